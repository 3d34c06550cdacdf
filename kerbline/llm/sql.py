"""Independent SQL for the registered queries that SQL can express, by plain definitions: all pairs, all prefixes, all words."""

from __future__ import annotations

from kerbline.llm.chat import CLOSE, OPEN
from kerbline.llm.spelling import LOWER, UPPER

ORACLE: dict[str, str] = {}

_WORD = r"[^\x20\x09-\x0D]+"
# crc32 byte by byte; the table follows from the polynomial
_TABLE = ("crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) "
          "ELSE c >> 1 END, i) AS v FROM range(256) AS r(i)))")


def _crc32(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of a text; needs the table `crc` beside it."""
    digits = f"hex(encode({text}))"
    each = f"list_transform(range(1, length({digits}), 2), lambda p: cast('0x' || {digits}[p:p + 1] AS bigint))"
    return f"xor(list_reduce({each}, lambda c, b: xor(c >> 8, t[xor(c, b) & 255 + 1]), 4294967295::bigint), 4294967295)".replace("& 255 + 1", "& 255) + 1").replace("t[xor(", "t[(xor(")


def _components(nodes: str) -> str:
    """Tables `reach` and `least` over `links` (a, b in both directions) and nodes (id)."""
    return (f"reach AS (SELECT id AS a, id AS b FROM {nodes} UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b), "
            "least AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a), "
            "counted AS (SELECT a AS id, count(*) AS n_links FROM links GROUP BY a)")


ORACLE["op2_epsilon_grid_join"] = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: cast(x AS double)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.id <> q.id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.9),
{_components('v')}
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN least ON least.id = vec_id LEFT JOIN counted ON counted.id = vec_id"""

ORACLE["op6_ngram_jaccard"] = f"""
WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORD}') AS w FROM documents),
s AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
u AS (SELECT id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT p.id AS a, q.id AS b FROM u p JOIN u q ON p.x = q.x AND p.id <> q.id GROUP BY p.id, q.id
    HAVING 100 * count(*) >= 80 * (any_value(p.n) + any_value(q.n) - count(*))),
{_components('s')}
SELECT s.id AS doc_id, cast(len(s) AS bigint) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
FROM s JOIN least ON least.id = s.id LEFT JOIN counted ON counted.id = s.id"""

_MARKS = r"'\\*</?s>'"
_SAID = "string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)"
_LOSS = "string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY place)"
ORACLE["op9_chat_formatting"] = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
e AS (SELECT *, sum({len(OPEN) + 1 + len(CLOSE)} + length(role) + len(regexp_extract_all(role, '[\\\n]')) + len(regexp_extract_all(role, '</?s>'))
    + length(text) + len(regexp_extract_all(text, {_MARKS}))) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM p)
SELECT conv_id, cast(count(*) AS bigint) AS n_turns, sha256({_SAID}) AS turns_sha256, cast(length({_LOSS}) AS bigint) AS loss_chars, sha256({_LOSS}) AS loss_sha256,
    cast(sum(CASE WHEN role = 'assistant' OR place = n THEN upto ELSE 0 END) AS bigint) AS formatted_chars
FROM e GROUP BY conv_id"""

ORACLE["op11_mtree_search"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x AS double))) AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, cast(list_inner_product(q.e, c.e) AS bigint) AS score FROM v q JOIN v c
    ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS integer) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

ORACLE["op12_partenum_variants"] = f"""
WITH RECURSIVE {_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
hashed AS (SELECT run, {_crc32("doc_id || ':' || run")} AS h FROM runs, crc WHERE length(run) >= 5),
edited AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
v AS (SELECT word, count(*) AS n FROM edited WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3),
without AS (SELECT word, p, left(word, p - 1) || substring(word, p + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM v)),
pairs AS (SELECT a.word AS x, b.word AS y FROM without a JOIN without b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
    UNION SELECT a.word, v.word FROM without a JOIN v ON a.rest = v.word UNION SELECT v.word, a.word FROM without a JOIN v ON a.rest = v.word),
ranked AS (SELECT x, y, v.n AS m, row_number() OVER (PARTITION BY x ORDER BY v.n DESC, encode(y)) AS k, count(*) OVER (PARTITION BY x) AS n_near
    FROM pairs JOIN v ON v.word = y),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN y END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n
    FROM v LEFT JOIN ranked ON x = word AND k = 1),
walk AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.next)
SELECT f.word, form, walk.at AS root, n, n_near, form_n FROM f JOIN walk ON walk.word = f.word WHERE walk.next IS NULL"""

ORACLE["op13_prefix_trie"] = f"""
WITH {_TABLE},
own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT own.*, {_crc32("conv_id::varchar")} % 9 AS h FROM own, crc),
made AS (SELECT h.conv_id, list_concat(coalesce(base.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN own base ON base.conv_id = h.conv_id - h.conv_id % 5),
member AS (SELECT conv_id, d, sha256(cast(turns[1:d] AS varchar)) AS k, CASE WHEN d > 0 THEN sha256(cast(turns[1:d - 1] AS varchar)) END AS up,
    CASE WHEN d > 0 THEN octet_length(encode(turns[d].text)) ELSE 0 END AS size, d = len(turns) AS ends, turns FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM made)),
node AS (SELECT d, k, up, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size, any_value(turns[1:d]) AS path,
    sha256(coalesce(string_agg(cast(conv_id AS varchar), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM member GROUP BY d, k, up),
child AS (SELECT up AS k, count(*) AS n_children FROM node GROUP BY up),
below AS (SELECT sha256(cast(path[1:a] AS varchar)) AS k, count(*) FILTER (n_children IS NULL) AS n_leaves, cast(sum((n - 1) * size) AS bigint) AS saved_tokens
    FROM (SELECT node.*, child.n_children, unnest(range(0, d + 1)) AS a FROM node LEFT JOIN child ON child.k = node.k) GROUP BY 1)
SELECT node.conv_id, cast(node.d AS bigint) AS depth, parent.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
    node.ends_sha256 FROM node LEFT JOIN node parent ON parent.k = node.up LEFT JOIN child ON child.k = node.k JOIN below ON below.k = node.k"""
