"""Document fingerprints: a Merkle tree over sentences, paragraphs and sections.

A text is cut into lines (paragraphs); runs of paragraphs form sections, whose borders a paragraph's own hash decides (one
in about eight), so an edit moves no border but those next to it. A paragraph's children are its sentences, and sentences
without a stop for long are cut every PIECE characters. Leaves are finer at the beginning of a text, down to words, so that
they are small beside a text of any length. Every node's hash covers its children's; the root is over the
sections, so equal roots mean equal texts. A fingerprint is the tree as text:

    root;section:paragraph,paragraph;section:paragraph…      with a paragraph as  hash=leaf.leaf.leaf

where a leaf is six hex digits and its length in characters. Two fingerprints are compared from the top: equal roots
are equal texts, equal sections and paragraphs count whole, and only where branches differ are leaves looked at.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.work import stored

PIECE = 128
LEAF = regex.compile(r"[^.!?|]{1,%d}[.!?|]*|[.!?|]{1,%d}" % (PIECE, PIECE))
# (up to this character of the text, leaves): words first, then short pieces
FINER = ((256, regex.compile(r"\S{1,8}\s*|\s+")), (1024, regex.compile(r"[^.!?|]{1,32}[.!?|]*|[.!?|]{1,32}")))
SECTION_RATE = 8


def _digest(data: str) -> str:
    return hashlib.blake2b(data.encode(), digest_size=16).hexdigest()


def _pieces(line: str, at: int, begin: int = 0) -> list[str]:
    """Leaves, from character `begin` of it on, of a line that begins at character `at` of its text."""
    out = []
    for upto, leaf in FINER:
        end = min(len(line), upto - at)
        if begin < end:
            out += leaf.findall(line[begin:end])
            begin = end
    return out + LEAF.findall(line[begin:] if begin else line)


def tree(text: str, like: list[tuple[str, list[str]]] | None = None, same: int = 0) -> list[tuple[str, list[str]]]:
    """The paragraphs of a text as (digest, leaves).

    With the paragraphs `like` of another text that has the first `same` characters in common, what lies within those is
    taken over: whole paragraphs, and leaves that end before them. A leaf is found from left to right and depends on nothing
    behind the character that follows it.
    """
    out, at = [], 0
    for n, line in enumerate(text.split("\n") if text else []):
        known = like[n] if like is not None and n < len(like) and at < same else None
        if known is not None and at + len(line) < same:
            out.append(known)
        else:
            leaves, begin = [], 0
            for leaf in known[1] if known is not None else ():
                end = begin + int(leaf[6:], 16)
                if at + end >= same:
                    break
                leaves.append(leaf)
                begin = end
            leaves += [f"{xxhash.xxh3_64_intdigest(p) & 0xFFFFFF:06x}{len(p):x}" for p in _pieces(line, at, begin)]
            out.append((_digest(line), leaves))
        at += len(line) + 1
    return out


def written(paragraphs: list[tuple[str, list[str]]]) -> str:
    """The fingerprint of a tree."""
    sections, nodes, whole = [], [], []
    for inner, leaves in paragraphs:
        nodes.append(f"{inner[:16]}=" + ".".join(leaves))
        whole.append(inner)
        if int(inner[-4:], 16) % SECTION_RATE == 0:
            sections.append((_digest("".join(whole)), nodes))
            nodes, whole = [], []
    if nodes:
        sections.append((_digest("".join(whole)), nodes))
    root = _digest("".join(s for s, _ in sections))
    return ";".join([root, *(f"{s[:16]}:" + ",".join(p) for s, p in sections)])


def fingerprint(text: str) -> str:
    """The tree of a text as text; '' has a root and nothing below it."""
    return written(tree(text))


def _leaves(paragraphs: list[str]) -> Counter:
    """How often each leaf occurs, counted in one go: a sum of counters looks at all leaves again for every paragraph."""
    return Counter([leaf for p in paragraphs for leaf in p.partition("=")[2].split(".") if leaf])


def _characters(leaves: Counter) -> int:
    return sum(int(leaf[6:], 16) * n for leaf, n in leaves.items())


def _unmatched(one: list[str], two: list[str], stop: str) -> tuple[list[str], list[str]]:
    """Nodes without a partner of the same hash, which ends at `stop`; equal nodes may have other leaves elsewhere in a text."""
    left = []
    for nodes, others in ((one, two), (two, one)):
        there = Counter(n.partition(stop)[0] for n in others)
        rest = []
        for n in nodes:
            name = n.partition(stop)[0]
            if there[name]:
                there[name] -= 1
            else:
                rest.append(n)
        left.append(rest)
    return left[0], left[1]


def differing(one: str, two: str) -> tuple[list[str], list[str]]:
    """Paragraph nodes of each fingerprint that have no partner in the other: this is where the texts were edited."""
    if one.partition(";")[0] == two.partition(";")[0]:
        return [], []
    a, b = _unmatched(one.split(";")[1:], two.split(";")[1:], ":")
    return _unmatched([p for s in a for p in s.partition(":")[2].split(",")], [p for s in b for p in s.partition(":")[2].split(",")], "=")


def _size(print_: str) -> int:
    return sum(int(leaf[6:], 16) for s in print_.split(";")[1:] for p in s.partition(":")[2].split(",")
               for leaf in p.partition("=")[2].split(".") if leaf)


def likeness(one: str, two: str) -> float:
    """Twice the characters below common nodes over all characters, from the fingerprints alone; 1 for equal roots only."""
    if one.partition(";")[0] == two.partition(";")[0]:
        return 1.0
    total = _size(one) + _size(two)
    if not total:
        return 0.0
    a, b = differing(one, two)
    left, right = _leaves(a), _leaves(b)
    apart = _characters(left - right) + _characters(right - left)
    return min((total - apart) / total, 1 - 1 / (total + 1))


def edited(text: str, following: str) -> str:
    """`text` with its last quarter (rounded down) replaced by as many code points of the text that follows, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _row(row_id, text: str, paragraphs: list, own: str, following: str, next_print: str) -> dict:
    changed = edited(text, following)
    changed_print = own if changed == text else written(tree(changed, paragraphs, len(text) - len(text) // 4))
    return {"row_id": row_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(), "fingerprint": own,
            "edited_fingerprint": changed_print, "near_edited": likeness(own, changed_print), "near_next": likeness(own, next_print)}


RESULT = ("row_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
          "near_next double")
FIELDS = ["row_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _arrow(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("kind", pa.string()), ("part", pa.int32()), ("text", pa.string()), ("row_id", id_type), ("n_chars", pa.int64()),
                      ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                      ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order: each is compared with the next; the first and the last text are passed on as well."""
    part = TaskContext.get().partitionId()
    held = schema = None
    for batch in batches:
        schema = _arrow(batch.schema.field("row_id").type)
        out = []
        for row_id, text in zip(batch.column("row_id").to_pylist(), batch.column("text").to_pylist()):
            paragraphs = tree(text)
            own = written(paragraphs)
            if held is None:
                out.append({"kind": "first", "part": part, "row_id": row_id, "text": text})
            else:
                row = _row(*held, text, own)
                # both fingerprints in one column: what they share is stored once by the compression
                row["fingerprint"] += "\n" + row.pop("edited_fingerprint")
                out.append({"kind": "row", "part": part, **row})
            held = (row_id, text, paragraphs, own)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if held is not None:
        yield pa.RecordBatch.from_pylist([{"kind": "last", "part": part, "row_id": held[0], "text": held[1]}], schema=schema)


def _at_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        schema = _arrow(batch.schema.field("row_id").type)
        columns = (batch.column(c).to_pylist() for c in ("row_id", "text", "following"))
        rows = [_row(i, t, tree(t), fingerprint(t), n, fingerprint(n)) for i, t, n in zip(*columns)]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([schema.field(c) for c in FIELDS]))


def compare_with_next(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form, and likeness to that and to the next row's text.

    Rows are put in order of the id (null first; equal ids by a hash of the text, then by the text) by one range exchange;
    every task walks through its range with one row held. Only the first and last text of each range meet afterwards.
    After the last row comes the first; a single row follows itself. A null text counts as empty. Equal rows are compared
    with each other. Other columns are not looked at. An empty table gives an empty table.
    """
    kind = docs.schema[row_id].dataType.simpleString()
    data = docs.select(F.col(row_id).alias("row_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    result = RESULT.format(id=kind)
    walked = stored(data.repartitionByRange("row_id", tie).sortWithinPartitions("row_id", tie, "text")
                    .mapInArrow(_in_order, f"kind string, part int, text string, {result}"), "walked", ["kind"])
    # at most two rows a range from here on
    parts = walked.where("kind = 'first'").select("part")
    follow = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next"))
    borders = (walked.where("kind = 'last'").select("part", "row_id", "text").join(follow, "part")
               .join(walked.where("kind = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following")), "next")
               .select("row_id", "text", "following").mapInArrow(_at_borders, result))
    both = F.col("fingerprint")
    rows = walked.where("kind = 'row'").withColumns({
        "fingerprint": F.substring_index(both, "\n", 1), "edited_fingerprint": F.substring_index(both, "\n", -1)})
    return rows.select(*FIELDS).unionByName(borders)
