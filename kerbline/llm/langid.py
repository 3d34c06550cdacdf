"""Language of a text by a bidirectional gated recurrent network over bytes, trained by backpropagation through time.

Every byte is labelled from what stands to its left and to its right within its window of WINDOW bytes; a document's
probabilities are the mean over all its bytes. The network is a few thousand numbers; it is trained on a sample of
documents whose bounds are parameters and then applied to all windows of all documents, thousands side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.work import drawn

WINDOW = 128
SIDE_BY_SIDE = 2048  # windows
ROWS = 1024  # texts that are looked at together
LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"


def _tanh(x: np.ndarray) -> np.ndarray:
    return np.tanh(x, out=x)


@dataclass
class Network:
    """Per direction: byte table (256 x 3h, with the bias), recurrent weights (h x 3h); output weights (2h x labels) and bias.

    Columns are update gate, reset gate, candidate. A gate is (1 + tanh(x)) / 2, which is a logistic function of 2x.
    """

    labels: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @property
    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.recurrent, self.out, self.bias]


def fresh(labels: list[str], hidden: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    return Network(labels, [draw(256, 3 * hidden) for _ in range(2)], [draw(hidden, 3 * hidden) for _ in range(2)],
                   draw(2 * hidden, len(labels)), np.zeros(len(labels), dtype=np.float32))


def _direction(table: np.ndarray, recurrent: np.ndarray, steps: np.ndarray, live: np.ndarray, keep: bool):
    """States (time, row, h) of one direction; `steps` holds bytes by time. A padded place keeps the state as it is."""
    h = recurrent.shape[0]
    gates, candidate = np.ascontiguousarray(recurrent[:, : 2 * h]), np.ascontiguousarray(recurrent[:, 2 * h :])
    state = np.zeros((steps.shape[1], h), dtype=np.float32)
    states = np.empty((*steps.shape, h), dtype=np.float32)
    trace = []
    full = live.all(axis=1)
    for t in range(len(steps)):
        x = table[steps[t]]
        g = _tanh(x[:, : 2 * h] + state @ gates)
        g += 1
        g *= 0.5
        z, r = g[:, :h], g[:, h:]
        c = _tanh(x[:, 2 * h :] + (r * state) @ candidate)
        new = c + z * (state - c)
        if not full[t]:
            new = np.where(live[t][:, None], new, state)
        if keep:
            trace.append((state, z, r, c))
        state = new
        states[t] = new
    return states, trace


def _probabilities(net: Network, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    h = forward.shape[2]
    x = forward @ net.out[:h] + backward @ net.out[h:] + net.bias
    x -= x.max(axis=2, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=2, keepdims=True)
    return x


def label_windows(net: Network, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probabilities (time, row, label) for each byte of zero-padded windows."""
    steps = np.ascontiguousarray(rows.T)
    live = np.arange(rows.shape[1])[:, None] < lengths
    forward, _ = _direction(net.tables[0], net.recurrent[0], steps, live, False)
    backward, _ = _direction(net.tables[1], net.recurrent[1], steps[::-1], live[::-1], False)
    return _probabilities(net, forward, backward[::-1])


def _through_time(table, recurrent, steps, live, trace, d_states):
    """Gradients of one direction from those of its states."""
    h = recurrent.shape[0]
    d_table, d_recurrent = np.zeros_like(table), np.zeros_like(recurrent)
    carry = np.zeros_like(d_states[0])
    for t in range(len(steps) - 1, -1, -1):
        state, z, r, c = trace[t]
        d = carry + d_states[t]
        on = live[t][:, None]
        dn = np.where(on, d, 0)
        d_old = np.where(on, dn * z, d)
        dz = dn * (state - c) * 2 * z * (1 - z)
        dc = dn * (1 - z) * (1 - c * c)
        d_rs = dc @ recurrent[:, 2 * h :].T
        dr = d_rs * state * 2 * r * (1 - r)
        dg = np.concatenate([dz, dr], axis=1)
        d_old = d_old + d_rs * r + dg @ recurrent[:, : 2 * h].T
        d_recurrent[:, : 2 * h] += state.T @ dg
        d_recurrent[:, 2 * h :] += (r * state).T @ dc
        np.add.at(d_table, steps[t], np.concatenate([dg, dc], axis=1))
        carry = d_old
    return d_table, d_recurrent


def loss_and_gradients(net: Network, rows: np.ndarray, lengths: np.ndarray, gold: np.ndarray):
    """Mean cross entropy over live bytes, and its gradients in the order of `net.parameters`."""
    steps = np.ascontiguousarray(rows.T)
    live = np.arange(rows.shape[1])[:, None] < lengths
    forward, trace_f = _direction(net.tables[0], net.recurrent[0], steps, live, True)
    backward, trace_b = _direction(net.tables[1], net.recurrent[1], steps[::-1], live[::-1], True)
    p = _probabilities(net, forward, backward[::-1])
    n = max(1, live.sum())
    picked = np.take_along_axis(p, np.broadcast_to(gold[None, :, None], (*steps.shape, 1)), axis=2)[..., 0]
    loss = -(np.log(np.maximum(picked, 1e-9)) * live).sum() / n
    d = p.copy()
    np.put_along_axis(d, np.broadcast_to(gold[None, :, None], (*steps.shape, 1)), picked[..., None] - 1, axis=2)
    d *= live[:, :, None] / n
    h = forward.shape[2]
    flat = d.reshape(-1, d.shape[2])
    d_out = np.concatenate([forward.reshape(-1, h).T @ flat, backward[::-1].reshape(-1, h).T @ flat])
    tf, rf = _through_time(net.tables[0], net.recurrent[0], steps, live, trace_f, d @ net.out[:h].T)
    tb, rb = _through_time(net.tables[1], net.recurrent[1], steps[::-1], live[::-1], trace_b, (d @ net.out[h:].T)[::-1])
    return loss, [tf, tb, rf, rb, d_out, flat.sum(axis=0)]


def train(samples: list[tuple[bytes, str]], hidden: int = 8, rounds: int = 240, batch: int = 192, span: int = 48,
          rate: float = 0.02, seed: int = 5) -> Network:
    """Train on byte strings with their labels; labels are drawn evenly, whatever their shares. Deterministic."""
    labels = sorted({label for _, label in samples})
    net = fresh(labels, hidden, seed)
    if len(labels) < 2:
        return net
    by_label = [[s for s, label in samples if label == name] for name in labels]
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in net.parameters]
    second = [np.zeros_like(p) for p in net.parameters]
    for step in range(1, rounds + 1):
        gold = rng.integers(len(labels), size=batch)
        rows, lengths = np.zeros((batch, span), dtype=np.uint8), np.zeros(batch, dtype=np.int64)
        for i, g in enumerate(gold):
            s = by_label[g][rng.integers(len(by_label[g]))]
            at = rng.integers(max(1, len(s) - span + 1))
            piece = s[at : at + span]
            rows[i, : len(piece)] = np.frombuffer(piece, dtype=np.uint8)
            lengths[i] = len(piece)
        _, gradients = loss_and_gradients(net, rows, lengths, gold)
        norm = np.sqrt(sum(float((g * g).sum()) for g in gradients))
        now = rate * min(1.0, 2.0 * (1 - step / (rounds + 1)))
        for p, g, m, v in zip(net.parameters, gradients, first, second):
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def pooled(net: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the mean probabilities over its bytes, and how many of its bytes get each label."""
    total = np.zeros((len(texts), len(net.labels)))
    votes = np.zeros((len(texts), len(net.labels)), dtype=np.int64)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    count = -(-lengths // WINDOW)
    owner = np.repeat(np.arange(len(texts)), count)
    if not len(owner):
        return total, votes
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(WINDOW, lengths[owner] - place * WINDOW)
    data = np.frombuffer(b"".join(t.ljust(int(c) * WINDOW, b"\0") for t, c in zip(texts, count)), dtype=np.uint8).reshape(-1, WINDOW)
    for at in range(0, len(owner), SIDE_BY_SIDE):
        some = slice(at, at + SIDE_BY_SIDE)
        longest = int(size[some].max())
        p = label_windows(net, data[some, :longest], size[some])
        p *= (np.arange(longest)[:, None] < size[some])[:, :, None]
        who = owner[some]
        begin = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        total[who[begin]] += np.add.reduceat(p.sum(axis=0, dtype=np.float64), begin, axis=0)
        label = p.argmax(axis=2)
        live = p.max(axis=2) > 0
        for k in range(len(net.labels)):
            votes[who[begin], k] += np.add.reduceat(((label == k) & live).sum(axis=0), begin)
    return total / np.maximum(lengths, 1)[:, None], votes


def sample_bytes(docs: DataFrame, learn: Column, row_id: str, text: str, lang: str, per_label: int, chars: int) -> list[tuple[bytes, str]]:
    """At most `per_label` pieces of `chars` characters for each label, from different documents, chosen by hash."""
    at = F.pmod(F.xxhash64(F.lit(3), row_id), F.greatest(F.length(text) - chars, F.lit(0)) + 1)
    some = (docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
            .select(F.substring(text, at.cast("int") + 1, F.lit(chars)).alias("piece"), F.col(lang).alias("label"),
                    F.xxhash64(F.lit(11), row_id).alias("drawn")))
    rows = drawn(some, "label", ["drawn", "piece"], per_label).orderBy("label", "drawn", "piece").collect()
    return [(r["piece"].encode(), r["label"]) for r in rows]


def predict(docs: DataFrame, net: Network | None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (default: all but the text) with lang_pred, score, probabilities and bytes_by_label.

    Arrays follow the sorted labels of the network. A text that is null or holds no letter is `und` with score 0; so is
    every text when the network is None (nothing to learn from). A text of any length is labelled whole.
    """
    names = [c for c in docs.columns if c != text] if carry is None else carry
    data = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            texts = batch.column("_text").to_pylist()
            known = [net is not None and t is not None and LETTER.search(t) is not None for t in texts]
            lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            shares: list[list[float]] = [[] for _ in texts]
            votes: list[list[int]] = [[] for _ in texts]
            rows = [i for i, k in enumerate(known) if k]
            if rows:
                mean, counted = pooled(net, [texts[i].encode() for i in rows])
                for i, p, v in zip(rows, mean, counted):
                    best = int(p.argmax())
                    lang[i], score[i], shares[i], votes[i] = net.labels[best], min(1.0, float(p[best])), p.tolist(), v.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.list_(pa.float64())),
                 pa.array(votes, pa.list_(pa.int64()))], names=["_row", "lang_pred", "score", "probabilities", "bytes_by_label"])

    row = data.schema["_row"].dataType.simpleString()
    return (data.mapInArrow(run, f"_row {row}, lang_pred string, score double, probabilities array<double>, bytes_by_label array<long>")
            .select("_row.*", "lang_pred", "score", "probabilities", "bytes_by_label"))


def identify(docs: DataFrame, learn: Column, row_id: str = "doc_id", text: str = "text", lang: str = "lang",
             per_label: int = 600, chars: int = 400, carry: list[str] | None = None) -> DataFrame:
    """Train on a sample of the rows where `learn` holds and their label is not null, then label all rows.

    The sample holds at most `per_label` pieces of `chars` characters for each label. Labels, ids and other columns are
    no inputs of a prediction. With a single label in the sample every text with letters gets that label.
    """
    samples = sample_bytes(docs, learn, row_id, text, lang, per_label, chars)
    return predict(docs, train(samples) if samples else None, text, carry if carry is not None else [row_id])
