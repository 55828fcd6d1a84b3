"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (``PASSAGE`` consecutive words; the last may be
shorter; an empty text is one empty passage).  Every passage of the whole text
is encoded by a small network; gated attention gives each passage a weight,
learned from document labels alone; the weighted sum of the passages' codes is
scored.  Ilse, Tomczak and Welling: Attention-based Deep Multiple Instance
Learning (2018).

Inputs of a passage: the shares of its bytes by value, and word statistics
(lengths, repeats within the passage and within the document, capitals,
digits, punctuation).  Labels, language, source and identifiers are no inputs.

Fitting uses at most ``sample`` labelled rows, chosen by a hash of the
identifier from those not held out; scoring reads every text whole.  Defined
results: null text is empty; repeated rows get equal scores; an identifier
with several labels counts as good if any label says so; null labels and null
identifiers are not learned from; with no labelled rows, or labels of one kind
only, every score is the share of good labels (1.0 if there are none); an
empty table gives no rows; further columns pass through."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import map_arrow, slices
from tidewire.llm.words import U, Words

PASSAGE = 48
BYTES = 129  # each ASCII value, and all others together
STATS = 12
WIDTH = BYTES + STATS
HIDDEN, GATES = 24, 12


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(inputs of all passages, for each text the number of its first passage
    with one entry more)."""
    words = Words(texts)
    n = words.counts()
    per = np.maximum(1, -(-n // PASSAGE))
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(per, out=first[1:])
    total = int(first[-1])
    x = np.zeros((total, WIDTH), np.float32)
    x[first[:-1][n == 0], WIDTH - 1] = 1
    if not len(words):
        return x, first
    doc = np.repeat(np.arange(len(n)), n)
    of = first[doc] + (np.arange(len(words)) - words.first[doc]) // PASSAGE  # passage of each word
    size = words.end - words.start
    # the bytes of a passage reach from its first word to its last
    lo = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    ids, hi = of[lo], np.append(lo[1:], len(of))
    begin, end = words.start[lo], words.end[hi - 1]
    length = end - begin
    at = np.arange(int(length.sum())) + np.repeat(begin - (np.cumsum(length) - length), length)
    value = np.minimum(words.data[at], 128).astype(np.int64)
    share = np.bincount(np.repeat(ids, length) * BYTES + value, minlength=total * BYTES)
    share = share.reshape(total, BYTES).astype(np.float32)
    x[:, :BYTES] = np.sqrt(share / np.maximum(1, share.sum(1, keepdims=True)))

    def mean(v):
        return np.bincount(of, weights=v, minlength=total) / count

    count = np.maximum(1, np.bincount(of, minlength=total))
    h = words.hashes()
    head, tail = words.data[words.start], words.data[words.end - 1]
    letter = lambda b: ((b | 32) >= 97) & ((b | 32) <= 122) | (b > 127)
    capital = lambda b: (b >= 65) & (b <= 90)

    def again(group):
        """Words that their group already has."""
        order = np.lexsort((h, group))
        same = np.zeros(len(h), bool)
        same[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (group[order[1:]] == group[order[:-1]])
        return same

    follow = np.zeros(len(h), U)
    follow[:-1] = h[1:]
    pair = h * U(0x9E3779B97F4A7C15) + follow
    keep, h = h, pair
    pairs_again = again(doc)
    h = keep
    sizes = mean(size)
    x[:, BYTES:] = np.stack([
        sizes / 8, np.sqrt(np.maximum(0, mean(size.astype(float) ** 2) - sizes**2)) / 4, mean(size <= 3),
        mean(again(of)), mean(again(doc)), mean(pairs_again), mean(capital(head)), mean(capital(tail)),
        mean(~letter(head)), mean(~letter(tail)), np.log1p(count) / 4,
        x[:, WIDTH - 1]], 1)
    return x, first


def forward(m: dict, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Scores of the bags, and what training needs."""
    z = (x - m["mean"]) / m["std"]
    code = np.tanh(z @ m["W"] + m["b"])
    t, g = np.tanh(code @ m["V"]), 1 / (1 + np.exp(-np.clip(code @ m["G"], -30, 30)))
    e = (t * g) @ m["a"]
    bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
    e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
    weight = e / np.add.reduceat(e, first[:-1])[bag]
    whole = np.add.reduceat(weight[:, None] * code, first[:-1])
    score = 1 / (1 + np.exp(-np.clip(whole @ m["u"] + m["c"], -30, 30)))
    return score, (z, code, t, g, weight, whole, bag)


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 40, rate: float = 0.01,
        decay: float = 1e-4, seed: int = 1) -> dict:
    """Learn from bags: gradient steps (Adam) on the mean log loss."""
    rng = np.random.default_rng(seed)
    m = {"mean": x.mean(0), "std": x.std(0) + 0.02}
    shapes = {"W": (WIDTH, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATES), "G": (HIDDEN, GATES),
              "a": (GATES,), "u": (HIDDEN,), "c": (1,)}
    m |= {k: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32) * (len(s) > 1 or k in "au") for k, s in shapes.items()}
    moment = {k: [np.zeros(s, np.float32), np.zeros(s, np.float32)] for k, s in shapes.items()}
    step, n = 0, len(y)
    for epoch in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, 128):
            own = order[i:i + 128]
            size = first[own + 1] - first[own]
            f = np.zeros(len(own) + 1, np.int64)
            np.cumsum(size, out=f[1:])
            rows = np.arange(f[-1]) + np.repeat(first[own] - f[:-1], size)
            p, (z, code, t, g, weight, whole, bag) = forward(m, x[rows], f)
            d = (p - y[own]).astype(np.float32) / len(own)
            d_whole = d[:, None] * m["u"]
            d_weight = (code * d_whole[bag]).sum(1)
            inner = np.add.reduceat(weight * d_weight, f[:-1])
            d_e = weight * (d_weight - inner[bag])
            d_gate = d_e[:, None] * m["a"]
            d_t, d_g = d_gate * g * (1 - t**2), d_gate * t * g * (1 - g)
            d_code = weight[:, None] * d_whole[bag] + d_t @ m["V"].T + d_g @ m["G"].T
            d_pre = d_code * (1 - code**2)
            grads = {"W": z.T @ d_pre, "b": d_pre.sum(0), "V": code.T @ d_t, "G": code.T @ d_g,
                     "a": (t * g).T @ d_e, "u": whole.T @ d, "c": np.array([d.sum()])}
            step += 1
            now = rate * (1 - epoch / epochs)
            for k, grad in grads.items():
                grad = grad + decay * m[k]
                one, two = moment[k]
                one[:] = 0.9 * one + 0.1 * grad
                two[:] = 0.999 * two + 0.001 * grad**2
                m[k] = m[k] - now * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    return m


def _encoder(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            x, first = passages(part.column("text"))
            yield pa.record_batch([
                part.column("doc_id"), part.column("label"),
                pa.array([x[a:b].astype(np.float16).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)],
                         pa.binary())], names=["doc_id", "label", "inputs"])


def held_out(id_col) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", sample: int = 4000) -> dict:
    """A model from at most ``sample`` labelled rows that are not held out."""
    good = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
            .groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # at most `sample` pairs of numbers: the bound of the broadcast
    bags = map_arrow(texts.join(F.broadcast(good), "doc_id").dropDuplicates(["doc_id"]), _encoder,
                     "doc_id long, label int, inputs binary").collect()
    bags.sort(key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in bags], np.float32)
    if len(y) == 0 or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 1.0}
    inputs = [np.frombuffer(r["inputs"], np.float16).reshape(-1, WIDTH) for r in bags]
    first = np.zeros(len(inputs) + 1, np.int64)
    np.cumsum([len(i) for i in inputs], out=first[1:])
    epochs = max(40, min(200, 80_000 // len(y)))
    return fit(np.concatenate(inputs).astype(np.float32), first, y, epochs=epochs)


def score(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column more: the score of each whole text.  A column of
    that name is replaced."""
    docs = docs.drop(score_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                if "constant" in model:
                    p = np.full(part.num_rows, model["constant"])
                else:
                    p = forward(model, *passages(part.column(text_col).cast(pa.string())))[0].astype(float)
                yield pa.record_batch([*part.columns, pa.array(p, pa.float64())], names=[*part.schema.names, score_col])

    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return map_arrow(docs, run, docs.withColumn(score_col, F.lit(0.0)).schema)
