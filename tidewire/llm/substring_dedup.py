"""Substring deduplication: words covered by a window of consecutive words
that also starts elsewhere are removed.

1. Sketch.  Every task counts its windows in a count-min sketch (two rows of
   cells, counts cut off at two, sent as sparse cell lists); the sketches are
   merged cell block by cell block.  What remains is one bit per cell: "two or
   more".  An estimate is never too low, so no repeated window is lost.  The
   number of cells follows the input up to ``sketch_bytes``; beyond that the
   estimate gets looser and the second pass exact-groups more windows, up to
   all of them, with the same result.
2. Exact groups.  A second pass takes only windows estimated repeated.  A task
   that sees a window twice settles its own occurrences at once and sends one
   row for it, so a window that stands in a third of all documents costs at
   most one row per task.  The others are grouped by 96 hash bits.
3. Each document's covered words are cut out of its whole text.

Windows are judged on the input.  Defined results: null text has no words; a
document shorter than a window keeps all its words; repeated rows are
documents of their own (their windows start elsewhere); identifiers that are
null or not unique are replaced by a key of identifier and text inside; an
empty table gives no rows; further columns are not read.  Memory: one flush of
windows, the sketch bits, one document with its covered ranges."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import map_arrow, slices
from tidewire.llm.words import U, Words, mix

_BLOCK = 1 << 20
_ROWS = 2
#: In the low 32 bits of a row: a place, a run's place plus RUN, or NOWHERE.
RUN, NOWHERE = 1 << 31, (1 << 32) - 1
_SEEDS = (U(0), U(0x2545F4914F6CDD1D))


def _cells(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(h ^ _SEEDS[row]) if row else h) & U(cells - 1)


def _gaps(index: np.ndarray) -> bytes:
    """Sorted numbers as byte planes of their gaps (the high planes are all but zero)."""
    gaps = np.diff(index.astype(np.int64), prepend=0).astype("<u4")
    return gaps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _ungaps(data) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4")[:, 0].astype(np.int64))


def _sketcher(size: int, cells: int, flush: int):
    def count(batches):
        held, n = [[] for _ in range(_ROWS)], 0
        for batch in batches:
            for part in slices(batch, "text"):
                h = Words(part.column("text")).windows(size)[1]
                for row in range(_ROWS):
                    held[row].append(_cells(h, row, cells).astype(np.uint32))  # cells < 2**32
                n += len(h)
                if n >= flush:
                    yield from send(held)
                    held, n = [[] for _ in range(_ROWS)], 0
        if n:
            yield from send(held)

    def send(held):
        for row in range(_ROWS):
            c = np.concatenate(held[row])
            held[row].clear()
            c.sort()
            same = np.append(c[1:] == c[:-1], False)
            new = np.append(True, ~same[:-1])
            c, many = c[new], same[new]
            cut = np.flatnonzero(np.append(True, c[1:] // _BLOCK != c[:-1] // _BLOCK))
            ends = np.append(cut[1:], len(c))
            for k in range(0, len(cut), 64):
                out = []
                for lo, hi in zip(cut[k:k + 64], ends[k:k + 64], strict=True):
                    local, two = c[lo:hi] % _BLOCK, many[lo:hi]
                    out.append((int(c[lo]) // _BLOCK * _ROWS + row, _gaps(local), _gaps(local[two])))
                yield pa.record_batch([pa.array(x) for x in zip(*out, strict=True)],
                                      names=["slot", "once", "twice"])

    return count


def _merge(batches):
    """Merge the sparse sketches of each slot; rows arrive sorted by slot."""
    slot, seen, twice = None, None, None

    def done():
        return pa.record_batch([pa.array([slot], pa.int64()),
                                pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())],
                               names=["slot", "bits"])

    for batch in batches:
        for s, once, two in zip(batch.column("slot").to_pylist(), batch.column("once"), batch.column("twice"),
                                strict=True):
            once, two = once.as_buffer(), two.as_buffer()
            if s != slot:
                if slot is not None:
                    yield done()
                slot, seen, twice = s, np.zeros(_BLOCK, bool), np.zeros(_BLOCK, bool)
            index = _ungaps(once)
            twice[index[seen[index]]] = True
            seen[index] = True
            twice[_ungaps(two)] = True
    if slot is not None:
        yield done()


def _finder(size: int, cells: int, flush: int, bits):
    def test(h):
        hit = np.ones(len(h), bool)
        for row in range(_ROWS):
            c = _cells(h, row, cells)
            hit &= (bits.value[row][c >> U(3)] >> (c & U(7)).astype(np.uint8)) & 1 == 1
        return hit

    def find(batches):
        held, n = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                at, h1 = words.windows(size)
                hit = test(h1)
                at, h1 = at[hit], h1[hit]
                h2 = words.windows(size, 1)[1][hit] >> U(32)
                doc = np.searchsorted(words.first, at, side="right") - 1
                key = part.column("key").to_numpy(zero_copy_only=False)[doc]
                held.append((h1, h2, key, at - words.first[doc]))
                n += len(at)
                if n >= flush:
                    yield from send(held)
                    held, n = [], 0
        if n:
            yield from send(held)

    def send(held):
        h1, h2, key, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        group = np.cumsum(new) - 1
        many = np.bincount(group) > 1
        settled = np.empty(len(h1), bool)
        settled[order] = many[group]
        head = np.zeros(len(h1), bool)
        head[order[new]] = True
        # a row per window in the order of the text; settled windows send one without a place
        rows = np.flatnonzero(head)
        nowhere = settled[rows]
        yield from batches_of(h1[rows], h2[rows], np.where(nowhere, 0, key[rows]),
                              np.where(nowhere, NOWHERE, pos[rows]))
        # settled occurrences leave as runs of window starts, with the run's length for a hash
        at = np.flatnonzero(settled)
        if len(at):
            start = np.concatenate([[True], (key[at][1:] != key[at][:-1]) | (pos[at][1:] != pos[at][:-1] + 1)])
            first = at[start]
            length = np.diff(np.append(np.flatnonzero(start), len(at)))
            spread = mix(key[first].astype(U) ^ (pos[first].astype(U) << U(40)))
            yield from batches_of(spread, length, key[first], pos[first] + RUN)

    def batches_of(h1, h2, key, pos):
        packed = ((h2.astype(U) << U(32)) | pos.astype(U)).view(np.int64)
        for i in range(0, len(h1), 50_000):
            j = slice(i, i + 50_000)
            yield pa.record_batch([pa.array(h1[j].view(np.int64)), pa.array(packed[j]), pa.array(key[j])],
                                  names=["h1", "packed", "key"])

    return find


def _pack(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            text = [b"" if t is None else t.as_buffer() for t in part.column("text")]
            yield pa.record_batch([
                part.column("key"), part.column("doc_id"), part.column("carry"),
                pa.array([len(t) for t in text], pa.int64()),
                pa.array([pa.compress(t, "zstd", asbytes=True) if len(t) else b"" for t in text], pa.binary())],
                names=["key", "doc_id", "carry", "n_bytes", "packed_text"])


def _cutter(size: int, with_text: bool):
    def cut(batches):
        for batch in batches:
            rows = [[] for _ in range(4)]
            for n, packed, starts, runs in zip(
                    *(batch.column(c).to_pylist() for c in ("n_bytes", "packed_text", "starts", "runs")), strict=True):
                text = pa.decompress(packed, n, "zstd", asbytes=True) if n else b""
                words = Words(pa.array([text], pa.binary()))
                total = len(words)
                kept = np.arange(total)
                if starts or runs:
                    edge = np.zeros(total + 1, np.int64)
                    np.add.at(edge, np.asarray(starts or [], np.int64), 1)
                    np.add.at(edge, np.asarray(starts or [], np.int64) + size, -1)
                    r = np.asarray(runs or [], np.int64)
                    np.add.at(edge, r >> 32, 1)
                    np.add.at(edge, (r >> 32) + (r & 0xFFFFFFFF) - 1 + size, -1)
                    kept = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                whole = len(kept) == total
                for x, v in zip(rows, (total, total - len(kept), hashlib.sha256(words.text(kept)).hexdigest(),
                                       (text if whole else words.cut(text, kept)) if with_text else None), strict=True):
                    x.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.record_batch([batch.column("doc_id"), batch.column("carry")]
                                  + [pa.array(x, k) for x, k in zip(rows, kinds, strict=True)],
                                  names=["doc_id", "carry", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return cut


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 35,
                    with_text: bool = False, sketch_bytes: int = 128 << 20, flush: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: of the words that stay, joined
    by one space.  ``with_text`` adds kept_text, the text without the removed
    words and the white space after each, and ``row``, the input row."""
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if with_text and c != text_col] or [F.lit(0).alias("none")])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       row.alias("carry"))
    facts = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()
    twice = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    unique = twice.isEmpty()
    rows = rows.withColumn("key", F.col("doc_id") if unique else F.xxhash64("doc_id", "text"))

    most = max(_BLOCK, sketch_bytes * 8 // _ROWS)
    cells = _BLOCK
    while cells < (facts["bytes"] or 0) // 2 and cells * 2 <= most:
        cells *= 2
    sparse = map_arrow(rows.select("text"), _sketcher(size, cells, flush), "slot long, once binary, twice binary")
    merged = map_arrow(sparse.repartition("slot").sortWithinPartitions("slot"), _merge, "slot long, bits binary")
    bits = [np.zeros(cells // 8, np.uint8) for _ in range(_ROWS)]
    for r in merged.toLocalIterator():  # cells / 8 bytes for each row of the sketch: at most sketch_bytes
        block, row = divmod(r["slot"], _ROWS)
        bits[row][block * _BLOCK // 8:(block + 1) * _BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    found = map_arrow(rows.select("key", "text"), _finder(size, cells, flush // 8, shared),
                      "h1 long, packed long, key long")
    found = found.select("h1", F.shiftright("packed", 32).cast("int").alias("h2"),
                         F.col("packed").bitwiseAND(F.lit(NOWHERE)).alias("pos"), "key")
    weight = F.when(F.col("pos") >= RUN, 2).otherwise(1)
    found = (found.withColumn("n", F.sum(weight).over(Window.partitionBy("h1", "h2")))
             .where((F.col("n") > 1) & (F.col("pos") != NOWHERE)))
    cover = found.groupBy("key").agg(
        F.collect_list(F.when(F.col("pos") < RUN, F.col("pos")).cast("int")).alias("starts"),
        F.collect_list(F.when(F.col("pos") >= RUN, F.shiftleft(F.col("pos") - RUN, 32) + F.col("h2"))).alias("runs"))
    carry = rows.schema["carry"].dataType.simpleString()
    texts = map_arrow(rows, _pack, f"key long, doc_id long, carry {carry}, n_bytes long, packed_text binary")
    out = map_arrow(texts.join(cover, "key", "left"), _cutter(size, with_text),
                    f"doc_id long, carry {carry}, n_words long, n_removed long, kept_sha256 string, kept_text binary")
    if not with_text:
        return out.drop("kept_text", "carry")
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256",
                      F.col("kept_text").cast("string").alias("kept_text"), F.col("carry").alias("row"))


