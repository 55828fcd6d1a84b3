"""Fill-in-middle transformation with a piecewise-linear learned rank index.

A text is cut into units (a run of ASCII letters, or one other code point).
Cuts are drawn as unit ranks, and a rank has to become an offset.  For this the
boundary offsets of a text (0, the end of each unit) are learned as a function
of their rank: a greedy shrinking cone fits linear segments that are off by at
most ``error`` code points anywhere, and the residual of every boundary is
stored in a byte.  A cut is predicted from its segment and corrected by its
residual, so it is exact; the index is some bytes for each segment and one for
each unit.  ``rank_index`` returns the stored index of all texts (to draw
other cuts later without parsing the texts again), ``fill_in_middle`` uses it
at once.

Draws come from the SHA-256 of ``seed:doc_id`` (four 8-digit groups), so they
depend on the identifier alone.  psm and spm outputs can be undone by their
sentinels, since texts that contain one stay plain.

Defined results: null text counts as empty and stays plain; a null identifier
is drawn as the empty string; repeated rows come out one by one; an empty table
gives no rows; further columns are not read.  Memory: a slice of about 1 MB of
texts, or one longer text, with its offsets."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import map_arrow, slices

# Sentinels and shares.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
ERROR = 127  # residuals fit in a signed byte


class RankIndex(NamedTuple):
    """Segments of (first rank, its offset, slope) and one residual a rank."""
    rank: np.ndarray
    offset: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def offsets(self, ranks) -> np.ndarray:
        """The exact offsets of these ranks: predicted, then corrected."""
        ranks = np.asarray(ranks, np.int64)
        return self._predict(ranks) + self.residual[ranks]

    def _predict(self, ranks: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.rank, ranks, "right") - 1
        return self.offset[s] + np.rint(self.slope[s] * (ranks - self.rank[s])).astype(np.int64)


def fit(offsets: np.ndarray, error: int = ERROR) -> RankIndex:
    """Greedy shrinking cone: a segment starts at a boundary and goes on as
    long as one slope keeps all its boundaries within ``error``; the cone is
    narrowed over blocks of growing size."""
    ranks, starts, slopes = [], [], []
    n, at, room = len(offsets), 0, error - 0.5  # the prediction is rounded
    while at < n:
        low, high, end, block = -np.inf, np.inf, at + 1, 1024
        while end < n:
            stop = min(end + block, n)
            run = np.arange(end - at, stop - at, dtype=np.float64)
            rise = (offsets[end:stop] - offsets[at]).astype(np.float64)
            lows = np.maximum.accumulate(np.maximum((rise - room) / run, low))
            highs = np.minimum.accumulate(np.minimum((rise + room) / run, high))
            closed = np.flatnonzero(lows > highs)
            good = int(closed[0]) if len(closed) else stop - end
            if good:
                low, high = lows[good - 1], highs[good - 1]
            end += good
            if len(closed):
                break
            block *= 2
        ranks.append(at)
        starts.append(int(offsets[at]))
        slopes.append((low + high) / 2 if end > at + 1 else 0.0)
        at = end
    index = RankIndex(np.array(ranks, np.int64), np.array(starts, np.int64), np.array(slopes, np.float64),
                      np.zeros(0, np.int8))
    residual = offsets - index._predict(np.arange(n))
    small = residual.astype(np.int8) if error <= 127 else residual.astype(np.int32)
    return index._replace(residual=small)


def boundaries(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(boundary offsets in code points of all texts, each beginning with 0;
    where each text's boundaries begin, with one entry more)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[offsets[0]:offsets[-1]] if whole is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    letter = ((data | 0x20) >= 97) & ((data | 0x20) <= 122)
    point = (data & 0xC0) != 0x80
    begins = point.copy()
    begins[1:] &= ~(letter[1:] & letter[:-1])
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] = True
    before = np.append(0, np.cumsum(point))  # code points before each byte
    start = np.flatnonzero(begins)
    first = np.searchsorted(start, offsets)
    counts = np.diff(first)
    # a unit's end is the next unit's start, or the end of its text
    text_of = np.repeat(np.arange(len(counts)), counts)
    ends = before[np.minimum(np.append(start[1:], len(data)), offsets[1:][text_of])] - before[offsets[:-1]][text_of]
    out = np.zeros(len(start) + len(counts), np.int64)
    out[np.arange(len(start)) + text_of + 1] = ends
    begin = np.append(0, np.cumsum(counts + 1))
    return out, begin


def _indexed(batch: pa.RecordBatch, error: int):
    """(row, index) of each text of a batch, by slices."""
    for part in slices(batch, "text"):
        ends, begin = boundaries(part.column("text"))
        for i in range(part.num_rows):
            yield part, i, fit(ends[begin[i]:begin[i + 1]], error)


def rank_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", error: int = ERROR) -> DataFrame:
    """doc_id, n (units), segments (rank, offset, slope) and residuals: little-endian
    signed integers of one byte each, or of four if ``error`` is above 127."""
    def build(batches):
        for batch in batches:
            rows = [(part.column("id")[i].as_py(), len(x.residual) - 1,
                     [{"rank": r, "offset": o, "slope": s} for r, o, s in
                      zip(x.rank.tolist(), x.offset.tolist(), x.slope.tolist(), strict=True)], x.residual.tobytes())
                    for part, i, x in _indexed(batch, error)]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(_INDEX_TYPES)],
                                  names=["doc_id", "n", "segments", "residuals"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, build, "doc_id long, n long, segments array<struct<rank: long, offset: long, "
                                  "slope: double>>, residuals binary")


_INDEX_TYPES = (pa.int64(), pa.int64(), pa.list_(pa.struct([("rank", pa.int64()), ("offset", pa.int64()),
                                                            ("slope", pa.float64())])), pa.binary())


def _transform(text: str, index: RankIndex, h1: int, h2: int, h3: int, h4: int):
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    n = len(index.residual) - 1
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= PLAIN_FROM:
        return n, "plain", None, None, text
    a, b = index.offsets(sorted((h1 % (n + 1), h2 % (n + 1)))).tolist()
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_BELOW:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1,
                   error: int = ERROR) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars, output
    for every row."""
    def build(batches):
        for batch in batches:
            rows, held = [], 0
            for part, i, index in _indexed(batch, error):
                row = {c: part.column(c)[i].as_py() for c in part.schema.names}
                rows.append((row["id"], *_transform(row["text"] or "", index, row["h1"], row["h2"], row["h3"],
                                                    row["h4"])))
                held += len(rows[-1][-1])
                if held > 16 << 20:
                    yield send(rows)
                    rows, held = [], 0
            yield send(rows)

    def send(rows):
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)],
                               names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *draws)
    return map_arrow(rows, build, "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
                                  "output string")


def restored(output: Column | str, form: Column | str) -> Column:
    """The text that an output of this form was made from."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def between(left: str, right: str | None) -> Column:
        after = F.substr(output, F.instr(output, left) + len(left))
        return after if right is None else F.substr(after, F.lit(1), F.instr(after, right) - 1)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
