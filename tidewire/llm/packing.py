"""Best-fit packing of documents into token sequences.

Documents become pieces of at most ``capacity`` tokens (only longer ones are
cut).  Pieces are dealt evenly to groups of about ``group_pieces`` and packed
group by group, largest first.  A sequence has three capacities: tokens,
documents and attention cost (sum of squared piece lengths).  Of the sequences
that a piece fits under every constraint, the one is taken whose residual
vector after placement has the least weighted norm (``select="norm"``) or
whose residual has the least weighted dot product with the piece's demand
(``select="dot"``); a new sequence opens if none fits.  Only lengths take part
in packing, never texts or ids, and a group's size is bounded by dealing, so
groups pack in parallel; each leaves a sequence or two that is not full.

Defined results: null text is empty and has one piece, the end id alone;
repeated rows are pieces of their own; null identifiers pass through; an empty
table gives no rows; further columns are not read."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import Scratch, map_arrow, slices
from tidewire.llm.tokens import encoder

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cutter(path: str, capacity: int, last: int, with_ids: bool):
    def cut(batches):
        encode = encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, begin = encode(part.column("text"), last)
                rows = [[] for _ in range(6)]
                for doc_id, lo, hi in zip(part.column("doc_id").to_pylist(), begin[:-1], begin[1:], strict=True):
                    for k, at in enumerate(range(int(lo), int(hi), capacity)):
                        own = ids[at:min(at + capacity, int(hi))]
                        for x, v in zip(rows, (doc_id, k, at - int(lo), len(own), zlib.crc32(own.astype("<u4").tobytes()),
                                               own.astype(np.int32) if with_ids else None), strict=True):
                            x.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                yield pa.record_batch([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)],
                                      names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return cut


def pack_group(length: np.ndarray, limits: tuple[float, float, float], weights: tuple[float, float, float],
               select: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset) of each piece of one group."""
    length = np.asarray(length, np.int64)
    cap, w = np.asarray(limits, float), np.asarray(weights, float)
    demand = np.stack([length, np.ones(len(length)), length.astype(float) ** 2], 1)
    if (demand > cap).any():
        raise ValueError("a piece exceeds a capacity of an empty sequence")
    left = np.empty((max(1, len(length)), 3))
    opened = 0
    sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    number = np.empty(len(length) + 1, np.int64)
    active = 0
    for i in np.argsort(-length, kind="stable"):
        d = demand[i]
        bins = left[:active]
        fits = np.flatnonzero((bins >= d).all(1))
        if len(fits):
            rest = bins[fits]
            score = ((((rest - d) / cap) ** 2) @ w if select == "norm" else ((rest / cap) * (d / cap)) @ w)
            j = fits[score.argmin()]
        else:
            j = active
            left[j], number[j] = cap, opened
            opened, active = opened + 1, active + 1
        sequence[i], offset[i] = number[j], int(cap[0] - left[j][0])
        left[j] -= d
        if left[j].min() <= 0:  # nothing fits any more: the last open one takes its place
            active -= 1
            left[j], number[j] = left[active], number[active]
    return sequence, offset


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096,
         most_documents: int = 4096, most_cost: float = 4096.0**2, last: int = 1,
         weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6), select: str = "norm", group_pieces: int = 8192,
         with_ids: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset, and ``ids`` if asked for.  ``tokenizer``: path of a tokenizer file,
    the same on all executors."""
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = map_arrow(rows, _cutter(tokenizer, capacity, last, with_ids), _PIECES + ", ids array<int>")
    pieces = scratch.table(pieces if with_ids else pieces.drop("ids"), "pieces")
    # the pieces' numbers follow the written files, so a repeated task gives the same
    pieces = pieces.withColumn("number", F.monotonically_increasing_id())
    groups = max(1, -(-pieces.count() // group_pieces))
    limits = (float(capacity), float(most_documents), float(most_cost))

    def place(key, frame):
        frame = frame.sort_values(["length", "number"], ascending=[False, True], ignore_index=True)
        sequence, offset = pack_group(frame["length"].to_numpy(), limits, weights, select)
        return pd.DataFrame({"number": frame["number"], "sequence_id": (int(key[0]) << 32) + sequence,
                             "offset": offset, **({} if with_ids else {c: frame[c] for c in (
                                 "doc_id", "piece", "start", "length", "ids_crc32")})})

    narrow = pieces.select("number", "length") if with_ids else pieces
    dealt = narrow.withColumn("group", F.pmod(F.xxhash64("number"), F.lit(groups)))
    out = dealt.groupBy("group").applyInPandas(
        place, "number long, sequence_id long, offset long" + ("" if with_ids else ", " + _PIECES))
    if with_ids:
        out = pieces.join(out, "number")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
                      *(["ids"] if with_ids else []))
