"""Cross-tokenizer alignment by pointer jumping.

Tokens of two tokenizers that cover the same bytes overlap; the finest groups
that both agree on are the connected components of that overlap.  Every token
points to its farthest-right overlapping token (itself if none reaches
further), and doubling all pointers at once until nothing changes leaves each
token at its component's terminal token, which labels the group.

1. Whole texts, with a space in front, are cut into units: before each space
   that follows a visible character.  Neither tokenizer's tokens cross such a
   place, so a text's tokens are its units' tokens in turn.  A task encodes and
   aligns each distinct unit of a block once and keeps what it has seen (up to
   ``KEPT`` units, then it starts anew).
2. Blocks of about ``BLOCK`` bytes of whole documents become rows: what each
   document says of itself, its linked id pairs with their links, and for each
   pair how many of the block's documents hold it.
3. Pair counts are summed over all blocks, and the highest of each A id joined
   to them.
4. Each block's distinct pairs fetch their counts, gathered by block (as many
   as the block has pairs), which gives the sums of its documents.

A pair that stands in every document thus crosses the shuffle once a block, not
once a document, and nothing is broadcast.

Defined results: texts that are null, empty, or whose joined tokens differ from
space and text have no tokens (zeros, ''); repeated rows are documents of their
own; null identifiers are ordinary; an empty table gives no rows; further
columns are not read.  Memory: one block (or one longer text) with its distinct
units and pairs, and the kept units."""

from __future__ import annotations

import hashlib
import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tidewire.llm.common import Scratch, map_arrow, slices

KEPT = 200_000
BLOCK = 2 << 20
_JOINED = 1 << 16  # bytes of units encoded by one call
_VISIBLE = 0x21, 0x7E


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: the
    printable Latin-1 bytes for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Tokenizer A: a tokenizers file with a byte-level vocabulary.

    Where the file's merges stand in the order of their ids, ids are ranks and
    tiktoken encodes the same, much faster on rare words; else the file's own
    library does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary = file["model"]["vocab"]
        byte, added = byte_alphabet(), {t["id"] for t in file["added_tokens"]}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        ranks = {}
        for entry, i in vocabulary.items():
            if i not in added and all(c in byte for c in entry):
                self.bytes[i] = bytes(byte[c] for c in entry)
                ranks[self.bytes[i]] = i
        made = [vocabulary["".join(m if not isinstance(m, str) else m.split(" "))] for m in file["model"]["merges"]]
        splitting = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if made == sorted(made) and file["pre_tokenizer"] == splitting and not file["normalizer"]:
            import public_tokenizers
            import tiktoken

            coder = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [coder.encode_ordinary(t.decode()) for t in texts]
        else:
            self.encode = self._by_file(path)

    @staticmethod
    def _by_file(path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [e.ids for e in tokenizer.encode_batch([t.decode() for t in texts],
                                                                    add_special_tokens=False)]


class PieceBpe:
    """Tokenizer B: a sentencepiece model, which puts a space in front itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(map(self.model.id_to_piece, range(n)))]

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        return self.model.encode([t[1:].decode() for t in texts], num_threads=1)


def jump(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, group of each B token, each group's end) for two
    sequences of tokens, given by their byte ends, that cover the same bytes."""
    if not len(end_a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(end_a)
    far_b = np.searchsorted(np.append(0, end_b[:-1]), end_a, "left") - 1
    far_a = np.searchsorted(np.append(0, end_a[:-1]), end_b, "left") - 1
    # A tokens are numbered first; of tokens with one end, B's is the terminal
    to = np.concatenate([far_b + n, np.where(end_a[far_a] > end_b, far_a, np.arange(n, n + len(end_b)))])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            break
        to = further
    terminal, group = np.unique(to, return_inverse=True)
    return group[:n], group[n:], end_b[terminal - n]


def _runs(sizes: np.ndarray) -> np.ndarray:
    """0 .. size-1 for each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _firsts(sizes) -> np.ndarray:
    return np.append(0, np.cumsum(sizes)).astype(np.int64)


def _counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the exact sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(weights[order], head) if len(head) else np.zeros(0, np.int64)


def _linked(id_a, group_a, id_b, group_b, n_groups: int):
    """(group, A id, B id, links) of the distinct linked ids of each group."""
    def distinct(ids, group):
        key, times = np.unique(group * (1 << 32) + ids, return_counts=True)
        return key >> 32, key & 0xFFFFFFFF, times

    ga, a, ta = distinct(id_a, group_a)
    gb, b, tb = distinct(id_b, group_b)
    have_b = np.bincount(gb, minlength=n_groups)
    first_b = _firsts(have_b)
    size = have_b[ga]
    left = np.repeat(np.arange(len(ga)), size)
    right = first_b[ga[left]] + _runs(size)
    return ga[left], a[left], b[right], ta[left] * tb[right]


class Aligner:
    """What is known of the units seen so far: numbers of tokens, groups and
    links, the groups as text, and the linked id pairs with their links."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteBpe(path_a), PieceBpe(path_b)
        self.size_a = np.array([len(t) for t in self.a.bytes])
        self.size_b = np.array([len(t) for t in self.b.bytes])
        ids = max(len(self.size_a), len(self.size_b))
        #: decimal ids with what may follow: the same side, the other side, the next group, the next unit
        self.decimal = [f"{i}{mark}" for mark in ",|;\n" for i in range(ids)]
        self.ids = ids
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.counts = array("q")  # n_a, n_b, n_groups, n_links of each unit
        self.lost = array("b")
        self.text: list[str] = []
        self.first = array("q", [0])
        self.pair = array("q")
        self.links = array("q")

    def learn(self, units: list[bytes], ends_visible: np.ndarray) -> None:
        """Encode and align units that are not known yet, many to a call.  A
        unit that does not end in a visible character ends its call."""
        blocks, held = [], 0
        for unit, visible in zip(units, ends_visible, strict=True):
            if held == 0:
                blocks.append([])
            blocks[-1].append(unit)
            held = held + len(unit) if visible and held + len(unit) < _JOINED else 0
        for k in range(0, len(blocks), 8):
            self._learn(blocks[k:k + 8])

    def _learn(self, blocks: list[list[bytes]]) -> None:
        texts = [b"".join(block) for block in blocks]
        rows_a, rows_b = self.a.encode(texts), self.b.encode(texts)
        good, again = [], []
        for k, text in enumerate(texts):
            same = (b"".join(map(self.a.bytes.__getitem__, rows_a[k])) == text
                    == b"".join(map(self.b.bytes.__getitem__, rows_b[k])))
            if same:
                good.append(k)
            elif len(blocks[k]) > 1:
                again += [[unit] for unit in blocks[k]]
            else:  # this unit's bytes are not covered
                self._add(blocks[k][0], (0, 0, 0, 0), "", (), (), True)
        if good:
            self._align([u for k in good for u in blocks[k]], np.concatenate([rows_a[k] for k in good]).astype(np.int64),
                        np.concatenate([rows_b[k] for k in good]).astype(np.int64))
        for k in range(0, len(again), 4096):
            self._learn(again[k:k + 4096])

    def _add(self, unit, counts, text, pair, links, lost) -> None:
        self.number[unit] = len(self.lost)
        self.counts.extend(counts)
        self.lost.append(lost)
        self.text.append(text)
        self.pair.extend(pair)
        self.links.extend(links)
        self.first.append(len(self.pair))

    def _align(self, units: list[bytes], id_a: np.ndarray, id_b: np.ndarray) -> None:
        end_a, end_b = np.cumsum(self.size_a[id_a]), np.cumsum(self.size_b[id_b])
        group_a, group_b, group_end = jump(end_a, end_b)
        unit_end = np.cumsum([len(u) for u in units])
        unit_of = np.searchsorted(unit_end, group_end, "left")  # of each group
        n, g = len(units), len(group_end)
        in_a, in_b = np.bincount(group_a, minlength=g), np.bincount(group_b, minlength=g)
        n_links = np.zeros(n, np.int64)
        np.add.at(n_links, unit_of, in_a * in_b)
        counts = np.stack([np.bincount(unit_of[group_a], minlength=n), np.bincount(unit_of[group_b], minlength=n),
                           np.bincount(unit_of, minlength=n), n_links], axis=1)
        # groups as text: tokens by group, A before B, each with its mark
        side = np.concatenate([group_a * 2, group_b * 2 + 1])
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.concatenate([id_a, id_b])[order]
        mark = np.full(len(side), 3)
        mark[:-1] = np.where(side[1:] == side[:-1], 0, np.where(side[1:] >> 1 == side[:-1] >> 1, 1, np.where(
            unit_of[side[1:] >> 1] == unit_of[side[:-1] >> 1], 2, 3)))
        text = "".join(map(self.decimal.__getitem__, (mark * self.ids + ids).tolist())).split("\n")
        # distinct pairs of each unit
        group, a, b, links = _linked(id_a, group_a, id_b, group_b, g)
        code, where = np.unique(a << 32 | b, return_inverse=True)
        key, links = _counted(unit_of[group] * len(code) + where, links)
        first = np.searchsorted(key // len(code), np.arange(n + 1))
        begin, have = len(self.lost), len(self.pair)
        self.number.update(zip(units, range(begin, begin + n), strict=True))
        self.counts.frombytes(counts.astype(np.int64).tobytes())
        self.lost.extend([0] * n)
        self.text += text[:n]
        self.pair.frombytes(code[key % len(code)].tobytes())
        self.links.frombytes(links.astype(np.int64).tobytes())
        self.first.frombytes((have + first[1:]).astype(np.int64).tobytes())


_aligners: dict[tuple[str, str], Aligner] = {}


def cut_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(units of all texts, number of the first unit of each text with one
    entry more, whether each unit ends in a visible character); texts that
    are null or empty have none, the others begin with a space of their own."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    filled = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    spaced = pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), texts, pa.scalar(b"", pa.large_binary()))
    spaced = pc.if_else(pa.array(filled), spaced, pa.scalar(b"", pa.large_binary()))
    offsets = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset:spaced.offset + len(spaced) + 1]
    data = np.frombuffer(spaced.buffers()[2], np.uint8)[:offsets[-1]] if len(spaced) else np.zeros(0, np.uint8)
    one, two, three = (np.concatenate([np.zeros(k, np.uint8), data])[:len(data)] for k in (1, 2, 3))
    # white space beyond ASCII ends in these bytes; more than needed is harmless
    wide = ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three == 0xE1) & ((two == 0x9A) | (two == 0xA0))) \
        | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80))
    visible = (one >= _VISIBLE[0]) & (one != _VISIBLE[1] + 1) & ~wide
    begins = (data == 0x20) & visible
    begins[offsets[1:][filled] - 1] = False  # a last space has nothing after it
    begins[offsets[:-1][filled]] = True
    start = np.flatnonzero(begins)
    bounds = np.append(start, len(data)).astype(np.int64)
    last = np.append(visible, False)
    if len(data):
        tail = data[-3:].tobytes()
        last[-1] = 0x21 <= tail[-1] <= 0x7E
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start),
                                             [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    return units, np.searchsorted(start, offsets), last[bounds[1:]]


_BLOCKS = ("chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
           "n_links array<long>, groups_sha256 array<string>, doc_first binary, pair binary, links binary, "
           "a array<int>, b array<int>, held array<int>")
_RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
           "groups_sha256 string")
_OWN = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "doc_first", "pair", "links")


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in the fewest bytes each."""
    most = int(values.max(initial=0))
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if most <= np.iinfo(k).max)
    return values.astype(kind).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(data) // n] if n else np.uint8
    return np.frombuffer(data, kind).astype(np.int64)


def _block(part: pa.RecordBatch, aligner: Aligner) -> dict:
    """One block's documents, distinct units and distinct pairs."""
    units, first, visible = cut_units(part.column("text"))
    coded = units.dictionary_encode()
    code, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    if len(aligner.lost) + len(distinct) > KEPT:
        aligner.clear()
    ends = np.zeros(len(distinct), bool)
    ends[code] = visible
    fresh = [i for i, u in enumerate(distinct) if u not in aligner.number]
    aligner.learn([distinct[i] for i in fresh], ends[fresh])
    slot = np.fromiter(map(aligner.number.__getitem__, distinct), np.int64, len(distinct))

    n = part.num_rows
    size = np.diff(first)
    lost = np.frombuffer(aligner.lost, np.int8)[slot].astype(bool)
    text_of = np.repeat(np.arange(n), size)
    none = np.bincount(text_of, weights=lost[code], minlength=n) > 0  # texts that are not covered
    text = np.array([aligner.text[i] for i in slot.tolist()] + [""], object)[:-1]
    said = [hashlib.sha256(";".join(text[code[first[i]:first[i + 1]]]).encode()).hexdigest()
            if size[i] and not none[i] else "" for i in range(n)]
    counts = np.frombuffer(aligner.counts, np.int64).reshape(-1, 4)[slot]
    keep = ~none[text_of]
    code, text_of = code[keep], text_of[keep]
    width = max(len(distinct), 1)
    key, times = np.unique(text_of * width + code, return_counts=True)
    doc, unit = key // width, key % width
    sums = np.zeros((n, 4), np.int64)
    np.add.at(sums, doc, counts[unit] * times[:, None])

    # the distinct pairs of each document: those of its units, with their links
    known = np.frombuffer(aligner.first, np.int64)
    have = known[slot + 1] - known[slot]
    code_of, pair = np.unique(np.frombuffer(aligner.pair, np.int64)[np.repeat(known[slot], have) + _runs(have)],
                              return_inverse=True)
    wide, width = have[unit], max(len(code_of), 1)
    at = _runs(wide)
    of_doc = np.repeat(doc, wide) * width + pair[np.repeat(_firsts(have)[unit], wide) + at]
    links = np.frombuffer(aligner.links, np.int64)[np.repeat(known[slot][unit], wide) + at] * np.repeat(times, wide)
    key, links = _counted(of_doc, links)
    held = np.bincount(key % width, minlength=len(code_of))
    some = np.flatnonzero(held)  # pairs of uncovered texts alone count nowhere
    place = np.zeros(width, np.int64)
    place[some] = np.arange(len(some))
    del known
    return {"doc_id": part.column("id").to_pylist(), "n_a": sums[:, 0], "n_b": sums[:, 1], "n_groups": sums[:, 2],
            "n_links": sums[:, 3], "groups_sha256": said,
            "doc_first": np.searchsorted(key // width, np.arange(n + 1)).astype(np.int64).tobytes(),
            "pair": _packed(place[key % width]), "links": _packed(links), "a": (code_of[some] >> 32).astype(np.int32),
            "b": (code_of[some] & 0xFFFFFFFF).astype(np.int32), "held": held[some].astype(np.int32)}


def _blocks(path_a: str, path_b: str):
    types = {"doc_id": pa.list_(pa.int64()), "groups_sha256": pa.list_(pa.string()), "a": pa.list_(pa.int32()),
             "b": pa.list_(pa.int32()), "held": pa.list_(pa.int32())} | {k: pa.binary() for k in _OWN[6:]}

    def run(batches):
        if (path_a, path_b) not in _aligners:
            _aligners[path_a, path_b] = Aligner(path_a, path_b)
        aligner = _aligners[path_a, path_b]
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                row = _block(part, aligner)
                names = ["chunk", *row]
                yield pa.record_batch([pa.array([number], pa.int64()), *[
                    pa.array([row[k]], types.get(k, pa.list_(pa.int64()))) for k in row]], names=names)
                number += 1

    return run


def _sums(own: dict, n: np.ndarray, top: np.ndarray) -> pa.RecordBatch:
    """The results of one block from its row and the counts of its pairs."""
    first = np.frombuffer(own["doc_first"], np.int64)
    pair, links = (_unpacked(own[k], int(first[-1])) for k in ("pair", "links"))

    def per(counts):  # exact sums of runs
        total = _firsts(links * counts[pair]) if len(pair) else np.zeros(1, np.int64)
        return total[first[1:]] - total[first[:-1]]

    best, held = per(top), per(n)
    return pa.record_batch([pa.array(x, pa.int64()) for x in (
        own["doc_id"], own["n_a"], own["n_b"], own["n_groups"], own["n_links"], best, held)]
        + [pa.array(own["groups_sha256"], pa.string())],
        names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def _meet(batches):
    """A block's own row with the counts of its pairs, in their order."""
    for batch in batches:
        for i in range(batch.num_rows):
            own = {k: batch.column(k)[i].as_py() for k in _OWN}
            counts = batch.column("counts")[i].values  # null for a block without tokens
            n, top = (np.zeros(0, np.int64) if counts is None else
                      counts.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("n", "top"))
            yield _sums(own, n, top)


def linked_pairs(blocks: DataFrame) -> DataFrame:
    """a, b, n: how many documents hold the pair linked."""
    return (blocks.select(F.explode(F.arrays_zip("a", "b", "held")).alias("x")).select("x.*")
            .groupBy("a", "b").agg(F.sum("held").alias("n")))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
          scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for
    every row."""
    scratch = scratch or Scratch(docs.sparkSession, "alignment")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = scratch.table(map_arrow(rows, _blocks(path_a, path_b), _BLOCKS), "blocks")
    counted = scratch.table(linked_pairs(blocks), "counts")
    highest = counted.groupBy(F.col("a").alias("a_")).agg(F.max("n").alias("most"))
    known = counted.join(highest, F.col("a") == F.col("a_")).select(
        "a", "b", "n", (F.col("n") == F.col("most")).cast("int").alias("top"))
    wanted = (blocks.select("chunk", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "x"))
              .select("chunk", "pos", "x.a", "x.b"))
    back = (wanted.join(known, ["a", "b"]).groupBy("chunk")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "n", "top"))).alias("counts")))
    met = blocks.select("chunk", *_OWN).join(back, "chunk", "left")
    return map_arrow(met, _meet, _RESULT)
