"""SentencePiece encoding and decoding over a relational lattice.

White space becomes the mark U+2581, as the model's rule has it, and texts are
cut before each run of marks (no piece has a mark after another character, so
no segmentation crosses there); for BPE models they are also cut between any two
characters that no piece has side by side, as no merge crosses there.  Distinct
words become a lattice: substrings of up to the longest piece's length are
exploded and equi-joined to the piece table, the edges of a word are grouped,
and a higher-order ``aggregate`` folds them.  For unigram models the fold is Viterbi's (best sum of scores, earlier
start on ties), for words of any length: their substrings are exploded block by
block, and the edges are grouped by the boundary at which they end.  For BPE
models the best sum is not the model's segmentation;
there the fold over the same lattice merges the best-scored adjacent pair, the
leftmost on ties, until no edge covers a pair: one pass over the edges in the
order of their scores where that gives the same (``fold_ranked``), the repeated
search (``fold_merges``) where a merge made a better one possible.  Characters
without a piece become their UTF-8 bytes' pieces.

Texts are coded against a dictionary of their chunk's words (about 32 MB of
texts).  A chunk travels once, as one compressed block; its words are grouped
over all chunks, so a distinct word is folded once, and their ids come back in
compressed packs, one for each task and chunk.  For BPE models, words of more
than ``LONGEST`` characters are merged by a heap in the task that reads them and
do not reach the lattice: the fold's work grows with the square of a word's
length.

Defined results: null text is empty and has no ids; repeated rows and null
identifiers pass through; an empty table gives no rows; further columns are
not read.  Decoding is exact for texts without U+2581."""

from __future__ import annotations

import hashlib
import heapq
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import map_arrow, slices

MARK = "▁"
#: Characters of a word of which the boundaries fit 63 bits; the sign is a flag.
LONGEST = 62
#: Starts of substrings that one row of a unigram model's word is exploded to.
BLOCK = 256
SIGN = -(1 << 63)
#: Bytes of texts in a chunk, and characters of texts for each task that folds words.
CHUNK = 32 << 20
FOLDED = 8 << 20


@lru_cache(maxsize=4)
def piece_rows(model: str) -> tuple[list[tuple[str, int, float]], list[bytes]]:
    """(piece, id, score) of ordinary pieces; for each id the bytes it decodes to."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rows, out = [], []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            out.append(b"")
        else:
            rows.append((piece, i, float(sp.get_score(i))))
            out.append(piece.replace(MARK, " ").encode())
    return rows, out


def byte_ids(model: str) -> list[int]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


def merge_word(word: str, pieces: dict[str, tuple[int, float]], of_byte: list[int]) -> list[int]:
    """BPE ids of one word by a heap of adjacent pairs."""
    n = len(word)
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))
    alive, heap = [True] * n, []

    def offer(i):
        if i >= 0 and end[i] < n:
            both = pieces.get(word[i:end[end[i]]])
            if both is not None:
                heapq.heappush(heap, (-both[1], i, end[i], end[end[i]]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or not alive[mid] or end[mid] != stop:
            continue
        alive[mid], end[i] = False, stop
        if stop < n:
            left[stop] = i
        offer(left[i])
        offer(i)
    ids, i = [], 0
    while i < n:
        own = pieces.get(word[i:end[i]])
        ids += [own[0]] if own else [of_byte[b] for b in word[i:end[i]].encode()]
        i = end[i]
    return ids


def neighbours(pieces) -> tuple[np.ndarray, np.ndarray]:
    """For each code point its number among those that stand in a piece of
    several characters (0: none), and which two numbers stand side by side."""
    pairs = {piece[i:i + 2] for piece in pieces for i in range(len(piece) - 1)}
    number = {c: i for i, c in enumerate(sorted({c for pair in pairs for c in pair}), 1)}
    of_char = np.zeros(0x110000, np.uint16)
    for c, i in number.items():
        of_char[ord(c)] = i
    beside = np.zeros((len(number) + 1, len(number) + 1), bool)
    for a, b in pairs:
        beside[number[a], number[b]] = True
    return of_char, beside


def words_of(texts: list[str], of_char: np.ndarray | None, beside: np.ndarray | None) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, one after the other, and how many each text has; with
    ``neighbours`` also cut where no piece of the model crosses."""
    marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
    whole = "".join(marked)
    points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    cut = np.ones(len(points) + 1, bool)
    if beside is None:
        mark = points == ord(MARK)
        cut[1:-1] = mark[1:] & ~mark[:-1]
    elif whole:
        kinds = of_char[points]
        cut[1:-1] = ~beside[kinds[:-1], kinds[1:]]
    ends = np.cumsum([0, *map(len, marked)])
    cut[ends] = True
    at = np.flatnonzero(cut)
    byte = np.zeros(len(points) + 1, np.int32)
    np.cumsum(1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000), out=byte[1:])
    words = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(byte[at]), pa.py_buffer(whole.encode()))
    return words, np.diff(np.searchsorted(at, ends))


def pack(*numbers: np.ndarray) -> bytes:
    """Arrays of unsigned 32-bit numbers as compressed bytes."""
    flat = np.concatenate([np.asarray(x, "<u4") for x in numbers])
    sizes = np.array([len(numbers), *map(len, numbers)], "<u4")
    return sizes.tobytes() + pa.compress(_planes(flat), codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    sizes = np.frombuffer(data, "<u4", n, 4)
    whole = pa.decompress(data[4 + 4 * n:], 4 * int(sizes.sum()), codec="zstd", asbytes=True)
    return np.split(_numbers(whole), np.cumsum(sizes)[:-1])


def _planes(numbers: np.ndarray) -> bytes:
    # bytes of one significance side by side compress better
    return np.ascontiguousarray(numbers, "<u4").view("u1").reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, "u1").reshape(4, -1).T).reshape(-1).view("<u4")


def _coder(shared, kind):
    def block(part, pieces, of_byte, cuts):
        words, sizes = zip(*[words_of(some.column("text").to_pylist(), *cuts) for some in slices(part, "text")], strict=True)
        coded = pa.chunked_array(words).dictionary_encode().unify_dictionaries()
        known = coded.chunk(0).dictionary
        long = np.flatnonzero(pc.utf8_length(known).to_numpy() > LONGEST).tolist() if kind == "bpe" else []
        merged = {i: merge_word(known[i].as_py(), pieces, of_byte) for i in long}
        asked = known.filter(pa.array(~np.isin(np.arange(len(known)), long)))
        codes = np.concatenate([x.indices.to_numpy() for x in coded.chunks])
        return pa.record_batch({
            "doc_ids": pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
            "codes": pa.array([pack(np.concatenate(sizes), codes)], pa.large_binary()),
            "words": pa.array([b"".join([x.as_buffer() for x in asked.cast(pa.binary())])], pa.large_binary()),
            "lengths": pa.array([pack(pc.binary_length(asked).to_numpy(), long)], pa.binary()),
            "merged": pa.array([pack(*_listed(merged))], pa.binary())})

    def code(batches):
        pieces, of_byte = shared.value
        cuts = neighbours(pieces) if kind == "bpe" else (None, None)
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                whole, sink = block(part, pieces, of_byte, cuts), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(whole)
                yield pa.record_batch({"block": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return code


def _listed(ids: dict[int, list[int]]) -> tuple[list[int], list[int], list[int]]:
    return list(ids), [len(x) for x in ids.values()], [i for x in ids.values() for i in x]


def _blocks(batch):
    for i, data in enumerate(batch.column("block").to_pylist()):
        yield i, pa.ipc.open_stream(data).read_next_batch()


def _asked(batches):
    """chunk, at, word: the words of each block that go through the lattice."""
    for batch in batches:
        for i, block in _blocks(batch):
            sizes, long = unpack(block.column("lengths")[0].as_py())
            offsets = np.cumsum([0, *sizes.tolist()]).astype(np.int32)
            words = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), block.column("words")[0].as_buffer())
            at = np.delete(np.arange(len(sizes) + len(long), dtype=np.int32), long)
            asked = pa.record_batch({"chunk": pa.array(np.full(len(at), batch.column("chunk")[i].as_py(), np.int64)),
                                     "at": pa.array(at), "word": words})
            for first in range(0, asked.num_rows, 10000):
                yield asked.slice(first, 10000)


def _packer(batches):
    """The ids of a chunk's words, of rows in the order of their chunks, as one pack."""
    for batch in batches:
        chunks = batch.column("chunk").to_numpy()
        edges = [0, *(np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist(), len(chunks)]
        packs = []
        for a, b in zip(edges, edges[1:], strict=False):
            ids = batch.column("ids").slice(a, b - a)
            packs.append(pack(batch.column("at").slice(a, b - a).to_numpy(), ids.value_lengths().to_numpy(),
                              ids.flatten().to_numpy()))
        if len(chunks):
            yield pa.record_batch({"chunk": pa.array(chunks[edges[:-1]]), "pack": pa.array(packs, pa.binary())})


def _joiner(batches):
    """doc_id and ids of a block's texts."""
    for batch in batches:
        for i, block in _blocks(batch):
            n = sum(map(len, unpack(block.column("lengths")[0].as_py())))
            start, length, flat, used = np.zeros(n, np.int64), np.full(n, -1, np.int64), [], 0
            for data in [*(batch.column("packs")[i].as_py() or []), block.column("merged")[0].as_py()]:
                at, sizes, ids = unpack(data)
                start[at], length[at] = used + np.cumsum(sizes, dtype=np.int64) - sizes, sizes
                flat.append(ids.astype(np.int32))
                used += len(ids)
            if (length < 0).any():
                raise RuntimeError("a word without ids")
            flat = np.concatenate(flat)
            sizes, codes = unpack(block.column("codes")[0].as_py())
            texts = np.split(codes, np.cumsum(sizes)[:-1])
            doc_ids = block.column("doc_ids").flatten()
            for first in range(0, len(texts), 512):
                some = []
                for codes in texts[first:first + 512]:
                    long = length[codes]
                    ends = np.cumsum(long)
                    # each word's ids lie together; its first stands where the words before it end
                    some.append(flat[np.repeat(start[codes] - ends + long, long) + np.arange(ends[-1] if len(ends) else 0)])
                offsets = np.cumsum([0, *map(len, some)]).astype(np.int32)
                yield pa.record_batch({"doc_id": doc_ids.slice(first, len(some)),
                                       "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(some)))})


def late_parts(rows: list[tuple[str, int, float]]) -> set[str]:
    """Pieces that are part of a piece of no lower score: after making one of
    them a merge of an earlier rank may follow."""
    score = {piece: value for piece, _, value in rows}
    return {part for piece, value in score.items() for i in range(1, len(piece))
            if piece[:i] in score and piece[i:] in score
            for part in (piece[:i], piece[i:]) if len(part) > 1 and score[part] <= value}


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """word, its edges, best score first, then leftmost, and the further columns
    of ``words``, which are distinct and not empty; ``pieces`` is of the model's
    size and broadcast: piece and edge, its part of an edge's number.

    An edge has its number: the rank of its score, its start, its stop, the
    piece's id and whether it is a late part.  Bit i of a 64-bit mask stands for
    the boundary before character i: ``ends`` has the edge's two ends,
    ``between`` the boundaries it removes."""
    n, more = F.char_length("word"), [c for c in words.columns if c != "word"]
    spans = words.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("start")).select(
        "*", F.explode(F.sequence(F.when(F.col("start") == 0, 0).otherwise(1),
                                  F.least(F.lit(longest), n - F.col("start")))).alias("size"))
    # the empty span at 0 keeps words without any piece and has the further columns
    spans = spans.select("word", "start", "size", *[F.when(F.col("size") == 0, F.col(c)).alias(c) for c in more])
    edges = spans.join(F.broadcast(pieces), F.expr("substring(word, start + 1, size)") == F.col("piece"))
    stop = F.col("start") + F.col("size")
    edge = F.struct((F.col("edge") + _shifted(F.col("start"), _START) + _shifted(stop, _STOP)).alias("number"),
                    (_bit(F.col("start")) + _bit(stop)).alias("ends"),
                    F.when(F.col("size") > 1, _bit(stop) - _bit(F.col("start") + 1)).otherwise(F.lit(0).cast("long"))
                    .alias("between"))
    return edges.groupBy("word").agg(F.sort_array(F.collect_list(F.when(F.col("size") > 0, edge))).alias("edges"),
                                     *[F.first(c, ignorenulls=True).alias(c) for c in more])


#: Where an edge's number has the rank of its score (19 bits), its start and its
#: stop (6 bits each); below are its id (31 bits) and whether it is a late part.
_RANK, _START, _STOP = 44, 38, 32


def numbered(rows: list[tuple[str, int, float]], late: set[str]) -> list[tuple[str, int]]:
    """piece and its part of an edge's number, and the empty piece."""
    rank = {score: i for i, score in enumerate(sorted({r[2] for r in rows}, reverse=True))}
    if len(rank) >> 19:
        raise ValueError("more different scores than an edge's number holds")
    return [("", 0), *[(p, rank[score] << _RANK | i << 1 | (p in late)) for p, i, score in rows]]


def _field(edge: Column, place: int, bits: int) -> Column:
    return F.shiftright(edge["number"], place).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")


def _start(edge: Column) -> Column:
    return _field(edge, _START, 6)


def _stop(edge: Column) -> Column:
    return _field(edge, _STOP, 6)


def _id(edge: Column) -> Column:
    return _field(edge, 1, 31)


def _shifted(x: Column, by: int) -> Column:
    return F.call_function("shiftleft", x.cast("long"), F.lit(by))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def edge_map(edges: Column) -> Column:
    """The edges by start * 1000 + stop."""
    return F.map_from_entries(F.transform(edges, lambda e: F.struct(
        _start(e) * 1000 + _stop(e), F.struct((-_field(e, _RANK, 19)).alias("score"), _id(e).alias("id")))))


def fold_ranked(word: Column, edges: Column) -> Column:
    """The mask of boundaries after one pass over the edges in the order of
    their scores: an edge merges if its ends are boundaries with exactly one
    between them.  The sign bit is set if a merge (of a late part) made one of
    an edge already passed possible; without it the pass equals the repeated
    search."""
    none = F.lit(0).cast("long")

    def merges(mask, e):
        inner = mask.bitwiseAND(e["between"])
        return ((mask.bitwiseAND(e["ends"]) == e["ends"]) & (inner != none)
                & (inner.bitwiseAND(inner - 1) == none))

    def step(mask, e):
        after = mask.bitwiseAND(F.bitwise_not(e["between"]))
        # what such a merge makes possible has the merged edge as a part
        missed = (_field(e, 0, 1) != 0) & F.exists(edges, lambda p: (p["number"] < e["number"]) & (_start(p) <= _start(e))
                                                   & (_stop(p) >= _stop(e)) & merges(after, p))
        return F.when(merges(mask, e), F.when(missed, after.bitwiseOR(F.lit(SIGN))).otherwise(after)).otherwise(mask)

    whole = _bit(F.char_length(word) + 1) - 1
    return F.aggregate(F.filter(edges, lambda e: e["between"] != none), whole, step)


def fold_merges(word: Column, edges: Column) -> Column:
    """Boundaries after merging the best adjacent pairs."""
    n = F.char_length(word)

    def step(cuts, _):
        def best(at):
            return F.filter(cuts, lambda _, j: (at["score"].isNull()) | (j != -at["at"] + 1))

        pairs = F.transform(F.slice(cuts, 1, F.greatest(F.size(cuts) - 2, F.lit(0))), lambda a, i: F.struct(
            F.try_element_at(edges, a * 1000 + F.get(cuts, i + 2))["score"].alias("score"), (-i).alias("at")))
        top = F.array_max(F.filter(pairs, lambda p: p["score"].isNotNull()))
        return F.coalesce(F.get(F.transform(F.filter(F.array(top), lambda t: t.isNotNull()), best), F.lit(0)), cuts)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.sequence(F.lit(0), n), step)


def fold_viterbi(stops: Column, longest: int) -> Column:
    """The ids on the path of the best sum of scores.  ``stops``: for each
    boundary from 1 on, in order, the edges (score, start, ids) ending there."""
    start = F.struct(F.array(F.lit(0.0)).alias("scores"), F.array().cast("array<int>").alias("starts"))

    def step(best, at):
        # scores are kept for the last ``longest`` boundaries
        ways = F.transform(at["edges"], lambda e: F.struct(
            (F.get(best["scores"], F.size(best["scores"]) - (at["stop"] - e["start"])) + e["score"]).alias("score"),
            (-e["start"]).alias("a")))
        near = F.slice(best["scores"], F.greatest(F.size(best["scores"]) - longest + 2, F.lit(1)), longest)
        return F.get(F.transform(F.array(F.array_max(ways)), lambda w: F.struct(
            F.array_append(near, w["score"]).alias("scores"),
            F.array_append(best["starts"], -w["a"]).alias("starts"))), F.lit(0))

    def back(path, e):
        own = F.get(F.filter(e["stops"]["edges"], lambda x: x["start"] == e["starts"]), F.lit(0))["ids"]
        return F.when(e["stops"]["stop"] == path["at"], F.struct(
            e["starts"].alias("at"), F.array_append(path["ids"], own).alias("ids"))).otherwise(path)

    end = F.struct(F.size(stops).alias("at"), F.array().cast("array<array<int>>").alias("ids"))
    path = F.arrays_zip(stops.alias("stops"), F.aggregate(stops, start, step)["starts"].alias("starts"))
    return F.flatten(F.reverse(F.aggregate(F.reverse(path), end, back)["ids"]))


def unigram_words(words: DataFrame, pieces: DataFrame, longest: int, unknown: float, of_byte: list[int]) -> DataFrame:
    """word, ids and further columns for distinct words of any length.  A character
    without a piece has an edge of the score ``unknown`` and its bytes' ids."""
    n, key = F.char_length("word"), F.sha2(F.col("word").cast("binary"), 256)
    # rows hold a block of the word, not the word: it may be a whole text
    blocks = words.select(key.alias("key"), n.alias("n"), "word", F.explode(
        F.sequence(F.lit(0), n - 1, F.lit(BLOCK))).alias("begin")).select(
        "key", "n", "begin", F.expr(f"substring(word, begin + 1, {BLOCK + longest - 1})").alias("block"))
    spans = blocks.select("key", "n", "begin", "block", F.explode(F.sequence(
        F.lit(0), F.least(F.lit(BLOCK), F.col("n") - F.col("begin")) - 1)).alias("at")).select(
        "key", (F.col("begin") + F.col("at")).alias("start"), "block", "at", F.explode(F.sequence(
            F.lit(1), F.least(F.lit(longest), F.col("n") - F.col("begin") - F.col("at")))).alias("size"))
    spans = spans.select("key", "start", "size", F.expr("substring(block, at + 1, size)").alias("span"))
    code = F.hex(F.col("span").cast("binary"))
    spelled = F.transform(F.sequence(F.lit(1), F.length(code) - 1, F.lit(2)), lambda k: F.get(
        F.array(*[F.lit(i) for i in of_byte]), F.conv(F.substring(code, k, F.lit(2)), 16, 10).cast("int")))
    edges = spans.join(F.broadcast(pieces.select("piece", F.col("id").alias("id_"), "score")),
                       F.col("span") == F.col("piece"), "left").where(F.col("id_").isNotNull() | (F.col("size") == 1))
    edge = F.struct(F.coalesce("score", F.lit(unknown)).alias("score"), "start",
                    F.when(F.col("id_").isNotNull(), F.array("id_")).otherwise(spelled).alias("ids"))
    ends = edges.groupBy("key", (F.col("start") + F.col("size")).alias("stop")).agg(F.collect_list(edge).alias("edges"))
    graph = ends.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("stop", "edges"))).alias("stops"))
    coded = graph.select("key", fold_viterbi(F.col("stops"), longest).alias("ids"))
    return words.select("*", key.alias("key")).join(coded, "key").drop("key")


def word_ids(word: Column, edges: Column, cuts: Column, of_byte: list[int]) -> Column:
    """The ids between boundaries; bytes where there is no piece."""
    table = F.array(*[F.lit(i) for i in of_byte])

    def at(a, i):
        end = F.get(cuts, i + 1)
        own = F.try_element_at(edges, a * 1000 + end)["id"]
        code = F.hex(F.substring(word, a + 1, end - a).cast("binary"))
        spelled = F.transform(F.sequence(F.lit(1), F.length(code) - 1, F.lit(2)), lambda k: F.get(
            table, F.conv(F.substring(code, k, F.lit(2)), 16, 10).cast("int")))
        return F.when(own.isNotNull(), F.array(own)).otherwise(spelled)

    return F.flatten(F.transform(F.slice(cuts, 1, F.size(cuts) - 1), at))


def encode_words(words: DataFrame, spark: SparkSession, model: str, kind: str = "bpe") -> DataFrame:
    """word, ids and the further columns of ``words`` for distinct words, for BPE
    models of at most ``LONGEST`` characters."""
    rows, _ = piece_rows(model)
    longest = max(len(r[0]) for r in rows)
    if kind != "bpe":
        pieces = spark.createDataFrame(rows, "piece string, id int, score double")
        return unigram_words(words, pieces, longest, min(r[2] for r in rows) - 10.0, byte_ids(model))
    more = [c for c in words.columns if c != "word"]
    graph = lattice(words, spark.createDataFrame(numbered(rows, late_parts(rows)), "piece string, edge long"), longest)
    word, edges, mask = F.col("word"), F.col("edges"), F.col("mask")
    by_span = edge_map(edges)
    # a one-element explode binds a value that is used more than once
    folded = graph.select("word", "edges", F.explode(F.array(fold_ranked(word, edges))).alias("mask"), *more)
    chosen = F.filter(edges, lambda e: (mask.bitwiseAND(e["ends"]) == e["ends"])
                      & (mask.bitwiseAND(e["between"]) == F.lit(0).cast("long")))
    plain = F.transform(F.sort_array(F.transform(chosen, lambda e: F.struct(_start(e).alias("start"), _id(e).alias("id")))), lambda e: e["id"])
    folded = folded.select("word", "edges", "mask", F.explode(F.array(plain)).alias("ids"), *more)
    # words with characters that have no piece, or with a late part
    again = F.transform(F.array(by_span), lambda m: F.transform(
        F.array(F.when(mask < 0, fold_merges(word, m)).otherwise(
            F.filter(F.sequence(F.lit(0), F.char_length(word)), lambda i: F.getbit(mask, i) == 1))),
        lambda c: word_ids(word, m, c, byte_ids(model))))
    return folded.select("word", F.when((mask >= 0) & (F.size("ids") == F.bit_count(mask) - 1), F.col("ids"))
                         .otherwise(F.flatten(F.flatten(again))).alias("ids"), *more)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", kind: str = "bpe") -> DataFrame:
    """doc_id and ids of every whole text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    pieces = {p: (i, s) for p, i, s in piece_rows(model)[0]}
    shared = spark.sparkContext.broadcast((pieces, byte_ids(model)))
    # a word makes many edges and a block is large, so the tasks follow the texts, not the bytes exchanged
    chars = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one exchange serves both readers; a chunk's number holds once it is written
    blocks = (map_arrow(rows, _coder(shared, kind), "block binary")
              .withColumn("chunk", F.monotonically_increasing_id())
              .repartition(max(least, chars // CHUNK), "chunk"))
    asked = map_arrow(blocks, _asked, "chunk long, at int, word string").repartition(max(least, chars // FOLDED), "word")
    words = asked.groupBy("word").agg(F.collect_list(F.struct("chunk", "at")).alias("places"))
    found = encode_words(words, spark, model, kind).select(F.explode("places").alias("x"), "ids").select(
        F.col("x.chunk").alias("chunk"), F.col("x.at").alias("at"), "ids").sortWithinPartitions("chunk", "at")
    packs = (map_arrow(found, _packer, "chunk long, pack binary")
             .repartition(max(least, chars // CHUNK), "chunk")
             .groupBy("chunk").agg(F.collect_list("pack").alias("packs")))
    return map_arrow(blocks.join(packs, "chunk", "left").select("block", "packs"), _joiner, "doc_id long, ids array<int>")


def decode_ids(ids: np.ndarray, out: np.ndarray) -> str:
    text = b"".join(out[ids].tolist()).decode("utf-8", "replace")
    return text.removeprefix(" ")


def _digester(shared):
    def run(batches):
        out = np.array(shared.value, object)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), part.column("ids"), strict=True):
                    ids = ids.values.to_numpy()
                    rows.append((doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()),
                                 hashlib.sha256(decode_ids(ids, out).encode()).hexdigest()))
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (
                    pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                    names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256"])

    return run


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian 32-bit ids), decoded_sha256."""
    shared = docs.sparkSession.sparkContext.broadcast(piece_rows(model)[1])
    return map_arrow(encode(docs, model), _digester(shared),
                     "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string")
