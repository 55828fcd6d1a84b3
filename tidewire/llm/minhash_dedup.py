"""Near-duplicate groups by SetSketch registers.

A document's set holds the hashes of its distinct word shingles (64 bits).
Register i keeps the truncated, exponentially spaced minimum
``floor(1 - log_b(x_i))`` of the elements' exponential values; registers merge
by maximum, and two registers agree with a probability near the Jaccard
similarity.  Steps:

1. equal sets are collapsed to their smallest identifier (copies, however
   many, never reach the pair search);
2. bands of registers are hashed to buckets;
3. in rounds, members of a bucket that are not yet known to be connected are
   compared with the bucket's leaders.  Small buckets compare all members at
   once.  In larger ones a leader meets every other component's members and
   then leaves the bucket, so a bucket is finished when one component is left
   in it or every pair across components has met: no link is given up, and a
   large group of near copies costs about one comparison per member.  From the
   second round on a pair also ends where it meets if the parity bitmaps of its
   sets differ in more bits than similar sets have elements of their own (exact);
4. a candidate must pass the exact length bound and the joint likelihood
   estimate of the similarity (five standard deviations below the threshold),
   then the full sets decide: ``100 * |A & B| >= percent * |A | B|``.

Bands of ``band_rows`` registers, ``bands`` of them: a pair at similarity 0.8
shares no band with probability (1 - 0.8**5)**32 = 3e-6, one at 0.85 with 2e-8.

Defined results: null, empty or blank texts have no shingles and stand alone;
texts with fewer words than a shingle have their whole word sequence as the
only element; repeated rows are copies (one component; ``kept`` marks every
row whose identifier is the component's smallest); rows with a null identifier
stand alone with a null component and are kept; further columns are not read.
Memory: work arrays of one slice of texts, one set per side of a pair."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import Scratch, map_arrow, slices
from tidewire.llm.words import U, Words, mix
from tidewire.operators.similarity import connected_components

BASE, RATE, LEVELS = 1.001, 20.0, (1 << 16) - 2
#: 64-bit words of a set's parity bitmap.
BITMAP = 16


def shingle_sets(texts: pa.Array, words_each: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z in lower case."""
    words = Words(texts, lower=True)
    h = words.hashes()
    at, shingles = words.windows(words_each, hashes=h)
    cut = np.searchsorted(at, words.first)
    out = []
    for i, n in enumerate(words.counts()):
        if n >= words_each:
            out.append(np.unique(shingles[cut[i]:cut[i + 1]]))
        elif n:
            own = h[words.first[i]:words.first[i + 1]]
            out.append(np.array([xxhash.xxh3_64_intdigest(own.tobytes(), seed=int(n))], U))
        else:
            out.append(np.zeros(0, U))
    return out


def registers(shingles: np.ndarray, count: int) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes."""
    seeds = mix(np.arange(1, 2 * count + 1, dtype=U) * U(0x9E3779B97F4A7C15)) >> U(32)
    flip, odd = seeds[:count].astype(np.uint32), seeds[count:].astype(np.uint32) | np.uint32(1)
    low = np.full(count, 0xFFFFFFFF, np.uint32)
    values = (shingles >> U(32)).astype(np.uint32)
    for i in range(0, len(values), 2048):
        v = (values[i:i + 2048, None] ^ flip) * odd
        np.minimum(low, (v ^ (v >> np.uint32(15))).min(axis=0), out=low)
    x = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, LEVELS + 1).astype(np.uint16)


def parity(shingles: np.ndarray) -> np.ndarray:
    """A bitmap in which each element flips the bit that its hash names."""
    flips = np.bincount((shingles & U(64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def may_reach(percent: int, a: str, b: str, n_a: str, n_b: str) -> Column:
    """Whether sets of these bitmaps and sizes may be similar: each bit that
    differs stands for at least one element that only one of them has."""
    apart = reduce(add, [F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))) for i in range(BITMAP)])
    total = F.col(n_a) + F.col(n_b)
    return (total - apart) * (100 + percent) >= total * (2 * percent)


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of register rows ``a`` and ``b`` with set sizes na, nb."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    j = top * np.linspace(0, 1, 101)[None, :]

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    pm, pl = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    score = (more * np.log(np.maximum(pm, tiny)) + less * np.log(np.maximum(pl, tiny))
             + same * np.log(np.maximum(1 - pm - pl, tiny)))
    return j[np.arange(len(j)), score.argmax(1)]


def _sketcher(words_each: int, bands: int, band_rows: int):
    def sketch(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), words_each)
                rows = [registers(s, bands * band_rows) if len(s) else None for s in sets]
                keys = [None if r is None else
                        [xxhash.xxh3_64_intdigest(x.tobytes(), seed=i) - (1 << 63)
                         for i, x in enumerate(r.reshape(bands, band_rows))] for r in rows]
                yield pa.record_batch([
                    part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if r is None else r.tobytes() for r in rows], pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array([parity(s) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "digest", "sketch", "bands", "bits"])

    return sketch


def _setter(words_each: int):
    def sets(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = shingle_sets(part.column("text"), words_each)
                yield pa.record_batch([part.column("doc_id"),
                                       pa.array([s.tobytes() for s in found], pa.binary())],
                                      names=["doc_id", "elements"])

    return sets


def _flat(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            sets = [np.frombuffer(v.as_buffer(), np.int64) for v in part.column("elements")]
            yield pa.record_batch([pa.array(np.repeat(part.column("doc_id").to_numpy(), [len(s) for s in sets])),
                                   pa.array(np.concatenate(sets))], names=["id", "element"])


def _estimator(percent: int, count: int):
    least = percent / 100 - 5 * math.sqrt(percent / 100 * (1 - percent / 100) / count)

    def estimate(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, count)
                    for c in ("sketch_a", "sketch_b"))
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            keep = np.concatenate([likely(a[i:i + 2048], b[i:i + 2048], na[i:i + 2048], nb[i:i + 2048])
                                   for i in range(0, len(a), 2048)]) >= least
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return estimate


def _decider(percent: int):
    def decide(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(
                pa.array(keep, pa.bool_()))

    return decide


def tied(comp: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) after further links (a, b): only the labels that they tie
    are searched for components, not all links anew."""
    ends = links
    for c in ("a", "b"):
        ends = ends.join(comp.toDF(c, f"of_{c}"), c, "left").withColumn(c, F.coalesce(f"of_{c}", c)).drop(f"of_{c}")
    found = connected_components(ends, stars=True)
    every = comp.unionByName(found.select("id", F.col("id").alias("component"))).distinct()
    return (every.join(found.toDF("component", "root"), "component", "left")
            .select("id", F.coalesce("root", "component").alias("component")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5,
                    percent: int = 80, bands: int = 32, band_rows: int = 5, small: int = 12,
                    scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    ``small``: a bucket of up to so many members compares all of them at once;
    in larger buckets so many leaders are taken a round, after a first round
    of one (256 times as many in each further round: the bitmaps end most of
    their pairs where they meet, a round more costs some 40 stages)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "near-dedup")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    count = bands * band_rows
    every = scratch.table(map_arrow(rows, _sketcher(words_each, bands, band_rows),
                                    "doc_id long, n_shingles long, digest binary, sketch binary, "
                                    "bands array<long>, bits array<long>"), "sketches")
    # one row for each distinct set
    lone = F.col("digest").isNull() | F.col("doc_id").isNull()
    reps = every.where(~lone).groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("rep"))
    member = every.where(~lone).join(reps, ["digest", "n_shingles"]).select("doc_id", "n_shingles", "rep", "digest")
    sketches = (every.where(~lone).select("doc_id", "n_shingles", "digest", "sketch", "bands", "bits")
                .join(reps.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"])
                .dropDuplicates(["digest", "doc_id"]))
    sketches = scratch.table(sketches.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"),
                                             "sketch", "bands", "bits"), "distinct")
    # buckets of two members or more
    keys = sketches.select("id", "n", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = scratch.table(keys.join(shared, "key"), "buckets-0")
    involved = buckets.select(F.col("id").alias("doc_id")).distinct()
    sets = scratch.table(map_arrow(rows.join(involved, "doc_id", "left_semi").dropDuplicates(["doc_id"]),
                                   _setter(words_each), "doc_id long, elements binary"), "sets") \
        if not buckets.isEmpty() else None

    # a member whose buckets are large resembles many: it leads
    weight = buckets.groupBy("id").agg(F.sum("size").alias("weight"))
    buckets = buckets.select("key", "id", "n", F.col("n").alias("s"))
    if sets is not None:
        weight = scratch.table(weight, "weights")
    comp, turn, done = None, 0, False
    alike = ((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
             & (F.least("s_a", "s_b") * 100 >= (F.col("n_a") + F.col("n_b") - F.least("s_a", "s_b")) * percent))
    while sets is not None:
        if not turn:
            now = buckets.withColumn("comp", F.col("id"))
        else:
            if grown:
                comp = scratch.table(connected_components(new) if turn == 1 else tied(comp, new), f"components-{turn}")
            if done:
                break
            # read more than once below: written, so that the join runs once
            now = scratch.table(buckets.join(comp, "id", "left").select(
                "key", "id", "n", "s", F.coalesce("component", "id").alias("comp")), f"labelled-{turn}")
        if turn == 1:
            # what is left are large buckets of several components.  A set meets no
            # other in its elements that none of them shares: s counts the others
            mixed = now.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y")
            now = scratch.table(now.join(mixed.select("key"), "key"), "mixed")
            elements = map_arrow(sets.join(now.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"),
                                 _flat, "id long, element long")
            own = (elements.groupBy("element").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id"))
                   .where("c = 1").groupBy("id").agg(F.count(F.lit(1)).alias("u")))
            now = scratch.table(now.drop("s").join(own, "id", "left")
                                .select("key", "id", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("s"), "comp")
                                .where(F.col("s") * 100 >= F.col("n") * percent), "shared")
        # members of each bucket by component; the largest component leads last
        per = now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
        top = per.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"),
                                     F.sum("m").alias("size")).where("comps > 1")
        open_ = scratch.table(now.join(top, "key").select(
            "key", "id", "n", "s", "comp", "size", ((F.col("comp") == F.col("top.comp")) & F.lit(turn > 0)).alias("main")),
            f"open-{turn}")
        largest = open_.agg(F.max("size")).first()[0]
        if largest is None:
            break
        leaders = small * 256 ** (turn - 1) if turn else 1
        # all members of all buckets lead: every pair across components meets now
        done = largest <= max(small, leaders)
        # the first members of each bucket lead: found without sorting a bucket whole
        limit = F.when(F.col("size") <= small, F.col("size")).otherwise(F.lit(leaders))
        at = Window.partitionBy("key").orderBy("main", F.desc("weight"), "id")
        heads = (open_.join(weight, "id").withColumn("place", F.row_number().over(at))
                 .where(F.col("place") <= max(small, leaders)).where((F.col("place") <= limit) & ~F.col("main")))
        heads = scratch.table(heads.select("key", F.col("id").alias("head"), F.col("n").alias("n_a"),
                                           F.col("s").alias("s_a"), F.col("comp").alias("comp_a")), f"heads-{turn}")
        members, once = open_.select("key", "id", "comp", F.col("n").alias("n_b"), F.col("s").alias("s_b")), F.lit(True)
        leading = heads
        if turn:
            # a pair may share several buckets: it meets in the least one that the
            # head leads, and only under the smaller identifier if both lead one.  A
            # member that is not there any more led it before, and has met the head then
            leads = heads.groupBy("head").agg(F.collect_set("key").alias("leads"))
            about = scratch.table(sketches.select("id", "bands", "bits").join(open_.select("id").distinct(), "id", "left_semi")
                                  .join(leads.toDF("id", "leads"), "id", "left"), f"leads-{turn}")  # a row a member
            members = members.join(about.withColumnRenamed("leads", "own_leads"), "id")
            leading = heads.join(about.where(F.col("leads").isNotNull()).toDF("head", "head_bands", "head_bits", "leads"), "head")
            both = F.coalesce(F.arrays_overlap("own_leads", "head_bands"), F.lit(False))
            once = ((F.col("key") == F.array_min(F.array_intersect("leads", "bands")))
                    & ~((F.col("head") > F.col("id")) & both) & may_reach(percent, "bits", "head_bits", "n_b", "n_a"))
        pairs = (members.join(leading, "key")
                 .where((F.col("comp") != F.col("comp_a")) & alike & once)
                 .select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))
                 .distinct())
        side = sketches.select("id", "n", "sketch")
        with_sketch = (pairs.join(side.select(F.col("id").alias("a"), F.col("n").alias("n_a"),
                                              F.col("sketch").alias("sketch_a")), "a")
                       .join(side.select(F.col("id").alias("b"), F.col("n").alias("n_b"),
                                         F.col("sketch").alias("sketch_b")), "b"))
        likely_ = scratch.table(map_arrow(with_sketch, _estimator(percent, count), "a long, b long"),
                                f"candidates-{turn}")
        full = (likely_.join(sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("set_a")), "a")
                .join(sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("set_b")), "b"))
        new = scratch.table(map_arrow(full, _decider(percent), "a long, b long"), f"links-{turn}")
        grown = turn == 0 or not new.isEmpty()
        # a leader has met all others of its bucket: it leaves
        if not done:
            rest = (open_.select("key", "id", "n", "s")
                    .join(heads.select("key", F.col("head").alias("id")), ["key", "id"], "left_anti"))
            buckets = scratch.table(rest, f"buckets-{turn + 1}")
        turn += 1

    if comp is None:  # no two sets share a bucket
        comp = every.where("false").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("component"))
    whole = (member.join(comp, F.col("rep") == F.col("id"), "left")
             .select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")))
    alone = every.where(lone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return whole.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
