"""Document fingerprints by consistent weighted sampling (DataFrame functions
only).

A document is the weighted set of its words, weighted by their counts.  For
each of ``samples`` draws every word has two gamma(2, 1) variables and one
uniform variable, derived from a hash of the word alone; the word with the
least sample value wins (Ioffe, Improved Consistent Sampling, 2010).  Draws of
two documents agree with a probability equal to their generalised Jaccard
similarity sum(min(v, w)) / sum(max(v, w)), so the share of equal draws
estimates it; its standard error is at most 0.5 / sqrt(samples).

Defined results: null text is empty; a text without words has the fingerprint
of zeros, which is like itself only; equal texts have equal fingerprints;
rows of equal identifier are ordered by text; further columns are not read; an
empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import WORD_SPLIT, Scratch

SAMPLES = 32
_LOW32 = 0xFFFFFFFF


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def weighted_words(text: Column) -> Column:
    """The text's distinct words as an array of (code, count)."""
    words = F.filter(F.split(text, WORD_SPLIT), lambda w: w != "")
    return _let(F.sort_array(F.transform(words, lambda w: F.xxhash64(w))), lambda codes: _let(
        F.filter(F.sequence(F.lit(0), F.greatest(F.size(codes) - 1, F.lit(0))),
                 lambda i: (F.size(codes) > 0) & ((i == 0) | (F.get(codes, i) != F.get(codes, i - 1)))),
        lambda starts: F.transform(starts, lambda at, i: F.struct(
            F.get(codes, at).alias("code"),
            (F.coalesce(F.get(starts, i + 1), F.size(codes)) - at).alias("count")))))


def _uniform(bits: Column, shift: int, width: int) -> Column:
    """(0, 1) from ``width`` bits of a hash."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(0.5)) * F.lit(2.0**-width)


def sample(k: int) -> Column:
    """Draw ``k`` of a row (code, logw): its value in the high bits, what it
    names (word and step) in the low 32."""
    a, b = F.xxhash64("code", F.lit(2 * k)), F.xxhash64("code", F.lit(2 * k + 1))
    r = -F.log(_uniform(a, 0, 21) * _uniform(a, 21, 21))
    beta = _uniform(a, 42, 21)
    log_c = F.log(-F.log(_uniform(b, 0, 21) * _uniform(b, 21, 21)))
    t = F.floor(F.col("logw") / r + beta)
    log_a = log_c - r * (t - beta) - r
    high = F.least(F.greatest((log_a + 128.0) * F.lit(float(1 << 23)), F.lit(0.0)), F.lit(2.0**31 - 1)).cast("long")
    low = F.xxhash64("code", t).bitwiseAND(F.lit(_LOW32))
    return F.shiftleft(high, 32).bitwiseOR(low)


def fingerprints(texts: DataFrame, key_cols: list[str], text_col: str, samples: int = SAMPLES) -> DataFrame:
    """key_cols and ``marks``: an array of ``samples`` numbers (32 bits each).

    Rows of a text lie next to each other, so partial aggregation leaves one
    row a text before any shuffle.  Texts without words have zeros."""
    words = texts.select(*key_cols, F.explode_outer(weighted_words(F.col(text_col))).alias("w"))
    rows = words.select(*key_cols, F.col("w.code").alias("code"), F.log(F.col("w.count").cast("double")).alias("logw"))
    least = rows.groupBy(*key_cols).agg(*[F.min(sample(k)).alias(f"m{k}") for k in range(samples)])
    marks = F.array(*[F.coalesce(F.col(f"m{k}").bitwiseAND(F.lit(_LOW32)), F.lit(0).cast("long"))
                      for k in range(samples)])
    return least.select(*key_cols, marks.alias("marks"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal draws (0 to 1)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0)), F.lit(0.0),
                       lambda s, v: s + v) / F.size(a)


def as_text(marks: Column) -> Column:
    return F.concat_ws("", F.transform(marks, lambda m: F.lpad(F.lower(F.hex(m)), 8, "0")))


def with_next(docs: DataFrame, blocks: int = 256) -> DataFrame:
    """doc_id, text, the row's place (block, nth), and the next row's place and
    text in falling order of doc_id (after the last row: the first).

    Sampled quantiles of the identifier cut the rows into blocks; the next row
    is found by a window within each block, and for a block's last row from
    the first rows of the blocks (one row a block)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    block = F.lit(0)
    if cuts:
        edges = F.array(*[F.lit(c) for c in cuts])
        block = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(
            F.size(F.filter(edges, lambda c: c >= F.col("doc_id"))))
    order = [F.desc_nulls_last("doc_id"), F.col("text")]
    w = Window.partitionBy("block").orderBy(*order)
    rows = (rows.withColumn("block", block.cast("int"))
            .withColumn("nth", F.row_number().over(w))
            .withColumn("next_text", F.lead("text").over(w)))
    # the first row of each block, next to the block before it
    first = rows.where("nth = 1").select("block", F.col("text").alias("head_text"))
    every = Window.partitionBy("one").orderBy("block")
    blocks_ = first.select("block").withColumn("one", F.lit(1))  # one number a block
    follow = blocks_.select("block", F.coalesce(F.lead("block").over(every), F.first("block").over(
        every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_block"))
    heads = follow.join(first.withColumnRenamed("block", "next_block"), "next_block")
    out = rows.join(heads, "block")
    last = F.col("next_text").isNull()
    return out.select("doc_id", "text", "block", "nth",
                      F.when(last, F.col("next_block")).otherwise(F.col("block")).alias("next_block"),
                      F.when(last, F.lit(1)).otherwise(F.col("nth") + 1).alias("next_nth"),
                      F.when(last, F.col("head_text")).otherwise(F.col("next_text")).alias("next_text"))


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES, scratch: Scratch | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text (the last third
    replaced by the start of the next text), with their likenesses."""
    scratch = scratch or Scratch(docs.sparkSession, "fingerprints")
    rows = with_next(docs)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    both = rows.select("doc_id", "block", "nth", "next_block", "next_nth", n.cast("long").alias("n_chars"),
                       F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")),
                                         F.struct(F.lit(1).alias("kind"), edited.alias("text")))).alias("x"))
    key = ["block", "nth", "kind", "doc_id", "next_block", "next_nth", "n_chars", "edited_sha256"]
    texts = both.select("doc_id", "block", "nth", "next_block", "next_nth", "n_chars", F.col("x.kind").alias("kind"),
                        F.when(F.col("x.kind") == 1, F.sha2(F.col("x.text").cast("binary"), 256)).alias("edited_sha256"),
                        F.col("x.text").alias("text"))
    marks = scratch.table(fingerprints(texts, key, "text", samples), "marks")
    own = marks.where("kind = 0").select("block", "nth", "doc_id", "next_block", "next_nth", "n_chars",
                                         F.col("marks").alias("own"))
    changed = marks.where("kind = 1").select("block", "nth", "edited_sha256", F.col("marks").alias("edited"))
    following = marks.where("kind = 0").select(F.col("block").alias("next_block"), F.col("nth").alias("next_nth"),
                                               F.col("marks").alias("next"))
    return (own.join(changed, ["block", "nth"]).join(following, ["next_block", "next_nth"])
            .select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"),
                    as_text(F.col("edited")).alias("edited_fingerprint"),
                    likeness(F.col("own"), F.col("edited")).alias("near_edited"),
                    likeness(F.col("own"), F.col("next")).alias("near_next")))
