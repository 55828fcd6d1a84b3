"""The training-data pipeline over ``documents``: quality classifier, exact
dedup, MinHash near-dedup, substring dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs; all but the last return the
columns of ``documents``.  A stage's scratch tables are dropped when the next
one starts, since its result is then written."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import quality
from tidewire.llm.common import Scratch, read
from tidewire.llm.exact_dedup import exact_dedup
from tidewire.llm.minhash_dedup import near_duplicates
from tidewire.llm.packing import pack
from tidewire.llm.substring_dedup import substring_dedup

LEAST_SCORE = 0.3
_open: list[Scratch] = []


def _scratch(spark: SparkSession, name: str) -> Scratch:
    while _open:
        old = _open.pop()
        if old.spark is spark:
            old.drop()
    _open.append(Scratch(spark, f"pipeline-{name}"))
    return _open[-1]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    _scratch(spark, "quality")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model, score_col="_score").where(F.col("_score") >= LEAST_SCORE).drop("_score")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the largest doc_id."""
    found = exact_dedup(docs, keep="largest", scratch=_scratch(spark, "exact"))
    kept = found.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    # equal rows (the same doc_id and text) meet one kept row: one of them stays
    return (docs.withColumn("_sha", sha).join(kept.withColumnRenamed("_sha", "_kept_sha"),
                                              F.col("doc_id").eqNullSafe(F.col("_id"))
                                              & (F.col("_sha") == F.col("_kept_sha")), "left_semi")
            .dropDuplicates(["doc_id", "_sha"]).select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, 80 %)."""
    found = near_duplicates(docs, words_each=5, percent=80, scratch=_scratch(spark, "near"))
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that also start elsewhere."""
    _scratch(spark, "substring")
    cut = substring_dedup(docs, size=35, with_text=True)
    return cut.select(*[F.col("kept_text").alias("text") if c == "text"
                        else F.char_length("kept_text").cast("long").alias("n_chars") if c == "n_chars"
                        else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), scratch=_scratch(spark, "packing"))


STAGES = [("quality classifier", keep_good), ("exact dedup", drop_copies), ("minhash near-dedup", drop_near_copies),
          ("substring dedup", drop_repeats), ("best-fit packing", pack_documents)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    tables = Scratch(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        docs = tables.table(stage(spark, docs, sf_dir), f"{number}-{name.replace(' ', '-')}")
    return docs
