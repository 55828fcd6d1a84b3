"""Secret scans with an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its whole
text.  The ledger holds which (blob, rule version) pairs have been scanned and
what was found; a scan looks up the blobs at hand, reads the text of one
carrier of each blob with pairs still unseen, applies only the unseen rules to
it, records the outcome (no findings too), and joins findings back to all
paths.  A copy, an old version seen again or a second run costs no scan; a rule
with a new version is applied to every blob once more, the others are not.

A rule has a pattern, the group whose length counts and the least length;
matches are leftmost and non-overlapping, and those that are too short are
dropped after they were matched.  Patterns see ASCII only, so they run on the
UTF-8 bytes; a screening pattern, implied by every match that stays, is tested
on whole batches first.  Offsets are code points, ends exclusive.

Recovery: a scan writes one table of its own and then names it in the ledger's
list of commits; a scan that was lost is not named and its pairs stay unseen.

Hot blobs: of a group of copies one row is read, found by a key of blob and
path, so no task gathers the group; the join back to the paths has one row for
each blob on the other side, and adaptive execution cuts a hot blob's paths.

Defined results: null text counts as empty; null path keys are ordinary;
repeated rows share a blob and come out one by one; an empty table gives no
rows; further columns are not read.  Memory: one batch of texts, the offsets
of one text with findings."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import Scratch, map_arrow
from tidewire.session import path_exists


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0
    #: a pattern that occurs in every text with a match that stays
    screen: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base rules.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

#: In order of report.  The base rules, then public formats of keys that they miss.
RULES = (
    Rule("assign", 1, ASSIGN, 12, 2, ASSIGN[:-2] + "{12})"),
    Rule("access", 1, ACCESS, 18, 0, "AKIA[A-Z0-9]{14}"),
    Rule("hex", 1, HEX, 16, 0, "[0-9a-f]{16}"),
    Rule("private", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 1, 0, "PRIVATE KEY-----"),
    Rule("github", 1, r"gh[opsru]_[A-Za-z0-9]+", 40, 0, "gh[opsru]_[A-Za-z0-9]{36}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, 0, r"eyJ[A-Za-z0-9_-]+\.eyJ"),
)

_SPANS = "array<struct<rule: string, start: long, end: long>>"
_SCANS = f"blob binary, scanned array<string>, spans {_SPANS}"


class Ledger:
    """The scans made so far, in a folder of shared storage."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _file_system(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def commits(self) -> list[str]:
        if not path_exists(self.spark, f"{self.root}/commits"):
            return []
        files, path = self._file_system("commits")
        return sorted(f.getPath().getName() for f in files.listStatus(path))

    def scans(self) -> DataFrame | None:
        """blob, scanned, spans of all committed scans; None before the first."""
        paths = [f"{self.root}/scans/{name}" for name in self.commits()]
        return self.spark.read.schema(_SCANS).parquet(*paths) if paths else None

    def record(self, rows: DataFrame) -> str:
        """Add the rows of one scan; they count once their name is listed."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/scans/{name}")
        files, path = self._file_system(f"commits/{name}")
        files.create(path).close()
        return name


def _spans(rule: Rule, pattern: re.Pattern, text: bytes) -> np.ndarray:
    """Byte ranges of the rule's findings in a text."""
    found = [m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return np.array(found, np.int64).reshape(-1, 2)


def _scanner(rules: Sequence[Rule]):
    patterns = [re.compile(r.pattern.encode()) for r in rules]

    def scan(batches):
        for batch in batches:
            texts = batch.column("text")
            due = batch.column("due")
            hits: dict[int, list] = {}
            for rule, pattern in zip(rules, patterns, strict=True):
                maybe = pc.match_substring_regex(texts, rule.screen) if rule.screen else pa.array([True] * len(texts))
                for i in np.flatnonzero(maybe.to_numpy(zero_copy_only=False)):
                    if rule.key in due[i].as_py():
                        text = texts[i].as_buffer().to_pybytes()
                        spans = _spans(rule, pattern, text)
                        if len(spans) and not text.isascii():
                            points = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
                            spans = np.append(0, points)[spans]  # code points before each byte
                        hits.setdefault(int(i), []).extend(
                            {"rule": rule.key, "start": s, "end": e} for s, e in spans.tolist())
            yield pa.record_batch(
                [batch.column("blob"), due, pa.array([hits.get(i, []) for i in range(len(texts))], pa.list_(
                    pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))],
                names=["blob", "scanned", "spans"])

    return scan


def scan(history: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES, keys: Sequence[str] = ("doc_id",),
         text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Scan what the ledger lacks; for each row of ``history`` (a version of a
    path): its keys, ``blob``, and the ``spans`` (kind, start, end) of the
    rules' versions, by start and then by the rules' order."""
    scratch = scratch or Scratch(history.sparkSession, "secrets")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = [F.col(k).alias(f"key{i}") for i, k in enumerate(keys)]
    rows = history.select(*named, text.alias("text")).select(
        "*", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("blob"),
        F.xxhash64(*[f"key{i}" for i in range(len(keys))]).alias("carrier"))
    paths = scratch.table(rows.drop("text"), "paths")

    wanted = F.array(*[F.lit(r.key) for r in rules])
    blobs = paths.groupBy("blob").agg(F.min("carrier").alias("carrier"))
    seen = ledger.scans()
    if seen is None:
        due = blobs.withColumn("due", wanted)
    else:
        done = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("done"))
        due = (blobs.join(done, "blob", "left")
               .withColumn("due", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>"))))
               .where(F.size("due") > 0).drop("done"))
    # the side without texts is hashed: rows with texts are not sorted
    carriers = rows.select("blob", "carrier", "text").join(
        due.hint("shuffle_hash"), ["blob", "carrier"]).select("blob", "text", "due")
    ledger.record(map_arrow(carriers, _scanner(tuple(rules)), _SCANS).dropDuplicates(["blob"]))

    order = F.array(*[F.lit(r.key) for r in rules])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    now = F.filter("spans", lambda s: F.array_contains(order, s["rule"]))
    found = (ledger.scans().select("blob", now.alias("spans")).where(F.size("spans") > 0)
             .groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
             .select("blob", F.transform(F.array_sort(F.transform("spans", lambda s: F.struct(
                 s["start"].alias("start"), F.array_position(order, s["rule"]).cast("int").alias("rank"),
                 s["end"].alias("end")))),
                 lambda s: F.struct(F.element_at(kinds, s["rank"]).alias("kind"), s["start"].alias("start"),
                                    s["end"].alias("end"))).alias("spans")))
    none = F.array().cast("array<struct<kind: string, start: long, end: long>>")
    return paths.join(found, "blob", "left").select(
        *[F.col(f"key{i}").alias(k) for i, k in enumerate(keys)], "blob", F.coalesce("spans", none).alias("spans"))


def digests(found: DataFrame, keys: Sequence[str] = ("doc_id",), base: Sequence[str] = ("assign", "access", "hex")
            ) -> DataFrame:
    """keys, the number of findings of each base kind, ``base_sha256`` and
    ``spans``: findings as kind:start:end, joined by commas."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(*keys, *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
                        F.sha2(joined(of(*base)).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))
