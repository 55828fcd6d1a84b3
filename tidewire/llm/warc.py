"""WARC archives: a deterministic sharded writer and its reader.

Records are dealt to shards by ranges of (page_id, digest) and sorted; each
shard is written as gzip members, one a record, into files that roll at
``roll_bytes`` of compressed size.  The ranges are cut at every ``shard_bytes``
of exact cumulative payload bytes over all keys in order, so they depend on the
pages alone, not on a sample, their order or the session.  Files are written under names of the attempt; the tasks'
manifest rows (attempt name, final name, records, bytes, digest) go through
Spark's own commit, so rows of lost or repeated attempts never count; then the
listed files get their final names, which may be repeated safely, and the
manifest is written last.  Readers follow the manifest alone.  The same input
gives the same files.

Of records with equal payloads of at least ``revisit_bytes`` the one with the
smallest page_id is a response, the others are revisits without a payload.

Defined results: null html is an empty payload; null urls are named after the
page; a null page_id has no id header and comes back as null; of equal payloads
under one page_id all rows but the first are revisits of it; an empty table
gives an empty manifest; further columns are not read.  Memory: one Arrow
batch and one record."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.common import map_arrow

DATE = "2024-01-31T00:00:00Z"
_SPACE = uuid.UUID("6f1c7a52-3c1e-5d0b-9d53-0b7c2f4f9a11")
_MANIFEST = "attempt string, file string, records long, bytes long, sha256 string"
_RECORD = ("page_id long, target_uri string, record_type string, payload_digest string, payload_bytes long, "
           "refers_to long, payload binary")


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS, object stores)."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return pyarrow.fs.FileSystem.from_uri(uri)
    return pyarrow.fs.LocalFileSystem(), uri


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header alone."""
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
             ).encode() + (b"" if revisit else payload)
    own = "" if page_id is None else str(page_id)
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{own or 'none'}"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
             f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if own:
        lines.append(f"X-Page-Id: {own}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record; digests are verified."""
    head, rest = data.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n" or hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"][7:]:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, payload = block.split(b"\r\n\r\n", 1)
    digest, kind = fields["WARC-Payload-Digest"][7:], fields["WARC-Type"]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-Id"), "target_uri": fields["WARC-Target-URI"], "record_type": kind,
            "payload_digest": digest, "payload_bytes": length, "refers_to": number("X-Refers-To-Page-Id"),
            "payload": payload if kind == "response" else None}


def _writer(folder: str, roll_bytes: int):
    def write(batches):
        fs, root = filesystem(folder)
        attempt, out, done = uuid.uuid4().hex, None, []
        part, nth, count, held, sha, key, first, seen = None, 0, 0, 0, None, None, None, 0

        def close():
            out.close()
            done.append((f"_attempts/{name}.{attempt}", name, count, held, sha.hexdigest()))

        for batch in batches:
            for page_id, digest, kind, url, html, refers, one, p in zip(
                    *(batch.column(c).to_pylist() for c in
                      ("page_id", "digest", "kind", "url", "html", "first_id", "repeats", "shard")), strict=True):
                if p != part:
                    if out is not None:
                        close()
                        out = None
                    part, nth = p, 0
                if (page_id, digest) != key:
                    key, first, seen = (page_id, digest), None, 0
                if not kind:
                    first = (refers, one)
                    continue
                seen += 1
                payload = (html or "").encode()
                # the first row of the smallest page_id is the response
                revisit = first is not None and (page_id != first[0] or seen > 1)
                data = record(page_id, url, payload, digest, first[0] if revisit else None, revisit)
                if out is None:
                    count, held, sha = 0, 0, hashlib.sha256()
                    name = f"pages-{part:06d}-{nth:05d}.warc.gz"
                    nth += 1
                    fs.create_dir(f"{root}/_attempts", recursive=True)
                    out = fs.open_output_stream(f"{root}/_attempts/{name}.{attempt}", compression=None)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = pack.compress(data) + pack.flush()
                out.write(member)
                sha.update(member)
                count, held = count + 1, held + len(member)
                if held >= roll_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.record_batch([pa.array(x) for x in zip(*done, strict=True)],
                                  names=["attempt", "file", "records", "bytes", "sha256"])

    return write


def _committer(folder: str):
    def commit(batches):
        fs, root = filesystem(folder)
        for batch in batches:
            for attempt, name in zip(batch.column("attempt").to_pylist(), batch.column("file").to_pylist(),
                                     strict=True):
                if fs.get_file_info(f"{root}/{attempt}").type == pyarrow.fs.FileType.File:
                    fs.move(f"{root}/{attempt}", f"{root}/{name}")
                elif fs.get_file_info(f"{root}/{name}").type != pyarrow.fs.FileType.File:
                    raise FileNotFoundError(f"{root}/{name}")
            yield batch

    return commit


def _key() -> Column:
    """The order of records; null page_ids come first."""
    return F.struct(F.col("page_id").isNotNull().cast("int").alias("known"),
                    F.coalesce("page_id", F.lit(0)).alias("page_id"), F.col("digest"))


def first_keys(keys: DataFrame, folder: str, shard_bytes: int) -> list:
    """The first key of each shard but shard 0, in order: a shard begins where
    the bytes of all keys before it pass a multiple of ``shard_bytes``.

    Sums over the whole order do not depend on where its partitions are cut."""
    spark = keys.sparkSession
    keys.select(_key().alias("key"), "bytes").orderBy("key").withColumn("at", F.spark_partition_id()).write.parquet(
        f"{folder}/_order")
    order = spark.read.schema("key struct<known:int,page_id:long,digest:string>, bytes long, at int").parquet(
        f"{folder}/_order")
    # one row for each partition of the order
    begins = order.groupBy("at").agg(F.sum("bytes").alias("all")).select("at", F.coalesce(F.sum("all").over(
        Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("at").orderBy("key").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    cut = order.withColumn("before", before).join(F.broadcast(begins), "at").select(
        "key", F.floor((F.col("begin") + F.col("before")) / shard_bytes).alias("nth"))
    # one key for each ``shard_bytes`` of payload goes to the driver
    return sorted(tuple(r.key) for r in cut.where("nth > 0").groupBy("nth").agg(F.min("key").alias("key")).collect())


def _shard(firsts: int) -> Column:
    """How many of the sorted ``cuts`` are not after the key: a binary search."""
    def step(x, _):
        mid = ((x["low"] + x["high"]) / 2).cast("int")
        passed = (x["low"] < x["high"]) & (F.get("cuts", mid) <= F.col("key"))
        return F.struct(F.when(passed, mid + 1).otherwise(x["low"]).alias("low"),
                        F.when(passed, x["high"]).otherwise(mid).alias("high"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(firsts.bit_length())),
                       F.struct(F.lit(0).alias("low"), F.lit(firsts).alias("high")), step)["low"]


def write_warc(pages: DataFrame, folder: str, roll_bytes: int = 64 << 20, revisit_bytes: int = 100,
               shard_bytes: int = 64 << 20) -> DataFrame:
    """Write the archives; returns the manifest.  ``folder``: a new one that
    driver and executors share."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    sizes = rows.select("page_id", "digest", F.octet_length("html").cast("long").alias("size"))
    # a header's worth more for each record; equal digests have equal sizes
    sizes.groupBy("digest", "page_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.sum(F.col("size") + 512).alias("bytes")
    ).write.parquet(f"{folder}/_keys")
    keys = spark.read.schema("digest string, page_id long, n long, size long, bytes long").parquet(f"{folder}/_keys")
    cuts = first_keys(keys, folder, shard_bytes)
    narrow = keys.where(F.col("size") >= revisit_bytes)
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.sum("n").alias("repeats"))
    marks = narrow.join(firsts.where("repeats > 1 and first_id is not null"), "digest")
    # one shuffle of the payloads: marks travel with them, each before its rows
    both = rows.select("page_id", "digest", F.lit(1).alias("kind"), "url", "html",
                       F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("long").alias("repeats")).unionByName(
        marks.select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"),
                     F.lit(None).cast("string").alias("html"), "first_id", "repeats"))
    table = spark.createDataFrame([(cuts,)], "cuts array<struct<known:int,page_id:long,digest:string>>")
    dealt = (both.withColumn("key", _key()).join(F.broadcast(table), F.lit(True))
             .withColumn("shard", _shard(len(cuts))).drop("key", "cuts")
             .repartitionById(len(cuts) + 1, F.col("shard"))
             .sortWithinPartitions("shard", "page_id", "digest", "kind", "url"))
    map_arrow(dealt, _writer(folder, roll_bytes), _MANIFEST).write.parquet(f"{folder}/_pending")
    pending = spark.read.schema(_MANIFEST).parquet(f"{folder}/_pending")
    map_arrow(pending, _committer(folder), _MANIFEST).select("file", "records", "bytes", "sha256").write.parquet(
        f"{folder}/_manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("file string, records long, bytes long, sha256 string").parquet(f"{folder}/_manifest")


def _reader(folder: str, with_payload: bool):
    names = [x.split()[0] for x in _RECORD.split(", ")]

    def read(batches):
        fs, root = filesystem(folder)
        kinds = dict(zip(names, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(),
                                 pa.binary()), strict=True))
        for batch in batches:
            for name, records in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist(),
                                     strict=True):
                rows, total = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for data in members(f):
                        row = parse(data)
                        rows.append(row if with_payload else row | {"payload": None})
                        total += 1
                        if len(rows) == 256:
                            yield pa.record_batch([pa.array([r[n] for r in rows], kinds[n]) for n in names], names=names)
                            rows = []
                if total != records:
                    raise ValueError(f"{name}: {total} records, the manifest has {records}")
                if rows:
                    yield pa.record_batch([pa.array([r[n] for r in rows], kinds[n]) for n in names], names=names)

    return read


#: Tasks that read archives.
READERS = 100_000


def members(stream):
    """The contents of the gzip members of a stream, one after the other."""
    unpack, out, rest = zlib.decompressobj(31), [], b""
    while True:
        rest = rest or stream.read(1 << 20)
        if not rest:
            if out:
                raise EOFError("the last member is cut off")
            return
        out.append(unpack.decompress(rest))
        rest = unpack.unused_data
        if unpack.eof:
            yield b"".join(out)
            unpack, out = zlib.decompressobj(31), []


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the files in the manifest.  A file is a task's work
    (``READERS`` tasks at most): a number of partitions that is given is not
    merged for the few bytes that the manifest itself has."""
    manifest = read_manifest(spark, folder)
    spread = manifest.repartition(max(1, min(manifest.count(), READERS)), F.col("file"))
    return map_arrow(spread, _reader(folder, with_payload), _RECORD)
