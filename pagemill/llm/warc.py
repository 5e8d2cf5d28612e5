"""A deterministic sharded WARC writer, and its reader.

Writing goes in these steps, each safe to repeat when an executor is lost:

1. Payload digests are computed once; the smallest page id of each payload that
   occurs more than once is found by a pre-aggregated group, and only the pages
   that revisit another are kept as pairs of ids. No payload moves for this.
2. Page ids with their bytes are range-sorted and summed up on the cluster; a page
   belongs to the shard in which its running sum begins. The sum over all rows is
   the same however they are dealt, so shards depend on the rows alone. The driver
   gets a number for each partition and the first id of each shard, of which there
   are at most ``MOST_SHARDS``: shards grow beyond that.
3. Payloads move once, a shard to a task. Records are sorted there by page id,
   headers and digests are made anew from the payloads, and each shard rolls to a
   new file once its compressed size passes the limit. Files get temporary names
   that hold the task attempt, and a row of the manifest each.
4. Everything goes to a new folder, the generation. The manifest rows, from the
   attempts that succeeded, are written by Spark's own committer. A second job
   renames what they name, files of failed attempts are removed, and a marker that
   names the generation makes the archive visible. Readers go by the marker and the
   manifest only, so an archive that is written again stays readable meanwhile; the
   generation before is kept until the next writing.

File names, contents and order are the same on every run: gzip members carry no
time, record ids and dates come from the page and the parameters.

Defined results: a null payload is empty. Equal payloads of at least
``min_revisit_bytes`` bytes are written once; the record with the smallest page
id is the response and the others revisit it. Among rows that repeat both id and
payload the first in file order is the response, the rest revisit it. Rows with a
null page id are responses with a record id made from their content; they neither
revisit nor are revisited, and are dealt to the shards by a hash. Rows of one page
id are in one shard. An empty table gives an archive of no files. Other columns are
not written.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm import runtime

#: Compressed bytes after which a file ends, uncompressed bytes of a shard, and most shards.
FILE_BYTES = 8 << 20
SHARD_BYTES = 32 << 20
MOST_SHARDS = 100_000
#: Bytes of headers that a record counts besides its payload.
HEAD_BYTES = 512
#: Ranges of page ids in the table that shards are looked up in.
CELLS = 1024
DATE = "2000-01-01T00:00:00Z"

MANIFEST = "file string, temporary string, shard int, part int, n_records long, n_bytes long, sha256 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, file string"


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it: local, HDFS, S3 or what else Arrow knows."""
    if urlparse(path).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(path).path if path.startswith("file:") else path
    return pafs.FileSystem.from_uri(path)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, copy: int = 0, content: bytes = b"") -> str:
    if page_id is None:
        return f"<urn:page:none:{copy}:{base32_sha1(content)}>"
    return f"<urn:page:{page_id}:{copy}>" if copy else f"<urn:page:{page_id}>"


def page_of(record: str) -> int | None:
    """The page id of a record id."""
    own = record.strip("<>").split(":")[2]
    return None if own == "none" else int(own)


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, copy: int = 0, date: str = DATE) -> bytes:
    """One gzip member: a response with its payload, or a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, copy, (url or "").encode("utf-8", "surrogatepass") + b"\0" + payload if page_id is None else b""),
        "WARC-Date": date,
        "WARC-Target-URI": quote(url or "", safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        head["WARC-Refers-To"] = record_id(refers_to)
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    body = f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(body) + packer.flush()


def _shard_bounds(digests: DataFrame, shard_bytes: int) -> list[int]:
    """First page ids of the shards but the first, from the running sum of bytes in order of page ids."""
    sizes = digests.where("page_id is not null").groupBy("page_id").agg(F.sum(F.col("n") + HEAD_BYTES).alias("n"))
    ordered = runtime.written(sizes.repartitionByRange("page_id").sortWithinPartitions("page_id").withColumn("p", F.spark_partition_id()), "warc-ordered")
    totals = ordered.groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect()
    offsets, total = [], 0
    for r in totals:
        offsets.append((r["p"], total))
        total += r["n"]
    if not total:
        return []
    step = max(shard_bytes, -(-total // MOST_SHARDS))
    before = F.col("offset") + F.sum("n").over(Window.partitionBy("p").orderBy("page_id")) - F.col("n")
    placed = ordered.join(F.broadcast(digests.sparkSession.createDataFrame(offsets, "p int, offset long")), "p").select("page_id", before.alias("before"))
    starts = placed.groupBy(F.expr(f"before div {step}").alias("shard")).agg(F.min("page_id").alias("first")).collect()
    return sorted(r["first"] for r in starts)[1:]


def _shard_of(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """The rows with the shard of their page id: the number of bounds up to it, by a search in the part of them that its range of ids has."""
    spread = F.pmod(F.xxhash64("url", "payload"), F.lit(len(bounds) + 1)).cast("int")
    if not bounds:
        return rows.withColumn("shard", F.lit(0))
    low, high = bounds[0], bounds[-1]
    width = (high - low) // CELLS + 1
    cells: list[tuple[int, int, list[int]]] = []
    at = 0
    for cell in range((high - low) // width + 1):
        end = low + (cell + 1) * width
        first = at
        while at < len(bounds) and bounds[at] < end:
            at += 1
        cells.append((cell, first, bounds[first:at]))
    runtime.check_broadcast(8 * len(bounds) + 64 * len(cells))
    table = rows.sparkSession.createDataFrame(cells, "cell long, first int, inner array<long>")
    low_, high_ = f"CAST('{low}' AS BIGINT)", f"CAST('{high}' AS BIGINT)"
    inside = f"CAST(least(greatest(page_id, {low_}), {high_}) AS DECIMAL(20, 0)) - CAST('{low}' AS DECIMAL(20, 0))"
    found = rows.withColumn("cell", F.expr(f"coalesce(({inside}) div CAST('{width}' AS DECIMAL(20, 0)), 0L)"))
    longest = max(len(x) for *_, x in cells)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(longest.bit_length()))])
    passed = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.coalesce(F.get("inner", n + step - 1) <= F.col("page_id"), F.lit(False)), n + step).otherwise(n))
    joined = found.join(F.broadcast(table), "cell", "left")
    return joined.withColumn("shard", F.when(F.col("page_id").isNull(), spread).otherwise(F.col("first") + passed).cast("int")).drop("cell", "first", "inner")


def write(pages: DataFrame, path: str, min_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write an archive to ``path``, a folder that the executors share, and return its manifest."""
    spark = pages.sparkSession
    runtime.bound_batches(spark)
    folder = f"generation-{uuid.uuid4().hex}"
    with runtime.scope(spark):
        rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "utf-8").alias("payload"))
        digests = runtime.written(rows.select("page_id", F.unhex(F.sha1("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("n")), "warc-digests")
        long_enough = digests.where((F.col("n") >= min_revisit_bytes) & F.col("page_id").isNotNull())
        firsts = long_enough.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "first")
        revisits = long_enough.join(firsts, "digest").where("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
        bounds = _shard_bounds(digests, shard_bytes)
        # payloads move once: a page that revisits another is told by a row of ids that sorts before its own rows
        told = revisits.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "refers_to", "digest", F.lit(0).alias("own"))
        both = told.unionAll(rows.select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("binary").alias("digest"), F.lit(1).alias("own")))
        dealt = _shard_of(both, bounds).repartitionById(len(bounds) + 1, F.col("shard"))
        ordered = dealt.sortWithinPartitions("shard", "page_id", "own", "digest", "url", "payload").select("shard", "page_id", "url", "payload", "refers_to", "digest", "own")
        manifest = f"{path}/{folder}/_manifest"
        ordered.mapInArrow(_writer(f"{path}/{folder}", file_bytes, min_revisit_bytes), MANIFEST).write.mode("overwrite").parquet(manifest)
    _commit(spark, path, folder, manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def _writer(folder: str, file_bytes: int, min_revisit_bytes: int):
    """Writes the records of sorted rows to files of the folder, and gives their rows of the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        attempt = f"{task.stageId()}-{task.partitionId()}-{task.taskAttemptId()}"
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        out, shard_now, part, made = None, None, 0, []
        n = size = 0
        digest = hashlib.sha256()
        seen: tuple | None = None
        first_of: dict[bytes, int] = {}
        told_of: dict[bytes, int] = {}

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                made.append((f"shard-{shard_now:06d}-{part:04d}.warc.gz", name, shard_now, part, n, size, digest.hexdigest()))
                out = None

        for batch in batches:
            for sh, page_id, address, payload, refers, told_digest, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seen != (sh, page_id):
                    seen, copy, first_of, told_of = (sh, page_id), -1, {}, {}
                if not own:
                    told_of[told_digest] = refers
                    continue
                copy += 1
                if sh != shard_now or size >= file_bytes:
                    close()
                    part = part + 1 if sh == shard_now else 0
                    shard_now = sh
                if out is None:
                    name = f"_temporary.{attempt}.{sh}.{part}.warc.gz"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    n, size, digest = 0, 0, hashlib.sha256()
                if len(payload) >= min_revisit_bytes and page_id is not None:
                    key_ = hashlib.sha1(payload).digest()
                    refers = told_of.get(key_, first_of.get(key_))
                    first_of[key_] = page_id
                record = make_record(page_id, address, payload, refers, copy)
                out.write(record)
                digest.update(record)
                n, size = n + 1, size + len(record)
        close()
        if made:
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], [x.split()[0] for x in MANIFEST.split(", ")])

    return run


def _marker(path: str) -> dict | None:
    """What the marker of an archive says, or None if there is none."""
    fs, root = store(path)
    if fs.get_file_info(f"{root}/_COMMITTED").type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(f"{root}/_COMMITTED") as f:
        return json.loads(f.read())


def _commit(spark: SparkSession, path: str, folder: str, manifest: str) -> None:
    """Rename what the manifest names, remove what failed attempts left, then publish the generation. Repeating a rename that was done changes nothing."""
    where = f"{path}/{folder}"

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(where)
        for batch in batches:
            for name, temporary in zip(batch.column("file").to_pylist(), batch.column("temporary").to_pylist(), strict=True):
                if fs.get_file_info(f"{root}/{temporary}").type != pafs.FileType.NotFound:
                    fs.move(f"{root}/{temporary}", f"{root}/{name}")
                elif fs.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
                    raise FileNotFoundError(f"{root}/{temporary}")
            yield pa.RecordBatch.from_arrays([batch.column("file")], ["file"])

    named = spark.read.schema(MANIFEST).parquet(manifest)
    n = named.select("file", "temporary").mapInArrow(rename, "file string").count()
    fs, root = store(path)
    fs.create_dir(f"{root}/{folder}", recursive=True)
    for found in fs.get_file_info(pafs.FileSelector(f"{root}/{folder}")):
        if found.base_name.startswith("_temporary."):
            fs.delete_file(found.path)
    before = (_marker(path) or {}).get("generation")
    with fs.open_output_stream(f"{root}/_COMMITTED.{folder}") as f:
        f.write(json.dumps({"generation": folder, "files": n}).encode())
    try:
        fs.move(f"{root}/_COMMITTED.{folder}", f"{root}/_COMMITTED")
    except OSError:  # stores that do not rename onto a file
        fs.delete_file(f"{root}/_COMMITTED")
        fs.move(f"{root}/_COMMITTED.{folder}", f"{root}/_COMMITTED")
    for found in fs.get_file_info(pafs.FileSelector(root)):
        if found.base_name.startswith("generation-") and found.base_name not in (folder, before):
            fs.delete_dir(found.path)


def parse_members(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open gzip file of one member a record, read in pieces."""
    pending = b""
    while True:
        pending = pending or stream.read(1 << 20)
        if not pending:
            return
        unpacker, out = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not pending and not (pending := stream.read(1 << 20)):
                raise ValueError("a record is cut off")
            out.append(unpacker.decompress(pending))
            pending = unpacker.unused_data
        head, _, rest = b"".join(out).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record: {lines[0][:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of a committed archive, checked against their digests.

    A revisit has no payload of its own; its size and digest are those of the
    full payload, from its headers.
    """
    marker = _marker(path)
    if marker is None:
        raise FileNotFoundError(f"{path} holds no committed archive")
    folder = f"{path}/{marker['generation']}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, top = store(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, size = [], 0
                with own.open_input_stream(f"{top}/{name}", compression=None) as f:
                    for fields, block in parse_members(f):
                        if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                            raise ValueError(f"{name}: digest of {fields['WARC-Record-ID']} differs")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                        kind = fields["WARC-Type"]
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and digest != base32_sha1(payload):
                            raise ValueError(f"{name}: payload digest of {fields['WARC-Record-ID']} differs")
                        refers = fields.get("WARC-Refers-To")
                        page = page_of(fields["WARC-Record-ID"])
                        rows.append((page, fields["WARC-Target-URI"], length, digest, kind, page_of(refers) if refers else None, payload if with_payload and kind == "response" else None, name))
                        size += len(block)
                        if size >= 16 << 20:
                            yield _records(rows)
                            rows, size = [], 0
                if rows:
                    yield _records(rows)

    files = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest").select("file")
    return files.repartition(max(1, marker["files"])).mapInArrow(run, RECORDS)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])
