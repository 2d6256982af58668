"""WARC (operator 5): deterministic sharded writer, and reader.

Writing:

1. The payload digest of every row is taken; of equal payloads of at least
   ``REVISIT_BYTES``, the row with the smallest id is the response and the
   others become revisits of it (a pre-aggregated minimum per digest).
2. Rows go to shards by ranges of (id, digest), cut by their real bytes
   (``ranges``): a far outlier or an id with very many rows makes no shard larger.
   Only rows that are equal in id and payload have to stay together.  What a row
   revisits travels as a small row of its own, which is sorted in front of it, so
   the payloads are shuffled once.
3. Each shard is sorted and written as gzip members, one a record; a file is
   closed when its compressed size reaches ``roll_bytes``.  Headers, record ids
   and block and payload digests are made anew; the date is a parameter.  So
   equal input gives equal files under equal names.
4. Files are first written under names that only one task attempt uses.  The
   attempts that Spark accepts hand in manifest rows; the manifest is stored, then
   a second job renames what it lists (again harmless if it was done before),
   and the folder of temporary names goes.

Reading streams the listed files, checks every block and payload digest and
length, and returns a row per record.

Files are opened through ``pyarrow.fs``, so the folder may be any URI that it
knows (file, hdfs, s3, gs) and must be shared by all executors.

Defined cases: null html is an empty payload; a null url is left out; a null id
has no id header, is never a revisit nor revisited, and sorts first; rows that
repeat the smallest id of their payload are all responses; an empty table gives
an empty archive.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StringType, StructType

from blotter.llm.common import cut, field, pick
from blotter.llm.ranges import exact_cuts, range_of

REVISIT_BYTES = 100
#: What a record weighs besides its payload.
RECORD_BYTES = 600
SHARD_BYTES = 16 << 20
ROLL_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_HEADER, REFERS_HEADER = "X-Page-Id", "X-Refers-To-Page-Id"
CHUNK = 1 << 20

MANIFEST = StructType([field("file", StringType()), field("temporary", StringType()), field("n_records", LongType()),
                       field("n_bytes", LongType()), field("sha256", StringType())])
RECORDS = StructType([field("page_id", LongType()), field("url", StringType()), field("record_type", StringType()),
                      field("payload_bytes", LongType()), field("payload_digest", StringType()),
                      field("refers_to", LongType()), field("file", StringType()), field("offset", LongType()),
                      field("intact", BooleanType())])


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


# ---- records ----

def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'record:' + ':'.join(map(str, parts)))}>"


def headed(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in headers if v is not None],
             f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None,
                repeat: int, date: str) -> bytes:
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    kind = "response" if refers is None else "revisit"
    headers = [("WARC-Record-ID", record_id(page_id, digest, repeat)), ("WARC-Date", date),
               ("WARC-Target-URI", None if url is None else " ".join(url.split())),
               (ID_HEADER, page_id), ("WARC-Payload-Digest", f"sha256:{digest}"),
               ("Content-Type", "application/http; msgtype=response")]
    if refers is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers, digest, 0)),
                    (REFERS_HEADER, refers)]
    return headed(kind, headers, http + (payload if refers is None else b""))


def packed(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class ShardWriter:
    """Files of one shard under temporary names; ``done`` holds their manifest rows."""

    def __init__(self, folder: str, shard: int, attempt: str, roll_bytes: int, date: str):
        self.fs, self.path = opened(folder)
        self.shard, self.attempt, self.roll, self.date = shard, attempt, roll_bytes, date
        self.done: list[tuple] = []
        self.out = None

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"pages-{self.shard:06d}-{len(self.done):05d}.warc.gz"
            self.temporary = f"_temporary/{self.attempt}-{self.name}"
            self.fs.create_dir(f"{self.path}/_temporary", recursive=True)
            self.out = self.fs.open_output_stream(f"{self.path}/{self.temporary}", compression=None)
            self.sha, self.size, self.records = hashlib.sha256(), 0, 0
            info = f"software: blotter\r\nformat: WARC File Format 1.1\r\nfile: {self.name}\r\n".encode()
            self._write(packed(headed("warcinfo", [("WARC-Record-ID", record_id("info", self.name)),
                                                   ("WARC-Date", self.date), ("WARC-Filename", self.name),
                                                   ("Content-Type", "application/warc-fields")], info)))
        self._write(packed(data))
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.temporary, self.records, self.size, self.sha.hexdigest()))
            self.out = None


# ---- writing ----

def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES,
                  date: str = DATE) -> DataFrame:
    """Writes the archive to ``folder`` and returns its manifest (a row per file)."""
    spark = pages.sparkSession
    rows = (pick(pages, page_id=id_col, url=url_col, payload=payload_col)
            .withColumn("page_id", F.col("page_id").cast("long"))
            .withColumn("payload", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")))
            .withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long")))
    # The digest's first 15 digits as a number: ranges follow the order of id and digest.
    rows = rows.withColumn("part", F.conv(F.substring("digest", 1, 15), 16, 10).cast("long"))
    small = cut(rows.select("page_id", "part", "digest", "n_bytes"))
    cuts = exact_cuts(small.withColumn("n", F.col("n_bytes") + RECORD_BYTES), ["page_id", "part"], "n", shard_bytes)
    shards, shard = len(cuts) + 1, range_of(cuts, "page_id", "part").alias("shard")
    rows = rows.select("*", shard)
    keys = (small.where(F.col("n_bytes") >= REVISIT_BYTES).where("page_id IS NOT NULL")
            .select(shard, "page_id", "digest"))
    first = (keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
             .where("first < last").select("digest", "first"))
    revisits = keys.join(first, "digest").where("page_id > first").distinct()
    none = {"url": F.lit(None).cast("string"), "payload": F.lit(None).cast("binary")}
    notes = revisits.select("shard", "page_id", "digest", F.lit(0).alias("kind"), F.col("first").alias("refers"),
                            *[c.alias(k) for k, c in none.items()])
    both = notes.unionByName(rows.select("shard", "page_id", "digest", F.lit(1).alias("kind"),
                                         F.lit(None).cast("long").alias("refers"), "url", "payload"))
    both = (both.repartitionById(shards, F.col("shard"))
            .sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "kind", "url"))

    def write(batches):
        attempt = uuid.uuid4().hex
        schema = to_arrow_schema(MANIFEST)
        writer, refers, of, repeat = None, None, None, 0
        done = []
        for batch in batches:
            cols = [batch.column(c) for c in ("shard", "page_id", "digest", "kind", "refers", "url", "payload")]
            for i in range(batch.num_rows):
                shard, page_id, digest, kind, note, url, payload = (c[i].as_py() for c in cols)
                if writer is None or writer.shard != shard:
                    if writer:
                        writer.close()
                        done += writer.done
                    writer = ShardWriter(folder, shard, attempt, roll_bytes, date)
                if (shard, page_id, digest) != of:
                    refers, of, repeat = None, (shard, page_id, digest), 0
                if kind == 0:
                    refers = note
                    continue
                writer.add(page_record(page_id, url, payload, digest, refers, repeat, date))
                repeat += 1
        if writer:
            writer.close()
            done += writer.done
        for name, *rest in done:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (name, *rest)))], schema)

    both.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")

    def rename(batches):
        fs, path = opened(folder)
        for batch in batches:
            for r in batch.to_pylist():
                at, to = f"{path}/{r['temporary']}", f"{path}/{r['file']}"
                if fs.get_file_info(at).type == pafs.FileType.File:
                    fs.move(at, to)
                if fs.get_file_info(to).size != r["n_bytes"]:
                    raise OSError(f"{to} is missing or has another size than the manifest")
            yield batch

    renamed = manifest.mapInArrow(rename, MANIFEST).agg(F.count("*")).first()[0]
    if renamed:
        fs, path = opened(folder)
        fs.delete_dir(f"{path}/_temporary")
    return manifest


# ---- reading ----

def members(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a stream."""
    z, parts, offset, read = zlib.decompressobj(31), [], 0, 0
    data = stream.read(CHUNK)
    while data:
        read += len(data)
        parts.append(z.decompress(data))
        if z.eof:
            data = z.unused_data
            yield offset, b"".join(parts)
            offset = read - len(data)
            read = offset
            z, parts = zlib.decompressobj(31), []
            if data:
                continue
        data = stream.read(CHUNK)
    if any(parts):
        raise OSError("the last gzip member is cut off")


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise OSError("a record does not end where its length says")
    return headers, rest[:size]


def told(headers: dict[str, str], block: bytes, file: str, offset: int) -> dict:
    head, _, payload = block.partition(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(http["Content-Length"])
    intact = headers["WARC-Block-Digest"] == f"sha256:{hashlib.sha256(block).hexdigest()}"
    if headers["WARC-Type"] == "response":
        intact &= len(payload) == size and hashlib.sha256(payload).hexdigest() == digest
    number = {k: None if headers.get(k) is None else int(headers[k]) for k in (ID_HEADER, REFERS_HEADER)}
    return {"page_id": number[ID_HEADER], "url": headers.get("WARC-Target-URI"), "record_type": headers["WARC-Type"],
            "payload_bytes": size, "payload_digest": digest, "refers_to": number[REFERS_HEADER], "file": file,
            "offset": offset, "intact": intact}


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """A row per page record of the files that the manifest lists; damage raises."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    files = max(1, manifest.count())

    def read(batches):
        schema = to_arrow_schema(RECORDS)
        fs, path = opened(folder)
        for batch in batches:
            for r in batch.to_pylist():
                rows, n = [], 0
                with fs.open_input_stream(f"{path}/{r['file']}", compression=None) as stream:
                    for offset, data in members(stream):
                        headers, block = parsed(data)
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        row = told(headers, block, r["file"], offset)
                        if not row["intact"]:
                            raise OSError(f"{r['file']} at {offset}: a digest or length is wrong")
                        rows.append(row)
                        n += 1
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if n != r["n_records"]:
                    raise OSError(f"{r['file']} holds {n} records, the manifest says {r['n_records']}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return manifest.repartition(min(files, 2000), "file").mapInArrow(read, RECORDS)
