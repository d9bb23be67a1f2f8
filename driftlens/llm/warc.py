"""Content-addressed WARC archive: payloads once by verified digest, headers apart, records rebuilt by joins."""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import salted, small, spread, written

#: A WARC file is closed once it holds so many compressed bytes.
FILE_BYTES = 256 << 20
_CRLF = b"\r\n"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in bare upper-case base32: five bytes are eight base-32 digits, which ``conv`` writes as 0-9A-V."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(row: Column) -> Column:
    h = F.md5(F.concat(F.lit("record:"), row.cast("string")))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _headers(df: DataFrame) -> DataFrame:
    """Exact header bytes of each record: the WARC block and, with a response, the HTTP head."""
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    # White space and control characters would break the header.
    uri = F.coalesce(F.regexp_replace("__url", r"[\x00-\x20\x7F]+", "%20"), F.lit("urn:none"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n")
    )
    revisit = F.col("record_type") == "revisit"
    warc = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("row"))),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", _record_id(F.col("owner_row"))),
            ),
        ).otherwise(F.lit("")),
        F.when(F.col("id").isNotNull(), line("X-Row-Key", F.col("id").cast("string"))).otherwise(F.lit("")),
        F.when(revisit & F.col("owner_id").isNotNull(), line("X-Refers-To-Key", F.col("owner_id").cast("string"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", (F.length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit("\r\n"),
    )
    return df.withColumn("header", F.encode(F.concat(warc, http), "UTF-8"))


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0
) -> None:
    """Write ``pages`` to ``path``: a table of payloads, one of headers, and WARC files that a manifest lists.

    Of equal payloads of at least ``min_bytes`` bytes the one with the smallest
    id (then the first row; null ids come last) is the response, the others
    revisit it; smaller payloads are all responses. Payloads are equal when
    their SHA-256, SHA-1 and length are, and each stored payload is checked
    against a second hash of all its copies. Null payloads count as empty,
    extra columns are left out, repeated rows are records of their own.
    """
    spark = pages.sparkSession
    payload = F.col(payload_col).cast("binary") if dict(pages.dtypes)[payload_col] == "binary" else F.encode(F.col(payload_col), "UTF-8")
    payload = F.coalesce(payload, F.lit(b""))
    sha256 = F.unhex(F.sha2(payload, 256))
    digests = written(
        pages.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("id"),
            F.col(url_col).cast("string").alias("__url"),
            F.octet_length(payload).cast("long").alias("bytes"),
            base32_sha1(payload).alias("sha1"),
            sha256.alias("sha256"),
        ),
        "digests",
    )
    owners = (
        digests.groupBy("sha256", "sha1", "bytes")
        .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("o"))
        .select("sha256", "sha1", "bytes", F.col("o.id").alias("owner_id"), F.col("o.row").alias("owner_row"))
    )
    owned = salted(digests, owners, ["sha256", "sha1", "bytes"])
    stores = F.col("owner_row") == F.col("row")
    typed = owned.withColumn("record_type", F.when(~stores & (F.col("bytes") >= min_bytes), "revisit").otherwise("response"))
    _headers(typed.withColumn("stores", stores)).select(
        "row", "id", "bytes", "sha1", "sha256", "record_type", "stores", "owner_id", "header"
    ).write.option("compression", "zstd").parquet(f"{path}/headers")
    # Copies are folded into one before the shuffle; the check hash tells a false match.
    stored = (
        pages.select(sha256.alias("sha256"), payload.alias("payload"))
        .withColumn("check", F.xxhash64("payload"))
        .groupBy("sha256")
        .agg(F.first("payload").alias("payload"), F.min("check").alias("c0"), F.max("check").alias("c1"))
        .select("sha256", F.when(F.col("c0") == F.col("c1"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads share a digest"))).alias("payload"))
    )
    heads = spark.read.parquet(f"{path}/headers").select("sha256", "header", "stores", "record_type")
    responses = heads.where("record_type = 'response'").join(stored, "sha256")
    revisits = heads.where("record_type = 'revisit'").withColumn("payload", F.lit(b""))
    # One pass, so one shuffle of payloads, makes both the files and the table of payloads.
    made = responses.unionByName(revisits).select("sha256", "header", "stores", "payload").mapInArrow(_writer(path), _MADE)
    made.write.option("compression", "zstd").parquet(f"{path}/store")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Each distinct payload once: ``sha256``, ``payload``."""
    return spark.read.parquet(f"{path}/store").where("file is null").select("sha256", "payload")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The archive's WARC files and their numbers of records."""
    return spark.read.parquet(f"{path}/store").where("file is not null").select("file", "records")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Rebuild the original records by joining headers to payloads: ``row``, ``id``, ``header``, ``payload``."""
    heads = spark.read.parquet(f"{path}/headers").select("row", "id", "header", "sha256")
    return salted(heads, payloads(spark, path), ["sha256"], "inner").select("row", "id", "header", "payload")


def _open(path: str, mode: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    if mode == "w":
        system.create_dir(at.rpartition("/")[0], recursive=True)
        return system.open_output_stream(at, compression=None)
    return system.open_input_stream(at, compression=None)


_MADE = "sha256 binary, payload binary, file string, records long"


def _writer(path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One gzip member per record. A retried task writes new files; only those in the manifest count."""
        out, name, size, n, made = None, "", 0, 0, []
        for batch in batches:
            for header, payload in zip(batch.column("header"), batch.column("payload")):
                if out is None:
                    name, size, n = f"{path}/warc/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = _open(name, "w")
                member = gzip.compress(header.as_py() + payload.as_py() + 2 * _CRLF, 1, mtime=0)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= FILE_BYTES:
                    out.close()
                    made.append((name, n))
                    out = None
            own = pa.Table.from_batches([batch]).filter(batch.column("stores")).select(["sha256", "payload"])
            yield from own.append_column("file", pa.nulls(len(own), pa.string())).append_column("records", pa.nulls(len(own), pa.int64())).to_batches()
        if out is not None:
            out.close()
            made.append((name, n))
        empty = pa.nulls(len(made), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [empty, empty, pa.array([f for f, _ in made], pa.string()), pa.array([k for _, k in made], pa.int64())], ["sha256", "payload", "file", "records"]
        )

    return write


def iter_records(stream) -> Iterator[tuple[dict, bytes]]:
    """Header fields and block of each record of a WARC stream of gzip members, one record in memory at a time."""
    rest = b""
    while True:
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            rest = rest or stream.read(1 << 20)
            if not rest:
                if parts:
                    raise EOFError("the last record is cut short")
                return
            parts.append(d.decompress(rest))
            rest = d.unused_data
        record = b"".join(parts)
        head, _, body = record.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record here")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        yield fields, body[: int(fields["Content-Length"])]


_READ = "id string, warc_type string, record_id string, refers_to_record string, refers_to string, uri string, digest string, payload_bytes long, payload binary"


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Parse the WARC files of an archive; digests and sizes of responses are taken from the bytes read."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        schema = pa.schema(
            [(n, pa.int64() if t == "long" else pa.binary() if t == "binary" else pa.string()) for n, t in (x.split() for x in _READ.split(", "))]
        )
        rows, held = [], 0
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with _open(name, "r") as stream:
                    for f, block in iter_records(stream):
                        body = block.partition(b"\r\n\r\n")[2]
                        own = f["WARC-Type"] == "response"
                        digest = base64.b32encode(hashlib.sha1(body).digest()).decode() if own else f["WARC-Payload-Digest"].removeprefix("sha1:")
                        if own and digest != f["WARC-Payload-Digest"].removeprefix("sha1:"):
                            raise ValueError(f"payload of {f['WARC-Record-ID']} doesn't match its digest")
                        rows.append(
                            (f.get("X-Row-Key"), f["WARC-Type"], f["WARC-Record-ID"], f.get("WARC-Refers-To"), f.get("X-Refers-To-Key"), f["WARC-Target-URI"], digest, len(body) if own else None, body if own and payloads else None)
                        )
                        held += len(body) if payloads else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    files = manifest(spark, path).select("file")
    return files.repartition(max(1, files.count())).mapInArrow(parse, _READ)


def archived(spark: SparkSession, path: str, id_col: str = "page_id", id_type: str = "bigint") -> DataFrame:
    """Per record of the WARC files: id, full payload's bytes and digest, type, and the id it refers to."""
    got = written(read_archive(spark, path, payloads=False).drop("payload"), "records")
    sizes = got.where("warc_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("payload_bytes").alias("__bytes"))
    hinted = small(sizes, 96)
    out = spread(got, sizes, ["refers_to_record"]) if hinted is sizes else got.join(hinted, ["refers_to_record"], "left")
    return out.select(
        F.col("id").cast(id_type).alias(id_col),
        F.coalesce("payload_bytes", "__bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.col("refers_to").cast(id_type).alias("refers_to"),
    )
