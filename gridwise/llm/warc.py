"""WARC archives as chunked record tables.

A record's payload becomes rows of record identifier and chunk number; each row carries the digest of the payload so
far. Spark's text writer stores one archive record per row (payloads of several chunks use the format's segments:
a first record and ``continuation`` records), and its text reader splits archives at record boundaries, so neither
side holds a whole archive, nor a whole payload besides its input row.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, scratch

#: Bytes of payload in a record at most.
CHUNK = 64 << 10
#: The reader takes this for the boundary of two records; the writer ends a chunk inside it where a payload holds it.
BOUNDARY = b"\r\n\r\nWARC/1.1\r\n"
_END = "\r\n\r\n"
#: Rows of one payload digest go to this many partitions at least.
SALTS = 64
#: Bytes of chunks in an Arrow batch, about.
FLUSH = 8 << 20
_BOUNDARY = re.compile(re.escape(BOUNDARY))
#: Payloads with copies that are sent to every task at most (about 100 bytes each); more go by a shuffle.
FEW = 100_000
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digest: Column) -> Column:
    """Base 32 of a SHA-1 in hexadecimal digits: each five of these are four base-32 digits."""
    five = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substr(hex_digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    digit = lambda n, shift: F.substr(F.lit(_BASE32), F.shiftright(n, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.array_join(F.transform(five, lambda n: F.concat(*(digit(n, s) for s in (15, 10, 5, 0)))), "")


def chunks(payload: bytes | memoryview, size: int = CHUNK) -> Iterator[memoryview]:
    """Pieces of at most size bytes, one at least; no BOUNDARY lies whole in a piece."""
    view, at = memoryview(payload), 0
    while True:
        end = min(at + size, len(view))
        if hit := _BOUNDARY.search(view, at, end):
            end = hit.start() + len(_END) + 2
        yield view[at:end]
        at = end
        if at >= len(view):
            return


def typed(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, sha1, n_bytes, refers_to): refers_to is the page whose response a revisit refers to.

    Of pages with equal payloads of at least ``least`` bytes, the largest page_id is the response; smaller payloads are
    all responses. Up to FEW payloads that have copies are sent to every task, so that no payload is shuffled. Beyond,
    rows of one digest are dealt over SALTS partitions, and the counts meet them there. Rows with a null page_id are
    responses; if all rows of a payload have none, no row refers to another.
    """
    # The digest is worked out before the exchange and once more for the counts; the payload crosses it once.
    own = pages.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("n_bytes", F.octet_length("html").cast("long"))
    first = own.where(F.col("n_bytes") >= least).groupBy("sha1", "n_bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialize(first.select(F.col("sha1").alias("s"), F.col("n_bytes").alias("b"), "first"), "copies")
    refers_to = F.when(F.col("page_id") < F.col("first"), F.col("first")).alias("refers_to")
    if first.count() <= FEW:
        joined = own.join(F.broadcast(first), (F.col("sha1") == F.col("s")) & (F.col("n_bytes") == F.col("b")), "left")
        return joined.select("page_id", "url", "html", "sha1", "n_bytes", refers_to)
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))
    spread = first.select("s", "b", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt_"))
    joined = own.withColumn("salt", salt).join(spread, (F.col("sha1") == F.col("s")) & (F.col("n_bytes") == F.col("b")) & (F.col("salt") == F.col("salt_")), "left")
    return joined.select("page_id", "url", "html", "sha1", "n_bytes", refers_to)


def chunk_table(pages: DataFrame, chunk: int = CHUNK, least: int = 0) -> DataFrame:
    """(record_id, chunk_no, last, page_id, url, refers_to, n_bytes, digest, data) of the pages (page_id, url, html).

    A null html is empty. A revisit has one chunk without data. digest: base-32 SHA-1 of the payload up to and with this
    chunk. n_bytes: of the payload up to and with this chunk. Rows with the same page_id, or with none, are records of
    their own. Other columns are dropped, whatever their names. An empty table gives no rows.
    """
    bounded_batches(pages.sparkSession)
    names = ["record_id", "chunk_no", "last", "page_id", "url", "refers_to", "n_bytes", "digest", "data"]
    out = pa.schema(list(zip(names, [pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()], strict=True)))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        rows, held = [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
        for b in it:
            page_id, url, html, sha1, n_bytes, refers_to = b.columns
            for i in range(b.num_rows):
                n += 1
                record = f"{page_id[i].as_py()}-{part}-{n}"
                about = (page_id[i].as_py(), url[i].as_py(), refers_to[i].as_py())
                if about[2] is not None:
                    rows.append((record, 1, True, *about, n_bytes[i].as_py(), base64.b32encode(bytes.fromhex(sha1[i].as_py())).decode(), b""))
                    continue
                # A view of the row's own bytes; only chunks are copied.
                payload, done, digest = memoryview(html[i].as_buffer()), 0, hashlib.sha1(usedforsecurity=False)
                for k, piece in enumerate(chunks(payload, chunk)):
                    digest.update(piece)
                    done += len(piece)
                    rows.append((record, k + 1, done == len(payload), *about, done, base64.b32encode(digest.digest()).decode(), bytes(piece)))
                    held += len(piece)
                    if held >= FLUSH:
                        yield flush()
                        rows, held = [], 0
            if rows:
                yield flush()
                rows, held = [], 0

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    return typed(rows, least).mapInArrow(batches, "record_id string, chunk_no int, last boolean, page_id long, url string, refers_to long, n_bytes long, digest string, data binary")


def write_archives(table: DataFrame, path: str, compression: str = "gzip") -> None:
    """One archive a partition. Control characters and blanks in a URL are percent-encoded, so they can't break a header."""
    header = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")
    urn = lambda c: F.concat(F.lit("<urn:gridwise:"), c, F.lit(">"))
    segment = F.when(~(F.col("last") & (F.col("chunk_no") == 1)), F.col("chunk_no"))
    safe = F.regexp_replace(F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), r"[\x00-\x20\x7f]", "%20")
    kind = F.when(F.col("chunk_no") > 1, "continuation").when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", kind),
        header("WARC-Record-ID", urn(F.concat_ws("-", "record_id", "chunk_no"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        header("WARC-Target-URI", safe),
        header("WARC-Segment-Origin-ID", F.when(F.col("chunk_no") > 1, urn(F.concat(F.col("record_id"), F.lit("-1"))))),
        header("WARC-Segment-Number", segment),
        header("WARC-Segment-Total-Length", F.when(F.col("last") & (F.col("chunk_no") > 1), F.col("n_bytes"))),
        header("WARC-Payload-Digest", F.when(F.col("last"), F.concat(F.lit("sha1:"), F.col("digest")))),
        header("Content-Type", F.when(F.col("refers_to").isNull() & (F.col("chunk_no") == 1), F.lit("text/html"))),
        header("WARC-Profile", F.when(F.col("refers_to").isNotNull(), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        header("X-Page-ID", F.col("page_id")),
        header("X-Digest-So-Far", F.col("digest")),
        header("X-Refers-To-Page", F.col("refers_to")),
        header("X-Payload-Length", F.col("n_bytes")),
        header("Content-Length", F.octet_length("data")),
        F.lit("\r\n"),
        F.col("data").cast("string"),
    )
    table.select(record.alias("value")).write.option("lineSep", _END).option("compression", compression).text(path)


class Damaged(ValueError):
    """An archive record that breaks the format's rules."""


_HEADER = re.compile(rb"^([A-Za-z-]+): (.*)$")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record without its final blank lines."""
    head, found, block = record.removeprefix(b"WARC/1.1\r\n").partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n"):
        m = _HEADER.match(line)
        if not m:
            raise Damaged(f"no header: {line[:80]!r}")
        fields[m[1].decode()] = m[2].decode()
    length = fields.get("Content-Length", "")
    if not found or not length.isdecimal():
        raise Damaged(f"no length: Content-Length is {length!r}")
    block = block.removesuffix(b"\r\n\r\n") if len(block) == int(length) + 4 else block
    if len(block) != int(length):
        raise Damaged(f"{len(block)} bytes; Content-Length is {length}")
    return fields, block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, chunk_no, last, page_id, refers_to, n_bytes, digest, data) of the archives' records, as chunk_table has them."""
    bounded_batches(spark)
    lines = spark.read.option("lineSep", BOUNDARY.decode()).text(path).select(F.col("value").cast("binary").alias("value"))
    names = ["record_id", "chunk_no", "last", "page_id", "refers_to", "n_bytes", "digest", "data"]
    out = pa.schema(list(zip(names, [pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()], strict=True)))

    def whole(value: str | None) -> int | None:
        return None if value is None else int(value)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for v in b.column(0):
                f, block = parse(v.as_py())
                record, _, no = f["WARC-Record-ID"].removeprefix("<urn:gridwise:").removesuffix(">").rpartition("-")
                rows.append((record, int(no), "WARC-Payload-Digest" in f, whole(f.get("X-Page-ID")), whole(f.get("X-Refers-To-Page")), int(f["X-Payload-Length"]), f["X-Digest-So-Far"], block))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out)], schema=out)

    return lines.mapInArrow(batches, "record_id string, chunk_no int, last boolean, page_id long, refers_to long, n_bytes long, digest string, data binary")


def verify(chunks_read: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, refers_to) per record, worked out from the chunks that were read.

    Records of one chunk are checked where they are. The chunks of others meet by record in the order of their numbers,
    and a digest runs over them one at a time. A digest or a length that doesn't agree raises. A revisit has those of
    its own headers.
    """
    alone = (F.col("chunk_no") == 1) & F.col("last")
    own = F.when(F.col("refers_to").isNotNull(), F.col("digest")).otherwise(base32(F.sha1("data")))
    size = F.when(F.col("refers_to").isNotNull(), F.col("n_bytes")).otherwise(F.octet_length("data").cast("long"))
    fine = lambda df: df.withColumn("payload_digest", F.when((F.col("got") == F.col("digest")) & (F.col("size") == F.col("n_bytes")), F.col("got")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id")))))
    single = fine(chunks_read.where(alone).withColumn("got", own).withColumn("size", size))
    out = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("got", pa.string()), ("size", pa.int64())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, no, size, digest = None, 0, 0, hashlib.sha1(usedforsecurity=False)
        for b in it:
            rows = []
            for r in b.to_pylist():
                if r["record_id"] != record:
                    record, no, size, digest = r["record_id"], 0, 0, hashlib.sha1(usedforsecurity=False)
                no += 1
                if r["chunk_no"] != no:
                    raise Damaged(f"record {record} lacks chunk {no}")
                digest.update(r["data"])
                size += len(r["data"])
                got = base64.b32encode(digest.digest()).decode()
                if got != r["digest"]:
                    raise Damaged(f"wrong digest at chunk {no} of record {record}")
                if r["last"]:
                    rows.append((record, r["page_id"], r["n_bytes"], r["digest"], got, size))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out)], schema=out)

    parts = chunks_read.where(~alone).repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    many = fine(parts.mapInArrow(batches, "record_id string, page_id long, n_bytes long, digest string, got string, size long"))
    take = lambda df, refers_to: df.select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", refers_to.alias("refers_to"))
    return take(single, F.col("refers_to")).unionByName(take(many, F.lit(None).cast("long")))


def archive(pages: DataFrame, path: str | None = None, chunk: int = CHUNK, compression: str = "gzip") -> DataFrame:
    """Write the pages to archives at path (in the shared folder where none is given), read them back and verify them."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archives(chunk_table(pages, chunk), path, compression)
    return verify(read_archives(spark, path))
