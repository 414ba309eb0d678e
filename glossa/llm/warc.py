"""Operator 13: WARC archives in which a payload is stored once.

Headers only (key, address, size, SHA-1 of the payload) are shuffled by the
payload's digest. Of records with equal payloads of at least ``min_bytes`` the
one with the largest key is the original, the others become ``revisit`` records
that name it (``WARC-Refers-To``) and carry no payload. Then every record is
written with fresh headers: WARC/1.1, the block is an HTTP response, a revisit's
block the HTTP header alone. Records are text rows with two line ends as
separator, written by Spark's text writer: any file system, a lost task is
written again, one archive for each task (dealt by record, about
:data:`ARCHIVE_BYTES` each; compressed as a whole file if a codec is given).

Reading goes by Content-Length, record by record, over archives as Spark reads
them; payloads are hashed and measured again. Revisit records are joined to the
responses that they name, which gives their payload's size and digest (or the
payload itself).

A digest or a name that more than one in :data:`HOT_SHARE` of the rows carry
can only be one of fewer than that many: these rows are broadcast, so that a
payload shared by a third of all records is not joined in one task.

Defined results: null payload counts as empty; rows that repeat key, address
and payload are one record; a null key is the smallest; of several records with
the largest key one is the original, always the same; a null address has no
WARC-Target-URI; blanks, control and non-ASCII characters of an address
are written percent-encoded and read back so; payloads may hold anything, WARC
records too; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.llm.common import landed
from glossa.session import scratch_path

ARCHIVE_BYTES = 32 << 20
HOT_SHARE = 1 << 16
SEPARATOR = "\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def joined_by(rows: DataFrame, side: DataFrame, key: str, n_rows: int) -> DataFrame:
    """``rows`` left join ``side``, which has one row a ``key`` and in ``times``
    how many rows carry it. Keys of more than ``n_rows / HOT_SHARE`` rows are
    fewer than :data:`HOT_SHARE` and are broadcast; no other key is large."""
    hot = F.col("times") * HOT_SHARE > n_rows
    often = side.where(hot).drop("times")
    found = rows.join(F.broadcast(often), key)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(side.where(~hot).drop("times"), key, "left")
    return found.unionByName(rest)


def record_id(key: Column, url: Column, digest: Column) -> Column:
    """A stable identifier: MD5 of key, digest and address, nulls marked."""
    return F.md5(F.concat_ws("|", *[F.when(c.isNull(), F.lit("-")).otherwise(
        F.concat(F.lit("="), c.cast("string"))) for c in (key, digest, url)]).cast("binary"))


def with_ids(df: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """``(rid, key, url, n, digest, payload)`` of each row."""
    rows = df.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"),
                     F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    return rows.select(record_id(F.col("key"), F.col("url"), F.col("digest")).alias("rid"), "key", "url",
                       F.octet_length("payload").cast("long").alias("n"), "digest", "payload")


def revisits(headers: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``(rid, refers_rid, refers_url)`` of the records of ``headers(rid, key,
    url, n, digest)`` whose payload another one keeps."""
    large = headers.where(F.col("n") >= min_bytes)
    shared = large.groupBy("digest").agg(F.count(F.lit(1)).alias("times"), F.max(F.struct("key", "rid", "url")).alias("first")).where("times > 1")
    shared = landed(shared.select("digest", "times", F.col("first.rid").alias("refers_rid"), F.col("first.url").alias("refers_url")),
                    "warc-shared")
    met = joined_by(large.select("rid", "digest"), shared, "digest", large.count())
    return met.where(F.col("refers_rid") != F.col("rid")).select("rid", "refers_rid", "refers_url")


def _plain(text: Column, kept: str) -> Column:
    """Percent-encoded but for the characters of the class ``kept``."""
    each = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(kept), c).when(c == " ", F.lit("%20")).otherwise(F.url_encode(c)))
    return F.when(text.rlike(f"^{kept}*$"), text).otherwise(F.array_join(each, ""))


def _uri(rid: Column) -> Column:
    parts = [F.substring(rid, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def records(rows: DataFrame, date: str = DATE) -> DataFrame:
    """One text ``value`` for each of ``rows(rid, key, url, n, digest, payload,
    refers_rid, refers_url)``: WARC header, HTTP header and, but for revisits,
    the payload."""
    again = F.col("refers_rid").isNotNull()

    def line(name: str, value: Column, where: Column | None = None) -> Column:
        out = F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
        return F.coalesce(out if where is None else F.when(where, out), F.lit(""))

    address = "[!-~]"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("n").cast("string"), F.lit(SEPARATOR))
    size = F.octet_length(http) + F.when(again, 0).otherwise(F.col("n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _uri(F.col("rid"))), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _plain(F.col("url"), address)), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", F.lit(PROFILE), again), line("WARC-Refers-To", _uri(F.col("refers_rid")), again),
        line("WARC-Refers-To-Target-URI", _plain(F.col("refers_url"), address), again),
        line("X-Record-Key", _plain(F.col("key").cast("string"), "[!-$&-~]")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", size.cast("string")))
    return rows.select(F.concat(head, F.lit("\r\n"), http, F.when(again, "").otherwise(F.col("payload"))).alias("value"))


def write_archives(df: DataFrame, key: str, url: str, payload: str, path: str | None = None, min_bytes: int = 1000,
                   codec: str = "gzip") -> str:
    """Write the records of ``df`` as archives under ``path`` (a fresh folder
    beside the checkpoints by default), each large payload once; the path."""
    path = path or scratch_path(df.sparkSession, "warc")
    rows = with_ids(df, key, url, payload)
    headers = landed(rows.drop("payload").distinct(), "warc-headers")
    again = landed(revisits(headers, min_bytes), "warc-revisits")
    kept = headers.join(again, "rid", "left_anti").agg(F.sum("n")).first()[0] or 0
    dealt = rows.repartition(int(kept // ARCHIVE_BYTES) + 1, "rid")
    # repeated rows stand side by side after the sort that the join needs as well
    first = F.lag("rid").over(Window.partitionBy("rid").orderBy("rid")).isNull()
    once = dealt.withColumn("first", first).where("first").drop("first")
    records(once.join(again, "rid", "left")).write.option("lineSep", SEPARATOR).option("compression", codec).text(path)
    return path


def inflated(content: bytes) -> bytes:
    """An archive's bytes; gzip members, one or one a record, are decompressed."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(wbits=31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Header fields (lower-case names) and block of each record, by Content-Length."""
    view, at = memoryview(archive), 0
    while at < len(archive):
        stop = archive.index(b"\r\n\r\n", at)
        version, *lines = bytes(view[at:stop]).decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}: {version[:40]!r}")
        fields = {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
        at = stop + 4 + int(fields["content-length"])
        if archive[at:at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record of {fields.get('warc-record-id')} does not end where its Content-Length says")
        yield fields, view[stop + 4:at]
        at += 4


_READ = pa.schema([("rid", pa.string()), ("record_type", pa.string()), ("key", pa.string()), ("url", pa.string()),
                   ("refers_rid", pa.string()), ("declared", pa.string()), ("n", pa.int64()), ("digest", pa.string()),
                   ("payload", pa.large_binary())])


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """``(rid, record_type, key, url, refers_rid, declared, n, digest[,
    payload])`` of every record under ``path``: ``declared`` is the digest in
    the header, ``n`` and ``digest`` are of the payload that stands there."""
    names = _READ.names if with_payload else _READ.names[:-1]

    def rid(uri: str | None) -> str | None:
        return uri and uri.removeprefix("<urn:uuid:").removesuffix(">").replace("-", "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import unquote

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, block in parse(inflated(content.as_py())):
                    body = block
                    if fields["content-type"].startswith("application/http"):
                        body = block[bytes(block).index(b"\r\n\r\n") + 4:]
                    key = fields.get("x-record-key")
                    rows.append({"rid": rid(fields["warc-record-id"]), "record_type": fields["warc-type"],
                                 "key": key and unquote(key), "url": fields.get("warc-target-uri"),
                                 "refers_rid": rid(fields.get("warc-refers-to")),
                                 "declared": fields.get("warc-payload-digest", "").removeprefix("sha1:"),
                                 "n": len(body), "digest": hashlib.sha1(body).hexdigest(),
                                 "payload": bytes(body) if with_payload else None})
                    held += len(body) if with_payload else 256
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _READ).select(names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _READ).select(names)

    kinds = {"n": "long", "payload": "binary"}
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))


def resolved(found: DataFrame) -> DataFrame:
    """``read_archives`` with each revisit's ``n``, ``digest`` (and payload) of
    the response that it names, that record's key as ``refers_key``, and
    ``intact``: the payload has the digest that the record's own header states
    (false if no such response is there)."""
    whole = [c for c in ("n", "digest", "payload") if c in found.columns]
    again, there = found.where("record_type = 'revisit'"), found.where("record_type <> 'revisit'")
    times = again.groupBy("refers_rid").agg(F.count(F.lit(1)).alias("times"))
    side = there.select(F.col("rid").alias("refers_rid"), F.col("key").alias("refers_key"), *whole).join(times, "refers_rid")
    side = landed(side, "warc-originals")
    out = joined_by(again.drop(*whole), side, "refers_rid", again.count())
    out = out.unionByName(there.withColumn("refers_key", F.lit(None).cast("string")))
    return out.withColumn("intact", F.coalesce(F.col("digest") == F.col("declared"), F.lit(False)))
