"""WARC archives: writing pages as segmented records, and putting them together again.

A page's HTTP response carries its body in chunked framing. Bodies above the
segment size become several records: the first names the target, continuation
records name the first by WARC-Segment-Origin-ID, count up WARC-Segment-Number, and
the last states WARC-Segment-Total-Length. A payload that another record already
holds is written as a revisit of it.

Archives are written by Spark's own text writer, with the blank lines that end a
record as its line separator, so whatever file system and committer the
cluster has are used and a lost executor leaves no half file. A file holds a
bounded number of records, and records are bounded by the segment size. Once the
job is committed its files get the ending .warc.

A response that revisits refer to has an identifier made from its page and payload, so the
revisits can name it without a look at its record.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendframe.llm.common import saved

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"

#: Bits that mark payloads held more than once, 16 MB: with more payloads marks only let more pages be looked up.
MARK_BITS = 1 << 27


def revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, digest, refers_to, single, target): page_ids whose payload several page_ids hold.

    refers_to is the largest of them, its own for that row itself; single says
    whether one row has it, target is its url. Only payloads of at least `least` bytes.
    Narrow: no payload is shuffled, and a digest shared by many rows is combined before it is.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    narrow = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.sha1(body).alias("digest"), F.octet_length(body).alias("n"), "url")
    narrow = narrow.where(F.col("n") >= least).groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("rows"), F.max("url").alias("url"))
    last = narrow.groupBy("digest").agg(F.max(F.struct("page_id", "rows", "url")).alias("held"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return narrow.join(last, "digest").select(
        "page_id", "digest", F.col("held.page_id").alias("refers_to"), (F.col("held.rows") == 1).alias("single"), F.col("held.url").alias("target")
    )


def _target(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), "[\\x00-\\x20]", "%20")


def _urn(name: uuid.UUID) -> str:
    return f"<urn:uuid:{name}>"


def _head(*fields: tuple[str, object]) -> bytes:
    lines = [VERSION, *(f"{name}: {value}" for name, value in fields if value is not None and value != ""), "", ""]
    return "\r\n".join(lines).encode()


def page_records(
    page_id: int | None, url: str, body: bytes, digest: str, refers_to: int | None, single: bool | None, target: str | None,
    segment: int, frame: int, date: str,
) -> Iterator[bytes]:
    """The records of a page, each cut from the block once: linear in the payload."""
    named = lambda page: uuid.uuid5(uuid.NAMESPACE_URL, f"{date}/{page}/{digest}")
    revisit = refers_to is not None and refers_to != page_id
    own = named(page_id) if single and page_id == refers_to else uuid.uuid4()
    block = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"]
    if not revisit:
        for at in range(0, len(body), frame):
            chunk = body[at : at + frame]
            block += [b"%x\r\n" % len(chunk), chunk, b"\r\n"]
        block.append(b"0\r\n\r\n")
    whole = memoryview(b"".join(block))
    many = len(whole) > segment
    for no, at in enumerate(range(0, len(whole), segment), 1):
        part = whole[at : at + segment]
        first, last = no == 1, at + segment >= len(whole)
        yield b"".join((
            _head(
                ("WARC-Type", "continuation" if not first else "revisit" if revisit else "response"),
                ("WARC-Record-ID", _urn(own if first else uuid.uuid5(own, str(no)))),
                ("WARC-Date", date),
                ("WARC-Target-URI", url),
                ("Content-Type", "application/http; msgtype=response" if first else None),
                ("WARC-Payload-Digest", f"sha1:{digest}" if first else None),
                ("WARC-Profile", REVISIT if first and revisit else None),
                ("WARC-Refers-To", _urn(named(refers_to)) if first and revisit and single else None),
                ("WARC-Refers-To-Target-URI", target if first and revisit else None),
                ("WARC-Refers-To-Date", date if first and revisit else None),
                ("X-Page-ID", page_id if first else None),
                ("X-Refers-To-Page-ID", refers_to if first and revisit else None),
                ("WARC-Segment-Number", no if many else None),
                ("WARC-Segment-Origin-ID", None if first else _urn(own)),
                ("WARC-Segment-Total-Length", len(whole) if many and last else None),
                ("Content-Length", len(part)),
            ),
            part,
        ))


_COLUMNS = ("page_id", "url", "html", "digest", "refers_to", "single", "target")


def records(pages: DataFrame, segment: int, frame: int, least: int, date: str) -> DataFrame:
    """(value): the records of `pages`, without the blank lines behind each."""
    again = saved(revisits(pages, least), "warc-revisits").withColumnRenamed("page_id", "__id").withColumnRenamed("digest", "__digest")
    spot = F.pmod(F.xxhash64(F.unhex("digest")), F.lit(MARK_BITS))
    marks = (
        again.select(F.pmod(F.xxhash64(F.unhex("__digest")), F.lit(MARK_BITS)).alias("s"))
        .groupBy(F.bitmap_bucket_number("s").alias("__bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("__bits"))
    )
    base = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        _target(F.col("url")).alias("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"),
    ).withColumn("digest", F.sha1("html"))
    # At most MARK_BITS / 8 bytes, whatever the input.
    base = base.join(F.broadcast(marks), F.bitmap_bucket_number(spot) == F.col("__bucket"), "left").withColumn("__at", F.bitmap_bit_position(spot))
    byte = F.expr("cast(conv(hex(substring(__bits, cast(__at div 8 as int) + 1, 1)), 16, 10) as int)")
    marked = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(__at % 8 as int))")) != 0, F.lit(False))
    own = ["page_id", "url", "html", "digest"]
    # Only pages whose payload may be held twice are looked up, and shuffled for it.
    looked_up = base.where(marked).select(*own)
    looked_up = looked_up.join(again, looked_up["page_id"].eqNullSafe(again["__id"]) & (looked_up["digest"] == again["__digest"]), "left")
    looked_up = looked_up.withColumn("target", _target(F.col("target"))).select(*_COLUMNS)
    alone = base.where(~marked).select(*own, F.lit(None).cast("bigint").alias("refers_to"), F.lit(None).cast("boolean").alias("single"), F.lit("").alias("target"))
    rows = looked_up.unionByName(alone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            columns = [batch.column(c) for c in _COLUMNS]
            for i in range(batch.num_rows):
                for record in page_records(*(c[i].as_py() for c in columns), segment, frame, date):
                    held.append(record)
                    size += len(record)
                    if size >= 1 << 23:
                        yield pa.record_batch([pa.array(held, pa.binary())], ["value"])
                        held, size = [], 0
        if held:
            yield pa.record_batch([pa.array(held, pa.binary())], ["value"])

    # A segment may end inside a character: the text writer takes the bytes as they are.
    return rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))


def _rename(paths: Iterator) -> None:
    from pyarrow import fs

    for row in paths:
        system, path = fs.FileSystem.from_uri(row.path)
        to = path.removesuffix(".txt") + ".warc"
        # An earlier attempt of this task may have come this far.
        if system.get_file_info(path).type != fs.FileType.NotFound or system.get_file_info(to).type == fs.FileType.NotFound:
            system.move(path, to)


def write_archives(
    pages: DataFrame, folder: str, segment: int = 65536, frame: int = 16384, least: int = 1000, per_file: int = 500, date: str | None = None
) -> None:
    """Writes `pages` (page_id, url, html) as WARC files of at most `per_file` records to a new folder.

    `segment` and `frame` are bytes. NULL html is an empty payload, a NULL url or page_id leaves its
    header out. `date` (UTC, default: now) is the records' WARC-Date. Of rows with equal payloads of at
    least `least` bytes those with the largest page_id are responses, repeated ones among them too,
    and the others revisit it: by WARC-Refers-To, target and date, or by target and date alone if
    that page_id has repeated rows with the payload. Other columns are ignored; no page gives no record.
    The folder must be one that pyarrow's file systems reach.
    """
    spark = pages.sparkSession
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    (
        records(pages, segment, frame, least, date)
        .write.option("lineSep", _END)
        .option("maxRecordsPerFile", per_file)
        .text(folder)
    )
    # The list is saved first: an attempt that runs again must not look for files already renamed.
    names = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path")
    saved(names, "warc-names").foreachPartition(_rename)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["record_id", "kind", "origin", "no", "total", "page_id", "refers_to", "digest", "part"]
    for batch in batches:
        for data in batch["content"]:
            data, at, out = bytes(data), 0, []
            while at < len(data):
                cut = data.index(b"\r\n\r\n", at)
                lines = data[at:cut].decode().split("\r\n")
                if lines[0] != VERSION:
                    raise ValueError(f"no record at byte {at}")
                h = dict(x.split(": ", 1) for x in lines[1:])
                size = int(h["Content-Length"])
                part = data[cut + 4 : cut + 4 + size]
                at = cut + 8 + size
                if len(part) != size or data[at - 4 : at] != b"\r\n\r\n":
                    raise ValueError(f"record {h['WARC-Record-ID']} is cut short")
                number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                origin = h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"])
                out.append(
                    (h["WARC-Record-ID"], h["WARC-Type"], origin, number("WARC-Segment-Number"), number("WARC-Segment-Total-Length"),
                     number("X-Page-ID"), number("X-Refers-To-Page-ID"), h.get("WARC-Payload-Digest"), part)
                )
            yield pd.DataFrame(out, columns=names).astype({"no": "Int64", "total": "Int64", "page_id": "Int64", "refers_to": "Int64"})


def dechunk(body: bytes) -> bytes:
    """The payload of a body in chunked framing."""
    out, at = [], 0
    while True:
        cut = body.index(b"\r\n", at)
        size = int(body[at:cut].partition(b";")[0], 16)
        if not size:
            return b"".join(out)
        chunk = body[cut + 2 : cut + 2 + size]
        at = cut + 4 + size
        if len(chunk) != size or body[at - 2 : at] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(chunk)


def _payload(parts: pd.Series) -> pd.Series:
    out = []
    for some in parts:
        block = b"".join(bytes(p["part"]) for p in some)
        head, _, body = block.partition(b"\r\n\r\n")
        chunked = b"\r\ntransfer-encoding: chunked" in head.lower()
        out.append((dechunk(body) if chunked else body) if body else None)
    return pd.Series(out)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page of the archives in `folder`: page_id, record_type, digest, refers_to, payload.

    Segments are grouped by the identifier of their first record, put in order
    of their numbers and checked for gaps and against the stated total length; a group is
    one page and bounded by it. The payload is decoded from chunked framing
    and checked against its digest; a revisit has none of its own. A record
    that breaks these rules stops the read. An empty folder gives an empty result.
    """
    parsed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.warc")
        .load(folder)
        .select("content")
        .mapInPandas(
            _parse,
            "record_id string, kind string, origin string, no bigint, total bigint, page_id bigint, refers_to bigint, digest string, part binary",
        )
    )
    cols = ["kind", "page_id", "refers_to", "digest"]
    whole = parsed.where("no IS NULL").select(*cols, F.array(F.struct("no", "part")).alias("parts"))
    grouped = (
        parsed.where("no IS NOT NULL")
        .groupBy("origin")
        .agg(
            F.sort_array(F.collect_list(F.struct("no", "part"))).alias("parts"),
            F.max("total").alias("total"),
            *[F.max(F.when(F.col("no") == 1, F.col(c))).alias(c) for c in cols],
        )
    )
    length = F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + F.octet_length(p["part"]))
    sound = (F.transform("parts", lambda p: p["no"]) == F.sequence(F.lit(1).cast("bigint"), F.size("parts").cast("bigint"))) & (
        length == F.col("total")
    )
    joined = grouped.where(F.coalesce(sound, F.lit(False)) | F.raise_error(F.concat(F.lit("segments missing of "), "origin")).isNull())
    rows = whole.unionByName(joined.select(*cols, "parts")).select(*cols, F.pandas_udf(_payload, "binary")("parts").alias("payload"))
    bare = F.regexp_replace("digest", "^sha1:", "")
    empty = F.when(F.col("kind") == "response", F.coalesce("payload", F.lit(b"")))
    return (
        rows.select("page_id", F.col("kind").alias("record_type"), bare.alias("digest"), "refers_to", empty.alias("payload"))
        .where(
            F.col("payload").isNull()
            | (F.sha1("payload") == F.col("digest"))
            | F.raise_error(F.concat(F.lit("payload differs from digest "), "digest")).isNull()
        )
    )


def digest(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of `read_archives`, revisits resolved."""
    read = read.withColumn("n", F.octet_length("payload").cast("bigint")).drop("payload")
    held = (
        read.where("record_type = 'response'")
        .select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), F.col("n").alias("__n"))
        .distinct()
    )
    return read.join(
        held, (read["refers_to"] == held["__id"]) & (read["digest"] == held["__digest"]), "left"
    ).select(
        "page_id",
        F.coalesce("n", "__n").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
