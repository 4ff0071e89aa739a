"""WARC archives with segmented, chunked records (op 2).

Writing: each page becomes an HTTP response in chunked transfer framing; blocks
over ``segment_bytes`` go on in continuation records. Pages whose payload an
earlier page_id has too become revisits. Spark's text writer puts records down
byte by byte, the WARC record end being its line separator, in plain files of
bounded size, wherever Spark can write. (Its gzip would make one member of a
file, where WARC readers expect one of each record; gzip files are read.)

Reading: files are parsed record by record by their declared length;
continuations are grouped by origin identifier, ordered by segment number,
checked against the total length and freed of the chunked framing.

Defined cases: a null html is an empty payload; a null page_id is a page of its
own; of repeated rows one is the response and the others revisit it; an empty
table gives no rows; extra columns are ignored; a record whose segments are
missing or do not add up, whose framing or digest is wrong, or that is itself cut off or
without length, type or end of its header, is read back with ``problem`` set
and a null payload, and the others of its file are read; a revisit whose response is lost or
broken stays, with ``problem`` set and a null size.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import shuffles_removed
from .common import shared_path, table, written

END = "\r\n\r\n"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
#: Of a payload that an earlier record has.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id string, type string, origin_id string, segment int, total_length long, refers_to string, page_id long, payload_digest string, block binary, problem string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is wrong or data are missing."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if len(body) < at + n + 2 or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk")
        out.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(kind: str, rid: str, page_id: int | None, captured: str, block: bytes, **fields: object) -> bytes:
    lines = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{rid}>\r\nWARC-Date: {captured}\r\nX-Page-ID: {'' if page_id is None else page_id}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block


def page_records(page_id: int | None, digest: str, copy: int, first: int | None, html: bytes, response: bool, url: str | None, captured: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response and its continuations."""
    rid = f"urn:page:{page_id}:{digest}:{copy}"
    b32 = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    uri = re.sub("[\x00-\x20\x7f]+", "", url or "") or f"urn:page:{page_id}"
    http = {"WARC_Target_URI": uri, "Content_Type": "application/http; msgtype=response", "WARC_Payload_Digest": b32}
    if not response:
        yield _record("revisit", rid, page_id, captured, HEAD, WARC_Refers_To=f"<urn:page:{first}:{digest}:1>", WARC_Profile=PROFILE, **http)
        return
    block = HEAD + chunked(html, chunk_bytes)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    several = len(parts) > 1
    yield _record("response", rid, page_id, captured, parts[0], **http, WARC_Segment_Number=1 if several else None)
    for k, p in enumerate(parts[1:], 2):
        yield _record("continuation", f"{rid}:{k}", page_id, captured, p, WARC_Target_URI=uri, WARC_Segment_Origin_ID=f"<{rid}>", WARC_Segment_Number=k, WARC_Segment_Total_Length=len(block) if k == len(parts) else None)


def packed(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with a binary column compressed, for a shuffle that carries it through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index(column)
            yield b.set_column(k, column, pa.array([zlib.compress(x.as_py(), 1) for x in b.column(k)], pa.binary()))

    return rows.mapInArrow(run, rows.schema)


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, segment_bytes: int = 1 << 14, chunk_bytes: int = 1 << 12, records_per_file: int = 2048, captured: str = "1970-01-01T00:00:00Z") -> None:
    """WARC files of ``pages`` (page_id, html, and url if there is one) under ``path``: at most records_per_file * segment_bytes bytes each, and headers.

    The pages are shuffled once, compressed: the lookup of shared payloads and the numbers
    of repeated rows use one partitioning.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    url = (F.col("url") if "url" in pages.columns else F.lit(None)).cast("string")
    # A null page_id is the empty string in the key, which no number is.
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), html.alias("html"), url.alias("url"))
    rows = named.withColumn("digest", F.sha1("html")).withColumn("key", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    keys = written(rows.select("page_id", "key", "digest", F.octet_length("html").alias("n")), "payloads")
    firsts = keys.where(F.col("n") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1")
    # Only payloads that several pages share are looked up, and without the payloads themselves.
    shared = keys.select("key", "digest").distinct().join(firsts.select("digest", "first"), "digest").select("key", "digest", "first", F.lit(True).alias("several"))
    marked = packed(rows, "html").join(written(shared, "shared-payloads"), ["key", "digest"], "left")
    copy = F.row_number().over(Window.partitionBy("key", "digest").orderBy(F.lit(0)))
    response = F.col("several").isNull() | (F.col("page_id").eqNullSafe(F.col("first")) & (F.col("copy") == 1))
    ready = marked.withColumn("copy", copy).select("page_id", "digest", "copy", "first", "html", response.alias("response"), "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, out, held = [b.column(k) for k in range(7)], [], 0
            for k in range(b.num_rows):
                for r in page_records(*(zlib.decompress(c[k].as_py()) if i == 4 else c[k].as_py() for i, c in enumerate(columns)), captured, segment_bytes, chunk_bytes):
                    out.append(r)
                    held += len(r)
                if held > 1 << 22 or k == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, held = [], 0

    records = ready.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    with shuffles_removed(pages.sparkSession):
        records.write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


def unpacked(data: bytes) -> bytes:
    """The bytes of a file of gzip members, up to where they break off; other files as they are."""
    plain = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        try:
            plain.append(d.decompress(data))
        except zlib.error:
            break
        data = d.unused_data
    return b"".join(plain) if plain else data


def parse(data: bytes) -> Iterator[dict]:
    """Records of one archive, by their declared lengths; a file may hold several gzip members.

    A record that cannot be read has a ``problem``: after one without a length the next
    one that begins behind an empty line is looked for, and nothing comes after one
    whose header does not end.
    """
    data, at = unpacked(data), 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").split("\r\n")[1:]
        f = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        bare = lambda k: f[k].strip("<>") if k in f else None
        whole = lambda k: int(f[k]) if re.fullmatch(r"-?[0-9]{1,18}", f.get(k, "")) else None
        n = whole("content-length")
        block = data[end + 4 : end + 4 + n] if end >= 0 and n is not None and n >= 0 else b""
        problem = "no end of header" if end < 0 else "no length" if n is None or n < 0 else "no type" if "warc-type" not in f else "cut off" if len(block) < n else None
        segment = whole("warc-segment-number")
        yield {
            "record_id": bare("warc-record-id"), "type": f.get("warc-type", ""), "origin_id": bare("warc-segment-origin-id"), "segment": segment if segment is None or abs(segment) < 1 << 31 else None, "total_length": whole("warc-segment-total-length"),
            "refers_to": bare("warc-refers-to"), "page_id": whole("x-page-id"), "payload_digest": re.sub("^sha1:", "", f.get("warc-payload-digest", "")) or None, "block": block, "problem": problem,
        }
        if end < 0:
            return
        if problem == "no length":
            at = data.find(b"\r\n\r\nWARC/1.", end)
            if at < 0:
                return
        else:
            at = end + 4 + n


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record, continuations included."""
    files = spark.read.format("binaryFile").load(path).select("content")
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        for b in batches:
            for content in b.column(0):
                block: list[dict] = []
                for r in parse(content.as_py()):
                    block.append(r)
                    if len(block) == 256:
                        yield pa.RecordBatch.from_pylist(block, schema)
                        block = []
                yield pa.RecordBatch.from_pylist(block, schema)

    return files.mapInArrow(run, RECORDS)


def reassembled(records: DataFrame) -> DataFrame:
    """(record_id, page_id, type, refers_to, payload_digest, blocks, problem): records with the blocks of their segments in order.

    Records of one segment need no shuffle. Others are grouped by origin
    identifier; a group is the segments of one record.
    """
    names = ["record_id", "page_id", "type", "refers_to", "payload_digest"]
    alone = records.where("segment is null and origin_id is null").select(*names, F.array("block").alias("blocks"), "problem")
    parts = records.where("segment is not null or origin_id is not null")
    only = lambda c: F.max(F.when(F.col("origin_id").isNull(), F.col(c)))
    joined = parts.groupBy(F.coalesce("origin_id", "record_id").alias("record_id")).agg(
        *[only(c).alias(c) for c in names[1:]], F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("s"), F.max("total_length").alias("total"), F.max("problem").alias("broken")
    )
    length = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"]))
    gapless = F.forall(F.transform("s", lambda x, k: x["segment"] == k + 1), lambda x: x)
    checked = joined.withColumn("problem", F.when(F.col("broken").isNotNull(), F.col("broken")).when(F.col("type").isNull(), "no first segment").when(~gapless, "segment missing").when(~length.eqNullSafe(F.col("total")), "total length"))
    return alone.unionByName(checked.select(*names, F.col("s.block").alias("blocks"), "problem"))


def payloads(records: DataFrame) -> DataFrame:
    """(record_id, page_id, type, refers_to, payload, payload_bytes, payload_digest, problem) with framing decoded and digests verified; null payloads for revisits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for b in batches:
            data, digests, problems = [], [], []
            for kind, blocks, digest, problem in zip(*(b.column(k) for k in (2, 4, 5, 6)), strict=True):
                kind, digest, problem, got = kind.as_py(), digest.as_py(), problem.as_py(), None
                if problem is None and kind != "revisit":
                    try:
                        got = payload_of(b"".join(blocks.as_py()))
                        problem = None if digest in (None, base32_sha1(got)) else "digest"
                    except ValueError:
                        problem = "framing"
                data.append(got if problem is None else None)
                digests.append(digest or (base32_sha1(got) if got is not None else None))
                problems.append(problem)
            sizes = [None if x is None else len(x) for x in data]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), b.column(3), pa.array(data, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(problems, pa.string())],
                ["record_id", "page_id", "type", "refers_to", "payload", "payload_bytes", "payload_digest", "problem"],
            )

    shaped = reassembled(records).select("record_id", "page_id", "type", "refers_to", "blocks", "payload_digest", "problem")
    return shaped.mapInArrow(run, "record_id string, page_id long, type string, refers_to string, payload binary, payload_bytes long, payload_digest string, problem string")


def resolved(read: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, problem): revisits get the size of the response they refer to."""
    facts = written(read.drop("payload"), "warc-records")
    base = facts.where("type <> 'revisit'")
    target = base.where("problem is null").select(F.col("record_id").alias("t"), F.col("page_id").alias("refers"), F.col("payload_bytes").alias("n"))
    again = facts.where("type = 'revisit'").join(target, F.col("refers_to") == F.col("t"), "left")
    lost = F.coalesce("problem", F.when(F.col("t").isNull(), "no response"))
    return base.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "problem").unionByName(
        again.select("page_id", F.col("n").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), F.col("refers").alias("refers_to"), lost.alias("problem"))
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path, min_revisit_bytes=0)
    return resolved(payloads(read_archives(spark, path))).drop("problem")


ORACLE = {
    "op2_warc": """
with p as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h from pages),
d as (select h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (k // 4) * 5 + 1, 5))::bigint >> (15 - 5 * (k % 4))) & 31)::int, 1), '' order by k) as b32
      from (select distinct h from p), range(32) r(k) group by h)
select page_id, octet_length(encode(t))::bigint as payload_bytes, b32 as payload_digest,
       case when page_id = min(page_id) over (partition by t) then 'response' else 'revisit' end as record_type,
       case when page_id <> min(page_id) over (partition by t) then min(page_id) over (partition by t) end as refers_to
from p join d using (h)
""",
}
QUERIES = {"op2_warc": op2_warc}
