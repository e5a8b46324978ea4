"""WARC archives: write captures, read them back, and assemble transactions.

Each page becomes a request, a response or revisit, and a metadata record; the
request and the metadata name the response in WARC-Concurrent-To. Records are
text rows whose line separator is the record terminator, so Spark's own text
writer, with its commit protocol, makes gzip archives; their number follows the
records' bytes. Archives are read whole (they are bounded) and cut by
Content-Length, never by looking for separators. A record may name several
others as concurrent. Which captures it leads to, by way of however many other
records, is found on ids alone; the records then meet by capture and make one
nested row. Responses and revisits are captures themselves and join nothing.

Edge cases: null html is an empty payload; null urls are empty; among equal
payloads of at least 1000 bytes the largest page_id holds the response (for a
repeated page_id the rows are equal or ordered by url, and each row is a
capture of its own); a null page_id loses against any other; a capture without
some record has null there, further records of a kind are in ``more``; a record
that leads to several captures is in each; records that lead to no capture make
one under the id where their chain ends (of a ring, its smallest). Extra columns
are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.common import materialize, scratch_path, table

REVISIT_MIN = 1000
#: Bytes of an archive before compression, about; a larger single record has one of its own.
ARCHIVE_BYTES = 16 << 20
#: Bytes of a capture's three records besides the payload and the url, which each of them names.
HEAD_BYTES = 1500
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "rec_id string, type string, concurrent_to array<string>, page_id long, uri string, date string, refers_to string, digest string, bytes long, computed string, payload binary"


def _uuid(*parts) -> F.Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def captures(pages: DataFrame, archives: int) -> DataFrame:
    """Rows of pages with cap (an id of the row), payload length, SHA-1, revisit, first_cap and refers_to, dealt to archives.

    Which row holds a payload is found on digests alone; the payloads are then
    shuffled once, to the archive that they are written to.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumn("sha1", F.sha1("html")).withColumn("bytes", F.octet_length("html").cast("long"))
    rows = rows.withColumn("cap", _uuid(F.lit("capture"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "url", "sha1"))
    large = rows.filter(F.col("bytes") >= REVISIT_MIN).select("page_id", "sha1", "bytes", "cap")
    most = large.groupBy("sha1", "bytes").agg(F.max(F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", "cap")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = large.join(most, ["sha1", "bytes"]).filter(F.col("cap") != F.col("first.cap"))
    again = again.select("cap", F.col("first.page_id").alias("refers_to"), F.col("first.cap").alias("first_cap")).distinct()
    out = rows.repartition(archives, "cap").join(again.repartition(archives, "cap"), "cap", "left")
    return out.withColumn("revisit", F.col("first_cap").isNotNull())


def _record(type_: F.Column, rec: F.Column, concurrent: F.Column | None, headers: list, body: F.Column) -> F.Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), type_), F.concat(F.lit("WARC-Record-ID: "), rec), F.lit("WARC-Date: 2024-01-01T00:00:00Z")]
    if concurrent is not None:
        lines.append(F.concat(F.lit("WARC-Concurrent-To: "), concurrent))
    lines += [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), body)


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of all pages below path."""
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long") + 4 * F.coalesce(F.octet_length("url"), F.lit(0)) + HEAD_BYTES
    total = pages.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    rows = captures(pages, max(1, -(-int(total) // archive_bytes)))
    page, uri = F.col("page_id").cast("string"), F.when(F.col("url") != "", F.regexp_replace("url", "[\r\n]+", "%0A"))
    req, meta = _uuid(F.lit("request"), "cap"), _uuid(F.lit("metadata"), "cap")
    common = [("WARC-Target-URI", uri), ("X-Page-ID", page)]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1")))
    refer = [("WARC-Refers-To", F.col("first_cap")), ("WARC-Profile", F.when(F.col("revisit"), F.lit(PROFILE)))]
    body = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html"))
    response = _record(F.when(F.col("revisit"), "revisit").otherwise("response"), F.col("cap"), None, [*common, digest, *refer, ("Content-Type", F.lit("text/html; charset=utf-8"))], body)
    request = _record(F.lit("request"), req, F.col("cap"), [*common, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")))
    metadata = _record(F.lit("metadata"), meta, req, [*common, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string"), F.lit("\r\n")))
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").text(path)


def parse(content: bytes) -> Iterator[tuple[dict[str, list[str]], memoryview]]:
    """Headers (lower-case names, all values of each) and block of each record of an archive."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    view, at = memoryview(data), 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            raise ValueError(f"record header without end at byte {at}")
        lines = data[at:stop].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head: dict[str, list[str]] = {}
        for k, _, v in (x.partition(":") for x in lines[1:]):
            head.setdefault(k.strip().lower(), []).append(v.strip())
        size = int(head["content-length"][0])
        if stop + 4 + size > len(data):
            raise ValueError(f"record cut short at byte {at}")
        yield head, view[stop + 4 : stop + 4 + size]
        at = stop + 4 + size
        while data[at : at + 2] == b"\r\n":
            at += 2


def _hex_sha1(value: str | None) -> str | None:
    """Bare hex of a payload digest, which archives give in hex or base 32."""
    value = (value or "").rpartition(":")[2]
    return (base64.b32decode(value).hex() if len(value) == 32 else value.lower()) or None


def _reader(payloads: bool):
    schema = pa.schema([("rec_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("page_id", pa.int64()), ("uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("bytes", pa.int64()), ("computed", pa.string()), ("payload", pa.binary())])

    def flush(rows):
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows, held = [], 0
                for head, block in parse(batch.column(0)[k].as_py()):
                    one = lambda name, head=head: head.get(name, [None])[0]
                    page, type_ = one("x-page-id"), one("warc-type")
                    rows.append({
                        "rec_id": one("warc-record-id"), "type": type_, "concurrent_to": head.get("warc-concurrent-to"), "page_id": int(page) if page else None,
                        "uri": one("warc-target-uri"), "date": one("warc-date"), "refers_to": one("warc-refers-to"), "digest": _hex_sha1(one("warc-payload-digest")),
                        "bytes": len(block), "computed": hashlib.sha1(block).hexdigest() if type_ == "response" else None, "payload": bytes(block) if payloads else None,
                    })
                    held += len(block) if payloads else 0
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield flush(rows)
                        rows, held = [], 0
                if rows:
                    yield flush(rows)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_reader(payloads), RECORD)


def captures_of(records: DataFrame) -> DataFrame:
    """rec_id and capture_id of all records that name others as concurrent: the captures that these lead to, or the ends of their chains.

    Ids only, one step of all chains a round; rounds end when no step reaches a new record.
    """
    is_main = F.col("type").isin("response", "revisit")
    main = records.filter(is_main & F.col("rec_id").isNotNull()).select(F.col("rec_id").alias("to"), F.lit(True).alias("main")).distinct()
    steps = records.filter(~is_main & F.col("rec_id").isNotNull()).select("rec_id", F.explode("concurrent_to").alias("to")).filter("to is not null").distinct()
    steps = materialize(steps.join(main, "to", "left").select("rec_id", "to", F.coalesce("main", F.lit(False)).alias("main")), "steps")
    onward = steps.select(F.col("rec_id").alias("via"), F.col("to").alias("further"), F.col("main").alias("at_main"))
    known = now = steps
    while True:
        after = now.filter("not main").join(onward, F.col("to") == F.col("via")).select("rec_id", F.col("further").alias("to"), F.col("at_main").alias("main")).distinct()
        now = materialize(after.join(known, ["rec_id", "to"], "left_anti").select("rec_id", "to", "main"), "steps")
        if now.isEmpty():
            break
        known = known.unionByName(now)
    led = known.filter("main").select("rec_id", F.col("to").alias("capture_id"))
    lost = materialize(known.groupBy("rec_id").agg(F.bool_or("main").alias("main")).filter("not main").select("rec_id"), "lost")
    if lost.isEmpty():
        return led
    # ends of chains: places without a step of their own; in a ring all places have one
    stuck = known.join(lost, "rec_id", "left_semi")
    ends = stuck.join(steps.select(F.col("rec_id").alias("to")).distinct(), "to", "left_anti").select("rec_id", F.col("to").alias("end"))
    least = stuck.select("rec_id", F.least("rec_id", "to").alias("low"))
    stuck = least.join(ends, "rec_id", "left").groupBy("rec_id").agg(F.coalesce(F.min("end"), F.min("low")).alias("capture_id"))
    return led.unionByName(stuck)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture_id, the structs response, request and metadata, more (array of all further records) and n_main.

    ``records`` is read several times, of which all but one need its ids only.
    """
    is_main = F.col("type").isin("response", "revisit")
    others = F.coalesce(~is_main, F.lit(True))
    rec = F.struct(*[c for c in records.columns if c != "concurrent_to"])
    alone = records.filter(is_main).select(F.col("rec_id").alias("capture_id"), rec.alias("rec"))
    to = captures_of(records).withColumnRenamed("rec_id", "__r")
    led = records.filter(others & (F.size("concurrent_to") > 0) & F.col("rec_id").isNotNull()).join(to, F.col("rec_id") == F.col("__r"), "left")
    led = led.select(F.coalesce("capture_id", "rec_id").alias("capture_id"), rec.alias("rec"))
    # without an id a record can't be led by others, but it leads to what it names first
    free = records.filter(others & (F.coalesce(F.size("concurrent_to"), F.lit(0)) <= 0) | others & F.col("rec_id").isNull())
    free = free.select(F.coalesce("rec_id", F.get("concurrent_to", F.lit(0))).alias("capture_id"), rec.alias("rec"))
    kind = F.when(F.col("rec.type").isin("response", "revisit"), "response").otherwise(F.col("rec.type"))
    rows = alone.unionByName(led).unionByName(free).select("capture_id", "rec", kind.alias("kind"))
    made = rows.groupBy("capture_id").agg(F.sort_array(F.collect_list(F.struct("kind", "rec"))).alias("recs"))
    of = lambda name: F.filter("recs", lambda x: x["kind"] == name)
    first = [F.get(of(name), F.lit(0))["rec"].alias(name) for name in ("response", "request", "metadata")]
    more = F.concat(*[F.slice(of(name), 2, F.greatest(F.size(of(name)) - 1, F.lit(0))) for name in ("response", "request", "metadata")], F.filter("recs", lambda x: ~F.coalesce(x["kind"].isin("response", "request", "metadata"), F.lit(False))))
    return made.select("capture_id", *first, F.transform(more, lambda x: x["rec"]).alias("more"), F.when(F.size(of("response")) > 0, F.size(of("response"))).cast("long").alias("n_main"))


def transactions(spark: SparkSession, pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Write the pages' archives, read them back, and assemble their captures."""
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    return assemble(materialize(read_archives(spark, path, payloads), "records"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    caps = materialize(transactions(spark, pages, payloads=False), "captures")
    full = caps.filter("response.type = 'response'").select(F.col("capture_id").alias("__id"), F.col("response.bytes").alias("n"), F.col("response.computed").alias("sha"), F.col("response.page_id").alias("page"))
    out = caps.join(full, F.coalesce("response.refers_to", "capture_id") == F.col("__id"), "left")
    revisit = F.col("response.type") == "revisit"
    row = F.struct(F.col("response.page_id").alias("page_id"), F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_digest"), F.col("response.type").alias("record_type"), F.when(revisit, F.col("page")).alias("refers_to"))
    return out.filter("response is not null").select(F.explode(F.array_repeat(row, F.col("n_main").cast("int"))).alias("r")).select("r.*")


QUERIES = {"op9_warc": op9_warc}
ORACLES = {
    "op9_warc": f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages),
m as (select d, n, max(page_id) as page from p where n >= {REVISIT_MIN} group by d, n)
select p.page_id, cast(p.n as bigint) as payload_bytes, p.d as payload_digest, case when m.page is null or m.page = p.page_id then 'response' else 'revisit' end as record_type,
 case when m.page <> p.page_id then m.page end as refers_to from p left join m on m.d = p.d and m.n = p.n"""
}
