"""WARC (9): transaction assembly.

``write_archives`` writes a request, a response (or revisit) and a metadata record per capture as
gzip text files whose line separator ends the records, so any file system Spark knows can hold
them. ``read_records`` streams the records back, one at a time, and ``assemble`` joins request and
metadata records to their response through ``WARC-Concurrent-To``: one nested row per capture.

Edge cases: a null payload is an empty one. Rows with equal payloads refer to the one with the
smallest id; all rows with that id (repeated rows) are responses, and where every id is null all
are responses. A null url leaves ``WARC-Target-URI`` out. A payload may hold anything, record
heads included, as lengths and not marks end a record. A record that ends early is returned with
``truncated`` set. An empty table gives no archives and no captures. Other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from korvane.session import materialize

HEAD = "WARC/1.1\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FLUSH_BYTES = 4 << 20


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    digits = F.sha1(payload)
    out = []
    for group in range(8):
        value = F.conv(F.substring(digits, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substr(F.lit(ALPHABET), F.shiftright(value, shift).bitwiseAND(31) + 1,
                                F.lit(1)))
    return F.concat(*out)


def _record_id(kind: str, ident: Column) -> Column:
    return F.concat(F.lit(f"<urn:capture:{kind}"), F.coalesce(
        F.concat(F.lit(":"), F.url_encode(ident.cast("string"))), F.lit("")), F.lit(">"))


def capture_of(record_id: Column) -> Column:
    """The capture's id in a record id that ``write_archives`` made; null if it had none."""
    return F.url_decode(F.nullif(F.regexp_extract(record_id, r"^<urn:capture:\w+:(.*)>$", 1),
                                 F.lit("")))


def _record(kind: Column, ident: Column, heads: list[Column], block: Column) -> Column:
    """Version, head lines, empty line, block and its line end; the writer adds the second."""
    lines = [F.concat(F.lit("WARC-Type: "), kind, F.lit("\r\n")),
             F.concat(F.lit("WARC-Record-ID: "), ident, F.lit("\r\n")), *heads,
             F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"),
                      F.lit("\r\n\r\n"))]
    return F.concat(F.lit(HEAD), *lines, block, F.lit("\r\n"))


def _head(name: str, value: Column) -> Column:
    """A head line; none for a null value."""
    clean = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", date: str = "1970-01-01T00:00:00Z",
                   min_bytes: int = 0, records_per_file: int = 60_000) -> None:
    """Write the archives of all rows below ``path``.

    The table of repeated digests is written first, so that the join with it is a plain one
    between two exchanges, where a digest that a third of the rows share is split.
    """
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                     F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("body"))
    p = p.withColumn("digest", base32_sha1(F.col("body")))
    first = (p.filter(F.octet_length("body") >= min_bytes).groupBy("digest")
             .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
             .filter((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first"))
    p = p.join(materialize(first, "warc-first"), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    when = _head("WARC-Date", F.lit(date))
    target = _head("WARC-Target-URI", F.col("url"))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    response = _record_id("response", F.col("id"))
    together = _head("WARC-Concurrent-To", response)
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("body").cast("string"), F.lit("\r\n\r\n"),
        F.when(again, F.lit("")).otherwise(F.col("body").cast("string")))
    request = F.concat(F.lit("GET "), F.coalesce(F.regexp_replace("url", r"[\r\n\s]", "%20"),
                                                 F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n"))
    refers = F.when(again, F.concat(
        _head("WARC-Refers-To", _record_id("response", F.col("first"))),
        _head("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit(""))
    records = F.array(
        _record(F.lit("request"), _record_id("request", F.col("id")),
                [when, target, together,
                 F.lit("Content-Type: application/http; msgtype=request\r\n")], request),
        _record(kind, response,
                [when, target, _head("WARC-Payload-Digest",
                                     F.concat(F.lit("sha1:"), F.col("digest"))), refers,
                 F.lit("Content-Type: application/http; msgtype=response\r\n")], http),
        _record(F.lit("metadata"), _record_id("metadata", F.col("id")),
                [when, target, together, F.lit("Content-Type: application/warc-fields\r\n")],
                F.concat(F.lit("payload-bytes: "), F.octet_length("body").cast("string"),
                         F.lit("\r\n"))))
    (p.select(F.explode(records).alias("value")).write.option("lineSep", "\r\n")
     .option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))


RECORD = ("file string, record_id string, record_type string, concurrent_to array<string>, "
          "refers_to string, target_uri string, digest string, http_bytes long, "
          "payload binary, truncated boolean")
ARROW = pa.schema([("file", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()),
                   ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()),
                   ("target_uri", pa.string()), ("digest", pa.string()), ("http_bytes", pa.int64()),
                   ("payload", pa.binary()), ("truncated", pa.bool_())])


def _fields(head: bytes) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            found.setdefault(name.strip().lower().decode("latin-1"), []).append(
                value.strip().decode("utf-8", "replace"))
    return found


def _row(file: str, fields: dict, block: bytes, truncated: bool) -> tuple:
    def one(name):
        return fields.get(name, [None])[0]

    kind, http_bytes = one("warc-type"), None
    if kind in ("response", "revisit"):
        head, _, block = block.partition(b"\r\n\r\n")
        length = _fields(head).get("content-length", [""])[0]
        http_bytes = int(length) if length.isdigit() else None
    digest = one("warc-payload-digest")
    return (file, one("warc-record-id"), kind, fields.get("warc-concurrent-to", []),
            one("warc-refers-to"), one("warc-target-uri"),
            digest.removeprefix("sha1:") if digest else None, http_bytes, block, truncated)


def _records(segments):
    """(file, text between two heads) in file order to record rows.

    A segment shorter than its record's length was cut at a head inside the block, so the next
    one is put back behind it.
    """
    mark = HEAD.encode()
    open_file, fields, parts, need = None, None, [], 0
    for file, segment in segments:
        if fields is not None and file != open_file:
            yield _row(open_file, fields, b"".join(parts), True)
            fields = None
        if fields is None:
            head, end, block = segment.partition(b"\r\n\r\n")
            found = _fields(head) if end else {}
            length = found.get("content-length", [""])[0]
            if not length.isdigit():
                continue
            open_file, fields, parts, need = file, found, [block], int(length) - len(block)
        else:
            parts += [mark, segment]
            need -= len(mark) + len(segment)
        if need <= 0:
            block = b"".join(parts)
            yield _row(file, fields, block[:len(block) + need], False)
            fields = None
    if fields is not None:
        yield _row(open_file, fields, b"".join(parts), True)


def _parse(batches):
    def segments():
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

    rows, size = [], 0

    def flush():
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)

    for row in _records(segments()):
        rows.append(row)
        size += len(row[8]) + 500
        if size > FLUSH_BYTES:
            yield flush()
            rows, size = [], 0
    if rows:
        yield flush()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of gzip archives; such a file is never split, so its records come in order."""
    lines = spark.read.option("lineSep", HEAD).text(path)
    return lines.select(F.input_file_name().alias("file"), F.col("value").cast("binary")) \
        .mapInArrow(_parse, RECORD)


def assemble(records: DataFrame, carried=("payload",)) -> DataFrame:
    """One nested row per response or revisit, with its request and metadata records.

    ``carried`` names what of the response travels through the join: its payload, or what was
    derived from it before.

    ``WARC-Concurrent-To`` may stand on either side, and metadata may name the request instead
    of the response. Of several requests (or metadata records) of a capture the smallest id counts.
    """
    main = records.filter(F.col("record_type").isin("response", "revisit")).select(
        "record_id", "record_type", "concurrent_to", "target_uri", "refers_to", "digest",
        "http_bytes", "truncated", *carried)
    side = records.filter(F.col("record_type").isin("request", "metadata"))
    links = side.select(F.col("record_id").alias("side_id"), "record_type",
                        F.explode("concurrent_to").alias("main_id"))
    back = main.select(F.explode("concurrent_to").alias("side_id"),
                       F.col("record_id").alias("main_id"))
    reverse = back.join(side.select(F.col("record_id").alias("side_id"), "record_type"), "side_id")
    links = links.unionByName(reverse).distinct()
    requests = links.filter("record_type = 'request'")
    through = (links.filter("record_type = 'metadata'")
               .select("side_id", "record_type", F.col("main_id").alias("request_id"))
               .join(requests.select(F.col("side_id").alias("request_id"), "main_id"),
                     "request_id").drop("request_id"))
    links = links.unionByName(through)
    nested = side.select(F.col("record_id").alias("side_id"), F.struct(
        "record_id", F.col("payload").cast("string").alias("block")).alias("record"))
    found = (links.join(nested, "side_id").groupBy("main_id")
             .agg(F.min(F.when(F.col("record_type") == "request", F.col("record"))).alias("request"),
                  F.min(F.when(F.col("record_type") == "metadata", F.col("record")))
                  .alias("metadata")))
    found = materialize(found, "warc-sides")
    return main.join(found.withColumnRenamed("main_id", "record_id"), "record_id", "left") \
        .select(F.col("record_id").alias("capture_id"), "record_type", "target_uri", "refers_to",
                "digest", "http_bytes", *carried, "request",
                "metadata", "truncated")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('{ALPHABET}',
        ((('0x' || substr(hex, ((i // 4) * 5 + 1)::INT, 5))::INT
          >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
    CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit'
        END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN g USING (hex)"""
