"""Operator 11, WARC archives and an external merge of their capture index.

``write_archives`` writes one WARC/1.1 record per page with Spark's text sink:
a record is one row, and the two line ends that close a record are the line
separator.  Of pages with equal payloads (equal SHA-256 of the bytes) the first
one is a ``response``, all others are ``revisit`` records that refer to it and
carry no payload.  Archives of about ``ARCHIVE_BYTES`` are kept small enough to
be read as one value each.

``read_archives`` parses archives by their Content-Length fields, checks every
payload against its digest, and leaves one index run per archive, sorted by URL
key (host labels reversed) and time of capture.  ``merge_runs`` is the external
merge: the runs lie in the shared folder, ranges of the key are dealt to tasks,
and each task merges the parts of all runs that fall into its range with a
loser tree; ranges follow one another, so the index is in global order by
(``range``, ``place``).  A range holds about ``RANGE_ROWS`` captures whatever the
key: one URL's history may take several.

Defined results: a null html is an empty payload; a null url has no target
field and the key ``""``; line ends inside a url are percent-encoded; among equal
payloads the smallest page_id is the response, null ids come last, and rows that
repeat a page_id are told apart by a row number (the pages are then written once
with it); payloads below ``least_bytes`` are all responses.  Pages have no time of
capture: ``captured`` (epoch seconds) is a parameter and derived from page_id
where it is not given.  Bytes that stand for a record inside a payload are payload.
A damaged archive raises.  An empty table gives no archive and an empty
index.  Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm.common import NO_ID, ids_tell_rows, lean, numbered, query, scratch, settings, sized, staged, table

#: Bytes of an archive (one longer record makes a longer archive) and captures of a range of the index.
ARCHIVE_BYTES, RANGE_ROWS = 16 << 20, 100_000
#: A payload that more than one in so many pages has is hot: its group is joined by a broadcast of at most so many rows.
HOT_SHARE = 1000
CRLF = "\r\n"
#: FIXED VALUES: of the WARC format and of base32.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Epoch second of a capture without a time of its own: this plus its page_id.
FIRST_SECOND = 1_700_000_000


def base32_of_hex(hexed: Column) -> Column:
    """Base32 of 20 bytes given as 40 hex digits: five digits make four characters."""
    fives = F.array(*[F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)])
    letters = lambda v: F.concat(*[F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])
    return F.array_join(F.transform(fives, letters), "")


def _utc(seconds: Column) -> Column:
    """ISO time of epoch seconds, whatever the session's time zone."""
    day = F.floor(seconds / 86400).cast("int")
    rest = F.pmod(seconds, F.lit(86400)).cast("int")
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    clock = F.concat_ws(":", two(rest / 3600), two(F.pmod(rest, F.lit(3600)) / 60), two(F.pmod(rest, F.lit(60))))
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string"), F.lit("T"), clock, F.lit("Z"))


def payloads(pages: DataFrame, captured: Column | None = None) -> DataFrame:
    """page_id, row, url, payload, size, same (SHA-256), sha1, second; ``row`` tells rows of one page_id apart."""
    second = F.col("captured_at") if captured is not None else F.lit(FIRST_SECOND) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000))
    own = [captured.cast("long").alias("captured_at")] if captured is not None else []
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", *own)
    row = F.lit(0).cast("long")
    if not ids_tell_rows(rows.select(F.col("page_id").alias("doc_id"))):
        rows, name = numbered(rows)
        row = F.col(name)
    rows = rows.select("page_id", row.alias("row"), "url", F.coalesce("html", F.lit("")).alias("payload"), second.cast("long").alias("second"))
    raw = F.col("payload").cast("binary")
    return rows.select("*", F.octet_length("payload").cast("long").alias("size"), F.unhex(F.sha2(raw, 256)).alias("same"), F.sha1(raw).alias("sha1"))


def _first() -> Column:
    return F.struct(F.coalesce("page_id", F.lit(NO_ID)).alias("page"), F.col("row"))


def _with_first(rows: DataFrame, least_bytes: int) -> tuple[DataFrame, int]:
    """rows with ``first`` (of the group of equal payloads, null where none is shared), and the
    most payload bytes of a partition.  Only digests are grouped; payloads are shuffled only when the
    shared digests are too many for a broadcast, and then hot ones are joined by one all the same."""
    narrow = staged(rows.select("same", _first().alias("at"), "size", F.spark_partition_id().alias("part")), "warc-digests")
    most, n = narrow.groupBy("part").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).agg(F.max("size"), F.sum("n")).first()
    groups = narrow.filter(F.col("size") >= least_bytes).groupBy(F.col("same").alias("shared")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = staged(groups, "warc-shared")
    small = sized(groups)
    if small is not groups:
        return rows.join(small.drop("n"), F.col("same") == F.col("shared"), "left").drop("shared"), int(most or 0)
    often = F.broadcast(groups.filter(F.col("n") * HOT_SHARE > n).select(F.col("shared").alias("hot"), F.col("first").alias("hot_first")))
    rows = rows.join(often, F.col("same") == F.col("hot"), "left")
    key = F.when(F.col("hot").isNull(), F.col("same")).otherwise(F.xxhash64("page_id", "row").cast("string").cast("binary"))  # spread: matches nothing
    rows = rows.withColumn("dealt", key).join(groups.drop("n"), F.col("dealt") == F.col("shared"), "left")
    return rows.withColumn("first", F.coalesce("hot_first", "first")).drop("hot", "hot_first", "shared", "dealt"), int(most or 0)


def _urn(page: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(":"), row.cast("string"), F.lit(">"))


def _record() -> Column:
    """The record of a row of ``_with_first``, without the two line ends that close it."""
    revisit = F.col("first").isNotNull() & (F.col("first") != _first())
    http = F.concat(F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=UTF-8", "Content-Length: "])), F.col("size").cast("string"), F.lit(CRLF * 2))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.coalesce("page_id", F.lit(NO_ID)), F.col("row"))),
        F.concat(F.lit("WARC-Date: "), _utc(F.col("second"))),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("sha1"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("first.page"), F.col("first.row")))),
        F.when(revisit, F.lit("WARC-Profile: " + PROFILE)),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    )
    return F.concat(head, F.lit(CRLF * 2), http, F.when(revisit, "").otherwise(F.col("payload")))


def write_archives(pages: DataFrame, path: str, captured: Column | None = None, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of all pages under the new folder ``path``."""
    rows, most = _with_first(payloads(pages, captured), least_bytes)
    each = max(1, -(-most // archive_bytes))  # archives of a task
    out = rows.select(_record().alias("value"), F.pmod(F.xxhash64("page_id", "row"), F.lit(each)).cast("int").alias("archive"))
    out.write.option("lineSep", CRLF * 2).partitionBy("archive").text(path)


def records(raw: bytes) -> Iterator[tuple[int, int, dict[bytes, bytes], bytes]]:
    """Offset, length (without the closing line ends), fields and block of each record of an archive."""
    at, close = 0, b"\r\n\r\n"
    while at < len(raw):
        end = raw.find(close, at)
        lines = raw[at:end].split(b"\r\n") if end >= 0 else [b""]
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(b": ", 1) for x in lines[1:])
        stop = end + 4 + int(fields[b"Content-Length"])
        if raw[stop : stop + 4] != close:
            raise ValueError(f"the record at byte {at} is cut")
        yield at, stop - at, fields, raw[end + 4 : stop]
        at = stop + 4


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then port, path and query; no scheme or fragment."""
    if url is None:
        return ""
    rest = url.split("://", 1)[-1].split("#", 1)[0].lower()
    cut = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    host, colon, port = rest[:cut].rpartition("@")[2].partition(":")
    return ",".join(reversed(host.split("."))) + colon + port + ")" + rest[cut:]


RUN = (
    "url_key string, second long, page long, row long, url string, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long, archive string, offset long, length long, seq long"
)


def _named(urn: bytes | None) -> tuple[int, int] | None:
    return None if urn is None else tuple(int(x) for x in urn[10:-1].split(b":"))


def index_run(archive: str, raw: bytes) -> pd.DataFrame:
    """The sorted index run of one archive."""
    rows = []
    for at, length, fields, block in records(raw):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(http.rpartition(b"Content-Length: ")[2])
        kind, digest = fields[b"WARC-Type"].decode(), fields[b"WARC-Payload-Digest"].decode().partition(":")[2]
        if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"the payload at byte {at} of {archive} differs from its digest")
        url = fields[b"WARC-Target-URI"].decode() if b"WARC-Target-URI" in fields else None
        second = int(pd.Timestamp(fields[b"WARC-Date"].decode()).timestamp())
        page, row = _named(fields[b"WARC-Record-ID"])
        to = _named(fields.get(b"WARC-Refers-To"))
        rows.append((url_key(url), second, page, row, url, kind, size, digest, None if to is None or to[0] == NO_ID else to[0], archive, at, length))
    rows.sort(key=lambda r: r[:4])
    out = pd.DataFrame([(*r, i) for i, r in enumerate(rows)], columns=[c.split()[0] for c in RUN.split(", ")])
    return out.astype({"refers_to": "Int64"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One sorted run for each archive under ``path``; staged."""

    @lean
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive, raw in zip(b["path"], b["content"]):
                yield index_run(archive, bytes(raw))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    out, at = files.mapInPandas(parse, RUN), scratch(spark, "capture-runs")
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}):  # one archive at a time in a worker
        out.write.parquet(at)
    return spark.read.schema(out.schema).parquet(at)


def loser_tree(runs: list[list]) -> Iterator[tuple[int, int]]:
    """(run, place) of every entry of the sorted runs, by key, equal keys by run.  An inner node keeps
    the loser of the match below it, so the next entry costs one match a level."""
    k = len(runs)
    place = [0] * k
    heads = [(False, r[0]) if r else (True,) for r in runs]
    losers: list[int | None] = [None] * k
    for run in range(k):
        winner: int | None = run
        node = (run + k) // 2
        while node and winner is not None:
            other = losers[node]
            if other is None or (heads[other], other) < (heads[winner], winner):
                losers[node], winner = winner, other
            node //= 2
        if winner is not None:
            losers[0] = winner
    while k and len(heads[losers[0]]) == 2:
        winner = losers[0]
        yield winner, place[winner]
        place[winner] += 1
        heads[winner] = (False, runs[winner][place[winner]]) if place[winner] < len(runs[winner]) else (True,)
        node = (winner + k) // 2
        while node:
            other = losers[node]
            if (heads[other], other) < (heads[winner], winner):
                losers[node], winner = winner, other
            node //= 2
        losers[0] = winner


INDEX = RUN.removesuffix(", seq long") + ", range int, place long"


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in global order by (range, place)."""
    ranges = max(1, -(-runs.count() // range_rows))

    @lean
    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        got = [b for b in batches if len(b)]
        if not got:
            return
        part = pd.concat(got, ignore_index=True)
        del got
        starts = (part["archive"] != part["archive"].shift()).to_numpy().nonzero()[0].tolist()
        keys = list(zip(part["url_key"], part["second"], part["page"], part["row"]))
        cuts = [*starts, len(part)]
        order = [starts[run] + i for run, i in loser_tree([keys[a:z] for a, z in zip(cuts, cuts[1:])])]
        out = part.drop(columns="seq").iloc[order].assign(range=TaskContext.get().partitionId(), place=range(len(order)))
        for at in range(0, len(out), 10_000):
            yield out.iloc[at : at + 10_000].astype({"refers_to": "Int64"})

    dealt = runs.repartitionByRange(ranges, "url_key", "second", "page", "row").sortWithinPartitions("archive", "seq")
    return dealt.mapInPandas(merge, INDEX)


def capture_index(pages: DataFrame, path: str | None = None, captured: Column | None = None, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Write the archives of ``pages`` (to a new folder of the shared one unless ``path`` names one),
    read them back, and merge their runs: url_key, second, page_id, url, record_type, payload_bytes,
    payload_digest, refers_to, archive, offset, length, range, place."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archives(pages, path, captured, least_bytes, archive_bytes)
    index = merge_runs(read_archives(spark, path), range_rows)
    return index.withColumn("page_id", F.when(F.col("page") != NO_ID, F.col("page"))).drop("page", "row")


def histories(index: DataFrame) -> DataFrame:
    """One row per URL key: captures, first and last second, distinct payloads."""
    return index.groupBy("url_key").agg(
        F.count(F.lit(1)).alias("captures"), F.min("second").alias("first_second"), F.max("second").alias("last_second"), F.count_distinct("payload_digest").alias("payloads")
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
     f AS (SELECT *, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id) AS first_id FROM p),
     d AS (SELECT *, list_transform(generate_series(0, 7), lambda i: CAST('0x' || substr(hex, 5 * i + 1, 5) AS INTEGER)) AS fives FROM f)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(fives, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""


@query(SQL)
def op11_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_index(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
