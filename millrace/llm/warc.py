"""WARC archives: writing, reading back, and an external merge of their index.

A task writes its records, each a gzip member, to one file; what Spark's text writer puts between rows is an empty gzip member,
so a file is a valid sequence of members, on any store that Spark knows. Reading a file back gives one run of captures, sorted
by URL key and time. The runs, written as a table, are dealt to ranges of (URL key, time, page) of a bounded number of captures,
however many a site or a URL has, and each range merges its shares of the runs with a loser tree, so the ranges in order are one
globally ordered history of captures.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, partitions, table, text_steps

#: Payloads of at least so many bytes are compared; smaller ones are always stored.
LEAST_PAYLOAD = 0
#: Captures have no time of their own in `pages`: the page's number of seconds after this.
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
#: Payload bytes that an archive is meant to hold before compression, and captures that a range is meant to merge.
ARCHIVE_BYTES = 128 << 20
RANGE_CAPTURES = 50_000
EMPTY_MEMBER = gzip.compress(b"", mtime=0)

CAPTURE = "run bigint, url_key string, captured timestamp_ntz, page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, filename string, offset bigint, length bigint"
_KINDS = (("run", pa.int64()), ("url_key", pa.string()), ("captured", pa.timestamp("us")), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("filename", pa.string()), ("offset", pa.int64()), ("length", pa.int64()))


def url_key(url: str) -> str:
    """Host labels from the last to the first, then path and query, in lower case: captures of a site sort together."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, refers_url: str | None) -> bytes:
    """One record with its closing blank lines, as a gzip member."""
    name = "none" if page_id is None else str(page_id)
    time = (EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:millrace:page:{name}>", f"WARC-Date: {time}", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is None:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
        head.append("Content-Type: application/http; msgtype=response")
    else:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:millrace:page:{refers_to}>", f"WARC-Refers-To-Target-URI: {' '.join((refers_url or '').split())}", "Content-Type: application/http; msgtype=response"]
    head.append(f"Content-Length: {len(body)}")
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    return gzip.compress(raw, compresslevel=1, mtime=0)


def members(raw: bytes):
    """(offset, length, content) of the gzip members that hold anything."""
    at = 0
    while at < len(raw):
        one = zlib.decompressobj(31)
        content = one.decompress(raw[at:] if len(raw) - at < 1 << 16 else raw[at : at + (1 << 16)])
        fed = min(len(raw), at + (1 << 16))
        while not one.eof and fed < len(raw):
            content += one.decompress(raw[fed : fed + (1 << 16)])
            fed = min(len(raw), fed + (1 << 16))
        if not one.eof:
            raise ValueError("a record is cut short")
        end = fed - len(one.unused_data)
        if content:
            yield at, end - at, content
        at = end


def parse(content: bytes) -> dict:
    """A record's named fields, by lower-case name, and its payload (None for a revisit)."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    fields["payload"] = body.partition(b"\r\n\r\n")[2] if fields["warc-type"] == "response" else None
    return fields


def _page(urn: str | None) -> int | None:
    name = (urn or "").rpartition(":")[2].rstrip(">")
    return int(name) if name and name != "none" else None


def _write(batches):
    for batch in batches:
        for step in text_steps(batch, "html"):
            rows = zip(*(step.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "refers_url")), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([record(p, u or "", (h or "").encode(), r, ru) for p, u, h, r, ru in rows], pa.binary())], names=["record"])


def write_archives(pages: DataFrame, path: str, least: int = LEAST_PAYLOAD) -> None:
    """Write a record per page. Of equal payloads of at least `least` bytes the smallest page_id is the response, the others revisit it."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha2(html, 256).alias("mark"))
    marks = table(rows.select("page_id", "url", "mark", F.octet_length("html").alias("size")), "warc-marks")
    first = marks.where((F.col("size") >= least) & F.col("page_id").isNotNull()).groupBy("mark").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = marks.join(first, "mark").where(F.col("page_id") != F.col("first.page_id")).select("page_id", "mark", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")).distinct()
    payload = marks.agg(F.sum("size")).first()[0] or 0
    dealt = rows.repartition(max(partitions(pages), -(-payload // ARCHIVE_BYTES)), "page_id", "mark")
    records = dealt.join(again, ["page_id", "mark"], "left").mapInArrow(_write, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def _read(batches):
    for batch in batches:
        for name, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            run, rows = zlib.crc32(name.encode()), []
            for offset, length, content in members(raw.as_py()):
                f = parse(content)
                url, time = f["warc-target-uri"], datetime.strptime(f["warc-date"], "%Y-%m-%dT%H:%M:%SZ")
                stored = f["payload"]
                size = int(f["x-payload-length"]) if stored is None else len(stored)
                sha1 = f["warc-payload-digest"].removeprefix("sha1:") if stored is None else digest(stored)
                rows.append((run, url_key(url), time, _page(f["warc-record-id"]), url, size, sha1, f["warc-type"], _page(f.get("warc-refers-to")), name.rpartition("/")[2], offset, length))
            rows.sort(key=capture_order)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=[n for n, _ in _KINDS])


def capture_order(row: tuple) -> tuple:
    """URL key, time, page; a page without id comes first."""
    return row[1], row[2], row[3] is not None, row[3] or 0


class LoserTree:
    """Merges sorted runs: each inner node holds the loser of its match, so a step replays one path of log2(k) matches."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.at = [0] * self.k
        self.heads = [key(r[0]) if r else None for r in runs]
        self.nodes = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._seat(leaf)

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[b] is None:
            return True
        return self.heads[a] is not None and (self.heads[a], a) < (self.heads[b], b)

    def _seat(self, leaf: int) -> None:
        """While the tree is filled: stop at the first node without an opponent; the last leaf plays through to the root."""
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.nodes[node] < 0:
                self.nodes[node] = winner
                return
            if self._beats(self.nodes[node], winner):
                self.nodes[node], winner = winner, self.nodes[node]
            node //= 2
        self.nodes[0] = winner

    def __iter__(self):
        while self.k and self.heads[winner := self.nodes[0]] is not None:
            yield self.runs[winner][self.at[winner]]
            self.at[winner] += 1
            run = self.runs[winner]
            self.heads[winner] = self.key(run[self.at[winner]]) if self.at[winner] < len(run) else None
            node = (winner + self.k) // 2
            while node > 0:
                if self._beats(self.nodes[node], winner):
                    self.nodes[node], winner = winner, self.nodes[node]
                node //= 2
            self.nodes[0] = winner


def ascending_runs(batches) -> list[list[tuple]]:
    """The rows as they come, cut into runs in capture order: each block of an archive's run is one, and is not sorted again."""
    runs: list[list[tuple]] = []
    open_run: dict[int, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held = open_run.get(row[0])
            if held is None or capture_order(held[-1]) > capture_order(row):
                held = open_run[row[0]] = []
                runs.append(held)
            held.append(row)
    return runs


def _merge(batches):
    out = []
    for row in LoserTree(ascending_runs(batches), capture_order):
        out.append(row)
        if len(out) == 10_000:
            yield _rows(out)
            out = []
    if out:
        yield _rows(out)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=[n for n, _ in _KINDS])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All captures of the archives: partition after partition, and row after row in each, by URL key, time and page."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    runs = table(files.mapInArrow(_read, CAPTURE), "warc-runs")
    n = max(1, -(-runs.count() // RANGE_CAPTURES))
    ranges = runs.repartitionByRange(n, "url_key", "captured", "page_id")
    return ranges.mapInArrow(_merge, CAPTURE)


def archive_round_trip(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, from archives written and read back.

    Null html is an empty payload, and empty payloads equal each other. Null URLs are empty. A page without id is always a
    response. Rows that repeat the smallest id of a payload are responses both. Payloads of any length are written whole. Columns
    other than page_id, url and html are ignored. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, least)
    return read_archives(spark, path)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    captures = archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, encode(coalesce(html, '')) AS payload FROM pages
), h AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(html) AS digest,
         min(page_id) OVER (PARTITION BY html) AS first_id
  FROM p
), b AS (
  SELECT *, list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(digest || '0', 1 + (5 * i) // 4, 3))::INT >> (7 - (5 * i) % 4)) & 31)::INT, 1)) AS letters
  FROM h
)
SELECT page_id, payload_bytes, array_to_string(letters, '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM b
"""
