"""WARC archives of pages, and their capture index by external merge.

**Archives.** Every page is one WARC 1.1 record, a gzip member of its own, so a record can
be read alone by its offset. Spark's text writer writes the members; its line separator is
an empty gzip member, which decompresses to nothing, so the files are plain ``.warc.gz``
and their commit survives lost tasks. Pages whose payload another page has already are
revisit records without the payload.

**Index.** Reading an archive back gives one run of captures, sorted in the task by URL
key and time. Range partitioning on the whole key (URL key, time, page, place) sends a
segment of each run to the task of a range, so a URL with a third of all captures spans
many ranges; there a loser tree merges the segments. Ranges are in order, and their counts
give every capture its place in the whole."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from datetime import datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragframe.llm.common import broadcast_up_to, shared_path, shared_table, text_batches

#: Payloads from this many bytes on are stored once.
MIN_REVISIT = 100
#: Bytes of payload in one archive, on average.
ARCHIVE_BYTES = 32 << 20
#: Copies from which a payload's pages find their first page by broadcast.
HOT_COPIES = 1000
#: Captures that one merging task holds.
RANGE_ROWS = 100_000

#: Fixed values of the formats.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff0300") + struct.pack("<II", 0, 0)

_ID_TAG = 0x726563_6F7264  # the custom part of the ids of records of numbered pages
_CAPTURE = ("archive string, place long, offset long, length long, page_id long, url string, url_key string, captured string, "
            "record_type string, payload_bytes long, payload_digest string, refers_to long, intact boolean")


def record_id(page_id: int | None, seed: str = "") -> str:
    """The record id of a page: a version 8 UUID that holds the number. A page without a
    number has an id of its payload's digest."""
    if page_id is None:
        low, tag = int(hashlib.sha256(seed.encode()).hexdigest()[:16], 16), 0
    else:
        low, tag = page_id & (1 << 64) - 1, _ID_TAG
    value = tag << 80 | 8 << 76 | low >> 62 << 64 | 2 << 62 | low & (1 << 62) - 1
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def page_of(record: str | None) -> int | None:
    """The page's number in a record id; None without one."""
    if record is None:
        return None
    value = uuid.UUID(record.strip("<>")[len("urn:uuid:"):]).int
    if value >> 80 != _ID_TAG:
        return None
    low = (value >> 64 & 3) << 62 | value & (1 << 62) - 1
    return low - (1 << 64) if low >> 63 else low


def _uri(url: str) -> str:
    """The URL with white space and control characters as percent codes, so that it stays in its header."""
    return re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels from the last to the first, lower case and without
    ``www``, user and usual port, then path and query. ``-`` for null."""
    if url is None:
        return "-"
    scheme, sep, rest = url.partition("://")
    if not sep:
        return url
    host, tail = re.match(r"([^/?#]*)([^#]*)", rest, re.S).groups()
    host = host.rpartition("@")[2].lower()
    usual = {"http": ":80", "https": ":443"}.get(scheme.lower())
    if usual and host.endswith(usual):
        host = host[:-len(usual)]
    host = re.sub(r"^www\d*\.", "", host)
    return ",".join(reversed(host.split("."))) + ")" + (tail if tail.startswith("/") else "/" + tail)


def record(page_id: int | None, url: str | None, captured: datetime, payload: bytes, digest: str,
           first: tuple | None = None) -> bytes:
    """One WARC record. ``first``: (page_id, url, time) of the page whose response holds
    the same payload; the record is then a revisit of that one."""
    date = captured.strftime("%Y-%m-%dT%H:%M:%SZ")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", _uri(url)))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if first:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(first[0]))]
        if first[1] is not None:
            head.append(("WARC-Refers-To-Target-URI", _uri(first[1])))
        head.append(("WARC-Refers-To-Date", first[2].strftime("%Y-%m-%dT%H:%M:%SZ")))
    body = http if first else http + payload
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    return b"".join([b"WARC/1.1\r\n", *(f"{k}: {v}\r\n".encode() for k, v in head), b"\r\n", body, b"\r\n\r\n"])


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def members(data) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of an archive that have content."""
    view, at, total = memoryview(data).cast("B"), 0, len(data)
    while at < total:
        if view[at:at + len(EMPTY_MEMBER)] == EMPTY_MEMBER:
            at += len(EMPTY_MEMBER)
            continue
        d, start, parts = zlib.decompressobj(31), at, []
        while not d.eof and at < total:
            fed = min(total, at + 8192)
            parts.append(d.decompress(view[at:fed]))
            at = fed
        if not d.eof:
            raise ValueError("an archive ends inside a record")
        at -= len(d.unused_data)
        yield start, at - start, b"".join(parts)


def parse(content: bytes) -> dict:
    """The fields of one record: its headers (lower-case names), HTTP headers and payload."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    body = rest[:int(fields["content-length"])]
    if rest[len(body):] != b"\r\n\r\n":
        raise ValueError("a record's length is not that of its block")
    http, _, payload = body.partition(b"\r\n\r\n")
    return {"fields": fields, "payload": payload,
            "http": {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in http.decode().split("\r\n")[1:])}}


def _planned(pages: DataFrame, captured: Column) -> DataFrame:
    """page_id, url, captured, payload, digest and (first_id, first_url, first_time) of the
    page that holds the payload already (null: the page itself is the response)."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     captured.cast("timestamp").alias("captured"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    lead = F.struct("page_id", "url", "captured")
    firsts = shared_table(
        p.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(
            F.count(F.lit(1)).alias("copies"), F.min(F.when(F.col("page_id").isNotNull(), lead)).alias("lead"))
        .where((F.col("copies") > 1) & F.col("lead").isNotNull()), "warc-firsts")
    hot = broadcast_up_to(firsts.where(F.col("copies") >= HOT_COPIES).select("digest", F.col("lead").alias("hot")), 200_000)
    cold = broadcast_up_to(firsts.where(F.col("copies") < HOT_COPIES).select(F.col("digest").alias("key"), F.col("lead").alias("cold")), 200_000)
    p = p.join(hot, "digest", "left")
    # pages that have found their lead spread over all tasks of the second join
    p = p.withColumn("key", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat_ws("#", "digest", "page_id", "url")))
    p = p.join(cold, "key", "left").withColumn("lead", F.coalesce("hot", "cold"))
    own = F.col("lead").isNull() | (F.col("lead.page_id") == F.coalesce("page_id", F.col("lead.page_id") - 1))
    lead = F.when(~own, F.col("lead"))
    return p.select("page_id", "url", "captured", "payload", "digest", lead["page_id"].alias("first_id"),
                    lead["url"].alias("first_url"), lead["captured"].alias("first_time"))


def write_archives(pages: DataFrame, path: str, captured: Column) -> None:
    """Writes ``pages`` (page_id, url, html) as WARC archives under ``path``.

    Of pages with equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest
    page_id is the response (rows that share this page_id all are), the others revisit it. A
    page without page_id is never revisited. Null html is an empty payload, a null url gives
    no target header. A null ``captured`` time is the epoch's start."""
    spark = pages.sparkSession
    planned = _planned(pages, F.coalesce(captured.cast("timestamp"), F.timestamp_seconds(F.lit(0))))
    rows, size = pages.agg(F.count(F.lit(1)), F.sum(F.octet_length("html"))).first()
    held = max(1, int(ARCHIVE_BYTES / max(1.0, (size or 0) / rows))) if rows else 1

    def run(batches):
        for batch in text_batches(batches, 3, 4 << 20):
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            out = []
            for page_id, url, at, payload, digest, f_id, f_url, f_at in zip(
                    *(col[n].cast(pa.timestamp("us", "UTC")).to_pylist() if n in ("captured", "first_time") else col[n].to_pylist()
                      for n in ("page_id", "url", "captured", "payload", "digest", "first_id", "first_url", "first_time"))):
                first = (f_id, f_url, f_at) if f_id is not None else None
                out.append(_member(record(page_id, url, at, payload.encode(), digest, first)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    (planned.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", held).option("encoding", "ISO-8859-1")
     .option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One run of captures for each archive under ``path``: a row for every record, sorted
    by URL key, time and page (``place`` in the run), with its offset and length in the
    archive. ``intact``: a response's payload has the digest and length of its headers."""
    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = content.as_buffer()
                found = []
                for offset, length, data in members(raw):
                    r = parse(data)
                    f, payload = r["fields"], r["payload"]
                    size, digest = int(r["http"]["content-length"]), f["warc-payload-digest"].removeprefix("sha256:")
                    kind, intact = f["warc-type"], True
                    if kind == "response":
                        intact = (len(payload), hashlib.sha256(payload).hexdigest()) == (size, digest)
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    url = f.get("warc-target-uri")
                    page = page_of(f["warc-record-id"])
                    found.append((url_key(url), f["warc-date"], page is not None, page or 0, offset, length, url, kind, size,
                                  digest, page_of(f.get("warc-refers-to")), intact))
                found.sort(key=lambda e: e[:5])
                for lo in range(0, len(found), 5000):
                    part = found[lo:lo + 5000]
                    key, date, has, page, offset, length, url, kind, size, digest, refers, intact = zip(*part)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name] * len(part)), pa.array(range(lo, lo + len(part)), pa.int64()), pa.array(offset, pa.int64()),
                        pa.array(length, pa.int64()), pa.array([p if h else None for p, h in zip(page, has)], pa.int64()),
                        pa.array(url, pa.string()), pa.array(key), pa.array(date), pa.array(kind), pa.array(size, pa.int64()),
                        pa.array(digest), pa.array(refers, pa.int64()), pa.array(intact)],
                        [f.split()[0] for f in _CAPTURE.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content").mapInArrow(run, _CAPTURE)


class LoserTree:
    """Merges sorted sequences. Inner nodes keep the loser of their match; when the winner
    moves on, its new key is matched along its own path only."""

    def __init__(self, runs: Sequence[Sequence]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.key = [run[0] if len(run) else None for run in runs]
        winner = [0] * self.k + list(range(self.k))
        self.loser = [0] * self.k
        for t in range(self.k - 1, 0, -1):
            a, b = winner[2 * t], winner[2 * t + 1]
            winner[t], self.loser[t] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winner[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's key comes first; a run that has ended comes last."""
        x, y = self.key[a], self.key[b]
        return y is None or x is not None and (x < y or x == y and a < b)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in it) in merged order."""
        while self.k and self.key[self.winner] is not None:
            s = self.winner
            yield s, self.at[s]
            self.at[s] += 1
            self.key[s] = self.runs[s][self.at[s]] if self.at[s] < len(self.runs[s]) else None
            t = (s + self.k) // 2
            while t:
                if self._before(self.loser[t], s):
                    self.loser[t], s = s, self.loser[t]
                t //= 2
            self.winner = s


def merge_runs(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``captures`` (of :func:`read_archives`) in one order over all archives: by URL key,
    time, page (null first), archive and place. ``position`` counts from 0, so the captures
    of a URL stand one behind the other in the order of time."""
    spark = captures.sparkSession
    stored = shared_table(captures, "warc-runs")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored.count() // range_rows))
    names = stored.columns

    def merged(batches):
        whole = [b for b in batches if b.num_rows]
        if not whole:
            return
        t = pa.Table.from_batches(whole).combine_chunks()
        archive = t.column("archive").combine_chunks().dictionary_encode()
        page = t.column("page_id")
        keys = list(zip(t.column("url_key").to_pylist(), t.column("captured").to_pylist(), pc.is_valid(page).to_pylist(),
                        pc.fill_null(page, 0).to_pylist()))
        codes = archive.indices.to_pylist()
        starts = [i for i in range(len(codes)) if not i or codes[i] != codes[i - 1]] + [len(codes)]
        tree = LoserTree([keys[a:b] for a, b in zip(starts, starts[1:])])
        yield from t.take(pa.array([starts[r] + i for r, i in tree], pa.int64())).to_batches(max_chunksize=5000)

    # a partition is a range of the whole order; in it, the segments of the runs end to end
    ranged = stored.repartitionByRange(parts, "url_key", "captured", "page_id", "archive", "place").sortWithinPartitions("archive", "place")
    out = ranged.mapInArrow(merged, stored.schema).withColumn("pid", F.spark_partition_id()).withColumn(
        "at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    out = shared_table(out, "warc-merged")
    counts = out.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    before = F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    bases = shared_table(counts.select("pid", F.coalesce(before, F.lit(0)).alias("base")), "warc-bases")
    return out.join(broadcast_up_to(bases, 1_000_000), "pid").select(*names, (F.col("base") + F.col("at")).alias("position"))


def archived(pages: DataFrame, captured: Column | None = None, path: str | None = None) -> DataFrame:
    """Writes ``pages`` into archives (under ``path``, or a new shared folder), reads them
    back and returns the merged capture index, one row for each row of ``pages``.

    ``captured``: the pages' capture times (None: one second apart by page_id). Repeated
    rows are records of their own; an empty table has no rows. Columns of other names have
    no part in it."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    seconds = F.timestamp_seconds(F.pmod(F.col("page_id"), F.lit(1 << 32)))
    write_archives(pages, path, seconds if captured is None else captured)
    return merge_runs(read_archives(spark, path))
