"""WARC archives with an externally merged capture index.

Writing: every task writes its pages as WARC 1.1 records, one gzip member each, to archive files of bounded size in the
shared folder, through pyarrow's file systems. Of records with equal payloads the one with the smallest page_id is a
response, the others are revisits of it without payload. Each finished file gives one capture run: its index rows, sorted
by URL key and timestamp.

Index: the runs are dealt out by ranges of (URL key, timestamp, page_id, file, offset); within a range a loser tree merges
its pieces of the k runs, so that the ranges one after the other are the capture histories in global order. A URL with
very many captures is split by timestamp like any others; a range's rows are bounded.

Reading: archives are read back by file and offset in the order they lie, and every payload is checked against its digest.

Defined results: null html is an empty payload; null urls have an empty URL key and no target; rows that repeat the smallest
page_id of a payload are all responses; a null page_id never names a response that others revisit unless all with its
payload are null, which then are all responses; an empty table gives an empty result; other columns are ignored. A task
that runs again writes files of another name, and only index rows that reached the index count.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serploom.llm.common import check_columns, columns_of, persisted, scratch
from serploom.shipping import ship

#: Compressed bytes after which a new archive file, and with it a new run, begins.
FILE_BYTES = 32 << 20
#: Compressed bytes that one task reads back, about.
READ_BYTES = 8 << 20
#: Index rows of one range of the merge, about.
RANGE_ROWS = 100_000
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=UTC)
LEVEL = 1

INDEX = "urlkey string, stamp string, page_id long, file string, offset long, length long, run string, place long"
COLUMNS = ["urlkey", "stamp", "page_id", "file", "offset", "length", "run", "place"]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Host labels reversed, then the rest: ``com,example)/path?query``."""
    m = re.match(r"(?s)[^:/?#]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)(?::\d+)?([^#]*)", (url or "").lower())
    return f"{','.join(reversed(m[1].split('.')))}){m[2] or '/'}" if m else (url or "").lower()


def stamp_of(page_id: int | None) -> datetime:
    """The capture time: pages carry none, so they are a second apart in the order of page_id."""
    return FIRST_CAPTURE + timedelta(seconds=(page_id or 0) % 10**9)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": stamp_of(page_id).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe="!#$%&'()*+,/:;=?@[]~", errors="surrogatepass")
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> dict:
    """The fields of a compressed record; raises ValueError where a response's payload doesn't fit its digest."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload doesn't fit its digest")
    number = lambda x: int(m[1]) if x and (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "payload_bytes": len(payload) if kind == "response" else int(re.search(rb"Content-Length: (\d+)", http)[1]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(fields.get("WARC-Refers-To")),
        "payload": payload if kind == "response" else None,
        "url": fields.get("WARC-Target-URI"),
    }


class LoserTree:
    """Merges k sorted sequences with about log2(k) comparisons an element: inner nodes keep the loser, the winner goes up."""

    def __init__(self, runs: Iterable[Iterable[tuple]]) -> None:
        self.feeds = [iter(r) for r in runs]
        self.k = len(self.feeds)
        self.heads: list[tuple | None] = [next(f, None) for f in self.feeds]
        self.loser = [-1] * max(self.k, 1)
        for leaf in range(self.k):
            self._climb(leaf)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _climb(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.loser[node] < 0:  # while building: wait here for the other side
                self.loser[node] = winner
                return
            if self._less(self.loser[node], winner):
                self.loser[node], winner = winner, self.loser[node]
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.loser[0]] is not None:
            winner = self.loser[0]
            yield self.heads[winner]
            self.heads[winner] = next(self.feeds[winner], None)
            self._climb(winner)


def typed(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, first: the page whose response the row revisits, null for responses.

    Digests are aggregated to their smallest page_id before anything is joined; only rows that revisit are joined to
    the pages, by page_id and digest, so no payload group meets in one task.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = check_columns(pages, "page_id", "url", "html").withColumn("__sha", F.sha1(payload))
    slim = rows.select(F.col("page_id").alias("__id"), F.col("__sha").alias("__d"), F.octet_length(payload).alias("__n")).filter(F.col("__n") >= least_bytes)
    first = slim.groupBy("__d").agg(F.min("__id").alias("first"), F.count("*").alias("__c")).filter("__c > 1 and first is not null").select("__d", "first")
    revisits = slim.join(first, "__d").filter("__id is null or __id <> first").select("__id", "__d", "first").distinct()
    return rows.join(revisits, rows["page_id"].eqNullSafe(revisits["__id"]) & (rows["__sha"] == revisits["__d"]), "left").select("page_id", "url", "html", "first")


def write(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives; the runs' index rows (INDEX), run by run sorted, kept in the shared folder."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        task = TaskContext.get()
        rows: list[tuple] = []
        name, at, out = "", 0, None

        def index() -> pa.RecordBatch:
            out.close()
            rows.sort()
            cols = [*zip(*[(key, stamp, page[1] if page[0] else None, file, offset, length, file, k) for k, (key, stamp, page, file, offset, length) in enumerate(rows)], strict=True)]
            rows.clear()
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], COLUMNS)

        for batch in batches:
            cols = columns_of(batch)
            for page, url, html, first in zip(*(cols[n] for n in ("page_id", "url", "html", "first")), strict=True):
                page_id, url, payload = page.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass")
                if out is None:
                    name, at = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz", 0
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                member = record(page_id, url, payload, base32_sha1(payload), first.as_py(), first.is_valid)
                out.write(member)
                rows.append((url_key(url), stamp_of(page_id).strftime("%Y%m%d%H%M%S"), (page_id is not None, page_id or 0), name, at, len(member)))
                at += len(member)
                if at >= file_bytes:
                    yield index()
                    out = None
        if out is not None:
            yield index()

    return persisted(typed(pages, least_bytes).mapInArrow(run, INDEX), "runs")


def merge(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The index in global order of URL key and timestamp: INDEX and ``history`` (ascending in that order)."""
    ship(runs.sparkSession)
    ranges = max(1, -(-runs.count() // range_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, list[tuple]] = {}
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, stamp, page, file, offset, length, name, place = r
                pieces.setdefault(name, []).append(((key, stamp, page is not None, page or 0, file, offset), length, place))
        for piece in pieces.values():  # a run's rows may come in several fetches
            if any(a[2] > b[2] for a, b in zip(piece, piece[1:])):
                piece.sort(key=lambda r: r[2])
        base = TaskContext.get().partitionId() << 40
        rows = [(k, s, p if has else None, f, o, n, f, place, base + i) for i, ((k, s, has, p, f, o), n, place) in enumerate(LoserTree(pieces[x] for x in sorted(pieces)))]
        for k in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_pylist([dict(zip([*COLUMNS, "history"], r, strict=True)) for r in rows[k : k + 10_000]], pa.schema([(n, pa.string() if n in ("urlkey", "stamp", "file", "run") else pa.int64()) for n in [*COLUMNS, "history"]]))

    return runs.select(*COLUMNS).repartitionByRange(ranges, "urlkey", "stamp", "page_id", "file", "offset").mapInArrow(run, INDEX + ", history long")


def read(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records that the index names: page_id, payload_bytes, payload_digest, record_type, refers_to, urlkey, history
    (and url, payload)."""
    ship(index.sparkSession)
    more = ["url", "payload"] if with_payload else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(folder)
        now, source = "", None
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "urlkey": pa.string(), "history": pa.int64(), "url": pa.string(), "payload": pa.binary()}
        names = [n for n in kinds if n in more or n not in ("url", "payload")]
        for batch in batches:
            cols = columns_of(batch)
            rows = []
            for file, offset, length, key, place in zip(*(cols[n].to_pylist() for n in ("file", "offset", "length", "urlkey", "history")), strict=True):
                if file != now:
                    if source is not None:
                        source.close()
                    now, source = file, store.open_input_file(f"{top}/{file}")
                source.seek(offset)
                rows.append(parse(source.read(length)) | {"urlkey": key, "history": place})
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[n]) for n in names], names)
        if source is not None:
            source.close()

    slim = index.select("file", "offset", "length", "urlkey", "history")
    # by the archives' bytes: the index rows that are shuffled say nothing about the work, so they mustn't decide
    parts = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // READ_BYTES))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, urlkey string, history long" + ", url string, payload binary" * with_payload
    return slim.repartition(parts, "file").sortWithinPartitions("file", "offset").mapInArrow(run, schema)


def round_trip(pages: DataFrame, least_bytes: int = 0, **how: int) -> DataFrame:
    """Write the archives, merge the runs, read all records back through the merged index."""
    folder = scratch(pages.sparkSession, "warc")
    return read(persisted(merge(write(pages, folder, least_bytes, **how)), "cdx"), folder)
