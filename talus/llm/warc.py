"""WARC archives of captures, with an index built by an external merge of locally sorted runs.

Each task writes archives (a gzip member per record) and next to each its run: a file of the
archive's captures, sorted by URL key, timestamp and id, in blocks that can be read one by one.
What travels is a row per block: its place, and its first and last sort key. Splitters, drawn
from these rows, cut the key space into ranges; for each range up to FAN runs are merged through
a loser tree that holds one block of each, into a longer run or, in the last level, into the
index: the capture histories in global order. The index then says what is read where.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.llm import files
from talus.llm.text import binary, slices
from talus.runtime import new_path, stage

#: Payloads below this size are always written in full.
MIN_REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)
LEVEL = 1
#: Bytes after which an archive is closed.
ARCHIVE_BYTES = 256 << 20
#: Captures of an archive at most: a task holds their index rows until the archive is closed.
ARCHIVE_ROWS = 200_000
#: Captures in a block of a run, blocks in a range on average, ranges at most, and runs that one loser tree merges.
BLOCK_ROWS, RANGE_BLOCKS, MAX_RANGES, FAN = 1024, 200, 10_000, 64
#: Block rows that are drawn for each splitter.
DRAWN = 20
#: Bytes read at once, and parts that the copies of one payload are dealt into.
CHUNK, SALTS = 4 << 20, 8


class LoserTree:
    """Merges sorted iterables: an inner node keeps the loser of its match, the winner moves up."""

    _DONE = object()

    def __init__(self, runs: list[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.heads = [next(r, self._DONE) for r in self.runs] or [self._DONE]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._seat(leaf)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's head comes first; ended runs come last, ties go to the lower run."""
        x, y = self.heads[a], self.heads[b]
        if x is self._DONE or y is self._DONE:
            return y is self._DONE and (x is not self._DONE or a < b)
        return (x, a) < (y, b)

    def _seat(self, leaf: int) -> None:
        """First matches: a run waits at the first free node on its way up."""
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = winner
                return
            if self._less(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.heads[self.losers[0]] is not self._DONE:
            winner = self.losers[0]
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], self._DONE)
            node = (winner + self.k) // 2
            while node > 0:
                if self._less(self.losers[node], winner):
                    self.losers[node], winner = winner, self.losers[node]
                node //= 2
            self.losers[0] = winner


def url_key(url: str | None) -> str:
    """The sort-friendly form of a URL: host labels reversed, then port, path and query."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + tail.lower()


def _header_value(text: str) -> str:
    """What can't stand in a header line as the percent signs of its UTF-8 bytes, so that different URLs stay different."""
    return "".join(c if c.isprintable() and c != "\x7f" else "".join("%%%02X" % b for b in c.encode("utf-8", "surrogatepass")) for c in text)


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, when: datetime) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP header with the payload's size, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>"]
    if url:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    lines += [f"WARC-Date: {when.strftime('%Y-%m-%dT%H:%M:%SZ')}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    number = lambda urn: int(x) if (x := urn.removeprefix("<urn:page:").removesuffix(">")) else None
    kind = fields["WARC-Type"]
    if kind == "response":
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    else:
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None,
    }


def records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of each gzip member, in time linear in the bytes."""
    view, at, step = memoryview(data), 0, 1 << 16
    while at < len(data):
        d, to, body = zlib.decompressobj(31), at, []
        while not d.eof and to < len(data):
            body.append(d.decompress(view[to : to + step]))
            to = min(len(data), to + step)
        used = to - len(d.unused_data) - at
        yield at, used, b"".join(body)
        at += used


CAPTURE = pa.schema([("sort_key", pa.binary()), ("key", pa.string()), ("stamp", pa.string()), ("page_id", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
BLOCKS = "run long, uri string, offset long, bytes long, rows long, first binary, last binary"
_BLOCKS = pa.schema([("run", pa.int64()), ("uri", pa.string()), ("offset", pa.int64()), ("bytes", pa.int64()), ("rows", pa.int64()), ("first", pa.binary()), ("last", pa.binary())])


def sort_key(key: str, stamp: str, page: int | None, part: int, n: int, offset: int) -> bytes:
    """Bytes that sort as (key, stamp, page, with null first, archive, offset) do."""
    number = b"\0" if page is None else b"\1" + (page + (1 << 63)).to_bytes(8, "big")
    return key.encode("utf-8", "surrogatepass").replace(b"\0", b"\1") + b"\0" + stamp.encode() + number + struct.pack(">IIQ", part, n, offset)


def write_run(uri: str, run: int, rows: Iterator[tuple]) -> pa.RecordBatch:
    """Write sorted captures as a run; gives its block rows."""
    made, at = [], 0
    with files.create(uri) as out:
        while piece := list(itertools.islice(rows, BLOCK_ROWS)):
            sink = pa.BufferOutputStream()
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*piece), CAPTURE)], schema=CAPTURE)
            with pa.ipc.new_stream(sink, CAPTURE, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(batch)
            data = sink.getvalue()
            out.write(data)
            made.append((run, uri, at, len(data), len(piece), piece[0][0], piece[-1][0]))
            at += len(data)
    return pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], f.type) for k, f in enumerate(_BLOCKS)], schema=_BLOCKS)


def read_blocks(blocks: list[dict], low: bytes, high: bytes | None) -> Iterator[tuple]:
    """The captures from low to below high of a run's blocks, one block in memory at a time."""
    for b in blocks:
        with files.open_file(b["uri"]) as f:
            f.seek(b["offset"])
            table = pa.ipc.open_stream(f.read(b["bytes"])).read_all()
        for row in zip(*(c.to_pylist() for c in table.columns)):
            if row[0] >= low and (high is None or row[0] < high):
                yield row


def write(pages: DataFrame, path: str, when: Column | None = None) -> DataFrame:
    """Write every row of pages (page_id, url, html) to archives and runs below path; gives the runs' block rows.

    Of rows with equal payloads of MIN_REVISIT_BYTES or more, the smallest page_id is written in
    full (rows that repeat that id too) and the others revisit it. A null html is an empty
    payload; a null url has the empty key; a null page_id never is a group's first unless all
    are null. Payloads are written whole, however long. Other columns are ignored; an empty
    table gives no archive. `when` is the capture time, by default a second per id from 2020 on.
    Archives and runs of lost attempts stay behind, but no block row names them.
    """
    seconds = F.unix_seconds(when.cast("timestamp")) if when is not None else F.lit(int(EPOCH.timestamp())) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(1 << 31))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), seconds.alias("seconds"))
    firsts = base.where(F.octet_length("html") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = base.select("page_id", "digest", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt"))
    again = salted.join(firsts, ["digest", "salt"]).where("NOT page_id <=> first").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("first").alias("refers_to")).distinct()
    typed = base.join(again, base.page_id.eqNullSafe(F.col("p")) & (base.digest == F.col("d")), "left").select("page_id", "url", "html", "digest", "seconds", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, at, rows, out, uri = TaskContext.get(), 0, 0, [], None, ""
        part = task.partitionId()

        def close() -> pa.RecordBatch:
            out.close()
            rows.sort()  # the local run, by its sort keys
            return write_run(uri.removesuffix(".warc.gz") + ".run", part << 32 | n, iter(rows))

        for batch in slices(batches, "html"):
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to", "seconds")]
            for page, url, digest, refers, seconds, payload in zip(*columns, binary(batch.column("html"))):
                if out is None:
                    uri = f"{path}/captures-{part:06d}-{n:05d}-{task.taskAttemptId()}.warc.gz"
                    out, at, rows, n = files.create(uri), 0, [], n + 1
                moment = datetime.fromtimestamp(0, timezone.utc) + timedelta(seconds=seconds)
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = packer.compress(record(page, url, payload, digest, refers, moment)) + packer.flush()
                out.write(member)
                key, stamp = url_key(url), moment.strftime("%Y%m%d%H%M%S")
                rows.append((sort_key(key, stamp, page, part, n, at), key, stamp, page, digest, "response" if refers is None else "revisit", uri, at, len(member)))
                at += len(member)
                if at >= ARCHIVE_BYTES or len(rows) >= ARCHIVE_ROWS:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    files.make_folder(path)
    return stage(typed.mapInArrow(run, BLOCKS), "warc-blocks")


def splitters(blocks: DataFrame, n: int) -> list[bytes]:
    """The lower bounds of the ranges but for the first: about one for RANGE_BLOCKS of the n blocks, MAX_RANGES - 1 at most.

    Like a range partitioner's, they come from a drawn share of the rows, DRAWN for each range.
    """
    ranges = min(MAX_RANGES, -(-n // RANGE_BLOCKS))
    step = max(1, n // (ranges * DRAWN))
    drawn = blocks.where(F.pmod(F.xxhash64("first"), F.lit(step)) == 0).select("first").limit(4 * DRAWN * MAX_RANGES).collect() if ranges > 1 else []
    keys = sorted({bytes(r["first"]) for r in drawn})
    every = max(1, len(keys) // ranges)
    return keys[every::every]


def dealt(blocks: DataFrame, bounds: list[bytes]) -> DataFrame:
    """With part: a row for each range that a block's captures lie in."""
    shared = blocks.sparkSession.sparkContext.broadcast(bounds)  # MAX_RANGES keys at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        for batch in batches:
            at, parts = [], []
            for k, (first, last) in enumerate(zip(batch.column("first").to_pylist(), batch.column("last").to_pylist())):
                for part in range(bisect.bisect_right(bounds, first), bisect.bisect_right(bounds, last) + 1):
                    at.append(k)
                    parts.append(part)
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(parts, pa.int32())], [*batch.schema.names, "part"])

    return blocks.mapInArrow(run, BLOCKS + ", part int")


def _merged(segments: list[dict], low: bytes, high: bytes | None) -> Iterator[tuple]:
    by_run: dict[int, list[dict]] = {}
    for b in sorted(segments, key=lambda b: (b["run"], b["first"])):
        by_run.setdefault(b["run"], []).append(b)
    return iter(LoserTree([read_blocks(bs, low, high) for bs in by_run.values()]))


INDEX = "key string, stamp string, page_id long, payload_digest string, record_type string, file string, offset long, length long, part int, place long, nth long"


def merge_runs(blocks: DataFrame, path: str) -> DataFrame:
    """The runs' captures in global order: (part, place) orders them, capture numbers a key's history from 0.

    A popular key may fall into several ranges, as the ranges split by time and id too.
    """
    spark = blocks.sparkSession
    size = blocks.agg(F.count("*").alias("n"), F.count_distinct("run").alias("runs")).first()
    bounds = splitters(blocks, size.n) if size.n else []
    shared = spark.sparkContext.broadcast([b"", *bounds, None])
    cut, runs = dealt(blocks, bounds), size.runs

    def tasks(cut: DataFrame, groups: int) -> DataFrame:
        """A row per range and group of runs: the rows of its blocks, RANGE_BLOCKS on average."""
        group = F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int") if groups > 1 else F.lit(0)
        block = F.struct("run", "uri", "offset", "bytes", "first")
        each = cut.groupBy("part", group.alias("grp")).agg(F.collect_list(block).alias("segments"))
        return each.repartition(max(1, min(MAX_RANGES, len(bounds) + 1) * groups), "part", "grp")

    level = 0
    while runs > FAN:
        groups, level = -(-runs // FAN), level + 1

        def longer(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    low, high = shared.value[row["part"]], shared.value[row["part"] + 1]
                    uri = f"{path}/merged-{level}-{row['grp']:06d}-{row['part']:05d}-{TaskContext.get().taskAttemptId()}.run"
                    made = write_run(uri, row["grp"], _merged(row["segments"], low, high))
                    yield pa.RecordBatch.from_arrays([*made.columns, pa.array([row["part"]] * made.num_rows, pa.int32())], [*made.schema.names, "part"])

        cut = stage(tasks(cut, groups).mapInArrow(longer, BLOCKS + ", part int"), "warc-level")
        runs = cut.select("run").distinct().count()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = _merged(row["segments"], shared.value[row["part"]], shared.value[row["part"] + 1])
                place, last, nth = 0, None, 0
                while piece := list(itertools.islice(rows, 10_000)):
                    count = []
                    for r in piece:
                        last, nth = r[1], nth + 1 if r[1] == last else 0
                        count.append(nth)
                    columns = [pa.array(c, f.type) for c, f in zip(list(zip(*piece))[1:], list(CAPTURE)[1:])]
                    spot = pa.array(range(place, place + len(piece)), pa.int64())
                    place += len(piece)
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([row["part"]] * len(piece), pa.int32()), spot, pa.array(count, pa.int64())], [*CAPTURE.names[1:], "part", "place", "nth"])

    made = stage(tasks(cut, 1).mapInArrow(index, INDEX), "warc-index")
    # only a range's first and last key can be in other ranges: two rows per range
    ends = made.groupBy("part").agg(F.min_by("key", "place").alias("a"), F.max_by("key", "place").alias("b"))
    ends = ends.select("part", F.explode(F.array_distinct(F.array("a", "b"))).alias("key"))
    counts = made.join(F.broadcast(ends), ["part", "key"]).groupBy("part", "key").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    earlier = counts.select("part", "key", before.alias("earlier")).where("earlier > 0")
    numbered = made.join(F.broadcast(earlier), ["part", "key"], "left")  # MAX_RANGES rows at most
    return numbered.withColumn("capture", F.col("nth") + F.coalesce("earlier", F.lit(0))).drop("earlier", "nth")


def read(index: DataFrame) -> DataFrame:
    """The record of every row of the index: page_id, payload_bytes, payload_digest, record_type, refers_to, and its place in the index.

    The index drives the reads: a task has the captures of some archives in the order of their
    offsets, and reads each archive from front to back, CHUNK bytes at a time.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    kept = ["key", "part", "place", "capture"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, f, start, held = None, None, 0, b""
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for file, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != uri:
                    if f is not None:
                        f.close()
                    uri, f, start, held = file, files.open_file(file), 0, b""
                if at < start or at + size > start + len(held):
                    f.seek(at)
                    start, held = at, f.read(max(CHUNK, size))
                rows.append(tuple(parse(zlib.decompress(held[at - start : at - start + size], 31)).values()))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows), kinds)), *(batch.column(c) for c in kept)], [*names, *kept])
        if f is not None:
            f.close()

    ordered = index.select("file", "offset", "length", *kept).repartition("file").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, key string, part int, place long, capture long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives written, indexed and read back by the index: a row per page with its place in the histories."""
    path = new_path(pages.sparkSession, "warc")
    index = merge_runs(write(pages, path), path)
    return read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("key").alias("url_key"), F.col("part").alias("index_part"), F.col("place").alias("index_place"), "capture")
