"""A paged REST source as a Spark data source, with the retry rules as plain functions.

fetch(url) -> (status, headers, body) is given by the caller (tests give a local one); by
default it is urllib.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.errors import PySparkNotImplementedError
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

#: Pages read at most, unless given: by offset, by cursor. A source with more raises.
MAX_OFFSET_PAGES, MAX_CURSOR_PAGES = 500, 2000
#: Rows from which on a batch of a stream by cursor takes no further page.
BATCH_ROWS = 50_000
ATTEMPTS = 3


class IncompleteRead(RuntimeError):
    """A page failed, or there are more pages than the reader may take."""


def wait_seconds(status: int, attempt: int, retry_after: str | None = None, base: float = 1.0) -> float | None:
    """How long to wait before trying again; None: don't. 403 and 404 are final."""
    if status in (403, 404):
        return None
    if status == 429:
        if retry_after and retry_after.isdigit():
            return float(retry_after)
        return min(300.0, 30.0 * 2**attempt)
    if status >= 500:
        return min(60.0, base * 2**attempt)
    return None


def wait_column(status: Column, attempt: Column, retry_after: Column, base: float = 1.0) -> Column:
    """wait_seconds for rows of a table of answers."""
    grown = lambda start, cap: F.least(F.lit(cap), F.lit(start) * F.pow(F.lit(2.0), attempt))
    asked = F.when(retry_after.rlike("^[0-9]+$"), retry_after.try_cast("double"))
    return F.when(status.isin(403, 404), F.lit(None)).when(status == 429, F.coalesce(asked, grown(30.0, 300.0))).when(status >= 500, grown(base, 60.0))


def urllib_fetch(url: str) -> tuple[int, dict, str]:
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(url, timeout=30) as r:  # noqa: S310
            return r.status, dict(r.headers), r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), ""


def get(url: str, fetch: Callable = urllib_fetch, sleep: Callable = time.sleep) -> dict | list | None:
    for attempt in range(ATTEMPTS):
        status, headers, body = fetch(url)
        if status == 200:
            return json.loads(body)
        wait = wait_seconds(status, attempt, headers.get("Retry-After"))
        if wait is None:
            return None
        sleep(wait)
    return None


def rows_of(page: dict | list | None) -> list[dict]:
    """The rows of a page: a list, or the list under data."""
    if isinstance(page, list):
        return page
    return list((page or {}).get("data") or [])


def cursor_of(page: dict | list | None) -> str | None:
    if not isinstance(page, dict):
        return None
    return next((str(page[k]) for k in ("next", "nextCursor", "cursor") if page.get(k)), None)


def offset_pages(get_page: Callable[[int, int], dict | list | None], size: int, first: int = 0, max_pages: int = MAX_OFFSET_PAGES, partial: bool = False, last: bool = True) -> Iterator[list[dict]]:
    """Pages from an offset on, until one is short, empty or the total is reached.

    A failed page, or a page beyond max_pages, raises; with partial what came before it stays
    and the read ends. A reader of some of the pages (not last) ends after max_pages.
    """
    offset = first
    for _ in range(max_pages):
        page = get_page(offset, size)
        if page is None and not partial:
            raise IncompleteRead(f"the page at offset {offset} failed")
        rows = rows_of(page)
        if not rows:
            return
        yield rows
        offset += len(rows)
        total = page.get("total") if isinstance(page, dict) else None
        if len(rows) < size or (total is not None and offset >= int(total)):
            return
    if last and not partial and rows_of(get_page(offset, size)):
        raise IncompleteRead(f"more than {max_pages} pages")


def cursor_pages(get_page: Callable[[str | None], dict | list | None], cursor: str | None = None, max_pages: int = MAX_CURSOR_PAGES, partial: bool = False) -> Iterator[tuple[str | None, list[dict]]]:
    """(next cursor, rows) from a cursor on, until there is no next one; failed or too many pages raise unless partial."""
    for _ in range(max_pages):
        page = get_page(cursor)
        if page is None and not partial:
            raise IncompleteRead(f"the page at cursor {cursor} failed")
        rows, cursor = rows_of(page), cursor_of(page)
        if rows:
            yield cursor, rows
        if not rows or not cursor:
            return
    if not partial:
        raise IncompleteRead(f"more than {max_pages} pages")


class _Offsets(InputPartition):
    def __init__(self, first: int, pages: int, last: bool):
        self.first, self.pages, self.last = first, pages, last


class RestSource(DataSource):
    """format("talus_rest"): options url (with {offset} and {limit}, or {cursor}), pagesize, partitions, maxpages, partial.

    A stream over a url with {offset} is read on the executors, partitions pages apart at once; one
    with {cursor} can only be walked page by page, batchrows rows or a little more to a batch. counturl
    is asked for the number of rows (total) of a stream by offsets, by default the url with a limit of 1.
    """

    fetch: Callable = staticmethod(urllib_fetch)

    @classmethod
    def name(cls) -> str:
        return "talus_rest"

    def schema(self) -> str:
        return "user_id bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options), type(self).fetch)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        if "{offset}" not in self.options.get("url", ""):  # Spark then takes the simple reader
            raise PySparkNotImplementedError(errorClass="NOT_IMPLEMENTED", messageParameters={"feature": "streamReader"})
        return _OffsetStream(schema, dict(self.options), type(self).fetch)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Stream(schema, dict(self.options), type(self).fetch)


def _row(schema: StructType, row: dict) -> tuple:
    return tuple(row.get(f.name) for f in schema.fields)


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict, fetch: Callable):
        self.schema, self.options, self.fetch = schema, options, fetch
        self.size = int(options.get("pagesize", "100"))

    def partitions(self) -> list[InputPartition]:
        n, pages = int(self.options.get("partitions", "1")), int(self.options.get("maxpages", MAX_OFFSET_PAGES))
        starts = [pages * k // n for k in range(n + 1)]
        return [_Offsets(x * self.size, y - x, y == pages) for x, y in zip(starts, starts[1:]) if y > x]

    def read(self, partition: _Offsets) -> Iterator[tuple]:
        page = lambda offset, limit: get(self.options["url"].replace("{offset}", str(offset)).replace("{limit}", str(limit)), self.fetch)
        partial = self.options.get("partial", "false").lower() == "true"
        for rows in offset_pages(page, self.size, partition.first, partition.pages, partial, partition.last):
            yield from (_row(self.schema, r) for r in rows)


class _Rows(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class _OffsetStream(DataSourceStreamReader):
    """The offset is the number of rows taken. The driver asks for the total alone; rows go from the pages to the executors."""

    def __init__(self, schema: StructType, options: dict, fetch: Callable):
        self.schema, self.options, self.fetch = schema, options, fetch
        self.size = int(options.get("pagesize", "100"))

    def _page(self, template: str, offset: int, limit: int) -> dict | list:
        page = get(template.replace("{offset}", str(offset)).replace("{limit}", str(limit)), self.fetch)
        if page is None:
            raise IncompleteRead(f"the page at offset {offset} failed")
        return page

    def initialOffset(self) -> dict:  # noqa: N802
        return {"rows": int(self.options.get("start", "0"))}

    def latestOffset(self) -> dict:  # noqa: N802
        page = self._page(self.options.get("counturl", self.options["url"]), 0, 1)
        if not isinstance(page, dict) or page.get("total") is None:
            raise IncompleteRead("a stream by offsets needs the total in the answer")
        return {"rows": int(page["total"])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Whole pages for each, so that no page is asked for twice, but the one that a batch began in."""
        first, last, n = start["rows"], end["rows"], int(self.options.get("partitions", "1"))
        pages = -(-last // self.size) - first // self.size
        each = max(1, -(-pages // n)) * self.size
        cuts = [first, *range((first // self.size) * self.size + each, last, each), last]
        return [_Rows(x, y) for x, y in zip(cuts, cuts[1:]) if y > x]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        at = partition.first // self.size * self.size
        while at < partition.end:
            rows = rows_of(self._page(self.options["url"], at, self.size))
            if at + len(rows) < min(partition.end, at + self.size):
                raise IncompleteRead(f"the page at offset {at} has fewer rows than were counted")
            yield from (_row(self.schema, r) for r in rows[max(0, partition.first - at) : partition.end - at])
            at += self.size


class _Stream(SimpleDataSourceStreamReader):
    """The cursor is the stream's offset, so a restarted query goes on where its checkpoint says.

    A batch takes pages until it has batchrows rows: what a batch costs is paid once for many
    pages, and no more than these rows and a page are held at once. At the end (done) the offset
    names the last page, and a batch that runs again ends with it.
    """

    def __init__(self, schema: StructType, options: dict, fetch: Callable):
        self.schema, self.options, self.fetch = schema, options, fetch
        self.least = int(options.get("batchrows", str(BATCH_ROWS)))

    def initialOffset(self) -> dict:
        return {"cursor": self.options.get("start", ""), "done": 0}

    def _page(self, cursor: str) -> dict | list:
        page = get(self.options["url"].replace("{cursor}", cursor), self.fetch)
        if page is None:
            raise IncompleteRead(f"the page at cursor {cursor} failed")
        return page

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["done"]:
            return iter([]), start
        cursor, rows = start["cursor"], []
        while True:
            page = self._page(cursor)
            rows += [_row(self.schema, r) for r in rows_of(page)]
            after = cursor_of(page)
            if not after:
                return iter(rows), {"cursor": cursor, "done": 1}
            cursor = after
            if len(rows) >= self.least:
                return iter(rows), {"cursor": cursor, "done": 0}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        cursor = start["cursor"]
        while True:
            page = self._page(cursor)
            yield from (_row(self.schema, r) for r in rows_of(page))
            at, cursor = cursor, cursor_of(page)
            if not cursor or (at if end["done"] else cursor) == end["cursor"]:
                return
