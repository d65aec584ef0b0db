"""A Python data source over cursor-paginated REST endpoints."""

from __future__ import annotations

import datetime
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Pause between pages, tries, first wait; waits double.
PAUSE, TRIES, WAIT = 0.3, 5, 1.0
#: Seconds by which a stream stays behind the clock.
LAG = 60.0

Get = Callable[[str], tuple[int, dict, str]]


def http_get(url: str, headers: dict[str, str] | None = None, timeout: float = 60.0) -> tuple[int, dict, str]:
    """(status, headers, body) of a request; transport errors are raised as OSError."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as r:
            return r.status, dict(r.headers), r.read().decode("utf-8")
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read().decode("utf-8", "replace")


def get_json(url: str, get: Get = http_get, tries: int = TRIES, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep) -> dict:
    """A page. Transport errors, 429 and 5xx are tried again, after ``Retry-After`` if it is given; other errors are final."""
    for left in range(tries - 1, -1, -1):
        pause = wait
        try:
            status, headers, body = get(url)
        except OSError:
            if not left:
                raise
        else:
            if status == 200:
                return json.loads(body)
            if not left or not (status == 429 or status >= 500):
                raise RuntimeError(f"HTTP {status} of {url}")
            pause = float({k.lower(): v for k, v in headers.items()}.get("retry-after", wait))
        sleep(pause)
        wait *= 2
    raise RuntimeError("no tries")


def page_url(base: str, path: str, filters: dict[str, object], cursor: str | None = None) -> str:
    """Filters that are None are left out; ``__`` in a name stands for a dot."""
    params = {"format": "json"} | {k.replace("__", "."): v for k, v in filters.items() if v is not None}
    if cursor is not None:
        params["cursor"] = cursor
    return f"{base.rstrip('/')}/{path.lstrip('/')}?{urllib.parse.urlencode(params)}"


def paginate(base: str, path: str, filters: dict[str, object], fetch: Callable[[str], dict] = get_json, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Records of all pages; ends at an empty page, a cursor that stays, or once ``numFound`` were seen."""
    cursor, seen = None, 0
    while True:
        page = fetch(page_url(base, path, filters, cursor))
        records = page.get("documents") or []
        yield from records
        seen += len(records)
        following = page.get("cursor")
        if not records or following == cursor or seen >= page.get("numFound", 0):
            return
        cursor = following
        sleep(pause)


def count(base: str, path: str, filters: dict[str, object], fetch: Callable[[str], dict] = get_json) -> int:
    return int(fetch(page_url(base, path, filters)).get("numFound", 0))


class Slice(InputPartition):
    def __init__(self, path: str, filters: dict):
        self.path, self.filters = path, filters


def _slices(o: dict, since: str | None, until: str | None) -> list[Slice]:
    """One for each path and term: pages follow from each other, so a slice is read in order by one task."""
    terms = [t for t in o.get("terms", "").split(",") if t] or [None]
    own = {"f__wahlperiode": None, "f__zuordnung": o.get("assignment") or None, "f__aktualisiert__start": since, "f__aktualisiert__end": until}
    return [Slice(p, own | {"f__wahlperiode": t}) for p in o["paths"].split(",") for t in terms]


class _Records:
    """Reads a slice in a task."""

    def __init__(self, options):
        self.options = options

    def read(self, partition: Slice) -> Iterator[tuple]:
        key, base = self.options.get("token"), self.options["url"]
        headers = {"Authorization": f"ApiKey {key}"} if key else {}

        def fetch(url: str) -> dict:
            return get_json(url, lambda u: http_get(u, headers))

        for record in paginate(base, partition.path, partition.filters, fetch, float(self.options.get("pause", PAUSE))):
            yield partition.path, json.dumps(record, ensure_ascii=False)


class _Reader(_Records, DataSourceReader):

    def partitions(self) -> list[Slice]:
        return _slices(self.options, self.options.get("since") or None, None)


def until(lag: float = LAG) -> str:
    """The time so many seconds ago, in UTC."""
    return (datetime.datetime.now(datetime.UTC) - datetime.timedelta(seconds=lag)).strftime("%Y-%m-%dT%H:%M:%S+00:00")


class _Stream(_Records, DataSourceStreamReader):
    """Records by the time of their last update: an offset is such a time, and a batch takes what was updated from one to the next.

    Both ends are inclusive, as the endpoint's filters are, so a record at an end comes twice and none is missed; one that is updated again while a batch is read
    comes with a later one. A batch that is read again asks for the same times.
    """

    def initialOffset(self) -> dict:
        return {"until": self.options.get("since") or ""}

    def latestOffset(self) -> dict:
        """Now, less ``lag`` seconds for what the endpoint has not shown yet, in UTC; or the time that ``until`` names."""
        if self.options.get("until"):
            return {"until": self.options["until"]}
        return {"until": until(float(self.options.get("lag", LAG)))}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return _slices(self.options, start["until"] or None, end["until"])

    def commit(self, end: dict) -> None:
        """Nothing is kept at the endpoint."""


class RestSource(DataSource):
    """``spark.read.format("paged_rest")`` with options url, paths, terms, assignment, since, token, pause; as a stream also until and lag.

    Rows are (path, record), record as JSON; ``jsonl.parsed`` gives its columns.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return "path string, record string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))
