"""A live playlist as a streaming source: its segments by media sequence number.

The playlist is fetched by a function given by name, ``module:function`` -> list of (sequence, uri),
so a test or another transport needs no network. Offsets are sequence numbers, so a segment is read
once also after a restart; a failed fetch is tried again with growing waits.
"""

from __future__ import annotations

import importlib
import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.streaming.query import StreamingQuery

from hearken.sources.files import place, put


def retried(fetch, tries: int = 5, step: float = 5.0, most: float = 30.0, wait=time.sleep):
    """``fetch()``, tried again after step, 2 step, ... seconds, ``most`` at most."""
    for n in range(1, tries + 1):
        try:
            return fetch()
        except OSError:
            if n == tries:
                raise
            wait(min(n * step, most))


class PlaylistReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        module, name = options["fetch"].split(":")
        self.fetch = getattr(importlib.import_module(module), name)
        self.stream = options.get("stream", "live")

    def initialOffset(self) -> dict:
        return {"sequence": -1}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found = sorted(s for s in retried(self.fetch) if s[0] > start["sequence"])
        return iter([(self.stream, n, uri) for n, uri in found]), {"sequence": found[-1][0] if found else start["sequence"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(self.stream, n, uri) for n, uri in sorted(retried(self.fetch)) if start["sequence"] < n <= end["sequence"]])


class Playlist(DataSource):
    """spark.dataSource.register(Playlist); spark.readStream.format("playlist").option("fetch", ...)"""

    @classmethod
    def name(cls) -> str:
        return "playlist"

    def schema(self) -> str:
        return "stream string, sequence long, uri string"

    def simpleStreamReader(self, schema) -> PlaylistReader:
        return PlaylistReader(dict(self.options))



@dataclass
class Segments(InputPartition):
    """Segments that one task fetches."""

    segments: list[tuple[int, str]]


class SegmentReader(DataSourceStreamReader):
    """The whole live list, with what was seen kept until it is committed.

    Every list is put into the folder ``log`` before its segments are offered, and a segment's bytes when a
    task has fetched them. So a batch that runs again has the same segments, and the same bytes, though the
    live list has moved on; what is committed goes. With ``target`` the source ends after so many segments
    in all. A list without news is asked again after ``poll`` seconds at the earliest; a fetch that fails is
    tried again, with growing waits, and one that keeps failing offers nothing until the next trigger."""

    def __init__(self, options: dict) -> None:
        self.fetch, self.get = _named(options["fetch"]), _named(options["get"]) if "get" in options else None
        self.stream, self.log = options.get("stream", "live"), options["log"]
        self.target = int(options.get("target", 0)) or None
        self.poll, self.tries, self.step = (float(options.get(k, v)) for k, v in (("poll", 2), ("tries", 5), ("step", 5)))
        self.each = int(options.get("each", 4))
        self.asked = float("-inf")

    def _lists(self) -> list[tuple[int, str]]:
        files, path = place(self.log)
        found: dict[int, str] = {}
        for info in sorted(files.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True)), key=lambda i: i.base_name):
            if info.base_name.startswith("list-") and info.base_name.endswith(".json"):
                with files.open_input_stream(info.path) as f:
                    found.update({n: uri for n, uri in json.loads(f.read()) if n not in found})
        return sorted(found.items())

    def initialOffset(self) -> dict:
        return {"sequence": -1, "count": 0}

    def latestOffset(self) -> dict:
        files, path = place(self.log)
        known = self._lists()
        ends = self._ends()
        now = time.monotonic()
        full = self.target is not None and ends["count"] + sum(n > ends["sequence"] for n, _ in known) >= self.target
        if not full and now - self.asked >= self.poll:
            self.asked = now
            try:
                live = retried(self.fetch, int(self.tries), self.step)
            except OSError:
                live = []
            last = max([ends["sequence"], *[n for n, _ in known]])
            new = sorted({(n, uri) for n, uri in live if n > last})
            if self.target is not None:
                new = new[: max(self.target - ends["count"] - sum(n > ends["sequence"] for n, _ in known), 0)]
            if new:
                files.create_dir(path)
                put(files, f"{path}/list-{new[0][0]:015d}.json", json.dumps(new).encode())
                known += new
        offered = [n for n, _ in known if n > ends["sequence"]]
        return {"sequence": max([ends["sequence"], *offered]), "count": ends["count"] + len(offered)}

    def _ends(self) -> dict:
        """How far lists have gone: sequence and count."""
        files, path = place(self.log)
        info = files.get_file_info(f"{path}/ends.json")
        if info.type == pyarrow.fs.FileType.NotFound:
            return self.initialOffset()
        with files.open_input_stream(info.path) as f:
            return json.loads(f.read())

    def partitions(self, start: dict, end: dict) -> list[Segments]:
        some = [s for s in self._lists() if start["sequence"] < s[0] <= end["sequence"]]
        return [Segments(some[i : i + self.each]) for i in range(0, len(some), self.each)]

    def read(self, partition: Segments) -> Iterator[tuple]:
        files, path = place(self.log)
        for n, uri in partition.segments:
            content = None
            if self.get is not None:
                kept = f"{path}/segment-{n:015d}"
                if files.get_file_info(kept).type == pyarrow.fs.FileType.NotFound:
                    content = retried(lambda u=uri: self.get(u), int(self.tries), self.step)
                    put(files, kept, content)
                else:
                    with files.open_input_stream(kept) as f:
                        content = f.read()
            yield (self.stream, n, uri, content)

    def commit(self, end: dict) -> None:
        files, path = place(self.log)
        known = self._lists()
        files.create_dir(path)
        put(files, f"{path}/ends.json", json.dumps(end).encode())
        rest = [s for s in known if s[0] > end["sequence"]]
        for info in files.get_file_info(pyarrow.fs.FileSelector(path)):
            number = re.fullmatch(r"(?:list|segment)-(\d+)(?:\.json)?", info.base_name)
            if number and int(number[1]) <= end["sequence"]:
                files.delete_file(info.path)
        if rest and not any(i.base_name == f"list-{rest[0][0]:015d}.json" for i in files.get_file_info(pyarrow.fs.FileSelector(path))):
            put(files, f"{path}/list-{rest[0][0]:015d}.json", json.dumps(rest).encode())


def _named(name: str):
    module, name = name.split(":")
    return getattr(importlib.import_module(module), name)


class Live(DataSource):
    """spark.dataSource.register(Live); spark.readStream.format("segments") with the options fetch, log, get,
    stream, target, poll, each. ``get``, ``module:function``, gives a segment's bytes for its address."""

    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> str:
        return "stream string, sequence long, uri string, content binary"

    def streamReader(self, schema) -> SegmentReader:
        return SegmentReader(dict(self.options))


def run_until(query: StreamingQuery, segments: int, longest: float = 600.0, poll: float = 0.2) -> int:
    """A bounded run: let the query go until it has taken so many segments, and stop it. Returns how many
    it took; fewer if it ended, or if ``longest`` seconds went by."""
    began, taken = time.monotonic(), 0
    while time.monotonic() - began < longest:
        for progress in query.recentProgress:
            counts = [re.search(r"count\W+(\d+)", str(s["endOffset"])) for s in progress["sources"]]
            taken = max([taken, *[int(c[1]) for c in counts if c]])
        if taken >= segments or not query.isActive:
            break
        time.sleep(poll)
    if query.isActive:
        query.processAllAvailable()
        query.stop()
    return taken
