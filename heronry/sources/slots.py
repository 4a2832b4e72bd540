"""A feed of time slots as a streaming source with a cursor of its own.

A feed is a folder with a file `<yyyyMMddHHmmss>.<ext>` or a folder
`slot=<yyyyMMddHHmmss>` for each slot. The cursor advances slot by slot up to
the last one that is there. At a missing slot it stops and waits, until the feed
is `wait` seconds ahead; then the slot is given up as lost. A lost slot that
comes after all, within `reread` seconds before the cursor, is read late.

An offset holds the cursor and the lost slots of that span, so what a batch
reads follows from its two offsets alone: a batch that runs again, or a query
that restarts, reads the same slots. Each slot is a partition.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from heronry.sources.archives import Member, listed, opened, pieces, zip_members

SCHEMA = "slot timestamp, state string, line long, value string"
STAMP = "%Y%m%d%H%M%S"
MOST_BYTES = 1 << 28


def instant(stamp: str) -> int:
    """Seconds of a slot's name."""
    return int(datetime.datetime.strptime(stamp, STAMP).replace(tzinfo=datetime.UTC).timestamp())


def there(folder: str) -> dict[int, str]:
    """The slots of a feed and where they are."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
    prefix, out = folder[: len(folder) - len(name)] if folder.endswith(name) else "", {}
    for f in store.get_file_info(fs.FileSelector(name, allow_not_found=True)):
        stamp = f.base_name.removeprefix("slot=").split(".")[0]
        if len(stamp) == 14 and stamp.isdigit():
            out[instant(stamp)] = prefix + f.path
    return out


def advance(present, first: int | None, step: int, wait: int, reread: int) -> dict:
    """The offset that the slots which are there lead to: the cursor stands before the first slot that still waits."""
    if not present:
        return {"slot": None, "lost": []}
    last = max(present)
    slot, lost = min(present) if first is None else first, []
    while slot <= last and (slot in present or last - slot >= wait):
        if slot not in present:
            lost.append(slot)
        slot += step
    cursor = slot - step
    return {"slot": cursor, "lost": [s for s in lost if s > cursor - reread]}


def due(start: dict, end: dict, first: int | None, step: int, reread: int) -> list[tuple[int, str]]:
    """(slot, state) of what lies between two offsets."""
    if end["slot"] is None:
        return []
    lost = set(end["lost"])
    began = start["slot"] + step if start["slot"] is not None else first
    late = [(s, "late") for s in start["lost"] if s not in lost and s > end["slot"] - reread]
    return late + [(s, "lost" if s in lost else "read") for s in range(began, end["slot"] + 1, step)]


class Slot(InputPartition):
    def __init__(self, slot: int, state: str, path: str):
        self.slot, self.state, self.path = slot, state, path


class SlotReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.step, self.wait, self.reread = (int(options.get(k, d)) for k, d in (("step", 900), ("wait", 6 * 3600), ("reread", 48 * 3600)))
        if self.wait > self.reread:
            raise ValueError("a slot is given up before the span that is read again has passed")
        self.first = instant(options["first"]) if options.get("first") else None

    def initialOffset(self) -> dict:
        return {"slot": None, "lost": []}

    def latestOffset(self) -> dict:
        return advance(there(self.folder), self.first, self.step, self.wait, self.reread)

    def partitions(self, start: dict, end: dict) -> list[Slot]:
        found = there(self.folder)
        first = self.first if self.first is not None else min(found, default=0)
        return [Slot(s, state, found.get(s, "")) for s, state in due(start, end, first, self.step, self.reread)]

    def read(self, partition: Slot) -> Iterator[tuple]:
        """A row for the slot itself (line 0), then its lines."""
        at = datetime.datetime.fromtimestamp(partition.slot, datetime.UTC)
        yield at, partition.state, 0, None
        if partition.state == "lost":
            return
        n = 0
        for path in listed(partition.path):
            for line in lines(path):
                n += 1
                yield at, partition.state, n, line

    def commit(self, end: dict) -> None:
        pass


def lines(path: str) -> Iterator[str]:
    """The lines of a text file, gzip or not, or of the members of a zip."""
    with opened(path) as f:
        size = f.size()
        members = list(zip_members(f, size)) if path.endswith(".zip") else [Member(path, 0, size, "stored")]
        for m in members:
            rest = b""
            for part in pieces(f, m, MOST_BYTES):
                *whole, rest = (rest + part).split(b"\n")
                yield from (x.decode("utf-8", "replace").removesuffix("\r") for x in whole)
            if rest:
                yield rest.decode("utf-8", "replace")


class SlotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "slots"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> SlotReader:
        return SlotReader(self.options)


def slot_stream(spark: SparkSession, folder: str, step: int = 900, wait: int = 6 * 3600, reread: int = 48 * 3600, first: str | None = None) -> DataFrame:
    """(slot, state, line, value) of a feed; state is read, late or lost."""
    spark.dataSource.register(SlotSource)
    stream = spark.readStream.format("slots").option("step", step).option("wait", wait).option("reread", reread)
    return (stream.option("first", first) if first else stream).load(folder)
