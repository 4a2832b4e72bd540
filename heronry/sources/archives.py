"""Archives as a batch source: the members of zip and tar files, read by byte range.

`archive_members` reads (archive, member, size, line, value) lines or whole
members out of many archives. The source's partitions are runs of members, told
by their places in the archive: the driver reads only the index at a zip's end
or the heads of a tar's members. A task opens the archive at its members' bytes
and inflates them piece by piece, so neither an archive nor a member over
`most_bytes` is ever held. Members that are too large, damaged or not text are
rows with a state of their own and no value: nothing is lost silently, and
nothing stops the job.

Files are opened through pyarrow's file systems (local paths and the URIs it
knows), since a Python source has no access to Spark's.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, member string, size long, state string, line long, value string"
#: Bytes inflated at once, most bytes of a member, and bytes of members in a partition.
STEP, MOST_BYTES, PART_BYTES = 1 << 16, 20 << 20, 64 << 20
BLOCK = 512
ZIP_END, ZIP_ENTRY, ZIP_HEAD = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04"
ZIP64_PLACE, ZIP64_END = b"PK\x06\x07", b"PK\x06\x06"


@dataclass
class Member:
    """Where a member's bytes stand; `method` is stored, deflate or gzip (a file that is gzip inside)."""

    name: str
    at: int
    packed: int
    method: str
    crc: int | None = None
    state: str = "read"


@dataclass
class Members(InputPartition):
    archive: str
    members: list[Member]


def opened(path: str):
    """A seekable file."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(name)


def listed(path: str) -> list[str]:
    """The files of a folder, or the file itself."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    if store.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    found = store.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def number(field: bytes) -> int:
    """A tar head's number: octal, or binary for large ones."""
    if field[:1] == b"\x80":
        return int.from_bytes(field[1:], "big")
    text = field.rstrip(b"\0 ").lstrip(b" ")
    return int(text, 8) if text else 0


def records(data: bytes) -> dict[str, str]:
    """The `length key=value` records of an extended head."""
    out, at = {}, 0
    while (gap := data.find(b" ", at)) > at and data[at:gap].isdigit():
        size = int(data[at:gap])
        key, _, value = data[gap + 1 : at + size - 1].partition(b"=")
        out[key.decode("utf-8", "replace")] = value.decode("utf-8", "replace")
        at += max(size, 1)
    return out


def tar_members(f, size: int) -> Iterator[Member]:
    """The regular files of a tar by their heads; a damaged head ends the archive with a member in state broken."""
    at, long_name, extended = 0, None, {}
    while at + BLOCK <= size:
        f.seek(at)
        head = f.read(BLOCK)
        if not head.strip(b"\0"):
            break
        try:
            if sum(head[:148]) + 8 * 32 + sum(head[156:]) != number(head[148:156]):
                raise ValueError("checksum")
            length = int(extended.get("size", number(head[124:136])))
        except ValueError:
            yield Member(f"@{at}", at, 0, "stored", state="broken")
            break
        kind, begin = head[156:157], at + BLOCK
        at = begin + -(-length // BLOCK) * BLOCK
        if kind in b"xgL" and kind:
            f.seek(begin)
            data = f.read(min(length, 1 << 20))
            if kind == b"x":
                extended = records(data)
            elif kind == b"L":
                long_name = data.rstrip(b"\0").decode("utf-8", "replace")
            continue
        prefix = head[345:500].rstrip(b"\0") if head[257:262] == b"ustar" else b""
        name = extended.get("path") or long_name or b"/".join(x for x in (prefix, head[:100].split(b"\0")[0]) if x).decode("utf-8", "replace")
        long_name, extended = None, {}
        if kind in (b"0", b"\0", b"7"):
            yield Member(name, begin, length, "gzip" if name.endswith(".gz") else "stored", state="read" if begin + length <= size else "broken")


def zip_members(f, size: int) -> Iterator[Member]:
    """The files of a zip by its index."""
    tail_at = max(0, size - 65557)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    end = tail.rfind(ZIP_END)
    if end < 0 or end + 22 > len(tail):
        yield Member("@index", 0, 0, "stored", state="broken")
        return
    length, at = struct.unpack("<II", tail[end + 12 : end + 20])
    place = tail.rfind(ZIP64_PLACE, 0, end)
    if 0xFFFFFFFF in (length, at) and place >= 0:
        f.seek(struct.unpack("<Q", tail[place + 8 : place + 16])[0])
        wide = f.read(56)
        if wide[:4] == ZIP64_END:
            length, at = struct.unpack("<QQ", wide[40:56])
    f.seek(at)
    index, k = f.read(length), 0
    while k + 46 <= len(index) and index[k : k + 4] == ZIP_ENTRY:
        flags, method = struct.unpack("<HH", index[k + 8 : k + 12])
        crc, packed, plain = struct.unpack("<III", index[k + 16 : k + 28])
        n, extra, note = struct.unpack("<HHH", index[k + 28 : k + 34])
        head = struct.unpack("<I", index[k + 42 : k + 46])[0]
        name = index[k + 46 : k + 46 + n].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        more, e = index[k + 46 + n : k + 46 + n + extra], 0
        while e + 4 <= len(more):
            mark, wide = struct.unpack("<HH", more[e : e + 4])
            if mark == 1:
                values = iter(struct.unpack(f"<{wide // 8}Q", more[e + 4 : e + 4 + wide // 8 * 8]))
                plain = next(values, plain) if plain == 0xFFFFFFFF else plain
                packed = next(values, packed) if packed == 0xFFFFFFFF else packed
                head = next(values, head) if head == 0xFFFFFFFF else head
            e += 4 + wide
        k += 46 + n + extra + note
        if name.endswith("/"):
            continue
        f.seek(head)
        local = f.read(30)
        whole = local[:4] == ZIP_HEAD and method in (0, 8) and not flags & 1
        begin = head + 30 + sum(struct.unpack("<HH", local[26:30])) if whole else head
        yield Member(name, begin, packed, {0: "stored", 8: "deflate"}.get(method, "other"), crc, "read" if whole and begin + packed <= size else "broken")


class TooLarge(ValueError):
    pass


def pieces(f, m: Member, most: int) -> Iterator[bytes]:
    """A member's bytes, inflated; TooLarge past `most`, ValueError or zlib.error where it is damaged."""
    f.seek(m.at)
    left, total, crc, inner = m.packed, 0, 0, zlib.decompressobj(-15) if m.method == "deflate" else None
    gzipped = zlib.decompressobj(31) if m.method == "gzip" or m.name.endswith(".gz") else None

    def through(unpack, data: bytes) -> Iterator[bytes]:
        while data:
            yield unpack.decompress(data, STEP)
            data = unpack.unconsumed_tail

    while left:
        data = f.read(min(STEP, left))
        if not data:
            raise ValueError("cut off")
        left -= len(data)
        for part in through(inner, data) if inner else (data,):
            crc = zlib.crc32(part, crc)
            for out in through(gzipped, part) if gzipped else (part,):
                total += len(out)
                if total > most:
                    raise TooLarge(m.name)
                yield out
    if any(x is not None and not x.eof for x in (inner, gzipped)) and m.packed:
        raise ValueError("cut off")
    if m.crc is not None and crc != m.crc:
        raise ValueError("checksum")


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.whole = options["path"], options.get("whole", "false").lower() == "true"
        self.most, self.part = int(options.get("most_bytes", MOST_BYTES)), int(options.get("part_bytes", PART_BYTES))

    def partitions(self) -> list[Members]:
        out = []
        for archive in listed(self.path):
            with opened(archive) as f:
                size, run, held = f.size(), [], 0
                f.seek(0)
                for m in zip_members(f, size) if f.read(2) == b"PK" else tar_members(f, size):
                    run.append(m)
                    held += m.packed
                    if held >= self.part:
                        out.append(Members(archive, run))
                        run, held = [], 0
                if run:
                    out.append(Members(archive, run))
        return out or [Members("", [])]

    def read(self, partition: Members) -> Iterator[tuple]:
        if not partition.members:
            return
        with opened(partition.archive) as f:
            for m in partition.members:
                yield from self.member(f, partition.archive, m)

    def member(self, f, archive: str, m: Member) -> Iterator[tuple]:
        """Rows of a member only once it has been read to its end: at most `most_bytes` are held."""
        state, parts = m.state, []
        if state == "read":
            try:
                parts = list(pieces(f, m, self.most))
            except TooLarge:
                state = "large"
            except (ValueError, OSError, zlib.error):
                state = "broken"
        if state != "read":
            yield archive, m.name, m.packed, state, None, None
            return
        text = b"".join(parts).decode("utf-8", "replace")
        if self.whole:
            yield archive, m.name, len(text), state, 0, text
            return
        lines = text.split("\n")
        for k, line in enumerate(lines[:-1] if lines[-1] == "" else lines):
            yield archive, m.name, m.packed, state, k, line.removesuffix("\r")


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def archive_members(spark: SparkSession, path: str, whole: bool = False, most_bytes: int = MOST_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """A row for each line (or with `whole`, each member) of the archives in a folder, and one for each member that can't be read."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").option("whole", whole).option("most_bytes", most_bytes).option("part_bytes", part_bytes).load(path)


def member_states(members: DataFrame) -> DataFrame:
    """(archive, n_read, n_large, n_broken) of what archive_members gives."""
    one = members.select("archive", "member", "state").distinct()
    return one.groupBy("archive").agg(*(F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("read", "large", "broken")))


#: Places of the columns that are used in the news files of 27 columns (fixed values).
NEWS_COLUMNS = {"at": 1, "outlet": 3, "url": 4, "themes": 7, "places": 9, "translation": 25, "extras": 26}
NEWS_WIDTH = 27


def news_rows(spark: SparkSession, path: str) -> DataFrame:
    """(archive, at, outlet, url, title, language, themes, places) of zipped news files; rows of fewer columns go."""
    v = F.split("value", "\t")
    rows = archive_members(spark, path).filter("state = 'read'").select("archive", v.alias("v")).filter(F.size("v") >= NEWS_WIDTH)
    rows = rows.select("archive", *(F.get("v", F.lit(k)).alias(name) for name, k in NEWS_COLUMNS.items()))
    title = F.regexp_extract("extras", "(?s)<PAGE_TITLE>(.*?)</PAGE_TITLE>", 1)
    language = F.nullif(F.regexp_extract("translation", r"^srclc:(\w+)", 1), F.lit(""))
    return rows.select("archive", F.try_to_timestamp(F.substring("at", 1, 14), F.lit("yyyyMMddHHmmss")).alias("at"), "outlet", "url", F.trim(F.regexp_replace(title, r"\s+", " ")).alias("title"), F.coalesce(language, F.lit("eng")).alias("language"), F.filter(F.split("themes", ";"), lambda x: x != "").alias("themes"), F.filter(F.split("places", ";"), lambda x: x != "").alias("places"))


def archived_traces(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(archive, member, icao, point, at, lat, lon, altitude_ft, on_ground) of aircraft files in daily tars; members that aren't JSON have null for icao."""
    docs = archive_members(spark, path, whole=True, most_bytes=most_bytes).filter("state = 'read'")
    doc = F.from_json("value", "icao string, timestamp double, trace array<array<string>>")
    points = docs.select("archive", "member", doc.alias("d")).select("archive", "member", "d.icao", "d.timestamp", F.posexplode_outer("d.trace").alias("point", "p"))
    value = lambda k: F.get("p", F.lit(k)).try_cast("double")
    at = F.timestamp_micros(((F.col("timestamp") + value(0)) * 1_000_000).cast("long"))
    return points.select("archive", "member", F.lower("icao").alias("icao"), "point", at.alias("at"), value(1).alias("lat"), value(2).alias("lon"), value(3).alias("altitude_ft"), (F.get("p", F.lit(3)) == "ground").alias("on_ground"))
