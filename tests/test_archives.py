"""Archives read by byte range: round trips, damaged, large and odd members."""

from __future__ import annotations

import gzip
import io
import json
import tarfile
import zipfile

import pytest

from heronry.sources.archives import archive_members, archived_traces, listed, member_states, news_rows


def tar_of(path, members, kind=tarfile.PAX_FORMAT):
    with tarfile.open(path, "w", format=kind) as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a").mkdir()
    return tmp_path / "a"


@pytest.mark.parametrize("kind", [tarfile.PAX_FORMAT, tarfile.GNU_FORMAT, tarfile.USTAR_FORMAT])
def test_tar_round_trip(spark, folder, kind):
    long_name = "d/" * 40 + "x" * 60 + ".txt" if kind != tarfile.USTAR_FORMAT else "d" * 90 + "/x.txt"
    texts = {"one.txt": b"a\nb\r\n\nc", "empty.txt": b"", "é.txt": "ñ\n".encode(), long_name: b"long\n", "z.gz": gzip.compress(b"packed\n" * 5)}
    tar_of(folder / "t.tar", texts.items(), kind)
    got = {(r.member, r.line): r.value for r in archive_members(spark, str(folder), part_bytes=1).collect()}
    want = {(n, k): x for n, lines in {"one.txt": ["a", "b", "", "c"], "é.txt": ["ñ"], long_name: ["long"], "z.gz": ["packed"] * 5}.items() for k, x in enumerate(lines)}
    assert got == want


def test_zip_round_trip_and_damage(spark, folder):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.csv", "1\t2\n3\t4\n", zipfile.ZIP_DEFLATED)
        z.writestr("b.csv", "stored\n", zipfile.ZIP_STORED)
        z.writestr("large.csv", "x" * 5000, zipfile.ZIP_DEFLATED)
        z.writestr("hurt.csv", "y0123456789\n" * 300, zipfile.ZIP_DEFLATED)
        z.mkdir("folder")
        hurt = z.getinfo("hurt.csv")
    raw = bytearray(data.getvalue())
    raw[hurt.header_offset + 45] ^= 0xFF
    (folder / "z.zip").write_bytes(raw)
    (folder / "cut.zip").write_bytes(data.getvalue()[:80])
    rows = archive_members(spark, str(folder), most_bytes=4000)
    assert sorted((r.member, r.value) for r in rows.filter("state = 'read'").collect()) == [("a.csv", "1\t2"), ("a.csv", "3\t4"), ("b.csv", "stored")]
    told = {r.archive.rpartition("/")[2]: (r.n_read, r.n_large, r.n_broken) for r in member_states(rows).collect()}
    assert told == {"z.zip": (2, 1, 1), "cut.zip": (0, 0, 1)}


def test_damaged_tars_give_what_comes_before(spark, folder):
    members = [(f"m{k}.txt", f"text {k}\n".encode() * 200) for k in range(6)]
    tar_of(folder / "x.tar", members)
    raw = bytearray((folder / "x.tar").read_bytes())
    with tarfile.open(folder / "x.tar") as tar:
        place = {m.name: m.offset for m in tar.getmembers()}
    raw[place["m4.txt"] + 10] ^= 1  # a head whose checksum fails
    (folder / "x.tar").write_bytes(raw)
    (folder / "y.tar").write_bytes(bytes(raw[: place["m2.txt"] + 600]))  # cut off inside of a member
    told = {r.archive.rpartition("/")[2]: (r.n_read, r.n_large, r.n_broken) for r in member_states(archive_members(spark, str(folder))).collect()}
    assert told == {"x.tar": (4, 0, 1), "y.tar": (2, 0, 1)}


def test_memory_of_a_member_is_bounded():
    """A member that inflates to 200 MB is given up after the bound."""
    import tracemalloc

    from heronry.sources.archives import Member, TooLarge, pieces

    packed = gzip.compress(b"\0" * (200 << 20))
    tracemalloc.start()
    with pytest.raises(TooLarge):
        for _ in pieces(io.BytesIO(packed), Member("a.gz", 0, len(packed), "gzip"), 1 << 20):
            pass
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


def test_traces_in_a_daily_tar(spark, folder):
    doc = {"icao": "4CA1FA", "timestamp": 1700000000.0, "trace": [[0, 40.0, -3.0, "ground", 5.0], [10.5, 40.1, -3.1, 1200, 90.0], [20, None, None]]}
    tar_of(folder / "day.tar", [("traces/fa/a.json", gzip.compress(json.dumps(doc).encode())), ("traces/b.json.gz", gzip.compress(json.dumps(doc).encode())), ("traces/c.json", b"{not json"), ("traces/d.json.gz", gzip.compress(b"x" * 900)[:-5])])
    rows = archived_traces(spark, str(folder)).filter("member = 'traces/b.json.gz'").orderBy("point").collect()
    assert [(r.icao, r.lat, r.altitude_ft, r.on_ground) for r in rows] == [("4ca1fa", 40.0, None, True), ("4ca1fa", 40.1, 1200.0, False), ("4ca1fa", None, None, None)]
    assert member_states(archive_members(spark, str(folder), whole=True)).first()[1:] == (3, 0, 1)


def test_news_rows_of_27_columns(spark, folder):
    fields = [str(k) for k in range(27)]
    fields[1], fields[4], fields[7], fields[25], fields[26] = "20240301123000", "https://x/y", "A;;B;", "srclc:deu;eng:x", "<PAGE_TITLE>Two\n words</PAGE_TITLE>".replace("\n", " ")
    with zipfile.ZipFile(folder / "n.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("n.csv", "\t".join(fields) + "\n" + "too\tfew\n" + "\t".join([*fields[:25], "", ""]) + "\n")
    rows = news_rows(spark, str(folder)).collect()
    assert [(r.title, r.language, r.themes, r.url) for r in rows] == [("Two words", "deu", ["A", "B"], "https://x/y"), ("", "eng", ["A", "B"], "https://x/y")]


def test_no_archives(spark, folder):
    assert listed(str(folder)) == [] and archive_members(spark, str(folder)).count() == 0
