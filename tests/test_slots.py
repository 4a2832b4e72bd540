"""The feed of slots: waiting, giving up, late slots, restarts."""

from __future__ import annotations

import datetime
import gzip
import zipfile

from heronry.session import fresh_path
from heronry.sources.slots import STAMP, advance, due, slot_stream
from heronry.streaming.replay import drain

BASE = datetime.datetime(2024, 5, 1, tzinfo=datetime.UTC)


def stamp(k):
    return (BASE + datetime.timedelta(minutes=15 * k)).strftime(STAMP)


def run(spark, folder, state, **options):
    stream = slot_stream(spark, str(folder), wait=3600, reread=4 * 3600, **options)
    rows = drain(stream, state).collect()
    at = lambda r: round((r.slot.replace(tzinfo=datetime.UTC) - BASE).total_seconds() / 900)
    return sorted((at(r), r.state, r.line, r.value) for r in rows)


def test_waits_gives_up_and_reads_late(spark, tmp_path):
    state, put = fresh_path(spark, "slots"), lambda k, text: (tmp_path / f"{stamp(k)}.tsv").write_text(text)
    put(0, "a\nb\n")
    put(1, "")
    put(3, "c")
    assert run(spark, tmp_path, state) == [(0, "read", 0, None), (0, "read", 1, "a"), (0, "read", 2, "b"), (1, "read", 0, None)]
    put(6, "d")  # an hour past slot 2: it is given up; 4 and 5 still wait
    assert [r[:3] for r in run(spark, tmp_path, state) if r[2] == 0] == [(0, "read", 0), (1, "read", 0), (2, "lost", 0), (3, "read", 0)]
    (tmp_path / f"{stamp(4)}.tsv.gz").write_bytes(gzip.compress(b"packed"))
    with zipfile.ZipFile(tmp_path / f"{stamp(5)}.zip", "w") as z:
        z.writestr("x.csv", "zipped\n")
    put(2, "late\n")
    rows = run(spark, tmp_path, state)
    assert [r for r in rows if r[0] in (2, 4, 5, 6)] == [(2, "late", 0, None), (2, "late", 1, "late"), (2, "lost", 0, None), (4, "read", 0, None), (4, "read", 1, "packed"), (5, "read", 0, None), (5, "read", 1, "zipped"), (6, "read", 0, None), (6, "read", 1, "d")]
    assert run(spark, tmp_path, state) == rows  # nothing is read twice


def test_offsets_alone_decide():
    h = 3600
    one = advance({0: "", 2 * h: ""}, None, h, 2 * h, 10 * h)
    assert one == {"slot": 0, "lost": []}
    two = advance({0: "", 2 * h: "", 3 * h: "", 20 * h: ""}, None, h, 2 * h, 10 * h)
    assert two["slot"] == 18 * h and two["lost"] == [s * h for s in range(9, 19)]
    assert due(one, two, 0, h, 10 * h)[:3] == [(h, "read"), (2 * h, "read"), (3 * h, "read")]


def test_no_slots(spark, tmp_path):
    assert run(spark, tmp_path, fresh_path(spark, "slots")) == []
