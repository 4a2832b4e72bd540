"""Importance resampling against features hashed and drawn by hand."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from heronry.llm import resample

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
EDGES = [(1, None), (2, ""), (3, "."), (4, "a b a b a"), (4, "a b a b a"), (None, "É é x-y"), (None, "É é x-y"), (5, "only here " * 40), (6, "word " * 3000), (7, "x" * 5000 + " y"), (8, " ".join(f"w{k}" for k in range(60)))]


def features(text, order=2):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return w, [b" ".join(w[p : p + n]) for n in range(1, order + 1) for p in range(len(w) - n + 1)]


def brute(docs, target, percent=25, min_words=20, order=2):
    sums = [Counter(zlib.crc32(f) % 10000 for t in texts for f in features(t, order)[1]) for texts in ([t for _, t in docs], target)]
    s_all, t_all = (sum(c.values()) for c in sums)
    gains = [math.floor(1000 * math.log((sums[1][b] + 1) * (s_all + 10000) / ((sums[0][b] + 1) * (t_all + 10000)))) for b in range(10000)]
    rows = []
    for d, t in docs:
        w, f = features(t, order)
        weight = sum(gains[zlib.crc32(x) % 10000] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, *r[1:3]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS rank", "2 AS bucket", "3 AS rs_weight")


def items(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


@pytest.mark.parametrize("options", [{}, {"step_bytes": 16}, {"percent": 60, "min_words": 0}, {"order": 3}, {"order": 1, "step_bytes": 16}])
def test_edges(spark, options):
    target = ["a b only here", None, "", "word " * 30]
    got = resample.report(frame(spark, EDGES), items(spark, target), **options).collect()
    want = brute(EDGES, target, **{k: v for k, v in options.items() if k != "step_bytes"})
    assert sorted(map(tuple, got), key=repr) == want


def test_table(spark):
    docs, bench = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [r[0] for r in bench.select("text").collect()])
    assert sorted(map(tuple, resample.report(docs, bench).collect()), key=repr) == want


def test_drawn_documents(spark):
    docs = frame(spark, EDGES)
    drawn = resample.draw(docs, items(spark, ["only here"]), percent=60)
    ranked = [r[0] for r in brute(EDGES, ["only here"], percent=60) if r[4] is not None]
    assert drawn.columns == docs.columns and sorted(r["doc_id"] for r in drawn.collect()) == sorted(ranked)


def test_empty(spark):
    none = frame(spark, [])
    assert resample.report(none, items(spark, ["a"])).count() == 0 and resample.draw(none, items(spark, [])).count() == 0
    got = resample.report(frame(spark, EDGES), items(spark, [])).collect()
    assert sorted(map(tuple, got), key=repr) == brute(EDGES, [])


def test_crc_states():
    raw = np.frombuffer(b"one two " + b"z" * 300, np.uint8)
    states = resample.advance(np.full(3, 0xFFFFFFFF, np.uint32), raw, np.array([0, 4, 8]), np.array([3, 7, 308]))
    assert (~states).tolist() == [zlib.crc32(b"one"), zlib.crc32(b"two"), zlib.crc32(b"z" * 300)]
