"""Stupid-backoff scores against counting by hand."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from heronry.llm import lm_score

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGES = [(1, None), (2, ""), (3, "a a a b"), (4, "a b c a b c d"), (4, "a b c a b c d"), (None, "b c É é"), (None, "."), (5, "only here " * 3), (6, "word " * 3000)]


def brute(texts, order=3, alpha=0.4):
    words = [WORD.findall((t or "").translate(LOWER)) for _, t in texts]
    grams = [[Counter(tuple(w[p : p + n]) for p in range(len(w) - n + 1)) for n in range(1, order + 1)] for w in words]
    whole = [sum((g[n] for g in grams), Counter()) for n in range(order)]
    total = sum(map(len, words))
    for (d, _), w, own in zip(texts, words, grams):
        levels, log = [0] * (order + 1), 0.0
        for p in range(len(w)):
            n = min(order, p + 1)
            while n and whole[n - 1][g := tuple(w[p - n + 1 : p + 1])] - own[n - 1][g] <= 0:
                n -= 1
            levels[n] += 1
            if n == 0:
                log += order * math.log(alpha) - math.log(total + 1)
                continue
            seen = whole[n - 1][g] - own[n - 1][g]
            context = total - len(w) if n == 1 else whole[n - 2][g[:-1]] - own[n - 2][g[:-1]]
            log += math.log(seen / context) + (order - n) * math.log(alpha)
        yield (d, len(w), *levels, log, log / len(w) if w else None)


def same(got, want):
    got, want = sorted(map(tuple, got), key=repr), sorted(want, key=lambda r: repr((*r[:6], round(r[6], 6))))
    assert [r[:6] for r in got] == [r[:6] for r in want]
    for a, b in zip(got, want):
        assert a[6] == pytest.approx(b[6], abs=2e-5) and (a[7] is b[7] is None or a[7] == pytest.approx(b[7], abs=2e-5))


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 10}, {"shard_bytes": 40, "passes": 1}])
def test_edges(spark, options):
    df = spark.createDataFrame(EDGES, "doc_id long, text string").selectExpr("*", "1 AS shard", "'x' AS n", "2 AS part")
    same(lm_score.score(df, **options).collect(), brute(EDGES))


def test_large_counts(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "COUNT_BITS", 3)
    same(lm_score.score(spark.createDataFrame(EDGES, "doc_id long, text string"), shard_bytes=10).collect(), brute(EDGES))


def test_rows_follow_the_text(spark):
    """n-gram rows grow with the text, not with shards times partitions."""
    df = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(50))) for k in range(64)], "doc_id long, text string")
    sizes = [lm_score.shard_grams(lm_score.sharded(df.limit(n).coalesce(1), 100), 3, 1, 0).count() for n in (16, 64)]
    assert sizes == [16 * (50 + 49 + 48), 64 * (50 + 49 + 48)]


def test_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    same(lm_score.score(docs).collect(), brute([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]))


def test_empty(spark):
    assert lm_score.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
