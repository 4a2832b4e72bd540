"""Importance resampling towards a target (Xie et al., 2023) with word tries local to a partition.

Features are all runs of 1 to `order` consecutive words, hashed into buckets by
crc32. Each task builds tries over stretches of its texts: the first level
holds the words, every further level the words that follow. A node holds how
often its feature stands in the stretch and the CRC state of its bytes, so a
feature's bytes are hashed once a stretch, from its parent's state on. The
counts of the nodes go to bucket totals, which Spark adds up: a task sends at
most one row a bucket. A bucket's gain compares its share of the target with
its share of all documents. To score, the tries of a stretch are built again
with the gains attached to their nodes, and each document adds up the gains on
the paths that its words walk.

Drawing without replacement adds Gumbel noise, made from the document's id, to
its weight and takes the highest sums. Ranks come from the counts of equal
scores, a table bounded by the range of scores (about 10^5 rows), and from the
order inside a score; the noise spreads documents over scores (at most one in
2700 meets in one), so no window holds more than that share.

A trie covers about STEP_BYTES of text and is then dropped, so memory is
bounded; a longer text is cut between words and carries its last words over.
Words are told apart in a stretch by 64-bit hashes.

Words are runs of digits, lower-cased A-Z letters and characters beyond ASCII.
Defined cases: null, empty or word-free text has no features and weight 0; it
is ranked if `min_words` is 0; equal scores rank by id, null ids first, and
repeated rows one after the other; a null id gets the noise of the id "null";
an empty target has no feature; an empty table gives no rows; columns named
rs_* are replaced, others pass through.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.llm.common import add_arrays, pack_bounds, text_buffers, with_columns
from heronry.llm.decontaminate import LOWER, WORD_BYTE, hash_words
from heronry.session import fresh_path

ORDER = 2
BUCKETS = 10_000
SEED = 7
PERCENT = 25
MIN_WORDS = 20
STEP_BYTES = 2 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 48

ADDED = [T.StructField(f"rs_{name}", T.LongType()) for name in ("n_words", "n_features", "weight")]


def crc_table() -> np.ndarray:
    """The byte table of the reflected polynomial 0xEDB88320."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


TABLE = crc_table()


def advance(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC states after the bytes [start, end) of `raw`."""
    state, size = state.copy(), ends - starts
    for k in np.nonzero(size > LONG_WORD)[0].tolist():
        state[k] = zlib.crc32(raw[starts[k] : ends[k]].tobytes(), int(~state[k])) ^ 0xFFFFFFFF
    live = np.nonzero((size > 0) & (size <= LONG_WORD))[0]
    for at in range(LONG_WORD):
        live = live[size[live] > at]
        if not len(live):
            break
        state[live] = TABLE[(state[live] ^ raw[starts[live] + at]) & 0xFF] ^ (state[live] >> np.uint32(8))
    return state


class Trie:
    """The trie of a stretch of words. `doc` is the text of each word; a feature counts where its last word is `fresh`."""

    def __init__(self, raw: np.ndarray, words: np.ndarray, doc: np.ndarray, starts: np.ndarray, ends: np.ndarray, fresh: np.ndarray, order: int):
        _, first, word = np.unique(words, return_index=True, return_inverse=True)
        node, parent_at = word, np.arange(len(words))
        state = advance(np.full(len(first), 0xFFFFFFFF, np.uint32), raw, starts[first], ends[first])
        #: By level: the first word of each feature, its node, and the nodes' CRC states and counts.
        self.levels = [(parent_at, node, state, np.bincount(node[fresh], minlength=len(state)), fresh)]
        for k in range(1, order):
            at = parent_at[parent_at + k < len(words)]
            node = node[: len(at)]
            inside = doc[at] == doc[at + k]
            at, above = at[inside], node[inside]
            last = at + k
            _, one, node = np.unique(above * max(1, len(first)) + word[last], return_index=True, return_inverse=True)
            spaced = state[above[one]]
            spaced = TABLE[(spaced ^ np.uint32(32)) & 0xFF] ^ (spaced >> np.uint32(8))
            state = advance(spaced, raw, starts[last[one]], ends[last[one]])
            self.levels.append((at, node, state, np.bincount(node[fresh[last]], minlength=len(state)), fresh[last]))
            parent_at = at

    def add_to(self, totals: np.ndarray) -> None:
        for _, _, state, count, _ in self.levels:
            np.add.at(totals, ~state % np.uint32(len(totals)), count)

    def walk(self, doc: np.ndarray, gains: np.ndarray, n: np.ndarray, gained: np.ndarray) -> None:
        """Adds each text's features and their gains."""
        for at, node, state, _, counts in self.levels:
            attached = gains[~state % np.uint32(len(gains))]
            np.add.at(n, doc[at[counts]], 1)
            np.add.at(gained, doc[at[counts]], attached[node[counts]])


def stretches(column: pa.Array, order: int, step: int) -> Iterator[tuple]:
    """Yields (first row, rows, bytes, word hashes, row of each word from the first, starts, ends, fresh)."""
    offsets, raw = text_buffers(column)
    bounds = pack_bounds(np.diff(offsets), step)
    for a, b in zip(bounds, bounds[1:]):
        begin, end, carried = int(offsets[a]), int(offsets[b]), int(offsets[a])
        while True:
            to = end
            if b == a + 1 and end - begin > step:  # a long text: the next byte outside of words from here on
                to = begin + step
                while to < end and (inside := WORD_BYTE[LOWER[raw[to : to + 65536]]]).all():
                    to += len(inside)
                to = min(end, to + int(inside.argmin())) if to < end else end
            part = LOWER[raw[carried:to]]
            edges = np.clip(offsets[a : b + 1], carried, to) - carried
            words, doc, starts = hash_words(part, edges, places=True)
            breaks = np.union1d(np.nonzero(~WORD_BYTE[part])[0], edges)
            ends = breaks[np.searchsorted(breaks, starts, side="right")] if len(starts) else starts
            fresh = starts >= begin - carried
            yield a, b - a, part, words, doc, starts, ends, fresh
            if to >= end:
                break
            carried = to if order == 1 else carried + int(starts[-(order - 1)]) if len(starts) >= order - 1 else carried
            begin = to


def bucket_totals(texts: DataFrame, text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS, step_bytes: int = STEP_BYTES) -> np.ndarray:
    """How often the features of all texts fall in each bucket."""

    def count(batches):
        totals = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, *trie in stretches(batch.column(0), order, step_bytes):
                if len(trie[1]):
                    Trie(*trie, order).add_to(totals)
        some = np.nonzero(totals)[0]
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(totals[some])], names=["bucket", "n"])

    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.collect():  # at most one row a bucket
        out[bucket] = n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's smoothed share over the source's) of each bucket."""
    s_all, t_all, buckets = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, target: DataFrame, *, text_col: str = "text", target_col: str = "text", order: int = ORDER, buckets: int = BUCKETS, step_bytes: int = STEP_BYTES) -> DataFrame:
    """`docs` with rs_n_words, rs_n_features and rs_weight, the floored mean gain of a document's features. Counts both tables at once."""
    source = bucket_totals(docs, text_col, order, buckets, step_bytes)
    gains = gains_of(source, bucket_totals(target, target_col, order, buckets, step_bytes))
    schema = with_columns(docs.schema, ADDED)

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.names.index(text_col))
            n_words, n, gained = (np.zeros(len(column), np.int64) for _ in range(3))
            for a, size, *trie in stretches(column.cast(pa.string()), order, step_bytes):
                if len(trie[1]):
                    doc = trie[2]
                    n_words[a : a + size] += np.bincount(doc[trie[5]], minlength=size)
                    Trie(*trie, order).walk(doc, gains, n[a : a + size], gained[a : a + size])
            weight = gained // np.maximum(n, 1)
            yield add_arrays(batch, schema, {"rs_n_words": pa.array(n_words), "rs_n_features": pa.array(n), "rs_weight": pa.array(weight)})

    return docs.mapInArrow(run, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel variate, floored, from the first 32 bits of sha256("seed:id")."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) with `rank` among the drawn; `scored` is read twice."""
    able = F.col("n_words") >= min_words
    of_score = scored.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("_n"))
    # One row a score: bounded by the range of scores, not by the documents.
    downwards = Window.orderBy(F.col("score").desc())
    of_score = of_score.select("score", (F.sum("_n").over(downwards) - F.col("_n")).alias("_above"), F.floor(F.sum("_n").over(downwards.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * percent / 100).alias("_drawn"))
    inside = F.row_number().over(Window.partitionBy("score", able).orderBy("doc_id", "n_features", "weight"))
    place = F.col("_above") + F.col("_inside")
    placed = scored.withColumn("_inside", inside).join(F.broadcast(of_score), "score", "left")
    return placed.withColumn("rank", F.when(able & (place <= F.col("_drawn")), place)).drop("_above", "_drawn", "_inside")


def report(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, **options) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank. Runs at once, and keeps its numbers in the shared folder."""
    path = fresh_path(docs.sparkSession, "resample")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    weighed = weigh(rows, target, **options).select("doc_id", *(F.col(f"rs_{x}").alias(x) for x in ("n_words", "n_features", "weight")))
    weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).write.parquet(path)
    scored = docs.sparkSession.read.schema("doc_id long, n_words long, n_features long, weight long, score long").parquet(path)
    return ranked(scored, percent, min_words).select("doc_id", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, **options) -> DataFrame:
    """The drawn documents with their own columns; rows that equal the last one drawn in score and id are all drawn."""
    last = report(docs, target, id_col=id_col, text_col=text_col, percent=percent, min_words=min_words, seed=seed, **options).agg(F.max_by(F.struct("score", "doc_id"), "rank").alias("x")).first()["x"]
    weighed = weigh(docs, target, text_col=text_col, **options)
    score, key = F.col("rs_weight") + noise(F.col(f"`{id_col}`").cast("long"), seed), F.col(f"`{id_col}`").cast("long")
    if last is None:
        return docs.limit(0)
    upto = key.isNull() if last["doc_id"] is None else key.isNull() | (key <= last["doc_id"])
    kept = weighed.filter((F.col("rs_n_words") >= min_words) & ((score > last["score"]) | ((score == last["score"]) & upto)))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
