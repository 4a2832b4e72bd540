"""Stupid-backoff scores of documents under the corpus's own n-gram counts.

A word's score is the count of its n-gram over that of its context, or 0.4
times the score of the next shorter n-gram where the n-gram is unknown
(Brants et al., 2007). A document doesn't vouch for itself: its own
occurrences are taken off every count, and what the others don't have is
unknown. At the bottom stands the word's share of all other words, or
`alpha` over the number of all words plus one for a word that only this
document has.

The work is three relations. Words: each document's words, as hashes in order,
are written once, numbered by shards of about SHARD_BYTES of text. Counts: the different n-grams of each shard are
rows (h, shard and n in one number), partitioned by the hash h and added up
there by a window, which is the grouping and its join to the shards' rows in
one sort; what other shards have too is written as a table of counts
(shard, h, total). Scores: the counts are joined by shard and hash to the
n-grams that are exploded from the documents, and summed per document. A
frequent n-gram has at most one row a shard (one for every 2^20 occurrences),
so no hash is hot. The hashes have 64 bits at any size of the table.

To bound the disk, the n-grams are counted in `passes` ranges of hashes, and
the shards are scored in as many parts; each frees its shuffle files before
the next begins. Rows are in proportion to the text; each pass reads the words.

Words are op1's: digits, lower-cased A-Z letters and characters beyond ASCII.
Defined cases: null or word-free text has no words, score 0 and a null mean;
repeated rows are separate documents, each vouching for the others; a very
long text shares its shard with the texts before it and is hashed in one piece; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.llm.common import pack_bounds, text_buffers
from heronry.llm.decontaminate import hash_words
from heronry.session import fresh_path, shuffles_dropped

ORDER = 3
ALPHA = 0.4
SHARD_BYTES = 6 << 20
PASSES = 6
#: Rows that go to a Python worker at once; words of a document take some kilobytes.
BATCH_ROWS = 2000
#: Bits of the count beside the shard's number; larger counts take several rows.
COUNT_BITS = 20
#: Bits of the shard's number in its task.
TASK_BITS = 16
#: Bytes of text that are hashed at once, and words that are scored at once.
STEP_BYTES, STEP_WORDS = 1 << 20, 1 << 17
#: words: 64-bit hashes, little-endian, one after another.
WORDS = "shard long, doc_id long, words binary"
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def grams(words: np.ndarray, doc: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 .. order: hash of the n-gram that ends at each word; 0 where the document is too short before it."""
    out = [np.where(words == 0, np.uint64(1), words)]
    for n in range(2, order + 1):
        h = np.zeros_like(words)
        same = np.nonzero(doc[n - 1 :] == doc[: len(doc) - n + 1])[0] + n - 1 if len(words) >= n else np.zeros(0, np.int64)
        x = out[-1][same - 1] * MIX[0] ^ (words[same] + np.uint64(n)) * MIX[1]
        x ^= x >> np.uint64(31)
        x *= MIX[1]
        x ^= x >> np.uint64(29)
        h[same] = np.where(x == 0, np.uint64(1), x)
        out.append(h)
    return out


def chunks(words: pa.Array, order: int):
    """Yields (first document, next document, words' documents, n-gram hashes by order) of consecutive documents; 0 stands for none."""
    words = words.cast(pa.large_binary())
    _, edges, data = words.buffers()
    offsets = np.frombuffer(edges, np.int64)[words.offset : words.offset + len(words) + 1] // 8 if len(words) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, "<u8") if data is not None and data.size else np.zeros(0, np.uint64)
    bounds = pack_bounds(np.diff(offsets), STEP_WORDS)
    for a, b in zip(bounds, bounds[1:]):
        doc = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
        yield a, b, doc, grams(flat[offsets[a] : offsets[b]], doc, order)


def count_words(parts: list[pa.Array], order: int, passes: int = 1, own: int = 0):
    """Yields (different n-grams of the range `own`, their counts) by order."""
    found: list[list] = [[] for _ in range(order)]
    low, high = (np.uint64(max(1, own * (1 << 64) // passes)), np.uint64((own + 1) * (1 << 64) // passes - 1))
    for part in parts:
        for _, _, _, hashes in chunks(part, order):
            for out, h in zip(found, hashes):
                out.append(h[(h >= low) & (h <= high)])
    for k in range(order):
        whole = np.concatenate(found[k]) if found[k] else np.zeros(0, np.uint64)
        found[k] = []
        yield np.unique(whole, return_counts=True)


def in_other_documents(doc: np.ndarray, h: np.ndarray, values: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """How often other documents have the n-gram that ends at each word; `whole`: how often all have the n-grams `values`."""
    out = np.zeros(len(h), np.int64)
    there = np.nonzero(h)[0]
    different, at, n = np.unique(h[there], return_inverse=True, return_counts=True)
    own = np.ones(len(there), np.int64)
    again = np.nonzero(n[at] > 1)[0]
    _, pair, times = np.unique(at[again] << 32 | doc[there[again]], return_inverse=True, return_counts=True)
    own[again] = times[pair]
    out[there] = whole[np.searchsorted(values, different)][at] - own
    return out


def score_documents(doc: np.ndarray, others: list[np.ndarray], n_docs: int, total: int, alpha: float):
    """Per document: words, words scored at each order (0: unknown), sum of natural logs; `others` by order."""
    n_words = np.bincount(doc, minlength=n_docs)
    size = total - n_words[doc]
    level = np.zeros(len(doc), np.int64)
    top = len(others)
    log = np.full(len(doc), top * np.log(alpha) - np.log(total + 1.0))
    seen = others[0] > 0
    log[seen] = np.log(others[0][seen] / size[seen]) + (top - 1) * np.log(alpha)
    level[seen] = 1
    for n in range(2, top + 1):
        seen = others[n - 1] > 0
        context = np.zeros(len(doc), np.int64)
        context[1:] = others[n - 2][:-1]
        log[seen] = np.log(others[n - 1][seen] / context[seen]) + (top - n) * np.log(alpha)
        level[seen] = n
    sums = np.bincount(doc, weights=log, minlength=n_docs).astype(np.float64)
    return n_words, [np.bincount(doc[level == n], minlength=n_docs) for n in range(top + 1)], sums


def sharded(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """(shard, doc_id, words) of each document (doc_id, text); the shards of a task follow one another."""

    def number(batches):
        first, size = TaskContext.get().partitionId() << TASK_BITS, 0
        for batch in batches:
            offsets, raw = text_buffers(batch.column(1))
            bounds = pack_bounds(np.diff(offsets), STEP_BYTES)
            for a, b in zip(bounds, bounds[1:]):
                part = offsets[a : b + 1]
                words, doc = hash_words(raw[part[0] : part[-1]], part - part[0])
                edges = np.searchsorted(doc, np.arange(b - a + 1))
                shard = np.minimum((size + part[:-1]) // shard_bytes, (1 << TASK_BITS) - 1)
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(8 * edges), pa.py_buffer(words.astype("<u8"))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(first + shard), batch.column(0).slice(a, b - a), data], names=["shard", "doc_id", "words"])
            size += int(offsets[-1])

    return docs.mapInArrow(number, WORDS)


def shard_grams(words: DataFrame, order: int, passes: int, own: int) -> DataFrame:
    """(h, told) of the different n-grams of each shard, of one range of hashes; told is the shard's number and, in the last COUNT_BITS, n."""
    most = (1 << COUNT_BITS) - 1

    def explode(batches):
        def rows():
            for h, n in count_words(parts, order, passes, own):
                while len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array((int(shard) << COUNT_BITS) + np.minimum(n, most))], names=["h", "told"])
                    h, n = h[n > most], n[n > most] - most

        shard, parts = None, []
        for batch in batches:
            shards = batch.column(0).to_numpy(zero_copy_only=False)
            starts = [0, *(np.nonzero(np.diff(shards))[0] + 1).tolist()]
            for s, e in zip(starts, [*starts[1:], len(shards)]):
                if e > s:
                    if shards[s] != shard:
                        yield from rows() if parts else ()
                        shard, parts = shards[s], []
                    parts.append(batch.column(1).slice(s, e - s))
        yield from rows() if parts else ()

    return words.select("shard", "words").mapInArrow(explode, "h long, told long")


def known_elsewhere(grams_of: DataFrame) -> DataFrame:
    """(shard, h, total) of the n-grams that other shards have too."""
    n = F.col("told").bitwiseAND((1 << COUNT_BITS) - 1)
    counted = grams_of.withColumn("total", F.sum(n).over(Window.partitionBy("h")))
    return counted.filter(F.col("total") > n).select(F.shiftright("told", COUNT_BITS).alias("shard"), "h", "total")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA, shard_bytes: int = SHARD_BYTES, passes: int = PASSES) -> DataFrame:
    """One row per document: doc_id, n_words, n_unknown, n_1 .. n_order (words by the order they are scored at), log_score, mean_log_score.

    Runs at once, and leaves the scores in the shared folder.
    """
    spark = docs.sparkSession
    base = fresh_path(spark, "lm-score")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    names = ["n_unknown", *(f"n_{k}" for k in range(1, order + 1))]
    schema = "doc_id long, n_words long, " + ", ".join(f"{x} long" for x in names) + ", log_score double, mean_log_score double"
    part = F.pmod(F.xxhash64("shard"), F.lit(passes)).cast("int")

    def write(df: DataFrame, name: str, *by: str) -> None:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(f"{base}/{name}")

    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, str(BATCH_ROWS))
    with shuffles_dropped(spark):
        write(sharded(rows, shard_bytes), "words")
        words = spark.read.schema(WORDS).parquet(f"{base}/words")
        total = words.agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0
        total = int(total)
        for own in range(passes):
            known = known_elsewhere(shard_grams(words, order, passes, own)).withColumn("part", part)
            write(known.sortWithinPartitions("part", "shard", "h"), f"known/pass={own}", "part")

        def finish(key, frame, answers):
            own_words = frame["words"].combine_chunks()
            h, more = answers["h"].to_numpy().view(np.uint64), answers["total"].to_numpy()
            order_of = np.argsort(h)
            h, more = h[order_of], more[order_of]
            counts = []
            for values, whole in count_words([own_words], order):
                at = np.searchsorted(h, values)
                there = np.nonzero(h[np.minimum(at, len(h) - 1)] == values)[0] if len(h) else at[:0]
                whole[there] = more[at[there]]
                counts.append((values, whole))
            ints, sums = [np.zeros((order + 2, 0), np.int64)], [np.zeros(0)]
            for a, b, doc, hashes in chunks(own_words, order):
                others = [in_other_documents(doc, h, *x) if len(doc) else np.zeros(0, np.int64) for h, x in zip(hashes, counts)]
                n_words, levels, log = score_documents(doc, others, b - a, total, alpha)
                ints.append(np.stack([n_words, *levels]))
                sums.append(log)
            ints, sums = np.concatenate(ints, axis=1), np.concatenate(sums)
            mean = pa.array(np.round(sums / np.maximum(ints[0], 1), 6), mask=ints[0] == 0)
            columns = [frame["doc_id"].combine_chunks(), *(pa.array(x) for x in ints), pa.array(np.round(sums, 6)), mean]
            return pa.Table.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

        known = spark.read.schema("shard long, h long, total long, pass int, part int").parquet(f"{base}/known")
        for own in range(passes):
            asked = words.filter(part == own).groupBy("shard")
            write(asked.cogroup(known.filter(F.col("part") == own).select("shard", "h", "total").groupBy("shard")).applyInArrow(finish, schema), f"scores/part={own}")
    spark.conf.set(batch, before)
    drop(spark, f"{base}/words")
    drop(spark, f"{base}/known")
    return spark.read.schema(schema).parquet(*(f"{base}/scores/part={own}" for own in range(passes)))


def drop(spark, path: str) -> None:
    """Deletes a folder in the shared folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
