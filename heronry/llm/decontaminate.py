"""Benchmark decontamination with suffix arrays over shards of the training documents.

Each task cuts its documents into shards and sorts the word suffixes of each
shard (words as ranks, several to an integer key; only suffixes that still
tie are sorted on). Every suffix of every benchmark item is then found in
every shard by binary search, which gives all places of its first `window`
words. A longest match begins where a window stands in a document and in an
item after different words (or at either's start); only such pairs of places
are made, so a run of one repeated word has as many as it has words, and the
length of each is found by halving over sums of word hashes. Documents don't
move: there is no shuffle.

The benchmark is a stated query set. It is read in blocks of bounded bytes
(`block_bytes`), each prepared once on the driver, broadcast and searched over
all documents in turn, so a larger benchmark makes more passes, not a larger
broadcast.

A word is a run of digits, lower-cased A-Z letters and characters beyond
ASCII. Words are compared by 64-bit hashes; a wrong hit would need 13 words
in a row with one of them colliding.

Defined cases: null text has no words; an item without words has no window;
an item id of null is listed as "null"; items with the same text are all
listed, ids repeated in the benchmark once; a document never matches across
its end; repeated documents are each reported; a very long text is a shard of
its own, and texts of one repeated word take no more work than others; empty
tables give no rows or no hits; columns named dc_* are replaced, others pass
through.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.llm.common import ASCII_LOWER, add_arrays, as_row, pack_bounds, text_buffers, text_bytes, with_columns

SHARD_BYTES = 4 << 20
BLOCK_BYTES = 16 << 20

RUN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("doc_word", T.IntegerType()), T.StructField("item_word", T.IntegerType()), T.StructField("n_words", T.IntegerType())])
ADDED = [
    T.StructField("dc_n_words", T.LongType()),
    T.StructField("dc_runs", T.ArrayType(RUN)),
    T.StructField("dc_items", T.ArrayType(T.StringType())),
    T.StructField("dc_matches", T.ArrayType(MATCH)),
]

LOWER = np.frombuffer(ASCII_LOWER, dtype=np.uint8)
#: Digits, a-z and every byte of a character beyond ASCII.
WORD_BYTE = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
WEIGHT = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: What stands before a text's first word; never equal.
ITEM_START, DOC_START = np.uint64(0), np.uint64(1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


@cache
def powers(base: int, length: int) -> np.ndarray:
    out = np.full(length, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def roof(n: int) -> int:
    """A power of two over n, so that few tables of powers are kept."""
    return 1 << max(20, int(n).bit_length())


def hash_words(raw: np.ndarray, offsets: np.ndarray, places: bool = False):
    """(64-bit hash of each word, index of its text[, its first byte]) for the UTF-8 bytes of consecutive texts."""
    if not len(raw):
        return (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))[: 2 + places]
    low = LOWER[raw]
    word = WORD_BYTE[low]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    before = np.empty(len(raw), bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.nonzero(word & (~before | first[:-1]))[0]
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.nonzero(word & (~after | first[1:]))[0] + 1
    size = roof(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(WEIGHT[low] * powers(int(BASE), size)[: len(raw)], out=total[1:])
    h = (total[ends] - total[starts]) * powers(int(BASE_INVERSE), size)[starts]
    h ^= (ends - starts).astype(np.uint64) * WEIGHT[1]
    h ^= h >> np.uint64(32)
    h *= WEIGHT[2]
    return (h ^ (h >> np.uint64(29)), np.searchsorted(offsets, starts, side="right") - 1, starts)[: 2 + places]


class Queries:
    """The suffixes of a block of benchmark items, one for each different window, and where the windows stand."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        offsets, raw = text_buffers(pa.array(texts, pa.string()))
        self.words, item = hash_words(raw, offsets)
        self.ids = sorted(set(ids))
        id_of = np.searchsorted(np.array(self.ids, object), np.array(ids, object)) if ids else np.zeros(0, np.int64)
        self.starts = np.searchsorted(item, np.arange(len(ids)))
        self.ends = np.searchsorted(item, np.arange(len(ids)), side="right")
        size = self.ends - self.starts
        place = np.arange(len(self.words))
        length = np.minimum(window, size[item])
        begins = place + length <= self.ends[item]
        place, length, item = place[begins], length[begins], item[begins]
        lanes = np.stack([self.rolled(place, length, WEIGHT[k]) for k in (3, 4)], axis=1) if len(place) else np.zeros((0, 2), np.uint64)
        _, first, which = np.unique(lanes, axis=0, return_index=True, return_inverse=True)
        which = which.reshape(-1)
        self.at = np.stack([place[first], length[first]], axis=1) if len(place) else np.zeros((0, 2), np.int64)
        self.depth = int(self.at[:, 1].max()) if len(self.at) else 0
        # Of each window: its different ids, and its places in all items, sorted by the word before each (START at an item's start).
        pairs = np.unique(np.stack([which, id_of[item]], axis=1), axis=0) if len(place) else np.zeros((0, 2), np.int64)
        self.id_edge, self.id_list = np.searchsorted(pairs[:, 0], np.arange(len(self.at) + 1)), pairs[:, 1]
        begins = place == self.starts[item]
        before = np.where(begins, ITEM_START, self.words[np.maximum(place - 1, 0)]) if len(place) else np.zeros(0, np.uint64)
        order = np.lexsort((before, which))
        self.place_list, self.place_item, self.id_of_item = place[order], item[order], id_of
        self.place_edge = np.searchsorted(which[order], np.arange(len(self.at) + 1))
        self.before = np.unique(before)
        self.place_key = which[order] * (len(self.before) + 1) + np.searchsorted(self.before, before[order])

    def heads(self, which: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into `which`, place in place_list) of the places of each window that follow another word than `before`."""
        begin, end = self.place_edge[which], self.place_edge[which + 1]
        rank = np.searchsorted(self.before, before)
        known = self.before[np.minimum(rank, len(self.before) - 1)] == before
        key = which * (len(self.before) + 1) + rank
        low = np.where(known, np.searchsorted(self.place_key, key), end)
        high = np.where(known, np.searchsorted(self.place_key, key, side="right"), end)
        first, count = np.concatenate([begin, high]), np.concatenate([low - begin, end - high])
        own = np.repeat(np.tile(np.arange(len(which)), 2), count)
        return own, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)

    def rolled(self, place: np.ndarray, length: np.ndarray, base: np.uint64) -> np.ndarray:
        """64-bit hash of the words of each window."""
        out = length.astype(np.uint64)
        for k in range(int(length.max())):
            inside = np.nonzero(k < length)[0]
            x = (out[inside] ^ self.words[place[inside] + k]) * base
            out[inside] = x ^ (x >> np.uint64(31))
        return out


def listed(edge: np.ndarray, values: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into `which`, value) of the values that each of `which` has."""
    count = edge[which + 1] - edge[which]
    own = np.repeat(np.arange(len(which)), count)
    return own, values[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(edge[which], count)]


class Shard:
    """Suffix array of the words of some documents, sorted to a depth; a stop stands after each document."""

    def __init__(self, words: np.ndarray, doc: np.ndarray, n_docs: int, depth: int):
        self.n_words = np.bincount(doc, minlength=n_docs)
        self.first = np.cumsum(self.n_words) - self.n_words + np.arange(n_docs)  # where each document starts, stops counted
        self.vocabulary, rank = np.unique(words, return_inverse=True)
        bits = (len(self.vocabulary) + 2).bit_length()
        self.bits, self.per = bits, max(1, 62 // bits)
        self.ranks = np.zeros(len(words) + n_docs + depth + self.per + 1, np.int64)
        where = np.arange(len(words)) + doc
        self.ranks[where] = rank + 1
        n = len(words) + n_docs
        self.keys = np.zeros(len(self.ranks), np.int64)
        for k in range(self.per):
            self.keys[:n] |= self.ranks[k : n + k] << (bits * (self.per - 1 - k))
        sa = where[np.argsort(self.keys[where], kind="stable")]
        new = np.ones(len(sa), bool)
        new[1:] = np.diff(self.keys[sa]) != 0
        for d in range(self.per, depth, self.per):
            group = np.cumsum(new)
            tied = ~new
            tied[:-1] |= ~new[1:]
            at = np.nonzero(tied)[0]
            if not len(at):
                break
            sub, own = sa[at], group[at]
            key = self.keys[np.minimum(sub + d, len(self.keys) - 1)]
            order = np.lexsort((key, own))
            sa[at], key = sub[order], key[order]
            new[at[1:]] |= (np.diff(key) != 0) & (np.diff(own) == 0)
        self.sa = sa

    def rank_of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.ones(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, len(self.vocabulary) + 1)

    def find(self, ranks: np.ndarray, at: np.ndarray):
        """Range in the suffix array of each query (place in `ranks`, number of words), by binary search key after key."""
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.sa), np.int64)
        deepest = int(at[:, 1].max()) if len(at) else 0
        padded = np.concatenate([ranks, np.zeros(self.per + deepest, np.int64)])
        for d in range(0, deepest, self.per):
            left = np.clip(at[:, 1] - d, 0, self.per)
            low = np.zeros(len(at), np.int64)
            for k in range(self.per):
                low |= np.where(k < left, padded[at[:, 0] + d + k], 0) << (self.bits * (self.per - 1 - k))
            high = low + (np.int64(1) << (self.bits * (self.per - left)))
            live = np.nonzero((left > 0) & (lo < hi))[0]
            a, b = self.bound(low[live], lo[live], hi[live], d), self.bound(high[live], lo[live], hi[live], d)
            lo[live], hi[live] = a, b
        return lo, hi

    def bound(self, key: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: int) -> np.ndarray:
        """First place in [lo, hi) whose key `d` words on isn't below `key`."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := np.nonzero(lo < hi)[0]).size:
            mid = (lo[open_] + hi[open_]) >> 1
            below = self.keys[self.sa[mid] + d] < key[open_]
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
        return lo


def search(words: np.ndarray, doc: np.ndarray, n_docs: int, q: Queries):
    """Words per document; (document, start, end) of hit runs; (document, item); matches (document, item, word, item's word, length)."""
    shard = Shard(words, doc, n_docs, q.depth)
    ranks = shard.rank_of(q.words)
    lo, hi = shard.find(ranks, q.at)
    found = np.nonzero(lo < hi)[0]
    none = np.zeros((0, 3), np.int64), np.zeros((0, 2), np.int64), np.zeros((0, 5), np.int64)
    if not len(found):
        return shard.n_words, *none
    count = hi[found] - lo[found]
    which = np.repeat(found, count)
    places = shard.sa[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[found], count)]
    edge = np.zeros(len(shard.ranks) + 1, np.int32)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + q.at[which, 1], -1)
    hit = np.cumsum(edge) > 0
    turn = np.diff(np.concatenate([[False], hit]).astype(np.int8))
    starts, ends = np.nonzero(turn == 1)[0], np.nonzero(turn == -1)[0]
    where = np.searchsorted(shard.first, starts, side="right") - 1
    runs = np.stack([where, starts - shard.first[where], ends - shard.first[where]], axis=1)
    in_doc = np.searchsorted(shard.first, places, side="right") - 1
    order = np.lexsort((places, which, in_doc))
    in_doc, which, places = in_doc[order], which[order], places[order]
    once = np.ones(len(order), bool)
    once[1:] = (np.diff(in_doc) != 0) | (np.diff(which) != 0)
    own, ids = listed(q.id_edge, q.id_list, which[once])
    doc_items = np.unique(np.stack([in_doc[once][own], ids], axis=1), axis=0)
    rank_before = np.where(places == shard.first[in_doc], 0, shard.ranks[np.maximum(places - 1, 0)])
    own, at = q.heads(which, np.where(rank_before == 0, DOC_START, shard.vocabulary[np.maximum(rank_before - 1, 0)]))
    in_doc, places, item, item_word = in_doc[own], places[own], q.place_item[at], q.place_list[at]
    most = np.minimum(shard.first[in_doc] + shard.n_words[in_doc] - places, q.ends[item] - item_word)
    size = agreed(sums_of(np.where(shard.ranks > 0, shard.vocabulary[np.maximum(shard.ranks - 1, 0)], np.uint64(0))), sums_of(q.words), places, item_word, most)
    whole = np.stack([in_doc, item, places - shard.first[in_doc], item_word - q.starts[item], size], axis=1)
    return shard.n_words, runs, doc_items, np.unique(whole, axis=0)


def sums_of(words: np.ndarray) -> np.ndarray:
    """Running sums of word hashes times powers of BASE, so that a difference tells a stretch of words."""
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum((words ^ (words >> np.uint64(33))) * powers(int(BASE), roof(len(words)))[: len(words)], out=out[1:])
    return out


def agreed(doc_sums: np.ndarray, item_sums: np.ndarray, doc_word: np.ndarray, item_word: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words agree from each pair of places on, within `most`, by halving."""
    back = powers(int(BASE_INVERSE), roof(max(len(doc_sums), len(item_sums))))
    low, high = np.zeros(len(most), np.int64), most.copy()
    while (live := np.nonzero(low < high)[0]).size:
        mid = (low[live] + high[live] + 1) >> 1
        p, i = doc_word[live], item_word[live]
        same = (doc_sums[p + mid] - doc_sums[p]) * back[p] == (item_sums[i + mid] - item_sums[i]) * back[i]
        low[live[same]], high[live[~same]] = mid[same], mid[~same] - 1
    return low


def nested(n: int, owner: np.ndarray, values: pa.Array) -> pa.Array:
    """A list column of n rows from values sorted by the row that owns them."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), values)


def annotate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with dc_n_words, dc_runs (hit words), dc_items (ids, sorted as strings) and dc_matches (longest verbatim matches)."""
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), F.col(item_text).cast("string").alias("text"))
    n_blocks = max(1, -(-text_bytes(items, "text") // block_bytes))
    base = docs
    for k in range(n_blocks):
        block = items if n_blocks == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == k)
        rows = block.collect()  # bounded by block_bytes
        sent = sc.broadcast(Queries([r[0] for r in rows], [r[1] for r in rows], window))
        schema = with_columns(base.schema, ADDED)

        def run(batches, sent=sent, schema=schema):
            q = sent.value
            for batch in batches:
                offsets, raw = text_buffers(batch.column(batch.schema.names.index(text_col)))
                bounds = pack_bounds(np.diff(offsets), shard_bytes)
                for a, b in zip(bounds, bounds[1:]):
                    part = offsets[a : b + 1]
                    words, doc = hash_words(raw[part[0] : part[-1]], part - part[0])
                    n, runs, doc_items, matches = search(words, doc, b - a, q)
                    ids = pa.array(q.ids, pa.string())
                    as32 = lambda x: pa.array(x.astype(np.int32))
                    added = {
                        "dc_n_words": pa.array(n.astype(np.int64)),
                        "dc_runs": nested(b - a, runs[:, 0], pa.StructArray.from_arrays([as32(runs[:, 1]), as32(runs[:, 2])], ["start", "end"])),
                        "dc_items": nested(b - a, doc_items[:, 0], ids.take(pa.array(doc_items[:, 1]))),
                        "dc_matches": nested(b - a, matches[:, 0], pa.StructArray.from_arrays([ids.take(pa.array(q.id_of_item[matches[:, 1]])), as32(matches[:, 2]), as32(matches[:, 3]), as32(matches[:, 4])], ["item_id", "doc_word", "item_word", "n_words"])),
                    }
                    yield add_arrays(batch.slice(a, b - a), schema, added)

        if k:
            old = {f.name: f"dc_old_{f.name}" for f in ADDED}
            base = base.withColumnsRenamed(old)
            schema = with_columns(base.schema, ADDED)
            base = base.mapInArrow(lambda batches, run=run, schema=schema: run(batches, schema=schema), schema)
            base = base.withColumns({
                "dc_runs": F.concat("dc_runs", F.col(old["dc_runs"])),
                "dc_items": F.concat("dc_items", F.col(old["dc_items"])),
                "dc_matches": F.concat("dc_matches", F.col(old["dc_matches"])),
            }).drop(*old.values())
        else:
            base = base.mapInArrow(run, schema)
    return base.withColumn("dc_items", F.array_sort(F.array_distinct("dc_items")))


def hit_words(runs: Column) -> Column:
    """Words in the union of the runs."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, r: F.struct(F.greatest(acc["upto"], r["end"]).alias("upto"), (acc["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(acc["upto"], r["start"]))).alias("n"))
    return F.aggregate(F.array_sort(runs), start, step)["n"]


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one word in twenty is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest match and its place."""
    found = annotate(docs.select(F.col(id_col).alias("doc_id"), F.col(options.pop("text_col", "text")).alias("text")), benchmark, **options)
    longest = F.array_max(F.transform("dc_matches", lambda m: F.struct(m["n_words"].alias("n"), (-m["doc_word"]).alias("at"), m["item_id"].alias("item"))))
    n_hit = hit_words(F.col("dc_runs"))
    return found.select(
        "doc_id",
        F.col("dc_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("dc_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "dc_items").cast("binary"), 256).alias("items_sha256"),
        contaminated(n_hit, F.col("dc_n_words")).alias("contaminated"),
        F.coalesce(longest["n"], F.lit(0)).cast("long").alias("longest_match"),
        (-longest["at"]).cast("long").alias("longest_at"),
        longest["item"].alias("longest_item"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    found = annotate(as_row(docs, text=options.pop("text_col", "text")), benchmark, **options)
    return found.filter(~contaminated(hit_words(F.col("dc_runs")), F.col("dc_n_words"))).select("row.*")
