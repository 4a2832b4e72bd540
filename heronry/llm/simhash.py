"""Near-duplicate groups from SimHash fingerprints, by anchor-point covering.

A fingerprint has 64 bits. The anchors are the code words of the product of
two perfect binary Golay codes (23 bits each, covering radius 3); the other
18 bits are left free. If two fingerprints differ in at most `threshold`
bits, some word lies within half of it (rounded down) of the one and within
the rest of the other, and the anchor next to that word lies within the
covering radius plus these parts of both. So each fingerprint is replicated
to the anchors that it reaches over the smaller part, as a host, and over
the larger part, as a guest; comparing hosts with guests anchor by anchor
loses no link. For 3 bits these are 10 and 61 rows of 17 bytes a fingerprint
on average over 2^24 anchors, at any size of the table; carrying all of the
threshold on one side would take 302. Only different fingerprints are
replicated, so exact copies cost nothing.

An anchor with many hosts is dealt over a grid of tasks: its hosts over the
rows, its guests over the columns, so that each pair meets in one task and
no task holds all of them. A task holds only the hosts of one cell; guests
are read batch by batch, and only a star for each component goes out.

Defined cases: null or word-free text has fingerprint 0, linked like any
other; null ids belong to their group but never name it, and a group without
ids has a null component; repeated rows stay repeated; a very long text is
hashed in steps; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm.common import ASCII_LOWER, as_row
from heronry.operators.graphs import connected_components, cut

#: Generator of the Golay code [23,12,7], as bits of a polynomial, and its covering radius.
GOLAY, LENGTH, RADIUS = 0xAE3, 23, 3
#: First bits of the two blocks.
BLOCKS = (0, 23)
#: An anchor with more hosts is dealt over a grid of tasks.
HOT_HOSTS = 20_000
#: So many rows of hot anchors are broadcast at most; more are joined.
SMALL = 1 << 18
#: Groups of up to so many pairs are compared many at a time.
PAIRS = 4096
#: Most entries of one comparison matrix.
MATRIX = 1 << 22


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash of one text."""
    words = text.encode().translate(ASCII_LOWER).split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)  # one shingle: over half of one
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :])], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        part = hashes[k : k + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row (doc_id, text_hash, fp) per document; fp is the fingerprint as a signed long, text_hash 64 bits of the text."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


@cache
def code():
    """(remainders of the low bits, of the high bits, coset leader by remainder) of the Golay code."""
    degree = GOLAY.bit_length() - 1

    def remainder(x: int) -> int:
        for k in range(LENGTH - 1, degree - 1, -1):
            if x >> k & 1:
                x ^= GOLAY << (k - degree)
        return x

    unit = [remainder(1 << k) for k in range(LENGTH)]
    half = (LENGTH + 1) // 2

    def table(bits: list[int]):
        out = np.zeros(1 << len(bits), np.int64)
        for k, u in enumerate(bits):
            out[1 << k : 2 << k] = out[: 1 << k] ^ u
        return out

    low, high = table(unit[:half]), table(unit[half:])
    leader = np.zeros(1 << degree, np.int64)
    for n in range(RADIUS, -1, -1):
        for c in combinations(range(LENGTH), n):
            e = sum(1 << k for k in c)
            leader[low[e & ((1 << half) - 1)] ^ high[e >> half]] = e
    return half, low, high, leader


def leaders(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(remainder, flips to the code word next to it) of each x."""
    half, low, high, leader = code()
    s = low[x & ((1 << half) - 1)] ^ high[x >> half]
    return s, leader[s]


@cache
def reach(flips: int):
    """For each remainder: code words, relative to its own, that are next to a word within 0, 1, .. `flips`, as a padded array, and the flips each needs (99: none)."""
    leader = code()[3]
    found: list[dict[int, int]] = [{} for _ in leader]
    for n in range(flips + 1):
        for c in combinations(range(LENGTH), n):
            moved = leader ^ sum(1 << k for k in c)
            for s, w in enumerate((moved ^ leaders(moved)[1]).tolist()):
                found[s].setdefault(w, n)
    most = max(map(len, found))
    words, need = np.zeros((len(leader), most), np.int64), np.full((len(leader), most), 99, np.int8)
    for s, x in enumerate(found):
        words[s, : len(x)], need[s, : len(x)] = list(x), list(x.values())
    return words, need


def anchors(fp: np.ndarray, flips: int):
    """(anchor, index of the fingerprint) of all anchors that each fingerprint reaches."""
    words, need = reach(flips)
    at, by = [], []
    for first in BLOCKS:
        x = (fp >> np.uint64(first)).astype(np.int64) & ((1 << LENGTH) - 1)
        s, e = leaders(x)
        at.append((x ^ e)[:, None] ^ words[s])
        by.append(need[s])
    who, i, j = np.nonzero(by[0][:, :, None] + by[1][:, None, :] <= flips)
    return at[0][who, i] << LENGTH | at[1][who, j], who


def join_labels(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> None:
    """Makes `label` (the smallest index of each component) hold with the links a-b too."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label != (up := label[label])).any():
            label[:] = up


def compare_small(fp: np.ndarray, starts: np.ndarray, splits: np.ndarray, ends: np.ndarray, threshold: int):
    """Links of many small groups at once (hosts from starts, guests from splits, to ends): each guest's first host with the guest and with its other hosts."""
    n_hosts, n_guests = splits - starts, ends - splits
    count = n_hosts * n_guests
    group = np.repeat(np.arange(len(count)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    guest, host = splits[group] + within // n_hosts[group], starts[group] + within % n_hosts[group]
    far = fp[guest] ^ fp[host]
    met = np.nonzero((np.bitwise_count(far) <= threshold) & (far != 0))[0]
    guest, host = guest[met], host[met]
    first = np.diff(guest, prepend=-1) != 0
    leader = host[np.nonzero(first)[0]][np.cumsum(first) - 1] if len(met) else host
    return [(fp[np.where(first, guest, host)], fp[leader])]


class Cell:
    """The hosts of one cell of an anchor, and which of them belong together."""

    def __init__(self):
        self.parts, self.hosts, self.label = [], None, None

    def compare(self, guests: np.ndarray, threshold: int):
        """(guest, host) of one link for each guest that has any; hosts that share a guest come together."""
        if self.hosts is None:
            self.hosts = np.concatenate(self.parts)
            self.label = np.arange(len(self.hosts))
        for k in range(0, len(guests), step := max(1, MATRIX // len(self.hosts))):
            part = guests[k : k + step]
            j, i = np.nonzero(np.bitwise_count(part[:, None] ^ self.hosts[None, :]) <= threshold)
            start = np.nonzero(np.diff(j, prepend=-1))[0]
            join_labels(i, np.repeat(i[start], np.diff(np.append(start, len(j)))), self.label)
            yield part[j[start]], self.hosts[i[start]]

    def stars(self):
        """(host, first host of its component) of the hosts that guests have brought together."""
        if self.hosts is None:
            return []
        moved = np.nonzero(self.label != np.arange(len(self.label)))[0]
        return [(self.hosts[moved], self.hosts[self.label[moved]])]


def links(distinct: DataFrame, threshold: int = 3) -> DataFrame:
    """Star links (u, v) between different fingerprints (column fp) that meet at an anchor."""
    near = threshold // 2
    far = threshold - near
    if far > RADIUS:
        raise ValueError("the table of reached anchors is made for at most 6 differing bits")

    def replicate(batches, kinds):
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(whole), 1000):
                fp = whole[k : k + 1000]
                for guest, flips in kinds:
                    at, who = anchors(fp, flips)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), guest)), pa.array(fp[who].view(np.int64))], names=["anchor", "guest", "fp"])

    fps, kind = distinct.select("fp"), "anchor long, guest boolean, fp long"
    hosts = fps.mapInArrow(lambda batches: replicate(batches, [(False, near)]), kind)
    hot = cut(hosts.groupBy("anchor").count().filter(F.col("count") > HOT_HOSTS).select("anchor", F.ceil(F.col("count") / HOT_HOSTS).cast("int").alias("side")))
    rows = fps.mapInArrow(lambda batches: replicate(batches, [(False, near), (True, far)]), kind)
    n_hot = hot.count()
    if n_hot:
        own = F.pmod(F.xxhash64("fp"), F.col("side")).cast("int")
        cells = F.transform(F.sequence(F.lit(0), F.col("side") - 1), lambda k: F.when(F.col("guest"), k * F.col("side") + own).otherwise(own * F.col("side") + k))
        placed = rows.join(F.broadcast(hot) if n_hot <= SMALL else hot, "anchor", "left").withColumn("side", F.coalesce("side", F.lit(1)))
        rows = placed.select("anchor", F.explode(cells).alias("cell"), "guest", "fp")
    else:
        rows = rows.select("anchor", F.lit(0).alias("cell"), "guest", "fp")

    def compare(batches):
        key, cell = None, Cell()
        for batch in batches:
            at, number, guest, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(at):
                continue
            fp, found = fp.view(np.uint64), []
            starts = np.concatenate([[0], np.nonzero((np.diff(at) != 0) | (np.diff(number) != 0))[0] + 1])
            ends = np.append(starts[1:], len(at))
            guests = np.add.reduceat(guest.astype(np.int64), starts)
            splits = ends - guests  # hosts come first
            goes_on = np.zeros(len(starts), bool)
            goes_on[0], goes_on[-1] = (at[0], number[0]) == key, True  # the last group may go on in the next batch
            small = ~goes_on & (guests * (splits - starts) <= PAIRS)
            found += compare_small(fp, starts[small], splits[small], ends[small], threshold)
            for s, m, e in zip(*(x[~small].tolist() for x in (starts, splits, ends))):
                if (now := (at[s], number[s])) != key:
                    found += cell.stars()
                    key, cell = now, Cell()
                if m > s:
                    cell.parts.append(fp[s:m])
                if e > m and cell.parts:
                    found += cell.compare(fp[m:e], threshold)
            if found:
                yield batch_of(found)
        if last := cell.stars():
            yield batch_of(last)

    def batch_of(found: list) -> pa.RecordBatch:
        u, v = (np.concatenate(x).view(np.int64) for x in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    met = rows.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell", "guest")
    return met.mapInArrow(compare, "u long, v long").filter("u <> v").distinct()


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 3, shingle: int = 3) -> DataFrame:
    """One row (doc_id, text_hash, fp, root, component_id) per document; root is the smallest fingerprint of its group."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(cut(links(distinct, threshold))).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return fps.join(rooted.join(best, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per document: the smallest id reachable over links."""
    return grouped(docs, **options).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row of each group: that with the smallest id, rows without an id last; the smallest hash of the text settles ties.

    A row is known by its id and its text's hash, so different texts that share an id, or have none, are told apart.
    """
    found = grouped(docs, id_col=id_col, text_col=text_col)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("stay_id"), F.col("text_hash").alias("stay_hash"))).alias("first"))
    stay = first.select("first.stay_id", "first.stay_hash")
    rows = as_row(docs, id=id_col, text=text_col).select("row", F.col("id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    kept = rows.join(stay, F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("text_hash") == F.col("stay_hash")))
    return kept.dropDuplicates(["doc_id", "text_hash"]).select("row.*")
