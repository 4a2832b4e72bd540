"""Byte-level BPE with a lexicon of the corpus's frequent words, and back.

Text is cut into words by the vocabulary's rule, over arrays of code points.
Spark counts the words of all texts; those seen most often, at most
LEXICON_WORDS of them (whole steps of frequency, so no sort of the words is
needed), are encoded and compiled into a minimal acyclic transducer
(lexicon.py). Its file goes to the shared folder, Spark brings it to each
executor once, and the workers there map it into memory together. All words of
a stretch of text walk it at once; words that it doesn't hold are merged pair
by pair by rank, which is exact for any word, so the lexicon decides the speed
and never the ids.

The ids are those of the tokenizer file, truncation and padding aside: the
string of the special token in a text becomes its id. Letters, numbers and
white space are told by Python's tables; a code point that these don't know is
asked of the tokenizer file itself.

A long text is cut where a letter or digit, a blank and a letter or digit
follow one another (a word always begins at such a blank), so memory is bounded
for all texts that have blanks.

Defined cases: null text is empty; empty text has no ids; bytes that aren't
UTF-8 are read as U+FFFD, as the decoder does; null ids decode to the empty
text; repeated rows are encoded each; an empty table gives no rows; columns
named bpe_* are replaced, others pass through.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.llm.common import add_arrays, pack_bounds, text_buffers, with_columns
from heronry.llm.lexicon import MOST_BYTES, Lexicon, compiled
from heronry.session import fresh_path

#: Most words in the lexicon, and least occurrences of one.
LEXICON_WORDS, LEAST_COUNT = 1 << 16, 2
STEP_BYTES = 1 << 20
#: Different words that a counting task holds, and merged words that an encoding worker remembers.
HELD_WORDS = 1 << 17
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255
#: White space in the vocabulary's rule (fixed values).
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Where a long text may be cut: before the blank.
CUT = re.compile(rb"[0-9A-Za-z](?= [0-9A-Za-z])")

IDS = T.StructField("bpe_ids", T.ArrayType(T.IntegerType(), False))
TEXT = T.StructField("bpe_text", T.StringType())


def default_path() -> str:
    """The vocabulary of 50,257 ids among the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The byte of each letter in which a byte-level vocabulary is written: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Merges, ids and bytes of a tokenizer file."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, ids = byte_letters(), file["model"]["vocab"]
        as_bytes = {i: bytes(letters[x] for x in token) for token, i in ids.items() if all(x in letters for x in token)}
        self.special = {t["content"].encode(): t["id"] for t in file["added_tokens"]}
        as_bytes |= {i: token for token, i in self.special.items()}
        self.first = [ids[letter] for letter, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        size = max(as_bytes) + 1
        self.lengths = np.array([len(as_bytes.get(i, b"")) for i in range(size)], np.int64)
        self.edges = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(as_bytes.get(i, b"") for i in range(size)), np.uint8)
        self.remembered: dict[bytes, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of any word: of neighbouring pairs the one of lowest rank is merged, the leftmost first."""
        ids, merges = [self.first[b] for b in word], self.merges
        if len(ids) > 64:
            return self.merge_long(ids)
        while len(ids) > 1:
            best, at = None, -1
            for k in range(len(ids) - 1):
                found = merges.get((ids[k], ids[k + 1]))
                if found is not None and (best is None or found[0] < best[0]):
                    best, at = found, k
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs over linked places."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], k, ids[k], ids[k + 1], m[1]) for k in range(n - 1) if (m := self.merges.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            right = after[k]
            if ids[k] != a or right >= n or ids[right] != b:
                continue
            ids[k], ids[right], after[k] = new, -1, after[right]
            if after[k] < n:
                before[after[k]] = k
                if (m := self.merges.get((new, ids[after[k]]))) is not None:
                    heapq.heappush(heap, (m[0], k, new, ids[after[k]], m[1]))
            if (left := before[k]) >= 0 and (m := self.merges.get((ids[left], new))) is not None:
                heapq.heappush(heap, (m[0], left, ids[left], new, m[1]))
        return [i for i in ids if i >= 0]

    def ids_of(self, word: bytes) -> list[int]:
        """`merge`, remembering short words up to a bound."""
        found = self.remembered.get(word)
        if found is None:
            found = self.merge(word)
            if len(word) <= MOST_BYTES:
                if len(self.remembered) >= HELD_WORDS:
                    self.remembered.clear()
                self.remembered[word] = found
        return found

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids; an id outside of the vocabulary has none."""
        ids = ids[(ids >= 0) & (ids < len(self.lengths))]
        size = self.lengths[ids]
        ends = np.cumsum(size)
        return self.bytes[np.arange(ends[-1] if len(ids) else 0) - np.repeat(ends - size, size) + np.repeat(self.edges[ids], size)]


@cache
def vocabulary(path: str) -> Vocabulary:
    """One a worker process."""
    return Vocabulary(path)


@cache
def classes() -> np.ndarray:
    """The class of each code point; UNKNOWN where Python's tables have none."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((UNKNOWN if (c := unicodedata.category(chr(k))) == "Cn" else kinds.get(c[0], OTHER) for k in range(0x110000)), np.uint8, 0x110000)
    table[SPACES] = SPACE
    return table


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def classes_of(points: np.ndarray, path: str) -> np.ndarray:
    """Classes of code points; unknown ones are asked of the tokenizer file, by which neighbour they form a word with."""
    table = classes()
    found = table[points]
    unknown = np.unique(points[found == UNKNOWN])
    if len(unknown):
        cut = tokenizer(path).pre_tokenizer.pre_tokenize_str
        for c in unknown.tolist():
            joined = [len(cut(x + chr(c))) == 1 for x in ("a", "1")]
            table[c] = LETTER if joined[0] else NUMBER if joined[1] else OTHER
        found = table[points]
    return found


def cut_words(raw: np.ndarray, edges: np.ndarray, path: str) -> np.ndarray:
    """First bytes of the words of consecutive texts (UTF-8 bytes, with the texts' edges)."""
    at = np.nonzero((raw & 0xC0) != 0x80)[0]
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind, blank = classes_of(points, path), points == 32
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, edges)] = True
    first = first[:n]
    first[0] = True
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    # The last white space before other characters begins a word, and a blank takes these along.
    before = np.nonzero(run[1:] & ~first[1:] & (kind[:-1] == SPACE))[0]
    start[before] = True
    start[before[blank[before]] + 1] = False
    # 's 't 're 've 'm 'll 'd: an apostrophe by itself, with no blank before it, takes the letters along.
    mark = np.nonzero((points[:-1] == 39) & start[:-1] & run[1:] & ~first[1:] & (kind[1:] == LETTER))[0]
    if len(mark):
        a, b = points[mark + 1], points[np.minimum(mark + 2, n - 1)]
        two = (mark + 2 < n) & ~first[np.minimum(mark + 2, n - 1)]
        is_ = lambda x, c: x == ord(c)
        long_ = two & ((is_(a, "r") & is_(b, "e")) | (is_(a, "v") & is_(b, "e")) | (is_(a, "l") & is_(b, "l")))
        short = is_(a, "s") | is_(a, "t") | is_(a, "m") | is_(a, "d")
        taken = mark[short | long_]
        start[taken + 1] = False
        end = taken + np.where(short, 2, 3)[short | long_]
        start[end[end < n]] = True
    return at[start]


def valid(column: pa.Array) -> pa.Array:
    """The column as UTF-8; bytes that aren't are replaced."""
    offsets, raw = text_buffers(column)
    try:
        raw.tobytes().decode("utf-8")
        return column
    except UnicodeDecodeError:
        return pa.array([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:])], pa.large_string())


def stretches(column: pa.Array, vocab: Vocabulary, step: int) -> Iterator[tuple]:
    """Yields (first row, rows, bytes, rows' edges, first byte of each word, of each word the special id or -1) of consecutive texts, or of a part of a long one."""
    offsets, raw = text_buffers(valid(column))
    bounds = pack_bounds(np.diff(offsets), step)
    for a, b in zip(bounds, bounds[1:]):
        begin, end = int(offsets[a]), int(offsets[b])
        while True:
            to = end
            if b == a + 1 and end - begin > step:
                found = CUT.search(raw[begin + step : end].tobytes())
                to = begin + step + found.end() if found else end
            part = raw[begin:to]
            edges = np.clip(offsets[a : b + 1], begin, to) - begin
            whole, fixed, data = edges, [], part.tobytes()
            for token, i in vocab.special.items():
                place = data.find(token)
                while place >= 0:
                    inside = np.searchsorted(edges, place, side="right")
                    if inside < len(edges) and place + len(token) <= edges[inside]:
                        fixed.append((place, place + len(token), i))
                    place = data.find(token, place + len(token))
            if fixed:
                whole = np.union1d(edges, [x for f in fixed for x in f[:2]])
            words = cut_words(part, whole, vocab.path)
            special = np.full(len(words), -1, np.int64)
            for x, y, i in fixed:
                k = np.searchsorted(words, x)
                special[k] = i
                gone = np.searchsorted(words, y)
                words, special = np.delete(words, slice(k + 1, gone)), np.delete(special, slice(k + 1, gone))
            yield a, b - a, part, edges, words, special
            if to >= end:
                break
            begin = to


def encode_words(raw: np.ndarray, words: np.ndarray, special: np.ndarray, vocab: Vocabulary, lexicon: Lexicon | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each word)."""
    ends = np.append(words[1:], len(raw))
    place = lexicon.places(raw, words, ends) if lexicon is not None else np.full(len(words), -1, np.int64)
    place[special >= 0] = -1
    count = np.zeros(len(words), np.int64)
    known = np.nonzero(place >= 0)[0]
    if len(known):
        count[known] = lexicon.edges[place[known] + 1] - lexicon.edges[place[known]]
    others = np.nonzero(place < 0)[0]
    merged = [[i] if i >= 0 else vocab.ids_of(raw[a:b].tobytes()) for a, b, i in zip(words[others].tolist(), ends[others].tolist(), special[others].tolist())]
    count[others] = [len(x) for x in merged]
    to = np.cumsum(count) - count
    ids = np.empty(int(count.sum()), np.int32)
    if len(known):
        size = count[known]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        ids[np.repeat(to[known], size) + step] = lexicon.ids[np.repeat(lexicon.edges[place[known]], size) + step]
    if len(others):
        size = count[others]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        ids[np.repeat(to[others], size) + step] = np.fromiter((i for x in merged for i in x), np.int32, int(size.sum()))
    return ids, count


def encoded(column: pa.Array, vocab: Vocabulary, lexicon: Lexicon | None, step: int) -> Iterator[tuple[int, np.ndarray]]:
    """Yields (row, ids) in order; a long text comes in several parts."""
    for a, rows, raw, edges, words, special in stretches(column, vocab, step):
        ids, count = encode_words(raw, words, special, vocab, lexicon)
        upto = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(words, edges)]
        for k in range(rows):
            yield a + k, ids[upto[k] : upto[k + 1]]


def frequent_words(texts: DataFrame, tokenizer_path: str, most: int = LEXICON_WORDS, least: int = LEAST_COUNT, step_bytes: int = STEP_BYTES) -> list[bytes]:
    """The words of the column `text` seen most often, in whole steps of an eighth of a power of two, at most `most`; sorted."""
    spark = texts.sparkSession

    def count(batches):
        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["word", "n"])

        vocab, found = vocabulary(tokenizer_path), Counter()
        for batch in batches:
            for _, _, raw, _, words, special in stretches(batch.column(0), vocab, step_bytes):
                ends = np.append(words[1:], len(raw))
                some = (ends - words <= MOST_BYTES) & (special < 0)
                data = raw.tobytes()
                found.update([data[a:b] for a, b in zip(words[some].tolist(), ends[some].tolist())])
                if len(found) >= HELD_WORDS:
                    yield rows(found)
                    found.clear()
        if found:
            yield rows(found)

    path = fresh_path(spark, "words")
    counted = texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    counted.withColumn("step", F.floor(8 * F.log2("n")).cast("int")).write.parquet(path)
    counted = spark.read.schema("word binary, n long, step int").parquet(path)
    steps = sorted(counted.groupBy("step").count().collect(), reverse=True)  # at most 8 * 63 rows
    total, low = 0, None
    for step, n in steps:
        total += n
        if total > most:
            break
        low = step
    return [] if low is None else sorted(bytes(r[0]) for r in counted.filter(F.col("step") >= low).select("word").collect())  # at most `most`


def write_shared(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a file of the driver's to the shared folder."""
    path = fresh_path(spark, name)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(data))
    out.close()
    return path


def build_lexicon(docs: DataFrame, *, text_col: str = "text", tokenizer_path: str | None = None, most: int = LEXICON_WORDS, least: int = LEAST_COUNT, step_bytes: int = STEP_BYTES) -> str:
    """Compiles the frequent words of `docs`, and has Spark bring the file to every executor; returns its name there."""
    spark, path = docs.sparkSession, tokenizer_path or default_path()
    words = frequent_words(docs.select(F.col(text_col).cast("string").alias("text")), path, most, least, step_bytes)
    vocab = vocabulary(path)
    file = write_shared(spark, "lexicon", compiled(words, [vocab.merge(w) for w in words]).tobytes())
    spark.sparkContext.addFile(file)
    return file.rpartition("/")[2]


@cache
def mapped(name: str) -> Lexicon:
    """The transducer's file on this executor, mapped into memory."""
    return Lexicon(np.memmap(SparkFiles.get(name), np.int32, mode="r"))


def encode(docs: DataFrame, lexicon: str | None = None, *, text_col: str = "text", tokenizer_path: str | None = None, step_bytes: int = STEP_BYTES) -> DataFrame:
    """`docs` with bpe_ids; `lexicon` is what build_lexicon has returned."""
    path, schema = tokenizer_path or default_path(), with_columns(docs.schema, [IDS])

    def run(batches):
        vocab, words = vocabulary(path), mapped(lexicon) if lexicon else None
        for batch in batches:
            column = batch.column(batch.schema.names.index(text_col)).cast(pa.string())
            parts, size = [], np.zeros(len(column), np.int64)
            for k, ids in encoded(column, vocab, words, step_bytes):
                parts.append(ids)
                size[k] += len(ids)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))
            yield add_arrays(batch, schema, {"bpe_ids": lists})

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, *, ids_col: str = "bpe_ids", tokenizer_path: str | None = None) -> DataFrame:
    """`df` with bpe_text, the text of its ids."""
    path, schema = tokenizer_path or default_path(), with_columns(df.schema, [TEXT])

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            lists = batch.column(batch.schema.names.index(ids_col))
            texts = [vocab.decode(lists[k].values.to_numpy(zero_copy_only=False)).tobytes().decode("utf-8", "replace") if lists[k].is_valid else "" for k in range(len(lists))]
            yield add_arrays(batch, schema, {"bpe_text": pa.array(texts, pa.string())})

    return df.mapInArrow(run, schema)


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, step_bytes: int = STEP_BYTES, **options) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256. Counts words at once."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    path, name = tokenizer_path or default_path(), build_lexicon(rows, tokenizer_path=tokenizer_path, step_bytes=step_bytes, **options)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        vocab, words = vocabulary(path), mapped(name)
        for batch in batches:
            n, ids_hash, text_hash = np.zeros(batch.num_rows, np.int64), [], []
            for k, ids in encoded(batch.column(1), vocab, words, step_bytes):
                if k == len(ids_hash):
                    ids_hash.append(hashlib.sha256())
                    text_hash.append(hashlib.sha256())
                n[k] += len(ids)
                ids_hash[k].update(ids.astype("<u4").tobytes())
                text_hash[k].update(vocab.decode(ids).tobytes())  # whole words are whole characters
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array([h.hexdigest() for h in ids_hash], pa.string()), pa.array([h.hexdigest() for h in text_hash], pa.string())], names=names)

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
