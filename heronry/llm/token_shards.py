"""Training-order materialisation: token sequences in shuffled slots of fixed-stride binary shards.

Documents become sequences of `length` ids, cut from the documents of a task
laid end to end; the last one is filled with the pad id. Sequence i of n goes
to slot P(i), where P is a keyed Feistel permutation of the next power of
four, walked on until it falls below n; so the place of a sequence follows
from the key, n and i, and needs no sort of the corpus. i counts the sequences
in the order of the table's splits when the shards are made: another layout of
the splits makes other shards, and the shards that were written are what a
resumed reader goes by. Slots are cut in ranges of about `shard_bytes`; each
range is one partition and one file, in which the sequence of a slot stands at
(slot modulo sequences per shard) times the stride. A reader can go on at any
slot.

The first pass only counts the sequences of each task (one number a task
comes to the driver); the second encodes again and checks its count and a
checksum of its documents against the first, so a table or layout that changes
between the passes stops the job. Keeping the ids of the first pass would save
the second encoding, but they, the shuffle and the shards together would take
more than the disk's bound of three times the input. A shard is written under
a name of its own and renamed, so a task that runs again replaces it whole.

Defined cases: null or empty text is the end id alone; a null id is null in
the manifest; a very long text runs over many sequences; repeated rows are
encoded each; a vocabulary with ids beyond 16 bits is an error; an empty table
writes no shard; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm.common import pack_bounds, text_buffers
from heronry.llm.tokens import default_path, encode, in_16_bits
from heronry.session import fresh_path

LENGTH, END, PAD, KEY, ROUNDS = 2048, 1, 0, 20240101, 6
SHARD_BYTES = 128 << 20
#: Stands for a null id inside a task.
NO_ID = -(1 << 63)
STEP_BYTES = 4 << 20
MANIFEST = "slot long, shard long, byte_offset long, n_tokens long, ids_crc32 long, first_doc_id long"


def permute(index: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """Slot of each index: a permutation of 0 .. n-1."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(0, 1 << 64, rounds, dtype=np.uint64)

    def feistel(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(32)
            f *= np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((f >> np.uint64(29)) & mask)
        return left << np.uint64(half) | right

    out = feistel(np.asarray(index, np.uint64))
    while (over := np.nonzero(out >= n)[0]).size:
        out[over] = feistel(out[over])
    return out.astype(np.int64)


def sequences(batches, path: str, length: int):
    """Yields (ids of whole sequences as an array of rows, tokens in each, first document of each, running checksum)."""
    held, docs, crc = np.zeros(0, np.uint16), np.zeros(0, np.int64), 0
    for batch in batches:
        ids, texts = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False), batch.column(1)
        bounds = pack_bounds(np.diff(text_buffers(texts)[0]), STEP_BYTES)
        for a, b in zip(bounds, bounds[1:]):
            flat, count = encode(path, texts.slice(a, b - a).to_pylist(), END)
            crc = zlib.crc32(ids[a:b].astype("<i8").tobytes(), crc)
            held, docs = np.concatenate([held, in_16_bits(flat)]), np.concatenate([docs, np.repeat(ids[a:b], count)])
            n = len(held) // length
            yield held[: n * length].reshape(n, length), np.full(n, length), docs[: n * length : length], crc
            held, docs = held[n * length :], docs[n * length :]
    if len(held):
        row = np.full((1, length), PAD, np.uint16)
        row[0, : len(held)] = held
        yield row, np.array([len(held)]), docs[:1], crc


def qualified(spark, folder: str) -> str:
    """The folder with the scheme of the cluster's own file system, where it has none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + whole.removeprefix("file:") if re.match("file:/[^/]", whole) else whole


def materialise(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, key: int = KEY) -> DataFrame:
    """Writes shard-{k}.bin files to `folder` when it runs; one row per sequence: slot, shard, byte_offset, n_tokens, ids_crc32, first_doc_id."""
    path, stride = tokenizer or default_path(), 2 * length
    per_shard = max(1, shard_bytes // stride)
    folder = qualified(docs.sparkSession, folder)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        n, crc = 0, 0
        for ids, _, _, crc in sequences(batches, path, length):  # noqa: B007
            n += len(ids)
        yield pa.RecordBatch.from_pydict({"task": [TaskContext.get().partitionId()], "n": [n], "crc": [crc]})

    counts = {r["task"]: (r["n"], r["crc"]) for r in rows.mapInArrow(count, "task long, n long, crc long").collect()}
    first, total = {}, 0
    for task in sorted(counts):
        first[task] = total
        total += counts[task][0]
    n_shards = max(1, -(-total // per_shard))

    def place(batches):
        task = TaskContext.get().partitionId()
        at, crc, end = first.get(task, 0), 0, first.get(task, 0) + counts.get(task, (0, 0))[0]
        for ids, n, docs_of, crc in sequences(batches, path, length):
            if at + len(ids) > end:
                raise RuntimeError("the documents of a task changed between the passes")
            slot = permute(np.arange(at, at + len(ids)), total, key)
            at += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // per_shard), pa.array(n), pa.array(docs_of, mask=docs_of == NO_ID), pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary())], names=["slot", "shard", "n_tokens", "first_doc_id", "ids"])
        if (at, crc) != (end, counts.get(task, (0, 0))[1]):
            raise RuntimeError("the documents of a task changed between the passes")

    placed = rows.mapInArrow(place, "slot long, shard long, n_tokens long, first_doc_id long, ids binary")
    ranged = placed.repartitionById(n_shards, F.col("shard").cast("int")).sortWithinPartitions("slot")

    def write(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, shard = None, "", None
        try:
            for batch in batches:
                slots, n, docs_of, ids = (batch.column(k) for k in (0, 2, 3, 4))
                crcs = []
                for k, x in enumerate(ids.to_pylist()):
                    if out is None:
                        shard = int(batch.column(1)[k].as_py())
                        name = f"{base}/.shard-{shard:08d}-{uuid.uuid4().hex}"
                        out = store.open_output_stream(name)
                    out.write(x)
                    crcs.append(zlib.crc32(x))
                offset = (slots.to_numpy() % per_shard) * stride
                yield pa.RecordBatch.from_arrays([slots, batch.column(1), pa.array(offset), n, pa.array(crcs, pa.int64()), docs_of], names=[x.split()[0] for x in MANIFEST.split(", ")])
        finally:
            if out is not None:
                out.close()
        if out is not None:
            store.move(name, f"{base}/shard-{shard:08d}.bin")

    return ranged.mapInArrow(write, MANIFEST)


def read_slots(folder: str, start: int, n: int, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """Sequences of slots start .. start+n-1 as rows of ids."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    out, per_shard = [], max(1, shard_bytes // (2 * length))
    while n > 0:
        shard, place = divmod(start, per_shard)
        take = min(n, per_shard - place)
        with store.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
            data = f.read_at(take * 2 * length, place * 2 * length)
        out.append(np.frombuffer(data, "<u2").reshape(-1, length))
        start, n = start + take, n - take
    return np.concatenate(out) if out else np.zeros((0, length), np.uint16)


def report(docs: DataFrame) -> DataFrame:
    """Writes to a new folder beside the checkpoints; its manifest."""
    return materialise(docs, fresh_path(docs.sparkSession, "token-shards"))
