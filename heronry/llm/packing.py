"""Harmonic packing of token sequences.

Lengths fall into classes by the reciprocal of the capacity: class k holds
lengths in (capacity/(k+1), capacity/k], and a bin of class k takes exactly k
of them. Documents are cut so that nearly all pieces sit at the upper end of
their class, where k of them fill a bin. Each task fills the bins of its own
classes and knows nothing of the others. What stands in open bins when a task
ends, less than one bin a class, is laid end to end and cut at the capacity,
and the last stretch is cut at powers of two, which need no padding.

A piece is held only while its bin is open; memory is bounded by the classes.
There is no shuffle. The sequence id is the task's number and a counter, so
a task that runs again gives the same rows.

Defined cases: null or empty text is one piece with the end id alone; rows
that repeat are packed each; a null id is kept; a very long text fills whole
bins and is encoded by itself; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm.common import pack_bounds, text_buffers
from heronry.llm.tokens import default_path, encode

CAPACITY = 2048
END = 1
#: A piece is left whole if its class wastes at most this share of a bin ...
WASTE = 1 / 64
#: ... or if it is as short as this.
SHORT = 128
#: Bytes of text that are encoded at once.
STEP_BYTES = 4 << 20

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(n: int, capacity: int = CAPACITY, waste: float = WASTE, short: int = SHORT) -> list[int]:
    """Piece lengths of a document of n ids."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if rest <= short or rest * k >= capacity * (1 - waste):
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


class Packer:
    """Bins of one task."""

    def __init__(self, task: int, capacity: int, with_ids: bool):
        self.next_id, self.capacity, self.with_ids = task << 33, capacity, with_ids
        self.open: dict[int, list] = {}
        self.plans: dict[int, list[int]] = {}
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, start = len(ids), 0
        rest = n % self.capacity
        if rest not in self.plans:
            self.plans[rest] = cuts(rest, self.capacity)
        for size in [self.capacity] * (n // self.capacity) + self.plans[rest]:
            piece = (doc_id, start, ids[start : start + size], n)
            start += size
            k = self.capacity // size
            if k == 1:
                self.close([piece])
                continue
            held = self.open.setdefault(k, [])
            held.append((*piece[:2], piece[2].copy(), n))
            if len(held) == k:
                self.close(held)
                self.open[k] = []

    def close(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            row = (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.next_id, offset)
            self.rows.append((*row, ids.astype("<u4").tobytes()) if self.with_ids else row)
            offset += len(ids)
        self.next_id += 1

    def finish(self) -> None:
        """Open bins end to end; pieces are cut where a sequence is full."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        total = sum(len(p[2]) for p in left)
        room = [self.capacity] * (total // self.capacity) + [1 << b for b in range(total.bit_length(), -1, -1) if total % self.capacity >> b & 1 and 1 << b < self.capacity]
        left.reverse()
        for size in room:
            bin_ = []
            while size:
                doc_id, start, ids, n = left.pop()
                bin_.append((doc_id, start, ids[:size], n))
                if len(ids) > size:
                    left.append((doc_id, start + size, ids[size:], n))
                size -= len(bin_[-1][2])
            self.close(bin_)

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece; `with_ids` adds its ids as little-endian 32-bit numbers."""
    path = tokenizer or default_path()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    schema = SCHEMA + (", ids binary" if with_ids else "")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + ([pa.array(columns[7], pa.binary())] if with_ids else [])
        return pa.RecordBatch.from_arrays(arrays, names=names + (["ids"] if with_ids else []))

    def run(batches):
        packer = Packer(TaskContext.get().partitionId(), capacity, with_ids)
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            bounds = pack_bounds(np.diff(text_buffers(texts)[0]), STEP_BYTES)
            for a, b in zip(bounds, bounds[1:]):
                flat, count = encode(path, texts.slice(a, b - a).to_pylist(), end)
                at = np.cumsum(count) - count
                for k, (s, n) in enumerate(zip(at.tolist(), count.tolist())):
                    packer.add(ids_of[a + k], flat[s : s + n])
                if len(packer.rows) >= 20_000:
                    yield batch_of(packer.take())
        packer.finish()
        if packer.rows:
            yield batch_of(packer.take())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
