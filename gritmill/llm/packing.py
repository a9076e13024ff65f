"""Packing of token ids into fixed windows by online sum-of-squares placement (Csirik et al., 1999-2006).

A shard is what one task reads. Each document's full windows go out whole; its rest goes into the fill level whose choice
makes the sum of squared counts of partly filled windows least, tracked in an array of counts by level. What is still
open when the shard ends is joined by cutting: fuller windows are topped up from the emptiest, and the last one is cut
into powers of two. So a shard has no padding at all, and shards share nothing: no shuffle, and a lost task is redone alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gritmill.llm.common import text_bytes
from gritmill.llm.tokens import pieces

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Windows by fill level. Items are (key, start, length); `done` collects (sequence, [items])."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity)]
        self.items: dict[int, list[tuple]] = {}
        self.next = 0
        self.done: list[tuple[int, list[tuple]]] = []

    def level_for(self, size: int) -> int:
        """The fill level (0: a new window) that minimises the sum of squared counts; of equals the fullest."""
        room = self.capacity - size
        counts = self.counts
        grown = counts[size : self.capacity + 1].copy()  # counts of the levels that result
        # squares change by 2 * (grown - counts) + 2; a new or a full window leaves out its own half
        change = 2 * (grown - counts[: room + 1]) + 2
        change[0] = 2 * grown[0] + 1
        if room:
            change[room] = -2 * counts[room] + 1
        else:
            change[0] = 0
        change[1:][counts[1 : room + 1] == 0] = np.iinfo(np.int64).max
        return room - int(np.argmin(change[::-1]))

    def place(self, item: tuple) -> None:
        size = item[2]
        level = self.level_for(size)
        if level:
            k = self.open[level].pop()
            self.counts[level] -= 1
            self.items[k].append(item)
        else:
            k, self.next = self.next, self.next + 1
            self.items[k] = [item]
        self._put(k, level + size)

    def _put(self, k: int, level: int) -> None:
        if level == self.capacity:
            self.done.append((k, self.items.pop(k)))
        else:
            self.open[level].append(k)
            self.counts[level] += 1

    def full(self, items: list[tuple]) -> None:
        self.done.append((self.next, items))
        self.next += 1

    def finish(self) -> None:
        """Tops up the fullest open windows with the items of the emptiest, cut where needed; the last rest is cut into powers of two."""
        left = [k for level in range(self.capacity) for k in self.open[level]]
        low, high = 0, len(left) - 1
        pool: list[tuple] = []
        while low <= high:
            k = left[high]
            high -= 1
            items = self.items.pop(k)
            room = self.capacity - sum(x[2] for x in items)
            while room and (pool or low <= high):
                if not pool:
                    pool = self.items.pop(left[low])[::-1]
                    low += 1
                key, start, n = pool.pop()
                take = min(n, room)
                items.append((key, start, take))
                room -= take
                if take < n:
                    pool.append((key, start + take, n - take))
            if room:
                pool = items[::-1]
                break
            self.done.append((k, items))
        rest = pool[::-1]
        while rest:
            size = 1 << min(sum(x[2] for x in rest).bit_length() - 1, self.capacity.bit_length() - 1)
            items, room = [], size
            while room:
                key, start, n = rest.pop(0)
                take = min(n, room)
                items.append((key, start, take))
                room -= take
                if take < n:
                    rest.insert(0, (key, start + take, n - take))
            self.full(items)


def _packer(path: str, capacity: int, end_id: int):
    schema = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])

    def pack(batches):
        tok = pieces(path)
        small, wide, end = f"<u{tok.width}", np.dtype("<u4"), int(end_id).to_bytes(tok.width, "little")
        shard = TaskContext.get().partitionId() << 36
        bins, held, k = SumOfSquares(capacity), {}, 0

        def rows():
            out = []
            for seq, items in bins.done:
                at = 0
                for key, start, n in items:
                    doc, total, base, ids, left = held[key]
                    crc = zlib.crc32(np.frombuffer(ids, small)[start - base : start - base + n].astype(wide).tobytes())
                    out.append((doc, start, n, crc, total, shard + seq, at))
                    at += n
                    if left == n:
                        del held[key]
                    else:
                        held[key] = (doc, total, base, ids, left - n)
            bins.done = []
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema) if out else None

        for b in batches:
            docs = b.column(0).to_pylist()
            for i, text in enumerate(text_bytes(b.column(1))):
                ids = tok.ids(text) + end
                n = len(ids) // tok.width
                whole = n - n % capacity
                # only the rest is held until its window is full
                for at in range(0, whole, capacity):
                    held[k] = (docs[i], n, at, ids[at * tok.width : (at + capacity) * tok.width], capacity)
                    bins.full([(k, at, capacity)])
                    k += 1
                if whole < n:
                    held[k] = (docs[i], n, whole, ids[whole * tok.width :], n - whole)
                    bins.place((k, whole, n - whole))
                    k += 1
                if len(bins.done) > 2000 and (out := rows()):
                    yield out
        bins.finish()
        if out := rows():
            yield out

    return pack


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null or empty text gives the end id alone. Repeated rows and null doc_ids are packed like any other, each row for
    itself. Other columns are not read; an empty table gives no rows. Sequences are full but for those that hold a power
    of two. State per shard: fewer than `capacity` ids of each open window, and the sum of squares keeps those few.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_packer(path, capacity, end_id), SCHEMA)
