"""Packing of token sequences by the sum-of-squares rule.

A document's ids, with an end id, are cut into full windows and a rest, and the rest at the last multiple of ``GRID`` ids; what is over
of all documents is gathered into cells of ``GRID`` ids. Rests and cells go to the
fill level at which the sum over levels of the squared number of partly filled windows
comes out least; those numbers stand in one array by level. With levels a grid apart few windows are open at any time, however
few the documents. A partition packs its own documents, so nothing is shuffled. At its end the windows that are still partly filled stay as they are,
the fullest first, and are filled up with pieces of the emptiest; the last one is cut into windows of powers of two. So no sequence needs padding.

Defined results. A null text counts as empty and gives the end id alone. Every id lies in exactly
one piece, with any number of repeated rows; each row is a document of its own, whatever its length. An
empty table gives no piece. Of equal sums the lowest level counts. Columns other than the id and the text are dropped.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .byte_bpe import encoder
from .common import buffers, slices

WINDOW = 2048
END_ID = 1
#: Ids between two fill levels.
GRID = 64
#: Sequence ids of a partition start from its number times this.
STRIDE = 1 << 36
PIECE = (("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()))


class SumOfSquares:
    """Online packing into windows of ``size`` levels; full windows are handed to ``close``."""

    def __init__(self, size: int, close) -> None:
        self.size, self.close = size, close
        #: By level from 0 to size: how many windows are filled so far.
        self.count = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)

    def place(self, items: list, length: int) -> None:
        """Put items of 1 to size levels in all into the window that the rule names."""
        size = self.size
        if length == size:
            self.close(items)
            return
        # From level h to h + length the sum of squares grows by 2 (n[h+length] - n[h]) + 2; a new
        # window adds 2 n[length] + 1, and one that gets full takes away 2 n[h] - 1.
        grow = 2 * (self.count[length:] - self.count[: size + 1 - length]) + 2
        grow[0] = 2 * self.count[length] + 1
        grow[size - length] = 1 - 2 * self.count[size - length]
        usable = self.count[: size + 1 - length] > 0
        usable[0] = True
        level = int(np.argmin(np.where(usable, grow, np.iinfo(np.int64).max)))
        window = self.open[level].pop() if level else []
        if level:
            self.count[level] -= 1
        window += items
        if level + length == size:
            self.close(window)
        else:
            self.count[level + length] += 1
            self.open[level + length].append(window)

    def rest(self) -> list[list]:
        """The windows that are still partly filled, the fullest first."""
        out = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open.clear()
        self.count[:] = 0
        return out


class Packer:
    """Documents, as (id, bytes of ids, start, number of ids) items, to sequences of at most ``window`` ids."""

    def __init__(self, window: int, close) -> None:
        self.window, self.close = window, close
        self.grid = math.gcd(window, GRID)
        self.rule = SumOfSquares(window // self.grid, close)
        self.over: list[tuple] = []
        self.held = 0
        #: Ids that the end moved from where the rule had put them, and all ids.
        self.moved = self.seen = 0

    def add(self, key, ids: bytes) -> None:
        total = len(ids) // 4
        self.seen += total
        full = total // self.window * self.window
        for start in range(0, full, self.window):
            self.close([(key, ids[4 * start : 4 * (start + self.window)], start, total)])
        edge = total // self.grid * self.grid
        if full < edge:
            self.rule.place([(key, ids[4 * full : 4 * edge], full, total)], (edge - full) // self.grid)
        if edge < total:
            self.over.append((key, ids[4 * edge :], edge, total))
            self.held += total - edge
            if self.held >= self.grid:
                self.rule.place(self._take(self.over, self.grid), 1)
                self.held -= self.grid

    @staticmethod
    def _take(items: list[tuple], room: int) -> list[tuple]:
        """``room`` ids from the end of ``items``, which lose them."""
        out = []
        while room:
            key, ids, start, total = items.pop()
            n = len(ids) // 4
            if n > room:
                items.append((key, ids[: 4 * (n - room)], start, total))
                ids, start, n = ids[4 * (n - room) :], start + n - room, room
            out.append((key, ids, start, total))
            room -= n
        return out

    def finish(self) -> None:
        size = lambda w: sum(len(i[1]) // 4 for i in w)
        open_ = [*self.rule.rest(), *([self.over] if self.over else [])]
        self.over, self.held = [], 0
        first, last = 0, len(open_) - 1
        while first < last:
            room, left = self.window - size(open_[first]), size(open_[last])
            n = min(room, left)
            open_[first] += self._take(open_[last], n)
            self.moved += n
            last -= n == left
            if n == room:
                self.close(open_[first])
                first += 1
        if first == last:
            left = size(open_[first])
            sizes = powers(left)
            self.moved += left if len(sizes) > 1 else 0
            for n in sizes:
                self.close(self._take(open_[first], n))


def powers(n: int) -> list[int]:
    """n as powers of two, the largest first."""
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` (and ``ids``)."""
    fields = [T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(n, t) for n, t in PIECE)]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        pieces: list[tuple] = []
        number = part * STRIDE
        kind = None

        def close(items: list) -> None:
            nonlocal number
            offset = 0
            for key, ids, start, total in items:
                n = len(ids) // 4
                pieces.append((key, start, n, zlib.crc32(ids), total, number, offset, ids))
                offset += n
            number += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*pieces, strict=True))
            arrays = [pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:7])]
            if with_ids:
                flat = np.frombuffer(b"".join(cols[7]), "<u4").astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(cols[2]))).astype(np.int32), pa.array(flat)))
            pieces.clear()
            return pa.RecordBatch.from_arrays(arrays, [f.name for f in fields])

        def encoded(batch: pa.RecordBatch):
            """(id, ids with the end id) of each row, a slice of texts at a time."""
            _, at = buffers(batch.column(1))
            for i, j in slices(at):
                rows = batch.slice(i, j - i)
                texts = [t or "" for t in rows.column(1).to_pylist()]
                for key, ids in zip(rows.column(0).to_pylist(), coder.many(texts), strict=True):
                    yield key, ids + end

        packer = Packer(window, close)
        for batch in batches:
            kind = batch.column(0).type
            for key, ids in encoded(batch):
                packer.add(key, ids)
                if len(pieces) >= 4096:
                    yield flush()
        packer.finish()
        if pieces:
            yield flush()

    return df.select(id_col, text_col).mapInArrow(run, schema)
