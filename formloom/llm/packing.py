"""Packing by the sum-of-squares rule.

A level array counts the partially filled windows of each fill level. A document (or what remains of
it after whole windows are cut off) goes where the sum of the squared counts grows least: into a window
of some level, or into a new one. That keeps many different levels open, so most windows fill exactly.
Each partition packs what it reads, holding only the level array and its open windows. When ``MOST_OPEN``
windows are open, and at its end, the emptiest are cut up to fill the fullest, which bounds memory; the
last one is cut into sequences whose lengths are powers of two, as those need no padding. Nothing is shuffled, so no group of documents can be hot.

Defined results: every document has at least its end token. A null text counts as empty. Rows that
repeat an id are packed each for itself. A very long text fills whole windows and leaves one rest. An empty
table gives no pieces; other columns, whatever their names, are not read. Sequence ids are unique but
not gapless: the partition's number and a counter inside it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.llm import bpe

WINDOW = 4096
END_ID = 2
BATCH_BYTES = 8_000_000
MOST_OPEN = 4096

Piece = tuple  # (row number, start, packed ids, tokens of the document)


class Packer:
    """Sum-of-squares packing of one stream of documents into windows."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list[Piece]]] = {}

    def level_for(self, size: int) -> int:
        """Level whose choice makes the sum of squared counts smallest; the fullest among equals."""
        room = self.window - size
        filled = np.flatnonzero(self.counts[1 : room + 1]) + 1
        # A window of a level moves to the level it then fills; a full one is not counted any more.
        after = 2 * self.counts[filled + size] + 1
        after[filled == room] = 0
        change = after - 2 * self.counts[filled] + 1
        fresh = 2 * int(self.counts[size]) + 1 if room else 0
        if len(filled) and change.min() <= fresh:
            return int(filled[np.flatnonzero(change == change.min())[-1]])
        return 0

    def add(self, row, ids: bytes) -> Iterator[list[Piece]]:
        """Place a document; yields the windows that are full by it."""
        total, step = len(ids) // 4, self.window * 4
        whole = len(ids) - len(ids) % step
        for at in range(0, whole, step):
            yield [(row, at // 4, ids[at : at + step], total)]
        rest = ids[whole:]
        if not rest:
            return
        size = len(rest) // 4
        level = self.level_for(size)
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
        else:
            window = []
        window.append((row, whole // 4, rest, total))
        if level + size == self.window:
            yield window
        else:
            self.open.setdefault(level + size, []).append(window)
            self.counts[level + size] += 1

    def merge(self) -> Iterator[list[Piece]]:
        """Fill the fullest open windows from the emptiest, cut freely; at most one stays open."""
        left = [(level, window) for level in sorted(self.open, reverse=True) for window in self.open[level]]
        low, high = 0, len(left) - 1
        while low < high:
            (level, window), (donor_level, donor) = left[low], left[high]
            size = min(self.window - level, donor_level)
            taken, rest = cut_off(donor, size)
            left[low], left[high] = (level + size, window + taken), (donor_level - size, rest)
            if not rest:
                high -= 1
            if level + size == self.window:
                yield left[low][1]
                low += 1
        self.counts[:] = 0
        self.open = {}
        if low == high:
            self.counts[left[low][0]] = 1
            self.open[left[low][0]] = [left[low][1]]

    def close(self) -> Iterator[list[Piece]]:
        """All open windows: full ones, then sequences of power-of-two lengths."""
        yield from self.merge()
        for level, (window,) in ((h, w) for h, w in self.open.items() if w):
            while level:
                size = 1 << (level.bit_length() - 1)
                taken, window = cut_off(window, size)
                yield taken
                level -= size


def cut_off(pieces: list[Piece], size: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``size`` tokens of some pieces, and the rest."""
    taken, rest = [], list(pieces)
    while size:
        row, start, ids, total = rest[0]
        n = min(size, len(ids) // 4)
        taken.append((row, start, ids[: 4 * n], total))
        rest[:1] = [(row, start + n, ids[4 * n :], total)] if 4 * n < len(ids) else []
        size -= n
    return taken, rest


def pack(encoded: DataFrame, id: str = "doc_id", ids: str = "ids", window: int = WINDOW, end_id: int | None = END_ID) -> DataFrame:
    """Pieces (id, start, length, piece_ids, doc_tokens, sequence_id, offset) of packed ids."""
    return _pack(encoded.select(F.col(id).alias("id"), F.col(ids).alias("given")), id, lambda packed: packed or b"", window, end_id)


def pack_texts(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int | None = END_ID) -> DataFrame:
    """The same pieces of texts, encoded and packed by one Python process per task."""
    return _pack(docs.select(F.col(id).alias("id"), F.col(text).alias("given")), id, lambda value: bpe.model(path).encode(value), window, end_id)


def _pack(given: DataFrame, id: str, encode: Callable[[object], bytes], window: int, end_id: int | None) -> DataFrame:
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    kind = given.schema["id"].dataType
    schema = T.StructType(
        [T.StructField("id", kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
         T.StructField("piece_ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
         T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, sequence = Packer(window), TaskContext.get().partitionId() << 32
        out: list[tuple] = []
        size, id_type = 0, None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

        def windows():
            nonlocal id_type
            for batch in batches:
                id_type = batch.column(0).type
                for doc, value in zip(batch.column(0), batch.column(1)):
                    yield from packer.add(doc.as_py(), encode(value.as_py()) + end)
                    if packer.counts.sum() > MOST_OPEN:
                        yield from packer.merge()
                batch = doc = value = None  # else they stay while the next batch is read
                pa.default_memory_pool().release_unused()
            yield from packer.close()

        for pieces in windows():
            offset = 0
            for doc, start, packed, total in pieces:
                out.append((doc, start, len(packed) // 4, packed, total, sequence, offset))
                offset += len(packed) // 4
                size += len(packed)
            sequence += 1
            if size > BATCH_BYTES:
                yield flush()
                out.clear()
                size = 0
        if out:
            yield flush()

    return given.mapInArrow(run, schema).withColumnRenamed("id", id)
