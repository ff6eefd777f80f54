"""Token counts without token ids: pieces are counted once per distinct pre-token.

Documents become pre-token frequencies. The pieces of a pre-token are counted where all its occurrences
meet, once, and go back to the documents as numbers. Two things keep that from moving a row for each
word of each document: the ``HEAD`` most frequent pre-tokens are counted first and broadcast (a fixed
number of rows at any input size), which takes the hot keys out; and the others travel as postings, one
row per pre-token and block of documents, each posting four bytes (place in the block, frequency).

Steps: block and pre-token frequencies -> meet by pre-token, count pieces -> meet by block, sum.

Defined results: a null or empty text has no tokens and no bytes. Special strings inside a text are the
special tokens they name. Rows that repeat an id are counted each for itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.llm.bpe import CACHED_CHUNKS, BpeModel, Generations, model

HEAD = 100_000
# A local count below this says nothing about the corpus' most frequent pre-tokens.
LOCAL_LEAST = 4
COUNTED_CHUNKS = 1_000_000
BLOCK_DOCS = 1 << 16
BLOCK_POSTINGS = 2_000_000
PLACE_BITS = 16
MOST = (1 << (32 - PLACE_BITS)) - 1


def _local_frequencies(path: str):
    """Pre-token counts of a task's documents, handed on whenever many have gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(chunks):
            counts: Counter = Counter()
            for chunk, n in chunks.items():
                if n > 1:
                    for word in model(path).pretokens(chunk):
                        counts[word] += n
            kept = [(w, n) for w, n in counts.items() if n >= LOCAL_LEAST]
            return pa.record_batch([pa.array([w for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        chunks: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                for special, part in model(path).parts(text.as_py()):
                    if not special:
                        chunks.update(model(path).split(part))
                if len(chunks) > COUNTED_CHUNKS:
                    yield rows(chunks)
                    chunks.clear()
        yield rows(chunks)

    return run


class Frequencies:
    """Pre-token frequencies of documents, split into what the head knows and the rest."""

    def __init__(self, tokenizer: BpeModel, head: dict[bytes, int]):
        self.tokenizer, self.head = tokenizer, head
        self.pieces = Generations(self._learn)
        self.rare: dict[str, list[bytes]] = {}

    def _learn(self, chunk: str) -> int:
        """Pieces of the chunk's pre-tokens that are in the head; the others are noted."""
        words = self.tokenizer.pretokens(chunk)
        others = [w for w in words if w not in self.head]
        if others:
            self.rare[chunk] = others
        return sum(self.head[w] for w in words if w in self.head)

    def count(self, text: str | None) -> tuple[int, dict[bytes, int]]:
        """Pieces of pre-tokens in the head, and how often each other pre-token stands in the text."""
        pieces, rare = 0, {}
        for special, part in self.tokenizer.parts(text):
            if special:
                pieces += 1
                continue
            chunks = self.tokenizer.split(part)
            pieces += sum(map(self.pieces.__getitem__, chunks))
            for chunk in filter(self.rare.__contains__, chunks):
                for word in self.rare[chunk]:
                    rare[word] = rare.get(word, 0) + 1
        if len(self.pieces) > CACHED_CHUNKS or self.pieces.long:
            for chunk in self.pieces.long:
                self.rare.pop(chunk, None)
            if len(self.pieces) > CACHED_CHUNKS:  # both at once: a known chunk has its other words noted
                self.pieces.clear()
                self.rare.clear()
            self.pieces.bound()
        return pieces, rare


def _count_pieces(path: str):
    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array([model(path).pieces(w) for w in words], pa.int64())], names=["word", "pieces"])
            model(path).words.bound()

    return run


def frequent_pretokens(texts: DataFrame, path: str, head: int = HEAD) -> dict[bytes, int]:
    """Pieces of the ``head`` most frequent pre-tokens of all documents; never more than ``head``."""
    counts = texts.mapInArrow(_local_frequencies(path), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(head).select("word")
    found = top.mapInArrow(_count_pieces(path), "word binary, pieces long").toArrow()
    return dict(zip(found["word"].to_pylist(), found["pieces"].to_pylist()))


def _blocks(path: str, head):
    """Rows (key, block, postings, docs): one per block with its documents, and one per rarer pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequencies, number = Frequencies(model(path), head.value), TaskContext.get().partitionId() << 32
        names: dict[bytes, int] = {}
        docs: list[tuple] = []
        word_of: list[int] = []
        posting: list[int] = []

        def rows(id_type):
            doc_type = pa.struct([("id", id_type), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
            place = [{"id": i, "n_bytes": b, "n_tokens": n} for i, b, n in docs]
            # No pre-token holds a space, so the key of a block's own row is no pre-token.
            own = b" " + number.to_bytes(8, "little")
            yield pa.record_batch(
                [pa.array([own], pa.binary()), pa.array([number], pa.int64()), pa.array([None], pa.binary()), pa.array([place], pa.list_(doc_type))],
                names=["key", "block", "postings", "docs"],
            )
            if not names:
                return
            words, values = np.array(word_of, dtype=np.int64), np.array(posting, dtype="<u4")
            order = np.argsort(words, kind="stable")
            ends = np.cumsum(np.bincount(words, minlength=len(names)))
            offsets = np.concatenate([[0], ends * 4]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values[order].tobytes())])
            keys = pa.array(list(names), pa.binary())
            for at in range(0, len(keys), 50_000):
                n = min(50_000, len(keys) - at)
                yield pa.record_batch(
                    [keys.slice(at, n), pa.array(np.full(n, number), pa.int64()), packed.slice(at, n), pa.nulls(n, pa.list_(doc_type))],
                    names=["key", "block", "postings", "docs"],
                )

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text, place = text.as_py() or "", len(docs)
                tokens, rare = frequencies.count(text)
                for word, n in rare.items():
                    at = names.setdefault(word, len(names))
                    while n > 0:
                        word_of.append(at)
                        posting.append(min(n, MOST) << PLACE_BITS | place)
                        n -= MOST
                docs.append((doc, len(text.encode("utf-8", "surrogatepass")), tokens))
                if len(docs) == BLOCK_DOCS or len(posting) >= BLOCK_POSTINGS:
                    yield from rows(id_type)
                    number += 1
                    names, docs, word_of, posting = {}, [], [], []
        if docs:
            yield from rows(id_type)

    return run


def _counted(path: str):
    """Postings with the pieces of their pre-token, which meet in one partition and are counted once.

    Postings of one block with equal counts are joined within a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        names = ["block", "pieces", "postings", "docs"]
        for batch in batches:
            keys = batch.column(0).to_pylist()
            own = np.array([key[:1] == b" " for key in keys])
            docs_type = batch.schema.field("docs").type
            if own.any():
                some = batch.filter(pa.array(own))
                yield pa.record_batch([some.column(1), pa.array(np.zeros(len(some), np.int64)), some.column(2), some.column(3)], names=names)
            if own.all():
                continue
            some = batch.filter(pa.array(~own))
            if len(known) > COUNTED_CHUNKS:
                known.clear()
            pieces = [known.get(key) for key in keys if key[:1] != b" "]
            if None in pieces:
                for i, key in enumerate(some.column(0).to_pylist()):
                    if pieces[i] is None:
                        pieces[i] = known[key] = known.get(key) or model(path).pieces(key)
                model(path).words.bound()
            pieces, blocks = np.array(pieces), some.column(1).to_numpy()
            order = np.lexsort((pieces, blocks))
            pieces, blocks = pieces[order], blocks[order]
            postings = some.column(2).take(pa.array(order))
            first = np.flatnonzero(np.concatenate([[True], (pieces[1:] != pieces[:-1]) | (blocks[1:] != blocks[:-1])]))
            ends = np.frombuffer(postings.buffers()[1], dtype=np.int32)[postings.offset : postings.offset + len(postings) + 1]
            offsets = np.append(ends[first], ends[-1]).astype(np.int32)
            joined = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), postings.buffers()[2]])
            yield pa.record_batch([pa.array(blocks[first]), pa.array(pieces[first]), joined, pa.nulls(len(first), docs_type)], names=names)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each block with all their tokens; rows come sorted by block."""

    def rows(docs, sums):
        whole = docs.field("n_tokens").to_numpy(zero_copy_only=False) + sums[: len(docs)]
        return pa.record_batch([docs.field("id"), docs.field("n_bytes"), pa.array(whole.astype(np.int64))], names=["id", "n_bytes", "n_tokens"])

    block, docs, sums = None, None, None
    for batch in batches:
        for i, b in enumerate(batch.column(0).to_pylist()):
            if b != block:
                if docs is not None:
                    yield rows(docs, sums)
                block, docs, sums = b, None, np.zeros(BLOCK_DOCS)
            if batch.column(3)[i].is_valid:
                docs = batch.column(3)[i].values
            else:
                values = np.frombuffer(batch.column(2)[i].as_py(), dtype="<u4")
                sums += int(batch.column(1)[i].as_py()) * np.bincount(values & (BLOCK_DOCS - 1), weights=values >> PLACE_BITS, minlength=BLOCK_DOCS)
    if docs is not None:
        yield rows(docs, sums)


def count_tokens(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """(id, n_bytes, n_tokens) for every row."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_pretokens(docs.select(text), path, head))
    given = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = given.schema["id"].dataType
    docs_type = T.ArrayType(T.StructType([T.StructField("id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]))
    tail = [T.StructField("postings", T.BinaryType()), T.StructField("docs", docs_type)]
    block = T.StructField("block", T.LongType())
    blocks = given.mapInArrow(_blocks(path, frequent), T.StructType([T.StructField("key", T.BinaryType()), block, *tail]))
    counted = blocks.repartition("key").mapInArrow(_counted(path), T.StructType([block, T.StructField("pieces", T.LongType()), *tail]))
    out = T.StructType([T.StructField("id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return counted.repartition("block").sortWithinPartitions("block").mapInArrow(_summed, out).withColumnRenamed("id", id)
