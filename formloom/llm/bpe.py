"""Byte-pair encoding by forced-boundary splitting, and decoding.

Two neighbouring symbols that stand side by side in no vocabulary entry can never be merged, nor can
anything across them. Such pairs are certain cuts: a pre-token is cut there, its fragments are merged
independently and their ids concatenated. The pair table comes from the vocabulary alone; symbols are
bytes, and the last byte of a pre-token, which carries the end-of-word mark, is a symbol of its own.

A text whose characters have had the same classes in all Unicode versions is lower-cased and split by the
file's own pattern in one run, and each pre-token is looked up in a bounded cache, so a frequent word is
encoded once per Python worker. Texts with other characters are split at white space, and only chunks with
such characters take the tokenizer file's own normalizer and splitter.
Encoding and decoding run in Arrow batches on whatever partitioning the input has; nothing is shuffled.

Defined results: a null text is empty; an empty text has no ids and decodes to the empty text. Ids are
packed as little-endian unsigned 32-bit integers. Decoding joins the entries' strings with a space, as
a tokenizer file without a decoder asks for. Very long texts are encoded block by block, with the caches
bounded between blocks. Repeated rows and columns with clashing names are kept; an empty table gives an
empty table.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHED_CHUNKS = 160_000
CACHED_CHARS = 48
# Pre-tokens or chunks of one text between two checks of the caches.
BLOCK = 50_000
BATCH_BYTES = 16_000_000
SHORT = 24
NONE, CUT = 1 << 28, 1 << 29
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
# A letter word followed by one of these is two pre-tokens in any pattern of words and punctuation.
PLAIN_ENDS = (".", ",", ";", ":", "!", "?")
END = "</w>"
# White space of the tokenizer's normalizer.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
# Below this code point the classes used here have not changed between Unicode versions.
STABLE = "԰"


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)}


def stable_class(kind: str) -> str:
    """The characters below STABLE of a general category, as ranges of a pattern's class."""
    own = [c for c in range(ord(STABLE)) if unicodedata.category(chr(c)).startswith(kind)]
    starts = [c for p, c in zip([-2, *own], own) if p != c - 1]
    ends = [c for c, n in zip(own, [*own[1:], -2]) if n != c + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


class Generations(dict):
    """Results of a function by its argument. ``bound`` keeps the size: when the dictionary is full it
    becomes the elder generation, so what is frequent survives, and long arguments are not kept.
    """

    def __init__(self, function: Callable):
        self.function, self.elder, self.long = function, {}, []

    def __missing__(self, key):
        found = self.elder.get(key)
        if found is None:
            found = self.function(key)
        self[key] = found
        if len(key) > CACHED_CHARS:
            self.long.append(key)
        return found

    def bound(self) -> None:
        for key in self.long:
            self.pop(key, None)
        self.long.clear()
        if len(self) > CACHED_CHUNKS:
            self.elder = self.copy()
            self.clear()


class BpeModel:
    """A word-level BPE tokenizer file: ids of a text, and text of ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = np.empty(size, dtype=object)
        for string, i in {**vocab, **self.special}.items():
            self.strings[i] = string
        self.of_byte = byte_symbols()
        byte_of = {c: b for b, c in self.of_byte.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        # By left id the rank of each right id, and by rank the id a pair becomes.
        self.ranks: list[dict[int, int]] = [{} for _ in range(size)]
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(pairs):
            self.ranks[vocab[a]][vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.inner = [vocab.get(self.of_byte[b]) for b in range(256)]
        self.last = [vocab.get(self.of_byte[b] + END) for b in range(256)]
        # Whether symbol b follows symbol a inside an entry; 256 + b is byte b with the end mark.
        self.together = np.zeros((256, 512), dtype=bool)
        for string in vocab:
            ended = string.endswith(END) and string != END
            symbols = [byte_of[c] for c in (string[: -len(END)] if ended else string)]
            if ended and symbols:
                symbols[-1] += 256
            for a, b in zip(symbols, symbols[1:]):
                self.together[a, b] = True
        # Rank of two neighbouring symbols, or that there is a certain cut between them.
        self.first = [
            [self.ranks[self.inner[a]].get(self.inner[b] if b < 256 else self.last[b - 256], NONE) if self.together[a, b] else CUT for b in range(512)]
            for a in range(256)
        ]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pretoken = regex.compile(pattern)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.space = re.compile(f"[{SPACES}]+")
        self.stable = re.compile(f"[^\\x00-{STABLE}]")
        # The same pattern over characters whose classes are stable; four controls are space to Python alone.
        letters, numbers = stable_class("L"), stable_class("N")
        plain = pattern.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}").replace(r"[^\s\p{L}\p{N}]", f"[^\\s{letters}{numbers}]")
        self.plain = re.compile(plain.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]"))
        self.odd = re.compile(f"[^\\x00-\\x1b\\x20-{chr(ord(STABLE) - 1)}]")
        self.tokens = Generations(self.encode_token)
        self.chunks = Generations(self.encode_chunk)
        self.words = Generations(self.encode_packed)

    def pretokens(self, chunk: str) -> list[bytes]:
        """Pre-tokens of text without white space, as UTF-8."""
        if self.stable.search(chunk):
            normal = self.library.normalizer.normalize_str(chunk)
            byte_of = {c: b for b, c in self.of_byte.items()}
            return [bytes(byte_of[c] for c in piece) for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        lower = chunk.lower()
        if lower.isalpha():
            return [lower.encode()]
        if lower[-1:] in PLAIN_ENDS and lower[:-1].isalpha():
            return [lower[:-1].encode(), lower[-1:].encode()]
        return [p.encode() for p in self.pretoken.findall(lower)]

    def first_ranks(self, word: bytes) -> list[int]:
        """Rank of each pair of neighbouring symbols of a pre-token, ``CUT`` where a cut is certain."""
        first = self.first
        ranks = [first[a][b] for a, b in zip(word, word[1:])]
        if ranks:
            ranks[-1] = first[word[-2]][256 + word[-1]]
        return ranks

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token: fragments between certain cuts, each merged by itself."""
        inner = self.inner
        symbols = [inner[b] for b in word]
        symbols[-1] = self.last[word[-1]]
        ranks = self.first_ranks(word)
        if CUT not in ranks:
            return self.merge(symbols, ranks)
        ids, start = [], 0
        for end in [*(i + 1 for i, rank in enumerate(ranks) if rank == CUT), len(word)]:
            ids += self.merge(symbols[start:end], ranks[start : end - 1])
            start = end
        return ids

    def merge(self, ids: list[int], ranks: list[int]) -> list[int]:
        """Merge neighbours, lowest rank first and leftmost among equals."""
        if len(ids) > SHORT:
            return self._merge_long(ids)
        pairs, merged = self.ranks, self.merged
        while ranks and (best := min(ranks)) != NONE:
            i = ranks.index(best)
            ids[i] = new = merged[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = pairs[ids[i - 1]].get(new, NONE)
            if i < len(ranks):
                ranks[i] = pairs[new].get(ids[i + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same through a heap, for fragments of any length."""
        ids, n = list(ids), len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            rank = self.ranks[ids[i]].get(ids[j], NONE)
            if rank != NONE:
                heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            rank, i, a, b = heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = self.merged[rank], False, after[j]
            if after[j] < n:
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [x for x, live in zip(ids, alive) if live]

    def split(self, part: str) -> list[str]:
        """The chunks between white space."""
        # Four control characters are white space to Python and not to the tokenizer.
        odd = "\x1c" in part or "\x1d" in part or "\x1e" in part or "\x1f" in part
        return self.space.split(part) if odd else part.split()

    def encode_packed(self, word: bytes) -> bytes:
        ids = self.encode_word(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_token(self, token: str) -> bytes:
        """Packed ids of a pre-token; written out for short ones without certain cuts, which are nearly all."""
        word, first = token.encode(), self.first
        if len(word) > SHORT:
            return self.encode_packed(word)
        ids = list(map(self.inner.__getitem__, word))
        ids[-1] = self.last[word[-1]]
        ranks = [first[a][b] for a, b in pairwise(word)]
        if ranks:
            ranks[-1] = first[word[-2]][256 + word[-1]]
            if CUT in ranks:
                return self.encode_packed(word)
            pairs, merged = self.ranks, self.merged
            while ranks and (best := min(ranks)) != NONE:
                i = ranks.index(best)
                ids[i] = new = merged[best]
                del ids[i + 1], ranks[i]
                if i:
                    ranks[i - 1] = pairs[ids[i - 1]].get(new, NONE)
                if i < len(ranks):
                    ranks[i] = pairs[new].get(ids[i + 1], NONE)
        return array("I", ids).tobytes() if LITTLE else struct.pack(f"<{len(ids)}I", *ids)

    def encode_chunk(self, chunk: str) -> bytes:
        """Packed ids of text without white space."""
        return b"".join([self.words[word] for word in self.pretokens(chunk)])

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a whole text."""
        if not text:
            return b""
        out: list[bytes] = []
        for special, part in self.parts(text):
            if special:
                out.append(struct.pack("<I", self.special[part]))
            elif self.odd.search(part):
                self._looked_up(self.chunks, self.split(part), out)
            else:
                plain = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")
                words = self.plain.findall if len(part) < 4 * BLOCK else lambda x: (m[0] for m in self.plain.finditer(x))
                self._looked_up(self.tokens, words(plain.lower()), out)
        return b"".join(out)

    def _looked_up(self, cache: Generations, keys, out: list[bytes]) -> None:
        """Adds what a cache has for each key, block by block where there are many."""
        keys = iter(keys)
        while block := list(islice(keys, BLOCK)):
            out.append(b"".join(map(cache.__getitem__, block)))
            self.tokens.bound()
            self.chunks.bound()
            self.words.bound()

    def parts(self, text: str | None) -> Iterator[tuple[bool, str]]:
        """Special tokens, marked as such, and the text between them."""
        text = text or ""
        for part in self.specials.split(text) if self.specials and "<" in text else [text]:
            yield part in self.special, part

    def pieces(self, word: bytes) -> int:
        """Number of ids of a pre-token."""
        return len(self.words[word]) // 4

    def decode(self, packed: bytes | None) -> str:
        return " ".join(self.strings[np.frombuffer(packed or b"", dtype="<u4")].tolist())


@lru_cache(maxsize=2)
def model(path: str) -> BpeModel:
    """One model per worker process."""
    return BpeModel(path)


def _map(docs: DataFrame, column: str, out: str, kind: pa.DataType, ddl: str, keep, each: Callable[[object], object], size_of=len) -> DataFrame:
    """``keep`` of ``docs`` and one column computed from ``column`` row by row, in batches of bounded bytes."""
    kept = [name for name in (docs.columns if keep is None else keep) if name != out]
    packed = docs.select(F.struct(F.lit(0).alias("."), *[docs[name] for name in kept]).alias("row"), docs[column].alias("given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, found = 0, 0, []
            for i in range(batch.num_rows):
                found.append(each(batch.column(1)[i].as_py()))
                size += size_of(found[-1])
                if size > BATCH_BYTES or i + 1 == batch.num_rows:
                    made = pa.array(found, kind)
                    found = []
                    yield pa.record_batch([batch.slice(start, len(made)).column(0), made], names=["row", "made"])
                    start, size, made = i + 1, 0, None
            batch = None  # else it stays while the next one is read
            pa.default_memory_pool().release_unused()

    schema = T.StructType([T.StructField("row", packed.schema["row"].dataType), T.StructField("made", T.DataType.fromDDL(ddl))])
    return packed.mapInArrow(run, schema).select(*[F.col("row")[name].alias(name) for name in kept], F.col("made").alias(out))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns in ``keep``, with the packed ids of each whole text in ``ids``."""
    return _map(docs, text, ids, pa.binary(), "binary", keep, lambda x: model(path).encode(x))


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns in ``keep``, with packed ids and the text they decode to in ``ids`` and ``decoded``,
    made in one pass."""

    def both(value: str | None) -> dict:
        own = model(path)
        packed = own.encode(value)
        return {"ids": packed, "decoded": own.decode(packed)}

    kind = pa.struct([("ids", pa.binary()), ("decoded", pa.string())])
    own = [name for name in (docs.columns if keep is None else keep) if name not in ("ids", "decoded", "_both")]
    made = _map(docs, text, "_both", kind, "struct<ids:binary,decoded:string>", own, both, lambda x: len(x["ids"]) + len(x["decoded"]))
    return made.select(*own, "_both.*")


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns in ``keep``, with the text of packed ids in ``text``."""
    return _map(docs, ids, text, pa.string(), "string", keep, lambda x: model(path).decode(x))
