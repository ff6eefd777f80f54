"""Offset-preserving SentencePiece BPE encoding, and decoding.

A text is normalised by longest prefixes through the model's compiled character map (a double-array trie
over bytes). Every normalised byte keeps the place in the source it came from, so each piece is projected
to a span of original UTF-8 bytes. A model without a map changes only spaces; then a span follows from
piece lengths. Such a text is split into chunks (runs of spaces with the word or the other characters after
them) where the vocabulary shows that no piece crosses, and the pieces of a chunk are kept in a bounded cache.

The rules are the library's: neighbours whose joined string is a piece merge, best score first, leftmost
among equals; a character outside the vocabulary becomes its bytes, of which the last carries the span.
Models with user-defined or unused pieces, or with white space as a suffix, are refused.

Defined results: a null text is empty; an empty text has only the added ids and decodes to the empty text.
Very long texts are encoded block by block with the cache bounded between blocks. Repeated rows, ties and
columns with clashing names are kept as they are; an empty table gives an empty table. Spans cover the
text without gaps unless the model drops white space; added ids have empty spans at the ends.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice, repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
NONE = 1 << 30
SHORT = 24
CACHED_CHUNKS = 100_000
CACHED_CHARS = 48
# Chunks of one text between two checks of the caches.
BLOCK = 50_000
BATCH_BYTES = 8_000_000
# Any class of characters will do, as the model is asked whether its pieces keep to it.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏͰ-ϿЀ-ӿ"
LETTER = re.compile(f"[{LETTERS}]")
# Spaces with the letters after them, with other characters after them, or alone.
WORDS = re.compile(f" *[{LETTERS}]+| *[^ {LETTERS}]+| +")
# Values of the model file's piece types and model kinds.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message; nested messages stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """The compiled map of a model: replacements of byte strings, found by longest prefix."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if blob else []
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest entry that starts at ``at``."""
        if not self.units:
            return None
        found, node = None, self._offset(self.units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (self.units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        start, length = found
        return self.strings[start : self.strings.index(b"\0", start)], length

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)


class Cache(dict):
    """Results of a function by its argument, in two generations; see ``bound``."""

    def __init__(self, function):
        self.function, self.elder = function, {}

    def __missing__(self, key):
        found = self.elder.get(key)
        if found is None:
            found = self.function(key)
        if len(key) <= CACHED_CHARS:
            self[key] = found
        return found

    def bound(self) -> None:
        if len(self) > CACHED_CHUNKS:
            self.elder = self.copy()
            self.clear()


class Packed(dict):
    """(id, source bytes) of a piece, packed; a character outside the vocabulary becomes its bytes."""

    def __init__(self, model: PieceModel):
        self.model = model
        for piece, i in model.id_of.items():
            self[piece] = struct.pack("<II", i, source_size(piece))

    def __missing__(self, piece: str) -> bytes:
        ids = self.model.ids_of(piece)
        return b"".join(struct.pack("<II", i, 0) for i in ids[:-1]) + struct.pack("<II", ids[-1], source_size(piece))


def source_size(piece: str) -> int:
    """Source bytes of a piece where only spaces change."""
    return len(piece.encode()) - 2 * piece.count(SPACE)


class PieceModel:
    """A SentencePiece BPE model file: ids and source spans of a text, and text of ids."""

    def __init__(self, data: bytes):
        pieces, trainer, normalizer = [], {}, {}
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        kinds = {kind for _, _, kind in pieces}
        if trainer.get(3, 1) != BPE or trainer.get(24, 0) or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("only BPE models without user-defined and unused pieces and without space suffixes")
        self.map = CharacterMap(normalizer.get(2, b""))
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.remove_extra = bool(normalizer.get(4, 1))
        self.escape = bool(normalizer.get(5, 1))
        self.fallback = bool(trainer.get(35, 0))
        self.id_of = {piece: i for i, (piece, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN)
        self.end_id = next((i for i, (piece, _, kind) in enumerate(pieces) if kind == CONTROL and piece == "</s>"), None)
        self.bytes_id = {int(piece[3:5], 16): i for i, (piece, _, kind) in enumerate(pieces) if kind == BYTE}
        scores = sorted({score for _, score, kind in pieces if kind == NORMAL}, reverse=True)
        rank_of = {score: rank for rank, score in enumerate(scores)}
        self.rank = {piece: rank_of[score] for piece, score, kind in pieces if kind == NORMAL}
        self.neighbours = {piece[i : i + 2] for piece in self.rank for i in range(len(piece) - 1)}
        # Whether a space can never follow another character inside a piece, so words are independent.
        self.words_apart = not any(pair[1] == SPACE and pair[0] != SPACE for pair in self.neighbours)
        # Whether letters and other characters never meet inside a piece either.
        self.classes_apart = self.words_apart and all(bool(LETTER.match(a)) == bool(LETTER.match(b)) for a, b in self.neighbours if a != SPACE)
        surface = trainer.get(44, " ⁇ ".encode())
        self.surface = np.empty(len(pieces), dtype=object)
        for i, (piece, _, kind) in enumerate(pieces):
            text = piece.replace(SPACE, " ").encode()
            self.surface[i] = {UNKNOWN: surface, CONTROL: b""}.get(kind, bytes([int(piece[3:5], 16)]) if kind == BYTE else text)
        self.control = np.array([kind == CONTROL for _, _, kind in pieces])
        self.plain = self.classes_apart and not self.map.units and self.dummy_prefix and self.escape and not self.remove_extra
        self.packed = Packed(self)
        self.chunks = Cache(self.encode_chunk)

    # Normalising

    def normalize(self, text: str) -> tuple[str, list[int]]:
        """Normalised text, and for each of its characters and its end the source byte it starts at."""
        source = text.encode()
        out: list[str] = []
        places: list[int] = []
        at, leading = 0, self.remove_extra
        if source and self.dummy_prefix:
            out.append(" ")
            places.append(0)
        pending = self.remove_extra
        while at < len(source):
            found = self.map.longest(source, at)
            if found is None:
                lead = source[at]
                length = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                made = source[at : at + length].decode()
            else:
                made, length = found[0].decode(), found[1]
            leading = leading and made == " "
            if pending:
                made = made.lstrip(" ")
            if made:
                out += made
                places += [at] * len(made)
                pending = self.remove_extra and made[-1] == " "
            at += length
            if leading and self.dummy_prefix:
                places[0] = at  # white space left out at the start belongs to no piece
        end = len(source)
        if self.remove_extra:
            while out and out[-1] == " ":
                out.pop()
                end = places.pop()
            end = end if out else 0
        return "".join(out).replace(" ", SPACE) if self.escape else "".join(out), [*places, end]

    # Encoding

    def pieces(self, normal: str) -> list[str]:
        """Merged pieces of normalised text, fragment by fragment between certain cuts."""
        if len(normal) <= SHORT:
            return self.merge(normal)
        found, start = [], 0
        neighbours = self.neighbours
        for i in range(1, len(normal)):
            if normal[i - 1 : i + 1] not in neighbours:
                found += self.merge(normal[start:i])
                start = i
        return found + self.merge(normal[start:])

    def merge(self, fragment: str) -> list[str]:
        if len(fragment) > SHORT:
            return self._merge_long(fragment)
        get, parts = self.rank.get, list(fragment)
        ranks = list(map(get, map(add, parts, parts[1:]), repeat(NONE)))
        while ranks and (best := min(ranks)) != NONE:
            i = ranks.index(best)
            parts[i] = new = parts[i] + parts[i + 1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + new, NONE)
            if i < len(ranks):
                ranks[i] = get(new + parts[i + 1], NONE)
        return parts

    def _merge_long(self, fragment: str) -> list[str]:
        """The same through a heap, for fragments of any length."""
        parts, n, rank = list(fragment), len(fragment), self.rank
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, pair) for i in range(n - 1) if (r := rank.get(pair := parts[i] + parts[i + 1], NONE)) != NONE]
        heapify(heap)
        while heap:
            _, i, pair = heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != pair:
                continue
            parts[i], parts[j], after[i] = pair, "", after[j]
            for a, b in ((before[i], i), (i, after[i])):
                if 0 <= a and b < n and (r := rank.get(parts[a] + parts[b], NONE)) != NONE:
                    heappush(heap, (r, a, parts[a] + parts[b]))
            if after[i] < n:
                before[after[i]] = i
        return [p for p in parts if p]

    def ids_of(self, piece: str) -> list[int]:
        """Id of a piece, or of the bytes of a character outside the vocabulary."""
        found = self.id_of.get(piece)
        if found is not None:
            return [found]
        return [self.bytes_id[b] for b in piece.encode()] if self.fallback else [self.unknown]

    def encode_chunk(self, chunk: str) -> bytes:
        """Pairs (id, source bytes) of a chunk where only spaces change."""
        return b"".join(map(self.packed.__getitem__, self.pieces(chunk.replace(" ", SPACE))))

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a whole text and the source bytes at which each piece begins and ends."""
        if not text:
            nothing = np.zeros(0, dtype=np.int64)
            return nothing.astype(np.int32), nothing, nothing
        if self.plain and SPACE not in text:
            return self._encode_plain(text)
        normal, places = self.normalize(text)
        ids: list[int] = []
        ends: list[int] = [places[0] if places else 0]
        at = 0
        cuts = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if self.words_apart else re.compile("(?s).+")
        for match in cuts.finditer(normal):
            for piece in self.pieces(match[0]):
                own = self.ids_of(piece)
                ids += own
                at += len(piece)
                ends += [ends[-1]] * (len(own) - 1) + [places[at]]
        bounds = np.array(ends, dtype=np.int64)
        return np.array(ids, dtype=np.int32), bounds[:-1], bounds[1:]

    def _encode_plain(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        made: list[bytes] = []
        if len(text) < BLOCK:
            made += map(self.chunks.__getitem__, WORDS.findall(" " + text))
            self.chunks.bound()
        else:
            words = (match[0] for match in WORDS.finditer(" " + text))
            while block := list(islice(words, BLOCK)):
                made.append(b"".join(map(self.chunks.__getitem__, block)))
                self.chunks.bound()
        pairs = np.frombuffer(b"".join(made), dtype="<u4").reshape(-1, 2)
        ends = np.cumsum(pairs[:, 1], dtype=np.int64) - 1  # the first space is not in the source
        begins = np.empty_like(ends)
        begins[0], begins[1:] = 0, ends[:-1]
        return pairs[:, 0].astype(np.int32), begins, np.maximum(ends, 0)

    # Decoding

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; the space that stands for the dummy prefix goes."""
        out: list[str] = []
        control = np.flatnonzero(self.control[ids])
        for own in np.split(ids, control):
            own = own[self.control[own[:1]].sum() :]  # a control id also ends a run of bytes
            if len(own):
                text = b"".join(self.surface[own].tolist())
                strip = not out and (self.dummy_prefix or self.remove_extra) and self.first_space(own)
                out.append((text[1:] if strip else text).decode("utf-8", "each_byte"))
        return "".join(out)

    def first_space(self, ids: np.ndarray) -> bool:
        """Whether the first piece starts with a space of the vocabulary, not with a byte or the unknown mark."""
        first = int(ids[0])
        return first != self.unknown and first not in self.bytes_id.values() and self.surface[first][:1] == b" "


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One model per worker process."""
    with open(path, "rb") as file:
        return PieceModel(file.read())


COLUMNS = ("ids", "begins", "ends", "decoded")
_TYPES = {"ids": (pa.list_(pa.int32()), "array<int>"), "begins": (pa.list_(pa.int64()), "array<bigint>"),
          "ends": (pa.list_(pa.int64()), "array<bigint>"), "decoded": (pa.string(), "string")}


def encode(docs: DataFrame, path: str, text: str = "text", add_end: bool = False, keep: list[str] | None = None,
           made: tuple[str, ...] = ("ids", "begins", "ends")) -> DataFrame:
    """``keep`` of ``docs`` and the columns in ``made``: ids, source bytes where each piece begins and ends,
    and the text the ids decode to. An own column of a made name is replaced."""
    kept = [name for name in (docs.columns if keep is None else keep) if name not in made]
    given = docs.select(F.struct(F.lit(0).alias("."), *[docs[name] for name in kept]).alias("row"), docs[text].cast("string").alias("given"))

    def coded(value: str | None) -> dict:
        own = model(path)
        ids, begins, ends = own.encode(value)
        if add_end:
            last = ends[-1:] if len(ends) else np.zeros(1, dtype=np.int64)
            ids, begins, ends = np.append(ids, np.int32(own.end_id)), np.append(begins, last), np.append(ends, last)
        return {"ids": ids, "begins": begins, "ends": ends, "decoded": own.decode(ids) if "decoded" in made else None}

    return _mapped(given, kept, made, coded)


def decode(docs: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` of ``docs`` and the text of the ids in ``decoded``; a null list decodes to the empty text."""
    kept = [name for name in (docs.columns if keep is None else keep) if name != "decoded"]
    given = docs.select(F.struct(F.lit(0).alias("."), *[docs[name] for name in kept]).alias("row"), docs[ids].cast("array<int>").alias("given"))
    return _mapped(given, kept, ("decoded",), lambda value: {"decoded": model(path).decode(np.array(value or [], dtype=np.int32))})


def _mapped(given: DataFrame, kept: list[str], made: tuple[str, ...], each) -> DataFrame:
    """``each`` applied to column ``given`` row by row, given back in batches of bounded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size = 0, 0
            found: dict[str, list] = {name: [] for name in made}
            for i in range(batch.num_rows):
                own = each(batch.column(1)[i].as_py())
                for name in made:
                    found[name].append(own[name])
                    size += getattr(own[name], "nbytes", 0) or len(own[name])
                if size > BATCH_BYTES or i + 1 == batch.num_rows:
                    arrays = [pa.array(found[name], _TYPES[name][0]) for name in made]
                    yield pa.record_batch([batch.slice(start, i + 1 - start).column(0), *arrays], names=["row", *made])
                    start, size, found, arrays = i + 1, 0, {name: [] for name in made}, None
            batch = None  # else it stays while the next one is read
            pa.default_memory_pool().release_unused()

    schema = T.StructType([T.StructField("row", given.schema["row"].dataType),
                           *(T.StructField(name, T.DataType.fromDDL(_TYPES[name][1])) for name in made)])
    return given.mapInArrow(run, schema).select(*[F.col("row")[name].alias(name) for name in kept], *made)
