"""Jaccard join of word n-gram sets by a grouped prefix join.

Shingles get one global order, rare ones first; two sets that overlap enough share a shingle among the
first ``n - ceil(t * n) + 1`` of each. The order comes from a popularity table of fixed size: tasks
report the slots (hash cells) they meet repeatedly, over all documents, and each slot keeps the
logarithm of its sum. Any such table gives a right order; a good one keeps popular passages out of the
prefixes.

1. Documents with equal sets are one class, known by its smallest id.
2. Classes with identical prefix and size are one group, and only groups enter the prefix index.
3. Index keys that only one group has are dropped; what is left tells, for each place in a prefix, how
   many shingles before it could be shared at all, and that bounds the overlap of a pair of groups
   (positional filter) inside the join.
   Pairs are filtered by parity bitmaps (exact: two sets differ in at least as many shingles as their
   bitmaps in bits) before any text moves, and by folded ones inside the last join.
4. First each key's groups are only paired with the group that has most shared keys, and members of a
   group with its smallest. Pairs are verified on the words of the texts; links make components.
5. Then, for keys and groups that still hold several components, all pairs of different components
   that pass the positional and the bitmap filter are verified. Pairs inside a component cannot change
   the result and are never formed, so a large group of near copies costs a row per member, not per pair.

Defined results: words are split at ASCII white space after lower-casing A-Z. With fewer words than a
shingle has, the whole sequence is the only shingle; without words the set is empty and links with
nothing. Rows are linked, not ids: every row is a document of its own, also where ids repeat or are null,
and a component is named by its smallest id that is not null. Memory holds one text's words at a time.
An empty table gives an empty table; other columns, whatever their names, are not read. Equal sets are told
by 128 bits of their hashed shingles; all other links are verified on the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formloom.llm.components import components
from formloom.session import cut

SPACE_BYTES = (0x20, *range(0x09, 0x0E))
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 20
_LEVELS = 64
BITMAP_WORDS = 16


@dataclass(frozen=True)
class Setting:
    """Shingle length, similarity as a percentage, and the slots of the popularity table and of the table
    that says which texts may be wanted for verification; both tables are broadcast.
    """

    words: int = 3
    percent: int = 90
    slots: int = 1 << 22
    local_least: int = 3
    wanted_slots: int = 1 << 20


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up = np.ones(_BLOCK + 1, dtype=np.uint64)
    up[1:] = np.uint64(_BASE)
    down = np.ones(_BLOCK + 1, dtype=np.uint64)
    down[1:] = np.uint64(pow(_BASE, -1, 1 << 64))
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of every word of lower-cased bytes, block by block."""
    spaces = np.zeros(256, dtype=bool)
    spaces[list(SPACE_BYTES)] = True
    out, start = [], 0
    while start < len(data):
        end = min(len(data), start + _BLOCK)
        if end < len(data):  # end a block at white space
            cut_at = max(data.rfind(bytes([c]), start, end) for c in SPACE_BYTES)
            if cut_at <= start and not spaces[data[start]]:  # a word longer than a block: hash its parts in turn
                stop = min((p for c in SPACE_BYTES if (p := data.find(bytes([c]), end)) >= 0), default=len(data))
                h = 0
                for at in range(start, stop, _BLOCK):
                    part = data[at : min(stop, at + _BLOCK)]
                    h = (h * _BASE + int(_hash_block(part, spaces)[0]) + len(part)) % (1 << 64)
                out.append(np.array([h], dtype=np.uint64))
                start = stop
                continue
            end = max(cut_at, start + 1)
        out.append(_hash_block(data[start:end], spaces))
        start = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _hash_block(data: bytes, spaces: np.ndarray) -> np.ndarray:
    values = np.frombuffer(data, dtype=np.uint8)
    inside = np.concatenate([[False], ~spaces[values], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers()
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * down[starts])


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    hashes = _word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(hashes):
        return hashes
    size = min(words, len(hashes))
    total = np.full(len(hashes) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total = _mixed(total + hashes[i : len(hashes) - size + 1 + i])
    return np.unique(total)


def _popular_slots(setting: Setting):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(setting.slots, dtype=np.int32)
        for batch in batches:
            for text in batch.column(0):
                slots = shingle_set(text.as_py(), setting.words) & np.uint64(setting.slots - 1)
                np.add.at(counts, slots.astype(np.int64), 1)
        kept = np.flatnonzero(counts >= setting.local_least)
        yield pa.record_batch([pa.array(kept, pa.int32()), pa.array(counts[kept], pa.int64())], names=["slot", "n"])

    return run


def popularity(texts: DataFrame, setting: Setting) -> np.ndarray:
    """Level of each slot, one byte; at most ``slots`` rows reach the driver."""
    found = texts.mapInArrow(_popular_slots(setting), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    levels = np.zeros(setting.slots, dtype=np.uint8)
    levels[found["slot"].to_numpy()] = np.minimum(np.log2(np.maximum(found["n"].to_numpy(), 1)), _LEVELS).astype(np.uint8)
    return levels


def _sets(setting: Setting, levels):
    """Per document: size of its set, hash of the set, hash of prefix and size, and the prefix."""

    def digest(*parts: np.ndarray) -> bytes:
        import hashlib

        return hashlib.blake2b(b"".join(p.tobytes() for p in parts), digest_size=16).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            sizes, whole, groups, prefixes, bitmaps = [], [], [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py(), setting.words)
                n = len(found)
                place = level[(found & np.uint64(len(level) - 1)).astype(np.int64)]
                order = np.lexsort((found, place))
                prefix = found[order[: n + setting.percent * n // -100 + 1 if n else 0]]
                sizes.append(n)
                whole.append(digest(found))
                groups.append(digest(prefix, np.array([n])))
                prefixes.append(prefix.view(np.int64))
                parity = np.bincount((found >> np.uint64(40)).astype(np.int64) % (64 * BITMAP_WORDS), minlength=64 * BITMAP_WORDS) & 1
                bitmaps.append(np.packbits(parity.astype(np.uint8)).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))
            bits = pa.array([b.tolist() for b in bitmaps], pa.list_(pa.int64()))
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(whole, pa.binary()), pa.array(groups, pa.binary()), lists, bits],
                names=["id", "n", "whole", "grp", "prefix", "bits"],
            )

    return run


def _verify(setting: Setting):
    """Links among pairs (a, b, text_a, text_b), by the words themselves."""

    def shingles(text: str) -> set:
        words = words_of(text)
        size = min(setting.words, len(words))
        return set(zip(*(words[i:] for i in range(size)))) if size else set()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, set()
        for batch in batches:
            linked = []
            for a, b, text_a, text_b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, left = a, shingles(text_a.as_py())
                right = shingles(text_b.as_py())
                both = len(left & right)
                if 100 * both >= setting.percent * (len(left) + len(right) - both):
                    linked.append((a, b))
            yield pa.record_batch([pa.array([x for x, _ in linked], pa.int64()), pa.array([x for _, x in linked], pa.int64())], names=["a", "b"])

    return run


def plausible(pairs: DataFrame, sketches: DataFrame, setting: Setting) -> DataFrame:
    """Those of ``pairs`` (a, b) that the parity bitmaps in ``sketches`` (rep, n, bits) do not rule out."""
    left = sketches.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = sketches.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    enough = _alike(setting, ("na", "ba"), ("nb", "bb"))
    return pairs.join(right, "b").join(left, "a").filter(enough).select("a", "b")


def _alike(setting: Setting, left: tuple[str, str], right: tuple[str, str]):
    """Whether two sets of these sizes and parity bitmaps can overlap enough: twice the overlap is at most the
    sizes less the bits that differ."""
    (na, ba), (nb, bb) = left, right
    differing = F.aggregate(F.zip_with(ba, bb, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = F.col(na) + F.col(nb)
    return (100 + setting.percent) * (both - differing) >= 2 * setting.percent * both


# Longs of the bitmaps that travel with index rows.
FOLDED_WORDS = 8


def _folded(bits: str):
    """A parity bitmap folded to a few longs; parities of parities are parities, so the bound still holds."""
    parts = [F.slice(bits, 1 + start, FOLDED_WORDS) for start in range(0, BITMAP_WORDS, FOLDED_WORDS)]
    out = parts[0]
    for part in parts[1:]:
        out = F.zip_with(out, part, lambda x, y: x.bitwiseXOR(y))
    return out


def verified(pairs: DataFrame, docs: DataFrame, sketches: DataFrame, setting: Setting) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts are similar enough.

    A text moves only if its id falls into a slot that some pair asks for; there are at most
    ``wanted_slots`` of those.
    """
    pairs = cut(plausible(pairs, sketches, setting), "pairs")

    def slot(column):
        return F.pmod(F.xxhash64(column), F.lit(setting.wanted_slots)).alias("slot")

    wanted = pairs.select(slot("a")).union(pairs.select(slot("b"))).distinct()
    texts = docs.join(F.broadcast(wanted), slot("id") == F.col("slot"), "left_semi")
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return cut(both.mapInArrow(_verify(setting), "a long, b long"), "verified")


def similarity_classes(
    docs: DataFrame, setting: Setting = Setting(), id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, n_shingles, class_id, component_id) for every row.

    ``class_id`` is the smallest id with the same set, ``component_id`` the smallest reachable by links.
    """
    given = docs.select(F.col(id).cast("long").alias("given"), F.col(text).alias("text"))
    rows = cut(given.withColumn("id", F.monotonically_increasing_id()), "rows")
    found = cut(row_classes(rows.select("id", "text"), setting).join(rows.select("id", "given"), "id"), "row-classes")
    smallest = found.groupBy("class_id", "component_id").agg(F.min("given").alias("class"))
    named = smallest.join(smallest.groupBy("component_id").agg(F.min("class").alias("component")), "component_id")
    return found.join(named, ["class_id", "component_id"]).select(
        F.col("given").alias(id), "n_shingles", F.col("class").alias("class_id"), F.col("component").alias("component_id")
    )


def _placed(members: DataFrame, component: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, rep, c): the component of every class of a group, and one class of each group and component."""
    placed = cut(
        members.join(component.withColumnRenamed("v", "rep"), "rep", "left").select("g", "rep", F.coalesce("component", "rep").alias("c")),
        "placed",
    )
    return placed, placed.groupBy("g", "c").agg(F.min("rep").alias("some"))


def row_classes(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """(id, n_shingles, class_id, component_id) for rows (id, text) whose ids are not null and do not repeat."""
    levels = docs.sparkSession.sparkContext.broadcast(popularity(docs.select("text"), setting))
    schema = "id long, n long, whole binary, grp binary, prefix array<long>, bits array<long>"
    sets = cut(docs.mapInArrow(_sets(setting, levels), schema), "sets")

    # 1 and 2: classes of equal sets, groups of equal prefix and size.
    filled = sets.filter("n > 0 AND id IS NOT NULL")
    classes = cut(filled.groupBy("whole", "grp", "n").agg(F.min("id").alias("rep"), F.min("bits").alias("bits")), "classes")
    sketches = classes.select("rep", "n", "bits")
    members = cut(
        classes.join(classes.groupBy("grp").agg(F.min("rep").alias("g")), "grp").select("g", "rep", "n"), "members"
    )
    leaders = members.filter("g = rep").select(F.col("g").alias("id"))
    index = (
        filled.select("id", "n", "prefix")
        .join(leaders, "id", "left_semi")
        .select(F.col("id").alias("g"), "n", F.posexplode("prefix").alias("pos", "h"))
    )

    # 3: keys of several groups, with the number of such keys before each place.
    shared_keys = index.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("h")
    places = Window.partitionBy("g").orderBy("pos")
    whole = Window.partitionBy("g")
    prefix_size = F.col("n") - F.ceil(F.col("n") * setting.percent / 100) + 1
    rows = cut(
        index.join(shared_keys, "h")
        .withColumn("before", F.row_number().over(places) - 1)
        .withColumn("weight", F.count(F.lit(1)).over(whole) / prefix_size),
        "index",
    )

    # 4: each key's leader against the others, each group's smallest member against the others.
    lead = rows.groupBy("h").agg(F.min(F.struct(-F.col("weight"), F.col("g").alias("g"), "n", "pos", "before")).alias("l"))
    star = (
        rows.join(lead, "h")
        .filter(F.col("g") != F.col("l.g"))
        .filter(_possible(setting, ("n", "pos", "before"), ("l.n", "l.pos", "l.before")))
        .select(F.col("l.g").alias("a"), F.col("g").alias("b"))
        .unionByName(members.filter("g <> rep").select(F.col("g").alias("a"), F.col("rep").alias("b")))
        .distinct()
    )
    first = verified(star, docs, sketches, setting)
    component = components(first)

    # 5: what still lies in different components.
    placed, parts = _placed(members, component)
    split = parts.groupBy("g").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("g")
    inside = parts.join(split, "g").select("g", "c")
    inside = inside.alias("x").join(inside.alias("y"), F.expr("x.g = y.g AND x.c < y.c")).select(
        F.col("x.g").alias("ga"), F.col("x.c").alias("ca"), F.col("y.g").alias("gb"), F.col("y.c").alias("cb")
    )
    with_parts = rows.join(parts.select("g", "c"), "g")
    mixed = with_parts.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("n").alias("least")).filter("lo <> hi")
    # Overlap that a row can still reach, against what the smallest set of its key would ask for.
    reach = F.col("before") + F.col("n") - F.col("pos")
    other = F.greatest(F.col("least"), F.ceil(F.col("n") * setting.percent / 100))
    needed = setting.percent * (F.col("n") + other)
    open_rows = with_parts.join(mixed.select("h", "least"), "h").filter((100 + setting.percent) * reach >= needed).drop("least", "weight")
    # Where a group has one class in a component, that class's bitmap rules pairs out before they are made.
    alone = placed.groupBy("g", "c").agg(F.min("rep").alias("rep"), F.count(F.lit(1)).alias("k")).filter("k = 1")
    bits = alone.join(sketches.select("rep", "bits"), "rep").select("g", "c", _folded("bits").alias("bits"))
    open_rows = cut(open_rows.join(bits, ["g", "c"], "left"), "open")
    x, y = open_rows.alias("x"), open_rows.alias("y")
    across = x.join(
        y,
        (F.col("x.h") == F.col("y.h"))
        & (F.col("x.g") < F.col("y.g"))
        & (F.col("x.c") != F.col("y.c"))
        & _possible(setting, ("x.n", "x.pos", "x.before"), ("y.n", "y.pos", "y.before"))
        & F.coalesce(_alike(setting, ("x.n", "x.bits"), ("y.n", "y.bits")), F.lit(True)),
    ).select(F.col("x.g").alias("ga"), F.col("x.c").alias("ca"), F.col("y.g").alias("gb"), F.col("y.c").alias("cb"))
    open_pairs = across.unionByName(inside).distinct()
    rest = (
        open_pairs.join(placed.select(F.col("g").alias("ga"), F.col("c").alias("ca"), F.col("rep").alias("a")), ["ga", "ca"])
        .join(placed.select(F.col("g").alias("gb"), F.col("c").alias("cb"), F.col("rep").alias("b")), ["gb", "cb"])
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = verified(rest.join(tried, ["a", "b"], "left_anti"), docs, sketches, setting)
    component = components(first.unionByName(second))

    known = classes.join(component.withColumnRenamed("v", "rep"), "rep", "left").select(
        "whole", F.col("n").alias("size"), "rep", F.coalesce("component", "rep").alias("component")
    )
    return sets.select("id", "n", "whole").join(known.withColumnRenamed("whole", "w"), (F.col("whole") == F.col("w")) & F.col("id").isNotNull(), "left").select(
        "id", F.col("n").alias("n_shingles"),
        F.coalesce("rep", "id").alias("class_id"), F.coalesce("component", "id").alias("component_id"),
    )


def _possible(setting: Setting, left: tuple[str, str, str], right: tuple[str, str, str]):
    """Whether two sets that share a key at these places can overlap enough.

    Before the key they share no more than either has shared keys there, after it no more than is left.
    """
    (n, pos, before), (m, at, earlier) = (map(F.col, side) for side in (left, right))
    most = F.least(before, earlier) + F.least(n - pos, m - at)
    near = (F.least(n, m) * 100 >= F.greatest(n, m) * setting.percent)
    return near & ((100 + setting.percent) * most >= setting.percent * (n + m))
