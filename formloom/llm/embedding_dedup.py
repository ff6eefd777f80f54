"""Near-duplicate vectors by NN-descent.

A neighbour graph (k nearest found so far, for each vector) starts from blocks of random-hyperplane
orders and is refined by neighbours-of-neighbours joins: around each vector its neighbours and reverse
neighbours are compared with one another, and pairs that improve a list enter it. Edges at or above the
threshold, checked in double precision, are links.

A list in which every entry is a link is saturated: there may be more. Later rounds therefore look only
between the components found so far: a list holds the nearest member of each of k other components, so a
vector's own group takes no place in it. Rounds go on until one with new orders finds no new link.
Inside a component links are counted by reference to its most linked vector: with angles ``p`` and ``q`` to it, two members are linked for certain if ``p + q`` is within the threshold's
angle, and not if ``|p - q|`` is beyond it. Certain links are counted from a histogram of angles, so a
large group of near copies costs a row per member; what is left is compared in blocks.

A bounded set of queries is compared with all vectors to audit recall; below the target another round
with new orders refines the same graph, and after ``rounds`` of them what is left between components is
compared exactly, block by block.

Defined results: vectors that are null, zero, or hold null or non-finite components, and those without
a label, link with nothing. Only vectors of one label and one length are compared. Every row is a vector
of its own, also where ids repeat; a null id has a null component unless a link gives it another. Ties
between neighbours go to the row read first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formloom.llm.components import components
from formloom.session import cut


@dataclass(frozen=True)
class Setting:
    threshold: float = 0.93
    neighbours: int = 8
    orders: int = 4
    block: int = 512
    descents: int = 2
    audited: int = 400
    least_recall: float = 0.995
    rounds: int = 4


BINS = 1024
_SLACK = 1e-7
_CODE_BITS = 40
_CELL_BITS = 16
_LARGE = 64
_SHARES = 16


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision; rows that link with nothing get none."""
    for batch in batches:
        units = []
        for vector in batch.column(1).to_pylist():
            x = None if vector is None or None in vector else np.asarray(vector, dtype=np.float64)
            # Scaled first, so squares neither overflow nor vanish.
            most = np.abs(x).max() if x is not None and len(x) else 0.0
            if not (0 < most < np.inf):
                units.append(None)
                continue
            x = x / most
            units.append((x / np.sqrt(x @ x)).tobytes())
        yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), pa.array(units, pa.binary())], names=["id", "label", "dim", "unit"])


def _matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1).astype(dtype)


def _orders(points: DataFrame, setting: Setting) -> int:
    """Orders after which a lone pair at the threshold has met in a block as often as recall asks for.

    Two vectors stay together over a hyperplane with probability ``1 - angle / pi``, and about
    ``log2(n / block)`` hyperplanes split ``n`` vectors of a label down to blocks.
    """
    most = points.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    planes = 1 + max(0.0, math.log2(max(most, 1) / setting.block))
    together = (1 - math.acos(setting.threshold) / math.pi) ** planes
    return max(setting.orders, math.ceil(math.log(1 - setting.least_recall) / math.log(1 - together)))


def _codes(first: int, orders: int, seed: int):
    """Each vector once per order, with the signs of its projections on that order's hyperplanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        weights = 1 << np.arange(_CODE_BITS, dtype=np.int64)[::-1]
        for batch in batches:
            for dim in set(batch.column(2).to_pylist()):
                own = batch.filter(pa.array(np.array(batch.column(2).to_pylist()) == dim))
                x = _matrix(own.column(3))
                for order in range(first, first + orders):
                    if (order, dim) not in planes:
                        planes[order, dim] = np.random.default_rng([seed, order]).standard_normal((dim, _CODE_BITS))
                    codes = ((x @ planes[order, dim]) > 0) @ weights
                    yield pa.record_batch(
                        [pa.array(np.full(len(x), order), pa.int32()), own.column(1), own.column(2), pa.array(codes), own.column(0), own.column(3), *own.columns[4:]],
                        names=["ord", "label", "dim", "code", "rid", "unit", "component", "large"],
                    )

    return run


def _best(rids: np.ndarray, parts: np.ndarray, cosines: np.ndarray, k: int, bars: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Of each row the nearest member of each of the k nearest other components, if above that row's bar.

    As (row, member, its component, cosine).
    """
    names, inverse, sizes = np.unique(parts, return_inverse=True, return_counts=True)
    order = np.argsort(inverse, kind="stable")
    starts = np.cumsum(sizes) - sizes
    if len(names) == len(parts):
        member = np.broadcast_to(order, cosines.shape)
        cosines = cosines[:, order]
    else:
        member = np.tile(order[starts], (len(parts), 1))
        for j in np.flatnonzero(sizes > 1):
            columns = order[starts[j] : starts[j] + sizes[j]]
            member[:, j] = columns[np.argmax(cosines[:, columns], axis=1)]
        cosines = np.take_along_axis(cosines, member, axis=1)
    cosines[np.arange(len(parts)), inverse] = -2
    k = min(k, len(names))
    top = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    values = np.take_along_axis(cosines, top, axis=1)
    keep = values > (-1.5 if bars is None else bars[:, None])
    found = np.take_along_axis(member, top, axis=1)[keep]
    return np.repeat(rids, keep.sum(axis=1)), rids[found], parts[found], values[keep]


def _edges(v: np.ndarray, u: np.ndarray, part: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v, pa.int64()), pa.array(u, pa.int64()), pa.array(part, pa.int64()), pa.array(c, pa.float64())], names=["v", "u", "part", "cos"])


_EDGES = "v long, u long, part long, cos double"


def _block_edges(k: int, block: int):
    """Neighbours inside consecutive blocks of sorted rows; a block never mixes orders, labels or lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(rids, units, parts):
            x = np.frombuffer(b"".join(units), dtype=np.float64).reshape(len(rids), -1)
            return _edges(*_best(np.array(rids), np.array(parts), x @ x.T, k))

        key, rids, units, parts = None, [], [], []
        for batch in batches:
            for order, label, dim, rid, unit, part in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6))):
                if (order, label, dim) != key or len(rids) == block:
                    if len(rids) > 1:
                        yield compared(rids, units, parts)
                    key, rids, units, parts = (order, label, dim), [], [], []
                rids.append(rid)
                units.append(unit)
                parts.append(part)
        if len(rids) > 1:
            yield compared(rids, units, parts)

    return run


def _local_join(k: int):
    """Around each vector: its members compared with one another, pairs that beat a member's bar come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(rids, units, parts, bars):
            x = np.frombuffer(b"".join(units), dtype=np.float64).reshape(len(rids), -1)
            return _best(np.array(rids), np.array(parts), x @ x.T, k, np.array(bars))

        around, rids, units, parts, bars, found = None, [], [], [], [], []
        for batch in batches:
            for centre, rid, unit, part, bar in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if centre != around:
                    if len(rids) > 1:
                        found.append(compared(rids, units, parts, bars))
                    around, rids, units, parts, bars = centre, [], [], [], []
                rids.append(rid)
                units.append(unit)
                parts.append(part)
                bars.append(bar)
            if found:
                yield _edges(*map(np.concatenate, zip(*found)))
                found = []
        if len(rids) > 1:
            yield _edges(*compared(rids, units, parts, bars))

    return run


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest components of each v. A list is fed by a few blocks or centres, so it is small before the cut."""
    best = edges.repartition("v").groupBy("v", "part").agg(F.max(F.struct("cos", (-F.col("u")).alias("u"))).alias("best"))
    distinct = best.select("v", (-F.col("best.u")).alias("u"), "part", F.col("best.cos").alias("cos"))
    order = Window.partitionBy("v").orderBy(F.desc("cos"), "u")
    return cut(distinct.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= k).drop("i"), "graph")


def _started(points: DataFrame, graph: DataFrame | None, setting: Setting, orders: int, seed: int) -> DataFrame:
    """``graph`` with the neighbours in blocks of new orders, a few orders at a time.

    A large component would fill whole blocks with its own members, so of those with the same first
    signs only one stands in an order, another one in the next.
    """
    schema = "ord int, label string, dim int, code long, rid long, unit binary, component long, large boolean"
    for first in range(0, orders, setting.orders):
        coded = points.mapInArrow(_codes(first, min(setting.orders, orders - first), seed), schema)
        place = F.xxhash64("rid", "ord", F.lit(seed))
        if seed:
            one = F.min_by(F.struct("code", "rid", "unit"), place).alias("one")
            cell = F.shiftright("code", _CODE_BITS - _CELL_BITS)
            thin = coded.filter("large").groupBy("ord", "label", "dim", "component", cell).agg(one)
            coded = coded.filter("NOT large").drop("large").unionByName(thin.select("ord", "label", "dim", "component", "one.*"))
        else:
            coded = coded.drop("large")
        ordered = (
            coded.repartitionByRange("ord", "label", "dim", "code", place)
            .sortWithinPartitions("ord", "label", "dim", "code", place)
            .select("ord", "label", "dim", "code", "rid", "unit", "component")
        )
        found = ordered.mapInArrow(_block_edges(setting.neighbours, setting.block), _EDGES)
        graph = _nearest(found if graph is None else graph.unionByName(found), setting.neighbours)
    return graph


def _descend(graph: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """One round of neighbours-of-neighbours joins."""
    order = Window.partitionBy("u").orderBy(F.desc("cos"), "v")
    reverse = graph.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= k)
    members = (
        graph.select(F.col("v").alias("centre"), F.col("u").alias("rid"))
        .union(reverse.select(F.col("u").alias("centre"), F.col("v").alias("rid")))
        .union(graph.select(F.col("v").alias("centre"), F.col("v").alias("rid")))
        .distinct()
    )
    bars = graph.groupBy("v").agg(F.when(F.count(F.lit(1)) >= k, F.min("cos")).otherwise(F.lit(-1.5)).alias("bar"))
    known = points.select("rid", "unit", "component").join(bars.withColumnRenamed("v", "rid"), "rid")
    around = members.join(known, "rid").select("centre", "rid", "unit", "component", "bar").repartition("centre").sortWithinPartitions("centre")
    better = around.mapInArrow(_local_join(k), _EDGES)
    return _nearest(graph.unionByName(better), k)


def _between(graph: DataFrame, points: DataFrame) -> DataFrame:
    """Those edges that join different components, as ``points`` name them now."""
    part = points.select(F.col("rid").alias("u"), F.col("component").alias("part"))
    own = points.select(F.col("rid").alias("v"), F.col("component").alias("own"))
    return graph.drop("part").join(part, "u").join(own, "v").filter("part <> own").select("v", "u", "part", "cos")


def _angle(cosine):
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def _dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cosine of two unit vectors of each row, in double precision."""
    for batch in batches:
        pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
        dots = [float(np.frombuffer(a) @ np.frombuffer(b)) for a, b in pairs]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(dots, pa.float64())], names=["a", "b", "cos"])


def _cosines(pairs: DataFrame, points: DataFrame) -> DataFrame:
    left = points.select(F.col("rid").alias("a"), F.col("unit").alias("ua"))
    right = points.select(F.col("rid").alias("b"), F.col("unit").alias("ub"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ua", "ub").mapInArrow(_dots, "a long, b long, cos double")


def _open_counts(threshold: float):
    """Links between a block of members and a block of others, beyond those that are certain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for xs, ys in zip(batch.column(0), batch.column(1)):
                xs, ys = xs.values, ys.values
                cosines = _matrix(xs.field("unit")) @ _matrix(ys.field("unit")).T
                sure, bins = xs.field("sure").to_numpy(), ys.field("bin").to_numpy()
                x, y = xs.field("rid").to_numpy(), ys.field("rid").to_numpy()
                linked = (cosines >= threshold) & (bins[None, :] > sure[:, None]) & (x[:, None] != y[None, :])
                yield pa.record_batch([pa.array(x), pa.array(linked.sum(axis=1), pa.int64())], names=["rid", "n"])

    return run


def _enlarged(member: DataFrame, degree: DataFrame, points: DataFrame, setting: Setting) -> DataFrame:
    """(rid, n) links of each member (rid, component) with all members of its component."""
    limit = math.acos(setting.threshold)
    width = limit / BINS
    centre = member.join(degree, "rid").groupBy("component").agg(F.max_by("rid", F.struct("n", -F.col("rid"))).alias("b"))
    spread = _cosines(member.join(centre, "component").select(F.col("rid").alias("a"), "b"), points)
    angles = spread.select(F.col("a").alias("rid"), _angle(F.col("cos")).alias("angle")).join(member, "rid")
    placed = cut(
        angles.withColumn("bin", F.floor(F.col("angle") / width))
        # Bins up to this one are certainly linked.
        .withColumn("sure", F.floor((F.lit(limit - _SLACK) - F.col("angle")) / width) - 1)
        .select("rid", "component", "bin", "sure"),
        "angles",
    )
    # At most pi / width bins in a component's histogram.
    bins = placed.groupBy("component", "bin").agg(F.count(F.lit(1)).alias("n"))
    histogram = bins.groupBy("component").agg(F.collect_list(F.struct("bin", "n")).alias("bins"), F.max("bin").alias("last"))
    seen = placed.join(histogram, "component")
    within = F.aggregate("bins", F.lit(0).cast("long"), lambda s, b: s + F.when(b["bin"] <= F.col("sure"), b["n"]).otherwise(0))
    certain = seen.select("rid", (within - F.when(F.col("bin") <= F.col("sure"), 1).otherwise(0)).alias("n"))

    # Members for which not all others are certain, against those others, block by block.
    open_members = seen.filter("sure < last").select("rid", "component", "sure", "bin")
    sizes = open_members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("sure").alias("floor"))
    block = F.pmod(F.xxhash64("rid"), F.ceil(F.col("size") / setting.block)).alias("block")
    with_units = points.select("rid", "unit")
    xs = (
        open_members.join(sizes, "component").join(with_units, "rid")
        .groupBy("component", block).agg(F.collect_list(F.struct("rid", "sure", "unit")).alias("xs"))
    )
    others = placed.join(sizes.select("component", "floor"), "component").filter(F.col("bin") > F.col("floor"))
    amounts = others.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    ys = (
        others.join(amounts, "component").join(with_units, "rid")
        .groupBy("component", block).agg(F.collect_list(F.struct("rid", "bin", "unit")).alias("ys"))
    )
    pairs = xs.select("component", "xs").join(ys.select("component", "ys"), "component").select("xs", "ys")
    counted = pairs.mapInArrow(_open_counts(setting.threshold), "rid long, n long")
    return certain.unionByName(counted).groupBy("rid").agg(F.sum("n").alias("n"))


def _placed(points: DataFrame, member: DataFrame) -> DataFrame:
    """``points`` with their component, themselves if they have none, and whether it is a large one."""
    sizes = member.groupBy("component").agg((F.count(F.lit(1)) > _LARGE).alias("large"))
    own = points.join(member.join(sizes, "component"), "rid", "left")
    return cut(own.select(*points.columns, F.coalesce("component", "rid").alias("component"), F.coalesce("large", F.lit(False)).alias("large")), "placed")


def _counts(member: DataFrame, links: DataFrame, points: DataFrame, setting: Setting) -> DataFrame:
    """(rid, n): all links of each member of a component with the others in it."""
    degree = links.select(F.col("a").alias("rid")).union(links.select("b")).groupBy("rid").agg(F.count(F.lit(1)).alias("n"))
    several = member.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 2").select("component")
    whole = _enlarged(cut(member.join(several, "component", "left_semi"), "several"), degree, points, setting)
    pairs = member.join(several, "component", "left_anti").select("rid", F.lit(1).cast("long").alias("n"))
    return cut(whole.select("rid", "n").unionByName(pairs), "counts")


def _cross_links(threshold: float):
    """A link for each two components that have one between two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for xs, ys in zip(batch.column(0), batch.column(1)):
                xs, ys = xs.values, ys.values
                p, q = xs.field("component").to_numpy(), ys.field("component").to_numpy()
                linked = (_matrix(xs.field("unit")) @ _matrix(ys.field("unit")).T >= threshold) & (p[:, None] != q[None, :])
                i, j = np.nonzero(linked)
                some = np.unique(np.stack([p[i], q[j]]), axis=1, return_index=True)[1]
                a, b = xs.field("rid").to_numpy()[i[some]], ys.field("rid").to_numpy()[j[some]]
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _remaining(placed: DataFrame, setting: Setting) -> DataFrame:
    """Links between components by comparing all blocks of a label: exact, and quadratic in the label."""
    sizes = placed.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size"))
    block = F.pmod(F.xxhash64("rid"), F.ceil(F.col("size") / setting.block)).alias("block")
    blocks = cut(
        placed.join(sizes, ["label", "dim"]).groupBy("label", "dim", block).agg(F.collect_list(F.struct("rid", "component", "unit")).alias("rows")),
        "blocks",
    )
    share = F.pmod("block", F.lit(_SHARES)).cast("int").alias("share")
    xs = blocks.select("label", "dim", share, F.col("block").alias("x"), F.col("rows").alias("xs"))
    ys = blocks.select("label", "dim", F.explode(F.sequence(F.lit(0), F.lit(_SHARES - 1))).alias("share"), F.col("block").alias("y"), F.col("rows").alias("ys"))
    pairs = xs.join(ys, ["label", "dim", "share"]).filter("x <= y").select("xs", "ys")
    return cut(pairs.mapInArrow(_cross_links(setting.threshold), "a long, b long"), "remaining")


def _audit(points: DataFrame, counts: DataFrame, setting: Setting) -> float:
    """Mean share of their true links that vectors have, over the vectors that have any.

    Of the vectors with links and of those without, ``audited`` each are picked by a hash and stand for
    all of their kind, so neither large groups nor the many lone vectors hide what small groups lose.
    """
    known = points.join(counts, "rid", "left").select("rid", "label", "dim", "unit", "n")
    sizes = known.agg(F.count("n"), F.count(F.lit(1))).first()
    kinds = {True: sizes[0], False: sizes[1] - sizes[0]}
    queries = []
    for linked in kinds:
        some = known.filter(F.col("n").isNotNull() if linked else F.col("n").isNull())
        queries += some.orderBy(F.xxhash64("rid"), "rid").limit(setting.audited).collect()
    if not queries:
        return 1.0
    rows = [(q["rid"], q["label"], q["dim"], bytes(q["unit"])) for q in queries]
    threshold = setting.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array([f"{dim}:{label}" for label, dim in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())], dtype=object)
            for key in set(keys):
                own = [q for q in rows if f"{q[2]}:{q[1]}" == key]
                if not own:
                    continue
                some = batch.filter(pa.array(keys == key))
                x = _matrix(some.column(3))
                q = np.frombuffer(b"".join(r[3] for r in own)).reshape(len(own), -1)
                same = np.array([r[0] for r in own])[:, None] == some.column(0).to_numpy()[None, :]
                true = ((q @ x.T >= threshold) & ~same).sum(axis=1)
                yield pa.record_batch([pa.array([r[0] for r in own], pa.int64()), pa.array(true, pa.int64())], names=["rid", "true"])

    whole = points.select("rid", "label", "dim", "unit").mapInArrow(run, "rid long, true long").groupBy("rid").agg(F.sum("true").alias("true"))
    true = {r["rid"]: r["true"] for r in whole.collect()}  # one row per query
    return mean_recall([(q["n"], true.get(q["rid"], 0)) for q in queries], kinds)


def mean_recall(found: list[tuple[int | None, int]], kinds: dict[bool, int]) -> float:
    """Mean recall of queries (links found or None, true links), each kind weighed by its vectors; 1 if none has links."""
    drawn = {kind: sum((n is not None) == kind for n, _ in found) for kind in kinds}
    shares = [(kinds[n is not None] / drawn[n is not None], min(n or 0, true) / true) for n, true in found if true]
    return sum(w * r for w, r in shares) / sum(w for w, _ in shares) if shares else 1.0


def near_duplicates(
    vectors: DataFrame, setting: Setting = Setting(), id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    given = vectors.select(
        F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).cast("string").alias("label"),
        F.coalesce(F.size(vector), F.lit(0)).cast("int").alias("dim"),
    )
    schema = f"id {given.schema['id'].dataType.simpleString()}, label string, dim int, unit binary"
    rows = cut(given.mapInArrow(_units, schema).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    points = rows.filter("unit IS NOT NULL AND label IS NOT NULL").select("rid", "label", "dim", "unit")

    orders = _orders(points, setting)
    graph, links, member, attempt = None, None, None, 0
    while True:
        if member is None:
            placed = points.withColumn("component", F.col("rid")).withColumn("large", F.lit(False))
        else:
            placed = _placed(points, member)
            graph = _between(graph, placed)
        graph = _started(placed, graph, setting, orders, attempt)
        for _ in range(setting.descents):
            graph = _descend(graph, placed, setting.neighbours)
        near = graph.filter(F.col("cos") >= setting.threshold - 1e-6)
        pairs = near.select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b")).distinct()
        new = cut(_cosines(pairs, points).filter(F.col("cos") >= setting.threshold).select("a", "b"), "near-links")
        quiet = attempt > 0 and new.isEmpty()
        if not quiet:
            links = new if links is None else links.unionByName(new)
            member = cut(components(links).select(F.col("v").alias("rid"), "component"), "member")
        attempt += 1
        if not quiet and attempt < setting.rounds:
            continue
        counts = _counts(member, links, points, setting)
        enough = _audit(points, counts, setting) >= setting.least_recall
        if enough and quiet:
            break
        if not enough and attempt >= setting.rounds:
            links = links.unionByName(_remaining(_placed(points, member), setting))
            member = cut(components(links).select(F.col("v").alias("rid"), "component"), "member")
            counts = _counts(member, links, points, setting)
            break

    named = member.join(rows.select("rid", "id"), "rid")
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    found = named.join(least, "component").select("rid", "least").join(counts, "rid")
    return rows.select("rid", "id").join(found, "rid", "left").select(
        F.col("id").alias(id),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("least", "id").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("least", "id")).alias("kept"),
    )
