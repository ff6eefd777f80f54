"""Evidence lineage as an edge list."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.session import cut

# Node kinds, in the order evidence flows.
NODE_KINDS = ("raw", "canonical", "mapping", "quality", "omop", "catalog")


def _node(kind: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *parts)


def lineage_edges(decisions: DataFrame, facts: DataFrame, batch_id: Column) -> DataFrame:
    """Edges of every decided answer: source, target, relation.

    ``decisions``: ``event_id, establishment_id, object_key, mapping_release_id, decision,
    clinical_event_id``; ``facts``: ``clinical_event_id, omop_table, fact_id``. The last two edges
    exist only where a fact was published.
    """
    rows = decisions.join(facts.select("clinical_event_id", "omop_table", "fact_id"), "clinical_event_id", "left")
    canonical = _node("canonical", F.col("event_id"))
    mapping = _node("mapping", F.col("mapping_release_id"))
    quality = _node("quality", F.col("event_id"), F.col("decision"))
    omop = _node("omop", F.col("omop_table"), F.col("fact_id"))
    catalog = _node("catalog", F.col("establishment_id"), batch_id)
    published = F.col("fact_id").isNotNull()

    def edge(source: Column, target: Column, relation: str) -> Column:
        return F.struct(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"))

    steps = F.array_compact(
        F.array(
            edge(_node("raw", F.col("object_key")), canonical, "canonicalized-as"),
            edge(canonical, mapping, "evaluated-against"),
            edge(mapping, quality, "quality-evaluated"),
            F.when(published, edge(quality, omop, "published-as")),
            F.when(published, edge(omop, catalog, "summarized-in")),
        )
    )
    return rows.select(F.explode(steps).alias("e")).select("e.*")


def persisted_edges(facts: DataFrame) -> DataFrame:
    """Edge from each fact to the row it was stored as."""
    return facts.select(
        _node("omop", F.col("omop_table"), F.col("fact_id")).alias("source"),
        _node("omop", F.col("omop_table"), F.col("omop_fact_id").cast("string")).alias("target"),
        F.lit("persisted-as").alias("relation"),
    )


def lineage_nodes(edges: DataFrame) -> DataFrame:
    """Distinct endpoints with their kind, the part before the first colon."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    return ends.select("node_id", F.split_part("node_id", F.lit(":"), F.lit(1)).alias("kind"), F.col("node_id").alias("label"))


def graph_findings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(finding, node_id): repeated node ids, edges to missing nodes, nodes on a cycle or between two.

    A node is reported as CYCLE where it reaches a cycle and a cycle reaches it. What has no edge in or none out
    cannot, and is taken off first; in what is left both are found by contracting chains, see ``reaches_cycle``, so
    neither long paths nor long cycles take more than their logarithm in rounds.
    """
    steps = cut(edges.select(F.col("source").alias("a"), F.col("target").alias("b")), "edges")
    marks = _marks(steps).unionByName(nodes.select("node_id", F.lit(1).alias("listed"), F.lit(False).alias("out"), F.lit(False).alias("into")))
    marks = marks.groupBy("node_id").agg(F.sum("listed").alias("listed"), F.max("out").alias("out"), F.max("into").alias("into"))
    # A null end never matches a node, not even a null one.
    missing = (F.col("out") | F.col("into")) & ((F.col("listed") == 0) | F.col("node_id").isNull())
    found = F.array_compact(F.array(F.when(F.col("listed") > 1, F.lit("DUPLICATE_NODE")), F.when(missing, F.lit("DANGLING_EDGE"))))
    marks = marks.select("node_id", (F.col("out") & F.col("into")).alias("inner"), found.alias("found"))
    marks = cut(marks.filter(F.col("inner") | (F.size("found") > 0)), "marks")
    steps = _core(steps, marks.filter("inner").select("node_id"))
    onward = reaches_cycle(steps)
    # Only what reaches a cycle can lie on one, so the way back is sought among those alone.
    inner = _kept(steps, onward)
    backward = reaches_cycle(cut(inner.select(F.col("b").alias("a"), F.col("a").alias("b")), "edges"))
    return marks.select(F.explode("found").alias("finding"), "node_id").unionByName(backward.select(F.lit("CYCLE").alias("finding"), "node_id"))


def _marks(steps: DataFrame) -> DataFrame:
    """Both ends of every edge (a, b), with the side they are on."""
    ends = F.array(
        F.struct(F.col("a").alias("node_id"), F.lit(0).alias("listed"), F.lit(True).alias("out"), F.lit(False).alias("into")),
        F.struct(F.col("b").alias("node_id"), F.lit(0).alias("listed"), F.lit(False).alias("out"), F.lit(True).alias("into")),
    )
    return steps.select(F.explode(ends).alias("e")).select("e.*")


def _kept(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges (a, b) between ``nodes`` (node_id). Never broadcast: in a loop that would add up at the driver."""
    for end in ("a", "b"):
        steps = steps.join(nodes.withColumnRenamed("node_id", end).hint("merge"), end, "left_semi")
    return steps.select("a", "b")


def _core(steps: DataFrame, inner: DataFrame) -> DataFrame:
    """The edges (a, b) without those of nodes that have no edge in or none out, again while half of them go.

    Layers then go one by one at a cost that halves each time; long chains are left to ``reaches_cycle``.
    """
    left = cut(_kept(steps, inner), "core")
    before = left.count()
    while before:
        sides = _marks(left).groupBy("node_id").agg(F.max("out").alias("out"), F.max("into").alias("into"))
        left = cut(_kept(left, sides.filter("out AND into").select("node_id")), "core")
        after = left.count()
        if 2 * after > before:
            break
        before = after
    return left


def reaches_cycle(edges: DataFrame) -> DataFrame:
    """(node_id) of the nodes from which a cycle can be reached along ``edges`` (a, b).

    In every round a node with a single edge out is merged into the first node on its way that has none or
    several; pointers double, so a chain of n takes about log n joins, and a chain that never ends is a cycle.
    Edges into nodes without a way out go. What is left has at least two edges out of each node, so the number
    of rounds follows the layers of branching and not the lengths of paths. No join broadcasts: over the rounds
    that would send the graph to the driver many times.
    """
    left = cut(edges.select("a", "b").distinct(), "edges")
    merged = cut(left.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("rep", F.col("v")), "merged")
    found = None
    while not left.isEmpty():
        out = cut(left.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("to")), "out")
        single = out.filter("n = 1 AND a <> to").select("a", "to")
        points, endless = _doubled(single)
        loops = left.filter("a = b").select(F.col("a").alias("v"))
        hits = loops.unionByName(endless.select(F.col("a").alias("v")))
        hits = cut((hits if found is None else hits.unionByName(found)).distinct(), "hits")
        merged = cut(
            merged.join(points.select(F.col("a").alias("rep"), "to").hint("merge"), "rep", "left").select("v", F.coalesce("to", "rep").alias("rep")), "merged"
        )
        moved = left.join(points.select(F.col("a").alias("b"), "to").hint("merge"), "b", "left").select("a", F.coalesce("to", "b").alias("b"))
        # A node merged into another has no edges of its own any more.
        moved = cut(moved.join(points.select("a").hint("merge"), "a", "left_anti").distinct(), "moved")
        # One step back from what is known to reach a cycle; those nodes are done with.
        before = moved.join(hits.withColumnRenamed("v", "b").hint("merge"), "b", "left_semi").select(F.col("a").alias("v"))
        found = cut(hits.unionByName(before).distinct(), "found")
        open_edges = moved.join(found.withColumnRenamed("v", "a").hint("merge"), "a", "left_anti")
        sources = open_edges.select(F.col("a").alias("b")).unionByName(found.withColumnRenamed("v", "b")).distinct()
        left = cut(open_edges.join(sources.hint("merge"), "b", "left_semi"), "edges")
    if found is None:
        return merged.select(F.col("v").alias("node_id")).limit(0)
    return merged.join(found.withColumnRenamed("v", "rep").hint("merge"), "rep", "left_semi").select(F.col("v").alias("node_id"))


def _doubled(single: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, to) of single steps followed to the first node without one, and (a) of those that never end."""
    points = cut(single, "points")
    most = points.count()
    step = 1
    while True:
        inside = points.join(points.select(F.col("a").alias("to")).hint("merge"), "to", "left_semi")
        if step > most or inside.isEmpty():
            break
        onward = points.select(F.col("a").alias("to"), F.col("to").alias("next"))
        points = cut(points.join(onward.hint("merge"), "to", "left").select("a", F.coalesce("next", "to").alias("to")), "points")
        step *= 2
    endless = cut(inside.select("a"), "endless")
    return points.join(endless.hint("merge"), "a", "left_anti"), endless


HUB = 1_000


def compact_trace(edges: DataFrame, starts: DataFrame, direction: str = "upstream", hub: int = HUB) -> DataFrame:
    """(start, node_id, depth, hub): what each start reaches without passing a hub, and the same once for each hub.

    A hub is a node that more than ``hub`` nodes lie right behind, such as the mapping release all answers of a
    batch were evaluated against. A start's own rows stop at the hubs it meets (``hub`` is true on such a row and on
    a hub's own); what lies behind a hub is there once, with the hub as ``start``, however many starts meet it.
    Rows are then bounded by starts and edges and not by their product; ``expand_trace`` gives the pairs.
    """
    here, there = ("target", "source") if direction == "upstream" else ("source", "target")
    step = cut(edges.select(F.col(here).alias("node_id"), F.col(there).alias("_next")).distinct(), "steps")
    hubs = cut(step.groupBy("node_id").count().filter(F.col("count") > hub).select("node_id"), "hubs")
    first = starts.select("node_id").unionByName(hubs).distinct()
    seen = cut(first.select(F.col("node_id").alias("start"), "node_id", F.lit(0).alias("depth")), "seen")
    frontier = seen
    # A hub goes on only where it is the start.
    for depth in itertools.count(1):
        own = frontier.join(hubs, "node_id", "left_anti")
        if depth == 1:
            own = frontier
        fresh = own.join(step, "node_id").select("start", F.col("_next").alias("node_id")).distinct()
        fresh = fresh.join(seen.select("start", "node_id"), ["start", "node_id"], "left_anti")
        frontier = cut(fresh.withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    # Hubs that no start meets, directly or through other hubs, are left out. Hubs are few beside starts, so rows are
    # told apart by them and not by the starts, which would shuffle every row.
    seen = seen.filter("start IS NOT NULL")
    added = cut(hubs.join(starts.select("node_id"), "node_id", "left_anti"), "added")
    of_starts = seen.join(added.withColumnRenamed("node_id", "start"), "start", "left_anti").select("node_id")
    met = cut(hubs.join(starts.select("node_id"), "node_id", "left_semi").unionByName(of_starts.join(hubs, "node_id", "left_semi")).distinct(), "met")
    while True:
        behind = seen.join(met.withColumnRenamed("node_id", "start"), "start", "left_semi").join(hubs, "node_id", "left_semi").select("node_id")
        more = cut(behind.unionByName(met).distinct(), "met")
        if more.count() == met.count():
            break
        met = more
    unmet = cut(added.join(met, "node_id", "left_anti"), "unmet")
    marked = hubs.withColumn("hub", F.lit(True))
    kept = seen.join(unmet.withColumnRenamed("node_id", "start"), "start", "left_anti")
    return kept.join(marked, "node_id", "left").select("start", "node_id", "depth", F.coalesce("hub", F.lit(False)).alias("hub"))


def expand_trace(compact: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node_id, depth) of ``compact_trace`` with the hubs followed: every pair, at its shortest distance."""
    compact = cut(compact, "compact")
    seen = cut(compact.join(starts.select(F.col("node_id").alias("start")).distinct(), "start", "left_semi"), "expanded")
    hubs = compact.select(F.col("start").alias("_hub"), "node_id", F.col("depth").alias("_more"), "hub")
    while True:
        through = seen.filter("hub AND start <> node_id").select("start", F.col("node_id").alias("_hub"), "depth").join(hubs, "_hub")
        both = seen.unionByName(through.select("start", "node_id", (F.col("depth") + F.col("_more")).alias("depth"), "hub"))
        after = cut(both.groupBy("start", "node_id").agg(F.min("depth").alias("depth"), F.max("hub").alias("hub")), "expanded")
        if after.exceptAll(seen.select(*after.columns)).isEmpty():
            return after.select("start", "node_id", "depth")
        seen = after


def trace(edges: DataFrame, starts: DataFrame, direction: str = "upstream") -> DataFrame:
    """(start, node_id, depth): everything reachable from each start, with its shortest distance.

    Walks on until nothing new is met, so cycles end it and depth does not. The result has a row for
    each pair of a start and a node it reaches, which is what the caller asks for by its starts.

    ``upstream`` walks against the edges, to the evidence; ``downstream`` along them.
    """
    here, there = ("target", "source") if direction == "upstream" else ("source", "target")
    every = cut(edges.select(F.col(here).alias("node_id"), F.col(there).alias("_next")).distinct(), "steps")
    # A walk only comes by starts and by what an edge leads to; other edges need not be joined in every round.
    passed = starts.select("node_id").unionByName(every.select(F.col("_next").alias("node_id"))).distinct()
    step = cut(every.join(passed, "node_id", "left_semi"), "steps")
    seen = cut(starts.select(F.col("node_id").alias("start"), "node_id", F.lit(0).alias("depth")), "seen")
    frontier = seen
    for depth in itertools.count(1):
        onward = frontier.join(step, "node_id").select("start", F.col("_next").alias("node_id")).distinct()
        frontier = cut(
            onward.join(seen.select("start", "node_id"), ["start", "node_id"], "left_anti").withColumn("depth", F.lit(depth)),
            "frontier",
        )
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
