"""Lineage on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.operators import lineage, omop
from formloom.plans.answers import stored_decisions
from formloom.plans.omop import FACTS_SQL
from formloom.plans.registry import Source, query
from formloom.plans.sqltext import sql_fact_id
from formloom.session import cut

EDGES_SQL = f"""{FACTS_SQL}, edges AS (
    SELECT 'raw:raw/events/' || response_id AS source, 'canonical:' || event_id AS target, 'canonicalized-as' AS relation FROM decided
    UNION ALL SELECT 'canonical:' || event_id, 'mapping:mapping_r1', 'evaluated-against' FROM decided
    UNION ALL SELECT 'mapping:mapping_r1', 'quality:' || event_id || ':' || decision, 'quality-evaluated' FROM decided
    UNION ALL SELECT 'quality:' || event_id || ':' || decision, 'omop:' || omop_table || ':' || fact_id, 'published-as' FROM facts
    UNION ALL SELECT 'omop:' || omop_table || ':' || fact_id, 'catalog:' || establishment_id || ':batch-1', 'summarized-in' FROM facts)"""


def event_lineage(src: Source) -> tuple[DataFrame, DataFrame]:
    decisions = stored_decisions(src)
    facts = omop.project_facts(decisions)
    rows = decisions.withColumn("object_key", F.col("evidence")[0]["object_key"]).withColumn(
        "mapping_release_id", F.lit("mapping_r1")
    )
    return lineage.lineage_edges(rows, facts, F.lit("batch-1")), facts


@query("m1_lineage_edges", "b_answers", sql=f"WITH {EDGES_SQL} SELECT source, target, relation FROM edges")
def m1_lineage_edges(src: Source) -> DataFrame:
    return event_lineage(src)[0]


@query(
    "m2_lineage_nodes",
    "b_answers",
    sql=f"""WITH {EDGES_SQL}, every AS (SELECT source, target FROM edges UNION ALL
      SELECT 'omop:' || omop_table || ':' || fact_id, 'omop:' || omop_table || ':' || {sql_fact_id('fact_id')} FROM facts)
    SELECT DISTINCT n AS node_id, split_part(n, ':', 1) AS kind FROM (SELECT source AS n FROM every UNION ALL SELECT target FROM every)""",
)
def m2_lineage_nodes(src: Source) -> DataFrame:
    from formloom.functions.identity import integer_fact_id

    edges, facts = event_lineage(src)
    stored = lineage.persisted_edges(facts.withColumn("omop_fact_id", integer_fact_id("fact_id")))
    return lineage.lineage_nodes(edges.unionByName(stored)).select("node_id", "kind")


@query(
    "m3_validate_graph",
    "b_edges",
    sql="""WITH nodes AS (SELECT DISTINCT source AS node_id FROM b_edges UNION ALL SELECT 'mapping:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT 'DUPLICATE_NODE' AS finding, node_id FROM nodes GROUP BY node_id HAVING count(*) > 1
    UNION ALL SELECT DISTINCT 'DANGLING_EDGE', n FROM (SELECT source AS n FROM b_edges UNION SELECT target FROM b_edges) WHERE n NOT IN (SELECT node_id FROM nodes)
    UNION ALL SELECT 'CYCLE', n FROM (VALUES ('catalog:0'), ('omop:0')) t(n)
    UNION ALL SELECT DISTINCT 'DANGLING_EDGE', n FROM (VALUES ('catalog:0')) t(n) WHERE n NOT IN (SELECT target FROM b_edges)""",
)
def m3_validate_graph(src: Source) -> DataFrame:
    edges = src.view("b_edges")
    nodes = edges.select(F.col("source").alias("node_id")).distinct().unionByName(
        src.table("customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("mapping:"), F.col("c_custkey").cast("string")).alias("node_id"))
    )
    # One edge back from the first region to its first nation closes a cycle.
    back = src.table("nation").filter("n_name = 'NATION_0'").select(
        F.concat(F.lit("catalog:"), F.col("n_regionkey").cast("string")).alias("source"),
        F.concat(F.lit("omop:"), F.col("n_nationkey").cast("string")).alias("target"),
    )
    return lineage.graph_findings(nodes, edges.unionByName(back))


@query(
    "m4_trace",
    "b_edges",
    sql="""WITH RECURSIVE up(start, node_id, depth) AS (
      SELECT DISTINCT 'catalog:' || n_regionkey, 'catalog:' || n_regionkey, 0 FROM nation
      UNION ALL SELECT u.start, e.source, u.depth + 1 FROM up u JOIN b_edges e ON e.target = u.node_id)
    SELECT start, node_id, min(depth) AS depth FROM up GROUP BY 1, 2""",
)
def m4_trace(src: Source) -> DataFrame:
    starts = src.table("nation").select(F.concat(F.lit("catalog:"), F.col("n_regionkey").cast("string")).alias("node_id")).distinct()
    return lineage.trace(src.view("b_edges"), starts)


@query(
    "m4_trace_downstream",
    "b_edges",
    sql="""WITH RECURSIVE down(start, node_id, depth) AS (
      SELECT DISTINCT 'canonical:' || o_orderkey, 'canonical:' || o_orderkey, 0 FROM orders
      UNION ALL SELECT d.start, e.target, d.depth + 1 FROM down d JOIN b_edges e ON e.source = d.node_id)
    SELECT start, node_id, min(depth) AS depth FROM down GROUP BY 1, 2""",
)
def m4_trace_downstream(src: Source) -> DataFrame:
    starts = src.table("orders").select(F.concat(F.lit("canonical:"), F.col("o_orderkey").cast("string")).alias("node_id"))
    return lineage.trace(src.view("b_edges"), starts, "downstream")


@query(
    "m4_trace_hub",
    "b_answers",
    sql=f"""WITH {EDGES_SQL}, q AS (SELECT DISTINCT 'quality:' || event_id || ':' || decision AS start FROM decided)
    SELECT start, start AS node_id, 0 AS depth, false AS hub FROM q UNION ALL SELECT start, 'mapping:mapping_r1', 1, true FROM q
    UNION ALL SELECT 'mapping:mapping_r1', 'mapping:mapping_r1', 0, true
    UNION ALL SELECT DISTINCT 'mapping:mapping_r1', 'canonical:' || event_id, 1, false FROM decided
    UNION ALL SELECT DISTINCT 'mapping:mapping_r1', 'raw:raw/events/' || response_id, 2, false FROM decided""",
)
def m4_trace_hub(src: Source) -> DataFrame:
    """All decided answers to their evidence, through the mapping release they share."""
    edges, _ = event_lineage(src)
    edges = cut(edges, "lineage")
    starts = edges.filter("relation = 'quality-evaluated'").select(F.col("target").alias("node_id"))
    return lineage.compact_trace(edges, starts, hub=100)


@query(
    "m3_cycles",
    sql="""WITH c AS (SELECT c_custkey AS k, c_custkey // 40 AS g, c_custkey % 40 AS i FROM customer),
    n AS (SELECT g, min(i) AS lo, max(i) AS hi, count(*) AS n FROM c GROUP BY g)
    SELECT 'CYCLE' AS finding, 'c' || k AS node_id FROM c JOIN n USING (g) WHERE g % 3 = 0 AND i >= 5 AND hi > 5 AND i <= hi""",
)
def m3_cycles(src: Source) -> DataFrame:
    """Customers in chains of forty, linked end to end; every third chain has an edge back to its sixth member."""
    key = F.col("c_custkey")
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    customers = cut(src.table("customer").select(key.alias("k"), F.floor(key / 40).alias("g")), "customers")
    ahead = customers.join(customers.select((F.col("k") - 1).alias("k"), F.col("g").alias("g2")), "k").filter("g = g2")
    onward = ahead.select(name(F.col("k")).alias("source"), name(F.col("k") + 1).alias("target"))
    ends = customers.groupBy("g").agg(F.max("k").alias("last")).filter("g % 3 = 0 AND last > g * 40 + 5")
    back = ends.select(name(F.col("last")).alias("source"), name((F.col("g") * 40 + 5).cast("bigint")).alias("target"))
    edges = onward.unionByName(back)
    nodes = customers.select(name(F.col("k")).alias("node_id"))
    return lineage.graph_findings(nodes, edges)
