"""Releases on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.operators import catalog, membership, omop, quality, releases
from formloom.plans.answers import REPLAY_ENTRIES, decided_sql, entries_sql, event_canonical, event_entries, stored_decisions
from formloom.plans.registry import Source, query
from formloom.session import cut


def line_facts(src: Source, flags: list[str]) -> DataFrame:
    rows = src.table("lineitem").filter(F.col("l_returnflag").isin(flags))
    return rows.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("clinical_event_id"),
        F.when(F.col("l_linenumber") % 2 == 0, "observation").otherwise("measurement").alias("omop_table"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("omop_fact_id"),
    )


FACT_SQL = """(SELECT l_orderkey || '-' || l_linenumber AS clinical_event_id, CASE WHEN l_linenumber % 2 = 0 THEN 'observation' ELSE 'measurement' END AS omop_table,
    l_orderkey * 10 + l_linenumber AS omop_fact_id FROM lineitem WHERE l_returnflag IN ({flags}))"""


@query(
    "j1_roll_forward_membership",
    sql=f"""SELECT omop_table, min(omop_fact_id) AS omop_fact_id, clinical_event_id, 'release_2' AS release_id FROM
      (SELECT * FROM {FACT_SQL.format(flags="'A','N'")} UNION ALL SELECT * FROM {FACT_SQL.format(flags="'N','R'")}) GROUP BY omop_table, clinical_event_id""",
)
def j1_roll_forward_membership(src: Source) -> DataFrame:
    return releases.roll_forward_membership(
        line_facts(src, ["A", "N"]), line_facts(src, ["N", "R"]), F.lit("release_2")
    )


@query(
    "j1_membership_shared_ids",
    sql=f"""SELECT omop_table, min(omop_fact_id // 10) AS omop_fact_id, clinical_event_id, 'release_2' AS release_id
      FROM {FACT_SQL.format(flags="'A','N','R'")} GROUP BY omop_table, clinical_event_id""",
)
def j1_membership_shared_ids(src: Source) -> DataFrame:
    """All lines of an order share one integer id here, and each stays a member."""
    shared = F.call_function("div", F.col("omop_fact_id"), F.lit(10))
    parent, new = (line_facts(src, flags).withColumn("omop_fact_id", shared) for flags in (["A", "N"], ["N", "R"]))
    return releases.roll_forward_membership(parent, new, F.lit("release_2"))


BATCH_SQL = """b AS (SELECT CAST(o_orderdate AS DATE) AS created_at, 'batch-' || o_orderpriority AS batch_id, 'mapping_r' || (count(*) % 2) AS mapping_release_id,
    sha256(CAST(sum(o_orderkey) AS BIGINT)::VARCHAR) AS source_manifest_checksum, sha256(CAST(sum(o_custkey) AS BIGINT)::VARCHAR) AS output_checksum,
    count(*) FILTER (o_orderstatus <> 'P') AS published, count(*) FILTER (o_orderstatus = 'P') AS quarantined FROM orders GROUP BY o_orderdate, o_orderpriority)"""
LEDGER_SQL = BATCH_SQL + """, n AS (SELECT *, 'release_' || substr(sha256('{"batch_id":"' || batch_id || '","mapping_release_id":"' || mapping_release_id ||
    '","output_checksum":"' || output_checksum || '","source_manifest_checksum":"' || source_manifest_checksum || '"}'), 1, 16) AS release_id FROM b),
    ledger AS (SELECT release_id, created_at, batch_id, CAST(sum(published) OVER w AS BIGINT) AS published_count, CAST(sum(quarantined) OVER w AS BIGINT) AS quarantined_count,
      lag(release_id) OVER (ORDER BY created_at, batch_id) AS parent_release_id FROM n WINDOW w AS (ORDER BY created_at, batch_id ROWS UNBOUNDED PRECEDING))"""


def ledger(src: Source) -> DataFrame:
    """One batch per order day and priority."""
    batches = src.table("orders").groupBy(F.col("o_orderdate").cast("date").alias("created_at"), "o_orderpriority").agg(
        F.concat(F.lit("mapping_r"), (F.count(F.lit(1)) % 2).cast("string")).alias("mapping_release_id"),
        F.sha2(F.sum("o_orderkey").cast("string"), 256).alias("source_manifest_checksum"),
        F.sha2(F.sum("o_custkey").cast("string"), 256).alias("output_checksum"),
        F.count_if(F.col("o_orderstatus") != "P").alias("published"),
        F.count_if(F.col("o_orderstatus") == "P").alias("quarantined"),
    ).withColumn("batch_id", F.concat(F.lit("batch-"), "o_orderpriority"))
    return releases.release_ledger(batches)


@query(
    "j2_release_ledger",
    sql=f"WITH {LEDGER_SQL} SELECT release_id, parent_release_id, published_count, quarantined_count, created_at FROM ledger",
)
def j2_release_ledger(src: Source) -> DataFrame:
    return ledger(src).select("release_id", "parent_release_id", "published_count", "quarantined_count", "created_at")


@query(
    "j3_verify_release",
    sql="""SELECT o_orderkey AS release_id, o_orderstatus = 'F' AS verified, CASE o_orderstatus WHEN 'O' THEN 'No artifact is stored'
      WHEN 'P' THEN 'Stored and computed checksum differ' END AS reason, sha256(o_orderpriority) AS checksum_sha256 FROM orders""",
)
def j3_verify_release(src: Source) -> DataFrame:
    orders = src.table("orders")
    stored = orders.select(F.col("o_orderkey").alias("release_id"), F.sha2("o_orderpriority", 256).alias("checksum_sha256"))
    body = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("changed")
    artifacts = orders.filter("o_orderstatus <> 'O'").select(
        F.col("o_orderkey").alias("release_id"), F.sha2(body, 256).alias("artifact_checksum")
    )
    return releases.verify_releases(stored, artifacts)


@query(
    "j4_compare_releases",
    "b_coverage",
    sql="""WITH m AS (SELECT *, 'release_' || extract(year FROM period_start) AS rid FROM b_coverage),
    r AS (SELECT rid AS release_id, min(period_start) AS created_at, CAST(sum(usable_count) AS BIGINT) AS published_count FROM m GROUP BY rid)
    SELECT release_id, created_at, published_count, establishment_id, recorded_count, usable_count, positive_count
    FROM r JOIN m ON m.rid = r.release_id WHERE concept_key = '5-LOW'""",
)
def j4_compare_releases(src: Source) -> DataFrame:
    release = F.concat(F.lit("release_"), F.year("period_start").cast("string"))
    metrics = src.view("b_coverage").withColumn("research_release_id", release)
    known = metrics.groupBy(F.col("research_release_id").alias("release_id")).agg(
        F.min("period_start").alias("created_at"),
        F.sum("usable_count").alias("published_count"),
        F.lit(0).alias("quarantined_count"),
        F.lit(None).cast("string").alias("parent_release_id"),
    )
    return releases.compare_releases(known, metrics, "5-LOW").select(
        "release_id", "created_at", "published_count", "establishment_id", "recorded_count", "usable_count", "positive_count"
    )


@query(
    "j5_finalize_check",
    sql="""WITH rows AS (SELECT l_orderkey // 100 AS partition_id, l_orderkey * 10 + l_linenumber AS event_id FROM lineitem
      UNION ALL SELECT -1000000 - r_regionkey, -1 - r_regionkey FROM region),
    e AS (SELECT o_orderkey // 100 AS partition_id, min(o_orderkey) * 4 AS first_row, max(o_orderkey) * 4 + 4 - CASE WHEN (o_orderkey // 100) % 7 = 0 THEN 1 ELSE 0 END AS end_row
          FROM orders GROUP BY 1, (o_orderkey // 100) % 7
      UNION ALL SELECT -1 - s_suppkey, -10 * (s_suppkey + 1), -10 * s_suppkey FROM supplier),
    c AS (SELECT partition_id, count(*) AS n FROM rows GROUP BY 1),
    w AS (SELECT *, lag(end_row) OVER (ORDER BY first_row) AS pe FROM e)
    SELECT 'MISSING_PARTITION' AS finding, e.partition_id, NULL AS detail FROM e LEFT JOIN c USING (partition_id) WHERE n IS NULL
    UNION ALL SELECT 'COUNT_MISMATCH', e.partition_id, n::VARCHAR FROM e JOIN c USING (partition_id) WHERE n <> end_row - first_row
    UNION ALL SELECT 'UNEXPECTED_PARTITION', c.partition_id, n::VARCHAR FROM c WHERE partition_id NOT IN (SELECT partition_id FROM e)
    UNION ALL SELECT 'NOT_CONTIGUOUS', partition_id, pe::VARCHAR FROM w WHERE pe <> first_row
    UNION ALL SELECT 'DUPLICATE_EVENT_ID', min(partition_id), event_id::VARCHAR FROM rows GROUP BY event_id HAVING count(*) > 1""",
)
def j5_finalize_check(src: Source) -> DataFrame:
    part = F.floor(F.col("l_orderkey") / 100).cast("bigint")
    rows = src.table("lineitem").select(
        part.alias("partition_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id")
    )
    key = F.floor(F.col("o_orderkey") / 100).cast("bigint")
    expected = src.table("orders").groupBy(key.alias("partition_id")).agg(
        (F.min("o_orderkey") * 4).alias("first_row"), (F.max("o_orderkey") * 4 + 4).alias("end_row")
    )
    short = F.when(F.col("partition_id") % 7 == 0, 1).otherwise(0)
    expected = expected.withColumn("end_row", F.col("end_row") - short)
    # Suppliers stand for partitions that never came, regions for rows nobody expected.
    absent = src.table("supplier").select(
        (-1 - F.col("s_suppkey")).alias("partition_id"), (-10 * (F.col("s_suppkey") + 1)).alias("first_row"), (-10 * F.col("s_suppkey")).alias("end_row")
    )
    stray = src.table("region").select(
        (-1_000_000 - F.col("r_regionkey")).alias("partition_id"), (-1 - F.col("r_regionkey")).alias("event_id")
    )
    return releases.finalize_check(expected.unionByName(absent), rows.unionByName(stray))


@query(
    "j7_latest_release",
    sql=f"WITH {LEDGER_SQL} SELECT release_id, created_at, published_count FROM ledger ORDER BY created_at DESC, release_id DESC LIMIT 1",
)
def j7_latest_release(src: Source) -> DataFrame:
    return releases.latest_release(ledger(src)).select("release_id", "created_at", "published_count")


@query(
    "j8_release_ancestry",
    sql="""WITH RECURSIVE r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey > 0 THEN o_orderkey // 2 END AS parent FROM orders),
    up(id, parent, depth) AS (SELECT id, parent, 0 FROM r WHERE id = (SELECT max(o_orderkey) FROM orders)
      UNION ALL SELECT r.id, r.parent, up.depth + 1 FROM up JOIN r ON r.id = up.parent)
    SELECT 'r' || id AS release_id, depth FROM up""",
)
def j8_release_ancestry(src: Source) -> DataFrame:
    orders = src.table("orders")
    named = orders.select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("release_id"),
        F.when(F.col("o_orderkey") > 0, F.concat(F.lit("r"), F.floor(F.col("o_orderkey") / 2).cast("string"))).alias("parent_release_id"),
    )
    newest = orders.agg(F.max("o_orderkey")).first()[0]
    return releases.release_ancestry(named, f"r{newest}")


@query(
    "j8_release_chain",
    sql="""SELECT 'r' || c_custkey AS release_id, CAST(max(c_custkey) OVER () - c_custkey AS INTEGER) AS depth FROM customer""",
)
def j8_release_chain(src: Source) -> DataFrame:
    """One unbroken chain through all customers."""
    customers = src.table("customer")
    key = F.col("c_custkey").cast("string")
    named = customers.select(
        F.concat(F.lit("r"), key).alias("release_id"),
        F.concat(F.lit("r"), (F.col("c_custkey") - 1).cast("string")).alias("parent_release_id"),
    )
    newest = customers.agg(F.max("c_custkey")).first()[0]
    return releases.release_ancestry(named, f"r{newest}")


@query(
    "j9_release_diff",
    sql=f"""WITH o AS (SELECT DISTINCT omop_table, omop_fact_id FROM {FACT_SQL.format(flags="'A','N'")}),
    n AS (SELECT DISTINCT omop_table, omop_fact_id FROM {FACT_SQL.format(flags="'N','R'")})
    SELECT omop_table, omop_fact_id, CASE WHEN o.omop_fact_id IS NULL THEN 'ADDED' WHEN n.omop_fact_id IS NULL THEN 'REMOVED' ELSE 'KEPT' END AS change
    FROM (SELECT * FROM o UNION SELECT * FROM n) k LEFT JOIN o USING (omop_table, omop_fact_id) LEFT JOIN n USING (omop_table, omop_fact_id)""",
)
def j9_release_diff(src: Source) -> DataFrame:
    return releases.release_diff(line_facts(src, ["A", "N"]), line_facts(src, ["N", "R"])).drop("clinical_event_id")


@query(
    "j9_diff_shared_ids",
    sql=f"""WITH o AS (SELECT DISTINCT clinical_event_id, omop_table FROM {FACT_SQL.format(flags="'A','N'")}),
    n AS (SELECT DISTINCT clinical_event_id, omop_table FROM {FACT_SQL.format(flags="'N','R'")})
    SELECT clinical_event_id, omop_table, CASE WHEN o.x IS NULL THEN 'ADDED' WHEN n.x IS NULL THEN 'REMOVED' ELSE 'KEPT' END AS change
    FROM (SELECT * FROM o UNION SELECT * FROM n) k LEFT JOIN (SELECT *, 1 AS x FROM o) o USING (clinical_event_id, omop_table)
    LEFT JOIN (SELECT *, 1 AS x FROM n) n USING (clinical_event_id, omop_table)""",
)
def j9_diff_shared_ids(src: Source) -> DataFrame:
    """All lines of an order share one integer id here, and each change is seen."""
    shared = F.call_function("div", F.col("omop_fact_id"), F.lit(10))
    old, new = (line_facts(src, flags).withColumn("omop_fact_id", shared) for flags in (["A", "N"], ["N", "R"]))
    return releases.release_diff(old, new).drop("omop_fact_id")


def yearly_history(src: Source) -> membership.History:
    """A release for each year of shipping: it adds the year's lines and removes the returned lines of the year before."""
    lines = src.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min(F.year("l_shipdate")).alias("y"), F.min("l_returnflag").alias("flag")
    )
    member = [
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("clinical_event_id"),
        F.lit("observation").alias("omop_table"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("omop_fact_id"),
    ]
    name = lambda year: F.concat(F.lit("r"), year.cast("string"))
    added = lines.select(name(F.col("y")).alias("release_id"), *member, F.lit(membership.ADD).alias("change"))
    gone = lines.filter("flag = 'R'").select(name(F.col("y") + 1).alias("release_id"), *member, F.lit(membership.REMOVE).alias("change"))
    years = cut(lines.select("y").distinct(), "years")
    known = years.select(name(F.col("y")).alias("release_id"), name(F.col("y") - 1).alias("parent_release_id"))
    deltas = cut(added.unionByName(gone), "deltas")
    history = membership.History(known, deltas, deltas.drop("change").limit(0))
    # Snapshots of every third release, one after the other as they would have been published.
    newest = years.agg(F.max("y")).first()[0]
    for year in range(newest - 6, newest):
        if membership.snapshot_due(history, f"r{year}", 3):
            history = membership.with_snapshot(history, f"r{year}")
    return history


@query(
    "j1_versioned_members",
    sql="""WITH l AS (SELECT l_orderkey, l_linenumber, min(extract(year FROM l_shipdate)) AS y, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey || '-' || l_linenumber AS clinical_event_id, 'observation' AS omop_table, l_orderkey * 10 + l_linenumber AS omop_fact_id
    FROM l WHERE flag <> 'R' OR y = (SELECT max(y) FROM l)""",
)
def j1_versioned_members(src: Source) -> DataFrame:
    history = yearly_history(src)
    newest = history.releases.agg(F.max("release_id")).first()[0]
    return membership.members_of(history, newest)


CHILD_SQL = f"""first_pass AS (WITH {decided_sql()} SELECT * FROM decided),
    second_pass AS (WITH {decided_sql(entries_sql(REPLAY_ENTRIES))} SELECT * FROM decided),
    again AS (SELECT s.* FROM second_pass s JOIN first_pass f USING (event_id) WHERE f.decision = 'QUARANTINE'),
    was AS (SELECT DISTINCT clinical_event_id, target_domain FROM first_pass WHERE decision = 'PUBLISH' AND clinical_event_id IS NOT NULL),
    added AS (SELECT DISTINCT clinical_event_id, target_domain FROM again WHERE decision = 'PUBLISH' AND clinical_event_id IS NOT NULL
      AND (clinical_event_id, target_domain) NOT IN (SELECT clinical_event_id, target_domain FROM was))"""


def replayed(src: Source) -> tuple[membership.Child, DataFrame, DataFrame]:
    """The child of the first release of the event answers, that release's members and its metrics."""
    # Dealt, as the events may be a file of few pieces and are judged a second time.
    rows = event_canonical(src.dealt(src.view("b_answers")))
    first = stored_decisions(src)
    members = cut(omop.project_facts(first).select("clinical_event_id", "omop_table", F.lit(0).cast("bigint").alias("omop_fact_id")), "members")
    metrics = cut(catalog.coverage_from_facts(first, ["establishment_id", "item_path"]), "metrics")
    records = quality.quarantine_records(first, F.col("authored_at"))
    parent = first.agg(
        F.lit("r1").alias("release_id"), F.count_if(F.col("decision") == "PUBLISH").alias("published_count"),
        F.count_if(F.col("decision") == "QUARANTINE").alias("quarantined_count"),
    )
    child = membership.replay(parent, members, metrics, ["establishment_id", "item_path"], rows, records, event_entries(src, REPLAY_ENTRIES), F.lit("mapping_r2"))
    return child, members, metrics


@query(
    "h5_child_members",
    "b_answers",
    sql=f"""WITH {CHILD_SQL}, m AS (SELECT *, true AS inherited FROM was UNION ALL SELECT *, false FROM added)
    SELECT clinical_event_id, CASE target_domain WHEN 'CONDITION' THEN 'condition_occurrence' WHEN 'MEASUREMENT' THEN 'measurement'
      WHEN 'OBSERVATION' THEN 'observation' WHEN 'NOTE' THEN 'note' WHEN 'NOTE_NLP' THEN 'note_nlp' END AS omop_table, inherited FROM m""",
)
def h5_child_members(src: Source) -> DataFrame:
    child, members, _ = replayed(src)
    ids = child.release.select("release_id", "parent_release_id").first()
    both = src.spark.createDataFrame([(ids[0], ids[1]), (ids[1], None)], "release_id string, parent_release_id string")
    deltas = members.select(F.lit(ids[1]).alias("release_id"), "*", F.lit("ADD").alias("change")).unionByName(
        child.delta.select(F.lit(ids[0]).alias("release_id"), *members.columns, "change")
    )
    history = membership.History(both, deltas, deltas.drop("change").limit(0))
    now = membership.members_of(history, ids[0]).drop("omop_fact_id")
    return now.join(members.select("clinical_event_id", "omop_table").withColumn("inherited", F.lit(True)), ["clinical_event_id", "omop_table"], "left").select(
        "clinical_event_id", "omop_table", F.coalesce("inherited", F.lit(False)).alias("inherited")
    )


@query(
    "h5_child_release",
    "b_answers",
    sql=f"""WITH {CHILD_SQL}
    SELECT 'r1' AS parent_release_id, (SELECT count(*) FROM first_pass WHERE decision = 'PUBLISH') + (SELECT count(*) FROM added) AS published_count,
      (SELECT count(*) FROM again WHERE decision = 'QUARANTINE') AS quarantined_count""",
)
def h5_child_release(src: Source) -> DataFrame:
    return replayed(src)[0].release.select("parent_release_id", "published_count", "quarantined_count")


@query(
    "h5_child_metrics",
    "b_answers",
    sql=f"""WITH {CHILD_SQL}, site AS (SELECT establishment_id, count(*) AS n FROM again WHERE decision = 'PUBLISH' GROUP BY 1)
    SELECT f.establishment_id, item_path,
      count(*) FILTER (state NOT IN ('NOT_DISPLAYED_BY_FORM_LOGIC', 'VOIDED', 'SUPERSEDED', 'DELETED')) AS eligible_count,
      count(*) FILTER (state NOT IN ('NOT_DISPLAYED_BY_FORM_LOGIC', 'VOIDED', 'SUPERSEDED', 'DELETED', 'NOT_RECORDED', 'NOT_APPLICABLE')) + coalesce(any_value(n), 0) AS recorded_count,
      count(*) FILTER (decision = 'PUBLISH') AS usable_count
    FROM first_pass f LEFT JOIN site USING (establishment_id) GROUP BY ALL""",
)
def h5_child_metrics(src: Source) -> DataFrame:
    return replayed(src)[0].metrics.select("establishment_id", "item_path", "eligible_count", "recorded_count", "usable_count")
