"""Coverage, catalog and federation on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.operators import catalog, privacy
from formloom.plans.answers import decided_sql, event_decisions
from formloom.plans.registry import Source, query
from formloom.session import cut
from formloom.plans.sqltext import sql_bag, sql_ratio

KEY = ["concept_key", "establishment_id", "period_start"]


@query(
    "k1_coverage",
    "b_coverage",
    sql=f"""SELECT establishment_id, concept_key, period_start,
      {sql_ratio('recorded_count', 'eligible_count')} AS completion, {sql_ratio('usable_count', 'eligible_count')} AS usable_coverage,
      {sql_ratio('positive_count', 'usable_count')} AS prevalence, recorded_count AS observed_count,
      eligible_count IS NOT NULL AS denominator_known FROM b_coverage""",
)
def k1_coverage(src: Source) -> DataFrame:
    out = catalog.coverage(src.view("b_coverage"))
    return out.select(
        "establishment_id", "concept_key", "period_start",
        *[F.col(n).cast("double").alias(n) for n in ("completion", "usable_coverage", "prevalence")],
        "observed_count", "denominator_known",
    )


@query(
    "k2_validate_counts",
    "b_coverage",
    sql="""WITH s AS (SELECT concept_key, establishment_id, period_start, recorded_count - 1 AS recorded, usable_count AS usable,
        positive_count + 1 AS positive, eligible_count - 2 AS eligible FROM b_coverage)
    SELECT concept_key, establishment_id, period_start, 'USABLE_EXCEEDS_RECORDED' AS violation FROM s WHERE usable > recorded
    UNION ALL SELECT concept_key, establishment_id, period_start, 'POSITIVE_EXCEEDS_USABLE' FROM s WHERE positive > usable
    UNION ALL SELECT concept_key, establishment_id, period_start, 'RECORDED_EXCEEDS_ELIGIBLE' FROM s WHERE recorded > eligible
    UNION ALL SELECT concept_key, establishment_id, period_start, 'NEGATIVE_COUNT' FROM s
      WHERE least(coalesce(eligible, 0), recorded, usable, positive) < 0""",
)
def k2_validate_counts(src: Source) -> DataFrame:
    shifted = src.view("b_coverage").withColumns(
        {
            "recorded_count": F.col("recorded_count") - 1,
            "positive_count": F.col("positive_count") + 1,
            "eligible_count": F.col("eligible_count") - 2,
        }
    )
    return catalog.count_violations(shifted, KEY)


@query(
    "k3_roll_forward_coverage",
    "b_coverage",
    sql=f"""
    WITH k AS (SELECT DISTINCT establishment_id, concept_key FROM b_coverage),
    p AS (SELECT establishment_id, concept_key, sum(eligible_count) AS e, sum(recorded_count) AS r, sum(usable_count) AS u, sum(positive_count) AS q
          FROM b_coverage WHERE period_start < DATE '1998-01-01' GROUP BY 1, 2),
    d AS (SELECT establishment_id, concept_key, sum(eligible_count) AS e, sum(recorded_count) AS r, sum(usable_count) AS u, sum(positive_count) AS q
          FROM b_coverage WHERE period_start >= DATE '1998-01-01' GROUP BY 1, 2),
    s AS (SELECT establishment_id, concept_key, CAST(CASE WHEN p.r IS NULL THEN d.e ELSE p.e END AS BIGINT) AS eligible_count,
            CAST(coalesce(p.r, 0) + coalesce(d.r, 0) AS BIGINT) AS recorded_count, CAST(coalesce(p.u, 0) + coalesce(d.u, 0) AS BIGINT) AS usable_count,
            CAST(coalesce(p.q, 0) + coalesce(d.q, 0) AS BIGINT) AS positive_count
          FROM k LEFT JOIN p USING (establishment_id, concept_key) LEFT JOIN d USING (establishment_id, concept_key)
          WHERE p.r IS NOT NULL OR d.r IS NOT NULL)
    SELECT *, least({sql_ratio('recorded_count', 'eligible_count')}, CASE WHEN eligible_count <> 0 THEN 1.0 END) AS completion,
      least({sql_ratio('usable_count', 'eligible_count')}, CASE WHEN eligible_count <> 0 THEN 1.0 END) AS usable_coverage,
      {sql_ratio('positive_count', 'usable_count')} AS prevalence FROM s""",
)
def k3_roll_forward_coverage(src: Source) -> DataFrame:
    counts = src.view("b_coverage")
    key = ["establishment_id", "concept_key"]
    sums = [F.sum(c).alias(c) for c in ("eligible_count", *catalog.COUNTS)]
    parent = counts.filter("period_start < DATE '1998-01-01'").groupBy(*key).agg(*sums)
    delta = counts.filter("period_start >= DATE '1998-01-01'").groupBy(*key).agg(*sums)
    out = catalog.roll_forward(parent, delta, key)
    return out.withColumns({n: F.col(n).cast("double") for n in ("completion", "usable_coverage", "prevalence")})


@query(
    "k4_coverage_from_facts",
    "b_answers",
    sql=f"""WITH {decided_sql()} SELECT item_path AS concept_key, establishment_id, CAST(date_trunc('month', authored_at) AS DATE) AS period_start,
      count(*) FILTER (state NOT IN ('VOIDED','DELETED')) AS eligible_count,
      count(*) FILTER (state NOT IN ('VOIDED','DELETED','NOT_RECORDED','NOT_APPLICABLE')) AS recorded_count,
      count(*) FILTER (decision = 'PUBLISH') AS usable_count,
      count(*) FILTER (decision = 'PUBLISH' AND clinical_state = 'PRESENT') AS positive_count
    FROM decided GROUP BY 1, 2, 3""",
)
def k4_coverage_from_facts(src: Source) -> DataFrame:
    month = F.trunc(F.col("authored_at").cast("date"), "month").alias("period_start")
    return catalog.coverage_from_facts(
        event_decisions(src), [F.col("item_path").alias("concept_key"), "establishment_id", month]
    )


@query(
    "k6_search_concepts",
    sql="""SELECT p_partkey AS concept_id, p_name AS display_name FROM part WHERE p_name ILIKE '%RING%' ORDER BY 2, 1""",
)
def k6_search_concepts(src: Source) -> DataFrame:
    concepts = src.table("part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("display_name"))
    return catalog.search(concepts, "RING", "display_name", ["display_name", "concept_id"])


@query(
    "k7_coverage_by_concept",
    "b_coverage",
    sql=f"""WITH m AS (SELECT *, {sql_ratio('recorded_count', 'eligible_count')} AS completion, {sql_ratio('usable_count', 'eligible_count')} AS usable_coverage,
        {sql_ratio('positive_count', 'usable_count')} AS prevalence FROM b_coverage WHERE concept_key = '2-HIGH')
    SELECT establishment_id, period_start, eligible_count, recorded_count, usable_count, positive_count,
      CAST(floor(CAST(coalesce(completion, 0) AS DECIMAL(18,4)) * 100 + 0.5) AS BIGINT) AS completion_percent,
      CAST(floor(CAST(coalesce(usable_coverage, 0) AS DECIMAL(18,4)) * 100 + 0.5) AS BIGINT) AS usable_coverage_percent,
      CAST(floor(CAST(coalesce(prevalence, 0) AS DECIMAL(18,4)) * 100 + 0.5) AS BIGINT) AS prevalence_percent FROM m""",
)
def k7_coverage_by_concept(src: Source) -> DataFrame:
    out = catalog.coverage_by_concept(catalog.coverage(src.view("b_coverage")), "2-HIGH")
    return out.select(
        "establishment_id", "period_start", "eligible_count", *catalog.COUNTS,
        "completion_percent", "usable_coverage_percent", "prevalence_percent",
    )


@query(
    "k8_inventory",
    sql="""SELECT 'forms' AS kind, count(*) AS records FROM (SELECT DISTINCT p_brand, p_size % 3 FROM part)
    UNION ALL SELECT 'runs', count(*) FROM orders UNION ALL SELECT 'concepts', count(*) FROM part
    UNION ALL SELECT 'answers', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents""",
)
def k8_inventory(src: Source) -> DataFrame:
    part = src.table("part")
    return catalog.inventory(
        forms=part.select("p_brand", F.col("p_size") % 3).distinct(),
        runs=src.table("orders"),
        concepts=part,
        answers=src.table("events"),
        documents=src.table("documents"),
    )


@query(
    "k9_page",
    sql="""SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total, 'NzU' AS next_cursor
    FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50""",
)
def k9_page(src: Source) -> DataFrame:
    orders = src.table("orders").select("o_orderkey", "o_totalprice")
    return catalog.page(
        orders, [F.col("o_totalprice").desc(), "o_orderkey"], catalog.encode_cursor(50), 25
    )


@query(
    "k9_late_page",
    sql="""WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS i, count(*) OVER () AS total FROM orders)
    SELECT 'jump' AS page, o_orderkey, o_totalprice, total FROM o WHERE i >= total // 10 * 9 AND i < total // 10 * 9 + 25
    UNION ALL SELECT 'next', o_orderkey, o_totalprice, total FROM o WHERE i >= total // 10 * 9 + 25 AND i < total // 10 * 9 + 50""",
)
def k9_late_page(src: Source) -> DataFrame:
    """A page nine tenths down the table, and the one behind its last row."""
    pages = catalog.paged(src.table("orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", False), ("o_orderkey", True)])
    total = pages.index.agg(F.sum("rows")).first()[0]
    page = cut(catalog.page_at(pages, total // 10 * 9, 25), "page")
    last = page.orderBy(F.asc("o_totalprice"), F.desc("o_orderkey")).first()
    behind = catalog.page_after(pages, (last["o_totalprice"], last["o_orderkey"]), 25)
    return page.select(F.lit("jump").alias("page"), "*").unionByName(behind.select(F.lit("next").alias("page"), "*"))


# --- L -------------------------------------------------------------------------------------

SUPPRESSED_SQL = """sup AS (SELECT concept_key, establishment_id, period_start,
    recorded_count IN (0) OR recorded_count >= 10 AS a, usable_count = 0 OR usable_count >= 10 AS b, positive_count = 0 OR positive_count >= 10 AS c,
    eligible_count, recorded_count, usable_count, positive_count FROM cells),
    shown AS (SELECT concept_key, establishment_id, period_start, NOT (a AND b AND c) AS suppressed,
      CASE WHEN a AND b AND c THEN eligible_count END AS eligible_count, CASE WHEN a AND b AND c THEN recorded_count ELSE 0 END AS recorded_count,
      CASE WHEN a AND b AND c THEN usable_count ELSE 0 END AS usable_count, CASE WHEN a AND b AND c THEN positive_count ELSE 0 END AS positive_count FROM sup)"""
CELLS_SQL = """cells AS (SELECT concept_key, establishment_id, CAST(date_trunc('year', period_start) AS DATE) AS period_start,
    CAST(sum(eligible_count) AS BIGINT) AS eligible_count, CAST(sum(recorded_count) AS BIGINT) AS recorded_count, CAST(sum(usable_count) AS BIGINT) AS usable_count,
    CAST(sum(positive_count) AS BIGINT) AS positive_count FROM b_coverage GROUP BY 1, 2, 3)"""


def yearly_cells(src: Source) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("eligible_count", *catalog.COUNTS)]
    year = F.trunc("period_start", "year").alias("period_start")
    return src.view("b_coverage").groupBy("concept_key", "establishment_id", year).agg(*sums)


@query("l1_suppress_small_cells", "b_coverage", sql=f"WITH {CELLS_SQL}, {SUPPRESSED_SQL} SELECT * FROM shown")
def l1_suppress_small_cells(src: Source) -> DataFrame:
    return privacy.suppress_small_cells(yearly_cells(src)).select(
        *KEY, "suppressed", "eligible_count", *catalog.COUNTS
    )


BUNDLE_SQL = f"""{CELLS_SQL.replace('establishment_id,', 'establishment_id,')}, {SUPPRESSED_SQL},
    site AS (SELECT * FROM shown WHERE establishment_id = 'nation-NATION_3'),
    hashed AS (SELECT sha256('v' || concept_key || chr(31) || 'v' || period_start || chr(31) || coalesce('v' || eligible_count, 'n') || chr(31) || 'v' || recorded_count
      || chr(31) || 'v' || usable_count || chr(31) || 'v' || positive_count || chr(31) || 'v' || suppressed) AS h FROM site)"""


def site_bundle(src: Source) -> tuple[DataFrame, DataFrame]:
    metrics = yearly_cells(src).withColumn("research_release_id", F.lit("release_2"))
    releases = src.table("region").select(
        F.concat(F.lit("release_"), F.col("r_regionkey").cast("string")).alias("release_id"),
        F.lit("mapping_r1").alias("mapping_release_id"),
        F.when(F.col("r_regionkey") == 2, F.lit("2024-03-01")).otherwise(F.lit("2024-01-01")).cast("timestamp").alias("created_at"),
    )
    return privacy.build_site_bundle(releases, metrics, "nation-NATION_3", 10)


@query(
    "l2_build_site_bundle",
    "b_coverage",
    sql=f"""WITH {BUNDLE_SQL} SELECT 'nation-NATION_3' AS establishment_id, 'release_2' AS research_release_id, 'mapping_r1' AS mapping_release_id,
      10 AS minimum_cell_threshold, (SELECT count(*) FROM site) AS metric_count,
      sha256('{{"establishment_id":"nation-NATION_3","mapping_release_id":"mapping_r1","metrics":"' || (SELECT {sql_bag('h')} FROM hashed) ||
       '","minimum_cell_threshold":10,"research_release_id":"release_2","schema_version":"1.0"}}') AS payload_checksum""",
)
def l2_build_site_bundle(src: Source) -> DataFrame:
    header, _ = site_bundle(src)
    return header.select(
        "establishment_id", "research_release_id", "mapping_release_id", "minimum_cell_threshold",
        "metric_count", "payload_checksum",
    )


@query(
    "l2_site_bundle_metrics",
    "b_coverage",
    sql=f"WITH {BUNDLE_SQL} SELECT concept_key, period_start, eligible_count, recorded_count, usable_count, positive_count, suppressed FROM site",
)
def l2_site_bundle_metrics(src: Source) -> DataFrame:
    _, metrics = site_bundle(src)
    return metrics.select("concept_key", "period_start", "eligible_count", *catalog.COUNTS, "suppressed")


@query(
    "l3_import_site_bundles",
    "b_coverage",
    sql=f"""WITH {CELLS_SQL}, {SUPPRESSED_SQL} SELECT establishment_id, concept_key, period_start, recorded_count, suppressed FROM shown
      WHERE establishment_id IN ('nation-NATION_3', 'nation-NATION_4')""",
)
def l3_import_site_bundles(src: Source) -> DataFrame:
    metrics = yearly_cells(src).withColumn("research_release_id", F.lit("release_2"))
    releases = src.table("region").agg(
        F.lit("release_2").alias("release_id"), F.lit("mapping_r1").alias("mapping_release_id"), F.lit("2024-03-01").cast("timestamp").alias("created_at")
    )
    headers, bodies = None, None
    for site, spoiled in (("nation-NATION_3", False), ("nation-NATION_4", False), ("nation-NATION_6", True)):
        header, body = privacy.build_site_bundle(releases, metrics, site, 10)
        body = body.withColumn("recorded_count", F.col("recorded_count") + 1) if spoiled else body
        headers = header if headers is None else headers.unionByName(header)
        bodies = body if bodies is None else bodies.unionByName(body)
    return privacy.import_site_bundles(headers, bodies).select(
        "establishment_id", "concept_key", "period_start", "recorded_count", "suppressed"
    )


@query(
    "l4_redact",
    "b_answers",
    sql="""SELECT response_id, '[REDACTED]' AS patient_id, item_path, '[REDACTED]' AS session_token, authored_at::DATE AS day,
      '[REDACTED]' AS inner_secret, item_path AS inner_kind, establishment_id AS list_site, '[REDACTED]' AS list_answer FROM b_answers""",
)
def l4_redact(src: Source) -> DataFrame:
    rows = src.view("b_answers").select(
        "response_id", "patient_id", "item_path",
        F.col("raw_value").alias("session_token"),
        F.col("authored_at").cast("date").alias("day"),
        F.struct(F.col("unit").alias("secret_unit"), F.col("item_path").alias("kind")).alias("context"),
        F.array(F.struct(F.col("establishment_id").alias("site"), F.col("raw_value").alias("Answer_text"))).alias("log"),
    )
    out = privacy.redact(rows)
    return out.select(
        "response_id", "patient_id", "item_path", "session_token", "day",
        F.col("context.secret_unit").alias("inner_secret"),
        F.col("context.kind").alias("inner_kind"),
        F.col("log")[0]["site"].alias("list_site"),
        F.col("log")[0]["Answer_text"].alias("list_answer"),
    )


@query(
    "l5_patient_column_guard",
    "b_coverage",
    sql=f"WITH {CELLS_SQL} SELECT establishment_id, CAST(sum(recorded_count) AS BIGINT) AS recorded_count FROM cells GROUP BY 1",
)
def l5_patient_column_guard(src: Source) -> DataFrame:
    return privacy.guard_aggregate(
        yearly_cells(src).groupBy("establishment_id").agg(F.sum("recorded_count").alias("recorded_count"))
    )
