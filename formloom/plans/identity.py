"""Identities, pseudonyms and checksums on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.functions.identity import (
    content_hash,
    deterministic_uuid,
    hmac_pads,
    integer_fact_id,
    pseudonymize,
)
from formloom.operators import checksums, merkle
from formloom.plans.registry import Source, query
from formloom.plans.sqltext import sql_bag, sql_fact_id, sql_uuid
from formloom.session import broadcast_if_small, cut, local_table

# Keys of the four demonstration sites; a deployment reads them from its own key table.
SITE_KEYS = {f"site-{s}": (f"demonstration-key-of-site-{s}-" + "0123456789" * n).encode() for s, n in zip("abcd", (1, 2, 4, 6))}


@query(
    "c1_content_hash",
    sql="""SELECT c_custkey, sha256('{"key":' || c_custkey || ',"name":' || CASE WHEN c_acctbal < 0 THEN 'null'
        ELSE '"' || c_name || '"' END || ',"segment":"' || c_mktsegment || '"}') AS content_hash FROM customer""",
)
def c1_content_hash(src: Source) -> DataFrame:
    name = F.when(F.col("c_acctbal") >= 0, F.col("c_name"))
    return src.table("customer").select(
        "c_custkey",
        content_hash(segment="c_mktsegment", name=name, key="c_custkey").alias("content_hash"),
    )


@query(
    "c2_deterministic_uuid",
    sql=f"SELECT l_orderkey, l_linenumber, {sql_uuid('line', 'l_orderkey', 'l_linenumber', 'l_returnflag')} AS id FROM lineitem",
)
def c2_deterministic_uuid(src: Source) -> DataFrame:
    identifier = deterministic_uuid("line", "l_orderkey", "l_linenumber", "l_returnflag")
    return src.table("lineitem").select("l_orderkey", "l_linenumber", identifier.alias("id"))


def _keys_sql() -> str:
    rows = ",".join(f"('{site}','{hmac_pads(key)[0]}','{hmac_pads(key)[1]}')" for site, key in SITE_KEYS.items())
    return f"k(site, inner_pad, outer_pad) AS (VALUES {rows})"


@query(
    "c3_pseudonymize",
    sql=f"""WITH {_keys_sql()}
    SELECT event_id, CASE WHEN user_id % 10 <> 9 THEN 'p_' || substr(sha256(unhex(outer_pad) || unhex(sha256(unhex(inner_pad) ||
      encode(site) || unhex('00') || encode('user ' || user_id)))), 1, 32) END AS pseudonym
    FROM events JOIN k ON site = 'site-' || substr('abcd', CAST(user_id % 4 AS INT) + 1, 1)""",
)
def c3_pseudonymize(src: Source) -> DataFrame:
    pads = [(site, *hmac_pads(key)) for site, key in SITE_KEYS.items()]
    keys = local_table(src.spark, pads, "site string, inner_pad string, outer_pad string")
    site = F.concat(F.lit("site-"), F.substr(F.lit("abcd"), (F.col("user_id") % 4 + 1).cast("int"), F.lit(1)))
    blank = F.lit(" \t ")
    name = F.when(F.col("user_id") % 10 == 9, blank).otherwise(
        F.concat(F.lit("  user "), F.col("user_id").cast("string"), F.lit(" \n"))
    )
    events = src.table("events").select("event_id", site.alias("site"), name.alias("name"))
    return events.join(broadcast_if_small(keys), "site").select(
        "event_id", pseudonymize("name", "site", "inner_pad", "outer_pad").alias("pseudonym")
    )


@query(
    "c4_integer_fact_id",
    sql=f"SELECT event_id, {sql_fact_id(sql_uuid('fact', 'event_id'))} AS fact_id FROM events",
)
def c4_integer_fact_id(src: Source) -> DataFrame:
    return src.table("events").select(
        "event_id", integer_fact_id(deterministic_uuid("fact", "event_id")).alias("fact_id")
    )


@query(
    "c5_dataset_checksum",
    sql="""
    WITH m AS (SELECT 'object/' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS name, sha256(props) AS digest FROM events),
    r AS (SELECT name, digest, row_number() OVER (ORDER BY name) - 1 AS i FROM m),
    l1 AS (SELECT i // 1024 AS i, sha256(unhex(string_agg(hex(encode(name)) || '00' || digest, '' ORDER BY name))) AS h
           FROM r GROUP BY 1),
    l2 AS (SELECT i // 1024 AS i, sha256(unhex(string_agg(h, '' ORDER BY i))) AS h FROM l1 GROUP BY 1)
    SELECT h AS checksum, (SELECT count(*) FROM m) AS members FROM l2""",
)
def c5_dataset_checksum(src: Source) -> DataFrame:
    padded = F.lpad(F.col("event_id").cast("string"), 12, "0")
    members = src.table("events").select(
        F.concat(F.lit("object/"), padded).alias("name"), F.sha2("props", 256).alias("digest")
    )
    return checksums.dataset_checksum(members, "name", "digest")


_LEAF_SQL = f"""SELECT substr(sha256(name), 1, 4) AS prefix, {sql_bag("sha256(name || chr(0) || digest)")} AS digest, count(*) AS members"""


def _tree_sql(members: str, label: str) -> str:
    """Levels of the tree over a table of members, as common table expressions t4 to t0 with a label."""
    parts = [f"{label}4 AS ({_LEAF_SQL} FROM {members} GROUP BY 1)"]
    for d in (3, 2, 1, 0):
        parts.append(f"""{label}{d} AS (SELECT substr(prefix, 1, {d}) AS prefix, sha256(string_agg(prefix || '=' || digest, ';' ORDER BY prefix)) AS digest,
            CAST(sum(members) AS BIGINT) AS members FROM {label}{d + 1} GROUP BY 1)""")
    return ", ".join(parts)


EVENT_MEMBERS = "SELECT 'object/' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS name, sha256(props) AS digest FROM events"


def event_members(src: Source) -> DataFrame:
    padded = F.lpad(F.col("event_id").cast("string"), 12, "0")
    return src.table("events").select(F.concat(F.lit("object/"), padded).alias("name"), F.sha2("props", 256).alias("digest"))


def changed_members(src: Source) -> DataFrame:
    """The same members after some were taken away and some written again."""
    number = F.substring("name", 8, 12).cast("bigint")
    again = F.when(number % 997 == 0, F.sha2(F.lit("written again"), 256)).otherwise(F.col("digest"))
    return event_members(src).filter(number % 1009 != 5).withColumn("digest", again)


@query(
    "c5_tree_checksum",
    sql=f"WITH m AS ({EVENT_MEMBERS}), {_tree_sql('m', 't')} SELECT digest AS checksum, members FROM t0",
)
def c5_tree_checksum(src: Source) -> DataFrame:
    return merkle.root(merkle.build(event_members(src), "name", "digest"))


@query(
    "c5_tree_refresh",
    sql=f"""WITH m0 AS ({EVENT_MEMBERS}), m AS (SELECT name, CASE WHEN CAST(substr(name, 8, 12) AS BIGINT) % 997 = 0 THEN sha256('written again') ELSE digest END AS digest
      FROM m0 WHERE CAST(substr(name, 8, 12) AS BIGINT) % 1009 <> 5), {_tree_sql('m', 't')}
    SELECT 0 AS depth, prefix, digest, members FROM t0 UNION ALL SELECT 1, prefix, digest, members FROM t1 UNION ALL SELECT 2, prefix, digest, members FROM t2
    UNION ALL SELECT 3, prefix, digest, members FROM t3 UNION ALL SELECT 4, prefix, digest, members FROM t4""",
)
def c5_tree_refresh(src: Source) -> DataFrame:
    """The tree brought up to date from the names that changed equals the one built anew."""
    number = F.substring("name", 8, 12).cast("bigint")
    touched = event_members(src).filter((number % 997 == 0) | (number % 1009 == 5)).select("name")
    tree = merkle.build(event_members(src), "name", "digest")
    return merkle.refresh(tree, changed_members(src), touched, "name", "digest")


@query(
    "j6_differing_members",
    sql=f"""WITH m AS ({EVENT_MEMBERS}) SELECT name, digest AS first_digest, CASE WHEN CAST(substr(name, 8, 12) AS BIGINT) % 1009 <> 5 THEN sha256('written again') END AS second_digest
      FROM m WHERE CAST(substr(name, 8, 12) AS BIGINT) % 1009 = 5 OR (CAST(substr(name, 8, 12) AS BIGINT) % 997 = 0 AND digest <> sha256('written again'))""",
)
def j6_differing_members(src: Source) -> DataFrame:
    """What differs between two runs, found by going down both trees."""
    first, second = event_members(src), changed_members(src)
    leaves = merkle.differences(merkle.build(first, "name", "digest"), merkle.build(second, "name", "digest"))
    return merkle.differing_members(leaves, first, second, "name", "digest")


ROW_SQL = "sha256('v' || o_orderkey || chr(31) || 'v' || o_custkey || chr(31) || 'v' || o_orderstatus)"
LINE_SQL = "sha256('v' || l_orderkey || chr(31) || 'v' || l_partkey || chr(31) || CASE WHEN l_returnflag = 'R' THEN 'n' ELSE 'v' || l_returnflag END)"
STAGES_SQL = f"""stages AS (
      SELECT 'canonical' AS stage, count(*) AS rows, {sql_bag('h')} AS checksum FROM (SELECT {LINE_SQL} AS h FROM lineitem)
      UNION ALL SELECT 'omop', count(*), {sql_bag('h')} FROM (SELECT {ROW_SQL} AS h FROM orders))"""


def stages(src: Source) -> DataFrame:
    lines = src.table("lineitem").withColumn("flag", F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")))
    return checksums.stage_checksums(
        {
            "canonical": (lines, ["l_orderkey", "l_partkey", "flag"]),
            "omop": (src.table("orders"), ["o_orderkey", "o_custkey", "o_orderstatus"]),
        }
    )


@query(
    "c6_stage_checksum",
    sql=f"""WITH {STAGES_SQL} SELECT stage, rows, checksum FROM stages UNION ALL
    SELECT 'combined', NULL, sha256(string_agg(stage || '=' || checksum, ';' ORDER BY stage)) FROM stages""",
)
def c6_stage_checksum(src: Source) -> DataFrame:
    each = cut(stages(src), "stage-checksums")  # hashed once, read twice
    total = checksums.combined_checksum(each).select(
        F.lit("combined").alias("stage"), F.lit(None).cast("bigint").alias("rows"), F.col("combined").alias("checksum")
    )
    return each.unionByName(total)


@query(
    "j6_determinism_check",
    sql=f"""WITH {STAGES_SQL} SELECT stage, checksum AS first_checksum, CASE WHEN stage = 'omop' THEN checksum
        END AS second_checksum, stage = 'omop' AS equal FROM stages""",
)
def j6_determinism_check(src: Source) -> DataFrame:
    # The second run sees the orders in another order and partitioning, and no canonical stage.
    again = checksums.stage_checksums(
        {"omop": (src.table("orders").repartition(7, "o_custkey"), ["o_orderkey", "o_custkey", "o_orderstatus"])}
    )
    return checksums.compare_runs(stages(src), again)
