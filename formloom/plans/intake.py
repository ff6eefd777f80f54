"""Intake triage and ledger reports on the driver tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.operators import intake, ledger
from formloom.plans.registry import Source, query

# Payloads: events as JSON (every third cut short, every third behind a PDF signature), pages as
# XML (every second left open), documents as plain text.
PAYLOAD_SQL = """p AS (
    SELECT 'e' || event_id AS id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN substr(props, 1, length(props) - 1) ELSE '%PDF-' || props END AS body,
      CASE event_id % 3 WHEN 0 THEN 'application/json' WHEN 2 THEN 'application/pdf' END AS kind, CASE event_id % 3 WHEN 1 THEN 'MALFORMED_JSON' END AS error FROM events
    UNION ALL SELECT 'p' || page_id, '<page><n>' || length(html) || '</n>' || CASE WHEN page_id % 2 = 0 THEN '</page>' ELSE '' END,
      CASE WHEN page_id % 2 = 0 THEN 'application/xml' END, CASE WHEN page_id % 2 = 1 THEN 'MALFORMED_XML' END FROM pages
    UNION ALL SELECT 'd' || doc_id, text, CASE WHEN csv THEN 'text/csv' END, CASE WHEN NOT csv THEN 'UNKNOWN_FILE_SIGNATURE' END FROM
      (SELECT doc_id, 'doc ' || text AS text, contains(text, chr(10)) AND regexp_matches(string_split('doc ' || text, chr(10))[1], '[,;\\t]') AS csv FROM documents))"""


def payloads(src: Source) -> DataFrame:
    kind = F.col("event_id") % 3
    body = (
        F.when(kind == 0, F.col("props"))
        .when(kind == 1, F.substr("props", F.lit(1), F.length("props") - 1))
        .otherwise(F.concat(F.lit("%PDF-"), "props"))
    )
    events = src.table("events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), body.alias("body"))
    end = F.when(F.col("page_id") % 2 == 0, "</page>").otherwise("")
    size = F.length("html").cast("string")
    pages = src.table("pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.concat(F.lit("<page><n>"), size, F.lit("</n>"), end).alias("body")
    )
    docs = src.table("documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("doc "), "text").alias("body")
    )
    every = events.unionByName(pages).unionByName(docs)
    return every.withColumn("content", F.encode("body", "UTF-8"))


@query("o1_sniff_media_type", sql=f"WITH {PAYLOAD_SQL} SELECT id, kind AS media_type, error FROM p")
def o1_sniff_media_type(src: Source) -> DataFrame:
    sniffed = payloads(src).withColumn("s", intake.sniff_media_type(F.col("content")))
    return sniffed.select("id", "s.media_type", "s.error")


@query("o1_sniff_pages", sql=None)
def o1_sniff_pages(src: Source) -> DataFrame:
    """Raw web pages: few are well-formed XML, which DuckDB cannot tell."""
    sniffed = src.table("pages").select("page_id", intake.sniff_media_type(F.encode("html", "UTF-8")).alias("s"))
    return sniffed.select("page_id", "s.media_type", "s.error")


@query(
    "o2_normalize_filename",
    sql="""WITH b AS (SELECT page_id, list_extract(string_split(regexp_replace(replace(url, chr(92), '/'), '(?:/\\.?)+$', ''), '/'), -1) AS base FROM pages)
    SELECT page_id, nullif(substr(trim(regexp_replace(base, '[^A-Za-z0-9._-]+', '-', 'g'), '.-'), 1, 180), '') AS safe_name FROM b""",
)
def o2_normalize_filename(src: Source) -> DataFrame:
    return src.table("pages").select("page_id", intake.normalize_filename(F.col("url")).alias("safe_name"))


@query(
    "o3_triage_uploads",
    sql=f"""WITH {PAYLOAD_SQL}, u AS (SELECT *, CASE length(body) % 5 WHEN 0 THEN 'application/fhir+json' WHEN 1 THEN 'text/xml' WHEN 2 THEN 'application/pdf'
        WHEN 3 THEN 'text/csv' ELSE 'image/gif' END AS declared FROM p)
    SELECT id, kind AS detected, CASE WHEN declared = 'image/gif' THEN 'UNSUPPORTED_MEDIA_TYPE' WHEN strlen(body) > 2000 THEN 'UPLOAD_TOO_LARGE'
      WHEN error IS NOT NULL THEN error WHEN NOT (kind = declared OR (kind = 'application/json' AND declared = 'application/fhir+json')
        OR (kind = 'application/xml' AND declared = 'text/xml')) THEN 'MEDIA_TYPE_MISMATCH' END AS reason FROM u""",
)
def o3_triage_uploads(src: Source) -> DataFrame:
    kind = F.length("body") % 5
    declared = (
        F.when(kind == 0, "application/fhir+json").when(kind == 1, "text/xml").when(kind == 2, "application/pdf")
        .when(kind == 3, "text/csv").otherwise("image/gif")
    )
    uploads = payloads(src).withColumns({"media_type": declared, "filename": F.concat("id", F.lit(".dat"))})
    return intake.triage_uploads(uploads, 2000).select("id", "detected", "reason")


def _zip(doc_id: int, text: str, lang: str) -> bytes:
    """One document as an archive of a few files, some of which break a rule."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(f"{lang}/text.txt", text)
        link = zipfile.ZipInfo("link")
        link.external_attr = (0o120777 << 16) if doc_id % 5 == 0 else (0o100644 << 16)
        archive.writestr(link, "target")
        archive.writestr({0: "../up.txt", 1: "inner/data.ZIP", 2: "/abs.txt"}.get(doc_id % 7, "notes.txt"), lang)
    content = buffer.getvalue()
    return content[: len(content) // 2] if doc_id % 11 == 0 else content


def document_archives(src: Source) -> DataFrame:
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            packed = [_zip(*row) for row in zip(b.doc_id, b.text, b.lang)]
            yield pd.DataFrame({"archive_id": b.doc_id.astype(str), "content": packed})

    docs = src.table("documents").select("doc_id", "text", "lang")
    return docs.mapInPandas(pack, "archive_id string, content binary")


@query(
    "o4_inspect_archives",
    sql="""WITH d AS (SELECT doc_id, lang, strlen(text) AS n FROM documents WHERE doc_id % 11 <> 0),
    m AS (SELECT doc_id, 0 AS pos, lang || '/text.txt' AS name, n AS size FROM d UNION ALL SELECT doc_id, 1, 'link', 6 FROM d
      UNION ALL SELECT doc_id, 2, CASE doc_id % 7 WHEN 0 THEN '../up.txt' WHEN 1 THEN 'inner/data.ZIP' WHEN 2 THEN '/abs.txt' ELSE 'notes.txt' END, 2 FROM d)
    SELECT CAST(doc_id AS VARCHAR) AS archive_id, name, size AS file_size, CASE WHEN pos = 1 AND doc_id % 5 = 0 THEN 'ARCHIVE_LINK'
      WHEN pos = 2 AND doc_id % 7 IN (0, 2) THEN 'UNSAFE_ARCHIVE_PATH' WHEN pos = 2 AND doc_id % 7 = 1 THEN 'NESTED_ARCHIVE'
      WHEN size > 3000 THEN 'ARCHIVE_ENTRY_TOO_LARGE' END AS violation FROM m
    UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, NULL, 'INVALID_ARCHIVE' FROM documents WHERE doc_id % 11 = 0""",
)
def o4_inspect_archives(src: Source) -> DataFrame:
    members = intake.list_archives(document_archives(src), entry_limit=3000)
    return intake.inspect_archives(members, maximum_entry_bytes=3000, maximum_ratio=1_000_000).select(
        "archive_id", "name", "file_size", "violation"
    )


# --- P -------------------------------------------------------------------------------------


def jobs(src: Source) -> DataFrame:
    """Orders as submitted jobs; the customer is the idempotency key."""
    orders = src.table("orders")
    return orders.select(
        F.col("o_orderkey").alias("job_id"),
        F.concat(F.lit("key-"), (F.col("o_custkey") * 8 + F.col("o_orderkey") % 8).cast("string")).alias("idempotency_key"),
        F.when(F.col("o_orderstatus") == "F", "pipeline.replay").otherwise("pipeline.run").alias("job_type"),
        F.col("o_orderpriority").alias("payload"),
        F.when(F.col("o_orderstatus") == "O", "QUEUED").when(F.col("o_orderstatus") == "P", "FAILED").otherwise("SUCCEEDED").alias("status"),
        (F.col("o_orderkey") % 5).cast("int").alias("attempts"),
        F.lit(3).alias("maximum_attempts"),
        F.col("o_orderdate").alias("created_at"),
    )


JOBS_SQL = """j AS (SELECT o_orderkey AS job_id, 'key-' || (o_custkey * 8 + o_orderkey % 8) AS idempotency_key, CASE WHEN o_orderstatus = 'F' THEN 'pipeline.replay' ELSE 'pipeline.run' END AS job_type,
    o_orderpriority AS payload, CASE o_orderstatus WHEN 'O' THEN 'QUEUED' WHEN 'P' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, o_orderkey % 5 AS attempts, o_orderdate AS created_at FROM orders)"""


@query(
    "p1_idempotency_conflicts",
    sql=f"WITH {JOBS_SQL} SELECT idempotency_key, count(DISTINCT (job_type, payload)) AS requests, count(*) AS submissions FROM j GROUP BY 1 HAVING requests > 1",
)
def p1_idempotency_conflicts(src: Source) -> DataFrame:
    return ledger.idempotency_conflicts(jobs(src))


@query(
    "p1_distinct_jobs",
    sql=f"WITH {JOBS_SQL} SELECT idempotency_key, arg_min(job_id, (created_at, job_id)) AS job_id, arg_min(status, (created_at, job_id)) AS status FROM j GROUP BY 1",
)
def p1_distinct_jobs(src: Source) -> DataFrame:
    return ledger.distinct_jobs(jobs(src)).select("idempotency_key", "job_id", "status")


@query(
    "p2_run_ledger",
    sql=f"WITH {JOBS_SQL} SELECT job_id, status, attempts, attempts >= 3 AS exhausted FROM j ORDER BY created_at DESC, job_id",
)
def p2_run_ledger(src: Source) -> DataFrame:
    return ledger.run_ledger(jobs(src)).select("job_id", "status", "attempts", "exhausted")


@query(
    "p2_run_totals",
    sql=f"""WITH {JOBS_SQL} SELECT job_type, count(*) AS runs, count(*) FILTER (status = 'SUCCEEDED') AS succeeded, count(*) FILTER (status = 'FAILED') AS failed,
      count(*) FILTER (status IN ('QUEUED', 'RUNNING')) AS open, CAST(sum(attempts) AS BIGINT) AS attempts, 3 * count(*) AS attempt_budget FROM j GROUP BY 1""",
)
def p2_run_totals(src: Source) -> DataFrame:
    return ledger.run_totals(jobs(src))


@query(
    "p3_audit_search",
    sql="""SELECT event_id, event_type AS action, ts AS occurred_at FROM events WHERE event_type = 'purchase'
      AND json_extract_string(props, '$.k') = '42' ORDER BY ts DESC, event_id""",
)
def p3_audit_search(src: Source) -> DataFrame:
    log = src.table("events").select(
        "event_id", F.col("event_type").alias("action"), F.col("ts").alias("occurred_at"), F.col("props").alias("metadata_json")
    )
    return ledger.audit_search(log, "purchase", {"k": "42"}).select("event_id", "action", "occurred_at")


@query(
    "p4_sources_by_site",
    sql="""SELECT 'nation-' || n_name AS establishment_id, s_name AS source_key FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey 
      ORDER BY 1, 2""",
)
def p4_sources_by_site(src: Source) -> DataFrame:
    sites = src.table("nation").select("n_nationkey", F.concat(F.lit("nation-"), "n_name").alias("establishment_id"))
    systems = src.table("supplier").join(sites, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "establishment_id", F.col("s_name").alias("source_key")
    )
    return ledger.sources_by_site(sites.select("establishment_id"), systems)
