"""Documents on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.operators import documents
from formloom.plans.registry import Source, query

MEDIA_SQL = """CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'text/html' WHEN 3 THEN 'application/pdf' ELSE 'image/jpeg' END"""
# Pages of a document are its lines.
PAGES_SQL = """pages AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents)"""


def line_pages(src: Source) -> DataFrame:
    lines = src.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return lines.select("doc_id", (F.col("i") + 1).alias("page"), "text")


@query(
    "n1_route_documents",
    sql=f"""WITH {PAGES_SQL}, c AS (SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS n FROM pages GROUP BY doc_id)
    SELECT d.doc_id, {MEDIA_SQL.replace('doc_id', 'd.doc_id')} AS media_type, n AS native_characters,
      CASE WHEN n_chars % 11 = 0 THEN 'EMPTY_DOCUMENT' WHEN d.doc_id % 5 = 2 THEN 'UNSUPPORTED_DOCUMENT_MEDIA_TYPE'
           WHEN d.doc_id % 5 IN (0, 3) AND coalesce(n, 0) >= 40 THEN 'NATIVE_TEXT' WHEN lang <> 'fr' THEN 'ABSTAIN' ELSE 'OCR_RULES' END AS route
    FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id""",
)
def n1_route_documents(src: Source) -> DataFrame:
    kind = F.col("doc_id") % 5
    media = (
        F.when(kind.isin(0, 3), "application/pdf").when(kind == 1, "image/png").when(kind == 2, "text/html").otherwise("image/jpeg")
    )
    docs = src.table("documents").select(
        "doc_id",
        media.alias("media_type"),
        F.when(F.col("n_chars") % 11 == 0, 0).otherwise(F.col("n_chars")).alias("size"),
        (F.col("lang") == "fr").alias("relevant"),
    )
    return documents.route_documents(docs, line_pages(src)).select("doc_id", "media_type", "native_characters", "route")


@query(
    "n2_dedupe_documents",
    sql="""SELECT doc_id, sha256(text) AS checksum, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id,
      doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS deduplicated FROM documents""",
)
def n2_dedupe_documents(src: Source) -> DataFrame:
    docs = src.table("documents").select("doc_id", F.sha2("text", 256).alias("checksum"))
    return documents.dedupe_documents(docs).select("doc_id", "checksum", "first_id", "deduplicated")


@query(
    "n3_span_evidence",
    sql=f"""WITH {PAGES_SQL},
    native AS (SELECT doc_id, page, CAST(NULL AS BIGINT) AS span_index, sha256(text) AS text_hash, length(text) AS text_span_end,
      'pdf:page:' || page AS source_locator, CAST(NULL AS DOUBLE) AS confidence, NULL AS box FROM pages WHERE length(text) > 0),
    w AS (SELECT doc_id, page, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) - 1 AS i FROM pages)
    SELECT * FROM native UNION ALL SELECT doc_id, page, i, sha256(s), NULL, 'ocr:page:' || page || ':span:' || i, (50 + length(s) % 50) / 100.0, i || ',' || length(s) FROM w""",
)
def n3_span_evidence(src: Source) -> DataFrame:
    pages = line_pages(src)
    spans = F.transform(
        F.split("text", r"\. "),
        lambda s, i: F.struct(
            s.alias("text"),
            ((F.length(s) % 50 + 50) / 100.0).cast("double").alias("confidence"),
            F.array(i.cast("double"), F.lit(0.0), F.length(s).cast("double"), F.lit(1.0)).alias("bounding_box"),
        ),
    )
    rows = documents.native_spans(pages).unionByName(
        documents.ocr_spans(pages.select("doc_id", "page", spans.alias("spans")))
    )
    box = F.concat_ws(",", F.col("bounding_box")[0].cast("int").cast("string"), F.col("bounding_box")[2].cast("int").cast("string"))
    return rows.select(
        "doc_id", "page", F.col("span_index").cast("bigint").alias("span_index"), F.sha2("text", 256).alias("text_hash"),
        "text_span_end", "source_locator", "confidence", F.when(F.col("bounding_box").isNotNull(), box).alias("box"),
    )


def _assertion_sql() -> str:
    before, after = "(?:^|[^\\p{L}\\p{N}_])", "(?:$|[^\\p{L}\\p{N}_])"
    return f"""t AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS norm FROM b_narrative),
    k AS (SELECT *, CASE WHEN NOT regexp_matches(norm, '{before}(?:allerg(?:ie|ies|ique)|hypersensibilit[éeÉ]){after}', 'i') THEN 'NONE'
        WHEN regexp_matches(norm, '{before}(?:possible|suspect(?:e|ée)?|à\\s+confirmer|incertain(?:e)?){after}', 'i') THEN 'UNCERTAIN'
        WHEN regexp_matches(norm, '{before}(?:aucune?|sans|absence\\s+d[''’]?|pas\\s+d[''’]?)\\s+(?:allergie|allergies){after}', 'i') THEN 'NEGATED'
        ELSE 'ASSERTED' END AS kind, lower(norm) AS low FROM t),
    cand AS (SELECT doc_id, lang, source, CASE kind WHEN 'NEGATED' THEN 'EXPLICITLY_ABSENT' WHEN 'ASSERTED' THEN 'PRESENT' ELSE 'UNKNOWN' END AS assertion,
      CASE WHEN kind <> 'NONE' THEN CASE WHEN contains(low, 'penicilline') OR contains(low, 'pénicilline') THEN 'Penicillin'
        WHEN contains(low, 'amoxicilline') THEN 'Amoxicillin' WHEN contains(low, 'latex') THEN 'Latex' END END AS substance,
      CASE WHEN kind <> 'NONE' THEN CASE WHEN contains(low, 'urticaire') THEN 'Urticaria' WHEN contains(low, 'anaphylaxie') THEN 'Anaphylaxis'
        WHEN contains(low, 'éruption') OR contains(low, 'eruption') THEN 'Rash' END END AS reaction,
      CASE kind WHEN 'NONE' THEN 0.0 WHEN 'UNCERTAIN' THEN least(coalesce(nullif(confidence, 0), 0.7), 0.7) ELSE coalesce(confidence, 1.0) END AS candidate_confidence,
      CASE WHEN kind IN ('NONE', 'UNCERTAIN') THEN 'TEXT_ASSERTION_UNCERTAIN' WHEN method = 'OCR_RULES' AND coalesce(confidence, 1.0) < 0.85
        THEN 'OCR_CONFIDENCE_TOO_LOW' END AS failure FROM k)"""


@query(
    "n4_extract_assertions",
    "b_narrative",
    sql=f"WITH {_assertion_sql()} SELECT doc_id, assertion, substance, reaction, candidate_confidence, failure FROM cand",
)
def n4_extract_assertions(src: Source) -> DataFrame:
    return documents.extract_assertions(src.view("b_narrative")).select(
        "doc_id", "assertion", "substance", "reaction", "candidate_confidence", "failure"
    )


@query(
    "n5_reconcile",
    "b_narrative",
    sql=f"""WITH {_assertion_sql()}, s AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'EXPLICITLY_ABSENT' WHEN quality = 1 THEN 'PRESENT' ELSE 'UNKNOWN' END AS structured_state FROM labels),
    p AS (SELECT c.*, s.structured_state, s.structured_state IN ('PRESENT', 'EXPLICITLY_ABSENT') AND assertion IN ('PRESENT', 'EXPLICITLY_ABSENT') AS cmp
          FROM cand c JOIN s USING (doc_id))
    SELECT doc_id, structured_state, assertion,
      CASE WHEN failure IS NULL AND cmp AND structured_state <> assertion THEN 'QUARANTINE' ELSE 'PUBLISH' END AS structured_decision,
      CASE WHEN failure IS NULL AND cmp AND structured_state = assertion THEN 'OMIT' ELSE 'QUARANTINE' END AS narrative_decision,
      CASE WHEN failure IS NOT NULL THEN failure WHEN cmp AND structured_state <> assertion THEN 'CLINICAL_INCONSISTENCY'
           WHEN NOT cmp THEN 'TEXT_ASSERTION_UNCERTAIN' END AS reconciliation_failure FROM p""",
)
def n5_reconcile(src: Source) -> DataFrame:
    state = F.when(F.col("toxic") == 1, "EXPLICITLY_ABSENT").when(F.col("quality") == 1, "PRESENT").otherwise("UNKNOWN")
    structured = src.table("labels").select("doc_id", state.alias("structured_state"))
    pairs = documents.extract_assertions(src.view("b_narrative")).join(structured, "doc_id")
    return documents.reconcile(pairs).select(
        "doc_id", "structured_state", "assertion", "structured_decision", "narrative_decision", "reconciliation_failure"
    )


@query(
    "n6_confidence_histogram",
    sql="""WITH s AS (SELECT lang AS device, (n_chars % 101) / 100.0 AS confidence FROM documents),
    b(le) AS (VALUES (0.5),(0.7),(0.8),(0.85),(0.9),(0.95),(0.98),(0.99),(1.0),(NULL))
    SELECT device, CAST(le AS DOUBLE) AS le, count(*) FILTER (le IS NULL OR confidence <= le) AS spans FROM s, b GROUP BY 1, 2""",
)
def n6_confidence_histogram(src: Source) -> DataFrame:
    spans = src.table("documents").select(
        F.col("lang").alias("device"), ((F.col("n_chars") % 101) / 100.0).alias("confidence")
    )
    return documents.confidence_histogram(spans, "device", "confidence")
