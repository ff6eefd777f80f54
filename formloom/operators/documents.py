"""Narrative documents: routing, evidence spans, assertion rules and reconciliation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.functions.text import WHITE_SPACE

# Media types that may be read, and the least native text that counts.
DOCUMENT_MEDIA_TYPES = ("image/png", "image/jpeg", "image/tiff", "application/pdf")
NATIVE_TEXT_MINIMUM = 40
OCR_CONFIDENCE_MINIMUM = 0.85
UNCERTAIN_CONFIDENCE = 0.7
COMPARABLE_STATES = ("PRESENT", "EXPLICITLY_ABSENT")
CONFIDENCE_BUCKETS = (0.5, 0.7, 0.8, 0.85, 0.9, 0.95, 0.98, 0.99, 1.0)

# Not preceded, or not followed, by a letter, digit or underscore of any script.
_START, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_GAP = f"[{WHITE_SPACE}]+"


@dataclass(frozen=True)
class AssertionRules:
    """Patterns and ordered lexicons of one concept; the defaults are French allergy rules."""

    concept: str = "allergy history"
    # The three patterns, with look-arounds that know letters of every script.
    trigger: str = rf"(?iu){_START}(?:allerg(?:ie|ies|ique)|hypersensibilit[ée]){_END}"
    uncertainty: str = (
        rf"(?iu){_START}(?:possible|suspect(?:e|ée)?|à{_GAP}confirmer|incertain(?:e)?){_END}"
    )
    negation: str = (
        rf"(?iu){_START}(?:aucune?|sans|absence{_GAP}d['’]?|pas{_GAP}d['’]?){_GAP}"
        rf"(?:allergie|allergies){_END}"
    )
    # Words one of which every match of the pattern contains: a plain search for them spares most
    # texts the pattern. Without hints the pattern is always tried.
    trigger_hints: tuple[str, ...] = ("allerg", "hypersensibilit")
    uncertainty_hints: tuple[str, ...] = ("possible", "suspect", "confirmer", "incertain")
    negation_hints: tuple[str, ...] = ("aucun", "sans", "absence", "pas")
    # First entry contained in the text wins, in this order.
    substances: tuple[tuple[str, str], ...] = (
        ("penicilline", "Penicillin"),
        ("pénicilline", "Penicillin"),
        ("amoxicilline", "Amoxicillin"),
        ("latex", "Latex"),
    )
    reactions: tuple[tuple[str, str], ...] = (
        ("urticaire", "Urticaria"),
        ("anaphylaxie", "Anaphylaxis"),
        ("éruption", "Rash"),
        ("eruption", "Rash"),
    )


def _matches(text: Column, folded: Column, pattern: str, hints: tuple[str, ...]) -> Column:
    if not hints:
        return text.rlike(pattern)
    hinted = F.lit(False)
    for hint in hints:
        hinted = hinted | folded.contains(hint)
    return F.when(hinted, text.rlike(pattern)).otherwise(F.lit(False))


def _first_entry(folded: Column, lexicon: tuple[tuple[str, str], ...]) -> Column:
    return F.coalesce(*[F.when(folded.contains(word), F.lit(target)) for word, target in lexicon])


def extract_assertions(
    documents: DataFrame,
    rules: AssertionRules | None = None,
    minimum_confidence: float = OCR_CONFIDENCE_MINIMUM,
) -> DataFrame:
    """Adds the candidate each text supports: assertion, substance, reaction, confidence, failures.

    Without a trigger nothing is asserted. Uncertainty is tested before negation and caps the
    confidence; a low OCR confidence is a failure of an otherwise certain assertion.
    ``documents``: ``text, method, confidence``.
    """
    rules = rules or AssertionRules()
    # The long s folds to s in the patterns but not in lower().
    rows = documents.withColumn("_folded", F.translate(F.lower("text"), "ſ", "s"))
    text, folded = F.col("text"), F.col("_folded")
    kind = (
        F.when(~_matches(text, folded, rules.trigger, rules.trigger_hints), "NONE")
        .when(_matches(text, folded, rules.uncertainty, rules.uncertainty_hints), "UNCERTAIN")
        .when(_matches(text, folded, rules.negation, rules.negation_hints), "NEGATED")
        .otherwise("ASSERTED")
    )
    rows = rows.withColumn("_kind", kind)
    k = F.col("_kind")
    given = F.col("confidence")
    capped = F.least(F.coalesce(F.when(given != 0, given), F.lit(UNCERTAIN_CONFIDENCE)), F.lit(UNCERTAIN_CONFIDENCE))
    confidence = (
        F.when(k == "NONE", F.lit(0.0)).when(k == "UNCERTAIN", capped).otherwise(F.coalesce(given, F.lit(1.0)))
    )
    low = (F.col("method") == "OCR_RULES") & (F.coalesce(given, F.lit(1.0)) < minimum_confidence)
    failure = (
        F.when(k.isin("NONE", "UNCERTAIN"), "TEXT_ASSERTION_UNCERTAIN").when(low, "OCR_CONFIDENCE_TOO_LOW")
    )
    assertion = (
        F.when(k.isin("NONE", "UNCERTAIN"), "UNKNOWN").when(k == "NEGATED", "EXPLICITLY_ABSENT").otherwise("PRESENT")
    )
    return rows.withColumns(
        {
            "concept": F.lit(rules.concept),
            "substance": F.when(k != "NONE", _first_entry(folded, rules.substances)),
            "reaction": F.when(k != "NONE", _first_entry(folded, rules.reactions)),
            "assertion": assertion,
            "candidate_confidence": confidence,
            "failure": failure,
        }
    ).drop("_folded", "_kind")


def route_documents(documents: DataFrame, pages: DataFrame, minimum: int = NATIVE_TEXT_MINIMUM) -> DataFrame:
    """Adds ``route``: how each document is read.

    ``documents``: ``doc_id, media_type, size, relevant``; ``pages``: ``doc_id, page, text`` of
    native text. Enough native text wins; otherwise irrelevant documents are left alone and the
    rest go to OCR.
    """
    native = pages.groupBy("doc_id").agg(F.sum(F.length("text")).alias("native_characters"))
    joined = documents.join(native, "doc_id", "left")
    enough = (F.col("media_type") == "application/pdf") & (F.coalesce("native_characters", F.lit(0)) >= minimum)
    route = (
        F.when(F.col("size") == 0, "EMPTY_DOCUMENT")
        .when(~F.col("media_type").isin(*DOCUMENT_MEDIA_TYPES), "UNSUPPORTED_DOCUMENT_MEDIA_TYPE")
        .when(enough, "NATIVE_TEXT")
        .when(~F.col("relevant"), "ABSTAIN")
        .otherwise("OCR_RULES")
    )
    return joined.withColumn("route", route)


def dedupe_documents(documents: DataFrame, order: str = "doc_id") -> DataFrame:
    """Adds ``first_id`` of the same content and ``deduplicated`` for the later copies.

    The first copy is an aggregate per checksum, so many copies cost no large group.
    """
    first = documents.groupBy("checksum").agg(F.min(order).alias("first_id"))
    return documents.join(first, "checksum").withColumn("deduplicated", F.col(order) != F.col("first_id"))


def native_spans(pages: DataFrame) -> DataFrame:
    """Evidence of native text: one span per page that has any."""
    text = pages.filter(F.length("text") > 0)
    return text.select(
        "doc_id",
        "page",
        F.lit(None).cast("int").alias("span_index"),
        "text",
        F.lit(0).alias("text_span_start"),
        F.length("text").alias("text_span_end"),
        F.lit(None).cast("array<double>").alias("bounding_box"),
        F.concat(F.lit("pdf:page:"), F.col("page").cast("string")).alias("source_locator"),
        F.lit("NATIVE_TEXT").alias("extraction_method"),
        F.lit(None).cast("double").alias("confidence"),
    )


def ocr_spans(pages: DataFrame) -> DataFrame:
    """Evidence of recognized text: one row per span of each page.

    ``pages.spans`` is an array of (text, confidence, bounding_box).
    """
    spans = pages.select("doc_id", "page", F.posexplode("spans").alias("span_index", "s"))
    page, index = F.col("page").cast("string"), F.col("span_index").cast("string")
    return spans.select(
        "doc_id",
        "page",
        "span_index",
        F.col("s.text").alias("text"),
        F.lit(None).cast("int").alias("text_span_start"),
        F.lit(None).cast("int").alias("text_span_end"),
        F.col("s.bounding_box").alias("bounding_box"),
        F.concat(F.lit("ocr:page:"), page, F.lit(":span:"), index).alias("source_locator"),
        F.lit("OCR_RULES").alias("extraction_method"),
        F.col("s.confidence").alias("confidence"),
    )


def reconcile(pairs: DataFrame) -> DataFrame:
    """Decisions for a structured answer and the narrative candidate about the same concept.

    ``pairs``: ``structured_state, assertion, failure``. Uncertain text never touches the
    structured answer; an explicit contradiction quarantines both; agreement omits the text.
    """
    comparable = F.col("structured_state").isin(*COMPARABLE_STATES) & F.col("assertion").isin(*COMPARABLE_STATES)
    conflict = comparable & (F.col("structured_state") != F.col("assertion"))
    failed = F.col("failure").isNotNull()
    return pairs.withColumns(
        {
            "structured_decision": F.when(~failed & conflict, "QUARANTINE").otherwise("PUBLISH"),
            "narrative_decision": F.when(~failed & comparable & ~conflict, "OMIT").otherwise("QUARANTINE"),
            "reconciliation_failure": F.when(failed, F.col("failure"))
            .when(conflict, "CLINICAL_INCONSISTENCY")
            .when(~comparable, "TEXT_ASSERTION_UNCERTAIN"),
        }
    )


def confidence_histogram(spans: DataFrame, key: str, value: str) -> DataFrame:
    """(key, le, spans): cumulative counts per bucket bound, the open last bucket as null."""
    counts = [F.count_if(F.col(value) <= bound).alias(f"b{i}") for i, bound in enumerate(CONFIDENCE_BUCKETS)]
    per_key = spans.groupBy(key).agg(*counts, F.count(value).alias("every"))
    rows = [F.struct(F.lit(bound).alias("le"), F.col(f"b{i}").alias("spans")) for i, bound in enumerate(CONFIDENCE_BUCKETS)]
    rows.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("every").alias("spans")))
    return per_key.select(key, F.explode(F.array(*rows)).alias("b")).select(key, "b.*")
