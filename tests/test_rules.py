"""Truth tables of the single rules."""

import hashlib
import hmac
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from formloom.functions import answers, identity
from formloom.functions.ratios import ratio4
from formloom.operators import catalog, documents, intake, privacy, quality
from formloom.session import local_table

STATE_CASES = [
    (True, True, "oui", "DELETED", "DELETED"),
    (True, False, "oui", "VOIDED", "VOIDED"),
    (True, False, "oui", "DRAFT", "NOT_RECORDED"),
    (True, False, "oui", "SIGNED", "NOT_DISPLAYED_BY_FORM_LOGIC"),
    (False, True, "oui", "SIGNED", "NOT_RECORDED"),
    (True, True, None, "SIGNED", "NOT_RECORDED"),
    (True, True, "", "SIGNED", "NOT_RECORDED"),
    (True, True, "  ", "SIGNED", "PRESENT"),
    (True, True, " NON ", "SIGNED", "EXPLICITLY_ABSENT"),
    (True, True, "False", "CORRECTED", "EXPLICITLY_ABSENT"),
    (True, True, "Inconnu", "SIGNED", "UNKNOWN"),
    (True, True, "N/A", "SIGNED", "NOT_APPLICABLE"),
    (True, True, "0", "SIGNED", "PRESENT"),
]


def test_answer_states(spark):
    df = local_table(spark, STATE_CASES, "present boolean, enabled boolean, raw string, status string, want string")
    got = df.select(
        answers.answer_state(F.col("present"), F.col("enabled"), F.col("raw"), F.col("status")).alias("got"), "want"
    ).collect()
    assert [r.got for r in got] == [r.want for r in got]


COERCE_CASES = [
    ("bool", "true", "boolean", "true"),
    ("str", "FALSE", "boolean", "false"),
    ("num", "1", "boolean", None),
    ("num", "12", "integer", "12.000000000"),
    ("num", "12.0", "integer", "12.000000000"),
    ("num", "12.5", "integer", None),
    ("str", " +7 ", "integer", "7.000000000"),
    ("str", "7.0", "integer", None),
    ("bool", "true", "integer", None),
    ("str", "1e3", "decimal", "1000.000000000"),
    ("str", "NaN", "decimal", None),
    ("bool", "true", "decimal", None),
    ("num", "1", "string", None),
    ("str", "a", "text", "a"),
    ("str", "2024-02-30", "date", None),
    ("str", "20240229", "date", "2024-02-29"),
    ("str", "2024-01-01T10:00:00", "datetime", None),
    ("str", "2024-01-01T10:00:00+02:00", "datetime", "2024-01-01 08:00:00"),
    ("str", "x", "group", None),
]


def test_coercion(spark):
    df = local_table(spark, COERCE_CASES, "t string, s string, kind string, want string")
    rows = df.select(answers.coerce(F.col("t"), F.col("s"), F.col("kind"))["s"].alias("got"), "want", "s", "kind").collect()
    assert [(r.s, r.kind, r.got) for r in rows] == [(r.s, r.kind, r.want) for r in rows]


NUM = lambda v: ("num", str(v), Decimal(v))
CONDITION_CASES = [
    (None, "exists", ("bool", "true", Decimal(1)), False),
    (None, "exists", ("bool", "false", Decimal(0)), True),
    (("str", "a", None), "exists", ("bool", "true", Decimal(1)), True),
    (None, "ne", ("str", "a", None), False),
    (("str", "1", None), "eq", NUM(1), False),
    (("bool", "true", Decimal(1)), "eq", NUM(1), True),
    (("str", "a", None), "ne", ("str", "b", None), True),
    (("str", "10", None), "gt", NUM(9), True),
    (("str", "abc", None), "gt", NUM(9), False),
    (("bool", "true", Decimal(1)), "gt", NUM(0), False),
    (NUM(5), "gte", NUM(5), True),
    (NUM(5), "lt", NUM(5), False),
    (NUM(4), "lte", ("str", "5", None), True),
]


def test_conditions(spark):
    df = local_table(spark, CONDITION_CASES, f"a {answers.SCALAR}, op string, e {answers.SCALAR}, want boolean")
    rows = df.select(answers.condition_holds(F.col("a"), F.col("op"), F.col("e")).alias("got"), "want").collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_uuid_and_hmac_match_the_standard_library(spark):
    namespace = uuid.UUID(identity.NAMESPACE_HEX)
    key = b"k" * 70
    pads = identity.hmac_pads(key)
    df = local_table(spark, [("s1", " äö 7 ")], "site string, who string")
    row = df.select(
        identity.deterministic_uuid("kind", "site", "who").alias("u"),
        identity.pseudonymize("who", "site", F.lit(pads[0]), F.lit(pads[1])).alias("p"),
        identity.integer_fact_id(F.lit("ffffffff-0000")).alias("i"),
    ).first()
    assert row.u == str(uuid.uuid5(namespace, "kind\x1fs1\x1f äö 7 "))
    digest = hmac.new(key, b"s1\x00" + "äö 7".encode(), hashlib.sha256).hexdigest()
    assert row.p == "p_" + digest[:32]
    assert row.i == 0xFFFFFFFF % 2_000_000_000 + 1
    with pytest.raises(ValueError):
        identity.hmac_pads(b"short")


def test_multiset_digest_ignores_order_and_counts_copies(spark):
    def digest(values):
        df = local_table(spark, [(v,) for v in values], "v string").select(F.sha2("v", 256).alias("h"))
        return df.agg(identity.multiset_digest("h")).first()[0]

    assert digest(["a", "b", "a"]) == digest(["b", "a", "a"])
    assert digest(["a", "b", "a"]) != digest(["a", "b"])
    assert digest(["a", "a"]) != digest(["b", "b"])


def test_ratio_is_half_even(spark):
    cases = [(87, 100, "0.8700"), (1, 20000, "0.0000"), (3, 20000, "0.0002"), (21, 84, "0.2500"), (1, 0, None), (1, None, None), (2, 3, "0.6667")]
    df = local_table(spark, cases, "a bigint, b bigint, want string")
    rows = df.select(ratio4(F.col("a"), F.col("b")).cast("string").alias("got"), "want").collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_coverage_keeps_unknown_denominators(spark):
    df = local_table(spark, [(100, 87, 84, 21), (None, 10, 8, 2)], "eligible_count bigint, recorded_count bigint, usable_count bigint, positive_count bigint")
    known, unknown = catalog.coverage(df).collect()
    assert (str(known.completion), str(known.usable_coverage), str(known.prevalence)) == ("0.8700", "0.8400", "0.2500")
    assert unknown.completion is None and unknown.usable_coverage is None and not unknown.denominator_known


def test_suppression(spark):
    rows = [(50, 9, 8, 2), (50, 20, 10, 0), (None, 0, 0, 0), (5, 30, 20, 3)]
    df = local_table(spark, rows, "eligible_count bigint, recorded_count bigint, usable_count bigint, positive_count bigint")
    got = [tuple(r) for r in privacy.suppress_small_cells(df, 10).collect()]
    assert got == [(None, 0, 0, 0, True), (50, 20, 10, 0, False), (None, 0, 0, 0, False), (None, 0, 0, 0, True)]


def test_aggregate_guard(spark):
    df = local_table(spark, [(1, "x")], "n int, patient_pseudonym string")
    with pytest.raises(ValueError):
        privacy.guard_aggregate(df)
    assert privacy.guard_aggregate(df.select("n")).columns == ["n"]


def test_decisions(spark):
    # state, failure, concept, evidence count -> decision, first failure
    cases = [
        ("PRESENT", None, 5, 1, "PUBLISH", None),
        ("UNKNOWN", None, 5, 1, "PUBLISH", None),
        ("PRESENT", "UNKNOWN_MAPPING", None, 1, "QUARANTINE", "UNKNOWN_MAPPING"),
        ("PRESENT", "INVALID_UNIT", None, 0, "QUARANTINE", "MISSING_PROVENANCE"),
        ("PRESENT", None, 0, 1, "QUARANTINE", "OMOP_CONFORMANCE_FAILURE"),
        ("INVALID", None, 5, 1, "QUARANTINE", "CLINICAL_INCONSISTENCY"),
        ("VOIDED", None, 5, 1, "OMIT", "CLINICAL_INCONSISTENCY"),
        ("NOT_RECORDED", "UNKNOWN_MAPPING", None, 1, "OMIT", None),
    ]
    df = local_table(spark, cases, "state string, failure string, target_concept_id bigint, n int, want string, first string")
    df = df.withColumn("evidence", F.slice(F.array(F.struct(F.lit("k").alias("object_key"))), F.lit(1), F.col("n")))
    rows = quality.decide(df).select("decision", "want", F.try_element_at("failures", F.lit(1)).alias("got"), "first").collect()
    assert [(r.decision, r.got) for r in rows] == [(r.want, r["first"]) for r in rows]


SENTENCES = [
    ("Allergie à la pénicilline avec urticaire.", "NATIVE_TEXT", None, "PRESENT", "Penicillin", "Urticaria", 1.0, None),
    ("Aucune\n allergie connue", "NATIVE_TEXT", None, "EXPLICITLY_ABSENT", None, None, 1.0, None),
    ("allergie possible à l'amoxicilline", "NATIVE_TEXT", None, "UNKNOWN", "Amoxicillin", None, 0.7, "TEXT_ASSERTION_UNCERTAIN"),
    ("Pas d' allergie, à confirmer", "OCR_RULES", 0.5, "UNKNOWN", None, None, 0.5, "TEXT_ASSERTION_UNCERTAIN"),
    ("ALLERGIE au latex", "OCR_RULES", 0.8, "PRESENT", "Latex", None, 0.8, "OCR_CONFIDENCE_TOO_LOW"),
    ("Hypersensibilité : éruption", "OCR_RULES", 0.9, "PRESENT", None, "Rash", 0.9, None),
    ("allergies", "OCR_RULES", 0.0, "PRESENT", None, None, 0.0, "OCR_CONFIDENCE_TOO_LOW"),
    ("allergies suspectes", "OCR_RULES", 0.99, "PRESENT", None, None, 0.99, None),
    ("antiallergique", "NATIVE_TEXT", None, "UNKNOWN", None, None, 0.0, "TEXT_ASSERTION_UNCERTAIN"),
    ("rien", "NATIVE_TEXT", None, "UNKNOWN", None, None, 0.0, "TEXT_ASSERTION_UNCERTAIN"),
]


def test_assertions(spark):
    df = local_table(spark, [s[:3] for s in SENTENCES], "text string, method string, confidence double")
    rows = documents.extract_assertions(df).select(
        "text", "assertion", "substance", "reaction", "candidate_confidence", "failure"
    ).collect()
    assert [tuple(r) for r in rows] == [(s[0], *s[3:]) for s in SENTENCES]


def test_reconciliation(spark):
    cases = [
        ("PRESENT", "EXPLICITLY_ABSENT", None, "QUARANTINE", "QUARANTINE", "CLINICAL_INCONSISTENCY"),
        ("PRESENT", "EXPLICITLY_ABSENT", "OCR_CONFIDENCE_TOO_LOW", "PUBLISH", "QUARANTINE", "OCR_CONFIDENCE_TOO_LOW"),
        ("PRESENT", "PRESENT", None, "PUBLISH", "OMIT", None),
        ("UNKNOWN", "PRESENT", None, "PUBLISH", "QUARANTINE", "TEXT_ASSERTION_UNCERTAIN"),
    ]
    df = local_table(spark, cases, "structured_state string, assertion string, failure string, a string, b string, c string")
    rows = documents.reconcile(df).collect()
    assert [(r.structured_decision, r.narrative_decision, r.reconciliation_failure) for r in rows] == [(r.a, r.b, r.c) for r in rows]


def test_sniffing(spark):
    cases = [
        (b"%PDF-1.7", "application/pdf", None),
        (b"\x89PNG\r\n\x1a\nx", "image/png", None),
        (b"\xff\xd8\xff\xe0", "image/jpeg", None),
        (b' {"a": 1}', "application/json", None),
        (b'{"a": ', None, "MALFORMED_JSON"),
        (b"<a><b/></a>", "application/xml", None),
        (b"<a><b></a>", None, "MALFORMED_XML"),
        (b'<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>', None, "MALFORMED_XML"),
        (b"a;b\n1;2", "text/csv", None),
        (b"plain", None, "UNKNOWN_FILE_SIGNATURE"),
        (b"\xfe\x00\x81", None, "UNKNOWN_FILE_SIGNATURE"),
    ]
    df = local_table(spark, [(bytes(a), b, c) for a, b, c in cases], "content binary, kind string, error string")
    rows = df.select(intake.sniff_media_type(F.col("content")).alias("s"), "kind", "error").collect()
    assert [tuple(r.s) for r in rows] == [(r.kind, r.error) for r in rows]


def test_filenames(spark):
    cases = [("a/b/c d.pdf", "c-d.pdf"), ("..\\..\\x.csv", "x.csv"), ("...", None), ("dir/", "dir"), ("é.txt", "txt"), ("a" * 200, "a" * 180)]
    df = local_table(spark, cases, "name string, want string")
    rows = df.select(intake.normalize_filename(F.col("name")).alias("got"), "want").collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_cursor_round_trip():
    assert catalog.decode_cursor(catalog.encode_cursor(75)) == 75
    assert catalog.decode_cursor(None) == 0
    with pytest.raises(ValueError):
        catalog.decode_cursor("!!")
