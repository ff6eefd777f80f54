"""Table-level operators against brute force and literal expectations."""

import io
import random
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from formloom.operators import forms, intake, lifecycle, lineage, omop, ordering, privacy, releases
from formloom.plans import registry
from formloom.plans.answers import event_decisions, eav_canonical, event_entries
from formloom.operators import mapping
from formloom.session import fresh_path, local_table, shared_dir
from formloom.sources import fhir, files, structured, synthetic
from formloom.streaming import supersession


def test_positions_and_running_totals_match_brute_force(spark):
    rng = random.Random(3)
    # One key holds a third of the rows.
    rows = [(0 if rng.random() < 0.34 else rng.randrange(20), n, rng.randrange(9)) for n in range(3000)]
    df = local_table(spark, rows, "k int, n int, v int").repartition(5)
    got = {(r.k, r.n): r.idx for r in ordering.group_index(df, ["k"], "n").collect()}
    blocks = {(r.k, r.n): r.idx for r in ordering.block_ordinal(df, ["k"], "n", "idx", block=64).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for i, n in enumerate(sorted(r[1] for r in rows if r[0] == key)):
            want[(key, n)] = i
    assert got == want and blocks == want
    out = {r.n: (r.s, r.m, r.i) for r in ordering.running(df, ["n"], {"s": "v"}, {"m": "v"}, "i").collect()}
    total, top = 0, 0
    for _, n, v in sorted(rows, key=lambda r: r[1]):
        total, top = total + v, max(top, v)
        assert out[n] == (total, top, n)


def _probe(bases, taken, space):
    used, out = set(taken), {}
    for base, key in sorted(bases):
        slot = base
        while slot in used:
            slot = slot % space + 1
        used.add(slot)
        out[key] = slot
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_id_collisions_match_linear_probing(spark, seed):
    rng = random.Random(seed)
    space = 220
    taken = rng.sample(range(1, space + 1), 60)
    bases = [(rng.choice([rng.randrange(1, space + 1), 190, 215]), key) for key in range(120)]
    df = local_table(spark, [(b, k) for b, k in bases], "base int, key int")
    stored = local_table(spark, [(t,) for t in taken], "id int")
    got = {r.key: r.resolved_id for r in omop.resolve_id_collisions(df, "base", "key", taken=stored, space=space).collect()}
    want = _probe(bases, taken, space)
    # The same ids are used; which row gets which may differ only after a wrap.
    assert len(set(got.values())) == len(bases) and not set(got.values()) & set(taken)
    assert set(got.values()) == set(want.values())
    plain = {r.key: r.resolved_id for r in omop.resolve_id_collisions(df, "base", "key", space=2_000_000_000).collect()}
    assert plain == _probe(bases, [], 2_000_000_000)
    with pytest.raises(ValueError):
        omop.resolve_id_collisions(df, "base", "key", taken=stored, space=100)


def test_documents_nest_as_deep_as_they_like(spark):
    import json

    deep, leaf = 8, {"linkId": "L8", "answer": [{"valueString": 'a "item": [ ] } text'}]}
    item, definition = leaf, {"item_id": "L8", "path": "P8", "data_type": "string", "label": "x", "order": 0}
    xml = '<item id="L8" data-type="string" label="a &gt; b"/>'
    for level in range(deep - 1, 0, -1):
        item = {"linkId": f"L{level}", "item": [item]}
        definition = {"item_id": f"L{level}", "path": f"P{level}", "data_type": "group", "label": "x", "order": 0, "children": [definition]}
        xml = f'<item id="L{level}" data-type="group" label="x">{xml}</item>'
    response = json.dumps({"resourceType": "QuestionnaireResponse", "id": "r", "item": [item]})
    questionnaire = json.dumps({"resourceType": "Questionnaire", "id": "q", "item": [json.loads(json.dumps(item).replace('"answer"', '"ignored"').replace('"linkId"', '"type": "string", "linkId"'))]})
    head = {"ehr_product": "e", "ehr_version": "1", "form_id": "f", "form_family": "f", "version": "1", "title": "t"}
    form = json.dumps({"schema_version": "structured/1.0", "form": {**head, "items": [definition]}})
    form_xml = '<form-definition schema-version="structured/1.0" ' + " ".join(f'{k.replace("_", "-")}="{v}"' for k, v in head.items()) + f">{xml}</form-definition>"

    def table(content):
        return local_table(spark, [("k", content)], "object_key string, content string")

    none = local_table(spark, [], "form_id string, version string, path string, repeats boolean")
    docs = local_table(spark, [("s", "p", "k", response, "f", "1")], "establishment_id string, patient_pseudonym string, object_key string, content string, form_id string, version string")
    _, answers, errors = fhir.read_responses(docs, none, ["form_id", "version"])
    rows = answers.filter("present").collect()
    assert errors.count() == 0 and len(rows) == 1 and rows[0].item_path.count("/") == deep - 1
    assert fhir.read_questionnaires(table(questionnaire))[1].count() == deep
    assert structured.read_json_definitions(table(form))[1].count() == deep
    assert structured.read_xml_definitions(table(form_xml))[1].count() == deep


def test_error_rows_of_structured_responses(spark):
    """One response per fault, one without answers and one without faults; instances may share a name."""
    from formloom.operators import canonical

    form = ["form_id", "form_version"]
    items = spark.sql(f"""
        SELECT 'f' AS form_id, '1' AS form_version, * FROM VALUES ('A', 'string', NULL, 'u'), ('B', 'integer', NULL, NULL), ('G', 'group', 'G', NULL),
        ('G/X', 'string', 'G', NULL), ('G/Y', 'string', 'G', 'kg'), ('H/Z', 'string', 'H', NULL) AS v(path, data_type, repeated_root, unit)""")
    shown = "array(named_struct('source_item_path', 'A', 'operator', 'eq', 'expected', named_struct('t', 'str', 's', 'yes', 'num', CAST(NULL AS decimal(38,9)))))"
    items = items.withColumn("conditions", F.expr(f"CASE WHEN path IN ('B', 'G/Y') THEN {shown} ELSE filter({shown}, x -> false) END"))
    names = ["empty", "good", "unknown", "group", "bare", "placed", "twice", "conflict"]
    heads = local_table(spark, [("s", n, "f", "1", "p", "SIGNED") for n in names],
                        "establishment_id string, response_id string, form_id string, form_version string, patient_pseudonym string, lifecycle_status string")
    given = [("good", "A", None, "yes", None), ("good", "B", None, "x", True), ("good", "G/X", "1", "v", None), ("good", "H/Z", "1", "w", None),
             ("good", "G/Y", "2", "", None), ("unknown", "Q", None, "v", None), ("group", "G", "1", "v", None), ("bare", "G/X", None, "v", None),
             ("placed", "A", "1", "v", None), ("twice", "A", None, "v", None), ("twice", "A", None, "w", None), ("conflict", "B", None, "1", True)]
    answers = local_table(spark, [("s", r, "f", "1", p, g, "str", v, i, d) for i, (r, p, g, v, d) in enumerate(given)],
                          "establishment_id string, response_id string, form_id string, form_version string, item_path string, group_instance string, "
                          "raw_type string, raw_value string, pos bigint, declared_enabled boolean")
    stream = canonical.canonical_stream(heads, answers, items, form)
    assert {r.response_id: r.reason for r in canonical.canonical_errors(stream).collect()} == {
        "unknown": "UNKNOWN_ITEM_PATH", "group": "INVALID_STRUCTURED_VALUE", "bare": "REPEATED_GROUP_CONFLICT",
        "placed": "REPEATED_GROUP_CONFLICT", "twice": "DUPLICATE_ANSWER", "conflict": "CONDITIONAL_LOGIC_CONFLICT"}
    rows = {(r.response_id, r.item_path, r.group_instance): (r.state, r.unit) for r in canonical.canonicalize_structured(heads, answers, items, form).collect()}
    hidden = "NOT_DISPLAYED_BY_FORM_LOGIC"
    assert rows == {
        ("empty", "A", None): ("NOT_RECORDED", "u"), ("empty", "B", None): (hidden, None), ("good", "A", None): ("PRESENT", None),
        ("good", "B", None): ("INVALID", None), ("good", "G/X", "1"): ("PRESENT", None), ("good", "G/Y", "1"): ("NOT_RECORDED", "kg"),
        ("good", "H/Z", "1"): ("PRESENT", None), ("good", "G/X", "2"): ("NOT_RECORDED", None), ("good", "G/Y", "2"): ("NOT_RECORDED", None)}


def test_items_are_reached_at_any_depth(spark):
    rows = [("f", f"P{i}", f"P{i - 1}" if i else None, i == 3) for i in range(8)]
    items = local_table(spark, rows, "form_id string, path string, parent_path string, repeats boolean")
    found = {r.path: (r.depth, r.repeated_root) for r in forms.flatten_items(items, ["form_id"]).collect()}
    assert found == {f"P{i}": (i, "P3" if i >= 3 else None) for i in range(8)}


def test_trace_and_ancestry_have_no_limit(spark):
    edges = local_table(spark, [(f"n{i}", f"n{i + 1}") for i in range(15)], "source string, target string")
    starts = local_table(spark, [("n15",)], "node_id string")
    assert lineage.trace(edges, starts).count() == 16
    chain = local_table(spark, [(f"r{i}", f"r{i - 1}" if i else None) for i in range(130)], "release_id string, parent_release_id string")
    assert [r.depth for r in releases.release_ancestry(chain, "r129").collect()] == list(range(130))


def test_cycles_at_the_end_of_long_paths(spark, monkeypatch):
    """A path of 3,000 edges, a cycle of 500 behind another path, two cycles with a way between, branching layers."""
    edges = [(f"p{i}", f"p{i + 1}") for i in range(3000)]
    edges += [(f"q{i}", f"q{i + 1}") for i in range(300)] + [("q300", "r0")] + [(f"r{i}", f"r{(i + 1) % 500}") for i in range(500)]
    edges += [("a", "b"), ("b", "a"), ("b", "m"), ("m", "n"), ("n", "x"), ("x", "x"), ("x", "out"), ("in", "a")]
    edges += [(f"d{i}{s}", f"d{i + 1}{t}") for i in range(6) for s in "uv" for t in "uv"]
    nodes = sorted({n for e in edges for n in e})
    written = []
    monkeypatch.setattr(lineage, "cut", lambda df, label="cut", keep=lineage.cut: written.append(label) or keep(df, label))
    found = lineage.graph_findings(local_table(spark, [(n,) for n in nodes], "node_id string"), local_table(spark, edges, "source string, target string"))
    assert {(r.finding, r.node_id) for r in found.collect()} == {("CYCLE", n) for n in [*(f"r{i}" for i in range(500)), "a", "b", "m", "n", "x"]}
    assert len(written) < 120
    acyclic = local_table(spark, edges[:3000], "source string, target string")
    assert lineage.graph_findings(local_table(spark, [(n,) for n in nodes], "node_id string"), acyclic).isEmpty()
    assert lineage.graph_findings(local_table(spark, [], "node_id string"), acyclic.limit(0)).isEmpty()


def test_compact_traces_expand_to_all_pairs(spark):
    """Random layers with hubs, also hubs behind hubs, in both directions, against breadth-first search."""
    rng = random.Random(6)
    edges = {(f"n{a}", f"n{rng.randrange(60)}") for a in range(60) for _ in range(2)} | {(f"n{i}", "h1") for i in range(30)} | {("h1", f"n{i}") for i in range(20, 50)}
    edges |= {("h1", "h2")} | {("h2", f"m{i}") for i in range(20)} | {(f"m{i}", "h2") for i in range(20)}
    table = local_table(spark, sorted(edges), "source string, target string")
    starts = ["n1", "n7", "m3", "h1", "alone"]
    for direction in ("upstream", "downstream"):
        onward = {}
        for a, b in edges:
            a, b = (a, b) if direction == "downstream" else (b, a)
            onward.setdefault(a, set()).add(b)
        want = set()
        for start in starts:
            depth, level, seen = 0, {start}, set()
            while level:
                want |= {(start, n, depth) for n in level}
                seen |= level
                level, depth = {n for m in level for n in onward.get(m, ())} - seen, depth + 1
        first = local_table(spark, [(s,) for s in starts], "node_id string")
        compact = lineage.compact_trace(table, first, direction, hub=12)
        assert {tuple(r) for r in lineage.expand_trace(compact, first).collect()} == want
        assert compact.count() < len(want)


def test_redaction_reaches_every_map(spark):
    df = spark.sql("SELECT map('patient_name', named_struct('a', 1), 'site', named_struct('a', 2)) AS m, map('x', map('patient_name', 'p', 'k', 'v')) AS n")
    row = privacy.redact(df).first()
    assert row.m["patient_name"] is None and row.m["site"].a == 2
    assert row.n["x"] == {"patient_name": privacy.REDACTED, "k": "v"}


def test_unique_ids_per_table(spark):
    claims = [("note", f"n{i}", 7 if i < 4 else 100 + i) for i in range(9)] + [("measurement", f"m{i}", 7 + i) for i in range(5)]
    claims += [("observation", "o1", 3), ("observation", "o2", 9)]
    df = local_table(spark, claims, "omop_table string, key string, base bigint")
    stored = local_table(spark, [("observation", 9), ("note", 8)], "omop_table string, id bigint")
    got = {(r.omop_table, r.key): r.id for r in omop.unique_ids(df, stored).collect()}
    assert len(got) == len(claims) and len({(t, i) for (t, _), i in got.items()}) == len(claims)
    assert all(got["measurement", f"m{i}"] == 7 + i for i in range(5))
    assert sorted(got["note", f"n{i}"] for i in range(4)) == [7, 9, 10, 11] and got["observation", "o2"] == 10


def _answers(spark, rows):
    """rows: (event, patient, [(status, target)])"""
    at = datetime(2024, 1, 1)
    data = [
        (e, p, "f", "i", None, "PRESENT", "v", [(s, at, n, t) for n, (s, t) in enumerate(steps)]) for e, p, steps in rows
    ]
    return local_table(
        spark, data,
        "event_id string, patient_pseudonym string, form_id string, item_path string, group_instance string, state string, value string, "
        "lifecycle array<struct<status:string,occurred_at:timestamp,source_sequence:bigint,supersedes_event_id:string>>",
    )


def test_lifecycle_resolution(spark):
    rows = [
        ("a", "p", []), ("b", "p", [("CORRECTED", "a")]), ("c", "p", [("VOIDED", "b")]),
        ("d", "q", []), ("e", "q", [("CORRECTED", "d")]), ("f", "q", [("CORRECTED", "d")]),
        ("g", "p", [("CORRECTED", "g")]), ("h", "p", [("CORRECTED", "d")]), ("i", "p", [("CORRECTED", None)]),
        ("j", "r", [("CORRECTED", "k")]), ("k", "r", [("CORRECTED", "l")]), ("l", "r", [("CORRECTED", "j")]),
        ("m", "p", [("SIGNED", None)]), ("x", "p", []), ("x", "p", []),
    ]
    got = {(r.event_id, r.state, r.value, r.lifecycle_error) for r in lifecycle.resolve_lifecycle(_answers(spark, rows)).collect()}
    state = {e: (s, err) for e, s, _, err in got}
    assert state["a"] == ("SUPERSEDED", None) and state["b"] == ("SUPERSEDED", None) and state["c"] == ("PRESENT", None)
    assert state["d"][0] == "PRESENT" and state["e"][1] == state["f"][1] == "AMBIGUOUS_SUPERSESSION"
    assert {state[e][1] for e in "ghi"} == {"INVALID_SUPERSESSION"}
    assert {state[e] for e in "jkl"} == {("PRESENT", "CYCLIC_SUPERSESSION")}
    assert state["m"] == ("PRESENT", None) and state["x"][1] == "DUPLICATE_EVENT_ID"
    assert all(value is None for _, s, value, _ in got if s == "SUPERSEDED")
    with pytest.raises(ValueError):
        lifecycle.resolve_lifecycle(_answers(spark, rows), fail_on_error=True)


def test_supersession_across_micro_batches(spark):
    schema = "event_id string, entity string, lifecycle_status string, supersedes_event_id string"
    batches = [
        [("a", "p", "SIGNED", None), ("c", "p", "CORRECTED", "late")],
        [("b", "p", "CORRECTED", "a"), ("late", "p", "SIGNED", None)],
        [("d", "p", "CORRECTED", "a"), ("e", "q", "CORRECTED", "b"), ("f", "p", "CORRECTED", "never"), ("b", "p", "SIGNED", None)],
    ]
    stored, seen = None, []
    for number, rows in enumerate(batches):
        new = supersession.messages(local_table(spark, rows, schema))
        prior = stored if stored is not None else local_table(spark, [("-", None, "-", 0)], supersession.STORED).limit(0)
        seen.append({(r.answer_id, r.change, r.claimant) for r in supersession.changes(new, prior).collect()})
        tagged = new.withColumn("micro_batch", F.lit(number))
        stored = tagged if stored is None else stored.unionByName(tagged)
    assert seen[0] == {("a", "CURRENT", None), ("c", "CURRENT", None)}
    assert seen[1] == {("a", "SUPERSEDED", "b"), ("b", "CURRENT", None), ("late", "SUPERSEDED", "c")}
    assert {("a", "AMBIGUOUS_SUPERSESSION", "d"), ("b", "INVALID_SUPERSESSION", "e"), ("b", "DUPLICATE_EVENT_ID", None)} <= seen[2]
    gone = {(r.answer_id, r.claimant) for r in supersession.expired(stored, 3).collect()}
    assert gone == {("never", "f")}


def test_mapping_precedence(spark):
    from formloom.plans.answers import _entry

    entries = [
        _entry("site", "q", "OBSERVATION", 1, establishment_id="s1", source_fingerprint="sf"),
        _entry("source", "q", "OBSERVATION", 2, source_fingerprint="sf", compatibility_fingerprint="cf"),
        _entry("compat", "q", "OBSERVATION", 3, compatibility_fingerprint="cf"),
    ]
    answers = local_table(
        spark,
        [("1", "s1", "q", "sf", "cf"), ("2", "s2", "q", "sf", "cf"), ("3", "s2", "q", "other", "cf"), ("4", "s1", "q", "x", "y"), ("5", "s1", "z", "sf", "cf")],
        "event_id string, establishment_id string, item_path string, source_fingerprint string, compatibility_fingerprint string",
    )
    table = local_table(spark, [tuple(e.values()) for e in entries], mapping.ENTRY_SCHEMA)
    got = {r.event_id: (r.mapping.mapping_id if r.mapping else None, r.resolution) for r in mapping.resolve(answers, table).collect()}
    assert got["1"] == ("site", "RESOLVED") and got["2"] == ("source", "RESOLVED")
    # Two entries share the compatibility fingerprint, so the lowest level is ambiguous.
    assert got["3"] == (None, "AMBIGUOUS_MAPPING")
    assert got["4"] == got["5"] == (None, "UNKNOWN_MAPPING")


def _form(spark, items, version="1", title="t"):
    heads = local_table(
        spark, [("f", version, "fam", "prod", "9", title, True, {"a": "b"})],
        "form_id string, version string, form_family string, ehr_product string, ehr_version string, title string, source_order_semantic boolean, metadata map<string,string>",
    )
    rows = local_table(
        spark, [("f", version, p, None, p, label, "string", order, semantic, False, False, None, None, [], []) for p, label, order, semantic in items],
        "form_id string, version string, path string, parent_path string, item_id string, label string, data_type string, item_order int, order_semantic boolean, "
        "required boolean, repeats boolean, unit string, calculation string, options array<struct<code:string>>, conditions array<struct<operator:string>>",
    )
    row = forms.fingerprint_forms(heads, rows, ["form_id", "version"]).first()
    return row.source_fingerprint, row.compatibility_fingerprint


def test_fingerprints(spark):
    source, compat = _form(spark, [("a", "A  b", 0, False), ("b", "B", 1, False)])
    assert _form(spark, [("b", "B", 1, False), ("a", " A b ", 0, False)]) == (source, compat)
    # A new title or version only changes the source fingerprint, gaps in the order likewise.
    for changed in (_form(spark, [("a", "A b", 0, False), ("b", "B", 1, False)], title="other"), _form(spark, [("a", "A b", 0, False), ("b", "B", 7, False)])):
        assert changed[0] != source and changed[1] == compat
    # Swapping items or relabelling changes both.
    for changed in (_form(spark, [("a", "A b", 1, False), ("b", "B", 0, False)]), _form(spark, [("a", "A c", 0, False), ("b", "B", 1, False)])):
        assert changed[0] != source and changed[1] != compat


def test_graph_findings_and_trace(spark):
    edges = local_table(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "source string, target string")
    nodes = local_table(spark, [(n,) for n in "abcxyy"], "node_id string")
    got = {(r.finding, r.node_id) for r in lineage.graph_findings(nodes, edges).collect()}
    assert got == {("DUPLICATE_NODE", "y"), ("DANGLING_EDGE", "d"), ("CYCLE", "x"), ("CYCLE", "y")}
    start = local_table(spark, [("d",)], "node_id string")
    assert {(r.node_id, r.depth) for r in lineage.trace(edges, start).collect()} == {("d", 0), ("c", 1), ("b", 2), ("a", 2)}


def test_finalize_check(spark):
    expected = local_table(spark, [(0, 0, 2), (1, 2, 4), (2, 5, 6), (3, 6, 7)], "partition_id int, first_row bigint, end_row bigint")
    rows = local_table(spark, [(0, 1), (0, 2), (1, 3), (2, 4), (2, 4), (9, 8)], "partition_id int, event_id bigint")
    got = {(r.finding, r.partition_id) for r in releases.finalize_check(expected, rows).collect()}
    assert got == {
        ("COUNT_MISMATCH", 1), ("COUNT_MISMATCH", 2), ("NOT_CONTIGUOUS", 2), ("MISSING_PARTITION", 3),
        ("UNEXPECTED_PARTITION", 9), ("DUPLICATE_EVENT_ID", 2),
    }


def _zipped(names, data=b"x" * 10):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name in names:
            archive.writestr(name, data)
    return buffer.getvalue()


@pytest.mark.filterwarnings("ignore:Duplicate name")
def test_archives(spark):
    cases = {
        "ok": (_zipped(["a/b.txt", "c.json"]), None),
        "up": (_zipped(["a/../b.txt"]), "UNSAFE_ARCHIVE_PATH"),
        "abs": (_zipped(["/b.txt"]), "UNSAFE_ARCHIVE_PATH"),
        "nested": (_zipped(["b.tar"]), "NESTED_ARCHIVE"),
        "twice": (_zipped(["b.txt", "b.txt"]), "DUPLICATE_ARCHIVE_PATH"),
        "bomb": (_zipped(["b.txt"], b"0" * 200_000), "ARCHIVE_COMPRESSION_RATIO"),
        "many": (_zipped([f"{i}.txt" for i in range(101)]), "ARCHIVE_ENTRY_LIMIT"),
        "junk": (b"not a zip", "INVALID_ARCHIVE"),
    }
    df = local_table(spark, [(k, v[0]) for k, v in cases.items()], "archive_id string, content binary")
    got = {r.archive_id: r.violation for r in intake.archive_verdicts(intake.inspect_archives(intake.list_archives(df))).collect()}
    assert got == {k: v[1] for k, v in cases.items()}


def test_vocabulary_files(spark, tmp_path):
    header = "\t".join(files.VOCABULARY_FILES["DOMAIN.csv"])
    (tmp_path / "DOMAIN.csv").write_text("﻿" + header + "\nObs\tObservation\t27\nMeas\t\t21\nX\tY\tz\n", encoding="utf-8")
    rows, errors = files.read_vocabulary(spark, str(tmp_path), "DOMAIN.csv")
    assert [tuple(r) for r in rows.collect()] == [("Obs", "Observation", 27)]
    assert {(r.key, r.error) for r in errors.collect()} == {("Meas", "empty_value:domain_name"), ("X", "invalid_integer:domain_concept_id")}
    (tmp_path / "CONCEPT_CLASS.csv").write_text("a\tb\n")
    with pytest.raises(ValueError):
        files.read_vocabulary(spark, str(tmp_path), "CONCEPT_CLASS.csv")


def test_cdm_catalog():
    assert len(omop.CDM_TABLES) == len(set(omop.CDM_TABLES)) == 39
    assert omop.is_complete_catalog(omop.CDM_TABLES, omop.cdm_schema("person").names)
    assert not omop.is_complete_catalog(omop.CDM_TABLES[1:], omop.cdm_schema("person").names)
    assert ("note_nlp", "note_id", "note", "note_id") in omop.foreign_keys()


def test_generated_answers_have_the_closed_form_count(spark):
    rows = synthetic.synthetic_answers(spark.range(100_003))
    counts = {r.d: r["count"] for r in rows.groupBy(synthetic.decision_of(F.col("answer_state")).alias("d")).count().collect()}
    assert counts["PUBLISH"] == 3 * (100_003 // 6) + min(100_003 % 6, 3)
    assert rows.select("clinical_event_id").distinct().count() == 100_003


def test_decision_plan_keeps_answers_unshuffled(small):
    plan = event_decisions(small)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    # Mapping entries are counted and broadcast, one join per scope, which carries the entry's body;
    # the answers never cross the network.
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 3
    narrow = mapping.resolve(eav_canonical(small), event_entries(small)).select("event_id", "resolution")
    scan = [line for line in narrow._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
    # Resolving needs neither the answer's value nor its payload, so they are not read.
    assert scan and "value" not in scan[0] and "props" not in scan[0]


def test_new_paths_lie_in_the_shared_folder(spark):
    assert fresh_path(spark, "x").startswith(shared_dir(spark))
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


CHECKED = ["e1_answer_state", "f1_resolve_mappings", "h2_decide", "k1_coverage", "d2_fingerprint_forms", "e14_canonicalize_structured", "e14_structured_errors", "i5_resolve_id_collisions", "a3_read_fhir_responses", "a5_read_structured_xml", "m4_trace"]


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    base = duckdb.connect()
    base.execute("SET TimeZone='UTC'")
    for table in registry.TABLES:
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small.folder}/{table}.parquet'")
    result = base.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    want = sorted(str(tuple(f"{v:.9g}" if isinstance(v, float) else v for v in row)) for row in result.fetchall())
    df = registry.queries()[name](spark, small.folder).select(*columns)
    got = sorted(str(tuple(f"{v:.9g}" if isinstance(v, float) else v for v in row)) for row in df.collect())
    assert got == want
