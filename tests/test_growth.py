"""Work that must not grow faster than its input: what loops are given, what is broadcast, what is shuffled."""

import pytest
from pyspark.sql import functions as F

from formloom.operators import canonical, lineage, membership, ordering, quality, releases
from formloom.plans import answers, omop, sources
from formloom.plans import releases as release_plans
from formloom.session import cut, local_table
from formloom.sources import fhir, nesting, structured

FORM = ["form_id", "form_version"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_layers_go_before_chains_are_contracted(spark, monkeypatch):
    seen = []

    def watched(edges):
        seen.append(edges.count())
        return whole(edges)

    whole = lineage.reaches_cycle
    monkeypatch.setattr(lineage, "reaches_cycle", watched)
    tree = [(f"raw{i}", f"c{i % 20}") for i in range(100)] + [(f"c{i}", f"m{i % 4}") for i in range(20)] + [(f"m{i}", "o") for i in range(4)]
    tree += [("o", "cat"), ("cat", "o"), ("cat", "end"), ("o", None), (None, "o")]
    edges = local_table(spark, tree, "source string, target string")
    nodes = local_table(spark, [(n,) for n in ("o", "o", "cat", None, *[f"raw{i}" for i in range(100)])], "node_id string")
    found = sorted((r["finding"], r["node_id"] or "") for r in lineage.graph_findings(nodes, edges).collect())
    missing = ["", "end", *[f"c{i}" for i in range(20)], *[f"m{i}" for i in range(4)]]
    assert found == sorted([("CYCLE", "o"), ("CYCLE", "cat"), ("DUPLICATE_NODE", "o"), *[("DANGLING_EDGE", n) for n in missing]])
    assert max(seen) == 2


@pytest.mark.parametrize("module", [lineage, releases])
def test_loops_broadcast_nothing(spark, monkeypatch, module):
    plans = []

    def watched(df, label="cut", codec=None):
        plans.append(plan_of(df))
        return cut(df, label, codec)

    monkeypatch.setattr(module, "cut", watched)
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(12)]
    if module is lineage:
        edges = local_table(spark, [*pairs, ("n12", "n4")], "source string, target string")
        nodes = local_table(spark, [(f"n{i}",) for i in range(13)], "node_id string")
        found = lineage.graph_findings(nodes, edges).collect()
        assert sorted(r["node_id"] for r in found) == sorted(f"n{i}" for i in range(4, 13))
    else:
        rows = local_table(spark, pairs, "release_id string, parent_release_id string")
        found = releases.release_ancestry(rows, "n0").collect()
        assert [(r["release_id"], r["depth"]) for r in found] == [(f"n{i}", i) for i in range(12)]
    assert plans and not any("Broadcast" in plan for plan in plans)


def test_trace_leaves_out_edges_nobody_comes_by(spark, monkeypatch):
    kept = []

    def watched(df, label="cut", codec=None):
        done = cut(df, label, codec)
        if label == "steps":
            kept.append(done.count())
        return done

    monkeypatch.setattr(lineage, "cut", watched)
    edges = local_table(spark, [*[(f"raw{i}", "c") for i in range(50)], ("c", "m"), ("m", "o")], "source string, target string")
    starts = local_table(spark, [("c",), ("raw7",)], "node_id string")
    rows = sorted(tuple(r) for r in lineage.trace(edges, starts, "downstream").collect())
    assert rows == [("c", "c", 0), ("c", "m", 1), ("c", "o", 2), ("raw7", "c", 1), ("raw7", "m", 2), ("raw7", "o", 3), ("raw7", "raw7", 0)]
    assert kept[-1] == 3


ITEMS = [
    ("f", "1", "A", "string", None, "EUR", []),
    ("f", "1", "B", "string", None, None, [("A", "eq", ("str", "x", None))]),
    ("f", "1", "G", "group", "G", None, []),
    ("f", "1", "G/P", "string", "G", "kg", [("A", "eq", ("str", "x", None))]),
    ("f", "1", "G/Q", "string", "G", None, [("G/P", "eq", ("str", "p", None))]),
]
RESPONSE = "establishment_id string, response_id string, form_id string, form_version string"
ANSWER = RESPONSE + ", item_path string, group_instance string, raw_type string, raw_value string, unit string, pos bigint, data_type string"


def dense_case(spark):
    def given(site, response, path, instance, value, pos):
        return (site, response, "f", "1", path, instance, "str", value, "g", pos, "string")

    items = local_table(spark, ITEMS, answers.ITEM_SCHEMA)
    responses = local_table(spark, [("s", "r1", "f", "1"), ("s", "r1", "f", "1"), ("s", None, "f", "1"), ("s", "r3", "none", "1")], RESPONSE)
    rows = [
        given("s", "r1", "A", None, "x", 1), given("s", "r1", "G/P", "G:1", "p", 2), given("s", "r1", "G/Q", "G:2", "q", 3),
        given("s", "r1", "G/Q", "G:2", "again", 4), given("s", "r1", "A", "G:9", "off", 5), given("s", "r1", "G/P", None, "off", 6),
        given("s", None, "A", None, "x", 7), given("s", None, "G/P", "G:1", "p", 8), given("s", "r4", "A", None, "x", 9),
    ]
    return responses, local_table(spark, rows, ANSWER), items


def test_densify_shuffles_answers_once(spark):
    responses, given, items = dense_case(spark)
    dense = canonical.densify(responses, given.drop("data_type"), items, FORM)
    on_key = [line for line in plan_of(dense).splitlines() if "Exchange hashpartitioning" in line and "_key" in line]
    assert len(on_key) <= 2  # answers, and responses if they are not broadcast
    rows = sorted((r["response_id"] or "", r["item_path"], r["group_instance"] or "", r["present"], r["raw_value"] or "", r["unit"] or "") for r in dense.collect())
    one = [
        ("r1", "A", "", True, "x", "g"), ("r1", "B", "", False, "", ""),
        ("r1", "G/P", "G:1", True, "p", "g"), ("r1", "G/Q", "G:1", False, "", ""),
        ("r1", "G/P", "G:2", False, "", "kg"), ("r1", "G/Q", "G:2", True, "q", "g"), ("r1", "G/Q", "G:2", True, "again", "g"),
    ]
    assert rows == sorted([*one, *one, ("", "A", "", True, "x", "g"), ("", "B", "", False, "", "")])


def test_display_state_shuffles_rows_once(spark):
    responses, given, items = dense_case(spark)
    typed = cut(canonical.type_answers(given).drop("data_type"), "typed")
    dense = cut(canonical.densify(responses, typed, items, FORM), "dense")
    shown = canonical.display_state(dense, typed, items, FORM)
    moved = [line for line in plan_of(shown).splitlines() if "Exchange hashpartitioning" in line and ("_key" in line or "response_id" in line)]
    assert len(moved) == 1
    rows = {(r["response_id"], r["item_path"], r["group_instance"]): r["enabled"] for r in shown.collect()}
    # Without a whole key nothing is seen across instances, only what lies in the same one.
    assert rows == {
        ("r1", "A", None): True, ("r1", "B", None): True, ("r1", "G/P", "G:1"): True, ("r1", "G/Q", "G:1"): True,
        ("r1", "G/P", "G:2"): True, ("r1", "G/Q", "G:2"): False, (None, "A", None): True, (None, "B", None): True,
    }
    assert shown.count() == dense.count()


def test_order_answers_are_spread_after_the_joins(small):
    made = answers._site_answers(small)
    site = answers.order_responses(small).select("establishment_id", "response_id", *FORM)
    plain = small.view("b_order_answers").join(site, "response_id").select(*made.columns)
    assert made.exceptAll(plain).isEmpty() and plain.exceptAll(made).isEmpty()
    # In the plan of the lines, which comes first, nothing is exchanged above the spreading.
    assert plan_of(made).index("Generate explode") < plan_of(made).index("Exchange")


def test_documents_are_made_by_many_tasks(spark, small):
    made = (sources.questionnaires, sources.asking_questionnaires, sources.json_definitions, sources.xml_definitions)
    assert small.table("part").rdd.getNumPartitions() == 1
    for documents in made:
        sizes = [n for n in documents(small).rdd.glom().map(len).collect() if n]
        assert len(sizes) > 1 and sum(sizes) == small.table("part").count()


def test_questions_are_resolved_once_where_whole_documents_are_refused(spark):
    def asked(link, question):
        return f'{{"linkId":"{link}","type":"string","enableWhen":[{{"question":"{question}","operator":"=","answerString":"x"}}]}}'

    def form(*items):
        return '{"resourceType":"Questionnaire","id":"q","item":[{"linkId":"A","type":"string"},' + ",".join(items) + "]}"

    rows = [("good", form(asked("B", "A"))), ("bad", form(asked("B", "NONE"))), (None, form('{"linkId":"B","type":"odd"}')), ("mixed", form(asked("B", "A"))), ("mixed", "{}")]
    forms, items, errors = fhir.read_questionnaires(local_table(spark, rows, "object_key string, content string"), whole=True)
    # Without a key a document cannot be refused as a whole; with a key, what shares it goes too.
    assert sorted(((r["object_key"] or "", r["path"]) for r in items.collect())) == [("", "A"), ("good", "A"), ("good", "B")]
    assert sorted(r["object_key"] or "" for r in forms.collect()) == ["", "good"]
    assert errors.count() == 3
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lastvalue") + plan.count("last(path") <= 2


def test_levels_are_those_of_a_walk(spark):
    marks = ["", "s]", "ss]]", "sas]]]", "aaaas]]]]]", "aaaa]]]]", "ss]s]]]s", "]]s", "sss", "s" * 9 + "]" * 9, "as]]sas]s]]]", "a]sa]sas]]]]"]
    rows = local_table(spark, [(m,) for m in marks], "m string").select("m", nesting._deepest(F.col("m")).alias("n"))

    def walked(text):
        stack, most = [], 0
        for mark in text:
            stack = stack[:-1] if mark == "]" else [*stack, mark]
            most = max(most, stack.count("s"))
        return most

    assert {r["m"]: r["n"] for r in rows.collect()} == {m: walked(m) for m in marks}


def test_only_repeating_items_are_numbered(spark, monkeypatch):
    seen = []

    def watched(rows, *given, **named):
        seen.extend(r["item_path"] for r in rows.collect())
        return whole(rows, *given, **named)

    whole = canonical.group_instances
    monkeypatch.setattr(canonical, "group_instances", watched)
    group = '{"linkId":"G","item":[{"linkId":"A","answer":[{"valueString":"x"}]},{"linkId":"A"}]}'
    body = f'{{"resourceType":"QuestionnaireResponse","id":"r","item":[{group},{{"linkId":"B","answer":[{{"valueInteger":3}}]}},{group}]}}'
    documents = local_table(
        spark, [("s", "p", "k", "f", "1", body)], "establishment_id string, patient_pseudonym string, object_key string, form_id string, form_version string, content string"
    )
    items = local_table(spark, [("f", "1", "G", True), ("f", "1", "G/A", False), ("f", "1", "B", False)], "form_id string, form_version string, path string, repeats boolean")
    rows = fhir.read_responses(documents, items, FORM)[1].collect()
    found = sorted((r["item_path"], r["group_instance"] or "", r["answer"]["s"] if r["answer"] else "", r["json_pointer"]) for r in rows)
    assert found == [
        ("B", "", "3", "/item/1/answer/0"),
        ("G/A", "G:0", "", "/item/0/item/1"), ("G/A", "G:0", "x", "/item/0/item/0/answer/0"),
        ("G/A", "G:1", "", "/item/2/item/1"), ("G/A", "G:1", "x", "/item/2/item/0/answer/0"),
    ]
    assert seen == ["G", "G"]


def test_blocks_are_only_joined_where_a_group_has_several(spark, monkeypatch):
    joins = []

    def watched(*given):
        joins.append(given)
        return whole(*given)

    whole = ordering.null_safe_join
    monkeypatch.setattr(ordering, "null_safe_join", watched)
    rows = local_table(spark, [(k, n * 2) for k in ("a", None) for n in range(5)], "k string, n int")
    for block, times in ((64, 0), (4, 1)):
        found = ordering.block_ordinal(rows, ["k"], "n", "idx", block=block).collect()
        assert sorted((r["k"] or "", r["n"], r["idx"]) for r in found) == sorted((k, n * 2, n) for k in ("a", "") for n in range(5))
        assert len(joins) == times


def test_xml_responses_are_parsed_once(spark):
    text = '<form-response schema-version="structured/1.0" response-id="r" authored-at="2020-01-01T00:00:00Z"><answer item-path="A"><value>1</value></answer></form-response>'
    documents = cut(local_table(spark, [("s", "k", text), ("s", "l", "<x")], "establishment_id string, object_key string, content string"))
    responses, given, errors = structured.read_xml_responses(documents, ["establishment_id"])
    assert not any("xml" in plan_of(df).lower().replace("xml-responses", "").replace("application/xml", "") for df in (responses, given, errors))
    assert [(r["response_id"], r["raw_value"]) for r in given.collect()] == [("r", "1")]
    assert [(r["object_key"], r["error"]) for r in errors.collect()] == [("l", "INVALID_STRUCTURED_XML")]
    assert responses.count() == 1


def test_cdm_tables_are_read_from_identified_facts(small):
    tables = omop.produced(small)
    assert not any("Join" in plan_of(df) for df in tables.values())
    assert tables["measurement"].count() > 0


def test_answers_are_dealt_before_they_are_judged(small):
    assert "REPARTITION_BY_NUM" in plan_of(answers.event_decisions(small))


def test_structured_answers_are_gathered_before_windows(spark, small):
    """Windows run over instances, and once over answers where display states are declared."""
    rows = answers.order_responses(small), answers.order_answers(small), answers.order_items(small), answers.FORM
    assert plan_of(canonical.canonicalize_structured(*rows)).split("== Initial Plan ==")[0].count("Window [") == 1
    declared = rows[0], answers.faulty_answers(small), *rows[2:]
    assert plan_of(canonical.canonicalize_structured(*declared)).split("== Initial Plan ==")[0].count("Window [") == 2


def test_replayed_answers_are_judged_once_and_dealt(spark, small, monkeypatch):
    records = cut(quality.quarantine_records(answers.stored_decisions(small), F.col("authored_at")), "records")
    _, after = quality.replay_quarantine(answers.eav_canonical(small), records, answers.event_entries(small, answers.REPLAY_ENTRIES))
    assert "events.parquet" not in plan_of(after)
    given = []
    monkeypatch.setattr(membership, "replay", lambda *args: given.append(args[4]))
    release_plans.replayed(small)
    assert "RoundRobinPartitioning" in plan_of(given[0])


def test_compact_traces_are_told_apart_by_hubs(spark):
    """Behind the walk no row is shuffled again, neither by its start nor by the starts themselves."""
    edges = [(f"a{i}", "h") for i in range(20)] + [("h", f"q{i}") for i in range(20)] + [(f"b{i}", "unmet") for i in range(20)] + [(None, "q0")]
    table = local_table(spark, edges, "source string, target string")
    starts = local_table(spark, [*[(f"q{i}",) for i in range(20)], (None,)], "node_id string")
    found = lineage.compact_trace(table, starts, hub=10)
    assert "Exchange hashpartitioning" not in plan_of(found)
    rows = [("q0", None, 1, False)] + [(f"q{i}", f"q{i}", 0, False) for i in range(20)] + [(f"q{i}", "h", 1, True) for i in range(20)]
    rows += [("h", "h", 0, True)] + [("h", f"a{i}", 1, False) for i in range(20)]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, rows))


def test_declared_states_are_compared_by_instance(small):
    """No window runs over the single answers, and lists are built from sorted rows without hashing them."""
    rows = answers.order_responses(small), answers.faulty_answers(small), answers.order_items(small), answers.FORM
    plan = plan_of(canonical.canonicalize_structured(*rows)).split("== Initial Plan ==")[0]
    assert plan.index("Generate explode") < plan.index("Window [")
    gathering = [line for line in plan.splitlines() if "collect_list(_given" in line]
    assert len(gathering) == 1 and "SortAggregate" in gathering[0]


@pytest.mark.parametrize("behavior", ["all", "any"])
def test_conditions_of_any_number_hold(spark, behavior):
    """The first conditions are compiled and the others walked; both see the earlier of own and outer answers."""
    def number(n):
        return ("num", str(n), n)

    many = [("A", "eq", ("str", "x", None)), ("G/P", "gte", number(2)), ("G/P", "lt", number(5)), ("A", "exists", ("bool", "true", 1))]
    items = [("f", "1", "A", "string", None, None, []), ("f", "1", "G", "group", "G", None, []), ("f", "1", "G/P", "decimal", "G", None, [])]
    items += [("f", "1", f"G/Q{n}", "string", "G", None, many[:n]) for n in range(5)]
    made = local_table(spark, items, answers.ITEM_SCHEMA)
    cases = [(f"r{a}{p}", a, p) for a in ("x", "y", None) for p in (1, 3, 7, None)]
    responses = local_table(spark, [("s", r, "f", "1", "SIGNED") for r, *_ in cases], RESPONSE + ", lifecycle_status string")
    given = [("s", r, "f", "1", "A", None, "str", a, None, 1) for r, a, _ in cases if a]
    given += [("s", r, "f", "1", "G/P", "G:1", "num", str(p), None, 2) for r, _, p in cases if p]
    given += [("s", r, "f", "1", "G/Q0", "G:1", "str", "q", None, 3) for r, *_ in cases]
    given = local_table(spark, given, ANSWER.replace(", data_type string", ""))
    found = canonical.canonicalize_structured(responses, given, made, FORM, behavior).filter("item_path LIKE 'G/Q%'").collect()
    fold = all if behavior == "all" else any

    def shown(a, p, n):
        return n == 0 or fold([a == "x", p is not None and p >= 2, p is not None and p < 5, a is not None][:n])

    assert {(r["response_id"], r["item_path"]): r["enabled"] for r in found} == {(r, f"G/Q{n}"): shown(a, p, n) for r, a, p in cases for n in range(5)}


def test_declared_state_of_a_doubled_answer_and_of_several_roots(spark):
    items = [("f", "1", "A", "string", None, None, []), ("f", "1", "G", "group", "G", None, []), ("f", "1", "G/P", "string", "G", None, [("A", "eq", ("str", "x", None))])]
    items += [("f", "1", "H", "group", "H", None, []), ("f", "1", "H/P", "string", "H", "kg", []), ("f", "1", "H/Q", "string", "H", None, [])]
    made = local_table(spark, items, answers.ITEM_SCHEMA)
    responses = local_table(spark, [("s", r, "f", "1", "SIGNED") for r in ("ok", "clash", "double", "none")], RESPONSE + ", lifecycle_status string")
    rows = [("ok", "A", None, "x", 1, True), ("ok", "G/P", "I:1", "p", 2, True), ("ok", "H/Q", "I:1", "q", 3, None)]
    rows += [("clash", "A", None, "y", 1, None), ("clash", "G/P", "I:1", "p", 2, True), ("clash", "G/P", "I:2", "p", 3, False)]
    rows += [("double", "A", None, "y", 1, None), ("double", "A", None, "x", 0, None), ("double", "G/P", "I:1", "p", 2, True)]
    given = local_table(
        spark, [("s", r, "f", "1", path, instance, "str", v, None, pos, d) for r, path, instance, v, pos, d in rows],
        ANSWER.replace("data_type string", "declared_enabled boolean"),
    )
    stream = cut(canonical.canonical_stream(responses, given, made, FORM), "stream")
    wrong = {(r["response_id"], r["item_path"], r["group_instance"], r["reason"]) for r in canonical.canonical_errors(stream).collect()}
    assert wrong == {("clash", "G/P", "I:1", "CONDITIONAL_LOGIC_CONFLICT"), ("double", "A", None, "DUPLICATE_ANSWER")}
    kept = {(r["response_id"], r["item_path"], r["group_instance"], r["state"], r["unit"]) for r in stream.filter("NOT rejected").collect()}
    assert kept == {
        ("ok", "A", None, "PRESENT", None), ("ok", "G/P", "I:1", "PRESENT", None), ("ok", "H/Q", "I:1", "PRESENT", None),
        ("ok", "H/P", "I:1", "NOT_RECORDED", "kg"), ("none", "A", None, "NOT_RECORDED", None),
    }


def gathered_by(plan, column):
    return [line for line in plan.splitlines() if "Aggregate(" in line and f"collect_list({column}" in line]


def test_expected_answers_are_gathered_in_one_pass(spark):
    """Lists are built from sorted rows, and responses come with the answers instead of being joined."""
    items = [*ITEMS, ("f", "1", "H", "group", "H", None, []), ("f", "1", "H/P", "string", "H", None, []), ("f", "1", "H/Q", "string", "H", None, [])]
    made = local_table(spark, items, answers.ITEM_SCHEMA)
    responses = local_table(spark, [("s", "r1", "f", "1"), ("s", "r2", "f", "1")], RESPONSE)
    rows = [("r1", "G/P", "I:1"), ("r1", "H/Q", "I:1"), ("r1", "H/P", "I:2")]
    given = local_table(spark, [("s", r, "f", "1", path, instance, "str", "v", None, 1) for r, path, instance in rows], ANSWER.replace(", data_type string", ""))
    dense = canonical.densify(responses, given, made, FORM)
    lines = gathered_by(plan_of(dense), "_answer")
    assert len(lines) == 1 and "SortAggregate" in lines[0]
    assert not any("Join" in line and "response_id" in line for line in plan_of(dense).splitlines())
    found = sorted((r["response_id"], r["group_instance"] or "", r["item_path"], r["present"]) for r in dense.collect())
    outside = [(r, "", path, False) for r in ("r1", "r2") for path in ("A", "B")]
    first = [("r1", "I:1", "G/P", True), ("r1", "I:1", "G/Q", False), ("r1", "I:1", "H/P", False), ("r1", "I:1", "H/Q", True)]
    assert found == sorted([*outside, *first, ("r1", "I:2", "H/P", True), ("r1", "I:2", "H/Q", False)])


def test_display_conflicts_come_from_one_pass(spark):
    """Rows and named answers are gathered from sorted rows; of an answer given again the earliest is seen."""
    responses = local_table(spark, [("s", "r1", "f", "1"), ("s", "r2", "f", "1")], RESPONSE)
    rows = [("r1", "A", None, "y", 5), ("r1", "A", None, "x", 1), ("r1", "G/P", "G:1", "p", 2), ("r2", "A", None, "x", 5), ("r2", "A", None, "y", 1)]
    given = local_table(spark, [("s", r, "f", "1", path, instance, "str", v, None, pos, "string") for r, path, instance, v, pos in rows], ANSWER)
    items = local_table(spark, ITEMS, answers.ITEM_SCHEMA)
    typed = cut(canonical.type_answers(given).drop("data_type"), "typed")
    dense = cut(canonical.densify(responses, typed, items, FORM), "dense")
    shown = canonical.display_state(dense, typed, items, FORM)
    lines = gathered_by(plan_of(shown), "_row")
    assert len(lines) == 1 and "SortAggregate" in lines[0]
    wrong = canonical.display_conflicts(shown.withColumn("declared_enabled", F.lit(True)))
    assert [(r["response_id"], r["item_path"], r["group_instance"]) for r in wrong.collect()] == [("r2", "B", None)]
