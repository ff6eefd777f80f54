"""Exact decimals against Python's, and conditions in document order."""

import json
import random
from decimal import Decimal, getcontext

from pyspark.sql import functions as F

from formloom.functions import answers, exact
from formloom.operators.standardize import convert_unit
from formloom.session import local_table
from formloom.sources import fhir

getcontext().prec = 200


def test_products_and_sums_are_exact_or_out_of_reach(spark):
    rnd = random.Random(4)

    def text():
        digits = "".join(rnd.choice("0123456789") for _ in range(rnd.randint(1, 22)))
        at = rnd.randint(0, len(digits))
        sign = rnd.choice(["", "-", "+"])
        return sign + digits[:at] + rnd.choice([".", ""]) + digits[at:] + rnd.choice(["", "", "e-7", "E3", "e+12"])

    odd = ["1e-10", "0", "-0.000", ".5", "5.", "1e400", "abc", "", "1.2.3", "99999999999999999999999999999999999999", "1e37", "1e-37", "NaN"]
    rows = [(i, rnd.choice(odd) if rnd.random() < 0.2 else text(), rnd.choice(odd) if rnd.random() < 0.2 else text()) for i in range(800)]
    table = local_table(spark, rows, "i int, a string, b string")
    a, b = exact.number(F.col("a")), exact.number(F.col("b"))
    found = table.select("i", exact.plain(a).alias("a"), exact.plain(b).alias("b"), exact.plain(exact.multiply(a, b)).alias("m"), exact.plain(exact.add(a, b)).alias("s")).collect()

    def value(t):
        try:
            d = Decimal(t)
            return d if d.is_finite() else None
        except ArithmeticError:
            return None

    def size(d):
        """Digits before and after the point."""
        _, digits, exponent = d.as_tuple()
        return max(len(digits) + exponent, 1), max(-exponent, 0)

    seen = 0
    for r in found:
        x, y = value(rows[r.i][1]), value(rows[r.i][2])
        for got, want in ((r.a, x), (r.b, y), (r.m, None if None in (x, y) else x * y), (r.s, None if None in (x, y) else x + y)):
            assert want is not None or got is None
            if got is not None:
                assert Decimal(got) == want and not (got.endswith("0") and "." in got), (rows[r.i], got)
                seen += 1
        near = [d for d in (x, y) if d is not None and sum(size(d)) <= 18]
        assert len(near) < 2 or None not in (r.a, r.b, r.m, r.s), rows[r.i]
    assert seen > 1200


def test_small_multipliers_and_many_decimals(spark):
    rows = [("0.000000000012", "1", "0"), ("7", "0.0000000001", "0"), ("1.5", "2", "0.000000000001"), ("x", "1", "0"), ("1e29", "1000", "0"), ("12.5", "1.8", "32")]
    df = local_table(spark, rows, "v string, m string, o string")
    value = F.struct(F.lit("str").alias("t"), F.col("v").alias("s"), F.lit(None).cast("decimal(38,9)").alias("num"))
    found = [r.c and r.c.s for r in df.select(convert_unit(value, F.col("m"), F.col("o")).alias("c")).collect()]
    assert found == ["0.000000000012", "0.0000000007", "3.000000000001", None, None, "54.500000000"]
    typed = df.select(answers.coerce(F.lit("num"), F.col("v"), F.lit("decimal")).alias("c"), answers.coerce(F.lit("num"), F.col("v"), F.lit("integer")).alias("i")).collect()
    assert typed[0].c.s == "0.000000000012" and typed[0].i is None and typed[1].i.num == 7 and typed[3].c is None
    close = spark.range(1).select(
        answers.condition_holds(answers.coerce(F.lit("num"), F.lit("0.0000000001"), F.lit("decimal")), F.lit("eq"), answers.coerce(F.lit("num"), F.lit("0"), F.lit("decimal"))).alias("e"),
        answers.condition_holds(answers.coerce(F.lit("num"), F.lit("2.50"), F.lit("decimal")), F.lit("eq"), answers.coerce(F.lit("num"), F.lit("2.5"), F.lit("decimal"))).alias("f"),
    ).first()
    assert (close.e, close.f) == (False, True)


def walk(items, parent, known, out):
    """The definition: a level's items are known before any of them is looked at, their children after them."""
    for raw in items:
        known[raw["linkId"]] = f"{parent}/{raw['linkId']}" if parent else raw["linkId"]
    for raw in items:
        path = f"{parent}/{raw['linkId']}" if parent else raw["linkId"]
        for when in raw.get("enableWhen", []):
            out.append((path, when["question"], known.get(when["question"])))
        walk(raw.get("item", []), path, known, out)


def test_conditions_see_what_a_walk_has_met(spark):
    rnd = random.Random(8)

    def tree(depth):
        items = []
        for _ in range(rnd.randint(1, 4)):
            item = {"linkId": rnd.choice("abcdefgh"), "type": "group"}
            if item["linkId"] in {i["linkId"] for i in items}:
                continue
            if rnd.random() < 0.6:
                item["enableWhen"] = [{"question": rnd.choice("abcdefgh"), "operator": "exists", "answerBoolean": True}]
            if depth:
                item["item"] = tree(depth - 1)
            items.append(item)
        return items

    forms = [tree(3) for _ in range(40)]
    docs = local_table(spark, [(f"k{n}", json.dumps({"resourceType": "Questionnaire", "id": f"q{n}", "item": f})) for n, f in enumerate(forms)], "object_key string, content string")
    _, items, errors = fhir.read_questionnaires(docs)
    resolved = {(r.object_key, r.path): r.s for r in items.filter("size(conditions) > 0").select("object_key", "path", F.col("conditions")[0]["source_item_path"].alias("s")).collect()}
    failed = {(r.object_key, r.path) for r in errors.collect()}
    for n, form in enumerate(forms):
        out = []
        walk(form, "", {}, out)
        for path, _, source in out:
            if source is None:
                assert (f"k{n}", path) in failed
            else:
                assert resolved[(f"k{n}", path)] == source
    whole_forms, whole_items, _ = fhir.read_questionnaires(docs, whole=True)
    bad = {k for k, _ in failed}
    assert {r.object_key for r in whole_forms.collect()} == {f"k{n}" for n in range(40)} - bad and not {r.object_key for r in whole_items.collect()} & bad


def test_a_conversion_reads_its_numbers_once(spark):
    table = local_table(spark, [("num", "12.5", Decimal("12.5"))], f"t string, s string, num {answers.NUMBER}")
    value = F.struct("t", "s", "num")
    found = table.select(convert_unit(value, F.lit("0.0000000001"), F.lit("0.000000000001"))["s"].alias("s"))
    assert found.first()["s"] == "0.000000001251"
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # The value by its text or its number, the multiplier and the offset.
    assert plan.count(exact._NUMBER) <= 2 * 4
