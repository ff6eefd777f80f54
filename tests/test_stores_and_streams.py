"""Hash trees, deltas of membership, keyed pages, vocabulary part files and windows in append mode."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from formloom.operators import catalog, membership, merkle
from formloom.session import local_table
from formloom.sources import files, store
from formloom.streaming import counters, ingest


def members(spark, names):
    return local_table(spark, list(names.items()), "name string, digest string")


def test_one_formula_for_all_sizes(spark):
    """1,024 and 1,025 members, order and partitioning, refreshing against building anew, and what differs."""
    full = {f"m{i}": f"{i:064x}" for i in range(1025)}
    less = {n: d for n, d in full.items() if n != "m1024"}
    trees = {n: merkle.build(members(spark, m), "name", "digest", depth=2) for n, m in (("full", full), ("less", less))}
    roots = {n: merkle.root(t).first() for n, t in trees.items()}
    assert (roots["full"].members, roots["less"].members) == (1025, 1024) and roots["full"].checksum != roots["less"].checksum
    again = merkle.build(members(spark, dict(reversed(full.items()))).repartition(7), "name", "digest", depth=2)
    assert merkle.root(again).first().checksum == roots["full"].checksum
    touched = local_table(spark, [("m1024",)], "name string")
    grown = merkle.refresh(trees["less"], members(spark, full), touched, "name", "digest", depth=2)
    assert grown.exceptAll(trees["full"].select(*merkle.TREE)).isEmpty() and merkle.root(grown).first() == roots["full"]
    shrunk = merkle.refresh(trees["full"], members(spark, less), touched, "name", "digest", depth=2)
    assert merkle.root(shrunk).first() == roots["less"]
    leaves = merkle.differences(trees["full"], trees["less"], depth=2)
    assert leaves.count() == 1
    found = merkle.differing_members(leaves, members(spark, full), members(spark, less), "name", "digest", depth=2).collect()
    assert [(r.name, r.second_digest) for r in found] == [("m1024", None)]
    assert merkle.differences(trees["full"], again, depth=2).isEmpty()
    nothing = merkle.build(members(spark, {}), "name", "digest", depth=2)
    assert merkle.root(nothing).first().members == 0 and merkle.differences(nothing, trees["less"], depth=2).count() == trees["less"].filter("depth = 2").count()


def test_members_follow_their_history(spark):
    """Random adding and removing along a chain with a side branch, with and without snapshots."""
    rnd = random.Random(5)
    state, rows, chain, wanted = {}, [], [("r0", None)], {}
    for n in range(8):
        added = {f"e{rnd.randrange(20)}": rnd.randrange(100) for _ in range(4)}
        removed = {e for e in state if rnd.random() < 0.3} - set(added)
        rows += [(f"r{n}", e, "observation", i, "ADD") for e, i in added.items()] + [(f"r{n}", e, "observation", 0, "REMOVE") for e in removed]
        state = {e: i for e, i in {**state, **added}.items() if e not in removed}
        wanted[f"r{n}"] = dict(state)
        if n:
            chain.append((f"r{n}", f"r{n - 1}"))
    chain.append(("side", "r3"))
    rows.append(("side", "only", "note", 7, "ADD"))
    deltas = local_table(spark, rows, "release_id string, clinical_event_id string, omop_table string, omop_fact_id bigint, change string")
    history = membership.History(local_table(spark, chain, "release_id string, parent_release_id string"), deltas, deltas.drop("change").limit(0))
    assert membership.snapshot_due(history, "r5", 3)
    short = membership.with_snapshot(history, "r4")
    assert not membership.snapshot_due(short, "r5", 3)
    for h in (history, short):
        for name in ("r0", "r4", "r7"):
            assert {r.clinical_event_id: r.omop_fact_id for r in membership.members_of(h, name).collect()} == wanted[name]
        assert {r.clinical_event_id for r in membership.members_of(h, "side").collect()} == {*wanted["r3"], "only"}
    # What lies before a snapshot is not read any more.
    recent = membership.History(short.releases, deltas.filter("release_id NOT IN ('r0', 'r1', 'r2', 'r3')"), short.snapshots)
    assert {r.clinical_event_id: r.omop_fact_id for r in membership.members_of(recent, "r7").collect()} == wanted["r7"]


def test_pages_by_key(spark):
    rnd = random.Random(3)
    rows = sorted(((rnd.randrange(9), i) for i in range(500)), key=lambda r: (-r[0], r[1]))
    pages = catalog.paged(local_table(spark, rows[::-1], "a int, b int").repartition(6), [("a", False), ("b", True)])
    for offset in (0, 7, 250, 495, 500, 900):
        got = [(r.a, r.b, r.total) for r in catalog.page_at(pages, offset, 20).collect()]
        assert got == [(a, b, 500) for a, b in rows[offset : offset + 20]]
    assert [(r.a, r.b) for r in catalog.page_after(pages, rows[249], 20).collect()] == rows[250:270]
    plan = catalog.page_after(pages, rows[249], 20)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(a" in plan
    empty = catalog.paged(local_table(spark, [], "a int, b int"), [("a", False), ("b", True)])
    assert catalog.page_at(empty, 0).count() == 0


def test_every_part_file_needs_its_header(spark, tmp_path):
    header = "\t".join(files.VOCABULARY_FILES["DOMAIN.csv"])
    folder = tmp_path / "DOMAIN.csv"
    folder.mkdir()
    (folder / "part-0.csv").write_text(f"﻿{header}\nA\tName A\t1\n")
    (folder / "part-1.csv").write_text(f"{header}\nB\tName B\t2\n")
    rows, errors = files.read_vocabulary(spark, str(tmp_path), "DOMAIN.csv")
    assert {r[0] for r in rows.collect()} == {"A", "B"} and errors.count() == 0
    (folder / "part-2.csv").write_text(f"C\tName C\t3\n{header}\n")
    with pytest.raises(ValueError, match="part-2"):
        files.read_vocabulary(spark, str(tmp_path), "DOMAIN.csv")


def arrivals(spark, folder, batches):
    """Files in the order they arrive."""
    import os

    for n, batch in enumerate(batches):
        rows = [(t, bad, "s") for t, bad in batch]
        local_table(spark, rows, "ts timestamp, is_error boolean, stage string").coalesce(1).write.parquet(f"{folder}/in{n}")
        for name in os.listdir(f"{folder}/in{n}"):
            os.utime(f"{folder}/in{n}/{name}", (1_700_000_000 + n * 10,) * 2)
    schema = spark.read.parquet(f"{folder}/in0").schema
    return ingest.file_stream(spark, f"{folder}/in*", schema, files_per_trigger=1).withWatermark("ts", "2 hours")


@pytest.mark.parametrize("cuts", [1, 4, 9])
def test_windows_do_not_depend_on_the_split(spark, tmp_path, cuts):
    rnd = random.Random(7)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    events = sorted((start + dt.timedelta(minutes=rnd.randrange(60 * 96)), rnd.random() < (0.7 if 30 < i % 96 < 60 else 0.1)) for i in range(900))
    size = -(-len(events) // cuts)
    stream = arrivals(spark, str(tmp_path), [events[i : i + size] for i in range(0, len(events), size)])
    closed = counters.outcome_counters(stream.select("ts", "stage", F.col("is_error").cast("string").alias("outcome"), F.lit("none").alias("failure_code")), "1 hour")
    progress = ingest.drain(closed, f"{tmp_path}/out", f"{tmp_path}/state")
    mark = events[-1][0] - dt.timedelta(hours=2)
    whole = local_table(spark, [(t, bad, "s") for t, bad in events], "ts timestamp, is_error boolean, stage string")
    batch = counters.outcome_counters(whole.select("ts", "stage", F.col("is_error").cast("string").alias("outcome"), F.lit("none").alias("failure_code")), "1 hour")
    want = batch.filter(F.col("window_start") + F.expr("INTERVAL 1 HOUR") <= F.lit(mark))
    found = spark.read.parquet(f"{tmp_path}/out")
    assert found.count() == want.count() > 50 and found.exceptAll(want.select(*found.columns)).isEmpty()
    assert ingest.late_rows(progress) == 0 and ingest.state_rows(progress)[-1] <= 12
    alerts = ingest.drain_to_table(counters.alert_stream(stream, "6 hours", "1 hour", "3 hours", 3, 0.25), "alerts")
    rates = counters.error_rates(whole, "6 hours", "1 hour").filter("ratio > 0.25 AND w.end <= '%s'" % mark.strftime("%Y-%m-%d %H:%M:%S"))
    breaching = {r.e for r in rates.select(F.col("w.end").alias("e")).collect()}
    hour = dt.timedelta(hours=1)
    expected = {e for e in breaching if {e - hour, e - 2 * hour} <= breaching}
    assert {r.fired_at for r in alerts.collect()} == expected and expected


def test_late_rows_are_counted(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    day = dt.timedelta(days=1)
    stream = arrivals(spark, str(tmp_path), [[(start, False)], [(start + day, False)], [(start + 2 * day, False)], [(start, True), (start + 2 * day, True)]])
    closed = counters.latency_p95(stream.select("ts", "stage", F.col("is_error").cast("int").alias("v")), "1 hour", "stage", "v")
    assert ingest.late_rows(ingest.drain(closed, f"{tmp_path}/out", f"{tmp_path}/state")) == 1
    assert [r.samples for r in spark.read.parquet(f"{tmp_path}/out").orderBy("window_start").collect()] == [1, 1]


def test_an_empty_store_reads_with_a_schema(spark, tmp_path):
    schema = local_table(spark, [], "event_id string, establishment_id string, batch_id string").schema
    assert store.read_canonical(spark, f"{tmp_path}/nothing", site="a", schema=schema).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.read_canonical(spark, f"{tmp_path}/nothing")
