"""Chat formatting and URL filtering, and the pipeline."""

import hashlib
import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from formloom.llm import bpe, chat_format, exact_dedup, queries, url_reputation
from formloom.session import local_table
from tests.llm.messy import LONG, documents
from tests.llm.test_groups import SPACE, brute_force
from tests.llm.test_texts import PATH, PlainBayes, check_pieces

SF = "/root/testdata/sf0.001"


def test_escape_is_reversible(spark):
    rnd = random.Random(8)
    parts = ["<", "[", "\\", "/", "s>", "INST]", "</s>", "[INST]", "[/INST]", "x", "\n", "<s>", "$1", "é"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat_format.escape(F.col("t")))
    for r in df.withColumn("u", chat_format.unescape(F.col("e"))).collect():
        assert r["u"] == r["t"]
        assert not re.search(r"</?s>|\[/?INST\]", r["e"])


def fold_by_hand(events):
    """The definition, event by event: a regeneration also ends all that was said below it."""
    messages = {}
    for seq, msg, kind, role, text in sorted(events):
        if kind == "regenerate":
            messages = {m: x for m, x in messages.items() if m <= msg}
        entry = messages.setdefault(msg, [role, ""])
        if kind in ("edit", "regenerate"):
            entry[1] = ""
        entry[1] += text or ""
    return [(m, *messages[m]) for m in sorted(messages)]


def test_fold_of_deltas_edits_and_regenerations(spark):
    rnd = random.Random(9)
    rows, want = [], {}
    for conv in range(40):
        events, seq = [], 0
        for msg in range(rnd.randint(1, 6)):
            role = "user" if msg % 2 == 0 else "assistant"
            for _ in range(rnd.randint(1, 4)):
                events.append((seq, msg, "delta", role, rnd.choice(["a", "bc", "", None, "[INST]"])))
                seq += 1
            if rnd.random() < 0.4:
                back = rnd.randint(0, msg)
                kind = rnd.choice(["edit", "regenerate"])
                events.append((seq, back, kind, "user" if back % 2 == 0 else "assistant", rnd.choice(["new", ""])))
                seq += 1
        want[conv] = fold_by_hand(events)
        rows += [(conv, seq, msg, kind, role, text) for seq, msg, kind, role, text in events]
    rnd.shuffle(rows)
    log = local_table(spark, rows, chat_format.LOG.replace("long", "bigint")).repartition(5)
    found = {}
    for r in chat_format.fold(log).collect():
        found.setdefault(r["conv_id"], []).append((r["msg"], r["role"], r["text"]))
    assert {c: sorted(m) for c, m in found.items()} == want
    for r in chat_format.format_conversations(log).withColumn("turns", chat_format.read_turns(F.col("formatted"))).collect():
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role, text) for _, role, text in want[r["conv_id"]]]


def test_log_of_rows_has_every_kind_of_event(spark):
    rows = [(1, 0, "user", "abc"), (1, 1, "assistant", "defg"), (2, 0, "assistant", "x"), (2, 1, None, LONG)]
    table = local_table(spark, [(*r, "x", "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, msg string, seq string")
    log = chat_format.log_of_rows(table)
    events = {}
    for r in log.collect():
        events.setdefault(r["conv_id"], []).append((r["seq"], r["msg"], r["kind"], r["role"], r["text"]))
    assert {k for e in events.values() for _, _, k, _, _ in e} == {"delta", "edit", "regenerate"}
    for conv, own in events.items():
        assert [t for _, _, t in fold_by_hand(own)] == [t for c, _, _, t in rows if c == conv]
    folded = sorted((r["conv_id"], r["msg"], r["role"], r["text"]) for r in chat_format.fold(log).collect())
    assert folded == [(1, 1, "user", "abc"), (1, 2, "assistant", "defg"), (2, 1, "assistant", "x"), (2, 2, "", LONG)]
    assert chat_format.format_conversations(chat_format.log_of_rows(table.limit(0))).count() == 0


def test_rows_with_nulls_ties_and_repeats(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (1, 1, "assistant", "é🙂" * 50), (None, 0, "user", "x")]
    log = chat_format.log_of_rows(local_table(spark, rows, "conv_id bigint, turn bigint, role string, text string"))
    found = {r["conv_id"]: r for r in chat_format.format_conversations(log).withColumn("loss", chat_format.read_loss(F.col("segments"))).collect()}
    assert found[1]["formatted"] == "<s>[INST][/INST]</s>" + "".join(f"<s>[INST]user[/INST]{t}</s>" for t in "aab") + f"<s>[INST]assistant[/INST]{'é🙂' * 50}</s>"
    assert found[1]["loss"] == "é🙂" * 50 and found[None]["loss"] == ""


def test_op9_on_the_given_table(spark):
    rows = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        rows.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    rows[-7] = [(0, "user", queries.CONTROL_TEXT), (1, "assistant", queries.CONTROL_TEXT)]
    found = queries.op9_chat_format(spark, SF).collect()
    assert len(found) == len(rows)
    for r in found:
        turns = sorted(rows[r["conv_id"]])
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_hosts_paths_and_rules(spark):
    urls = [
        None, "", "no-scheme.net/x", "http://A.Example.NET/en/1?q#f", "https://x.example.net/de/1", "https://example.com/de/", "https://badexample.com/de/",
        "ftp://user@shop.org:80/fr/?x", "http://net", "http://NET/", "http://a.net?x=/en/", "http://é.ORG/fr/ü#x", "://a.com/de", "http://q.com/p://z",
    ]
    pages = local_table(spark, [(i, u) for i, u in enumerate(urls)] + [(3, urls[3])], "page_id bigint, url string")
    outcomes = local_table(spark, [], "page_id bigint, bad int")
    rows = url_reputation.judge_urls(pages, outcomes).collect()
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == len(urls) + 1
    assert found[0] == found[1] == found[2] == ("", "", None, "allow")
    assert found[3] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert found[4] == ("x.example.net", "/de/1", "net/", "block")
    assert found[5] == ("example.com", "/de/", "example.com/de/", "block")
    assert found[6][2:] == (None, "allow")
    assert found[7] == ("user@shop.org:80", "/fr/", None, "allow")
    assert found[8] == ("net", "", None, "allow") and found[9] == ("net", "/", "net/", "block") and found[10] == ("a.net", "", None, "allow")
    assert found[11] == ("é.org", "/fr/ü", "org/fr/", "allow") and found[12][:2] == ("a.com", "/de") and found[13][:2] == ("q.com", "/p://z")


def test_reputation_shrinks_and_blocks(spark):
    pages, outcomes = [], []

    def add(host, bad, good, unlabelled=1):
        for kind, n in ((1, bad), (0, good), (None, unlabelled)):
            for _ in range(n):
                pages.append((len(pages), f"http://{host}/x"))
                if kind is not None:
                    outcomes.append((len(pages) - 1, kind))

    add("bad.spam.com", 60, 0)
    add("new.spam.com", 0, 0)
    add("good.fine.com", 1, 80)
    add("rare.fine.com", 1, 0)
    add("x.other.org", 5, 60)
    outcomes += [(0, 0), (0, None), (None, 1)]
    df = url_reputation.judge_urls(
        local_table(spark, pages, "page_id bigint, url string"), local_table(spark, outcomes, "page_id bigint, bad int")
    )
    rows = {r["host"]: r for r in df.collect()}
    assert df.count() == len(pages)
    assert rows["bad.spam.com"]["verdict"] == "block" and rows["good.fine.com"]["verdict"] == "allow"
    assert rows["rare.fine.com"]["verdict"] == "allow" and rows["rare.fine.com"]["bad_rate"] < 0.9
    assert rows["new.spam.com"]["bad_rate"] > rows["rare.fine.com"]["bad_rate"] > rows["good.fine.com"]["bad_rate"]


def test_pipeline_equals_brute_force(spark, tmp_path):
    """With copies between the thresholds of op5 and of the stage, foreign texts and letter junk planted."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in given.collect()]
    base = max((r for r in rows if r[1]), key=lambda r: len(set(r[1].split())))
    words = base[1].split()
    appended, cut_off = " ".join([*words, *(w[::-1] + "x" for w in words[: len(words) // 6])]), " ".join(words[: len(words) * 17 // 20])
    planted = [appended, cut_off, "asdkj qwpoeiru zxmcnv qpwoeiru tyghbn vmcnxz laskdj qpwoei", "Это предложение написано по-русски", "?? 12", None]
    rows += [(900_000 + i, text, None, "planted", len(text or "")) for i, text in enumerate(planted)]
    spark.createDataFrame(rows, given.schema).write.parquet(f"{tmp_path}/documents.parquet")
    plain = PlainBayes((r[2], r[1]) for r in rows)
    docs = {r[0]: r[1] for r in rows if plain.judge(r[1])[2]}
    assert not set(range(900_002, 900_006)) & set(docs) and len(docs) == len(rows) - 4
    groups = {}
    for i, text in docs.items():
        groups.setdefault(SPACE.sub("", text), []).append((-len(text), i))
    kept = {min(g)[1]: docs[min(g)[1]] for g in groups.values()}
    _, loose = brute_force(kept, 5, 80)
    _, strict = brute_force(kept)
    assert {i for i in kept if i >= 900_000 and strict[i] == i and loose[i] != i}, "a copy that only the stage's setting finds"
    kept = {i: t for i, t in kept.items() if loose[i] == i}
    model = bpe.model(PATH)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids_of = {i: [*memoryview(model.encode(t)).cast("I"), 2] for i, t in kept.items()}
    assert {p["doc_id"] for p in pieces} == set(kept)
    assert check_pieces(pieces, ids_of) == 0


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").filter("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_on_awkward_rows(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "")
        assert after.columns == docs.columns, name
        assert after.count() <= docs.count()
        assert stage(spark, documents(spark, []), "").count() == 0
    clear = corpus_pipeline.identify_language(spark, docs, "")
    assert {r["doc_id"] for r in clear.collect()} == {None, 1, 2, 6, 7, 8, 9, 10, 11, 12}
    assert corpus_pipeline.pack_tokens(spark, docs, "").select("doc_id").distinct().count() == len({r["doc_id"] for r in docs.collect()})
    assert corpus_pipeline.drop_near_copies(spark, docs, "").filter("doc_id IN (2, 7, 10, 12)").count() == 0


def test_native_operators_run_no_python(spark):
    docs, pages = documents(spark), local_table(spark, [(1, "http://a.b/c")], "page_id bigint, url string")
    rows = local_table(spark, [(1, 0, "user", "b")], "conv_id bigint, turn bigint, role string, text string")
    for df in (
        exact_dedup.exact_groups(docs),
        url_reputation.judge_urls(pages, local_table(spark, [(1, 1)], "page_id bigint, bad int")),
        chat_format.format_conversations(chat_format.log_of_rows(rows)),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)

