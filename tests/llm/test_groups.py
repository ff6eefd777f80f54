"""Deduplication, similarity, vectors and sharding against brute force."""

import hashlib
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from formloom.llm import embedding_dedup, exact_dedup, ngram_join, sharding
from formloom.llm.components import components
from formloom.session import local_table
from tests.llm.messy import ROWS, WORDS, documents

SPACE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def union_find(pairs, items):
    parent = {x: x for x in items}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in items}


@pytest.mark.parametrize("hash_of", [F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(3))], ids=["64 bits", "3 values"])
def test_exact_groups(spark, hash_of):
    """Also with a hash so weak that nearly every chunk has to be compared by its text."""
    random.seed(2)
    letters = "abcks"
    long = ["".join(random.choice(letters) for _ in range(3000)) for _ in range(3)]
    rows = [(100 + i, t, "en", "s") for i, t in enumerate([*long, long[0][:-1] + "!", long[0][:1500] + " " + long[0][1500:], long[1]])]
    rows = [r for r in ROWS if r[0] is not None] + rows
    found = exact_dedup.exact_groups(documents(spark, rows), hash_of=hash_of).collect()
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(SPACE.sub("", text or ""), []).append((-len(text or ""), i))
    want = sorted(
        (i, min(g)[1], len(g), i == min(g)[1], hashlib.sha256(s.encode()).hexdigest()) for s, g in groups.items() for _, i in g
    )
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in found) == want


def test_exact_dedup_keeps_one_whole_row_of_each_group(spark):
    docs = documents(spark)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    texts = [SPACE.sub("", r["text"] or "") for r in rows]
    assert len(texts) == len(set(texts)) == len({SPACE.sub("", r[1] or "") for r in ROWS})
    assert exact_dedup.deduplicate(documents(spark, [])).count() == 0


def test_chunks_are_the_whole_text_and_follow_content(spark):
    rnd = random.Random(1)
    text = "".join(rnd.choice("abckstuvé🙂") for _ in range(9000))
    rows = spark.createDataFrame([(text,), ("xyz" + text,)], "t string").select(exact_dedup.chunks(F.col("t")).alias("c")).collect()
    assert "".join(rows[0]["c"]) == text
    assert len(set(rows[0]["c"]) & set(rows[1]["c"])) > len(rows[0]["c"]) // 2


def shingles(text, length=3):
    words = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    size = min(length, len(words))
    return set(zip(*(words[i:] for i in range(size)))) if size else set()


def brute_force(texts, length=3, percent=90):
    sets = {i: shingles(t, length) for i, t in texts.items()}
    ids = sorted(i for i in sets if sets[i])
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    return sets, union_find(links, sets)


def near_copies(seed=4):
    """A hub with copies of it, chains of small edits, equal texts, and texts that share a passage."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rnd.choice(vocabulary) for _ in range(150)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    texts, n = {}, 0

    def add(words):
        nonlocal n
        texts[n] = " ".join(words)
        n += 1

    add(base)
    for _ in range(60):
        copy = list(base)
        for _ in range(rnd.randint(0, 4)):
            copy[rnd.randrange(150)] = rnd.choice(vocabulary)
        add(copy)
    chain = list(base[:100])
    for _ in range(20):
        chain[rnd.randrange(100)] = rnd.choice(vocabulary)
        add(chain)
    for _ in range(30):
        add(passage + [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 80))])
    for _ in range(5):
        add(passage)
    for i in range(12):
        add(["same"] * i)
    return texts


def test_similarity_classes_equal_brute_force(spark):
    texts = near_copies()
    sets, component = brute_force(texts)
    rows = ngram_join.similarity_classes(local_table(spark, list(texts.items()), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {i: (len(sets[i]), component[i]) for i in texts}


def test_similarity_does_not_depend_on_the_popularity_table(spark):
    """With one slot, or every slot counted, the order of shingles differs and the result may not."""
    texts = near_copies(9)
    _, component = brute_force(texts)
    docs = local_table(spark, list(texts.items()), "doc_id bigint, text string").repartition(3)
    setting = ngram_join.Setting(slots=8, local_least=1)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_classes(docs, setting).collect()} == component


def test_similarity_awkward_rows(spark):
    rows = ngram_join.similarity_classes(documents(spark)).collect()
    assert len(rows) == len(ROWS)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert found[3] == (0, 3) and found[4] == (0, 4) and found[5] == (0, 5)
    assert found[2] == found[1] == (2, 1) and found[12] == found[11] == (1, 11) and found[7][1] == 6 and found[10][1] == 9
    assert found[None][1] is None
    assert ngram_join.similarity_classes(documents(spark, [])).count() == 0


def test_similarity_links_rows_not_ids(spark):
    """An id with two texts, and near copies without an id."""
    first, second, third = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    rows = [(5, first), (5, second), (3, first + " more"), (7, second + " more"), (None, third), (None, third + " more"), (9, third)]
    docs = local_table(spark, rows, "doc_id bigint, text string")
    found = sorted((r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_classes(docs).collect())
    assert found == [(98, 3), (98, 5), (98, 9), (98, 9), (99, 3), (99, 5), (99, 9)]
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert {(r["doc_id"], r["text"]) for r in kept} == {(3, first + " more"), (5, second), (9, third)} and len(kept) == 3


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    text = " ".join(WORDS * 50 + ["x" * 300, "y" * 64])
    whole = ngram_join.shingle_set(text, 3)
    assert len(whole) == len(shingles(text))
    long = ngram_join.shingle_set("a " + "z" * (ngram_join._BLOCK * 2 + 5) + " b", 3)
    assert len(long) == 1 and np.array_equal(long, ngram_join.shingle_set("A \n" + "z" * (ngram_join._BLOCK * 2 + 5) + "\tB", 3))


def test_components_of_paths_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(1, 60)] + [(900, 901), (901, 902), (902, 900), (7, 7)]
    want = union_find([p for p in pairs if p[0] != p[1]], {x for p in pairs for x in p})
    found = {r["v"]: r["component"] for r in components(local_table(spark, pairs, "a bigint, b bigint")).collect()}
    assert found == want
    assert components(local_table(spark, [], "a bigint, b bigint")).count() == 0


def vectors_of(spark, rows):
    return local_table(spark, rows, "vec_id bigint, embedding array<float>, label int")


def brute_vectors(rows, threshold=0.93):
    unit, links = {}, []
    for i, v, label in rows:
        if v is not None and None not in v and label is not None:
            x = np.array(v, dtype=np.float32).astype(float)
            if np.isfinite(x).all() and np.linalg.norm(x) > 0:
                unit[i] = (label, len(x), x / np.linalg.norm(x))
    ids = sorted(unit)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if unit[a][:2] == unit[b][:2] and unit[a][2] @ unit[b][2] >= threshold:
                links.append((a, b))
    degree = {i: 0 for i, *_ in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return degree, union_find(links, degree)


@pytest.mark.parametrize("noise", [0.05, 0.16, 0.21])
def test_vectors_equal_brute_force(spark, noise):
    """Groups from tight to so wide that many of their pairs are below the threshold."""
    rnd = np.random.default_rng(int(noise * 100))
    rows, n = [], 0
    for label in (0, 1):
        for size in (120, 30, 2, 1, 1):
            centre = rnd.standard_normal(24)
            centre /= np.linalg.norm(centre)
            for _ in range(size):
                v = centre + noise * rnd.standard_normal(24) / np.sqrt(24)
                rows.append((n, [float(np.float32(x)) for x in v], label))
                n += 1
    degree, component = brute_vectors(rows)
    found = embedding_dedup.near_duplicates(vectors_of(spark, rows), embedding_dedup.Setting(block=64)).collect()
    recall = sum(min(r["n_links"], degree[r["vec_id"]]) for r in found) / max(1, sum(degree.values()))
    assert recall >= 0.99 and all(r["n_links"] <= degree[r["vec_id"]] for r in found)
    if noise < 0.2:
        assert {r["vec_id"]: r["component_id"] for r in found} == component
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


def in_turn(angles):
    """Unit vectors of 24 components: the angles are taken in the first plane."""
    return [[float(np.cos(a)), float(np.sin(a)), *[0.0] * 22] for a in angles]


@pytest.mark.parametrize("spread", [0.0, 0.02], ids=["identical", "tight"])
def test_vectors_link_groups_that_fill_each_other_s_lists(spark, spread):
    """Two groups of 50 at cosine 0.95, in one label with others, are one component."""
    rnd = np.random.default_rng(11)
    at = [*([0.0] * 50), *([float(np.arccos(0.95))] * 50)]
    vectors = [np.array(v) + spread * rnd.standard_normal(24) / np.sqrt(24) for v in in_turn(at)]
    vectors += list(rnd.standard_normal((200, 24)))
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(vectors)]
    degree, component = brute_vectors(rows)
    assert {component[i] for i in range(100)} == {0}
    found = embedding_dedup.near_duplicates(vectors_of(spark, rows)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == {i: (degree[i], component[i]) for i in degree}


def test_vectors_are_compared_exactly_where_the_audit_fails(spark, monkeypatch):
    """A search too weak to meet its target is followed by all blocks."""
    rnd = np.random.default_rng(12)
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(rnd.standard_normal((150, 24)))]
    rows += [(200 + i, [x + 0.01 for x in v], 0) for i, v, _ in rows[:60]]
    degree, component = brute_vectors(rows)
    monkeypatch.setattr(embedding_dedup, "_audit", lambda *a: 0.0)
    weak = embedding_dedup.Setting(neighbours=1, orders=1, block=2, descents=0, rounds=1, least_recall=0.01)
    found = embedding_dedup.near_duplicates(vectors_of(spark, rows), weak).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == {i: (degree[i], component[i]) for i in degree}


def test_audit_weighs_vectors_not_links():
    """One found group of thousands hides neither lost pairs nor vectors that seem to have no links."""
    pairs = [(None, 1)] * 20 + [(None, 0)] * 380
    assert embedding_dedup.mean_recall([(5000, 5000)] * 20 + pairs, {True: 20, False: 400}) == 0.5
    assert embedding_dedup.mean_recall([(9, 9)] * 400 + pairs, {True: 400, False: 380_000}) < 0.03
    assert embedding_dedup.mean_recall([(None, 0)] * 5, {True: 0, False: 5}) == 1.0


def test_vectors_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 0), (6, [0.0, 0.0], 0),
        (7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (9, [None, 1.0], 0), (10, [], 0), (11, [1.0, 0.0, 0.0], 0), (12, [1e-30, 0.0], 0), (12, [1e30, 0.0], 0),
    ]
    found = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(vectors_of(spark, rows)).collect())
    assert found == sorted([(1, 3, 1), (2, 3, 1), (12, 3, 1), (12, 3, 1), *((i, 0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))])
    assert embedding_dedup.near_duplicates(vectors_of(spark, [])).count() == 0


def test_shards_hold_groups_together_and_balance(spark):
    rnd = random.Random(6)
    rows = ROWS + [(1000 + i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 60))), "en", "s") for i in range(1500)]
    rows += [(5000 + i, "a copied text " * 9, "en", "s") for i in range(40)]
    found = sharding.assign_shards(documents(spark, [r for r in rows if r[0] not in (6, 7)])).collect()
    assert len(found) == len(rows) - 2
    texts = {r[0]: r[1] or "" for r in rows}
    of_text, loads, slots = {}, [0] * 24, {}
    for r in found:
        text = texts[r["doc_id"]]
        of_text.setdefault(text, set()).add(r["shard"])
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["size"] == len(text.encode()) + 8 and r["text_crc32"] == zlib.crc32(text.encode())
    assert all(len(s) == 1 for s in of_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads) - min(loads) <= 400
    assert sharding.assign_shards(documents(spark, [])).count() == 0


def test_longest_first_schedule():
    placed = sharding.schedule([(0, 7), (1, 6), (2, 5), (3, 4), (4, 3)], 2)
    loads = {}
    for item, size in ((0, 7), (1, 6), (2, 5), (3, 4), (4, 3)):
        loads[placed[item]] = loads.get(placed[item], 0) + size
    assert sorted(loads.values()) == [11, 14]


def test_loads_equal_a_schedule_made_by_hand(spark):
    """Every group an item of its own, so the loads must be those of longest-processing-time scheduling."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    table = local_table(spark, docs, "doc_id bigint, text string")
    for shards in (3, 24):
        plan = sharding.Plan(shards=shards, large_groups=10**12)
        sizes = {}
        for _, text in docs:
            sizes[text or ""] = sizes.get(text or "", 0) + len((text or "").encode()) + 8
        loads = [0] * shards
        for size in sorted(sizes.values(), reverse=True):
            loads[loads.index(min(loads))] += size
        found = {}
        for r in sharding.assign_shards(table, plan).collect():
            found[r["shard"]] = found.get(r["shard"], 0) + r["size"]
        assert sorted(found.values()) == sorted(x for x in loads if x)


def test_rows_without_an_id_are_spread_and_numbered(spark):
    docs = local_table(spark, [(None, "same") for _ in range(500)] + [(1, "same")], "doc_id bigint, text string")
    rows = sharding.assign_shards(docs).collect()
    assert sorted(r["slot"] for r in rows) == list(range(501)) and len({r["shard"] for r in rows}) == 1


def test_a_character_is_judged_by_few_comparisons(spark):
    points = spark.range(0x20, 0x400).select(F.col("id").alias("p"), F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    cuts = {r["p"] for r in points.filter(F.col("c").rlike(f"[{exact_dedup._CUT_CLASS}]")).collect()}
    assert cuts == set(range(0x23, 0x250, 8))
    # Beyond one byte the pattern compares point by point, so most characters must be ruled out by one range before.
    before = exact_dedup._CUT_CLASS.split("&&")[0].split("\\u")[1:]
    assert "[" in exact_dedup._CUT_CLASS and all(int(p[:4], 16) <= 0x100 or p == "024F" for p in before)
