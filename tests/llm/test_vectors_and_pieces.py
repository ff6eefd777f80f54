"""Offset-preserving encoding, whitening and centroid clustering against the library and brute force."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from formloom.llm import centroids, piece_bpe, queries, whitening
from formloom.session import local_table
from tests.llm.messy import LONG, ROWS, documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


PARTS = ["a", "zq", " ", "  ", "\n", "é", "中文", "▁", "🙂", "<0x0A>", "</s>", "<s>", "the", "123", "\t", "\x00", "ﬁ", "²", " ing", " " * 20, "a" * 70]


def test_pieces_and_spans_equal_the_library(library):
    rnd, own = random.Random(3), piece_bpe.model(PATH)
    assert own.plain
    for _ in range(2000):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 10)))
        ids, begins, ends = own.encode(text)
        want = library.encode(text, return_type="proto")
        assert ids.tolist() == [p.id for p in want.pieces], text
        assert begins.tolist() == [p.begin for p in want.pieces] and ends.tolist() == [p.end for p in want.pieces], text
        assert own.decode(ids) == library.decode(ids.tolist())


def test_decoding_any_ids_equals_the_library(library):
    rnd, own = random.Random(4), piece_bpe.model(PATH)
    space = library.piece_to_id("▁")
    for _ in range(2000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(3, 259), space, rnd.randrange(3)]) for _ in range(rnd.randint(0, 6))]
        assert own.decode(np.array(ids, dtype=np.int32)) == library.decode(ids), ids


@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("remove", [True, False])
def test_character_map_equals_the_library(prefix, remove):
    rnd = random.Random(5)
    flags = {"add_dummy_prefix": prefix, "escape_whitespaces": True, "remove_extra_whitespaces": remove}
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", **flags)
    spec = dict(piece_bpe.fields(dict(piece_bpe.fields(library.serialized_model_proto()))[3]))
    own = piece_bpe.PieceModel.__new__(piece_bpe.PieceModel)
    own.map, own.dummy_prefix, own.remove_extra, own.escape = piece_bpe.CharacterMap(spec[2]), prefix, remove, True
    parts = ["ＡＢ", "ﬁ", " ", "  ", "　", "é", "½", "㍿", "\t", "\n", "​", "ｶﾞ", "a", "\x00", "\x07", "™", "…", "가"]
    for _ in range(1000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8)))
        normal, places = own.normalize(text)
        want, offsets = library.normalize(text, with_offsets=True)
        assert normal == want, text
        if want:  # without pieces there is nothing to place
            assert [len(text.encode()[:at].decode()) for at in places] == offsets, text


def test_general_path_equals_the_short_one():
    own, rnd = piece_bpe.model(PATH), random.Random(6)
    for _ in range(500):
        text = "".join(rnd.choice([p for p in PARTS if p != "▁"]) for _ in range(rnd.randint(1, 10)))
        short = own.encode(text)
        own.plain = False
        try:
            general = own.encode(text)
        finally:
            own.plain = True
        assert all(a.tolist() == b.tolist() for a, b in zip(short, general)), text


def test_blocks_of_a_very_long_text(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "BLOCK", 1000)
    monkeypatch.setattr(piece_bpe, "CACHED_CHUNKS", 500)
    own = piece_bpe.PieceModel(open(PATH, "rb").read())
    ids, _, ends = own.encode(LONG)
    assert ids.tolist() == library.encode(LONG) and ends[-1] == len(LONG) and len(own.chunks) <= 1500


def test_encode_rows(spark, library):
    coded = piece_bpe.encode(documents(spark), PATH, add_end=True)
    rows = coded.select("doc_id", "text", "ids", "begins", "ends", "row", "given").collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r["ids"] == library.encode(r["text"] or "", add_eos=True)
        assert r["ends"][-1] == len((r["text"] or "").encode()) and r["given"] == r["row"] == "x"
    back = piece_bpe.decode(coded.select("text", "ids", "row", "decoded") if "decoded" in coded.columns else coded.select("text", "ids", "row"), PATH)
    assert all(r["decoded"] == library.decode(r["ids"]) for r in back.collect())
    assert piece_bpe.encode(documents(spark, []), PATH).count() == 0


def test_op11_on_the_given_table(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op11_offset_piece_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_eos=True)
        assert (r["n_tokens"], r["covered_bytes"]) == (len(ids), len(texts[r["doc_id"]].encode()))
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def vectors(spark, rows):
    data = [(i, v, 0, *["x"] * 5) for i, v in rows]
    return local_table(spark, data, "vec_id bigint, embedding array<double>, label int, id string, v string, x string, cluster string, component string")


ODD_VECTORS = [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0]), (903, [1.0, NAN, 2.0, 3.0]), (904, [INF, 0.0, 0.0, 0.0]), (905, [1.0, 2.0])]


def check_whitened(rows, table):
    """Against numpy's symmetric eigenvalues of the same integers."""
    x = np.floor(64 * np.array([v for _, v in table])) + 1_000_000
    n, centred = len(x), x - x.mean(axis=0)
    v = centred.T @ centred / n
    values, matrix = np.linalg.eigh(v)
    values, matrix = values[::-1], matrix[:, ::-1]
    rank = min(32, int((values > values[0] * 1e-12).sum()))
    sums = [int(s) for s in x.sum(axis=0)]
    found = {}
    for r in rows:
        found.setdefault(r["component"], []).append(r)
    assert sorted(found) == list(range(1, rank + 1))
    want = centred @ matrix[:, :rank] / np.sqrt(values[:rank])
    by_id = {i: k for k, (i, _) in enumerate(table)}
    for c, own in found.items():
        assert len(own) == n
        order = [by_id[r["vec_id"]] for r in own]
        got = np.array([r["whitened"] for r in own])
        sign = np.sign(got @ want[order, c - 1])
        gap = min([abs(values[c - 1] - values[j]) for j in range(len(values)) if j != c - 1], default=1.0)
        assert np.abs(got * sign - want[order, c - 1]).max() < 1e-9 * max(1.0, values[0] / max(gap, 1e-9))
        for r, k in zip(own, order):
            assert r["n"] == n and r["deviation"] == sum((n * int(a) - s) ** 2 for a, s in zip(x[k], sums))
            assert abs(r["explained"] - values[c - 1] / np.trace(v)) < 1e-12 and r["identity_error"] < 1e-9


def test_whitening_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitened(queries.op12_cholesky_jacobi_whitening(spark, SF).collect(), rows)


def test_whitening_of_awkward_rows(spark):
    rnd = random.Random(7)
    rows = [(i, [rnd.gauss(0, 1), rnd.gauss(5, 0.01), a := rnd.gauss(0, 3), a]) for i in range(60)]  # two equal dimensions
    found = whitening.whiten(vectors(spark, rows + ODD_VECTORS).repartition(5)).collect()
    check_whitened(found, rows)
    again = whitening.whiten(vectors(spark, rows + ODD_VECTORS).repartition(3)).collect()
    assert sorted((r["vec_id"], r["component"], r["whitened"]) for r in found) == sorted((r["vec_id"], r["component"], r["whitened"]) for r in again)
    assert whitening.whiten(vectors(spark, [])).count() == whitening.whiten(vectors(spark, ODD_VECTORS[:2])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0])])).count() == 0  # no variance
    repeated = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [2.0, 2.0])])).collect()
    assert len(repeated) == 3 and {r["component"] for r in repeated} == {1}


def test_whitening_of_large_entries_stays_exact(spark):
    rows = [(i, [float(1 << 30) + i, float(i * i)]) for i in range(20)]
    check = whitening.whiten(vectors(spark, rows)).collect()
    x = np.array([[64 * int(a) + 1_000_000, 64 * int(b) + 1_000_000] for _, (a, b) in rows], dtype=object)
    sums = x.sum(axis=0)
    assert {r["vec_id"]: r["deviation"] for r in check} == {i: int(((20 * v - sums) ** 2).sum()) for (i, _), v in zip(rows, x)}
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(vectors(spark, [(1, [1e12]), (2, [0.0])]))


def test_jacobi_on_triangular_factors():
    rng = np.random.default_rng(3)
    for d, rank in ((1, 1), (6, 6), (12, 5), (40, 40)):
        a = rng.normal(size=(d, rank)) * (10.0 ** -rng.integers(0, 4, size=rank))
        matrix = a @ a.T
        factor, order = whitening.pivoted_cholesky(matrix)
        assert factor.shape[1] <= d and np.allclose(factor @ factor.T, matrix[np.ix_(order, order)], atol=1e-12 * np.trace(matrix))
        assert np.allclose(np.triu(factor, 1), 0)
        values, rows = whitening.eigen(matrix)
        assert np.allclose(rows @ rows.T, np.eye(len(values)), atol=1e-9) and np.allclose(matrix @ rows.T, rows.T * values, atol=1e-12 * values[0])
        assert np.all(np.diff(values) <= 0)


def brute_clusters(rows, k, rounds):
    kept = [(i, [int(np.floor(64 * c)) for c in v]) for i, v in rows]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    centre = [list(x) for _, x in first]

    def assign():
        found = []
        for _, x in kept:
            found.append(min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centre)))
        return found

    for _ in range(rounds):
        own = assign()
        for n in range(len(centre)):
            members = [x for (_, x), (_, c) in zip(kept, own) if c == n]
            if members:
                centre[n] = [sum(col) // len(members) for col in zip(*members)]
    own = assign()
    inertia = sum(d for d, _ in own)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    per = {n: sum(d for d, c in own if c == n) for n in range(len(centre))}
    return sorted((str(i), c, d, per[c], inertia, names[c]) for (i, _), (d, c) in zip(kept, own))


def as_tuples(rows):
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in rows)


def test_clusters_equal_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert as_tuples(queries.op13_geometric_centroids(spark, SF).collect()) == brute_clusters(rows, 16, 3)


@pytest.mark.parametrize("k, rounds", [(1, 2), (5, 6), (40, 3)])
def test_clusters_of_awkward_rows(spark, k, rounds):
    rnd = random.Random(k)
    rows = [(rnd.choice([i, 3]), [float(rnd.randint(-3, 3)) + g for _ in range(4)]) for i in range(25) for g in [rnd.choice([0, 9, -9])]]
    found = centroids.cluster(vectors(spark, rows + ODD_VECTORS), clusters=k, rounds=rounds, dimension=4).collect()
    assert as_tuples(found) == brute_clusters(rows, k, rounds)
    missing = centroids.cluster(vectors(spark, rows + [(None, [1.0, 1.0, 1.0, 1.0])]), clusters=k, rounds=rounds, dimension=4)
    assert missing.count() == 26
    assert centroids.cluster(vectors(spark, ODD_VECTORS), dimension=4).count() == centroids.cluster(vectors(spark, [])).count() == 0


def test_plane_loss_is_a_bound_below_the_drift():
    rng = np.random.default_rng(9)
    tighter = 0
    for _ in range(300):
        centre, old = rng.normal(size=5) * 4, rng.normal(size=5) * 4
        new = old + rng.normal(size=5) * rng.choice([0.1, 1, 5])
        radius = float(rng.choice([0.0, 0.3, 2, 6]))
        bound, drift = centroids.plane_loss(centre, radius, old, new), np.linalg.norm(new - old)
        points = rng.normal(size=(400, 5))
        points = centre + radius * points / np.linalg.norm(points, axis=1)[:, None] * rng.random((400, 1)) ** 0.2
        lost = np.linalg.norm(points - old, axis=1) - np.linalg.norm(points - new, axis=1)
        assert lost.max() <= bound + 1e-9 and bound <= drift
        tighter += bound < 0.9 * drift
    assert tighter > 100


def test_most_vectors_are_settled_by_bounds():
    rng = np.random.default_rng(2)
    centres = rng.integers(-500, 500, size=(8, 6))
    x = np.concatenate([c + rng.integers(-20, 20, size=(200, 6)) for c in centres])
    old = centres + rng.integers(-8, 8, size=centres.shape)
    own, upper, lower = centroids.scan(x, old)
    new = np.array([x[own == c].sum(axis=0) // max((own == c).sum(), 1) for c in range(8)])
    radii = np.array([upper[own == c].max(initial=0) for c in range(8)])
    drifts = np.linalg.norm(new - old, axis=1)
    lost = centroids.losses(old, new, radii)
    assert (lost <= drifts.max() * (1 + 1e-6)).all() and lost.min() < drifts.max()
    found = centroids.reassign(x, own, upper, lower, new, drifts, lost)
    assert (found[0] == centroids.scan(x, new)[0]).all() and found[3] < len(x) // 10
