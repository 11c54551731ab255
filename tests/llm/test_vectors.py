import numpy as np
import pytest

from quire.llm import similar_vectors as sv


def rows(spark, data):
    return spark.createDataFrame(data, "id bigint, v array<float>, extra string")


def collection(n=600, seed=2):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, 64))
    v[::7] = v[1::7][: len(v[::7])] + 0.12 * rng.standard_normal(v[::7].shape)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_near_neighbours_are_those_of_brute_force(spark):
    v = collection()
    data = [(i, (x * (1 + i % 3)).tolist(), "e") for i, x in enumerate(v)]
    data += [(9001, None, "e"), (9002, [0.0] * 64, "e"), (9003, [1.0] * 63, "e"), (9004, [float("nan")] * 64, "e"), (9005, [], "e"), data[0]]
    got = {(r["id"], r["neighbour"]) for r in sv.near_neighbours(rows(spark, data), "id", "v").collect()}
    s = v @ v.T
    np.fill_diagonal(s, -1)
    want = {(i, j) for i in range(len(v)) for j in np.lexsort((np.arange(len(v)), -s[i].round(9)))[:5].tolist() if s[i, j] >= 0.9}
    assert len(want - got) <= 0.03 * len(want) and not got - want


def test_copies_rank_by_id_and_stay_few(spark):
    v = collection(20)
    data = [(100 + i, v[0].tolist(), "") for i in range(300)] + [(i, x.tolist(), "") for i, x in enumerate(v[1:])]
    got = sv.near_neighbours(rows(spark, data), "id", "v").where("id >= 100").collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], set()).add(r["neighbour"])
    assert by[100] == {101, 102, 103, 104, 105} and by[399] == {100, 101, 102, 103, 104}
    assert all(len(x) == 5 for x in by.values())


@pytest.mark.parametrize("size", [800, 1_000_000])
def test_nearest_has_recall_and_excludes_itself(spark, size):
    """With the tables of this collection, and with those of a large one."""
    v = collection(800, 5)
    base = rows(spark, [(i, x.tolist(), "") for i, x in enumerate(v)])
    got = {}
    for r in sv.nearest(base.where("id % 20 = 0"), base, "id", "v", t=sv.Tables.wide(size)).collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    s = v @ v.T
    np.fill_diagonal(s, -1)
    hit = [len(set(got[i]) & set(np.argsort(-s[i])[:5].tolist())) for i in range(0, 800, 20)]
    assert np.mean(hit) / 5 >= 0.9 and all(i not in n for i, n in got.items())


def test_empty_tables(spark):
    none = rows(spark, [])
    assert sv.near_neighbours(none, "id", "v").count() == 0
    assert sv.nearest(none, none, "id", "v").count() == 0


def test_probe_sets_come_in_order_and_never_move_both_ways():
    sets = sv.probe_sets(6, 40)
    assert len(set(sets)) == 40 and all(len({min(a, 11 - a) for a in s}) == len(s) for s in sets)


def test_recall_stays_as_the_collection_grows():
    def recall(t, n=4000, cosine=0.90):
        rng = np.random.default_rng(3)
        v, w = rng.standard_normal((2, n, 64))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        w -= (v * w).sum(1, keepdims=True) * v
        w = cosine * v + (1 - cosine**2) ** 0.5 * w / np.linalg.norm(w, axis=1, keepdims=True)
        met, h = np.zeros(n, bool), sv.Hasher(t)
        for (own, a), (_, b) in zip(h.keys(v.astype(np.float32)), h.keys(w.astype(np.float32))):
            if own:
                at_v, at_w = a, b
            met |= (a == at_w) | (b == at_v)
        return met.mean()

    assert all(recall(sv.Tables.near(n)) >= 0.955 for n in (1_000, 10_000, 96_000, 1_000_000))
