import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import golay, simhash


def brute(rows):
    fps = [(d, simhash.fingerprint(t)) for d, t in rows]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, f"{f:016x}", least[find(i)]) for i, (d, f) in enumerate(fps))


def test_decoding_is_perfect():
    error = golay._error_of_syndrome()
    assert len(np.unique(error)) == 2048 and np.bitwise_count(error).max() == 3


@pytest.mark.parametrize("segments", [4, 5])
def test_links_miss_nothing(spark, segments):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 30, dtype=np.int64)
    near = [b ^ sum(1 << int(k) for k in rng.choice(63, n, replace=False)) for b in base for n in (1, 2, 3, 4)]
    cluster = [int(base[0]) ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i)]
    fps = sorted({int(x) for x in [*base, *near, *cluster]})
    got = simhash.components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), segments))
    got = {r.node: r.root for r in got.collect()}
    root = {x: x for x in fps}
    changed = True
    a = np.array(fps)
    close = np.bitwise_count((a[:, None] ^ a[None, :]).view(np.uint64)) <= 3
    label = np.arange(len(fps))
    while changed:
        new = np.where(close, label[None, :], len(fps)).min(axis=1)
        changed = bool((new != label).any())
        label = new
    root = {x: fps[k] for x, k in zip(fps, label, strict=True)}
    assert {x: got.get(x, x) for x in fps} == root


@pytest.mark.parametrize("hot", [False, True])
def test_heavy_keys_and_a_hub(spark, monkeypatch, hot):
    """5,000 fingerprints under one key, a chain of them and a hub with all its neighbours."""
    if hot:  # the hubs go by broadcast
        monkeypatch.setattr(simhash, "HOT", 20)
        monkeypatch.setattr(simhash, "HOT_ROWS", 0)
    rng = np.random.default_rng(8)
    hub = int(rng.integers(0, 1 << 62))
    same_key = [hub ^ (int(x) << 40) for x in rng.choice(1 << 22, 4_400, replace=False)]
    near_hub = [hub ^ (1 << i) ^ (1 << j) ^ (1 << k) for i in range(14) for j in range(i) for k in range(j)]
    fps = np.array(sorted({*same_key, *near_hub, hub}), np.int64)
    assert len(fps) > 4_700
    label = np.arange(len(fps))
    while True:
        new = np.array([label[np.bitwise_count((fps ^ f).view(np.uint64)) <= 3].min() for f in fps])
        if (new == label).all():
            break
        label = new
    got = simhash.components(simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long")))
    got = {r.node: r.root for r in got.collect()}
    assert [got.get(int(x), int(x)) for x in fps] == [int(fps[k]) for k in label]


@pytest.mark.parametrize("heavy", [False, True])
def test_expanded_rows_are_never_broadcast(spark, monkeypatch, heavy):
    """Neither side of the keys' joins, however few the fingerprints look to Spark."""
    monkeypatch.setattr(simhash, "BROADCAST_IDS", 0)
    if heavy:  # keys of two fingerprints go blockwise
        monkeypatch.setattr(simhash, "HEAVY", 1)
    fps = [x << 20 for x in range(12)]
    found = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    linked = {tuple(sorted(r)) for r in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan and ("FlatMapGroupsInPandas" in plan) == heavy
    if not heavy:
        assert linked == {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    got = {r.node: r.root for r in simhash.components(found).collect()}
    assert [got[x] for x in fps] == [0] * 12


def test_whole_operator_against_brute_force(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 60))))) for i in range(80)]
    rows += [(100 + i, rows[i][1].upper()) for i in range(20)] + [(200, None), (201, ""), (202, " \t\n"), (203, "x " * 30_000), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    got = simhash.near_duplicates(df)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.near_duplicates(spark.createDataFrame([(None, "a b c d"), (4, "a b c d")], df.select("doc_id", "text").schema)).select("component_id").distinct().collect()[0][0] == 4


@pytest.mark.parametrize("few", [0, 250_000])
def test_components_by_stars_and_in_one_task(spark, monkeypatch, few):
    """A long chain in mixed order, a hub, a ring with negative nodes, loops and repeated edges."""
    monkeypatch.setattr(simhash, "FEW_EDGES", few)
    rng = np.random.default_rng(5)
    chain, hub, ring = rng.permutation(range(1000, 1300)).tolist(), list(range(2000, 2200)), [-(1 << 63), -7, 5, (1 << 63) - 1]
    edges = list(zip(chain, chain[1:], strict=False)) + [(2100, x) for x in hub] + list(zip(ring, ring[1:] + ring[:1], strict=True))
    edges += edges[:50] + [(9000, 9000)]
    got = simhash.components(spark.createDataFrame([edges[i] for i in rng.permutation(len(edges))], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted((x, min(group)) for group in (chain, hub, ring) for x in group)
    assert ("MapInArrow" in got._jdf.queryExecution().executedPlan().toString()) == bool(few)
