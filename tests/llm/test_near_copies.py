import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from texloom.llm import near_copies as nc


def grams(text):
    words = (text or "").encode().split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    names = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            names[root(i)] = min(names.get(root(i), name), name)
    return sorted(((n, names.get(root(i)), links[i]) for i, (n, _) in enumerate(rows)), key=repr)


def result(df):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in nc.near_copies(df).collect()), key=repr)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(nc, "BLOCK_TEXTS", 7)


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_families_against_brute_force(spark, small_blocks):
    rng = random.Random(3)
    texts = []
    for size, edits in ((2, 1), (30, 1), (25, 3), (4, 9)):
        texts += family(rng, [f"w{rng.randrange(5000)}" for _ in range(150)], size, edits)
    texts += [texts[0]] * 3 + [texts[5]] * 40
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    texts += ["a b c", "a b c", "a b c d", None, None, "", "  ", "a b c d e", "a b c d e"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_documents_against_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(docs) == brute(rows)


def test_repeated_ids_and_null_ids(spark):
    a = " ".join(f"w{i}" for i in range(80))
    rows = [(4, a), (4, a), (4, a + " more"), (None, a), (None, "q r s t u v"), (None, "q r s t u v"), (2, "other text is here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("mine")).withColumn("digest", F.lit(1))
    assert result(df) == brute(rows)


def test_odd_rows(odd, none):
    found = result(odd)
    assert len(found) == 10 and (2, 2, 0) in found and (3, 3, 0) in found and found.count((5, 1, 2)) == 2
    assert result(none) == []


def test_matched_prefixes_reach_the_recall():
    forest, rng = nc.Forest(), np.random.default_rng(2)
    sizes = np.sort(rng.integers(1, 10_000, (50, forest.trees, 4)), axis=2)[:, :, ::-1]
    sizes[:5] = 1
    depths = forest.matched_depths(sizes)
    assert depths.min() >= forest.least_depth and depths.max() <= forest.depth
    recall = forest.expected_recall(depths)
    assert (recall >= forest.recall - 1e-9).all()
    # no more is shortened than needed: one step back in some tree misses the recall
    longer = depths[:, None, :] + np.eye(forest.trees, dtype=int)[None]
    assert (forest.expected_recall(longer).min(axis=1) < forest.recall).all()


def test_crowded_trees_keep_long_prefixes():
    forest = nc.Forest()
    sizes = np.ones((1, forest.trees, 4), int) * 2
    sizes[0, :8, :3] = 5000
    depths = forest.matched_depths(sizes)[0]
    assert (depths[:8] == forest.depth).all() and depths[8:].min() < forest.depth - 1
    with pytest.raises(ValueError):
        nc.Forest(trees=4)


def test_common_counts_against_sets():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 60, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(400) < 0.8], rng.choice(base[:50] + np.uint64(7), 5), rng.integers(0, 1 << 60, 30, dtype=np.uint64)])) for _ in range(90)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    other = ~np.eye(len(sets), dtype=bool)
    assert (nc.common_counts(np.concatenate(sets), bounds) == want)[other].all()
    assert (nc.common_counts(np.concatenate(sets), bounds, 31) == want[:31, 31:]).all()


def test_one_large_family(spark, monkeypatch):
    """20,000 different texts that nearly all link: each text is shipped once a block, its links are those of brute force."""
    monkeypatch.setattr(nc, "BLOCK_TEXTS", 4096)
    rng = np.random.default_rng(8)
    # text i lacks word i % 200 of 200 common ones and has a last word of its own
    rows = [(i, " ".join(f"w{k}" for k in range(200) if k != i % 200) + f" end{i}") for i in range(20_000)]
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string").repartition(8)
    found = nc.near_copies(df).agg(F.min("class_id"), F.max("class_id"), F.min("n_links"), F.max("n_links"), F.count("*")).first()
    # two texts lack up to ten of some 195 n-grams and differ in one more each: all pairs are over the threshold
    assert tuple(found) == (0, 0, 19_999, 19_999, 20_000)


def test_min_hash_estimates_similarity():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = a.copy()
    b[:110] = rng.integers(0, 1 << 63, 110, dtype=np.uint64)
    found = nc.min_hashes(np.concatenate([a, b]), np.array([0, 1000, 2000]), 2000, 1)
    assert abs((found[0] == found[1]).mean() - 890 / 1110) < 0.05


def test_components(spark):
    from texloom.llm.graph import components

    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (200, 199)]
    rng = random.Random(1)
    rng.shuffle(edges)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100, 199: 199, 200: 199}


def test_components_of_a_long_path(spark, monkeypatch):
    """A path in the order of its ids takes rounds as its length's logarithm."""
    from texloom.llm import graph

    rounds = []
    monkeypatch.setattr(graph, "_order", lambda label, turn, own=graph._order: (rounds.append(turn), own(label, turn))[1])
    found = graph.components(spark.range(1000).selectExpr("id as a", "id + 1 as b"))
    assert found.count() == 1001 and {r["root"] for r in found.select("root").distinct().collect()} == {0}
    assert max(rounds) < 30
