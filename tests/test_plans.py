"""Registered queries over small tables of their own."""

import random

import numpy as np

from texloom import registry


def run(spark, folder, name, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return registry.queries()[name](spark, str(folder)).collect()


LINES = "l_orderkey long, l_linenumber int, l_quantity double"


def test_orders_without_a_line_1_are_blocks(spark, tmp_path):
    lines = [(65, 3, 9.0), (65, 2, 14.0), (65, 2, 11.0), (66, 1, 7.0), (66, 4, 2.0), (129, 7, 23.0), (130, 5, 30.0)]
    q = {(1, 1): 11, (2, 1): 7, (1, 2): 23, (2, 2): 30}
    found = run(spark, tmp_path, "previous_frame", lineitem=(lines, LINES))
    assert {(r["bx"], r["by"]): (r["q"], r["prev_q"]) for r in found} == {(x, y): (v, q.get((x, y - 1))) for (x, y), v in q.items()}
    found = run(spark, tmp_path, "causal_neighbors")
    assert {(r["bx"], r["by"]): (r["endpoint"], r["predictor"]) for r in found} == {(1, 1): (3, 3), (2, 1): (3, 0), (1, 2): (3, 1), (2, 2): (2, 3)}
    found = run(spark, tmp_path, "combine_images")
    assert {(r["bx"], r["by"]): (r["color"], r["alpha"]) for r in found} == {(2, 1): (7, 11), (2, 2): (30, 23)}
    assert {(r["bx"], r["by"]) for r in run(spark, tmp_path, "neighbor_reuse")} == set(q)


def signs(code):
    return [1.0 if code >> i & 1 else -1.0 for i in range(16)]


def test_tour_has_codes_of_all_ids(spark, tmp_path):
    rows = [(i, signs(c)) for i, c in {0: 6, 399: 7, 400: 0, 5000: 65535, 5001: 7}.items()]
    found = run(spark, tmp_path, "selector_tour", embeddings=(rows, "vec_id long, embedding array<float>"))
    assert [r["code"] for r in sorted(found, key=lambda r: r["place"])] == [0, 6, 7, 65535]


def test_tour_of_every_code_of_16_bits(spark):
    from texloom.operators import entropy

    tour = [r["id"] for r in entropy.hamming_tour(spark.range(1 << 16), "id").orderBy("place").collect()]
    assert sorted(tour) == [*range(1 << 16)] and tour[:4] == [0, 1, 3, 2]


def test_hamming_neighbors_of_all_ids(spark, tmp_path):
    rng = random.Random(3)
    codes = {i: rng.choice([rng.randrange(1 << 16), 77, 79]) for i in [*range(40), *range(90, 170)]}
    found = run(spark, tmp_path, "hamming_neighbors", embeddings=([(i, signs(c)) for i, c in codes.items()], "vec_id long, embedding array<float>"))
    want = {(i, k + 1, *x[::-1]) for i, c in codes.items() for k, x in enumerate(sorted(((c ^ d).bit_count(), j) for j, d in codes.items())[:3])}
    assert len(found) == len(want) == 360 and {(r["vec_id"], r["rank"], r["pattern_id"], r["bits"]) for r in found} == want


def test_hamming_neighbors_of_a_row_without_id(spark, tmp_path):
    rows = [(0, signs(5)), (None, signs(5)), (3, signs(5)), (2, signs(4))]
    found = run(spark, tmp_path, "hamming_neighbors", embeddings=(rows, "vec_id long, embedding array<float>"))
    five = [(1, 0, 0), (2, 3, 0), (3, 2, 1)]
    want = {0: five, None: five, 3: five, 2: [(1, 2, 0), (2, 0, 1), (3, 3, 1)]}
    assert {(r["vec_id"], r["rank"], r["pattern_id"], r["bits"]) for r in found} == {(i, *x) for i, ranks in want.items() for x in ranks} and len(found) == 12


def test_labels_without_an_early_code_keep_their_rows(spark, tmp_path):
    rows = [(1, 0, [0.0] * 64), (70, 0, [1.0] * 64), (71, 5, [1.0] * 64), (90, 5, [3.0] * 64), (91, None, [3.0] * 64)]
    found = run(spark, tmp_path, "nearest_codeword_of_parent", embeddings=(rows, "vec_id long, label int, embedding array<float>"))
    assert {r["vec_id"]: (r["code"], r["error"]) for r in found} == {1: (1, 0.0), 70: (1, 64.0), 71: (71, 0.0), 90: (71, 256.0), 91: (None, None)}


def test_covariance_of_all_components(spark, tmp_path):
    rng = np.random.default_rng(5)
    v, label = rng.normal(size=(40, 64)).astype(np.float32), rng.integers(0, 10, 40)
    rows = [(i, x.tolist(), int(k)) for i, (x, k) in enumerate(zip(v, label, strict=True))]
    found = run(spark, tmp_path, "covariance_matrix", embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    want = np.cov(v.T.astype(float), aweights=label + 1, ddof=0)
    got = {(r["i"], r["j"]): r["covariance"] for r in found}
    assert len(found) == len(got) == 64 * 64
    assert all(abs(got[i + 1, j + 1] - want[i, j]) < 2e-6 for i in range(64) for j in range(64))
