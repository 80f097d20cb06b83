import numpy as np
import pytest

from clickstack.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, anchor_block string, v string"


def brute(rows):
    """Every contract step in plain Python over exact integers."""
    import math

    held = {}
    for vec_id, vector, label, *_ in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        own = (label, [math.floor(256 * x) for x in vector])
        held[vec_id] = min(held.get(vec_id, own), own)
    out = []
    for a, (label, v) in held.items():
        if a % 100:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in held.items()}
        order = lambda ids: sorted(ids, key=lambda i: (-score[i], i))
        for p in order(i for i, (lab, _) in held.items() if lab == label and i != a)[:5]:
            fit = order(i for i, (lab, _) in held.items() if lab != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p])
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fit[:5])]
    return sorted(out)


def made(n, seed, dims=6, scale=1.0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(7, dims)) * scale
    rows = [(int(i), [float(x) for x in base[rng.integers(7)] + rng.choice([0, 0.05], dims)], int(rng.integers(3)), "x", "y") for i in range(n)]
    return rows


@pytest.mark.parametrize("scale", [1.0, 3e6, 1e13])
def test_equal_to_brute_force(spark, scale):
    rows = made(420, 5, scale=scale)  # few base vectors: many ties
    if scale == 1.0:
        rows += [(None, [1.0] * 6, 1, "", ""), (1000, None, 1, "", ""), (1100, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, "", ""),
                 (1200, [float("nan")] * 6, 1, "", ""), (1300, [float("inf")] * 6, 1, "", ""), (1400, [0.5] * 6, None, "", ""),
                 (1500, [], 1, "", ""), (1600, [0.4, -0.2], 0, "", ""), rows[100], (200, [9.0] * 6, 2, "", ""), (-300, [0.3] * 6, 1, "", "")]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = H.hard_negatives(table, block_rows=64, block_anchors=2)
    want = [r for r in brute(rows) if abs(r[4]) < 1 << 63]
    assert sorted(tuple(r) for r in got.collect() if abs(r.positive_score) < H._LONG) == want
    assert scale > 1e12 or len(want) > 50


def test_no_rows_and_no_anchors(spark):
    assert H.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    assert H.hard_negatives(spark.createDataFrame([(1, [1.0], 1, "", ""), (2, [1.0], 0, "", "")], SCHEMA)).collect() == []


@pytest.mark.parametrize("top", [3, 200, 1 << 20, 1 << 40])
def test_packed_products_are_exact(top):
    rng = np.random.default_rng(top)
    rows = rng.integers(-top, top + 1, (37, 5))
    anchor = rng.integers(-top, top + 1, 5)
    if top > 1 << 30:
        rows, anchor = rows.astype(object), anchor.astype(object)
    bias = max(0, -int(anchor.min()))
    packed = H.PackedRows(rows, bias, int(anchor.max()) + bias)
    want = [sum(int(x) * int(y) for x, y in zip(r, anchor)) for r in rows]
    assert [int(x) for x in packed.scores(anchor)] == want


def test_query_relabels_every_seventh_row(spark):
    from clickstack.llm import queries

    got = queries.op12(spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    told = [(r.vec_id, list(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in rows]
    assert sorted(tuple(r) for r in got.collect()) == brute(told)
