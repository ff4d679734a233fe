"""Vector links against all pairs in double precision, and on rows with nulls, ties, repeats and odd components."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.llm import vector_links

KIND = "vec_id long, embedding array<double>"


def all_pairs(rows, least=0.9):
    """(id, n_links, component) of every row, by brute force."""
    sound = [k for k, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    near = {k: set() for k in range(len(rows))}
    for n, a in enumerate(sound):
        for b in sound[n + 1 :]:
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if len(x) == len(y):
                x, y = (np.ldexp(v, -np.frexp(np.abs(v).max())[1]) for v in (x, y))
                if (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= least:
                    near[a].add(b)
                    near[b].add(a)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((i, len(near[k]), i if i is None else min(rows[x][0] for x in seen)))
    return sorted(out, key=str)


def links(spark, rows, **more):
    df = spark.createDataFrame(rows, KIND).withColumn("node", F.lit("clash")).withColumn("band", F.lit("clash"))
    return sorted((tuple(r) for r in vector_links.vector_links(df, **more).select("id", "n_links", "component").collect()), key=str)


def grouped(rng, groups, size, width, noise):
    """Vectors around some centres, ids in no order."""
    centres = rng.normal(size=(groups, width))
    rows = (np.repeat(centres, size, 0) + noise * rng.normal(size=(groups * size, width))) * rng.uniform(0.1, 9, (groups * size, 1))
    return [(int(i), r.tolist()) for i, r in zip(rng.permutation(len(rows)), rows, strict=True)]


@pytest.mark.parametrize("leaf, width, noise, dense", [(1024, 64, 0.3, 0.05), (7, 40, 0.32, 0.05), (16, 5, 0.2, 0.0), (8, 33, 0.35, 1.0)])
def test_links_equal_all_pairs(spark, monkeypatch, leaf, width, noise, dense):
    monkeypatch.setattr(vector_links, "LEAF", leaf)
    monkeypatch.setattr(vector_links, "DENSE", dense)
    rows = grouped(np.random.default_rng(leaf), 25, 8, width, noise)
    got = links(spark, rows)
    assert got == all_pairs(rows) and any(n for _, n, _ in got)


def test_every_block_and_tile_size_gives_the_same_links():
    rng = np.random.default_rng(4)
    vectors = np.array([v for _, v in grouped(rng, 12, 9, 48, 0.33)])
    axes = np.linalg.qr(rng.normal(size=(48, 48)))[0]
    turned = (vector_links._units(vectors) @ axes).astype(np.float32)
    leaf = vector_links._Leaf(vector_links._leaf(0, 48, np.arange(len(vectors)), np.ones(len(vectors), np.int64), turned, vectors), 0)
    units = vector_links._units(vectors)
    wanted = {(a, b) for a, b in zip(*np.nonzero(units @ units.T >= 0.9), strict=True) if a < b}
    assert set(zip(*(p.tolist() for p in vector_links.linked(leaf, leaf, 0.9)), strict=True)) == wanted and wanted


def test_ties_at_the_threshold_are_links(spark):
    rows = [(k, [float(x) for x in v]) for k, v in enumerate([(1, 0, 0, 0), (9, 3, 3, 1), (9, 3, 3, 1.001), (-9, -3, -3, -1)], 1)]
    assert links(spark, rows) == all_pairs(rows) and ((1, 1, 1) in links(spark, rows))


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, None), (2, []), (3, [0.0, -0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, -0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (11, [1e200, 1e199]), (12, [1e-200, 1e-201]), (13, [0.0, 5.0]),
        (13, [0.0, 5.0]), (7, [0.0, 1.0]), (14, [5.0]), (15, [-5.0]), (16, [3.0]),
    ]
    assert links(spark, rows) == all_pairs(rows)
    assert links(spark, []) == [] and links(spark, [(1, None), (2, [0.0])]) == [(1, 0, 1), (2, 0, 2)]
    kept = vector_links.keep_one_vector(spark.createDataFrame(rows, KIND).withColumn("kept_id", F.lit(1)))
    assert kept.columns == ["vec_id", "embedding", "kept_id"] and {r.vec_id for r in kept.collect()} == {i for i, _, c in all_pairs(rows) if i == c}


def test_a_large_group_of_copies_stays_small(spark):
    """Near copies of one vector: counts and forests come out of a task, not pairs."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=32)
    vectors = np.concatenate([base + 0.05 * rng.normal(size=(3000, 32)), np.repeat(rng.normal(size=(1, 32)), 1500, 0)])
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    got = vector_links.vector_links(spark.createDataFrame(rows, KIND)).groupBy("component", "n_links").count().collect()
    assert {tuple(r) for r in got} == {(0, 2999, 3000), (3000, 1499, 1500)}
