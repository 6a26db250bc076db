"""Vector operators against brute force."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.llm import ann, graph, vector_join

ODD = [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] + [0.0] * 6), (904, [float("nan")] + [1.0] * 7), (905, [float("inf")] + [1.0] * 7), (906, [1.0] * 3)]


def sample(seed=0, n=400, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + rng.normal(0, 0.25, (n, dim))
    x[:120] = centres[0] + rng.normal(0, 0.03, (120, dim))  # one dense group
    x[130:135] = x[129]  # repeated vectors
    x[140] = -x[141]
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.fixture(scope="module")
def rows():
    return sample()


@pytest.fixture(scope="module")
def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows + ODD], "vec_id long, embedding array<double>, row string, unit string").repartition(5).cache()


def cosines(rows):
    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    return x @ x.T


@pytest.mark.parametrize("dense", [4, 10**9])
def test_links_and_components_equal_brute_force(vectors, rows, monkeypatch, dense):
    monkeypatch.setattr(vector_join, "DENSE", dense)  # with and without dense balls
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_join.linked_groups(vectors).collect()}
    s = cosines(rows) >= 0.9
    np.fill_diagonal(s, False)
    label = np.arange(len(rows))
    while True:
        new = np.array([min([label[i], *label[np.flatnonzero(s[i])]]) for i in range(len(rows))])
        if (new == label).all():
            break
        label = new
    assert got == {**{i: (int(s[i].sum()), int(label[i])) for i in range(len(rows))}, **{i: (0, i) for i, _ in ODD}}


def test_small_strips_and_tiles_find_the_same(vectors, rows, monkeypatch):
    monkeypatch.setattr(vector_join, "STRIP_ROWS", 40)
    monkeypatch.setattr(vector_join, "TILE_ROWS", 25)
    monkeypatch.setattr(vector_join, "DENSE", 10**9)
    got = {r["vec_id"]: r["n_links"] for r in vector_join.linked_groups(vectors).collect()}
    s = cosines(rows) >= 0.9
    assert all(got[i] == s[i].sum() - 1 for i in range(len(rows)))


def test_nearest_vectors_recall_and_scores(vectors, rows):
    got = ann.nearest_vectors(vectors, F.col("vec_id") % 5 == 0).toPandas()
    s = cosines(rows)
    np.fill_diagonal(s, -2)
    hit = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == [1, 2, 3, 4, 5] and (np.diff(part.score) <= 0).all() and q not in set(part.vec_id)
        np.testing.assert_allclose(part.score, s[q, part.vec_id], atol=1e-12)
        hit += len(set(part.vec_id) & set(np.argsort(-s[q], kind="stable")[:5]))
    assert got.query_id.nunique() == len([i for i, _ in rows if i % 5 == 0]) and hit / len(got) >= 0.9


def test_ties_go_to_the_smaller_id_and_few_candidates_are_all_returned(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"]) for r in ann.nearest_vectors(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 3)]


@pytest.mark.parametrize("list_rows", [2, 6, 40])
def test_every_query_gets_its_rows_with_outliers_and_copies(spark, list_rows):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 16))
    x[:60] = rng.normal(size=16) + rng.normal(0, 0.01, (60, 16))
    x[100:200:2] = x[101:200:2]  # pairs of copies
    x[-6:] = 0
    x[-6:, :6] = np.eye(6) * 50  # outliers
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    units, dim = ann.unit_vectors(df)
    got = ann.search(units, dim, F.lit(True), list_rows=list_rows).toPandas()
    assert got.groupby("query_id").size().tolist() == [5] * 300
    top = got[got["rank"] == 1].set_index("query_id").vec_id
    assert all(top[i] == i + 1 - 2 * (i % 2) for i in range(100, 200))
    for few in (1, 2, 4):
        assert ann.nearest_vectors(df.filter(F.col("vec_id") < few), F.lit(True)).count() == few * (few - 1)


def test_lists_are_balanced_on_the_sample():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2_200, 64))
    x[:300] = rng.normal(size=64) * 2 + rng.normal(0, 0.3, (300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    centres = ann.means(x, 400)
    n = np.bincount(ann.nearest(x, ann.balanced(x, centres))[0])
    assert n.min() >= 2 and n.max() <= 6 * 5.5 and 200 <= len(n) <= 600
    assert np.bincount(ann.nearest(x, centres)[0], minlength=400).min() < 2


def test_graph_walk_finds_all_near_centroids():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(300, 16))
    g = ann.centroid_graph(centres, 16)
    for q in rng.normal(size=(20, 16)):
        d = np.linalg.norm(centres - q, axis=1)
        want = set(np.flatnonzero(d <= 1.1 * d.min()))
        assert len(want - set(ann.search_graph(q, centres, g, 1.1))) <= 0.1 * len(want)


def test_empty_tables(spark, vectors):
    none = vectors.limit(0)
    assert vector_join.linked_groups(none).count() == 0 and ann.nearest_vectors(none, F.lit(True)).count() == 0
    odd = vectors.filter("vec_id >= 900 and vec_id < 906")
    assert vector_join.linked_groups(odd).filter("n_links > 0").count() == 0


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    got = {r["node"]: r["component"] for r in graph.components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, **{i: 200 for i in (200, 201, 202)}}
    assert collections.Counter(got.values())[0] == 41
