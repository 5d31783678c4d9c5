"""Pivot search against the plain one."""

from __future__ import annotations

import numpy as np
import pytest

from studyloom.operators import vector_index, vectors


def frame(spark, rows):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows], "vec_id long, embedding array<float>")


def both(spark, stored, asked, k=5, **options):
    store = frame(spark, stored)
    queries = frame(spark, asked).toDF("query_id", "query")
    found, met = vector_index.search(vector_index.build_index(store, **{x: options[x] for x in options if x in ("pivots", "rows")}), queries, k, **{x: options[x] for x in options if x in ("query_rows", "pack")})
    want = sorted(map(tuple, vectors.top_k(store, queries, k).collect()))
    assert sorted(map(tuple, found.collect())) == want
    return met.count(), found.count()


@pytest.mark.parametrize("options", [{}, {"rows": 7, "query_rows": 3, "pack": 2}, {"pivots": 1, "rows": 16}])
def test_same_rows_as_the_plain_search(spark, options):
    rng = np.random.default_rng(1)
    for x in (rng.normal(size=(150, 6)), np.repeat(rng.normal(size=(5, 3)), 30, axis=0), rng.integers(0, 2, size=(120, 4))):  # spread, equal, many ties
        rows = list(enumerate(x))
        both(spark, rows, rows[::9] + [(1000, x[0] + 50.0)], **options)


def test_blocks_are_left_out_where_vectors_cluster(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8)) * 100
    rows = list(enumerate(np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 8))))
    met, _ = both(spark, rows, rows[::20], rows=50, query_rows=10)
    assert met < 0.4 * 40 * 10


def test_few_vectors(spark):
    assert both(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])], [(7, [1.0, 1.0])])[1] == 2
    assert both(spark, [], [(7, [1.0, 1.0])])[1] == 0
    assert both(spark, [(1, [1.0, 0.0])], [])[1] == 0
