import json
import random

import numpy as np
import pytest

from attestry.operators import drift

SCHEMA = "site string, stream string, file_no int, line_no int, record_key string, record_json string, path string, idx int"


def table(spark, files, site="s"):
    rows = []
    for n, records in files:
        for i, (key, record) in enumerate(records):
            rows.append((site, "t", n, i, key, record if record is None or isinstance(record, str) else json.dumps(record), "x", 7))
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, files):
    return sorted(tuple(r)[2:] for r in drift.drift(table(spark, files)).collect())


def test_each_kind_of_change(spark):
    a = [("k1", {"id": 1, "secs": 5, "o": {"x": 1, "y": "a"}, "old": True}), ("k2", {"id": 2, "secs": 6, "o": {"x": 2, "y": "b"}, "old": False})]
    b = [("k2", {"id": "2", "elapsed": 6, "o": {"x": 2, "z": "b"}, "new": 1}), ("k3", {"id": "3", "elapsed": 9, "o": {"x": 3, "z": "c"}, "new": 2})]
    assert changes(spark, [(1, a), (4, b)]) == [(4, "added", "new", ""), (4, "removed", "old", ""), (4, "renamed", "o.y", "o.z"), (4, "renamed", "secs", "elapsed"), (4, "type_changed", "id", "")]


def test_values_decide_and_inner_fields_hide(spark):
    a = [("k", {"a": 1, "o": {"p": 1}})]
    assert changes(spark, [(1, a), (2, [("k", {"b": 2, "q": {"p": 1}})])]) == [(2, "added", "b", ""), (2, "removed", "a", ""), (2, "renamed", "o", "q")]
    assert changes(spark, [(1, a), (2, [("other", {"b": 1, "o": {"p": 1}})])]) == [(2, "added", "b", ""), (2, "removed", "a", "")]
    assert changes(spark, [(1, a), (2, [("k", {"a": 1, "o": "text"})])]) == [(2, "type_changed", "o", "")]


def test_ties_go_to_the_more_similar_name(spark):
    a, b = [("k", {"page": 1, "dpi": 1})], [("k", {"dpi_used": 1, "page_no": 1})]
    assert changes(spark, [(1, a), (2, b)]) == [(2, "renamed", "dpi", "dpi_used"), (2, "renamed", "page", "page_no")]


def test_dirt(spark):
    a = [("k", {"a": 1}), ("k", {"a": 1}), ("b", "{broken"), (None, {"a": None}), ("c", None), ("d", "[1]"), ("e", "")]
    assert changes(spark, [(1, a), (2, [("k", {"a": 1.0})])]) == []
    assert drift.drift(spark.createDataFrame([], SCHEMA)).collect() == []
    assert changes(spark, [(1, [("k", {"a": 1})])]) == []


def test_unified_columns(spark):
    files = [(1, [("k", {"a": 1, "o": {"x": 1}})]), (2, [("k", {"b": 1, "p": {"x": 1}})]), (3, [("k", {"c": 1, "p": {"x": 1}})])]
    rows = {(r.file_no, r["column"], r.value) for r in drift.unified(table(spark, files)).collect()}
    assert rows == {(n, c, "1") for n in (1, 2, 3) for c in ("c", "p.x")}


@pytest.mark.parametrize("seed", range(30))
def test_assignment_is_best(seed):
    from itertools import permutations

    r = random.Random(seed)
    w = np.array([[r.choice([0, r.random()]) for _ in range(r.randint(1, 4))]] * 0 or [[r.choice([0, r.random()]) for _ in range(3)] for _ in range(r.randint(1, 4))])
    best = max(sum(w[i, j] for i, j in zip(rows, range(3)) if i is not None) for rows in permutations([*range(len(w)), None, None, None], 3))
    assert abs(sum(w[i, j] for i, j in drift.assign(w)) - best) < 1e-9
