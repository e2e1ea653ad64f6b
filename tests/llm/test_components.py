import random

import pytest

from attestry.llm.components import components, job_groups

SCHEMA = "job_id string, other_id string, n string, label string, u int"


def expected(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {(v, find(v)) for v in list(parent)}


def found(spark, pairs):
    return {tuple(r) for r in components(spark.createDataFrame([(a, b, "x", "y", 1) for a, b in pairs], SCHEMA)).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    hub = [("m0", f"v{i:03}") for i in range(60)]  # one vertex holds a third of the rows
    small = [(f"v{r.randint(0, 400):03}", f"v{r.randint(0, 400):03}") for _ in range(120)]
    pairs = hub + small + small[:10] + [(b, a) for a, b in small[:10]] + [(None, "q"), ("q", None), ("s", "s")]
    assert found(spark, pairs) == expected(pairs)


def test_chains_hanging_from_the_giant(spark):
    star = [("a0", f"b{i:03}") for i in range(40)]
    chain = [("b000", "c000")] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    alone = [(f"0{i:03}", f"0{i + 1:03}") for i in range(50)]
    below = [("c060", "Z")]  # smaller than all that the search reached
    pairs = star + chain + alone + below
    assert found(spark, pairs) == expected(pairs)


def test_nothing(spark):
    assert found(spark, []) == set() and found(spark, [(None, None), ("a", "a")]) == set()


def test_ids_are_normalised_and_leads_left_out(spark):
    a, b, c = "0" * 31 + "a", "0" * 31 + "b", "0" * 31 + "c"
    rows = [("Same face", a.upper() + " ", f"{b[:8]}-{b[8:12]}-{b[12:16]}-{b[16:20]}-{b[20:]}"), ("Face near miss", b, c), (None, c, " "), ("Same face", "", c)]
    df = spark.createDataFrame(rows, "pair_type string, job_id string, other_id string")
    assert {tuple(r) for r in job_groups(df).collect()} == {(a, a), (b, a)}
