import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from attestry.functions.structural import Index, valid_json
from attestry.operators import nested

values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=5), c, max_size=4), max_leaves=12)


def tree(index, v):
    kind = chr(index.first[v])
    if kind not in "{[":
        return json.loads(index.text(v))
    _, children = index.children(np.array([v]))
    if kind == "[":
        return [tree(index, c) for c in sorted(children, key=lambda c: index.ord[c])]
    return {index.key(c): tree(index, c) for c in sorted(children, key=lambda c: index.ord[c])}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(values, st.sampled_from([None, 1]), st.booleans()), min_size=1, max_size=4))
def test_index_holds_all_values(docs):
    texts = [json.dumps(v, indent=i, ensure_ascii=a) for v, i, a in docs]
    index = Index(texts)
    assert [tree(index, i) for i in range(len(docs))] == [v for v, _, _ in docs]


def test_validity():
    assert valid_json('{"a": [1, 2]}') and valid_json("[" * 5000 + "]" * 5000)
    for bad in ("", "{", '{"a": NaN}', '{"a" 1}', "[1,]", "[" * 5000):
        assert not valid_json(bad)


REGION = {"page": 1, "kind": "photo"}


def payload(result, as_list=False):
    return json.dumps({"results": [{"analyzer_id": "a", "result": result}] if as_list else {"a": result}})


def rows(spark, payloads):
    df = spark.createDataFrame([(f"j{i}", p, "x") for i, p in enumerate(payloads)], "id string, payload_json string, child string")
    return sorted(tuple(r) for r in nested.children(df).collect())


def test_children_and_positions(spark):
    full = {"regions": [None, REGION], "check": {"facts": [{"label": "x", "value": "1"}]}, "raw": {"pages": [{"page": 1}, {"regions": [REGION, None, REGION]}]}}
    expected = [("a", "fact", 0, -1), ("a", "page_region", 1, 0), ("a", "page_region", 1, 2), ("a", "region", 1, -1)]
    strings = {"regions": json.dumps(full["regions"]), "check": json.dumps({"facts": json.dumps(full["check"]["facts"])}), "raw": full["raw"]}
    for p in (payload(full), payload(full, True), json.dumps(payload(full)), payload(strings)):
        assert [r[1:] for r in rows(spark, [p])] == expected
    single = {"regions": REGION, "check": None, "raw": "text"}
    assert rows(spark, [payload(single)]) == [("j0", "a", "region", 0, -1)]


def test_nothing_from_empty_broken_or_null(spark):
    assert rows(spark, [None, "", "{", "3", '"x"', "[]", '{"results": null}', '{"results": {"a": null}}', payload({"regions": []})]) == []
    empty = spark.createDataFrame([], "id string, payload_json string")
    assert nested.children(empty).collect() == []


def test_repeated_rows_count_once_and_long_texts_work(spark):
    p = payload({"regions": [REGION] * 3000, "note": "x\\\" {[" * 20000})
    df = spark.createDataFrame([("j", p), ("j", p), (None, p)], "id string, payload_json string")
    out = nested.children(df, body=True)
    assert out.count() == 6000 and json.loads(out.first().body) == REGION
