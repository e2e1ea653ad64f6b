"""Queries do the whole of their job: cases of the first advice."""

import __spark_entry__ as entry

QUERIES = entry.queries()
PAIRS = "pair_id bigint, pair_type string, job_id string, other_id string, score double"
A, B, C, D, E, G = (f"{i:032x}" for i in range(10, 16))
DASHED_B = f" {B[:8]}-{B[8:12]}-{B[12:16]}-{B[16:20]}-{B[20:].upper()}"


def stored(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def pairs(spark, tmp_path):
    rows = [
        (1, "Face near miss", A, E, 0.3),
        (2, "Same QR payload", D, E, None),
        (3, "Identical file", A, B, None),
        (4, "Same face", C, DASHED_B, 0.36),
        (5, "Same face", G, " ", 0.9),
        (6, "Same QR payload", G, None, None),
        (7, "Face near miss", G, A, 0.3),
    ]
    return stored(spark, tmp_path, "pairs", rows, PAIRS)


def groups(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    out = {}
    for x in list(parent):
        out.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in out.values()}


def test_duplicate_clusters_link_by_all_confirmed_kinds(spark, tmp_path):
    got = dict(map(tuple, QUERIES["duplicate_clusters"](spark, pairs(spark, tmp_path)).collect()))
    assert got == {D: "C1", E: "C1", A: "C2", B: "C2", C: "C2"}


def test_duplicate_clusters_equal_union_find(spark, data):
    bare = lambda x: "".join(c for c in (x or "").lower() if not c.isspace() and c not in "{}-")
    rows = spark.read.parquet(f"{data}/pairs.parquet").where("pair_type <> 'Face near miss'").collect()
    links = {(bare(r.job_id), bare(r.other_id)) for r in rows}
    expected = groups((a, b) for a, b in links if a and b and a != b)
    found = {}
    for r in QUERIES["duplicate_clusters"](spark, data).collect():
        found.setdefault(r.cluster, set()).add(r.id)
    assert {frozenset(g) for g in found.values()} == expected


def test_pair_listing_has_all_pairs_and_clusters_of_all_confirmed_kinds(spark, tmp_path):
    got = sorted((r.position, r.pair_id, r.cluster, r.evidence_rank) for r in QUERIES["pair_listing"](spark, pairs(spark, tmp_path)).collect())
    assert [r[1:] for r in got] == [(2, "C1", 1), (3, "C2", 0), (4, "C2", 2), (1, "C2", 3), (6, None, 1), (5, None, 2), (7, None, 3)]


def test_baseline_drift_keeps_long_lines(spark, tmp_path):
    rows = [(1, "a", "certificate", "c" * 60 + "\nshort"), (2, "a", "certificate", "c" * 60 + "\nshort"), (3, "a", "marksheet", "m" * 60 + "\nshort")]
    at = stored(spark, tmp_path, "documents", rows, "doc_id bigint, source string, kind string, text string")
    assert {(r.line, r.state) for r in QUERIES["template_baseline_drift"](spark, at).collect()} == {("c" * 60, "missing"), ("m" * 60, "new")}


def test_face_groups_normalise_ids_and_match_from_the_threshold(spark, tmp_path):
    rows = [(1, "Same face", A, DASHED_B, 0.9), (2, "Same face", B, C, 0.35), (3, "Same face", C, D, 0.34), (4, "Same face", C, " ", 0.9), (5, "Same face", None, C, 0.9)]
    got = QUERIES["face_groups"](spark, stored(spark, tmp_path, "pairs", rows, PAIRS)).collect()
    assert [tuple(r) for r in got] == [(A, 3)]


def test_link_parts_of_all_spellings(spark, tmp_path):
    links = ["HTTPS://A-B.Example:8443/C?NO=1", "\n https://a-b.example?no=1 \n", "\ufeffhttps://a-b.example/c", "http://a.example", "No link: https", "mailto:a@b.example", None]
    at = stored(spark, tmp_path, "qr_hits", list(enumerate(links)), "hit_id int, payload string")
    assert {tuple(r) for r in QUERIES["link_parts"](spark, at).collect()} == {("https", "a-b.example", 3, 2), ("http", "a.example", 1, 0)}
