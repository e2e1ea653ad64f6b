"""Operators against plain twins and the fixtures of their definitions."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from attestry.functions import fields
from attestry.functions import text as T
from attestry.operators import features, grading, greedy, linkage, pages, signals, store, templates, windows
from attestry.sources import files, sinks


def test_cursor_and_pages(spark):
    rows = spark.createDataFrame([(f"b{i}", f"2025-01-0{1 + i // 2} 00:00:00") for i in range(6)], "id string, c string").select("id", F.col("c").cast("timestamp_ntz").alias("created_at"))
    every = [r.id for r in store.page(rows, 10).collect()]
    first = store.page(rows, 2).collect()
    cursor = store.encode_cursor(str(first[-1].created_at), first[-1].id)
    assert [r.id for r in first] + [r.id for r in store.page(rows, 2, cursor).collect()] == every[:4]
    assert [r.id for r in store.page(rows, 2, offset=2).collect()] == every[2:4]
    with pytest.raises(ValueError):
        store.decode_cursor("nonsense")
    with pytest.raises(ValueError):
        store.page(rows, 2, cursor, 1)


def test_store_mutations(spark):
    runs = spark.createDataFrame([("a", "completed", 0), ("b", "running", 0), ("c", "queued", 1)], "id string, status string, attempt int")
    once = store.recovered(runs)
    assert sorted(map(tuple, once.collect())) == [("a", "completed", 0), ("b", "queued", 1), ("c", "queued", 1)]
    batches = spark.createDataFrame([("b1", "p1"), ("b2", None)], "id string, project_id string")
    assert sorted(map(tuple, store.unfiled(batches, spark.createDataFrame([("p1",)], "id string")).collect())) == [("b1", None), ("b2", None)]
    merged = store.append_missing(batches, spark.createDataFrame([("b1", "x"), ("b3", "y"), ("b3", "y")], "id string, project_id string"), "id")
    assert merged.count() == 3


JOBS = "id string, batch_id string, batch_position int, sha256 string"


def test_payload_and_digest_links(spark):
    d = "ab" * 32
    jobs = spark.createDataFrame([("a", "x", 0, d), ("b", "x", 1, "SHA-256: " + d.upper()), ("c", "x", 2, None), ("d", "x", 3, T.EMPTY_FILE), ("e", "x", 4, T.EMPTY_FILE)], JOBS)
    hits = spark.createDataFrame([(1, "a", "A"), (2, "b", " A\n"), (3, "c", "B"), (4, "c", None), (5, "d", " ")], "hit_id long, job_id string, payload string")
    assert sorted(map(tuple, linkage.payload_holders(hits, jobs).collect())) == [("x", "a", "new", None, None, None), ("x", "b", "duplicate", 2, "a", "A"), ("x", "c", "new", None, None, None)]
    assert [tuple(r) for r in linkage.identical_files(jobs).collect()] == [("x", "b", "a")]
    faces = spark.createDataFrame([("b", "c", 0.81), ("C", "d", 0.31), ("d", "e", 0.11)], "job_id string, other_id string, score double")
    pairs = linkage.match_signals(jobs, hits, faces)
    assert sorted((r.pair_type, r.job_id, r.other_id) for r in pairs.collect()) == [("Face near miss", "c", "d"), ("Identical file", "b", "a"), ("Same QR payload", "b", "a"), ("Same face", "b", "c")]
    assert {tuple(r) for r in linkage.clusters(linkage.confirmed(pairs), "job_id", "other_id").collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
    timed = jobs.withColumn("created_at", F.col("batch_position"))
    assert [r.id for r in linkage.screenings_of(timed, d, "a").collect()] == ["b"]
    assert sorted(map(tuple, linkage.prior_screenings(timed).collect())) == [("a", 1, "b"), ("b", 1, "a")]


def test_clusters_and_names(spark):
    r = random.Random(3)
    edges = [(f"v{r.randint(0, 60):02}", f"v{r.randint(0, 60):02}", i) for i in range(45)] + [(f"c{i:02}", f"c{i + 1:02}", 100 + i) for i in range(40)] + [(None, "z", 200), ("z", "z", 201)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b, _ in edges:
        if a and b and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a string, b string, pos int")
    assert {tuple(x) for x in linkage.clusters(df, "a", "b").collect()} == {(v, find(v)) for v in parent}
    names = dict(map(tuple, linkage.named_clusters(df, "a", "b", "pos").collect()))
    assert names["c00"] == names["c40"] and set(names) >= set(parent)


def _twin_iou(a, b):
    w = max(0, min(a.x + a.width, b.x + b.width) - max(a.x, b.x))
    h = max(0, min(a.y + a.height, b.y + b.height) - max(a.y, b.y))
    return w * h / (a.width * a.height + b.width * b.height - w * h)


@pytest.mark.parametrize("seed", range(5))
def test_greedy_boxes_against_twin(seed):
    r = random.Random(seed)
    boxes = pd.DataFrame([(i, r.random(), r.random(), 0.1 + r.random() / 2, 0.1 + r.random() / 2, round(r.random(), 1)) for i in range(25)], columns=["ord", "x", "y", "width", "height", "confidence"])
    kept = []
    for b in sorted(boxes.itertuples(), key=lambda b: (-b.confidence, b.ord)):
        for k in kept:
            if _twin_iou(k[0], b) >= 0.35:
                k[1], k[2] = min(0.995, k[1] + 0.04), k[2] + 1
                break
        else:
            kept.append([b, b.confidence, 1])
    out = greedy.merge_boxes(boxes)
    assert [(o.ord, round(o.confidence, 9), o.merged) for o in out.itertuples()] == [(k[0].ord, round(k[1], 9), k[2]) for k in kept]
    faces = greedy.distinct_faces(boxes)
    assert len(faces) <= len(out) and faces.ord.is_unique


def test_peaks_families_lines():
    peaks = pd.DataFrame({"ord": [0, 1, 2], "x": [0, 5, 100], "y": [0, 0, 0], "strength": [1, 2, 1]})
    assert list(greedy.distinct_peaks(peaks).ord) == [1, 2]
    angles = pd.DataFrame({"ord": [0, 1, 2], "angle": [2.0, 175.0, 90.0]})
    assert list(greedy.orientation_families(angles).family) == [0, 0, 1]
    parts = pd.DataFrame({"ord": [0, 1, 2, 3], "x": [0, 5, 0, 0], "y": [0, 5, 30, 9], "height": [10, 10, 10, 10]})
    lines = greedy.text_lines(parts)  # 9 is too far from the mean of 0 and 5, and 30 from 9
    assert list(lines.ord) == [0, 1, 3, 2] and list(lines.line) == [0, 0, 1, 2]
    faces = pd.DataFrame({"ord": [0, 1], "x": [0.0, 30.0], "y": [0.0, 0.0], "width": [20.0, 100.0], "height": [20.0, 100.0], "confidence": [0.9, 0.8]})
    assert len(greedy.distinct_faces(faces)) == 2 and len(greedy.distinct_faces(faces.assign(x=[0.0, -30.0], y=[0.0, -30.0]))) == 1  # within a third of the larger face


def test_pages(spark):
    pairs = spark.createDataFrame([("j", 1, 2, 88.0), ("j", 1, 3, 41.0), ("j", 2, 3, 44.0)], "j string, page_a int, page_b int, score double")
    assert sorted(tuple(r)[1:] for r in pages.worst_per_page(pairs, "j").collect()) == [(1, 41.0), (2, 44.0), (3, 41.0)]
    spans = spark.createDataFrame([("k", 0.0, 1.0), ("k", 1.5, 2.0), ("k", 9.0, 9.5), ("k", 0.1, 8.5)], "k string, s double, e double")
    assert sorted(tuple(r)[1:] for r in pages.merged_intervals(spans, "k", "s", "e", 0.6).collect()) == [(0.0, 9.5, 4)]
    assert spark.range(1).select(files.tiles(10, 5, 4, 3).alias("t")).first().t == [(x, y) for y in (0, 1) for x in (0, 3, 6)]


def test_windows(spark):
    e = spark.createDataFrame([("u", i, f"2025-01-01 00:{m:02}:00") for i, m in enumerate([0, 5, 20, 2])], "u string, i int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = windows.failures_in_window(e, "u", "t", "true", 15, 3).orderBy("t").collect()
    assert [(r.failures, r.locked) for r in got] == [(1, False), (2, False), (3, True), (2, False)]
    assert [r.rollback for r in windows.clock_check(e, "u", "t", "i").orderBy("i").collect()] == [False, False, False, True]


def test_text_functions(spark):
    def one(c):
        return spark.createDataFrame([("  ABCDEF+Brindle Mono-Bold ", "a%20b")], "s string, u string").select(c.alias("x")).first().x

    assert one(T.font_key(F.trim("s"))) == "brindlemonobold"
    assert one(T.key_of(F.lit(" Date of Issue: "))) == "date_of_issue"
    assert one(T.terms(F.lit("What is the registration number of the page?"))) == ["registration", "number"]
    assert one(T.pdf_date(F.lit("D:20260102"))) == 20260102000000 and one(T.pdf_date(F.lit("x"))) is None
    assert one(T.clamp_int(F.lit("999"), 1, 50, 7)) == 50 and one(T.clamp_int(F.lit("x"), 1, 50, 7)) == 7
    assert one(T.base64_text(F.lit("aGVsbG8"))) == "hello" and one(T.base64_text(F.lit("?"))) is None
    assert one(T.nfc(F.lit("é  x"))) == "é x" and one(T.folded(F.lit("Gr\u00f6\u00dfe-1"))) == "gro e 1"
    assert one(T.html_text(F.lit("<p>a&amp;b<script>x</script></p><p>c"))) == "a&b\nc"
    assert one(T.json_paths(F.lit('{"a": [1, {"b": "x"}]}'))) == {"a.0": "1", "a.1.b": "x"}
    assert one(T.partial_ratio(F.lit("asha"), F.lit("name: asha rao"))) == 100.0
    assert one(T.occurrences(F.lit("Page page"), F.lit("page"))) == 2
    assert set(one(T.date_forms(F.lit("2025-02-03")))) == {"2025-02-03", "03/02/2025", "03-02-2025", "3/2/2025", "3-2-2025"} == fields.dates_of("2025-02-03")
    assert one(T.date_forms(F.lit("HS/12"))) == ["HS/12"] and one(T.extract_date(F.lit("born 3.2.2025, seen 2026-01-01"))) == "03-02-2025" and one(T.extract_date(F.lit("x"))) is None
    assert one(F.to_json(T.fenced_json(F.lit('Sure: ```json\n{"a": 1}\n``` done')))) == '{"a":1}' and one(T.fenced_json(F.lit("none"))) is None
    assert one(T.producer_kind(F.lit("Adobe Photoshop ScanSnap"))) == "image_editor" and one(T.producer_kind(F.lit(""))) == "unknown" and one(T.font_class(F.lit("Open Sans"))) == "web"
    assert one(T.clamp_float(F.lit("2"), 0.1, 0.9, 0.35)) == 0.9 and one(T.allowed(F.lit(" HIGH"), ["low", "high"], "low")) == "high"
    assert one(T.title_case(F.lit("needs_review now"))) == "Needs Review Now"


def test_retrieval(spark):
    rows = [(0, 1, "ledger of seals", 9), (0, 2, "Seal number seal", 9), (0, 3, "index", 9), (0, 4, "a seal", 9)]
    df = spark.createDataFrame(rows, "d int, page int, t string, score int").drop("score")
    found = templates.rank_pages(df, "d", "page", "t", ["seal", "number"], [], None, 2).orderBy("position").collect()
    assert [(r.page, r.rank, r.position) for r in found] == [(1, 2, 1), (2, 1, 2)]
    assert [r.page for r in templates.rank_pages(df, "d", "page", "t", ["seal"], [3], 4, 1).collect()] == [4]


RAW = [
    ("font_analysis", '{"typefaces":[{"typeface":"Arial"}]}', "pass"),
    ("font_analysis", "{}", "fail"),
    ("photo_detection", '{"photo_found":true,"photo_count":1}', "pass"),
    ("photo_detection", '{"photo_found":false,"photo_count":0,"search_effort":"low"}', "inconclusive"),
    ("photo_detection", '{"photo_found":false,"photo_count":0}', "fail"),
    ("font_analysis", '{"unique_fonts":[{"typeface":"Arial","embedded":false}]}', "fail"),
    ("font_analysis", '{"unique_fonts":[{"typeface":"B","embedded":true},{"font_name":"A","embedded":true}]}', "pass"),
    ("font_analysis", '{"unique_fonts":[{"typeface":"B","xref":0,"extension":"ttf"}]}', "fail"),
    ("font_analysis", '{"embedded_typefaces":[],"typefaces":["Arial"]}', "fail"),
    ("same_phone", '{"summary":{"overall_verdict":"likely_same_phone_or_workflow"},"pages":[{"page":1},{"page":2}]}', "pass"),
    ("same_phone", '{"summary":{"overall_verdict":"possibly_different_phone_or_workflow","same_phone_score":41},"pages":[{},{}]}', "fail"),
    ("same_phone", '{"summary":{"overall_verdict":"likely_same_phone_or_workflow"},"pages":[{"page":1}]}', "inconclusive"),
    ("moire", '{"file_verdict":"CLEAN"}', "pass"),
    ("moire", '{"file_verdict":"RECAPTURE"}', "fail"),
    ("qr_presence", '{"qr_count":1,"hits":[{"page":5,"data":"HS/1"}]}', "pass"),
    ("qr_presence", '{"hits":[{"page":5}]}', "fail"),
    ("qr_presence", '{"qr_count":1,"expected_min_codes":2}', "fail"),
    ("qr_presence", '{"qr_count":0,"deep_rescan_incomplete":"timeout"}', "inconclusive"),
    ("signature", '{"count":"1","regions":[{"page":1}]}', "pass"),
    ("signature", '{"count":0}', "fail"),
    ("tamper_scan", '{"document_probability":0.62,"review_threshold":0.35}', "fail"),
    ("tamper_scan", '{"document_probability":0.1}', "pass"),
    ("tamper_scan", '{"document_probability":"high"}', "inconclusive"),
    ("tamper_scan", '{"document_probability":0.1,"pages":[{},{}],"indeterminate_pages":2}', "inconclusive"),
    ("metadata", "{}", "info"),
    ("readability", '{"verdict":"","tests":[]}', "inconclusive"),
    ("readability", '{"verdict":"readable","tests":[{"status":"ok"}]}', "pass"),
    ("readability", '{"verdict":"poor_readability","tests":[]}', "fail"),
    ("readability", '{"verdict":"readable","tests_not_run":["ocr"]}', "inconclusive"),
    ("moire", '{"status":"error","detail":"Timed out"}', "error"),
    ("unknown", '{"risk":"high"}', "fail"),
    ("unknown", '{"status":"insufficient_data"}', "inconclusive"),
    ("unknown", "{}", "pass"),
    ("moire", '[{"file_verdict":"CLEAN"}]', "pass"),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, a, r) for i, (a, r, _) in enumerate(RAW)], "job_id int, analyzer_id string, r string").withColumn("raw", F.parse_json("r"))
    once = grading.normalized(df)
    assert [r.status for r in once.orderBy("job_id").collect()] == [s for _, _, s in RAW]
    assert set(grading.ANALYZERS) == set(grading.RULES)
    assert all(r.check.reason and r.check.criterion and r.summary for r in once.collect())


def graded(spark, *rows):
    df = spark.createDataFrame([(i, a, r) for i, (a, r) in enumerate(rows)], "job_id int, analyzer_id string, r string").withColumn("raw", F.parse_json("r"))
    return df, grading.normalized(df.drop("r")).orderBy("job_id").collect()


def test_bodies(spark):
    fonts = '{"unique_fonts":[{"typeface":"Quill","embedded":true},{"typeface":"Arial","embedded":false}]}'
    meta = '{"generation":{"kind":"scanner","producer":"S1","pages":3,"resaved_after_creation":true},"document_metadata":{"created_at":"2026-01-02","modified_at":"2026-01-03"},"issues":[{"signal":"editor_producer"},{"signal":"editor_producer"}]}'
    _, rows = graded(spark, ("font_analysis", fonts), ("metadata", meta), ("signature", '{"count":2,"regions":[{"page":3,"confidence":0.8},{"page":1}]}'), ("tamper_scan", '{"document_probability":0.62,"suspicious_regions_count":2}'), ("moire", '[1, 2]'), ("x", '{"summary":{"suspicious_pages":2,"suspicious_regions":3,"overall_risk":"Warning"}}'), ("x", '{"risk":"clean","issues":[1],"findings":[1,2]}'))
    facts = [{f.label: f.value for f in r.check.facts} for r in rows]
    assert facts[0] == {"Embedded fonts": "1", "Font names": "Quill", "Embedded font objects": "1", "Referenced fonts": "Arial"}
    assert facts[1]["Re-saved after creation"] == "Yes" and facts[1]["Editing signals found"] == "Produced by an image editor" and facts[1]["Pages"] == "3"
    assert facts[2] == {"Signatures found": "2", "Pages": "1, 3", "Highest confidence": "80%"}
    assert facts[3]["Whitener probability"] == "62%" and rows[3].findings_count == 2 and rows[4].status == "error"
    assert (rows[5].findings_count, rows[5].risk, rows[5].outcome) == (5, "medium", "review") and (rows[6].findings_count, rows[6].risk, rows[6].outcome) == (1, "low", "clear")


def test_regions_and_evidence(spark):
    df, _ = graded(
        spark, ("qr_presence", '{"hits":[{"page":1,"dpi":72,"variant":"rot90","points":[[10,20],[30,20],[30,50],[10,50]]},{"page":9,"dpi":72,"points":[[1,1]]}]}'), ("signature", '{"regions":[{"bbox_normalized":{"x0":0.9,"y0":0.2,"x1":1.4,"y1":0.3},"severity":"severe"},{"bbox_normalized":{"x0":0.1,"y0":0.1,"x1":0.1,"y1":0.3}}]}'),
        ("photo_detection", '{"photos":[{"bbox_px":[10,10,60,110],"source_size_px":[100,200],"page":2,"passed":true}]}'), ("x", '{"a":1,"status":"x","p_probability":0.256,"summary":{"k":true,"z":"text"}}'),
    )
    r = grading.regions(F.col("analyzer_id"), F.col("raw"), F.expr("map(1L, named_struct('width', 100D, 'height', 200D))"))
    rows = [[tuple(x) for x in row.r] for row in df.orderBy("job_id").select(r.alias("r")).collect()]
    assert rows[0] == [(1, "qr_code", "QR code", "low", 0.15, 0.825, 0.4, 0.15)]
    assert rows[1] == [(1, "signature", "Signature", "high", 0.9, 0.2, 0.1, 0.1)] and rows[2] == [(2, "document_photo", "Document photo 1", "low", 0.1, 0.05, 0.5, 0.5)] and rows[3] == []
    assert [(e.key, e.value) for e in grading.evidence(df).where("analyzer_id = 'x'").orderBy("position").collect()] == [("a", "1"), ("p_probability", "26%"), ("k", "true"), ("z", "text")]
    conf = spark.createDataFrame([('{"score":0.375}',), ('{"confidence":"x","probability":88.4}',), ("{}",)], "r string").select(grading.confidence_percent(F.parse_json("r")).alias("c"))
    assert [x.c for x in conf.collect()] == [38, 88, None]


def test_page_sheet(spark):
    df, _ = graded(
        spark, ("font_analysis", '{"unique_fonts":[{"typeface":"B","embedded":true,"pages_used":[1,3]},{"typeface":"A","embedded":true,"pages_used":[1]}]}'), ("tamper_scan", '{"pages":[{"page":1,"probability":0.04,"regions":[]},{"page":2,"probability":0.61,"regions":[{},{}]}]}'),
        ("same_phone", '{"pages":[{},{},{}],"pair_assessments":[{"page_a":1,"page_b":2,"same_phone_score":88},{"page_a":1,"page_b":3,"same_phone_score":41},{"page_a":2,"page_b":3,"same_phone_score":44}]}'), ("moire", '{"images":[{"page":2,"verdict":"CLEAN"},{"page":2,"verdict":"recapture"}]}'), ("metadata", '{"generation":{"pages":4}}'), ("photo_detection", '{"photo_found":true,"page":2}'),
    )
    one = df.select(F.lit("j").alias("job_id"), F.col("job_id").cast("bigint").alias("pos"), "analyzer_id", "raw")
    rows = [tuple(r)[1:] for r in pages.sheet(pages.page_values(one)).orderBy("page").select("job_id", "page", "fonts", "font_names", "photos", "signatures", "codes", "probability", "regions", "lowest_pair", "moire").collect()]
    assert rows == [(1, 2, "A, B", 0, None, None, 0.04, 0, 41.0, None), (2, 0, "", 1, None, None, 0.61, 2, 44.0, "Recapture"), (3, 1, "B", 0, None, None, None, 0, 41.0, None), (4, 0, "", 0, None, None, None, 0, None, None)]


def test_fields():
    doc = "Name: Asha Rao\nGender\nFemale\nDate of Birth\n1/2/2003\nPLACE OF BIRTH\nPUNE CITY\nName of Mother\nx1\nName of Father\nSita Rao\nRam Rao\nAddress: x\nMunicipal Board Pune\nDate of Registration: 03.02.2003"
    assert fields.document_fields(doc) == {"name": "ASHA RAO", "gender": "FEMALE", "date_of_birth": "01-02-2003", "place_of_birth": "PUNE CITY", "mother_name": "SITA RAO", "father_name": "RAM RAO", "registration_unit_name": "MUNICIPAL BOARD PUNE", "registration_date": "03-02-2003"}
    assert fields.page_fields("Name: A Rao\nName\tB Rao\nSex: Male\nDOB: soon") == {"name": "B RAO", "gender": "MALE"}
    held = fields.payload_fields("https://v.example/ABCD/c?no=HS%2F2020%2F1&n=A%20B")
    assert held["no"] == "HS/2020/1" and held["n"] == "A B" and held["url_domain"] == "v.example" and held["url_path_tail"] == "c"
    assert fields.payload_fields('{"a":{"b":[1,"x"]}}')["a_b_1"] == "x" and fields.payload_fields('<r a="1"><n>Asha</n></r>')["r_n"] == "Asha" and fields.payload_fields("eyJuYW1lIjogIkFzaGEifQ")["name"] == "Asha"
    assert fields.best_line("ASHA RAO", "x\nasha  rao, 3", 82)[:2] == (True, 100.0) and fields.best_line("01-02-2003", "on 1/2/2003", 82)[0]
    assert fields.best_line("Registrar Mohan Lal", "zz\nRegistrar Mohan Lol\n", 82)[3] == "fuzzy" and not fields.best_line("A" * 20, "x", 82)[0]
    assert fields.links(["https://a/b%20c", "https://a/b c", "x", "http://d"]) == ["https://a/b%20c", "http://d"]
    assert fields.is_person_line("Asha Rao") and not fields.is_person_line("Date Rao") and fields.is_place_line("PUNE, MH") and not fields.is_place_line("MAY 2020")
    assert fields.payload_fields("") == {} and fields.document_fields("") == {} and fields.xml_paths("<a") == {}


def test_features(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    f = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    assert math.isclose(one(features.pearson(f(1, 2, 3), f(2, 4, 6))), 1) and one(features.pearson(f(1, 1), f(1, 2))) is None and one(features.cosine(f(0, 0), f(1, 2))) is None
    assert math.isclose(one(features.mismatch_score(F.lit(0.1))), 100 * (1 - math.exp(-0.8)))
    s = lambda *n: one(features.document_risk(F.array(*(F.lit(x) for x in n)).cast("array<string>")))
    assert [s(), s("a"), s("editor_producer"), s("a", "b"), s("editor_producer", "incremental_update"), s("a", "b", "c")] == ["low", "low", "medium", "medium", "high", "high"]
    words = lambda line: one(features.anchor_words(F.split(F.lit(line), " ")))
    assert words("Issuing Authority: signed by the authorized signatory") == ["issuing authority", "signed", "authorized signatory"] and words("digitally signed by x") == []
    assert one(features.overall_risk(F.lit(None).cast("double"), F.lit(75.0), F.lit(0.0), F.lit(1), F.lit(0))) == "medium" and one(features.overall_risk(F.lit(None).cast("double"), F.lit(0.0), F.lit(80.0), F.lit(2), F.lit(1))) == "high"
    assert one(features.document_verdict(F.lit(79.0), F.lit(50.0))) == "compatible_with_same_phone" and one(features.document_verdict(F.lit(40.0), F.lit(40.0))) == features.DIFFERENT
    assert one(signals.condition_note(F.lit(0.1), F.lit(0.1), F.lit(0.001))) == "uneven lighting/shadow; soft/blurred capture"
    assert one(signals.code_verdict(F.lit(True), F.lit(0), F.lit(3), F.lit(2), F.lit(0))) == "review_url_check_failed" and one(signals.code_verdict(F.lit(False), F.lit(0), F.lit(0))) == "fail_no_qr"
    assert one(signals.whitener_review(F.lit(0.4), F.lit(0.5), F.lit(2), F.lit(0))) == "no_whitener_evidence" and one(signals.whitener_review(F.lit(None).cast("double"), F.lit(0.5), F.lit(2), F.lit(2))) == "insufficient_signal"
    assert one(signals.short_of(F.lit(1), F.lit(2), "codes")).note == "Expected at least 2 codes, found 1" and one(signals.short_of(F.lit(2), F.lit(2), "codes")) is None


def test_store_states_and_profiles(spark, tmp_path):
    got = spark.createDataFrame([("queued", 1, None, None), ("queued", 1, 2, None), ("running", 1, 2, 3), ("completed", 1, 2, None), ("completed", 3, 2, 4), ("completed", 1, 3, 2)], "s string, a int, b int, c int").select(store.illegal_state(*(F.col(c) for c in "sabc")).alias("f")).collect()
    assert [r.f for r in got] == [None, "queued job has been run", "running job needs its start only", "finished job lacks a time", "started before it was queued", "completed before it was started"]
    p = spark.createDataFrame([("2", "b" * 90, None, None), ("1", " a ", "g", None), ("3", " ", None, None)], "id string, name string, goal string, guidance string")
    assert [(r.id, len(r.name), r.goal) for r in files.profiles(p).collect()] == [("1", 1, "g"), ("2", 80, "")]
    assert len(spark.range(1).select(files.grid(10, 10, 3).alias("g")).first().g) == 9
    (tmp_path / "r" / "j1").mkdir(parents=True)
    (tmp_path / "r" / "j1" / "moire.json").write_text('{"file_verdict":"CLEAN"}')
    (tmp_path / "r" / "j1" / "metadata.json").write_text("{broken")
    raw = files.raw_results(spark, str(tmp_path / "r"), "json")
    assert sorted((r.job_id, r.analyzer_id, r.status) for r in grading.normalized(raw).collect()) == [("j1", "metadata", "error"), ("j1", "moire", "pass")]


def test_sources_and_sinks(spark, tmp_path):
    up = tmp_path / "up"
    (up / "deep").mkdir(parents=True)
    (up / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (up / "b.pdf").write_bytes(b"no pdf")
    (up / "deep" / "c.exe").write_bytes(b"x")
    came = files.uploads(spark, str(up))
    assert {(r.filename, r.blocker) for r in came.collect()} == {("a.pdf", None), ("b.pdf", "content"), ("c.exe", "type")}
    d = came.where("filename = 'a.pdf'").first().sha256
    held = spark.createDataFrame([("j1", 1, "sha256:" + d.upper(), "u"), ("j2", 2, d, "other")], "id string, created_at int, sha256 string, owner_user_id string")
    assert {(r.filename, r.prior, r.prior_id) for r in files.known_uploads(came, held, store.visible("u")).collect()} == {("a.pdf", 1, "j1"), ("b.pdf", 0, None), ("c.exe", 0, None)}
    (tmp_path / "l.csv").write_text("file,present\na.png, Yes\nb.png,0\n")
    assert {tuple(r) for r in files.labels(spark, str(tmp_path / "l.csv")).collect()} == {("a.png", True), ("b.png", False)}
    (tmp_path / "legacy").mkdir()
    (tmp_path / "legacy" / "1.json").write_text('{"id": "x", "project_id": "gone"}')
    (tmp_path / "legacy" / "2.json").write_text("{broken")
    new = files.legacy_records(spark, str(tmp_path / "legacy"), "id string, project_id string")
    done = files.imported(new, spark.createDataFrame([], "id string"), spark.createDataFrame([("p",)], "id string"))
    assert [tuple(r) for r in done.collect()] == [("x", None)]
    rows = spark.createDataFrame([("1", "=cmd", None), ("2", "<b>", 5)], "id string, name string, n int")
    sinks.batch_csv(rows, str(tmp_path / "csv"))
    assert [r.name for r in spark.read.option("header", "true").csv(str(tmp_path / "csv")).orderBy("id").collect()] == ["'=cmd", "<b>"]
    page = [r.html for r in sinks.batch_html(rows, "T", ["id"]).orderBy("position").collect()]
    assert len(page) == 4 and "<td>&lt;b&gt;</td>" in page[2] and "<td>—</td>" in page[1]
    sinks.write_html(sinks.batch_html(rows, "T", ["id"]), str(tmp_path / "html"))
    sinks.write_tables({"t": rows}, str(tmp_path / "tables"))
    assert spark.read.json(str(tmp_path / "tables" / "t.json")).count() == 2
    assert '"n":null' in sinks.case_json(rows).orderBy("id").first().report
    other = spark.createDataFrame([("1", "=cmd", None), ("3", "z", 1)], "id string, name string, n int")
    assert sorted((r.id, r.side) for r in sinks.manifest_difference(rows, other).collect()) == [("2", "missing"), ("3", "unexpected")]


def test_stream_upsert(spark, tmp_path):
    from attestry.streaming import intake

    write = intake.upsert(str(tmp_path / "t"), "k", "v")
    write(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), 0)
    write(spark.createDataFrame([("a", 2)], "k string, v int"), 1)
    place = spark.read.text(str(tmp_path / "t" / "current")).first().value
    assert sorted(map(tuple, spark.read.parquet(place).collect())) == [("a", 2), ("b", 1)]


def test_robust_outliers(spark):
    rows = [("g", i, float(v)) for i, v in enumerate([1, 1.1, 0.9, 1.05, 9])]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    assert [r.i for r in pages.outliers(df, "g", "i", "v", 2.5).collect()] == [4]
    p = spark.createDataFrame([("g", 0.5), ("g", 0.5), ("g", 0.1)], "g string, p double")
    got = pages.decayed_noisy_or(p, "g", "p").first().score
    assert math.isclose(got, 1 - 0.5 * (1 - 0.35), rel_tol=1e-9)


def test_nearest_earlier_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(linkage, "BLOCK_ROWS", 7)
    r = random.Random(6)
    rows = [(r.choice("ab"), i, [r.choice([0.0, 1.0, 0.5]) for _ in range(4)]) for i in range(60)] + [(None, 60, [1.0] * 4), ("a", 61, None)]

    def cos(v, w):
        n = math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in w))
        return round(sum(x * y for x, y in zip(v, w)) / n, 9) if n else 0.0

    expected = set()
    for g, i, v in rows[:60]:
        scored = [(cos(v, w), -j) for h, j, w in rows[:60] if h == g and j < i]
        if scored and max(scored)[0] >= 0.35:
            expected.add((i, -max(scored)[1]))
    found = linkage.nearest_earlier(spark.createDataFrame(rows, "g string, i int, v array<float>"), "g", "i", "v")
    assert {(x.i, x.best) for x in found.collect()} == expected


def test_ordered_operators_with_a_hot_key(spark):
    from attestry.operators import ordered

    r = random.Random(8)
    rows = [(r.choice(["hot"] * 5 + ["a", "b", None]), i, r.randint(0, 99)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    by = {}
    for k, i, v in rows:
        by.setdefault(k, []).append((i, v))
    numbered = {(x.k, x.i): x.n for x in ordered.numbered(df, "k", ["i"]).collect()}
    around = {(x.k, x.i): (x.previous_v, x.next_v, x.position) for x in ordered.neighbours(df, "k", ["i"], "v").collect()}
    highs = {(x.k, x.i): x.high for x in ordered.highest_before(df, "k", ["i"], "v").collect()}
    sums = {(x.k, x.i): x.total for x in ordered.running_sum(df, "k", ["i"], "v").collect()}
    for k, own in by.items():
        for n, (i, v) in enumerate(own):
            assert sums[k, i] == sum(x for _, x in own[: n + 1])
            assert numbered[k, i] == n + 1
            assert around[k, i] == (own[n - 1][1] if n else None, own[n + 1][1] if n + 1 < len(own) else None, n)
            assert highs[k, i] == (max(x for _, x in own[:n]) if n else None)
    assert ordered.numbered(df.limit(0), "k", ["i"]).collect() == []


def test_groups_of_one_and_more(spark):
    rows = [("a", 0, 0.0, 0.0, 1.0, 1.0, 0.5), ("b", 1, 0.0, 0.0, 1.0, 1.0, 0.5), ("b", 2, 0.1, 0.0, 1.0, 1.0, 0.4), (None, 3, 0.0, 0.0, 1.0, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "k string, ord long, x double, y double, width double, height double, confidence double")
    out = greedy.by_group(df, ["k"], greedy.merge_boxes, "merged bigint", F.lit(1))
    assert {(r.k, r.ord, r.merged) for r in out.collect()} == {("a", 0, 1), ("b", 1, 2), (None, 3, 1)}
    assert greedy.by_group(df.limit(0), ["k"], greedy.distinct_faces).collect() == []


def test_detectors_and_passes(spark):
    def good(df):
        return df.select("job", F.lit(0.5).alias("confidence"))

    def broken(df):
        return df.select("nowhere")

    rows = pages.united([good, broken], spark.createDataFrame([("a",), ("b",)], "job string")).collect()
    assert sorted((r.detector, r.job, r.failure is None) for r in rows if r.job) == [("good", "a", True), ("good", "b", True)] and [r.detector for r in rows if r.failure] == ["broken"]
    p = spark.createDataFrame([("j", 1), ("j", 2)], "job string, page int")
    assert pages.decode_passes(p, "job", "page", F.array(F.lit(200), F.lit(300)), most=1).count() == 2 * 4 * 4
