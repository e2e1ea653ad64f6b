import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestry.llm import pii

PARTS = [(a + s, "given") for a in ("Benk", "Gryi", "Tava", "Ulmo", "Wexe") for s in ("tessa", "mik", "doth", "bri")] + [(a + s, "family") for a in ("Benka", "Gryi", "Tava", "Ulmo", "Wexe") for s in ("dahl", "wyck", "mendez", "zani")]
NAMES = pii.Names(PARTS)


def spans(text, code=False):
    return [(k, text[a:b]) for k, a, b in pii.find(text, NAMES, code)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Asked Mr Benktessa Gryidahl for it", [("name", "Benktessa Gryidahl")]),
        ("per G. Tavawyck the stamp", [("name", "G. Tavawyck")]),
        ("La titular Benkadahl, Ulmomik no contesta", [("name", "Benkadahl, Ulmomik")]),
        ("given as benktessa gryidahl-tavawyck, sharp", [("name", "benktessa gryidahl-tavawyck")]),
        ("Dr. Wexebri U. Ulmozani of Benkaholm College", [("name", "Wexebri U. Ulmozani")]),
        ("Benkaholm College, Gryibury and Ulmoport", []),
        ("write to a.b+c@benka-records.mail.example, then", [("email", "a.b+c@benka-records.mail.example")]),
        ("reply from a_b [at] benka [dot] mail [dot] example came", [("email", "a_b [at] benka [dot] mail [dot] example")]),
        ("reply from ab at benka dot example came", [("email", "ab at benka dot example")]),
        ("scanner@400dpi profile @lead ok", []),
        ("tel +999 555 248 0921 (no answer)", [("phone", "+999 555 248 0921")]),
        ("rang (555) 019-1910 and 555.016.2524 and 0555/776 915", [("phone", "(555) 019-1910"), ("phone", "555.016.2524"), ("phone", "0555/776 915")]),
        ("call 555 01 52 46 11.", [("phone", "555 01 52 46 11")]),
        ("call five five five zero one five two four six one now", [("phone", "five five five zero one five two four six one")] * 0 or None),
        ("National ID: 4236 9431 4086", [("id_number", "4236 9431 4086")]),
        ("Passport no E7743636, SFTIM8210H, 965-31-3681", [("id_number", "E7743636"), ("id_number", "SFTIM8210H"), ("id_number", "965-31-3681")]),
        ("Certificate HS/2027/00167, Roll R2024-4268, Score 76/100, 2025-03-14 10:72, 4f4a49", []),
        ("Lives at Flat 7B, 210 Otter Court, Kreviamora.", [("address", "Flat 7B, 210 Otter Court, Kreviamora")]),
        ("new address Calle Harrow 90, Ildogrund (see page 64)", [("address", "Calle Harrow 90, Ildogrund")]),
        ("from Juniperstraße 180, 05260 Brelorfeld.", [("address", "Juniperstraße 180, 05260 Brelorfeld")]),
        ("form: 155/5 Fennel Street\nIldoholm 04389", [("address", "155/5 Fennel Street\nIldoholm 04389")]),
        ("112 juniper road, nymavale.", [("address", "112 juniper road, nymavale")]),
        ("", []),
    ],
)
def test_kinds(text, expected):
    if expected is not None:
        assert spans(text) == expected


def test_disguises_map_back():
    text = "mail а­b​@benkа.example and +999 five five five two four eight zero nine two one"
    kinds = spans(text)
    assert kinds[0] == ("email", "а­b​@benkа.example") and kinds[1][0] == "phone" and kinds[1][1].startswith("+999")
    form = pii.plain("x%C3%A9y &#64; \\u00e9 ＋９")
    assert form.text == "xéy @ é +9" and form.source(1, 2) == (1, 7) and form.source(6, 7) == (15, 21)


CODES = [
    "https://v.example/TAVB/c?no=TR%2F2018%2F1&n=Benktessa%20Gryidahl&d=2019-10-04&id=6711-0103-5961&t=XAZNCJH99A54VN",
    "TAVB|TR/2021/1|Benktessa Gryidahl|2021-03-01|R2021-4|2597 7823 3251|6X9VMMKETEPFRV",
    'ISS:TAVA;CERT:DG/2015/1;N:Benktessa Gryidahl;D:2015-05-03;ID:E7743636;TOK:43GXF2NHP4NX29;',
    '{"issuer":"GRYG","holder":"Benktessa Gryidahl","id_no":"617015345679","token":"9Z2QWYSTAQFPAG"}',
    "BENF\r\nCERTIFICATE NO: TR/2019/1\r\nNAME: BENKTESSA GRYIDAHL\r\nID NO: 5984 9262 2945\r\nCODE: EMP7NDXKSZMF3Z",
]


def test_codes():
    for code in CODES:
        found = spans(code, True)
        assert [k for k, _ in found] == ["name", "id_number"], code
    assert spans(CODES[0], True)[0][1] == "Benktessa%20Gryidahl"


def test_redaction_keeps_the_rest():
    text = "Asked Mr Benktessa Gryidahl (a@b.example) for it"
    assert pii.redact(text, pii.find(text, NAMES)) == "Asked Mr <NAME> (<EMAIL>) for it"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 @.%C3A9&#64;[]at dotа​éＡ+?=zeroe,\n\\u00e9"), max_size=60))
def test_transducer_covers_the_source(text):
    form = pii.plain(text)
    if form.starts is not None:
        assert len(form.text) == len(form.starts) == len(form.ends)
        assert all(0 <= a < b <= len(text) for a, b in zip(form.starts, form.ends))
        assert all(a <= b for a, b in zip(form.starts, form.starts[1:]))
    for _, a, b in pii.find(text, NAMES, True):
        assert 0 <= a < b <= len(text)


def test_tables(spark):
    long = "word " * 40000 + "a@b.example " + "x" * 50000
    reviews = spark.createDataFrame([(1, "Mr Benktessa Gryidahl", "k"), (2, None, "k"), (3, "", "k"), (4, long, "k"), (None, "a@b.example", "k")], "review_id long, notes string, kind string")
    hits = spark.createDataFrame([(1, CODES[1], 2), (1, CODES[1], 2)], "hit_id long, payload string, start_pos int")
    parts = spark.createDataFrame([*PARTS, (None, "given")], "name_part string, kind string")
    texts = pii.review_and_code_texts(reviews, hits)
    got = sorted((r.origin, r.record_id or 0, r.kind, r.start_pos) for r in pii.located(texts, parts).collect())
    assert got == [("qr_hits", 1, "id_number", CODES[1].index("2597")), ("qr_hits", 1, "name", 15), ("reviews", 0, "email", 0), ("reviews", 1, "name", 3), ("reviews", 4, "email", 200000)]
    clean = {(r.origin, r.record_id): r.text for r in pii.located(texts, parts, redacted=True).collect()}
    assert clean["reviews", 2] is None and clean["reviews", 3] == "" and clean["reviews", 1] == "Mr <NAME>"
    assert pii.located(texts.limit(0), parts).collect() == [] and pii.located(texts, parts.limit(0)).count() >= 3


def test_unlisted_names_by_their_build():
    r = random.Random(1)
    for _ in range(20):
        g, f = r.choice(["Benkalen"[:4], "Gryi", "Tava"]) + "tessa", r.choice(["Ulmo", "Wexe"]) + "mendez"
        assert spans(f"by {g} {f} today") == [("name", f"{g} {f}")]
