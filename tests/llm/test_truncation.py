import random

from attestry.llm import truncation

SCHEMA = "fact_id long, source string, label string, value string, job_id string, measure string, open int"
WORDS = ["seal", "page", "line", "margin", "größe", "code", "scan", "border", "stamp", "date"]


def corpus():
    r = random.Random(2)
    fonts = [f"{f}-{s}" for f in ("Undine", "Tessera", "Quillon", "Marlow Sans") for s in ("Regular", "Medium", "Condensed")]
    rows, cut = [], set()

    def add(source, label, value, is_cut=False):
        if is_cut:
            cut.add(len(rows))
        rows.append((len(rows), source, label, value, f"j{len(rows)}", "x", 1))

    limits = {"a": (60, len), "b": (80, lambda s: len(s.encode())), "c": (None, len)}
    for source, (limit, size) in limits.items():
        for _ in range(500):
            text = " ".join(" ".join(r.choice(WORDS) for _ in range(r.randint(3, 9))).capitalize() + "." for _ in range(r.randint(1, 4)))
            short = text
            while limit and size(short) > limit:
                short = short[:-1]
            broken = source == "c" and r.random() < 0.05
            if broken:
                short = text[: r.randint(5, len(text) - 2)]
            lost = short != text and not short.endswith((".", ". "))
            if short != text and not lost:
                continue  # cut just behind a sentence: nothing shows it
            add(source, "Findings", short, lost)
        for _ in range(60):
            add(source, "Findings", r.choice(["No seal", "Checked by hand"]))
        for _ in range(200):
            value = ", ".join(r.choice(fonts) for _ in range(r.randint(1, 6)))
            if limit and size(value) > limit:
                short = value[:limit]
                if short in value and short.rsplit(", ", 1)[-1] not in fonts:
                    add(source, "Fonts", short, True)
            else:
                add(source, "Fonts", value)
        for _ in range(60):
            add(source, "Digest", "".join(r.choice("0123456789abcdef") for _ in range(40)))
    add("c", "Digest", "0123456789abcdef0123", True)
    add("c", "Findings", '{"passes": [1, 2], "tool": "x"}')
    add("c", "Findings", '{"passes": [1, 2], "to', True)
    add("c", "Findings", "Seal seen �", True)
    for empty in (None, "", " "):
        add("c", "Findings", empty, empty == " ")
    return rows, cut


def test_finds_what_was_cut(spark):
    rows, cut = corpus()
    cut -= {r[0] for r in rows if r[3] == " "}
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r.fact_id for r in truncation.truncated(df).collect()} - {r[0] for r in rows if r[3] == " "}
    assert len(found & cut) >= 0.97 * len(cut)
    assert len(found - cut) <= 0.03 * len(cut)
    limits = {r.source: (r.measure, r.limit) for r in truncation.report(df).collect()}
    assert limits["a"] == ("characters", 60) and limits["b"] == ("utf8", 80) and limits["c"] == (None, None)


def test_repeated_rows_nulls_and_nothing(spark):
    rows, cut = corpus()
    again = [(r[0] + 10**6, *r[1:]) for r in rows]
    nulls = [(2 * 10**6, None, None, "x", None, None, None), (None, "a", "Findings", "Seal and pa", "j", None, None)]
    df = spark.createDataFrame(rows + again + nulls, SCHEMA)
    found = {r.fact_id for r in truncation.truncated(df).collect()}
    assert {f for f in found if f is not None and f < 10**6} == {f - 10**6 for f in found if f is not None and 10**6 <= f < 2 * 10**6}
    assert None in found
    empty = spark.createDataFrame([], SCHEMA)
    assert truncation.truncated(empty).collect() == [] and truncation.report(empty).collect() == []


def test_measures(spark):
    from pyspark.sql import functions as F

    v = 'a&b "ü"\n🙂'
    got = spark.range(1).select(*(c.alias(n) for n, c in truncation.measures(F.lit(v)).items())).first().asDict()
    assert got["characters"] == 9 and got["utf8"] == len(v.encode()) and got["utf16"] == len(v.encode("utf-16-le")) // 2
    assert got["json_ascii"] == len(__import__("json").dumps(v)) - 2 and got["html"] == len(__import__("html").escape(v)) and got["crlf"] == 10


def test_several_limits_and_sentences_that_end_in_an_abbreviation(spark):
    r = random.Random(8)
    rows, cut, whole = [], {}, set()
    for source, limits in (("a", {"Note": 60, "Reason": 90}), ("b", {}), ("c", {})):
        for label in ("Note", "Reason"):
            for _ in range(400):
                text = " ".join(" ".join(r.choice(WORDS) for _ in range(r.randint(3, 9))).capitalize() + r.choice([".", ".", " todavía no."]) for _ in range(r.randint(1, 5)))
                limit = limits.get(label, 10**6)
                if len(text) > limit and text[limit - 1] != ".":
                    cut[len(rows)] = limit
                elif text.endswith(" no.") and len(text) <= limit:
                    whole.add(len(rows))
                rows.append((len(rows), source, label, text[:limit], f"j{len(rows)}", "", 0))
    found = {r.fact_id: r for r in truncation.truncated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(cut) > 100 and set(cut) <= set(found) and all(found[k].limit == n and found[k].by_limit for k, n in cut.items())
    assert len(whole) > 100 and not whole & set(found)
