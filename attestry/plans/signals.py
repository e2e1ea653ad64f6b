"""Queries: candidates, bands, ladders and comparisons over measured features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators import features, linkage, signals, store
from attestry.plans import evidence, texts
from attestry.plans.evidence import _BOXES as BOXES
from attestry.session import table

_W, _H = 2481.0, 3507.0  # an A4 page at 300 dots per inch


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit boxes as components of a page in pixels, a tenth of their size."""
    b = evidence.hit_boxes(spark, sf_dir)
    return b.select("hit_id", "job_id", "page", F.floor(F.col("x") * _W).alias("x"), F.floor(F.col("y") * _H).alias("y"), F.floor(F.col("width") * _W / 10).alias("width"), F.floor(F.col("height") * _H / 10).alias("height"))


def glyph_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("width"), F.col("height")
    return _parts(spark, sf_dir).where(signals.is_glyph(w, h, w * h / 2, F.lit(_W), F.lit(_H), F.lit(300))).select("hit_id", "width", "height")


def photo_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest boxes of a job's pages that may be photos, the eight largest a page."""
    kept = _parts(spark, sf_dir).where(signals.is_photo(F.col("width"), F.col("height"), F.lit(_W), F.lit(_H))).withColumn("area", F.col("width") * F.col("height"))
    return signals.largest(kept, ["job_id", "page"], "area", "hit_id", signals.PHOTO["top"]).select("hit_id", "area")


def row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of a page that stand on one row in short distances, as groups: those of three or more count, as kept; at test sizes none need be."""
    links = signals.row_links(_parts(spark, sf_dir), ["job_id", "page"], "hit_id", gap=8.0)
    n = linkage.clusters(links, "a", "b").groupBy("label").agg(F.count("*").alias("parts"))
    return n.select("label", "parts", (F.col("parts") >= signals.STROKE["group"]).alias("kept"))


def body_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components against the median of their page's ordinary text: hits as glyphs, their sides as ink and strokes."""
    p = _parts(spark, sf_dir).where("height > 0").select("hit_id", "job_id", "page", "height", (F.col("width") / F.col("height")).alias("boldness"), (1.0 / F.col("height")).alias("density"))
    n = features.body_norms(p, ["job_id", "page"], "height", {"boldness": 0.0, "density": 0.0})
    return n.select("hit_id", "field_text", *(F.round(c, 3).alias(c) for c in ("boldness_ratio", "density_ratio")))


def overwritten_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines as marks: those that two signals or more call overwritten, and those too thick, by flag."""
    li = table(spark, sf_dir, "lineitem")
    s = signals.overwriting_signals(F.col("l_quantity") / 20, F.col("l_extendedprice") / 25000, F.col("l_discount") * 4, 0.5 + F.col("l_tax"), F.col("l_tax") * 10)
    area, ordinary = F.col("l_quantity") * 10, F.col("l_linestatus") == "O"
    each = li.select("l_returnflag", s.alias("s"), signals.is_overwritten(s, area, ordinary).alias("over"), signals.is_thick(F.col("l_quantity") / 20, area, ordinary).alias("thick"))
    return each.groupBy("l_returnflag").agg(F.count_if("over").alias("overwritten"), F.count_if("thick").alias("thick"), F.sum(F.when(F.col("over"), F.size("s"))).alias("signals"))


def eye_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a page's hits as far apart as eyes are in a face of its size."""
    b = evidence.hit_boxes(spark, sf_dir).select("hit_id", "job_id", "page", (F.col("x") + F.col("width") / 2).alias("x"), (F.col("y") + F.col("height") / 2).alias("y"))
    return features.eye_pairs(b, ["job_id", "page"], "hit_id", F.lit(1.0), F.lit(1.0)).select("a_hit_id", "b_hit_id")


def noise_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "facts").where("value is not null")
    return f.groupBy("label").agg(F.count("*").alias("facts"), F.count_if(signals.is_noise(T.key_of(F.col("label")), F.col("value"))).alias("noise"))


def readability_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by score and level: of the sub-tests that facts ever name as failed, those that a fact does not name passed."""
    f = table(spark, sf_dir, "facts").where("label = 'Failed sub-tests' and value is not null and trim(value) <> ''")
    each = f.select("fact_id", F.explode(F.split("value", ", ")).alias("test"))
    known = each.groupBy("test").agg(F.count_distinct("fact_id").alias("n")).where("n >= 20 and test <> 'None'")
    ran = known.agg(F.count("*").alias("ran")).withColumn("one", F.lit(1))  # one row
    failed = each.join(known, "test", "left_semi").groupBy("fact_id").agg(F.count_distinct("test").alias("failed"), F.coalesce(F.bool_or(F.col("test") == "ocr_confidence"), F.lit(False)).alias("ocr"))
    rows = f.select("fact_id", F.lit(1).alias("one")).join(failed, "fact_id", "left").join(ran, "one").select(F.coalesce("failed", F.lit(0)).alias("failed"), "ran", F.coalesce("ocr", F.lit(False)).alias("ocr"))
    score = signals.readability_score(F.col("ran") - F.col("failed"), F.col("ran"))
    level = signals.readability_level(score, F.lit(0), ~F.col("ocr"), F.lit(True), F.when(F.col("ocr"), 1).otherwise(0))
    return rows.groupBy(score.alias("score"), level.alias("level")).agg(F.count("*").alias("facts"))


def word_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a job as recognised words, their length for their confidence: the mean, the share under 50, null under ten words."""
    f = table(spark, sf_dir, "facts").where("value is not null").select("job_id", F.pmod(F.char_length("value"), F.lit(101)).alias("c"))
    n = f.groupBy("job_id").agg(F.count("*").alias("words"), F.avg("c").alias("mean"), (100.0 * F.count_if(F.col("c") < 50) / F.count("*")).alias("low"))
    enough = F.col("words") >= 10
    return n.select("job_id", "words", F.when(enough, F.round("mean", 4)).alias("mean"), F.when(enough, F.round("low", 4)).alias("low"), (enough & (F.col("mean") > 40) & (F.col("low") < 65)).alias("passed"))


def code_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled fields of completed jobs' codes: those that the last reading repeats as the first one had them; jobs without a code have found none."""
    fields = texts.first_and_last_fields(spark, sf_dir).groupBy("job_id").agg(F.count("*").alias("total"), F.count_if(F.col("first_value") == F.col("last_value")).alias("matched"))
    found = table(spark, sf_dir, "qr_hits").select("job_id", F.lit(True).alias("found")).distinct()
    jobs = store.jobs(spark, sf_dir).where("status = 'completed'").select(F.col("id").alias("job_id"))
    joined = jobs.join(found, "job_id", "left").join(fields, "job_id", "left").na.fill(0, ["total", "matched"])
    return joined.groupBy(signals.code_verdict(F.coalesce("found", F.lit(False)), F.col("matched"), F.col("total")).alias("verdict")).agg(F.count("*").alias("jobs"))


def order_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: bands and tiers from their lines' discounts, quantities and prices."""
    li = table(spark, sf_dir, "lineitem")
    each = li.select("l_orderkey", (F.col("l_quantity") / 20).alias("ratio"), signals.triggered(discount=F.col("l_discount") > 0.05, tax=F.col("l_tax") > 0.04, price=F.col("l_extendedprice") > 50000, returned=F.col("l_returnflag") == "R").alias("s"))
    n = each.groupBy("l_orderkey").agg(F.max("ratio").alias("r"), F.count_if(F.col("ratio") > 1.8).alias("c"), signals.worst(signals.overwriting_tier(F.col("s"))).alias("overwriting"))
    return n.select("l_orderkey", signals.stroke_tier(F.coalesce("r", F.lit(0.0)), F.col("c")).alias("stroke"), "overwriting", signals.shortfall(F.col("c"), F.lit(2)).alias("shortfall"))


def chosen_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six pages of each job, the page of its first hit among them, as if each had 3 pages for each page seen."""
    h = table(spark, sf_dir, "qr_hits").dropDuplicates(["hit_id"]).where("page is not null")
    n = h.groupBy("job_id").agg((F.max("page") * 3).alias("total"), F.min_by("page", "hit_id").alias("first"))
    return n.select("job_id", "total", F.array_join(signals.chosen_pages(F.col("total"), 6, F.array("first")).cast("array<string>"), ",").alias("pages"))


def compared_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first values of a job's labelled fields against the last."""
    f = texts.first_and_last_fields(spark, sf_dir)
    c = signals.compared(f.select("job_id", "field", F.col("first_value").alias("v")), f.where("field <> 'roll'").select("job_id", "field", F.col("last_value").alias("v")), "job_id", "field", "v")
    return c.groupBy("field", "state").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (glyph_candidates, photo_candidates, row_groups, body_norms, overwritten_marks, eye_pairs, noise_facts, readability_scores, word_confidence, code_verdicts, order_tiers, chosen_pages, compared_fields)}

_PARTS = f"WITH RECURSIVE {BOXES}, parts AS (SELECT hit_id, job_id, page, CAST(floor(x * {_W}::DOUBLE) AS BIGINT) AS x, CAST(floor(y * {_H}::DOUBLE) AS BIGINT) AS y, CAST(floor(width * {_W}::DOUBLE / 10) AS BIGINT) AS width, CAST(floor(height * {_H}::DOUBLE / 10) AS BIGINT) AS height FROM boxes)"
_FIELDS = texts.SQL["first_and_last_fields"].strip()

SQL = {
    "glyph_candidates": f"{_PARTS} SELECT hit_id, width, height FROM parts WHERE height >= 15 AND height <= 150 AND width >= 4.5 AND width <= 255 AND width * height / 2 >= 60 AND NOT (width > 180 AND height > 105) AND width * height <= 0.10 * {_W * _H} AND width <= 0.55 * {_W} AND greatest(width, height) <= 12 * least(width, height)",
    "photo_candidates": f"{_PARTS} SELECT hit_id, width * height AS area FROM parts WHERE width * height / {_W * _H} > 0.003 AND width * height / {_W * _H} < 0.18 AND width / greatest(height, 1.0) > 0.4 AND width / greatest(height, 1.0) < 1.3 AND width > 40 AND height > 50 QUALIFY row_number() OVER (PARTITION BY job_id, page ORDER BY width * height DESC, hit_id) <= 8",
    "row_groups": f"""{_PARTS}, l AS (SELECT a.hit_id AS a, b.hit_id AS b FROM parts a JOIN parts b ON a.job_id = b.job_id AND a.page = b.page AND a.hit_id < b.hit_id
          AND abs((a.y + a.height / 2.0) - (b.y + b.height / 2.0)) <= 0.6 * greatest(a.height, b.height) AND greatest(a.x, b.x) - least(a.x + a.width, b.x + b.width) <= 8.0 * greatest(a.height, b.height)),
        g AS (SELECT a, b FROM l UNION SELECT b, a FROM l), reach(n, m) AS (SELECT a, a FROM g UNION SELECT r.n, g.b FROM reach r JOIN g ON g.a = r.m)
        SELECT label, count(*) AS parts, count(*) >= 3 AS kept FROM (SELECT n, min(m) AS label FROM reach GROUP BY n) GROUP BY 1""",
    "body_norms": f"""{_PARTS}, q AS (SELECT hit_id, job_id, page, height, width / height AS boldness, 1.0::DOUBLE / height AS density FROM parts WHERE height > 0), m AS (SELECT job_id, page, median(height) AS mid FROM q GROUP BY 1, 2),
        f AS (SELECT q.*, height >= 0.55::DOUBLE * mid AND height <= 1.7::DOUBLE * mid AS field_text FROM q JOIN m USING (job_id, page)), n AS (SELECT job_id, page, median(boldness) FILTER (boldness > 1e-6) AS b, median(density) FILTER (density > 1e-6) AS d FROM f WHERE field_text GROUP BY 1, 2)
        SELECT hit_id, field_text, round(CASE WHEN coalesce(b, 0.0) > 1e-6 THEN boldness / b ELSE 0.0 END, 3) AS boldness_ratio, round(CASE WHEN coalesce(d, 0.0) > 1e-6 THEN density / d ELSE 0.0 END, 3) AS density_ratio FROM f LEFT JOIN n USING (job_id, page)""",
    "overwritten_marks": """WITH e AS (SELECT l_returnflag, l_quantity, l_linestatus = 'O' AS ordinary, l_quantity * 10 AS area, CAST(l_quantity / 20 > 1.9 AS INTEGER) + CAST(l_extendedprice / 25000 > 2.0 AS INTEGER) + CAST(l_discount * 4 > 0.22::DOUBLE AS INTEGER) + CAST(0.5::DOUBLE + l_tax < 0.55::DOUBLE AND l_tax * 10 < 0.6::DOUBLE AS INTEGER) AS s FROM lineitem)
        SELECT l_returnflag, count_if(s >= 2 AND area >= 120 AND ordinary) AS overwritten, count_if(l_quantity / 20 > 1.8 AND area >= 120 AND ordinary) AS thick, CAST(sum(CASE WHEN s >= 2 AND area >= 120 AND ordinary THEN s END) AS BIGINT) AS signals FROM e GROUP BY 1""",
    "eye_pairs": f"""WITH {BOXES}, c AS (SELECT hit_id, job_id, page, x + width / 2 AS x, y + height / 2 AS y FROM boxes)
        SELECT a.hit_id AS a_hit_id, b.hit_id AS b_hit_id FROM c a JOIN c b ON a.job_id = b.job_id AND a.page = b.page AND a.hit_id < b.hit_id WHERE abs(a.x - b.x) BETWEEN 0.16::DOUBLE AND 0.72::DOUBLE AND abs(a.y - b.y) <= 0.22::DOUBLE""",
    "noise_facts": f"SELECT label, count(*) AS facts, count_if(lower(replace(label, ' ', '_')) IN ({', '.join(repr(k) for k in signals.NOISE_KEYS)}) OR regexp_matches(lower(trim(value, ' ')), '^https?://') OR length(trim(value, ' ')) < 3 OR length(trim(value, ' ')) > 180 OR (length(regexp_replace(trim(value, ' '), '[^A-Za-z0-9+/=_-]+', '', 'g')) >= 18 AND NOT contains(trim(value, ' '), ' '))) AS noise FROM facts WHERE value IS NOT NULL GROUP BY 1",
    "readability_scores": """
        WITH f AS (SELECT fact_id, string_split(value, ', ') AS tests FROM facts WHERE label = 'Failed sub-tests' AND value IS NOT NULL AND trim(value, ' ') <> ''), e AS (SELECT fact_id, unnest(tests) AS test FROM f), k AS (SELECT test FROM e GROUP BY 1 HAVING count(DISTINCT fact_id) >= 20 AND test <> 'None'),
        n AS (SELECT f.fact_id, (SELECT count(*) FROM k) AS ran, count(DISTINCT k.test) AS failed, coalesce(bool_or(k.test = 'ocr_confidence'), false) AS ocr FROM f LEFT JOIN e USING (fact_id) LEFT JOIN k ON k.test = e.test GROUP BY 1),
        s AS (SELECT *, CAST(floor(coalesce(100.0 * (ran - failed) / nullif(ran, 0), 0)) AS INTEGER) AS score FROM n)
        SELECT score, CASE WHEN NOT ocr AND score >= 70 THEN 'readable' WHEN score >= 80 AND NOT ocr THEN 'readable' ELSE 'poor_readability' END AS level, count(*) AS facts FROM s GROUP BY 1, 2""",
    "word_confidence": """WITH n AS (SELECT job_id, count(*) AS words, avg(length(value) % 101) AS mean, 100.0 * count_if(length(value) % 101 < 50) / count(*) AS low FROM facts WHERE value IS NOT NULL GROUP BY 1)
        SELECT job_id, words, CASE WHEN words >= 10 THEN round(mean, 4) END AS mean, CASE WHEN words >= 10 THEN round(low, 4) END AS low, words >= 10 AND mean > 40 AND low < 65 AS passed FROM n""",
    "code_verdicts": f"WITH f AS ({_FIELDS}), n AS (SELECT job_id, count(*) AS total, count_if(first_value = last_value) AS matched FROM f GROUP BY 1), q AS (SELECT DISTINCT job_id FROM qr_hits), j AS (SELECT DISTINCT id AS job_id FROM jobs WHERE status = 'completed') SELECT CASE WHEN q.job_id IS NULL THEN 'fail_no_qr' WHEN coalesce(total, 0) = 0 THEN 'review_no_structured_qr_details' WHEN matched = total THEN 'pass' WHEN matched > 0 THEN 'review_partial_match' ELSE 'fail_no_details_matched' END AS verdict, count(*) AS jobs FROM j LEFT JOIN q USING (job_id) LEFT JOIN n USING (job_id) GROUP BY 1",
    "order_tiers": """
        WITH e AS (SELECT l_orderkey, l_quantity / 20 AS ratio, CAST(l_discount > 0.05 AS INTEGER) + CAST(l_tax > 0.04 AS INTEGER) + CAST(l_extendedprice > 50000 AS INTEGER) + CAST(l_returnflag = 'R' AS INTEGER) AS s FROM lineitem),
        n AS (SELECT l_orderkey, max(ratio) AS r, count_if(ratio > 1.8) AS c, max(CASE WHEN s >= 3 THEN 2 WHEN s = 2 THEN 1 ELSE 0 END) AS o FROM e GROUP BY 1)
        SELECT l_orderkey, CASE WHEN c = 0 THEN 'low' WHEN r >= 2.5 OR c >= 5 THEN 'high' WHEN r >= 2.0 OR c >= 2 THEN 'medium' ELSE 'low' END AS stroke, ['low', 'medium', 'high'][o + 1] AS overwriting, greatest(0, 2 - c) AS shortfall FROM n""",
    "compared_fields": f"WITH f AS ({_FIELDS}) SELECT field, CASE WHEN field = 'roll' THEN 'missing' WHEN lower(trim(first_value, ' ')) = lower(trim(last_value, ' ')) THEN 'match' ELSE 'differs' END AS state, count(*) AS n FROM f GROUP BY 1, 2",
    "chosen_pages": """
        WITH h AS (SELECT DISTINCT ON (hit_id) * FROM qr_hits WHERE page IS NOT NULL), n AS (SELECT job_id, CAST(max(page) * 3 AS INTEGER) AS total, arg_min(page, hit_id) AS first FROM h GROUP BY 1),
        c AS (SELECT job_id, total, CASE WHEN total <= 6 THEN range(1, total + 1) ELSE list_concat([first, 1, total], list_concat(list_transform(range(0, 6), lambda i: CAST(1 + round_even(i * (total - 1) / 5.0, 0) AS BIGINT)), range(1, total + 1))) END AS l FROM n),
        d AS (SELECT job_id, total, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM c)
        SELECT job_id, total, array_to_string(list_sort(l[1:CASE WHEN total <= 6 THEN total ELSE 6 END]), ',') AS pages FROM d""",
}
