"""Queries: evidence by page and box, outliers, combined probabilities, ordered merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.operators import features, grading, greedy, pages, signals
from attestry.session import table
from attestry.sources import files

#: Pixels of an A4 page at one dot per inch.
_WIDTH, _HEIGHT = 8.27, 11.69


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "qr_hits").dropDuplicates(["hit_id"])


def per_page_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of each job to its last page with a hit: hits, distinct payloads, highest resolution; null where none."""
    h = _hits(spark, sf_dir).where("page is not null")
    own = h.groupBy("job_id", "page").agg(F.count("*").alias("hits"), F.count_distinct("payload").alias("payloads"), F.max("dpi").alias("dpi"))
    return pages.aligned(own, "job_id", "page").join(own, ["job_id", "page"], "left")


def hit_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of each hit in shares of its page; boxes thinner than a thousandth are no evidence."""
    b = pages.box(F.col("points"), F.col("dpi") * _WIDTH, F.col("dpi") * _HEIGHT)
    return _hits(spark, sf_dir).where("points is not null and size(points) >= 3 and dpi > 0").select("hit_id", "job_id", "page", *(c.alias(n) for n, c in b.items())).where("width >= 0.001 and height >= 0.001")


def overlapping_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of hits on one page whose boxes overlap by 0.35 or more."""
    b = hit_boxes(spark, sf_dir)
    side = lambda p: b.select("job_id", "page", *(F.col(c).alias(f"{p}{c}") for c in ("hit_id", "x", "y", "width", "height")))
    both = side("a_").join(side("b_"), ["job_id", "page"]).where("a_hit_id < b_hit_id")
    return both.withColumn("iou", F.round(pages.iou("a_", "b_"), 6)).where("iou >= 0.35").select("a_hit_id", "b_hit_id", "iou")


def merged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a page merged where they overlap, the largest taken as the surest."""
    b = hit_boxes(spark, sf_dir).withColumn("confidence", F.round(F.col("width") * F.col("height"), 6)).withColumn("ord", F.col("hit_id"))
    return greedy.by_group(b, ["job_id", "page"], greedy.merge_boxes, "merged bigint", F.lit(1))


def hit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a page grouped to lines, boxes in thousandths of the page."""
    b = hit_boxes(spark, sf_dir).select("hit_id", "job_id", "page", *(F.round(F.col(c) * 1000, 3).alias(c) for c in ("x", "y", "width", "height")), F.col("hit_id").alias("ord"))
    return greedy.by_group(b, ["job_id", "page"], greedy.text_lines, "line bigint", F.lit(0))


def document_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, discounts as page probabilities: all pages combined."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(pages.noisy_or(F.col("l_discount") * 5), 12).alias("probability"))


def decayed_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_discount") * 8).alias("p"), "l_linenumber", "l_partkey", "l_suppkey")
    return pages.decayed_noisy_or(rows, "l_orderkey", "p").select("l_orderkey", F.round("score", 6).alias("score"))


def page_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    found = pages.outliers(rows, "l_orderkey", "l_partkey", "l_extendedprice", 2.5)
    return found.select("l_orderkey", "l_partkey", "l_extendedprice", F.round("z", 6).alias("z"))


def _resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).where("page is not null and dpi is not null").groupBy("job_id", "page").agg(F.max("dpi").alias("dpi"))


def pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a job compared in pairs by resolution: median, least, greatest score and what they say."""
    p = pages.page_pairs(_resolutions(spark, sf_dir), "job_id", "page", "dpi")
    s = p.groupBy("job_id").agg(F.median("score").alias("mid"), F.min("score").alias("least"), F.max("score").alias("most"))
    return s.select("job_id", F.round("mid", 6).alias("median_score"), F.round("least", 6).alias("least_score"), F.round("most", 6).alias("most_score"), pages.pair_band(F.col("mid"), F.col("least")).alias("band"))


def worst_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages.page_pairs(_resolutions(spark, sf_dir), "job_id", "page", "dpi")
    return pages.worst_per_page(p, "job_id").select("job_id", "page", F.round("score", 6).alias("score"))


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a page in reading order: bands of 250 pixels down, then across."""
    first = F.col("points")[0]
    order = Window.partitionBy("job_id", "page").orderBy(F.floor(first[1] / 250), first[0], first[1], "hit_id")
    return _hits(spark, sf_dir).where("points is not null and size(points) >= 1").select("hit_id", F.row_number().over(order).alias("position"))


def first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hit of each payload of a page, in the order of scanning."""
    return table(spark, sf_dir, "qr_hits").where("payload is not null").groupBy("job_id", "page", "payload").agg(F.min("hit_id").alias("hit_id")).select("hit_id", "job_id", "page")


def session_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as intervals of ten minutes, joined where they are at most 20 minutes apart (whole seconds)."""
    e = table(spark, sf_dir, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("s"))
    return pages.merged_intervals(e.withColumn("e", F.col("s") + 600), "user_id", "s", "e", 1200)


def dpi_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolutions to try for each seen one, by the effort of the search."""
    d = table(spark, sf_dir, "qr_hits").where("dpi is not null").select("dpi").distinct()
    return d.select("dpi", *(F.array_join(signals.dpi_ladder(F.col("dpi"), e).cast("array<string>"), ",").alias(e) for e in signals.LADDERS))


def native_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolution of each job's scans, its hits' outermost corners taken for the sizes of its images on A4 pages."""
    corner = lambda i: F.array_max(F.transform("points", lambda q: q[i]))
    h = _hits(spark, sf_dir).where("points is not null and size(points) >= 1").select("job_id", corner(0).alias("w"), corner(1).alias("h"))
    return h.groupBy("job_id").agg(files.native_dpi(F.col("w"), F.col("h"), F.lit(595.0), F.lit(842.0)).alias("dpi"))


def original_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first corner of each hit on its page as it was, if the variant that found it had turned the page."""
    turn = F.coalesce(F.regexp_extract("variant", r"rot(0|90|180|270)", 1).try_cast("int"), F.lit(0))
    x, y = grading.unrotated(F.col("points")[0][0], F.col("points")[0][1], turn, F.col("dpi") * _WIDTH, F.col("dpi") * _HEIGHT)
    return _hits(spark, sf_dir).where("points is not null and size(points) >= 1").select("hit_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def ring_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean resolution of hits by rings of 500 pixels around a page's corner."""
    q = F.col("points")[0]
    ring = F.floor(F.sqrt(q[0] * q[0] + q[1] * q[1]) / 500)
    return _hits(spark, sf_dir).where("points is not null and size(points) >= 1 and dpi is not null").groupBy(ring.alias("ring")).agg(F.count("*").alias("n"), F.round(F.avg("dpi"), 6).alias("mean"))


def covered_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits whose box others of their page cover by more than 0.18: no place for a signature."""
    b = hit_boxes(spark, sf_dir)
    return features.covered(b, b, ["job_id", "page"], "hit_id").where("covered > 0.18").select("hit_id", F.round("covered", 4).alias("covered"))


def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engines of hits as words of a page, joined to lines by their height in steps of 4 points."""
    q = F.col("points")[0]
    line = F.bround(q[1] / 4, 0).cast("bigint")
    w = _hits(spark, sf_dir).where("points is not null and size(points) >= 1 and engine is not null")
    return w.groupBy("job_id", "page", line.alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(q[0].alias("x"), "hit_id", "engine"))), lambda e: e["engine"]), " ").alias("words"))


def signature_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as signatures: of each job how many, on which pages, by which methods, the surest, how many only likely; the share of a page stands for confidence."""
    b = hit_boxes(spark, sf_dir).select("hit_id", "job_id", "page", F.least(F.round((F.col("width") + F.col("height")) * 2, 4), F.lit(1.0)).alias("confidence"))
    m = b.join(_hits(spark, sf_dir).select("hit_id", F.split(F.concat_ws("+", "engine", "variant"), r"\+").alias("methods")), "hit_id")
    kept = m.where("confidence >= 0.3")
    own = kept.groupBy("job_id").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("page")).cast("array<string>"), ",").alias("pages"), F.max("confidence").alias("surest"), F.count_if(F.col("confidence") < 0.65).alias("only_likely"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("methods")))), ",").alias("methods"),
    )
    return own


def photo_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as photos of a job: whether all pass, and the reason of the first that does not; resolution stands for sharpness, the page for light."""
    q = signals.photo_quality(F.col("dpi") / 4, F.col("page") * 40)
    each = _hits(spark, sf_dir).where("dpi is not null and page is not null").select("job_id", "hit_id", q.alias("reason"))
    return each.groupBy("job_id").agg(F.bool_and(F.col("reason") == "ok").alias("passed"), F.min_by(F.when(F.col("reason") != "ok", F.col("reason")), F.when(F.col("reason") != "ok", F.col("hit_id"))).alias("first_reason"))


def file_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as images of a job: recaptured if one is, clean if all are, else undecided; resolutions under 250 stand for recaptures."""
    v = F.when(F.col("dpi") < 250, "RECAPTURE").when(F.col("dpi") < 350, "INCONCLUSIVE").otherwise("CLEAN")
    own = _hits(spark, sf_dir).where("dpi is not null").groupBy("job_id").agg(F.bool_or(v == "RECAPTURE").alias("any"), F.bool_and(v == "CLEAN").alias("all"))
    return own.select("job_id", F.when(F.col("any"), "RECAPTURE").when(F.col("all"), "CLEAN").otherwise("INCONCLUSIVE").alias("verdict"))


def decode_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many passes a decoder makes over the pages of each job at medium effort, its hits' highest resolution taken for its scan's."""
    d = _hits(spark, sf_dir).where("page is not null and dpi is not null").groupBy("job_id", "page").agg(F.max("dpi").alias("native"))
    return pages.decode_passes(d, "job_id", "page", signals.dpi_ladder(F.col("native"), "medium")).groupBy("job_id").agg(F.count("*").alias("passes"), F.max("dpi").alias("highest"))


def distinct_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of each job once, however many pages show them, and the runs' totals: hits, crops, jobs without any."""
    h = _hits(spark, sf_dir)
    crops = h.where("crop_path is not null").dropDuplicates(["job_id", "crop_path"]).groupBy("job_id").agg(F.count("*").alias("crops"))
    own = h.groupBy("job_id").agg(F.count("*").alias("hits")).join(crops, "job_id", "left")
    return own.agg(F.count("*").alias("jobs"), F.sum("hits").alias("hits"), F.sum("crops").alias("crops"), F.count_if(F.col("crops").isNull()).alias("without"))


QUERIES = {f.__name__: f for f in (per_page_alignment, hit_boxes, overlapping_hits, merged_hits, hit_lines, document_probability, decayed_probability, page_outliers, pair_summary, worst_pairing, reading_order, first_hits, session_islands, dpi_ladder, native_resolutions, original_corners, ring_means, covered_boxes, page_words, signature_reports, photo_outcomes, file_verdicts, decode_passes, distinct_images)}

_H = "h AS (SELECT DISTINCT ON (hit_id) * FROM qr_hits)"
_clip = "least(greatest({}, 0.0), 1.0)"


def _edge(fn: str, axis: int, size: float) -> str:
    return _clip.format(f"list_{fn}(list_transform(points, lambda p: p[{axis}])) / (dpi * {size}::DOUBLE)")


_BOXES = f"""{_H}, b AS (SELECT hit_id, job_id, page, round({_edge('min', 1, _WIDTH)}, 6) AS x, round({_edge('min', 2, _HEIGHT)}, 6) AS y,
    round({_edge('max', 1, _WIDTH)} - {_edge('min', 1, _WIDTH)}, 6) AS width, round({_edge('max', 2, _HEIGHT)} - {_edge('min', 2, _HEIGHT)}, 6) AS height
    FROM h WHERE points IS NOT NULL AND len(points) >= 3 AND dpi > 0), boxes AS (SELECT * FROM b WHERE width >= 0.001 AND height >= 0.001)"""
_PAIRS = f"""{_H}, d AS (SELECT job_id, page, max(dpi) AS dpi FROM h WHERE page IS NOT NULL AND dpi IS NOT NULL GROUP BY 1, 2),
    pairs_ AS (SELECT a.job_id, a.page AS page_a, b.page AS page_b, 100 * greatest(1 - coalesce(abs(a.dpi - b.dpi)::DOUBLE / nullif(greatest(abs(a.dpi), abs(b.dpi)), 0), 0.0), 0.0) AS score FROM d a JOIN d b ON a.job_id = b.job_id AND a.page < b.page)"""

SQL = {
    "per_page_alignment": f"WITH {_H}, o AS (SELECT job_id, page, count(*) AS hits, count(DISTINCT payload) AS payloads, max(dpi) AS dpi FROM h WHERE page IS NOT NULL GROUP BY 1, 2), a AS (SELECT job_id, unnest(range(1, max(page) + 1)) AS page FROM o GROUP BY 1 HAVING max(page) >= 1) SELECT a.job_id, CAST(a.page AS INTEGER) AS page, o.hits, o.payloads, o.dpi FROM a LEFT JOIN o ON o.job_id = a.job_id AND o.page = a.page",
    "hit_boxes": f"WITH {_BOXES} SELECT * FROM boxes",
    "overlapping_hits": f"""WITH {_BOXES}, j AS (SELECT a.hit_id AS a_hit_id, b.hit_id AS b_hit_id, a.width * a.height AS sa, b.width * b.height AS sb,
        greatest(0.0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * greatest(0.0, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y)) AS i
        FROM boxes a JOIN boxes b ON a.job_id = b.job_id AND a.page = b.page AND a.hit_id < b.hit_id) SELECT a_hit_id, b_hit_id, round(i / (sa + sb - i), 6) AS iou FROM j WHERE round(i / (sa + sb - i), 6) >= 0.35""",
    "document_probability": "SELECT l_orderkey, round(least(1 - product(1 - l_discount * 5), 0.98), 12) AS probability FROM lineitem GROUP BY 1",
    "decayed_probability": "WITH k AS (SELECT l_orderkey, l_discount * 8 AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount * 8 DESC, l_linenumber, l_partkey, l_suppkey) - 1 AS k FROM lineitem WHERE l_discount * 8 >= 0.25) SELECT l_orderkey, round(least(1 - product(1 - p * pow(0.7, k)), 0.98), 6) AS score FROM k WHERE k < 12 GROUP BY 1",
    "page_outliers": """
        WITH m AS (SELECT l_orderkey, median(l_extendedprice) AS mid, stddev_pop(l_extendedprice) AS spread, count(*) AS n FROM lineitem GROUP BY 1),
        d AS (SELECT l_orderkey, median(abs(l_extendedprice - mid)) AS mad FROM lineitem JOIN m USING (l_orderkey) GROUP BY 1),
        z AS (SELECT l_orderkey, l_partkey, l_extendedprice, n, coalesce((l_extendedprice - mid) / CASE WHEN mad > 0 THEN 1.4826 * mad ELSE nullif(spread, 0) END, 0) AS z FROM lineitem JOIN m USING (l_orderkey) JOIN d USING (l_orderkey)),
        h AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS k FROM z WHERE z >= 2.5)
        SELECT l_orderkey, l_partkey, l_extendedprice, round(z, 6) AS z FROM h WHERE k * 2 <= n""",
    "pair_summary": f"WITH {_PAIRS}, s AS (SELECT job_id, median(score) AS m, min(score) AS l, max(score) AS x FROM pairs_ GROUP BY 1) SELECT job_id, round(m, 6) AS median_score, round(l, 6) AS least_score, round(x, 6) AS most_score, CASE WHEN m >= 78 AND l >= 60 THEN 'likely' WHEN m >= 62 AND l >= 48 THEN 'compatible' WHEN m >= 48 THEN 'uncertain' ELSE 'possibly_different' END AS band FROM s",
    "worst_pairing": f"WITH {_PAIRS} SELECT job_id, page, round(min(score), 6) AS score FROM (SELECT job_id, page_a AS page, score FROM pairs_ UNION ALL SELECT job_id, page_b, score FROM pairs_) GROUP BY 1, 2",
    "reading_order": f"WITH {_H} SELECT hit_id, CAST(row_number() OVER (PARTITION BY job_id, page ORDER BY floor(points[1][2] / 250), points[1][1], points[1][2], hit_id) AS INTEGER) AS position FROM h WHERE points IS NOT NULL AND len(points) >= 1",
    "first_hits": f"WITH {_H} SELECT hit_id, job_id, page FROM h WHERE payload IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_id, page, payload ORDER BY hit_id) = 1",
    "session_islands": """
        WITH e AS (SELECT user_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s FROM events), i AS (SELECT *, s + 600 AS e FROM e),
        f AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1200 OR row_number() OVER (PARTITION BY user_id ORDER BY s, e) = 1 THEN 1 ELSE 0 END AS fresh FROM i),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f)
        SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM g GROUP BY user_id, island""",
    "dpi_ladder": "WITH d AS (SELECT DISTINCT dpi FROM qr_hits WHERE dpi IS NOT NULL) SELECT dpi, "
    + ", ".join(f"array_to_string(list_filter(l{i}, lambda x, i: list_position(l{i}, x) = i), ',') AS {e}" for i, e in enumerate(("low", "medium", "high")))
    + " FROM (SELECT dpi, "
    + ", ".join(f"list_transform({m}::DOUBLE[], lambda m: CAST(least(greatest(round_even(dpi * m / 10, 0) * 10, 150), 900) AS INTEGER)) AS l{i}" for i, m in enumerate(([], [1.0, 1.2, 1.4, 1.6, 1.8], [0.8, 1.0, 1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 1.8, 2.0])))
    + " FROM d)",
    "native_resolutions": f"WITH {_H}, s AS (SELECT job_id, list_max(list_transform(points, lambda q: q[1])) AS w, list_max(list_transform(points, lambda q: q[2])) AS h FROM h WHERE points IS NOT NULL AND len(points) >= 1), d AS (SELECT job_id, max(CASE WHEN w > 0 AND h > 0 THEN greatest(least(w / (595.0::DOUBLE / 72), h / (842.0::DOUBLE / 72)), least(w / (842.0::DOUBLE / 72), h / (595.0::DOUBLE / 72))) END) AS best FROM s GROUP BY 1) SELECT job_id, CASE WHEN best BETWEEN 50 AND 1200 THEN CAST(round_even(best, 0) AS INTEGER) END AS dpi FROM d",
    "original_corners": f"""WITH {_H}, c AS (SELECT hit_id, points[1][1] AS x, points[1][2] AS y, dpi * {_WIDTH}::DOUBLE AS w, dpi * {_HEIGHT}::DOUBLE AS ht, coalesce(try_cast(nullif(regexp_extract(variant, 'rot(0|90|180|270)', 1), '') AS INTEGER), 0) AS t FROM h WHERE points IS NOT NULL AND len(points) >= 1)
        SELECT hit_id, round(CASE t WHEN 90 THEN y WHEN 180 THEN w - x WHEN 270 THEN w - y ELSE x END, 3) AS x, round(CASE t WHEN 90 THEN ht - x WHEN 180 THEN ht - y WHEN 270 THEN x ELSE y END, 3) AS y FROM c""",
    "ring_means": f"WITH {_H} SELECT CAST(floor(sqrt(points[1][1] * points[1][1] + points[1][2] * points[1][2]) / 500) AS BIGINT) AS ring, count(*) AS n, round(avg(dpi), 6) AS mean FROM h WHERE points IS NOT NULL AND len(points) >= 1 AND dpi IS NOT NULL GROUP BY 1",
    "covered_boxes": f"""WITH {_BOXES}, a AS (SELECT a.hit_id, a.width * a.height AS area, sum(greatest(0.0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * greatest(0.0, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y))) AS over
        FROM boxes a JOIN boxes b ON a.job_id = b.job_id AND a.page = b.page AND a.hit_id <> b.hit_id GROUP BY ALL) SELECT hit_id, round(over / area, 4) AS covered FROM a WHERE over / area > 0.18""",
    "page_words": f"WITH {_H} SELECT job_id, page, CAST(round_even(points[1][2] / 4, 0) AS BIGINT) AS line, string_agg(engine, ' ' ORDER BY points[1][1], hit_id) AS words FROM h WHERE points IS NOT NULL AND len(points) >= 1 AND engine IS NOT NULL GROUP BY 1, 2, 3",
    "signature_reports": f"""WITH {_BOXES}, m AS (SELECT b.*, least(round((b.width + b.height) * 2, 4), 1.0) AS confidence, string_split(concat_ws('+', h.engine, h.variant), '+') AS methods FROM boxes b JOIN h USING (hit_id)), k AS (SELECT * FROM m WHERE confidence >= 0.3),
        s AS (SELECT job_id, string_agg(method, ',' ORDER BY method) AS methods FROM (SELECT DISTINCT job_id, unnest(methods) AS method FROM k) GROUP BY 1), p AS (SELECT job_id, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM (SELECT DISTINCT job_id, page FROM k WHERE page IS NOT NULL) GROUP BY 1)
        SELECT k.job_id, count(*) AS n, any_value(coalesce(p.pages, '')) AS pages, max(confidence) AS surest, count_if(confidence < 0.65) AS only_likely, any_value(s.methods) AS methods FROM k JOIN s USING (job_id) LEFT JOIN p USING (job_id) GROUP BY 1""",
    "photo_outcomes": f"WITH {_H}, r AS (SELECT job_id, hit_id, CASE WHEN dpi / 4.0 < 80 THEN 'image_too_blurry' WHEN NOT (page * 40 > 35 AND page * 40 < 225) THEN 'bad_lighting' ELSE 'ok' END AS reason FROM h WHERE dpi IS NOT NULL AND page IS NOT NULL) SELECT job_id, bool_and(reason = 'ok') AS passed, arg_min(reason, hit_id) FILTER (reason <> 'ok') AS first_reason FROM r GROUP BY 1",
    "file_verdicts": f"WITH {_H} SELECT job_id, CASE WHEN bool_or(dpi < 250) THEN 'RECAPTURE' WHEN bool_and(dpi >= 350) THEN 'CLEAN' ELSE 'INCONCLUSIVE' END AS verdict FROM h WHERE dpi IS NOT NULL GROUP BY 1",
    "decode_passes": f"""WITH {_H}, d AS (SELECT job_id, page, max(dpi) AS native FROM h WHERE page IS NOT NULL AND dpi IS NOT NULL GROUP BY 1, 2), l AS (SELECT job_id, page, unnest(list_distinct(list_transform([1.0, 1.2, 1.4, 1.6, 1.8]::DOUBLE[], lambda m: CAST(least(greatest(round_even(native * m / 10, 0) * 10, 150), 900) AS INTEGER)))) AS dpi FROM d)
        SELECT job_id, count(*) * 16 AS passes, max(dpi) AS highest FROM l GROUP BY 1""",
    "distinct_images": f"WITH {_H}, o AS (SELECT job_id, count(*) AS hits, nullif(count(DISTINCT crop_path), 0) AS crops FROM h GROUP BY 1) SELECT count(*) AS jobs, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(crops) AS BIGINT) AS crops, count_if(crops IS NULL) AS without FROM o",
}
