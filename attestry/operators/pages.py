"""Evidence by page: alignment, pair scores, outliers, combined probabilities, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.operators import grading as G
from attestry.operators import ordered


def aligned(counts: DataFrame, key: str, page: str) -> DataFrame:
    """``(key, page)`` for every page from 1 to the last of each document, so that pages without evidence show."""
    last = counts.groupBy(key).agg(F.max(page).alias("n"))
    return last.where("n >= 1").select(key, F.explode(F.sequence(F.lit(1), F.col("n"))).alias(page))


def noisy_or(p: Column, cap: float = 0.98) -> Column:
    """The probability that at least one of independent signals holds, at most ``cap``."""
    return F.least(1 - F.product(1 - p), F.lit(cap))


def decayed_noisy_or(rows: DataFrame, key: str, p: str, least: float = 0.25, decay: float = 0.7, top: int = 12) -> DataFrame:
    """(key, score): of each key's ``top`` signals of ``least`` or more, the k-th strongest counts decay^k."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(p), *[F.col(c) for c in rows.columns if c not in (key, p)])) - 1
    kept = rows.where(F.col(p) >= least).withColumn("_k", rank).where(F.col("_k") < top)
    return kept.groupBy(key).agg(noisy_or(F.col(p) * F.pow(F.lit(decay), F.col("_k"))).alias("score"))


def robust_z(value: Column, median: Column, mad: Column, spread: Column) -> Column:
    """Deviation in robust units; where half of the values are equal, in standard deviations."""
    sigma = F.when(mad > 0, 1.4826 * mad).otherwise(F.nullif(spread, F.lit(0.0)))
    return F.coalesce((value - median) / sigma, F.lit(0.0))


def outliers(rows: DataFrame, group: str, item: str, value: str, least: float) -> DataFrame:
    """(group, item, value, z) of values whose robust z is ``least`` or more; none where more than half would be."""
    mid = rows.groupBy(group).agg(F.median(value).alias("mid"), F.stddev_pop(value).alias("spread"), F.count("*").alias("n"))
    at = rows.join(mid, group)
    mad = at.groupBy(group).agg(F.median(F.abs(F.col(value) - F.col("mid"))).alias("mad"))
    scored = at.join(mad, group).withColumn("z", robust_z(F.col(value), F.col("mid"), F.col("mad"), F.col("spread")))
    hits = scored.where(F.col("z") >= least)
    many = hits.groupBy(group).agg(F.count("*").alias("k"))
    return hits.join(many, group).where(F.col("k") * 2 <= F.col("n")).select(group, item, value, "z")


def page_pairs(pages: DataFrame, key: str, page: str, value: str) -> DataFrame:
    """(key, page_a, page_b, score): each pair of pages of a document, scored 100 for equal values down to 0."""
    a = pages.select(F.col(key), F.col(page).alias("page_a"), F.col(value).alias("va"))
    b = pages.select(F.col(key), F.col(page).alias("page_b"), F.col(value).alias("vb"))
    relative = 1 - F.coalesce(F.try_divide(F.abs(F.col("va") - F.col("vb")), F.greatest(F.abs("va"), F.abs("vb"))), F.lit(0.0))
    return a.join(b, key).where("page_a < page_b").select(key, "page_a", "page_b", (100 * F.greatest(relative, F.lit(0.0))).alias("score"))


def pair_band(median: Column, least: Column) -> Column:
    """What a document's pair scores say about one capture of all its pages."""
    return F.when((median >= 78) & (least >= 60), "likely").when((median >= 62) & (least >= 48), "compatible").when(median >= 48, "uncertain").otherwise("possibly_different")


def worst_per_page(pairs: DataFrame, key: str) -> DataFrame:
    """(key, page, score): the lowest score of the pairs each page is in."""
    each = pairs.select(key, F.explode(F.array("page_a", "page_b")).alias("page"), "score")
    return each.groupBy(key, "page").agg(F.min("score").alias("score"))


def box(points: Column, width: Column, height: Column) -> dict[str, Column]:
    """The box around a polygon of pixels, clipped to the page and in shares of it."""
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    x0, y0, x1, y1 = clip(F.array_min(xs) / width), clip(F.array_min(ys) / height), clip(F.array_max(xs) / width), clip(F.array_max(ys) / height)
    return {"x": F.round(x0, 6), "y": F.round(y0, 6), "width": F.round(x1 - x0, 6), "height": F.round(y1 - y0, 6)}


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes, columns ``<prefix>x, y, width, height``."""
    c = lambda p, n: F.col(f"{p}{n}")
    over = lambda n, size: F.greatest(F.lit(0.0), F.least(c(a, n) + c(a, size), c(b, n) + c(b, size)) - F.greatest(c(a, n), c(b, n)))
    inner = over("x", "width") * over("y", "height")
    return F.try_divide(inner, c(a, "width") * c(a, "height") + c(b, "width") * c(b, "height") - inner)


def merged_intervals(rows: DataFrame, key: str, start: str, end: str, gap: float) -> DataFrame:
    """(key, start, end, n): intervals no further than ``gap`` apart joined into islands; a hot key takes many tasks."""
    placed = ordered.highest_before(rows.select(key, start, end), key, [start, end], end)
    fresh = placed.withColumn("_new", F.coalesce(F.col(start) > F.col("high") + gap, F.lit(True)).cast("int"))
    island = ordered.running_sum(fresh.drop("high"), key, [start, end], "_new", "_island")
    return island.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


#: How a decoder turns a page and alters its picture.
ROTATIONS, VARIANTS = [0, 90, 180, 270], ["gray", "sharp", "threshold", "inverted"]


def decode_passes(pages: DataFrame, key: str, page: str, ladder: Column, most: int = 0) -> DataFrame:
    """(key, page, dpi, rotation, variant): every pass of a decoder over pages, the first ``most`` of each document (0: all), by the resolutions of ``ladder``."""
    kept = pages.where(F.col(page) <= most) if most else pages
    rows = kept.select(key, page, F.explode(ladder).alias("dpi"))
    turned = rows.select("*", F.explode(F.array(*(F.lit(r) for r in ROTATIONS))).alias("rotation"))
    return turned.select("*", F.explode(F.array(*(F.lit(v) for v in VARIANTS))).alias("variant"))


def united(generators: list, context: DataFrame) -> DataFrame:
    """The rows of several detectors over one table, each a function of it; a detector that cannot be planned stops no other.

    Rows say in ``detector`` whose they are; of what failed a row says why in ``failure``.
    """
    out = None
    for f in generators:
        try:
            rows = f(context).withColumn("detector", F.lit(f.__name__)).withColumn("failure", F.lit(None).cast("string"))
            rows.schema  # noqa: B018 - analyses the plan
        except Exception as e:  # noqa: BLE001
            rows = context.sparkSession.createDataFrame([(f.__name__, f"{type(e).__name__}: {e}"[:400])], "detector string, failure string")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


#: Readings of recaptured images, the worst first.
MOIRE_RANK = ["RECAPTURE", "INCONCLUSIVE", "CLEAN"]
_VALUES = "array<struct<page:bigint,measure:string,number:double,text:string>>"


def page_values(raws: DataFrame) -> DataFrame:
    """``(job_id, pos, analyzer_id, pages, values)``: what each payload says of single pages, and how many pages it knows of."""
    raw = F.col("raw")
    none = F.lit(None).cast("double")

    def value(page: Column, measure: str, number: Column = none, text: Column | None = None) -> Column:
        return F.struct(page.alias("page"), F.lit(measure).alias("measure"), number.cast("double").alias("number"), (F.lit(None).cast("string") if text is None else text).alias("text"))

    def each(path: str, measure: str) -> Column:
        return F.transform(G.objects(raw, path), lambda x: value(G.count(x, "$.page"), measure, F.lit(1.0))).cast(_VALUES)

    groups = F.when(F.size(G.items(raw, "$.embedded_typefaces")) > 0, G.objects(raw, "$.embedded_typefaces")).otherwise(G.embedded_fonts(raw)[0])
    name = lambda g: F.coalesce(G.text(g, "$.typeface", "$.font_name"), F.lit("(unnamed)"))
    fonts = F.flatten(F.transform(groups, lambda g: F.transform(G.items(g, "$.pages_used"), lambda p: value(G.count(p, "$"), "fonts", none, name(g))))).cast(_VALUES)
    photos = each("$.photos", "photos")
    one = F.array(value(G.count(raw, "$.page"), "photos", F.greatest(F.lit(1).cast("bigint"), G.count(raw, "$.photo_count")))).cast(_VALUES)
    photos = F.when(F.exists(photos, lambda x: x["page"] > 0), photos).when(F.coalesce(G.get(raw, "$.photo_found", "boolean"), F.lit(False)), one).otherwise(photos)
    scans = G.objects(raw, "$.pages")
    tamper = F.concat(F.transform(scans, lambda x: value(G.count(x, "$.page"), "probability", G.get(x, "$.probability", "double"))), F.transform(scans, lambda x: value(G.count(x, "$.page"), "regions", F.size(G.items(x, "$.regions"))))).cast(_VALUES)
    scored = F.filter(G.objects(raw, "$.pair_assessments"), lambda x: G.is_number(x, "$.same_phone_score"))
    pairs = F.flatten(F.transform(scored, lambda x: F.array(*(value(G.count(x, f"$.{k}"), "pair", G.get(x, "$.same_phone_score", "double")) for k in ("page_a", "page_b"))))).cast(_VALUES)
    said = lambda x: F.array_position(F.array(*(F.lit(v) for v in MOIRE_RANK)), F.upper(F.trim(F.try_variant_get(x, "$.verdict", "string"))))
    moire = F.filter(F.transform(G.objects(raw, "$.images"), lambda x: value(G.count(x, "$.page"), "moire", said(x))), lambda v: v["number"] > 0).cast(_VALUES)
    is_ = lambda a: F.col("analyzer_id") == a
    values = (
        F.when(is_("font_analysis"), fonts).when(is_("photo_detection"), photos).when(is_("signature"), each("$.regions", "signatures")).when(is_("qr_presence"), each("$.hits", "codes"))
        .when(is_("tamper_scan"), tamper).when(is_("same_phone"), pairs).when(is_("moire"), moire).otherwise(F.array().cast(_VALUES))
    )
    known = F.when(is_("metadata"), G.count(raw, "$.generation.pages")).when(is_("tamper_scan") | is_("same_phone"), F.size(G.items(raw, "$.pages")).cast("bigint"))
    return raws.select("job_id", "pos", "analyzer_id", known.alias("pages"), F.filter(values, lambda v: v["page"] > 0).alias("values"))


def sheet(values: DataFrame) -> DataFrame:
    """One row for each page of each document from :func:`page_values`: fonts, font_names, photos, signatures, codes, probability, regions, lowest_pair, moire.

    A document has as many pages as its payloads know of; one of which none
    says anything is absent. Null means that the check was not run, or says
    nothing of single pages.
    """
    checks = {"fonts": "font_analysis", "photos": "photo_detection", "signatures": "signature", "codes": "qr_presence", "regions": "tamper_scan"}
    ran = values.groupBy("job_id").agg(F.greatest(F.max("pages"), F.max(F.array_max(F.transform("values", lambda v: v["page"])))).alias("n"), *(F.bool_or(F.col("analyzer_id") == a).alias(f"ran_{m}") for m, a in checks.items()))
    series = ran.where("n >= 1").select("job_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("page"), *(f"ran_{m}" for m in checks))
    v = values.select("job_id", F.explode("values").alias("v")).select("job_id", "v.*")
    of = lambda m, c: F.when(F.col("measure") == m, F.col(c))
    own = v.groupBy("job_id", "page").agg(
        F.array_sort(F.collect_set(of("fonts", "text"))).alias("names"), *(F.sum(of(m, "number")).alias(m) for m in ("photos", "signatures", "codes", "regions")), F.max(of("probability", "number")).alias("probability"), F.min(of("pair", "number")).alias("lowest_pair"), F.min(of("moire", "number")).alias("_moire")
    )
    joined = series.join(own, ["job_id", "page"], "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    counted = {m: F.when(F.col(f"ran_{m}"), F.coalesce(F.size("names").cast("double") if m == "fonts" else F.col(m), F.lit(0.0)).cast("bigint")) for m in checks}
    moire = F.initcap(F.lower(F.get(F.array(*(F.lit(m) for m in MOIRE_RANK)), (F.col("_moire") - 1).cast("int"))))
    return joined.select("job_id", "page", *(c.alias(m) for m, c in counted.items() if m != "regions"), F.when(F.col("ran_fonts"), F.array_join("names", ", ")).alias("font_names"), "probability", counted["regions"].alias("regions"), "lowest_pair", moire.alias("moire"))
