"""Comparisons of pages by their features, provenance of files, norms of ink: Columns and aggregates over measured tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.operators.signals import ladder

#: Weights of a pair's parts, bands of its score and of a document's median and least score.
PAIR_WEIGHTS = {"metadata": 0.30, "geometry": 0.25, "texture": 0.35, "condition": 0.10}
PAIR_BANDS = [(78, "likely_same_phone_or_workflow"), (62, "compatible_with_same_phone"), (48, "uncertain_same_phone")]
LEAST_SCORES = {78: 60, 62: 48}
DIFFERENT = "possibly_different_phone_or_workflow"
#: A scanner pair's weights, how steeply mismatch grows, and from when scores of pages, regions and pairs count.
SCANNER_WEIGHTS = {"spectral": 0.46, "statistic": 0.38, "bands": 0.04, "most": 0.12}
STEEPNESS = 8.0
RISK_SCORES = {"page": (42, 74), "region": (72, 82), "pair": (45, 76)}
#: Editing signals that count by themselves, and those of an editor.
STRONG = ["incremental_update", "editor_producer", "editor_image_metadata"]
EDITORS = ["editor_producer", "editor_image_metadata"]
WEB_PRODUCERS = "chromium|chrome|webkit|skia|wkhtmltopdf|weasyprint|puppeteer|playwright|prince|fpdf|tcpdf|dompdf|html|phantomjs|electron"
#: The heights of ordinary text in medians; phrases that are no place for a signature.
FIELD_HEIGHT = (0.55, 1.7)
NO_ANCHOR = ["facsimile signature", "digitally signed", "digital signature", "signature certificate", "signature is not verified"]

_EPS = 1e-6


def page_sides(pages: DataFrame, key: str, page: str) -> DataFrame:
    """All pairs of pages of one document, columns a_* and b_*: a document's pages are few."""
    side = lambda p: pages.select(F.col(key), *(F.col(c).alias(f"{p}_{c}") for c in pages.columns if c != key))
    return side("a").join(side("b"), key).where(F.col(f"a_{page}") < F.col(f"b_{page}"))


def similarity(a: Column, b: Column, scale: float = 1.0) -> Column:
    """1 for equal values down to 0; one half where one is missing."""
    apart = F.abs(a - b) / (F.abs(a) + F.abs(b) + _EPS)
    return F.coalesce(F.least(F.greatest(1 - apart * 2 * scale, F.lit(0.0)), F.lit(1.0)), F.lit(0.5))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; null where one has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > _EPS, F.least(F.greatest(dot(a, b) / size, F.lit(-1.0)), F.lit(1.0)))


def pearson(a: Column, b: Column) -> Column:
    """The correlation of two vectors of one length of two or more; null where one does not vary."""
    centred = lambda v: F.transform(v, lambda x: x - F.aggregate(v, F.lit(0.0), lambda s, y: s + y) / F.size(v))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) >= 2), cosine(centred(a), centred(b)))


def pair_scores(pairs: DataFrame) -> DataFrame:
    """``pairs`` of :func:`page_sides` with metadata_score, geometry_score, texture_score, condition_score and score.

    Pages have filter, color, images, width (of the main image, or null),
    aspect, megapixels, spectrum, noise, blocks, light, sharpness.
    """
    c = lambda n: (F.col(f"a_{n}"), F.col(f"b_{n}"))

    def alike(name: str, same: int, unknown: int) -> Column:
        a, b = (F.nullif(x, F.lit("")) for x in c(name))
        return F.when(a == b, same).when(a.isNotNull() & b.isNotNull(), 0).otherwise(unknown)

    wide = F.when((F.coalesce("a_width", F.lit(0)) > 0) & (F.coalesce("b_width", F.lit(0)) > 0), 15).otherwise(0)
    metadata = F.least(alike("filter", 45, 20) + alike("color", 25, 10) + wide + F.when(F.col("a_images") == F.col("b_images"), 15).otherwise(0), F.lit(100)).cast("double")
    spectrum = F.coalesce((cosine(*c("spectrum")) + 1) / 2, F.lit(0.5))
    scored = pairs.select(
        "*", metadata.alias("metadata_score"), (100 * (0.55 * similarity(*c("aspect"), 0.8) + 0.45 * similarity(*c("megapixels"), 0.5))).alias("geometry_score"),
        (100 * (0.65 * spectrum + 0.25 * similarity(*c("noise"), 0.6) + 0.10 * similarity(*c("blocks"), 0.5))).alias("texture_score"), (100 * (0.55 * similarity(*c("light"), 0.45) + 0.45 * similarity(*c("sharpness"), 0.25))).alias("condition_score"),
    )
    return scored.withColumn("score", sum((F.col(f"{k}_score") * w for k, w in PAIR_WEIGHTS.items()), F.lit(0.0)))


def pair_verdict(score: Column) -> Column:
    return ladder(*((score >= least, name) for least, name in PAIR_BANDS), otherwise=DIFFERENT)


def document_verdict(median: Column, least: Column) -> Column:
    """What the scores of all pairs of a document's pages say."""
    return ladder(*(((median >= m) & (least >= LEAST_SCORES.get(m, float("-inf"))), name) for m, name in PAIR_BANDS), otherwise=DIFFERENT)


def mismatches(pairs: DataFrame, statistics: list[str]) -> DataFrame:
    """``pairs`` with spectral, statistic, row_r, column_r and mismatch (0 to 100) from spectrum, rows, columns, row_bands, column_bands and ``statistics``."""
    c = lambda n: (F.col(f"a_{n}"), F.col(f"b_{n}"))
    relative = lambda n: F.abs(c(n)[0] - c(n)[1]) / (F.abs(c(n)[0]) + F.abs(c(n)[1]) + _EPS)
    w = SCANNER_WEIGHTS
    weight = lambda n: F.least(F.lit(w["most"]), (c(n)[0] + c(n)[1]) * w["bands"])
    parts = pairs.select(
        "*", F.coalesce((1 - cosine(*c("spectrum"))) / 2, F.lit(0.0)).alias("spectral"), F.least(sum((relative(n) for n in statistics), F.lit(0.0)) / len(statistics) * 2, F.lit(1.0)).alias("statistic"),
        pearson(*c("rows")).alias("row_r"), pearson(*c("columns")).alias("column_r"), weight("row_bands").alias("_rw"), weight("column_bands").alias("_cw"),
    )
    apart = lambda r: F.coalesce((1 - F.col(r)) / 2, F.lit(0.0))
    total = (F.col("spectral") * w["spectral"] + F.col("statistic") * w["statistic"] + apart("row_r") * F.col("_rw") + apart("column_r") * F.col("_cw")) / (w["spectral"] + w["statistic"] + F.col("_rw") + F.col("_cw"))
    return parts.withColumn("mismatch", mismatch_score(total)).drop("_rw", "_cw")


def mismatch_score(share: Column) -> Column:
    """A mismatch from 0 on as a score of 0 to 100."""
    return F.least(F.greatest(100 * (1 - F.exp(-STEEPNESS * share)), F.lit(0.0)), F.lit(100.0))


def overall_risk(page: Column, region: Column, pair: Column, pages: Column, pairs: Column) -> Column:
    """A document's risk from its highest scores (null for none), its number of analysed pages and of pairs."""
    p, r, m = (F.coalesce(c, F.lit(0.0)) for c in (page, region, pair))
    (p_mid, p_high), (r_mid, r_high), (m_mid, m_high) = RISK_SCORES["page"], RISK_SCORES["region"], RISK_SCORES["pair"]
    single = (pages < 2) & page.isNull()
    return ladder(
        (single & (r >= r_mid), "medium"), (single, "low"), (p >= p_high, "high"), ((m >= m_high) & (pairs == 1), "high"), ((p >= p_mid) | (r >= r_mid) | (m >= m_mid), "medium"), otherwise="low"
    )


def document_risk(signals: Column) -> Column:
    """The risk of a file's editing signals, an array of names."""
    held = F.array_distinct(F.coalesce(signals, F.array().cast("array<string>")))
    among = lambda names: F.size(F.array_intersect(held, F.array(*(F.lit(n) for n in names)))) > 0
    return ladder((F.size(held) == 0, "low"), ((F.size(held) >= 3) | (among(EDITORS) & F.array_contains(held, "incremental_update")), "high"), ((F.size(held) >= 2) | among(STRONG), "medium"), otherwise="low")


def font_origin(web_producer: Column, web: Column, system: Column, characters: Column, coverage: Column) -> Column:
    """Where a file seems to come from: by its text and images, else by its producer and its fonts."""
    return ladder(
        ((characters < 100) & (coverage > 60), "scanned"), ((characters > 100) & (coverage > 60), "scanned with text layer"), (web_producer & system & ~web, "browser, official"), (web_producer & web & ~system, "browser, recreated"),
        (web_producer & web & system, "browser, mixed"), (web_producer, "browser, unclear"), (web & ~system, "web generator"), (system & ~web, "desktop application"), (system & web, "mixed"), otherwise="unknown",
    )


def body_norms(parts: DataFrame, keys: list[str], height: str, measures: dict[str, float]) -> DataFrame:
    """``parts`` with field_text and <measure>_ratio: each measure against the median of the page's ordinary text.

    ``measures`` names them with the norm of a page that has none. Stroke
    width counts by height (its measure is stroke / height).
    """
    mid = parts.groupBy(*keys).agg(F.median(height).alias("_mid"))
    placed = parts.join(mid, keys).withColumn("field_text", (F.col(height) >= FIELD_HEIGHT[0] * F.col("_mid")) & (F.col(height) <= FIELD_HEIGHT[1] * F.col("_mid")))
    norms = placed.where("field_text").groupBy(*keys).agg(*(F.median(F.when(F.col(m) > _EPS, F.col(m))).alias(f"_{m}") for m in measures))
    joined = placed.join(norms, keys, "left")
    ratios = [F.when(F.coalesce(f"_{m}", F.lit(default)) > _EPS, F.col(m) / F.coalesce(f"_{m}", F.lit(default))).otherwise(F.lit(default)).alias(f"{m}_ratio") for m, default in measures.items()]
    return joined.select(*parts.columns, "field_text", *ratios)


def eye_pairs(spots: DataFrame, keys: list[str], ident: str, width: Column, height: Column) -> DataFrame:
    """Spots (x, y: centres) of one face that may be its eyes: apart by 0.16 to 0.72 of its width, at most 0.22 of its height."""
    side = lambda p: spots.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in (ident, "x", "y")), width.alias(f"{p}_w"), height.alias(f"{p}_h"))
    both = side("a").join(side("b"), keys).where(F.col(f"a_{ident}") < F.col(f"b_{ident}"))
    across, down = F.abs(F.col("a_x") - F.col("b_x")), F.abs(F.col("a_y") - F.col("b_y"))
    return both.where((across >= 0.16 * F.col("a_w")) & (across <= 0.72 * F.col("a_w")) & (down <= 0.22 * F.col("a_h"))).select(*keys, f"a_{ident}", f"b_{ident}")


def anchor_words(words: Column) -> Column:
    """Places for a signature in a line's words, in order: issuing authority, authorized signatory, signature, signatory, signed, sign; none in lines about digital signatures."""
    line = F.lower(F.array_join(words, " "))
    bare = F.transform(words, lambda w: F.regexp_replace(F.lower(w), "[^a-z]", ""))
    after = lambda i: F.coalesce(F.get(bare, i + 1), F.lit(""))

    def phrase(w: Column, i: Column) -> Column:
        two = F.when(F.startswith(w, F.lit("issuing")) & F.startswith(after(i), F.lit("author")), "issuing authority").when(F.startswith(w, F.lit("authorized")) & F.startswith(after(i), F.lit("signator")), "authorized signatory")
        one = F.when(F.startswith(w, F.lit("signature")), "signature").when(F.startswith(w, F.lit("signatory")), "signatory").when(w.isin("signed", "sign"), w)
        used = F.startswith(w, F.lit("signator")) & F.startswith(F.coalesce(F.get(bare, F.greatest(i - 1, F.lit(0))), F.lit("")), F.lit("authorized")) & (i > 0)
        return F.when(F.startswith(w, F.lit("issuing")) | F.startswith(w, F.lit("authorized")), two).when(used, None).otherwise(one)

    found = F.filter(F.transform(bare, phrase), lambda p: p.isNotNull())
    return F.when(F.rlike(line, F.lit("|".join(NO_ANCHOR))), F.array().cast("array<string>")).otherwise(found)


def covered(boxes: DataFrame, others: DataFrame, on: list[str], ident: str) -> DataFrame:
    """``boxes`` (x, y, width, height) with the share of each that ``others`` of the same ``on`` cover, overlaps counted each."""
    b = others.select(*on, *(F.col(c).alias(f"o_{c}") for c in (ident, "x", "y", "width", "height")))
    span = lambda at, size: F.greatest(F.lit(0.0), F.least(F.col(at) + F.col(size), F.col(f"o_{at}") + F.col(f"o_{size}")) - F.greatest(F.col(at), F.col(f"o_{at}")))
    area = F.when(F.col(ident) != F.col(f"o_{ident}"), span("x", "width") * span("y", "height")).otherwise(0.0)
    total = boxes.join(b, on).groupBy(*boxes.columns).agg(F.sum(area).alias("_a"))
    return total.withColumn("covered", F.col("_a") / (F.col("width") * F.col("height"))).drop("_a")
