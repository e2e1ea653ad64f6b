"""Signals over measured features: candidates, bands, tiers and ladders, each a Column of other Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a glyph may measure in pixels at 200 dots per inch, in shares of its page and by its sides; a blob is large both ways.
GLYPH = {"dpi": 200, "height": (10, 100), "width": (3, 170), "area": 40, "page_area": 0.10, "page_width": 0.55, "aspect": 12.0, "blob": (120, 70)}
#: From when signals of overwriting and of thick strokes count, and how large a mark must be.
OVERWRITING = {"ink": 1.9, "stroke": 2.0, "blob": 0.22, "solidity": 0.55, "solidity_ratio": 0.6, "area": 120, "signals": 2}
STROKE = {"ratio": 1.8, "area": 120, "group": 3, "gap": 2.0}
#: Tiers by the greatest ratio and the number of thick strokes; capture classes by light, bands and blocks; lighting and focus.
STROKE_TIERS = {"high": (2.5, 5), "medium": (2.0, 2)}
CAPTURE = {"camera": (0.115, 0.46), "scanner": (0.11, 0.085), "blocks": (1.18, 0.08)}
CONDITION = {"uneven": (0.32, 0.085), "soft": 0.003, "sharp": 0.025}
#: How the wide search multiplies a scan's own resolution, by effort.
LADDERS = {"low": [], "medium": [1.0, 1.2, 1.4, 1.6, 1.8], "high": [0.8, 1.0, 1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 1.8, 2.0]}
#: What a photo may measure in shares of its page, by aspect and in pixels.
PHOTO = {"share": (0.003, 0.18), "aspect": (0.4, 1.3), "width": 40, "height": 50, "top": 8}
#: Keys whose values say nothing about a document.
NOISE_KEYS = ["raw_payload", "url", "url_domain", "url_path", "url_path_tail", "signature", "sig", "hash", "digest", "signeddata", "signed_data"]


def ladder(*rungs: tuple[Column, str], otherwise: str) -> Column:
    """The value of the first condition that holds; a null condition does not."""
    out = F.lit(otherwise)
    for condition, value in reversed(rungs):
        out = F.when(F.coalesce(condition, F.lit(False)), value).otherwise(out)
    return out


def between(c: Column, low: float, high: float) -> Column:
    return (c > low) & (c < high)


def is_glyph(w: Column, h: Column, area: Column, page_w: Column, page_h: Column, dpi: Column) -> Column:
    """Whether a component may be a written character: no speck, no block or emblem, no rule across the page."""
    unit = dpi / GLYPH["dpi"]
    fits = lambda v, sides: (v >= sides[0] * unit) & (v <= sides[1] * unit)
    blob = (w > GLYPH["blob"][0] * unit) & (h > GLYPH["blob"][1] * unit)
    shape = (w * h <= GLYPH["page_area"] * page_w * page_h) & (w <= GLYPH["page_width"] * page_w) & (F.greatest(w, h) <= GLYPH["aspect"] * F.least(w, h))
    return fits(h, GLYPH["height"]) & fits(w, GLYPH["width"]) & (area >= GLYPH["area"] * unit) & ~blob & shape


def is_photo(w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    return between(w * h / F.greatest(page_w * page_h, F.lit(1.0)), *PHOTO["share"]) & between(w / F.greatest(h, F.lit(1.0)), *PHOTO["aspect"]) & (w > PHOTO["width"]) & (h > PHOTO["height"])


def largest(rows: DataFrame, keys: list[str], size: str, order: str, top: int) -> DataFrame:
    """The ``top`` largest rows of each group."""
    w = Window.partitionBy(*keys).orderBy(F.desc(size), order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top).drop("_n")


def row_links(parts: DataFrame, keys: list[str], ident: str, gap: float = STROKE["gap"]) -> DataFrame:
    """(a, b): components of one page on one text row with a small gap between them; x, y, width, height in pixels."""
    side = lambda p: parts.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in (ident, "x", "y", "width", "height")))
    both = side("a").join(side("b"), keys).where(F.col(f"a_{ident}") < F.col(f"b_{ident}"))
    tall = F.greatest("a_height", "b_height")
    apart = F.abs((F.col("a_y") + F.col("a_height") / 2) - (F.col("b_y") + F.col("b_height") / 2))
    space = F.greatest("a_x", "b_x") - F.least(F.col("a_x") + F.col("a_width"), F.col("b_x") + F.col("b_width"))
    return both.where((apart <= 0.6 * tall) & (space <= gap * tall)).select(F.col(f"a_{ident}").alias("a"), F.col(f"b_{ident}").alias("b"))


def triggered(**signals: Column) -> Column:
    """The names of the signals that hold, in order."""
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in signals.items())), lambda s: s.isNotNull())


def overwriting_tier(signals: Column) -> Column:
    return ladder((F.size(signals) >= 3, "high"), (F.size(signals) == 2, "medium"), otherwise="low")


def overwriting_signals(ink: Column, stroke: Column, blob: Column, solidity: Column, solidity_ratio: Column) -> Column:
    """Which signals of overwriting a mark shows: full, thick, with a dark blob, ragged both by itself and beside its neighbours."""
    o = OVERWRITING
    return triggered(high_ink_density=ink > o["ink"], high_stroke_thickness=stroke > o["stroke"], dark_blob=blob > o["blob"], complex_contour=(solidity < o["solidity"]) & (solidity_ratio < o["solidity_ratio"]))


def is_overwritten(signals: Column, area: Column, field_text: Column) -> Column:
    return (F.size(signals) >= OVERWRITING["signals"]) & (area >= OVERWRITING["area"]) & F.coalesce(field_text, F.lit(True))


def is_thick(ratio: Column, area: Column, field_text: Column) -> Column:
    return (ratio > STROKE["ratio"]) & (area >= STROKE["area"]) & F.coalesce(field_text, F.lit(True))


def stroke_tier(greatest_ratio: Column, count: Column) -> Column:
    tiers = [((greatest_ratio >= ratio) | (count >= n), tier) for tier, (ratio, n) in STROKE_TIERS.items()]
    return ladder((count == 0, "low"), *tiers, otherwise="low")


def photo_quality(blur: Column, brightness: Column) -> Column:
    return ladder((blur < 80, "image_too_blurry"), (~between(brightness, 35, 225), "bad_lighting"), otherwise="ok")


def capture_class(illum_std: Column, illum_range: Column, rows: Column, columns: Column, blocks: Column) -> Column:
    """What took a page's picture, by its light, its bands of rows or columns, and its blocks."""
    light, bands, squares = CAPTURE["camera"], CAPTURE["scanner"], CAPTURE["blocks"]
    camera = "camera-photo-like"
    return ladder(
        ((illum_std > light[0]) | (illum_range > light[1]), camera), ((F.greatest(rows, columns) > bands[0]) & (illum_std < bands[1]), "scanner-like"), ((blocks > squares[0]) & (illum_std > squares[1]), camera), otherwise="mixed-or-uncertain"
    )


def condition_note(illum_std: Column, illum_range: Column, sharpness: Column) -> Column:
    """What a page's light and focus are like."""
    light = F.when((illum_range > CONDITION["uneven"][0]) | (illum_std > CONDITION["uneven"][1]), "uneven lighting/shadow")
    focus = F.when(sharpness < CONDITION["soft"], "soft/blurred capture").when(sharpness > CONDITION["sharp"], "very sharp/high-contrast capture")
    return F.coalesce(F.nullif(F.concat_ws("; ", light, focus), F.lit("")), F.lit("normal phone-photo variation"))


def whitener_band(probability: Column, pages: Column, indeterminate: Column) -> Column:
    return ladder(((pages > 0) & (indeterminate == pages), "insufficient_signal"), (probability >= 0.6, "likely_whitener"), (probability >= 0.35, "possible_whitener"), otherwise="no_whitener_evidence")


def whitener_review(probability: Column, threshold: Column, pages: Column, indeterminate: Column) -> Column:
    """The band of :func:`whitener_band`, overridden by one threshold where there is a probability."""
    held = ladder((probability >= threshold, "likely_whitener"), otherwise="no_whitener_evidence")
    return F.when(probability.isNull(), whitener_band(probability, pages, indeterminate)).otherwise(held)


def shortfall(count: Column, required: Column) -> Column:
    """How many codes or signatures are missing of those required, at least one."""
    return F.greatest(F.lit(0), F.greatest(F.lit(1), F.coalesce(required, F.lit(1))) - F.coalesce(count, F.lit(0)))


def short_of(count: Column, required: Column, what: str) -> Column:
    """What lies over a result that has fewer codes or signatures than required: (passed, risk, verdict, note); null where it has enough."""
    note = F.format_string("Expected at least %d " + what + ", found %d", required.cast("bigint"), F.coalesce(count, F.lit(0)).cast("bigint"))
    return F.when(F.coalesce(count, F.lit(0)) < required, F.struct(F.lit(False).alias("passed"), F.lit("medium").alias("risk"), F.lit(f"{what}_below_minimum").alias("verdict"), note.alias("note")))


def dpi_ladder(native: Column, effort: str) -> Column:
    """The resolutions to try for a scan: multiples of its own, to tens, within 150 and 900, each once in order."""
    rung = lambda m: F.least(F.greatest(F.bround(native * m / 10, 0) * 10, F.lit(150.0)), F.lit(900.0)).cast("int")
    return F.array_distinct(F.transform(F.array(*(F.lit(m) for m in LADDERS[effort])), rung))


def is_token(value: Column) -> Column:
    """Whether a value is for machines: 18 characters or more of the alphabets of keys, no blank."""
    v = F.trim(value)
    return (F.length(F.regexp_replace(v, "[^A-Za-z0-9+/=_-]+", "")) >= 18) & ~F.contains(v, F.lit(" "))


def is_noise(key: Column, value: Column) -> Column:
    """Whether a field's value says nothing about the document: links, machine tokens, too short or too long, signatures."""
    v = F.trim(value)
    return F.lower(key).isin(NOISE_KEYS) | F.rlike(F.lower(v), F.lit("^https?://")) | (F.length(v) < 3) | (F.length(v) > 180) | is_token(v)


def code_verdict(found: Column, matched: Column, total: Column, visited: Column | None = None, opened: Column | None = None, fields: Column | None = None, fields_matched: Column | None = None, seen: Column | None = None) -> Column:
    """What comparing a code's fields with its document says, and with the pages it links to where they were visited.

    ``visited`` and ``opened`` count pages, ``fields`` and ``fields_matched``
    their labelled fields, ``seen`` other matches on them.
    """
    visited, opened, fields, fields_matched, seen = (F.lit(0) if c is None else c for c in (visited, opened, fields, fields_matched, seen))
    web = opened > 0
    return ladder(
        (~found, "fail_no_qr"), ((visited > 0) & ~web, "review_url_check_failed"), (web & (fields > 0) & (fields_matched == fields), "pass_url_cross_checked"), (web & (fields_matched > 0), "review_url_partial_structured_match"),
        (web & (seen > 0), "pass_url_cross_checked"), (web & (total == 0), "review_url_opened_no_details_found"), (total == 0, "review_no_structured_qr_details"), (matched == total, "pass"), (matched > 0, "review_partial_match"), otherwise="fail_no_details_matched",
    )


def readability_score(passed: Column, ran: Column) -> Column:
    """The share of executed sub-tests that passed, cut to a whole percentage; 0 if none ran."""
    return F.coalesce(F.floor(F.try_divide(100 * passed, ran)), F.lit(0)).cast("int")


def readability_level(score: Column, missing: Column, ocr_words: Column, text_layer: Column, critical: Column) -> Column:
    """A document's level: incomplete while sub-tests could not run, else by its words, its text layer, its score and its critical failures."""
    return ladder((missing > 0, "incomplete"), (ocr_words & text_layer & (score >= 70), "readable"), (ocr_words & ~text_layer, "readable"), ((score >= 80) & (critical == 0), "readable"), ((score >= 50) | (critical <= 1), "poor_readability"), otherwise="unreadable")


def model_review(risk: Column, severities: Column, reviewed: Column, total: Column) -> Column:
    """A model's review of some of a document's pages as (status, passed, risk, verdict); ``severities`` are those of its findings on reviewed pages."""
    rank = lambda s: F.coalesce(F.create_map(F.lit("unknown"), F.lit(0), F.lit("low"), F.lit(1), F.lit("medium"), F.lit(2), F.lit("high"), F.lit(3))[s], F.lit(0))
    worst_ = F.greatest(rank(risk), F.coalesce(F.array_max(F.transform(severities, rank)), F.lit(0)))
    acts, partial = F.exists(severities, lambda s: s.isin("medium", "high")), reviewed < total
    named = F.element_at(F.array(*(F.lit(x) for x in ("unknown", "low", "medium", "high"))), worst_ + 1)
    return F.struct(
        F.when(partial & ~acts, "inconclusive").otherwise("completed").alias("status"), F.when(acts, False).when(~partial, True).alias("passed"),
        F.when(acts, named).when(partial, "unknown").otherwise("low").alias("risk"), F.when(acts, "visual_review_signals").when(partial, "partial_review").otherwise("clear").alias("verdict"),
    )


def worst(severity: Column) -> Column:
    """An aggregate: the worst of low, medium and high; low for none."""
    rank = F.coalesce(F.create_map(F.lit("low"), F.lit(0), F.lit("medium"), F.lit(1), F.lit("high"), F.lit(2))[severity], F.lit(0))
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.max(rank) + 1)


def chosen_pages(total: Column, limit: int, preferred: Column) -> Column:
    """At most ``limit`` of ``total`` pages, ascending: preferred ones, the first, the last, then evenly spaced ones, then from the first on."""
    every = F.when(total >= 1, F.sequence(F.lit(1), F.greatest(total, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    wanted = F.filter(F.concat(F.coalesce(preferred, F.array().cast("array<int>")), F.array(F.lit(1), total)), lambda p: (p >= 1) & (p <= total))
    spaced = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: (1 + F.bround(i * (total - 1) / max(limit - 1, 1), 0)).cast("int"))
    picked = F.slice(F.array_distinct(F.concat(wanted, F.when(total > 0, spaced).otherwise(F.array().cast("array<int>")), every)), F.lit(1), F.lit(limit))
    return F.when(total <= limit, every).otherwise(F.array_sort(picked))


def compared(documents: DataFrame, web: DataFrame, key: str, field: str, value: str) -> DataFrame:
    """(key, field, a, b, state): fields of a document and of its web page side by side; state is match, differs, missing or extra."""
    a, b = documents.select(key, field, F.col(value).alias("a")), web.select(key, field, F.col(value).alias("b"))
    joined = a.join(b, [key, field], "full")
    return joined.withColumn("state", ladder((F.col("a").isNull(), "extra"), (F.col("b").isNull(), "missing"), (F.lower(F.trim("a")) == F.lower(F.trim("b")), "match"), otherwise="differs"))
