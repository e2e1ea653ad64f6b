"""Values that were cut on their way: hidden storage limits and broken endings.

Lengths of all values are recomputed as a store might have counted them
(characters, UTF-8 bytes, UTF-16 units, after entity or JSON escaping, with
two-byte line ends) and grouped by source. A length at which a source's values
pile up, beyond its neighbouring lengths and beyond what the other sources'
values of the same labels do, is a limit of that source; it can have several.
Endings are then inspected against what whole values of the label look like
everywhere: sentences that stop, list items and last words that recur, a fixed
length, balanced JSON. A value with an open ending at a limit was cut there,
one with an open ending elsewhere was cut in transfer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.session import dropped, written_at

#: A short value, an ending or an item counts as whole from this share of its label's values, and from RECURS jobs or occurrences;
#: values and endings must come from two sources at least, as a cut at one source's limit recurs there only.
SHARE, ENDING_SHARE, RECURS = 0.001, 0.005, 3

#: A limit needs so many values at one length, so many times as many as the ten lengths below it have on average,
#: and so many times as many as the other sources have at it by their labels.
#: It is one only if so many of the values at it, and this share of them, have an open ending.
AT_LIMIT, OVER_NEIGHBOURS, OVER_OTHERS = 8, 4.0, 3.0
OPEN_AT_LIMIT, OPEN_SHARE = 5, 0.2

#: Whole lists may end at a limit by chance; beyond this multiple of what neighbouring lengths have, they do not.
EXCESS = 2.0

#: An abbreviation with its stop ends a sentence if it stands at the end of this share of the values that have it; items are looked up by name from this share of their label's.
CLOSING_SHARE, NAMED_SHARE = 0.05, 1e-5

_TERMINAL = r"""[.!?।。！？؟]["”»’')\]]*$"""
#: Full stops that end no sentence: abbreviations, and numbers that go on behind a point.
_ABBREVIATION = r"""(?i)(^|[\s("])(e\.g|i\.e|approx|ca|no|nos|nr|p|pp|sec|vs|mr|mrs|ms|dr|st|z\.b|d\.h|(sec\.|approx\.|version|v)\s?\d[\d.]*)\.$"""
_SHORT = r"\s(?:[Ee]\.g|[Ii]\.e|[Aa]pprox|[Cc]a|[Nn]os?|NOS?|[Nn]r|[Pp]{1,2}|[Ss]ec|[Vv]s|[Mm]rs?|[Mm]s|[Dd]r|[Ss]t|[Zz]\.[Bb]|[Dd]\.[Hh])\.(?:\s|$)"
_TAIL = r"(?i)(\S+\s+(?:e\.g|i\.e|approx|ca|no|nos|nr|p|pp|sec|vs|mr|mrs|ms|dr|st|z\.b|d\.h)\.)(?=\s|$)"


#: What a value without any of these has one length by, whatever the measure.
_SPECIAL = r"""[^\x20-\x7E]|["\\&<>']"""


def counts(v: Column) -> dict[str, Column]:
    """What the measures add up: characters, bytes, and how often the characters stand that some store writes longer."""
    special = F.rlike(v, F.lit(_SPECIAL))
    count = lambda pattern: F.when(special, F.regexp_count(v, F.lit(pattern))).otherwise(0)
    lost = F.when(F.endswith(v, F.lit("\ufffd")), 1).otherwise(0)  # a last character that was split counts for nothing
    return {
        "special": special,
        "chars": F.char_length(v) - lost,
        "octets": F.octet_length(v) - 3 * lost,
        "lost": lost,
        "other": F.when(F.octet_length(v) > F.char_length(v), F.regexp_count(v, F.lit(r"[^\x00-\x7F]"))).otherwise(0) - lost,
        "astral": F.when(F.octet_length(v) >= F.char_length(v) + 3, F.regexp_count(v, F.lit(r"[\x{10000}-\x{10FFFF}]"))).otherwise(0),
        "escaped": count(r"""["\\\n\r\t\x08\x0C]"""),
        "lines": count(r"(?<!\r)\n"),
        "ampersands": count("&"),
        "angles": count("[<>]"),
        "quotes": count('"'),
        "apostrophes": count("'"),
    }


def sizes(c: dict[str, Column]) -> dict[str, Column]:
    """The length of a value as different stores count it, from its :func:`counts`."""
    entities = 4 * c["ampersands"] + 3 * c["angles"] + 5 * c["quotes"]
    return {
        "characters": c["chars"],
        "utf8": c["octets"],
        "utf16": c["chars"] + c["astral"],
        "html": c["chars"] + entities,
        "html_apostrophe": c["chars"] + entities + 5 * c["apostrophes"],
        "html_utf8": c["octets"] + entities,
        "json": c["chars"] + c["escaped"],
        "json_utf8": c["octets"] + c["escaped"],
        "json_ascii": c["chars"] + c["escaped"] + 5 * c["other"] + 6 * c["astral"],
        "crlf": c["chars"] + c["lines"],
        "crlf_utf8": c["octets"] + c["lines"],
    }


def measures(v: Column) -> dict[str, Column]:
    """The length of ``v`` as different stores count it; a last character that was split counts for nothing."""
    return sizes(counts(v))


#: The names of the measures, the plainest first.
MEASURES = ["characters", "utf8", "utf16", "html", "html_apostrophe", "html_utf8", "json", "json_utf8", "json_ascii", "crlf", "crlf_utf8"]


def _shape(item: Column) -> Column:
    """Runs of small letters as one, digits and capitals one by one: the form of a code or link."""
    return F.regexp_replace(F.regexp_replace(item, "[a-z]+", "a"), "[A-Z0-9]", "X")


def _described(facts: DataFrame) -> DataFrame:
    v = F.rtrim(F.col("value"))
    items = F.split(v, ", ")
    kept = facts.where("value is not null and value <> ''").select("fact_id", F.col("source"), F.coalesce("label", F.lit("")).alias("label"), "job_id", "value")
    return kept.select(
        "*",
        v.alias("v"),
        (F.col("value") != v).alias("trailing"),
        # Patterns of bounded length at the end need no search through the value.
        F.rlike(F.right(v, F.lit(32)), F.lit(_TERMINAL)).alias("stops"),
        (F.endswith(v, F.lit(".")) & F.rlike(F.right(v, F.lit(64)), F.lit(_ABBREVIATION))).alias("short"),
        (F.endswith(v, F.lit("…")) | F.endswith(v, F.lit("...")) | F.endswith(v, F.lit("\ufffd"))).alias("marked"),
        items.alias("items"),
        F.element_at(items, -1).alias("last_item"),
        # The last word with its digits alike; a trailing comma is an ending too.
        F.translate(F.substring_index(F.translate(v, "\t\r\n", "   "), " ", -1), "123456789", "000000000").alias("ending"),
    )


def _label_kinds(d: DataFrame) -> DataFrame:
    """``(label, total, kind, fixed)``: sentences, fixed (all of one length), list, or words."""
    by_length = d.groupBy("label", F.char_length("v").alias("n"), F.contains("v", F.lit(" ")).alias("spaced")).agg(
        F.count("*").alias("c"), F.count_if(F.col("stops") & ~F.col("short")).alias("t"), F.count_if(F.size("items") > 1).alias("l")
    )
    whole = by_length.groupBy("label").agg(
        F.sum("c").alias("total"), F.sum("t").alias("t"), F.sum("l").alias("l"), F.max(F.when(~F.col("spaced"), F.struct("c", "n"))).alias("mode")
    )
    kind = (
        F.when(F.col("t") >= 0.4 * F.col("total"), "sentences")
        .when((F.col("mode.c") >= 0.6 * F.col("total")) & (F.col("mode.n") >= 16), "fixed")
        .when(F.col("l") >= 0.15 * F.col("total"), "list")
        .otherwise("words")
    )
    return whole.select("label", "total", kind.alias("kind"), F.col("mode.n").alias("fixed"))


def _recurring(rows: DataFrame, key: Column, share: float, name: str) -> DataFrame:
    """(label, key): keys of ``rows`` that enough values share; at most 1/share for each label."""
    often = rows.groupBy("label", "total", key.alias(name)).agg(F.count("*").alias("c"), F.min("job_id").alias("j"), F.max("job_id").alias("k"), F.min("source").alias("a"), F.max("source").alias("b"))
    enough = (F.col("c") >= RECURS) & (F.col("c") >= share * F.col("total")) & (F.col("j") != F.col("k")) & (F.col("a") != F.col("b"))
    return often.where(enough).select("label", name, F.lit(True).alias(f"known_{name}"))


def _closing(d: DataFrame) -> DataFrame:
    """(label, tail): a word and an abbreviation that end whole values often enough to be the end of a sentence."""
    held = d.where(F.rlike("v", F.lit(_SHORT))).select("label", "source", "short", F.transform(F.regexp_extract_all("v", F.lit(_TAIL), 1), lambda t: F.regexp_replace(t, r"\s+", " ")).alias("tails"))
    own = held.where(F.size("tails") > 0).select("label", "source", F.explode(F.array_distinct("tails")).alias("tail"), F.when(F.col("short"), F.element_at("tails", -1)).alias("last"))
    ends = F.col("tail").eqNullSafe(F.col("last"))
    counted = own.groupBy("label", "tail").agg(F.count("*").alias("held"), F.count_if(ends).alias("ending"), F.min(F.when(ends, F.col("source"))).alias("a"), F.max(F.when(ends, F.col("source"))).alias("b"))
    enough = (F.col("ending") >= RECURS) & (F.col("ending") >= CLOSING_SHARE * F.col("held")) & (F.col("a") != F.col("b"))
    return counted.where(enough).select("label", "tail", F.lit(True).alias("closing"))


def inspected(facts: DataFrame, places: list[str]) -> DataFrame:
    """Facts whose ending is open, and lists with a whole last item: fact_id, source, label, value, open.

    What whole values look like is gathered in tables that are small by their
    thresholds and written first (their places are added to ``places``), so
    that their size is known and the facts need no shuffle to meet them.
    """

    def kept(df: DataFrame, name: str) -> DataFrame:
        df, at = written_at(df, name)
        places.append(at)
        return df

    d = _described(facts)
    d = d.join(kept(_label_kinds(d), "kinds"), "label")
    value, last, shape = F.xxhash64("value"), F.xxhash64("last_item"), _shape(F.col("last_item"))
    phrases = kept(_recurring(d, value, SHARE, "phrase"), "phrase")
    endings = kept(_recurring(d.where("kind = 'words'"), F.col("ending"), ENDING_SHARE, "ending"), "ending")
    closing = kept(_closing(d.where("kind = 'sentences'")), "closing")
    # Items before the last are whole whatever happened to the value.
    inner = d.where("kind = 'list'").select("label", F.explode(F.slice("items", F.lit(1), F.size("items") - 1)).alias("last_item"))
    known = kept(inner.groupBy("label", shape.alias("shape"), last.alias("item")).agg(F.count("*").alias("c")), "known")
    coverage = kept(known.groupBy("label").agg(F.sum("c").alias("all"), (F.sum(F.when(F.col("c") >= RECURS, F.col("c")).otherwise(0)) >= 0.9 * F.sum("c")).alias("by_name")), "coverage")
    # Only labels whose items recur are looked up by name.
    common = known.join(coverage.where("by_name"), "label").where((F.col("c") >= RECURS) & (F.col("c") >= NAMED_SHARE * F.col("all")))
    named = kept(common.select("label", "item", F.lit(True).alias("known_item")).distinct(), "named")
    shapes = known.groupBy("label", "shape").agg(F.sum("c").alias("c")).join(coverage, "label")
    shapes = kept(shapes.where(F.col("c") >= ENDING_SHARE * F.col("all")).select("label", "shape", F.lit(True).alias("known_shape")), "shapes")
    tail = F.when((F.col("kind") == "sentences") & F.col("short"), F.regexp_replace(F.regexp_extract("v", r"(\S+\s+\S+)$", 1), r"\s+", " "))
    joined = (
        d.withColumn("shape", F.when(F.col("kind") == "list", shape))
        .withColumn("phrase", value)
        .withColumn("item", F.when(F.col("kind") == "list", last))
        .withColumn("tail", tail)
        .join(phrases, ["label", "phrase"], "left")
        .join(endings, ["label", "ending"], "left")
        .join(closing, ["label", "tail"], "left")
        .join(named, ["label", "item"], "left")
        .join(shapes, ["label", "shape"], "left")
        .join(coverage.select("label", "by_name"), "label", "left")
    )
    json_like = F.rlike("v", F.lit(r"^\s*[\[{]"))
    item = F.when(F.coalesce("by_name", F.lit(False)), F.col("known_item")).otherwise(F.col("known_shape"))
    complete = (
        F.when(F.coalesce("known_phrase", F.lit(False)), True)
        .when(json_like & F.try_parse_json("v").isNotNull(), True)
        .when(json_like, False)
        .when(F.col("marked") | F.col("trailing"), False)
        .when(F.col("kind") == "fixed", F.char_length("v") >= F.col("fixed"))
        .when(F.col("kind") == "sentences", F.col("stops") & (~F.col("short") | F.coalesce("closing", F.lit(False))))
        .when(F.col("kind") == "list", F.coalesce(item, F.lit(False)))
        .otherwise(F.coalesce("known_ending", F.lit(False)))
    )
    whole_list = (F.col("kind") == "list") & F.col("known_phrase").isNull()
    return joined.withColumn("open", ~complete).where(F.col("open") | whole_list).select("fact_id", "source", "label", "value", "open")


def _lengths(facts: DataFrame) -> DataFrame:
    """``(source, label, rank, n, c)``: how many values of a source and label have length n under each measure, by the measure's number."""
    counted = facts.where("value is not null and value <> ''").select("source", F.coalesce("label", F.lit("")).alias("label"), *(c.alias(n) for n, c in counts(F.col("value")).items()))
    # Without special characters all measures agree: one row for the eleven.
    each = F.array(*(F.struct(F.lit(i).alias("rank"), c.alias("n")) for i, c in enumerate(sizes({n: F.col(n) for n in counts(F.lit(""))}).values())))
    one = F.array(F.struct(F.lit(-1).alias("rank"), F.col("chars").alias("n")))
    agree = ~F.col("special") & (F.col("octets") == F.col("chars"))
    grouped = counted.select("source", "label", F.explode(F.when(agree, one).otherwise(each)).alias("m")).groupBy("source", "label", "m.rank", "m.n").agg(F.count("*").alias("c"))
    ranks = F.when(F.col("rank") < 0, F.sequence(F.lit(0), F.lit(len(MEASURES) - 1))).otherwise(F.array("rank"))
    return grouped.select("source", "label", F.explode(ranks).alias("rank"), "n", "c").groupBy("source", "label", "rank", "n").agg(F.sum("c").alias("c"))


def limits(facts: DataFrame, places: list[str]) -> DataFrame:
    """``(source, measure, limit, at_limit)``: lengths at which values pile up, from all values.

    What the other sources have at a length, label by label, is what whole
    values have there: fixed lengths and frequent values recur in all of them.
    """
    lengths, at = written_at(_lengths(facts), "lengths")
    places.append(at)
    own = lengths.where("rank = 0").groupBy("source", "label").agg(F.sum("c").alias("own"))
    labels = own.groupBy("label").agg(F.sum("own").alias("all"))
    sizes = own.join(labels, "label").withColumn("others", F.col("all") - F.col("own"))
    at_length = lengths.groupBy("label", "rank", "n").agg(F.sum("c").alias("everywhere"))
    joined = lengths.alias("l").join(at_length, ["label", "rank", "n"]).join(sizes.alias("s"), F.col("l.source").eqNullSafe(F.col("s.source")) & (F.col("l.label") == F.col("s.label")))
    expected = F.coalesce(F.try_divide((F.col("everywhere") - F.col("c")) * F.col("own"), F.col("others")), F.lit(0.0))
    piled = joined.groupBy("l.source", "rank", "n").agg(F.sum("c").alias("c"), F.sum(expected).alias("expected"))
    below = Window.partitionBy("source", "rank").orderBy("n").rangeBetween(-10, -1)
    peaks = piled.withColumn("below", F.coalesce(F.sum("c").over(below), F.lit(0)) / 10)
    found = peaks.where((F.col("c") >= AT_LIMIT) & (F.col("c") >= OVER_NEIGHBOURS * F.col("below")) & (F.col("c") >= OVER_OTHERS * F.col("expected")))
    # Of measures that agree on a length the plainest; of the measures of one store the one that gathers most.
    best = found.groupBy("source", "n").agg(F.max(F.struct(F.col("c"), (-F.col("rank")).alias("r"))).alias("p"))
    names = F.array(*(F.lit(m) for m in MEASURES))
    return best.select("source", F.get(names, (-F.col("p.r"))).alias("measure"), F.col("n").alias("limit"), F.col("p.c").alias("at_limit"))


def _sized(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with ``near``: the limits of their source at or above their length, each with ``room``, how far above."""
    held = found.groupBy("source").agg(F.collect_list(F.struct("at_limit", "measure", "limit")).alias("limits"))  # as many as the source has limits
    sizes = F.create_map(*(x for m, c in measures(F.col("value")).items() for x in (F.lit(m), c)))
    room = F.transform("limits", lambda x: F.struct(x["at_limit"].alias("at_limit"), x["measure"].alias("measure"), x["limit"].alias("limit"), (x["limit"] - F.col("sizes")[x["measure"]]).alias("room")))
    joined = rows.alias("r").join(held.alias("h"), F.col("r.source").eqNullSafe(F.col("h.source")), "left").select("r.*", "limits")
    return joined.withColumn("sizes", sizes).withColumn("near", F.filter(room, lambda x: x["room"] >= 0)).select(*rows.columns, "near")


def _confirmed(sized: DataFrame, found: DataFrame) -> DataFrame:
    """The limits at which endings are open, not only lengths frequent."""
    at = sized.where("open").select("source", F.explode(F.filter("near", lambda x: x["room"] <= 3)).alias("x"))
    opened = at.groupBy("source", "x.measure", "x.limit").agg(F.count("*").alias("opened"))
    joined = found.alias("f").join(opened.alias("o"), F.col("f.source").eqNullSafe(F.col("o.source")) & (F.col("f.measure") == F.col("o.measure")) & (F.col("f.limit") == F.col("o.limit")))
    return joined.where((F.col("opened") >= OPEN_AT_LIMIT) & (F.col("opened") >= OPEN_SHARE * F.col("at_limit"))).select("f.*")


def truncated(facts: DataFrame) -> DataFrame:
    """``(fact_id, source, label, measure, limit, by_limit)``: the facts whose value was cut.

    A value is cut if its ending is open: at a limit of its source (by_limit,
    with the measure and the limit) or in transfer. A list whose last item is
    whole is cut too if it ends exactly at a limit and far more lists of the
    label do than end just below it. Null and empty values are no cases;
    values that recur (terse ones, such as codes) are whole whatever their
    ending; repeated rows count on their own; a null label or source is one
    like any other; an empty table gives no rows.
    """
    places: list[str] = []
    found, at = written_at(limits(facts, places), "limits")
    places.append(at)
    ends, at = written_at(inspected(facts, places), "endings")
    places.append(at)
    sure, at = written_at(_confirmed(_sized(ends, found), found), "confirmed")
    places.append(at)
    # The limit that most values end at, of those the value ends at; else the next one above it.
    rank = F.transform("near", lambda x: F.struct(F.when(x["room"] <= 3, x["at_limit"]).otherwise(-1).alias("first"), (-x["room"]).alias("second"), x["measure"].alias("measure"), x["limit"].alias("limit"), x["room"].alias("room")))
    rows = _sized(ends, sure).withColumn("at", F.array_max(rank)).select("fact_id", "source", "label", "open", "at.measure", "at.limit", "at.room")
    near = rows.where("not open and room between 0 and 10").groupBy("source", "label", "measure", "limit").agg(F.count_if(F.expr("room = 0")).alias("at"), (F.count_if(F.expr("room > 0")) / 10).alias("below"))
    crowded = near.where((F.col("at") >= RECURS) & (F.col("at") > EXCESS * (F.col("below") + 0.5))).select("source", "label", "measure", "limit", F.lit(True).alias("crowded"))
    marked = rows.join(crowded, ["source", "label", "measure", "limit"], "left")
    at_limit = F.coalesce(F.col("room").between(0, 3), F.lit(False))
    chance = ~F.col("open") & (F.col("room") == 0) & F.coalesce("crowded", F.lit(False))
    cut = marked.where(F.col("open") | F.coalesce(chance, F.lit(False)))
    out, _ = written_at(cut.select("fact_id", "source", "label", F.when(at_limit, F.col("measure")).alias("measure"), F.when(at_limit, F.col("limit")).alias("limit"), at_limit.alias("by_limit")), "cut")
    dropped(facts.sparkSession, *places)
    return out


def report(facts: DataFrame) -> DataFrame:
    """``(source, facts, cut, share, at_limit, measure, limit)`` of each source, values or none; measure and limit are those that cut most."""
    held = truncated(facts)
    top = held.where("by_limit").groupBy("source", "measure", "limit").count().groupBy("source").agg(F.max(F.struct("count", "measure", "limit")).alias("top"))
    cut = held.groupBy("source").agg(F.count("*").alias("cut"), F.count_if("by_limit").alias("at_limit"))
    every = facts.groupBy("source").agg(F.count("*").alias("facts"))
    joined = every.alias("e").join(cut.alias("c"), F.col("e.source").eqNullSafe(F.col("c.source")), "left").join(top.alias("t"), F.col("e.source").eqNullSafe(F.col("t.source")), "left")
    n = F.coalesce("c.cut", F.lit(0))
    return joined.select("e.source", "facts", n.alias("cut"), (n / F.col("facts")).alias("share"), F.coalesce("c.at_limit", F.lit(0)).alias("at_limit"), "t.top.measure", "t.top.limit")
