"""Detector payloads to one result contract: envelope, rules, outcomes, summaries, facts, regions.

A result's payload is a VARIANT, kept as it came; everything else is a
projection of it, so rows of an older contract are graded anew without their
detectors. Each rule is a builder of Columns: a status (pass, fail,
inconclusive or info), the criterion, the reason and facts as displayed.
Values of a wrong type count as absent.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The analyzers of the service with what their detectors write, outcomes by status, risk words, caps.
OUTPUTS = {"metadata": "json", "font_analysis": "font", "signature": "report_dir", "photo_detection": "json", "qr_presence": "json", "tamper_scan": "whitener", "moire": "json", "same_phone": "json", "readability": "stdout"}
ANALYZERS = list(OUTPUTS)
OUTCOMES = {"pass": "clear", "fail": "review", "inconclusive": "inconclusive", "info": "info", "error": "error"}
RISKS = {"low": ["low", "none", "minimal", "clean"], "medium": ["medium", "moderate", "warning"], "high": ["high", "critical", "severe"]}
TAMPER_THRESHOLD = 0.35
FACT_CHARS, PAYLOAD_CHARS, MOST_REGIONS = 400, 120, 100
#: What generation kinds and editing signals are called.
ORIGINS = {"image_editor": "Image editor", "scanner": "Scanner or capture pipeline", "browser_or_converter": "Browser print or file converter", "office_export": "Office / typesetting export", "pdf_library": "PDF library or report writer", "unknown": "Unidentified"}
SIGNALS = {"incremental_update": "Re-saved after creation", "date_inconsistency": "Modified after creation", "editor_producer": "Produced by an image editor", "renderer_producer": "Produced by a browser/HTML renderer", "editor_image_metadata": "Embedded image carries editor tags", "suspicious_structure": "Interactive or overlay structure present"}
#: Fixed value: keys of a payload that are no evidence by themselves.
HIDDEN_KEYS = ["artifacts", "regions", "report", "detail", "hits", "value", "input", "timing", "status", "passed", "risk", "verdict", "file_verdict", "exit_code", "feature", "pdf_path", "file", "outputs", "pages", "tests", "score", "tests_passed", "tests_total"]

_NUMERIC = "^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|TINYINT|SMALLINT)"


# --- Members of a payload -----------------------------------------------------------------------------------------------


def member(raw: Column, path: str) -> Column:
    return F.try_variant_get(raw, path, "variant")


def kind_of(raw: Column, path: str) -> Column:
    return F.schema_of_variant(member(raw, path))


def is_number(raw: Column, path: str) -> Column:
    return F.coalesce(F.rlike(kind_of(raw, path), F.lit(_NUMERIC)), F.lit(False))


def get(raw: Column, path: str, kind: str = "string") -> Column:
    """A member of a VARIANT by path, null where it is absent or of another type."""
    if kind == "string":  # numbers and booleans are not text
        return F.when(kind_of(raw, path) == "STRING", F.try_variant_get(raw, path, "string"))
    if kind in ("double", "bigint"):
        return F.when(is_number(raw, path), F.try_variant_get(raw, path, kind))
    if kind == "boolean":
        return F.when(kind_of(raw, path) == "BOOLEAN", F.try_variant_get(raw, path, kind))
    return F.try_variant_get(raw, path, kind)


def text(raw: Column, *paths: str) -> Column:
    """The first of several members that is text and not blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(get(raw, p)), F.lit("")) for p in paths))


def word(raw: Column, *paths: str) -> Column:
    """As :func:`text`, in small letters, an empty string where there is none."""
    return F.coalesce(F.lower(text(raw, *paths)), F.lit(""))


def number(raw: Column, path: str) -> Column:
    """A number, or text that is one."""
    return F.coalesce(get(raw, path, "double"), get(raw, path).try_cast("double"))


def count(raw: Column, path: str) -> Column:
    """A number without its fraction, or text that is a whole number; else 0."""
    return F.coalesce(get(raw, path, "double").cast("bigint"), get(raw, path).try_cast("bigint"), F.lit(0).cast("bigint"))


def items(raw: Column, path: str) -> Column:
    """The entries of a list, none where it is no list."""
    return F.coalesce(F.try_variant_get(raw, path, "array<variant>"), F.array().cast("array<variant>"))


def objects(raw: Column, path: str) -> Column:
    return F.filter(items(raw, path), lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))


def truthy(raw: Column, path: str) -> Column:
    """Whether a member counts as true: true, a number but 0, text or a list that is not empty."""
    return F.coalesce(get(raw, path, "boolean"), get(raw, path, "double") != 0, get(raw, path) != "", F.size(F.try_variant_get(raw, path, "array<variant>")) > 0, F.lit(False))


def shown(raw: Column, path: str) -> Column:
    """A member as displayed: Yes or No, a list with commas, else its text."""
    return (
        F.when(kind_of(raw, path) == "BOOLEAN", F.when(get(raw, path, "boolean"), "Yes").otherwise("No"))
        .when(F.startswith(kind_of(raw, path), F.lit("ARRAY")), F.array_join(F.transform(items(raw, path), lambda x: F.try_variant_get(x, "$", "string")), ", "))
        .otherwise(F.try_variant_get(raw, path, "string"))
    )


def share(value: Column) -> Column:
    """A share as a whole percentage."""
    return F.concat(F.bround(value * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def pages_of(entries: Column) -> Column:
    """The pages that entries name, ascending, each once."""
    each = F.transform(entries, lambda x: count(x, "$.page"))
    return F.array_sort(F.array_distinct(F.filter(each, lambda p: p != 0)))


def listed(numbers: Column, separator: str = ", ") -> Column:
    return F.array_join(numbers.cast("array<string>"), separator)


def facts(*pairs: tuple[str, Column]) -> Column:
    """Labelled facts as displayed, blank ones left out, each of at most 400 characters."""
    if not pairs:
        return F.array().cast("array<struct<label:string,value:string>>")
    held = [F.struct(F.lit(label).alias("label"), F.left(F.nullif(F.trim(value.cast("string")), F.lit("")), F.lit(FACT_CHARS)).alias("value")) for label, value in pairs]
    return F.filter(F.array(*held), lambda f: f["value"].isNotNull())


@dataclass
class Verdict:
    """A rule's Columns; ``reason`` is never null."""

    status: Column
    criterion: Column
    reason: Column
    facts: Column

    def struct(self) -> Column:
        return F.struct(self.status.alias("status"), self.criterion.alias("criterion"), self.reason.alias("reason"), self.facts.alias("facts"))


def _said(*parts: Column | str) -> Column:
    """Parts of a sentence one after the other, null ones left out."""
    return F.concat_ws("", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _cases(*rungs: tuple[Column, Column | str], otherwise: Column | str) -> Column:
    out = F.lit(otherwise) if isinstance(otherwise, str) else otherwise
    for condition, value in reversed(rungs):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(value) if isinstance(value, str) else value).otherwise(out)
    return out


# --- The rules ----------------------------------------------------------------------------------------------------------


def metadata(raw: Column) -> Verdict:
    kind = _mapped(F.coalesce(get(raw, "$.generation.kind"), F.lit("unknown")), ORIGINS, ORIGINS["unknown"])
    producer, creator = (F.coalesce(text(raw, f"$.generation.{k}"), text(raw, f"$.document_metadata.{k}")) for k in ("producer", "creator"))
    created, modified = text(raw, "$.document_metadata.created_at"), text(raw, "$.document_metadata.modified_at")
    some = F.size(F.map_keys(F.coalesce(F.try_variant_get(raw, "$.generation", "map<string,variant>"), F.try_variant_get(raw, "$.document_metadata", "map<string,variant>")))) > 0
    changed = modified.isNotNull() & ~modified.eqNullSafe(created)
    signals = F.array_sort(F.array_distinct(F.filter(F.transform(objects(raw, "$.issues"), lambda x: F.coalesce(F.create_map(*(F.lit(v) for kv in SIGNALS.items() for v in kv))[get(x, "$.signal")], get(x, "$.signal"))), lambda s: s.isNotNull())))
    named = F.coalesce(producer, creator)
    reason = _said(
        kind, F.when(named.isNotNull(), _said(" by ", named, ".")).otherwise("; no producer or creator is named."), F.when(truthy(raw, "$.generation.resaved_after_creation"), " Saved again after it was first written.").otherwise(" Written in one pass."),
        F.when(changed, _said(" Created ", F.coalesce(created, F.lit("unknown")), ", modified ", modified, ".")).when(created.isNotNull(), _said(" Created ", created, ".")),
    )
    g = lambda k: shown(raw, f"$.generation.{k}")
    held = facts(
        ("Generated by", kind), ("Producer", producer), ("Creator", creator), ("PDF version", F.coalesce(g("pdf_version"), shown(raw, "$.document_metadata.format"))), ("Created", created), ("Modified", modified),
        ("Title", shown(raw, "$.document_metadata.title")), ("Author", shown(raw, "$.document_metadata.author")), ("Pages", g("pages")), ("Pages with a text layer", g("pages_with_text_layer")), ("Embedded images", g("embedded_images")),
        ("Annotations", g("annotations")), ("Re-saved after creation", g("resaved_after_creation")), ("Embedded JavaScript", g("has_javascript")), ("Interactive form", g("has_acroform")), ("Editing signals found", F.when(F.size(signals) > 0, F.array_join(signals, ", ")).otherwise("None")),
    )
    none = F.coalesce(text(raw, "$.note"), F.lit("No metadata was recorded in this run."))
    some = F.coalesce(some, F.lit(False))
    return Verdict(F.lit("info"), F.lit("States how the file was made; neither passes nor fails."), F.when(some, reason).otherwise(none), F.when(some, held).otherwise(facts()))


def font_names(entries: Column) -> Column:
    """The names of font records, sorted, each once; a record is an object with a typeface or a font name, or a name."""
    name = lambda x: F.coalesce(F.nullif(get(x, "$.typeface"), F.lit("")), F.nullif(get(x, "$.font_name"), F.lit("")), get(x, "$"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(entries, name), lambda s: s.isNotNull())))


def embedded_fonts(raw: Column) -> tuple[Column, Column]:
    """The font objects stored in the file, and those that it only names.

    Flags say so; older payloads without any have a number above 0 and a file extension for a stored one.
    """
    held = objects(raw, "$.unique_fonts")
    flags = F.exists(held, lambda x: member(x, "$.embedded").isNotNull())
    stored = lambda x: F.when(flags, F.coalesce(get(x, "$.embedded", "boolean"), F.lit(False))).otherwise((count(x, "$.xref") > 0) & ~word(x, "$.extension").isin("", "n/a", "none"))
    return F.filter(held, stored), F.filter(held, lambda x: ~stored(x))


def font_inventory(raw: Column) -> tuple[Column, Column, Column]:
    """Names of embedded fonts, of referenced ones, and the number of embedded objects: from objects, else from typefaces, else from an old list."""
    own, other = embedded_fonts(raw)
    some, explicit = F.size(items(raw, "$.unique_fonts")) > 0, F.try_variant_get(raw, "$.embedded_typefaces", "array<variant>").isNotNull()
    names = F.when(some, font_names(own)).when(explicit, font_names(items(raw, "$.embedded_typefaces"))).otherwise(font_names(items(raw, "$.typefaces")))
    referenced = F.when(some, font_names(other)).when(explicit, font_names(items(raw, "$.referenced_typefaces"))).otherwise(F.array().cast("array<string>"))
    number_ = F.when(some, F.size(own).cast("bigint")).when(explicit, count(raw, "$.embedded_font_objects_count")).otherwise(count(raw, "$.font_objects_count"))
    return names, referenced, number_


def font_analysis(raw: Column) -> Verdict:
    names, referenced, stored = font_inventory(raw)
    n, joined, others = F.size(names), F.array_join(names, ", "), F.nullif(F.array_join(referenced, ", "), F.lit(""))
    reason = F.when(n > 0, _said("Embedded fonts: ", joined, ".")).otherwise(_said("No font is embedded.", F.when(others.isNotNull(), _said(" Only referenced: ", others, "."))))
    return Verdict(
        F.when(n > 0, "pass").otherwise("fail"), F.lit("Passes with at least one embedded font; references to fonts do not count."), reason,
        facts(("Embedded fonts", n), ("Font names", joined), ("Embedded font objects", stored), ("Referenced fonts", others)),
    )


def _least(raw: Column, path: str) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), count(raw, path))


def signature(raw: Column) -> Verdict:
    least, regions = _least(raw, "$.expected_min_signatures"), items(raw, "$.regions")
    n = F.when(count(raw, "$.count") != 0, count(raw, "$.count")).otherwise(F.size(regions).cast("bigint"))
    held = objects(raw, "$.regions")
    pages = F.nullif(listed(pages_of(held)), F.lit(""))
    sure = F.when(F.size(held) > 0, F.array_max(F.transform(held, lambda x: F.coalesce(number(x, "$.confidence"), F.lit(0.0))))).otherwise(F.coalesce(number(raw, "$.score"), F.lit(0.0)))
    reason = _cases((n >= least, _said(n, " signatures found", F.when(pages.isNotNull(), _said(" on pages ", pages)), ".")), (n > 0, _said(n, " signatures found, ", least, " required.")), otherwise="No signature was found.")
    found = facts(("Signatures found", n), ("Pages", pages), ("Highest confidence", F.when(sure > 0, share(sure))))
    short = facts(("Signatures found", n), ("Required", least), ("Pages", pages))
    return Verdict(F.when(n >= least, "pass").otherwise("fail"), _said("Passes with ", least, " or more signatures."), reason, F.when(n >= least, found).otherwise(short))


def photo_detection(raw: Column) -> Verdict:
    n, page, effort = count(raw, "$.photo_count"), shown(raw, "$.page"), word(raw, "$.search_effort")
    unknown = (member(raw, "$.photo_found").isNull() | F.coalesce(F.is_variant_null(member(raw, "$.photo_found")), F.lit(False))) & (n == 0)
    found = truthy(raw, "$.photo_found")
    note = F.when(~F.coalesce(get(raw, "$.passed", "boolean"), F.lit(True)), F.translate(text(raw, "$.reason"), "_", " "))
    effort_fact = ("Search effort", F.initcap(F.nullif(effort, F.lit(""))))
    n_found = F.when(n == 0, F.lit(1).cast("bigint")).otherwise(n)
    absent = _said("No photo was found; searched: ", _cases((effort == "low", "embedded images only, no page was rendered"), (effort == "medium", "embedded images and rendered pages"), (effort == "high", "pages at high resolution and low confidence"), otherwise="all pages"), ".")
    face = number(raw, "$.face_confidence")
    present = facts(("Photos found", n_found), ("Page", page), ("Quality note", note), ("Face confidence", F.when(face != 0, share(face))), ("Blur score", shown(raw, "$.blur")), ("Brightness", shown(raw, "$.brightness")), effort_fact)
    return Verdict(
        _cases((unknown, "inconclusive"), (found, "pass"), (effort == "low", "inconclusive"), otherwise="fail"), F.lit("Passes with a photo of a person."),
        _cases((unknown, "The detector did not say whether there is a photo."), (found, _said(n_found, " photos found", F.when(page.isNotNull(), _said(" on page ", page)), ".", F.when(note.isNotNull(), _said(" Quality: ", note, ".")))), otherwise=absent),
        F.when(unknown, facts()).when(found, present).otherwise(facts(("Photos found", F.lit(0)), effort_fact)),
    )


def qr_presence(raw: Column) -> Verdict:
    least, n, hits = _least(raw, "$.expected_min_codes"), count(raw, "$.qr_count"), objects(raw, "$.hits")
    payload = F.filter(F.transform(hits, lambda x: F.left(F.coalesce(F.nullif(F.try_variant_get(x, "$.payload", "string"), F.lit("")), F.nullif(F.try_variant_get(x, "$.data", "string"), F.lit(""))), F.lit(PAYLOAD_CHARS))), lambda p: p.isNotNull())
    pages, effort, cut = F.nullif(listed(pages_of(hits)), F.lit("")), word(raw, "$.search_effort"), word(raw, "$.deep_rescan_incomplete")
    late = F.when(cut == "timeout", "ran out of time").otherwise("could not be completed")
    effort_fact = ("Search effort", F.initcap(F.nullif(effort, F.lit(""))))
    missed = (("QR codes found", n), ("Required", least), effort_fact)
    absent = _said("No code was decoded; searched: ", _cases((effort == "low", "one resolution"), (effort == "medium", "a ladder of resolutions, four rotations"), (effort == "high", "a wide ladder of resolutions, four rotations"), otherwise="the configured resolution and rotations"), ".", F.when(least > 1, _said(" Found ", n, " of ", least, ".")))
    return Verdict(
        _cases((n >= least, "pass"), (cut != "", "inconclusive"), otherwise="fail"), _said("Passes with ", least, " or more decoded codes."),
        _cases((n >= least, _said(n, " codes decoded", F.when(pages.isNotNull(), _said(" on pages ", pages)), ".")), (cut != "", _said("No code was decoded, but the wider search ", late, ".")), otherwise=absent),
        F.when(n >= least, facts(("QR codes found", n), ("Pages", pages), ("Decoded payloads", F.array_join(F.slice(payload, 1, 5), ", ")))).when(cut != "", facts(*missed, ("Wider search", F.concat(F.upper(F.left(late, F.lit(1))), F.substring(late, 2, 99))))).otherwise(facts(*missed)),
    )


def tamper_scan(raw: Column) -> Verdict:
    p, at = get(raw, "$.document_probability", "double"), F.coalesce(number(raw, "$.review_threshold"), F.lit(TAMPER_THRESHOLD))
    pages, blind, regions = F.size(items(raw, "$.pages")).cast("bigint"), count(raw, "$.indeterminate_pages"), count(raw, "$.suspicious_regions_count")
    weak = (F.coalesce(text(raw, "$.verdict"), F.lit("")) == "insufficient_signal") | ((pages > 0) & (blind == pages))
    held = facts(("Whitener probability", share(p)), ("Review threshold", share(at)), ("Pages analysed", F.when(pages > 0, pages.cast("string")).otherwise(shown(raw, "$.pages_analyzed"))), ("Suspicious regions", regions))
    return Verdict(
        _cases((weak, "inconclusive"), (p.isNull(), "inconclusive"), (p >= at, "fail"), otherwise="pass"), _said("Passes with a probability of correction fluid below ", share(at), "."),
        _cases((weak, _said("None of ", F.when(blind > 0, blind).otherwise(pages), " pages could be read.")), (p.isNull(), "The detector gave no probability."), (p >= at, _said("Probability ", share(p), ", at or above ", share(at), ", in ", regions, " regions.")), otherwise=_said("Probability ", share(p), ", below ", share(at), ".")),
        F.when(weak, facts(("Pages analysed", pages), ("Indeterminate pages", blind))).when(p.isNull(), facts()).otherwise(held),
    )


def moire(raw: Column) -> Verdict:
    v, images = F.upper(text(raw, "$.file_verdict", "$.verdict")), items(raw, "$.images")
    reasons = F.filter(F.transform(objects(raw, "$.images"), lambda x: F.nullif(F.try_variant_get(x, "$.reason", "string"), F.lit(""))), lambda r: r.isNotNull())
    first = F.get(reasons, F.lit(0))
    return Verdict(
        _cases((v == "RECAPTURE", "fail"), (v == "CLEAN", "pass"), otherwise="inconclusive"), F.lit("Passes without a screen or reprint pattern."),
        _cases((v == "RECAPTURE", _said("A periodic pattern of a screen or a reprint was found", F.when(first.isNotNull(), _said(": ", first)), ".")), (v == "CLEAN", "No periodic pattern was found."), (F.size(images) == 0, "There was no raster image to analyse."), otherwise=_said("Undecided: ", F.coalesce(first, F.lit("the analysis settled neither way")), ".")),
        facts(("Images analysed", F.size(images)), ("File verdict", F.initcap(F.lower(v))), ("Per-image findings", F.array_join(F.slice(reasons, 1, 4), ", "))),
    )


def same_phone(raw: Column) -> Verdict:
    v = F.lower(F.coalesce(F.nullif(F.try_variant_get(raw, "$.summary.overall_verdict", "string"), F.lit("")), F.try_variant_get(raw, "$.verdict", "string"), F.lit("")))
    score, pages = get(raw, "$.summary.same_phone_score", "double"), F.size(items(raw, "$.pages"))
    scored = F.when(score.isNotNull(), _said(" Score ", F.bround(score, 0).cast("bigint"), "/100."))
    few = (v == "insufficient_pages") | ((pages > 0) & (pages < 2))
    same, other, unsure = v.isin("likely_same_phone_or_workflow", "compatible_with_same_phone"), v == "possibly_different_phone_or_workflow", v == "uncertain_same_phone"
    reasons = F.array_join(F.slice(F.transform(items(raw, "$.summary.reasons"), lambda x: F.try_variant_get(x, "$", "string")), 1, 4), ", ")
    return Verdict(
        _cases((few, "inconclusive"), (same, "pass"), (other, "fail"), otherwise="inconclusive"), F.lit("Passes if all pages fit one capture device; needs two pages."),
        _cases((few, "One page has no other to be compared with."), (same, _said("All pages fit one device.", scored)), (other, _said("A page seems to come from another device.", scored)), (unsure, _said("The pages are neither alike nor different enough.", scored)), otherwise="The comparison gave no verdict."),
        facts(("Pages analysed", F.when(pages > 0, pages)), ("Same-phone score", F.when(score.isNotNull(), _said(F.bround(score, 0).cast("bigint"), "/100"))), ("Lowest pair score", shown(raw, "$.summary.lowest_pair_score")), ("Findings", reasons)),
    )


def readability(raw: Column) -> Verdict:
    v, passed, total = word(raw, "$.verdict"), count(raw, "$.tests_passed"), count(raw, "$.tests_total")
    score = F.when(F.rlike(kind_of(raw, "$.score"), F.lit("^(BIGINT|INT|SMALLINT|TINYINT)")), F.try_variant_get(raw, "$.score", "bigint"))
    failed = F.filter(F.transform(F.filter(objects(raw, "$.tests"), lambda t: ~F.coalesce(get(t, "$.passed", "boolean"), F.lit(True))), lambda t: F.nullif(F.try_variant_get(t, "$.name", "string"), F.lit(""))), lambda n: n.isNotNull())
    missed = F.filter(F.transform(items(raw, "$.tests_not_run"), lambda x: F.nullif(F.try_variant_get(x, "$", "string"), F.lit(""))), lambda n: n.isNotNull())
    declared = F.when(count(raw, "$.tests_declared") != 0, count(raw, "$.tests_declared")).otherwise(total)
    open_, bad = (v == "incomplete") | (F.size(missed) > 0), v.isin("poor_readability", "unreadable")
    tail = lambda names: F.nullif(F.array_join(F.slice(names, 1, 3), ", "), F.lit(""))
    return Verdict(
        _cases((open_, "inconclusive"), (v == "readable", "pass"), (bad, "fail"), otherwise="inconclusive"), F.lit("Passes if the document can be read by machine."),
        _cases(
            (open_, _said(F.size(missed), " of ", declared, " sub-tests could not run", F.when(F.size(missed) > 0, _said(": ", tail(missed))), ".")), (v == "readable", _said("Readable, ", score, "/100, ", passed, " of ", total, " sub-tests passed.")),
            (bad, _said(F.when(v == "unreadable", "Unreadable, ").otherwise("Poor, "), score, "/100, ", total - passed, " of ", total, " sub-tests failed", F.when(F.size(failed) > 0, _said(": ", tail(failed))), ".")), otherwise="The checker gave no verdict.",
        ),
        facts(("Readability score", F.when(score.isNotNull(), _said(score, "/100"))), ("Sub-tests passed", F.when(total != 0, _said(passed, "/", total))), ("Failed sub-tests", F.coalesce(F.nullif(F.array_join(F.slice(failed, 1, 6), ", "), F.lit("")), F.lit("None"))), ("Checks that could not run", F.array_join(F.slice(missed, 1, 6), ", "))),
    )


#: The rule of each analyzer: the registry that a new analyzer's rule is added to.
RULES: dict[str, Callable[[Column], Verdict]] = {f.__name__: f for f in (metadata, font_analysis, signature, photo_detection, qr_presence, tamper_scan, moire, same_phone, readability)}


def generic(raw: Column) -> Verdict:
    """The rule for analyzers without one of their own."""
    bad = ~F.coalesce(get(raw, "$.passed", "boolean"), F.lit(True)) | F.lower(F.coalesce(F.try_variant_get(raw, "$.risk", "string"), F.lit(""))).isin("medium", "high")
    open_, note = word(raw, "$.status").isin("insufficient_data", "inconclusive"), text(raw, "$.note", "$.reason")
    return Verdict(
        _cases((bad, "fail"), (open_, "inconclusive"), otherwise="pass"), F.lit("Passes without a signal."),
        F.coalesce(note, _cases((bad, "A signal was reported."), (open_, "No conclusion was reached."), otherwise="No signal was reported.")), facts(),
    )


def evaluate(analyzer: Column, raw: Column) -> Column:
    """The verdict on a payload under its analyzer's rule; a crashed detector's is error."""
    out = generic(raw).struct()
    criterion = F.lit("Passes without a signal.")
    for name, rule in RULES.items():
        verdict = rule(raw)
        out = F.when(analyzer == name, verdict.struct()).otherwise(out)
        criterion = F.when(analyzer == name, verdict.criterion).otherwise(criterion)
    broken = Verdict(F.lit("error"), criterion, _said("The check could not run: ", F.coalesce(text(raw, "$.detail"), F.lit("the detector stopped with an error."))), facts())
    return F.when(raw.isNull() | (word(raw, "$.status") == "error"), broken.struct()).otherwise(out)


def status(analyzer: Column, raw: Column) -> Column:
    return evaluate(analyzer, raw)["status"]


# --- The envelope -------------------------------------------------------------------------------------------------------


def _mapped(key: Column, values: dict[str, str], other: str) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key], F.lit(other))


def risk_word(word_: Column) -> Column:
    """low, medium, high or unknown for a detector's word."""
    clean = F.lower(F.trim(word_))
    return _cases(*((clean.isin(words), level) for level, words in RISKS.items()), otherwise="unknown")


def risk(raw: Column) -> Column:
    said = lambda path: F.when(~F.startswith(kind_of(raw, path), F.lit("OBJECT")), F.nullif(F.try_variant_get(raw, path, "string"), F.lit("")))
    return risk_word(F.coalesce(said("$.risk"), said("$.summary.overall_risk"), F.lit("")))


def findings(raw: Column) -> Column:
    """How many findings a payload has: its own count of regions, else its summary's counts together, else the length of its first list, else 0."""
    whole = lambda p: F.when(F.rlike(kind_of(raw, p), F.lit("^(BIGINT|INT|SMALLINT|TINYINT)")) & (F.try_variant_get(raw, p, "bigint") >= 0), F.try_variant_get(raw, p, "bigint"))
    a, b = whole("$.summary.suspicious_pages"), whole("$.summary.suspicious_regions")
    summed = F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    lists = [F.size(F.try_variant_get(raw, f"$.{k}", "array<variant>")) for k in ("issues", "findings", "suspicious_pages", "suspicious_regions", "regions")]
    return F.coalesce(whole("$.suspicious_regions_count"), summed, *(F.when(n >= 0, n) for n in lists), F.lit(0)).cast("bigint")


def said_verdict(raw: Column) -> Column:
    """The verdict that a detector itself gives, in small letters."""
    return F.coalesce(*(F.nullif(F.lower(F.trim(F.try_variant_get(raw, p, "string"))), F.lit("")) for p in ("$.file_verdict", "$.verdict", "$.summary.overall_verdict")), F.lit(""))


def legacy_outcome(analyzer: Column, raw: Column, risk_: Column) -> Column:
    """The outcome of analyzers without a rule: by status, risk and the words of their verdict."""
    state, verdict = word(raw, "$.status"), said_verdict(raw)
    holds = lambda *words: F.rlike(verdict, F.lit("|".join(words)))
    return _cases(
        (state == "error", "error"), (state.isin("insufficient_data", "inconclusive"), "inconclusive"), (~F.coalesce(get(raw, "$.passed", "boolean"), F.lit(True)) | risk_.isin("medium", "high"), "review"),
        (holds("recapture", "suspicion", "different_phone", "tamper"), "review"), (holds("inconclusive", "insufficient", "uncertain"), "inconclusive"),
        (verdict.isin("clean", "passed", "clear", "readable", "likely_same_phone_or_workflow", "compatible_with_same_phone"), "clear"),
        ((analyzer == "qr_presence") & ~get(raw, "$.qr_found", "boolean"), "inconclusive"), ((analyzer == "readability") & (get(raw, "$.exit_code", "bigint") == 1), "review"),
        ((state == "completed") & (risk_ == "unknown"), "inconclusive"), otherwise="clear",
    )


def outcome(status: Column) -> Column:
    return _mapped(status, OUTCOMES, "error")


def summary(analyzer: Column, raw: Column, outcome_: Column, risk_: Column) -> Column:
    """A result in one line."""
    verdict, p = said_verdict(raw), get(raw, "$.document_probability", "double")
    readable = F.concat(F.upper(F.left(F.translate(verdict, "_", " "), F.lit(1))), F.substring(F.translate(verdict, "_", " "), 2, 999))
    names, referenced, _ = font_inventory(raw)
    count_of = lambda path: F.greatest(count(raw, path), F.lit(1).cast("bigint"))
    least, signed = get(raw, "$.expected_min_codes", "bigint"), get(raw, "$.expected_min_signatures", "bigint")
    present = get(raw, "$.present", "boolean")
    is_ = lambda name: analyzer == name
    source = F.coalesce(text(raw, "$.generation.producer"), text(raw, "$.generation.creator"))
    origin = _mapped(F.coalesce(get(raw, "$.generation.kind"), F.lit("unknown")), ORIGINS, ORIGINS["unknown"])
    return _cases(
        (outcome_ == "error", F.coalesce(text(raw, "$.detail"), F.lit("Analyzer failed"))), ((outcome_ == "inconclusive") & text(raw, "$.note").isNotNull(), text(raw, "$.note")),
        (is_("metadata") & F.startswith(kind_of(raw, "$.generation"), F.lit("OBJECT")), F.concat_ws(" · ", origin, source)),
        (is_("font_analysis"), _cases((F.size(names) > 0, _said(F.size(names), " embedded fonts: ", F.array_join(names, ", "))), (F.size(referenced) > 0, _said("No embedded fonts · references ", F.array_join(referenced, ", "))), otherwise="No embedded fonts")),
        (is_("photo_detection"), _cases((get(raw, "$.photo_found", "boolean"), _said(count_of("$.photo_count"), " document photos", F.when(F.coalesce(get(raw, "$.passed", "boolean"), F.lit(False)), " detected").otherwise(" detected - quality needs review"))), otherwise="No document photo detected")),
        (is_("tamper_scan") & p.isNotNull(), _said(_cases((verdict == "likely_whitener", "Likely whitener"), (verdict == "possible_whitener", "Possible whitener"), (verdict == "no_whitener_evidence", "No whitener evidence"), otherwise="Analysed"), " · ", share(p))),
        (is_("readability") & (verdict != "") & is_number(raw, "$.score"), _said(readable, " · ", shown(raw, "$.score"), "/100 (", count(raw, "$.tests_passed"), "/", count(raw, "$.tests_total"), ")")),
        (is_("qr_presence") & (count(raw, "$.qr_count") < least), _said("Expected ", least, " codes, found ", count(raw, "$.qr_count"))),
        (is_("signature") & present.isNotNull(), _cases(((signed > 0) & (count(raw, "$.count") < signed), _said("Expected ", signed, " signatures, found ", count(raw, "$.count"))), (present, _said(count(raw, "$.count"), " signatures detected")), otherwise="No signature detected")),
        (verdict != "", readable),
        (is_("qr_presence") & get(raw, "$.qr_found", "boolean").isNotNull(), F.when(get(raw, "$.qr_found", "boolean"), _said("QR found (", count(raw, "$.qr_count"), ")")).otherwise("No QR code found")),
        (risk_ != "unknown", F.concat(F.initcap(risk_), F.lit(" risk"))), (outcome_ == "inconclusive", "Analysis inconclusive"), otherwise="Analysis completed",
    )


_REGION = "array<struct<page:bigint,kind:string,label:string,severity:string,x:double,y:double,width:double,height:double>>"


def clipped(page: Column, kind: Column, label: Column, severity: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A region in shares of its page, clipped to it."""
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    left, right, top, bottom = clip(F.least(x0, x1)), clip(F.greatest(x0, x1)), clip(F.least(y0, y1)), clip(F.greatest(y0, y1))
    return F.struct(page.alias("page"), kind.alias("kind"), label.alias("label"), severity.alias("severity"), F.round(left, 6).alias("x"), F.round(top, 6).alias("y"), F.round(right - left, 6).alias("width"), F.round(bottom - top, 6).alias("height"))


def unrotated(x: Column, y: Column, rotation: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """A point of a page that was turned by ``rotation`` degrees, on the page as it was (``width`` by ``height``)."""
    return (
        F.when(rotation == 90, y).when(rotation == 180, width - x).when(rotation == 270, width - y).otherwise(x),
        F.when(rotation == 90, height - x).when(rotation == 180, height - y).when(rotation == 270, x).otherwise(y),
    )


def regions(analyzer: Column, raw: Column, sizes: Column | None = None) -> Column:
    """Evidence regions of a payload: codes, photos, tampering and signatures, boxes thinner than a thousandth left out, 100 at most.

    ``sizes`` maps pages to structs (width, height) in points; where it lacks a page, regions in pixels have no place on it.
    """
    sizes = F.create_map().cast("map<bigint,struct<width:double,height:double>>") if sizes is None else sizes
    pixels = lambda page, dpi: (sizes[page]["width"] * dpi / 72.0, sizes[page]["height"] * dpi / 72.0)

    def code(hit: Column) -> Column:
        page, dpi = get(hit, "$.page", "bigint"), get(hit, "$.dpi", "double")
        w, h = pixels(page, dpi)
        turn = F.coalesce(F.regexp_extract(F.try_variant_get(hit, "$.variant", "string"), r"rot(0|90|180|270)", 1).try_cast("int"), F.lit(0))
        points = F.transform(F.filter(items(hit, "$.points"), lambda q: F.size(items(q, "$")) >= 2), lambda q: F.struct(*(c.alias(n) for n, c in zip("xy", unrotated(F.try_variant_get(q, "$[0]", "double"), F.try_variant_get(q, "$[1]", "double"), turn, w, h)))))
        xs, ys = F.transform(points, lambda q: q["x"]), F.transform(points, lambda q: q["y"])
        return F.when((dpi > 0) & (F.size(points) > 0), clipped(page, F.lit("qr_code"), F.lit("QR code"), F.lit("low"), (F.array_min(xs) - 5) / w, (F.array_min(ys) - 5) / h, (F.array_max(xs) + 5) / w, (F.array_max(ys) + 5) / h))

    def photo(x: Column, i: Column) -> Column:
        page = F.coalesce(F.nullif(count(x, "$.page"), F.lit(0)), F.nullif(count(raw, "$.page"), F.lit(0)), F.lit(1).cast("bigint"))
        drawn = pixels(page, F.coalesce(F.nullif(number(raw, "$.render_dpi"), F.lit(0.0)), F.lit(300.0)))
        w, h = (F.coalesce(F.try_variant_get(x, f"$.source_size_px[{k}]", "double"), drawn[k]) for k in (0, 1))
        box = [F.try_variant_get(x, f"$.bbox_px[{k}]", "double") for k in range(4)]
        return F.when((w > 0) & (h > 0), clipped(page, F.lit("document_photo"), _said("Document photo ", i + 1), F.when(F.coalesce(get(x, "$.passed", "boolean"), F.lit(False)), "low").otherwise("medium"), box[0] / w, box[1] / h, box[2] / w, box[3] / h))

    def marked(kind: str, label: str):
        def one(x: Column) -> Column:
            box = [F.coalesce(number(x, f"$.bbox_normalized.{k}"), F.lit(0.0)) for k in ("x0", "y0", "x1", "y1")]
            page = F.when(member(x, "$.page").isNull(), F.lit(1).cast("bigint")).otherwise(count(x, "$.page"))
            return F.when(F.startswith(kind_of(x, "$.bbox_normalized"), F.lit("OBJECT")), clipped(page, F.coalesce(text(x, "$.kind"), F.lit(kind)), F.coalesce(text(x, "$.label"), F.lit(label)), risk_word(F.coalesce(F.try_variant_get(x, "$.severity", "string"), F.lit(""))), *box))

        return one

    each = (
        F.when(analyzer == "qr_presence", F.transform(objects(raw, "$.hits"), code).cast(_REGION))
        .when(analyzer == "photo_detection", F.transform(objects(raw, "$.photos"), photo).cast(_REGION))
        .when(analyzer == "tamper_scan", F.transform(objects(raw, "$.regions"), marked("tamper_signal", "Tamper signal")).cast(_REGION))
        .when(analyzer == "signature", F.transform(objects(raw, "$.regions"), marked("signature", "Signature")).cast(_REGION))
        .otherwise(F.array().cast(_REGION))
    )
    return F.slice(F.filter(each, lambda r: (r["width"] >= 0.001) & (r["height"] >= 0.001)), 1, MOST_REGIONS)


def confidence_percent(raw: Column) -> Column:
    """A result's confidence as a whole percentage: the first number among four members; shares count as such."""
    first = F.coalesce(*(get(raw, f"$.{k}", "double") for k in ("confidence", "score", "probability", "similarity")))
    return F.floor(F.when(first <= 1, first * 100).otherwise(first) + 0.5).cast("int")


def envelope(raw: Column) -> Column:
    """The payload of one result: an object, or a list of one object; anything else is an error."""
    is_object = lambda path: F.startswith(kind_of(raw, path), F.lit("OBJECT"))
    broken = F.parse_json(F.lit('{"status": "error", "detail": "The analyzer returned a result of another shape."}'))
    one = (F.size(F.try_variant_get(raw, "$", "array<variant>")) == 1) & is_object("$[0]")
    return F.when(raw.isNull(), raw).when(is_object("$"), raw).when(F.coalesce(one, F.lit(False)), member(raw, "$[0]")).otherwise(broken)


def normalized(raw_results: DataFrame) -> DataFrame:
    """The result contract from (job_id, analyzer_id, raw, and any others, which stay): check (status, criterion, reason, facts), status, outcome, risk, summary, findings_count, raw.

    A list of one object counts as the object; a null or another shape is an
    error. Analyzers without a rule are graded by status, risk and verdict.
    """
    rows = raw_results.withColumn("raw", envelope(F.col("raw")))
    graded = rows.withColumn("check", evaluate(F.col("analyzer_id"), F.col("raw"))).withColumn("status", F.col("check.status")).withColumn("risk", risk(F.col("raw")))
    own = F.col("analyzer_id").isin(ANALYZERS) | F.col("raw").isNull()
    found = graded.withColumn("outcome", F.when(own, outcome(F.col("status"))).otherwise(legacy_outcome(F.col("analyzer_id"), F.col("raw"), F.col("risk"))))
    return found.select(*(c for c in raw_results.columns if c != "raw"), "status", "outcome", "risk", summary(F.col("analyzer_id"), F.col("raw"), F.col("outcome"), F.col("risk")).alias("summary"), findings(F.col("raw")).alias("findings_count"), "check", "raw")


def evidence(raw_results: DataFrame) -> DataFrame:
    """``(job_id, analyzer_id, key, value, position)``: what else a payload states: short texts, numbers and booleans, ten at most; a summary's members count as its own."""
    spark = raw_results.sparkSession
    exploded = lambda rows, column: rows.lateralJoin(spark.tvf.variant_explode(F.col(column).outer()))
    first = exploded(raw_results.select("job_id", "analyzer_id", "raw"), "raw").select("job_id", "analyzer_id", F.col("key").alias("outer"), F.col("value").alias("held")).where(F.col("outer").isNotNull() & ~F.col("outer").isin(HIDDEN_KEYS))
    nested = (F.col("outer") == "summary") & F.startswith(F.schema_of_variant("held"), F.lit("OBJECT"))
    inner = exploded(first.where(nested), "held").select("job_id", "analyzer_id", "outer", "key", "value").where("key is not null")
    rows = first.where(~nested).select("job_id", "analyzer_id", "outer", F.col("outer").alias("key"), F.col("held").alias("value")).unionByName(inner)
    kind, said = F.schema_of_variant("value"), F.try_variant_get("value", "$", "string")
    shown_ = _cases((kind == "BOOLEAN", said), (F.rlike(kind, F.lit(_NUMERIC)) & F.contains("key", F.lit("probability")), F.concat(F.floor(F.try_variant_get("value", "$", "double") * 100 + 0.5).cast("string"), F.lit("%"))), (F.rlike(kind, F.lit(_NUMERIC)), said), ((kind == "STRING") & (F.trim(said) != "") & (F.length(said) <= 120), said), otherwise=F.lit(None).cast("string"))
    w = Window.partitionBy("job_id", "analyzer_id").orderBy("outer", "key")
    return rows.select("job_id", "analyzer_id", "outer", "key", shown_.alias("value")).where("value is not null").withColumn("position", F.row_number().over(w)).where("position <= 10").drop("outer")
