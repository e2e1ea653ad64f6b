"""Sources: uploaded files, label tables, legacy records, name stores, settings and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.functions import text as T

#: Intake limits, and the words for true in label tables.
MOST_BYTES, MOST_FILES = 25 * 1024 * 1024, 50
TRUE_WORDS = ["1", "true", "yes", "y", "present"]
TYPES = ["pdf", "png", "jpg", "jpeg", "webp", "tif", "tiff"]


def blocker(kind: Column, length: Column, starts: Column, pages: Column | None = None) -> Column:
    """Why a file cannot be screened, the first reason that holds; null if it can. ``starts`` are its first five bytes as text."""
    out = F.when(length > MOST_BYTES, "size").when(~F.coalesce(kind, F.lit("")).isin(TYPES), "type").when((kind == "pdf") & (starts != "%PDF-"), "content")
    return out.when(pages == 0, "no pages") if pages is not None else out


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path``, all levels: name, length, digest of the bytes as they came, blocker (null if the file may pass).

    Only names and lengths are read for files that are blocked by them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    why = F.when(F.col("length") == 0, "content").otherwise(blocker(kind, F.col("length"), F.substring("content", 1, 5).cast("string")))
    return files.select(name.alias("filename"), "length", F.sha2("content", 256).alias("sha256"), why.alias("blocker"))


def known_uploads(uploaded: DataFrame, jobs: DataFrame, visible: Column) -> DataFrame:
    """``uploaded`` with how many visible jobs have its digest, and the newest of them: prior, prior_id; none for blocked files."""
    held = jobs.where(visible).select("id", "created_at", T.digest(F.col("sha256")).alias("_d")).where("_d is not null")
    newest = held.groupBy("_d").agg(F.max_by("id", F.struct("created_at", "id")).alias("prior_id"), F.count("*").alias("prior"))
    own = uploaded.withColumn("_d", F.when(F.col("blocker").isNull(), T.digest(F.col("sha256"))))
    return own.join(newest, "_d", "left").drop("_d").na.fill(0, ["prior"])


def accepted(files: DataFrame, key: list[str], order: list[str], most: int = MOST_FILES) -> DataFrame:
    """The files of a batch that are taken: supported ones, one of each name and length, the first ``most`` in order.

    The limit is what a batch may hold.
    """
    kind = F.lower(F.regexp_extract("filename", r"\.([^./]+)$", 1))
    one = files.where(kind.isin(TYPES)).groupBy(*key, "filename", "length").agg(F.min(F.struct(*order)).alias("_at")).select("*", "_at.*")
    w = Window.partitionBy(*key).orderBy(*order)
    return one.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n", "_at")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(name, present) from a CSV of names and words for true; a header line is left out."""
    rows = spark.read.schema("name string, word string").csv(path)
    return rows.where("name is not null and lower(trim(name)) not in ('file', 'filename', 'name')").select(F.trim("name").alias("name"), F.coalesce(F.lower(F.trim("word")).isin(TRUE_WORDS), F.lit(False)).alias("present"))


def legacy_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of one JSON file each; files that cannot be read are left out."""
    rows = spark.read.schema(f"{schema}, _broken string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("recursiveFileLookup", "true").json(path)
    # Spark reads a column of broken records only beside others.
    return rows.where(F.col("_broken").isNull() & F.expr(" or ".join(f"`{c}` is not null" for c in rows.columns if c != "_broken"))).drop("_broken")


def imported(new: DataFrame, store: DataFrame, projects: DataFrame) -> DataFrame:
    """Legacy batches that the store lacks; a project that is not there is none."""
    fresh = new.join(store.select("id"), "id", "left_anti")
    there = projects.select(F.col("id").alias("project_id"), F.lit(True).alias("_there")).distinct()
    return fresh.join(there, "project_id", "left").select(*(F.when(F.col("_there"), F.col(c)).alias(c) if c == "project_id" else F.col(c) for c in new.columns))


def catalogue(spark: SparkSession) -> DataFrame:
    """The analyzers with their names, in order."""
    from attestry.operators.grading import ANALYZERS

    return spark.createDataFrame([(i, a, a.replace("_", " ").title()) for i, a in enumerate(ANALYZERS)], "position int, analyzer_id string, name string")


def tiles(width: int, height: int, size: int, stride: int) -> Column:
    """The windows over an image as structs (x, y): a stride apart, the last clamped to the edge."""
    last_x, last_y = max(0, width - size), max(0, height - size)
    axis = lambda last: F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(last + stride - 1), F.lit(stride)), lambda v: F.least(v, F.lit(last))))
    return F.flatten(F.transform(axis(last_y), lambda y: F.transform(axis(last_x), lambda x: F.struct(x.alias("x"), y.alias("y")))))


def grid(width: int, height: int, n: int) -> Column:
    """An image in n by n tiles as structs (x0, y0, x1, y1)."""
    edge = lambda i, size: F.floor(i * size / n).cast("int")
    axis = F.sequence(F.lit(0), F.lit(n - 1))
    return F.flatten(F.transform(axis, lambda y: F.transform(axis, lambda x: F.struct(edge(x, width).alias("x0"), edge(y, height).alias("y0"), edge(x + 1, width).alias("x1"), edge(y + 1, height).alias("y1")))))


def native_dpi(width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """An aggregate: the highest resolution of a document's images on their pages (points), upright or turned; null outside 50 to 1200."""
    w, h = page_width / 72.0, page_height / 72.0
    best = F.max(F.when((w > 0) & (h > 0) & (width > 0) & (height > 0), F.greatest(F.least(width / w, height / h), F.least(width / h, height / w))))
    return F.when((best >= 50) & (best <= 1200), F.bround(best, 0).cast("int"))


def needs_ocr(text: Column, least: int = 12) -> Column:
    """Whether a page's text layer is too short to be used."""
    return F.coalesce(F.length(F.trim(text)) < least, F.lit(True))


def profiles(rows: DataFrame) -> DataFrame:
    """Screening profiles (id, name, goal, guidance) within their limits, by name; those without an id or a name are none."""
    cut = lambda c, n: F.left(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(n))
    return rows.where("id is not null and trim(coalesce(name, '')) <> ''").select(F.left("id", F.lit(120)).alias("id"), cut("name", 80).alias("name"), cut("goal", 400).alias("goal"), cut("guidance", 2000).alias("guidance")).orderBy("name", "id")


def raw_results(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Detector outputs as (job_id, analyzer_id, raw) from files <job>/<analyzer>.<ext>, by the kind of output.

    json, font and whitener outputs and reports in a folder are one JSON text a
    file; of what a detector printed (stdout) the object in it counts. A file
    that cannot be read is an error result.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.input_file_name().alias("at"))
    value = T.fenced_json(F.col("value")) if kind == "stdout" else F.try_parse_json("value")
    broken = F.parse_json(F.lit('{"status": "error", "detail": "The output could not be read."}'))
    name = lambda pattern: F.regexp_extract("at", pattern, 1)
    report = r"([^/]+)/([^/]+)/[^/]+$" if kind == "report_dir" else r"([^/]+)/([^/.]+)\.[^/]*$"
    return files.select(name(report).alias("job_id"), F.regexp_extract("at", report, 2).alias("analyzer_id"), F.coalesce(value, broken).alias("raw"))
