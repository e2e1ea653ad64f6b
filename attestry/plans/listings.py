"""Queries: listings, pages, totals, links and groups over the store's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators import linkage, ordered, store
from attestry.session import table
from attestry.sources import files

CURSOR = ("2025-12-01T00:00:00", "8")
_JOBS = "SELECT DISTINCT id, batch_id, batch_position, filename, sha256, status, created_at, started_at, completed_at, owner_user_id, flagged, check_contract_version FROM jobs"


def batch_summary_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 batches; the limit comes before the join, so batches without jobs shorten the page."""
    newest = store.page(table(spark, sf_dir, "batches").where(F.col("project_id").isNotNull()), 50)
    return store.batch_summaries(newest, store.jobs(spark, sf_dir))


def batch_page_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursor = store.encode_cursor(*CURSOR)
    return store.page(table(spark, sf_dir, "batches"), 21, cursor).select("id", "created_at")


def project_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, b = table(spark, sf_dir, "projects"), table(spark, sf_dir, "batches")
    filed = b.groupBy("project_id").agg(F.count("*").alias("batch_count"), F.max("created_at").alias("last_batch_at"))
    return p.join(filed, p["id"] == filed["project_id"], "left").select("id", "name", F.coalesce("batch_count", F.lit(0)).alias("batch_count"), "last_batch_at")


def visible_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each owner sees in development: their own and those without an owner."""
    counts = table(spark, sf_dir, "batches").groupBy("owner_user_id").agg(F.count("*").alias("own"))
    unowned = F.coalesce(F.sum(F.when(F.col("owner_user_id").isNull(), F.col("own"))).over(Window.partitionBy(F.lit(1))), F.lit(0))  # a row an owner
    return counts.withColumn("visible", F.col("own") + unowned).where("owner_user_id is not null").select("owner_user_id", "visible")


def prior_screenings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.prior_screenings(store.jobs(spark, sf_dir))


def identical_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.identical_files(store.jobs(spark, sf_dir))


def payload_first_holder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job of a batch that decoded a payload: new, or a duplicate with its first repeated hit and that payload's first holder."""
    hits = table(spark, sf_dir, "qr_hits").select("hit_id", "job_id", "payload").dropDuplicates(["hit_id"])
    return linkage.payload_holders(hits, store.jobs(spark, sf_dir)).select("batch_id", "job_id", "status", "hit_id", "first_id")


def match_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identical files, repeated payloads and faces of all jobs as one table of pairs."""
    return _signals(spark, sf_dir).select("pair_type", "job_id", "other_id", "score")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "qr_hits").select("hit_id", "job_id", "payload").dropDuplicates(["hit_id"])
    faces = table(spark, sf_dir, "pairs").where("pair_type in ('Same face', 'Face near miss')").select("job_id", "other_id", "score")
    return linkage.match_signals(store.jobs(spark, sf_dir), hits, faces)


def signal_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups that those signals, near misses left out, connect: how many jobs, by the smallest of them."""
    linked = linkage.confirmed(_signals(spark, sf_dir))
    return linkage.clusters(linked, "job_id", "other_id").groupBy("label").agg(F.count("*").alias("jobs"))


def nearest_earlier_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linkage.nearest_earlier(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return found.select("vec_id", "best", F.round("score", 3).alias("score"))


def duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of jobs that identical files, QR payloads and faces connect; near misses of faces link nothing."""
    return linkage.named_clusters(linkage.confirmed(table(spark, sf_dir, "pairs")), "job_id", "other_id", "pair_id")


def pair_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs with the cluster of their job, if confirmed links give it one; near misses of faces come after them in it."""
    pairs = table(spark, sf_dir, "pairs")
    named = linkage.named_clusters(linkage.confirmed(pairs), "job_id", "other_id", "pair_id")
    return linkage.pair_listing(pairs.withColumn("job_id", linkage.job_key(F.col("job_id"))), named)


def neighbours_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = store.jobs(spark, sf_dir).where("batch_id is not null").select("id", "batch_id", "batch_position")
    return ordered.neighbours(j, "batch_id", ["batch_position", "id"], "id").select("id", "previous_id", "next_id", "position")


def latest_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(table(spark, sf_dir, "reviews").where("job_id is not null"), "job_id", "reviewed_at", "review_id").select("job_id", "review_id", "decision")


def history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of a period that are decided and match a text, newest first."""
    j = store.jobs(spark, sf_dir).where("created_at >= timestamp_ntz'2025-06-01' and created_at < timestamp_ntz'2026-01-01'")
    decided = store.latest(table(spark, sf_dir, "reviews").where("job_id is not null"), "job_id", "reviewed_at", "review_id").select("job_id", "decision", "reviewer")
    text = F.lower(F.concat_ws(" ", "filename", "decision", "reviewer"))
    return j.join(decided, F.col("id") == F.col("job_id")).where(F.contains(text, F.lit("scan"))).select("id", "filename", "decision")


def default_batch_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch's name from its first file: the stem to 80 characters, or to 60 and how many more."""
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    own = store.jobs(spark, sf_dir).where("batch_id is not null").groupBy("batch_id").agg(F.min_by(stem, F.struct("batch_position", "id")).alias("stem"), F.count("*").alias("n"))
    return own.select("batch_id", F.when(F.col("n") == 1, F.left("stem", F.lit(80))).otherwise(F.concat(F.left("stem", F.lit(60)), F.lit(" +"), F.col("n") - 1, F.lit(" more"))).alias("name"))


def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each queued upload: blocked by its type, or a duplicate of a completed job that its owner may see, by its digest, or ready."""
    j = store.jobs(spark, sf_dir).withColumn("d", T.digest(F.col("sha256")))
    stored = j.where("status = 'completed' and d is not null").select("d", "owner_user_id").distinct()
    own = stored.where("owner_user_id is not null").withColumn("own", F.lit(True))
    open_ = stored.where("owner_user_id is null").select("d", F.lit(True).alias("open"))
    kind = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    state = F.when(files.blocker(kind, F.lit(0), F.lit("%PDF-")).isNotNull(), "blocked").when(F.col("own") | F.col("open"), "duplicate").otherwise("ready")
    return j.where("status = 'queued'").join(own, ["d", "owner_user_id"], "left").join(open_, "d", "left").select("id", state.alias("state"))


def accepted_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each batch that an upload takes, by the batch's order; names stand for lengths."""
    j = store.jobs(spark, sf_dir).where("batch_id is not null").withColumn("length", F.length("filename"))
    return files.accepted(j, ["batch_id"], ["batch_position", "id"]).groupBy("batch_id").agg(F.count("*").alias("taken"), F.max("batch_position").alias("last_position"))


def digest_twins_across_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = store.jobs(spark, sf_dir).withColumn("sha256", T.digest(F.col("sha256"))).where("sha256 is not null")
    return j.groupBy("sha256").agg(F.count("*").alias("jobs"), F.count_distinct("owner_user_id").alias("owners")).where("jobs > 1")


QUERIES = {f.__name__: f for f in (batch_summary_page, batch_page_keyset, project_rollup, visible_totals, prior_screenings, identical_files, payload_first_holder, match_signals, signal_clusters, nearest_earlier_embedding, duplicate_clusters, pair_listing, neighbours_in_batch, latest_review, history_search, default_batch_names, preflight, accepted_uploads, digest_twins_across_owners)}

_KEY = "nullif(regexp_replace(lower({0}), '[\\s{{}}-]+', '', 'g'), '')"
_REACH = "reach(n, m) AS (SELECT a, a FROM g UNION SELECT r.n, g.b FROM reach r JOIN g ON g.a = r.m)"
_CLUSTERS = f"""
    WITH RECURSIVE e AS (SELECT {_KEY.format('job_id')} AS a, {_KEY.format('other_id')} AS b, pair_id FROM pairs WHERE lower(trim(coalesce(pair_type, ''))) <> 'face near miss'),
    g AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), {_REACH},
    labels AS (SELECT n AS id, min(m) AS label FROM reach GROUP BY n),
    seen AS (SELECT id, min(pair_id) AS pos FROM (SELECT a AS id, pair_id FROM e UNION ALL SELECT b, pair_id FROM e) GROUP BY id),
    firsts AS (SELECT label, min(pos) AS pos FROM labels JOIN seen USING (id) GROUP BY label),
    named AS (SELECT label, 'C' || dense_rank() OVER (ORDER BY pos, label) AS cluster FROM firsts),
    clustered AS (SELECT id, cluster FROM labels JOIN named USING (label))
"""
#: A digest as 64 hex digits, not that of an empty file.
_BARE = "regexp_replace(regexp_replace(lower(sha256), '^\\s*sha-?256\\s*[:=]?', ''), '[^0-9a-f]', '', 'g')"
DIGEST = f"CASE WHEN length({_BARE}) = 64 AND {_BARE} <> 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855' THEN {_BARE} END"
_FILES = f"jd AS (SELECT *, {DIGEST} AS d FROM j), files AS (SELECT batch_id, id, first_value(id) OVER (PARTITION BY batch_id, d ORDER BY batch_position, id) AS first_id FROM jd WHERE d IS NOT NULL AND batch_id IS NOT NULL)"
_CODES = """h AS (SELECT DISTINCT hit_id, job_id, nullif(regexp_replace(payload, '^\\s+|\\s+$', '', 'g'), '') AS payload FROM qr_hits),
        p AS (SELECT j.batch_id, j.batch_position, h.* FROM h JOIN j ON j.id = h.job_id WHERE j.batch_id IS NOT NULL AND h.payload IS NOT NULL),
        f AS (SELECT batch_id, payload, min(batch_position) AS first_position, arg_min(job_id, batch_position) AS first_id FROM p GROUP BY 1, 2),
        codes AS (SELECT p.batch_id, p.job_id, min(CASE WHEN f.first_position < p.batch_position THEN p.hit_id END) AS hit_id, arg_min(f.first_id, p.hit_id) FILTER (f.first_position < p.batch_position) AS first_id FROM p JOIN f USING (batch_id, payload) GROUP BY 1, 2)"""
_SIGNALS = f"""j AS ({_JOBS}), {_FILES}, {_CODES}, signals AS (SELECT 'Identical file' AS pair_type, id AS job_id, first_id AS other_id, CAST(NULL AS DOUBLE) AS score FROM files WHERE id <> first_id UNION ALL SELECT 'Same QR payload', job_id, first_id, NULL FROM codes WHERE first_id IS NOT NULL
        UNION ALL SELECT CASE WHEN score >= 0.35 THEN 'Same face' ELSE 'Face near miss' END, {_KEY.format('job_id')}, {_KEY.format('other_id')}, score FROM pairs WHERE pair_type IN ('Same face', 'Face near miss') AND score >= 0.25 AND {_KEY.format('job_id')} IS NOT NULL AND {_KEY.format('other_id')} IS NOT NULL)"""

_LATEST = "SELECT * FROM reviews WHERE job_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY reviewed_at DESC, review_id DESC) = 1"

SQL = {
    "batch_summary_page": f"""
        WITH newest AS (SELECT * FROM batches WHERE project_id IS NOT NULL ORDER BY created_at DESC, id DESC LIMIT 50), j AS ({_JOBS})
        SELECT b.id, b.name, b.created_at, b.project_id, count(*) AS total, count_if(j.status = 'completed') AS completed, count_if(j.status IN ('queued', 'running')) AS active, count_if(j.flagged = 1) AS flagged,
          CASE WHEN count_if(j.status IN ('queued', 'running')) = 0 THEN 'completed' WHEN count_if(j.status IN ('queued', 'running')) = count(*) THEN 'queued' ELSE 'running' END AS status
        FROM newest b JOIN j ON j.batch_id = b.id GROUP BY ALL""",
    "batch_page_keyset": f"SELECT id, created_at FROM batches WHERE created_at < TIMESTAMP '{CURSOR[0]}' OR (created_at = TIMESTAMP '{CURSOR[0]}' AND id < '{CURSOR[1]}') ORDER BY created_at DESC, id DESC LIMIT 21",
    "project_rollup": "SELECT p.id, p.name, count(b.id) AS batch_count, max(b.created_at) AS last_batch_at FROM projects p LEFT JOIN batches b ON b.project_id = p.id GROUP BY p.id, p.name",
    "visible_totals": "SELECT o.owner_user_id, count(*) AS visible FROM (SELECT DISTINCT owner_user_id FROM batches WHERE owner_user_id IS NOT NULL) o JOIN batches b ON b.owner_user_id = o.owner_user_id OR b.owner_user_id IS NULL GROUP BY 1",
    "prior_screenings": f"WITH j AS ({_JOBS}), d AS (SELECT id, created_at, {DIGEST} AS d FROM j) SELECT a.id, count(*) AS others, arg_max(b.id, (b.created_at, b.id)) AS newest_id FROM d a JOIN d b ON a.d = b.d AND a.id <> b.id GROUP BY 1",
    "identical_files": f"WITH j AS ({_JOBS}), {_FILES} SELECT * FROM files WHERE id <> first_id",
    "payload_first_holder": f"WITH j AS ({_JOBS}), {_CODES} SELECT batch_id, job_id, CASE WHEN hit_id IS NULL THEN 'new' ELSE 'duplicate' END AS status, hit_id, first_id FROM codes",
    "match_signals": f"WITH {_SIGNALS} SELECT * FROM signals",
    "signal_clusters": f"WITH RECURSIVE {_SIGNALS}, g AS (SELECT job_id AS a, other_id AS b FROM signals WHERE pair_type <> 'Face near miss' AND job_id <> other_id UNION SELECT other_id, job_id FROM signals WHERE pair_type <> 'Face near miss' AND job_id <> other_id), {_REACH} SELECT label, count(*) AS jobs FROM (SELECT n, min(m) AS label FROM reach GROUP BY n) GROUP BY 1",
    "nearest_earlier_embedding": """
        WITH s AS (SELECT a.vec_id, b.vec_id AS best, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id < a.vec_id)
        SELECT vec_id, best, round(score, 3) AS score FROM s WHERE score >= 0.35 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, best) = 1""",
    "duplicate_clusters": _CLUSTERS + "SELECT id, cluster FROM clustered",
    "pair_listing": _CLUSTERS
    + """SELECT p.pair_id, c.cluster, CASE p.pair_type WHEN 'Identical file' THEN 0 WHEN 'Same QR payload' THEN 1 WHEN 'Same face' THEN 2 WHEN 'Face near miss' THEN 3 ELSE 9 END AS evidence_rank,
        row_number() OVER (ORDER BY CAST(substr(c.cluster, 2) AS BIGINT) ASC NULLS LAST, evidence_rank, p.score DESC NULLS LAST, p.pair_id) AS position
        FROM pairs p LEFT JOIN clustered c ON c.id = """
    + _KEY.format("p.job_id"),
    "neighbours_in_batch": f"WITH j AS ({_JOBS}) SELECT id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id, row_number() OVER w - 1 AS position FROM j WHERE batch_id IS NOT NULL WINDOW w AS (PARTITION BY batch_id ORDER BY batch_position, id)",
    "latest_review": f"SELECT job_id, review_id, decision FROM ({_LATEST})",
    "history_search": f"WITH j AS ({_JOBS}), r AS ({_LATEST}) SELECT j.id, j.filename, r.decision FROM j JOIN r ON r.job_id = j.id WHERE j.created_at >= TIMESTAMP '2025-06-01' AND j.created_at < TIMESTAMP '2026-01-01' AND contains(lower(concat_ws(' ', j.filename, r.decision, r.reviewer)), 'scan')",
    "default_batch_names": f"WITH j AS ({_JOBS}), s AS (SELECT batch_id, arg_min(regexp_replace(filename, '\\.[^.]*$', ''), (batch_position, id)) AS stem, count(*) AS n FROM j WHERE batch_id IS NOT NULL GROUP BY 1) SELECT batch_id, CASE WHEN n = 1 THEN left(stem, 80) ELSE left(stem, 60) || ' +' || (n - 1) || ' more' END AS name FROM s",
    "preflight": f"""WITH j AS ({_JOBS}), d AS (SELECT *, {DIGEST} AS d FROM j), k AS (SELECT DISTINCT d, owner_user_id FROM d WHERE status = 'completed' AND d IS NOT NULL)
        SELECT d.id, CASE WHEN lower(regexp_extract(d.filename, '\\.([^.]+)$', 1)) NOT IN ('pdf', 'png', 'jpg', 'jpeg', 'webp', 'tif', 'tiff') THEN 'blocked' WHEN EXISTS (SELECT 1 FROM k WHERE k.d = d.d AND (k.owner_user_id = d.owner_user_id OR k.owner_user_id IS NULL)) THEN 'duplicate' ELSE 'ready' END AS state FROM d WHERE d.status = 'queued'""",
    "accepted_uploads": f"""WITH j AS ({_JOBS}), o AS (SELECT batch_id, filename, min(batch_position) AS pos FROM j WHERE batch_id IS NOT NULL AND lower(regexp_extract(filename, '\\.([^.]+)$', 1)) IN ('pdf', 'png', 'jpg', 'jpeg', 'webp', 'tif', 'tiff') GROUP BY 1, 2),
        n AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY pos) AS n FROM o) SELECT batch_id, count(*) AS taken, max(pos) AS last_position FROM n WHERE n <= 50 GROUP BY 1""",
    "digest_twins_across_owners": f"WITH j AS ({_JOBS}), d AS (SELECT owner_user_id, {DIGEST} AS sha256 FROM j) SELECT sha256, count(*) AS jobs, count(DISTINCT owner_user_id) AS owners FROM d WHERE sha256 IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
}
