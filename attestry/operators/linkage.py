"""Links between jobs: equal digests, repeated payloads, near vectors, and the groups they form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators import ordered
from attestry.session import dropped, written_at

#: Matches of faces from here, near misses from there; order of evidence in a listing.
FACE_MATCH, NEAR_MISS = 0.35, 0.25
EVIDENCE_RANK = {"Identical file": 0, "Same QR payload": 1, "Same face": 2, "Face near miss": 3}


def prior_screenings(jobs: DataFrame) -> DataFrame:
    """Of each job whose digest others have: how many others, and the newest of them: (id, others, newest_id).

    One row a job, not one a pair: a digest may be that of a third of all
    jobs. Digests count however they are written; an empty file's does not.
    """
    held = jobs.select("id", T.digest(F.col("sha256")).alias("sha256"), F.struct("created_at", "id").alias("at")).where("sha256 is not null")
    groups = held.groupBy("sha256").agg(F.count("*").alias("n"), F.max("at").alias("top")).where("n > 1")
    joined = held.join(groups, "sha256")
    second = joined.where(F.col("id") != F.col("top.id")).groupBy("sha256").agg(F.max("at").alias("second"))
    return joined.join(second, "sha256").select("id", (F.col("n") - 1).alias("others"), F.when(F.col("id") == F.col("top.id"), F.col("second.id")).otherwise(F.col("top.id")).alias("newest_id"))


def screenings_of(jobs: DataFrame, sha256: str, exclude: str | None = None) -> DataFrame:
    """All jobs of one digest but ``exclude``, later ones too, newest first."""
    same = T.digest(F.col("sha256")) == T.digest(F.lit(sha256))
    return jobs.where(same & ~F.col("id").eqNullSafe(F.lit(exclude))).orderBy(F.desc("created_at"), F.desc("id"))


def identical_files(jobs: DataFrame) -> DataFrame:
    """Within a batch, each job with the first job, by position, that holds its digest: (batch_id, id, first_id)."""
    held = jobs.select("batch_id", "id", "batch_position", T.digest(F.col("sha256")).alias("sha256")).where("sha256 is not null and batch_id is not null")
    # The first holder of a digest is aggregated before it is joined: one digest may fill a batch.
    first = held.groupBy("batch_id", "sha256").agg(F.min_by("id", F.struct("batch_position", "id")).alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return held.join(first, ["batch_id", "sha256"]).where("id <> first_id").select("batch_id", "id", "first_id")


def payload_holders(hits: DataFrame, jobs: DataFrame) -> DataFrame:
    """Within a batch, each job that decoded a payload: (batch_id, job_id, status, hit_id, first_id, payload).

    A duplicate's first hit whose payload an earlier job holds, with that
    payload's first holder; of a new one these are null. Blanks around a
    payload do not count; jobs without a payload are absent.
    """
    bare = F.nullif(F.regexp_replace("payload", r"^\s+|\s+$", ""), F.lit(""))
    placed = hits.select("hit_id", "job_id", bare.alias("payload")).where("payload is not null").join(jobs.where("batch_id is not null").select(F.col("id").alias("job_id"), "batch_id", "batch_position"), "job_id")
    holders = placed.groupBy("batch_id", "payload").agg(F.min(F.struct("batch_position", "job_id")).alias("first"))
    earlier = F.when(F.col("first.batch_position") < F.col("batch_position"), F.struct(F.col("hit_id"), F.col("first.job_id").alias("first_id"), "payload"))
    best = placed.join(holders, ["batch_id", "payload"]).groupBy("batch_id", "job_id").agg(F.min(earlier).alias("hit"))
    return best.select("batch_id", "job_id", F.when(F.col("hit").isNull(), "new").otherwise("duplicate").alias("status"), "hit.hit_id", "hit.first_id", "hit.payload")


def match_signals(jobs: DataFrame, hits: DataFrame, faces: DataFrame) -> DataFrame:
    """The signals that link jobs as one table: (pair_type, job_id, other_id, score).

    Identical files and repeated payloads of one batch, and ``faces`` (job_id,
    other_id, score): a match from FACE_MATCH, a near miss from NEAR_MISS.
    """
    none = F.lit(None).cast("double").alias("score")
    files = identical_files(jobs).select(F.lit("Identical file").alias("pair_type"), F.col("id").alias("job_id"), F.col("first_id").alias("other_id"), none)
    codes = payload_holders(hits, jobs).where("status = 'duplicate'").select(F.lit("Same QR payload").alias("pair_type"), "job_id", F.col("first_id").alias("other_id"), none)
    kind = F.when(F.col("score") >= FACE_MATCH, "Same face").when(F.col("score") >= NEAR_MISS, "Face near miss")
    seen = faces.select(kind.alias("pair_type"), job_key(F.col("job_id")).alias("job_id"), job_key(F.col("other_id")).alias("other_id"), "score").where("pair_type is not null and job_id is not null and other_id is not null")
    return files.unionByName(codes).unionByName(seen)


#: Rows of a group that are compared with as many others in one task.
BLOCK_ROWS = 2000


def nearest_earlier(vectors: DataFrame, group: str, order: str, vector: str, least: float = FACE_MATCH) -> DataFrame:
    """Of each row the most similar strictly earlier row of its group, the first seen of equals: (order, best, score).

    A group is cut into blocks of bounded size by its order, so that a hot one
    takes many tasks; a block meets itself and those before it, each pair of
    blocks one matrix product. Rows with a null vector, group or order have no
    match and are none; all vectors have one length.
    """
    rows = vectors.select(F.col(group).alias("g"), F.col(order).cast("bigint").alias("o"), F.col(vector).cast("array<double>").alias("v")).dropna()
    placed = ordered.numbered(rows, "g", ["o"])
    blocks = rows.groupBy("g").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = placed.join(blocks, "g").withColumn("own", F.floor((F.col("n") - 1) / BLOCK_ROWS).cast("int"))
    left = dealt.select(F.col("g").alias("g1"), F.col("own").alias("x"), F.explode(F.sequence(F.lit(0), "own")).alias("y"), F.col("o").alias("o1"), F.col("v").alias("v1"))
    right = dealt.select(F.col("g").alias("h"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("p"), F.col("own").alias("q"), F.col("o").alias("best"), F.col("v").alias("w"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"o": [], "best": [], "score": []})
        if a.empty or b.empty:
            return none
        b = b.sort_values("best")
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        score = np.round(unit(np.stack(a["v1"].to_numpy())) @ unit(np.stack(b["w"].to_numpy())).T, 12)
        score = np.where(b["best"].to_numpy()[None, :] < a["o1"].to_numpy()[:, None], score, -2)
        at = score.argmax(1)  # the first of equals
        top = score[np.arange(len(a)), at]
        return pd.DataFrame({"o": a["o1"].to_numpy(), "best": b["best"].to_numpy()[at], "score": top})[top >= least]

    pairs = left.groupBy("g1", "x", "y").cogroup(right.groupBy("h", "p", "q")).applyInPandas(best, "o bigint, best bigint, score double")
    top = pairs.groupBy("o").agg(F.max(F.struct("score", (-F.col("best")).alias("b"))).alias("m"))
    return top.select(F.col("o").alias(order), (-F.col("m.b")).alias("best"), F.col("m.score").alias("score"))


def job_key(c: Column) -> Column:
    """An id as jobs.id writes it (32 hex digits in small letters); null for a blank one."""
    return F.nullif(F.lower(F.regexp_replace(c, r"[\s{}-]+", "")), F.lit(""))


def confirmed(pairs: DataFrame) -> DataFrame:
    """The rows of ``pairs`` that link, ids as jobs.id writes them: all but near misses of faces, which are leads."""
    kept = pairs.where(~F.lower(F.trim(F.coalesce("pair_type", F.lit("")))).eqNullSafe("face near miss"))
    return kept.withColumns({c: job_key(F.col(c)) for c in ("job_id", "other_id")})


#: Parts that a label's rows are dealt into where they look up its name: a group may hold a third of all ids.
SALTS = 16


def clusters(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(id, label)``: the smallest id of each id's group, by alternating star contractions: a long chain takes about log(length) rounds."""
    spark = edges.sparkSession
    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    named, named_at = written_at(both.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "named")
    # Ids become numbers in the same order: rounds then shuffle eight bytes an end and aggregate by hash.
    ids = named.select(F.explode(F.array("u", "v")).alias("id")).distinct().repartitionByRange("id").sortWithinPartitions("id")
    ids, ids_at = written_at(ids.withColumn("n", F.monotonically_increasing_id()), "ids")
    number = lambda side: ids.select(F.col("id").alias(side), F.col("n").alias(f"{side}_n"))
    current, at = written_at(named.join(number("u"), "u").join(number("v"), "v").select(F.col("u_n").alias("u"), F.col("v_n").alias("v")), "stars")
    moving = True
    while moving:
        ways = current.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("m")), F.struct(F.col("v").alias("n"), F.col("u").alias("m")))).alias("e")).select("e.*")
        # A vertex's larger neighbours, then its smaller ones and itself, move to the smallest of its neighbourhood.
        low = ways.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        large = ways.where("m > n").join(low, "n").select(F.col("low").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("low"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("low").alias("u"), F.col("u").alias("v")), F.struct(F.col("low").alias("u"), F.col("v").alias("v")))).alias("e")).select("e.*")
        after, after_at = written_at(small.where("u < v").distinct(), "stars")
        # Done when no vertex hangs from two others, and none that others hang from.
        ends = after.select(F.explode(F.array(F.struct(F.col("v").alias("n"), F.lit(1).alias("up")), F.struct(F.col("u").alias("n"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        moving = bool(ends.groupBy("n").agg(F.sum("up").alias("parents"), F.min("up").alias("least")).where("parents > 1 or (parents = 1 and least = 0)").limit(1).take(1))
        dropped(spark, at)
        current, at = after, after_at
    stars = current.select(F.col("v").alias("n"), F.col("u").alias("label")).union(current.select(F.col("u"), F.col("u").alias("l")).distinct())
    own = stars.join(ids, "n").select("id", "label", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    roots = current.select(F.col("u").alias("n")).distinct().join(ids, "n").select(F.col("n").alias("label"), F.col("id").alias("name"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = written_at(own.join(roots, ["label", "salt"]).select("id", F.col("name").alias("label")), "clusters")[0]
    dropped(spark, named_at, ids_at, at)
    return out


def named_clusters(edges: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """``(id, cluster)``: groups named C1, C2, ... by the first appearance (least ``order``) of a member in ``edges``."""
    members = clusters(edges, a, b)
    seen = edges.select(F.col(a).alias("id"), order).union(edges.select(F.col(b), order)).groupBy("id").agg(F.min(order).alias("at"))
    first = members.join(seen, "id").groupBy("label").agg(F.min("at").alias("at"))
    numbered = ordered.numbered(first.withColumn("one", F.lit(1)), "one", ["at", "label"])
    return members.join(numbered.select("label", F.concat(F.lit("C"), "n").alias("cluster")), "label").select("id", "cluster")


def pair_listing(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs with their cluster in the order of a report: clustered first, cluster, evidence, score; position from 1."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in EVIDENCE_RANK.items() for x in kv))[F.col("pair_type")], F.lit(9))
    number = F.try_to_number(F.substring("cluster", 2, 20), F.lit("99999999999999999999")).cast("bigint")
    joined = pairs.join(named.withColumnRenamed("id", "job_id"), "job_id", "left").withColumn("evidence_rank", rank).withColumn("number", number)
    placed = joined.withColumn("one", F.lit(1)).withColumn("late", F.col("number").isNull()).withColumn("low", -F.coalesce("score", F.lit(float("-inf"))))
    out = ordered.numbered(placed, "one", ["late", "number", "evidence_rank", "low", "pair_id"], "position")
    return out.select("pair_id", "cluster", "evidence_rank", "position")
