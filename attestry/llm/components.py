"""One group identifier for all records that are linked directly or through others.

The giant component is peeled first: a breadth-first search from the vertex of
highest degree joins its frontier to the edges until the frontier is small
against what is reached; the reached vertices leave the graph through an
anti-join. What remains, with a reached set contracted to one vertex where
edges still leave it, is labelled by minimum propagation, as alternating star
contractions, so that a long chain takes about log(length) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.session import dropped, written_at

#: The search stops when the frontier holds less than this share of the reached vertices.
FRONTIER_SHARE = 0.02


def undirected(links: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct edges ``(u, v)`` with ``u < v``; null sides and self-links give none."""
    return (
        links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") < F.col("v")))
        .distinct()
    )


def _both_ways(edges: DataFrame) -> DataFrame:
    flip = F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("m")), F.struct(F.col("v").alias("n"), F.col("u").alias("m"))))
    return edges.select(flip.alias("e")).select("e.n", "e.m")


def peel(edges: DataFrame) -> tuple[DataFrame, DataFrame, object, list[str]]:
    """Reach out from the vertex of highest degree.

    Returns the reached vertices ``(n)``, the edges still to label (those with
    a reached end have it replaced by the root), the root (None for an empty
    graph) and the places of the tables written.
    """
    spark = edges.sparkSession
    both, both_at = written_at(_both_ways(edges), "both")
    top = both.groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not top:
        return edges.select(F.col("u").alias("n")).limit(0), edges, None, [both_at]
    root = top[0].n
    frontier, at = written_at(spark.createDataFrame([(root,)], both.select("n").schema), "reached")
    places, reached, size = [at], frontier, 1
    while True:
        step = both.join(frontier, "n", "left_semi").select(F.col("m").alias("n")).distinct()
        frontier, at = written_at(step.join(reached, "n", "left_anti"), "reached")
        places.append(at)
        found = frontier.count()
        size += found
        reached = spark.read.schema(frontier.schema).parquet(*places)
        if found < max(1, FRONTIER_SHARE * size):
            break
    # Edges among reached vertices go; one that leaves the set hangs from the root.
    mark = reached.withColumn("in_", F.lit(True))
    rest = (
        edges.join(mark.withColumnRenamed("n", "u").withColumnRenamed("in_", "u_in"), "u", "left")
        .join(mark.withColumnRenamed("n", "v").withColumnRenamed("in_", "v_in"), "v", "left")
        .where(F.col("u_in").isNull() | F.col("v_in").isNull())
        .select(
            F.when(F.col("u_in"), F.lit(root)).otherwise(F.col("u")).alias("a"),
            F.when(F.col("v_in"), F.lit(root)).otherwise(F.col("v")).alias("b"),
        )
    )
    return reached, undirected(rest, "a", "b"), root, [both_at, *places]


def propagate(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """``(n, label)``: each vertex of ``edges`` with the smallest vertex of its component.

    Each round hangs a vertex's larger neighbours, then its smaller ones, on
    the smallest of its neighbourhood, until every edge is a star's ray.
    """
    at = None
    current = edges
    while True:
        both = _both_ways(current)
        low = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        large = both.where(F.col("m") > F.col("n")).join(low, "n").select(F.col("m").alias("v"), F.col("low").alias("u")).where("u < v").distinct()
        # Now u < v: v's smaller neighbours and v itself move to the smallest of them.
        least = large.groupBy("v").agg(F.min("u").alias("low"))
        small = (
            large.join(least, "v")
            .select(F.explode(F.array(F.struct(F.col("low").alias("u"), F.col("u").alias("v")), F.struct(F.col("low").alias("u"), F.col("v").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u < v")
            .distinct()
        )
        after, after_at = written_at(small, "star")
        # Done when no vertex has two parents and no parent has one of its own.
        ends = after.select(F.explode(F.array(F.struct(F.col("v").alias("n"), F.lit(1).alias("up")), F.struct(F.col("u").alias("n"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        moving = ends.groupBy("n").agg(F.sum("up").alias("parents"), F.min("up").alias("least")).where("parents > 1 or (parents = 1 and least = 0)")
        done = not moving.limit(1).take(1)
        if at:
            dropped(edges.sparkSession, at)
        current, at = after, after_at
        if done:
            break
    rays = current.select(F.col("v").alias("n"), F.col("u").alias("label"))
    return rays.union(current.select(F.col("u").alias("n"), F.col("u").alias("label")).distinct()), [at]


def components(links: DataFrame, a: str = "job_id", b: str = "other_id") -> DataFrame:
    """``(id, group_id)`` for every id linked to another, over columns ``a`` and ``b`` of ``links``.

    group_id is the smallest id of the group. A link with a null side or with
    one id on both sides links nothing; repeated and reversed links count
    once; no links give no rows; other columns are ignored, whatever their
    names. An empty string is an id like any other: filter it out beforehand
    where it stands for a missing side.
    """
    spark = links.sparkSession
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    named, named_at = written_at(undirected(pairs, "a", "b"), "named")
    # Ids become numbers in the same order: rounds then shuffle eight bytes an end and aggregate by hash.
    ids = named.select(F.explode(F.array("u", "v")).alias("id")).distinct().repartitionByRange("id").sortWithinPartitions("id")
    ids, ids_at = written_at(ids.withColumn("n", F.monotonically_increasing_id()), "ids")
    number = lambda side: ids.select(F.col("id").alias(side), F.col("n").alias(f"{side}_n"))
    edges, edges_at = written_at(named.join(number("u"), "u").join(number("v"), "v").select(F.col("u_n").alias("u"), F.col("v_n").alias("v")), "edges")
    reached, rest, root, places = peel(edges)
    rest, rest_at = written_at(rest, "rest")
    labels, star_at = propagate(rest)
    labels, labels_at = written_at(labels, "labels")
    # The contracted set's vertices share the smallest of their own ids and of what the root's label covers.
    giant, others = None, labels
    if root is not None:
        hung = labels.where(F.col("n") == F.lit(root)).select("label").collect()  # one row at most
        joined = F.col("label") == F.lit(hung[0].label) if hung else F.lit(False)
        giant, others = reached.union(labels.where(joined).select("n")).distinct(), labels.where(~joined)
    # Small groups look their label up; the giant's, which would be a hot key, is one value.
    out = others.join(ids, "n").select("id", "label").join(ids.select(F.col("n").alias("label"), F.col("id").alias("group_id")), "label").select("id", "group_id")
    if giant is not None:
        own = giant.join(ids, "n").select("id")
        out = out.union(own.withColumn("group_id", F.lit(own.agg(F.min("id")).first()[0])))
    dropped(spark, named_at, edges_at, rest_at, *star_at)
    out, _ = written_at(out, "groups")
    dropped(spark, ids_at, labels_at, *places)
    return out


def job_groups(pairs: DataFrame) -> DataFrame:
    """``(job_id, group_id)`` for the rows of ``pairs``, ids in the form of jobs.id (32 lower-case hex digits).

    Near misses of faces are leads and link nothing; a side that is null or
    blank after trimming links nothing.
    """
    norm = lambda c: F.nullif(F.lower(F.regexp_replace(F.col(c), r"[\s{}-]+", "")), F.lit(""))
    kept = pairs.where(~F.lower(F.trim(F.coalesce("pair_type", F.lit("")))).eqNullSafe("face near miss"))
    groups = components(kept.select(norm("job_id").alias("a"), norm("other_id").alias("b")), "a", "b")
    return groups.select(F.col("id").alias("job_id"), "group_id")
