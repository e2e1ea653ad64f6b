"""Fields that drift between the files of a stream: profiles, changes, one table.

Each file's fields are profiled (types as a bit set, a sketch of the values);
a field that goes and one that comes in the same object of the next file are a
candidate rename. The records that both files hold decide which candidates
are admissible, and a maximum-weight bipartite matching over value sketches,
types and name similarity picks among them. Matched fields then share one
column of the unified table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.structural import valid_json
from attestry.session import spread, written

#: Bits of the JSON types; null has none.
TYPE_BITS = {"string": 1, "number": 2, "boolean": 4, "array": 8, "object": 16}

FILE = ["site", "stream", "file_no"]
_FIELD = pa.struct([("path", pa.string()), ("parent", pa.string()), ("type", pa.int32()), ("value", pa.string())])


def _canonical(value: object) -> object:
    """Numbers compare by value, members in any order."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        return int(value)
    if isinstance(value, dict):
        return {k: _canonical(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_canonical(v) for v in value]
    return value


def _type(value: object) -> int:
    for kind, name in ((bool, "boolean"), (str, "string"), ((int, float), "number"), (list, "array"), (dict, "object")):
        if isinstance(value, kind):
            return TYPE_BITS[name]
    return 0


def fields_of(text: str | None) -> list[dict] | None:
    """The fields of one record, outer and inner names joined by '.'; None if it is not a readable object."""
    if text is None or not valid_json(text):
        return None
    try:
        record = json.loads(text)
    except RecursionError:
        return None
    if not isinstance(record, dict):
        return None
    out, todo = [], [("", record)]
    while todo:
        parent, obj = todo.pop()
        for name, value in obj.items():
            path = f"{parent}.{name}" if parent else name
            out.append({"path": path, "parent": parent, "type": _type(value), "value": json.dumps(_canonical(value), sort_keys=True)})
            if isinstance(value, dict):
                todo.append((path, value))
    return out


def flat_fields(records: DataFrame) -> DataFrame:
    """``(site, stream, file_no, line_no, record_key, path, parent, type, value)`` of readable records; value is canonical JSON."""
    columns = [*FILE, "line_no", "record_key"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = pa.array([fields_of(t) for t in batch.column(len(columns)).to_pylist()], pa.list_(_FIELD))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fields], [*columns, "fields"])

    types = {f.name: f.dataType.simpleString() for f in records.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in columns) + ", fields array<struct<path string, parent string, type int, value string>>"
    parsed = spread(records.select(*columns, "record_json")).mapInArrow(parse, schema)
    return parsed.select(*columns, F.explode("fields").alias("f")).select(*columns, "f.*")


def profiles(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(site, stream, file_no, path, parent, types)`` of each field of each file, and the files."""
    seen = flat.groupBy(*FILE, "path", "parent").agg(F.bit_or("type").alias("types"))
    return seen, seen.select(*FILE).distinct()


def _numbered(files: DataFrame) -> DataFrame:
    stream = Window.partitionBy("site", "stream")
    return files.withColumn("idx", F.row_number().over(stream.orderBy("file_no")) - 1).withColumn("last", F.max("idx").over(stream))


def _same(a: str, b: str, columns: list[str]) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return on


def assign(weight: np.ndarray) -> list[tuple[int, int]]:
    """The maximum-weight matching of a bipartite graph; pairs of weight 0 or less stay apart."""
    rows, cols = weight.shape
    n = max(rows, cols)
    cost = np.zeros((n + 1, n + 1))
    cost[1 : rows + 1, 1 : cols + 1] = -np.maximum(weight, 0)
    u, v, match, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):  # shortest augmenting paths with potentials
        match[0], j0 = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used
            free[0] = False
            step = cost[i0] - u[i0] - v
            better = free & (step < least)
            least[better], way[better] = step[better], j0
            j1 = int(np.where(free, least, np.inf).argmin())
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, cols + 1) if 0 < match[j] <= rows and weight[match[j] - 1, j - 1] > 0]


def _name_similarity(a: str, b: str) -> float:
    a, b = a.rsplit(".", 1)[-1].lower(), b.rsplit(".", 1)[-1].lower()
    return SequenceMatcher(None, a, b).ratio()


def _match(pdf: pd.DataFrame) -> pd.DataFrame:
    old, new = sorted(set(pdf["old_path"])), sorted(set(pdf["new_path"]))
    weight = np.zeros((len(old), len(new)))
    for r in pdf.itertuples():
        weight[old.index(r.old_path), new.index(r.new_path)] = 1 + 0.5 * _name_similarity(r.old_path, r.new_path) + 0.25 * (r.old_types == r.new_types) + 0.25 * r.overlap
    first = pdf.iloc[0]
    return pd.DataFrame([(first.site, first.stream, first.idx, old[i], new[j]) for i, j in assign(weight)], columns=["site", "stream", "idx", "old_path", "new_path"])


def _changes(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw changes between consecutive files, and the files with their idx."""
    seen, files = profiles(flat)
    files = written(_numbered(files), "files")
    seen = written(seen.alias("s").join(files.alias("f"), _same("s", "f", FILE)).select("s.*", "f.idx", "f.last"), "profiles")
    path = Window.partitionBy("site", "stream", "path").orderBy("idx")
    around = seen.withColumn("before", F.lag("idx").over(path)).withColumn("after", F.lead("idx").over(path)).withColumn("types_before", F.lag("types").over(path))
    come = around.where("idx > 0 and (before is null or before < idx - 1)").select("site", "stream", "idx", "path", "parent", "types", F.lit("added").alias("kind"))
    gone = around.where("idx < last and (after is null or after > idx + 1)").select("site", "stream", (F.col("idx") + 1).alias("idx"), "path", "parent", "types", F.lit("removed").alias("kind"))
    turned = around.where("before = idx - 1 and types <> types_before").select("site", "stream", "idx", "path", "parent", "types", F.lit("type_changed").alias("kind"))
    return written(come.union(gone).union(turned), "changes"), files


def _renames(flat: DataFrame, changes: DataFrame, files: DataFrame) -> DataFrame:
    """``(site, stream, idx, old_path, new_path)``: renames by the matching over admissible candidates."""
    both = lambda kind, p: changes.where(F.col("kind") == kind).select("site", "stream", "idx", "parent", F.col("path").alias(f"{p}_path"), F.col("types").alias(f"{p}_types"))
    place = ["site", "stream", "idx", "parent"]
    # Written first, as they are small: their size is known, and the fields meet them without a shuffle.
    candidates = written(both("removed", "old").alias("o").join(both("added", "new").alias("n"), _same("o", "n", place)).select("o.*", "n.new_path", "n.new_types"), "candidates")
    changed = written(candidates.select("site", "stream", "idx").distinct(), "changed")
    placed = flat.alias("r").join(files.alias("f"), _same("r", "f", FILE)).select("r.site", "r.stream", "f.idx", "r.record_key", "r.path", "r.value")

    def values(side: str, shift: int) -> DataFrame:
        wanted = written(candidates.select("site", "stream", "idx", F.col(f"{side}_path").alias("path")).distinct(), "wanted")
        rows = placed.withColumn("idx", F.col("idx") + shift)
        return rows.alias("v").join(wanted.alias("w"), _same("v", "w", ["site", "stream", "idx", "path"]), "left_semi")

    # The records that both files of a change hold.
    at = ["site", "stream", "idx"]
    around = written(changed.union(changed.withColumn("idx", F.col("idx") - 1)).distinct(), "around")
    keys = placed.where("record_key is not null").select(*at, "record_key").alias("k").join(around.alias("a"), _same("k", "a", at), "left_semi").distinct()
    both_files = keys.alias("k").join(keys.withColumn("idx", F.col("idx") + 1).alias("p"), _same("k", "p", at) & (F.col("k.record_key") == F.col("p.record_key")), "left_semi")
    held = written(both_files.alias("h").join(changed.alias("c"), _same("h", "c", at), "left_semi"), "held")

    def digest(side: str, shift: int) -> DataFrame:
        """Of each field: one number for its values in the held records (absent and null alike), how many are there, a sketch of all."""
        rows = values(side, shift).where("value <> 'null'")
        own = held.withColumn("shared", F.lit(True))
        joined = rows.alias("r").join(own.alias("h"), _same("r", "h", at) & (F.col("r.record_key") == F.col("h.record_key")), "left").select("r.*", "h.shared")
        once = joined.groupBy(*at, "path", "record_key", "shared").agg(F.max("value").alias("value"))
        mix = F.when(F.col("shared"), F.xxhash64("record_key", "value"))
        check = F.when(F.col("shared"), F.hash("value", "record_key").cast("long"))
        return once.groupBy(*at, "path").agg(
            F.bit_xor(mix).alias(f"{side}_mix"), F.sum(check).alias(f"{side}_sum"), F.count("shared").alias(f"{side}_held"), F.hll_sketch_agg(F.xxhash64("value")).alias(f"{side}_sketch")
        )

    old, new = digest("old", 1), digest("new", 0)
    known = (
        candidates.alias("c")
        .join(old.alias("a"), _same("c", "a", at) & (F.col("c.old_path") == F.col("a.path")))
        .join(new.alias("b"), _same("c", "b", at) & (F.col("c.new_path") == F.col("b.path")))
        .where("old_mix = new_mix and old_sum = new_sum and old_held = new_held and old_held > 0")
    )
    union = F.hll_sketch_estimate(F.hll_union("old_sketch", "new_sketch"))
    overlap = F.greatest(F.lit(0.0), (F.hll_sketch_estimate("old_sketch") + F.hll_sketch_estimate("new_sketch") - union) / F.greatest(union, F.lit(1)))
    admissible = known.select("c.site", "c.stream", "c.idx", "c.parent", "c.old_path", "c.new_path", "c.old_types", "c.new_types", overlap.alias("overlap"))
    types = {f.name: f.dataType.simpleString() for f in admissible.schema}
    # A group holds the changed fields of one object of one file: as many as it has members.
    cores = flat.sparkSession.sparkContext.defaultParallelism
    return admissible.repartition(cores, "site", "stream", "idx", "parent").groupBy("site", "stream", "idx", "parent").applyInPandas(_match, f"site {types['site']}, stream {types['stream']}, idx int, old_path string, new_path string")


def drift(records: DataFrame, flat: DataFrame | None = None) -> DataFrame:
    """``(site, stream, file_no, change_kind, field_path, new_path)`` between each file and the one before it.

    ``records`` has site, stream, file_no, line_no, record_key, record_json;
    other columns are ignored. Unreadable lines and lines that are no object
    give no fields, doubled lines count once, a null record_key is shared by
    no records, null sites and streams are streams of their own. A rename
    needs one value, not null, in the records both files hold, and the same
    values in all of them (absent as null); ties go to the more similar name.
    A field inside a reported one is not reported. No records, no rows.
    """
    flat = written(flat_fields(records), "fields") if flat is None else flat
    changes, files = _changes(flat)
    renames = written(_renames(flat, changes, files), "renames")
    at = ["site", "stream", "idx"]
    known = renames.select(*at, F.explode(F.array(F.struct(F.lit("removed").alias("kind"), F.col("old_path").alias("path")), F.struct(F.lit("added").alias("kind"), F.col("new_path").alias("path")))).alias("k")).select(*at, "k.kind", "k.path")
    plain = changes.alias("c").join(known.alias("k"), _same("c", "k", [*at, "kind", "path"]), "left_anti").select(*at, "kind", "path", F.lit("").alias("new_path"))
    moved = renames.select(*at, F.lit("renamed").alias("kind"), F.col("old_path").alias("path"), "new_path")
    every = plain.union(moved)
    # Paths that are reported hide what is inside them, under the old name or the new.
    tops = every.select(*at, F.explode(F.when(F.col("new_path") == "", F.array("path")).otherwise(F.array("path", "new_path"))).alias("top")).distinct()
    parts = F.split("path", r"\.")
    outer = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    inside = every.where(F.size(parts) > 1).select(*at, "kind", "path", F.explode(outer).alias("top"))
    hidden = inside.alias("i").join(tops.alias("t"), _same("i", "t", [*at, "top"]), "left_semi").select(*at, "kind", "path").distinct()
    shown = every.alias("e").join(hidden.alias("h"), _same("e", "h", [*at, "kind", "path"]), "left_anti")
    return shown.alias("e").join(files.alias("f"), _same("e", "f", at)).select(
        "e.site", "e.stream", F.col("f.file_no").cast("bigint").alias("file_no"), F.col("e.kind").alias("change_kind"), F.col("e.path").alias("field_path"), "e.new_path"
    )


def _chains(pdf: pd.DataFrame) -> pd.DataFrame:
    """The newest name of each path, per file, by following the renames back from the last file."""
    pdf = pdf.sort_values("file_no", ascending=False)
    out, name = [], {}
    for r in pdf.itertuples():
        newest = name.get(r.new_path, r.new_path)
        name[r.field_path] = newest
        out.append((r.site, r.stream, r.field_path, r.file_no, newest))
    return pd.DataFrame(out, columns=["site", "stream", "path", "until", "column"])


def unified(records: DataFrame) -> DataFrame:
    """``(site, stream, file_no, line_no, record_key, column, value)``: all readable records under one set of columns.

    A renamed field goes by the last name it takes in its stream; values are
    JSON texts, so a column whose type changed holds both forms. Inner fields
    of objects are columns of their own, the objects themselves are not.
    """
    flat = written(flat_fields(records), "fields")
    renamed = drift(records, flat).where("change_kind = 'renamed'")
    types = {f.name: f.dataType.simpleString() for f in records.schema}
    names = renamed.groupBy("site", "stream").applyInPandas(_chains, f"site {types['site']}, stream {types['stream']}, path string, until bigint, column string")
    leaf = flat.where(F.col("type") != TYPE_BITS["object"])
    # A name holds for the files before its rename; the earliest such rename applies.
    on = _same("l", "n", ["site", "stream"]) & ((F.col("l.path") == F.col("n.path")) | F.startswith(F.col("l.path"), F.concat("n.path", F.lit(".")))) & (F.col("l.file_no") < F.col("n.until"))
    named = leaf.alias("l").join(names.alias("n"), on, "left")
    key = [*FILE, "line_no", "record_key"]
    best = named.groupBy(*(F.col(f"l.{c}") for c in [*key, "path", "value"])).agg(F.min_by(F.struct(F.col("n.column"), F.col("n.path").alias("was")), F.struct(F.col("n.until"), -F.length("n.path"))).alias("n"))
    column = F.when(F.col("n.column").isNull(), F.col("path")).otherwise(F.concat("n.column", F.expr("substring(path, length(n.was) + 1)")))
    return best.select(*key, column.alias("column"), "value")
