"""Deeply nested records as related flat tables with the keys of their parents."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.structural import Index, valid_json
from attestry.session import spread

#: Texts are indexed together up to about this many characters.
BATCH_CHARS = 4_000_000

ROWS = "job_id string, digest bigint, seq bigint, analyzer_id string, child string, ord bigint, sub_ord bigint, body string"

OBJECT, ARRAY, STRING, NULL = 123, 91, 34, 110


class _Values:
    """Values of several indexes (texts within texts have their own), with the row that each belongs to."""

    def __init__(self, index: Index, values: np.ndarray, row: np.ndarray) -> None:
        self.parts = [(index, values, row)] if len(values) else []

    @classmethod
    def of(cls, parts: list) -> _Values:
        it = cls.__new__(cls)
        it.parts = [p for p in parts if len(p[1])]
        return it.opened()

    def opened(self) -> _Values:
        """Strings that hold an object or an array are replaced by what they hold, again and again."""
        done, todo = [], self.parts
        while todo:
            held, rows = [], []
            for index, values, row in todo:
                text = index.first[values] == STRING
                done.append((index, values[~text], row[~text]))
                for v, r in zip(values[text].tolist(), row[text].tolist()):
                    inner = json.loads(index.text(v), strict=False)
                    if inner.strip()[:1] in ("{", "[", '"') and valid_json(inner):
                        held.append(inner)
                        rows.append(r)
            todo = []
            if held:
                inner_index = Index(held)
                todo = [(inner_index, np.arange(len(held)), np.array(rows))]
        self.parts = [p for p in done if len(p[1])]
        return self

    def member(self, name: str) -> _Values:
        parts = []
        for index, values, row in self.parts:
            objects = index.first[values] == OBJECT
            got = index.member(values[objects], name)
            parts.append((index, got[got >= 0], row[objects][got >= 0]))
        return _Values.of(parts)

    def entries(self) -> list[tuple[Index, np.ndarray, np.ndarray, np.ndarray]]:
        """``(index, value, row, ord)`` of a list's entries; an object is its own entry 0."""
        out = []
        for index, values, row in self.parts:
            lists = index.first[values] == ARRAY
            which, child = index.children(values[lists])
            out.append((index, child, row[lists][which], index.ord[child]))
            objects = index.first[values] == OBJECT
            out.append((index, values[objects], row[objects], np.zeros(objects.sum(), np.int64)))
        return out


def _results(texts: list[str]) -> tuple[_Values, list[int], list[str | None]]:
    """The results in ``texts``: values whose row is a number of the lists of text numbers and analyzers."""
    index = Index(texts)
    roots = _Values.of([(index, np.arange(len(texts)), np.arange(len(texts)))])
    doc, analyzer, parts = [], [], []
    for index, values, row in roots.member("results").parts:
        kind = index.first[values]
        for wanted in (OBJECT, ARRAY):
            which, child = index.children(values[kind == wanted])
            held = _Values.of([(index, child, np.arange(len(child)))])
            names = [index.key(c) if wanted == OBJECT else None for c in child.tolist()]
            outer = row[kind == wanted][which]
            for sub, inner, at in held.parts:
                objects = sub.first[inner] == OBJECT
                inner, at = inner[objects], at[objects]
                named = sub.member(inner, "analyzer_id")
                wrapped = sub.member(inner, "result")
                base = len(doc)
                for k, (n, a) in enumerate(zip(named.tolist(), at.tolist())):
                    doc.append(int(outer[a]))
                    own = json.loads(sub.text(n), strict=False) if n >= 0 and sub.first[n] == STRING else None
                    analyzer.append(names[a] if names[a] is not None else own)
                rows = base + np.arange(len(inner))
                parts.append((sub, inner[wrapped < 0], rows[wrapped < 0]))
                parts.append((sub, wrapped[wrapped >= 0], rows[wrapped >= 0]))
                # An analyzer may be named within the wrapped result only.
                for r in rows[wrapped >= 0].tolist():
                    if analyzer[r] is None:
                        m = sub.member(wrapped[[r - base]], "analyzer_id")[0]
                        if m >= 0 and sub.first[m] == STRING:
                            analyzer[r] = json.loads(sub.text(m), strict=False)
    return _Values.of(parts), doc, analyzer


def shred(texts: list[str], body: bool = False) -> dict[str, list]:
    """The child records of valid payloads: doc (number of the text), analyzer_id, child, ord, sub_ord and body."""
    out: dict[str, list] = {k: [] for k in ("doc", "analyzer_id", "child", "ord", "sub_ord", "body")}
    results, doc, analyzer = _results(texts)

    def emit(child: str, index: Index, value: np.ndarray, row: np.ndarray, ord_: np.ndarray, sub: np.ndarray | None) -> None:
        keep = index.first[value] != NULL
        value, row, ord_ = value[keep], row[keep], ord_[keep]
        out["doc"] += [doc[r] for r in row.tolist()]
        out["analyzer_id"] += [analyzer[r] for r in row.tolist()]
        out["child"] += [child] * len(value)
        out["ord"] += ord_.tolist()
        out["sub_ord"] += [-1] * len(value) if sub is None else sub[keep].tolist()
        out["body"] += [index.text(v) for v in value.tolist()] if body else [None] * len(value)

    for child, found in (("region", results.member("regions")), ("fact", results.member("check").member("facts"))):
        for index, value, row, ord_ in found.entries():
            emit(child, index, value, row, ord_, None)
    for index, page, row, ord_ in results.member("raw").member("pages").entries():
        # Each page is a row of its own, so that its regions find their way back.
        pages = _Values.of([(index, page, np.arange(len(page)))])
        for sub_index, value, at, sub in pages.member("regions").entries():
            emit("page_region", sub_index, value, row[at], ord_[at], sub)
    return out


def _batches(columns: Iterator[pa.RecordBatch], body: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("job_id", pa.string()), ("digest", pa.int64()), ("seq", pa.int64()), ("analyzer_id", pa.string()), ("child", pa.string()), ("ord", pa.int64()), ("sub_ord", pa.int64()), ("body", pa.string())])

    def made(ids: list, digests: list, texts: list) -> pa.RecordBatch:
        rows = shred(texts, body)
        docs = rows["doc"]
        at: dict[int, int] = {}
        seq = []
        for d in docs:
            at[d] = at.get(d, -1) + 1
            seq.append(at[d])
        return pa.record_batch([pa.array([ids[d] for d in docs], pa.string()), pa.array([digests[d] for d in docs], pa.int64()), pa.array(seq, pa.int64()), *(pa.array(rows[k], t) for k, t in (("analyzer_id", pa.string()), ("child", pa.string()), ("ord", pa.int64()), ("sub_ord", pa.int64()), ("body", pa.string())))], schema=schema)

    ids, digests, texts, size = [], [], [], 0
    for batch in columns:
        for i, d, t in zip(*(c.to_pylist() for c in batch.columns)):
            if t is None or not valid_json(t):
                continue
            ids.append(i)
            digests.append(d)
            texts.append(t)
            size += len(t)
            if size >= BATCH_CHARS:
                yield made(ids, digests, texts)
                ids, digests, texts, size = [], [], [], 0
    if texts:
        yield made(ids, digests, texts)


def children(jobs: DataFrame, key: str = "id", payload: str = "payload_json", body: bool = False) -> DataFrame:
    """``(job_id, analyzer_id, child, ord, sub_ord[, body])`` of the payloads of ``jobs``.

    child is 'region' for an entry of a result's regions, 'fact' for one of
    its check's facts, 'page_region' for one of the regions of an entry of
    raw.pages; ord is the entry's position from 0 (for page_region the
    page's), sub_ord the position within the page, else -1. Null entries keep
    their position and give no row, a single object in place of a list is its
    entry 0, text that holds an object or a list counts as what it holds, the
    last of repeated members counts. A null, empty or invalid payload gives
    no rows; identical payloads of one key count once; a null key stays null;
    other columns are ignored. With ``body`` each row has its record's JSON.
    """
    read = jobs.select(F.col(key).alias("job_id"), F.xxhash64(payload).alias("digest"), F.col(payload).alias("payload"))
    rows = spread(read).mapInArrow(lambda it: _batches(it, body), ROWS)
    once = rows.dropDuplicates(["job_id", "digest", "seq"])
    return once.select("job_id", "analyzer_id", "child", "ord", "sub_ord", *(["body"] if body else []))
