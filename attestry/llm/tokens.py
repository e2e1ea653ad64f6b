"""Encoding of texts by a public byte-level BPE, as recursive DuckDB queries per partition.

A partition's texts are split into words by the tokenizer's pattern; the
distinct words that it has not met yet become rows (word, position, token),
one for each byte. A recursive query joins adjacent rows with the merge table
and contracts each word's pair of least rank, the leftmost first and with it
every further occurrence that does not overlap it, until no word has a pair
left; an ordered aggregation gives each word's ids. No shuffle takes place.

Contracting all occurrences of one pair in a round equals contracting them one
by one, from the left: what a contraction changes before the next occurrence is
only the pair of the new token and the token after it. That pair comes first
only if its rank is lower, and it reaches into the next occurrence only if that
token is the pair's own first one. Pairs of which both hold (some dozens in
this vocabulary) contract one occurrence a round.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.session import spread

#: Where the vocabulary lies; pass another path to any function here to use another.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the word pattern of the byte_bpe vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same over ASCII texts, for the standard library's faster engine.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)

#: Characters encoded by one run of the recursive query, about, and words remembered between runs of one worker.
RUN_CHARS = 1_500_000
WORDS_KEPT = 400_000

_CONTRACT = """
with recursive step(w, pos, tok, round) as (
  select w, pos, tok, 0 from fresh
  union all
  (
    with paired as materialized (
      select p.w, p.rn, p.tok, p.round, m.merged
      from (
        select w, tok, round, cast(row_number() over word as integer) as rn, lead(tok) over word as next_tok
        from step window word as (partition by w order by pos)
      ) p left join merges m on m.a = p.tok and m.b = p.next_tok
    ), least as materialized (
      select w, min(merged) as merged from paired group by w having min(merged) is not null
    ), heads as materialized (
      -- Of overlapping occurrences (one token again and again) every second one contracts, from the left.
      select w, rn, merged from (
        select w, rn, merged, nth, row_number() over (partition by w, rn - nth order by rn) as k from (
          select p.w, p.rn, p.merged, row_number() over (partition by p.w order by p.rn) as nth
          from paired p join least l on l.w = p.w and l.merged = p.merged
        )
      ) where k % 2 = 1 and (nth = 1 or merged not in (select merged from alone))
    )
    select p.w, p.rn, coalesce(h.merged, p.tok), p.round + 1
    from paired p join least l on l.w = p.w
    left join heads h on h.w = p.w and h.rn = p.rn
    left join heads g on g.w = p.w and g.rn = p.rn - 1
    where g.w is null
  )
)
select w, list(tok order by pos) as ids
from (select *, max(round) over (partition by w) as final from step) where round = final
group by w order by w
"""


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary's byte strings and their ids, which are the ranks of the merges."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Encodes texts; one per worker and vocabulary."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        ranks = load_ranks(path)
        self.pattern = regex.compile(PATTERN)
        self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, r in ranks.items():
            self.token_bytes[r] = len(t)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a, b, merged = zip(*merges)
        self.db = duckdb.connect()
        self.db.execute("set threads = 1").fetchall()
        self.db.execute("set memory_limit = '700MB'").fetchall()
        table = pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "merged": pa.array(merged, pa.int32())})
        self.db.register("given", table)
        self.db.execute("create table merges as select * from given").fetchall()
        self.db.unregister("given")
        alone = sorted({r for t, r in ranks.items() for i in range(1, len(t)) if ranks.get(t + t[:i], r) < r and t[:i] in ranks and t[i:] in ranks})
        self.db.execute("create table alone (merged integer)").fetchall()
        self.db.executemany("insert into alone values (?)", [(r,) for r in alone] or [(-1,)]).fetchall()
        self._forget()

    def _forget(self) -> None:
        """Words by number, in the order met; their ids lie end to end in ``flat``."""
        self.known: dict[str, int] = defaultdict(count().__next__)
        self.flat, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def words(self, fresh: list[str]) -> list[np.ndarray]:
        """The ids of each of ``fresh``, distinct words."""
        raw = [w.encode("utf-8", "replace") for w in fresh]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        tokens = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        w = np.repeat(np.arange(len(raw)), size)
        pos = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
        self.db.register("fresh", pa.table({"w": pa.array(w, pa.int32()), "pos": pa.array(pos, pa.int32()), "tok": pa.array(tokens, pa.int32())}))
        got = self.db.sql(_CONTRACT).to_arrow_table()
        self.db.unregister("fresh")
        ids = got.column("ids").combine_chunks()
        flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        return [flat[i:j] for i, j in zip(ends[:-1], ends[1:])]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has."""
        if len(self.known) > WORDS_KEPT:
            self._forget()
        split = [(_ASCII if t.isascii() else self.pattern).findall(t) for t in texts]
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64)  # unmet words get the next number
        fresh = list(islice(self.known, len(self.size), None))
        if fresh:
            new = self.words(fresh)
            self.flat = np.concatenate([self.flat, *new])
            self.size = np.concatenate([self.size, [len(n) for n in new]])
        start = np.cumsum(self.size) - self.size
        n = self.size[numbers]
        done = np.cumsum(n)
        at = np.arange(n.sum()) - np.repeat(done - n, n) + np.repeat(start[numbers], n)
        words = np.cumsum([0, *map(len, split)])
        total = np.concatenate([[0], done])[words]
        return self.flat[at].astype(np.int32), np.diff(total)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, n = self.encode_flat(texts)
        return np.split(ids, np.cumsum(n)[:-1]) if len(texts) else []


def texts_of(column: pa.Array) -> list[str]:
    """The texts of an Arrow column, null as empty, bytes that are no UTF-8 replaced."""
    return ["" if t is None else t.decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def in_runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches put together, or cut, to about RUN_CHARS characters of text each."""
    held, size = [], 0
    for batch in batches:
        step = max(1, int(batch.num_rows * RUN_CHARS / max(1, batch.column(column).nbytes)))
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            held.append(part)
            size += part.column(column).nbytes * part.num_rows // max(1, batch.num_rows) if step < batch.num_rows else batch.column(column).nbytes
            if size >= RUN_CHARS:
                yield _joined(held, column)
                held, size = [], 0
    if held:
        yield _joined(held, column)


def _joined(held: list[pa.RecordBatch], column: int) -> tuple[pa.RecordBatch, list[str]]:
    table = pa.Table.from_batches(held).combine_chunks().to_batches()
    batch = table[0] if table else held[0]
    return batch, texts_of(batch.column(column))


def encoded(documents: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY, with_text: bool = False) -> DataFrame:
    """The columns ``keep`` of ``documents`` and ``ids``, the ids of ``text``.

    Strings that look like special tokens are ordinary text; an empty and a
    null text have an empty list; rows stay as they are, repeated ones too.
    With ``with_text`` the text comes along as ``text``.
    """
    schema = {f.name: f.dataType.simpleString() for f in documents.schema}
    columns = ", ".join([*(f"`{c}` {schema[c]}" for c in keep), *(["text string"] if with_text else []), "ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for batch, texts in in_runs(batches, len(keep)):
            flat, n = encoder.encode_flat(texts)
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
            given = [batch.column(i) for i in range(len(keep))] + ([pa.array(texts, pa.string())] if with_text else [])
            yield pa.RecordBatch.from_arrays([*given, lists], [*keep, *(["text"] if with_text else []), "ids"])

    return spread(documents.select(*keep, F.col(text).alias("__text"))).mapInArrow(run, columns)
