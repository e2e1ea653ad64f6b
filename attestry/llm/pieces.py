"""Oversized texts cut at natural boundaries, with an overlap between pieces.

Sizes are tokens, so the pattern runs over one character a token: its class
says what boundary lies behind it. Bounded quantifiers, with alternatives in
the order of boundary strength, consume up to the limit; any character
boundary is the fallback. The fold over a text's pieces, the lookback for the
overlap and the windows are SQL array and string functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.tokens import VOCABULARY, Encoder, in_runs
from attestry.session import spread

LIMIT, OVERLAP = 512, 64

#: Classes are kept in blocks, so that a window costs the same anywhere in a text.
BLOCK = 1024

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that end a sentence, and those that may close after it.
_ENDS = np.zeros(256, bool)
_ENDS[[33, 46, 63]] = True
_CLOSERS = np.zeros(256, bool)
_CLOSERS[[34, 39, 41, 93]] = True
_WIDE_ENDS = ("。", "！", "？", "।", "…", "؟")


def boundary_classes(raw: bytes, ends: np.ndarray) -> str:
    """One letter for each end (a byte offset): p, l, s or w if a paragraph, line, sentence or word ends there, x within a character, else c."""
    buf = np.frombuffer(raw, np.uint8)
    n = len(buf)
    at = np.arange(n)
    space = _SPACES[buf]
    # Newlines in the run of white space before each offset.
    lines = np.concatenate([[0], np.cumsum(buf == 10)])
    solid = np.maximum.accumulate(np.where(space, -1, at)) if n else at
    last = solid[ends - 1] + 1  # where the run begins
    newlines = lines[ends] - lines[last]
    before, after = space[ends - 1], np.where(ends < n, space[np.minimum(ends, n - 1)], True)
    word = before | after
    # Sentences end with a mark, perhaps closed by quotes or brackets, before white space.
    plain = np.maximum.accumulate(np.where(_CLOSERS[buf], -1, at))
    mark = plain[ends - 1]
    stop = (mark >= 0) & _ENDS[buf[np.maximum(mark, 0)]]
    for wide in _WIDE_ENDS if not raw.isascii() else ():
        w = np.frombuffer(wide.encode(), np.uint8)
        hit = mark >= len(w) - 1
        for k, b in enumerate(w):
            hit &= buf[np.maximum(mark - len(w) + 1 + k, 0)] == b
        stop |= hit
    sentence = stop & (after | ~_ENDS[buf[np.maximum(mark, 0)]])
    inner = np.where(ends < n, (buf[np.minimum(ends, n - 1)] & 0xC0) == 0x80, False)
    kind = np.select([inner, newlines >= 2, newlines == 1, sentence, word], [120, 112, 108, 115, 119], 99)
    return kind.astype(np.uint8).tobytes().decode()


def _marked(documents: DataFrame, keep: list[str], text: str, vocabulary: str, limit: int) -> DataFrame:
    """``keep``, n_tokens, blocks of classes and of text and ends (of each token, in characters) for the texts over the limit."""
    schema = {f.name: f.dataType.simpleString() for f in documents.schema}
    columns = ", ".join([*(f"`{c}` {schema[c]}" for c in keep), "n_tokens int", "blocks array<string>", "texts array<string>", "ends array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for batch, texts in in_runs(batches, len(keep)):
            ids = encoder.encode(texts)
            big = [i for i, x in enumerate(ids) if len(x) > limit]
            blocks, parts, ends = [], [], []
            for i in big:
                raw = texts[i].encode("utf-8", "replace")
                stop = np.cumsum(encoder.token_bytes[ids[i]])
                kinds = boundary_classes(raw, stop)
                blocks.append([kinds[k : k + BLOCK] for k in range(0, len(kinds), BLOCK)])
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                end = chars[stop].astype(np.int32)
                edges = [0, *end[BLOCK - 1 :: BLOCK].tolist(), len(texts[i])]
                parts.append([texts[i][a:b] for a, b in zip(edges[:-1], edges[1:])])
                ends.append(end)
            own = batch.take(pa.array(big, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*own.columns[: len(keep)], pa.array([len(ids[i]) for i in big], pa.int32()), pa.array(blocks, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))],
                [*keep, "n_tokens", "blocks", "texts", "ends"],
            )

    return spread(documents.select(*keep, F.col(text).alias("__text"))).mapInArrow(run, columns)


def spans(n: Column, blocks: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """The pieces of a text of ``n`` tokens as an array of structs (start, stop) of token positions."""
    least, short = max(limit // 2, overlap + 1), min(overlap + overlap // 2 + 1, limit)
    # Each alternative consumes up to the limit, half of it at least; then what boundaries lie before that, behind the overlap; the last resort is any end of a character.
    pattern = "|".join([*(f"^.{{{start - 1},{limit - 1}}}{kind}" for start in (least, short) for kind in "plsw"), f"^.{{{overlap},{limit - 1}}}[^x]", f"^.{{1,{limit}}}"])
    # The overlap begins at a word if one begins soon, else at a character.
    start_pattern = f"^.{{0,{overlap // 4}}}?[plsw]|^.*?[^x]"

    def window(pos: Column, size: int) -> Column:
        count = -(-size // BLOCK) + 1
        first = F.floor(pos / BLOCK).cast("int")
        joined = F.array_join(F.slice(blocks, first + 1, F.lit(count)), "")
        return F.substring(joined, pos - first * BLOCK + 1, F.lit(size))

    def step(state: Column, _: Column) -> Column:
        start = state["start"]
        taken = F.length(F.regexp_extract(window(start, limit), pattern, 0))
        stop = F.when(start + limit >= n, n).otherwise(start + taken)
        back = F.greatest(stop - (overlap + 1), F.lit(0))
        skipped = F.length(F.regexp_extract(window(back, overlap), start_pattern, 0))
        following = F.when(stop >= n, n).otherwise(back + skipped) if overlap else stop
        piece = F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"))
        ahead = F.struct(following.cast("int").alias("start"), F.array_append(state["pieces"], piece).alias("pieces"))
        return F.when(start >= n, state).otherwise(ahead)

    empty = F.from_json(F.lit("[]"), "array<struct<start:int,stop:int>>")
    steps = F.sequence(F.lit(1), F.ceil(n / max(1, short - overlap)).cast("int") + 1)
    return F.aggregate(steps, F.struct(F.lit(0).alias("start"), empty.alias("pieces")), step, lambda s: s["pieces"])


def split(documents: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of the texts of more than ``limit`` tokens.

    ``keep``, piece (from 0), start_char and end_char (in Unicode characters),
    n_tokens, overlap_tokens (shared with the piece before) and text. Joined
    without their overlaps the pieces are the text. Smaller, empty and null
    texts give no rows; repeated rows are cut each on their own; columns
    outside ``keep`` are ignored.
    """
    marked = _marked(documents, keep, text, vocabulary, limit).withColumn("pieces", spans(F.col("n_tokens"), F.col("blocks"), limit, overlap))
    char = lambda token: F.when(token == 0, 0).otherwise(F.get("ends", token - 1))

    def piece(p: Column, i: Column) -> Column:
        shared = F.when(i == 0, 0).otherwise(F.get("pieces", i - 1)["stop"] - p["start"])
        # The text comes from the blocks that the piece lies in, so a cut costs the same anywhere in a text.
        first = F.floor(p["start"] / BLOCK).cast("int")
        begin, end, edge = char(p["start"]), char(p["stop"]), char(first * BLOCK)
        held = F.array_join(F.slice("texts", first + 1, F.lit(-(-limit // BLOCK) + 1)), "")
        return F.struct(
            begin.cast("int").alias("start_char"), end.cast("int").alias("end_char"), (p["stop"] - p["start"]).alias("n_tokens"), F.greatest(shared, F.lit(0)).cast("int").alias("overlap_tokens"), F.substring(held, begin - edge + 1, end - begin).alias("text")
        )

    return marked.select(*keep, F.posexplode(F.transform("pieces", piece)).alias("piece", "_p")).select(*keep, "piece", "_p.start_char", "_p.end_char", "_p.n_tokens", "_p.overlap_tokens", "_p.text")
