"""Documents packed into containers of fixed capacity.

Items are spread over groups of about equal size (by a hash, so a hot source
cannot fill one). Within a group items fill bins as they come; local search
then empties the emptiest bins: moves, one-for-one and two-for-one exchanges
with other underfull bins, each of which increases the sum of squared fills,
until no bin can be saved or no exchange helps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.tokens import VOCABULARY, encoded
from attestry.session import written

CAPACITY = 2048

#: Containers filled together; each group wastes less than a container on average, so about 1 in 1,000.
GROUP_CONTAINERS = 1000


class Bins:
    """Items in bins of one capacity: each item's size and bin, each bin's items and fill."""

    #: Emptiest bins tried before the search ends; items of a bin that stand for it in exchanges of two.
    BREADTH, PAIRED = 24, 10

    def __init__(self, sizes: np.ndarray, capacity: int) -> None:
        self.sizes, self.capacity = np.asarray(sizes, np.int64), capacity
        self.bin = np.zeros(len(self.sizes), np.int64)
        self.items: list[set[int]] = []
        self.fill = np.zeros(0, np.int64)
        self._paired: dict[int, np.ndarray] = {}

    def first_pass(self) -> None:
        """Items as they come, each into the fullest bin that still takes it."""
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        rooms, fill = 0, []  # a bit for each room that some bin has
        for item, size in enumerate(self.sizes.tolist()):
            fitting = rooms >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
            else:
                room, b = self.capacity, len(fill)
                fill.append(0)
                self.items.append(set())
            self.bin[item] = b
            self.items[b].add(item)
            fill[b] += size
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
        self.fill = np.array(fill, np.int64)

    def _some(self, b: int) -> list[int]:
        """The items of a bin, one for each size; evenly spaced ones if there are many."""
        by_size = {int(self.sizes[i]): i for i in sorted(self.items[b])}
        held = [by_size[s] for s in sorted(by_size, reverse=True) if s]
        return held if len(held) <= self.PAIRED else [held[round(k * (len(held) - 1) / (self.PAIRED - 1))] for k in range(self.PAIRED)]

    def _pairs(self, b: int) -> np.ndarray:
        """Pairs of a bin's items, with the bin."""
        if b not in self._paired:
            some = self._some(b)
            self._paired[b] = np.array([(b, some[i], some[j]) for i in range(len(some)) for j in range(i)], np.int64).reshape(-1, 3)
        return self._paired[b]

    def _exchange(self, b: int, give: tuple[int, ...], c: int, take: tuple[int, ...]) -> None:
        for items, source, target in ((give, b, c), (take, c, b)):
            for i in items:
                self.items[source].discard(i)
                self.items[target].add(i)
                self.bin[i] = target
                self.fill[source] -= self.sizes[i]
                self.fill[target] += self.sizes[i]
        if not self.fill[b]:  # items of no size go along
            for i in self.items[b]:
                self.bin[i] = c
            self.items[c] |= self.items[b]
            self.items[b] = set()
        self._paired.pop(b, None)
        self._paired.pop(c, None)

    def _improve(self, b: int) -> int | None:
        """Apply the exchange that takes load off bin ``b`` with the greatest gain in squared fill; the other bin, None if there is none."""
        room = self.capacity - self.fill
        under = np.flatnonzero((self.fill > 0) & (room > 0))
        under = under[under != b]
        if not len(under):
            return None
        best, chosen = 0, None

        def gain(shift: np.ndarray, c: np.ndarray) -> np.ndarray:
            return np.where((shift > 0) & (shift <= room[c]), 2 * shift * (self.fill[c] - self.fill[b] + shift), 0)

        gives = [(i,) for i in self._some(b)] + [(i, j) for _, i, j in self._pairs(b).tolist()]
        given = [int(self.sizes[list(g)].sum()) for g in gives]
        # A move goes to the fullest bin that takes it.
        by_room = under[np.argsort(room[under], kind="stable")]
        fitting = np.searchsorted(room[by_room], given)
        for give, size, at in zip(gives, given, fitting.tolist()):
            if at < len(by_room) and (value := int(gain(np.int64(size), by_room[at]))) > best:
                best, chosen = value, (give, int(by_room[at]), ())
        # One item taken back.
        held = np.flatnonzero((room[self.bin] > 0) & (self.bin != b) & (self.sizes > 0))
        sizes, owner = self.sizes[held], self.bin[held]
        for give, size in zip(gives, given):
            value = gain(size - sizes, owner)
            if len(value) and value.max() > best:
                best, chosen = int(value.max()), (give, int(owner[value.argmax()]), (int(held[value.argmax()]),))
        if chosen is None:  # two taken back for one
            pairs = np.concatenate([self._pairs(c) for c in under.tolist()])
            sizes = self.sizes[pairs[:, 1]] + self.sizes[pairs[:, 2]]
            for give, size in zip(gives, given):
                if len(give) == 1 and len(pairs) and (value := gain(size - sizes, pairs[:, 0])).max() > best:
                    k = int(value.argmax())
                    best, chosen = int(value[k]), (give, int(pairs[k, 0]), (int(pairs[k, 1]), int(pairs[k, 2])))
        if chosen is None:
            return None
        self._exchange(b, *chosen)
        return chosen[1]

    def search(self) -> None:
        """Empty the emptiest bins into the other underfull ones, while bins can still be saved."""
        least, count = -(-int(self.sizes.sum()) // self.capacity), int((self.fill > 0).sum())
        stuck = np.zeros(len(self.fill), bool)
        while count > least:
            emptiest = np.argsort(np.where(self.fill > 0, self.fill, self.capacity + 1), kind="stable")[: self.BREADTH].tolist()
            b = next((b for b in emptiest if 0 < self.fill[b] < self.capacity and not stuck[b]), None)
            if b is None:
                break
            other = self._improve(b)
            if other is None:
                stuck[b] = True
            elif self.fill[b]:
                stuck[[b, other]] = False
            else:
                count -= 1
                stuck[:] = False


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """A container number for each item, numbered from 0 without gaps; no size may exceed the capacity."""
    bins = Bins(np.asarray(sizes, np.int64), capacity)
    bins.first_pass()
    bins.search()
    return np.unique(bins.bin, return_inverse=True)[1] if len(bins.bin) else bins.bin


def packed(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start_token, n_tokens, container_id)``: every text in containers of ``capacity`` tokens.

    A text is whole (piece 0) unless it alone exceeds the capacity; then it is
    cut into pieces of the capacity and a rest. An empty or null text is an
    item of no tokens; repeated rows are items of their own; a null key stays
    null. container_id is '<group>-<number>'.
    """
    sizes = encoded(documents, [key], text, vocabulary).select(key, F.size("ids").alias("n"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(capacity))
    items = sizes.select(key, "n", F.posexplode(starts).alias("piece", "start_token"))
    items = written(items.select(key, "piece", "start_token", F.least(F.col("n") - F.col("start_token"), F.lit(capacity)).alias("n_tokens")), "items")
    total = items.agg(F.sum("n_tokens")).first()[0] or 0
    groups = max(1, round(total / capacity / GROUP_CONTAINERS))
    kind = documents.schema[key].dataType.simpleString()

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        group = pdf["group"].iloc[0]
        at = pack(pdf["n_tokens"].to_numpy(), capacity)
        return pdf.drop(columns="group").assign(container_id=[f"{group}-{i}" for i in at])

    spread = items.withColumn("group", F.pmod(F.xxhash64(key, "piece", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    # A group costs seconds, whatever its bytes: as many partitions as groups, which are not joined again.
    return spread.repartition(groups, "group").groupBy("group").applyInPandas(fill, f"`{key}` {kind}, piece int, start_token int, n_tokens int, container_id string")


def fill(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(items, tokens, containers, least, fill)`` of :func:`packed`: containers used and needed at least, and the share of them that is filled."""
    total = assigned.agg(F.count("*").alias("items"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.count_distinct("container_id").alias("containers"))
    return total.select("*", F.ceil(F.col("tokens") / capacity).alias("least"), F.round(F.try_divide("tokens", F.col("containers") * capacity), 6).alias("fill"))
