"""Vectorised structural indexing of JSON texts (numpy over whole batches).

A batch of texts is laid end to end in one byte buffer. Bitmaps of quotes,
brackets and delimiters are built for the whole buffer at once; the string
mask is the parity of a prefix sum over unescaped quotes, the nesting depth a
prefix sum over brackets outside strings. Every value is then a span between
two structural characters, and navigation (members of an object, elements of
an array) is selection over the table of spans.
"""

from __future__ import annotations

import json

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True


def valid_json(text: str) -> bool:
    """Whether ``text`` is one JSON value by RFC 8259 (NaN and Infinity are none)."""

    def no(_: str) -> None:
        raise ValueError

    try:
        json.loads(text, parse_constant=no)
    except ValueError:
        return False
    except RecursionError:  # nested beyond the parser's stack: judged by its structure alone
        index = Index([text])
        return bool(len(index.open_at) and index.balanced)
    return True


class Index:
    """The structural index of a batch of valid JSON texts.

    Values are numbered; ``start``/``end`` are their spans in ``buf`` without
    the space around them, ``doc`` the text's number, ``parent`` the number of
    the value that holds it (-1 at the root), ``ord`` its position there,
    ``key_start``/``key_end`` the span of its key without quotes (0, 0 in an
    array or at the root).
    """

    def __init__(self, texts: list[str]) -> None:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        size = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
        begin = np.concatenate([[0], np.cumsum(size)])
        self.buf = buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8) if raw else np.zeros(0, np.uint8)
        n = len(buf)
        # A quote counts if an even run of backslashes stands before it.
        back = buf == 92
        where = np.arange(n)
        last = np.maximum.accumulate(np.where(back, -1, where)) if n else where
        run = np.zeros(n, np.int64)
        run[1:] = where[:-1] - last[:-1]
        quote = (buf == 34) & (run % 2 == 0)
        # Parity by prefix sum, begun anew at each text so that a broken one spoils no other.
        total = np.cumsum(quote)
        base = np.concatenate([[0], total])[begin[:-1]]
        inside = ((total - np.repeat(base, size)) % 2 == 1) | quote
        out = ~inside
        opens, closes = out & ((buf == 123) | (buf == 91)), out & ((buf == 125) | (buf == 93))
        depth = np.cumsum(opens.astype(np.int32) - closes)
        self.balanced = bool(n == 0 or (depth[-1] == 0 and depth.min() >= 0))
        structural = np.flatnonzero(opens | closes | (out & ((buf == 44) | (buf == 58))))
        kind = buf[structural]
        is_open, is_close = opens[structural], closes[structural]
        # The level that a character belongs to: its own container's.
        level = depth[structural] + is_close
        owner = np.full(len(structural), -1, np.int64)  # index into structural of the container's bracket
        order = np.argsort(level, kind="stable")
        opened = np.where(is_open[order], order, -1)
        first = np.concatenate([[0], np.flatnonzero(np.diff(level[order])) + 1]) if len(order) else np.zeros(0, np.int64)
        lift = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(order)]]))) * (len(order) + 1)
        owner[order] = np.maximum.accumulate(np.where(opened >= 0, opened + lift, lift - 1)) - lift if len(order) else 0
        close_of = np.full(len(structural), -1, np.int64)
        c = np.flatnonzero(is_close)
        close_of[owner[c]] = c
        self.open_at = structural[is_open]
        # Values end before a comma or a closing bracket of their container; in objects they begin after a colon.
        end_i = np.flatnonzero((kind == 44) | is_close)
        holder = owner[end_i]
        # Within a container: the delimiter before each end (its bracket, a comma or a colon).
        by = np.lexsort((structural, owner))
        before = np.full(len(structural), -1, np.int64)
        if len(by) > 1:
            same = owner[by][1:] == owner[by][:-1]
            before[by[1:][same]] = by[:-1][same]
        prev = before[end_i]
        start, end = structural[prev] + 1, structural[end_i]
        start, end = self._trim(start, end)
        keep = end > start  # an empty container has no value
        end_i, holder, prev, start, end = end_i[keep], holder[keep], prev[keep], start[keep], end[keep]
        in_object = kind[holder] == 123
        colon = in_object & (kind[prev] == 58)
        key_from = before[np.where(colon, prev, 0)]
        ks, ke = np.where(colon, structural[key_from] + 1, 0), np.where(colon, structural[prev], 0)
        ks, ke = self._trim(ks, ke)
        has = ke > ks
        self.key_start, self.key_end = np.where(has, ks + 1, 0), np.where(has, ke - 1, 0)
        # Position among the values of the same container.
        seq = np.lexsort((start, holder))
        new = np.concatenate([[True], np.diff(holder[seq]) != 0]) if len(seq) else np.zeros(0, bool)
        rank = np.arange(len(seq)) - np.maximum.accumulate(np.where(new, np.arange(len(seq)), 0)) if len(seq) else np.zeros(0, np.int64)
        order_ = np.empty(len(seq), np.int64)
        order_[seq] = rank
        root_start, root_end = self._trim(begin[:-1], begin[1:] - 1)
        roots = len(raw)
        self.start, self.end = np.concatenate([root_start, start]), np.concatenate([root_end, end])
        self.ord = np.concatenate([np.zeros(roots, np.int64), order_])
        self.key_start = np.concatenate([np.zeros(roots, np.int64), self.key_start])
        self.key_end = np.concatenate([np.zeros(roots, np.int64), self.key_end])
        self.doc = np.searchsorted(begin, self.start, "right") - 1
        # A container's value number, by the place of its bracket.
        number = np.full(n + 1, -1, np.int64)
        number[self.start] = np.arange(len(self.start))
        self.parent = np.concatenate([np.full(roots, -1), number[structural[holder]] if len(holder) else np.zeros(0, np.int64)])
        self.first = buf[np.minimum(self.start, n - 1)] if n else np.zeros(0, np.uint8)
        self._children = np.argsort(self.parent, kind="stable")
        self._parents = self.parent[self._children]

    def _trim(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end = start.copy(), end.copy()
        while (go := (start < end) & _SPACE[self.buf[np.minimum(start, len(self.buf) - 1)]]).any():
            start[go] += 1
        while (go := (start < end) & _SPACE[self.buf[end - 1]]).any():
            end[go] -= 1
        return start, end

    def text(self, value: int) -> str:
        return self.buf[self.start[value] : self.end[value]].tobytes().decode("utf-8", "surrogatepass")

    def key(self, value: int) -> str:
        raw = self.buf[self.key_start[value] : self.key_end[value]].tobytes()
        return json.loads(b'"' + raw + b'"', strict=False) if b"\\" in raw else raw.decode("utf-8", "surrogatepass")

    def children(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(which, child)``: the values held by each of ``values``; which is an index into ``values``."""
        lo, hi = np.searchsorted(self._parents, values, "left"), np.searchsorted(self._parents, values, "right")
        count = hi - lo
        which = np.repeat(np.arange(len(values)), count)
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return which, self._children[np.repeat(lo, count) + inner]

    def member(self, values: np.ndarray, name: str) -> np.ndarray:
        """The member ``name`` of each of ``values`` (the last, if repeated), -1 where there is none."""
        which, child = self.children(values)
        keys = self.key_end[child] - self.key_start[child]
        want = np.frombuffer(name.encode(), np.uint8)
        hit = keys == len(want)
        for i, b in enumerate(want):
            at = np.flatnonzero(hit)
            hit[at] = self.buf[self.key_start[child[at]] + i] == b
        for i in np.flatnonzero(~hit & (keys > len(want))):  # a key may be written with escapes
            k = self.buf[self.key_start[child[i]] : self.key_end[child[i]]]
            if (k == 92).any() and self.key(child[i]) == name:
                hit[i] = True
        got = np.full(len(values), -1, np.int64)
        np.maximum.at(got, which[hit], child[hit])
        return got
