"""External induced sorting of suffixes with common-prefix values.

The suffixes at local minima are named and sorted by recursion; from their order, one scan upwards induces the suffixes
larger than their successors and one scan downwards the others. Scans draw tuples (place, common prefix with the one
before) from queues ordered by first symbol that lie on disk beyond a bound, a block at a time as numpy arrays, and the
text and the results are memory-mapped, so a shard may be far larger than memory. Common-prefix values are carried along:
that of two neighbours that are induced into one bucket is one more than the least between their sources.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Tuples that a queue holds in memory, tuples taken at once, symbols up to which recursion ends in memory.
IN_MEMORY, BLOCK, BASE_CASE = 1 << 16, 1 << 16, 1 << 21


def mapped(n: int, kind: type) -> np.ndarray:
    """An array on disk, in a file that is gone with its last user."""
    return np.asarray(np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(max(1, n),)))[:n]


class BucketQueue:
    """A priority queue of tuples (place, common prefix) by first symbol; equal symbols leave in the order they came.

    Tuples beyond `limit` are written out, in stretches by symbol.
    """

    def __init__(self, limit: int = IN_MEMORY):
        self.limit, self.held = limit, 0
        self.memory: dict[int, list[np.ndarray]] = {}
        self.disk: dict[int, list[tuple[int, int]]] = {}
        self.file = None
        self.end = 0

    def push(self, symbol: int, tuples: np.ndarray) -> None:
        self.memory.setdefault(symbol, []).append(tuples)
        self.held += len(tuples)
        if self.held > self.limit:
            self.spill()

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(self.end)
        for symbol, parts in self.memory.items():
            joined = np.concatenate(parts)
            self.file.write(joined.tobytes())
            self.disk.setdefault(symbol, []).append((self.end, len(joined)))
            self.end += joined.nbytes
        self.memory.clear()
        self.held = 0

    def pop(self, symbol: int, most: int) -> np.ndarray | None:
        """The next tuples of a symbol, `most` at most."""
        if parts := self.disk.get(symbol):
            at, n = parts.pop(0)
            if n > most:
                parts.insert(0, (at + 16 * most, n - most))
                n = most
            self.file.seek(at)
            return np.frombuffer(self.file.read(16 * n), np.int64).reshape(n, 2)
        if parts := self.memory.pop(symbol, None):
            joined = np.concatenate(parts) if len(parts) > 1 else parts[0]
            if len(joined) > most:
                self.memory[symbol] = [joined[most:]]
                joined = joined[:most]
            self.held -= len(joined)
            return joined
        return None


class _Least:
    """Least values of ranges of an array."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least of values[a..b], both included."""
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), self.rows[0].dtype)
        for k in np.unique(level).tolist():
            own = level == k
            row = self.rows[k]
            out[own] = np.minimum(row[a[own]], row[b[own] - (1 << k) + 1])
        return out


class _Inducer:
    """One scan: takes sorted sources with their common prefixes and pushes their predecessors of one type."""

    def __init__(self, text: np.ndarray, smaller: np.ndarray, want_smaller: bool, depth: int, queue: BucketQueue, symbols: int):
        self.text, self.smaller, self.want, self.depth, self.queue = text, smaller, want_smaller, depth, queue
        self.least = np.zeros(symbols, np.int64)  # since the last push to a bucket, within the bucket being scanned
        self.when = np.full(symbols, -1, np.int64)
        self.begun = np.zeros(symbols, bool)
        self.now, self.narrow = -1, symbols <= 1 << 16

    def bucket(self, symbol: int) -> None:
        self.now = symbol
        self.touched = np.zeros(0, np.int64)

    def scan(self, places: np.ndarray, common: np.ndarray) -> None:
        """common[i]: with the source before; 0 for the first source of the bucket."""
        before = places - 1
        ok = before >= 0
        ok[ok] = self.smaller[before[ok]] == self.want
        r = np.flatnonzero(ok)
        j = before[r]
        to = self.text[j].astype(np.int64)
        order = np.argsort(to.astype(np.uint16) if self.narrow else to, kind="stable")
        r, j, to = r[order], j[order], to[order]
        head = np.ones(len(r), bool)
        head[1:] = to[1:] != to[:-1]
        own, rest = np.flatnonzero(head), np.flatnonzero(~head)
        x = to[own]
        lcp = np.zeros(len(r), np.int64)
        if len(rest):
            lcp[rest] = 1 + _Least(common).between(r[rest - 1] + 1, r[rest])
        # the first push to a bucket looks back to the last one from an earlier block of the same sources
        since = np.minimum(np.where(self.when[x] == self.now, self.least[x], 0), np.minimum.accumulate(common)[r[own]])
        lcp[own] = np.where(self.begun[x], 1 + since, 0)
        if len(self.touched):
            self.least[self.touched] = np.minimum(self.least[self.touched], common.min())
        if not len(r):
            return
        np.minimum(lcp, self.depth, out=lcp)
        ends = np.append(own[1:], len(r))
        tail = np.append(np.minimum.accumulate(common[::-1])[::-1][1:], self.depth)
        self.least[x] = tail[r[ends - 1]]
        self.touched = np.union1d(self.touched, x)
        self.begun[x], self.when[x] = True, self.now
        tuples = np.stack([j, lcp], 1)
        for a, b, s in zip(own.tolist(), ends.tolist(), x.tolist(), strict=True):
            self.queue.push(s, tuples[a:b])


def _run(text: np.ndarray, at: int, depth: int) -> int:
    """How often the symbol at a place is repeated from there on."""
    other = text[at : at + depth] != text[at]
    return int(other.argmax()) if other.any() else len(other)


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one, the least of all, counts as smaller."""
    n = len(text)
    out = np.asarray(mapped(n, bool))
    carry = True
    for end in range(n, 0, -BLOCK * 16):
        at = max(0, end - BLOCK * 16)
        part = np.asarray(text[at : min(end + 1, n)]).astype(np.int64)
        if end == n:
            part = np.append(part, -1)
        step = np.sign(part[1:] - part[:-1])
        place = np.where(step != 0, np.arange(len(step)), len(step))
        next_ = np.minimum.accumulate(place[::-1])[::-1]
        out[at:end] = np.where(next_ < len(step), step[np.minimum(next_, len(step) - 1)] > 0, carry)
        if end == n:
            out[n - 1] = True
            # equal symbols before the end follow the last real step, and the sentinel is unique
        carry = bool(out[at])
    return out


def _doubled(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Base case in memory: ranks of prefixes of doubled length; common prefixes from the ranks of all lengths."""
    n = len(text)
    order = np.argsort(text)
    first = np.ones(n, bool)
    first[1:] = text[order[1:]] != text[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
    levels, h = [rank], 1
    while h < depth:
        alike = ~first
        alike[:-1] |= ~first[1:]
        where = np.flatnonzero(alike)  # places in order that aren't settled
        if not len(where):
            break
        own = order[where]
        beyond = own + h < n
        key = rank[own] * (n + 2)
        key[beyond] += rank[own[beyond] + h] + 1
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[where] = own
        new = np.ones(len(own), bool)
        new[1:] = key[1:] != key[:-1]
        first[where] = new
        rank = rank.copy()
        rank[own] = where[np.flatnonzero(new)][np.cumsum(new) - 1]
        levels.append(rank)
        h *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = levels[level][a[inside]] == levels[level][b[inside]]
        step = np.where(same, 1 << level, 0)
        lcp[1:] += step
        a, b = a + step, b + step
    return order, np.minimum(lcp, depth)


def _names(text: np.ndarray, smaller: np.ndarray, minima: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the stretches between local minima, by their symbols and types; how many differ."""
    m = len(minima)
    length = np.append(np.diff(minima) + 1, 1)
    bits = int(2 * int(text.max()) + 3).bit_length()
    per = max(1, 62 // bits)
    rank = np.zeros(m, np.int64)
    active, at = np.arange(m), 0
    while len(active):
        key = np.zeros(len(active), np.int64)
        for k in range(per):
            inside = length[active] > at + k
            place = minima[active[inside]] + at + k
            key <<= bits
            key[inside] |= 2 * text[place].astype(np.int64) + smaller[place] + 1
        order = np.lexsort((key, rank[active])) if at else np.argsort(key, kind="stable")
        own, k, r = active[order], key[order], rank[active[order]]
        group = np.ones(len(own), bool)
        group[1:] = r[1:] != r[:-1]
        new = group.copy()
        new[1:] |= k[1:] != k[:-1]
        first, sub = np.flatnonzero(group), np.flatnonzero(new)
        begin = first[np.cumsum(group) - 1]
        part = sub[np.cumsum(new) - 1]
        rank[own] = r + (part - begin)
        sizes = np.diff(np.append(sub, len(own)))
        alike = np.repeat(sizes > 1, sizes)
        at += per
        active = own[alike & (length[own] > at)]
    used = np.unique(rank, return_inverse=True)
    return used[1].astype(np.int32), len(used[0])


def suffixes(text: np.ndarray, depth: int, base_case: int = BASE_CASE, limit: int = IN_MEMORY, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first `depth` symbols, and the common prefix of each with the one before, up to depth.

    The last symbol must be smaller than all others and occur once. Equal suffixes (to that depth) come in any order.
    """
    n = len(text)
    if n <= 2:
        return np.arange(n - 1, -1, -1), np.zeros(n, np.int64)
    smaller = _types(text)
    minima = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    names, different = _names(text, smaller, minima)
    if different == len(minima):
        order = np.empty(len(minima), np.int64)
        order[names] = np.arange(len(minima))
        shared = np.zeros(len(minima), np.int64)
    elif len(minima) <= base_case:
        order, shared = _doubled(names, depth // 2 + 1)
    else:
        order, shared = suffixes(names, depth // 2 + 1, base_case, limit, block)
    # common prefixes in symbols: whole stretches, then symbol by symbol
    ends = np.append(minima, n)
    common = np.zeros(len(minima), np.int64)
    x, y = minima[order[:-1]], minima[order[1:]]
    known = np.minimum(ends[np.minimum(order[1:] + shared[1:], len(minima))] - y, depth)
    live = np.arange(len(x))
    while len(live):
        p, q = x[live] + known[live], y[live] + known[live]
        live = live[(known[live] < depth) & (p < n) & (q < n)]
        p, q = x[live] + known[live], y[live] + known[live]
        live = live[text[p] == text[q]]
        known[live] += 1
    common[1:] = known
    sorted_minima = minima[order]

    counts = np.bincount(text)
    seeds = np.bincount(text[minima], minlength=len(counts))
    start = np.concatenate([[0], np.cumsum(counts)])
    seed_at = np.concatenate([[0], np.cumsum(seeds)])
    out, lcp, larger = mapped(n, np.int64), mapped(n, np.int32), np.zeros(len(counts), np.int64)
    symbols = np.flatnonzero(counts).tolist()

    queue = BucketQueue(limit)
    up = _Inducer(text, smaller, False, depth, queue, len(counts))
    for c in symbols:
        up.bucket(c)
        at = int(start[c])
        while (t := queue.pop(c, block)) is not None:
            out[at : at + len(t)], lcp[at : at + len(t)] = t[:, 0], t[:, 1]
            at += len(t)
            up.scan(t[:, 0], t[:, 1])
        larger[c] = at - start[c]
        for a in range(int(seed_at[c]), int(seed_at[c + 1]), block):
            b = min(a + block, int(seed_at[c + 1]))
            own, values = sorted_minima[a:b], common[a:b].copy()
            if a == seed_at[c]:
                values[0] = min(_run(text, int(out[at - 1]), depth), _run(text, int(own[0]), depth)) if larger[c] else 0
            up.scan(own, values)

    queue = BucketQueue(limit)
    down = _Inducer(text, smaller, True, depth, queue, len(counts))
    for c in reversed(symbols):
        down.bucket(c)
        at = int(start[c + 1])
        last = None
        if c == symbols[0]:  # the least suffix of all is the last symbol alone
            out[0], lcp[0] = n - 1, 0
            break
        while (t := queue.pop(c, block)) is not None:
            k = np.arange(at - 1, at - 1 - len(t), -1)
            out[k] = t[:, 0]
            inner = k + 1 < start[c + 1]
            lcp[k[inner] + 1] = t[inner, 1]
            at -= len(t)
            last = int(t[-1, 0])
            down.scan(t[:, 0], t[:, 1])
        high = int(start[c] + larger[c])
        seam = 0
        if last is not None:
            if larger[c]:
                seam = min(_run(text, last, depth), _run(text, int(out[high - 1]), depth))
            lcp[at] = seam
        for b in range(high, int(start[c]), -block):
            a = max(int(start[c]), b - block)
            own = np.asarray(out[a:b])[::-1]
            values = np.empty(b - a, np.int64)
            values[0] = seam if b == high else lcp[b]
            values[1:] = lcp[a + 1 : b][::-1]
            down.scan(own, values)
    return out, lcp
