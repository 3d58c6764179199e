"""Links between fingerprints of one shared bit pattern, by a hierarchical index in Gray order.

Fingerprints sorted by Gray rank differ little from their neighbours, so runs of them share many
bits. Every run of eight is a leaf; eight nodes make the node above. A node holds the bits that all
its fingerprints share (mask and pattern). Two nodes whose shared bits differ in more places than
allowed hold no link, and the whole pair of groups is dropped at once; the differences counted at a
node are part of those counted below it. Where all bits that vary in a pair of nodes are as few as
the allowed differences, everything in it is linked, and it is not opened either.

Unlike codes share few bits, so the pairs opened grow with the square of a group. Groups above ``MANY`` rows are searched
by parts instead: their free bits are cut into ``p`` parts, and of two codes within ``most`` bits one part differs in
no more than its share of ``most - p + 1``. So rows meet on a part with up to so many bits flipped, in a table of buckets,
and ``p`` is chosen for the fewest probes and pairs. Two buckets of very many rows (near copies) go to the index.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np

FAN = 8
#: Pairs of nodes that are opened at a time.
CHUNK = 1 << 15
#: Rows from which a group is searched by parts of its bits; bits of a part at most.
MANY, WIDE = 1 << 9, 20
#: Pairs of rows compared at a time, and pairs of two buckets from which the index searches them.
PAIRS, DENSE = 1 << 18, 1 << 14


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a code in the Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class Labels:
    """Smallest linked row of every row; links come in arrays."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        of = self.of
        while len(a):
            x, y = of[a], of[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            open_ = low < high
            a, b, low, high = a[open_], b[open_], low[open_], high[open_]
            if not len(a):
                return
            np.minimum.at(of, high, low)
            while True:  # roots only
                up = of[of]
                if np.array_equal(up, of):
                    break
                of[:] = up


def links(
    group: np.ndarray, codes: np.ndarray, most: int, more: tuple[np.ndarray, int] | None = None, many: int = MANY
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows and a spanning forest: in each group, rows (x, y) linked by chains of close codes.

    Returns ``order`` and index arrays ``x``, ``y`` into the ordered rows, one pair for each row
    that is not the first of its component. ``more`` holds further bits of each row (64 a column) and how
    many of them may differ in a link. Groups above ``many`` rows are searched by parts.
    """
    order = np.lexsort((gray_rank(codes), group))
    group, codes = group[order], codes[order]
    if more:
        more = more[0][order], more[1]
    n = len(codes)
    labels = Labels(n)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[first, n])
    large = np.zeros(len(first), bool)
    for i in np.flatnonzero(sizes > many):
        large[i] = _by_parts(codes, int(first[i]), int(first[i] + sizes[i]), most, labels, more)
    rank = np.arange(n) - np.repeat(first, sizes)
    # Levels from the leaves up: start row, bits all set, bits ever set, node's place in its group.
    start = np.flatnonzero(rank % FAN == 0)
    owner = np.repeat(np.arange(len(first)), sizes)[start]
    levels = [(start, np.bitwise_and.reduceat(codes, start), np.bitwise_or.reduceat(codes, start), None)]
    while len(owner) > len(first):
        head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        place = np.arange(len(owner)) - np.repeat(head, np.diff(np.r_[head, len(owner)]))
        child = np.flatnonzero(place % FAN == 0)
        below = levels[-1]
        owner = owner[child]
        levels.append(
            (below[0][child], np.bitwise_and.reduceat(below[1], child), np.bitwise_or.reduceat(below[2], child), child)
        )
    ends = [np.r_[level[0][1:], n] for level in levels]
    top = len(levels) - 1
    roots = np.flatnonzero((sizes > 1) & ~large)
    todo = [(top, roots[i : i + CHUNK], roots[i : i + CHUNK]) for i in range(0, len(roots), CHUNK)]
    while todo:
        depth, a, b = todo.pop()
        begin, every, some, child = levels[depth]
        differ = np.bitwise_count((every[a] & ~some[b]) | (~some[a] & every[b]))
        a, b = a[differ <= most], b[differ <= most]
        vary = np.bitwise_count((some[a] | some[b]) & ~(every[a] & every[b]))
        alike = vary <= most
        if more:
            alike[:] = False
        if alike.any():
            for i, j in zip(a[alike], b[alike], strict=True):
                rows = np.r_[begin[i] : ends[depth][i], begin[j] : ends[depth][j]]
                labels.link(np.full(len(rows), begin[i]), rows)
            a, b = a[~alike], b[~alike]
        if not len(a):
            continue
        if depth == 0:
            _compare(codes, begin, ends[0], a, b, most, labels, more)
            continue
        # A pair of nodes whose rows are one component already has nothing to add.
        of = labels.of
        low, high = np.minimum.reduceat(of, begin), np.maximum.reduceat(of, begin)
        open_ = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
        a, b = a[open_], b[open_]
        bound = np.r_[child, len(levels[depth - 1][0])]
        na, nb = bound[a + 1] - bound[a], bound[b + 1] - bound[b]
        pair = np.repeat(np.arange(len(a)), na * nb)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
        x, y = bound[a][pair] + nth // nb[pair], bound[b][pair] + nth % nb[pair]
        keep = x <= y
        x, y = x[keep], y[keep]
        near = np.argsort(x == y, kind="stable")  # pairs of a node with itself are opened first
        x, y = x[near], y[near]
        todo += [(depth - 1, x[i : i + CHUNK], y[i : i + CHUNK]) for i in range(0, len(x), CHUNK)]
    tied = np.flatnonzero(labels.of != np.arange(n))
    return order, tied, labels.of[tied]


def _compare(codes, begin, end, a, b, most, labels, more=None) -> None:
    """Links the rows of leaf pairs that are close."""
    wide = np.arange(FAN)
    x = (begin[a][:, None, None] + wide[None, :, None]) + 0 * wide[None, None, :]
    y = (begin[b][:, None, None] + wide[None, None, :]) + 0 * wide[None, :, None]
    real = (x < end[a][:, None, None]) & (y < end[b][:, None, None]) & (x < y)
    x, y = x[real], y[real]
    close = np.bitwise_count(codes[x] ^ codes[y]) <= most
    _link(x[close], y[close], labels, more)


def _link(x, y, labels, more) -> None:
    """Links rows with close codes if their further bits are close too."""
    if more:
        bits, limit = more
        open_ = labels.of[x] != labels.of[y]
        x, y = x[open_], y[open_]
        close = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= limit
        x, y = x[close], y[close]
    labels.link(x, y)


def _plan(rows: int, free: int, most: int) -> list[tuple[int, int]] | None:
    """Width of each part and how many of its bits are flipped, for the least work; None where the index has less."""
    best, least = None, rows * rows / 8
    for p in range(1, min(most + 1, free) + 1):
        widths = [free // p + (i < free % p) for i in range(p)]
        if widths[0] > WIDE:
            continue
        spare = most - p + 1
        plan = [(w, spare // p + (i < spare % p)) for i, w in enumerate(widths)]
        work = sum(sum(comb(w, k) for k in range(r + 1)) * (8 * rows + rows * rows / 2 ** (w + 1)) for w, r in plan)
        if work < least:
            best, least = plan, work
    return best


def _by_parts(codes, low, high, most, labels, more) -> bool:
    """Links the close rows of one group; False where the index is to search it."""
    here = codes[low:high]
    vary = int(np.bitwise_or.reduce(here) & ~np.bitwise_and.reduce(here))
    bits = [i for i in range(64) if vary >> i & 1]
    plan = _plan(high - low, len(bits), most)
    if plan is None:
        return False
    tables = []
    for width, flips in plan:
        part, bits = bits[:width], bits[width:]
        key = np.zeros(high - low, np.int64)
        for j, bit in enumerate(part):
            key |= (here >> np.uint64(bit) & np.uint64(1)).astype(np.int64) << j
        count = np.bincount(key, minlength=1 << width)
        tables.append((width, flips, np.argsort(key, kind="stable"), count, np.cumsum(count) - count))
    # Equal parts first: rows that are linked by then are not compared again where buckets are large.
    for k in range(max(flips for _, flips in plan) + 1):
        for width, flips, rows, count, start in tables:
            if k > flips:
                continue
            held, sorted_ = np.flatnonzero(count), here[rows]
            for flipped in combinations(range(width), k):
                other = held ^ sum(1 << i for i in flipped)
                met = (count[other] > 1) if not k else (held < other) & (count[other] > 0)
                u, v = held[met], other[met]
                na, nb, sa, sb = count[u], count[v], start[u], start[v]
                dense = na * nb > DENSE
                if dense.any():
                    for a, n, b, m in zip(*(x[dense].tolist() for x in (sa, na, sb, nb)), strict=True):
                        both = rows[a : a + n] if a == b else np.r_[rows[a : a + n], rows[b : b + m]]
                        _dense(codes, both + low, most, labels, more)
                    na, nb, sa, sb = (x[~dense] for x in (na, nb, sa, sb))
                ends = np.cumsum(na * nb)
                cuts = np.searchsorted(ends, np.arange(PAIRS, ends[-1], PAIRS)) if len(ends) else []
                for a, b in zip([0, *cuts], [*cuts, len(ends)], strict=True):
                    each = na[a:b] * nb[a:b]
                    pair = np.repeat(np.arange(a, b), each)
                    nth = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
                    x, y = sa[pair] + nth // nb[pair], sb[pair] + nth % nb[pair]
                    close = np.bitwise_count(sorted_[x] ^ sorted_[y]) <= most
                    x, y = x[close], y[close]
                    if not k:
                        x, y = x[x < y], y[x < y]
                    _link(rows[x] + low, rows[y] + low, labels, more)
    return True


def _dense(codes, rows, most, labels, more) -> None:
    """Links close rows of two large buckets: those outside their largest component with all, or all by the index."""
    found, counts = np.unique(labels.of[rows], return_counts=True)
    if len(found) == 1:
        return
    single = rows[labels.of[rows] != found[counts.argmax()]]
    if len(single) * len(rows) <= PAIRS:
        x, y = np.repeat(single, len(rows)), np.tile(rows, len(single))
        close = np.bitwise_count(codes[x] ^ codes[y]) <= most
        _link(x[close], y[close], labels, more)
        return
    further = (more[0][rows], more[1]) if more else None
    order, x, y = links(np.zeros(len(rows), np.int64), codes[rows], most, further, len(rows))
    labels.link(rows[order[x]], rows[order[y]])
