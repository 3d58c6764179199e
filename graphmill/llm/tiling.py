"""Greedy string tiling of a pattern and several texts.

The longest common run of words that are not marked yet becomes a tile and is marked in both, again
and again, until no common run of ``least`` words is left. Runs are found by Karp-Rabin hashes of a
search length that starts long and is halved, so that long tiles are marked before short runs are
looked for at all. Order does not matter: a passage whose sentences were shuffled is tiled as well.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

MODULUS, BASE = (1 << 61) - 1, 1_000_003


def rolling(codes: list[int], size: int, marked: bytearray) -> list[tuple[int, int]]:
    """Hash and start of every run of ``size`` unmarked codes."""
    out, value, clean = [], 0, 0
    top = pow(BASE, size, MODULUS)
    for i, code in enumerate(codes):
        value = (value * BASE + code) % MODULUS
        if i >= size:
            value = (value - codes[i - size] * top) % MODULUS
        clean = 0 if marked[i] else clean + 1
        if clean >= size:
            out.append((value, i - size + 1))
    return out


def tiles(pattern: list, texts: list[list], least: int) -> list[tuple[int, int, int, int]]:
    """Tiles as (length, place in pattern, number of text, place in text); equal lengths from the left."""
    known: dict = {}
    codes = [known.setdefault(w, len(known) + 1) for w in pattern]
    others = [[known.setdefault(w, len(known) + 1) for w in text] for text in texts]
    done, free = bytearray(len(codes)), [bytearray(len(t)) for t in others]
    found = []
    size = max(least, len(codes))
    while len(codes) >= least:
        table = defaultdict(list)
        for value, start in rolling(codes, size, done):
            table[value].append(start)
        heap = []
        for n, text in enumerate(others):
            mark = free[n]
            for value, t in rolling(text, size, mark):
                for p in table.get(value, ()):
                    if p and t and codes[p - 1] == text[t - 1] and not done[p - 1] and not mark[t - 1]:
                        continue  # part of a run that starts earlier
                    length = 0
                    while (
                        p + length < len(codes) and t + length < len(text) and codes[p + length] == text[t + length]
                        and not done[p + length] and not mark[t + length]
                    ):
                        length += 1
                    if length >= size:
                        heap.append((-length, p, n, t))
        heapq.heapify(heap)
        while heap:
            length, p, n, t = heapq.heappop(heap)
            length = -length
            mark = free[n]
            taken = [k for k in range(length) if done[p + k] or mark[t + k]]
            if taken:  # what earlier tiles left of the run
                start = 0
                for end in [*taken, length]:
                    if end - start >= size:
                        heapq.heappush(heap, (start - end, p + start, n, t + start))
                    start = end + 1
                continue
            found.append((length, p, n, t))
            done[p : p + length] = mark[t : t + length] = b"\1" * length
        if size == least:
            break
        size = max(least, size // 2)
    return found


def coverage(pattern: list, texts: list[list], least: int) -> float:
    """The share of the pattern's words that tiles cover."""
    return sum(t[0] for t in tiles(pattern, texts, least)) / len(pattern) if pattern else 0.0
