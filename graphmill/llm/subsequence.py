"""A gap-weighted subsequence kernel on words, and a support vector machine on Nyström features of it.

Two words are alike as they share subsequences of three letters; a subsequence counts ``GAP`` to the power
of the span it takes, so letters in between cost a little and never hide it. Signs that are no letters take
up room but match nothing. The kernel is normalised to 1 for a word with itself.

The machine's decision is a sum over landmarks of weighted kernels. Since each kernel is a product over
subsequences, the sum is folded into one weight per subsequence, and a word is judged by looking up its own
subsequences, without visiting the landmarks.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations

import numpy as np

LENGTH, GAP = 3, 0.7
#: Longer words are read in overlapping windows of this many signs, half of it apart.
WIDTH = 24
#: Words that are compared with the landmarks at a time.
ROWS = 1 << 12


class Alphabet:
    """Letters to numbers from 1; all other signs are 0."""

    def __init__(self, letters: str) -> None:
        self.size = len(letters) + 1
        self.table = np.zeros(0x110000, np.int64)
        for n, sign in enumerate(letters):
            self.table[ord(sign)] = n + 1

    def rows(self, words: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length: places in ``words`` and the codes of words, or of windows of long words."""
        found: dict[int, tuple[list, list]] = {}
        for n, word in enumerate(words):
            starts = range(0, max(1, len(word) - WIDTH // 2), WIDTH // 2) if len(word) > WIDTH else (0,)
            for s in starts:
                part = word[s : s + WIDTH]
                place, parts = found.setdefault(len(part), ([], []))
                place.append(n)
                parts.append(part)
        out = {}
        for size, (place, parts) in found.items():
            if size:
                codes = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4").reshape(-1, size)
                out[size] = np.array(place), self.table[codes]
        return out


def self_kernel(codes: np.ndarray, length: int = LENGTH, gap: float = GAP) -> np.ndarray:
    """The kernel of each row with itself, before normalising."""
    n, size = codes.shape
    same = (codes[:, :, None] == codes[:, None, :]) & (codes[:, :, None] > 0)
    before = np.ones((n, size + 1, size + 1))
    for _ in range(length - 1):
        after = np.zeros((n, size + 1, size + 1))
        for i in range(1, size + 1):
            run = np.zeros(n)
            for j in range(1, size + 1):
                run = gap * run + gap * gap * same[:, i - 1, j - 1] * before[:, i - 1, j - 1]
                after[:, i, j] = gap * after[:, i - 1, j] + run
        before = after
    return gap * gap * (same * before[:, :-1, :-1]).sum(axis=(1, 2))


class Weights:
    """Values (one or a row of them) of triples of letters; triples without one share a row of zeros."""

    def __init__(self, values: np.ndarray, index: np.ndarray | None = None) -> None:
        self.values, self.index = values, index

    def of(self, triples: np.ndarray) -> np.ndarray:
        return self.values[triples if self.index is None else self.index[triples]]


def weighted(codes: np.ndarray, weights: Weights, base: int, gap: float = GAP) -> np.ndarray:
    """For each row, the sum over its subsequences of their gap weight times their value."""
    n, size = codes.shape
    out = np.zeros((n, *weights.values.shape[1:]))
    for i, j in combinations(range(size), 2):
        head = (codes[:, i] * base + codes[:, j]) * base
        for k in range(j + 1, size):
            out += gap ** (k - i + 1) * weights.of(head + codes[:, k])
    return out


def subsequences(word: str, alphabet: Alphabet) -> dict[int, float]:
    """The normalised features of one word: its triples of letters and their gap weights."""
    out: dict[int, float] = defaultdict(float)
    for _, codes in alphabet.rows([word[:WIDTH]]).values():
        for i, j, k in combinations(range(codes.shape[1]), LENGTH):
            a, b, c = codes[0, i], codes[0, j], codes[0, k]
            if a and b and c:
                out[int((a * alphabet.size + b) * alphabet.size + c)] += GAP ** (k - i + 1)
    norm = sum(v * v for v in out.values()) ** 0.5
    return {triple: v / norm for triple, v in out.items()}


def marked(words: list[str], alphabet: Alphabet) -> Weights:
    """One column of features for each word; only triples that occur take a row."""
    columns = [subsequences(w, alphabet) for w in words]
    known = sorted({t for c in columns for t in c})
    index = np.zeros(alphabet.size**LENGTH, np.int32)
    index[known] = np.arange(1, len(known) + 1)
    values = np.zeros((len(known) + 1, len(words)))
    for n, column in enumerate(columns):
        values[index[list(column)], n] = list(column.values())
    return Weights(values, index)


def kernels(words: list[str], weights: Weights, alphabet: Alphabet, step: int = ROWS) -> np.ndarray:
    """What the weights give for each word, normalised; the largest of a long word's windows."""
    out = np.full((len(words), *weights.values.shape[1:]), -np.inf)
    for size, (places, rows) in alphabet.rows(words).items():
        if size < LENGTH:
            continue
        for at in range(0, len(places), step):
            place, codes = places[at : at + step], rows[at : at + step]
            norm = np.sqrt(self_kernel(codes)).reshape(-1, *[1] * (out.ndim - 1))
            found = weighted(codes, weights, alphabet.size) / np.where(norm > 0, norm, 1)
            np.maximum.at(out, place, found)
    out[np.isneginf(out)] = 0
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-5, steps: int = 30) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by Newton's method; y is 1 or -1, the last column is the bias."""
    w, weight = np.zeros(x.shape[1]), weight / weight.sum()
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-8
    for _ in range(steps):
        slack = 1 - y * (x @ w)
        on = np.flatnonzero(slack > 0)
        square, pull = np.diag(penalty), np.zeros(len(w))
        for at in range(0, len(on), ROWS):
            rows = on[at : at + ROWS]
            part = x[rows].astype(float)
            square = square + (part * weight[rows, None]).T @ part
            pull = pull + part.T @ (weight[rows] * y[rows] * slack[rows])
        step = np.linalg.solve(square, penalty * w - pull)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Machine:
    """The decision on words: above 0 like the positive ones, below like the others."""

    def __init__(self, alphabet: Alphabet, landmarks: list[str], words: list[str], y: np.ndarray, weight: np.ndarray) -> None:
        marks = marked(landmarks, alphabet)
        values, vectors = np.linalg.eigh(marks.values.T @ marks.values)
        kept = values > 1e-6 * values.max()
        white = vectors[:, kept] / np.sqrt(values[kept])  # Nyström: kernels to landmarks become coordinates
        x = np.ones((len(words), int(kept.sum()) + 1), np.float32)
        for at in range(0, len(words), ROWS):
            x[at : at + ROWS, :-1] = kernels(words[at : at + ROWS], marks, alphabet) @ white
        w = squared_hinge(x, y, weight)
        self.alphabet, self.bias = alphabet, float(w[-1])
        self.weights = Weights((marks.values @ (white @ w[:-1]))[marks.index])

    def judge(self, words: list[str]) -> np.ndarray:
        return kernels(words, self.weights, self.alphabet) + self.bias
