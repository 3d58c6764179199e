"""Periodic runs of words: stretches that repeat one block four times or more.

A run is a stretch of consecutive words with smallest period q, of at least ``times`` periods and
``least`` words, that no neighbouring word extends. Words are what ASCII white space parts.

* Periods below ``DIRECT`` are found by comparing the words with themselves at each lag.
* Longer periods are found per scale, [2^s, 2^(s+1)), from minimizers: the smallest hash among the
  2^(s-1)-word grams of every window of 2^(s-1) places. Inside a run they repeat at period distance, so
  a run holds two equal ones exactly one period apart. Equal minimizers closer than half a gram belong
  to a shorter period; only the first of such a chain is paired, which leaves a few pairs for each.
* Each pair is a seed (place, lag), extended both ways word by word to a maximal stretch. Seeds that
  lie in a stretch of their lag are skipped, so a run is walked once for each of its few lags.
* A stretch that two lags give is one run; the smaller lag is its period.

Four periods leave room for a whole period of places whose windows all lie inside the run; that is why
``times`` may not be smaller. Words are compared by numbers given per slice of texts, not by hashes, so
results are exact. The texts of a slice are searched as one sequence with a sign of its own between
each two, so short texts cost no more than long ones.

Null and empty texts have no words and no runs; a text is never cut. Repeated rows are judged alike,
each by itself, null ids included; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from graphmill.llm.common import ODD, mixed, slices, sliding, text_bytes

LEAST, TIMES = 6, 4
#: Periods below this are looked for lag by lag; a power of two.
DIRECT = 16
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _direct(ids: np.ndarray, lag: int, need: int) -> np.ndarray:
    """Stretches (start, end, lag) in which words a lag apart agree, of ``need`` words at least."""
    same = np.flatnonzero(ids[lag:] == ids[:-lag])
    if not len(same):
        return np.zeros((0, 3), np.int64)
    cut = np.flatnonzero(np.diff(same) > 1)
    first, last = same[np.r_[0, cut + 1]], same[np.r_[cut, len(same) - 1]]
    long = last + 1 + lag - first >= need
    return np.stack([first[long], last[long] + 1 + lag, np.full(int(long.sum()), lag)], axis=1)


def _seeds(gram: np.ndarray, k: int, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags of pairs of equal minimizers of one text, the lags in [2k, 4k)."""
    least = sliding(gram, k)
    edge = np.zeros(k - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), k, np.maximum) == gram)
    at = at[np.lexsort((at, gram[at]))]
    g = gram[at]
    chained = (g[1:] == g[:-1]) & (np.diff(at) <= k // 2)
    lonely = np.r_[True, g[1:] != g[:-1]] & np.r_[g[1:] != g[:-1], True]
    first = np.flatnonzero(~np.r_[False, chained] & ~lonely)
    at, g = at[first], g[first]
    places, lags = [at[:0]], [at[:0]]
    for step in range(1, 9):  # firsts of one gram are more than k / 2 apart
        if len(at) <= step:
            break
        lag = at[step:] - at[:-step]
        good = (g[step:] == g[:-step]) & (lag >= 2 * k) & (lag < 4 * k) & (text[at[step:]] == text[at[:-step]])
        places.append(at[:-step][good])
        lags.append(lag[good])
    return np.concatenate(places), np.concatenate(lags)


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading items of both are equal."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        apart = np.flatnonzero(a[at : min(at + step, n)] != b[at : min(at + step, n)])
        if len(apart):
            return at + int(apart[0])
        at, step = at + step, 2 * step
    return n


def _extended(ids: np.ndarray, places: np.ndarray, lags: np.ndarray, need: Callable[[int], int]) -> list:
    """The maximal stretches around the seeds that are long enough."""
    found, lag, done = [], 0, 0
    order = np.lexsort((places, lags))
    for x, d in zip(places[order].tolist(), lags[order].tolist(), strict=True):
        if d != lag:
            lag, done = d, 0
        if x < done:
            continue
        right = x + _reach(ids[x : len(ids) - d], ids[x + d :])
        left = x - _reach(ids[:x][::-1], ids[d : x + d][::-1])
        done = right
        if right + d - left >= need(d):
            found.append((left, right + d, d))
    return found


def runs_of(ids: np.ndarray, text: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Runs (start, length, period) of a sequence of word numbers, by start, then period.

    ``text`` tells which text a place belongs to; between texts stands a number that occurs once.
    """
    if times < 4:
        raise ValueError("runs of fewer than four periods may hold no pair of minimizers")

    def need(period: int) -> int:
        return max(least, times * period)

    longest = int(np.bincount(text).max()) if len(text) else 0
    found = [_direct(ids, lag, need(lag)) for lag in range(1, min(DIRECT, longest // times + 1))]
    k = DIRECT // 2
    if 2 * k * times <= longest:
        gram, size = mixed(ids.astype(np.uint64), 1), 1
        while 2 * k * times <= longest:
            while size < k:
                gram = mixed(gram[:-size] * ODD + gram[size:])
                size *= 2
            seeds = _seeds(gram, k, text)
            found.append(np.array(_extended(ids, *seeds, need), np.int64).reshape(-1, 3))
            k *= 2
    runs = np.concatenate([*found, np.zeros((0, 3), np.int64)])
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.r_[True, (np.diff(runs[:, :2], axis=0) != 0).any(axis=1)] if len(runs) else np.zeros(0, bool)
    runs = runs[new]
    runs = np.stack([runs[:, 0], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _listed(runs: np.ndarray, ends: np.ndarray) -> pa.Array:
    fields = [pa.array(runs[:, i]) for i in range(3)]
    items = pa.StructArray.from_arrays(fields, names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), items)


def find_runs(
    docs: DataFrame,
    least: int = LEAST,
    times: int = TIMES,
    change: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """doc_id, its ``runs`` and ``collapsed``, the words that stay when of each run only the first period does.

    ``change`` may replace the words of a text, given its doc_id, before they are searched.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [t.split() for t in text_bytes(batch)]
            if change:
                words = [change(i, w) for i, w in zip(batch.column("doc_id").to_pylist(), words, strict=True)]
            sizes = np.array([len(w) for w in words], np.int64)
            starts = np.cumsum(sizes + 1) - sizes - 1
            known: dict[bytes, int] = {}
            ids = np.full(int(sizes.sum()) + len(words), -1, np.int64)
            for at, ws in zip(starts.tolist(), words, strict=True):
                ids[at : at + len(ws)] = [known.setdefault(w, len(known)) for w in ws]
            between = starts + sizes
            ids[between] = len(known) + np.arange(len(words))
            text = np.repeat(np.arange(len(words)), sizes + 1)
            runs = runs_of(ids, text, least, times)
            drop = np.zeros(len(ids) + 1, np.int64)
            np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
            np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
            stay = np.cumsum(drop)[:-1] == 0
            row = text[runs[:, 0]]
            runs[:, 0] -= starts[row]
            held = np.bincount(row, minlength=len(words))
            kept = []
            for r, (at, ws) in enumerate(zip(starts.tolist(), words, strict=True)):
                if held[r]:
                    ws = [w for w, s in zip(ws, stay[at : at + len(ws)].tolist(), strict=True) if s]
                kept.append(b" ".join(ws))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    _listed(runs, np.cumsum(held)),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "runs", "collapsed"],
            )

    narrow = docs.select("doc_id", "text")
    rest = StructType.fromDDL(f"runs {RUNS}, collapsed string").fields
    return narrow.mapInArrow(run, StructType([StructField("doc_id", narrow.schema["doc_id"].dataType), *rest]))


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; ties go to the first; null where there is none."""
    return F.reduce(
        runs,
        F.get(runs, F.lit(0)),
        lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a),
    )


def collapsed(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The same rows and columns; texts that hold runs keep the first period of each, null reads as empty."""
    others = F.struct(*[c for c in docs.columns if c != "text"])
    found = find_runs(docs.select(others.alias("doc_id"), "text"), least, times)
    return found.select(*[F.col("collapsed" if c == "text" else f"doc_id.{c}").alias(c) for c in docs.columns])
