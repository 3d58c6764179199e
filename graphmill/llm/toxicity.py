"""Toxicity by a subsequence-kernel support vector machine with Nyström landmarks.

Learning takes labelled documents that are not held out, in order of a hash of their id (``sampled``). Its
bounds, all parameters of ``score``: ``DOCS`` ids of each label; ``SENTENCES`` sentences of each label;
``TOXIC_MARKS`` landmarks from telling words and ``CLEAN_MARKS`` from clean ones, and of hard words twice as many
as the latter a round; ``HARD`` hard words a round; ``ROUNDS`` rounds. Fixed: telling words are ten times
``TOXIC_MARKS`` at most, in ``LEAST`` toxic documents and ``RATIO`` times as frequent there; the alphabet has 62
letters and digits; landmarks are read to ``subsequence.WIDTH`` signs. Every document is scored.

Counts of words over the learning documents find words that toxic ones use far more often; the strongest become
landmarks, next to words of clean sentences. Sentences of toxic documents that hold such a word are positive, sentences of clean documents
negative. A sentence is as toxic as its worst word: the machine is trained on one word of each, the most
telling one for a positive and the worst one so far for a negative sentence, twice over. Gaps and inserted
signs inside a word cost the kernel little; letters set apart by blanks are read as one word.

Every document is then read whole. Its worst word, how many words are toxic and their share are turned into a
score between 0 and 1 by a logistic fit on the learning documents. Each different word is judged once per task.

Null and empty text is scored like any other text without toxic words. Where either label is missing
from the learning rows, all scores are 0. Labels that contradict each other count as toxic, null labels not
at all. A null id counts as empty text in the split. Repeated rows are scored alike; other columns are ignored;
an empty table gives no rows. Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import drop, slices, text_bytes, write
from graphmill.llm.subsequence import LENGTH, Alphabet, Machine

FOLDS, HELD_OUT = 5, 0
#: Learning documents of each label; sentences of each label; landmarks from toxic and from clean words.
DOCS, SENTENCES, TOXIC_MARKS, CLEAN_MARKS = 10_000, 20_000, 96, 32
#: A telling word is in at least so many toxic documents, and so much more often than in clean ones.
LEAST, RATIO = 3, 10.0
#: Hard clean words that are gathered between rounds of training.
HARD, ROUNDS = 5000, 3
#: Different words that a task remembers.
HELD = 1 << 20
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
ENDS = re.compile(r"(?<=[.!?])\s+|\n+")
EDGE = " "
EDGES = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())


def words_of(text: str) -> list[str]:
    """Lower case words; letters set apart by single blanks are one word more."""
    low = text.lower()
    words = low.split()
    return words + [m[0] for m in SPACED.finditer(low)]


def bare(word: str) -> str:
    return word.strip(EDGES)


def edged(word: str) -> str:
    """The word with its edges marked, so that where a subsequence stands in it counts."""
    return EDGE + bare(word) + EDGE if word else ""


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def sampled(docs: DataFrame, labels: DataFrame, most: int = DOCS) -> DataFrame:
    """toxic and text of the learning documents."""
    told = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    told = told.where(fold(F.col("doc_id")) != HELD_OUT)
    told = told.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), "doc_id")
    picked = [told.where(F.col("toxic") == label).orderBy(*order).limit(most) for label in (0, 1)]
    # Two times ``most`` rows of an id and a label.
    return docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").select("toxic", "text")


def _word_counts(sample: DataFrame) -> DataFrame:
    """Documents of each label that hold a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for label, text in zip(batch.column("toxic").to_pylist(), text_bytes(batch), strict=True):
                for word in {bare(w) for w in words_of(text.decode())}:
                    counts[word][label] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in (0, 1))],
                names=["word", "clean", "toxic"],
            )

    parts = sample.mapInArrow(run, "word string, clean long, toxic long")
    return parts.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _sentences(sample: DataFrame, telling: dict[str, float]) -> DataFrame:
    """Label, a random number and the words of each sentence; of toxic documents only those with a telling word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for label, text in zip(batch.column("toxic").to_pylist(), text_bytes(batch), strict=True):
                for sentence in ENDS.split(text.decode()):
                    words = sorted({bare(w) for w in words_of(sentence)})
                    if label and not any(w in telling for w in words):
                        continue
                    rows.append((label, [w for w in words if len(w) >= LENGTH]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.list_(pa.string()))],
                names=["toxic", "words"],
            )

    return sample.mapInArrow(run, "toxic int, words array<string>")


def _telling(counts: DataFrame, clean: int, toxic: int, most: int) -> dict[str, float]:
    """Words of toxic documents and the logarithm of how much more often these use them; the strongest by weight of use."""
    rate = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    strong = counts.where((F.col("toxic") >= LEAST) & (F.length("word") >= LENGTH)).withColumn("rate", rate)
    strong = strong.where(F.col("rate") >= RATIO).withColumn("weight", F.col("toxic") * F.log("rate"))
    rows = strong.orderBy(F.desc("weight"), "word").limit(most).collect()
    return {r["word"]: float(np.log(r["rate"])) for r in rows}


def _alphabet(words: list[str]) -> Alphabet:
    """The letters and digits that the landmarks and sentences use most."""
    counts: dict[str, int] = defaultdict(int)
    for word in words:
        for sign in word:
            if sign.isalnum():
                counts[sign] += 1
    return Alphabet(EDGE + "".join(sorted(sorted(counts, key=lambda s: (-counts[s], s))[:62])))


def _hard(sample: DataFrame, machine, telling: dict[str, float], most: int = HARD) -> dict[str, int]:
    """Words of clean documents that the machine takes for toxic or nearly so, and in how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(machine.value)
        for batch in slices(batches):
            found = reader.near([t for t in text_bytes(batch)])
            words = [w for ws in found for w in ws if w not in telling]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["word"])

    words = sample.where("toxic = 0").mapInArrow(run, "word string").groupBy("word").count()
    rows = words.orderBy(F.desc("count"), "word").limit(most).collect()
    return {r["word"]: r["count"] for r in rows}


def learn(
    sample: DataFrame,
    sentences: int = SENTENCES,
    toxic_marks: int = TOXIC_MARKS,
    clean_marks: int = CLEAN_MARKS,
    hard_words: int = HARD,
    rounds: int = ROUNDS,
):
    """The machine, or None where a label or all telling words are missing."""
    context = sample.sparkSession.sparkContext
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return None
    telling = _telling(_word_counts(sample), sizes[0], sizes[1], 10 * toxic_marks)
    if not telling:
        return None
    rows = _sentences(sample, telling).withColumn("key", F.xxhash64("words"))
    rows = rows.where(F.size("words") > 0)
    picked = [
        rows.where(F.col("toxic") == label).orderBy("key", "words").limit(sentences).select("words").collect()
        for label in (0, 1)
    ]
    clean, toxic = ([r["words"] for r in x] for x in picked)
    if not clean or not toxic:
        return None
    # The most telling word of a positive sentence; any word of a negative one, and later those that are hard to tell.
    positive = Counter(max(s, key=lambda w: (telling.get(w, 0), w)) for s in toxic)
    negative = Counter(w for s in clean for w in s)
    alphabet = _alphabet([*negative, *telling])
    toxic_words = list(telling)[:toxic_marks]
    marks = toxic_words + sorted(negative, key=lambda w: (-negative[w], w))[:clean_marks]
    for turn in range(rounds):
        words = [*positive, *negative]
        y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
        weight = np.r_[
            np.array(list(positive.values())) / positive.total(), np.array(list(negative.values())) / negative.total()
        ]
        machine = Machine(alphabet, [edged(w) for w in marks], [edged(w) for w in words], y, np.sqrt(weight))
        if turn + 1 < rounds:
            hard = _hard(sample, context.broadcast(machine), telling, hard_words)
            negative.update({w: 5 * n for w, n in hard.items()})
            marks += [w for w in sorted(hard, key=lambda w: (-hard[w], w)) if w not in marks][: 2 * clean_marks]
    return machine


class Reader:
    """What the machine finds in whole texts; remembers the words it has judged."""

    def __init__(self, machine: Machine) -> None:
        self.machine, self.known = machine, {}

    def judged(self, texts: list[bytes]) -> list[list[str]]:
        """The words of each text, all of them known."""
        words = [words_of(t.decode()) for t in texts]
        new = list({w for ws in words for w in ws if w not in self.known})
        if len(self.known) + len(new) > HELD:
            self.known = {}
            new = list({w for ws in words for w in ws})
        self.known.update(zip(new, self.machine.judge([edged(w) for w in new]).tolist(), strict=True))
        return words

    def near(self, texts: list[bytes], floor: float = -0.4) -> list[set[str]]:
        known = self.known
        return [{bare(w) for w in ws if known[w] > floor} for ws in self.judged(texts)]

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Per text: its worst word, the logarithm of toxic words, of different ones, and of their share."""
        words = self.judged(texts)
        out = np.zeros((len(texts), 4))
        for row, ws in enumerate(words):
            found = np.fromiter(map(self.known.__getitem__, ws), float, len(ws))
            toxic = np.flatnonzero(found > 0)
            worst = found.max() if len(ws) else -1.0
            different = len({ws[i] for i in toxic.tolist()})
            out[row] = np.clip(worst, -1, 2), np.log1p(len(toxic)), np.log1p(different), len(toxic) / (len(ws) + 20)
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights and bias (last) by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _features(sample: DataFrame, machine) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(machine.value)
        for batch in slices(batches):
            x = reader.features(text_bytes(batch))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *map(pa.array, x.T)], names=["toxic", *"abcd"])

    rows = sample.mapInArrow(run, "toxic int, a double, b double, c double, d double").toPandas()
    return rows[list("abcd")].to_numpy(float), rows["toxic"].to_numpy(float)


def score(
    docs: DataFrame,
    labels: DataFrame,
    most: int = DOCS,
    sentences: int = SENTENCES,
    toxic_marks: int = TOXIC_MARKS,
    clean_marks: int = CLEAN_MARKS,
    hard_words: int = HARD,
    rounds: int = ROUNDS,
) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    spark = docs.sparkSession
    path = write(sampled(docs, labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")), most), "labelled")
    sample = spark.read.parquet(path)
    machine, fit = learn(sample, sentences, toxic_marks, clean_marks, hard_words, rounds), None
    if machine is not None:
        machine = spark.sparkContext.broadcast(machine)
        fit = logistic(*_features(sample, machine))
    drop(spark, path)
    rows = docs.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(machine.value) if machine is not None else None
        for batch in slices(batches):
            if reader is None:
                found = np.zeros(batch.num_rows)
            else:
                x = np.column_stack([reader.features(text_bytes(batch)), np.ones(batch.num_rows)])
                found = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
