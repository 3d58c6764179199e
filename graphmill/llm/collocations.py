"""Collocations: frequent phrases whose words stand together more often than their parts would.

Texts are split into pieces at ``PIECES`` and those into words at blanks and tabs; A-Z reads as lower
case. Everything is counted per language (null: ``und``).

* Prefix polynomials over the word hashes of many texts at once give a fingerprint of every run of n
  words that crosses no piece. Equal ones are added up in the task, then by Spark, one n after the other (from four on together).
  A phrase can only be frequent if the phrases without its last and without its first word are, so a
  run goes to the shuffle only if both are in a bit map of the frequent ones (``BITS``, of fixed size).
* The map may let through more than it should, never less; when it fills up, more rows are shuffled and
  the result stays the same.
* A last scan meets the texts again for all lengths. Runs whose fingerprint is frequent are compared word
  by word with the first place of that fingerprint in their slice; what differs, a collision, is handed on
  for itself. Only these phrases become strings. They are counted by their own text, each with the
  smallest id of a document where it stands, so fingerprints decide what is looked at and never a count.

The score of a cut into l and r is floor(1000 * a * n / (l * r)), in decimals of 38 digits. A phrase
counts by its lowest cut (ties: the shortest first part). Candidates inside a longer candidate that is
as frequent (``share`` per cent of it) are dropped.

Null and empty texts hold no words; words of a text that is one long line, however long, are all counted.
Repeated rows count as often as they occur, null ids included; ties in the report go to the more frequent
phrase, then to the order of UTF-8 bytes. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from graphmill.llm.common import drop, mixed, slices, text_bytes, word_hashes, write
from graphmill.llm.decontamination import bit_map
from graphmill.llm.substring import BASE, Powers

MOST_WORDS, LEAST, TOP, SHARE = 5, 100, 2000, 100
#: Bits of the map of frequent phrases, as a power of two: 16 MB on every executor.
BITS = 27
#: Bytes of text that a task counts at once before it hands its sums on.
SLICE = 1 << 22
#: The same for the last scan, which makes words and phrases of it.
SCANNED = 1 << 20
#: Rows that the last scan hands on at once.
HANDED = 1 << 16
NO_LANGUAGE = "und"
#: The signs that end a piece.
PIECES = b".,;:!?\n\x0b\x0c\r"
#: Stands between pieces; no UTF-8 text holds this byte.
BREAK = b"\xff"
#: Bytes to words: A-Z in lower case, ends of pieces as line ends.
SIGNS = bytes(10 if i in PIECES else i + 32 if 65 <= i <= 90 else i for i in range(256))


def tokens(text: bytes) -> list[bytes]:
    """The words of a text with a break after each piece."""
    found = text.translate(SIGNS).replace(b"\n", b" \xff ").split()
    found.append(BREAK)
    return found


class Slice:
    """The words of a slice of texts, their fingerprints and where runs of n words may start."""

    def __init__(self, batch: pa.RecordBatch, powers: Powers) -> None:
        self.words: list[bytes] = []
        ends = [0]
        for text in text_bytes(batch):
            self.words += tokens(text)
            ends.append(len(self.words))
        self.row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        langs = [(x if x is not None else NO_LANGUAGE).encode() for x in batch.column("lang").to_pylist()]
        self.langs = langs
        self.salt = mixed(word_hashes(langs), 7)[self.row]
        coded = pa.array(self.words, pa.binary()).dictionary_encode()
        #: Distinct words, and numbers of words in them: equal for equal words only.
        self.distinct, self.numbers = coded.dictionary, coded.indices.to_numpy()
        hashes = word_hashes(self.distinct.to_pylist())[self.numbers]
        self.ends = np.flatnonzero(hashes == word_hashes([BREAK])[0])
        up, self.down = powers.get(len(hashes) + 1)
        #: Values at 0 of the polynomials of all beginnings; a run's is a difference, moved to its start.
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mixed(hashes, BASE) * up[: len(hashes)], out=self.sums[1:])

    def number(self) -> None:
        """Numbers that are equal for equal languages only."""
        known: dict[bytes, int] = {}
        self.lang = np.array([known.setdefault(x, len(known)) for x in self.langs], np.int64)[self.row]

    def starts(self, n: int) -> np.ndarray:
        """Places of runs of n words that cross no break."""
        free = np.ones(len(self.words), bool)
        for back in range(n):
            at = self.ends - back
            free[at[at >= 0]] = False
        return np.flatnonzero(free)

    def fingerprints(self, at: np.ndarray, n: int) -> np.ndarray:
        return mixed((self.sums[at + n] - self.sums[at]) * self.down[at] ^ self.salt[at], n)


def held(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether the map holds each fingerprint."""
    place = prints >> np.uint64(64 - (len(bits).bit_length() + 5))
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _counts(docs: DataFrame, sizes: range, shorter) -> DataFrame:
    """Fingerprint, number of words and count, per slice, of the runs whose shorter runs are frequent.

    The map holds runs of one word less than the first of ``sizes``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in slices(batches, most=SLICE):
            part = Slice(batch, powers)
            base = sizes[0] - 1
            if shorter is not None:
                known = np.zeros(len(part.words) + 1, bool)
                at = part.starts(base)
                known[at] = held(shorter.value, part.fingerprints(at, base))
            for n in sizes:
                at = part.starts(n)
                if shorter is not None:
                    for i in range(n - base + 1):
                        at = at[known[at + i]]
                found, counts = np.unique(part.fingerprints(at, n), return_counts=True)
                size = pa.array(np.full(len(found), n, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), size, pa.array(counts)], names=["seed", "size", "n"]
                )

    return docs.select("lang", "text").mapInArrow(run, "seed long, size int, n long")


def alike_runs(part: Slice, at: np.ndarray, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of runs of n words: the first place of each fingerprint, and each that reads otherwise."""
    _, first, which, counts = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
    lead = at[first][which]
    alike = part.numbers[lead] == part.numbers[at]
    for i in range(1, n):
        alike &= part.numbers[lead + i] == part.numbers[at + i]
    alike &= part.lang[lead] == part.lang[at]
    if alike.all():
        return at[first], counts
    same = np.bincount(which[alike], minlength=len(first))
    return np.r_[at[first], at[~alike]], np.r_[same, np.ones(int((~alike).sum()), np.int64)]


def _phrases(docs: DataFrame, most_words: int, frequent) -> DataFrame:
    """lang, phrase, its count and smallest doc_id in a slice; rows without a phrase count the words of a language.

    Every slice hands on its own rows: Spark adds them up in the task, and Python holds no more than a slice.
    """

    names = ["lang", "phrase", "n", "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in slices(batches, most=SCANNED):
            batch = batch.take(pc.sort_indices(batch.column("doc_id")))  # the first place has the smallest id
            ids = batch.column("doc_id")
            part = Slice(batch, powers)
            part.number()
            langs, which = np.unique(part.langs, return_inverse=True)
            langs = pa.array(langs.tolist(), pa.binary()).cast(pa.string())
            totals = np.bincount(which[part.row], minlength=len(langs))
            totals -= np.bincount(which[part.row[part.ends]], minlength=len(langs))
            none = [pa.nulls(len(langs), kind) for kind in (pa.string(), ids.type)]
            yield pa.RecordBatch.from_arrays([langs, none[0], pa.array(totals, pa.int64()), none[1]], names=names)
            for n in range(1, most_words + 1):
                at = part.starts(n)
                prints = part.fingerprints(at, n)
                known = held(frequent.value, prints)
                at, counts = alike_runs(part, at[known], prints[known], n)
                for i in range(0, len(at), HANDED):
                    some = at[i : i + HANDED]
                    run_words = [part.distinct.take(pa.array(part.numbers[some + k])) for k in range(n)]
                    phrases = pc.binary_join_element_wise(*run_words, pa.scalar(b" ", pa.binary())).cast(pa.string())
                    row = part.row[some]
                    columns = [langs.take(pa.array(which[row])), phrases, pa.array(counts[i : i + HANDED], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, ids.take(pa.array(row))], names=names)

    narrow = docs.select("doc_id", "lang", "text")
    kind = StructField("doc_id", narrow.schema["doc_id"].dataType)
    text = [StructField("lang", StringType()), StructField("phrase", StringType())]
    return narrow.mapInArrow(run, StructType([*text, StructField("n", LongType()), kind]))


def frequent_phrases(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """lang, phrase, its count ``n`` and smallest ``doc_id`` of all phrases found ``least`` times or more.

    The row of a language without a phrase holds the number of all its words.
    """
    spark = docs.sparkSession
    paths, shorter, n = [], None, 1
    while n <= most_words:
        # Few runs of four words are left whose shorter ones are frequent, so longer ones go with them.
        sizes = range(n, n + 1 if n < 4 else most_words + 1)
        counts = _counts(docs, sizes, shorter).groupBy("seed", "size").agg(F.sum("n").alias("n"))
        paths.append(write(counts.where(F.col("n") >= least).select("seed"), "frequent"))
        if shorter is not None:
            shorter.unpersist()
        shorter = spark.sparkContext.broadcast(bit_map(spark.read.parquet(paths[-1]), bits))
        n = sizes[-1] + 1
    frequent = spark.sparkContext.broadcast(bit_map(spark.read.parquet(*paths), bits))
    counted = _phrases(docs, most_words, frequent).groupBy("lang", "phrase")
    counted = counted.agg(F.sum("n").alias("n"), F.min("doc_id").alias("doc_id"))
    found = spark.read.parquet(write(counted.where(F.col("phrase").isNull() | (F.col("n") >= least)), "phrases"))
    drop(spark, *paths)
    return found


def _parts(words: Column, low: int, high: Column) -> Column:
    """All stretches of ``low`` to ``high`` words of an array of words, each once."""
    starts = F.sequence(F.lit(1), F.size(words))

    def of(i: Column) -> Column:
        left = F.size(words) - i + 1
        sizes = F.when(F.least(left, high) >= low, F.sequence(F.lit(low), F.least(left, high)))
        return F.transform(F.coalesce(sizes, F.array().cast("array<int>")), lambda k: F.array_join(F.slice(words, i, k), " "))

    return F.array_distinct(F.flatten(F.transform(starts, of)))


def collocations(
    docs: DataFrame,
    most_words: int = MOST_WORDS,
    least: int = LEAST,
    top: int = TOP,
    share: int = SHARE,
    bits: int = BITS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score and a doc_id of the first ``top`` collocations of each language."""
    found = frequent_phrases(docs, most_words, least, bits)
    totals = found.where("phrase is null").select("lang", F.col("n").alias("total"))
    counts = found.where("phrase is not null").withColumn("words", F.split("phrase", " "))
    candidates = counts.where(F.size("words") > 1).withColumnRenamed("n", "a")

    longer = candidates.where(F.size("words") > 2)
    inner = longer.select("lang", "a", F.explode(_parts(F.col("words"), 2, F.size("words") - 1)).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    free = candidates.join(inner, ["lang", "phrase"], "left").where(
        F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("a"))
    )

    size, k = F.size("words"), F.col("k")
    cuts = free.select("lang", "phrase", "a", "doc_id", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select(
        *["lang", "phrase", "a", "doc_id", "k"],
        F.array_join(F.slice("words", F.lit(1), k), " ").alias("first"),
        F.array_join(F.slice("words", k + 1, size - k), " ").alias("rest"),
    )
    firsts = counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    rests = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    cuts = cuts.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest"]).join(totals, "lang")
    # 34 digits hold the product of a count and a total of up to 10^17 each.
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("up", (wide("a") * wide("total")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)"))
    cuts = cuts.withColumn("down", (wide("l") * wide("r")).cast("decimal(38,0)"))
    lowest = Window.partitionBy("lang", "phrase").orderBy("score", "k")
    scored = cuts.withColumn("score", F.expr("cast(up as decimal(38,0)) div down"))
    scored = scored.withColumn("nth", F.row_number().over(lowest)).where("nth = 1").drop("nth")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score", "doc_id"
    )


def duckdb_sql(most_words: int = MOST_WORDS, least: int = LEAST, top: int = TOP, share: int = SHARE) -> str:
    """The same rows, every run of words formed and counted by its text."""
    runs = " UNION ALL ".join(
        f"SELECT lang, doc_id, {n} AS size, array_to_string(w[i:i + {n - 1}], ' ') AS phrase "
        f"FROM (SELECT lang, doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM pieces WHERE len(w) >= {n})"
        for n in range(1, most_words + 1)
    )
    return rf"""
        WITH texts AS (
            SELECT doc_id, coalesce(lang, 'und') AS lang,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents
        ), pieces AS (
            SELECT doc_id, lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w
            FROM (SELECT doc_id, lang, unnest(regexp_split_to_array(text, '[.,;:!?\n\x0b\f\r]')) AS piece FROM texts)
        ), counts AS (
            SELECT lang, phrase, any_value(size) AS size, count(*) AS f, min(doc_id) AS doc_id
            FROM ({runs}) GROUP BY lang, phrase HAVING count(*) >= {least}
        ), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
        longer AS (
            SELECT lang, f, w, unnest(range(2, size)) AS k
            FROM (SELECT lang, f, size, string_split(phrase, ' ') AS w FROM counts WHERE size > 2)
        ), inside AS (
            SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(f) AS longest
            FROM (SELECT lang, f, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM longer) GROUP BY ALL
        ), free AS (
            SELECT c.lang, c.phrase, c.f AS a, c.doc_id, string_split(c.phrase, ' ') AS w
            FROM counts c LEFT JOIN inside i USING (lang, phrase)
            WHERE c.size > 1 AND (i.longest IS NULL OR 100 * i.longest < {share} * c.f)
        ), cuts AS (
            SELECT *, array_to_string(w[1:k], ' ') AS left_part, array_to_string(w[k + 1:], ' ') AS right_part
            FROM (SELECT *, unnest(range(1, len(w))) AS k FROM free)
        ), scored AS (
            SELECT c.lang, c.phrase, c.a, c.doc_id, c.k, x.f AS l, y.f AS r, t.n,
                ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
            FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.left_part
            JOIN counts y ON y.lang = c.lang AND y.phrase = c.right_part JOIN totals t ON t.lang = c.lang
        ), best AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
            phrase, a, l, r, n, score, doc_id
        FROM best QUALIFY rank <= {top}"""
