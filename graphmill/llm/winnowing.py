"""Document fingerprints by winnowing, in built-in functions only.

Words are runs between ASCII white space, in pieces of at most ``PIECE`` signs, so that a text without
white space has more than one. A rolling hash (rotate and xor of word pairs, doubled) gives one 64-bit
value for every ``WORDS`` = 4 words; of each window of ``WINDOW`` = 16 such grams the smallest 31-bit prefix
is kept, of equal ones the rightmost, with its place. Texts that share a run of WORDS + WINDOW - 1 = 19
words share a fingerprint of it; a shared run shorter than WORDS gives none.

A fingerprint is a list of hashes and a list of their places (number of the gram's first word). Equal
texts have equal ones. A text with fewer words than a gram has the hash of all its words at place 0; with
fewer grams than a window, the smallest of all; null, empty and blank texts have no hash. Likeness is
the share of distinct hashes of two fingerprints that are in both; two without any are alike (1).

``edited`` gives each text the edited form of the contract: its last third replaced by the beginning of
the next document, in descending doc_id. Documents are found through two joins on the id, the second one
with the part that is needed of a text and no more; the order of ids is found on a narrow table of
distinct ids, in ``BINS`` ranges whose bounds are the only thing the driver gets. Rows of one id all have the
same next document: the next smaller id; of several rows there, the one whose text has the smallest
64-bit hash. A null id comes after all others. After the last comes the first. A row that is alone in its
table is its own next. Repeated rows stay repeated; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphmill.llm.common import write

#: Words of a gram and grams of a window, both powers of two; signs of a word that count as one.
WORDS, WINDOW, PIECE = 4, 16, 40
#: Ranges of ids that are ordered for themselves.
BINS = 256
#: The places of grams are counted down from here, so that of equal hashes the rightmost is smallest.
LAST = (1 << 32) - 1


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column, piece: int = PIECE) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^ \t-\r]{{1,{piece}}}"), F.lit(0))


def _doubled(values: Column, k: int, join) -> Column:
    """Each value joined with the ``k``-th after it; beyond the end stands null."""
    return _let(values, lambda v: F.zip_with(v, F.slice(v, F.lit(1 + k), F.size(v)), join))


def _turned(h: Column, by: int) -> Column:
    return F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by))


def gram_hashes(words: Column, k: int = WORDS) -> Column:
    """Rolling hashes of all runs of ``k`` words (a power of two, 2 at least)."""
    n = F.size(words)
    pairs = F.zip_with(words, F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    size = 2
    while size < k:
        pairs = _doubled(pairs, size, lambda a, b: _turned(a, 7).bitwiseXOR(b))
        size *= 2
    return F.slice(pairs, F.lit(1), F.greatest(n - (k - 1), F.lit(0)))


def _minima(v: Column, window: int) -> Column:
    """Smallest value of every window, by doubling; a short list has one window."""
    n = F.size(v)
    size = 1
    while size < window:
        v = _doubled(v, size, lambda a, b: F.least(a, b))  # leaves nulls out
        size *= 2
    return F.slice(v, F.lit(1), F.greatest(n - (window - 1), F.lit(1)))


def fingerprint(text: Column, k: int = WORDS, window: int = WINDOW, piece: int = PIECE) -> Column:
    """A struct of ``hashes`` and ``places``, in order of place."""

    def chosen(h: Column) -> Column:
        ranked = F.transform(
            h, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 33), 32).bitwiseOR(F.lit(LAST) - i)
        )
        least = F.array_distinct(_let(ranked, lambda v: _minima(v, window)))
        places = F.transform(least, lambda v: (F.lit(LAST) - v.bitwiseAND(F.lit(LAST))).cast("int"))
        return _let(
            places,
            lambda at: F.struct(F.transform(at, lambda i: F.get(h, i)).alias("hashes"), at.alias("places")),
        )

    def of(words: Column) -> Column:
        n = F.size(words)
        few = F.struct(F.array(F.xxhash64(words)).alias("hashes"), F.array(F.lit(0)).alias("places"))
        none = F.struct(F.array().cast("array<bigint>").alias("hashes"), F.array().cast("array<int>").alias("places"))
        return F.when(n >= k, _let(gram_hashes(words, k), chosen)).when(n > 0, few).otherwise(none)

    return _let(words_of(text, piece), of)


def shown(print_: Column) -> Column:
    """A fingerprint as a string: hash (16 hexadecimal digits) and place of each entry."""
    digits = F.transform(
        print_["hashes"], lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    )
    return F.array_join(F.zip_with(digits, print_["places"], lambda h, p: F.concat(h, F.lit(":"), p)), ",")


def likeness(a: Column, b: Column) -> Column:
    """Shared distinct hashes of two lists by all distinct hashes; 1 if there are none."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both
    return F.when(all_ == 0, F.lit(1.0)).otherwise(both / all_)


def _ordered(ids: DataFrame) -> DataFrame:
    """The distinct ids, each with the next one in descending order, null last; the last one with the first."""
    spark = ids.sparkSession
    kind = ids.schema["doc_id"].dataType
    ids = spark.read.parquet(write(ids, "ids"))
    cuts = ids.where("doc_id is not null").select(
        F.percentile_approx("doc_id", [i / BINS for i in range(1, BINS)]).alias("cuts")
    )
    bounds = sorted(set(cuts.first()["cuts"] or []))
    if bounds:
        above = F.array(*[F.lit(b).cast(kind) for b in bounds])
        # The number of bounds below or at the id; null ids come last in a bin of their own.
        bin_ = F.size(F.filter(above, lambda b: b <= F.col("doc_id")))
    else:
        bin_ = F.lit(0)
    binned = ids.withColumn("bin", F.when(F.col("doc_id").isNull(), -1).otherwise(bin_))
    order = Window.partitionBy("bin").orderBy(F.desc("doc_id"))
    row = F.struct("doc_id", "rep")
    linked = binned.withColumn("next", F.lead(row).over(order))
    tops = binned.groupBy("bin").agg(F.max_by(row, "doc_id").alias("ahead"), F.min_by(row, F.lit(0)).alias("only"))
    tops = tops.select("bin", F.coalesce("ahead", "only").alias("ahead"))
    around = Window.partitionBy(F.lit(0)).orderBy(F.desc("bin"))  # BINS rows
    tops = tops.select(
        "bin",
        F.coalesce(
            F.lead("ahead").over(around),
            F.first("ahead").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("following"),
    )
    joined = linked.join(tops, "bin")
    return joined.select("doc_id", "longest", F.coalesce("next", "following").alias("next"))


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, the text's edited form ``edited``, both fingerprints and that of the next document."""
    text = F.coalesce("text", F.lit(""))
    # A struct is never null, so ids that are null meet like others. Both joins read the same columns by the
    # same key: the texts are shuffled once.
    rows = docs.select(F.struct("doc_id").alias("at"), text.alias("text"))
    lengths = docs.select("doc_id", F.length(text).alias("n"), F.xxhash64(text).alias("h"))
    ids = lengths.groupBy("doc_id").agg(F.max("n").alias("longest"), F.min("h").alias("rep"))
    order = docs.sparkSession.read.parquet(write(_ordered(ids), "order"))
    # What the row before wants of a document: as many signs of it as a third of that row has.
    wanted = order.select(
        F.struct("next.doc_id").alias("from"),
        F.col("next.rep").alias("rep"),
        F.struct("doc_id").alias("for"),
        F.floor(F.col("longest") / 3).cast("int").alias("signs"),
    )
    given = rows.join(wanted, F.col("at") == F.col("from"))
    # No text of an id has a smaller hash than ``rep``; an equality would become a second key of the join.
    given = given.where(F.xxhash64("text") <= F.col("rep")).select(
        F.col("for").alias("at"),
        F.substring("text", F.lit(1), F.col("signs")).alias("ahead"),
        fingerprint(F.col("text"))["hashes"].alias("next_hashes"),
    )
    given = given.groupBy("at").agg(F.min(F.struct("ahead", "next_hashes")).alias("given"))
    joined = rows.join(given, "at", "left").withColumn("doc_id", F.col("at.doc_id"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    changed = F.concat(F.substring("text", F.lit(1), n - third), F.substring("given.ahead", F.lit(1), third))
    own = fingerprint(F.col("text")).alias("print")
    out = joined.select("doc_id", n.cast("bigint").alias("n_chars"), changed.alias("edited"), own, "given.next_hashes")
    return out.withColumn("edited_print", fingerprint(F.col("edited")))


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, digest of the edited text, both fingerprints as strings, and both likenesses."""
    found = edited(docs)
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("print")).alias("fingerprint"),
        shown(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print.hashes"), F.col("edited_print.hashes")).alias("near_edited"),
        likeness(F.col("print.hashes"), F.col("next_hashes")).alias("near_next"),
    )
