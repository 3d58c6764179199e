"""Names to known entities: exact, fuzzy and staged matching.

Callers pass the distinct names; a name that a third of all news mention is resolved once and
joined back. All joins are equi joins. Small dictionaries become broadcast joins by Spark's own
size check; large ones are shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill import schemas
from graphmill.functions import jsontext
from graphmill.functions.clean import _col, clean_name
from graphmill.operators import hooks
from graphmill.session import stored


def exact(terms: DataFrame, dictionary: DataFrame, term: str = "term", alias: str = "alias") -> DataFrame:
    """Terms with the dictionary row of the same text."""
    return terms.join(dictionary, terms[term] == dictionary[alias]).drop(alias)


def first_row(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per group, the first in a stated order."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def exact_either(terms: DataFrame, nodes: DataFrame, term: str = "term") -> DataFrame:
    """Terms equal to a node's ticker or name in any case, one node per term.

    Two equi joins instead of one with OR, which would compare every term with every node. A
    ticker hit comes before a name hit, then label and key decide.
    """
    folded = terms.withColumn("_t", F.lower(F.trim(F.col(term))))
    fields = ["label", "key", "name"]

    def by(column: str, order: int) -> DataFrame:
        side = nodes.where(F.col(column).isNotNull()).select(F.lower(column).alias("_t"), *fields)
        return folded.join(side, "_t").withColumn("_o", F.lit(order))

    hits = by("ticker", 0).unionByName(by("name", 1)).drop("_t")
    return first_row(hits, [term], ["_o", "label", "key"]).drop("_o")


def folded(c: Column | str) -> Column:
    """Lower case, single blanks: the form in which names are compared."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), r"\s+", " "))


def sorted_words(c: Column) -> Column:
    return F.array_join(F.sort_array(F.split(c, " ")), " ")


def _edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(0.0)


def fuzzy_score(a: Column | str, b: Column | str) -> Column:
    """Likeness of two folded names, 0 to 100.

    The best of edit similarity, 0.95 times edit similarity of the sorted words, and 0.9 times
    the share of the shorter name's distinct words that the other name holds too.
    """
    a, b = _col(a), _col(b)
    words_a, words_b = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    shared = F.size(F.array_intersect(words_a, words_b)) / F.least(F.size(words_a), F.size(words_b))
    best = F.greatest(
        _edit_similarity(a, b), 0.95 * _edit_similarity(sorted_words(a), sorted_words(b)), 0.9 * shared
    )
    return F.round(100 * best, 6)


def _with_bigrams(names: DataFrame) -> DataFrame:
    """Names with their padded bigrams, equal ones told apart by a running number.

    Two steps, since an expression used inside a lambda is evaluated for every element.
    """
    padded = F.concat(F.lit("\u0002"), F.col("text"), F.lit("\u0003"))
    spots = F.sequence(F.lit(1), F.length(padded) - 1)
    grams = F.sort_array(F.transform(spots, lambda i: F.substr(F.col("_padded"), i, F.lit(2))))
    ordered = names.select("text", padded.alias("_padded")).select("text", grams.alias("_grams"))

    def number(gram: Column, i: Column) -> Column:
        return F.concat(gram, F.lit("#"), (i - F.array_position("_grams", gram)).cast("string"))

    return ordered.select("text", F.transform("_grams", number).alias("tokens"))


def _with_words(names: DataFrame) -> DataFrame:
    return names.select("text", F.array_distinct(F.split("text", " ")).alias("tokens"))


def _all_tokens(names: DataFrame) -> DataFrame:
    # Outer, as a plain explode would push a second copy of the token expression below as a filter.
    return names.select("text", F.explode_outer("tokens").alias("token"))


def _rare_tokens(names: DataFrame, needed: Column, rarity: DataFrame) -> DataFrame:
    """The rarest tokens of each name, as many as a partner must meet at least one of.

    A name with ``n`` tokens whose partners share at least ``o`` of them meets each partner
    within its ``n - o + 1`` rarest ones, so the most frequent of its tokens stay out of the join.
    """
    kept = F.size("tokens") - needed + 1
    rows = names.select("text", kept.alias("_kept"), F.explode_outer("tokens").alias("token"))
    by_rarity = F.sort_array(F.collect_list(F.struct(F.coalesce("_count", F.lit(0)).alias("_count"), "token")))
    rare = (
        rows.join(rarity, "token", "left").groupBy("text", "_kept").agg(by_rarity.alias("_all"))
        .select("text", F.slice("_all.token", 1, F.greatest("_kept", F.lit(0))).alias("tokens"))
    )
    return _all_tokens(rare)


def _meet(terms: DataFrame, names: DataFrame, needed: Column, full_names: bool = False) -> DataFrame:
    """Pairs of term and name that share a token of their rare ends.

    Both sides hold text and tokens. ``full_names`` compares the rare end of either side with all
    tokens of the other.
    """
    rarity = _all_tokens(names).groupBy("token").agg(F.count("*").alias("_count"))

    def side(rows: DataFrame, into: str) -> DataFrame:
        return rows.withColumnRenamed("text", into)

    rare_terms, rare_names = (_rare_tokens(df, needed, rarity) for df in (terms, names))
    rare_terms, rare_names = side(rare_terms, "term"), side(rare_names, "name")
    if not full_names:
        return rare_terms.join(rare_names, "token").select("term", "name")
    all_terms, all_names = side(_all_tokens(terms), "term"), side(_all_tokens(names), "name")
    return (
        rare_terms.join(all_names, "token").select("term", "name")
        .union(all_terms.join(rare_names, "token").select("term", "name"))
    )


def _most_edits(length: Column, share: float) -> Column:
    """Edits between a name of this length and any partner whose edit similarity exceeds ``share``."""
    longest = F.floor(length / share + 1e-9)
    return F.floor((1 - share) * longest + 1e-9).cast("int")


def _segment_start(length: Column, edits: Column, i: Column) -> Column:
    """Where segment ``i`` of a name begins that is cut into ``edits + 1`` of about equal length."""
    return F.floor(i * length / (edits + 1)).cast("int")


def _segment_pairs(terms: DataFrame, names: DataFrame, share: float) -> DataFrame:
    """Pairs of term and name that agree on a segment of the name, near its place.

    A name with at most ``e`` edits to its partner is cut into ``e + 1`` segments; one of them stands
    in the partner unchanged, moved by no more than the edits on either side of it allow. Length and
    number of the segment are part of the key, so only names of fitting length meet.
    """
    length, edits = F.col("_length"), F.col("_edits")
    i, at, size = F.col("_i"), F.col("_at"), F.col("_size")

    def cut(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_edits", _most_edits(length, share))
        rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), edits)))
        start = _segment_start(length, edits, i)
        return rows.withColumn("_at", start).withColumn("_size", _segment_start(length, edits, i + 1) - start)

    whole = names.select(F.col("text").alias("name"), F.length("text").alias("_length"))
    segments = cut(whole).select("name", "_length", "_i", F.substr("name", at + 1, size).alias("_segment"))
    own = F.length("term")
    low, high = F.ceil(own * share - 1e-9).cast("int"), F.floor(own / share + 1e-9).cast("int")
    fitting = terms.select(F.col("text").alias("term"))
    fitting = cut(fitting.withColumn("_length", F.explode(F.sequence(low, high))))
    moved = own - length
    # Edits before the segment are at most its number, those behind it at most the rest.
    first = F.greatest(at - i, at + moved - (edits - i), F.lit(0))
    last = F.least(at + i, at + moved + (edits - i), own - size)
    places = fitting.withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
    places = places.withColumn("_place", F.explode(F.sequence("_first", "_last")))
    parts = places.select("term", "_length", "_i", F.substr("term", F.col("_place") + 1, size).alias("_segment"))
    key = ["_length", "_i", "_segment"]
    # Both sides by the key they meet on, over all cores: the rows are small, the pairs are the work.
    tasks = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        parts.repartition(tasks, *key).distinct().join(segments.repartition(tasks, *key), key).select("term", "name")
    )


def _edit_pairs(terms: DataFrame, names: DataFrame, form: Column, share: float) -> DataFrame:
    """Every pair whose edit similarity on ``form`` exceeds ``share`` (at least one half).

    From three quarters up, pairs meet on a segment of the name (``_segment_pairs``). Below, segments
    would be too short to tell names apart: with ``n`` the longer length, similarity above ``share``
    means fewer than ``(1 - share) n`` edits; an edit touches two of the ``n + 1`` padded bigrams, so
    more than ``1 + (2 share - 1) n`` of them are shared. Distinct forms meet, not texts. Few pairs meet
    twice, so they are measured where they meet, by a bounded edit distance that gives up on a pair as
    soon as it is too far apart; only those that are near are shuffled.
    """
    text = F.col("text")
    sides = [df.select(form.alias("text"), F.col("text").alias("_own")) for df in (terms, names)]
    forms = [side.select("text").distinct() for side in sides]
    if share >= 0.75:
        pairs = _segment_pairs(*forms, share)
    else:
        needed = (F.floor(1 + (2 * share - 1) * F.length(text)) + 1).cast("int")
        pairs = _meet(*[_with_bigrams(rows) for rows in forms], needed)
    shorter, longer = F.least(F.length("term"), F.length("name")), F.greatest(F.length("term"), F.length("name"))
    edits = F.floor((1 - share) * longer + 1e-9).cast("int")
    near = (
        pairs.where(longer - shorter <= edits).withColumn("_edits", edits)
        .where(F.expr("levenshtein(term, name, _edits) >= 0")).select("term", "name").distinct()
    )
    own_term, own_name = (
        side.select(F.col("text").alias(into), F.col("_own").alias(f"_{into}"))
        for side, into in zip(sides, ("term", "name"), strict=True)
    )
    return near.join(own_term, "term").join(own_name, "name").select(
        F.col("_term").alias("term"), F.col("_name").alias("name")
    )


def fuzzy(
    terms: DataFrame, dictionary: DataFrame, k: int, floor: float, term: str = "term", alias: str = "alias"
) -> DataFrame:
    """The ``k`` best dictionary names per term with a score above ``floor``.

    Exact for floors from 50 on: candidates are found by shared rare bigrams and words with
    bounds that no qualifying pair can miss, then scored. Returns term, alias, score, rank.
    """
    if not 50 <= floor <= 100:
        raise ValueError("fuzzy needs a floor between 50 and 100")
    left = terms.select(folded(term).alias("text")).where("text <> ''").distinct()
    right = dictionary.select(folded(alias).alias("text")).where("text <> ''").distinct()
    text = F.col("text")
    channels = [_edit_pairs(left, right, text, floor / 100)]
    if floor < 95:
        channels.append(_edit_pairs(left, right, sorted_words(text), floor / 95))
    if floor < 90:
        needed = (F.floor(floor / 90 * F.size("tokens")) + 1).cast("int")
        channels.append(_meet(_with_words(left), _with_words(right), needed, full_names=True))
    pairs = functools.reduce(DataFrame.union, channels).distinct()
    scored = pairs.withColumn("score", fuzzy_score("term", "name")).where(F.col("score") > floor)
    # One spelling stands for all that fold to the same text, so ranks count distinct names.
    spellings = dictionary.groupBy(folded(alias).alias("name")).agg(F.min(alias).alias("_alias"))
    best = Window.partitionBy("term").orderBy(F.desc("score"), "name")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    originals = terms.select(F.col(term).alias("_term"), folded(term).alias("term")).distinct()
    return (
        ranked.join(spellings, "name").join(originals, "term")
        .select(F.col("_term").alias(term), F.col("_alias").alias(alias), "score", "rank")
    )


def resolve_names(
    terms: DataFrame, dictionary: DataFrame, official: DataFrame, floor: float = 90.0, min_length: int = 3
) -> DataFrame:
    """Staged resolution of distinct terms; a term settles at the first stage that knows it.

    Stages: exact, fuzzy, exact on the official name, fuzzy on the official name. ``dictionary``
    holds alias, label, key; ``official`` holds term, official_name, given from outside. Aliases
    up to ``min_length`` characters take no part in fuzzy stages. Terms are looked up without
    honorifics and legal forms. Returns term, stage, score, label, key, with terms as given.
    """
    given = terms.select("term", clean_name("term").alias("_clean")).distinct()
    official = official.join(given, "term").select(F.col("_clean").alias("term"), "official_name")
    official = official.groupBy("term").agg(F.min("official_name").alias("official_name"))
    terms = given.select(F.col("_clean").alias("term")).where("term <> ''").distinct()
    long_aliases = dictionary.where(F.length("alias") > min_length).select("alias")

    def stage(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("term", F.lit(name).alias("stage"), "score", "label", "key")

    def best(pairs: DataFrame) -> DataFrame:
        return pairs.join(dictionary, "alias")

    by_text = exact(terms, dictionary).withColumn("score", F.lit(100.0))
    rest = terms.join(dictionary.select(F.col("alias").alias("term")), "term", "left_anti")
    # The fuzzy answers, one row per term, decide three further steps: computed once.
    near = stored(fuzzy(rest, long_aliases, 1, floor), "near")
    rest = rest.join(near.select("term"), "term", "left_anti").where(F.length("term") > 2)
    named = rest.join(official, "term").where("official_name is not null")
    by_official = (
        named.join(dictionary.withColumnRenamed("alias", "official_name"), "official_name")
        .withColumn("score", F.lit(100.0))
    )
    left = named.join(dictionary.select(F.col("alias").alias("official_name")), "official_name", "left_anti")
    near_official = fuzzy(
        left.select("official_name").distinct(), long_aliases, 1, floor, term="official_name"
    ).join(left, "official_name")
    settled = (
        stage(by_text, "exact")
        .unionByName(stage(best(near), "fuzzy"))
        .unionByName(stage(by_official, "official_exact"))
        .unionByName(stage(best(near_official), "official_fuzzy"))
    )
    return given.join(settled.withColumnRenamed("term", "_clean"), "_clean").drop("_clean")


def exact_then_vector(terms: DataFrame, nodes: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Terms by ticker or name with score 1, the others by their nearest vector.

    ``neighbours``: term, label, key, name, score, from a search that applied the threshold.
    """
    by_text = exact_either(terms, nodes).select("term", "label", "key", "name").withColumn("score", F.lit(1.0))
    rest = neighbours.join(by_text.select("term"), "term", "left_anti")
    return by_text.withColumn("stage", F.lit("exact")).unionByName(
        rest.select("term", "label", "key", "name", "score").withColumn("stage", F.lit("vector"))
    )


def candidates(
    names: DataFrame, dictionary: DataFrame, k: int = 5, floor: float = 50.0
) -> DataFrame:
    """The dictionary entries offered for each name: name, rank, alias, ticker, score."""
    near = fuzzy(names, dictionary.select("alias"), k, floor, term="name")
    return near.join(dictionary.select("alias", "ticker"), "alias").select("name", "rank", "alias", "ticker", "score")


def decide_matches(
    names: DataFrame, dictionary: DataFrame, load: Callable, k: int = 5, floor: float = 50.0
) -> DataFrame:
    """Ticker of each company name: exact, else what is decided among its fuzzy candidates.

    ``names``: name. ``dictionary``: alias, ticker. ``load`` opens a decision function as for
    ``hooks.decide``; it sees name and ``offered`` (rank, alias, ticker, score, best first) and
    answers with a response that holds ``match_ticker``. Answers that are not among the tickers
    offered are dropped, as are unreadable ones. Returns name, match, stage.
    """
    by_text = names.join(dictionary.withColumnRenamed("alias", "name"), "name").select(
        "name", F.col("ticker").alias("match"), F.lit("exact").alias("stage")
    )
    rest = names.join(by_text.select("name"), "name", "left_anti")
    offered = candidates(rest, dictionary, k, floor).groupBy("name").agg(
        F.sort_array(F.collect_list(F.struct("rank", "alias", "ticker", "score"))).alias("offered")
    )
    answered = jsontext.with_record(hooks.decide(offered, load), "response", schemas.CANDIDATE_MATCH)
    chosen = F.col("parsed.match_ticker")
    decided = answered.where(F.array_contains("offered.ticker", chosen)).select(
        "name", chosen.alias("match"), F.lit("decided").alias("stage")
    )
    return by_text.unionByName(decided)


def words_of(c: Column | str) -> Column:
    """Lower-case runs of letters and digits, in text order."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _phrase_key(words: Column) -> list[Column]:
    """128 bits that stand for a run of words."""
    return [F.xxhash64(words).alias("_h1"), F.xxhash64(F.lit(1), words).alias("_h2")]


def gazetteer(
    texts: DataFrame, aliases: DataFrame, id_col: str, text: str = "text", alias: str = "alias"
) -> DataFrame:
    """Aliases that occur in the texts, whole words, any case: id, alias, first position, count.

    Every text is read whole. Runs of as many words as some alias has are reduced to 128-bit keys,
    so long aliases cost no more than short ones, and meet the alias table on them: in place where
    the table is small enough to broadcast, by a shuffle of the keys where it is not.
    """
    known = aliases.select(alias, words_of(alias).alias("_w")).where(F.size("_w") > 0)
    lengths = sorted(r["_len"] for r in known.select(F.size("_w").alias("_len")).distinct().collect())
    words = F.col("_words")
    nothing = F.array().cast("array<struct<pos:int,_run:array<string>>>")

    def runs(length: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - (length - 1))
        cut = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.slice(words, i, length).alias("_run")))
        return F.when(F.size(words) >= length, cut).otherwise(nothing)

    rows = texts.select(id_col, words_of(text).alias("_words")).select(
        id_col, F.explode_outer(F.concat(nothing, *[runs(n) for n in lengths])).alias("_g")
    )
    keyed = rows.where("_g is not null").select(id_col, "_g.pos", *_phrase_key(F.col("_g._run")))
    keys = known.select(alias, *_phrase_key(F.col("_w")))
    found = keyed.join(keys, ["_h1", "_h2"])
    return found.groupBy(id_col, alias).agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
