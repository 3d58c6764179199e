"""Digests: lines of group members joined into one text of bounded length.

A digest shows a fixed number of characters, so only the lines that can reach into them matter.
They are found on narrow rows, order and length of each line, in two steps: a group's lines are
dealt to ``PARTS`` parts, and a line whose part alone fills the digest before it cannot be shown;
what is left, little more than the digest's lines times the parts, is summed up once more by group.
Only then are the texts of the lines that do reach in fetched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.clean import DIGEST
from graphmill.session import stored

#: Parts in which the lines of a group are looked at first.
PARTS = 1024


def member_line(name: str, description: str, kind: str = "") -> Column:
    lead = F.lit(f"- {kind} " if kind else "- ")
    return F.concat(
        lead, F.coalesce(F.col(name), F.lit("")), F.lit(": "), F.coalesce(F.col(description), F.lit(""))
    )


def _reaching(rows: DataFrame, parts: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """The rows before which less than ``limit`` characters stand in their part."""
    before = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).where(F.col("_start") < limit)


def digest(
    lines: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    line: str = "line",
    limit: int = DIGEST,
    separator: str = "\n",
    into: str = "digest",
) -> DataFrame:
    """The first ``limit`` characters of the lines of a group, joined in ``order``.

    Lines of equal order are told apart by a hash of their text; equal ones are counted and repeated.
    """
    shown = F.substring(line, 1, limit)
    rows = lines.where(F.length(line) > 0).select(*group, *order, shown.alias("_line")).withColumn("_h", F.xxhash64("_line"))
    keys = [*group, *order, "_h"]
    # More copies of a line than fill the digest are never shown.
    copies = F.least(F.count("*"), F.lit(limit + 1))
    narrow = rows.groupBy(*keys).agg(copies.alias("_n"), F.max(F.length("_line")).alias("_length"))
    narrow = narrow.withColumn("_size", F.col("_n") * (F.col("_length") + len(separator)))
    narrow = narrow.withColumn("_part", F.pmod(F.xxhash64(*order, "_h"), F.lit(PARTS)))
    first = _reaching(narrow, [*group, "_part"], [*order, "_h"], limit).drop("_start", "_part")
    kept = _reaching(first, group, [*order, "_h"], limit).withColumn(
        "_n", F.least("_n", F.ceil((limit - F.col("_start")) / (F.col("_length") + len(separator))).cast("bigint"))
    )
    # Few narrow rows, written, so that Spark knows how few when it joins them with the texts.
    kept = stored(kept.select(*keys, "_start", "_n"), "digest-lines")
    same = [rows[c].eqNullSafe(kept[c]) for c in keys]
    fetched = rows.join(kept, same).select(*[rows[c] for c in keys], "_start", "_n", "_line")
    fetched = fetched.groupBy(*keys, "_start", "_n").agg(F.min("_line").alias("_line"))
    repeated = F.array_repeat("_line", F.col("_n").cast("int"))
    in_order = F.array_sort(F.collect_list(F.struct("_start", F.array_join(repeated, separator).alias("_line"))))
    return (
        fetched.groupBy(*group)
        .agg(in_order.alias("_lines"))
        .select(*group, F.substring(F.array_join("_lines._line", separator), 1, limit).alias(into))
    )


def store_digest(nodes: DataFrame, digests: DataFrame, key: str, text: str = "digest") -> DataFrame:
    """Group nodes with their digest as description; groups without one keep what they had."""
    found = digests.select(F.col(key).alias("key"), F.col(text).alias("_new"))
    return (
        nodes.join(found, "key", "left")
        .withColumn("description", F.coalesce("_new", "description"))
        .drop("_new")
    )


def top_lines(
    rows: DataFrame, group: Sequence[str], order: Sequence[Column], line: str, count: int, separator: str, into: str
) -> DataFrame:
    """The first ``count`` lines of each group as one text."""
    window = Window.partitionBy(*group).orderBy(*order)
    ranked = rows.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= count)
    in_order = F.array_sort(F.collect_list(F.struct("_rank", F.col(line).alias("_line"))))
    return ranked.groupBy(*group).agg(F.count("*").alias("n_lines"), in_order.alias("_lines")).select(
        *group, "n_lines", F.array_join("_lines._line", separator).alias(into)
    )


# Title words that mark a section as being about the business.
SECTION_WORDS = ["product", "service", "operation", "division", "segment", "business"]
# Words that mark a headline as being about a deal.
DEAL_WORDS = ["partnership", "collaboration", "joint venture", "acquisition"]


def has_word(c: str, words: Sequence[str]) -> Column:
    """True when any of the words occurs in the text, in any case."""
    text = F.lower(F.col(c))
    hit = F.lit(False)
    for word in words:
        hit = hit | F.coalesce(text.contains(word.lower()), F.lit(False))
    return hit


def section_digest(
    pages: DataFrame,
    sections: DataFrame,
    words: Sequence[str] = SECTION_WORDS,
    summary_length: int = 800,
    section_length: int = 1500,
    total: int = 3500,
) -> DataFrame:
    """Summary, then the first two sections whose title holds a key word, else leading content.

    ``pages``: page_id, summary, content. ``sections``: page_id, sec_no, title, body.
    """
    matching = sections.where(has_word("title", words) & (F.length("body") > 0)).select(
        "page_id", "sec_no",
        F.concat(
            F.lit("SECTION '"), F.upper("title"), F.lit("':\n"), F.substring("body", 1, section_length),
            F.lit("\n\n"),
        ).alias("line"),
    )
    found = top_lines(matching, ["page_id"], [F.col("sec_no")], "line", 2, "", "found")
    head = F.concat(F.lit("SUMMARY:\n"), F.substring("summary", 1, summary_length), F.lit("\n\n"))
    fallback = F.concat(F.lit("CONTENT:\n"), F.substring("content", 1, section_length))
    return pages.join(found, "page_id", "left").select(
        "page_id",
        F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_sections"),
        F.substring(F.concat(head, F.coalesce("found", fallback)), 1, total).alias("digest"),
    )


def deal_digest(
    news: DataFrame,
    mentions: DataFrame,
    since: Column | None = None,
    words: Sequence[str] = DEAL_WORDS,
    count: int = 5,
) -> DataFrame:
    """Titles of the first articles per company that speak of a deal.

    ``news``: news_id, title, body, date. ``mentions``: news_id, company, from the gazetteer join,
    so no company name is searched in every article.
    """
    deals = news.where(has_word("title", words) | has_word("body", words))
    if since is not None:
        deals = deals.where(F.col("date") >= since)
    linked = deals.select("news_id", F.concat(F.lit("- News: "), "title").alias("line")).join(
        mentions.select("news_id", "company").distinct(), "news_id"
    )
    return top_lines(linked, ["company"], [F.col("news_id")], "line", count, "\n", "digest")
