"""Quality rules: a threshold table compiled into one projection of built-in functions.

Words are runs without ASCII white space. All counts come from array functions within the row, so
a text of any length is judged where it is read: no shuffle, no user function, no second pass.

Null and empty text have no words and fail the base rules. Ratios over nothing count as zero.
Rows are judged each for itself, repeated rows and null ids included; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that it was for on as with be by this are from or an at not "
    "der die das und ist von den zu mit sich des auf für ein eine dem nicht im als auch "
    "le la les de et un une des du en que qui dans pour pas sur avec par au est il elle "
    "el los las y del que se por con para una su al lo como más o no"
).split()

# Measure, smallest and largest allowed value (None: open).
RULES = (
    ("n_words", 50, None),
    ("word_chars / n_words", 2.0, 20.0),
    ("n_symbols / n_words", None, 0.3),
    ("n_stop_words / n_words", 0.02, None),
    ("n_letter_words / n_words", 0.7, None),
    ("n_bullet_lines / n_lines", None, 0.9),
    ("n_ellipsis_lines / n_lines", None, 0.3),
    ("n_dup_lines / n_lines", None, 0.5),
    ("n_repeat_words / n_words", None, 0.5),
)
SPACE = r"\\x20\\x09-\\x0D"


def measured(docs: DataFrame, carry: list[str] = ("doc_id",)) -> DataFrame:
    """The columns of ``carry`` and all counts the rules speak of."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*carry).alias("keep"), text.alias("text"))
    rows = rows.withColumn("words", F.expr(f"regexp_extract_all(text, '[^{SPACE}]+', 0)"))
    rows = rows.withColumn("lines", F.expr(f"filter(split(text, '\\n'), l -> l rlike '[^{SPACE}]')"))
    rows = rows.withColumn(
        "windows",
        F.expr("""if(size(words) < 4, array(), transform(sequence(0, size(words) - 3),
            i -> concat_ws(' ', words[i], words[i + 1], words[i + 2])))"""),
    )
    # Only texts with a repeated window are sorted: equal windows become neighbours.
    rows = rows.withColumn(
        "sorted",
        F.expr("""if(size(array_distinct(windows)) = size(windows), null,
            sort_array(transform(windows, (w, i) -> struct(w, i))))"""),
    )
    rows = rows.withColumn(
        "repeated",
        F.expr("""if(sorted is null, array(), sort_array(transform(
            filter(sequence(0, size(sorted) - 1), j -> coalesce(get(sorted, j - 1).w = sorted[j].w, false)
                or coalesce(get(sorted, j + 1).w = sorted[j].w, false)), j -> sorted[j].i)))"""),
    )
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    counts = {
        "n_words": "size(words)",
        "word_chars": "length(array_join(words, ''))",
        "n_symbols": "regexp_count(text, '[#*$%&|<>]')",
        "n_lines": "size(lines)",
        "n_dup_lines": "size(lines) - size(array_distinct(lines))",
        # Each repeated window covers three words, or as many as lie before the next one starts.
        "n_repeat_words": "aggregate(repeated, named_struct('n', 0, 'end', 0), (a, i) -> named_struct("
        "'n', a.n + i + 3 - greatest(i, a.end), 'end', i + 3), a -> a.n)",
        "n_stop_words": f"size(filter(words, w -> lower(w) in ({stop})))",
        "n_letter_words": r"size(filter(words, w -> w rlike '\\p{L}'))",
        "n_bullet_lines": r"size(filter(lines, l -> l rlike '^\\s*[-*•]'))",
        "n_ellipsis_lines": r"size(filter(lines, l -> l rlike '(\\.\\.\\.|…)\\s*$'))",
    }
    made = F.struct(*[F.expr(f"cast({e} as bigint)").alias(name) for name, e in counts.items()])
    # A generator keeps filters on the counts above them; pushed below, they would count everything again.
    return rows.select("keep", F.explode_outer(F.array(made)).alias("made")).select("keep.*", "made.*")


def verdict(rules=RULES) -> str:
    """The rules as one condition; true where a text passes all of them."""
    tests = []
    for measure, low, high in rules:
        top, _, bottom = measure.partition(" / ")
        value = f"case when {bottom} = 0 then 0 else {top} / {bottom} end" if bottom else top
        tests += [f"{value} >= {low}"] * (low is not None) + [f"{value} <= {high}"] * (high is not None)
    return " and ".join(tests)


def judge(docs: DataFrame, rules=RULES, carry: list[str] = ("doc_id",)) -> DataFrame:
    """One row per document: its counts, base_failed and kept."""
    rows = measured(docs, carry)
    rows = rows.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    return rows.withColumn("kept", ~F.col("base_failed") & F.expr(verdict(rules)))


def duckdb_sql(rules=RULES) -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    space = r"\x20\x09-\x0D"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^{space}]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^{space}]')) AS lines
  FROM documents),
w AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
      FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM w) WHERE n > 1),
c AS (SELECT r, sum(least(3, coalesce(nxt - i, 3))) AS n
      FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM p) GROUP BY r),
m AS (
  SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words,
         len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
         len(list_filter(words, lambda x: regexp_matches(x, '\pL'))) AS n_letter_words,
         len(list_filter(lines, lambda l: regexp_matches(l, '^\s*[-*•]'))) AS n_bullet_lines,
         len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)\s*$'))) AS n_ellipsis_lines
  FROM d LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_lines::BIGINT AS n_lines, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_stop_words::BIGINT AS n_stop_words, n_letter_words::BIGINT AS n_letter_words,
       n_bullet_lines::BIGINT AS n_bullet_lines, n_ellipsis_lines::BIGINT AS n_ellipsis_lines,
       base_failed, NOT base_failed AND ({verdict(rules)}) AS kept
FROM b"""
