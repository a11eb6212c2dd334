"""Quality rules: a table of thresholds compiled into one projection.

All measures of a text come from its array of words and its array of lines with higher-order
functions, so one narrow projection over the scan computes and judges them: no shuffle, no user
function, nothing that another row could weigh on.  ``RULES`` is plain data; :func:`compiled`
turns any such table into the boolean expression.

Repeated five-word windows are found by sorting: windows with their places are sorted, equal
neighbours are the repeated ones, and the words they cover are counted from the sorted places.
That costs ``n log n`` for a text of ``n`` words; texts whose window hashes are all distinct skip it.

Defined results: null and empty texts have no words, fail the base rules and are not kept; a share
whose denominator is zero is zero; ties and repeated rows are judged alike; other columns stay.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrortab.llm.common import query, table, text_or_empty

#: White space that separates words.  Fixed values.
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
NOT_BLANK = r"[^\x20\x09-\x0D]"

#: Base limits of the contract.
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5

#: Frequent function words of English, German, Spanish and French.
STOP_WORDS = tuple(sorted(set(
    "the of and to in a is that for it as was with be by on not at this are from or an which "
    "der die und das von zu den mit ist des sich auf für im dem nicht ein eine als auch es "
    "de la que el en y los del las un por con no una su para al lo como "
    "le les et à est pour dans ce qui ne sur pas plus par au".split()
)))


@dataclass(frozen=True)
class Rule:
    """``least <= measure <= most`` for texts of ``from_words`` words or more."""

    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: Symbols a word, share of repeated lines, mean word length, share of stop words, words.
RULES = (
    Rule("n_words", least=MIN_WORDS, most=1e9),
    Rule("mean_word_chars", least=2, most=12),
    Rule("symbols_per_word", most=0.1),
    Rule("dup_line_share", most=0.5, from_words=20),
    Rule("stop_word_share", least=0.05, from_words=50),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more."""
    gram = lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(WINDOW)])
    short = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, s: a + s)

    def sorted_way(windows: Column) -> Column:
        repeated = F.filter(windows, lambda w, k: F.coalesce(
            (k > 0) & (F.get(windows, F.greatest(k - 1, F.lit(0)))["g"] == w["g"]), F.lit(False)
        ) | F.coalesce(F.get(windows, k + 1)["g"] == w["g"], F.lit(False)))
        return let(F.sort_array(F.transform(repeated, lambda w: w["i"])), covered)

    exact = let(F.sort_array(F.transform(starts, lambda i: F.struct(gram(i).alias("g"), i.alias("i")))), sorted_way)
    all_differ = let(F.transform(starts, short), lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("bigint")).when(all_differ, F.lit(0).cast("bigint")).otherwise(exact)


def measures(text: Column) -> Column:
    """A struct of counts and shares of a text."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_BLANK))
    long = lambda c: c.cast("bigint")
    of_words = let(words, lambda w: F.struct(
        long(F.size(w)).alias("n_words"),
        long(F.char_length(F.array_join(w, ""))).alias("word_chars"),
        _repeated_words(w).alias("n_repeat_words"),
        long(F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS)))).alias("n_stop_words"),
    ))
    of_lines = let(lines, lambda x: F.struct(
        long(F.size(x)).alias("n_lines"), long(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")
    ))
    counted = F.struct(of_words.alias("w"), of_lines.alias("l"), long(F.regexp_count(text, F.lit(SYMBOLS))).alias("n_symbols"))
    return let(counted, lambda c: F.struct(
        *[c["w"][k].alias(k) for k in ("n_words", "word_chars", "n_repeat_words", "n_stop_words")],
        *[c["l"][k].alias(k) for k in ("n_lines", "n_dup_lines")],
        c["n_symbols"].alias("n_symbols"),
        share(c["w"]["word_chars"], c["w"]["n_words"]).alias("mean_word_chars"),
        share(c["n_symbols"], c["w"]["n_words"]).alias("symbols_per_word"),
        share(c["l"]["n_dup_lines"], c["l"]["n_lines"]).alias("dup_line_share"),
        share(c["w"]["n_stop_words"], c["w"]["n_words"]).alias("stop_word_share"),
    ))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * REPEAT_PERCENT)


def compiled(rules, m: Column) -> Column:
    """True where every rule of the table holds for the measures ``m``."""
    verdict = F.lit(True)
    for rule in rules:
        value, holds = m[rule.measure], F.lit(True)
        if rule.least is not None:
            holds = holds & (value >= rule.least)
        if rule.most is not None:
            holds = holds & (value <= rule.most)
        verdict = verdict & (holds | (m["n_words"] < rule.from_words)) if rule.from_words else verdict & holds
    return verdict


def judged(docs: DataFrame, rules=RULES, text: str = "text", to: str = "quality_rules") -> DataFrame:
    """``docs`` with a struct column ``to``: all measures, ``base_failed`` and ``kept``.

    A column that is called ``to`` already is replaced.
    """
    return docs.withColumn(to, let(measures(text_or_empty(text)), lambda m: F.struct(
        m.alias("measures"), base_failed(m).alias("base_failed"), (~base_failed(m) & compiled(rules, m)).alias("kept")
    )))


_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)

SQL_QUALITY = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l,
    len(regexp_extract_all(coalesce(text, ''), '{SYMBOLS}')) AS n_symbols
  FROM documents
),
g AS (
  SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
    len(list_filter(w, lambda x: lower(x) IN ({_LIST}))) AS n_stop
  FROM d LEFT JOIN c USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND word_chars >= 2 * n_words AND word_chars <= 12 * n_words AND n_symbols <= 0.1 * n_words
    AND (n_words < 20 OR n_lines = 0 OR n_dup_lines <= 0.5 * n_lines)
    AND (n_words < 50 OR n_stop >= 0.05 * n_words) AS kept
FROM m
"""


@query("op8_quality_rules", SQL_QUALITY)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    q = F.col("quality_rules")
    return found.select(
        "doc_id",
        *[q["measures"][k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        q["base_failed"].alias("base_failed"), q["kept"].alias("kept"),
    )
