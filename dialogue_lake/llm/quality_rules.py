"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

A missing text counts as empty, an empty text has no words and fails, repeated rows are
judged one by one, and columns other than the text are never looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogue_lake.llm import textual as tx

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8

#: Common words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that it was for on are as with they be at from or this by not but what all were "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son "
    "el y los del las por con no su para al lo como más pero sus o este sí porque esta entre cuando"
).split()


@dataclass(frozen=True)
class Rule:
    """A document of at least ``from_words`` words passes while low <= measure <= high."""

    name: str
    measure: str
    low: float = float("-inf")
    high: float = float("inf")
    from_words: int = 0


RULES = (
    Rule("some_words", "n_words", low=20),
    Rule("repeated_text", "repeat_ratio", high=0.3),
    Rule("word_length", "mean_word", low=1.5, high=15),
    Rule("symbols", "symbol_ratio", high=0.25),
    Rule("shouts", "shout_ratio", high=0.4),
    Rule("stop_words", "stop_ratio", low=0.01, from_words=60),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("capitals", "capital_ratio", high=0.6, from_words=20),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def measured(df: DataFrame, text: str = "text", prefix: str = "_q_") -> DataFrame:
    """``df`` with the measures of each text, under ``prefix``."""
    p = lambda name: f"{prefix}{name}"
    c = lambda name: F.col(p(name))
    body = tx.whole(text)
    df = df.withColumns({
        p("words"): tx.words(body),
        p("lines"): F.filter(F.split(body, "\n"), lambda x: x.rlike(tx.WORD)),
    })
    df = df.withColumn(p("windows"), F.transform(c("words"), lambda x: F.xxhash64(x)))
    # Hashes of 2, 4 and 8 consecutive words, each from two of the step before.
    for step in (1, 2, 4):
        later = F.slice(c("windows"), step + 1, F.greatest(F.size(c("windows")) - step, F.lit(0)))
        first = F.slice(c("windows"), 1, F.greatest(F.size(c("windows")) - step, F.lit(0)))
        df = df.withColumn(p("windows"), F.zip_with(first, later, lambda a, b: F.xxhash64(a, b)))
    df = df.withColumns({
        p("n_words"): F.size(c("words")).cast("long"),
        p("word_chars"): F.length(F.array_join(c("words"), "")).cast("long"),
        p("n_symbols"): (F.length(body) - F.length(F.regexp_replace(body, f"{SYMBOLS}+", ""))).cast("long"),
        p("n_dup_lines"): (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
        p("n_lines"): F.size(c("lines")).cast("long"),
        p("n_shouts"): F.regexp_count(body, F.lit("!!")).cast("long"),
        p("n_capitals"): F.regexp_count(body, F.lit(r"[A-Z]{2}")).cast("long"),
        p("n_stop"): F.size(F.filter(c("words"), lambda x: F.lower(x).isin(STOP_WORDS))).cast("long"),
    })
    repeats = F.size(F.array_distinct(c("windows"))) < F.size(c("windows"))
    df = df.withColumn(p("sorted"), F.when(repeats, F.sort_array(
        F.transform(c("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: F.get(c("sorted"), i).h.eqNullSafe(x.h)
    df = df.withColumn(p("starts"), F.sort_array(F.transform(
        F.filter(c("sorted"), lambda x, i: ((i > 0) & same(x, i - 1)) | same(x, i + 1)), lambda x: x.i)))
    # A repeated window adds the words up to the next repeated window.
    covered = F.aggregate(
        F.transform(c("starts"), lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(c("starts"), i + 1) - s, F.lit(WINDOW)))),
        F.lit(0), lambda total, x: total + x)
    df = df.withColumn(p("n_repeat_words"), F.coalesce(covered, F.lit(0)).cast("long"))
    df = df.withColumns({
        p("repeat_ratio"): _ratio(c("n_repeat_words"), c("n_words")),
        p("mean_word"): _ratio(c("word_chars"), c("n_words")),
        p("symbol_ratio"): _ratio(c("n_symbols"), c("n_words")),
        p("shout_ratio"): _ratio(c("n_shouts"), c("n_words")),
        p("stop_ratio"): _ratio(c("n_stop"), c("n_words")),
        p("dup_line_ratio"): _ratio(c("n_dup_lines"), c("n_lines")),
        p("capital_ratio"): _ratio(2 * c("n_capitals"), c("word_chars")),
    })
    return df.drop(*(p(x) for x in ("words", "lines", "windows", "sorted", "starts")))


def verdict(rules: tuple[Rule, ...] = RULES, prefix: str = "_q_") -> Column:
    """The threshold table as one boolean expression over the measures."""
    passes = []
    for rule in rules:
        value = F.col(f"{prefix}{rule.measure}")
        bounds = [value >= rule.low] * (rule.low > float("-inf")) + [value <= rule.high] * (rule.high < float("inf"))
        passes.append(tx.all_of(bounds) | (F.col(f"{prefix}n_words") < rule.from_words))
    return tx.all_of(passes)


def base_failed(prefix: str = "_q_") -> Column:
    n, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 20) | (100 * repeated > 30 * n)


def kept_rows(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows whose text passes every rule, with the columns of ``df``.

    The verdict is written before rows are filtered by it: Catalyst would otherwise push the
    filter through the projections and copy each measure into every place that uses it.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    judged = tx.stored(measured(df, text).select(*columns, (~base_failed() & verdict(rules)).alias("_q_kept")), "quality-verdicts")
    return judged.filter("_q_kept").select(*columns)
