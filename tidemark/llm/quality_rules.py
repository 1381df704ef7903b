"""Quality rules: a table of thresholds compiled into one projection.

Each rule names a ratio of the text, the least and the greatest value it may have
and the least number of words from which it applies. The rules become one boolean
expression over built-in functions: no user functions, no shuffle, one pass.

Results in special cases: a null text counts as empty; a text without words has
zero counts and is rejected (fewer words than the base rule's least); rules on
ratios don't apply to it; rows that repeat are judged alike; an empty table gives
no rows; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import signals
from tidemark.llm.text_batches import column

SYMBOLS = "#*$%&|<>"

#: Base rules: fewest words, greatest share of words in repeated windows (per cent).
LEAST_WORDS, MOST_REPEATED = 10, 20


@dataclass(frozen=True)
class Rule:
    ratio: str
    least: float | None
    most: float | None
    from_words: int = 0


#: The thresholds, production values.
RULES = (
    Rule("mean_word_length", 2.5, 12.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("marks_per_word", None, 0.3),
    Rule("stop_words", 0.03, None, from_words=50),
    Rule("duplicate_lines", None, 0.5),
)


def ratios(text: Column, own: Column) -> dict[str, Column]:
    """The ratios that rules can name; ``own`` are the text's words."""
    n = F.size(own)
    lines = signals.lines_with_words(text)
    return {
        "mean_word_length": F.try_divide(F.col("word_chars"), n),
        "symbols_per_word": F.try_divide(F.col("n_symbols"), n),
        "marks_per_word": F.try_divide(signals.n_chars_of(text, "!"), n),
        "stop_words": F.try_divide(F.size(F.filter(own, lambda w: w.isin(signals.STOP_WORDS))), n),
        "duplicate_lines": F.try_divide(F.col("n_dup_lines"), F.size(lines)),
    }


def compiled(rules: tuple[Rule, ...], named: dict[str, Column], n_words: Column) -> Column:
    """True where every rule holds or doesn't apply."""
    verdict = F.lit(True)
    for rule in rules:
        value = named[rule.ratio]
        holds = F.lit(True)
        if rule.least is not None:
            holds &= value >= rule.least
        if rule.most is not None:
            holds &= value <= rule.most
        verdict &= (n_words < rule.from_words) | F.coalesce(holds, F.lit(True))
    return verdict


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    A kept column with the name of one of these is left out.
    """
    # Kept columns travel in a struct, so that no name they have can clash.
    kept = F.struct(*map(column, keep)) if keep else F.lit(None)
    split = docs.select(kept.alias("kept"), column(text).alias("text"), signals.words(column(text)).alias("words"))
    body, own = F.col("text"), F.col("words")
    counts = {
        "n_words": F.size(own).cast("long"),
        "word_chars": F.length(F.coalesce(body, F.lit(""))).cast("long") - signals.n_chars_of(body, signals.BLANKS),
        "n_symbols": signals.n_chars_of(body, SYMBOLS),
        "n_dup_lines": signals.n_dup_lines(signals.lines_with_words(body)),
        "n_repeat_words": signals.n_repeat_words(own),
    }
    counted = split.select("kept", "text", "words", *(c.alias(n) for n, c in counts.items()))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    judged = counted.withColumn("base_failed", base)
    verdict = ~F.col("base_failed") & compiled(rules, ratios(body, own), F.col("n_words"))
    made = [*counts, "base_failed"]
    return judged.select(*(F.col("kept").getField(c).alias(c) for c in keep if c not in (*made, "kept")), *made, verdict.alias("kept"))
