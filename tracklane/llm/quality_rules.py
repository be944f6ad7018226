"""Quality rules as a short-circuit cascade, in DataFrame operations only.

A document is rejected by the first rule that it breaks, and later rules aren't evaluated for it. The order is
measured on a seeded sample: a rule's cost in time, and its share of rejected documents among those that the rules
before it let pass; the rule that rejects most per cost comes next. The order changes what is computed, never the
verdict. Words are split once, as every rule needs their number.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.llm.common import WORD, documents, let, stored

#: Documents of the sample on which the order is measured; it decides nothing else. How often each cost is measured.
SAMPLE_ROWS, TIMES = 2_000, 3
# The contract's symbols and windows.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``broken`` holds for a document to reject; null counts as not broken."""

    name: str
    broken: Column


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def n_of(text: Column, characters: str) -> Column:
    """How often ASCII ``characters`` occur, by the bytes that are left without them."""
    return (F.octet_length(text) - F.octet_length(without(text, characters))).cast("long")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(F.filter(F.split(text, "\n"), lambda x: F.length(without(x, BLANKS)) > 0), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words in windows of eight words that occur twice or more in the text, the first time included.

    Windows are compared by 64-bit hashes. Most texts repeat nothing, which a set of the hashes shows; only for others
    are the windows sorted, to find those with an equal neighbour, and their stretches added up.
    """

    def covered(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        starts = let(ordered, lambda s: F.array_sort(F.transform(again(s), lambda x: x["i"])))
        gaps = let(starts, lambda s: F.transform(s, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(x - F.get(s, k - 1), F.lit(WINDOW)))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    windows = let(hashes(words), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
    count = let(windows, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), 0).otherwise(covered(x)))
    return F.when(F.size(words) > WINDOW, count).otherwise(0).cast("long")


def base_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and the contract's figures; a null text counts as empty. Names that exist are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.withColumns({"_text": text, "_words": words_of(text)})
    text = F.col("_text")
    return first.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(without(text, BLANKS)).cast("long"),
        "n_symbols": n_of(text, SYMBOLS),
        "n_dup_lines": n_dup_lines(text),
        "n_repeat_words": n_repeat_words(F.col("_words")),
    }).drop("_words", "_text")


def rules_over(n_words: Column, n_repeat_words: Column, n_symbols: Column, n_shouts: Column, word_chars: Column) -> list[Rule]:
    """The rules over given figures; the first two are the contract's base."""
    return [
        Rule("few_words", n_words < 20),
        Rule("repeated_words", 100 * n_repeat_words > 30 * n_words),
        Rule("symbols", 10 * n_symbols > n_words),
        Rule("shouting", 10 * n_shouts > n_words),
        Rule("word_length", (word_chars < 2 * n_words) | (word_chars > 15 * n_words)),
    ]


def text_rules(text: Column, words: Column) -> list[Rule]:
    """The rules over a text and its words, each of which computes only what it needs."""
    return rules_over(F.size(words), n_repeat_words(words), n_of(text, SYMBOLS), n_of(text, "!"), F.length(without(text, BLANKS)))


def split_once(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, list[Rule]]:
    """``docs`` with its texts and their words as ``_text`` and ``_words``, and the rules over these."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"_text": text, "_words": words_of(text)}), text_rules(F.col("_text"), F.col("_words"))


def by_rejection_per_cost(cost: dict[str, float], patterns: dict[tuple[str, ...], int]) -> list[str]:
    """The rules, each time the one that rejects the largest share of what is left per cost.

    ``patterns``: how many documents break exactly these rules. Costs count by their power of two and equals go by
    name, so that an unsteady clock rarely changes the order.
    """
    order, left = [], dict(patterns)
    while len(order) < len(cost):
        total = max(sum(left.values()), 1)
        gain = {n: sum(k for p, k in left.items() if n in p) / total / 2.0 ** round(log2(max(c, 1e-6))) for n, c in cost.items() if n not in order}
        order.append(min(gain, key=lambda n: (-gain[n], n)))
        left = {p: k for p, k in left.items() if order[-1] not in p}
    return order


def measured_order(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 5) -> list[str]:
    """The order of the rules for ``docs``, measured on a sample; no rows give the order by name.

    A rule's cost is the least of several times, without that of a job that evaluates no rule. The driver gets a count
    for each set of rules that documents break.
    """
    count = docs.count()
    sample = stored(docs.select(text_col).sample(fraction=min(1.0, sample_rows / max(count, 1)), seed=seed).coalesce(64), "rules_sample")
    split, rules = split_once(sample, text_col)
    split = stored(split.select("_text", "_words").coalesce(4), "rules_words")

    def seconds(broken: Column) -> float:
        job, times = split.agg(F.count(F.when(broken, 1))), []
        for _ in range(1 + TIMES):  # the first compiles
            began = time.perf_counter()
            job.collect()
            times.append(time.perf_counter() - began)
        return min(times[1:])

    flags = [F.when(r.broken, F.lit(r.name)) for r in rules]
    found = split.select(F.array_compact(F.array(*flags)).alias("broken")).groupBy("broken").count().collect()  # 2 ** rules at most
    none = seconds((F.octet_length("_text") < 0) | (F.size("_words") < 0))
    return by_rejection_per_cost({r.name: max(seconds(r.broken) - none, 1e-3) for r in rules}, {tuple(r["broken"]): r["count"] for r in found})


def cascade(rows: DataFrame, rules: list[Rule], order: list[str], name: str = "rejected_by") -> DataFrame:
    """``rows`` with the name of the rule that rejects each, null if it is kept.

    Rules are nested in the given order, so that a rule is evaluated only for what earlier ones let pass. A rule that
    is null for a row doesn't reject it. No rows give no rows; all other columns stay.
    """
    by_name = {r.name: r for r in rules}
    verdict = F.lit(None).cast("string")
    for n in reversed(order):
        verdict = F.when(F.coalesce(by_name[n].broken, F.lit(False)), F.lit(n)).otherwise(verdict)
    return rows.withColumn(name, verdict)


def judge(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``rejected_by``, by the rules over the text in the order measured on a sample."""
    order = measured_order(docs, text_col, sample_rows)
    split, rules = split_once(docs, text_col)
    return cascade(split, rules, order).drop("_text", "_words")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    # The contract's figures are wanted of every row; what only the method's own rules need is computed if they are reached
    figures = (F.col(c) for c in ("n_words", "n_repeat_words", "n_symbols"))
    rules = rules_over(*figures, n_of(F.coalesce(F.col("text"), F.lit("")), "!"), F.col("word_chars"))
    done = cascade(base_measures(docs), rules, measured_order(docs))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))
