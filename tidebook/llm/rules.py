"""Quality rules on whole texts, judged by a short-circuit cascade. Built-in functions only."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, text_of

SPACES = " \t\n\v\f\r"
WINDOW = 8


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word).

    n_repeat_words counts words in windows of eight words that the text has twice or more. Windows are compared as
    64-bit hashes, sorted only for texts in which one recurs. A null text has no words. Columns of these names are
    replaced. No row is shuffled.
    """
    at = lambda a, i: F.get(a, i)
    d = docs.withColumn("_text", text_of()).withColumn("_words", words_of(F.col("_text")))
    d = d.withColumn("_lines", F.filter(F.split(F.col("_text"), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    # Each array is used more than once where it is read in a lambda, so the optimizer keeps it computed once.
    d = d.withColumn("_hash", F.transform("_words", lambda x: F.xxhash64(x)))
    d = d.withColumn("_win", F.when(F.size("_hash") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("_hash") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_hash"), i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    recurs = F.size(F.array_distinct("_win")) < F.size("_win")
    d = d.withColumn("_sorted", F.when(recurs, F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twice = F.filter(F.col("_sorted"), lambda x, k: (x["h"] == at(F.col("_sorted"), k + 1)["h"]) | (x["h"] == at(F.col("_sorted"), F.when(k > 0, k - 1).otherwise(F.size("_sorted")))["h"]))
    d = d.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("_at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(at(F.col("_at"), k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return d.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(F.col("_text"), F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": covered.cast("long"),
            "n_lines": F.size("_lines").cast("long"),
        }
    ).drop("_text", "_words", "_lines", "_hash", "_win", "_sorted", "_at")




def default_rules() -> dict[str, Column]:
    """Each rule is true for a document that it rejects.

    symbols: over a symbol for every ten words. dup_lines: over 30 % of the lines repeat an earlier one. word_length:
    the mean word is under 2 or over 15 characters. shouting: over half as many all-upper-case runs of three letters
    as words. stretched: a word of over 1,000 characters.
    """
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") * 10 > n,
        "dup_lines": F.col("n_dup_lines") * 10 > F.col("n_lines") * 3,
        "word_length": (F.col("word_chars") < n * 2) | (F.col("word_chars") > n * 15),
        "shouting": F.regexp_count(text_of(), F.lit(r"\b\p{Lu}{3,}\b")) * 2 > n,
        "stretched": text_of().rlike(r"[^\x20\x09-\x0D]{1001}"),
    }


def rule_order(docs: DataFrame, rules: dict[str, Column], sample_rows: int = 2_000, seed: int = 7) -> list[dict]:
    """The rules by falling rejection per cost, as seen on a sample of about sample_rows rows of docs.

    Cost is the time that a pass over the sample takes with the rule, less that of a pass without one. The sample only
    sets the order; every rule still holds for every document, so no verdict depends on it.
    """
    n = docs.count()
    if not n:
        return [{"rule": name, "rejects": 0.0, "cost_s": 0.0} for name in rules]
    held = kept(measured(docs.sample(fraction=min(1.0, sample_rows / n), seed=seed)), "rules-sample").cache()
    rows = max(1, held.count())

    def timed(rule: Column) -> tuple[float, int]:
        began = time.perf_counter()
        hits = held.agg(F.count_if(rule).alias("n")).first()["n"]
        return time.perf_counter() - began, hits

    timed(F.lit(False))
    idle = timed(F.lit(False))[0]
    found = []
    for name, rule in rules.items():
        timed(rule)  # compiles it
        seconds, hits = timed(rule)
        found.append({"rule": name, "rejects": hits / rows, "cost_s": max(seconds - idle, 1e-4)})
    held.unpersist()
    return sorted(found, key=lambda x: (-x["rejects"] / x["cost_s"], x["cost_s"], x["rule"]))


def cascade(rules: dict[str, Column], order: list[str]) -> Column:
    """The first rule, in this order, that rejects a row; null if none does. Later rules aren't evaluated then."""
    chain = reduce(lambda c, name: (c.when if c is not None else F.when)(rules[name], F.lit(name)), order, None)
    return chain if chain is not None else F.lit(None).cast("string")


def judge(docs: DataFrame, rules: dict[str, Column] | None = None, sample_rows: int = 2_000) -> DataFrame:
    """docs with the columns of measured(), base_failed, failed_rule and kept.

    base_failed: under 20 words, or over 30 % of the words in windows that recur. failed_rule: null where base_failed
    or where no rule rejects; which of several rejecting rules it names depends on the measured order, kept doesn't.
    Empty and null texts fail the base; repeated rows and equal texts are judged alike, rules of equal order by name; a very
    long text is judged whole. Columns of the result's names are replaced. An empty table stays empty.
    """
    rules = default_rules() if rules is None else rules
    order = [x["rule"] for x in rule_order(docs, rules, sample_rows)]
    d = measured(docs)
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    d = d.withColumn("base_failed", base).withColumn("failed_rule", F.when(~F.col("base_failed"), cascade(rules, order)))
    return d.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())
