"""Lemmas by rules of endings that are learned from pairs of form and lemma.

A pair shows a rule: the ending that goes and what comes in its place, after the longest common beginning. Each ending of a form that holds the
part that goes votes for the pair's rule, up to `most` letters, and so does the whole form, marked by ^. An ending keeps the rule with most votes, unless the ending
without its first letter says the same. A word takes the rule of its longest ending that has one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Endings that are sent to every task if all rules are at most so many; beyond it only those of up to SHORT letters, which many words share, if these are at most so many.
SENT, SHORT = 200_000, 3


def _endings(word: Column, most: int) -> Column:
    """Endings of ^word of 0 to `most` letters, and ^word itself."""
    whole = F.concat(F.lit("^"), word)
    n = F.length(word)
    some = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(most))), lambda k: F.substr(word, n - k + 1, k))
    return F.array_append(some, whole)


def _change(form: Column, lemma: Column) -> Column:
    """What goes from the form's end and what comes."""
    lengths = F.sequence(F.lit(0), F.least(F.length(form), F.length(lemma)))
    same = F.array_max(F.filter(lengths, lambda k: F.left(form, k) == F.left(lemma, k)))
    return F.struct(F.substr(form, same + 1, F.length(form)).alias("goes"), F.substr(lemma, same + 1, F.length(lemma)).alias("comes"))


def learn(pairs: DataFrame, keys: Sequence[str] = (), least: int = 2, most: int = 8) -> DataFrame:
    """Rules (keys, ending, goes, comes) from pairs (keys, form, lemma), for instance with a part of speech as key.

    Repeated pairs count as often as they stand; endings need `least` votes for their rule, whole forms one. Ties: what takes fewer letters away, then by letters. Case is
    ignored. Pairs with a null or an empty form, or a null lemma, are left out.
    """
    keys = list(keys)
    known = pairs.select(*keys, F.lower("form").alias("form"), F.lower("lemma").alias("lemma")).filter("form <> '' AND lemma IS NOT NULL")
    counted = known.groupBy(*keys, "form", "lemma").agg(F.count(F.lit(1)).alias("n"))
    votes = counted.withColumn("c", _change(F.col("form"), F.col("lemma"))).select(*keys, "n", "c.*", F.explode(_endings(F.col("form"), most)).alias("ending"))
    fitting = votes.filter(F.col("ending").endswith(F.col("goes")))
    sums = fitting.groupBy(*keys, "ending", "goes", "comes").agg(F.sum("n").alias("n"))
    first = F.struct(-F.col("n"), F.length("goes"), "goes", "comes")
    best = sums.groupBy(*keys, "ending").agg(F.min_by(F.struct("goes", "comes", "n"), first).alias("x")).select(*keys, "ending", "x.*")
    best = best.filter((F.col("n") >= least) | F.col("ending").startswith("^"))
    # an ending's parent lacks its first letter; a whole form's lacks the mark, or is its longest ending
    up = F.when(F.col("ending").startswith("^"), F.when(F.length("ending") > most + 1, F.substr("ending", F.length("ending") - most + 1, F.lit(most))).otherwise(F.substr("ending", F.lit(2)))).otherwise(F.substr("ending", F.lit(2)))
    parents = best.select(*keys, F.col("ending").alias("_up"), F.col("goes").alias("_goes"), F.col("comes").alias("_comes"))
    said = best.withColumn("_up", F.when(F.col("ending") != "", up)).join(parents, [*keys, "_up"], "left")
    return said.filter(F.col("_goes").isNull() | (F.col("_goes") != F.col("goes")) | (F.col("_comes") != F.col("comes"))).select(*keys, "ending", "goes", "comes")


def lemmas(words: DataFrame, rules: DataFrame, keys: Sequence[str] = (), most: int = 8, column: str = "word") -> DataFrame:
    """(keys, word, lemma) of each distinct word; one that no rule fits is its own lemma, in lower case. Null words are left out. `most` as in `learn`.

    Rules are broadcast if they were counted to be few; else only short endings, which many words share, are, and long ones are joined by the ending.
    """
    keys = list(keys)
    distinct = words.select(*keys, F.col(column).alias("word")).filter("word IS NOT NULL").distinct()
    each = distinct.select(*keys, "word", F.explode(_endings(F.lower("word"), most)).alias("ending"))
    short = F.length("ending") <= SHORT
    if rules.limit(SENT + 1).count() <= SENT:
        hits = each.join(F.broadcast(rules), [*keys, "ending"])
    else:
        shorts = rules.filter(short)
        shorts = F.broadcast(shorts) if shorts.limit(SENT + 1).count() <= SENT else shorts
        hits = each.filter(short).join(shorts, [*keys, "ending"]).unionByName(each.filter(~short).join(rules.filter(~short), [*keys, "ending"]))
    best = hits.groupBy(*keys, "word").agg(F.max_by(F.struct("goes", "comes"), F.length("ending")).alias("x"))
    low = F.lower("word")
    made = F.concat(F.left(low, F.length(low) - F.length("x.goes")), F.col("x.comes"))
    # a rule that would leave nothing is not taken
    return distinct.join(best, [*keys, "word"], "left").select(*keys, "word", F.when(made != "", made).otherwise(low).alias("lemma"))


def attested_pairs(words: DataFrame, guesses: Column, column: str = "word") -> DataFrame:
    """Pairs (form, lemma) that a vocabulary itself bears out: each distinct word with those of its guessed lemmas (an array of strings) that are words of it too, itself among them only where no other is."""
    known = words.select(F.lower(column).alias("form")).filter("form <> ''").distinct()
    guessed = known.select("form", F.explode(F.array_distinct(guesses)).alias("lemma")).filter("lemma <> form")
    found = guessed.join(known.withColumnRenamed("form", "lemma"), "lemma", "left_semi").select("form", "lemma")
    own = known.join(found, "form", "left_anti").select("form", F.col("form").alias("lemma"))
    return found.unionByName(own)
