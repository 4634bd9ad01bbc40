"""Quality rules learned as a decision list.

Every text gets a row of statistics. Sequential covering then learns rules for poor texts from labelled statistics: a rule
is grown by adding the threshold condition with the highest information gain, pruned on rows kept apart, and its rows are
taken out before the next rule. The list is emitted as one ordered Spark expression: the first rule that holds decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_columns

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Capital letters of Latin scripts.
_UPPER = re.compile("[A-Z\u00c0-\u00d6\u00d8-\u00de]")
#: Statistics of a text, in the order of the result; all are whole numbers.
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_stops", "n_marks", "n_distinct_words", "longest_word"]
#: Ratios the rules use, as SQL over the statistics, so that thresholds hold for texts of any length.
FEATURES = {
    "n_words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "stops_per_word": "n_stops / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "longest_word": "longest_word",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def _repeat_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: set = set()
    twice: set = set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    covered, reach = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + 3 - max(i, reach)
            reach = i + 3
    return covered


def text_statistics(text: str | None) -> tuple[int, ...]:
    """STATISTICS of one text; null and empty texts have none (all 0)."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeat_words(words),
        len(lines),
        len(_UPPER.findall(text)),
        sum(map(text.count, "0123456789")),
        sum(map(text.count, ".,;:")),
        sum(map(text.count, "!?")),
        len(set(words)),
        max(map(len, words), default=0),
    )


def with_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns of keep and the statistics of each whole text, in one pass and without a shuffle."""

    def stats(texts: list[str | None]) -> np.ndarray:
        return np.array([text_statistics(t) for t in texts], dtype=np.int64).reshape(len(texts), len(STATISTICS)).T

    return map_columns(docs, keep, [F.col(text_col)], [(s, "long") for s in STATISTICS], stats)


@dataclass(frozen=True)
class Condition:
    """feature <= limit, or > limit."""

    feature: str
    above: bool
    limit: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.limit if self.above else x[self.feature] <= self.limit

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.limit!r}D"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best_condition(x: dict[str, np.ndarray], poor: np.ndarray, steps: int) -> tuple[float, Condition | None]:
    """The condition of highest gain: poor rows kept times the rise of the log share of poor rows."""
    p, n = poor.sum(), len(poor)
    base, best, found = np.log2((p + 1) / (n + 2)), 0.0, None
    for name, v in x.items():
        limits = np.unique(np.quantile(v, np.linspace(0, 1, steps + 1)[:-1], method="lower"))
        order = np.argsort(v, kind="stable")
        below_n = np.searchsorted(v[order], limits, side="right")
        below_p = np.concatenate([[0], np.cumsum(poor[order])])[below_n]
        for above, kept_n, kept_p in ((False, below_n, below_p), (True, n - below_n, p - below_p)):
            gain = kept_p * (np.log2((kept_p + 1) / (kept_n + 2)) - base)
            k = int(np.argmax(gain))
            if gain[k] > best + 1e-9:
                best, found = float(gain[k]), Condition(name, above, float(limits[k]))
    return best, found


def learn(x: dict[str, np.ndarray], poor: np.ndarray, max_rules: int = 24, max_conditions: int = 4, steps: int = 48, precision: float = 0.75, least: int = 4, seed: int = 5) -> list[Rule]:
    """Rules for poor rows, in order. A rule must be right on `precision` of the rows it takes, growing and pruning rows apart, and take `least` at least."""
    rng = np.random.default_rng(seed)
    left, rules = np.arange(len(poor)), []
    while len(rules) < max_rules and poor[left].any():
        mixed = rng.permutation(left)
        cut = max(1, len(mixed) * 2 // 3)
        grow, prune = mixed[:cut], mixed[cut:]
        rule: Rule = ()
        rows = grow
        while len(rule) < max_conditions and len(rows) and not poor[rows].all():
            _, c = _best_condition({k: v[rows] for k, v in x.items()}, poor[rows], steps)
            if c is None or c in rule:
                break
            rule += (c,)
            rows = rows[c.holds({k: v[rows] for k, v in x.items()})]
        if not rule:
            break

        def worth(r: Rule, rows: np.ndarray = prune) -> float:
            took = _covered(r, {k: v[rows] for k, v in x.items()}, len(rows))
            good = poor[rows][took].sum()
            return (2 * good - took.sum()) / max(1, took.sum())

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        took = _covered(rule, {k: v[left] for k, v in x.items()}, len(left))
        right = poor[left][took].sum()
        if took.sum() < least or right < precision * took.sum() or worth(rule) < 2 * precision - 1 - 0.25:
            break
        rules.append(rule)
        left = left[~took]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered conditional expression over the statistics: false at the first rule that holds, else true."""
    out = None
    for rule in rules:
        holds = F.expr(" AND ".join(c.sql() for c in rule))
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most_rows: int = 12_000, **options) -> list[Rule]:
    """Learns a list from at most `most_rows` labelled documents, those of the lowest hash of the id.

    Only this bounded sample of labels is broadcast, and only its statistics reach the driver. Ids labelled twice count once, with
    the lower label; null labels and ids are left out. Without labels, or without poor texts, the list is empty and keeps everything.
    """
    sample = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_label"))
    sample = sample.orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    got = with_statistics(rows, ["_id", "_label"], "_text").selectExpr("_id", "_label", *[f"double({e}) AS {k}" for k, e in FEATURES.items()]).toPandas()
    got = got.drop_duplicates().sort_values(["_id", *FEATURES]).reset_index(drop=True)
    return learn({k: got[k].to_numpy() for k in FEATURES}, (got["_label"] == 0).to_numpy(), **options)


def judged(docs: DataFrame, rules: list[Rule], keep: list[str], text_col: str = "text") -> DataFrame:
    """keep's columns, the statistics, base_failed and kept for every row.

    base_failed: under 50 words, or over half of the words in repeated windows. Null and empty texts have 0 words, so they fail.
    """
    rows = with_statistics(docs, keep, text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
