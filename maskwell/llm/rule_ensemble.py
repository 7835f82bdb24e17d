"""A quality classifier made of rules: trees give conjunctions over text statistics, a lasso picks and weighs them.

Statistics are column expressions. A forest of small trees is grown on a bounded sample; every path from a root to a node
is a rule, a conjunction of comparisons. A logistic regression with an L1 penalty over the rules leaves a few with
weights. These are compiled into one Spark column expression, so scoring is a projection without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, let, table, text_of
from .labelled import TRAIN_ROWS, held_out, training_rows

STATISTICS = ("words", "mean_word", "upper", "symbols", "bangs", "bars", "digits", "distinct", "repeats", "line_words", "distinct_lines")
TREES, DEPTH, CUTS, LASSO = 40, 3, 24, 2e-3


def statistics(text: Column) -> Column:
    """A struct of ``STATISTICS`` (double): counts and shares, all defined for an empty text."""
    share = lambda n, of: (n / F.greatest(of, F.lit(1))).cast("double")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))

    def of(w: Column) -> Column:
        n, chars = F.size(w), F.length(F.array_join(w, ""))
        lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)
        return F.struct(
            n.cast("double").alias("words"),
            share(chars, n).alias("mean_word"),
            share(count(r"\p{Lu}"), chars).alias("upper"),
            share(count(r"[#*$%&<>]"), chars).alias("symbols"),
            share(count("!"), chars).alias("bangs"),
            share(count(r"[|]"), n).alias("bars"),
            share(count("[0-9]"), chars).alias("digits"),
            share(F.size(F.array_distinct(w)), n).alias("distinct"),
            share(F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False)))), n).alias("repeats"),
            share(n, F.size(lines)).alias("line_words"),
            let(lines, lambda x: share(F.size(F.array_distinct(x)), F.size(x))).alias("distinct_lines"),
        )

    return let(F.array_remove(F.split(text, f"[{SPACE}]+"), ""), of)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether it must be at most the value, value)."""

    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, x):
        import numpy as np

        out = np.ones(len(x), bool)
        for k, low, value in self.parts:
            out &= (x[:, k] <= value) == low
        return out

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for k, low, value in self.parts:
            here = stats[STATISTICS[k]] <= F.lit(value)
            out = out & (here if low else ~here)
        return out


@dataclass
class Ensemble:
    rules: list[tuple[Rule, float]]
    intercept: float

    def column(self, stats: Column) -> Column:
        """The score as a column expression over a statistics struct."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def grown(x, y, rng, features: int) -> list[tuple[tuple[int, bool, float], ...]]:
    """All paths of one tree that splits by Gini gain, each split over a random choice of features."""
    import numpy as np

    paths = []

    def split(rows, path):
        n, ones = len(rows), int(y[rows].sum())
        if len(path) >= DEPTH or n < 10 or ones in (0, n):
            return
        best = (1e-9, None, None)
        for k in rng.choice(x.shape[1], features, replace=False):
            values = x[rows, k]
            cuts = np.unique(np.quantile(values, np.linspace(0, 1, CUTS + 2)[1:-1]))
            for c in cuts:
                low = values <= c
                m = int(low.sum())
                if m < 3 or n - m < 3:
                    continue
                p, q = y[rows][low].mean(), y[rows][~low].mean()
                gain = ones / n * (1 - ones / n) - m / n * p * (1 - p) - (n - m) / n * q * (1 - q)
                if gain > best[0]:
                    above = values[~low].min()
                    best = (gain, int(k), float((c + above) / 2))
        _, k, c = best
        if k is None:
            return
        for low in (True, False):
            here = (*path, (k, low, c))
            paths.append(here)
            split(rows[(x[rows, k] <= c) == low], here)

    split(rng.permutation(len(y))[: max(10, min(len(y), 4000))], ())
    return paths


def lasso(r, y, penalty: float, steps: int = 800):
    """Weights and intercept of an L1-penalised logistic regression, by accelerated proximal steps."""
    import numpy as np

    n = len(y)
    rate = 4.0 / max(1e-9, np.linalg.norm(np.c_[r, np.ones(n)], 2) ** 2 / n)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w, b = np.zeros(r.shape[1]), float(np.log(p / (1 - p)))
    v, c, t = w, b, 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-np.clip(r @ v + c, -30, 30))) - y
        g = v - rate * (r.T @ e / n)
        w2, b2 = np.sign(g) * np.maximum(np.abs(g) - rate * penalty, 0), c - rate * e.mean()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, float(b)


def fitted(x, y, seed: int = 8) -> Ensemble:
    """Rules from a forest, their weights from the lasso; a constant if there is only one label."""
    import numpy as np

    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return Ensemble([], float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    made: dict = {}
    for _ in range(TREES):
        for path in grown(x, y, rng, 4):
            rule = Rule(tuple(sorted(path)))
            made.setdefault(rule.holds(x).tobytes(), rule)  # one rule for each set of rows
    rules = [r for r in made.values() if 0 < r.holds(x).mean() < 1]
    if not rules:
        return Ensemble([], float(np.log(y.mean() / (1 - y.mean()))))
    w, b = lasso(np.array([r.holds(x) for r in rules], float).T, y, LASSO)
    return Ensemble([(r, float(a)) for r, a in zip(rules, w, strict=True) if abs(a) > 1e-6], b)


def learnt(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Ensemble:
    """An ensemble from at most ``most`` labelled rows that aren't held out."""
    import numpy as np

    rows = training_rows(docs, labels, "quality", most).select("label", statistics(F.col("text")).alias("s"))
    found = rows.select("label", *[F.col("s")[c].alias(c) for c in STATISTICS]).orderBy(*STATISTICS, "label").toArrow()  # at most `most` rows of numbers
    return fitted(np.array([found[c].to_numpy() for c in STATISTICS]).T, found["label"].to_numpy().astype(float))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts have the statistics of no words. Without both labels among the training rows, the score is the
    smoothed share of label 1 for all. Repeated rows give equal rows; an empty table gives none. Only ids and texts are
    read.
    """
    model = learnt(docs, labels, most)
    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), let(statistics(text_of()), model.column).alias("score"))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, in all their columns."""
    model = learnt(docs, labels, most)
    return docs.where(let(statistics(text_of()), model.column) >= threshold)


def op8_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
