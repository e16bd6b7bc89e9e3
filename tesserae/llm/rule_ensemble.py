"""Quality scores from a sparse ensemble of rules.

Statistics of a text are Spark columns. Shallow trees are grown on a bounded sample of labelled rows; each
path from a root to a node is a rule, a conjunction of thresholds. A logistic regression with an L1 penalty
weighs the rules and leaves most at zero. What is left is compiled into one Spark column expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import held_out, let, save, without_white, words
from tesserae.llm.statistics import SYMBOLS, count_of, dup_lines


#: The statistics, in the order in which models name them.
NAMES = ("log_words", "word_length", "symbols", "exclamations", "digits", "upper", "stops", "lines", "dup_lines", "distinct_words", "adjacent_repeats")


def with_statistics(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the statistics of ``text`` in its place, none null; a null text is an empty one. A text is split once."""
    body = F.coalesce(F.col(text), F.lit(""))
    again = lambda w: F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False))))
    of_words = let(words(body), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), again(w).alias("again")))
    of_chars = {"all": F.char_length(body), "black": F.char_length(without_white(body)), "upper": F.regexp_count(body, F.lit(r"\p{Lu}"))}
    of_chars |= {k: count_of(body, c) for k, c in {"symbols": SYMBOLS, "exclamations": "!?", "digits": "0123456789", "stops": ".,;:", "lines": "\n"}.items()}
    counted = rows.withColumns({"_w": of_words, "_dup_lines": dup_lines(body), **{f"_{k}": c for k, c in of_chars.items()}})
    at_least_1 = lambda c: F.greatest(c, F.lit(1)).cast("double")
    chars, n = at_least_1(F.col("_all")), at_least_1(F.col("_w.n"))
    shares = {"log_words": F.log1p(F.col("_w.n").cast("double")), "word_length": F.col("_black") / n}
    shares |= {k: F.col(f"_{k}") / chars for k in ("symbols", "exclamations", "digits", "upper")} | {k: F.col(f"_{k}") / n for k in ("stops", "lines", "dup_lines")}
    shares |= {"distinct_words": F.col("_w.distinct") / n, "adjacent_repeats": F.col("_w.again") / n}
    return counted.select(*[c for c in rows.columns if c != text], *[shares[k].alias(k) for k in NAMES])


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, is_greater, threshold) that must all hold."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, greater, limit in self.conditions:
            out &= F.col(name) > F.lit(limit) if greater else F.col(name) <= F.lit(limit)
        return out


_BRANCH = re.compile(r"^(\s*)(If|Else) \(feature (\d+) (<=|>) ([^)]+)\)")


def tree_rules(description: str, names: list[str]) -> list[Rule]:
    """One rule for each branch of the trees in a model's ``toDebugString``."""
    path: list[tuple[int, tuple[str, bool, float]]] = []
    rules = []
    for line in description.splitlines():
        if re.match(r"^\s*Tree \d+", line):
            path = []
        elif found := _BRANCH.match(line):
            depth = len(found[1])
            path = [(d, c) for d, c in path if d < depth] + [(depth, (names[int(found[3])], found[4] == ">", float(found[5])))]
            rules.append(Rule(tuple(sorted({c for _, c in path}))))
    return list(dict.fromkeys(rules))


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self) -> Column:
        """Probability of label 1 over columns named as the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, trees: int = 24, depth: int = 3, penalty: float = 0.002, label: str = "quality") -> RuleModel:
    """Fit on labelled rows that aren't held out; at most about ``max_train`` of them, chosen by a hash of the id.

    Without labelled rows, or with one label only, the model has no rules and scores everything alike.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000)) < int(min(1.0, max_train / max(n, 1)) * 1_000_000))
    chosen = save(chosen.select(F.col("doc_id").alias("id"), "y"), "labels")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))  # about max_train rows at most
    names = list(NAMES)
    rows = save(with_statistics(texts.select("y", "text"), "text"), "training").coalesce(6)
    seen = [r[0] for r in rows.select("y").distinct().collect()]
    if len(seen) < 2:
        return RuleModel((), 0.0 if not seen else (8.0 if seen[0] else -8.0))
    rows = VectorAssembler(inputCols=names, outputCol="x").transform(rows).select("y", "x", *names).cache()
    forest = RandomForestClassifier(labelCol="y", featuresCol="x", numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=10, featureSubsetStrategy="onethird", seed=8)
    rules = tree_rules(forest.fit(rows).toDebugString, names)
    if not rules:
        rows.unpersist()
        return RuleModel((), 0.0)
    held = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="z")
    fired = held.transform(rows.select("y", *[r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)])).select("y", "z").cache()
    lasso = LogisticRegression(labelCol="y", featuresCol="z", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=True).fit(fired)
    weights = lasso.coefficients.toArray()
    rows.unpersist()
    fired.unpersist()
    return RuleModel(tuple((r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6), float(lasso.intercept))


def score(docs: DataFrame, model: RuleModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    A null text is scored as an empty one; repeated rows and texts alike get equal scores; a text of any length is
    one row; a score of just 0.5 is predicted 1; an empty table gives no rows. Other columns are not read.
    """
    stats = with_statistics(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text")
    out = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
