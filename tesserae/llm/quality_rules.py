"""Quality rules: base limits, then robust multivariate outliers.

Each document's counts are turned into a short vector of transformed statistics. For every language and
source the minimum-covariance-determinant estimate of centre and scatter is sought: from two robust starts,
concentration steps take the share of rows nearest in Mahalanobis distance and estimate again from these,
until no determinant falls any more, and the start of smaller determinant wins; a reweighted estimate follows.
The same is done for every language and for all rows, and each estimate is drawn to the one above it as if
that were worth some rows: a source with many rows stands by its own, one with few leans on its language.
Rows far from the centre are rejected. All of it is DataFrame aggregation: the rows never leave their place
but as partial sums and quantile sketches, which merge by group, so a group with a third of all rows is no
hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import save
from tesserae.llm.statistics import base_counts

#: Least scatter that a statistic is held to have, so that one that never varies in a group rejects nothing by itself.
FLOOR = {"length": 0.5, "word": 0.08, "symbol": 0.08, "line": 0.08, "repeat": 0.15}
FEATURES = tuple(FLOOR)


def features() -> dict[str, Column]:
    """Transformed statistics of a row of counts; 0 where a share has no words to refer to."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda c: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(c) / n)))
    return {
        "length": F.log1p(F.col("n_words").cast("double")),
        "word": F.log1p(F.col("word_chars") / n),
        "symbol": share("n_symbols"),
        "line": share("n_dup_lines"),
        "repeat": share("n_repeat_words"),
    }


def _factor(df: DataFrame, cov: str, out: str, p: int) -> DataFrame:
    """Add the Cholesky factor of ``{cov}{i}{j}`` (lower part) as ``{out}{i}{j}``."""
    for j in range(p):
        rest = lambda i: F.col(f"{cov}{i}{j}") - sum((F.col(f"{out}{i}{k}") * F.col(f"{out}{j}{k}") for k in range(j)), F.lit(0.0))  # noqa: B023, E731
        df = df.withColumn(f"{out}{j}{j}", F.sqrt(F.greatest(rest(j), F.lit(1e-12))))
        if j + 1 < p:
            df = df.withColumns({f"{out}{i}{j}": rest(i) / F.col(f"{out}{j}{j}") for i in range(j + 1, p)})
    return df


def _distance(df: DataFrame, mean: str, factor: str, out: str, p: int) -> DataFrame:
    """Add the squared Mahalanobis distance of x0.. from ``{mean}0..`` by forward substitution."""
    for i in range(p):
        known = sum((F.col(f"{factor}{i}{k}") * F.col(f"_z{k}") for k in range(i)), F.lit(0.0))
        df = df.withColumn(f"_z{i}", (F.col(f"x{i}") - F.col(f"{mean}{i}") - known) / F.col(f"{factor}{i}{i}"))
    total = sum((F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(p)), F.lit(0.0))
    return df.withColumn(out, total).drop(*[f"_z{i}" for i in range(p)])


def _moments(inside: Column, tag: str, p: int) -> list[Column]:
    """Sums over the rows ``inside``, of x less its group's median so that squares stay small."""
    x = lambda i: F.col(f"x{i}") - F.col(f"med{i}")
    sums = [F.sum(inside.cast("double")).alias(f"{tag}n")] + [F.sum(F.when(inside, x(i))).alias(f"{tag}s{i}") for i in range(p)]
    return sums + [F.sum(F.when(inside, x(i) * x(j))).alias(f"{tag}q{i}{j}") for i in range(p) for j in range(i + 1)]


def _estimate(df: DataFrame, tag: str, p: int, scale: float = 1.0) -> DataFrame:
    """Mean, covariance (at least the floor) and factor from the sums of ``_moments``; and the log-determinant."""
    n = F.nullif(F.col(f"{tag}n"), F.lit(0.0))
    df = df.withColumns({f"{tag}m{i}": F.col(f"{tag}s{i}") / n for i in range(p)})
    cov = lambda i, j: (F.col(f"{tag}q{i}{j}") / n - F.col(f"{tag}m{i}") * F.col(f"{tag}m{j}")) * F.lit(scale) + F.lit(FLOOR[FEATURES[i]] ** 2 if i == j else 0.0)
    df = df.withColumns({f"{tag}c{i}{j}": cov(i, j) for i in range(p) for j in range(i + 1)})
    df = df.withColumns({f"{tag}m{i}": F.col(f"{tag}m{i}") + F.col(f"med{i}") for i in range(p)})
    df = _factor(df, f"{tag}c", f"{tag}l", p)
    return df.withColumn(f"{tag}det", sum((F.log(F.col(f"{tag}l{i}{i}")) for i in range(p)), F.lit(0.0)))


def _params(tag: str, p: int) -> list[str]:
    return [f"{tag}m{i}" for i in range(p)] + [f"{tag}l{i}{j}" for i in range(p) for j in range(i + 1)]


def _meet(rows: DataFrame, params: DataFrame, n_groups: int, how: str = "inner", broadcast_groups: int = 10_000, salts: int = 64) -> DataFrame:
    """Join the parameters of each group to its rows without bringing a group's rows into one task.

    Parameters of at most ``broadcast_groups`` groups are broadcast. More are repeated for each of ``salts``
    salts, among which the rows of a group are dealt.
    """
    if n_groups <= broadcast_groups:
        return rows.join(F.broadcast(params), "g", how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("x0", "x1", "x2"), F.lit(salts)))
    spread = params.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(spread, ["g", "_salt"], how).drop("_salt")


def robust_estimates(rows: DataFrame, n_groups: int, share: float = 0.75, settled: float = 1e-3, accuracy: int = 1000, inlier: float = 12.83) -> DataFrame:
    """(g, x0..) -> (g, fn, fm0.., fc00..): number of rows, centre and covariance of the reweighted MCD estimate of each group.

    A start takes steps as long as its log-determinant falls by more than ``settled``; as the least scatter bounds it
    from below, all come to an end. ``inlier`` is the squared distance within which rows enter the reweighted estimate: the
    0.975 quantile of chi-square with five degrees of freedom. A group none of whose rows is inside has fn 0 and nulls.
    """
    p = len(FEATURES)
    medians = rows.groupBy("g").agg(*[F.percentile_approx(f"x{i}", 0.5, accuracy).alias(f"med{i}") for i in range(p)])
    centre = save(medians, "medians")
    with_centre = lambda: _meet(rows, centre, n_groups)
    spread = with_centre().groupBy("g").agg(*[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"med{i}")), 0.5, accuracy).alias(f"mad{i}") for i in range(p)])
    spread = spread.select("g", *[F.greatest(1.4826 * F.col(f"mad{i}"), F.lit(FLOOR[FEATURES[i]])).alias(f"sd{i}") for i in range(p)])
    centre = save(centre.join(spread, "g"), "spread")
    # start a: scaled by each statistic's own spread; start b: with the covariance of tanh-wrapped scores
    z = lambda i: (F.col(f"x{i}") - F.col(f"med{i}")) / F.col(f"sd{i}")
    wrapped = with_centre().groupBy("g").agg(*[F.covar_pop(F.tanh(z(i)), F.tanh(z(j))).alias(f"w{i}{j}") for i in range(p) for j in range(i + 1)])
    start = centre.join(wrapped, "g")
    for i in range(p):
        for j in range(i + 1):
            start = start.withColumn(f"bc{i}{j}", F.col(f"w{i}{j}") * F.col(f"sd{i}") * F.col(f"sd{j}") / 0.4 + F.lit(FLOOR[FEATURES[i]] ** 2 if i == j else 0.0))
    start = _factor(start, "bc", "bl", p)
    start = start.withColumns({f"{t}m{i}": F.col(f"med{i}") for t in "ab" for i in range(p)})
    start = start.withColumns({f"al{i}{j}": F.col(f"sd{i}") if i == j else F.lit(0.0) for i in range(p) for j in range(i + 1)})
    med = [f"med{i}" for i in range(p)]
    now = save(start.select("g", *med, *_params("a", p), *_params("b", p)), "start")
    step, moved = 0, True
    while moved:
        far = _distance(_distance(_meet(rows, now, n_groups), "am", "al", "da", p), "bm", "bl", "db", p)
        cut = save(far.groupBy("g").agg(F.percentile_approx("da", share, accuracy).alias("ca"), F.percentile_approx("db", share, accuracy).alias("cb")), f"cut{step}")
        sums = _meet(far, cut, n_groups).groupBy("g", *med).agg(*_moments(F.col("da") <= F.col("ca"), "a", p), *_moments(F.col("db") <= F.col("cb"), "b", p))
        got = _estimate(_estimate(sums, "a", p), "b", p).select("g", *med, *_params("a", p), *_params("b", p), "adet", "bdet")
        if step:  # a start that doesn't gain stays where it was, as quantiles are approximate and may step back
            was = now.select(F.col("g").alias("of"), *[F.col(c).alias(f"was_{c}") for t in "ab" for c in (*_params(t, p), f"{t}det")])
            both = got.join(was, F.col("g") == F.col("of"))
            fell = {t: F.col(f"was_{t}det") - F.col(f"{t}det") > settled for t in "ab"}
            better = [F.when(fell[t], F.col(c)).otherwise(F.col(f"was_{c}")).alias(c) for t in "ab" for c in (*_params(t, p), f"{t}det")]
            got = both.select("g", *med, *better, (fell["a"] | fell["b"]).alias("moved"))
        now = save(got if step else got.withColumn("moved", F.lit(True)), f"step{step}")
        step, moved = step + 1, not now.where("moved").isEmpty()
    best = now.select("g", *med, *[F.when(F.col("adet") <= F.col("bdet"), F.col(f"a{c[1:]}")).otherwise(F.col(f"b{c[1:]}")).alias(f"r{c[1:]}") for c in _params("a", p)])
    # the nearest 75 % of a normal sample have a smaller scatter than all of it: 1.35 makes up for that in five dimensions
    near = _distance(_meet(rows, best, n_groups), "rm", "rl", "d", p)
    sums = near.groupBy("g", *med).agg(*_moments(F.col("d") <= F.lit(inlier * 1.35), "f", p))
    covariances = [f"fc{i}{j}" for i in range(p) for j in range(i + 1)]
    return save(_estimate(sums, "f", p).select("g", "fn", *[f"fm{i}" for i in range(p)], *covariances), "robust")


def _levels(*names: str) -> list[Column]:
    """Names of all rows, of the language, and of the language and source."""
    return [F.lit("[]"), *[F.to_json(F.array(*names[:k])) for k in range(1, len(names) + 1)]]


def shrunk(pairs: DataFrame, robust: DataFrame, worth: float, p: int) -> DataFrame:
    """(g0, g1, g2) -> (g, m0.., l00..): the estimate of g2 drawn to that of g1, itself drawn to that of g0, as if to ``worth`` rows of it."""
    names = [f"fm{i}" for i in range(p)] + [f"fc{i}{j}" for i in range(p) for j in range(i + 1)]
    out = pairs
    for k in range(3):
        at = robust.select(F.col("g").alias(f"of{k}"), F.col("fn").alias(f"n{k}"), *[F.col(c).alias(f"{c}_{k}") for c in names])
        out = out.join(at, F.col(f"g{k}") == F.col(f"of{k}"), "left")
    for k in (1, 2):
        own = F.col(f"n{k}") / (F.col(f"n{k}") + F.lit(worth))
        out = out.withColumns({f"{c}_{k}": own * F.coalesce(f"{c}_{k}", f"{c}_{k - 1}") + (1 - own) * F.col(f"{c}_{k - 1}") for c in names})
    out = _factor(out.select(F.col("g2").alias("g"), *[F.col(f"{c}_2").alias(c) for c in names]), "fc", "l", p)
    return save(out.select("g", *[F.col(f"fm{i}").alias(f"m{i}") for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)]), "shrunk")


def judge(docs: DataFrame, cutoff: float = 40.0, worth: float = 30.0, min_words: int = 10, most_repeated: int = 20, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.

    A null text has no words, so it fails the base rules. Groups are a language and a source (null is one
    value of each). Estimates come from the rows that pass the base rules; only these are judged by ``distance``
    (null for the others). A group's estimate is drawn to its language's, and that to the one of all rows, as if
    these were worth ``worth`` rows. Ties and repeated rows count each; long texts are counted whole. An empty table
    gives no rows. Other columns are not read.
    """
    p = len(FEATURES)
    counts = base_counts(F.col(text))
    stats = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), *[c.alias(k) for k, c in counts.items()])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed).withColumn("g", _levels("lang", "source")[2])
    rows = save(stats.withColumns({f"x{i}": c for i, c in enumerate(features().values())}), "vectors")
    passed = rows.where(~F.col("base_failed"))
    pairs = save(passed.select("lang", "source").distinct().select(*[c.alias(f"g{k}") for k, c in enumerate(_levels("lang", "source"))]), "groups")
    n_pairs = pairs.count()
    levelled = passed.select(F.explode(F.array(*_levels("lang", "source"))).alias("g"), *[f"x{i}" for i in range(p)])
    robust = robust_estimates(levelled, 2 * n_pairs + 1)  # a group, its language, and all rows
    seen = _distance(_meet(rows, shrunk(pairs, robust, worth, p), n_pairs, "left"), "m", "l", "distance", p)
    near = F.coalesce(F.col("distance") <= F.lit(cutoff), F.lit(True))
    return seen.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(~F.col("base_failed"), F.col("distance")).alias("distance"), (~F.col("base_failed") & near).alias("kept"))
