"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each row draws u from a hash of its id and gets the exponential key -ln(u) / w for its quality weight w; the
rows of smallest keys are a weighted sample without replacement. A source's target is spent in complete
epochs first, then on the rows in the order of their keys until the budget is met. No source is sorted: its
keys are cut into equal ranges, sizes are summed by range, and the range in which the budget ends is cut
again, until it holds few rows, which alone are summed one by one. The level that targets share is found in the
same way among the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import let, save, without_white, words
from tesserae.llm.statistics import count_of
from tesserae.sources.numbering import number_in_order

#: Sources in order take these weights in turn; the mix holds this share of all words; no document above this many times.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
#: A document in the outer ``TAIL`` of all documents by a statistic weighs less than others, in proportion, down to ``LEAST``.
TAIL, LEAST = 0.05, 0.05
#: Characters that prose rarely has many of, and the bins of each statistic.
RARE = "#*$%&|<>!0123456789"
BINS = {"rare": 1000, "length": 500, "distinct": 100}


def statistics(rows: DataFrame, text: str) -> DataFrame:
    """Add ``size``, the number of words, and bins of ``text``: rare characters per thousand, tenths of characters a word, distinct words per hundred."""
    body = F.coalesce(F.col(text), F.lit(""))
    counted = let(words(body), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    chars = F.struct(F.char_length(body).alias("all"), F.char_length(without_white(body)).alias("black"), count_of(body, RARE).alias("rare"))
    rows = rows.withColumns({"_w": counted, "_c": chars}).drop(text)
    share = lambda part, whole, name: F.least(F.floor(F.lit(float(BINS[name])) * part / F.greatest(whole, F.lit(1))), F.lit(BINS[name])).cast("int")
    n = F.greatest(F.col("_w.n"), F.lit(1))
    bins = {"rare": share(F.col("_c.rare"), F.col("_c.all"), "rare"), "length": F.least(F.floor(F.lit(10.0) * F.col("_c.black") / n), F.lit(BINS["length"])).cast("int"), "distinct": share(F.col("_w.distinct"), F.col("_w.n"), "distinct")}
    return rows.withColumns({"size": F.col("_w.n").cast("long"), **bins}).drop("_w", "_c")


def with_weights(rows: DataFrame) -> DataFrame:
    """Add ``weight``, from LEAST to 1: how usual the row's statistics are among all rows.

    A statistic of a row is worth its tail, the share of rows that are at least as far out, over TAIL, at most 1: many
    rare characters, few distinct words, and words shorter or longer than usual are far out. Worths are multiplied.
    The tables of tails have one row a bin, so joining them by broadcast is bounded.
    """
    total, weight = float(rows.count()), F.lit(1.0)
    for name in BINS:
        counts = rows.groupBy(F.col(name).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
        up, down = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.col("_bin"), F.col("_bin").desc()))
        low, high = F.sum("_n").over(up).cast("double"), F.sum("_n").over(down).cast("double")
        tail = {"rare": high, "distinct": low, "length": F.least(low, high) * 2}[name]
        table = save(counts.select("_bin", F.least(F.lit(1.0), tail / F.lit(total) / F.lit(TAIL)).alias(f"_{name}")), "tails")
        rows = rows.join(F.broadcast(table), F.col(name) == F.col("_bin")).drop("_bin", name)
        weight = weight * F.col(f"_{name}")
    return rows.withColumn("weight", F.greatest(F.lit(LEAST), weight)).drop(*[f"_{n}" for n in BINS])


def uniform(doc_id: Column) -> Column:
    """A number strictly between 0 and 1 from the id."""
    hexed = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 13)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def common_level(table: DataFrame, goal: float, bins: int = 256) -> float:
    """(cap, weight) -> the level at which the sum of least(cap, level * weight) is ``goal``; caps all fit below it or reach it.

    Sources are full up to some ratio of cap to weight. Ratios are cut into ranges with their sums, at most ``bins``
    of which come to the driver; the range in which the level lies is cut again, until it holds one ratio.
    """
    rows = table.withColumn("ratio", F.col("cap") / F.col("weight"))
    low, high, free = rows.agg(F.min("ratio"), F.max("ratio"), F.sum("weight")).first()
    capped, level = 0.0, 0.0
    while low is not None:
        inside = rows.where(F.col("ratio").between(low, high))
        bin_ = F.least(F.floor((F.col("ratio") - F.lit(low)) / F.lit((high - low) or 1.0) * bins), F.lit(bins - 1))
        found = inside.groupBy(bin_.alias("bin")).agg(F.sum("cap"), F.sum("weight"), F.min("ratio"), F.max("ratio")).orderBy("bin").collect()
        for _, cap, weight, low, high in found:
            if capped + cap + high * (free - weight) > goal:
                break  # not all of this range is full
            capped, free, level = capped + cap, free - weight, high
        else:
            low = None
        if low is None or low == high:
            break
    return (goal - capped) / free if free else level


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """(source, source_size) -> with target: the words that each source is to bring.

    Weights go round the sources in order of their code points, null last. Each target is its weight times a
    common level, or ``epochs`` times the source's size where that is less; the level is such that the targets
    sum to ``share`` of all sizes.
    """
    placed = number_in_order(sources, [F.col("source").isNull(), F.col("source")], "turn")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("turn") - 1) % len(weights) + 1).cast("int"))
    table = save(placed.withColumns({"weight": turn, "cap": F.col("source_size") * F.lit(float(epochs))}), "sources")
    total = table.agg(F.sum("source_size")).first()[0]
    level = common_level(table, share * float(total or 0))
    return table.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).drop("turn", "cap", "weight")


#: The order of a source's rows: keys, then texts (in halves, which doubles hold), then any order of rows that are alike.
_ORDER = ("key", "high", "low", "row")


def _before_and_inside() -> tuple[Column, Column]:
    """Whether a row comes before its source's range, and whether it lies in it."""
    before, inside = F.lit(False), F.lit(True)
    for i, c in enumerate(_ORDER):
        before = before | (inside & (F.col(c) < F.col(f"from{i}")))
        inside = inside & F.col(c).between(F.col(f"from{i}"), F.col(f"to{i}"))
    return before, inside


def locate(rows: DataFrame, budgets: DataFrame, meet, bins: int = 1024, per_range: int = 1024) -> DataFrame:
    """(s, rest, ..) -> with from0.., to0.., base: the range of each source's rows in which ``rest`` words are reached, and the words before it.

    Each turn cuts every range that still has more than ``per_range`` rows into ``bins`` equal ones of the first
    column that varies in it, so a range shrinks by that factor a turn, however uneven the keys are.
    """
    far = float("inf")
    state = save(budgets.withColumn("base", F.lit(0.0)).withColumns({f"{e}{i}": F.lit(-far if e == "from" else far) for i in range(len(_ORDER)) for e in ("from", "to")}), "budgets")
    todo, done = state, []
    while True:
        at = meet(rows, todo).where(_before_and_inside()[1])
        ends = at.groupBy("s").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{e}_{i}") for i, c in enumerate(_ORDER) for f, e in ((F.min, "least"), (F.max, "most"))])
        # the range shrunk to what it holds; the first column that varies is the one to cut
        tight = todo.drop(*[f"{e}{i}" for i in range(len(_ORDER)) for e in ("from", "to")]).join(ends.withColumnRenamed("s", "s_"), F.col("s").eqNullSafe(F.col("s_"))).drop("s_")
        varying = F.coalesce(*[F.when(F.col(f"least_{i}") < F.col(f"most_{i}"), F.lit(i)) for i in range(len(_ORDER))], F.lit(len(_ORDER) - 1))
        tight = tight.withColumn("cut", varying)
        edge = lambda e, i, inf: F.when(F.lit(i) <= F.col("cut"), F.col(f"{e}_{i}")).otherwise(F.lit(inf))
        tight = save(tight.withColumns({f"from{i}": edge("least", i, -far) for i in range(len(_ORDER))} | {f"to{i}": edge("most", i, far) for i in range(len(_ORDER))}).drop(*[f"{e}_{i}" for i in range(len(_ORDER)) for e in ("least", "most")]), "tight")
        done.append(tight.where(F.col("n") <= per_range).drop("n", "cut"))
        todo = tight.where(F.col("n") > per_range)
        if todo.isEmpty():
            break
        pick = lambda names: F.coalesce(*[F.when(F.col("cut") == i, names(i)) for i in range(len(_ORDER))])
        value, low, high = pick(lambda i: F.col(_ORDER[i])), pick(lambda i: F.col(f"from{i}")), pick(lambda i: F.col(f"to{i}"))
        bin_ = F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1))
        cut = meet(rows, todo).where(_before_and_inside()[1]).withColumns({"bin": bin_, "value": value})
        sums = cut.groupBy("s", "bin").agg(F.sum("size").alias("words"), F.min("value").alias("least"), F.max("value").alias("most"))
        upto = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most ``bins`` rows
        sums = sums.withColumn("upto", F.sum("words").over(upto)).select(F.col("s").alias("s_"), "bin", "words", "least", "most", "upto")
        joined = todo.join(sums, F.col("s").eqNullSafe(F.col("s_"))).where(F.col("base") + F.col("upto") > F.col("rest"))
        first = joined.groupBy("s").agg(F.min_by(F.struct("*"), "bin").alias("r")).select("r.*")
        # a budget that is met by all words has no such range; its last row is in whole
        narrow = {f"from{i}": F.when(F.col("cut") == i, F.col("least")).otherwise(F.col(f"from{i}")) for i in range(len(_ORDER))}
        narrow |= {f"to{i}": F.when(F.col("cut") == i, F.col("most")).otherwise(F.col(f"to{i}")) for i in range(len(_ORDER))}
        todo = save(first.withColumns(narrow).withColumn("base", F.col("base") + F.col("upto") - F.col("words")).drop("s_", "bin", "words", "least", "most", "upto", "n", "cut"), "budgets")
        if todo.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, per_range: int = 1024, broadcast_sources: int = 50_000) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, text_hash.

    ``size`` counts words, 0 for a null text. ``taken`` is a whole multiple of ``size``. Null sources form one
    source. Rows with equal keys (repeated ids) are ordered by text; rows equal in both are alike. The row at
    which the budget ends is taken if that brings the source nearer to its target. Long texts are one row like any
    other. An empty table gives no rows. Ranges of at most ``broadcast_sources`` sources are broadcast; beyond that
    Spark joins by source, where it may split one with many rows.
    """
    body = F.col(text)
    tag = F.xxhash64(F.coalesce(body, F.lit("")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), body.alias("body"), tag.alias("text_hash"), F.monotonically_increasing_id().alias("row"))
    rows = save(statistics(rows, "body"), "mix")
    rows = with_weights(rows).withColumn("key", -F.log(uniform(F.col("doc_id"))) / F.col("weight"))
    rows = rows.withColumns({"high": F.shiftright("text_hash", 32).cast("double"), "low": F.col("text_hash").bitwiseAND(F.lit(0xFFFFFFFF)).cast("double"), "row": F.col("row").cast("double")})
    rows = save(rows.drop("weight"), "keys")
    sizes = save(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    n_sources = sizes.count()

    def meet(left: DataFrame, of: DataFrame) -> DataFrame:
        return left.join(F.broadcast(of) if n_sources <= broadcast_sources else of, F.col("source").eqNullSafe(F.col("s")))

    whole_epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = targets(sizes, weights, share, epochs).select(F.col("source").alias("s"), "source_size", "target", whole_epochs.alias("epochs"))
    goal = save(goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "goals")
    found = save(locate(rows, goal.where("rest > 0").select("s", "rest"), meet, per_range=per_range), "located")
    ends = found.select(F.col("s").alias("s_"), "base", *[f"{e}{i}" for i in range(len(_ORDER)) for e in ("from", "to")])
    plan = goal.join(ends, F.col("s").eqNullSafe(F.col("s_")), "left").drop("s_")
    before, inside = _before_and_inside()
    # a source without a range is in by whole epochs only
    joined = meet(rows, plan).withColumns({"whole": F.coalesce(before, F.lit(False)), "upon": F.coalesce(inside, F.lit(False))})
    out = ["doc_id", "source", "size", "source_size", "target", "taken", "text_hash"]
    settled = joined.where(~F.col("upon")).withColumn("taken", F.col("size") * (F.col("epochs") + F.col("whole").cast("long")))
    upto = Window.partitionBy("source").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upon = joined.where("upon").withColumn("end", F.col("base") + F.sum("size").over(upto))
    # below the budget, or across it by less than what would be missing
    more = (F.col("end") <= F.col("rest")) | ((F.col("end") - F.col("size") < F.col("rest")) & (2 * F.col("rest") >= 2 * F.col("end") - F.col("size")))
    last = upon.withColumn("taken", F.col("size") * (F.col("epochs") + more.cast("long")))
    return settled.select(*out).unionByName(last.select(*out))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (
  SELECT doc_id, source, len(ws)::BIGINT AS size,
    least(floor(1000.0::DOUBLE * (length(body) - length(regexp_replace(body, '[#*$%&|<>!0-9]', '', 'g'))) / greatest(length(body), 1)), 1000) AS rare,
    least(floor(10.0::DOUBLE * length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) / greatest(len(ws), 1)), 500) AS word_length,
    least(floor(100.0::DOUBLE * len(list_distinct(ws)) / greatest(len(ws), 1)), 100) AS distinct_words
  FROM t),
n AS (SELECT count(*)::DOUBLE AS n FROM b),
rr AS (SELECT rare, least(1.0::DOUBLE, (sum(count(*)) OVER (ORDER BY rare DESC))::DOUBLE / any_value(n) / 0.05::DOUBLE) AS w FROM b, n GROUP BY rare),
wl AS (
  SELECT word_length, least(1.0::DOUBLE, least((sum(count(*)) OVER (ORDER BY word_length))::DOUBLE, (sum(count(*)) OVER (ORDER BY word_length DESC))::DOUBLE) * 2 / any_value(n) / 0.05::DOUBLE) AS w
  FROM b, n GROUP BY word_length),
dw AS (SELECT distinct_words, least(1.0::DOUBLE, (sum(count(*)) OVER (ORDER BY distinct_words))::DOUBLE / any_value(n) / 0.05::DOUBLE) AS w FROM b, n GROUP BY distinct_words),
d AS (
  SELECT doc_id, source, size, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / greatest(0.05::DOUBLE, rr.w * wl.w * dw.w) AS key
  FROM b JOIN rr USING (rare) JOIN wl USING (word_length) JOIN dw USING (distinct_words)),
s AS (
  SELECT source, source_size, [3.0, 1.0, 2.0][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)]::DOUBLE AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
r AS (
  SELECT *, 2.0::DOUBLE * source_size / w AS full_at, sum(source_size) OVER () * 1.5::DOUBLE AS goal,
    coalesce(sum(2.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free_w
  FROM s WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST)),
-- the level when this source and those after it are free and those before it are full
l AS (SELECT coalesce(max((goal - capped) / free_w) FILTER (WHERE full_at >= (goal - capped) / free_w), 0) AS level FROM r),
g AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, level * w) AS target FROM s, l),
k AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS epochs,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN upto <= target - epochs * source_size
     OR (upto - size < target - epochs * source_size AND 2 * (target - epochs * source_size) >= 2 * upto - size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k"""
