"""Correlation of factors with rank, and the statistics around it. Long rows in, one row per (run, factor) out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serploom.shared import written

#: Least points and non-zero points, and the critical value's constants.
LEAST_POINTS, Z, LEAST_CRITICAL, PAGE_ONE = 5, 1.96, 0.05, 10
#: Rows of a group that one task sorts; larger groups are ranked in as many ranges of values.
PER_GROUP, RANGES = 200_000, 512


def critical(n: Column) -> Column:
    """1.0 up to two points, else max(1.96 / sqrt(n - 1), 0.05)."""
    return F.when(n <= 2, 1.0).otherwise(F.greatest(F.lit(Z) / F.sqrt(F.greatest(n - 1, F.lit(1))), F.lit(LEAST_CRITICAL)))


def average_rank(by: list[str], value: str) -> Column:
    """Rank from 1 within ``by``; ties share their mean rank."""
    peers = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (peers - 1) / 2.0


def crowded(rows: DataFrame, by: list[str], most: int = PER_GROUP) -> DataFrame | None:
    """by: the groups of over ``most`` rows, which no single task should sort; None if there is none. Reads ``rows`` once."""
    found = written(rows.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(*by), "crowded")
    return None if found.isEmpty() else found


def below(rows: DataFrame, by: list[str], value: str, weight: Column | None = None, ranges: int = RANGES) -> DataFrame:
    """by, value, c, below: of every value of a group how many rows (or how much weight) have it, and have a smaller one. No task holds a group.

    Equal values are counted first. A sketch of each group's quantiles, written down so that every reader sees the same, cuts its values into ranges; counts are summed within ranges, and the ranges' totals before them
    are added. Cuts that are less than even cost balance, not exactness.
    """
    weight = F.lit(1) if weight is None else weight
    counts = rows.groupBy(*by, value).agg(F.sum(weight).alias("c"))
    marks = [k / ranges for k in range(1, ranges)]
    cuts = written(counts.groupBy(*by).agg(F.array_distinct(F.percentile_approx(value, marks, 100 * ranges)).alias("__cuts")), "cuts")
    cut = counts.join(cuts, by).withColumn("__r", F.size(F.filter("__cuts", lambda x: x < F.col(value)))).drop("__cuts")
    first = lambda keys, order, n: F.coalesce(F.sum(n).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut.groupBy(*by, "__r").agg(F.sum("c").alias("__n")).select(*by, "__r", first(by, "__r", "__n").alias("__start"))  # ``ranges`` rows a group at most
    return cut.withColumn("__in", first([*by, "__r"], value, "c")).join(starts, [*by, "__r"]).select(*by, value, "c", (F.col("__start") + F.col("__in")).alias("below"))


def ranked(rows: DataFrame, by: list[str], names: dict[str, str], most: int = PER_GROUP) -> DataFrame:
    """rows with the average rank of each named column's value within ``by``: windows for groups that a task can sort, ``below`` for the others. names: the new column by the ranked one."""
    many = crowded(rows, by, most)
    few = rows if many is None else rows.join(many, by, "left_anti")
    few = few.withColumns({to: average_rank(by, of) for of, to in names.items()})
    if many is None:
        return few
    rest = rows.join(many, by, "left_semi")
    out = rest
    for of, to in names.items():
        out = out.join(below(rest, by, of).select(*by, of, (F.col("below") + (F.col("c") + 1) / 2.0).alias(to)), [*by, of])
    return few.unionByName(out.select(*few.columns))


def pearson(x: str, y: str) -> Column:
    """Null on constant input, where corr would throw."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def correlate(values: DataFrame, definitions: DataFrame | None = None, run: str = "run_id", most: int = PER_GROUP) -> DataFrame:
    """run, factor_id, n, nonzero, pearson, spearman, best, significant, direction, page1_avg, max_value, usage.

    values: run, rank, factor_id, value, read more than once; absent rows are not measured and never count as zero, and rank 0 (the target) is
    left out. For runs of up to ``most`` pages one shuffle by (run, factor) serves ranks and sums; the values of larger ones are ranked in ranges, see ``below``.
    """
    by = [run, "factor_id"]
    rows = values.filter("rank > 0 and value is not null").select(run, "factor_id", "rank", "value")
    both = ranked(rows, by, {"value": "rv", "rank": "rr"}, most)
    # the first ten of a run: cut off in every task before they meet
    top = rows.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy("rank", "value"))).filter(F.col("__k") <= PAGE_ONE)
    sums = both.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("value") != 0).alias("nonzero"),
        (F.max("value") > F.min("value")).alias("varies"),
        (F.max("rank") > F.min("rank")).alias("ranks_vary"),
        pearson("value", "rank").alias("p"),
        pearson("rv", "rr").alias("s"),
        F.max("value").alias("max_value"),
    ).join(top.groupBy(*by).agg(F.avg("value").alias("page1_avg")), by)
    ok = (F.col("n") >= LEAST_POINTS) & (F.col("nonzero") >= LEAST_POINTS) & F.col("varies") & F.col("ranks_vary")
    best = F.when(F.abs("spearman") >= F.abs("pearson"), F.col("spearman")).otherwise(F.col("pearson"))
    out = sums.withColumns({"pearson": F.when(ok, F.col("p")), "spearman": F.when(ok, F.col("s"))}).withColumn("best", F.coalesce(best, "spearman", "pearson"))
    registry = F.lit(None).cast("string")
    if definitions is not None:
        out = out.join(definitions.select("factor_id", F.col("direction").alias("__d")), "factor_id", "left")
        registry = F.col("__d")
    direction = F.when(F.col("best") < 0, "more_is_better").when(F.col("best").isNotNull(), "less_is_better").otherwise(F.coalesce(registry, F.lit("more_is_better")))
    return out.select(
        run, "factor_id", "n", "nonzero", "pearson", "spearman", "best",
        F.coalesce(F.abs("best") >= critical(F.col("n")), F.lit(False)).alias("significant"),
        direction.alias("direction"), "page1_avg", "max_value", (F.col("nonzero") / F.col("n")).alias("usage"),
    )


def ordered(correlations: DataFrame, definitions: DataFrame, run: str = "run_id") -> DataFrame:
    """With ``place`` per run: by absolute correlation (to 12 decimals), nulls last, ties in registry order."""
    joined = correlations.join(definitions.select("factor_id", "ordinal"), "factor_id", "left")
    return joined.withColumn("place", F.row_number().over(Window.partitionBy(run).orderBy(F.abs(F.round("best", 12)).desc_nulls_last(), F.col("ordinal").asc_nulls_last(), "factor_id")))


def percentile(values: DataFrame, by: list[str], value: str = "value", name: str = "percentile", target: str = "rank = 0", most: int = PER_GROUP) -> DataFrame:
    """100 * (below + 0.5 * equal) / n of every row's value among the rows of its group that aren't the target.

    Below is the number of smaller population values, equal that of peers: by ranks in one window pass, or for groups of over ``most`` rows in ranges of values, see ``below``.
    """
    many = crowded(values, by, most)
    few = values if many is None else values.join(many, by, "left_anti")
    pop = F.when(F.expr(f"not ({target})"), 1).otherwise(0)
    whole, peers = Window.partitionBy(*by), Window.partitionBy(*by, value)
    upto = Window.partitionBy(*by).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    share = lambda under, eq, n: F.try_divide((under + eq * 0.5) * 100, F.nullif(n, F.lit(0)))
    eq = F.sum(pop).over(peers)
    out = few.withColumn(name, share(F.sum(pop).over(upto) - eq, eq, F.sum(pop).over(whole)))
    if many is None:
        return out
    rest = values.join(many, by, "left_semi")
    under = below(rest, by, value, pop).withColumnRenamed(value, "__v")
    sizes = rest.groupBy(*by).agg(F.sum(pop).alias("__all"))
    met = rest.withColumn("__v", F.col(value)).join(under, [*by, "__v"]).join(sizes, by)
    return out.unionByName(met.withColumn(name, share(F.col("below"), F.col("c"), F.col("__all"))).select(*out.columns))
