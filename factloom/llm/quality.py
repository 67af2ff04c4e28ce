"""Quality rules by robust multivariate outliers: minimum covariance determinant per language and source.

Text statistics are made per row by SQL functions alone. The transformed statistic vectors of each (language, source) get a
minimum-covariance-determinant estimate: from deterministic starts, concentration steps refit mean and covariance to the
``share`` of rows with the smallest Mahalanobis distances, and the start with the smaller determinant stays. Squared distances
get the usual consistency factor for that share, and rows beyond ``cutoff`` are rejected, as are rows that fail the fixed rules. Groups are never collected: a step is a join with one row a group and two aggregates, whose quantile
comes from a histogram of fixed logarithmic bins; a group may hold any share of the rows.

Groups with fewer than ``least`` rows are pooled by language, and then all together. Defined results: null text has no words and
fails the fixed rules; null language or source form groups of their own; repeated rows count each; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from factloom.llm import common
from factloom.llm.common import WORD_SEPARATORS, beside, cut, whole_text

DIMENSIONS = 5
#: The value that a chi-squared variable with 5 degrees of freedom exceeds once in a million.
CUTOFF = 38.8
#: Factor by which the covariance of the nearest 75 % falls short for five normal variables.
SHORT = 1.41


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Array of words between the six ASCII separators."""
    return F.array_remove(F.split(F.translate(text, WORD_SEPARATORS[1:], " " * 5), " "), "")


def repeated_words(words: Column, window: int = 3) -> Column:
    """Words that lie in a window of words which occurs twice or more; windows are sorted, and equal neighbours give positions."""

    def covered(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: let(F.concat_ws(" ", *(F.get(w, i + j) for j in range(window))), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"), i.alias("i"))))
        return let(F.sort_array(grams), lambda s: let(F.sort_array(F.transform(F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1)), lambda x: x["i"])), union))

    def same(s: Column, x: Column, i: Column) -> Column:
        other = F.when(i >= 0, F.get(s, i))
        return F.coalesce((other["h"] == x["h"]) & (other["g"] == x["g"]), F.lit(False))

    def union(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - p, F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(words, covered)).cast("long")


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) of each whole text."""
    text = whole_text(text_col)
    lines = F.filter(F.split("__text", "\n"), lambda s: F.translate(s, WORD_SEPARATORS, "") != "")
    return (
        docs.select(id_col, *keep, text.alias("__text"))
        .withColumns({"__words": words_of(F.col("__text")), "__lines": lines})
        .select(
            id_col, *keep, F.size("__words").cast("long").alias("n_words"),
            F.length(F.translate("__text", WORD_SEPARATORS, "")).cast("long").alias("word_chars"),
            (F.length("__text") - F.length(F.translate("__text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col("__words")).alias("n_repeat_words"),
        )
    )


def vector() -> list[Column]:
    """Transformed statistics: nearly symmetric, and comparable between short and long texts."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.log1p(F.col("n_words")), F.col("word_chars") / n, F.sqrt(F.col("n_symbols") / n), F.sqrt(10 * F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n)]


#: The squares of these are added to the variances, so that statistics which are nearly constant in a group don't reject small changes.
FLOORS = (1.0, 0.5, 0.045, 0.15, 0.1)


def distance(x: list[str]) -> Column:
    """Squared Mahalanobis distance to mean m* under the covariance c*_*, by a Cholesky factorisation written out as columns."""
    p = len(x)
    low: dict[tuple[int, int], Column] = {}
    for i in range(p):
        for j in range(i + 1):
            low[i, j] = F.col(f"l{i}_{j}")
    z: list[Column] = []
    for i in range(p):
        rest = F.col(x[i]) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - low[i, j] * F.col(f"z{j}")
        z.append(rest / low[i, i])
    return z


def with_distance(rows: DataFrame, x: list[str]) -> DataFrame:
    """Rows joined with a group's m* and l* get d2."""
    for i, z in enumerate(distance(x)):
        rows = rows.withColumn(f"z{i}", z)
    return rows.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, len(x))), F.col("z0") * F.col("z0")))


def factored(moments: DataFrame, p: int) -> DataFrame:
    """From means m* and covariances c*_* the Cholesky factor l*_* (variances raised by the floors) and the log determinant."""
    out = moments
    for i in range(p):
        for j in range(i + 1):
            rest = F.coalesce(F.col(f"c{i}_{j}"), F.lit(0.0))
            if i == j:
                rest = rest + FLOORS[i] ** 2
            for k in range(j):
                rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            out = out.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-8))) if i == j else rest / F.col(f"l{j}_{j}"))
    return out.withColumn("logdet", sum((F.log(F.col(f"l{i}_{i}")) for i in range(1, p)), F.log(F.col("l0_0"))))


def moments(rows: DataFrame, keys: list[str], x: list[str]) -> DataFrame:
    aggs = [F.avg(c).alias(f"m{i}") for i, c in enumerate(x)] + [F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(len(x)) for j in range(i + 1)]
    return rows.groupBy(*keys).agg(*aggs)


def histogram_quantile(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Per key the smallest upper bin edge below which at least the share of the values lie; bins are 1/32 wide in the logarithm."""
    bins = rows.select(*keys, F.floor(F.log(F.greatest(F.col(value), F.lit(1e-9))) * 32).alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    upto = bins.withColumn("below", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    return upto.where(F.col("below") >= share * F.col("all")).groupBy(*keys).agg(F.exp((F.min("bin") + 1) / 32).alias("limit"))


def mcd(rows: DataFrame, x: list[str], share: float, steps: int, few: bool) -> DataFrame:
    """Per group ``g`` the estimate (m*, l*) with the smaller determinant of two starts: all rows, and the rows near the coordinatewise centre."""
    p = len(x)
    starts = F.explode(F.array(F.lit(0), F.lit(1))).alias("start")
    many = rows.select("g", *x, starts)
    whole = moments(rows, ["g"], x)
    centre = rows.groupBy("g").agg(*(F.percentile_approx(c, 0.5, 1000).alias(f"m{i}") for i, c in enumerate(x)))
    diagonal = centre.join(whole.drop(*(f"m{i}" for i in range(p))), "g").withColumns({f"c{i}_{j}": F.lit(0.0) for i in range(p) for j in range(i)})
    now = whole.withColumn("start", F.lit(0)).unionByName(diagonal.withColumn("start", F.lit(1)))
    for _ in range(steps):
        now = cut(factored(now, p), "mcd")
        near = with_distance(beside(many, now, ["g", "start"], few), x)
        limit = histogram_quantile(near, ["g", "start"], "d2", share)
        now = moments(beside(near, limit, ["g", "start"], few).where(F.col("d2") <= F.col("limit")).select("g", "start", *x), ["g", "start"], x)
    final = factored(now, p)
    return cut(final.groupBy("g").agg(F.min_by(F.struct(*(c for c in final.columns if c != "g")), F.struct("logdet", "start")).alias("b")).select("g", "b.*"), "mcd")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.75, steps: int = 4, least: int = 50, cutoff: float = CUTOFF) -> DataFrame:
    """Statistics of every row with ``base_failed``, the robust squared ``distance`` and ``kept``."""
    made = text_statistics(docs, id_col, text_col).withColumns({"lang": F.coalesce("lang", F.lit("\x00")), "source": F.coalesce("source", F.lit("\x00"))})
    x = [f"x{i}" for i in range(DIMENSIONS)]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    made = cut(made.withColumns(dict(zip(x, vector()))).withColumn("base_failed", failed), "statistics")
    fit = made.where(~F.col("base_failed"))
    sizes = fit.groupBy("lang", "source").agg(F.count("*").alias("n"))
    pooled = sizes.withColumn("pool", F.sum(F.when(F.col("n") < least, F.col("n"))).over(Window.partitionBy("lang")))
    groups = cut(
        pooled.select(
            "lang", "source",
            F.when(F.col("n") >= least, F.to_json(F.array("lang", "source"))).when(F.col("pool") >= least, F.to_json(F.array("lang"))).otherwise(F.lit("[]")).alias("g"),
        ), "groups")
    few = groups.count() <= common.FEW
    grouped = beside(made, groups, ["lang", "source"], few, "left")
    estimates = mcd(grouped.where(~F.col("base_failed")).select("g", *x), x, share, steps, few)
    judged = with_distance(beside(grouped, estimates, ["g"], few, "left"), x).withColumn("distance", F.col("d2") / SHORT)
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)
    return judged.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
