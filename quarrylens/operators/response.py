"""A response column and the columns that may explain it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import ranks

#: Different values of a column up to which their ranks are broadcast.
FEW_VALUES = 100_000
# Labels that mark the positive class.
POSITIVE_LABELS = ("1", "true", "t", "yes", "y", "positive", "event", "bad", "claim", "lapse")


def encoded(response: Column, positive: str, negative: str) -> Column:
    """1 for the positive class, 0 for the negative, null for anything else."""
    s = response.cast("string")
    return F.when(s == positive, 1.0).when(s == negative, 0.0)


def classes_of(df: DataFrame, response: str, order: Column | None = None) -> list[str]:
    """The distinct values as text, at most three of them: as they come first in an order, else sorted."""
    seen = df.where(C.name(response).isNotNull()).groupBy(C.name(response).cast("string").alias("class"))
    found = seen.agg(F.min(order if order is not None else F.lit(0)).alias("at"))
    return [r["class"] for r in found.orderBy("at", "class").limit(3).collect()]


def positive_class(classes: Sequence[str], wanted: str | None = None) -> str:
    """A wanted one, else the first with a known label, else the last by name."""
    if wanted is not None and wanted in classes:
        return wanted
    known = [c for c in classes if c.strip().lower() in POSITIVE_LABELS]
    return known[0] if known else max(classes)


def class_table(df: DataFrame, response: str, positive: str | None = None) -> DataFrame:
    """Each class with its count, share and 0/1 value; a missing response is a class of its own."""
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    counts = df.groupBy(C.label(C.name(response)).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("class") == C.MISSING, None).when(F.col("class") == positive, 1).otherwise(0) if positive is not None else F.lit(None)
    return counts.select("class", "n", C.share(F.col("n"), total).alias("percentage"), value.cast("long").alias("encoded_value"))


def imbalance(df: DataFrame, y: Column) -> DataFrame:
    """Of a 0/1 response: rate, smaller and larger class, their ratio (null if one is empty)."""
    pos, neg = F.count_if(y == 1), F.count_if(y == 0)
    out = df.agg(F.avg(y).alias("response_rate"), pos.alias("pos"), neg.alias("neg"))
    lo, hi = F.least("pos", "neg"), F.greatest("pos", "neg")
    return out.select("response_rate", lo.alias("minority_count"), hi.alias("majority_count"), F.when(lo > 0, C.share(hi, lo)).alias("imbalance_ratio"))


def class_counts(df: DataFrame, y: Column, columns: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """(column, value, n, n1): value counts with the positives among them; what AUC, ranks and bins are made of. counts: a value table
    with this response's classes."""
    if counts is not None:
        return ranks.numbers_of(counts, columns, classes=True)
    rows = ranks.long_numbers(df.where(y.isNotNull()), columns, {"y": y.cast("double")})
    return rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("n1"))


def numeric_relationships(df: DataFrame, y: Column, columns: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """AUC, its distance from a half, Mann-Whitney U, Spearman against a 0/1 response, and the sum of tie cubes.

    From (value, n, n1) placed by value: U sums, over values, positives times the negatives below them and half of
    those beside them. Needs 3 pairs, 2 values and both classes, else null."""
    at = ranks.placed(class_counts(df, y, columns, counts).withColumn("n0", F.col("n") - F.col("n1")), "column", ("n", "n0"))
    rank, n, n1, n0 = ranks.average_rank(), F.col("n"), F.col("n1"), F.col("n0")
    sums = at.groupBy("column").agg(
        F.sum(n).alias("n"), F.sum(n1).alias("n1"), F.sum(n0).alias("n0"), F.count(F.lit(1)).alias("values"), F.sum(n1 * (F.col("before_n0") + n0 / 2.0)).alias("u"),
        F.sum(rank * rank * n).alias("rr"), F.sum(rank * n).alias("r"), F.sum(rank * n1).alias("ry"), F.sum(n.cast("double") * n * n - n).alias("tie_sum"),
    )
    d = lambda c: F.col(c).cast("double")
    auc = F.try_divide(d("u"), d("n0") * d("n1"))
    # ranks of a 0/1 column are a line in it, so Spearman is the correlation of ranks with the column
    cov = d("ry") - F.try_divide(d("r") * d("n1"), d("n"))
    spread = F.sqrt((d("rr") - F.try_divide(d("r") * d("r"), d("n"))) * (d("n1") - F.try_divide(d("n1") * d("n1"), d("n"))))
    fit = (F.col("n") >= 3) & (F.col("values") >= 2) & (F.col("n0") > 0) & (F.col("n1") > 0)
    return sums.select(
        "column", "n", F.when(fit, auc).alias("auc"), F.when(fit, F.greatest(auc, 1 - auc)).alias("auc_abs"), F.when(fit, F.try_divide(cov, spread)).alias("spearman"),
        F.when(fit, d("u")).alias("mann_whitney_u"), F.col("n1").alias("positives"), F.col("n0").alias("negatives"), d("tie_sum").alias("tie_sum"),
    )


def welch_t(df: DataFrame, y: Column, columns: Sequence[str]) -> DataFrame:
    """Welch's t of positives against negatives and its degrees of freedom; needs 2 rows in each class."""
    out = []
    for c in columns:
        x = C.as_number(df, c)
        side = lambda v: F.when(y == v, x)  # noqa: E731, B023
        out.append(F.struct(F.lit(c).alias("column"), *[f(side(v)).alias(f"{k}{v}") for v in (1, 0) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]))
    a, b = F.try_divide("v1", "n1"), F.try_divide("v0", "n0")
    t = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(a + b))
    df_ = F.try_divide((a + b) * (a + b), F.try_divide(a * a, F.col("n1") - 1) + F.try_divide(b * b, F.col("n0") - 1))
    fit = (F.col("n1") >= 2) & (F.col("n0") >= 2)
    return C.rows_of(df, out).select("column", F.when(fit, t).alias("t"), F.when(fit, df_).alias("degrees"))


def quantile_bins(df: DataFrame, y: Column, columns: Sequence[str], most: int = 10, counts: DataFrame | None = None) -> DataFrame:
    """(column, bin, low, high, n, response_rate): right-closed bins between quantiles, equal edges merged, the lowest edge
    inside the first bin. Of q = min(most, distinct values) bins."""
    counts = class_counts(df, y, columns, counts)
    sizes = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    grid = sorted({i / q for q in range(1, most + 1) for i in range(q + 1)})
    found = ranks.quantiles(counts, grid).join(F.broadcast(sizes), "column").withColumn("q_", F.least(F.lit(most), "distinct"))
    step = F.col("p") * F.col("q_")
    edges = found.where(F.abs(step - F.round(step)) < 1e-9).groupBy("column").agg(F.array_sort(F.collect_set("q")).alias("edges"))  # most + 1 numbers at most
    placed = counts.join(F.broadcast(edges), "column").withColumn("bin", F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < F.col("value")))))
    out = placed.groupBy("column", "bin").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"), F.first("edges").alias("edges"))
    out = out.where(F.size("edges") > 1)
    return out.select("column", F.col("bin").cast("long").alias("bin"), F.element_at("edges", F.col("bin").cast("int")).alias("low"), F.element_at("edges", (F.col("bin") + 1).cast("int")).alias("high"), "n", C.share(F.col("n1"), F.col("n")).alias("response_rate"))


def bin_trend(bins: DataFrame) -> DataFrame:
    """Spread of the bins' rates, first and last rate, and whether they only rise or only fall."""
    last = F.lag("response_rate").over(Window.partitionBy("column").orderBy("bin"))  # ten rows at most
    steps = bins.withColumn("d", F.col("response_rate") - last)
    out = steps.groupBy("column").agg(
        (F.max("response_rate") - F.min("response_rate")).alias("response_rate_spread"), F.min_by("response_rate", "bin").alias("bottom_bin_rate"), F.max_by("response_rate", "bin").alias("top_bin_rate"),
        F.count(F.lit(1)).alias("bins"), F.bool_and(F.coalesce(F.col("d") >= 0, F.lit(True))).alias("up"), F.bool_and(F.coalesce(F.col("d") <= 0, F.lit(True))).alias("down"),
    )
    trend = F.when(F.col("bins") < 2, "none").when(F.col("up") & F.col("down"), "flat").when(F.col("up"), "increasing").when(F.col("down"), "decreasing").otherwise("mixed")
    return out.select("column", "response_rate_spread", "bottom_bin_rate", "top_bin_rate", (F.col("bins") >= 2).__and__(F.col("up") | F.col("down")).alias("monotonic"), trend.alias("trend"))


def _categories(df: DataFrame, columns: Sequence[str], **kept: Column) -> DataFrame:
    """(column, category, kept ones): a row for each column of a row; a missing value is a category."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), C.label(C.name(c)).alias("category")) for c in columns])
    return df.select(*[c.alias(k) for k, c in kept.items()], F.explode(pairs).alias("p")).select("p.*", *kept)


def all_category_rates(df: DataFrame, columns: Sequence[str], y: Column, top: int = 20, counts: DataFrame | None = None) -> DataFrame:
    """(column, category, n, mean_response, place): category_rates() of all columns, in one scan, or of a value table with this
    0/1 response's classes."""
    if counts is None:
        out = _categories(df.where(y.isNotNull()), columns, y=y.cast("double")).groupBy("column", "category").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_response"))
    else:
        out = _of_table(counts, columns).groupBy("column", "category").agg(F.sum(F.col("n1") + F.col("n0")).alias("n"), C.share(F.sum("n1"), F.sum(F.col("n1") + F.col("n0"))).alias("mean_response")).where("n > 0")
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("mean_response"), F.desc("n"), "category"))
    return out.withColumn("place", place).where(F.col("place") <= top)


def _of_table(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    return counts.where(F.col("column").isin(*columns)).select("column", C.label(F.col("value")).alias("category"), "n1", "n0")


def category_rates(df: DataFrame, column: str, y: Column, top: int = 20) -> DataFrame:
    """Count and mean response of each category, highest mean first, then largest, then by name; the first of them."""
    return all_category_rates(df, [column], y, top).select("category", "n", "mean_response", "place").orderBy("place").drop("place")


def contingency(df: DataFrame, columns: Sequence[str], response: str) -> DataFrame:
    """Counts of each column's categories and classes in one scan, missing categories included, missing responses not."""
    rows = _categories(df.where(C.name(response).isNotNull()), columns, **{"class": C.name(response).cast("string")})
    return rows.groupBy("column", "category", "class").agg(F.count(F.lit(1)).alias("n"))


def chi_squares(df: DataFrame, columns: Sequence[str], response: str, counts: DataFrame | None = None) -> DataFrame:
    """Of each column: chi-squared of independence (with Yates' correction for two by two), its degrees of freedom, and Cramer's V
    of it. All columns are counted in one scan, or taken from a value table with the response's two classes; a column without
    rows gives no row.

    The sum over all cells of (n - e)**2 / e is the sum of n**2 / e less the total, so cells without rows need no row."""
    if counts is None:
        cells = contingency(df, columns, response)
    else:
        both = F.array(F.struct(F.lit("1").alias("class"), F.col("n1").alias("n")), F.struct(F.lit("0").alias("class"), F.col("n0").alias("n")))
        cells = _of_table(counts, columns).select("column", "category", F.explode(both).alias("c")).groupBy("column", "category", "c.class").agg(F.sum("c.n").alias("n")).where("n > 0")
    rows = cells.groupBy("column", "category").agg(F.sum("n").alias("row"))
    cols = cells.groupBy("column", "class").agg(F.sum("n").alias("col"))
    n = F.col("n").cast("double")
    r = rows.groupBy("column").agg(F.count(F.lit(1)).alias("r"), F.sum(1.0 / F.col("row")).alias("over_rows"))
    c = cols.groupBy("column").agg(F.count(F.lit(1)).alias("c"), F.sum(1.0 / F.col("col")).alias("over_cols"))
    out = cells.join(rows, ["column", "category"]).join(cols, ["column", "class"]).groupBy("column").agg(F.sum("n").alias("n"), F.sum(n * n / F.col("row") / F.col("col")).alias("s"))
    out = out.join(F.broadcast(r), "column").join(F.broadcast(c), "column").select("column", "n", (F.col("s") * F.col("n")).alias("s"), "r", "c", (F.col("n") * F.col("over_rows") * F.col("over_cols")).alias("over_e"))  # a row for each column
    plain = F.greatest(F.lit(0.0), F.col("s") - F.col("n"))
    # two by two: every cell is as far from its expected number, so the distance follows from the sum
    gap = F.sqrt(F.try_divide(plain, F.col("over_e")))
    off = gap - F.least(F.lit(0.5), gap)
    chi2 = F.when((F.col("r") == 2) & (F.col("c") == 2), off * off * F.col("over_e")).otherwise(plain)
    least = F.least("r", "c") - 1
    return out.withColumn("chi2", chi2).select("column", "n", F.when(least > 0, F.col("chi2")).alias("chi_square"), ((F.col("r") - 1) * (F.col("c") - 1)).alias("degrees"), F.when(least > 0, F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * least))).alias("cramers_v"))


def chi_square(df: DataFrame, column: str, response: str) -> DataFrame:
    return chi_squares(df, [column], response)


def regression_target(df: DataFrame, response: str) -> DataFrame:
    """Count, missing, parse failures, moments, quartiles and outliers of a numeric (or numeric-like text) response."""
    from . import univariate

    text = response in C.text_columns(df)
    x = C.parsed_number(C.name(response)) if text else C.as_number(df, response)
    y = df.select(C.name(response).alias("raw"), x.alias("y"))
    facts = y.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("y").isNull()).alias("missing_count"), F.count_if(F.col("raw").isNotNull() & F.col("y").isNull()).alias("parse_failure_count"))
    return facts.withColumn("column", F.lit("y")).join(univariate.numeric_summary(y, ["y"]), "column").drop("column").withColumn("zero_variance", F.coalesce(F.col("min") == F.col("max"), F.lit(False)))


def _paired(data: DataFrame, columns: Sequence[str]) -> list[tuple[list[str], DataFrame]]:
    """(column, x, y) rows where both are there, with the columns that they are of: a frame for each column where these read no more
    than one for all."""
    y = F.col("__y").cast("double").alias("y")
    if ranks.by_passes(data, columns):
        return [([c], data.select(F.lit(c).alias("column"), C.name(c).alias("x"), y).where(F.col("x").isNotNull() & F.col("y").isNotNull())) for c in columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), C.name(c).alias("x")) for c in columns])).alias("v")
    return [(list(columns), data.where(F.col("__y").isNotNull()).select(pairs, y).select("v.column", "v.x", "y").where(F.col("x").isNotNull()))]


def rank_sums(data: DataFrame, columns: Sequence[str], few: int = FEW_VALUES) -> DataFrame:
    """(column, m, sx, sy, sxx, syy, sxy): of each column's pairs with __y their number, and the sums of both average ranks, their
    squares and their products; taken at once, a row for each column.

    The ranks of x are added up by value of y, so next to what comes from the scan there are rows only for different values of
    either side, never for different pairs. Up to so many ranks of x are broadcast to the rows, more are joined by value."""
    parts, n = _paired(data, columns), F.count(F.lit(1)).alias("n")
    w = lambda e: F.sum(F.col("n") * e)
    with ranks.held(ranks.united([p.groupBy("column", F.col("x").alias("value")).agg(n) for _, p in parts])) as xs:
        different = {r["column"]: r["n"] for r in xs.groupBy("column").agg(n).collect()}
        placed = ranks.placed(xs).select("column", F.col("value").alias("x"), "n", ranks.average_rank().alias("rx"))
        by_y = []
        for names, p in parts:
            known = placed.where(F.col("column").isin(*names)).drop("n")
            known = F.broadcast(known) if sum(different.get(c, 0) for c in names) <= few else known
            by_y.append(p.join(known, ["column", "x"]).groupBy("column", F.col("y").alias("value")).agg(n, F.sum("rx").alias("s")))
        with ranks.held(ranks.united(by_y)) as ys:
            ry, rx = ranks.average_rank(), F.col("rx")
            of_x = placed.groupBy("column").agg(w(rx).alias("sx"), w(rx * rx).alias("sxx"))
            of_y = ranks.placed(ys).groupBy("column").agg(F.sum("n").alias("m"), w(ry).alias("sy"), w(ry * ry).alias("syy"), F.sum(F.col("s") * ry).alias("sxy"))
            out = of_y.join(F.broadcast(of_x), "column")  # a row for each column
            return data.sparkSession.createDataFrame(out.collect(), out.schema)


def regression_correlations(df: DataFrame, y: Column, columns: Sequence[str]) -> DataFrame:
    """Pearson and Spearman of each column with a numeric response; needs 3 pairs and 2 values."""
    data = df.select(y.alias("__y"), *[C.as_number(df, c).alias(c) for c in columns])
    pearson = C.rows_of(data, [F.struct(F.lit(c).alias("column"), F.count(F.when(C.name(c).isNotNull() & F.col("__y").isNotNull(), 1)).alias("n"), C.correlation(C.name(c), F.col("__y")).alias("pearson")) for c in columns])
    sums = rank_sums(data, columns)
    d = lambda c: F.col(c).cast("double")
    part = lambda a, b, ab: d(ab) - d(a) * d(b) / d("m")
    spread = F.sqrt(part("sx", "sx", "sxx") * part("sy", "sy", "syy"))
    out = sums.select("column", F.when(spread > 0, part("sx", "sy", "sxy") / spread).alias("spearman"))
    both = pearson.join(F.broadcast(out), "column", "left")
    fit = F.col("n") >= 3
    s = F.when(fit, F.col("spearman"))
    return both.select("column", "n", F.when(fit, F.col("pearson")).alias("pearson"), s.alias("spearman"), F.when(s.isNull() | (F.abs(s) < 1e-12), "none").when(s > 0, "positive").otherwise("negative").alias("direction"))
