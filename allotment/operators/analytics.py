"""Result analytics: estimates against references, over repeats, budgets and methods.

`scored` rows are (game_id, method, repeat, budget_index, player, value, truth); `cells` rows are
one per (game_id, method, repeat, budget_index) with mse, rmse and the sum of the estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allotment.functions.hashing import order_key
from allotment.functions.student import simultaneous_t
from allotment.operators.skew import hot_rows, large

CELL = ["game_id", "method", "repeat", "budget_index"]
GROUP = ["game_id", "method", "budget_index"]


def score(estimates: DataFrame, truth: DataFrame) -> DataFrame:
    return estimates.join(large(truth.select("game_id", "player", F.col("share").alias("truth"))), ["game_id", "player"])


def cells(scored: DataFrame) -> DataFrame:
    gap = F.col("value") - F.col("truth")
    out = scored.groupBy(*CELL).agg(F.avg(gap * gap).alias("mse"), F.sum("value").alias("total"),
                                    F.sum("truth").alias("target"), F.avg(F.col("truth") * F.col("truth")).alias("truth_square"))
    return out.withColumn("rmse", F.sqrt("mse"))


def rmse_summary(cell_rows: DataFrame) -> DataFrame:
    """Aggregate RMSE (root of the mean MSE), mean and sample SD of the per-repeat RMSE, normalised RMSE."""
    return cell_rows.groupBy(*GROUP).agg(
        F.sqrt(F.avg("mse")).alias("aggregate_rmse"), F.avg("rmse").alias("mean_rmse"), F.stddev_samp("rmse").alias("sd_rmse"),
        (F.sqrt(F.avg("mse")) / F.sqrt(F.first("truth_square"))).alias("normalised_rmse"))


def bias(scored: DataFrame) -> DataFrame:
    """L2 norm and RMS over players of the error of the mean over repeats."""
    mean = scored.groupBy(*GROUP, "player").agg((F.avg("value") - F.first("truth")).alias("b"))
    return mean.groupBy(*GROUP).agg(F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("bias_l2"), F.sqrt(F.avg(F.col("b") * F.col("b"))).alias("bias_rmse"))


def efficiency_gap(cell_rows: DataFrame) -> DataFrame:
    gap = F.abs(F.col("total") - F.col("target"))
    return cell_rows.groupBy(*GROUP).agg(F.avg(gap).alias("mean_gap"), F.max(gap).alias("max_gap"))


def noise_corrected(scored: DataFrame, noise: DataFrame) -> DataFrame:
    """sqrt(max(0, MSE - mean squared standard error of the reference)); `noise` has game_id, player, mean_variance."""
    gap = F.col("value") - F.col("truth")
    joined = scored.join(large(noise.select("game_id", "player", "mean_variance")), ["game_id", "player"])
    out = joined.groupBy(*GROUP).agg(F.avg(gap * gap).alias("mse"), F.avg("mean_variance").alias("noise"))
    return out.select(*GROUP, F.sqrt(F.greatest(F.lit(0.0), F.col("mse") - F.col("noise"))).alias("corrected_rmse"))


def relative_errors(scored: DataFrame) -> DataFrame:
    """Average and largest |value/truth - 1| per repeat; a zero reference is an error, not a skipped row."""
    safe = F.when(F.col("truth") == 0, F.raise_error(F.lit("relative error of a zero reference")).cast("double")).otherwise(F.col("truth"))
    ratio = F.abs(F.col("value") / safe - 1)
    return scored.groupBy(*CELL).agg(F.avg(ratio).alias("average_relative"), F.max(ratio).alias("maximum_relative"))


def cumulative_levels(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, copies, earlier, total): distinct values with the rows before them, for keys of any size.

    Rows collapse to distinct values first. A key with many of them is cut into ranges of the value
    axis: totals per range, running sums over ranges, then running sums inside a range. No task
    ever holds a whole large key.
    """
    levels = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("copies"))
    stats = levels.groupBy(*keys).agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("_levels"),
                                      F.min(value).cast("double").alias("_low"), F.max(value).cast("double").alias("_high"))
    width = F.ceil(F.col("_levels") / F.lit(hot_rows()))
    spot = (F.col(value).cast("double") - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-300))
    cut_ = levels.join(stats, keys).withColumn("_part", F.least(F.floor(spot * width), width - 1)).drop("_levels", "_low", "_high")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut_.groupBy(*keys, "_part").agg(F.sum("copies").alias("_c")).select(
        *keys, "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = cut_.withColumn("_local", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    return local.join(parts, [*keys, "_part"]).select(*keys, value, "copies", "total", (F.col("_carried") + F.col("_local")).alias("earlier"))


def average_ranks(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Add the rank of `value` within keys; ties share their mean rank. For keys of any size."""
    ranks = cumulative_levels(rows, keys, value).select(*keys, value, (F.col("earlier") + (F.col("copies") + 1) / 2).alias(name))
    return rows.join(large(ranks), [*keys, value])


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per key, read off cumulative counts: exact for keys of any size."""
    levels = cumulative_levels(rows, keys, value)
    reach = F.col("earlier") + F.col("copies")

    def quantile(p: float) -> Column:
        spot = (F.col("total") - 1) * F.lit(float(p))
        low = F.min(F.when(reach > F.floor(spot), F.col(value)))
        high = F.min(F.when(reach > F.ceil(spot), F.col(value)))
        part = F.first(spot - F.floor(spot))
        return low + (high - low) * part

    return levels.groupBy(*keys).agg(*[quantile(p).alias(name) for name, p in points.items()])


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank with ties sharing their mean rank, for keys that fit a window: the mean of a tie's first and last place, off one sort."""
    order = Window.partitionBy(*keys).orderBy(value)
    upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (F.rank().over(order) + F.count(F.lit(1)).over(upto)) / 2


def rank_correlation(scored: DataFrame, wide: bool = False) -> DataFrame:
    """Mean over repeats of the Spearman correlation with the reference; constant sides leave a repeat out.

    wide=True ranks games that are too large for a window.
    """
    if wide:
        ranked = average_ranks(average_ranks(scored, CELL, "value", "rv"), CELL, "truth", "rt")
    else:
        ranked = scored.withColumn("rv", average_rank("value", CELL)).withColumn("rt", average_rank("truth", CELL))
    per = ranked.groupBy(*CELL).agg(F.when((F.stddev_pop("rv") > 0) & (F.stddev_pop("rt") > 0), F.corr("rv", "rt")).alias("rho"))
    return per.groupBy(*GROUP).agg(F.avg("rho").alias("mean_spearman"), F.count("rho").alias("defined"))


def top_overlap(scored: DataFrame, k: int = 5, wide: bool = True) -> DataFrame:
    """Mean over repeats of |top-k of the estimate and of the reference| / min(k, n); ties go to the lower player.

    wide=True is for games that are too large for a window: each side is a top-k filter, which Spark applies before the shuffle;
    only k rows per cell meet. Else both ranks are taken where the cell's rows are, in one pass.
    """
    rank = lambda c: F.row_number().over(Window.partitionBy(*CELL).orderBy(F.desc(c), "player"))
    if not wide:
        ranked = scored.withColumn("_v", rank("value")).withColumn("_t", rank("truth"))
        per = ranked.groupBy(*CELL).agg((F.sum(((F.col("_v") <= k) & (F.col("_t") <= k)).cast("bigint")) / F.least(F.count(F.lit(1)), F.lit(k))).alias("share"))
        return per.groupBy(*GROUP).agg(F.avg("share").alias("mean_top_overlap"))
    top = lambda c: scored.withColumn("_r", rank(c)).where(F.col("_r") <= k).select(*CELL, "player")
    sizes = top("truth").groupBy(*CELL).agg(F.count(F.lit(1)).alias("size"))
    common = top("value").join(large(top("truth")), [*CELL, "player"]).groupBy(*CELL).agg(F.count(F.lit(1)).alias("common"))
    per = sizes.join(large(common), CELL, "left").withColumn("share", F.coalesce("common", F.lit(0)) / F.col("size"))
    return per.groupBy(*GROUP).agg(F.avg("share").alias("mean_top_overlap"))


def repeat_arrays(cell_rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Values by repeat in one array per key (as many entries as repeats)."""
    pairs = F.sort_array(F.collect_list(F.struct("repeat", value)))
    return cell_rows.groupBy(*keys).agg(F.transform(pairs, lambda p: p[value]).alias(name))


def draws(rows: DataFrame, sizes: Column, count: int, seed: str) -> DataFrame:
    """Bootstrap: `count` index vectors per row, the same for all rows with the same number of repeats."""
    spread = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    index = F.transform(F.sequence(F.lit(0), sizes - 1), lambda r: (order_key(seed, F.col("draw"), r) % sizes).cast("int"))
    return spread.select("*", F.inline(F.array(F.struct(index.alias("index")))))


def mean_at(array: str) -> Column:
    """Mean of an array at the drawn indices."""
    return F.aggregate("index", F.lit(0.0), lambda acc, i: acc + F.col(array)[i]) / F.size("index")


def interval(value: Column, name: str) -> list[Column]:
    return [F.percentile(value, F.lit(0.025)).alias(f"{name}_low"), F.percentile(value, F.lit(0.975)).alias(f"{name}_high")]


def bootstrap_rmse(cell_rows: DataFrame, count: int, seed: str) -> DataFrame:
    rows = draws(repeat_arrays(cell_rows, GROUP, "mse", "mses"), F.size("mses"), count, seed)
    return rows.groupBy(*GROUP).agg(*interval(F.sqrt(mean_at("mses")), "rmse"))


def paired_arrays(cell_rows: DataFrame, candidate: str, reference: str, value: str = "mse") -> DataFrame:
    """Aligned arrays of two methods per (game, budget)."""
    keys = ["game_id", "budget_index"]
    side = lambda m, name: repeat_arrays(cell_rows.where(F.col("method") == m), keys, value, name)
    return side(candidate, "mine").join(large(side(reference, "theirs")), keys)


def bootstrap_change(cell_rows: DataFrame, candidate: str, reference: str, count: int, seed: str) -> DataFrame:
    """Interval of the relative RMSE change and the percent reduction, on shared index draws; zero references drop out."""
    rows = draws(paired_arrays(cell_rows, candidate, reference), F.size("mine"), count, seed)
    ratio = F.sqrt(mean_at("mine") / F.nullif(mean_at("theirs"), F.lit(0.0)))
    rows = rows.withColumn("ratio", ratio)
    return rows.groupBy("game_id", "budget_index").agg(
        *interval(F.col("ratio") - 1, "change"), *interval(100.0 * (1 - F.col("ratio")), "reduction"))


def paired_difference(cell_rows: DataFrame, candidate: str, reference: str, count: int, seed: str) -> DataFrame:
    """Mean paired RMSE difference, its bootstrap interval, and how often the candidate is worse."""
    rows = draws(paired_arrays(cell_rows, candidate, reference, "rmse"), F.size("mine"), count, seed)
    rows = rows.withColumn("gaps", F.zip_with("mine", "theirs", lambda a, b: a - b))
    size = F.size("gaps")
    first = F.first(F.aggregate("gaps", F.lit(0.0), lambda a, g: a + g) / size)
    larger = F.first(F.aggregate("gaps", F.lit(0.0), lambda a, g: a + F.when(g > 0, 1.0).otherwise(0.0)) / size)
    return rows.groupBy("game_id", "budget_index").agg(
        first.alias("mean_difference"), larger.alias("fraction_larger"), *interval(mean_at("gaps"), "difference"))


def safe_ratio(a: Column, b: Column) -> Column:
    """a/b with 0/0 = 1 and x/0 missing."""
    return F.when(b == 0, F.when(a == 0, 1.0)).otherwise(a / b)


def geometric_mean(value: Column) -> Column:
    """exp(mean(log)), exactly 0 when any value is 0."""
    return F.when(F.min(value) == 0, 0.0).otherwise(F.exp(F.avg(F.log(F.when(value > 0, value)))))


def paired_outcomes(cell_rows: DataFrame, candidate: str, reference: str, tolerance: float = 1e-15) -> DataFrame:
    """Wins, losses, ties and unavailable pairs of the candidate, per (game, budget)."""
    pick = lambda m, p: cell_rows.where(F.col("method") == m).select(
        "game_id", "repeat", "budget_index", F.col("rmse").alias(f"{p}_rmse"), F.col("status").alias(f"{p}_status"))
    rows = pick(candidate, "mine").join(large(pick(reference, "their")), ["game_id", "repeat", "budget_index"])
    usable = (F.col("mine_status") == "ok") & (F.col("their_status") == "ok")
    gap = F.when(usable, F.col("mine_rmse") - F.col("their_rmse"))
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    out = rows.groupBy("game_id", "budget_index").agg(
        count(gap < -tolerance).alias("wins"), count(gap > tolerance).alias("losses"), count(F.abs(gap) <= tolerance).alias("ties"),
        count(~usable).alias("unavailable"), F.count(F.lit(1)).alias("registered"), F.avg(gap).alias("mean_difference"),
        F.avg(F.when(usable, safe_ratio(F.col("mine_rmse"), F.col("their_rmse")))).alias("mean_ratio"))
    compared = F.col("wins") + F.col("losses") + F.col("ties")
    return out.withColumn("win_rate", F.col("wins") / F.col("registered")).withColumn(
        "available_win_rate", F.when(compared > 0, F.col("wins") / compared)).drop("registered")


def rank_configurations(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """1-based rank of configurations within keys: failures, then score, then cost; missing scores last."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def log_correlation(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson of log10 values and Spearman; undefined for fewer than 2 rows, non-positive or constant values."""
    ranked = average_ranks(average_ranks(rows, keys, x, "rx"), keys, y, "ry")
    lx, ly = F.log10(F.when(F.col(x) > 0, F.col(x))), F.log10(F.when(F.col(y) > 0, F.col(y)))
    defined = (F.count(F.lit(1)) >= 2) & (F.min(x) > 0) & (F.min(y) > 0) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return ranked.groupBy(*keys).agg(
        defined.alias("defined"), F.count(F.lit(1)).alias("rows"), F.when(defined, F.corr(lx, ly)).alias("pearson_log10"),
        F.when(defined, F.corr("rx", "ry")).alias("spearman"))


def centred_correlation(rows: DataFrame, cell: list[str], x: str, y: str) -> DataFrame:
    """Correlation of logs after removing the mean of every cell."""
    logs = rows.where((F.col(x) > 0) & (F.col(y) > 0)).select(*cell, F.log10(x).alias("lx"), F.log10(y).alias("ly"))
    means = logs.groupBy(*cell).agg(F.avg("lx").alias("mx"), F.avg("ly").alias("my"))
    centred = logs.join(means, cell).select((F.col("lx") - F.col("mx")).alias("cx"), (F.col("ly") - F.col("my")).alias("cy"))
    return centred.agg(F.corr("cx", "cy").alias("within_correlation"), F.count(F.lit(1)).alias("rows"))


def log_trend(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line of log10 y on log10 x."""
    rows = rows.where((F.col(x) > 0) & (F.col(y) > 0)).withColumn("lx", F.log10(x)).withColumn("ly", F.log10(y))
    return rows.groupBy(*keys).agg(F.regr_slope("ly", "lx").alias("slope"), F.regr_intercept("ly", "lx").alias("intercept"))


def compare_runs(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Fractional change and ratio of a metric between two runs."""
    joined = before.select(*keys, F.col(value).alias("before")).join(large(after.select(*keys, F.col(value).alias("after"))), keys)
    return joined.withColumn("ratio", safe_ratio(F.col("after"), F.col("before"))).withColumn("change", F.col("ratio") - 1)


def audit_metrics(recomputed: DataFrame, stored: DataFrame, keys: list[str], metric: str, tolerance: float) -> DataFrame:
    """Rows where a stored metric is missing, unexpected or off by more than the tolerance."""
    joined = recomputed.select(*keys, F.col(metric).alias("expected")).join(
        stored.select(*keys, F.col(metric).alias("stored")), keys, "full_outer")
    problem = (F.when(F.col("stored").isNull() & F.col("expected").isNotNull(), "missing")
               .when(F.col("expected").isNull() & F.col("stored").isNotNull(), "unexpected")
               .when(F.abs(F.col("stored") - F.col("expected")) > tolerance, "differs"))
    return joined.withColumn("problem", problem).where("problem is not null")


def audit_grid(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Missing, unexpected and duplicate cells."""
    have = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    want = expected.select(*keys).distinct().withColumn("wanted", F.lit(True))
    joined = want.join(large(have), keys, "full_outer")
    problem = (F.when(F.col("copies").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("copies") > 1, "duplicate"))
    return joined.withColumn("problem", problem).where("problem is not null").select(*keys, "problem")


def audit_overlap(left: DataFrame, right: DataFrame, keys: list[str], ignore: list[str] = ()) -> DataFrame:
    """Shared keys whose other columns differ (null-safe), apart from timing columns."""
    fields = [c for c in left.columns if c not in keys and c not in ignore]
    a = left.select(*keys, F.struct(*fields).alias("a"))
    b = right.select(*keys, F.struct(*fields).alias("b"))
    return a.join(large(b), keys).where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys)


def merge_runs(runs: list[DataFrame], keys: list[str]) -> DataFrame:
    """One copy of every cell of several runs that agree where they overlap."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out.dropDuplicates(keys)


def metric_summary(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sample SD of several metrics, one row per (keys, metric)."""
    long = rows.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])))
    return long.groupBy(*keys, "metric").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.count("x").alias("rows"))


def timing_summary(rows: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    """Mean, exact median, fastest and slowest per cell of any size."""
    summary = rows.groupBy(*keys).agg(F.avg(seconds).alias("mean"), F.min(seconds).alias("fastest"), F.max(seconds).alias("slowest"), F.count(seconds).alias("rows"))
    return summary.join(exact_quantiles(rows, keys, seconds, {"median": 0.5}), keys)


def modelled_time(calls: DataFrame, unit_costs: DataFrame, keys: list[str]) -> DataFrame:
    """calls x median unit cost + design seconds."""
    return calls.join(unit_costs, keys).withColumn("modelled_seconds", F.col("calls") * F.col("median") + F.col("design_seconds"))


def interpolate_log(points: DataFrame, keys: list[str], x: str, y: str, at: Column) -> DataFrame:
    """Log-log interpolation of a curve at a given x, from the bracketing pair of points."""
    w = Window.partitionBy(*keys).orderBy(x)
    pairs = points.withColumn("at", at.cast("double")).withColumn("x1", F.lead(x).over(w)).withColumn("y1", F.lead(y).over(w))
    inside = pairs.where((F.col(x) <= F.col("at")) & (F.col("at") < F.col("x1")))
    t = (F.log("at") - F.log(x)) / (F.log("x1") - F.log(x))
    return inside.select(*keys, F.col("at"), F.exp(F.log(y) + t * (F.log("y1") - F.log(y))).alias("interpolated"))


def reference_moments(contributions: DataFrame, halves: Column) -> DataFrame:
    """count, sum and sum of squares per player, and the same split by half."""
    x = F.col("contribution")
    return contributions.groupBy("game_id", "player").agg(
        F.count(x).alias("count"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"),
        F.sum(F.when(halves, x).otherwise(0.0)).alias("first_total"), F.sum(halves.cast("bigint")).alias("first_count"))


def reference_uncertainty(moments: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Value, standard error, simultaneous half-width and half-split gap per player.

    The half-widths hold for all players of a game together at level alpha: Student t with count - 1 degrees of
    freedom at alpha over twice the players. `moments` has one row per player.
    """
    n = F.col("count")
    moments = moments.withColumn("critical", simultaneous_t(n, F.count(F.lit(1)).over(Window.partitionBy("game_id")), alpha))
    mean = F.col("total") / n
    variance = F.greatest((F.col("squares") - n * mean * mean) / (n - 1), F.lit(0.0))
    first, second = F.col("first_total") / F.col("first_count"), (F.col("total") - F.col("first_total")) / (n - F.col("first_count"))
    return moments.select("game_id", "player", mean.alias("value"), F.sqrt(variance / n).alias("standard_error"),
                          (F.col("critical") * F.sqrt(variance / n)).alias("half_width"), (first - second).alias("half_gap"))


def reference_summary(uncertainty: DataFrame) -> DataFrame:
    """RMS standard error, largest half-width and half-split RMSE per game."""
    se, gap = F.col("standard_error"), F.col("half_gap")
    return uncertainty.groupBy("game_id").agg(F.sqrt(F.avg(se * se)).alias("rms_standard_error"), F.max("half_width").alias("largest_half_width"),
                                              (0.5 * F.sqrt(F.avg(gap * gap))).alias("half_split_rmse"))


def status_summary(rows: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Failed cells stay as rows; they are counted and kept out of the means."""
    ok = F.col("status") == "ok"
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("registered"), F.sum(ok.cast("bigint")).alias("successful"), F.sum((~ok).cast("bigint")).alias("failed"),
        F.avg(F.when(ok, F.col(metric))).alias("mean_ok"), F.when(F.min(ok), F.avg(F.col(metric))).alias("mean_complete"))


def score_matrix(rows: DataFrame, row: list[str], column: str, values: list, score_: Column) -> DataFrame:
    return rows.groupBy(*row).pivot(column, values).agg(score_)
