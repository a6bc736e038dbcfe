"""Column helpers over ordered windows. All of an operator's entity windows share one partitioning and order, so Spark
sorts once. Frames count rows, not days; nulls are passed over by averages as SQL has it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by(*keys: str, order: str | list = "trade_date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*(order if isinstance(order, list) else [order]))


def _of(w: WindowSpec | None) -> WindowSpec:
    """The window given, or that of a stock by day; made when asked for, as it needs a session."""
    return w if w is not None else by("stock_code")


def sma(col: str | Column, n: int, w: WindowSpec | None = None) -> Column:
    """Mean of the last n rows, fewer at the start."""
    return F.avg(col).over(_of(w).rowsBetween(1 - n, 0))


def prior_mean(col: str | Column, n: int = 5, w: WindowSpec | None = None) -> Column:
    """Mean of the n rows before this one."""
    return F.avg(col).over(_of(w).rowsBetween(-n, -1))


def lag_k(col: str | Column, k: int, w: WindowSpec | None = None) -> Column:
    return F.lag(col, k).over(_of(w))


def rolling_std(col: str | Column, n: int = 20, w: WindowSpec | None = None) -> Column:
    return F.stddev_pop(col).over(_of(w).rowsBetween(1 - n, 0))


def rolling_extreme(col: str | Column, n: int, fn: str = "max", w: WindowSpec | None = None) -> Column:
    return getattr(F, fn)(col).over(_of(w).rowsBetween(1 - n, 0))


def prior_extreme(col: str | Column, n: int, fn: str = "max", w: WindowSpec | None = None) -> Column:
    """Extreme of the n rows strictly before this one."""
    return getattr(F, fn)(col).over(_of(w).rowsBetween(-n, -1))


def history_days(w: WindowSpec | None = None) -> Column:
    return F.row_number().over(_of(w))


def guarded(expr: Column, source: str | Column, n: int, w: WindowSpec | None = None, order: str = "trade_date") -> Column:
    """expr, where none of the last n rows (or all there are) lacks its source. The last gap is kept as the window moves, so n costs nothing."""
    source, w = F.col(source) if isinstance(source, str) else source, _of(w)
    gap = running(F.when(source.isNull(), F.col(order)), "max", w)
    return F.when(gap.isNull() | F.coalesce(gap < F.lag(order, n - 1).over(w), F.lit(False)), expr)


def moving_means(df: DataFrame, col: str, widths: tuple[int, ...], keys: tuple[str, ...] = ("stock_code",), order: str = "trade_date") -> DataFrame:
    """Adds mean_n for each width: the mean of the last n rows, fewer at the start, nulls passed over.

    A difference of two running sums each, so a width of 250 costs a row what one of 5 does. The sums are decimals: nothing is lost
    by taking one from the other. Values have at most 11 digits before the point; larger ones count as null.
    """
    w = by(*keys, order=order)
    value = F.col(col).try_cast("decimal(27,16)")
    df = df.withColumns({"_sum": running(value, "sum", w), "_known": running(value, "count", w)})
    since = lambda c, n: F.col(c) - F.coalesce(F.lag(c, n).over(w), F.lit(0))
    means = {f"mean_{n}": since("_sum", n).cast("double") / F.when(since("_known", n) > 0, since("_known", n)) for n in widths}
    return df.withColumns(means).drop("_sum", "_known")


def rolling_sum(col: str | Column, n: int, w: WindowSpec | None = None) -> Column:
    return F.sum(col).over(_of(w).rowsBetween(1 - n, 0))


def rolling_count(col: str | Column, n: int, w: WindowSpec | None = None) -> Column:
    return F.count(col).over(_of(w).rowsBetween(1 - n, 0))


def streak(df: DataFrame, condition: Column, out: str, keys: tuple[str, ...] = ("stock_code",), order: str = "trade_date") -> DataFrame:
    """Adds how many rows in a row, up to and with this one, meet the condition; null conditions break it. No look-ahead."""
    w = by(*keys, order=order)
    met = F.coalesce(condition, F.lit(False))
    df = df.withColumn("_island", F.sum(F.when(met, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.when(met, F.sum(F.when(met, 1).otherwise(0)).over(inside)).otherwise(0).cast("long")).drop("_island")


def cume_pct(col: str, by_: str = "trade_date") -> Column:
    """Share of the day's values not above this one, in percent; null stays null and takes no part."""
    w = Window.partitionBy(by_, F.col(col).isNull()).orderBy(F.col(col))
    return F.when(F.col(col).isNotNull(), F.cume_dist().over(w) * 100)


def rsi_simple(delta: Column, n: int = 14, w: WindowSpec | None = None) -> Column:
    """Relative strength by simple means of gains and losses; 100 where there are only gains."""
    gain = sma(F.greatest(delta, F.lit(0.0)), n, w)
    loss = sma(F.greatest(-delta, F.lit(0.0)), n, w)
    return F.when((loss == 0) & (gain > 0), 100.0).when(loss > 0, 100 - 100 / (1 + gain / loss))


def running(col: str | Column, fn: str, w: WindowSpec) -> Column:
    return getattr(F, fn)(col).over(w.rowsBetween(Window.unboundedPreceding, 0))


def prior_stats(col: str, n: int, w: WindowSpec) -> tuple[Column, Column]:
    """(mean, count) of the positive values among the n rows before."""
    positive = F.when(F.col(col) > 0, F.col(col))
    frame = w.rowsBetween(-n, -1)
    return F.avg(positive).over(frame), F.count(positive).over(frame)


def partition_agg(col: str | Column, fn: str, *keys: str) -> Column:
    return getattr(F, fn)(col).over(Window.partitionBy(*keys))


def _known_before(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Adds _known: how many rows before this one have a value. A range of n before it then holds the last n values known."""
    return df.withColumn("_known", F.count(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))


def history_percentile(df: DataFrame, keys: list[str], order: str, value: str, n: int = 120, negative: Column | None = None) -> DataFrame:
    """Adds sample and percentile: the mid-rank of the value among the n values before it that aren't null, in percent; negative turns it around.

    The n values are an array, never more.
    """
    df = _known_before(df, keys, order, value).withColumn("_h", F.collect_list(value).over(Window.partitionBy(*keys).orderBy("_known").rangeBetween(-n, -1))).drop("_known")
    below = F.size(F.filter("_h", lambda x: x < F.col(value)))
    same = F.size(F.filter("_h", lambda x: x == F.col(value)))
    pct = (below + same * 0.5) / F.size("_h") * 100
    pct = F.when(F.col(value).isNotNull() & (F.size("_h") > 0), pct)
    return df.withColumn("sample", F.size("_h").cast("long")).withColumn("percentile", F.when(negative, 100 - pct).otherwise(pct) if negative is not None else pct).drop("_h")


def avg_rank_pct(col: str, by_: str = "trade_date") -> Column:
    """Mean place of equal values among the day's, from 0 to 100; a single value has 100; null stays null."""
    c = F.col(col)
    ordered, same, all_ = Window.partitionBy(by_, c.isNull()).orderBy(c), Window.partitionBy(by_, c), Window.partitionBy(by_, c.isNull())
    n = F.count(F.lit(1)).over(all_)
    place = F.rank().over(ordered) - 1 + (F.count(F.lit(1)).over(same) - 1) / 2
    return F.when(c.isNull(), None).when(n == 1, 100.0).otherwise(place / (n - 1) * 100)


def calendar_streak(events: DataFrame, calendar: DataFrame, complete: DataFrame | None = None) -> DataFrame:
    """events (stock_code, trade_date, distinct) with board_count: consecutive open days up to this one on which the stock has
    an event. complete (trade_date): days not in it have no events and break all streaks."""
    days = F.broadcast(calendar.select("trade_date", "idx"))
    if complete is not None:
        events = events.join(F.broadcast(complete.select("trade_date").distinct()), "trade_date", "left_semi")
    df = events.join(days, "trade_date").withColumn("_island", F.col("idx") - F.row_number().over(by("stock_code", order="idx")))
    return df.withColumn("board_count", F.row_number().over(Window.partitionBy("stock_code", "_island").orderBy("idx")).cast("long")).drop("_island", "idx")


def rank_with_delta(df: DataFrame, order: list[Column], round_: str, entity: str, group: str | None = None) -> DataFrame:
    """Adds rank within the round (and group) and rank_change: how many places up since the entity's round before."""
    keys = [round_] + ([group] if group else [])
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return df.withColumn("rank_change", F.lag("rank").over(by(*([group] if group else []), entity, order=round_)) - F.col("rank"))


def change_points(df: DataFrame, key: list[str], order: str, state: str) -> DataFrame:
    """Rows whose state differs from the row before of the same key, with that state; the first row is none."""
    w = by(*key, order=order)
    df = df.withColumn("previous_state", F.lag(state).over(w)).withColumn("_n", F.row_number().over(w))
    return df.filter((F.col("_n") > 1) & ~F.col(state).eqNullSafe(F.col("previous_state"))).drop("_n")


def crossed_up(a: str, b: str, w: WindowSpec | None = None) -> Column:
    """a was not above b on the row before, and is now."""
    return (F.lag(a).over(_of(w)) <= F.lag(b).over(_of(w))) & (F.col(a) > F.col(b))


def forward_compound(col: str, h: int, w: WindowSpec) -> Column:
    """Compounded change in percent over the next h rows; null if any of them is missing."""
    product = F.lit(1.0)
    for k in range(1, h + 1):
        product = product * (1 + F.lead(col, k).over(w) / 100)
    return (product - 1) * 100


def baseline_ratio(df: DataFrame, value: str, n: int, least: int, out: str, order: str = "trade_date", keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds value over the mean of the n values before it (of the same keys) that aren't null, where at least `least` are. Without
    keys it is for frames of one row a day."""
    w = Window.partitionBy(*keys).orderBy("_known").rangeBetween(-n, -1)
    mean, count = F.avg(value).over(w), F.count(value).over(w)
    return _known_before(df, list(keys), order, value).withColumn(out, F.when((count >= least) & (mean != 0), F.col(value) / mean)).drop("_known")


def recent_high_and_slope(score: str, w: WindowSpec) -> tuple[Column, Column]:
    """(highest of the five scores before, or this one; change since the one before, or 0)."""
    return F.coalesce(F.max(score).over(w.rowsBetween(-5, -1)), F.col(score)), F.col(score) - F.coalesce(F.lag(score).over(w), F.col(score))
