"""Realtime operators. Each works on a static round (or rounds) as on a micro-batch; the wrappers at the end run them on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import windows as W
from ..operators.relational import latest_state


def accepted(quotes: DataFrame, active: DataFrame, least: float = 0.95, round_: str = "round_time") -> DataFrame:
    """Rounds with quotes of at least ceil(least * active stocks); one row a round."""
    n = active.select("stock_code").distinct().agg(F.count("*").alias("active"))
    got = quotes.join(active.select("stock_code"), "stock_code", "left_semi").groupBy(round_).agg(F.countDistinct("stock_code").alias("received"))
    return got.crossJoin(F.broadcast(n)).withColumn("accepted", F.col("received") >= F.ceil(F.col("active") * least))  # one row


def accepted_rows(quotes: DataFrame, active: DataFrame, least: float = 0.95) -> DataFrame:
    """The quotes of accepted rounds: what is published."""
    return quotes.join(accepted(quotes, active, least).filter("accepted").select("round_time"), "round_time", "left_semi")


#: Buckets of the change in percent, by name.
BUCKETS = ("up_5", "up_3", "up_0_to_3", "flat", "down_0_to_3", "down_3", "down_5")


def bucket(change: Column) -> Column:
    """The bucket of a change in percent; bounds belong to the bucket farther from zero."""
    return (
        F.when(change >= 5, "up_5").when(change >= 3, "up_3").when(change > 0, "up_0_to_3").when(change == 0, "flat")
        .when(change > -3, "down_0_to_3").when(change > -5, "down_3").otherwise("down_5")
    )


def breadth_state(up: Column, down: Column, quoted: Column) -> Column:
    share = lambda n: F.round(n / F.greatest(quoted, F.lit(1)) * 100, 2)
    return F.when(share(up) >= 65, "broadly_up").when(share(down) >= 65, "broadly_down").otherwise("mixed")


def overview(quotes: DataFrame) -> DataFrame:
    """By round: counts by direction and bucket, mean and median change, state of breadth, amount. Shares and means are of quotes
    that have a change."""
    c = F.col("change_pct")
    df = quotes.groupBy("round_time").agg(
        F.count("*").alias("quotes"), F.count(c).alias("quoted"), F.count_if(c > 0).alias("up"), F.count_if(c < 0).alias("down"), F.count_if(c == 0).alias("flat"), *[F.count_if(bucket(c) == b).alias(b) for b in BUCKETS if b != "flat"],
        F.round(F.sum(c.cast("decimal(20,8)")).cast("double") / F.count(c), 4).alias("mean_change"), F.percentile(c, F.lit(0.5)).alias("median_change"), F.sum(F.col("amount_yuan").cast("decimal(20,4)")).cast("double").alias("amount"),
    )
    share = lambda n: F.col(n) / F.greatest(F.col("quoted"), F.lit(1)) * 100
    return df.withColumns({"up_share": share("up"), "down_share": share("down"), "flat_share": share("flat"), "state": breadth_state(F.col("up"), F.col("down"), F.col("quoted"))})


#: The rankings of an overview: the column that orders, and whether its greatest come first.
RANKINGS = {"top_gainers": ("change_pct", True), "top_losers": ("change_pct", False), "top_amount": ("amount_yuan", True), "top_volume": ("volume_share", True)}


def leaders(quotes: DataFrame, n: int = 10) -> DataFrame:
    """By round: for each of RANKINGS the codes of the first n quotes, ties by code; changes that are null and amounts and volumes below
    zero don't rank."""
    order = F.array(*[F.struct(F.lit(name).alias("ranking"), (F.col(c) if down else -F.col(c)).cast("double").alias("by"), (F.col(c).isNotNull() if c == "change_pct" else F.col(c) >= 0).alias("fit")) for name, (c, down) in RANKINGS.items()])
    df = quotes.select("round_time", "stock_code", F.explode(order).alias("_")).filter("_.fit").select("round_time", "stock_code", "_.ranking", "_.by")
    first = df.withColumn("place", F.row_number().over(Window.partitionBy("round_time", "ranking").orderBy(F.desc("by"), "stock_code"))).filter(F.col("place") <= n)
    lists = first.groupBy("round_time", "ranking").agg(F.sort_array(F.collect_list(F.struct("place", "stock_code"))).alias("_"))  # at most n a group
    return lists.groupBy("round_time").agg(*[F.max(F.when(F.col("ranking") == name, F.col("_.stock_code"))).alias(name) for name in RANKINGS])


def market_overview(quotes: DataFrame, active: DataFrame, n: int = 10) -> DataFrame:
    """The whole overview of each round over active stocks: `overview`, coverage, limits where prices of both limits are known, and
    the four rankings."""
    codes = active.select("stock_code").distinct()
    own = quotes.join(codes, "stock_code", "left_semi")
    both = F.col("limit_up").isNotNull() & F.col("limit_down").isNotNull()
    hits = lambda side: F.when(F.count_if(both) > 0, F.count_if(both & _at_limit(side)))
    limits = own.groupBy("round_time").agg(hits("limit_up").alias("limit_ups"), hits("limit_down").alias("limit_downs"))
    expected = codes.agg(F.count("*").alias("expected"))
    df = overview(own).crossJoin(F.broadcast(expected)).join(limits, "round_time").join(leaders(own, n), "round_time")  # expected: one row
    return df.withColumn("coverage", F.col("quotes") / F.greatest(F.col("expected"), F.lit(1)) * 100)


def above_ma(quotes: DataFrame, factors: DataFrame) -> DataFrame:
    """By round: quotes at or above each mean of the latest daily factors, and above all. factors: one row a stock."""
    df = quotes.join(factors.select("stock_code", "ma5", "ma20", "ma60"), "stock_code")
    p = F.col("last_price")
    return df.groupBy("round_time").agg(*[F.count_if(p >= F.col(m)).alias(f"above_{m}") for m in ("ma5", "ma20", "ma60")], F.count_if((p >= F.col("ma5")) & (p >= F.col("ma20")) & (p >= F.col("ma60"))).alias("above_all"), F.count("*").alias("compared"))


def tolerance(price: Column) -> Column:
    return F.greatest(F.lit(0.001), F.abs(price) * 0.0002)


def intraday_structure(quotes: DataFrame) -> DataFrame:
    p = F.col("last_price")
    at = lambda c: F.abs(p - F.col(c)) <= tolerance(F.col(c))
    return quotes.groupBy("round_time").agg(F.count_if(p > F.col("open_price")).alias("above_open"), F.count_if(p < F.col("open_price")).alias("below_open"), F.count_if(at("high_price")).alias("at_high"), F.count_if(at("low_price")).alias("at_low"))


def limit_hits(quotes: DataFrame) -> DataFrame:
    """By round: quotes at their upper and at their lower limit, null where no quote has that limit, and those that have both."""
    n = lambda side: F.when(F.count(side) > 0, F.count_if(_at_limit(side)))
    return quotes.groupBy("round_time").agg(n("limit_up").alias("limit_ups"), n("limit_down").alias("limit_downs"), F.count_if(F.col("limit_up").isNotNull() & F.col("limit_down").isNotNull()).alias("verified"))


def _at_limit(side: str) -> Column:
    return F.abs(F.col(side) - F.col("last_price")) <= tolerance(F.col(side))


def strength(quotes: DataFrame, groups: DataFrame, by: str, *more: str, round_: str = "round_time", keep_unchanged: bool = False) -> DataFrame:
    """By round and group (sector or pool): coverage, changes, limits, heat of 0 to 100, leader and laggard. Also the pools' summary.

    more: further columns that name a group, as its taxonomy. Works on a stream whose round_ is an event-time window. keep_unchanged:
    also groups whose quotes have no change, and received, the number of quotes with or without one.
    """
    keys = [by, *more]
    sizes = groups.groupBy(*keys).agg(F.countDistinct("stock_code").alias("members"))
    c = F.col("change_pct")
    known = F.lit(True) if keep_unchanged else c.isNotNull()
    df = quotes.filter(known).join(groups.select(*keys, "stock_code").distinct(), "stock_code")
    df = df.groupBy(round_, *keys).agg(
        F.count("*").alias("received"), F.count(c).alias("quotes"), F.sum(c.cast("decimal(20,8)")).cast("double").alias("_sum"), F.count_if(c > 0).alias("up"), F.count_if(c < 0).alias("down"), F.count_if(c == 0).alias("flat"), F.round(F.percentile(c, F.lit(0.5)), 4).alias("median_change"), F.count_if(_at_limit("limit_up")).alias("limit_ups"), F.count_if(_at_limit("limit_down")).alias("limit_downs"),
        F.sum(F.col("amount_yuan").cast("decimal(20,4)")).cast("double").alias("amount"), F.max(F.struct("change_pct", "stock_code")).alias("_a"), F.min(F.struct("change_pct", "stock_code")).alias("_b"),
    ).join(sizes, keys)
    mean = F.col("_sum") / F.col("quotes")
    limits = F.least(F.lit(25.0), F.col("limit_ups") / F.col("members") * 250) - F.least(F.lit(10.0), F.col("limit_downs") / F.col("members") * 100)
    heat = F.least(F.lit(35.0), F.greatest(F.lit(0.0), (mean + 3) / 6 * 35)) + F.col("up") / F.col("quotes") * 30 + limits + F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.log10(F.greatest(F.lit(1.0), F.col("amount"))) - 6))
    coverage = F.col("quotes") / F.col("members") * 100
    return df.select(round_, *keys, "members", *(["received"] if keep_unchanged else []), "quotes", coverage.alias("coverage"), F.when(coverage >= 95, "high").when(coverage >= 80, "medium").otherwise("low").alias("confidence"), F.round(mean, 6).alias("mean_change"), "median_change", "up", "down", "flat", "limit_ups", "limit_downs", F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), heat)), 4).alias("heat"), F.col("_a.stock_code").alias("leader"), F.col("_b.stock_code").alias("laggard"))


def points(rounds: DataFrame) -> DataFrame:
    """round_time, trade_date and point of each accepted round of `accepted`: numbered from 1 on each date. One row a round."""
    day = F.to_date("round_time")
    return rounds.filter("accepted").select("round_time", day.alias("trade_date"), F.row_number().over(Window.partitionBy(day).orderBy("round_time")).alias("point"))


def ranked(groups: DataFrame, rounds: DataFrame, by: str, *taxonomy: str) -> DataFrame:
    """Groups of `strength` in accepted rounds (of `points`) with rank by heat, coverage and code within round and taxonomy, previous_rank and
    rank_change against the accepted round just before; null on a date's first, and for a group that wasn't in it."""
    df = groups.join(rounds, "round_time").withColumn("rank", F.row_number().over(Window.partitionBy("round_time", *taxonomy).orderBy(F.desc("heat"), F.desc("coverage"), by)).cast("long"))
    before = _just_before(Window.partitionBy("trade_date", *taxonomy, by).orderBy("round_time"))
    df = df.withColumns({"previous_rank": before("rank"), "previous_leader": before("leader")})
    return df.withColumn("rank_change", F.col("previous_rank") - F.col("rank"))


def _just_before(w) -> Callable[[str], Column]:
    return lambda c: F.when(F.lag("point").over(w) == F.col("point") - 1, F.lag(c).over(w))


def timeline(quotes: DataFrame, active: DataFrame, least: float = 0.95) -> DataFrame:
    """One point an accepted round: the round's overview and its number within its trade date, from 1 on each date."""
    rounds = points(accepted(quotes, active, least))
    own = quotes.join(active.select("stock_code").distinct(), "stock_code", "left_semi")
    return overview(own).join(rounds, "round_time").select("trade_date", "point", "round_time", "quotes", "up", "down", "flat", "mean_change", "median_change", "amount", "state")


def change_events(ranks: DataFrame, line: DataFrame, by: str, jump: int = 5, leading: int = 10, leaders: int = 5, most: int | None = None) -> DataFrame:
    """What changed between an accepted round and the one before on its date: event_id is `round:n`, n in the order of the events.

    The market's breadth state (line: points of `timeline`); of the first `leading` groups of `ranked`, a rank that moved by `jump` or
    more; another leader of a group that is and was among the first `leaders`. None on a date's first round. most: events kept a round, None for all.
    """
    w = Window.partitionBy("trade_date").orderBy("round_time")
    switch = line.withColumn("_before", F.lag("state").over(w)).filter((F.col("point") > 1) & (F.col("_before") != F.col("state")))
    none = F.lit(None)
    market = switch.select("round_time", F.lit("market_breadth_changed").alias("kind"), none.cast("string").alias(by), none.cast("long").alias("rank"), none.cast("long").alias("previous_rank"), F.col("state").alias("value"), F.lit(0).cast("long").alias("_a"), F.lit(0).alias("_b"))
    top = ranks.filter(F.col("rank") <= leading)
    moved = top.filter(F.abs("rank_change") >= jump).select("round_time", F.when(F.col("rank_change") > 0, "rank_up").otherwise("rank_down").alias("kind"), by, "rank", "previous_rank", F.abs("rank_change").cast("string").alias("value"), F.col("rank").alias("_a"), F.lit(1).alias("_b"))
    led = top.filter((F.col("rank") <= leaders) & (F.col("previous_rank") <= leaders) & (F.col("previous_leader") != F.col("leader"))).select("round_time", F.lit("leader_changed").alias("kind"), by, "rank", "previous_rank", F.col("leader").alias("value"), F.col("rank").alias("_a"), F.lit(2).alias("_b"))
    n = F.row_number().over(Window.partitionBy("round_time").orderBy("_a", "_b"))
    df = market.unionByName(moved).unionByName(led).withColumn("n", n.cast("long"))
    df = df if most is None else df.filter(F.col("n") <= most)
    return df.select("round_time", F.concat(F.date_format("round_time", "yyyyMMddHHmmss"), F.lit(":"), "n").alias("event_id"), "kind", by, "rank", "previous_rank", "value")


def changed_quotes(quotes: DataFrame, fields: tuple[str, ...] = ("quote_time", "last_price", "change_pct", "volume_share", "amount_yuan")) -> DataFrame:
    """Quotes that differ from the stock's one before in a tracked field; the first counts as changed."""
    w = W.by("stock_code", order="round_time")
    now = F.struct(*fields)
    return quotes.withColumn("_p", F.lag(now).over(w)).filter(~F.col("_p").eqNullSafe(now)).drop("_p")


def depth_features(depth: DataFrame) -> DataFrame:
    """Volumes of both sides, imbalance, and spread, from arrays of (level, price, volume)."""
    volume = lambda c: F.aggregate(F.coalesce(c, F.array()), F.lit(0.0), lambda s, x: s + F.coalesce(x["volume"].cast("double"), F.lit(0.0)))
    b, a = volume("bids"), volume("asks")
    bid, ask = F.try_element_at("bids", F.lit(1))["price"], F.try_element_at("asks", F.lit(1))["price"]
    return depth.select("stock_code", "depth_time", b.alias("bid_volume"), a.alias("ask_volume"), F.round((b - a) / F.when(a + b > 0, a + b), 6).alias("imbalance"), F.round(ask - bid, 6).alias("spread"), F.round((ask - bid) / F.when(ask + bid != 0, (ask + bid) / 2) * 100, 6).alias("spread_pct"))


def last_depths(depth: DataFrame, n: int = 3) -> DataFrame:
    return depth.withColumn("_n", F.row_number().over(Window.partitionBy("stock_code").orderBy(F.desc("depth_time")))).filter(F.col("_n") <= n).drop("_n")


def minute_features(minutes: DataFrame) -> DataFrame:
    """Of each stock's day, at its last minute: changes over 1, 5 and 15 bars, recent 5 bars' volume against the 20 before, trend, strength."""
    w = Window.partitionBy("stock_code", "trade_date").orderBy(F.desc("bar_time"), F.desc("event_id"))
    whole = Window.partitionBy("stock_code", "trade_date")
    df = minutes.withColumns({"_n": F.row_number().over(w), "_hi": F.max("price").over(whole), "_lo": F.min("price").over(whole)})
    at = lambda k: F.max(F.when(F.col("_n") == k + 1, F.col("price")))
    mean = lambda a, b: F.sum(F.when(F.col("_n").between(a, b), F.col("volume_hand"))) / F.greatest(F.lit(1), F.count_if(F.col("_n").between(a, b)))
    prior = mean(6, 25)
    first = F.max_by("price", "_n")
    hi, lo = F.max("_hi"), F.min("_lo")
    return df.groupBy("stock_code", "trade_date").agg(
        *[((at(0) / F.when(at(k) != 0, at(k)) - 1) * 100).alias(f"return_{k}m") for k in (1, 5, 15)], F.round(mean(1, 5) / F.when(prior > 0, prior), 6).alias("volume_spike"), ((at(0) / F.when(first != 0, first) - 1) * 100).alias("trend"), ((at(0) - lo) / F.when(hi > lo, hi - lo)).alias("strength"), (at(0) >= hi).alias("breakout"),
    )


#: Order of lanes.
LANES = ("hot", "warm", "off")


def merge_targets(pools: DataFrame, quotes: DataFrame, strong: int, cap: int, active: DataFrame | None = None) -> DataFrame:
    """One row a stock of pools (pool, stock_code, priority, lane) or among the `strong` quotes that moved most: its reason, priority, lane,
    signal score, and its place.

    The strongest by absolute change, then amount, join as warm with priority 1000. A stock's reason and priority are those of its
    membership of the least priority, lane and name, its lane the best of all. The score is the change and up to 20 for the amount
    of its quote. By priority, lane, score and code the first `cap` hot ones are hot; the others overflow to the warm ones, after which those come.
    Stocks of lane off are left out, and those not in `active`. quotes: one row a stock.
    """
    own = quotes if active is None else quotes.join(active.select("stock_code").distinct(), "stock_code", "left_semi")
    in_pools = pools if active is None else pools.join(active.select("stock_code").distinct(), "stock_code", "left_semi")
    lane = lambda c: F.array_position(F.array(*map(F.lit, LANES)), c) - 1
    change, amount = F.coalesce(F.abs("change_pct"), F.lit(0.0)), F.coalesce("amount_yuan", F.lit(0.0))
    movers = own.orderBy(change.desc(), amount.desc(), "stock_code").limit(strong)
    member = F.struct(F.col("priority").cast("long").alias("priority"), "lane", "reason")
    rows = in_pools.select("stock_code", "priority", lane(F.col("lane")).alias("lane"), F.concat(F.lit("pool:"), "pool").alias("reason"))
    rows = rows.unionByName(movers.select("stock_code", F.lit(1000).alias("priority"), lane(F.lit("warm")).alias("lane"), F.lit("strong").alias("reason")))
    df = rows.groupBy("stock_code").agg(F.min(member).alias("_"), F.min("lane").alias("lane")).filter(F.col("lane") < 2)
    score = F.round(F.coalesce(change, F.lit(0.0)) + F.least(F.lit(20.0), F.log10(F.greatest(F.lit(1.0), F.coalesce(amount, F.lit(0.0)))) - 5), 4)
    df = df.join(quotes.select("stock_code", "change_pct", "amount_yuan"), "stock_code", "left").select("stock_code", F.col("_.reason").alias("reason"), F.col("_.priority").alias("priority"), "lane", score.alias("score"))
    in_order = [F.col("priority"), F.desc("score"), F.col("stock_code")]
    n = F.row_number().over(Window.partitionBy("lane").orderBy(*in_order))
    df = df.withColumn("overflow", (F.col("lane") == 0) & (n > cap))
    where = F.when((F.col("lane") == 0) & ~F.col("overflow"), "hot").otherwise("warm")
    # Hot ones beyond the cap come before the warm ones.
    place = F.row_number().over(Window.partitionBy("target").orderBy("lane", *in_order))
    return df.withColumn("target", where).withColumn("place", place.cast("long")).select("stock_code", "reason", "priority", "target", "score", "overflow", "place")


def in_session(ts: Column, phase: str = "continuous", zone: str = "Asia/Shanghai") -> Column:
    """Whether an instant (UTC) lies in the market's session on a weekday: the call auction, the part of it with depth, continuous
    trading, or the hours in which quotes are polled."""
    local = F.from_utc_timestamp(ts, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    spans = {"auction": [(555, 565)], "opening_depth": [(560, 565)], "continuous": [(570, 690), (780, 900)], "quote": [(555, 690), (775, 900)]}[phase]
    inside = F.lit(False)
    for a, b in spans:
        inside = inside | ((minute >= a) & ((minute < b) | ((minute == b) & (F.second(local) == 0))))
    return inside & (F.dayofweek(local) > 1) & (F.dayofweek(local) < 7)


def entry_triggers(candidates: DataFrame, quotes: DataFrame, depth: DataFrame, minutes: DataFrame, now: str, max_age: int = 15, depth_age: int = 20, snapshots: int = 3, bars: int = 5, low: float = -2.0, high: float = 4.0, near: float = 0.9998) -> DataFrame:
    """Each candidate (stock_code, entry_mode) at `now`: wait, reject or trigger with the reason.

    Its latest quote and depth must be fresh, the best ask must be one that can be bought; in mode auction as many depth
    snapshots of the day as `snapshots` are needed, in mode intraday as many minute bars as `bars`. Then the ask is compared
    with the close before and with the upper limit.
    """
    t = F.lit(now).cast("timestamp")
    today = lambda c: (F.col(c) <= t) & (F.to_date(c) == F.to_date(t))
    best = F.try_element_at(F.filter("asks", lambda x: (x["price"] > 0) & (x["volume"] > 0)), F.lit(1))["price"]
    df = latest_state(candidates, quotes, now, max_age, columns=("pre_close_price", "limit_up"), fresh="_quote")
    df = latest_state(df, depth.select("stock_code", "depth_time", best.alias("ask")), now, depth_age, "depth_time", ("ask",), "_depth")
    df = df.join(depth.filter(today("depth_time")).groupBy("stock_code").agg(F.count("*").alias("_snapshots")), "stock_code", "left")
    df = df.join(minutes.filter(today("bar_time")).groupBy("stock_code").agg(F.count("*").alias("_bars")), "stock_code", "left")
    few = lambda mode, c, n: (F.col("entry_mode") == mode) & (F.coalesce(F.col(c), F.lit(0)) < n)
    gap = (F.col("ask") / F.when(F.col("pre_close_price") > 0, F.col("pre_close_price")) - 1) * 100
    reason = (
        F.when(~F.col("_quote"), "quote_stale_or_missing").when(~F.col("_depth"), "depth_stale_or_missing").when(F.col("ask").isNull(), "executable_ask_missing")
        .when(few("auction", "_snapshots", snapshots), "auction_depth_history_insufficient").when(few("intraday", "_bars", bars), "minute_history_insufficient")
        .when(gap.isNull(), "entry_price_unavailable").when(gap < low, "gap_below_range").when(gap > high, "gap_above_range").when(F.col("ask") >= F.col("limit_up") * near, "near_limit_up_queue").otherwise("entry_confirmation_matched")
    )
    decision = F.when(reason == "entry_confirmation_matched", "trigger").when(reason.isin("gap_above_range", "near_limit_up_queue"), "reject").otherwise("wait")
    return df.select("stock_code", "entry_mode", reason.alias("reason"), decision.alias("decision"))


def drop_stale(df: DataFrame, now: str, seconds: int, time: str = "quote_time") -> DataFrame:
    return df.filter(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(time) <= seconds)


# ---- on streams ----------------------------------------------------------------------------------------------------


def run_rounds(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Calls handle(batch, id) for each micro-batch, as available now. Ids are stable, so a handler that overwrites by id is idempotent."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish(folder: str, topic: str, operator: Callable[[DataFrame], DataFrame], active: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """A handler that writes operator(batch) to folder/topic/batch=id, of accepted rounds only if active is given."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        if active is not None:
            batch = accepted_rows(batch, active)
        operator(batch).write.mode("overwrite").parquet(f"{folder}/{topic}/batch={batch_id}")

    return handle


def dedupe_events(stream: DataFrame, fields: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """Events once each, by a fingerprint of their fields: on a stream within the watermark, else the earliest of all, the least of equals."""
    df = stream.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*fields)), 256))
    if df.isStreaming:
        return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(["fingerprint"])
    first = df.groupBy("fingerprint").agg(F.min(F.struct(time, *[c for c in df.columns if c not in (time, "fingerprint")])).alias("_"))
    return first.select(*[F.col("fingerprint") if c == "fingerprint" else F.col(f"_.{c}").alias(c) for c in df.columns])


#: What exit triggers return, and their state: peak, next leg, open quantity (-1: not known yet).
EXITS = "trade_id long, quote_time timestamp, trigger string, price double, quantity long, remaining long"
FRESH_TRADE = (0.0, 0, -1)


def exit_triggers(quotes: DataFrame, stop: float = -4.0, activate: float = 6.0, drawdown: float = 3.0, legs: tuple[tuple[float, float], ...] = ((5.0, 0.5), (10.0, 1.0)), days: int = 3, max_age: int = 20, keep_days: int = 7, delay: str = "1 day") -> DataFrame:
    """Each sale: trade_id, quote_time, trigger, price, quantity and what remains, of quotes polled for trades.

    quotes: trade_id, poll_time, quote_time, depth_time, last_price, bid, entry_price, quantity (bought), holding_days. A quote and a
    depth older than max_age seconds at the poll, or no bid, do nothing; nor does anything on the day of entry (holding_days 0). By
    priority: stop, trailing stop, the next leg (gain, share of what is open, in lots of 100, or all if that is none), time. Sales are
    at the bid; the one that leaves nothing ends the trade.

    State by trade. On a stream, quotes later than the watermark of `delay` are left, and a trade that is closed is forgotten
    keep_days after; after that its quotes show more holding_days than any open trade has, and are left as well. A static frame is
    read in order of trade and time, with the state of one trade at a time.
    """

    def sells(frame: pd.DataFrame, state: tuple[float, int, int]) -> tuple[list[tuple], tuple[float, int, int]]:
        peak, leg, left = state
        rows = []
        for q in frame.itertuples():
            old = max((q.poll_time - t).total_seconds() if t == t else max_age + 1 for t in (q.quote_time, q.depth_time)) > max_age
            if left == 0 or q.holding_days < 1 or old or not q.bid > 0 or not q.last_price > 0:
                continue
            if left < 0:
                left = 0 if q.holding_days > days + keep_days else int(q.quantity)
                if not left:
                    continue
            peak = max(peak, q.entry_price, q.last_price)
            gain = (q.last_price / q.entry_price - 1) * 100
            why, sold = None, left
            if gain <= stop:
                why = "hard_stop"
            elif (peak / q.entry_price - 1) * 100 >= activate and (peak - q.last_price) / peak * 100 >= drawdown:
                why = "trailing_stop"
            elif leg < len(legs) and gain >= legs[leg][0]:
                sold = int(left * min(max(legs[leg][1], 0.0), 1.0) // 100 * 100) or left
                why, leg = f"take_profit_{leg + 1}", leg + 1
            elif q.holding_days >= days:
                why = "time_exit"
            if why:
                left -= sold
                rows.append((q.trade_id, q.quote_time, why, q.bid, sold, left))
        return rows, (peak, leg, left)

    columns = ["trade_id", "quote_time", "trigger", "price", "quantity", "remaining"]
    read = ["trade_id", "poll_time", "quote_time", "depth_time", "last_price", "bid", "entry_price", "quantity", "holding_days"]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        rows, now = [], state.get if state.exists else FRESH_TRADE
        last = state.getCurrentWatermarkMs()
        for frame in frames:
            more, now = sells(frame.sort_values(["poll_time", "quote_time", "last_price"]), now)
            rows += more
            last = max(last, int(frame["poll_time"].max().timestamp() * 1000))
        state.update(now)
        if now[2] == 0:
            state.setTimeoutTimestamp(last + keep_days * 86_400_000)
        yield pd.DataFrame(rows, columns=columns)

    def in_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trade, now = None, FRESH_TRADE
        for frame in frames:
            rows = []
            for key, part in frame.groupby("trade_id", sort=False):
                more, now = sells(part, now if key == trade else FRESH_TRADE)
                trade = key
                rows += more
            yield pd.DataFrame(rows, columns=columns)

    if not quotes.isStreaming:
        ordered = quotes.select(*read).repartition("trade_id").sortWithinPartitions("trade_id", "poll_time", "quote_time", "last_price")
        return ordered.mapInPandas(in_order, EXITS)
    return quotes.select(*read).withWatermark("poll_time", delay).groupBy("trade_id").applyInPandasWithState(update, EXITS, "peak double, leg int, remaining long", "append", "EventTimeTimeout")
