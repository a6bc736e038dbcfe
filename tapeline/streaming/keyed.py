"""Realtime operators on streams: rounds closed by event time, and state by key. Each equals its static form in `realtime`."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from . import realtime as X

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MARKET = "market"


def stateful(spark: SparkSession) -> SparkSession:
    """Sets the state store that keyed processors need, where the session has Spark's default."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBackedStateStoreProvider" in spark.conf.get(name):
        spark.conf.set(name, ROCKS)
    return spark


# ---- X1: rounds


def last_quotes(quotes: DataFrame, every: str = "1 minute", delay: str = "30 seconds") -> DataFrame:
    """window (the round, by quote_time), stock_code and the other columns of the stock's last quote of each round.

    A round is closed once the watermark of `delay` is past its end, whatever micro-batches its quotes came in; quotes that come
    later are dropped and counted by Spark (see `Lateness`). Of quotes of one time the greatest counts. Works on static frames too.
    """
    others = [c for c in quotes.columns if c not in ("stock_code", "quote_time", "round_time")]
    df = quotes.withColumn("quote_time", F.col("quote_time").cast("timestamp")).withWatermark("quote_time", delay).groupBy(F.window("quote_time", every), "stock_code").agg(F.max(F.struct("quote_time", *others)).alias("_"))
    return df.select("window", "stock_code", "_.*")


def rounds(quotes: DataFrame, every: str = "1 minute", delay: str = "30 seconds") -> DataFrame:
    """`last_quotes` with round_time, the round's start. On a stream each micro-batch holds whole rounds, for `publish`."""
    return last_quotes(quotes, every, delay).withColumn("round_time", F.col("window.start")).drop("window")


# ---- X8, X9, X10: what an accepted round changes

REPORT = "kind string, trade_date date, round_time timestamp, point long, sector_type string, sector_code string, rank long, previous_rank long, rank_change long, heat double, leader string, event_id string, event string, value string, quotes long, up long, down long, state string"
_COLUMNS = [x.strip().split()[0] for x in REPORT.split(",")]
_NUMBERS = ("point", "rank", "previous_rank", "rank_change", "quotes", "up", "down")


class Report(StatefulProcessor):
    """The last accepted round's ranks, leaders and breadth as state, and the number of its point on its date.

    Rows are groups of rounds (a few hundred a round), market included; a round enters if the market's quotes reach
    ceil(least * members).
    """

    def __init__(self, least: float, jump: int, leading: int, leaders: int):
        self.least, self.jump, self.leading, self.leaders = least, jump, leading, leaders

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "json string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        last = json.loads(self.last.get()[0]) if self.last.exists() else {}
        out: list[dict] = []
        for at, group in sorted(frame.groupby("round_time"), key=lambda x: x[0]):
            market = group[group["sector_type"] == MARKET]
            if len(market) and int(market["received"].iloc[0]) >= -(-int(market["members"].iloc[0]) * round(self.least * 1_000_000) // 1_000_000):
                last = self._accepted(at, market.iloc[0], group[(group["sector_type"] != MARKET) & (group["quotes"] > 0)], last, out)
        if last:
            self.last.update((json.dumps(last),))
        df = pd.DataFrame(out, columns=_COLUMNS)
        yield df.astype({c: "Int64" for c in _NUMBERS})

    def _accepted(self, at: pd.Timestamp, market: pd.Series, groups: pd.DataFrame, last: dict, out: list[dict]) -> dict:
        day = at.date()
        if last.get("day") != str(day):
            last = {"day": str(day), "point": 0, "ranks": {}, "leaders": {}, "state": None}
        base = {"trade_date": day, "round_time": at, "point": last["point"] + 1}
        up, down, quoted = (int(market[c]) for c in ("up", "down", "quotes"))
        share = lambda n: round(n / max(quoted, 1) * 100 + 1e-9, 2)
        state = "broadly_up" if share(up) >= 65 else "broadly_down" if share(down) >= 65 else "mixed"
        out.append(base | {"kind": "point", "quotes": int(market["received"]), "up": up, "down": down, "state": state})
        events, ranks, leaders = [], {}, {}
        if last["point"] and state != last["state"]:
            events.append((0, 0, {"event": "market_breadth_changed", "value": state}))
        ordered = groups.assign(_h=-groups["heat"], _c=-groups["coverage"]).sort_values(["sector_type", "_h", "_c", "sector_code"])
        for kind, own in ordered.groupby("sector_type", sort=False):
            for rank, row in enumerate(own.itertuples(), 1):
                name = f"{kind}:{row.sector_code}"
                before, ranks[name], leaders[name] = last["ranks"].get(name), rank, row.leader
                moved = before - rank if before else None
                what = base | {"sector_type": kind, "sector_code": row.sector_code, "rank": rank, "previous_rank": before}
                out.append(what | {"kind": "rank", "rank_change": moved, "heat": row.heat, "leader": row.leader})
                if rank <= self.leading and moved and abs(moved) >= self.jump:
                    events.append((rank, 1, what | {"event": "rank_up" if moved > 0 else "rank_down", "value": str(abs(moved))}))
                if before and max(rank, before) <= self.leaders and last["leaders"][name] != row.leader:
                    events.append((rank, 2, what | {"event": "leader_changed", "value": row.leader}))
        for n, (_, _, event) in enumerate(sorted(events, key=lambda e: e[:2]), 1):
            out.append(base | event | {"kind": "event", "event_id": f"{at:%Y%m%d%H%M%S}:{n}"})
        return last | {"point": base["point"], "ranks": ranks, "leaders": leaders, "state": state}

    def close(self) -> None:
        pass


def report(quotes: DataFrame, groups: DataFrame, active: DataFrame, least: float = 0.95, jump: int = 5, leading: int = 10, leaders: int = 5, every: str = "1 minute", delay: str = "30 seconds") -> DataFrame:
    """Points of the timeline, ranks of groups and change events of accepted rounds of a stream of quotes, as rows of REPORT.

    groups: sector_type, sector_code, stock_code. Quotes are gathered by round and stock, then by round and group, each over the whole cluster;
    what is left, a row a group, goes to one keyed processor in the order of rounds. State goes on over batches and restarts,
    and starts anew on each date. Static twins: `realtime.timeline`, `ranked`, `change_events`.
    """
    stateful(quotes.sparkSession)
    codes = active.select("stock_code").distinct()
    own = groups.select("sector_type", "sector_code", "stock_code").distinct()
    all_ = own.unionByName(codes.select(F.lit(MARKET).alias("sector_type"), F.lit("*").alias("sector_code"), "stock_code"))
    last = last_quotes(quotes, every, delay)
    metrics = strength_of_windows(last, all_)
    in_key = metrics.select(F.lit(MARKET).alias("market"), F.col("window.start").alias("round_time"), "sector_type", "sector_code", "members", "received", "quotes", "up", "down", "coverage", "heat", "leader")
    return in_key.groupBy("market").transformWithStateInPandas(Report(least, jump, leading, leaders), REPORT, "Append", "None")


def strength_of_windows(last: DataFrame, groups: DataFrame) -> DataFrame:
    """`realtime.strength` by window and group, with received: quotes with or without a change."""
    return X.strength(last, groups, "sector_code", "sector_type", round_="window", keep_unchanged=True)


def write_report(folder: str) -> Callable[[DataFrame, int], None]:
    """A handler that appends a report to folder/kind, by trade date and batch: a batch that comes again replaces what it wrote."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for kind in ("point", "rank", "event"):
            own = batch.filter(F.col("kind") == kind).withColumn("batch", F.lit(batch_id))
            own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trade_date", "batch").parquet(f"{folder}/{kind}")
        batch.unpersist()

    return handle


# ---- X13, X14: histories by stock


class LastDepths(StatefulProcessor):
    def __init__(self, n: int, hours: int):
        self.n, self.hours = n, hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.depths = handle.getListState("depths", "depth_time timestamp, features string", self.hours * 3_600_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {(r[0], r[1]) for r in self.depths.get()} if self.depths.exists() else set()
        for frame in rows:
            known |= set(zip(frame["depth_time"].dt.to_pydatetime(), frame["features"], strict=True))
        newest = sorted(known, reverse=True)[: self.n]
        self.depths.put(newest)
        yield pd.DataFrame({"stock_code": key[0], "place": range(1, len(newest) + 1), "depth_time": [x[0] for x in newest], "features": [x[1] for x in newest]})

    def close(self) -> None:
        pass


def last_depths(depth: DataFrame, n: int = 3, hours: int = 24) -> DataFrame:
    """After each batch, of each stock in it the newest n depths with their features as JSON: stock_code, place (1 is the newest), depth_time, features.

    State is a list of at most n by stock, whose entries go `hours` after they were put. A depth that comes late takes its place by
    depth_time. As state goes by the clock, the query is one that runs on; it has no last batch.
    """
    stateful(depth.sparkSession)
    features = X.depth_features(depth)
    rows = features.select("stock_code", "depth_time", F.to_json(F.struct(*[c for c in features.columns if c not in ("stock_code", "depth_time")])).alias("features"))
    return rows.groupBy("stock_code").transformWithStateInPandas(LastDepths(n, hours), "stock_code string, place long, depth_time timestamp, features string", "Update", "ProcessingTime")


MINUTES = "stock_code string, trade_date date, return_1m double, return_5m double, return_15m double, volume_spike double, trend double, strength double, breakout boolean"


class MinuteRing(StatefulProcessor):
    """The newest 25 bars of a stock's day in order, and of all of them the first price, the highest and the lowest."""

    SIZE = 25

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "bar_time timestamp, event_id long, price double, volume double")
        self.day = handle.getValueState("day", "first_time timestamp, first_id long, first double, high double, low double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bars = list(self.ring.get()) if self.ring.exists() else []
        bars = [(b[0], b[1], b[2], b[3]) for b in bars]
        day = tuple(self.day.get()) if self.day.exists() else None
        for frame in rows:
            for bar in zip(frame["bar_time"].dt.to_pydatetime(), frame["event_id"].tolist(), frame["price"].tolist(), frame["volume_hand"].astype(float).tolist(), strict=True):
                bars.append(bar)
                if day is None or bar[:2] < day[:2]:
                    day = (*bar[:3], *(day[3:] if day else (bar[2], bar[2])))
                day = (*day[:3], max(day[3], bar[2]), min(day[4], bar[2]))
        bars = sorted(bars)[-self.SIZE :]
        self.ring.put(bars)
        self.day.update(day)
        if timerValues.getCurrentWatermarkInMs() >= 0:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            end = datetime.combine(key[1], datetime.min.time(), UTC) + timedelta(days=self.keep)
            self.handle.registerTimer(max(int(end.timestamp() * 1000), timerValues.getCurrentWatermarkInMs() + 1))
        price, volume = [b[2] for b in bars][::-1], [b[3] for b in bars][::-1]
        change = lambda k: (price[0] / price[k] - 1) * 100 if len(price) > k and price[k] else None
        mean = lambda v: sum(v) / max(1, len(v)) if v else None
        recent, prior = mean(volume[:5]), mean(volume[5:25])
        high, low = day[3], day[4]
        yield pd.DataFrame([(key[0], key[1], change(1), change(5), change(15), round(recent / prior, 6) if prior else None, (price[0] / day[2] - 1) * 100 if day[2] else None, (price[0] - low) / (high - low) if high > low else None, price[0] >= high)], columns=[x.split()[0] for x in MINUTES.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ring.clear()
        self.day.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def minute_features(minutes: DataFrame, delay: str = "10 minutes", keep: int = 2) -> DataFrame:
    """After each batch, `realtime.minute_features` of each stock and day in it, from bars in any order.

    State is a ring of 25 bars and three numbers by stock and day; it goes once the watermark is `keep` days past the day's start.
    Bars later than the watermark still take their place while the state is there.
    """
    stateful(minutes.sparkSession)
    rows = minutes.withColumn("bar_time", F.col("bar_time").cast("timestamp")).withWatermark("bar_time", delay).select("stock_code", "trade_date", "bar_time", "event_id", "price", "volume_hand")
    return rows.groupBy("stock_code", "trade_date").transformWithStateInPandas(MinuteRing(keep), MINUTES, "Update", "EventTime")


# ---- X17: entries

ENTRIES = "stock_code string, decision string, reason string, at timestamp, ask double"


class Entries(StatefulProcessor):
    """A candidate waits until a quote with its depth confirms or rejects it, or its window is over."""

    def __init__(self, rules: dict):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("candidate", "entry_mode string, starts timestamp, ends timestamp, reason string, done boolean")
        self.seen = handle.getMapState("seen", "kind string, at timestamp", "n int")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        starts, ends = row["starts"].to_pydatetime(), row["ends"].to_pydatetime()
        self.state.update((row["entry_mode"], starts, ends, "no_quote", False))
        self.handle.registerTimer(int(pd.Timestamp(row["ends"]).timestamp() * 1000) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if self.state.exists():
            mode, starts, ends, reason, done = self.state.get()
            for row in pd.concat(list(rows)).sort_values(["quote_time", "depth_time"]).itertuples():
                if done or not starts <= row.quote_time.to_pydatetime() <= ends:
                    continue
                for kind, at in (("depth", row.depth_time), ("minute", row.quote_time.floor("min"))):
                    self.seen.updateValue((kind, at.to_pydatetime()), (1,))
                counts = {"depth": 0, "minute": 0}
                for kind, _ in self.seen.keys():
                    counts[kind] += 1
                reason = self._reason(mode, row, counts)
                done = reason in ("entry_confirmation_matched", "gap_above_range", "near_limit_up_queue")
                if done:
                    decision = "trigger" if reason == "entry_confirmation_matched" else "reject"
                    out.append((key[0], decision, reason, row.quote_time, row.ask))
            self.state.update((mode, starts, ends, reason, done))
            if done:
                self.seen.clear()
        yield pd.DataFrame(out, columns=[x.split()[0] for x in ENTRIES.split(", ")])

    def _reason(self, mode: str, row, counts: dict) -> str:
        r = self.rules
        if not row.ask > 0:
            return "executable_ask_missing"
        if mode == "auction" and counts["depth"] < r["snapshots"]:
            return "auction_depth_history_insufficient"
        if mode == "intraday" and counts["minute"] < r["bars"]:
            return "minute_history_insufficient"
        if not row.pre_close_price > 0:
            return "entry_price_unavailable"
        gap = (row.ask / row.pre_close_price - 1) * 100
        if gap < r["low"]:
            return "gap_below_range"
        if gap > r["high"]:
            return "gap_above_range"
        return "near_limit_up_queue" if row.ask >= row.limit_up * r["near"] else "entry_confirmation_matched"

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            _, _, ends, reason, done = self.state.get()
            if not done:
                out.append((key[0], "expired", reason, ends, None))
        self.state.clear()
        self.seen.clear()
        yield pd.DataFrame(out, columns=[x.split()[0] for x in ENTRIES.split(", ")])

    def close(self) -> None:
        pass


def entries(candidates: DataFrame, quotes: DataFrame, depth: DataFrame, age: int = 20, delay: str = "20 seconds", snapshots: int = 3, bars: int = 5, low: float = -2.0, high: float = 4.0, near: float = 0.9998) -> DataFrame:
    """What becomes of each candidate (stock_code, entry_mode, starts, ends): one row of ENTRIES when it triggers, is rejected, or expires.

    quotes (stock_code, quote_time, pre_close_price, limit_up) meet depths (stock_code, depth_time, asks) of at most `age` seconds before, as an interval join of two streams, each
    with a watermark of `delay`; a quote without such a depth decides nothing. In mode auction so many depth snapshots, in mode intraday quotes of so many minutes must have come
    within the window. A candidate still waiting when the watermark is past its window expires with the last reason; one that
    no quote met expires with `no_quote`.
    """
    stateful(quotes.sparkSession)
    best = F.try_element_at(F.filter("asks", lambda x: (x["price"] > 0) & (x["volume"] > 0)), F.lit(1))["price"]
    q = quotes.select("stock_code", "quote_time", "pre_close_price", "limit_up").withWatermark("quote_time", delay)
    d = depth.select(F.col("stock_code").alias("code"), "depth_time", best.alias("ask")).withWatermark("depth_time", delay)
    near_ = (F.col("stock_code") == F.col("code")) & (F.col("depth_time") <= F.col("quote_time")) & (F.col("depth_time") >= F.col("quote_time") - F.expr(f"interval {age} seconds"))
    plain = F.timestamp_micros(F.unix_micros("depth_time"))  # one event time is allowed after the join: that of the quote
    met = q.join(d, near_).select("stock_code", "quote_time", plain.alias("depth_time"), "pre_close_price", "limit_up", "ask")
    rules = {"snapshots": snapshots, "bars": bars, "low": low, "high": high, "near": near}
    return met.groupBy("stock_code").transformWithStateInPandas(Entries(rules), ENTRIES, "Append", "EventTime", initialState=candidates.select("stock_code", "entry_mode", "starts", "ends").groupBy("stock_code"))


# ---- X20: late data


def watched(quotes: DataFrame, name: str, seconds: int, arrival: str = "arrival_time", time: str = "quote_time") -> DataFrame:
    """Fresh rows: those that came within so many seconds of their time. Rows seen and stale are counted as metrics `name`, for `Lateness`."""
    old = F.unix_timestamp(arrival) - F.unix_timestamp(time) > seconds
    return quotes.observe(name, F.count("*").alias("seen"), F.count_if(old).alias("stale")).filter(~old)


class Lateness(StreamingQueryListener):
    """By query name: rows seen and stale (of `watched`), and rows that Spark dropped as later than the watermark."""

    def __init__(self) -> None:
        self.counts: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        own = self.counts.setdefault(p.name or str(p.id), {"seen": 0, "stale": 0, "dropped": 0})
        own["dropped"] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        for metrics in p.observedMetrics.values():
            for name in ("seen", "stale"):
                own[name] += getattr(metrics, name, 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
