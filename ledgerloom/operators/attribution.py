"""Attribution of conversions to channels: last and first touch, linear, time decay, position; all together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.semantics import micros, need, num, pct, with_total

_DAY = 86_400_000_000
MODELS = ("Last Touch", "First Touch", "Linear", "Time Decay", "Position Based")


def _touches(df: DataFrame, customer: str, channel: str, conversion: str, date: str, tie: str | None) -> DataFrame:
    need(df, customer, channel, conversion, date, tie)
    t = F.col(tie) if tie else F.xxhash64(*df.columns)
    rows = df.select(F.col(customer).alias("c"), F.col(channel).alias("channel"), F.coalesce(num(conversion), F.lit(0.0)).alias("v"), micros(date).alias("t"), t.alias("tie"))
    return rows.dropna(subset=["c", "t"])


def _shares(credit: DataFrame) -> DataFrame:
    """(channel, credit) rows to channel, attributed_conversions, attribution_percentage. Null channels drop out."""
    got = credit.where("channel is not null").groupBy("channel").agg(F.sum("credit").alias("attributed_conversions"))
    return with_total(got, all__=F.sum("attributed_conversions")).withColumn("attribution_percentage", pct(F.col("attributed_conversions"), F.col("all__"))).drop("all__")


def _end_touch(t: DataFrame, last: bool, journey: bool) -> DataFrame:
    pick = F.max_by if last else F.min_by
    at = F.struct("t", "tie")
    seen = F.col("channel") if journey else F.when(F.col("v") > 0, F.col("channel"))
    key = at if journey else F.when(F.col("v") > 0, at)
    got = t.groupBy("c").agg(F.sum(F.when(F.col("v") > 0, F.col("v"))).alias("credit"), pick(seen, key).alias("channel"))
    return got.where("credit is not null").select("channel", "credit")


def last_touch(df: DataFrame, customer: str, channel: str, conversion: str, date: str, tie: str | None = None, journey: bool = False) -> DataFrame:
    """A customer's whole conversion value goes to the channel of the last converting row; with ``journey``, of
    the last row of all. Equal times are ordered by ``tie``."""
    return _shares(_end_touch(_touches(df, customer, channel, conversion, date, tie), True, journey))


def first_touch(df: DataFrame, customer: str, channel: str, conversion: str, date: str, tie: str | None = None, journey: bool = False) -> DataFrame:
    return _shares(_end_touch(_touches(df, customer, channel, conversion, date, tie), False, journey))


def _linear(t: DataFrame, lookback_days: int) -> DataFrame:
    w = Window.partitionBy("c").orderBy("t")
    span = lookback_days * _DAY
    t = t.withColumn("n", F.count("*").over(w.rangeBetween(-span, 0)))
    share = F.when(F.col("v") > 0, F.col("v") / F.col("n"))
    return t.withColumn("credit", F.sum(share).over(w.rangeBetween(0, span))).where("credit is not null").select("channel", "credit")


def linear(df: DataFrame, customer: str, channel: str, conversion: str, date: str, lookback_days: int = 30, tie: str | None = None) -> DataFrame:
    """Each conversion's value is shared alike by the customer's rows up to ``lookback_days`` before it, itself included.
    Two range windows, no join: a conversion counts its touches, a touch sums the shares of the conversions ahead."""
    return _shares(_linear(_touches(df, customer, channel, conversion, date, tie), lookback_days))


def _decayed(rows: pd.DataFrame, ready: np.ndarray, lookback_days: int, half_life_days: float, size: int) -> pd.DataFrame:
    """(channel, credit) of the conversions that are ``ready``; rows in order of customer, block and time, with all touches of theirs.

    The touches that are j whole days before a conversion follow one another, so their number is the difference of two places
    in the order, and credit goes to them as a step up at the one and down at the other."""
    c, b, t = rows["c"].to_numpy(), rows["b"].to_numpy(), rows["t"].to_numpy()
    group = np.cumsum(np.append(0, (c[1:] != c[:-1]) | (b[1:] != b[:-1])))
    at = group * (4 * size) + (t - b * size + size)  # a line of time for all customers; a block's touches lie in [0, 2 size)
    conv = at[ready]
    bounds = [np.searchsorted(at, conv, "right")]
    bounds += [np.searchsorted(at, conv - j * _DAY, "right") for j in range(1, lookback_days + 1)]
    bounds.append(np.searchsorted(at, conv - lookback_days * _DAY, "left"))
    weights = 2.0 ** (-np.arange(lookback_days + 1) / half_life_days)
    total = sum(w * (high - low) for w, high, low in zip(weights, bounds, bounds[1:], strict=False))
    unit = rows["v"].to_numpy()[ready] / total
    step = np.zeros(len(rows) + 1)
    for w, high, low in zip(weights, bounds, bounds[1:], strict=False):
        np.add.at(step, low, unit * w)
        np.add.at(step, high, -unit * w)
    code, channels = pd.factorize(rows["channel"], use_na_sentinel=False)
    return pd.DataFrame({"channel": channels, "credit": np.bincount(code, np.cumsum(step[:-1]), len(channels))})


def _decay(t: DataFrame, lookback_days: int, half_life_days: float) -> DataFrame:
    """(channel, credit) in parts. No touch meets a conversion in a join: rows go to their customer's block of time and, as what lies
    before, to the next one; there they pass once in order of time, of which the last ``lookback_days`` are at hand."""
    span, size = lookback_days * _DAY, max(lookback_days, 1) * _DAY
    block = F.floor(F.col("t") / F.lit(size)).cast("long")
    copies = F.explode(F.array(F.struct(block.alias("b"), F.col("v")), F.struct((block + 1).alias("b"), F.lit(0.0).alias("v")))).alias("x")
    dealt = t.select("c", "channel", "t", copies).select("c", "channel", "t", "x.b", "x.v").repartition("c", "b").sortWithinPartitions("c", "b", "t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            last = rows.iloc[-1]
            same = ((rows["c"] == last["c"]) & (rows["b"] == last["b"])).to_numpy()
            times = rows["t"].to_numpy()
            wait = same & (times == last["t"])  # the next batch may have more touches of this time
            yield _decayed(rows, (rows["v"] > 0).to_numpy() & ~wait, lookback_days, half_life_days, size)
            held = rows.assign(v=rows["v"].where(wait, 0.0))[same & (times >= last["t"] - span)]
        if held is not None:
            yield _decayed(held, (held["v"] > 0).to_numpy(), lookback_days, half_life_days, size)

    kind = t.schema["channel"].dataType.simpleString()
    return dealt.mapInPandas(run, f"channel {kind}, credit double").where("credit <> 0")


def time_decay(df: DataFrame, customer: str, channel: str, conversion: str, date: str, lookback_days: int = 30, half_life_days: float = 7, tie: str | None = None) -> DataFrame:
    """As linear, with weights that halve every ``half_life_days`` before the conversion, by whole days."""
    return _shares(_decay(_touches(df, customer, channel, conversion, date, tie), lookback_days, half_life_days))


def _position(t: DataFrame, lookback_days: int, first: float, last: float, renormalize: bool) -> DataFrame:
    if first + last > 1:
        raise ValueError("first and last weights are over 1 together")
    w, span = Window.partitionBy("c").orderBy("t"), lookback_days * _DAY
    back, touch = w.rangeBetween(-span, 0), F.struct("t", "tie", "channel")
    t = t.withColumns({"n": F.count("*").over(back), "first": F.min(touch).over(back), "last": F.max(touch).over(back)})
    t = t.withColumn("m", F.when((F.col("v") > 0) & (F.col("n") > 2), (1 - first - last) / (F.col("n") - 2) * F.col("v")).otherwise(0.0))
    two = first + last if renormalize and first + last > 0 else 1.0

    def end(touch: str, weight: float) -> Column:
        # what an end gets beyond the share of the middle that the sum below gives to all touches
        own = F.when(F.col("n") == 1, 1.0 if touch == "last" else 0.0).when(F.col("n") == 2, weight / two).otherwise(weight)
        return F.struct(F.col(f"{touch}.channel").alias("channel"), F.when(F.col("v") > 0, own * F.col("v") - F.col("m")).alias("credit"))

    t = t.withColumn("share", F.sum("m").over(w.rangeBetween(0, span)))
    middle = F.struct("channel", F.col("share").alias("credit"))
    return t.select(F.explode(F.array(middle, end("first", first), end("last", last))).alias("x")).select("x.*").where("credit <> 0")


def position_based(df: DataFrame, customer: str, channel: str, conversion: str, date: str, lookback_days: int = 30, first_weight: float = 0.4, last_weight: float = 0.4, tie: str | None = None, renormalize: bool = False) -> DataFrame:
    """First and last touch get their weights, those between share the rest. Of exactly two touches the rest is
    lost, unless ``renormalize``. Range windows as in linear, no join."""
    return _shares(_position(_touches(df, customer, channel, conversion, date, tie), lookback_days, first_weight, last_weight, renormalize))


def compare_models(df: DataFrame, customer: str, channel: str, conversion: str, date: str, lookback_days: int = 30, tie: str | None = None) -> DataFrame:
    """channel and a column of attributed conversions for each of MODELS; 0 where a model gives none."""
    t = _touches(df, customer, channel, conversion, date, tie)
    parts = [_end_touch(t, True, False), _end_touch(t, False, False), _linear(t, lookback_days), _decay(t, lookback_days, 7), _position(t, lookback_days, 0.4, 0.4, False)]
    all_ = None
    for name, p in zip(MODELS, parts, strict=True):
        p = p.withColumn("model", F.lit(name))
        all_ = p if all_ is None else all_.unionByName(p)
    return all_.where("channel is not null").groupBy("channel").pivot("model", list(MODELS)).agg(F.sum("credit")).fillna(0.0)


def most_disputed(comparison: DataFrame) -> DataFrame:
    """The channel whose credit varies most between models: channel, variance, lowest, highest."""
    long = comparison.unpivot(["channel"], list(MODELS), "model", "credit")
    got = long.groupBy("channel").agg(F.var_samp("credit").alias("variance"), F.min("credit").alias("lowest"), F.max("credit").alias("highest"))
    return got.orderBy(F.desc("variance"), "channel").limit(1)
