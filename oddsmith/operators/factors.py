"""Trailing factors, market states and forward returns per ticker and date."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith.config import Config
from oddsmith.functions.columns import label_state
from oddsmith.operators import windows as w


@dataclass(frozen=True)
class Factor:
    """A flag over the columns that `measured` makes, its two labels, and those columns."""

    flag: Callable[[], Column]
    yes: str
    no: str
    needs: tuple[str, ...]


REGISTRY = {
    "stock_momentum": Factor(lambda: F.col("momentum") > 0, "Up", "Down", ("momentum",)),
    "sector_momentum": Factor(lambda: F.col("sector_change") > 0, "Up", "Down", ("sector_change",)),
    "vol_regime": Factor(lambda: F.col("rv") > F.col("rv_median"), "HighVol", "LowVol", ("rv", "rv_median")),
    "vix_regime": Factor(lambda: F.col("vix") > F.col("vix_median"), "HighVIX", "LowVIX", ("vix", "vix_median")),
    "rate_trend": Factor(lambda: F.col("rate_change") > 0, "RatesUp", "RatesDown", ("rate_change",)),
    "volume_regime": Factor(lambda: F.col("mean_volume") > F.col("volume_median"), "HiVolume", "LoVolume", ("mean_volume", "volume_median")),
}
SERIES = ("sector_close", "vix", "tnx")
MEDIANS = {"rv_median": "rv", "vix_median": "vix", "volume_median": "mean_volume"}


def states(cfg: Config) -> list[str]:
    """All states, ordered."""
    return ["/".join(labels) for labels in itertools.product(*[(REGISTRY[f].yes, REGISTRY[f].no) for f in cfg.factors])]


def joined(prices: DataFrame, market: DataFrame) -> DataFrame:
    """Prices with the market series of their date, filled forward along the ticker's own dates.

    Rows without close, sector_close or vix go; tnx may stay null. `market` is brought to one row
    per calendar day first (the largest value of a series, if a day has several), so its size is
    bounded by the calendar and it is broadcast.
    """
    daily = market.groupBy("date").agg(*[F.max(c).alias(c) for c in SERIES])
    rows = prices.join(F.broadcast(daily), "date", "left")
    rows = rows.withColumns({c: w.filled(c) for c in SERIES})
    return rows.dropna(subset=["close", "sector_close", "vix"])


def measured(rows: DataFrame, cfg: Config, columns: Sequence[str] | None = None, keys: tuple[str, ...] = w.TICKER) -> DataFrame:
    """The numbers that the factors compare. All windows share the partitioning by `keys`.

    Only `columns` (default: all) are made and go through the medians' pass along the rows. Rows
    in slices bring `n_rows`, the number of their ticker's rows, along; it is counted here otherwise.
    """
    back, ahead, order = cfg.momentum_lookback, cfg.horizon, w.along(keys)
    rows = rows.withColumn("log_return", w.log_return("close", keys))
    rows = rows.withColumns(
        {
            "momentum": w.change("close", back, keys),
            "sector_change": w.change("sector_close", back, keys),
            "rate_change": F.col("tnx") - F.lag("tnx", back).over(order),
            "rv": w.rolling_std("log_return", cfg.vol_window, keys),
            "mean_volume": w.rolling_mean("volume", cfg.vol_window, keys),
            "raw_ret": F.lead("close", ahead).over(order) / F.col("close") - 1,
            "sector_ret": F.lead("sector_close", ahead).over(order) / F.col("sector_close") - 1,
            "exit_date": F.lead("date", ahead).over(order),
            **({} if "n_rows" in rows.columns else {"n_rows": F.count(F.lit(1)).over(w.Window.partitionBy("ticker"))}),
        }
    )
    medians = {m: c for m, c in MEDIANS.items() if columns is None or m in columns}
    if columns is not None:
        kept = {"ticker", "date", "n_rows", *keys, *columns, *medians.values()} - set(medians)
        rows = rows.select(*[c for c in rows.columns if c in kept])
    return w.with_medians(rows, medians, cfg.regime_window, keys) if medians else rows


def features(prices: DataFrame, market: DataFrame, cfg: Config, min_extra: int = 50, flags_of: Sequence[str] | None = None) -> DataFrame:
    """ticker, date, close, volume, one flag for each of `flags_of` (default: the active factors), state, fwd_ret, exit_date.

    The state is null until both the momentum and the volatility median exist, whatever the
    active factors are. fwd_ret is null on a ticker's last rows. With `relative`, the sector's
    return over the same rows is taken off. Tickers with fewer than regime_window + horizon +
    `min_extra` rows are left out.
    """
    named = [f for f in REGISTRY if f in cfg.factors or f in (flags_of or ())]
    return flagged(measured(joined(prices, market), cfg, needed(cfg, named)), cfg, min_extra, named)


def needed(cfg: Config, named: Sequence[str]) -> list[str]:
    """Columns of `measured` that `flagged` reads."""
    return sorted({"close", "volume", "momentum", "rv_median", "raw_ret", "exit_date", *(("sector_ret",) if cfg.relative else ()), *(c for f in named for c in REGISTRY[f].needs)})


def flagged(rows: DataFrame, cfg: Config, min_extra: int, named: Sequence[str]) -> DataFrame:
    """The rows of `features` from `measured` ones."""
    rows = rows.filter(F.col("n_rows") >= cfg.regime_window + cfg.horizon + min_extra)
    flags = {f: F.coalesce(REGISTRY[f].flag(), F.lit(False)) for f in named}
    warm = F.col("momentum").isNotNull() & F.col("rv_median").isNotNull()
    labels = label_state([(flags[f], REGISTRY[f].yes, REGISTRY[f].no) for f in cfg.factors])
    ret = F.col("raw_ret") - F.col("sector_ret") if cfg.relative else F.col("raw_ret")
    return rows.select(
        "ticker", "date", "close", "volume", *[c.alias(n) for n, c in flags.items()], F.when(warm, labels).alias("state"), ret.alias("fwd_ret"), "exit_date"
    )
