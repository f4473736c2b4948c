"""One ticker's rows in several tasks: slices of bounded size with a halo of the rows around them.

A window of n rows needs n - 1 rows before a slice and as many behind it as it looks ahead. With
these rows copied into the slice, every window gives the same numbers as along the whole ticker,
and no task sorts or holds more than a slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oddsmith.config import Config
from oddsmith.operators import factors
from oddsmith.operators import windows as w

SPAN = 366  # days of a period: a stretch of dates that is numbered by one task


def in_periods(rows: DataFrame, days: int = SPAN) -> DataFrame:
    """Adds `period`, the number of a row's stretch of `days` calendar days."""
    return rows.withColumn("period", F.floor(F.unix_date("date") / days).cast("int"))


def filled_by_period(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`rows` (with ticker, period, date) with the columns filled forward along each ticker, period by period.

    What a period begins with is the last value of the periods before it: one small row a period.
    """
    ends = rows.groupBy("ticker", "period").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c) for c in columns])
    before = Window.partitionBy("ticker").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("ticker", "period", *[F.last(c, ignorenulls=True).over(before).alias(f"__{c}") for c in columns])
    keys = ("ticker", "period")
    out = rows.join(carried, [*keys])
    return out.withColumns({c: F.coalesce(w.filled(c, keys), F.col(f"__{c}")) for c in columns}).drop(*[f"__{c}" for c in columns])


def sliced(rows: DataFrame, before: int, after: int, size: int) -> DataFrame:
    """`rows` (with ticker, period, date) with `slice`, `halo` and `n_rows`: each row in its slice and in those whose halo it is.

    Row k of a ticker lies in slice k div size. A slice also gets the `before` rows ahead of it and
    the `after` rows behind it, marked `halo`. Rows are numbered within their period and by the
    sizes of the periods before, so no task sees a whole ticker. `n_rows` counts the ticker's rows.
    """
    if size < max(before, after, 1):
        raise ValueError("a slice must be as long as its halo")
    counts = rows.groupBy("ticker", "period").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("ticker").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("ticker", "period", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("__base"), F.sum("n").over(Window.partitionBy("ticker")).alias("n_rows"))
    out = rows.join(counts, ["ticker", "period"]).withColumn("__k", F.col("__base") + F.row_number().over(w.along(("ticker", "period"))) - 1)
    own = F.floor(F.col("__k") / size)
    at = F.col("__k") % size
    last = F.floor((F.col("n_rows") - 1) / size)
    here = F.struct(own.alias("slice"), F.lit(False).alias("halo"))
    next_ = F.when((at >= size - before) & (own < last), F.struct((own + 1).alias("slice"), F.lit(True).alias("halo")))
    previous = F.when((at < after) & (own > 0), F.struct((own - 1).alias("slice"), F.lit(True).alias("halo")))
    return out.select("*", F.inline(F.array_compact(F.array(here, next_, previous)))).drop("__k", "__base", "period")


def features(prices: DataFrame, market: DataFrame, cfg: Config, min_extra: int = 50, size: int = 16_384, days: int = SPAN) -> DataFrame:
    """The rows of `factors.features`, with every window run in slices of `size` rows.

    For tickers of very many rows, say bars of minutes: a ticker of a million rows goes to sixty
    tasks. It takes two more exchanges than `factors.features`, which stays the way for daily bars.
    """
    daily = market.groupBy("date").agg(*[F.max(c).alias(c) for c in factors.SERIES])
    rows = in_periods(prices.join(F.broadcast(daily), "date", "left"), days)  # a row a calendar day
    rows = filled_by_period(rows, factors.SERIES).dropna(subset=["close", "sector_close", "vix"])
    before = max(cfg.regime_window + cfg.vol_window, cfg.momentum_lookback)
    keys = ("ticker", "slice")
    named = [f for f in factors.REGISTRY if f in cfg.factors]
    cut = sliced(rows, before, cfg.horizon, max(size, before))
    found = factors.measured(cut, cfg, [*factors.needed(cfg, named), "halo"], keys)
    return factors.flagged(found.filter(~F.col("halo")), cfg, min_extra, named)
