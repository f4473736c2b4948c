"""Windows along the dates of one ticker. All share one partitioning and one order.

`keys` are what a window runs within: the ticker, or the ticker and a slice of its rows (see `slices`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

TICKER = ("ticker",)


def along(keys: tuple[str, ...] = TICKER, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(n: int, keys: tuple[str, ...] = TICKER) -> WindowSpec:
    return along(keys).rowsBetween(-(n - 1), 0)


def _full(value: Column, column: Column, n: int, keys: tuple[str, ...]) -> Column:
    """`value` only where the last n rows all have `column`."""
    return F.when(F.count(column).over(trailing(n, keys)) == n, value)


def change(column: str, n: int, keys: tuple[str, ...] = TICKER) -> Column:
    """Relative change over n rows."""
    return F.try_divide(F.col(column), F.lag(column, n).over(along(keys))) - 1


def log_return(column: str = "close", keys: tuple[str, ...] = TICKER) -> Column:
    return F.ln(column) - F.ln(F.lag(column, 1).over(along(keys)))


def rolling_std(column: str, n: int, keys: tuple[str, ...] = TICKER) -> Column:
    return _full(F.stddev_samp(column).over(trailing(n, keys)), F.col(column), n, keys)


def rolling_mean(column: str, n: int, keys: tuple[str, ...] = TICKER) -> Column:
    return _full(F.avg(column).over(trailing(n, keys)), F.col(column), n, keys)


def rolling_median(column: str, n: int, keys: tuple[str, ...] = TICKER) -> Column:
    """Exact, by Spark alone: each frame is aggregated anew. `with_medians` is the quicker way."""
    return _full(F.percentile(column, F.lit(0.5)).over(trailing(n, keys)), F.col(column), n, keys)


def filled(column: str, keys: tuple[str, ...] = TICKER) -> Column:
    """The last known value so far."""
    return F.last(column, ignorenulls=True).over(along(keys).rowsBetween(Window.unboundedPreceding, 0))


def newest(rows: DataFrame, n: int, key: str = "ticker", order: str = "date") -> DataFrame:
    """The last n rows of each key, with `nth` (1: the last).

    Spark puts a limit of n rows a key before the exchange as well (its window group limit, for n
    up to spark.sql.optimizer.windowGroupLimitThreshold, 1,000 by default), so each task sends at
    most n rows of a key; a test looks for it in the plan.
    """
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= n)


def with_medians(df: DataFrame, columns: dict[str, str], n: int, keys: tuple[str, ...] = TICKER, order: str = "date") -> DataFrame:
    """Adds rolling medians (new name: column), all in one pass along the rows of all keys.

    A sliding median needs an ordered structure that Spark's frames don't keep, so rows, in order
    within their key, stream through a task that remembers the n - 1 values before each batch:
    memory doesn't grow with a key's rows. Frames that aren't full give null. A row number that
    Spark makes along the same windows brings keys together, in order, and says where each begins.
    """
    schema = T.StructType([*df.schema.fields, *(T.StructField(name, T.DoubleType()) for name in columns)])
    names = df.columns
    numbered = df.withColumn("__nth", F.row_number().over(along(keys, order)))

    def medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tails = {c: np.zeros(0) for c in columns.values()}
        last = 0
        for batch in batches:
            nth = batch.column("__nth").to_numpy()
            starts = np.flatnonzero(nth == 1)
            if len(nth) and (np.diff(nth)[nth[1:] != 1] != 1).any() or len(nth) and nth[0] not in (1, last + 1):
                raise RuntimeError("rows of a key are not in order")
            last = int(nth[-1]) if len(nth) else last
            bounds = [0, *(b for b in starts.tolist() if b), len(nth)]
            found: dict[str, np.ndarray] = {}
            for column in tails:
                values, parts = batch.column(column).to_numpy(zero_copy_only=False).astype(float), []
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    if a < b:
                        tail = np.zeros(0) if nth[a] == 1 else tails[column]
                        whole = np.concatenate([tail, values[a:b]])
                        parts.append(pd.Series(whole).rolling(n).median().to_numpy()[len(tail) :])
                        tails[column] = whole[max(0, len(whole) - n + 1) :]
                found[column] = np.concatenate(parts) if parts else np.zeros(0)
            added = [pa.array(found[c], pa.float64(), from_pandas=True) for c in columns.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *added], [*names, *columns])

    return numbered.mapInArrow(medians, schema)
