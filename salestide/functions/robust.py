"""Robust scores against a trailing history: framed medians as window expressions, scores and their sums in one sorted pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

EXTREME = 999.0  # score of a departure from a constant history


def with_framed_medians(df: DataFrame, columns: dict[str, str], over: Window, first: int, last: int, least: int) -> DataFrame:
    """Add the exact medians ``{column: name}`` of the rows ``first`` to ``last`` from each row, null below ``least`` values.

    ``over`` is ordered and has no frame.  The few values of a frame are read by
    offset, and the frames of an Arrow batch are sorted together.  For frames of
    bounded length.
    """
    span = last - first + 1
    near = {
        f"_near_{i}_{k}": F.lag(c, -k).over(over) if k else F.col(c) for i, c in enumerate(columns) for k in range(first, last + 1)
    }

    @F.arrow_udf("struct<" + ",".join(f"m{i}:double" for i in range(len(columns))) + ">")
    def medians(*values: pa.Array) -> pa.Array:
        found = []
        for at in range(0, len(values), span):
            frame = values[at : at + span]
            # absent values sort last, as NaN
            ranked = np.sort(np.column_stack([v.to_numpy(zero_copy_only=False) for v in frame]), axis=1)
            n = sum(np.asarray(v.is_valid()).astype(int) for v in frame)
            pick = lambda place: np.take_along_axis(ranked, np.maximum(place, 0)[:, None], axis=1)[:, 0]  # noqa: E731, B023
            found.append(pa.array(pick((n - 1) // 2) * 0.5 + pick(np.minimum(n // 2, span - 1)) * 0.5, mask=(n < least) | (n == 0)))
        return pa.StructArray.from_arrays(found, names=[f"m{i}" for i in range(len(found))])

    rows = df.withColumns(near).withColumn("_medians", medians(*near))
    return rows.withColumns({name: F.col(f"_medians.m{i}") for i, name in enumerate(columns.values())}).drop(*near, "_medians")


def _in_runs(df: DataFrame, keys: list[str], order: str, values: list[str], added: list[str], compute: Callable[..., list[pa.Array]]) -> DataFrame:
    """Add the columns ``added``, computed from whole keys in order, in one sorted pass.

    ``compute(values, known, at)`` gets the rows of some keys: the values as
    doubles, where they are not null, and the place of each row in its key, from
    0 on.  A key's rows are held until its last one is read; they are the
    periods of one key.
    """
    inner = {c: f"_v_{c}" for c in values}
    rows = df.withColumns({v: F.col(c).cast("double") for c, v in inner.items()})
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).sortWithinPartitions(*keys, order)
    schema = StructType([*df.schema.fields, *[StructField(c, DoubleType()) for c in added]])
    own = df.columns

    def with_added(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        numbers = {c: table[v].to_numpy() for c, v in inner.items()}
        known = {c: table[v].is_valid().to_numpy() for c, v in inner.items()}
        new = compute(numbers, known, table["_at"].to_numpy() - 1)
        for c, found in zip(added, new):
            table = table.append_column(c, found)
        yield from table.select([*own, *added]).to_batches()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("_at").to_numpy() == 1)
            if len(starts):
                held.append(batch.slice(0, starts[-1]))
                yield from with_added(held)
                held = [batch.slice(starts[-1])]
            else:
                held.append(batch)
        if held:
            yield from with_added(held)

    return rows.mapInArrow(kernel, schema)


def _earlier(value: np.ndarray, known: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The value ``k`` rows before in the same key, NaN where there is none, and whether it is known."""
    before = np.maximum(np.arange(len(value)) - k, 0)
    there = (at >= k) & known[before]
    return np.where(there, value[before], np.nan), there


def _medians(value: np.ndarray, known: np.ndarray, at: np.ndarray, first: int, last: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact medians of the rows ``first`` to ``last`` before each row, and where at least ``least`` values are known."""
    frame = [_earlier(value, known, at, k) for k in range(last, first + 1)]
    # absent values sort last, as NaN
    ranked = np.sort(np.column_stack([v for v, _ in frame]), axis=1)
    n = sum(there.astype(int) for _, there in frame)
    pick = lambda place: np.take_along_axis(ranked, np.clip(place, 0, len(frame) - 1)[:, None], axis=1)[:, 0]
    return pick((n - 1) // 2) * 0.5 + pick(n // 2) * 0.5, (n >= least) & (n > 0)


def _scores(value: np.ndarray, known: np.ndarray, at: np.ndarray, window: int, least: int, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    """Robust scores of one value, and where they are known."""
    med, has_med = _medians(value, known, at, window, 1, least)
    last, has_last = _earlier(value, known, at, 1)
    mad, has_mad = _medians(np.abs(last - med), has_last & has_med, at, window - 1, 0, least)
    gap, has_gap = value - med, known & has_med
    # as in SQL, NaN is greater than any number
    spread = has_mad & ((mad > 0) | np.isnan(mad))
    sign = np.where(gap == 0, 0.0, np.where(gap < 0, -EXTREME, EXTREME))
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.where(spread, gap * 0.6745 / mad, sign)
    if strict:
        return z, has_gap & has_mad
    # the older convention scores every row that has no usable spread
    return np.where(spread | has_gap, z, -EXTREME), ~spread | has_gap


def _cusums(x: np.ndarray, at: np.ndarray, slack: float) -> list[np.ndarray]:
    """Two-sided sums of steps, reflected at 0, from 0 on the first row of each key.

    A sum reflected at 0 equals the plain running sum minus its running
    minimum; keys of equal length are summed together.
    """
    starts = np.flatnonzero(at == 0)
    lengths = np.diff(np.append(starts, len(x)))
    found = [np.empty(len(x)), np.empty(len(x))]
    for n in np.unique(lengths):
        rows = starts[lengths == n][:, None] + np.arange(n)
        for out, own in zip(found, (x[rows], -x[rows])):
            steps = own - slack
            steps[:, 0] = 0.0
            run = np.cumsum(steps, axis=1)
            out[rows] = run - np.minimum.accumulate(run, axis=1)
    return found


def with_robust_z(
    df: DataFrame, values: list[str], keys: list[str], order: str,
    window: int, min_history: int, strict: bool = True, prefix: str = "z_", cusum: str | None = None, slack: float = 0.5,
) -> DataFrame:
    """Add ``z_<value>``: 0.6745 × (value − median) / MAD over the previous rows of the key.

    The deviations are those of the lagged value from the current median.  A
    zero MAD gives 0 or ±999.  Without enough history the score is null;
    ``strict=False`` keeps the older convention of ±999 or 0 there, with -999
    when even the median is missing.  ``cusum`` names a value whose scores are
    summed as by ``with_cusum`` in the same pass.

    Rows are sorted by key and order once; all scores come from one pass over
    them.  What is known before the scores is best added before, because the
    rows come back without their partitioning.
    """
    def compute(numbers: dict[str, np.ndarray], known: dict[str, np.ndarray], at: np.ndarray) -> list[pa.Array]:
        scores = {c: _scores(numbers[c], known[c], at, window, min_history, strict) for c in values}
        sums = _cusums(np.where(scores[cusum][1], scores[cusum][0], 0.0), at, slack) if cusum else []
        return [*[pa.array(z, mask=~there) for z, there in scores.values()], *map(pa.array, sums)]

    return _in_runs(df, keys, order, values, [f"{prefix}{c}" for c in values] + (["cusum_pos", "cusum_neg"] if cusum else []), compute)


def with_cusum(df: DataFrame, z: str, keys: list[str], order: str, slack: float = 0.5) -> DataFrame:
    """Two-sided cumulative sums of a score that start at 0 on the first row of the key; a null score counts as 0."""
    def compute(numbers: dict[str, np.ndarray], known: dict[str, np.ndarray], at: np.ndarray) -> list[pa.Array]:
        return list(map(pa.array, _cusums(np.where(known[z], numbers[z], 0.0), at, slack)))

    return _in_runs(df, keys, order, [z], ["cusum_pos", "cusum_neg"], compute)
