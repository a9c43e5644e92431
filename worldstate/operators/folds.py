"""Folds whose next state depends on the previous one (chained thresholds, flush rules).

Rows are partitioned by (key, segment), sorted, and streamed through a small Python step
with constant memory; no group is ever collected. Keys that fit one task have one segment.
Hot keys have many, and the state entering a segment is not known in advance: every
segment first runs from a guess (a fresh start), then segments whose entering state turned
out different run again, until nothing changes. At that point all entering states are
consistent from the first segment on, so the result equals a sequential fold. Folds that
forget their past (a flush, a jump, an emptied list) settle soon; a state that is never
forgotten moves on by one segment per round.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worldstate.operators.ordered import PARTS, ROWS_PER_TASK, SEG, with_segments
from worldstate.session import cut_lineage

# step(state or None, rows in order) -> (new state, {output column: values})
Step = Callable[[object, pd.DataFrame], tuple[object, dict[str, np.ndarray]]]


def _runs(pdf: pd.DataFrame, group: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Consecutive rows of equal group columns."""
    columns = [pdf[c].to_numpy() for c in group]
    same = np.ones(len(pdf) - 1, dtype=bool)
    for values in columns:
        same &= values[1:] == values[:-1]
    borders = [0, *(np.flatnonzero(~same) + 1).tolist(), len(pdf)]
    for a, b in zip(borders[:-1], borders[1:]):
        yield tuple(values[a] for values in columns), pdf.iloc[a:b]


def _stream(step: Step, group: list[str], outputs: list[str], ends_only: bool):
    """Task body: carries the state over batch borders, resets it at group borders."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            done, added = [], {}
            for k, rows in _runs(pdf, group):
                if k != key:
                    if key is not None:
                        done.append((*key, json.dumps(state)))
                    entering = rows["_entering"].iloc[0]
                    key, state = k, (json.loads(entering) if isinstance(entering, str) else None)
                state, out = step(state, rows)
                if not ends_only:
                    for name, values in out.items():
                        added.setdefault(name, []).append(values)
            if not ends_only:
                yield pdf.assign(**{name: np.concatenate(parts) for name, parts in added.items()})[outputs]
            elif done:
                yield pd.DataFrame(done, columns=[*group, "_leaving"])
        if ends_only and key is not None:
            yield pd.DataFrame([(*key, json.dumps(state))], columns=[*group, "_leaving"])

    return run


def chained_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    step: Step,
    output: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Apply ``step`` along each key. ``output`` is the DDL of the columns it adds.

    ``df`` should hold only the columns the step or the caller needs: all pass through Python.
    Keys and order columns must not be null.
    """
    group = [*keys, SEG]
    rows = with_segments(df, keys, order, rows_per_task)
    split = rows is not None
    if not split:
        rows = df.withColumn(SEG, F.lit(0).cast("bigint"))
    types = dict(rows.dtypes)
    names = [*df.columns, *[c.strip().split()[0] for c in output.split(",")]]
    out_schema = ", ".join(f"`{c}` {types[c]}" for c in df.columns) + ", " + output
    end_schema = ", ".join(f"`{c}` {types[c]}" for c in group) + ", _leaving string"

    def arranged(part: DataFrame) -> DataFrame:
        return part.repartition(*group).sortWithinPartitions(*group, *order)

    def leaving(part: DataFrame, entering: DataFrame) -> DataFrame:
        part = part.join(F.broadcast(entering), group, "inner")
        return arranged(part).mapInPandas(_stream(step, group, names, True), end_schema)

    if not split:
        ready = rows.withColumn("_entering", F.lit(None).cast("string"))
    else:
        entering = _settled_states(rows.filter(F.col(PARTS) > 1).drop(PARTS), list(keys), leaving)
        ready = rows.drop(PARTS).join(F.broadcast(entering), group, "left")
    return arranged(ready).mapInPandas(_stream(step, group, names, False), out_schema)


def _settled_states(hot_rows: DataFrame, keys: list[str], leaving) -> DataFrame:
    """Entering state per (key, segment); one row per segment of ``rows_per_task`` rows."""
    group = [*keys, SEG]
    across = Window.partitionBy(*keys).orderBy(SEG)
    entering = cut_lineage(hot_rows.select(*group).distinct().withColumn("_entering", F.lit(None).cast("string")))
    states = cut_lineage(leaving(hot_rows, entering))
    while True:
        wanted = states.select(*group, F.lag("_leaving").over(across).alias("_wanted"))
        both = cut_lineage(entering.join(wanted, group))
        stale = both.filter(~F.col("_entering").eqNullSafe(F.col("_wanted"))).select(
            *group, F.col("_wanted").alias("_entering")
        )
        if stale.isEmpty():
            return entering
        entering = both.select(*group, F.col("_wanted").alias("_entering"))
        rerun = leaving(hot_rows, stale)
        kept = states.join(F.broadcast(stale.select(*group)), group, "left_anti")
        states = cut_lineage(kept.unionByName(rerun))
