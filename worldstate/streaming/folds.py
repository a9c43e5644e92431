"""The folds of ``operators.folds`` on streams: same step functions, state kept per key."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from worldstate.operators.folds import Step
from worldstate.session import ROCKSDB_PROVIDER


BUCKETS = 1024
KEY, BUCKET = "fold_key", "fold_bucket"  # names that begin with an underscore are lost on the way to Python


class FoldProcessor(StatefulProcessor):
    """Keeps one JSON value per key; the rows of a micro-batch are applied in order.

    It is called once per bucket of keys, since a call costs far more than the rows of a small key; only keys that have
    rows are looked up. The rows of one bucket in one micro-batch are sorted in memory; the source's limit per trigger
    (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``) bounds them.
    """

    def __init__(self, step: Step, order: Sequence[str], columns: Sequence[str]):
        self._step = step
        self._order = list(order)
        self._columns = list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._states = handle.getMapState("states", "key string", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = [pdf for pdf in rows if not pdf.empty]
        if not chunks:
            return
        pdf = pd.concat(chunks, ignore_index=True)
        codes, names = pd.factorize(pdf[KEY])
        pdf = pdf.assign(**{KEY: codes}).sort_values([KEY, *self._order], kind="stable", ignore_index=True)
        borders = np.searchsorted(pdf[KEY].to_numpy(), np.arange(len(names) + 1))
        added: dict[str, list] = {}
        for name, start, end in zip(names, borders[:-1], borders[1:]):
            held = self._states.getValue((name,))
            state, out = self._step(None if held is None else json.loads(held[0]), pdf.iloc[start:end])
            self._states.updateValue((name,), (json.dumps(state),))
            for column, values in out.items():
                added.setdefault(column, []).append(values)
        yield pdf.assign(**{column: np.concatenate(parts) for column, parts in added.items()})[self._columns]

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state of this kind needs the RocksDB state store."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB_PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


def stream_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, output: str, buckets: int = BUCKETS) -> DataFrame:
    """Streaming twin of ``chained_fold``: ``step`` along each key, state carried over batches.

    Keys are dealt to ``buckets`` by their hash; the number must stay the same for a checkpoint.
    Needs the RocksDB state store (``ROCKSDB_PROVIDER``).
    """
    use_rocksdb(df.sparkSession)
    added = [c.strip().split()[0] for c in output.split(",")]
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", " + output
    processor = FoldProcessor(step, order, [*df.columns, *added])
    named = df.withColumn(KEY, F.to_json(F.struct(*keys)))
    dealt = named.withColumn(BUCKET, F.pmod(F.xxhash64(KEY), F.lit(buckets)))
    return dealt.groupBy(BUCKET).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None"
    )
