"""State by key: which row of a stream came first, until it is forgotten.

A key's first row is kept in a state store (RocksDB, whose files go to the checkpoint), with
those of the other keys of its bucket; a timer at its event time plus ``keep`` drops it when
the watermark has passed.  So the state holds the keys of that period only, a batch reads its
own rows and no earlier ones, and a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.streaming.streams import run_available

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Groups of keys, each of which is one call and one row of state.  A query keeps the number it began with.
BUCKETS = 8192
HELD = "keys array<string>, ids array<long>, at_ms array<long>"
MARKED = "id long, key string, at_ms long, duplicate_of long"


def chain(ids: np.ndarray, at: np.ndarray, first: tuple[int, int] | None, keep_ms: int, of: np.ndarray, fresh: np.ndarray) -> tuple[int, int]:
    """Writes the first row of each of a key's rows (in the order of their times) to ``of``, or true to ``fresh``; the key's first row from then on."""
    start = 0
    while start < len(ids):
        if first is None:
            first, fresh[start] = (int(ids[start]), int(at[start])), True
            start += 1
        end = max(start, int(np.searchsorted(at, first[1] + keep_ms, side="right")))
        of[start:end] = first[0]
        start = end
        if start < len(ids):
            first, fresh[start] = (int(ids[start]), int(at[start])), True
            start += 1
    return first


def first_of_key(keep_ms: int) -> Callable:
    """Marks rows (id, key, at_ms) of a bucket of keys with the first row of their key that is at most ``keep_ms`` older.

    Rows of a batch are taken in the order of their times, then ids; a batch is as large as
    its source's limit lets it be.  A call and a state for each key would cost more than the
    work; a bucket's are its keys' first rows, those of which no more rows can be marked left out."""

    def mark(bucket: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: (i, at) for k, i, at in zip(*state.get, strict=True)} if state.exists else {}
        if not state.hasTimedOut:
            batch = pd.concat([part[["id", "key", "at_ms"]] for part in rows])
            codes, names = pd.factorize(batch["key"])
            order = np.lexsort((batch["id"], batch["at_ms"], codes))
            batch, codes = batch.iloc[order], codes[order]
            ids, at = batch["id"].to_numpy(), batch["at_ms"].to_numpy()
            of, fresh = np.zeros(len(ids), "int64"), np.zeros(len(ids), bool)
            ends = np.searchsorted(codes, np.arange(len(names)), side="right").tolist()
            for name, start, end in zip(names.tolist(), [0, *ends], ends):
                own = slice(start, end)
                held[name] = chain(ids[own], at[own], held.get(name), keep_ms, of[own], fresh[own])
        passed = state.getCurrentWatermarkMs()
        held = {k: first for k, first in held.items() if first[1] + keep_ms >= passed}
        if held:
            state.update((list(held), [i for i, _ in held.values()], [at for _, at in held.values()]))
            state.setTimeoutTimestamp(max(min(at for _, at in held.values()) + keep_ms, passed) + 1)
        elif state.exists:
            state.remove()
        if not state.hasTimedOut:
            yield pd.DataFrame({"id": ids, "key": batch["key"].to_numpy(), "at_ms": at, "duplicate_of": pd.arrays.IntegerArray(of, fresh)})

    return mark


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which may outgrow memory."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def mark_duplicates(rows: DataFrame, item: str, key: str, at: str, keep: int, late: str = "1 day") -> DataFrame:
    """MARKED: each row of a stream with the id of the first one of its key, null for that first one; after ``keep`` seconds a key is new again.

    Rows without a key are never duplicates of each other, so they stay out of the state.
    Rows that are more than ``late`` behind are dropped, as the watermark has it."""
    named = rows.withWatermark(at, late).select(F.col(item).cast("long").alias("id"), F.col(key).cast("string").alias("key"), F.unix_millis(at).alias("at_ms"), at)
    named = named.filter("key IS NOT NULL").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    return named.groupBy("bucket").applyInPandasWithState(first_of_key(keep * 1000), MARKED, HELD, "append", GroupStateTimeout.EventTimeTimeout)


def marked(rows: DataFrame, item: str, key: str, at: str, keep: int, folder: str, late: str = "1 day") -> DataFrame:
    """What ``mark_duplicates`` gives for all rows there are, written batch by batch and read back; calling it again goes on with new rows."""
    spark = rows.sparkSession
    with rocksdb(spark):
        run_available(mark_duplicates(rows, item, key, at, keep, late), lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), f"{folder}/state")
    return spark.read.schema(MARKED).parquet(f"{folder}/out").select("id", "key", "duplicate_of")
