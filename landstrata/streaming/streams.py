"""Incremental versions of the accumulators on Structured Streaming."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.timeseries import BASE_YEAR, FAST_CODES
from ..session import scratch_path

BUCKETS = 2048  # of pixels that share one state
SPAN = 1 << 33  # more than two years can lie apart


def read_table_stream(spark: SparkSession, folder: str, file_glob: str, max_files: int | None = None) -> DataFrame:
    """File stream over the files of a folder that match a glob; the schema comes from the files."""
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def stream_change_state(records: DataFrame, key: str, year: str, change: str, fast_codes: list[int] = FAST_CODES, base: int = BASE_YEAR,
                        buckets: int = BUCKETS) -> DataFrame:
    """Yearly change records to (key, year, last_fast_year, cum_events, ysfc, censored, late).

    The state of a pixel is (last fast year, events, last seen year): three numbers.  Records of a batch are
    applied in year order, the first of a year counts.  A record that is not newer than the state's year changes
    nothing and comes out with ``late`` true and no state, so a caller can count or replay such rows.

    Pixels are dealt to ``buckets`` by a hash, and a bucket keeps one table of its pixels' states: a call of the fold serves
    all pixels of a bucket at once.  The number must stay the same for the life of a stream's checkpoint.
    """
    ktype = records.schema[key].dataType.simpleString()
    fast = list(fast_codes)

    def fold(k: tuple, batches, state: GroupState):
        pdf = pd.concat(list(batches), ignore_index=True)
        old = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else None
        names = pdf[key] if old is None else pd.concat([old["key"], pdf[key]], ignore_index=True)
        code, names = pd.factorize(names, use_na_sentinel=False)
        known = 0 if old is None else len(old)  # a state's pixels come first, so theirs are the first codes
        last, events, seen = (np.concatenate([old[c].to_numpy(np.int64) if known else [], np.full(len(names) - known, x)]).astype(np.int64)
                              for c, x in (("last", base), ("events", 0), ("seen", -1)))
        code = code[known:]
        order = np.lexsort((pdf[change], pdf[year], code))
        pdf, code = pdf.iloc[order], code[order]
        with np.errstate(invalid="ignore"):
            years = pdf[year].to_numpy(np.int64)
        first = np.append(True, code[1:] != code[:-1])
        late = (years <= seen[code]) | ~first & np.append(False, years[1:] == years[:-1])
        hit = pdf[change].isin(fast).to_numpy() & ~late
        # running maxima and sums of each pixel: pixels lie one after the other, SPAN apart
        lasts = np.maximum.accumulate(np.where(hit, np.maximum(years, last[code]), last[code]) + code * SPAN) - code * SPAN
        ran = np.cumsum(hit)
        counts = events[code] + ran - np.repeat((ran - hit)[first], np.diff(np.append(np.flatnonzero(first), len(code))))
        ends = np.append(first[1:], True)
        at = code[ends]
        last[at], events[at], seen[at] = lasts[ends], counts[ends], np.maximum(seen[at], years[ends])
        table, sink = pa.table({"key": pa.array(names, from_pandas=True), "last": last, "events": events, "seen": seen}), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
        gone = lambda x, kind: pd.Series(x).astype(kind).mask(late)
        yield pd.DataFrame({key: pdf[key].to_numpy(), year: years, "last_fast_year": gone(lasts, "Int64"), "cum_events": gone(counts, "Int64"),
                            "ysfc": gone(years - lasts, "Int64"), "censored": gone(lasts == base, "boolean"), "late": late})

    bucket = F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(buckets))).otherwise(-1)  # no null beside keys, which would turn into floats
    rows = records.select(key, F.col(year).cast("int").alias(year), F.col(change).cast("int").alias(change), bucket.alias("_bucket"))
    return rows.groupBy("_bucket").applyInPandasWithState(
        fold, f"`{key}` {ktype}, `{year}` int, last_fast_year int, cum_events int, ysfc int, censored boolean, late boolean",
        "pixels binary", "append", GroupStateTimeout.NoTimeout)


def stream_channel_moments(df: DataFrame, channels: list[str]) -> DataFrame:
    """n, mean, M2, min and max per channel; the state is one row per channel."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("value")) for c in channels]))
    long = df.select(pairs.alias("p")).select("p.*").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.groupBy("channel").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("*")).alias("m2"),
                                       F.min("value").alias("min"), F.max("value").alias("max"))


def stream_class_contingency(df: DataFrame, cluster: str, cls: str) -> DataFrame:
    """Running cluster x class counts."""
    return df.groupBy(F.col(cluster).alias("cluster"), F.col(cls).alias("cls")).agg(F.count("*").alias("n"))


def utc_clock(ts) -> Column:
    """A time without zone as the instant with the same clock in UTC, whatever the session's zone."""
    return F.from_utc_timestamp(F.col(ts).cast("timestamp"), F.current_timezone())


def wall_clock(ts) -> Column:
    """Inverse of ``utc_clock``."""
    return F.to_utc_timestamp(F.col(ts), F.current_timezone()).cast("timestamp_ntz")


def stream_windowed_metrics(df: DataFrame, key: str, ts: str, index: str, window: str, delay: str) -> DataFrame:
    """Metrics of an index per key and event-time window; rows later than ``delay`` behind the newest are dropped."""
    return df.withWatermark(ts, delay).groupBy(key, F.window(ts, window).alias("w")).agg(
        F.max(index).alias(f"{index}_max"), F.min(index).alias(f"{index}_min"), F.avg(index).alias(f"{index}_mean"), F.count(index).alias("n")
    ).select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), f"{index}_max", f"{index}_min", f"{index}_mean", "n")


def run_to_table(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Drain a stream into a table in the shared folder and return it.

    append writes files as they are produced; complete rewrites the (small) result table per batch.
    """
    spark = stream.sparkSession
    out, ckpt = scratch_path(spark, name), scratch_path(spark, f"{name}-progress")
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", out).start()
    else:
        q = w.foreachBatch(lambda batch, _id: batch.write.mode("overwrite").parquet(out)).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(out)
