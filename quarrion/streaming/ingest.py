"""Streams: ingest, de-duplication, last-writer-wins, event windows and append logs with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A bounded number of files a trigger holds the source back."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Runs what is there through sink(batch, number) and stops. The batch number makes rewrites of a batch idempotent."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own: all of it or nothing, and once."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def fault_tolerant(path: str, domain: str, check) -> Callable[[DataFrame, int], None]:
    """Rows of domains in which each row passes the check are written, those of the others go to `rejected`."""

    def sink(batch: DataFrame, number: int) -> None:
        bad = batch.where(~F.coalesce(check, F.lit(False))).select(domain).distinct()
        batch.join(bad, domain, "left_anti").write.mode("overwrite").parquet(f"{path}/accepted/batch={number}")
        batch.join(bad, domain, "left_semi").write.mode("overwrite").parquet(f"{path}/rejected/batch={number}")

    return sink


def deduplicated(stream: DataFrame, id_col: str, time_col: str, horizon: str = "1 hour") -> DataFrame:
    """First arrival of each id within the horizon; state older than that is dropped."""
    return stream.withWatermark(time_col, horizon).dropDuplicatesWithinWatermark([id_col])


def last_writer_wins(changes: DataFrame, region: str, key: str = "doc_id", clock: str = "clock", origin: str = "origin") -> DataFrame:
    """State after changes from other regions: own echoes and clocks not above the last one seen are dropped."""
    foreign = changes.where(F.col(origin) != region)
    others = [c for c in changes.columns if c != key]
    return foreign.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(clock, origin)).alias("_r")).select(key, "_r.*")


def event_windows(events: DataFrame, time_col: str, by: list[str], length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, end, by..., n, total): tumbling or sliding windows; as a stream, closed once `late` has passed."""
    rows = events.withWatermark(time_col, late) if events.isStreaming else events
    w = F.window(time_col, length, slide) if slide else F.window(time_col, length)
    sums = rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, time_col: str, by: str, gap: str, late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark(time_col, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(time_col, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def progress(query) -> dict:
    """Rows, batches and average batch size of a query."""
    seen = [p for p in query.recentProgress if p["numInputRows"]]
    rows = sum(p["numInputRows"] for p in seen)
    return {"rows": rows, "batches": len(seen), "average": rows / len(seen) if seen else 0.0}


def read_log(entries: DataFrame, stream: str, start: int, count: int) -> DataFrame:
    """Entries of an append log from a place on: (stream, id, ...) in order of id."""
    return entries.where(F.col("stream") == stream).orderBy("id").offset(start).limit(count)
