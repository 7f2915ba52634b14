"""Collections on disk: inserts, snapshots with manifests, backups, journals with checksums, crawled sources."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def insert(new: DataFrame, path: str, key: str, existing: DataFrame | None = None) -> None:
    """Appends rows; an id that is there already is an error before anything is written."""
    if existing is not None and new.join(existing.select(key), key, "left_semi").limit(1).count():
        raise ValueError("an id exists already")
    new.write.mode("append").parquet(path)


def with_json_metadata(rows: DataFrame, json_col: str, fields: str) -> DataFrame:
    """The fields of a JSON column as typed columns; malformed JSON gives nulls. fields: a DDL schema."""
    return rows.select("*", F.from_json(json_col, fields).alias("_m")).select(*rows.columns, "_m.*")


def save_snapshot(tables: dict[str, DataFrame], path: str) -> dict:
    """Writes tables as Parquet with a manifest of row counts and order-free digests."""
    spark = next(iter(tables.values())).sparkSession
    manifest = {}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        manifest[name] = digest(spark.read.parquet(f"{path}/{name}"))
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], ["value"]).coalesce(1).write.text(f"{path}/manifest")
    return manifest


def digest(df: DataFrame) -> dict:
    """Row count, and a digest that doesn't depend on the order of rows, columns or files."""
    columns = sorted(df.columns)
    line = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    h = F.sha2(line, 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    row = df.agg(F.count("*").alias("n"), *parts).first()
    return {"rows": row["n"], "digest": "-".join(format(int(row[f"p{i}"] or 0), "x") for i in range(4))}


def open_snapshot(spark: SparkSession, path: str, verify: bool = True) -> dict[str, DataFrame]:
    """Tables of a snapshot; fails closed if one isn't what the manifest says."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    out = {name: spark.read.parquet(f"{path}/{name}") for name in manifest}
    if verify:
        for name, df in out.items():
            if digest(df) != manifest[name]:
                raise ValueError(f"{name} doesn't match its manifest")
    return out


def incremental_backup(log: DataFrame, path: str, after: int, upto: int, order: str = "lsn") -> None:
    log.where((F.col(order) > after) & (F.col(order) <= upto)).write.mode("errorifexists").parquet(f"{path}/upto={upto}")


def restore(spark: SparkSession, path: str, lsn: int, order: str = "lsn") -> DataFrame:
    """The log of a series of backups up to a point in time, to be folded."""
    return spark.read.parquet(path).where(F.col(order) <= lsn).drop("upto")


def journal_line(columns: list[str]) -> Column:
    """A JSON line with a checksum over its entry."""
    entry = F.to_json(F.struct(*columns))
    return F.to_json(F.struct(entry.alias("entry"), F.sha2(entry, 256).alias("sha256")))


def write_journal(rows: DataFrame, path: str) -> None:
    rows.select(journal_line(rows.columns).alias("value")).write.mode("append").text(path)


def read_journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries of a journal; reading a line whose checksum differs is an error."""
    rows = spark.read.schema("entry string, sha256 string").json(path)
    checked = F.when(F.sha2("entry", 256) == F.col("sha256"), F.col("entry")).otherwise(F.raise_error("the journal was tampered with"))
    return rows.select(F.from_json(checked, schema).alias("e")).select("e.*")


def write_frames(rows: DataFrame, path: str, order: str = "lsn", per_segment: int = 1_000_000) -> None:
    """Appends log entries as lines `crc32 number entry` to segments; numbers must follow each other without gaps."""
    entry = F.to_json(F.struct(*rows.columns))
    line = F.concat_ws("\t", F.col(order).cast("string"), entry)
    out = rows.select(F.floor(F.col(order) / per_segment).cast("long").alias("segment"), F.concat_ws("\t", F.crc32(line.cast("binary")).cast("string"), line).alias("value"))
    out.repartition("segment").write.mode("append").partitionBy("segment").text(path)


def replay_frames(spark: SparkSession, path: str, schema: str, truncated: int = 0) -> DataFrame:
    """Entries of a log, those up to `truncated` left out. One bad line at the end of the last segment is a torn write and is dropped;
    one anywhere else leaves a gap in the numbers or stands in an earlier segment, and is an error."""
    rows = spark.read.text(path).select("segment", F.split("value", "\t", 3).alias("p"))
    good = (F.size("p") == 3) & (F.try_element_at("p", F.lit(1)).try_cast("long").eqNullSafe(F.crc32(F.concat_ws("\t", F.try_element_at("p", F.lit(2)), F.try_element_at("p", F.lit(3))).cast("binary"))))
    read = rows.select("segment", F.coalesce(good, F.lit(False)).alias("good"), F.try_element_at("p", F.lit(2)).try_cast("long").alias("n"), F.try_element_at("p", F.lit(3)).alias("entry"))
    valid, bad = F.when(F.col("good"), F.col("n")), F.when(~F.col("good"), F.col("segment"))
    state = read.agg(F.count(valid).alias("n"), F.countDistinct(valid).alias("distinct"), F.min(valid).alias("first"), F.max(valid).alias("last"), F.count(bad).alias("bad"), F.min(bad).alias("bad_in"), F.max("segment").alias("newest")).first()
    if state["n"] and (state["distinct"] != state["n"] or state["last"] - state["first"] + 1 != state["n"]):
        raise ValueError("the log has a gap or repeats an entry")
    if state["bad"] > 1 or (state["bad"] and state["bad_in"] != state["newest"]):
        raise ValueError("the log is damaged before its end")
    return read.where(F.col("good") & (F.col("n") > truncated)).select(F.from_json("entry", schema).alias("e")).select("e.*")


#: Files larger than this are left alone by crawl().
MAX_BYTES = 8 << 20


def crawl(spark: SparkSession, path: str, glob: str = "*", most: int = MAX_BYTES) -> DataFrame:
    """(path, bytes, hash, content) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.where(F.col("length") <= most).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("hash"), F.decode("content", "UTF-8").alias("content"))


def byte_range(content: Column, offset: int, length: int) -> Column:
    """bytes[offset, offset + length), clipped; empty past the end."""
    return F.substring(content, offset + 1, length)
