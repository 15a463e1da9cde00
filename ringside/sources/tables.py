"""Scans with explicit schemas, sinks behind a gate, and reports on tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table; filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _store(spark: SparkSession, path: str):
    """(file system, path) in Hadoop's terms, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark can see a path, in whatever store it is."""
    store, at = _store(spark, path)
    return store.exists(at)


def _remove(spark: SparkSession, path: str) -> None:
    store, at = _store(spark, path)
    store.delete(at, True)


def _move(spark: SparkSession, path: str, to: str) -> None:
    """Rename; one step of the store, so that nobody sees half of it."""
    store, at = _store(spark, path)
    target = _store(spark, to)[1]
    store.mkdirs(target.getParent())
    if not store.rename(at, target):
        raise OSError(f"{path} can't be moved to {to}")


def must_exist(spark: SparkSession, *paths: str) -> None:
    """Raise unless Spark can see every path, in whatever store it is."""
    for p in paths:
        if not exists(spark, p):
            raise FileNotFoundError(p)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, corrupt: str | None = None) -> DataFrame:
    """Headered CSV files with `_ord`, the gapless number of a row from 0: along each file, and files by name.

    Columns are taken by name; others are left out, missing ones are null. Line breaks may stand in quotes,
    doubled quotes too. A value that isn't of its column's type is null. corrupt: a column for the whole line where
    a row has too many or too few values, or one of a wrong type; null for the others. Without it such a row is kept all the
    same.

    Numbers follow from counts of the rows of each split, a row of which the driver holds.
    """
    plain = spark.read.options(header=True, multiLine=True, escape='"', enforceSchema=False, columnPruning=False, mode="PERMISSIVE")
    have = plain.csv(path).columns
    bad = "_corrupt_line"
    text = T.StructType([T.StructField(c, T.StringType()) for c in have] + [T.StructField(bad, T.StringType())])
    rows = plain.option("columnNameOfCorruptRecord", bad).schema(text).csv(path)
    rows = rows.withColumns({"__file": F.col("_metadata.file_path"), "__split": F.col("_metadata.file_block_start"), "__at": F.monotonically_increasing_id()})
    starts, n = [], 0
    for r in rows.groupBy("__file", "__split").agg(F.count("*").alias("n"), F.min("__at").alias("first")).orderBy("__file", "__split").collect():
        starts.append((r["__file"], r["__split"], n - r["first"]))
        n += r["n"]
    before = F.broadcast(spark.createDataFrame(starts, "__file string, __split long, __shift long"))
    typed = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType) for f in schema}
    wrong = [F.col(f"`{c}`").isNotNull() & typed[c].isNull() for c in typed if c in have]
    line = F.coalesce(F.col(bad), F.when(reduce(Column.__or__, wrong, F.lit(False)), F.to_csv(F.struct(*[F.col(f"`{c}`") for c in have]))))
    cols = [v.alias(c) for c, v in typed.items()] + ([line.alias(corrupt)] if corrupt else [])
    return rows.join(before, ["__file", "__split"]).select(*cols, (F.col("__at") + F.col("__shift")).alias("_ord"))


def write(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    out = df.write.mode("overwrite")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)


def write_if_valid(spark: SparkSession, tables: dict[str, DataFrame], folder: str, checks: Callable[[dict[str, DataFrame]], DataFrame]) -> None:
    """Write all tables, or none: none if a write fails, or a check (check, violations) of their report has violations.

    They are written beside the folder first, and checked as they were written. A manifest with their names, which
    appears by one rename, is the commit; then each is moved to its place. Whoever stops before the
    manifest has changed nothing; what stops after it is ended by settle(), here at the next write.
    There is one writer at a time.
    """
    settle(spark, folder)
    staged = f"{folder.rstrip('/')}.next-{uuid.uuid4().hex}"
    try:
        for k, df in tables.items():
            write(df, f"{staged}/{k}.parquet")
        report = checks({k: spark.read.parquet(f"{staged}/{k}.parquet") for k in tables})
        failed = report.filter("violations > 0").limit(100).collect()
        if failed:  # a line for each check, some tens
            raise ValueError("; ".join(f"{r['check']}: {r['violations']}" for r in failed))
        spark.createDataFrame([(k,) for k in tables], "name string").coalesce(1).write.parquet(f"{staged}/_manifest.part")
        _move(spark, f"{staged}/_manifest.part", f"{staged}/_manifest")
    except BaseException:
        _remove(spark, staged)
        raise
    _apply(spark, staged, folder)


def _apply(spark: SparkSession, staged: str, folder: str) -> None:
    """Move what a manifest names to its place; done again, it goes on where it stopped."""
    for (k,) in spark.read.parquet(f"{staged}/_manifest").collect():
        new, place = f"{staged}/{k}.parquet", f"{folder}/{k}.parquet"
        if exists(spark, new):
            if exists(spark, place):
                _move(spark, place, f"{staged}/_old/{k}.parquet")
            _move(spark, new, place)
    _remove(spark, staged)


def settle(spark: SparkSession, folder: str) -> None:
    """End what a writer left of a folder: committed tables are moved to their places, others go."""
    store, pattern = _store(spark, f"{folder.rstrip('/')}.next-*")
    for found in store.globStatus(pattern) or []:
        staged = found.getPath().toString()
        if exists(spark, f"{staged}/_manifest"):
            _apply(spark, staged, folder)
        else:
            _remove(spark, staged)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this application, which the driver and all executors share.

    It is the one that spark.checkpoint.dir names. Where that is unset, one is made on this
    machine if the master is local; on a cluster the job fails, as no executor would see it.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(where or os.path.join(tempfile.gettempdir(), "ringside-checkpoints"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one; nothing is there yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _shuffles_go(spark: SparkSession) -> None:
    """From now on frames drop their shuffle files as soon as an action is done, not when the driver collects its garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def cut(df: DataFrame) -> DataFrame:
    """Compute once, into the shared folder, and cut the lineage: a lost executor costs no more than what came since."""
    shared_folder(df.sparkSession)
    _shuffles_go(df.sparkSession)
    return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """cut() into Parquet files that discard() can delete once nothing reads them."""
    _shuffles_go(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete what stored() wrote."""
    _remove(spark, path)


def null_report(df: DataFrame) -> DataFrame:
    """(column, rows, nulls) of every column, from one pass."""
    counts = df.agg(F.count("*").alias("__rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col("__rows").alias("rows"), F.col(f"`{c}`").alias("nulls")) for c in df.columns])
    return counts.select(F.inline(each))


def attach_dates(fights: DataFrame, events: DataFrame, missing: str = "warn", dedup: bool = True) -> DataFrame:
    """fights with the date of their event. missing: "warn" or "raise" where there is none.

    dedup: an event counts with its first row (by `_ord` if there is one, else the earliest date,
    null last), so the join keeps one row a fight; else one for each row of the event.
    """
    order = F.col("_ord") if "_ord" in events.columns else F.struct(F.col("date").isNull(), "date")
    dates = events.groupBy("event_id").agg(F.min_by(F.struct("date"), order).alias("first")).select("event_id", "first.date") if dedup else events.select("event_id", "date")
    joined = fights.join(dates, "event_id", "left")
    if missing not in ("warn", "raise"):
        return joined
    # only ids are read for it, before the join of whole rows
    lost = fights.select("event_id").join(dates, "event_id", "left").filter(F.col("date").isNull()).count()
    if lost and missing == "raise":
        raise ValueError(f"{lost} fights have no date")
    if lost:
        warnings.warn(f"{lost} fights have no date", stacklevel=2)
    return joined
