"""Session set-up, shared-folder checkpoints and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if the planner proves it to be no larger than this.
BROADCAST_LIMIT = 16 << 20


def session(cores: int | str = 8, app: str = "quirefold", **conf: str) -> SparkSession:
    """A local session with the settings that tests and benchmarks use."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("QUIREFOLD_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir; where that is unset and all runs in this process, a folder of the warehouse."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_between"


#: Tables written by this process and not yet discarded.
_written: dict[str, SparkSession] = {}


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut, and a lost executor costs nothing. The table is
    removed by discard, or when the process ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written[path] = df.sparkSession
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Remove tables of materialize that no later result reads."""
    for t in tables:
        path = getattr(t, "_path", None)
        if path in _written:
            _remove(path, _written.pop(path))


def _remove(path: str, spark: SparkSession) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clear() -> None:
    for path, spark in list(_written.items()):
        try:
            _remove(path, spark)
        except Exception:  # the session is gone; the folder is the cluster's to clean
            return


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """SQL settings for plans that are made inside; they are as before afterwards. Names have _ for a dot."""
    names = {k.replace("_", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def planned_bytes(df: DataFrame) -> int:
    """Estimate of a plan's size from Catalyst's statistics; runs no job. It is no bound: files are compressed, and rows may be unfolded."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def table_bytes(table: DataFrame) -> int:
    """Bytes that a written table has in memory, by its number of rows and the width of its columns; strings and arrays count
    as ten times what the files have."""
    fixed = sum(f.dataType.jsonValue() in ("integer", "long", "float", "double", "boolean", "date", "timestamp", "short", "byte") for f in table.schema)
    rows = table.count()
    return rows * (24 + 8 * len(table.columns)) + (0 if fixed == len(table.columns) else 10 * planned_bytes(table))


def is_small(table: DataFrame, limit: int = BROADCAST_LIMIT) -> bool:
    """Whether a written table, counted, is small enough to be broadcast."""
    return table_bytes(table) <= limit


def small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """df with a broadcast hint if it is small, else as it is (shuffled join, skew left to AQE). A written table is counted; of
    other plans the planner's estimate must be far below the limit."""
    return F.broadcast(df) if _small(df, limit) else df


def _small(df: DataFrame, limit: int) -> bool:
    return is_small(df, limit) if hasattr(df, "_path") else planned_bytes(df) <= limit // 4


def join_hot(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salt_from: list[str] | None = None, salts: int = 16) -> DataFrame:
    """Equi-join that survives hot keys on the left. A right side of proven size is broadcast; a larger one is copied
    `salts` times and joined on (key, salt), the salt of a left row being a hash of `salt_from`."""
    if _small(right, BROADCAST_LIMIT):
        return left.join(F.broadcast(right), on, how)
    salt = F.pmod(F.xxhash64(*(salt_from or left.columns)), F.lit(salts)).cast("int")
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt).join(many, [*on, "_salt"], how).drop("_salt")


def least_frequent(df: DataFrame, count: str, most: int) -> tuple[int | None, bool]:
    """(least whole part of a count such that at most `most` rows of df reach it, or None if the largest count alone has more;
    whether all rows do). A histogram of counts finds it."""
    cells = sorted(df.groupBy(_level(count).alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True)
    taken, least = 0, None
    for at, n in cells:
        if taken + n > most:
            return least, False
        taken, least = taken + n, at
    return least, True


def _level(count: str) -> Column:
    return F.least(F.floor(count), F.lit(100_000))


def frequent(count: str, least: int | None) -> Column:
    """Whether a row reaches the level that least_frequent found."""
    return F.lit(False) if least is None else _level(count) >= least


def most_frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """At most `most` rows of df with the largest counts, by a threshold: a histogram of counts finds it, so that no task
    holds more than the result. Rows of the count at the threshold come in whole or not at all; if the largest count alone
    has more rows, there are none. For what a task may hold, the rest being joined."""
    return df.filter(frequent(count, least_frequent(df, count, most)[0]))
