"""Session settings and the one place that writes and removes intermediate tables."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(
    cpus: str = "8", name: str = "acctpulse", memory: str = "10g", shared: str | None = None
) -> SparkSession:
    """A session for tests and benchmarks on one machine; ``shared`` becomes its ``spark.checkpoint.dir``."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus) if cpus.isdigit() else "8")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine uses a folder inside its warehouse; on a cluster it is an
    error, since the default warehouse is a folder of the driver's machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_acctpulse"


#: MB of input files that one partition of :func:`spread` stands for.
SPREAD_MB = 8
#: And one bucket of dealt tables. Every sort and aggregate of a task holds a page of memory, however few its rows.
DEALT_MB = 32


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by ``keys`` to a number of partitions that grows with the files they come from.

    A fixed number of shuffle partitions lets the memory of one task grow with the input. Groupings by these or
    more keys need no other shuffle.
    """
    return df.repartition(parts_for(df, mb=SPREAD_MB), *keys)


def parts_for(*frames: DataFrame, mb: int = SPREAD_MB) -> int:
    """A number of partitions that grows with the files ``frames`` come from, one for each ``mb`` MB."""
    spark, size = frames[0].sparkSession, 0
    for path in {p for df in frames for p in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        size += where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).getLen()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(size / (mb * 2**20)))


#: Paths written and not yet removed, by application.
_written: dict[str, list[str]] = {}
#: Names of those among them that are tables with buckets, by path.
_tables: dict[str, str] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a result that is read more than once as a table, and read it back.

    Cuts the lineage; survives the loss of executors, since the files lie in
    the shared folder. Later reads prune columns and push filters into them.
    The files stay until :func:`release` (or the end of :func:`workspace`).
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/{app}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(app, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_dealt(df: DataFrame, name: str, parts: int, *keys: str) -> DataFrame:
    """As :func:`materialize`, but written in ``parts`` buckets by ``keys``.

    Groupings and windows by these or more keys then need no shuffle, nor do joins of tables with the same buckets.
    All rows of a key lie in one bucket. For joins by more keys than the buckets have, a setting of the session is
    changed; it chooses plans, not results.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    app = spark.sparkContext.applicationId
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{app}/{table}"
    dealt = df.repartition(parts, *keys)
    dealt.write.format("parquet").bucketBy(parts, *keys).option("path", path).saveAsTable(table)
    _written.setdefault(app, []).append(path)
    _tables[path] = table
    return spark.table(table)


def discard(table: DataFrame) -> None:
    """Remove a table that :func:`materialize` returned and that no pending result reads."""
    spark = table.sparkSession
    own = _written.get(spark.sparkContext.applicationId, [])
    for path in [p for p in own if any(f"/{p.rsplit('/', 1)[1]}/" in f for f in table.inputFiles())]:
        _remove(spark, path)
        own.remove(path)


def written(spark: SparkSession) -> list[str]:
    """Paths of the intermediate tables written and not yet removed."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Remove some of them."""
    own = _written.get(spark.sparkContext.applicationId, [])
    for path in paths:
        if path in own:
            _remove(spark, path)
            own.remove(path)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Remove the intermediate tables written so far, but for the first ``keep``.

    Call it once the results that read them have been written or collected.
    """
    own = _written.get(spark.sparkContext.applicationId, [])
    for path in own[keep:]:
        _remove(spark, path)
    del own[keep:]


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are removed at the end, also after a failure."""
    before = len(_written.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, before)


def _remove(spark: SparkSession, path: str) -> None:
    if path in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
