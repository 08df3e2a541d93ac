"""Session helpers: object-store settings, shared scratch space, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType

#: A table is broadcast only after its rows and bytes were counted and found not to exceed these.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Activities of a log of which all pairs may be formed.
ACTIVITIES = 20_000
_WRITTEN: ContextVar[list[str]] = ContextVar("written", default=[])  # noqa: B039  shared on purpose outside of scopes


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", app: str = "traceloom") -> SparkSession:
    """A session for tests and single-node runs; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def required(name: str, env: Mapping[str, str] = os.environ) -> str:
    """A setting of the environment; an error that names it where it is missing."""
    if not env.get(name):
        raise ValueError(f"set {name}")
    return env[name]


def object_store(endpoint: str, key: str, secret: str, path_style: bool = True, timeout_ms: int = 600_000) -> dict[str, str]:
    """Session settings under which ``s3a://`` paths lead to an object store of one's own."""
    s3a = "spark.hadoop.fs.s3a."
    return {
        f"{s3a}endpoint": endpoint,
        f"{s3a}access.key": key,
        f"{s3a}secret.key": secret,
        f"{s3a}path.style.access": str(path_style).lower(),
        f"{s3a}connection.ssl.enabled": str(endpoint.startswith("https")).lower(),
        f"{s3a}connection.timeout": str(timeout_ms),
        f"{s3a}impl": "org.apache.hadoop.fs.s3a.S3AFileSystem",
    }


def session_from(env: Mapping[str, str] = os.environ, app: str = "traceloom") -> SparkSession:
    """The session of the command line; with ``TRACELOOM_S3_ENDPOINT`` set, ``_KEY`` and ``_SECRET`` are required too and ``s3a://`` paths work."""
    builder = SparkSession.builder.appName(app)
    if env.get("TRACELOOM_S3_ENDPOINT"):
        style = env.get("TRACELOOM_S3_PATH_STYLE", "true") != "false"
        for k, v in object_store(required("TRACELOOM_S3_ENDPOINT", env), required("TRACELOOM_S3_KEY", env), required("TRACELOOM_S3_SECRET", env), style).items():
            builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (tests, single node) a local folder is made; on a cluster
    without the setting that would not be shared, so it is refused.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(scratch_dir, "own", None)
    if own is None or not os.path.isdir(own):
        own = scratch_dir.own = tempfile.mkdtemp(prefix="traceloom-")
        atexit.register(shutil.rmtree, own, True)
    return own


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` and survives lost executors, but is computed once only,
    is stored as compressed columns, and later reads can prune columns.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/traceloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes what ``materialize`` has written so far; results that still read it must have been stored."""
    written = _WRITTEN.get()
    while written:
        path = spark._jvm.org.apache.hadoop.fs.Path(written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what ``materialize`` wrote inside it."""
    token = _WRITTEN.set([])
    try:
        yield
    finally:
        drop_scratch(spark)
        _WRITTEN.reset(token)


def _bytes(c: Column, kind: DataType) -> Column:
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        each = F.octet_length(F.array_join(c, "")) + 16 * F.size(c) if isinstance(kind.elementType, StringType) else 16 * F.size(c)
        return F.coalesce(each, F.lit(0)) + 16
    return F.lit(16)


def broadcast_if_bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and about ``size`` bytes (counted, and never beyond the bounds).

    Beyond them the hint is left out: the join is then a shuffle join, which adaptive execution splits where it is skewed.
    ``df`` should be materialised: its rows are counted (from the footers of its files), and if they are few its values are measured.
    """
    if df.count() > rows:
        return df
    held = df.agg(F.sum(sum((_bytes(F.col(f"`{x.name}`"), x.dataType) for x in df.schema), F.lit(0)))).first()[0] or 0
    return F.broadcast(df) if held <= size else df


def at_most(df: DataFrame, rows: int, what: str) -> DataFrame:
    """``df``, whose rows are counted as they pass: an error that names ``what`` if there are more than ``rows``.

    For small tables that all pairs are formed of; the rows pass through one task, and no further than the bound.
    """
    counted = df.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    fine = F.when(F.col("_rows") <= rows, F.lit(True)).otherwise(F.raise_error(F.lit(f"more than {rows} {what}")).cast("boolean"))
    return counted.where(fine).drop("_rows")


def collect_bounded(df: DataFrame, rows: int, what: str) -> list:
    """The rows of ``df`` on the driver, if they are at most ``rows``; an error otherwise, never a cut."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"more than {rows} {what}; raise the bound if the driver can hold them")
    return got
