"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


_LOCAL_DIRS: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}

#: Most rows of a result that may become part of a plan.
HELD_ROWS = 10_000


def build_session(app: str = "panelwatch", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution, skew handling and UTC time.

    Partition counts are left to adaptive execution: it starts from
    ``spark.sql.shuffle.partitions`` and merges small partitions at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/") + "/panelwatch"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="panelwatch-")
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path in the shared folder; :func:`drop_scratch` knows it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def scratch_mark(spark: SparkSession) -> int:
    """A place in the list of this session's scratch tables, for :func:`drop_scratch`."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def drop_scratch(spark: SparkSession, since: int = 0) -> int:
    """Remove the scratch tables this session made after ``since``; returns how many there were.

    Call it when the results that read them are written: a DataFrame that was
    not is lost with them. Other sessions' tables are not touched.
    """
    paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
    gone, paths[since:] = paths[since:], []
    for path in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(gone)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several later passes: the table survives lost
    executors, is read by column, and its true size guides the join strategy.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A short fixed table held in the plan itself, with its true size known to the optimizer."""
    names = StructType.fromDDL(schema).fieldNames()
    columns = list(zip(*rows)) if rows else [()] * len(names)
    arrow = pa.table({name: list(values) for name, values in zip(names, columns)})
    return spark.createDataFrame(arrow, schema)


def held(df: DataFrame, most: int = HELD_ROWS) -> DataFrame:
    """A result of a few rows, taken once and held in the plan; more than ``most`` rows are an error."""
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"more than {most} rows to hold in the plan: write them as a table")
    return df.sparkSession.createDataFrame(rows, df.schema)


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if nothing was written there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def one_row(df: DataFrame) -> dict:
    """The single row of an ungrouped aggregate as plain values.

    Column statistics are read this way and enter later plans as constants: a
    filter pushed through them copies numbers, not another pass over the data.
    """
    return df.first().asDict()
