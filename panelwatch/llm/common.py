"""Column names, row keys and task functions shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwatch.session import materialize


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    name = f"__{stem}"
    return name if name not in df.columns else f"__{stem}_{uuid.uuid4().hex}"


def added(df: DataFrame, name: str) -> str:
    """Name of a result column beside the columns of ``df``: with ``_new`` at its end as often as needed to be unused."""
    while name in df.columns:
        name += "_new"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the folder all executors share; later steps read it again after a loss."""
    return materialize(df, f"llm-{name}")


def parts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
