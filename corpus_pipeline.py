"""From raw documents to packed sequences: language, repeated lines, near duplicates, benchmark leaks, packing.

Each stage reads what its predecessor wrote. All but the last return the columns of ``documents``.

Defined results: a text that is null or has no letter is rejected by the first stage; an empty table gives an empty
result; of rows that are equal or near copies one stays (the smallest id, null ids last, then the smallest row); null
languages, sources and ids pass through; further columns, whatever their names and types, come out of every stage but the
last unchanged (``n_chars`` follows a text that lost lines); without a benchmark item of at least five words nothing is
taken for a leak.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwatch.llm import decontaminate, language, linededup, neardup, packing
from panelwatch.llm.common import written

STAGES = [
    ("language_id", language.stage),
    ("line_dedup", linededup.stage),
    ("near_duplicates", neardup.stage),
    ("decontamination", decontaminate.stage),
    ("packing", packing.stage),
]

#: Tokenizing, character models and signatures have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that pass all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
