"""Removal of repeated multi-line chunks (operator 3), in DataFrame functions only.

A text is cut into lines, and each line is hashed. A boundary stands after a line when the hash over its own and the
previous line's hash ends in one of ``CUTS``: it depends on two lines only, so the same passage is cut alike wherever
it stands. Chunks lie between boundaries. A chunk with at least two lines that are not blank takes part.

Chunk hashes are counted over all documents; chunks whose hash occurs again are gathered with their bytes and
compared by them. The first place of a chunk keeps it (smallest doc_id, then hash of the text, then place in the
text), every other place loses it.

Data flow: hashes are counted with partial sums, so a chunk that a third of all documents share costs one row a task.
Texts are shuffled twice, by chunk hash and by document; both are joins whose large keys adaptive execution splits.

Defined results: a null text stays null with 0 lines, an empty text has one empty line; rows that agree in doc_id
and text are one source and are treated alike; a null doc_id counts as smaller than every other; further columns
pass through unchanged; a document that loses all its lines keeps an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwatch.llm.common import added, fresh, written

#: Last hexadecimal digits that end a chunk: one line in four.
CUTS = ["0", "4", "8", "c"]


def chunk_array(text: Column) -> Column:
    """Array of (no, lines): the chunks of a text in order."""
    return F.transform("__spans", lambda s, i: F.struct(
        i.alias("no"), F.slice("__lines", s["first"], s["last"] - s["first"] + 1).alias("lines")))


def with_chunks(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``__lines`` and ``__spans`` (first and last line of each chunk, from 1)."""
    col = F.col(text)
    lines = docs.withColumn("__lines", F.split(col, "\n", -1))
    hashed = lines.withColumn("__hashes", F.transform("__lines", lambda x: F.md5(x.cast("binary"))))
    # the window's hash needs the previous line's: pair the array with itself moved by one
    ends = F.zip_with(
        F.concat(F.array(F.lit("")), F.slice("__hashes", 1, F.size("__hashes") - 1)), "__hashes",
        lambda before, own: F.right(F.md5(F.concat(before, own).cast("binary")), F.lit(1)).isin(CUTS))
    cut = hashed.withColumn("__ends", ends).withColumn(
        "__last", F.array_union(
            F.filter(F.transform("__ends", lambda e, i: F.when(e, i + 1)), lambda x: x.isNotNull()),
            F.array(F.size("__lines"))))
    firsts = F.concat(F.array(F.lit(1)), F.transform(F.slice("__last", 1, F.size("__last") - 1), lambda x: x + 1))
    return cut.withColumn("__spans", F.arrays_zip(firsts.alias("first"), F.col("__last").alias("last"))).drop("__hashes", "__ends", "__last")


def source_key(doc_id: str, text: str) -> Column:
    """One value for each (doc_id, text); null for a null text."""
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit("\n"), F.col(text)).cast("binary"))


def chunks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Chunks that take part: key, content, doc_id, place (hash of the text), no, source."""
    base = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    full = with_chunks(base, "__text")
    each = full.select("doc_id", F.md5(F.col("__text").cast("binary")).alias("place"), source_key("doc_id", "__text").alias("source"),
                       F.explode(chunk_array(F.col("__text"))).alias("c"))
    solid = F.size(F.filter("c.lines", lambda x: F.trim(x) != "")) >= 2
    return (each.filter(solid)
            .select(F.array_join("c.lines", "\n").alias("content"), "doc_id", "place", F.col("c.no").alias("no"), "source")
            .withColumn("key", F.md5(F.col("content").cast("binary"))))


def repeated_places(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(source, removed): for each (doc_id, text) the numbers of the chunks that stand earlier somewhere."""
    all_chunks = chunks(docs, doc_id, text)
    again = all_chunks.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    places = written(all_chunks.join(again, "key", "left_semi"), "chunks")
    order = F.struct("doc_id", "place", "no")
    first = places.groupBy("key", "content").agg(F.min(order).alias("first"))
    return (places.join(first, ["key", "content"]).filter(order != F.col("first"))
            .groupBy("source").agg(F.collect_set("no").alias("removed")))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with the text cut down to its kept chunks, plus ``n_lines`` and ``n_removed`` (lines, long).

    ``counts`` names the two result columns; by default a name that ``docs`` has already gets ``_new`` at its end.
    """
    n_lines_name, n_removed_name = counts or (added(docs, "n_lines"), added(docs, "n_removed"))
    clash = [c for c in docs.columns if c.startswith("__") or c in ("source_key", "removed", "n_lines", "n_removed")]
    renamed = docs.withColumnsRenamed({c: fresh(docs, f"own{i}") for i, c in enumerate(clash)})
    back = {fresh(docs, f"own{i}"): c for i, c in enumerate(clash)}
    removed = repeated_places(docs, doc_id, text).withColumnsRenamed({"source": "__source", "removed": "__removed"})
    joined = renamed.withColumn("__source", source_key(doc_id, text)).join(removed, "__source", "left")
    full = with_chunks(joined, text)
    kept = F.flatten(F.transform(F.filter(chunk_array(F.col(text)), lambda c: ~F.array_contains("__removed", c["no"])), lambda c: c["lines"]))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size("__lines")).cast("long")
    done = full.withColumn("n_lines", n_lines).withColumn("__kept", F.when(F.col("__removed").isNotNull(), kept))
    done = done.withColumn("n_removed", F.when(F.col("__removed").isNull(), 0).otherwise(F.size("__lines") - F.size("__kept")).cast("long"))
    done = done.withColumn(text, F.when(F.col("__removed").isNull(), F.col(text)).otherwise(F.array_join("__kept", "\n")))
    counted = F.col("n_lines").alias(n_lines_name), F.col("n_removed").alias(n_removed_name)
    return done.select(*[F.col(c).alias(back.get(c, c)) for c in renamed.columns], *counted)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: one row per document with its kept text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their repeated chunks; n_chars follows the text where the column exists."""
    counts = fresh(docs, "lines"), fresh(docs, "removed")
    out = dedup_lines(docs, counts=counts)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(counts[1]) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


_PLACES = """
lines AS (
  SELECT doc_id, md5(text) AS place, i, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
        FROM (SELECT DISTINCT doc_id, text FROM {docs} WHERE text IS NOT NULL))),
ends AS (
  SELECT *, right(md5(coalesce(lag(md5(line)) OVER w, '') || md5(line)), 1) IN ('0', '4', '8', 'c') AS cut
  FROM lines WINDOW w AS (PARTITION BY doc_id, place ORDER BY i)),
parts AS (
  SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id, place ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no
  FROM ends),
chunks AS (
  SELECT doc_id, place, no, string_agg(line, chr(10) ORDER BY i) AS content, count(*) AS n,
         count(*) FILTER (trim(line) <> '') AS solid
  FROM parts GROUP BY ALL),
ranked AS (
  SELECT *, solid >= 2 AND row_number() OVER (PARTITION BY solid >= 2, content ORDER BY doc_id NULLS FIRST, place, no) > 1 AS gone
  FROM chunks),
deduped AS (
  SELECT doc_id, place, sum(n) AS n_lines, coalesce(sum(n) FILTER (gone), 0) AS n_removed,
         coalesce(string_agg(content, chr(10) ORDER BY no) FILTER (NOT gone), '') AS text
  FROM ranked GROUP BY ALL)
"""

ORACLE_SQL = "WITH " + _PLACES.format(docs="documents") + """
SELECT d.doc_id, coalesce(r.n_lines, 0)::BIGINT AS n_lines, coalesce(r.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN r.text END AS text
FROM documents d LEFT JOIN deduped r ON d.doc_id IS NOT DISTINCT FROM r.doc_id AND md5(d.text) = r.place
"""
