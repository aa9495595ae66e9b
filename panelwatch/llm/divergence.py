"""How far the word use of sources differs within each language (operator 11).

Texts are collapsed first: identical texts of a language become one row with a multiplicity per source (texts that occur
once stay where they are). Each text is tokenized once; its words are added to every source with the multiplicity as weight, for counts and for document
frequencies alike. Tasks keep these sums in dicts and give them up when they hold ``HELD`` of them; Spark adds the rest.

A term is kept by a language if at least ``least`` of its documents hold it. Groups are (language, source); a group's
smoothed share of a term is ``p = 1 + floor(10^9 (count + 5) / (N + 5 V))``. Terms that a group does not use all have one
and the same share, its base. The distance of two groups is therefore V times the difference of their bases, corrected
by the terms that at least one of them uses. Corrections come from tiles: up to 256 by 256 sources of a language and
one bucket of about 2,048 terms, a small dense matrix per side. No pairs are made per term; one row per pair of
groups leaves each tile. The pairs of sources of a language are the result itself.

Defined results: null text, language and source are empty strings; a group without terms takes part with N = 0; a
language without kept terms has distances of 0 and no term rows; repeated rows count each; an empty table gives an empty
result; ties are ordered by the item's bytes; further columns are left alone. All arithmetic is exact (integers and
decimals of 38 digits).
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwatch.llm import textops
from panelwatch.llm.common import written
from panelwatch.llm.decontaminate import bitmap_of, slots

LEAST, TOP_TERMS = 30, 50
SCALE, SMOOTH = 1_000_000_000, 5
#: Occurrences and documents of a term share one whole number: the occurrences are its lower 63 bits.
COUNT = (1 << 63) - 1
#: Sums a task holds before it gives them up, sources on a side of a tile, terms in a bucket.
HELD, SIDE, BUCKET = 1_000_000, 256, 2048

# letters a-z and all bytes of non-ASCII characters belong to terms, A-Z is lowered, the rest separates
_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES)
TABLE = np.where(((_LOWER >= 97) & (_LOWER <= 122)) | (_LOWER >= 128), _LOWER, 32).astype(np.uint8).tobytes()


def keyed_texts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """lang, text, source without nulls, the text's key, and a hash of language and key."""
    base = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (text, "text"), (source, "source"))])
    return base.withColumn("key", F.unhex(F.sha2("text", 256))).withColumn("seed", F.xxhash64("lang", "key"))


def chosen(batches, bitmap: np.ndarray, repeated: bool):
    """The rows whose hash is in the bitmap of repeated texts, or all others."""
    for batch in batches:
        hit = np.ones(batch.num_rows, bool)
        for slot in slots(batch.column("seed").to_numpy().view(np.uint64)):
            hit &= (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
        yield batch.filter(pa.array(hit == repeated))


def chosen_task(shared):
    """The rows of texts that may occur again."""
    def run(batches):
        yield from chosen(batches, shared.value, True)
    return run


def collapsed(keyed: DataFrame, shared) -> DataFrame:
    """(lang, text, sources): each text that occurs again, once a language, with the number of its rows per source.

    Only texts that may occur again are shuffled: the hashes of the keys that do are in a bitmap of fixed size (2 MB).
    A text that is taken for a repeated one by mistake just forms a group of its own.
    """
    often = keyed.mapInArrow(chosen_task(shared), keyed.schema)
    each = often.groupBy("lang", "key", "source").agg(F.count("*").alias("n"))
    # one entry per source at most, however many rows there are
    sources = each.groupBy("lang", "key").agg(F.collect_list(F.struct("source", "n")).alias("sources"))
    texts = often.groupBy("lang", "key").agg(F.first("text").alias("text"))
    return texts.join(sources, ["lang", "key"]).select("lang", "text", "sources")


def term_task(held: int, shared=None):
    """Weighted sums per (lang, source, term) over collapsed texts: occurrences and documents.

    With a bitmap, over all texts (lang, text, source, seed) that are not in it: they are picked where they are
    counted, as a task of their own would be a second Python process beside each of these.
    """
    def run(batches):
        batches = batches if shared is None else chosen(batches, shared.value, False)
        sums, size = defaultdict(dict), 0

        def given():
            for (lang, source), terms in sums.items():
                names, values = list(terms), list(terms.values())
                for at in range(0, len(names), 100_000):
                    some = values[at:at + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()),
                         pa.array(names[at:at + 100_000], pa.binary()).cast(pa.string()), pa.array([v & COUNT for v in some], pa.int64()),
                         pa.array([v >> 63 for v in some], pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for part in textops.slices(batches, "text"):
            texts = part.column("text").cast(pa.large_binary()).to_pylist()
            own = part.column("sources").to_pylist() if shared is None else [[{"source": s, "n": 1}] for s in part.column("source").to_pylist()]
            for lang, text, sources in zip(part.column("lang").to_pylist(), texts, own):
                words = Counter(text.translate(TABLE).split())
                for s in sources:
                    group, times = sums[lang, s["source"]], s["n"]
                    document, known, before = times << 63, group.get, len(group)
                    for term, n in words.items():
                        group[term] = known(term, 0) + n * times + document
                    size += len(group) - before
                    if size > held:
                        yield from given()
                        sums, size = defaultdict(dict), 0
        yield from given()
    return run


def kept_terms(docs: DataFrame, text: str, lang: str, source: str, least: int, held: int) -> DataFrame:
    """(lang, term, total, sources): the kept terms, their count in the language and in each source that uses them."""
    keyed, kind = keyed_texts(docs, text, lang, source), "lang string, source string, term string, n long, docs long"
    again = keyed.groupBy("lang", "key", "seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(again))
    sums = (keyed.select("lang", "text", "source", "seed").mapInArrow(term_task(held, shared), kind)
            .union(collapsed(keyed, shared).mapInArrow(term_task(held), kind)))
    each = sums.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return (each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("sources"))
            .filter(F.col("docs") >= least).drop("docs"))


def share_of(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)); null where there are no terms. Sums stay below 10^24."""
    top = (count + SMOOTH).cast("decimal(18,0)") * F.lit(SCALE).cast("decimal(10,0)")
    low = (total + SMOOTH * terms).cast("decimal(19,0)")
    return F.when(terms > 0, F.lit(1) + F.call_function("div", top, low))


def tile_distance(tile: pd.DataFrame) -> pd.DataFrame:
    """Corrections of one tile and bucket: rows of sources (term null) and of the terms they use.

    The correction of two sources is the sum of \\|p - q\\| over the bucket's terms, less as often the difference of their
    bases, which both have at terms that neither uses.
    """
    known = tile[tile["term"].isna()]
    used = tile[tile["term"].notna()]
    code, terms = pd.factorize(used["term"])
    none = pd.DataFrame({"lang": pd.Series(dtype=str), "one": pd.Series(dtype="int64"), "two": pd.Series(dtype="int64"), "more": pd.Series(dtype="int64")})
    if not len(terms):
        return none
    sides = []
    for side in ("tile_one", "tile_two"):
        own = known[known["idx"] // SIDE == known[side]].drop_duplicates("idx").sort_values("idx")
        ids, base = own["idx"].to_numpy(np.int64), own["p"].to_numpy(np.int64)
        matrix = np.repeat(base[:, None], len(terms), axis=1)
        mine = (used["idx"] // SIDE == used[side]).to_numpy()
        matrix[np.searchsorted(ids, used["idx"].to_numpy(np.int64)[mine]), code[mine]] = used["p"].to_numpy(np.int64)[mine]
        sides.append((ids, base, matrix))
    (ids, base, matrix), (others, other_base, other) = sides
    one, two, more = [], [], []
    for i, row in enumerate(matrix):
        later = others > ids[i]
        if later.any():
            gap = np.abs(other[later] - row).sum(1) - len(terms) * np.abs(other_base[later] - base[i])
            one.append(np.full(len(gap), ids[i]))
            two.append(others[later])
            more.append(gap)
    if not one:
        return none
    return pd.DataFrame({"lang": tile["lang"].iloc[0], "one": np.concatenate(one), "two": np.concatenate(two), "more": np.concatenate(more)})


def pair_distances(shares: DataFrame, groups: DataFrame, most_terms: int) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language.

    ``groups``: lang, source, idx (from 0 within the language), base, terms; ``shares``: lang, term, idx, p.
    """
    buckets = max(1, -(-most_terms // BUCKET))
    tiles = groups.groupBy("lang").agg(F.floor((F.max("idx") + SIDE) / SIDE).cast("int").alias("tiles"))

    def dealt(rows: DataFrame) -> DataFrame:
        """Each row once for every tile that holds its source."""
        own = F.floor(F.col("idx") / SIDE).cast("int")
        with_tile = rows.join(tiles, "lang").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        return (with_tile.withColumn("tile_one", F.least(own, "other")).withColumn("tile_two", F.greatest(own, "other"))
                .select("lang", "tile_one", "tile_two", "bucket", "idx", "term", "p"))

    terms = shares.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    sources = (groups.filter("terms > 0").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
               .withColumn("term", F.lit(None).cast("string")).withColumn("p", F.col("base")))
    more = (dealt(terms).unionByName(dealt(sources)).groupBy("lang", "tile_one", "tile_two", "bucket")
            .applyInPandas(tile_distance, "lang string, one long, two long, more long")
            .groupBy("lang", "one", "two").agg(F.sum("more").alias("more")))
    one, two = (groups.select("lang", F.col("idx").alias(n), F.col("source").alias(f"source_{n}"), F.col("base").alias(f"base_{n}"), *extra)
                for n, extra in (("one", ["terms"]), ("two", [])))
    apart = (one.join(two, "lang").filter("one < two").join(more, ["lang", "one", "two"], "left")
             .withColumn("value", F.coalesce(F.col("terms") * F.abs(F.col("base_one") - F.col("base_two")), F.lit(0)) + F.coalesce("more", F.lit(0))))
    both = F.explode(F.array(*[F.struct(F.col(f"source_{a}").alias("source"), F.col(f"source_{b}").alias("item")) for a, b in (("one", "two"), ("two", "one"))]))
    return apart.select("lang", "value", both.alias("pair")).select("lang", "pair.source", "pair.item", "value")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST,
          top_terms: int = TOP_TERMS, held: int = HELD) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources and the terms a source uses more."""
    terms = written(kept_terms(docs, text, lang, source, least, held), "terms")
    size = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
    each = terms.select("lang", "term", "total", F.explode("sources").alias("s")).select("lang", "term", "total", "s.source", "s.n")
    used = each.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    groups = (docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]).distinct()
              .join(size, "lang", "left").join(used, ["lang", "source"], "left").na.fill(0, ["terms", "lang_total", "group_total"]))
    groups = written(groups.withColumn("idx", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
                     .withColumn("base", share_of(F.lit(0).cast("long"), F.col("group_total"), F.col("terms"))), "groups")
    shares = written(each.join(groups, ["lang", "source"]).withColumn("p", share_of(F.col("n"), F.col("group_total"), F.col("terms")))
                     .withColumn("q", share_of(F.col("total"), F.col("lang_total"), F.col("terms"))).select("lang", "source", "idx", "term", "p", "q"), "shares")
    most = groups.agg(F.max("terms")).first()[0] or 0
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_distances(shares.select("lang", "idx", "term", "p"), groups, most).withColumn("rank", F.row_number().over(order))
    more = (shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(more.withColumn("part", F.lit("term")).select(*columns)))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: every ordered pair of sources of a language, and the first 50 terms of each source."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ws)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30),
c AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n
  FROM (SELECT lang, source, unnest(ws) AS term FROM d) JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
g AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * v.v) AS p
  FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (
  SELECT c.lang, c.term, 1 + (1000000000::HUGEINT * (sum(c.n) + 5)) // (any_value(t.n) + 5 * any_value(v.v)) AS q
  FROM c JOIN v ON v.lang = c.lang JOIN (SELECT lang, sum(n)::HUGEINT AS n FROM c GROUP BY lang) t ON t.lang = c.lang GROUP BY c.lang, c.term),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value
  FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
