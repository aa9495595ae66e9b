"""Exact top-k inner products by sequential list reads without random access (operator 1).

Vectors are dealt into blocks of bounded size. A block keeps one list per component, sorted by value. For a query, a
component's list is read from the end where its contribution is largest, all lists in step, in growing portions, for
many queries at once; the unread rest of a list does not enter a bound but for its last value. Every
vector has a lower bound (what was read of it, and the worst value of each unread list) and an upper bound (what was
read, and the value each unread list has come down to). Reading stops when all but a few vectors have
an upper bound below the k-th lower bound; those few are resolved to their final scores.

Each query first visits one block; its k-th score there is a lower bound for the whole table, with which the other
blocks stop much earlier. Queries and blocks meet as blocks: each (query block, vector block) pair is one task row and
leaves at most k rows a query; the k best of all blocks are taken with partial sums.

Defined results: vectors that are null, empty of ids, or hold null or non-finite components take no part; components
are floor(scale * x) as far as a long holds them (+-2^62 beyond that); scores are exact, with whole numbers of any size
where products do not fit 64 bits, and scores that no long holds are given as the nearest long and tie; of vectors of
different length the missing components count 0; an empty vector scores 0 with all; the query's own id is no candidate; repeated (id, vector) rows
count once, and an id with several vectors counts with its best; ties go to the smaller id; fewer than k candidates
give fewer rows; further columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwatch.llm.common import written

BLOCK_ROWS = 8192
QUERY_ROWS = 256
LIMIT = float(1 << 62)
LARGEST = (1 << 63) - 1
#: Queries that meet a block in one task.
TASK_QUERIES = 4096
#: Shares of the lists that are read one after another, and the share of a block that is resolved rather than read on.
PORTIONS = (0.25, 0.45, 0.7, 1.0)
RESOLVE = 0.02


def whole_numbers(vectors: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """(vec_id, v): distinct integer vectors that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    ints = F.transform(vector, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x.cast("double") * scale).cast("double"))).cast("long"))
    return (vectors.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & ~bad)
            .select(F.col(vec_id).cast("long").alias("vec_id"), ints.alias("v")).distinct())


def products(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, exact: whole numbers of any size where 64 bits might not hold them."""
    if not queries.size:
        return np.zeros(len(queries), np.int64)
    most = int(max(queries.max(), -queries.min())) * int(max(block.max(), -block.min())) * queries.shape[1]
    if most <= LARGEST:
        return (queries * block).sum(1)
    return (queries.astype(object) * block.astype(object)).sum(1)


def matrix(rows: list, wide: int = 0) -> np.ndarray:
    wide = max([wide, *map(len, rows)])
    if all(len(r) == wide for r in rows) and rows:
        return np.array(rows, np.int64)
    out = np.zeros((len(rows), wide), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


class Lists:
    """A block's component lists: its vectors' ranks by falling value, read from both ends."""

    def __init__(self, ids: np.ndarray, block: np.ndarray):
        self.ids, self.block = ids, block
        self.largest = float(np.abs(block.astype(np.float64)).max(initial=0.0))
        order = np.argsort(-block, axis=0, kind="stable")
        self.values = np.take_along_axis(block, order, 0).astype(np.float64)
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(len(block))[:, None], 0)

    def read(self, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """What ``depth`` entries from the top and from the end of every list show: values and marks."""
        out = []
        for mark in (self.rank < depth, self.rank >= len(self.block) - depth):
            out.append((np.where(mark, self.block, 0).astype(np.float64).T, mark.astype(np.float64).T))
        return out


def search(lists: Lists, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> list[tuple]:
    """(query_id, vec_id, score) of each query's best k of the block that reach its floor."""
    n = len(lists.block)
    found = []
    # a query reads a list from the top where its weight is positive, from the end where it is negative
    top, end = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    going = np.arange(len(queries))
    for portion in PORTIONS:
        if not len(going):
            break
        depth = n if portion == 1 else max(1, int(np.ceil(portion * n)))
        (from_top, seen_top), (from_end, seen_end) = lists.read(depth)
        t, e = top[going], end[going]
        part = t @ from_top + e @ from_end
        front_top, front_end = t * lists.values[depth - 1], e * lists.values[n - depth]
        upper = part + (front_top + front_end).sum(1, keepdims=True) - front_top @ seen_top - front_end @ seen_end
        own = lists.ids[None, :] == query_ids[going, None]
        bound = floors[going].copy()
        open_floor = np.flatnonzero(np.isneginf(bound))
        if len(open_floor) and n > k:
            worst_top, worst_end = t[open_floor] * lists.values[-1], e[open_floor] * lists.values[0]
            lower = part[open_floor] + (worst_top + worst_end).sum(1, keepdims=True) - worst_top @ seen_top - worst_end @ seen_end
            lower[own[open_floor]] = -np.inf
            bound[open_floor] = np.partition(lower, n - k, axis=1)[:, n - k]
        # sums of doubles: a bound may be off by a share of the largest sum there can be
        slack = 0.5 + 1e-12 * (np.abs(t).sum(1) + np.abs(e).sum(1)) * lists.largest
        alive = (upper >= (bound - 2 * slack)[:, None]) & ~own
        few = (alive.sum(1) <= max(4 * k, RESOLVE * n)) | (depth == n)
        row, column = np.nonzero(alive & few[:, None])
        for at in range(0, len(row), 1 << 18):
            r, c = going[row[at:at + (1 << 18)]], column[at:at + (1 << 18)]
            found.append((r, c, products(queries[r], lists.block[c])))
        going = going[~few]
    if not found:
        return []
    row, column, score = (np.concatenate(x) for x in zip(*found))
    ids = lists.ids[column]
    if score.dtype == object:
        order = np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[i], ids[i])), np.int64)
    else:
        order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    best = place < k
    return [(q, i, max(-LARGEST, min(LARGEST, x))) for q, i, x in zip(query_ids[row[best]].tolist(), ids[best].tolist(), score[best].tolist())]


def search_task(k: int, with_floor: bool):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            wide = max(map(len, left["v"]))
            lists = Lists(right["vec_id"].to_numpy(), matrix(list(right["v"]), wide))
            queries = matrix(list(left["v"]), lists.block.shape[1])
            floors = left["floor"].fillna(-np.inf).to_numpy(float) if with_floor else np.full(len(left), -np.inf)
            ids = left["vec_id"].to_numpy()
            for at in range(0, len(left) if lists.block.shape[1] else 0, QUERY_ROWS):
                cut = slice(at, at + QUERY_ROWS)
                out += search(lists, ids[cut], queries[cut], k, floors[cut])
            if not lists.block.shape[1]:  # all vectors are empty
                out = [(q, i, 0) for q in ids for i in sorted(i for i in lists.ids if i != q)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")
    return run


def best(rows: DataFrame, k: int) -> DataFrame:
    one = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best vectors for each row where ``queries`` holds."""
    picked = whole_numbers(vectors.withColumn("__q", queries), vec_id, vector, scale)
    asked = whole_numbers(vectors.filter(queries), vec_id, vector, scale)
    rows = written(picked, "vectors")
    blocks = max(1, -(-rows.count() // block_rows))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"))
    asked = written(asked.withColumn("home", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")), "queries")
    schema = "query_id long, vec_id long, score long"
    groups = max(1, -(-asked.count() // TASK_QUERIES))
    asked = asked.withColumn("group", F.pmod(F.hash("vec_id", "v"), F.lit(groups)))
    home = asked.groupBy("home").cogroup(dealt.groupBy("block")).applyInPandas(search_task(k, False), schema)
    home = written(home, "home")
    floors = best(home, k).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    visits = (asked.join(floors, "vec_id", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
              .filter("block != home"))
    copies = dealt.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    away = visits.groupBy("group", "block").cogroup(copies.groupBy("group", "block")).applyInPandas(search_task(k, True), schema)
    return best(home.union(away), k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """Contract of op1."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH whole AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
