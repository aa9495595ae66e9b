"""Benchmark decontamination by spaced seeds (operator 8).

A seed is the hash of the words that a fixed mask selects from a window; the words under its gaps may differ. Seeds of
the benchmark and of the documents are joined, each hit names a document, an item and the diagonal on which they line
up, and the words along that diagonal are compared: a run is a leak if at least ``min_share`` of its words are equal
and it has at least ``min_words`` words (or is the whole item, for shorter items of at least five words). Every run of
the diagonal is looked at, by sums up to each place.

Before the join the seeds of a document pass a bitmap of fixed size (2 MB) that holds the benchmark's seeds; it only
keeps rows out of the shuffle that cannot meet anything. It is built by a distributed OR and is the only thing that
is broadcast; however large the benchmark grows, the join decides.

Defined results: null and empty texts have no leaks; items shorter than five words are not searched; a run may lie
anywhere in a text; each (document, item) with a leak gives one row with its best run (most equal words, then the
earliest start); repeated rows and repeated items are reported each; an empty table on either side gives an empty
result; further columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwatch.llm import textops
from panelwatch.llm.common import fresh, written

#: Fixed masks, one word per digit; 0 is ignored. The first is the plain five-word window.
MASKS = ("11111", "1101101", "1110011", "1011011", "11010011", "110010101")
BITS = 24
MISMATCH = 2.0
MIN_WORDS = 8
MIN_SHARE = 0.8


def seeds(hashes: np.ndarray, counts: np.ndarray, masks=MASKS):
    """For each mask: (seed, row, place of the window's first word) of all windows that fit into their text."""
    rows = textops.row_of(counts)
    ends = np.cumsum(counts)[rows] if len(rows) else rows
    place = np.arange(len(hashes)) - (ends - counts[rows])
    left = ends - np.arange(len(hashes))
    odd = np.uint64(0xD6E8FEB86659FD93)
    for number, mask in enumerate(masks):
        keep = np.flatnonzero(left >= len(mask))
        out = np.full(len(keep), number + 1, np.uint64)
        for k, digit in enumerate(mask):
            if digit == "1":
                out = out * odd + hashes[keep + k]
        yield textops.mix(out), rows[keep], place[keep]


def slots(seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (seed >> np.uint64(64 - BITS)).astype(np.int64), (seed & np.uint64((1 << BITS) - 1)).astype(np.int64)


def item_task(batches):
    for part in textops.slices(batches, "item_text"):
        hashes, counts = textops.word_hashes(part.column("item_text"))
        for seed, rows, place in seeds(hashes, counts):
            yield pa.RecordBatch.from_arrays(
                [pa.array(seed.view(np.int64)), part.column("item").take(pa.array(rows)), pa.array(place, pa.int32())],
                names=["seed", "item", "item_place"])


def document_task(shared):
    def run(batches):
        bitmap = shared.value
        for part in textops.slices(batches, "text"):
            hashes, counts = textops.word_hashes(part.column("text"))
            for seed, rows, place in seeds(hashes, counts):
                one, two = slots(seed)
                hit = np.flatnonzero(bitmap[one >> 3] >> (one & 7).astype(np.uint8) & 1)
                two = two[hit]
                hit = hit[(bitmap[two >> 3] >> (two & 7).astype(np.uint8) & 1).astype(bool)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed[hit].view(np.int64)), part.column("source").take(pa.array(rows[hit])), pa.array(place[hit], pa.int32())],
                    names=["seed", "source", "place"])
    return run


def bitmap_of(item_seeds: DataFrame) -> np.ndarray:
    """Bitmap over both slots of every seed: 2^21 bytes, whatever the number of seeds."""
    mask = F.lit((1 << BITS) - 1)
    slot = F.explode(F.array(F.shiftrightunsigned("seed", 64 - BITS), F.col("seed").bitwiseAND(mask))).alias("slot")
    words = (item_seeds.select(slot).select(F.shiftright("slot", 5).cast("int").alias("word"), F.expr("shiftleft(1L, cast(slot & 31 AS int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")))
    out = np.zeros(1 << (BITS - 5), np.uint32)
    rows = words.toArrow()
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def best_run(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the run with the highest score (equal 1, different ``-MISMATCH``), whatever its share; leaks use ``longest_run``."""
    gain = np.concatenate([[0.0], np.cumsum(np.where(equal, 1.0, -MISMATCH))])
    low = np.minimum.accumulate(gain)
    end = int(np.argmax(gain - low))
    start = int(np.flatnonzero(gain[:end + 1] == low[end])[-1]) if end else 0
    return start, end


def longest_run(equal: np.ndarray, need: int, min_share: float) -> tuple[int, int] | None:
    """Start and end of the run with the most equal words, then the earliest, that has ``need`` words and the share.

    A run that begins or ends with a different word is no better than without it, unless it must be filled up to
    ``need`` words. For each end the earliest start whose prefix value is low enough gives the most equal words.
    """
    n = len(equal)
    if n < need:
        return None
    same = np.concatenate([[0], np.cumsum(equal)])
    value = same - min_share * np.arange(n + 1)
    # the first start with a value of at most value[end] is a strict new minimum
    lows = np.flatnonzero(np.concatenate([[True], value[1:] < np.minimum.accumulate(value)[:-1]]))
    ends = np.arange(need, n + 1)
    place = np.searchsorted(-value[lows], -value[ends] - 1e-9, side="left")
    starts = lows[np.minimum(place, len(lows) - 1)]
    fits = (place < len(lows)) & (ends - starts >= need)
    if not fits.any():
        return None
    starts, ends = starts[fits], ends[fits]
    got = same[ends] - same[starts]
    best = np.lexsort((ends, starts, -got))[0]
    start, end = int(starts[best]), int(ends[best])
    while end - start > need and not equal[start]:
        start += 1
    while end - start > need and not equal[end - 1]:
        end -= 1
    return start, end


def leaks_of(words: np.ndarray, lines: list[tuple[np.ndarray, int]], min_words: int, min_share: float):
    """Best run per (item words, diagonal): equal words, start and end in the document, or None."""
    for item, diagonal in lines:
        first, last = max(0, -diagonal), min(len(item), len(words) - diagonal)
        if last - first < 1:
            yield None
            continue
        equal = item[first:last] == words[first + diagonal:last + diagonal]
        run = longest_run(equal, min(min_words, len(item)), min_share)
        yield (int(equal[slice(*run)].sum()), first + diagonal + run[0], first + diagonal + run[1]) if run else None


def verify_task(min_words, min_share):
    def run(batches):
        for part in textops.slices(batches, "text"):
            hashes, counts = textops.word_hashes(part.column("text"))
            ends = np.cumsum(counts)
            found, rows = [], []
            lists = part.column("lines").to_pylist()
            texts = sorted({line["item_text"] for x in lists for line in x})
            item_hashes, item_counts = textops.word_hashes(pa.array(texts, pa.string()))
            item_ends = np.cumsum(item_counts)
            item_words = {t: item_hashes[e - n:e] for t, e, n in zip(texts, item_ends, item_counts)}
            for i, lines in enumerate(lists):
                words, best = hashes[ends[i] - counts[i]:ends[i]], {}
                lines = [(x["item"], item_words[x["item_text"]], x["diagonal"]) for x in lines]
                for (item, _, _), run in zip(lines, leaks_of(words, [x[1:] for x in lines], min_words, min_share)):
                    if run and (item not in best or (-run[0], run[1]) < (-best[item][0], best[item][1])):
                        best[item] = run
                for item, run in sorted(best.items()):
                    rows.append(i)
                    found.append((item, *run))
            columns = list(zip(*found)) if found else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [part.column("source").take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int64()),
                 *(pa.array(c, pa.int64()) for c in columns[1:])], names=["source", "item", "n_equal", "first_word", "end_word"])
    return run


def source_key() -> F.Column:
    return F.md5(F.col("text").cast("binary"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, text_key, item_id, n_equal, first_word, end_word) of every leak; words from 0, end exclusive."""
    spark = docs.sparkSession
    items = written(benchmark.filter(F.col("text").isNotNull()).select("item_id", F.col("text").alias("item_text"))
                    .withColumn("item", F.xxhash64("item_text")), "items")
    texts = items.select("item", "item_text").distinct()
    item_seeds = written(texts.mapInArrow(item_task, "seed long, item long, item_place int"), "seeds")
    shared = spark.sparkContext.broadcast(bitmap_of(item_seeds))
    keyed = docs.filter(F.col("text").isNotNull()).select("doc_id", "text", source_key().alias("source"))
    hits = keyed.select("source", "text").mapInArrow(document_task(shared), "seed long, source string, place int")
    lines = written(hits.join(item_seeds, "seed").select("source", "item", (F.col("place") - F.col("item_place")).alias("diagonal")).distinct(), "lines")
    listed = (lines.join(texts, "item").groupBy("source")
              .agg(F.collect_list(F.struct("item", "item_text", "diagonal")).alias("lines")))
    found = (keyed.join(listed, "source").select("doc_id", "source", "text", "lines"))
    unique = found.groupBy("source").agg(F.first("text").alias("text"), F.first("lines").alias("lines"))
    runs = written(unique.mapInArrow(verify_task(min_words, min_share), "source string, item long, n_equal long, first_word long, end_word long"), "runs")
    return (keyed.select("doc_id", "source").join(runs, "source").join(items.select("item", "item_id"), "item")
            .select("doc_id", F.col("source").alias("text_key"), "item_id", "n_equal", "first_word", "end_word"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: one row per document and benchmark item found in it."""
    leaks = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return leaks.select("doc_id", "item_id", "n_equal", "first_word", "end_word")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a leak, unchanged."""
    leaks = find_leaks(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    key = fresh(docs, "key")
    gone = leaks.select(F.col("text_key").alias(key)).distinct()
    return docs.withColumn(key, source_key()).join(gone, key, "left_anti").select(*docs.columns)
