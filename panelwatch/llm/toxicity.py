"""Toxicity of obfuscated text (operator 5).

Noisy channel: what was written is a disguise of what was meant. Digits and signs may stand for letters, letters may be
repeated, and a word may be written as single letters with separators. Such places are found in the whole text; each
becomes a lattice of the letters it may stand for, at a price per substitution, merged repeat and dropped separator, and
Viterbi decoding takes the path that is likeliest under a character trigram model of the corpus. The restored words join
the words of the text.

Score: words fall into 2^18 buckets. Every labelled training row counts with its own label; rows with the same sketch
(the three smallest hashes of their three-word runs, so copies and most near copies, but not texts that share a
passage) have the weight of one row together. A bucket becomes a feature if it is clearly commoner in toxic texts
(likelihood ratio ``least_ratio`` or more and three times the odds). A text's raw value is the sum of the log odds of its
features; a logistic curve fitted on the training rows turns it into a probability. The model is the trigram table (27^3)
and one number for each bucket that is a feature.

Data flow: labels meet ids and sketches, a few bytes a row. Word buckets are only made for rows whose sketch is in a
bitmap (2 MB) of the labelled ones, joined by id and sketch, and summed inside each task. All texts are read again
for the scores; no word of an unlabelled text is stored or shuffled. The search for disguised places goes through a text
once; places longer than ``WIDE`` characters are decoded in overlapping windows, so the work follows the text's length.

Defined results: null and empty texts get the score of a text without features; rows whose id is null are scored and
not learned from; an id with several labels counts as toxic if one says so; repeated rows are scored each; without
labelled rows of both kinds every score is the share of toxic rows (0 without any); further columns are left alone.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwatch.llm import textops
from panelwatch.llm.common import fold, written
from panelwatch.llm.decontaminate import bitmap_of, slots

BUCKET_BITS = 18
SYMBOLS = 27
#: Weight of a row whose sketch no other row has.
ONE = 1 << 20

# What a sign may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "*": "aeiou",
}
SUBSTITUTE, MERGE, DROP, DOUBLE = 1.5, 0.5, 0.5, 2.5

#: A sign beside a letter (an exclamation mark only before one), a letter three times, three or more single characters.
MIXED = re.compile(r"[^\W\d_][0-9@$|+*]|[0-9@$!|+*][^\W\d_]")
REPEAT = re.compile(r"([a-z])\1\1")
SPACED = re.compile(r"(?<![^\W_])[a-z0-9@$!](?:[ .\-_*~/]{1,2}[a-z0-9@$!]){2,}(?![^\W_])")
TOKEN = re.compile(r"[^\s.,;:?\"'()\[\]{}<>=/\\&%#^~`]+")
#: Places are decoded in windows of so many characters, each half over the next.
WIDE = 48


def trigram_task(batches):
    """Counts of letter trigrams; all that is no plain letter is a gap."""
    total = np.zeros(SYMBOLS ** 3, np.int64)
    for part in textops.slices(batches, "text"):
        letters, _ = textops.letter_stream(part.column("text").to_pylist())
        s = np.where(letters < SYMBOLS, letters, 0).astype(np.int64)
        if len(s) > 2:
            codes = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
            total += np.bincount(codes, minlength=SYMBOLS ** 3)
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], names=["code", "n"])


def trigram_model(texts: DataFrame) -> np.ndarray:
    """log P(c | a, b) as an array of 27 x 27 x 27."""
    counts = np.zeros(SYMBOLS ** 3)
    for r in texts.select("text").mapInArrow(trigram_task, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        counts[r.code] = r.n
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pair = counts.sum(0) + 0.1
    pair = pair / pair.sum(1, keepdims=True)
    return np.log((counts + 2 * pair[None]) / (counts.sum(2, keepdims=True) + 2))


def lattice(span: str, spaced: bool | None = None) -> list[list[tuple[str, float]]]:
    """Per place the letters it may stand for and their price; '' drops the place."""
    spaced = SPACED.fullmatch(span) is not None if spaced is None else spaced
    out, i = [], 0
    while i < len(span):
        c, run = span[i], 1
        while i + run < len(span) and span[i + run] == c:
            run += 1
        if "a" <= c <= "z":
            # each letter less makes a reading likelier, so a double letter needs a bonus over a single one
            choices = [(c, MERGE)] + [(c * 2, MERGE - DOUBLE)] if run > 2 else [(c, 2 * DOUBLE), (c * 2, 0.0)] if run == 2 else [(c, 0.0)]
        elif c in STANDS_FOR:
            choices = [(x, SUBSTITUTE + MERGE * (run > 1)) for x in STANDS_FOR[c]] + ([("", DROP)] if c in "*!|+" else [])
            if run > 1:
                choices += [(x * run, SUBSTITUTE * run) for x in STANDS_FOR[c]]
        elif c.isalpha():
            choices = [(" ", 0.0)]
        else:
            choices = [("", DROP if spaced else SUBSTITUTE), (" ", 2.0 if spaced else 0.5)]
        out.append(choices)
        i += run
    return out


def viterbi(span: str, log_model: np.ndarray) -> str:
    """The likeliest reading of a span."""
    states = {(0, 0): (0.0, "")}
    for choices in lattice(span) + [[(" ", 0.0)]]:
        following: dict = {}
        for (a, b), (value, text) in states.items():
            for letters, price in choices:
                x, y, v = a, b, value - price
                for c in letters:
                    s = 0 if c == " " else ord(c) - 96
                    v += log_model[x, y, s]
                    x, y = y, s
                if (x, y) not in following or v > following[x, y][0]:
                    following[x, y] = (v, text + letters)
        states = following
    return max(states.values())[1].strip()


def windows(span: str) -> list[str]:
    return [span[a:a + WIDE] for a in range(0, max(1, len(span) - WIDE // 2), WIDE // 2)]


def suspicious(low: str) -> list[str]:
    """Spans of a lower-case text that may be disguised words."""
    spans = [w.strip(" .-_*~/") for m in SPACED.finditer(low) for w in windows(m.group())]
    for m in TOKEN.finditer(low):
        token = m.group().strip("!|+*-_")
        if MIXED.search(token) or REPEAT.search(token):
            spans += windows(token)
    return spans


def doubtful(column: pa.Array) -> np.ndarray:
    """Texts that may hold a disguise: a letter three times, a sign beside a letter, or three single characters in a row.

    A look at the bytes that spares clean texts the exact search; it misses nothing that the search would find.
    """
    data, offsets = textops.raw(column)
    out = np.zeros(len(column), bool)
    if len(data) < 2:
        return out
    lower = np.where((data >= 65) & (data <= 90), data | np.uint8(0x20), data)
    plain = (lower >= 97) & (lower <= 122)
    letter, digit = plain | (data >= 128), (data >= 48) & (data <= 57)
    front = digit | np.isin(data, np.frombuffer(b"@$!|+*", np.uint8))
    back = front & (data != 33)
    mark = np.zeros(len(data), bool)
    mark[2:] |= plain[2:] & (lower[2:] == lower[1:-1]) & (lower[2:] == lower[:-2])
    mark[1:] |= (front[:-1] & letter[1:]) | (letter[:-1] & back[1:])
    word = plain | digit
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    begins = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    before[begins] = after[begins - 1] = False
    at = np.flatnonzero((word & ~before & ~after) | np.isin(data, np.frombuffer(b"@$!", np.uint8)))
    if len(at) > 2:
        mark[at[2:][at[2:] - at[:-2] <= 6]] = True
    hits = np.flatnonzero(mark)
    out[np.searchsorted(offsets, hits, side="right") - 1] = True
    return out


def restorer(log_model: np.ndarray):
    """column of texts -> restored words of each, with the readings of recent spans kept."""
    read = lru_cache(maxsize=50_000)(lambda span: viterbi(span, log_model))

    def restore(column: pa.Array) -> pa.Array:
        check = doubtful(column)
        texts = column.filter(pa.array(check)).to_pylist()
        words = np.full(len(column), "", object)
        words[check] = [" ".join(read(s) for s in suspicious(t.lower()) if s) for t in texts]
        return pa.array(words, pa.string())
    return restore


def restore_task(shared):
    def run(batches):
        restore = restorer(shared.value)
        for part in textops.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), restore(part.column("text"))], names=["doc_id", "restored"])
    return run


def restored_words(docs: DataFrame, log_model: np.ndarray) -> DataFrame:
    """(doc_id, restored): the restored words of each text, joined by spaces."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(log_model)
    return docs.select("doc_id", "text").mapInArrow(restore_task(shared), f"doc_id {kind}, restored string")


def sketches_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One number per text from the three smallest different hashes of its three-word runs; 0 without words."""
    gram, rows = textops.grams(hashes, counts, 3)
    out = np.zeros(len(counts), np.uint64)
    if not len(gram):
        return out
    order = np.lexsort((gram, rows))
    gram, rows = gram[order], rows[order]
    new = np.append(True, (gram[1:] != gram[:-1]) | (rows[1:] != rows[:-1]))
    gram, rows = gram[new], rows[new]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    low = place < 3
    np.add.at(out, rows[low], textops.mix(gram[low] + place[low].astype(np.uint64)))
    return out


def sketch_task(batches):
    """(doc_id, sketch) of every text."""
    for part in textops.slices(batches, "text"):
        sketch = sketches_of(*textops.word_hashes(part.column("text")))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sketch.view(np.int64))], names=["doc_id", "sketch"])


def buckets_of(column: pa.Array, restore) -> tuple[np.ndarray, np.ndarray]:
    """Rows and distinct buckets of written and restored words, sorted by both."""
    hashes, counts = textops.word_hashes(column)
    extra, extra_counts = textops.word_hashes(restore(column))
    row = np.concatenate([textops.row_of(counts), textops.row_of(extra_counts)])
    bucket = np.concatenate([hashes, extra]) >> np.uint64(64 - BUCKET_BITS)
    both = np.unique((row.astype(np.uint64) << np.uint64(BUCKET_BITS)) | bucket)
    return (both >> np.uint64(BUCKET_BITS)).astype(np.int64), (both & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)


def train_task(shared):
    """(doc_id, sketch, buckets) of the texts whose sketch may be a labelled one."""
    def run(batches):
        log_model, bitmap = shared.value
        restore = restorer(log_model)
        for part in textops.slices(batches, "text"):
            sketch = sketches_of(*textops.word_hashes(part.column("text")))
            one, two = slots(sketch)
            keep = pa.array(((bitmap[one >> 3] >> (one & 7).astype(np.uint8)) & (bitmap[two >> 3] >> (two & 7).astype(np.uint8)) & 1).astype(bool))
            part, sketch = part.filter(keep), pa.array(sketch.view(np.int64)).filter(keep)
            row, bucket = buckets_of(part.column("text"), restore)
            offsets = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), sketch, pa.ListArray.from_arrays(offsets, pa.array(bucket.astype(np.int32)))],
                names=["doc_id", "sketch", "buckets"])
    return run


def flat_buckets(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of a list column."""
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return textops.row_of(lengths), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def sum_task(batches):
    """Weighted sums per bucket over (toxic, weight, buckets) rows, one row per bucket and task."""
    bad, total = np.zeros(1 << BUCKET_BITS, np.int64), np.zeros(1 << BUCKET_BITS, np.int64)
    for part in batches:
        row, bucket = flat_buckets(part.column("buckets"))
        weight, toxic = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("weight", "toxic"))
        np.add.at(total, bucket, weight[row])
        np.add.at(bad, bucket, (weight * toxic)[row])
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(bad[there]), pa.array(total[there])], names=["bucket", "bad", "n"])


def raw_values(weights: np.ndarray, row: np.ndarray, bucket: np.ndarray, rows: int) -> np.ndarray:
    """Sum of the weights of each row's buckets."""
    return np.bincount(row, weights[bucket], rows) if len(row) else np.zeros(rows)


def bin_task(shared):
    """Weighted rows per tenth of the raw value and label."""
    def run(batches):
        for part in batches:
            raw = np.round(raw_values(shared.value, *flat_buckets(part.column("buckets")), part.num_rows) * 10).astype(np.int64)
            toxic = pa.array(part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(raw), toxic, part.column("weight")], names=["bin", "toxic", "n"])
    return run


def logistic(x: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with a weak pull towards 0."""
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        n = positive + negative
        g = np.array([(x * (positive - n * p)).sum() - 0.01 * a, (positive - n * p).sum() - 0.01 * b])
        w = n * p * (1 - p)
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
    return float(a), float(b)


def feature_weights(train: DataFrame, least_ratio: float) -> tuple[np.ndarray, float, float]:
    """Log odds per bucket from (toxic, weight, buckets) rows; 0 where it is no feature."""
    sizes = {r.toxic: r.n / ONE for r in train.groupBy("toxic").agg(F.sum("weight").alias("n")).collect()}
    bad, good = sizes.get(1, 0.0), sizes.get(0, 0.0)
    weights = np.zeros(1 << BUCKET_BITS)
    if not bad or not good:
        return weights, bad, good
    sums = train.select("toxic", "weight", "buckets").mapInArrow(sum_task, "bucket int, bad long, n long")
    rows = (sums.groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
            .filter(F.col("bad") >= int(2.99 * ONE)).toArrow())  # at most 2^18 rows
    k, at = rows.column("bad").to_numpy() / ONE, rows.column("bucket").to_numpy()
    m = np.maximum(rows.column("n").to_numpy() / ONE - k, 0.0)
    share = np.minimum((k + m) / (bad + good), 1.0)

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    left = np.maximum(bad - k, 0.0), np.maximum(good - m, 0.0)
    ratio = 2 * (part(k, bad * share) + part(m, good * share) + part(left[0], bad * (1 - share)) + part(left[1], good * (1 - share)))
    odds = np.log((k + 0.5) / (bad + 1)) - np.log((m + 0.5) / (good + 1))
    weights[at] = np.where((ratio >= least_ratio) & (odds >= np.log(3)), odds, 0.0)
    return weights, bad, good


def score_task(shared):
    def run(batches):
        log_model, weights, a, b = shared.value
        restore = restorer(log_model)
        for part in textops.slices(batches, "text"):
            raw = raw_values(weights, *buckets_of(part.column("text"), restore), part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30))))], names=["doc_id", "score"])
    return run


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, sketch, toxic, weight) of the labelled texts: rows of one sketch share the weight of one."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = docs.select("doc_id", "text").mapInArrow(sketch_task, f"doc_id {kind}, sketch long")
    each = written(rows.groupBy("doc_id", "sketch").agg(F.count("*").alias("n")).join(known, "doc_id"), "labelled")
    sizes = each.groupBy("sketch").agg(F.sum("n").alias("size"))
    return each.join(sizes, "sketch").select("doc_id", "sketch", "toxic", F.round(F.lit(ONE) / F.col("size")).cast("long").alias("weight"))


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, least_ratio: float = 25.0) -> DataFrame:
    """(doc_id, score) of every row; ``learn`` says from which rows (by doc_id) labels may be used."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    log_model = trigram_model(docs.filter(learn))
    teaching = docs.filter(learn & F.col("doc_id").isNotNull())
    labelled = written(labelled_rows(teaching, labels), "weights")
    shared = spark.sparkContext.broadcast((log_model, bitmap_of(labelled.select(F.col("sketch").alias("seed")))))
    rows = teaching.mapInArrow(train_task(shared), f"doc_id {kind}, sketch long, buckets array<int>")
    train = written(rows.join(labelled, ["doc_id", "sketch"]).select("toxic", "weight", "buckets"), "train")
    weights, bad, good = feature_weights(train, least_ratio)
    if bad and good:
        bins = train.mapInArrow(bin_task(spark.sparkContext.broadcast(weights)), "bin long, toxic int, n long")
        bins = bins.groupBy("bin").agg(F.sum(F.col("toxic") * F.col("n")).alias("bad"), F.sum("n").alias("n")).toPandas()
        a, b = logistic(bins["bin"].to_numpy() / 10, bins["bad"].to_numpy(float) / ONE, (bins["n"] - bins["bad"]).to_numpy(float) / ONE)
    else:
        a, b = 0.0, float(np.log((bad + 1e-9) / (good + 1e-9))) if bad + good else -30.0
    final = spark.sparkContext.broadcast((log_model, weights, a, b))
    return docs.mapInArrow(score_task(final), f"doc_id {kind}, score double")


def held_out() -> Column:
    return F.coalesce(fold("doc_id", 5) == 0, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """Contract of op5: one row per document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(docs.select("doc_id", "text"), labels, ~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
