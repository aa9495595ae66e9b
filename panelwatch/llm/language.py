"""Language identification by interpolated Kneser-Ney character models (operator 7).

Fitting: trigram counts of letters per language are summed by Spark over all training texts; one task emits each
(language, trigram) at most once per slice of text, so a hot source or language only adds to sums. The counts of a
language have at most 64^3 entries whatever the corpus (letters fall into 64 classes), so the model is at most
4 MB a language and can be collected and broadcast.

Prediction: the language whose model gives the lowest cross-entropy per symbol. A text is rejected if even that
cross-entropy is far above what the language's training texts show, with room for the chance spread of short texts.
The limit is set on all training texts so that at most ``reject_share`` of them lie beyond it.

Defined results: null texts and texts without a letter get ``und``, score 0 and rejected; languages null or rows
whose fold is held out are not learned; without any training row every text is ``und``; ties go to the language
first in text order; repeated rows count as often as they occur; further columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwatch.llm import textops
from panelwatch.llm.common import added, fold, fresh

CLASSES = 64
RESULTS = ["lang_pred", "score", "cross_entropy", "rejected"]
UNKNOWN = "und"
#: Bins of a tenth for how far a training text lies above its language's mean, in standard deviations.
FAR_BINS = 4000
#: Added to the standard deviation of a text's mean, in nats: texts of one language differ in topic, not only by chance.
ALLOWANCE = 0.12


@dataclass
class Model:
    langs: list[str]
    keys: np.ndarray  # sorted hashes of the trigrams that any language has
    logs: np.ndarray  # (trigram, language): log probability
    backoff: np.ndarray  # (context pair, language): log weight of the shorter model
    pairs: np.ndarray  # (pair, language): log probability of the shorter model
    mean: np.ndarray  # per language: cross-entropy per symbol on its own training texts
    spread: np.ndarray  # and its standard deviation per symbol
    limit: float = float("inf")  # largest accepted distance in standard deviations


def kept_trigrams(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram code at each position and whether it counts: word starts have an empty context, gaps count once."""
    s = letters.astype(np.int32)
    before = np.concatenate([[0], s[:-1]])
    second = np.concatenate([[0, 0], s[:-2]])[:len(s)]
    second[before == 0] = 0
    return (second * CLASSES + before) * CLASSES + s, (s != 0) | (before != 0)


def count_task(batches):
    for part in textops.slices(batches, "text"):
        langs = np.array(part.column("lang").to_pylist(), dtype=object)
        texts = part.column("text").to_pylist()
        for lang in sorted(set(langs)):
            letters, _ = textops.letter_stream([texts[i] for i in np.flatnonzero(langs == lang)])
            codes, keep = kept_trigrams(letters)
            counts = np.bincount(codes[keep], minlength=1)
            present = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(present), pa.string()), pa.array(present, pa.int32()), pa.array(counts[present], pa.int64())],
                names=["lang", "code", "n"])


def kneser_ney(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probabilities of all 64^3 trigrams, log backoff weights and log probabilities of the pairs."""
    c = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
    seen = c > 0
    ones, twos = (c == 1).sum(), (c == 2).sum()
    d3 = ones / (ones + 2 * twos) if ones and twos else 0.5
    before = seen.sum(0).astype(float)  # different letters before each pair
    ones, twos = (before == 1).sum(), (before == 2).sum()
    d2 = ones / (ones + 2 * twos) if ones and twos else 0.5
    total = before.sum()
    single = (before.sum(0) + 0.5) / (total + 0.5 * CLASSES) if total else np.full(CLASSES, 1 / CLASSES)
    row = before.sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        pair = np.where(row > 0, (np.maximum(before - d2, 0) + d2 * (before > 0).sum(1, keepdims=True) * single) / row, single)
        context = c.sum(2, keepdims=True)
        weight = np.where(context > 0, d3 * seen.sum(2, keepdims=True) / context, 1.0)
        three = np.where(context > 0, np.maximum(c - d3, 0) / context, 0) + weight * pair[None]
    tiny = 1e-12
    return np.log(np.maximum(three, tiny)).ravel(), np.log(np.maximum(weight, tiny)).ravel(), np.log(np.maximum(pair, tiny)).ravel()


def fit_counts(rows) -> Model:
    """The model from (lang, code, n) rows."""
    langs = sorted({r.lang for r in rows})
    if not langs:
        none = np.zeros((0, 0), np.float32)
        return Model([], np.zeros(0, np.uint64), none, none, none, np.zeros(0), np.zeros(0))
    at = {lang: i for i, lang in enumerate(langs)}
    table = np.zeros((len(langs), CLASSES ** 3), np.int64)
    for r in rows:
        table[at[r.lang], r.code] = r.n
    fitted = [kneser_ney(t) for t in table]
    codes = np.flatnonzero(table.any(0))
    keys = textops.mix(codes.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    logs = np.array([f[0] for f in fitted]).reshape(len(langs), -1).T
    mean = np.array([-(t * f[0]).sum() / max(1, t.sum()) for t, f in zip(table, fitted)])
    square = np.array([(t * f[0] ** 2).sum() / max(1, t.sum()) for t, f in zip(table, fitted)])
    return Model(langs, keys[order], logs[codes[order]].astype(np.float32),
                 np.array([f[1] for f in fitted]).reshape(len(langs), -1).T.astype(np.float32),
                 np.array([f[2] for f in fitted]).reshape(len(langs), -1).T.astype(np.float32),
                 mean, np.sqrt(np.maximum(square - mean ** 2, 1e-6)))


def cross_entropies(model: Model, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text and language the cross-entropy per symbol; symbols per text; has a letter."""
    letters, begins = textops.letter_stream(texts)
    codes, keep = kept_trigrams(letters)
    present = np.flatnonzero(np.bincount(codes[keep], minlength=1))
    hashes = textops.mix(present.astype(np.uint64) + np.uint64(1))
    spot = np.minimum(np.searchsorted(model.keys, hashes), max(0, len(model.keys) - 1))
    known = model.keys[spot] == hashes if len(model.keys) else np.zeros(len(present), bool)
    looked = model.backoff[present // CLASSES] + model.pairs[present % CLASSES ** 2]
    looked[known] = model.logs[spot[known]]
    place = np.zeros(CLASSES ** 3, np.int32)
    place[present] = np.arange(len(present))
    place = place[codes]
    n = np.add.reduceat(keep.astype(np.int64), begins[:-1])
    out = np.zeros((len(texts), len(model.langs)))
    for i in range(len(model.langs)):
        value = looked[:, i].astype(np.float64)[place] if len(present) else np.zeros(len(codes))
        value[~keep] = 0
        out[:, i] = -np.add.reduceat(value, begins[:-1])
    return out / np.maximum(n, 1)[:, None], n, np.add.reduceat((letters > 0).astype(np.int64), begins[:-1]) > 0


def distance(model: Model, ce: np.ndarray, n: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """How many standard deviations a text of n symbols lies above its language's mean."""
    return (ce - model.mean[lang]) / (model.spread[lang] / np.sqrt(np.maximum(n, 1)) + ALLOWANCE)


def distance_task(shared):
    def run(batches):
        model, total = shared.value, np.zeros(FAR_BINS, np.int64)
        for part in textops.slices(batches, "text"):
            at = {lang: i for i, lang in enumerate(model.langs)}
            ce, n, lettered = cross_entropies(model, part.column("text").to_pylist())
            own = np.array([at[x] for x in part.column("lang").to_pylist()])
            far = distance(model, ce[np.arange(len(own)), own], n, own)[lettered]
            total += np.bincount(np.clip(far * 10, 0, FAR_BINS - 1).astype(int), minlength=FAR_BINS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], names=["bin", "n"])
    return run


def predict_task(shared, columns, results):
    def run(batches):
        model = shared.value
        for part in textops.slices(batches, columns[0]):
            texts = part.column(columns[0]).to_pylist()
            if model.langs:
                ce, n, lettered = cross_entropies(model, texts)
                best = ce.argmin(1)
                like = -(ce - ce.min(1, keepdims=True)) * np.sqrt(np.maximum(n, 1))[:, None]
                share = np.exp(like)
                score = np.where(lettered, share.max(1) / share.sum(1), 0.0)
                rows = np.arange(len(texts))
                entropy = ce[rows, best]
                rejected = ~lettered | (distance(model, entropy, n, best) > model.limit)
                named = [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
            else:
                named, score, entropy = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                rejected = np.ones(len(texts), bool)
            kept = [part.column(c) for c in columns[1:]]
            yield pa.RecordBatch.from_arrays(
                kept + [pa.array(named, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*columns[1:], *results])
    return run


def fit(docs: DataFrame, learn: Column, reject_share: float = 1e-4, least_limit: float = 8.0) -> Model:
    """Fit on the rows of ``docs`` (text, lang) where ``learn`` holds and the language is known."""
    train = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counted = train.mapInArrow(count_task, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    model = fit_counts(counted.collect())  # at most 64^3 rows a language
    if not model.langs:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    far = train.mapInArrow(distance_task(shared), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    total, beyond = sum(r.n for r in far), 0
    for r in sorted(far, key=lambda r: -r.bin):
        beyond += r.n
        if beyond > reject_share * total:
            model.limit = max(least_limit, (r.bin + 1) / 10)
            break
    return model


def identify(docs: DataFrame, model: Model, keep: list[str], results: list[str] | None = None) -> DataFrame:
    """``keep`` columns of all rows with lang_pred, score, cross_entropy and rejected.

    ``results`` names these four; by default a name that is kept already gets ``_new`` at its end.
    """
    results = results or [added(docs.select(*keep), c) for c in RESULTS]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = fresh(docs, "text")
    schema = docs.select(*keep).schema
    for name, kind in zip(results, ("string", "double", "double", "boolean")):
        schema = schema.add(name, kind)
    return docs.select(F.col("text").alias(text), *keep).mapInArrow(predict_task(shared, [text, *keep], results), schema)


def held_out() -> Column:
    return F.coalesce(fold("doc_id", 4) == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """Contract of op7: one row per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs, ~held_out())
    return identify(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not rejected, unchanged."""
    columns = docs.columns
    model = fit(docs, ~held_out())
    results = [fresh(docs, c) for c in RESULTS]
    return identify(docs, model, columns, results).filter(~F.col(results[-1])).select(*columns)
