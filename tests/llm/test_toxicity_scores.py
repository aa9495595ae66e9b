"""Toxicity: decoding against enumeration, sums against plain Python, long texts, awkward rows, held-out recall."""

import itertools
import math
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from panelwatch.llm import textops, toxicity

WORDS = "sh it loser idiot ass bad stupid moron the a is".split()


@pytest.fixture(scope="module")
def model(spark):
    text = "you loser are an ass and a bad idiot that is shit stupid moron so bad a loser " * 40
    return toxicity.trigram_model(spark.createDataFrame([(text,)], "text string"))


def best_by_enumeration(span, log_model):
    options = []
    for choice in itertools.product(*toxicity.lattice(span), [(" ", 0.0)]):
        text, value, a, b = "", 0.0, 0, 0
        for letters, price in choice:
            value -= price
            for c in letters:
                s = 0 if c == " " else ord(c) - 96
                value += log_model[a, b, s]
                a, b = b, s
            text += letters
        options.append((value, text.strip()))
    return max(options)


@pytest.mark.parametrize("span", ["l053r", "sh17", "a$$", "b a d", "1d10t", "baaad", "s!t*", "4", "i-d.1", "m0r0n"])
def test_viterbi_is_the_best_path(model, span):
    value, _ = best_by_enumeration(span, model)
    found = toxicity.viterbi(span, model)
    same = [v for v, t in [best_by_enumeration(span, model)] if t == found]
    assert same or math.isclose(value, max(v for v, t in paths(span, model) if t == found), abs_tol=1e-9)


def paths(span, log_model):
    for choice in itertools.product(*toxicity.lattice(span), [(" ", 0.0)]):
        text, value, a, b = "", 0.0, 0, 0
        for letters, price in choice:
            value -= price
            for c in letters:
                s = 0 if c == " " else ord(c) - 96
                value += log_model[a, b, s]
                a, b = b, s
            text += letters
        yield value, text.strip()


def test_disguises_are_restored(model):
    READ_ASS = toxicity.viterbi("a$$", model)
    assert READ_ASS in ("as", "ass")  # which of the two is likelier is up to the corpus
    said = pa.array(["a l053r", "sh17 happens", "what a$$", "so b a d", "b.a.d!", "b4d", "plain words only", "ok!", "in 2024", None])
    got = toxicity.restorer(model)(said).to_pylist()
    assert got == ["loser", "shit", READ_ASS, "bad", "bad", "bad", "", "", "", ""]


def test_quick_look_misses_nothing():
    r = np.random.default_rng(4)
    texts = ["".join(r.choice(list("aab1$! .-é漢0Zz\n"), r.integers(0, 14))) for _ in range(6000)]
    flagged = toxicity.doubtful(pa.array(texts))
    assert not [t for t, f in zip(texts, flagged) if not f and any(toxicity.suspicious(t.lower()))]


@pytest.mark.parametrize("text", ["a1b," * 250_000, "a1b" * 330_000, "a b " * 250_000, "aaa" * 330_000], ids=["commas", "one_token", "spaced", "repeated"])
def test_a_megabyte_without_spaces(model, text):
    start = time.process_time()
    toxicity.restorer(model)(pa.array([text]))
    assert time.process_time() - start < 30


def test_sums_weigh_copies_once():
    texts = pa.array(["one two three four five six", "one two three four five six", "seven eight nine ten one two three", "", "x"])
    sketch = toxicity.sketches_of(*textops.word_hashes(texts))
    assert sketch[0] == sketch[1] and len(set(sketch.tolist())) == 4
    shared = " ".join(f"s{i}" for i in range(12))
    other = pa.array([shared + " " + " ".join(f"d{k}w{i}" for i in range(60)) for k in range(300)])
    assert len(set(toxicity.sketches_of(*textops.word_hashes(other)).tolist())) >= 285
    weights = np.zeros(1 << toxicity.BUCKET_BITS)
    weights[[3, 5]] = 1.5, 2.0
    row, bucket = toxicity.flat_buckets(pa.array([[3, 4], [], None, [3, 5]], pa.list_(pa.int32())).slice(1))
    assert toxicity.raw_values(weights, row, bucket, 3).tolist() == [0.0, 0.0, 3.5]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 0], pa.int32()), pa.array([4, 2]), pa.array([[7, 9], [9]], pa.list_(pa.int32()))], names=["toxic", "weight", "buckets"])
    sums = next(toxicity.sum_task([batch])).to_pylist()
    assert sums == [{"bucket": 7, "bad": 4, "n": 4}, {"bucket": 9, "bad": 4, "n": 6}]


def test_scores_equal_plain_python(spark, model):
    r = np.random.default_rng(8)
    plain = [f"{a}{b}" for a in "ba be bi bo".split() for b in "ma me ra re sa".split()]
    rows = []
    for i in range(300):
        words = list(r.choice(plain, 25))
        rows.append((i, " ".join(words + (["vile", "nasty"] if i % 5 == 0 else []))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, None, int(i % 5 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    learn = ~toxicity.held_out()
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(docs, labels, learn).collect()}
    train = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 0]
    bad, good = sum(i % 5 == 0 for i, _ in train), sum(i % 5 != 0 for i, _ in train)
    weights = {}
    for w in {w for _, t in train for w in t.split()}:
        k = sum(w in t.split() and i % 5 == 0 for i, t in train)
        m = sum(w in t.split() and i % 5 != 0 for i, t in train)
        share = (k + m) / (bad + good)
        term = lambda seen, expected: seen * math.log(seen / expected) if seen else 0.0
        ratio = 2 * (term(k, bad * share) + term(m, good * share) + term(bad - k, bad * (1 - share)) + term(good - m, good * (1 - share)))
        odds = math.log((k + 0.5) / (bad + 1)) - math.log((m + 0.5) / (good + 1))
        if k >= 3 and ratio >= 25 and odds >= math.log(3):
            weights[w] = odds
    assert set(weights) == {"vile", "nasty"}
    raw = {i: sum(weights.get(w, 0.0) for w in set(t.split())) for i, t in rows}
    tenth = {i: round(raw[i] * 10) / 10 for i, _ in train}
    values = sorted(set(tenth.values()))
    a, b = toxicity.logistic(np.array(values), np.array([sum(tenth[i] == v and i % 5 == 0 for i, _ in train) for v in values], float),
                             np.array([sum(tenth[i] == v and i % 5 != 0 for i, _ in train) for v in values], float))
    for i, _ in rows:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, a * raw[i] + b)))), abs=1e-6)


def test_awkward_and_empty(spark):
    rows = [(1, None, "s"), (None, "stupid text", "s"), (2, "", "s"), (2, "", "s"), (3, "x" * 50_000, "s")]
    docs = spark.createDataFrame([(*x, 1.0, 1, 2) for x in rows], "doc_id long, text string, sketch string, score double, toxic int, weight int")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (2, 0, 1), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, labels, ~toxicity.held_out()).collect()
    assert len(got) == 5 and all(0 <= x.score <= 1 for x in got)
    assert toxicity.score_toxicity(docs.limit(0), labels, ~toxicity.held_out()).count() == 0


def test_held_out_recall(spark, data):
    folder = data.replace("sf0.001", "sf0.1")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in toxicity.query(spark, folder).collect() if r.held_out and toxic.get(r.doc_id) is not None]
    found = [r.predicted for r in rows if toxic[r.doc_id] == 1]
    wrong = [r.predicted for r in rows if toxic[r.doc_id] == 0]
    print(len(found), sum(found), len(wrong), sum(wrong))
    # some toxic labels stand on texts without any sign of it (repeated clean lines, one repeated word)
    assert sum(found) >= 0.85 * len(found) and sum(wrong) <= 0.01 * len(wrong)
