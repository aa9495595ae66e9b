"""Each operator against a brute-force version on small tables, and on awkward rows."""

import collections
import hashlib
import json
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import check_queries
from panelwatch.llm import decontaminate, language, licenses, linededup, lmscore, neardup, packing, secrets, textops, topk, toxicity

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile("[0-9a-z\u0080-\U0010ffff]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").toPandas()


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, ties, clashing names."""
    base = "The quick brown fox jumps over the lazy dog again and again.\nSecond line of the very same text here.\nA third one.\nLast line of it."
    rows = [
        (1, base, "en", "a", 1), (1, base, "en", "a", 1), (None, base, "en", None, None), (None, None, None, None, None),
        (2, None, "en", "a", 1), (3, "", "en", "a", 0), (4, " \n\n ", None, "b", 3), (5, "x" * 60_000, "en", "b", 3),
        (6, ("mot de passe secret " * 4000).strip(), "fr", "b", 3), (7, "12345 ***", "fr", "b", 3), (8, base + " Extra.", "en", "c", 9),
        (9, "licensed under the MIT License\npassword = abcdef123", "en", "c", 9), (9, "password: xy", "en", "c", 9),
        (10, "漢字 é É \U0001f600 <|endoftext|> é", "zz", "c", 9),
    ]
    extra = "word string, key string, node string, band long, row string, removed string, `__source` string, `__lines` string"
    df = spark.createDataFrame([(*r, *["q", "k", "n", 1, "r", "x", "s", "l"]) for r in rows], f"{SCHEMA}, {extra}")
    return df.coalesce(2)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(n for n in entry_point.oracle_sql() if re.match(r"op\d+_|pipeline", n)))
def test_matches_sql(spark, data, name):
    line = check_queries.compare(spark, check_queries.connect(data), name, entry_point.queries()[name], entry_point.oracle_sql()[name], data)
    assert line.startswith("OK"), line


@pytest.mark.parametrize("spaces,pattern", [(False, WORD), (True, re.compile(r"[^\x20\x09-\x0D]+"))])
def test_word_hashes_name_words(spaces, pattern):
    r = np.random.default_rng(1)
    texts = [None, "", "  ", "a" * 40] + ["".join(r.choice(list("aAbZ09 \n.,-éßЖ漢😀\x7f\x0b"), r.integers(0, 60))) for _ in range(800)]
    hashes, counts = textops.word_hashes(pa.array(texts), spaces)
    want = [pattern.findall((t or "").translate(LOWER)) for t in texts]
    assert counts.tolist() == list(map(len, want))
    named = {}
    assert all(named.setdefault(w, h) == h for w, h in zip((w for x in want for w in x), hashes.tolist()))
    assert len(set(named.values())) == len(named)


# ---- 1 top-k


def test_top_k_with_ties_nulls_and_lengths(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(0, 0.2, 8)], "x") for i in range(300)]
    rows += [(300 + i, [0.5] * 8, "x") for i in range(40)] + [(340, None, "x"), (341, [float("nan")] * 8, "x"), (342, [None] * 8, "x"), (343, [], "x")]
    rows += [(344, [0.5] * 5, "x"), (0, rows[0][1], "x"), (None, [1.0] * 8, "x"), (350, [float("inf")] * 8, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, block_rows=64).collect()}
    whole = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q in (i for i in whole if i % 50 == 0):
        best = sorted(((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert {q for q, _ in got} == {i for i in whole if i % 50 == 0}


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top_k(df, F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(one, F.col("vec_id") % 50 == 0).count() == 0


# ---- 2 licences


def test_license_scan_rows(awkward, empty):
    rows = licenses.scan(awkward).collect()
    assert len(rows) == 14 and licenses.scan(empty).count() == 0
    for r in rows:
        w = words(r.text)
        assert r.n_words == len(w)
        base = sorted(x.start for x in r.findings if x.base)
        assert base == sorted(i for _, p in licenses.BASE for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
    assert rows[0].word == "q"


def test_license_notice_with_changed_words(spark):
    text = "x Permission is hereby granted, free of charge, to any human obtaining a copy of this software and associated documentation files"
    df = spark.createDataFrame([(1, text), (2, text.replace("granted", "refused"))], "doc_id long, text string")
    found = {r.doc_id: [f.label for f in r.findings] for r in licenses.scan(df, min_cover=0.5).collect()}
    assert found == {1: ["mit-notice"], 2: []}


# ---- 3 lines


def brute_lines(rows):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    places = collections.defaultdict(list)
    cut = {}
    for doc_id, text in set(rows):
        if text is None:
            continue
        chunks, now, before = [], [], ""
        lines = text.split("\n")
        for i, line in enumerate(lines):
            now.append(line)
            if md5(before + md5(line))[-1] in "048c" or i == len(lines) - 1:
                chunks.append(now)
                now = []
            before = md5(line)
        cut[doc_id, text] = chunks
        for no, c in enumerate(chunks):
            if sum(bool(x.strip(" ")) for x in c) >= 2:
                places["\n".join(c)].append((doc_id is not None, doc_id or 0, md5(text), no, (doc_id, text)))
    gone = collections.defaultdict(set)
    for p in places.values():
        for x in sorted(p, key=lambda x: x[:4])[1:]:
            gone[x[4]].add(x[3])
    return {k: "\n".join("\n".join(c) for i, c in enumerate(v) if i not in gone[k]) for k, v in cut.items()}


def test_line_dedup_rows(awkward, empty):
    rows = awkward.select("doc_id", "text").collect()
    want = brute_lines([tuple(r) for r in rows])
    got = linededup.dedup_lines(awkward)
    assert set(awkward.columns) < set(got.columns) and linededup.dedup_lines(empty).count() == 0
    key = lambda x: repr(x)
    assert sorted(((r.doc_id, r.text, r["__source"]) for r in got.collect()), key=key) == sorted(
        ((r.doc_id, want.get((r.doc_id, r.text)), "s") for r in rows), key=key)


def test_shared_lines_go_once(spark):
    shared = "\n".join(f"shared line number {i} of the passage" for i in range(40))
    df = spark.createDataFrame([(i, f"own head {i} of text\n{shared}\nown tail {i} of text") for i in range(5)], "doc_id long, text string")
    rows = {r.doc_id: r for r in linededup.dedup_lines(df).collect()}
    assert rows[0].n_removed == 0
    assert all(rows[i].n_removed > 25 and f"own head {i}" in rows[i].text and f"own tail {i}" in rows[i].text for i in range(1, 5))


# ---- 4 packing


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    want = collections.Counter()
    for doc_id, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k:k + 2048], "<u4")
            want[doc_id, k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for s in by_sequence.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 2048
    return len(by_sequence), -(-sum(r.length for r in rows) // 2048)


def test_packing_of_documents(spark, data, documents):
    made, least = check_packing(packing.query(spark, data).collect(), list(zip(documents.doc_id, documents.text)))
    assert made <= least * 1.02 + 1


def test_packing_rows_and_shards(spark, awkward, empty):
    texts = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    check_packing(packing.pack_documents(awkward).collect(), texts)
    assert packing.pack_documents(empty).count() == 0
    from panelwatch.llm.common import written

    pieces = written(packing.token_pieces(awkward.union(awkward).union(awkward), with_ids=True), "pieces")
    placed = packing.pack(pieces, shard_rows=4)
    check_packing(placed.collect(), texts * 3)
    sizes = {r.sequence_id: len(r.ids) for r in packing.sequences(placed).collect()}
    assert sizes == {r.sequence_id: 4 * r.n for r in placed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()}


def test_word_ids_start_anew():
    small = packing.WordIds(packing.vocabulary_path(), cache_words=3)
    texts = pa.array(["one two, three. four", "five six", None, "one É é don't <|endoftext|>"])
    for _ in range(3):
        got = small.encode(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [
            small.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]


# ---- 5 toxicity


def test_restored_words(spark, data):
    model = toxicity.trigram_model(spark.createDataFrame([("the stupid idiot is a pathetic loser and a moron " * 30,)], "text string"))
    said = pa.array(["you 1d10t", "i d i o t", "so stuuuupid", "p@thetic l0ser", None, "", "nothing here"])
    assert toxicity.restorer(model)(said).to_pylist() == ["idiot", "idiot", "stupid", "pathetic loser", "", "", ""]


def test_toxicity_finds_held_out_words(spark):
    r = np.random.default_rng(5)
    common = [f"{a}{b}" for a in "ba be bi bo da de di do".split() for b in "ma me ra re sa".split()]
    rows, labels = [], []
    for i in range(400):
        text = " ".join(r.choice(common, 30))
        toxic = i % 4 == 0
        if toxic:
            text += " " + ("stup1d" if i % 8 == 0 and i > 200 else "stupid") + " " + text[:10]
        rows.append((i, text))
        labels.append((i, None, int(toxic)))
    docs = spark.createDataFrame(rows + [(None, None), (900, ""), (5, "more")], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scores = collections.defaultdict(list)
    for x in toxicity.score_toxicity(docs, known, ~toxicity.held_out()).collect():
        scores[x.doc_id].append(x.score)
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0 and i != 5]
    assert all((scores[i][0] >= 0.5) == (i % 4 == 0) for i in held) and len(scores[5]) == 2
    nothing = toxicity.score_toxicity(docs, known.limit(0), ~toxicity.held_out()).collect()
    assert len(nothing) == 403 and all(x.score < 0.01 for x in nothing)


# ---- 6 secrets


def brute_base(text):
    out = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


def test_secret_scan(spark, data, documents):
    rows = {r.doc_id: r for r in secrets.query(spark, data).collect()}
    assert len(rows) == len(documents)
    for doc_id, text in zip(documents.doc_id, documents.text):
        base = brute_base(text)
        line = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert rows[doc_id].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [rows[doc_id][f"n_{k}"] for k in secrets.KINDS] == [sum(b[1] == i for b in base) for i in range(3)]


def test_network_learns_keys(spark, awkward, empty):
    r = np.random.default_rng(3)
    key = lambda: "".join(r.choice(list("0123456789abcdef"), 40))
    word = lambda: "".join(r.choice(list("abcdefghiklmnoprstu"), r.integers(3, 12)))
    rows = [(i, " ".join([word() for _ in range(60)] + [f'token = "{key()}"'] + [f"mailbox{i}@example.com"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    network = secrets.fit(docs, sample=600)
    hidden = "here ghp9A8b7C6d5E4f3A2b1C0d9E8f7A6b5C4d3 and 日本語 then " + word() + "2024" + word() + "end"
    found = secrets.find_secrets(spark.createDataFrame([(1, hidden)], "doc_id long, text string"), network).first().findings
    assert all(f.kind == "model" and hidden[f.start:f.end].startswith("ghp") for f in found)
    assert [len(x.findings) for x in secrets.find_secrets(awkward, secrets.fit(awkward)).collect() if x.doc_id == 9] == [1, 0]
    assert secrets.find_secrets(empty, secrets.fit(empty)).count() == 0


# ---- 7 language


def test_language_held_out_accuracy(spark, data, documents):
    rows = language.query(spark, data).toPandas().merge(documents[["doc_id", "lang"]], on="doc_id")
    held = rows[rows.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and not rows.rejected.any() and rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()


def test_kneser_ney_sums_to_one():
    counts = np.random.default_rng(0).poisson(0.02, 64 ** 3)
    logs, backoff, pairs = language.kneser_ney(counts)
    assert np.allclose(np.exp(logs).reshape(64, 64, 64).sum(2), 1) and np.allclose(np.exp(pairs).reshape(64, 64).sum(1), 1)


def test_language_rows(awkward, empty):
    model = language.fit(awkward, ~language.held_out())
    rows = language.identify(awkward, model, ["doc_id", "text", "word"]).collect()
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    none = language.fit(empty, ~language.held_out())
    assert {r.lang_pred for r in language.identify(awkward, none, ["doc_id"]).collect()} == {"und"}
    assert language.stage(None or awkward.sparkSession, empty, "").count() == 0


# ---- 8 decontamination


def test_leaks_with_changed_words(spark, awkward, empty):
    r = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [" ".join(r.choice(vocabulary, 30)) for _ in range(20)]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(77, items[3]), (78, None), (79, "")], "item_id long, text string")
    rows, want = [], set()
    for i in range(60):
        passage = items[i % 20].split()
        if i % 3 == 1:
            passage[7] = passage[16] = passage[25] = "other"
        if i % 3 == 2:
            passage = list(r.choice(vocabulary, 30))
        else:
            want |= {(i, i % 20)} | ({(i, 77)} if i % 20 == 3 else set())
        rows.append((i, " ".join(r.choice(vocabulary, 50)) + " " + " ".join(passage).upper() + ". " + " ".join(r.choice(vocabulary, 20))))
    docs = spark.createDataFrame(rows + [(None, None), (70, ""), (71, items[0].split()[0])], "doc_id long, text string")
    found = decontaminate.find_leaks(docs, benchmark).collect()
    assert {(x.doc_id, x.item_id) for x in found} == want
    assert decontaminate.find_leaks(awkward, benchmark).count() == 0 and decontaminate.find_leaks(empty, benchmark).count() == 0
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0


# ---- 9 near duplicates


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = rows[i][1] is not None and rows[i][1] == rows[j][1]
            if same or (a & b and len(a & b) >= 0.8 * len(a | b)):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


def test_near_duplicate_classes(spark, data, documents):
    rows = sorted(zip(documents.doc_id, documents.text))
    want = {rows[i][0]: rows[c][0] for i, c in enumerate(brute_classes(rows))}
    assert {r.doc_id: r.class_id for r in neardup.query(spark, data).collect()} == want


def test_many_variants_of_one_text(spark):
    r = np.random.default_rng(4)
    base = [f"v{i}" for i in r.integers(0, 10_000, 200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        own = list(base)
        for k in r.choice(200, 3, replace=False):
            own[k] = f"new{i}x{k}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes, _ = neardup.classify(docs)
    assert {x.class_id for x in classes.collect()} == {0}


def test_near_duplicate_rows(spark, awkward, empty):
    classes, heads = neardup.classify(awkward)
    assert classes.count() == 14
    stay = neardup.stage(spark, awkward, "").collect()
    texts = [r.text for r in stay]
    assert len([t for t in texts if t is not None]) == len({t for t in texts if t is not None}) and texts.count(None) == 2
    assert neardup.stage(spark, empty, "").count() == 0


def test_probability_jaccard_and_signatures():
    x, y = np.array([0.5, 0.3, 0.2, 0.0]), np.array([0.2, 0.3, 0.1, 0.4])
    slow = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in range(4)) for i in range(4) if x[i] and y[i])
    assert neardup.probability_jaccard(x, y) == pytest.approx(slow)
    grams = np.arange(1, 5, dtype=np.uint64) * np.uint64(77777)
    m = 20_000
    a = neardup.prob_minhash(np.zeros(3, int), grams[:3], x[:3], 1, m)
    b = neardup.prob_minhash(np.zeros(4, int), grams, y, 1, m)
    assert (a == b).mean() == pytest.approx(slow, abs=0.02)


# ---- 10 language-model scores


def test_scores_of_documents(spark, data, documents):
    got = {r.doc_id: r for r in lmscore.query(spark, data).collect()}
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)) + [None] for i, t in zip(documents.doc_id, documents.text)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in split}
    counts = collections.Counter(w for i, ws in split.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in split.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(counts[w] > 0 for w in ws), n, held[i])
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    of = lambda column: sum(got[i][column] for i in got if held[i])
    assert of("score") > of("base_score")


def test_score_rows(awkward, empty):
    rows = lmscore.score_texts(awkward, ~lmscore.held_out()).collect()
    assert len(rows) == 14 and all(r.score <= 0 and r.base_score < 0 for r in rows)
    assert sorted(r.n_tokens for r in rows if r.doc_id in (2, 3, 4)) == [1, 1, 1]
    assert lmscore.score_texts(empty, ~lmscore.held_out()).count() == 0
    untrained = lmscore.score_texts(awkward, F.lit(False)).collect()
    assert all(r.score == 0 and r.base_score == 0 for r in untrained)


def test_filter_reads_back_counts(spark):
    n = np.array([1, 2, 3, 8, 1000, 70_000])
    grams = spark.createDataFrame([(int(i) * 999, int(c), False) for i, c in enumerate(n)], "token long, n long, pair boolean")
    model = lmscore.Model(lmscore.build_filter(grams, 200, (1.0, 1.0)), (1.0, 1.0), 1.0, 0.1, np.zeros(0, np.uint64))
    read = lmscore.counts_from(model, np.arange(len(n)).astype(np.uint64) * np.uint64(999), False)
    assert ((read >= n / 1.5) & (read <= n * 1.5)).all()
    assert (lmscore.counts_from(model, np.arange(5000, 6000, dtype=np.uint64), False) > 0).mean() < 0.02


# ---- pipeline


def test_pipeline_against_brute_force(spark, data, documents):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "packing"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = corpus_pipeline.run(spark, data).collect()
    kept = [(i, t) for i, t in zip(documents.doc_id, documents.text) if any(c.isalpha() for c in t)]
    cut = brute_lines(kept)
    kept = sorted((i, cut[i, t]) for i, t in kept)
    classes = brute_classes(kept)
    kept = [kept[i] for i in sorted(set(classes))]
    items = [words(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]

    def leaks(text):
        w = words(text)
        index = collections.defaultdict(list)
        for i, x in enumerate(w):
            index[x].append(i)
        for item in items:
            lines = collections.Counter(p - k for k, x in enumerate(item) for p in index[x])
            for d, n in lines.items():
                if n >= 7:
                    equal = np.array([0 <= k + d < len(w) and w[k + d] == x for k, x in enumerate(item)])
                    s, e = decontaminate.best_run(equal)
                    if e - s >= min(8, len(item)) and equal[s:e].sum() >= 0.8 * (e - s):
                        return True
        return False
    kept = [(i, t) for i, t in kept if not leaks(t)]
    made, least = check_packing(rows, kept)
    assert made <= least * 1.03 + 1
    stage = dict(corpus_pipeline.STAGES)["decontamination"]
    assert stage(spark, docs, data).columns == docs.columns
    json.dumps([made, least])
