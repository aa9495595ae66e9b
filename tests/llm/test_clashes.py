"""Every result name as an extra column, maps and nulls, through all operators and the pipeline; the pipeline without rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelwatch.llm import decontaminate, divergence, language, licenses, linededup, lmscore, neardup, packing, secrets, topk, toxicity
from panelwatch.session import scratch_path

NAMES = ("n_lines n_removed n_words findings lang_pred score cross_entropy rejected class_id kept node row root band bands query_id vec_id rank "
         "held_out predicted toxic sketch weight buckets n_assign spans base_sha256 n_tokens n_known train_tokens base_score token pair item_id "
         "n_equal first_word end_word source_key removed piece start length ids_crc32 sequence_id offset key seed sources term idx part item value "
         "label quality text_new n_lines_new score_new").split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    base = "\n".join(f"A line of words number {k} that stands in several texts of this table" for k in range(6))
    rows = [(1, base, "en", "a", 1), (1, base, "en", "a", 1), (2, base + "\nOne more line at the very end of it.", "en", "b", None),
            (3, "Das ist ein deutscher Satz, der hier nur einmal steht und keine Kopie hat.", "de", "b", 5), (4, None, "en", "a", None),
            (5, "", None, None, 0), (None, "Nobody knows the number of this text but it is there all the same.", "en", None, 7),
            (6, "MIT license\npassword = abcdef123456", "en", "c", 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    number = F.monotonically_increasing_id()
    own = [F.concat(F.lit(f"{c}:"), F.coalesce("doc_id", F.lit(-1)).cast("string")).alias(c) for c in NAMES]
    return df.repartition(2).select("*", *own, F.create_map(F.lit("k"), (number * 0).cast("string")).alias("a_map"), F.lit(dt.date(2024, 1, 1)).alias("a date"))


def own_columns(df):
    return {(r.doc_id, c): r[c] for r in df.collect() for c in NAMES if c in r.__fields__}


def unchanged(df):
    return all(v == f"{c}:{-1 if i is None else i}" for (i, c), v in own_columns(df).items())


def test_operators_leave_them_alone(spark, documents):
    assert unchanged(licenses.scan(documents)) and {"n_words_new", "findings_new"} <= set(licenses.scan(documents).columns)
    out = linededup.dedup_lines(documents)
    assert unchanged(out) and {"n_lines_new_new", "n_removed_new"} <= set(out.columns)
    model = language.fit(documents, F.lit(True))
    out = language.identify(documents, model, documents.columns)
    assert unchanged(out) and {"lang_pred_new", "score_new_new", "cross_entropy_new", "rejected_new"} <= set(out.columns) and out.count() == 8
    assert language.stage(spark, documents, "").columns == documents.columns
    assert secrets.find_secrets(documents, None).count() == lmscore.score_texts(documents, ~lmscore.held_out()).count() == 8
    labels = documents.select("doc_id", F.lit(1).alias("quality"), F.lit(1).alias("toxic"))
    assert toxicity.score_toxicity(documents, labels, ~toxicity.held_out()).count() == 8
    assert neardup.classify(documents)[0].count() == 8
    assert {tuple(r) for r in divergence.audit(documents).select("part").distinct().collect()} == {("pair",)}
    vectors = documents.select(F.coalesce("doc_id", F.lit(0)).alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), *[c for c in NAMES if c != "vec_id"])
    assert topk.top_k(vectors, F.col("vec_id") == 0, 2).select("vec_id", "score").collect() == [(1, 327680), (2, 327680)]


@pytest.mark.parametrize("module", [linededup, neardup, language], ids=lambda m: m.__name__.rsplit(".")[-1])
def test_stages_leave_them_alone(spark, documents, module):
    out = module.stage(spark, documents, "")
    assert out.columns == documents.columns and unchanged(out)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, None)], "item_id long, text string")


def folder_of(spark, documents, benchmark):
    path = scratch_path(spark, "pipeline-test")
    documents.write.parquet(f"{path}/documents.parquet")
    benchmark.write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_with_clashing_columns(spark, documents, benchmark):
    path = folder_of(spark, documents, benchmark)
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in rows} <= {1, 2, 3, 4, 5, 6, None} and sum(r.doc_id == 1 for r in rows) == 1
    leaks = decontaminate.stage(spark, documents, path)
    assert leaks.columns == documents.columns and leaks.count() == 8 and unchanged(leaks)


def test_pipeline_without_rows(spark, documents, benchmark):
    path = folder_of(spark, documents.limit(0), benchmark)
    assert corpus_pipeline.run(spark, path).count() == 0
    assert packing.stage(spark, documents.limit(0), path).count() == 0


LARGE = [2.0 ** 20, 2.0 ** 22, -(2.0 ** 21), 1e300, -1e300, 3.5, 2.0 ** 53]


def test_large_components_are_exact(spark):
    rows = [(0, [2.0 ** 20, 2.0 ** 21]), (1, [2.0 ** 20, 0.0]), (2, [2.0 ** 20, 2.0 ** 20]), (3, [2.0 ** 22, 2.0 ** 21]), (4, [-1.0, 0.001])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 4).orderBy("rank").collect()
    whole = {i: [int(x * 256 // 1) for x in v] for i, v in rows}
    want = sorted(((-sum(a * b for a, b in zip(whole[0], whole[i])), i) for i in range(1, 5)))
    assert [(r.vec_id, r.score) for r in got] == [(i, -s) for s, i in want]


def test_components_beyond_a_long(spark):
    rows = [(0, LARGE), (1, LARGE), (2, [-x for x in LARGE]), (3, [0.0] * 7), (4, [1.0] + [0.0] * 6)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 4).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 4, 3, 2] and got[0].score == topk.LARGEST and got[-1].score == -topk.LARGEST


def test_close_scores_of_large_vectors(spark):
    big = float(2 ** 22)
    rows = [(0, [big, 1.0])] + [(i, [big, i / 256]) for i in range(1, 40)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 3, block_rows=8).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [39, 38, 37]
