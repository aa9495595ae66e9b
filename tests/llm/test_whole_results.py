"""Large groups and awkward passages against brute force that shares no step with the operators."""

import numpy as np
import pytest

from panelwatch.llm import decontaminate, neardup


def variants(count, changes, seed):
    """A text of 200 words and variants of it with a few random words changed, ``changes(i)`` each."""
    r = np.random.default_rng(seed)
    base = [f"v{i}" for i in r.integers(0, 10_000, 200)]
    rows = []
    for i in range(count):
        own = list(base)
        for k in r.choice(200, changes(i), replace=False):
            own[k] = f"new{i}x{k}"
        rows.append((i, " ".join(own)))
    return rows


def linked_classes(rows, threshold=0.8):
    """Smallest row of each row's class, over all pairs."""
    sets = [{tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    known = {g: n for n, g in enumerate(sorted(set().union(*sets)))}
    grid = np.zeros((len(rows), len(known)), np.float32)
    for i, s in enumerate(sets):
        grid[i, [known[g] for g in s]] = 1
    both, size = grid @ grid.T, grid.sum(1)
    near = both >= threshold * (size[:, None] + size - both) - 1e-6
    label = np.arange(len(rows))
    while True:
        lower = np.where(near, label[None], len(rows)).min(1)
        if (lower == label).all():
            return {rows[i][0]: rows[c][0] for i, c in enumerate(label)}
        label = lower


@pytest.mark.parametrize("changes", [lambda i: 3, lambda i: 2 + 2 * (i % 2)], ids=["three", "two_or_four"])
def test_large_group_close_to_the_threshold(spark, changes):
    rows = variants(1200, changes, 11)
    classes, _ = neardup.classify(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {x.doc_id: x.class_id for x in classes.collect()} == linked_classes(rows)


def test_twins_that_repeat_a_passage(spark):
    rows, twins = [], 40
    for i in range(twins):
        own = [f"d{i}w{k}" for k in range(300)]
        loop = " ".join(own[:24])
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*[loop] * 100, *own[24:]]))]
    classes, _ = neardup.classify(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {x.doc_id: x.class_id for x in classes.collect()} == {d: d - d % 2 for d, _ in rows}


def test_signatures_of_counts_and_of_plain_sets(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(0, text), (1, f"{text} {' '.join(text.split()[:12] * 50)}"), (2, None), (3, "")]
    bands = {x.doc_id: x.bands for x in neardup.signatures(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert bands[0][:neardup.BANDS] == bands[0][neardup.BANDS:] and bands[1][:neardup.BANDS] != bands[1][neardup.BANDS:]
    assert bands[3] == [] and 2 not in bands


def test_every_run_of_a_diagonal():
    r = np.random.default_rng(5)
    for _ in range(1500):
        equal, need = r.random(r.integers(1, 40)) < r.choice([0.5, 0.7, 0.85]), int(r.integers(5, 9))
        runs = [(int(equal[s:e].sum()), -s) for s in range(len(equal)) for e in range(s + need, len(equal) + 1)
                if 5 * equal[s:e].sum() >= 4 * (e - s)]
        run = decontaminate.longest_run(equal, need, 0.8)
        assert (run is None) == (not runs)
        if run:
            share = equal[slice(*run)]
            assert share.sum() == max(runs)[0] and len(share) >= need and 5 * share.sum() >= 4 * len(share)


def test_verbatim_part_of_a_changed_item(spark):
    item = [f"i{k}" for k in range(49)]
    changed = [w if k < 10 or 14 <= k < 23 or 27 <= k < 36 or k >= 40 else f"o{k}" for k, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(changed)), (2, " ".join(item[:10])), (3, " ".join(item[:4]))], "doc_id long, text string")
    found = decontaminate.find_leaks(docs, spark.createDataFrame([(5, " ".join(item))], "item_id long, item_text string").withColumnRenamed("item_text", "text")).collect()
    assert {x.doc_id for x in found} == {1, 2}
    assert all(x.n_equal >= 0.8 * (x.end_word - x.first_word) for x in found)


def test_no_pair_is_left_out_of_the_score(spark):
    """rare tokens and pairs are in the model with their exact counts; common pairs come from the filter."""
    import collections
    import math

    from pyspark.sql import functions as F

    from panelwatch.llm import lmscore
    texts = ["a b a c", "a b", "rare words stand here", "rare words stand here", "a b unseen", ""]
    held = [4]
    split = [[None, *t.split(), None] for t in texts]
    one = collections.Counter(w for i, ws in enumerate(split) if i not in held for w in ws[1:])
    two = collections.Counter(p for i, ws in enumerate(split) if i not in held for p in zip(ws, ws[1:]))
    n, v = sum(one.values()), len(one)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for share in (1.0, 0.1):  # all pairs by the join; then those of frequent tokens from the filter, with quantised counts
        got = {r.doc_id: r.score for r in lmscore.score_texts(docs, ~F.col("doc_id").isin(held), frequent=0.1, pair_token=share, strength=5.0).collect()}
        for i, ws in enumerate(split):
            after = {w: 5 + max(0, c - 0.1 * n) / 2 for w, c in one.items()}
            want = sum(math.log10((two[p] + after.get(p[0], 5) * (one[p[1]] + 0.5) / (n + 0.5 * (v + 1))) / (one[p[0]] + after.get(p[0], 5))) for p in zip(ws, ws[1:]))
            assert abs(got[i] - want) < (1e-9 if share == 1.0 else 0.5), (share, i, got[i], want)


def test_scores_move_less_than_the_disk_budget(spark):
    """op10 (check finding on disk): pairs travel once and packed; the scores are those of brute force for every kind of pair."""
    import collections
    import math
    import os

    from pyspark.sql import functions as F

    from panelwatch.llm import lmscore
    from panelwatch.session import drop_scratch, scratch_mark, shared_dir
    r = np.random.default_rng(3)
    words = [f"w{k:04d}" for k in range(5000)]
    texts = [" ".join(r.choice(words, 4000)) + " often" * 900 for _ in range(48)]
    texts += [texts[0], "never learned " * 50, "never learned", "", "w0001  W0002"]
    held = {3, 17, 49, 50, 52}
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string").repartition(5).localCheckpoint()

    def files():
        places = [*spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString(), shared_dir(spark)]
        return {f"{d}/{x}": os.path.getsize(f"{d}/{x}") for p in places for d, _, names in os.walk(p.removeprefix("file:")) for x in names if "shuffle_" in x or "part-" in x}

    was, mark = files(), scratch_mark(spark)
    got = lmscore.score_texts(docs, ~F.col("doc_id").isin(held), frequent=0.0002, pair_token=1.0, strength=5.0).collect()
    moved = sum(size for name, size in files().items() if name not in was)
    drop_scratch(spark, mark)
    split = [[None, *t.lower().split(), None] for t in texts]
    learned = [*(i for i in range(len(texts)) if i not in held), 0]
    one = collections.Counter(w for i in learned for w in split[i][1:])
    two = collections.Counter(p for i in learned for p in zip(split[i], split[i][1:]))
    n, v = sum(one.values()), len(one)
    rare = lambda w: one[w] < 0.0002 * n
    assert {(rare(x), rare(y)) for x, y in two} == {(x, y) for x in (False, True) for y in (False, True)}
    after = collections.defaultdict(lambda: 5, {w: 5 + max(0, c - 0.0002 * n) / 2 for w, c in one.items()})
    assert sorted(x.doc_id for x in got) == sorted([*range(len(texts)), 0])
    for x in got:
        ws = split[x.doc_id]
        base = [math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws[1:]]
        want = sum(math.log10((two[p] + after[p[0]] * 10 ** b) / (one[p[0]] + after[p[0]])) for p, b in zip(zip(ws, ws[1:]), base))
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(base), sum(one[w] > 0 for w in ws[1:]), n)
        assert abs(x.base_score - sum(base)) < 1e-7 and abs(x.score - want) < 1e-7, x.doc_id
    assert moved < 4 * sum(len(t.encode()) for t in texts), moved


def test_pairs_are_packed_without_loss():
    import pyarrow as pa

    from panelwatch.llm import lmscore, textops
    r = np.random.default_rng(4)
    for top in (0, 1, 255, 256, 1 << 40, (1 << 64) - 1):
        values = np.append(r.integers(0, top, 50, dtype=np.uint64, endpoint=True), np.uint64(top))
        assert (lmscore.unpacked(lmscore.packed(values), len(values)) == values).all()
        assert (lmscore.unmixed(textops.mix(values)) == values).all()
    assert len(lmscore.unpacked(lmscore.packed(np.zeros(0, np.uint64)), 0)) == 0
    lost = pa.table({"block": [1, 1], "parts": [3, 0]})
    with pytest.raises(RuntimeError, match="another order"):
        lmscore.block_scores(lost)
