"""Near-duplicate documents by ProbMinHash (operator 9).

A text is a weighted set: its five-word shingles with their counts. Each shingle sends a Poisson process of arrivals,
at a rate equal to its weight, to random registers; the earliest arrival at each of 64 registers is the signature, and
a shingle stops as soon as its next arrival comes after every register's earliest one. Two signatures agree in a
register with the probability Jaccard similarity of the sets. 16 bands of 4 registers make buckets: a pair at 0.8
meets in one with probability 0.9998. A second signature with all weights 1 gives 16 more bands in the same buckets, so
that the same holds for plain Jaccard, whatever a text repeats.

Exact copies are one node from the start. In each bucket every member is compared
with the bucket's hub and with the hub of one of eight random parts of the bucket; hubs are the members that meet most
others over all their bands, so a text that many variants were made from is found as their hub. These comparisons grow
with the members, not with their square. Then, round by round, members that are still in another class than the
bucket's hub are compared with another member of the hub's class: first in the same buckets, then in finer ones of two
bands each, where the texts are closer. That only makes the classes large cheaply. At last every pair of a bucket that
is still in two classes is compared (``open_links``): the members outside the bucket's largest class with all its
members, in blocks of bounded size, so no pair that shares a bucket stays untested unless links already join it. A pair
is a link if its exact probability Jaccard or its plain Jaccard similarity reaches ``threshold``; classes are connected
components of the links.

Defined results: a null text is a class of its own row (class_id = doc_id) and so are texts that nothing resembles;
texts of fewer than five words have one shingle, all their words; texts without words meet exact copies only;
class_id is the smallest doc_id of the class (null ids do not count unless all are null); repeated rows share a class;
further columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwatch.llm import textops
from panelwatch.llm.common import fresh, written

WIDTH = 5
BANDS = 16
BAND_ROWS = 4
REGISTERS = BANDS * BAND_ROWS
PARTS = 8
#: Members and text bytes of one side of a block of pairs.
BLOCK = 256
BLOCK_BYTES = 4 << 20


def uniform(x: np.ndarray) -> np.ndarray:
    return ((textops.mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def prob_minhash(rows: np.ndarray, grams: np.ndarray, weights: np.ndarray, texts: int, m: int = REGISTERS) -> np.ndarray:
    """Signatures (texts x m): the gram that arrived first at each register; 0 for a text without grams."""
    least = np.full(texts * m, np.inf)
    winner = np.zeros(texts * m, np.uint64)
    active, time, arrival = np.arange(len(rows)), np.zeros(len(rows)), 0
    while len(active):
        arrival += 1
        seed = grams[active] + np.uint64(arrival * int(textops.GOLD) & 0xFFFFFFFFFFFFFFFF)
        time = time - np.log(uniform(seed)) / weights[active]
        slot = rows[active] * m + (textops.mix(~seed) % np.uint64(m)).astype(np.int64)
        np.minimum.at(least, slot, time)
        won = least[slot] == time
        winner[slot[won]] = grams[active][won]
        going = time < least.reshape(texts, m).max(1)[rows[active]]
        active, time = active[going], time[going]
    return winner.reshape(texts, m)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    odd = np.uint64(0xD6E8FEB86659FD93)
    bands = np.zeros((len(sig), BANDS), np.uint64)
    for k in range(BAND_ROWS):
        bands = bands * odd + sig[:, k::BAND_ROWS]
    return textops.mix(bands + np.arange(BANDS, dtype=np.uint64) * textops.GOLD)


def signature_task(batches):
    for part in textops.slices(batches, "text"):
        hashes, counts = textops.word_hashes(part.column("text"))
        rows, grams, weights = textops.weighted_grams(hashes, counts, WIDTH)
        weighted = band_hashes(prob_minhash(rows, grams, weights, part.num_rows))
        plain = weighted.copy()
        again = np.bincount(rows, weights=weights > 1, minlength=part.num_rows) > 0
        if again.any():
            of = again[rows]
            place = np.cumsum(again) - 1
            plain[again] = band_hashes(prob_minhash(place[rows[of]], grams[of], np.ones(int(of.sum())), int(again.sum())))
        bands = np.concatenate([weighted, plain], axis=1)
        some = counts > 0
        offsets = np.concatenate([[0], np.cumsum(some * 2 * BANDS)]).astype(np.int32)
        values = pa.array(bands[some].ravel().view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("node"), pa.ListArray.from_arrays(pa.array(offsets), values)],
            names=["doc_id", "node", "bands"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, node, bands) of every row with a text; node is the hash of the text, alike for exact copies.

    First the bands of the counts, then those of weights 1; they agree for a text that repeats no shingle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", F.md5(F.col("text").cast("binary")).alias("node"), "text")
    return rows.mapInArrow(signature_task, f"doc_id {kind}, node string, bands array<bigint>")


def row_starts(rows: np.ndarray, count: int) -> np.ndarray:
    return np.searchsorted(rows, np.arange(count + 1))


def probability_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Exact value for two aligned weight vectors (0 where one lacks the element)."""
    both = (x > 0) & (y > 0)
    with np.errstate(divide="ignore"):
        ratio = np.where(x > 0, y / np.where(x > 0, x, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    left = np.concatenate([[0], np.cumsum(x[order])])
    right = y.sum() - np.concatenate([[0], np.cumsum(y[order])])
    upto = np.searchsorted(ratio[order], ratio[both], side="right")
    return float((1 / (left[upto] / x[both] + right[upto] / y[both])).sum())


def aligned_probability(grams_x: np.ndarray, x: np.ndarray, grams_y: np.ndarray, y: np.ndarray) -> float:
    """Probability Jaccard of two texts, each given by its sorted grams and their counts."""
    grams = np.union1d(grams_x, grams_y)
    full = np.zeros((2, len(grams)))
    full[0, np.searchsorted(grams, grams_x)] = x / x.sum()
    full[1, np.searchsorted(grams, grams_y)] = y / y.sum()
    return probability_jaccard(*full)


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """The larger of plain and probability Jaccard for each pair of texts."""
    n = len(left)
    sides = [textops.weighted_grams(*textops.word_hashes(c), WIDTH) for c in (left, right)]
    keys = [(r.astype(np.uint64) << np.uint64(44)) | g for r, g, _ in sides]
    _, ia, ib = np.intersect1d(keys[0], keys[1], assume_unique=True, return_indices=True)
    shared = np.bincount(sides[0][0][ia], minlength=n)
    sizes = [np.bincount(s[0], minlength=n) for s in sides]
    union = sizes[0] + sizes[1] - shared
    out = np.where(union > 0, shared / np.maximum(union, 1), 0.0)
    heavy = [np.bincount(s[0], weights=s[2] > 1, minlength=n) for s in sides]
    starts = [row_starts(s[0], n) for s in sides]
    for i in np.flatnonzero(((heavy[0] + heavy[1]) > 0) & (shared > 0)):
        cut = [slice(s[i], s[i + 1]) for s in starts]
        out[i] = max(out[i], aligned_probability(*(s[k][c] for s, c in zip(sides, cut) for k in (1, 2))))
    return out


def verify_task(threshold):
    def run(batches):
        for part in textops.slices(batches, "text_a"):
            good = pa.array(similarities(part.column("text_a"), part.column("text_b")) >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), good], names=["a", "b", "linked"])
    return run


def hub_pairs(buckets: DataFrame, group: list[Column | str]) -> DataFrame:
    """(a, b): every member of a group beside the group's most central member."""
    hubs = buckets.groupBy(*group).agg(F.max(F.struct("centrality", "node")).alias("hub"))
    names = [c for c in hubs.columns if c != "hub"]
    return buckets.join(hubs, names).select(F.col("node").alias("a"), F.col("hub.node").alias("b")).filter("a != b")


def undirected(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"))
    return both.select("a", "b", "text_a", "text_b").mapInArrow(verify_task(threshold), "a string, b string, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link.

    Each round every node takes the smallest label among its neighbours and that label's own; links are renamed to
    the labels and those within a label go, so what is left shrinks from round to round.
    """
    edges = written(links.select("a", "b").distinct(), "links")
    roots = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("near")), "near")
        onward = near.select(F.col("node").alias("near"), F.col("near").alias("root"))
        labels = written(near.join(onward, "near").select("node", "root"), "labels")
        renamed = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        roots = labels if roots is None else written(roots.join(renamed, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        at_a, at_b = (labels.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        edges = (edges.join(at_a, "a").join(at_b, "b").filter("root_a != root_b")
                 .select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct())
        edges = written(edges, "links")
        if edges.isEmpty():
            return roots


def joined_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Classes after more links between nodes; only links between different classes are followed."""
    at_a, at_b = (classes.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    between = (links.select("a", "b").join(at_a, "a", "left").join(at_b, "b", "left")
               .select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).filter("a != b"))
    moved = components(between)
    renamed = moved.select(F.col("node").alias("root"), F.col("root").alias("next"))
    kept = classes.join(renamed, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return written(kept.union(moved.join(classes.select("node"), "node", "left_anti")), "roots")


def open_blocks(known: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Blocks (band, l, r) of the members outside a bucket's largest class (side 0) beside all members (side 1).

    Buckets of two are left out: their pair has met as member and hub.
    """
    sized = written(known.join(texts.select("node", F.octet_length("text").alias("bytes")), "node"), "known")
    by_class = sized.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    per = by_class.groupBy("band").agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"),
                                       F.max(F.struct("n", "root", "bytes")).alias("main")).filter("classes > 1 AND n > 2")

    def blocks(n, size):
        return F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")

    per = per.select("band", F.col("main.root").alias("main"), blocks(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("ls"),
                     blocks(F.col("n"), F.col("bytes")).alias("rs"))
    rows = sized.join(per, "band")
    deal = F.xxhash64("band", "node")
    left = rows.filter("root != main").select(
        "band", "node", "root", "main", F.lit(0).alias("side"), F.pmod(deal, "ls").cast("int").alias("l"), F.explode(F.sequence(F.lit(0), F.col("rs") - 1)).alias("r"))
    right = rows.select(
        "band", "node", "root", "main", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("ls") - 1)).alias("l"), F.pmod(deal, "rs").cast("int").alias("r"))
    return left.unionByName(right).join(nodes, "node").join(texts, "node")


def open_links(known: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that join classes which share a bucket; every pair of two classes in it is compared."""
    return open_blocks(known, nodes, texts).groupBy("band", "l", "r").applyInArrow(open_task(threshold), "a string, b string")


def open_task(threshold):
    """Links between a block's left and right members of different classes; one link at most for two classes to join."""
    least = threshold - 1e-12

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        right = table.column("side").to_numpy()
        lefts, rights = np.flatnonzero(right == 0), np.flatnonzero(right == 1)
        names = table.column("node").to_numpy(zero_copy_only=False)
        found: list[tuple[str, str]] = []
        if len(lefts) and len(rights):
            band = table.column("band")[0].as_py()
            bands = np.array(table.column("bands").to_pylist(), np.int64).reshape(len(names), -1, BANDS)
            node = np.unique(names, return_inverse=True)[1]
            roots = table.column("root").to_numpy(zero_copy_only=False)
            kind = np.unique(roots, return_inverse=True)[1]
            label = np.arange(kind.max() + 1)
            main = roots[rights] == table.column("main")[0].as_py()
            rows, grams, weights = textops.weighted_grams(*textops.word_hashes(pa.concat_arrays(table.column("text").chunks)), WIDTH)
            distinct, ids = np.unique(grams, return_inverse=True)
            sizes, starts = np.bincount(rows, minlength=len(names)), row_starts(rows, len(names))
            share = weights / np.bincount(rows, weights=weights, minlength=len(names))[rows]
            heavy = np.bincount(rows, weights=weights > 1, minlength=len(names)) > 0
            mark = np.zeros(len(distinct))
            for i in lefts:
                others = rights[(label[kind[rights]] != label[kind[i]]) & (main | (node[rights] > node[i]))]
                # a pair is compared in one of the buckets it shares
                alike = bands[others][:, :, None] == bands[i][None, None]
                meet = np.where(alike, bands[i][None, None], np.iinfo(np.int64).max)
                others = others[meet.min((1, 2, 3)) == band]
                if not len(others):
                    continue
                own = slice(starts[i], starts[i + 1])
                at = textops.ragged(starts[others], sizes[others])
                slot = np.repeat(np.arange(len(others)), sizes[others])
                mark[ids[own]] = share[own]
                met = mark[ids[at]]
                mark[ids[own]] = 0
                shared = np.bincount(slot, weights=met > 0, minlength=len(others))
                good = shared / (sizes[i] + sizes[others] - shared) >= least
                # no probability Jaccard exceeds the common mass
                mass = np.bincount(slot, weights=np.minimum(met, share[at]), minlength=len(others))
                maybe = ~good & (heavy[i] | heavy[others]) & (mass >= least - 1e-9)
                for j, sure in [*((j, True) for j in others[good]), *((j, False) for j in others[maybe])]:
                    if label[kind[i]] == label[kind[j]]:
                        continue
                    other = slice(starts[j], starts[j + 1])
                    if sure or aligned_probability(grams[own], weights[own], grams[other], weights[other]) >= least:
                        found.append((names[i], names[j]))
                        label[label == label[kind[j]]] = label[kind[i]]
        return pa.table({"a": pa.array([a for a, _ in found], pa.string()), "b": pa.array([b for _, b in found], pa.string())})
    return run


def node_classes(docs: DataFrame, signed: DataFrame, threshold: float = 0.8, rounds: int = 3) -> DataFrame:
    """(node, root) of the nodes that are linked to another node."""
    nodes = signed.filter(F.size("bands") > 0).groupBy("node").agg(F.min("bands").alias("bands"))
    member = nodes.select("node", F.explode(F.array_distinct("bands")).alias("band"))
    full = member.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    shared = written(member.join(full, "band"), "members")
    central = shared.groupBy("node").agg(F.sum("size").alias("centrality"))
    buckets = written(shared.join(central, "node").select("band", "node", "centrality"), "buckets")
    texts = written(
        docs.filter(F.col("text").isNotNull()).select(F.md5(F.col("text").cast("binary")).alias("node"), "text")
        .join(central.select("node"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")
    part = F.pmod(F.xxhash64("node", "band"), F.lit(PARTS)).alias("part")
    with_part = buckets.select("*", part)
    pairs = undirected(hub_pairs(buckets, ["band"]).union(hub_pairs(with_part, ["band", "part"])))
    checked = written(verified(pairs, texts, threshold), "checked")
    classes = components(checked.filter("linked"))
    for step in range(rounds):
        groups = buckets
        if step:  # finer buckets, of two bands each, bring closer texts together
            wide = F.transform(F.sequence(F.lit(0), F.lit(2 * BANDS - 1)), lambda k: F.xxhash64(
                F.get("bands", k), F.get("bands", k - k % BANDS + (k + step) % BANDS), k % BANDS))
            groups = nodes.join(central, "node").select("node", "centrality", F.explode(F.array_distinct(wide)).alias("band"))
        known = groups.join(classes, "node", "left").select("band", "node", "centrality", F.coalesce("root", "node").alias("root"))
        hub = known.groupBy("band").agg(F.max(F.struct("centrality", "node", "root"))["root"].alias("main"), F.min("root").alias("low"), F.max("root").alias("high"))
        known = known.join(hub.filter("low != high"), "band")
        turn = F.xxhash64("node", F.lit(step))
        other = known.filter("root = main").groupBy("band").agg(F.max(F.struct(turn.alias("turn"), "node"))["node"].alias("b"))
        more = undirected(known.filter("root != main").join(other, "band").select(F.col("node").alias("a"), "b"))
        more = written(more.join(checked, ["a", "b"], "left_anti"), "pairs")
        if more.isEmpty():
            continue
        again = written(verified(more, texts, threshold), "checked")
        checked = checked.union(again)
        if not again.filter("linked").isEmpty():
            classes = joined_classes(classes, again.filter("linked"))
    known = buckets.join(classes, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    links = written(open_links(known, nodes, texts, threshold), "open")
    return classes if links.isEmpty() else joined_classes(classes, links)


def classify(docs: DataFrame, threshold: float = 0.8, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, class_id) of every row, and (doc_id, node) of the one document that stands for each class."""
    ids = docs.select("doc_id", "text")
    signed = written(signatures(ids), "signatures")
    classes = node_classes(ids, signed, threshold, rounds)
    own = signed.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    rooted = written(own.join(classes, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "rooted")
    heads = rooted.groupBy("root").agg(F.min(F.struct(F.col("first").isNull(), "first", "node")).alias("head"))
    heads = heads.select("root", F.col("head.first").alias("class_id"), F.col("head.node").alias("head"))
    named = written(rooted.join(heads, "root").select("node", "class_id", (F.col("node") == F.col("head")).alias("is_head")), "classes")
    rows = signed.select("doc_id", "node").join(named.select("node", "class_id"), "node").select("doc_id", "node", "class_id")
    blank = ids.filter(F.col("text").isNull()).select("doc_id", F.lit(None).cast("string").alias("node"), F.col("doc_id").alias("class_id"))
    return rows.union(blank), named.filter("is_head").select(F.col("class_id").alias("doc_id"), "node")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: one row per document with its class and whether it is the one that stays."""
    rows, _ = classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, unchanged; texts that are null all stay."""
    _, heads = classify(docs)
    node, ident = fresh(docs, "node"), fresh(docs, "id")
    keyed = docs.withColumn(node, F.md5(F.col("text").cast("binary")))
    heads = heads.select(F.col("node").alias(node), F.col("doc_id").alias(ident))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # rows that agree in id and text: the smallest one; maps have no order, so they are compared as text
    order = F.struct(*[F.to_json(f"`{f.name}`") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
                       for f in docs.schema.fields if f.name not in ("doc_id", "text")], F.lit(0))
    one = (keyed.join(heads, (keyed[node] == heads[node]) & keyed["doc_id"].eqNullSafe(heads[ident]))
           .groupBy(keyed[node], heads[ident]).agg(F.min_by(row, order).alias("row")).select("row.*"))
    return one.union(docs.filter(F.col("text").isNull()))
