"""Phrases of two and three words that stand together more often than their parts explain (operator 13).

Texts are cut into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs. Per language the words, word
pairs and word triples are counted, one width after another. Each task counts in a HAT-trie: a shallow trie by word ids
whose leaves are hash containers; a container that grows beyond ``BURST`` entries becomes a node with one container for
each next word. When a task holds more than ``HELD`` entries it spills its largest subtrees whole, as sorted runs. The
runs are merged by Spark per language and phrase: the whole phrase is the partition's prefix, so the phrases that
begin with one very common pair are dealt over all tasks.

A phrase can only occur ``least`` times if its words and pairs do. So the pair pass leaves out pairs of rare words, and
the triple pass triples of rare pairs; and both leave out phrases whose slot among 2^26 counters (a pass of its own over
the texts, counters of one byte in each task) stays below ``least``. What is common is known from bitmaps of fixed size
(2 and 8 MB), built by a distributed OR; a wrong hit in a bitmap only means
that a rare phrase is counted and dropped afterwards. Nothing else is sent to all tasks, and no result depends on the
bitmaps: with more phrases than the counters tell apart, more of them are counted.

Defined results: null texts are empty, a null language is ``und``; words may be of any length; repeated rows count each;
an empty table gives an empty result; scores are exact (decimals of 38 digits); ties are ordered by count, then by the
phrase's bytes; further columns are left alone.
"""

from __future__ import annotations

import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwatch.llm import textops
from panelwatch.llm.common import written
from panelwatch.llm.decontaminate import bitmap_of, slots

WIDEST = 3
LEAST, SHARE, TOP = 10, 50, 2000
#: Entries of a container before it bursts, entries and words a task holds before it spills.
BURST, HELD, WORDS = 4096, 300_000, 250_000
BATCH = 50_000
#: A phrase is packed into 63 bits, 21 for each word id of the task.
ID_BITS = 21
ID = (1 << ID_BITS) - 1
SLOT_BITS = 26
#: Counters travel in blocks of 2^16: two bytes of place and one of count for each that is not 0.
BLOCK = 1 << 16
FULL = 255
SEPARATOR = 0

_FROM = bytes(range(65, 91)) + b".,;:!?\x0a\x0b\x0c\x0d\x09"
TABLE = bytes.maketrans(_FROM, bytes(range(97, 123)) + b"\n" * 10 + b" ")
SCHEMA = "lang string, w1 string, w2 string, w3 string, n long"


class Node(dict):
    """Inner node of the trie: next word id to subtree."""


def shift(depth: int) -> int:
    return ID_BITS * (WIDEST - 1 - depth)


def insert(tree: dict, keys: np.ndarray, counts: np.ndarray, depth: int, width: int, burst: int) -> tuple[dict, int]:
    """Add sorted packed phrases below ``tree``; the subtree (a node if its container burst) and its new entries."""
    if not isinstance(tree, Node):
        before, known = len(tree), tree.get
        for k, n in zip(keys.tolist(), counts.tolist()):
            tree[k] = known(k, 0) + n
        added = len(tree) - before
        if len(tree) <= burst or depth >= width - 1:
            return tree, added
        node = Node()
        for k, n in tree.items():
            node.setdefault(k >> shift(depth) & (1 << ID_BITS) - 1, {})[k] = n
        return node, added
    word = keys >> shift(depth) & (1 << ID_BITS) - 1
    cuts = np.flatnonzero(np.diff(word)) + 1
    added = 0
    for first, last in zip(np.append(0, cuts).tolist(), np.append(cuts, len(keys)).tolist()):
        w = int(word[first])
        tree[w], more = insert(tree.get(w, {}), keys[first:last], counts[first:last], depth + 1, width, burst)
        added += more
    return tree, added


def entries(tree: dict) -> int:
    return sum(map(entries, tree.values())) if isinstance(tree, Node) else len(tree)


def run_of(tree: dict) -> list[tuple[int, int]]:
    """The phrases of a subtree and their counts, sorted."""
    if isinstance(tree, Node):
        return [pair for w in sorted(tree) for pair in run_of(tree[w])]
    return sorted(tree.items())


class Words(dict):
    """Word bytes to id, ids given in order of first sight; 0 is the separator and 1 the empty word."""

    def __init__(self):
        super().__init__({b"\n": SEPARATOR, b"": 1})

    def __missing__(self, word):
        self[word] = found = len(self)
        return found


class Counter:
    """The tries of one task, one per language, and their spilled runs."""

    def __init__(self, width: int, bitmaps: tuple, burst: int, held: int, words: int):
        self.width, self.burst, self.held, self.limit = width, burst, held, words
        self.bitmap, self.slots = bitmaps
        self.sums = None
        self.trees, self.words, self.common, self.good, self.total, self.size = {}, {}, {}, {}, {}, 0

    def hashes(self, lang: str, words: Words) -> np.ndarray:
        """Hash of each word id, taken once per word."""
        known = self.common.get(lang, np.zeros(2, np.uint64))
        if len(known) < len(words):
            fresh = word_hashes(lang, list(islice(words, len(known), None)))
            if self.width == 2:
                self.good[lang] = np.concatenate([self.good.get(lang, np.zeros(2, bool)), in_bitmap(self.bitmap, fresh)])
            known = self.common[lang] = np.concatenate([known, fresh])
        return known

    def add(self, lang: str, joined: bytes) -> None:
        """Count the phrases of one slice of texts, separated by line ends."""
        words = self.words.setdefault(lang, Words())
        tokens = joined.translate(TABLE).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
        ids = ids[ids != 1]
        solid = ids != SEPARATOR
        if self.width == 1:
            self.total[lang] = self.total.get(lang, 0) + int(solid.sum())
            found = np.bincount(ids[solid])
            keys = np.flatnonzero(found) << shift(0)
            self.put(lang, keys, found[found > 0])
            return
        elif self.width == 2:
            own = self.hashes(lang, words)
            good = self.good.get(lang, np.zeros(2, bool))[ids] & solid
            at = np.flatnonzero(good[:-1] & good[1:])
            keys = ids[at] << shift(0) | ids[at + 1] << shift(1)
        else:
            at = np.flatnonzero(solid[:-1] & solid[1:])
            pairs, place = np.unique(ids[at] << ID_BITS | ids[at + 1], return_inverse=True)
            common = np.zeros(len(ids), bool)
            own = self.hashes(lang, words)
            common[at] = in_bitmap(self.bitmap, joined_hashes(own[pairs >> ID_BITS], own[pairs & ID]))[place.reshape(-1)]
            at = np.flatnonzero(common[:-1] & common[1:])
            keys = ids[at] << shift(0) | ids[at + 1] << shift(1) | ids[at + 2]
        keys, counts = np.unique(keys, return_counts=True)
        slot = slot_of(joined_hashes(own[keys >> shift(0)], own[keys >> shift(1) & ID]), own[keys & ID] if self.width == 3 else None)
        if self.sums is not None:
            slot, place = np.unique(slot, return_inverse=True)
            self.sums[slot] = np.minimum(self.sums[slot] + np.bincount(place.reshape(-1), counts, len(slot)), FULL)
            return
        often = (self.slots[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
        self.put(lang, keys[often], counts[often])

    def put(self, lang: str, keys: np.ndarray, counts: np.ndarray) -> None:
        if len(keys):
            self.trees[lang], added = insert(self.trees.get(lang, {}), keys, counts, 0, self.width, self.burst)
            self.size += added

    def spill(self, goal: int):
        """Give up whole subtrees, the largest first, until at most ``goal`` entries stay; small runs share a batch."""
        parts = []
        for lang, tree in self.trees.items():
            children = tree.items() if isinstance(tree, Node) else [(None, tree)]
            parts += [(entries(child), lang, word) for word, child in children]
        parts.sort(key=lambda x: (-x[0], x[1], x[2] or 0))
        run, of = [], None
        for size, lang, word in sorted(parts[:self.needed(parts, goal)], key=lambda x: (x[1], x[2] or 0)):
            if run and (lang != of or len(run) >= BATCH):
                yield from self.batches(of, run)
                run = []
            of, tree = lang, self.trees[lang]
            run += run_of(tree if word is None else tree.pop(word))
            if word is None or not tree:
                del self.trees[lang]
            self.size -= size
        if run:
            yield from self.batches(of, run)

    def needed(self, parts: list, goal: int) -> int:
        """How many of the largest subtrees must go."""
        left = self.size - np.cumsum([0] + [size for size, _, _ in parts])
        return int(np.argmax(left <= goal))

    def batches(self, lang: str, run: list[tuple[int, int]]):
        names = list(self.words[lang])
        for at in range(0, len(run), BATCH):
            keys, counts = (np.array(x, np.int64) for x in zip(*run[at:at + BATCH]))
            columns = [pa.array([lang] * len(keys), pa.string())]
            for depth in range(WIDEST):
                ids = (keys >> shift(depth) & (1 << ID_BITS) - 1).tolist()
                column = [names[i] for i in ids] if depth < self.width else [None] * len(ids)
                columns.append(pa.array(column, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts)], names=["lang", "w1", "w2", "w3", "n"])

    def relieve(self):
        """Spill half of the entries when there are too many, all of them when the word ids run out."""
        if sum(map(len, self.words.values())) > self.limit:
            yield from self.finish()
            self.words, self.common, self.good = {}, {}, {}
        elif self.size > self.held:
            yield from self.spill(self.held // 2)

    def finish(self):
        yield from self.spill(0)
        if self.total:
            langs = list(self.total)
            none = pa.nulls(len(langs), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), none, none, none, pa.array([self.total[x] for x in langs], pa.int64())],
                                             names=["lang", "w1", "w2", "w3", "n"])
        self.total = {}


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = zlib.crc32(lang.encode())
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def joined_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return textops.mix(first * textops.GOLD + second)


def seed_task(width: int):
    """Bitmap hashes of words or pairs."""
    def run(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            words = [[w.encode() for w in batch.column(f"w{i + 1}").to_pylist()] for i in range(width)]
            hashes = [np.concatenate([word_hashes(g, [w]) for g, w in zip(langs, column)] or [np.zeros(0, np.uint64)]) for column in words]
            seed = hashes[0] if width == 1 else joined_hashes(*hashes)
            yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64))], names=["seed"])
    return run


def slot_of(pair: np.ndarray, third: np.ndarray | None) -> np.ndarray:
    hashes = pair if third is None else joined_hashes(pair, third)
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for slot in slots(hashes.astype(np.uint64)):
        out &= (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
    return out


def each_piece(batches):
    """(language, joined texts) of every slice, in parts of bounded size."""
    for part in textops.slices(batches, "text"):
        langs = part.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            rows = pa.array([i for i, x in enumerate(langs) if x == lang], pa.int64())
            texts = part.column("text").take(rows).cast(pa.large_binary()).to_pylist()
            # a long text gives many new words: ids must stay below 2^21
            yield from ((lang, piece) for piece in pieces_of(b"\n".join(texts)))


def slot_task(width: int, shared, words: int):
    """(block, places, counts): phrases of common parts per slot, added up in the task as far as a byte holds."""
    def run(batches):
        counter = Counter(width, shared.value, BURST, 0, words)
        counter.sums = np.zeros(1 << SLOT_BITS, np.uint8)
        for lang, piece in each_piece(batches):
            counter.add(lang, piece)
            if sum(map(len, counter.words.values())) > words:
                counter.words, counter.common, counter.good = {}, {}, {}
        for block, sums in enumerate(counter.sums.reshape(-1, BLOCK)):
            there = np.flatnonzero(sums)
            if len(there):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int32()), pa.array([there.astype("<u2").tobytes()], pa.binary()), pa.array([sums[there].tobytes()], pa.binary())],
                    names=["block", "places", "counts"])
    return run


def often_task(least: int):
    """(block, bits): which counters of a block reach ``least`` over all tasks. One byte a counter is held."""
    def run(batches):
        sums = {}
        for batch in batches:
            for block, places, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "places", "counts"))):
                held = sums.setdefault(block, np.zeros(BLOCK, np.uint8))
                at = np.frombuffer(places, "<u2")
                held[at] = np.minimum(held[at].astype(np.int32) + np.frombuffer(counts, np.uint8), FULL)
        for block, held in sums.items():
            bits = np.packbits(held >= least, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits], pa.binary())], names=["block", "bits"])
    return run


def slot_bitmap(texts: DataFrame, width: int, shared, least: int, words: int) -> np.ndarray:
    """Bitmap of the slots with at least ``least`` phrases: 2^23 bytes. A full byte counts as enough."""
    sums = texts.mapInArrow(slot_task(width, shared, words), "block int, places binary, counts binary").repartition("block")
    rows = sums.mapInArrow(often_task(min(least, FULL)), "block int, bits binary").toArrow()  # at most 2^10 rows of 8 KB
    out = np.zeros(1 << SLOT_BITS - 3, np.uint8)
    for block, bits in zip(rows.column("block").to_pylist(), rows.column("bits").to_pylist()):
        out[block * (BLOCK // 8):(block + 1) * (BLOCK // 8)] = np.frombuffer(bits, np.uint8)
    return out


def count_task(width: int, shared, burst: int, held: int, words: int):
    def run(batches):
        counter = Counter(width, shared.value if shared else (None, None), burst, held, words)
        for lang, piece in each_piece(batches):
            counter.add(lang, piece)
            yield from counter.relieve()
        yield from counter.finish()
    return run


def pieces_of(joined: bytes, size: int = textops.SLICE_BYTES):
    """``joined`` in parts of about ``size`` bytes, cut at ends of pieces only; a piece beyond 2^21 bytes stays whole."""
    start = 0
    while len(joined) - start > size:
        cut = max(joined.rfind(c, start, start + size) for c in (b"\n", b".", b","))
        if cut < 0:
            ends = [x for x in (joined.find(c, start + size) for c in (b"\n", b".", b",")) if x >= 0]
            if not ends:
                break
            cut = min(ends)
        yield joined[start:cut + 1]
        start = cut + 1
    yield joined[start:]


def phrase_counts(texts: DataFrame, width: int, common: DataFrame | None = None,
                  least: int = LEAST, burst: int = BURST, held: int = HELD, words: int = WORDS) -> DataFrame:
    """(lang, w1, w2, w3, n) of all phrases of ``width`` words; w1 null holds the number of words of the language.

    ``common``: the phrases with one word less that may be parts (all of them for width 1). Of longer phrases, those
    that occur at least ``least`` times are all there, of rarer ones some.
    """
    shared = None
    if common is not None:
        seeds = common.filter("w1 IS NOT NULL").mapInArrow(seed_task(width - 1), "seed long")
        context, bitmap = texts.sparkSession.sparkContext, bitmap_of(seeds)
        slots_often = slot_bitmap(texts, width, context.broadcast((bitmap, None)), least, words)
        shared = context.broadcast((bitmap, slots_often))
    runs = texts.mapInArrow(count_task(width, shared, burst, held, words), SCHEMA)
    return runs.groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("n"))


def score_of(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a^2 / (l r)), exact."""
    wide = [c.cast("decimal(19,0)") for c in (a, left, right)]
    top = (F.lit(1_000_000).cast("decimal(7,0)") * a.cast("decimal(15,0)")).cast("decimal(22,0)") * a.cast("decimal(15,0)")
    # the integer division of decimals gives a long
    return F.call_function("div", top, wide[1].cast("decimal(18,0)") * wide[2].cast("decimal(18,0)"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, share: int = SHARE, **limits) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every candidate that no longer one covers."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    enough = F.col("w1").isNull() | (F.col("n") >= least)
    one = written(phrase_counts(texts, 1, **limits).filter(enough), "words")
    two = written(phrase_counts(texts, 2, one, least, **limits).filter(enough), "pairs")
    three = written(phrase_counts(texts, 3, two, least, **limits).filter(enough), "triples")
    total = one.filter("w1 IS NULL").select("lang", F.col("n").alias("n"))
    words = one.filter("w1 IS NOT NULL")

    def count(table, names, alias):
        return table.select("lang", *[F.col(f"w{i + 1}").alias(w) for i, w in enumerate(names)], F.col("n").alias(alias))

    keys = ["lang", "w1", "w2", "w3"]
    pair = (count(two, ["w1", "w2"], "a").withColumn("w3", F.lit(None).cast("string"))
            .join(count(words, ["w1"], "l"), ["lang", "w1"]).join(count(words, ["w2"], "r"), ["lang", "w2"])
            .select(*keys, "a", "l", "r", score_of(F.col("a"), F.col("l"), F.col("r")).alias("score")))
    triple = (count(three, ["w1", "w2", "w3"], "a")
              .join(count(words, ["w1"], "l1"), ["lang", "w1"]).join(count(two, ["w2", "w3"], "r1"), ["lang", "w2", "w3"])
              .join(count(two, ["w1", "w2"], "l2"), ["lang", "w1", "w2"]).join(count(words, ["w3"], "r2"), ["lang", "w3"]))
    cuts = [F.struct(score_of(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
            for k in (1, 2)]
    triple = triple.withColumn("cut", F.least(*cuts)).select(*keys, "a", "cut.l", "cut.r", "cut.score")
    # the commonest triple that holds a pair
    inside = F.explode(F.array(F.struct(F.col("w1").alias("w1"), F.col("w2").alias("w2")), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"))))
    longer = (three.select("lang", "n", inside.alias("p")).groupBy("lang", F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2"))
              .agg(F.max("n").alias("longest")))
    pair = pair.join(longer, ["lang", "w1", "w2"], "left").filter(F.expr(f"longest IS NULL OR 100 * longest < {int(share)} * a")).drop("longest")
    return (pair.unionByName(triple).join(total, "lang")
            .select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "l", "r", "n", "score"))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the first 2000 phrases of each language."""
    found = collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
places AS (SELECT lang, unnest(ws) AS w1, unnest(ws[2:] || [NULL]) AS w2, unnest(ws[3:] || [NULL, NULL]) AS w3 FROM words WHERE len(ws) > 0),
one AS (SELECT lang, w1, count(*) AS f FROM places WHERE w1 IS NOT NULL GROUP BY ALL),
two AS (SELECT lang, w1, w2, count(*) AS f FROM places WHERE w1 IS NOT NULL AND w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, w1, w2, w3, count(*) AS f FROM places WHERE w1 IS NOT NULL AND w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(f) AS n FROM one GROUP BY lang),
cuts AS (
  SELECT c.lang, c.w1, c.w2, NULL AS w3, c.f AS a, x.f AS l, y.f AS r, 1 AS cut
  FROM two c JOIN one x ON x.lang = c.lang AND x.w1 = c.w1 JOIN one y ON y.lang = c.lang AND y.w1 = c.w2
  UNION ALL
  SELECT c.lang, c.w1, c.w2, c.w3, c.f, x.f, y.f, 1
  FROM three c JOIN one x ON x.lang = c.lang AND x.w1 = c.w1 JOIN two y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
  UNION ALL
  SELECT c.lang, c.w1, c.w2, c.w3, c.f, x.f, y.f, 2
  FROM three c JOIN two x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN one y ON y.lang = c.lang AND y.w1 = c.w3),
scored AS (SELECT *, 1000000::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w1, w2, w3 ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, w1, w2, max(f) AS longest
  FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL),
kept AS (
  SELECT b.*, concat_ws(' ', b.w1, b.w2, b.w3) AS phrase
  FROM best b LEFT JOIN longer x ON b.w3 IS NULL AND x.lang = b.lang AND x.w1 = b.w1 AND x.w2 = b.w2
  WHERE x.longest IS NULL OR 100 * x.longest < 50 * b.a),
ranked AS (
  SELECT lang, phrase, a, l, r, n, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM kept JOIN total USING (lang))
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""
