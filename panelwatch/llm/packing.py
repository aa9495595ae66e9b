"""Sequence packing by the sum-of-squares rule (operator 4).

Texts are tokenized in tasks; a task keeps the ids of words it has met, so a word is tokenized once per worker and
cache fill. A text longer than a sequence is cut into pieces of full length and a rest; all other texts are one piece.

Packing: full pieces are sequences of their own. The others are dealt by a hash of their row into shards of about
``shard_rows`` pieces. Within a shard, longest pieces first, each goes where the sum over all gaps of (open sequences
with that gap) squared becomes smallest, among the open sequences that have room; a new sequence is opened only where
none has, as the aim is few sequences and the pieces of a shard are all known. What a shard could
not fill is packed again as a block, by the same rule, over fewer shards, until one shard held all of them. The number
of shards follows the number of pieces and their size does not, so no task sees more than a shard.

Defined results: a null or empty text has no token but the closing id 0 and is one piece of length 1; repeated rows are
packed as often as they occur; null ids are allowed; an empty table gives no piece; further columns are ignored; ties
go to the smallest gap.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwatch.llm import textops
from panelwatch.llm.common import written

CAPACITY = 2048
SHARD_ROWS = 8192
#: Words whose ids a worker remembers before it starts anew.
CACHE_WORDS = 3_000_000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Token ids of whole texts. The vocabulary drops white space, so a text's ids are those of its words in order.

    Words are cut at ASCII white space only and A-Z lower-cased, both of which the vocabulary does too. The ids of words
    are kept by the word's hash; beyond ``cache_words`` words the collection starts anew.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # for words of small Latin letters alone, which the vocabulary's own cutting and folding leave as they are
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.latin = re.compile("[a-zà-öø-ÿ]+")
        self.cache_words = cache_words
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.first = np.zeros(0, np.int64)  # where the word's ids begin in the table
        self.size = np.zeros(0, np.int32)
        self.table = np.zeros(0, np.uint32)

    def words(self, asked: list[str]) -> list[bytes]:
        """Ids of words. A last full stop or comma after a letter is a token of its own."""
        stems = [w[:-1] if w[-1] in ".," and self.latin.fullmatch(w[:-1]) else w for w in asked]
        distinct = list(dict.fromkeys(stems))
        plain = [w for w in distinct if self.latin.fullmatch(w)]
        other = list({*distinct, ".", ","}.difference(plain))
        ids = {}
        for tokenizer, group in ((self.plain, plain), (self.tokenizer, other)):
            coded = tokenizer.encode_batch_fast(group, add_special_tokens=False)
            ids.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(group, coded))
        return [ids[s] if len(s) == len(w) else ids[s] + ids[w[-1]] for w, s in zip(asked, stems)]

    def learn(self, keys: np.ndarray, coded: list[bytes]) -> None:
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        first = len(self.table) + np.cumsum(size) - size
        self.table = np.concatenate([self.table, np.frombuffer(b"".join(coded), "<u4")])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.first = np.concatenate([self.first, first])[order]
        self.size = np.concatenate([self.size, size.astype(np.int32)])[order]

    def encode(self, column: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        data, offsets = textops.raw(column)
        hashes, counts, starts, lengths = textops.word_places(data, offsets, spaces_only=True)
        distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        raw = data.tobytes()
        new = distinct
        if len(self.keys):
            spot = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
            new = distinct[self.keys[spot] != distinct]
        if len(self.keys) + len(new) > self.cache_words:
            self.forget()
            new = distinct
        if len(new):
            at = first[np.searchsorted(distinct, new)]
            self.learn(new, self.words([raw[a:a + n].lower().decode("utf-8", "surrogatepass") for a, n in zip(starts[at].tolist(), lengths[at].tolist())]))
        spot = np.searchsorted(self.keys, distinct)[place]
        sizes = self.size[spot].astype(np.int64)
        ids = self.table[textops.ragged(self.first[spot], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        out = [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
        if b"<|" in raw:  # the vocabulary's special strings are found across any neighbours
            for i, t in enumerate(column.to_pylist()):
                if t and "<|" in t:
                    out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        return out


def piece_task(path: str, capacity: int, with_ids: bool):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        store = textops.worker_store()
        if ("ids", path) not in store:
            store["ids", path] = WordIds(path)
        ids = store["ids", path]
        for part in textops.slices(batches, "text", 4 << 20):
            rows, piece, start, length, crc, data = [], [], [], [], [], []
            for i, coded in enumerate(ids.encode(part.column("text"))):
                coded += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(coded), 4 * capacity)):
                    cut = coded[at:at + 4 * capacity]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
                    if with_ids:
                        data.append(cut)
            columns = [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = columns + [pa.array(data, pa.binary())], names + ["ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the texts as pieces; ids are little-endian 32-bit."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(piece_task(path or vocabulary_path(), capacity, with_ids), schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, taken in the given order."""
    open_bins = np.zeros(capacity + 1, np.int64)  # by gap; full sequences are not counted
    stacks: dict[int, list[int]] = {}
    bins, offsets, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        gaps = size + np.flatnonzero(open_bins[size:capacity])
        if len(gaps):
            rise = 2 * (open_bins[gaps - size] - open_bins[gaps] + 1)
            if gaps[0] == size:
                rise[0] = 1 - 2 * open_bins[size]
            gap = int(gaps[rise.argmin()])
            chosen = stacks[gap].pop()
            open_bins[gap] -= 1
        else:
            gap, chosen, made = capacity, made, made + 1
        bins[i], offsets[i] = chosen, capacity - gap
        if gap > size:
            open_bins[gap - size] += 1
            stacks.setdefault(gap - size, []).append(chosen)
    return bins, offsets


def shard_task(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("length", ascending=False, kind="stable")
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.assign(bin=(int(key[0]) << 32) + bins, offset=offsets)
    return run


def block_task(capacity: int, level: int):
    """Underfilled sequences as blocks: where each goes and how far it moves there."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("fill", ascending=False, kind="stable")
        bins, offsets = sum_of_squares(rows["fill"].to_numpy(), capacity)
        return rows[["bin", "fill"]].assign(to=(level << 56) + (int(key[0]) << 32) + bins, by=offsets)
    return run


def dealt(rows: DataFrame, shards: int) -> DataFrame:
    """Rows of a written table with the number of their shard: the same at each reading of the table."""
    return rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``pieces`` (with length; must be a written table) plus sequence_id and offset."""
    small = pieces.filter(F.col("length") < capacity)
    shards = max(1, -(-small.count() // shard_rows))
    schema = dealt(small, shards).schema.add("bin", "long").add("offset", "long")
    placed = written(dealt(small, shards).groupBy("shard").applyInPandas(shard_task(capacity), schema), "placed").drop("shard")
    bins = written(placed.groupBy("bin").agg(F.sum("length").alias("fill")).filter(F.col("fill") < capacity), "bins")
    moves = None  # (bin, sequence, base)
    level = 1
    while shards > 1:
        least = bins.agg(F.min("fill")).first()[0]
        if least is None:
            break
        blocks = written(bins.filter(F.col("fill") <= capacity - least), "blocks")
        count = blocks.count()
        if count < 2:
            break
        shards = min(shards - 1, max(1, -(-count // shard_rows)))
        schema = "bin long, fill long, to long, by long"

        moved = written(dealt(blocks, shards).groupBy("shard").applyInPandas(block_task(capacity, level), schema), "moved")
        step = moved.select("bin", "to", "by")
        if moves is None:
            moves = step
        else:
            onward = step.select(F.col("bin").alias("to"), F.col("to").alias("to2"), F.col("by").alias("by2"))
            moves = (moves.join(onward, "to", "left").select("bin", F.coalesce("to2", "to").alias("to"), (F.col("by") + F.coalesce("by2", F.lit(0))).alias("by"))
                     .union(step.join(moves.select("bin"), "bin", "left_anti")))
            moves = written(moves, "moves")
        # a block that was alone in its new bin and one that gained blocks are bins alike
        bins = written(bins.join(blocks.select("bin"), "bin", "left_anti")
                       .union(moved.groupBy(F.col("to").alias("bin")).agg(F.sum("fill").alias("fill"))).filter(F.col("fill") < capacity), "bins")
        level += 1
    if moves is not None:
        placed = (placed.join(moves, "bin", "left")
                  .select(*pieces.columns, F.coalesce("to", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset")))
    else:
        placed = placed.select(*pieces.columns, F.col("bin").alias("sequence_id"), "offset")
    full = pieces.filter(F.col("length") >= capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.union(full)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence as bytes, from pieces that carry their ids."""
    gathered = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate(F.transform("parts", lambda p: p["ids"]), F.lit(b""), lambda a, b: F.concat(a, b))
    return gathered.select("sequence_id", joined.alias("ids"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    return pack(written(token_pieces(docs, path, capacity, with_ids), "pieces"), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    """Contract of op4: one row per piece."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places."""
    return pack_documents(docs)
