"""Text scores from a log-frequency Bloom filter (operator 10).

Tokens are runs of anything but white space with A-Z lower-cased, and one end token a text.

Base score: exact counts. All tokens are counted by hash with sums in each task. Tokens that make up at least
``frequent`` of the training tokens or of all tokens (1e-6, so at most two million) are broadcast with their training
counts, and their part of a score is added where the text is read. All others are rare.

Model: the count of a token after another, added to ``strength`` times the token's base probability, over the count of the
token before plus ``strength``, which grows by half of what a token counts beyond ``frequent``. No n-gram is left out. A Bloom filter holds the common ones with quantised counts: an n-gram
of count c is inserted with the levels 1 to 1 + log2(c / least count), and a count is read by probing level after level until
one is missing. It holds pairs of neighbouring tokens of at least the share ``held_pair``, both of whose tokens have at least
the share ``pair_token``; shares of the training tokens, so the filter has a fixed largest size (1e7 pairs of a few levels
each, 2^30 bits); its bits are set by a distributed OR. All other pairs are counted exactly, in one shuffle for counts and
questions alike: a block of texts sends each shard its distinct pairs, sorted and packed, and the texts that hold them.
A shard has every place of its pairs, so it adds up their counts, and sends each text one sum; a shard has the pairs of
about ``TASK_TOKENS`` tokens at most. A pair of frequent tokens
goes to a shard by both tokens, one with a rare token by that token: every place of a rare token is the second half of some
pair, so its own count and its part of the base score come from the same shard. A rare token makes up less than a millionth
of all tokens, so no key is large. The logarithm is a sum of one part for each token and one for each pair, so the parts
are added up per text wherever they come from.

Blocks are known by a hash of their tokens. If a lost task is repeated on rows that come in another order, its blocks differ
from what the shards already have; then the query fails with a message instead of adding up parts of different texts.

Defined results: null and empty texts have one token, the end; rows with a null id are learned from; without any
training row all probabilities are 1 (score 0); repeated rows count and are scored each; further columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwatch.llm import textops
from panelwatch.llm.common import fold, parts_of, written

END = np.uint64(0x5851F42D4C957F2D)
FREQUENT = 1e-6
PAIR_TOKEN = 2e-5
HELD_PAIR = 1e-7
STRENGTH, STRENGTH_SHARE = 500.0, 0.5
PROBES = 4
BITS_PER_ENTRY = 12
TASK_TOKENS = 4_000_000
#: Tokens of a block, whose texts send their pairs together.
BLOCK_TOKENS = 2_000_000
#: Pair tokens have the share 2e-5, so they are at most 50,000 and numbers of 20 bits hold them.
PAIR_SHIFT = 20


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by the end token, and the number of tokens of each text."""
    hashes, counts = textops.word_hashes(column, spaces_only=True)
    return np.insert(hashes, np.cumsum(counts), END), counts + 1


def gathered(parts):
    """(code, n) over runs of about ``TASK_TOKENS`` values."""
    held, size = [], 0
    for values in parts:
        held.append(values)
        size += len(values)
        if size >= TASK_TOKENS:
            yield np.unique(np.concatenate(held), return_counts=True)
            held, size = [], 0
    if held:
        yield np.unique(np.concatenate(held), return_counts=True)


def token_task(batches):
    """(token, n, c): all occurrences and those in training texts."""
    def split():
        for part in textops.slices(batches, "text"):
            tokens, counts = tokens_of(part.column("text"))
            learned = np.repeat(part.column("train").to_numpy(zero_copy_only=False), counts)
            yield tokens[learned], tokens[~learned]

    held, size = [], 0
    for pieces in split():
        held.append(pieces)
        size += sum(map(len, pieces))
        if size >= TASK_TOKENS:
            yield from token_counts(held)
            held, size = [], 0
    if held:
        yield from token_counts(held)


def token_counts(held):
    for learned, pieces in zip((1, 0), zip(*held)):
        tokens, n = np.unique(np.concatenate(pieces), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n, pa.int64()), pa.array(n * learned, pa.int64())], names=["token", "n", "c"])


def numbers(table: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Place of each token in a sorted table, -1 if it is not there."""
    if not len(table):
        return np.full(len(tokens), -1)
    spot = np.minimum(np.searchsorted(table, tokens), len(table) - 1)
    return np.where(table[spot] == tokens, spot, -1)


def pair_codes(table: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Code of each token with the one before it, -1 if the table lacks one of them; the end token stands before a text."""
    number = numbers(table, tokens)
    first = np.concatenate([numbers(table, np.array([END])), number[:-1]])
    return np.where((number >= 0) & (first >= 0), (first << PAIR_SHIFT) + number, -1)


def strength_after(count: np.ndarray, strength: float, free: float) -> np.ndarray:
    """How many counts the base probability stands for after a token of that count."""
    return strength + STRENGTH_SHARE * np.maximum(count - free, 0.0)


def code_task(shared):
    """(token, n) of the pairs the filter may hold: their codes and training counts."""
    def run(batches):
        codes = (pair_codes(shared.value, tokens_of(part.column("text"))[0]) for part in textops.slices(batches, "text"))
        for code, n in gathered(x[x >= 0] for x in codes):
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n, pa.int64())], names=["token", "n"])
    return run


@dataclass
class Model:
    bits: np.ndarray  # the filter, in 64-bit words
    least: tuple[float, float]  # least counts of tokens (not held by queries) and of pairs
    total: float  # training tokens and what smoothing adds
    strength: float
    pair_tokens: np.ndarray  # sorted hashes of the tokens that form pairs
    free: float = 0.0  # count from which on the strength grows


def positions(codes: np.ndarray, level: int, size: int) -> list[np.ndarray]:
    seed = textops.mix(codes + np.uint64(level * int(textops.GOLD) & 0xFFFFFFFFFFFFFFFF))
    step = textops.mix(seed) | np.uint64(1)
    return [((seed + np.uint64(k) * step) & np.uint64(size - 1)) for k in range(PROBES)]


def level_of(count: np.ndarray, least: float) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(count / least, 1)) + 1e-9).astype(int)


def value_of(level: np.ndarray, least: float) -> np.ndarray:
    """Middle of the counts of a level; 0 for level 0."""
    return np.where(level > 0, least * 1.4 * 2.0 ** (level - 1.0), 0.0)


def bit_task(size: int, least: tuple[float, float]):
    def run(batches):
        for part in batches:
            codes = part.column("token").to_numpy().view(np.uint64)
            count, pair = part.column("n").to_numpy(), part.column("pair").to_numpy(zero_copy_only=False)
            level = np.where(pair, level_of(count, least[1]), level_of(count, least[0]))
            codes = codes ^ np.where(pair, textops.GOLD, np.uint64(0))
            for j in range(1, int(level.max(initial=0)) + 1):
                for at in positions(codes[level >= j], j, size):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"])
    return run


def counts_from(model: Model, codes: np.ndarray, pair: bool) -> np.ndarray:
    """Quantised counts by repeated membership probes."""
    size = len(model.bits) * 64
    codes = codes ^ textops.GOLD if pair else codes
    level, active = np.zeros(len(codes), int), np.arange(len(codes))
    j = 0
    while len(active):
        j += 1
        inside = np.ones(len(active), bool)
        for at in positions(codes[active], j, size):
            inside &= (model.bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        active = active[inside]
        level[active] = j
    return value_of(level, model.least[1] if pair else model.least[0])


def held_counts(model: Model, codes: np.ndarray) -> np.ndarray:
    """What the filter says of each pair; 0 for a code of -1."""
    out, some = np.zeros(len(codes)), np.flatnonzero(codes >= 0)
    distinct, at = np.unique(codes[some], return_inverse=True)
    out[some] = counts_from(model, distinct.view(np.uint64), True)[at]
    return out


def packed(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs, all first bytes first."""
    width = (int(values.max(initial=0)).bit_length() + 7) // 8
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if data:
        planes = np.frombuffer(data, np.uint8).reshape(-1, n)
        out[:, :len(planes)] = planes.T
    return out.view("<u8").ravel()


#: Which token of a pair is rare: neither, the first, the second or both.
FIRST_RARE, SECOND_RARE = 1, 2


def addresses(first: np.ndarray, second: np.ndarray, first_number: np.ndarray, second_number: np.ndarray):
    """(kind, route, other) of pairs, which together say the two tokens exactly.

    Frequent tokens are said by their numbers. The route, by which a pair finds its shard, is both numbers scrambled,
    or the hash of the rare token (the second, if both are); the other is the other token's number or hash.
    """
    first_rare, second_rare = first_number < 0, second_number < 0
    kind = FIRST_RARE * first_rare + SECOND_RARE * second_rare
    numbers_of = lambda x: x.astype(np.uint64)
    route = textops.mix((numbers_of(first_number) << np.uint64(32)) | numbers_of(second_number))
    route = np.where(second_rare, second, np.where(first_rare, first, route))
    other = np.where(kind == 0, np.uint64(0), numbers_of(np.where(second_rare, first_number, second_number)))
    return kind, route, np.where(kind == FIRST_RARE + SECOND_RARE, first, other)


def unmixed(x: np.ndarray) -> np.ndarray:
    """What ``textops.mix`` made into ``x``."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def by_address(kind: np.ndarray, route: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Order by route, kind and other; equal ones stay in their order."""
    plain, rest = np.flatnonzero(kind == 0), np.flatnonzero(kind)
    order = np.concatenate([plain[np.argsort(route[plain], kind="stable")], rest[np.lexsort((other[rest], kind[rest], route[rest]))]])
    return order[np.argsort(route[order], kind="stable")]


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return out


OWN = "array<struct<doc_id: {kind}, n_tokens: bigint, n_frequent: bigint, frequent_sum: double, held_sum: double>>"
ASKED = "shard int, block long, parts int, pairs int, first_route long, routes binary, kinds binary, numbers binary, hashes binary, places binary, texts binary, times binary, own " + OWN
ANSWERED = "block long, parts int, at binary, more binary, rare binary, known binary, base binary, own " + OWN


def ask_task(model_shared, exact_shared, shards: int):
    """A row for each block and shard: the block's distinct pairs that the filter lacks, the texts of each, and how often.

    One row of a block also has the number of its rows and, per text, its tokens, the exact part of its frequent
    tokens and the filter's part of the model's score.
    """
    def run(batches):
        model, (table, exact) = model_shared.value, exact_shared.value
        end, pair_number = numbers(table, np.array([END])), numbers(model.pair_tokens, table)
        after = strength_after(exact, model.strength, model.free)
        value, follows = np.log10(exact + 0.5), np.log10(after / (exact + after))
        of = lambda column, number: column[number] if len(column) else np.zeros(len(number), column.dtype)  # noqa: E731  with 0 <= number
        parts, size, done = [], 0, 0

        def looked_up(part, base):
            tokens, counts = tokens_of(part.column("text"))
            begins = np.cumsum(counts) - counts
            number, first = numbers(table, tokens), np.concatenate([[END], tokens[:-1]])
            before = np.concatenate([end, number[:-1]])
            frequent = number >= 0
            code = np.where(frequent, of(pair_number, number), -1)
            code_before = np.where(before >= 0, of(pair_number, before), -1)
            pair = held_counts(model, np.where((code >= 0) & (code_before >= 0), (code_before << PAIR_SHIFT) + code, -1))
            held = pair > 0
            score = np.where(frequent, of(follows, number), 0.0)
            x, y = before[held], number[held]  # tokens of held pairs are frequent
            score[held] += np.log10(1 + np.minimum(pair[held], exact[x]) * model.total / (after[x] * (exact[y] + 0.5)))
            sums = [np.add.reduceat(x, begins) for x in ((frequent & (of(exact, number) > 0)).astype(np.int64), np.where(frequent, of(value, number), 0.0), score)]
            learned = part.column("train").to_numpy(zero_copy_only=False)
            text = textops.row_of(counts)
            place = ((base + text) << 1 | learned[text])[~held]
            apart = addresses(first[~held], tokens[~held], before[~held], number[~held])
            name = textops.mix(tokens * (2 * np.arange(len(tokens), dtype=np.uint64) + np.uint64(1))).sum(dtype=np.uint64)
            return (part.column("doc_id"), counts, *sums), (*apart, place), name

        def block(parts, number):
            own, apart, names = zip(*parts)
            kind, route, other, place = (np.concatenate(x) for x in zip(*apart))
            order = by_address(kind, route, other)
            kind, route, other, place = kind[order], route[order], other[order], place[order]
            new = changes(route, kind, other)
            entry = np.flatnonzero(new | changes(place))  # a pair in a text
            times = np.diff(np.append(entry, len(place)))
            at = np.flatnonzero(new[entry])
            n_texts = np.diff(np.append(at, len(entry)))
            kind, route, other, place = kind[entry][at], route[entry][at], other[entry][at], place[entry]
            shard = ((route >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
            own = [pa.concat_arrays([x[0] for x in own]), *(pa.array(np.concatenate([x[i] for x in own])) for i in range(1, 5))]
            own = pa.StructArray.from_arrays(own, names=["doc_id", "n_tokens", "n_frequent", "frequent_sum", "held_sum"])
            name = textops.mix(np.array(names, np.uint64) + np.arange(len(names), dtype=np.uint64)).sum(dtype=np.uint64)
            name = textops.mix(np.array([name ^ textops.mix(np.array([(TaskContext.get().partitionId() << 32) + number], np.uint64))[0]], np.uint64))
            home = int(name[0] % np.uint64(shards))
            to = np.union1d(shard, [np.uint64(home)]).astype(np.int64)
            low, high = np.searchsorted(shard, to.astype(np.uint64)), np.searchsorted(shard, to.astype(np.uint64), side="right")
            ends = np.append(at, len(entry))
            for k, i, j in zip(to.tolist(), low.tolist(), high.tolist()):
                e, f = ends[i], ends[j]
                rest = other[i:j]
                columns = [np.diff(route[i:j]), kind[i:j] + (n_texts[i:j] << 2), rest[(kind[i:j] == 1) | (kind[i:j] == 2)], rest[kind[i:j] == 3]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array(name.view(np.int64)), pa.array([len(to) if k == home else 0], pa.int32()), pa.array([j - i], pa.int32()),
                     pa.array(route[i:i + 1].view(np.int64) if j > i else [0], pa.int64()),
                     *(pa.array([packed(x)], pa.binary()) for x in columns),
                     pa.array([int(f - e).to_bytes(8, "little")], pa.binary()), pa.array([packed(place[e:f])], pa.binary()), pa.array([packed(times[e:f])], pa.binary()),
                     pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own) if k == home else pa.array([None], pa.list_(own.type))],
                    names=["shard", "block", "parts", "pairs", "first_route", "routes", "kinds", "numbers", "hashes", "places", "texts", "times", "own"])

        texts = 0
        for part in textops.slices(batches, "text"):
            parts.append(looked_up(part, texts))
            texts += part.num_rows
            size += int(parts[-1][0][1].sum())
            if size >= BLOCK_TOKENS:
                yield from block(parts, done)
                parts, size, texts, done = [], 0, 0, done + 1
        if parts:
            yield from block(parts, done)
    return run


def answer_task(model_shared, exact_shared):
    """Per block: the sums of its texts over the pairs of this shard, and what came with it."""
    def run(batches):
        batches = [x for x in batches if x.num_rows]
        if not batches:
            return
        model, (_, exact) = model_shared.value, exact_shared.value
        smooth, strength = model.total, model.strength
        after = strength_after(exact, strength, model.free)
        rows = [dict(zip(x.schema.names, row)) for x in (y.select(["pairs", "first_route", "routes", "kinds", "numbers", "hashes", "places", "texts", "times"]) for y in batches)
                for row in zip(*(c.to_pylist() for c in x.columns))]
        pairs, entries = [], []
        for k, row in enumerate(rows):
            n = row["pairs"]
            if n:
                steps = np.concatenate([np.array([row["first_route"]]).view(np.uint64), unpacked(row["routes"], n - 1)])
                kinds = unpacked(row["kinds"], n)
                kind, other = (kinds & np.uint64(3)).astype(np.uint8), np.zeros(n, np.uint64)
                for column, some in (("numbers", (kind == 1) | (kind == 2)), ("hashes", kind == 3)):
                    other[some] = unpacked(row[column], int(some.sum()))
                pairs.append((kind, np.cumsum(steps, dtype=np.uint64), other, (kinds >> np.uint64(2)).astype(np.int64)))
                many = int.from_bytes(row["places"], "little")
                place, times = unpacked(row["texts"], many), unpacked(row["times"], many).astype(np.int32)
                entries.append(((place >> np.uint64(1)).astype(np.int64) + (k << 32), (place & np.uint64(1)).astype(bool), times))
        if pairs:
            kind, route, other, n_texts = (np.concatenate(x) for x in zip(*pairs))
            at, learned, times = (np.concatenate(x) for x in zip(*entries))
            del pairs, entries
            learned = np.add.reduceat(times * learned, np.cumsum(n_texts) - n_texts)
            order = by_address(kind, route, other)
            kind, route, other, learned = kind[order], route[order], other[order], learned[order]
            # a rare token counts as often as it is the second of a pair
            second_rare, second = kind >= SECOND_RARE, np.zeros(len(kind), np.int64)
            c = np.zeros(len(kind))
            if second_rare.any():
                group = np.cumsum(changes(route[second_rare])) - 1
                c[second_rare] = np.bincount(group, learned[second_rare])[group]
            group = np.cumsum(changes(route, kind, other)) - 1
            n = np.bincount(group, learned)[group]
            s = np.full(len(kind), strength)
            if len(exact):
                both = unmixed(route)
                second[kind == 0] = (both[kind == 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                s[kind == 0] = after[(both[kind == 0] >> np.uint64(32)).astype(np.int64)]
                second[kind == FIRST_RARE] = other[kind == FIRST_RARE].astype(np.int64)
                s[kind == SECOND_RARE] = after[other[kind == SECOND_RARE].astype(np.int64)]
                c = np.where(second_rare, c, exact[second])
            more = np.log10(1 + n * smooth / (s * (c + 0.5))) + np.where(second_rare, np.log10(strength / (c + strength)), 0.0)
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            back = np.repeat(back, n_texts)
            at, spot = np.unique(at, return_inverse=True)
            more = np.bincount(spot, more[back] * times)
            rare = np.bincount(spot, second_rare[back]) > 0
            base = np.bincount(spot, np.where(second_rare, np.log10(c + 0.5), 0.0)[back] * times)
            known = np.bincount(spot, (second_rare & (c > 0))[back] * times).astype(np.int64)
        else:
            at, more, rare, base, known = (np.zeros(0, kind) for kind in (np.int64, float, bool, float, np.int64))
        bounds, k = np.searchsorted(at >> 32, np.arange(len(rows) + 1)), 0
        for x in batches:
            columns = [[], [], [], [], []]
            for i in range(k, k + x.num_rows):
                here = slice(bounds[i], bounds[i + 1])
                some = np.flatnonzero(rare[here])
                values = (packed(np.diff(at[here] & 0xFFFFFFFF, prepend=0)), more[here].tobytes(), packed(np.diff(some, prepend=0)), packed(known[here][some]), base[here][some].tobytes())
                for column, value in zip(columns, values):
                    column.append(value)
            k += x.num_rows
            yield pa.RecordBatch.from_arrays(
                [x.column("block"), x.column("parts"), *(pa.array(column, pa.binary()) for column in columns), x.column("own")],
                names=["block", "parts", "at", "more", "rare", "known", "base", "own"])
    return run


def block_scores(table: pa.Table) -> pa.Table:
    """(doc_id, n_tokens, n_known, base_sum, more) of the texts of a block."""
    homes = [i for i, n in enumerate(table.column("parts").to_pylist()) if n]
    if len(homes) != 1 or table.column("parts")[homes[0]].as_py() != table.num_rows:
        raise RuntimeError("a repeated task read the texts in another order: write the documents as a table first")
    own = table.column("own").combine_chunks()
    own = (own if isinstance(own, pa.Array) else own.chunk(0)).flatten()
    own = pa.RecordBatch.from_struct_array(own)
    known_sum, base_sum, more_sum = (own.column(name).to_numpy().copy() for name in ("n_frequent", "frequent_sum", "held_sum"))
    for at, more, rare, known, base in zip(*(table.column(name).to_pylist() for name in ("at", "more", "rare", "known", "base"))):
        more, base = np.frombuffer(more), np.frombuffer(base)
        at = np.cumsum(unpacked(at, len(more)).astype(np.int64))
        more_sum[at] += more
        at = at[np.cumsum(unpacked(rare, len(base)).astype(np.int64))]
        base_sum[at] += base
        known_sum[at] += unpacked(known, len(base)).astype(np.int64)
    return pa.table([own.column("doc_id"), own.column("n_tokens"), pa.array(known_sum), pa.array(base_sum), pa.array(more_sum)], names=["doc_id", "n_tokens", "n_known", "base_sum", "more"])


def build_filter(grams: DataFrame, entries: int, least: tuple[float, float]) -> np.ndarray:
    """Bits of the filter over (token, n, pair) rows."""
    size = 1 << max(12, int(np.ceil(np.log2(max(1, entries) * BITS_PER_ENTRY))))
    rows = grams.mapInArrow(bit_task(size, least), "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return bits


def score_texts(docs: DataFrame, learn: Column, frequent: float = FREQUENT, pair_token: float = PAIR_TOKEN,
                held_pair: float = HELD_PAIR, strength: float = STRENGTH) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row; ``learn`` says which rows train."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("train"))
    train = texts.filter("train").select("text")
    counts = written(texts.select("text", "train").mapInArrow(token_task, "token long, n long, c long")
                     .groupBy("token").agg(F.sum("n").alias("n"), F.sum("c").alias("c")), "counts")
    total, distinct, every = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    top = counts.filter(((F.col("c") > 0) & (F.col("c") >= frequent * total)) | (F.col("n") >= frequent * every)).toArrow()
    tokens = top.column("token").to_numpy().view(np.uint64)
    exact = top.column("c").to_numpy()
    order = np.argsort(tokens)
    tokens, exact = tokens[order], exact[order]
    exact_shared = spark.sparkContext.broadcast((tokens, exact))
    pair_table = tokens[(exact > 0) & (exact >= pair_token * total)]
    pair_tokens = spark.sparkContext.broadcast(pair_table)
    least = (1.0, max(1.0, held_pair * total))
    grams = written(train.mapInArrow(code_task(pair_tokens), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
                    .filter(F.col("n") >= least[1]).withColumn("pair", F.lit(True)), "pairs")
    level = 1 + F.floor(F.log2(F.col("n") / F.lit(least[1])) + 1e-9)
    entries = grams.agg(F.coalesce(F.sum(level), F.lit(0))).first()[0]
    smooth = float(total + 0.5 * (distinct + 1))
    model_shared = spark.sparkContext.broadcast(Model(build_filter(grams, entries, least), least, smooth, strength, pair_table, frequent * total))
    shards = max(parts_of(docs), -(-every // TASK_TOKENS))
    asked = texts.mapInArrow(ask_task(model_shared, exact_shared, shards), ASKED.format(kind=kind)).repartitionById(shards, "shard")
    answered = asked.mapInArrow(answer_task(model_shared, exact_shared), ANSWERED.format(kind=kind))
    summed = answered.groupBy("block").applyInArrow(block_scores, f"doc_id {kind}, n_tokens long, n_known long, base_sum double, more double")
    base_score = F.col("base_sum") - F.col("n_tokens") * float(np.log10(smooth))
    trained = lambda score: F.when(F.lit(total > 0), score).otherwise(0.0)
    return summed.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                         trained(base_score).alias("base_score"), trained(base_score + F.col("more")).alias("score"))


def held_out() -> Column:
    return F.coalesce(fold("doc_id", 5) == 1, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """Contract of op10: one row per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs, ~held_out()).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
