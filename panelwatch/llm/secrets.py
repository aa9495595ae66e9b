"""Secret scan with a character convolutional network (operator 6).

Base findings come from three patterns over whole texts. Every other token of at least eight characters of letters,
digits and the signs of encoded keys (dots inside) is a candidate, unless it is made of plain words and numbers: some
part of it must mix letters and digits, or capitals and small letters, or be a run of 20 letters. A small convolutional
network in numpy reads each candidate and its surroundings: one-hot characters, one convolution, the largest response of
each filter, one output.

Training: base findings are the labelled findings. Their value is what is learned: the words and signs of the pattern
before it are blanked out. Each also stands once with a value of another shape in the same place (another alphabet and
length, with or without a prefix or dots, drawn by a hash of the value), because keys of other shapes have no pattern to be
labelled by. Negative are all candidates outside the base findings, and the whole rest of the texts: everything outside the
findings is cut into windows such that each run of ``WIDTH`` symbols lies in one, and each window stands once more with one
of its words put together the way names are (a number behind or between, capitals inside). Nothing is sampled: every window
of every text takes part. Texts are dealt to buckets of about ``BUCKET_BYTES``, and the windows of findings and candidates to the
same buckets (to several, if there are few of them). The network starts from one bucket; then every bucket goes on from
there over all of its windows, and the weights of all buckets are averaged. A third of the windows, by their hash, which
training does not see, calibrates the output by a logistic curve, and the threshold is the largest one that keeps
``recall`` of all positive windows there. ``Network.report`` holds threshold, recall and precision on that third.
Candidates at or above the threshold are further findings; base findings are always reported.

Candidates longer than a window are read in overlapping windows to their end; the largest output counts. Findings are
spans in code points, end exclusive.

Defined results: null and empty texts have no findings; without a base finding, or without any other token, in the corpus
there is no model and only base findings are reported; repeated rows are scanned each; further columns are left alone.
"""

from __future__ import annotations

import hashlib
import pickle
import random
import re
import string
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwatch.llm import textops
from panelwatch.llm.common import written
from panelwatch.llm.toxicity import logistic

# The patterns and the least lengths of their findings.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
ASSIGN_LENGTH, ACCESS_LENGTH = 6, 20

MODEL_KIND = "model"
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_=.-]{6,}[A-Za-z0-9+/_=-]")
MIXED = re.compile(r"[A-Za-z][0-9]|[0-9][A-Za-z]|[a-z][A-Z]|[A-Z]{2}[a-z]|[A-Za-z]{20}")
#: A whole word of letters in a window's symbols, after an empty place.
WORD = re.compile(rb"(?<=[\x00\x01])[\x22-\x3b\x42-\x5b]{6,}(?=[\x00\x01])")

BEFORE, WINDOW, STEP = 20, 64, 32
SYMBOLS = 97  # 0 outside the text, 1-95 printable ASCII, 96 all others
FILTERS, WIDTH = 24, 5
TILE = WINDOW - WIDTH + 1
#: Text in a bucket, findings a bucket has at least, training steps in the first bucket and in each later one at least.
BUCKET_BYTES, BUCKET_FINDINGS, FIRST_STEPS, LATER_STEPS = 16 << 20, 200, 600, 200
#: Windows a training step takes of findings, of candidates and of the rest; the part of candidates in the negative weight.
STEP_SIZES, OTHER_SHARE = (64, 64, 1024), 1 / 3
#: Logits are added up by bins of this many parts for the calibration.
BINS = 64
#: Alphabets of made-up values, as (letters, what may stand before, parts with dots between).
SHAPES = [
    (string.ascii_letters + string.digits, "", 1), (string.ascii_letters + string.digits, "{}_", 1), (string.ascii_letters + string.digits, "{}-", 1),
    (string.ascii_letters + string.digits + "+/", "", 1), (string.ascii_letters + string.digits + "_-", "", 3),
    (string.ascii_uppercase + string.digits, "", 1), (string.ascii_letters, "", 1),
]


def base_findings(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), leftmost without overlap for each kind, those too short dropped."""
    out, low = [], text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda f: (f[0], KINDS.index(f[2])))


def covered(findings: list) -> tuple[list[int], list[int]]:
    """Starts and ends of the places that findings cover, without overlap and in order."""
    starts, ends = [], []
    for start, end, _ in findings:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def overlaps(start: int, end: int, places: tuple[list[int], list[int]]) -> bool:
    at = bisect_left(places[0], end) - 1
    return at >= 0 and places[1][at] > start


def candidates(text: str, places: tuple[list[int], list[int]]) -> list[tuple[int, int]]:
    """Tokens outside the base findings that are not made of plain words and numbers."""
    return [m.span() for m in CANDIDATE.finditer(text) if MIXED.search(m.group()) and not overlaps(m.start(), m.end(), places)]


def blanked(text: str, places: tuple[list[int], list[int]]) -> str:
    """The text with its base findings as empty places, so that a key beside a candidate does not speak for it."""
    parts, at = [], 0
    for start, end in zip(*places):
        parts += [text[at:start], "\0" * (end - start)]
        at = end
    return "".join(parts) + text[at:] if parts else text


def values(text: str, findings: list) -> list[tuple[int, int, int]]:
    """(start of the finding, start and end of its value) of each base finding."""
    out = []
    for start, end, kind in findings:
        m = ASSIGN.match(text, start) if kind == "assign" else None
        out.append((start, m.start(2) if m else start, end))
    return out


def other_shape(value: str) -> str:
    """A made-up value, the same for the same ``value``."""
    r = random.Random(signed(value.encode()))
    letters, before, parts = r.choice(SHAPES)
    prefix = before.format("".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(2, 5))))
    return prefix + ".".join("".join(r.choice(letters) for _ in range(r.randint(12, 44) // parts + 1)) for _ in range(parts))


def windows(text: str, start: int, end: int) -> list[bytes]:
    """Symbols of the candidate with its surroundings, in as many windows as it takes."""
    out, at = [], start - BEFORE
    while True:
        part = text[max(0, at):max(0, at + WINDOW)]
        codes = bytes(ord(c) - 31 if " " <= c <= "~" else 96 if c != "\0" else 0 for c in part)
        out.append(b"\0" * max(0, -at) + codes + b"\0" * (WINDOW - max(0, -at) - len(codes)))
        at += STEP
        if at + WINDOW - STEP >= end:
            return out


def glued(word: str, number: int) -> str:
    """A plain word as names are made of words: with a number behind or inside, or in two capitalised parts."""
    cut, kind = 1 + number // 4 % len(word), number // 64 % 4
    if kind == 0:
        return f"{word}{number % 10_000}"
    if kind == 1:
        return f"{word[:cut].title()}{word[cut:].title()}{word.title()}"
    return f"{word[:cut]}{2000 + number % 50 if kind == 2 else number % 1000}{word[cut:]}{word if number % 2 else ''}"


def positive_windows(text: str, findings: list):
    """Of each base finding its value with the pattern blanked out, and a value of another shape in its place."""
    for start, first, end in values(text, findings):
        own = windows(text, first, end)[0]
        blank = min(BEFORE, first - start)
        yield own[:BEFORE - blank] + b"\0" * blank + own[BEFORE:]
        made = other_shape(text[first:end])
        before, after = text[max(0, start - BEFORE):start], text[end:end + WINDOW]
        yield windows(before + made + after, len(before), len(before) + len(made))[0]


def tiles(text: str, places: tuple[list[int], list[int]]) -> np.ndarray:
    """The text with its base findings blanked out, in windows that share ``WIDTH`` - 1 symbols; empty ones left out."""
    codes = np.frombuffer(blanked(text, places).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = np.where((codes >= 32) & (codes <= 126), codes - 31, np.where(codes > 0, 96, 0)).astype(np.uint8)
    n = max(1, -(-(len(symbols) - WIDTH + 1) // TILE))
    padded = np.zeros(n * TILE + WIDTH - 1, np.uint8)
    padded[:len(symbols)] = symbols
    rows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::TILE]
    return rows[(rows > 1).any(1)]


def twins(rows: np.ndarray) -> np.ndarray:
    """The windows that hold a whole word, with the first one put together the way names are."""
    joined, made, out = rows.tobytes(), {}, []
    for at in range(0, len(joined), WINDOW):
        window = joined[at:at + WINDOW]
        m = WORD.search(window)
        if m:
            word = m.group()
            if word not in made:
                plain = bytes(x + 31 for x in word)
                made[word] = bytes(ord(c) - 31 for c in glued(plain.decode(), zlib.crc32(plain)))
            out.append((window[:m.start()] + made[word] + window[m.end():])[:WINDOW].ljust(WINDOW, b"\0"))
    return as_windows(out)


def as_windows(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, WINDOW)


def held_back(rows: np.ndarray) -> np.ndarray:
    """The third of the windows, by their hash, that training does not see."""
    h = np.zeros(len(rows), np.uint64)
    for part in np.ascontiguousarray(rows).view(np.uint64).T:
        h = textops.mix(h * textops.GOLD + part)
    return h % np.uint64(3) == 2


def rest_windows(texts: list[str | None], held: bool) -> np.ndarray:
    """All windows of the texts outside their base findings that are held back or not, and the same ones with names."""
    own = [tiles(t or "", covered(base_findings(t or ""))) for t in texts]
    rows = np.concatenate([np.zeros((0, WINDOW), np.uint8), *own])
    rows = rows[held_back(rows) == held]
    return np.concatenate([rows, twins(rows)])


def dealt_from(text: str | None) -> int:
    """First of the numbers by which the rows of a task are dealt to buckets, by a hash of its first text."""
    return zlib.crc32((text or "").encode("utf-8", "surrogatepass"))


def window_task(batches):
    """(number, positive, window): the windows of findings and of candidates, with a number that deals them."""
    number = None
    for part in textops.slices(batches, "text"):
        out = []
        for text in part.column("text").to_pylist():
            text = text or ""
            found = base_findings(text)
            out += [(True, w) for w in positive_windows(text, found)]
            places = covered(found)
            rest = blanked(text, places)
            out += [(False, w) for start, end in candidates(text, places) for w in windows(rest, start, end)]
        if out:
            number = dealt_from(part.column("text")[0].as_py()) if number is None else number
            numbers = np.arange(number, number + len(out))
            number += len(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int64()), pa.array([p for p, _ in out], pa.bool_()), pa.array([w for _, w in out], pa.binary())], names=["number", "positive", "window"])


def number_task(batches):
    """(number, text) of the rows."""
    number = None
    for part in batches:
        texts = part.column("text")
        if len(texts):
            number = dealt_from(texts[0].as_py()) if number is None else number
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + len(texts)), pa.int64()), texts], names=["number", "text"])
            number += len(texts)


def signed(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


class Network:
    """Convolution over one-hot characters, largest response per filter, one output."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.kernel = r.normal(0, 0.15, (WIDTH, SYMBOLS, FILTERS)).astype(np.float32)
        self.kernel[:, 0] = 0
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = r.normal(0, 0.3, FILTERS).astype(np.float32)
        self.offset = np.float32(0)
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5
        self.report: dict[str, float] = {}

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The responses of the kernel's first and second two places to two symbols each."""
        return tuple((self.kernel[k][:, None] + self.kernel[k + 1][None]).reshape(-1, FILTERS) for k in (0, 2))

    def forward(self, symbols: np.ndarray, tables: tuple | None = None):
        """A one-hot convolution is a sum of looked-up rows; the largest response of each filter and, without ``tables``, its place."""
        first, second = tables or self.tables()
        at = np.ascontiguousarray(symbols.T).astype(np.intp)
        pairs = at[:-1] * SYMBOLS + at[1:]
        top = np.full((len(symbols), FILTERS), -np.inf, np.float32)
        where = None if tables else np.zeros(top.shape, np.intp)
        for step in range(WINDOW - WIDTH + 1):
            response = first.take(pairs[step], axis=0, mode="clip")
            response += second.take(pairs[step + 2], axis=0, mode="clip")
            response += self.kernel[4].take(at[step + 4], axis=0, mode="clip")
            if where is None:
                np.maximum(top, response, out=top)
            else:
                more = response > top
                np.copyto(top, response, where=more)
                np.copyto(where, step, where=more)
        hidden = np.maximum(top + self.bias, 0)
        return hidden @ self.out + self.offset, hidden, where

    def learn(self, kinds: list[np.ndarray], least: int, rate: float, seed: int = 7) -> None:
        """Steps over the windows of findings, candidates and the rest until each was seen once, ``least`` steps at least.

        A kind with fewer windows than the steps take is gone through again.
        """
        r = np.random.default_rng(seed)
        shares = [0.5, 0.5 * OTHER_SHARE * bool(len(kinds[1]))]
        shares.append(1 - sum(shares))
        orders = [r.permutation(len(k)) for k in kinds]
        names = ("kernel", "bias", "out", "offset")
        moments = {n: [np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))] for n in names}
        for step in range(1, max(least, *(-(-len(k) // n) for k, n in zip(kinds, STEP_SIZES))) + 1):
            picked = [k[np.take(o, np.arange((step - 1) * n, step * n), mode="wrap")] if len(k) else k for k, o, n in zip(kinds, orders, STEP_SIZES)]
            x = np.concatenate(picked)
            weight = np.concatenate([np.full(len(p), s / max(len(p), 1)) for p, s in zip(picked, shares)])
            target = np.arange(len(x)) < len(picked[0])
            logit, hidden, where = self.forward(x)
            slope = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target) * weight).astype(np.float32)
            back = slope[:, None] * self.out[None] * (hidden > 0)
            sums = [np.bincount((np.take_along_axis(x, where + k, 1) * np.intp(FILTERS) + np.arange(FILTERS)).ravel(), back.ravel(), SYMBOLS * FILTERS) for k in range(WIDTH)]
            grads = {"kernel": np.array(sums, np.float32).reshape(self.kernel.shape), "bias": back.sum(0), "out": hidden.T @ slope + np.float32(1e-4) * self.out, "offset": slope.sum()}
            for n in names:
                m, v = moments[n]
                m[...] = 0.9 * m + 0.1 * grads[n]
                v[...] = 0.999 * v + 0.001 * grads[n] ** 2
                setattr(self, n, (getattr(self, n) - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32))

    def weights(self) -> np.ndarray:
        return np.concatenate([self.kernel.ravel(), self.bias, self.out, [self.offset]])

    def set_weights(self, values: np.ndarray) -> None:
        cuts = np.cumsum([self.kernel.size, FILTERS, FILTERS])
        kernel, self.bias, self.out, offset = np.split(values.astype(np.float32), cuts)
        self.kernel, self.offset = kernel.reshape(self.kernel.shape), offset[0]

    def logits(self, rows: np.ndarray) -> np.ndarray:
        tables = self.tables()
        return np.concatenate([np.zeros(0), *(self.forward(rows[at:at + 1024], tables)[0] for at in range(0, len(rows), 1024))])

    def probability(self, symbols: np.ndarray) -> np.ndarray:
        return self.squashed(self.forward(symbols)[0])

    def squashed(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -30, 30)))


def bucket_task(shared, least: int, rate: float):
    """(place, value): the weights after all training windows of one bucket."""
    def run(table):
        loose = table.filter(pc.is_valid(table["window"])).sort_by([("number", "ascending"), ("window", "ascending")])
        texts = table.filter(pc.is_null(table["window"])).sort_by([("number", "ascending"), ("text", "ascending")])
        kinds = [as_windows(loose.filter(pc.equal(loose["positive"], mine))["window"].to_pylist()) for mine in (True, False)]
        kinds = [k[~held_back(k)] for k in kinds] + [rest_windows(texts["text"].to_pylist(), False)]
        values = np.zeros(0)
        if len(kinds[0]) and len(kinds[1]) + len(kinds[2]):
            network = pickle.loads(shared.value)
            network.learn(kinds, least, rate)
            values = network.weights()
        return pa.table([pa.array(np.arange(len(values)), pa.int32()), pa.array(values, pa.float64())], names=["place", "value"])
    return run


def held_task(shared, findings: bool):
    """(positive, logit, n) of the windows held back, of findings and candidates or of the rest; those of negative ones by bins."""
    def given(network, rows, positive):
        said = network.logits(rows)
        n = np.ones(len(said), np.int64)
        if not positive:
            said, n = np.unique(np.floor(np.clip(said, -40, 40) * BINS) / BINS, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([positive] * len(said), pa.bool_()), pa.array(said, pa.float64()), pa.array(n, pa.int64())], names=["positive", "logit", "n"])

    def run(batches):
        network = pickle.loads(shared.value)
        if not findings:
            yield from (given(network, rest_windows(part.column("text").to_pylist(), True), False) for part in textops.slices(batches, "text"))
            return
        for part in batches:
            rows, positive = as_windows(part.column("window").to_pylist()), part.column("positive").to_numpy(zero_copy_only=False).astype(bool)
            held = held_back(rows)
            yield from (given(network, rows[held & (positive == mine)], mine) for mine in (True, False))
    return run


def fit(docs: DataFrame, sample: int | None = None, recall: float = 0.99) -> Network | None:
    """The network trained, calibrated and given its threshold on all texts of ``docs``; ``sample`` has no effect any more."""
    context, docs = docs.sparkSession.sparkContext, docs.select("text")
    rows = written(docs.mapInArrow(window_task, "number long, positive boolean, window binary"), "windows")
    findings = rows.filter("positive").count()
    if not findings:
        return None
    buckets = max(1, -(-docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // BUCKET_BYTES))
    copies = min(buckets, -(-buckets * BUCKET_FINDINGS // findings))

    def bucket(shift) -> Column:
        return F.pmod(F.col("number") + shift, F.lit(buckets)).alias("bucket")

    texts = docs.mapInArrow(number_task, "number long, text string").select(
        bucket(0), "number", "text", F.lit(None).cast("boolean").alias("positive"), F.lit(None).cast("binary").alias("window"))
    dealt = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("positive"), copies - 1).otherwise(0)))).select(
        bucket(F.col("copy")), "number", F.lit(None).cast("string").alias("text"), "positive", "window")
    everything = texts.union(dealt)

    def trained(some: DataFrame, network: Network, least: int, rate: float) -> Network | None:
        shared = context.broadcast(cloudpickle.dumps(network))
        values = (some.groupBy("bucket").applyInArrow(bucket_task(shared, least, rate), "place int, value double")
                  .groupBy("place").agg(F.round(F.avg("value"), 6).alias("value")).orderBy("place").toPandas()["value"].to_numpy())
        if not len(values):
            return None
        network.set_weights(values)
        return network

    first = Network()
    network = trained(everything.filter("bucket = 0"), first, FIRST_STEPS, 0.02)
    if buckets > 1:
        network = trained(everything, network or first, LATER_STEPS, 0.005)
    if network is None:
        return None
    shared, kind = context.broadcast(cloudpickle.dumps(network)), "positive boolean, logit double, n long"
    held = written(rows.mapInArrow(held_task(shared, True), kind).union(docs.mapInArrow(held_task(shared, False), kind)), "held")
    bins = held.groupBy("positive", (F.floor(F.col("logit") * BINS) / BINS).alias("logit")).agg(F.sum("n").alias("n")).orderBy("positive", "logit").toPandas()
    if len(bins):
        mine = bins["positive"].to_numpy(bool)
        count = bins["n"].to_numpy(float)
        network.slope, network.shift = logistic(bins["logit"].to_numpy(float), count * mine, count * ~mine)
        total, least = int(count[mine].sum()), 0.0
        if total:
            least = held.filter("positive").orderBy("logit").offset(int((1 - recall) * total)).limit(1).first().logit
            network.threshold = float(network.squashed(np.array([least]))[0])
        else:
            least = (np.log(network.threshold / (1 - network.threshold)) - network.shift) / (network.slope or 1.0)
        hits = {r.positive: r.n for r in held.filter(F.col("logit") >= float(least)).groupBy("positive").agg(F.sum("n").alias("n")).collect()}
        network.report = {"threshold": network.threshold, "recall": hits.get(True, 0) / total if total else 0.0,
                          "precision": hits.get(True, 0) / sum(hits.values()) if hits else 0.0}
    return network


def scan_task(shared):
    def run(batches):
        network = pickle.loads(shared.value)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
        for part in textops.slices(batches, "text"):
            found, asked = [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                base = base_findings(text or "")
                found.append([(s, e, k, 1.0) for s, e, k in base])
                if network is not None:
                    places = covered(base)
                    rest = blanked(text or "", places)
                    asked += [(i, s, e, windows(rest, s, e)) for s, e in candidates(text or "", places)]
            for at in range(0, len(asked), 512):
                some = asked[at:at + 512]
                p = network.probability(np.array([np.frombuffer(w, np.uint8) for x in some for w in x[3]]).astype(np.int64))
                ends = np.cumsum([len(x[3]) for x in some])
                for (i, s, e, w), end in zip(some, ends):
                    best = float(p[end - len(w):end].max())
                    if best >= network.threshold:
                        found[i].append((s, e, MODEL_KIND, best))
            order = (*KINDS, MODEL_KIND).index
            values = [[{"kind": k, "start": s, "end": e, "probability": p} for s, e, k, p in sorted(f, key=lambda x: (x[0], order(x[2])))] for f in found]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values, kind)], names=["doc_id", "findings"])
    return run


def find_secrets(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, findings): spans by start, then kind, with the network's probability (1 for base findings)."""
    # by value: executors need no copy of this package
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(network))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        scan_task(shared), f"doc_id {kind}, findings array<struct<kind:string,start:bigint,end:bigint,probability:double>>")


def query(spark, sf_dir: str) -> DataFrame:
    """Contract of op6: one row per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = find_secrets(docs, fit(docs))

    def count(kind: str):
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(entries):
        return F.array_join(F.transform(entries, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = joined(F.filter("findings", lambda x: x["kind"] != MODEL_KIND))
    return rows.select("doc_id", *(count(k) for k in KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
