"""Main text of web pages (operator 12).

Each page is read into blocks (:mod:`panelwatch.llm.markup`): what menus, headers, footers, sidebars, notices, adverts,
forms, scripts and reader comments hold is left out by element, class, id and role, and where a page marks its article
only that stays. What still repeats from page to page is found by suffix arrays per host. The token streams of a host's
distinct pages are concatenated, with a mark at each end of a block, and their suffixes are ranked by prefix
doubling over numpy arrays. The ranks after j rounds name all substrings of 2^j tokens, and a pair of them names any
longer one, so whole blocks and runs of ``LONG`` tokens get one name per different substring and are counted over
distinct pages. Where a run is boilerplate:

* a whole block goes if at least ``STRONG`` pages and half of the host's distinct pages hold it;
* where the page marks no article, runs of ``LONG`` tokens and blocks go that ``WEAK`` pages and a quarter of the host's
  hold; what is left of a block (its unique runs) stays.

A passage that some articles share is no boilerplate by these shares, and inside an article blocks only go whole.

Data flow: a host with more than ``HOST_BYTES`` is dealt into shards by the hash of the page's stream, so identical
pages meet and count once; each shard has its own suffix array, and the counts of the runs that at least two of its
pages hold are added over the shards (so of such a host a count leaves out a page that is the only one of its shard with
a run: at most one page in 4 MB). A task builds one array over several small hosts or one shard at a time. The runs
that are boilerplate come back to the pages by a join on the host, which adaptive execution broadcasts or splits.

Defined results: null and empty html give an empty text; a page is judged by its own blocks alone if its url is null or
names no host; repeated rows are extracted each and count once for the shares; empty tables give empty results; pages of
any length are read whole; columns other than the named ones are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwatch.llm import textops
from panelwatch.llm.common import written
from panelwatch.llm.markup import blocks

LONG = 8
STRONG, STRONG_SHARE = 5, 0.5
WEAK, WEAK_SHARE = 3, 0.25
#: Text of a host beyond which it is dealt into shards, and text of one suffix array.
HOST_BYTES = 4 << 20
SALTS = 16
MARK = "\x01"
ODD = np.uint64(0xD6E8FEB86659FD93)
ODD_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """Host of a url in lower case, null without one."""
    return F.nullif(F.regexp_extract(F.lower(url), HOST, 1), F.lit(""))


def stream_of(texts: list[str]) -> str:
    """The blocks of a page with a mark before each and after the last."""
    return f"{MARK} " + "".join(f"{t} {MARK} " for t in texts)


def stream_task(batches):
    """(host, page, size, stream): the token stream of each page that has text."""
    for part in textops.slices(batches, "html"):
        streams = [stream_of(found[0]) if h and (found := blocks(h))[0] else None for h in part.column("html").to_pylist()]
        column = pa.array(streams, pa.string())
        hashes, counts = textops.word_hashes(column, spaces_only=True)
        key = textops.grams(hashes, counts, 1)[0] * np.uint64(2) + np.uint64(1)
        place = np.arange(len(key), dtype=np.uint64)
        total = np.concatenate([[np.uint64(0)], np.cumsum(textops.mix(key ^ textops.mix(place - np.repeat(np.cumsum(counts) - counts, counts).astype(np.uint64))))])
        ends = np.cumsum(counts)
        page = textops.mix(total[ends] - total[ends - counts])
        keep = pa.array([s is not None for s in streams])
        yield pa.RecordBatch.from_arrays(
            [part.column("host"), pa.array(page.view(np.int64)), column], names=["host", "page", "stream"]).filter(keep)


def suffix_ranks(tokens: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4 ... tokens; the last level orders whole suffixes.

    A rank is the number of suffixes that are smaller, so a suffix that is already alone keeps its rank and is not
    sorted again.
    """
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(tokens[order]) != 0))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    levels, width = [rank.astype(np.int32)], 1
    while True:
        sizes = np.bincount(rank, minlength=n)
        active = np.flatnonzero(sizes[rank] > 1)
        if not len(active) or width >= n:
            return levels
        after = active + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        by = np.lexsort((second, rank[active]))
        active, second = active[by], second[by]
        group = rank[active]
        new_group = np.append(True, np.diff(group) != 0)
        new = new_group | np.append(True, np.diff(second) != 0)
        place = np.arange(len(active))
        starts = np.maximum.accumulate(np.where(new, place, 0))
        group_starts = np.maximum.accumulate(np.where(new_group, place, 0))
        rank = rank.copy()
        rank[active] = group + starts - group_starts
        levels.append(rank.astype(np.int32))
        width *= 2


def names_of(levels: list[np.ndarray], starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One number per different substring; substrings are equal if the ranks of their first and last 2^j tokens are."""
    if not len(starts):
        return np.zeros(0, np.int64)
    level = np.minimum(np.log2(np.maximum(lengths, 1)).astype(np.int64), len(levels) - 1)
    first, last = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    for number, ranks in enumerate(levels):
        own = np.flatnonzero(level == number)
        first[own] = ranks[starts[own]]
        last[own] = ranks[starts[own] + np.maximum(lengths[own] - (1 << number), 0)]
    pair = np.unique(first * len(levels[0]) + last, return_inverse=True)[1].reshape(-1)
    return np.unique(pair * (int(lengths.max()) + 1) + lengths, return_inverse=True)[1].reshape(-1)


def spans_of(tokens: np.ndarray, mark: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of all whole blocks (with their marks) and of all runs of ``LONG`` tokens inside pages."""
    marks = np.flatnonzero(tokens == mark)
    page = textops.row_of(counts)
    same = page[marks[:-1]] == page[marks[1:]]
    block = marks[:-1][same]
    block_length = marks[1:][same] - block + 1
    left = np.cumsum(counts)[page] - np.arange(len(tokens))
    runs = np.flatnonzero(left >= LONG)
    return np.append(block, runs), np.append(block_length, np.full(len(runs), LONG))


def span_hashes(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of tokens, by sums of powers."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = int((starts + lengths).max())
    powers, back = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(total, x)])) for x in (ODD, ODD_INVERSE))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes[:total] * powers[:total])])
    # times the inverse power of the start, so that a span has one hash wherever it stands
    return textops.mix((sums[starts + lengths] - sums[starts]) * back[starts] ^ textops.mix(lengths.astype(np.uint64)))


def repeated_runs(hosts: np.ndarray, pages: np.ndarray, streams: pa.Array):
    """(host, run, pages) of runs that at least two distinct pages of a host hold, and (host, 0, distinct pages).

    ``hosts``: numbers; all pages of a host's shard are there.
    """
    keep = np.unique(np.stack([hosts, pages], 1), axis=0, return_index=True)[1]
    hosts, streams = hosts[keep], streams.take(pa.array(keep))
    hashes, counts = textops.word_hashes(streams, spaces_only=True)
    mark = textops.word_hashes(pa.array([MARK]), spaces_only=True)[0][0]
    page = textops.row_of(counts)
    # equal tokens of different hosts are different, and pages end in tokens of their own
    own = textops.mix(hashes ^ textops.mix(hosts[page].astype(np.uint64)))
    tokens = np.unique(own, return_inverse=True)[1].reshape(-1).astype(np.int64)
    at = np.cumsum(counts)
    tokens = np.insert(tokens, at, len(tokens) + np.arange(len(counts)))
    levels = suffix_ranks(tokens)
    starts, lengths = spans_of(hashes, mark, counts)
    name = names_of(levels, starts + page[starts], lengths)
    where = np.unique(name * len(counts) + page[starts])
    support = np.bincount(where // len(counts))
    one = np.zeros(len(support), np.int64)
    one[name] = np.arange(len(name))
    often = np.flatnonzero(support >= 2)
    ids = one[often]
    listed, distinct = np.unique(hosts, return_counts=True)
    return (np.append(hosts[page[starts[ids]]], listed),
            np.append(span_hashes(hashes, starts[ids], lengths[ids]), np.zeros(len(listed), np.uint64)), np.append(support[often], distinct))


def run_task(limit: int):
    """Rows sorted by host and shard to the runs of each; several small hosts share one suffix array."""
    def close(rows):
        batch = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        names, hosts = np.unique(np.array(batch.column("host").to_pylist(), object), return_inverse=True)
        host, run, pages = repeated_runs(hosts.reshape(-1), batch.column("page").to_numpy(), batch.column("stream"))
        return pa.RecordBatch.from_arrays(
            [pa.array(names[host], pa.string()), pa.array(run.view(np.int64)), pa.array(pages, pa.int64())], names=["host", "run", "pages"])

    def task(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column("host").to_pylist(), batch.column("shard").to_pylist()))
            cuts = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
            for first, end in zip(cuts, cuts[1:]):
                part = batch.slice(first, end - first)
                if rows and keys[first] != last and (size > limit or keys[first][0] == last[0]):
                    yield close(rows)
                    rows, size = [], 0
                rows.append(part)
                size += int(textops.text_bytes(part.column("stream")).sum())
                last = keys[first]
        if rows:
            yield close(rows)
    return task


def boilerplate(pages: DataFrame, host_bytes: int = HOST_BYTES) -> DataFrame:
    """(host, strong, weak): hashes of the runs to remove, for hosts that have any. ``pages``: host, html."""
    known = pages.filter(F.col("host").isNotNull())
    large = written(known.groupBy("host").agg(F.sum(F.length("html")).alias("size")).filter(F.col("size") > host_bytes)
                    .select("host", F.ceil(F.col("size") / host_bytes).cast("int").alias("shards")), "hosts")
    streams = known.select("host", "html").mapInArrow(stream_task, "host string, page long, stream string")
    sharded = (streams.join(large, "host", "left").withColumn("shard", F.pmod(F.col("page"), F.coalesce("shards", F.lit(1))).cast("int"))
               .select("host", "shard", "page", "stream").repartition("host", "shard").sortWithinPartitions("host", "shard"))
    runs = written(sharded.mapInArrow(run_task(host_bytes), "host string, run long, pages long")
                   .groupBy("host", "run").agg(F.sum("pages").alias("pages")), "runs")
    # a host with very many runs is dealt over the salts
    distinct = (runs.filter("run = 0").select("host", F.col("pages").alias("distinct"))
                .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salted = runs.filter("run <> 0").filter(F.col("pages") >= WEAK).withColumn("salt", F.pmod("run", F.lit(SALTS)).cast("int"))
    judged = (salted.join(distinct, ["host", "salt"])
              .filter(F.col("pages") >= F.col("distinct") * WEAK_SHARE)
              .withColumn("strong", (F.col("pages") >= STRONG) & (F.col("pages") >= F.col("distinct") * STRONG_SHARE)))
    # a run that a quarter of the pages hold: at most four times the runs of one page, whatever the host's size
    return written(judged.groupBy("host").agg(F.collect_list(F.when(F.col("strong"), F.col("run"))).alias("strong"), F.collect_list("run").alias("weak")), "boilerplate")


def unique_text(texts: list[str], marked: bool, strong: np.ndarray, weak: np.ndarray) -> str:
    """The blocks without boilerplate, joined by spaces."""
    stream = stream_of(texts)
    hashes, counts = textops.word_hashes(pa.array([stream]), spaces_only=True)
    mark = textops.word_hashes(pa.array([MARK]), spaces_only=True)[0][0]
    starts, lengths = spans_of(hashes, mark, counts)
    gone = np.isin(span_hashes(hashes, starts, lengths), strong if marked else weak)
    if marked:
        gone &= np.arange(len(gone)) < np.count_nonzero(hashes == mark) - 1  # whole blocks only
    if not gone.any():
        return " ".join(texts)
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, starts[gone], 1)
    np.add.at(cover, starts[gone] + lengths[gone], -1)
    kept = np.cumsum(cover)[:-1] == 0
    return " ".join(t for t, k in zip(stream.split(" "), kept) if k and t != MARK)


def text_task(batches):
    for part in textops.slices(batches, "html"):
        out, sets = [], {}
        names, strong, weak = (part.column(c).to_pylist() for c in ("host", "strong", "weak"))
        for html, host, one, two in zip(part.column("html").to_pylist(), names, strong, weak):
            texts, marked = blocks(html) if html else ([], False)
            if texts and two:
                if host not in sets:
                    sets[host] = np.array(one, np.int64).view(np.uint64), np.array(two, np.int64).view(np.uint64)
                out.append(unique_text(texts, marked, *sets[host]))
            else:
                out.append(" ".join(texts))
        text = pa.array(out, pa.string())
        keys = [part.column(c) for c in part.schema.names if c.startswith("key")]
        yield pa.RecordBatch.from_arrays([*keys, text], names=[*(f"key{i}" for i in range(len(keys))), "main"])


def main_text(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), url: str = "url", html: str = "html",
              host_bytes: int = HOST_BYTES) -> DataFrame:
    """``keys`` of every page, its main ``text`` and ``n_chars`` (code points)."""
    inner = [f"key{i}" for i in range(len(keys))]
    base = pages.select(*[F.col(k).alias(i) for k, i in zip(keys, inner)], host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    found = boilerplate(base.select("host", "html"), host_bytes)
    kinds = ", ".join(f"{i} {pages.schema[k].dataType.simpleString()}" for k, i in zip(keys, inner))
    done = base.join(found, "host", "left").mapInArrow(text_task, f"{kinds}, main string")
    return done.select(*[F.col(i).alias(k) for k, i in zip(keys, inner)], F.col("main").alias("text"), F.length("main").cast("long").alias("n_chars"))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the main text of every page."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
