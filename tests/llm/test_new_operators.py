"""Source divergence, page extraction and collocations against brute force, and on awkward rows."""

import collections
import re
from html import escape

import duckdb
import numpy as np
import pytest

from panelwatch.llm import collocations, divergence, markup, pages

SCHEMA = "doc_id long, text string, lang string, source string"
EXTRA = ("n string, w1 string, rank string, sources string, term string, idx string, p string, part string, item string, value string, "
         "phrase string, score string, host string, shard string, key0 string, main string, n_chars string, seed string, `key` string")


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(1, None, "en", "a"), (1, None, "en", "a"), (2, "", None, None), (None, "x" * 70_000, "en", "b"), (3, "?!.,\n\t ", "en", "b"),
            (4, "A b\tC. a b c; a b\nc É漢 é漢" * 30, "en", "a"), (4, "A b\tC. a b c; a b\nc É漢 é漢" * 30, "en", "a"), (5, "a b c " * 3000, "zz", "c")]
    rows += [(10 + i, f"new york is big and new york has {i % 3} parks a{i}", "en", "abc"[i % 3]) for i in range(60)]
    rows += [(100 + i, "los gatos", ["es", None][i % 2], None) for i in range(70)]
    df = spark.createDataFrame(rows, SCHEMA)
    return spark.createDataFrame([(*r, *["clash"] * 19) for r in rows], f"{SCHEMA}, {EXTRA}").coalesce(3), df.toPandas()


def by_sql(table, sql):
    con = duckdb.connect()
    con.register("documents", table)
    return sorted(con.execute(sql).fetchall(), key=repr), con


@pytest.mark.parametrize("limits", [{}, {"held": 20}], ids=["default", "gives_up_often"])
def test_divergence_of_awkward_rows(spark, awkward, limits, monkeypatch):
    monkeypatch.setattr(divergence, "SIDE", 2)
    monkeypatch.setattr(divergence, "BUCKET", 2)
    got = sorted((tuple(r) for r in divergence.audit(awkward[0], **limits).select("lang", "source", "part", "item", "value", "rank").collect()), key=repr)
    want, _ = by_sql(awkward[1], divergence.ORACLE_SQL)
    assert got == want and {r[2] for r in got} == {"pair", "term"}


def test_divergence_without_kept_terms_and_empty(spark):
    rows = [(1, "few words", "en", "a"), (2, "few words", "en", "b"), (3, None, None, None)]
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.source, r.item, r.value, r.rank) for r in got) == [("a", "b", 0, 1), ("b", "a", 0, 1)]
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shares_are_exact_for_large_counts(spark):
    n, total, terms = 10 ** 15 + 7, 3 * 10 ** 17 + 11, 10 ** 6
    df = spark.createDataFrame([(n, total, terms), (0, 0, 0)], "n long, total long, terms long")
    from pyspark.sql import functions as F
    got = [r[0] for r in df.select(divergence.share_of(F.col("n"), F.col("total"), F.col("terms"))).collect()]
    assert got == [1 + 10 ** 9 * (n + 5) // (total + 5 * terms), None]
    a, left, right = 10 ** 14 + 3, 10 ** 15 + 1, 10 ** 14 + 9
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(collocations.score_of(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 10 ** 6 * a * a // (left * right)


@pytest.mark.parametrize("limits", [{}, {"burst": 2, "held": 8, "words": 10}], ids=["default", "bursts_and_spills"])
def test_collocations_of_awkward_rows(spark, awkward, limits):
    found = collocations.collocations(awkward[0], **limits)
    got = sorted((r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found.collect())
    rows, con = by_sql(awkward[1], collocations.ORACLE_SQL)
    want = sorted((r[0], *r[2:]) for r in rows)
    assert got == want and ("en", "and new york") in {r[:2] for r in got}


def test_collocations_empty_and_ties(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(i, "b a, a b, c c c", None, None) for i in range(10)]
    got = {r.phrase: (r.lang, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"b a": ("und", 10, 20, 20, 70, 250_000), "a b": ("und", 10, 20, 20, 70, 250_000), "c c c": ("und", 10, 30, 20, 70, 166_666)}


def test_trie_counts_like_a_dict():
    r = np.random.default_rng(3)
    want, tree = collections.Counter(), {}
    for _ in range(40):
        words = r.integers(2, 12, (60, 3)).astype(np.int64)
        packed = words[:, 0] << 42 | words[:, 1] << 21 | words[:, 2]
        want.update(packed.tolist())
        tree, _ = collocations.insert(tree, *np.unique(packed, return_counts=True), 0, 3, 5)
    assert isinstance(tree, collocations.Node) and collocations.entries(tree) == len(want)
    assert collocations.run_of(tree) == sorted(want.items())


def test_bitmap_holds_every_common_phrase(spark):
    rows = [("en", "a", "é漢"), ("", "x" * 50, "b"), ("en", "é漢", "a")]
    table = spark.createDataFrame(rows, "lang string, w1 string, w2 string")
    for width in (1, 2):
        bitmap = collocations.bitmap_of(table.mapInArrow(collocations.seed_task(width), "seed long"))
        for lang, *words in rows:
            hashes = [collocations.word_hashes(lang, [w.encode()]) for w in words]
            seed = hashes[0] if width == 1 else collocations.joined_hashes(*hashes)
            assert collocations.in_bitmap(bitmap, seed).all()
        assert not collocations.in_bitmap(bitmap, collocations.word_hashes("fr", [b"q", b"r"])).any()


PAGE = ("<!DOCTYPE html><html class='no-js'><head><title>T</title><style>p{}</style><script>var a='</p>';if(a<b){}</script></head><body class='has-sidebar'>"
        "<header class=top><h1>Site</h1></header><nav><ul><li><a href='/x'>Menu</a></ul></nav><!-- ad --><div class=\"ad\">Buy</div>"
        "<div id='cookie-notice'>We use cookies</div><form><input name=q><button>Go</button></form>"
        "<article><h1>Head &amp; line</h1><p><b>One<br>two&nbsp;\n three.<p>Caf&eacute; &#x6f22; A &lt; B</p><ul><li>x<li>y</ul>"
        "<div class='share-buttons'>Share</div><section id=comments><article>Nice!</article></section></article>"
        "<aside>More</aside><footer>&copy; host</footer>")


def test_blocks_of_a_page():
    texts, marked = markup.blocks(PAGE)
    assert marked and " ".join(texts) == "Head & line One two three. Café 漢 A < B x y"
    assert markup.blocks("") == ([], False) and markup.blocks("<article></article>") == ([], False)
    assert markup.blocks("plain &amp; simple") == (["plain & simple"], False)
    assert markup.blocks("<div><article><p>a</div></div><p>b</article><p>c")[0] == ["a", "b"]
    assert markup.blocks("<nav><a>m</a><article>a</article>")[0] == ["a"]
    assert markup.blocks("<p title='x>y'>a</p><p title=\"open>b<p>c")[0] == ["a", "b", "c"]
    assert markup.blocks("<main><h1>t</h1><div class='comment-list'>no</div>z</main>q")[0] == ["t", "z"]
    assert markup.blocks("a<b>b</b>c<span class='ad'>no</span>d")[0] == ["abcd"]


@pytest.mark.parametrize("html", ["<a " * 100_000, "<p class=\"x" * 50_000, "<!--" * 100_000, "<" * 200_000, "&" * 200_000,
                                  "<div>" * 50_000 + "</section>" * 50_000, "<a =\"" * 50_000, "<script>" * 50_000], ids=range(8))
def test_blocks_in_linear_time(html):
    import time
    start = time.process_time()
    markup.blocks(html)
    assert time.process_time() - start < 5


def test_suffix_ranks_name_substrings():
    r = np.random.default_rng(7)
    for n, k in ((1, 1), (40, 2), (300, 3), (200, 1)):
        tokens = r.integers(0, k, n).astype(np.int64)
        levels = pages.suffix_ranks(tokens)
        whole = sorted(range(n), key=lambda i: tokens[i:].tolist())
        assert np.argsort(levels[-1], kind="stable").tolist() == whole
        starts = r.integers(0, n, 400)
        lengths = r.integers(1, 30, 400)
        keep = starts + lengths <= n
        starts, lengths = starts[keep], lengths[keep]
        name = pages.names_of(levels, starts, lengths)
        spans = [tuple(tokens[s:s + m].tolist()) for s, m in zip(starts, lengths)]
        assert len(set(zip(name.tolist(), spans))) == len(set(spans)) == len(set(name.tolist()))
        hashes = tokens.astype(np.uint64) * np.uint64(977)
        assert len(set(zip(pages.span_hashes(hashes, starts, lengths).tolist(), spans))) == len(set(spans))


def brute_text(rows):
    """Main texts, with runs counted in dicts."""
    read = [markup.blocks(html or "") for _, html in rows]
    hosts = [m.group(1) if (m := re.match(pages.HOST, (u or "").lower())) else None for u, _ in rows]
    lower = {c: c + 32 for c in range(65, 91)}

    def spans(texts):
        tokens = pages.stream_of(texts).translate(lower).split()
        marks = [i for i, t in enumerate(tokens) if t == pages.MARK]
        whole = [(a, b + 1) for a, b in zip(marks, marks[1:])]
        return tokens, whole, [(i, i + pages.LONG) for i in range(len(tokens) - pages.LONG + 1)]

    held, distinct = collections.defaultdict(set), collections.defaultdict(set)
    for host, (texts, _) in zip(hosts, read):
        if host and texts:
            tokens, whole, runs = spans(texts)
            distinct[host].add(tuple(tokens))
            for a, b in whole + runs:
                held[host, tuple(tokens[a:b])].add(tuple(tokens))
    out = []
    for host, (texts, marked) in zip(hosts, read):
        if not texts or not host:
            out.append(" ".join(texts))
            continue
        tokens, whole, runs = spans(texts)
        plain, kept = pages.stream_of(texts).split(), [True] * len(tokens)
        for a, b in whole + ([] if marked else runs):
            n, of = len(held[host, tuple(tokens[a:b])]), len(distinct[host])
            if (n >= pages.STRONG and n >= of / 2) if marked else (n >= pages.WEAK and n >= of / 4):
                kept[a:b] = [False] * (b - a)
        out.append(" ".join(t for t, k, x in zip(plain, kept, tokens) if k and x != pages.MARK))
    return out


@pytest.fixture(scope="module")
def site():
    r = np.random.default_rng(9)
    words = [f"w{i}" for i in range(400)]

    def prose(n):
        return " ".join(r.choice(words, n))

    rows = []
    for host, count, article in (("news.example", 40, True), ("plain.example", 30, False), ("tiny.example", 2, False), ("Two.Example:80", 9, True)):
        shared, tail = prose(30), "Read our newsletter every day " + prose(12)
        for i in range(count):
            own = [prose(40) for _ in range(3)]
            if i % 10 == 0:
                own.insert(1, shared)
            own.append(f"All rights reserved by the owner of this place {i}")
            own.append(tail)
            body = "".join(f"<p>{escape(x)}</p>" for x in own)
            rows.append((f"http://{host}/p/{i}", f"<body><nav>Menu</nav>{'<article>' if article else ''}{body}{'</article>' if article else ''}"))
    rows += [rows[0], rows[0], (None, rows[1][1]), ("no url", rows[1][1]), ("http://news.example/x", None), ("http://news.example/y", ""),
             ("http://long.example/", "<p>" + "lorem ipsum " * 20_000)]
    return rows


@pytest.mark.parametrize("host_bytes", [pages.HOST_BYTES, 9000], ids=["one_array", "several"])
def test_main_text_against_brute_force(spark, site, host_bytes):
    df = spark.createDataFrame([(i, u, h, *["clash"] * 19) for i, (u, h) in enumerate(site)], f"page_id long, url string, html string, {EXTRA}").repartition(5)
    got = {r.page_id: r for r in pages.main_text(df, host_bytes=host_bytes).collect()}
    want = brute_text(site)
    assert len(got) == len(site)
    assert [got[i].text for i in range(len(site))] == want
    assert all(r.n_chars == len(r.text) and r.url == site[i][0] for i, r in got.items())
    assert all("newsletter" not in want[i] for i in range(79) if "tiny" not in site[i][0]) and "reserved" in want[1]


def test_main_text_of_no_pages(spark):
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_main_text_keeps_articles(spark, data):
    table = spark.read.parquet(f"{data}/pages.parquet").toPandas()
    got = {r.page_id: r.text for r in pages.query(spark, data).collect()}

    def article(html):
        from html import unescape
        m = re.search(r"<article>(.*?)(?:</article>|\Z)", html, re.S)
        return " ".join(unescape(re.sub(r"<[^>]+>", lambda t: "" if t.group() in ("<b>", "</b>") else " ", m.group(1))).split())
    assert [got[i] for i in table.page_id] == [article(h) for h in table.html]


def test_counters_of_blocks_are_added_up(spark):
    """Counters travel as one row for each block, not one for each slot, and add up over tasks to full bytes."""
    context = spark.sparkContext
    texts = spark.createDataFrame([("en", "los gatos negros")] * 12 + [("en", "un perro")] * 3 + [("en", "x y " * 3000)], "lang string, text string").repartition(4)
    one = collocations.phrase_counts(texts, 1)
    bitmap = collocations.bitmap_of(one.filter("w1 IS NOT NULL").mapInArrow(collocations.seed_task(1), "seed long"))
    rows = texts.mapInArrow(collocations.slot_task(2, context.broadcast((bitmap, None)), 1000), "block int, places binary, counts binary").collect()
    assert len(rows) <= 4 * 5 and all(len(r.places) == 2 * len(r.counts) for r in rows)
    often = collocations.slot_bitmap(texts, 2, context.broadcast((bitmap, None)), 10, 1000)

    def slot(a, b):
        return int(collocations.slot_of(collocations.joined_hashes(*(collocations.word_hashes("en", [w]) for w in (a, b))), None)[0])

    want = {slot(b"los", b"gatos"), slot(b"gatos", b"negros"), slot(b"x", b"y"), slot(b"y", b"x")}
    assert set(np.flatnonzero(np.unpackbits(often, bitorder="little")).tolist()) == want


def test_single_texts_are_picked_where_they_are_counted(spark):
    """One Python step between the texts and the sums of texts that occur once."""
    docs = spark.createDataFrame([(i, f"word{i} common", "en", "ab"[i % 2]) for i in range(40)] + [(99, "again again", "en", "a")] * 3, SCHEMA)
    keyed = divergence.keyed_texts(docs, "text", "lang", "source")
    shared = spark.sparkContext.broadcast(divergence.bitmap_of(keyed.filter("text = 'again again'").select("seed")))
    sums = keyed.select("lang", "text", "source", "seed").mapInArrow(divergence.term_task(1000, shared), "lang string, source string, term string, n long, docs long")
    got = {(r.term, r.n) for r in sums.groupBy("term").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert got == {("common", 40), ("word", 40)}
    assert {(r.term, r.total) for r in divergence.kept_terms(docs, "text", "lang", "source", 2, 1000).collect()} == {("common", 40), ("again", 6), ("word", 40)}
