"""Licence scan by a positional index of rare words (operator 2), in DataFrame functions only.

Templates are word lists with key phrases that must stand at their places. For each template the index holds the two
words of its key phrases that occur in the fewest documents of the corpus, with their places in the template. A text's
places of such words give template starts (place in the text minus place in the template); starts that both words
agree on are compared with the template: all key phrases must match, and of all words at least ``min_cover``.

As the index words are taken from the key phrases, nothing that the comparison would accept is missed, whatever the
frequencies are: they only decide how many starts are compared. The document frequencies are one small aggregate over
the vocabulary of the key phrases; the scan itself is one pass without a shuffle.

Defined results: null and empty texts have 0 words and no finding; a template must begin inside the text and may run
over its end; a text that names several licences has several labels; repeated rows are scanned each; further columns
are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwatch.llm.common import added, ascii_lower

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
BASE = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]

# Label, template, key phrases. Wording of the licences' own notices.
TEMPLATES = [
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-notice", "under the terms of the gnu general public license as published by the free software foundation",
     ["gnu general public license", "free software foundation"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "gnu affero general public license", ["affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-notice", "you may not use this file except in compliance with the license", ["except in compliance with the license"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-attribution", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc0", "cc0 1 0 universal", ["cc0 1 0"]),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ["copy modify and or distribute this software", "with or without fee"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("epl", "eclipse public license", ["eclipse public license"]),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ["boost software license version 1 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]

MIN_COVER = 0.8


def catalogue() -> list[dict]:
    """All templates as words with the places of their key phrases; base phrases are key phrases as a whole."""
    out = []
    for label, text, keys, base in [(a, b, [b], True) for a, b in BASE] + [(a, b, c, False) for a, b, c in TEMPLATES]:
        words = text.split()
        must: set[int] = set()
        for key in keys:
            part = key.split()
            at = next(i for i in range(len(words)) if words[i:i + len(part)] == part)
            must |= set(range(at, at + len(part)))
        out.append({"label": label, "words": words, "must": sorted(must), "base": base})
    return out


def with_words(docs: DataFrame, text: Column) -> DataFrame:
    """Adds ``__words``. Splitting is far cheaper than extracting; a separator at either end leaves an empty word."""
    split = docs.withColumn("__split", F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1))
    lead = (F.element_at("__split", 1) == "").cast("int")
    trail = ((F.size("__split") > 1) & (F.element_at("__split", -1) == "")).cast("int")
    return split.withColumn("__words", F.slice("__split", 1 + lead, F.size("__split") - lead - trail)).drop("__split")


def frequencies(words: DataFrame, column: str, vocabulary: list[str]) -> dict[str, int]:
    """In how many texts each word of the vocabulary occurs."""
    seen = words.select(F.explode(F.array_intersect(column, F.array(*map(F.lit, vocabulary)))).alias("word"))
    return {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}


def starts_of(template: dict, rare: list[int], words: Column, hits: Column, min_cover: float) -> Column:
    """Array of (label, base, start, cover) where the template stands."""
    size = len(template["words"])

    def places(k: int) -> Column:
        return F.transform(F.filter(hits, lambda h: h["word"] == template["words"][k]), lambda h: h["place"] - k)

    lists = [places(k) for k in rare]
    starts = reduce(F.array_intersect, lists)
    runs, must = [], template["must"]
    for i in must:  # neighbouring places are compared as one slice
        if runs and runs[-1][1] == i:
            runs[-1][1] = i + 1
        else:
            runs.append([i, i + 1])

    def good(s: Column) -> Column:
        parts = [F.slice(words, s + a + 1, b - a) == F.array(*map(F.lit, template["words"][a:b])) for a, b in runs]
        return reduce(lambda x, y: x & y, parts, s >= 0)

    def entry(s: Column) -> Column:
        if len(must) == size:
            cover = F.lit(1.0)
        else:
            same = F.zip_with(F.slice(words, s + 1, size), F.array(*map(F.lit, template["words"])), lambda x, y: F.when(x == y, 1))
            cover = F.size(F.filter(same, lambda x: x.isNotNull())) / F.lit(float(size))
        return F.struct(F.lit(template["label"]).alias("label"), F.lit(template["base"]).alias("base"), s.alias("start"), cover.alias("cover"))

    return F.filter(F.transform(F.filter(starts, good), entry), lambda x: x["cover"] >= min_cover)


def scan(docs: DataFrame, text: str = "text", min_cover: float = MIN_COVER) -> DataFrame:
    """``docs`` plus ``n_words`` and ``findings``: array of (label, base, start, cover), start in words from 0.

    A result column whose name ``docs`` has already ends in ``_new``; no column of ``docs`` is changed.
    """
    own = {c: f"__own{i}" for i, c in enumerate(docs.columns) if c != text}
    names = added(docs, "n_words"), added(docs, "findings")
    kept, docs = docs.columns, docs.withColumnsRenamed(own)
    templates = catalogue()
    vocabulary = sorted({t["words"][i] for t in templates for i in t["must"]})
    count = frequencies(with_words(docs.select(text), F.col(text)), "__words", vocabulary)
    rare = [sorted(t["must"], key=lambda i, t=t: (count.get(t["words"][i], 0), i))[:2] for t in templates]
    first = sorted({t["words"][r[0]] for t, r in zip(templates, rare)})
    every = sorted({t["words"][k] for t, r in zip(templates, rare) for k in r})
    words, hits = F.col("__words"), F.col("__hits")
    prepared = with_words(docs, F.col(text))
    placed = F.filter(F.transform(words, lambda w, i: F.when(w.isin(every), F.struct(w.alias("word"), i.alias("place")))), lambda h: h.isNotNull())
    prepared = prepared.withColumn("__hits", F.when(F.arrays_overlap(words, F.array(*map(F.lit, first))), placed))
    found = F.concat(*[starts_of(t, r, words, hits, min_cover) for t, r in zip(templates, rare)])
    none = F.array().cast("array<struct<label:string,base:boolean,start:int,cover:double>>")
    return prepared.select(*[F.col(own.get(c, c)).alias(c) for c in kept], F.size(words).cast("long").alias(names[0]),
                           F.when(hits.isNull(), none).otherwise(found).alias(names[1]))


def query(spark, sf_dir: str) -> DataFrame:
    """Contract of op2: one row per document."""
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("findings", lambda x: x["base"])
    starts = F.transform("__base", lambda x: x["start"].cast("long"))

    def labels(entries: Column | str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(entries, lambda x: x["label"]))), ",")

    return rows.withColumn("__base", base).select(
        "doc_id", "n_words", F.size("__base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels("__base").alias("base_labels"), labels("findings").alias("labels"),
        F.coalesce(F.array_max(F.transform("findings", lambda x: x["cover"])), F.lit(0.0)).alias("score"))


def _oracle() -> str:
    rows = [f"({n}, '{t['label']}', {t['base']}, {i}, '{w}', {i in t['must']}, {len(t['must'])}, {len(t['words'])})"
            for n, t in enumerate(catalogue()) for i, w in enumerate(t["words"])]
    return f"""
WITH template(tid, label, base, pos, word, must, n_must, size) AS (VALUES {", ".join(rows)}),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words
  FROM documents),
each_word AS (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS i FROM docs),
found AS (
  SELECT rid, tid, any_value(label) AS label, any_value(base) AS base, i - pos AS start,
         count(*) / any_value(size)::DOUBLE AS cover
  FROM each_word JOIN template USING (word) WHERE i >= pos GROUP BY rid, tid, i - pos
  HAVING count(*) FILTER (must) = any_value(n_must) AND count(*) / any_value(size)::DOUBLE >= {MIN_COVER}),
summed AS (
  SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score
  FROM found GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN summed USING (rid)
"""


ORACLE_SQL = _oracle()
