"""License scans by a positional index of rare licence words (DataFrame functions only)."""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let, text_of

# Base phrases with their labels, and short texts by which public licences are known,
# each with the phrases that must stand in the file word for word.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = {
    "gpl-notice": ("this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    "gpl-program": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["redistribute it and or modify"]),
    "apache-2.0": ("licensed under the apache license version 2 0", ["apache license version 2 0"]),
    "apache-2.0-notice": ("you may not use this file except in compliance with the license you may obtain a copy of the license at", ["except in compliance with the license"]),
    "mit-notice": ("released under the mit license", ["mit license"]),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ["cc by nc"]),
    "cc-by-4.0": ("this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify"]),
}
#: Words of the templates too common in any prose to be looked up.
COMMON = frozenset("a and any are as at by for in is it may not of or that the this to under use v with you your 0 2 3 4".split())
#: Rarest words of each template found in a file that are looked up, and the share of a template's rarity that must agree in position.
RAREST, AGREE = 6, 0.5

# Characters between words and in words, once letters are lowered; the second is the complement of the first, which Java matches faster as ranges.
SEP, CHAR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[0-9a-z\x{80}-\x{10FFFF}]"
#: A word before letters are lowered.
ANY_CASE = r"[0-9A-Za-z\x{80}-\x{10FFFF}]++"
VOCABULARY = sorted({w for text, _ in TEMPLATES.values() for w in text.split()} - COMMON)


def _any_of(phrases: list[str]) -> str:
    """Any of the phrases, word for word; what must not stand before them is tested once a place."""
    return f"(?<!{CHAR})(?:" + "|".join(f"{SEP}+".join(map(re.escape, p.split())) for p in phrases) + f")(?!{CHAR})"


#: A file without any of the phrases that bases and templates require has no label; the longest word of each is searched first.
REQUIRED = sorted({*BASE, *[k for _, keys in TEMPLATES.values() for k in keys]})
NEEDED = _any_of(REQUIRED)
HINTS = sorted({max(p.split(), key=len) for p in REQUIRED})


def _places(words: Column, known: Column, phrase: str) -> Column:
    """Start positions of the consecutive words of ``phrase``, looked for around its first licence word."""
    p = phrase.split()
    at = next(k for k, w in enumerate(p) if w in VOCABULARY)

    def here(h: Column) -> Column:
        return functools.reduce(lambda a, b: a & b, [h["w"] == p[at], *[F.get(words, h["i"] + (k - at)) == w for k, w in enumerate(p) if k != at]])

    return F.transform(F.filter(known, here), lambda h: h["i"] - at)


def document_frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of all rows, and of those in which each licence word stands; as many entries as the vocabulary and one reach the driver."""
    heads = "|".join(f"{c}(?:{'|'.join(w[1:] for w in VOCABULARY if w[0] == c)})" for c in sorted({w[0] for w in VOCABULARY}))
    found = F.regexp_extract_all("text", F.lit(f"(?i)(?<!{CHAR})({heads})(?!{CHAR})"), F.lit(1))
    parts = F.array_distinct(F.transform(F.array_distinct(found), F.lower))
    # The empty word stands once in every row.
    seen = docs.select(F.explode(F.concat(F.array(F.lit("")), parts)).alias("word")).groupBy("word").count().collect()
    df = {r[0]: r[1] for r in seen}
    return df.pop("", 0), df


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rarest: int = RAREST, agree: float = AGREE) -> DataFrame:
    """Licence labels of every row of ``docs``.

    First pass: document frequencies of the licence vocabulary over all rows.  Second: of each template the rarest words in the file
    look up the postings (word -> template, place), so that one licence takes no other's lookups; postings that agree on the difference between place in the file and place in
    the template add up, and a template whose best difference holds ``agree`` of the file's looked-up and its own rarity is
    labelled if its mandatory phrases stand in the file.  All of it happens within a row: no shuffle but the frequencies'.

    Cases: a null or empty text has no words, no labels, null positions and score 0; repeated rows are scanned each on its own;
    ids are carried, null or not; other columns are not read; an empty table gives an empty result.
    """
    text = text_of(docs, text_col)
    base = docs.select(docs[id_col].alias(id_col), text.alias("text"))
    hint = F.lower("text")
    some = functools.reduce(lambda a, b: a | b, [F.contains(F.col("hint"), F.lit(h)) for h in HINTS])
    base = base.withColumn("hint", hint).withColumn("maybe", F.when(some, F.col("text").rlike(f"(?i){NEEDED}")).otherwise(False)).drop("hint")
    low = F.when(F.col("maybe"), F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    lowered = base.withColumn("low", low)
    total, df = document_frequencies(base.select("text"))
    idf = {w: math.log1p(max(1, total) / (1 + df.get(w, 0))) for w in VOCABULARY}
    rarity = F.create_map(*[F.lit(x) for w in VOCABULARY for x in (w, idf[w])])

    def labelled(places: Column, label: str) -> Column:
        return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    def scan(words: Column) -> Column:
        """Places of base phrases, and the scores of the templates, each by its rarest words in the file."""
        known = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(VOCABULARY))
        return let(known, lambda k: scores(words, k))

    def scores(words: Column, known: Column) -> Column:
        rated = F.transform(known, lambda h: F.struct(rarity[h["w"]].alias("idf"), h["w"].alias("w"), h["i"].alias("i")))
        base = F.sort_array(F.flatten(F.array(*[labelled(_places(words, known, p), x) for p, x in BASE.items()])))

        def aligned(hits: Column) -> Column:
            kinds = F.sort_array(F.array_distinct(F.transform(hits, lambda h: F.struct(h["idf"].alias("idf"), h["w"].alias("w")))), False)
            return let(kinds, lambda k: F.array(*[_aligned(hits, k, t, words, known, idf, rarest, agree) for t in TEMPLATES]))

        return F.struct(base.alias("base"), let(rated, aligned).alias("scores"))

    words = F.regexp_extract_all("low", F.lit(f"{CHAR}+"), F.lit(0))
    out = lowered.withColumn("scan", F.when(F.col("maybe"), let(words, scan))).withColumn("n_words", F.regexp_count("text", F.lit(ANY_CASE)).cast("long"))
    empty = F.array().cast("array<string>")
    base_labels = F.coalesce(F.array_distinct(F.transform("scan.base", lambda b: b["label"])), empty)
    method = F.coalesce(F.transform(F.filter("scan.scores", lambda s: s["ok"]), lambda s: s["label"]), empty)
    score = F.coalesce(F.array_max(F.transform("scan.scores", lambda s: F.when(s["ok"], s["score"]).otherwise(0.0))), F.lit(0.0))
    return out.select(
        id_col,
        "n_words",
        F.coalesce(F.size("scan.base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform("scan.base", lambda b: b["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("scan.base", lambda b: b["at"])).cast("long").alias("last_word"),
        F.array_join(F.sort_array(base_labels), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base_labels, method)), ",").alias("labels"),
        F.least(F.lit(1.0), score).alias("score"),
    )


def _aligned(hits: Column, kinds: Column, name: str, words: Column, known: Column, idf: dict[str, float], rarest: int, agree: float) -> Column:
    """(label, score, ok) of one template: the largest rarity that agrees on one relative position; ``kinds`` are the file's licence words, rarest first."""
    text, keys = TEMPLATES[name]
    postings: dict[str, list[int]] = {}
    for i, w in enumerate(text.split()):
        if w in idf:
            postings.setdefault(w, []).append(i)
    places = F.create_map(*[x for w, at in postings.items() for x in (F.lit(w), F.array(*[F.lit(i) for i in at]))])
    whole = sum(sorted((idf[w] for w in postings), reverse=True)[:rarest])
    zero = F.struct(F.lit(-(10**6)).alias("shift"), F.lit("").alias("w"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        now = F.when(a["shift"] == x["shift"], a["sum"] + x["idf"]).otherwise(x["idf"])
        return F.struct(x["shift"].alias("shift"), x["w"].alias("w"), now.alias("sum"), F.greatest(a["best"], now).alias("best"))

    def scored(top: Column) -> Column:
        mine = F.filter(hits, lambda h: F.exists(top, lambda k: k["w"] == h["w"]))
        shifts = F.sort_array(F.flatten(F.transform(mine, lambda h: F.transform(places[h["w"]], lambda p: F.struct((h["i"] - p).alias("shift"), h["w"].alias("w"), h["idf"].alias("idf"))))))
        best = F.aggregate(shifts, zero, step, lambda a: a["best"])
        own = F.aggregate(top, F.lit(0.0), lambda a, k: a + k["idf"])
        return F.least(F.lit(1.0), best / F.greatest(own, F.lit(whole * agree), F.lit(1e-9)))

    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & (F.size(_places(words, known, k)) > 0)
    score = F.when(keyed, let(F.slice(F.filter(kinds, lambda k: F.map_contains_key(places, k["w"])), 1, rarest), scored)).otherwise(0.0)
    return let(score, lambda s: F.struct(F.lit(name).alias("label"), s.alias("score"), ((s >= agree) & (s > 0)).alias("ok")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
