"""Divergence of sources against a plain version, on random and on odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from cisloom.llm import source_audit

SCHEMA = "doc_id bigint, text string, lang string, source string, value string, rank string, term string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least_docs, most_terms=10):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = [t for t in df if df[t] >= least_docs]
        groups = {d[1] for d in own}
        n = {g: Counter(t for d in own if d[1] == g for t in d[2]) for g in groups}
        n[None] = Counter(t for d in own for t in d[2])
        p = {g: {t: 1 + 10**9 * (n[g][t] + 2) // (sum(n[g][x] for x in kept) + 2 * len(kept)) for t in kept} for g in n}
        for g in groups:
            pairs = sorted(((-sum(f(p[g][t], p[s][t]) for t in kept), s.encode(), s) for s in groups if s != g))
            out += [(lang, g, "pair", s, -v, i) for i, (v, _, s) in enumerate(pairs, 1)]
            terms = sorted((-f(p[g][t], p[None][t]), t.encode(), t) for t in kept if n[g][t] > 0 and p[g][t] > p[None][t])
            out += [(lang, g, "term", t, -v, i) for i, (v, _, t) in enumerate(terms[:most_terms], 1)]
    return sorted(out)


def odd_rows():
    rng = random.Random(3)
    words = ["Alpha", "beta", "été", "ÉTÉ", "ß", "x", "日本", "don't", "a1b", "Zed"]
    rows = [(" ".join(rng.choices(words[: rng.randint(2, 10)], k=rng.randint(0, 40))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None, "é", "hot", "hot", "hot"])) for _ in range(300)]
    return rows + rows[:20] + [(None, "en", "void"), ("", None, None), (None, "xx", "one"), ("rare", "xx", "two"), ("12 34 !", "yy", "alone"), ("Q" * 70_000 + " x x", "en", "a")]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "clash", "clash", "clash") for i, r in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("least", [1, 10])
def test_divergence(spark, least):
    rows = odd_rows()
    got = sorted(map(tuple, source_audit.divergence(frame(spark, rows).repartition(5), least_docs=least).collect()))
    assert got == plain(rows, least)


def test_divergence_without_rows(spark):
    out = source_audit.divergence(frame(spark, []))
    assert out.collect() == [] and out.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(source_audit, "PIECE", 7)
    data = b"abc defghijklmnop q  rs,TUV\xc3\xa9 x"
    assert [t for p in source_audit._pieces(data) for t in p] == [b"abc", b"defghijklmnop", b"q", b"rs", b"tuv\xc3\xa9", b"x"]


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    rows = odd_rows()
    monkeypatch.setattr(source_audit, "SALTS", 3)
    assert sorted(map(tuple, source_audit.divergence(frame(spark, rows).coalesce(1), least_docs=2, most_terms=3).collect())) == plain(rows, 2, 3)


def test_query_on_whole_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("text", "lang", "source").collect()]
    assert sorted(map(tuple, source_audit.op13_source_audit(spark, small).collect())) == plain(rows, 10)
