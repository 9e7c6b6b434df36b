"""Product codes against a plain version: all entries looked at, whole numbers of any size."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from cisloom.llm import vector_codes
from cisloom.llm.vector_codes import Book, distances, product_codes

SCHEMA = "vec_id bigint, embedding array<double>, label int, code string, error string, part string, n string"


def nearest(x, book):
    return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))


def plain(rows, parts, entries, rounds):
    """({row number: (code, error)}, codebooks) of (id, vector) rows."""
    whole = [(i, None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(1024 * x) for x in v]) for i, v in rows]
    kept = sorted(((i is None, i or 0, v) for i, v in whole if v is not None))
    w = len(kept[0][2]) // parts
    cut = lambda v: [tuple(v[p * w : (p + 1) * w]) for p in range(parts)]
    books = [[cut(v)[p] for _, _, v in kept[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p, book in enumerate(books):
            met = defaultdict(list)
            for _, _, v in kept:
                met[nearest(cut(v)[p], book)[1]].append(cut(v)[p])
            books[p] = [tuple(sum(c) // len(met[e]) for c in zip(*met[e], strict=True)) if e in met else entry for e, entry in enumerate(book)]
    out = []
    for _, _, v in kept:
        best = [nearest(x, b) for x, b in zip(cut(v), books, strict=True)]
        out.append((bytes(e for _, e in best), sum(d for d, _ in best)))
    return [(None if n else i, *o) for (n, i, _), o in zip(kept, out, strict=True)], books


def rows_of(seed, n, dim, scale=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, scale) for _ in range(dim)] for _ in range(5)]
    out = [(i, [x + rng.gauss(0, scale / 9) for x in rng.choice(centres)]) for i in range(n)]
    return out + [(n + k, list(out[0][1])) for k in range(n // 3)]  # a third of all rows are one vector


def frame(spark, rows):
    return spark.createDataFrame([(i, v, (i or 0) % 3 or None, "clash", "clash", "clash", "clash") for i, v in rows], SCHEMA)


@pytest.mark.parametrize(("dim", "entries", "scale"), [(8, 256, 1.0), (8, 20, 0.004), (12, 7, 90_000.0)])
def test_product_codes(spark, dim, entries, scale):
    rows = rows_of(dim + entries, 120, dim, scale)
    odd = [(900, None), (901, [None] * dim), (902, [float("nan")] * dim), (903, [float("inf")] + [0.0] * (dim - 1)), (904, [0.0] * 3), (905, []), (None, [0.5] * dim), (7, [1.0] * dim), (3, rows[3][1])]
    codes, books = product_codes(frame(spark, rows + odd).repartition(4), entries=entries)
    want, plain_books = plain(rows + [(i, v) for i, v in odd if v is None or len(v) == dim], 4, entries, 4)
    assert [[tuple(e) for e in b.tolist()] for b in books] == plain_books
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r[0], bytes(r[2]), r[3]) for r in codes.collect()), key=key) == sorted(want, key=key)


def test_without_rows(spark):
    codes, books = product_codes(frame(spark, []))
    assert codes.collect() == [] and books == []
    assert product_codes(frame(spark, [(1, None), (2, [])]))[0].collect() == []
    with pytest.raises(ValueError, match="256"):
        product_codes(frame(spark, []), entries=257)


def test_components_beyond_bounds_are_held(spark):
    codes, books = product_codes(frame(spark, [(1, [1e300] + [0.0] * 7), (2, [-1e300] + [0.0] * 7)]), entries=1, rounds=1)
    assert all(0 <= r[3] < 1 << 63 for r in codes.collect()) and abs(books[0]).max() < 1 << 31


@pytest.mark.parametrize("big", [100, 1 << 27])
def test_search_equals_all_entries(big):
    rng = np.random.default_rng(big)
    entries = rng.integers(-big, big, (60, 5))
    entries[40:50] = entries[:10]  # equal entries: the smaller index wins
    x = np.concatenate([rng.integers(-big, big, (300, 5)), entries, entries // 2])
    all_ = ((x[:, None, :].astype(object) - entries[None]) ** 2).sum(2)
    book = Book(entries)
    for start in (np.zeros(len(x), np.int64), rng.integers(0, 60, len(x)), all_.argmin(1).astype(np.int64)):
        entry, best = book.nearest(x, start)
        assert (entry == [min(range(60), key=lambda e: (d[e], e)) for d in all_]).all() and (best == all_.min(1)).all()
    assert (distances(x, entries) == all_).all()


def test_search_looks_at_few_entries(monkeypatch):
    looked = []
    rng = np.random.default_rng(1)
    entries = rng.integers(0, 1 << 20, (256, 2))
    book = Book(entries)
    true = vector_codes.distances
    monkeypatch.setattr(vector_codes, "distances", lambda x, c: looked.append(len(x) * len(c)) or true(x, c))
    x = entries[rng.integers(0, 256, 5000)] + rng.integers(-9000, 9000, (5000, 2))
    start = true(x, entries).argmin(1)
    book.nearest(x, start)
    assert sum(looked) < 0.1 * 5000 * 256


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()][:2000]
    out = {r["vec_id"]: r for r in vector_codes.op12_vector_codes(spark, small).collect()}
    codes, _ = plain([(i, v) for i, v in rows], 4, 256, 4) if len(rows) <= 300 else ([], None)
    assert len(out) == len(rows) and all(out[i]["code"] == c.hex() and out[i]["error"] == e for i, c, e in codes)
