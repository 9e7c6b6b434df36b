"""Plain versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(b: bytes | str) -> str:
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def base_quality(text: str | None) -> tuple:
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def substring_dedup(rows: list[tuple], k: int = 35) -> list[tuple]:
    words = [WORD.findall(t or "") for _, t in rows]
    n = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - k + 1) if n[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def shingles(text: str | None, k: int) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def components(rows: list[tuple], k: int, percent: int) -> list[tuple]:
    """(id, size, smallest id); null ids count for nothing but their own rows."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        near = Counter(j for x in s for j in by[x])
        for j, c in near.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                up[max(root(i), root(j))] = min(root(i), root(j))
        for x in s:
            by[x].append(i)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def suffix_dedup(rows: list[tuple], n: int = 100) -> dict:
    """By (id, text): rows that share both are one document."""
    docs = sorted({(d is None, d or 0, (t or "").encode()) for d, t in rows}, key=lambda x: x[:2])
    seen, out = set(), {}
    for none, d, raw in docs:
        gone = bytearray(len(raw))
        for i in range(len(raw) - n + 1):
            if raw[i : i + n] in seen:
                gone[i : i + n] = b"\1" * n
            seen.add(raw[i : i + n])
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[None if none else d, raw] = (len(raw), sum(gone), spans, sha(bytes(c for c, g in zip(raw, gone, strict=True) if not g)))
    return out


KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(text: str | None) -> list[tuple[int, int, int]]:
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def base_licenses(text: str | None) -> tuple:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    found = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def vote_model(counts: dict, two_sided: list, rounds: int, prior_rows: float, prior_share: float, sides: tuple) -> dict:
    """Posterior of every vote pattern (tuples of -1, 0, 1) by EM over one good class and a bad class a labeller, in numpy."""
    import numpy as np

    pats, n = np.array(list(counts)), np.array(list(counts.values()), float)
    r = pats.shape[1]
    hot = (pats[:, :, None] == np.array([-1, 0, 1])).astype(float)
    own = np.array([sides[0] if t else sides[1] for t in two_sided])  # labeller, (own kind, other kind, good), vote
    prior = np.stack([np.where(np.arange(r)[:, None] == c, own[:, 0], own[:, 1]) for c in range(r)] + [own[:, 2]])
    usual = np.array([(1 - prior_share) / r] * r + [prior_share])
    bad = (pats == -1).astype(float)
    says = bad.sum(1, keepdims=True)
    belief = np.where(says > 0, np.hstack([0.95 * bad / np.maximum(says, 1), np.full((len(n), 1), 0.05)]), np.array([0.05 / r] * r + [0.95]))
    for _ in range(rounds):
        shares = (n @ belief + prior_rows * usual) / (n.sum() + prior_rows)
        votes = np.einsum("pc,prv->crv", belief * n[:, None], hot) + prior_rows * prior
        votes /= votes.sum(2, keepdims=True)
        like = shares * np.exp(np.einsum("prv,crv->pc", hot, np.log(np.maximum(votes, 1e-300))))
        belief = like / like.sum(1, keepdims=True)
    return {tuple(p): b for p, b in zip(pats.tolist(), belief[:, -1].tolist(), strict=True)}


def weak_secrets(text: str | None, scope: int, patterns: dict, random_key) -> list[tuple[int, int, int]]:
    """Linked weak spans by comparing every pair of parts; ``patterns`` by kind (3 identifier, 4 key, 5 endpoint)."""
    t = text or ""
    base = base_secrets(t)
    weak = [(m.start(), k, m.end()) for k, p in patterns.items() for m in p.finditer(t) if k != 4 or random_key(m[0])]
    weak = [w for w in weak if not any(w[0] < b[2] and b[0] < w[2] for b in base)]
    role = (0, 1, 0, 1, 0, 2)
    out = []
    for w in weak:
        near = {role[p[1]] for p in (*base, *weak) if p != w and p[0] < w[2] + scope and p[2] > w[0] - scope}
        if (w[1] == 4 and near & {1, 2}) or (w[1] == 3 and 0 in near) or (w[1] == 5 and {0, 1} <= near):
            out.append(w)
    return sorted(base + out)


def licenses(rows: list[tuple], templates: dict, base: dict, common: frozenset, rarest: int, agree: float) -> list[tuple]:
    """(id, labels, score) by scanning every template over every file."""
    import math

    vocabulary = {w for text, _ in templates.values() for w in text.split()} - common
    files = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) for _, t in rows]
    df = Counter(w for f in files for w in set(f) & vocabulary)
    idf = {w: math.log1p(max(1, len(rows)) / (1 + df[w])) for w in vocabulary}
    has = lambda f, p: any(f[i : i + len(p.split())] == p.split() for i in range(len(f)))
    out = []
    for (d, _), f in zip(rows, files, strict=True):
        labels, best = {x for p, x in base.items() if has(f, p)}, 0.0
        for name, (text, keys) in templates.items():
            words = text.split()
            known = set(words) & vocabulary
            top = sorted(((idf[w], w) for w in set(f) & known), reverse=True)[:rarest]
            whole = sum(sorted((idf[w] for w in known), reverse=True)[:rarest])
            shifts = defaultdict(float)
            for i, w in enumerate(f):
                for j, x in enumerate(words):
                    if w == x and (idf.get(w), w) in top:
                        shifts[i - j] += idf[w]
            score = min(1.0, max(shifts.values(), default=0.0) / max(sum(x for x, _ in top), whole * agree, 1e-9))
            if score >= agree and all(has(f, k) for k in keys):
                labels.add(name)
                best = max(best, score)
        out.append((d, ",".join(sorted(labels)), best))
    return out


def redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """Spans but those of endpoints replaced; what overlaps becomes one mark."""
    out, at = "", 0
    for start, kind, end in spans:
        if kind != 5:
            if start >= at:
                out += text[at:start] + "<secret>"
            at = max(at, end)
    return text and out + text[at:]


def mixed(rows: list[tuple], weights: tuple, budget: float, epochs: float, seed: int) -> Counter:
    """How often each (id, source, text) is taken: excess over the caps goes round until none is above."""
    import math

    size = {r: len(WORD.findall(r[2] or "")) for r in rows}
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size[r] for r in rows if r[1] == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, left, free = {}, budget * sum(own.values()), set(sources)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level >= epochs * own[s]}
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: epochs * own[s] for s in full}
        left -= sum(target[s] for s in full)
        free -= full
    out: Counter = Counter()
    for s in sources:
        key = lambda r: hashlib.md5(f"{seed}:{hashlib.md5((r[2] or '').encode()).hexdigest() if r[0] is None else r[0]}".encode()).hexdigest()
        before, whole = 0, math.floor(target[s] / own[s]) if own[s] else 0
        for r in sorted((r for r in rows if r[1] == s), key=lambda r: (key(r), r[0] is not None, r[0] or 0, size[r])):
            out[r] += whole + (size[r] > 0 and before + size[r] / 2 <= target[s] - whole * own[s])
            before += size[r]
    return out
