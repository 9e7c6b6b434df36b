"""Expectation-maximisation over votes of weak labellers (+1 good, -1 bad, 0 abstains).

Bad text is of several kinds: one for each labeller, which is the first to notice it.  So the model has a class for good documents and
one for each kind; in each, every labeller has a distribution over the votes that it can give, abstention among them.  (With one
class for all bad text the two classes follow the largest group of labellers that agree, whatever they agree on.)  A labeller that
only ever calls text bad is one-sided.  Documents enter only as counts of vote patterns: ``R`` labellers make ``3**R``
patterns at most, whatever the size of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labellers in one model; bounds the pattern table to 3**8 = 6561 rows.
MOST_LABELLERS = 8
#: Prior vote distribution (bad, abstain, good): of a labeller in its own kind of bad text, in the other kinds, and in good text; for two-sided labellers and those that only vote bad.
TWO_SIDED = ((0.80, 0.15, 0.05), (0.20, 0.40, 0.40), (0.02, 0.18, 0.80))
ONE_SIDED = ((0.80, 0.20, 0.0), (0.20, 0.80, 0.0), (0.02, 0.98, 0.0))
#: Rows that the prior counts for in each class and in the shares of the classes, and the share of good rows.
PRIOR_ROWS, PRIOR_SHARE = 10.0, 0.85
ROUNDS = 40


@dataclass
class VoteModel:
    """``shares`` of the kinds of bad documents and, last, of good ones; ``votes[c][r][v]`` probability of vote ``v - 1`` by labeller ``r`` in
    class ``c``; ``posterior`` of being good, by pattern."""

    shares: list[float]
    votes: list[list[list[float]]]
    posterior: list[float] = field(repr=False)

    @property
    def accuracy(self) -> list[float]:
        """Of each labeller, over the documents that it votes on: of a one-sided one, the share of bad documents among those that it calls bad."""
        out = []
        for r in range(len(self.votes[-1])):
            right = self.shares[-1] * self.votes[-1][r][2] + sum(s * v[r][0] for s, v in zip(self.shares[:-1], self.votes, strict=False))
            wrong = self.shares[-1] * self.votes[-1][r][0] + sum(s * v[r][2] for s, v in zip(self.shares[:-1], self.votes, strict=False))
            out.append(right / (right + wrong) if right + wrong else 0.5)
        return out


def pattern(votes: list[Column]) -> Column:
    """The votes of a row as one number in base 3."""
    if len(votes) > MOST_LABELLERS:
        raise ValueError(f"at most {MOST_LABELLERS} labellers")
    code = F.lit(0)
    for v in votes:
        code = code * 3 + (v + 1)
    return code.cast("int")


def unpack(code: int, labellers: int) -> tuple[int, ...]:
    out = []
    for _ in range(labellers):
        code, v = divmod(code, 3)
        out.append(v)
    return tuple(reversed(out))


def fit(counts: dict[int, int], two_sided: Sequence[bool], rounds: int = ROUNDS) -> VoteModel:
    """Parameters that maximise the posterior, given how many rows show each pattern.

    Starts from "bad if any labeller says so, of the kinds of those that do".  The prior counts for PRIOR_ROWS rows a class, however many
    rows there are; without rows it is returned itself.  A vote that a one-sided labeller cannot give counts as its abstention.
    """
    n = len(two_sided)
    kinds = range(n)
    own = [TWO_SIDED if two else ONE_SIDED for two in two_sided]
    prior = [[own[r][0 if r == c else 1] for r in kinds] for c in kinds] + [[own[r][2] for r in kinds]]
    shares = [(1 - PRIOR_SHARE) / n] * n + [PRIOR_SHARE]
    usual, votes = list(shares), [[list(p) for p in side] for side in prior]
    clean = lambda code: tuple(v if two or v < 2 else 1 for v, two in zip(unpack(code, n), two_sided, strict=True))
    seen = [(clean(k), c) for k, c in sorted(counts.items()) if c]
    total = sum(c for _, c in seen)
    beliefs = []
    for v, _ in seen:
        says = [r for r in kinds if v[r] == 0]
        beliefs.append([(0.95 / len(says) if r in says else 0.0) for r in kinds] + [0.05] if says else [0.05 / n] * n + [0.95])
    for _ in range(rounds if total else 0):
        shares = [(sum(c * b[k] for (_, c), b in zip(seen, beliefs, strict=True)) + PRIOR_ROWS * usual[k]) / (total + PRIOR_ROWS) for k in range(n + 1)]
        votes = [[[PRIOR_ROWS * x for x in p] for p in side] for side in prior]
        for (v, c), b in zip(seen, beliefs, strict=True):
            for side, share in zip(votes, b, strict=True):
                for r, x in enumerate(v):
                    side[r][x] += c * share
        votes = [[[x / sum(row) for x in row] for row in side] for side in votes]
        beliefs = [_beliefs(v, shares, votes) for v, _ in seen]
    return VoteModel(shares, votes, [_beliefs(clean(k), shares, votes)[-1] for k in range(3**n)])


def _beliefs(v: tuple[int, ...], shares: list[float], votes: list[list[list[float]]]) -> list[float]:
    """Posterior of every class, given the votes of a row."""
    logs = [math.log(s) + sum(math.log(row[x]) for row, x in zip(side, v, strict=True)) for s, side in zip(shares, votes, strict=True)]
    most = max(logs)
    each = [math.exp(x - most) for x in logs]
    return [x / sum(each) for x in each]


def fit_frame(df: DataFrame, code: str, two_sided: Sequence[bool]) -> VoteModel:
    """Fit on all rows of ``df``; only the table of patterns (at most ``3**8`` rows) reaches the driver."""
    return fit({r[0]: r[1] for r in df.groupBy(code).count().collect()}, two_sided)


def posterior_of(model: VoteModel, code: Column) -> Column:
    """Probability that a row is good, by its pattern."""
    return F.array(*[F.lit(p) for p in model.posterior])[code]
