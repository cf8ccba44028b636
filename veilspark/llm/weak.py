"""Accuracies of overlapping labellers, estimated without labels."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable


def majority(votes: str) -> float:
    return min(0.95, max(0.05, 0.5 + 0.3 * (votes.count("+") - votes.count("-"))))


def reliabilities(
    counts: dict[tuple[str, str], int], start: Callable[[str], float] = majority, rounds: int = 50,
    also: Iterable[tuple[str, str]] = (),
) -> dict[tuple[str, str], float]:
    """Posterior of the positive class by (group, votes), by expectation-maximisation over counts of vote patterns.

    Each group has a prior; each labeller has a rate of '+' and '-' for either class, shared by the groups, and
    '0' (no opinion) says nothing. ``start`` gives the first posterior of a pattern. Patterns in ``also`` get a posterior
    by the last rates, though nothing is counted for them; without any counts, that of ``start``.
    """
    if not counts:
        return {p: start(p[1]) for p in also}
    width = len(next(iter(counts))[1])
    post = {p: start(p[1]) for p in counts}
    for _ in range(rounds):
        prior: dict[str, list[float]] = {}
        # a weak belief that a vote means what it says
        rate = [[{"+": 1.0, "-": 3.0}, {"+": 3.0, "-": 1.0}] for _ in range(width)]
        for (group, votes), n in counts.items():
            own = prior.setdefault(group, [1.0, 1.0])
            q = post[group, votes]
            own[0] += n * (1 - q)
            own[1] += n * q
            for i, a in enumerate(votes):
                if a != "0":
                    rate[i][1][a] += n * q
                    rate[i][0][a] += n * (1 - q)
        for group, votes in counts:
            post[group, votes] = _posterior(prior[group], rate, votes)
    for group, votes in also:
        if (group, votes) not in post:
            post[group, votes] = _posterior(prior.get(group, [1.0, 1.0]), rate, votes)
    return post


def _posterior(prior: list[float], rate: list[list[dict[str, float]]], votes: str) -> float:
    log = [math.log(x) for x in prior]
    for i, a in enumerate(votes):
        if a != "0":
            for c in (0, 1):
                log[c] += math.log(rate[i][c][a] / sum(rate[i][c].values()))
    return 1 / (1 + math.exp(max(-500.0, min(500.0, log[0] - log[1]))))
