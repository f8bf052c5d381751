"""Incremental reduced-error pruning: an ordered rule list from labelled rows of numbers.

One rule at a time is grown on two thirds of the rows, condition by condition, by FOIL's
information gain, pruned on the other third as long as that helps, and kept if it is right
there in at least 97 cases of 100; the rows that it covers are then left out.
"""

from __future__ import annotations

import numpy as np

Condition = tuple[str, str, float]
Rule = list[Condition]

#: Worth that a shorter rule may lack, and share of its positives that a rule's thresholds are drawn in to.
SLACK, KEPT = 0.02, 0.99
#: Share of negatives from which a rule is grown no further: conditions for the last few are chance.
PURE = 0.01
#: Rows of the pruning third that a rule must cover, so that none is made for a handful.
LEAST = 5


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    n = len(next(iter(x.values())))
    hit = np.ones(n, dtype=bool)
    for name, op, threshold in rule:
        hit &= x[name] >= threshold if op == ">=" else x[name] <= threshold
    return hit


def _grow(x: dict[str, np.ndarray], y: np.ndarray, rows: np.ndarray, most: int, cuts: int, ways: dict[str, str]) -> Rule:
    rule: Rule = []
    inside = rows.copy()
    while len(rule) < most:
        p, n = (y & inside).sum(), (~y & inside).sum()
        if p == 0 or n <= PURE * (p + n):
            break
        base, best = np.log2(p / (p + n)), (1e-9, None)
        for name, values in x.items():
            own = values[inside]
            for t in np.unique(np.quantile(own, np.linspace(0, 1, cuts))):
                for op, hit in ((">=", values >= t), ("<=", values <= t)):
                    if ways.get(name, op) != op:
                        continue
                    both = inside & hit
                    q, m = (y & both).sum(), (~y & both).sum()
                    if q and (q, m) != (p, n):
                        gain = q * (np.log2(q / (q + m)) - base)
                        if gain > best[0]:
                            best = (gain, (name, op, float(t)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= covers([best[1]], x)
    return rule


def _worth(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray, rows: np.ndarray) -> float:
    hit = covers(rule, x) & rows
    p, n = (y & hit).sum(), (~y & hit).sum()
    return (p - n) / (p + n) if p + n else -1.0


def _tightened(rule: Rule, x: dict[str, np.ndarray], positive: np.ndarray) -> Rule:
    """The thresholds drawn in to where the positives are, so that rows far from them aren't covered."""
    own = covers(rule, x) & positive if rule else positive
    if not own.any():
        return rule
    return [(name, op, float(np.quantile(x[name][own], 1 - KEPT if op == ">=" else KEPT))) for name, op in dict.fromkeys((name, op) for name, op, _ in rule)]


def induce(x: dict[str, np.ndarray], y: np.ndarray, seed: int = 1, most_rules: int = 24, most_conditions: int = 4, cuts: int = 60, ways: dict[str, str] | None = None) -> list[Rule]:
    """Rules in order; a row that one of them covers is positive, others are negative. Rows without a positive give no rule.

    ways has the one comparison that may be made of a number of which it is known which way it speaks.
    """
    rng = np.random.default_rng(seed)
    left = np.ones(len(y), dtype=bool)
    rules: list[Rule] = []
    failed = 0
    while (y & left).any() and len(rules) < most_rules:
        growing = left & (rng.random(len(y)) < 2 / 3)
        pruning = left & ~growing
        rule = _grow(x, y, growing, most_conditions, cuts, ways or {})
        while len(rule) > 1 and _worth(rule[:-1], x, y, pruning) >= _worth(rule, x, y, pruning) - SLACK:
            rule = rule[:-1]
        rule = _tightened(rule, x, y & growing)
        if not rule or _worth(rule, x, y, pruning) < 0.94 or (covers(rule, x) & pruning).sum() < LEAST:
            failed += 1  # another division of the rows may give a better one
            if failed > 16:
                break
            continue
        rules.append(rule)
        left &= ~covers(rule, x)
    return rules


def classify(rules: list[Rule], x: dict[str, np.ndarray]) -> np.ndarray:
    n = len(next(iter(x.values())))
    hit = np.zeros(n, dtype=bool)
    for rule in rules:
        hit |= covers(rule, x)
    return hit
