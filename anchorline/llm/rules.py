"""Ordered rule lists by incremental reduced-error pruning."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Test:
    """feature <= value, or feature > value."""

    feature: str
    at_most: bool
    value: float

    def sql(self) -> str:
        return f"{self.feature} {'<=' if self.at_most else '>'} {self.value!r}D"


@dataclass
class RuleList:
    """Rules tried in order; the first whose tests all hold gives the kind."""

    rules: list[tuple[tuple[Test, ...], str]]
    default: str

    def to_sql(self) -> str:
        whens = " ".join(f"WHEN {' AND '.join(t.sql() for t in tests)} THEN '{kind}'" for tests, kind in self.rules)
        return f"CASE {whens} ELSE '{self.default}' END" if whens else f"'{self.default}'"

    def predict(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.full(len(x), self.default, dtype=object)
        todo = np.ones(len(x), bool)
        for tests, kind in self.rules:
            hit = todo & _covers(x, tests, names)
            out[hit] = kind
            todo &= ~hit
        return out


def _covers(x: np.ndarray, tests: tuple[Test, ...], names: list[str]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for t in tests:
        col = x[:, names.index(t.feature)]
        hit &= (col <= t.value) if t.at_most else (col > t.value)
    return hit


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], most: int) -> list[Test]:
    """Add the test of highest information gain until no negative is covered."""
    tests: list[Test] = []
    live = np.ones(len(x), bool)
    while len(tests) < most and (~y[live]).any():
        p0, n0 = y[live].sum(), (~y[live]).sum()
        base = np.log2(p0 / (p0 + n0))
        best: tuple[float, Test, np.ndarray] | None = None
        for j, name in enumerate(names):
            col = x[:, j]
            vals = col[live]
            order = np.argsort(vals, kind="stable")
            v, pos = vals[order], y[live][order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            cp, cn = np.cumsum(pos)[cut], np.cumsum(~pos)[cut]
            for at_most, p, n in ((True, cp, cn), (False, p0 - cp, n0 - cn)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / np.maximum(p + n, 1)) - base), -np.inf)
                # Of equal gains the widest gap between the two sides, so the threshold lies clear of the examples.
                top = np.flatnonzero(gain >= gain.max() - 1e-9)
                i = top[np.argmax(v[cut[top] + 1] - v[cut[top]])]
                if best is None or gain[i] > best[0] + 1e-9:
                    value = float(np.round((v[cut[i]] + v[cut[i] + 1]) / 2, 6))
                    test = Test(name, at_most, value)
                    best = (float(gain[i]), test, (col <= value) if at_most else (col > value))
        if best is None or best[0] <= 1e-9:
            break
        tests.append(best[1])
        live &= best[2]
    return tests


def _prune(tests: list[Test], x: np.ndarray, y: np.ndarray, names: list[str]) -> tuple[list[Test], float]:
    """The shortest prefix of the tests that is most accurate on examples not grown on: (p - n) / (p + n)."""
    best, worth = tests, -2.0
    for k in range(1, len(tests) + 1):
        hit = _covers(x, tuple(tests[:k]), names)
        p, n = int((y & hit).sum()), int((~y & hit).sum())
        value = (p - n) / (p + n) if p + n else -1.0
        if value > worth + 1e-12:
            best, worth = tests[:k], value
    return best, worth


def induce(x: np.ndarray, kinds: list[str], names: list[str], order: list[str], default: str, seed: int, most_tests: int = 6, most_rules: int = 12, least_worth: float = 0.9, tries: int = 4) -> RuleList:
    """Learn rules for the kinds in `order`; what no rule covers is `default`.

    For each kind, again and again: two thirds of the examples still there grow a rule, one third prunes it, and the examples it
    covers are removed; a rule worth less than `least_worth` on the pruning third, or empty, is dropped, and `tries` of them in a row end the kind.
    """
    rng = np.random.default_rng(seed)
    kind_of = np.array(kinds, dtype=object)
    left = np.ones(len(x), bool)
    found: list[tuple[tuple[Test, ...], str]] = []
    for kind in order:
        failed = 0
        while failed < tries and sum(k == kind for _, k in found) < most_rules:
            at = np.flatnonzero(left)
            y = kind_of[at] == kind
            if y.sum() < 3:
                break
            part = np.zeros(len(at), bool)
            for side in (True, False):  # both parts hold their share of the kind
                own = rng.permutation(np.flatnonzero(y == side))
                part[own[: (2 * len(own) + 2) // 3]] = True
            grow, prune = at[part], at[~part]
            tests = _grow(x[grow], kind_of[grow] == kind, names, most_tests)
            worth = -1.0
            if tests:
                tests, worth = _prune(tests, x[prune], kind_of[prune] == kind, names)
            if worth < least_worth:
                failed += 1
                continue
            failed = 0
            found.append((tuple(tests), kind))
            left &= ~_covers(x, tuple(tests), names)
    return RuleList(found, default)
