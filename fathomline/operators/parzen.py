"""Tree-structured Parzen search over mixed spaces.

Trials are split into good and bad ones; each parameter gets a density of either kind, and of many
candidates drawn from the good one the one whose density ratio is highest is tried next. The state is
the list of trials, a row each; what is costly, a trial's fits, runs on the cluster, and the
settings of one batch may be evaluated by one job or side by side.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np

STARTUP, CANDIDATES, MOST_GOOD = 15, 24, 25


@dataclass(frozen=True)
class Choice:
    values: tuple

    def draw(self, rng: np.random.Generator):
        return self.values[int(rng.integers(len(self.values)))]

    def weights(self, seen: list) -> np.ndarray:
        """How likely each value is, after those seen and one of each."""
        n = np.array([1.0 + sum(v == s for s in seen) for v in self.values])
        return n / n.sum()


@dataclass(frozen=True)
class Range:
    """Numbers from low to high, both included; log: even in their logarithm; whole: integers."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def inner(self, value: float) -> float:
        return math.log(value) if self.log else float(value)

    @property
    def ends(self) -> tuple[float, float]:
        """Whole numbers reach half a step beyond their ends, so that the ends are as likely as others."""
        half = 0.5 if self.whole else 0.0
        return self.inner(self.low - half), self.inner(self.high + half)

    def outer(self, x: float):
        v = math.exp(x) if self.log else x
        v = min(max(round(v) if self.whole else v, self.low), self.high)
        return int(v) if self.whole else float(v)

    def draw(self, rng: np.random.Generator):
        return self.outer(rng.uniform(*self.ends))


class Density:
    """A mixture of normal curves cut off at the range's ends: one about each value seen, as wide as the gap to its farther neighbour, and a wide one for the whole range."""

    def __init__(self, space: Range, seen: list):
        self.low, self.high = space.ends
        width = self.high - self.low
        prior = (self.low + self.high) / 2
        middle = np.array([*map(space.inner, seen), prior])
        order = np.argsort(middle, kind="stable")
        gaps = np.diff(np.concatenate([[self.low], middle[order], [self.high]]))
        sigma = np.empty(len(middle))
        sigma[order] = np.maximum(gaps[:-1], gaps[1:])
        sigma = np.clip(sigma, width / min(100.0, 1.0 + len(middle)), width)
        sigma[-1] = width
        self.middle, self.sigma = middle, np.maximum(sigma, 1e-12)
        self.inside = np.array([_normal(self.high, m, s) - _normal(self.low, m, s) for m, s in zip(self.middle, self.sigma, strict=True)])

    def draw(self, rng: np.random.Generator) -> float:
        i = int(rng.integers(len(self.middle)))
        for _ in range(100):
            x = rng.normal(self.middle[i], self.sigma[i])
            if self.low <= x <= self.high:
                return x
        return float(np.clip(self.middle[i], self.low, self.high))

    def log(self, x: float) -> float:
        z = (x - self.middle) / self.sigma
        return float(np.log(np.mean(np.exp(-z * z / 2) / (self.sigma * math.sqrt(2 * math.pi) * np.maximum(self.inside, 1e-12))) + 1e-300))


def _normal(x: float, middle: float, sigma: float) -> float:
    return 0.5 * (1 + math.erf((x - middle) / (sigma * math.sqrt(2))))


def good_ones(n: int) -> int:
    """How many of n trials are good."""
    return min(math.ceil(0.1 * n), MOST_GOOD)


def suggest(space: dict[str, Range | Choice], trials: list[tuple[dict, float | None]], rng: np.random.Generator, startup: int = STARTUP, candidates: int = CANDIDATES) -> dict:
    """The next setting after trials (setting, score; the higher the better, None while it runs or if it failed: a bad one).

    At random before `startup` trials have a score. Parameters are looked at one by one.
    """
    scored = sorted((t for t in trials if t[1] is not None), key=lambda t: -t[1])
    if len(scored) < startup:
        return {name: s.draw(rng) for name, s in space.items()}
    k = good_ones(len(scored))
    good = [t[0] for t in scored[:k]]
    bad = [t[0] for t in scored[k:]] + [t[0] for t in trials if t[1] is None]
    out = {}
    for name, s in space.items():
        of_good, of_bad = [t[name] for t in good], [t[name] for t in bad]
        if isinstance(s, Choice):
            a, b = s.weights(of_good), s.weights(of_bad)
            drawn = rng.choice(len(s.values), candidates, p=a)
            out[name] = s.values[int(max(drawn, key=lambda i: math.log(a[i]) - math.log(b[i])))]
        else:
            a, b = Density(s, of_good), Density(s, of_bad)
            drawn = [a.draw(rng) for _ in range(candidates)]
            out[name] = s.outer(max(drawn, key=lambda x: a.log(x) - b.log(x)))
    return out


def search(space: dict[str, Range | Choice], evaluate: Callable[[list[dict]], list[float | None]], n: int, batch: int = 1, seed: int = 42, startup: int = STARTUP, candidates: int = CANDIDATES) -> list[dict]:
    """n trials: a row each of trial (from 1), the setting and score. evaluate gets up to `batch` settings at a time and returns their scores; those of one batch don't know of each other's score, but count as bad trials, so that they differ."""
    rng = np.random.default_rng(seed)
    trials: list[tuple[dict, float | None]] = []
    while len(trials) < n:
        chosen: list[tuple[dict, float | None]] = []
        for _ in range(min(batch, n - len(trials))):
            chosen.append((suggest(space, trials + chosen, rng, startup, candidates), None))
        scores = evaluate([s for s, _ in chosen])
        trials += [(s, None if x is None or math.isnan(x) else float(x)) for (s, _), x in zip(chosen, scores, strict=True)]
    return [{"trial": i, **s, "score": x} for i, (s, x) in enumerate(trials, 1)]


def side_by_side(one: Callable[[dict], float | None], jobs: int) -> Callable[[list[dict]], list[float | None]]:
    """An evaluation of settings one by one, so many at a time: Spark runs the jobs of several threads together, which fills the cluster where one setting's fits are small."""

    def evaluate(settings: list[dict]) -> list[float | None]:
        with ThreadPoolExecutor(jobs) as pool:
            return list(pool.map(one, settings))

    return evaluate
