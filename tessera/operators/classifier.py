"""Rules of entailment: IF each feature's code is in a set THEN a response, WITH a truth value.

Rules are small and become column expressions; an ensemble votes.  Training compresses
the data to distinct combinations of codes first, so that it depends on the number of
combinations rather than of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .crossentropy import Optimization, optimize

#: Distinct combinations of codes that training may bring to the driver.
COMBINATIONS = 500_000


@dataclass(frozen=True)
class Entailment:
    """premises: per feature the codes that satisfy it; an empty or full set says nothing."""

    premises: tuple[frozenset[float], ...]
    conclusion: float
    truth: float = 1.0

    def __post_init__(self) -> None:
        if not 0 <= self.truth <= 1:
            raise ValueError("a truth value lies in [0, 1]")

    def holds(self, features: Sequence[Column], domains: Sequence[Sequence[float]]) -> Column:
        out = F.lit(True)
        for column, wanted, domain in zip(features, self.premises, domains, strict=True):
            if wanted and len(wanted) < len(domain):
                out = out & column.isin(*sorted(wanted))
        return out

    def text(self, names: Sequence[str], response: str, labels: dict[str, dict[float, str]]) -> str:
        """The rule in words."""
        said = [f"{n} IN {{{', '.join(labels[n][c] for c in sorted(p))}}}" for n, p in zip(names, self.premises, strict=True) if p and len(p) < len(labels[n])]
        return f"IF {' AND '.join(said) or 'TRUE'} THEN {response} IS {labels[response][self.conclusion]} WITH TRUTH {self.truth:g}"


def validate_premises(df: DataFrame, index: str, rule: Entailment, features: Sequence[str], domains: Sequence[Sequence[float]]) -> DataFrame:
    """Indexes of the rows that satisfy every premise."""
    return df.where(rule.holds([F.col(c) for c in features], domains)).select(index)


@dataclass
class EnsembleClassifier:
    """features and response with their codes (domains), and rules that vote."""

    features: tuple[str, ...]
    domains: tuple[tuple[float, ...], ...]
    response: str
    codes: tuple[float, ...]
    rules: list[Entailment] = field(default_factory=list)

    def add(self, premises: Sequence[set[float]], conclusion: float, truth: float = 1.0) -> None:
        if len(premises) != len(self.features) or any(not set(p) <= set(d) for p, d in zip(premises, self.domains, strict=True)) or conclusion not in self.codes:
            raise ValueError("premises and conclusion must be known codes, one set a feature")
        self.rules.append(Entailment(tuple(frozenset(p) for p in premises), conclusion, truth))

    def remove(self, place: int) -> None:
        del self.rules[place]

    def votes(self) -> list[Column]:
        """The truth gathered by each response code."""
        columns = [F.col(c) for c in self.features]
        out = []
        for code in self.codes:
            total = F.lit(0.0)
            for rule in self.rules:
                if rule.conclusion == code:
                    total = total + F.when(rule.holds(columns, self.domains), rule.truth).otherwise(0.0)
            out.append(total)
        return out

    def classify(self, df: DataFrame, name: str = "predicted", seed: int | None = None, key: str | None = None) -> DataFrame:
        """The frame with the code of most votes.

        Ties, also of rows that no rule covers, go to the first code; with a seed and a
        key column to one of the tied codes by a hash, so that a rerun decides alike.
        """
        votes = self.votes()
        best = F.greatest(*votes) if len(votes) > 1 else votes[0]
        if seed is None:
            out = F.lit(self.codes[-1])
            for code, v in reversed(list(zip(self.codes, votes, strict=True))):
                out = F.when(v == best, F.lit(code)).otherwise(out)
            return df.withColumn(name, out)
        tied = F.filter(F.array(*[F.when(v == best, F.lit(c)) for c, v in zip(self.codes, votes, strict=True)]), lambda c: c.isNotNull())
        return df.withColumn("_tied", tied).withColumn(name, F.get("_tied", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.size("_tied")).cast("int"))).drop("_tied")

    def train(self, df: DataFrame, rules: int, seed: int = 0, sequentially: bool = False, draws: int = 100, allow_truth: bool = True) -> None:
        """Learn rules that maximise accuracy, added to those there are."""
        grouped = df.groupBy(*self.features, self.response).agg(F.count(F.lit(1)).alias("n"))
        held = grouped.limit(COMBINATIONS + 1).collect()
        if len(held) > COMBINATIONS:
            raise ValueError("too many distinct combinations of codes to train on")
        x = [np.array([[r[c] == d for d in dom] for r in held]) for c, dom in zip(self.features, self.domains, strict=True)]
        y = np.array([self.codes.index(r[self.response]) for r in held])
        n = np.array([r.n for r in held], float)
        base = np.zeros((len(held), len(self.codes)))
        for rule in self.rules:
            base[:, self.codes.index(rule.conclusion)] += self._matches(x, rule) * rule.truth
        for count in [1] * rules if sequentially else [rules]:
            context = _Training(x, y, n, base, len(self.codes), count, allow_truth)
            state = optimize(context, draws * context.parameters, 0.01, seed).optimal_state
            for masks, conclusion, truth in context.rules_of(state):
                own = Entailment(tuple(frozenset(d for d, m in zip(dom, mask, strict=True) if m) for dom, mask in zip(self.domains, masks, strict=True)), self.codes[conclusion], truth)
                self.rules.append(own)
                base[:, conclusion] += self._matches(x, own) * truth

    def _matches(self, x: list[np.ndarray], rule: Entailment) -> np.ndarray:
        out = np.ones(len(x[0]), bool)
        for onehot, wanted, dom in zip(x, rule.premises, self.domains, strict=True):
            if wanted and len(wanted) < len(dom):
                out &= onehot[:, [d in wanted for d in dom]].any(axis=1)
        return out


class _Training(Optimization):
    """States: per rule a bit for each feature code, a conclusion, a truth value."""

    def __init__(self, x: list[np.ndarray], y: np.ndarray, n: np.ndarray, base: np.ndarray, responses: int, rules: int, allow_truth: bool):
        super().__init__(self.accuracy, True, least=10, most=1000, smoothing=0.9)
        self.x, self.y, self.n, self.base, self.responses, self.count, self.allow = x, y, n, base, responses, rules, allow_truth
        self.bits = sum(o.shape[1] for o in x)
        self.width = self.bits + 2
        self.state_size = self.width * rules
        # per rule: a probability a bit, response probabilities, mean and deviation of the truth
        self.initial = np.tile(np.concatenate([np.full(self.bits, 0.5), np.full(responses, 1 / responses), [0.5, 0.3]]), rules)
        self.parameters = len(self.initial)

    def partial_sample(self, rng: np.random.Generator, parameter: np.ndarray, count: int) -> np.ndarray:
        out = []
        for p in parameter.reshape(self.count, -1):
            bits = rng.random((count, self.bits)) < p[: self.bits]
            q = p[self.bits : self.bits + self.responses]
            code = (rng.random((count, 1)) >= np.cumsum(q / q.sum())[:-1]).sum(axis=1)
            truth = np.clip(rng.normal(p[-2], max(p[-1], 1e-6), count), 0, 1) if self.allow else np.ones(count)
            out.append(np.column_stack([bits, code, truth]))
        return np.column_stack(out)

    def update_parameter(self, elite: np.ndarray, previous: np.ndarray) -> np.ndarray:
        out = []
        for k in range(self.count):
            own = elite[:, k * self.width : (k + 1) * self.width]
            q = [(own[:, self.bits] == c).mean() for c in range(self.responses)]
            out.append(np.concatenate([own[:, : self.bits].mean(axis=0), q, [own[:, -1].mean(), own[:, -1].std()]]))
        return np.concatenate(out)

    def optimal_state(self, parameter: np.ndarray) -> np.ndarray:
        out = []
        for p in parameter.reshape(self.count, -1):
            out.append(np.concatenate([p[: self.bits] > 0.5, [p[self.bits : self.bits + self.responses].argmax()], [p[-2] if self.allow else 1.0]]))
        return np.concatenate(out)

    def rules_of(self, state: np.ndarray) -> list[tuple[list[np.ndarray], int, float]]:
        out = []
        for s in state.reshape(self.count, -1):
            masks, at = [], 0
            for o in self.x:
                masks.append(s[at : at + o.shape[1]] > 0.5)
                at += o.shape[1]
            out.append((masks, int(s[self.bits]), float(s[-1])))
        return out

    def accuracy(self, states: np.ndarray) -> np.ndarray:
        out = np.empty(len(states))
        rows = np.arange(len(self.y))
        for k, state in enumerate(states):
            votes = self.base.copy()
            for masks, code, truth in self.rules_of(state):
                hit = np.ones(len(self.y), bool)
                for onehot, mask in zip(self.x, masks, strict=True):
                    if mask.any() and not mask.all():
                        hit &= onehot[:, mask].any(axis=1)
                votes[hit, code] += truth
            # an undecided row counts for the share of its tied codes
            best = votes == votes.max(axis=1, keepdims=True)
            out[k] = (self.n * best[rows, self.y] / best.sum(axis=1)).sum() / self.n.sum()
        return out


def accuracy(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """The share of rows predicted exactly."""
    return df.agg(F.avg((F.col(predicted) == F.col(actual)).cast("double")).alias("accuracy"))
