"""An averaged perceptron over sparse binary features, small enough to be sent to every task."""

from __future__ import annotations

import random
from collections import Counter, defaultdict


class AveragedPerceptron:
    def __init__(self) -> None:
        self.weights: dict[str, dict[str, float]] = {}
        self.classes: list[str] = []

    def scores(self, features: list[str]) -> dict[str, float]:
        """Scores of the classes that any feature speaks of; the others have 0."""
        total: dict[str, float] = {}
        for f in features:
            if row := self.weights.get(f):
                for c, w in row.items():
                    total[c] = total.get(c, 0.0) + w
        return total

    def predict(self, features: list[str]) -> str:
        """The class of the highest score; the more frequent one of equals."""
        s = self.scores(features)
        return max(self.classes, key=lambda c: s.get(c, 0.0))

    def train(self, examples: list[tuple[list[str], str]], epochs: int = 3, seed: int = 1) -> AveragedPerceptron:
        """examples: features and their class. The result is the mean of the weights over all steps."""
        count = Counter(c for _, c in examples)
        self.classes = sorted(count, key=lambda c: (-count[c], c))  # the most frequent one first
        total: dict[tuple[str, str], float] = defaultdict(float)
        stamp: dict[tuple[str, str], int] = defaultdict(int)
        rows, at, order = self.weights, 0, random.Random(seed)
        index = list(range(len(examples)))
        for _ in range(epochs):
            order.shuffle(index)
            for i in index:
                features, right = examples[i]
                at += 1
                s = self.scores(features)
                guess = max((c for c in self.classes if c != right), key=lambda c: s.get(c, 0.0), default=right)
                if guess == right or s.get(guess, 0.0) < s.get(right, 0.0):
                    continue  # a tie counts as an error
                for f in features:
                    w = rows.setdefault(f, {})
                    for c, d in ((right, 1.0), (guess, -1.0)):
                        total[f, c] += (at - stamp[f, c]) * w.get(c, 0.0)
                        stamp[f, c] = at
                        w[c] = w.get(c, 0.0) + d
        for f, w in rows.items():
            for c in list(w):
                mean = (total[f, c] + (at - stamp[f, c]) * w[c]) / max(1, at)
                if abs(mean) > 0.02:
                    w[c] = mean
                else:
                    del w[c]
        return self
