"""A hidden Markov model over sequences of discrete observations, several per place."""

from __future__ import annotations

import numpy as np


class LineHmm:
    """States emit one value of each statistic; tables are probabilities by state and value."""

    def __init__(self, emit: list[np.ndarray], move: np.ndarray):
        emit = [np.asarray(e, float) for e in emit]
        self.emit = [np.log(e / e.sum(1, keepdims=True)) for e in emit]
        move = np.asarray(move, float)
        self.move = np.log(move / move.sum(1, keepdims=True))

    def label(self, obs: np.ndarray) -> np.ndarray:
        """The most probable states of one sequence (places, statistics), by Viterbi."""
        n = len(obs)
        if not n:
            return np.zeros(0, np.int64)
        score = self.emit[0][:, obs[:, 0]].T.copy()
        for k, e in enumerate(self.emit[1:], 1):
            score += e[:, obs[:, k]].T
        if n == 1:
            return score.argmax(1)
        back = np.zeros((n, len(self.move)), np.int8)
        v = score[0]
        for i in range(1, n):
            step = v[:, None] + self.move
            back[i] = step.argmax(0)
            v = step.max(0) + score[i]
        out = np.zeros(n, np.int64)
        out[-1] = v.argmax()
        for i in range(n - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out

    def label_all(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """The labels of many sequences at once: the same as `label` of each, place by place for all."""
        sizes = np.array([len(o) for o in sequences], np.int64)
        out = [np.zeros(n, np.int64) for n in sizes]
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        if not len(order):
            return out
        flat = np.concatenate([sequences[i] for i in order])
        score = self.emit[0][:, flat[:, 0]].T.copy()
        for k, e in enumerate(self.emit[1:], 1):
            score += e[:, flat[:, k]].T
        n = sizes[order]
        start = np.cumsum(n) - n
        # at place t only the sequences longer than t go on; they come first
        alive = np.searchsorted(-n, -np.arange(n[0]), "left")
        v = score[start]
        back = np.zeros((len(flat), len(self.move)), np.int8)
        for t in range(1, n[0]):
            at = start[: alive[t]] + t
            step = v[: alive[t], :, None] + self.move
            back[at] = step.argmax(1)
            v[: alive[t]] = step.max(1) + score[at]
        state, last = v.argmax(1), np.zeros(len(flat), np.int64)
        last[start + n - 1] = state
        for t in range(n[0] - 1, 0, -1):
            m = alive[t]
            at = start[:m] + t
            # a sequence that ends here has its last state; longer ones came from the place behind
            state[:m] = back[at, last[at]]
            last[at - 1] = state[:m]
        for i, a, k in zip(order, start, n, strict=True):
            out[i] = last[a : a + k]
        return out

    def trained(self, sample: list[np.ndarray], prior: float, rounds: int = 3) -> LineHmm:
        """Viterbi training; the present tables weigh as `prior` places."""
        states = len(self.move)
        base_emit = [np.exp(e) * prior / states for e in self.emit]
        base_move = np.exp(self.move) * prior / states
        model = self
        for _ in range(rounds):
            emit, move = [e.copy() for e in base_emit], base_move.copy()
            for o, s in zip(sample, model.label_all(sample), strict=True):
                for k in range(len(emit)):
                    np.add.at(emit[k], (s, o[:, k]), 1.0)
                if len(s) > 1:
                    np.add.at(move, (s[:-1], s[1:]), 1.0)
            model = LineHmm(emit, move)
        return model
