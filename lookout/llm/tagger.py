"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Works on windows of one length, a batch at a time; arrays are (position, window,
unit). Gradients are written out; the optimizer is Adam.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """``symbols``: number of character classes; ``tags``: number of tags."""

    def __init__(self, symbols: int, tags: int, embed: int = 10, hidden: int = 16, seed: int = 8):
        rng = np.random.default_rng(seed)

        def init(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) * (1 / np.sqrt(shape[0]))).astype(np.float32)

        self.hidden = hidden
        self.p = {"E": init(symbols, embed) * np.float32(3), "U": init(2 * hidden, tags),
                  "c": np.zeros(tags, np.float32), "A": np.zeros((tags, tags), np.float32),
                  "first": np.zeros(tags, np.float32)}
        for way in "fb":
            self.p["W" + way] = init(embed + hidden, 4 * hidden)
            self.p["d" + way] = np.zeros(4 * hidden, np.float32)
            self.p["d" + way][hidden:2 * hidden] = 1  # remember at first

    def _run(self, x: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        """One LSTM over x (position, window, unit), in the given direction."""
        h = self.hidden
        w, d = self.p["W" + way], self.p["d" + way]
        n = len(x)
        inputs = x @ w[:-h] + d
        state = np.zeros((x.shape[1], h), np.float32)
        cell = np.zeros_like(state)
        out, past = np.empty((n, x.shape[1], h), np.float32), []
        for t in range(n) if way == "f" else range(n - 1, -1, -1):
            z = inputs[t] + state @ w[-h:]
            gates = _sigmoid(z[:, :3 * h])
            i, f, o, g = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:], np.tanh(z[:, 3 * h:])
            new = f * cell + i * g
            tanh = np.tanh(new)
            if keep:
                past.append((t, i, f, o, g, cell, state, tanh))
            cell, state = new, o * tanh
            out[t] = state
        return out, past

    def _back(self, x: np.ndarray, way: str, past: list, dout: np.ndarray, grads: dict) -> np.ndarray:
        h = self.hidden
        w = self.p["W" + way]
        dz_all = np.empty((len(x), x.shape[1], 4 * h), np.float32)
        before = np.empty((len(x), x.shape[1], h), np.float32)
        dstate = np.zeros((x.shape[1], h), np.float32)
        dcell = np.zeros_like(dstate)
        for t, i, f, o, g, cell, state, tanh in reversed(past):
            ds = dout[t] + dstate
            dc = dcell + ds * o * (1 - tanh * tanh)
            dz = np.concatenate((dc * g * i * (1 - i), dc * cell * f * (1 - f), ds * tanh * o * (1 - o),
                                 dc * i * (1 - g * g)), axis=1)
            dcell = dc * f
            dstate = dz @ w[-h:].T
            dz_all[t], before[t] = dz, state
        flat = dz_all.reshape(-1, 4 * h)
        grads["W" + way] = np.concatenate((x.reshape(-1, x.shape[2]).T @ flat, before.reshape(-1, h).T @ flat))
        grads["d" + way] = flat.sum(axis=0)
        return dz_all @ w[:-h].T

    def emissions(self, symbols: np.ndarray) -> np.ndarray:
        """(window, position) -> tag scores (position, window, tag)."""
        x = self.p["E"][symbols.T]
        both = np.concatenate([self._run(x, way, False)[0] for way in "fb"], axis=2)
        return both @ self.p["U"] + self.p["c"]

    def _sums(self, em: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log sums over tag paths, and the total."""
        trans = self.p["A"]
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[0] = em[0] + self.p["first"]
        for t in range(1, len(em)):
            alpha[t] = em[t] + _logsumexp(alpha[t - 1][:, :, None] + trans, 1)
        for t in range(len(em) - 2, -1, -1):
            beta[t] = _logsumexp(trans + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        return alpha, beta, _logsumexp(alpha[-1], 1)

    def posteriors(self, symbols: np.ndarray) -> np.ndarray:
        """(window, position) -> probability of each tag (window, position, tag)."""
        alpha, beta, total = self._sums(self.emissions(symbols))
        return np.exp(alpha + beta - total[None, :, None]).transpose(1, 0, 2)

    def loss(self, symbols: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Negative log likelihood a position, and its gradients."""
        p, grads = self.p, {}
        x = p["E"][symbols.T]
        (front, past_f), (back, past_b) = self._run(x, "f", True), self._run(x, "b", True)
        both = np.concatenate((front, back), axis=2)
        em = both @ p["U"] + p["c"]
        alpha, beta, total = self._sums(em)
        n, b, k = em.shape
        gold = np.eye(k, dtype=np.float32)[tags.T]
        pairs = gold[:-1].reshape(-1, k).T @ gold[1:].reshape(-1, k)
        right = (em * gold).sum() + (pairs * p["A"]).sum() + (gold[0] @ p["first"]).sum()
        scale = np.float32(1 / (n * b))
        dem = (np.exp(alpha + beta - total[None, :, None]) - gold) * scale
        grads["first"] = dem[0].sum(axis=0)
        joint = np.zeros((k, k), np.float32)
        for t in range(n - 1):
            joint += np.exp(alpha[t][:, :, None] + p["A"] + (em[t + 1] + beta[t + 1] - total[:, None])[:, None, :]).sum(axis=0)
        grads["A"] = (joint - pairs) * scale
        grads["U"] = both.reshape(-1, both.shape[2]).T @ dem.reshape(-1, k)
        grads["c"] = dem.sum(axis=(0, 1))
        dboth = dem @ p["U"].T
        h = self.hidden
        dx = (self._back(x, "f", past_f, dboth[:, :, :h], grads) + self._back(x, "b", past_b, dboth[:, :, h:], grads))
        grads["E"] = np.zeros_like(p["E"])
        np.add.at(grads["E"], symbols.T, dx)
        return float((total.sum() - right) * scale), grads

    def train(self, symbols: np.ndarray, tags: np.ndarray, epochs: int, batch: int, rate: float, seed: int) -> float:
        """Adam over shuffled batches; returns the mean loss of the last epoch."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, mean = 0, 0.0
        for epoch in range(epochs):
            order, losses = rng.permutation(len(symbols)), []
            for at in range(0, len(order), batch):
                these = order[at:at + batch]
                loss, grads = self.loss(symbols[these], tags[these])
                losses.append(loss)
                step += 1
                speed = rate * (1 - 0.9 * epoch / max(1, epochs - 1))
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (speed * (m[k] / (1 - 0.9 ** step))
                                  / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
            mean = float(np.mean(losses))
        return mean


def best_path(scores: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Viterbi: the tags (position) with the greatest sum of scores (position,
    tag) and transitions."""
    n, k = scores.shape
    best, back = scores[0] + first, np.empty((n, k), np.int64)
    for t in range(1, n):
        each = best[:, None] + trans
        back[t] = each.argmax(axis=0)
        best = each.max(axis=0) + scores[t]
    out = np.empty(n, np.int64)
    out[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out
