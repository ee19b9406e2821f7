"""A character tagger in numpy: bidirectional LSTM, and a linear-chain CRF over its scores.

Character codes pick rows of the input weights, so embedding and input projection are one table.
Both directions run as one batched product. Sequences start at rest (zero state).
"""

from __future__ import annotations

import numpy as np

F = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    def __init__(self, codes: int, tags: int, hidden: int = 16, seed: int = 1):
        r = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {
            "x": r.normal(0, 0.3, (2, codes, 4 * hidden)).astype(F),
            "u": r.normal(0, hidden**-0.5, (2, hidden, 4 * hidden)).astype(F),
            "v": r.normal(0, hidden**-0.5, (2, hidden, tags)).astype(F),
            "b": np.zeros(tags, F),
            "a": np.zeros((tags, tags), F),  # from, to
        }
        self.p["x"][:, :, hidden : 2 * hidden] += 1  # remember at first

    def forward(self, ids: np.ndarray, keep: bool = False):
        """Scores (time, row, tag) of codes (time, row)."""
        n, (steps, rows) = self.hidden, ids.shape
        p = self.p
        both = np.stack([ids, ids[::-1]])
        h, c = np.zeros((2, rows, n), F), np.zeros((2, rows, n), F)
        hs, kept = np.empty((steps, 2, rows, n), F), []
        drive = np.stack([p["x"][0][both[0]], p["x"][1][both[1]]], 1)
        for t in range(steps):
            g = drive[t] + h @ p["u"]
            s, z = sigmoid(g[..., : 3 * n]), np.tanh(g[..., 3 * n :])
            i, f, o = s[..., :n], s[..., n : 2 * n], s[..., 2 * n :]
            before, last = c, h
            c = f * before + i * z
            q = np.tanh(c)
            h = o * q
            hs[t] = h
            if keep:
                kept.append((i, f, o, z, before, q, last))
        scores = hs[:, 0] @ p["v"][0] + hs[::-1, 1] @ p["v"][1] + p["b"]
        return (scores, hs, kept, both) if keep else scores

    def gradients(self, ids: np.ndarray, gold: np.ndarray):
        """Loss and gradients of the negative log-likelihood of tags (time, row)."""
        p, n, (steps, rows) = self.p, self.hidden, ids.shape
        scores, hs, kept, both = self.forward(ids, keep=True)
        loss, d_scores, d_a = crf_gradients(scores, p["a"], gold)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["a"] = d_a
        g["b"] = d_scores.sum((0, 1))
        back = [d_scores, d_scores[::-1]]
        for d in (0, 1):  # step by step: one flat product would start BLAS threads for nothing
            g["v"][d] = (hs[:, d].transpose(0, 2, 1) @ back[d]).sum(0)
        d_out = np.stack([b @ p["v"][d].T for d, b in enumerate(back)], 1)
        dh, dc = np.zeros((2, rows, n), F), np.zeros((2, rows, n), F)
        ut = p["u"].transpose(0, 2, 1)
        dgs, lasts = np.empty((steps, 2, rows, 4 * n), F), np.empty((steps, 2, rows, n), F)
        for t in range(steps - 1, -1, -1):
            i, f, o, z, before, q, last = kept[t]
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - q * q)
            dg = np.concatenate([dc * z * i * (1 - i), dc * before * f * (1 - f), dh * q * o * (1 - o), dc * i * (1 - z * z)], -1)
            dc = dc * f
            dh = dg @ ut
            dgs[t], lasts[t] = dg, last
        for d in (0, 1):
            g["u"][d] = (lasts[:, d].transpose(0, 2, 1) @ dgs[:, d]).sum(0)
            flat = dgs[:, d].reshape(-1, 4 * n)
            codes = both[d].reshape(-1)
            by = np.argsort(codes, kind="stable")
            seen, first = np.unique(codes[by], return_index=True)
            g["x"][d][seen] = np.add.reduceat(flat[by], first)
        return loss, g

    def train(self, ids: np.ndarray, gold: np.ndarray, steps: int, rows: int = 48, rate: float = 0.02, seed: int = 1) -> list[float]:
        """Adam over random rows of ids and gold (row, time)."""
        r, m, v, losses = np.random.default_rng(seed), {}, {}, []
        for step in range(1, steps + 1):
            pick = r.integers(0, len(ids), rows)
            loss, g = self.gradients(ids[pick].T, gold[pick].T)
            losses.append(loss)
            norm = max(1.0, float(np.sqrt(sum((x * x).sum() for x in g.values()))) / 5)
            now = rate * min(1.0, 2 * (1 - (step - 1) / steps))
            for k, x in g.items():
                x = x / norm
                m[k] = 0.9 * m.get(k, 0) + 0.1 * x
                v[k] = 0.99 * v.get(k, 0) + 0.01 * x * x
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(F)
        return losses


def crf_gradients(scores: np.ndarray, a: np.ndarray, gold: np.ndarray):
    """Mean loss of rows, and its gradients by scores and by transitions.

    Forward and backward sums are scaled at each step, so they stay numbers of ordinary size.
    """
    steps, rows, tags = scores.shape
    tops = scores.max(2, keepdims=True)
    odds, moves = np.exp(scores - tops), np.exp(a - a.max())
    alpha, beta, scale = np.empty_like(scores), np.ones_like(scores), np.empty((steps, rows, 1), scores.dtype)
    for t in range(steps):
        alpha[t] = odds[0] if t == 0 else (alpha[t - 1] @ moves) * odds[t]
        scale[t] = alpha[t].sum(1, keepdims=True)
        alpha[t] /= scale[t]
    ahead = odds / scale
    for t in range(steps - 2, -1, -1):
        ahead[t + 1] *= beta[t + 1]
        beta[t] = ahead[t + 1] @ moves.T
    total = (np.log(scale) + tops).sum((0, 2)) + (steps - 1) * a.max()
    d_scores = alpha * beta
    d_a = moves * np.einsum("tbi,tbj->ij", alpha[:-1], ahead[1:])
    t, b = np.indices(gold.shape)
    right = scores[t, b, gold].sum(0) + a[gold[:-1], gold[1:]].sum(0)
    d_scores[t, b, gold] -= 1
    np.add.at(d_a, (gold[:-1], gold[1:]), -1)
    return float((total - right).mean()), (d_scores / rows).astype(F), (d_a / rows).astype(F)


class Path:
    """Viterbi's best tags of one sequence whose scores (time, tag) come part by part.

    ``before`` and ``after`` are the tags that stand around the sequence, None at an end. What the best paths of
    all last tags agree on is settled at once, so only steps back to where they part are kept.
    """

    def __init__(self, a: np.ndarray, before: int | None = None):
        self.a, self.every = a.astype(np.float64), np.arange(len(a))
        self.best = None if before is None else self.a[before]
        self.came = np.zeros((0, len(a)), np.int8)
        self.settled: list[np.ndarray] = []
        self.patience = 0

    def feed(self, scores: np.ndarray) -> None:
        came = np.zeros((len(scores), len(self.every)), np.int8)
        best, start = self.best, 0
        if len(scores) and not self.settled and not len(self.came):
            best, start = scores[0] + (0.0 if best is None else best), 1
        for t in range(start, len(scores)):
            sums = best[:, None] + self.a
            last = sums.argmax(0)
            came[t] = last
            best = sums[last, self.every] + scores[t]
        self.best = best if best is None else best - best.max()
        self.came = np.concatenate([self.came, came])
        if len(self.came) > self.patience:
            self.settle()
            self.patience = 2 * len(self.came)

    def settle(self) -> None:
        paths = self.every
        for t in range(len(self.came) - 1, 0, -1):
            paths = self.came[t][paths]
            if (paths == paths[0]).all():  # the tag at t - 1, whatever comes
                self.settled.append(self.back(self.came[:t], int(paths[0])))
                self.came = self.came[t:].copy()
                return

    @staticmethod
    def back(came: np.ndarray, tag: int) -> np.ndarray:
        out = np.empty(len(came), np.int8)
        for t in range(len(came) - 1, -1, -1):
            out[t] = tag
            tag = came[t, tag]
        return out

    def tags(self, after: int | None = None) -> np.ndarray:
        if len(self.came):
            self.settled.append(self.back(self.came, int((self.best if after is None else self.best + self.a[:, after]).argmax())))
            self.came = self.came[:0]
        return np.concatenate(self.settled) if self.settled else np.zeros(0, np.int8)


def viterbi(scores: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The best tags of one sequence of scores (time, tag)."""
    path = Path(a)
    path.feed(scores)
    return path.tags()
