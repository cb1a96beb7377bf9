"""A gated recurrent language model in numpy.

Minimal gated units: f = sigmoid(Ef[x] + h Uf), c = tanh(Ec[x] + h Uc), h' = h + f (c - h). The output
softmax is factored by classes of consecutive token ids: p(token) = p(class | h) p(token | class, h).
Many streams run side by side; a document starts with a zero state, and the state is carried from one
window to the next, so a whole document counts however long it is. Training truncates gradients at
window borders and steps by Adagrad.
"""

from __future__ import annotations

import numpy as np

#: Steps of a window in training, where gradients are cut, and in scoring, where only states go on.
STEPS, SCORE_STEPS = 24, 64


class Model:
    """tokens = classes * width ids; hidden units."""

    NAMES = ("E", "U", "Wc", "bc", "Wo", "bo")

    def __init__(self, classes: int, width: int, hidden: int, seed: int = 7):
        self.classes, self.width, self.hidden = classes, width, hidden
        rng = np.random.Generator(np.random.PCG64(seed))
        n = classes * width
        self.E = (rng.standard_normal((n, 2 * hidden)) * 0.1).astype(np.float32)
        self.E[:, :hidden] -= 1  # gates start rather shut: long memory
        self.U = (rng.standard_normal((hidden, 2 * hidden)) * 0.1).astype(np.float32)
        self.Wc = (rng.standard_normal((hidden, classes)) * 0.1).astype(np.float32)
        self.bc = np.zeros(classes, np.float32)
        self.Wo = (rng.standard_normal((classes, hidden, width)) * 0.1).astype(np.float32)
        self.bo = np.zeros((classes, width), np.float32)
        self.sums = {k: np.full_like(getattr(self, k), 1e-3) for k in self.NAMES}

    def start_from(self, counts: np.ndarray) -> None:
        """Biases of the unigram distribution (add one) that counts of token ids give."""
        p = (counts.reshape(self.classes, self.width) + 1.0)
        self.bc = np.log(p.sum(1) / p.sum()).astype(np.float32)
        self.bo = np.log(p / p.sum(1, keepdims=True)).astype(np.float32)

    def vector(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def load(self, vector: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            old = getattr(self, k)
            setattr(self, k, vector[at:at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def _run(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool):
        """x, fresh: steps by streams (token ids, whether a document starts there); h: states. Gives the states before each step (zero at a start), gates and candidates, and the last states."""
        steps, streams = x.shape
        H = self.hidden
        before = np.empty((steps, streams, H), np.float32)
        gates = np.empty((2, steps if keep else 1, streams, H), np.float32)  # apart, so that exp and tanh run over contiguous numbers
        a = np.empty((streams, 2 * H), np.float32)
        live, starting = ~fresh, fresh.any(1).tolist()
        for t in range(steps):
            hp = before[t]
            hp[...] = h
            if starting[t]:
                hp *= live[t][:, None]
            self.E.take(x[t], axis=0, out=a, mode="clip")  # ids are in range; clip spares a buffer
            a += hp @ self.U
            f, c = gates[:, t if keep else 0]
            np.negative(a[:, :H], out=f)
            c[...] = a[:, H:]
            np.exp(f, out=f)
            f += 1
            np.reciprocal(f, out=f)
            np.tanh(c, out=c)
            h = hp + f * (c - hp)
        return before, gates, h

    def _by_token(self, states: np.ndarray, x: np.ndarray):
        """The order that puts equal tokens, and so those of a class, together; states, tokens and their places in their class in it; where each class starts."""
        order = np.argsort(x.astype(np.int16) if self.classes * self.width < 1 << 15 else x, kind="stable")  # small numbers are sorted by radix
        x = x[order]
        starts = np.searchsorted(x, np.arange(self.classes + 1) * self.width)
        klass = np.repeat(np.arange(self.classes), np.diff(starts))
        return order, states[order], x, klass, x - klass * self.width, starts.tolist()

    def log_likelihoods(self, states: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Natural log p of tokens x (n,) after states (n, hidden)."""
        order, states, x, klass, place, starts = self._by_token(states, x)
        at = np.arange(len(x))
        z = states @ self.Wc
        z += self.bc
        found = z[at, klass]
        total = np.exp(z, out=z) @ np.ones(self.classes, np.float32)
        z = np.empty((len(x), self.width), np.float32)
        for k, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
            if a < b:
                np.matmul(states[a:b], self.Wo[k], out=z[a:b])
                z[a:b] += self.bo[k]
        found += z[at, place]
        total *= np.exp(z, out=z) @ np.ones(self.width, np.float32)
        out = np.empty(len(x))
        out[order] = found - np.log(total)
        return out

    def train_window(self, x: np.ndarray, fresh: np.ndarray, valid: np.ndarray, h: np.ndarray, rate: float) -> np.ndarray:
        """One step over a window; valid: which tokens count. Gives the states to go on with."""
        steps, streams = x.shape
        H = self.hidden
        before, gates, last = self._run(x, fresh, h, True)
        flat, ids, n = before.reshape(-1, H), x.ravel(), x.size
        order, s, tokens, klass, place, starts = self._by_token(flat, ids)
        at = np.arange(n)
        scale = valid.ravel()[order].astype(np.float32)
        p = s @ self.Wc
        p += self.bc
        np.exp(p, out=p)
        p *= (scale / (p @ np.ones(self.classes, np.float32)))[:, None]
        p[at, klass] -= scale
        ones = np.ones(n, np.float32)  # sums by BLAS
        g = {"Wc": s.T @ p, "bc": ones @ p, "Wo": np.zeros_like(self.Wo), "bo": np.zeros_like(self.bo)}
        ds = p @ self.Wc.T
        q = np.empty((n, self.width), np.float32)
        used = [(k, starts[k], starts[k + 1]) for k in range(self.classes) if starts[k] < starts[k + 1]]
        for k, a, b in used:
            np.matmul(s[a:b], self.Wo[k], out=q[a:b])
            q[a:b] += self.bo[k]
        np.exp(q, out=q)
        q *= (scale / (q @ np.ones(self.width, np.float32)))[:, None]
        q[at, place] -= scale
        for k, a, b in used:
            np.matmul(s[a:b].T, q[a:b], out=g["Wo"][k])
            np.matmul(ones[a:b], q[a:b], out=g["bo"][k])
            ds[a:b] += q[a:b] @ self.Wo[k].T
        d = np.empty_like(ds)
        d[order] = ds
        d = d.reshape(steps, streams, H)
        da = np.empty((steps, streams, 2 * H), np.float32)
        back = np.zeros((streams, H), np.float32)
        f, c = gates
        slopes = np.empty((steps, streams, 2, H), np.float32)
        rest = 1 - f
        np.multiply((c - before) * f, rest, out=slopes[:, :, 0])
        np.multiply(1 - c * c, f, out=slopes[:, :, 1])
        parts, starting = da.reshape(slopes.shape), fresh.any(1).tolist()
        for t in range(steps - 1, -1, -1):
            np.multiply(back[:, None], slopes[t], out=parts[t])
            back *= rest[t]
            back += da[t] @ self.U.T
            back += d[t]
            if starting[t]:
                back *= ~fresh[t][:, None]
        flat_da = da.reshape(-1, 2 * H)
        g["U"] = flat.T @ flat_da
        first = np.flatnonzero(np.diff(tokens, prepend=-1))
        tokens = tokens[first]
        g["E"] = np.add.reduceat(flat_da[order], first, axis=0)
        # steps are averages over a stream's tokens, with the sum over streams bounded
        for k, value in g.items():
            value /= steps
            norm = float(np.sqrt((value * value).sum()))
            if norm > 50:
                value *= 50 / norm
            if k == "E":
                self.sums["E"][tokens] += value * value
                self.E[tokens] -= rate * value / np.sqrt(self.sums["E"][tokens])
            else:
                self.sums[k] += value * value
                getattr(self, k)[...] -= rate * value / np.sqrt(self.sums[k])
        return last


def lanes(sizes: np.ndarray, streams: int) -> np.ndarray:
    """A stream for each document: longest first, each to the stream that has least so far."""
    load = np.zeros(streams, np.int64)
    out = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        out[i] = k = int(load.argmin())
        load[k] += sizes[i]
    return out


def laid_out(documents: list[np.ndarray], streams: int):
    """Token ids, starts, document numbers (-1: padding), as steps by streams."""
    sizes = np.fromiter(map(len, documents), np.int64, len(documents))
    streams = max(1, min(streams, len(documents)))
    lane = lanes(sizes, streams)
    steps = int(np.bincount(lane, weights=sizes, minlength=streams).max()) if len(documents) else 0
    x = np.zeros((streams, steps), np.int32)
    fresh = np.zeros((streams, steps), bool)
    owner = np.full((streams, steps), -1, np.int32)
    at = [0] * streams
    for i, (doc, k) in enumerate(zip(documents, lane.tolist(), strict=True)):
        lo, hi = at[k], at[k] + len(doc)
        x[k, lo:hi], owner[k, lo:hi], at[k] = doc, i, hi
        if hi > lo:
            fresh[k, lo] = True
    return x.T.copy(), fresh.T.copy(), owner.T.copy()


def train(model: Model, documents: list[np.ndarray], streams: int = 128, rate: float = 0.08) -> None:
    """One pass over documents (arrays of token ids), states carried from window to window."""
    x, fresh, owner = laid_out(documents, streams)
    h = np.zeros((x.shape[1], model.hidden), np.float32)
    for t in range(0, len(x), STEPS):
        live = np.flatnonzero((owner[t:t + STEPS] >= 0).any(0))
        if len(live) < 0.9 * x.shape[1]:  # streams that have ended give no gradient: the steps are the same without them
            x, fresh, owner, h = x[:, live], fresh[:, live], owner[:, live], h[live]
        h = model.train_window(x[t:t + STEPS], fresh[t:t + STEPS], owner[t:t + STEPS] >= 0, h, rate)


def score(model: Model, documents: list[np.ndarray], streams: int = 256) -> np.ndarray:
    """Each document's natural log-likelihood."""
    out = np.zeros(len(documents) + 1)
    x, fresh, owner = laid_out(documents, streams)
    h = np.zeros((x.shape[1], model.hidden), np.float32)
    for t in range(0, len(x), SCORE_STEPS):
        of = owner[t:t + SCORE_STEPS]
        live = np.flatnonzero((of >= 0).any(0))
        if len(live) < 0.7 * x.shape[1]:  # streams that have ended take no more part
            x, fresh, owner, h = x[:, live], fresh[:, live], owner[:, live], h[live]
            of = owner[t:t + SCORE_STEPS]
        before, _, h = model._run(x[t:t + SCORE_STEPS], fresh[t:t + SCORE_STEPS], h, False)
        use = of.ravel() >= 0
        states, tokens, of = before.reshape(-1, model.hidden), x[t:t + SCORE_STEPS].ravel(), of.ravel()
        if not use.all():
            states, tokens, of = states[use], tokens[use], of[use]
        out += np.bincount(of, weights=model.log_likelihoods(states, tokens), minlength=len(out))
    return out[:-1]
