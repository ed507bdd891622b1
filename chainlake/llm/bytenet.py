"""A small byte-level convolutional network in numpy: filters of several widths, max pooling, softmax over classes.

A text's UTF-8 bytes are cut into windows of fixed length that cover all of it. Filters run over each window and are
max-pooled in it; a document's features are the mean and the maximum of its windows' pooled values.
"""

from __future__ import annotations

import numpy as np

#: Windows that are convolved at a time.
CHUNK = 96


def windows_of(texts: list[str | None], length: int, overlap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Windows (n, length) of bytes, zero-padded, and each window's text. Every text has a window, an empty one zeros."""
    step = length - overlap
    raw = [np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
    counts = [max(1, -(-(len(r) - overlap) // step)) for r in raw]
    out = np.zeros((sum(counts), length), np.uint8)
    at = 0
    for r, n in zip(raw, counts, strict=True):
        for i in range(n):
            part = r[i * step : i * step + length]
            out[at + i, : len(part)] = part
        at += n
    return out, np.repeat(np.arange(len(raw)), counts)


class ByteNet:
    def __init__(self, widths: tuple[int, ...], filters: int, stride: int, window: int, overlap: int, classes: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.widths, self.filters, self.stride, self.window, self.overlap = widths, filters, stride, window, overlap
        n = len(widths) * filters
        #: A filter is a table of each byte's weight at each of its places: a convolution over one-hot bytes.
        self.p = {f"t{i}": (rng.normal(0, 0.3, (w, 256, filters)) / np.sqrt(w)).astype(np.float32) for i, w in enumerate(widths)}
        self.p |= {"c": np.zeros(n, np.float32), "w": rng.normal(0, 0.1, (2 * n, classes)).astype(np.float32), "b": np.zeros(classes, np.float32)}

    def pooled(self, x: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The largest value of each filter in each window, and where it is."""
        out = np.empty((len(x), len(self.p["c"])), np.float32)
        where = np.empty(out.shape, np.int64) if places else None
        for at in range(0, len(x), CHUNK):
            part = x[at : at + CHUNK]
            for i, w in enumerate(self.widths):
                last = self.window - w + 1
                table = self.p[f"t{i}"]
                h = table[0].take(part[:, 0:last : self.stride], axis=0)
                for j in range(1, w):
                    h += table[j].take(part[:, j : j + last : self.stride], axis=0)
                cols = slice(i * self.filters, (i + 1) * self.filters)
                if places:
                    a = h.argmax(axis=1)
                    where[at : at + CHUNK, cols] = a * self.stride
                    out[at : at + CHUNK, cols] = np.take_along_axis(h, a[:, None], axis=1)[:, 0]
                else:
                    out[at : at + CHUNK, cols] = h.max(axis=1)
        return out, where

    def features(self, pooled: np.ndarray, owner: np.ndarray) -> np.ndarray:
        act = np.tanh(pooled + self.p["c"])
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        count = np.diff(np.append(first, len(owner)))[:, None]
        return np.hstack([np.add.reduceat(act, first) / count, np.maximum.reduceat(act, first)])

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """(texts, classes); each row sums to 1."""
        x, owner = windows_of(texts, self.window, self.overlap)
        z = self.features(self.pooled(x)[0], owner) @ self.p["w"] + self.p["b"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def gradients(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        n = len(self.p["c"])
        pooled, where = self.pooled(x, places=True)
        act = np.tanh(pooled + self.p["c"])
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        count = np.diff(np.append(first, len(owner)))[:, None]
        top = np.maximum.reduceat(act, first)
        f = np.hstack([np.add.reduceat(act, first) / count, top])
        z = f @ self.p["w"] + self.p["b"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(len(y)), y] -= 1
        z *= (weight / weight.sum())[:, None]
        g = {"w": f.T @ z, "b": z.sum(axis=0)}
        df = z @ self.p["w"].T
        da = (df[:, :n] / count)[owner]
        at_top = act == top[owner]
        da += df[:, n:][owner] * at_top / np.add.reduceat(at_top, first)[owner]
        dh = da * (1 - act * act)
        g["c"] = dh.sum(axis=0)
        rows = np.arange(len(x))[:, None]
        for i, w in enumerate(self.widths):
            cols = slice(i * self.filters, (i + 1) * self.filters)
            grad = np.zeros_like(self.p[f"t{i}"])
            k = np.arange(self.filters)[None, :]
            for j in range(w):
                np.add.at(grad[j], (x[rows, where[:, cols] + j], k), dh[:, cols])
            g[f"t{i}"] = grad
        return g

    def fit(self, texts: list[str], y: np.ndarray, weight: np.ndarray, steps: int, batch: int = 32, rate: float = 0.01, decay: float = 1e-4, seed: int = 2) -> ByteNet:
        """Adam on the weighted cross-entropy; the rate falls to zero linearly."""
        rng = np.random.default_rng(seed)
        x, owner = windows_of(texts, self.window, self.overlap)
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        order = rng.permutation(len(texts))
        at = 0
        for t in range(1, steps + 1):
            if at >= len(order):
                order, at = rng.permutation(len(texts)), 0
            chosen = order[at : at + batch]
            at += batch
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in chosen])
            own = np.repeat(np.arange(len(chosen)), first[chosen + 1] - first[chosen])
            for k, g in self.gradients(x[rows], own, y[chosen], weight[chosen].astype(np.float32)).items():
                g = g + decay * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                self.p[k] -= (rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self
