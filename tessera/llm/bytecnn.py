"""A byte-level convolutional network in numpy.

Bytes are embedded, filters of several widths slide over a window, each filter's
responses are max-pooled, and a dense layer follows.  Embedding and filter are both
linear, so at prediction time their product becomes a table over byte pairs: a filter
of width 2k costs k table look-ups a position, whatever the embedding's size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class ByteCNN:
    """Trained parameters. widths are even; filters[i] has shape (width, dims, count)."""

    widths: tuple[int, ...]
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    @property
    def reach(self) -> int:
        """Bytes that a position looks ahead."""
        return max(self.widths) - 1

    def tables(self) -> list[np.ndarray]:
        """For each even offset, the summed response to a byte pair of all filters that reach it.

        Filters are held widest first, so that those of one offset are a prefix.
        """
        out = []
        for at in range(0, max(self.widths), 2):
            own = [w for w in self.filters if w.shape[0] > at]
            first = np.concatenate([self.embedding @ w[at] for w in own], axis=1)
            second = np.concatenate([self.embedding @ w[at + 1] for w in own], axis=1)
            out.append((first[:, None, :] + second[None, :, :]).reshape(65536, -1).astype(np.float32))
        return out


def windows_of(raw: np.ndarray, offsets: np.ndarray, size: int, step: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte windows that cover each row: a (windows, size + reach) array, the window's row, its own bytes.

    Each row has one window at least; past the row's end there are zeros.
    """
    sizes = np.diff(offsets)
    per_row = np.maximum(1, -(-np.maximum(sizes - (size - step), 0) // step))
    row = np.repeat(np.arange(len(sizes)), per_row)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    start = offsets[:-1][row] + rank * step
    left = offsets[1:][row] - start
    padded = np.concatenate([raw, np.zeros(size + reach, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, size + reach)
    out = view[start]
    over = np.flatnonzero(left < size + reach)
    if len(over):
        out[over] *= np.arange(size + reach) < left[over, None]
    return out, row, np.clip(left, 0, size)


def pooled(net: ByteCNN, tables: list[np.ndarray], windows: np.ndarray, block: int = 48) -> np.ndarray:
    """Max-pooled filter responses (windows, filters) before bias and rectifier. The size is a power of two."""
    size = windows.shape[1] - net.reach
    out = np.empty((len(windows), len(net.bias)), np.float32)
    work = np.empty((block * size, tables[0].shape[1]), np.float32)
    more = [np.empty((block * size, t.shape[1]), np.float32) for t in tables[1:]]
    for lo in range(0, len(windows), block):
        part = windows[lo : lo + block]
        pairs = (part[:, :-1].astype(np.intp) << 8) | part[:, 1:]
        n = len(part) * size
        held = work[:n]
        np.take(tables[0], pairs[:, :size].reshape(-1), axis=0, out=held, mode="clip")
        for k, table in enumerate(tables[1:], 1):
            got = more[k - 1][:n]
            np.take(table, pairs[:, 2 * k : 2 * k + size].reshape(-1), axis=0, out=got, mode="clip")
            held[:, : got.shape[1]] += got
        cube = held.reshape(len(part), size, -1)
        h = size
        while h > 1:
            h //= 2
            np.maximum(cube[:, :h], cube[:, h : 2 * h], out=cube[:, :h])
        out[lo : lo + len(part)] = cube[:, 0]
    return out


def logits(net: ByteCNN, features: np.ndarray) -> np.ndarray:
    return np.maximum(features + net.bias, 0) @ net.dense + net.offset


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(
    windows: np.ndarray,
    labels: np.ndarray,
    classes: int,
    widths: tuple[int, ...] = (6, 4, 2),
    count: int = 16,
    dims: int = 8,
    epochs: int = 6,
    rate: float = 0.01,
    batch: int = 64,
    seed: int = 7,
    steps: int = 300,
) -> ByteCNN:
    """Fit by Adam on windows (n, size + reach) with integer labels.

    epochs is raised where needed to make `steps` updates, so that few windows suffice.
    """
    rng = np.random.default_rng(seed)
    assert list(widths) == sorted(widths, reverse=True) and not any(w % 2 for w in widths)
    reach = max(widths) - 1
    size = windows.shape[1] - reach
    p = {"e": rng.normal(0, 0.5, (256, dims)), "d": rng.normal(0, 0.1, (count * len(widths), classes)), "o": np.zeros(classes), "b": np.zeros(count * len(widths))}
    for i, w in enumerate(widths):
        p[f"w{i}"] = rng.normal(0, 1 / np.sqrt(w * dims), (w, dims, count))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    per_epoch = max(1, len(windows) // batch)
    total = max(epochs * per_epoch, steps)
    done = 0
    while done < total:
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            if done >= total:
                break
            pick = order[at : at + batch]
            x, y = windows[pick].astype(np.intp), labels[pick]
            grads = _gradients(p, x, y, widths, count, size)
            done += 1
            now = rate * (1 - 0.9 * done / total)
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p[k] -= now * ((m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.999**done)) + 1e-8) + 1e-4 * p[k])
    f32 = {k: v.astype(np.float32) for k, v in p.items()}
    return ByteCNN(tuple(widths), f32["e"], [f32[f"w{i}"] for i in range(len(widths))], f32["b"], f32["d"], f32["o"])


def _gradients(p: dict, x: np.ndarray, y: np.ndarray, widths: tuple[int, ...], count: int, size: int) -> dict:
    """Gradients of the mean cross-entropy; only each filter's best position passes any on."""
    n = len(x)
    best, peak = [], []
    for i, w in enumerate(widths):
        response = 0
        for k in range(w):
            response = response + (p["e"] @ p[f"w{i}"][k]).astype(np.float32)[x[:, k : k + size]]
        at = response.argmax(axis=1)
        best.append(at)
        peak.append(np.take_along_axis(response, at[:, None, :], axis=1)[:, 0])
    pre = np.concatenate(peak, axis=1) + p["b"]
    h = np.maximum(pre, 0)
    q = softmax(h @ p["d"] + p["o"])
    q[np.arange(n), y] -= 1
    q /= n
    g = {"d": h.T @ q, "o": q.sum(axis=0)}
    back = (q @ p["d"].T) * (pre > 0)
    g["b"] = back.sum(axis=0)
    g["e"] = np.zeros_like(p["e"])
    for i, w in enumerate(widths):
        own = back[:, i * count : (i + 1) * count]
        g[f"w{i}"] = np.zeros_like(p[f"w{i}"])
        for k in range(w):
            seen = np.take_along_axis(x, best[i] + k, axis=1)
            g[f"w{i}"][k] = np.einsum("nf,nfd->df", own, p["e"][seen])
            np.add.at(g["e"], seen.ravel(), (own[:, :, None] * p[f"w{i}"][k].T[None]).reshape(n * count, -1))
    return g
