"""A bidirectional gated recurrent layer in numpy, with backpropagation through time."""

from __future__ import annotations

import numpy as np

F32 = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, F32(0.5), out=x)
    np.tanh(x, out=x)
    x += F32(1)
    x *= F32(0.5)
    return x


class BiGru:
    """Two directions of gated recurrent units, run side by side.

    Inputs come projected: (steps, 2, batch, 3 * hidden), the second direction already
    reversed in time.  The thirds are the update gate, the reset gate and the candidate.
    """

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.hidden = hidden
        scale = 1 / np.sqrt(hidden)
        self.params = {
            "recurrent": rng.uniform(-scale, scale, (2, hidden, 3 * hidden)).astype(F32),
            "bias": np.zeros((2, 1, 3 * hidden), F32),
        }

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state from projected inputs x (which it overwrites) and the state h."""
        n = self.hidden
        u = np.matmul(h, self.params["recurrent"])
        x += self.params["bias"]
        gates = x[..., :2 * n] + u[..., :2 * n]
        _sigmoid(gates)
        update, reset = gates[..., :n], gates[..., n:]
        inner = u[..., 2 * n:]
        candidate = np.tanh(x[..., 2 * n:] + reset * inner)
        return candidate + update * (h - candidate), update, reset, candidate, inner

    def forward(self, inputs: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States of all steps, and what backward needs if kept."""
        steps, _, batch, _ = inputs.shape
        states = np.empty((steps, 2, batch, self.hidden), F32)
        h, kept = np.zeros((2, batch, self.hidden), F32), []
        for t in range(steps):
            before = h
            h, update, reset, candidate, inner = self.step(inputs[t].copy(), h)
            states[t] = h
            if keep:
                kept.append((before, update, reset, candidate, inner))
        return states, kept

    def backward(self, grad: np.ndarray, kept: list) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Gradients of the projected inputs and of the layer, from those of the states."""
        n, u = self.hidden, self.params["recurrent"]
        inputs = np.empty((*grad.shape[:3], 3 * n), F32)
        total = {"recurrent": np.zeros_like(u), "bias": np.zeros_like(self.params["bias"])}
        later = np.zeros(grad.shape[1:], F32)
        for t in range(len(kept) - 1, -1, -1):
            before, update, reset, candidate, inner = kept[t]
            g = grad[t] + later
            to_candidate = g * (1 - update) * (1 - candidate * candidate)
            to_update = g * (before - candidate) * update * (1 - update)
            to_reset = to_candidate * inner * reset * (1 - reset)
            x = inputs[t]
            x[..., :n], x[..., n:2 * n], x[..., 2 * n:] = to_update, to_reset, to_candidate
            through = x.copy()
            through[..., 2 * n:] *= reset
            total["recurrent"] += np.matmul(before.transpose(0, 2, 1), through)
            total["bias"] += x.sum(axis=1, keepdims=True)
            later = g * update + np.matmul(through, u.transpose(0, 2, 1))
        return inputs, total


class Adam:
    """Adam with a linearly falling rate over a known number of updates."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, updates: int):
        self.params, self.rate, self.updates, self.count = params, rate, updates, 0
        self.mean = {k: np.zeros_like(v) for k, v in params.items()}
        self.square = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray], clip: float = 1.0) -> None:
        self.count += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        shrink = min(1.0, clip / max(norm, 1e-12))
        rate = self.rate * max(0.05, 1 - self.count / self.updates)
        rate *= np.sqrt(1 - 0.999**self.count) / (1 - 0.9**self.count)
        for k, g in grads.items():
            g = g * F32(shrink)
            self.mean[k] += F32(0.1) * (g - self.mean[k])
            self.square[k] += F32(0.001) * (g * g - self.square[k])
            self.params[k] -= F32(rate) * self.mean[k] / (np.sqrt(self.square[k]) + F32(1e-8))


def scatter_rows(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of value rows by row number."""
    order = np.argsort(rows, kind="stable")
    rows, values = rows[order], values[order]
    out = np.zeros((size, values.shape[1]), F32)
    if len(rows):
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        out[rows[first]] = np.add.reduceat(values, first, axis=0)
    return out
