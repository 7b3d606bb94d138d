"""Bidirectional gated recurrent network over bytes, in numpy: training by backpropagation through time and
batched inference.

Both directions are computed as one block of arrays shaped (gate, direction, sequence, unit). Gates use
the hard sigmoid clip(x, 0, 1) and states the hard tanh clip(x, -1, 1): exact derivatives, no exp.
"""

from __future__ import annotations

import numpy as np

PAD = 256
F32 = np.float32


def cut(texts: list[bytes], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of ``steps`` bytes (padded with PAD) that cover all texts, and the sequences of each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    rows = -(-sizes // steps)
    out = np.full((int(rows.sum()), steps), PAD, np.int16)
    flat = out.reshape(-1)
    at = 0
    for text, n in zip(texts, rows):
        flat[at:at + len(text)] = np.frombuffer(text, np.uint8)
        at += int(n) * steps
    return out, rows


def start_weights(units: int, labels: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.3, (3, 2, 257, units))
    table[:2] += 0.5                 # gates start half open
    return {k: v.astype(F32) for k, v in {
        "table": table, "loop": rng.normal(0, 0.5 / np.sqrt(units), (3, 2, units, units)),
        "out": rng.normal(0, 0.3, (2, units, labels)), "bias": np.zeros(labels)}.items()}


def _inputs(x: np.ndarray) -> np.ndarray:
    """(time, direction, sequence): bytes forwards and backwards."""
    return np.ascontiguousarray(np.stack([x.T, x.T[::-1]], axis=1), np.int64)


def train(x: np.ndarray, y: np.ndarray, labels: int, units: int, rounds: int = 500, batch: int = 96,
          rate: float = 0.01, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam on the mean cross-entropy of every position's label; PAD positions count nothing."""
    rng = np.random.default_rng(seed)
    w = start_weights(units, labels, seed)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for r in range(rounds):
        pick = rng.integers(0, len(x), batch)
        grads = _gradients(w, x[pick], y[pick])
        step = rate * min(1.0, 2 * (rounds - r) / rounds)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        for k, g in grads.items():
            g *= min(1.0, 1.0 / (norm + 1e-9))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            w[k] -= step * (first[k] / (1 - 0.9 ** (r + 1))) / (np.sqrt(second[k] / (1 - 0.99 ** (r + 1))) + 1e-8)
    return w


def _gradients(w: dict, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    n, steps = x.shape
    units, labels = w["loop"].shape[-1], len(w["bias"])
    ids = _inputs(x)
    lane = np.arange(2)[:, None]
    states = np.zeros((steps + 1, 2, n, units), F32)
    kept = []
    for t in range(steps):
        h = states[t]
        rec = np.matmul(h, w["loop"])                                   # (3, 2, n, units)
        fed = w["table"][:, lane, ids[t]]                               # (3, 2, n, units)
        pre = fed[:2] + rec[:2]
        z, r = gate = np.clip(pre, 0, 1)
        raw = r * rec[2] + fed[2]
        c = np.clip(raw, -1, 1)
        states[t + 1] = h + z * (c - h)
        kept.append((gate, c, rec[2], (pre > 0) & (pre < 1), (raw > -1) & (raw < 1)))
    ahead, back = states[1:, 0], states[:0:-1, 1]                       # both (steps, n, units), in reading order
    logits = ahead @ w["out"][0] + back @ w["out"][1] + w["bias"]
    logits -= logits.max(axis=-1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=-1, keepdims=True)
    real = (x.T != PAD)[..., None]
    p[:, np.arange(n), y] -= 1
    err = (p * real / max(1, real.sum())).astype(F32)
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["bias"] += err.sum(axis=(0, 1))
    g["out"][0] = np.tensordot(ahead, err, ((0, 1), (0, 1)))
    g["out"][1] = np.tensordot(back, err, ((0, 1), (0, 1)))
    to_state = np.stack([err @ w["out"][0].T, (err @ w["out"][1].T)[::-1]], axis=1)
    dh = np.zeros((2, n, units), F32)
    loop_t = np.swapaxes(w["loop"], -1, -2)
    hot = np.zeros((3, 2, 257, units), F32)
    for t in range(steps - 1, -1, -1):
        dh += to_state[t]
        h, (gate, c, rec_c, in_gate, in_c) = states[t], kept[t]
        z, r = gate
        dc = dh * z * in_c
        d = np.stack([dh * (c - h) * in_gate[0], dc * rec_c * in_gate[1], dc])
        for k in range(2):
            np.add.at(hot[:, k], (slice(None), ids[t, k]), d[:, k])
        d[2] = dc * r
        g["loop"] += np.matmul(np.swapaxes(h, -1, -2), d)
        dh = dh * (1 - z) + np.matmul(d, loop_t).sum(axis=0)
    g["table"] = hot
    return g


class Reader:
    """Batched inference: label probabilities of every position, summed for each sequence."""

    def __init__(self, weights: dict[str, np.ndarray], lanes: int = 1024):
        self.w = {k: np.ascontiguousarray(v, F32) for k, v in weights.items()}
        self.lanes = lanes
        self.flat = self.w["table"].reshape(-1, self.w["loop"].shape[-1])
        self.offset = (np.arange(6).reshape(3, 2, 1) * 257).astype(np.int64)

    def _states(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, steps = x.shape
        units = self.flat.shape[1]
        ids = _inputs(x)
        states = np.zeros((steps + 1, 2, n, units), F32)
        index = np.empty((3, 2, n), np.int64)
        fed, rec = np.empty((3, 2, n, units), F32), np.empty((3, 2, n, units), F32)
        for t in range(steps):
            h = states[t]
            np.add(ids[t], self.offset, out=index)
            np.take(self.flat, index, axis=0, out=fed, mode="clip")
            np.matmul(h, self.w["loop"], out=rec)
            gate, c = fed[:2], rec[2]
            gate += rec[:2]
            np.maximum(gate, 0, out=gate)
            np.minimum(gate, 1, out=gate)
            c *= gate[1]
            c += fed[2]
            np.maximum(c, -1, out=c)
            np.minimum(c, 1, out=c)
            c -= h
            c *= gate[0]
            np.add(h, c, out=states[t + 1])
        return states[1:, 0], states[:0:-1, 1]

    def positions(self, x: np.ndarray) -> np.ndarray:
        """(label, step, sequence) probabilities. States lie in [-1, 1], so the exponents are bounded."""
        ahead, back = self._states(x)
        steps, n, units = ahead.shape
        logits = np.matmul(self.w["out"][0].T, np.ascontiguousarray(ahead).reshape(-1, units).T)
        logits += np.matmul(self.w["out"][1].T, np.ascontiguousarray(back).reshape(-1, units).T)
        logits += self.w["bias"][:, None]
        np.clip(logits, -40, 40, out=logits)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits.reshape(-1, steps, n)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """(sequence, label): probabilities of all real positions added up."""
        parts = [np.zeros((0, len(self.w["bias"])), F32)]
        for i in range(0, len(x), self.lanes):
            part = x[i:i + self.lanes]
            p = self.positions(part)
            p *= (part != PAD).T
            parts.append(p.sum(axis=1).T)
        return np.concatenate(parts)
