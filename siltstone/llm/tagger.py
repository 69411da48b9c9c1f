"""Character tagger: a bidirectional LSTM with CRF transitions, in numpy, trained from labelled spans."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Characters above are folded into classes by kind.
ASCII = 128
CLASSES = ASCII + 3


def codes(text: str) -> np.ndarray:
    """A class for each code point: ASCII as it is; other letters, white space and the rest."""
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    out = raw.copy()
    for k in np.flatnonzero(raw >= ASCII):
        out[k] = ASCII if text[k].isalpha() else ASCII + 1 if text[k].isspace() else ASCII + 2
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _total(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Tagger:
    """Tags 0 (outside), then begin and inside of each kind. Windows are padded on the right with class 0 and a mask."""

    kinds: tuple[str, ...]
    width: int = 20
    embedding: int = 12
    seed: int = 7
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if self.weights:
            return
        rng = np.random.default_rng(self.seed)
        h, e, k = self.width, self.embedding, self.tags
        w = self.weights
        w["embed"] = rng.normal(0, 0.3, (CLASSES, e))
        for side in ("f", "b"):
            w[f"x{side}"] = rng.normal(0, 1 / np.sqrt(e), (e, 4 * h))
            w[f"h{side}"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            w[f"c{side}"] = np.r_[np.ones(h), np.zeros(3 * h)]  # forget gates begin open
        w["out"] = rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, k))
        w["bias"] = np.r_[1.0, np.zeros(k - 1)]
        w["next"] = rng.normal(0, 0.1, (k, k))
        self.weights = {name: x.astype(np.float32) for name, x in w.items()}

    @property
    def tags(self) -> int:
        return 1 + 2 * len(self.kinds)

    def _lstm(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool):
        """x: batch, time, embedding. Padded places keep the state. Backward for side b."""
        h, (n, t, _) = self.width, x.shape
        gates = x.reshape(n * t, -1) @ self.weights[f"x{side}"] + self.weights[f"c{side}"]
        gates = gates.reshape(n, t, 4 * h)
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out = np.zeros((n, t, h), np.float32)
        saved = []
        for i in range(t) if side == "f" else range(t - 1, -1, -1):
            z = gates[:, i] + state @ self.weights[f"h{side}"]
            s = _sigmoid(z[:, : 3 * h])
            g = np.tanh(z[:, 3 * h :])
            m = mask[:, i : i + 1]
            new = s[:, :h] * cell + s[:, h : 2 * h] * g
            u = np.tanh(new)
            if keep:
                saved.append((i, s, g, u, cell, state, m))
            cell = np.where(m, new, cell)
            state = np.where(m, s[:, 2 * h :] * u, state)
            out[:, i] = state
        return out, saved

    def _lstm_back(self, x: np.ndarray, d_out: np.ndarray, saved: list, side: str, grad: dict[str, np.ndarray]) -> np.ndarray:
        h, (n, t, e) = self.width, x.shape
        d_gates = np.zeros((n, t, 4 * h), np.float32)
        d_state, d_cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for i, s, g, u, cell, state, m in reversed(saved):
            d_state = d_state + d_out[:, i]
            f, a, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
            d_new = (d_state * o * (1 - u * u) + d_cell) * m
            dz = np.concatenate([d_new * cell * f * (1 - f), d_new * g * a * (1 - a), d_state * m * u * o * (1 - o), d_new * a * (1 - g * g)], axis=1)
            d_gates[:, i] = dz
            grad[f"h{side}"] += state.T @ dz
            d_cell = np.where(m, d_new * f, d_cell)
            d_state = np.where(m, dz @ self.weights[f"h{side}"].T, d_state)
        flat = d_gates.reshape(n * t, -1)
        grad[f"x{side}"] += x.reshape(n * t, e).T @ flat
        grad[f"c{side}"] += flat.sum(axis=0)
        return (flat @ self.weights[f"x{side}"].T).reshape(n, t, e)

    def _emissions(self, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        x = self.weights["embed"][ids]
        forward, kept_f = self._lstm(x, mask, "f", keep)
        backward, kept_b = self._lstm(x, mask, "b", keep)
        both = np.concatenate([forward, backward], axis=2)
        return both @ self.weights["out"] + self.weights["bias"], x, both, kept_f, kept_b

    def _step(self, ids: np.ndarray, mask: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients: the CRF's negative log likelihood by forward and backward sums."""
        grad = {k: np.zeros_like(v) for k, v in self.weights.items()}
        scores, x, both, kept_f, kept_b = self._emissions(ids, mask, keep=True)
        n, t, k = scores.shape
        move = self.weights["next"]
        alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
        alpha[:, 0] = scores[:, 0]
        for i in range(1, t):
            step = _total(alpha[:, i - 1, :, None] + move, 1) + scores[:, i]
            alpha[:, i] = np.where(mask[:, i : i + 1], step, alpha[:, i - 1])
        whole = _total(alpha[:, -1], 1)
        for i in range(t - 2, -1, -1):
            step = _total(move + (scores[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where(mask[:, i + 1 : i + 2], step, 0)
        d = np.exp(alpha + beta - whole[:, None, None]) * mask[:, :, None]
        rows = np.arange(n)
        loss = float(whole.sum())
        for i in range(t):
            on = mask[:, i]
            loss -= float((scores[rows, i, gold[:, i]] * on).sum())
            d[rows, i, gold[:, i]] -= on
            if i:
                pair = np.exp(alpha[:, i - 1, :, None] + move + (scores[:, i] + beta[:, i])[:, None, :] - whole[:, None, None]) * on[:, None, None]
                grad["next"] += pair.sum(axis=0)
                np.add.at(grad["next"], (gold[on, i - 1], gold[on, i]), -1)
                loss -= float((move[gold[:, i - 1], gold[:, i]] * on).sum())
        grad["out"] += both.reshape(n * t, -1).T @ d.reshape(n * t, k)
        grad["bias"] += d.sum(axis=(0, 1))
        d_both = d @ self.weights["out"].T
        d_x = self._lstm_back(x, d_both[:, :, : self.width], kept_f, "f", grad) + self._lstm_back(x, d_both[:, :, self.width :], kept_b, "b", grad)
        np.add.at(grad["embed"], ids[mask], d_x[mask])
        return loss / n, {name: g / n for name, g in grad.items()}

    def _pad(self, texts: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.zeros((len(texts), width), np.int64)
        mask = np.zeros((len(texts), width), bool)
        for row, text in enumerate(texts):
            ids[row, : len(text)] = text
            mask[row, : len(text)] = True
        return ids, mask

    def train(self, texts: list[str], spans: list[list[tuple[int, int, str]]], steps: int = 500, batch: int = 32, rate: float = 0.01) -> list[float]:
        """Adam with a falling rate over windows drawn anew in each round, by the seed. Spans: (start, end, kind) of each window. Returns the losses."""
        rng = np.random.default_rng(self.seed)
        coded = [codes(t) for t in texts]
        gold = []
        for text, own in zip(coded, spans, strict=True):
            tags = np.zeros(len(text), np.int64)
            for start, end, kind in own:
                k = self.kinds.index(kind)
                tags[start:end] = 2 + 2 * k
                tags[start] = 1 + 2 * k
            gold.append(tags)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        losses, order = [], np.zeros(0, np.int64)
        for step in range(1, steps + 1):
            if len(order) < batch:
                order = np.r_[order, rng.permutation(len(texts))]
            chosen, order = order[:batch], order[batch:]
            width = max(len(coded[i]) for i in chosen)
            ids, mask = self._pad([coded[i] for i in chosen], width)
            tags, _ = self._pad([gold[i] for i in chosen], width)
            loss, grad = self._step(ids, mask, tags)
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            now = rate * min(1.0, 1.1 - step / steps)
            for name, g in grad.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                self.weights[name] = (self.weights[name] - now * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return losses

    def decode(self, texts: list[np.ndarray], at_once: int = 256) -> list[np.ndarray]:
        """The best tags of each window, by the CRF's transitions; an inside tag only follows a tag of its kind."""
        move = self.weights["next"].copy()
        for k in range(len(self.kinds)):
            allowed = np.zeros(self.tags, bool)
            allowed[[1 + 2 * k, 2 + 2 * k]] = True
            move[~allowed, 2 + 2 * k] = -1e4
        out: list[np.ndarray] = []
        for a in range(0, len(texts), at_once):
            part = texts[a : a + at_once]
            ids, mask = self._pad(part, max(map(len, part)))
            scores = self._emissions(ids, mask)[0]
            best = scores[:, 0].copy()
            best[:, 2::2] -= 1e4
            came = np.zeros(scores.shape, np.int64)
            for i in range(1, scores.shape[1]):
                step = best[:, :, None] + move
                came[:, i] = step.argmax(axis=1)
                best = np.where(mask[:, i : i + 1], step.max(axis=1) + scores[:, i], best)
            tag = best.argmax(axis=1)
            tags = np.zeros(ids.shape, np.int64)
            for i in range(scores.shape[1] - 1, -1, -1):
                tags[:, i] = tag
                tag = np.where(mask[:, i], came[np.arange(len(part)), i, tag], tag)
            out += [row[: len(text)] for row, text in zip(tags, part, strict=True)]
        return out
