"""A character-level bidirectional LSTM with a CRF on top, in numpy: training and decoding of short windows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Symbols: padding, the ASCII characters, other letters, other characters.
SYMBOLS = 131
OTHER_LETTER, OTHER = 129, 130


def symbols(text: str) -> np.ndarray:
    """The number of each code point's symbol."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    out = code + 1
    far = np.flatnonzero(code >= 128)
    out[far] = [OTHER_LETTER if text[i].isalpha() else OTHER for i in far.tolist()]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Tagger:
    """inputs (2, symbols, 4h), hidden (2, h, 4h): the two directions; outputs (2h, tags), bias (tags,): emissions;
    steps (tags, tags): transition scores; allowed (tags + 1, tags): which tag may follow which, last row: may begin."""

    inputs: np.ndarray
    hidden: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray
    steps: np.ndarray
    allowed: np.ndarray

    @property
    def learned(self) -> list[np.ndarray]:
        return [self.inputs, self.hidden, self.outputs, self.bias, self.steps]

    def states(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """The joined hidden states (rows, length, 2h) of rows of symbols, and what a step back needs."""
        rows, length = x.shape
        size = self.hidden.shape[1]
        both = np.stack([x, x[:, ::-1]])
        given = np.stack([self.inputs[k][both[k]] for k in (0, 1)])
        h = c = np.zeros((2, rows, size), dtype=np.float32)
        out, kept = np.empty((2, rows, length, size), dtype=np.float32), []
        for t in range(length):
            a = given[:, :, t] + h @ self.hidden
            gates, new = sigmoid(a[..., : 3 * size]), np.tanh(a[..., 3 * size :])
            i, f, o = gates[..., :size], gates[..., size : 2 * size], gates[..., 2 * size :]
            before, c = c, f * c + i * new
            squashed = np.tanh(c)
            kept.append((h, before, i, f, o, new, squashed))
            h = o * squashed
            out[:, :, t] = h
        return np.concatenate([out[0], out[1][:, ::-1]], axis=2), kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return self.states(x)[0] @ self.outputs + self.bias

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags of each row, by Viterbi's algorithm."""
        scores = self.emissions(x)
        steps = np.where(self.allowed[:-1], self.steps, -1e9)
        best, back = scores[:, 0] + np.where(self.allowed[-1], 0, -1e9), []
        for t in range(1, x.shape[1]):
            ways = best[:, :, None] + steps
            back.append(ways.argmax(1))
            best = ways.max(1) + scores[:, t]
        tags = np.empty(x.shape, dtype=np.int64)
        tags[:, -1] = best.argmax(1)
        for t in range(x.shape[1] - 1, 0, -1):
            tags[:, t - 1] = np.take_along_axis(back[t - 1], tags[:, t : t + 1], 1)[:, 0]
        return tags

    def gradients(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean negative log likelihood of the rows' tags, and its derivatives by what is learned."""
        rows, length = x.shape
        n = self.bias.shape[0]
        states, kept = self.states(x)
        scores = states @ self.outputs + self.bias
        # the CRF: scaled forward and backward sums
        top = scores.max(2, keepdims=True)
        weight, move = np.exp(scores - top), np.exp(self.steps) * self.allowed[:-1].astype(np.float32)
        ahead, scale = np.empty_like(scores), np.empty((rows, length), dtype=np.float32)
        now = weight[:, 0] * self.allowed[-1]
        for t in range(length):
            if t:
                now = (now @ move) * weight[:, t]
            scale[:, t] = now.sum(1)
            now = now / scale[:, t : t + 1]
            ahead[:, t] = now
        behind, pairs = np.ones((rows, n), dtype=np.float32), np.zeros((n, n))
        marginal = np.empty_like(scores)
        for t in range(length - 1, -1, -1):
            marginal[:, t] = ahead[:, t] * behind
            if t:
                onward = weight[:, t] * behind / scale[:, t : t + 1]
                pairs += (ahead[:, t - 1].T @ onward) * move
                behind = onward @ move.T
        one = np.eye(n, dtype=np.float32)[tags]
        true = np.zeros((n, n))
        np.add.at(true, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        loss = np.log(scale).sum(dtype=float) + top.sum(dtype=float) - (scores * one).sum(dtype=float) - (true * self.steps)[true > 0].sum()
        down = (marginal - one) / rows
        d_steps = (pairs - true) * self.allowed[:-1] / rows
        d_outputs = np.tensordot(states, down, axes=([0, 1], [0, 1]))
        d_states = down @ self.outputs.T
        # back through both LSTMs
        size = self.hidden.shape[1]
        d_out = np.stack([d_states[..., :size], d_states[:, ::-1, size:]])
        d_hidden, d_given = np.zeros_like(self.hidden), np.empty((2, rows, length, 4 * size), dtype=np.float32)
        d_h = d_c = np.zeros((2, rows, size), dtype=np.float32)
        turned = self.hidden.transpose(0, 2, 1)
        for t in range(length - 1, -1, -1):
            h, before, i, f, o, new, squashed = kept[t]
            d_h = d_h + d_out[:, :, t]
            d_c = d_c + d_h * o * (1 - squashed * squashed)
            d_a = np.concatenate([d_c * new * i * (1 - i), d_c * before * f * (1 - f), d_h * squashed * o * (1 - o), d_c * i * (1 - new * new)], axis=2)
            d_given[:, :, t] = d_a
            d_hidden += h.transpose(0, 2, 1) @ d_a
            d_h, d_c = d_a @ turned, d_c * f
        d_inputs = np.stack([np.eye(SYMBOLS, dtype=np.float32)[q.ravel()].T @ d_given[k].reshape(-1, 4 * size) for k, q in enumerate((x, x[:, ::-1]))])
        return float(loss / rows), [d_inputs, d_hidden, d_outputs, down.sum((0, 1)), d_steps]


def new_tagger(allowed: np.ndarray, hidden: int, seed: int) -> Tagger:
    rng, n = np.random.default_rng(seed), allowed.shape[1]
    inputs = rng.normal(0, 0.2, (2, SYMBOLS, 4 * hidden))
    inputs[:, :, hidden : 2 * hidden] += 1.0  # remember at first
    parts = (inputs, rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, 4 * hidden)), rng.normal(0, 0.2, (2 * hidden, n)), np.zeros(n), np.zeros((n, n)))
    return Tagger(*[p.astype(np.float32) for p in parts], allowed)


def train(x: np.ndarray, tags: np.ndarray, allowed: np.ndarray, hidden: int = 20, epochs: int = 7, rows: int = 64, rate: float = 0.02, seed: int = 5) -> Tagger:
    """A tagger fitted to rows of symbols and their tags by Adam; the same rows give the same tagger."""
    tagger, rng = new_tagger(allowed, hidden, seed), np.random.default_rng(seed)
    first, second, step = [np.zeros_like(p) for p in tagger.learned], [np.zeros_like(p) for p in tagger.learned], 0
    total = epochs * -(-len(x) // rows)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for low in range(0, len(x), rows):
            some = order[low : low + rows]
            _, slopes = tagger.gradients(x[some], tags[some])
            length = np.sqrt(sum((s * s).sum() for s in slopes))
            slopes = [s * min(1.0, 5.0 / length) for s in slopes]
            step += 1
            pace = rate * (1 - 0.9 * step / total)
            for p, s, m, v in zip(tagger.learned, slopes, first, second, strict=True):
                m += 0.1 * (s - m)
                v += 0.01 * (s * s - v)
                p -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return tagger
