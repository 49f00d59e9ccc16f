"""A character tagger in numpy: bidirectional LSTM, then a linear-chain CRF.

Labels are ``O`` and, for each kind, ``B-`` and ``I-``. Training is full-batch-free Adam on windows
of equal length; decoding is Viterbi over many windows at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Character classes: padding, printable ASCII one by one, other letters, blanks, the rest.
_ASCII = 95
PAD, LETTER, BLANK, REST = 0, _ASCII + 1, _ASCII + 2, _ASCII + 3
CLASSES = _ASCII + 4


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.full(len(codes), REST, dtype=np.int64)
    out[codes >= 192] = LETTER
    out[(codes == 9) | (codes == 10) | (codes == 13) | (codes == 160)] = BLANK
    plain = (codes >= 32) & (codes < 127)
    out[plain] = codes[plain] - 31
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """Weights by name. ``fit`` trains new ones."""

    weights: dict[str, np.ndarray]
    n_tags: int
    moments: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict, repr=False)

    @classmethod
    def new(cls, n_tags: int, embed: int = 12, hidden: int = 20, seed: int = 5) -> Tagger:
        draw = np.random.default_rng(seed)
        small = lambda *shape: draw.normal(0, 0.2, shape)
        bias = np.zeros((2, 1, 4 * hidden))
        bias[:, :, hidden : 2 * hidden] = 1.0  # remember at first
        return cls(
            {
                "embed": small(CLASSES, embed),
                "into": small(2, embed, 4 * hidden),
                "back": small(2, hidden, 4 * hidden),
                "bias": bias,
                "out": small(2 * hidden, n_tags),
                "out_bias": np.zeros(n_tags),
                "move": np.zeros((n_tags, n_tags)),
                "first": np.zeros(n_tags),
            },
            n_tags,
        )

    def _forward(self, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Emissions of windows ``x`` (rows, time); both directions run side by side."""
        w = self.weights
        rows, time = x.shape
        hidden = w["back"].shape[1]
        both = np.stack([x, x[:, ::-1]])
        fed = w["embed"][both] @ w["into"][:, None] + w["bias"][:, None]
        h = np.zeros((2, rows, hidden))
        c = np.zeros_like(h)
        states, kept = np.empty((2, rows, time, hidden)), []
        for t in range(time):
            gates = fed[:, :, t] + h @ w["back"]
            i, f, o = (_sigmoid(gates[..., k * hidden : (k + 1) * hidden]) for k in range(3))
            g = np.tanh(gates[..., 3 * hidden :])
            before, h_before = c, h
            c = f * c + i * g
            tanh_c = np.tanh(c)
            h = o * tanh_c
            states[:, :, t] = h
            if keep:
                kept.append((i, f, o, g, before, tanh_c, h_before))
        joined = np.concatenate([states[0], states[1][:, ::-1]], axis=2)
        return joined @ w["out"] + w["out_bias"], [both, joined, kept]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags of each window."""
        emit, _ = self._forward(x, keep=False)
        move = self.weights["move"]
        rows, time, tags = emit.shape
        score = emit[:, 0] + self.weights["first"]
        came = np.empty((time, rows, tags), dtype=np.int64)
        for t in range(1, time):
            options = score[:, :, None] + move
            came[t] = options.argmax(axis=1)
            score = options.max(axis=1) + emit[:, t]
        best = np.empty((rows, time), dtype=np.int64)
        best[:, -1] = score.argmax(axis=1)
        for t in range(time - 1, 0, -1):
            best[:, t - 1] = np.take_along_axis(came[t], best[:, t, None], axis=1)[:, 0]
        return best

    def _chain(self, emit: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, dict]:
        """Negative log likelihood of the tags, with its gradients."""
        move, first = self.weights["move"], self.weights["first"]
        rows, time, tags = emit.shape
        ahead, after = np.empty_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0] + first
        for t in range(1, time):
            ahead[:, t] = _log_sum(ahead[:, t - 1, :, None] + move, 1) + emit[:, t]
        for t in range(time - 2, -1, -1):
            after[:, t] = _log_sum(move + (emit[:, t + 1] + after[:, t + 1])[:, None, :], 2)
        whole = _log_sum(ahead[:, -1], 1)
        chance = np.exp(ahead + after - whole[:, None, None])
        right = np.eye(tags)[y]
        pairs = np.zeros((tags, tags))
        for t in range(1, time):
            joint = (
                ahead[:, t - 1, :, None]
                + move
                + (emit[:, t] + after[:, t])[:, None, :]
                - whole[:, None, None]
            )
            pairs += np.exp(joint).sum(axis=0)
        np.subtract.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        given = (
            first[y[:, 0]].sum()
            + (emit * right).sum()
            + move[y[:, :-1], y[:, 1:]].sum()
        )
        slopes = {"move": pairs, "first": (chance[:, 0] - right[:, 0]).sum(axis=0)}
        return float(whole.sum() - given), chance - right, slopes

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of a batch of windows and its gradients."""
        w = self.weights
        emit, (both, joined, kept) = self._forward(x, keep=True)
        value, d_emit, slopes = self._chain(emit, y)
        rows, time = x.shape
        hidden = w["back"].shape[1]
        slopes["out"] = np.tensordot(joined, d_emit, ([0, 1], [0, 1]))
        slopes["out_bias"] = d_emit.sum(axis=(0, 1))
        d_joined = d_emit @ w["out"].T
        d_states = np.stack([d_joined[..., :hidden], d_joined[:, ::-1, hidden:]])
        d_fed = np.empty((2, rows, time, 4 * hidden))
        d_back = np.zeros_like(w["back"])
        d_h, d_c = np.zeros((2, rows, hidden)), np.zeros((2, rows, hidden))
        back_t = w["back"].transpose(0, 2, 1)
        for t in range(time - 1, -1, -1):
            i, f, o, g, before, tanh_c, h_before = kept[t]
            d_h = d_h + d_states[:, :, t]
            d_c = d_c + d_h * o * (1 - tanh_c**2)
            gates = np.concatenate(
                [
                    d_c * g * i * (1 - i),
                    d_c * before * f * (1 - f),
                    d_h * tanh_c * o * (1 - o),
                    d_c * i * (1 - g**2),
                ],
                axis=2,
            )
            d_fed[:, :, t] = gates
            d_back += h_before.transpose(0, 2, 1) @ gates
            d_h = gates @ back_t
            d_c = d_c * f
        embedded = w["embed"][both].reshape(2, rows * time, -1)
        flat = d_fed.reshape(2, rows * time, -1)
        slopes["back"] = d_back
        slopes["bias"] = flat.sum(axis=1)[:, None, :]
        slopes["into"] = embedded.transpose(0, 2, 1) @ flat
        d_embed = np.zeros_like(w["embed"])
        inner = flat @ w["into"].transpose(0, 2, 1)
        np.add.at(d_embed, both.reshape(2, -1), inner)
        slopes["embed"] = d_embed
        return value / rows, {k: v / rows for k, v in slopes.items()}

    def step(self, slopes: dict[str, np.ndarray], number: int, rate: float) -> None:
        """Adam, with the norm of the gradient held."""
        norm = np.sqrt(sum((s**2).sum() for s in slopes.values()))
        for name, slope in slopes.items():
            slope = slope * min(1.0, 5.0 / max(norm, 1e-9))
            m, v = self.moments.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            self.moments[name] = m, v
            move = (m / (1 - 0.9**number)) / (np.sqrt(v / (1 - 0.99**number)) + 1e-8)
            self.weights[name] = self.weights[name] - rate * move

    @classmethod
    def fit(
        cls,
        x: np.ndarray,
        y: np.ndarray,
        n_tags: int,
        steps: int = 160,
        batch: int = 96,
        rate: float = 0.02,
        seed: int = 5,
    ) -> Tagger:
        tagger, draw = cls.new(n_tags, seed=seed), np.random.default_rng(seed)
        for number in range(1, steps + 1):
            some = draw.integers(0, len(x), min(batch, len(x)))
            _, slopes = tagger.loss(x[some], y[some])
            tagger.step(slopes, number, rate * (1 - 0.9 * number / steps))
        tagger.moments.clear()
        return tagger
