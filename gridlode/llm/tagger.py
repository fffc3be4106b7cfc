"""A character-level bidirectional LSTM with CRF transitions, in numpy: training and decoding of windows."""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Tag 0 is outside; kind k begins with 1 + 2k and goes on with 2 + 2k.
TAGS = 1 + 2 * len(KINDS)
HIDDEN = 24
#: Symbols: 0 padding, 1 other white space, 2 letters outside ASCII, 3 anything else, then printable ASCII.
SYMBOLS = 4 + 95
_LOW = -1e4

_ALLOWED = np.zeros((TAGS, TAGS), bool)
_ALLOWED[:, 0] = True
_ALLOWED[:, 1::2] = True
for _k in range(len(KINDS)):
    _ALLOWED[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = True
_BAN = np.where(_ALLOWED, 0, _LOW)
_BAN_START = np.where(np.arange(TAGS) % 2 == 0, _LOW, 0.0)
_BAN_START[0] = 0


def symbols(text: str) -> np.ndarray:
    """A symbol per code point."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.where((c >= 32) & (c < 127), c - 28, 3)
    out[(c >= 9) & (c <= 13)] = 1
    wide = c > 127
    if wide.any():
        out[wide] = [2 if chr(x).isalpha() else 3 for x in c[wide]]
    return out.astype(np.int16)


def new_weights(seed: int = 11) -> dict[str, np.ndarray]:
    r, h = np.random.default_rng(seed), HIDDEN
    w = {
        "x": r.normal(0, 0.3, (2, SYMBOLS, 4 * h)),
        "h": r.normal(0, 1 / np.sqrt(h), (2, h, 4 * h)),
        "b": np.zeros((2, 4 * h)),
        "o": r.normal(0, 1 / np.sqrt(2 * h), (2, h, TAGS)),
        "t": np.zeros((TAGS, TAGS)),
        "s": np.zeros(TAGS),
    }
    w["b"][:, h : 2 * h] = 1.0  # remember at first
    return {k: v.astype(np.float32) for k, v in w.items()}


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(w: dict, ids: np.ndarray, keep: bool):
    """Hidden states (time, 2, windows, hidden) of both directions; the second one reads backwards."""
    n, steps = ids.shape
    both = np.stack([ids, ids[:, ::-1]])
    side = np.arange(2)[:, None]
    h = np.zeros((2, n, HIDDEN), np.float32)
    c = h.copy()
    states, cache = np.empty((steps, 2, n, HIDDEN), np.float32), []
    for t in range(steps):
        a = w["x"][side, both[:, :, t]] + h @ w["h"] + w["b"][:, None]
        gates, g = _sigmoid(a[..., : 3 * HIDDEN]), np.tanh(a[..., 3 * HIDDEN :])
        i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :]
        new = f * c + i * g
        squashed = np.tanh(new)
        if keep:
            cache.append((h, c, i, f, o, g, squashed))
        h, c = o * squashed, new
        states[t] = h
    return states, cache, both


def emissions(w: dict, ids: np.ndarray) -> np.ndarray:
    """Scores (time, windows, tags)."""
    states = _lstm(w, ids, False)[0]
    return (states[:, 0] @ w["o"][0] + states[::-1, 1] @ w["o"][1]).astype(np.float64)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def forward_backward(w: dict, e: np.ndarray):
    """Log-partition of each window, log-marginals (time, windows, tags), and the two message arrays."""
    trans, start = w["t"] + _BAN, w["s"] + _BAN_START
    a, b = np.empty_like(e), np.zeros_like(e)
    a[0] = start + e[0]
    for t in range(1, len(e)):
        a[t] = _log_sum(a[t - 1][:, :, None] + trans, 1) + e[t]
    for t in range(len(e) - 2, -1, -1):
        b[t] = _log_sum(trans + (b[t + 1] + e[t + 1])[:, None, :], 2)
    total = _log_sum(a[-1], 1)
    return total, a + b - total[:, None], a, b


def viterbi(w: dict, e: np.ndarray) -> np.ndarray:
    """The best tags (windows, time)."""
    trans = w["t"] + _BAN
    best, back = w["s"] + _BAN_START + e[0], []
    for t in range(1, len(e)):
        s = best[:, :, None] + trans
        back.append(s.argmax(axis=1))
        best = s.max(axis=1) + e[t]
    out = np.empty((e.shape[1], len(e)), np.int64)
    out[:, -1] = best.argmax(axis=1)
    rows = np.arange(e.shape[1])
    for t in range(len(e) - 2, -1, -1):
        out[:, t] = back[t][rows, out[:, t + 1]]
    return out


def gradients(w: dict, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood of the tags and its gradients."""
    states, cache, both = _lstm(w, ids, True)
    e = (states[:, 0] @ w["o"][0] + states[::-1, 1] @ w["o"][1]).astype(np.float64)
    total, marginal, a, b = forward_backward(w, e)
    steps, n = len(e), len(ids)
    gold, rows, times = tags.T, np.arange(n), np.arange(steps)[:, None]
    trans = w["t"] + _BAN
    score = e[times, rows, gold].sum(axis=0) + w["s"][gold[0]] + trans[gold[:-1], gold[1:]].sum(axis=0)
    de = np.exp(marginal)
    g = {"s": de[0].sum(axis=0), "t": np.zeros_like(w["t"], np.float64)}
    for t in range(1, steps):
        g["t"] += np.exp(a[t - 1][:, :, None] + trans + (e[t] + b[t])[:, None, :] - total[:, None, None]).sum(axis=0)
    np.add.at(g["t"], (gold[:-1].ravel(), gold[1:].ravel()), -1)
    np.add.at(g["s"], gold[0], -1)
    de[times, rows, gold] -= 1
    de = de.astype(np.float32)
    g["o"] = np.stack([np.einsum("tnh,tnk->hk", states[:, 0], de), np.einsum("tnh,tnk->hk", states[::-1, 1], de)])
    dstates = np.stack([de @ w["o"][0].T, de[::-1] @ w["o"][1].T], axis=1)
    g |= {k: np.zeros_like(w[k]) for k in ("x", "h", "b")}
    dh, dc = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
    side = np.repeat(np.arange(2), n)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, u, squashed = cache[t]
        dh = dh + dstates[t]
        dc = dc + dh * o * (1 - squashed**2)
        da = np.concatenate([dc * u * i * (1 - i), dc * c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - u**2)], axis=2)
        g["h"] += h.transpose(0, 2, 1) @ da
        g["b"] += da.sum(axis=1)
        np.add.at(g["x"], (side, both[:, :, t].ravel()), da.reshape(2 * n, -1))
        dh, dc = da @ w["h"].transpose(0, 2, 1), dc * f
    return float((total - score).mean()), {k: v / n for k, v in g.items()}


def train(ids: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 5) -> dict:
    """Weights fitted by Adam with a falling rate."""
    w, r = new_weights(), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v2 = {k: np.zeros_like(v) for k, v in w.items()}
    rounds = epochs * max(1, (len(ids) + batch - 1) // batch)
    step = 0
    for _ in range(epochs):
        order = r.permutation(len(ids))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            _, g = gradients(w, ids[part], tags[part])
            norm = np.sqrt(sum(float((x.astype(np.float64) ** 2).sum()) for x in g.values()))
            step += 1
            now = rate * (1 - step / (rounds + 1))
            for k in w:
                x = (g[k] * min(1.0, 5.0 / (norm + 1e-9))).astype(np.float32)
                m[k] = 0.9 * m[k] + 0.1 * x
                v2[k] = 0.99 * v2[k] + 0.01 * x * x
                w[k] = w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)
    return w


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of a tag sequence."""
    out, kind, start = [], -1, 0
    for i, t in enumerate([*tags.tolist(), 0]):
        begins, k = t % 2 == 1, (t - 1) // 2 if t else -1
        if kind >= 0 and (begins or k != kind):
            out.append((kind, start, i))
            kind = -1
        if begins:
            kind, start = k, i
    return out
