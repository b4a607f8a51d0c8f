"""Small bidirectional recurrent networks in numpy: windows over sequences,
gated cells, backpropagation through time, Adam.

Symbols are small integers, so a cell's input weights are one row per symbol.
Running (not training) steps many windows together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

Params = dict[str, np.ndarray]
#: Windows that step together.
LANES = 1024


def windows(n: int, size: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, end, own start, own end) of overlapping windows over n symbols;
    the own ranges cut the sequence at the middles of the overlaps."""
    if n <= size:
        return [(0, n, 0, n)] if n else []
    out, start, own = [], 0, 0
    while True:
        end = min(start + size, n)
        cut = n if end == n else end - overlap // 2
        out.append((start, end, own, cut))
        if end == n:
            return out
        own, start = cut, end - overlap


def lanes(seqs: list[np.ndarray], size: int, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All windows of all sequences, some LANES at a time, of like lengths:
    rows (sequence, start, end, own start, own end), symbols (time, lane) and lengths."""
    rows = np.array([(k, *w) for k, s in enumerate(seqs) for w in windows(len(s), size, overlap)], dtype=np.int64).reshape(-1, 5)
    if not len(rows):
        return
    flat = np.concatenate(seqs)
    base = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])[:-1]
    length = rows[:, 2] - rows[:, 1]
    order = np.argsort(length, kind="stable")
    for a in range(0, len(order), LANES):
        pick = order[a : a + LANES]
        some, n = rows[pick], length[pick]
        at = np.minimum(np.arange(n.max())[:, None], n - 1) + (base[some[:, 0]] + some[:, 1])
        yield some, flat[at], n


def backwards(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Reverse each lane of (time, ..., lane) within its own length."""
    if (n == len(values)).all():
        return values[::-1]
    at = np.maximum(n - 1 - np.arange(len(values))[:, None], 0)
    return np.take_along_axis(values, at.reshape(len(values), *[1] * (values.ndim - 2), -1), axis=0)


def _by_gate(m: np.ndarray, scale: list[float]) -> np.ndarray:
    """(rows, gates x hidden) as (gate, rows, hidden), each gate scaled."""
    gates = np.stack(np.split(m, len(scale), axis=1))
    return np.ascontiguousarray(gates * np.float32(scale)[:, None, None])


def _squash(a: np.ndarray) -> None:
    """1 / (1 + exp(a)) in place: the sigmoid of -a."""
    np.exp(a, out=a)
    a += 1
    np.reciprocal(a, out=a)


# Gates stand one behind the other as (gate, lane, hidden), so all of them are
# squashed at once; their weights carry the sign, and twice the value where
# tanh(b) = 2 sigmoid(2 b) - 1 is meant.


def _gru_run(x: np.ndarray, e: np.ndarray, u: np.ndarray, out_w: np.ndarray) -> np.ndarray:
    """Outputs (time, classes, lane) of a GRU: gates z, r and candidate."""
    hidden, width = u.shape[0], x.shape[1]
    e, u = _by_gate(e, [-1, -1, -2]), _by_gate(u, [-1, -1, -2])
    head = np.ascontiguousarray(out_w.T)
    h, c = np.zeros((width, hidden), np.float32), np.empty((width, hidden), np.float32)
    a, g = np.empty((3, width, hidden), np.float32), np.empty((2, width, hidden), np.float32)
    out = np.empty((len(x), len(head), width), np.float32)
    with np.errstate(over="ignore"):
        for t, now in enumerate(x.astype(np.intp)):
            e.take(now, axis=1, out=a, mode="clip")
            np.matmul(h, u[:2], out=g)
            g += a[:2]
            _squash(g)
            g[1] *= h
            np.matmul(g[1], u[2], out=c)
            c += a[2]
            _squash(c)
            c *= 2
            c -= 1
            h -= c
            h *= g[0]
            h += c
            np.matmul(head, h.T, out=out[t])
    return out


def _lstm_run(x: np.ndarray, e: np.ndarray, u: np.ndarray, out_w: np.ndarray) -> np.ndarray:
    """Outputs (time, classes, lane) of an LSTM: gates i, f, o and candidate."""
    hidden, width = u.shape[0], x.shape[1]
    e, u = _by_gate(e, [-1, -1, -1, -2]), _by_gate(u, [-1, -1, -1, -2])
    head = np.ascontiguousarray(out_w.T)
    h, c = np.zeros((width, hidden), np.float32), np.zeros((width, hidden), np.float32)
    a, g = np.empty((4, width, hidden), np.float32), np.empty((4, width, hidden), np.float32)
    out = np.empty((len(x), len(head), width), np.float32)
    with np.errstate(over="ignore"):
        for t, now in enumerate(x.astype(np.intp)):
            e.take(now, axis=1, out=a, mode="clip")
            np.matmul(h, u, out=g)
            g += a
            _squash(g)
            new = g[3]
            new *= 2
            new -= 1
            new *= g[0]
            c *= g[1]
            c += new
            np.multiply(c, -2, out=h)
            _squash(h)
            h *= 2
            h -= 1
            h *= g[2]
            np.matmul(head, h.T, out=out[t])
    return out


RUN: dict[str, Callable] = {"gru": _gru_run, "lstm": _lstm_run}
GATES = {"gru": 3, "lstm": 4}


def outputs(p: Params, cell: str, x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Class scores (time, classes, lane) from both directions."""
    ahead = RUN[cell](x, p["ef"], p["uf"], p["wf"])
    back = RUN[cell](backwards(x, n), p["eb"], p["ub"], p["wb"])
    ahead += backwards(back, n)
    ahead += p["bias"][:, None]
    return ahead


def fresh(cell: str, symbols: int, hidden: int, classes: int, seed: int) -> Params:
    rng, g = np.random.default_rng(seed), GATES[cell] * hidden
    draw = lambda *shape, s=0.1: (rng.standard_normal(shape) * s).astype(np.float32)
    p = {k: draw(symbols, g, s=0.3) for k in ("ef", "eb")}
    p |= {k: draw(hidden, g, s=1 / np.sqrt(hidden)) for k in ("uf", "ub")}
    p |= {k: draw(hidden, classes, s=1 / np.sqrt(hidden)) for k in ("wf", "wb")}
    if cell == "lstm":  # remember at first
        p["ef"][:, hidden : 2 * hidden] += 1
        p["eb"][:, hidden : 2 * hidden] += 1
    return p | {"bias": np.zeros(classes, np.float32)}


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return np.tanh(a * 0.5) * 0.5 + 0.5


def _states(cell: str, x: np.ndarray, e: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (time, lane, hidden) and what the way back needs."""
    hidden = u.shape[0]
    h = c = np.zeros((x.shape[1], hidden), np.float32)
    hs, kept = np.empty((len(x), x.shape[1], hidden), np.float32), []
    for t in range(len(x)):
        a = e[x[t]]
        if cell == "gru":
            zr = _sigmoid(a[:, : 2 * hidden] + h @ u[:, : 2 * hidden])
            z, r = zr[:, :hidden], zr[:, hidden:]
            cand = np.tanh(a[:, 2 * hidden :] + (r * h) @ u[:, 2 * hidden :])
            kept.append((h, z, r, cand))
            h = cand + z * (h - cand)
        else:
            g = a + h @ u
            s, cand = _sigmoid(g[:, : 3 * hidden]), np.tanh(g[:, 3 * hidden :])
            i, f, o = s[:, :hidden], s[:, hidden : 2 * hidden], s[:, 2 * hidden :]
            new = f * c + i * cand
            th = np.tanh(new)
            kept.append((h, c, i, f, o, cand, th))
            h, c = o * th, new
        hs[t] = h
    return hs, kept


def _through_time(cell: str, x: np.ndarray, u: np.ndarray, kept: list, dhs: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input rows and the recurrent weights."""
    hidden = u.shape[0]
    du, da = np.zeros_like(u), np.empty((*x.shape, u.shape[1]), np.float32)
    dh = dc = np.zeros_like(dhs[0])
    for t in range(len(x) - 1, -1, -1):
        dh = dh + dhs[t]
        if cell == "gru":
            h, z, r, cand = kept[t]
            dcand = dh * (1 - z) * (1 - cand * cand)
            drh = dcand @ u[:, 2 * hidden :].T
            dzr = np.concatenate([dh * (h - cand) * z * (1 - z), drh * h * r * (1 - r)], axis=1)
            du[:, 2 * hidden :] += (r * h).T @ dcand
            du[:, : 2 * hidden] += h.T @ dzr
            da[t] = np.concatenate([dzr, dcand], axis=1)
            dh = dh * z + drh * r + dzr @ u[:, : 2 * hidden].T
        else:
            h, c, i, f, o, cand, th = kept[t]
            dc = dc + dh * o * (1 - th * th)
            da[t] = np.concatenate([dc * cand * i * (1 - i), dc * c * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - cand * cand)], axis=1)
            du += h.T @ da[t]
            dh, dc = da[t] @ u.T, dc * f
    flat, rows = x.ravel(), da.reshape(-1, da.shape[-1])
    de = np.stack([np.bincount(flat, rows[:, k], symbols) for k in range(rows.shape[1])], axis=1)
    return de.astype(np.float32), du


def train(
    p: Params,
    cell: str,
    x: np.ndarray,
    n: np.ndarray,
    loss: Callable[[Params, np.ndarray, np.ndarray], tuple[float, np.ndarray, Params]],
    epochs: int,
    batch: int,
    rate: float,
    seed: int,
) -> Params:
    """Adam over windows x (window, time) of lengths n.  ``loss(p, scores
    (time, lane, classes), which windows)`` gives the loss, its gradient by the
    scores (zero behind a window's end), and gradients of further parameters."""
    rng = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step, steps = 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            pick = order[a : a + batch]
            ln = n[pick]
            xa = np.ascontiguousarray(x[pick].T[: ln.max()])
            xb = backwards(xa, ln)
            hf, kf = _states(cell, xa, p["ef"], p["uf"])
            hb, kb = _states(cell, xb, p["eb"], p["ub"])
            turned = np.moveaxis(backwards(np.moveaxis(hb, 2, 1), ln), 1, 2)
            _, ds, more = loss(p, hf @ p["wf"] + turned @ p["wb"] + p["bias"], pick)
            ds = ds.astype(np.float32)
            dsb = np.moveaxis(backwards(np.moveaxis(ds, 2, 1), ln), 1, 2) * (np.arange(len(ds))[:, None, None] < ln[:, None])
            g = dict(more)
            g["wf"], g["wb"], g["bias"] = np.einsum("tbh,tbk->hk", hf, ds), np.einsum("tbh,tbk->hk", hb, dsb), ds.sum(axis=(0, 1))
            g["ef"], g["uf"] = _through_time(cell, xa, p["uf"], kf, ds @ p["wf"].T, len(p["ef"]))
            g["eb"], g["ub"] = _through_time(cell, xb, p["ub"], kb, dsb @ p["wb"].T, len(p["eb"]))
            size = np.sqrt(sum(float((d * d).sum()) for d in g.values()))
            step += 1
            now = rate * (1 - 0.9 * step / steps)
            for k, d in g.items():
                d = d * min(1.0, 5.0 / max(size, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                p[k] = (p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p
