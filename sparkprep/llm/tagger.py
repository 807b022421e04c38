"""A character-level bidirectional LSTM with CRF transitions, in numpy: forward pass, Viterbi decoding and training.

Gates are hard sigmoids and states pass through x / (1 + |x|), which numpy evaluates several times faster than exponentials;
the network is trained with the same functions. As inputs are discrete (character class and word flag), embedding and input
projection are folded into one table per direction before decoding.
"""

from __future__ import annotations

import multiprocessing
import unicodedata

import numpy as np

KINDS = ("person", "email", "phone", "id_number", "address")
#: Tags: 0 outside; 1 + 2k begins kind k, 2 + 2k continues it.
N_TAGS = 1 + 2 * len(KINDS)
N_FLAGS = 3
#: Windows at a time: OpenBLAS multiplies without packing up to a million products, here 227 windows for 107 rows and 41 inputs.
TOGETHER = 224


def _classes() -> np.ndarray:
    """Class of each code point below 0x3000: printable ASCII as itself, accented letters as their base in upper or lower case."""
    out = np.full(0x3000, 3, np.int16)
    for i in range(0x3000):
        c = chr(i)
        base = unicodedata.normalize("NFD", c)[0]
        if 32 <= i < 127:
            out[i] = i - 32 + 8
        elif c in "\n\r":
            out[i] = 0
        elif c.isspace():
            out[i] = 8
        elif c == "ß":
            out[i] = ord("s") - 24
        elif base.isascii() and base.isalpha():
            out[i] = ord(base) - 24
        elif c in "’‘":
            out[i] = ord("'") - 24
        elif c in "–—‐‑":
            out[i] = ord("-") - 24
        elif c in "ºª°":
            out[i] = 7
        elif c.isalpha():
            out[i] = 2
        elif c.isdigit():
            out[i] = ord("0") - 24
        elif not c.isprintable():
            out[i] = 1
    return out


CLASSES = _classes()
N_CLASSES = 8 + 95
_ALL_CLASSES = np.concatenate([CLASSES, np.full(0x110000 - len(CLASSES), 2, np.int16)])


def char_classes(text: str) -> np.ndarray:
    return _ALL_CLASSES.take(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(0.25 * x + 0.5, 0, 1)


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def allowed() -> np.ndarray:
    """(from, to) log-score 0 or -inf: a kind is continued only after its beginning or continuation."""
    out = np.zeros((N_TAGS, N_TAGS), np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = -1e4
        out[[inside - 1, inside], inside] = 0
    return out


class Tagger:
    """``p`` holds E (classes*flags, d) and for each direction Wx, Wh, b, and the output W, c, and the transitions T, first tags F."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        self.hidden = self.p["Wh0"].shape[0]

    @classmethod
    def fresh(cls, hidden: int = 24, size: int = 16, seed: int = 5) -> Tagger:
        rng = np.random.default_rng(seed)
        p = {"E": rng.normal(0, 0.5, (N_CLASSES * N_FLAGS, size)), "W": rng.normal(0, 0.2, (2 * hidden, N_TAGS)), "c": np.zeros(N_TAGS), "T": np.zeros((N_TAGS, N_TAGS)), "F": np.zeros(N_TAGS)}
        for d in (0, 1):
            p |= {f"Wx{d}": rng.normal(0, 0.25, (size, 4 * hidden)), f"Wh{d}": rng.normal(0, 0.2, (hidden, 4 * hidden)), f"b{d}": np.concatenate([np.zeros(hidden), np.full(hidden, 2.0), np.zeros(2 * hidden)])}
        return cls(p)

    def save(self, path: str, **more: np.ndarray) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.p.items()}, **more)

    def emissions(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(n, t, tags) scores of windows of symbols; padding is at the end."""
        n, steps = x.shape
        h2 = self.hidden
        out = np.zeros((steps, n, N_TAGS), np.float32)
        for d in (0, 1):
            table = self.p["E"] @ self.p[f"Wx{d}"] + self.p[f"b{d}"]
            h, c = np.zeros((n, h2), np.float32), np.zeros((n, h2), np.float32)
            wh, w = self.p[f"Wh{d}"], self.p["W"][d * h2 : (d + 1) * h2]
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                z = h @ wh
                z += table[x[:, t]]
                g = z[:, : 3 * h2]
                g *= 0.25
                g += 0.5
                np.clip(g, 0, 1, out=g)
                c = g[:, h2 : 2 * h2] * c + g[:, :h2] * _squash(z[:, 3 * h2 :])
                h = g[:, 2 * h2 :] * _squash(c)
                if d == 1:
                    keep = mask[:, t, None]
                    h *= keep
                    c *= keep
                out[t] += h @ w
        out += self.p["c"]
        return out.transpose(1, 0, 2)

    def scores(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(t, tags, n): ``emissions`` of windows of symbols, for windows in the order of their lengths.

        Windows lie along the last axis, so that each operation runs over contiguous rows; the scale of the gates is folded
        into the weights, and rows whose window has ended, or has not begun from behind, are left out of a step. One product
        gives the gates of a step and the scores of the step before, so that states never leave the cache. Bounds are whole
        arrays, as numpy has no vector instructions for minima and maxima with a single number.
        """
        n, steps = x.shape
        h2 = self.hidden
        weights = []
        for d in (0, 1):
            gates = np.concatenate([self.p[f"Wh{d}"], self.p[f"Wx{d}"], self.p[f"b{d}"][None]]).T
            joined = np.concatenate([gates, np.zeros((N_TAGS, gates.shape[1]), np.float32)])
            joined[: 3 * h2] *= 0.25
            joined[: 3 * h2, -1] += 0.5
            joined[4 * h2 :, :h2] = self.p["W"][d * h2 : (d + 1) * h2].T
            weights.append(joined)
        weights[0][4 * h2 :, -1] = self.p["c"]
        out = np.zeros((steps, N_TAGS, n), np.float32)
        room = np.empty(steps * self.p["E"].shape[1] * min(n, TOGETHER), np.float32)
        for a in range(0, n, TOGETHER):
            own = lengths[a : a + TOGETHER]
            self._score(x[a : a + TOGETHER, : own[-1]], own, weights, room, out[: own[-1], :, a : a + TOGETHER])
        return out

    def _score(self, x: np.ndarray, lengths: np.ndarray, weights: list[np.ndarray], room: np.ndarray, out: np.ndarray) -> None:
        n, steps = x.shape
        h2, size = self.hidden, self.p["E"].shape[1]
        begins = np.searchsorted(lengths, np.arange(steps), "right").tolist()
        inputs = room[: steps * size * n].reshape(steps, size, n)
        inputs[:] = self.p["E"][x.T].transpose(0, 2, 1)
        zeros, ones = np.zeros((3 * h2, n), np.float32), np.ones((3 * h2, n), np.float32)
        products, spare, unit = np.empty((4 * h2 + N_TAGS, n), np.float32), np.empty((h2, n), np.float32), np.array(1, np.float32)
        for d, joined in enumerate(weights):
            state, c = np.zeros((h2 + size + 1, n), np.float32), np.zeros((h2, n), np.float32)
            state[-1] = 1
            last, borders = None, None
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                s = begins[t]
                low = s if last is None else min(s, begins[last])  # with the windows that ended there
                if (s, low) != borders:
                    borders = s, low
                    before, z, tail = state[:, low:], products[:, low:], products[4 * h2 :, low:]
                    g, u, v, own = products[: 3 * h2, s:], products[3 * h2 : 4 * h2, s:], spare[:, s:], c[:, s:]
                    i, f, o = g[:h2], g[h2 : 2 * h2], g[2 * h2 :]
                    h, own_input, zero, one = state[:h2, s:], state[h2:-1, s:], zeros[:, s:], ones[:, s:]
                own_input[:] = inputs[t, :, s:]
                np.matmul(joined, before, out=z)
                if last is not None:
                    out[last, :, low:] += tail
                np.maximum(g, zero, out=g)
                np.minimum(g, one, out=g)
                np.abs(u, out=v)
                np.add(v, unit, out=v)
                np.divide(u, v, out=u)
                np.multiply(u, i, out=u)
                np.multiply(own, f, out=own)
                np.add(own, u, out=own)
                np.abs(own, out=v)
                np.add(v, unit, out=v)
                np.divide(own, v, out=v)
                np.multiply(v, o, out=h)
                last = t
            out[last, :, s:] += joined[4 * h2 :] @ state[:, s:]

    def may_hold(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Which windows of (t, tags, n) scores may have a tag on their best path; of the others it is proven that they have none.

        For each character and kind, a bound on what a path that ends there in the kind gains over the one without tags: it enters
        by a beginning, with the best transition into it, or goes on from the character before. While no bound is over 0, no
        path comes back to tag 0 with a gain; where none ever is, the best path has no tags.
        """
        trans = self.p["T"] + allowed()
        into = (trans[:, 1:].max(0) - trans[0, 0]).astype(np.float32)[:, None]
        first = (self.p["F"] - self.p["F"][0])[1::2, None]
        best = e[0, 1::2] - e[0, 0] + first
        most = np.empty((len(e), e.shape[2]), np.float32)
        best.max(0, out=most[0])
        for t in range(1, len(e)):
            gain = e[t, 1:] - e[t, 0]
            gain += into
            best += gain[1::2]
            gain[::2] += np.maximum(most[t - 1], 0)
            np.maximum(best, gain[::2], out=best)
            best.max(0, out=most[t])
        back = max(0.0, float(trans[1:, 0].max() - trans[0, 0])) + 1e-3
        return ((most > -back) & (np.arange(len(e))[:, None] < lengths)).any(0)

    def viterbi(self, e: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tags, margin): the best path of each window, and at each character its score over the best other tag."""
        n, steps, _ = e.shape
        trans = self.p["T"] + allowed()
        first = self.p["F"].copy()
        first[2::2] = -1e4
        along = np.ascontiguousarray(e.transpose(1, 2, 0))
        score = np.empty((steps, N_TAGS, n), np.float32)
        score[0] = first[:, None] + along[0]
        for t in range(1, steps):
            new = (score[t - 1][:, None, :] + trans[:, :, None]).max(0) + along[t]
            score[t] = np.where(t < lengths, new, score[t - 1])
        tags = np.zeros((n, steps), np.int8)
        at = score[-1].argmax(0)
        for t in range(steps - 1, -1, -1):
            tags[:, t] = np.where(t < lengths, at, 0)
            if t:
                at = np.where(t < lengths, (score[t - 1].T + trans.T[at]).argmax(1), at)
        own = np.take_along_axis(e, tags[:, :, None].astype(np.int64), 2)[:, :, 0]
        return tags, own - e[:, :, 0]


def path_log_odds(model: Tagger, e: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log-probability of the tag path ``y`` of each window."""
    n, steps, _ = e.shape
    trans, first = model.p["T"] + allowed(), model.p["F"].copy()
    first[2::2] = -1e4
    alpha, rows = first + e[:, 0], np.arange(n)
    score = (first[y[:, 0]] + e[rows, 0, y[:, 0]]).astype(np.float64)
    for t in range(1, steps):
        live = t < lengths
        alpha = np.where(live[:, None], _lse(alpha[:, :, None] + trans, 1) + e[:, t], alpha)
        score += live * (trans[y[:, t - 1], y[:, t]] + e[rows, t, y[:, t]])
    return score - _lse(alpha, 1)


_DATA: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def _share(p: dict[str, np.ndarray], rows: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradient of some rows of the shared data."""
    x, y, lengths = _DATA[-1]
    steps = int(lengths[rows].max())
    return _gradient(Tagger(p), x[rows, :steps], y[rows, :steps], lengths[rows], allowed())


def train(model: Tagger, x: np.ndarray, y: np.ndarray, lengths: np.ndarray, epochs: int, rate: float = 8e-3, batch: int = 256, seed: int = 1, workers: int = 1, report=print) -> None:
    """Maximises the conditional likelihood of the tag paths by Adam; gradients by hand, in ``workers`` processes."""
    _DATA[:] = [(x, y, lengths)]
    with multiprocessing.get_context("fork").Pool(workers) as pool:
        _descend(model, pool, workers, len(x), lengths, epochs, rate, batch, seed, report)
    _DATA.clear()


def _descend(model: Tagger, pool, workers: int, size: int, lengths: np.ndarray, epochs: int, rate: float, batch: int, seed: int, report) -> None:
    rng = np.random.default_rng(seed)
    p = model.p
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(size)
        order = order[np.argsort(lengths[order] // 16, kind="stable")]
        blocks = [order[i : i + batch] for i in range(0, len(order), batch)]
        rng.shuffle(blocks)
        total = 0.0
        for rows in blocks:
            parts = [r for r in np.array_split(rows, workers) if len(r)]
            found = pool.starmap(_share, [(p, r) for r in parts])
            weights = [len(r) / len(rows) for r in parts]
            loss = sum(w * own for w, (own, _) in zip(weights, found))
            grad = {k: sum(w * g[k] for w, (_, g) in zip(weights, found)) for k in p}
            total += loss * len(rows)
            step += 1
            norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            lr = rate * min(1.0, step / 30) * (0.5 * (1 + np.cos(np.pi * step / (epochs * len(blocks)))) + 0.02)
            for k, g in grad.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.002 * (g * g - v)
                p[k] -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.998**step)) + 1e-8)).astype(np.float32)
        report(f"epoch {epoch}: loss {total / size:.4f}", flush=True)


def _gradient(model: Tagger, x: np.ndarray, y: np.ndarray, lengths: np.ndarray, ban: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    p, h2 = model.p, model.hidden
    n, steps = x.shape
    mask = (np.arange(steps) < lengths[:, None]).astype(np.float32)
    kept, e = [], np.zeros((n, steps, N_TAGS), np.float32) + p["c"]
    for d in (0, 1):
        table = p["E"] @ p[f"Wx{d}"] + p[f"b{d}"]
        h, c = np.zeros((n, h2), np.float32), np.zeros((n, h2), np.float32)
        trace = {}
        hs = np.zeros((n, steps, h2), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            z = h @ p[f"Wh{d}"] + table[x[:, t]]
            i, f, o = _gate(z[:, :h2]), _gate(z[:, h2 : 2 * h2]), _gate(z[:, 2 * h2 : 3 * h2])
            g = _squash(z[:, 3 * h2 :])
            keep = mask[:, t, None]
            new_c = (f * c + i * g) * keep
            s = _squash(new_c)
            trace[t] = (z, i, f, o, g, c, new_c, s, h)
            c, h = new_c, o * s * keep
            hs[:, t] = h
        e += hs @ p["W"][d * h2 : (d + 1) * h2]
        kept.append((trace, hs))
    # CRF by forward and backward sums of probabilities, scaled to 1 at each step
    trans, first = p["T"] + ban, p["F"].copy()
    first[2::2] = -1e4
    moves = np.exp(trans).astype(np.float32)
    top = e.max(2, keepdims=True)
    scores = np.exp(e - top)
    alpha, beta, scale = np.empty((steps, n, N_TAGS), np.float32), np.ones((steps, n, N_TAGS), np.float32), np.ones((steps, n, 1), np.float32)
    ahead = np.exp(first) * scores[:, 0]
    for t in range(steps):
        if t:
            live = mask[:, t, None] > 0
            ahead = np.where(live, (alpha[t - 1] @ moves) * scores[:, t], alpha[t - 1])
        scale[t] = ahead.sum(1, keepdims=True)
        alpha[t] = ahead / scale[t]
    log_z = np.log(scale[:, :, 0].astype(np.float64)).sum(0) + (top[:, :, 0] * mask).sum(1)
    later = np.zeros((steps, n, N_TAGS), np.float32)
    for t in range(steps - 2, -1, -1):
        live = mask[:, t + 1, None] > 0
        later[t + 1] = np.where(live, scores[:, t + 1] * beta[t + 1] / scale[t + 1], 0)
        beta[t] = np.where(live, later[t + 1] @ moves.T, beta[t + 1])
    post = (alpha * beta).transpose(1, 0, 2) * mask[:, :, None]
    gold = np.eye(N_TAGS, dtype=np.float32)[y] * mask[:, :, None]
    de = ((post - gold) / n).astype(np.float32)
    d_t = (alpha[:-1].reshape(-1, N_TAGS).T @ later[1:].reshape(-1, N_TAGS)).astype(np.float64) * moves
    score = (first[y[:, 0]] + e[np.arange(n), 0, y[:, 0]]).astype(np.float64)
    own = trans[y[:, :-1], y[:, 1:]] + np.take_along_axis(e[:, 1:], y[:, 1:, None], 2)[:, :, 0]
    score += (own * mask[:, 1:]).sum(1)
    np.add.at(d_t, (y[:, :-1].ravel(), y[:, 1:].ravel()), -mask[:, 1:].ravel())
    grad = {"T": np.where(ban < 0, 0, d_t / n).astype(np.float32), "F": de[:, 0].sum(0), "c": de.sum((0, 1)), "W": np.zeros_like(p["W"]), "E": np.zeros_like(p["E"])}
    for d in (0, 1):
        trace, hs = kept[d]
        w = p["W"][d * h2 : (d + 1) * h2]
        grad["W"][d * h2 : (d + 1) * h2] = np.tensordot(hs, de, ([0, 1], [0, 1]))
        dh_out = de @ w.T
        dh, dc = np.zeros((n, h2), np.float32), np.zeros((n, h2), np.float32)
        d_wh, d_table = np.zeros_like(p[f"Wh{d}"]), np.zeros((len(p["E"]), 4 * h2), np.float32)
        dzs = np.zeros((n, steps, 4 * h2), np.float32)
        for t in range(steps - 1, -1, -1) if d == 0 else range(steps):
            z, i, f, o, g, c, new_c, s, h = trace[t]
            keep = mask[:, t, None]
            dh = (dh + dh_out[:, t]) * keep
            dc = (dc + dh * o / (1 + np.abs(new_c)) ** 2) * keep
            dz = dzs[:, t]
            inside = (np.abs(z[:, : 3 * h2]) < 2) * np.float32(0.25)
            dz[:, :h2] = dc * g
            dz[:, h2 : 2 * h2] = dc * c
            dz[:, 2 * h2 : 3 * h2] = dh * s
            dz[:, : 3 * h2] *= inside
            dz[:, 3 * h2 :] = dc * i / (1 + np.abs(z[:, 3 * h2 :])) ** 2
            d_wh += h.T @ dz
            dh, dc = dz @ p[f"Wh{d}"].T, dc * f
        flat, order = dzs.reshape(-1, 4 * h2), np.argsort(x.ravel(), kind="stable")
        ids = x.ravel()[order]
        cuts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        d_table[ids[cuts]] = np.add.reduceat(flat[order], cuts, axis=0)
        grad[f"Wh{d}"], grad[f"b{d}"], grad[f"Wx{d}"] = d_wh, d_table.sum(0), p["E"].T @ d_table
        grad["E"] += d_table @ p[f"Wx{d}"].T
    return float((log_z - score).mean()), grad


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)
