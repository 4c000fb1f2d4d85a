"""A gated recurrent language model in numpy, with a class-factored output softmax."""

from __future__ import annotations

import heapq
from bisect import bisect_left

import numpy as np

F32 = np.float32
#: Units of the state, dimensions of an embedding, words of a class, lanes in which documents follow each other, and tokens
#: of a training window.
UNITS, DIM, CLASS, LANES, WINDOW = 64, 32, 96, 256, 24
LEARNING_RATE, SEED = 0.1, 11


#: Parameters that one step changes at a time, and rows of a block of outputs at least: few enough to stay in the cache.
#: Multiplications of a product that the library does without copying its factors; rows from which a token counts as frequent.
BLOCK, ROWS, SMALL, OFTEN = 1 << 14, 1024, 960_000, 12


def _step(value: np.ndarray, grad: np.ndarray, memory: np.ndarray, rate: float) -> None:
    """value -= rate * grad / sqrt(memory + grad ** 2) in place, memory too; grad is used up."""
    value, grad, memory, room = value.reshape(-1), grad.reshape(-1), memory.reshape(-1), np.empty(min(BLOCK, value.size), F32)
    for k in range(0, len(value), BLOCK):
        g, m = grad[k : k + BLOCK], memory[k : k + BLOCK]
        root = np.multiply(g, g, out=room[: len(g)])
        m += root
        np.sqrt(m, out=root)
        g *= F32(rate)
        g /= root
        value[k : k + BLOCK] -= g


def _softmax(logits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of place at in each row, and the rows' sums of exponentials, which take the place of logits.

    The rows' maxima are only taken off where a sum could leave the range of floats."""
    own = logits[np.arange(len(at)), at]
    if logits.max(initial=0) > 60 or own.min(initial=0) < -60:
        most = logits.max(1)
        logits -= most[:, None]
        own -= most
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], F32)
    return own - np.log(total), total


def _error(probability: np.ndarray, total: np.ndarray, at: np.ndarray, weight: np.ndarray) -> None:
    """The loss's gradient by the logits, in place of what _softmax left."""
    probability *= (weight / total)[:, None]
    probability[np.arange(len(at)), at] -= weight


def _product(a: np.ndarray, b: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """a.T @ b, in pieces of rows which the library multiplies without copying them."""
    step = SMALL // (a.shape[1] * b.shape[1]) or 1
    whole = len(a) // step
    if whole < 2:
        return np.matmul(a.T, b, out=out)
    cut = lambda x: np.lib.stride_tricks.as_strided(x, (whole, step, x.shape[1]), (step * x.strides[0], *x.strides))
    out = np.matmul(cut(a).transpose(0, 2, 1), cut(b)).sum(0, out=out)
    if whole * step < len(a):
        out += a[whole * step :].T @ b[whole * step :]
    return out


class Model:
    """Tokens 0 to words - 1 are words, in classes of CLASS; tokens words to words + tails - 1 are classes of all other words.

    z, r = sigmoid(x + h U), n = tanh(x + (r h) U), h' = h + z (n - h), where x is the token's embedding through a
    projection; the state before a token gives its class's logits, and the class its word's.
    """

    def __init__(self, words: int, tails: int = 1, units: int = UNITS, dim: int = DIM, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.words, self.tails, self.units, self.classes = words, tails, units, -(-words // CLASS)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(F32)
        self.p = {
            "e": small(words + tails, dim) * F32(5), "x": small(dim, 3 * units) * F32(2), "bx": np.zeros(3 * units, F32), "u": small(units, 2 * units), "un": small(units, units),
            "wc": small(units, self.classes + tails), "bc": np.zeros(self.classes + tails, F32), "ww": small(self.classes, units, CLASS), "bw": np.zeros((self.classes, CLASS), F32),
        }
        self._rooms: dict = {}
        last = words - (self.classes - 1) * CLASS
        if words:
            self.p["bw"][-1, last:] = -60  # places of the last class without a word

    def begin_with(self, counts: np.ndarray, others: np.ndarray) -> None:
        """Biases that give the relative frequencies of words, and of the classes of all others."""
        padded = np.full(self.classes * CLASS, 0.0)
        padded[: self.words] = counts
        by = padded.reshape(self.classes, CLASS)
        total = max(1.0, by.sum() + others.sum())
        self.p["bc"][:] = np.log(np.append(by.sum(1), others) / total + 1e-9)
        self.p["bw"][:] = np.where(by > 0, np.log(np.maximum(by, 1e-9) / np.maximum(by.sum(1, keepdims=True), 1e-9)), -60)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(F32)
            at += v.size

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array of any content whose memory is that of the last one of this name: new pages would cost more than
        what is computed in them."""
        size = int(np.prod(shape))
        if name not in self._rooms or len(self._rooms[name]) < size:
            self._rooms[name] = np.empty(size, F32)
        return self._rooms[name][:size].reshape(shape)

    def inputs(self, rows: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """What tokens give to the gates (z and half of it each, then r) and to the candidate, a row for each token."""
        d = self.units
        x = (self.p["e"][rows] @ self.p["x"] + self.p["bx"]).astype(F32, copy=False)
        return np.concatenate([x[:, :d], x[:, d : 2 * d]]) * F32(0.5), np.ascontiguousarray(x[:, 2 * d :])

    def run(self, tokens: np.ndarray, follows: np.ndarray, h: np.ndarray, keep: bool = False, inputs: tuple[np.ndarray, np.ndarray] | None = None):
        """States before each of tokens (time, lane), from state h; follows is 0 where a document begins. tokens are
        places in inputs, if given.

        Returns (states, last state, and what the gradient needs, if keep); all but the last state are good until the next run."""
        t, b, d = *tokens.shape, self.units
        if inputs is None:
            rows, tokens = _distinct(tokens, self.words + self.tails)
            inputs = self.inputs(rows)
        table, third = inputs
        both = np.stack([tokens, tokens + len(third)], axis=1)
        u, un = self.p["u"], self.p["un"].astype(F32, copy=False)
        halves = (np.stack([u[:, :d], u[:, d:]]) * F32(0.5)).astype(F32, copy=False)
        before, zr, cand = self._room("before", t + 1, b, d), self._room("zr", t if keep else 1, 2, b, d), self._room("cand", t if keep else 1, b, d)
        two, one = self._room("two", 2, b, d), self._room("one", b, d)
        begin, lane = np.nonzero(follows == 0)
        begin = np.searchsorted(begin, np.arange(t + 1))
        before[0] = h
        for k in range(t):
            h, after, g, n = before[k], before[k + 1], zr[k if keep else 0], cand[k if keep else 0]
            if begin[k] < begin[k + 1]:
                h[lane[begin[k] : begin[k + 1]]] = 0
            np.matmul(h, halves, out=g)
            g += np.take(table, both[k], axis=0, out=two, mode="clip")
            np.tanh(g, out=g)  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
            g *= F32(0.5)
            g += F32(0.5)
            np.multiply(g[1], h, out=one)
            np.matmul(one, un, out=n)
            n += np.take(third, tokens[k], axis=0, out=one, mode="clip")
            np.tanh(n, out=n)
            np.subtract(n, h, out=after)
            after *= g[0]
            after += h
        return before[:t], before[t].copy(), zr, cand

    def outputs(self, states: np.ndarray, tokens: np.ndarray, weight: np.ndarray | None = None, grad: dict | None = None):
        """Natural log probability of each token from the state before it; with weight and grad also the gradients'
        sums, added to grad, and that of the states. Rows are dealt with in the order of their classes, in blocks that
        stay in the cache."""
        flat, p, d = states.reshape(-1, self.units), self.p, self.units
        token, n, wide = tokens.ravel(), tokens.size, self.classes + self.tails
        cls = np.where(token < self.words, token // CLASS, self.classes + token - self.words).astype(np.int16)
        order = np.argsort(cls, kind="stable")
        cls = cls[order]
        cuts = np.searchsorted(cls, np.arange(wide + 1)).tolist()
        m = cuts[self.classes]
        place = token[order[:m]] - cls[:m].astype(np.int64) * CLASS
        h = np.take(flat, order, axis=0, out=self._room("h", n, d), mode="clip")
        logp, ones = np.empty(n, F32), np.ones(n, F32)
        if grad is not None:
            weight = weight[order].astype(F32, copy=False)
            back = self._room("back", n, d)
            grad["wc"], grad["bc"], grad["ww"], grad["bw"] = np.zeros(p["wc"].shape, F32), np.zeros(p["bc"].shape, F32), self._room("ww", *p["ww"].shape), np.zeros(p["bw"].shape, F32)
            for c in range(self.classes):
                if cuts[c] == cuts[c + 1]:
                    grad["ww"][c] = 0
        begin = 0
        while begin < n:
            first = int(cls[begin])
            last = min(bisect_left(cuts, begin + ROWS), wide) if first >= self.classes else min(max(bisect_left(cuts, begin + ROWS, hi=self.classes), first + 1), self.classes)
            rows = slice(begin, cuts[last])
            begin = cuts[last]
            hb = h[rows]
            top = self._room("top", len(hb), wide)
            np.matmul(hb, p["wc"], out=top)
            top += p["bc"]
            logp[rows], total = _softmax(top, cls[rows])
            if grad is not None:
                _error(top, total, cls[rows], weight[rows])
                np.matmul(top, p["wc"].T, out=back[rows])
                grad["wc"] += _product(hb, top)
                grad["bc"] += ones[rows] @ top
            if first >= self.classes:
                continue
            inner = self._room("inner", len(hb), CLASS)
            spans = [(c, slice(e - rows.start, f - rows.start)) for c, e, f in zip(range(first, last), cuts[first:], cuts[first + 1 :]) if e < f]
            for c, at in spans:
                part = inner[at]
                np.matmul(hb[at], p["ww"][c], out=part)
                part += p["bw"][c]
            own, total = _softmax(inner, place[rows])
            logp[rows] += own
            if grad is not None:
                _error(inner, total, place[rows], weight[rows])
                within = self._room("within", len(hb), d)
                for c, at in spans:
                    part = inner[at]
                    _product(hb[at], part, grad["ww"][c])
                    np.matmul(ones[at], part, out=grad["bw"][c])
                    np.matmul(part, p["ww"][c].T, out=within[at])
                back[rows] += within
        out = np.empty(n, F32)
        out[order] = logp
        if grad is None:
            return out, None
        by_time = self._room("by_time", n, d)
        by_time[order] = back
        return out, by_time

    def gradient(self, tokens: np.ndarray, follows: np.ndarray, weight: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Gradients of the window's mean loss, truncated at its begin; the last state; the summed loss."""
        t, b, d = *tokens.shape, self.units
        rows, place = _distinct(tokens, self.words + self.tails)
        before, last, zr, cand = self.run(place, follows, h, keep=True, inputs=self.inputs(rows))
        grad: dict = {}
        count = max(1.0, float(weight.sum()))
        logp, back = self.outputs(before, tokens, (weight / F32(count)).ravel(), grad)
        back = back.reshape(t, b, d)
        da, rh = self._room("da", 3, t, b, d), self._room("rh", t, b, d)
        dh, one, two = np.zeros((b, d), F32), np.empty((b, d), F32), np.empty((b, d), F32)
        uz, ur, un = (np.ascontiguousarray(x.T, F32) for x in (self.p["u"][:, :d], self.p["u"][:, d:], self.p["un"]))
        begin, lane = np.nonzero(follows == 0)
        begin = np.searchsorted(begin, np.arange(t + 1))
        for k in range(t - 1, -1, -1):
            hk, n, z, r, az, ar, an, rhk = before[k], cand[k], zr[k, 0], zr[k, 1], *da[:, k], rh[k]
            np.multiply(dh, z, out=one)  # what comes to the candidate
            dh -= one
            np.subtract(n, hk, out=az)
            az *= dh
            az *= z
            np.multiply(n, n, out=an)
            np.subtract(F32(1), an, out=an)
            an *= one
            np.matmul(an, un, out=one)  # what comes to r h
            np.multiply(r, hk, out=rhk)
            np.subtract(F32(1), r, out=ar)
            ar *= rhk
            ar *= one
            one *= r
            dh += one
            dh += np.matmul(az, uz, out=one)
            dh += np.matmul(ar, ur, out=two)
            dh += back[k]
            if begin[k] < begin[k + 1]:
                dh[lane[begin[k] : begin[k + 1]]] = 0
        hb, da = before.reshape(-1, d), da.reshape(3, -1, d)
        grad["u"] = np.concatenate([_product(hb, da[0]), _product(hb, da[1])], axis=1)
        grad["un"] = _product(rh.reshape(-1, d), da[2])
        # sums for each distinct token first: the projection's gradients need no more than these
        sums = self._sums(da, place.ravel(), len(rows))
        grad["x"], grad["bx"] = _product(self.p["e"][rows], sums), np.ones(len(rows), F32) @ sums
        grad["e"] = (rows, sums @ self.p["x"].T)
        return grad, last, -float((logp * weight.ravel()).sum())

    def _sums(self, parts: np.ndarray, place: np.ndarray, count: int) -> np.ndarray:
        """Sums of (part, row, unit) over the rows of each of count places: of those that come often by themselves, of all
        others together, their first rows, their second rows, and so on. The parts' sums stand side by side."""
        times = np.bincount(place, minlength=count)
        rank = np.argsort(-times, kind="stable")
        times = times[rank]
        at = np.empty(count, np.uint16 if count <= 1 << 16 else np.int64)
        at[rank] = np.arange(count)
        order = np.argsort(at[place], kind="stable")
        begin = np.concatenate([[0], np.cumsum(times)])
        often = int(np.searchsorted(-times, -OFTEN, side="right"))
        cuts, rest, fewer = begin[: often + 1].tolist(), begin[often:-1], -times[often:]
        rounds = [order[rest[: int(np.searchsorted(fewer, -k))] + k] for k in range(-int(fewer[0]) if len(fewer) else 0)]
        dealt = np.take(parts, np.concatenate([order[: cuts[-1]], *rounds]), axis=1, out=self._room("dealt", *parts.shape), mode="clip")
        sums, ones, done = np.zeros((len(parts), count, parts.shape[2]), F32), np.ones(len(place), F32), cuts[-1]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            np.matmul(ones[a:b], dealt[:, a:b], out=sums[:, i])
        for those in rounds:
            sums[:, often : often + len(those)] += dealt[:, done : done + len(those)]
            done += len(those)
        result = np.empty((count, len(parts), parts.shape[2]), F32)
        result[rank] = sums.transpose(1, 0, 2)
        return result.reshape(count, -1)

    def learn(self, tokens: np.ndarray, follows: np.ndarray, weight: np.ndarray, memory: dict | None = None, rate: float = LEARNING_RATE) -> dict:
        """One pass of truncated backpropagation through lanes (time, lane), window by window; the state goes on from
        window to window. memory: squared gradients so far, for the step sizes."""
        memory = memory or {k: np.full_like(v, 1e-8) for k, v in self.p.items()}
        h = np.zeros((tokens.shape[1], self.units), F32)
        for k in range(0, len(tokens), WINDOW):
            grad, h, _ = self.gradient(tokens[k : k + WINDOW], follows[k : k + WINDOW], weight[k : k + WINDOW], h)
            rows, g = grad.pop("e")
            squares = memory["e"][rows] + g * g
            memory["e"][rows] = squares
            self.p["e"][rows] -= F32(rate) * g / np.sqrt(squares)
            for name, g in grad.items():
                _step(self.p[name], g, memory[name], rate)
        return memory

    def score(self, tokens: np.ndarray, follows: np.ndarray, window: int = 64) -> np.ndarray:
        """Natural log probabilities of all tokens (time, lane); the state is carried over windows."""
        out = np.empty(tokens.shape, F32)
        h, inputs = np.zeros((tokens.shape[1], self.units), F32), self.inputs(slice(None))
        for k in range(0, len(tokens), window):
            part = tokens[k : k + window]
            before, h, _, _ = self.run(part, follows[k : k + window], h, inputs=inputs)
            out[k : k + window] = self.outputs(before, part)[0].reshape(part.shape)
        return out


def _distinct(tokens: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens, under most, that are there, and for each its place among these."""
    there = np.zeros(most, bool)
    there[tokens] = True
    rows = np.flatnonzero(there)
    places = np.empty(most, np.int64)
    places[rows] = np.arange(len(rows))
    return rows, places[tokens]


def lanes(lengths: np.ndarray, most: int = LANES) -> tuple[np.ndarray, np.ndarray, int]:
    """(lane, begin) of each document, and the longest lane: documents follow each other in lanes of near equal length,
    as many as the longest document lets be full."""
    total, longest = int(lengths.sum()), int(lengths.max(initial=1))
    count = max(1, min(most, len(lengths), -(-total // longest)))
    lane, begin = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    heap = [(0, k) for k in range(count)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, k = heap[0]
        lane[i], begin[i] = k, size
        heapq.heapreplace(heap, (size + int(lengths[i]), k))
    return lane, begin, max(size for size, _ in heap)


def laid_out(tokens: np.ndarray, bounds: np.ndarray, other: int, most: int = LANES):
    """tokens (time, lane), follows, weight, and the place of each token in the flattened (lane, time) order."""
    lengths = np.diff(bounds)
    lane, begin, time = lanes(lengths, most)
    count = int(lane.max(initial=0)) + 1
    place = np.repeat(lane * time + begin - bounds[:-1], lengths) + np.arange(len(tokens))
    grid, follows, weight = np.full(count * time, other, np.int64), np.ones(count * time, F32), np.zeros(count * time, F32)
    grid[place], weight[place] = tokens, 1
    follows[(lane * time + begin)[lengths > 0]] = 0
    return *(np.ascontiguousarray(x.reshape(count, time).T) for x in (grid, follows, weight)), place
