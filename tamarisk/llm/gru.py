"""A small gated recurrent language model in numpy.

Documents lie end to end in lanes; a lane's state is carried from window to window
and set to zero where a document starts, so a document's likelihood is exact over
its whole length while memory holds one window.  The output is factored: the class of
the next token, then the token within its class.  Training is back-propagation cut
at the window's start, with Adagrad steps.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

_F = np.float32


@dataclass(frozen=True)
class Shape:
    """Sizes of the model; tokens are ordered so that a class is a range of them."""

    bounds: tuple[int, ...]  # first token of each class, and the number of tokens
    hidden: int

    @property
    def tokens(self) -> int:
        return self.bounds[-1]

    @property
    def classes(self) -> int:
        return len(self.bounds) - 1

    def parts(self) -> dict[str, tuple[int, ...]]:
        h = self.hidden
        return {
            "emb": (self.tokens, h), "wx": (h, 3 * h), "wh": (h, 3 * h), "b": (3 * h,),
            "cw": (h, self.classes), "cb": (self.classes,), "ow": (self.tokens, h), "ob": (self.tokens,),
        }

    def unpack(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, dims in self.parts().items():
            n = int(np.prod(dims))
            out[name] = flat[at : at + n].reshape(dims)
            at += n
        return out

    @property
    def size(self) -> int:
        return sum(int(np.prod(d)) for d in self.parts().values())


def shape_for(frequency: np.ndarray, classes: int, hidden: int) -> Shape:
    """Classes of about equal mass in the root of the frequency; frequencies fall."""
    mass = np.cumsum(np.sqrt(frequency))
    cut = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes, side="left")
    return Shape((0, *sorted({int(c) for c in cut if 0 < c < len(frequency)}), len(frequency)), hidden)


def initial(shape: Shape, frequency: np.ndarray, seed: int) -> np.ndarray:
    """Random weights, biases at the log of the frequencies: the unigram model."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(shape.size, dtype=_F)
    p = shape.unpack(flat)
    for name in ("emb", "wx", "wh", "cw", "ow"):
        p[name][...] = rng.normal(0, {"emb": 0.3, "cw": 0.02, "ow": 0.02}.get(name, 0.25), p[name].shape)
    share = frequency / frequency.sum()
    p["ob"][...] = np.log(share)
    p["cb"][...] = np.log(np.add.reduceat(share, shape.bounds[:-1]))
    return flat


def lanes(docs: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Token and document matrices, steps by lanes, longest lane first; -1 where a lane is over.

    There are as many lanes as the longest document lets be filled, ``width`` at most.
    """
    longest = max((len(d) for d in docs), default=1)
    width = max(1, min(width, len(docs), sum(len(d) for d in docs) // max(longest, 1)))
    heap = [(0, i) for i in range(width)]
    held: list[list[int]] = [[] for _ in range(width)]
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        n, i = heapq.heappop(heap)
        held[i].append(d)
        heapq.heappush(heap, (n + len(docs[d]), i))
    length = {i: n for n, i in heap}
    order = sorted(range(width), key=lambda i: -length[i])
    steps = max(length.values())
    token = np.full((steps, width), -1, dtype=np.int32)
    owner = np.full((steps, width), -1, dtype=np.int32)
    for col, i in enumerate(order):
        at = 0
        for d in held[i]:
            token[at : at + len(docs[d]), col] = docs[d]
            owner[at : at + len(docs[d]), col] = d
            at += len(docs[d])
    return token, owner


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _forward(p, x, start, h, hid, keep):
    """States after each step; with ``keep`` also what back-propagation needs."""
    steps, width = start.shape
    out = np.empty((steps, width, hid), dtype=_F)
    saved = []
    for t in range(steps):
        h = h * start[t][:, None]
        u = h @ p["wh"]
        zr = _sigmoid(x[t, :, : 2 * hid] + u[:, : 2 * hid])
        z, r = zr[:, :hid], zr[:, hid:]
        un = u[:, 2 * hid :]
        n = np.tanh(x[t, :, 2 * hid :] + r * un)
        if keep:
            saved.append((h, z, r, un, n))
        h = n + z * (h - n)
        out[t] = h
    return out, h, saved


def _log_softmax(a):
    a = a - a.max(axis=1, keepdims=True)
    return a - np.log(np.exp(a).sum(axis=1, keepdims=True))


class Model:
    def __init__(self, shape: Shape, flat: np.ndarray):
        self.shape, self.flat = shape, flat
        self.p = shape.unpack(flat)
        bounds = np.array(shape.bounds)
        self.class_of = np.repeat(np.arange(shape.classes), np.diff(bounds))

    def _output(self, h, target, grad=None):
        """Log-probability of each target; with ``grad`` adds gradients and returns that of h."""
        p, bounds = self.p, self.shape.bounds
        cls = self.class_of[target]
        row = np.arange(len(h))
        logc = _log_softmax(h @ p["cw"] + p["cb"])
        got = logc[row, cls]
        back = None
        if grad is not None:
            d = np.exp(logc)
            d[row, cls] -= 1
            grad["cw"] += h.T @ d
            grad["cb"] += d.sum(axis=0)
            back = d @ p["cw"].T
        order = np.argsort(cls.astype(np.int16), kind="stable")
        edge = np.searchsorted(cls[order], np.arange(self.shape.classes + 1))
        for c in range(self.shape.classes):
            a, b = bounds[c], bounds[c + 1]
            which = order[edge[c] : edge[c + 1]]
            if not len(which) or b - a == 1:
                continue
            hs = h[which]
            logw = _log_softmax(hs @ p["ow"][a:b].T + p["ob"][a:b])
            own = target[which] - a
            got[which] += logw[np.arange(len(which)), own]
            if grad is not None:
                d = np.exp(logw)
                d[np.arange(len(which)), own] -= 1
                grad["ow"][a:b] += d.T @ hs
                grad["ob"][a:b] += d.sum(axis=0)
                back[which] += d @ p["ow"][a:b]
        return got, back

    def _windows(self, docs, width, window, keep):
        """Per window: (token, owner, live, input, start, states, saved); states carry over."""
        hid, p = self.shape.hidden, self.p
        token, owner = lanes(docs, width)
        h = np.zeros((token.shape[1], hid), dtype=_F)
        before = np.full(token.shape[1], -1, dtype=np.int32)
        before_owner = np.full(token.shape[1], -1, dtype=np.int32)
        for at in range(0, len(token), window):
            tok, own = token[at : at + window], owner[at : at + window]
            wide = int((tok[0] >= 0).sum())
            tok, own = tok[:, :wide], own[:, :wide]
            prev = np.vstack([before[:wide], tok[:-1]])
            start = own == np.vstack([before_owner[:wide], own[:-1]])
            # a document starts from the zero state with a zero input
            fed = np.where(start & (prev >= 0), prev, 0)
            begun = start.astype(_F)
            x = (p["emb"][fed] * begun[..., None]).reshape(-1, hid) @ p["wx"] + p["b"]
            x = x.reshape(*tok.shape, 3 * hid)
            states, h, saved = _forward(p, x, begun, h[:wide], hid, keep)
            before, before_owner = tok[-1], own[-1]
            yield tok, own, fed, begun, states, saved

    def score(self, docs: list[np.ndarray], width: int = 512, window: int = 64) -> np.ndarray:
        """Natural-log probability of each document, given as token arrays."""
        total = np.zeros(len(docs))
        for tok, own, _, _, states, _ in self._windows(docs, width, window, keep=False):
            live = tok >= 0
            got, _ = self._output(states[live], tok[live])
            total += np.bincount(own[live], weights=got, minlength=len(docs))
        return total

    def train(self, docs: list[np.ndarray], rate: float, past: dict | None = None,
              width: int = 512, window: int = 16, piece: int = 1024) -> dict:
        """One pass of truncated back-propagation; returns Adagrad's sums for the next call.

        Documents longer than ``piece`` are learned in pieces, which keeps all lanes busy.
        """
        hid, p = self.shape.hidden, self.p
        docs = [d[at : at + piece] for d in docs for at in range(0, len(d), piece)]
        past = past if past is not None else {k: np.full(v.shape, 1e-2, dtype=_F) for k, v in p.items()}
        n = 0
        for tok, _, fed, begun, states, saved in self._windows(docs, width, window, keep=True):
            live = tok >= 0
            n = n or tok.size  # windows with fewer lanes make shorter steps
            grad = {k: np.zeros(v.shape, dtype=_F) for k, v in p.items() if k != "emb"}
            _, back = self._output(states[live], tok[live], grad)
            dstate = np.zeros(states.shape, dtype=_F)
            dstate[live] = back
            dx = np.empty((*tok.shape, 3 * hid), dtype=_F)
            du = np.empty_like(dx)
            dh = np.zeros(states.shape[1:], dtype=_F)
            for t in range(len(tok) - 1, -1, -1):
                h, z, r, un, new = saved[t]
                dh = dh + dstate[t]
                dn = dh * (1 - z) * (1 - new * new)
                dx[t, :, 2 * hid :] = dn
                dx[t, :, hid : 2 * hid] = dn * un * r * (1 - r)
                dx[t, :, :hid] = dh * (h - new) * z * (1 - z)
                du[t, :, : 2 * hid] = dx[t, :, : 2 * hid]
                du[t, :, 2 * hid :] = dn * r
                dh = (dh * z + du[t] @ p["wh"].T) * begun[t][:, None]
            before = np.stack([s[0] for s in saved]).reshape(-1, hid)
            flat = dx.reshape(-1, 3 * hid)
            grad["wh"] += before.T @ du.reshape(-1, 3 * hid)
            grad["b"] += flat.sum(axis=0)
            inputs = (p["emb"][fed] * begun[..., None]).reshape(-1, hid)
            grad["wx"] += inputs.T @ flat
            demb = (flat @ p["wx"].T) * begun.reshape(-1, 1)
            ids = fed.reshape(-1)
            order = np.argsort(ids.astype(np.int16) if self.shape.tokens < 2**15 else ids, kind="stable")
            rows, at = np.unique(ids[order], return_index=True)
            sums = np.add.reduceat(demb[order], at, axis=0)
            for k, g in grad.items():
                g /= n
                past[k] += g * g
                p[k] -= rate * g / np.sqrt(past[k])
            sums /= n
            past["emb"][rows] += sums * sums
            p["emb"][rows] -= rate * sums / np.sqrt(past["emb"][rows])
        return past
