"""Sampled segmentations over a SentencePiece vocabulary, and lossless decoding.

A text is cut into units, before spaces and at line ends; every way to spell a unit with
pieces is a path of its lattice, with probability proportional to the product of the
pieces' weights.  Only the pieces that end at a place are held there.  Forward sums are computed
once for each distinct unit of a group of texts, byte by byte over all of them; then every occurrence is sampled from its end to its
start.  A unit of any length is one lattice: those longer than ``LONG`` bytes are worked
through on their own, in blocks that hand on the last forward sums, with 8 bytes of
memory a byte and tables for one block.  The random numbers are hashes of the row's key and
the place in its text, so a row gets the same pieces wherever and whenever it is encoded.

The vocabulary stores merge ranks, not probabilities; a piece of rank r weighs
1 / (r + ``rank_shift``).  Single bytes are always possible, with the weight ``byte_weight``.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.textbytes import chunks, mix, prefix_hash, span_hash

_U = np.uint64
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: bytes of a unit that is worked through on its own, of a group of shorter ones, of a block, of a leap
LONG, PART, BLOCK, STEP = 4096, 1 << 20, 1 << 14, 8


@dataclass(frozen=True)
class Pieces:
    """Pieces as bytes (a space for the word mark), with their weights; ids are the model's."""

    spelled: list[bytes]
    weight: np.ndarray
    ids: np.ndarray  # of the pieces that may be chosen

    @property
    def longest(self) -> int:
        return max(len(self.spelled[i]) for i in self.ids)


@dataclass(frozen=True)
class SamplingParams:
    rank_shift: float = 50.0
    byte_weight: float = 1e-7
    sharpness: float = 1.0  # above 1 the likeliest segmentation prevails
    longest: int | None = None  # bytes; longer pieces are not used
    seed: int = 17
    group_bytes: int = 2_000_000


def load_pieces(path: str = MODEL, params: SamplingParams = SamplingParams()) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled, weight, ids = [], [], []
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            spelled.append(bytes([int(model.id_to_piece(i)[1:-1], 16)]))
            weight.append(params.byte_weight)
            ids.append(i)
        elif model.is_control(i) or model.is_unknown(i):
            spelled.append(b"")
            weight.append(0.0)
        else:
            rank = -model.get_score(i)
            spelled.append(model.id_to_piece(i).replace("▁", " ").encode())
            weight.append((1 / ((rank if rank < 1e6 else 1000) + params.rank_shift)) ** params.sharpness)
            if params.longest is None or len(spelled[-1]) <= params.longest:
                ids.append(i)
    # a byte that is also an ordinary piece is spelled by the piece
    plain = {spelled[i] for i in ids if weight[i] > params.byte_weight}
    ids = [i for i in ids if weight[i] > params.byte_weight or spelled[i] not in plain]
    return Pieces(spelled, np.array(weight), np.array(ids))


class Lattice:
    """Where pieces end in a text: the pieces are read backwards in a trie of half bytes."""

    def __init__(self, pieces: Pieces):
        order = pieces.ids
        self.longest = pieces.longest
        flat = np.frombuffer(b"".join(pieces.spelled[i] for i in order), dtype=np.uint8)
        length = np.array([len(pieces.spelled[i]) for i in order])
        last = np.cumsum(length) - 1
        # node 0 is where no piece goes on, node 1 the root
        node, nodes = np.ones(len(order), dtype=np.int64), 2
        slots, kids, ended = [], [], []
        for d in range(self.longest):
            on = np.flatnonzero(length > d)
            byte = flat[last[on] - d]
            for half in (byte >> 4, byte & 15):
                slot, which = np.unique(node[on] * 16 + half, return_inverse=True)
                node[on] = nodes + which
                slots.append(slot)
                kids.append(np.arange(nodes, nodes + len(slot)))
                nodes += len(slot)
            ended.append(on[length[on] == d + 1])
        self.next = np.zeros(16 * nodes, dtype=np.int32)
        self.next[np.concatenate(slots)] = np.concatenate(kids)
        self.piece = np.full(nodes, -1, dtype=np.int32)
        ended = np.concatenate(ended)
        self.piece[node[ended]] = order[ended]
        self.weight = np.append(pieces.weight, 0.0)  # the last for "no piece"

    @staticmethod
    def units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of units, and the end of the data."""
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offsets] = True
        space, line = data == 0x20, data == 0x0A
        cut[1:-1] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        cut[-1] = True
        return np.flatnonzero(cut)

    def sample(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, and the first of each text (one more at the end)."""
        bounds = self.units(data, offsets)
        starts, ends = bounds[:-1], bounds[1:]
        if not len(starts) or not len(data):
            return np.empty(0, np.int32), np.zeros(len(offsets), dtype=np.int64)
        text_of = np.searchsorted(offsets, starts, side="right") - 1
        key = mix(keys[text_of] ^ mix((starts - offsets[text_of]).astype(np.uint64) + _U(seed)))
        # runs of short units of about PART bytes, and every long unit, one after the other
        long = ends - starts > LONG
        part = (np.cumsum(np.where(long, 0, ends - starts)) - 1) // PART
        edge = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | long[1:] | long[:-1]))
        ids, steps = [], []
        for a, b in zip(edge, np.append(edge[1:], len(starts)), strict=True):
            own = data[starts[a] : ends[b - 1]]
            if long[a]:
                ids.append(self._sample_long(own, key[a]))
                steps.append([len(ids[-1])])
            else:
                out, n = self._sample_short(own, starts[a:b] - starts[a], ends[a:b] - starts[a], key[a:b])
                ids.append(out)
                steps.append(n)
        base = np.cumsum(np.concatenate(steps))
        first = np.append(0, base)[np.searchsorted(starts, offsets[:-1])] if len(offsets) > 1 else np.empty(0, np.int64)
        return np.concatenate(ids), np.append(first, base[-1])

    def _matches(self, data: np.ndarray, inside: np.ndarray, back):
        """Pieces that end at each place, by length: ``(places, length, pieces)``.

        ``inside`` counts from the start of the place's unit; ``back(i, n)`` is where the byte
        stands that comes ``n`` bytes before that of the places ``i``.
        """
        live, node = np.arange(len(inside)), np.ones(len(inside), dtype=np.int32)
        for n in range(1, self.longest + 1):
            byte = data[back(live, n - 1)]
            node = self.next[node * 16 + (byte >> 4)]
            node = self.next[node * 16 + (byte & 15)]
            found = self.piece[node]
            hit = np.flatnonzero(found >= 0)
            yield live[hit], n, found[hit]
            on = np.flatnonzero((node > 0) & (inside[live] >= n))
            if not len(on):
                return
            live, node = live[on], node[on]

    def _choices(self, data: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Per place and length, the piece of that length that ends there, or -1; ``inside`` counts from its unit's start."""
        choice = np.full((len(data), self.longest), -1, dtype=np.int32)
        for at, n, found in self._matches(data, inside, lambda i, k: i - k):
            choice[at, n - 1] = found
        return choice

    def _sample_short(self, data, starts, ends, key) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all units, and how many each has."""
        _, first, which = np.unique(span_hash(prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
        size = (ends - starts)[first]
        rank = np.argsort(-size, kind="stable")  # longest first
        back = np.empty_like(rank)
        back[rank] = np.arange(len(rank))
        which, first, size = back[which], first[rank], size[rank]
        # place off[r] + u stands behind r bytes of unit u; the units of r bytes and more are the first ones
        width = np.searchsorted(-size, -np.arange(int(size[0]) + 1), side="right")
        off = np.append(0, np.cumsum(width))
        inside = np.repeat(np.arange(len(width)), width)
        unit = np.arange(off[-1]) - off[inside]
        own = data[starts[first][unit] + np.maximum(inside - 1, 0)]
        begin, length, piece = self._entries(own, off, inside, unit)
        share = self._shares(off, begin, inside, unit, length, piece)
        # what the shorter pieces of the place take; the longer ones are tried first
        below = np.append(np.float32(0), share[:-1])
        below[begin[:-1][np.diff(begin) > 0]] = 0
        # backward: all occurrences at once
        left = ends - starts
        live = np.arange(len(starts))
        steps = np.zeros(len(starts), dtype=np.int64)
        got = []
        while len(live):
            at = begin[off[left[live]] + which[live] + 1] - 1
            draw = _uniform(key[live] + _U(len(got)))
            go = np.flatnonzero(below[at] > draw)
            while len(go):
                at[go] -= 1
                go = go[below[at[go]] > draw[go]]
            got.append((live, piece[at]))
            steps[live] += 1
            left[live] -= length[at]
            live = live[left[live] > 0]
        base = np.cumsum(steps)
        out = np.empty(base[-1], dtype=np.int32)
        for step, (occurrence, ids) in enumerate(got):
            out[base[occurrence] - 1 - step] = ids
        return out, steps

    def _entries(self, own, off, inside, unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces by the place where they end, then by length: where a place's begin, their lengths and ids."""
        u, r = unit[off[1] :], inside[off[1] :]
        found = list(self._matches(own, r - 1, lambda i, k: off[r[i] - k] + u[i]))
        count = np.zeros(len(own), dtype=np.int64)
        for at, _, _ in found:
            count[off[1] + at] += 1
        begin = np.append(0, np.cumsum(count))
        free = begin[:-1].copy()
        length, piece = np.empty(begin[-1], dtype=np.int16), np.empty(begin[-1], dtype=np.int32)
        for at, n, ids in found:
            to = free[off[1] + at]
            length[to], piece[to] = n, ids
            free[off[1] + at] += 1
        return begin, length, piece

    def _shares(self, off, begin, inside, unit, length, piece) -> np.ndarray:
        """Of the forward sum of a place, the part of its pieces up to each one."""
        count = np.diff(begin)
        source = off[np.repeat(inside, count) - length] + np.repeat(unit, count)
        part = self.weight[piece]
        # forward sums as fractions and powers of two, so that no length runs out of range
        fraction, power = np.full(off[-1], 0.5), np.ones(off[-1], dtype=np.int32)
        for r in range(1, len(off) - 1):
            here = slice(off[r], off[r + 1])
            lo, hi = begin[off[r]], begin[off[r + 1]]
            first = begin[here] - lo
            came = source[lo:hi]
            up = power[came]
            top = np.maximum.reduceat(up, first)
            part[lo:hi] = np.ldexp(fraction[came] * part[lo:hi], up - np.repeat(top, count[here]))
            fraction[here], more = np.frexp(np.add.reduceat(part[lo:hi], first))
            power[here] = more + top
        place, k = np.flatnonzero(count > 1), 1
        while len(place):
            at = begin[place] + k
            part[at] += part[at - 1]
            k += 1
            place = place[count[place] > k]
        return (part / np.repeat(part[begin[1:][count > 0] - 1], count[count > 0])).astype(np.float32)

    def _block(self, data: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """The choices at the places ``lo`` to ``hi`` of a unit."""
        a = max(0, lo - self.longest + 1)
        # places before ``lo`` are only there for the pieces that reach back to them
        return self._choices(data[a:hi], np.arange(hi - a))[lo - a :]

    def _sample_long(self, data: np.ndarray, key: np.uint64) -> np.ndarray:
        """Piece ids of one unit: the same lattice, block by block."""
        p, size = self.longest, len(data)
        # logarithms of the forward sums; before the start there is nothing
        logs = np.full(p + size, -np.inf)
        logs[p - 1] = 0.0
        state, scale = np.zeros(p), 0.0
        state[-1] = 1
        j = np.arange(STEP)
        for lo in range(0, size, BLOCK):
            hi = min(size, lo + BLOCK)
            weight = self.weight[self._block(data, lo, hi)]
            weight = np.pad(weight, ((0, -len(weight) % STEP), (0, 0))).reshape(-1, STEP, p)
            # STEP sums at once: new = inner @ new + outer @ old, where old are the p sums before
            inner, outer = np.zeros((len(weight), STEP, STEP)), np.zeros((len(weight), STEP, p))
            for n in range(1, p + 1):
                near = j >= n
                inner[:, j[near], j[near] - n] = weight[:, near, n - 1]
                outer[:, j[~near], p + j[~near] - n] = weight[:, ~near, n - 1]
            leap = np.linalg.solve(np.eye(STEP) - inner, outer)
            for k, jump in enumerate(leap):
                new = jump @ state
                m = min(STEP, hi - lo - k * STEP)
                at = p + lo + k * STEP
                with np.errstate(divide="ignore"):
                    logs[at : at + m] = np.log(new[:m]) + scale
                state = np.append(state[m:], new[:m])
                top = state.max()
                state /= top
                scale += np.log(top)
        got, made, left = [], 0, size
        while left:
            lo = max(0, left - BLOCK)
            choice = self._block(data, lo, left)
            # logs[p + i] stands behind place i, so a piece of n bytes that ends there comes from logs[p + i - n]
            before = np.lib.stride_tricks.sliding_window_view(logs[lo : p + left - 1], p)[:, ::-1]
            run = np.cumsum(np.exp(before - logs[p + lo : p + left, None]) * self.weight[choice], axis=1)
            rows, ids = (run / run[:, -1:]).tolist(), choice.tolist()
            draws = _uniform(key + np.arange(made, made + len(rows)).astype(np.uint64)).tolist()
            own = []
            while left > lo:
                n = min(bisect_right(rows[left - 1 - lo], draws[len(own)]) + 1, p)
                own.append(ids[left - 1 - lo][n - 1])
                left -= n
            made += len(own)
            got.append(np.array(own[::-1], dtype=np.int32))
        return np.concatenate(got[::-1])


def _uniform(h: np.ndarray) -> np.ndarray:
    """A number from 0 to below 1 for each hash."""
    return (mix(h) >> _U(40)).astype(np.float32) * np.float32(2.0**-24)


def _encoded(pieces: Pieces, p: SamplingParams):
    spell_len = np.array([len(s) for s in pieces.spelled])
    spell_at = np.cumsum(spell_len) - spell_len
    spell = np.frombuffer(b"".join(pieces.spelled), dtype=np.uint8)

    def run(batches):
        lattice = Lattice(pieces)
        for batch in batches:
            keys = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for chunk in chunks(batch.column(1), p.group_bytes):
                out, edge = lattice.sample(chunk.data, chunk.offsets, mix(keys[chunk.rows]), p.seed)
                spelled, at = spelled_out(out, spell, spell_at, spell_len)
                same = np.zeros(len(chunk), dtype=bool)
                if len(spelled) == len(chunk.data):
                    differ = np.append(0, np.cumsum(spelled != chunk.data))
                    same = (at[edge][:-1] == chunk.offsets[:-1]) & (differ[chunk.offsets[1:]] == differ[chunk.offsets[:-1]])
                lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(out, pa.int32()))
                # a chunk is handed on as soon as it is done
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[chunk.rows], pa.array(np.diff(chunk.offsets), pa.int64()),
                     pa.array(np.diff(edge), pa.int64()), lists, pa.array(same, pa.bool_())],
                    ["doc_id", "n_bytes", "n_pieces", "pieces", "lossless"],
                )

    return run


def spelled_out(ids: np.ndarray, spell, spell_at, spell_len) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a row of pieces, and where each piece starts (one more at the end)."""
    size = spell_len[ids]
    at = np.append(0, np.cumsum(size))
    return spell[np.repeat(spell_at[ids] - at[:-1], size) + np.arange(at[-1])], at


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text",
           key: Column | None = None, params: SamplingParams = SamplingParams()) -> DataFrame:
    """doc_id, n_bytes, n_pieces, pieces, lossless (the pieces spell the text) of every row.

    ``key`` seeds a row (default: a hash of the id).  A null or empty text has no
    pieces.  Null and repeated ids are rows like others; rows with equal key and text
    get equal pieces.
    """
    seed = key if key is not None else F.xxhash64(F.col(id_col))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.coalesce(seed, F.lit(0)).cast("long").alias("key"),
    )
    return rows.mapInArrow(
        _encoded(pieces, params), "doc_id long, n_bytes long, n_pieces long, pieces array<int>, lossless boolean"
    )


def _decoded(pieces: Pieces):
    spell_len = np.array([len(s) for s in pieces.spelled])
    spell_at = np.cumsum(spell_len) - spell_len
    spell = np.frombuffer(b"".join(pieces.spelled), dtype=np.uint8)

    def run(batches):
        for batch in batches:
            texts = []
            for i in range(len(batch)):
                ids = batch.column(1)[i].values
                ids = np.empty(0, np.int64) if ids is None else ids.to_numpy(zero_copy_only=False).astype(np.int64)
                texts.append(spelled_out(ids, spell, spell_at, spell_len)[0].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, pieces: Pieces, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """doc_id and text of rows of pieces; a null row of pieces is an empty text."""
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(pieces_col).cast("array<int>").alias("pieces"))
    return rows.mapInArrow(_decoded(pieces), "doc_id long, text string")
