"""Byte-level BPE on whole columns of texts with numpy.

Texts are cut into pieces by vectorised character classes, distinct pieces are laid into padded matrices of equal length
buckets, and in each round every row merges its leftmost pair of minimum rank. Pairs are looked up by hash; merged symbols
are compacted to the left.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import cache

import numpy as np

#: Longest piece, in bytes, of which many lie in one matrix; a longer one is a matrix of one row.
WIDEST = 64
_OTHER, _SPACE, _LETTER, _NUMBER = 0, 1, 2, 3


@cache
def _classes() -> np.ndarray:
    """The class of each code point: letter (L), number (N), white space, or other."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for point in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            table[point] = _LETTER
        elif kind == "N":
            table[point] = _NUMBER
    table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return table


def cut(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin in points (code points of texts laid end to end; starts: where each text begins).

    A piece is a run of letters, of numbers or of others, each with a plain space before it if there is one; an English
    contraction; or white space, whose last character goes to the next piece if it is a plain space and is left alone if not.
    """
    n = len(points)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[starts[starts < n]] = True
    first[n] = True
    begins = first[:-1].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    last_space = space.copy()
    last_space[:-1] &= ~space[1:] | first[1:-1]
    # The last of several spaces parts from the rest if a text goes on behind it.
    ends_text = first[1:]
    part = last_space & ~ends_text
    begins |= part
    after = np.flatnonzero(part & (points == 0x20)) + 1
    begins[after] = False
    # Contractions begin at an apostrophe that begins a piece; a space before it would have taken it.
    mark = np.flatnonzero(begins & (points == 0x27))
    if len(mark):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        until = np.concatenate([first, np.ones(3, bool)])
        one, two = padded[mark + 1], padded[mark + 2]
        whole_one, whole_two = ~until[mark + 1], ~until[mark + 1] & ~until[mark + 2]
        short = whole_one & np.isin(one, [ord(x) for x in "stmd"])
        long = whole_two & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for at, length in ((mark[short], 2), (mark[long], 3)):
            for k in range(1, length):
                begins[at + k] = False
            ends = at + length
            begins[ends[ends < n]] = True
    return np.flatnonzero(begins)


class Merges:
    """The pairs of a vocabulary with merges, hashed; the id of a merged symbol orders the merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary = model["vocab"]
        printable = _byte_letters()
        self.byte_ids = np.array([vocabulary[printable[b]] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self.symbols = max(vocabulary.values()) + 1
        self._hash(left, right)

    def _hash(self, left: np.ndarray, right: np.ndarray) -> None:
        """An open table of the pairs: pair in keys, its rank in ranks; as many probes as the longest chain."""
        self.bits = max(4, int(np.ceil(np.log2(4 * len(left) + 1))))
        size = 1 << self.bits
        self.mask = size - 1
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, np.iinfo(np.int32).max, np.int32)
        keys = left * self.symbols + right
        waiting, probe = np.arange(len(keys)), 0
        while len(waiting):
            slots = (self._slot(keys[waiting]) + probe) & self.mask
            free = self.keys[slots] == -1
            _, first = np.unique(slots[free], return_index=True)
            taken = np.flatnonzero(free)[first]
            self.keys[slots[taken]] = keys[waiting[taken]]
            self.ranks[slots[taken]] = waiting[taken]
            waiting = np.delete(waiting, taken)
            probe += 1
        self.probes = probe

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; the largest int32 where there is none."""
        keys = left.astype(np.int64) * self.symbols + right
        slots = self._slot(keys)
        out = np.full(keys.shape, np.iinfo(np.int32).max, np.int32)
        open_ = np.arange(keys.size)
        flat, at, flat_out = keys.ravel(), slots.ravel(), out.ravel()
        for probe in range(self.probes):
            held = self.keys[(at[open_] + probe) & self.mask]
            hit = held == flat[open_]
            flat_out[open_[hit]] = self.ranks[(at[open_[hit]] + probe) & self.mask]
            open_ = open_[~hit & (held != -1)]
            if not len(open_):
                break
        return flat_out.reshape(keys.shape)

    def encode_matrix(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of rows of symbols of one length: each round every row merges its leftmost pair of least rank."""
        none = np.iinfo(np.int32).max
        rows, width = symbols.shape
        done = np.zeros((rows, width), np.int32)
        lengths = np.full(rows, width, np.int64)
        alive, now = np.arange(rows), symbols.copy()
        ranks = self.find(now[:, :-1], now[:, 1:]) if width > 1 else np.zeros((rows, 0), np.int32)
        while True:
            if now.shape[1] > 1:
                where = ranks.argmin(axis=1)
                least = ranks[np.arange(len(alive)), where]
                busy = least != none
            else:
                busy = np.zeros(len(alive), bool)
            still = ~busy
            done[alive[still], : now.shape[1]] = now[still]
            lengths[alive[still]] = now.shape[1]
            if not busy.any():
                return done, lengths
            alive, now, where, least, ranks = alive[busy], now[busy], where[busy], least[busy], ranks[busy]
            # Every row loses one symbol, so all rows stay equally long and are compacted by one mask.
            count, wide = now.shape
            each = np.arange(count)
            now[each, where] = self.made[least]
            keep = np.ones((count, wide), bool)
            keep[each, where + 1] = False
            now = now[keep].reshape(count, wide - 1)
            if wide == 2:
                ranks = np.zeros((count, 0), np.int32)
                continue
            keep = np.ones((count, wide - 1), bool)
            keep[each, where] = False
            ranks = ranks[keep].reshape(count, wide - 2)
            # Only the pairs beside the new symbol have changed.
            inner = where > 0
            ranks[each[inner], where[inner] - 1] = self.find(now[inner, where[inner] - 1], now[inner, where[inner]])
            inner = where < wide - 2
            ranks[each[inner], where[inner]] = self.find(now[inner, where[inner]], now[inner, where[inner] + 1])

    def encode_row(self, now: np.ndarray) -> np.ndarray:
        """The ids of one row of symbols of any length. Each round merges all places of the pair of least rank at once, from left to
        right: what a merge makes has pairs of greater rank only, so the result is that of one place after the other."""
        none = np.iinfo(np.int32).max
        now = now.astype(np.int32)
        ranks = self.find(now[:-1], now[1:])
        while len(ranks):
            least = ranks.min()
            if least == none:
                break
            at = np.flatnonzero(ranks == least)
            # Of places that overlap every other one counts.
            first = np.append(True, np.diff(at) > 1)
            begin = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            now[at] = self.made[least]
            now = np.delete(now, at + 1)
            ranks = np.delete(ranks, at)
            at = at - np.arange(len(at))
            changed = np.unique(np.concatenate([at - 1, at]))
            changed = changed[(changed >= 0) & (changed < len(ranks))]
            ranks[changed] = self.find(now[changed], now[changed + 1])
        return now

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text k are ids[offsets[k]:offsets[k + 1]]; null and empty texts have none."""
        bodies = [t or "" for t in texts]
        joined = "".join(bodies)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(b) for b in bodies], np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        if not len(points):
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32)
        pieces = cut(points, starts[lengths > 0])
        owner = np.searchsorted(ends, pieces, side="right")
        # From code points to bytes.
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate([[0], np.cumsum(width)])
        begin, end = at[pieces], at[np.append(pieces[1:], len(points))]
        size = end - begin
        ids_of, count_of = self._distinct(data, begin, size)
        total = count_of.sum()
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=count_of, minlength=len(texts)).astype(np.int64))])
        out = np.empty(total, np.int32)
        goes = np.cumsum(count_of) - count_of
        for which, ids, lens, inverse in ids_of:
            each = lens[inverse]
            one = each == 1
            out[goes[which[one]]] = ids[inverse[one], 0]
            many = np.flatnonzero(~one)
            if len(many):
                # Place within the piece of each of its ids, and the piece of each of them.
                reps = each[many]
                piece = np.repeat(many, reps)
                inside = np.arange(len(piece)) - np.repeat(np.cumsum(reps) - reps, reps)
                out[goes[which[piece]] + inside] = ids[inverse[piece], inside]
        return offsets, out

    def _distinct(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[list, np.ndarray]:
        """Encodes the distinct pieces of each length; (pieces, ids, lengths, place of each piece) and the count of each piece."""
        parts, counts = [], np.zeros(len(size), np.int64)
        # Eight bytes from any place on, as one number.
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        bucket = np.minimum(size, WIDEST + 1).astype(np.uint8)
        order = np.argsort(bucket, kind="stable")
        sizes, firsts = np.unique(bucket[order], return_index=True)
        bounds = np.append(firsts, len(order))
        for k, length in enumerate(sizes.tolist()):
            which = order[bounds[k] : bounds[k + 1]]
            if length > WIDEST:
                bodies = [data[b : b + n].tobytes() for b, n in zip(begin[which], size[which], strict=True)]
                known = {body: self.encode_row(self.byte_ids[np.frombuffer(body, np.uint8)]) for body in set(bodies)}
                places = {body: p for p, body in enumerate(known)}
                lens = np.array([len(x) for x in known.values()], np.int64)
                ids = np.zeros((len(known), int(lens.max())), np.int32)
                for p, x in enumerate(known.values()):
                    ids[p, : len(x)] = x
                inverse = np.array([places[b] for b in bodies])
            else:
                words = (length + 7) // 8
                last = np.uint64((1 << (8 * (length - 8 * (words - 1)))) - 1)
                if words == 1:
                    distinct, inverse = np.unique(eights[begin[which]] & last, return_inverse=True)
                    distinct = distinct[:, None]
                else:
                    at = begin[which]
                    keys = np.stack([eights[at + 8 * w] for w in range(words)], axis=1)
                    keys[:, -1] &= last
                    sort = np.lexsort(keys.T)
                    ordered = keys[sort]
                    new = np.ones(len(sort), bool)
                    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
                    inverse = np.empty(len(sort), np.int64)
                    inverse[sort] = np.cumsum(new) - 1
                    distinct = ordered[new]
                matrix = np.ascontiguousarray(distinct).view(np.uint8).reshape(len(distinct), 8 * words)[:, :length]
                ids, lens = self.encode_matrix(self.byte_ids[matrix])
            parts.append((which, ids, lens, inverse))
            counts[which] = lens[inverse]
        return parts, counts


def _byte_letters() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable bytes themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(0x100 + rest.index(b)) for b in range(256)]


@cache
def merges(path: str) -> Merges:
    """The vocabulary at path, read once in each worker."""
    return Merges(path)
