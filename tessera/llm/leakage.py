"""Passages of held-out items in a corpus, by suffix arrays over shards of the corpus.

Every shard (a slice of one partition) gets the sorted array of its suffixes at word beginnings; every suffix of the items is
looked up in it by binary search. Every verbatim run that is long enough to be part of a leak is aligned exactly.

Texts are compared as streams of letters and digits: case, accents, punctuation, white space, line breaks, look-alike
characters, page headers and paragraph numbers aren't in them. Letters of every script are told apart.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import lookalike
from tessera.llm.tokenize import parts

#: Characters of a shard; a text that is longer is a shard of its own.
SHARD_CHARS = 1_500_000
#: Characters of items that are held in each worker at once; more items take several passes over the corpus.
ITEM_CHARS = 4_000_000
#: Pairs of suffix and place that are compared at once.
PAIRS = 1_000_000
#: Words that stand before the number of a page, without accents.
PAGE_WORDS = ("page", "seite", "pagina", "sida", "strona")
#: Codes: 1 to 26 a to z, 27 to 36 digits, 37 to 71 the four places of the number of any other letter.
_BASE, _WIDTH, _PAD = 72, 10, 64
_FAR, _FARS = 37, 35
MEASURES = ("words", "altered", "first_word", "verbatim", "begins_at", "ends_at")
_HARD, _SOFT = 0, 255
#: Bits of a place among the letters of a shard.
_PLACE = 44
_DASH, _BLANK, _OPEN, _CLOSE, _HYPHEN = 1, 2, 4, 8, 16


def _code(letter: str) -> list[int]:
    if "a" <= letter <= "z":
        return [ord(letter) - 96]
    if "0" <= letter <= "9":
        return [ord(letter) - 21]
    point = ord(letter)
    return [_FAR + point // _FARS**k % _FARS for k in (3, 2, 1, 0)]


class Letters:
    """The codes of each code point that has been asked for, and what else it is.

    A letter is its base letters without accents, in lower case; a look-alike is the letter it is drawn like. What parts words
    is 0, what doesn't is 255. Only characters that occur are looked up, each once in a worker.
    """

    def __init__(self, alike: dict[str, str]) -> None:
        self.alike = alike
        self.known = np.zeros(0x110000, bool)
        self.first, self.count, self.flags = (np.zeros(0x110000, np.uint8) for _ in range(3))
        self.offset = np.zeros(0x110000, np.int32)
        self.store = np.zeros(0, np.uint8)
        self.marks = {}
        for text, flag in (("[(\u00b6\u00a7", _OPEN), ("]).:", _CLOSE), ("-\u2010\u00ac", _HYPHEN), ("\t\r", _BLANK)):
            for letter in text:
                for form in (letter, chr(ord(letter) + 0xFEE0)) if "!" <= letter <= "~" else (letter,):
                    self.marks[form] = self.marks.get(form, 0) | flag

    def learn(self, points: np.ndarray) -> None:
        """Looks up the code points that aren't known yet."""
        more = []
        for point in np.unique(points[~self.known[points]]).tolist():
            codes = self._codes(chr(point))
            self.first[point], self.count[point] = codes[0], len(codes)
            self.offset[point] = len(self.store) + len(more)
            self.flags[point] = self._flags(chr(point))
            more += codes
        self.known[points] = True
        self.store = np.concatenate([self.store, np.array(more, np.uint8)])

    def _codes(self, letter: str) -> list[int]:
        kind = unicodedata.category(letter)
        if kind[0] == "M" or letter in lookalike.INVISIBLE:
            return [_SOFT]
        if kind[0] not in "LN":
            return [_HARD]
        plain = unicodedata.normalize("NFKD", self.alike.get(letter, letter)).lower()
        base = [self.alike.get(x, x) for x in plain if unicodedata.category(x)[0] in "LN"]
        return [code for x in base or [letter] for code in _code(x)]

    def _flags(self, letter: str) -> int:
        kind = unicodedata.category(letter)
        return self.marks.get(letter, 0) | (_DASH if kind == "Pd" else 0) | (_BLANK if kind == "Zs" else 0)


@cache
def letters_of(alike: tuple[tuple[str, str], ...]) -> Letters:
    """One table in each worker."""
    return Letters(dict(alike))


@dataclass
class Stream:
    """Letters of texts laid end to end, a 0 before each text and behind the last; word beginnings; the text of each."""

    letters: np.ndarray
    begins: np.ndarray
    text_of: np.ndarray
    keys: np.ndarray
    #: The character of its text that each letter comes from.
    source: np.ndarray

    def key_of_prefix(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The first `length` (at most 10) letters from each place on, as a number."""
        return self.keys[at] // _POWERS[_WIDTH - length]


_POWERS = np.array([_BASE**k for k in range(_WIDTH + 1)], np.uint64)


def _keys(letters: np.ndarray) -> np.ndarray:
    """The 10 letters from each place on, as one number."""
    padded = np.concatenate([letters, np.zeros(_WIDTH, np.uint8)]).astype(np.uint64)
    two = padded[:-1] * np.uint64(_BASE) + padded[1:]
    four = two[:-2] * _POWERS[2] + two[2:]
    eight = four[:-4] * _POWERS[4] + four[4:]
    return (eight[:-2] * _POWERS[2] + two[8:])[: len(letters)]


def _drop_furniture(points: np.ndarray, codes: np.ndarray, flags: np.ndarray, starts: np.ndarray) -> None:
    """Takes page headers (lines with two dashes that end in a word for page and a number) and numbers of paragraphs out of codes."""
    n = len(points)
    lines = np.unique(np.concatenate([starts[starts < n], np.flatnonzero(points[:-1] == 10) + 1]))
    ends = np.append(lines[1:], n)
    dashes = np.add.reduceat((flags & _DASH).astype(np.int32), lines)
    for k in np.flatnonzero(dashes >= 2):
        line = codes[lines[k] : ends[k]]
        seen = line[(line != _HARD) & (line != _SOFT)]
        digits = 0
        while digits < len(seen) and 27 <= seen[-1 - digits] <= 36:
            digits += 1
        if 0 < digits < 7 and seen[: len(seen) - digits].tobytes().endswith(_PAGES):
            line[:] = _HARD
    # A number of up to three digits at the beginning of a line, with a mark before or behind it.
    at, opened = lines.copy(), np.zeros(len(lines), bool)
    for _ in range(8):
        here = np.minimum(at, n - 1)
        skip = (at < ends) & (((flags[here] & (_BLANK | _OPEN)) > 0) | (codes[here] == _SOFT))
        opened |= skip & ((flags[here] & _OPEN) > 0)
        at += skip
    digit = (codes >= 27) & (codes <= 36)
    run = np.zeros(len(lines), np.int64)
    for k in range(4):
        run += (run == k) & (at + k < ends) & digit[np.minimum(at + k, n - 1)]
    behind = np.minimum(at + run, n - 1)
    closed = (at + run < ends) & ((flags[behind] & _CLOSE) > 0)
    letter = (at + run < ends) & (codes[behind] != _HARD) & (codes[behind] != _SOFT)
    number = (run > 0) & (run < 4) & (closed | opened) & ~letter
    for k in range(3):
        codes[at[number & (run > k)] + k] = _HARD


_PAGES = tuple(bytes(ord(x) - 96 for x in word) for word in PAGE_WORDS)


def stream(table: Letters, texts: list[str | None], furniture: bool, words_by_blanks: bool = False) -> Stream:
    """The stream of texts. words_by_blanks: only white space parts words, as in items."""
    bodies = [t or "" for t in texts]
    points = np.frombuffer("".join(bodies).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(b) for b in bodies], np.int64)
    starts = np.cumsum(lengths) - lengths
    table.learn(points)
    flags, codes = table.flags[points], table.first[points]
    # A hyphen at the end of a line parts no word.
    if len(points):
        breaks = np.flatnonzero(points[1:] == 10)
        breaks = breaks[(flags[breaks] & _HYPHEN) > 0]
        codes[breaks] = _SOFT
        codes[breaks + 1] = _SOFT
    if furniture and len(points):
        _drop_furniture(points, codes, flags, starts)
    known = (codes != _HARD) & (codes != _SOFT)
    kept = np.flatnonzero(known)
    parting = codes == _HARD
    if words_by_blanks:
        parting &= ((flags & _BLANK) > 0) | ((points >= 9) & (points <= 13))
    gaps = np.cumsum(parting, dtype=np.int32)[kept]
    owner = np.repeat(np.arange(len(bodies), dtype=np.int32), lengths)[kept]
    new_text = np.ones(len(kept), bool)
    new_text[1:] = owner[1:] != owner[:-1]
    begins = new_text.copy()
    begins[1:] |= gaps[1:] != gaps[:-1]
    found = codes[kept]
    size = table.count[points[kept]].astype(np.int64)
    if len(kept) and size.max() > 1:
        # Letters of more than one code.
        first = np.cumsum(size) - size
        inner = np.arange(size.sum()) - np.repeat(first, size)
        kept = np.repeat(kept, size)
        found = table.store[table.offset[points[kept]] + inner]
        owner = np.repeat(owner, size)
        one = np.zeros(len(kept), bool)
        one[first] = new_text
        new_text = one
        one = np.zeros(len(kept), bool)
        one[first] = begins
        begins = one
    # One 0 goes before each text that has letters.
    at = np.arange(len(kept)) + np.cumsum(new_text)
    letters = np.zeros(len(kept) + int(new_text.sum()) + _PAD, np.uint8)
    letters[at] = found
    text_of = np.full(len(letters), -1, np.int32)
    text_of[at] = owner
    source = np.zeros(len(letters), np.int64)
    source[at] = kept - starts[owner]
    return Stream(letters, at[begins], text_of, _keys(letters), source)


class Items:
    """Items as a stream, their words, and the sorted keys of their suffixes."""

    def __init__(self, table: Letters, ids: list, texts: list[str | None], least_run: int) -> None:
        self.ids, self.table = ids, table
        self.forward = stream(table, texts, furniture=False, words_by_blanks=True)
        self.begins = self.forward.begins
        self.item_of = self.forward.text_of[self.begins]
        n = len(self.begins)
        first_of = np.flatnonzero(np.append([True], self.item_of[1:] != self.item_of[:-1])) if n else np.zeros(0, np.int64)
        last = np.append(first_of, n)[1:]
        self.first_word = np.repeat(first_of, last - first_of)
        self.end_word = np.repeat(last, last - first_of)
        letters = self.forward.letters
        stops = np.flatnonzero(letters == 0)
        item_end = stops[np.searchsorted(stops, self.begins)] if n else np.zeros(0, np.int64)
        self.item_end = item_end
        following = np.append(self.begins, 0)[1:]
        inside = np.append(self.item_of[1:] == self.item_of[:-1], False) if n else np.zeros(0, bool)
        self.length = np.where(inside, following, item_end) - self.begins
        # Runs of least_run words that can begin here, and how many letters the shortest of them has.
        seeds = np.flatnonzero(np.arange(n) + least_run <= self.end_word)
        ends = seeds + least_run - 1
        spans = self.begins[ends] + self.length[ends] - self.begins[seeds]
        self.depth = int(min(spans.min(), 2 * _WIDTH)) if len(seeds) else _WIDTH
        order, self.suffix_keys = suffix_array(self.forward, self.begins[seeds], self.depth)
        self.seeds = seeds[order]

    def words(self, item: int) -> list[bytes]:
        which = np.flatnonzero(self.item_of == item)
        return [self.forward.letters[b : b + k].tobytes() for b, k in zip(self.begins[which], self.length[which], strict=True)]


def suffix_array(s: Stream, at: np.ndarray, depth: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The order of the suffixes from the places `at` on by their first `depth` (at most 20) letters, and in that order those
    letters, as a number of the first 10 and one of the rest."""
    first = s.keys[at] // _POWERS[max(_WIDTH - depth, 0)]
    second = s.keys[np.minimum(at + _WIDTH, len(s.keys) - 1)] // _POWERS[min(2 * _WIDTH - depth, _WIDTH)]
    order = np.lexsort((second, first))
    return order, (first[order], second[order])


def bounds(array: tuple[np.ndarray, np.ndarray], wanted: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sorted array the pairs that equal each wanted pair begin and end, by binary search."""
    first, second = array
    low, high = np.searchsorted(first, wanted[0], "left"), np.searchsorted(first, wanted[0], "right")
    out = []
    for before in (np.less, np.less_equal):
        a, b = low.copy(), high.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            middle = (a[live] + b[live]) // 2
            up = before(second[middle], wanted[1][live])
            a[live[up]], b[live[~up]] = middle[up] + 1, middle[~up]
            live = live[a[live] < b[live]]
        out.append(a)
    return out[0], out[1]


class Walk:
    """Follows verbatim matches onward from a word and a place."""

    def __init__(self, doc: Stream, items: Items) -> None:
        self.doc, self.items = doc, items

    def equal(self, y: np.ndarray, i: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Whether `count` letters agree from y on in the corpus and from i on in the items."""
        doc, item = self.doc, self.items.forward
        ok = y >= 0
        done, at = 0, np.flatnonzero(ok)
        while len(at):
            rest = np.minimum(count[at] - done, _WIDTH)
            here = np.minimum(y[at] + done, len(doc.keys) - 1)
            same = doc.key_of_prefix(here, rest) == item.key_of_prefix(i[at] + done, rest)
            ok[at[~same]] = False
            done += _WIDTH
            at = at[same & (count[at] > done)]
        return ok

    def run(self, word: np.ndarray, y: np.ndarray, until: np.ndarray) -> np.ndarray:
        """The word behind the whole words that match one after the other, up to the word `until`."""
        word, y = word.copy(), y.copy()
        alive = np.flatnonzero(word != until)
        while len(alive):
            w = word[alive]
            size = self.items.length[w]
            ok = self.equal(y[alive], self.items.begins[w], size)
            alive, size = alive[ok], size[ok]
            y[alive] += size
            word[alive] += 1
            alive = alive[word[alive] != until[alive]]
        return word


@dataclass(frozen=True)
class Rule:
    """What a leak is: so many consecutive words, of which one in `altered_in` may be altered."""

    words: int = 25
    altered_in: int = 10

    @property
    def least_run(self) -> int:
        """The words that some verbatim run of every leak has: the altered words part the rest into one run more."""
        return min(-(-(n - n // self.altered_in) // (n // self.altered_in + 1)) for n in range(self.words, 40 * self.altered_in))


class Alignment:
    """Alignments of items with the texts of a shard: chains of item words that the text holds verbatim, in order.

    Words are compared by their letters, so a word that the text parts otherwise is the same. Between two words of a chain,
    some words of the item may be altered; the text has at most two words for each of them, and one more. A chain begins and
    ends where a word of the text does.
    """

    def __init__(self, doc: Stream, rule: Rule) -> None:
        self.letters, self.begins, self.rule = doc.letters.tobytes(), doc.begins.tolist(), rule
        self.owner = doc.text_of[doc.begins]
        # The letters of each word of a text, and no less.
        self.widths = np.diff(np.append(doc.begins, len(doc.letters) - _PAD))

    def onward(self, words: list[bytes], row: int, y: int, most: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(row, place, altered words before it) of each word that can follow, the text's words ending before number `end`."""
        letters, begins, last = self.letters, self.begins, len(words)
        y += len(words[row])
        row += 1
        if row < last and letters.startswith(words[row], y):
            yield row, y, 0
        k = bisect_left(begins, y)
        if letters[y] and not (k < end and begins[k] == y):
            return
        for altered in range(min(most + 1, last - row)):
            word = words[row + altered]
            for z in begins[k + (altered == 0) : min(k + 2 * altered + 2, end)]:
                if letters.startswith(word, z):
                    yield row + altered, z, altered

    def back(self, words: list[bytes], row: int, y: int, most: int, first: int) -> Iterator[tuple[int, int, int]]:
        """The same for each word that can go before, the text's words beginning with number `first`."""
        letters, begins = self.letters, self.begins
        row -= 1
        if row >= 0 and y >= len(words[row]) and letters.startswith(words[row], y - len(words[row])):
            yield row, y - len(words[row]), 0
        k = bisect_left(begins, y)
        if k == len(begins) or begins[k] != y:
            return
        for altered in range(min(most, row) + 1):
            word = words[row - altered]
            for z in begins[max(k - 2 * altered - 1, first) : k + (altered > 0)]:
                if z >= len(word) and letters.startswith(word, z - len(word)):
                    yield row - altered, z - len(word), altered

    def reached(self, step: Callable, words: list[bytes], seeds: set[tuple[int, int]], most: int, edge: int, rows: Iterable[int]) -> set[tuple[int, int]]:
        """All (row, place) that a chain from one of the seeds reaches with at most `most` altered words."""
        found: list[dict[int, int]] = [{} for _ in words]
        for row, y in seeds:
            found[row][y] = 0
        for row in rows:
            for y, altered in found[row].items():
                for to, z, more in step(words, row, y, most - altered, edge):
                    if altered + more < found[to].get(z, most + 1):
                        found[to][z] = altered + more
        return {(row, y) for row, ys in enumerate(found) for y in ys}

    def runs(self, words: list[bytes], seeds: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """(first row, row behind the last, place, place behind it) of the verbatim runs that the seeds lie in, each as long as it is."""
        letters, out, have = self.letters, set(), set(seeds)
        for a, y in seeds:
            if a and (a - 1, y - len(words[a - 1])) in have:
                continue
            b, z = a, y
            while b < len(words) and letters.startswith(words[b], z):
                z += len(words[b])
                b += 1
            while a and y >= len(words[a - 1]) and letters.startswith(words[a - 1], y - len(words[a - 1])):
                a -= 1
                y -= len(words[a])
            out.add((a, b, y, z))
        return sorted(out, key=lambda r: r[2])

    def promising(self, words: list[bytes], run: tuple[int, int, int, int], widest: int) -> bool:
        """False only where no passage under the rule goes through the run: too many words of the item don't occur at all where
        an alignment could reach them. widest: the letters of the text's longest word."""
        (a, b, y, z), n, rule, letters = run, len(words), self.rule, self.letters
        most = n // rule.altered_in
        # How many rows go onward and back with each number of missing words. An alignment passes the letters of the rows and
        # two words of the text for each altered row, and one for each row.
        onward, back, passed = [], [], 0
        for row in range(b, n):
            passed += len(words[row])
            if letters.find(words[row], z, z + passed + (2 * most + row - b + 1) * widest) < 0:
                onward.append(row - b)
                if len(onward) > most:
                    break
        else:
            onward.append(n - b)
        passed = 0
        for row in range(a - 1, -1, -1):
            passed += len(words[row])
            if letters.find(words[row], max(y - passed - (2 * most + a - row) * widest, 0), y) < 0:
                back.append(a - 1 - row)
                if len(back) > most:
                    break
        else:
            back.append(a)
        return any(b - a + p + q >= max(rule.words, rule.altered_in * (e + f)) for e, p in enumerate(onward) for f, q in enumerate(back))

    def is_begin(self, y: int, end: int) -> bool:
        k = bisect_left(self.begins, y)
        return k < end and self.begins[k] == y

    def longest(self, words: list[bytes], text: int, seeds: list[tuple[int, int]]) -> tuple[int, int, int, int, int, int] | None:
        """(words, altered, first word, place, place behind, words of the longest verbatim run) of the passage with most verbatim
        words under the rule through one of the seeds, None if there is none."""
        rule, n = self.rule, len(words)
        first, end = (int(x) for x in np.searchsorted(self.owner, [text, text + 1]))
        runs = self.runs(words, seeds)
        for a, b, y, z in runs:
            if b - a == n and self.is_begin(y, end) and (not self.letters[z] or self.is_begin(z, end)):
                return n, 0, 0, y, z, n
        widest = int(self.widths[first:end].max())
        runs = [r for r in runs if self.promising(words, r, widest)]
        if not runs:
            return None
        best: tuple[int, int, int, int, int] | None = None
        # Runs far from each other are followed apart, so that what is held stays small.
        span, at = 4 * sum(map(len, words)), 0
        while at < len(runs):
            upto = at
            while upto < len(runs) and runs[upto][2] <= runs[at][2] + span:
                upto += 1
            mine, at = {(r[0], r[2]) for r in runs[at:upto]}, upto
            most = n // rule.altered_in
            points = self.reached(self.onward, words, mine, most, end, range(n)) | self.reached(self.back, words, mine, most, first, range(n - 1, -1, -1))
            # The least altered words of a chain from each first word to each point and, in the lower bits, where it begins.
            none = np.full(n, n + 1 << _PLACE, np.int64)
            least = dict.fromkeys(points, none)
            rows = np.arange(n)
            for row, y in sorted(points):
                here = least[row, y]
                if self.is_begin(y, end):
                    here = here.copy()
                    here[row] = y
                if here.min() >> _PLACE > most:
                    continue
                for to, z, altered in self.onward(words, row, y, most, end):
                    if (to, z) in least:
                        least[to, z] = np.minimum(least[to, z], here + (altered << _PLACE))
                y += len(words[row])
                if self.letters[y] and not self.is_begin(y, end):
                    continue
                size, gone = row + 1 - rows, here >> _PLACE
                good = np.flatnonzero((size >= rule.words) & (gone * rule.altered_in <= size))
                if len(good):
                    a = int(good[np.argmax((size - gone)[good])])
                    found = (int(size[a]), int(gone[a]), a, int(here[a]) & (1 << _PLACE) - 1, y)
                    if best is None or (found[0] - found[1], found[0]) > (best[0] - best[1], best[0]):
                        best = found
        return best and (*best, max(b - a for a, b, *_ in runs))


def search(items: Items, texts: list[str | None], rule: Rule) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """(text, item, words, altered, first word, words of the longest verbatim run, first character, character behind the last) of
    every leak in a shard."""
    doc = stream(items.table, texts, furniture=True)
    if not len(doc.begins) or not len(items.seeds):
        return []
    # The suffix array of the shard: word beginnings in the order of their letters, to the depth of the items' keys.
    order, array = suffix_array(doc, doc.begins, items.depth)
    one, two = items.suffix_keys
    first = np.flatnonzero(np.append([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
    times = np.diff(np.append(first, len(one)))
    low, high = bounds(array, (one[first], two[first]))
    hit = np.flatnonzero(high > low)
    walk = Walk(doc, items)
    # All pairs of an item's suffix and a place with that key, in blocks; keys are deep, so few suffixes share one.
    size = (high[hit] - low[hit]) * times[hit]
    block = np.cumsum(size) // PAIRS
    kept = []
    for number in np.unique(block):
        mine = hit[block == number]
        many = size[block == number]
        which = np.repeat(mine, many)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        suffix = items.seeds[first[which] + inner % times[which]]
        place = doc.begins[order[low[which] + inner // times[which]]]
        long = walk.run(suffix, place, np.minimum(suffix + rule.least_run, items.end_word[suffix])) - suffix >= rule.least_run
        kept.append((suffix[long], place[long]))
    if not kept:
        return []
    suffix, place = (np.concatenate(x) for x in zip(*kept, strict=True))
    seeds: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for t, i, row, y in zip(*(x.tolist() for x in (doc.text_of[place], items.item_of[suffix], suffix - items.first_word[suffix], place)), strict=True):
        seeds.setdefault((t, i), []).append((row, y))
    alignment, known, out = Alignment(doc, rule), {}, []
    for (t, i), found in seeds.items():
        if i not in known:
            known[i] = items.words(i)
        best = alignment.longest(known[i], t, found)
        if best:
            words, altered, first_word, begin, end, verbatim = best
            out.append((t, i, words, altered, first_word, verbatim, int(doc.source[begin]), int(doc.source[end - 1]) + 1))
    return out


def leaks(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule | None = None) -> DataFrame:
    """key, item_id, words, altered, first_word, verbatim, begins_at, ends_at: documents that hold a passage of an item, with the
    longest passage, the words of its longest verbatim run, and where it stands in the text (characters from 0 on).

    At least `rule.words` consecutive words of the item, of which up to one in `rule.altered_in` may be altered or blacked
    out. Null and empty texts hold none, null and short items leak into none. Items are held in each worker as far as
    ITEM_CHARS go; more of them are split into blocks by a hash of their id, each a pass of its own over the corpus.
    """
    rule = rule or Rule()
    chars = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(chars) // ITEM_CHARS))
    kinds = f"`{key}` {documents.schema[key].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, words int, altered int, first_word int, verbatim int, begins_at int, ends_at int"
    alike = tuple(sorted(lookalike.alike(documents.sparkSession).items()))

    def one(block: int) -> DataFrame:
        chosen = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).select("item_id", "text").where("text IS NOT NULL")
        rows = sorted(chosen.collect(), key=lambda r: (r["item_id"] is None, r["item_id"]))
        ids, bodies = [r["item_id"] for r in rows], [r["text"] for r in rows]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(letters_of(alike), ids, bodies, rule.least_run)
            for batch in batches:
                for first, end in parts(batch.column(1), SHARD_CHARS):
                    part = batch.slice(first, end - first)
                    found = search(items, part.column(1).to_pylist(), rule)
                    names = part.column(0)
                    columns = [names.take(pa.array([f[0] for f in found], pa.int64())), pa.array([ids[f[1]] for f in found], item_type), *[pa.array([f[k] for f in found], pa.int32()) for k in range(2, 8)]]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "item_id", *MEASURES])

        return documents.select(key, text).mapInArrow(run, kinds)

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    return reduce(DataFrame.unionByName, [one(b) for b in range(blocks)])
