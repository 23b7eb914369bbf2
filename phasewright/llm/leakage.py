"""Evaluation texts leaking into training text: CGK embedding, bit-sampling LSH, edit verification."""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters of a window: about five words.
WINDOW = 22
#: Steps of a random walk; a walk takes two steps a letter on average.
STEPS = 2 * WINDOW
#: Walks, samples of each walk, and letters of a sample, so that a window is met in 9 of 10 cases if it has ``RADIUS`` edits (with
#: two in 7 of 10, with three in 4 or 5 of 10); a passage has a window at every word and is tied by two of them.
WALKS, SAMPLES, TAKEN, RADIUS = 3, 3, 11, 1
#: Most edits between a window of a page and one of an item that are verified.
EDITS = 3
#: A case holds so many successive words of an item, and such a share of its words.
RUN_WORDS, SHARE = 16, 0.25
#: Letters that tie a page to an item beside the windows, if they stand in one line and in no more than ``RARE`` items.
TIE, RARE = 12, 4
#: Letters of the seeds by which lines are laid beside an item; seeds that make a line worth following; matched letters, and share of
#: the line's, that place it; lines from one to the next of a passage; letters lost if one cannot be read, and lines within which that is.
GRAM, SEEDS, PLACED, PART, BETWEEN, LOST, LOST_WITHIN = 5, 4, 12, 0.6, 24, 24, 8
#: Seeds that make a line count; letters that such seeds must cover in some stretch of an item; the stretch, and pairs looked at together.
LEAST_SEEDS, SEEN, STRETCH, PAIRS = 3, 32, 64, 2000
#: Share of the words of a run that are held.
DENSITY = 0.88
#: Share of the letters of a line's stretch that are matched, and most that are misread one after the other: another word is no misreading.
READ, MISREAD = 0.75, 3
#: Windows and letters worked on at a time, and windows that stay in a processor's cache.
SLICE, LETTERS, CACHED = 200_000, 2_000_000, 16_000
#: Items that one index holds, and indexes that one pass over the pages probes; more items take more passes.
ITEMS, INDEXES = 2000, 8
SEED = 20240229

# Signs a scanner takes for each other, as one sign each; then groups of signs.
_SAME = {"0": "o", "1": "l", "5": "s", "6": "b", "8": "b", "9": "g", "(": "c", "|": "l", "ſ": "s", "ß": "b"}
_CLASS = {"c": "o", "e": "o", "o": "o", "i": "l", "l": "l", "j": "l", "t": "l", "f": "l", "u": "n", "n": "n", "h": "h", "b": "h", "g": "g", "q": "g"}
_GROUPS = [(b"rn", b"m"), (b"vv", b"w"), (b"ol", b"d"), (b"ln", b"m")]


#: Codes of letters of other scripts, and of signs that are words of their own (scripts without blanks between words).
OTHER, ALONE = 128, 224


def _table() -> np.ndarray:
    """For each sign of the basic plane its class as a letter, a line break as itself, and a blank for all that is no letter or digit."""
    out = np.full(1 << 16, 32, np.uint8)
    for code in range(1 << 16):
        sign = chr(code)
        if not sign.isalnum():
            continue
        sign = sign.lower()[0]
        sign = _SAME.get(sign, sign)
        bare = sign if sign < "\x80" else unicodedata.normalize("NFKD", sign)[0]  # without its accents
        if bare < "\x80" and bare.isalnum():
            out[code] = ord(_CLASS.get(bare, bare))
        elif 0x3040 <= code < 0xA000 or 0xF900 <= code < 0xFB00:
            out[code] = ALONE + code * 7 % 32
        else:
            out[code] = OTHER + code * 37 % (ALONE - OTHER)
    for sign, one in _SAME.items():
        out[ord(sign)] = ord(_CLASS.get(one, one))
    out[10] = 10
    return out


_TABLE = _table()
_LATIN = _TABLE[:256].tobytes()


def canonical(text: str) -> bytes:
    """The text as the scanner could not have told it apart: letter classes, blanks and line breaks.

    Letters of other scripts keep a class of their own, out of about a
    hundred; a sign of a script without blanks is a word.
    """
    try:
        raw = text.replace("ſ", "s").encode("latin-1").translate(_LATIN)
    except UnicodeEncodeError:
        raw = _TABLE[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0xFFFF)].tobytes()
    for group, one in _GROUPS:
        raw = raw.replace(group, one)
    return raw


class Letters:
    """Letters of some texts without anything between them, with the word and the line each belongs to; lines without letters don't count.

    ``ends`` has the number of letters up to the end of each text.
    """

    def __init__(self, *texts: str):
        parts = [canonical(t) for t in texts]
        raw = np.frombuffer(b"\n".join(parts), np.uint8)
        is_letter = raw > 32
        first = is_letter.copy()
        first[1:] &= ~is_letter[:-1] | (raw[1:] >= ALONE)
        self.codes = raw[is_letter]
        self.word = np.cumsum(first, dtype=np.int32)[is_letter] - 1
        line = np.cumsum(raw == 10, dtype=np.int32)[is_letter]
        self.line = np.cumsum(np.concatenate(([False], line[1:] != line[:-1]))[: len(line)], dtype=np.int32)
        self.starts = np.flatnonzero(first[is_letter])
        upto = np.concatenate(([0], np.cumsum(is_letter)))
        self.ends = upto[np.minimum(np.cumsum([len(x) + 1 for x in parts]), len(raw))] if parts else np.empty(0, np.int64)
        self._sketches: dict[int, np.ndarray] = {}

    def sketches(self, part: int) -> np.ndarray:
        """Sketches of the windows from place ``part`` on, ``SLICE`` of them; made once for all indexes."""
        if part not in self._sketches:
            self._sketches[part] = sketch(self.codes, self.starts[part : part + SLICE])
        return self._sketches[part]


def grams(codes: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A number for the ``size`` letters from each place on (up to 12 letters: their own); the last places have none."""
    n = max(0, len(codes) - size + 1)
    out = np.zeros(n, np.int64)
    for k in range(size):
        out *= 32
        out += codes[k : k + n] & 31
    return out


def _walks() -> tuple[np.ndarray, np.ndarray]:
    """The random bits of the walks, the same for all texts, and the steps that each sample takes."""
    rng = np.random.default_rng(SEED)
    moves = rng.integers(0, 2, (WALKS, STEPS, OTHER), dtype=np.int64)
    taken = np.stack([np.sort(rng.choice(STEPS - 6, TAKEN, replace=False)) for _ in range(WALKS * SAMPLES)])
    return np.concatenate((moves, rng.integers(0, 2, (WALKS, STEPS, 256 - OTHER), dtype=np.int64)), 2), taken


_MOVES, _TAKEN = _walks()
_TAKES = [set(t) for t in _TAKEN.tolist()]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def sketch(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sampled signs of each window, hashed: one row per sample, one column per window.

    A walk stands at a letter and writes it down at every step; a random bit
    that depends on the step and the letter tells whether it goes on to the
    next one (CGK embedding: few edits become few differing signs).
    """
    padded = np.concatenate((codes, np.zeros(STEPS + 1, np.uint8)))
    out = np.zeros((WALKS * SAMPLES, len(starts)), np.uint64)
    for begin in range(0, len(starts), CACHED):
        here = slice(begin, begin + CACHED)
        for walk in range(WALKS):
            at = starts[here].astype(np.int64)
            mine = range(walk * SAMPLES, (walk + 1) * SAMPLES)
            for step in range(int(_TAKEN[list(mine)].max()) + 1):
                sign = np.take(padded, at, mode="clip")
                for k in mine:
                    if step in _TAKES[k]:
                        out[k, here] *= np.uint64(31)
                        out[k, here] += sign
                at += np.take(_MOVES[walk, step], sign, mode="clip")
    for h in out:
        h *= _MIX
        h ^= h >> np.uint64(17)
    return out


def edits(a: np.ndarray, b: np.ndarray, most: int = EDITS) -> np.ndarray:
    """Smallest number of edits that turn each row of ``a`` into a beginning of the row of ``b``; above ``most``: some larger number."""
    n, width = a.shape
    far = most + 1
    row = np.broadcast_to(np.minimum(np.arange(b.shape[1] + 1), far), (n, b.shape[1] + 1)).astype(np.int8)
    for i in range(width):
        lo, hi = max(0, i - most), min(b.shape[1], i + most + 1)
        new = np.full_like(row, far)
        if i < most:
            new[:, 0] = i + 1
        for j in range(lo, hi):
            best = row[:, j] + (b[:, j] != a[:, i])
            best = np.minimum(best, row[:, j + 1] + 1)
            new[:, j + 1] = np.minimum(np.minimum(best, new[:, j] + 1), far)
        row = new
    return row.min(1)


@dataclass
class ItemIndex:
    """The windows of a set of items: their letters, their sketches sorted, and a bit map of the sketches' ends."""

    ids: list
    codes: np.ndarray
    ends: np.ndarray
    word: np.ndarray
    words: np.ndarray
    owner: np.ndarray
    start: np.ndarray
    hashes: list
    order: list
    seen: np.ndarray
    ties: tuple = ()

    BITS = 21

    @classmethod
    def of(cls, items: list[tuple[int, str]], opening: int) -> ItemIndex:
        """``opening``: words at the start of every item that prove nothing."""
        ids, codes, word, words, owner, start, at, ends = [], [], [], [], [], [], 0, []
        for item, text in items:
            got = Letters(" ".join(text.split()[opening:]))
            if not len(got.codes):
                continue
            keep = got.starts[got.starts + WINDOW <= len(got.codes)]
            ids.append(item)
            codes.append(got.codes)
            word.append(got.word)
            words.append(len(got.starts))
            owner.append(np.full(len(keep), len(ids) - 1))
            start.append(keep + at)
            at += len(got.codes)
            ends.append(at)
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
        self = cls(ids, join(codes, np.uint8), np.array(ends, np.int64), join(word, np.int64), np.array(words, np.int64), join(owner, np.int64), join(start, np.int64), [], [], np.zeros(1 << cls.BITS, bool))
        for h in sketch(self.codes, self.start):
            by = np.argsort(h, kind="stable")
            self.order.append(by)
            self.hashes.append(h[by])
            self.seen[(h >> np.uint64(20)).astype(np.int64) & ((1 << cls.BITS) - 1)] = True
        number = grams(self.codes, TIE)
        owns = np.searchsorted(self.ends, np.arange(len(number)), "right")
        inside = owns == np.searchsorted(self.ends, np.arange(len(number)) + TIE - 1, "right")
        number, owns = np.unique(np.stack((number[inside], owns[inside])), axis=1)
        _, place, items_with = np.unique(number, return_inverse=True, return_counts=True)
        rare = items_with[place] <= RARE
        number, owns = number[rare], owns[rare]
        met = np.zeros(1 << cls.BITS, bool)
        met[cls._spot(number)] = True
        self.ties = (number, owns, met)
        return self

    @classmethod
    def _spot(cls, number: np.ndarray) -> np.ndarray:
        return ((number.astype(np.uint64) * _MIX) >> np.uint64(64 - cls.BITS)).astype(np.int64)

    def tied(self, pages: Letters) -> tuple[np.ndarray, np.ndarray]:
        """(text, place of an item) where a line of the text has ``TIE`` letters that few items have."""
        number, owns, met = self.ties
        texts, mine = [], []
        for part in range(0, len(pages.codes), SLICE):
            codes = pages.codes[part : part + SLICE + TIE - 1]
            line = pages.line[part : part + SLICE + TIE - 1]
            got = grams(codes, TIE)
            at = np.flatnonzero(met[self._spot(got)] & (line[: len(got)] == line[TIE - 1 :])) if len(got) else np.empty(0, np.int64)
            lo, hi = np.searchsorted(number, got[at], "left"), np.searchsorted(number, got[at], "right")
            n = hi - lo
            texts.append(np.repeat(np.searchsorted(pages.ends, part + at, "right"), n))
            mine.append(owns[np.repeat(lo - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())])
        return (np.concatenate(texts), np.concatenate(mine)) if texts else (np.empty(0, np.int64), np.empty(0, np.int64))

    def candidates(self, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the sketched windows, window of an item) of all windows that share a sample."""
        pages, mine = [], []
        for k, h in enumerate(sketches):
            maybe = np.flatnonzero(self.seen[(h >> np.uint64(20)).astype(np.int64) & ((1 << self.BITS) - 1)])
            lo, hi = np.searchsorted(self.hashes[k], h[maybe], "left"), np.searchsorted(self.hashes[k], h[maybe], "right")
            n = hi - lo
            if not n.any():
                continue
            first = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n)
            pages.append(np.repeat(maybe, n))
            mine.append(self.order[k][first + np.arange(n.sum())])
        if not pages:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = np.unique(np.concatenate(pages) * np.int64(len(self.start)) + np.concatenate(mine))
        return both // len(self.start), both % len(self.start)

    def verified(self, pages: Letters) -> tuple[np.ndarray, np.ndarray]:
        """(letter of the pages, window of an item) of all candidates within ``EDITS`` edits."""
        pad = np.concatenate((pages.codes, np.zeros(WINDOW + EDITS, np.uint8)))
        own = np.concatenate((self.codes, np.zeros(WINDOW, np.uint8)))
        at, mine = [], []
        for part in range(0, len(pages.starts), SLICE):
            starts = pages.starts[part : part + SLICE]
            here, window = self.candidates(pages.sketches(part))
            for some in range(0, len(here), SLICE):
                p, w = starts[here[some : some + SLICE]], window[some : some + SLICE]
                near = edits(own[self.start[w][:, None] + np.arange(WINDOW)], pad[p[:, None] + np.arange(WINDOW + EDITS)]) <= EDITS
                at.append(p[near])
                mine.append(w[near])
        return (np.concatenate(at), np.concatenate(mine)) if at else (np.empty(0, np.int64), np.empty(0, np.int64))

    def leaks(self, texts: list[str] | Letters) -> Iterator[tuple[int, int, int, int, int]]:
        """(place of the text, item, longest run, words held, words of the item) where windows or rare letters tie a text to an item."""
        pages = texts if isinstance(texts, Letters) else Letters(*texts)
        p, w = self.verified(pages)
        also, of = self.tied(pages)
        text, owner = np.searchsorted(pages.ends, p, "right"), self.owner[w]
        by = np.lexsort((p, owner, text))
        p, q = p[by], self.start[w[by]]
        many = np.int64(len(self.ids))
        key = text[by] * many + owner[by]
        # two windows at different places, or letters that few items have
        pair, first = np.unique(key, return_index=True)
        apart = np.maximum.reduceat(q, first) - np.minimum.reduceat(q, first) >= WINDOW // 2 if len(q) else np.zeros(0, bool)
        pairs = np.union1d(pair[apart], also * many + of)
        page = None
        for both, found in zip(pairs.tolist(), self.seeds(pages, pairs), strict=True):
            t, o = divmod(both, len(self.ids))
            hits = slice(*np.searchsorted(key, (both, both + 1)))
            if found is None:
                continue
            lo, hi = int(self.ends[o - 1]) if o else 0, int(self.ends[o])
            begin, end = int(pages.ends[t - 1]) if t else 0, int(pages.ends[t])
            if page is None or page[0] != t:
                page = (t, PageLines(pages.codes[begin:end], pages.line[begin:end]))
            held = held_words(page[1], list(zip((p[hits] - begin).tolist(), (q[hits] - lo).tolist(), strict=True)), found, self.codes[lo:hi], self.word[lo:hi])
            if max(int(x.sum()) for x in held) >= DENSITY * RUN_WORDS:  # no run of that many words has fewer
                yield t, self.ids[o], max(map(longest_run, held)), printed_words(held), int(self.words[o])

    def seeds(self, pages: Letters, pairs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None]:
        """For each pair of a text and an item: (line, page letter, item letter, seeds) for the seeds that a line and the item share.

        There is one for each line and shift between the two.  None where no
        ``STRETCH`` letters of the item, less than ``RUN_WORDS`` words have, are covered by ``SEEN``.
        """
        many = np.int64(len(self.ids))
        t, o = pairs // many, pairs % many
        begin = np.concatenate(([0], pages.ends[:-1]))
        wanted = np.zeros(len(pages.ends), bool)
        wanted[t] = True
        number = grams(pages.codes)
        text = np.searchsorted(pages.ends, np.arange(len(number)), "right")
        at = np.flatnonzero(wanted[text] & (pages.line[: len(number)] == pages.line[GRAM - 1 :])) if len(number) else np.empty(0, np.int64)
        own = (text[at] << 5 * GRAM) + number[at]
        by = np.argsort(own, kind="stable")
        own, at = own[by], at[by]
        lo = np.concatenate(([0], self.ends[:-1]))
        letters = np.maximum(self.ends - lo - GRAM + 1, 0)
        theirs = grams(self.codes)
        for part in range(0, len(pairs), PAIRS):
            tp, op = t[part : part + PAIRS], o[part : part + PAIRS]
            size = letters[op]
            which = np.repeat(np.arange(len(tp)), size)
            q = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            sought = (tp[which] << 5 * GRAM) + theirs[lo[op][which] + q]
            low, high = np.searchsorted(own, sought, "left"), np.searchsorted(own, sought, "right")
            n = high - low
            p = at[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            which, q = np.repeat(which, n), np.repeat(q, n)
            line = pages.line[p].astype(np.int64)
            p = p - begin[tp[which]]
            # an edit shifts the rest of a line by one: neighbouring shifts support each other
            span = np.int64((p.max(initial=0) + q.max(initial=0) + 8) * 2)
            first_line, lines = int(line.min(initial=0)), np.int64(line.max(initial=0) - line.min(initial=0) + 1)
            place = (which * lines + line - first_line) * span + (q - p + span // 2)
            spot, first, back, count = np.unique(place, return_index=True, return_inverse=True, return_counts=True)
            upto = np.concatenate(([0], np.cumsum(count)))
            near = upto[np.searchsorted(spot, spot + 3, "right")] - upto[np.searchsorted(spot, spot - 3, "left")]
            # item letters that good seeds cover, and the most of them in any stretch
            room = size + 2 * GRAM
            base = np.cumsum(room) - room
            good = near[back] >= LEAST_SEEDS
            mark = base[which[good]] + q[good]
            total = int(room.sum())
            cover = np.cumsum(np.bincount(mark, minlength=total + 1) - np.bincount(mark + GRAM, minlength=total + 1)[: total + 1]) > 0
            upto = np.concatenate(([0], np.cumsum(cover)))
            inside = upto[np.minimum(np.arange(total) + STRETCH, np.repeat(base + room, room))] - upto[:total]
            seen = np.maximum.reduceat(inside, base) if len(tp) else np.empty(0, np.int64)
            which, line, p, q = which[first], line[first], p[first], q[first]
            ends = np.searchsorted(which, np.arange(len(tp) + 1))
            for k in range(len(tp)):
                here = slice(ends[k], ends[k + 1])
                yield (line[here] - pages.line[begin[tp[k]]], p[here], q[here], near[here]) if seen[k] >= SEEN else None


class PageLines:
    """The letters of one page, the line of each, and where each line begins."""

    def __init__(self, codes: np.ndarray, line: np.ndarray):
        self.letters = codes.tobytes()
        self.line = line - line[:1]
        self.begin = np.searchsorted(self.line, np.arange(int(self.line[-1:].sum()) + 2))


def _stretch(page: bytes, p: int, p_end: int, item: bytes, q: int, q_end: int, step: int, matched: bytearray) -> int | None:
    """Mark the letters of an item that go on matching the page from (p, q) in one direction, past lone edits.

    Gives the next item letter if the page's end is reached, and None if the texts part before.
    """
    debt = 0.0
    room_p, room_q = (p_end - p) * step, (q_end - q) * step
    i = j = 0
    while i < room_p and j < room_q:
        if page[p + step * i] == item[q + step * j]:
            matched[q + step * j] = 1
            i += 1
            j += 1
            debt = max(0.0, debt - 0.25)
            continue
        debt += 1
        if debt > 3:
            return None
        best = (-1.0, 1, 1)
        for a, b in ((1, 1), (1, 0), (0, 1), (2, 1), (1, 2)):
            n, x, y = 0, i + a, j + b
            while n < 5 and x < room_p and y < room_q and page[p + step * x] == item[q + step * y]:
                n, x, y = n + 1, x + 1, y + 1
            if n - 0.1 * (a + b) > best[0]:
                best = (n - 0.1 * (a + b), a, b)
        i += best[1]
        j += best[2]
    return q + step * j if i >= room_p else None


def held_words(page: PageLines, hits: list[tuple[int, int]], found: tuple, codes: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
    """Which words of an item a page holds, from its verified windows (page letter, item letter) and the seeds ``found``: by the windows, and by each passage.

    Each window is followed to both sides to where its lines end or the texts
    part.  Then every line of the page that shares seeds with the item is laid
    beside it, also from inside a word.  Lines make a passage where one goes on
    in the item's order after another breaks off: at that letter or, if much of
    it matches, up to a lost line further on.  A line alone that has no window
    is no passage.  A word is held if two thirds of its letters are matched.
    """
    item, letters = codes.tobytes(), page.letters
    matched = bytearray(len(item))
    windows: dict[int, list[int]] = {}
    laid: dict[tuple[int, int], tuple[int, list[tuple[int, int, int]], bytearray]] = {}

    def follow(p: int, q: int, first: int, last: int, marks: bytearray) -> list[tuple[int, int, int]]:
        before = _stretch(letters, p - 1, int(page.begin[first]) - 1, item, q - 1, -1, -1, marks)
        after = _stretch(letters, p, int(page.begin[last + 1]), item, q, len(item), 1, marks)
        # (1 after a line, -1 before it; line; item letter that is expected there)
        return [(side, line, at) for side, line, at in ((-1, first, before), (1, last, after)) if at is not None]

    def lay(p: int, q: int, line: int) -> tuple[int, list[tuple[int, int, int]], bytearray]:
        """Letters matched without a gap beside those at a seed, the breaks that they reach, and the letters."""
        if (p, q) in laid:
            return laid[p, q]
        marks = bytearray(len(item))
        ends = follow(p, q, line, line, marks)
        low = high = q
        while (there := marks.rfind(1, max(0, low - MISREAD - 1), low)) >= 0:
            low = there
        while (there := marks.find(1, high + 1, high + MISREAD + 2)) >= 0:
            high = there
        n = marks.count(1, low, high + 1)
        if n < READ * (high + 1 - low):
            laid[p, q] = (0, [], marks)
            return laid[p, q]
        marks[:low], marks[high + 1 :] = bytes(low), bytes(len(item) - high - 1)
        near = [x for x in ends if (low - 1 - x[2] if x[0] < 0 else x[2] - 1 - high) <= MISREAD]
        laid[p, q] = (n, near, marks)
        return laid[p, q]

    def join(x: tuple[int, int, int], y: tuple[int, int, int], slack: int) -> bool:
        """Whether the line that ends with one break goes on with the other."""
        if x[0] == y[0]:
            return False
        end, start = (x, y) if x[0] > 0 else (y, x)
        lines = start[1] - end[1]
        return 0 < lines <= BETWEEN and -3 <= start[2] + 1 - end[2] <= (slack if lines <= LOST_WITHIN else 2)

    # pieces of the passage: breaks, letters, and whether a piece counts alone
    pieces: list[tuple[list[tuple[int, int, int]], bytearray, bool]] = []
    spans = []
    for p, q in hits:
        windows.setdefault(int(page.line[p]), []).append(q - p)
        if not all(matched[max(0, q - 6) : q + WINDOW + 6]):
            marks = bytearray(len(item))
            first, last = int(page.line[p]), int(page.line[min(p + WINDOW, len(letters)) - 1])
            pieces.append((follow(p, q, first, last, marks), marks, True))
            spans.append((first, last, marks.find(1) if 1 in marks else q, marks.rfind(1) if 1 in marks else q))
            matched = either(matched, marks)
    near: list[set[int]] = [set() for _ in pieces]

    def link(a: int, b: int) -> None:
        near[a].add(b)
        near[b].add(a)

    for a, x in enumerate(spans):
        for b, y in enumerate(spans):
            if a != b and x[0] <= y[0] <= x[1] + BETWEEN and x[2] <= y[2] <= x[3] + (LOST if y[0] <= x[1] + LOST_WITHIN else 3):
                link(a, b)
    runs = [matched]
    line, p, q, seeds = found
    begin, end = page.begin[line], page.begin[line + 1]
    start, stop = q - (p - begin), q + (end - p)
    at_hand = set()
    # lines of which much matches
    for k in np.flatnonzero((seeds >= SEEDS) & (end - begin >= PLACED)).tolist():
        own = (int(line[k]), int(q[k]) - int(p[k]))
        if any((own[0], own[1] + x) in at_hand for x in (-3, -2, -1, 0, 1, 2, 3)):
            continue
        n, ends, marks = lay(int(p[k]), int(q[k]), own[0])
        if n >= PLACED and n >= PART * (end[k] - begin[k]):
            at_hand.add(own)
            has = [a for a, (first, last, low, high) in enumerate(spans) if first <= own[0] <= last and any(abs(x - own[1]) <= 3 for x in windows.get(own[0], ()))]
            pieces.append((ends, marks, bool(has)))
            near.append(set())
            for a in has:
                link(a, len(pieces) - 1)
    placed = len(pieces)
    for a in range(placed):
        for b in range(a):
            if any(join(x, y, LOST) for x in pieces[a][0] for y in pieces[b][0]):
                link(a, b)
    # passages: pieces that hang together, and the short and badly read lines that they join
    left = set(range(placed))
    while left:
        mine, todo = {(first := left.pop())}, [first]
        while todo:
            for b in near[todo.pop()] - mine:
                mine.add(b)
                todo.append(b)
        left -= mine
        if len(mine) == 1 and not pieces[first][2]:
            continue
        marks, new, tried = bytearray(len(item)), [x for a in mine for x in pieces[a][0]], set()
        for a in mine:
            marks = either(marks, pieces[a][1])
        while new:
            side, own, at = new.pop()
            there = (line > own) & (line <= own + BETWEEN) & (abs(start - at) <= 2) if side > 0 else (line < own) & (line >= own - BETWEEN) & (abs(stop - 1 - at) <= 2)
            for k in np.flatnonzero(there).tolist():
                if k in tried:
                    continue
                tried.add(k)
                n, ends, got = lay(int(p[k]), int(q[k]), int(line[k]))
                if n >= min(PART * (end[k] - begin[k]), PLACED) and any(join((side, own, at), y, 2) for y in ends):
                    marks = either(marks, got)
                    new += ends
        runs.append(marks)
    n = int(word[-1]) + 1
    size = np.bincount(word, minlength=n)
    return [np.bincount(word, weights=np.frombuffer(x, np.uint8), minlength=n) * 3 >= size * 2 for x in runs]


def either(a: bytearray, b: bytearray) -> bytearray:
    return bytearray((int.from_bytes(a) | int.from_bytes(b)).to_bytes(len(a)))


def dense_runs(held: np.ndarray, gap: int = 2, density: float = DENSITY) -> list[tuple[int, int]]:
    """(first, last word) of the longest run in each part of an item: at most ``gap`` misread words between held ones, and ``density`` of all held."""
    at = np.flatnonzero(held)
    out = []
    for cut in np.split(at, np.flatnonzero(np.diff(at) > gap + 1) + 1) if len(at) else []:
        # the longest stretch of the cut that is dense enough; both ends are held words
        best, run = 0, (0, 0)
        for x in range(len(cut)):
            for y in range(len(cut) - 1, x - 1, -1):
                length = int(cut[y] - cut[x]) + 1
                if length <= best:
                    break
                if y - x + 1 >= density * length:
                    best, run = length, (int(cut[x]), int(cut[y]))
                    break
        out.append(run)
    return out


def longest_run(held: np.ndarray, gap: int = 2, density: float = DENSITY) -> int:
    """Words of the longest run of an item."""
    return max((last - first + 1 for first, last in dense_runs(held, gap, density)), default=0)


def printed_words(held: list[np.ndarray], least: int = RUN_WORDS) -> int:
    """Words that some passage holds, and the misread ones inside runs of ``least`` words."""
    printed = np.any(held, axis=0)
    for one in held:
        for first, last in dense_runs(one):
            if last - first + 1 >= least:
                printed[first : last + 1] = True
    return int(printed.sum())


def _probe(indexes: list[ItemIndex], run: int, share: float, opening: int):
    """Pages in groups of about ``LETTERS`` signs against some indexes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = batch.column("doc").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            size = np.cumsum([len(t) for t in texts])
            groups = np.split(np.arange(len(texts)), np.flatnonzero(np.diff(size // LETTERS)) + 1)
            out = []
            for group in groups:
                pages = Letters(*[texts[g] for g in group])
                for index in indexes:
                    for t, item, longest, held, words in index.leaks(pages):
                        if longest >= run and held >= share * (words + opening):
                            out.append((docs[group[t]], item, longest, held, words + opening))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "run", "held", "words"])

    return work


def common_opening(first: str | None, last: str | None) -> int:
    """Words of the first sentence, if the texts that come first and last in order (and so all between) begin with it."""
    if not first or not last or first == last:
        return 0
    words = first.split()
    n = next((k + 1 for k, w in enumerate(words) if w[-1] in ".!?"), 0)
    return n if words[:n] == last.split()[:n] else 0


def leaked_items(
    documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    run: int = RUN_WORDS, share: float = SHARE, block: int = ITEMS,
) -> DataFrame:
    """(doc_id, item_id, run, held, words): documents that hold ``run`` successive words of an item and ``share`` of its words.

    Every word start of a page opens a window of ``WINDOW`` letters, with all
    that is no letter left out, so that line breaks, hyphens and punctuation do
    not matter, and with signs that a scanner takes for each other made equal.
    Windows are embedded by CGK random walks and met with the items' windows
    by repeated sampling; candidates within ``EDITS`` edits are kept and
    followed along the line to both sides.  A page that two windows, or ``TIE``
    letters of a line that few items have, tie to an item has all its lines laid beside that item
    (see ``held_words``), so that narrow columns with foreign lines between
    count as well, and the words covered make up the runs.  ``held`` counts the
    misread words inside a run too.  Lines of other
    columns or adverts between do not break a run.

    The sentence with which all items open is left out of the search but
    counts among the words of an item.  Null or empty texts hold nothing, and
    items without a window are never found.  Items are indexed in blocks of
    ``block``; ``INDEXES`` blocks are one pass over the pages without a shuffle, in
    which the pages' windows are sketched once.
    """
    spark: SparkSession = documents.sparkSession
    own = items.where(F.col(item_text).isNotNull() & F.col(item).isNotNull()).select(F.col(item).alias("i"), F.col(item_text).alias("t"))
    n, first, last = own.agg(F.count(F.lit(1)), F.min("t"), F.max("t")).first()
    opening = common_opening(first, last)
    pages = documents.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, run long, held long, words long"
    found = spark.createDataFrame([], schema)
    blocks = -(-n // block)
    number = F.pmod(F.xxhash64("i"), F.lit(max(blocks, 1)))
    for b in range(0, blocks, INDEXES):
        some = own.withColumn("b", number).where((F.col("b") >= b) & (F.col("b") < b + INDEXES)).sort("b", "i").collect()
        indexes = [ItemIndex.of([(r.i, r.t) for r in rows], opening) for _, rows in itertools.groupby(some, lambda r: r.b)]
        found = found.unionByName(pages.mapInArrow(_probe(indexes, run, share, opening), schema))
    return found.distinct()
