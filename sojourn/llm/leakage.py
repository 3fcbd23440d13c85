"""Evaluation texts leaking into training text: q-gram lemma filter in diagonal bands, then banded alignment."""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Cyrillic and other letters that look like Latin ones, and letters without a decomposition.
LOOKALIKES = str.maketrans({
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "ν": "v", "ο": "o", "α": "a", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
})
# Beyond 200 characters a tag is told from a stray "<" by a comment's start or an attribute's value near its name.
_LONG = r"(?=[^<>\x00=]{0,100}=\s?[\"'\w/#.])[^<>\x00]*>"
_BLOCK_TAG = re.compile(rf"</?(?:br|p|div|li|ul|ol|td|tr|table|h[1-6])\b(?:[^<>\x00]{{0,200}}>|(?=\s){_LONG})", re.I)
_TAG = re.compile(rf"</?[a-zA-Z!][^<>\x00]{{0,200}}>|<!--[^<>\x00]*>|<[a-zA-Z][\w:-]*(?=\s){_LONG}")
_ALIKE = re.compile("[" + "".join(map(chr, LOOKALIKES)) + "]")
_HIDDEN = re.compile(r"[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\u0300-\u036f]+")
_WORD = re.compile(r"[^\W_]+")

Q = 8
#: Characters that are searched at once.
PIECE = 1_000_000


@dataclass(frozen=True)
class Bounds:
    """What counts as a leak: ``exact`` words in a row, or ``passage`` words with at most one in ``per_error`` wrong."""

    exact: int = 12
    passage: int = 20
    per_error: int = 8

    #: "About" one in ``per_error``: the share of wrong words may go this factor beyond it.
    about: float = 1.1

    @property
    def share(self) -> float:
        """Largest share of wrong words."""
        return self.about / self.per_error

    @property
    def most(self) -> int:
        """Wrong words in a passage of at most twice the shortest; of a longer one a half qualifies by itself."""
        return int(self.share * 2 * self.passage)

    def kinds(self) -> list[tuple[int, int, int]]:
        """``(words of the item, wrong ones among them, added ones)`` such that every passage holds a stretch of one kind.

        For each number of wrong words the shortest length that allows it; shorter stretches of the item where added
        words make up the length.
        """
        lengths = range(self.passage, 2 * self.passage + 1)
        out = [(next(n for n in lengths if int(self.share * n) >= e), e, 0) for e in range(int(self.share * self.passage), self.most + 1)]
        few = int(self.share * self.passage)
        return out + [(self.passage - k, few - k, k) for k in range(1, few + 1)]

    @property
    def apart(self) -> int:
        """Words of a passage in a row without a kept q-gram: wrong ones and short ones between them."""
        return (self.most + 1) * Q


def plain(texts: list[str]) -> list[str]:
    """Texts without markup, accents, case, hidden characters and look-alike letters; one pass over the whole batch."""
    big = "\x00".join(t.replace("\x00", " ") if t else "" for t in texts)
    if "&" in big:
        big = html.unescape(big)
    if "<" in big:
        big = _TAG.sub("", _BLOCK_TAG.sub(" ", big))
    big = _HIDDEN.sub("", unicodedata.normalize("NFKD", big))
    big = _HIDDEN.sub("", unicodedata.normalize("NFKD", big.casefold()))
    return _ALIKE.sub(lambda m: LOOKALIKES[ord(m[0])], big).split("\x00")


def _codes(squeezed: str) -> np.ndarray:
    """Six bits per character: letters and digits exactly, others by remainder."""
    raw = np.frombuffer(squeezed.encode("utf-32-le"), np.uint32).astype(np.uint64)
    out = raw % np.uint64(27) + np.uint64(36)
    digit, letter = (raw >= 48) & (raw <= 57), (raw >= 97) & (raw <= 122)
    out[digit] = raw[digit] - np.uint64(48)
    out[letter] = raw[letter] - np.uint64(87)
    return out


def _grams(codes: np.ndarray) -> np.ndarray:
    """All q-grams of a code array as integers."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(Q):
        out = (out << np.uint64(6)) | codes[k : k + n]
    return out


class Index:
    """q-grams of a block of items, what a region must keep of each item's windows, and the items' words."""

    def __init__(self, ids: list, texts: list[str], bounds: Bounds):
        self.ids, self.bounds = ids, bounds
        self.words = [_WORD.findall(t) for t in plain(texts)]
        self.strings = [["".join(w[k : k + bounds.exact]) for k in range(len(w) - bounds.exact + 1)] for w in self.words]
        grams, owner, place, self.windows = [], [], [], []
        longest = 1
        for i, words in enumerate(self.words):
            g = _grams(_codes("".join(words)))
            grams.append(g)
            owner.append(np.full(len(g), i, np.int64))
            place.append(np.arange(len(g), dtype=np.int64))
            self.windows.append(self._windows(words))
            longest = max([longest, *map(len, words)])
        self.least = np.array([max(1, int(w[2].min())) if len(w[2]) else np.iinfo(np.int32).max for w in self.windows], np.int64)
        # A wrong word shifts the diagonal by its length; places between hits further apart than ``gap`` are taken as
        # ``gap``, so that an added word of any length shifts it by no more.
        self.gap = longest + 2 * Q
        self.shift = bounds.most * self.gap
        grams, owner, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (grams, owner, place))
        order = np.argsort(grams, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.gram, first = np.unique(grams[order], return_index=True)
        self.first = np.append(first, len(order)).astype(np.int64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self._slot(self.gram)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def _windows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """q-gram lemma: first and last place of each window of ``exact`` or ``passage`` words and the fewest grams that
        it keeps: all of an exact run, or what the most wrong words leave of a passage."""
        b, size = self.bounds, np.array([len(w) for w in words])
        ends = np.cumsum(np.append(0, size))
        out = []
        for length, wrong, added in ((b.exact, 0, 0), *b.kinds()):
            for k in range(len(words) - length + 1):
                part = size[k : k + length]
                lost = np.sort(part)[::-1][:wrong].sum() + (wrong + added) * (Q - 1)
                out.append((ends[k], ends[k + length] - Q, part.sum() - Q + 1 - lost))
        return tuple(np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    def candidates(self, words: list[list[str]]) -> list[tuple[int, int, int, int]]:
        """``(text, item, first and last word of the region)`` of each diagonal band that keeps enough grams."""
        if not len(self.gram) or not words:
            return []
        squeezed = ["".join(w) for w in words]
        starts = np.cumsum([0, *[len(s) + Q for s in squeezed]])
        # Q filler characters apart, no gram of two texts is one of an item: filler is a code that no item has.
        codes = np.concatenate([np.append(_codes(s), np.full(Q, 63, np.uint64)) for s in squeezed])
        grams = _grams(codes)
        at = np.flatnonzero(self.seen[self._slot(grams)])
        slot = np.minimum(np.searchsorted(self.gram, grams[at]), len(self.gram) - 1)
        same = self.gram[slot] == grams[at]
        at, slot = at[same], slot[same]
        if not len(at):
            return []
        # Word of each hit: words' ends in the joined texts.
        of_text = np.array([len(w) for w in words])
        ends = np.cumsum([len(w) for ws in words for w in ws]) + Q * np.repeat(np.arange(len(words)), of_text)
        word_at = np.searchsorted(ends, at, side="right")
        count = self.first[slot + 1] - self.first[slot]
        where = np.repeat(self.first[slot] + count - np.cumsum(count), count) + np.arange(count.sum())
        at, word = np.repeat(at, count), np.repeat(word_at, count)
        item, place = self.owner[where], self.place[where]
        text = np.searchsorted(starts, at, side="right") - 1
        order = np.lexsort((place, at, item, text))
        at, word, item, place, text = at[order], word[order], item[order], place[order], text[order]
        # Runs of an item's hits without a stretch that no passage can hold; within them long gaps count as ``gap``.
        same = (item[1:] == item[:-1]) & (text[1:] == text[:-1])
        run = np.cumsum(np.append(True, ~same | (np.diff(word) > self.bounds.apart))) - 1
        along = np.cumsum(np.append(0, np.where(same, np.minimum(np.diff(at), self.gap), 0)))
        # Each diagonal lies in two bands of twice the shift, so that one band holds a whole passage.
        band = (along - place + (1 << 40)) // self.shift
        run2, band2, place2, row2 = np.tile(run, 2), np.concatenate([band, band - 1]), np.tile(place, 2), np.tile(np.arange(len(run)), 2)
        order = np.lexsort((place2, band2, run2))
        run2, band2, place2, row2 = run2[order], band2[order], place2[order], row2[order]
        new = np.append(True, (run2[1:] != run2[:-1]) | (band2[1:] != band2[:-1]))
        fresh = new | np.append(True, place2[1:] != place2[:-1])  # an item's gram counts once in a band
        head = np.flatnonzero(new)
        kept = np.add.reduceat(fresh.astype(np.int64), head)
        tail = np.append(head[1:], len(new))
        first_word = np.cumsum(of_text) - of_text
        out = []
        for k in np.flatnonzero(kept >= self.least[item[row2[head]]]):
            rows = slice(head[k], tail[k])
            t, i = int(text[row2[head[k]]]), int(item[row2[head[k]]])
            places = place2[rows][fresh[rows]]
            a, z, need = self.windows[i]
            if (np.searchsorted(places, z, side="right") - np.searchsorted(places, a) >= np.maximum(need, 1)).any():
                hit = word[row2[rows]] - first_word[t]
                out.append((t, i, int(hit.min()), int(hit.max())))
        return out

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """``(text, item)`` pairs of a batch of raw texts."""
        return sorted({hit for piece in pieces(texts, self.overlap) for hit in self.search(piece)})

    @property
    def overlap(self) -> int:
        """Words that the pieces of a long text share: more than a passage has, with what lies around it."""
        return 2 * (max(map(len, self.words), default=0) + self.bounds.apart)

    def search(self, piece: list[tuple[int, list[str]]]) -> set[tuple[int, int]]:
        """``(text, item)`` of what the texts (or parts of them) in ``piece`` hold."""
        out: set[tuple[int, int]] = set()
        for k, i, a, z in self.candidates([w for _, w in piece]):
            t, words = piece[k]
            if (t, i) not in out and self._holds(i, words[max(0, a - self.bounds.apart) : z + Q + self.bounds.apart]):
                out.add((t, i))
        return out

    def _holds(self, i: int, region: list[str]) -> bool:
        item, joined, b = self.words[i], "".join(region), self.bounds
        if any(run in joined for run in self.strings[i]):
            return True
        return best_share(item, _respaced(region, item), b) <= b.share


def pieces(texts: list[str | None], overlap: int) -> Iterator[list[tuple[int, list[str]]]]:
    """``(text, words)`` in portions of about ``PIECE`` characters; a longer text comes in parts that share ``overlap`` words."""
    held: list[tuple[int, list[str]]] = []
    k = 0
    while k < len(texts):
        end, size = k, 0
        while end < len(texts) and (end == k or size + len(texts[end] or "") < PIECE):
            size += len(texts[end] or "")
            end += 1
        for t, clean in enumerate(plain([x or "" for x in texts[k:end]]), k):
            words = _WORD.findall(clean)
            step = max(1, PIECE // 8)
            if len(words) > step + overlap and size > PIECE:
                for a in range(0, len(words), step):
                    yield [(t, words[a : a + step + overlap])]
            else:
                held.append((t, words))
        if held:
            yield held
        held, k = [], end


def _respaced(region: list[str], item: list[str]) -> list[str]:
    """``region`` with words that only spacing tells from words of the item put together or taken apart."""
    words = set(item)
    pairs = {a + b: (a, b) for a, b in zip(item, item[1:], strict=False)}
    out, k = [], 0
    while k < len(region):
        for size in (3, 2):
            if k + size <= len(region) and "".join(region[k : k + size]) in words and not all(w in words for w in region[k : k + size]):
                out.append("".join(region[k : k + size]))
                k += size
                break
        else:
            out += [region[k]] if region[k] in words else pairs.get(region[k], [region[k]])
            k += 1
    return out


def best_share(item: list[str], region: list[str], b: Bounds) -> float:
    """Smallest share of wrong words of any passage of ``item`` that ``region`` holds, by banded alignment; 1.0 if none.

    A passage is as long as the longer of its two sides, ``b.passage`` words at least; wrong are words altered, dropped
    or added. Bands are diagonals of the word matrix with enough equal words for a passage, twice as wide as its wrong
    words can shift it and overlapping by half; within a band each start in the item has its own row of costs, so the
    result is the best of all starts and ends there, not that of one best alignment.
    """
    codes: dict[str, int] = {}
    x = np.array([codes.setdefault(w, len(codes)) for w in item], np.int64)
    y = np.array([codes.get(w, -1) for w in region], np.int64)
    there = np.zeros(len(codes) + 1, bool)
    there[y] = True
    there[-1] = False
    if not len(_starts(there[x], b)):
        return 1.0
    rows, columns = np.nonzero(x[:, None] == y[None, :])
    step = b.most + 1
    diagonal = columns - rows + len(x)
    best = 1.0
    for first in np.unique(np.concatenate([diagonal // step, diagonal // step - 1])) * step:
        equal = np.zeros(len(x), bool)
        equal[rows[(diagonal >= first) & (diagonal < first + 2 * step)]] = True
        starts = _starts(equal, b)
        if len(starts):
            best = min(best, _banded(x, y, int(first) - len(x), 2 * step, starts, b))
            if best <= b.share:
                return best
    return best


def _starts(equal: np.ndarray, b: Bounds) -> np.ndarray:
    """Places of an item from which a passage may start, ``equal`` telling which of its words have an equal one."""
    have = np.cumsum(np.append(0, equal))
    good = np.zeros(len(equal) + 1, bool)
    for length in range(b.passage - int(b.share * b.passage), 2 * b.passage + 1):
        if length <= len(equal):
            # Of a passage of fewer words of the item the others are added, and added words are wrong ones.
            wrong = int(b.share * length) if length >= b.passage else int(b.share * b.passage) - (b.passage - length)
            good[: len(have) - length] |= have[length:] - have[:-length] >= length - wrong
    return np.flatnonzero(good)


def _banded(x: np.ndarray, y: np.ndarray, low: int, width: int, starts: np.ndarray, b: Bounds) -> float:
    """:func:`best_share` within the diagonals ``low`` to ``low + width - 1`` and for these starts in the item.

    A cost is 256 for each wrong word, less the words by which the region's side is longer: of equally many wrong words
    the longer side is the better one.
    """
    n, m, far = len(x), len(y), 1 << 24
    short, long = b.passage - int(b.share * b.passage), 2 * b.passage
    used = np.arange(low, low + n + width + 1)  # words of the region before the next one, by row + column
    word = np.full(len(used), -2, np.int64)
    word[(used >= 0) & (used < m)] = y[used[(used >= 0) & (used < m)]]
    bar = np.where((used >= 0) & (used <= m), 0, far)
    step = np.where((used >= 0) & (used < m), 0, far)
    ramp = 255 * np.arange(width)
    cost = np.full((len(starts), width), far, np.int64)
    best = 1.0
    for r in range(int(starts[0]), min(n, int(starts[-1]) + long)):
        cost[starts == r] = bar[r : r + width]
        after = cost + (np.where(word[r : r + width] == x[r], 0, 256) + step[r : r + width])
        np.minimum(after[:, :-1], cost[:, 1:] + 257, out=after[:, :-1])
        cost = np.minimum.accumulate(after - ramp, axis=1) + (ramp + bar[r + 1 : r + 1 + width])
        ours = r + 1 - starts
        live = (ours >= short) & (ours <= long)
        if live.any():
            value = cost[live].min(1)
            errors = (value + 128) // 256
            length = np.maximum(ours[live], ours[live] + errors * 256 - value)
            fits = (length >= b.passage) & (value < far // 2)
            if fits.any():
                best = min(best, float((errors[fits] / length[fits]).min()))
    return best


def leaking_items(documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", bounds: Bounds = Bounds(), block_chars: int = 2_000_000) -> DataFrame:
    """``(doc, item)``: documents that hold ``exact`` words of an item in a row or a close passage of it.

    Case, accents, markup, entities, hidden and look-alike characters and spacing don't matter; words of the item must
    be whole. Null or empty texts hold nothing; items of fewer than ``exact`` words can't be reported; documents of
    equal text are reported one by one. Rows of equal ids give one row.

    The items are the stated query set. They are indexed in blocks of at most ``block_chars`` characters (one item at
    least): the driver holds one block at a time, each is broadcast, and a task holds one at a time too. Documents are
    read, cleaned and split into words once, whatever the number of blocks; they are neither shuffled nor cut.
    """
    spark, kind = documents.sparkSession, items.schema[item].dataType.simpleString()
    shared, overlap = [], 0

    def add(block: list[tuple]) -> None:
        nonlocal overlap
        index = Index([i for i, _ in block], [t for _, t in block], bounds)
        overlap = max(overlap, index.overlap)
        shared.append(spark.sparkContext.broadcast(index))

    held, size = [], 0
    for row in items.select(item, item_text).filter(F.col(item_text).isNotNull()).toLocalIterator():
        if held and size + len(row[1]) > block_chars:
            add(held)
            held, size = [], 0
        held.append((row[0], row[1]))
        size += len(row[1])
    add(held)
    schema = f"{doc} {documents.schema[doc].dataType.simpleString()}, {item} {kind}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, hits = batch[doc].tolist(), set()
            ready = list(pieces(batch[text].tolist(), overlap)) if len(shared) > 1 else pieces(batch[text].tolist(), overlap)
            for block in shared:
                index = block.value
                hits |= {(t, index.ids[i]) for piece in ready for t, i in index.search(piece)}
                if len(shared) > 1:
                    vars(block).pop("_value", None)  # the next batch reads it again from the worker's disk
            hits = sorted(hits, key=lambda h: h[0])
            yield pd.DataFrame({doc: [ids[t] for t, _ in hits], item: [i for _, i in hits]})

    return documents.select(doc, text).filter(F.col(text).isNotNull()).mapInPandas(run, schema).distinct()
