"""Elias-Fano sequences and an n-gram trie of compact levels in one memory-mappable image."""

from __future__ import annotations

import struct

import numpy as np

#: Ones of the high part between entries of its select directory.
SELECT = 64
_ONE = np.uint64(1)


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words, with one more of zeros."""
    packed = np.packbits(bits, bitorder="little")
    return np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, dtype=np.uint8)]).view("<u8")


class Sequence:
    """A monotone sequence of nonnegative integers: low bits packed, high parts in unary with a select directory."""

    @staticmethod
    def encode(x: np.ndarray) -> bytes:
        x = np.asarray(x, dtype=np.uint64)
        n = len(x)
        top = int(x[-1]) + 1 if n else 1
        low = max(0, (top // max(1, n)).bit_length() - 1)
        lows = ((x[:, None] >> np.arange(low, dtype=np.uint64)) & _ONE).astype(np.uint8) if low else np.zeros((n, 0), np.uint8)
        places = (x >> np.uint64(low)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, dtype=np.uint8)
        high[places] = 1
        words = _words(high)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype("<u4")
        parts = [_words(lows.ravel()).tobytes(), words.tobytes(), ranks.tobytes(), (places[::SELECT] >> 6).astype("<u4").tobytes()]
        parts = [p + bytes(-len(p) % 8) for p in parts]
        return struct.pack("<QQQQQQ", n, low, *map(len, parts)) + b"".join(parts)

    def __init__(self, image, at: int = 0):
        self.n, self.low, *sizes = struct.unpack_from("<QQQQQQ", image, at)
        at += 48
        views = []
        for size, kind in zip(sizes, ("<u8", "<u8", "<u4", "<u4"), strict=True):
            views.append(np.frombuffer(image, kind, size // int(kind[2]), at))
            at += size
        self.lows, self.high, self.ranks, self.select = views
        self.end = at
        self.top = int(self.get(np.array([self.n - 1]))[0]) >> self.low if self.n else 0

    @staticmethod
    def _nth(x: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place of the k-th one of each word."""
        place = np.zeros(len(x), dtype=np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            part = x & ((_ONE << np.uint64(width)) - _ONE)
            ones = np.bitwise_count(part)
            on = k >= ones
            k = k - ones * on
            x = np.where(on, x >> np.uint64(width), part)
            place += width * on
        return place

    def _low(self, i: np.ndarray) -> np.ndarray:
        """Low bits of the elements at the given places."""
        if not self.low:
            return np.zeros(len(i), dtype=np.uint64)
        bit = i * self.low
        at, skip = bit >> 6, (bit & 63).astype(np.uint64)
        more = (self.lows[at + 1] << _ONE) << (np.uint64(63) - skip)
        return ((self.lows[at] >> skip) | more) & ((_ONE << np.uint64(self.low)) - _ONE)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The elements at the given places: each from the select directory on, then its low bits; no other is decoded."""
        i = np.asarray(i, dtype=np.int64)
        word = self.select[i // SELECT].astype(np.int64)
        while True:
            late = np.flatnonzero(self.ranks[word + 1] <= i)
            if not len(late):
                break
            word[late] += 1
        place = (word << 6) + self._nth(self.high[word], i - self.ranks[word])
        return (place - i).astype(np.uint64) << np.uint64(self.low) | self._low(i)

    def _from(self, h: np.ndarray) -> np.ndarray:
        """The first place whose element's high part is at least h: the ones before the zero that ends the part before."""
        out = np.full(len(h), self.n, dtype=np.int64)
        out[h == 0] = 0
        zeros = (np.arange(len(self.high), dtype=np.int64) << 6) - self.ranks[: len(self.high)]
        ask = np.flatnonzero((h > 0) & (h <= self.top))
        k = h[ask].astype(np.int64) - 1
        word = np.searchsorted(zeros, k, "right") - 1
        place = (word << 6) + self._nth(~self.high[word], k - zeros[word])
        out[ask] = place - k
        return out

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each x the first place in [lo, hi) whose element is at least x, or hi.

        The unary part leads to the elements of x's high part, few on average; their low bits are searched.
        """
        x = np.asarray(x, dtype=np.uint64)
        lo, hi = (np.broadcast_to(np.asarray(b, dtype=np.int64), x.shape) for b in (lo, hi))
        if not self.n or not len(x):
            return lo.copy()
        high, low = x >> np.uint64(self.low), x & ((_ONE << np.uint64(self.low)) - _ONE)
        a, b = np.clip(self._from(high), lo, np.maximum(lo, hi)), np.clip(self._from(high + _ONE), lo, np.maximum(lo, hi))
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            less = self._low(mid) < low[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
            open_ = open_[a[open_] < b[open_]]
        return a

    def find(self, x: np.ndarray, lo, hi) -> np.ndarray:
        """The place of each x in [lo, hi), or -1."""
        at = self.successor(x, lo, hi)
        ok = np.flatnonzero(at < np.broadcast_to(np.asarray(hi), at.shape))
        out = np.full(len(at), -1, dtype=np.int64)
        out[ok] = np.where(self.get(at[ok]) == np.asarray(x, dtype=np.uint64)[ok], at[ok], -1)
        return out


#: Logarithms (base 10) of probabilities are held in 256 steps from here to 0.
FLOOR = -12.75


def quantise(logp: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(logp / FLOOR * 255), 0, 255).astype(np.uint8)


def dequantise(codes: np.ndarray) -> np.ndarray:
    return codes * (FLOOR / 255)


class Trie:
    """Contexts, their successors, and the quantised smoothed probability of each.

    Levels: contexts (monotone), with a byte each for the weight of the lower order; pointers to each one's successors
    (monotone); the words that occur as successors (monotone); the successors by their rank among those, each context's
    raised by what comes before it, so that the whole level is monotone and a context's own part is searched relative to it,
    with a byte of probability each.
    """

    @staticmethod
    def build(contexts: np.ndarray, backoff: np.ndarray, vocabulary: np.ndarray, context: np.ndarray, word: np.ndarray, logp: np.ndarray) -> bytes:
        """Image of pairs (places of context and word in the sorted distinct `contexts` and `vocabulary`), sorted and distinct."""
        pointers = np.searchsorted(context, np.arange(len(contexts) + 1))
        raised = word.astype(np.uint64) + context.astype(np.uint64) * np.uint64(max(1, len(vocabulary)))
        return b"".join([*map(Sequence.encode, (contexts, pointers, vocabulary, raised)), quantise(backoff).tobytes(), quantise(logp).tobytes()])

    def __init__(self, image):
        self.contexts = Sequence(image)
        self.pointers = Sequence(image, self.contexts.end)
        self.vocabulary = Sequence(image, self.pointers.end)
        self.raised = Sequence(image, self.vocabulary.end)
        self.backoff = np.frombuffer(image, np.uint8, self.contexts.n, self.raised.end)
        self.codes = np.frombuffer(image, np.uint8, self.raised.n, self.raised.end + self.contexts.n)

    def log_p(self, contexts: np.ndarray, context: np.ndarray, words: np.ndarray, word: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """The model's log10 p(word | context) of pairs, by places in `contexts` and `words`; `lower`: that of each of `words` alone.

        Each context and word is found once; a pair by a successor search within its context's part alone. A pair that is
        not held has the context's weight times the lower order, one of an unknown context the lower order itself.
        """
        c, r = self.contexts.find(contexts, 0, self.contexts.n), self.vocabulary.find(words, 0, self.vocabulary.n)
        known = np.flatnonzero(c >= 0)
        lo, hi, back = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64), np.zeros(len(c))
        lo[known], hi[known] = self.pointers.get(c[known]).astype(np.int64), self.pointers.get(c[known] + 1).astype(np.int64)
        back[known] = dequantise(self.backoff[c[known]])
        out = back[context] + lower[word]
        ask = np.flatnonzero((c[context] >= 0) & (r[word] >= 0))
        x, y = context[ask], word[ask]
        at = self.raised.find(r[y].astype(np.uint64) + c[x].astype(np.uint64) * np.uint64(max(1, self.vocabulary.n)), lo[x], hi[x])
        held = at >= 0
        out[ask[held]] = dequantise(self.codes[at[held]])
        return out
