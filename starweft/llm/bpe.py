"""Byte-level BPE as a streaming transducer, and the decoder that reverses it.

A greedy merge order has this property: a token sequence is the encoding of its bytes exactly if every two neighbouring
tokens are the encoding of their joint bytes. So the encoding of each prefix follows from those of shorter prefixes: its last
token t is the one that ends there and may follow the last token of the prefix before t. The transducer keeps that last token
per byte position. A token still to come begins before the current end only if the merge list builds it and if it is longer
than the bytes between; the sufficient lookahead is therefore the length of the longest token that the merges can build, less
one (it is also needed: a proper prefix of that token is encoded otherwise than with its last byte). Once the chains of last
tokens from all positions within it meet in one earlier position, everything up to there is stable and is emitted; state is
kept for the bytes after it only.

The pattern that cuts text into words before the merges never joins the two sides of a single blank between visible
characters, so text is taken in such segments, and a segment seen before is looked up. The last segment is held back until
its end is known; within a longer one the last two words are held back, since only those can still change, and an open run
(letters without a break, say) goes to the transducer all but its last character.
"""

from __future__ import annotations

import base64
import gc
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property

import ahocorasick
import regex

#: The public pattern that splits text before the merges. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A blank between visible characters. `re` counts a few more characters as blank than the pattern does, which cuts less.
SEGMENT = re.compile(r"(?<=\S) (?=\S)")
MEMO_WORDS = 150_000
MEMO_SEGMENTS = 150_000
MEMO_CHARS = 64
OPEN_CHARS = 2048
SETTLE_BYTES = 512


class Vocabulary:
    """Ranks of a byte-level BPE, from lines of base64 token and rank. `built` is what the merges can build, if that
    is known already."""

    def __init__(self, lines: bytes, pattern: str = PATTERN, built: dict[int, tuple[int, ...]] | None = None):
        self.rank = {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines.splitlines() if x.strip())}
        self.token = {r: t for t, r in self.rank.items()}
        # each token that merges lead to, with the two parts of its last merge; others never come out
        self.built = self._built() if built is None else built
        self.lookahead = max((len(self.token[r]) for r in self.built), default=1) - 1
        self.words = regex.compile(pattern)
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, list[int]] = {}
        self.segments: dict[str, list[int]] = {}
        self.cuts: dict[str, tuple] = {}

    @cached_property
    def automaton(self):
        a = ahocorasick.Automaton()
        for r in self.built:
            t = self.token[r]
            a.add_word(t.decode("latin-1"), (len(t), r))
        a.make_automaton()
        return a

    def merged(self, data: bytes, down_to: int = 1) -> list[int]:
        """Plain merging of a few bytes, lowest rank first, until so many parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > down_to:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.rank[p] for p in parts]

    def _built(self) -> dict[int, tuple[int, ...]]:
        halves = ((r, self.merged(t, 2)) for t, r in self.rank.items())
        return {r: tuple(h) if len(h) == 2 else () for r, h in halves if len(h) <= 2}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether a and b are what their joint bytes merge to: whether no merge across the border comes before those that
        build the parts beside it. The parts are followed back in time, the one that was built last first."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            x, y, end_x, end_y, known = a, b, 1 << 60, 1 << 60, True
            token, built = self.token, self.built
            while True:
                across = self.rank.get(token[x] + token[y])
                if across is not None and across < end_x and across <= end_y:
                    known = False
                    break
                left, right = built[x], built[y]
                if right and (y >= x or not left):
                    end_y, y = y, right[0]
                elif left:
                    end_x, x = x, left[1]
                else:
                    break
            self.fits[a, b] = known
        return known

    def word(self, w: str) -> list[int]:
        """Token ids of one word of the pattern."""
        ids = self.memo.get(w)
        if ids is None:
            raw = w.encode("utf-8", "surrogatepass")
            one = self.rank.get(raw)
            if one is not None and one in self.built:
                ids = [one]
            else:
                ids = Transducer.of_word(self, raw)
            if len(w) <= MEMO_CHARS:
                if len(self.memo) >= MEMO_WORDS:
                    self.memo.clear()
                self.memo[w] = ids
        return ids

    def segment(self, s: str) -> list[int]:
        """Token ids of a blank and the segment that follows it."""
        ids = self.segments.get(s)
        if ids is None:
            ids = self.run(" " + s)
            if len(s) <= MEMO_CHARS:
                if len(self.segments) >= MEMO_SEGMENTS:
                    self.segments.clear()
                self.segments[s] = ids
        return ids

    def run(self, text: str) -> list[int]:
        """Token ids of a text, word by word."""
        out: list[int] = []
        get, word, more = self.memo.get, self.word, out.extend
        for w in self.words.findall(text):
            more(get(w) or word(w))
        return out


class Transducer:
    """Bytes of one word in, stable token ids out."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.tail = ""  # bytes after the emitted tokens, as latin-1
        self.last: list[int] = []  # token that ends after byte i of the tail, in the encoding of that prefix
        self.before: int | None = None  # the last token emitted

    @classmethod
    def of_word(cls, v: Vocabulary, data: bytes) -> list[int]:
        """Token ids of a whole word. One within the lookahead has nothing stable before its end, so no state is kept."""
        if len(data) > v.lookahead:
            t = cls(v)
            return t.feed(data) + t.finish()
        last = [-1] * len(data)
        fits, may_follow = v.fits.get, v.may_follow
        for end, (size, token) in v.automaton.iter(data.decode("latin-1")):
            if last[end] < 0:
                if size > end:
                    last[end] = token
                else:
                    left = last[end - size]
                    if left >= 0:
                        ok = fits((left, token))
                        if ok or (ok is None and may_follow(left, token)):
                            last[end] = token
        out, end, token = [], len(data), v.token
        while end:
            out.append(last[end - 1])
            end -= len(token[out[-1]])
        out.reverse()
        return out

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), SETTLE_BYTES):
            self._take(data[at : at + SETTLE_BYTES].decode("latin-1"))
            if len(self.tail) > self.v.lookahead + SETTLE_BYTES // 2:
                out += self._settle()
        return out

    def _take(self, piece: str) -> None:
        v, last, before = self.v, self.last, self.before
        fits, may_follow = v.fits.get, v.may_follow
        old = len(last)
        self.tail += piece
        last.extend([-1] * len(piece))
        skip = max(0, old - v.lookahead)  # matches that end in the new part begin after this
        for end, (size, token) in v.automaton.iter(self.tail, skip):
            if end < old or last[end] >= 0:
                continue
            start = end - size
            if start < -1:
                continue
            left = last[start] if start >= 0 else before
            if left is None:
                last[end] = token
            elif left >= 0:
                ok = fits((left, token))
                if ok or (ok is None and may_follow(left, token)):
                    last[end] = token

    def _chain(self, end: int) -> list[int]:
        out = []
        while end > 0:
            t = self.last[end - 1]
            out.append(t)
            end -= len(self.v.token[t])
        return out[::-1]

    def _settle(self) -> list[int]:
        """Emit the tokens that all positions a later token may begin at have in common."""
        n = len(self.last)
        live = set(range(max(0, n - self.v.lookahead), n + 1))
        while len(live) > 1:  # the farthest position steps back to where its last token begins
            far = max(live)
            live.remove(far)
            live.add(far - len(self.v.token[self.last[far - 1]]))
        stable = live.pop()
        out = self._chain(stable)
        if out:
            self.before = out[-1]
            self.tail, self.last = self.tail[stable:], self.last[stable:]
        return out

    def finish(self) -> list[int]:
        out = self._chain(len(self.last))
        self.tail, self.last, self.before = "", [], None
        return out


class StreamingEncoder:
    """Pieces of a text in, stable token ids out, special tokens' strings being ordinary text; memory is bounded by the pieces
    and by the open segment's last characters."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.held, self.open = vocabulary, "", None

    def feed(self, piece: str) -> list[int]:
        out: list[int] = []
        self.held += piece
        if self.open is not None:
            out += self._go_on(False)
            if self.open is not None:
                return out
        first, *more = SEGMENT.split(self.held)
        if more:  # all segments but the last are followed by a blank and a visible character
            out += self.v.run(first)
            get, segment, add = self.v.segments.get, self.v.segment, out.extend
            self.held = " " + more.pop()
            for s in more:
                add(get(s) or segment(s))
        if len(self.held) > OPEN_CHARS:
            out += self._within()
        return out

    def _within(self) -> list[int]:
        """Words of a long segment, up to a run that is still open."""
        out: list[int] = []
        spans = [m.span() for m in self.v.words.finditer(self.held)]
        for a, b in spans[:-2]:
            out += self.v.word(self.held[a:b])
        if len(spans) > 2:
            self.held = self.held[spans[-3][1] :]
        if len(self.held) > OPEN_CHARS:
            spans = [m.span() for m in self.v.words.finditer(self.held)]
            for a, b in spans[:-1]:
                out += self.v.word(self.held[a:b])
            self.held = self.held[spans[-1][0] :] if spans else self.held
            if len(self.held) > OPEN_CHARS // 2:
                self.open = (Transducer(self.v), self._run_of(self.held[-1]))
                out += self._go_on(False)
        return out

    @staticmethod
    def _run_of(c: str) -> regex.Pattern:
        for p in (r"\p{L}*", r"\p{N}*", r"\s*"):
            if regex.fullmatch(p, c):
                return regex.compile(p)
        return regex.compile(r"[^\s\p{L}\p{N}]*")

    def _go_on(self, last: bool) -> list[int]:
        """Give the open run all but its last character; close it where another kind of character follows."""
        t, run = self.open
        lead = 1 if self.held[:1] == " " and run.pattern != r"\s*" else 0
        end = run.match(self.held, lead).end()
        if end == len(self.held) and not last:
            if end <= 1:
                return []
            data, self.held = self.held[: end - 1], self.held[end - 1 :]
            return t.feed(data.encode("utf-8", "surrogatepass"))
        if run.pattern == r"\s*" and end < len(self.held) and end > 0:
            end -= 1  # the last blank before a word belongs to what follows
        out = t.feed(self.held[:end].encode("utf-8", "surrogatepass")) + t.finish()
        self.held, self.open = self.held[end:], None
        return out

    def finish(self) -> list[int]:
        out: list[int] = []
        if self.open is not None:
            out += self._go_on(True)
        out += self.v.run(self.held)
        self.held = ""
        return out


class Decoder:
    """Token ids in, text out, as far as its bytes are complete: a state machine over UTF-8 whose state is the bytes of the
    open character. Bytes that cannot be part of any character become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.open = vocabulary, b""

    @staticmethod
    def _need(lead: int) -> int:
        return 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0

    def feed(self, ids: list[int]) -> str:
        data = self.open + b"".join([self.v.token[i] for i in ids])
        cut = len(data)
        for back in range(1, min(4, len(data) + 1)):
            lead = data[-back]
            if lead & 0xC0 != 0x80:
                if self._need(lead) > back:
                    cut -= back
                break
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.open = self.open.decode("utf-8", "replace"), b""
        return rest


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the cycle collector, which would go over the memos again and again; nothing here makes cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


_LOADED: dict[int, Vocabulary] = {}


def loaded(lines: bytes, built: dict[int, tuple[int, ...]] | None = None) -> Vocabulary:
    """The vocabulary of these lines, made once per Python process."""
    key = hash(lines)
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(lines, built=built)
    return _LOADED[key]
