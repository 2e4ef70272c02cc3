"""Redaction of a text by many findings in one pass, with the outcome of one after the other.

The rule is sequential: each finding replaces the first occurrence of what it looks for in the text as those
before left it, so an occurrence may be gone by then, or lie in or across an earlier replacement. Instead of
rebuilding the text each time, all needles are found in it at once, replacements are pieces over intervals of
the original, and a new piece is searched with its surroundings for needles that touch it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from heapq import heappop, heappush

#: Occurrences of a needle that are noted beyond as many as there are findings of it; the next are looked up when they are needed.
SPARE = 8


class _Text:
    """A text with pieces: replaced intervals of the original and what stands in their place."""

    def __init__(self, text: str):
        self.text, self.starts = text, []
        self.pieces: dict[int, tuple[int, str, int]] = {}  # start: end, string, version
        self.versions = 0

    def touched(self, a: int, b: int) -> bool:
        """Whether a piece lies over part of the original's interval."""
        k = bisect_left(self.starts, b) - 1
        return k >= 0 and self.pieces[self.starts[k]][0] > a

    def before(self, at: int, n: int) -> str:
        """The last ``n`` characters, or what there is, before the piece at ``at``, as the text stands now."""
        out, k = [], bisect_left(self.starts, at) - 1
        while n > 0 and at > 0:
            end = self.pieces[self.starts[k]][0] if k >= 0 else 0
            own = self.text[max(end, at - n) : at]
            out.append(own)
            n -= len(own)
            at = end
            if n > 0 and k >= 0:
                string = self.pieces[self.starts[k]][1]
                own = string[max(0, len(string) - n) :]
                out.append(own)
                n -= len(own)
                at, k = self.starts[k], k - 1
        return "".join(reversed(out))

    def after(self, at: int, n: int) -> str:
        """The first ``n`` characters, or what there is, from the original's place ``at`` on."""
        out, k = [], bisect_left(self.starts, at)
        while n > 0 and (at < len(self.text) or k < len(self.starts)):
            start = self.starts[k] if k < len(self.starts) else len(self.text)
            own = self.text[at : min(start, at + n)]
            out.append(own)
            n -= len(own)
            if n > 0 and k < len(self.starts):
                end, string, _ = self.pieces[start]
                out.append(string[:n])
                n -= len(string)
                start = end
                k += 1
            at = start
        return "".join(out)

    def put(self, a: int, b: int, string: str) -> int:
        """A piece over the interval, with what stood over parts of it gone."""
        lo, hi = bisect_left(self.starts, a), bisect_left(self.starts, b)
        if lo < len(self.starts) and self.starts[lo] == a:
            hi = max(hi, lo + 1)
        for s in self.starts[lo:hi]:
            del self.pieces[s]
        del self.starts[lo:hi]
        insort(self.starts, a)
        self.versions += 1
        self.pieces[a] = (b, string, self.versions)
        return a

    def span(self, at: int, offset: int, n: int) -> tuple[int, int, str, str]:
        """Of ``n`` characters from ``offset`` on, counted from the start of the piece at ``at``: the interval of whole pieces and original
        characters over which they lie, and what of its pieces stands before and behind them."""
        a, head = at, ""
        if offset >= 0:
            head = self.pieces[at][1][:offset]
        else:
            left, k = -offset, bisect_left(self.starts, at) - 1
            while left > 0:
                end = self.pieces[self.starts[k]][0] if k >= 0 else 0
                own = min(left, a - end)
                a, left = a - own, left - own
                if left > 0:
                    string = self.pieces[self.starts[k]][1]
                    a, own = self.starts[k], min(left, len(string))
                    head, left, k = string[: len(string) - own], left - own, k - 1
        b, right, k = at, offset + n, bisect_left(self.starts, at)
        tail = ""
        while right > 0:
            if k < len(self.starts) and self.starts[k] == b:
                end, string, _ = self.pieces[b]
                own = min(right, len(string))
                tail, right, b, k = string[own:], right - own, end, k + 1
            else:
                start = self.starts[k] if k < len(self.starts) else len(self.text)
                own = min(right, start - b)
                tail, right, b = "", right - own, b + own
        return a, b, head, tail

    def whole(self) -> str:
        out, at = [], 0
        for s in self.starts:
            end, string, _ = self.pieces[s]
            out += [self.text[at:s], string]
            at = end
        return "".join([*out, self.text[at:]])


def redact(text: str, steps: list[tuple[str, str]]) -> tuple[str, int]:
    """The text after all (needle, token) steps, each replacing its needle's first occurrence, and how many found one. Empty needles find none.

    Pieces have at least a character: where a token is empty, the steps are done one after the other.
    """
    import ahocorasick

    if not all(token for _, token in steps):
        return _one_by_one(text, steps)

    wanted = Counter(n for n, _ in steps if n)
    if not wanted:
        return text, 0
    machine = ahocorasick.Automaton()
    for n in wanted:
        machine.add_word(n, n)
    machine.make_automaton()
    longest = max(map(len, wanted))
    places: dict[str, list[int]] = {n: [] for n in wanted}
    for end, n in machine.iter(text):
        if len(places[n]) < wanted[n] + SPARE:
            places[n].append(end - len(n) + 1)
    at = dict.fromkeys(wanted, 0)
    near: dict[str, list[tuple[int, int, int]]] = {n: [] for n in wanted}  # heaps of place, offset and version of a piece
    now = _Text(text)

    def untouched(n: str) -> int:
        """The needle's first occurrence in what is left of the original, or -1."""
        while True:
            if at[n] == len(places[n]):
                following = text.find(n, places[n][-1] + 1) if places[n] else -1
                if following < 0:
                    return -1
                places[n].append(following)
            p = places[n][at[n]]
            if not now.touched(p, p + len(n)):
                return p
            at[n] += 1

    def touching(n: str) -> tuple[tuple[int, int], int, int] | None:
        """The needle's first occurrence that touches a piece: where it begins, and that piece and offset."""
        while near[n]:
            begins, (piece, offset, version) = near[n][0]
            held = now.pieces.get(piece)
            # where a piece before it has changed since, the occurrence was noted anew with that piece
            if held and held[2] == version and _stands(now, piece, offset, n) and begins == _begins(now, piece, offset, n):
                return begins, piece, offset
            heappop(near[n])
        return None

    found = 0
    for n, token in steps:
        if not n:
            continue
        p, other = untouched(n), touching(n)
        if other is not None and (p < 0 or other[0] < (p, 0)):
            a, b, head, tail = now.span(other[1], other[2], len(n))
            piece = now.put(a, b, head + token + tail)
        elif p >= 0:
            piece = now.put(p, p + len(n), token)
        else:
            continue
        found += 1
        end, string, version = now.pieces[piece]
        left = now.before(piece, longest - 1)
        around = left + string + now.after(end, longest - 1)
        for last, m in machine.iter(around):
            first = last - len(m) + 1
            if first < len(left) + len(string) and last >= len(left):
                offset = first - len(left)
                heappush(near[m], (_begins(now, piece, offset, m), (piece, offset, version)))
    return now.whole(), found


def _one_by_one(text: str, steps: list[tuple[str, str]]) -> tuple[str, int]:
    found = 0
    for n, token in steps:
        if n and n in text:
            text, found = text.replace(n, token, 1), found + 1
    return text, found


def _begins(now: _Text, piece: int, offset: int, needle: str) -> tuple[int, int]:
    """Where an occurrence begins: a place of the original, or of a piece there and how far into it."""
    a, _, head, _ = now.span(piece, offset, len(needle))
    return a, len(head)


def _stands(now: _Text, piece: int, offset: int, needle: str) -> bool:
    end, string, _ = now.pieces[piece]
    left = now.before(piece, -offset) if offset < 0 else ""
    if len(left) < -offset:
        return False
    own = (left + string + now.after(end, max(0, offset + len(needle) - len(string))))[max(offset, 0) :]
    return own[: len(needle)] == needle
