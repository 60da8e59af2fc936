"""Byte-pair encodings as left-to-right dynamic programs.

A merge procedure encodes a string by merging its best pair until none is left.
Its result has a local test: a token sequence is the encoding of its own text
if and only if every two neighbours are the encoding of their joint text, since
the first merge across a token's edge would also happen between those two
alone.  And what stands before any token is the encoding of the text before it.
So each prefix of a text has exactly one last token that fits the prefix before
it, and one pass from left to right finds it: a Viterbi recursion in which one
path survives at each position.  The test of a pair is remembered.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence


def merged(symbols: Sequence[str], rank: Callable[[str, str], float | None]) -> list[str]:
    """``symbols`` after merging the pair of lowest rank, leftmost first, until none has one."""
    parts = list(symbols)
    none = math.inf
    ranks = [none if (r := rank(a, b)) is None else r for a, b in zip(parts, parts[1:], strict=False)]
    while ranks:
        best = min(ranks)
        if best == none:
            break
        at = ranks.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del ranks[at]
        for i in (at - 1, at):
            if 0 <= i < len(ranks):
                r = rank(parts[i], parts[i + 1])
                ranks[i] = none if r is None else r
    return parts


class Program:
    """The recursion over a vocabulary.

    ``rank`` gives a pair's place in the order of merges.  Tokens that end with
    ``end`` can only close a word; with no ``end`` every token can.
    """

    #: Pairs remembered before the memory is emptied.
    MOST = 1_500_000

    def __init__(self, tokens: Sequence[str], rank: Callable[[str, str], float | None], end: str = ""):
        self.rank, self.end = rank, end
        self.tokens = ["", *tokens]  # 0 stands for the start of the text
        self.longest = 0
        self.root: dict = {}
        self.numbers: dict[str, int] = {}
        for number, token in enumerate(self.tokens[1:], 1):
            self.numbers[token] = number
            closes = bool(end) and token.endswith(end)
            body = token[: -len(end)] if closes else token
            self.longest = max(self.longest, len(body))
            children, node = self.root, None
            for letter in body:
                node = children.get(letter)
                if node is None:
                    node = children[letter] = [{}, 0, 0]
                children = node[0]
            node[2 if closes else 1] = number
        self.follow: list[dict[int, bool] | None] = [None] * len(self.tokens)
        self.known = 0

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def fits(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow ``before``; remembered."""
        after = self.after(before)
        found = after.get(token)
        if found is None:
            a, b = self.tokens[before], self.tokens[token]
            found = after[token] = merged([*self.symbols(a), *self.symbols(b)], self.rank) == ([a, b] if before else [b])
            self.known += 1
        return found

    def after(self, before: int) -> dict[int, bool]:
        after = self.follow[before]
        if after is None:
            if self.known > self.MOST:
                self.follow = [None] * len(self.tokens)
                self.known = 0
            after = self.follow[before] = {}
        return after

    def path(self, word: str, before: int = 0) -> list[int]:
        """Numbers of the tokens of a whole word; 0 for a letter that no token has."""
        n = len(word)
        closing = bool(self.end)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        last[0] = before
        root, fits = self.root, self.fits
        for j in range(n):
            b = last[j]
            if b < 0:  # a letter that no token has
                b = last[j] = 0
                start[j] = j - 1
            after = self.after(b)
            children = root
            for k in range(j, n):
                node = children.get(word[k])
                if node is None:
                    break
                children, token, closer = node
                k += 1
                if closing and k == n:
                    token = closer
                if token and last[k] < 0:
                    ok = after.get(token)
                    if ok is None:
                        ok = fits(b, token)
                    if ok:
                        last[k], start[k] = token, j
        if last[n] < 0:
            last[n], start[n] = 0, n - 1
        out, i = [], n
        while i > 0:
            out.append(last[i])
            i = start[i]
        out.reverse()
        return out

    def counts(self, word: str, most: float = math.inf) -> list[int]:
        """Number of tokens of word[:1], word[:2], ..., each taken as a whole word.

        Ends early where each longer prefix has more than ``most`` tokens.
        """
        n = len(word)
        last, count, whole = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        last[0] = 0
        root, fits = self.root, self.fits
        low = 0  # positions in a row, up to here, whose count is above ``most``
        for j in range(n):
            low = low + 1 if count[j] > most else 0
            if low >= self.longest:
                n = j
                break
            b, children, size = last[j], root, count[j] + 1
            after = self.after(b)
            for k in range(j, n):
                node = children.get(word[k])
                if node is None:
                    break
                children, token, closer = node
                k += 1
                if closer and not whole[k]:
                    ok = after.get(closer)
                    if fits(b, closer) if ok is None else ok:
                        whole[k] = size
                if token and last[k] < 0:
                    ok = after.get(token)
                    if fits(b, token) if ok is None else ok:
                        last[k], count[k] = token, size
        return (whole if self.end else count)[1 : n + 1]
