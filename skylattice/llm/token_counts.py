"""Exact token counts of every prefix of a text, by prefix dynamic programming.

For the word BPE of ``word_bpe_49k.json``: text is cut at special strings, each
part is put in NFC and lower case and cut into words by the file's pattern, and
each word is a BPE over its bytes whose last symbol carries the end mark.  For a
word, one pass (``bpe``) gives the last token and the number of tokens of every
prefix, once as an inner part and once as if the word ended there.

White space ends words, so a text's *prefix table* is, for each chunk between
white space, the running sum of tokens before it and the counts of the chunk's own
prefixes.  The table is made in one pass from left to right (a chunk's counts are
remembered), and every answer is read from it: the text's tokens are the last sum,
the tokens of any prefix are a sum and a count, and the longest prefix within a
budget is found by bisection over the sums and a look at one chunk's counts.
Only a prefix cut inside a letter and its combining marks, where that changes the
normal form, is not in a long chunk's table; it is counted when it is asked for.

Defined cases: a null text is empty and has no tokens.  Rows are counted one by
one, so repeated ids or texts need no care.  Other columns are not read, so none
can clash.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import cached_property, lru_cache
from itertools import accumulate, islice
from operator import itemgetter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import Program
from .common import table

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
END = "</w>"
#: White space as the tokenizer's pattern language has it: it separates words and is dropped.
CHUNK = re.compile("[^\\t-\\r \x85\xa0  -     　]+")
#: Letters after a word's end within which another continuation could still change it.
AHEAD = 3
#: Bounds of what a worker remembers: chunks, and their length.
MEMO, LONG = 500_000, 40
#: Translations that add a number to each byte, up to the counts of ``LONG`` letters.
SHIFTED = [bytes(min(255, x + n) for x in range(256)) for n in range(256)]


def remember(memo: dict, key, value) -> None:
    if len(memo) >= MEMO:
        memo.clear()
    memo[key] = value


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else one from U+0100 on."""
    kept = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in kept}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(0x100 + len(letters) - len(kept))
    return [letters[b] for b in range(256)]


@lru_cache(maxsize=1)
def seconds() -> frozenset[str]:
    """Letters that can join the letter before them in the normal form."""
    found = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


@lru_cache(maxsize=100_000)
def starts_afresh(letter: str) -> bool:
    """Whether the normal form of what stands before ``letter`` stays as it is."""
    first = unicodedata.normalize("NFD", letter)[0]
    return not unicodedata.combining(first) and first not in seconds()


@lru_cache(maxsize=2)
def newer_letters(path: str, pattern: str) -> tuple[re.Pattern, dict[str, str], regex.Pattern]:
    """Letters and digits newer than Python's tables: what may find them, their small letters, and ``pattern`` with them.

    Whether such a one is a letter, a digit or neither is for the library to say, whose tables are its own.
    """
    library = Tokenizer.from_file(path)
    found = regex.findall(r"[\p{L}\p{N}]", "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn"))
    pieces = lambda text: len(library.pre_tokenizer.pre_tokenize_str(text))
    no_letters = "".join(c for c in found if pieces(f"a{c}") > 1)
    no_digits = "".join(c for c in found if pieces(f"!{c}") == 1)
    exact = pattern
    for name, but in (("L", no_letters), ("N", no_digits)):
        if but:
            exact = exact.replace(f"\\p{{{name}}}", rf"[\p{{{name}}}--[{but}]]")
    small = {c: library.normalizer.normalize_str(c) for c in found}
    return re.compile(f"[{min(found)}-\U0010ffff]" if found else r"(?!)"), small, regex.compile(exact, regex.V1)


class WordCounter:
    """Counts tokens of chunks (texts without white space), and of their prefixes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        ranks = {tuple(m): i for i, m in enumerate(model["model"]["merges"])}
        specials = [t["content"] for t in model["added_tokens"]]
        if any(CHUNK.sub("", t) for t in specials):
            raise ValueError(f"{path} has special strings with white space")
        self.program = Program([t for t in model["model"]["vocab"] if t not in specials], lambda a, b: ranks.get((a, b)), END)
        self.specials = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        pattern = model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        self.newer, self.small, self.exact = newer_letters(path, pattern)
        self.letters = byte_letters()
        self.memo: dict[str, bytes] = {}
        self.of_words: dict[str, int] = {}
        self.of_prefixes: dict[str, bytes] = {}

    def normal(self, part: str) -> str:
        if not part.isascii():
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            if self.has_newer(part):
                return "".join([self.small[c] if c in self.small else c.lower() for c in part])
        return part.lower()

    def has_newer(self, text: str) -> bool:
        return self.newer.search(text) is not None and not self.small.keys().isdisjoint(text)

    def splitter(self, text: str) -> regex.Pattern:
        """The pattern that cuts ``text``, which is normal, into words."""
        return self.exact if not text.isascii() and self.has_newer(text) else self.pattern

    def words(self, part: str) -> list[str]:
        text = self.normal(part)
        return self.splitter(text).findall(text)

    def spelled(self, word: str) -> str:
        return "".join([self.letters[b] for b in word.encode("utf-8", "surrogatepass")])

    def of_word(self, word: str) -> int:
        found = self.of_words.get(word)
        if found is None:
            found = len(self.program.path(self.spelled(word)))
            if len(word) <= LONG:
                remember(self.of_words, word, found)
        return found

    def count(self, chunk: str) -> int:
        """Tokens of a chunk, encoded whole."""
        if self.specials and self.specials.search(chunk):
            parts = self.specials.split(chunk)
            return len(parts) - 1 + sum(self.count(p) for p in parts if p)
        return sum(map(self.of_word, self.words(chunk)))

    def prefixes(self, chunk: str) -> Sequence[int]:
        """Tokens of chunk[:1], chunk[:2], ...; -1 for a cut inside a letter of a long chunk."""
        found = self.memo.get(chunk)
        if found is None:
            found = self._prefixes(chunk)
            if len(chunk) <= LONG:
                found = bytes(list(found))  # no letter has more than four tokens
                remember(self.memo, chunk, found)
        return found

    def word_prefixes(self, word: str) -> Sequence[int]:
        """Tokens of word[:1], word[:2], ..., each by itself."""
        found = self.of_prefixes.get(word)
        if found is None:
            if len(word) <= AHEAD:  # a cut contraction is other words
                found = [sum(map(self.of_word, self.splitter(word).findall(word[:k]))) for k in range(1, len(word) + 1)]
            elif word.isascii():
                found = self.program.counts(self.spelled(word))  # a letter for each, control characters included
            else:
                spelled = [self.spelled(c) for c in word]
                counts = self.program.counts("".join(spelled))
                found = [counts[end - 1] for end in accumulate(map(len, spelled))]
            if len(word) <= LONG:
                found = bytes(found)  # no letter has more than four tokens
                remember(self.of_prefixes, word, found)
        return found

    def plain_prefixes(self, text: str) -> Sequence[int]:
        """Tokens of text[:1], text[:2], ... of a normal text without special strings."""
        pattern = self.splitter(text)
        words = pattern.findall(text)
        if len(text) > LONG or len("".join(words)) < len(text):
            out, spent = array("i"), 0
            for m in pattern.finditer(text):
                out.extend([spent] * (m.start() - len(out)))
                out.extend([spent + n for n in self.word_prefixes(m[0])])
                spent = out[-1]
            out.extend([spent] * (len(text) - len(out)))
            return out
        out = b""
        for w in words:
            found = self.word_prefixes(w)
            out += found.translate(SHIFTED[out[-1]]) if out else found
        return out

    def _prefixes(self, chunk: str) -> Sequence[int]:
        out: Sequence[int] = b""
        before = at = 0
        while True:
            special = self.specials.search(chunk, at) if self.specials else None
            end = special.end() - 1 if special else len(chunk)
            part = chunk[at:end]
            text = self.normal(part)
            if part.isascii() or len(text) == len(part) and unicodedata.is_normalized("NFC", part) and all(map(starts_afresh, part)):
                counts = self.plain_prefixes(text)
            else:
                known, _ = self.part_counts(part)
                counts = [known[p] if p in known else self.count(part[:p]) if len(chunk) <= LONG else -1 - before for p in range(1, len(part) + 1)]
            if not special and not before:
                return counts
            out = [*out, *[before + n for n in counts]]
            if not special:
                return out
            before += (counts[special.start() - at - 1] if special.start() > at else 0) + 1
            out.append(before)
            at = special.end()

    def part_counts(self, part: str, budget: float = math.inf) -> tuple[dict[int, int], int]:
        """Tokens of part[:p] by p, and the p from which on none has ``budget`` tokens or less.

        One pass.  ``part`` has no whole special string.  Left out are the p inside
        a letter and its marks where the normal form of part[:p] does not begin that of ``part``.
        """
        if part.isascii():
            text, ends = part.lower(), None
        else:
            bounds = [0, *[p for p in range(1, len(part)) if starts_afresh(part[p])], len(part)]
            pieces: list[str] = []
            ends, starts, size = [(0, 0)], [], 0  # (p, length of the normal form of part[:p]), (p, size) of the bounds
            for a, b in zip(bounds, bounds[1:], strict=False):
                piece = self.normal(part[a:b])
                starts.append((a, size))
                for p in range(a + 1, b):
                    inner = self.normal(part[a:p])
                    if piece.startswith(inner):
                        ends.append((p, size + len(inner)))
                pieces.append(piece)
                size += len(piece)
                ends.append((b, size))
            text = "".join(pieces)
        counts, spent, over = [0], 0, len(text) + 1
        for m in self.splitter(text).finditer(text):
            if m.start() >= over:
                break
            counts += [spent] * (m.start() + 1 - len(counts))
            word = m[0]
            if len(word) <= AHEAD:  # a cut contraction is other words
                counts += [spent + sum(map(self.of_word, self.splitter(word).findall(word[:k]))) for k in range(1, len(word) + 1)]
                spent = counts[-1]
            else:
                spelled = [self.spelled(c) for c in word]
                found = self.program.counts("".join(spelled), budget - spent)
                at = 0
                for letter in spelled:
                    at += len(letter)
                    if at > len(found):
                        break
                    counts.append(spent + found[at - 1])
                if at > len(found):
                    over = min(over, len(counts) + AHEAD)
                    break
                spent = counts[-1]
            if spent > budget:
                over = min(over, m.end() + AHEAD)
        else:
            counts += [spent] * (len(text) + 1 - len(counts))
        if ends is None:
            return dict(enumerate(counts)), min(over, len(part) + 1)
        end = next((p for p, size in starts if size >= over), len(part) + 1)
        return {p: counts[size] for p, size in ends if size < len(counts)}, end

    def inside(self, chunk: str, budget: int) -> int:
        """Code points of the longest prefix of a chunk with at most ``budget`` tokens."""
        best = before = at = 0
        while True:
            special = self.specials.search(chunk, at) if self.specials else None
            end = special.end() - 1 if special else len(chunk)
            best = max(best, at + self.inside_part(chunk[at:end], budget - before))
            if not special:
                return best
            before += self.count(chunk[at : special.start()]) + 1
            if before > budget:
                return best
            at = best = special.end()

    def inside_part(self, part: str, budget: int) -> int:
        size = 8 * budget + 64
        while True:
            some = part[:size]
            known, end = self.part_counts(some, budget)
            if end <= len(some) or len(some) == len(part):
                break
            size *= 4
        fit = max(p for p, n in known.items() if n <= budget)
        return next((p for p in range(min(end - 1, len(some)), fit, -1) if p not in known and self.count(some[:p]) <= budget), fit)

    def table(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)


class PrefixTable:
    """How many tokens each prefix of a text has."""

    def __init__(self, counter: WordCounter, text: str):
        self.counter, self.text = counter, text
        chunks = CHUNK.findall(text)
        found = list(map(counter.memo.get, chunks))
        try:
            self.sums = list(accumulate(map(itemgetter(-1), found)))  # at each chunk's end
        except TypeError:  # a chunk that is not remembered
            for i, n in enumerate(found):
                if n is None:
                    found[i] = counter.prefixes(chunks[i])
            self.sums = list(accumulate(map(itemgetter(-1), found)))
        self.inner = found

    @property
    def tokens(self) -> int:
        return self.sums[-1] if self.sums else 0

    @cached_property
    def starts(self) -> list[int]:
        return [m.start() for m in CHUNK.finditer(self.text)]

    def before(self, chunk: int) -> int:
        return self.sums[chunk - 1] if chunk else 0

    def at(self, p: int) -> int:
        """Tokens of the first ``p`` code points."""
        chunk = bisect_left(self.starts, p) - 1  # the last one that starts before p
        if chunk < 0:
            return 0
        inside = min(p - self.starts[chunk], len(self.inner[chunk]))
        n = self.inner[chunk][inside - 1]
        return self.before(chunk) + (n if n >= 0 else self.counter.count(self.text[self.starts[chunk] : p]))

    def fitting(self, budget: int) -> int:
        """Code points of the longest prefix with at most ``budget`` tokens."""
        chunk = bisect_right(self.sums, budget)
        if chunk == len(self.sums):
            return len(self.text)
        inner, left = self.inner[chunk], budget - self.before(chunk)
        start = next(islice(CHUNK.finditer(self.text), chunk, None)).start()
        if min(inner) < 0:
            return start + self.counter.inside(self.text[start : start + len(inner)], left)
        return start + next((p for p in range(len(inner), 0, -1) if inner[p - 1] <= left), 0)


@lru_cache(maxsize=1)
def counter(path: str) -> WordCounter:
    return WordCounter(path)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars) of ``docs`` (doc_id, text).

    ``vocabulary`` is the name of an installed file, read on each executor.
    fit_chars is the length of the longest prefix of at most ``limit`` tokens.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary_path(vocabulary))
        for batch in batches:
            tokens, fit = [], []
            for text in batch.column("text"):
                found = count.table(text.as_py() or "")
                tokens.append(found.tokens)
                fit.append(found.fitting(limit))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), pa.array(fit, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(kernel, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
