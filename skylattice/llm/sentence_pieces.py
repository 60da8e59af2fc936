"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The installed model is a BPE model, so a path's worth is not a sum of scores: a
path survives where its tokens are what the model's merges give (``bpe``), which
leaves one backpointer a position.  The pass takes a text in parts and keeps a
window no longer than it must: a later piece can start only within the longest
piece's length of the newest position, and once the backpointer paths of all those
positions run through one boundary, the ids before it are committed and the
window moves up.

No piece has the space mark after another letter (checked when the model is
read), so every path meets at the start of each marked word, and between letters
that no piece has side by side: there the window is empty.  What stands between
two such boundaries and has passed before is not passed again; its remembered ids
are committed at once.  ``window`` is a bound of the letters the window held.

Encoding equals the model's own: the text gets a leading space mark, spaces turn
into marks, and letters without a piece fall back to their UTF-8 bytes' pieces.
Decoding joins the pieces, turns runs of byte pieces back into letters and drops
the leading space.

Defined cases: a null or empty text has no ids and decodes to the empty text.
U+2581 in a text is a space to the model and decodes to one; ``restored`` tells
whether decoding gave the text back, comparing such marks as spaces.  Repeated
rows are encoded one by one.  Other columns are not read, so none can clash.  An
empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Program
from .common import table
from .token_counts import LONG, remember, vocabulary_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Letters after which the window looks for a common boundary.
LOOK = 64
#: Letters of a text that are normalised and cut into words at a time.
PART = 1 << 16


class Pieces:
    """The model's pieces, and what its merges make of them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.bytes_from = next(i for i in range(size) if model.is_byte(i))
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        cost = {self.pieces[i]: -model.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in cost):
            raise ValueError(f"{path} has pieces across words")
        self.program = Program([self.pieces[i] for i in plain], lambda a, b: cost.get(a + b))
        self.ids = [0, *plain]  # by the program's numbers
        self.longest = self.program.longest
        self.joined = {p[i : i + 2] for p in cost for i in range(len(p) - 1)}
        self.is_byte = np.zeros(size, bool)
        self.is_byte[self.bytes_from : self.bytes_from + 256] = True

    def parts(self, word: str) -> list[str]:
        """``word`` cut between letters that no piece has side by side: there, too, all paths meet."""
        joined = self.joined
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in joined]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)] if cuts else [word]

    def spelled(self, tokens: list[int], text: str) -> list[int]:
        """Ids of the program's ``tokens``, which make up ``text``."""
        if 0 not in tokens:
            return [self.ids[t] for t in tokens]
        out, at = [], 0
        for t in tokens:
            size = len(self.program.tokens[t]) if t else 1
            out += [self.ids[t]] if t else [self.bytes_from + b for b in text[at].encode("utf-8", "surrogatepass")]
            at += size
        return out


class StreamingEncoder:
    """Takes a normalised text in parts, gives ids as soon as they are certain."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.reset()

    def reset(self) -> None:
        self.text = ""  # the window, from the last committed boundary on
        self.last: list[int] = [0]  # of each position in the window: the piece that ends there, -1 while there is none
        self.start: list[int] = [0]  # and where that piece starts
        self.done = 0  # starts from which all pieces have been tried
        self.widest = 0  # the most letters the window has held

    def feed(self, more: str) -> list[int]:
        out: list[int] = []
        for at in range(0, len(more), LOOK):
            self._take(more[at : at + LOOK])
            self._advance(len(self.text) - self.pieces.longest + 1)
            end = self._boundary()
            if end:
                out += self._commit(end)
        return out

    def flush(self) -> list[int]:
        """Ids of what is still in the window; the text ends here."""
        n = len(self.text)
        self._advance(n)
        self._unknown(n)
        out = self._path(n)
        self.text, self.last, self.start, self.done = "", [0], [0], 0
        return out

    def word(self, word: str) -> list[int]:
        """Ids of a word between two certain boundaries: ``feed`` and ``flush``, without looking for a boundary inside a short one."""
        n = len(word)
        if n > LOOK:
            return [*self.feed(word), *self.flush()]
        self.text, self.last, self.start, self.done = word, [0] + [-1] * n, [0] * (n + 1), 0
        return self.flush()

    def _take(self, more: str) -> None:
        self.text += more
        self.last += [-1] * len(more)
        self.start += [0] * len(more)
        self.widest = max(self.widest, len(self.text))

    def _unknown(self, j: int) -> int:
        """The piece that ends at ``j``; where none does, no piece has the letter before."""
        if self.last[j] < 0:
            self.last[j], self.start[j] = 0, j - 1
        return self.last[j]

    def _advance(self, upto: int) -> None:
        """Try the pieces that start before ``upto``; all of them end inside the window or the text."""
        text, last, start, program = self.text, self.last, self.start, self.pieces.program
        n, root, fits = len(text), program.root, program.fits
        for j in range(self.done, upto):
            b = last[j] if last[j] >= 0 else self._unknown(j)
            after, children = program.after(b), root
            for k in range(j, n):
                node = children.get(text[k])
                if node is None:
                    break
                children, token, _ = node
                if token and last[k + 1] < 0:
                    ok = after.get(token)
                    if ok is None:
                        ok = fits(b, token)
                    if ok:
                        last[k + 1], start[k + 1] = token, j
        self.done = max(self.done, upto)

    def _boundary(self) -> int:
        """The last position through which the paths of all open positions run."""
        done, n = self.done, len(self.text)
        open_ = {done, *[k for k in range(done + 1, min(n, done + self.pieces.longest) + 1) if self.last[k] >= 0]}
        while len(open_) > 1:
            far = max(open_)
            open_.discard(far)
            open_.add(self.start[far] if self.last[far] >= 0 else far - 1)
        return open_.pop()

    def _path(self, end: int) -> list[int]:
        """Ids from the last committed boundary up to ``end``."""
        tokens, i = [], end
        while i > 0:
            tokens.append(self._unknown(i))
            i = self.start[i]
        tokens.reverse()
        return self.pieces.spelled(tokens, self.text)

    def _commit(self, end: int) -> list[int]:
        out = self._path(end)
        self.text = self.text[end:]
        self.last = self.last[end:]
        self.start = [s - end for s in self.start[end:]]
        self.done -= end
        return out


class Codec:
    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.stream = StreamingEncoder(self.pieces)
        self.memo: dict[str, bytes] = {}
        self.of_parts: dict[str, bytes] = {}
        self.plain = [p.replace(MARK, " ") for p in self.pieces.pieces]
        self.raw = [bytes([i - self.pieces.bytes_from]) if odd else p.encode() for i, (p, odd) in enumerate(zip(self.plain, self.pieces.is_byte.tolist(), strict=True))]
        self.sure = True  # every part of the text being encoded has been decoded, byte by byte

    def word(self, word: str) -> bytes:
        found = self.memo.get(word)
        if found is None:
            found = b"".join(map(self.part, self.pieces.parts(word)))
            if self.sure and len(word) <= LONG:
                remember(self.memo, word, found)
        return found

    def part(self, part: str) -> bytes:
        found = self.of_parts.get(part)
        if found is None:
            ids = self.stream.word(part)
            found = array("i", ids).tobytes()
            if b"".join([self.raw[i] for i in ids]) != part.replace(MARK, " ").encode("utf-8", "surrogatepass"):
                self.sure = False
            elif len(part) <= LONG:
                remember(self.of_parts, part, found)
        return found

    def words(self, words: list[str]) -> bytes:
        found = list(map(self.memo.get, words))
        try:
            return b"".join(found)
        except TypeError:
            return b"".join([x if x is not None else self.word(w) for x, w in zip(found, words, strict=True)])

    def encode(self, text: str) -> tuple[bytes, int]:
        """The ids as the bytes of 32-bit integers, and a bound of the letters the window held: ``LONG`` or, if wider, its width."""
        self.stream.reset()
        self.sure = True
        out, held = [], MARK if text else ""
        for at in range(0, len(text), PART):
            part = text[at : at + PART].replace(" ", MARK)
            if not held:  # the window is inside a word
                self.sure = False
                end = re.match(f"{MARK}*[^{MARK}]*" if self.stream.text.endswith(MARK) else f"[^{MARK}]*", part).end()
                out.append(array("i", self.stream.feed(part[:end])).tobytes())
                if end == len(part):
                    continue
                out.append(array("i", self.stream.flush()).tobytes())
                part = part[end:]
            words = SEGMENT.findall(held + part)
            held = words.pop()  # its end is not known yet
            out.append(self.words(words))
            if len(held) > LONG:
                self.sure = False
                out.append(array("i", self.stream.feed(held)).tobytes())
                held = ""
        if held:
            out.append(self.word(held))
        else:
            out.append(array("i", self.stream.flush()).tobytes())
        return b"".join(out), max(LONG, self.stream.widest) if text else 0

    def restores(self, text: str, found: bytes) -> bool:
        """Whether the ids that ``text`` was just encoded to give it back: its parts were decoded when they were first passed, else it is decoded whole."""
        return self.sure or self.decode(np.frombuffer(found, np.int32)) == text.replace(MARK, " ")

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        odd = self.pieces.is_byte[ids]
        if not odd.any():
            return "".join(map(self.plain.__getitem__, ids.tolist()))[1:]
        edges = np.flatnonzero(np.diff(odd)) + 1
        out = []
        for run in np.split(ids, edges):
            if self.pieces.is_byte[run[0]]:
                out.append(bytes((run - self.pieces.bytes_from).tolist()).decode("utf-8", "replace"))
            else:
                out.append("".join(map(self.plain.__getitem__, run.tolist())))
        return "".join(out)[1:]


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, token_ids, n_tokens, restored, window) of ``docs`` (doc_id, text)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary_path(model))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, restored, window = [], [], []
                for value in part.column("text"):
                    text = value.as_py() or ""
                    found, widest = c.encode(text)
                    ids.append(found)
                    window.append(widest)
                    restored.append(c.restores(text, found))
                sizes = np.array([len(x) // 4 for x in ids], np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(sizes.astype(np.int64)), pa.array(restored, pa.bool_()), pa.array(window, pa.int32())], ["doc_id", "token_ids", "n_tokens", "restored", "window"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(kernel, f"doc_id {id_type}, token_ids array<int>, n_tokens long, restored boolean, window int")


def op2_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
