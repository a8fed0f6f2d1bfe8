"""Token ids of whole texts, with each distinct piece of text tokenized once.

A text is cut where every tokenizer of the given family cuts anyway (before a
single space or line feed that is followed by something else than white
space), and the pieces' ids are kept in a bounded table per worker.  A text
with a run of white space or with a special token's string takes the plain
way: the whole text at once.  Both give the same ids.
"""

from __future__ import annotations

import itertools
import os
import zlib
from array import array

from tessera.llm import shared

#: Bytes of the pieces that a worker keeps; when there are more, the later half
#: goes.  A piece takes about so many bytes besides its characters and ids.
MAX_BYTES, PIECE_BYTES = 192 << 20, 180

#: Marks that end a word and start a token of their own.
_MARKS = ",.!?;:#$%&*|"

#: The characters with the Unicode property White_Space, and
#: four controls that Python takes for white space.
_SPACES = frozenset("\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0       "
                    "         　")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary:
    printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PieceCoder:
    """Base class: subclasses give the ids of whole strings.

    ``keeps_space``: the space before a word belongs to its token (byte-level
    BPE); otherwise white space only separates and yields no id.
    """

    keeps_space = True
    specials: tuple[str, ...] = ()

    def __init__(self, max_bytes: int = MAX_BYTES):
        self.max_bytes = max_bytes
        self.held = 0
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of each string as little-endian unsigned 32-bit integers."""
        raise NotImplementedError

    def folded(self, text: str) -> str:
        """The text, or one with the same ids and fewer distinct words."""
        return text

    def word(self, word: str, spaced: bool) -> bytes | None:
        """Ids of a word of letters, after a space if ``spaced``; None leaves
        it to ``whole``."""
        return None

    def _word(self, piece: str) -> bytes | None:
        """Ids of a piece that is one word of letters, else None."""
        if piece[0] == "\n" and self.keeps_space:
            after = self.word(piece[1:], False) if piece[1:].isalpha() else None
            return None if after is None else self._tail("\n") + after
        return self.word(piece, self.keeps_space) if piece.isalpha() else None

    def _first(self, heads: list[str]) -> list[bytes]:
        """Ids of the pieces that texts begin with."""
        out = [self.word(head, False) if head.isalpha() else None for head in heads]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self.whole([heads[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _tail(self, tail: str) -> bytes:
        if tail not in self.tails:
            self.tails[tail] = self.whole([tail])[0]
        return self.tails[tail]

    def _learn(self, pieces: set[str]) -> None:
        """Add the ids of ``pieces``, none known yet, but for those that are part
        of a run of white space.  A piece of a word and marks after it is cut
        between them, as the tokenizers do."""
        known, rest = self.known, []
        for piece in pieces:
            if piece.isalpha() and (ids := self.word(piece, self.keeps_space)) is not None:
                known[piece] = ids
                continue
            if self.keeps_space:
                body = piece[1:] if piece[:1] == "\n" else piece
                if not body or body[0] in _SPACES:
                    continue
            elif not piece:
                known[piece] = b""
                continue
            head = piece.rstrip(_MARKS)
            if not (head[-1:].isalnum() and "\u0130" != head[-1] < "\u0250"):
                rest.append(piece)
                continue
            ids = known.get(head) or self._word(head)
            if ids is None:
                rest.append(piece)
            else:
                known[head] = ids
                if len(head) < len(piece):
                    known[piece] = ids + self._tail(piece[len(head):])
        if self.keeps_space:
            known.update(zip(rest, self.whole([p if p[0] == "\n" else " " + p for p in rest]), strict=True))
        else:
            known.update(zip(rest, self.whole(rest), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes (little-endian uint32); null is empty."""
        if self.held > self.max_bytes:  # what was met first is met most
            self.known = dict(itertools.islice(self.known.items(), len(self.known) // 2))
            self.held = sum(map(len, self.known)) + sum(map(len, self.known.values())) + PIECE_BYTES * len(self.known)
            self.tails.clear()
        out = [b""] * len(texts)
        cut: list[tuple[int, str, list[str]]] = []
        plain: list[int] = []
        distinct: set[str] = set()
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(s in text for s in self.specials):
                plain.append(i)
                continue
            head = ""
            if self.keeps_space:
                head, *pieces = text.replace("\n", " \n").split(" ")
            else:
                pieces = self.folded(text).replace("\n", " ").split(" ")
            cut.append((i, head, pieces))
            distinct.update(pieces)
        fresh = distinct.difference(self.known)
        self._learn(fresh)
        self.held += sum(len(p) + len(self.known[p]) + PIECE_BYTES for p in fresh if p in self.known)
        heads = self._first([head for _, head, _ in cut]) if self.keeps_space else [b""] * len(cut)
        find = self.known.__getitem__
        for (i, _, pieces), head in zip(cut, heads, strict=True):
            try:
                out[i] = head + b"".join(map(find, pieces))
            except KeyError:  # a run of white space
                plain.append(i)
        for i, ids in zip(plain, self.whole([texts[i] for i in plain]), strict=True):
            out[i] = ids
        return out


class LibraryCoder(PieceCoder):
    """Ids of the tokenizers library for a BPE tokenizer given as JSON text."""

    def __init__(self, tokenizer_json: str, keeps_space: bool, max_bytes: int = MAX_BYTES):
        super().__init__(max_bytes)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.keeps_space = keeps_space
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.specials = tuple(token.content for token in added)
        self.lowers = not keeps_space and "Lowercase" in str(self.tokenizer.normalizer)
        self.letters = {b: c for c, b in byte_letters().items()}

    def folded(self, text: str) -> str:
        """Latin-1 text is lowered here if the tokenizer does so first."""
        if self.lowers:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
            return text.lower()
        return text

    def word(self, word: str, spaced: bool) -> bytes | None:
        """A word of Latin letters is one pre-token and goes to the library's
        BPE model at once."""
        letters = word if self.keeps_space else word.lower()
        if not word.isascii():
            if max(word) >= "\u0250" or "\u0130" in word:
                return None
            letters = letters.encode().decode("latin-1").translate(self.letters)
        if spaced and self.keeps_space:
            letters = self.letters[32] + letters
        return array("I", [token.id for token in self.model.tokenize(letters)]).tobytes()

    def whole(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in made]


#: Largest tokenizer file that is sent to the workers.
MAX_TOKENIZER_BYTES = 64 << 20


def tokenizer_json(path: str) -> str:
    """The tokenizer file, read once on the driver; its size is checked, as
    it goes to every worker."""
    if os.path.getsize(path) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"tokenizer file {path} is larger than {MAX_TOKENIZER_BYTES} bytes")
    with open(path, encoding="utf-8") as file:
        return file.read()


_CODERS: dict[tuple[int, bool], LibraryCoder] = {}
shared.keeps_tables(_CODERS.clear)


def coder(tokenizer_json: str, keeps_space: bool) -> LibraryCoder:
    """One coder per worker process, so that its table serves later tasks."""
    key = (zlib.crc32(tokenizer_json.encode()), keeps_space)
    if key not in _CODERS:
        _CODERS[key] = LibraryCoder(tokenizer_json, keeps_space)
    return _CODERS[key]
