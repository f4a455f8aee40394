"""Token ids of whole texts by a given tokenizer file, with a cache of words.

Merges never cross the pieces that a pre-tokenizer cuts, so a text can be cut
between pieces, and each distinct piece encoded once per worker.  A byte-level
tokenizer cuts a word of Latin letters and the marks behind it in two, so such a
piece goes to the tokenizer's merges at once, without its search for pieces.
Other new pieces of a batch are encoded together, with a separator between them
that is a token of its own.  Texts that hold an added token, or characters on
which white-space rules of pattern engines differ, are encoded whole, without the
cache.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable

import numpy as np

# Characters that Python counts as white space and the tokenizers do not, and the marks used here.
ODD = re.compile("[\x1c-\x1f\x00\x01]")
# A piece of Latin letters, whose class no Unicode version changes, and ASCII marks but for the apostrophe.
WORD = re.compile("(\x00 |[\x00\n]|)([A-Za-zªµºÀ-ÖØ-öø-ʯ]+)([!-&(-/:-@\\[-`{-~]*)\\Z")
# Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = itertools.count(256)
BYTE_CHARS = {b: chr(b if b in _PRINTED else next(_OTHERS)) for b in range(256)}
# Pieces kept per worker; a full cache keeps the first quarter, in which frequent pieces are.
CACHE_PIECES = 1_000_000


class _Pieces(dict):
    """Ids of pieces; those of a missing one are made."""

    def __init__(self, make: Callable[[str], bytes | None], kept=()):
        super().__init__(kept)
        self.make = make

    def __missing__(self, piece: str) -> bytes | None:
        return self.make(piece)


def _cuts_words(tokenizer) -> bool:
    """Whether a tokenizer is merges of bytes behind the usual byte-level pieces and nothing else."""
    said = json.loads(tokenizer.to_str())
    cut, model = said["pre_tokenizer"] or {}, said["model"]
    usual = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    return bool(usual) and said["normalizer"] is None and model["type"] == "BPE" and not model.get("dropout")


class Encoder:
    """Encodes texts to little-endian 32-bit ids.

    ``spaced``: the tokenizer keeps white space (byte-level); otherwise white
    space is dropped and pieces are cut at it.
    """

    def __init__(self, path: str, spaced: bool, limit: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = spaced
        # a separator that is one id and stands in no piece
        self.between = "\n" if spaced else " \x01 "
        self.mark = self.plain(self.between)[0] if spaced else self.plain("\x01")[0]
        self.line = np.array([self.mark], "<u4").tobytes()
        self.model, self.words = self.tokenizer.model, spaced and _cuts_words(self.tokenizer)
        self.raw = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.marks: dict[str, bytes] = {"": b""}
        self.later: dict[str, None] = {}  # pieces to learn together
        self.cache = _Pieces(self.make)
        self.limit = limit

    def merged(self, piece: str) -> bytes:
        """Ids of one piece as the tokenizer cuts it, in the characters of its vocabulary."""
        return b"".join([self.raw[t.id] for t in self.model.tokenize(piece)])

    def make(self, piece: str) -> bytes | None:
        """Ids of a new word, which are kept; another piece is noted and gives none yet."""
        if self.words and piece.isascii() and piece.isalpha():  # most pieces
            self.cache[piece] = ids = self.merged(BYTE_CHARS[32] + piece)
            return ids
        found = WORD.match(piece) if self.words else None
        if found is None:
            self.later[piece] = None
            return None
        lead, letters, marks = found.groups()
        ids = self.cache.get(letters) if marks and not lead else None
        if ids is None:
            said = letters if letters.isascii() else letters.encode().decode("latin-1").translate(BYTE_CHARS)
            ids = self.merged(said if lead in ("\x00", "\n") else BYTE_CHARS[32] + said)
        if marks not in self.marks:
            if len(self.marks) >= self.limit:
                self.marks = {"": b""}
            self.marks[marks] = self.merged(marks)
        ids += self.marks[marks]
        self.cache[piece] = ids = self.line + ids if lead == "\n" else ids
        return ids

    def plain(self, text: str) -> np.ndarray:
        """Ids of a text by the tokenizer itself."""
        # the batch form leaves out the places of tokens, which take half of the time
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def cut(self, text: str) -> list[str]:
        """Pieces of a text, in the form in which they are kept.

        A piece of a text with white space stands for itself behind a ``\\x00``, or
        for a blank and itself, or, where it begins with a line end, for itself.
        """
        if not self.spaced:
            return text.split()
        words = text.split()
        gaps = len(words) - 1
        # white space other than one blank or line end between two words
        if len(text) - sum(map(len, words)) != gaps or text.count(" ") + text.count("\n") != gaps:
            # runs of white space leave their last blank to the word that follows
            return ["\x00" + p for p in re.findall(r"\x20?[^\s]+|\s+(?!\S)|\s+", text)]
        pieces = text.replace("\n", " \n").split(" ")
        pieces[0] = "\x00" + pieces[0]
        return pieces

    def learn(self, pieces: list[str]) -> None:
        """Encode new pieces and keep them."""
        if not pieces:
            return
        # the separator and a leading line end are pieces of their own to the tokenizer
        said = pieces
        if self.spaced:
            said = [p[1:] if p[0] == "\x00" or p[0] == "\n" else f" {p}" for p in pieces]
            alone = [i for i, p in enumerate(said) if p.isspace()]
            for i in reversed(alone):
                self.cache[pieces[i]] = self.plain(said.pop(i)).tobytes()
            kept = set(alone)
            pieces = [p for i, p in enumerate(pieces) if i not in kept]
        ids = self.plain(self.between.join(said))
        ends = np.flatnonzero(ids == self.mark)
        if len(ends) == len(pieces) - 1:
            raw = ids.tobytes()
            starts = [0, *((ends + 1) * 4).tolist()]
            stops = [*(ends * 4).tolist(), len(raw)]
            parts = [raw[a:b] for a, b in zip(starts, stops, strict=True)]
        else:  # a piece holds the separator's id
            parts = [self.plain(p).tobytes() for p in said]
        for piece, part in zip(pieces, parts, strict=True):
            self.cache[piece] = self.line + part if self.spaced and piece[0] == "\n" else part

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text as bytes; a null is an empty text."""
        cut = [
            None if not t or ODD.search(t) or any(a in t for a in self.added) else self.cut(t) for t in texts
        ]
        if len(self.cache) > self.limit:
            self.cache = _Pieces(self.make, itertools.islice(self.cache.items(), self.limit // 4))
        get = self.cache.__getitem__
        out: list[bytes] = []
        again = []
        for i, (t, c) in enumerate(zip(texts, cut, strict=True)):
            if c is None:
                out.append(self.plain(t).tobytes() if t else b"")
                continue
            ids = list(map(get, c))
            if self.later and None in ids:
                again.append(i)
            out.append(b"" if again and again[-1] == i else b"".join(ids))
        if again:
            self.learn(list(self.later))
            self.later.clear()
        for i in again:
            out[i] = b"".join(map(get, cut[i]))
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}
# Texts are encoded in groups of at most so many characters (or one text).
GROUP_CHARS = 1 << 18


def encoder(path: str, spaced: bool) -> Encoder:
    """The encoder of this worker process."""
    key = (path, spaced)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, spaced)
    return _ENCODERS[key]


def forget() -> None:
    """Free the encoders of this worker process, which tasks without tokens would hold on to."""
    _ENCODERS.clear()


def encode_all(path: str, spaced: bool, texts: list[str | None]):
    """Yield the ids of each text in order, encoding a bounded group at a time."""
    group: list[str | None] = []
    chars = 0
    for text in texts:
        group.append(text)
        chars += len(text or "")
        if chars >= GROUP_CHARS:
            yield from encoder(path, spaced).encode(group)
            group, chars = [], 0
    if group:
        yield from encoder(path, spaced).encode(group)


def public_path(name: str) -> str:
    """Place of one of the installed public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path(name)
