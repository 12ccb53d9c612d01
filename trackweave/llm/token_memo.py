"""Token ids by the tokenizers library, with a memo for the pieces of text that repeat.

A text is cut only where the tokenizer's own pre-tokenizer always cuts, so the ids of the pieces,
one after the other, are the ids of the whole text. Each worker keeps the ids of pieces that it
has met, so the library encodes a word once and not at each of its occurrences.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from functools import lru_cache
from pathlib import Path

#: Pieces that one generation of a worker's memo holds; two generations live. Results do not depend on it.
MEMO_PIECES = 150_000
#: Longer pieces are encoded each time.
MEMO_CHARS = 40
#: A run of these marks behind letters is a pre-token of its own for both tokenizers.
MARKS = ".,;:!?$%&#*"
#: The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on.
PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = dict(zip((b for b in range(256) if b not in PLAIN), range(0x100, 0x200), strict=False))
#: A space between two characters that nobody counts as white space.
CUT = re.compile(r"(?<=\S)(?= \S)")
RUN = re.compile(r"\s\s|^\s|\s$|[^\S \n]")
#: Marks that end a word before a space, and those behind another sign, with which they are one pre-token.
ENDS = ".,;:!?"
SIGN_END = re.compile(r"(?:[^\w ]|_)[.,;:!?] ")
WORD_END = re.compile(r"(?<=[^\W_])([.,;:!?])(?= )")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def version(path: str) -> str:
    """Digest of a tokenizer's file and of the library's version."""
    import tokenizers

    return hashlib.sha256(Path(path).read_bytes() + tokenizers.__version__.encode()).hexdigest()


def _stays_letters(head: str) -> bool:
    """Letters that lower-casing and composing leave letters: some, like U+0130, decompose into a letter and a mark."""
    return head.isalpha() and (max(head) < "\u0100" or unicodedata.normalize("NFC", head.lower()).isalpha())


class _Memo(dict):
    """From a piece to its value; a miss asks the library.

    ``before`` goes in front of each piece, and ``letter`` stands for it in the model's alphabet.
    ``folds``: the tokenizer lower-cases. A piece of Latin-1 letters is one pre-token, so the
    model is asked at once; letters and a run of marks are two pre-tokens.
    """

    def __init__(self, path: str, before: str, value, folds: bool):
        super().__init__()
        self.encode, self.model = tokenizer(path).encode, tokenizer(path).model.tokenize
        self.before, self.letter, self.value, self.folds = before, before.replace(" ", "\u0120"), value, folds
        self.path, self.older = path, {}

    def __missing__(self, piece: str):
        got = self.older.get(piece)
        if got is None:
            head = piece.rstrip(MARKS)
            if piece.isalpha() and max(piece) < "\u0100":
                word = piece.lower() if self.folds else piece
                word = word if word.isascii() else word.encode().decode("latin-1").translate(BYTES)
                got = self.value([t.id for t in self.model(self.letter + word)])
            elif head != piece and _stays_letters(head):
                got = self[head] + _memo(self.path, "", self.value, self.folds)[piece[len(head) :]]
            else:
                got = self.value(self.encode(self.before + piece, add_special_tokens=False).ids)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = got
        return got


@lru_cache(maxsize=8)
def _memo(path: str, before: str, value, folds: bool) -> _Memo:
    return _Memo(path, before, value, folds)


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _folded(text: str) -> str:
    """Lower-case, with a space before marks that end a word: the memo meets a word in one form instead of many.

    Only for Latin-1, which lower-cases letter by letter and has nothing to compose, and without
    special strings, which count in their own case only.
    """
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    if "<|" in text:
        return text
    text = f"{text.lower()} "
    if SIGN_END.search(text):
        return WORD_END.sub(r" \1", text)
    for mark in ENDS:
        text = text.replace(f"{mark} ", f" {mark} ")
    return text


def dropped_space_ids(path: str, text: str) -> bytes:
    """Ids, as unsigned 32-bit numbers, for a tokenizer that drops white space (word_bpe_49k)."""
    memo = _memo(path, "", _packed, True)
    return b"".join(map(memo.__getitem__, _folded(text.replace("\n", " ")).split(" ")))


def byte_level_count(path: str, text: str) -> int:
    """Number of ids for a byte-level tokenizer that joins one space to the next word (byte_bpe_50k)."""
    if not text:
        return 0
    first, spaced = _memo(path, "", len, False), _memo(path, " ", len, False)
    if RUN.search(text):
        return sum(spaced[x[1:]] if x[0] == " " and len(x) > 1 and x[1] != " " else first[x] for x in CUT.split(text))
    lines = text.split("\n")  # each line break stands alone between two words, and so is a piece of its own
    count = (len(lines) - 1) * first["\n"] if len(lines) > 1 else 0
    for line in lines:
        head, *rest = line.split(" ")
        count += first[head] + sum(map(spaced.__getitem__, rest))
    return count
