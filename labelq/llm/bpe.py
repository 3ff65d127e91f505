"""Pre-tokens of a byte-level BPE file, and the ids of one pre-token.

Every pre-token stands alone: merges never cross its ends, so the ids of a text are the ids of its
pre-tokens in order. Texts of Latin letters are split by one compiled pattern; any other text is
split by the tokenizers library itself, whose character classes are then the ones that count.
Special strings inside a text stay one unit, as the library treats them by default.
"""

from __future__ import annotations

import os
import re

LATIN_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
LATIN_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_SPACES = "\t-\r \x85\xa0"
BEYOND_LATIN = re.compile("[^\x00-\u017f]")
# The branches of the file's own pattern, written for Latin letters; letters come first, as no two branches
# but the contractions can start alike, and those start with an apostrophe.
LATIN_SPLIT = re.compile(
    f" ?[{LATIN_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{LATIN_NUMBERS}]+| ?[^{LATIN_SPACES}{LATIN_LETTERS}{LATIN_NUMBERS}]+"
    f"|[{LATIN_SPACES}]+(?![^{LATIN_SPACES}])|[{LATIN_SPACES}]+")

#: Pre-tokens a worker remembers; beyond it the memory is emptied and filled again, results stay the same.
REMEMBERED = 600_000


def byte_letters() -> dict[int, str]:
    """The printable letter a byte-level vocabulary writes for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ByteLevel:
    """One tokenizer file in a worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.before = self.tokenizer.pre_tokenizer
        if self.tokenizer.normalizer is not None or "ByteLevel" not in type(self.before).__name__:
            raise ValueError(f"{path}: only byte-level BPE files without a normaliser split into independent pre-tokens")
        self.letters = byte_letters()
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.vocabulary = self.tokenizer.get_vocab_size()

    def pieces(self, text: str) -> list[str]:
        if self.cut is not None and self.cut.search(text):
            parts = self.cut.split(text)
            return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text:
            return []
        if BEYOND_LATIN.search(text) is None:
            return LATIN_SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.before.pre_tokenize_str(text)]

    def ids(self, piece: str) -> list[int]:
        if piece in self.special:
            return [self.special[piece]]
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]


_OPEN: dict[str, ByteLevel] = {}


def opened(path: str) -> ByteLevel:
    """The tokenizer of this worker; a file is read once per worker process."""
    if path not in _OPEN:
        _OPEN[path] = ByteLevel(path)
    return _OPEN[path]
