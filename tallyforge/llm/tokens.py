"""Token ids as the tokenizers library gives them, several times faster for plain texts.

For texts whose characters all lie below U+0250 or in the general punctuation,
tiktoken with the same vocabulary, pattern and special token gives the same ids
(tests compare them); all other texts go to the tokenizers library itself.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from functools import cached_property, lru_cache

import numpy as np
import regex

#: The special token of the vocabulary; the library takes its string in a text as this token by default.
SPECIAL = {"<|endoftext|>": 50256}
_other = regex.compile(r"[^\x00-ɏ‐-‧‰-⁞]")


class _Unassigned(dict):
    """Whether a character has no Unicode category here; no more entries than there are characters."""

    def __missing__(self, c: str) -> bool:
        self[c] = found = unicodedata.category(c) == "Cn"
        return found


_unassigned = _Unassigned()


def has_unassigned(text: str) -> bool:
    """Whether a text has a character without category: two Unicode versions class only these apart (a test compares all others)."""
    return not text.isascii() and any(map(_unassigned.__getitem__, set(text)))


class Encoder:
    """encode(text) -> uint32 array; lengths only by length(text)."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken

        self.path = path = path or public_tokenizers.path("byte_bpe_50k.json")
        self.pattern = public_tokenizers.PATTERN
        self.fast = self.ranks = None
        ranked = path.removesuffix(".json") + ".tiktoken"
        if path.endswith("byte_bpe_50k.json") and os.path.exists(ranked):
            with open(ranked, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast, self.ranks = tiktoken.Encoding("bytes", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens=SPECIAL), ranks

    @cached_property
    def library(self):
        """The tokenizers library's own reader of the vocabulary; loaded for the first text that needs it."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    @cached_property
    def pieces(self):
        """Encodes a pre-token as it is; None where the vocabulary has no ranks. Made for those alone that ask for it."""
        import tiktoken

        return tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks, special_tokens={}) if self.ranks else None

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and _other.search(text) is None:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def length(self, text: str) -> int:
        return len(self.encode(text))

    def piece_length(self, piece: str) -> int:
        """Tokens of one pre-token; a piece with a character that the pattern's library might class apart is left to the tokenizers library."""
        if has_unassigned(piece):
            return len(self.library.encode(piece, add_special_tokens=False).ids)
        return len(self.pieces.encode_ordinary(piece))


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    """One encoder a worker process and vocabulary."""
    return Encoder(path)
