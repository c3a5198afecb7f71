"""Shared tokenizer helpers for the packing and the encoding operators.

The tokenizers library splits a text into pre-tokens and merges each of them
on its own, so equal pre-tokens always give equal ids. For texts whose
characters all lie in ``SAFE`` the split is done here with the same pattern;
every other text is given to the library whole.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from functools import lru_cache

import regex

# Characters whose letter, number and white-space classes, case and composition are the same for the library
# and for Python (tests/llm/test_tokens.py checks each one): Latin letters, common punctuation, the euro sign.
SAFE = "\\x00-\\x7F\\u00A1-\\u012F\\u0131-\\u017F\\u2010-\\u2027\\u2030-\\u205E\\u20AC"
UNSAFE_CHAR = regex.compile(f"[^{SAFE}]")

# The split patterns of the two vocabularies, as their files state them.
BYTE_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _safe_class(kind: str) -> str:
    """The safe characters of a Unicode category, for a character class of the plain ``re`` module."""
    chars = [c for c in map(chr, range(0x2100)) if UNSAFE_CHAR.match(c) is None]
    found = [c for c in chars if (regex.match(r"\s", c) if kind == "space" else unicodedata.category(c)[0] == kind)]
    return "".join(map(re.escape, found))


# WORD_PATTERN for safe texts: explicit classes make the plain module's split twice as fast.
WORD_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+".format(
    L=_safe_class("L"), N=_safe_class("N"), S=_safe_class("space")))


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a vocabulary file, loaded once per worker; no truncation, no padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def rank_encoding(path: str):
    """The tiktoken encoding of a rank file of the byte-level vocabulary, without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=BYTE_SPLIT.pattern, mergeable_ranks=ranks, special_tokens={})


_PAIRS = ("  ", "\n\n", "\n ", " \n", *"\t\x0b\x0c\r\x1c\x1d\x1e\x1f")
_LONG = regex.compile(r"\s{500}")


def long_space(text: str) -> bool:
    """True when a run of 500 or more white-space characters is in a simple text."""
    return any(p in text for p in _PAIRS) and _LONG.search(text) is not None


def specials(path: str) -> list[str]:
    """The strings that the library reads as one special token."""
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]


def simple(text: str, special: list[str]) -> bool:
    """True when the split here is the library's: safe characters only, no special token inside."""
    return (text.isascii() or UNSAFE_CHAR.search(text) is None) and not any(s in text for s in special)
