"""Byte-level BPE over texts with pieces worked out once per distinct pre-token.

A text is cut before every blank that a non-space follows; no pre-token of the vocabulary's pattern
crosses such a place, so the parts ("chunks") can be kept with what was found for them. The one
exception, a blank between two white-space characters, is noticed while the chunks are looked up and
the text is then taken through the pattern as a whole.
"""

from __future__ import annotations

import base64

import regex

SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
#: Entries that a worker keeps at most; a full cache is emptied, which costs time and nothing else.
CACHE = 1 << 18


class OddSpaces(Exception):
    """A blank stands between white space: chunks are no units here."""


def pattern(public_tokenizers=None) -> regex.Pattern:
    if public_tokenizers is None:
        import public_tokenizers
    return regex.compile(public_tokenizers.PATTERN)


class ChunkCache(dict):
    """chunk -> make(the chunk's pre-tokens, a blank before the first one)."""

    def __init__(self, split, make):
        super().__init__()
        self.split, self.make = split, make

    def __missing__(self, chunk: str):
        if not chunk or chunk[0].isspace():
            raise OddSpaces
        value = self.make(self.split(" " + chunk))
        if "\n" not in chunk:  # most of these occur once
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = value
        return value

    def of(self, text: str) -> list:
        """The values of a text's parts, in order."""
        first, *rest = text.split(" ")
        trailing = rest and not rest[-1]
        try:
            found = [self.make(self.split(first))] if first else []
            if trailing:  # the text ends with a blank, a pre-token of its own unless white space precedes it
                rest.pop()
                before = rest[-1] if rest else first
                if not before or before[-1].isspace():
                    raise OddSpaces
            found.extend(map(self.__getitem__, rest))
            if trailing:
                found.append(self.make([" "]))
            return found
        except OddSpaces:
            return [self.make(self.split(text))]


def segments(text: str) -> list[str]:
    """The parts of a text between the special token's strings, which count as one token each."""
    return text.split(SPECIAL)


def piece_ids(path: str):
    """bytes of a pre-token -> ids, from a file of ranks."""
    import tiktoken

    import public_tokenizers

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding._core_bpe.encode_single_piece
