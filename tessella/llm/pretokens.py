"""Pre-tokens of a byte-level tokenizer's pattern, found for many texts at once with numpy.

The matches of the pattern cover a text without gaps, so they are given by where each begins. Letters, numbers and white space are
what the tiktoken library's own tables say, which are asked once on the driver for every code point.
"""

from __future__ import annotations

import re

import numpy as np
import tiktoken

#: Fixed value: the pattern whose matches are found here.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes that are worked on at a time, unless a text has no place to cut it at.
PIECE = 1 << 20
#: A code point's entry: its kind in the low bits, then marks of a blank, an apostrophe and the letters of contractions.
_OTHER, _LETTER, _NUMBER, _SPACE, _BLANK, _QUOTE, _PART = 0, 1, 2, 3, 4, 8, 5
#: Behind the first letter, before the blank, begins a token in any text.
_CUT = re.compile(rb"[A-Za-z](?= [A-Za-z])")


def code_points() -> np.ndarray:
    """The entry (uint8) of each code point."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    table = np.zeros(0x110000, np.uint8)
    for kind, name in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        bytes_only = tiktoken.Encoding("kind", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        table[np.frombuffer(bytes(bytes_only.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    table[ord(" ")] |= _BLANK
    table[ord("'")] |= _QUOTE
    for part, letters in enumerate(("stmd", "r", "v", "l", "e"), 1):
        table[[ord(c) for c in letters]] |= part << _PART
    return table


def _begins(entry: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a token begins at each character; ``first`` has the places where texts begin."""
    kind = entry & 3
    begins = np.ones(kind.size, bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins[first] = True
    # White space before other characters of its text: its last character begins a token, which goes on if that is a blank.
    turn = begins[1:] & (kind[:-1] == _SPACE) & (kind[1:] != _SPACE)
    turn[first[first > 0] - 1] = False
    begins[:-1] |= turn
    begins[1:] &= ~(turn & (entry[:-1] & _BLANK > 0))
    # Contractions: the rest of the letters is a token of its own.
    quotes = np.flatnonzero(begins & (entry & _QUOTE > 0))
    inside = np.r_[np.ones(kind.size, bool), np.zeros(4, bool)]
    inside[first] = False
    part, letter = np.r_[entry >> _PART, np.zeros(4, np.uint8)], np.r_[kind == _LETTER, np.zeros(4, bool)]
    one, two = part[quotes + 1], part[quotes + 2]
    short = (one == 1) & inside[quotes + 1]
    long = (((one == 2) | (one == 3)) & (two == 5) | (one == 4) & (two == 4)) & inside[quotes + 1] & inside[quotes + 2]
    for at, n in ((quotes[short], 2), (quotes[long], 3)):
        begins[at + 1] = False
        rest = at + n
        begins[rest[letter[rest] & inside[rest]]] = True
    return begins


def token_starts(raw: bytes, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The bytes at which the tokens begin of texts that stand in ``raw`` (UTF-8) one after another and end at ``ends``."""
    out, pos = [], 0
    begin = np.unique(np.r_[0, ends[:-1]]) if len(ends) else np.zeros(0, np.int64)
    begin = begin[begin < len(raw)]
    while pos < len(raw):
        whole = ends[(ends > pos) & (ends <= pos + PIECE)]
        if whole.size:
            stop = int(whole[-1])
        else:
            last = int(ends[ends > pos][0])
            cut = _CUT.search(raw, pos + PIECE, last)
            stop = cut.end() if cut else last
        piece = raw[pos:stop]
        places = np.flatnonzero(np.frombuffer(piece, np.uint8) & 0xC0 != 0x80)
        entry = table[np.frombuffer(piece.decode().encode("utf-32-le"), np.uint32)]
        first = np.searchsorted(places, begin[(begin >= pos) & (begin < stop)] - pos)
        out.append(places[_begins(entry, first)] + pos)
        pos = stop
    return np.concatenate([np.zeros(0, np.int64), *out])
