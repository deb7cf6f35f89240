"""License notices by conditional compression (operator 9).

Every template has anchors: words so many that a stretch of text with most of the template's words has one of them at least. The blocks
round the anchors of a text are the candidates. A block that can hold most of a template's words is compressed alone and with the
template as zstandard's raw dictionary; templates are ranked by the bytes that the dictionary saves, against their own size, and each that
saves bytes is compared with the block word by word. The winner is the one with the fewest differences, if most of its words are there; where
a word differs that names a license or its version, the row says so in the license's name. SPDX tags are read as they stand.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .license_texts import PARTIAL, TEMPLATES

#: The share of a template's words that a notice holds at least, how far it reaches from an anchor in template lengths at most, and its differences by the template's words.
WORDS, REACH, DIFFERENCES = 0.8, 1.25, 0.5
#: Words that are too common to be anchors, unless a template has no others.
COMMON = frozenset("a all an and any are as at be by for from if in is it its may no not of on or that the then this to under version which with without you your".split())

_WORD = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*")
#: What numbers an item of a list: it isn't a word of a notice, unless it is a version.
_ITEM, _BEFORE_ITEM, _VERSION_OF = re.compile(r"\(?(?:\d|[a-e]|iv|i{1,3})[.)]\s"), re.compile(r"(?:^|[\n.:;,]|\band|\bor)[^\w\n]*\(?$"), re.compile(r"(?i)\b(?:version|v\.?|licen[sc]e)[\s*#/;-]*$")
#: A tag names its license itself.
_TAG = re.compile(r"(?i:SPDX-License-Identifier):[ \t]*(\(*[ \t]*[A-Za-z0-9][\w.:+-]*(?:[ \t]*\))*(?:[ \t]+(?:AND|OR|WITH|and|or|with)[ \t]+\(*[ \t]*[A-Za-z0-9][\w.:+-]*(?:[ \t]*\))*)*)")
#: Words that name a license or its version, or tell BSD licenses apart: a notice that differs in one isn't that license's. Years aren't versions.
_NAMING = re.compile(
    r"(?!(?:19|20)\d\d$)v?\d+(?:\.\d+)*\+?|[1-4]-clause|by-.*|attribution.*|.*(?:commercial|sharealike|share-alike|noderiv\w*)|lesser|library-general|affero|later|endorse|advertising|mit|mit-0|bsd|isc|zlib|boost|apache|mozilla|eclipse|"
    r"artistic|perl|gnu|cc0?|[al]?gpl.*|mpl.*|epl.*|apache-.*|cc-.*|unlicense|x11|expat"
)
OTHER = " (another version or license)"


def _words(text: str) -> list[tuple[int, int, str]]:
    """(start, end, word) of a text's words: in lower case, versions without a last .0, the name Library General as one, numbers of list items left out."""
    out = []
    for m in _WORD.finditer(text):
        if len(m[0]) < 4 and _ITEM.match(text, m.start()) and _BEFORE_ITEM.search(before := text[max(0, m.start() - 24) : m.start()]) and not _VERSION_OF.search(before):
            continue
        word = m[0].lower()
        if word == "general" and out and out[-1][2] == "library":  # a name; alone it is a kind of software
            out[-1] = (out[-1][0], m.end(), "library-general")
        else:
            out.append((m.start(), m.end(), word[:-2] if re.fullmatch(r"v?\d+\.0", word) else word))
    return out


def names_another(said: str) -> bool:
    """Whether a word that names a license or its version is among the differences."""
    return any(_NAMING.fullmatch(w[1:]) for w in said.split())


@cache
def _tools(template: str) -> tuple[zstandard.ZstdCompressor, list[str]]:
    """A compressor with the template as raw dictionary, and the template's words."""
    raw = zstandard.ZstdCompressionDict(template.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False), [w for _, _, w in _words(template)]


@cache
def _alone() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=9, write_content_size=False, write_checksum=False)


def reduction(window: str, template: str) -> int:
    """Bytes by which the template as dictionary shortens a compressed window."""
    data = window.encode()
    return len(_alone().compress(data)) - len(_tools(template)[0].compress(data))


def size(text: str) -> int:
    return max(1, len(_alone().compress(text.encode())))


class Index:
    """What is known of a set of templates beforehand."""

    def __init__(self, templates: dict[str, str]):
        self.templates = templates
        self.words = {name: _tools(t)[1] for name, t in templates.items()}
        self.times = {name: Counter(words) for name, words in self.words.items()}
        #: Words of each template that a notice may lack.
        self.may_lack = {name: int(len(words) * (1 - WORDS) + 1e-9) for name, words in self.words.items()}
        self.anchors = {name: self._anchors(name) for name in templates}
        vocabulary = sorted({w for words in self.words.values() for w in words})
        self.number = {w: i for i, w in enumerate(vocabulary)}
        self.anchor = np.isin(vocabulary, list(set().union(*self.anchors.values())))
        self.content, self.least = {}, {}
        for name, times in self.times.items():
            content = [w for w in times if w not in COMMON]
            self.content[name] = np.isin(vocabulary, content)
            self.least[name] = max(1, sum(times[w] for w in content) - self.may_lack[name])

    def _anchors(self, name: str) -> set[str]:
        """Words of a template that stand in more of its places than a notice may lack."""
        times, out, places = self.times[name], set(), 0
        for word in sorted((w for w in times if w.isascii() and w.isalpha() and w != "general"), key=lambda w: (w in COMMON, -len(w), w)):
            if places > self.may_lack[name]:
                break
            out.add(word)
            places += times[word]
        return out

    def pattern(self) -> str:
        """Matches a text that has an anchor of a template or an SPDX tag, whatever its case."""
        words = sorted(set().union(*self.anchors.values()))
        by_start = [f"{a}(?:{'|'.join(w[1:] for w in words if w[0] == a)})" for a in sorted({w[0] for w in words})]  # fewer to try at each place
        return "(?i)(?<![a-zA-Z0-9])(?:" + "|".join(by_start) + ")(?![a-zA-Z0-9])|spdx-license-identifier:"

    def candidates(self, words: list[tuple[int, int, str]]) -> dict[int, list[str]]:
        """For each word of a text that is an anchor of any template: the templates of which enough words may stand round it. Words that aren't too common are counted."""
        known = [(i, w[0], self.number[w[2]]) for i, w in enumerate(words) if w[2] in self.number]
        out: dict[int, list[str]] = {}
        if known:
            at, begin, number = (np.array(x) for x in zip(*known))
            mine = np.flatnonzero(self.anchor[number])
            for name, template in self.templates.items():
                total = np.r_[0, np.cumsum(self.content[name][number])]
                if total[-1] >= self.least[name]:
                    low, high = np.searchsorted(begin, begin[mine] - _reach(template)), np.searchsorted(begin, begin[mine] + _reach(template))
                    for i in at[mine[total[high] - total[low] >= self.least[name]]].tolist():
                        out.setdefault(i, []).append(name)
        return out


def _reach(template: str) -> int:
    return int(len(template) * REACH) + 8


def wording(found: list[tuple[int, int, str]], template: str) -> tuple[int, int, float, str] | None:
    """(start, end, share of the template's words found, differences) of a template's best place among words of a text, if any.

    Differences are words that the template has and the text lacks (-) or that stand between its words there (+).
    """
    words, wanted = [w for _, _, w in found], _tools(template)[1]
    blocks = [b for b in SequenceMatcher(None, words, wanted, autojunk=False).get_matching_blocks() if b.size]
    if not blocks:
        return None
    said, i, j = [], blocks[0].a, 0
    for b in blocks:
        said += [f"-{w}" for w in wanted[j : b.b]] + [f"+{w}" for w in words[i : b.a]]
        i, j = b.a + b.size, b.b + b.size
    said += [f"-{w}" for w in wanted[j:]]
    return found[blocks[0].a][0], found[blocks[-1].a + blocks[-1].size - 1][1], sum(b.size for b in blocks) / len(wanted), " ".join(said)


def scan(text: str, index: Index) -> list[tuple[int, int, str, float, int, str]]:
    """Notices in a text: (start, end, license, share of the notice's bytes saved, number of differences, differences), in order, none overlapping."""
    out, done, words, templates = [], 0, _words(text), index.templates
    begins = [w[0] for w in words]
    found = index.candidates(words)
    tags = {m.start(): m for m in _TAG.finditer(text)}
    for at, end_of, names in sorted([(*words[i][:2], names) for i, names in found.items()] + [(m.start(), m.end(), []) for m in tags.values()], key=lambda x: x[:2]):
        if at < done:
            continue
        if tag := tags.get(at):
            done = at + len(tag[0].rstrip())
            out.append((at, done, f"{tag[1].strip()} tag", reduction(text[at:done], text[at:done]) / size(text[at:done]), 0, ""))
            continue
        ranked = []
        for name in names:
            template = templates[name]
            block = words[bisect_left(begins, max(done, at - _reach(template))) : bisect_left(begins, at + _reach(template))]
            if (Counter(w for _, _, w in block) & index.times[name]).total() >= len(index.words[name]) - index.may_lack[name]:  # else no place has so many of them
                saved = reduction(text[block[0][0] : block[-1][1]], template)
                ranked += [(-saved / size(template), name, block)] if saved > 0 else []
        confirmed = []
        for _, name, block in sorted(ranked, key=lambda r: r[:2]):
            template = templates[name]
            place = wording(block, template)
            if place and place[2] >= WORDS and place[0] <= at and place[1] >= end_of:
                n = len(place[3].split())
                if n > max(2, DIFFERENCES * len(index.words[name])):  # the words are there, but among too many others
                    continue
                confirmed.append((names_another(place[3]), name in PARTIAL, n / len(_tools(template)[1]), -len(template), name, place[0], place[1], n, place[3]))
        if confirmed:
            other, _, _, _, name, start, end, n, said = min(confirmed)
            out.append((start, end, name + OTHER * other, reduction(text[start:end], templates[name]) / size(text[start:end]), n, said))
            done = end
    return out


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per notice found: doc_id, start, end (characters), license, saved, differences, wording, exact.

    Every whole text with an anchor of a template is read; others can't hold a notice of the templates. A notice has WORDS of its template's words at least and
    stands within REACH template lengths of each of them. exact: no word differs.
    A notice whose difference names another license or version has OTHER after its template's name; an SPDX tag has its expression and "tag".
    Null and empty texts, empty tables and texts without a notice give no rows; null ids are kept as null; repeated rows give
    repeated rows. Other columns of ``docs`` are not looked at.
    """
    index = Index(TEMPLATES if templates is None else templates)
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).where(F.col("text").rlike(index.pattern()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "start", "end", "license", "saved", "differences", "wording"]
        for batch in batches:
            found = [(i, *hit) for i, text in zip(batch["doc_id"].tolist(), batch["text"]) for hit in scan(text, index)]
            frame = pd.DataFrame(found, columns=names)
            frame["exact"] = frame["differences"] == 0
            frame["doc_id"] = frame["doc_id"].astype(batch["doc_id"].dtype)
            yield frame

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInPandas(run, f"doc_id {kind}, start int, end int, license string, saved double, differences int, wording string, exact boolean")
