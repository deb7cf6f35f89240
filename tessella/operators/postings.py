"""Search of texts by trigrams: what a pattern must hold literally picks the texts that are read at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Trigrams of a pattern that are looked up at most; a few of them rule out as much as all do.
LOOKED_UP = 16


def folded(text: Column) -> Column:
    """A text with A-Z in lower case, as searches without regard to case compare letters."""
    return F.translate(text, _UPPER, _UPPER.lower())


def grams(text: Column) -> Column:
    """The distinct trigrams of a folded text, line ends among them."""
    return F.array_distinct(F.regexp_extract_all(folded(text), F.lit("(?s)(?=(...))"), F.lit(1)))


def postings(texts: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(more, gram, id_col) of each text's trigrams."""
    return texts.where(F.length(text_col) > 2).select(*more, F.explode(grams(F.col(text_col))).alias("gram"), id_col)


def literals(query: str, mode: str = "plain") -> list[str]:
    """Stretches that every text that a pattern matches holds as they stand; none where that can't be told.

    Of a regex these are the literal characters outside groups and classes, up to one that a quantifier makes optional; a pattern with alternatives or inline options has none.
    """
    if mode == "wildcard":
        return [x for x in query.replace("?", "*").split("*") if x]
    if mode != "regex":
        return [query]
    if "|" in query or "(?" in query or "\\Q" in query:
        return []
    out, run, depth, i = [], "", 0, 0

    def end():
        nonlocal run
        out.append(run)
        run = ""

    while i < len(query):
        c = query[i]
        if c == "\\":
            c, known = query[i + 1 : i + 2], not query[i + 1 : i + 2].isalnum()
            # What follows a class or a reference may belong to it, as in \\x41 or \\p{L}: nothing after it counts.
            if not known and c not in "dDwWsSbBtnrfAzZ":
                break
            i += 2
            if known and not depth:
                run += c
            else:
                end()
            continue
        if c == "[":
            # To its end; a class inside a class is too rare to follow.
            close = query.find("]", i + 2 + (query[i + 1 : i + 2] == "^"))
            if close < 0 or "[" in query[i + 1 : close] or "\\" in query[i + 1 : close]:
                break
            end()
            i = close + 1
            continue
        i += 1
        if c in "()":
            depth += 1 if c == "(" else -1
            end()
        elif c in "*?{":
            run = run[:-1]
            end()
            if c == "{":
                i = max(i, query.find("}", i) + 1)
        elif c in ".^$+":
            end()
        elif not depth:
            run += c
    end()
    return [x for x in out if x]


def literal_grams(query: str, mode: str = "plain") -> list[str]:
    """Trigrams that a text must hold to be matched by a pattern, LOOKED_UP of them at most, spread over it; none if it has no three literal characters together."""
    lower = str.maketrans(_UPPER, _UPPER.lower())
    found = sorted({x[k : k + 3] for part in literals(query, mode) for x in [part.translate(lower)] for k in range(len(x) - 2)})
    return found[:: -(-len(found) // LOOKED_UP)] if found else []


def holding(posted: DataFrame, wanted: list[str], id_col: str) -> DataFrame:
    """The ids (distinct) of texts that hold all ``wanted`` trigrams."""
    some = posted.where(F.col("gram").isin(wanted))
    return some.groupBy(id_col).agg(F.count_distinct("gram").alias("_n")).where(F.col("_n") == len(wanted)).select(id_col)
