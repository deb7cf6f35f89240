"""JVM descriptors as readable types, in batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The letters of primitive types.
_PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}


def types(descriptor: str) -> list[str]:
    """The types of a run of field descriptors, with dots and brackets."""
    out, at = [], 0
    while at < len(descriptor):
        depth = 0
        while descriptor[at] == "[":
            at, depth = at + 1, depth + 1
        if descriptor[at] == "L":
            end = descriptor.index(";", at)
            name, at = descriptor[at + 1 : end].replace("/", "."), end + 1
        else:
            name, at = _PRIMITIVES[descriptor[at]], at + 1
        out.append(name + "[]" * depth)
    return out


def readable(descriptor: str | None, short: bool = False) -> str | None:
    """``(int, java.lang.String): void`` for a method, the type for a field; one that can't be read stays as it is."""
    cut = (lambda t: t.rsplit(".", 1)[-1]) if short else (lambda t: t)
    try:
        if descriptor and descriptor.startswith("("):
            inside, _, result = descriptor[1:].partition(")")
            return f"({', '.join(map(cut, types(inside)))}): {cut(types(result)[0])}"
        return cut(types(descriptor)[0]) if descriptor else descriptor
    except (IndexError, KeyError, ValueError):
        return descriptor


@F.pandas_udf(StringType())
def display_type(descriptor: pd.Series) -> pd.Series:
    return descriptor.map(readable)


@F.pandas_udf(StringType())
def short_signature(descriptor: pd.Series) -> pd.Series:
    return descriptor.map(lambda d: readable(d, short=True))
