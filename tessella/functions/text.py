"""Column functions over names, paths, lines and descriptors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ARCHIVE = r"\.(jar|war|zip|jmod|aar|ear|kar|apk|dex)$"
#: Access flag bits and their names, in the order in which they are listed.
FLAGS = {
    0x0001: "public", 0x0002: "private", 0x0004: "protected", 0x0008: "static", 0x0010: "final", 0x0400: "abstract",
    0x0200: "interface", 0x4000: "enum", 0x1000: "synthetic", 0x2000: "annotation", 0x10000: "record",
}
#: Signs of output that is not usable, in lower case, and literal ones.
FAILURES = ("exception decompiling", "couldn't be decompiled", "could not be decompiled", "failed to decompile", "unable to decompile")
LITERAL_FAILURES = ("// INTERNAL ERROR", "Decompilation failed at line #")
#: A dotted name of at least two parts, not preceded by a name character, dollar or slash.
QUALIFIED = r"(?<![\w$/])(?:[A-Za-z_$][\w$]*\.)+[A-Za-z_$][\w$]*(?:\$[A-Za-z_$][\w$]*)*"


#: Other names of decompilers, by the name that they have here.
ENGINES = {
    "auto": ("auto",), "jd-core-v1": ("jd-core", "jd-core-v1", "jdcore", "jd"), "jd-core-v0": ("jd-core-v0", "jdcore-v0", "v0"), "cfr": ("cfr",), "procyon": ("procyon",),
    "fernflower": ("fernflower", "ff"), "vineflower": ("vineflower", "vf"), "jadx": ("jadx",),
}


def engine_name(requested: Column) -> Column:
    """A decompiler's name for any name of it, in any case; auto where none is asked for, null for an unknown one."""
    names = F.create_map(*[F.lit(x) for name, others in ENGINES.items() for other in others for x in (other, name)])
    return F.when(requested.isNull() | (F.trim(requested) == ""), "auto").otherwise(F.try_element_at(names, F.lower(requested)))


def checked_path(path: str) -> str:
    """A path from outside without white space round it; ValueError if it is empty, has control characters or leads upwards."""
    path = path.strip()
    if not path or any(ord(c) < 32 or 127 <= ord(c) < 160 for c in path) or ".." in re.split(r"[/\\\\]", path):
        raise ValueError(f"bad path: {path!r}")
    return path


def match(col: str | Column, query: str, mode: str = "plain", case_sensitive: bool = False) -> Column:
    """Whether a text holds ``query`` anywhere: ``plain`` as it stands, ``wildcard`` with * and ?, or ``regex``; other modes are plain."""
    col = F.col(col) if isinstance(col, str) else col
    if mode == "regex":
        pattern = query
    elif mode == "wildcard":
        pattern = "".join({"*": ".*", "?": "."}.get(c) or (rf"\{c}" if re.match(r"[^\w\s]", c) else c) for c in query)
    elif case_sensitive:
        return col.contains(query)
    else:
        pattern = re.sub(r"([^\w\s])", r"\\\1", query)
    return col.rlike(pattern if case_sensitive else f"(?i){pattern}")


def glob(col: Column, pattern: str) -> Column:
    """Whether a file name matches a glob of *, ? and {a,b}, as a whole."""
    out = "".join({"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}.get(c) or re.escape(c) for c in pattern)
    return col.rlike(f"^{out}$")


def display_name(owner: Column) -> Column:
    return F.translate(owner, "/", ".")


def internal_name(name: Column) -> Column:
    """A class name or entry path as internal name: slashes, without the suffix and the roots of web and boot archives."""
    n = F.regexp_replace(F.translate(name, "\\", "/"), r"\.class$", "")
    return F.translate(F.regexp_replace(n, r"^(BOOT-INF/classes/|WEB-INF/classes/|classes/)", ""), ".", "/")


def package_of(display: Column) -> Column:
    return F.when(F.instr(display, ".") > 0, F.regexp_replace(display, r"\.[^.]*$", "")).otherwise("(default)")


def flag_names(access: Column) -> Column:
    """Names of the set access flags, in their fixed order, as an array."""
    return F.array_compact(F.array(*[F.when(access.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in FLAGS.items()]))


def resource_type(entry: Column) -> Column:
    """Kind of a resource by its path; null if it is none that is indexed."""
    e = F.lower(F.translate(entry, "\\", "/"))
    return (
        F.when(e.startswith("meta-inf/services/"), "service").when(e == "meta-inf/manifest.mf", "manifest").when(e.endswith(".xml"), "xml")
        .when(e.endswith(".properties"), "properties").when(e.endswith(".json"), "json").when(e.rlike(r"\.ya?ml$"), "yaml").when(e.rlike(r"\.(txt|md|conf|cfg|ini)$"), "text")
    )


def relaxed_key(key: Column) -> Column:
    """A member's key in which types have lost their packages: what it still has where a package could not be told."""
    return F.regexp_replace(key, r"L(?:\w+/)+", "L")


def object_types(descriptor: Column) -> Column:
    """Object types of a descriptor, the return type of a method first, then its arguments; arrays count as their elements."""
    found = F.regexp_extract_all(descriptor, F.lit(r"L([^;]+);"), F.lit(1))
    returned = F.regexp_extract(descriptor, r"\)\[*L([^;]+);$", 1)
    return F.when(returned != "", F.concat(F.array(returned), F.slice(found, F.lit(1), F.size(found) - 1))).otherwise(found)


def usable(text: Column) -> Column:
    """Output that is not blank and has no sign of failure."""
    bad = F.lit(False)
    for sign in FAILURES:
        bad = bad | F.lower(text).contains(sign)
    for sign in LITERAL_FAILURES:
        bad = bad | text.contains(sign)
    return text.isNotNull() & (F.trim(text) != "") & ~bad


def failure_category(message: Column) -> Column:
    """Kind of a failure, by the first sign in its message."""
    m = F.lower(message)
    return (
        F.when(message.isNull() | (F.trim(message) == ""), "unknown").when(m.contains("class not found"), "class_not_found").when(m.contains("empty output"), "empty_output")
        .when(m.contains("unsupported"), "unsupported").when(m.contains("jadx") | m.contains("android native") | m.contains("dex2jar"), "android_native")
        .when(m.contains("patch"), "patch").otherwise("other")
    )


def version_key(version: Column) -> Column:
    """A key that sorts as versions do: part by part, numbers by value and above text, parts that one lacks as zero; then by the text in any case.

    As any version goes on with zeros, each part stands with the zeros before it: text after more zeros is later, a number after
    more zeros earlier, and the end lies between the two.
    """
    parts = F.filter(F.split(F.lower(version), r"[._-]"), lambda p: F.trim(p) != "")
    number = lambda p: F.when(p.rlike(r"^\d+$"), p.try_cast("long"))
    part = lambda side, zeros, value, text: F.struct(side.alias("side"), zeros.alias("zeros"), value.alias("value"), text.alias("text"))
    none = F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("zeros"), F.array().cast("array<struct<side:int,zeros:int,value:bigint,text:string>>").alias("out"))

    def add(state: Column, p: Column) -> Column:
        n, zeros = number(p), state["zeros"]
        said = F.when(n.isNull(), part(F.lit(0), zeros, none, p)).otherwise(part(F.lit(2), -zeros, F.coalesce(n, none), F.lit("")))
        zero = F.coalesce(n == 0, F.lit(False))
        return F.struct(F.when(zero, zeros + 1).otherwise(0).alias("zeros"), F.when(zero, state["out"]).otherwise(F.concat(state["out"], F.array(said))).alias("out"))

    end = F.array(part(F.lit(1), F.lit(0), none, F.lit("")))
    return F.struct(F.concat(F.aggregate(parts, start, add)["out"], end).alias("parts"), F.lower(version).alias("raw"))


def newest_first_key(version: Column) -> Column:
    """A key that sorts as :func:`version_key` does, but from the newest version down: numbers negative, texts by their code points from above."""
    key, last = version_key(version), F.array(F.lit(0x110001))
    down = lambda t: F.concat(F.transform(F.split(t, ""), lambda c: F.lit(0x110000) - F.ascii(c)), last)
    part = lambda p: F.struct((-p["side"]).alias("side"), (-p["zeros"]).alias("zeros"), (-p["value"]).alias("value"), down(p["text"]).alias("text"))
    return F.struct(F.transform(key["parts"], part).alias("parts"), down(key["raw"]).alias("raw"))


def artifact_key(name: Column) -> Column:
    """A file name up to its version: what stands before the first hyphen that a digit follows."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.when(stem.rlike(r"-\d"), F.regexp_extract(stem, r"^(.*?)-\d", 1)).otherwise(stem)


def artifact_version(name: Column) -> Column:
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.when(stem.rlike(r"-\d"), F.regexp_extract(stem, r"^.*?-(\d.*)$", 1)).otherwise("")


def inferred_coordinates(name: Column) -> Column:
    """STRUCT(group_id, artifact_id, version, packaging) of an archive's file name; without a version in it, a local one that is made up."""
    packaging = F.lower(F.regexp_extract(name, r"\.([A-Za-z]+)$", 1))
    version = artifact_version(name)
    return F.struct(
        F.lit("local.inferred").alias("group_id"), artifact_key(name).alias("artifact_id"), F.when(version == "", "0.0.0-local").otherwise(version).alias("version"),
        F.when(packaging == "", "jar").otherwise(packaging).alias("packaging"),
    )


def first_matching_line(text: Column, hit) -> Column:
    """STRUCT(line, snippet) of the first line for which ``hit`` (of a column) holds, counted from 1; null if none."""
    lines = F.split(text, r"\R", -1)
    at = F.array_position(F.transform(lines, hit), True)
    return F.when(at > 0, F.struct(at.cast("long").alias("line"), F.trim(F.element_at(lines, at.cast("int"))).alias("snippet")))


#: Endings of archives that may have their sources beside them.
SOURCED = r"\.(jar|war|zip|aar|jmod)$"


def sources_sibling(name: Column) -> Column:
    """The name under which an archive's sources usually stand beside it; null for what has none."""
    return F.when(name.rlike(SOURCED), F.regexp_replace(name, SOURCED, "-sources.jar"))


#: A cast of a string or character literal to its own type.
LITERAL_CAST = r"""\((?:java\.lang\.)?(?:String\)\s*("(?:[^"\\]|\\.)*")|char\)\s*('(?:[^'\\]|\\.)'))"""


def without_literal_casts(source: Column) -> Column:
    """STRUCT(text, removed): source text without casts of literals, and how many there were."""
    return F.struct(F.regexp_replace(source, LITERAL_CAST, "$1$2").alias("text"), F.regexp_count(source, F.lit(LITERAL_CAST)).cast("long").alias("removed"))


def checksum_line(line: Column) -> Column:
    """STRUCT(checksum, file) of a line of a checksum list, whether in text or in binary (``*``) form."""
    return F.struct(F.lower(F.regexp_extract(line, r"^([0-9A-Fa-f]+)\s+", 1)).alias("checksum"), F.regexp_extract(line, r"^[0-9A-Fa-f]+\s+\*?(.*)$", 1).alias("file"))


def utf8_text(content: Column) -> Column:
    """Bytes as text. Those that are not UTF-8 count as U+FFFD each, where a strict decoder would end the job for one file."""
    return F.make_valid_utf8(content.cast("string"))


#: Lines of a property file: a comment, or a line (group 1) with those that its last backslashes join to it. All repetitions are possessive, which Java runs without recursion.
PROPERTY_LINE = r"(?:\A|(?<=\n))(?:[ \t\f]|\\\n(?!\z))*+(?:[#!][^\n]*+|([^\\\n]*+(?:\\[\s\S][^\\\n]*+)*+(?:\\\z)?+))"
#: Key and value of a line whose parts have been joined.
PROPERTY = r"\A([^\\=: \t\f]*+(?:\\[\s\S][^\\=: \t\f]*+)*+)[ \t\f]*+[=:]?[ \t\f]*+([\s\S]*+)"
#: Pieces of a key or value: runs of escaped code units that make whole characters, half of a surrogate pair, another escape, plain text.
UNITS = r"(?:\\u(?:[Dd][89ABab][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2}|(?![Dd][89A-Fa-f])[0-9A-Fa-f]{4}))++"
PROPERTY_PIECE = UNITS + r"|\\u[0-9A-Fa-f]{4}|\\[\s\S]|[^\\]++"


def _unescaped(text: Column) -> Column:
    """A key or value without its escapes; null if a code unit is not four hexadecimal digits."""
    letters = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}

    def plain(p: Column) -> Column:
        units = F.unhex(F.replace(p, F.lit("\\u"), F.lit("")))
        out = F.when(~p.startswith("\\"), p).when(p.rlike(rf"\A{UNITS}\z"), F.decode(units, "UTF-16BE")).when(p == "\\u", F.lit(None)).when(p.startswith("\\u"), F.lit("\ufffd"))
        for letter, char in letters.items():
            out = out.when(p == f"\\{letter}", char)
        return out.otherwise(F.substr(p, F.lit(2)))

    pieces = F.transform(F.regexp_extract_all(text, F.lit(PROPERTY_PIECE), F.lit(0)), plain)
    return F.when(~F.exists(pieces, lambda p: p.isNull()), F.array_join(pieces, ""))


def properties(text: Column) -> Column:
    """ARRAY<STRUCT(key, value)> of a property file's text, in its order; null if an escape in it is malformed.

    Comments and blank lines are none; a line that ends in an odd number of backslashes goes on in the next one, without its leading blanks. A key ends
    at a blank, an equals sign or a colon without a backslash; the blanks round that are dropped, those that end a value are not.
    """
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    lines = F.filter(F.regexp_extract_all(unix, F.lit(PROPERTY_LINE), F.lit(1)), lambda x: x != "")
    joined = F.transform(lines, lambda x: F.regexp_replace(x, r"(\\[^\n])|\\\n[ \t\f]*+", "$1"))
    part = lambda x, k: _unescaped(F.regexp_extract(x, PROPERTY, k))
    pairs = F.transform(joined, lambda x: F.struct(part(x, 1).alias("key"), part(x, 2).alias("value")))
    return F.when(~F.exists(pairs, lambda p: p["key"].isNull() | p["value"].isNull()), pairs)


def property_value(pairs: Column, key: str) -> Column:
    """The value of a key in ``pairs`` of :func:`properties`: its last one; null without any."""
    return F.try_element_at(F.filter(pairs, lambda p: p["key"] == key), F.lit(-1))["value"]
