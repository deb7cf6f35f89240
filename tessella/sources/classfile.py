"""Facts of class files: a reader of the class file format of the JVM specification, chapter 4, applied to rows of entries."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import FACTS

# Bytes of operands of each opcode that has any; -1 stands for the two switches and wide.
_OPERANDS = {
    **dict.fromkeys([16, 18, *range(21, 26), *range(54, 59), 169, 188], 1),
    **dict.fromkeys([17, 19, 20, 132, *range(153, 169), *range(178, 185), 187, 189, 192, 193, 198, 199], 2),
    197: 3, **dict.fromkeys([185, 186, 200, 201], 4), **dict.fromkeys([170, 171, 196], -1),
}
_SIZES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
JUMPS, RETURNS = {*range(153, 169), 198, 199, 200, 201}, {*range(172, 178)}


class ClassFile:
    """The constant pool of a class file and a cursor over the rest."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 8
        if data[:4] != b"\xca\xfe\xba\xbe":
            raise ValueError("not a class file")
        self.minor, self.major = struct.unpack(">HH", data[4:8])
        self.pool: list = [None] * self.u2()
        i = 1
        while i < len(self.pool):
            tag = self.u1()
            if tag == 1:
                self.pool[i] = (1, self._text(self.take(self.u2())))
            else:
                self.pool[i] = (tag, self.take(_SIZES[tag]))
            i += 2 if tag in (5, 6) else 1

    @staticmethod
    def _text(raw: bytes) -> str:
        """Modified UTF-8: a null in two bytes, supplementary characters as pairs of surrogates."""
        text = raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass")
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def u1(self) -> int:
        return self.take(1)[0]

    def u2(self) -> int:
        return int.from_bytes(self.take(2))

    def u4(self) -> int:
        return int.from_bytes(self.take(4))

    def text(self, i: int) -> str | None:
        return self.pool[i][1] if i else None

    def name(self, i: int) -> str | None:
        """The text that a class, string, module or package constant names."""
        return self.text(int.from_bytes(self.pool[i][1])) if i else None

    def pair(self, i: int) -> tuple[str, str]:
        a, b = struct.unpack(">HH", self.pool[i][1])
        return self.text(a), self.text(b)

    def member(self, i: int) -> tuple[str, str, str]:
        owner, pair = struct.unpack(">HH", self.pool[i][1])
        return (self.name(owner), *self.pair(pair))

    def attributes(self) -> list[tuple[str, bytes]]:
        return [(self.text(self.u2()), self.take(self.u4())) for _ in range(self.u2())]


def instructions(code: bytes) -> Iterator[tuple[int, int, int, list[int]]]:
    """(offset, opcode, operand, jump targets) of bytecode."""
    at = 0
    while at < len(code):
        op, start = code[at], at
        n, targets = _OPERANDS.get(op, 0), []
        if op in (170, 171):
            p = at + 4 - at % 4
            base, first = struct.unpack_from(">ii", code, p)
            if op == 170:
                (high,) = struct.unpack_from(">i", code, p + 8)
                count, p = high - first + 1, p + 12
                targets = [start + base, *(start + x for x in struct.unpack_from(f">{count}i", code, p))]
                at = p + 4 * count
            else:
                targets = [start + base, *(start + struct.unpack_from(">i", code, p + 12 + 8 * k)[0] for k in range(first))]
                at = p + 8 + 8 * first
            yield start, op, 0, targets
            continue
        if op == 196:  # the instruction that it widens counts
            n, op = (5, 132) if code[at + 1] == 132 else (3, code[at + 1])
        operand = int.from_bytes(code[at + 1 : at + 1 + min(n, 2)]) if n > 0 else 0
        if op in JUMPS:
            targets = [start + int.from_bytes(code[at + 1 : at + 1 + n], signed=True)]
        yield start, op, operand, targets
        at += 1 + n


def _skip_value(body: bytes, at: int) -> int:
    """Where an annotation's element value ends."""
    tag, at = chr(body[at]), at + 1
    u2 = lambda k: int.from_bytes(body[k : k + 2])
    if tag == "e":
        return at + 4
    if tag == "@":
        return _skip_annotation(body, at)
    if tag == "[":
        n, at = u2(at), at + 2
        for _ in range(n):
            at = _skip_value(body, at)
        return at
    return at + 2


def _skip_annotation(body: bytes, at: int) -> int:
    n, at = int.from_bytes(body[at + 2 : at + 4]), at + 4
    for _ in range(n):
        at = _skip_value(body, at + 2)
    return at


def annotations(c: ClassFile, attributes: list[tuple[str, bytes]]) -> Iterator[str]:
    """Descriptors of the annotations among attributes, visible ones first."""
    for wanted in ("RuntimeVisibleAnnotations", "RuntimeInvisibleAnnotations"):
        for name, body in attributes:
            if name == wanted:
                at = 2
                for _ in range(int.from_bytes(body[:2])):
                    yield c.text(int.from_bytes(body[at : at + 2]))
                    at = _skip_annotation(body, at)


def facts(archive: str, entry: str, data: bytes) -> Iterator[tuple]:
    """Rows (FACTS) of a class file: class, module, interface, field, method, annotation, instruction, handler and constant kinds."""
    c = ClassFile(data)
    access, owner, parent = c.u2(), c.name(c.u2()), c.name(c.u2())
    row = lambda kind, name=None, desc=None, flags=None, seq=None, op=None, ref=(None, None, None), text=None, targets=None: (archive, entry, kind, owner, name, desc, flags, seq, op, *ref, text, targets)
    yield row("class", parent, None, access, c.major)
    for k in range(c.u2()):
        yield row("interface", c.name(c.u2()), None, None, k)
    handles: list[tuple[str, bytes]] = []
    for kind in ("field", "method"):
        for _ in range(c.u2()):
            flags, name, desc = c.u2(), c.text(c.u2()), c.text(c.u2())
            yield row(kind, name, desc, flags)
            attributes = c.attributes()
            if kind == "method":
                for k, found in enumerate(annotations(c, attributes)):
                    yield row("annotation", name, desc, seq=k, text=found)
            for attribute, body in attributes:
                if attribute == "ConstantValue" and c.pool[int.from_bytes(body)][0] == 8:
                    yield row("string", name, desc, text=c.name(int.from_bytes(body)))
                elif attribute == "Exceptions":
                    for k in range(int.from_bytes(body[:2])):
                        yield row("throws", name, desc, seq=k, text=c.name(int.from_bytes(body[2 + 2 * k : 4 + 2 * k])))
                elif attribute == "Code":
                    handles.append((name + "\0" + desc, body))
    attributes = c.attributes()
    for k, found in enumerate(annotations(c, attributes)):
        yield row("annotation", seq=k, text=found)
    own = dict(attributes)
    if "Module" in own:
        yield row("module", c.name(int.from_bytes(own["Module"][:2])))
    bootstrap = own.get("BootstrapMethods", b"\0\0")
    arguments, p = [], 2
    for _ in range(int.from_bytes(bootstrap[:2])):
        n = int.from_bytes(bootstrap[p + 2 : p + 4])
        arguments.append(struct.unpack_from(f">{n}H", bootstrap, p + 4))
        p += 4 + 2 * n
    for key, body in handles:
        name, desc = key.split("\0")
        size = int.from_bytes(body[4:8])
        code = list(instructions(body[8 : 8 + size]))
        index = {at: k for k, (at, *_) in enumerate(code)}
        for k, (_, op, operand, targets) in enumerate(code):
            ref, text = (None, None, None), None
            if 178 <= op <= 185:
                ref = c.member(operand)
            elif op in (187, 189, 192, 193, 197):
                ref = (c.name(operand), None, None)
            elif op in (18, 19, 20):
                constant = c.pool[operand]
                if constant and constant[0] in (7, 8, 16):
                    text, ref = c.text(int.from_bytes(constant[1])), ({7: "class", 8: "string", 16: "type"}[constant[0]], None, None)
            elif op == 186:
                which, pair = struct.unpack(">HH", c.pool[operand][1])
                ref = (None, *c.pair(pair))
                for a in arguments[which]:
                    if c.pool[a][0] == 15:
                        yield row("handle", name, desc, seq=k, op=c.pool[a][1][0], ref=c.member(int.from_bytes(c.pool[a][1][1:3])))
                    elif c.pool[a][0] in (7, 16):
                        yield row("constant", name, desc, seq=k, text=c.text(int.from_bytes(c.pool[a][1])))
            yield row("instruction", name, desc, seq=k, op=op, ref=ref, text=text, targets=[index[t] for t in targets if t in index])
        p = 8 + size
        for k in range(int.from_bytes(body[p : p + 2])):
            start, end, handler, caught = struct.unpack_from(">HHHH", body, p + 2 + 8 * k)
            yield row("handler", name, desc, seq=k, text=c.name(caught), targets=[index[start], index.get(end, len(code)), index[handler]])


_NAMES = [x.split()[0] for x in FACTS.split(", ")]


def _rows_of(archive: str, entry: str, content: bytes) -> list[tuple]:
    try:
        return list(facts(archive, entry, content))
    except Exception as e:
        return [(archive, entry, "failure", *[None] * 9, f"{type(e).__name__}: {e}", None)]


def _frame(rows: list[tuple], more: tuple[str, ...] = ()) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[*_NAMES, *more]).astype({"access": "Int32", "seq": "Int32", "opcode": "Int32"})


def class_facts(entries: DataFrame) -> DataFrame:
    """FACTS of every class entry, and a row of kind ``failure`` (text: what is wrong) for each that can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, entry, content in zip(batch["archive_path"], batch["entry"], batch["content"]):
                yield _frame(_rows_of(archive, entry, bytes(content)))

    classes = entries.where(F.col("entry").endswith(".class")).select("archive_path", "entry", "content")
    return classes.repartition("archive_path", "entry").mapInPandas(run, FACTS)


#: What is read of an archive in one pass: FACTS, and besides them each class's place (kind ``entry``, seq), other entries (``resource``, with what content may be text) and failures of archives.
PARSED = f"{FACTS}, content binary, error_type string, message string"


def parsed(entries: DataFrame, largest: int) -> DataFrame:
    """PARSED of entries with error_type and message, where they are unzipped: no class file is shuffled. Contents over ``largest`` bytes or with a null byte are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = (None,) * (len(_NAMES) - 3)
        for batch in batches:
            for archive, entry, ord_, content, error, message in zip(*[batch[c] for c in ("archive_path", "entry", "ord", "content", "error_type", "message")]):
                if error is not None:
                    rows = [(archive, None, "unread", *none, None, error, message)]
                elif not entry.endswith(".class"):
                    data = bytes(content)
                    rows = [(archive, entry, "resource", *none, data if len(data) <= largest and b"\0" not in data else None, None, None)]
                else:
                    place = (archive, entry, "entry", None, None, None, None, int(ord_), *none[5:])
                    rows = [(*r, None, None, None) for r in (place, *_rows_of(archive, entry, bytes(content)))]
                yield _frame(rows, ("content", "error_type", "message"))

    return entries.mapInPandas(run, PARSED)
