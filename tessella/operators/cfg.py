"""Control-flow graphs from an instruction relation (method, idx, op, kind, targets): blocks, edges and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Opcodes that a block's label shows.
SHOWN = 3


def _names() -> dict[int, str]:
    """The mnemonic of each opcode as the JVM specification has them; forms that differ in the width or the place of their operand have one name."""
    # Mnemonics in the order of their opcodes, those of families by the letters of their types.
    kinds = "I L F D A".split()
    runs = {
        0: "NOP ACONST_NULL ICONST_M1 ICONST_0 ICONST_1 ICONST_2 ICONST_3 ICONST_4 ICONST_5 LCONST_0 LCONST_1 FCONST_0 FCONST_1 FCONST_2 DCONST_0 DCONST_1 BIPUSH SIPUSH LDC LDC LDC".split(),
        87: "POP POP2 DUP DUP_X1 DUP_X2 DUP2 DUP2_X1 DUP2_X2 SWAP".split(),
        96: [k + op for op in ("ADD", "SUB", "MUL", "DIV", "REM", "NEG") for k in kinds[:4]],
        120: [k + op for op in ("SHL", "SHR", "USHR", "AND", "OR", "XOR") for k in kinds[:2]],
        132: ["IINC", *[f"{a}2{b}" for a in kinds[:4] for b in kinds[:4] if a != b], "I2B", "I2C", "I2S", "LCMP", "FCMPL", "FCMPG", "DCMPL", "DCMPG"],
        153: [p + c for p in ("IF", "IF_ICMP") for c in ("EQ", "NE", "LT", "GE", "GT", "LE")] + ["IF_ACMPEQ", "IF_ACMPNE", "GOTO", "JSR", "RET", "TABLESWITCH", "LOOKUPSWITCH"],
        172: [*[k + "RETURN" for k in kinds], "RETURN", *[op + where for where in ("STATIC", "FIELD") for op in ("GET", "PUT")], *["INVOKE" + how for how in ("VIRTUAL", "SPECIAL", "STATIC", "INTERFACE", "DYNAMIC")]],
        187: "NEW NEWARRAY ANEWARRAY ARRAYLENGTH ATHROW CHECKCAST INSTANCEOF MONITORENTER MONITOREXIT WIDE MULTIANEWARRAY IFNULL IFNONNULL GOTO JSR".split(),
    }
    # Loads and stores: with an operand, for each of the first four variables, and of arrays.
    for first, op in ((21, "LOAD"), (54, "STORE")):
        runs[first] = [k + op for k in kinds] + [k + op for k in kinds for _ in range(4)] + [k + "A" + op for k in [*kinds, "B", "C", "S"]]
    return {start + i: name for start, run in runs.items() for i, name in enumerate(run)}


NAMES = _names()


def opcode_name(op: str | Column) -> Column:
    """An opcode's mnemonic."""
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    op = F.col(op) if isinstance(op, str) else op
    return F.coalesce(F.try_element_at(names, op), F.concat(F.lit("unknown_"), op.cast("string")))


def from_facts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instructions, handlers) of class files' facts; method is ``owner#name`` and descriptor, op the opcode's name."""
    method = F.concat("owner", F.lit("#"), "name", "descriptor")
    op = F.col("opcode")
    kind = (
        F.when(op.isin(167, 200), "goto").when(op.between(153, 168) | op.isin(198, 199, 201), "jump").when(op.isin(170, 171), "switch")
        .when(op.between(172, 177), "return").when(op == 191, "throw").otherwise("plain")
    )
    long = lambda c: F.col(c).cast("array<bigint>")
    code = facts.where("kind = 'instruction'").select(method.alias("method"), F.col("seq").cast("long").alias("idx"), opcode_name(op).alias("op"), kind.alias("kind"), long("targets").alias("targets"))
    at = long("targets")
    handlers = facts.where("kind = 'handler'").select(method.alias("method"), at[0].alias("start"), at[1].alias("end"), at[2].alias("handler"), F.col("text").alias("type"), F.col("seq").cast("long").alias("ord"))
    return code, handlers


def blocks(instructions: DataFrame) -> DataFrame:
    """Instructions with their block: a method's first, a jump's or switch's targets and what follows it each start one.

    Expects (method, idx, op, kind, targets) with kind one of jump, goto, switch, return, throw and plain; the first target of a switch is its default.
    """
    order = Window.partitionBy("method").orderBy("idx")
    led = instructions.select("method", F.explode("targets").alias("idx")).distinct().withColumn("_target", F.lit(True))
    marked = instructions.join(led, ["method", "idx"], "left").withColumn("_before", F.lag("kind").over(order))
    leader = F.col("_before").isNull() | F.coalesce("_target", F.lit(False)) | F.col("_before").isin("jump", "goto", "switch")
    return marked.withColumn("block", F.sum(leader.cast("int")).over(order).cast("long") - 1).drop("_target", "_before")


def edges(blocked: DataFrame) -> DataFrame:
    """(method, from_block, to_block, kind, place) with one edge for each pair of blocks, the first by place: blocks in order, of each its jump before the fallthrough, its default before cases."""
    last = blocked.groupBy("method", "block").agg(F.max(F.struct("idx", "kind", "targets")).alias("t"))
    at = blocked.select("method", "idx", F.col("block").alias("to_block"))
    kind = F.when(F.col("tail") != "switch", "jump").when(F.col("ord") == 0, "default").otherwise("case")
    jumps = last.select("method", F.col("block").alias("from_block"), F.col("t.kind").alias("tail"), F.posexplode("t.targets").alias("ord", "idx")).join(at, ["method", "idx"])
    jumps = jumps.select("method", "from_block", "to_block", kind.alias("kind"), _place(0, F.col("from_block"), F.col("ord")))
    following = blocked.groupBy("method").agg(F.max("block").alias("end"))
    falls = last.where(F.col("t.kind").isin("plain", "jump")).join(following, "method").where(F.col("block") < F.col("end"))
    falls = falls.select("method", F.col("block").alias("from_block"), (F.col("block") + 1).alias("to_block"), F.lit("fallthrough").alias("kind"), _place(0, F.col("block"), F.lit(1)))
    return _first(jumps.unionByName(falls))


def _place(phase: int, a: Column, b: Column) -> Column:
    """Where an edge stands in the order of discovery."""
    return F.struct(F.lit(phase).alias("phase"), a.cast("long").alias("a"), b.cast("long").alias("b")).alias("place")


def _first(found: DataFrame) -> DataFrame:
    """Of the edges between two blocks the first."""
    one = found.groupBy("method", "from_block", "to_block").agg(F.min(F.struct("place", "kind")).alias("e"))
    return one.select("method", "from_block", "to_block", "e.kind", "e.place")


def exception_edges(blocked: DataFrame, handlers: DataFrame) -> DataFrame:
    """Edges (as :func:`edges` has them) of the blocks from that of ``start`` up to the one before that of ``end`` (the last one, if nothing stands there) to the handler's block.

    Expects (method, start, end, handler, type, ord), ord the handlers' order; kind is exception, or finally where the handler has no type.
    """
    where = blocked.select("method", "idx", "block")
    place = lambda c: where.select("method", F.col("idx").alias(c), F.col("block").alias(f"_{c}"))
    end = blocked.groupBy("method").agg(F.max("block").alias("_last"))
    spans = handlers.join(place("start"), ["method", "start"]).join(place("handler"), ["method", "handler"]).join(place("end"), ["method", "end"], "left").join(end, "method")
    stop = F.when(F.col("_end").isNull(), F.col("_last")).otherwise(F.greatest(F.col("_start"), F.col("_end") - 1))
    kind = F.when(F.col("type").isNull(), "finally").otherwise("exception")
    found = spans.select("method", F.explode(F.sequence("_start", stop)).alias("from_block"), F.col("_handler").alias("to_block"), kind.alias("kind"), "ord")
    return _first(found.select("method", "from_block", "to_block", "kind", _place(1, F.col("ord"), F.col("from_block"))))


def all_edges(blocked: DataFrame, handlers: DataFrame) -> DataFrame:
    """Edges of control flow and then of exceptions; between two blocks only the first."""
    return _first(edges(blocked).unionByName(exception_edges(blocked, handlers)))


def labels(blocked: DataFrame) -> DataFrame:
    """(method, block, label): the first SHOWN opcodes of a block with their places."""
    ops = F.slice(F.array_sort(F.collect_list(F.struct("idx", F.col("op").cast("string").alias("op")))), 1, SHOWN)
    return blocked.groupBy("method", "block").agg(F.array_join(F.transform(ops, lambda o: F.concat(o["idx"].cast("string"), F.lit(": "), o["op"])), "\\n").alias("label"))


def _diagram(edge: DataFrame, label: DataFrame, head: str, node: str, arrow: str, tail: list[str]) -> DataFrame:
    """(method, diagram): nodes by number and then edges by their place, between the first and last lines."""
    text = F.replace(F.col("label"), F.lit('"'), F.lit("'"))
    nodes = label.groupBy("method").agg(F.array_sort(F.collect_list(F.struct("block", F.format_string(node, F.col("block"), text).alias("line")))).alias("nodes"))
    line = F.format_string(arrow, F.col("from_block"), F.col("kind"), F.col("to_block"))
    arrows = edge.groupBy("method").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("arrows"))
    lines = lambda c: F.coalesce(F.transform(c, lambda r: r["line"]), F.array().cast("array<string>"))
    every = F.concat(F.array(F.lit(head)), lines("nodes"), lines("arrows"), F.array(*map(F.lit, tail)).cast("array<string>"))
    return nodes.join(arrows, "method", "left").select("method", F.array_join(every, "\n").alias("diagram"))


def mermaid(edge: DataFrame, label: DataFrame) -> DataFrame:
    """(method, diagram) as Mermaid text."""
    return _diagram(edge, label, "graph TD", '  B%d["%s"]', "  B%d -->|%s| B%d", [])


def plantuml(edge: DataFrame, label: DataFrame) -> DataFrame:
    """(method, diagram) as PlantUML text."""
    return _diagram(edge, label, "@startuml", 'state B%1$d as "%2$s"', "B%1$d --> B%3$d : %2$s", ["@enduml"])
