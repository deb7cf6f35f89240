"""Call chains by levels over the call relation and the type graph, from many roots at once, each with a budget of its own.

Nothing of a search but the names of few types passes through the driver: known methods, frontiers and budgets are DataFrames. Where the
relations are stored as adjacency (in folders by ``bucket``, sorted by the type at one end), a level reads the folders and row groups of its own types alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed, type_edges

METHOD = ["archive_path", "owner", "name", "descriptor"]
#: Folders of a stored adjacency, and so many types at most that a level names one by one; more are joined.
BUCKETS, NAMED = 16, 1000


def bucket_of(owner: str | Column) -> Column:
    """The folder of a type in a stored adjacency."""
    return F.pmod(F.xxhash64(owner), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class CallGraph:
    """Calls by source and by target, (parent, child) of types by either, and methods by owner; the same relation may serve twice.

    ``lists`` are the first methods that each method calls (:func:`lists_of`), if they have been made for all.
    """

    by_source: DataFrame
    by_target: DataFrame
    by_parent: DataFrame
    by_child: DataFrame
    methods: DataFrame
    lists: DataFrame | None = None

    @classmethod
    def of(cls, calls: DataFrame, classes: DataFrame, interfaces: DataFrame, methods: DataFrame) -> CallGraph:
        types = type_edges(classes, interfaces).select("parent", "child")
        return cls(calls, calls, types, types, methods)


def method_text(prefix: str = "") -> Column:
    """``owner#name`` and descriptor."""
    return F.concat(F.col(f"{prefix}owner"), F.lit("#"), F.col(f"{prefix}name"), F.col(f"{prefix}descriptor"))


def near(table: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows of a stored ``table`` whose ``column`` is a ``key`` of ``keys``, which have been written; a table that is not stored by bucket is left as it is."""
    if "bucket" not in table.columns:
        return table
    wanted = keys.select(F.col(key).alias(column)).distinct().withColumn("bucket", bucket_of(column))
    few = wanted.limit(NAMED + 1).collect()
    if len(few) > NAMED:
        return table.join(wanted, ["bucket", column], "left_semi")
    return table.where(F.col("bucket").isin(sorted({r.bucket for r in few})) & F.col(column).isin(sorted(r[column] for r in few)))


def _written(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` written, if their keys are to be named to a stored ``table``."""
    return checkpointed(rows) if "bucket" in table.columns else rows


#: What a row of a frontier is passed on with: its search, its place there, and its method as text.
FROM = ["root", "seq", "by"]
SOURCE = ["source_owner", "source_name", "source_desc"]


def lists_of(graph: CallGraph, most: int, asked: DataFrame | None = None) -> DataFrame:
    """(SOURCE, methods, size), written: the first ``most`` methods (METHOD) that each method, or each of ``asked`` (SOURCE), calls, in order; no row where there is none.

    A stored call has the archive of its caller. Each is followed by the declarations of its method in direct subtypes of its owner, in whatever archive.
    Calls are cut before they meet declarations, and so are the declarations below a called method: what comes after ``most`` others of the same order
    can't be among the first. Calls of a method come together once (a method's code is bounded), so that they are sorted once.
    """
    target = ["target_owner", "target_name", "target_desc"]
    here = graph.by_source if asked is None else near(graph.by_source, "source_owner", asked, "source_owner").join(asked, SOURCE)
    here = here.where(" and ".join(f"{c} is not null" for c in SOURCE)).select(*SOURCE, F.col("archive_path").alias("called_in"), *target)
    here = here.repartition(*SOURCE).withColumn("n", F.dense_rank().over(Window.partitionBy(*SOURCE).orderBy("called_in", *target))).where(F.col("n") <= most)
    here = _written(here, graph.by_parent)
    types = near(graph.by_parent, "parent", here, "target_owner").select(F.col("parent").alias("target_owner"), F.col("child").alias("owner")).distinct()
    types = _written(types, graph.methods)
    declared = near(graph.methods, "owner", types, "owner").select("archive_path", "owner", F.col("name").alias("target_name"), F.col("descriptor").alias("target_desc"))
    below = declared.join(types, "owner")
    if "bucket" in graph.by_parent.columns:
        below = below.join(here.select(*target).distinct(), target, "left_semi")
    below = below.withColumn("n", F.dense_rank().over(Window.partitionBy(*target).orderBy("archive_path", "owner"))).where(F.col("n") <= most)
    # Written, so that Spark knows its size: few called types have subtypes that declare the method, in which case the calls stay where they are.
    method = F.struct("archive_path", "owner", F.col("target_name").alias("name"), F.col("target_desc").alias("descriptor"))
    below = checkpointed(below.groupBy(*target).agg(F.array_sort(F.collect_set(method)).alias("below")))
    called = F.struct(F.col("called_in").alias("archive_path"), *[F.col(t).alias(c) for t, c in zip(target, METHOD[1:])])
    lists = here.join(below, target, "left").groupBy(*SOURCE).agg(F.array_sort(F.collect_set(F.struct("n", called.alias("method"), "below"))).alias("calls"))
    none = F.array().cast(below.schema["below"].dataType)
    # Calls are different methods; only declarations below them may come twice.
    mixed = F.aggregate("calls", none, lambda had, c: F.when(F.size(had) >= most, had).otherwise(F.array_union(had, F.concat(F.array(c["method"]), F.coalesce(c["below"], none)))))
    every = F.when(F.exists("calls", lambda c: c["below"].isNotNull()), mixed).otherwise(F.col("calls.method"))
    return checkpointed(lists.select(*SOURCE, F.slice(every, 1, most).alias("methods")).withColumn("size", F.size("methods")))


def callees(graph: CallGraph, frontier: DataFrame, most: int) -> DataFrame:
    """(FROM, key, of, METHOD) of the first methods that each method of a frontier (FROM, METHOD) calls, numbered by key from 1 to ``of``.

    They are the first ``most``, but for the method itself, which its search knows. What a method calls is found once, however many searches meet it.
    The root has seq 0; a search that goes on from several methods needs none after the first that calls ``most``, as these hold as many new ones as there is budget left.
    """
    frontier = frontier.select(*FROM, "archive_path", *[F.col(c).alias(s) for c, s in zip(METHOD[1:], SOURCE)])
    lists = graph.lists
    if lists is None:
        lists = lists_of(graph, most, frontier.select(*SOURCE).distinct())
    if not frontier.where("seq > 0").isEmpty():
        full = F.min(F.when(F.col("size") >= most, F.col("seq"))).over(Window.partitionBy("root"))
        frontier = frontier.join(lists.select(*SOURCE, "size"), SOURCE).withColumn("full", full).where("full is null or seq <= full").drop("size", "full")
    own = F.struct("archive_path", *[F.col(s).alias(c) for s, c in zip(SOURCE, METHOD[1:])])
    found = frontier.join(lists, SOURCE).select(*FROM, F.array_remove("methods", own).alias("methods"))
    return found.select(*FROM, F.size("methods").alias("of"), F.posexplode("methods").alias("at", "to")).select(*FROM, (F.col("at") + 1).alias("key"), "of", "to.*")


def callers(graph: CallGraph, frontier: DataFrame, most: int) -> DataFrame:
    """(FROM, key, METHOD) of the first ``most`` methods at least that call each of a frontier, and then of those that call the same method of its owner's direct parents.

    What calls a method is found and cut once, however many searches and subtypes ask for it.
    """
    target, source = ["target_owner", "target_name", "target_desc"], ["source_owner", "source_name", "source_desc"]
    own = frontier.select(*FROM, *[F.col(c).alias(t) for c, t in zip(METHOD[1:], target)])
    types = near(graph.by_child, "child", own, "target_owner").select(F.col("child").alias("target_owner"), "parent").distinct()
    above = own.join(types, "target_owner").select(*FROM, F.lit(1).alias("later"), "parent", F.col("parent").alias("target_owner"), *target[1:])
    wanted = own.select(*FROM, F.lit(0).alias("later"), F.lit("").alias("parent"), *target).unionByName(above)
    wanted = _written(wanted, graph.by_target)
    found = near(graph.by_target, "target_owner", wanted, "target_owner").join(wanted.select(*target).distinct(), target, "left_semi")
    found = found.select(*target, "archive_path", *source).withColumn("n", F.dense_rank().over(Window.partitionBy(*target).orderBy("archive_path", *source))).where(F.col("n") <= most)
    found = found.join(wanted, target)
    return found.select(*FROM, F.struct("later", "parent", "n").alias("key"), "archive_path", *[F.col(s).alias(c) for s, c in zip(source, METHOD[1:])])


def _new(found: DataFrame, known: DataFrame, max_nodes: int) -> DataFrame:
    """(root, METHOD, first, seq, last): what of ``found`` (FROM, key, METHOD) is not ``known`` (root, METHOD, seq), once and in order, as far as the budget goes, with the last seq of its root."""
    of_root = Window.partitionBy("root")
    found = found.select("root", *METHOD, F.struct("seq", "key", "by").alias("first"))
    had = known.select("root", *METHOD, F.lit(None).cast(found.schema["first"].dataType).alias("first"), F.col("seq").alias("had"))
    both = found.withColumn("had", F.lit(None).cast("int")).unionByName(had).repartition("root")
    new = both.groupBy("root", *METHOD).agg(F.min("first").alias("first"), F.max("had").alias("had"))
    new = new.withColumn("last", F.max("had").over(of_root)).where("had is null")
    new = new.withColumn("seq", F.col("last") + F.row_number().over(of_root.orderBy("first"))).where(F.col("seq") < max_nodes)
    return new.withColumn("last", F.max("seq").over(of_root))


def search(step: Callable[[DataFrame, int], DataFrame], roots: DataFrame, depth: int, max_nodes: int) -> DataFrame:
    """(root, METHOD, parent, depth, seq, truncated): the methods within ``depth`` of each of ``roots`` (root, METHOD), itself first, in the order of discovery.

    ``step`` gives (FROM, key, METHOD) of a frontier. Each root has a budget of ``max_nodes``, one at least, of which it takes one itself; a method is found
    once, by its first parent, and is another one in another archive. Where the budget is used up the last row is flagged truncated, as rows may lack.

    A root that has k methods takes max_nodes - k more at most, and no more than k of what a method leads to are known: the first max_nodes of each are enough,
    and roots with no budget left are not searched from. What is new and what is known of a root meet in one shuffle. A step with a column ``of`` numbers
    what a method leads to by key from 1 to ``of``, each once and without the method itself: what comes of the root alone stands in order already.
    """
    depth, max_nodes = max(1, depth), max(1, max_nodes)
    level = out = checkpointed(roots.select("root", *METHOD, F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit(0).alias("seq")))
    known = level = level.where(F.lit(max_nodes > 1))
    for d in range(1, depth + 1):
        found = step(level.select("root", "seq", method_text().alias("by"), *METHOD), max_nodes)
        if d == 1 and "of" in found.columns:
            new = found.where(F.col("key") < max_nodes).withColumns({"first": F.struct("by"), "seq": F.col("key"), "last": F.least("of", F.lit(max_nodes - 1))})
        else:
            new = _new(found, known, max_nodes)
        level = checkpointed(new.select("root", *METHOD, F.col("first.by").alias("parent"), F.lit(d).alias("depth"), "seq", "last"))
        out = out.unionByName(level.drop("last"))
        level = level.where(F.col("last") < max_nodes - 1).drop("last")
        if d == depth or level.isEmpty():
            break
        known = known.join(level.select("root").distinct(), "root", "left_semi").unionByName(level)
    return out.withColumn("truncated", F.col("seq") == max_nodes - 1)


def chains(graph: CallGraph, wanted: DataFrame, classes: DataFrame, direction: str = "both", depth: int = 3, max_nodes: int = 128) -> DataFrame:
    """Call chains of all ``wanted`` (root, owner, name, descriptor or null): (root, direction, METHOD, parent, depth, seq, truncated, outcome).

    A method that is not one has a row for each candidate (one without archive if there is none) with the outcome, and no chain.
    """
    from .symbols import resolve_all

    named = checkpointed(resolve_all(wanted, graph.methods, classes))
    roots = named.where("outcome = 'resolved'")
    steps = {"callers": callers, "callees": callees}
    direction = {"caller": "callers", "callee": "callees"}.get(direction.strip().lower(), direction.strip().lower())
    out = named.where("outcome <> 'resolved'").select("root", F.lit(None).cast("string").alias("direction"), *METHOD, F.lit(None).cast("string").alias("parent"), *[F.lit(None).cast("int").alias(c) for c in ("depth", "seq")], F.lit(False).alias("truncated"), "outcome")
    ways = [direction] if direction in steps else list(steps)
    if "callees" in ways and "bucket" not in graph.by_source.columns:
        # Calls that are not stored are read as a whole at any rate: once, for all levels.
        graph = replace(graph, lists=lists_of(graph, max(1, max_nodes)))
    for name in ways:
        found = search(lambda f, most, step=steps[name]: step(graph, f, most), roots, depth, max_nodes)
        out = out.unionByName(found.withColumns({"direction": F.lit(name), "outcome": F.lit("resolved")}))
    return out
