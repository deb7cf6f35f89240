"""Lookups for all that ask at once: the first of ranked containers, strategies in a chain, keys that are relaxed where they do not meet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import artifact_key, artifact_version, newest_first_key, sources_sibling, utf8_text

#: Where a type is looked for, in order: the archive itself, archives that are named, those inside it, those of its folder and below, the platform's.
LEVELS = ("own", "named", "nested", "folder", "platform")


def outer(path: str | Column) -> Column:
    """The archive that a nested one is in, at the top."""
    return F.regexp_replace(path, r"!/.*", "")


def container_order(path: str | Column, artifact: Column | None = None, version: Column | None = None) -> Column:
    """What containers of one level are ordered by, least first: artifact, the newest version, the least depth of the name, and the name."""
    path = F.col(path) if isinstance(path, str) else path
    name = F.element_at(F.split(path, "/"), -1)
    own = lambda given, read: read(name) if given is None else F.coalesce(given, read(name))
    depth = F.size(F.split(F.translate(path, "\\", "/"), "/"))
    return F.struct(own(artifact, artifact_key).alias("artifact"), newest_first_key(own(version, artifact_version)).alias("version"), depth.alias("depth"), path.alias("path"))


def resolve_types(references: DataFrame, classes: DataFrame, named: DataFrame | None = None, platform: DataFrame | None = None, coordinates: DataFrame | None = None) -> DataFrame:
    """``references`` (archive_path, target_type, each once) with container and level: the first container that has the type; both null where none has it.

    ``classes`` (archive_path, internal_name) are those of all containers; ``named`` and ``platform`` (archive_path) say which of these stand at the second and the last
    level for all that ask; ``coordinates`` (archive_path, group_id, artifact_id, version) name artifacts better than file names do. Of each level the
    classes are reduced to the first container by what they are asked for by (the archive, the one round it, a folder, nothing), so that every join is by a key that
    meets one row, however many containers have a type.
    """
    known = classes.select("archive_path", F.col("internal_name").alias("target_type")).distinct()
    if coordinates is not None:
        known = known.join(coordinates.select("archive_path", F.concat_ws(":", "group_id", "artifact_id").alias("_artifact"), F.col("version").alias("_version")), "archive_path", "left")
        order = container_order("archive_path", F.col("_artifact"), F.col("_version"))
    else:
        order = container_order("archive_path")
    known = known.select("archive_path", "target_type", order.alias("_order"))
    first = lambda df, *by: df.groupBy(*by, "target_type").agg(F.min_by("archive_path", "_order").alias("_found"))
    among = lambda some: known.join(some.select("archive_path").distinct(), "archive_path", "left_semi")
    # Every folder above an archive, its own one too; folders end in a slash.
    parts = F.split(outer("archive_path"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/")))
    nested = known.where(F.col("archive_path").contains("!/")).withColumn("_outer", outer("archive_path"))
    folders = known.where(~F.col("archive_path").contains("!/") & (F.size(parts) > 1)).withColumn("_folder", F.explode(above))
    own = known.select(F.col("archive_path").alias("_own"), "target_type", F.col("archive_path").alias("_found"))
    tables = {"own": (own, ["_own"]), "nested": (first(nested, "_outer"), ["_outer"]), "folder": (first(folders, "_folder"), ["_folder"])}
    for level, some in (("named", named), ("platform", platform)):
        if some is not None:
            tables[level] = (first(among(some)), [])
    out = references.select("archive_path", "target_type").withColumns({"_own": F.col("archive_path"), "_outer": outer("archive_path"), "_folder": F.regexp_extract(outer("archive_path"), "^(.*/)", 1)})
    for level in LEVELS:
        if level in tables:
            table, by = tables[level]
            out = out.join(table.withColumnRenamed("_found", f"_{level}_at"), [*by, "target_type"], "left")
    at = [(level, F.col(f"_{level}_at")) for level in LEVELS if level in tables]
    level = F.coalesce(*[F.when(c.isNotNull(), name) for name, c in at])
    return out.select("archive_path", "target_type", F.coalesce(*[c for _, c in at]).alias("container"), level.alias("level"))


def chained(wanted: DataFrame, key: str, strategies: list[tuple[str, Callable[[DataFrame], DataFrame]]], written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What each strategy finds of what those before it have left: their rows with column strategy.

    A strategy gets the rows of ``wanted`` that are left and gives rows with their ``key``, each once. ``written`` cuts lineage, so that no strategy runs twice.
    """
    left, found = wanted, None
    for name, strategy in strategies:
        hits = written(strategy(left).withColumn("strategy", F.lit(name)))
        found = hits if found is None else found.unionByName(hits)
        left = left.join(hits.select(key), key, "left_anti")
    return found


def sources_in(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, origin, entry, source) of ``asked`` (id, class_name, origin: an archive of sources) in ``entries``: at the class's own path, else at the first path that ends in it."""
    path = F.concat(F.translate("class_name", ".", "/"), F.lit(".java"))
    simple = lambda c: F.element_at(F.split(c, "/"), -1)
    files = entries.where(F.col("entry").endswith(".java")).select(F.col("archive_path").alias("origin"), "entry", "ord", "content", simple(F.col("entry")).alias("_simple"))
    both = asked.select("id", "origin", path.alias("_path")).withColumn("_simple", simple(F.col("_path"))).join(files, ["origin", "_simple"])
    exact = F.col("entry") == F.col("_path")
    fits = both.where(exact | F.col("entry").endswith(F.concat(F.lit("/"), F.col("_path"))))
    best = fits.groupBy("id").agg(F.min_by(F.struct("origin", "entry", utf8_text(F.col("content")).alias("source")), F.struct((~exact).alias("late"), "ord", "entry")).alias("b"))
    return best.select("id", "b.*")


def find_sources(wanted: DataFrame, sources: DataFrame, repository: DataFrame, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, strategy, origin, entry, source) of classes ``wanted`` (id, class_name, archive_path, given, group_id, artifact_id, version, checksum; all but id and class_name may be null).

    In turn: the archive of sources that is given, the one beside the archive, the one of the ``repository`` (origin, group_id, artifact_id, version, checksum of the
    artifact) with its coordinates, and, for what has no complete coordinates, the one with its checksum; of several the first by name. ``sources`` has the entries of all these archives.
    """
    complete = F.col("group_id").isNotNull() & F.col("artifact_id").isNotNull() & F.col("version").isNotNull()
    gav = ["group_id", "artifact_id", "version"]
    by_gav = repository.dropna(subset=gav).select(*gav, "origin").distinct()
    by_sum = repository.dropna(subset=["checksum"]).select(F.lower("checksum").alias("_sum"), "origin").distinct()

    def at(rows: DataFrame) -> DataFrame:
        found = sources_in(rows.withColumn("id", F.struct("id", "origin")), sources)
        first = found.groupBy(F.col("id.id").alias("id")).agg(F.min_by(F.struct("origin", "entry", "source"), "origin").alias("b"))
        return first.select("id", "b.*")

    strategies = [
        ("given", lambda left: at(left.where("given is not null").select("id", "class_name", F.col("given").alias("origin")))),
        ("sibling", lambda left: at(left.where("archive_path is not null").select("id", "class_name", sources_sibling(F.col("archive_path")).alias("origin")).where("origin is not null"))),
        ("coordinates", lambda left: at(left.where(complete).join(by_gav, gav).select("id", "class_name", "origin"))),
        ("checksum", lambda left: at(left.where(~complete & F.col("checksum").isNotNull()).withColumn("_sum", F.lower("checksum")).join(by_sum, "_sum").select("id", "class_name", "origin"))),
    ]
    return chained(wanted, "id", strategies, written).select("id", "strategy", "origin", "entry", "source")


def relaxed_join(left: DataFrame, right: DataFrame, key: str, relaxed: Callable[[Column], Column]) -> DataFrame:
    """Pairs (left, right, how) of keys: ``exact`` ones first; what is left of both sides meets by the relaxed key, where that is one row's on either side (``relaxed``).

    The keys of a side are distinct. Keys that meet nothing come with a null on the other side.
    """
    a, b = left.select(F.col(key).alias("left")).distinct(), right.select(F.col(key).alias("right")).distinct()
    both = a.join(b, F.col("left") == F.col("right"), "full_outer")
    exact = both.where("left = right").withColumn("how", F.lit("exact"))
    alone = lambda side: both.where(f"{side} is not null and {'right' if side == 'left' else 'left'} is null").select(side, relaxed(F.col(side)).alias("_key"))
    sides = alone("left").withColumn("right", F.lit(None).cast("string")).unionByName(alone("right").withColumn("left", F.lit(None).cast("string")))
    met = sides.groupBy("_key").agg(F.count("left").alias("_n"), F.count("right").alias("_m"), F.min("left").alias("_left"), F.min("right").alias("_right"))
    one = met.where("_n = 1 and _m = 1")
    pairs = one.select(F.col("_left").alias("left"), F.col("_right").alias("right"), F.lit("relaxed").alias("how"))
    rest = sides.join(one.select("_key"), "_key", "left_anti").select("left", "right", F.lit(None).cast("string").alias("how"))
    return exact.unionByName(pairs).unionByName(rest)
