"""Choice among locations and attempts, tallies, refreshing and line maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import version_key


def class_entries(entries: DataFrame) -> DataFrame:
    """Class entries (column entry) with internal_name and version: the release of META-INF/versions/N, else null; modules inside (``inner!/entry``) count as the archive's own."""
    path = F.regexp_replace(F.translate("entry", "\\", "/"), r"^.*!/", "")
    versioned = r"^META-INF/versions/(\d+)/"
    out = entries.withColumn("version", F.when(path.rlike(versioned), F.regexp_extract(path, versioned, 1).cast("long")))
    bare = F.regexp_replace(F.regexp_replace(path, versioned, ""), r"^(BOOT-INF/classes/|WEB-INF/classes/|classes/)", "")
    return out.where(path.endswith(".class")).withColumn("internal_name", F.regexp_replace(bare, r"\.class$", ""))


def multi_release(entries: DataFrame, release: int, order: str) -> DataFrame:
    """Of each class's locations the one that ``release`` reads: an eligible one before others, then the highest release, then the first."""
    eligible = F.col("version").isNull() | (F.col("version") <= release)
    rank = F.struct((~eligible).alias("late"), F.col("version").isNull().alias("base"), (-F.col("version")).alias("down"), F.col(order).alias("at"))
    rest = [c for c in entries.columns if c not in ("archive_path", "internal_name")]
    best = entries.groupBy("archive_path", "internal_name").agg(F.min_by(F.struct(*rest), rank).alias("_best"))
    return best.select("archive_path", "internal_name", "_best.*")


def first_usable(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """The output of the first usable attempt by rank (null if none), with the number of attempts that failed."""
    return attempts.groupBy(*keys).agg(F.min_by("output", F.when(F.col("usable"), F.col("rank"))).alias("output"), F.count_if(~F.col("usable")).alias("failures"))


def tallies(outcomes: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    """How many outcomes there are, and of how many each condition holds, by keys."""
    return outcomes.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(c).alias(name) for name, c in conditions.items()])


def refresh_plan(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """Archives (archive_path, fingerprint) with state new, changed or current against what a manifest has."""
    known = manifest.select("archive_path", F.col("fingerprint").alias("_known"))
    state = F.when(F.col("_known").isNull(), "new").when(F.col("_known") == F.col("fingerprint"), "current").otherwise("changed")
    return now.join(known, "archive_path", "left").withColumn("state", state).drop("_known")


#: What stands before a line: its number, that of the source, or both.
GUTTERS = ("decompiled", "source", "both")


def gutter(text: Column, mode: str | None = "decompiled", source_lines: Column | None = None) -> Column:
    """Lines behind their numbers, behind those of the source (a map from line to source line; blank where it has none), or behind both; as they are without a mode."""
    if not (mode or "").strip() or mode.lower() == "none":
        return text
    mode = mode.lower()
    if mode not in GUTTERS:
        raise ValueError(f"unknown mode: {mode}")
    wide = lambda n: F.when(F.length(n) < 4, F.lpad(n, 4, " ")).otherwise(n)
    known = F.create_map().cast("map<int,int>") if source_lines is None else source_lines

    def line(content: Column, i: Column) -> Column:
        own, source = wide((i + 1).cast("string")), wide(F.coalesce(F.try_element_at(known, i + 1).cast("string"), F.lit("")))
        parts = {"decompiled": [own], "source": [source], "both": [own, source]}[mode]
        return F.concat(*[x for p in parts for x in (p, F.lit(" | "))], content)

    return F.array_join(F.transform(F.split(text, r"\R", -1), line), "\n")


def ranked_containers(containers: DataFrame, keys: list[str]) -> DataFrame:
    """Containers (keys, priority, artifact, version, name) with their rank from 1: by priority, artifact, the newest version, the least depth of the name, and name.

    What one lacks comes last in each of these. Those that are equal in all come in the order of their other columns, so that reruns agree.
    """
    depth = F.array_size(F.split(F.translate("name", "\\", "/"), "/"))
    named = {*keys, "priority", "artifact", "version", "name"}
    rest = [c for c in containers.columns if c not in named]
    last = [F.col(c).asc_nulls_last() for c in ("name", *rest)]
    order = Window.partitionBy(*keys).orderBy(F.col("priority").asc_nulls_last(), F.col("artifact").asc_nulls_last(), version_key(F.col("version")).desc(), depth.asc_nulls_last(), *last)
    return containers.withColumn("rank", F.row_number().over(order))


def checksum_of(files: DataFrame, listed: DataFrame) -> DataFrame:
    """``files`` (path) with the checksum that a list (checksum, file) has for their name, the first by file if several; null if it has none."""
    base = lambda c: F.element_at(F.split(F.translate(c, "\\", "/"), "/"), -1)
    first = listed.groupBy(base("file").alias("_base")).agg(F.min_by("checksum", "file").alias("checksum"))
    return files.withColumn("_base", base("path")).join(first, "_base", "left").drop("_base")


def merge_line_map(base: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """A line map (keys, line, source_line) in which lines of a patched range take the patch's, its offset clamped to the span."""
    line = patches.select(*keys, F.explode(F.sequence(F.col("start").cast("long"), F.col("end").cast("long"))).alias("line"), "start", "source_start", "source_end")
    at = F.least(F.col("source_start") + F.col("line") - F.col("start"), F.col("source_end")).cast("long")
    patched = line.select(*keys, "line", at.alias("_patched"))
    return base.join(patched, [*keys, "line"], "left").select(*keys, "line", F.coalesce("_patched", "source_line").cast("long").alias("source_line"))
