"""Log and stack-trace lines as typed entries, and frames resolved to classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The forms of lines that are recognised.
FRAME = r"^\s*at\s+([\w.$/]+)\.([\w$<>]+)\(([^()]*)\)$"
THROWN = r"([\w.$]+(?:Exception|Error|Throwable|Failure))(?::\s*(.*))?$"
HEADER = r'^(?:Exception in thread ".*?"\s+)?' + THROWN
CAUSED = r"^Caused by:\s+" + THROWN
SUPPRESSED = r"^Suppressed:\s+" + THROWN
OMITTED = r"^\.\.\.\s+(\d+)\s+more$"
LOG = r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d{3})?)\s+(TRACE|DEBUG|INFO|WARN|ERROR|FATAL)\s+(?:\[([^\]]+)])?\s*([\w.$-]+)?\s*-\s*(.*)$"


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` with kind (causedBy, suppressed, header, omitted, log, frame; null: none) and the parts of that kind."""
    raw = F.regexp_replace(F.col(line), r"\r$", "")
    bare = F.regexp_replace(raw, r"^\s+|\s+$", "")
    kind = F.when(bare.rlike(CAUSED), "causedBy").when(bare.rlike(SUPPRESSED), "suppressed").when(bare.rlike(HEADER), "header").when(bare.rlike(OMITTED), "omitted").when(bare.rlike(LOG), "log").when(raw.rlike(FRAME), "frame")
    thrown = lambda group: F.when(F.col("kind") == "causedBy", F.regexp_extract(bare, CAUSED, group)).when(F.col("kind") == "suppressed", F.regexp_extract(bare, SUPPRESSED, group)).when(F.col("kind") == "header", F.regexp_extract(bare, HEADER, group))
    part = lambda k, pattern, group: F.when(F.col("kind") == k, F.regexp_extract(raw if k == "frame" else bare, pattern, group))
    out = lines.withColumn("kind", kind).withColumn("exception_type", thrown(1)).withColumn("message", F.coalesce(thrown(2), part("log", LOG, 5)))
    out = out.withColumn("omitted", part("omitted", OMITTED, 1).cast("long")).withColumn("level", part("log", LOG, 2)).withColumn("logger", part("log", LOG, 4))
    return location(out.withColumn("class_name", part("frame", FRAME, 1)).withColumn("method_name", part("frame", FRAME, 2)).withColumn("_where", part("frame", FRAME, 3)))


def location(frames: DataFrame, where: str = "_where") -> DataFrame:
    """The file, line and flags of a frame's place."""
    w: Column = F.col(where)
    native, unknown = w == "Native Method", w == "Unknown Source"
    frames = frames.withColumn("native_method", native).withColumn("unknown_source", unknown)
    frames = frames.withColumn("file_name", F.when(~native & ~unknown & (w != ""), F.regexp_replace(w, r":\d+$", "")))
    return frames.withColumn("source_line", F.when(w.rlike(r":\d+$"), F.regexp_extract(w, r":(\d+)$", 1).cast("long"))).drop(where)


def resolve_frames(frames: DataFrame, classes: DataFrame, methods: DataFrame, keys: list[str]) -> DataFrame:
    """Frames with the number of archives that hold their class and of methods of their name there; frames without any stay."""
    f = frames.withColumn("internal_name", F.translate("class_name", ".", "/"))
    c = classes.select("archive_path", "internal_name")
    m = methods.select("archive_path", F.col("owner").alias("internal_name"), F.col("name").alias("method_name"), "descriptor")
    joined = f.join(c, "internal_name", "left").join(m, ["archive_path", "internal_name", "method_name"], "left")
    return joined.groupBy(*keys, "class_name", "method_name").agg(F.countDistinct("archive_path").alias("archives"), F.count("descriptor").alias("methods"))


def frame_candidates(frames: DataFrame, classes: DataFrame, methods: DataFrame, keys: list[str]) -> DataFrame:
    """Frames with candidates: for each archive that holds their class, the descriptors of the methods of their name; none for a frame whose class is nowhere."""
    f = frames.withColumn("internal_name", F.translate("class_name", ".", "/"))
    m = methods.select("archive_path", F.col("owner").alias("internal_name"), F.col("name").alias("method_name"), "descriptor")
    joined = f.join(classes.select("archive_path", "internal_name"), "internal_name", "left").join(m, ["archive_path", "internal_name", "method_name"], "left")
    each = joined.groupBy(*keys, "class_name", "method_name", "archive_path").agg(F.array_sort(F.collect_set("descriptor")).alias("methods"))
    found = F.array_sort(F.collect_list(F.when(F.col("archive_path").isNotNull(), F.struct("archive_path", "methods"))))
    return each.groupBy(*keys, "class_name", "method_name").agg(found.alias("candidates"))
