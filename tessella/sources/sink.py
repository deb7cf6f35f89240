"""A file for each row, written by the tasks that hold the rows: first under the attempt's own name, then moved to its place."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .archives import qualified

STATUS = "path string, saved_to string, size long, error string"
ATTEMPTS, REPORT = "_attempts", "_status"


def relative(path: str | None) -> str:
    """A path below the root, with slashes; ValueError for none, an absolute one, one that leads upwards or into what the sink keeps for itself."""
    parts = [p for p in (path or "").replace("\\", "/").split("/") if p not in ("", ".")]
    if not parts or (path or "").startswith(("/", "\\")) or ".." in parts or any(ord(c) < 32 for c in path or "") or parts[0] in (ATTEMPTS, REPORT):
        raise ValueError(f"bad path: {path!r}")
    return "/".join(parts)


def place(system: fs.FileSystem, root: str, attempt: str, path: str, content: bytes) -> str:
    """Write one file and move it to its place; whatever ends the task before leaves it under the attempt's name alone."""
    target, draft = f"{root}/{path}", f"{root}/{ATTEMPTS}/{attempt}"
    system.create_dir(f"{root}/{ATTEMPTS}", recursive=True)
    with system.open_output_stream(draft) as out:
        out.write(content)
    if "/" in path:
        system.create_dir(target.rsplit("/", 1)[0], recursive=True)
    if system.get_file_info(target).type == fs.FileType.File and not isinstance(system, fs.LocalFileSystem):
        system.delete_file(target)  # a store that does not move onto a file; here a move replaces it
    system.move(draft, target)
    return target


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Write ``rows`` (path below ``root``, content binary) as files; returns (path, saved_to, size, error) of each, as kept in the folder REPORT.

    A path that is not one, a null content and what can't be written give a row with the error, and the others are written. Of rows with one path the first by its content's digest
    is written and the others have an error. A task that is run again writes the same files again. What an attempt left behind is deleted at the end.
    """
    spark = rows.sparkSession
    uri, run = qualified(spark, root).rstrip("/"), uuid.uuid4().hex

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(uri)
        base, attempt, last, n = base.rstrip("/"), f"{run}-{TaskContext.get().taskAttemptId()}", None, 0
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                n += 1
                try:
                    where = relative(path)
                    if where == last:
                        raise ValueError("another row has this path")
                    last = where
                    if content is None:
                        raise ValueError("no content")
                    out.append((path, place(system, base, f"{attempt}-{n}", where, bytes(content)), len(content), None))
                except Exception as e:
                    out.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "saved_to", "size", "error"]).astype({"size": "Int64"})

    # All rows of one path meet, however they write it.
    plain = F.regexp_replace(F.translate("path", "\\", "/"), r"/(\./|/)*", "/")
    own = rows.select("path", F.col("content").cast("binary").alias("content"), plain.alias("_path"), F.xxhash64("content").alias("_digest"))
    dealt = own.repartition("_path").sortWithinPartitions("_path", F.col("content").isNull(), "_digest").select("path", "content")
    report = f"{uri}/{REPORT}/{run}"
    dealt.mapInPandas(write, STATUS).write.parquet(report)
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{uri}/{ATTEMPTS}")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return spark.read.schema(STATUS).parquet(report)
