"""Inputs as rows: every entry of zip-backed files read by Spark's ``binaryFile`` source, nested libraries included, and class folders."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ARCHIVE, properties, property_value, sources_sibling, utf8_text
from ..schemas import ENTRIES

LIBRARIES = ("BOOT-INF/lib/", "WEB-INF/lib/", "APP-INF/lib/", "lib/", "libs/", "dependencies/")
#: Bytes of content and entries of a frame at most (one entry at least).
FRAME_BYTES, FRAME_ROWS = 16 << 20, 500
#: Buckets of a folder's files.
BUCKETS = 4096
_COLUMNS = [c.split()[0] for c in ENTRIES.split(", ")] + ["error_type", "message"]


def _members(path: str, data: bytes, depth: int, inside: str = "") -> Iterator[tuple]:
    """Entries of an archive, one at a time; libraries inside follow as ``outer!/inner`` archives, unreadable ones left out.

    Modules of an EAR or KAR and the classes.jar of an AAR are the archive's own: their entries come under the outer archive, named
    ``inner!/entry``.
    """
    lower = path.lower()
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        infos = [i for i in archive.infolist() if not i.is_dir()]
        names = {i.filename for i in infos}
        for ending, needed in ((".apk", "classes.dex"), (".aar", "classes.jar")):
            if not inside and lower.endswith(ending) and needed not in names:
                raise ValueError(f"no {needed}")
        for k, info in enumerate(infos):
            content, name = archive.read(info), info.filename.replace("\\", "/")
            yield path, inside + name, k, info.file_size, info.CRC, content, None, None
            zipped = name.lower().endswith((".jar", ".war", ".zip", ".aar"))
            if not (zipped and depth and zipfile.is_zipfile(io.BytesIO(content))):
                continue
            if not inside and (lower.endswith((".ear", ".kar")) or lower.endswith(".aar") and name == "classes.jar"):
                yield from _members(path, content, depth - 1, f"{name}!/")
            elif name.startswith(LIBRARIES) or "/" not in name:
                yield from _members(f"{path}!/{inside}{name}", content, depth - 1)


def _files(spark: SparkSession, path: str | list[str], recursive: bool, only: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", only).load(path)
    return files.where(F.lower("path").rlike(ARCHIVE))


def read_entries(spark: SparkSession, path: str | list[str], recursive: bool = False, nested: int = 2, only: str = "*") -> DataFrame:
    """Entries (ENTRIES) of the archives at ``path``, a file, a folder or several, with columns error_type and message; in a folder of those whose name the glob ``only`` fits.

    A task reads whole archives one at a time and passes their entries on in small frames. An archive that can't be read gives a row with
    error_type and message, after what could be read of it, and not an error. APK files without a dex file fail, as do AAR files without classes.jar.
    """

    return _files(spark, path, recursive, only).select("path", "content").mapInPandas(_unzipping(nested, None), f"{ENTRIES}, error_type string, message string")


def _unzipping(nested: int, opened: Callable[[str], bytes] | None):
    """A task that gives the entries of archives, one archive at a time, in small frames; ``opened`` reads an archive whose content the rows don't have."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=_COLUMNS).astype({"ord": "Int32", "size": "Int64", "crc": "Int64"})
        for batch in batches:
            for k, name in enumerate(batch["path"]):
                rows, held = [], 0
                try:
                    for row in _members(name, bytes(batch["content"].iloc[k]) if opened is None else opened(name), nested):
                        rows.append(row)
                        held += len(row[5])
                        if held >= FRAME_BYTES or len(rows) >= FRAME_ROWS:
                            yield frame(rows)
                            rows, held = [], 0
                except Exception as e:
                    rows.append((name, None, None, None, None, None, type(e).__name__, str(e)))
                yield frame(rows)

    return run


def _opened(path: str) -> bytes:
    """A file's bytes, read in a task."""
    system, where = fs.FileSystem.from_uri(path)
    with system.open_input_stream(where) as f:
        return f.read()


def read_named(spark: SparkSession, paths: DataFrame, nested: int = 2) -> DataFrame:
    """:func:`read_entries` of the archives that ``paths`` (archive_path) names: the names are rows, and each task opens its own.

    Stores that tasks can't open but through Spark (those that have no file system in Arrow) are read by Spark's own source, for which the names are collected.
    """
    first = paths.first()
    try:
        fs.FileSystem.from_uri(first.archive_path if first else "file:///")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return read_entries(spark, [r.archive_path for r in paths.collect()], True, nested)
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return paths.select(F.col("archive_path").alias("path")).repartition(tasks, "path").mapInPandas(_unzipping(nested, _opened), f"{ENTRIES}, error_type string, message string")


def read_archives(spark: SparkSession, path: str | list[str], recursive: bool = False, nested: int = 2) -> tuple[DataFrame, DataFrame]:
    """Entries (ENTRIES) of the archives at ``path`` that can be read, and failures (archive_path, error_type, message)."""
    every = read_entries(spark, path, recursive, nested)
    failures = every.where("error_type is not null").select("archive_path", "error_type", "message")
    return every.where("error_type is null").drop("error_type", "message"), failures


def _class_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.class").load(path)


def read_class_folder(spark: SparkSession, path: str) -> DataFrame:
    """Entries (ENTRIES) of the class files below a folder, which counts as one archive; names start below the folder."""
    root = qualified(spark, path)
    name = F.substring("path", len(root) + 2, 1 << 20)
    return _class_files(spark, path).select(F.lit(root).alias("archive_path"), name.alias("entry"), F.lit(0).alias("ord"), F.col("length").alias("size"), F.crc32("content").alias("crc"), "content")


def class_file_root(spark: SparkSession, path: str) -> str:
    """The folder in which a class file's packages begin, by the name that the class itself states."""
    from .classfile import ClassFile

    data = bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
    c = ClassFile(data)
    c.u2()
    full, name = qualified(spark, path), c.name(c.u2())
    return full.removesuffix(f"/{name}.class") if full.endswith(f"/{name}.class") else full.rsplit("/", 1)[0]


def open_input(spark: SparkSession, path: str) -> DataFrame:
    """Entries (ENTRIES) of an input: of an archive, of a folder's class files, or of all class files beside a single one."""
    if is_folder(spark, path):
        return read_class_folder(spark, path)
    if path.lower().endswith(".class"):
        return read_class_folder(spark, class_file_root(spark, path))
    if re.search(ARCHIVE, path.lower()):
        return read_archives(spark, path)[0]
    raise ValueError(f"unsupported input: {path}")


def _status(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getFileStatus(where) if system.exists(where) else None


def is_folder(spark: SparkSession, path: str) -> bool:
    status = _status(spark, path)
    if status is None:
        raise FileNotFoundError(path)
    return status.isDirectory()


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark names its files, with scheme."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def scope_inputs(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(archive_path, kind) of a scope: a file is its only input; a folder has its archives, and is one itself if a class file is anywhere below it."""
    found = _files(spark, path, recursive).select(F.col("path").alias("archive_path"), F.lit("archive").alias("kind"))
    if not is_folder(spark, path) or _class_files(spark, path).select("path").isEmpty():
        return found
    return found.unionByName(spark.createDataFrame([(qualified(spark, path), "folder")], "archive_path string, kind string"))


def fingerprints(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(archive_path, fingerprint): SHA-256 of each archive's bytes; of a folder with class files, of its files' names below it, sizes and times.

    A folder's files are put into BUCKETS by a hash; the digest is one of the buckets' digests, each of its lines in order.
    """
    found = _files(spark, path, recursive).select(F.col("path").alias("archive_path"), F.sha2("content", 256).alias("fingerprint"))
    if not is_folder(spark, path) or _class_files(spark, path).select("path").isEmpty():
        return found
    root = qualified(spark, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = files.select(F.concat_ws("\0", F.substring("path", len(root) + 2, 1 << 20), "length", F.unix_millis("modificationTime"), F.lit("")).alias("line"))
    digest = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    buckets = listed.groupBy(F.pmod(F.xxhash64("line"), F.lit(BUCKETS)).alias("bucket")).agg(digest("line").alias("digest"))
    folder = buckets.agg(digest(F.concat_ws(":", "bucket", "digest")).alias("fingerprint"))
    return found.unionByName(folder.select(F.lit(root).alias("archive_path"), "fingerprint"))


def repository(spark: SparkSession, path: str) -> DataFrame:
    """(origin, group_id, artifact_id, version, checksum) of the archives of sources below ``path``: what the artifact beside each states, and its SHA-1."""
    every = _files(spark, path, True)
    artifacts = every.where(~F.col("path").endswith("-sources.jar")).select(F.col("path").alias("archive_path"), F.sha1("content").alias("checksum"), sources_sibling(F.col("path")).alias("origin"))
    sources = every.where(F.col("path").endswith("-sources.jar")).select(F.col("path").alias("origin"))
    stated = coordinates(read_entries(spark, path, True, nested=0).where("error_type is null and entry like '%pom.properties'").drop("error_type", "message"))
    found = artifacts.join(sources, "origin").join(stated, "archive_path", "left")
    return found.select("origin", "group_id", "artifact_id", "version", "checksum")


def coordinates(entries: DataFrame) -> DataFrame:
    """(archive_path, group_id, artifact_id, version) of archives by their first complete pom.properties."""
    text = entries.where(F.col("entry").rlike(r"^META-INF/maven/.*/pom\.properties$")).select("archive_path", "ord", properties(F.decode("content", "ISO-8859-1")).alias("p"))
    value = lambda k: F.trim(property_value(F.col("p"), k))
    found = text.select("archive_path", "ord", value("groupId").alias("group_id"), value("artifactId").alias("artifact_id"), value("version").alias("version"))
    found = found.where("group_id <> '' and artifact_id <> '' and version <> ''")
    return found.groupBy("archive_path").agg(F.min_by(F.struct("group_id", "artifact_id", "version"), "ord").alias("gav")).select("archive_path", "gav.*")


def source_of(entries: DataFrame, class_name: str) -> DataFrame:
    """(archive_path, entry, source): a class's source in archives of sources, at its own path or, where that is missing, at the first path that ends in it."""
    wanted = class_name.replace(".", "/") + ".java"
    exact = F.col("entry") == wanted
    found = entries.where(exact | F.col("entry").endswith("/" + wanted))
    best = found.groupBy("archive_path").agg(F.min_by(F.struct("entry", utf8_text(F.col("content")).alias("source")), F.struct((~exact).alias("late"), "ord")).alias("b"))
    return best.select("archive_path", "b.*")
