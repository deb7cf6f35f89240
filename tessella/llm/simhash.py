"""SimHash near-duplicates found through a Gray-order hierarchical index (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy_join, keep_rows, materialise, row_key, text_of
from .components import components
from .gray_index import gray_links

SHINGLE = 4
SEED = 42
CHUNK = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of a UTF-8 text: a bit is set if set in over half the shingle hashes; no words give zero."""
    words = text.lower().split()  # for bytes, only A-Z and only ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(lengths + 1) - 1
    start = end - lengths
    n = max(1, len(words) - SHINGLE + 1)
    first, last = start[:n].tolist(), end[-n:].tolist()
    ones = np.zeros((8, 8), np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[k : k + CHUNK], last[k : k + CHUNK])], np.uint64)
        columns = hashes.view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            ones[byte] += np.bincount(columns[:, byte], minlength=256) @ _BITS
    bits = (ones * 2 > n).astype(np.uint8)
    return int(np.packbits(bits.ravel(), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256 of the text as it is, fp: long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                fps = [fingerprint(t) for t in part.column(2).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "text_sha256", "fp"])

    text = text_of(text_col)
    source = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), text.alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, text_sha256 string, fp long")


def simhash_components(prints: DataFrame) -> DataFrame:
    """(fp, n: how many rows have it, component_id, first_sha) for each distinct fingerprint of ``prints`` (doc_id, text_sha256, fp)."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_sha256")
    classes = materialise(prints.groupBy("fp").agg(F.min(order).alias("first"), F.count("*").alias("n")))
    members = components(gray_links(classes.select("fp")))
    named = materialise(members.join(classes, members["node"] == classes["fp"]).select("fp", "root", "first"))
    least = named.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("members"))
    named = heavy_join(named, materialise(least), "root", "members", named.count()).select(F.col("fp").alias("member"), "least")
    found = classes.join(named, F.col("fp") == F.col("member"), "left")
    return materialise(found.select("fp", "n", F.coalesce("least", "first").alias("first")).select("fp", "n", F.col("first.doc_id").alias("component_id"), F.col("first.text_sha256").alias("first_sha")))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints at 4 or fewer differing bits are linked; component_id is the smallest doc_id that can be reached.
    Null and empty texts and texts without words have fingerprint zero, which is linked like any other. Null ids
    come last, so a component has a null component_id only if all its ids are null. Repeated rows each give a
    row, and an empty table gives none. Other columns of ``docs`` are not looked at.
    """
    prints = materialise(fingerprints(docs, id_col, text_col))
    found = simhash_components(prints)
    return heavy_join(prints, found, "fp", "n", prints.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest doc_id of each component, with all its columns, whatever their names; repeated rows come out once.

    Null and empty texts have the fingerprint zero and form a component with what is near it. Of several texts with the smallest doc_id one stays, by the digest of the text; of rows that agree in id and text,
    one by a hash of all columns. A null id is the largest. An empty table gives an empty result.
    """
    prints = materialise(fingerprints(docs, id_col, text_col))
    kept = simhash_components(prints).groupBy("component_id", "first_sha").agg(F.count("*")).select(row_key("component_id", F.col("first_sha")).alias("_key"))
    return keep_rows(docs, row_key(id_col, F.sha2(text_of(text_col).cast("binary"), 256)), kept)
