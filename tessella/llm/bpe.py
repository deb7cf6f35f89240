"""Byte-level BPE by a global shuffle of distinct words (operator 5).

1. Texts are split into pre-tokens. A block of documents becomes its distinct words, dealt into buckets by a hash, and one
   stream that names the word at every position.
2. The words are shuffled by bucket. There each distinct word is encoded once, whatever the number of blocks that have it.
   No position travels with a word, so a word that is in every text is one more entry for each block, no more.
3. The ids go back to their block, where documents are put together by position. The streams stay where they are: they
   are a table bucketed by block, to whose buckets only the ids are shuffled.

Decoding looks ids up in the token-byte table, whose size the vocabulary bounds.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import pretokens
from .common import bucketed, materialise, text_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: UTF-8 bytes of a block at most (a single longer document is a block of its own), and buckets at least.
BLOCK_BYTES, BUCKETS = 8_000_000, 256
#: How hard what is shuffled is compressed.
LEVEL = 9

_encoders: dict[int, tiktoken.Encoding] = {}


def vocabulary(path: str | None = None) -> bytes:
    """The ranks file at ``path``, by default that of the public tokenizers' folder, read on the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(os.fspath(path), "rb") as f:
        return f.read()


def pattern() -> str:
    """The pattern of the public tokenizers, which must be the one that the splitter knows."""
    import public_tokenizers

    if public_tokenizers.PATTERN != pretokens.PATTERN:
        raise ValueError("the tokenizers' pattern has changed")
    return pretokens.PATTERN


def ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def encoder(raw: bytes) -> tiktoken.Encoding:
    """The encoder of a ranks file, made once in each process."""
    key = xxhash.xxh64_intdigest(raw)
    if key not in _encoders:
        _encoders[key] = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks(raw), special_tokens={})
    return _encoders[key]


def pack(values: np.ndarray, level: int = 3) -> bytes:
    """Whole numbers below 2**32, compressed: all low bytes first, then the next."""
    return zstandard.compress(np.ascontiguousarray(values, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), level)


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel()


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """Bits of a count: words of a class are about as frequent as each other."""
    return np.frexp(counts.astype(np.float64))[1]


def numbering(classes: np.ndarray) -> np.ndarray:
    """Numbers of a block's words, the more frequent classes first, so that a stream of numbers compresses well."""
    out = np.empty(len(classes), np.uint32)
    out[np.argsort(-classes.astype(np.int64), kind="stable")] = np.arange(len(classes), dtype=np.uint32)
    return out


def _texts(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The texts of a string column one after another, and where each ends; bytes that aren't UTF-8 count as U+FFFD."""
    values = column.cast(pa.binary()).to_pylist()
    raw = b"".join(values)
    try:
        raw.decode()
    except UnicodeDecodeError:
        values = [v.decode("utf-8", "replace").encode() for v in values]
        raw = b"".join(values)
    return raw, np.cumsum(np.fromiter(map(len, values), np.int64, len(values)))


def split_texts(column: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens (binary) of a column of texts, and how many each text has."""
    raw, ends = _texts(column)
    starts = pretokens.token_starts(raw, ends, table)
    offsets = np.r_[starts, len(raw)].astype(np.int32)
    places = np.searchsorted(starts, ends)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]), np.diff(np.r_[0, places])


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows with BLOCK_BYTES at most, or one row."""
    end = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(end, (end[row - 1] if row else 0) + BLOCK_BYTES, "right")))
        yield row, last
        row = last


def _split_blocks(shared, buckets: int, kind: pa.DataType):
    """Documents (doc_id, text) in; word rows and one stream row for each block out."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("lengths", pa.binary()), ("classes", pa.binary()), ("docs", pa.list_(kind)), ("counts", pa.binary()), ("stream", pa.binary())])

    def block_rows(block: int, part: pa.RecordBatch) -> pa.RecordBatch:
        tokens, counts = split_texts(part.column(1), np.frombuffer(shared.value[1], np.uint8))
        coded = tokens.dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy()
        bucket = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in words.to_pylist()), np.int64, len(words))
        alphabetical = pc.sort_indices(words).to_numpy()
        order = alphabetical[np.argsort(bucket[alphabetical], kind="stable")]
        classes = frequency_classes(np.bincount(at, minlength=len(words))[order])
        place = np.empty(len(words), np.uint32)
        place[order] = numbering(classes)
        stream = place[at] if len(words) else np.zeros(0, np.uint32)
        size = np.bincount(bucket, minlength=buckets)
        filled, words = np.flatnonzero(size), words.take(pa.array(order))
        ends = np.cumsum(size)[filled]
        lengths = pc.binary_length(words).to_numpy()
        rows = {name: [None] for name in schema.names}
        rows |= {"block": [block], "docs": [part.column(0).to_pylist()], "counts": [pack(counts)], "stream": [pack(stream, LEVEL)]}
        for b, s, e in zip(filled.tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
            for name, value in (("block", block), ("bucket", b), ("words", zstandard.compress(b"".join(words.slice(s, e - s).to_pylist()), LEVEL)), ("lengths", pack(lengths[s:e])), ("classes", pack(classes[s:e])), ("docs", None), ("counts", None), ("stream", None)):
                rows[name].append(value)
        return pa.RecordBatch.from_pydict(rows, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for row, end in _blocks(batch.column(1)):
                yield block_rows(task << 32 | number, batch.slice(row, end - row))
                number += 1

    return run


def _encode_words(shared):
    """Word rows in the order of their buckets in, their ids and the number of ids of each word out; a bucket's word is encoded when it first appears."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bucket, known = encoder(shared.value[0]).encode_ordinary, None, {}
        for batch in batches:
            ids, numbers = [], []
            for b, data, lengths in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist(), batch.column("lengths").to_pylist()):
                if b != bucket:
                    bucket, known = b, {}
                data, end, found = zstandard.decompress(data), 0, []
                for n in unpack(lengths).tolist():
                    start, end = end, end + n
                    word = data[start:end]
                    code = known.get(word)
                    if code is None:
                        code = known[word] = tuple(encode(word.decode()))
                    found.append(code)
                ids.append(pack(np.fromiter((i for code in found for i in code), np.uint32), LEVEL))
                numbers.append(pack(np.fromiter(map(len, found), np.uint32, len(found))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), batch.column("classes"), pa.array(ids, pa.binary()), pa.array(numbers, pa.binary())], ["block", "bucket", "classes", "ids", "numbers"])

    return run


def _reassemble(kind: pa.DataType):
    """A block's stream and the ids of its words in; the ids of its documents out."""
    schema = pa.schema([("doc_id", kind), ("ids", pa.list_(pa.int32()))])

    def run(whole: pa.Table, coded: pa.Table) -> pa.Table:
        coded = coded.sort_by("bucket")
        ids = np.concatenate([np.zeros(0, np.uint32), *map(unpack, coded["ids"].to_pylist())]).astype(np.int32)
        numbers = np.concatenate([np.zeros(0, np.uint32), *map(unpack, coded["numbers"].to_pylist())]).astype(np.int64)
        order = numbering(np.concatenate([np.zeros(0, np.uint32), *map(unpack, coded["classes"].to_pylist())]))
        first = np.empty_like(numbers)
        first[order] = np.cumsum(numbers) - numbers
        numbers[order] = numbers.copy()
        stream, counts = unpack(whole["stream"][0].as_py()), unpack(whole["counts"][0].as_py()).astype(np.int64)
        docs, ends = whole["docs"].combine_chunks().flatten(), np.cumsum(counts)
        parts = []
        for row in range(0, len(docs), 512):
            last = min(row + 512, len(docs)) - 1
            at = stream[ends[row] - counts[row] : ends[last]]
            n = numbers[at]
            total = np.cumsum(n)
            flat = ids[np.repeat(first[at] - (total - n), n) + np.arange(int(total[-1]) if at.size else 0)]
            bounds = np.r_[0, total][np.r_[0, np.cumsum(counts[row : last + 1])]].astype(np.int32)
            parts.append(pa.RecordBatch.from_arrays([docs.slice(row, last + 1 - row), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], schema=schema))
        return pa.Table.from_batches(parts, schema)

    return run


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids: array<int>) for every row of ``docs``, as the tiktoken library would encode the text.

    Null texts count as empty and have no ids; null and repeated doc_ids each keep a row; an empty table gives
    an empty result. Special tokens are ordinary text. Other columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    pattern()
    shared = spark.sparkContext.broadcast((vocabulary(path), pretokens.code_points().tobytes()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(BUCKETS, 4 * parts)
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType
    kind = to_arrow_type(id_type)
    pieces = source.mapInArrow(_split_blocks(shared, buckets, kind), f"block long, bucket int, words binary, lengths binary, classes binary, docs array<{id_type.simpleString()}>, counts binary, stream binary")
    pieces = bucketed(pieces, parts, "block")
    words = pieces.where("words is not null").select("block", "bucket", "words", "lengths", "classes").repartition(parts, "bucket").sortWithinPartitions("bucket")
    coded = words.mapInArrow(_encode_words(shared), "block long, bucket int, classes binary, ids binary, numbers binary")
    streams = pieces.where("stream is not null").select("block", "docs", "counts", "stream")
    return streams.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(_reassemble(kind), f"doc_id {id_type.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) with column ``decoded``: the bytes of the ids, looked up in the token-byte table."""
    raw = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = {rank: token for token, rank in ranks(raw.value).items()}
        table = [by_rank.get(i, b"") for i in range(max(by_rank, default=-1) + 1)]
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                flat, bounds = part.column(1).flatten().to_numpy(), np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy())]
                texts = [b"".join(map(table.__getitem__, flat[a:b].tolist())) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def encoding_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs``."""
    both = decode_documents(encode_documents(docs, path), path)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
