"""Mixing sources to target weights by blocks, multinomial draws and index permutations (operator 7)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, WORD, each_copy, materialise, running_offsets, text_of, word_count
from .feistel import permute

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Words of a block. Output shards at least, and slots that a shard has at most in a large mix.
BLOCK, SHARDS, SHARD_SLOTS = 32, 64, 1 << 20
#: Slots that a task makes, about, and at a time.
TASK_SLOTS, PIECE = 1 << 19, 1 << 16
SEED = 7
#: A source whose whole blocks miss its target by a larger share has shorter ones. Added to a source's key for each turn.
NEAR, TURN_KEY = 0.05, 0x1_0000_0001


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Targets of sources: (source, source_size) in; rank (the number of the source, from 1) and target added.

    Sources by code point, null last, weigh ``weights``, repeating, and share ``share`` times all sizes. A target
    stops at ``most`` times its source's size; the excess is shared anew by weight until none is above. In the
    order of cap by weight, a source is capped if its cap is at most its share of what the capped ones before it
    leave, so that running sums give the end of that process at once. One row per source passes.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cap, weight = F.col("cap"), F.col("weight")
    s = sizes.withColumn("rank", F.row_number().over(order))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(most))
    every, ratio = Window.partitionBy(), Window.orderBy(cap / weight, "rank").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("all", F.sum("source_size").over(every) * share).withColumn("all_weight", F.sum("weight").over(every))
    s = s.withColumn("left", F.col("all") - F.coalesce(F.sum("cap").over(ratio), F.lit(0.0))).withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(ratio), F.lit(0.0)))
    level = F.col("left") / F.col("left_weight")
    s = s.withColumn("here", level).withColumn("capped", cap / weight <= level)
    first_open = F.min(F.when(~F.col("capped"), F.struct((cap / weight).alias("r"), F.col("rank").alias("k"), F.col("here").alias("here")))).over(every)
    return s.select("source", "rank", "source_size", F.when(F.col("capped"), cap).otherwise(first_open.getField("here") * weight).alias("target"))


def draw(left: np.ndarray, slots: int, rng: np.random.Generator) -> np.ndarray:
    """Multinomial counts of the sources for ``slots`` slots, with chances by the slots that each has left, none above these.

    What a draw gives a source beyond what it has left is drawn again among the others.
    """
    counts = np.zeros_like(left)
    while slots > 0:
        rest = left - counts
        take = np.minimum(rng.multinomial(slots, rest / rest.sum()), rest)
        counts += take
        slots -= int(take.sum())
    return counts


def shard_counts(want: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, counts) of the sources in an output shard: the slots before it and in it.

    The shards are halved again and again; at each step a draw, which its place and the seed fix, deals the slots out to
    the two halves. So any task finds the counts of its shards alone, all agree, and the sums are the sources' slots.
    """
    first, counts, low, high = np.zeros_like(want), want.copy(), 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        left = draw(counts, int(counts.sum()) * (middle - low) // (high - low), np.random.default_rng([seed, low, high]))
        if shard < middle:
            counts, high = left, middle
        else:
            first, counts, low = first + left, counts - left, middle
    return first, counts


def choose_slots(size: np.ndarray, target: np.ndarray, key: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, slots) of each source: so many slots in the order of its permutations that their words come nearest to its target.

    The last block of a source may be shorter; its place in each turn tells which slots hold it. Where the words miss the target by
    more than NEAR of it, as in sources of a few blocks, the source's block is halved, down to one word.
    """
    blocks, slots = np.full(size.size, block, np.int64), np.zeros(size.size, np.int64)
    todo = np.flatnonzero(size > 0)
    while todo.size:
        s, t, b = size[todo], target[todo], blocks[todo]
        n = -(-s // b)
        turn = np.minimum(t // s, MOST - 1).astype(np.int64)
        last = permute(n - 1, n, key[todo] + turn * TURN_KEY, back=True)
        best, off = np.zeros_like(n), np.full(n.size, np.inf)
        for more in range(3):
            k = np.minimum((t - turn * s) // b + more, n).astype(np.int64)
            miss = np.abs(turn * s + k * b - np.where(k > last, n * b - s, 0) - t)
            best, off = np.where(miss < off, k, best), np.minimum(miss, off)
        slots[todo] = turn * n + best
        todo = todo[(off > NEAR * t) & (off > 0.5) & (b > 1)]
        blocks[todo] = np.maximum(1, blocks[todo] // 2)
    return blocks, slots


def mix_slots(sources: DataFrame, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The block of each source (rank, block), and the slots of all output shards: (rank, index, turn, shard), index the block that is drawn.

    One row per source passes the driver. Each task draws the counts of its shards and permutes their slots; every turn through
    a source's blocks has a permutation of its own.
    """
    table = sources.orderBy("rank").collect()
    spark = sources.sparkSession
    size, target = np.array([r.source_size for r in table], np.int64), np.array([r.target or 0 for r in table], float)
    keys = np.array([zlib.crc32((r.source if r.source is not None else "\0").encode()) + (seed << 32) for r in table], np.int64)
    length, want = choose_slots(size, target, keys, block)
    rank, blocks = np.array([r["rank"] for r in table], np.int32), -(-size // np.maximum(length, 1))
    total = int(want.sum())
    shards = max(SHARDS, -(-total // SHARD_SLOTS))
    shared = spark.sparkContext.broadcast((rank, blocks, keys, want))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, blocks, keys, want = shared.value
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                first, counts = shard_counts(want, shards, shard, seed)
                end = np.cumsum(counts)
                for k in range(0, int(end[-1]) if end.size else 0, PIECE):
                    place = np.arange(k, min(k + PIECE, int(end[-1])))
                    source = np.searchsorted(end, place, "right")
                    slot = first[source] + place - (end - counts)[source]
                    turn = slot // blocks[source]
                    index = permute(slot - turn * blocks[source], blocks[source], keys[source] + turn * TURN_KEY)
                    yield pa.RecordBatch.from_arrays([pa.array(rank[source]), pa.array(index), pa.array(turn.astype(np.int32)), pa.array(np.full(place.size, shard, np.int32))], ["rank", "index", "turn", "shard"])

    tasks = min(shards, max(spark.sparkContext.defaultParallelism, -(-total // TASK_SLOTS)))
    lengths = spark.createDataFrame([(int(r), int(b)) for r, b in zip(rank, length)], "rank int, block long")
    return lengths, spark.range(0, shards, 1, tasks).mapInArrow(run, "rank int, index long, turn int, shard int")


def mix_blocks(docs: DataFrame, block: int = BLOCK, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, text_sha256, source, size, copy, at, rank, source_size, target, block) and the drawn runs of their words.

    ``at`` is a document's first word in its source's row of words; rank and at name a document with words. A run (rank,
    at, turn, shard, start, words) is what one drawn block holds of one document: ``words`` words from word
    ``start`` on. turn 0 draws each block of a source once at most, as does turn 1.
    """
    text = text_of(text_col)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), F.col(source_col).alias("source"), word_count(text).alias("size"))
    counted = materialise(sized.groupBy("doc_id", "text_sha256", "source", "size").agg(F.count("*").alias("copies")).withColumn("weight", F.col("size") * F.col("copies")))
    targets = materialise(source_targets(counted.groupBy("source").agg(F.sum("weight").alias("source_size"))))
    most = counted.agg(F.max("copies")).first()[0] or 0
    placed = each_copy(running_offsets(counted, "weight", ["source"], ["doc_id", "text_sha256", "size"], "at"), "copies", most, "copy")
    placed = placed.select("doc_id", "text_sha256", "source", "size", "copy", (F.col("at") + F.col("copy") * F.col("size")).alias("at"))
    lengths, slots = mix_slots(targets, block, seed)
    named = targets.join(lengths, "rank").select(F.col("source").alias("target_source"), "rank", "source_size", "target", "block")
    placed = materialise(placed.join(named, F.col("source").eqNullSafe(F.col("target_source"))).drop("target_source"))
    end = F.col("at") + F.col("size")
    parts = placed.where("size > 0").select("rank", "at", "size", "block", F.explode(F.sequence(F.floor(F.col("at") / F.col("block")), F.floor((end - 1) / F.col("block")))).alias("index"))
    low, high = F.greatest("at", F.col("index") * F.col("block")), F.least(end, (F.col("index") + 1) * F.col("block"))
    parts = parts.select("rank", "at", "index", (low - F.col("at")).cast("int").alias("start"), (high - low).cast("int").alias("words"))
    # Merge: Spark can't tell how many slots the tasks make of their few rows, and might broadcast them.
    return placed, parts.hint("merge").join(slots.hint("merge"), ["rank", "index"]).drop("index")


def mix_documents(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, shards.

    size: the words of the text (null: none). A source's words stand in one row, in an order that a hash of doc_id and
    text fixes, and are cut into blocks of ``block`` words, of fewer in sources so small that whole ones would miss their target; ``taken`` counts the words of the document's blocks that
    the mix draws, 2 times its size at most. Null sources form one source, the last; texts without words
    take nothing; repeated rows have words and draws of their own. ``shards`` says in which output shards the taken words are, as ``shard:words`` in order, joined by commas. An empty table gives an empty result. Other
    columns of ``docs`` are not looked at. The draws depend on the rows and the seed alone.
    """
    rows, runs = mix_blocks(docs, block, seed)
    by_shard = runs.groupBy("rank", "at", "shard").agg(F.sum("words").alias("words"))
    each = F.array_sort(F.collect_list(F.struct("shard", "words")))
    taken = by_shard.groupBy("rank", "at").agg(F.sum("words").alias("taken"), F.array_join(F.transform(each, lambda x: F.concat_ws(":", x["shard"], x["words"])), ",").alias("shards"))
    # Documents without words share their place with the next one, and take nothing.
    found = rows.join(taken, ["rank", "at"], "left").withColumn("taken", F.when(F.col("size") > 0, F.col("taken")))
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.when(F.col("size") > 0, F.coalesce("shards", F.lit(""))).otherwise("").alias("shards"))


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = SEED, by_shard: bool = False) -> DataFrame:
    """The mix itself, with the columns of ``documents``: for each turn, a document's drawn words in their order; ``by_shard`` for each turn and output shard, with column shard.

    A document drawn whole keeps its text as it is; otherwise text holds the drawn words, joined by spaces, and
    n_chars its length. Documents of which nothing is drawn, as empty and null texts, are left out. Null ids, languages and sources are values as any other.
    Rows that agree in id, text and source are one document in as many copies; which of their languages and n_chars a copy has is fixed by these values, whatever
    the order of the input. An empty table gives an empty result; other columns are not looked at, whatever their names.
    """
    rows, runs = mix_blocks(docs, block, seed)
    part = ["turn", "shard"] if by_shard else ["turn"]
    drawn = runs.groupBy("rank", "at", *part).agg(F.array_sort(F.collect_list(F.struct("start", "words"))).alias("runs"))
    text_or = lambda c, none: F.coalesce(F.col(c).cast("string"), F.lit(none))
    key = lambda digest: F.concat_ws("|", text_or("doc_id", "null"), digest, text_or("source", "\0null"))
    drawn = rows.where("size > 0").join(drawn, ["rank", "at"]).select(key(F.col("text_sha256")).alias("_own"), "copy", *part, "runs")
    docs = docs.select(*DOCUMENT_COLUMNS).withColumn("_own", key(F.sha2(text_of("text").cast("binary"), 256))).withColumn("_kind", F.concat_ws("|", text_or("lang", "\0"), text_or("n_chars", "\0")))
    # Copies are numbered by kind: of equal rows one is read and all copies of its kind, however many, are made of it.
    kinds = docs.groupBy("_own", "_kind").agg(F.count("*").alias("_many"))
    before = Window.partitionBy("_own").orderBy("_kind").rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("_from", F.coalesce(F.sum("_many").over(before), F.lit(0)))
    drawn = drawn.join(kinds, "_own").where("copy >= _from and copy < _from + _many").select("_own", "_kind", *part, "runs")
    once = Window.partitionBy("_own", "_kind").orderBy("n_chars")
    docs = docs.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    both = docs.join(drawn, ["_own", "_kind"])
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    # The outer array of one binds the words, so that they are found once for a text and not for each of its runs.
    some = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(w, r["start"] + 1, r["words"]))), " "))[0]
    whole = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["words"]) == word_count(F.col("text"))
    out = both.select("doc_id", F.when(whole, F.col("text")).otherwise(some).alias("text"), "lang", "source", *part[1:])
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), *part[1:])
