"""Near-duplicate embeddings by an exact metric range join: pivots, triangle inequality, cells on their own (operator 11).

Unit vectors with a cosine of at least c are at a distance of at most r = sqrt(2 - 2c). A group of vectors (one label, one length) that is
too large for a task is dealt out to the cells of pivots, each vector to its nearest. A cell is a ball round its pivot, in which any two are
linked by the triangle inequality, or the ring beyond that. Of another cell's vector the inequality says that it is linked with a whole cell,
which is counted and not compared, with none of it, or that it must be copied there. A cell that is still too large is dealt out again. Vectors
that are equal in all components count as one class with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import heavy_join, materialise
from .components import components

COSINE = 0.93
#: Vectors that a cell holds at most before it is dealt out, pivots of a cell at most, and how often it is dealt out; what is too large then is cut into blocks.
CELL, FAN, LEVELS = 1024, 64, 3
#: Rows of one cell that a task takes, about.
CHUNK = 1 << 15
#: Room for rounding in distances, and in cosines that are computed once more.
SLACK, NEAR = 1e-6, 1e-9

_OUT = "kind int, unit string, home boolean, sure boolean, node long, other long, w long, vec array<double>"
_ROW, _CREDIT, _CELL, _EDGE = range(4)

ORACLE = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
r(u, v) AS (SELECT u, v FROM p UNION SELECT r.u, p.v FROM r JOIN p ON p.u = r.v),
l AS (SELECT u, count(*) AS n FROM p GROUP BY u), c AS (SELECT u, min(v) AS m FROM r GROUP BY u)
SELECT e.vec_id, coalesce(l.n, 0) AS n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) AS component_id, c.m IS NULL OR e.vec_id <= c.m AS kept
FROM embeddings e LEFT JOIN l ON l.u = e.vec_id LEFT JOIN c ON c.u = e.vec_id"""


def usable(vec: Column) -> Column:
    """Whether a vector has a direction: no null, no null or non-finite component, and one that is not zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _matrix(vec: pa.Array) -> np.ndarray:
    """Vectors of one length, scaled to length one."""
    x = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Stretches of rows with one (unit, salt, role), and whether a new (unit, salt) begins."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        unit, salt, role = batch.column("unit"), batch.column("salt").to_numpy(), batch.column("role").to_numpy()
        code = unit.dictionary_encode().indices.to_numpy()
        cut = np.flatnonzero((np.diff(code) != 0) | (np.diff(salt) != 0) | (np.diff(role) != 0)) + 1
        for low, high in zip([0, *cut], [*cut, batch.num_rows]):
            key = (unit[int(low)].as_py(), int(salt[low]))
            yield key != last, batch.slice(low, high - low)
            last = key


def _frame(kind: int, n: int, **columns) -> pa.RecordBatch:
    names = [x.split()[0] for x in _OUT.split(", ")]
    types = {"kind": pa.int32(), "unit": pa.string(), "home": pa.bool_(), "sure": pa.bool_(), "vec": pa.list_(pa.float64())}
    columns["kind"] = np.full(n, kind, np.int32)
    made = [pa.array(columns[c], types.get(c, pa.int64())) if c in columns else pa.nulls(n, types.get(c, pa.int64())) for c in names]
    return pa.RecordBatch.from_arrays(made, names)


def _radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, pivot, ring, rows, w, low, high, rep) of the homes that each cell gets from a stretch."""
    pivots = None
    for new, piece in _pieces(batches):
        if new:
            pivots = np.empty((0, 0))
        if piece.column("role")[0].as_py() == 0:
            pivots = np.vstack([pivots, _matrix(piece.column("vec"))]) if pivots.size else _matrix(piece.column("vec"))
            continue
        piece = piece.filter(piece.column("home"))
        if not piece.num_rows:
            continue
        far = _far(_matrix(piece.column("vec")), pivots)
        at = far.argmin(axis=1)
        d = far[np.arange(at.size), at]
        cell = 2 * at + (d > _ball())
        w, node = piece.column("w").to_numpy(), piece.column("node").to_numpy()
        each = [(int(c), cell == c) for c in np.unique(cell)]
        columns = [
            pa.array([piece.column("unit")[0].as_py()] * len(each)), pa.array([c for c, _ in each], pa.int32()), *[pa.array([int(f(x[own])) for _, own in each]) for f, x in ((np.size, w), (np.sum, w))],
            *[pa.array([float(f(d[own])) for _, own in each]) for f in (np.min, np.max)], pa.array([int(node[own].min()) for _, own in each]),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["unit", "cell", "rows", "w", "low", "high", "rep"])


def _reach() -> float:
    return float(np.sqrt(2.0 - 2.0 * COSINE))


def _ball() -> float:
    """The radius in which any two are linked."""
    return (_reach() - SLACK) / 2


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the cells, links that are certain, and edges. Homes go to the cell of their nearest pivot; pairs of two cells are met in the one of the smaller number."""
    r, pivots, table = _reach() + SLACK, None, None
    for new, piece in _pieces(batches):
        if new:
            pivots, table = np.empty((0, 0)), []
        if piece.column("role")[0].as_py() == 0:
            pivots = np.vstack([pivots, _matrix(piece.column("vec"))]) if pivots.size else _matrix(piece.column("vec"))
            table += piece.column("cells").to_pylist()
            between = _far(pivots, pivots)
            continue
        unit = piece.column("unit")[0].as_py()
        x, home = _matrix(piece.column("vec")), piece.column("home").to_numpy(zero_copy_only=False)
        w, node = piece.column("w").to_numpy(), piece.column("node").to_numpy()
        far = _far(x, pivots)
        at = far.argmin(axis=1)
        d = far[np.arange(at.size), at]
        own = np.where(home, 2 * at + (d > _ball()), 1 << 30)
        part = lambda pick, c, is_home: _frame(_ROW, int(pick.sum()), unit=[f"{unit}.{c}"] * int(pick.sum()), home=np.full(int(pick.sum()), is_home), sure=np.full(int(pick.sum()), c % 2 == 0), node=node[pick], w=w[pick], vec=piece.column("vec").filter(pa.array(pick)))
        for i, cells in enumerate(table):
            # How far a vector is from the half space nearer to this pivot than to its own: no home of this cell is nearer.
            gap = np.maximum(between[i, at], 1e-300)
            beyond = (far[:, i] ** 2 - d**2) / (2 * gap) > r
            beyond[between[i, at] < 1e-3] = False
            for cell in cells or []:
                c = cell["cell"]
                mine = own == c
                if mine.any():
                    yield part(mine, c, True)
                    if c % 2 == 0:
                        yield _frame(_CREDIT, int(mine.sum()), node=node[mine], w=cell["w"] - w[mine], other=np.full(int(mine.sum()), cell["rep"]))
                near = (own > c) & ~beyond & (far[:, i] <= cell["high"] + r) & (far[:, i] >= cell["low"] - r)
                certain = near & (far[:, i] + cell["high"] <= _reach() - SLACK)
                if certain.any():
                    n = int(certain.sum())
                    yield _frame(_CREDIT, n, node=node[certain], w=np.full(n, cell["w"]), other=np.full(n, cell["rep"]))
                    yield _frame(_CELL, 1, unit=[f"{unit}.{c}"], w=[int(w[certain].sum())], other=[cell["rep"]])
                near &= ~certain
                if near.any():
                    yield part(near, c, False)


def _linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of unit vectors are linked; cosines very near to the limit are summed once more, by themselves."""
    cos = a @ b.T
    for i, j in np.argwhere(np.abs(cos - COSINE) < NEAR):
        cos[i, j] = float(np.dot(a[i], b[j]) / (np.sqrt(np.dot(a[i], a[i])) * np.sqrt(np.dot(b[j], b[j]))))
    return cos >= COSINE


class _Groups:
    """Which homes of a cell are known to be connected."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def add(self, links: np.ndarray) -> None:
        """Homes that have a link from the same row (of links, boolean) belong together."""
        rows = np.flatnonzero(links.any(axis=1))
        while rows.size:
            here = links[rows]
            low = np.where(here, self.of, self.of.size).min(axis=1)
            rows = rows[np.where(here, self.of, -1).max(axis=1) > low]
            if rows.size:
                met = np.unique(self.of[links[rows[0]]])
                self.of[np.isin(self.of, met)] = met[0]
                rows = rows[1:]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the vectors of cells: homes (role 0), which a task holds, with one another (in the first stretch of a cell) and with the rows that pass by."""

    def done():
        if homes is not None and homes.size:
            some = np.flatnonzero(count)
            if some.size:
                yield _frame(_CREDIT, some.size, node=node[some], w=count[some])
            tied = np.flatnonzero(groups.of != np.arange(groups.of.size))
            if tied.size:
                yield _frame(_EDGE, tied.size, node=node[tied], other=node[groups.of[tied]])

    homes = None
    for new, piece in _pieces(batches):
        x, w_x, node_x = _matrix(piece.column("vec")), piece.column("w").to_numpy(), piece.column("node").to_numpy()
        if new:
            yield from done()
            homes, w, node, count, groups = np.empty((0, x.shape[1])), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), _Groups(0)
        if piece.column("role")[0].as_py() == 0:
            inside = not piece.column("sure")[0].as_py() and piece.column("salt")[0].as_py() == 0
            homes, w, node = np.vstack([homes, x]), np.concatenate([w, w_x]), np.concatenate([node, node_x])
            count, groups = np.concatenate([count, np.zeros(len(x), np.int64)]), _Groups(len(homes))
            if inside:
                count[:] = 0
                for k in range(0, len(homes), 1024):
                    links = _linked(homes[k : k + 1024], homes)
                    links[np.arange(len(links)), k + np.arange(len(links))] = False
                    count[k : k + 1024] = links @ w
                    links[np.arange(len(links)), k + np.arange(len(links))] = links.any(axis=1)
                    groups.add(links)
            continue
        for k in range(0, len(x), 1024):
            links = _linked(x[k : k + 1024], homes)
            hit = np.flatnonzero(links.any(axis=1))
            if hit.size:
                links = links[hit]
                count += w_x[k + hit] @ links
                groups.add(links)
                yield _frame(_CREDIT, hit.size, node=node_x[k + hit], w=links @ w, other=node[links.argmax(axis=1)])
    yield from done()


def _dealt(rows: DataFrame, held: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over ``rows`` (unit, salt, role 1), each stretch after the rows of ``held`` (role 0) with its unit and salt."""
    every = held.unionByName(rows, allowMissingColumns=True)
    return every.repartition("unit", "salt").sortWithinPartitions("unit", "salt", "role", "node").mapInArrow(run, schema)


def _salted(rows: DataFrame) -> DataFrame:
    """Rows with a salt below the ``salts`` of their unit, and role 1."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("node", F.lit("salt")), "salts").cast("int")).withColumn("role", F.lit(1)).drop("salts")


def _copied(rows: DataFrame) -> DataFrame:
    """A copy of each row for every salt of its unit, with role 0."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts").cast("int") - 1))).withColumn("role", F.lit(0)).drop("salts")


def _split(work: DataFrame, cell: int, level: int) -> DataFrame:
    """One dealing out of ``work`` (with homes and salts of its units) to the cells of pivots: rows as _OUT has them, written."""
    rows = work.select("unit", "home", "node", "w", "vec", "salts")
    # About so many homes as pivots, by a hash; a unit in which that chooses none has its first by that hash.
    mark = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 40))
    share = F.least(F.lit(float(FAN)), F.ceil(F.col("homes") / cell) * 2.0) / F.col("homes") * float(1 << 40)
    marked = work.where("home").select("unit", "node", "w", "vec", "salts", mark.alias("mark"), share.alias("share"))
    few = materialise(marked.where("mark < share"))
    none = marked.join(few.select("unit").distinct(), "unit", "left_anti").groupBy("unit").agg(F.min_by(F.struct("node", "w", "vec", "salts"), F.struct("mark", "node")).alias("p")).select("unit", "p.*")
    pivots = few.select("unit", "node", "w", "vec", "salts").unionByName(none)
    pivots = materialise(pivots.withColumn("place", F.row_number().over(Window.partitionBy("unit").orderBy("node")) - 1))
    own = pivots.drop("place")
    found = _dealt(_salted(rows), _copied(own), _radii, "unit string, cell int, rows long, w long, low double, high double, rep long")
    stats = found.groupBy("unit", "cell").agg(F.sum("w").alias("w"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("rep").alias("rep"))
    cells = stats.groupBy("unit", F.floor(F.col("cell") / 2).cast("int").alias("place")).agg(F.collect_list(F.struct("cell", "w", "low", "high", "rep")).alias("cells"))
    return materialise(_dealt(_salted(rows), _copied(pivots.join(cells, ["unit", "place"], "left").drop("place")), _deal, _OUT))


def _ready(work: DataFrame, cell: int) -> DataFrame:
    """Rows of units as :func:`_compare` takes them: what a cell has too many of is cut into blocks, and each pair of blocks meets in the first of them."""
    blocks = F.ceil(F.col("homes") / cell).cast("int")
    own = work.withColumn("blocks", blocks).withColumn("block", F.when(F.col("home"), F.pmod(F.xxhash64("node", F.lit("block")), "blocks")).cast("int"))
    name = F.concat_ws("#", "unit", "at")
    pick = lambda df: df.select(name.alias("unit"), "sure", "node", "w", "vec", "salts")
    homes = _copied(pick(own.where("home").withColumn("at", F.col("block"))))
    last = F.when(F.col("home"), F.col("block") - 1).otherwise(F.col("blocks") - 1)
    passing = own.where("not home or not sure and block > 0").withColumn("at", F.explode(F.sequence(F.lit(0), last)))
    return _dealt(_salted(pick(passing)), homes, _compare, _OUT)


def class_links(classes: DataFrame, cell: int = CELL, chunk: int = CHUNK, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(node, links) and edges (u, v) that connect what is linked, of classes (node, unit, w, vec): vectors of one unit with their weights."""
    work = classes.select("unit", F.lit(True).alias("home"), F.lit(False).alias("sure"), "node", "w", "vec")
    found = []
    for level in range(levels + 1):
        sizes = work.groupBy("unit").agg(F.count_if("home").alias("homes"), F.count("*").alias("every"), F.first("sure").alias("all_sure"))
        # Nothing is left to compare in a cell of one row, or of homes whose links are all certain.
        sizes = sizes.where("homes > 0 and every > 1 and not (all_sure and homes = every)")
        sizes = materialise(sizes.select("unit", "homes", F.ceil(F.col("every") / chunk).alias("salts"), ((F.col("homes") <= cell) | F.col("all_sure") | F.lit(level == levels)).alias("last")))
        found.append(_ready(work.join(sizes.where("last"), "unit"), cell))
        if sizes.where("not last").isEmpty():
            break
        out = _split(work.join(sizes.where("not last"), "unit"), cell, level)
        found.append(out)
        work = out.where(F.col("kind") == _ROW).select("unit", "home", "sure", "node", "w", "vec")
        # What rows elsewhere are certainly linked with all homes of a cell: their weights go to each of these.
        given = out.where(F.col("kind") == _CELL).groupBy("unit").agg(F.sum("w").alias("more"), F.min("other").alias("rep"))
        found.append(work.where("home").join(given, "unit").select(F.lit(_CREDIT).alias("kind"), "node", F.col("more").alias("w"), F.col("rep").alias("other")))
    names = ["kind", "node", "w", "other"]
    every = found[0].select(*names)
    for df in found[1:]:
        every = every.unionByName(df.select(*names))
    every = materialise(every.where(F.col("kind").isin(_CREDIT, _EDGE)))
    links = every.where("w > 0").groupBy("node").agg(F.sum("w").alias("links"))
    edges = every.where((F.col("kind") == _EDGE) | (F.col("w") > 0)).where("other is not null and node <> other").select(F.col("node").alias("u"), F.col("other").alias("v")).distinct()
    return links, edges


def link_embeddings(embeddings: DataFrame, cell: int = CELL, chunk: int = CHUNK, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``embeddings``: vec_id, n_links, component_id, kept.

    Vectors are linked if their labels and lengths are equal and their cosine is at least COSINE; n_links counts the other rows that a row is linked with, and
    component_id is the smallest vec_id that links lead to. A vector that is null, empty or zero or holds null or non-finite components, or whose label is
    null, is linked with nothing. Repeated rows are rows of their own and linked with each other; rows with one vec_id count each for themselves. A null
    vec_id is larger than any other, and kept where it is alone. An empty table gives an empty result; other columns are not looked at.
    """
    vec = F.col("embedding").cast("array<double>")
    rows = embeddings.select("vec_id", F.when(usable(F.col("embedding")) & F.col("label").isNotNull(), F.col("label").cast("string")).alias("_label"), vec.alias("vec"))
    unit = F.concat_ws("/", "_label", F.size("vec").cast("string"))
    rows = rows.withColumn("_key", F.when(F.col("_label").isNotNull(), F.sha2(F.concat_ws(",", unit, F.col("vec").cast("array<string>")), 256)))
    good = rows.where("_key is not null")
    once = good.groupBy("_key").agg(F.count("*").alias("w"), F.min("vec_id").alias("least"), F.first("vec").alias("vec"), F.first(unit).alias("unit"))
    classes = materialise(once.withColumn("node", F.monotonically_increasing_id()))
    links, edges = class_links(classes, cell, chunk, levels)
    root = components(edges)
    ids = classes.select("node", "least", "w", "_key").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = ids.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n"))
    ids = materialise(heavy_join(ids, least, "root", "n", classes.count()).join(links, "node", "left"))
    table = ids.select("_key", "w", "component", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.col("w").alias("copies"))
    linked = heavy_join(good.select("vec_id", "_key"), table, "_key", "copies", good.count())
    out = linked.select("vec_id", "n_links", "component").unionByName(rows.where("_key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component")))
    component = F.col("component").cast("long")
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))
