"""A partitioned vector index: vectors by cell, searched by probing cells, with an exact way.

``build_index`` fits ``cells`` centres (spherical k-means) on a sample of at
most ``SAMPLE`` vectors, sends the centres to the tasks and packs the
unit vectors of each cell into blocks of at most ``BLOCK``, so neither a hot
cell nor a long table fills a task.  Every vector is indexed.  A cell's radius
is the greatest angle between its centre and one of its vectors.

``search`` probes the ``probes`` nearest cells of every query.  With
``exact=True`` it then visits the cells that could hold something nearer: for
a vector x of a cell with centre c, angle(q, x) >= angle(q, c) - radius, so a
cell whose bound is beyond the k-th angle found so far is left out.
``near_pairs`` finds all pairs within a distance in the same manner: two cells
are compared unless their centres are farther apart than both radii and the
angle of that distance together.

What is compared are blocks, by one matrix product in numpy; only hits become
rows.  Vectors that are null, empty, of length 0 or have fewer numbers than
others are near nothing and not indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import saved

#: Vectors that the centres are fitted on at most, about; most cells; vectors of a block; queries that go out together.
SAMPLE, MOST_CELLS, BLOCK, QUERY_BLOCK = 20_000, 1024, 512, 4096
#: Most tasks that pack blocks.
MOST_RANGES = 20_000
#: Vectors of one space that are compared in one task with as many others, about.
RUN = 16_384
PASSES = 8
#: Slack for bounds on angles, which are computed in double precision.
SLACK = 1e-6


@dataclass
class VectorIndex:
    """``blocks(cell, space, ids, vectors)``; ``centres`` (as long as the vectors are) and ``radii`` by cell; whether an id may be ``repeated``."""

    blocks: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    repeated: bool = True


def _units(rows: list) -> np.ndarray:
    x = np.asarray(rows, float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means from the sample's own rows, spread by farthest first; equal samples give equal centres."""
    order = np.lexsort(sample.T[::-1])
    sample = sample[order]
    centres = [sample[0]]
    near = sample @ centres[0]
    while len(centres) < min(cells, len(sample)):
        at = int(np.argmin(near))
        if near[at] > 1 - 1e-12:
            break
        centres.append(sample[at])
        near = np.maximum(near, sample @ sample[at])
    centres = np.array(centres)
    for _ in range(PASSES):
        cell = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def usable(vectors: DataFrame, size: int | None = None) -> DataFrame:
    """Rows whose vector has a direction, and ``size`` numbers."""
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return vectors.where(F.size("embedding") > 0 if size is None else F.size("embedding") == size).where(length > 0)


def build_index(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """The index of ``vectors(id, space, embedding)``; pairs and hits are only looked for within one ``space``."""
    rows = usable(vectors).select(F.col("id").cast("long").alias("id"), F.col("space").cast("string").alias("space"), "embedding")
    count, dimensions = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    dimensions = dimensions or 1
    rows = rows.where(F.size("embedding") == dimensions)
    if cells is None:
        cells = max(1, min(MOST_CELLS, round(count**0.5 / 2)))
    place = F.pmod(F.xxhash64(F.lit(5), "id", "embedding"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.where(place < min(1.0, sample / max(1, count))).select("embedding").limit(2 * sample).toArrow()["embedding"].to_pylist()
    if not drawn:
        drawn = [r[0] for r in rows.select("embedding").limit(1).collect()] or [[1.0] * dimensions]
    centres = fit_centres(_units(drawn), cells)
    sent = vectors.sparkSession.sparkContext.broadcast(centres)

    @F.arrow_udf("struct<cell:int,angle:double>")
    def cell_of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            cosine = _units(column.to_pylist()) @ sent.value.T if len(column) else np.zeros((0, 1))
            best = np.argmax(cosine, axis=1) if len(column) else np.zeros(0, int)
            yield pa.StructArray.from_arrays([pa.array(best, pa.int32()), pa.array(_angle(cosine[np.arange(len(best)), best]))], ["cell", "angle"])

    placed = saved(rows.withColumn("at", cell_of("embedding")).select("id", "space", "embedding", F.col("at.cell").alias("cell"), F.col("at.angle").alias("angle")))
    sizes = placed.groupBy("cell").agg(F.max("angle").alias("radius")).collect()  # one row a cell
    repeated = bool(placed.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count())
    radii = np.zeros(len(centres))
    for r in sizes:
        radii[r["cell"]] = r["radius"]
    # Ranges of (space, cell, id), so that a hot cell is many ranges.
    ranges = max(1, min(MOST_RANGES, round(count / (16 * BLOCK))))
    dealt = placed.select("space", "cell", "id", "embedding").repartitionByRange(ranges, "space", "cell", "id").sortWithinPartitions("space", "cell", "id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, rows = None, [], []
        kind = pa.schema([("cell", pa.int32()), ("space", pa.string()), ("ids", pa.binary()), ("vectors", pa.binary())])

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"cell": held[1], "space": held[0], "ids": np.array(ids, np.int64).tobytes(), "vectors": _units(rows).tobytes()}], schema=kind)

        for b in batches:
            for space, cell, i, v in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if held != (space, cell) or len(ids) == BLOCK:
                    if ids:
                        yield block()
                    held, ids, rows = (space, cell), [], []
                ids.append(i)
                rows.append(v)
        if ids:
            yield block()

    return VectorIndex(saved(dealt.mapInArrow(pack, "cell int, space string, ids binary, vectors binary")), centres, radii, repeated)


def _block(batch: pa.RecordBatch, row: int, ids: int, vectors: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(batch.column(ids)[row].as_buffer(), np.int64)
    return i, np.frombuffer(batch.column(vectors)[row].as_buffer(), np.float64).reshape(len(i), -1)


def _visit(index: VectorIndex, names: list, units: np.ndarray, visits: np.ndarray, k: int, spaces: list | None) -> DataFrame:
    """``query, id, distance``: of each block the k nearest of each query that visits its cell (``visits``: queries by cells) and asks for its space."""
    cells = np.flatnonzero(visits.any(axis=0)).tolist()
    sent = index.blocks.sparkSession.sparkContext.broadcast((np.array(names, np.int64), units, visits, spaces))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, units, visits, spaces = sent.value
        for b in batches:
            for row in range(b.num_rows):
                ids, vectors = _block(b, row, 1, 2)
                asks = visits[:, b.column(0)[row].as_py()]
                if spaces is not None:
                    space = b.column(3)[row].as_py()
                    asks = asks & np.array([s == space for s in spaces])
                asking = np.flatnonzero(asks)
                if not len(asking):
                    continue
                distance = np.round(1 - units[asking] @ vectors.T, 9) + 0.0  # no -0.0
                who, what = [], []
                for j in range(len(asking)):
                    d = distance[j]
                    near = np.arange(len(d)) if len(d) <= k else np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                    near = near[np.lexsort((ids[near], d[near]))][:k]
                    who.append(np.full(len(near), j))
                    what.append(near)
                who, what = np.concatenate(who), np.concatenate(what)
                yield pa.RecordBatch.from_arrays([pa.array(names[asking[who]]), pa.array(ids[what]), pa.array(distance[who, what])], ["query", "id", "distance"])

    return index.blocks.where(F.col("cell").isin(cells)).select("cell", "ids", "vectors", "space").mapInArrow(score, "query long, id long, distance double")


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "id", "distance", "rank")


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int = 8, exact: bool = True, within: bool = False) -> DataFrame:
    """``query, id, distance, rank``: the k nearest of ``queries(id, embedding)``, ties by id; distances to 9 digits.

    ``within``: a query has a ``space`` and finds what is in it.  The queries
    go out in blocks of ``QUERY_BLOCK``.
    """
    space = F.col("space").cast("string") if within else F.lit(None).cast("string")
    asked = saved(usable(queries, index.centres.shape[1]).select(F.col("id").cast("long").alias("id"), "embedding", space.alias("space")))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("id").collect()
        if not rows:
            continue
        names, units = [r["id"] for r in rows], _units([r["embedding"] for r in rows])
        spaces = [r["space"] for r in rows] if within else None
        angles = _angle(units @ index.centres.T)
        visits = np.zeros(angles.shape, bool)
        np.put_along_axis(visits, np.argsort(angles, axis=1, kind="stable")[:, :probes], True, axis=1)
        hits = saved(_best(_visit(index, names, units, visits, k, spaces), k))
        if exact:
            # At most k rows of each query of the block.
            last = {r["query"]: r["distance"] for r in hits.where(F.col("rank") == k).select("query", "distance").collect()}
            reach = _angle(1 - np.array([last.get(n, 3.0) for n in names]))
            more = ~visits & (angles - index.radii[None, :] <= reach[:, None] + SLACK)
            if more.any():
                hits = saved(_best(hits.drop("rank").unionByName(_visit(index, names, units, more, k, spaces)), k))
        found = hits if found is None else found.unionByName(hits)
    return found if found is not None else index.blocks.sparkSession.createDataFrame([], "query long, id long, distance double, rank int")


def _grouped(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks with ``part``, and ``space, part, cells``: the blocks of a space in runs of about ``RUN`` vectors, in the order of their cells.

    One small row a block is ordered for that; the vectors stay where they are.
    """
    size = blocks.select("space", "cell", F.xxhash64("ids").alias("h"), (F.length("ids") / 8).cast("long").alias("n"))
    before = F.sum("n").over(Window.partitionBy("space").orderBy("cell", "h").rowsBetween(Window.unboundedPreceding, -1))
    placed = size.withColumn("part", F.floor(F.coalesce(before, F.lit(0)) / RUN).cast("int")).select("space", "cell", "h", "part").distinct()
    named = blocks.withColumn("h", F.xxhash64("ids")).alias("b").join(placed.alias("p"), F.col("b.space").eqNullSafe(F.col("p.space")) & (F.col("b.cell") == F.col("p.cell")) & (F.col("b.h") == F.col("p.h")))
    return named.select("b.space", "b.cell", "b.h", "b.ids", "b.vectors", "p.part"), placed.groupBy("space", "part").agg(F.collect_set("cell").alias("cells"))


def near_pairs(index: VectorIndex, most: float, other: VectorIndex | None = None) -> DataFrame:
    """``a, b, distance``: all pairs of one space that are nearer than ``most``; with ``other``, a is of the index and b of the other.

    Without it a < b.  The blocks of a space go in runs of about ``RUN``
    vectors, and two runs meet in one task if a cell of the one may hold a
    vector near one of a cell of the other; so a vector is sent once for each
    run that it meets, not for each cell.  Only hits leave the task, and are
    shuffled only if an id is repeated.
    """
    angle = float(_angle(np.array(1 - most)))
    second = other or index
    alone = other is None
    apart = _angle(index.centres @ second.centres.T)
    spark = index.blocks.sparkSession
    meet = apart <= index.radii[:, None] + second.radii[None, :] + angle + SLACK
    sent = spark.sparkContext.broadcast(meet)  # at most MOST_CELLS squared
    left, runs = _grouped(index.blocks)
    right, others = (left, runs) if alone else _grouped(second.blocks)

    @F.arrow_udf("boolean")
    def may_meet(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([bool(sent.value[np.ix_(p, q)].any()) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.bool_())

    x, y = runs.select("space", F.col("part").alias("x"), F.col("cells").alias("p")), others.select(F.col("space").alias("s"), F.col("part").alias("y"), F.col("cells").alias("q"))
    task = saved(x.join(y, F.col("space").eqNullSafe(F.col("s")) & (F.col("x") <= F.col("y") if alone else F.lit(True))).where(may_meet("p", "q")).select("space", "x", "y").withColumn("task", F.monotonically_increasing_id()))
    at = lambda rows, run, side: rows.alias("b").join(task.alias("t"), F.col("b.space").eqNullSafe(F.col("t.space")) & (F.col("b.part") == F.col(f"t.{run}"))).select("t.task", F.lit(side).alias("side"), "b.cell", "b.ids", "b.vectors", (F.col("t.x") == F.col("t.y")).alias("same"), "b.h")
    rows = at(left, "x", 0)
    rows = rows.unionByName(at(right, "y", 1).where("NOT same") if alone else at(right, "y", 1))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []
        for b in batches:
            for row in range(b.num_rows):
                at, second, cell, same = (b.column(k)[row].as_py() for k in (0, 1, 2, 5))
                j, w = _block(b, row, 3, 4)
                if at != task:
                    task, held = at, []
                within = alone and same
                if not second:
                    held.append((cell, j, w))  # with the block itself, where a run meets itself
                    if not within:
                        continue
                for c, i, v in held:
                    if not sent.value[c, cell]:
                        continue
                    cosine = v @ w.T
                    near = cosine > 1 - most - 1e-8  # few are rounded
                    x, y = np.nonzero(np.triu(near, 1) if within and i is j else near)
                    a, c2, d = i[x], j[y], np.round(1 - cosine[x, y], 9) + 0.0
                    keep = d < most
                    if alone:
                        keep &= a != c2
                        a, c2 = np.minimum(a, c2), np.maximum(a, c2)
                    a, c2, d = a[keep], c2[keep], d[keep]
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c2), pa.array(d)], ["a", "b", "distance"])

    dealt = rows.repartition("task").sortWithinPartitions("task", "side", "cell", "h").select("task", "side", "cell", "ids", "vectors", "same")
    hits = dealt.mapInArrow(compare, "a long, b long, distance double")
    return hits.groupBy("a", "b").agg(F.min("distance").alias("distance")) if index.repeated or second.repeated else hits


def nearest_of_label(vectors: DataFrame, k: int, run: int = RUN) -> DataFrame:
    """``query, id, distance``: of ``vectors(id, label, embedding, asks)`` the k nearest not asking ones of the label of each that asks, ties by id; distances to 6 digits.

    The vectors of a label go in runs of about ``run``, an eighth of it where
    they ask; two runs meet in one task as matrices, which gives the k nearest
    of each query, so no pair becomes a row.  A vector that is null, has no
    length or a length of its own is compared by columns; a distance that is no number or unknown comes last.
    """
    length = F.aggregate("embedding", F.lit(0.0), lambda n, x: n + x.cast("double") * x)
    rows = vectors.where(F.col("label").isNotNull() & F.col("asks").isNotNull()).withColumns({"norm": F.sqrt(length), "size": F.size("embedding")})
    usual = rows.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    fits = F.coalesce((F.col("size") == (usual["size"] if usual else 0)) & (F.col("norm") > 0) & (F.col("norm") < float("inf")), F.lit(False))
    held = saved(rows.withColumn("fits", fits))
    counts = held.where("fits").groupBy("label").agg(F.count_if("asks").alias("q"), F.count_if(~F.col("asks")).alias("m"))
    runs = counts.select("label", F.greatest(F.lit(1), F.ceil(F.col("q") * 8 / run)).cast("int").alias("qs"), F.greatest(F.lit(1), F.ceil(F.col("m") / run)).cast("int").alias("ms"))
    of = lambda many: F.pmod(F.xxhash64("id", "embedding"), F.col(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    fit = held.where("fits").join(runs, "label")
    asking = fit.where("asks").select("label", of("qs").alias("x"), every("ms").alias("y"), "id", "embedding")
    asked = fit.where("NOT asks").select(F.col("label").alias("l"), of("ms").alias("run"), every("qs").alias("met"), F.col("id").alias("i"), F.col("embedding").alias("v"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        q, w, i, v = left["id"].to_numpy(), _units(left["embedding"].to_pylist()) if len(left) else None, right["i"].to_numpy(), _units(right["v"].to_pylist()) if len(right) else None
        who, what, far = [], [], []
        for a in range(0, len(q) if len(i) else 0, BLOCK):
            distance = np.round(1 - w[a : a + BLOCK] @ v.T, 6) + 0.0  # no -0.0
            for j, d in enumerate(distance):
                near = np.arange(len(d)) if len(d) <= k else np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                near = near[np.lexsort((i[near], d[near]))][:k]
                who.append(np.full(len(near), q[a + j]))
                what.append(i[near])
                far.append(d[near])
        cat = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0), kind)
        return pa.table({"query": cat(who, pa.int64()), "id": cat(what, pa.int64()), "distance": cat(far, pa.float64())})

    found = asking.groupBy("label", "x", "y").cogroup(asked.groupBy("l", "met", "run")).applyInArrow(compare, "query long, id long, distance double")
    dot = F.aggregate(F.zip_with("a.embedding", "b.embedding", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda n, x: n + x)
    norms = F.col("a.norm") * F.col("b.norm")
    side = lambda asks, name: held.where(F.col("asks") == asks).alias(name)
    odd = side(True, "a").join(side(False, "b"), (F.col("a.label") == F.col("b.label")) & ~(F.col("a.fits") & F.col("b.fits")))
    odd = odd.select(F.col("a.id").alias("query"), F.col("b.id").alias("id"), F.round(1 - F.coalesce(F.try_divide(dot, F.nullif(norms, F.lit(0.0))), F.when(norms == 0, F.lit(float("nan")))), 6).alias("distance"))
    if held.where("NOT fits").limit(1).count():
        found = found.unionByName(odd)
    order = Window.partitionBy("query").orderBy(F.asc_nulls_last("distance"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
