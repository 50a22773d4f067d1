"""Nearest neighbours by cosine through shifted Hilbert orderings."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domweave.session import written

BITS = 7
#: Vectors, and bytes of them, that a cell of the check has at most: queries, which are held, and rows, which pass by.
CELL_QUERIES, CELL_ROWS = (1 << 15, 16 << 20), (1 << 17, 64 << 20)
#: Queries that are multiplied with a block at a time.
STRIPE = 2048


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of grid cells (rows of ``dims`` integers of ``bits`` bits), after Skilling (2004)."""
    x = [c.astype(np.int64) for c in cells.T]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = x[0] ^ np.where(on, p, swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros(len(cells), np.int64), top
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | ((c ^ t) >> bit) & 1
    return key


def curve_keys(unit: np.ndarray, ordering: int, dims: int, seed: int = 11) -> np.ndarray:
    """Keys of unit vectors in one ordering: its own orthonormal projection, grid shift and curve."""
    random = np.random.default_rng([seed, ordering])
    dims = min(dims, unit.shape[1])
    basis, _ = np.linalg.qr(random.standard_normal((unit.shape[1], dims)))
    # projections of unit vectors in many dimensions lie within a few 1/sqrt(n)
    spread = 4 / np.sqrt(unit.shape[1])
    cells = (unit @ basis / spread + 1 + random.random(dims)) / 3 * (1 << BITS)
    return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64))


def _matrix(blob: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(blob, np.float64).reshape(rows, -1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """vec_id, vec: usable vectors as bytes of doubles, equal vectors as equal bytes."""
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    own = own.where(F.col("vec_id").isNotNull() & usable(F.col("v")))

    def pack(batches):
        for batch in batches:
            lists = batch.column(1)
            values, ends = lists.flatten().to_numpy(zero_copy_only=False) + 0.0, np.cumsum(lists.value_lengths().to_numpy())
            blobs = [values[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["vec_id", "vec"])

    return own.mapInArrow(pack, "vec_id long, vec binary")


_BLOCK = pa.schema([("o", pa.int32()), ("pid", pa.int64()), ("seq", pa.int64()), ("n", pa.int32()), ("vecs", pa.binary()),
                    ("ids", pa.list_(pa.list_(pa.int64()))), ("asked", pa.list_(pa.bool_()))])
_BLOCK_DDL = "o int, pid long, seq long, n int, vecs binary, ids array<array<long>>, asked array<boolean>"
_FOUND_DDL = "class long, vec_id long, score double"


def _best(classes, scores: np.ndarray, ids, k: int, floor: np.ndarray | None = None):
    """(class, vec_id, score) of each row's ``k`` best ids, all ids of tied vectors considered; only scores from ``floor`` on."""
    out = []
    for i, (c, own) in enumerate(zip(classes, scores)):
        least = np.partition(own, len(own) - k)[len(own) - k] if len(own) > k else -np.inf
        if floor is not None:
            least = max(least, floor[i])
        at = np.flatnonzero(own >= least)
        if len(at):
            some = sorted((-own[j], v) for j in at for v in ids[j])[:k]
            out += [(c, v, -s) for s, v in some]
    return out


def _found(rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                                      names=["class", "vec_id", "score"])


class _Cell:
    """Queries of a cell, each with the ``k`` best rows found for it so far and the score from which a row counts."""

    def __init__(self, parts: list, k: int):
        self.k, self.classes = k, [c for classes, _, _ in parts for c in classes]
        self.vecs = np.concatenate([_matrix(vecs, len(classes)) for classes, vecs, _ in parts])
        self.floor = np.concatenate([lasts for _, _, lasts in parts]) - 1e-12
        self.best: dict[int, list] = {}

    def compare(self, b: np.ndarray, ids) -> None:
        """Goes through a block; queries that its centre and radius rule out are skipped."""
        unit = b / np.linalg.norm(b, axis=1, keepdims=True)
        centre = unit.mean(axis=0, keepdims=True)
        possible = np.arange(len(self.vecs))
        if np.linalg.norm(centre):
            radius = np.arccos(np.clip(cosines(unit, centre).min(), -1, 1))
            angle = np.arccos(np.clip(cosines(self.vecs, centre)[:, 0], -1, 1))
            possible = np.flatnonzero(np.cos(np.maximum(angle - radius, 0)) >= self.floor - 1e-9)
        for start in range(0, len(possible), STRIPE):
            at = possible[start : start + STRIPE]
            scores = cosines(self.vecs[at], b)
            reached = scores.max(axis=1) >= self.floor[at]
            self._take(_best(at[reached].tolist(), scores[reached], ids, self.k, self.floor[at[reached]]))

    def _take(self, found) -> None:
        for i, some in groupby(found, key=lambda f: f[0]):
            own = dict(self.best.get(i, ()))
            for _, v, s in some:
                own[v] = max(s, own.get(v, s))
            best = self.best[i] = sorted(own.items(), key=lambda f: (-f[1], f[0]))[: self.k]
            if len(best) == self.k:
                self.floor[i] = max(self.floor[i], best[-1][1])

    def found(self) -> pa.RecordBatch:
        return _found([(self.classes[i], v, s) for i, best in self.best.items() for v, s in best])


def _checked(asked: DataFrame, blocks: DataFrame, k: int, width: int) -> DataFrame:
    """(class, vec_id, score) of rows that may be among a query's ``k`` best, from all blocks.

    ``asked`` (near, classes, queries, lasts) has blocks of queries with the last score each has so far.  Queries and blocks are
    cut into shares, and every two shares meet in one cell, which gets each of its blocks and queries once: a block is sent as
    often as there are shares of queries, and nothing is broadcast.
    """
    def shares(vectors, cell):
        most, size = cell
        return -(-(vectors or 0) // max(1, min(most, size // width)))

    tasks, (n, rows) = blocks.sparkSession.sparkContext.defaultParallelism, blocks.agg(F.count("*"), F.sum("n")).first()
    across = max(1, shares(asked.agg(F.sum(F.size("classes"))).first()[0], CELL_QUERIES))
    down = max(1, min(n, 2 * tasks), shares(rows, CELL_ROWS))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    no_ids = F.lit(None).cast("array<array<long>>")
    sent = asked.select(every(down).alias("p"), F.pmod(F.xxhash64("near"), F.lit(across)).cast("int").alias("c"), F.lit(-1).cast("long").alias("at"),
                        "classes", F.col("queries").alias("vecs"), "lasts", no_ids.alias("ids"))
    sent = sent.union(blocks.select(F.pmod("at", F.lit(down)).cast("int").alias("p"), every(across).alias("c"), "at", F.lit(None).cast("array<long>").alias("classes"),
                                    "vecs", F.lit(None).cast("array<double>").alias("lasts"), "ids"))

    def verify(batches):
        place, parts, cell = None, [], None
        for batch in batches:
            for p, c, at, classes, vecs, lasts, ids in zip(*(x.to_pylist() for x in batch.columns)):
                if (p, c) != place:
                    if cell:
                        yield cell.found()
                    place, parts, cell = (p, c), [], None
                if at < 0:  # queries come first
                    parts.append((classes, vecs, lasts))
                elif parts:
                    cell = cell or _Cell(parts, k)
                    cell.compare(_matrix(vecs, len(ids)), ids)
        if cell:
            yield cell.found()

    dealt = sent.repartition(down * across, "p", "c").sortWithinPartitions("p", "c", "at")
    return dealt.mapInArrow(verify, _FOUND_DDL)


def _top(found: DataFrame, k: int) -> DataFrame:
    unique = found.groupBy("class", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("score"), "vec_id"))
    return unique.withColumn("place", place).where(F.col("place") <= k)


def nearest(rows: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", orderings: int = 4, dims: int = 8,
            block: int = 512, check: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest other rows of every row whose id is divisible by ``every``.

    *Orderings*: each of several random projections of the unit vectors, shifted on its grid, is
    put in Hilbert order, range-partitioned by key and cut into blocks of ``block`` vectors.
    *Windows*: a query is compared with its own and the neighbouring blocks of each ordering; the
    windows' results merge and are reranked by exact cosine in double precision.  *Check*
    (optional): the blocks of the first ordering are gone through once more for every query, a share of the blocks and one of
    the queries at a time (`_checked`).  A block whose centre and radius leave no room for a score as high as the
    query's last is skipped.  That makes the answer exact.  On vectors without structure
    hardly a block can be skipped, then it costs queries times rows; without it the answer is approximate.

    Ties go to the smaller id.  Equal vectors are indexed once with their ``k + 1`` smallest ids, which
    is all that any answer can need, so a vector that very many rows share is no hot key.
    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids, nor vectors
    whose length differs from that of the smallest id.  Rows repeated with one id count once (with different vectors, each
    may be found, with the better score).  Other columns are ignored; an empty table gives no rows.
    """
    spark = rows.sparkSession
    own = written(_vectors(rows, id_col, vector), "vectors")
    first = own.orderBy("vec_id", "vec").select(F.length("vec").alias("n")).first()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    own = own.where(F.length("vec") == first.n).distinct()
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    classes = own.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = own.where(F.col("vec_id") % every == 0)
    classes = written(classes.join(asked.select("vec").distinct().withColumn("asked", F.lit(True)).hint("merge"), "vec", "left").select(
        "vec", "ids", F.coalesce("asked", F.lit(False)).alias("asked")), "classes")

    def place_on_curves(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            matrix = _matrix(b"".join(batch.column(0).to_pylist()), n)
            unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
            for o in range(orderings):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, o, np.int32)), pa.array(curve_keys(unit, o, dims)), *batch.columns], names=["o", "key", "vec", "ids", "asked"])

    def cut_blocks(batches):
        pid, held, seq = TaskContext.get().partitionId(), [], {}

        def flush():
            o = held[0][0]
            seq[o] = seq.get(o, -1) + 1
            return pa.RecordBatch.from_pylist([{
                "o": o, "pid": pid, "seq": seq[o], "n": len(held), "vecs": b"".join(r[1] for r in held), "ids": [r[2] for r in held],
                "asked": [r[3] for r in held]}], schema=_BLOCK)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("o", "vec", "ids", "asked"))):
                if held and (len(held) == block or held[0][0] != row[0]):
                    yield flush()
                    held = []
                held.append(row)
        if held:
            yield flush()

    placed = classes.mapInArrow(place_on_curves, "o int, key long, vec binary, ids array<long>, asked boolean")
    blocks = written(
        placed.repartitionByRange("o", "key", F.xxhash64("vec")).sortWithinPartitions("o", "key", "vec").mapInArrow(cut_blocks, _BLOCK_DDL), "blocks")
    # a row per partition and ordering: blocks before it
    counts = blocks.groupBy("o", "pid").agg(F.count("*").alias("blocks"))
    before = F.coalesce(F.sum("blocks").over(Window.partitionBy("o").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.join(counts.select("o", "pid", before.alias("before")), ["o", "pid"]).withColumn("at", F.col("before") + F.col("seq"))
    blocks = blocks.select("o", "at", "n", "vecs", "ids", "asked")

    def ask(batches):
        """The queries of a block, as one row."""
        for batch in batches:
            out = []
            for o, at, n, vecs, ids, own in zip(*(c.to_pylist() for c in batch.columns)):
                chosen = [i for i, a in enumerate(own) if a]
                if chosen:
                    out.append({"o": o, "near": at, "classes": [ids[i][0] for i in chosen], "queries": _matrix(vecs, n)[chosen].tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=_ASKED)

    queries = written(blocks.mapInArrow(ask, "o int, near long, classes array<long>, queries binary"), "queries")

    def search(batches):
        for batch in batches:
            for n, vecs, ids, own, asked_vecs in zip(*(c.to_pylist() for c in batch.columns)):
                yield _found(_best(own, cosines(_matrix(asked_vecs, len(own)), _matrix(vecs, n)), ids, k + 1))

    around = F.explode(F.array(F.col("near") - 1, F.col("near"), F.col("near") + 1))
    # written tables are joined by merging: compressed, or with rows yet to be repeated, they look small enough to broadcast and are not
    windows = queries.hint("merge").select("o", around.alias("at"), "classes", "queries").join(blocks, ["o", "at"])
    found = windows.select("n", "vecs", "ids", "classes", "queries").mapInArrow(search, _FOUND_DDL)
    best = written(_top(found, k + 1).drop("place"), "nearest")
    if check:
        last = best.groupBy("class").agg(F.when(F.count("*") > k, F.min("score")).otherwise(-2.0).alias("last"))
        # query blocks with each query's last score so far
        named = queries.where("o = 0").select("near", F.posexplode("classes").alias("i", "class"))
        lasts = named.join(last.hint("merge"), "class").groupBy("near").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "last"))), lambda s: s.last).alias("lasts"))
        groups = written(queries.where("o = 0").hint("merge").join(lasts, "near").select("near", "classes", "queries", "lasts"), "asked")
        # the stated query set against all rows, in blocks
        more = _checked(groups, blocks.where("o = 0"), k + 1, first.n)
        best = written(_top(best.union(more), k + 1).drop("place"), "checked")
    # every query of a class has the class's answers but itself
    members = asked.join(classes.hint("merge").select("vec", F.col("ids")[0].alias("class")), "vec").select(F.col("vec_id").alias("query_id"), "class").distinct()
    answers = members.join(best.hint("merge"), "class").where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_ASKED = pa.schema([("o", pa.int32()), ("near", pa.int64()), ("classes", pa.list_(pa.int64())), ("queries", pa.binary())])
