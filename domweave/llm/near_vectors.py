"""Near-duplicate vectors: collisions in windows of many sorted projections are counted, then pairs verified."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domweave.functions.skew import join_per_key
from domweave.llm.components import connected_components
from domweave.llm.vectors import components, finite, of_common_length
from domweave.session import written

#: Half width of a window, in standard deviations of a projection.
WINDOW = 0.75
#: Collisions that a pair at the threshold is given on average.
COLLISIONS = 10.0
#: Angles nearer than this to a bound are computed, not inferred.
MARGIN = 1e-7
#: Projections that are held at a time, vectors of a verification block.
STRIPE, BLOCK = 2048, 256


def collision_chance(least: float, cosine: float, window: float = WINDOW, steps: int = 2000) -> float:
    """Chance that two unit vectors of this cosine collide in one Gaussian projection, on either side.

    Their values are then normal with this correlation; they collide if both are at least
    ``least`` and differ by at most ``window``.
    """
    x = least + (np.arange(steps) + 0.5) * (8 / steps)
    spread = math.sqrt(max(1 - cosine * cosine, 1e-12))
    below = np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))
    inside = below((x + window - cosine * x) / spread) - below((np.maximum(x - window, least) - cosine * x) / spread)
    return float(2 * (np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * inside).sum() * 8 / steps)


def recall_of(projections: int, chance: float, count: int) -> float:
    """Chance that a pair collides in at least ``count`` of independent projections."""
    less, term = 0.0, (1 - chance) ** projections
    for k in range(count):
        less += term
        term *= (projections - k) / (k + 1) * chance / (1 - chance)
    return 1 - less


def calibrate(n: int, cosine: float, recall: float) -> tuple[int, float, int]:
    """(projections, least value, count) for ``n`` vectors.

    The number of projections grows with the square root of ``n``, so that the sorted lists of
    outer values grow as slowly.  The least value is set such that a pair at the
    threshold has `COLLISIONS` of them on average; the count is the largest with which it is still
    found with a chance of ``recall``.  All three depend on the number of rows and the threshold alone.
    """
    projections = 1 << max(9, math.ceil(math.log2(32 * math.sqrt(max(n, 1)))))
    low, high = 0.0, 8.0
    for _ in range(40):
        least = (low + high) / 2
        low, high = (least, high) if projections * collision_chance(least, cosine) > COLLISIONS else (low, least)
    count = 1
    while recall_of(projections, collision_chance(low, cosine), count + 1) >= recall:
        count += 1
    return projections, low, count


def merged(rows: DataFrame) -> DataFrame:
    """Rows that are joined by merging, as their number grows with the table's.

    The planner broadcasts what its estimate calls small, which leaves out rows yet to be repeated (`join_per_key`) and takes a
    written table by its compressed size; it does not go back on that for what it then measures, if merging needs another shuffle.
    """
    return rows.hint("merge")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _unit(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _stripes(dims: int, projections: int, seed: int):
    for stripe in range(0, projections, STRIPE):
        yield stripe, np.random.default_rng([seed, stripe]).standard_normal((dims, min(STRIPE, projections - stripe)))


def _classes(own: DataFrame) -> DataFrame:
    """c, vec, weight, least: distinct vectors, how many rows have each, and their smallest id."""
    counted = own.groupBy("vec").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    return written(counted.select(F.monotonically_increasing_id().alias("c"), "vec", "weight", "least"), "classes")


def _balls(classes: DataFrame, cosine: float, seed: int = 5) -> DataFrame:
    """classes with g: the leader whose ball they lie in (else themselves) and near, the cosine with it.

    The key of a vector names its outermost projection in each of two sets.  One class of each key, whichever
    hashes least, is the leader; those within half the threshold's angle of it share its
    ball, so any two in a ball are certainly linked.  A crowd of near copies thus shrinks to a few balls.
    """
    half = math.cos((math.acos(cosine) - MARGIN) / 2)

    def keys(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column(1)))
            key = np.zeros(len(unit), np.int64)
            for part in range(2):
                seen = unit @ np.random.default_rng([seed, part]).standard_normal((unit.shape[1], 128))
                outer = np.abs(seen).argmax(axis=1)
                key = key * 256 + 2 * outer + (seen[np.arange(len(seen)), outer] < 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], names=["c", "vec", "weight", "least", "key"])

    keyed = written(classes.mapInArrow(keys, "c long, vec binary, weight long, least long, key long"), "keyed")
    chosen = keyed.groupBy("key").agg(F.min_by(F.struct("c", "vec"), F.xxhash64("c")).alias("leader"))
    leaders = chosen.select("key", F.col("leader.c").alias("g"), F.col("leader.vec").alias("leader"))

    def attach(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near = _cosines(_matrix(batch.column(1)), _matrix(batch.column(5)))
            own, leader = batch.column(0).to_numpy(), batch.column(4).to_numpy()
            inside = (near >= half) & (own != leader)
            g = np.where(inside, leader, own)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(g), pa.array(np.where(inside, near, 1.0))], names=["c", "vec", "weight", "least", "g", "near"])

    joined = join_per_key(keyed, merged(leaders), ["key"], ["c"], "inner").select("c", "vec", "weight", "least", "g", "leader")
    return written(joined.mapInArrow(attach, "c long, vec binary, weight long, least long, g long, near double"), "balls")


def _candidates(balls: DataFrame, dims: int, projections: int, least: float, count: int, seed: int = 7) -> DataFrame:
    """Pairs of balls (a < b) whose members' windows meet in at least ``count`` projections."""
    window = WINDOW

    def outer(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, g = _unit(_matrix(batch.column(1))), batch.column(0).to_numpy()
            for stripe, directions in _stripes(dims, projections, seed):
                seen = unit @ directions
                row, column = np.nonzero(np.abs(seen) >= least)
                value = seen[row, column]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[row]), pa.array(2 * (column + stripe) + (value < 0)), pa.array(np.abs(value))], names=["g", "list", "v"])

    spans = balls.select("g", "vec").mapInArrow(outer, "g long, list long, v double").groupBy("g", "list").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    # a window that reaches into further cells is also laid there
    cells = F.posexplode(F.sequence(F.floor(F.col("lo") / window), F.floor((F.col("hi") + window) / window))).alias("over", "cell")
    laid = written(spans, "spans").select("list", "lo", "hi", "g", cells)

    def meet(batches):
        held: list = []
        key = None

        def pairs(lo, hi, g, native):
            for start in range(0, len(g), 512):
                j = np.arange(start, min(start + 512, len(g)))
                hit = (hi[None, : j[-1]] + window >= lo[j][:, None]) & (np.arange(j[-1])[None, :] < j[:, None]) & native[j][:, None]
                y, x = np.nonzero(hit)
                if len(y):
                    yield np.minimum(g[x], g[j[y]]), np.maximum(g[x], g[j[y]])

        def rows(found):
            a, b = (np.concatenate(side) for side in zip(*found))
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            ends = [*first[1:].tolist(), len(a)]
            return pa.RecordBatch.from_arrays(
                [pa.array(a[first]), pa.array([b[s:e].tobytes() for s, e in zip(first.tolist(), ends)], pa.binary())], names=["a", "bs"])

        found, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            lists, cell = columns[0], columns[5]
            cuts = np.flatnonzero(np.concatenate([[True], (lists[1:] != lists[:-1]) | (cell[1:] != cell[:-1])]))
            for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(lists)]):
                now = (lists[s], cell[s])
                if key is not None and now != key:
                    for pair in pairs(*(np.concatenate(side) for side in zip(*held))):
                        found.append(pair)
                        size += len(pair[0])
                    held = []
                key = now
                held.append((columns[1][s:e], columns[2][s:e], columns[3][s:e], columns[4][s:e] == 0))
                if size > 500_000:
                    yield rows(found)
                    found, size = [], 0
        if held:
            found += pairs(*(np.concatenate(side) for side in zip(*held)))
        if found:
            yield rows(found)

    def tally(batches):
        own, held = None, []

        def passing():
            b, times = np.unique(np.frombuffer(b"".join(held), np.int64), return_counts=True)
            return b[times >= count]

        for batch in batches:
            out = []
            for a, bs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if a != own:
                    if held:
                        out.append((own, passing()))
                    own, held = a, []
                held.append(bs)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([a for a, _ in out], [len(b) for _, b in out]).astype(np.int64)), pa.array(np.concatenate([b for _, b in out]))], names=["a", "b"])
        if held:
            b = passing()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), own, np.int64)), pa.array(b)], names=["a", "b"])

    order = ("list", "cell", "lo", "g")
    met = laid.select("list", "lo", "hi", "g", "over", "cell").repartitionByRange("list", "cell").sortWithinPartitions(*order).mapInArrow(meet, "a long, bs binary")
    return written(met.repartition("a").sortWithinPartitions("a").mapInArrow(tally, "a long, b long"), "candidates")


def _judged(candidates: DataFrame, balls: DataFrame, cosine: float) -> DataFrame:
    """a, b, every: pairs of balls of which all members are linked (true), or some may be (false)."""
    own = balls.groupBy("g").agg(F.max(F.when(F.col("c") == F.col("g"), F.col("vec"))).alias("vec"), F.min("near").alias("near"))
    own = written(own, "leaders")
    angle = math.acos(cosine)

    def judge(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, va, na, vb, nb = batch.columns
            seen = _cosines(_matrix(va), _matrix(vb))
            na, nb = na.to_numpy(), nb.to_numpy()
            single = (na == 1.0) & (nb == 1.0)
            apart = np.arccos(np.clip(seen, -1, 1))
            reach = np.arccos(np.clip(na, -1, 1)) + np.arccos(np.clip(nb, -1, 1))
            every = np.where(single, seen >= cosine, apart + reach <= angle - MARGIN)
            some = np.where(single, seen >= cosine, apart - reach <= angle + MARGIN)
            keep = pa.array(some)
            yield pa.RecordBatch.from_arrays([a, b, pa.array(every)], names=["a", "b", "every"]).filter(keep)

    sides = candidates.join(merged(own.toDF("a", "va", "na")), "a").join(merged(own.toDF("b", "vb", "nb")), "b")
    return written(sides.select("a", "b", "va", "na", "vb", "nb").mapInArrow(judge, "a long, b long, every boolean"), "judged")


def _verified(mixed: DataFrame, balls: DataFrame, cosine: float) -> DataFrame:
    """c, more, a, b: links of each class that blocks of two balls' members have, counted in rows.

    Members are cut into blocks by a hash, so a ball of any size is spread over tasks; a block
    pair returns one number for each member, never its pairs.
    """
    needed = mixed.select(F.explode(F.array("a", "b")).alias("g")).distinct()
    some = written(join_per_key(balls, merged(needed), ["g"], ["c"], "inner").select("g", "c", "vec", "weight"), "members")
    cuts = some.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).alias("cuts"))
    block = F.pmod(F.xxhash64("c"), F.col("cuts"))
    blocks = written(
        join_per_key(some, merged(cuts), ["g"], ["c"], "inner").groupBy("g", block.alias("block"))
        .agg(F.collect_list(F.struct("c", "weight", "vec")).alias("members")).select("g", "members"), "blocks")

    def compare(batches):
        for batch in batches:
            out = []
            for a, b, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                (ma, wa), (mb, wb) = (
                    (np.frombuffer(b"".join(m["vec"] for m in side), np.float64).reshape(len(side), -1), np.array([m["weight"] for m in side]))
                    for side in (left, right))
                lengths = [np.sqrt(np.einsum("ij,ij->i", m, m)) for m in (ma, mb)]
                linked = ma @ mb.T / (lengths[0][:, None] * lengths[1][None, :]) >= cosine
                for side, links, weights in ((left, linked, wb), (right, linked.T, wa)):
                    total = links @ weights
                    out += [(m["c"], int(t), a, b) for m, t in zip(side, total) if t]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["c", "more", "a", "b"])

    pairs = mixed.join(merged(blocks.toDF("a", "left")), "a").join(merged(blocks.toDF("b", "right")), "b")
    return written(pairs.select("a", "b", "left", "right").mapInArrow(compare, "c long, more long, a long, b long"), "verified")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, recall: float = 0.995) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; rows are linked if found and their cosine is at least ``cosine``.

    *Sort*: unit vectors are projected on many Gaussian directions; of each direction, outer
    values are kept and sorted.  *Count*: a window around every vector's value collects those that collide with it there; a
    pair passes with a count that one at the threshold reaches with a chance of ``recall`` (`calibrate`); nearer pairs
    reach it more surely.  *Verify*: pairs that pass are compared in double precision, so no link is false.
    Equal vectors are one class, and crowds of near copies are balls (`_balls`) that stand for their members: windows then span a ball's
    values, so a ball collides wherever a member does, and links inside a ball need no pairs.  Whole balls
    that are certainly linked are added up as such, the others' members are compared in blocks.

    A vector that is null, empty, zero, holds null or non-finite components, or whose length is not that
    of the smallest id's usable vector links with nothing: it has no links and its own id as component.
    Every row comes out once.  Rows repeated with one id count as other vectors and share
    that id; null ids take part, have kept false, and null as component only if no linked row has an id.
    Other columns are ignored; an empty table gives no rows.
    """
    everything = components(rows, id_col, vector)
    good = F.col("usable") & F.exists(F.col("v"), lambda x: x != 0)
    everything = written(everything.withColumn("usable", finite("v")).withColumn("usable", F.coalesce(good, F.lit(False))), "all")

    def pack(batches):
        for batch in batches:
            lists = batch.column(1)
            values, ends = lists.flatten().to_numpy(zero_copy_only=False) + 0.0, np.cumsum(lists.value_lengths().to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([values[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)], pa.binary())], names=["vec_id", "vec"])

    usable = of_common_length(everything.where("usable"), "v").select("vec_id", "v")
    own = written(usable.mapInArrow(pack, "vec_id long, vec binary"), "vectors")
    first = own.select(F.length("vec").alias("n")).first()
    dims = first.n // 8 if first else 1
    length = dims if first else -1
    rest = everything.where(~F.col("usable") | (F.size("v") != length)).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    classes = _classes(own)
    projections, least, count = calibrate(classes.count(), cosine, recall)
    balls = _balls(classes, cosine)
    judged = _judged(_candidates(balls, dims, projections, least, count), balls, cosine)
    whole = judged.where("every").select("a", "b")
    verified = _verified(judged.where("not every"), balls, cosine)
    edges = whole.union(verified.select("a", "b").distinct())
    groups = written(balls.groupBy("g").agg(F.sum("weight").alias("rows"), F.min("least").alias("least")), "groups")
    both = whole.union(whole.select("b", "a")).toDF("g", "to")
    outside = both.join(merged(groups.select(F.col("g").alias("to"), "rows")), "to").groupBy("g").agg(F.sum("rows").alias("outside"))
    named = groups.join(merged(connected_components(edges, broadcast=False).withColumnRenamed("node", "g")), "g", "left").withColumn("component", F.coalesce("component", "g"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    per_ball = written(
        join_per_key(named, merged(smallest), ["component"], ["g"]).join(outside, "g", "left")
        .select("g", (F.col("rows") - 1 + F.coalesce("outside", F.lit(0))).alias("links"), "component_id"), "linked")
    more = verified.groupBy("c").agg(F.sum("more").alias("more"))
    members = join_per_key(balls.select("g", "c", "vec", "weight", "least"), merged(per_ball), ["g"], ["c"], "inner").join(merged(more), "c", "left")
    answers = written(members.select("vec", "weight", "least", (F.col("links") + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id"), "answers")
    alone = answers.where("weight = 1").select(F.col("least").alias("vec_id"), "n_links", "component_id")
    shared = answers.where("weight > 1").select(F.sha2("vec", 256).alias("digest"), "n_links", "component_id")
    copies = join_per_key(own.select("vec_id", F.sha2("vec", 256).alias("digest")), merged(shared), ["digest"], ["vec_id"], "inner").select("vec_id", "n_links", "component_id")
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return rest.union(alone).union(copies).withColumn("kept", kept)
