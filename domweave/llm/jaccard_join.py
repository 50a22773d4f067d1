"""Exact set-similarity classes of documents by word shingles."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domweave.functions.skew import join_per_key
from domweave.llm.common import (
    PLACES, WordHashes, measured_broadcast, mixed, releasing, segment_slices, segments_for, shingle_hashes, text_bytes, utf8, words_of, worker_keeps,
)
from domweave.llm.components import connected_components, joined_components
from domweave.session import written

SPARE = 3
#: Lists of so many sets are paired off; the sets of longer ones are compared family by family.
SHORT = 32
#: Members (or bytes) of the sets that are indexed together in a task.
CHUNK = 500_000


def size_bounds(percent: int, n: int) -> list[int]:
    """Upper ends of the size classes up to one that holds ``n``: 1, 2, 3 ... then by 1.35."""
    ends = [1]
    while ends[-1] < n:
        ends.append(max(ends[-1] + 1, int(ends[-1] * 1.35)))
    return ends


def blocks_of(end: int, percent: int) -> int:
    """Blocks of positions for pairs whose smaller set has at most ``end`` members.

    Similar sets x <= y differ in at most (x + y) * (100 - percent) / (100 + percent)
    members, and y <= 100 x / percent.  With ``SPARE`` more blocks than that, at least
    ``SPARE`` blocks are equal in both.
    """
    return (end + 100 * end // percent) * (100 - percent) // (100 + percent) + SPARE


def block_lists(members: np.ndarray, percent: int, ends: list[int]) -> tuple[np.ndarray, bytes]:
    """The index lists that a sorted set of evenly spread hashes is entered in, and a byte for each block.

    The order of all members is cut by position into equal blocks; a list holds the sets
    with one content of one block.  A set goes to the lists of its own size class and of
    the lower classes in which it can have a similar set.  The bytes, own class first, differ
    only where blocks differ.
    """
    n, out, marks = len(members), [], []
    own = int(np.searchsorted(ends, n))
    spread = mixed(members)
    anchor = own
    while anchor >= 0 and (anchor == own or -(-percent * n // 100) <= ends[anchor]):
        k = blocks_of(ends[anchor], percent)
        block = ((members >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        content, number = np.add.reduceat(spread, first), block[first]
        if k - len(first) >= SPARE:  # empty blocks can be all that two sets have in common
            empty = np.setdiff1d(np.arange(k, dtype=np.uint64), number)
            content, number = np.r_[content, np.zeros(len(empty), np.uint64)], np.r_[number, empty]
        lists = mixed(content ^ (number * PLACES[5] + np.uint64((anchor + 1) * int(PLACES[6]) % 2**64)))
        out.append(lists)
        mark = np.zeros(k, np.uint8)
        mark[number.astype(np.int64)] = (lists & np.uint64(255)).astype(np.uint8)
        mark[number[content == 0].astype(np.int64)] = 0
        marks.append(mark.tobytes())
        anchor -= 1
    return np.concatenate(out), b"".join(marks)


def may_be_similar(na: int, ma: bytes, nb: int, mb: bytes, percent: int, ends: list[int]) -> bool:
    """False only if the sets differ in more blocks than similar sets of these sizes can differ in members."""
    if na > nb:
        na, ma, nb, mb = nb, mb, na, ma
    if 100 * na < percent * nb:
        return False
    anchor, own = (int(np.searchsorted(ends, n)) for n in (na, nb))
    k = blocks_of(ends[anchor], percent)
    skip = sum(blocks_of(ends[i], percent) for i in range(anchor + 1, own + 1))
    differ = np.count_nonzero(np.frombuffer(ma, np.uint8, k) != np.frombuffer(mb, np.uint8, k, skip))
    return differ <= (na + nb) * (100 - percent) // (100 + percent)


def set_id(members: np.ndarray) -> np.uint64:
    """One id for equal sets."""
    return mixed(mixed(members ^ PLACES[7]).sum(keepdims=True) ^ np.uint64(len(members)))[0]


_ROUTED = pa.schema([("segment", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("set_id", pa.int64()),
                     ("marks", pa.binary()), ("lists", pa.binary()), ("sets", pa.binary())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_id", pa.int64()), ("marks", pa.binary()), ("list_id", pa.int64()), ("leader", pa.int64()),
                    ("member", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.bool_(): "boolean", pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.float64(): "double"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _batch(schema: pa.Schema, rows: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def _index(length: int, percent: int, segments: int, hold: int = 1_000_000):
    """Documents to their set ids, and to index entries packed by segment of the list id."""

    @releasing
    def route(batches):
        worker_keeps("sets")
        hashes, ends, seen = WordHashes(), size_bounds(percent, 1), set()
        lists, sets, held = [], [], 0

        def flush():
            keys, owners = np.concatenate(lists), np.concatenate(sets)
            order = np.argsort(keys)
            keys, owners = keys[order], owners[order]
            cuts = list(segment_slices(keys, segments))
            yield _batch(_ROUTED, len(cuts), segment=[s for s, _, _ in cuts], lists=[keys[a:b].tobytes() for _, a, b in cuts],
                         sets=[owners[a:b].tobytes() for _, a, b in cuts])

        for batch in batches:
            n, ids, marks = [], [], [None] * batch.num_rows
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                members = shingle_hashes(hashes.of(words_of(text)), length)
                n.append(len(members))
                own = set_id(members) if len(members) else None
                ids.append(None if own is None else int(own.astype(np.int64)))
                if own is None or doc is None or own in seen:
                    continue
                if len(seen) < 200_000:  # only saves entries of copies; the reader drops repeated ones
                    seen.add(own)
                if len(members) > ends[-1]:
                    ends = size_bounds(percent, 2 * len(members))
                own_lists, marks[len(n) - 1] = block_lists(members, percent, ends)
                lists.append(own_lists)
                sets.append(np.full(len(lists[-1]), own))
                held += len(lists[-1])
                if held >= hold:
                    yield from flush()
                    lists, sets, held = [], [], 0
            segment = [(held + i) % segments for i in range(len(ids))]
            yield _batch(_ROUTED, len(n), segment=segment, doc_id=batch.column(0), n=n, set_id=ids, marks=marks)
        if held:
            yield from flush()

    return route


@releasing
def _read_lists(batches):
    """Documents as they are; of each list with several sets the least as leader of each other."""
    worker_keeps("sets")
    lists, sets = [], []
    for batch in batches:
        docs = batch.filter(batch.column("n").is_valid())
        yield _batch(_FOUND, len(docs), doc_id=docs.column("doc_id"), n=docs.column("n"), set_id=docs.column("set_id"),
                     marks=docs.column("marks"))
        entries = batch.filter(batch.column("lists").is_valid())
        lists += [np.frombuffer(x, np.uint64) for x in entries.column("lists").to_pylist()]
        sets += [np.frombuffer(x, np.uint64) for x in entries.column("sets").to_pylist()]
    if not lists:
        return
    keys, owners = np.concatenate(lists), np.concatenate(sets).astype(np.int64)
    lists.clear()
    sets.clear()
    order = np.argsort(keys, kind="stable")
    keys, owners = keys[order], owners[order]
    # most lists hold one set: leave them before the exact sort
    same = keys[1:] == keys[:-1]
    shared = np.r_[False, same] | np.r_[same, False]
    keys, owners = keys[shared], owners[shared]
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    if not len(keys):
        return
    first = np.r_[True, keys[1:] != keys[:-1]]
    leader = owners[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))]
    other = ~first & (owners != leader) & np.r_[True, (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])]
    keys, leader, owners = keys[other].astype(np.int64), leader[other], owners[other]
    for a in range(0, len(keys), 200_000):
        yield _batch(_FOUND, len(keys[a : a + 200_000]), list_id=keys[a : a + 200_000], leader=leader[a : a + 200_000],
                     member=owners[a : a + 200_000])


def _members(docs: DataFrame, wanted: DataFrame, length: int, id_col: str, text: str) -> DataFrame:
    """set_id, members of one document of each wanted set (doc_id, set_id), read from its text again."""

    @releasing
    def build(batches):
        hashes, seen = WordHashes(), set()
        for batch in batches:
            ids, out = [], []
            for own, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                members = shingle_hashes(hashes.of(words_of(value)), length)
                if len(members) and own not in seen and int(set_id(members).astype(np.int64)) == own:
                    seen.add(own)
                    ids.append(own)
                    out.append(members.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["set_id", "members"])

    # a set's document may share its id with another text, hence the comparison in build()
    few = measured_broadcast(wanted, 2_000_000)
    own = docs.select(F.col(id_col).alias("doc_id"), utf8(text).alias("text")).join(few, "doc_id")
    return own.select("set_id", "text").mapInArrow(build, "set_id long, members array<long>")


def _possible(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those that their sizes and blocks do not rule out."""
    def keep(batches):
        ends = size_bounds(percent, 1)
        for batch in batches:
            kept = []
            for na, ma, nb, mb in zip(*(batch.column(c).to_pylist() for c in ("na", "ma", "nb", "mb"))):
                if max(na, nb) > ends[-1]:
                    ends = size_bounds(percent, 2 * max(na, nb))
                kept.append(may_be_similar(na, ma, nb, mb, percent, ends))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    for side in ("a", "b"):
        pairs = pairs.join(marks.select(F.col("set_id").alias(side), F.col("n").alias(f"n{side}"), F.col("marks").alias(f"m{side}")), side)
    return pairs.mapInArrow(keep, "a long, b long")


def _linked(pairs: DataFrame, members, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose sets are similar; ``members(pairs)`` gives the sets."""
    own = members(pairs)
    left = own.select(F.col("set_id").alias("a"), F.col("members").alias("ma"))
    right = own.select(F.col("set_id").alias("b"), F.col("members").alias("mb"))
    small, large = F.least(F.size("ma"), F.size("mb")), F.greatest(F.size("ma"), F.size("mb"))
    both = F.size(F.array_intersect("ma", "mb"))
    return (
        pairs.join(right, "b").join(left, "a")
        .where(100 * both >= percent * (small + large - both)).select("a", "b").distinct()
    )


def overlap_links(a_ids, a_sets, a_comp, b_ids, b_sets, b_comp, percent: int) -> list[tuple[int, int]]:
    """Edges that join the components of similar sets of two lists, as few as join them.

    The members of the second list are sorted into one index; a set of the first looks its members up and
    counts the owners, which gives its overlap with every set at once.
    """
    parent: dict = {}

    def root(c):
        while parent.get(c, c) != c:
            parent[c] = parent.get(parent[c], parent[c])
            c = parent[c]
        return c

    sizes = np.array([len(s) for s in b_sets])
    elements, owners = np.concatenate(b_sets), np.repeat(np.arange(len(b_sets)), sizes)
    order = np.argsort(elements, kind="stable")
    elements, owners = elements[order], owners[order]
    out = []
    for own, members, comp in zip(a_ids, a_sets, a_comp):
        lo, hi = np.searchsorted(elements, members, "left"), np.searchsorted(elements, members, "right")
        n = hi - lo
        lo, n = lo[n > 0], n[n > 0]
        if not len(n):
            continue
        at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        both = np.bincount(owners[at], minlength=len(sizes))
        for j in np.flatnonzero(100 * both >= percent * (len(members) + sizes - both)).tolist():
            x, y = root(comp), root(b_comp[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((own, b_ids[j]))
    return out


def _chunked(rows: DataFrame, keys: list[str], weight: Column, percent: int) -> DataFrame:
    """The rows once for each pair (i, j) of chunks of their group that is to be compared.

    A group is cut, by size of set, into chunks of about ``CHUNK`` bytes or members, so it may be larger than any
    task; chunks whose sizes are not comparable do not meet.
    """
    total = F.sum(weight).over(Window.partitionBy(*keys).orderBy("n", "set_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = written(rows.withColumn("chunk", F.floor((total - 1) / CHUNK)), "chunks")
    ranges = rows.groupBy(*keys, "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    left, right = ranges.toDF(*keys, "i", "lo_i", "hi_i"), ranges.toDF(*keys, "j", "lo_j", "hi_j")
    meet = left.join(right, keys).where((F.col("i") <= F.col("j")) & (100 * F.col("hi_i") >= percent * F.col("lo_j")))
    sides = meet.select(*keys, "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("chunk"))
    return rows.join(sides, [*keys, "chunk"])


def _promising(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """set_id of the sets that blocks do not rule out for every set of another component in their family."""
    def anchored(batches):
        ends = size_bounds(percent, 1)
        for batch in batches:
            out = []
            for component, own, n, marks, comp in zip(*(c.to_pylist() for c in batch.columns)):
                if n > ends[-1]:
                    ends = size_bounds(percent, 2 * n)
                at, anchor, top = 0, int(np.searchsorted(ends, n)), int(np.searchsorted(ends, n))
                while at < len(marks):
                    k = blocks_of(ends[anchor], percent)
                    out.append((component, anchor, own, n, comp, anchor == top, marks[at : at + k]))
                    at, anchor = at + k, anchor - 1
            columns = list(zip(*out)) or [()] * len(_ANCHORED)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ANCHORED)], schema=_ANCHORED)

    def compare(rows):
        if not len(rows):
            return rows[["set_id"]]
        i, j = rows["i"].iat[0], rows["j"].iat[0]
        one, two = rows[rows["chunk"] == i], rows[rows["chunk"] == j]
        blocks = np.frombuffer(b"".join(two["mark"]), np.uint8).reshape(len(two), -1)
        n, comp, own = two["n"].to_numpy(), two["c_set_id"].to_numpy(), two["own"].to_numpy()
        hit = np.zeros(len(two), bool)
        found = []
        for set_id, size, c, is_own, mark in zip(one["set_id"], one["n"], one["c_set_id"], one["own"], one["mark"]):
            differ = np.count_nonzero(blocks != np.frombuffer(mark, np.uint8), axis=1)
            fits = (differ <= (n + size) * (100 - percent) // (100 + percent)) & (comp != c) & (own | is_own)
            if fits.any():
                found.append(set_id)
                hit |= fits
        return pd.DataFrame({"set_id": sorted({*found, *two["set_id"].to_numpy()[hit].tolist()})}, dtype="int64")

    rows = _labelled(sets, nodes, "set_id").select("component", "set_id", "n", "marks", "c_set_id").mapInArrow(anchored, _ddl(_ANCHORED))
    return _chunked(rows, ["component", "anchor"], F.length("mark"), percent).groupBy("component", "anchor", "i", "j").applyInPandas(
        compare, "set_id long").distinct()


_ANCHORED = pa.schema([("component", pa.int64()), ("anchor", pa.int32()), ("set_id", pa.int64()), ("n", pa.int64()), ("c_set_id", pa.int64()),
                       ("own", pa.bool_()), ("mark", pa.binary())])


def _family_links(long: DataFrame, marks: DataFrame, members, nodes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that join components of sets which meet in long lists.

    A family is what such lists connect.  The blocks' bytes leave those sets of it that may have a similar
    set in another component; these are compared whole, a task taking two chunks of a family.
    """
    family = connected_components(long.select(F.col("first").alias("a"), F.col("set_id").alias("b")))
    sets = written(family.withColumnRenamed("node", "set_id").join(marks, "set_id"), "family")
    left = written(_promising(sets, nodes, percent), "promising")
    sets = _labelled(sets.drop("marks").join(left, "set_id", "left_semi"), nodes, "set_id")
    rows = _chunked(sets, ["component"], F.col("n"), percent)
    own = members(left.select(F.col("set_id").alias("a"), F.col("set_id").alias("b")))

    def compare(rows):
        if not len(rows):
            return rows.assign(a=0, b=0)[["a", "b"]]
        i, j = rows["i"].iat[0], rows["j"].iat[0]
        parts = []
        for chunk in (i, j):
            own = rows[rows["chunk"] == chunk]
            parts += [own["set_id"].tolist(), [np.asarray(m) for m in own["members"]], own["c_set_id"].tolist()]
        found = overlap_links(*parts, percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return written(
        rows.join(own, "set_id").select("component", "i", "j", "chunk", "set_id", "c_set_id", "members").groupBy("component", "i", "j")
        .applyInPandas(compare, "a long, b long"), "family_links")


def _labelled(rows: DataFrame, nodes: DataFrame, on: str) -> DataFrame:
    """The rows with the component of the set in column ``on``."""
    named = nodes.select(F.col("node").alias(on), F.col("component").alias(f"c_{on}"))
    return rows.join(named, on, "left").withColumn(f"c_{on}", F.coalesce(f"c_{on}", on))


def similar_groups(docs: DataFrame, length: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text",
                   segment_bytes: int = 4_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; exact, whatever the sizes of the groups.

    A document's set holds its distinct runs of ``length`` words (all words as one run if fewer).  Two
    documents link when 100 * intersection >= percent * union; component_id is the least
    doc_id reachable by links.

    *Index*: equal sets count once.  Sets enter lists by block of positions (``block_lists``);
    by the pigeonhole principle similar sets meet in a list, and all positions outside equal
    blocks are skipped.  *Set relations*: in a list every set is compared with the list's leader
    only; sets found similar, directly or through others, share an answer, so their other pairs
    are not looked at.  Lists that still hold sets of several components are gone through again: short
    ones pair by pair, long ones as families (lists with common sets) in which an index gives a set's
    overlaps with all others at once (``_family_links``); only pairs across components can add an edge.
    So no pair that could join two components is missed, and no long list is expanded to pairs.

    No words or no text: empty set, n_shingles 0, alone.  Null doc_id: n_shingles as usual,
    component_id null, links with nothing.  Repeated rows are copies.  Other columns are ignored.
    Empty table: no rows.  Shingles are told apart by 64-bit hashes.
    """
    segments = segments_for(text_bytes(docs, text), segment_bytes)
    own = docs.select(F.col(id_col).alias("doc_id"), utf8(text).alias("text"))
    found = written(
        own.mapInArrow(_index(length, percent, segments), _ddl(_ROUTED)).repartition(segments, "segment")
        .mapInArrow(_read_lists, _ddl(_FOUND)), "lists")
    rows = found.where("n is not null").select("doc_id", "n", "set_id")
    lists = found.where("list_id is not null").select("list_id", "leader", "member")
    marks = found.where("marks is not null").groupBy("set_id").agg(F.max("n").alias("n"), F.max("marks").alias("marks"))
    least = rows.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))

    def members(pairs):
        involved = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
        wanted = written(least.join(involved, "set_id", "left_semi").select("doc_id", "set_id"), "wanted")
        return written(_members(docs, wanted, length, id_col, text), "members")

    def links(pairs):
        possible = written(_possible(pairs, marks, percent), "possible")
        return None if possible.isEmpty() else written(_linked(possible, members, percent), "links")

    pairs = written(lists.groupBy(F.col("leader").alias("a"), F.col("member").alias("b")).agg(F.count("*").alias("shared")), "pairs")
    # first the leader that shares most lists; then those that could still join two components
    closest = written(pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b"), "closest")
    edges = links(closest)
    nodes = closest.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    if edges is not None:
        nodes = written(connected_components(edges), "nodes")
    others = pairs.join(closest, ["a", "b"], "left_anti").select("a", "b")
    more = links(_labelled(_labelled(others, nodes, "a"), nodes, "b").where("c_a != c_b").select("a", "b"))
    if more is not None:
        nodes = written(joined_components(nodes, more), "nodes")
    # leaders were compared with all of their list: only other members can hide a link between components
    hidden = _labelled(_labelled(lists, nodes, "leader"), nodes, "member").where("c_leader != c_member").select("list_id").distinct()
    rest = _labelled(lists.join(hidden, "list_id", "left_semi").select("list_id", F.col("member").alias("set_id")), nodes, "set_id")
    sizes = rest.groupBy("list_id").agg(F.count("*").alias("m"), F.min("set_id").alias("first"), F.min("c_set_id").alias("c0"), F.max("c_set_id").alias("c1"))
    rest = written(rest.join(sizes.where("c0 != c1").drop("c0", "c1"), "list_id"), "rest")
    short = rest.where(F.col("m") <= SHORT).select("list_id", F.col("set_id").alias("a"), F.col("c_set_id").alias("ca"))
    other = short.select("list_id", F.col("a").alias("b"), F.col("ca").alias("cb"))
    more = links(short.join(other, "list_id").where("a < b and ca != cb").select("a", "b").distinct())
    if more is not None:
        nodes = written(joined_components(nodes, more), "nodes")
    long = rest.where(F.col("m") > SHORT)
    if not long.isEmpty():
        nodes = written(joined_components(nodes, _family_links(long, marks, members, nodes, percent)), "nodes")
    # set -> least document of its component
    named = least.join(nodes.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn(
        "component", F.coalesce("component", "set_id"))
    first = named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    answers = join_per_key(named.select("set_id", "component"), first, ["component"], ["set_id"], "inner").select("set_id", "component_id")
    return join_per_key(rows, answers, ["set_id"], ["doc_id"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
