"""Product codes of vectors: codebooks learnt by walking a trie of the distinct parts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domweave.llm.vectors import components, finite, of_common_length
from domweave.session import written

#: Components are held within this bound, so that every squared distance of a vector fits a long.
BOUND = 1 << 27
#: Rows that one task sorts into a trie at a time.
TRIE_ROWS = 50_000


def nearest_entries(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every row of ``parts``, distinct rows in lexicographic order.

    Sorted rows are a trie in depth-first order: a run of rows with equal leading
    components is a node.  Its distances to all entries over these components are summed
    once and handed to its children.  Where only one row is left below a child, the rest
    of its path is added in one step, for all such leaves of a node together.
    Ties go to the lower entry.
    """
    n, dims = parts.shape
    entry, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    largest = max(np.abs(parts).max(initial=0), np.abs(book).max(initial=0))
    # doubles hold these integers exactly and multiply much faster
    kind = np.float64 if dims * (2 * int(largest)) ** 2 < 1 << 52 else np.int64
    parts, book = parts.astype(kind), book.astype(kind)
    tails = np.zeros((dims + 1, len(book)), kind)  # squared length of each entry from a depth on
    tails[:dims] = np.cumsum((book**2).T[::-1], axis=0)[::-1]

    def leaves(at: np.ndarray, depth: int, so_far: np.ndarray) -> None:
        rest = parts[at, depth:]
        total = so_far + tails[depth] + (rest**2).sum(axis=1)[:, None] - 2 * (rest @ book[:, depth:].T)
        best = total.argmin(axis=1)
        entry[at], distance[at] = best, total[np.arange(len(at)), best]

    nodes = [(0, n, 0, np.zeros(len(book), kind))] if n else []
    while nodes:
        start, end, depth, so_far = nodes.pop()
        if depth == dims:
            leaves(np.arange(start, end), depth, so_far)
            continue
        values = parts[start:end, depth]
        starts = start + np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        ends = np.append(starts[1:], end)
        alone = ends - starts == 1
        if alone.any():
            leaves(starts[alone], depth, so_far)
        for a, b in zip(starts[~alone][::-1], ends[~alone][::-1]):
            nodes.append((a, b, depth + 1, so_far + (parts[a, depth] - book[:, depth]) ** 2))
    return entry, distance


def _bounds(dims: int, parts: int) -> list[tuple[int, int]]:
    return [(dims * p // parts, dims * (p + 1) // parts) for p in range(parts)]


def _start(own: DataFrame, entries: int) -> np.ndarray:
    """The integer vectors of the smallest ids, ascending; of an id's several vectors the least."""
    ids = [r.vec_id for r in own.where(F.col("vec_id").isNotNull()).select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    chosen = own.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").collect() if ids else []
    return np.array([r.x for r in chosen], np.int64).reshape(len(chosen), -1 if chosen else 0)


def _tallies(trie: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(p, entry, d, total): what the parts of each entry add up to; dimension -1 counts them."""
    schema = pa.schema([("p", pa.int32()), ("entry", pa.int32()), ("d", pa.int32()), ("total", pa.int64())])

    def tally(batches):
        sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]

        def walk(held):
            position = np.concatenate([h[0] for h in held])
            weight = np.concatenate([h[2] for h in held])
            ends = np.searchsorted(position, np.arange(len(books) + 1))  # rows come in order of p
            flat, at = np.concatenate([h[1] for h in held]), 0
            for p, book in enumerate(books):
                some, k = slice(ends[p], ends[p + 1]), book.shape[1]
                rows = flat[at : at + (ends[p + 1] - ends[p]) * k].reshape(-1, k).astype(np.int64)
                at += rows.size
                if len(rows):
                    entry, _ = nearest_entries(rows, book)
                    np.add.at(sums[p], entry, np.column_stack([weight[some], rows * weight[some][:, None]]))

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(), batch.column(2).to_numpy()))
                n += batch.num_rows
            if n >= TRIE_ROWS:
                walk(held)
                held, n = [], 0
        if held:
            walk(held)
        for p, total in enumerate(sums):
            e, d = np.nonzero((total[:, :1] > 0) & np.ones(total.shape, bool))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(e), p, np.int32)), pa.array(e.astype(np.int32)), pa.array(d.astype(np.int32) - 1), pa.array(total[e, d])], schema=schema)

    found = trie.mapInArrow(tally, "p int, entry int, d int, total long")
    return found.groupBy("p", "entry", "d").agg(F.sum("total").alias("total"))


def learn_codebooks(own: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> list[np.ndarray]:
    """One integer codebook for each part of the vectors (vec_id, x array<int> of one length).

    The distinct parts, with how often each occurs, are range-partitioned and sorted, so
    a task holds one stretch of the trie; a part that very many rows share is one row.
    Only sums per entry come to the driver, which holds nothing but the codebooks.
    """
    start = _start(own, entries)
    bounds = _bounds(start.shape[1], parts)
    books = [start[:, a:b] for a, b in bounds]
    if not len(start):
        return books
    cut = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.slice("x", a + 1, b - a).alias("part")) for p, (a, b) in enumerate(bounds)]))
    counted = own.select(cut.alias("e")).groupBy("e.p", "e.part").agg(F.count("*").alias("weight"))
    trie = written(counted.repartitionByRange("p", "part").sortWithinPartitions("p", "part"), "parts")
    for _ in range(rounds):
        books = [b.copy() for b in books]
        sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for r in _tallies(trie, books).collect():
            sums[r.p][r.entry, r.d + 1] = r.total
        for book, total in zip(books, sums):
            used = total[:, 0] > 0
            book[used] = total[used, 1:] // total[used, :1]
    return books


def compress(
    rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4,
    scale: int = 1024,
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row with a usable vector.

    Components become floor(scale * x), held within +-2**27.  Each of ``parts`` consecutive parts of a vector
    is replaced by its nearest codebook entry, see `learn_codebooks`; ``code`` has two hex digits a part,
    ``error`` is the vector's squared distance, ``label_error`` the sum over rows of its label.
    The last step is map-only: a task builds the trie of its own rows' distinct parts.

    Rows whose vector is null, empty or holds null or non-finite components are left out, as are
    vectors whose length is not that of the smallest id.  A length that ``parts`` does not divide makes parts that differ by one.
    Null ids are coded, but start no entry; without any id there are no rows.  Repeated rows are all returned
    and all count; of one id's several vectors the least starts the entry.  Null labels are one label.
    Other columns are ignored; an empty table gives no rows.
    """
    x = F.transform(F.col("v"), lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(BOUND))), F.lit(-float(BOUND)))).cast("int"))
    own = components(rows, id_col, vector, label).where(finite("v")).select("vec_id", x.alias("x"), "label")
    own = written(of_common_length(own, "x"), "integers")
    books = learn_codebooks(own.select("vec_id", "x"), parts, entries, rounds)
    bounds = _bounds(sum(b.shape[1] for b in books), parts)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    if not len(books[0]):
        own = own.limit(0)

    def code(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            whole = batch.column(1).flatten().to_numpy().reshape(n, -1).astype(np.int64)
            error, digits = np.zeros(n, np.int64), []
            for (a, b), book in zip(bounds, books):
                distinct, back = np.unique(whole[:, a:b], axis=0, return_inverse=True)
                entry, distance = nearest_entries(distinct, book)
                back = back.reshape(-1)
                error += distance[back]
                digits.append(entry[back])
            codes = ["".join(f"{e:02x}" for e in row) for row in zip(*(d.tolist() for d in digits))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(codes), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kind = own.schema["label"].dataType.simpleString()
    coded = written(own.mapInArrow(code, f"vec_id long, label {kind}, code string, error long"), "codes")
    errors = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label_errors")
    return coded.join(errors, coded.label.eqNullSafe(errors.of)).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
