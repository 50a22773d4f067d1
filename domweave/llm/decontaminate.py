"""Test items inside documents: MinHash containment search over size classes, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domweave.llm.common import measured_broadcast
from domweave.session import written

#: Above so many rows a side is shuffled instead of broadcast.
SKETCH_ROWS, PAIR_ROWS, ITEM_ROWS = 2_000_000, 1_000_000, 50_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]++"), lambda w: w != "")


def _runs(tokens: str, length: int, one: str) -> Column:
    """Every run of ``length`` tokens as ``one`` (SQL over w and i, i from 1); all tokens as one run if fewer."""
    places = ", ".join(f"{tokens}[i + {k}]" for k in range(length))
    return F.expr(
        f"CASE WHEN size({tokens}) >= {length} THEN transform(sequence(0, size({tokens}) - {length}), i -> {one.format(places)}) "
        f"WHEN size({tokens}) > 0 THEN array({one.format(f'array_join({tokens}, chr(31))')}) ELSE array() END")


def hashes(tokens: str, length: int) -> Column:
    return _runs(tokens, length, "xxhash64({})")


def shingles(tokens: str, length: int) -> Column:
    return _runs(tokens, length, "concat_ws(chr(31), {})")


def _of_lengths(runs, tokens: str, length: int, shorter: list[int] | tuple) -> Column:
    """Runs of ``length`` and, where there are ``shorter`` items, of their lengths."""
    kinds = [runs(tokens, n) for n in (length, *shorter)]
    return F.concat(*kinds) if shorter else kinds[0]


def _own_runs(runs, tokens: str, length: int, shorter: list[int] | tuple) -> Column:
    """Runs of an item: all words as one run of their own number if they are fewer than ``length``."""
    own = runs(tokens, length)
    for n in shorter:
        own = F.when(F.size(tokens) == n, runs(tokens, n)).otherwise(own)
    return own


def sketch(items: DataFrame, length: int, threshold: float, shorter: list[int] | tuple = ()) -> DataFrame:
    """item_id, h: of each item's shingle hashes the least ones, as many as its size class needs.

    Size classes are powers of two.  A document that contains ``threshold`` of an item's m shingles
    lacks at most (1 - threshold) m of them, so one of the floor((1 - threshold) M) + 1 least
    hashes is in the document, with M the upper end of the class.
    """
    end = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("hs"))))
    need = F.least(F.size("hs"), (F.floor(F.lit(1 - threshold) * end + 1e-9) + 1).cast("int"))
    return (
        items.withColumn("hs", F.array_sort(F.array_distinct(_own_runs(hashes, "w", length, shorter)))).where(F.size("hs") > 0)
        .select("item_id", F.explode(F.slice("hs", F.lit(1), need)).alias("h")).distinct()
    )


def find_leaks(docs: DataFrame, items: DataFrame, length: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text: str = "text",
               item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment of every item of which a document holds ``threshold``.

    Containment: the share of an item's distinct runs of ``length`` words (all words as one run
    if fewer, looked for among the document's runs of as many words) that occur in the document.  Items are cut into size classes with a MinHash
    sketch each (``sketch``); every document's hashes are looked up in the sketches; the
    pairs that share a hash are verified on the shingles themselves.  The sketch length
    leaves no pair out.

    Null or empty texts and items match nothing, null ids take no part.  Repeated rows
    (also of items) give one row per pair of ids; if texts differ under one id, the best counts.  Other columns are
    ignored; empty tables give no rows.  Sketches, pairs and items are broadcast if a count finds
    them small, else joined by shuffle.
    """
    tests = items.select(F.col(item_col).alias("item_id"), words(F.col(item_text)).alias("w")).where("item_id is not null")
    tests = written(tests.where(F.size("w") > 0), "items")
    shorter = sorted(r.n for r in tests.select(F.size("w").alias("n")).where(F.col("n") < length).distinct().collect())
    looked_up = measured_broadcast(written(sketch(tests, length, threshold, shorter), "sketches"), SKETCH_ROWS)
    own = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text)).alias("w")).where("doc_id is not null")
    hits = own.select("doc_id", F.explode(_of_lengths(hashes, "w", length, shorter)).alias("h")).join(looked_up, "h")
    pairs = written(hits.select("doc_id", "item_id").distinct(), "pairs")
    wanted = tests.select("item_id", F.array_distinct(_own_runs(shingles, "w", length, shorter)).alias("item"))
    few = measured_broadcast(pairs, PAIR_ROWS)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_text"))
    found = (
        texts.join(few, "doc_id").select("doc_id", "item_id", words(F.col("_text")).alias("w"))
        .select("doc_id", "item_id", _of_lengths(shingles, "w", length, shorter).alias("doc"))
        .join(measured_broadcast(wanted, ITEM_ROWS), "item_id")
    )
    found = found.select(
        "doc_id", "item_id", F.size(F.array_intersect("item", "doc")).cast("long").alias("shared"), F.size("item").cast("long").alias("item_shingles"))
    found = found.withColumn("containment", F.col("shared") / F.col("item_shingles"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "shared", "item_shingles")).alias("b"))
    return best.select("doc_id", "item_id", "b.shared", "b.item_shingles", "b.containment").where(
        F.col("shared") >= F.lit(threshold) * F.col("item_shingles") - 1e-9)


def drop_leaks(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents without those in ``leaks``; null ids stay."""
    bad = written(leaks.select(F.col("doc_id").alias(id_col)).distinct(), "leaking")
    return docs.join(measured_broadcast(bad, PAIR_ROWS), id_col, "left_anti")
