"""Language-model scores from a log-frequency Bloom filter of n-gram counts."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domweave.llm.common import (
    PLACES, WordHashes, mixed, packed, packed_keys, segment_slices, segments_for, text_bytes, unpacked, unpacked_keys, utf8, words_of,
)
from domweave.session import written

#: Keys of the marks around a text; no word has a blank.
END, BEGIN = WordHashes()[b" "], WordHashes()[b"  "]
UNIGRAM, BIGRAM = 0, 1


def training(doc_id: Column | str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 1, F.lit(True))


def tokens_of(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Hashes of the words, and of the end."""
    return np.r_[hashes.of(words_of(text)), np.uint64(END)]


def bigram_keys(tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mixed(before * PLACES[2] + tokens * PLACES[3])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], (np.add.reduceat(counts, first) if len(keys) else counts)


_PART = pa.schema([("segment", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_TOTAL = pa.schema([*_PART, ("types", pa.int64()), ("tokens", pa.int64()), ("events", pa.int64())])
_PART_DDL = "segment int, n int, keys binary, counts binary"
_TOTAL_DDL = _PART_DDL + ", types long, tokens long, events long"


def _levels(counts: np.ndarray) -> np.ndarray:
    """Quantised count: 1 + floor(log2(count))."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def count_ngrams(texts: DataFrame, segments: int, hold: int = 2_000_000) -> DataFrame:
    """A written table of segments of keys with their counts over all ``texts`` (one binary column).

    Counts are summed per task first and leave it compressed by segment of the key, so a hot n-gram is one
    entry per task.  ``types``, ``tokens``: distinct and all of a segment; ``events``: entries its filter part needs.
    """
    def count(batches):
        hashes, held, n = WordHashes(), [], 0

        def flush():
            before = [np.r_[np.uint64(BEGIN), t[:-1]] for t in held]
            tokens = np.concatenate(held)
            for order, keys in ((UNIGRAM, tokens), (BIGRAM, bigram_keys(tokens, np.concatenate(before)))):
                keys, counts = np.unique(keys, return_counts=True)
                cuts = list(segment_slices(keys, segments))
                yield pa.RecordBatch.from_arrays([
                    pa.array([s for s, _, _ in cuts], pa.int32()), pa.array([order] * len(cuts), pa.int32()),
                    pa.array([packed_keys(keys[a:b]) for _, a, b in cuts], pa.binary()), pa.array([packed(counts[a:b]) for _, a, b in cuts], pa.binary())],
                    schema=_PART)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(tokens_of(text, hashes))
                n += len(held[-1])
                if n >= hold:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    def total(batches):
        parts: dict = {}
        for batch in batches:
            for segment, order, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                parts.setdefault((segment, order), []).append((keys, counts))
        for (segment, order), own in sorted(parts.items()):
            keys, counts = _summed(np.concatenate([unpacked_keys(k) for k, _ in own]), np.concatenate([unpacked(c) for _, c in own]).astype(np.int64))
            parts[segment, order] = None
            types, tokens = len(keys), int(counts.sum())
            events = int(_levels(counts).sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], f.type) for x, f in zip(
                    (segment, order, keys.tobytes(), counts.astype("<u8").tobytes(), types, tokens, events), _TOTAL)], schema=_TOTAL)

    return written(
        texts.mapInArrow(count, _PART_DDL).repartition(segments, "segment").mapInArrow(total, _TOTAL_DDL), "ngrams", compression="zstd")


@dataclass
class Filter:
    """Bits of consecutive segments from ``first``; an n-gram of level q is stored as events (key, 1) to (key, q)."""

    bits: np.ndarray
    segments: int
    size: int
    probes: int
    first: int = 0

    def has(self, keys: np.ndarray, level: int, order: int) -> np.ndarray:
        """Whether all bits of the events are set; keys that miss one are not probed further."""
        found = np.ones(len(keys), bool)
        alive = np.arange(len(keys))
        for at in _places(keys, level, order, self.segments, self.size, self.probes):
            place = at(keys[alive]) - np.uint64(self.first * self.size)
            hit = (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            found[alive[~hit]] = False
            alive = alive[hit]
        return found

    def levels(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Quantised levels, by probing level after level until one is missing."""
        level = np.zeros(len(keys), np.uint8)
        alive, q = np.arange(len(keys)), 1
        while len(alive) and q < 60:
            alive = alive[self.has(keys[alive], q, order)]
            level[alive] = q
            q += 1
        return level

    def counts(self, keys: np.ndarray, order: int) -> np.ndarray:
        return counts_of(self.levels(keys, order))


def counts_of(level: np.ndarray) -> np.ndarray:
    """Counts that the quantised levels stand for."""
    level = level.astype(np.int64)
    return np.where(level == 0, 0.0, np.where(level == 1, 1.0, 1.4142135 * 2.0 ** (level - 1)))


def _places(keys, level, order, segments, size, probes):
    """For each probe the function from keys to bit places; a segment has ``size`` bits of its own."""
    shift = np.uint64(64 - (segments.bit_length() - 1))

    def probe(i):
        salt = np.uint64(((level * 2 + order + 1) * int(PLACES[4]) + i * int(PLACES[5])) % 2**64)

        def at(k):
            within = ((mixed(k ^ salt) >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
            return (k >> shift) * np.uint64(size) + within

        return at

    return [probe(i) for i in range(probes)]


def filter_shape(totals: DataFrame, segments: int, event_bits: int = 12) -> tuple[int, int]:
    """Bits of a segment and probes of a filter of all counted n-grams with ``event_bits`` per event, whatever the size of the corpus."""
    events = totals.agg(F.sum("events")).first()[0] or 0
    size = max(64, -(-event_bits * events // segments // 8) * 8)
    return size, max(1, min(8, round(math.log(2) * size * segments / max(1, events))))


def filter_parts(totals: DataFrame, segments: int, size: int, probes: int) -> DataFrame:
    """segment, bits; a segment's two orders can be two rows."""
    def fill(batches):
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, order, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("segment", "n", "keys", "counts"))):
                own = bits.setdefault(segment, np.zeros(size, bool))
                keys, levels = np.frombuffer(keys, np.uint64), _levels(np.frombuffer(counts, "<u8"))
                for q in range(1, int(levels.max(initial=0)) + 1):
                    some = keys[levels >= q]
                    for at in _places(some, q, order, segments, size, probes):
                        own[at(some) - np.uint64(segment) * np.uint64(size)] = True
        for segment, own in bits.items():
            yield pa.RecordBatch.from_pydict({
                "segment": pa.array([segment], pa.int32()), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()])})

    return totals.select("segment", "n", "keys", "counts").mapInArrow(fill, "segment int, bits binary")


def build_filter(totals: DataFrame, segments: int, event_bits: int = 12) -> Filter:
    """The whole filter on the driver, for corpora whose filter is small."""
    size, probes = filter_shape(totals, segments, event_bits)
    bits = np.zeros(segments * size // 8, np.uint8)
    for segment, own in filter_parts(totals, segments, size, probes).toLocalIterator():
        bits[segment * size // 8 : (segment + 1) * size // 8] |= np.frombuffer(own, np.uint8)
    return Filter(bits, segments, size, probes)


def frequent(totals: DataFrame, n: int, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys and counts of the tokens seen at least n / most times, so at most ``most`` of them; and that limit."""
    limit = n // most + 1

    def pick(batches):
        for batch in batches:
            out = []
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, counts = np.frombuffer(keys, np.uint64), np.frombuffer(counts, "<u8")
                out.append((keys[counts >= limit].tobytes(), counts[counts >= limit].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([c for _, c in out], pa.binary())],
                                             names=["keys", "counts"])

    rows = totals.where(F.col("n") == UNIGRAM).select("keys", "counts").mapInArrow(pick, "keys binary, counts binary").collect()
    keys = np.concatenate([np.frombuffer(r.keys, np.uint64) for r in rows] or [np.zeros(0, np.uint64)])
    counts = np.concatenate([np.frombuffer(r.counts, "<u8") for r in rows] or [np.zeros(0, "<u8")]).astype(np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order], limit


def looked_up(keys: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, counts[at], 0)


_SCORED = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("logs", pa.float64()), ("score", pa.float64()), ("segment", pa.int32()), ("rows", pa.binary()), ("keys", pa.binary()),
                     ("part", pa.int64()), ("n", pa.int32())])
_SCORED_DDL = ("key long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, segment int, "
               "rows binary, keys binary, part long, n int")


@dataclass
class Part:
    """Some texts as places in their distinct words and pairs, so that levels can be filled in where and when they are known."""

    begin: int
    end: int
    lengths: np.ndarray
    at: np.ndarray
    at_before: np.ndarray
    at_pair: np.ndarray

    @staticmethod
    def of(tokens: list[np.ndarray]) -> tuple[Part, np.ndarray, np.ndarray]:
        """The part, its distinct words (and the marks) and its distinct pairs, both sorted."""
        lengths = np.array(list(map(len, tokens)))
        types, at = np.unique(np.concatenate([*tokens, np.array([BEGIN, END], np.uint64)]), return_inverse=True)
        return Part.placed(types, lengths, at[:-2])

    @staticmethod
    def placed(types: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[Part, np.ndarray, np.ndarray]:
        begin, end = np.searchsorted(types, np.array([BEGIN, END], np.uint64)).tolist()
        before = np.r_[begin, at[:-1]]
        before[np.cumsum(lengths)[:-1]] = begin
        pairs, at_pair = np.unique(bigram_keys(types[at], types[before]), return_inverse=True)
        return Part(begin, end, lengths, at, before, at_pair), types, pairs

    def packed(self, types: np.ndarray) -> list[bytes]:
        """Words and places only: a word's predecessor and the pairs follow from them."""
        return [packed_keys(types), packed(np.r_[len(self.lengths), self.lengths, self.at])]

    @staticmethod
    def unpacked(types: bytes, places: bytes) -> tuple[Part, np.ndarray, np.ndarray]:
        numbers = unpacked(places).astype(np.int64)
        texts = int(numbers[0])
        return Part.placed(unpacked_keys(types), numbers[1 : 1 + texts], numbers[1 + texts :])

    def score(self, types_levels: np.ndarray, pairs_levels: np.ndarray, n: int, types: int, share: float) -> np.ndarray:
        """Sum of log10 p of each text."""
        quantised, pairs = counts_of(types_levels), counts_of(pairs_levels)[self.at_pair]
        quantised[self.begin] = quantised[self.end]  # every text begins once; the begin mark itself is no token
        p = (quantised[self.at] + 0.5) / (n + 0.5 * (types + 1))
        context = np.maximum(np.maximum(quantised[self.at_before], pairs), 1.0)
        return self.per_text(np.log10(share * pairs / context + (1 - share) * p))

    def per_text(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(len(self.lengths)), self.lengths), weights=values, minlength=len(self.lengths))


def _scored(columns: dict) -> pa.RecordBatch:
    m = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(m, f.type) for f in _SCORED], schema=_SCORED)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", share: float = 0.25, most_frequent: int = 1_000_000,
                max_filter_bytes: int = 0, segment_bytes: int = 8_000_000, part_tokens: int = 1_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Unigrams and bigrams of all training rows (crc32 of the id mod 5 is not 1) are counted.
    ``score`` sums log10 p(w | h) = share * c(h, w) / c(h) + (1 - share) * p(w), with
    p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)) and every c quantised to powers of two and read from a
    log-frequency Bloom filter of 12 bits an event, pairs seen once included.  The filter stays cut by segment of the key, and
    the distinct words and pairs of every ``part_tokens`` tokens are sent to their segments and their levels back, at every
    size, so that disk and time grow with the input.  A filter of at most ``max_filter_bytes`` is broadcast instead: less is
    shuffled for a corpus known to be small.  Both give the same scores.
    ``base_score`` and ``n_known`` use exact counts: tokens seen N / ``most_frequent`` times or more are
    broadcast (so at most ``most_frequent`` of them), the others meet their counts in a shuffle.

    Null and empty texts are one token, the end.  Null ids are training rows.  Repeated
    rows are counted and returned each.  Other columns are ignored; an empty table gives no rows.  Tokens are
    told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("doc_id"), utf8(text).alias("text"))
    segments = segments_for(text_bytes(docs, text), segment_bytes)
    totals = count_ngrams(own.where(training("doc_id")).select("text"), segments)
    sums = totals.where(F.col("n") == UNIGRAM).agg(F.sum("types"), F.sum("tokens")).first()
    types, n = sums[0] or 0, sums[1] or 0
    floor = math.log10(n + 0.5 * (types + 1))
    size, probes = filter_shape(totals, segments)
    whole = size * segments <= 8 * max_filter_bytes
    model = spark.sparkContext.broadcast(build_filter(totals, segments) if whole else None)
    known_keys, known_counts, limit = frequent(totals, n, most_frequent)
    known = spark.sparkContext.broadcast((known_keys, known_counts))

    def parts(batches):
        """Ids, held-out flags and tokens of some texts at a time."""
        hashes, held, n_held = WordHashes(), ([], [], []), 0
        for batch in batches:
            for doc, out, text in zip(*(c.to_pylist() for c in batch.columns)):
                for column, x in zip(held, (doc, out, tokens_of(text, hashes))):
                    column.append(x)
                n_held += len(held[2][-1])
                if n_held >= part_tokens or whole and len(held[0]) == 500:
                    yield held
                    held, n_held = ([], [], []), 0
        if held[0]:
            yield held

    def score(batches):
        f = model.value
        keys_known, counts_known = known.value
        base = TaskContext.get().partitionId() << 40
        number = 0
        for ids, held_out, texts in parts(batches):
            part, own_types, own_pairs = Part.of(texts)
            tokens = own_types[part.at]
            exact = looked_up(own_types, keys_known, counts_known)[part.at]
            rare = exact == 0
            logs = np.where(rare, 0.0, np.log10(exact + 0.5))
            keys = base + number + np.arange(len(ids))
            number += len(ids)
            columns = {"key": keys, "doc_id": ids, "held_out": held_out, "n_tokens": part.lengths,
                       "n_known": part.per_text(~rare).astype(np.int64), "logs": part.per_text(logs)}
            if whole:
                columns["score"] = part.score(f.levels(own_types, UNIGRAM), f.levels(own_pairs, BIGRAM), n, types, share)
            yield _scored(columns)
            order = np.argsort(tokens[rare], kind="stable")
            rare_keys, rare_rows = tokens[rare][order], np.repeat(keys, part.lengths)[rare][order]
            cuts = list(segment_slices(rare_keys, segments))
            yield _scored({"segment": [s for s, _, _ in cuts], "rows": [packed(rare_rows[a:b]) for _, a, b in cuts],
                           "keys": [packed_keys(rare_keys[a:b]) for _, a, b in cuts]})
            if not whole:
                words, places = part.packed(own_types)
                yield _scored({"part": keys[:1], "rows": [places], "keys": [words]})

    scored = written(
        own.select("doc_id", (~training("doc_id")).alias("held_out"), "text").mapInArrow(score, _SCORED_DDL), "scored")

    def resolve(batches):
        """Exact counts of rare tokens: a segment's counts and the tokens that ask for them meet in one partition."""
        asked, counted = [], []
        for batch in batches:
            for rows, keys, counts in zip(*(c.to_pylist() for c in batch.columns[1:])):
                if counts is None:
                    asked.append((rows, keys))
                else:
                    counted.append((np.frombuffer(keys, np.uint64), np.frombuffer(counts, "<u8")))
        if not asked:
            return
        own_keys, own_counts = _summed(*(np.concatenate([c[i] for c in counted] or [np.zeros(0, t)]) for i, t in enumerate((np.uint64, "<u8"))))
        for rows, keys in asked:
            rows, keys = unpacked(rows).astype(np.int64), unpacked_keys(keys)
            c = looked_up(keys, own_keys, own_counts.astype(np.int64))
            row, at = np.unique(rows, return_inverse=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(row), pa.array(np.bincount(at, weights=c > 0).astype(np.int64)), pa.array(np.bincount(at, weights=np.log10(c + 0.5)))],
                names=["key", "rare_known", "rare_logs"])

    def ask(batches):
        """Distinct words and pairs of the parts, by segment; made from the places, so that they are not stored besides."""
        for batch in batches:
            for number, places, words in zip(*(c.to_pylist() for c in batch.columns)):
                _, *distinct = Part.unpacked(words, places)
                for which, asked in zip((UNIGRAM, BIGRAM), distinct):
                    cuts = list(segment_slices(asked, segments))
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([number] * len(cuts), pa.int64()), "n": pa.array([which] * len(cuts), pa.int32()),
                        "segment": pa.array([s for s, _, _ in cuts], pa.int32()), "keys": pa.array([packed_keys(asked[a:b]) for _, a, b in cuts], pa.binary())})

    def answer(batches):
        """Levels of what is asked of a segment, from the bits of the segment."""
        asked, bits = {}, {}
        for batch in batches:
            for part, which, segment, keys, own in zip(*(c.to_pylist() for c in batch.columns)):
                if own is None:
                    asked.setdefault((segment, which), []).append((part, keys))
                else:
                    own = np.frombuffer(own, np.uint8)
                    bits[segment] = bits[segment] | own if segment in bits else own
        for (segment, which), rows in asked.items():
            # parts ask for the same words and pairs again and again: each is probed once
            keys = [unpacked_keys(k) for _, k in rows]
            distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
            own = bits.get(segment)
            levels = np.zeros(len(distinct), np.uint8) if own is None else Filter(own, segments, size, probes, segment).levels(distinct, which)
            for (part, _), levels in zip(rows, np.split(levels[at], np.cumsum([len(k) for k in keys[:-1]]))):
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int64()), "n": pa.array([which], pa.int32()), "segment": pa.array([segment], pa.int32()),
                    "rows": pa.array([None], pa.binary()), "keys": pa.array([packed(levels)], pa.binary())})

    def finish(rows):
        """Scores of one part, once the levels of its words and pairs are back."""
        levels = {UNIGRAM: [], BIGRAM: []}
        for first, which, segment, places, keys in zip(*(c.to_pylist() for c in rows.columns)):
            if which is None:
                part, *_ = Part.unpacked(keys, places)
                texts = first + np.arange(len(part.lengths))
            else:
                levels[which].append((segment, keys))
        types_levels, pairs_levels = (np.concatenate([unpacked(x) for _, x in sorted(levels[which])]) for which in (UNIGRAM, BIGRAM))
        return pa.table({"key": texts, "score": part.score(types_levels, pairs_levels, n, types, share)})

    asked = scored.where("segment is not null").select("segment", "rows", "keys", F.lit(None).cast("binary").alias("counts"))
    counted = totals.where(F.col("n") == UNIGRAM).select("segment", F.lit(None).cast("binary").alias("rows"), "keys", "counts")
    rare = asked.union(counted).repartition(segments, "segment").mapInArrow(resolve, "key long, rare_known long, rare_logs double")
    # written on its own, so that its shuffles are gone before the levels are shuffled
    rare = written(rare.groupBy("key").agg(F.sum("rare_known").alias("rare_known"), F.sum("rare_logs").alias("rare_logs")), "rare")
    texts = scored.where("key is not null")
    if not whole:
        places = scored.where("part is not null").select("part", "n", "segment", "rows", "keys")
        probed = places.select("part", "rows", "keys").mapInArrow(ask, "part long, n int, segment int, keys binary")
        stored = filter_parts(totals, segments, size, probes).selectExpr(
            "cast(null as long) AS part", "cast(null as int) AS n", "segment", "cast(null as binary) AS keys", "bits")
        levels = probed.withColumn("bits", F.lit(None).cast("binary")).union(stored).repartition(segments, "segment")
        levels = written(levels.mapInArrow(answer, "part long, n int, segment int, rows binary, keys binary"), "levels")
        texts = texts.drop("score").join(
            places.union(levels).groupBy("part").applyInArrow(finish, "key long, score double"), "key")
    return texts.join(rare, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score")
