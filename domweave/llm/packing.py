"""Best-fit packing of tokenised documents with swap-based local search."""

from __future__ import annotations

import gc
import zlib
from heapq import heapify, heappop, heappush
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domweave.llm.common import releasing, utf8, worker_keeps
from domweave.session import written


class Encoder:
    """Ids of a text as little-endian 32-bit bytes, built from the ids of its blank-separated words.

    No rule of the vocabulary spans ASCII blanks, so a text's ids are those of its words
    in a row.  Words not seen lately are encoded together as one text and told apart by
    their offsets.  At most ``2 * limit`` words are remembered.
    """

    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.young, self.old = limit, {}, {}
        normalizer = self.tokenizer.normalizer
        self.lowers = normalizer is not None and normalizer.normalize_str(ascii_uppercase) == ascii_lowercase

    def words(self, text: bytes) -> list[bytes]:
        """The words of a text, A-Z lower-cased where the vocabulary does that itself.

        Not in texts with combining marks (U+0300 to U+036F begin with 0xCC or 0xCD), since some letters only
        compose with a mark when they are small.
        """
        return (text.lower() if self.lowers and b"\xcc" not in text and b"\xcd" not in text else text).split()

    def learn(self, words: set[bytes]) -> None:
        # differences of sets with dicts, in this order, walk the words and not all that is remembered
        new = words.difference(self.young)
        if len(self.young) + len(new) > self.limit:
            self.old, self.young, new = self.young, {}, words
        unknown = new.difference(self.old)
        kept = new.difference(unknown)
        self.young.update(zip(kept, map(self.old.__getitem__, kept)))
        unknown = list(unknown)
        for first in range(0, len(unknown), 2000):
            some = unknown[first : first + 2000]
            text = b" ".join(some).decode("utf-8", "replace")
            encoded = self.tokenizer.encode(text, add_special_tokens=False)
            starts = np.cumsum([0, *(len(w) + 1 for w in text.split(" "))])
            offsets = np.fromiter((a for a, _ in encoded.offsets), np.int64, len(encoded))
            at = (4 * np.searchsorted(offsets, starts)).tolist()
            ids = np.array(encoded.ids, "<u4").tobytes()
            self.young.update(zip(some, (ids[a:b] for a, b in zip(at, at[1:]))))

    def ids(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.young.__getitem__, words))


def _encoder(path: str) -> Encoder:
    """One encoder per worker process: what a task has learnt serves the next one, until another operator needs the memory."""
    return worker_keeps(f"encoder {path}", lambda: Encoder(path))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, key long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("key", pa.int64())])


def token_pieces(docs: DataFrame, vocabulary: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id", text: str = "text",
                 with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``size`` ids of every document, each document closed by ``end_id``.

    Only documents of more than ``size`` ids are cut, from the front, so only the last piece is
    shorter.  ``ids`` (little-endian 32 bit) is filled if ``with_ids``.  ``key`` numbers the pieces.
    """
    end = int(end_id).to_bytes(4, "little")

    @releasing
    def cut(batches):
        collecting = gc.isenabled()
        gc.disable()  # lists of words without cycles: collection passes would only cost time
        try:
            yield from pieces_of(batches)
        finally:
            if collecting:
                gc.enable()

    def pieces_of(batches):
        encoder, n = _encoder(vocabulary), 0
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                texts = [encoder.words(t) for t in part.column(1).to_pylist()]
                encoder.learn(set().union(*texts))
                rows = []
                for doc, words in zip(part.column(0).to_pylist(), texts):
                    ids = encoder.ids(words) + end
                    for piece, at in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[at : at + 4 * size]
                        rows.append((doc, piece, at // 4, len(own) // 4, zlib.crc32(own), own if with_ids else None, base + n))
                        n += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _PIECES)], schema=_PIECES)

    return docs.select(F.col(id_col).alias("doc_id"), utf8(text).alias("text")).mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins (lists of positions) by best fit, longest first; bins by free space, found through a bit mask."""
    order = np.argsort(-lengths, kind="stable")
    bins, by_free, mask = [], [[] for _ in range(size + 1)], 0
    for i in order.tolist():
        need = int(lengths[i])
        fitting = mask >> need
        if fitting:
            free = need + (fitting & -fitting).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                mask &= ~(1 << free)
        else:
            free, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        free -= need
        if free:
            by_free[free].append(b)
            mask |= 1 << free
    return bins


class Takers:
    """Underfull bins by what they can take: a slot (back, t) of a bin gives ``back`` (a member's length, or 0) for up to t = back + room.

    For every t the slot of least ``back`` is known, so a lookup does not walk the bins.
    Slots of changed bins are dropped when they come up.
    """

    def __init__(self, bins: list[list[int]], fill: list[int], lengths: np.ndarray, size: int):
        self.bins, self.fill, self.lengths, self.size = bins, fill, lengths, size
        self.none = size + 1
        self.slots = [[] for _ in range(size + 1)]
        self.least = np.full(size + 2, self.none)  # by t
        self.stamp = [0] * len(bins)

    def add(self, b: int) -> None:
        room = self.size - self.fill[b]
        if room:
            for back in {0, *(int(self.lengths[i]) for i in self.bins[b])}:
                heappush(self.slots[back + room], (back, b, self.stamp[b]))
                self.least[back + room] = min(self.least[back + room], back)
            self.fresh = False

    def drop(self, b: int) -> None:
        """Before a bin changes."""
        room = self.size - self.fill[b]
        self.stamp[b] += 1
        for back in {0, *(int(self.lengths[i]) for i in self.bins[b])} if room else ():
            slots = self.slots[back + room]
            while slots and slots[0][2] != self.stamp[slots[0][1]]:
                heappop(slots)
            self.least[back + room] = slots[0][0] if slots else self.none
        self.fresh = False

    def best(self, sums: np.ndarray) -> tuple[int, int, int] | None:
        """(position in sums, back, taker) of a gain: what leaves a taker least room, else what gives most."""
        if not self.fresh:
            at = np.where(self.least < self.none, np.arange(self.size + 2), self.none)
            self.following = np.minimum.accumulate(at[::-1])[::-1]
            self.lowest = np.minimum.accumulate(self.least[::-1])[::-1]
            self.fresh = True
        tight = self.following[sums]
        fits = self.least[tight] < sums
        if fits.any():
            k = int(np.argmin(np.where(fits, (tight - sums) * (self.size + 1) - (sums - self.least[tight]), self.size * (self.size + 2))))
            t = int(tight[k])
        else:
            gains = sums - self.lowest[sums]
            if not len(sums) or gains.max() <= 0:
                return None
            k = int(np.argmax(gains))
            t = int(sums[k]) + int(np.argmax(self.least[sums[k] :] == self.lowest[sums[k]]))
        return k, self.slots[t][0][0], self.slots[t][0][1]


def _sums(own: list[int], lengths: np.ndarray, size: int) -> tuple[np.ndarray, list[tuple]]:
    """Lengths, and sums of two lengths, of a bin's members, with the members; each sum once."""
    by_length: dict[int, list[int]] = {}
    for i in own:
        by_length.setdefault(int(lengths[i]), []).append(i)
    found = {}
    kinds = sorted(by_length)
    for k, n in enumerate(kinds):
        for m in kinds[k:]:
            if n + m > size:
                break
            if m > n:
                found[n + m] = (by_length[n][0], by_length[m][0])
            elif len(by_length[n]) > 1:
                found[n + m] = tuple(by_length[n][:2])
    found |= {n: (by_length[n][0],) for n in kinds}
    return np.fromiter(found, np.int64, len(found)), list(found.values())


def swap_search(bins: list[list[int]], lengths: np.ndarray, size: int) -> list[list[int]]:
    """Fewer bins by moves and exchanges that raise the sum of squared fills until bins are empty.

    Underfull bins give to fuller ones (of equals, to later ones) that have room, the least filled first: a document
    moves, is exchanged for a shorter one, or two are exchanged for one shorter than both
    together.  A giver looks up the tightest fit among all takers (``Takers``), until none
    gains.  Each step raises the sum of squares, so none is undone.  Ends at the lower bound on
    the number of bins, or when a pass changes nothing.
    """
    bins, fill = [list(b) for b in bins], [int(lengths[b].sum()) for b in bins]
    least, used = -(-sum(fill) // size), sum(f > 0 for f in fill)
    changed = True
    while changed and used > least:
        changed = False
        waiting = [(f, b) for b, f in enumerate(fill) if 0 < f < size]
        heapify(waiting)
        takers = Takers(bins, fill, lengths, size)
        for _, b in waiting:
            takers.add(b)
        while waiting and used > least:
            f, giver = heappop(waiting)
            if f != fill[giver] or f == size:  # has taken since; its present fill waits too
                continue
            takers.drop(giver)
            while bins[giver]:
                sums, members = _sums(bins[giver], lengths, size)
                found = takers.best(sums)
                if found is None:
                    break
                k, back, taker = found
                over = members[k]
                returned = [next(j for j in bins[taker] if lengths[j] == back)] if back else []
                takers.drop(taker)
                bins[giver] = [i for i in bins[giver] if i not in over] + returned
                bins[taker] = [j for j in bins[taker] if j not in returned] + list(over)
                gain = int(sums[k]) - back
                fill[giver] -= gain
                fill[taker] += gain
                takers.add(taker)
                heappush(waiting, (fill[taker], taker))
                changed = True
            used -= not bins[giver]
    return [b for b in bins if b]


def pack(pieces: DataFrame, size: int = 4096, group: int = 20_000) -> DataFrame:
    """The pieces with sequence_id and offset, in as few sequences of ``size`` ids as the search finds.

    Pieces are dealt evenly over groups of about ``group`` by their key, whatever their document,
    and each group is packed in one task.  The bins that a group leaves underfull go
    on to a next round with those of other groups, until one group is left; a group
    hands on at most half of its pieces, so the rounds end.  ``pieces`` must be a written table.
    """
    schema = "key long, sequence_id long, offset long, round int"
    slim = pieces.select("key", F.col("length").cast("long").alias("length"))
    left, n, done, rounds = slim, slim.count(), None, 0
    while n:
        groups = -(-n // group)
        one_group = groups == 1

        def fit(rows):
            rows = rows.sort_values(["length", "key"], ascending=[False, True]).reset_index(drop=True)
            lengths = rows["length"].to_numpy()
            bins = swap_search(best_fit(lengths, size), lengths, size)
            fills = np.array([lengths[b].sum() for b in bins])
            order, open_bins, handed = np.argsort(fills, kind="stable"), set(), 0
            for b in order.tolist():
                if one_group or fills[b] == size or handed + len(bins[b]) > len(rows) // 2:
                    break
                open_bins.add(b)
                handed += len(bins[b])
            number, start, handed_on = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int32)
            keys = rows["key"].to_numpy()
            for b, members in enumerate(bins):
                number[members] = keys[min(members)]  # a sequence is called after its first piece
                start[members] = np.cumsum([0, *lengths[members][:-1]])
                if b in open_bins:
                    handed_on[members] = -1
            return rows.assign(sequence_id=number, offset=start, round=handed_on)[["key", "sequence_id", "offset", "round"]]

        packed = written(
            left.withColumn("_g", F.pmod(F.xxhash64("key", F.lit(rounds)), F.lit(groups))).groupBy("_g").applyInPandas(fit, schema),
            "packed")
        closed = packed.where("round = 0").drop("round")
        done = closed if done is None else done.union(closed)
        open_keys = packed.where("round = -1").select("key")
        n = 0 if one_group else open_keys.count()
        if n:
            left = written(slim.join(open_keys, "key", "left_semi"), "open")
        rounds += 1
    if done is None:
        return pieces.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    return pieces.join(done, "key")


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id", text: str = "text",
                   with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset of every piece of every document.

    Null and empty texts are one piece of one id (the end).  Repeated rows, also with one id,
    are packed each.  Null ids stay null.  Very long texts are cut into many pieces.  Other columns
    are ignored; an empty table gives no rows.  ``vocabulary`` is a file that every worker can read.
    """
    pieces = written(token_pieces(docs, vocabulary, size, end_id, id_col, text, with_ids), "pieces")
    return pack(pieces, size).drop("key")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids in order, from pieces packed ``with_ids`` (a sequence is bounded by its size)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length"))
