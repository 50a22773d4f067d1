"""Licence notices found through a positional index of rare words."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domweave.llm.common import utf8

# Phrases that name a licence by themselves, notices to align with, and what each must contain.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
           "documentation files the software to deal in the software without restriction",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
                "with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the "
           "following conditions are met",
    "gpl": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                  "public license as published by the free software foundation",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
}
KEYS = {
    "mit": ("permission is hereby granted", "free of charge"),
    "apache-2": ("apache license version 2",),
    "bsd": ("redistribution and use in source and binary forms",),
    "gpl": ("gnu general public license",),
    "gpl-notice": ("gnu general public license", "free software"),
    "mpl": ("mozilla public license",),
    "cc-by-nc": ("creative commons attribution noncommercial",),
}
LABELS = {"gpl-notice": "gpl"}

# Digits, A-Z and all bytes from 0x80 make words; the rest separates them.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def notice_index(notices: dict[str, str]) -> dict[bytes, list[tuple[str, int]]]:
    """word -> (notice, place) for every word of every notice."""
    index = defaultdict(list)
    for name, notice in notices.items():
        for place, word in enumerate(notice.encode().split()):
            index[word].append((name, place))
    return dict(index)


def word_idf(docs: DataFrame, words: list[bytes], text: str = "text") -> dict[bytes, float]:
    """Inverse document frequency of the notices' words over all documents (at most ``len(words)`` rows return)."""
    wanted = frozenset(words)

    def count(batches):
        total, df = 0, Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                total += 1
                df.update(wanted.intersection(normal_words(value)))
        yield pa.RecordBatch.from_pydict({"word": [b"", *df], "df": [total, *df.values()]})

    counted = docs.select(utf8(text)).mapInArrow(count, "word binary, df long").groupBy("word").agg(F.sum("df").alias("df"))
    df = {bytes(r.word): r.df for r in counted.collect()}
    total = df.pop(b"", 0)
    return {w: math.log((total + 1) / (df.get(w, 0) + 0.5)) for w in wanted}


def scan_text(text: bytes, index, idf, phrases, notices, keys, rare: int, least: float):
    """(words, phrase places, aligned notices) of one text.

    Phrase places: sorted (place, phrase).  Aligned notices: name -> (share of its words
    in place, first, last).
    """
    words = normal_words(text)
    joined = b" " + b" ".join(words) + b" "
    found = []
    for phrase in phrases:
        at = joined.find(needle := b" " + phrase.encode() + b" ")
        done = place = 0
        while at >= 0:
            place, done = place + joined.count(b" ", done, at), at
            found.append((place, phrase))
            at = joined.find(needle, at + 1)
    aligned = {}
    known = index.keys() & set(words)
    chosen = {}
    for name, (own, distinct) in notices.items():
        here = known & distinct
        # with ``least`` of its words in place, a notice lacks (1 - least) of them at most
        if len(here) >= max(1, len(distinct) - (1 - least) * len(own)):
            chosen[name] = set(sorted(here, key=lambda w: (-idf[w], w))[:rare])
    if chosen:
        votes, looked_up = Counter(), set().union(*chosen.values())
        for place, word in enumerate(words):
            if word in looked_up:
                for name, own_place in index[word]:
                    if name in chosen and word in chosen[name]:
                        votes[name, place - own_place] += 1
        best = {}
        for (name, start), n in votes.items():
            own = notices[name][0]
            if 2 * n < len(chosen[name]):
                continue
            lo, hi = max(start, 0), min(start + len(own), len(words))
            share = sum(words[p] == own[p - start] for p in range(lo, hi)) / len(own)
            if share > best.get(name, (0,))[0]:
                best[name] = (share, lo, hi)
        for name, (share, lo, hi) in best.items():
            region = b" " + b" ".join(words[lo:hi]) + b" "
            if share >= least and all(b" " + key.encode() + b" " in region for key in keys[name]):
                aligned[name] = (share, lo, hi)
    return words, sorted(found), aligned


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, notices array<struct<label: string, share: double, first: long, last: long>>")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text", phrases=None, notices=None, keys=None, rare: int = 6,
                  least: float = 0.6) -> DataFrame:
    """Licence labels of whole texts.

    First pass: document frequency of the notices' words over all documents.  Second
    pass, map-only: each file's ``rare`` words of highest IDF per notice are looked up in the
    positional index; postings that agree on one relative position propose a notice there;
    it counts if ``least`` of its words stand in place and its mandatory key phrases occur
    inside.  ``n_base`` counts the places of the plain ``phrases``.

    score: 1 with a phrase, else the best aligned share, else 0.  Null or empty text: no words,
    null places, empty labels, score 0.  Repeated rows give repeated results; other
    columns of ``docs`` are ignored; an empty table gives no rows.  The broadcast index is
    as large as the notices, which are parameters.
    """
    phrases, notices, keys = phrases or PHRASES, notices or NOTICES, keys or KEYS
    index = notice_index(notices)
    idf = word_idf(docs, list(index), text)
    split = {name: (notice.encode().split(), frozenset(notice.encode().split())) for name, notice in notices.items()}

    def scan(batches):
        for batch in batches:
            rows = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, found, aligned = scan_text(value, index, idf, phrases, split, keys, rare, least)
                base = {phrases[p] for _, p in found}
                labels = base | {LABELS.get(n, n) for n in aligned}
                score = 1.0 if base else max((a[0] for a in aligned.values()), default=0.0)
                rows.append({
                    "doc_id": doc, "n_words": len(words), "n_base": len(found), "first_word": found[0][0] if found else None,
                    "last_word": found[-1][0] if found else None, "base_labels": ",".join(sorted(base)),
                    "labels": ",".join(sorted(labels)), "score": score,
                    "notices": [{"label": LABELS.get(n, n), "share": s, "first": a, "last": b} for n, (s, a, b) in sorted(aligned.items())],
                })
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return docs.select(F.col(id_col).alias("doc_id"), utf8(text).alias("text")).mapInArrow(scan, SCHEMA)


_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("notices", pa.list_(pa.struct([("label", pa.string()), ("share", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))),
])
