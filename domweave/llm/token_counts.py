"""Token counts of a unigram tokenizer, by forward scores shared in a trie of pre-tokens."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domweave.llm.common import utf8

BLANK = "▁"


class Unigram:
    """Pieces with log probabilities by Zipf's law of their rank: a public vocabulary has an order, not scores.

    Characters outside the vocabulary become one token per UTF-8 byte, each scored below the rarest piece.
    """

    def __init__(self, pieces: list[str]):
        harmonic = math.log(math.log(len(pieces) + 1) + 0.5772)
        self.score = {}
        for rank, piece in enumerate(pieces):
            self.score.setdefault(piece, -math.log(rank + 2.0) - harmonic)
        self.byte = -math.log(len(pieces) + 2.0) - harmonic - 1.0
        self.longest = max(map(len, pieces), default=1)
        #: last letter -> lengths of the pieces that end so, to try no others
        self.lengths: dict[str, list[int]] = {}
        for piece in self.score:
            self.lengths.setdefault(piece[-1], []).append(len(piece))
        self.lengths = {c: sorted(set(n)) for c, n in self.lengths.items()}

    @classmethod
    def from_file(cls, path: str) -> Unigram:
        """The pieces of a public sentence-piece file, without control, unknown and byte pieces."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        return cls([model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))])

    def extend(self, path: str, best: list[float], tokens: list[int]) -> None:
        """Forward score and token count of ``path``, given those of all its shorter prefixes."""
        end, last = len(path), path[-1]
        size = len(last.encode("utf-8", "replace"))
        top, count = best[end - 1] + size * self.byte, tokens[end - 1] + size
        score = self.score
        for n in self.lengths.get(last, ()):
            if n > end:
                break
            s = score.get(path[end - n :])
            if s is not None and (s := s + best[end - n]) > top:
                top, count = s, tokens[end - n] + 1
        best.append(top)
        tokens.append(count)


def trie_counts(words: list[str], model: Unigram) -> list[tuple[int, float]]:
    """(tokens, log probability) of distinct words, in sorted order.

    Sorted words are the trie in depth-first order: the stacks hold the forward scores along the
    path from the root, so the node of a shared prefix is computed once and left when the words
    that share it are through.  Each word's terminal node gives its count.
    """
    best, tokens, before, out = [0.0], [0], "", []
    for word in words:
        shared = 0
        for a, b in zip(before, word):
            if a != b:
                break
            shared += 1
        del best[shared + 1 :], tokens[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            model.extend(word[:end], best, tokens)
        before = word
        out.append((tokens[-1], best[-1]))
    return out


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", remember: int = 150_000,
                 batch_rows: int = 1000) -> DataFrame:
    """doc_id, n_words, n_tokens, n_distinct, log_prob of every whole text.

    Texts are cut at ASCII blanks; a pre-token is the mark for a blank and a word.  Distinct pre-tokens of
    a batch that are not remembered go through one trie; a text's count is the sum over its
    words of terminal counts times occurrences.  Map-only: no shuffle, so no hot key; memory
    is bounded by a batch and ``remember`` words.  ``vocabulary`` is a file all workers can read.

    Null and empty texts have no words and no tokens.  Repeated rows give repeated results; null ids stay;
    other columns are ignored; an empty table gives no rows.
    """
    def count(batches):
        model, known = Unigram.from_file(vocabulary), {}
        for batch in batches:
            for first in range(0, batch.num_rows, batch_rows):
                part = batch.slice(first, batch_rows)
                texts = [Counter(t.split()) for t in part.column(1).to_pylist()]
                if len(known) > remember:
                    known.clear()
                new = sorted({w for own in texts for w in own if w not in known}, key=lambda w: w.decode("utf-8", "replace"))
                known.update(zip(new, trie_counts([BLANK + w.decode("utf-8", "replace") for w in new], model)))
                rows = [(sum(own.values()), sum(known[w][0] * n for w, n in own.items()), len(own),
                         math.fsum(known[w][1] * n for w, n in own.items())) for own in texts]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.float64())],
                    names=["doc_id", "n_words", "n_tokens", "n_distinct", "log_prob"])

    return docs.select(F.col(id_col).alias("doc_id"), utf8(text).alias("text")).mapInArrow(
        count, "doc_id long, n_words long, n_tokens long, n_distinct long, log_prob double")
