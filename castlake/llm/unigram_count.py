"""Token counts by a count-only Viterbi search over a unigram vocabulary.

A space becomes the sign U+2581, and one is put before a text that does not begin with it. The best segmentation has the greatest sum of piece
scores; an Aho-Corasick automaton gives the pieces that end at each character, longest first, and dynamic programming
carries only the best score and its piece count. Ties go as in the tokenizer: of equal sums the piece that begins first
wins (a later one must be strictly better). A character without a piece of its own costs 10 more than the worst piece
and counts its UTF-8 bytes (byte fallback).

No piece has the sign U+2581 after another character, and none holds a line break, so the search is exact on each run of
signs with the word behind it; those are remembered in a table of bounded size. The working memory of a run is a window
as long as the longest piece.

The registered query has no unigram vocabulary to read: it takes the pieces of a BPE file, whose scores are minus merge
ranks. The search is exact for these scores, but the counts are not those of the file's own (BPE) tokenizer; the README
has the measured difference.

Defined results: null and empty texts have no tokens and score 0; repeated rows and clashing further columns have no
influence; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ready

SPACE = "▁"
RUN = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
UNKNOWN = 10.0
REMEMBERED = 300_000


def vocabulary(path: str) -> dict[str, float]:
    """The pieces of a sentencepiece model file, without its control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {model.IdToPiece(i): model.GetScore(i) for i in range(model.GetPieceSize()) if not (model.IsControl(i) or model.IsUnknown(i) or model.IsByte(i) or model.IsUnused(i))}


class Counter:
    def __init__(self, pieces: dict[str, float]):
        import ahocorasick

        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            raise ValueError("a piece crosses the border of a run")
        self.automaton = ahocorasick.Automaton()
        for p, score in pieces.items():
            self.automaton.add_word(p, (len(p), score))
        self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.longest = max(map(len, pieces))
        self.unknown = min(min(pieces.values()), 0.0) - UNKNOWN
        self.young: dict[str, tuple[float, int]] = {}
        self.old: dict[str, tuple[float, int]] = {}

    def best(self, run: str) -> tuple[float, int]:
        """Score and piece count of a run's best segmentation."""
        size = self.longest + 1
        score, count = [0.0] * size, [0] * size
        done = 0
        for last, (n, s) in self.automaton.iter(run):
            end = last + 1
            while done < end - 1:  # characters at which no piece ends
                done = self._alone(run, done, score, count, size, None)
            if done < end:  # the first piece that ends here
                self._alone(run, done, score, count, size, (n, s))
                done = end
            else:
                a, b = (end - n) % size, end % size
                if score[a] + s > score[b]:
                    score[b], count[b] = score[a] + s, count[a] + 1
            if n == 1 or run[last] in self.single:
                continue
            # an unknown character is the last candidate for its end
            a, b = last % size, end % size
            if score[a] + self.unknown > score[b]:
                score[b], count[b] = score[a] + self.unknown, count[a] + len(run[last].encode())
        while done < len(run):
            done = self._alone(run, done, score, count, size, None)
        return score[len(run) % size], count[len(run) % size]

    def _alone(self, run, done, score, count, size, piece) -> int:
        b = (done + 1) % size
        if piece:
            n, s = piece
            a = (done + 1 - n) % size
            score[b], count[b] = score[a] + s, count[a] + 1
        else:
            a = done % size
            score[b], count[b] = score[a] + self.unknown, count[a] + len(run[done].encode("utf-8"))
        return done + 1

    def count(self, text: str) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        total, n = 0.0, 0
        young = self.young
        text = text.replace(" ", SPACE)
        for run in RUN.findall(text if text[0] == SPACE else SPACE + text):
            found = young.get(run)
            if found is None:
                found = self.old.get(run) or self.best(run)
                if len(run) <= 64:
                    if len(young) >= REMEMBERED:
                        self.old, self.young = young, {}
                        young = self.young
                    young[run] = found
            total += found[0]
            n += found[1]
        return total, n


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, score of every row of docs; path: the model file, on every worker."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                found = [c.count(t or "") for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([n for _, n in found], pa.int64()), pa.array([s for s, _ in found], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, score double")
