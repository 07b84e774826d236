"""Token counts of a unigram tokenizer without its tokens: Viterbi that carries score and count.

An Aho-Corasick automaton enumerates all vocabulary pieces that end at each place of a word; the best
score and the piece count of its path are carried from place to place. The tie rules are those of the
tokenizers library's Unigram model: scores in double precision; for a place, of equal scores the path
whose last piece starts first; a character that is no piece by itself may be unknown, at the least score
minus 10; unknown characters count as their UTF-8 bytes where the vocabulary has byte pieces, and else
each run of them as one piece. Words begin at spaces, which are written as U+2581.

No unigram vocabulary is at hand: the model file read here, piece_bpe_32k.model, is one of a BPE tokenizer, and
its merge ranks (with -1e9 for runs of spaces) are taken as log scores. The counts are those of a unigram
reading of that table, not the number of tokens that the BPE model itself makes.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from roundsmith.llm import storage

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words kept by a worker; beyond it the cache starts anew. Longer words are not kept.
CACHE_WORDS, CACHE_CHARS = 500_000, 64
_made: dict[str, "UnigramCounter"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in order of id (protocol buffer fields 1.1, 1.2)."""

    def fields(raw: bytes) -> Iterator[tuple[int, object]]:
        at = 0

        def varint() -> int:
            nonlocal at
            n = shift = 0
            while True:
                b = raw[at]
                at, n, shift = at + 1, n | (b & 127) << shift, shift + 7
                if b < 128:
                    return n

        while at < len(raw):
            tag = varint()
            kind = tag & 7
            if kind == 0:
                yield tag >> 3, varint()
            else:
                n = varint() if kind == 2 else 4 if kind == 5 else 8
                yield tag >> 3, raw[at : at + n]
                at += n

    with open(path, "rb") as f:
        raw = f.read()
    out = []
    for number, piece in fields(raw):
        if number == 1:
            own = dict(fields(piece))
            out.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0))
    return out


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        names = {p for p, _ in vocabulary}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.cache: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """Pieces and score of one word, its leading mark included."""
        n = len(word)
        score, count, was_unknown = array("d", bytes(8 * n + 8)), array("q", bytes(8 * n + 8)), bytearray(n + 1)
        hits = self.automaton.iter(word)  # by end, the longest first at each
        at, hit = next(hits, (n, None))
        for end in range(1, n + 1):
            best, pieces, single = None, 0, False
            while at == end - 1:
                size, s = hit
                single = single or size == 1
                got = score[end - size] + s
                if best is None or got > best:
                    best, pieces = got, count[end - size] + 1
                at, hit = next(hits, (n, None))
            if not single:
                got = score[end - 1] + self.unknown
                if best is None or got > best:
                    best, was_unknown[end] = got, 1
                    own = len(word[end - 1].encode("utf-8", "replace")) if self.bytes else not was_unknown[end - 1]
                    pieces = count[end - 1] + own
            score[end], count[end] = best, pieces
        return count[n], score[n]

    def text(self, text: str) -> tuple[int, float]:
        """Pieces and score of a text."""
        if not text:
            return 0, 0.0
        words = text.replace(SPACE, " ").split(" ")
        if not words[0]:  # the text begins with a space: no mark is put before it
            words = words[1:]
        cache, n, total = self.cache, 0, 0.0
        for w in words:
            got = cache.get(w)
            if got is None:
                got = self.word(SPACE + w)
                if len(w) <= CACHE_CHARS:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[w] = got
            n, total = n + got[0], total + got[1]
        return n, total


def counter(path: str) -> UnigramCounter:
    """The worker's counter of this file."""
    if path not in _made:
        _made[path] = UnigramCounter(read_vocabulary(path))
    return _made[path]


def count_tokens(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, best_score for documents (doc_id, text).

    A null or empty text has no tokens and score 0; rows that repeat stay; other columns are ignored;
    an empty table gives no rows. Texts are whole; memory holds one text and the longest word's paths.
    """
    path = model or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).text
        for b in batches:
            got = [count(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "n_tokens", "best_score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, best_score double")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return count_tokens(storage.table(spark, sf_dir, "documents"))
