"""Quality rules: base counts, and a linear-chain CRF that labels each line content or boilerplate.

A document that passes the base rules is kept if the words of its content lines are at least
CONTENT_SHARE of all. The field is trained on a bounded sample of labelled documents: lines of good
documents count as content, lines of bad ones as boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from roundsmith.llm import chain_crf, storage, textkit
from roundsmith.llm.textkit import U64

MIN_WORDS, REPEAT_PERCENT, CONTENT_SHARE = 50, 50, 0.5
#: Labelled documents of each quality that the field is trained on, and bytes of all of them: whole texts, those with the least hash.
SAMPLE_DOCS, SAMPLE_BYTES = 600, 6 << 20
#: Lines after which a training chain is cut in two.
CHAIN = 200
BOILERPLATE, CONTENT = 0, 1
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_in = lambda chars: np.isin(np.arange(256), [ord(c) for c in chars])
UPPER, LOWER, DIGIT = (np.isin(np.arange(256), np.arange(ord(a), ord(b) + 1)) for a, b in ("AZ", "az", "09"))
ENDING, MARKS = _in(".!?:;\"'"), _in("!")
#: Feature: bounds between its bins. Counts are of the line, shares of its non-blank characters or words.
BINS = {"words": [1, 2, 4, 8, 16, 32], "symbols": [0.001, 0.02, 0.06, 0.15], "upper": [0.02, 0.1, 0.3, 0.6], "digits": [0.001, 0.1, 0.3], "marks": [0.001, 0.03], "word length": [2.0, 3.5, 8.0, 12.0], "distinct": [0.3, 0.6, 0.9], "ends": [0.5], "repeat": [0.5], "first": [0.5]}
N_FEATURES = 1 + sum(len(b) + 1 for b in BINS.values())


def profile(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Base counts of each row (document), and lines: their rows, words and features."""
    n = len(offsets) - 1
    rows_of = lambda at: np.searchsorted(offsets, at, "right") - 1
    starts, ends, rows = textkit.words(data, offsets)
    prefix = textkit.prefix_hash(data, textkit.RAW)
    h = textkit.span_hash(prefix, starts, ends)
    count = lambda at, m: np.bincount(at, minlength=m)
    n_words = count(rows, n)
    # code points: bytes that do not continue one
    points = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~textkit.SPACE[data])])
    word_chars = points[offsets[1:]] - points[offsets[:-1]]
    symbol_at = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    n_symbols = symbol_at[offsets[1:]] - symbol_at[offsets[:-1]]
    # words in windows of three that a row has twice or more
    first, x = textkit.windows(h, rows, 3)
    key = textkit.mix(x + rows[first].astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = np.zeros(len(key), bool)
    if len(key):
        eq = key[order][1:] == key[order][:-1]
        same[order[1:]] |= eq
        same[order[:-1]] |= eq
    in_repeat = np.zeros(len(h), bool)
    for k in range(3):
        in_repeat[first[same] + k] = True
    n_repeat = count(rows[in_repeat], n)
    # lines: the pieces between line ends, in each row at least one
    cut = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offsets[:-1], cut + 1]), kind="stable")
    own = np.repeat(np.arange(n), count(rows_of(cut), n) + 1) if n else np.zeros(0, np.int64)
    stop = np.append(begin[1:], len(data))
    last = np.ones(len(own), bool)
    last[:-1] = own[1:] != own[:-1]
    stop = np.where(last, offsets[own + 1], stop - 1)
    line_of = np.searchsorted(begin, starts, "right") - 1 if len(begin) else np.zeros(0, np.int64)
    m = len(own)
    words = count(line_of, m)
    lh = textkit.mix(textkit.span_hash(prefix, begin, stop) + own.astype(U64) * U64(0xD1B54A32D192ED03))
    order = np.argsort(lh, kind="stable")
    again = np.zeros(m, bool)
    again[order[1:]] = lh[order][1:] == lh[order][:-1]
    again &= words > 0
    n_dup = count(own[again], n)
    # features
    share = lambda mask: _between(mask[data], begin, stop) / np.maximum(chars, 1)
    chars = np.maximum(points[stop] - points[begin], 0)
    wide = np.zeros(len(data), bool)
    wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    letters = _between(UPPER[data] | wide, begin, stop)
    pair = textkit.mix(h + line_of.astype(U64) * U64(0x9E3779B97F4A7C15))
    _, once = np.unique(pair, return_index=True)
    end_char = data[np.maximum(ends - 1, 0)] if len(ends) else np.zeros(0, np.uint8)
    tail = np.zeros(m, bool)
    tail[line_of] = ENDING[end_char]  # the last word of a line is written last
    first_line = np.ones(m, bool)
    first_line[1:] = own[1:] != own[:-1]
    values = {
        "words": words, "symbols": share(SYMBOLS), "upper": letters / np.maximum(chars, 1), "digits": share(DIGIT), "marks": share(MARKS),
        "word length": chars / np.maximum(words, 1), "distinct": count(line_of[once], m) / np.maximum(words, 1), "ends": tail, "repeat": again, "first": first_line,
    }
    some = np.flatnonzero(words > 0)
    f = np.zeros((len(some), N_FEATURES))
    f[:, 0], at = 1, 1
    for name, bounds in BINS.items():
        f[np.arange(len(some)), at + np.searchsorted(bounds, np.asarray(values[name])[some].astype(float), "right")] = 1
        at += len(bounds) + 1
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "line_row": own[some], "line_words": words[some], "x": f}


def _between(mask: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    s = np.concatenate([[0], np.cumsum(mask)])
    return s[stop] - s[begin]


def base_failed(p: dict[str, np.ndarray]) -> np.ndarray:
    return (p["n_words"] < MIN_WORDS) | (100 * p["n_repeat_words"] > REPEAT_PERCENT * p["n_words"])


class LineModel:
    """Weights of the field."""

    def __init__(self, w: np.ndarray, trans: np.ndarray):
        self.w, self.trans = w, trans

    def content_share(self, p: dict[str, np.ndarray]) -> np.ndarray:
        """For each row the share of its words that lie in content lines; 0 without words."""
        n = len(p["n_words"])
        lengths = np.bincount(p["line_row"], minlength=n)
        labels = chain_crf.viterbi(p["x"] @ self.w, lengths, self.trans)
        content = np.bincount(p["line_row"], weights=p["line_words"] * (labels == CONTENT), minlength=n)
        return content / np.maximum(p["n_words"], 1)


def fit(docs: DataFrame, labels: DataFrame) -> LineModel:
    """Trains on SAMPLE_DOCS whole documents and SAMPLE_BYTES of each quality; without both, every line
    counts as content.

    Null or other qualities are left out; a document with several labels is taken under each.
    """
    picked = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    key = F.xxhash64("doc_id", F.lit(3))
    picked = [picked.where(F.col("quality") == q).orderBy(key, "doc_id").limit(SAMPLE_DOCS) for q in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))  # at most 2 * SAMPLE_DOCS rows of 12 bytes
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    rows = storage.sample(texts, SAMPLE_DOCS, SAMPLE_BYTES, "quality")  # bounded again, as doc_ids may repeat
    quality = np.array([r["quality"] for r in rows], np.int64)
    if len(set(quality.tolist())) < 2:
        w = np.zeros((N_FEATURES, 2))
        w[0, CONTENT] = 1.0
        return LineModel(w, np.zeros((2, 2)))
    line_row, x = [], []
    for i, _, data, offs in textkit.pieces(pa.array([r["text"] for r in rows], pa.string())):
        p = profile(data, offs)
        line_row.append(p["line_row"] + i), x.append(p["x"])
    del rows, p
    row = np.concatenate(line_row)
    # chains of CHAIN lines: training steps through all chains at once, as often as the longest has lines
    lengths = np.array([n for lines in np.bincount(row, minlength=len(quality)).tolist() for n in [CHAIN] * (lines // CHAIN) + [lines % CHAIN] * (lines % CHAIN > 0)], np.int64)
    model = LineModel(*chain_crf.train(np.concatenate(x), quality[row], lengths, 2))
    textkit.trim()
    return model


def label_documents(docs: DataFrame, model: LineModel, carry: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    content_share for documents (doc_id, text).

    A null, empty or blank text has no words and fails the base rules; rows that repeat are judged each
    by itself; other columns are ignored, and with carry the whole row is handed on as the struct _row;
    an empty table gives no rows. Repeats are found by 64-bit hashes.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in textkit.pieces(b.column(1)):
                p = profile(data, offs)
                failed, share = base_failed(p), model.content_share(p)
                part = b.slice(i, j - i)
                cols = [part.column(0), *(pa.array(p[k].astype(np.int64)) for k in names), pa.array(failed), pa.array(~failed & (share >= CONTENT_SHARE)), pa.array(share), *([part.column(2)] if carry else [])]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *names, "base_failed", "kept", "content_share", *(["_row"] if carry else [])])
        textkit.trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"), *([F.struct("*").alias("_row")] if carry else []))
    schema = T._parse_datatype_string("doc_id long, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, kept boolean, content_share double")
    return rows.mapInArrow(run, T.StructType([*schema.fields, *([rows.schema["_row"]] if carry else [])]))


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = storage.table(spark, sf_dir, "documents")
    model = fit(docs, storage.table(spark, sf_dir, "labels"))
    return label_documents(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
