"""Benchmark decontamination: a BM25 index of test items, asked with every passage of every document.

The index holds the items; its impacts are divided by each item's score for its own text, so that a
score says how much of an item a passage covers. An item's passages are windows of twice its length class
(the power of two at or above its words), a class apart, so that any copy of an item lies whole in one of
them, whatever other items there are. Items of nearby classes share an index, which is asked with the
passages of its largest class: these hold those of the others. A passage whose words' block maxima do not
reach the threshold in any block of items ends there, whole slices of passages at a time; the others are
searched by block-max WAND, which returns every item above the threshold. Those are scored and verified
in their own passages: enough of the word triples of the item's question and of the word pairs of its answer
must occur, or enough of the pairs of the whole item, since items carry no mark of where their answer begins.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from roundsmith.llm import storage, textkit
from roundsmith.llm.rindex import rolling

K1, B, THRESHOLD, QUESTION, ANSWER, WHOLE = 1.2, 0.75, 0.5, 0.5, 0.5, 0.5
#: Items of a block (of similar lengths, so that its maxima are close bounds); bytes of items that one index may hold (a larger test set makes more indexes).
BLOCK_ITEMS, INDEX_BYTES = 4, 8 << 20
#: Words up to which items share the first index; each further one takes items up to eight times as long.
FIRST_WORDS = 128
#: Bounds (passages by blocks), and postings behind them, that are held at once; a passage counts as one at least.
HELD_BOUNDS, HELD_POSTINGS = 2_000_000, 2_000_000
#: Words here are runs of ASCII letters and digits and of all other characters beyond ASCII, of texts in
#: lower case (all letters).
BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def item_words(text: str) -> np.ndarray:
    """Hashes of the words of an item in lower case."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return textkit.word_hashes(raw, np.array([0, len(raw)]), space=BREAK)[3].view(np.int64)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; of fewer words, the run of all."""
    k = max(1, min(k, len(words)))
    return np.unique(textkit.windows(words.view(np.uint64), np.zeros(len(words), np.int64), k)[1])


def length_class(n: int) -> int:
    """The power of two at or above a number of words."""
    return 1 << max(0, n - 1).bit_length()


class Statistics(NamedTuple):
    """Of a whole test set: items, their mean length in words, and in how many items terms (ascending) occur."""

    n: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


class BlockMaxIndex:
    """BM25 postings with block maxima, in flat arrays; scores are shares of an item's own score."""

    def __init__(self, items: list[tuple[int, str]], whole: Statistics | None = None):
        """Of items (id, text); whole: statistics of the test set that they are a part of, else their own."""
        words = [item_words(t or "") for _, t in items]
        order = sorted(range(len(items)), key=lambda k: (len(words[k]), k))
        self.ids, self.words = [items[k][0] for k in order], [words[k] for k in order]
        lengths = np.array([len(w) for w in self.words], np.int64)
        n, mean = len(items), float(lengths.mean()) if lengths.sum() else 1.0
        self.classes = [length_class(int(k)) for k in lengths]
        self.widest = max([1, *self.classes])
        flat = np.concatenate([*self.words, np.zeros(0, np.int64)])
        self.terms, term = np.unique(flat, return_inverse=True)
        m = len(self.terms)
        #: Postings by term and then item: item, share of the item's score.
        pair, tf = np.unique(term * n + np.repeat(np.arange(n), lengths), return_counts=True)
        of, self.post_doc = np.divmod(pair, max(1, n))
        df = np.bincount(of, minlength=m)
        total, held = n, df
        if whole is not None:
            total, mean, held = whole.n, whole.mean, whole.df[np.searchsorted(whole.terms, self.terms)]
        idf = np.log(1 + (total - held + 0.5) / (held + 0.5))
        impact = idf[of] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.post_doc] / mean))
        self.post_share = impact / np.bincount(self.post_doc, weights=impact, minlength=n)[self.post_doc]
        self.post_start = np.concatenate([[0], np.cumsum(df)])
        #: Block maxima by term and then block.
        new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (self.post_doc[1:] // BLOCK_ITEMS != self.post_doc[:-1] // BLOCK_ITEMS)])) if len(pair) else np.zeros(0, np.int64)
        self.list_block = self.post_doc[new] // BLOCK_ITEMS
        self.list_max = np.maximum.reduceat(self.post_share, new) if len(new) else np.zeros(0)
        self.list_size = np.bincount(of[new], minlength=m)
        self.list_start = np.concatenate([[0], np.cumsum(self.list_size)])
        self.most = np.maximum.reduceat(self.post_share, self.post_start[:-1]) if m else np.zeros(0)
        self.n_blocks = -(-n // BLOCK_ITEMS)
        #: Postings by item: term, share.
        by = np.argsort(self.post_doc, kind="stable")
        self.own_term, self.own_share = of[by], self.post_share[by]
        self.own_start = np.concatenate([[0], np.cumsum(np.bincount(self.post_doc, minlength=n))])

    def parts(self, item: int) -> tuple[np.ndarray, int, np.ndarray, int, np.ndarray, int]:
        """An item's question and answer (its last quarter of words, four at least) and all of it, as grams
        and how many words each has."""
        w = self.words[item]
        cut = len(w) - max(4, len(w) // 4)
        q, a = (w[:cut], w[cut:]) if cut > 0 else (w, w)
        return grams(q, 3), min(3, len(q)), grams(a, 2), min(2, len(a)), grams(w, 2), min(2, len(w))

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Every item (by place) whose score is at least threshold, in order; terms are distinct."""
        # views give plain numbers one at a time, without a copy of the arrays
        docs, shares, blocks, maxima, most, starts, lists = map(memoryview, (self.post_doc, self.post_share, self.list_block, self.list_max, self.most, self.post_start, self.list_start))
        # cursors: item, place in the postings, term, place in the block maxima, ends of both
        live = [[docs[starts[t]], starts[t], t, lists[t], starts[t + 1], lists[t + 1]] for t in terms]
        out, least = [], threshold - 1e-12
        while live:
            live.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(live):
                bound += most[c[2]]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = live[pivot][0]
            while pivot + 1 < len(live) and live[pivot + 1][0] == doc:
                pivot += 1
            # block maxima of the lists up to the pivot, in the pivot's block
            block, bound = doc // BLOCK_ITEMS, 0.0
            for c in live[: pivot + 1]:
                if blocks[c[3]] < block:
                    c[3] = bisect_left(blocks, block, c[3], c[5] - 1)
                if blocks[c[3]] == block:
                    bound += maxima[c[3]]
            if bound >= least:
                if live[0][0] == doc:
                    score = math.fsum(shares[c[1]] for c in live[: pivot + 1])
                    if score >= least:
                        out.append((doc, score))
                    target = doc + 1
                else:
                    target = doc
            else:
                target = max(min((block + 1) * BLOCK_ITEMS, live[pivot + 1][0] if pivot + 1 < len(live) else len(self.ids)), doc + 1)
            for c in live[: pivot + 1]:
                if c[0] < target:
                    c[1] = bisect_left(docs, target, c[1], c[4])
                    c[0] = docs[c[1]] if c[1] < c[4] else -1
            live = [c for c in live if c[0] >= 0]
        return out

    def check(self, item: int, term: np.ndarray, words: np.ndarray, begin: int, end: int) -> tuple[float, float, float] | None:
        """Score, question share and answer share of the best verified passage of an item among those that begin
        from begin up to end, of a document with these terms (-1: none) and word hashes; None if there is none."""
        n, step = len(words), self.classes[item]
        own = slice(self.own_start[item], self.own_start[item + 1])
        terms, share = self.own_term[own], self.own_share[own]
        parts, best = None, None
        last = max(1, -(-n // step) - 1)  # passages of a document; the last one reaches its end
        for k in range(-(-begin // step), min(last, -(-end // step))):
            i, j = k * step, min((k + 2) * step, n)
            score = float(share[np.isin(terms, term[i:j])].sum())
            if score < THRESHOLD - 1e-12:
                continue
            parts = parts or self.parts(item)
            here = [float(np.isin(parts[c], grams(words[i:j], parts[c + 1])).mean()) if j - i >= parts[c + 1] else 0.0 for c in (0, 2, 4)]
            if here[2] >= WHOLE or here[0] >= QUESTION and here[1] >= ANSWER:
                best = max(best or (0.0, 0.0, 0.0), (score, here[0], here[1]))
        return best


def scan(index: BlockMaxIndex, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item, score, question share, answer share) of each verified item of each row, best passage."""
    _, _, rows, h = textkit.word_hashes(data, offsets, space=BREAK)
    h = h.view(np.int64)
    if not len(h) or not len(index.terms):
        return
    at = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    term = np.where(index.terms[at] == h, at, -1)
    count = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    step = index.widest
    per = np.maximum(1, -(-count // step) - 1) * (count > 0)
    row = np.repeat(np.arange(len(count)), per)
    place = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    begin = first[row] + place * step
    end = np.minimum(begin + 2 * step, first[row] + count[row])
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for k, b, e in _slices(begin, end, max(1, HELD_BOUNDS // max(1, index.n_blocks))):
        at = rolling(b, e - b)
        key = np.repeat(np.arange(len(b)), e - b) * len(index.terms) + term[at]
        passage, own = np.divmod(np.unique(key[term[at] >= 0]), len(index.terms))
        edges = np.searchsorted(passage, np.arange(len(b) + 1))
        size = np.concatenate([[0], np.cumsum(index.list_size[own])])[edges]
        i = 0
        while i < len(b):  # passages whose postings' blocks are held at once
            j = max(i + 1, int(np.searchsorted(size, size[i] + HELD_POSTINGS, "right")) - 1)
            p, t = passage[edges[i] : edges[j]] - i, own[edges[i] : edges[j]]
            entry, of = rolling(index.list_start[t], index.list_size[t]), np.repeat(np.arange(len(t)), index.list_size[t])
            cell = p[of] * index.n_blocks + index.list_block[entry]
            reach = np.bincount(cell, weights=index.list_max[entry], minlength=(j - i) * index.n_blocks) >= THRESHOLD - 1e-9
            # of the passages that reach the threshold somewhere, the terms that occur there
            asked = np.bincount(of[reach[cell]], minlength=len(t)) > 0
            p, t = p[asked], t[asked]
            at = np.searchsorted(p, np.arange(j - i + 1))
            for x in np.flatnonzero(np.diff(at)).tolist():
                terms = t[at[x] : at[x + 1]].tolist()
                x += i
                r = int(row[k + x])
                f, n, a = int(first[r]), int(count[r]), int(place[k + x]) * step
                upto = n if place[k + x] == per[r] - 1 else a + step
                for item, _ in index.search(terms, THRESHOLD):
                    got = index.check(item, term[f : f + n], h[f : f + n], a, upto)
                    if got and ((r, item) not in best or got > best[r, item]):
                        best[r, item] = got
            i = j
    for (r, item), got in sorted(best.items()):
        yield r, index.ids[item], *got


def _slices(begin: np.ndarray, end: np.ndarray, many: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for k in range(0, len(begin), many):
        yield k, begin[k : k + many], end[k : k + many]


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tier, own, term: each term of each item once."""
    for b in batches:
        terms = [np.unique(item_words(t)) for t in b.column(2).to_pylist()]
        row = pa.array(np.repeat(np.arange(len(terms)), [len(t) for t in terms]), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(np.concatenate([*terms, np.zeros(0, np.int64)]))], ["tier", "own", "term"])


def _indexes(items: DataFrame) -> Iterator:
    """Indexes of at most INDEX_BYTES or so, broadcast, that hold all items between them; items of each go with
    their lengths. Numbers of items, mean length and document frequencies are those of all items, so scores do not
    depend on how many indexes there are; an index gets the frequencies of its own terms."""
    text = F.lower(F.col("text").cast("string"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).where("text is not null")
    items = items.withColumn("n", F.regexp_count("text", F.lit(r"[0-9a-z\u0080-\x{10FFFF}]+"))).where("n > 0")
    items = items.withColumn("tier", F.greatest(F.lit(0), F.ceil(F.log(F.greatest("n", F.lit(1)) / FIRST_WORDS) / F.log(F.lit(8.0)))).cast("int"))
    tiers = sorted(map(tuple, items.groupBy("tier").agg(F.sum(F.octet_length("text")), F.count("*"), F.sum("n")).collect()))
    if not tiers:
        return
    parts = {tier: 1 + size // INDEX_BYTES for tier, size, _, _ in tiers}
    many = F.element_at(F.create_map(*(F.lit(x) for pair in parts.items() for x in pair)), F.col("tier"))
    items = items.withColumn("own", F.pmod(F.xxhash64("item_id", "text"), many))
    n, mean = sum(t[2] for t in tiers), sum(t[3] for t in tiers) / sum(t[2] for t in tiers)
    saved = []
    if sum(parts.values()) > 1:
        terms = storage.saved(items.select("tier", "own", "text").mapInArrow(_item_terms, "tier int, own long, term long").groupBy("tier", "own", "term").agg(F.count("*").alias("n")), "item-terms")
        whole = storage.saved(terms.groupBy("term").agg(F.sum("n").alias("df")), "item-df")
        saved = [terms, whole]
    for tier, k in ((tier, k) for tier, many in parts.items() for k in range(many)):
        here = (F.col("tier") == tier) & (F.col("own") == k)
        own = items.where(here).select("item_id", "text").collect()  # INDEX_BYTES or so
        if not own:
            continue
        stats = None  # of the one index there is
        if saved:
            df = terms.where(here).select("term").join(whole, "term").orderBy("term").toArrow()  # terms of INDEX_BYTES
            stats = Statistics(n, mean, df["term"].to_numpy(), df["df"].to_numpy())
        yield items.sparkSession.sparkContext.broadcast(BlockMaxIndex(sorted(((r["item_id"], r["text"]) for r in own), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), stats))
    storage.drop(*saved)


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: every verified pair, from documents
    (doc_id, text) and test items (item_id, text).

    Null, empty or wordless texts match nothing; items that repeat match each; rows that repeat a doc_id
    give one row each; other columns are ignored; without items or documents there are no rows. Items
    are split over as many indexes of at most INDEX_BYTES as they need, each asked with all documents: these are
    read once for each index. Scores and verdicts are the same however many there are.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    rows = docs.select(F.col("doc_id").cast("long"), F.lower(F.col("text").cast("string")))
    out = None
    for index in _indexes(items):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, _, data, offs in textkit.pieces(b.column(1)):
                    got = list(scan(index.value, data, offs))
                    if got:
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i + g[0] for g in got])), *(pa.array([g[c] for g in got], t) for c, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.float64())))], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])
            textkit.trim()

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs (with a column text) that hold no test item, each judged by its own text whatever its doc_id."""
    rows = docs.select(F.lower(F.col("text").cast("string")).alias("_text"), F.struct("*").alias("_row"))
    for index in _indexes(items):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for i, _, data, offs in textkit.pieces(b.column(0)):
                    clean[[i + g[0] for g in scan(index.value, data, offs)]] = False
                yield b.filter(pa.array(clean))
            textkit.trim()

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select("_row.*")


def op7_bm25_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a test item, with the item."""
    return find_leaks(storage.table(spark, sf_dir, "documents"), storage.table(spark, sf_dir, "benchmark"))
