"""Hybrid retrieval over a knowledge base: metadata filter, dense candidates with maximal marginal
relevance, TF-IDF, reciprocal rank fusion.

Everything works on a table of queries at once. A query's filter becomes its partition key `part`, and
the knowledge base is laid out by the same key, so the filter comes before every count: the number of
documents and document frequencies are those of the filtered candidates.

Tables: queries(query_id, part, query[, qvec]), kb(part, seq, doc_id, text[, vec]); seq is the order in
which candidates stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from roundsmith.functions.scalar import CONTEXT_SEPARATOR, NO_CONTEXT, idf, rrf, tokens
from roundsmith.plans.lineage import drop, saved

TOP_K, FETCH_K, SPARSE_K, LAMBDA = 4, 20, 20, 0.5
#: Queries and candidates that are held against each other at once; bytes of query vectors that are sent to
#: every task (more queries make more passes over the candidates).
BLOCK, SENT_BYTES = 2048, 64 << 20
#: Sparse search: postings up to which all are read; classes of impact for each halving of it; postings that are read of each query for a first bound of its
#: k-th score; and the share of that bound which postings that are not read may add up to.
FEW_POSTINGS, CLASSES, FIRST_POSTINGS, SKIPPED_SHARE = 4_000_000, 3, 4000, 0.35
#: Postings of documents that a task holds at once; characters of queries that are sent to every task at once.
BLOCK_POSTINGS, SENT_CHARS = 2_000_000, 16 << 20
#: Postings of a term in a task up to which they are one block.
RARE = 8
#: Tasks for each core of the passes over candidates, in which each task hands on the best of each query once.
TASKS_PER_CORE = 4
#: Best rows of all queries that a task holds; what is more is handed on at once.
HELD_ROWS = 2_000_000
#: Terms whose blocks are shuffled as one row of a task.
TERMS_OF_ROW = 1000
#: Greatest impact of each class.
IMPACTS = 2.0 ** (-np.arange(127) / CLASSES)
#: Ids of ranked documents up to which they are sent to every task.
SENT_IDS = 4_000_000
#: Whether best_scores counts what it reads, which takes passes of its own.
COUNT = False
#: Rankings compare scores rounded to so many places, so that the order of sums does not decide ties.
PLACES = 12


def metadata_filter(conditions: dict, column=F.col) -> Column | None:
    """All conditions key = value, as one predicate; none for no conditions. Values are literals: quotes
    in them have no meaning."""
    parts = [column(k) == F.lit(v) for k, v in (conditions or {}).items()]
    return reduce(lambda a, b: a & b, parts) if parts else None


def filtered(kb: DataFrame, conditions: dict | None) -> DataFrame:
    """The candidates that a filter leaves; the predicate reaches the scan where metadata are columns."""
    p = metadata_filter(conditions)
    return kb if p is None else kb.where(p)


def term_table(kb: DataFrame) -> DataFrame:
    """part, doc_id, seq, len, term, tf: postings, which one version of a knowledge base needs once. A document's tokens
    are all in its row, so they are counted there, in Arrow batches: making postings shuffles nothing."""
    rows = kb.select("part", "doc_id", "seq", tokens(F.col("text")).alias("words"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(_counted, f"part {kinds['part']}, doc_id {kinds['doc_id']}, seq {kinds['seq']}, len int, term string, tf long")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = b.column(3)
        length = words.value_lengths().fill_null(0)
        coded = words.flatten().dictionary_encode()
        rows = np.repeat(np.arange(b.num_rows), length.to_numpy())
        if not len(rows):
            continue
        key, tf = np.unique(rows * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
        row, term = (pa.array(x) for x in np.divmod(key, len(coded.dictionary)))
        own = [b.column(k).take(row) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*own, length.take(row), coded.dictionary.take(term), pa.array(tf)], ["part", "doc_id", "seq", "len", "term", "tf"])


def document_frequency(terms: DataFrame) -> DataFrame:
    return terms.groupBy("part", "term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, part, term, qtf: a term that a query repeats counts repeatedly."""
    return queries.select("query_id", "part", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "part", "term").agg(F.count("*").alias("qtf"))


def _impact() -> Column:
    """What a posting adds to a score for each unit of a query's weight; at most 1."""
    return F.col("tf") / (F.col("len") + 1e-6)


def rounded(x: Column, places: int | None = None) -> Column:
    """x to so many places (PLACES), halves away from zero, of the double that x * 10^places is: as SQL engines round doubles, where
    F.round goes by their decimal digits."""
    unit = 10.0 ** (PLACES if places is None else places)
    return F.signum(x) * F.floor(F.abs(x) * unit + 0.5) / unit


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.copysign(np.floor(np.abs(x) * 10.0**PLACES + 0.5) / 10.0**PLACES, x)


def _exact_sum(x: Column) -> Column:
    """A sum of doubles that no order of its rows changes: of multiples of 2^-30, which add up exactly, and of what is left of
    them. So documents with equal words get equal scores, and ties are ties."""
    coarse = F.floor(x * 2.0**30) / 2.0**30
    return F.sum(coarse) + F.sum(x - coarse)


class SparseIndex:
    """The postings of the terms that some queries ask for, a row for each document with arrays of gaps between term numbers and of frequencies
    (classes of impact follow from these; terms that more queries ask for have smaller numbers, so gaps are small); blocks of one term and class with the
    number and the greatest impact of their postings, a row for each term; the terms' idf and the queries' weights. Tables of the shared folder, until
    closed. Documents stay in the tasks that read them: postings are never shuffled."""

    def __init__(self, queries: DataFrame, kb: DataFrame):
        own = saved(query_terms(queries), "query-terms")
        asked = own.groupBy("part", "term").agg(F.count("*").alias("n")).toArrow().combine_chunks()
        asked = asked.sort_by([("part", "ascending"), ("n", "descending"), ("term", "ascending")]).drop_columns(["n"])
        asked = asked.append_column("id", pa.array(np.arange(asked.num_rows, dtype=np.int32)))
        terms = saved(kb.sparkSession.createDataFrame(asked) if asked.num_rows else own.select("part", "term", F.lit(0).alias("id")), "terms")
        rows = kb.select("part", "doc_id", "seq", tokens(F.col("text")).alias("words"))
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        schema = f"part {kinds['part']}, doc_id {kinds['doc_id']}, seq {kinds['seq']}, len int, gaps array<int>, tfs array<int>"
        self.rows = saved(rows.mapInArrow(_asked_postings(kb.sparkSession, asked), schema), "postings")
        # a task for each core, so that what is shuffled grows with the blocks and the cluster, not with the documents; by term, for both groupings
        tasks = kb.sparkSession.sparkContext.defaultParallelism
        counted = self.rows.coalesce(tasks).mapInArrow(_rows_of_blocks, "terms_of int, terms array<int>, classes array<tinyint>, ns array<int>, tops array<smallint>")
        self.blocks = saved(counted.groupBy("terms_of").applyInArrow(_added_blocks, "term int, df long, classes array<struct<cls:tinyint,n:int,top:float>>"), "blocks")
        n = kb.groupBy("part").agg(F.count("*").alias("n_docs"))
        of_term = self.blocks.select("term", "df").join(terms.select(F.col("id").alias("term"), "part"), "term").join(F.broadcast(n), "part")
        self.idf = saved(of_term.select("term", idf(F.col("n_docs"), F.col("df")).alias("idf")), "idf")
        self.own = own.join(terms, ["part", "term"]).select("query_id", "part", F.col("id").alias("term"), "qtf")
        self.weights = self.own.join(self.idf, "term").select("query_id", "part", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
        self.tables = [own, terms, self.rows, self.blocks, self.idf]

    def _postings(self) -> DataFrame:
        kinds = {f.name: f.dataType.simpleString() for f in self.rows.schema}
        rows = self.rows.mapInArrow(_opened, ", ".join(f"{c} {kinds[c]}" for c in ("part", "doc_id", "seq", "len")) + ", terms array<int>, tfs array<int>, classes array<tinyint>")
        each = rows.select("part", "doc_id", "seq", "len", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
        return each.select("part", "doc_id", "seq", "len", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))

    def all_scores(self) -> DataFrame:
        """query_id, doc_id, seq, score for every document that shares a term with a query."""
        rows = self._postings().join(self.weights, ["part", "term"])
        return rows.groupBy("query_id", "doc_id", "seq").agg(rounded(_exact_sum(F.col("weight") * _impact())).alias("score"))

    def n_postings(self) -> int:
        """Postings of all terms of all queries, once for each query."""
        asked = self.own.groupBy("term").agg(F.count("*").alias("q"))
        return self.blocks.join(asked, "term").agg(F.coalesce(F.sum(F.col("df") * F.col("q")), F.lit(0))).first()[0]

    def close(self) -> None:
        drop(*self.tables)


def _asked_postings(spark: SparkSession, asked: pa.Table):
    """The postings of the asked terms (part, term, id; in order) of rows (part, doc_id, seq, words), a row for each document with any."""
    own: dict = {}
    for part in asked["part"].unique():
        t = asked.filter(pc.equal(asked["part"], part))
        own[part.as_py()] = (t["id"][0].as_py(), t["term"].combine_chunks())
    sent = spark.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in whole.column(0).unique():
                if part.as_py() not in sent.value:
                    continue
                first, terms = sent.value[part.as_py()]
                b = whole.filter(pc.equal(whole.column(0), part))
                words = b.column(3)
                length = words.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                coded = words.flatten().dictionary_encode()
                known = pc.index_in(coded.dictionary, value_set=terms.cast(coded.dictionary.type)).fill_null(-1).to_numpy()
                code = known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.int64)
                row, code = np.repeat(np.arange(b.num_rows), length)[code >= 0], code[code >= 0]
                key, tf = np.unique(row * len(terms) + code, return_counts=True)
                if not len(key):
                    continue
                row, code = np.divmod(key, len(terms))
                some, counts = np.unique(row, return_counts=True)
                starts = counts.cumsum() - counts
                gaps = np.diff(code, prepend=0)
                gaps[starts] = code[starts] + first
                ends = pa.array(np.append(starts, len(row)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (gaps, tf)]
                kept = [b.column(c).take(pa.array(some)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(length[some].astype(np.int32)), *lists], ["part", "doc_id", "seq", "len", "gaps", "tfs"])

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stored rows (part, doc_id, seq, len, gaps, tfs) with arrays of terms, tfs and classes. A class is found by comparisons alone, so it is
    the same in all passes and on all machines."""
    for b in batches:
        if not b.num_rows:
            continue
        n = pc.list_value_length(b.column(4)).to_numpy()
        gaps, tf = (pc.list_flatten(b.column(c)).to_numpy() for c in (4, 5))
        ends = np.concatenate([[0], n.cumsum()])
        terms = gaps.cumsum(dtype=np.int64)
        terms -= np.repeat(np.concatenate([[0], terms])[ends[:-1]], n)
        impact = np.minimum(tf / (np.repeat(b.column(3).to_numpy(), n) + 1e-6), 1.0)
        cls = np.searchsorted(-IMPACTS, -impact, "right") - 1
        lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x)) for x in (terms.astype(np.int32), tf, cls.astype(np.int8))]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(4)), *lists], ["part", "doc_id", "seq", "len", "terms", "tfs", "classes"])


def _merged(key: np.ndarray, n: np.ndarray | None, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys once, in order, with the sum of n (None: 1 each) and the greatest top of each."""
    if not len(key):
        return key, np.zeros(0, np.int64), top
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.append(starts, len(key))) if n is None else np.add.reduceat(n[order], starts)
    return key[starts], n, np.maximum.reduceat(top[order], starts)


def _counted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, cls, n, top: of a task's documents (len, terms, tfs, classes) a row for each block, in order. A term with up to RARE postings in the task
    is one block there, of its greatest class: whoever reads up to that class reads all of them. top is a float that is not below the impact."""
    held, size, least = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))], 0, BLOCK_POSTINGS // 4
    for b in batches:
        terms, tf, cls = (pc.list_flatten(b.column(c)).to_numpy() for c in (1, 2, 3))
        length = np.repeat(b.column(0).to_numpy(), pc.list_value_length(b.column(1)).to_numpy())
        top = (tf / (length + 1e-6) * (1 + 2.0**-22)).astype(np.float32)
        # a batch has many more postings than blocks: only its blocks are held
        held.append(_merged(terms.astype(np.int64) << 7 | cls, None, top))
        size += len(held[-1][0])
        if size >= least:
            held, size = [_merged(*(np.concatenate(x) for x in zip(*held, strict=True)))], 0
            least = max(BLOCK_POSTINGS // 4, len(held[0][0]))
    key, n, top = _merged(*(np.concatenate(x) for x in zip(*held, strict=True)))
    if len(key):
        starts = np.flatnonzero(np.concatenate([[True], key[1:] >> 7 != key[:-1] >> 7]))
        own = np.diff(np.append(starts, len(key)))
        rare = np.repeat(np.add.reduceat(n, starts) <= RARE, own)
        key, n, top = _merged(np.where(rare, np.repeat(key[starts + own - 1], own), key), n, top)
    for at in range(0, len(key), 100_000):
        k = key[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array((k >> 7).astype(np.int32)), pa.array((k & 127).astype(np.int8)), pa.array(n[at : at + 100_000]), pa.array(top[at : at + 100_000])], ["term", "cls", "n", "top"])


def _rows_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a task's stored rows, as arrays: a row for TERMS_OF_ROW terms. Of top, the upper half of its bits goes on, rounded up."""
    for b in _counted_blocks(x.select(["len", "terms", "tfs", "classes"]) for x in _opened(batches)):
        terms, cls, n, top = (c.to_numpy() for c in b.columns)
        upper = ((top.view(np.uint32) + np.uint32(0xFFFF)) >> np.uint32(16)).astype(np.int16)
        of, starts = np.unique(terms // TERMS_OF_ROW, return_index=True)
        ends = pa.array(np.append(starts, len(terms)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (terms, cls, n.astype(np.int32), upper)]
        yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), *lists], ["terms_of", "terms", "classes", "ns", "tops"])


def _added_blocks(t: pa.Table) -> pa.Table:
    """The blocks of all tasks, a row for each term."""
    terms, cls, n, upper = (pc.list_flatten(t[c]).to_numpy() for c in ("terms", "classes", "ns", "tops"))
    key, n, top = _merged(terms.astype(np.int64) << 7 | cls, n.astype(np.int64), (upper.astype(np.uint32) << np.uint32(16)).view(np.float32))
    starts = np.flatnonzero(np.concatenate([[True], key[1:] >> 7 != key[:-1] >> 7]))
    classes = pa.StructArray.from_arrays([pa.array((key & 127).astype(np.int8)), pa.array(n.astype(np.int32)), pa.array(top)], ["cls", "n", "top"])
    ends = pa.array(np.append(starts, len(key)).astype(np.int32))
    return pa.table([pa.array((key[starts] >> 7).astype(np.int32)), pa.array(np.add.reduceat(n, starts)), pa.ListArray.from_arrays(ends, classes)], ["term", "df", "classes"])


def _sent_blocks(index: SparseIndex):
    """The blocks as arrays that every task gets: terms in order, their idf, where their blocks begin; and of those cls, n, top."""
    t = index.blocks.select("term", F.inline("classes")).toArrow().combine_chunks().sort_by([("term", "ascending"), ("cls", "ascending")])
    of_term = index.idf.toArrow().combine_chunks().sort_by("term")
    terms = of_term["term"].to_numpy()
    starts = np.append(np.searchsorted(t["term"].to_numpy(), terms), t.num_rows)
    return index.idf.sparkSession.sparkContext.broadcast((terms, of_term["idf"].to_numpy(), starts, *(t[c].to_numpy() for c in ("cls", "n", "top"))))


class _Asked:
    """Queries as arrays that every task gets: of each part their ids, where their terms begin, terms, weights, the class up to which
    postings are read at first (cut, -1: none), and least and rest of best_scores."""

    def __init__(self, rows: DataFrame):
        """rows: query_id, part, least, rest, terms (term, weight, cut)."""
        t = rows.select("part", "query_id", "least", "rest", F.inline("terms")).toArrow().combine_chunks()
        t = t.sort_by([("part", "ascending"), ("query_id", "ascending"), ("term", "ascending")])
        own: dict = {}
        for part in t["part"].unique():
            u = t.filter(pc.equal(t["part"], part)).combine_chunks()
            ids = u["query_id"].combine_chunks().dictionary_encode()
            starts = np.searchsorted(ids.indices.to_numpy(), np.arange(len(ids.dictionary) + 1))
            columns = [u[c].to_numpy() for c in ("term", "weight", "cut")]
            limits = [u[c].to_numpy()[starts[:-1]] for c in ("least", "rest")]
            own[part.as_py()] = (ids.dictionary, starts, *columns, *limits)
        self.sent = rows.sparkSession.sparkContext.broadcast(own)
        self.id_type = rows.schema["query_id"].dataType.simpleString()


class _Block:
    """Postings of some documents of one part, by term and class; and by document."""

    def __init__(self, rows: pa.Table):
        counts = pc.list_value_length(rows["terms"]).to_numpy()
        terms, tf, cls = (pc.list_flatten(rows[c]).to_numpy() for c in ("terms", "tfs", "classes"))
        doc = np.repeat(np.arange(rows.num_rows, dtype=np.int32), counts)
        impact = tf / (rows["len"].to_numpy()[doc] + 1e-6)
        self.n, self.starts = rows.num_rows, np.concatenate([[0], counts.cumsum()])
        self.own_terms, self.own_impact = terms, impact
        self.first = int(terms.min())
        key = (terms.astype(np.int64) << 7) + cls
        order = np.argsort(key, kind="stable")
        self.key, self.doc, self.impact = key[order], doc[order], impact[order]
        self.of_term = np.searchsorted(self.key, np.arange(self.first, int(terms.max()) + 2, dtype=np.int64) << 7)

    def ranges(self, terms: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the postings of terms up to their cuts begin, and how many they are."""
        at = np.clip(terms - self.first, 0, len(self.of_term) - 1)
        begin = self.of_term[at]
        n = np.zeros(len(terms), np.int64)
        some = np.flatnonzero((cut >= 0) & (at == terms - self.first) & (at < len(self.of_term) - 1))
        some = some[self.of_term[at[some] + 1] > begin[some]]
        n[some] = np.searchsorted(self.key, (terms[some].astype(np.int64) << 7) + cut[some], "right") - begin[some]
        return begin, n

    def sums(self, begin: np.ndarray, n: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of each document the sum over these ranges."""
        at = _each_of(begin, n)
        return np.bincount(self.doc[at], self.impact[at] * np.repeat(weight, n), self.n)

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of some documents by the weights of all terms, as _exact_sum adds."""
        n = self.starts[docs + 1] - self.starts[docs]
        at = _each_of(self.starts[docs], n)
        row = np.repeat(np.arange(len(docs)), n)
        x = weights[self.own_terms[at]] * self.own_impact[at]
        coarse = np.floor(x * 2.0**30) / 2.0**30
        total = np.bincount(row, coarse, len(docs)) + np.bincount(row, x - coarse, len(docs))
        return _rounded(total)


def _each_of(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of ranges."""
    return np.arange(n.sum()) + np.repeat(begin - (n.cumsum() - n), n)


def _blocks_of(batches: Iterator[pa.RecordBatch], known) -> Iterator[tuple]:
    """Parts with the rows of blocks of at most BLOCK_POSTINGS postings or one batch more."""
    held: dict = {}
    size = 0
    for b in batches:
        for part in b.column(0).unique():
            if part.as_py() in known:
                rows = b.filter(pc.equal(b.column(0), part))
                held.setdefault(part.as_py(), []).append(rows)
                size += pc.sum(pc.list_value_length(rows.column(4))).as_py()
        if size >= BLOCK_POSTINGS:
            yield from ((p, pa.Table.from_batches(x)) for p, x in held.items())
            held, size = {}, 0
    yield from ((p, pa.Table.from_batches(x)) for p, x in held.items())


def _k_best(rows: pa.Table, k: int) -> pa.Table:
    """Of rows (q, doc_id, seq, score) the k of each q with the greatest scores, ties by seq."""
    q, score, seq = (rows[c].to_numpy() for c in ("q", "score", "seq"))
    order = np.lexsort((seq, -score, q))
    own = q[order]
    return rows.take(pa.array(order[np.arange(len(own)) - np.searchsorted(own, own) < k])).combine_chunks()


def _best_of_task(found: Iterator[pa.Table], k: int) -> Iterator[pa.Table]:
    """The k best rows of each q of all tables together; of more than HELD_ROWS, of as many as are held."""
    held, size, least = [], 0, HELD_ROWS // 4
    for rows in found:
        held.append(rows)
        size += rows.num_rows
        if size >= least:
            best = _k_best(pa.concat_tables(held), k)
            if best.num_rows > HELD_ROWS:
                yield best
                best = best.slice(0, 0)
            held, size = [best], best.num_rows
            least = max(HELD_ROWS // 4, 2 * size)
    if size:
        yield _k_best(pa.concat_tables(held), k)


def _first_sums(asked: _Asked, k: int):
    """query_id, sums: the k greatest sums over the postings up to the cuts, of all documents of a task; rounded down."""
    sent, id_type = asked.sent, to_arrow_type(DataType.fromDDL(asked.id_type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {part: {} for part in sent.value}
        for part, rows in _blocks_of(batches, sent.value):
            _, starts, terms, weight, cut, _, _ = sent.value[part]
            block, held = _Block(rows), best[part]
            begin, n = block.ranges(terms, cut)
            for q in np.flatnonzero(np.add.reduceat(n, starts[:-1])):
                own = slice(starts[q], starts[q + 1])
                total = block.sums(begin[own], n[own], weight[own])
                total = total[total > 0]
                total = np.partition(total, -k)[-k:] if len(total) > k else total
                total = np.nextafter(total.astype(np.float32), np.float32(0))
                if q in held:
                    total = np.concatenate([held[q], total])
                    total = np.partition(total, -k)[-k:] if len(total) > k else total
                held[q] = total
        for part, held in best.items():
            ids, found = sent.value[part][0], list(held)
            for at in range(0, len(found), 10_000):
                some = found[at : at + 10_000]
                ends = pa.array(np.cumsum([0, *(len(held[q]) for q in some)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)).cast(id_type), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([held[q] for q in some])))], ["query_id", "sums"])

    return run


def _best_of_blocks(asked: _Asked, k: int):
    """query_id, doc_id, seq, score: of all documents of a task the k best whose sum over the postings up to the cuts can reach
    least with rest, scored in full."""
    sent, id_type = asked.sent, to_arrow_type(DataType.fromDDL(asked.id_type))

    def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        size = 1 + max((int(own[2].max()) for own in sent.value.values()), default=0)
        all_weights = np.zeros(size)
        base = dict(zip(sent.value, np.cumsum([0, *(len(own[0]) for own in sent.value.values())]).tolist(), strict=False))
        for part, rows in _blocks_of(batches, sent.value):
            _, starts, terms, weight, cut, least, rest = sent.value[part]
            block, seq = _Block(rows), rows["seq"].to_numpy()
            begin, n = block.ranges(terms, cut)
            found = []
            for q in np.flatnonzero(np.add.reduceat(n, starts[:-1])):
                own = slice(starts[q], starts[q + 1])
                total = block.sums(begin[own], n[own], weight[own])
                docs = np.flatnonzero((total > 0) & (total >= least[q] - rest[q] - 1e-9))
                if len(docs):
                    all_weights[terms[own]] = weight[own]
                    score = block.scores(docs, all_weights)
                    all_weights[terms[own]] = 0
                    best = np.lexsort((seq[docs], -score))[:k]
                    best = best[score[best] >= least[q] - 1e-9]
                    found.append((np.full(len(best), q), docs[best], score[best]))
            if found:
                q, docs, score = (np.concatenate(x) for x in zip(*found, strict=True))
                own = rows.select(["doc_id", "seq"]).take(pa.array(docs)).combine_chunks()
                yield pa.table([pa.array(base[part] + q), own["doc_id"], own["seq"], pa.array(score)], ["q", "doc_id", "seq", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays([own[0].cast(id_type) for own in sent.value.values()]) if sent.value else None
        for best in _best_of_task(found_in(batches), k):
            yield from best.drop_columns(["q"]).add_column(0, "query_id", ids.take(best["q"].combine_chunks())).to_batches(max_chunksize=100_000)

    return run


def _needed(share: float):
    """Of a query's blocks (term, cls, n, bound, least) those whose postings must be read. For each term, blocks up
    to some bound are skipped; these bounds add up to less than share of least, which a document of the result
    reaches, so what is skipped of it does not. Among all such choices the one that skips most postings for what its
    bounds add up to: steps along each term's concave hull of (bound, postings skipped), best ratio first."""

    def run(t: pa.Table) -> pa.Table:
        term, bound, n = (t[c].to_numpy() for c in ("term", "bound", "n"))
        room = share * t["least"][0].as_py()
        steps = []
        order = np.lexsort((bound, term))
        starts = np.flatnonzero(np.concatenate([[True], term[order][1:] != term[order][:-1]]))
        for own in np.split(order, starts[1:]):
            hull: list[list] = []  # width in bound, postings, blocks
            for k, width in zip(own.tolist(), np.diff(bound[own], prepend=0.0).tolist(), strict=True):
                hull.append([width, int(n[k]), [k]])
                while len(hull) > 1 and hull[-1][1] * hull[-2][0] >= hull[-2][1] * hull[-1][0]:
                    width, more, blocks = hull.pop()
                    hull[-1] = [hull[-1][0] + width, hull[-1][1] + more, hull[-1][2] + blocks]
            steps += [(width / count, int(own[0]), place, width, blocks) for place, (width, count, blocks) in enumerate(hull)]
        read, skipped, ended = np.ones(len(term), bool), 0.0, set()
        for _, first, _, width, blocks in sorted(steps):
            if first in ended or skipped + width >= room:
                ended.add(first)  # of a term the later steps need the earlier ones
                continue
            skipped += width
            read[blocks] = False
        rows = t.filter(pa.array(read)).select(["query_id", "part", "term", "cls", "weight", "n", "least"])
        return rows.append_column("rest", pa.array(np.full(rows.num_rows, skipped)))

    return run


def _cuts(sent, share: float | None):
    """Of rows (query_id, part, least, terms (term, qtf)), a query each, what _Asked takes, and the number of postings that are
    read: by _needed, or (share None) the blocks that can add most, FIRST_POSTINGS postings of them. Terms that no document has are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_terms, idfs, starts, *columns = sent.value
        for b in batches:
            out, kept = [], []
            for k in range(b.num_rows):
                terms = b.column(3)[k].values
                term, qtf = (terms.field(c).to_numpy() for c in ("term", "qtf"))
                place = np.searchsorted(all_terms, term)
                known = all_terms[np.minimum(place, len(all_terms) - 1)] == term if len(all_terms) else np.zeros(len(term), bool)
                term, place = term[known], place[known]
                if not len(term):
                    continue
                kept.append(k)
                weight, count = qtf[known] * idfs[place], starts[place + 1] - starts[place]
                of, at = np.repeat(np.arange(len(term)), count), _each_of(starts[place], count)
                cls, n, top = (c[at] for c in columns)
                number, w = term[of], weight[of]
                t = pa.table({"query_id": np.zeros(len(of), np.int8), "part": np.zeros(len(of), np.int8), "term": number, "cls": cls, "weight": w, "n": n, "bound": w * top, "least": np.full(len(of), b.column(2)[k].as_py())})
                if share is None:
                    order = np.lexsort((cls, number, -t["bound"].to_numpy()))
                    t, rest = t.take(pa.array(order[t["n"].to_numpy()[order].cumsum() <= FIRST_POSTINGS])), 0.0
                else:
                    t = _needed(share)(t)
                    rest = t["rest"][0].as_py() if t.num_rows else 0.0
                cut = np.full(len(term), -1, np.int32)  # terms of which nothing is read belong to a full score
                known, at = np.unique(term, return_index=True)
                np.maximum.at(cut, at[np.searchsorted(known, t["term"].to_numpy())], t["cls"].to_numpy().astype(np.int32))
                out.append((rest, t["n"].to_numpy().sum(), pa.StructArray.from_arrays([pa.array(x) for x in (term, weight, cut)], ["term", "weight", "cut"])))
            if out:
                b = b.take(pa.array(kept))
                ends = pa.array(np.cumsum([0, *(len(x[2]) for x in out)]).astype(np.int32))
                terms = pa.ListArray.from_arrays(ends, pa.concat_arrays([x[2] for x in out]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([float(x[0]) for x in out]), pa.array([int(x[1]) for x in out]), terms], ["query_id", "part", "least", "rest", "n", "terms"])

    return run


def sparse_scores(queries: DataFrame, kb: DataFrame) -> DataFrame:
    """query_id, doc_id, seq, score for every document that shares a term with a query: the plain way."""
    return SparseIndex(queries, kb).all_scores()


def best_scores(index: SparseIndex, k: int) -> tuple[DataFrame, dict[str, int]]:
    """query_id, doc_id, seq, score of the documents that can be among the k best of a query by a score above 0; and
    counts: postings of all queries' terms, those read, and (if COUNT) documents handed on by the tasks.

    Exact pruning by blocks of impact, within the tasks that hold the documents: no row is made for a query and a document, but for the
    best. The blocks that can add most, FIRST_POSTINGS postings of them for each query, give it a bound that k documents reach. The
    blocks to be read then leave out as many postings as that bound allows, frequent terms' first; a document whose sum falls short of it
    even with all that is left out is dropped, the others are scored in full, and a task hands on the k best of all its documents.
    A query that finds no k documents at first has all its postings read. Of up to FEW_POSTINGS nothing is left out: the
    scores are the same, and the passes that choose cost more than they save."""
    postings = index.n_postings()
    if postings <= FEW_POSTINGS:
        return index.all_scores(), {"postings": postings, "read": postings}
    # blocks go to the tasks that hold the queries, so no query's blocks are shuffled; these tasks have much to do for few bytes, so each core gets some
    tasks = TASKS_PER_CORE * index.rows.sparkSession.sparkContext.defaultParallelism
    own = saved(index.own.repartition(tasks, "query_id").groupBy("query_id", "part").agg(F.collect_list(F.struct("term", "qtf")).alias("terms")), "asked")
    blocks = _sent_blocks(index)
    kinds = {f.name: f.dataType.simpleString() for f in (*index.rows.schema, *own.schema)}
    kinds["terms"] = "array<struct<term:int,weight:double,cut:int>>"
    out = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in ("query_id", "part", "least", "rest")) + f", n long, terms {kinds['terms']}"
    cuts = lambda least, share: own.join(F.broadcast(least), "query_id", "left").select("query_id", "part", F.coalesce("least", F.lit(0.0)).alias("least"), "terms").mapInArrow(_cuts(blocks, share), out)
    first = _Asked(cuts(own.select("query_id", F.lit(0.0).alias("least")).limit(0), None))
    # the k best sums of each query once for a task, so what is shuffled grows with the queries and the cluster, not with the blocks
    in_tasks = lambda run, schema: index.rows.coalesce(tasks).mapInArrow(lambda batches: run(_opened(batches)), schema)
    sums = in_tasks(_first_sums(first, k), f"query_id {first.id_type}, sums array<float>").groupBy("query_id").agg(F.flatten(F.collect_list("sums")).alias("sums"))
    least = saved(sums.select("query_id", F.try_element_at(F.sort_array("sums", asc=False), F.lit(k)).cast("double").alias("least")), "least")
    needed = saved(cuts(least, SKIPPED_SHARE), "needed")
    last = _Asked(needed)
    scores = saved(in_tasks(_best_of_blocks(last, k), f"query_id {last.id_type}, doc_id {kinds['doc_id']}, seq {kinds['seq']}, score double"), "scores")
    counts = {"postings": postings} | ({"read": needed.agg(F.sum("n")).first()[0] or 0, "scored": scores.count()} if COUNT else {})
    drop(own, needed, least)
    index.tables.append(scores)
    return scores, counts


def sparse_top(queries: DataFrame, kb: DataFrame, k: int = SPARSE_K) -> DataFrame:
    """query_id, doc_id, seq, score, rank (from 0): the k best of each query, ties in candidate order.

    Every task gets the queries, SENT_CHARS of them at a time (more queries make more passes over the candidates).
    Documents without a common term have score 0 and follow in candidate order: the first k candidates
    of the part stand in for them, which is as many as can be needed."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "seq")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)
    queries = saved(queries.select("query_id", "part", "query"), "queries")
    size = queries.agg(F.coalesce(F.sum(F.length("query")), F.lit(0))).first()[0]
    passes = max(1, -(-size // SENT_CHARS))
    top = None
    for k_pass in range(passes):
        # scores of common terms are above 0, so only queries with fewer than k of them need any other document
        index = SparseIndex(queries if passes == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == k_pass), kb)
        part = saved(ranked(best_scores(index, k)[0]), "sparse-top")
        index.close()
        top = part if top is None else top.unionByName(part)
    few = queries.select("query_id", "part").join(top.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k), "query_id", "left_anti")
    # a table of known size: k rows for each part, which queries of one part need not be gathered to meet
    first = kb.select("part", "doc_id", "seq", F.row_number().over(Window.partitionBy("part").orderBy("seq")).alias("place")).where(F.col("place") <= k)
    zero = few.join(saved(first.drop("place"), "first"), "part").select("query_id", "doc_id", "seq", F.lit(0.0).alias("score"))
    zero = zero.join(top, ["query_id", "doc_id", "seq"], "left_anti")
    return ranked(top.drop("rank").unionByName(zero))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, by the same steps as _cosines; 0 where one has no length."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n > 0, F.least(F.greatest(dot(a, b) / n, F.lit(-1.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def _cosines(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of rows i of a with rows j of b. Components are added one after another, so that equal vectors have equal cosines wherever
    they stand, which the sums of a matrix product do not give; for vectors of floats they are DuckDB's, bit for bit."""
    product, own_a, own_b = np.zeros(len(i)), np.zeros(len(a)), np.zeros(len(b))
    for x, y in zip(a.T, b.T, strict=True):
        product += x[i] * y[j]
        own_a += x * x
        own_b += y * y
    n = np.sqrt(own_a[i] * own_b[j])
    return np.clip(np.divide(product, n, out=np.zeros(len(i)), where=n > 0), -1.0, 1.0)


def dense_candidates(queries: DataFrame, kb: DataFrame, k: int = FETCH_K) -> DataFrame:
    """query_id, doc_id, seq, vec, sim, place: the nearest candidates with their vectors."""
    return kb.select("part", "doc_id", "seq", "vec").join(nearest(queries, kb, k), ["part", "doc_id", "seq"]).select("query_id", "doc_id", "seq", "vec", "sim", "place")


def nearest(queries: DataFrame, kb: DataFrame, k: int = FETCH_K) -> DataFrame:
    """query_id, part, doc_id, seq, sim, place: the k nearest of each query, ties in candidate order; vectors are
    of one length. Blocks of candidates times blocks of queries are matrix products, of which the k best of each
    stay (what comes within 1e-9 of the k-th is computed again by _cosines), and a task hands on the k best of all its candidates; no row is made for any other
    pair. So what is shuffled grows with the queries and the cluster, not with the candidates. Queries go to every task, SENT_BYTES of vectors at a time."""
    asked = queries.where("qvec is not null").select("part", "query_id", F.col("qvec").cast("array<double>").alias("qvec"))
    size = asked.agg(F.coalesce(F.sum(F.size("qvec")), F.lit(0))).first()[0] * 8
    passes = max(1, -(-size // SENT_BYTES))
    rows = kb.where("vec is not null").select("part", F.col("doc_id").cast("long"), F.col("seq").cast("long"), F.col("vec").cast("array<double>"))
    rows = rows.coalesce(TASKS_PER_CORE * kb.sparkSession.sparkContext.defaultParallelism)
    id_type = queries.schema["query_id"].dataType.simpleString()
    scored = None
    for k_pass in range(passes):
        own = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == k_pass)
        part = rows.mapInArrow(_nearest(own, k), f"query_id {id_type}, part string, doc_id long, seq long, sim double")
        scored = part if scored is None else scored.union(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "seq")
    return saved(scored.withColumn("place", F.row_number().over(w) - 1).where(F.col("place") < k), "nearest")


def _nearest(asked: DataFrame, k: int):
    by: dict = {}
    for r in asked.collect():  # SENT_BYTES of vectors or so
        by.setdefault(r["part"], []).append((r["query_id"], r["qvec"]))
    sent = asked.sparkSession.sparkContext.broadcast({p: ([i for i, _ in own], np.array([v for _, v in own], np.float64)) for p, own in by.items()})
    id_type = to_arrow_type(asked.schema["query_id"].dataType)

    def best(part: str, doc: np.ndarray, seq: np.ndarray, vec: np.ndarray, base: int) -> Iterator[pa.Table]:
        ids, asked = sent.value[part]
        order = np.argsort(seq, kind="stable")  # so that ties stay in candidate order
        doc, seq, vec = doc[order], seq[order], vec[order]
        size = np.sqrt((vec * vec).sum(axis=1))
        for i in range(0, len(ids), BLOCK):
            q = asked[i : i + BLOCK]
            n = np.sqrt((q * q).sum(axis=1))[:, None] * size
            near = np.divide(q @ vec.T, n, out=np.zeros(n.shape), where=n > 0)
            last = -np.partition(-near, min(k, len(doc)) - 1, axis=1)[:, [min(k, len(doc)) - 1]]
            row, at = np.nonzero(~(near < last - 1e-9))
            sim = _rounded(_cosines(q, vec, row, at))
            yield _k_best(pa.table({"q": base + i + row, "doc_id": doc[at], "seq": seq[at], "score": sim}), k)

    def found_in(batches: Iterator[pa.RecordBatch], base: dict) -> Iterator[pa.Table]:
        held: dict = {}
        for b in batches:
            parts = b.column(0).to_pylist()
            doc, seq = (b.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            vec = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for p in base.keys() & set(parts):
                own = np.array([x == p for x in parts])
                held.setdefault(p, []).append((doc[own], seq[own], vec[own]))
                if sum(len(x[0]) for x in held[p]) >= BLOCK:
                    yield from best(p, *(np.concatenate(x) for x in zip(*held.pop(p), strict=True)), base[p])
        for p, own in held.items():
            yield from best(p, *(np.concatenate(x) for x in zip(*own, strict=True)), base[p])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [len(ids) for ids, _ in sent.value.values()]
        base = dict(zip(sent.value, np.cumsum([0, *sizes]).tolist(), strict=False))
        ids = pa.array([i for own, _ in sent.value.values() for i in own], id_type)
        parts = pa.array([p for p, (own, _) in sent.value.items() for _ in own], pa.string())
        for rows in _best_of_task(found_in(batches, base), k):
            q = rows["q"].combine_chunks()
            yield from pa.table([ids.take(q), parts.take(q), rows["doc_id"], rows["seq"], rows["score"]], ["query_id", "part", "doc_id", "seq", "sim"]).to_batches(max_chunksize=100_000)

    return run


def mmr(candidates: DataFrame, k: int = TOP_K, balance: float = LAMBDA) -> DataFrame:
    """query_id, doc_id, seq, rank of the greedy choice: first the nearest, then the best of
    balance * similarity - (1 - balance) * the largest similarity to one chosen; ties by place.

    A fold over at most fetch-k candidates of each query, within the JVM."""
    item = F.struct("place", "doc_id", "seq", "sim", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    held = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    items = F.col("items")

    def step(chosen: Column, _: Column) -> Column:
        def value(c: Column) -> Column:
            near = F.array_max(F.transform(chosen, lambda s: cosine(c["vec"], s["vec"])))
            gain = F.when(F.size(chosen) == 0, c["sim"]).otherwise(balance * c["sim"] - (1 - balance) * near)
            return F.struct(rounded(gain).alias("gain"), (-c["place"]).alias("order"), c.alias("item"))

        left = F.filter(items, lambda c: ~F.exists(chosen, lambda s: s["place"] == c["place"]))
        return F.concat(chosen, F.when(F.size(left) > 0, F.array(F.array_max(F.transform(left, value))["item"])).otherwise(F.slice(chosen, 1, 0)))

    picked = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.slice(items, 1, 0), step)
    rows = held.select("query_id", F.posexplode(picked).alias("rank", "item"))
    return rows.select("query_id", "item.doc_id", "item.seq", F.col("rank"))


def _of_ranked(ranked: DataFrame, kb: DataFrame, column: Column) -> DataFrame:
    """doc_id and a column of the documents that are ranked (a saved table). Up to SENT_IDS ids go to every task, so that of the
    knowledge base only the ranked documents are shuffled."""
    ids = ranked.select("doc_id").distinct()
    ids = F.broadcast(ids) if ranked.count() <= SENT_IDS else ids
    return kb.select("doc_id", column).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def _with_texts(ranked: DataFrame, kb: DataFrame) -> DataFrame:
    """Ranked rows with the texts of their documents: of the knowledge base only the ranked ones are read on."""
    ranked = saved(ranked, "ranked")
    return ranked.join(_of_ranked(ranked, kb, F.col("text")), "doc_id")


def fuse(dense: DataFrame, sparse: DataFrame, kb: DataFrame, k: int | None = TOP_K, texts: bool = True) -> DataFrame:
    """query_id, text (if texts), doc_id, score, first_seq, rank: reciprocal rank fusion by text.

    Of dense ranks of one text the last counts, and sparse ranks add up. The document that stands for a
    text is its last dense one, else its first sparse one; ties go by first appearance. Texts are the same if their SHA-256 is;
    only those of the result are shuffled."""
    ranked = saved(dense.select("query_id", "doc_id", "rank", F.lit(1).alias("dense")).unionByName(sparse.select("query_id", "doc_id", "rank", F.lit(0).alias("dense"))), "ranks")
    rows = ranked.join(_of_ranked(ranked, kb, F.unhex(F.sha2("text", 256)).alias("same")), "doc_id")
    is_dense = F.col("dense") == 1
    score = F.coalesce(rrf(F.max(F.when(is_dense, F.col("rank")))), F.lit(0.0)) + F.coalesce(_exact_sum(F.when(~is_dense, rrf(F.col("rank")))), F.lit(0.0))
    both = rows.groupBy("query_id", "same").agg(
        rounded(score).alias("score"),
        F.min(F.when(is_dense, F.col("rank")).otherwise(F.col("rank") + 1000)).alias("first_seq"),
        F.coalesce(F.max_by("doc_id", F.when(is_dense, F.col("rank"))), F.min_by("doc_id", F.when(~is_dense, F.col("rank")))).alias("doc_id"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first_seq")
    out = both.drop("same").withColumn("rank", F.row_number().over(w) - 1)
    out = out if k is None else out.where(F.col("rank") < k)
    return _with_texts(out, kb).select("query_id", "text", "doc_id", "score", "first_seq", "rank") if texts else out


def hybrid_search(queries: DataFrame, kb: DataFrame, k: int = TOP_K, sparse: bool = True, vectors: DataFrame | None = None, texts: bool = True) -> DataFrame:
    """The k best documents of each query; sparse=False is the fallback to the dense choice alone. vectors (part, seq, doc_id, vec), where
    they lie in a table of their own, so that texts are not joined with them."""
    dense = mmr(dense_candidates(queries, kb if vectors is None else vectors), k)
    if sparse:
        return fuse(dense, sparse_top(queries, kb), kb, k, texts)
    rows = _with_texts(dense, kb)
    return rows.select("query_id", "text", "doc_id", rrf(F.col("rank")).alias("score"), F.col("rank").alias("first_seq"), "rank")


def context(queries: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, rag_context: the texts found, in order, or the sentinel that says there are none."""
    parts = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), CONTEXT_SEPARATOR).alias("found"))
    return queries.select("query_id").join(parts, "query_id", "left").select("query_id", F.coalesce("found", F.lit(NO_CONTEXT)).alias("rag_context"))
