"""Codes of vectors by trained codebooks, the nearest entry found by VA-file filtering.

Vectors of integers are cut into parts; each part position has a codebook of entries. To find a part's nearest entry,
entry coordinates are quantised into cells of a few bits. For each part, tables give the least and the greatest squared
difference to each cell of each coordinate; their sums bound the distance to every entry from both sides. Only entries
whose lower bound is not above the least upper bound are compared exactly, in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from roundsmith.llm import storage, textkit

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Bits of a cell; vectors that are held against the entries at once.
CELL_BITS, BATCH = 4, 256


class Codebook:
    """The entries of one part position (rows of integers), with their cells."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, cells = len(entries), 1 << CELL_BITS
        order = np.argsort(entries, axis=0, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(n)[:, None], 0)
        #: cell of each coordinate (row) of each entry: cells hold equally many entries
        self.cell = (rank * cells // n).T.astype(np.uint8)
        self.low = np.full((entries.shape[1], cells), np.iinfo(np.int64).max)
        self.high = np.full((entries.shape[1], cells), np.iinfo(np.int64).min)
        for k, cell in enumerate(self.cell):
            np.minimum.at(self.low[k], cell, entries[:, k])
            np.maximum.at(self.high[k], cell, entries[:, k])
        empty = self.low > self.high
        self.low[empty] = self.high[empty] = 0  # no entry looks there

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (entry, vector) of the squared distances of some vectors."""
        lower = np.zeros((len(self.entries), len(x)), np.int64)
        upper = np.zeros_like(lower)
        for cell, low, high, q in zip(self.cell, self.low[:, :, None], self.high[:, :, None], x.T, strict=True):
            below, above = low - q, q - high
            near = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(-below, -above)
            lower += (near * near)[cell]
            upper += (far * far)[cell]
        return lower, upper

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each vector; the lowest index among equals."""
        index, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for i in range(0, len(x), BATCH) if x.shape[1] else ():
            q = x[i : i + BATCH]
            lower, upper = self.bounds(q)
            row, entry = np.nonzero((lower <= upper.min(axis=0)).T)
            apart = q[row] - self.entries[entry]
            d = np.einsum("ij,ij->i", apart, apart)
            first = np.searchsorted(row, np.arange(len(q)))
            best = np.minimum.reduceat(d, first)
            hits = np.flatnonzero(d == best[row])
            index[i : i + BATCH] = entry[hits[np.searchsorted(hits, first)]]
            distance[i : i + BATCH] = best
        return index, distance


def _integers(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of floor(SCALE * x). Raises where squared distances might not fit 64 bits."""
    x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(x) and max(x.max(), -x.min()) > isqrt((1 << 62) // max(1, width)) // 2:
        raise OverflowError("components too large for 64-bit squared distances")
    return x.astype(np.int64).reshape(len(vectors), width)


def _coded(books: list[Codebook], x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each part position the entries and distances of the vectors' parts."""
    return [book.nearest(part) for book, part in zip(books, np.split(x, len(books), axis=1), strict=True)]


def _sums(entries: Broadcast):
    """For each part position, entry and place in it the sum over the parts of this task that it is nearest to, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(e) for e in entries.value]
        sums, counts = np.zeros_like(entries.value), np.zeros(entries.value.shape[:2], np.int64)
        for batch in batches:
            x = _integers(batch.column(0), entries.value.shape[0] * entries.value.shape[2])
            for k, (index, _) in enumerate(_coded(books, x)):
                np.add.at(sums[k], index, np.split(x, len(books), axis=1)[k])
                counts[k] += np.bincount(index, minlength=counts.shape[1])
        part, entry = np.nonzero(counts)
        width = sums.shape[2]
        columns = [np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part)), sums[part, entry].ravel(), np.repeat(counts[part, entry], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "entry", "at", "total", "n"])
        textkit.trim()

    return run


def _codes(entries: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(e) for e in entries.value]
        for batch in batches:
            coded = _coded(books, _integers(batch.column(1), entries.value.shape[0] * entries.value.shape[2]))
            digits = np.stack([index for index, _ in coded], axis=1).astype(np.uint8).tobytes().hex()
            step = 2 * len(books)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([digits[i : i + step] for i in range(0, len(digits), step)], pa.string()), pa.array(sum(d for _, d in coded))], ["vec_id", "label", "code", "error"])
        textkit.trim()

    return run


def train(vectors: DataFrame, width: int) -> np.ndarray | None:
    """Codebooks (part, entry, place) of vectors (vec_id, embedding) of one width: they start as the parts of the vectors
    with the smallest ids (of equal ids, the smaller vectors) and each round become the floor of the mean of what is nearest to them. None
    without vectors. All vectors are read in each round; what comes to the driver is one number for each number of the codebooks."""
    spark = vectors.sparkSession
    first = vectors.where("vec_id is not null").orderBy("vec_id", "embedding").limit(ENTRIES).select("embedding").toArrow()["embedding"]
    if not len(first):
        return None
    x = _integers(first.combine_chunks(), width)
    entries = x.reshape(len(x), PARTS, width // PARTS).transpose(1, 0, 2).copy()
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(entries)
        found = vectors.select("embedding").mapInArrow(_sums(shared), "part long, entry long, at long, total long, n long")
        found = found.groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
        entries = entries.copy()
        for r in found:
            entries[r["part"], r["entry"], r["at"]] = int(r["total"]) // r["n"]
        shared.unpersist()
    return entries


def compress(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, label for embeddings (vec_id, embedding, label).

    Rows whose vector is null or holds a null or non-finite component are dropped, the others all stay, repeated and
    missing ids among them (a vector without id never starts an entry). Vectors are integers floor(SCALE * x), cut into
    PARTS parts. code has two hex digits for each part's entry, error sums the squared distances, and label_error sums error over
    rows with the same label, missing ones being one label. Codebooks are made of vectors of the commonest length
    (of equally common ones the shortest); a vector of another length, or all if PARTS does not divide it,
    have neither code nor error. Fewer than ENTRIES vectors make smaller codebooks. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label"))
    rows = rows.where(F.col("embedding").isNotNull() & F.forall("embedding", finite))
    lengths = rows.groupBy(F.size("embedding").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").take(1)
    width = lengths[0]["k"] if lengths else 0
    fits = rows.where((F.size("embedding") == width) & F.lit(width % PARTS == 0 and width > 0))
    entries = train(fits, width) if width and width % PARTS == 0 else None
    kind = rows.schema["label"].dataType.simpleString()
    if entries is None:
        coded, sha = rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), None
    else:
        sha = hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()
        shared = spark.sparkContext.broadcast(entries)
        coded = fits.mapInArrow(_codes(shared), f"vec_id long, label {kind}, code string, error long")
        odd = rows.where(F.size("embedding") != width).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        coded = storage.saved(coded.union(odd) if len(lengths) and rows.where(F.size("embedding") != width).limit(1).count() else coded, "codes")
    # as a written table the sums have a known size: few labels are broadcast, and of many a hot one is split by AQE
    sums = storage.saved(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(sha).cast("string").alias("codebooks_sha256"), "label")


def op12_va_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its code and errors."""
    return compress(storage.table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """Rows of parts (vec, part, pos, x) against rows of entries, round by round."""
    steps = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "cells AS MATERIALIZED (SELECT vec_id, (i - 1) // (len(v) // 4) AS part, (i - 1) % (len(v) // 4) AS pos, v[i] AS x FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM kept))",
        "firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 256)",
        "book0 AS MATERIALIZED (SELECT part, entry, pos, x FROM cells JOIN firsts USING (vec_id))",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"d{k} AS (SELECT c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d FROM cells c JOIN book{k} b USING (part, pos) GROUP BY ALL)")
        steps.append(f"near{k} AS MATERIALIZED (SELECT vec_id, part, entry, d::BIGINT AS d FROM d{k} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)")
        if k < ROUNDS:
            steps.append(f"mean{k} AS (SELECT part, entry, pos, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM cells JOIN near{k} USING (vec_id, part) GROUP BY ALL)")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, CASE WHEN m.n IS NULL THEN b.x ELSE ((m.s - ((m.s % m.n) + m.n) % m.n) // m.n)::BIGINT END AS x FROM book{k} b LEFT JOIN mean{k} m USING (part, entry, pos))")
    steps.append(f"coded AS (SELECT vec_id, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id)")
    steps.append(f"sha AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book{ROUNDS})")
    return "WITH " + ", ".join(steps) + " SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256, label FROM coded JOIN kept USING (vec_id), sha"


ORACLE_SQL = _oracle()
