"""SimHash near-duplicates: pigeonhole blocks of fingerprints, joined and verified by Hamming distance.

Two fingerprints that differ in at most DISTANCE bits agree in all but DISTANCE of any blocks that the bits are cut
into. Each distinct fingerprint is keyed by every choice of all but DISTANCE blocks (its bits under a mask), so close
ones share a key. The number of blocks follows from that of the fingerprints: more blocks make more, but longer keys.
A key that more than GROUP fingerprints share is not compared: they differ in bits outside its mask alone, and these are
cut into DISTANCE + 1 blocks in turn, one of which close ones share. That goes on until every key has few; as
fingerprints are distinct, more than GROUP of them differ in more bits than DISTANCE, so every cut adds bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from roundsmith.llm import storage, textkit
from roundsmith.llm.components import components

SHINGLE_WORDS, SEED, BITS, DISTANCE = 3, 42, 64, 3
#: Fingerprints of a key that are compared with each other (at least 2 ** DISTANCE); keyed rows of a task; links that a task holds at once.
GROUP, TASK_ROWS, HELD_LINKS = 2048, 1_000_000, 2_000_000
#: Bytes of a text that are cut into words at once.
PART_BYTES = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: The bits of each byte value, lowest first, and where the counts of each byte of a hash start.
_BYTE_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
_LANES = np.arange(BITS // 8) * 256


def _parts(text: bytes) -> Iterator[bytes]:
    """Pieces of a text that end where white space begins."""
    at = 0
    while len(text) - at > PART_BYTES:
        end = SPACE.search(text, at + PART_BYTES)
        if end is None:
            break
        yield text[at : end.start()]
        at = end.start()
    yield text[at:]


def _ones(shingles, n: int) -> np.ndarray:
    """How many of the n shingles' hashes have each bit."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8", n)
    counts = np.bincount((h.view(np.uint8).reshape(-1, BITS // 8) + _LANES).ravel(), minlength=256 * BITS // 8)
    return (counts.reshape(-1, 256) @ _BYTE_BITS).ravel()


def fingerprint(text: bytes) -> int:
    """The unsigned fingerprint of a text in UTF-8: bit i is 1 if more than half of the hashes of its shingles, repeats
    included, have it. Words are runs without ASCII white space, A-Z as a-z; of a text with fewer words than a shingle
    the whole sequence is one; a text without words has 0."""
    ones, n, words = np.zeros(BITS, np.int64), 0, []
    for part in _parts(text.lower()):
        words = words[1 - SHINGLE_WORDS :] + part.split()
        new = len(words) - SHINGLE_WORDS + 1
        if new > 0:
            ones += _ones(map(b" ".join, zip(*(words[k:] for k in range(SHINGLE_WORDS)))), new)
            n += new
    if not n and words:
        ones, n = _ones([b" ".join(words)], 1), 1
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(x.as_py() or b"") for x in batch.column(1).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])
    textkit.trim()


def _cut(free: list[int], n: int) -> list[int]:
    """Masks of n blocks of nearly equal size that cover the bits in free."""
    ends = [len(free) * k // n for k in range(n + 1)]
    return [sum(1 << i for i in free[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def first_masks(n: int) -> list[int]:
    """Masks that n fingerprints are keyed by first; any two within DISTANCE agree under one of them at least. The
    cost of a number of blocks is that of the keyed rows and of the pairs that share a key by chance."""

    def cost(blocks: int) -> float:
        kept = BITS - sum(sorted((m.bit_count() for m in _cut([*range(BITS)], blocks)), reverse=True)[:DISTANCE])
        return comb(blocks, DISTANCE) * n * (1 + n / 2 ** (kept + 1))

    blocks = _cut([*range(BITS)], min(range(DISTANCE + 1, 11), key=cost))
    return [sum(c) for c in combinations(blocks, len(blocks) - DISTANCE)]


def finer_masks(mask: int) -> list[int]:
    """Masks with more bits; any two within DISTANCE that agree under mask agree under one of these."""
    return [mask | block for block in _cut([i for i in range(BITS) if not mask >> i & 1], DISTANCE + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links a-b connect, each node to the smallest of its component: one for each node."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(node))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low), np.minimum.at(new, y, low)
        np.minimum.at(new, root[x], low), np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    far = root != np.arange(len(node))
    return node[far], node[root[far]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (mask, key, fp) with all rows of a key in this task: links that connect the fingerprints of a key
    that are within DISTANCE of each other, directly or through others of the key."""
    rows = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches if batch.num_rows]
    if not rows:
        return
    mask, key, fp = np.concatenate(rows, axis=1)
    del rows
    order = np.lexsort((key, mask))
    mask, key, fp = mask[order], key[order], fp[order]
    new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
    size = np.diff(np.append(np.flatnonzero(new), len(fp)))
    left = np.repeat(np.cumsum(size), size) - np.arange(len(fp)) - 1  # later members of the own group
    bits = fp.view(np.uint64)  # a negative number's bits would be counted of its absolute value
    del mask, key, order, new
    found, held, here, step = [], 0, np.flatnonzero(left > 0), 1
    while len(here):
        near = here[np.bitwise_count(bits[here] ^ bits[here + step]) <= DISTANCE]
        found.append((fp[near], fp[near + step]))
        held += len(near)
        if held >= HELD_LINKS:
            found = [_forest(*(np.concatenate(x) for x in zip(*found, strict=True)))]
            held = len(found[0][0])
        step += 1
        here = here[left[here] >= step]
    if held:
        a, b = _forest(*(np.concatenate(x) for x in zip(*found, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
    textkit.trim()


def close_links(distinct: DataFrame) -> tuple[DataFrame | None, list[DataFrame]]:
    """distinct(fp: long), saved, no value twice -> links (a, b) that connect what pairs within DISTANCE connect (none:
    no rows, or None), and the saved tables that it reads."""
    spark, n = distinct.sparkSession, distinct.count()
    masks = F.array(*(F.lit(_signed(m)) for m in first_masks(n)))
    rows, links, kept = distinct.withColumn("mask", F.explode(masks)), None, []
    while n:
        rows = rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        hot = storage.saved(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("mask", "key"), "hot-keys")
        often = [r["mask"] for r in hot.select("mask").distinct().collect()]  # one of the masks of this step each
        few = rows.join(hot, ["mask", "key"], "left_anti") if often else rows
        tasks = max(1, -(-rows.count() // TASK_ROWS))
        own = storage.saved(few.repartition(tasks, "mask", "key").mapInArrow(_links, "a long, b long"), "close")
        kept.append(own)
        links = own if links is None else links.union(own)
        if not often:
            storage.drop(hot)
            return links.distinct(), kept
        finer = spark.createDataFrame([(m, [_signed(f) for f in finer_masks(m % (1 << BITS))]) for m in often], "mask long, finer array<long>")
        more = rows.join(hot, ["mask", "key"], "left_semi").join(F.broadcast(finer), "mask")
        rows = storage.saved(more.select("fp", F.explode("finer").alias("mask")).distinct(), "finer")
        storage.drop(hot)
        kept.append(rows)
    return None, kept


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for documents (doc_id, text); more columns are ignored.

    fingerprint is that of the whole text in 16 lower-case hex digits; a null, empty or blank text has zero, and links
    like any other. Documents link if their fingerprints differ in at most DISTANCE bits; component_id is the smallest
    doc_id that links reach. Rows that repeat a doc_id are separate documents; one without doc_id links as well,
    and a component without any doc_id has none. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fps = storage.saved(docs.mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    least = storage.saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    links, kept = close_links(least.select("fp"))
    of = least.select("fp", F.col("least").alias("component_id"))
    if links is not None:
        comps = components(links)
        of_node = least.select(F.col("fp").alias("node"), "least")
        ids = comps.join(of_node, "node").groupBy("comp").agg(F.min("least").alias("component_id"))
        linked = comps.join(ids, "comp").select(F.col("node").alias("fp"), "component_id")
        of = storage.saved(of.join(linked.select("fp"), "fp", "left_anti").union(linked), "of")
        storage.drop(*kept, comps, least)
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    return simhash_components(storage.table(spark, sf_dir, "documents"))
