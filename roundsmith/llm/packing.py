"""First-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

A document's ids beyond whole sequences go through first-fit decreasing: items in falling order of
length, each into the first sequence that has room, found in O(log n) in a tournament tree whose inner
nodes hold the largest room below them. Because documents may be cut freely, the emptiest sequences
are then poured into the gaps of the others. What a group has left, less than a sequence, is packed with
that of other groups; the last of it is cut at powers of two, so that no padding is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from roundsmith.llm import storage, textkit, tokens

SEQUENCE = 4096
#: Text bytes of a group, on average: about 0.4 million ids, whatever the size of the corpus.
GROUP_BYTES = 1_000_000
#: Groups whose rests are packed together.
REST = 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class TournamentTree:
    """The first bin, by number, with room for an item."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        room, k = self.room, 1
        while k < self.leaves:
            k *= 2
            if room[k] < size:
                k += 1
        room[k] -= size
        found = k - self.leaves
        while k > 1:
            k //= 2
            room[k] = max(room[2 * k], room[2 * k + 1])
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items (by index) of each bin; ties go by index. No size may exceed capacity."""
    if not sizes:
        return []
    tree, bins = TournamentTree(len(sizes), capacity), [[] for _ in sizes]
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        bins[tree.place(sizes[i])].append(i)
    return [b for b in bins if b]


def _filled(lengths: list[int], capacity: int) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Whole sequences of pieces (document, start, length), and the pieces that are left, less than a sequence."""
    full, rest = [], []
    for d, n in enumerate(lengths):
        whole = n // capacity
        full += [[(d, k * capacity, capacity)] for k in range(whole)]
        if n % capacity or not n:
            rest.append((d, whole * capacity, n % capacity))
    bins = [[rest[i] for i in b] for b in first_fit_decreasing([r[2] for r in rest], capacity)]
    used = lambda b: sum(p[2] for p in b)
    bins.sort(key=used, reverse=True)
    keep = sum(map(used, bins)) // capacity
    kept, pool = bins[:keep], [p for b in bins[keep:] for p in b]
    for b in kept:
        b += _pour(pool, capacity - used(b))
    return full + kept, pool


def _pour(pool: list[tuple[int, int, int]], room: int) -> list[tuple[int, int, int]]:
    """Pieces from the end of the pool that fill a room; the last one is cut."""
    got = []
    while room and pool:
        d, start, n = pool.pop()
        cut = min(n, room)
        got.append((d, start, cut))
        room -= cut
        if n > cut:
            pool.append((d, start + cut, n - cut))
    return got


def _numbered(sequences: list[list[tuple[int, int, int]]]) -> list[tuple[int, int, int, int, int]]:
    out = []
    for s, seq in enumerate(sequences):
        at = 0
        for d, start, n in seq:
            out.append((d, start, n, s, at))
            at += n
    return out


def pack(lengths: list[int], capacity: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; documents and sequences from 0.

    capacity is a power of two. An empty document gets one piece of length 0 at the end of a sequence.
    """
    sequences, pool = _filled(lengths, capacity)
    left = sum(p[2] for p in pool)
    while left:
        size = 1 << (left.bit_length() - 1)
        sequences.append(_pour(pool, size))
        left -= size
    if pool:  # empty documents
        sequences[-1:] = [sequences[-1] + pool] if sequences else [pool]
    return _numbered(sequences)


def pack_documents(docs: DataFrame, end_id: int = 2, tokenizer: str | None = None, capacity: int = SEQUENCE, group_bytes: int = GROUP_BYTES, seed: int = 7) -> DataFrame:
    """Packs documents (doc_id, text); one row for each piece, as in SCHEMA.

    A document's ids are those of its text (null: empty) and end_id. Documents go to groups by a hash of
    doc_id, text, the task that reads them and how often it has met the same before; so a group's ids are
    bounded by group_bytes and its longest document, also where one row repeats very often, and a task that
    runs again deals its rows alike whatever their order. Rows that repeat a doc_id are packed each by itself.
    Groups make whole sequences; what REST groups have left is packed together, and the last of it is cut at
    powers of two. sequence_id is the group's number times 2^32 plus the sequence's number in the group; the
    numbers of packed rests follow those of groups. Other columns are ignored; an empty table gives no rows.
    """
    path = tokenizer or tokens.default_path()
    groups = 1 + storage.text_bytes(docs) // group_bytes

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part, met = tokens.word_tokenizer(path), TaskContext.get().partitionId(), {}
        end = np.array([end_id], coder.dtype).tobytes()
        for batch in batches:
            texts, group = [t or b"" for t in batch.column(1).to_pylist()], []
            ids = [x + end for x in coder.all_ids(texts)]
            for doc_id, raw in zip(batch.column(0).to_pylist(), texts, strict=True):
                key = xxhash.xxh3_64_intdigest(raw, seed=seed) ^ xxhash.xxh3_64_intdigest(str(doc_id))
                met[key] = met.get(key, -1) + 1
                group.append(xxhash.xxh3_64_intdigest(f"{key} {part} {met[key]}") % groups)
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), batch.column(0), pa.array(ids, pa.binary())], ["grp", "doc_id", "ids"])
        textkit.trim()

    def table(pieces: list[tuple], docs: list, ids: list, starts: list, totals: list, base: int, rest: list) -> pa.Table:
        """Rows of placed pieces, and of those left, which keep their ids."""
        spans = [(p[0], p[1], p[2]) for p in pieces] + rest
        cut = [ids[d][s : s + n] for d, s, n in spans]
        cols = [
            [docs[d] for d, _, _ in spans], [starts[d] + s for d, s, _ in spans], [n for _, _, n in spans], [zlib.crc32(x.astype("<u4").tobytes()) for x in cut], [totals[d] for d, _, _ in spans],
            [base + p[3] for p in pieces] + [None] * len(rest), [p[4] for p in pieces] + [None] * len(rest),
        ]
        return pa.table([*(pa.array(c, pa.int64()) for c in cols), pa.array([None] * len(pieces) + [x.tobytes() for x in cut[len(pieces) :]], pa.binary())], [c.split()[0] for c in f"{SCHEMA}, ids binary".split(", ")])

    def place(t: pa.Table) -> pa.Table:
        width = tokens.word_tokenizer(path).dtype
        rows = sorted(zip(t["doc_id"].to_pylist(), t["ids"].to_pylist(), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        ids = [np.frombuffer(r[1], width) for r in rows]
        sequences, pool = _filled([len(x) for x in ids], capacity)
        return table(_numbered(sequences), [r[0] for r in rows], ids, [0] * len(rows), [len(x) for x in ids], t["grp"][0].as_py() << 32, pool).append_column("grp", t["grp"][:1].take(pa.array([0] * (sum(map(len, sequences)) + len(pool)))))

    def place_rest(t: pa.Table) -> pa.Table:
        width = tokens.word_tokenizer(path).dtype
        rows = sorted(t.select(["doc_id", "start", "doc_tokens", "ids"]).to_pylist(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["ids"]))
        ids = [np.frombuffer(r["ids"], width) for r in rows]
        return table(pack([len(x) for x in ids], capacity), [r["doc_id"] for r in rows], ids, [r["start"] for r in rows], [r["doc_tokens"] for r in rows], (groups + t["part"][0].as_py()) << 32, []).drop_columns(["ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    placed = storage.saved(rows.mapInArrow(encode, "grp long, doc_id long, ids binary").groupBy("grp").applyInArrow(place, f"{SCHEMA}, ids binary, grp long"), "packed")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rest = placed.where("sequence_id is null").select((F.col("grp") / REST).cast("long").alias("part"), "doc_id", "start", "doc_tokens", "ids")
    return placed.where("sequence_id is not null").select(names).union(rest.groupBy("part").applyInArrow(place_rest, SCHEMA))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids."""
    return pack_documents(storage.table(spark, sf_dir, "documents"))
