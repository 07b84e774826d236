"""Removal of long repeats: run-length indexes over content-defined segments of the corpus.

Each document is cut into overlapping segments by minimisers: a segment holds all 50-byte strings whose
least-hashed 20-byte substring is one and the same occurrence (its anchor). Equal strings have equal
anchors, so the occurrences of any 50-byte string meet in the bucket of their anchor's hash, whatever
the size of the corpus, and no segment is compared with those of other anchors.

0. Every map task writes its texts as chunks into the shared folder; a manifest of finished ones is the input of
   all that follows, so that nothing depends on the order of the documents' rows if a task is run again. It also
   says which anchors are common in a chunk. Segments of anchors that are common in all are cut into their
   50-byte strings, each of which is its own anchor: a very common one gathers nothing unlike in one task.
1. Every chunk sends, for each segment, hashes of its anchor and of its bytes, and its document. A reduce task
   tells which segments are copies of a segment of a smaller document (covered), which share their anchor with a
   different segment of a smaller document (queries), and which serve as sources: one for each distinct segment.
2. Every chunk sends the bytes of its queries and sources. A bucket builds a run-length index over its
   distinct sources and streams the matching statistics of its queries; a match of 50 bytes whose least
   owner is a smaller document covers them.
3. Every chunk joins what is covered and cuts its texts.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from roundsmith.llm import storage, textkit
from roundsmith.llm.rindex import RunLengthIndex, rolling
from roundsmith.llm.textkit import U64

SPAN, GRAM = 50, 20
WINDOW = SPAN - GRAM + 1
#: Text bytes of a reduce task of step 1, on average, and of a chunk.
BUCKET_BYTES, CHUNK_BYTES = 6 << 20, 6 << 20
#: Buckets to which a task deals segments; where more are needed, segments are dealt in two steps. Segments that
#: a task of the second step gathers before it deals them. Chunks (a power of two) that go through a task together.
FAN, DEAL_SEGMENTS, GROUP = 4096, 1_000_000, 4
#: Different segments of an anchor in a chunk from which it is counted; in all, from which it is common; and how
#: many anchors the list of common ones may hold (eight bytes each).
HOT_LOCAL, HOT_SEGMENTS, HOT_KEYS = 8, 20_000, 1 << 22
#: Bytes of segments that one index is built over.
PART_BYTES = 1 << 20
KEY_BITS, SEG_BITS = 48, 48
COVERED, QUERY, SOURCE = 1, 2, 4
NULL_ID = -(2**63)


def segments(data: np.ndarray, offsets: np.ndarray):
    """(row, start, end, anchor hash, bytes' hash) of the segments of each row of at least SPAN bytes."""
    n = len(data)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64))
    if n < SPAN:
        return none
    prefix = textkit.prefix_hash(data, textkit.RAW)
    inv = textkit.powers(n + 1)[1]
    grams = textkit.mix((prefix[GRAM:] - prefix[:-GRAM]) * inv[: n - GRAM + 1])
    bits = max(20, n.bit_length())
    low = U64((1 << bits) - 1)
    best = (grams & ~low) | np.arange(len(grams), dtype=U64)
    reach = 1
    while 2 * reach <= WINDOW:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if reach < WINDOW:
        best = np.minimum(best[: len(best) - (WINDOW - reach)], best[WINDOW - reach :])
    anchor = (best & low).astype(np.int64)  # of the string at each place
    size = np.diff(offsets)
    rows = np.flatnonzero(size >= SPAN)
    if not len(rows):
        return none
    at = rolling(offsets[rows], size[rows] - SPAN + 1)
    anchor = anchor[at]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
    last = np.append(new[1:], len(at)) - 1
    start, end = at[new], at[last] + SPAN
    # least hashes lie close to zero; hashed again they spread evenly over the buckets
    return np.searchsorted(offsets, start, "right") - 1, start, end, textkit.mix(~grams[anchor[new]]), textkit.span_hash(prefix, start, end)


class Chunk:
    """The texts of one map task in the shared folder."""

    def __init__(self, uri: str):
        self.uri = uri

    @staticmethod
    def tables(ids: list, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As read(), of texts in memory."""
        return np.array([NULL_ID if i is None else i for i in ids], np.int64), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64), np.frombuffer(b"".join(texts), np.uint8)

    def write(self, ids: list, texts: list[bytes]) -> None:
        z = zstandard.ZstdCompressor(level=1)
        head = np.array([NULL_ID if i is None else i for i in ids], "<i8").tobytes() + np.array([len(t) for t in texts], "<i8").tobytes()
        storage.put(self.uri, len(ids).to_bytes(8, "little") + head + z.compress(b"".join(texts)))

    def read(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document ids, offsets and bytes."""
        fs, path = storage.open_fs(self.uri)
        with fs.open_input_stream(path, compression=None) as f:
            raw = f.read()
        n = int.from_bytes(raw[:8], "little")
        ids, sizes = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n, 8 + 8 * n)
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[8 + 16 * n :]), np.uint8)
        return ids, np.concatenate([[0], np.cumsum(sizes)]), data


def _cut_common(data: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, seg: np.ndarray, common: np.ndarray):
    """Segments of common anchors as their 50-byte strings, each with its own hash as anchor."""
    hot = np.isin(key, common)
    if not hot.any():
        return row, start, end, key, seg
    n = end[hot] - start[hot] - SPAN + 1
    at, of = rolling(start[hot], n), np.repeat(row[hot], n)
    prefix = textkit.prefix_hash(data, textkit.RAW)
    h = textkit.span_hash(prefix, at, at + SPAN)
    cold = ~hot
    return (
        np.concatenate([row[cold], of]), np.concatenate([start[cold], at]), np.concatenate([end[cold], at + SPAN]),
        np.concatenate([key[cold], textkit.mix(~h) >> U64(64 - KEY_BITS)]), np.concatenate([seg[cold], h >> U64(64 - SEG_BITS)]),
    )


def _plan(ids: np.ndarray, offsets: np.ndarray, data: np.ndarray, buckets: int, common: np.ndarray = np.zeros(0, U64)):
    """The segments of a chunk in the order in which they are sent, their buckets, and which are sent.

    Of equal segments of one chunk only that of the least document is sent; the others are covered by
    it, unless they lie in a document with the same id."""
    got = []
    for i, j in textkit.slices(offsets):
        part = data[offsets[i] : offsets[j]]
        row, start, end, key, seg = segments(part, offsets[i : j + 1] - offsets[i])
        row, start, end, key, seg = _cut_common(part, row, start, end, key >> U64(64 - KEY_BITS), seg >> U64(64 - SEG_BITS), common)
        got.append((row + i, start + offsets[i], end + offsets[i], key, seg))
    row, start, end, key, seg = (np.concatenate(x) for x in zip(*got, strict=True)) if got else segments(data[:0], np.zeros(1, np.int64))
    doc = ids[row] if len(row) else np.zeros(0, np.int64)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    many = np.zeros(len(key), bool)
    many[1:] |= same
    many[:-1] |= same
    some = order[many]  # few share a key: only these are sorted by more
    order[many] = some[np.lexsort((start[some], doc[some], seg[some], key[some]))]
    row, start, end, key, seg, doc = (x[order] for x in (row, start, end, key, seg, doc))
    new = np.ones(len(row), bool)
    new[1:] = (key[1:] != key[:-1]) | (seg[1:] != seg[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    covered = doc[first] < doc
    return row, start, end, key, seg, doc, new, first, covered, _bucket(key, buckets)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """By the key's upper 32 bits: the product fits 64 bits for any number of buckets below 2^32."""
    return ((key >> U64(KEY_BITS - 32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _pack(z, *arrays: np.ndarray) -> bytes:
    return z.compress(b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays))


def _unpack(raw: bytes, n: int, *dtypes: str) -> list[np.ndarray]:
    flat, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8), [], 0
    for t in dtypes:
        w = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(flat[at : at + n * w].reshape(w, n).T).reshape(-1).view(t))
        at += n * w
    return out


MANIFEST = "grp long, chunk long, uri string, segments long, hot binary"
SEGMENTS = "bucket long, salt long, n long, segs binary, docs binary, chunks binary"
_SEGMENTS = pa.schema([("bucket", pa.int64()), ("salt", pa.int64()), ("n", pa.int64()), ("segs", pa.binary()), ("docs", pa.binary()), ("chunks", pa.binary())])


def _different(offsets: np.ndarray, data: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """How many different segments a chunk has, and how many of them the anchors with two and more have."""
    keys, segs = [np.zeros(0, U64)], [np.zeros(0, U64)]
    for i, j in textkit.slices(offsets):
        _, _, _, key, seg = segments(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        keys.append(key), segs.append(seg)
    key, seg = np.concatenate(keys) >> U64(64 - KEY_BITS), np.concatenate(segs)
    order = np.argsort(key)
    key, seg = key[order], seg[order]
    same = key[1:] == key[:-1]
    many = np.zeros(len(key), bool)
    many[1:] |= same
    many[:-1] |= same
    pairs = np.unique(np.stack([key[many], seg[many]], axis=1), axis=0) if many.any() else np.zeros((0, 2), U64)
    own, count = np.unique(pairs[:, 0], return_counts=True)
    return len(key) - int(many.sum()) + len(pairs), own[count > 1], count[count > 1]


def _write(folder: str, chunk_bytes: int, hot_local: int):
    """Step 0: the chunks of a task, under names of this attempt; what is listed of them is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            chunk = (part << 20) + k
            uri = f"{folder}/chunk-{chunk}-{uuid.uuid4().hex}"
            Chunk(uri).write(ids, texts)
            n, own, count = _different(*Chunk.tables(ids, texts)[1:])
            many = count >= hot_local
            hot = np.concatenate([own[many], count[many].astype(U64)]).tobytes()
            ids.clear(), texts.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((chunk // GROUP, pa.int64()), (chunk, pa.int64()), (uri, pa.string()), (n, pa.int64()), (hot or None, pa.binary()))], ["grp", "chunk", "uri", "segments", "hot"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i), texts.append(t or b"")
                held += len(texts[-1])
                if held >= chunk_bytes:
                    yield flush()
                    k, held = k + 1, 0
        if ids:
            yield flush()
        textkit.trim()

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            key, count = np.frombuffer(raw, U64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count.astype(np.int64))], ["key", "n"])


def _deal(bucket: np.ndarray, salt: int, key: np.ndarray, seg: np.ndarray, doc: np.ndarray, chunk: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Segments, sorted by bucket and within it by chunk and place, as one row for each bucket."""
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    z, rows = zstandard.ZstdCompressor(level=1), []
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(bucket)]):
        docs, at = np.unique(doc[i:j], return_inverse=True)
        chunks, of = np.unique(chunk[i:j], return_inverse=True)
        rows.append((int(bucket[i]), salt, j - i, _pack(z, np.diff(key[i:j], prepend=U64(0)), seg[i:j], at.astype(np.uint32), of.astype(np.uint32), np.diff(place[i:j], prepend=0).astype(np.uint32)), docs.tobytes(), chunks.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * 6, _SEGMENTS, strict=True)], schema=_SEGMENTS)


def _dealt(r: dict) -> tuple[np.ndarray, ...]:
    """Keys, segments, documents, chunks and places of a row."""
    key, seg, at, of, place = _unpack(r["segs"], r["n"], "<u8", "<u8", "<u4", "<u4", "<u4")
    return np.cumsum(key, dtype=U64), seg, np.frombuffer(r["docs"], np.int64)[at], np.frombuffer(r["chunks"], np.int64)[of], np.cumsum(place, dtype=np.uint32).astype(np.int64)


def _send(buckets: int, width: int, common):
    """Step 1, map: the segments of chunks, dealt to ranges of width buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, _, _, key, seg, doc, new, _, _, bucket = _plan(*Chunk(uri).read(), buckets, common.value)
                key = key[new]
                yield _deal(bucket[new] // width, chunk % width, key, seg[new], doc[new], np.full(len(key), chunk), np.arange(len(key)))
        textkit.trim()

    return run


def _deal_again(buckets: int, most: int):
    """Second step: the segments of each range to its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        n = 0

        def send() -> pa.RecordBatch:
            key, seg, doc, chunk, place = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = _bucket(key, buckets)
            order = np.lexsort((place, chunk, bucket))
            held.clear()
            return _deal(*(x[order] if isinstance(x, np.ndarray) else x for x in (bucket, 0, key, seg, doc, chunk, place)))

        for batch in batches:
            for r in batch.to_pylist():
                held.append(_dealt(r))
                n += r["n"]
                if n >= most:
                    yield send()
                    n = 0
        if held:
            yield send()
        textkit.trim()

    return run


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1, reduce: flags of segments that have one, by group of chunks."""
    parts = [_dealt(r) for batch in batches for r in batch.to_pylist()]
    if not parts:
        return
    key, seg, doc, chunk, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    many = ~new
    many[:-1] |= ~new[1:]
    order = order[many]
    order = order[np.lexsort((doc[order], seg[order], key[order]))]
    key, seg, doc, chunk, place = (x[order] for x in (key, seg, doc, chunk, place))
    if not len(key):
        return
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new_seg = new_key | np.concatenate([[True], seg[1:] != seg[:-1]])
    group, first = np.cumsum(new_key) - 1, np.maximum.accumulate(np.where(new_seg, np.arange(len(key)), 0))
    starts = np.flatnonzero(new_key)
    least, kinds = np.minimum.reduceat(doc, starts), np.add.reduceat(new_seg.astype(np.int64), starts)
    covered = doc[first] < doc
    query = ~covered & (least[group] < doc) & (kinds[group] > 1)
    asked = np.maximum.reduceat(np.where(query, doc, NULL_ID), starts)
    source = new_seg & (kinds[group] > 1) & (doc < asked[group])
    flags = (covered * COVERED + query * QUERY + source * SOURCE).astype(np.uint8)
    some = np.flatnonzero(flags)
    some = some[np.lexsort((place[some], chunk[some]))]
    chunk, place, flags, grp = chunk[some], place[some], flags[some], chunk[some] // GROUP
    at = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]])) if len(grp) else np.zeros(0, np.int64)
    z, rows = zstandard.ZstdCompressor(level=1), []
    for i, j in zip(at.tolist(), [*at[1:].tolist(), len(grp)]):
        rows.append({"grp": int(grp[i]), "n": j - i, "flags": _pack(z, np.diff(chunk[i:j], prepend=0), np.diff(place[i:j], prepend=0).astype(np.uint32), flags[i:j])})
        if len(rows) == 4096:
            yield pa.RecordBatch.from_pylist(rows, _FLAGS)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _FLAGS)
    textkit.trim()


FLAGS = "grp long, n long, flags binary"
_FLAGS = pa.schema([("grp", pa.int64()), ("n", pa.int64()), ("flags", pa.binary())])


def _ship(folder: str, buckets: int, common):
    """Step 2, map: what copies cover, into the shared folder; the bytes of queries and sources, on."""

    def run(chunks: pa.Table, t: pa.Table) -> pa.Table:
        where, places, kinds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
        for r in t.to_pylist():
            chunk, place, flag = _unpack(r["flags"], r["n"], "<i8", "<u4", "u1")
            where.append(np.cumsum(chunk)), places.append(np.cumsum(place, dtype=np.uint32).astype(np.int64)), kinds.append(flag)
        where, places, kinds = np.concatenate(where), np.concatenate(places), np.concatenate(kinds)
        out, z = [], zstandard.ZstdCompressor(level=1)
        for chunk, uri in zip(chunks["chunk"].to_pylist(), chunks["uri"].to_pylist(), strict=True):
            ids, offsets, data = Chunk(uri).read()
            row, start, end, key, seg, doc, new, first, covered, bucket = _plan(ids, offsets, data, buckets, common.value)
            sent = np.zeros(int(new.sum()), np.uint8)
            sent[places[where == chunk]] = kinds[where == chunk]
            flags = np.zeros(len(row), np.uint8)
            flags[new] = sent
            # rows with the id of a segment's least document share what was found for that document
            same = doc == doc[first]
            flags = np.where(covered, COVERED, np.where(same, flags[first] & ~np.uint8(SOURCE), 0)).astype(np.uint8) | (flags & SOURCE)
            hit = np.flatnonzero(flags & COVERED)
            storage.put(f"{folder}/covered-{chunk}", z.compress(np.stack([start[hit], end[hit]]).astype("<i8").tobytes()))
            pick = np.flatnonzero(flags & (QUERY | SOURCE))
            own = bucket[pick]
            edges = np.append(np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])), len(own)) if len(own) else np.zeros(1, np.int64)
            for i, j in zip(edges[:-1], edges[1:]):
                p = pick[i:j]
                raw = data[rolling(start[p], end[p] - start[p])].tobytes()
                out.append((int(own[i]), chunk, len(p), _pack(z, np.diff(key[p], prepend=U64(0)), start[p], end[p] - start[p], doc[p], flags[p]), z.compress(raw)))
        textkit.trim()
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.table({n: pa.array(c, y) for n, c, y in zip(("bucket", "chunk", "n", "meta", "bytes"), cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)})

    return run


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, reduce: the index of a bucket's sources, and its queries' matches."""
    meta, parts, raws = [], [], []
    for batch in batches:
        for r in batch.to_pylist():
            meta.append((r["chunk"], r["n"]))
            parts.append(_unpack(r["meta"], r["n"], "<u8", "<i8", "<i8", "<i8", "u1"))
            parts[-1][0] = np.cumsum(parts[-1][0], dtype=U64)
            raws.append(zstandard.ZstdDecompressor().decompress(r["bytes"]))
    if not meta:
        return
    key, start, size, doc, flags = (np.concatenate(x) for x in zip(*parts, strict=True))
    data = np.frombuffer(b"".join(raws), np.uint8)
    del parts, raws
    at = np.cumsum(size) - size
    chunk = np.repeat([m[0] for m in meta], [m[1] for m in meta])
    order = np.argsort(key, kind="stable")
    found_q, found_place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for own in _anchor_groups(key[order], size[order]):
        own = order[own]
        src, ask = own[(flags[own] & SOURCE) > 0], own[(flags[own] & QUERY) > 0]
        # a part holds whole anchors; of one with more sources than a part takes, each block of sources
        # has its own index, and all its queries are streamed against each
        for s in _blocks(src, size):
            if not len(ask):
                continue
            index = RunLengthIndex(data[rolling(at[s], size[s])], size[s], doc[s], SPAN)
            for q in _blocks(ask, size):
                for live, place, length, p in index.matching(data, at[q], size[q]):
                    ok = length >= SPAN
                    who, where = live[ok], place[ok]
                    good = index.least[p[ok]] < doc[q[who]]
                    found_q.append(q[who[good]]), found_place.append(where[good])
    q, place = np.concatenate(found_q), np.concatenate(found_place)
    begin, owner = start[q] + place, chunk[q]
    for c in np.unique(owner):
        b = begin[owner == c]
        yield pa.RecordBatch.from_pydict({"grp": pa.array([c // GROUP], pa.int64()), "chunk": pa.array([c], pa.int64()), "found": [np.unique(b).astype("<i8").tobytes()]})
    del data, key, start, size, doc, flags, found_q, found_place
    textkit.trim()


def _anchor_groups(key: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Places (of sorted keys) in parts of about PART_BYTES; places with one key stay together."""
    if not len(key):
        return
    total = np.cumsum(size)
    begin = 0
    while begin < len(key):
        end = int(np.searchsorted(total, total[begin] - size[begin] + PART_BYTES))
        end = int(np.searchsorted(key, key[min(end, len(key) - 1)], "right"))
        yield np.arange(begin, end)
        begin = end


def _blocks(rows: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in blocks of at most 2 * PART_BYTES, or one row."""
    part = (np.cumsum(size[rows]) - size[rows]) // (2 * PART_BYTES)
    for k in np.unique(part):
        yield rows[part == k]


def _cut(folder: str):
    """Step 3: the result for each document of a group of chunks."""

    def run(chunks: pa.Table, t: pa.Table) -> pa.Table:
        out, found = [], {}
        for r in t.to_pylist():
            found.setdefault(r["chunk"], []).append(np.frombuffer(r["found"], "<i8"))
        for chunk, uri in zip(chunks["chunk"].to_pylist(), chunks["uri"].to_pylist(), strict=True):
            ids, offsets, data = Chunk(uri).read()
            fs, path = storage.open_fs(f"{folder}/covered-{chunk}")
            with fs.open_input_stream(path, compression=None) as f:
                begin, end = np.frombuffer(zstandard.ZstdDecompressor().decompress(f.read()), "<i8").reshape(2, -1)
            more = np.concatenate([np.zeros(0, np.int64), *found.get(chunk, [])])
            step = np.zeros(len(data) + 1, np.int32)
            for sign, where in ((1, begin), (-1, end), (1, more), (-1, more + SPAN)):
                np.add.at(step, where, sign)
            gone = np.cumsum(step[:-1]) > 0
            for k in range(len(ids)):
                cut = gone[offsets[k] : offsets[k + 1]]
                text = data[offsets[k] : offsets[k + 1]]
                runs = int((cut[1:] & ~cut[:-1]).sum() + cut[:1].sum())
                out.append((None if ids[k] == NULL_ID else int(ids[k]), len(text), int(cut.sum()), runs, hashlib.sha256(text[~cut].tobytes()).hexdigest()))
        return pa.table({n: pa.array([o[i] for o in out], y) for i, (n, y) in enumerate((("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())))})

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for documents (doc_id, text).

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id.
    A null text is empty; a null doc_id counts as smaller than all others; rows with one doc_id are
    separate documents of which none is smaller; texts under 50 bytes stay whole; other columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    buckets = max(8, -(-storage.text_bytes(docs) // BUCKET_BYTES))
    width = 1 if buckets <= FAN else FAN
    buckets = -(-buckets // width) * width
    folder = storage.fresh(spark, "repeats")
    manifest = storage.saved(rows.mapInArrow(_write(folder, CHUNK_BYTES, HOT_LOCAL), MANIFEST), "manifest")
    chunks, groups, n_segments = manifest.agg(F.count("*"), F.count_distinct("grp"), F.coalesce(F.sum("segments"), F.lit(0))).first()
    # the common anchors are at most all segments over the least count of one
    counted = manifest.where("hot is not null").select("hot").mapInArrow(_counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    often = [r["key"] for r in counted.where(F.col("n") >= max(HOT_SEGMENTS, n_segments // HOT_KEYS)).select("key").collect()]
    common = spark.sparkContext.broadcast(np.sort(np.array(often, np.int64).view(U64)))
    sent = manifest.select("chunk", "uri").repartition(max(1, chunks), "chunk").mapInArrow(_send(buckets, width, common), SEGMENTS)
    if width > 1:
        sent = sent.repartition(buckets, "bucket", "salt").mapInArrow(_deal_again(buckets, DEAL_SEGMENTS), SEGMENTS)
    flags = storage.saved(sent.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(_judge, FLAGS), "flags")
    own = manifest.select("grp", "chunk", "uri").repartition(max(1, groups), "grp").groupBy("grp")
    together = lambda df: own.cogroup(df.repartition(max(1, groups), "grp").groupBy("grp"))
    shipped = together(flags).applyInArrow(_ship(folder, buckets, common), "bucket long, chunk long, n long, meta binary, bytes binary")
    found = storage.saved(shipped.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(_match, "grp long, chunk long, found binary"), "found")
    storage.drop(flags)
    return together(found).applyInArrow(_cut(folder), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after removal of the strings that smaller documents hold."""
    return remove_repeats(storage.table(spark, sf_dir, "documents"))
