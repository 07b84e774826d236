"""N-gram Jaccard self-join by universe partitioning and the pigeonhole principle.

Sets whose Jaccard similarity is at least 3/4 differ in at most H = floor((x + y) / 7) shingles, x and y
their sizes. A size band has m segments; a shingle's hash says to which one it belongs. For each band a
cost model gives D segments an allowance of one (their keys are the segment and its one-deletion
neighbourhood), the chosen H + 1 - 2D of the others an allowance of zero (their key is the segment), and
the rest are skipped. If two sets agree up to one shingle in none of the D, these hold 2D differences,
so at most H - 2D of the other segments differ; as both sets choose segments by one order on their
contents, the first that they share is among the H + 1 - 2D that each chose. So no pair is lost.

Sets that share a key form a group. Each group's members are first checked against the one of them that
shares most keys. Of groups that this leaves in several components, the outsiders (members not in the
largest component) are then held against that component and the other outsiders of it, in blocks of
bounded size. Exact bounds from sizes and parity sketches come before texts are read; every link is
verified on the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from roundsmith.llm import storage, textkit
from roundsmith.llm.components import components
from roundsmith.llm.textkit import U64

SHINGLE_WORDS = 5
#: Bits of a parity sketch for each shingle, and the most. The bits that differ in two sketches are at most
#: the shingles that differ in the sets; half a sketch is the exclusive or of its halves.
SKETCH_BITS, SKETCH_MOST = 4, 1 << 17
#: Keys of a reduce task, on average; keys gathered by a task before it sends them.
BUCKET_KEYS, FLUSH_KEYS = 1_000_000, 500_000
#: Buckets to which a task deals keys; where more are needed, keys are dealt in two steps.
FAN = 4096
#: Sets of a key in one sending from which it is counted; sets in all from which a key is common and goes by
#: rows instead of by bucket; and how many keys the list of common ones may hold (eight bytes each).
HOT_LOCAL, HOT_SETS, HOT_KEYS = 50, 200_000, 1 << 22
#: Chance, for the cost model alone, that another set of the band holds a given shingle.
RECURRENCE = 1 / 64
#: Members of a block when the pairs of a group are compared: at least BLOCK, of larger groups a COPIES-th, and
#: never more than BLOCK_BYTES of sketches; texts shipped to one verifying task.
BLOCK, COPIES, BLOCK_BYTES, BATCH = 512, 64, 32 << 20, 256
#: Tasks to which the sets of one group go before they are cut into blocks.
SALTS = 64


@lru_cache(8)
def bands(top: int) -> np.ndarray:
    """Lower ends of the size bands: partners of a set lie in its band or a neighbouring one."""
    at = [1, 2]
    while at[-1] <= top:
        at.append(max(4 * (at[-1] - 1) // 3 + 1, at[-1] + 1))
    return np.array([*at, max(4 * (at[-1] - 1) // 3 + 1, at[-1] + 1)])


@lru_cache(4096)
def allocation(most: int, size: int, n_sets: int) -> tuple[int, int]:
    """(D, m) for a band of sets of about this size that differ in at most most shingles.

    The cost of a choice is its number of keys plus the sets expected to share them by chance.
    """
    best = None
    for d in range(0, min((most + 1) // 2, 8) + 1):
        exact = max(0, most + 1 - 2 * d)
        m = d + (exact + (exact * 3 + 19) // 20 if exact else 0)
        w = size / m
        keys = exact + d * (1 + w)
        cost = keys + n_sets * (exact * RECURRENCE**w + d * (1 + w) * RECURRENCE ** max(0.0, w - 1))
        if best is None or cost < best[0]:
            best = (cost, d, m)
    return best[1], best[2]


def keys_of(h: np.ndarray, at: np.ndarray, n_sets: int) -> np.ndarray:
    """The keys of a set (sorted distinct hashes), in its own band's slot and in that below."""
    n = len(h)
    b = int(np.searchsorted(at, n, "right")) - 1
    sums = np.zeros(n + 1, U64)
    mixed = textkit.mix(h)
    np.cumsum(mixed, dtype=U64, out=sums[1:])
    out = []
    for slot in (b, b - 1):
        if slot < 0:
            continue
        top = int(at[slot + 1]) - 1  # the largest smaller partner of the slot
        if slot == b:
            own = (n + 4 * n // 3) // 7
        elif 4 * top < 3 * n:
            continue
        else:
            own = (n + top) // 7
        d, m = allocation((top + 4 * top // 3) // 7, max(1, top), n_sets)
        edges = np.searchsorted((h >> U64(32)) * U64(m) >> U64(32), np.arange(m + 1, dtype=U64))
        count = np.diff(edges)
        salt = textkit.mix(np.arange(m, dtype=U64) + U64(slot << 32))
        content = sums[edges[1:]] - sums[edges[:-1]]
        exact = own + 1 - 2 * d
        if exact > 0:
            key = textkit.mix(content[d:] + salt[d:])
            order = np.lexsort((key, -count[d:]))[:exact]
            out.append(key[order])
        for k in range(d):
            part = mixed[edges[k] : edges[k + 1]]
            out.append(textkit.mix(np.append(content[k] - part, content[k]) + salt[k] + U64(1 << 63)))
    return np.concatenate(out)


def _profile(col: pa.Array):
    """For each text: number of shingles, fingerprint of the set, sketch; in slices."""
    for _, _, data, offs in textkit.pieces(col):
        for h in textkit.shingle_sets(data, offs, SHINGLE_WORDS):
            yield h, fingerprint(h)


def fingerprint(h: np.ndarray) -> int:
    """A signed 64-bit fingerprint of a set; sets count as equal if theirs are."""
    x = textkit.mix(np.array([textkit.mix(h ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64) + U64(len(h))], U64))
    return int(x.view(np.int64)[0])


def sketch(h: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of a power of two of places."""
    bits = 64
    while bits < SKETCH_BITS * len(h) and bits < SKETCH_MOST:
        bits *= 2
    odd = np.bincount((h & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(x: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) at a smaller width."""
    while x.shape[1] > width:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def _words(sketches: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), U64).reshape(-1, width)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [(len(h), f, sketch(h)) for h, f in _profile(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] if g[0] else None for g in got], pa.int64()), pa.array([g[2] for g in got], pa.binary()), batch.column(2)], ["doc_id", "n", "fp", "sk", "th"])


def _planes(x: np.ndarray, z: zstandard.ZstdCompressor) -> bytes:
    return z.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _unplanes(raw: bytes, dtype: str, n: int) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(-1, n).T).reshape(-1).view(dtype)


BLOB = "bucket long, salt long, n long, m long, keys binary, ents binary, at binary, hot binary"
_BLOB = pa.schema([("bucket", pa.int64()), ("salt", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("keys", pa.binary()), ("ents", pa.binary()), ("at", pa.binary()), ("hot", pa.binary())])


class Dealer:
    """Sends sorted keys by ranges. The space of bits-bit keys is cut into steps * buckets fine ranges; a bucket
    of the first step covers buckets of them. hot_local: sets of a key in one sending from which it is counted."""

    def __init__(self, bits: int, steps: int, buckets: int, hot_local: int):
        self.bits, self.steps, self.buckets, self.hot_local = bits, steps, buckets, hot_local

    def edges(self, low: int, high: int, step: int) -> np.ndarray:
        """Least keys of the fine ranges low, low + step, ..., and the end of the last."""
        n = self.steps * self.buckets
        return np.array([-(-(k << self.bits) // n) for k in range(low, high + 1, step)], object).astype(U64)

    def send(self, key: np.ndarray, ent: np.ndarray, low: int, high: int, step: int, salt: int, hot: bool) -> pa.RecordBatch:
        """Blobs of the ranges low to high, step fine ranges each. hot: with counts of the keys that are common here."""
        order = np.argsort(key, kind="stable")
        key, ent = key[order], ent[order]
        at = np.searchsorted(key, self.edges(low, high, step))
        z, rows = zstandard.ZstdCompressor(level=1), []
        for k in np.flatnonzero(np.diff(at)).tolist():
            i, j = at[k], at[k + 1]
            table, where = np.unique(ent[i:j], return_inverse=True)
            often = b""
            if hot:
                first = np.flatnonzero(np.concatenate([[True], key[i + 1 : j] != key[i : j - 1]]))
                count = np.diff(np.append(first, j - i))
                many = count >= self.hot_local
                often = np.concatenate([key[i + first[many]], count[many].astype(U64)]).tobytes()
            rows.append((low // step + k, salt, j - i, len(table), _planes(np.diff(key[i:j], prepend=U64(0)), z), table.tobytes(), _planes(where.astype(np.uint32), z), often or None))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BLOB, strict=True)], schema=_BLOB)


def _blob(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """Keys and sets of a blob."""
    return np.cumsum(_unplanes(r["keys"], "<u8", r["n"]), dtype=U64), np.frombuffer(r["ents"], np.int64)[_unplanes(r["at"], "<u4", r["n"])]


def _key_blobs(top: int, n_sets: int, deal: Dealer, salts: int):
    """The keys of all sets; by fine ranges if there is but one step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, keys, fps, counts, held, turn = bands(top), [], [], [], 0, TaskContext.get().partitionId()
        seen: set[int] = set()
        step = 1 if deal.steps == 1 else deal.buckets

        def send() -> pa.RecordBatch:
            key, ent = np.concatenate(keys) >> U64(64 - deal.bits), np.repeat(np.array(fps, np.int64), counts)
            keys.clear(), fps.clear(), counts.clear(), seen.clear()
            return deal.send(key, ent, 0, deal.steps * deal.buckets, step, turn % salts, step == 1)

        for batch in batches:
            for h, f in _profile(batch.column(0)):
                if not len(h) or f in seen:
                    continue
                seen.add(f)
                own = keys_of(h, at, n_sets)
                keys.append(own), fps.append(f), counts.append(len(own))
                held += len(own)
                if held >= FLUSH_KEYS:
                    yield send()
                    held, turn = 0, turn + 1
        if held:
            yield send()
        textkit.trim()

    return run


def _deal_again(deal: Dealer):
    """Second step: the keys of each range of the first to fine ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        n = 0

        def send() -> Iterator[pa.RecordBatch]:
            for bucket, own in sorted(held.items()):
                key, ent = (np.concatenate(x) for x in zip(*own, strict=True))
                yield deal.send(key, ent, bucket * deal.buckets, (bucket + 1) * deal.buckets, 1, 0, True)
            held.clear()

        for batch in batches:
            for r in batch.to_pylist():
                held.setdefault(r["bucket"], []).append(_blob(r))
                n += r["n"]
                if n >= 2 * FLUSH_KEYS:
                    yield from send()
                    n = 0
        yield from send()
        textkit.trim()

    return run


def _common_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            key, count = np.frombuffer(raw, U64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count.astype(np.int64))], ["key", "n"])


def _rare(common):
    """Blobs without the common keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                key, ent = _blob(r)
                left = common.value[np.minimum(np.searchsorted(common.value, key), len(common.value) - 1)] != key
                if not left.any():
                    continue
                if not left.all():
                    z = zstandard.ZstdCompressor(level=1)
                    table, where = np.unique(ent[left], return_inverse=True)
                    r |= {"n": int(left.sum()), "m": len(table), "keys": _planes(np.diff(key[left], prepend=U64(0)), z), "ents": table.tobytes(), "at": _planes(where.astype(np.uint32), z)}
                rows.append(r)
            yield pa.RecordBatch.from_pylist(rows, _BLOB)

    return run


def _common(common):
    """The sets of the common keys, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                key, ent = _blob(r)
                own = common.value[np.minimum(np.searchsorted(common.value, key), len(common.value) - 1)] == key
                yield pa.RecordBatch.from_arrays([pa.array(key[own].view(np.int64)), pa.array(ent[own])], ["gid", "ent"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of two and more sets with a common key; groups with the same members once for each task."""
    keys, ents = [], []
    for batch in batches:
        for r in batch.to_pylist():
            key, ent = _blob(r)
            keys.append(key), ents.append(ent)
    if not keys:
        return
    key, ent = np.concatenate(keys), np.concatenate(ents)
    del keys, ents
    order = np.argsort(key, kind="stable")
    key, ent = key[order], ent[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    shared = ~new
    shared[:-1] |= ~new[1:]
    key, ent = key[shared], ent[shared]
    order = np.lexsort((ent, key))
    key, ent = key[order], ent[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (ent[1:] != ent[:-1])
    key, ent = key[keep], ent[keep]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    first, size = first[size > 1], size[size > 1]
    sums = np.zeros(len(ent) + 1, U64)
    np.cumsum(textkit.mix(ent.view(U64)), dtype=U64, out=sums[1:])
    gid = textkit.mix(sums[first + size] - sums[first] + size.astype(U64)).view(np.int64)
    # a group's center is the member that shares most keys with others, as far as this task knows
    table, at = np.unique(ent, return_inverse=True)
    grouped = np.zeros(len(ent) + 1, np.int64)
    np.add.at(grouped, first, size)
    np.add.at(grouped, first + size, -size)
    weight = np.bincount(at, weights=np.cumsum(grouped[:-1]), minlength=len(table))[at]
    _, once = np.unique(gid, return_index=True)
    rows = []
    for g in once:
        i, n = first[g], size[g]
        center = int(ent[i + int(weight[i : i + n].argmax())])
        for k in range(i, i + n, 1024):
            rows.append((int(gid[g]), int(n), center, ent[k : min(k + 1024, i + n)]))
            if len(rows) == 4096:
                yield _group_rows(rows)
                rows = []
    if rows:
        yield _group_rows(rows)
    del key, ent, order, sums, rows
    textkit.trim()


def _group_rows(rows: list) -> pa.RecordBatch:
    members = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])]).astype(np.int32), pa.array(np.concatenate([r[3] for r in rows])))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), members], ["gid", "size", "center", "members"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that sizes and sketches allow."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ska, skb = batch.column("ska").to_pylist(), batch.column("skb").to_pylist()
        n, m = (batch.column(k).to_numpy().astype(np.int64) for k in ("na", "nb"))
        ok = 4 * np.minimum(n, m) >= 3 * np.maximum(n, m)
        wa, wb = (np.array([len(x) // 8 for x in sk]) for sk in (ska, skb))
        for x, y in set(zip(wa[ok].tolist(), wb[ok].tolist(), strict=True)):
            at = np.flatnonzero(ok & (wa == x) & (wb == y))
            w = min(x, y)
            differ = np.bitwise_count(_folded(_words([ska[k] for k in at], x), w) ^ _folded(_words([skb[k] for k in at], y), w)).sum(axis=1, dtype=np.int64)
            ok[at] = differ <= (n[at] + m[at]) // 7
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], ["a", "b"])


def _cross(t: pa.Table) -> pa.Table:
    """Pairs of an outsider and another set, in different components, that sizes and sketches allow."""
    ent, comp, n, side = (t[k].to_numpy() for k in ("ent", "comp", "n", "side"))
    raw = t["sk"].to_pylist()
    width = np.array([len(x) // 8 for x in raw], np.int64)
    here = np.flatnonzero(side == 0)
    # for each width the sets of at least that width, at it
    level = {}
    for w in np.unique(width).tolist():
        at = here[width[here] >= w]
        if len(at):
            level[w] = at, np.concatenate([_folded(_words([raw[k] for k in at[width[at] == v]], v), w) for v in np.unique(width[at]).tolist()])[np.argsort(np.argsort(width[at], kind="stable"), kind="stable")]
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero(side == 1):
        own = _words([raw[i]], int(width[i]))
        for w, (at, rows) in level.items():
            if w > width[i]:
                continue
            pick = comp[at] != comp[i]
            pick &= width[at] >= width[i] if w == width[i] else width[at] == w
            pick &= 4 * np.minimum(n[i], n[at]) >= 3 * np.maximum(n[i], n[at])
            k = np.flatnonzero(pick)
            k = k[np.bitwise_count(rows[k] ^ _folded(own, w)).sum(axis=1, dtype=np.int64) <= (n[at[k]] + n[i]) // 7]
            out_a.append(np.minimum(ent[i], ent[at[k]])), out_b.append(np.maximum(ent[i], ent[at[k]]))
    return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _verify(t: pa.Table) -> pa.Table:
    """Links among the texts of one batch: exact counts of common shingles."""
    ents, partners = t["ent"].to_pylist(), t["partners"].to_pylist()
    sets = {}
    for e, (h, _) in zip(ents, _profile(t["text"].combine_chunks()), strict=True):
        sets[e] = h
    out = []
    for b, own in zip(ents, partners, strict=True):
        y = sets[b]
        for a in own:
            x = sets[a]
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            if 100 * both >= 75 * (len(x) + len(y) - both):
                out.append((a, b))
    return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of fingerprints that link. A set's partners are spread over batches by its hash,
    so that the text of a set with many partners goes to many tasks, with BATCH others each."""
    many = pairs.groupBy("a").agg(F.count("*").alias("k"))
    keyed = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / BATCH)).alias("part"))
    rows = keyed.select("a", "part", F.col("b").alias("ent"), F.col("a").alias("partner")).union(keyed.select("a", "part", F.col("a").alias("ent"), F.lit(None).cast("long")).distinct())
    rows = rows.groupBy("a", "part", "ent").agg(F.collect_set("partner").alias("partners"))
    # the text of a set is that of one of its rows, by doc_id (or none) and the text's hash, as ids may be missing or repeat
    row = rows.select("ent").distinct().join(sets.select(F.col("fp").alias("ent"), F.col("doc_id").alias("id"), F.col("th").alias("of")), "ent")
    texts = row.join(docs, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("th"))).select("ent", "text").dropDuplicates(["ent"])
    return rows.join(texts, "ent").select("a", "part", "ent", "partners", "text").groupBy("a", "part").applyInArrow(_verify, "a long, b long")


def _labelled(member: DataFrame, comps: DataFrame) -> DataFrame:
    """gid, ent, comp: the members of groups with the components found so far."""
    return member.join(comps, member["ent"] == comps["node"], "left").select("gid", "ent", F.coalesce("comp", "ent").alias("comp"))


def _crossing(labelled: DataFrame, comps: DataFrame, sized: DataFrame) -> DataFrame:
    """Pairs across components that sizes and sketches allow, among them all that a group holds.

    main is the largest component of a group; the group's other members are outsiders of main. Every
    outsider of main meets all sets of main and all outsiders of it, in blocks of BLOCK by BLOCK."""
    per = labelled.groupBy("gid", "comp").agg(F.count("*").alias("k"))
    main = per.groupBy("gid").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1").select("gid", "main")
    outside = storage.saved(labelled.join(main, "gid").where("comp <> main").select("main", "ent", "comp").distinct(), "outside")
    inside = comps.select("node", "comp").join(outside.select(F.col("main").alias("comp")).distinct(), "comp").select(F.col("comp").alias("main"), F.col("node").alias("ent"), "comp")
    alone = outside.select("main").distinct().join(comps.select(F.col("node").alias("main")), "main", "left_anti").select("main", F.col("main").alias("ent"), F.col("main").alias("comp"))
    every = inside.union(alone).withColumn("out", F.lit(0)).union(outside.withColumn("out", F.lit(1)))
    rows = every.join(sized, F.col("ent") == F.col("fp")).withColumn("h", F.xxhash64("ent"))
    sizes = rows.groupBy("main").agg(F.count("*").alias("all"), F.sum("out").alias("outs"), F.max(F.length("sk")).alias("width"))
    block = F.greatest(F.lit(1), F.least(F.greatest(F.lit(BLOCK), F.col("all") / COPIES), BLOCK_BYTES / F.col("width")))
    blocks = sizes.select("main", F.ceil(F.col("all") / block).alias("ni"), F.ceil(F.col("outs") / block).alias("nj"))
    # salted, so that the sets of a large group do not pass through one task
    rows = rows.withColumn("salt", F.pmod("h", F.lit(SALTS))).join(blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["main", "salt"])
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.select("main", F.pmod("h", "ni").alias("i"), all_of("nj").alias("j"), "ent", "comp", "n", "sk", F.lit(0).alias("side"))
    right = rows.where("out = 1").select("main", all_of("ni").alias("i"), F.pmod("h", "nj").alias("j"), "ent", "comp", "n", "sk", F.lit(1).alias("side"))
    return left.union(right).groupBy("main", "i", "j").applyInArrow(_cross, "a long, b long")


def _member_groups(docs: DataFrame, top: int, n_docs: int, n_keys: int) -> tuple[DataFrame, DataFrame]:
    """Sets that share a key: members (gid, center, ent) of groups of three and more, and pairs (a, b)."""
    buckets, bits = max(8, -(-n_keys // BUCKET_KEYS)), min(63, max(1, n_keys).bit_length() + 14)
    two = buckets > FAN
    deal = Dealer(bits, -(-buckets // FAN) if two else 1, FAN if two else buckets, HOT_LOCAL)
    buckets, salts = deal.steps * deal.buckets, max(1, buckets // max(1, deal.steps))
    blobs = docs.select("text").mapInArrow(_key_blobs(top, n_docs, deal, salts), BLOB)
    if two:
        blobs = blobs.repartition(buckets, "bucket", "salt").mapInArrow(_deal_again(deal), BLOB)
    blobs = storage.saved(blobs, "keys")
    # the common keys are at most n_keys over the least count of one
    counted = blobs.where("hot is not null").select("hot").mapInArrow(_common_counts, "key long, n long")
    often = counted.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(HOT_SETS, n_keys // HOT_KEYS)).select("key").collect()
    rare, extra = blobs, None
    if often:
        common = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r["key"] for r in often], np.int64).view(U64)))
        rare = blobs.mapInArrow(_rare(common), BLOB)
        extra = storage.saved(blobs.mapInArrow(_common(common), "gid long, ent long").distinct(), "common")
    groups = storage.saved(rare.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(_groups, "gid long, size long, center long, members array<long>"), "groups")
    storage.drop(blobs)
    # groups with the same members may come from several tasks
    large = groups.where("size > 2").withColumn("first", F.col("members")[0]).dropDuplicates(["gid", "first"])
    member = large.select("gid", "center", F.explode("members").alias("ent"))
    if extra is not None:
        member = member.union(extra.join(extra.groupBy("gid").agg(F.min("ent").alias("center")), "gid").select("gid", "center", "ent"))
    member = storage.saved(member, "members")
    twos = storage.saved(groups.where("size = 2").select(F.col("members")[0].alias("a"), F.col("members")[1].alias("b")), "twos")
    storage.drop(groups, *([extra] if extra is not None else []))
    return member, twos


def set_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From documents (doc_id, text): one row for each, doc_id, th (a hash of the text), n (set size), fp (of the
    set; null for an empty one); and fp, comp: the component of each set, one for all sets that links reach."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    profile = storage.saved(docs.mapInArrow(_sets, "doc_id long, n long, fp long, sk binary, th long"), "sets")
    stats = profile.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    sets = profile.where("n > 0").groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "th")).alias("row"), F.first("n").alias("n"), F.first("sk").alias("sk"))
    sets = sets.select("fp", "row.doc_id", "row.th", "n", "sk")
    member, twos = _member_groups(docs, int(stats[2]), int(stats[0]), int(stats[1]))
    sized = sets.select(F.col("fp"), "n", "sk")

    def allowed(pairs: DataFrame) -> DataFrame:
        a, b = (sized.select(F.col("fp").alias(k), F.col("n").alias("n" + k), F.col("sk").alias("sk" + k)) for k in "ab")
        return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ska", "skb").mapInArrow(_near, "a long, b long")

    stars = member.where("ent <> center").select(F.least("center", "ent").alias("a"), F.greatest("center", "ent").alias("b"))
    pairs = storage.saved(stars.union(twos).distinct(), "pairs")
    near = storage.saved(allowed(pairs), "near")
    first = components(verified(near, sets, docs))
    rest = storage.saved(_crossing(_labelled(member, first), first, sized).distinct().join(pairs, ["a", "b"], "left_anti"), "rest")
    comps = components(verified(rest, sets, docs).union(first.select("node", "comp")))
    storage.drop(member, twos, pairs, near, first, rest)
    return profile, sets.join(comps, sets["fp"] == comps["node"], "left").select("fp", "doc_id", "th", F.coalesce("comp", "fp").alias("comp"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for documents (doc_id, text); more columns are ignored.

    Words are maximal runs without ASCII white space, A-Z as a-z; a set holds the distinct shingles of
    five words, or the whole sequence of a shorter text; a null, empty or blank text has an empty set
    and links with nothing. Documents link if 100 * common >= 75 * all. component_id is the smallest
    doc_id that links reach. Documents with equal sets link. Rows that repeat a
    doc_id are separate documents, each with the n_shingles and component of its own set. An empty table
    gives no rows.
    """
    profile, classes = set_components(docs)
    least = classes.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of = classes.join(least, "comp").select(F.col("fp").alias("set_fp"), "component_id")
    return profile.join(of, profile["fp"] == of["set_fp"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and any other columns) that stay when one row of each group of linked
    documents does: that with the smallest doc_id, a missing one being the largest; of rows that repeat both
    doc_id and text, any one. Rows with an empty set link with nothing and stay."""
    keyed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_th": F.xxhash64(F.col("text").cast("string"))}).withColumn("_key", F.xxhash64("_id", "_th"))
    profile, classes = set_components(docs)
    best = classes.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "th")).alias("row"))
    best = best.select(F.xxhash64("row.doc_id", "row.th").alias("_key"), F.lit(True).alias("_one"))
    bare = profile.where("n = 0").select(F.xxhash64("doc_id", "th").alias("_key"), F.lit(False).alias("_one")).distinct()
    rows = keyed.join(best.union(bare), "_key")
    return rows.where("_one").dropDuplicates(["_key"]).select(docs.columns).union(rows.where("not _one").select(docs.columns))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set size and component."""
    return jaccard_components(storage.table(spark, sf_dir, "documents"))
