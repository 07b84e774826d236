import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from roundsmith.llm import simhash, spelling, vector_codes
from roundsmith.llm.queries import ORACLES, QUERIES

SPACE = "[^\x20\x09-\x0d]+"


def plain_fingerprint(text):
    w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h))


def plain_components(rows):
    """(doc_id, fingerprint) -> sorted (doc_id, hex, component_id), every pair compared."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return ordered((d, f"{f:016x}", least.get(find(i))) for i, (d, f) in enumerate(rows))


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, str(type(x)), x or 0) if not isinstance(x, str) else (True, "", x) for x in r))


def test_fingerprints_equal_the_plain_rule(monkeypatch):
    texts = ["", " \n", "One", "one TWO", "a b c", "a b c a b c a b c d", "é Ü ß 日本 x\x0by", "x" * 5000, " ".join(f"W{k % 7}" for k in range(3000))]
    for part in (1 << 20, 64, 1):
        monkeypatch.setattr(simhash, "PART_BYTES", part)
        assert [simhash.fingerprint(t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_simhash_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op11_simhash_blocks"](spark, sf)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert ordered(got.collect()) == plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in docs])


def test_simhash_of_odd_documents(spark, odd_docs, no_docs):
    """Null, empty and blank texts have fingerprint zero and link; ids may be missing or repeat; columns may clash."""
    clash = odd_docs.withColumnsRenamed({"kept": "fp", "comp": "component_id", "n": "mask"})
    assert ordered(simhash.simhash_components(clash).collect()) == plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in odd_docs.collect()])
    assert simhash.simhash_components(no_docs).collect() == []
    bare = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, None)], "doc_id long, text string")
    assert ordered(simhash.simhash_components(bare).collect()) == ordered([(None, f"{plain_fingerprint('a b c'):016x}", None)] * 2 + [(None, "0" * 16, None)])


def crowded(seed, n):
    """Fingerprints that crowd keys: few base values, changed in a few of the upper, the lower or all bits."""
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        x, kind = rng.choice(base), rng.randrange(3)
        for _ in range(rng.randrange(9)):
            x ^= 1 << rng.randrange(*((0, 64), (0, 20), (50, 64))[kind])
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("group", [40, 2048])
def test_crowded_keys_lose_no_link(spark, monkeypatch, group):
    """Keys beyond GROUP are cut finer, step by step, with the same components."""
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "HELD_LINKS", 50)
    fps = crowded(group, 300)
    rows = [(k, f) for k, f in enumerate(fps)]
    frame = spark.createDataFrame([(k, simhash._signed(f)) for k, f in rows], "doc_id long, fp long")
    steps = []
    monkeypatch.setattr(simhash, "finer_masks", lambda m, plain=simhash.finer_masks: steps.append(m) or plain(m))
    monkeypatch.setattr(simhash, "_fingerprints", lambda batches: (b.rename_columns(["doc_id", "fp"]).set_column(1, "fp", b.column(1).cast("int64")) for b in batches))
    got = simhash.simhash_components(frame.selectExpr("doc_id", "string(fp) AS text"))
    assert ordered(got.collect()) == plain_components(rows)
    assert bool(steps) == (group < 2048)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3), st.integers(1, 10**12))
def test_close_fingerprints_share_a_mask(x, flips, n):
    y = x
    for i in flips:
        y ^= 1 << i
    at = [m for m in simhash.first_masks(n) if x & m == y & m]
    assert at
    for _ in range(3):
        at = [f for f in simhash.finer_masks(at[0]) if x & f == y & f]
        assert at


def test_number_of_blocks_follows_the_number_of_fingerprints():
    assert [len(simhash.first_masks(n)) for n in (100, 10**7, 10**9, 10**11)] == [4, 10, 20, 56]


def plain_codes(rows):
    """(vec_id, vector, label) of one width -> entries, and (vec_id, code, error, label) with every distance computed."""
    kept = [(i, np.floor(1024 * np.array(v, float)).astype(int), lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((k for k in kept if k[0] is not None), key=lambda k: (k[0], k[1].tolist()))[:256]
    w = len(kept[0][1]) // 4
    books = [[[int(x) for x in v[p * w : p * w + w]] for _, v, _ in first] for p in range(4)]
    parts = [[[int(x) for x in v[p * w : p * w + w]] for _, v, _ in kept] for p in range(4)]

    def nearest(p):
        return [min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p])) for x in parts[p]]

    for _ in range(4):
        for p in range(4):
            own = {}
            for x, (_, k) in zip(parts[p], nearest(p), strict=True):
                own.setdefault(k, []).append(x)
            for k, xs in own.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    ends = [nearest(p) for p in range(4)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [(i, "".join(f"{ends[p][j][1]:02x}" for p in range(4)), sum(ends[p][j][0] for p in range(4)), lab) for j, (i, _, lab) in enumerate(kept)]
    sums = Counter()
    for _, _, e, lab in coded:
        sums[lab] += e
    return [(i, c, e, sums[lab], sha) for i, c, e, lab in coded]


COLUMNS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.mark.parametrize("n", [3, 90, 700])
def test_codes_equal_plain_training(spark, n):
    """Ties, repeated ids and vectors, missing ids, labels and components, clashing columns; fewer vectors than entries and more."""
    rng = random.Random(n)
    point = lambda: [rng.choice([-0.5, 0.0, 0.25, 1.0, rng.uniform(-2, 2)]) for _ in range(8)]
    rows = [(i, point(), rng.choice([None, 1, 2, 2])) for i in range(n)]
    rows += [(1, point(), 7), (1, rows[1][1], None), (None, point(), 1), (5000, None, 1), (5001, [*point()[:7], None], 1), (5002, [*point()[:7], float("nan")], 2), (5003, [float("inf"), *point()[:7]], 2), (-7, rows[0][1], 3)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(3)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert ordered(vector_codes.compress(frame).select(COLUMNS).collect()) == ordered(plain_codes(rows))


def test_vectors_that_cannot_be_cut(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], kind)).collect() == []
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1)], kind)).collect() == []
    odd = vector_codes.compress(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [], 1)], kind)).select(COLUMNS).collect()
    assert ordered(odd) == ordered([(1, None, None, None, None), (2, None, None, None, None)])
    mixed = vector_codes.compress(spark.createDataFrame([(1, [1.0] * 4, 1), (2, [2.0] * 4, 1), (3, [1.0] * 5, 1), (4, [], None)], kind)).collect()
    assert ordered((r.vec_id, r.code, r.error, r.label_error) for r in mixed) == ordered([(1, "00000000", 0, 0), (2, "01010101", 0, 0), (3, None, None, 0), (4, None, None, None)])
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 4, 1)], kind)).collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 3, 16, 17, 256]), st.integers(1, 20), st.sampled_from([3, 50, 10**6]))
def test_nearest_entry_and_its_bounds(seed, k, width, spread):
    rng = np.random.default_rng(seed)
    book, x = vector_codes.Codebook(rng.integers(-spread, spread + 1, (k, width))), rng.integers(-2 * spread, 2 * spread + 1, (300, width))
    d = ((x[:, None] - book.entries[None]) ** 2).sum(axis=2)
    lower, upper = book.bounds(x)
    assert (lower.T <= d).all() and (d <= upper.T).all()
    index, distance = book.nearest(x)
    assert (index == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


def test_code_query_equals_plain_training(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert ordered(QUERIES["op12_va_codes"](spark, sf).select(COLUMNS).collect()) == ordered(plain_codes(rows))


def plain_variants(rows):
    """(doc_id, text) -> sorted (word, form, root, n, n_near, form_n), every word's edits enumerated."""
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    letters, form, near = sorted(set("".join(words))), {}, {}
    for w in words:
        edits = {w[:k] + w[k + 1 :] for k in range(len(w))}
        edits |= {w[:k] + c + w[k + j :] for k in range(len(w) + 1) for c in letters for j in (0, 1)}
        near[w] = [x for x in edits - {w} if x in words]
        top = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = top if top is not None and words[top] >= 5 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return ordered((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


VARIANTS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_spelling_query_equals_plain_rules(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op13_spelling_variants"](spark, sf)
    assert got.columns == VARIANTS and ordered(got.collect()) == plain_variants(rows)


def dense_words(seed):
    """Texts of words a few edits apart, some of them in chains of growing frequency."""
    rng = random.Random(seed)
    base = ["sample", "étangère", "aaaaaaaa", "stationary", "ÿellow×w"]
    words = {b: 700 for b in base}
    for _ in range(250):
        w = rng.choice(list(words))
        k, c = rng.randrange(len(w)), rng.choice("abcdefghéÿ")
        words.setdefault(rng.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]]), rng.choice([5, 6, 25, 130]))
    return [(k % 50, f"{w.title() if k % 3 == 0 and w[0] < 'z' else w}, 9") for k, (w, n) in enumerate(words.items()) for _ in range(n)]


@pytest.mark.parametrize("group", [0, 3, 500])
def test_words_of_crowded_pieces_are_found(spark, monkeypatch, group):
    monkeypatch.setattr(spelling, "GROUP", group)
    rows = dense_words(group) + [(None, None), (None, "sample Sample SAMPLE"), (3, ""), (3, "9 _ \n")]
    docs = spark.createDataFrame([(d, t, "w", 1) for d, t in rows], "doc_id long, text string, word string, n int")
    got = spelling.variants(docs).collect()
    assert ordered(got) == plain_variants(rows)
    assert len({r.root for r in got if r.root != r.word and r.root != r.form}) > 0  # some chains are longer than one


def test_spelling_of_nothing(spark, no_docs, odd_docs):
    assert spelling.variants(no_docs).collect() == []
    assert ordered(spelling.variants(odd_docs).collect()) == plain_variants([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_very_long_words(spark):
    word = "".join(random.Random(2).choice("abcdefgh") for _ in range(3000))
    rows = [(1, f"{word} {word} {word} {word} {word}"), (2, " ".join([word[:70] + word[71:]] * 30))]
    assert ordered(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == plain_variants(rows)


def test_sql_of_the_new_queries_is_registered():
    assert {"op12_va_codes", "op13_spelling_variants"} <= set(ORACLES)
