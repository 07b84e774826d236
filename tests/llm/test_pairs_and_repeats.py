import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from roundsmith.llm import components, decontaminate, ngram_join, repeats, textkit
from roundsmith.llm.queries import QUERIES
from roundsmith.llm.rindex import RunLengthIndex

SPACE = "[^\x20\x09-\x0d]+"


def shingles(text):
    text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    w = re.findall(SPACE, text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(docs):
    """(doc_id, text) rows -> sorted (doc_id, n_shingles, component_id)."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(docs)):
        if docs[i][0] is not None:
            least[find(i)].append(docs[i][0])
    key = lambda r: (r[0] is not None, *(x or 0 for x in r))
    return sorted(((d[0], len(sets[i]), min(least[find(i)], default=None)) for i, d in enumerate(docs)), key=key)


def joined(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, *(x or 0 for x in r)))


def near_copies(seed, n, words):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice(words))] for _ in range(6)]
    shared = [rng.choice(vocabulary) for _ in range(30)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, max(2, len(w) // 25))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            w = [rng.choice(vocabulary) for _ in range(rng.choice(words))] + shared
        out.append((i, " ".join(w)))
    return out


def test_ngram_join_equals_brute_force(spark, odd_docs, no_docs):
    for seed, words in ((1, [1, 2, 3, 4, 5, 6, 7, 8]), (2, [12, 20, 40]), (3, [100, 160])):
        docs = near_copies(seed, 60, words)
        got = ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"))
        assert joined(got) == brute_components(docs)
    assert joined(ngram_join.jaccard_components(odd_docs)) == brute_components([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert ngram_join.jaccard_components(no_docs).collect() == []


def test_ngram_join_with_missing_and_repeated_ids(spark):
    """A chain through a row without doc_id links, and of texts that share a doc_id each has its own links."""
    w = [f"w{k}" for k in range(100)]
    drift = lambda k: " ".join(["x" + x if j % 10 == 5 and j < 10 * k else x for j, x in enumerate(w)])
    other = [" ".join(f"{c}{k}" for k in range(60)) for c in "pqr"]
    docs = [(1, drift(0)), (None, drift(2)), (3, drift(4)), (None, drift(2)), (7, other[0]), (7, other[1]), (7, other[2]), (8, other[0] + " end"), (9, other[1] + " end"), (6, other[2] + " end"), (None, other[2] + " end now")]
    want = brute_components(docs)
    assert (3, 96, 1) in want
    assert joined(ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"))) == want


def test_ngram_join_in_two_steps_and_with_common_keys(spark, monkeypatch):
    """Many buckets that are dealt in two steps, and keys that go by rows, lose no link."""
    docs = near_copies(3, 60, [100, 160]) + near_copies(2, 40, [12, 20, 40])
    docs = [(k, t) for k, (_, t) in enumerate(docs)]
    frame, want = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), brute_components(docs)
    monkeypatch.setattr(ngram_join, "BUCKET_KEYS", 200)
    monkeypatch.setattr(ngram_join, "FAN", 8)
    monkeypatch.setattr(ngram_join, "FLUSH_KEYS", 1500)
    assert joined(ngram_join.jaccard_components(frame)) == want
    monkeypatch.setattr(ngram_join, "HOT_LOCAL", 2)
    monkeypatch.setattr(ngram_join, "HOT_SETS", 4)
    seen = []
    monkeypatch.setattr(ngram_join, "_common", lambda common, plain=ngram_join._common: seen.append(len(common.value)) or plain(common))
    assert joined(ngram_join.jaccard_components(frame)) == want and seen[0] > 10
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    monkeypatch.setattr(ngram_join, "COPIES", 10**9)
    assert joined(ngram_join.jaccard_components(frame)) == want


def test_template_pages_that_do_not_link(spark):
    """Many sets that share keys but are unlike: rows of the pair stage grow with their number, not its square."""
    rng = random.Random(6)
    shared = [f"t{k}" for k in range(60)]
    texts = [" ".join(shared + [f"x{rng.randrange(10**6)}" for _ in range(40)]) for _ in range(300)]
    docs = list(enumerate(texts)) + [(1000, texts[7] + " end"), (1001, texts[9] + " end")]
    assert joined(ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"))) == brute_components(docs)


def test_one_of_each_group_stays(spark):
    w = [f"w{k}" for k in range(100)]
    near = lambda k: " ".join([*w, f"end{k}"])
    rows = [(None, near(1), 1), (None, near(2), 2), (5, "alone with no doc like it here", 3), (5, near(3), 4), (9, near(4), 5), (None, "another text without an id at all", 6), (3, " ", 7), (3, " ", 8), (None, None, 9), (6, "five words are said here", 10), (6, "five words are said here", 11), (None, "five words are said here", 12)]
    got = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    assert got.columns == ["doc_id", "text", "n"]
    kept = sorted(r.n for r in got.collect())
    assert [n for n in kept if n not in (10, 11)] == [3, 4, 6, 7, 8, 9] and len(kept) == 7


def test_ngram_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert joined(QUERIES["op2_ngram_join"](spark, sf).select("doc_id", "n_shingles", "component_id")) == brute_components(docs)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6), st.integers(0, 3))
def test_similar_sets_share_a_key(n, seed, size):
    """The pigeonhole bound, at the limit of 3/4 and for every allocation that the cost model can choose."""
    rng = np.random.default_rng(seed)
    x = np.unique(textkit.mix(rng.integers(0, 2**62, n).astype(np.uint64)))
    keep = rng.permutation(len(x))[int(rng.integers(0, len(x) // 4 + 1)) :]
    y = np.unique(np.concatenate([x[keep], textkit.mix(rng.integers(0, 2**62, int(rng.integers(0, len(x) // 4 + 1))).astype(np.uint64))]))
    both = len(np.intersect1d(x, y))
    n_sets = (1, 10**4, 10**7, 10**11)[size]
    at = ngram_join.bands(2000)
    if 100 * both >= 75 * (len(x) + len(y) - both):
        assert set(ngram_join.keys_of(x, at, n_sets).tolist()) & set(ngram_join.keys_of(y, at, n_sets).tolist())


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 360)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}


def brute_repeats(docs):
    """(doc_id, text) rows -> Counter of (doc_id, n_bytes, n_removed, n_spans, sha)."""
    first = {}
    low = lambda i: -(2**63) if i is None else i
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(low(i), first.get(b[k : k + 50], 2**63))
    out = Counter()
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < low(i):
                gone[k : k + 50] = b"\1" * 50
        runs = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out[i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()] += 1
    return out


def test_repeats_equal_brute_force(spark, odd_docs, no_docs):
    docs = near_copies(7, 50, [40, 100]) + [(60, "ab" * 100), (61, "ab" * 80), (62, "x" * 49), (63, "x" * 50), (64, "x" * 200)]
    got = repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == brute_repeats(docs)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert Counter(map(tuple, repeats.remove_repeats(odd_docs).collect())) == brute_repeats(rows)
    assert repeats.remove_repeats(no_docs).collect() == []


def test_repeats_in_two_steps_and_with_common_anchors(spark, monkeypatch):
    """Many buckets that are dealt in two steps, small chunks, and anchors that many unlike segments share."""
    rng = random.Random(11)
    shared = "a passage of words that most of the texts have " * 2
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    docs = [(k, noise(rng.randrange(0, 90)) + shared[: rng.randrange(25, 90)] + noise(rng.randrange(0, 90))) for k in range(150)]
    docs += [(200 + k, docs[rng.randrange(150)][1][rng.randrange(30) :] + noise(40)) for k in range(40)] + [(None, docs[3][1]), (200, docs[4][1])]
    frame, want = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), brute_repeats(docs)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 900)
    monkeypatch.setattr(repeats, "FAN", 8)
    monkeypatch.setattr(repeats, "DEAL_SEGMENTS", 200)
    assert Counter(map(tuple, repeats.remove_repeats(frame).collect())) == want
    monkeypatch.setattr(repeats, "HOT_LOCAL", 2)
    monkeypatch.setattr(repeats, "HOT_SEGMENTS", 10)
    seen = []
    monkeypatch.setattr(repeats, "_send", lambda b, w, common, plain=repeats._send: seen.append(len(common.value)) or plain(b, w, common))
    assert Counter(map(tuple, repeats.remove_repeats(frame).collect())) == want and seen[0] > 0


def test_a_common_anchor_gathers_nothing_unlike():
    """With its anchors known as common, no key of a passage in unlike surroundings has many different segments."""
    rng = random.Random(2)
    passage = "the same twenty-odd bytes"
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(60)) + passage + "".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(2000)]
    tables = repeats.Chunk.tables(list(range(len(texts))), [t.encode() for t in texts])
    most = lambda key, seg: max(Counter(k for k, _ in set(zip(key.tolist(), seg.tolist()))).values())
    key, seg = (repeats._plan(*tables, 8)[c] for c in (3, 4))
    own, count = np.unique(key, return_counts=True)
    assert most(key, seg) > 100
    key, seg = (repeats._plan(*tables, 8, own[count > 20])[c] for c in (3, 4))
    assert most(key, seg) <= 20


def test_repeats_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op8_run_length_index"](spark, sf).collect())) == brute_repeats(docs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=30), min_size=1, max_size=8), st.lists(st.text(alphabet="abc", min_size=1, max_size=30), min_size=1, max_size=5))
def test_matching_statistics(segments, queries):
    span = 8
    pack = lambda xs: (np.frombuffer("".join(xs).encode(), np.uint8), np.array([len(x) for x in xs]))
    data, lengths = pack(segments)
    index = RunLengthIndex(data, lengths, np.arange(len(segments)), span)
    q, n = pack(queries)
    for live, place, length, where in index.matching(q, np.cumsum(n) - n, n):
        for k, i, ln, p in zip(live, place, length, where):
            rest = queries[k][i:]
            want = max((m for m in range(min(span, len(rest)) + 1) if any(rest[:m] in s for s in segments)), default=0)
            assert ln == want
            if want == span:
                assert index.least[p] == next(j for j, s in enumerate(segments) if rest[:span] in s)


@pytest.mark.parametrize("buckets", [8, 65_536, 65_537, 20_000_001])
def test_buckets_rise_with_keys_and_do_not_depend_on_the_chunk(buckets):
    """At any number of buckets, in each of two chunks that share text: buckets as exact integers give them, in the order of the keys."""
    rng = np.random.default_rng(4)
    shared = bytes(rng.integers(97, 123, 60_000).astype(np.uint8))
    where = []
    for own in (1, 2):
        text = shared + bytes(rng.integers(97, 123, 20_000 * own).astype(np.uint8))
        _, _, _, key, _, _, _, _, _, bucket = repeats._plan(np.array([own]), np.array([0, len(text)]), np.frombuffer(text, np.uint8), buckets)
        assert (np.diff(bucket) >= 0).all() and bucket.min() >= 0 and bucket.max() < buckets
        assert bucket.tolist() == [(k >> 16) * buckets >> 32 for k in key.tolist()]
        where.append(dict(zip(key.tolist(), bucket.tolist())))
    both = where[0].keys() & where[1].keys()
    assert len(both) > 1000 and all(where[0][k] == where[1][k] for k in both)


def test_wand_returns_every_item_above_the_threshold():
    rng = random.Random(3)
    vocabulary = [f"t{k}" for k in range(60)]
    index = decontaminate.BlockMaxIndex([(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 20])))) for k in range(70)])
    for _ in range(300):
        terms = sorted(rng.sample(range(len(index.terms)), rng.randrange(1, 25)))
        scores = defaultdict(float)
        for t in terms:
            for k in range(index.post_start[t], index.post_start[t + 1]):
                scores[int(index.post_doc[k])] += index.post_share[k]
        for threshold in (0.1, 0.3, 0.6):
            assert {d for d, _ in index.search(terms, threshold)} == {d for d, s in scores.items() if s >= threshold - 1e-12}


def test_leaks(spark, odd_docs, no_docs):
    rng = random.Random(8)
    vocabulary = [f"v{k}" for k in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(20 + k)) for k in range(12)] + [(50, None), (51, ""), (52, "École À L'été où il fait très beau")]
    docs = [(100 + k, say(300) + "\n" + items[k][1].upper() + " " + say(200)) for k in range(12)] + [(200 + k, say(500)) for k in range(10)] + [(300, items[3][1]), (301, items[3][1][: len(items[3][1]) // 3]), (302, "x école à l'été où il fait très beau y")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), frame).collect()}
    assert got == {(100 + k, k) for k in range(12)} | {(300, 3), (302, 52)}
    assert decontaminate.find_leaks(odd_docs, frame).collect() == []
    assert decontaminate.find_leaks(no_docs, frame).collect() == []
    assert decontaminate.find_leaks(odd_docs, frame.limit(0)).collect() == []


def test_leaks_finds_cut_and_edited_items(spark):
    """Copies without their first or last parts, or with every tenth word changed, are hits; a third of an item is none."""
    rng = random.Random(9)
    vocabulary = [f"v{k}" for k in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = {k: say(15 + k).split() for k in range(30)}
    cuts = {1: lambda w: w[: len(w) * 9 // 10], 2: lambda w: w[: len(w) * 3 // 4], 3: lambda w: w[len(w) // 3 :], 4: lambda w: [f"x{j}" if j % 10 == 7 else x for j, x in enumerate(w)], 5: lambda w: [f"x{j}" if j == len(w) - 2 else x for j, x in enumerate(w)], 6: lambda w: w[: len(w) // 3]}
    docs = [(100 * c + k, say(90) + " . " + " ".join(cut(w)) + " . " + say(90)) for c, cut in cuts.items() for k, w in items.items()]
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), frame).collect()}
    assert got == {(100 * c + k, k) for c in cuts if c != 6 for k in items}


def brute_leaks(docs, items):
    """{(doc_id, item_id): (score, question share, answer share)} by scoring every item in every passage of its class."""
    words_of = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    items = [(i, words_of(t)) for i, t in items if words_of(t)]
    n, mean = len(items), sum(len(w) for _, w in items) / max(1, len(items))
    df = Counter(t for _, w in items for t in set(w))
    runs = lambda w, k: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    share = lambda own, w, k: len(own & runs(w, k)) / len(own)
    out = {}
    for item, w in items:
        tf = Counter(w)
        impact = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, f in tf.items()}
        total, step = sum(impact.values()), 1
        while step < len(w):
            step *= 2
        cut = len(w) - max(4, len(w) // 4)
        q, a = (w[:cut], w[cut:]) if cut > 0 else (w, w)
        grams = [(runs(x, min(k, len(x))), min(k, len(x))) for x, k in ((q, 3), (a, 2), (w, 2))]
        for doc, text in docs:
            own = words_of(text)
            last = max(1, -(-len(own) // step) - 1)
            for k in range(last if own else 0):
                here = own[k * step : (k + 2) * step]
                score = sum(impact[t] for t in set(here) & set(impact)) / total
                if score >= 0.5 - 1e-12:
                    x, y, z = (share(g, here, m) for g, m in grams)
                    if z >= 0.5 or x >= 0.5 and y >= 0.5:
                        out[doc, item] = max(out.get((doc, item), (0.0, 0.0, 0.0)), (score, x, y))
    return out


def found_leaks(spark, docs, items):
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len({(r.doc_id, r.item_id) for r in got}) == len(got)
    return {(r.doc_id, r.item_id): pytest.approx((r.score, r.question_overlap, r.answer_overlap), abs=1e-9) for r in got}


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_equal_exhaustive_scoring(spark, monkeypatch, seed):
    """Items of one to 90 words; whole, cut, edited, split and mixed copies; blocks of bounds held one by one."""
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(120)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, say(rng.choice([1, 2, 5, 9, 17, 33, 60, 90]))) for k in range(40)] + [(50, [])]
    docs = []
    for k in range(60):
        w = list(rng.choice(items)[1])
        change = rng.randrange(4)
        if change == 1:
            w = w[: len(w) * rng.randrange(3, 10) // 10]
        elif change == 2:
            w = [rng.choice(vocabulary) if rng.random() < 0.2 else x for x in w]
        elif change == 3:
            w = w[: len(w) // 2] + say(rng.choice([3, 30, 80])) + w[len(w) // 2 :]
        docs.append((k, " ".join(say(rng.randrange(0, 150)) + w + say(rng.randrange(0, 150)))))
    items = [(k, " ".join(w)) for k, w in items]
    want = brute_leaks(docs, items)
    assert len(want) > 40
    assert found_leaks(spark, docs, items) == want
    monkeypatch.setattr(decontaminate, "HELD_POSTINGS", 50)
    monkeypatch.setattr(decontaminate, "HELD_BOUNDS", 30)
    index = decontaminate.BlockMaxIndex(sorted((i, t) for i, t in items if t))
    got = {}
    for d, t in docs:
        data = np.frombuffer(t.encode(), np.uint8)
        got |= {(d, r[1]): pytest.approx(r[2:], abs=1e-9) for r in decontaminate.scan(index, data, np.array([0, len(data)]))}
    assert got == want


def test_a_long_item_changes_no_verdict_of_a_short_one(spark):
    """The parts of a copy that lie far from each other are none, with or without a long item beside it."""
    rng = random.Random(4)
    say = lambda n, c: " ".join(f"{c}{rng.randrange(5000)}" for _ in range(n))
    item = say(12, "i").split()
    docs = [(1, " ".join(item[:6]) + " " + say(900, "d") + " " + " ".join(item[6:])), (2, say(900, "d") + " " + " ".join(item) + " " + say(900, "d"))]
    for more in ([], [(2, say(4000, "l"))]):
        assert set(found_leaks(spark, docs, [(1, " ".join(item)), *more])) == {(2, 1)}


def test_leaks_query_equals_exhaustive_scoring(spark, sf):
    rows = lambda t, i: [(r[i], r.text) for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()]
    got = {(r.doc_id, r.item_id): pytest.approx((r.score, r.question_overlap, r.answer_overlap), abs=1e-9) for r in QUERIES["op7_bm25_leaks"](spark, sf).collect()}
    assert got and got == brute_leaks(rows("documents", "doc_id"), rows("benchmark", "item_id"))


def test_leaks_query_finds_verbatim_items(spark, sf):
    words = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    docs = [(r.doc_id, words(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in docs for i, x in items if x in t}
    assert {(r.doc_id, r.item_id) for r in QUERIES["op7_bm25_leaks"](spark, sf).collect()} == want


def test_verdicts_do_not_depend_on_the_number_of_indexes(spark, sf, monkeypatch):
    """One index or many, and items of two length tiers: the same pairs with the same scores, copies cut at the end included."""
    rng = random.Random(11)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items += [(1000 + k, " ".join(rng.choice(items)[1] for _ in range(30))) for k in range(3)]
    docs = []
    for i, t in items:
        w = t.split()
        docs += [(i * 10 + j, " ".join(rng.choice(w) for _ in range(20)) + " " + " ".join(w[: max(4, int(len(w) * s))])) for j, s in enumerate((1.0, 0.85, 0.7, 0.6, 0.5, 0.45))]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    leaks = lambda: sorted(map(tuple, decontaminate.find_leaks(docs, items).collect()))
    tiers = leaks()
    monkeypatch.setattr(decontaminate, "FIRST_WORDS", 1 << 20)
    one = leaks()
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 8000)
    split = leaks()
    assert len(list(decontaminate._indexes(items))) >= 3 and len(one) > 100 and len({r[0] for r in one}) < docs.count()
    assert split == one and tiers == one
    kept = decontaminate.without_leaks(docs, items)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {r[0] for r in one}
