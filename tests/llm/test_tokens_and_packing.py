import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from roundsmith.llm import packing, storage, token_files, tokens
from roundsmith.llm.queries import QUERIES

PATH = tokens.default_path()


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def ids_of(plain, text, end):
    return [*plain.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="a'sS \x00\x1c\t\n<|endoftx>é½.İΣ", max_size=40))
def test_words_give_the_ids_of_the_whole_text(text):
    text = text.encode("utf-8", "ignore").decode()
    got = np.frombuffer(tokens.word_tokenizer(PATH).ids(text.encode()), tokens.word_tokenizer(PATH).dtype).tolist()
    assert got == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids if text else got == []


@pytest.mark.parametrize("planes", ["bit", "byte"])
@pytest.mark.parametrize("dtype", ["<u2", "<u4"])
def test_planes_round_trip(tmp_path, planes, dtype):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 49408, n).astype(dtype) for n in (0, 1, 999, 1000, 1001, 5000, 0, 3)]
    w = token_files.TokenFileWriter(f"file://{tmp_path}/a.ids", np.dtype(dtype), 1000, planes)
    for k, d in enumerate(docs):
        w.add(k if k else None, d)
    w.close()
    f = token_files.TokenFile(f"file://{tmp_path}/a.ids")
    whole = np.concatenate(docs)
    assert f.lengths.tolist() == [len(d) for d in docs] and f.n_blocks == 9
    assert f.crcs().tolist() == [crc(d) for d in docs]
    for start, n in ((0, 0), (0, 8004), (999, 2), (2500, 3000), (8003, 1)):
        assert f.read(start, n).tolist() == whole[start : start + n].tolist()
    raw = (tmp_path / "a.ids").read_bytes()
    (tmp_path / "b.ids").write_bytes(raw[:-9])
    with pytest.raises(ValueError):
        token_files.TokenFile(f"file://{tmp_path}/b.ids")


def test_token_files_hold_every_document_in_order(spark, odd_docs, no_docs, plain):
    files = token_files.write_token_files(odd_docs, storage.fresh(spark, "t"))
    got = sorted(map(tuple, token_files.read_token_files(spark, files).drop("file").collect()), key=lambda r: r[1])
    rows = sorted(((r.doc_id, r.text) for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, []
    for i, t in rows:
        ids = ids_of(plain, t, 1)
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    assert token_files.read_token_files(spark, token_files.write_token_files(no_docs, storage.fresh(spark, "t"))).collect() == []


def check_pieces(rows, docs, plain, capacity=4096):
    """rows: doc_id, start, length, crc, doc_tokens, sequence_id, offset; docs: id -> text."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r[0]].append(r)
        by_seq[r[5]].append(r)
    assert set(by_doc) == set(docs)
    for i, own in by_doc.items():
        ids, at = ids_of(plain, docs[i], 2), 0
        for _, start, n, c, total, _, _ in sorted(own, key=lambda r: r[1]):
            assert (start, total, c) == (at, len(ids), crc(ids[start : start + n])) and n > 0
            at += n
        assert at == len(ids)
    padding = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r[6]):
            assert r[6] == at
            at += r[2]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_packing_keeps_every_id_once(spark, odd_docs, no_docs, plain):
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = [tuple(r) for r in packing.pack_documents(docs, group_bytes=60_000).collect()]
    assert check_pieces(rows, {r.doc_id: r.text for r in docs.collect()}, plain) == 0
    assert packing.pack_documents(odd_docs).selectExpr("sum(length)").first()[0] == sum(len(ids_of(plain, r.text, 2)) for r in odd_docs.collect())
    assert packing.pack_documents(no_docs).collect() == []


def test_rows_that_repeat_are_spread_over_groups(spark):
    """A row that is a third of all and more does not make one group large; few short sequences are left."""
    rows = [(7, "the same words " * 40)] * 4000 + [(10_000 + k, f"some other words {k} " * 30) for k in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = packing.pack_documents(frame, group_bytes=60_000).collect()
    of = defaultdict(int)
    for r in got:
        of[r.sequence_id >> 32] += r.length
    total, groups = sum(of.values()), 1 + sum(len(t) for _, t in rows) // 60_000
    assert max(of.values()) < 2 * total / groups + 64 * 4096
    assert total == sum(r.length for r in got) and len([r for r in got if r.doc_id == 7 and r.start == 0]) == 4000
    sizes = defaultdict(int)
    for r in got:
        sizes[r.sequence_id] += r.length
    assert sum(n < 4096 for n in sizes.values()) <= 12 * -(-groups // packing.REST)


def test_queries_of_packing_and_token_files(spark, sf, plain):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check_pieces([tuple(r) for r in QUERIES["op10_packing"](spark, sf).collect()], docs, plain) == 0
    got, at = {r.doc_id: tuple(r)[1:] for r in QUERIES["op1_token_planes"](spark, sf).collect()}, 0
    for i in sorted(docs):
        ids = ids_of(plain, docs[i], 1)
        assert got[i] == (at, len(ids), crc(ids))
        at += len(ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_first_fit_is_first_fit(sizes):
    want, left = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = next((k for k, room in enumerate(left) if room >= sizes[i]), None)
        if k is None:
            k = len(left)
            left.append(64), want.append([])
        left[k] -= sizes[i]
        want[k].append(i)
    assert packing.first_fit_decreasing(sizes, 64) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=40))
def test_pack_leaves_no_padding(lengths):
    got, seq = defaultdict(list), defaultdict(int)
    for d, start, n, s, at in packing.pack(lengths, 64):
        assert at == seq[s]
        seq[s] += n
        got[d].append((start, n))
    assert sorted(got) == list(range(len(lengths)))
    for d, own in got.items():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at == lengths[d]
    assert all(n <= 64 and n & (n - 1) == 0 for n in seq.values())


def test_a_known_word_is_looked_up_once(plain):
    """Packing spends most of its time on words that the worker knows."""
    looked = defaultdict(int)

    class Counted(dict):
        def get(self, word, *other):
            looked["get"] += 1
            return super().get(word, *other)

        def __getitem__(self, word):
            looked["item"] += 1
            return super().__getitem__(word)

    own = tokens.WordTokenizer(PATH)
    texts = [b"one two, one", b"", b"two, three one"]
    first = own.all_ids(texts)
    own.cache = Counted(own.cache)
    assert own.all_ids(texts) == first and looked == {"get": 6}
    assert own.all_ids([b"one four one"]) == [np.array(plain.encode("one four one", add_special_tokens=False).ids, own.dtype).tobytes()]
    assert looked == {"get": 9, "item": 1}
