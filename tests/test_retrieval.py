import math
import random
import re
import time
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window, functions as F

from roundsmith import queries
from roundsmith.functions.scalar import tokens
from roundsmith.operators import retrieval
from roundsmith.plans import lineage


def kb_of(spark, texts, vecs=None):
    rows = [("*", k, k, t, vecs[k] if vecs else None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "part string, seq long, doc_id long, text string, vec array<double>")


def query_of(spark, *texts, vec=None):
    return spark.createDataFrame([(k, "*", t, vec) for k, t in enumerate(texts)], "query_id int, part string, query string, qvec array<double>")


def words(t):
    return re.findall(r"[^\W]+", t.lower())


def model_scores(query, texts):
    q, docs = words(query), [words(t) for t in texts]
    df = Counter(w for d in docs for w in set(d))
    idf = {w: math.log((len(docs) + 1) / (df[w] + 1)) + 1 for w in q}
    return [round(sum(Counter(d)[w] / (len(d) + 1e-6) * idf[w] for w in q), 12) for d in docs]


def test_tokens(spark):
    got = spark.range(1).select(tokens(F.lit("A区防守 é ½ a_b")).alias("t")).first().t
    assert got == ["a区防守", "e", "½", "a_b"]


@pytest.mark.parametrize("seed", [1, 2])
def test_sparse_equals_the_model(spark, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("smoke flash mid long a b rush hold eco".split()) for _ in range(rng.randrange(0, 12))) for _ in range(60)]
    query = "smoke mid smoke unknown"
    want = model_scores(query, texts)
    order = sorted(range(60), key=lambda k: (-want[k], k))[:20]
    got = retrieval.sparse_top(query_of(spark, query), kb_of(spark, texts)).orderBy("rank").collect()
    assert [r.doc_id for r in got] == order and [r.rank for r in got] == list(range(20))
    assert all(abs(r.score - want[r.doc_id]) < 1e-11 for r in got)


@pytest.mark.parametrize("share, first", [(0.35, 4000), (0.9, 60)])
def test_pruned_search_equals_scoring_all(spark, monkeypatch, share, first):
    """Frequent and rare words, copies (ties), texts of 1 to 300 words, parts, and queries without k documents."""
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(300)]
    text = lambda n: " ".join(vocabulary[min(299, int(rng.paretovariate(0.6)) - 1)] for _ in range(n))
    texts = [text(rng.choice([1, 3, 30, 30, 300])) for _ in range(250)]
    rows = [(rng.choice("aab"), 1000 - k, k, t) for k, t in enumerate(texts + texts[:40])]
    kb = spark.createDataFrame(rows, "part string, seq long, doc_id long, text string")
    asked = [(k, rng.choice("abc"), text(rng.choice([1, 20, 80]))) for k in range(20)] + [(90, "a", "unknown words"), (91, "b", "")]
    asked = spark.createDataFrame(asked, "query_id int, part string, query string")
    for name, value in (("FEW_POSTINGS", 0), ("SKIPPED_SHARE", share), ("FIRST_POSTINGS", first), ("COUNT", True)):
        monkeypatch.setattr(retrieval, name, value)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "seq")
    plain = retrieval.sparse_scores(asked, kb).cache()
    best = lambda rows: sorted(tuple(r) for r in rows.withColumn("k", F.row_number().over(w)).where("k <= 5").select("query_id", "k", "doc_id", "score").collect())
    scores, counts = retrieval.best_scores(retrieval.SparseIndex(asked, kb), 5)
    assert best(scores) == best(plain)
    assert counts["read"] < counts["postings"] / 2 if (share, first) == (0.35, 4000) else counts["read"] <= counts["postings"]
    assert counts["scored"] < plain.count()


def test_skipped_blocks_stay_below_the_bound():
    """Against every choice of bounds: none that adds up to less skips more, beyond the step that does not fit."""
    rng = random.Random(4)
    for _ in range(100):
        rows = [(t, c, rng.randrange(1, 50), b) for t in "xyz" for c, b in enumerate(sorted((rng.random() for _ in range(rng.randrange(1, 5))), reverse=True))]
        least = 2 * rng.random()
        t = pa.table({"query_id": [1] * len(rows), "part": ["p"] * len(rows), "term": [r[0] for r in rows], "cls": [r[1] for r in rows], "n": [r[2] for r in rows], "weight": [1.0] * len(rows), "bound": [r[3] for r in rows], "least": [least] * len(rows)})
        got = retrieval._needed(0.5)(t).to_pylist()
        kept = {(r["term"], r["cls"]) for r in got}
        gone = [r for r in rows if r[:2] not in kept]
        top = {t: max((r[3] for r in gone if r[0] == t), default=0.0) for t in "xyz"}
        assert sum(top.values()) < 0.5 * least or not gone
        assert all(r in gone for r in rows if r[3] <= top[r[0]])  # of a term all that is bounded lower is skipped as well
        assert not got or abs(got[0]["rest"] - sum(top.values())) < 1e-9


def test_empty_query_keeps_the_order(spark):
    got = retrieval.sparse_top(query_of(spark, "!!!"), kb_of(spark, ["b", "a", "c"])).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [(0, 0.0), (1, 0.0), (2, 0.0)]


def test_repeated_terms_count_repeatedly(spark):
    kb = kb_of(spark, ["smoke here", "nothing", "smoke smoke"])
    got = retrieval.sparse_top(query_of(spark, "smoke", "smoke smoke"), kb).collect()
    score = {(r.query_id, r.doc_id): r.score for r in got}
    assert all(abs(score[1, d] - 2 * score[0, d]) < 1e-10 for d in range(3)) and score[0, 2] > 0


def test_filters_come_before_counts(spark):
    docs = spark.createDataFrame([(0, "smoke a", "x'y"), (1, "flash", "x'y"), (2, "smoke", "z"), (3, "smoke", "z")], "doc_id long, text string, map string")
    left = retrieval.filtered(docs, {"map": "x'y"})
    kb = left.select(F.lit("*").alias("part"), F.col("doc_id").alias("seq"), "doc_id", "text")
    got = {r.doc_id: r.score for r in retrieval.sparse_top(query_of(spark, "smoke"), kb).collect()}
    assert got == pytest.approx(dict(enumerate(model_scores("smoke", ["smoke a", "flash"]))))
    assert retrieval.filtered(docs, {}).count() == 4 and retrieval.metadata_filter(None) is None


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / n if n else 0.0


def test_mmr_equals_the_greedy_model(spark):
    rng = random.Random(7)
    vecs = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(40)]
    vecs[5] = vecs[4]
    q = [rng.gauss(0, 1) for _ in range(6)]
    near = sorted(range(40), key=lambda k: (-round(cosine(q, vecs[k]), 12), k))[:20]
    chosen = [near[0]]
    while len(chosen) < 4:
        gain = lambda k: round(0.5 * round(cosine(q, vecs[k]), 12) - 0.5 * max(cosine(vecs[k], vecs[c]) for c in chosen), 12)
        chosen.append(max((k for k in near if k not in chosen), key=lambda k: (gain(k), -near.index(k))))
    found = retrieval.mmr(retrieval.dense_candidates(query_of(spark, "x", vec=q), kb_of(spark, ["t"] * 40, vecs)))
    assert [r.doc_id for r in found.orderBy("rank").collect()] == chosen


def test_mmr_of_few_candidates(spark):
    found = retrieval.mmr(retrieval.dense_candidates(query_of(spark, "x", vec=[1.0, 0.0]), kb_of(spark, ["a", "b"], [[1.0, 0.0], [0.0, 1.0]])))
    assert [r.doc_id for r in found.orderBy("rank").collect()] == [0, 1]


def test_fusion_of_duplicates(spark):
    kb = kb_of(spark, ["same", "other", "same", "same"])
    ranks = lambda rows: spark.createDataFrame([(0, d, r) for d, r in rows], "query_id int, doc_id long, rank int")
    got = retrieval.fuse(ranks([(0, 0), (1, 1), (2, 2)]), ranks([(3, 0), (0, 1)]), kb).orderBy("rank").collect()
    assert got[0].text == "same" and abs(got[0].score - (1 / 62 + 1 / 60 + 1 / 61)) < 1e-11 and got[0].doc_id == 2 and got[0].first_seq == 0
    assert got[1].text == "other" and abs(got[1].score - 1 / 61) < 1e-11


def test_context_and_fallbacks(spark):
    q = query_of(spark, "smoke", vec=[1.0, 0.0])
    kb = kb_of(spark, ["smoke a", "flash b"], [[1.0, 0.0], [0.0, 1.0]])
    got = retrieval.context(q, retrieval.hybrid_search(q, kb)).first().rag_context
    assert got == "smoke a\n---\nflash b"
    assert "暂无匹配" in retrieval.context(q, retrieval.hybrid_search(q, kb.limit(0))).first().rag_context
    dense_only = retrieval.hybrid_search(q, kb, sparse=False).orderBy("rank").collect()
    assert [r.doc_id for r in dense_only] == [0, 1]


def test_searches_are_asked_with_every_fiftieth_row(spark, sf):
    ids = lambda table, name: {r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").where(f"{name} % 50 = 0").select(name).collect()}
    docs, vectors = ids("documents", "doc_id"), ids("embeddings", "vec_id")
    assert len(docs) > 1 and len(vectors) > 1
    for name in ("sparse_top20", "meta_filter_sparse", "cosine_top20", "mmr_top4", "rrf_fusion", "hybrid_top4", "context_join"):
        got = {r.query_id for r in queries.QUERIES[name](spark, sf).select("query_id").collect()}
        assert got == (vectors if name in ("cosine_top20", "mmr_top4") else docs), name


def test_dense_candidates_equal_brute_force(spark, monkeypatch):
    """With ties, parts, ids that are texts, vectors without length or missing, and blocks smaller than the tables."""
    rng = random.Random(3)
    vec = lambda: rng.choice([None, [0.0, 0.0, 0.0], [float(rng.randrange(-2, 3)) for _ in range(3)]])
    kb = [(rng.choice("ab"), 1000 - k, k, f"t{k}", vec()) for k in range(200)]
    asked = [(f"q{k}", rng.choice("abc"), vec()) for k in range(30)]
    want = []
    for q, part, v in asked:
        near = sorted((-round(cosine(v, d[4]), 12), d[1], d[2]) for d in kb if d[0] == part and d[4] is not None) if v is not None else []
        want += [(q, place, doc, -sim) for place, (sim, _, doc) in enumerate(near[:7])]
    frames = spark.createDataFrame(asked, "query_id string, part string, qvec array<double>"), spark.createDataFrame(kb, "part string, seq long, doc_id long, text string, vec array<double>")
    for block, sent in ((2048, 1 << 20), (5, 100)):
        monkeypatch.setattr(retrieval, "BLOCK", block)
        monkeypatch.setattr(retrieval, "SENT_BYTES", sent)
        got = sorted((r.query_id, r.place, r.doc_id, r.sim) for r in retrieval.dense_candidates(*frames, 7).collect())
        assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and all(abs(g[3] - w[3]) < 1e-9 for g, w in zip(got, sorted(want)))


def test_texts_are_read_for_ranked_documents_alone(spark):
    """The fusion's plan drops all other documents before any text is shuffled."""
    kb = kb_of(spark, ["a", "b", "c"])
    ranks = spark.createDataFrame([(0, 1, 0)], "query_id int, doc_id long, rank int")
    plan = retrieval.fuse(ranks, ranks, kb)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("Aggregate") < plan.index("LeftSemi")


@pytest.mark.parametrize("sent, block", [(16 << 20, 2_000_000), (60, 100)])
def test_search_within_tasks_equals_scoring_all(spark, monkeypatch, sent, block):
    """With passes over queries, blocks of documents, parts, copies (ties) and queries that find few documents or none."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(vocabulary[min(59, int(rng.paretovariate(0.8)) - 1)] for _ in range(n))
    texts = [text(rng.choice([0, 1, 3, 30])) for _ in range(120)]
    rows = [(rng.choice("aab"), 1000 - k, k, t) for k, t in enumerate(texts + texts[:40])]
    kb = spark.createDataFrame(rows, "part string, seq long, doc_id long, text string")
    asked = spark.createDataFrame([(f"q{k}", rng.choice("abc"), text(rng.choice([0, 1, 20]))) for k in range(15)] + [("u", "a", "unknown"), ("n", "b", None)], "query_id string, part string, query string")
    found = lambda: sorted(tuple(r) for r in retrieval.sparse_top(asked, kb, 7).select("query_id", "rank", "doc_id", "score").collect())
    plain = found()
    for name, value in (("FEW_POSTINGS", 0), ("SENT_CHARS", sent), ("BLOCK_POSTINGS", block)):
        monkeypatch.setattr(retrieval, name, value)
    assert found() == plain


def test_vectors_of_their_own_table_and_texts_of_the_result_alone(spark):
    """No text is shuffled that is not of the result, and the results are those of one table with texts and vectors."""
    texts = ["smoke a", "flash b", "smoke a", "long mid"]
    kb = kb_of(spark, texts, [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [0.5, 1.0]])
    q = query_of(spark, "smoke long", "flash", vec=[1.0, 0.2])
    rows = lambda found: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in found.collect())
    own = retrieval.hybrid_search(q, kb.drop("vec"), vectors=kb.drop("text"))
    assert rows(own) == rows(retrieval.hybrid_search(q, kb))
    assert all(r.text == texts[r.doc_id] for r in own.collect())
    ranks = spark.createDataFrame([(0, 1, 0)], "query_id int, doc_id long, rank int")
    found = retrieval.fuse(ranks, ranks, kb, None, texts=False)
    assert "text" not in found.columns and "sha2" in found._jdf.queryExecution().optimizedPlan().toString()


def test_sums_do_not_depend_on_the_order(spark, monkeypatch):
    """Documents whose words weigh the same in another order tie, whichever way they are scored."""
    rng = random.Random(11)
    values = [rng.random() * 10 ** rng.randrange(-3, 1) for _ in range(7)]
    rows = [(k, x) for k in range(60) for x in rng.sample(values, 7)]
    frame = spark.createDataFrame(rows, "k int, x double").coalesce(1)
    assert {r.s for r in frame.groupBy("k").agg(retrieval._exact_sum(F.col("x")).alias("s")).collect()} == {math.fsum(values)}
    assert len({r.s for r in frame.groupBy("k").agg(F.sum("x").alias("s")).collect()}) > 1
    # by document: the block of a task
    counts = pa.array([[*rng.sample(range(7), 7)] for _ in range(60)], pa.list_(pa.int32()))
    ones = pa.array([[1] * 7] * 60, pa.list_(pa.int32()))
    block = retrieval._Block(pa.table({"len": pa.array([1] * 60, pa.int32()), "terms": counts, "tfs": ones, "classes": pa.array([[0] * 7] * 60, pa.list_(pa.int8()))}))
    monkeypatch.setattr(retrieval, "PLACES", 15)
    assert len(set(block.scores(np.arange(60), np.array(values)).tolist())) == 1


def test_fused_scores_do_not_depend_on_the_order(spark, monkeypatch):
    """Sparse ranks of a text with many copies add up to one score, whichever copy has which rank."""
    monkeypatch.setattr(retrieval, "PLACES", 17)
    rng = random.Random(2)
    kb = kb_of(spark, ["same"] * 20)
    rows = [(q, d, r) for q in range(40) for r, d in sorted(enumerate(rng.sample(range(20), 20)), key=lambda _: rng.random())]
    sparse = spark.createDataFrame(rows, "query_id int, doc_id long, rank int")
    got = retrieval.fuse(sparse.limit(0), sparse, kb).collect()
    assert len(got) == 40 and len({r.score for r in got}) == 1


def test_hybrid_ties_of_equal_weights_stay_in_candidate_order(spark, monkeypatch):
    """Texts in which the words of a query have the same counts in another order have the same score, however it is rounded."""
    monkeypatch.setattr(retrieval, "PLACES", 17)
    rng = random.Random(6)
    texts = [" ".join(f"w{k} " * n for k, n in enumerate(rng.sample(range(1, 10), 9))) for _ in range(30)]
    q = query_of(spark, " ".join(f"w{k}" for k in range(9)))
    got = retrieval.hybrid_search(q, kb_of(spark, texts), 20).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(20))


def test_copies_of_a_vector_tie_wherever_they_stand(spark):
    """Cosines and their rounding are DuckDB's, bit for bit, in every place of a block; so is the order of copies."""
    rng = np.random.default_rng(12)
    vecs = (rng.normal(size=(101, 64)) + 2).astype(np.float32).tolist() * 5  # of the tables' type: products are exact
    kb = spark.createDataFrame(pa.table({"part": ["*"] * 505, "seq": range(505), "doc_id": range(505), "vec": vecs}))
    asked = spark.createDataFrame(pa.table({"query_id": range(401), "part": ["*"] * 401, "qvec": (rng.normal(size=(401, 64)) + 2).astype(np.float32).tolist()}))
    con = duckdb.connect()
    con.register("kb", kb.toArrow())
    con.register("asked", asked.toArrow())
    sql = "select query_id, row_number() over (partition by query_id order by sim desc, seq) - 1 as place, seq, sim from (select query_id, seq, round(list_cosine_similarity(vec, qvec), 12) as sim from kb, asked) order by 1, 2"
    want = con.sql(sql).fetchall()
    got = retrieval.dense_candidates(asked, kb, 505).select("query_id", "place", "seq", "sim").orderBy("query_id", "place").toArrow()
    assert [tuple(r.values()) for r in got.to_pylist()] == want


def test_scores_are_rounded_as_sql_rounds_doubles(spark):
    x = [(1000 * k + 500) / 1e12 for k in range(7, 2000)] + [-0.5e-9, -1.5e-9, 0.0, 0.25]
    got = [r.r for r in spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, x double").select("k", retrieval.rounded(F.col("x"), 9).alias("r")).orderBy("k").collect()]
    assert got == [r[0] for r in duckdb.sql(f"select round(x, 9) from (select unnest({x}::double[]) as x)").fetchall()]


def test_first_sums_of_a_task_do_not_grow_with_its_blocks(spark, monkeypatch):
    """One row for each query with its k best of all blocks."""
    monkeypatch.setattr(retrieval, "BLOCK_POSTINGS", 1)
    n = np.arange(1, 41)
    rows = pa.table({"part": ["*"] * 40, "doc_id": n, "seq": n, "len": pa.array([100] * 40, pa.int32()), "terms": pa.array([[0]] * 40, pa.list_(pa.int32())), "tfs": pa.array([[int(x)] for x in n], pa.list_(pa.int32())), "classes": pa.array([[0]] * 40, pa.list_(pa.int8()))})
    queries_of_part = (pa.array([7, 8]), np.array([0, 1, 2]), np.array([0, 0]), np.array([1.0, 2.0]), np.array([0, 0]), np.zeros(2), np.zeros(2))
    asked = SimpleNamespace(sent=SimpleNamespace(value={"*": queries_of_part}), id_type="int")
    got = [r for b in retrieval._first_sums(asked, 3)(iter(rows.to_batches(max_chunksize=4))) for r in b.to_pylist()]
    assert [r["query_id"] for r in got] == [7, 8]
    assert [sorted(round(x, 4) for x in r["sums"]) for r in got] == [[0.38, 0.39, 0.4], [0.76, 0.78, 0.8]]


def test_blocks_of_a_task_are_counted_once(monkeypatch):
    """One row for each block of a task however many batches it has; a term with few postings in the task is one block, of its greatest class."""
    rng = random.Random(9)
    docs = [[(t, rng.randrange(1, 9), rng.randrange(5)) for t in sorted(rng.sample(range(40), 6)) if t < 8 or rng.random() < 0.2] for _ in range(200)]
    column = lambda k, kind: pa.array([[p[k] for p in d] for d in docs], pa.list_(kind))
    rows = pa.table({"len": pa.array([50] * 200, pa.int32()), "terms": column(0, pa.int32()), "tfs": column(1, pa.int32()), "classes": column(2, pa.int8())})
    want: dict = {}
    few = {t for t, n in Counter(p[0] for d in docs for p in d).items() if n <= retrieval.RARE}
    last = {t: max(p[2] for d in docs for p in d if p[0] == t) for t in few}
    assert few and len(few) < 40
    for t, tf, cls in (p for d in docs for p in d):
        n, top = want.get((t, last.get(t, cls)), (0, 0))
        want[t, last.get(t, cls)] = (n + 1, max(top, tf))
    for size in (1, 2_000_000):
        monkeypatch.setattr(retrieval, "BLOCK_POSTINGS", size)
        got = [r for b in retrieval._counted_blocks(iter(rows.to_batches(max_chunksize=7))) for r in b.to_pylist()]
        assert [(r["term"], r["cls"]) for r in got] == sorted(want)
        for r in got:
            n, top = want[r["term"], r["cls"]]
            assert r["n"] == n and top / (50 + 1e-6) <= r["top"] < top / 50 * (1 + 1e-6)
    assert not list(retrieval._counted_blocks(iter([])))


def test_no_blocks_of_a_query_are_written(spark, monkeypatch):
    """What a query is held against reaches its task by term: of a query only its terms, weights and cuts are shuffled or written."""
    held = []
    real = retrieval.saved
    monkeypatch.setattr(retrieval, "saved", lambda df, name: (held.append((name, df.schema.simpleString())), real(df, name))[1])
    monkeypatch.setattr(retrieval, "FEW_POSTINGS", 0)
    kb = kb_of(spark, ["smoke a", "flash b", "smoke smoke", ""])
    got = retrieval.sparse_top(query_of(spark, "smoke unknown", "unknown", ""), kb, 2).collect()
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in got) == [(0, 0, 2), (0, 1, 0), (1, 0, 0), (1, 1, 1), (2, 0, 0), (2, 1, 1)]
    assert {"scores", "blocks"} < {name for name, _ in held}
    assert not [name for name, kind in held if "query_id" in kind and "top:" in kind]


def test_shuffle_files_of_a_saved_table_go_with_it(spark):
    stored = lambda: sum(b.isShuffle() for b in _blocks(spark))
    before = stored()
    conf = spark.conf.get(lineage.CLEAN)
    table = lineage.saved(spark.range(1000).repartition(7).groupBy(F.col("id") % 10).count(), "counts")
    for _ in range(100):  # files are removed beside the session's work
        if stored() <= before:
            break
        time.sleep(0.1)
    assert stored() <= before and table.count() == 10 and spark.conf.get(lineage.CLEAN) == conf


def test_blocks_are_counted_by_a_task_for_each_core(spark, monkeypatch):
    """However many partitions the postings have, so that what a hybrid search shuffles for them does not grow with the documents."""
    plans = {}
    real = retrieval.saved
    monkeypatch.setattr(retrieval, "saved", lambda df, name: (plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}), real(df, name))[1])
    texts = ["smoke a", "flash b", "smoke a", "long mid"]
    kb = kb_of(spark, texts, [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [0.5, 1.0]])
    q = query_of(spark, "smoke long", vec=[1.0, 0.2])
    rows = lambda: sorted((r["rank"], r.doc_id, r.score) for r in retrieval.hybrid_search(q, kb).collect())
    plain = rows()
    monkeypatch.setattr(retrieval, "FEW_POSTINGS", 0)
    assert rows() == plain
    assert f"Repartition {spark.sparkContext.defaultParallelism}, false" in plans["blocks"]


def _blocks(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return [found.apply(k) for k in range(found.size())]


def test_a_task_hands_on_the_best_of_all_its_documents_once(spark, monkeypatch):
    """However many blocks a task has, each query gets k rows of it; only beyond HELD_ROWS more."""
    monkeypatch.setattr(retrieval, "BLOCK_POSTINGS", 1)
    n = np.arange(1, 41)
    lists = lambda kind, values: pa.array(values, pa.list_(kind))
    rows = pa.table({"part": ["a", "b"] * 20, "doc_id": n, "seq": -n, "len": pa.array([100] * 40, pa.int32()), "terms": lists(pa.int32(), [[0]] * 40), "tfs": lists(pa.int32(), [[int(x) // 4] for x in n + 4]), "classes": lists(pa.int8(), [[0]] * 40)})
    of_part = lambda *ids: (pa.array(ids), np.array([0, 1, 2]), np.array([0, 0]), np.array([1.0, 2.0]), np.array([0, 0]), np.zeros(2), np.zeros(2))
    asked = SimpleNamespace(sent=SimpleNamespace(value={"a": of_part(7, 8), "b": of_part(9, 10)}), id_type="int")
    want = {q: [d for d in sorted(n.tolist(), key=lambda d: (-((d + 4) // 4), -d)) if d % 2 == q // 9 % 2 ^ 1][:3] for q in (7, 8, 9, 10)}
    for held in (2_000_000, 4):
        monkeypatch.setattr(retrieval, "HELD_ROWS", held)
        got = [r for b in retrieval._best_of_blocks(asked, 3)(iter(rows.to_batches(max_chunksize=4))) for r in b.to_pylist()]
        best = {q: [r["doc_id"] for r in sorted(got, key=lambda r: (-r["score"], r["seq"])) if r["query_id"] == q][:3] for q in want}
        assert best == want and (len(got) == 12) == (held > 4)


def test_dense_tasks_hand_on_the_nearest_of_all_their_candidates_once(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    asked = query_of(spark, "", "", vec=[1.0, 0.5])
    rows = pa.table({"part": ["*"] * 50, "doc_id": np.arange(50), "seq": np.arange(50), "vec": pa.array([[1.0, k % 7 / 7] for k in range(50)])})
    got = [r for b in retrieval._nearest(asked.select("part", "query_id", "qvec"), 4)(iter(rows.to_batches(max_chunksize=5))) for r in b.to_pylist()]
    near = sorted(range(50), key=lambda k: (-round(cosine([1.0, 0.5], [1.0, k % 7 / 7]), 12), k))[:4]
    assert sorted((r["query_id"], r["doc_id"]) for r in got) == sorted((q, d) for q in (0, 1) for d in near)
    held = {}
    real = retrieval.saved
    monkeypatch.setattr(retrieval, "saved", lambda df, name: (held.update({name: df._jdf.queryExecution().optimizedPlan().toString()}), real(df, name))[1])
    retrieval.nearest(asked, kb_of(spark, ["a"] * 9, [[1.0, float(k)] for k in range(9)]).repartition(99))
    assert f"Repartition {retrieval.TASKS_PER_CORE * spark.sparkContext.defaultParallelism}, false" in held["nearest"]


def test_stored_postings_are_gaps_from_which_all_follows(spark):
    """Small gaps for terms that many ask for, no classes; blocks of all tasks bound the impacts of their postings."""
    rng = random.Random(4)
    texts = [" ".join(f"w{min(39, int(rng.paretovariate(0.7)))}" for _ in range(rng.randrange(1, 90))) for _ in range(80)]
    q = spark.createDataFrame([(k, "*", " ".join(f"w{x}" for x in range(k % 40))) for k in range(60)], "query_id int, part string, query string")
    index = retrieval.SparseIndex(q, kb_of(spark, texts).repartition(3))
    assert index.rows.columns == ["part", "doc_id", "seq", "len", "gaps", "tfs"]
    names = {r.id: r.term for r in index.tables[1].collect()}
    assert names[0] == "w0" and names[len(names) - 1] == "w38"
    opened = [r for b in retrieval._opened(iter(index.rows.toArrow().to_batches(max_chunksize=7))) for r in b.to_pylist()]
    got = {r.term: sorted((c.cls, c.n, c.top) for c in r.classes) for r in index.blocks.collect()}
    found = Counter()
    assert {r["doc_id"] for r in opened} == {k for k, t in enumerate(texts) if set(words(t)) & set(names.values())}
    for r in opened:
        own = Counter(words(texts[r["doc_id"]]))
        assert {names[t]: n for t, n in zip(r["terms"], r["tfs"], strict=True)} == {w: n for w, n in own.items() if w in names.values()} and r["len"] == sum(own.values())
        for t, tf, cls in zip(r["terms"], r["tfs"], r["classes"], strict=True):
            impact = min(tf / (r["len"] + 1e-6), 1.0)
            assert 2.0 ** (-(cls + 1) / retrieval.CLASSES) < impact <= 2.0 ** (-cls / retrieval.CLASSES)
            found[t] += 1
            assert max(top for c, _, top in got[t] if c >= cls) >= impact
    assert found == {t: sum(n for _, n, _ in own) for t, own in got.items()} == {r.term: r.df for r in index.blocks.collect()}
    index.close()
