from collections import Counter

import corpus_pipeline
from tokenizers import Tokenizer

from roundsmith.llm import line_quality, pii, storage, tokens
from test_pairs_and_repeats import brute_components
from test_tokens_and_packing import check_pieces


def test_stages_equal_brute_force(spark, sf):
    """Each stage's decisions on what its predecessor kept, and the whole run."""
    docs = storage.table(spark, sf, "documents")
    names = docs.columns
    kept = corpus_pipeline.quality(spark, docs, sf)
    assert kept.columns == names and dict(kept.dtypes) == dict(docs.dtypes)
    model = line_quality.fit(docs, storage.table(spark, sf, "labels"))
    want = {r.doc_id for r in line_quality.label_documents(docs, model).where("kept").collect()}
    rows = {r.doc_id: r.text for r in kept.collect()}
    assert set(rows) == want and len(want) < docs.count()

    kept = storage.saved(kept, "t")
    one = corpus_pipeline.near_duplicates(spark, kept, sf)
    assert one.columns == names
    first = {c for i, _, c in brute_components(sorted(rows.items())) if i == c}
    rows = {r.doc_id: r.text for r in one.collect()}
    assert set(rows) == first

    one = storage.saved(one, "t")
    clean = corpus_pipeline.decontamination(spark, one, sf)
    from roundsmith.llm.decontaminate import find_leaks

    leaks = {r.doc_id for r in find_leaks(one, storage.table(spark, sf, "benchmark")).collect()}
    rows = {i: t for i, t in rows.items() if i not in leaks}
    assert clean.columns == names and {r.doc_id: r.text for r in clean.collect()} == rows

    clean = storage.saved(clean, "t")
    masked = corpus_pipeline.personal_data(spark, clean, sf)
    assert masked.columns == names and dict(masked.dtypes) == dict(docs.dtypes)
    field = pii.fit(clean)
    found = pii.find_spans([rows[i] for i in sorted(rows)], field)
    rows = {i: pii.masked(rows[i], spans) for i, (_, spans) in zip(sorted(rows), found, strict=True)}
    got = masked.collect()
    assert {r.doc_id: r.text for r in got} == rows and all(r.n_chars == len(r.text) for r in got)
    assert not any(pii.base_spans(t) for t in rows.values())

    pieces = [tuple(r) for r in corpus_pipeline.run(spark, sf).collect()]
    assert check_pieces(pieces, rows, Tokenizer.from_file(tokens.default_path())) == 0


def test_odd_documents_pass_through(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = storage.saved(stage(spark, docs, sf), "t")
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        assert corpus_pipeline.packing(spark, docs, sf).columns[:3] == ["doc_id", "start", "length"]
    near = Counter(r.doc_id for r in corpus_pipeline.near_duplicates(spark, odd_docs, sf).collect())
    assert near[4] == 1 and near[5] == near[14] == 0 and near[12] == 0 and near[None] == 1


def test_contaminated_rows_without_or_with_repeated_ids_go(spark, sf):
    item = storage.table(spark, sf, "benchmark").first().text
    rows = [(None, "clean words here"), (None, f"before {item} after"), (5, f"before {item} after"), (5, "clean words again"), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, docs, sf).collect())
    assert got == Counter([(None, "clean words here"), (5, "clean words again"), (6, None)])
