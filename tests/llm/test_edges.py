"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratocast.llm import crf, html, mixing, ngram, packing, rans, rules, simhash, topk, toxicity
from stratocast.llm.queries import BYTE_BPE, ORACLES, QUERIES, WORD_BPE, _tokenizer

LONG = "word another third " * 30_000
TEXTS = [
    (1, "a b c d e"), (1, "a b c d e"), (2, None), (3, ""), (4, " \n\t "), (None, "null id text here"), (None, None), (5, LONG),
    (6, "a b c d e"), (7, "x"), (8, "  two  blanks é "), (9, "tie tie tie"), (10, "line\nline\nline"),
]
EXTRA = ["score", "fp", "size", "hash", "y", "part", "rest", "bucket", "node", "root", "held_out", "kept", "mix_id", "uses", "text_bytes", "toxic_score", "rules_kept", "n", "a", "b"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, None if i == 2 else "en", None if i in (3, None) else f"s{(i or 0) % 3}", None) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("clash").alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, 1, 0), (None, 1, 1), (7, None, None), (9, 0, 1)], "doc_id long, quality int, toxic int")


def cases(labels):
    return {
        "simhash": simhash.near_duplicates,
        "rules": lambda d: rules.apply_rules(d, rules.fit_rules(d, labels)),
        "crf": lambda d: crf.score_quality(d, crf.fit_quality(d, labels)),
        "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels)),
        "mixing": mixing.mix,
        "ngram": lambda d: ngram.score(d, ngram.train(d)),
        "rans": lambda d: rans.read_tokens(d.sparkSession, rans.write_tokens(d, _tokenizer(WORD_BPE))[0]),
    }


@pytest.mark.parametrize("name", ["simhash", "rules", "crf", "toxicity", "mixing", "ngram", "rans"])
def test_one_row_for_each_document(docs, labels, name):
    run = cases(labels)[name]
    rows = run(docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in TEXTS)
    for r in rows:
        assert all(v is not None for c, v in r.asDict().items() if c not in ("doc_id", "component_id"))
    assert run(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["rules", "crf", "toxicity", "ngram"])
def test_no_labels_or_text_to_learn_from(docs, labels, name):
    empty = cases(labels.limit(0))[name]
    assert empty(docs).count() == len(TEXTS)


def test_packing_edges(docs):
    rows = packing.pack(docs, _tokenizer(BYTE_BPE)).collect()
    assert sorted(str(r.doc_id) for r in rows if r.start == 0) == sorted(str(i) for i, _ in TEXTS)
    assert packing.pack(docs.limit(0), _tokenizer(BYTE_BPE)).count() == 0


def test_html_edges(spark):
    rows = [(1, None, None), (2, "nonsense", ""), (None, "http://h/x", "<p>a"), (3, "http://h/y", "<div>" * 3000 + "deep"), (3, "http://h/y", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = {(r.page_id, r.text, r.n_chars) for r in html.extract(pages).collect()}
    assert got == {(1, "", 0), (2, "", 0), (None, "a", 1), (3, "deep", 4)}
    assert html.extract(pages).count() == 5
    assert html.extract(pages.limit(0)).count() == 0


def test_top_k_edges(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (20, [1e30, 0.0]), (20, [1e30, 0.0]), (6, []), (7, [float("inf")])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("id", F.lit(1))
    got = sorted(topk.exact_top_k(v, v.where("vec_id % 20 = 0"), k=3).collect())
    best = {q: [(r.vec_id, r.score) for r in got if r.query_id == q] for q in (0, 20)}
    assert best[0] == [(20, 2**63 - 1), (20, 2**63 - 1), (1, 64 * 64 + 32 * 32)]
    assert [i for i, _ in best[20]] == [0, 0, 1, 1, 2, 2]  # the id's two rows are queries each; all scores are held to the same
    assert topk.exact_top_k(v.limit(0), v.limit(0)).count() == 0


def test_top_k_takes_every_row_of_a_repeated_id(spark, tmp_path):
    import duckdb

    rows = [(20, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [3.0, 1.0]), (40, [1.0, 1.0])] + [(i % 7, [float(i % 5), 1.0]) for i in range(60)] + [(3, [2.0, 2.0])] * 30
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v.write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(db.execute(ORACLES["op1_exact_topk"]).fetchall())
    assert sorted(map(tuple, QUERIES["op1_exact_topk"](spark, str(tmp_path)).collect())) == want and len(want) > 60


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_edges_and_keep_columns(spark, docs, labels, stage, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        out = corpus_pipeline.STAGES[stage][1](spark, table, str(tmp_path))
        out.collect()
        if stage < 4:
            assert out.columns == docs.columns


def test_dedup_keeps_one_of_each_group(docs):
    kept = simhash.keep_one_of_each(docs).collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(1) == 1 and 6 not in ids and ids.count(2) == 1 and 3 not in ids and 4 not in ids
    assert sum(r.doc_id is None for r in kept) == 1  # the null-id text of its own; the other belongs to group 2


def test_dedup_of_a_scan_whose_columns_clash(spark, docs, tmp_path):
    """A scan of several files with a column called like the hidden one gives what the table itself does."""
    clash = docs.withColumn("_metadata", F.lit(1)).withColumn("file", F.lit("x")).withColumn("place", F.lit(2))
    clash.repartition(3).write.parquet(f"{tmp_path}/d")
    scan = spark.read.parquet(f"{tmp_path}/d")
    row = lambda r: (str(r.doc_id), r.text)
    assert sorted(map(row, simhash.keep_one_of_each(scan).select("doc_id", "text").collect()), key=str) == sorted(map(row, simhash.keep_one_of_each(docs).select("doc_id", "text").collect()), key=str)
    assert simhash.keep_one_of_each(scan).columns == scan.columns


def test_dedup_judges_rows_that_share_an_id_by_their_own_text(spark):
    rows = [(3, "one two three four"), (7, "quite another text here"), (7, "one two three four"), (8, "first of eight"), (8, "second text of eight"), (8, "first of eight")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one_of_each(docs).collect())) == sorted({*rows[:2], *rows[3:5]})


def test_mixed_documents_stand_as_often_as_taken(docs):
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + (r.taken // r.size if r.size else 0)
    out = {}
    for r in mixing.mixed_documents(docs).collect():
        out[r.doc_id] = out.get(r.doc_id, 0) + 1
    assert out == {k: v for k, v in taken.items() if v}
