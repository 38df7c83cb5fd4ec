"""The pipeline and its stages against brute-force versions."""

import corpus_pipeline
from panelworks.llm import secrets
from tests.llm.test_operators import WORD, brute_lines, brute_near, brute_quality, check_packing, without_secrets


def test_pipeline_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows = [(i, t) for i, t in rows if brute_quality(t)[-1]]
    before = dict(rows)
    rows = [(i, t) for i, t in brute_lines(rows) if t == before[i] or WORD.search(t)]
    near = brute_near(rows)
    rows = [(i, t) for i, t in rows if near[i][2] == i]
    texts = {i: without_secrets(t) for i, t in rows}
    assert any(secrets.MASK in t for t in texts.values()) and len(texts) < len(before)
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == set(texts)
    check_packing(out, texts)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_keep_all_columns_as_they_are(spark, clashing):
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, clashing, "")
        others = [c for c in clashing.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
        assert out.columns == clashing.columns and out.count() > 0
        assert all(v == "x" for r in out.collect() for v in [r[c] for c in others])
        assert all(r.n_chars == len(r.text or "") for r in out.collect())
    assert corpus_pipeline.pack_stage(spark, clashing, "").count() > 0


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_quality_stage_odd(spark, odd_docs, empty_docs):
    assert rows_of(stage("quality rules")(spark, odd_docs, "")) == sorted(((r.doc_id, r.text) for r in odd_docs.collect() if brute_quality(r.text)[-1]), key=str)
    assert stage("quality rules")(spark, empty_docs, "").count() == 0


def test_lines_stage_odd(spark, docs_of, empty_docs):
    foot = "the same old footer"
    rows = [(i, f"{foot}\nown text of {'abcdefgh'[i]}") for i in range(1, 7)] + [(6, f"{foot}\nmore"), (7, foot), (8, None), (9, ""), (None, foot), (1, f"x {foot}\n{foot}")]
    want = [(1, rows[0][1]), (1, rows[-1][1]), *[(i, f"own text of {'abcdefgh'[i]}") for i in range(2, 7)], (6, "more"), (8, ""), (9, ""), (None, foot)]
    assert rows_of(stage("line dedup")(spark, docs_of(rows), "")) == sorted(want, key=str)
    assert stage("line dedup")(spark, empty_docs, "").count() == 0


def test_passages_of_few_documents_stay_once(spark, docs_of):
    passage = " ".join(f"word{k}" for k in range(120))
    rows = [(i, f"{passage}\nown text number {'abcd'[i]} and more of {'wxyz'[i]}") for i in range(4)]
    got = rows_of(stage("line dedup")(spark, docs_of(rows), ""))
    assert [passage in t for _, t in got] == [True, False, False, False] and all("own text" in t for _, t in got)


def test_harmless_values_pass_the_secrets_stage(spark, docs_of):
    from tests.llm.test_operators import HARMLESS

    rows = list(enumerate(HARMLESS))
    assert rows_of(stage("secret scans")(spark, docs_of(rows), "")) == sorted(rows, key=str)


def test_near_stage_loses_no_text(spark, docs_of, empty_docs, odd_docs):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (7, c), (7, d), (7, d), (8, d + " e"), (9, None), (3, ""), (None, " "), (None, "n n"), (None, "n  n"), (None, b), (2, "n")]
    want = [(1, a), (5, b), (7, c), (7, d), (3, ""), (2, "n")]
    got = rows_of(stage("n-gram Jaccard join")(spark, docs_of(rows), ""))
    assert [x for x in got if x[0] is not None] == sorted(want, key=str) and [t.split() for i, t in got if i is None] == [["n", "n"]]
    assert stage("n-gram Jaccard join")(spark, empty_docs, "").count() == 0
    assert sorted(r.doc_id for r in stage("n-gram Jaccard join")(spark, odd_docs, "").collect()) == [1, 4, 6, 8, 9]


def test_secrets_stage_odd(spark, docs_of, empty_docs):
    key = "3f786850e387550fdab836ed7e6dc881de23001b"
    rows = [(1, f"token = {key}"), (1, f"token = {key}"), (2, None), (3, ""), (None, "w " * 30_000 + f"password={key}")]
    want = [(1, "token = [SECRET]")] * 2 + [(2, ""), (3, ""), (None, "w " * 30_000 + "password=[SECRET]")]
    assert rows_of(stage("secret scans")(spark, docs_of(rows), "")) == sorted(want, key=str)
    assert stage("secret scans")(spark, empty_docs, "").count() == 0


def test_pack_stage_odd(spark, odd_docs, empty_docs):
    out = corpus_pipeline.pack_stage(spark, odd_docs, "").collect()
    assert sum(r.piece == 0 for r in out) == odd_docs.count() and all(r.length == 1 for r in out if r.doc_id in (1, 2))
    assert corpus_pipeline.pack_stage(spark, empty_docs, "").count() == 0


def test_pipeline_on_an_empty_table(spark, empty_docs, tmp_path):
    empty_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
