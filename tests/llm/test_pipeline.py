import numpy as np

import corpus_pipeline as P
from strandlake.llm import jaccard_join, packing, suffix_dedup, toxicity
from strandlake.llm.queries import table, tokenizer_file

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    """Each stage works on all that the one before kept; run() gives what the stages give one by one."""
    docs = table(spark, SF, "documents")
    kept = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == list(P.COLUMNS)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        old = {r.doc_id for r in before.select("doc_id").collect()}
        assert ids <= old and len(ids) == docs.count()
        if name == "toxicity":
            known = table(spark, SF, "labels").withColumnRenamed("toxic", "label")
            w = toxicity.train(before.where(~toxicity.held_out()), known)
            assert old - ids == {r.doc_id for r in toxicity.score(before.select("doc_id", "text"), w).where("score >= 0.3").collect()}
        elif name == "near_duplicates":
            classes = {r.doc_id: r.class_id for r in jaccard_join.jaccard_classes(before).collect()}
            assert ids == {d for d, c in classes.items() if d == c}
        else:
            assert ids == old
            cut = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(before).collect()}
            for r in docs.collect():
                assert r.text == cut[r.doc_id].decode("utf-8", "ignore")
        kept.append(len(ids))
    assert kept[0] > kept[2]
    got = sorted(P.run(spark, SF).collect())
    tokens = {r.doc_id: r.doc_tokens for r in got}
    assert set(tokens) == ids
    for d, n in tokens.items():
        assert sum(r.length for r in got if r.doc_id == d) == n
    want = packing.pack(docs, tokenizer_file("word_bpe_49k.json")).collect()
    assert sorted((r.doc_id, r.doc_tokens) for r in want if r.start == 0) == sorted((r.doc_id, r.doc_tokens) for r in got if r.start == 0)


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "é" * 60 + "x" * 60, "en", "s", 120), (4, "y" + "é" * 60, "en", "s", 61), (None, "q", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    near = P.near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id for r in near.collect() if r.doc_id is not None) == [1, 3, 4]
    cut = {r.doc_id: r for r in P.repeated_passages(spark, docs, SF).collect()}
    assert cut[4].text == "y" and cut[4].n_chars == 1
    assert cut[3].text == "é" * 60 + "x" * 60
    assert cut[None].text == "q"
    empty = docs.where("false")
    for name, stage in P.STAGES:
        if name != "toxicity":
            assert stage(spark, empty, SF).count() == 0
    assert np.array_equal(P.toxicity(spark, empty, SF).collect(), [])


def test_repeats_long_texts_extra_columns_and_no_labels(spark, tmp_path):
    """Rows that repeat a doc_id, a very long text and columns named like inner ones go through the stages; without labels nothing is toxic."""
    words = [f"w{k % 977}x{k % 13}" for k in range(60_000)]
    rows = [(1, "one text of some words here", "en", "s", 27, 9, "a"), (1, "one text of some words here", "en", "s", 27, 9, "b"), (1, "another text under the same number", "en", "s", 34, 9, "c")]
    rows += [(2, " ".join(words), "en", "s", 1, 9, "d"), (3, "new " + " ".join(words), "en", "s", 1, 9, "e"), (4, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, kept string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    first = P.toxicity(spark, docs, str(tmp_path))
    assert first.columns == list(P.COLUMNS) and first.count() == len(rows)
    near = P.near_duplicates(spark, first, str(tmp_path))
    assert sorted(r.doc_id for r in near.collect()) == [1, 1, 1, 2, 4]
    done = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in done} == {1, 2, 4}
    assert sum(r.length for r in done if r.doc_id == 2) > 60_000
