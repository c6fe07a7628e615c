"""The pipeline keeps, drops and masks what its stages decide, over a small folder of tables."""

import random

import corpus_pipeline

rng = random.Random(3)
WORDS = [f"w{i}x" for i in range(300)]
prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))


def test_run(spark, tmp_path):
    item = prose(25)
    docs, labels = [], []
    for i in range(200):
        toxic = i % 4 == 0
        words = prose(40).split()
        if toxic:
            words[rng.randrange(40)] = "scumlord"
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs += [(500, docs[1][1]), (501, docs[1][1] + " end"), (502, prose(20) + " " + item), (503, prose(20) + " mail a@b.example"), (504, None), (505, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    clean = {i for i, _, toxic in labels if not toxic}
    assert len(kept & clean) >= 0.95 * len(clean) and len(kept & ({i for i, *_ in labels} - clean)) <= 5
    assert not kept & {500, 501, 502} and {503} <= kept


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _folder(spark, path, rows, item="one two three four five six seven eight nine ten"):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).selectExpr("*", "'clash' AS key", "'clash' AS spans_", "'clash' AS component_id", "'clash' AS c0").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_awkward_rows(spark, tmp_path):
    """Each stage on its own against what its operator's rules give: nulls, repeats, long texts, no ids, clashing columns."""
    long = prose(30000)
    rows = [(1, prose(50)), (2, None), (2, None), (3, ""), (None, prose(20)), (None, None), (4, long), (5, long + " end"), (6, prose(9) + " one two three four five six seven eight nine ten"), (7, "mail a@b.example now"), (7, "mail a@b.example now")]
    path = _folder(spark, tmp_path / "a", rows)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, path)
        assert found.columns == docs.columns and found.filter("spans_ <> 'clash' OR c0 <> 'clash'").count() == 0, name
        assert stage(spark, docs.filter("false"), path).count() == 0, name
    kept = sorted((str(r.doc_id), r.n_tokens) for r in corpus_pipeline.run(spark, path).collect())
    assert [k for k, _ in kept] == sorted(["1", "2", "3", "None", "None", "4", "7"])
    assert [n for k, n in kept if k in ("2", "3")] == [0, 0]


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, _folder(spark, tmp_path / "b", [])).count() == 0
