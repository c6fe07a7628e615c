"""Every operator over rows that are null, empty, very long, repeated or without an id, beside columns with clashing names, and over empty tables."""

import random
import string

import pytest
from pyspark.sql import functions as F

from waybill.llm import byte_bpe, decontaminate, html_text, language, near_dup, order_minhash, pii, secrets, suffix_dedup, toxicity

rng = random.Random(21)
WORDS = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 8))) for _ in range(3000)]
prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
LONG = prose(60_000)
ROWS = [(1, LONG), (2, LONG), (3, "x" * 60_000), (4, None), (5, ""), (6, " \n"), (7, prose(40)), (7, prose(40)), (None, prose(30)), (8, "a@b.example 10.0.0.1 password=abcdefgh1234"), (8, "a@b.example 10.0.0.1 password=abcdefgh1234"), (9, "é日本😀 " * 50)]
CLASH = ["key", "hash", "bucket", "part", "end", "own", "digest", "anchor", "spans", "base", "tried", "score", "held_out", "row", "text_key", "words", "h", "k", "node", "component", "a", "b", "t", "v", "id", "at", "base_", "spans_", "done_", "c0", "c1", "toxic", "keep"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if (i or 0) % 2 else "de", "s", len(t or "")) for i, t in ROWS]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(7, 1), (1, 0), (2, 0), (8, 0), (3, None)], "doc_id bigint, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, prose(20)), (2, None), (3, ""), (4, "two words")], "item_id bigint, text string").select("*", F.lit(1).alias("h"), F.lit(2).alias("words"))


def whole(docs, found, id_="doc_id"):
    """One row a row, and equal rows for equal rows."""
    rows = list(map(tuple, found.collect()))
    assert len(rows) == len(ROWS)
    at = found.columns.index(id_)
    assert len({r for r in rows if r[at] == 8}) == 1
    return rows


def test_toxicity(docs, labels):
    whole(docs, toxicity.score_documents(docs, labels))
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and toxicity.drop_toxic(docs.filter("false"), labels).count() == 0


def test_suffix_dedup(docs):
    rows = {r[0]: r for r in whole(docs, suffix_dedup.repeat_report(docs))}
    assert rows[1][2] == len(LONG) == rows[2][2] and rows[3][2] == 60_000 and rows[4][1] == 0


def test_pii(docs):
    rows = {r[0]: r for r in whole(docs, pii.pii_report(docs))}
    assert rows[8][1:3] == (1, 1) and rows[1][1:5] == (0, 0, 0, 0)
    masked = pii.redact(docs)
    assert masked.columns == docs.columns and masked.filter("doc_id = 8").first().text.startswith("<email> <ip> ") and masked.filter("base_ = 'clash'").count() == len(ROWS)
    assert pii.redact(docs.filter("false")).count() == 0


def test_near_duplicates(docs):
    rows = {r[0]: r for r in whole(docs, near_dup.near_duplicates(docs))}
    assert rows[2][2] == 1 and not rows[2][3]
    kept = near_dup.keep_one(docs, near_dup.NearDupParams())
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "7", "7", "None", "8", "9"])  # two texts of one id stay, of equal rows one


def test_decontamination(docs, bench):
    assert decontaminate.contaminated(docs, bench).count() == 0
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert decontaminate.contaminated(docs.filter("false"), bench.filter("false")).count() == 0


def test_secrets(docs):
    rows = {r[0]: r for r in whole(docs, secrets.secret_report(docs))}
    assert rows[8][1] == 1 and rows[1][1:4] == (0, 0, 0)


def test_language(docs):
    rows = {r[0]: r for r in whole(docs, language.detect_languages(docs))}
    assert rows[4][2] == rows[5][2] == rows[6][2] == "und"


def test_fingerprints(docs):
    for size in (2000, 3):
        rows = {r[0]: r for r in whole_ids(order_minhash.fingerprints(docs, order_minhash.OrderParams(rows=size)))}
        assert rows[1][3] == rows[2][3] and rows[1][1] == len(LONG)


def whole_ids(found):
    rows = list(map(tuple, found.collect()))
    assert len(rows) == len(ROWS)
    return rows


def test_byte_bpe(docs):
    vocabulary = pytest.importorskip("public_tokenizers")
    whole(docs, byte_bpe.token_digests(docs, vocabulary.path("byte_bpe_multi_50k.tiktoken"), vocabulary.PATTERN))


def test_html(spark):
    rows = [(1, "u", "<p>" + LONG), (1, "u", "<p>" + LONG), (None, None, None), (2, "u", ""), (3, "u", "<p>" * 5000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").select("*", F.lit(1).alias("text"), F.lit(2).alias("n_chars"))
    got = sorted(map(tuple, html_text.extract_pages(pages).collect()), key=repr)
    assert got == sorted([(1, "u", LONG, len(LONG))] * 2 + [(None, None, "", 0), (2, "u", "", 0), (3, "u", "", 0)], key=repr)
