"""Interleaved shards, fill-in-the-middle and periodic runs against brute force over plain, awkward and skewed rows."""

import collections
import hashlib
import random
import re
import string
import zlib

import pytest
from pyspark.sql import functions as F

from waybill.llm import fill_middle, interleave, runs

rng = random.Random(5)
WORDS = ["".join(rng.choice(string.ascii_letters) for _ in range(rng.randint(1, 8))) for _ in range(300)]
prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
LOOP = " ".join(WORDS[:7])
LONG = prose(3000) + " " + " ".join([prose(600)] * 5)
TEXTS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "é日本😀 " * 50), (6, "one <S> two"), (7, LONG), (8, " ".join([LOOP] * 6) + " " + prose(30)), (9, "x " * 400), (10, prose(40)), (10, prose(40)),
    (None, prose(30)), (None, None), (11, " ".join([LOOP] * 3)), (12, "ab ab ab ab ab ab cd cd cd cd cd cd cd ab"), (13, "<" + prose(20) + "<S"), (14, "naïve\x0bcafé\x0cü ü ü ü ü ü ü"), (15, "😀"), (10, prose(40)),
]
TEXTS += [(i, prose(rng.randint(1, 120))) for i in range(16, 140)] + [(7000, TEXTS[9][1])] * 2


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if (i or 0) % 9 == 0 else "" if (i or 0) % 9 == 1 else f"s{(i or 0) % 4}", len(t or "")) for i, t in TEXTS]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clash = ("row", "stratum", "draw", "bucket", "place", "bin", "number", "position", "shard", "slot", "size", "octave", "first", "marks", "words", "runs", "start", "period", "length", "n", "form", "output")
    return df.select("*", *(F.lit("clash").alias(c) for c in clash))


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_shards(docs):
    for p in (interleave.InterleaveParams(), interleave.InterleaveParams(rows_per_bucket=3, least_buckets=1), interleave.InterleaveParams(least_buckets=1), interleave.InterleaveParams(shards=5, seed=2)):
        found = interleave.positions(docs, p).collect()
        assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in found) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS)
        slots = collections.defaultdict(list)
        for r in found:
            slots[r.shard].append(r.slot)
        assert sorted(slots) == list(range(p.shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
        mix = collections.Counter((r.source, r.shard) for r in found)
        of = collections.Counter(r.source for r in found)
        assert all(abs(mix[s, k] - n / p.shards) <= 2 for s, n in of.items() for k in range(p.shards))


def test_shards_equal_a_plain_sort(docs):
    """The distributed ranks and positions are those of one sort in memory."""
    p = interleave.InterleaveParams(rows_per_bucket=4, least_buckets=1)
    rows = docs.select("doc_id", "text", "source").dropDuplicates()
    unit = lambda seed, *c: interleave._unit(seed, *c).alias("u")
    told = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    drawn = rows.select("doc_id", "source", "text", unit(p.seed, F.col("doc_id"), F.col("text")), unit(p.seed + 1, told).alias("offset")).collect()
    by = collections.defaultdict(list)
    for r in drawn:
        by[r.source].append(r)
    order = sorted((((k + r.offset) / len(rs)), r.source or "", str(r.doc_id), r.text) for rs in by.values() for k, r in enumerate(sorted(rs, key=lambda r: r.u)))
    n = len(order)
    expected = collections.Counter((i, t, k * p.shards // n, k - -(-(k * p.shards // n) * n // p.shards)) for k, (_, _, i, t) in enumerate(order))
    got = interleave.shards(rows, p=p)
    assert collections.Counter((str(r.doc_id), r.text, r.shard, r.slot) for r in got.collect()) == expected


def test_one_source_and_lone_sources(spark):
    """Half of the rows in one source, half each in its own: lone sources spread over all shards."""
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 2 == 0, "big").otherwise(F.concat(F.lit("s"), "id")).alias("source"))
    found = interleave.positions(rows).groupBy("shard").agg(F.count_if(F.col("source") == "big").alias("big"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.n == 250 and 95 <= r.big <= 155 for r in found) and len(found) == 16


def test_written_shards(docs, tmp_path):
    interleave.write_shards(docs, str(tmp_path / "out"))
    back = docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(TEXTS) and {c for c in back.columns} == set(docs.columns)
    assert sorted(r.slot for r in back.filter("shard = 3").collect()) == list(range(back.filter("shard = 3").count()))


def test_interleave_is_native(docs):
    plan = interleave.positions(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "CartesianProduct" not in plan


def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h4 % 100 < 20 else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, n, "spm" if h4 % 100 < 20 else "psm", len(pre), len(mid), sha(out), sha(text)


def test_middle(docs):
    expected = sorted((plain_middle(i, t) for i, t in TEXTS), key=repr)
    assert as_rows(fill_middle.middle_digests(docs)) == expected
    assert {r[2] for r in expected} == {"plain", "psm", "spm"}
    assert fill_middle.middle_digests(docs.filter("false")).count() == 0


def test_exception_index():
    import numpy as np

    for _ in range(300):
        text = "".join(rng.choice(["a", "z", " ", "é", "日", "😀", "́", "<"]) for _ in range(rng.randint(0, 40)))
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        index = fill_middle.ExceptionIndex(data)
        for c in range(len(text) + 1):
            assert index.to_bytes(c) == len(text[:c].encode()) and index.to_chars(len(text[:c].encode())) == c
        assert len(index.byte_at) == sum(len(x.encode()) > 1 for x in text)
        starts = [len(text[: m.start()].encode()) for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)]
        assert fill_middle.token_starts(data).tolist() == starts


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((start, length, q) for (start, length), q in found.items())


def plain_report(doc_id, text):
    w = runs.contract_words(doc_id, text)
    assert w == naive_words(doc_id, text)
    found = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in dropped)))


def naive_words(doc_id, text):
    w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def test_runs(docs):
    expected = sorted((plain_report(i, t) for i, t in TEXTS), key=repr)
    assert sum(r[1] > 0 for r in expected) > 8
    for p in (runs.RunParams(), runs.RunParams(tile_words=64, chunk_chars=500)):
        assert as_rows(runs.run_report(docs, p)) == expected
    assert runs.run_report(docs.filter("false")).count() == 0


def test_runs_and_their_texts(docs):
    found = {(r.doc_id, r.start, r.length, r.period) for r in runs.periodic_runs(docs).collect()}
    assert found == {(i, *r) for i, t in TEXTS for r in brute_runs((t or "").split() if i != 14 else (t or "").encode().split())}
    texts = {r.doc_id: r.text for r in runs.collapsed(docs).filter("text is not null").collect()}
    assert texts[9] == "x" and texts[8].startswith(LOOP + " ") and len(texts[8].split()) <= 37 and 10 not in texts


def test_one_long_document_is_many_tiles(spark):
    """A document of 120,000 words with a loop of 25,000 twelve-word rounds' neighbours: its tiles are dealt out, and no tile holds the whole text."""
    text = prose(20_000) + " " + " ".join([prose(12)] * 5000) + " " + " ".join([prose(9000)] * 5)
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    seen = runs.tiled(docs, runs.plain_words, runs.RunParams(tile_words=2048)).filter("octave is not null").selectExpr("octave", "size(words) w").collect()
    assert len(seen) > 30 and max(r.w for r in seen if r.octave < 256) < 2048 + 5 * 256
    found = {(r.start, r.length, r.period) for r in runs.periodic_runs(docs, runs.RunParams(tile_words=2048)).collect()}
    assert any(p == 12 and length >= 60_000 for _, length, p in found) and any(p == 9000 and length >= 45_000 for _, length, p in found)


def test_the_training_draw_works_for_any_number_of_rows(spark):
    """Counts of a corpus: the share drawn never rounds to nothing, and repeats of a row count once."""
    from waybill.llm import common

    for n in (10, 10**9, 10**14):
        limit = common.sample_limit(300, n)
        assert abs(limit / (1 << 63) * n - min(n, 300)) < 1e-3 * 300
    rows = spark.createDataFrame([(1, "a" * 1000, 0)] * 5000 + [(i, f"text {i}", i % 2) for i in range(2, 600)], "doc_id bigint, text string, toxic int")
    drawn = common.bounded_sample(rows, "toxic", ["doc_id", "text"], 50)
    found = drawn.groupBy("toxic").count().collect()
    assert all(20 <= r["count"] <= 90 for r in found) and drawn.distinct().count() == drawn.count()
    kept = common.within_chars(common.bounded_sample(rows, "toxic", ["doc_id", "text"], 10**6), "toxic", ["doc_id", "text"], 3000)
    assert kept.agg(F.sum(F.length("text"))).first()[0] <= 3000 and kept.filter("doc_id = 1").count() <= 1
    assert common.bounded_sample(rows.filter("false"), "toxic", ["doc_id", "text"], 5).count() == 0
    fake = common._drawn(rows, "toxic", F.shiftrightunsigned(F.xxhash64("doc_id"), 1), [(0, 10**9), (1, 2)], 300)
    assert fake.filter("toxic = 1").count() == 299 and fake.filter("toxic = 0").count() <= 5
