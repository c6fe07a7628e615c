"""The text operators against brute force, exact round trips or held-out accuracy, edge cases included."""

import collections
import hashlib
import random
import re
import string
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waybill.llm import byte_bpe, decontaminate, html_text, induced, language, near_dup, order_minhash, pii, secrets, suffix_dedup, toxicity

rng = random.Random(7)
WORDS = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 8))) for _ in range(400)]
prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
PASSAGE = prose(120)
BASE = prose(200).split()


def _documents():
    near = " ".join(BASE[:100] + ["changed"] + BASE[101:])
    rows = [(1, prose(300)), (2, PASSAGE + " " + prose(50)), (3, prose(40) + " " + PASSAGE), (4, " ".join(BASE)), (5, near), (6, " ".join(BASE)), (7, "aaaa " * 300), (8, None), (9, ""), (10, "one two"), (11, "One two"), (12, " \t\n"), (13, "é日本😀 " * 120), (13, "é日本😀 " * 120), (None, prose(30)), (15, "x" * 5000)]
    return rows


DOCUMENTS = _documents()
documents = lambda: DOCUMENTS


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in documents()]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "'clash' AS component_id", "'clash' AS score", "'clash' AS spans", "'clash' AS key")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def test_suffix_dedup(docs, empty):
    texts = [(i, (t or "").encode()) for i, t in documents()]
    seen = collections.Counter(t[k : k + 400] for _, t in texts for k in range(len(t) - 399))
    expected = []
    for i, t in texts:
        cover = bytearray(len(t))
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                cover[k : k + 400] = b"\1" * 400
        kept = bytes(b for b, c in zip(t, cover) if not c)
        spans = sum(1 for k, c in enumerate(cover) if c and (k == 0 or not cover[k - 1]))
        expected.append((i, len(t), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    for crowd in (2000, 1):
        got = suffix_dedup.repeat_report(docs, suffix_dedup.SuffixParams(crowd=crowd)).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert suffix_dedup.repeat_report(empty).count() == 0


def _near_copies(n):
    """Regions as sort_shards has them: passages with changes, runs of one letter, repeated lines; and the starts that repeat."""
    g = random.Random(n)
    passage = "".join(g.choice("abcd") for _ in range(150))
    rows = []
    for _ in range(n):
        t = list(passage[g.randint(0, 40) : g.randint(110, 150)])
        for _ in range(g.choice([0, 1, 1, 2])):
            t[g.randrange(len(t))] = g.choice("xyz")
        rows.append("".join(t).encode())
    rows += [b"q" * 90, b"".join(b"line of %d words " % (k % 3) for k in range(20)), rows[0], bytes(g.choice(b"efgh") for _ in range(100))]
    seen = collections.Counter(t[k : k + 40] for t in rows for k in range(len(t) - 39))
    return rows, [{k for k in range(len(t) - 39) if seen[t[k : k + 40]] > 1} for t in rows]


def test_suffix_dedup_sorts_only_what_may_repeat(monkeypatch):
    for n, cores in ((1, 8), (5, 1), (12, 3), (30, 8), (30, 100)):
        p = suffix_dedup.SuffixParams(length=40, gram=6, block=1 << (n % 9), cores=cores)
        rows, expected = _near_copies(n)
        for collide in (False, True):  # hashes that are all equal cost time and change nothing
            with monkeypatch.context() as m:
                if collide:
                    m.setattr(suffix_dedup, "range_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
                known, open_ = suffix_dedup.narrowed(rows, p)
            got = [set() for _ in rows]
            for r, a, b in known:
                got[r] |= set(range(a, b))
            pieces = [np.append(np.frombuffer(rows[r][a : b + 39], np.uint8).astype(np.uint16) + 2, 1).astype(np.uint16) for r, a, b in open_]
            hit, at = induced.repeated_starts(np.concatenate([*pieces, np.zeros(1, np.uint16)]).astype(np.uint16), 40) if pieces else [], 0
            for r, a, b in open_:
                got[r] |= {a + k for k in range(b - a) if hit[at + k]}
                at += b - a + 40
            assert got == expected
            assert collide or sum(b - a + 39 for _, a, b in open_) < sum(map(len, rows)) and not {n, n + 3} & {r for r, _, _ in open_}


def test_suffix_dedup_near_copies_beyond_a_crowd(spark):
    """Few crowded cores are met where their rows lie, the others by a shuffle: a table with both, equal to counting all strings."""
    g = random.Random(3)
    texts = []
    for passages, copies in ((1, 60), (6, 4)):
        for _ in range(passages):
            passage = prose(130)
            for _ in range(copies):
                at = g.randrange(len(passage))
                texts.append((passage[:at] + "#" + passage[at + g.randint(0, 3) :])[g.randint(0, 30) :])
    seen = collections.Counter(t[k : k + 400] for t in texts for k in range(len(t) - 399))
    expected = {i: len(set().union(*(range(k, k + 400) for k in range(len(t) - 399) if seen[t[k : k + 400]] > 1))) for i, t in enumerate(texts)}
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for crowd in (3, 12):
        assert {r.doc_id: r.n_removed for r in suffix_dedup.repeat_report(table, suffix_dedup.SuffixParams(crowd=crowd)).collect()} == expected


def test_induced_sorting(monkeypatch):
    for trial in range(120):
        text = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 70))] * rng.randint(1, 3) + [0]
        monkeypatch.setattr(induced, "CHUNK", rng.choice([3, 7, 1 << 16]))
        monkeypatch.setattr(induced, "NAME_ROUNDS", rng.choice([0, 1, 48]))
        monkeypatch.setattr(induced.Range, "BLOCK", rng.choice([1, 2, 32]))
        order, common = induced.suffix_order(np.array(text, np.uint16), 10**6, rng.choice([100, 1 << 26]), rng.choice([1, 2, 5, 1 << 20]))
        assert list(order) == sorted(range(len(text)), key=lambda i: text[i:])
        for a, b, c in zip(order, order[1:], common[1:]):
            x, y = text[a:], text[b:]
            assert c == next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


class Watched(induced.Scratch):
    made: list = []

    def __init__(self, memory):
        super().__init__(memory)
        self.made.append(self)


def _shard(n):
    g = np.random.default_rng(1)
    text = g.integers(97, 123, n).astype(np.uint16)
    text[n // 2 : n // 2 + 4000] = text[1000:5000]
    expected = np.zeros(n + 1, bool)
    expected[1000:4601] = expected[n // 2 : n // 2 + 3601] = True
    return np.append(text, 0).astype(np.uint16), expected


def test_induced_sorting_spills_and_recurses_at_the_defaults(monkeypatch):
    monkeypatch.setattr(induced, "Scratch", Watched)
    p = suffix_dedup.SuffixParams()
    text, expected = _shard(p.shard)
    assert (induced.repeated_starts(text, p.length, p.memory) == expected).all()
    assert Watched.made[-1].spills > 0 and Watched.made[-1].levels > 0


def test_induced_sorting_of_a_large_shard():
    """Shards of five and twenty times the budget: every repeat is found, and what lies in memory hardly grows with the shard."""
    peaks = []
    for n in (200_000, 800_000):
        text, expected = _shard(n)
        tracemalloc.start()
        hit = induced.repeated_starts(text, 400, 40_000)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert (hit == expected).all()
    assert peaks[1] < 16_000_000 and peaks[1] < 2 * peaks[0]


def test_induced_recursion_over_a_million_names():
    g = np.random.default_rng(2)
    names = np.append(np.unique(g.integers(0, 200_000, 1_000_000), return_inverse=True)[1] + 1, 0)
    scratch = induced.Scratch(1 << 20)
    start = time.process_time()
    order, _ = induced.recursive_order(names, 400, scratch, 1 << 10)
    assert time.process_time() - start < 60
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    a, b = np.array(order[1:-1]), np.array(order[2:])  # neighbours are in order by symbol, then by the rest's rank
    assert ((names[a] < names[b]) | ((names[a] == names[b]) & (rank[a + 1] < rank[b + 1]))).all()
    scratch.close()


def test_near_duplicates(docs, empty):
    sets = {}
    for i, t in documents():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(len(w) - 2, 1))} if w else set()
    group = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a is not None and b is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    for r in near_dup.near_duplicates(docs).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), group[r.doc_id])
        assert r.kept == (None if r.doc_id is None else r.doc_id == group[r.doc_id])
    assert near_dup.near_duplicates(empty).count() == 0


KINDS = ["email", "ip", "card", "phone"]
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def pii_base(text):
    def good(k, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(x - 9 if x > 9 else x for x in (int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d)))) % 10 == 0
        return [True, k != 1 or all(int(x) < 256 for x in m.split(".")), 14 <= len(d) <= 19 and luhn, 10 <= len(d) <= 15][k]

    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if good(k, m[0]))


def test_pii(spark, docs, empty):
    tricky = ["a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4", "+1 (743) 555-3824 +12 4111 1111 1111 1111 4111-1111-1111-1111-", "é@x.y.z 日本+4915112345678.", "a" * 20000, "1" * 9000, "a@b a@b.c@d.e", "+1+12345678901 (2) ", None, ""]
    rows = list(enumerate(tricky))
    got = {r.doc_id: r for r in pii.pii_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows:
        base = pii_base(t or "")
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(b[1] == n for b in base) for n in range(4)]
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
    assert pii.pii_report(empty).count() == 0 and pii.pii_report(docs).count() == len(documents())


def test_pii_bootstrap_and_redaction(spark):
    rows = [(i, f"write to the account number 10.20.30.{i} today") for i in range(12)] + [(50, "write to the account number 10.20.30.999 today"), (51, "nothing here 12345678"), (52, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "CAST(length(text) AS BIGINT) AS n_chars")
    got = {r.doc_id: r for r in pii.pii_report(df, pii.PiiParams(trust=0.9)).collect()}
    assert got[50].n_found == 1 and got[51].n_found == 0
    masked = {r.doc_id: r for r in pii.redact(df).collect()}
    assert masked[0].text == "write to the account number <ip> today" and masked[50].text == "write to the account number <found> today"
    assert masked[51].text == "nothing here 12345678" and masked[52].text is None and masked[0].n_chars == len(masked[0].text)


def test_pii_finds_unseen_identifiers(spark):
    """Half of the identifiers in special contexts are of a form that no fixed pattern knows: most are found, and no number in plain prose is."""
    rows, unseen = [], set()
    for i in range(120):
        lead = rng.choice(["customer record", "member file", "reach them via"])
        known = i % 2 == 0
        one = f"10.{i}.{i % 7}.9" if known else f"10.{i}.{i % 7}.999"
        rows.append((i, f"{prose(12)} {lead} {one} {prose(12)}"))
        if not known:
            unseen.add(i)
    rows += [(1000 + i, f"{prose(9)} {rng.choice(WORDS)} {rng.randrange(10**5, 10**6)} {prose(9)}") for i in range(100)]
    got = {r.doc_id: r.n_found for r in pii.pii_report(spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS seed", "'x' AS core")).collect()}
    assert np.mean([got[i] == 1 for i in unseen]) >= 0.9
    assert not any(got[i] for i in got if i not in unseen)
    many = pii.pii_report(spark.createDataFrame(rows, "doc_id bigint, text string"), pii.PiiParams(broadcast=0)).collect()
    assert {r.doc_id: r.n_found for r in many} == got


def test_pii_contexts_on_the_right(spark):
    """Words after an identifier bear it out as words before it do; one word and two, on each side."""
    one = spark.createDataFrame([("ask aa bb 12345678 cc dd now",)], "text string")
    (m,) = one.select(F.explode(pii.instances(F.col("text"), pii.base_spans(F.col("text")))).alias("w")).select("w.*").collect()
    assert (m.left2, m.left, m.right, m.right2) == ("aa", "bb", "cc", "dd")
    value = lambda i: f"10.{i}.{i % 7}.9" if i % 2 == 0 else f"10.{i}.{i % 7}.999"
    rows = [(i, f"{prose(12)} {value(i)} belongs truly {prose(12)}") for i in range(120)] + [(1000 + i, f"{prose(9)} {rng.randrange(10**5, 10**6)} {prose(9)}") for i in range(100)]
    got = {r.doc_id: r.n_found for r in pii.pii_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert np.mean([got[i] == 1 for i in range(1, 120, 2)]) >= 0.9 and not any(got[i] for i in got if i >= 1000 or i % 2 == 0)


def test_phrases_are_counted_before_they_are_shuffled(spark):
    """Few phrases and many give the counts of a plain reading; of many, each task shuffles a row a phrase and no row a word."""
    texts = [" ".join(rng.choice(["sun", "moon", "sea"]) for _ in range(400)) for _ in range(40)] + ["", "sun"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    phrases = spark.createDataFrame([("sun",), ("sun moon",), ("never",)], "phrase string")
    words = [t.split() for t in texts]
    expected = {"sun": sum(w.count("sun") for w in words), "sun moon": sum(a == "sun" and b == "moon" for w in words for a, b in zip(w, w[1:]))}
    for few in (True, False):
        found = pii.phrase_counts(F.col("text"), rows, phrases, few)
        assert {r.phrase: r.times for r in found.collect()} == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan[plan.index("Exchange hashpartitioning(phrase") :]


def test_decontamination(spark, docs, empty):
    item = "A train leaves the old station with 120 people and 35 kg of mail while Alice waits for Bob at the gate"
    other = item.replace("120", "77").replace("35", "9").replace("Alice", "Carol").replace("Bob", "Dave")
    rows = [(1, prose(30) + " " + item + " " + prose(30)), (2, prose(20) + ". " + other + ", " + prose(5)), (3, prose(100)), (4, None), (5, ""), (None, item), (6, " ".join(item.split()[:6]))]
    bench = spark.createDataFrame([(7, item), (8, item), (9, "too short"), (10, None)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.verbatim_slots for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert got == {(1, 7): True, (2, 7): False}
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.filter("false")).count() == 0
    assert decontaminate.drop_contaminated(docs, bench).count() == len(documents())


def test_decontamination_of_short_items(spark):
    """Items of 8, 9 and 10 tokens, and shared passages of them, are met at every offset."""
    bench = spark.createDataFrame([(n, " ".join(f"q{chr(97 + n)}{w}" for w in WORDS[:n])) for n in (8, 9, 10)], "item_id bigint, text string")
    rows = [(100 * r.item_id + k, prose(20 + k) + " " + r.text + " " + prose(20)) for r in bench.collect() for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.matched_windows) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(100 * n + k, n, n - 7) for n in (8, 9, 10) for k in range(4)}


def test_decontamination_of_slot_heavy_items(spark):
    """Items of numbers or names are found as exact copies, whatever stands before them, and not with other values."""
    items = [(1, "Add 12 and 7 and 31 and 5 and 88 and 4 and 90"), (2, "12 7 31 5 88 4 90 6 45 1"), (3, "Anna Bela Carla Dora Emma Fiona Greta Hanna Ines"), (4, "12 7 31 5 88 4 90 6 45 2")]
    rows = [(10 * i + k, prose(20 + k) + before + t + " " + prose(9)) for i, t in items for k, before in enumerate([". ", " ", ", "])]
    rows += [(100, prose(20) + " 3 8 32 15 81 14 91 16 46 11 " + prose(9))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert got == {(10 * i + k, i) for i, _ in items for k in range(3)} | {(10 * i + k, 6 - i) for i in (2, 4) for k in range(3)}


def test_decontamination_finds_every_verbatim_item(spark):
    """Items of 3 to 30 tokens, with and without numbers, and all items of one template, against a search of the words."""
    own = lambda n, k: [f"{chr(97 + k)}x{w}" for w in WORDS[:n]]
    items = [(n, " ".join(own(n, k % 26))) for k, n in enumerate(range(3, 31))]
    items += [(100 + n, " ".join(x for i in range(n) for x in (str(7 * i + n), "plus"))) for n in range(2, 12)]
    items += [(200 + n, f"A farmer sells {n} apples and {3 * n + 1} pears at the market before noon") for n in range(4)]
    rows = [(i, prose(15) + ". " + t + ". " + prose(15)) for i, t in items] + [(900, prose(80)), (901, "A farmer sells 50 apples and 60 pears at the market before noon")]
    bench, docs = spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "'x' AS words")
    got = {(r.doc_id, r.item_id): r.verbatim_slots for r in decontaminate.contaminated(docs, bench).collect()}
    held = {(d, i) for d, text in rows for i, item in items if f" {item} " in f" {text} ".replace(".", "")}
    assert held <= set(got) and all(got[pair] for pair in held)
    assert not {i for d, i in got if d == 900} and {i for d, i in got if d == 901} == {200}
    assert all(not got[pair] for pair in set(got) - held if pair[0] in (901, *range(200, 204)))


def test_decontamination_tries_every_place(spark):
    """A true copy behind a passage of the same template whose slots do not fit."""
    item = "A train leaves the old station with 120 people and 35 bags of mail and 47 boxes of fruit and then waits 61 hours at the gate"
    wrong = re.sub("[0-9]+", "5", item)
    docs = spark.createDataFrame([(1, wrong + ". " + prose(12) + ". " + item), (2, item + ". " + prose(12) + ". " + wrong), (3, wrong)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    got = {(r.doc_id, r.verbatim_slots) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, True), (2, True)}


def test_html():
    page = "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><a href=x>menu</a></nav><header>Site</header><article><h1>Head &amp; line</h1><p>One <b>bold</b>\n text<br>more<p>Two &eacute;<form>send</form><section class='comments'><p>first!</section></article><aside>side</aside><footer>&copy; x</footer>"
    assert html_text.main_text(page) == "Head & line\n\nOne bold text more\n\nTwo é"
    plain = "<body><div id=cookie-notice>We use cookies on this site and so on and on</div><div><p>The first long paragraph of text.</p><p>The second long one, as well.</p></div><div class='sidebar'><a>x</a></div></body>"
    assert html_text.main_text(plain) == "The first long paragraph of text.\n\nThe second long one, as well."
    assert [html_text.main_text(p) for p in (None, "", "<p>", "<<<>>>")][:3] == ["", "", ""]
    assert html_text.main_text("<p>" * 3000 + "deep") == "deep"


def _page(wrap, parts, extra=""):
    article = "".join(f"<p>{p}</p>" for p in parts)
    return f"<html><body><div class='menu'><a href=a>Home</a><a href=b>News</a></div>{wrap[0]}<h1>The title</h1>{article}{wrap[1]}{extra}<footer>foot</footer></body></html>"


def test_html_density_decides_without_article_tags():
    """Pages whose markup names no article: the parts come from the density sums and the threshold."""
    parts = [prose(40) + "." for _ in range(6)]
    expected = "\n\n".join(["The title", *parts])
    links = "<div>" + "".join(f"<a href={i}>{w}</a>" for i, w in enumerate(WORDS[:60])) + "</div>"
    for wrap in (("<div id=wrap><div class='no-sidebar'>", "</div></div>"), ("<table><tr><td>", "</td></tr></table>"), ("<div><section>", "</section></div>")):
        assert html_text.main_text(_page(wrap, parts, links)) == expected
    root, events = html_text.parse(_page(("<div>", "</div>"), parts, links))
    html_text.drop_furniture(root, events)
    chosen = html_text.select(root, events)
    assert [n.tag for n in chosen] == ["div"] and chosen[0].parent.tag == "body"


def test_html_densities_by_hand():
    """Composite density and sums of every node, worked out from the page's text by another way."""
    root, events = html_text.parse("<body><div><p>" + "a" * 90 + "<a>" + "b" * 10 + "</a></p><p>" + "c" * 50 + "</p></div><p>dd</p></body>")
    nodes = {id(n): n for n in html_text.measure(root, events)}.values()
    share = 10 / 152
    for n in nodes:
        kids = [x for x in nodes if x.parent is n]
        assert n.sum == pytest.approx(sum(k.density for k in kids))
        lc, lt, t = max(n.link_chars, 1), max(n.link_tags, 1), max(n.tags, 1)
        base = np.log(n.chars / max(n.chars - n.link_chars, 1) * n.link_chars + share * n.chars + np.e)
        assert n.density == pytest.approx(n.chars / t * np.log(max(n.chars / lc * t / lt, 1)) / (base and np.log(base) if base > 1 else 1))
    assert {n.tag: (n.chars, n.tags, n.link_chars) for n in nodes if n.tag in ("body", "div", "a")} == {"body": (152, 5, 10), "div": (150, 3, 10), "a": (10, 0, 10)}


def test_html_tolerance():
    two = "<body>" + "".join(f"<article><header><h2>H{i}</h2></header><p>{prose(60)}</p></article>" for i in range(2)) + "<nav>n</nav>"
    assert html_text.main_text(two).startswith("H0\n\n") and "\n\nH1\n\n" in html_text.main_text(two)
    assert html_text.main_text("<body><noscript>x<p>" + prose(20)).count(" ") >= 19
    assert html_text.main_text("<body class=has-sidebar><div class='content-with-nav'><p>kept</p></div>") == "kept"
    assert html_text.main_text("<div class=site-header>top</div><article><div class='post-header'><h1>T</h1></div><p>body</p><div class=post-footer>f</div></article>") == "T\n\nbody"
    assert html_text.main_text("<div class=sidebar><article><p>in an article</p></article></div>") == "in an article"
    deep = ["<div>" * 20000 + "x", "<b>" * 20000 + "</i>" * 20000 + "x", "<ul><li>" * 10000 + "x", "<table><tr><td>" * 7000 + "x"]
    start = time.process_time()
    assert [html_text.main_text(p) for p in deep] == ["x"] * 4 and time.process_time() - start < 8


def test_html_table(spark):
    assert html_text.extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    again = spark.createDataFrame([(1, "u", "<p>é</p>")] * 2, "page_id bigint, url string, html string").selectExpr("*", "2 AS n_chars")
    assert sorted(map(tuple, html_text.extract_pages(again).collect())) == [(1, "u", "é", 1)] * 2
    pages = spark.createDataFrame([(1, "u", "<p>é</p>"), (2, None, None)], "page_id bigint, url string, html string").selectExpr("*", "1 AS text")
    assert sorted(map(tuple, html_text.extract_pages(pages).collect())) == [(1, "u", "é", 1), (2, None, "", 0)]


def test_secrets(spark, docs, empty):
    random_token = "ciFnq9RBXO2tAG1yKwILALo5x8Zt3Qvb"
    text = f'password: token: abcdefghijkl PassWord="hunter2hunter2" AKIA1234567890ABCD 0123456789abcdef key {random_token} release-notes-for-version-12'
    row = secrets.secret_report(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert (row[0].n_assign, row[0].n_access, row[0].n_hex, row[0].n_random) == (1, 1, 1, 1)
    a = text.index(random_token)
    assert f"random:{a}:{a + len(random_token)}" in row[0].spans and "release" not in row[0].spans
    assert row[1].spans == row[2].spans == "" and row[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.secret_report(empty).count() == 0


def test_secret_battery():
    """The p-values of ordinary strings are not small: drawn from the null itself they lie below a level about as often as it says."""
    letters, r = secrets.LETTER_RATES, random.Random(5)

    def ordinary(n):
        out, digit = [], False
        for _ in range(n):
            digit = (not digit if r.random() < secrets.CHANGE_RATE else digit) if out else r.random() < 0.5
            if not (out and r.random() < secrets.CORRELATION and out[-1].isdigit() == digit):
                out.append(r.choice("0123456789") if digit else r.choices(string.ascii_lowercase, letters)[0])
            else:
                out.append(out[-1])
        return "".join(out)

    p = [got[1] for got in (secrets.battery(ordinary(32)) for _ in range(2000)) if got]
    assert len(p) > 1500 and np.mean([x < 0.001 for x in p]) < 0.01


def test_discovery_cut():
    """The binned cut accepts what Benjamini-Hochberg does on p-values rounded up to their bins' edges."""
    r = random.Random(3)
    for _ in range(50):
        scores = [r.choice([r.uniform(0, 3), r.uniform(0, 12)]) for _ in range(r.randint(0, 60))]
        bins = collections.Counter(int(x * secrets.BINS_PER_DECADE) for x in scores)
        p = sorted(10 ** (-int(x * secrets.BINS_PER_DECADE) / secrets.BINS_PER_DECADE) for x in scores)
        passed = [k for k, x in enumerate(p, 1) if x <= 0.01 * k / len(p)]
        assert sum(x >= secrets.discovery_cut(list(bins.items()), 0.01) for x in scores) == (passed[-1] if passed else 0)


def test_secret_recall_and_false_finds(spark):
    """Random strings of several encodings in prose, beside names, dates and versions."""
    import base64
    import uuid

    r = random.Random(9)
    kinds = {
        "hex": lambda: "%032x" % r.getrandbits(128),
        "base64": lambda: base64.b64encode(r.randbytes(30)).decode(),
        "base62": lambda: "".join(r.choices(string.ascii_letters + string.digits, k=28)),
        "uuid": lambda: str(uuid.UUID(int=r.getrandbits(128))),
    }
    decoys = ["2024-01-15-at-10-30", "release-notes-v12-final", "ISBN-978-3-16-148410-0", "chapter12section34", "image_2024_01_15_final2", "usr/local/lib/python3", "windows11professional", "item-12345-description", "abcabcabc123123123", "section4paragraph2"]
    rows, truth = [], {}
    for i in range(200):
        kind = list(kinds)[i % 4]
        head = prose(10) + " "
        token = kinds[kind]()
        rows.append((i, head + token + " " + prose(10)))
        truth[i] = (kind, f"random:{len(head)}:{len(head) + len(token)}")
    rows += [(1000 + i, f"{prose(8)} {d} {prose(8)}") for i, d in enumerate(decoys * 5)]
    got = {x.doc_id: x for x in secrets.secret_report(spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS base", "2 AS tried")).collect()}
    for kind in kinds:
        assert np.mean([t in got[i].spans for i, (k, t) in truth.items() if k == kind]) >= 0.9, kind
    assert sum(got[1000 + i].n_random for i in range(50)) <= 1


def test_language(spark, empty):
    own = {"xx": WORDS[:200], "yy": WORDS[200:]}
    rows = [(i, " ".join(rng.choice(own[lang]) for _ in range(rng.randint(3, 40))), lang) for i in range(400) for lang in [rng.choice(["xx", "yy"])]]
    rows += [(1000, None, "xx"), (1001, "123 !!", "yy"), (1002, "", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 AS score")
    got = {r.doc_id: r for r in language.detect_languages(df).collect()}
    known = [(i, lang) for i, _, lang in rows[:400] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _ in known) and np.mean([got[i].lang_pred == lang for i, lang in known]) > 0.9
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"}
    assert language.detect_languages(empty.select("doc_id", "text", "lang")).count() == 0


def test_language_rejection():
    """Where a third of the texts could be of either language, the calibrated threshold rejects these and accepts the rest."""
    own = {"xx": WORDS[:100], "yy": WORDS[100:200], "both": WORDS[200:]}
    draw = lambda kind: " ".join(rng.choice(own[kind]) for _ in range(24))
    rows = [(draw(kind), kind if kind != "both" else rng.choice(["xx", "yy"])) for kind in ["xx", "yy", "both"] * 120]
    scorer = language.Scorer(language.train_language(rows))
    clear = [(draw(kind), kind) for kind in ["xx", "yy"] * 60]
    found, _, rejected = scorer.predict([t for t, _ in clear])
    accepted = [got == kind for (_, kind), got, no in zip(clear, found, rejected) if not no]
    assert len(accepted) >= 0.8 * len(clear) and np.mean(accepted) >= 0.97
    assert np.mean(scorer.predict([draw("both") for _ in range(100)])[2]) >= 0.7


def test_toxicity(spark, empty):
    bad = ["vilebrat", "scumlord", "foulmouth"]
    rows, labels = [], []
    for i in range(500):
        words, toxic = prose(rng.randint(5, 80)).split(), rng.random() < 0.3
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, "")]
    df, lab = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([*labels, (1000, None)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(df, lab).collect()}
    known = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _ in known) and np.mean([got[i].predicted == y for i, y in known]) > 0.9
    assert 0 <= got[1000].score <= 1 and got[1000].score == got[1001].score
    assert toxicity.score_documents(empty, lab).count() == 0


def test_toxicity_gradients():
    """Back-propagation against differences."""
    p = toxicity.ToxicityParams(window=5, word_buckets=64, char_buckets=64)
    net = toxicity.Network(p)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    g = np.random.default_rng(1)
    gates, mask, y = g.standard_normal((6 * p.hidden, 5, 3)), np.ones((5, 3)), np.array([1.0, 0.0, 1.0])
    mask[3:, 1] = 0
    loss = lambda: float(np.logaddexp(0, net.run(gates, mask)).sum() - (y * net.run(gates, mask)).sum())
    out, *state = net.run(gates, mask, keep=True)
    grads, d_gates = net.gradients(1 / (1 + np.exp(-out)) - y, *state, gates.shape)
    for name in ("hf", "hb", "attend", "out"):
        at = tuple(0 for _ in net.w[name].shape)
        net.w[name][at] += 1e-3
        up = loss()
        net.w[name][at] -= 2e-3
        assert abs((up - loss()) / 2e-3 - grads[name][at]) < 1e-3
        net.w[name][at] += 1e-3


def test_toxicity_scores_every_window():
    """The text's logit is the highest of the windows that start at each of its words, each run by itself."""
    p = toxicity.ToxicityParams(window=4, chunk=7)
    net = toxicity.Network(p)
    net.w["word"] = np.random.default_rng(2).standard_normal(net.w["word"].shape).astype(np.float32)
    texts = [prose(n) for n in (0, 1, 3, 4, 5, 40, 2)]

    def alone(words):
        gates, mask = np.zeros((4, 6 * p.hidden), np.float32), np.zeros((4, 1), np.float32)
        if words:
            gates[: len(words)], mask[: len(words)] = net.gates(words), 1
        return net.run(gates.T[:, :, None], mask)[0]

    expected = [max(alone(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))) for ws in map(toxicity.words_of, texts)]
    assert np.allclose(toxicity.Scorer(net).top_logits(texts), expected, atol=1e-5)


def test_order_minhash(docs, empty):
    rows = sorted(((-(1 << 63) if i is None else i, i, t or "") for i, t in documents()), key=lambda r: (-r[0], r[2]))
    expected = []
    for k, (_, i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][2]
        half = len(t) // 2
        expected.append((i, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()))
    for size in (2000, 3):
        found = order_minhash.fingerprints(docs, order_minhash.OrderParams(rows=size)).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=repr) == sorted(expected, key=repr)
    prints = {r.doc_id: r.fingerprint for r in found}
    assert prints[4] == prints[6] != prints[5] and prints[8] == prints[9]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert order_minhash.fingerprints(empty).count() == 0


def test_order_minhash_by_hand(spark):
    """Fingerprints and likeness from a plain reading of the method: numbered k-mers, two least of each bin, hashed in text order."""
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    number = lambda x, seed: xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed)
    small = lambda x, seed: xxhash.xxh64_intdigest(int(x).to_bytes(4, "little"), seed)
    place_bits = order_minhash.PLACE_BITS

    def fingerprint(text, k=3):
        words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.sub("[\t\n\r\f]", " ", text).split(" ")]
        grams = []
        for i in range(max(len(words) - k + 1, 1)):
            h = 42
            for w in words[i : i + k]:
                h = number(w, h)
            grams.append(h)
        met, bins = collections.Counter(), collections.defaultdict(list)
        for i, g in enumerate(grams):
            top = ((g << place_bits) & ((1 << 64) - 1)) >> place_bits
            v = small(met[top], number(top, 42)) >> place_bits + 1
            bins[v >> 63 - place_bits - 6].append((v, i))
            met[top] += 1
        out = []
        for b in sorted(bins):
            least = [i for _, i in sorted(bins[b])[:2]]
            one, two = min(least), max(least)
            out.append(b << 32 | small(one == two, number(grams[two], number(grams[one], 42))) >> 32)
        return out

    texts = ["", "one", "a b c d", prose(300), "x y " * 50 + prose(20), "tab\tand\nline  two", prose(900)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in order_minhash.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows:
        own, following = fingerprint(t), fingerprint(texts[(i - 1) % len(texts)])
        assert got[i].fingerprint == "".join(f"{x:010x}" for x in own)
        bins = {x >> 32 for x in own} | {x >> 32 for x in following}
        assert got[i].near_next == pytest.approx(len(set(own) & set(following)) / len(bins))


def test_many_rows_of_one_doc_id(spark):
    """A doc_id that fills many buckets is split by its texts' hash; the order of all rows is one circle."""
    rows = [(5, f"text {i}") for i in range(60)] + [(i, f"other {i}") for i in range(10) if i != 5]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    parts = order_minhash.bucketed(df.selectExpr("doc_id AS key", "text"), order_minhash.OrderParams(rows=5)).filter("key = 5").select("bucket", "part").distinct().count()
    found = order_minhash.with_next(df.selectExpr("doc_id AS key", "text"), order_minhash.OrderParams(rows=5)).collect()
    following = {r.text: r.next_text for r in found}
    at, seen = "other 9", []
    for _ in rows:
        seen.append(at)
        at = following[at]
    assert parts > 4 and at == "other 9" and sorted(seen) == sorted(t for _, t in rows)
    assert [t for t in seen if t.startswith("other")] == [f"other {i}" for i in (9, 8, 7, 6, 4, 3, 2, 1, 0)]


def test_byte_bpe(docs, empty):
    tiktoken, vocabulary = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = vocabulary.path("byte_bpe_multi_50k.tiktoken")
    own = byte_bpe.codec(path, vocabulary.PATTERN)
    reference = tiktoken.Encoding("own", pat_str=vocabulary.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for text in [t or "" for _, t in documents()] + ["a" * 3000, "ab" * 2000, "日本" * 500, "'s 've\n\n  x", "".join(rng.choice("abé日 1!\n") for _ in range(5000))]:
        ids = own.encode(text)
        assert ids == reference.encode_ordinary(text) and own.decode(ids) == text.encode()
    got = {r.doc_id: r for r in byte_bpe.token_digests(docs, path, vocabulary.PATTERN).collect()}
    assert got[8].n_tokens == 0 and got[8].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert byte_bpe.token_digests(empty, path, vocabulary.PATTERN).count() == 0
    assert byte_bpe.encode_documents(docs, path, vocabulary.PATTERN).filter("doc_id = 4").first().decoded == " ".join(BASE).encode()
