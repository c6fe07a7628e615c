"""Personal data by fixed patterns and by bootstrapped contextual extraction, in DataFrame functions only.

The fixed patterns give the base spans.  They are also the seeds of the second part: identifier-like
words (five digits or more, or an at sign) are instances; one or two words before or after an
instance, or a word with a gap of one, with the instance's shape, are lexical patterns (two words also
without the shape).  Only patterns that seeds of several documents bear out, and whose words seldom
stand elsewhere in the corpus, are tried: words such as "the" say nothing, whatever stands beside
them.  Patterns and instances form a bipartite graph, over which scores go in rounds until they stand
still: a pattern's confidence is the share of its distinct instances that are seeds or found so far,
an instance's score is that one of its trusted patterns is right.  Instances that no fixed pattern
knows and that trusted patterns agree on are added as spans of kind ``found``.

Edge cases: null and empty texts have no spans; spans that start together are listed by kind; very
long texts are searched whole; repeated rows each give a row, and count as one document and one
instance for a pattern; an empty table gives an empty table; extra columns, whatever their names, are
not read, and redact() hands them on.  Positions are code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import cut

#: Kinds in the order in which spans that start together are listed; the last is the method's own.
KINDS = ("email", "ip", "card", "phone", "found")

# The fixed patterns.  Possessive repeats and the look-behinds keep the leftmost matches and their
# extents, and make the search linear in the text.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A word with five digits or an at sign.
IDENTIFIER = r"(?<!\S)(?=(?:[^\s0-9]*+[0-9]){5}|[^\s@]*+@)\S++"


@dataclass(frozen=True)
class PiiParams:
    """``seeds``, ``documents``: distinct seed instances and texts with one that a trusted pattern needs;
    ``trust``: its least confidence; ``special``: least share of its words' occurrences in the corpus that
    stand at an instance; ``accept``: least score of an instance that is added; ``rounds``: most rounds."""

    rounds: int = 12
    #: Most phrases that are sent to every task to be counted in the corpus.
    broadcast: int = 200_000
    seeds: int = 5
    documents: int = 3
    trust: float = 0.3
    special: float = 0.2
    accept: float = 0.5


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def valid_ip(match: Column) -> Column:
    part = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    return F.forall(F.split(match, r"\."), lambda x: F.when(F.length(part(x)) <= 3, part(x).cast("int") <= 255).otherwise(False))


def valid_card(match: Column) -> Column:
    digits = _digits(match)
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    luhn = F.aggregate(each, F.lit(0), lambda s, x: s + x - F.when(x > 9, 9).otherwise(0))
    return F.length(digits).between(14, 19) & (luhn % 10 == 0)


def valid_phone(match: Column) -> Column:
    return F.length(_digits(match)).between(10, 15)


def _tail(items: Column) -> Column:
    """All but the first.  The length is the array's own: slice() adds start and length as 32-bit numbers where it is not compiled, as inside zip_with()."""
    return F.slice(items, 2, F.size(items))


def _matches(text: Column, pattern: str, keep, after: bool = False) -> Column:
    """The leftmost matches that pass ``keep``, in order: m, start, and the text before (and after) it up to its neighbours.

    A text is its matches and the pieces between them, so the start of a match is the length of all
    that comes before; only what is kept is held.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(found, between, lambda m, b: F.struct(m.alias("m"), b.alias("before")))  # the last has no match
    if after:
        pairs = F.zip_with(pairs, _tail(between), lambda x, a: F.struct(x["m"].alias("m"), x["before"].alias("before"), a.alias("after")))
    held = "array<struct<m:string,start:int,before:string" + (",after:string>>" if after else ">>")
    start = lambda acc, x: acc["at"] + F.length(x["before"])
    rest = lambda x: [x["after"].alias("after")] if after else []
    row = lambda acc, x: F.array(F.struct(x["m"].alias("m"), start(acc, x).alias("start"), x["before"].alias("before"), *rest(x)))
    step = lambda acc, x: F.struct(
        (start(acc, x) + F.length(x["m"])).alias("at"),
        F.when(x["m"].isNotNull() & keep(x["m"]), F.concat(acc["kept"], row(acc, x))).otherwise(acc["kept"]).alias("kept"),
    )
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(held).alias("kept")), step)["kept"]


SPANS = "array<struct<start:int,rank:int,stop:int>>"


def base_spans(text: Column) -> Column:
    """Sorted array of (start, rank of the kind, stop)."""
    has_digit = text.rlike("[0-9]")
    none = F.array().cast(SPANS)
    spans = lambda rank, pattern, valid: F.transform(_matches(text, pattern, valid), lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), (x["start"] + F.length(x["m"])).alias("stop")))
    return F.sort_array(
        F.concat(
            F.when(F.contains(text, F.lit("@")), spans(0, EMAIL, lambda m: F.lit(True))).otherwise(none),
            F.when(has_digit, F.concat(spans(1, IP, valid_ip), spans(2, CARD, valid_card))).otherwise(none),
            F.when(has_digit & F.contains(text, F.lit("+")), spans(3, PHONE, valid_phone)).otherwise(none),
        )
    )


def instances(text: Column, base: Column) -> Column:
    """Identifier-like words: start, stop, core (no outer punctuation), shape, two words before and after, rank of a base span they touch."""
    words = _matches(text, IDENTIFIER, lambda m: F.lit(True), after=True)
    core = lambda m: F.regexp_extract(m, r"[\p{L}\p{N}](?:.*[\p{L}\p{N}])?", 0)
    placed = F.transform(words, lambda x: F.struct(core(x["m"]).alias("core"), (x["start"] + F.length(F.regexp_extract(x["m"], r"^[^\p{L}\p{N}]*", 0))).alias("start"), x["before"].alias("before"), x["after"].alias("after")))
    clean = lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}=:#]", ""))
    # digits as 9 one by one, but a stretch of up to three as one sign, letters as one
    short = lambda c: F.regexp_replace(c, "(?<![0-9])[0-9]{1,3}(?![0-9])", "#")
    shape = lambda c: F.regexp_replace(F.regexp_replace(short(c), "[0-9]", "9"), r"\p{L}+", "a")
    full = F.transform(
        placed,
        lambda x: F.struct(
            x["start"].alias("start"),
            (x["start"] + F.length(x["core"])).alias("stop"),
            x["core"].alias("core"),
            shape(x["core"]).alias("shape"),
            clean(F.regexp_extract(x["before"], r"(\S+)\s*$", 1)).alias("left"),
            clean(F.regexp_extract(x["before"], r"(\S+)\s+\S+\s*$", 1)).alias("left2"),
            clean(F.regexp_extract(x["after"], r"^\s*(\S+)", 1)).alias("right"),
            clean(F.regexp_extract(x["after"], r"^\s*\S+\s+(\S+)", 1)).alias("right2"),
            F.array_max(F.transform(F.filter(base, lambda b: (b["start"] < x["start"] + F.length(x["core"])) & (b["stop"] > x["start"])), lambda b: b["rank"])).alias("seed"),
        ),
    )
    return F.when(text.rlike("[0-9@]"), F.filter(full, lambda x: x["core"] != "")).otherwise(F.array().cast("array<struct<start:int,stop:int,core:string,shape:string,left:string,left2:string,right:string,right2:string,seed:int>>"))


def patterns_of(mentions: DataFrame) -> DataFrame:
    """(pattern, phrase, core, text_key, seed): the lexical patterns of each mention."""
    both = lambda a, b: F.when((F.col(a) != "") & (F.col(b) != ""), F.concat_ws(" ", a, b)).otherwise("")
    made = []
    for side, near, far, two in (("l", "left", "left2", both("left2", "left")), ("r", "right", "right2", both("right", "right2"))):
        made += [(side, F.col("shape"), F.col(near)), (side + "_", F.col("shape"), F.col(far)), (side * 2, F.col("shape"), two), (side * 2, F.lit("*"), two)]
    rows = F.explode(F.array(*(F.struct(F.concat_ws(" ", F.lit(kind), shape, phrase).alias("pattern"), phrase.alias("phrase")) for kind, shape, phrase in made))).alias("p")
    return mentions.select("core", "text_key", "seed", rows).select("p.*", "core", "text_key", "seed").filter("phrase <> ''")


def phrase_counts(texts: Column, rows: DataFrame, phrases: DataFrame, few: bool) -> DataFrame:
    """(phrase, times): how often each of ``phrases`` (one or two words) stands in the whole corpus.

    ``few``: they are sent to every task, and the corpus' words are not shuffled.  Otherwise the words are
    counted first, task by task before their shuffle, and their counts meet the phrases where they lie.
    """
    words = F.split(F.trim(F.lower(F.regexp_replace(texts, r"[^\p{L}\p{N}=:#\s]+", ""))), r"\s+")
    rows = rows.select(words.alias("w"))
    pairs = F.zip_with("w", _tail(F.col("w")), lambda a, b: F.concat(a, F.lit(" "), b))
    each = rows.select(F.explode(F.concat("w", pairs)).alias("phrase"))
    counted = lambda some: some.groupBy("phrase").agg(F.count(F.lit(1)).alias("times"))
    return counted(each.join(F.broadcast(phrases), "phrase")) if few else counted(each).join(phrases, "phrase")


def discover(mentions: DataFrame, texts: DataFrame, p: PiiParams) -> DataFrame:
    """Distinct cores that are no seeds and that trusted patterns agree on.

    ``mentions``: core, shape, left, left2, right, right2, text_key, seed; ``texts``: text.  Equal
    (pattern, instance) pairs fold before any join, so copies of a text weigh nothing and no join
    meets a hot pattern's mentions.
    """
    each = patterns_of(mentions)
    seeded = each.filter("seed IS NOT NULL")
    borne = seeded.groupBy("pattern").agg(F.count_distinct("core").alias("seeds"), F.count_distinct("text_key").alias("documents"))
    borne = cut(borne.filter((F.col("seeds") >= p.seeds) & (F.col("documents") >= p.documents)).select("pattern"))
    none = mentions.select("core").limit(0)
    if borne.isEmpty():
        return none
    met = each.join(borne, "pattern").groupBy("pattern", "phrase", "core").agg(F.count(F.lit(1)).alias("times"), F.max(F.col("seed").isNotNull().cast("int")).alias("seed"))
    met = cut(met)
    # of a phrase's patterns the one met most often counts, so a mention is never counted twice
    beside = met.groupBy("phrase", "pattern").agg(F.sum("times").alias("here")).groupBy("phrase").agg(F.max("here").alias("here"))
    beside = cut(beside)
    wanted = beside.select("phrase")
    few = wanted.count() <= p.broadcast  # rows of a written table
    special = beside.join(phrase_counts(F.col("text"), texts, wanted, few), "phrase").filter(F.col("here") >= F.col("times") * p.special)
    edges = cut(met.join(special.select("phrase"), "phrase").select("pattern", "core", F.col("seed").cast("double").alias("seed")))
    known, mark = edges.groupBy("core").agg(F.max("seed").alias("score"), F.max("seed").alias("seed")), None
    for _ in range(p.rounds):
        known = cut(known)
        row = known.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("core", F.round("score", 6)))).first()
        if row[0] == 0 or tuple(row) == mark:
            break
        mark = tuple(row)
        right = (F.col("score") >= p.accept).cast("double")
        patterns = edges.join(known.select("core", "score"), "core").groupBy("pattern").agg(F.avg(right).alias("confidence"))
        trusted = patterns.filter(F.col("confidence") >= p.trust)
        doubt = edges.join(trusted, "pattern").groupBy("core").agg(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))).alias("doubt"))
        seeds = edges.groupBy("core").agg(F.max("seed").alias("seed"))
        known = seeds.join(doubt, "core", "left").select("core", F.when(F.col("seed") > 0, 1.0).otherwise(1 - F.exp(F.coalesce("doubt", F.lit(0.0)))).alias("score"), "seed")
    return known.filter((F.col("seed") == 0) & (F.col("score") >= p.accept)).select("core")


def find_spans(docs: DataFrame, p: PiiParams = PiiParams()) -> DataFrame:
    """row, doc_id, text_key, base, added: sorted arrays of (start, rank, stop) for every row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64(text).alias("text_key"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    rows = cut(rows.select("row", "doc_id", "text_key", "base", instances(F.col("text"), F.col("base")).alias("words")))
    mentions = rows.select("row", "text_key", F.explode("words").alias("w")).select("row", "text_key", "w.*")
    fresh = discover(mentions, docs.select(text.alias("text")), p)
    added = mentions.filter("seed is null").join(fresh, "core").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", F.lit(4).alias("rank"), "stop"))).alias("added"))
    return rows.drop("words").join(added, "row", "left").withColumn("added", F.coalesce("added", F.array().cast(SPANS)))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def pii_report(docs: DataFrame, p: PiiParams = PiiParams()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found."""
    found = find_spans(docs, p)
    of_kind = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    counts = [of_kind(rank).alias(f"n_{kind}") for rank, kind in enumerate(KINDS[:4])]
    every = F.sort_array(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(every).alias("spans"), F.size("added").cast("long").alias("n_found"))


def redact(docs: DataFrame, p: PiiParams = PiiParams()) -> DataFrame:
    """``docs`` with the text of every span, base or added, replaced by its kind in angle brackets; n_chars follows the text.

    The text is cut at its spans; overlapping spans are one, named by the kind that starts first.
    A null text stays null.
    """
    text = F.col("text")
    names = [f"c{i}" for i in range(len(docs.columns))]  # the caller's columns under names of no meaning, until the end
    own = dict(zip(docs.columns, names, strict=True))
    rest = [F.col(own[c]) for c in docs.columns if c not in ("text", "n_chars")]
    added = find_spans(docs, p).filter(F.size("added") > 0).select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"), F.col("added").alias("added_"))
    keyed = docs.toDF(*names)
    same = F.col(own["doc_id"]).eqNullSafe(F.col("id_")) & (F.xxhash64(F.coalesce(own["text"], F.lit(""))) == F.col("key_"))
    rows = keyed.join(added.dropDuplicates(["id_", "key_"]), same, "left").select(*rest, F.col(own["text"]).alias("text"), "added_")
    rows = rows.withColumn("base_", base_spans(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("spans_", F.sort_array(F.concat("base_", F.coalesce("added_", F.array().cast(SPANS))))).drop("base_", "added_")
    blank = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    name = lambda s: F.concat(F.lit("<"), F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1), F.lit(">"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["out"].alias("out"))).otherwise(
        F.struct(s["stop"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), name(s))).alias("out"))
    )
    rows = rows.withColumn("done_", F.when(F.size("spans_") > 0, F.aggregate("spans_", blank, step)))
    new = F.when(F.size("spans_") > 0, F.concat(F.array_join("done_.out", ""), F.substring(text, F.col("done_.at") + 1, F.length(text)))).otherwise(text)
    rows = rows.withColumn("text", new)
    if "n_chars" in docs.columns:
        rows = rows.withColumn(own["n_chars"], F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return rows.select(*(F.col("text" if c == "text" else own[c]).alias(c) for c in docs.columns))
