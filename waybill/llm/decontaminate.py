"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, units after numbers and names inside a sentence become typed placeholders; the rest is
lower-cased words without punctuation.  Windows of ``window`` template tokens are hashed, all those
of an item and all those of a document, so a shared passage of ``window`` tokens is met wherever it
starts.  Documents that share a window with an item are candidates; the values in the slots of the
aligned passage must map one to one (the same value to the same value), so a re-parameterised
question counts and a chance likeness of templates does not.  Every place of a document where the
passage may lie is tried; one that passes is enough.

A window of few plain words says little as a template, so it is looked for by its words, values
included: exact copies of items full of numbers or names are found, other values in them are not.

Items of fewer tokens than a window are looked for whole, words and values, in windows of their own
length; only lengths that the benchmark has are tried.

The items are broadcast only if a count shows few windows; else the windows are joined by shuffle.

Edge cases: null and empty texts, and items of fewer than ``least`` tokens, match nothing; rows
without a doc_id are not reported; of items that differ in their values alone, the one with the
smallest item_id is looked for by the template and each by its own words, and items of the same words
are one, reported by the smallest item_id; of several places in a document the one with equal values,
then the most windows counts; very long texts are searched whole; repeated rows are reported once;
empty tables give an empty table; extra columns, whatever their names, are not read, and
drop_contaminated() hands them on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import cut

# Unit words that a number may carry.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml cl dl l gal s sec secs min mins h hr hrs ms ns hz khz mhz ghz w kw mw v kv a ma j kj cal kcal "
    "pa kpa k c f usd eur gbp dollars euros pounds cents percent degrees miles meters metres kilometers kilometres feet inches yards "
    "grams kilograms tons tonnes ounces liters litres gallons seconds minutes hours days weeks months years"
).split()
#: Marks of a slot's first character: number, name, unit.
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"


@dataclass(frozen=True)
class TemplateParams:
    """``least``: tokens of the shortest item that is looked for.  A pair is reported at ``share`` of the item's distinct windows, and ``agree`` of its slot pairs one to one.

    ``plain``: distinct words outside slots that a window of an item needs to be met by its template.  ``broadcast``: most item
    windows (about 24 bytes each) that are sent to every task.
    """

    window: int = 8
    least: int = 3
    plain: int = 4
    share: float = 0.5
    agree: float = 0.8
    broadcast: int = 1_000_000


def with_spaced(rows: DataFrame) -> DataFrame:
    """``text`` becomes ``spaced``: its words with one space between them and no punctuation, those in slots with
    their mark in front.  Each step is a column of its own, so that Spark works it out once."""
    rows = rows.withColumn("text", F.translate(F.coalesce("text", F.lit("")), NUMBER + NAME + UNIT, "   "))
    t = F.col("text")
    named = lambda x: F.regexp_replace(x, r"(?<=[\p{Ll}\p{Nd},;:] )(?=\p{Lu}\p{Ll})", NAME)
    numbers = F.regexp_replace(t, r"(?<![\p{L}\p{M}\p{Nd}])\p{Nd}+(?:[.,:/]\p{Nd}+)*", f" {NUMBER}$0 ")
    units = F.regexp_replace(numbers, rf"({NUMBER}\S+) +((?i:{'|'.join(UNITS)}))(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2 ")
    bare = F.regexp_replace(named(units), r"(?<!\p{Nd})[^\p{L}\p{M}\p{N}\s\ue000-\ue002]+|[^\p{L}\p{M}\p{N}\s\ue000-\ue002]+(?!\p{Nd})", " ")
    short = F.regexp_replace(named(t), r"[^\p{L}\p{M}\ue000-\ue002]+", " ")  # the same for a text without digits
    return rows.withColumn("spaced", F.trim(F.when(t.rlike(r"\p{N}"), F.regexp_replace(bare, r"\s+", " ")).otherwise(short))).drop("text")


def words_of(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def canonical(words: Column) -> Column:
    """Marked words with each slot as its mark alone, others in lower case."""
    return F.transform(words, lambda w: F.when(w.rlike(r"^[\ue000-\ue002]"), F.substring(w, 1, 1)).otherwise(F.lower(w)))


def without_marks(words: Column) -> Column:
    return F.lower(F.translate(words, NUMBER + NAME + UNIT, ""))


def with_hashes(rows: DataFrame) -> DataFrame:
    """``spaced`` becomes ``t``, the hashes of canonical() of its words, and ``v``, those of its words in lower case with no marks."""
    rows = rows.withColumn("lowered", F.lower(F.regexp_replace("spaced", r"([\ue000-\ue002])\S+", "$1"))).withColumn("plain", without_marks(F.col("spaced"))).drop("spaced")
    return rows.withColumn("t", F.transform(words_of(F.col("lowered")), lambda w: F.xxhash64(w))).withColumn("v", F.transform(words_of(F.col("plain")), lambda w: F.xxhash64(w))).drop("lowered", "plain")


def windows(hashes: Column, size: int) -> Column:
    """Hashes of the windows that start at 0, 1, 2, ...

    ``hashes`` must be a column and no expression: it is read at each start.
    """
    starts = F.when(F.size(hashes) >= size, F.sequence(F.lit(1), F.size(hashes) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, size)))


def item_table(benchmark: DataFrame, p: TemplateParams) -> DataFrame:
    """item_id, own_id, words (marked), places (array of (pos, key, plain, seeds)) for each distinct text that has a window.

    ``item_id`` is the smallest of those with the same template, ``own_id`` the smallest of those with the same words too.
    ``key`` tells an item's windows apart.  A window is looked for by its ``seeds``: the template if it is ``plain`` enough,
    else the words; the words too for the first window, as a name is not marked where a text starts.  Items of a template
    other than the smallest are looked for by words alone.
    """
    items = with_spaced(benchmark.select("item_id", "text")).select("item_id", words_of(F.col("spaced")).alias("words"))
    items = items.filter(F.size("words") >= p.window).withColumn("template", canonical(F.col("words"))).withColumn("values", F.transform("words", without_marks))
    items = items.groupBy("template", "values").agg(F.min(F.struct("item_id", "words")).alias("i")).select("i.*", "template", "values")
    first = items.groupBy("template").agg(F.min("item_id").alias("first_id"))
    items = items.join(first, "template").select(F.col("first_id").alias("item_id"), F.col("item_id").alias("own_id"), "words", "template", "values")
    items = items.withColumn("t", F.transform("template", lambda w: F.xxhash64(w))).withColumn("v", F.transform("values", lambda w: F.xxhash64(w)))
    items = items.withColumn("t", windows(F.col("t"), p.window)).withColumn("v", windows(F.col("v"), p.window))
    distinct = lambda i: F.size(F.array_distinct(F.filter(F.slice("template", i + 1, p.window), lambda w: ~w.rlike(r"^[\ue000-\ue002]"))))
    both = F.transform("t", lambda t, i: F.struct(i.alias("pos"), t.alias("t"), F.get("v", i).alias("v"), (distinct(i) >= p.plain).alias("plain")))
    is_first = F.col("item_id") == F.col("own_id")

    def place(x: Column) -> Column:
        by_template = x["plain"] & is_first
        seeds = F.when(by_template & (x["pos"] == 0), F.array_distinct(F.array(x["t"], x["v"]))).when(by_template, F.array(x["t"])).otherwise(F.array(x["v"]))
        return F.struct(x["pos"].alias("pos"), F.when(by_template, x["t"]).otherwise(x["v"]).alias("key"), x["plain"].alias("plain"), seeds.alias("seeds"))

    return items.withColumn("both", both).select("item_id", "own_id", "words", F.transform("both", place).alias("places"))


def short_items(docs: DataFrame, benchmark: DataFrame, p: TemplateParams) -> DataFrame | None:
    """Documents that hold an item of fewer tokens than a window, word for word; None where the benchmark has no such item.

    ``docs``: doc_id, v (hashes of the words).
    """
    items = with_spaced(benchmark.select("item_id", "text")).select("item_id", words_of(F.col("spaced")).alias("words"))
    items = items.filter(F.size("words").between(p.least, p.window - 1))
    slots = F.size(F.filter("words", lambda w: w.rlike(r"^[\ue000-\ue002]")))
    items = items.select("item_id", F.size("words").alias("n"), slots.alias("n_slots"), F.transform(F.transform("words", without_marks), lambda w: F.xxhash64(w)).alias("v"))
    items = cut(items.groupBy("n", F.xxhash64("v").alias("h")).agg(F.min("item_id").alias("item_id"), F.min("n_slots").alias("n_slots")))
    sizes = sorted(r[0] for r in items.select("n").distinct().collect())  # fewer than a window's tokens
    if not sizes:
        return None
    of_size = lambda n: F.transform(windows(F.col("v"), n), lambda h: F.struct(F.lit(n).alias("n"), h.alias("h")))
    each = F.flatten(F.array(*map(of_size, sizes)))
    met = docs.select("doc_id", F.explode(F.array_distinct(each)).alias("w")).select("doc_id", "w.*").join(items, ["n", "h"]).dropDuplicates(["doc_id", "item_id"])
    one, whole = F.lit(1), F.lit(1.0)
    return met.select("doc_id", "item_id", one.alias("matched_windows"), one.alias("item_windows"), whole.alias("share"), "n_slots", F.lit(True).alias("verbatim_slots"))


def contaminated(docs: DataFrame, benchmark: DataFrame, p: TemplateParams = TemplateParams()) -> DataFrame:
    """doc_id, item_id, matched_windows, item_windows, share, n_slots, verbatim_slots for each pair found.

    The share is that of an item's plain windows or that of all its windows, whichever is more.
    """
    items = item_table(benchmark, p)
    seeds = items.select("item_id", "own_id", F.explode("places").alias("w")).select("item_id", "own_id", "w.pos", "w.key", "w.plain", F.explode("w.seeds").alias("h"))
    if seeds.limit(p.broadcast + 1).count() <= p.broadcast:
        seeds = F.broadcast(seeds)
    named = docs.filter("doc_id is not null").select("doc_id", "text")
    hashed = with_hashes(with_spaced(named))
    tokens = hashed.withColumn("t", windows(F.col("t"), p.window)).withColumn("v", windows(F.col("v"), p.window))
    # the words' windows follow the templates'; one that is the same as its template's is left out
    starts = tokens.select("doc_id", F.size("t").alias("n"), F.posexplode(F.concat("t", F.zip_with("t", "v", lambda t, v: F.nullif(v, t)))).alias("k", "h")).filter("h is not null")
    hits = starts.join(seeds, "h").withColumn("shift", F.when(F.col("k") < F.col("n"), F.col("k")).otherwise(F.col("k") - F.col("n")) - F.col("pos"))
    by_shift = hits.groupBy("doc_id", "item_id", "own_id", "shift").agg(F.collect_set(F.struct("plain", "key")).alias("keys"))
    # few rows, read twice: written once, or the documents would be scanned again
    pairs = cut(by_shift.groupBy("doc_id", "item_id", "own_id").agg(F.collect_list(F.struct("shift", "keys")).alias("shifts")))

    texts = with_spaced(named.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")).select("doc_id", words_of(F.col("spaced")).alias("words"))
    both = pairs.join(texts, "doc_id").join(items.select("own_id", F.col("words").alias("own"), "places"), "own_id")
    wanted = F.array_distinct(F.transform("places", lambda x: F.struct(x["plain"].alias("plain"), x["key"].alias("key"))))
    both = both.withColumn("wanted", wanted).withColumn("seen", F.array_distinct(F.flatten(F.transform("shifts", lambda s: s["keys"]))))
    plain = lambda keys: F.size(F.filter(keys, lambda x: x["plain"]))
    of = lambda seen, total: F.struct((seen / total).alias("share"), seen.alias("seen"), total.alias("total"))
    most = lambda keys: F.greatest(of(F.size(keys), F.size("wanted")), F.when(plain("wanted") > 0, of(plain(keys), F.nullif(plain("wanted"), F.lit(0)))))
    both = both.withColumn("most", most(F.col("seen"))).filter(F.col("most.share") >= p.share)
    # each place that reaches the share by itself is tried, and those with the most windows
    both = both.withColumn("best", F.array_max(F.transform("shifts", lambda s: F.size(s["keys"]))))
    tried = F.filter("shifts", lambda s: (F.size(s["keys"]) == F.col("best")) | (most(s["keys"])["share"] >= p.share))
    passage = lambda s: F.transform("own", lambda w, i: F.struct(w.alias("b"), F.when(i + s["shift"] >= 0, F.get("words", i + s["shift"])).alias("d")))
    both = both.select("doc_id", F.col("own_id").alias("item_id"), "most", F.explode(F.transform(tried, passage)).alias("aligned"))
    slots = F.filter("aligned", lambda s: s["b"].rlike(r"^[\ue000-\ue002]") & F.coalesce(F.substring(s["b"], 1, 1) == F.substring(s["d"], 1, 1), F.lit(False)))
    both = both.withColumn("slots", F.array_distinct(slots))
    fewest = F.least(F.size(F.array_distinct(F.transform("slots", lambda s: s["b"]))), F.size(F.array_distinct(F.transform("slots", lambda s: s["d"]))))
    passed = both.filter(fewest >= F.size("slots") * p.agree)
    verbatim = F.forall("slots", lambda s: s["b"] == s["d"])
    rank = F.struct(verbatim.alias("verbatim_slots"), F.col("most.share").alias("share"), F.size("slots").alias("n_slots"), F.col("most.seen").alias("seen"), F.col("most.total").alias("total"))
    found = passed.groupBy("doc_id", "item_id").agg(F.max(rank).alias("f"))
    out = found.select("doc_id", "item_id", F.col("f.seen").alias("matched_windows"), F.col("f.total").alias("item_windows"), "f.share", "f.n_slots", "f.verbatim_slots")
    short = short_items(hashed, benchmark, p)
    return out if short is None else out.unionByName(short)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, p: TemplateParams = TemplateParams()) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows without a doc_id stay."""
    return docs.join(contaminated(docs, benchmark, p).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
