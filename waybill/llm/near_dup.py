"""MinHash near-duplicate detection with tensored banding and exact verification.

Two small collections of ``tables`` bands of ``rows`` minhashes are computed for each distinct
shingle set.  A table key joins one band of the first with one band of the second, so 2 x tables x
rows minhashes give tables^2 keys of 2 x rows minhashes each: about the square root of the work of
independent keys.  Two sets of similarity s share no key with a chance of about 2 (1 - s^rows)^tables.

1. Documents with equal sets fold into one node before any key is made.
2. Every node is checked against the leader of each of its keys: the node of the key whose keys hold
   the most nodes, so the original of a group rather than one of its copies.  Verified links give
   components.
3. In a key that still holds several components, two nodes close to its leader are compared by what
   they differ in from it (see differing()): to be linked they must share some of those shingles,
   which are rare ones, so a large group of texts that differ in different places forms few pairs.
   Nodes far from the leader meet the other nodes of the key, less those of the key's main component
   among themselves.  Parities of the sets are compared inside both joins, outlines after them.
   Verified links complete the components.

So no key forms all pairs of its nodes, and yet no candidate pair between different components goes
unchecked.  Links are confirmed on the full sets.

Edge cases: null, empty and blank texts have no shingles, are linked with nothing and stay; texts
shorter than a shingle have their whole word sequence as their one shingle; very long texts count
whole; repeated rows each give a row; rows that share a doc_id are one document, which counts with
one of their sets (the least by its key); equal likeness and equal sizes are ties that the smallest
doc_id wins; an empty table gives an empty table; extra columns, whatever their names, are not read,
and keep_one() hands them on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waybill.llm.common import cut, drop_cut, map_batches
from waybill.llm.graph import components
from waybill.llm.words import MIX, mix

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The low bits of a key are the number of its table: tables^2 numbers at most.
TABLE_MASK = 127
#: Word hashes that a task remembers.
CACHE_WORDS = 300_000


@dataclass(frozen=True)
class NearDupParams:
    """Sets of ``shingle`` words are linked when 100 x intersection >= ``percent`` x union.

    ``agree``: share of agreeing bins of two outlines (see outline()) below which a candidate is not
    verified; it lies about five standard deviations below the similarity wanted.  ``close``: share
    from which a node counts as close to its leader; it only decides which of two exact ways is taken.
    """

    shingle: int = 3
    percent: int = 85
    tables: int = 8
    rows: int = 2
    agree: float = 0.73
    close: float = 0.5
    seed: int = 97
    #: Most ids of candidates that are sent to every task to pick out their texts; beyond it texts and ids meet by shuffle.
    broadcast: int = 500_000

    def __post_init__(self) -> None:
        if self.tables**2 > TABLE_MASK + 1:
            raise ValueError("at most 11 tables: a key holds its table's number in seven bits")


class Shingler:
    """Whole texts to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, size: int) -> None:
        self.size, self.known = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").encode("utf-8").translate(LOWER).split()
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        if not len(h):
            return h
        size = min(self.size, len(h))
        out = np.full(len(h) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            out = mix(out * MIX + h[k : len(h) - size + 1 + k])
        return np.unique(out)


def sketch_maker(p: NearDupParams):
    """Shingle hashes to 2 x tables x rows minhashes of 32 bits."""
    rng = np.random.default_rng(p.seed)
    n = 2 * p.tables * p.rows
    a = (rng.integers(1, 1 << 63, n, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    b = rng.integers(0, 1 << 63, n, dtype=np.uint64)

    def sketch(h: np.ndarray) -> list[int]:
        low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(h), 4096):
            low = np.minimum(low, (h[i : i + 4096, None] * a + b).min(axis=0))
        return (low >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist()

    return sketch


BINS, PLANES = 256, 4
WORDS = BINS // 64


def outline(h: np.ndarray) -> list[int]:
    """A set's least hash in each of 256 bins, as bit planes of 64-bit words: filled or not, then four bits of the hash.

    One hash a shingle, whatever the number of bins; two outlines compare by a few bit operations.
    """
    g = np.sort(mix(h * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)))
    bins = (g >> np.uint64(56)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    planes = np.zeros((PLANES + 1, BINS), np.uint8)
    planes[0, bins[at]] = 1
    for k in range(PLANES):
        planes[k + 1, bins[at]] = (g[at] >> np.uint64(k)) & np.uint64(1)
    return np.packbits(planes, bitorder="little").view("<i8").tolist()


PARITY = 512


def parity(h: np.ndarray) -> list[int]:
    """How many hashes fall into each of 512 bins, modulo two, as 64-bit words.

    Two of them differ in at most as many bits as their sets in members, so they never hide a link.
    """
    odd = np.bincount((mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)) >> np.uint64(55)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def signatures(docs: DataFrame, p: NearDupParams) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the full set), sketch (minhashes for the keys), outline, parity."""

    def make():
        import xxhash

        shingles, sketch = Shingler(p.shingle), sketch_maker(p)

        def work(doc_id, text):
            sets = [shingles(t) for t in text]
            return {
                "doc_id": doc_id,
                "n_shingles": [len(s) for s in sets],
                "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "sketch": [sketch(s) if len(s) else None for s in sets],
                "outline": [outline(s) if len(s) else None for s in sets],
                "parity": [parity(s) if len(s) else None for s in sets],
            }

        return work

    return map_batches(docs.select("doc_id", "text"), make, "doc_id bigint, n_shingles bigint, set_key binary, sketch array<int>, outline array<bigint>, parity array<bigint>")


def _band(p: NearDupParams, collection: int, i: int):
    return F.slice("sketch", F.lit(1 + (collection * p.tables + i) * p.rows), F.lit(p.rows))


def table_keys(nodes: DataFrame, p: NearDupParams) -> DataFrame:
    """(key, node, n): tables^2 keys a node, each from one band of either collection."""
    joined = lambda i, j: F.xxhash64(_band(p, 0, i), _band(p, 1, j)).bitwiseAND(F.lit(~TABLE_MASK)).bitwiseOR(F.lit(i * p.tables + j))
    keys = F.array(*(joined(i, j) for i in range(p.tables) for j in range(p.tables)))
    return nodes.select(F.explode(keys).alias("key"), "node", "n")


def _first_shared(p: NearDupParams, key: str, a: str, b: str):
    """Whether the key is the first that two nodes share.

    Their shared keys are all pairs of a shared band of either collection, so the first is the pair
    of the first ones; each pair of nodes thus leaves the join once.
    """
    number = F.col(key).bitwiseAND(F.lit(TABLE_MASK)).cast("int")
    places = (F.floor(number / p.tables).cast("int"), number % p.tables)
    sooner = F.lit(False)
    for c, place in enumerate(places):
        for k in range(p.tables - 1):
            at = F.lit(c * p.tables + k)
            sooner = sooner | ((F.lit(k) < place) & (F.get(F.col(a), at) == F.get(F.col(b), at)))
    return ~sooner


def _may_link(p: NearDupParams, a: str, b: str):
    """Sizes within the wanted ratio: sets of n <= m can reach the similarity only if 100 n >= percent m."""
    return F.least(F.col(a), F.col(b)) * 100 >= F.greatest(F.col(a), F.col(b)) * p.percent


def _in_reach(p: NearDupParams, n_a: str, n_b: str, a: str, b: str):
    """Sets that differ in more than (100 - percent) / (100 + percent) of their sizes' sum are not linked: by the parities a and b."""
    differ = F.lit(0)
    for i in range(PARITY // 64):
        differ = differ + F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i))))
    return differ * (100 + p.percent) <= (F.col(n_a) + F.col(n_b)) * (100 - p.percent)


def _agree(least: float, a: str, b: str):
    """Share of the bins filled in either outline that hold the same in both, held against ``least``."""
    word = lambda c, plane, i: F.get(F.col(c), F.lit(plane * WORDS + i))
    same, either = F.lit(0), F.lit(0)
    for i in range(WORDS):
        differ = word(a, 1, i).bitwiseXOR(word(b, 1, i))
        for plane in range(2, PLANES + 1):
            differ = differ.bitwiseOR(word(a, plane, i).bitwiseXOR(word(b, plane, i)))
        same = same + F.bit_count(word(a, 0, i).bitwiseAND(word(b, 0, i)).bitwiseAND(F.bitwise_not(differ)))
        either = either + F.bit_count(word(a, 0, i).bitwiseOR(word(b, 0, i)))
    return same >= either * least


def full_sets(pairs: DataFrame, docs: DataFrame, p: NearDupParams) -> DataFrame:
    """(id, hashes): the whole shingle set of every doc_id in ``pairs`` (a, b), a written table."""
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    if 2 * pairs.count() <= p.broadcast:  # counts rows of a written table
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id", "left_semi")

    def make():
        shingles = Shingler(p.shingle)
        return lambda ids, text: {"id": ids, "hashes": [shingles(t).view(np.int64) for t in text]}

    return map_batches(texts, make, "id bigint, hashes array<bigint>")


def with_sets(pairs: DataFrame, docs: DataFrame, p: NearDupParams) -> DataFrame:
    """``pairs`` with x and y, the sets of a and b."""
    sets = full_sets(pairs, docs, p)
    of = lambda id_, name: sets.select(F.col("id").alias(id_), F.col("hashes").alias(name))
    return pairs.join(of("b", "y"), "b").join(of("a", "x"), "a")


def verified(pairs: DataFrame, docs: DataFrame, p: NearDupParams) -> DataFrame:
    """The pairs (a, b) of doc_ids whose full sets reach the similarity."""
    both = with_sets(pairs, docs, p).withColumn("shared", F.size(F.array_intersect("x", "y")))
    return both.filter(F.col("shared") * 100 >= (F.size("x") + F.size("y") - F.col("shared")) * p.percent).select("a", "b")


def differing(close: DataFrame, nodes: DataFrame, docs: DataFrame, p: NearDupParams) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) among nodes that are close to one leader, of different components, and the written table that they are read from.

    ``close``: a (the leader), b (a node), component.  D(x) is the set of shingles that are in one of x
    and the leader L alone.  With r = (100 - percent) / (100 + percent), x and y are linked when
    |D(x) ^ D(y)| <= r (|x| + |y|), and x is linked with L when |D(x)| <= r (|x| + |L|).  Two nodes that
    are linked with L are of one component, so one of a pair, y, is not: then the two share at least
    t = (|D(x)| - r (|x| - |L|)) / 2 > 0 shingles of D if x is linked with L, and
    t = (|D(x)| - r (|x| - |L|)) / 2, likewise, if neither is.  So in any one order of shingles the first
    |D(x)| - t + 1 of one hold a shared one; the rarest come first.  Exact, as no link is lost.  Parities
    are compared inside the join, so that it gives few pairs that are not linked.
    """
    r = (100 - p.percent) / (100 + p.percent)
    sets = with_sets(close, docs, p).withColumn("d", F.concat(F.array_except("x", "y"), F.array_except("y", "x")))
    sized = sets.select("a", "b", "component", F.size("x").alias("n_a"), F.size("y").alias("n"), F.size("d").alias("k"), "d")
    sized = sized.withColumn("free", F.col("k") > r * (F.col("n") + F.col("n_a")) - 1e-6)  # not linked with L; a doubt counts as free
    need = F.floor((F.col("k") - r * (F.col("n") - F.col("n_a"))) / 2 - 1e-6)
    sized = sized.withColumn("prefix", F.col("k") + 1 - F.greatest(need, F.lit(1)))
    tokens = cut(sized.select("a", "b", "component", "n", "free", "prefix", F.explode("d").alias("token")))
    common = tokens.groupBy("a", "token").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.coalesce("times", F.lit(1)), "token"))
    ranked = tokens.join(common, ["a", "token"], "left").withColumn("early", rank <= F.col("prefix")).filter("times > 1 and (free or early)")
    ranked = ranked.join(nodes.select(F.col("node").alias("b"), "parity"), "b")
    left = ranked.filter("free").select("a", "token", F.col("b").alias("node_a"), F.col("n").alias("small"), F.col("component").alias("component_a"), F.col("early").alias("early_a"), F.col("parity").alias("parity_a"))
    right = ranked.filter("early").select("a", "token", F.col("b").alias("node"), "n", "component", "free", "parity")
    met = left.join(right, ["a", "token"]).filter("component <> component_a and (not free or (early_a and node > node_a))").filter(_may_link(p, "n", "small") & _in_reach(p, "n", "small", "parity", "parity_a"))
    return met.select(F.least("node", "node_a").alias("a"), F.greatest("node", "node_a").alias("b")).distinct(), tokens


def near_duplicates(docs: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    signed = cut(signatures(docs, p))
    filled = signed.filter("n_shingles > 0")
    sets = filled.groupBy("set_key").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(name) for c, name in (("n_shingles", "n"), ("sketch", "sketch"), ("outline", "outline"), ("parity", "parity"))))
    sets = cut(sets)
    nodes = sets.groupBy("node").agg(F.min(F.struct("set_key", "n", "sketch", "outline", "parity")).alias("s")).select("node", "s.n", "s.sketch", "s.outline", "s.parity")
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("outline").alias(f"o_{x}"), F.col("parity").alias(f"p_{x}"))
    outlined = lambda pairs: pairs.join(side("a"), "a").join(side("b"), "b")
    likely = _may_link(p, "n_a", "n_b") & _agree(p.agree, "o_a", "o_b") & _in_reach(p, "n_a", "n_b", "p_a", "p_b")

    keys = table_keys(nodes, p)
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    crowded = cut(keys.join(sizes, "key"))  # the rows of keys with several nodes
    weights = crowded.groupBy("node").agg(F.sum("size").alias("weight"))
    leaders = crowded.join(weights, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("a"))
    led = cut(crowded.drop("size").join(leaders, "key"))
    drop_cut(crowded)
    stars = outlined(led.filter("a <> node").select("a", F.col("node").alias("b")).distinct()).filter(_agree(p.close, "o_a", "o_b"))
    stars = cut(stars.select("a", "b", likely.alias("likely")))
    tried = stars.filter("likely").select("a", "b")
    links = cut(verified(tried, docs, p))

    grouped = components(links)
    placed = led.select("key", "node", "n", "a").join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = placed.groupBy("key", "component").count()
    main = counts.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    near = stars.select("a", F.col("b").alias("node"), F.lit(True).alias("near"))
    split = placed.join(main, "key").drop("parts").join(near, ["a", "node"], "left")
    split = cut(split.withColumn("near", F.coalesce("near", F.col("node") == F.col("a"))))
    drop_cut(led, grouped)
    around = cut(split.filter("near and node <> a").select("a", F.col("node").alias("b"), "component").distinct())
    met, tokens = differing(around, nodes, docs, p)

    bands = F.array(*(F.hash(_band(p, c, i)) for c in range(2) for i in range(p.tables)))
    mixed = split.groupBy("key").agg(F.bool_and("near").alias("near")).filter("not near").select("key")  # keys that hold far nodes
    members = split.join(mixed, "key", "left_semi").join(nodes.select("node", "parity", bands.alias("bands")), "node")
    rest = members.filter("component <> main").select("key", *(F.col(c).alias(f"{c}_a") for c in ("node", "n", "component", "parity", "bands", "near")))
    one_far = rest.filter("not near_a").join(members, "key").filter("component <> component_a and (component = main or near or node > node_a)")
    main_far = rest.filter("near_a").join(members.filter("not near and component = main"), "key").filter("component <> component_a")
    crossing = one_far.unionByName(main_far).filter(_may_link(p, "n", "n_a") & _in_reach(p, "n", "n_a", "parity", "parity_a")).filter(_first_shared(p, "key", "bands", "bands_a"))
    crossing = crossing.select(F.least("node", "node_a").alias("a"), F.greatest("node", "node_a").alias("b"))
    ordered = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = outlined(met.unionByName(crossing).distinct()).filter(likely).select("a", "b")
    pairs = cut(pairs.join(ordered, ["a", "b"], "left_anti"))
    drop_cut(tokens, split, around, stars)
    final = components(links.unionByName(verified(pairs, docs, p)))
    drop_cut(pairs, links)

    of_set = sets.join(final, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    out = signed.join(of_set, "set_key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, p: NearDupParams) -> DataFrame:
    """The rows of ``docs`` that are their group's representative; one row for each doc_id and text, all without a doc_id."""
    kept = near_duplicates(docs, p).filter("kept or component_id is null").select("doc_id").distinct()
    some = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return some.unionByName(docs.filter("doc_id is null")).select(*docs.columns)
