"""Near-duplicate documents: b-bit MinHash signatures, band candidates, links confirmed on full shingle sets.

A document's set holds its distinct five-word shingles as 64-bit hashes. Documents with equal sets form a
class; classes are the nodes of the link graph, so copies never meet in pairs.

1. One pass over the texts gives each document its set's size and 128-bit key, ``PERMUTATIONS`` minima of
   which the low ``BITS`` bits are packed into longs, and a key per band of ``ROWS`` minima.
2. Classes that share a band key are candidates. Packed signatures are compared by bit counts; the share of
   equal low bits, corrected for chance collisions, estimates the similarity, and only pairs that are within
   five standard errors of the threshold (or above) are confirmed. Pairs of sets under ``FEW`` shingles are
   confirmed whatever the estimate: the permutations are linear, so on tiny sets errors are larger than that.
3. Pairs are confirmed on the full sets, made again from the texts. Two rounds link each class to one leader
   (of those that its buckets have in another component, the one with the best estimate), which unites nearly
   all groups with one link per class. A last round takes the buckets that still hold several components: all
   pairs where a bucket has ``SMALL`` classes at most; over the classes of larger ones, shingles are ordered by
   how many of these have them, and two similar sets must share one among the first of each (prefix filter:
   exact, and it passes over what all copies of a text have in common). Of these pairs the likeliest of any two
   components is confirmed first, and then all pairs of components that are still apart.

Components come from hooking each root to its least neighbour and pointer jumping; links, components and
signatures stay in tables. Keys that many rows have (a band of a large group, the key of a text with many copies)
meet their rows by broadcast, a bounded number of keys, so that no task gets all rows of one. A pair at the threshold shares no band with a probability of 1.3e-6.

Documents without words (or null text): empty set, no links, a component of their own. Repeated rows are
copies of one another. A null doc_id takes part and has the least other doc_id of its group, or null. Texts of
any length are taken whole; an empty table gives an empty one. Similarity of exactly 0.75 is a link.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.common import OWN, cut, hot_keys, joined, numbered, text_or_empty

WORDS = 5
ROWS, BANDS = 5, 50
PERMUTATIONS, BITS = 256, 4
NUMERATOR, DENOMINATOR = 3, 4
#: Members of a leader's group that are confirmed by one task.
GROUP = 64
#: Classes in a bucket whose pairs are taken as they are.
SMALL = 8
#: Rounds in which classes are linked to leaders.
TURNS = 2
#: Shingles from which on a set's estimates are taken for near the similarity.
FEW = 64
#: Rows with which texts are picked by broadcast; with more, texts are shuffled to them.
PICK_ROWS = 1 << 20

_PRIME = np.uint64(0x9E3779B97F4A7C15)


#: Words that a worker keeps the hashes of; a full table is emptied.
KNOWN_WORDS = 1 << 17


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, words: int = WORDS, hashes: WordHashes | None = None) -> np.ndarray:
    """Distinct shingles of ``words`` words as sorted 64-bit hashes; A-Z are lower-cased, words end at white space of ASCII."""
    hashes = WordHashes() if hashes is None else hashes
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _PRIME + h[i : len(h) - k + 1 + i]
    return np.unique(_mixed(out))


@lru_cache(maxsize=1)
def _family() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    draw = lambda n, kind: rng.integers(0, np.iinfo(kind).max, n, kind, endpoint=True)
    return draw((PERMUTATIONS, 1), np.uint32) | np.uint32(1), draw((PERMUTATIONS, 1), np.uint32), draw(ROWS, np.uint64) | np.uint64(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least hash of the set under each permutation."""
    a, b, _ = _family()
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 512):
        values = a * h[at : at + 512]
        values += b
        np.minimum(least, values.min(axis=1), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, 16 to a long."""
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    _, _, c = _family()
    rows = least[: ROWS * BANDS].astype(np.uint64).reshape(BANDS, ROWS)
    return _mixed((rows * c).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _PRIME).view(np.int64)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """_row, doc_id, n_shingles, key_a, key_b, signature, bands (null without words) of every row of ``docs``."""

    def work(batches):
        hashes = WordHashes()
        for batch in batches:
            sizes, a, b, signature, bands = [], [], [], [], []
            for value in batch.column("text"):
                shingles = shingle_set(value.as_py(), words, hashes)
                sizes.append(len(shingles))
                if not len(shingles):
                    for column in (a, b, signature, bands):
                        column.append(None)
                    continue
                key = xxhash.xxh3_128_digest(shingles.tobytes())
                a.append(int.from_bytes(key[:8], "little", signed=True))
                b.append(int.from_bytes(key[8:], "little", signed=True))
                least = minima(shingles)
                signature.append(packed(least))
                bands.append(band_keys(least))
            longs = pa.list_(pa.int64())
            arrays = [pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(signature, longs), pa.array(bands, longs)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), *arrays], ["_row", "doc_id", "n_shingles", "key_a", "key_b", "signature", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("_row", "doc_id", "text").mapInArrow(work, f"_row long, doc_id {kind}, n_shingles long, key_a long, key_b long, signature array<long>, bands array<long>")


def estimate(a, b):
    """Similarity of two packed signatures: the share of equal low bits, corrected for those that are equal by chance."""
    unlike = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)),
        F.lit(0),
        lambda n, z: n + F.bit_count(z.bitwiseOR(F.shiftright(z, 1)).bitwiseOR(F.shiftright(z, 2).bitwiseOR(F.shiftright(z, 3))).bitwiseAND(F.lit(0x1111111111111111))),
    )
    chance = 2.0**-BITS
    return ((1 - unlike / PERMUTATIONS) - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    """Five standard errors below the threshold."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * threshold
    return threshold - 5 * (p * (1 - p) / PERMUTATIONS) ** 0.5 / (1 - chance)


def _picking(rows: DataFrame) -> DataFrame:
    """Rows of a few numbers each, to join with texts: broadcast behind a count, so that texts stay where they are."""
    return F.broadcast(rows) if rows.limit(PICK_ROWS + 1).count() <= PICK_ROWS else rows


def confirmed(pairs: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough. texts: node, text.

    The pairs of one u come in parts of about GROUP; u's text goes to every part, v's to the one that needs it.
    """

    def work(batches):
        hashes = WordHashes()
        current, own = None, None
        for batch in batches:
            us, vs = [], []
            for u, part, v, text in zip(*(batch.column(c) for c in ("u", "part", "v", "text")), strict=True):
                at = (u.as_py(), part.as_py())
                shingles = shingle_set(text.as_py(), words, hashes)
                if not v.is_valid:
                    current, own = at, shingles
                elif current == at:
                    common = int((own[np.minimum(np.searchsorted(own, shingles), len(own) - 1)] == shingles).sum())
                    if DENOMINATOR * common >= NUMERATOR * (len(own) + len(shingles) - common):
                        us.append(at[0])
                        vs.append(v.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    parts = pairs.groupBy("u").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    parts = cut(parts, "parts")
    heads = texts.join(_picking(parts), F.col("u") == texts["node"]).select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("v"), "text")
    members = texts.join(_picking(cut(pairs.join(parts, "u"), "asked")), F.col("v") == texts["node"]).select("u", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), "v", "text")
    dealt = heads.unionByName(members).repartition("u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())
    return dealt.select("u", "part", "v", "text").mapInArrow(work, "u long, v long")


def _jumped(hooks: DataFrame) -> DataFrame:
    """(node, root): every pointer followed to its end; pointers lead to lesser nodes."""
    while True:
        a, b = hooks.alias("a"), hooks.alias("b")
        further = cut(a.join(b, F.col("a.root") == F.col("b.node"), "left").select("a.node", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")), "jumped")
        hooks = further.select("node", "root")
        if further.where("moved").isEmpty():
            return hooks


def united(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, root) for all nodes that aren't their own root, after ``edges`` (u, v) between roots of ``labels``."""
    while True:
        edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
        if edges.isEmpty():
            return labels if labels is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        roots = _jumped(cut(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")), "hooks"))
        if labels is not None:
            moved = labels.alias("l").join(roots.alias("r"), F.col("l.root") == F.col("r.node"), "left").select("l.node", F.coalesce("r.root", "l.root").alias("root"))
            labels = cut(moved.unionByName(roots), "labels")
        else:
            labels = roots
        edges = _rooted(edges, roots, "u", "v")


def _overlap(a: Column, b: Column) -> Column:
    """How many shingles two sets of these sizes must share."""
    return F.ceil(F.lit(NUMERATOR) * (a + b) / F.lit(NUMERATOR + DENOMINATOR))


def _sharing_prefixes(nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(u, v) of different roots that may be similar enough. nodes: node, root; texts: node, text."""

    def work(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), words, hashes) for t in batch.column("text")]
            sizes = np.array([len(x) for x in sets], np.int64)
            columns = [np.repeat(batch.column(c).to_numpy(), sizes) for c in ("node", "root")] + [np.repeat(sizes, sizes), np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "root", "size", "shingle"])

    shingles = cut(texts.join(_picking(cut(nodes, "many")), "node").select("node", "root", "text").mapInArrow(work, "node long, root long, size long, shingle long"), "shingles")
    common = shingles.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    # shingles that one class has alone come first; they are counted, not carried
    alone = F.col("size") - F.count("*").over(Window.partitionBy("node"))
    place = alone + F.row_number().over(Window.partitionBy("node").orderBy("n", "shingle"))
    least = F.ceil(F.lit(NUMERATOR) * F.col("size") / F.lit(DENOMINATOR))  # a partner has so many shingles at least
    first = shingles.join(common, "shingle").withColumn("place", place).where(F.col("place") <= F.col("size") - least + 1)
    first = cut(first.select("node", "root", "size", "shingle", "place"), "prefixes")
    a, b = (first.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "size", "place")]) for x in "uv")
    needed = _overlap(F.col("size_u"), F.col("size_v"))
    fits = (F.col("node_u") < F.col("node_v")) & (F.col("root_u") != F.col("root_v")) & (F.col("place_u") <= F.col("size_u") - needed + 1) & (F.col("place_v") <= F.col("size_v") - needed + 1)
    return a.join(b, (a["shingle"] == b["shingle"]) & fits).select(F.col("node_u").alias("u"), F.col("node_v").alias("v")).distinct()


def _rooted(df: DataFrame, labels: DataFrame | None, *columns: str) -> DataFrame:
    """Columns of nodes become columns of their roots."""
    for c in columns if labels is not None else ():
        other = labels.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        df = df.join(other, df[c] == other["_node"], "left").withColumn(c, F.coalesce("_root", c)).drop("_node", "_root")
    return df


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text)."""
    return components(docs.select("doc_id", "text"), words).drop("_row", "_group")


def components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """As near_duplicates, with ``_row`` (of ``docs`` where it has such a column) and ``_group``, a number that a component has alone.

    Without a column ``_row``, ``docs`` must be a table as it is read: its rows are numbered by their places.
    """
    texts = docs.select("doc_id", text_or_empty(docs).alias("text"), *(["_row"] if "_row" in docs.columns else []))
    texts = texts if "_row" in docs.columns else numbered(texts)
    all_docs = cut(signatures(texts, words), "signatures")
    # a class of equal sets stands for its documents; its node is the row of its least document
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col("_row").alias("node"))).alias("first")
    classes = cut(all_docs.where("n_shingles > 0").groupBy("key_a", "key_b").agg(first, F.count("*").alias("n")).select("key_a", "key_b", "first.doc_id", "first.node", "n"), "classes")
    nodes = all_docs.join(classes.select("node"), all_docs["_row"] == F.col("node")).select("node", "n_shingles", "signature", "bands")
    members = cut(nodes.select("node", F.explode("bands").alias("key")), "bands")
    shared = cut(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    hot = hot_keys(members, ["key"], shared)  # a band that many classes have
    members = cut(joined(members, shared.select("key"), ["key"], hot=hot), "members")
    involved = cut(nodes.join(members.select("node").distinct(), "node").select("node", "n_shingles", "signature"), "involved")
    node_texts = texts.select(F.col("_row").alias("node"), "text")
    enough = least_estimate(NUMERATOR / DENOMINATOR)

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes, and signatures unless both sets are small, allow for a link, with the estimate."""
        u, v = (involved.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}")) for c in "uv")
        both = pairs.join(u, "u").join(v, "v").where(DENOMINATOR * F.least("n_u", "n_v") >= NUMERATOR * F.greatest("n_u", "n_v"))
        return both.withColumn("estimate", estimate(F.col("s_u"), F.col("s_v"))).where((F.greatest("n_u", "n_v") < FEW) | (F.col("estimate") >= enough)).select("u", "v", "estimate")

    labels, tried, buckets = None, None, members

    def link(pairs: DataFrame) -> None:
        """Confirms pairs and unites what they link."""
        nonlocal labels, tried
        if pairs.isEmpty():
            return
        labels = united(_rooted(confirmed(pairs, node_texts, words), labels, "u", "v"), labels)
        done = pairs.select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"))
        tried = done if tried is None else tried.unionByName(done)

    for turn in range(TURNS + 1):
        buckets = cut(_rooted(buckets.select("key", "node", F.col("node").alias("root")), labels, "root"), "buckets")
        # only buckets that hold more than one component matter
        drawn = F.min_by("node", F.struct("root", F.xxhash64("node", F.lit(turn))))
        mixed = buckets.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), drawn.alias("leader"), F.count("*").alias("n"))
        mixed = cut(mixed.where("low < high").select("key", "low", "leader", "n"), "mixed")
        buckets = joined(buckets, mixed, ["key"], hot=hot)
        if turn < TURNS:
            pairs = buckets.where("root <> low").select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct()
            pairs = likely(pairs).groupBy("v").agg(F.max_by("u", F.struct("estimate", -F.col("u"))).alias("u"))
            link(cut(pairs.select("u", "v"), "pairs"))
            continue
        few = buckets.where(F.col("n") <= SMALL)
        a, b = (few.select("key", F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "uv")
        pairs = a.join(b, (a["key"] == b["key"]) & (F.col("u") < F.col("v")) & (F.col("root_u") != F.col("root_v"))).select("u", "v").distinct()
        many = buckets.where(F.col("n") > SMALL).select("node", "root").distinct()
        open_ = cut(likely(pairs.unionByName(_sharing_prefixes(many, node_texts, words)).distinct()), "open")
        for last in (False, True):
            # first the likeliest pair of two components, then all pairs of those that are still apart
            apart = _rooted(open_.select("u", "v", "estimate", F.col("u").alias("root_u"), F.col("v").alias("root_v")), labels, "root_u", "root_v").where("root_u <> root_v")
            if not last:
                two = F.least("root_u", "root_v").alias("x"), F.greatest("root_u", "root_v").alias("y")
                apart = apart.groupBy(*two).agg(F.max_by(F.struct("u", "v"), F.struct("estimate", -F.col("u"), -F.col("v"))).alias("best")).select("best.u", "best.v")
            pairs = apart.select("u", "v")
            if tried is not None:
                pairs = pairs.join(tried, (F.least("u", "v") == F.col("x")) & (F.greatest("u", "v") == F.col("y")), "left_anti")
            link(cut(pairs, "pairs"))
    rooted = cut(_rooted(classes.select("key_a", "key_b", "doc_id", F.col("node").alias("root")), labels, "root"), "rooted")
    least = cut(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "least")
    found = joined(rooted, least.drop("n"), ["root"], hot=hot_keys(rooted, ["root"], least))
    found = cut(found.select("key_a", "key_b", "component_id", F.col("root").alias("_group")), "found")
    some = all_docs.select("_row", "doc_id", "n_shingles", "key_a", "key_b").where("n_shingles > 0")
    out = joined(some, found, ["key_a", "key_b"], hot=hot_keys(some, ["key_a", "key_b"], classes))
    alone = all_docs.where("n_shingles = 0").select("_row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("_row").alias("_group"))
    out = out.select("_row", "doc_id", "n_shingles", "component_id", "_group").unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def first_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with one row of each component: that of its least doc_id. ``docs`` is a table as it is read."""
    row = f"{OWN}row"
    rows = numbered(docs, row)
    groups = components(rows.select(F.col(row).alias("_row"), "doc_id", "text"), words)
    first = groups.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col("_row").alias("_kept"))).alias("first")).select("first._kept")
    return rows.join(first, rows[row] == first["_kept"], "left_semi").select(*docs.columns)
