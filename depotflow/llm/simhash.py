"""SimHash near-dedup: fingerprints of word shingles, links within two bits, connected components.

Links are found by multi-index hashing. A fingerprint has two segments of 32 bits. Each fingerprint enumerates the
Hamming ball of radius 1 within each segment and is entered under every such value *together with the other segment*;
fingerprints that meet under one key are matches, and their complete distance is verified. Two fingerprints differ in at
most two bits exactly if they meet: one step from either side covers every way to spread two bits over two segments. As
the key holds the other segment too, a key never has more than 65 different fingerprints, however large a group of near
copies is, so a star to the smallest one gives the same components as all pairs would.

For near copies down to a given share of common shingles no small number of bits is enough. `similar_groups` first takes what
multi-index hashing finds: a table for each segment holds the fingerprints under the segment's value, every fingerprint probes the values of
the small ball around its own, fetches what lies there and compares the whole fingerprints; the pairs found are checked exactly on the
sets of shingles. A near copy may differ in more bits than the balls cover, so an exact join of the sets on prefixes completes the
classes: in an order that all sets share, two sets of that similarity have an element in common among the first few of both, so no pair
is missed. Each key offers its central member to all others; then all members of a key that are not in one
component yet are compared. Sizes, positions of the common key and parity bitmaps rule out pairs by bounds that hold for certain; long
sets have a second bitmap that grows with them, as a short one says nothing about them. What passes is checked exactly on the sets of
shingles. Only rows that a bitmap filter of the wanted keys lets through are shuffled.

Nulls: a null text is empty, its fingerprint is zero and it links like any other; a null id counts as a row of its own
and never becomes a component's id unless nothing else is in it. Repeated rows come back as often as they came in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from depotflow.llm.common import reach_package, stage, stage_result, text_key, text_rows, text_slices, unstage
from depotflow.llm.components import components
from depotflow.operators.bitmaps import might_hold, only, without

# Fixed values of the contract: white space, the five 64-bit primes of the public XXH64 description, and its seed.
WHITE_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
P1, P2, P3, P4, P5 = (
    np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9),
    np.uint64(0x85EBCA77C2B2AE63), np.uint64(0x27D4EB2F165667C5),
)
SEED = 42

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(WHITE_SPACE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Spreads four bits over four counters of 16 bits.
SPREAD = sum((np.arange(16, dtype=np.uint64) >> np.uint64(b) & np.uint64(1)) << np.uint64(16 * b) for b in range(4))
SEGMENT_BITS = 32
HASH_BLOCK = 1 << 17


def _rotate(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotate(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XXH64 of data[start : start + size] for each pair; `data` (uint8) has at least 8 bytes after the last one."""
    order = np.argsort(-sizes, kind="stable")  # those that still have bytes left are always a prefix
    at, left = starts[order].astype(np.int64), sizes[order].astype(np.int64)
    lanes8 = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    lanes4 = np.ndarray((len(data) - 3,), "<u4", data, 0, (1,))
    seed = np.uint64(SEED)
    length = left.astype(np.uint64)
    acc = np.full(len(at), seed + P5)
    with np.errstate(over="ignore"):
        long = int(np.searchsorted(-left, -32, "right"))
        if long:
            v = [np.full(long, s) for s in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            n = long
            while n:
                for k in range(4):
                    v[k][:n] = _round(v[k][:n], lanes8[at[:n] + 8 * k])
                at[:n] += 32
                left[:n] -= 32
                n = int(np.count_nonzero(left[:n] >= 32))  # the longest come first
            joined = _rotate(v[0], 1) + _rotate(v[1], 7) + _rotate(v[2], 12) + _rotate(v[3], 18)
            for k in range(4):
                joined = (joined ^ _round(np.zeros(long, np.uint64), v[k])) * P1 + P4
            acc[:long] = joined
        acc += length
        for _ in range(3):  # what is left of each is under 32 bytes
            i = np.flatnonzero(left >= 8)
            if not len(i):
                break
            acc[i] = _rotate(acc[i] ^ _round(np.zeros(len(i), np.uint64), lanes8[at[i]]), 27) * P1 + P4
            at[i] += 8
            left[i] -= 8
        i = np.flatnonzero(left >= 4)
        if len(i):
            acc[i] = _rotate(acc[i] ^ (lanes4[at[i]].astype(np.uint64) * P1), 23) * P2 + P3
            at[i] += 4
            left[i] -= 4
        for _ in range(3):
            i = np.flatnonzero(left > 0)
            if not len(i):
                break
            acc[i] = _rotate(acc[i] ^ (data[at[i]].astype(np.uint64) * P5), 11) * P1
            at[i] += 1
            left[i] -= 1
        acc = (acc ^ (acc >> np.uint64(33))) * P2
        acc = (acc ^ (acc >> np.uint64(29))) * P3
        acc ^= acc >> np.uint64(32)
    out = np.empty_like(acc)
    out[order] = acc
    return out


def shingle_hashes(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, one text after the other, and how many each text has."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = IS_SPACE[raw]
    first = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    size = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1 - first
    keep = ~space
    keep[(first + size)] = True  # one separator after each word
    data = np.append(np.where(space, np.uint8(32), LOWER[raw])[keep], np.zeros(8, np.uint8))
    at = np.cumsum(size + 1) - (size + 1)
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(first, ends)
    n_words = np.diff(upto, prepend=0)
    counts = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    total = int(counts.sum())
    inside = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    i = np.repeat(upto - n_words, counts) + inside
    j = i + np.repeat(np.minimum(n_words, words), counts) - 1
    hashes = np.empty(total, np.uint64)
    for s in range(0, total, HASH_BLOCK):
        a, b = i[s : s + HASH_BLOCK], j[s : s + HASH_BLOCK]
        hashes[s : s + HASH_BLOCK] = xxh64(data, at[a], at[b] + size[b] - at[a])
    return hashes, counts


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64-bit fingerprints: a bit is set if more than half of a text's hashes have it; zero without hashes."""
    votes = np.zeros((len(counts), 64), np.int64)
    starts, owner = [], []
    at = 0
    for k, n in enumerate(counts.tolist()):
        for s in range(0, n, 65_535):  # what a counter of 16 bits can hold
            starts.append(at + s)
            owner.append(k)
        at += n
    if starts:
        for nibble in range(16):
            sums = np.add.reduceat(SPREAD[(hashes >> np.uint64(4 * nibble)) & np.uint64(15)], starts)
            for b in range(4):
                np.add.at(votes[:, 4 * nibble + b], owner, (sums >> np.uint64(16 * b) & np.uint64(65_535)).astype(np.int64))
    bits = (votes * 2 > counts[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint long) of every row; A-Z count as lower case, shingles repeat as often as they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches):
            prints = majority(*shingle_hashes(texts, words)).astype("<u8").view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(prints)], ["doc_id", "fingerprint"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fingerprint", T.LongType())])
    return text_rows(docs, id_col, text_col).mapInArrow(run, schema)


def _ball(segment: int) -> list[Column]:
    """The values that differ from `fingerprint` in one bit of a segment."""
    shift = segment * SEGMENT_BITS
    masks = [(1 << (shift + b)) - (1 << 64 if shift + b == 63 else 0) for b in range(SEGMENT_BITS)]
    return [F.col("fingerprint").bitwiseXOR(F.lit(m).cast("long")) for m in masks]


def links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """Links (src, dst) between different fingerprints of at most `bits` (0, 1 or 2) differing bits, enough to connect
    all that any chain of such links connects."""
    if bits not in (0, 1, 2):
        raise ValueError("links are found for at most two differing bits")
    probes = prints.select("fingerprint").distinct()
    probes = probes.select("fingerprint", F.explode(F.array(F.col("fingerprint"), *_ball(0), *_ball(1))).alias("key"))
    hub = F.min("fingerprint").over(Window.partitionBy("key"))
    pairs = probes.select("fingerprint", hub.alias("hub"), "key").filter(F.col("fingerprint") != F.col("hub"))
    if bits < 2:  # then one of the two must be the key itself
        hub = F.col("key")
        members = probes.select("fingerprint", hub.alias("hub")).filter(F.col("fingerprint") != F.col("hub"))
        pairs = members.join(prints.select(F.col("fingerprint").alias("hub")).distinct(), "hub", "left_semi")
    return (
        pairs.filter(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("hub"))) <= bits)
        .select(F.col("fingerprint").alias("src"), F.col("hub").alias("dst"))
        .distinct()
    )


def segment_pairs(prints: DataFrame, similarity: float) -> DataFrame:
    """Pairs (src, dst, n_src, n_dst) of the (node, n, fingerprint) that the tables of the segments yield, of sizes that allow the similarity.

    A table holds every fingerprint under (number of the segment, its value). Every fingerprint probes each table at all values of the
    ball of radius 1 around its own segment; two of at most three differing bits agree so far in one of the two segments. Of what a value
    holds, the smallest node is fetched, so a value that many near copies share costs one row for each probe; the pairs among its
    other nodes are left to the exact join of the sets.
    """
    low = (1 << SEGMENT_BITS) - 1
    value = lambda s: F.shiftrightunsigned("fingerprint", s * SEGMENT_BITS).bitwiseAND(F.lit(low))
    key = lambda s, v: v.bitwiseOR(F.lit(s << SEGMENT_BITS))
    segments = range(64 // SEGMENT_BITS)
    entries = prints.select("node", "n", "fingerprint", F.explode(F.array(*[key(s, value(s)) for s in segments])).alias("key"))
    tables = stage(entries.groupBy("key").agg(F.min(F.struct("node", "n", "fingerprint")).alias("hub")))
    masks = [0] + [1 << b for b in range(SEGMENT_BITS)]
    ball = F.array(*[key(s, value(s).bitwiseXOR(F.lit(m))) for s in segments for m in masks])
    probes = prints.select("node", "n", "fingerprint", F.explode(ball).alias("key"))
    passed = might_hold(probes, F.col("key"), tables.select("key"), "_may").filter("_may").drop("_may")
    fetched = passed.join(tables, "key").select(
        F.col("hub.node").alias("src"), F.col("node").alias("dst"), F.col("hub.n").alias("n_src"), F.col("n").alias("n_dst"),
        F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("hub.fingerprint"))).alias("bits"),
    )
    sizes = F.least("n_src", "n_dst") >= similarity * F.greatest("n_src", "n_dst") - 1e-6
    return fetched.filter((F.col("src") != F.col("dst")) & (F.col("bits") <= PROBED_BITS) & sizes).drop("bits").distinct()


SET_MIX = np.uint64(0xBF58476D1CE4E5B9)  # an odd multiplier
# Bits of the parity bitmap of a set: the distance of two bitmaps never exceeds the number of elements the sets don't share.
MAP_WORDS, MAP_SHIFT = 16, np.uint64(20)
# A set of more elements than the bitmap has bits also has a wide one, with a bit for each element or more: the smallest power of two.
# How common a shingle is, is estimated from so many texts, or from so large a part of many, as passages that a fixed number would not
# meet often enough are shared by ever more texts of a larger table. Kept for so many shingles, it decides the order of the search only,
# never its result.
ORDER_TEXTS, ORDER_PART, ORDER_SHINGLES, ORDER_LEAST = 20_000, 1 / 16, 500_000, 3
# Pairs that a segment's table yields are checked on their sets up to so many differing bits of the whole fingerprint.
PROBED_BITS = 12
KEY_BITS = 48  # of a shingle's hash; shingles that share them are told apart by the exact check


def _distinct(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of each text in ascending order, and how many each text has."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], np.bincount(o[new], minlength=len(counts))


def _set_hashes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One hash for each set, whatever the order of its elements; zero for the empty set."""
    mixed = (hashes ^ (hashes >> np.uint64(31))) * SET_MIX
    mixed ^= mixed >> np.uint64(29)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * P1, dtype=np.uint64)))
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def _parity_maps(hashes: np.ndarray, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The bitmaps of the sets, of so many words each, one after the other; a set without words has none."""
    width = np.repeat(words, counts)
    first, hashes = np.repeat(np.cumsum(words) - words, counts)[width > 0], hashes[width > 0]
    bit = (hashes >> MAP_SHIFT) % (64 * width[width > 0]).astype(np.uint64)
    out = np.zeros(words.sum(), np.uint64)
    np.bitwise_xor.at(out, first + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def wide_words(counts: np.ndarray) -> np.ndarray:
    """Words of the wide bitmaps of sets of these sizes."""
    return np.where(counts > 64 * MAP_WORDS, 1 << np.ceil(np.log2(np.maximum(counts, 1) / 64)).astype(int).clip(0), 0)


def _bits_apart(a: str, b: str) -> Column:
    """In how many bits wide bitmaps differ; one twice as long as the other is folded, null for other lengths."""
    half = lambda m: (F.size(m) / 2).cast("int")
    folded = lambda m: F.zip_with(F.slice(m, 1, half(m)), F.slice(m, half(m) + 1, half(m)), lambda x, y: x.bitwiseXOR(y))
    like = lambda m, other: F.when(F.size(m) > F.size(other), folded(m)).otherwise(F.col(m))
    return F.aggregate(F.zip_with(like(a, b), like(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def prefix_sizes(counts: np.ndarray, similarity: float) -> np.ndarray:
    """How many first elements of a set, in an order all sets share, hold one of every set of this similarity."""
    return np.where(counts > 0, counts - np.ceil(similarity * counts - 1e-9).astype(np.int64) + 1, 0)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), values.view(np.int64))


def _common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of shingles that several of a sample of the texts (doc_id: hash of the text, text) hold, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in text_slices(batches):
            hashes, _ = _distinct(*shingle_hashes(found, words))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["h"])

    n = texts.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(max(n, 1))) < max(ORDER_TEXTS, ORDER_PART * n)
    held = texts.filter(part).dropDuplicates(["doc_id"]).mapInArrow(run, "h long").groupBy("h").count()
    top = held.filter(F.col("count") >= ORDER_LEAST).orderBy(F.desc("count"), "h").limit(ORDER_SHINGLES).toArrow()
    hashes, often = top["h"].to_numpy().view(np.uint64), top["count"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], often[order]


def set_rows(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc_id, node: hash of the set of shingles, n: its size, fingerprint, map, wide: its parity bitmaps, prefix: keys of the first
    elements) of every row of (doc_id: hash of the text, text); elements are ordered by how common they are, rare ones first."""
    known, often = _common_shingles(texts, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in text_slices(batches):
            shingles = shingle_hashes(found, words)
            prints = pa.array(majority(*shingles).astype("<u8").view(np.int64))
            hashes, counts = _distinct(*shingles)
            owner = np.repeat(np.arange(len(counts)), counts)
            rank = np.zeros(len(hashes), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                rank = np.where(known[at] == hashes, often[at], 0)
            ordered = hashes[np.lexsort((rank, owner))]  # stable: equally common ones stay in the order of their hashes
            taken = prefix_sizes(counts, similarity)
            place = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
            keys = ordered[place < np.repeat(taken, counts)] & np.uint64((1 << KEY_BITS) - 1)
            lengths = np.full(len(counts), MAP_WORDS), wide_words(counts)
            maps = [_lists(_parity_maps(hashes, counts, n), n) for n in lengths]
            nodes = pa.array(_set_hashes(hashes, counts).view(np.int64))
            columns = [ids, nodes, pa.array(counts), prints, *maps, _lists(keys, taken)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n", "fingerprint", "map", "wide", "prefix"])

    return texts.mapInArrow(run, "doc_id long, node long, n long, fingerprint long, map array<long>, wide array<long>, prefix array<long>")


def _first_rows(rows: DataFrame) -> DataFrame:
    """One of the staged rows for each node; what is shuffled are (node, row) and the rows of repeated nodes."""
    light = rows.select("node", "row")
    repeated = light.groupBy("node").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    later = stage(light.join(repeated.drop("times"), "node").filter("row <> first").select("row"))
    return without(rows, F.col("row"), later)


def _least_overlap(similarity: float) -> Column:
    """Elements that sets of sizes n_src and n_dst must share to have the similarity."""
    return F.ceil(similarity / (1 + similarity) * (F.col("n_src") + F.col("n_dst")) - 1e-6)


def _possible(similarity: float) -> Column:
    """Can two sets whose first common key lies at p_src and p_dst have the similarity? True for every pair that has it."""
    sizes = F.least("n_src", "n_dst") >= similarity * F.greatest("n_src", "n_dst") - 1e-6
    left = 1 + F.least(F.col("n_src") - F.col("p_src") - 1, F.col("n_dst") - F.col("p_dst") - 1)
    return sizes & (left >= _least_overlap(similarity))


def key_classes(members: DataFrame) -> DataFrame:
    """Members (key, node, n, pos, label, before) of classes of keys: keys with the same members are one, at the first place they have.

    `before` are the classes just before this one in the node's order, at most KEYS_BEFORE. Keys are told apart by hashes of their members;
    different ones under one hash have the members of both, which costs a few pairs and loses none.
    """
    held = members.groupBy("key").agg(*[F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"_{k}") for k in range(2)], F.count(F.lit(1)).alias("_n"))
    named = members.join(held.select("key", F.xxhash64("_0", "_1", "_n").alias("_class")), "key")
    classes = named.groupBy(F.col("_class").alias("key"), "node").agg(*[F.min(c).alias(c) for c in ("n", "pos", "label")])
    nearest = Window.partitionBy("node").orderBy("pos", "key").rowsBetween(-KEYS_BEFORE, -1)
    return classes.withColumn("before", F.collect_list("key").over(nearest))


def close_members(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs (src, dst, n_src, n_dst) of members (key, node, n, pos, label) of one key, not under one label yet, that sizes and positions allow.

    Sizes fall into bands so wide that only equal and neighbouring ones can be similar, so unlike sizes never meet. Two sets that share
    many keys meet at the first of them: a key is passed over if both have a common one just before it, as what the bounds allow
    here they allow there, too, and the first common key of a pair has none before it.
    """
    band = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / float(-np.log(similarity) * 1.0001))
    placed = stage(key_classes(members).withColumn("band", band))
    own = [F.col(c).alias(f"{d}_src") for c, d in MEMBER]
    left = placed.select("key", F.col("band").alias("_own"), F.explode(F.array("band", F.col("band") + 1)).alias("band"), *own)
    right = placed.select("key", "band", *[F.col(c).alias(f"{d}_dst") for c, d in MEMBER])
    once = (F.col("_own") != F.col("band")) | (F.col("i_src") < F.col("i_dst"))  # of one band both ways would meet
    apart = (F.col("l_src") != F.col("l_dst")) & once & _possible(similarity)
    met = left.join(right, ["key", "band"]).filter(apart & ~F.arrays_overlap("b_src", "b_dst"))
    src_first = F.col("i_src") < F.col("i_dst")
    ordered = [F.when(src_first, F.col(f"{d}_{x}")).otherwise(F.col(f"{d}_{y}")) for d in ("i", "n") for x, y in (("src", "dst"), ("dst", "src"))]
    return met.select(*[c.alias(n) for c, n in zip(ordered, ("src", "dst", "n_src", "n_dst"))]).distinct()


def _unjoined(pairs: DataFrame, labels: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Pairs (src, dst, `more`) whose sets have different labels; a set without one is by itself."""
    both = pairs.join(labels.toDF("src", "l_src"), "src", "left").join(labels.toDF("dst", "l_dst"), "dst", "left")
    return both.filter(F.coalesce("l_src", "src") != F.coalesce("l_dst", "dst")).select("src", "dst", *(more or []))


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of a key that are not joined to its last chosen one."""
    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = named.groupBy("key").agg(F.max(F.struct("weight", "node", "label")).alias("_hub")).select("key", F.col("_hub.label").alias("_first"))
    return named.join(first, "key").filter("label <> _first").select(*members.columns)


# Hubs are elected again, at most so often, until a round finds less than this part of the links before it; then all pairs left are compared.
HUB_ROUNDS, NEW_PART = 3, 16
MEMBER = (("node", "i"), ("n", "n"), ("pos", "p"), ("label", "l"), ("before", "b"))
KEYS_BEFORE = 8  # more of them cost room in every row and pass over hardly more keys


def similar_classes(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc_id, label) of the different doc_id of (doc_id: hash of the text, text): texts that a chain of pairs of this similarity
    connects share a label."""
    rows = stage(set_rows(texts, words, similarity).withColumn("row", F.monotonically_increasing_id()))
    classes, named = stage(_first_rows(rows)), stage(rows.select("doc_id", "node").distinct())
    unstage(rows)
    probes = classes.select("node", "n", F.posexplode("prefix").alias("pos", "key"))

    def weighted() -> DataFrame:
        """(node, n, pos, key, weight) of the keys that several sets have."""
        shared = stage(probes.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("key"))
        # filtered whatever the optimizer takes for the size of exploded rows; staged, so that adaptive execution can split the joins
        # where a group of near copies makes a key hot
        passed = might_hold(probes, F.col("key"), shared, "_may").filter("_may").drop("_may")
        members = stage(passed.join(shared, "key", "left_semi").select(*probes.columns))
        common = members.groupBy("node").agg((F.count(F.lit(1)) / F.max(F.floor(F.col("n") * (1 - similarity)) + 1)).alias("weight"))
        return members.join(common, "node")

    members = stage_result(weighted)

    def with_maps(pairs: DataFrame, column: str) -> DataFrame:
        asked = stage(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
        maps = only(classes, F.col("node"), asked).select("node", column)
        return pairs.join(maps.toDF("src", "m_src"), "src").join(maps.toDF("dst", "m_dst"), "dst")

    def near(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (src, dst, n_src, n_dst) that the parity bitmaps allow, with the number of bits the short ones differ in."""
        apart = sum((F.bit_count(F.get("m_src", k).bitwiseXOR(F.get("m_dst", k))) for k in range(MAP_WORDS)), F.lit(0))
        # similarity s leaves at most (1 - s) / (1 + s) of both sizes unshared
        bound = (1 - similarity) / (1 + similarity) * (F.col("n_src") + F.col("n_dst")) + 1e-6
        allowed = stage(with_maps(pairs, "map").withColumn("apart", apart).filter(F.col("apart") <= bound).drop("m_src", "m_dst"))
        long = F.least("n_src", "n_dst") > 64 * MAP_WORDS
        wide = with_maps(allowed.filter(long), "wide").filter(F.coalesce(_bits_apart("m_src", "m_dst") <= bound, F.lit(True)))
        return allowed.filter(~long).unionAll(wide.select(*allowed.columns)).select("src", "dst", "apart")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, some in text_slices(batches):
            yield pa.RecordBatch.from_arrays([ids, _lists(*_distinct(*shingle_hashes(some, words)))], ["node", "set"])

    def verified(close: DataFrame) -> DataFrame:
        """Those of the pairs (src, dst) whose sets have the similarity, from the texts themselves."""
        asked = stage(close.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
        firsts = stage(only(classes, F.col("node"), asked).select("node", "doc_id"))
        found = only(texts, F.col("doc_id"), firsts.select("doc_id").distinct()).join(firsts, "doc_id").select("node", "text")
        listed = stage(found.dropDuplicates(["node"]).mapInArrow(sets, "node long, set array<long>"))
        sized = close.join(listed.toDF("src", "a"), "src").join(listed.toDF("dst", "b"), "dst")
        common = F.size(F.array_intersect("a", "b"))
        return sized.filter(common >= similarity * (F.size("a") + F.size("b") - common)).select("src", "dst")

    def hub_pairs(number: int) -> DataFrame:
        """Pairs (src, dst, n_src, n_dst) of members with the chosen ones of a round."""
        if number == 0:
            return segment_pairs(classes.select("node", "n", "fingerprint"), similarity)
        hubs = placed.groupBy("key").agg(F.max(F.struct("weight", "node", "n", "pos")).alias("hub"))
        met = placed.join(hubs, "key").select(
            F.col("hub.node").alias("src"), F.col("node").alias("dst"), F.col("hub.n").alias("n_src"), F.col("n").alias("n_dst"),
            F.col("hub.pos").alias("p_src"), F.col("pos").alias("p_dst"),
        )
        stars = met.filter((F.col("src") != F.col("dst")) & _possible(similarity)).select("src", "dst", "n_src", "n_dst").distinct()
        return _unjoined(stars, labels, ["n_src", "n_dst"]) if number == 1 else stars

    # Round 0 takes the pairs that multi-index hashing of the fingerprints finds, the others join on keys. There
    # the member of a key with the largest part of its first elements in common with others, as the original of a group of copies
    # has, against all others joins most of what belongs together. Of the pairs that a set has with such members the closest is
    # verified first, and the others, together with the next pairs, only if they would still connect something. Then the members that
    # are still apart from it choose another one among themselves.
    linked, tried, waiting = 0, None, None
    labels = named.select("node", F.col("node").alias("label")).limit(0)
    placed = members
    for number in range(1 + HUB_ROUNDS):
        if number > 1:
            placed = stage(_apart(placed, labels))
        stars = stage_result(lambda: near(stage(hub_pairs(number))))
        asked = stars.groupBy("dst").agg(F.min(F.struct("apart", "src")).alias("m")).select("m.src", "dst")
        close = stage(asked if waiting is None else asked.unionAll(waiting))
        found = stage_result(lambda: verified(close))
        new, before = found.count(), linked
        linked += new
        # earlier components are stars already
        labels = stage_result(lambda: components(found.unionAll(labels.toDF("src", "dst"))))
        waiting = stage(_unjoined(stars, labels))
        tried = stars.select("src", "dst") if tried is None else tried.unionAll(stars.select("src", "dst"))
        if number and new * NEW_PART <= before:
            break

    def left_over() -> DataFrame:
        """Every pair that a key holds and that isn't joined yet."""
        placed = members.join(labels, "node", "left").select("key", "node", "n", "pos", F.coalesce("label", "node").alias("label"))
        parted = placed.groupBy("key").agg(F.min("label").alias("_a"), F.max("label").alias("_z")).filter("_a <> _z").select("key")
        apart = stage(only(placed, F.col("key"), stage(parted)))
        both = tried.unionAll(tried.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        rest = near(stage(close_members(apart, similarity))).select("src", "dst").join(both, ["src", "dst"], "left_anti")
        return rest.unionAll(waiting)

    rest = stage_result(left_over)
    if rest.limit(1).count():
        found = stage_result(lambda: verified(rest))
        labels = stage_result(lambda: components(found.unionAll(labels.toDF("src", "dst"))))
    return named.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("label"))


def _labelled(docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key) of every row, and (label, first: none, doc_id, text_key; text_key) of every text."""
    reach_package(docs.sparkSession)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("text_key"))
    texts = docs.select(text_key(F.col(text_col)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    labels = stage_result(lambda: similar_classes(texts, words, similarity).toDF("text_key", "label"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    return keyed, keyed.groupBy("text_key").agg(first).join(labels, "text_key")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id: the smallest doc_id that links of this similarity reach) of every row.

    All pairs of texts with this share of common shingles are found. Every row is judged by its own text, also where rows share
    an id or have none. Texts without words are one group.
    """
    keyed, texts = _labelled(docs, words, similarity, id_col, text_col)
    texts = stage(texts)
    firsts = texts.groupBy("label").agg(F.min("first")["doc_id"].alias("component_id"))
    named = stage(texts.join(firsts, "label").select("text_key", "component_id"))
    return keyed.join(named, "text_key").select("doc_id", "component_id")


def row_key(doc_id: Column, key: Column) -> Column:
    """Tells rows apart by id and text; a null id is one of its own."""
    return F.xxhash64(doc_id.isNull(), doc_id.cast("long"), key)


def first_of_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each of the similar groups, the one with the smallest id; null ids come last. Of equal rows one stays."""
    keyed, texts = _labelled(docs, words, similarity, id_col, text_col)
    own = row_key(F.col("doc_id"), F.col("text_key")).alias("row_key")
    firsts = texts.groupBy("label").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_key").select(own)
    counted = keyed.select(own).groupBy("row_key").agg(F.count(F.lit(1)).alias("times"))
    judged = stage(counted.join(firsts.withColumn("kept", F.lit(True)), "row_key", "left"))
    key = row_key(F.col(id_col), text_key(F.col(text_col)))
    kept = without(docs, key, judged.filter("kept is null").select("row_key"))
    repeated = judged.filter("kept and times > 1").select("row_key")
    if not repeated.limit(1).count():
        return kept
    return without(kept, key, repeated).unionAll(only(kept, key, repeated).dropDuplicates([id_col, text_col]))


def simhash_groups(docs: DataFrame, words: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id: the smallest doc_id that links reach)."""
    prints = stage(fingerprints(docs, words, id_col, text_col))
    classes = stage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    labels = components(links(classes, bits))
    joined = classes.join(labels, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first_id", F.coalesce("label", "fingerprint").alias("label")
    )
    smallest = joined.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = joined.join(smallest, "label").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
