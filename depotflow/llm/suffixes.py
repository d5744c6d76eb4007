"""Removal of repeated byte strings by a sparse, hash-compared suffix sort.

A byte goes if some string of `length` bytes that covers it also starts anywhere else. Sorting every suffix of a corpus is
not needed for that. Each window of `length` bytes picks the least of its gram hashes; equal windows pick the same place,
so suffixes are only sorted at these anchors (about one byte in sixty), and only where the gram at the anchor occurs twice.

* Anchors with equal surroundings (all bytes that a window over the anchor can reach) are one class, counted before the shuffle;
  a class of two or more is repeated as a whole. That takes care of copies, however many.
* Different classes at the same gram meet in one task. Prefix polynomial hashes give the common extension of two of them
  by binary search, so a mergesort compares suffixes in a logarithmic number of steps; once to the right and
  once to the left. Neighbours in each order are then compared byte by byte; where a hash deceived, the group is sorted anew by
  its bytes.
* Cutting both orders at depths that add up to a window leaves runs of equal left and right parts; two classes in the same pair of runs
  share that window. This is exact for every window, also for those that no two neighbours share.

Rows are told apart by a 64-bit hash of id and text, classes of surroundings by a 64-bit hash.
Nulls: a null text is empty. Texts shorter than `length` stay. Repeated rows are copies of each other, so both go.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from depotflow.llm.common import partitions, reach_package, stage, text_slices

LENGTH, GRAM = 200, 64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
KEY_BUCKETS = 1 << 20
CHUNK = 20_000  # classes compared at a time; a gram's classes are never parted


def mixed(h: np.ndarray) -> np.ndarray:
    """The known 64-bit finaliser: spreads the high bits of a polynomial hash over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Powers:
    """Powers of the base and of its inverse, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = (
                np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, np.uint64(x))))) for x in (BASE, pow(BASE, -1, 1 << 64))
            )


POWERS = Powers()


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    POWERS.reach(len(raw))
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * POWERS.up[: len(raw)], out=out[1:])
    return out


def _sliding(x: np.ndarray, width: int, best: np.ufunc, empty: np.uint64) -> np.ndarray:
    """best over x[i : i + width] for every i where that fits: block-wise running bests from both ends."""
    n = len(x)
    blocks = np.concatenate((x, np.full(-n % width, empty))).reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: n - width + 1], ahead[width - 1 : n])


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, place, gram hash, hash of the surroundings) of every anchor of the texts."""
    none = np.zeros(0, np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if len(raw) < length:
        return none, none, none, none
    wide, reach = length - gram + 1, length - gram
    sums = prefix_hashes(raw)
    places = len(raw) - gram + 1
    hashes = mixed((sums[gram:] - sums[:-gram]) * POWERS.down[:places])
    hashes[hashes == NEVER] -= np.uint64(1)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(places)
    whole = at + gram <= ends[owner[:places]]
    least = _sliding(np.where(whole, hashes, NEVER), wide, np.minimum, NEVER)
    starts = np.arange(len(least))
    chosen = np.where(starts + length <= ends[owner[: len(least)]], least, np.uint64(0))
    # a place is an anchor if one of the windows that hold its gram has it as its least
    edge = np.zeros(wide - 1, np.uint64)
    most = _sliding(np.concatenate((edge, chosen, edge)), wide, np.maximum, np.uint64(0))
    found = np.flatnonzero((most == hashes) & whole)
    text = owner[found]
    first, last = ends[text] - sizes[text], ends[text]
    left, right = np.minimum(found - first, reach), np.minimum(last - found - gram, reach)
    begin = found - left
    around = mixed((sums[found + gram + right] - sums[begin]) * POWERS.down[begin])
    around = mixed(around + left.astype(np.uint64) * np.uint64(1_000_003) + right.astype(np.uint64))
    return text, found - first, hashes[found].view(np.int64), around.view(np.int64)


def common(sums: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common beginning of rows a and b, at most depth, by binary search on prefix hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), depth)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high + 1) // 2
        same = sums[a, middle] == sums[b, middle]
        low = np.where(open_ & same, middle, low)
        high = np.where(open_ & ~same, middle - 1, high)


def suffix_order(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows (bytes) inside their groups, and the common beginning of each with the one before (-1 at a group's start).

    `group` is ascending. A bottom-up mergesort over all groups at once: each level finds by binary search how many rows
    of the sibling run come before a row; two rows compare at the end of their common beginning.
    """
    n, depth = rows.shape
    POWERS.reach(depth)
    sums = np.zeros((n, depth + 1), np.uint64)
    np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * POWERS.up[:depth], axis=1, out=sums[:, 1:])
    begin = np.searchsorted(group, group, "left")
    size = np.searchsorted(group, group, "right") - begin
    order = np.arange(n)
    width = 1
    while n and width < size.max():
        at = np.flatnonzero(size > width)  # places in groups that still have two runs
        inside = at - begin[at]
        run = inside // width
        sibling = begin[at] + (run ^ 1) * width
        low = np.minimum(sibling, begin[at] + size[at])
        high = np.minimum(sibling + width, begin[at] + size[at])
        second, start, me = run % 2 == 1, low.copy(), order[at]
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            middle = (low[live] + high[live]) // 2
            a, b = me[live], order[middle]
            same = common(sums, a, b, depth)
            cut = np.minimum(same, depth - 1)
            less = np.where(same < depth, rows[b, cut] < rows[a, cut], second[live])  # of equal rows the first run's come first
            low[live] = np.where(less, middle + 1, low[live])
            high[live] = np.where(less, high[live], middle)
        target = begin[at] + run // 2 * 2 * width + (inside - run * width) + (low - start)
        order[target] = me
        width *= 2
    shared = _shared(rows, order, group)
    # collision check: neighbours must be in the order of their bytes
    after, before = order[1:], order[:-1]
    near = np.flatnonzero((shared[1:] >= 0) & (shared[1:] < depth))
    cut = shared[1:][near]
    wrong = near[rows[after[near], cut] < rows[before[near], cut]]
    for g in np.unique(group[order[wrong]]) if len(wrong) else ():
        some = np.flatnonzero(group == g)
        order[some] = np.array(sorted(some.tolist(), key=lambda i: rows[i].tobytes()))
    return order, _shared(rows, order, group) if len(wrong) else shared


def _shared(rows: np.ndarray, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Common beginning of each row with the one before it in the order, byte by byte."""
    n, depth = rows.shape
    out = np.full(n, -1, np.int64)
    for s in range(1, n, 50_000):
        a, b = order[s : s + 50_000], order[s - 1 : s - 1 + len(order[s : s + 50_000])]
        differs = rows[a] != rows[b]
        lengths = np.where(differs.any(axis=1), differs.argmax(axis=1), depth)
        out[s : s + len(a)] = np.where(group[a] == group[b], lengths, -1)
    return out


def repeated_extents(
    bytes_: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, twice: np.ndarray, length: int = LENGTH, gram: int = GRAM
) -> tuple[np.ndarray, np.ndarray]:
    """How far repeated windows over the anchor reach to the left and right of its gram; -1 where there is none.

    bytes_: rows of reach + gram + reach bytes; left, right: how many of them exist; twice: the class itself occurs again.
    """
    n, reach = len(bytes_), length - gram
    # a gram hash may deceive: equal grams are a group, others are not
    _, gram_no = np.unique(np.ascontiguousarray(bytes_[:, reach : reach + gram]).view(f"V{gram}").ravel(), return_inverse=True)
    resort = np.lexsort((gram_no, group))
    key = np.concatenate(([0], np.cumsum((np.diff(group[resort]) != 0) | (np.diff(gram_no[resort]) != 0)))) if n else np.zeros(0, int)
    bytes_, left, right, twice = bytes_[resort], left[resort], right[resort], twice[resort]
    ways = [suffix_order(np.ascontiguousarray(x), key) for x in (bytes_[:, :reach][:, ::-1], bytes_[:, reach + gram :])]
    far_left, near_left = np.full(n, -1, np.int64), np.full(n, reach + 1, np.int64)
    for s in range(reach + 1):
        fits = (left >= s) & (right >= reach - s)
        runs = []
        for (order, shared), depth in zip(ways, (s, reach - s)):
            run = np.empty(n, np.int64)
            run[order] = np.cumsum(shared < depth)
            runs.append(run[fits])
        pair = runs[0] * (n + 1) + runs[1]
        sorted_ = np.sort(pair)
        again = sorted_[1:][sorted_[1:] == sorted_[:-1]]
        hit = np.flatnonzero(fits)[np.isin(pair, again) | twice[fits]]
        far_left[hit] = s
        near_left[hit] = np.minimum(near_left[hit], s)
    lefts, rights = np.empty(n, np.int64), np.empty(n, np.int64)
    lefts[resort], rights[resort] = far_left, np.where(far_left >= 0, reach - near_left, -1)
    return lefts, rights


def _parted(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be in `keys`, and those whose key is not, told by a table of occupied hash buckets.

    The table has at most KEY_BUCKETS rows, so it can be sent to every executor; once nearly all buckets are occupied it spares nothing.
    """
    bucket = F.pmod(F.col("key"), F.lit(KEY_BUCKETS)).alias("bucket")
    occupied = F.broadcast(keys.select(bucket).distinct())
    tagged = rows.select("*", bucket)
    return tuple(tagged.join(occupied, "bucket", how).drop("bucket") for how in ("left_semi", "left_anti"))


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, spans: (start, stop) of repeated stretches, unmerged) of (key, text), only for rows that have some."""
    reach, spark = length - gram, rows.sparkSession
    place = "gram long, around long, key long, at int"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_slices(batches):
            text, at, grams, around = anchors(texts, length, gram)
            columns = [pa.array(grams), pa.array(around), keys.take(pa.array(text)), pa.array(at.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "around", "key", "at"])

    # the anchors are found twice rather than stored: most grams occur once, and only their counts are shuffled then
    found = rows.select("key", "text").mapInArrow(find, place)
    often = stage(found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"))
    kept = stage(found.join(often, "gram"))
    classes = kept.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("one"))
    classes = stage(classes.select("gram", "around", (F.col("n") > 1).alias("twice"), "one.key", "one.at"))
    several = classes.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    wanted = classes.join(several, "gram")
    by_text = stage(wanted.groupBy("key").agg(F.collect_list(F.struct("gram", "around", "twice", "at")).alias("wanted")))  # of one text
    raw = F.col("text").cast("binary")
    maybe, _ = _parted(rows, by_text)
    texts = maybe.select("key", raw.alias("raw")).join(by_text, "key")

    def surroundings(w):
        left, right = F.least(w["at"], F.lit(reach)), F.least(F.octet_length("raw") - w["at"] - gram, F.lit(reach))
        piece = F.substring("raw", w["at"] - left + 1, left + right + gram)
        return F.struct(w["gram"].alias("gram"), w["around"].alias("around"), w["twice"].alias("twice"), left.alias("left"), piece.alias("piece"))

    pieces = texts.select(F.explode(F.transform("wanted", surroundings)).alias("w")).select("w.*")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            pieces, left = table.column("piece").to_pylist(), table.column("left").to_numpy()
            span = length - gram + length
            padded = b"".join((b"\0" * (reach - x) + p).ljust(span, b"\0") for p, x in zip(pieces, left.tolist()))
            rows_ = np.frombuffer(padded, np.uint8).reshape(len(pieces), span)
            right = np.array([len(p) for p in pieces]) - left - gram
            twice = table.column("twice").to_numpy()
            lefts, rights = repeated_extents(rows_, table.column("gram").to_numpy(), left, right, twice, length, gram)
            hit = np.flatnonzero(lefts >= 0)
            columns = [table.column(c).combine_chunks().take(pa.array(hit)) for c in ("gram", "around")]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array(lefts[hit].astype(np.int32)), pa.array(rights[hit].astype(np.int32))], ["gram", "around", "lefts", "rights"]
            )

        held: list[pa.RecordBatch] = []
        for batch in batches:  # sorted by gram
            held.append(batch)
            if sum(map(len, held)) >= CHUNK:
                table = pa.Table.from_batches(held)
                grams = table.column("gram").to_numpy()
                done = int(np.searchsorted(grams, grams[-1]))
                if done:
                    yield solve(table.slice(0, done))
                    held = table.slice(done).combine_chunks().to_batches()
        if held and sum(map(len, held)):
            yield solve(pa.Table.from_batches(held))

    met = pieces.repartition(partitions(spark), "gram").sortWithinPartitions("gram")
    extents = met.mapInArrow(extend, "gram long, around long, lefts int, rights int")
    alone = classes.join(several, "gram", "left_anti").filter("twice")
    reached = extents.unionByName(alone.select("gram", "around", F.lit(reach).alias("lefts"), F.lit(reach).alias("rights")))
    spans = kept.join(reached, ["gram", "around"]).select(
        "key", F.greatest(F.col("at") - F.col("lefts"), F.lit(0)).alias("start"), (F.col("at") + gram + F.col("rights")).alias("stop")
    )
    # what overlaps is merged when the text is cut; a text has fewer spans than bytes
    return spans.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept: the bytes that stay, kept_sha256) of every row."""
    reach_package(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("key"))
    spans = stage(repeated_spans(rows, length, gram))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist()):
                kept, upto, runs, removed = [], 0, 0, 0
                end = -1
                for s in sorted((x["start"], min(x["stop"], len(text))) for x in found or ()):
                    if s[0] > end:  # stretches that touch are one run
                        runs += 1
                        kept.append(text[upto : s[0]])
                        removed += s[1] - s[0]
                        upto = end = s[1]
                    elif s[1] > end:
                        removed += s[1] - end
                        upto = end = s[1]
                kept.append(text[upto:])
                whole = b"".join(kept)
                out.append((len(text), removed, runs, whole, hashlib.sha256(whole).hexdigest()))
            numbers, kinds = list(zip(*out)) if out else [[]] * 5, [pa.int64()] * 3 + [pa.binary(), pa.string()]
            columns = [pa.array(list(x), k) for x, k in zip(numbers, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    maybe, clean = _parted(rows, spans)
    joined = maybe.join(spans, "key", "left").select("doc_id", "text", "spans")
    whole = joined.unionByName(clean.select("doc_id", "text", F.lit(None).cast(joined.schema["spans"].dataType).alias("spans")))
    return whole.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
