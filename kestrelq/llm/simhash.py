"""SimHash near-duplicates: fingerprints of word shingles, linked by bit-sliced comparison.

Equal fingerprints become one node first, so copies cost nothing further. Candidates are exact: the 64 bits are cut into blocks, and
two fingerprints that differ in at most `radius` bits agree on all but `radius` of the blocks, so each choice of the remaining blocks
is a key. The number of blocks follows the number of fingerprints, so that a key meets few of them by chance; the links found are
the same for any number. A key that meets very many fingerprints is dealt out again by blocks of its remaining bits.

Fingerprints that share a key are compared at growing distance in their sorted order. Their bits lie in vertical planes of 64-bit
words, so one operation serves 64 pairs; differing bits are added up in carry-save counters, and a word of pairs is left as soon as
all of them exceed the radius or are connected already. A group yields links that connect it, not all its pairs.

The pipeline's stage (`similar_texts`, `deduplicate`) links texts by the Jaccard similarity of their sets of five-word shingles. Texts meet in
cells by the least hashes of their shingles; within a cell the fingerprints of these sets are compared by the same bit planes, and pairs
within the radius by their whole sets. A link is left out with odds of about one in a million for a pair at the least similarity, less above;
neither the order of documents nor the size of a cell or group matters.

Defined results: a null or empty text, or one of white space, has fingerprint zero and links like any other; texts of fewer words than a
shingle are one shingle; very long texts are read whole; repeated rows and ties share a node; the smallest doc_id that is not null names
a component and stays in the stage, of equal doc_ids with different texts that of the smaller hash, of repeated rows one; an empty table
gives an empty one; other columns, also those named like its own, are ignored, and passed through by the stage.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelq.llm.common import WordHashes, Workspace, factors, partitions, slices, table, trimmed
from kestrelq.llm.graph import components
from kestrelq.llm.substring import _pack, _unpack

BITS, SEED, SHINGLE, RADIUS = 64, 42, 4, 4
#: Of the pipeline's stage: shingles of five words whose sets have this Jaccard similarity. Texts meet by the least KEEP hashes of their
#: shingles; their fingerprints lie within WIDE bits unless they have fewer than FEW shingles, where that says too little.
STAGE_SHINGLE, SIMILARITY, KEEP, WIDE, FEW = 5, 0.8, 16, 26, 32
#: Odds at most of leaving out a pair by what its least hashes have in common.
ODDS = 1e-6
BROADCAST_ROWS = 100_000
#: A frequent shingle is in OFTEN of FREQUENT_OF texts, counted over all; how many are known; texts and shingles of one side of a cell, in
#: which texts are compared. None changes the result.
FREQUENT_OF, OFTEN, FREQUENT, CELL_ROWS, CELL_SHINGLES = 10_000, 4, 100_000, 1_024, 1 << 18
#: Shingles that are counted at once, bytes of text for each, about, and how their counts are packed.
TOKENS_AT_ONCE, BYTES_A_SHINGLE, COUNTED = 1 << 18, 6, (("<u8", 8, True), ("<u4", 4, False))
#: Least hashes that a text has in common with a centre that it is compared with; those left out meet later.
STAR_SHARED = 4
#: Pairs whose least hashes are compared at once.
PAIRS_AT_ONCE = 10_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SHINGLES_AT_ONCE = 1 << 16
#: Estimated seconds that a row of a key and a compared pair take; they choose the number of blocks, never the result.
ROW_S, PAIR_S = 3e-6, 8e-9
#: Rows of one key from which it is dealt out again.
HOT_KEY = 1 << 15
ROWS_AT_ONCE, CELLS_AT_ONCE = 1 << 16, 1 << 14
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        begins, ends = begins[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        begins, ends = begins[:1], ends[-1:]
    counts, n = np.zeros(BITS, np.int64), len(begins)
    for at in range(0, n, SHINGLES_AT_ONCE):
        hashes = np.array([xxh64_intdigest(whole[a:b], seed) for a, b in zip(begins[at : at + SHINGLES_AT_ONCE].tolist(), ends[at : at + SHINGLES_AT_ONCE].tolist(), strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, doc_key (a hash of the text) and the fingerprint's 64 bits as a long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = np.array([fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("doc_key"), pa.array(made.view(np.int64))], ["doc_id", "doc_key", "print"])

    return keyed(docs).mapInArrow(trimmed(run), "doc_id long, doc_key long, print long")


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("doc_key"), text.alias("text"))


# --- comparison ----------------------------------------------------------------------------------------------------------------


def _packed(flags: np.ndarray) -> np.ndarray:
    out = np.zeros((len(flags) + 63) // 64 * 8, np.uint8)
    packed = np.packbits(flags, bitorder="little")
    out[: len(packed)] = packed
    return out.view(np.uint64)


def _planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes, those that change most between neighbours first; a spare word at the end for shifting."""
    bits = np.unpackbits(np.ascontiguousarray(prints, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    order = np.argsort(-(bits[:, 1:] != bits[:, :-1]).sum(axis=1), kind="stable")
    words = (len(prints) + 63) // 64
    out = np.zeros((BITS, words + 1), np.uint64)
    packed = np.packbits(bits[order], axis=1, bitorder="little")
    out.view(np.uint8)[:, : packed.shape[1]] = packed
    return out


def _near(planes: np.ndarray, step: int, wanted: np.ndarray, radius: int) -> np.ndarray:
    """Of the wanted pairs (i, i + step), packed: those that differ in at most `radius` bits, as positions i."""
    skip, low = divmod(step, 64)
    words = np.flatnonzero(wanted)
    far = ~wanted[words]
    width = (radius + 1).bit_length()
    counters = [np.zeros(len(words), np.uint64) for _ in range(width)]
    limit = planes.shape[1] - 1
    for k in range(0, BITS, 2):
        there = words + skip
        x, y = (_differ(planes[j], words, there, low, limit) for j in (k, k + 1))
        # carry-save: two planes and the ones make a sum and a carry, which ripples on
        half = counters[0] ^ x
        carry = (counters[0] & x) | (half & y)
        counters[0] = half ^ y
        for j in range(1, width):
            counters[j], carry = counters[j] ^ carry, counters[j] & carry
        far |= carry
        if k % 8 == 6:
            far |= _exceeds(counters, radius)
            alive = far != ALL
            if not alive.all():
                words, far, counters = words[alive], far[alive], [c[alive] for c in counters]
            if not len(words):
                return words
    far |= _exceeds(counters, radius)
    bits = np.unpackbits(np.ascontiguousarray(~far).view(np.uint8), bitorder="little").reshape(-1, 64)
    row, bit = np.nonzero(bits)
    return words[row] * 64 + bit


def _differ(plane: np.ndarray, here: np.ndarray, there: np.ndarray, low: int, limit: int) -> np.ndarray:
    shifted = plane[np.minimum(there, limit)] >> np.uint64(low)
    if low:
        shifted |= plane[np.minimum(there + 1, limit)] << np.uint64(64 - low)
    return plane[here] ^ shifted


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Bitwise: whether the counter is above the radius."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ALL)
    for j in range(len(counters) - 1, -1, -1):
        if radius >> j & 1:
            equal &= counters[j]
        else:
            above |= equal & counters[j]
            equal &= ~counters[j]
    return above


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a to b; a label is the smallest position of its component."""
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        if not len(a):
            break
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(la, lb), np.minimum(la, lb))
        while (next_ := to[to]).tobytes() != to.tobytes():
            to = next_
        label = to[label]
    return label


def link(bucket: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each bucket, all fingerprints that differ in at most `radius` bits; buckets lie one after another."""
    n = len(prints)
    label, kept = np.arange(n), np.arange(n)
    step, until = 1, 16
    while True:
        # what is left: buckets of more than `step` rows that are not one component yet
        own, first, size = np.unique(bucket[kept], return_index=True, return_counts=True)
        if not len(own):
            break
        least, most = np.minimum.reduceat(label[kept], first), np.maximum.reduceat(label[kept], first)
        kept = kept[np.repeat((size > step) & (least != most), size)]
        if len(kept) < 2:
            break
        planes, group = _planes(prints[kept]), bucket[kept]
        while step < until:
            wanted = group[step:] == group[:-step] if step < len(kept) else np.zeros(0, bool)
            if not wanted.any():
                break
            now = label[kept]
            wanted &= now[step:] != now[:-step]
            if wanted.any():
                at = _near(planes, step, _packed(wanted), radius)
                if len(at):
                    label = _joined(label, kept[at], kept[at + step])
            step += 1
        if step < until:
            break
        until *= 2
    moved = np.flatnonzero(label != np.arange(n))
    return prints[moved], prints[label[moved]]


def _masks(parts: list[list[int]], agree: int) -> list[int]:
    return [sum(1 << b for p in chosen for b in p) for chosen in combinations(parts, agree)]


def _cut(bits: list[int], n: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(bits, n)]


def plan(n: int, radius: int) -> list[int]:
    """The masks of the keys: as many blocks as cost least for n fingerprints; fewer blocks are fewer keys, more are finer ones."""

    def cost(blocks: int) -> float:
        return comb(blocks, radius) * (ROW_S + n / 2 ** (BITS * (blocks - radius) / blocks) / 2 * PAIR_S)

    blocks = min(range(radius + 1, min(BITS, radius + 6)), key=cost)
    return _masks(_cut(list(range(BITS)), blocks), blocks - radius)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keys(prints: DataFrame, masks: list[int]) -> DataFrame:
    options = F.array(*(F.struct(F.lit(i).alias("mask"), F.col("print").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)))
    return prints.select("print", F.explode(options).alias("x")).select("x.mask", "x.key", "print")


def _links(keyed: DataFrame, by: list[str], radius: int) -> DataFrame:
    """Links of rows that share the columns `by`; the rows come sorted, whole groups are compared together."""
    dealt = keyed.repartition(partitions(keyed.sparkSession), *by).sortWithinPartitions(*by, "print")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[np.ndarray], np.ndarray]] = []
        rows = 0

        def compared(keys: list[np.ndarray], prints: np.ndarray) -> pa.RecordBatch:
            new = np.concatenate(([0], np.cumsum(np.any([k[1:] != k[:-1] for k in keys], axis=0)))) if len(prints) > 1 else np.zeros(len(prints), np.int64)
            a, b = link(new, prints.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            held.append(([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in by], batch.column("print").to_numpy(zero_copy_only=False).astype(np.int64)))
            rows += batch.num_rows
            if rows < ROWS_AT_ONCE:
                continue
            keys, prints = [np.concatenate([h[0][i] for h in held]) for i in range(len(by))], np.concatenate([h[1] for h in held])
            same = np.all([k == k[-1] for k in keys], axis=0)
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last group may go on
            if cut:
                yield compared([k[:cut] for k in keys], prints[:cut])
            held, rows = [([k[cut:] for k in keys], prints[cut:])], len(prints) - cut if cut else 0
        if held:
            yield compared([np.concatenate([h[0][i] for h in held]) for i in range(len(by))], np.concatenate([h[1] for h in held]))

    return dealt.mapInArrow(trimmed(run), "a long, b long")


def links(prints: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect all of the n different fingerprints that are within the radius of each other."""
    masks = plan(n, radius)
    # dealt out by number, which adaptive execution leaves as it is: a task compares much more than its few bytes tell
    dealt = _keys(prints, masks).repartition(partitions(prints.sparkSession), "mask", "key")
    sized = dealt.selectExpr("*", "count(1) OVER (PARTITION BY mask, key) AS n")
    cold = _links(sized.filter(f"n BETWEEN 2 AND {HOT_KEY}"), ["mask", "key"], radius)
    # in a hot key the pairs agree on one of radius + 1 blocks of its other bits
    again = [[m for m in _masks(_cut([b for b in range(BITS) if not mask >> b & 1], radius + 1), 1)] for mask in masks]
    inner = F.array(*(F.array(*(F.lit(_signed(m)) for m in row)) for row in again))[F.col("mask")]
    hot = sized.filter(f"n > {HOT_KEY}").select("mask", "key", "print", F.posexplode(inner).alias("sub", "bits")).withColumn("rest", F.col("print").bitwiseAND(F.col("bits"))).drop("bits")
    return cold.unionByName(_links(hot, ["mask", "key", "sub", "rest"], radius))


def grouped(docs: DataFrame, work: Workspace, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, doc_key, print, component_id: the smallest doc_id that links reach."""
    found = work.save(fingerprints(docs, shingle), "prints")
    nodes = found.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    n = nodes.count()
    edges = work.save(links(nodes.select("print"), n, radius), "links")
    stars = components(edges, work)
    rooted = nodes.join(stars.withColumnRenamed("a", "print"), "print", "left").withColumn("root", F.coalesce("b", "print"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = work.save(rooted.join(least, "root").select("print", "root", "component_id"), "named")
    return found.join(named, "print")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint as 16 hexadecimal digits, component_id: the smallest doc_id that links reach."""
    found = grouped(docs, Workspace(docs.sparkSession, "simhash"), shingle, radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


# --- deduplication ---------------------------------------------------------------------------------------------------------------


class Shingles:
    """Hashes of a text's different word shingles, sorted; fewer words are one shingle, no words too."""

    def __init__(self, size: int):
        self.size, self.words, self.factors = size, WordHashes(), factors(size, 1)[0]

    def of(self, text: str | None) -> np.ndarray:
        own = self.words.of((text or "").encode().translate(LOWER).split())
        n = max(1, len(own) - self.size + 1)
        total = np.zeros(n, np.uint64)
        for j in range(min(self.size, len(own))):
            total += own[j : j + n] * self.factors[j]
        # sums of words are spread over all bits
        total ^= total >> np.uint64(33)
        total *= np.uint64(0xFF51AFD7ED558CCD)
        total ^= total >> np.uint64(33)
        return np.unique(total)


def _print(own: np.ndarray) -> int:
    """The fingerprint of a set of hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(own), SHINGLES_AT_ONCE):
        counts += np.unpackbits(np.ascontiguousarray(own[at : at + SHINGLES_AT_ONCE], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(own), bitorder="little").view("<i8")[0])


def _of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked documents (asked_id, asked_key and other columns) with doc_id, doc_key and text."""
    few = asked.count() <= BROADCAST_ROWS
    return keyed(docs).join(F.broadcast(asked) if few else asked, F.col("doc_id").eqNullSafe(F.col("asked_id")) & F.col("doc_key").eqNullSafe(F.col("asked_key"))).drop("asked_id", "asked_key")


def _frequent(docs: DataFrame, shingle: int) -> np.ndarray:
    """Sorted hashes of the shingles that OFTEN of FREQUENT_OF texts have, OFTEN at least, counted over all texts: the FREQUENT most common ones. Any choice gives the same links."""
    n, size = docs.select(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()
    least, buckets = max(OFTEN, -(-OFTEN * n // FREQUENT_OF)), max(1, size // BYTES_A_SHINGLE // TOKENS_AT_ONCE)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        bucket = ((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(tokens)]))
        blobs = [_pack((tokens[i:j], counts[i:j].astype(np.uint32)), COUNTED) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(blobs, pa.binary())], ["bucket", "payload"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, n = Shingles(shingle), [], 0
        for batch in slices(batches, "text"):
            for t in batch.column("text").to_pylist():
                held.append(made.of(t))
                n += len(held[-1])
                if n >= TOKENS_AT_ONCE:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, n = None, [], 0

        def summed() -> list[tuple[np.ndarray, np.ndarray]]:
            tokens, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            tokens, place = np.unique(tokens, return_inverse=True)
            return [(tokens, np.bincount(place, counts).astype(np.int64))]

        def often() -> pa.RecordBatch:
            tokens, counts = summed()[0]
            known = counts >= least
            return pa.RecordBatch.from_arrays([pa.array(tokens[known].view(np.int64)), pa.array(counts[known])], ["token", "count"])

        for batch in batches:
            for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload"), strict=True):
                if bucket != at:
                    if held:
                        yield often()
                    at, held, n = bucket, [], 0
                tokens, counts = _unpack(payload.as_buffer(), COUNTED)
                held.append((tokens, counts.astype(np.int64)))
                n += len(tokens)
                if n > 4 * TOKENS_AT_ONCE:  # what repeats is summed up before the bucket ends
                    held = summed()
                    n = 0
        if held:
            yield often()

    tokens = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), "bucket int, payload binary")
    dealt = tokens.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(trimmed(total), "token long, count long").orderBy(F.desc("count"), "token").limit(FREQUENT).collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def sketches(docs: DataFrame, shingle: int, often: np.ndarray, keep: int = KEEP) -> DataFrame:
    """doc_id, doc_key, set_key (a hash of the shingles), size, rare (how many are not frequent), print, low and all.

    low: the least `keep` hashes of those not frequent; all: the least of all, for texts most of whose shingles are frequent, else null.
    """
    known = docs.sparkSession.sparkContext.broadcast(often)  # FREQUENT numbers at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        made, frequent = Shingles(shingle), known.value
        for batch in slices(batches, "text"):
            sets, size, rare, prints, low, every = [], [], [], [], [], []
            for t in batch.column("text").to_pylist():
                own = made.of(t)
                scarce = own
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                    scarce = own[frequent[at] != own]
                sets.append(xxh64_intdigest(own.tobytes()) - (1 << 63))
                size.append(len(own))
                rare.append(len(scarce))
                prints.append(_print(own))
                low.append(scarce[:keep].view(np.int64))
                every.append(own[:keep].view(np.int64) if 4 * len(scarce) < 3 * len(own) else None)
            longs, ints = pa.int64(), pa.int32()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("doc_key"), pa.array(sets, longs), pa.array(size, ints), pa.array(rare, ints), pa.array(prints, longs), pa.array(low, pa.list_(longs)), pa.array(every, pa.list_(longs))], ["doc_id", "doc_key", "set_key", "size", "rare", "print", "low", "all"])

    return keyed(docs).mapInArrow(trimmed(run), "doc_id long, doc_key long, set_key long, size int, rare int, print long, low array<long>, all array<long>")


def shared_at_least(keep: int = KEEP, odds: float = ODDS) -> list[int]:
    """For a similarity of i / 100: how many of their least hashes two sets have in common but for such odds."""
    out = []
    for i in range(101):
        total, c = 0.0, 0
        while c < keep and (total := total + comb(keep, c) * (i / 100) ** c * (1 - i / 100) ** (keep - c)) <= odds:
            c += 1
        out.append(c)
    return out


def _least_shared(size_a: np.ndarray, size_b: np.ndarray, rare_a: np.ndarray, rare_b: np.ndarray, whole: np.ndarray, similarity: float) -> np.ndarray:
    """How many of the least hashes two texts of that similarity have in common at least."""
    # at most (1 - s) / s of the smaller one's shingles are not shared, so that of the union of the scarce ones this share is
    scarce = 1 - (1 - similarity) / similarity * np.minimum(size_a, size_b) / np.maximum(1, np.maximum(rare_a, rare_b))
    likely = np.floor(100 * np.where(whole, similarity, np.clip(scarce, 0, 1)) + 1e-9).astype(np.int64)
    return np.maximum(1, np.array(shared_at_least())[likely])


def pairs_within(bucket: np.ndarray, prints: np.ndarray, label: np.ndarray, few: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of one bucket with different labels that differ in at most `radius` bits or are both marked `few`; buckets lie one after another."""
    kept, step, until = np.arange(len(prints)), 1, 16
    while True:
        own, first, size = np.unique(bucket[kept], return_index=True, return_counts=True)
        if not len(own):
            return
        least, most = np.minimum.reduceat(label[kept], first), np.maximum.reduceat(label[kept], first)
        kept = kept[np.repeat((size > step) & (least != most), size)]
        if len(kept) < 2:
            return
        planes, group, now, small = _planes(prints[kept]), bucket[kept], label[kept], few[kept]
        while step < until:
            wanted = (group[step:] == group[:-step]) & (now[step:] != now[:-step]) if step < len(kept) else np.zeros(0, bool)
            if wanted.any():
                at = _near(planes, step, _packed(wanted), radius)
                if small.any():
                    at = np.union1d(at, np.flatnonzero(wanted & small[step:] & small[:-step]))
                if len(at):
                    yield kept[at], kept[at + step]
            step += 1
        until *= 2


def _lists(column: pa.Array, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of `keep` hashes for each list, and the lengths."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    out = np.zeros((len(sizes), keep), np.uint64)
    out[np.arange(keep) < sizes[:, None]] = flat
    return out, sizes


CELL = ["whole", "token", "x", "y"]


def _candidates(rows: DataFrame, keep: int, radius: int, similarity: float) -> DataFrame:
    """Rows (cell, set_key) of those that may be similar to one of another label in their cell, in the cell of the least hash that both have."""
    dealt = rows.repartition(partitions(rows.sparkSession), *CELL).sortWithinPartitions(*CELL)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def compared(whole: pa.Table) -> Iterator[pa.RecordBatch]:  # a row of the table gives one at most
            col = lambda c: whole.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
            cells = np.stack([col(c) for c in CELL])
            bucket = np.concatenate(([0], np.cumsum(np.any(cells[:, 1:] != cells[:, :-1], axis=0))))
            key, label, size, rare, side = (col(c) for c in ("set_key", "label", "size", "rare", "side"))
            lists, lengths = _lists(whole.column("hashes").combine_chunks(), keep)
            other = np.where(np.arange(keep) < lengths[:, None], lists, np.uint64(1))  # what fills up never matches
            across, is_whole, token, met = cells[2] != cells[3], cells[0] != 0, cells[1].view(np.uint64), np.zeros(len(key), bool)
            for i_all, j_all in pairs_within(bucket, col("print").view(np.uint64), label, size < FEW, radius):
                for at in range(0, len(i_all), PAIRS_AT_ONCE):
                    i, j = i_all[at : at + PAIRS_AT_ONCE], j_all[at : at + PAIRS_AT_ONCE]
                    fit = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9
                    fit &= ~across[i] | (side[i] != side[j])  # of two parts only pairs of one with the other
                    i, j = i[fit], j[fit]
                    if not len(i):
                        continue
                    equal = (lists[i][:, :, None] == other[j][:, None, :]).any(axis=2)
                    first = lists[i, equal.argmax(axis=1)]
                    short = (lengths[i] < keep) | (lengths[j] < keep)
                    enough = equal.sum(axis=1) >= np.where(short, 1, _least_shared(size[i], size[j], rare[i], rare[j], is_whole[i], similarity))
                    good = enough & (first == token[i])
                    met[i[good]] = met[j[good]] = True
            yield pa.RecordBatch.from_arrays([pa.array(_mixed(cells[:, met])), pa.array(key[met]), pa.array(label[met])], ["cell", "set_key", "label"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CELLS_AT_ONCE:
                now = pa.Table.from_batches(held)
                last = now.slice(n - 1, 1)
                same = np.all([now.column(c).to_numpy() == last.column(c).to_numpy()[0] for c in CELL], axis=0)
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last cell may go on
                if cut:
                    yield from compared(now.slice(0, cut))
                held, n = now.slice(cut).to_batches(), n - cut
        if n:
            yield from compared(pa.Table.from_batches(held))

    return dealt.mapInArrow(trimmed(run), "cell long, set_key long, label long")


def _mixed(cells: np.ndarray) -> np.ndarray:
    """One number for each cell."""
    out = np.zeros(cells.shape[1], np.uint64)
    for row in cells:
        out = (out ^ row.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _texts(docs: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Members (cell, set_key and other columns) with their text."""
    return _of(docs, members.join(nodes.select("set_key", F.col("first.doc_id").alias("asked_id"), F.col("first.doc_key").alias("asked_key")), "set_key"))


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Of pairs (cell, a, b), of which a is the same in a cell: the links (a, b) whose whole sets of shingles are similar enough."""
    spark = docs.sparkSession
    members = pairs.select("cell", F.col("b").alias("set_key"), F.lit(1).alias("kind")).unionByName(pairs.select("cell", F.col("a").alias("set_key"), F.lit(0).alias("kind")).distinct())
    dealt = _texts(docs, nodes, members).select("cell", "kind", "set_key", "text").repartition(partitions(spark), "cell").sortWithinPartitions("cell", "kind", "set_key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, cell, centre, own, last = Shingles(shingle), None, 0, None, None
        for whole in batches:
            for batch in slices([whole], "text"):
                a_out, b_out = [], []
                for c, kind, key, text in zip(batch.column("cell").to_pylist(), batch.column("kind").to_pylist(), batch.column("set_key").to_pylist(), batch.column("text"), strict=True):
                    if (c, kind, key) == last:  # a repeated row
                        continue
                    last = (c, kind, key)
                    if c != cell:
                        cell, centre, own = c, key, made.of(text.as_py())
                    elif _alike(own, made.of(text.as_py()), similarity):
                        a_out.append(centre)
                        b_out.append(key)
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(trimmed(run), "a long, b long")


def _linked(docs: DataFrame, nodes: DataFrame, members: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Of members (cell, set_key, label): links (a, b) that connect, within each cell, all whose whole sets of shingles are similar enough and whose labels differ."""
    spark = docs.sparkSession
    dealt = _texts(docs, nodes, members).select("cell", "set_key", "label", "text").repartition(partitions(spark), "cell").sortWithinPartitions("cell", "label", "set_key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, cell, keys, labels, sets = Shingles(shingle), None, [], [], []

        def flush() -> pa.RecordBatch:
            a, b = _connected(np.array(labels, np.int64), sets, similarity) if len(sets) > 1 else ([], [])
            return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in a], pa.int64()), pa.array([keys[i] for i in b], pa.int64())], ["a", "b"])

        for whole in batches:
            for batch in slices([whole], "text"):
                for c, key, label, text in zip(batch.column("cell").to_pylist(), batch.column("set_key").to_pylist(), batch.column("label").to_pylist(), batch.column("text"), strict=True):
                    if c != cell:
                        yield flush()
                        cell, keys, labels, sets = c, [], [], []
                    if not keys or keys[-1] != key:  # else a repeated row
                        keys.append(key)
                        labels.append(label)
                        sets.append(made.of(text.as_py()))
        yield flush()

    return dealt.mapInArrow(trimmed(run), "a long, b long")


def _connected(labels: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links between labels, as positions: a number of them that connects what similar sets connect. Those of the largest label are compared with others alone."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(sets)), sizes)[order]
    label = np.unique(labels, return_inverse=True)[1]
    largest, a, b = np.bincount(label).argmax(), [], []
    for i in np.flatnonzero(label != largest).tolist():
        if (label == label[i]).all():
            break
        own = sets[i]
        low, high = np.searchsorted(flat, own), np.searchsorted(flat, own, "right")
        n = high - low
        shared = np.bincount(owner[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(sets))
        alike = np.flatnonzero((shared >= similarity * (sizes[i] + sizes - shared) - 1e-9) & (label != label[i]))
        for j in alike.tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                a.append(i)
                b.append(j)
    return a, b


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    shared = _common(x, y)
    return shared >= similarity * (len(x) + len(y) - shared) - 1e-9


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many numbers two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def _stars(rows: DataFrame, few: bool, similarity: float, radius: int) -> DataFrame:
    """Pairs (cell, a, b) of each text with the centre of its shingle's texts, the one nearest to the majority of their fingerprints."""
    ups = [F.sum(F.getbit("print", F.lit(i))).alias(f"u{i}") for i in range(BITS)]
    bits = [F.when(2 * F.col(f"u{i}") > F.col("n"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i in range(BITS)]
    middle = bits[0]
    for b in bits[1:]:
        middle = middle.bitwiseOR(b)
    middles = rows.groupBy("whole", "token").agg(F.count("*").alias("n"), *ups).select("whole", "token", middle.alias("middle"))
    apart = F.bit_count(F.col("print").bitwiseXOR(F.col("middle")))
    small = F.broadcast if few else lambda x: x  # a row of bounded width for each token
    nearest = rows.join(small(middles), ["whole", "token"]).groupBy("whole", "token").agg(F.min(F.struct(apart.alias("apart"), "set_key", "size", "print", "hashes")).alias("centre"))
    both = rows.join(small(nearest), ["whole", "token"]).filter("set_key <> centre.set_key")
    close = (F.bit_count(F.col("print").bitwiseXOR(F.col("centre.print"))) <= radius) | ((F.col("size") < FEW) & (F.col("centre.size") < FEW))
    enough = F.size(F.array_intersect("hashes", "centre.hashes")) >= F.least(F.lit(STAR_SHARED), F.size("hashes") / 2)
    fit = both.filter(close & enough & (F.least("size", "centre.size") >= similarity * F.greatest("size", "centre.size") - 1e-9))
    cell = F.xxhash64("centre.set_key", F.pmod(F.xxhash64("set_key"), F.col("parts").cast("long")))
    return fit.groupBy(F.col("centre.set_key").alias("a"), F.col("set_key").alias("b")).agg(F.min(cell).alias("cell")).select("cell", "a", "b")


def similar_texts(docs: DataFrame, work: Workspace, shingle: int = STAGE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, doc_key, set_key, group: the least set_key that links reach, where links join all texts of that similarity.

    Texts of equal shingle sets are one node. Nodes meet in cells by the least hashes of their shingles, frequent shingles aside: two sets
    of that similarity miss each other there with odds of a third, or less, to the power of `KEEP`. Nodes of mostly frequent shingles also meet by
    the least hashes of all. First each node is compared with the centre of each cell, which joins copies of one text; then, in
    cells that still hold several groups, fingerprints of all pairs of two groups are compared by bit planes, and those within the radius
    that have enough of their least hashes in common are compared by their whole sets. A cell of many nodes is dealt out by pairs of its parts.
    """
    found = work.save(sketches(docs, shingle, _frequent(docs, shingle)), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc_key")).alias("first")
    nodes = work.save(found.groupBy("set_key").agg(first, *(F.first(c).alias(c) for c in ("size", "rare", "print", "low", "all"))), "nodes")
    families = F.array(F.struct(F.lit(0).alias("whole"), F.col("low").alias("hashes")), F.struct(F.lit(1).alias("whole"), F.col("all").alias("hashes")))
    each = nodes.select("set_key", "size", "rare", "print", F.explode(families).alias("f")).filter("f.hashes IS NOT NULL").select("set_key", "size", "rare", "print", "f.whole", "f.hashes", F.explode("f.hashes").alias("token"))
    parts = F.ceil(F.greatest(F.count("*") / CELL_ROWS, F.sum("size") / CELL_SHINGLES)).cast("int").alias("parts")
    open_ = work.save(each.groupBy("whole", "token").agg(F.count("*").alias("n"), parts).filter("n > 1").drop("n"), "open")
    n_open = open_.count()
    rows = work.save(each.join(F.broadcast(open_) if n_open <= BROADCAST_ROWS else open_, ["whole", "token"]), "rows")
    stars = work.save(_verified(docs, nodes, work.save(_stars(rows, n_open <= BROADCAST_ROWS // 8, similarity, WIDE), "star-pairs"), shingle, similarity), "stars-found")
    known = components(stars, work)
    labelled = work.save(rows.join(known.withColumnRenamed("a", "set_key"), "set_key", "left").withColumn("label", F.coalesce("b", "set_key")).drop("b"), "labelled")
    mixed = labelled.groupBy("whole", "token").agg(F.min("label").alias("low_label"), F.max("label").alias("high_label")).filter("low_label <> high_label").select("whole", "token")
    left = labelled.join(mixed, ["whole", "token"], "left_semi").withColumn("side", F.pmod(F.hash("set_key"), F.col("parts")))
    cells = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"x": F.least("side", "other"), "y": F.greatest("side", "other")})
    members = work.save(_candidates(cells.select(*CELL, "side", "set_key", "label", "size", "rare", "print", "hashes"), KEEP, WIDE, similarity), "members")
    more = work.save(_linked(docs, nodes, members, shingle, similarity), "members-found")
    groups = components(known.unionByName(more), work).withColumnRenamed("a", "set_key").withColumnRenamed("b", "least_key")
    return found.select("doc_id", "doc_key", "set_key").join(groups, "set_key", "left").select("doc_id", "doc_key", "set_key", F.coalesce("least_key", "set_key").alias("group"))


def superfluous(docs: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, bool]:
    """doc_id and doc_key of documents that give way to another of their group, and whether rows repeat both. Of a group the smallest doc_id stays; with it, of two texts that of the smaller hash."""
    work = Workspace(docs.sparkSession, "simhash-groups")
    rows = work.save(similar_texts(docs, work, shingle, similarity), "grouped")
    repeated = bool(rows.groupBy("doc_id", "doc_key").count().filter("count > 1").head(1))
    stays = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc_key")).alias("first"))
    gone = rows.join(stays, "group").filter("NOT (doc_id <=> first.doc_id AND doc_key <=> first.doc_key)").select("doc_id", "doc_key")
    return work.save(gone.distinct(), "superfluous"), repeated


def deduplicate(docs: DataFrame, shingle: int = STAGE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of one document of each group of near copies, the smallest doc_id, with their columns as they are."""
    gone, repeated = superfluous(docs, shingle, similarity)
    few = gone.count() <= BROADCAST_ROWS
    gone = gone.select(F.col("doc_id").alias("__kestrelq_gone_id"), F.col("doc_key").alias("__kestrelq_gone_key"))
    kept = docs.join(F.broadcast(gone) if few else gone, docs["doc_id"].cast("long").eqNullSafe(F.col("__kestrelq_gone_id")) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(F.col("__kestrelq_gone_key")), "left_anti")
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
