"""Near-duplicate records with small edits.

Two records are near-duplicates if the Jaccard likeness of their sets of word shingles reaches a threshold t. A record's
fingerprint is its set of shingle bits, and likeness t is the same as a Hamming distance of at most
(1 - t) / (1 + t) * (|A| + |B|) between two fingerprints. The blocks follow from the pigeonhole principle: with all
fingerprints written in one global order, a pair within that distance must share one of the first |A| - ceil(t|A|) + 1
bits, so each of those is a block. The order puts rare shingles first, which keeps the blocks of common phrases out.

1. All shingles are counted into a table of fixed size (a parameter), which gives the order. The order changes only the
   cost: every order finds the same pairs.
2. One scan writes per record the size, two hashes of the whole set, a 256-bit folded fingerprint and the ordered bits.
   A task keeps the bits of a repeated set once, so a group of copies adds no more block entries than there are tasks.
3. Blocks are joined on (shuffled, sort-merged, split by AQE if skewed), a share of them in each of up to ROUNDS rounds, so
   that the disk holds the shuffle files of one share. Length and position filters drop pairs that cannot reach t, and so
   does a 128-bit sketch that each entry carries: what is written follows the pairs that are alike, not the pairs that meet,
   whose number grows faster than the input. A block of more than BLOCK_ROWS records is split by a further bit: a pair that shares k bits must share
   another one among its first |A| - ceil(t|A|) + k + 1. So a bit that ever more records have, as the collection grows,
   makes no ever larger block; only records that share MOST_BITS of their rarest bits meet however many they are. Which
   blocks are large is counted exactly, where step 1 leaves it open.
4. The Hamming distance of the folded fingerprints never exceeds the true one, nor does that of the sketches (the two halves
   of the folded fingerprint, combined by exclusive or); it drops most of the rest, and the distance of the whole
   fingerprints decides.

Records with equal sets form a class. Pairs between classes come once, membership separately; `expanded_pairs` joins both.

Cases: a null, empty or short text (fewer than `min_words` words, or than `words`) has no pairs and no class. Repeated
rows under new ids are a class of their own; rows with the same id and text count once, rows without an id not at all. Text
is folded first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.functions import codepoints as cp
from lavra.functions.arrow import SMALL_PIECE, map_arrow
from lavra.llm.shingles import shingle_hashes, word_hashes
from lavra.session import materialize, spread, tidy

HASH_BITS = 40
SLOT_BITS = 21
BLOCK_SLOTS = 1 << 15
FOLD_BITS = 256
ROWS = 1 << 14
#: Ids kept in memory by a broadcast filter, at most; above, the same filter is a shuffled join.
BROADCAST_IDS = 1_000_000
#: Records of a block, at most, that meet by the bits they share so far; in larger blocks a further one is asked for, up to MOST_BITS.
BLOCK_ROWS = 256
MOST_BITS = 4
#: Entries of blocks that a task reads, about.
ENTRIES_A_TASK = 500_000
#: Entries of blocks that a round shuffles, at least, and rounds, at most; each round reads all fingerprints again.
ENTRIES_A_ROUND = 6_000_000
ROUNDS = 8


def _batches(batches: Iterator[pa.RecordBatch], words: int, min_words: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            for off, texts in cp.pieces(part.column("text"), SMALL_PIECE):
                hashes, row = word_hashes(texts)
                x, d = shingle_hashes(hashes, row, words)
                enough = np.bincount(row, minlength=len(texts)) >= min_words
                keep = enough[d]
                yield part.slice(off, len(texts)), x[keep] >> np.uint64(64 - HASH_BITS), d[keep]


def shingle_levels(texts: DataFrame, words: int, min_words: int) -> np.ndarray:
    """Logarithmic count of each of 2**SLOT_BITS slots over all shingles of `text`; one byte each, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(1 << SLOT_BITS, np.int64)
        shift = np.uint64(HASH_BITS - SLOT_BITS)
        for _, x, _ in _batches(batches, words, min_words):
            slot, n = np.unique(x >> shift, return_counts=True)
            slots[slot.astype(np.int64)] += n
        for k in range(0, len(slots), BLOCK_SLOTS):
            part = slots[k : k + BLOCK_SLOTS]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k // BLOCK_SLOTS], pa.int32()), pa.array([np.minimum(part, 65535).astype(np.uint16).tobytes()], pa.binary())],
                    ["block", "counts"],
                )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(raw, np.uint16).astype(np.int64)
                sums[block] = sums[block] + part if block in sums else part
        if sums:
            level = [np.minimum(63, np.rint(2 * np.log2(1 + s))).astype(np.uint8).tobytes() for s in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(level, pa.binary())], ["block", "level"])

    counted = map_arrow(texts.select("text"), count, "block int, counts binary")
    out = np.zeros(1 << SLOT_BITS, np.uint8)
    with tidy(texts.sparkSession):
        levels = map_arrow(counted.repartition("block"), total, "block int, level binary").collect()
    for block, level in levels:
        out[block * BLOCK_SLOTS : (block + 1) * BLOCK_SLOTS] = np.frombuffer(bytes(level), np.uint8)
    return out


def fingerprints(texts: DataFrame, levels, words: int, min_words: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per record: id, hash of the text, n, set hash, folded fingerprint, and the ordered bits (null for a set this task has seen).

    rare is the number of leading bits that no more than block_rows records can have.
    """
    common = np.uint64(int(np.rint(2 * np.log2(1 + block_rows))))
    mask = np.uint64((1 << HASH_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        seen: set[int] = set()
        for part, x, d in _batches(batches, words, min_words):
            if not len(x):
                continue
            rank = level[(x >> np.uint64(HASH_BITS - SLOT_BITS)).astype(np.int64)].astype(np.uint64)
            key = np.unique((d.astype(np.uint64) << np.uint64(HASH_BITS + 6)) | (rank << np.uint64(HASH_BITS)) | x)
            d = (key >> np.uint64(HASH_BITS + 6)).astype(np.int64)
            few = ((key >> np.uint64(HASH_BITS)) & np.uint64(63)) < common
            x = key & mask
            rows, first, n = np.unique(d, return_index=True, return_counts=True)
            with np.errstate(over="ignore"):
                h1 = np.add.reduceat(cp.mix(x + np.uint64(0x51_7C_C1_B7)), first).view(np.int64)
                h2 = np.add.reduceat(cp.mix(x ^ np.uint64(0xA5A5_5A5A_0F0F)), first).view(np.int64)
            bit = (cp.mix(x) & np.uint64(FOLD_BITS - 1)).astype(np.int64)
            local = np.repeat(np.arange(len(rows)), n)
            bits = np.zeros((len(rows), FOLD_BITS), bool)
            bits[local, bit] = True
            folded = np.packbits(bits, axis=1).view(np.int64)
            fresh = np.zeros(len(rows), bool)
            for i, h in enumerate(h1.tolist()):
                if h not in seen:
                    seen.add(h)
                    fresh[i] = True
            values = x[fresh[local]].view(np.int64)
            ends = np.cumsum(np.where(fresh, n, 0))
            tokens = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], ends]).astype(np.int32), pa.int32(), mask=np.concatenate([~fresh, [False]])), pa.array(values, pa.int64())
            )
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(rows)), part.column("raw").take(pa.array(rows)), pa.array(n.astype(np.int32)), pa.array(h1), pa.array(h2)]
                + [pa.array(np.ascontiguousarray(folded[:, k])) for k in range(4)]
                + [pa.array(np.add.reduceat(few, first, dtype=np.int64).astype(np.int32)), tokens],
                ["id", "raw", "n", "h1", "h2", "f0", "f1", "f2", "f3", "rare", "bits"],
            )

    id_type = texts.schema["id"].dataType.simpleString()
    return map_arrow(texts, run, f"id {id_type}, raw long, n int, h1 long, h2 long, f0 long, f1 long, f2 long, f3 long, rare int, bits array<long>")


@dataclass
class NearDuplicates:
    """pairs: h_a, h_b, n_a, n_b, hamming, likeness of distinct sets. members: id, h (class), raw (hash of the text as it is), for every record with enough words."""

    pairs: DataFrame
    members: DataFrame

    def classes(self) -> DataFrame:
        return self.members.groupBy("h").agg(F.min("id").alias("representative"), F.count("*").alias("copies"))

    def expanded_pairs(self, largest_class: int = 256, by_text: bool = False) -> DataFrame:
        """id_a < id_b for every pair of records, copies included.

        Of more than largest_class copies, the least id stands for all in pairs with others, and the copies are given as
        (least id, copy): every link between others is there, and the number of rows stays linear in the size of a group of
        copies. Copies are records of equal sets, or with by_text of equal texts only, so that pairs of different texts are
        given also within a class.
        """
        return expand_classes(self.pairs.select("h_a", "h_b"), self.members, "h", largest_class, copy="raw" if by_text else None)


def expand_classes(pairs: DataFrame, members: DataFrame, key: str, largest: int, keep: tuple[str, ...] = (), own: str | None = None, copy: str | None = None) -> DataFrame:
    """id_a < id_b (and keep; own is its value within a class) from pairs of classes and members(id, key).

    More than `largest` copies are linked by their least id only; copies are members of equal key, and of equal copy if given.
    """
    same = [key, copy] if copy else [key]
    large = materialize(members.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("copies")).filter(F.col("copies") > largest).select(*same, "rep"), "large-classes")
    if large.count() <= BROADCAST_IDS:
        large = F.broadcast(large)
    marked = members.join(large, same, "left")
    stands = marked.filter("rep is null or id = rep").select("id", key)
    between = (
        pairs.join(stands.select(F.col("id").alias("x"), F.col(key).alias(f"{key}_a")), f"{key}_a")
        .join(stands.select(F.col("id").alias("y"), F.col(key).alias(f"{key}_b")), f"{key}_b")
        .filter("x <> y")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), *keep)
    )
    value = [F.col(own).alias(keep[0])] if own else []
    extra = [own] if own else []
    small = marked.filter("rep is null or id = rep").select("id", key, *extra)
    several = materialize(small.groupBy(key).count().filter("count > 1").select(key), "classes")
    small = small.join(several, key, "left_semi")
    within = (
        small.select(F.col("id").alias("id_a"), key, *extra).join(small.select(F.col("id").alias("id_b"), key), key).filter("id_a < id_b").select("id_a", "id_b", *value)
    )
    star = members.join(large, same).filter("id > rep").select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"), *value)
    return between.unionByName(within).unionByName(star)


def near_duplicates(df: DataFrame, id_col: str, text_col: str, words: int = 5, threshold: float = 0.8, min_words: int | None = None, block_rows: int = BLOCK_ROWS) -> NearDuplicates:
    """Pairs of near-duplicate classes and the members of each class; see the module's text."""
    spark = df.sparkSession
    t = Fraction(threshold).limit_denominator(1000)
    if not 0 < t <= 1:
        raise ValueError("threshold must be in (0, 1]")
    least = max(min_words or words, words)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("id").isNotNull() & (F.length("text") >= 2 * least - 1))
    texts = spread(texts.withColumn("raw", F.xxhash64("text")))
    levels = spark.sparkContext.broadcast(shingle_levels(texts, words, least))
    docs = materialize(fingerprints(texts, levels, words, least, block_rows), "fingerprints")
    if docs.groupBy("h1").agg(F.min("h2").alias("lo"), F.max("h2").alias("hi")).filter("lo <> hi").limit(1).count():
        raise RuntimeError("two different sets have the same 64-bit hash: change the constant h1 is made with")
    members = docs.groupBy("id", F.col("h1").alias("h")).agg(F.min("raw").alias("raw"))
    return NearDuplicates(_pairs(docs, t, block_rows), members)


def _pairs(docs: DataFrame, t: Fraction, block_rows: int) -> DataFrame:
    """Each step ends in a written table, so the disk holds the shuffle files of one step at a time."""
    return _exact(docs, _close(docs, _candidates(docs, t, block_rows), t), t)


def _candidates(docs: DataFrame, t: Fraction, block_rows: int, most_bits: int = MOST_BITS) -> DataFrame:
    """Pairs of sets that share a block and pass the filters of length, position and sketch; several times, if they meet in several rounds or by more bits."""
    num, den = t.numerator, t.denominator
    least = f"ceil(n * {num}L / {den}.0D)"
    sets = docs.filter("bits is not null").select(F.col("h1").alias("h"), "n", "rare", "bits", F.expr("f0 ^ f2").alias("s0"), F.expr("f1 ^ f3").alias("s1"))
    rows = int(sets.agg(F.sum(F.expr(f"n - {least} + 1"))).first()[0] or 0)
    rounds = max(1, min(ROUNDS, rows // ENTRIES_A_ROUND))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // (rounds * ENTRIES_A_TASK)))

    def meet(entry: DataFrame, before: int, share: int) -> DataFrame:
        """Pairs of entries of a block, of one share of the blocks; before: bits they share before the one at pos."""
        entry = entry.filter(F.expr(f"pmod(block, {rounds}L) = {share}")).select("h", "n", "pos", "block", "s0", "s1").repartition(parts, "block")
        a, b = entry.alias("a"), entry.alias("b")
        return a.join(
            b,
            F.expr(
                f"a.block = b.block and a.h < b.h and a.n * {den}L >= b.n * {num}L and b.n * {den}L >= a.n * {num}L"
                f" and (least(a.n - a.pos, b.n - b.pos) + {before}) * {den + num}L >= (a.n + b.n) * {num}L"
                f" and (bit_count(a.s0 ^ b.s0) + bit_count(a.s1 ^ b.s1)) * {den + num}L <= (a.n + b.n) * {den - num}L"
            ),
        ).select(F.col("a.h").alias("h_a"), F.col("b.h").alias("h_b"))

    entry = sets.withColumn("prefix", F.expr(f"slice(bits, 1, cast(n - {least} + 1 as int))")).select("h", "n", "rare", "s0", "s1", F.posexplode("prefix").alias("pos", "block"))
    met: DataFrame | None = None
    for shared in range(1, most_bits + 1):
        # Step 1 has shown already that the rare bits' blocks are not large.
        open_ = "pos >= rare" if shared == 1 else "true"
        count = 0
        if shared < most_bits:
            large = materialize(entry.filter(open_).groupBy("block").count().filter(F.col("count") > block_rows).select("block"), "large-blocks")
            count = large.count()
            large = F.broadcast(large) if count <= BROADCAST_IDS else large
        alone = entry
        if count:
            inside = entry.filter(open_).join(large, "block", "left_semi").select(*entry.columns)
            outside = entry.filter(open_).join(large, "block", "left_anti").select(*entry.columns)
            # Sets so small that no more than these bits need be shared also meet by them.
            alone = entry.filter(f"not ({open_})").unionByName(outside).unionByName(inside.filter(f"{least} <= {shared}"))
        # Written level by level and share by share, so that the disk holds the shuffle files of one at a time.
        for share in range(rounds):
            pairs = materialize(meet(alone, shared - 1, share).distinct(), "candidates")
            met = pairs if met is None else met.unionByName(pairs)
        if not count:
            break
        further = F.expr(f"slice(bits, x.pos + 2, cast(n - {least} + {shared} as int) - x.pos)")
        each = inside.select("h", F.struct("pos", "block").alias("x")).join(sets, "h").select("h", "n", "s0", "s1", "x", F.posexplode(further).alias("k", "y"))
        entry = materialize(each.select("h", "n", "s0", "s1", F.expr("x.pos + 1 + k").alias("pos"), F.xxhash64("x.block", "y").alias("block")), "blocks")
    return met


def _close(docs: DataFrame, candidates: DataFrame, t: Fraction) -> DataFrame:
    """Candidates whose folded fingerprints are within the distance."""
    num, den = t.numerator, t.denominator
    folded = docs.filter("bits is not null").select("h1", "n", "f0", "f1", "f2", "f3").dropDuplicates(["h1"])
    fa = folded.selectExpr("h1 as h_a", "n as n_a", "f0 as a0", "f1 as a1", "f2 as a2", "f3 as a3")
    fb = folded.selectExpr("h1 as h_b", "n as n_b", "f0 as b0", "f1 as b1", "f2 as b2", "f3 as b3")
    near = "+".join(f"bit_count(a{k} ^ b{k})" for k in range(4))
    within = candidates.distinct().join(fa, "h_a").join(fb, "h_b").filter(f"({near}) * {den + num}L <= (n_a + n_b) * {den - num}L")
    return materialize(within.select("h_a", "h_b", "n_a", "n_b"), "close")


def _exact(docs: DataFrame, close: DataFrame, t: Fraction) -> DataFrame:
    """Pairs whose whole fingerprints are within the distance."""
    num, den = t.numerator, t.denominator
    wanted = close.selectExpr("h_a as h1").union(close.selectExpr("h_b as h1")).distinct()
    if close.count() * 2 <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    sets = docs.filter("bits is not null").select("h1", "bits").join(wanted, "h1", "left_semi").dropDuplicates(["h1"])
    exact = (
        close.join(sets.selectExpr("h1 as h_a", "bits as bits_a"), "h_a")
        .join(sets.selectExpr("h1 as h_b", "bits as bits_b"), "h_b")
        .withColumn("shared", F.expr("cast(size(array_intersect(bits_a, bits_b)) as long)"))
        .withColumn("hamming", F.expr("n_a + n_b - 2 * shared"))
        .filter(f"hamming * {den + num}L <= (n_a + n_b) * {den - num}L")
        .select("h_a", "h_b", "n_a", "n_b", "hamming", F.expr("shared / (n_a + n_b - shared)").alias("likeness"))
    )
    return materialize(exact, "near")


def near_duplicate_groups(found: NearDuplicates) -> DataFrame:
    """One row for each record: id, its group (the least id of its connected component) and its number of links to other texts."""
    from lavra.llm.graph import connected_components

    linked = found.pairs.selectExpr("h_a as h", "h_b as other").union(found.pairs.selectExpr("h_b as h", "h_a as other"))
    links = linked.groupBy("h").agg(F.count("*").alias("links"))
    component = connected_components(found.pairs.selectExpr("h_a as src", "h_b as dst")).selectExpr("node as h", "component")
    labelled = found.members.join(component, "h", "left").withColumn("label", F.coalesce("component", "h"))
    group = labelled.groupBy("label").agg(F.min("id").alias("group_id"), F.count("*").alias("group_size"))
    return labelled.join(group, "label").join(links, "h", "left").select("id", "group_id", "group_size", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
