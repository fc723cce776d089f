"""Evaluation texts leaking into training text, found with suffix arrays of the training text.

Each task cuts its documents into shards of bounded size and builds the suffix array of a shard over words (prefix doubling
on integer ranks). Every suffix of every test item is then looked up in it by binary search, all suffixes at once; the
suffixes that share its first `min_words` words are the verbatim matches, of which those that begin where a match begins are
followed to their ends. No shuffle: a
document lies in one shard. The test side is sent in blocks of at most about `block_words` words, one scan for each, so it may
be of any size; the usual test side is one block.

Cases: null, empty or short documents and items match nothing; repeated documents and items each match; text is folded, so
case, accents, punctuation and white space do not matter. A document longer than a shard has a shard of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lavra.functions.arrow import map_arrow
from lavra.functions import codepoints as cp
from lavra.llm.shingles import word_hashes
from lavra.session import materialize, spread

SHARD_BYTES = 1 << 20


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by their first `depth` (or a power of two more) ids; 0 parts texts."""
    rank = ids.astype(np.int64)
    n = len(rank)
    step = 1
    while step < depth:
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:]
        values, rank = np.unique(rank * np.int64(n + 2) + nxt, return_inverse=True)
        rank += 1
        step *= 2
        if len(values) == n:
            break
    return np.argsort(rank, kind="stable")


def _bound(ids: np.ndarray, order: np.ndarray, queries: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of each query (a row of ids) among the suffixes; ids is padded with zeros by the query width."""
    low = np.zeros(len(queries), np.int64)
    high = np.full(len(queries), len(order), np.int64)
    width = np.arange(queries.shape[1])
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) >> 1
        here = ids[order[mid][:, None] + width]
        diff = here - queries[open_]
        first = (diff != 0).argmax(axis=1)
        sign = diff[np.arange(len(open_)), first]
        right = sign <= 0 if upper else sign < 0
        low[open_[right]] = mid[right] + 1
        high[open_[~right]] = mid[~right]


def _sums(ids: np.ndarray) -> np.ndarray:
    """Sums of a polynomial hash over word ids, for `cp.span_hashes`."""
    power, _ = cp._powers(max(1, int(len(ids)).bit_length()))
    sums = np.zeros(len(ids) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(cp.mix(ids.astype(np.uint64) + np.uint64(0x3C6E_F372)) * power[: len(ids)], dtype=np.uint64, out=sums[1:])
    return sums


class Block:
    """The test side, made ready once: ids of its words, and of each suffix with enough words its start, end and first words."""

    def __init__(self, words: np.ndarray, row: np.ndarray, min_words: int):
        self.vocabulary = np.unique(words)
        self.ids = np.searchsorted(self.vocabulary, words) + 1
        self.row = row
        self.sums = _sums(self.ids)
        at = np.arange(max(0, len(words) - min_words + 1))
        self.starts = at[row[at] == row[at + min_words - 1]] if len(at) else at
        self.first = np.searchsorted(row, row[self.starts], side="left")
        self.end = np.searchsorted(row, row[self.starts], side="right")
        # The word before a suffix, which no match may have before it too; 0 is never one of the text.
        self.left = np.where(self.starts > self.first, self.ids[self.starts - 1], -1) if len(self.starts) else self.starts
        self.queries = self.ids[self.starts[:, None] + np.arange(min_words)]


def shard_matches(words: np.ndarray, row: np.ndarray, block: Block, min_words: int) -> tuple[np.ndarray, ...]:
    """row, test row, first word in the document, first word in the item, and length of the longest match of each document and item, the first of equal ones.

    Words the test side does not have part the text into runs; the suffixes of runs are sorted. Suffixes of equal first words
    are a range of that order, sorted by the word before them: a suffix of the test side takes those of its range that follow
    another word than it does itself, so a match is taken once, where it begins, also in texts that repeat themselves. Lengths
    come from hashes, by bisection of all matches at once, and are then checked word by word for the matches returned.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    n = len(words)
    if n < min_words or not len(block.starts):
        return none
    at = np.minimum(np.searchsorted(block.vocabulary, words), len(block.vocabulary) - 1)
    known = block.vocabulary[at] == words
    edge = np.ones(n + 1, bool)
    edge[1:n] = ~known[1:] | ~known[:-1] | (row[1:] != row[:-1])
    cut = np.flatnonzero(edge)
    size = np.diff(cut)
    good = known[cut[:-1]] & (size >= min_words)
    if not good.any():
        return none
    # Runs one after another, a zero behind each.
    start, size = cut[:-1][good], size[good]
    run_at = np.concatenate([[0], np.cumsum(size + 1)])
    origin = np.repeat(start - run_at[:-1], size + 1) + np.arange(run_at[-1])
    inside = np.ones(run_at[-1], bool)
    inside[run_at[1:] - 1] = False
    ids = np.zeros(run_at[-1] + min_words, np.int64)
    ids[: run_at[-1]][inside] = at[origin[inside]] + 1
    run_end = np.repeat(run_at[1:] - 1, size + 1)
    order = suffix_array(ids[: run_at[-1]], min_words)
    order = order[order + min_words <= run_end[order]]
    head = ids[order[:, None] + np.arange(min_words)]
    fresh = np.concatenate([[True], (head[1:] != head[:-1]).any(axis=1)])
    group = np.cumsum(fresh) - 1
    left = np.where(np.isin(order, run_at[:-1]), 0, ids[order - 1])
    by_left = np.lexsort((left, group))
    order, left = order[by_left], left[by_left]
    begins = np.append(np.flatnonzero(fresh), len(order))
    low = _bound(ids, order, block.queries, False)
    found = low < len(order)
    found[found] = (ids[order[low[found]][:, None] + np.arange(min_words)] == block.queries[found]).all(axis=1)
    which = np.flatnonzero(found)
    if not len(which):
        return none
    k = group[low[which]]
    wide = np.int64(len(block.vocabulary) + 3)
    key = group * wide + left + 1
    same = k * wide + block.left[which] + 1
    skip_from, skip_to = np.searchsorted(key, same, side="left"), np.searchsorted(key, same, side="right")
    lows = np.concatenate([begins[k], skip_to])
    counts = np.concatenate([skip_from, begins[k + 1]]) - lows
    hit = np.repeat(np.concatenate([which, which]), counts)
    p = order[np.repeat(lows - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
    t = block.starts[hit]
    sums = _sums(ids[: run_at[-1]])
    short, long = np.full(len(hit), min_words, np.int64), np.minimum(run_end[p] - p, block.end[hit] - t)
    while len(open_ := np.flatnonzero(short < long)):
        half = (short[open_] + long[open_] + 1) >> 1
        equal = cp.span_hashes(sums, p[open_], p[open_] + half) == cp.span_hashes(block.sums, t[open_], t[open_] + half)
        short[open_[equal]] = half[equal]
        long[open_[~equal]] = half[~equal] - 1
    place = origin[p]
    doc = row[place]
    item = block.row[t]
    a, b = place - np.searchsorted(row, doc, side="left"), t - block.first[hit]
    best = np.lexsort((b, a, -short, item, doc))
    doc, item = doc[best], item[best]
    best = best[np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])] if len(best) else best
    return row[place[best]], block.row[t[best]], a[best], b[best], _checked(ids, p[best], block.ids, t[best], short[best])


def _checked(a: np.ndarray, p: np.ndarray, b: np.ndarray, t: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Lengths up to the first word that differs, which only equal hashes of different words would bring below `length`."""
    ends = np.cumsum(length)
    step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)
    wrong = np.flatnonzero(a[np.repeat(p, length) + step] != b[np.repeat(t, length) + step])
    out = length.copy()
    if len(wrong):
        np.minimum.at(out, np.repeat(np.arange(len(p)), length)[wrong], step[wrong])
    return out


def find_leaks(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, min_words: int = 12, block_words: int = 1 << 22) -> DataFrame:
    """doc_id, item_id, doc_word, item_word, n_words: the longest verbatim match of each document and item, the first of equal ones.

    Words count from 1 in both.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).cast("string").alias("text"))
    doc_type = texts.schema["doc_id"].dataType.simpleString()
    tests = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    item_type = tests.schema["item_id"].dataType
    item_kind = to_arrow_type(item_type)
    schema = f"doc_id {doc_type}, item_id {item_type.simpleString()}, doc_word int, item_word int, n_words int"

    def search(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, words, test_row = sent.value
            block = Block(words, test_row, min_words)
            for batch in batches:
                for off, part in cp.pieces(batch.column("text"), SHARD_BYTES):
                    doc, item, a, b, n = shard_matches(*word_hashes(part), block, min_words)
                    if not len(doc):
                        continue
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(doc + off)), pa.array([names[i] for i in item.tolist()], item_kind)]
                        + [pa.array((x + k).astype(np.int32)) for x, k in ((a, 1), (b, 1), (n, 0))],
                        ["doc_id", "item_id", "doc_word", "item_word", "n_words"],
                    )

        return map_arrow(spread(texts), run, schema)

    context = docs.sparkSession.sparkContext
    blocks = _blocks(tests, block_words)
    block, after = next(blocks, None), next(blocks, None)
    if block is None:
        return docs.sparkSession.createDataFrame([], schema)
    if after is None:
        return search(context.broadcast(block))
    # One block is in memory at a time: the matches of each are written before the next is sent.
    out: DataFrame | None = None
    while block is not None:
        sent = context.broadcast(block)
        part = materialize(search(sent), "leaks")
        sent.destroy()
        out = part if out is None else out.unionByName(part)
        block, after = after, next(blocks, None)
    return out


def _blocks(tests: DataFrame, block_words: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    names: list = []
    texts: list[str] = []
    words = 0

    def done() -> tuple[list, np.ndarray, np.ndarray]:
        return names, *word_hashes(pa.array(texts, pa.large_string()))

    for r in tests.toLocalIterator(prefetchPartitions=False):
        names.append(r.item_id)
        texts.append(r.text)
        words += r.text.count(" ") + 1
        if words >= block_words:
            yield done()
            names, texts, words = [], [], 0
    if names:
        yield done()


def without_leaks(docs: DataFrame, doc_id: str, leaks: DataFrame) -> DataFrame:
    """The documents no test item leaked into."""
    return docs.join(leaks.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")
