"""Long exact spans shared between records.

Rabin-Karp hashes are computed of every window of code points. Of the short windows (two thirds of the wanted length) only
the least hash of each run of windows is kept: any shared span of the wanted length or more holds such a run whole, so both
records keep the same window of it, and no span is missed. The kept windows are counted in Spark by hash.

`shared_pairs` takes one repeated window of each shared run, and compares what stands around it (as many characters as the
wanted length has beyond the window; no text is compared whole), so its pairs are exact. `span_classes` and `shared_coverage`
hash all windows of full length that hold a repeated short window, count those, and merge the repeated ones into classes and
maximal intervals; they form no pairs, so a span that stands in very many records costs what it holds.

Equal texts form a class that is searched once (a task keeps one of them); classes are expanded at the end.

Cases: null, empty and shorter texts share nothing. Repeats within one record do not count. Rows with the same id and text
count once, rows without an id not at all. Nothing is folded.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lavra.functions import codepoints as cp
from lavra.functions.arrow import SMALL_PIECE, map_arrow
from lavra.llm.neardup import expand_classes
from lavra.session import materialize, spread

POSITION_BITS = 26
SEGMENT = 1 << 22
#: Records kept in memory by a broadcast filter, at most; above, the same filter is a shuffled join.
BROADCAST_IDS = 1_000_000


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values: block-wise prefix and suffix minima."""
    n = len(x)
    if width == 1 or n < width:
        return x[: max(0, n - width + 1)]
    blocks = -(-n // width)
    pad = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    pad[:n] = x
    pad = pad.reshape(blocks, width)
    left = np.minimum.accumulate(pad, axis=1).ravel()
    right = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the window that starts at each position."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    start = np.arange(n)
    return cp.span_hashes(cp.prefix_hash(codes), start, start + size)


def chosen_windows(hashes: np.ndarray, run: int) -> np.ndarray:
    """Positions of the least hash of each run, the first of equal ones."""
    picked = []
    step = SEGMENT
    for at in range(0, max(1, len(hashes) - run + 1), step):
        part = hashes[at : at + step + run - 1]
        key = ((part >> np.uint64(POSITION_BITS)) << np.uint64(POSITION_BITS)) | np.arange(len(part), dtype=np.uint64)
        least = sliding_minimum(key, run)
        picked.append(np.unique(least & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64) + at)
    return np.unique(np.concatenate(picked))


def _plan(min_chars: int) -> tuple[int, int]:
    size = max(1, 2 * min_chars // 3)
    return size, min_chars - size + 1


def _windows(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, ...]:
    """Of each text: whole hash, length, number of chosen windows; and hash and position of those."""
    size, run = _plan(min_chars)
    codes, bounds = cp.decode(texts)
    length = np.diff(bounds)
    whole = cp.span_hashes(cp.prefix_hash(codes), bounds[:-1], bounds[1:]) if len(codes) else np.zeros(len(texts), np.uint64)
    h = window_hashes(codes, size)
    n = np.zeros(len(texts), np.int64)
    if not len(h):
        return whole, length, n, h, h.astype(np.int64)
    # A window over two texts is never chosen for either: it is larger than any other, and dropped at the end.
    ends = np.repeat(bounds[1:], length)[: len(h)]
    inside = np.arange(len(h)) + size <= ends
    h = np.where(inside, h >> np.uint64(1), np.uint64(1 << 63))
    at = chosen_windows(h, min(run, len(h)))
    at = at[inside[at]]
    doc = np.searchsorted(bounds, at, side="right") - 1
    long_enough = length[doc] >= min_chars
    at, doc = at[long_enough], doc[long_enough]
    return whole, length, np.bincount(doc, minlength=len(texts)), h[at], at - bounds[doc]


def _links(h: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of the window before each in its text and the distance from it; 0 for the first."""
    out = np.zeros(len(h), np.int64)
    if len(h) > 1:
        with np.errstate(over="ignore"):
            out[1:] = cp.mix(h[:-1] + cp.mix((at[1:] - at[:-1]).astype(np.uint64))).view(np.int64)
        out[out == 0] = 1
        first = (np.cumsum(n) - n)[n > 0]
        out[first] = 0
    return out


def chosen(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """id, h (hash of the whole text), n_chars, windows, positions and links (null for a text this task has seen)."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("id").isNotNull() & (F.length("text") >= min_chars))
    id_type = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for off, part in cp.pieces(batch.column("text"), SMALL_PIECE):
                whole, length, n, h, at = _windows(part, min_chars)
                fresh = np.zeros(len(part), bool)
                for i, w in enumerate(whole.tolist()):
                    if w not in seen:
                        seen.add(w)
                        fresh[i] = True
                keep = np.repeat(fresh, n)
                link = _links(h, at, n)
                ends = np.concatenate([[0], np.cumsum(np.where(fresh, n, 0))])
                offsets = pa.array(ends.astype(np.int32), pa.int32(), mask=np.concatenate([~fresh, [False]]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(off, len(part)), pa.array(whole.view(np.int64)), pa.array(length)]
                    + [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (h[keep].view(np.int64), at[keep].astype(np.int32), link[keep])],
                    ["id", "h", "n_chars", "windows", "positions", "links"],
                )

    return map_arrow(spread(texts), run, f"id {id_type}, h long, n_chars long, windows array<long>, positions array<int>, links array<long>")


def _small(df: DataFrame) -> DataFrame:
    """A materialised table as a broadcast if it is within the bound, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _texts_of(df: DataFrame, id_col: str, text_col: str, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, text for the wanted h, from one record of each class."""
    ids = docs.join(_small(wanted), "h", "left_semi").groupBy("h").agg(F.min("id").alias("__id"))
    ids = materialize(ids, "span-ids")
    texts = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    return texts.join(_small(ids), "__id").select("h", "text").dropDuplicates(["h"])


def _entries(docs: DataFrame) -> DataFrame:
    """h, w, p, link: each chosen window of each distinct text; link stands for the chosen window before it and the way from there."""
    return (
        docs.filter("windows is not null")
        .select("h", F.explode(F.arrays_zip("windows", "positions", "links")).alias("x"))
        .select("h", F.col("x.windows").alias("w"), F.col("x.positions").alias("p"), F.col("x.links").alias("link"))
    )


def _repeated(entry: DataFrame) -> DataFrame:
    """Entries whose window stands in two texts or more. Windows are counted pre-aggregated, and most are unique."""
    again = materialize(entry.groupBy("w").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo < hi").select("w"), "span-repeated")
    return entry.join(_small(again), "w", "left_semi")


def span_members(df: DataFrame, docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """h, w, p, link, digest, before, after: the windows repeated among texts, one for each shared run, with what is around them.

    Chosen windows overlap, so if all entries of a window follow the same window at the same distance, each run it stands in has
    that one too, and it is left out. digest is that of the window's text. before and after are the characters on both sides, as
    many as a run of min_chars can have beyond the window.
    """
    size, run = _plan(min_chars)
    again = materialize(_repeated(_entries(docs)), "span-entries")
    first = again.groupBy("w").agg(F.min("link").alias("lo"), F.max("link").alias("hi")).filter("lo <> hi or lo = 0").select("w")
    spots = again.join(first, "w", "left_semi").groupBy("h").agg(F.collect_list(F.struct("w", "p", "link")).alias("at"))
    spots = materialize(spots, "span-spots")
    texts = _texts_of(df, id_col, text_col, docs, spots.select("h"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = np.full(run - 1, 0xFFFFFFFF, np.uint32)
        for batch in batches:
            spot = batch.column("at")
            start = spot.offsets.to_pylist()
            flat = [spot.values.field(k).to_numpy(zero_copy_only=False) for k in ("w", "p", "link")]
            raw: list[tuple[bytes, bytes, bytes]] = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                codes = np.concatenate([pad, np.frombuffer(text.encode("utf-32-le"), np.uint32), pad])
                for q in flat[1][start[i] : start[i + 1]].tolist():
                    a, b = q + run - 1, q + run - 1 + size
                    raw.append((codes[q:a][::-1].tobytes(), md5(codes[a:b].tobytes()).digest(), codes[b : b + run - 1].tobytes()))
            before, digest, after = zip(*raw) if raw else ((), (), ())
            part = slice(start[0], start[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column("h").to_numpy(zero_copy_only=False), np.diff(start)))] + [pa.array(x[part]) for x in flat] + [pa.array(x, pa.binary()) for x in (digest, before, after)],
                ["h", "w", "p", "link", "digest", "before", "after"],
            )

    return materialize(map_arrow(spots.join(texts, "h").select("h", "at", "text"), cut, "h long, w long, p int, link long, digest binary, before binary, after binary"), "span-members")


def _alike(a: pa.Array, b: pa.Array, width: int) -> np.ndarray:
    """Code points that two columns of fixed width have in common at the start; beyond a text's end there is none."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(len(c), width) for c in (a, b))
    differ = (x != y) | (x == 0xFFFFFFFF)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), width)


def shared_pairs(df: DataFrame, id_col: str, text_col: str, min_chars: int = 300, largest_class: int = 256) -> DataFrame:
    """doc_a < doc_b: every pair of records that share a span of min_chars or more.

    More than largest_class equal texts are given as (least id, copy), and the least stands for all in other pairs.
    """
    _, run = _plan(min_chars)
    docs = materialize(chosen(df, id_col, text_col, min_chars), "span-windows")
    member = span_members(df, docs, id_col, text_col, min_chars)
    a, b = member.alias("a"), member.alias("b")
    # Two entries that follow the same window at the same distance meet there already.
    met = a.join(b, F.expr("a.w = b.w and a.h < b.h and a.digest = b.digest and (a.link <> b.link or a.link = 0)")).select(
        F.col("a.h").alias("h_a"), F.col("b.h").alias("h_b"), F.col("a.before").alias("before_a"), F.col("b.before").alias("before_b"), F.col("a.after").alias("after_a"), F.col("b.after").alias("after_b")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if run > 1 and batch.num_rows:
                length = sum(_alike(batch.column(f"{side}_a"), batch.column(f"{side}_b"), run - 1) for side in ("before", "after"))
                batch = batch.filter(pa.array(length >= run - 1))
            yield batch.select(["h_a", "h_b"])

    linked = materialize(map_arrow(met, verify, "h_a long, h_b long").distinct(), "span-pairs")
    members = docs.select("id", "h", "n_chars").distinct()
    return expand_classes(linked, members.drop("n_chars"), "h", largest_class).withColumnsRenamed({"id_a": "doc_a", "id_b": "doc_b"})


def span_classes(df: DataFrame, id_col: str, text_col: str, min_chars: int = 300) -> DataFrame:
    """span, id, start, copies: the classes of spans of min_chars or more, one row for each place of a span in each distinct text.

    A class is a window of min_chars that begins a shared run in one text at least; copies is the number of texts that hold it.
    It grows with what is shared, not with the pairs. id is the least id of equal texts.
    """
    docs, windows = _full_windows(df, id_col, text_col, min_chars)
    before = Window.partitionBy("h").orderBy("p")
    prior = F.when(F.lag("p").over(before) == F.col("p") - 1, F.lag("w").over(before))
    counted = windows.withColumn("prior", prior).groupBy("w").agg(
        F.min("h").alias("lo"), F.max("h").alias("hi"), F.min("prior").alias("first"), F.max("prior").alias("last"), F.count("prior").alias("n"), F.count("*").alias("rows")
    )
    # If all places of a window follow the same one, that one holds the same texts.
    begins = counted.filter("lo < hi and (n < rows or first <> last)").select("w")
    names = docs.groupBy("h").agg(F.min("id").alias("id"))
    places = materialize(windows.join(begins, "w", "left_semi"), "span-places")
    copies = places.groupBy("w").agg(F.count_distinct("h").alias("copies"))
    return places.join(copies, "w").join(names, "h").select(F.col("w").alias("span"), "id", F.col("p").alias("start"), "copies")


def _full_windows(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """The texts' table, and h, p, w of every window of min_chars that holds a repeated short window."""
    _, run = _plan(min_chars)
    docs = materialize(chosen(df, id_col, text_col, min_chars), "span-windows")
    spots = materialize(_repeated(_entries(docs)).groupBy("h").agg(F.collect_set("p").alias("at")), "span-spots")
    texts = _texts_of(df, id_col, text_col, docs, spots.select("h"))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for text, at in zip(batch.column("text").to_pylist(), batch.column("at").to_pylist()):
                h = window_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), min_chars)
                near = np.zeros(len(h) + 1, np.int64)
                np.add.at(near, np.maximum(np.array(at) - run + 1, 0), 1)
                np.add.at(near, np.minimum(np.array(at) + 1, len(h)), -1)
                p = np.flatnonzero(np.cumsum(near)[:-1] > 0)
                out.append((p.astype(np.int32), h[p].view(np.int64)))
            if out:
                p, w = (np.concatenate(x) for x in zip(*out))
                h = np.repeat(batch.column("h").to_numpy(zero_copy_only=False), [len(x) for x, _ in out])
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(p), pa.array(w)], ["h", "p", "w"])

    return docs, materialize(map_arrow(spots.join(texts, "h").select("h", "at", "text"), full, "h long, p int, w long"), "span-full")


def shared_coverage(df: DataFrame, id_col: str, text_col: str, min_chars: int = 300) -> DataFrame:
    """id, n_chars, intervals (array of start, end; from 0), shared_chars: what of each record also stands in another one.

    Every record of min_chars or more has a row. A record that another one equals is shared whole.
    """
    docs, windows = _full_windows(df, id_col, text_col, min_chars)
    again = windows.groupBy("w").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo < hi").select("w")
    starts = windows.join(again, "w", "left_semi").groupBy("h").agg(F.array_sort(F.collect_set("p")).alias("p"))
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out = []
            for at in batch.column("p").to_pylist():
                p = np.array(at)
                new = np.concatenate([[True], np.diff(p) > min_chars])
                first = p[new]
                last = p[np.append(np.flatnonzero(new)[1:] - 1, len(p) - 1)] + min_chars
                out.append([{"start": int(s), "end": int(e)} for s, e in zip(first, last)])
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(out, kind)], ["h", "intervals"])

    spans = map_arrow(starts, merge, "h long, intervals array<struct<start: int, end: int>>")
    copies = docs.groupBy("h").agg(F.count_distinct("id").alias("copies"))
    return (
        docs.select("id", "h", "n_chars").distinct().join(copies, "h").join(spans, "h", "left")
        .withColumn("intervals", F.expr("case when copies > 1 then array(named_struct('start', 0, 'end', cast(n_chars as int))) else coalesce(intervals, array()) end"))
        .select("id", "n_chars", "intervals", F.expr("aggregate(intervals, 0L, (s, x) -> s + x.end - x.start)").alias("shared_chars"))
    )
