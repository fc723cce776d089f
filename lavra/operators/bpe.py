"""Byte-pair encoding over tables: word counts, pair counts, applying given merges, token ids, decoding.

Merges and vocabularies are inputs, read from the files of public tokenizers; this library trains none. A vocabulary file is
sent to the workers; each distinct word of a task is encoded once.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.functions.arrow import map_arrow
from lavra.session import send_file, spread

DEFAULT_VOCABULARY = os.path.join(os.environ.get("LAVRA_TOKENIZERS", "/opt/tokenizers"), "word_bpe_49k.json")

END = "</w>"
SPECIALS = ["<PAD>", "<BOS>", "<EOS>", "<UNK>"]
WORD = r"[\p{L}\p{N}_]+"


def words(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(WORD), F.lit(0))).alias("palavra"))


def word_counts(df: DataFrame, text_col: str, least: int = 1) -> DataFrame:
    return words(df, text_col).groupBy("palavra").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def symbols(word: Column) -> Column:
    return F.concat(F.filter(F.split(word, ""), lambda x: x != ""), F.array(F.lit(END)))


def pair_counts(counts: DataFrame) -> DataFrame:
    """a, b, n: neighbouring symbols weighted by the frequency of their word."""
    each = counts.select("n", symbols(F.col("palavra")).alias("s"))
    pairs = each.select("n", F.explode(F.arrays_zip(F.expr("slice(s, 1, size(s) - 1)").alias("a"), F.expr("slice(s, 2, size(s) - 1)").alias("b"))).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("n").alias("n"))


def best_pair(pairs: DataFrame) -> DataFrame:
    """The most frequent pair, the last in order among equals."""
    return pairs.orderBy(F.col("n").desc(), F.col("a").desc(), F.col("b").desc()).limit(1)


def merge_word(symbols_: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Symbols after all merges, lowest rank first, every occurrence from the left."""
    s = list(symbols_)
    while len(s) > 1:
        best = min(zip(s, s[1:]), key=lambda p: ranks.get(p, len(ranks)))
        if best not in ranks:
            break
        out, i = [], 0
        while i < len(s):
            if i + 1 < len(s) and (s[i], s[i + 1]) == best:
                out.append(s[i] + s[i + 1])
                i += 2
            else:
                out.append(s[i])
                i += 1
        s = out
    return s


def encode_words(counts: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """palavra, n, tokens: each distinct word is merged once."""
    ranks = {m: k for k, m in enumerate(merges)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [merge_word([*w, END], ranks) for w in b.column("palavra").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("palavra"), b.column("n"), pa.array(done, pa.list_(pa.string()))], ["palavra", "n", "tokens"])

    return map_arrow(counts.select("palavra", F.col("n").cast("long").alias("n")), run, "palavra string, n long, tokens array<string>")


def token_frequency(encoded: DataFrame) -> DataFrame:
    return encoded.select(F.explode("tokens").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))


def encode_lookup(tokens: DataFrame, vocabulary: DataFrame, unknown: int = 3) -> DataFrame:
    """tokens with their id; unknown ones get the id of unknown."""
    return tokens.join(vocabulary, "token", "left").withColumn("token_id", F.coalesce("token_id", F.lit(unknown)))


def decode(tokens: Column) -> Column:
    """Words of a list of tokens, ended by the end mark."""
    return F.trim(F.regexp_replace(F.array_join(tokens, ""), END, " "))


def longest_pieces(word: str, vocabulary: set[str], longest: int, unknown: str = "<UNK>") -> list[str]:
    """Greedy longest-prefix split of a word; a character outside the vocabulary is unknown."""
    out, i = [], 0
    while i < len(word):
        for n in range(min(longest, len(word) - i), 0, -1):
            if word[i : i + n] in vocabulary:
                out.append(word[i : i + n])
                i += n
                break
        else:
            out.append(unknown)
            i += 1
    return out


def split_words(counts: DataFrame, vocabulary: list[str]) -> DataFrame:
    """palavra, n, tokens by the longest known prefixes, once per distinct word."""
    known = set(vocabulary)
    longest = max(map(len, known), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [longest_pieces(w, known, longest) for w in b.column("palavra").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("palavra"), b.column("n"), pa.array(done, pa.list_(pa.string()))], ["palavra", "n", "tokens"])

    return map_arrow(counts.select("palavra", F.col("n").cast("long").alias("n")), run, "palavra string, n long, tokens array<string>")


@dataclass
class Vocabulary:
    """Ids of tokens and ranks of merges of a byte-level vocabulary whose words end in END."""

    ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    pattern: str
    known: dict[str, list[int]] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        pattern = next(p["pattern"]["Regex"] for p in model["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        return cls(model["model"]["vocab"], {m: k for k, m in enumerate(merges)}, pattern)

    def save(self, path: str) -> None:
        """In the form load reads."""
        model = {"vocab": self.ids, "merges": [list(m) for m in sorted(self.ranks, key=self.ranks.get)]}
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"pre_tokenizer": {"pretokenizers": [{"type": "Split", "pattern": {"Regex": self.pattern}}]}, "model": model}, f, ensure_ascii=False)

    def info(self) -> dict[str, int]:
        return {"tokens": len(self.ids), "merges": len(self.ranks), "words": sum(t.endswith(END) for t in self.ids)}

    def word(self, word: str) -> list[int]:
        got = self.known.get(word)
        if got is None:
            marks = [BYTES[b] for b in word.encode("utf-8", "surrogatepass")]
            got = [self.ids[t] for t in merge_word([*marks[:-1], marks[-1] + END], self.ranks)]
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = got
        return got

    def encode(self, text: str) -> list[int]:
        clean = re.sub(r"\s+", " ", unicodedata.normalize("NFC", text)).lower()
        return [i for w in regex.findall(self.pattern, clean) for i in self.word(w)]

    def decode(self, ids: list[int]) -> str:
        """Words with one space behind each; what cannot be decoded is marked as the encoding does."""
        names = self.__dict__.setdefault("_names", {i: t for t, i in self.ids.items()})
        text = "".join(names.get(i, "") for i in ids).replace(END, " ")
        raw = bytes(b for c in text for b in ([BACK[c]] if c in BACK else c.encode()))
        return raw.decode("utf-8", "replace").strip()


def _marks() -> dict[int, str]:
    """Bytes as visible characters: printable Latin-1 ones as they are, the others from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(other)}


BYTES = _marks()
BACK = {c: b for b, c in BYTES.items()}
#: Words whose ids a worker remembers, at most; then it starts anew. Changes only the speed.
REMEMBERED = 1 << 20


def encode_texts(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """id, ids: the token ids of each text; null for null."""
    rows = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    name = send_file(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(SparkFiles.get(name))
        for b in batches:
            ids = [None if t is None else vocabulary.encode(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode_ids(df: DataFrame, path: str) -> DataFrame:
    """id, text of frame(id, ids)."""
    name = send_file(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(SparkFiles.get(name))
        for b in batches:
            texts = [None if ids is None else vocabulary.decode(ids) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return map_arrow(df.select("id", "ids"), run, f"id {df.schema['id'].dataType.simpleString()}, text string")


def vocabulary_table(spark: SparkSession, path: str) -> DataFrame:
    """token, token_id of a vocabulary file."""
    return spark.createDataFrame(sorted(Vocabulary.load(path).ids.items(), key=lambda x: x[1]), "token string, token_id int")
