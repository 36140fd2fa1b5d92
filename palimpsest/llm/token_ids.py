"""Token ids in Parquet list columns, for selective reads.

A corpus is one folder of Parquet files, in ascending doc_id order through files and rows:
doc_id, n_tokens and the ids with an end id. Ids are dictionary-encoded (a vocabulary fits a
dictionary page; pages where it doesn't fall back to delta), doc_id and n_tokens are delta-encoded,
row groups and pages have set sizes and page indexes, so that a
read of some documents touches their pages, and a read of doc_id and n_tokens no ids. Files go
through Spark's own writer and reader: any file system works, and a lost task is written again.

Encoding is that of the tokenizers library. Its pretokens never cross a single space or line
feed between two other characters, so a text is cut there and each word is encoded once per
worker and kept in a bounded cache, which is asked once for a word of a batch: Arrow numbers a batch's words
and puts their ids in place; a text with other white space or with the string of a special
token is encoded whole.

Defined cases: null text is empty and has the end id alone; null doc_id comes first; rows with
equal doc_id stand together, in order of text; an empty table gives no rows. Extra columns of
the input are not written.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_path, table

#: Words kept per worker. It bounds memory only: a word that isn't kept is encoded again.
CACHE = 800_000
#: The letters that byte-level vocabularies write bytes as: printable ones as themselves, the others from U+0100 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
#: Texts that can't be cut into words: none at all, white space at an end or in a row or other than a space or line feed (what str.split knows).
UNEVEN = r"\A\z|\A[ \n]|[ \n]\z|[ \n][ \n]|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WRITER = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "snappy",
}


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


class Pieces(dict):
    """Ids, as bytes, of words that follow `before` (a space, or nothing at a line's start), made when first asked for.

    A word of letters is one pretoken, so the library's model takes it as it is; its closing signs are a
    pretoken of their own, so a word is kept without them, once for all that follow it. Any other word goes through the whole library.
    Words live in two generations: when the younger has `most` words it becomes the older and the one before that goes,
    so words in use stay and memory is bounded.
    """

    def __init__(self, before: str, tok, most: int) -> None:
        super().__init__()
        self.before, self.most, self.older, self.signs = before, most, {}, {}
        self.model, self.whole = tok.model.tokenize, lambda x: tok.encode(x, add_special_tokens=False).ids
        self.head = before.replace(" ", "\u0120")

    def __missing__(self, w: str) -> bytes:
        word = w.rstrip(SIGNS)
        if word and len(word) < len(w) and word[-1].isalpha():
            return self[word] + self.sign(w[len(word) :])
        found = self.older.get(w) or self.made(w)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[w] = found
        return found

    def made(self, w: str) -> bytes:
        if w.isalpha() and (w.isascii() or max(w) < "\u0250"):
            # the model's own alphabet has a letter per byte
            x = w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_LETTERS)
            return packed([t.id for t in self.model(self.head + x)])
        return packed(self.whole(self.before + w))

    def sign(self, x: str) -> bytes:
        found = self.signs.get(x)
        if found is None:
            found = packed(self.whole(x))
            if len(self.signs) < self.most // 8:
                self.signs[x] = found
        return found


def encoder(path: str, plain_marks: bool = False) -> Callable[[list[str] | pa.Array], list[bytes]]:
    """Texts to their ids as little-endian 32-bit bytes, with one tokenizer and cache per process.

    A special token's string in a text becomes that token, as the library has it; with plain_marks it is text.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    kept = sys.modules["tokenizers"].__dict__.setdefault("_palimpsest_encoders", {})
    if (path, plain_marks) not in kept:
        tok = tokenizers.Tokenizer.from_file(path)
        tok.encode_special_tokens = plain_marks
        marks = [] if plain_marks else [t.content for t in tok.get_added_tokens_decoder().values()]
        kept[path, plain_marks] = (tok, marks, Pieces("", tok, CACHE // 16), Pieces(" ", tok, CACHE // 2))
    tok, marks, starts, inner = kept[path, plain_marks]
    uneven = "|".join([UNEVEN, *map(re.escape, marks)])
    line_end = packed(tok.encode("\n", add_special_tokens=False).ids)

    def lines(x: str, first: Pieces) -> bytes:
        """Ids of a piece between two spaces: a word, and the words alone in their lines after it."""
        if "\n" not in x:
            return first[x]
        head, *rest = x.split("\n")
        return line_end.join([first[head], *map(starts.__getitem__, rest)])

    def encode(texts: list[str] | pa.Array) -> list[bytes]:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        whole = pc.match_substring_regex(column, uneven)
        pieces = pc.split_pattern(pc.if_else(whole, "", column), " ")  # a text that is encoded whole is one piece here
        at, flat = pieces.offsets.to_numpy(), pieces.flatten()
        words = flat.dictionary_encode()
        ids = [lines(x, inner) for x in words.dictionary.to_numpy(zero_copy_only=False).tolist()]
        place = words.indices.to_numpy().copy()
        place[at[:-1]] = np.arange(len(ids), len(ids) + len(column))
        firsts = flat.take(pa.array(at[:-1])).to_numpy(zero_copy_only=False).tolist()
        for k, odd in enumerate(whole.to_pylist()):
            ids.append(packed(tok.encode(column[k].as_py(), add_special_tokens=False).ids) if odd else lines(firsts[k], starts))
        out = pa.array(ids, pa.large_binary()).take(pa.array(place))
        ends, data = np.frombuffer(out.buffers()[1], np.int64)[at].tolist(), memoryview(out.buffers()[2] or b"")
        return [bytes(data[a:z]) for a, z in zip(ends, ends[1:], strict=False)]

    return encode


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, ids for rows in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], "<i4").tobytes()
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                ids = encode(part.column(1))
                offsets = np.cumsum([0, *[len(x) // 4 + 1 for x in ids]]).astype(np.int32)
                flat = np.frombuffer(b"".join(y for x in ids for y in (x, end)), "<i4")
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets), pa.int32()), lists], names=["doc_id", "n_tokens", "ids"])

    return docs.mapInArrow(run, "doc_id long, n_tokens int, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """docs(doc_id, text) as token files under path."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded(ordered, tokenizer, end_id).write.options(**WRITER).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, part (the file's place in the order), at (the row's place in its file)."""
    rows = spark.read.schema("doc_id long, n_tokens int, ids array<int>").parquet(path)
    return rows.select("*", F.regexp_extract("_metadata.file_path", r"part-(\d+)", 1).cast("long").alias("part"), F.col("_metadata.row_index").alias("at"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(3)
        flat, offsets = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        offsets = offsets - offsets[0]
        n = np.diff(offsets)
        crc = [zlib.crc32(flat[a:z]) for a, z in zip(offsets, offsets[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files' ids.

    A document's start is the sum over the files before its own, which has a row per file, and
    the sum over the rows before it in its file.
    """
    rows = read_tokens(spark, path).select("doc_id", "part", "at", "ids").mapInArrow(_digests, "doc_id long, part long, at long, n_tokens long, ids_crc32 long")
    sizes = read_tokens(spark, path).groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("n"))
    before = sizes.select(F.col("part").alias("part1"), F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(before, rows.part == before.part1).select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def op7_parquet_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "token-ids")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return digests(spark, path)
