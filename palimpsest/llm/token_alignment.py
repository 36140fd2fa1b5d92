"""Alignment of the tokens of two tokenizers: A, byte-level BPE of the tokenizers library, and B, BPE of sentencepiece.

Both encode the same bytes: a space and the text (B adds the space itself). A byte offset where tokens of both end
closes a group of tokens and links the two that end there. A pair of ids counts as often as
it is linked in all texts.

Texts are cut before white space that begins with a space or a line feed and follows something else. A's pretokens never go on
past such a place, and none of B's pieces holds a line feed or a space after another character (both are looked up in
the tokenizers; where they don't hold, a text is one segment), so segments are encoded by themselves just as within the text.

1. Texts are read once, in chunks of about 16 MB; a chunk names its distinct segments by numbers, most frequent first,
   and its documents become rows of numbers.
2. Chunks' segments are dealt and sorted by segment, so each distinct one is encoded and aligned once, and its tokens go to all chunks
   that have it: words that are everywhere cost a row per chunk, not per occurrence.
3. Pairs of ids are counted from these rows. Of two tokens that end together one's bytes end with the other's, so the vocabularies bound the pairs: at most
   the number of tokens' endings that are tokens of the other side, some hundreds of thousands, whatever the texts. These counts are sent to all tasks.
4. Each chunk composes its documents.

Defined cases: null, empty texts, and texts whose joined tokens are not a space and the text (for B one with U+2581), have
no tokens, count for no pair, and have zeros and an empty string of groups; repeated rows and null ids are rows like any other; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import given_back, stored, table
from .token_ids import BYTE_LETTERS, UNEVEN

#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK = 16 << 20
#: Texts that are cut at once.
STEP = 256
#: Before white space that begins with a space or line feed; not before a lone space at the end, which B can't encode by itself.
CUT = re.compile(r"(?<=\S)(?=[ \n])(?! \Z)")
BREAK = "\0"
#: Documents of a chunk whose numbers are kept together.
BLOCK = 512
#: Segments of a chunk whose tokens are unpacked together.
PART = 50_000
CHUNKS = "chunk long, code int, segment string, n long, doc_ids array<long>, sizes array<int>, codes binary"
LINKS = "chunk long, code int, n long, ok boolean, tokens binary"
#: Tokens are written in 24 bits, in the order of groups, A's before B's: the id, whether it is B's, whether it ends its group.
IDS, OF_B, ENDS = (1 << 22) - 1, 1 << 22, 1 << 23
COMPOSED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


class Tokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a: str, b: str) -> None:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        letters = {chr(x): k for k, x in BYTE_LETTERS.items()}
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters.get(c, ord(c) & 255) for c in piece)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id("▁")
        spec = json.loads(self.a.to_str())
        split = spec["pre_tokenizer"] or {}
        self.cuts = (
            split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not spec["normalizer"]
            and not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)
            and pieces[self.space] == "▁" and self.encode_b(["\nx", " x", "  x"]) == [self.b.encode("x\nx")[-2:], self.b.encode("x x")[-1:], self.b.encode("x  x")[-2:]]
        )

    def encode_b(self, segments: list[str]) -> list[list[int]]:
        """B's ids of segments. B puts a space before what it encodes: the segment's own, or one that is taken off again."""
        found = self.b.encode([s[1:] if s[:1] == " " else s for s in segments], num_threads=1)
        return [ids if s[:1] == " " else ids[1:] for s, ids in zip(segments, found, strict=True)]

    def align(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each segment fits, its number of tokens, and the tokens of all as numbers of 24 bits."""
        own_a, own_b, ok = [], [], []
        for s, x, y in zip(segments, self.a.encode_batch_fast(segments, add_special_tokens=False), self.encode_b(segments), strict=True):
            x, raw = x.ids, s.encode()
            fits = b"".join(map(self.bytes_a.__getitem__, x)) == raw == b"".join(map(self.bytes_b.__getitem__, y))
            ok.append(fits)
            own_a.append(x if fits else [])
            own_b.append(y if fits else [])
        n = np.fromiter((len(x) + len(y) for x, y in zip(own_a, own_b, strict=True)), np.int64, len(ok))
        a, b = (np.array([i for ids in own for i in ids], np.int64) for own in (own_a, own_b))
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        # places count on through all segments; the last tokens of each end together, so no group goes on into the next one
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group = np.concatenate([np.searchsorted(both, ends_a) * 2, np.searchsorted(both, ends_b) * 2 + 1])
        last = np.concatenate([both[group[: len(a)] // 2] == ends_a, both[group[len(a) :] // 2] == ends_b]) if len(both) else np.zeros(0, bool)
        tokens = np.concatenate([a, b | OF_B]) | np.where(last, ENDS, 0)
        return np.array(ok), n, tokens[np.argsort(group, kind="stable")]


def loaded(a: str, b: str) -> Tokenizers:
    """One pair of tokenizers per process."""
    import tokenizers

    kept = sys.modules["tokenizers"].__dict__.setdefault("_palimpsest_pairs", {})
    if (a, b) not in kept:
        kept[a, b] = Tokenizers(a, b)
    return kept[a, b]


def segments_of(texts: pa.Array, cuts: bool) -> pa.ListArray:
    """The segments of a space and each text; none of an empty text."""
    empty = pc.equal(texts, "")
    odd = pc.or_(pc.match_substring_regex(texts, f"{UNEVEN}|{BREAK}"), not cuts)
    marked = pc.replace_substring(pc.replace_substring(pc.if_else(odd, "", texts), " ", f"{BREAK} "), "\n", f"{BREAK}\n")
    out = pc.split_pattern(pc.binary_join_element_wise(" ", marked, ""), BREAK)
    rest = {k: CUT.split(f" {texts[k].as_py()}") if cuts else [f" {texts[k].as_py()}"] for k in np.flatnonzero(pc.and_not(odd, empty).to_numpy(zero_copy_only=False)).tolist()}
    # what was cut one by one stands behind the others, and rows are put in order by take
    both = pa.concat_arrays([out, pa.array([[], *rest.values()], out.type)])
    place = np.arange(len(texts))
    place[list(rest)] = len(texts) + 1 + np.arange(len(rest))
    place[empty.to_numpy(zero_copy_only=False)] = len(texts)
    return both.take(pa.array(place))


def packed(codes: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, compressed."""
    return pa.compress(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def unpacked(planes: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(planes, 4 * n, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def three_bytes(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all rows of a binary column, and the place of each row's first one (and the end)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].reshape(-1, 3)
    tokens = np.zeros((len(raw), 4), np.uint8)
    tokens[:, :3] = raw
    return tokens.view("<i4").ravel(), (offsets - offsets[0]) // 3


def links_of(tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pair (a << 32 | b) and the row of each link."""
    ends = tokens & ENDS > 0
    at_b = np.flatnonzero(ends & (tokens & OF_B > 0))
    pairs = (tokens[ends & (tokens & OF_B == 0)] & IDS).astype(np.int64) << 32 | tokens[at_b] & IDS
    return pairs, np.searchsorted(starts, at_b, side="right") - 1


def chunked(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of blocks of documents (chunk, doc_ids, sizes, codes) and of their chunk's distinct segments (chunk, code, segment, n)."""

    class Chunk:
        def __init__(self, name: int) -> None:
            self.name, self.known, self.ids, self.sizes, self.codes, self.bytes = name, {}, [], [], [], 0

        def add(self, part: pa.RecordBatch, cuts: bool) -> None:
            lists = segments_of(part.column(1), cuts)
            own = lists.flatten().dictionary_encode()
            names = np.array([self.known.setdefault(s, len(self.known)) for s in own.dictionary.to_pylist()], np.int32)
            self.ids += part.column(0).to_pylist()
            self.sizes.append(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            self.codes.append(names[own.indices.to_numpy(zero_copy_only=False)] if len(own) else np.zeros(0, np.int32))
            self.bytes += part.column(1).nbytes

        def rows(self) -> Iterator[pa.RecordBatch]:
            codes, sizes, segments = np.concatenate(self.codes), np.concatenate(self.sizes), list(self.known)
            n = np.bincount(codes, minlength=len(segments))
            order = np.argsort(-n, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            codes, ends = rank[codes], np.concatenate([[0], np.cumsum(sizes)])
            kinds = {"chunk": pa.int64(), "code": pa.int32(), "segment": pa.string(), "n": pa.int64(), "doc_ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "codes": pa.binary()}

            def batch(m: int, **own) -> pa.RecordBatch:
                own["chunk"] = np.full(m, self.name)
                return pa.RecordBatch.from_arrays([pa.array(own[k], t) if k in own else pa.nulls(m, t) for k, t in kinds.items()], names=list(kinds))

            for k in range(0, len(segments), 20_000):
                part = order[k : k + 20_000]
                yield batch(len(part), code=np.arange(k, k + len(part)), segment=[segments[x] for x in part], n=n[part])
            for k in range(0, len(sizes), BLOCK):
                m = min(k + BLOCK, len(sizes))
                yield batch(1, doc_ids=[self.ids[k:m]], sizes=[sizes[k:m]], codes=[packed(codes[ends[k] : ends[m]])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, chunk = loaded(a, b).cuts, Chunk(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                part = batch.slice(k, STEP)
                if chunk.bytes and chunk.bytes + part.column(1).nbytes > CHUNK:
                    yield from chunk.rows()
                    chunk = Chunk(chunk.name + 1)
                chunk.add(part, cuts)
        if chunk.sizes:
            yield from chunk.rows()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(given_back(run), CHUNKS)


def linked(segments: DataFrame, a: str, b: str) -> DataFrame:
    """segments(chunk, code, segment, n) with their tokens in groups; equal segments come one after the other and are encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, before = loaded(a, b), (None, None, None)
        for batch in batches:
            own = batch.column(2).dictionary_encode()
            names = own.dictionary.to_pylist()
            known = names[:1] == [before[0]]
            ok, n, tokens = pair.align(names[1:] if known else names)
            ends = np.concatenate([[0], np.cumsum(n)]).tolist()
            rows = [three_bytes(tokens[x:y]) for x, y in zip(ends, ends[1:], strict=False)]
            ok = ok.tolist()
            if known:
                ok, rows = [before[1], *ok], [before[2], *rows]
            before = (names[-1], ok[-1], rows[-1]) if names else before
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(ok).take(own.indices), pa.array(rows, pa.binary()).take(own.indices)], names=["chunk", "code", "n", "ok", "tokens"])

    return segments.select("chunk", "code", "segment", "n").repartition("segment").sortWithinPartitions("segment").mapInArrow(given_back(run), LINKS)


def pair_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs (a << 32 | b) and how often each is linked, of rows(n, tokens); the vocabularies bound their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs, row = links_of(*tokens_of(b.column(1)))
            found, at = np.unique(pairs, return_inverse=True)
            n = np.zeros(len(found), np.int64)
            np.add.at(n, at, b.column(0).to_numpy()[row])
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["pair", "n"])

    found = rows.select("n", "tokens").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).orderBy("pair").toArrow()
    return found.column(0).to_numpy(), found.column(1).to_numpy()


def unfit(links: DataFrame, docs: DataFrame) -> DataFrame:
    """n, tokens: what documents that hold a segment which doesn't fit have in links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, bad, sizes, planes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                codes, doc = unpacked(planes, sum(sizes)), np.repeat(np.arange(len(sizes)), sizes)
                lost = np.isin(doc, doc[np.isin(codes, bad)])
                code, n = np.unique(codes[lost], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), chunk)), pa.array(code.astype(np.int32)), pa.array(n)], names=["chunk", "code", "k"])

    bad = links.where("NOT ok").groupBy("chunk").agg(F.collect_set("code").alias("bad"))  # of one chunk, which is bounded
    lost = docs.join(bad, "chunk").select("chunk", "bad", "sizes", "codes").mapInArrow(run, "chunk long, code int, k long").groupBy("chunk", "code").agg(F.sum("k").alias("k"))
    return links.join(lost, ["chunk", "code"]).select(F.col("k").alias("n"), "tokens")


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (a1,a2|b1;a3|b2,b3) for every row of docs.

    a and b are the paths of the tokenizers' files on every executor.
    """
    rows = stored(chunked(docs, a, b), "align-chunks")
    segments, documents = rows.where("segment IS NOT NULL"), rows.where("segment IS NULL").selectExpr("chunk AS chunk", "doc_ids", "sizes", "codes")
    links = stored(linked(segments, a, b), "align-links")
    pairs, count = pair_counts(links)
    if not links.where("NOT ok").isEmpty():
        lost, n = pair_counts(unfit(links, documents))
        count = count.copy()
        count[np.searchsorted(pairs, lost)] -= n
    of_b = pairs & 0xFFFFFFFF
    most = np.zeros(of_b.max(initial=0) + 1, np.int64)
    np.maximum.at(most, of_b, count)
    sent = docs.sparkSession.sparkContext.broadcast((pairs, count, count == most[of_b]))

    def totals(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """n_a, n_b, n_groups, n_best, count_sum of each segment."""
        pairs, count, best = sent.value
        own, row = links_of(tokens, starts)
        at, n = np.searchsorted(pairs, own), len(starts) - 1
        n_b = np.diff(np.concatenate([[0], np.cumsum(tokens & OF_B > 0)])[starts])
        counts = np.zeros(n, np.int64)
        np.add.at(counts, row, count[at])
        return np.stack([np.diff(starts) - n_b, n_b, np.bincount(row, minlength=n), np.bincount(row[best[at]], minlength=n), counts])

    def texts(tokens: np.ndarray, starts: np.ndarray) -> pa.Array:
        """The groups of each segment, with a semicolon after each."""
        ids = pc.cast(pa.array(tokens & IDS), pa.string())
        signs = pa.array([",", "|", ";"]).take(pa.array(np.where(tokens & ENDS == 0, 0, np.where(tokens & OF_B == 0, 1, 2))))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pc.binary_join_element_wise(ids, signs, "")), "")

    def compose(docs: pa.Table, links: pa.Table) -> pa.Table:
        links = links.combine_chunks().sort_by("code").combine_chunks()
        fits, sums, text = links.column("ok").to_numpy().astype(bool), [np.zeros((5, 0), np.int64)], [pa.array([], pa.string())]
        for k in range(0, len(links), PART):
            tokens, starts = tokens_of(links.column("tokens").slice(k, PART).combine_chunks())
            sums.append(totals(tokens, starts))
            text.append(texts(tokens, starts))
        del links
        sums, text, out = np.concatenate(sums, axis=1), pa.concat_arrays(text), []
        for doc_ids, sizes, planes in zip(*(docs.column(c).to_pylist() for c in ("doc_ids", "sizes", "codes")), strict=True):
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            codes = unpacked(planes, int(ends[-1]))
            good = np.array([fits[codes[x:y]].all() for x, y in zip(ends, ends[1:], strict=False)], bool)
            n = [np.where(good, np.diff(np.concatenate([[0], np.cumsum(own[codes])])[ends]), 0) for own in sums]
            groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), text.take(pa.array(codes))), "")
            groups = pc.if_else(pa.array(good), pc.utf8_slice_codeunits(groups, 0, -1), "")
            out.append(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *map(pa.array, (n[0], n[1], n[2], n[2], n[3], n[4])), groups], names=[c.split()[0] for c in COMPOSED.split(", ")]))
        return pa.Table.from_batches(out)

    return documents.groupBy("chunk").cogroup(links.select("chunk", "code", "ok", "tokens").groupBy("chunk")).applyInArrow(compose, COMPOSED)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256"))
