"""Alignment of whole texts against the libraries and the definition, without segments."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from palimpsest.llm import token_alignment

public = pytest.importorskip("public_tokenizers")
A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def whole():
    tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
    a, b = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}

    def tokens(text):
        """(id, end) of A and of B, or nothing."""
        if not text:
            return [], []
        x = [(i, bytes(of[c] for c in a.id_to_token(i))) for i in a.encode(f" {text}", add_special_tokens=False).ids]
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        if b"".join(r for _, r in x) != f" {text}".encode() or b"".join(r for _, r in y) != f" {text}".encode():
            return [], []
        out = []
        for rows in (x, y):
            end, own = 0, []
            for i, r in rows:
                end += len(r)
                own.append((i, end))
            out.append(own)
        return tuple(out)

    return tokens


def brute(rows, tokens):
    """Rows as the operator gives them."""
    each = [tokens(t) for _, t in rows]
    links = [[(i, j) for e in sorted({e for _, e in x} & {e for _, e in y}) for i, d in x if d == e for j, f in y if f == e] for x, y in each]
    count = Counter(p for own in links for p in own)
    most = {}
    for (_, j), n in count.items():
        most[j] = max(most.get(j, 0), n)
    out = []
    for (doc, _), (x, y), own in zip(rows, each, links, strict=True):
        groups, last = [], 0
        for e in sorted({e for _, e in x} & {e for _, e in y}):
            groups.append(",".join(str(i) for i, d in x if last < d <= e) + "|" + ",".join(str(i) for i, d in y if last < d <= e))
            last = e
        out.append((doc, len(x), len(y), len(groups), len(own), sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own), ";".join(groups)))
    return out


ODD = ["", None, " ", "  ", "\n", "a", " a", "a ", "a  b", "a\nb", "a \n b", "a\n", "\n a", "x y z", "a\t b\r\nc", "<|endoftext|> it's <s> </s> <0x0A>", "\0a \0b", "a▁b the the", "don't  stop　now", "naïve café ﬁ Ångström", "日本語 テキスト です", "🙂 🙃 👩‍👩‍👧", "é ́x", "\x1c a\x1c b", "the the the", "1234567 89.01", "​ a​ ​b"]


def test_segments_are_encoded_as_within_the_text(whole):
    pair, r = token_alignment.loaded(A, B), random.Random(3)
    assert pair.cuts
    parts = [*"abcXYZ .,'!\n\t\r 　\x1ćé1", "the", "'s", "  ", "\n\n", "日本", "🙂", "ing"]
    texts = [t or "" for t in ODD] + ["".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(3000)]
    cut = token_alignment.segments_of(pa.array(texts), True).to_pylist()
    for text, own in zip(texts, cut, strict=True):
        assert "".join(own) == (f" {text}" if text else "")
        x, y = whole(text)
        if x and own:
            assert [i for e in pair.a.encode_batch(own, add_special_tokens=False) for i in e.ids] == [i for i, _ in x], text
            assert [i for ids in pair.encode_b(own) for i in ids] == [i for i, _ in y], text
    assert any(len(own) > 1 for own in cut[: len(ODD)])
    assert token_alignment.segments_of(pa.array(["a b", ""]), False).to_pylist() == [[" a b"], []]


def test_odd_texts_and_chunks(spark, whole, monkeypatch):
    """Texts that don't fit count for no pair, over chunks of some bytes; repeated rows, null ids and other columns."""
    r = random.Random(8)
    words = ["the", "of", "tion", "xyzzy", "a▁b", "naïve", "42", "don't", "the.", "日本"]
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join(r.choices(words, [9, 9, 9, 9, 1, 9, 9, 9, 9, 9], k=r.randint(1, 9)))) for i in range(60)] + [(None, "the the"), (100, "of the"), (100, "of the")]
    monkeypatch.setattr(token_alignment, "CHUNK", 300)
    monkeypatch.setattr(token_alignment, "STEP", 5)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, chunk int")
    got = token_alignment.align(docs, A, B).collect()
    key = lambda t: tuple(str(x) for x in t)
    assert sorted((tuple(x) for x in got), key=key) == sorted(brute(rows, whole), key=key)
    assert token_alignment.align(docs.limit(0), A, B).count() == 0


def test_op12(spark, sf, whole):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    want = {x[0]: (*x[1:7], hashlib.sha256(x[7].encode()).hexdigest() if x[7] else "") for x in brute(rows, whole)}
    got = token_alignment.op12_token_alignment(spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(rows)
