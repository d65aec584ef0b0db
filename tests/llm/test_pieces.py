"""Ids of the operator against plain merges over its own normalised bytes, and its spans against the library's, for whole documents."""

import hashlib
import heapq

import numpy as np
import pytest
from test_rest import TEXTS

from spindrift.llm import pieces


@pytest.fixture(scope="module")
def known():
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(pieces.model_path(), "rb") as f:
        proto.ParseFromString(f.read())
    scores = {p.piece: p.score for p in proto.pieces if p.type == 1}
    ids = {p.piece: k for k, p in enumerate(proto.pieces)}
    return scores, ids, next(k for k, p in enumerate(proto.pieces) if p.piece == "</s>")


def merged(text, scores):
    """Characters, of which again and again the neighbours that make the best piece are joined, the leftmost of equals."""
    parts = list(text)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = []

    def offer(a):
        b = after[a]
        if b < len(parts) and (s := scores.get(parts[a] + parts[b])) is not None:
            heapq.heappush(heap, (-s, a, parts[a], parts[b]))

    for k in range(len(parts)):
        offer(k)
    while heap:
        _, a, left, right = heapq.heappop(heap)
        b = after[a]
        if parts[a] != left or b >= len(parts) or parts[b] != right:
            continue
        parts[a], parts[b], after[a] = left + right, None, after[b]
        if after[b] < len(parts):
            before[after[b]] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    return [p for p in parts if p is not None]


def plain_ids(text, known):
    scores, ids, end = known
    normal = pieces.encoder(pieces.model_path()).normalise(text)[0].decode()
    out = []
    for p in merged(normal, scores):
        out += [ids[p]] if p in ids else [ids[f"<0x{b:02X}>"] for b in p.encode()]
    return [*out, end]


def test_ids_are_plain_merges(docs_of, known):
    texts = [t for t in TEXTS if "<" not in t] + ["Ganz normaler Text, mit Zahlen 12345 und   Lücken.\n\tNeu", "日本 語 🙂 ok", "a" * 20_000]
    got = {r["doc_id"]: r for r in pieces.encoded(docs_of(list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        assert got[k]["ids"] == plain_ids(t, known)


def test_all_documents(spark, small, known):
    """Every whole document: ids by plain merges, decoded text, and spans as the library tells them."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = {r["doc_id"]: r for r in pieces.encoded(docs).collect()}
    for r in docs.collect():
        x, t = found[r["doc_id"]], r["text"] or ""
        assert x["ids"] == plain_ids(t, known) and x["decoded"] == library.decode(x["ids"])
        spans = list(zip(x["begins"], x["ends"], strict=True))
        told = library.encode(t, return_type="proto").pieces
        assert all(p.piece.startswith("<0x") or (p.begin, p.end) == s for p, s in zip(told, spans, strict=False))
        assert spans[-1] == (len(t.encode()), len(t.encode())) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_a_very_long_text(docs_of):
    long = "Wörter und Sätze, die sich wiederholen. " * 20_000
    r = pieces.encoded(docs_of([(1, long), (2, long)])).collect()
    d = pieces.digests(docs_of([(1, long)])).first()
    assert r[0]["ids"] == r[1]["ids"] and r[0]["ends"][-1] == len(long.encode()) and d["n_tokens"] == len(r[0]["ids"])
    assert d["spans_sha256"] == hashlib.sha256(np.array([r[0]["begins"], r[0]["ends"]], dtype="<i4").tobytes()).hexdigest()
