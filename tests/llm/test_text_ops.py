"""SimHash, BPE and packing against brute force and the reference tokenizers."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cropframe.llm import bpe, packing, simhash

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(odd_docs):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in odd_docs.collect()]
    got = sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(odd_docs).collect()),
                 key=str)
    ids = sorted({i for i, _ in rows if i is not None})
    fps = dict(sorted((i, f) for i, f in rows if i is not None))
    comp = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    by_print = {f: comp[i] for i, f in fps.items()}
    want = sorted(((i, signed(f), by_print.get(f)) for i, f in rows), key=str)
    assert got == want


def test_simhash_keeps_one_of_each_group(odd_docs):
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    firsts = {r["component_id"] for r in simhash.near_duplicates(odd_docs).collect() if r["doc_id"] is not None}
    assert sorted(i for i in ids if i is not None) == sorted(firsts)
    assert ids.count(None) == 2


def test_bk_forest_finds_all_pairs_and_hot_shards_split(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = base[rng.integers(0, 40, 600)]
    for _ in range(2):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64))
    fps = np.unique(fps)
    near = {(a, b) for a in range(len(fps)) for b in range(len(fps))
            if int(fps[a] ^ fps[b]).bit_count() <= 3}
    forest = simhash.BKForest(fps, np.zeros(len(fps), dtype=np.int64))
    found = {(int(a), int(b)) for q, n in forest.search(fps, np.zeros(len(fps), dtype=np.int64), 3)
             for a, b in zip(q, n, strict=True)}
    assert found == near
    classes = spark.createDataFrame([(i, int(f.view(np.int64))) for i, f in enumerate(fps)], "rep long, fp long")
    from cropframe.llm.common import connected_components
    for rows in (4096, 3):
        links = simhash.fingerprint_links(classes, 3, tree_rows=rows)
        comp = {r["id"]: r["component"] for r in connected_components(links).collect()}
        want = {a: a for a, _ in near}
        for _ in range(60):
            for a, b in near:
                want[a] = want[b] = min(want[a], want[b])
        assert {a: comp.get(a, a) for a in want} == want


@pytest.fixture(scope="module")
def encoder():
    ranks = bpe.load_ranks(RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.codec(RANKS, public_tokenizers.PATTERN), own


def test_bpe_documents_match_the_library(odd_docs, encoder):
    _, own = encoder
    got = bpe.encode_documents(odd_docs, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode_ids(got, RANKS, public_tokenizers.PATTERN)
    want = []
    for r in odd_docs.collect():
        text = r["text"] or ""
        ids = np.array(own.encode_ordinary(text), dtype="<u4").tobytes()
        want.append((r["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest(), ids, text.encode()))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], bytes(r["ids"]),
                    bytes(r["decoded"])) for r in back.collect()), key=str) == sorted(want, key=str)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_any_text(encoder, text):
    codec, own = encoder
    ids = np.frombuffer(codec.encode(text), "<u4").tolist()
    assert ids == own.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=80))
def test_bpe_any_bytes(encoder, piece):
    codec, _ = encoder
    assert codec.encode_piece(piece) == bpe.merge(piece, codec.ranks)


def test_bpe_long_piece(encoder):
    codec, own = encoder
    for text in ("a" * 20000, "abcabd" * 4000, " " * 5000 + "x"):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == own.encode_ordinary(text)


def check_sequences(pieces, limits):
    """Offsets gapless, budgets kept, lengths full or a power of two."""
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append(p)
    padding = 0
    for ps in by.values():
        ps.sort(key=lambda p: p["offset"])
        at = 0
        for p in ps:
            assert p["offset"] == at
            at += p["length"]
        assert at <= limits.tokens and len(ps) <= limits.segments
        assert sum(p["loss_tokens"] for p in ps) <= limits.loss
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    return padding


def test_packing_places_every_id_once(odd_docs):
    tok = Tokenizer.from_file(WORDS)
    pieces = [r.asDict() for r in packing.pack_documents(odd_docs, WORDS).collect()]
    assert check_sequences(pieces, packing.Limits()) == 0
    want = {}
    for r in odd_docs.collect():
        ids = np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want.setdefault(r["doc_id"], []).append(ids)
    for p in pieces:
        assert zlib.crc32(bytes(p["ids"])) == p["ids_crc32"]
    for doc, copies in want.items():
        own = sorted((p["start"], p["length"], bytes(p["ids"])) for p in pieces if p["doc_id"] == doc)
        assert sum(n for _, n, _ in own) == sum(map(len, copies))
        if len(copies) == 1:
            assert b"".join(x for _, _, x in own) == copies[0].tobytes()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=40), st.integers(1, 9), st.integers(1, 64))
def test_packing_limits_hold(lengths, segments, loss):
    limits = packing.Limits(tokens=64, segments=segments, loss=loss)
    masks = [np.array([(i + k) % 3 == 0 for k in range(n)], dtype=np.int64) for i, n in enumerate(lengths)]
    seen = [np.zeros(n, dtype=int) for n in lengths]
    for seq in packing.pack(lengths, masks, limits):
        assert seq.total() <= 64 and len(seq.pieces) <= segments
        assert sum(int(masks[i][s:s + n].sum()) for i, s, n in seq.pieces) <= loss
        for i, s, n in seq.pieces:
            seen[i][s:s + n] += 1
    assert all((x == 1).all() for x in seen)


def test_packing_instruction_examples(spark):
    rows = [(f"e{i}", n, [int(k > n // 2) for k in range(n)]) for i, n in enumerate([5, 90, 200, 0, 64, 33, 33])]
    rows.append(("none", None, None))
    df = spark.createDataFrame(rows, "id string, n int, mask array<int>")
    limits = packing.Limits(tokens=128, segments=3, loss=50)
    got = [r.asDict() for r in packing.pack_examples(df, "id", "n", "mask", limits).collect()]
    check_sequences(got, limits)
    assert sum(p["length"] for p in got) == 5 + 90 + 200 + 64 + 33 + 33


def test_empty_tables(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.keep_first(no_docs).count() == 0
    assert packing.pack_documents(no_docs, WORDS).count() == 0
    assert bpe.encode_documents(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0
