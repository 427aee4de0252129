"""Encoding, packing and token output against the tokenizers library and brute force."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from quarry.llm import bpe, packing, token_output, tokens
from quarry.llm.queries import BYTE_BPE, WORD_BPE

BYTE, WORD = tokens.public_path(BYTE_BPE), tokens.public_path(WORD_BPE)


def lib_ids(path, text):
    return tokens.library(path).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="session")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_byte_encoder_equals_library(odd_texts, corpus):
    for t in [*odd_texts, *(r.text for r in corpus.collect())]:
        assert tokens.encode(BYTE, t or "").tolist() == lib_ids(BYTE, t)


@pytest.mark.parametrize("which", ["odd", "corpus", "clash"])
def test_bpe_equals_library(which, odd_docs, corpus, clashing):
    df = {"odd": odd_docs, "corpus": corpus, "clash": clashing}[which]
    texts = {r.doc_id: r.text for r in df.collect()}
    lib = tokens.library(WORD)
    got = bpe.encode_decode(df, WORD).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = lib_ids(WORD, texts[r.doc_id])
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded == lib.decode(ids, skip_special_tokens=False)
    for r in bpe.encode_decode(df, WORD, digest=True).collect():
        ids = lib_ids(WORD, texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_joins_are_repaired_for_other_tokenizers(odd_texts):
    """A byte-level file joins white space to words, so cuts before it must be repaired."""
    coder = bpe.ChunkCoder(BYTE, mask=1)
    for t in odd_texts[:12] + odd_texts[13:]:
        assert np.frombuffer(coder.encode(coder.learn([t or ""])[0]), "<u4").tolist() == lib_ids(BYTE, t)


ODD = ["the", "The", "ÄÖ", "naïve", "é", "ΣΑΣ", "İstanbul", "日本語", "<|endoftext|>", "<|EndOfText|>", "it's", "'S", "12", "…", "\u0301", "a\u0308", "😀", "\x85", "\u3000", "x\u200by", "ſt", "ŉ", "ǅ", "\x00", "\x1c", "don't"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_bpe_equals_library_on_random_texts(path):
    r = random.Random(8)
    coder = bpe.ChunkCoder(path, mask=1, most_bytes=20_000, most_joins=500)  # cut often, tables emptied often
    for _ in range(150):
        some = [r.choice(ODD) for _ in range(6)]
        texts = ["".join(r.choice(some if r.random() < 0.7 else ODD) + r.choice(["", " ", " ", "\n", "  ", "\t\r\n", " \x0b"]) for _ in range(r.randint(0, 60))) for _ in range(20)]
        for t, cut in zip(texts, coder.learn(texts), strict=True):
            assert np.frombuffer(coder.encode(cut), "<u4").tolist() == lib_ids(path, t)
    assert coder.reused and coder.fresh


def test_lowered_texts_are_what_the_normalizer_leaves():
    """Every character that the way past the normalizer takes, by itself and between letters."""
    plain, special = tokens.unnormalized(WORD)
    taken = 0
    for c in map(chr, range(0x2000)):
        for t in (c, f"a{c}B", f"{c} {c}"):
            low = tokens.lowered(t, special)
            if low is not None:
                taken += 1
                assert low.split() == tokens.library(WORD).normalizer.normalize_str(t).split()
                assert plain.encode(low, add_special_tokens=False).ids == lib_ids(WORD, t)
    assert taken > 1000 and tokens.lowered("x<|ENDOFTEXT|>", special) is None and tokens.unnormalized(BYTE) is None


def test_disagreeing_joins_are_widened():
    """Chunks whose join the library encodes otherwise are joined until it agrees, whatever was in the table."""
    coder = bpe.ChunkCoder(WORD)
    parts = [b"ab", b"cd ef", b"gh ij", b" kl"]  # cut within words
    cut = [(p, coder._encode(p), k in (0, 3)) for k, p in enumerate(parts)]
    assert np.frombuffer(coder.encode(cut), "<u4").tolist() == lib_ids(WORD, "abcd efgh ij kl")
    coder._check([(b"ab", b"cd"), (b"ef", b" kl")], [(coder._encode(b"x ab"), coder._encode(b"cd ef")), (coder._encode(b"ef"), coder._encode(b" kl"))])
    assert list(coder.joins.values()) == [False, True]


def test_chunks_are_reused(odd_texts):
    coder = bpe.ChunkCoder(WORD)
    text = " ".join(f"word{i} alpha" for i in range(500))
    for _ in range(3):
        coder.encode(coder.learn([text])[0])
    assert coder.reused >= 2 * coder.fresh > 0


def test_decode(spark, corpus):
    enc = bpe.encode_decode(corpus.limit(20), WORD)
    assert all(r[0] == r[1] for r in bpe.decode(enc.withColumnRenamed("decoded", "was"), WORD).select("was", "decoded").collect())


def test_clashing_columns_and_repeated_rows(spark, clashing, odd_docs):
    twice = odd_docs.union(odd_docs)
    assert sum(p.length for p in packing.pack(twice, BYTE).collect()) == 2 * sum(p.length for p in packing.pack(clashing, BYTE).collect())
    assert sum(w.n_tokens for w in token_output.windows(twice, BYTE).collect()) == 2 * sum(w.n_tokens for w in token_output.windows(clashing, BYTE).collect())
    nulls = spark.createDataFrame([(None, None), (None, "a")], "doc_id long, text string")
    assert len(packing.pack(nulls, BYTE).collect()) == 2 and len(bpe.encode_decode(nulls, WORD).collect()) == 2


def test_whole_documents_stay_whole(odd_docs):
    pieces = packing.pack(odd_docs, BYTE, cut=False, with_ids=True).collect()
    assert all(p.length == p.doc_tokens for p in pieces if p.doc_tokens <= 2048)
    assert all(len(p.ids) == 4 * p.length for p in pieces)


def test_empty_tables(no_docs):
    assert bpe.encode_decode(no_docs, WORD).collect() == []
    assert packing.pack(no_docs, BYTE).collect() == []
    assert token_output.windows(no_docs, BYTE).collect() == []


def test_difference_is_a_partition_and_even():
    r = random.Random(1)
    for n, k in ((0, 3), (1, 3), (5, 5), (40, 7), (300, 60), (7, 1)):
        sizes = [r.randint(1, 2048) for _ in range(n)]
        groups = packing.difference(sizes, k)
        assert len(groups) == k and sorted(i for g in groups for i in g) == list(range(n))
    sizes = [r.randint(1, 500) for _ in range(400)]
    sums = [sum(sizes[i] for i in g) for g in packing.difference(sizes, 10)]
    assert max(sums) - min(sums) <= 5


def test_difference_textbook():
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in g) for g in packing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]


@pytest.mark.parametrize("cut", [True, False])
def test_pack_group_covers_every_id_once(cut):
    r = random.Random(2)
    for n in (1, 2, 17, 200):
        sizes = [r.choice([1, 5, 700, 2047, 2048, 2049, 9000, r.randint(1, 3000)]) for _ in range(n)]
        seen = defaultdict(list)
        windows = packing.pack_group(sizes, 2048, cut)
        for w in windows:
            assert 0 < sum(p[2] for p in w) <= 2048
            for d, a, m in w:
                seen[d].append((a, m))
        for d, size in enumerate(sizes):
            at = 0
            for a, m in sorted(seen[d]):
                assert a == at and m > 0
                at += m
            assert at == size
        if cut:
            assert len(windows) == -(-sum(sizes) // 2048)


def test_window_count_rises_over_capacity():
    """Tails that don't fit in the least count of windows: none is cut, windows are added until all fit."""
    assert len(packing.pack_group([1100] * 10, 2048, cut=False)) == 10
    assert len(packing.pack_group([1500, 1400, 600, 500], 2048, cut=False)) == 2
    r = random.Random(6)
    for _ in range(20):
        sizes = [min(2047, int(r.lognormvariate(6.3, 0.9)) + 1) for _ in range(1500)]
        windows = packing.pack_group(sizes, 2048, cut=False)
        assert sorted((d, a, n) for w in windows for d, a, n in w) == [(i, 0, n) for i, n in enumerate(sizes)]
        assert max(sum(p[2] for p in w) for w in windows) <= 2048
        assert sum(sizes) >= 0.95 * 2048 * len(windows)


def test_packing_cuts_only_long_documents_and_pads_little(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    pieces = packing.pack(docs.coalesce(1), BYTE).collect()
    assert all((p.doc_tokens > 2048) or p.length == p.doc_tokens for p in pieces)
    assert sum(p.length for p in pieces) >= 0.97 * 2048 * len({p.sequence_id for p in pieces})


def test_pack_rows(odd_docs, corpus):
    for df in (odd_docs, corpus):
        texts = {r.doc_id: r.text for r in df.collect()}
        by_doc, by_window = defaultdict(list), defaultdict(list)
        for p in packing.pack(df, BYTE).collect():
            by_doc[p.doc_id].append(p)
            by_window[p.sequence_id].append(p)
        assert set(by_doc) == set(texts)
        for d, pieces in by_doc.items():
            ids, at = [*lib_ids(BYTE, texts[d]), 1], 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert (p.start, p.doc_tokens) == (at, len(ids))
                at += p.length
                assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : at], "<u4").tobytes())
            assert at == len(ids)
        for pieces in by_window.values():
            at = 0
            for p in sorted(pieces, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at <= 2048


def test_room_tree_finds_best_fit():
    r = random.Random(3)
    tree, rooms = token_output.RoomTree(100), []
    for _ in range(500):
        n = r.randint(1, 100)
        want = min((x for x in rooms if x >= n), default=-1)
        assert tree.least(n) == want
        if want > 0 and r.random() < 0.6:
            rooms.remove(want)
            tree.add(want, -1)
        x = r.randint(1, 100)
        rooms.append(x)
        tree.add(x, 1)


def test_token_output_round_trip(odd_docs, corpus, tmp_path):
    for k, df in enumerate((odd_docs, corpus)):
        out = token_output.windows(df, BYTE)
        token_output.write(out, str(tmp_path / str(k)))
        back = df.sparkSession.read.parquet(str(tmp_path / str(k)))
        got = defaultdict(list)
        for r in token_output.unpack(back).collect():
            got[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        want = {r.doc_id: [*lib_ids(BYTE, r.text), 1] for r in df.collect()}
        assert {d: [i for _, x in sorted(p) for i in x] for d, p in got.items()} == want
        for r in back.collect():
            assert len(r.input_ids) == 4 * 2048 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 2048
            assert r.position_resets == r.cu_seqlens[:-1]


@pytest.mark.parametrize("low,high", [(1025, 1101), (1000, 1401), (683, 761), (1, 2049), (500, 5000), (20, 40)])
def test_little_padding_whatever_the_lengths(low, high):
    """Groups of two million ids whose lengths don't fill windows are cut; every id lies in one piece, no window is over capacity."""
    r = np.random.default_rng(low)
    sizes = r.integers(low, high, max(1, 4_000_000 // (low + high))).tolist()
    began = time.process_time()
    windows = packing.pack_group(sizes, 2048, cut=False, most_padding=1 / 64)
    assert time.process_time() - began < 8  # below one second on a machine at rest
    held = defaultdict(list)
    for w in windows:
        assert 0 < sum(n for _, _, n in w) <= 2048
        for doc, at, n in w:
            held[doc].append((at, n))
    for doc, size in enumerate(sizes):
        at = 0
        for start, n in sorted(held[doc]):
            assert start == at and n > 0
            at += n
        assert at == size
    assert 1 - sum(sizes) / (2048 * len(windows)) <= 0.02


def test_documents_are_cut_only_where_need_be():
    sizes = np.clip(np.random.default_rng(3).lognormal(5.5, 0.9, 5000).astype(int), 1, 2048).tolist()
    pieces = Counter(doc for w in packing.pack_group(sizes, 2048, cut=False, most_padding=1 / 64) for doc, _, _ in w)
    assert sum(n > 1 for n in pieces.values()) <= 5
