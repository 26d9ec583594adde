"""The operators that treat each text alone, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from replisift.llm import bpe, media, packing, quality, token_counts
from tests.llm.helpers import LONG, TEXTS, docs, empty

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
ALPHABET = st.sampled_from(list("aabehrstv'’ST 012  \n\t.,!-é漢😀  "))


@pytest.fixture(scope="module")
def whole():
    return tiktoken.Encoding("w", pat_str=P.PATTERN, mergeable_ranks=token_counts.load_ranks(RANKS), special_tokens={})


def multiset(rows):
    return Counter(tuple(r) for r in rows)


# --- packing


def test_decompose():
    for n in range(1, 5000):
        parts = packing.decompose(n, 2048)
        assert sum(parts) == n and all(p & (p - 1) == 0 for p in parts) and parts == sorted(parts, reverse=True)
        assert len([p for p in parts if p < 2048]) == len({p for p in parts if p < 2048})


def test_packing(spark):
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    rows = packing.pack_documents(docs(spark), WORDS).collect()
    want = Counter()
    for i, text in TEXTS:
        ids = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for n in packing.decompose(len(ids), 2048):
            want[i, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)] += 1
            at += n
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    assert all(zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.offset == 0 and 1 << r.bucket == r.length for r in rows)
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert packing.pack_documents(empty(spark), WORDS).count() == 0
    assert packing.pack_documents(docs(spark, [(1, None)]), WORDS, end_id=None).count() == 0


def test_word_cache_is_bounded():
    ids, t = packing.WordIds(WORDS, 5), Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    for text in ("a b c d", "c d e f g h i", "a b", "x y z a", LONG):
        assert np.frombuffer(ids(text.encode()), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
        assert len(ids.words.young) <= 5 and len(ids.pieces.old) <= 5


def test_write_packed(spark, tmp_path):
    packing.write_packed(packing.pack_documents(docs(spark), WORDS), f"{tmp_path}/p")
    back = spark.read.parquet(f"{tmp_path}/p")
    assert back.where("length != shiftleft(1, bucket)").count() == 0 and back.count() > 10


# --- byte-level BPE


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=200), st.sampled_from([1, 2, 3, 7, 40]), st.sampled_from([1, 2, 8]))
def test_tree_encoding(whole, text, leaf, window):
    assert bpe.coder(RANKS, P.PATTERN).encode(text, leaf, window) == whole.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=120), st.sampled_from([1, 3, 9]))
def test_tree_encoding_of_any_text(whole, text, leaf):
    coder = bpe.coder(RANKS, P.PATTERN)
    ids = coder.encode(text, leaf, 1)
    assert ids == whole.encode_ordinary(text)
    assert coder.decode(ids, 2) == text.encode()


def test_bpe_queries(spark, whole):
    rows = bpe.bpe_digests(docs(spark), RANKS, P.PATTERN).collect()
    want = Counter()
    for i, text in TEXTS:
        ids = whole.encode_ordinary(text or "")
        want[i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert multiset(rows) == want
    encoded = bpe.bpe_encode(docs(spark), RANKS, P.PATTERN)
    back = bpe.bpe_decode(encoded, RANKS, P.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back) == Counter((i, (t or "").encode()) for i, t in TEXTS)
    assert bpe.bpe_digests(empty(spark), RANKS, P.PATTERN).count() == 0


# --- token counts


def greedy(vocab, data):
    n = at = 0
    while at < len(data):
        size = next((k for k in range(min(40, len(data) - at), 1, -1) if data[at : at + k] in vocab), 1)
        n, at = n + 1, at + size
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(x % 3 for x in b)), max_size=12), st.binary(max_size=40))
def test_automaton(vocab, data):
    data = bytes(x % 3 for x in data)
    assert token_counts.LongestMatch(vocab).count(data) == greedy(vocab, data)


def test_token_counts(spark):
    vocab, find = set(token_counts.load_ranks(RANKS)), regex.compile(P.PATTERN).findall
    want = Counter((i, len(find(t or "")), sum(greedy(vocab, p.encode()) for p in find(t or "")), len((t or "").encode())) for i, t in TEXTS)
    assert multiset(token_counts.token_counts(docs(spark), RANKS, P.PATTERN).collect()) == want
    assert token_counts.token_counts(empty(spark), RANKS, P.PATTERN).count() == 0


# --- quality rules


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), len(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "#é", "\n", " ", "a b c", " "]), max_size=60).map(" ".join))
def test_measures(text):
    assert quality.measure(text.encode())[:5] == measured(text)


def test_ledger(spark):
    ledger = quality.apply_policy(quality.quality_ledger(docs(spark)))
    rows = ledger.collect()
    assert Counter((r.doc_id, *r[1:6]) for r in rows) == Counter((i, *measured(t or "")) for i, t in TEXTS)
    for r in rows:
        assert bool(r.failed & 1) == (r.n_words < 50) and bool(r.failed & 2) == (100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (r.failed & quality.mask(quality.DEFAULT_POLICY) == 0)
    table = {r.rule: r for r in quality.ablations(ledger).collect()}
    bits = quality.mask(quality.DEFAULT_POLICY)
    for name, bit in quality.BIT.items():
        if name in table:
            assert table[name].n_failed == sum(bool(r.failed & bit) for r in rows)
            assert table[name].n_only == sum(r.failed & bits == bit for r in rows)
    kept = quality.keep_quality(docs(spark))
    assert kept.columns == docs(spark).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.kept)
    assert quality.quality_ledger(empty(spark)).count() == 0 and quality.keep_quality(empty(spark)).count() == 0


# --- media


def test_store_round_trip(spark):
    rows = media.text_media(docs(spark)).collect()
    assert len(rows) == len(TEXTS)
    by_text = {}
    for r in rows:
        back = media.read_samples(bytes(r.media))
        assert len(back) == r.payload_bytes == 64 * max(1, -(-r.n_bytes // 64)) and hashlib.sha256(back).hexdigest() == r.payload_sha256
        assert zlib.crc32(back[-64:]) == r.tail_crc32 and len(r.media) == r.media_bytes
        assert by_text.setdefault(back, tuple(r[1:])) == tuple(r[1:])
    assert Counter(media.read_samples(bytes(r.media))[: r.n_bytes] for r in rows) == Counter((t or "").encode() for _, t in TEXTS)
    assert media.text_media(empty(spark)).count() == 0


def samples():
    import struct

    png = media.store_samples(bytes(range(64)) * 3)
    wav = b"RIFF" + struct.pack("<I", 40) + b"WAVEfmt " + bytes(20) + b"data" + bytes(8)
    bmp = b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + bytes(28)
    gif = b"GIF89a" + bytes(7) + b"\x2c" + bytes(9) + b"\x02\x01\x00\x00\x3b"
    jpeg = b"\xff\xd8\xff\xc0\x00\x04\x01\x02\xff\xda\x00\x02ab\xff\x00c\xff\xd9"
    pdf = b"%PDF-1.4\nstartxref\n0\n%%EOF"
    return {"png": png, "wav": wav, "bmp": bmp, "gif": gif, "jpeg": jpeg, "pdf": pdf}


def test_sniffing_and_carving(spark):
    sniff, rng = media.Sniffer(), random.Random(1)
    for kind, data in samples().items():
        assert sniff.find(data)[0] == (kind, 0, len(data)), kind
        noise = bytes(rng.randrange(32, 127) for _ in range(50)) + b"BM GIF89a RIFF %PDF-x "
        assert sniff.find(noise + data + noise) == [(kind, len(noise), len(data))]
        assert all(k != kind for k, _, _ in sniff.find(data[:-2] if kind != "pdf" else data[:-4]))
    s = samples()
    rows = [(1, s["png"], "JPEG"), (2, s["gif"] + b"--" + s["wav"], "gif"), (3, None, "png"), (4, b"plain", None), (5, b"", "x")]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None, d) for i, b, d in rows], "id long, body binary, carvedtype string")
    got = {r.id: r for r in media.sniff_media(df, "body", "carvedtype", "id").collect()}
    assert (got[1].media_type, got[1].corrected, got[1].carved) == ("png", True, [])
    assert (got[2].media_type, got[2].corrected) == ("gif", False)
    assert [(c.type, bytes(c.data)) for c in got[2].carved] == [("wav", s["wav"])]
    assert all(got[k].media_type is None and not got[k].corrected and got[k].carved == [] for k in (3, 4, 5))


def test_special_tokens_written_out(spark):
    t = Tokenizer.from_file(WORDS)  # as its file sets it up: the contract's call sets add_special_tokens alone
    texts = [(1, "a <|endoftext|> b"), (2, "x<|startoftext|>y<|endoftext|>"), (3, "<|endoftext|>" * 3 + " é漢 " + LONG), (4, "<|ENDOFTEXT|> <|end"), (5, None), (6, "plain")]
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in texts}
    got = {}
    for r in sorted(packing.pack_documents(docs(spark, texts), WORDS, special=True).collect(), key=lambda r: (r.doc_id, r.start)):
        got[r.doc_id] = got.get(r.doc_id, []) + list(r.ids)
    assert got == want and any(i > 49000 for i in want[1])


def test_quality_bits_of_a_struct(spark):
    row = spark.createDataFrame([(1, "a b c " * 40)], "doc_id long, text string")
    ledger = quality.quality_ledger(row).first()
    packed = quality.quality_ledger(row).selectExpr("struct(*) AS `my m`")
    assert packed.select(quality.failed_bits("my m").alias("f")).first().f == ledger.failed > 0


def test_counts_keep_their_bound():
    counts = token_counts.counter(RANKS)
    small = token_counts._Counts(counts.automaton, 5)
    pieces = [f"w{k % 17}" for k in range(200)] + ["x" * 100] * 3
    assert [small[p] for p in pieces] == [counts[p] for p in pieces] and len(small) <= 5 and len(small.old) <= 5
