"""BPE, packing and media columns against the libraries, with exact round trips."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bitloom.llm import bpe, media, packing, queries
from bitloom.llm.words import WordIds, load

BYTES, WORDS = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/word_bpe_49k.json"
PIECES = ["abc d", "'s're 'll'x", "  \n\t ", "aaaaaa", "1234 5", "é ñ ü漢字", "<|endoftext|>", "''''", "***$$$", "   x", "🙂👩‍🚀", "the of and ", "\x1c", "\xa0 ", "İ", "Ǆ"]
mixtures = st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=8)), max_size=60).map("".join).map(lambda t: t.encode("utf-8", "ignore").decode())


@pytest.fixture(scope="module")
def byte_tokenizer():
    return Tokenizer.from_file(BYTES)


@settings(max_examples=200, deadline=None)
@given(mixtures, st.lists(st.integers(0, 400), max_size=3))
def test_tree_concatenation_is_exact(text, cuts):
    c = bpe.codec(BYTES)
    at = [0, *sorted(min(k, len(text)) for k in cuts), len(text)]
    parts = [text[a:b] for a, b in zip(at, at[1:], strict=False)]
    ids = c.tree([p.encode() for p in parts], c.encode(parts))
    assert ids.tolist() == c.tokenizer.encode(text, add_special_tokens=False).ids
    assert c.decode([ids]) == [c.tokenizer.decode(ids.tolist(), skip_special_tokens=False)]


@pytest.mark.parametrize("run", ["a", " ", "ab", "\n", "9", "é", "'", "'s", "*$", "漢", "<|endoftext|>", "\n "])
def test_long_unsplit_texts(run):
    c = bpe.codec(BYTES)
    text = run * 5000
    cut = len(text) // 2 + 1
    ids = c.tree([text[:cut].encode(), text[cut:].encode()], c.encode([text[:cut], text[cut:]]))
    assert ids.tolist() == c.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(mixtures)
def test_words_have_the_tokenizers_ids(text):
    w = WordIds(load(WORDS), lower=True, cached=50)
    assert np.frombuffer(w.ids([text.encode().split()])[0], "<u4").tolist() == w.tokenizer.encode(text, add_special_tokens=False).ids


def test_bpe_rows(odd, odd_rows, none, byte_tokenizer):
    found = bpe.encode(odd, BYTES, long=2000, leaf=700).collect()
    expected = []
    for i, t in odd_rows:
        ids = byte_tokenizer.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), np.array(ids, "<u4").tobytes(), byte_tokenizer.decode(ids, skip_special_tokens=False)))
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r[0], r[1], bytes(r[2]), r[3]) for r in found), key=order) == sorted(expected, key=order)
    assert bpe.encode(none, BYTES).count() == 0


def test_bpe_query(spark, small, byte_tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op7_bpe(spark, small).collect():
        ids = byte_tokenizer.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(byte_tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def _check_pieces(rows, texts):
    tokenizer = Tokenizer.from_file(WORDS)
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID], "<u4") for i, t in texts}
    copies = Counter(i for i, _ in texts)
    covered, sequences = defaultdict(Counter), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id]
        if r.doc_id is not None:
            assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(own)
        covered[r.doc_id].update(range(r.start, r.start + r.length))
        sequences[r.sequence_id].append((r.offset, r.length, r.sequence_tokens))
    for i, own in ids.items():
        if i is not None:
            assert covered[i] == Counter({k: copies[i] for k in range(len(own))})
    for pieces in sequences.values():
        pieces.sort()
        ends = np.cumsum([n for _, n, _ in pieces])
        assert [o for o, _, _ in pieces] == [0, *ends[:-1]] and {t for _, _, t in pieces} == {ends[-1]}
        assert ends[-1] <= packing.CAPACITY and ends[-1] & (ends[-1] - 1) == 0  # full, or a power of two: no padding


def test_packing_rows(odd, odd_rows, none):
    _check_pieces(packing.pack(odd, WORDS).collect(), odd_rows)
    assert packing.pack(none, WORDS).count() == 0


def test_packing_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    _check_pieces(queries.op9_packing(spark, small).collect(), [tuple(d) for d in docs])


def test_packing_balances_cost():
    rng = random.Random(1)
    p = packing.Packer(0)
    for i in range(3000):
        p.add(i, np.zeros(rng.choice([40, 200, 900, 2500]), "<u4"))
    rows = p.pack()
    cost = {r[5]: r[8] for r in rows}
    assert np.std(list(cost.values())) < 0.25 * np.mean(list(cost.values()))
    assert p.tokens < packing.CAPACITY


def test_media_rows(odd, odd_rows, none):
    for r in media.media_columns(odd).collect():
        data = media.read_wav(bytes(r.media))
        assert r.payload_bytes == len(data) >= media.UNIT and len(data) % media.UNIT == 0
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.tail_crc32 == zlib.crc32(data[-16:])
        assert len(r.peak_times) == len(r.peak_codes) and list(r.peak_times) == sorted(r.peak_times)
    texts = Counter((t or "").encode().ljust(max(1, -(-len((t or "").encode()) // 192)) * 192) for _, t in odd_rows)
    assert Counter(media.read_wav(bytes(r.media)) for r in media.media_columns(odd).collect()) == texts
    assert media.media_columns(none).count() == 0


def test_equal_texts_have_equal_features(odd):
    rows = [r for r in media.digests(media.media_columns(odd)).collect() if r.doc_id in (1, 2)]
    assert len(rows) == 3 and len({r.feature for r in rows}) == len({r.media_sha256 for r in rows}) == 1


def test_fingerprint_finds_a_tone():
    n = np.arange(8000)
    tone = (128 + 100 * np.sin(2 * np.pi * 20 / media.FRAME * n)).astype(np.uint8).tobytes()
    assert (media.peaks(tone)[:, 0] == 20).all()
    times, codes = media.fingerprint(tone)
    assert len(times) and (codes >> 16 == 20).any()


@pytest.mark.parametrize("units", [1, 2, 3, 7])
def test_frames_cover_whole_texts(units):
    text = b"A few plain words that a short text may hold, said again. " * 30
    data = text[: units * media.UNIT]
    frames = media.framed(data) * np.hanning(media.FRAME)
    for at in (0, 1, len(data) // 2, len(data) - 2, len(data) - 1):
        other = media.framed(data[:at] + bytes([data[at] ^ 16]) + data[at + 1 :]) * np.hanning(media.FRAME)
        assert frames.shape == other.shape and np.abs(frames - other).max() > 2


def test_short_texts_have_pairs_of_all_bands():
    features = {tuple(map(bytes, media.fingerprint(media.payload(t)[1]))) for t in ("a short text", "another one", "x" * 300, "yz" * 150)}
    assert len(features) == 4 and all(codes for _, codes in features)
    p = media.peaks(bytes(range(32, 128)) * 20)
    others = {(int(c) >> 4) & 0xFFF for c in media.fingerprint(bytes(range(32, 128)) * 20)[1]}
    assert others == {int(b) for b in p[1:].ravel() if b >= 0}


def test_media_query_gives_the_contract_columns(spark, small):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op8_media(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r.doc_id].ljust(max(1, -(-len(texts[r.doc_id]) // 192)) * 192)
        stored = media.write_wav(data)
        times, codes = media.fingerprint(data)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(texts[r.doc_id]), len(data), zlib.crc32(data[-16:]))
        assert (r.payload_sha256, r.media_bytes, r.media_sha256) == (hashlib.sha256(data).hexdigest(), len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature.split(":")[0] == str(len(codes)) and len(times) == len(codes)
