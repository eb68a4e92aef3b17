"""Media columns and SentencePiece: round trips, parity and odd inputs."""

from __future__ import annotations

import hashlib
import io
import random
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest

from framelake.llm import media, sentencepieces as sp


@pytest.mark.parametrize("shape", [(1, 64), (7, 64), (5, 3), (1, 1)])
@pytest.mark.parametrize("encode", [media.encode_pgm, media.encode_bmp])
def test_images_come_back(shape, encode):
    grey = np.random.default_rng(0).integers(0, 256, shape).astype(np.uint8)
    assert (media.decode(encode(grey))[:, :, 0] == grey).all()


def test_other_netpbm_and_bmp_kinds():
    assert media.decode(b"P1\n# c\n3 2\n1 0 1\n010")[:, :, 0].tolist() == [[1, 0, 1], [0, 1, 0]]
    assert media.decode(b"P2 2 1 9 4 9")[:, :, 0].tolist() == [[4, 9]]
    assert media.decode(b"P3 1 1 255 1 2 3")[0, 0].tolist() == [1, 2, 3]
    assert media.decode(b"P4\n9 1\n\x80\x80")[:, :, 0].tolist() == [[1, 0, 0, 0, 0, 0, 0, 0, 1]]
    assert media.decode(b"P5 1 1 65535\n\x01\x02")[0, 0].tolist() == [258]
    assert media.decode(b"P6 1 1 255\n\x07\x08\x09")[0, 0].tolist() == [7, 8, 9]
    put = lambda n, k: n.to_bytes(k, "little", signed=n < 0)
    head = b"BM" + put(0, 8) + put(54, 4) + put(40, 4) + put(1, 4) + put(-2, 4) + put(1, 2) + put(24, 2) + bytes(24)
    assert media.decode(head + b"\x01\x02\x03\x00\x04\x05\x06\x00").tolist() == [[[3, 2, 1]], [[6, 5, 4]]]


def a_bmp(bits, packed, body, palette=b"", used=0, width=1, height=1):
    put = lambda n, k: n.to_bytes(k, "little", signed=n < 0)
    head = b"BM" + put(0, 8) + put(54 + len(palette), 4) + put(40, 4) + put(width, 4) + put(height, 4) + put(1, 2) + put(bits, 2) + put(packed, 4) + bytes(12) + put(used, 4) + put(0, 4)
    return head + palette + body


def test_bodies_with_comments_masks_and_spare_bytes():
    assert media.decode(b"P1\n3 1\n1 # 0 1\n0 1")[:, :, 0].tolist() == [[1, 0, 1]]
    assert media.decode(b"P2 2 1 9 4 # 7\n9 ")[:, :, 0].tolist() == [[4, 9]]
    assert media.decode(b"P5 1 1 65535\n\x01\x02\x09")[0, 0].tolist() == [258]
    masks = b"".join(m.to_bytes(4, "little") for m in (0xFF, 0xFF00, 0xFF0000))
    assert media.decode(a_bmp(32, 3, b"\x01\x02\x03\x00", masks))[0, 0].tolist() == [1, 2, 3]
    assert media.decode(a_bmp(16, 0, b"\xff\x7f\x00\x00"))[0, 0].tolist() == [255, 255, 255]
    assert media.decode(a_bmp(8, 0, b"\x01\x00\x00\x00", b"\x01\x02\x03\x00\x04\x05\x06\x00", 2))[0, 0].tolist() == [6, 5, 4]
    assert media.decode(b"P5 0 0 255\n").shape == (0, 0, 1)


BAD = [b"", b"P5", b"P5 4 4 255\n12", b"BM12", b"GIF89a", b"P5 1 1 0\n1", b"P2 1 1 255 300", b"P2 1 1 255 x", b"P1 1 1 3", b"P5 1 1 3\n\x09", b"P2 2 1 9 4"]
BAD += [a_bmp(8, 0, b"\x02\x00\x00\x00", bytes(8), 2), a_bmp(8, 0, b"\x00" * 4, bytes(8), 300), a_bmp(32, 3, bytes(4), bytes(12)), a_bmp(24, 0, b"\x00"), a_bmp(8, 1, bytes(4))]


@pytest.mark.parametrize("raw", BAD)
def test_bad_files(raw):
    with pytest.raises(ValueError):
        media.decode(raw)


def test_area_resize_keeps_means():
    rng = np.random.default_rng(0)
    x = rng.random((37, 51))
    assert np.allclose(media.area_resize(x, 8, 9).mean(), x.mean())
    assert np.allclose(media.area_resize(np.arange(12.0).reshape(3, 4), 3, 4), np.arange(12.0).reshape(3, 4))
    tall = rng.integers(0, 256, (997, 13)).astype(np.uint8)
    assert np.allclose(media.area_resize(tall, 8, 9, band=10), media.area_resize(tall, 8, 9))
    assert np.allclose(media.area_resize(np.arange(8.0).reshape(2, 4), 1, 2), [[2.5, 4.5]])


def test_tiles_come_back():
    x = np.random.default_rng(0).integers(0, 256, (23, 17)).astype(np.uint8)
    for rows, cols in ((5, 4), (23, 17), (100, 100), (1, 1)):
        assert (media.from_tiles(media.to_tiles(x, rows, cols)) == x).all()


def test_media_columns(odd, none):
    got = media.media_columns(odd, keep_media=True).toPandas()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in got.itertuples():
        raw = texts[None if np.isnan(r.id) else r.id].encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert media.from_tiles(r.media).tobytes() == payload and hashlib.sha256(r.media).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes
    assert got[got.id.isin([1, 2])].media_sha256.nunique() == 1
    assert media.media_columns(none).count() == 0


def test_decode_column(spark):
    rows = [(1, media.encode_pgm(np.full((4, 6), 9, np.uint8))), (2, b"nope"), (3, None)]
    got = {r.id: r for r in media.decode_column(spark.createDataFrame(rows, "k long, f binary"), id_col="k", media_col="f", thumb=2).collect()}
    assert (got[1].height, got[1].width, got[1].channels) == (4, 6, 1) and np.load(io.BytesIO(got[1].thumb)).tolist() == [[9, 9], [9, 9]]
    assert got[2].error and got[3].error and got[2].height is None


CASES = ["", "  ", " a", " a  b   c ", "x" * 50, "▁ foo▁", "a\n\tb", "<s> </s> <unk>", "日本語 テスト 🙂", "é" * 10, " " * 40 + "a", "hello world " * 5000, "\x00\x01z", "a " * 20000 + "  b"]


@pytest.fixture(scope="module")
def raw():
    return Path(sp.MODEL).read_bytes()


def test_parity_with_the_reference_library(raw):
    random.seed(1)
    c = sp.Codec(raw)
    texts = CASES + ["".join(random.choice(["a", "b", " ", "  ", "é", "th", "<0x41>", "\n", "1", "🙂"]) for _ in range(60)) for _ in range(400)]
    ids = c.encode(texts)
    assert all(c.parity(texts, ids, c.decode(ids)))
    assert ids == [c.reference.encode(t) for t in texts]
    assert c.decode(ids) == [c.reference.decode(i) for i in ids]
    assert ids == [x.ids for x in sp.build(c.spec).encode_batch(texts, add_special_tokens=False)]  # the whole library path
    assert c.parity(["a b"], [[1]], ["a b"]) == [False] and c.parity(["a b"], c.encode(["a b"]), ["x"]) == [False]


def as_unigram(raw: bytes) -> bytes:
    """The same model file with the type set to unigram (field 2, its field 3) and scores without ties (field 1, its field 2)."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out, n = b"", 0
    for number, value in sp.fields(raw):
        if number == 1:
            m, n = dict(sp.fields(value)), n + 1
            score = struct.pack("<f", -3.0 - 0.0731 * n**0.5) if m.get(3, 1) == 1 else bytes(4)
            value = b"\x0a" + varint(len(m[1])) + m[1] + b"\x15" + score + b"\x18" + varint(m.get(3, 1))
        if number == 2:
            body = b""
            for k, v in sp.fields(value):
                v = 1 if k == 3 else v
                body += varint(k << 3) + varint(v) if isinstance(v, int) else (varint(k << 3 | 5) + v if len(v) == 4 and k in (10, 15, 51) else varint(k << 3 | 2) + varint(len(v)) + v)
            value = body
        out += varint(number << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(number << 3) + varint(value)
    return out


def test_unigram_scores(raw):
    c = sp.Codec(as_unigram(raw))
    assert c.spec.kind == "unigram"
    texts = ["hello world", "the quick brown fox", " a b", "naïve café", "🙂 ok", ""]
    assert [c.reference.encode(t) for t in texts] == c.encode(texts)


def test_columns(odd, none):
    got = sp.encode_column(odd, model=sp.MODEL).toPandas()
    assert got.round_trip.all() and got.parity.all() and len(got) == odd.count()
    assert got[got.id.isin([3, 4])].n_tokens.tolist() == [0, 0]
    assert sp.encode_column(none, model=sp.MODEL).count() == 0
    back = {r.id: r.text for r in sp.decode_column(sp.encode_column(odd, model=sp.MODEL), model=sp.MODEL, id_col="id").collect()}
    assert back == {r.doc_id: r.text or "" for r in odd.collect()}


def test_parity_is_verified_on_every_row(spark, sf):
    assert sp.op10(spark, sf).where("parity IS NULL OR NOT parity").count() == 0


def test_marks_taken_away_as_by_the_library():
    raw = Path(sp.MODEL).read_bytes()
    c, whole = sp.Codec(raw), sp.build(sp.parse(raw))
    assert c.plain
    texts = ["", " ", "  two", "a\nb", "▁", "▁ x▁ ", "日本 語", "\U0001f9ff é", "end  "]
    ids = [*c.encode(texts), *np.random.default_rng(3).integers(0, len(c.spec.pieces), (50, 40)).tolist()]
    assert c.decode(ids) == whole.decode_batch(ids, skip_special_tokens=False)
