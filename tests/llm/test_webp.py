import base64
import hashlib
import itertools
import random

import numpy as np
import pytest

from strandlake.llm import webp as W
from strandlake.llm import webp_lanes as L


def image(rng, h, w, colours=None):
    if colours:
        return rng.integers(0, 256, (colours, 4))[rng.integers(0, colours, (h, w))]
    smooth = np.add.outer(np.arange(h) * 3, np.arange(w) * 2)[..., None] + rng.integers(0, 9, (h, w, 4))
    return smooth & 255


@pytest.mark.parametrize("cache,references", list(itertools.product((0, 1, 6), (False, True))))
def test_cache_and_references(cache, references):
    rng = np.random.default_rng(cache)
    for h, w, colours in ((1, 1, None), (7, 33, 3), (20, 16, None), (31, 5, 40)):
        x = image(rng, h, w, colours)
        assert (W.decode(W.encode(x, (), cache, references)) == x).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    x = image(np.random.default_rng(mode), 9, 13)
    modes = np.full((3, 4), mode)
    assert (W.decode(W.encode(x, [("predictor", 2, modes)])) == x).all()


def test_transforms_together():
    rng = np.random.default_rng(3)
    x = image(rng, 18, 21)
    modes, factors = rng.integers(0, 14, (5, 6)), rng.integers(0, 256, (3, 3, 4))
    for steps in itertools.permutations([("predictor", 2, modes), ("cross", 3, factors), ("green",)]):
        assert (W.decode(W.encode(x, steps, 4, True)) == x).all()


@pytest.mark.parametrize("colours", (1, 2, 3, 4, 9, 16, 17, 200))
def test_palettes(colours):
    x = image(np.random.default_rng(colours), 12, 19, colours)
    assert (W.decode(W.encode(x, [("palette",)], 0, True)) == x).all()


def test_texts(spark):
    rng = random.Random(4)
    texts = [None, "", "a", "ß" * 64, "x" * 191, "x" * 192, "x" * 193, "".join(chr(rng.choice([32, 65, 300, 0x1F600, 10, 0])) for _ in range(5000)), "word " * 40_000]
    given = [(k, t, 0) for k, t in enumerate(texts)] * 2 + [(None, "no id", 0)]
    rows = W.media_columns(spark.createDataFrame(given, "doc_id long, text string, media int")).collect()
    assert len(rows) == len(given)
    assert len({(r.doc_id, bytes(r.media)) for r in rows}) == len(texts) + 1
    for r in rows:
        data = ("no id" if r.doc_id is None else texts[r.doc_id] or "").encode()
        whole = data.ljust(max(192, -(-len(data) // 192) * 192))
        assert r.n_bytes == len(data)
        assert bytes(r.payload) == whole
        assert W.read_payload(bytes(r.media)).tobytes() == whole
        assert r.feature == W.feature(np.frombuffer(whole, np.uint8))
    assert W.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def scalar(media):
    """Samples of a run of files by the general decoder, one file at a time."""
    return b"".join(W._decode_chunk(media[a:b])[..., 1:].astype(np.uint8).tobytes() for a, b in L.decode_files(media))


def padded(text):
    data = text.encode()
    return np.frombuffer(data.ljust(max(1, -(-len(data) // 192)) * 192), np.uint8)


def test_tiles(monkeypatch):
    monkeypatch.setattr(W, "MAX_ROWS", 3)
    data = np.frombuffer(random.Random(1).randbytes(192 * 10), np.uint8)
    (media,) = W.store([data])
    assert media.count(b"RIFF") >= 4
    assert hashlib.sha256(W.read_payload(media)).digest() == hashlib.sha256(data).digest()


def test_lanes_equal_the_general_decoder():
    """Texts of all kinds, stored and read together, give the samples that the general decoder gives one by one."""
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdefghij klmnop") for _ in range(1200))
    texts = [passage * 4, "ab" * 9000, "=" * 30_000, "", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(4000)), passage, "line of text\n" * 900]
    texts += ["".join(rng.choice(["the ", "of ", "word ", "\n", "é", "0123 ", passage[:90]]) for _ in range(rng.randint(0, 900))) for _ in range(60)]
    payloads = [padded(x) for x in texts]
    media = W.store(payloads)
    for x, m, back in zip(payloads, media, L.decode_all(media), strict=True):
        assert back.tobytes() == x.tobytes()
        assert scalar(m) == x.tobytes()
    alone = [W.store([x])[0] for x in payloads]
    assert alone == media  # equal texts, equal media, whatever stands beside them


def test_stored_texts_use_the_features():
    """Where content repeats, tiles have back-references and cached colours, or a palette; such files are much shorter than literals."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefghij klmnop") for _ in range(1200))
    kinds = []
    for text in (passage * 4, "=" * 30_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(384))):
        x = padded(text)
        (media,) = W.store([x])
        a, b = L.decode_files(media)[0]
        code = L.head_of(media[a:b])[1]
        kinds.append("palette" if code is None else code.cache_bits)
        if len(kinds) < 3:
            literal = L._literal_bits(L.presets()[0], x.reshape(-1, 3).astype(np.int64) @ np.array([1 << 16, 1 << 8, 1]))[1].sum() / 8
            assert len(media) < 0.6 * literal
    assert kinds == [L.CACHE_BITS, "palette", 0]


def test_lanes_read_other_codes():
    """Images of other encoders' codes: own codes of each image, caches of other sizes, one symbol a code."""
    rng = np.random.default_rng(5)
    images = [image(rng, h, 64, colours) for h, colours in ((1, 1), (9, 3), (30, None), (64, 40), (17, 9))]
    files = [W.encode(x, (), cache, refs) for x in images for cache in (0, 1, 6) for refs in (False, True)]
    for x, back in zip([x for x in images for _ in range(6)], L.decode_all(files), strict=True):
        assert back.tobytes() == x[..., 1:].astype(np.uint8).tobytes()


def test_broken_files():
    (media,) = W.store([padded("some text " * 100)])
    a, b = L.decode_files(media)[0]
    with pytest.raises(ValueError):
        L.decode_all([media[: a + 60]])
    with pytest.raises(ValueError):
        L.decode_all([b"RIFF" + media[4:8] + b"WAVE" + media[12:]])


def test_fixed_vectors():
    """Files written out by hand from the format's text, not by this encoder."""
    # the published one-pixel file: header 0x2f, 1 x 1, alpha used; subtract-green, then codes of one symbol each
    one = W.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert one.shape == (1, 1, 4)

    def file(bits):
        n = len(bits)
        value = sum(int(c) << k for k, c in enumerate(bits))
        return W._file(value.to_bytes(-(-n // 8), "little"))

    def number(x, n):
        return "".join(str(x >> k & 1) for k in range(n))

    def size(w, h):
        return number(0x2F, 8) + number(w - 1, 14) + number(h - 1, 14) + "0" + "000"

    def single(symbol):
        return "1" + "0" + "1" + number(symbol, 8)

    def two(first, second):
        return "1" + "1" + "1" + number(first, 8) + number(second, 8)

    # 4 x 1: no transform, cache or meta code; green 7 or 9, red 1, blue 2, alpha 255
    plain = file(size(4, 1) + "0" + "0" + "0" + two(7, 9) + single(1) + single(2) + single(255) + single(0) + "0110")
    assert W.decode(plain).reshape(-1, 4).tolist() == [[255, 1, 7, 2], [255, 1, 9, 2], [255, 1, 9, 2], [255, 1, 7, 2]]
    assert W.read_payload(plain).reshape(-1, 3).tolist() == [[1, 7, 2], [1, 9, 2], [1, 9, 2], [1, 7, 2]]
    # subtract-green (kind 2): red and blue come back by adding green
    green = file(size(2, 1) + "1" + number(2, 2) + "0" + "0" + "0" + two(7, 9) + single(255) + single(2) + single(255) + single(0) + "01")
    assert W.decode(green).reshape(-1, 4).tolist() == [[255, 6, 7, 9], [255, 8, 9, 11]]
    # palette of two colours (kind 3): the table as an image of steps, then eight indices a pixel in green
    table = "0" + two(3, 4) + single(1) + single(2) + two(0, 255) + single(0) + "01" + "10"
    palette = file(size(8, 1) + "1" + number(3, 2) + number(1, 8) + table + "0" + "0" + "0" + single(0b10110001) + single(0) + single(0) + single(255) + single(0))
    a, b = [255, 1, 3, 2], [255, 2, 7, 4]
    assert W.decode(palette).reshape(-1, 4).tolist() == [b, a, a, a, b, b, a, b]
