import base64
import random

import numpy as np
import public_tokenizers as P
import tiktoken

from strandlake.llm import bpe

FILE = P.path("byte_bpe_50k.tiktoken")


def library():
    with open(FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_tree_equals_library():
    """Halves joined at their seams give the ids of the library, whatever the leaf."""
    rng = random.Random(3)
    whole = library()
    pieces = ["a", "b", "'", "s", "ll", " ", "  ", "\n", "\t", "é", "1", "22", "!", "..", "　", "\x1c", "😀", "the", "'ve", "‍", "A", "́", "re", "\x85"]
    for leaf in (1, 2, 3, 7, 16):
        t = bpe.encoder(FILE, P.PATTERN, leaf)
        for _ in range(2000):
            x = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))
            assert t.encode(x) == whole(x), repr(x)
            assert t.decode(t.encode(x)) == x.encode()


def test_joined_tokens_equal_merges():
    """Windows that grow until the pairs at their edges stay give the merges of the whole."""
    rng = random.Random(4)
    t = bpe.encoder(FILE, P.PATTERN)
    for _ in range(3000):
        x = "".join(rng.choice("aeinorstlmh") for _ in range(rng.randint(1, 60))).encode() if rng.random() < 0.8 else bytes(rng.randrange(256) for _ in range(rng.randint(1, 40)))
        assert t.tokens(x) == t.merged(x), x
        assert t.merged_all([x, b"", x[:7]]) == [tuple(t.merged(x)), (), tuple(t.merged(x[:7]))]


def test_long_runs():
    whole = library()
    t = bpe.encoder(FILE, P.PATTERN, 16)
    for x in ("a" * 5000, " " * 3000, "é" * 2000 + " x", "ab1!" * 800, "\n" * 999 + "b", "=" * 4097, "ha" * 3000, "\x1c" * 300 + " \x1d"):
        assert t.encode(x) == whole(x)


def test_kept_matches_make_room(monkeypatch):
    """More matches than are kept: those of older texts are encoded again."""
    monkeypatch.setattr(bpe, "KEPT", 50)
    whole, t, rng = library(), bpe.TreeEncoder(FILE, P.PATTERN), random.Random(6)
    for _ in range(40):
        texts = [" ".join(rng.choice(["of", "the", f"w{rng.randint(0, 999)}"]) for _ in range(30)) for _ in range(3)]
        assert t.encode_all(texts) == [whole(x) for x in texts]
    assert len(t.known) < 500


def test_rows(spark):
    whole = library()
    texts = [None, "", "Hello  world's\n\n\tend", "x" * 40_000, "<|endoftext|>", "word " * 30_000]
    rows = [(k, t, b"?") for k, t in enumerate(texts)] * 2 + [(None, texts[2], b"?")]
    got = bpe.encode_and_decode(spark.createDataFrame(rows, "doc_id long, text string, ids binary"), FILE, P.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        x = texts[2 if r.doc_id is None else r.doc_id] or ""
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == whole(x)
        assert bytes(r.decoded) == x.encode()
    assert bpe.encode_and_decode(spark.createDataFrame([], "doc_id long, text string"), FILE, P.PATTERN).count() == 0
