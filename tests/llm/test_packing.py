import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from strandlake.llm import kernels as K
from strandlake.llm import packing
from strandlake.llm import word_tokens as W

PATH = P.path("word_bpe_49k.json")

HARD = ["", " ", "don't stop", "a<|endoftext|>b <|startoftext|>", "A<|ENDOFTEXT|>b", "x-'s y.'ll", "café. —. á ́b", "A B　c", "\x1c a\x1db\x85c", "ΣΣ Σ", "12 345.6% $9", "'''s '", "İı ﬁ", "a|b|c | d", "​ x‍y", "1́.2", "a̸<b", "ẛ̣≠", "Ünï-cödé...!?"]


def test_units_give_the_ids_of_the_library():
    inner = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice(" .,'-|<>aBé1́\n\t") for _ in range(60)) for _ in range(500)]
    t = W.WordTokenizer(PATH)
    raw, off = K.text_buffers(pa.array(texts))
    for _ in range(2):  # new, then from the units kept
        ids, o = t(raw, off)
        for k, x in enumerate(texts):
            assert ids[o[k] : o[k + 1]].tolist() == inner.encode(x, add_special_tokens=False).ids, repr(x)


def check(rows, texts):
    inner = Tokenizer.from_file(PATH)
    whole = {k: inner.encode(t or "", add_special_tokens=False).ids + [1] for k, t in enumerate(texts)}
    got, windows = {}, {}
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length > 0
        assert r.doc_tokens == len(whole[r.doc_id])
        got.setdefault(r.doc_id, []).append((r.start, ids))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, ids in whole.items():
        at = 0
        for start, piece in sorted(got[k]):
            assert start == at
            assert piece == ids[at : at + len(piece)]
            at += len(piece)
        assert at == len(ids)
    fills = []
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        fills.append(at)
    assert max(fills) <= 2048
    return fills


def test_pieces(spark):
    rng = random.Random(2)
    texts = HARD + [None, "word " * 9000] + [" ".join(rng.choice(["alpha", "of", "x1", "é"]) for _ in range(rng.randint(0, 900))) for _ in range(150)]
    frame = spark.createDataFrame([(k, t, 3) for k, t in enumerate(texts)], "doc_id long, text string, start int").coalesce(1)
    fills = check(packing.pack(frame, PATH).collect(), texts)
    assert sum(f < 2048 for f in fills) <= 1
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in packing.packed_digests(frame, PATH).collect()}
    for r in packing.pack(frame, PATH).collect():
        assert digests[r.doc_id, r.start] == zlib.crc32(bytes(r.ids))
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_the_level_with_the_least_sum_of_squares():
    rng = random.Random(4)
    p = packing.SumOfSquares(64)
    for _ in range(3000):
        n = rng.randint(1, 63)
        level = p.level.copy()
        cost = {0: 2 * level[n] + 1}
        for h in range(1, 64 - n + 1):
            if level[h]:
                after = level.copy()
                after[h] -= 1
                if h + n < 64:
                    after[h + n] += 1
                cost[h] = int((after[1:64] ** 2).sum() - (level[1:64] ** 2).sum())
        assert cost[p.place(n)] == min(cost.values())
        p.add(0, np.zeros(n, np.uint16))
    p.pour()
    fills = [sum(len(x[2]) for x in w) for w in p.done]
    assert sum(f < 64 for f in fills) <= 1


def test_repeated_rows_and_null_ids(spark):
    """Rows that repeat are packed each; rows without doc_id are packed too."""
    rows = [(1, "alpha of x1"), (1, "alpha of x1"), (None, "alpha"), (None, None), (2, "word " * 3000)]
    frame = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, sequence_id int")
    got = packing.pack(frame, PATH).collect()
    assert len([r for r in got if r.doc_id == 1 and r.start == 0]) == 2
    assert sorted(r.doc_tokens for r in got if r.doc_id is None) == [1, 2]
    assert sum(r.length for r in got if r.doc_id == 2) == 3001
    assert packing.packed_digests(frame, PATH).count() == len(got)
