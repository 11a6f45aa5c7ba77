"""Hierarchical Pitman-Yor language model: seating by Gibbs, log10 probabilities of whole texts.

Words are runs of bytes other than ASCII white space, lower-cased (A-Z); each text ends
with an end token.  Each previous word has a context restaurant of its own, so
restaurants grow with the corpus; all share their parent, the restaurant without context,
whose base is uniform over the V words of the training texts and one class for all others.
A predictive probability is

    (c_uw - d t_uw + (strength + d t_u) P(w)) / (strength + c_u)

with customers c and tables t, P(w) of the same form one level up, and is averaged over ``SAMPLES`` states of the
sampler.  Words and contexts are told apart by 64-bit hashes.

*Sampler.*  A sweep draws, each from its conditional given all the rest,

* for each context u an auxiliary x_u ~ Gamma(strength/d + t_u): given these, dishes are independent;
* the tables of each dish in each context, P(t_uw = t) ~ S(c_uw, t) (d x_u G(w))**t with generalised Stirling numbers S;
* the same two of the root, whose dishes have one customer for each table below and the base in G's place;
* the root's weights G(w): Gamma(c_w - d t_w) of each word and Gamma(strength + d t) for what is new,
  divided by their sum (new weight falls on words by the base).

Draws with more than ``EXACT`` customers use the Stirling numbers' alternating sum, and from 32 expected tables on
their normal limit (see ``draw_tables``).  Random numbers are hashes of the
word, the context and the sweep, and sums over parts are of whole numbers, so the result
doesn't depend on the number of parts or on which task does what.

*Distribution.*  Places meet by context, so a restaurant is in one part whole; *hot* contexts (those with a
thousandth of all tokens, ``4 * HOT`` at most) are spread over all parts by word.  Numbers that several parts share, the
root's customers of a word and a hot context's tables, are added up in each sweep by an exchange by key; so
are the sums over all words.  Keys that one part alone has stay there.  Nothing is broadcast but the list of hot contexts
and ``COMMON`` words that blobs name by numbers.

Nulls and empties: a null text is empty, an end token alone.  Rows count each, repeated or not.
A null doc_id counts as the text "" in the choice of training rows.  An empty table gives
no rows; without training rows every word is unknown.  A very long text is like any other; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from . import kernels as K

SAMPLES, BURN_IN = 2, 2
DISCOUNT, STRENGTH = 0.8, 20.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.6, 10.0
HOT = 1000
EXACT = 256
FLUSH = 4_000_000
#: Tokens of a part, and parts that small tables have at most.
PART_TOKENS, FEW_PARTS = 2_500_000, 24
#: Words that lists name by a number of two bytes; which they are has no effect on results.
COMMON = 1 << 15
#: Logarithms are added up as multiples of 1 / SCALE, so sums are exact whatever their order.
SCALE = float(1 << 30)

END = np.uint64(0x3C79AC492BA7B653)
BEGIN = np.uint64(0x1B873593CC9E2D51)
_U = np.uint64
_HOT_KEY = _U(0x5851F42D4C957F2D)

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out_rows(doc_ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % 5 == 1 for x in doc_ids], dtype=bool)


def places(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, document index) of each token of a window, end tokens included."""
    _, _, h, doc = K.word_spans(raw, offsets, K.NOT_SPACE)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n)
    stop = np.cumsum(count)
    h = np.insert(h, stop, END)
    doc = np.insert(doc, stop, np.arange(n))
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[stop - count + np.arange(n)] = BEGIN
    return h, K.mix64(before * _U(0x9FB21C651E98DF25)), doc


# random numbers by key


def uniform(key: np.ndarray, sweep: int, salt: int) -> np.ndarray:
    """Numbers in (0, 1) that a key, a sweep and a salt give."""
    h = K.mix64(key ^ _U((sweep * 0x9E3779B97F4A7C15 + salt * 0xC2B2AE3D27D4EB4F + 1) & 0xFFFFFFFFFFFFFFFF))
    return ((h >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)


def normal(key: np.ndarray, sweep: int, salt: int) -> np.ndarray:
    return np.sqrt(-2 * np.log(uniform(key, sweep, salt))) * np.cos(2 * np.pi * uniform(key, sweep, salt + 1))


def gamma(key: np.ndarray, shape: np.ndarray, sweep: int) -> np.ndarray:
    """Gamma draws of scale 1 by a key (Marsaglia and Tsang 2000)."""
    shape = np.asarray(shape, np.float64)
    d = np.where(shape < 1, shape + 1, shape) - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out = np.zeros(len(key))
    open_, salt = np.arange(len(key)), 16
    while len(open_):
        x = normal(key[open_], sweep, salt)
        v = (1 + c[open_] * x) ** 3
        u = np.log(uniform(key[open_], sweep, salt + 2))
        with np.errstate(invalid="ignore", divide="ignore"):
            good = (v > 0) & (u < 0.5 * x * x + d[open_] * (1 - v + np.log(v)))
        out[open_[good]] = (d[open_] * v)[good]
        open_, salt = open_[~good], salt + 3
    small = np.flatnonzero(shape < 1)
    out[small] *= uniform(key[small], sweep, 15) ** (1 / shape[small])
    return out


# table counts


@functools.cache
def _stirling(d: float) -> np.ndarray:
    """log S(c, t) of generalised Stirling numbers for c, t up to EXACT."""
    n = EXACT
    s = np.full((n + 1, n + 1), -np.inf)
    s[0, 0] = 0.0
    for c in range(n):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            s[c + 1, 1 : c + 2] = np.logaddexp(s[c, : c + 1], np.log(np.maximum(c - t * d, 0)) + s[c, 1 : c + 2])
    return s


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of arguments of 50 and more."""
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


_GRID, _TERMS = 96, 96


@functools.cache
def _signed_binomials(d: float) -> np.ndarray:
    """(-1)**j C(t, j) / Gamma(-j d) for j (rows) from 1 and t from 1."""
    out = np.zeros((_TERMS, _GRID))
    for j in range(1, _TERMS + 1):
        x = j * d
        if abs(x - round(x)) > 1e-9:
            inverse = math.gamma(x + 1) * math.sin(math.pi * x) / -math.pi  # 1 / Gamma(-x)
            for t in range(j, _GRID + 1):
                out[j - 1, t - 1] = (-1) ** j * math.comb(t, j) * inverse
    return out


def _expected(c: np.ndarray, z: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the table count in the limit: z x (1-x)**(d-1) = c and t - 1 = z (1 - (1-x)**d) / d."""
    low, high = np.zeros(len(c)), np.full(len(c), 700.0)  # of -log(1 - x)
    target = np.log(c / z)
    for _ in range(60):
        y = (low + high) / 2
        less = np.log(-np.expm1(-y)) + (1 - d) * y < target
        low, high = np.where(less, y, low), np.where(less, high, y)
    y = (low + high) / 2
    rest = np.exp(-d * y)
    t = np.maximum(z * (1 - rest) / d, 1.0)
    g = d * np.exp(y * (1 - d)) / (1 - rest)  # derivative of log((1 - (1-x)**d) / d) in x
    x = -np.expm1(-y)
    curve = g * (1 - d) * np.exp(y) - g * g
    slope = 1 / t + x * g * g / (t * (g + x * curve))
    return t + 1, np.sqrt(1 / np.maximum(slope, 1e-12))


def draw_tables(c: np.ndarray, z: np.ndarray, d: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """Table counts of dishes with c customers, P(t) ~ S(c, t) z**t, by keys.

    Up to EXACT customers from the exact numbers; above, up to 32 expected tables, from their sum
    S(c, t) d**t t! = sum over j of (-1)**j C(t, j) (-j d)(-j d + 1)...(-j d + c - 1); beyond that from the normal limit.
    """
    t = np.minimum(c, 1).astype(np.int64)
    several = np.flatnonzero(c > 1)
    order = several[np.argsort(c[several], kind="stable")]
    bounds = np.searchsorted(c[order], np.arange(2, EXACT + 2))
    log_z = np.log(np.maximum(z, 1e-300))
    u = uniform(key, sweep, 0)
    exact = _stirling(d)
    for n in np.flatnonzero(np.diff(bounds)) + 2:
        at = order[bounds[n - 2] : bounds[n - 1]]
        for begin in range(0, len(at), max(1, (1 << 20) // int(n))):
            a = at[begin : begin + max(1, (1 << 20) // int(n))]
            p = exact[n, 1 : n + 1] + log_z[a, None] * np.arange(1, n + 1)
            p = np.exp(p - p.max(axis=1, keepdims=True)).cumsum(axis=1)
            t[a] = 1 + (p < u[a, None] * p[:, -1:]).sum(axis=1)
    large = order[bounds[-1] :]
    if len(large):
        mean, deviation = _expected(c[large].astype(float), np.maximum(z[large], 1e-300), d)
        t[large] = np.clip(np.round(mean + deviation * normal(key[large], sweep, 1)), 1, c[large]).astype(np.int64)
        few = large[mean < 32]
        for begin in range(0, len(few), 4096):
            a = few[begin : begin + 4096]
            j, k = np.arange(1, _TERMS + 1), np.arange(1, _GRID + 1)
            n = c[a].astype(float)[:, None]
            low = np.maximum(n - j * d, 50.0)
            ratio = np.exp(_log_gamma(low) - _log_gamma(n - d))
            sums = np.maximum(ratio @ _signed_binomials(d), 0.0)
            log_p = k * (log_z[a, None] - math.log(d)) - np.cumsum(np.log(k))
            p = (sums * np.exp(log_p - log_p.max(axis=1, keepdims=True))).cumsum(axis=1)
            t[a] = 1 + (p < u[a, None] * p[:, -1:]).sum(axis=1)
    return t


def root_draws(word: np.ndarray, customers: np.ndarray, tables: int, words: int, sweep: int) -> tuple[np.ndarray, np.ndarray]:
    """(tables, weights in units of 2**-20) of words in the root, given their customers and the tables of the state before."""
    if sweep:
        x = gamma(np.array([_HOT_KEY]), np.array([ROOT_STRENGTH / ROOT_DISCOUNT + tables]), sweep)[0]
        t = draw_tables(customers, np.full(len(word), ROOT_DISCOUNT * x / (words + 1)), ROOT_DISCOUNT, word, sweep)
    else:
        t = np.minimum(customers, 1)
    weight = np.zeros(len(word), np.int64)
    some = customers > 0
    weight[some] = np.maximum(1, np.round(gamma(word[some], customers[some] - ROOT_DISCOUNT * t[some], sweep) * (1 << 20))).astype(np.int64)
    return t, weight


# exchanges


def _census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task: the numbers of training tokens and of all (key -1), frequent contexts (key -2); of the first tasks also words that repeat in a window (key -3)."""
    from pyspark import TaskContext

    context, total, whole, repeated = TaskContext.get(), 0, 0, []
    contexts, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        raw, off = K.text_buffers(batch.column("text"))
        train = ~held_out_rows(batch.column("doc_id").to_pylist())
        for i, j in K.windows(off):
            w, u, doc = places(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            if len(repeated) < 4 and (context is None or context.partitionId() < 64):
                repeated.append(np.unique(w, return_counts=True))
            total += int(train[i:j][doc].sum())
            whole += len(w)
            slot = (u >> _U(48)).astype(np.int64)  # contexts of well-filled slots alone are counted
            full = np.bincount(slot, minlength=1 << 16)[slot] >= max(8, len(u) // (4 * HOT))
            v, n = np.unique(u[full], return_counts=True)
            v, inverse = np.unique(np.concatenate([contexts, v]), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([counts, n])).astype(np.int64)
            if len(v) > 8 * HOT:
                keep = np.sort(np.argsort(-n, kind="stable")[: 4 * HOT])
                v, n = v[keep], n[keep]
            contexts, counts = v, n
    rows = [(-1, blobs.pack(np.array([total, whole]))), (-2, blobs.pack(contexts, counts))]
    if repeated:
        v, n = _most(repeated, COMMON)
        rows.append((-3, blobs.pack(v[n > 1], n[n > 1])))
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["key", "data"])


def _most(got: list, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the largest sums of counts, in order."""
    v, inverse = np.unique(np.concatenate([x[0] for x in got]), return_inverse=True)
    n = np.bincount(inverse, weights=np.concatenate([x[1] for x in got]), minlength=len(v)).astype(np.int64)
    keep = np.sort(np.argsort(-n, kind="stable")[:most])
    return v[keep], n[keep]


def _census_sum(group: pd.DataFrame) -> pd.DataFrame:
    got, key = [blobs.unpack(x) for x in group["data"]], int(group["key"].iloc[0])
    if key == -1:
        return pd.DataFrame({"key": [key], "data": [blobs.pack(sum(x[0] for x in got))]})
    return pd.DataFrame({"key": [key], "data": [blobs.pack(*_most(got, 4 * HOT if key == -2 else COMMON))]})


def _slice_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Slices follow the order of keys."""
    return ((keys >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def _pair_keys(word: np.ndarray, u: np.ndarray) -> np.ndarray:
    return K.mix64(word + u * _U(0xD6E8FEB86659FD93))


def _named(words: np.ndarray, common: np.ndarray) -> list[np.ndarray]:
    """Sorted words as numbers of common ones and the rest."""
    place = np.minimum(np.searchsorted(common, words), max(0, len(common) - 1))
    known = common[place] == words if len(common) else np.zeros(len(words), dtype=bool)
    return [blobs.delta(place[known].astype(np.uint16)), blobs.delta(words[~known])]


def _words_of(number: np.ndarray, rest: np.ndarray, common: np.ndarray) -> np.ndarray:
    return np.sort(np.concatenate([common[blobs.undelta(number)] if len(number) else np.zeros(0, np.uint64), blobs.undelta(rest)]))


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint16 if len(x) == 0 or x.max() < 1 << 16 else np.uint32)


def _exchange(parts: int, hot: np.ndarray, common: np.ndarray):
    """Places by part. A blob has: contexts, distinct pairs of each, their words as indices, the words (common ones, others), places of each pair, document indices of places and training marks; one blob of each flush also what documents are."""

    def flush(w: np.ndarray, u: np.ndarray, doc: np.ndarray, source: int, docs: list) -> pa.RecordBatch:
        part = _slice_of(u, parts)
        if len(hot):
            warm = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, u), len(hot) - 1)] == u)
            part[warm] = (_pair_keys(w[warm], u[warm]) % _U(parts)).astype(np.int64)
        part = part.astype(np.uint16 if parts < 1 << 16 else np.uint32)
        order = np.argsort(part, kind="stable")
        cut = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
        del part
        ids = np.array([0 if x is None else x for x in docs], np.int64)
        null = np.array([x is None for x in docs], np.uint8)
        train = (~held_out_rows(docs)).astype(np.uint8)
        tokens = np.bincount(doc, minlength=len(docs)).astype(np.uint32)
        rows = []
        for k in range(parts):
            mine = order[cut[k] : cut[k + 1]]
            first = k == source % parts
            if len(mine) == 0 and not first:
                continue
            words, which = np.unique(w[mine], return_inverse=True)
            mine_u, mine_doc = u[mine], doc[mine]
            by = np.lexsort((which, mine_u))
            which, mine_u, mine_doc = which[by], mine_u[by], mine_doc[by]
            new = np.ones(len(by), dtype=bool)
            new[1:] = (mine_u[1:] != mine_u[:-1]) | (which[1:] != which[:-1])
            pairs = np.flatnonzero(new)
            contexts = K.runs(mine_u[pairs])
            body = [blobs.delta(mine_u[pairs[contexts]]), _small(np.diff(np.append(contexts, len(pairs)))), _small(which[pairs]), *_named(words, common), _small(np.diff(np.append(pairs, len(by)))), _small(mine_doc), train]
            if first:
                body += [blobs.delta(ids), null, tokens]
            rows.append((k, source, blobs.pack(*body)))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "source", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        source = (context.partitionId() if context else 0) << 32
        room = FLUSH + K.WINDOW
        w, u, doc = np.empty(room, np.uint64), np.empty(room, np.uint64), np.empty(room, np.int32)
        held, docs = 0, []
        for batch in batches:
            raw, off = K.text_buffers(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for i, j in K.windows(off):
                ww, uu, dd = places(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                if held and held + len(ww) > FLUSH:
                    yield flush(w[:held], u[:held], doc[:held], source, docs)
                    held, docs, source = 0, [], source + 1
                if held + len(ww) > len(w):  # one text longer than all the room
                    w, u, doc = (np.resize(x, held + len(ww)) for x in (w, u, doc))
                w[held : held + len(ww)], u[held : held + len(ww)], doc[held : held + len(ww)] = ww, uu, dd + len(docs)
                docs += ids[i:j]
                held += len(ww)
        if docs:
            yield flush(w[:held], u[:held], doc[:held], source, docs)

    return run


class Part:
    """The places of one part: distinct words and contexts, distinct pairs in order, the pair of each place."""

    def __init__(self, group: pd.DataFrame, common: np.ndarray):
        group = group.sort_values("source")
        self.docs, self.source, self.size, self.extra = [], [], [], []
        u_lists, u_runs, w_lists, w_index, counts, train = [], [], [], [], [], []
        listed = 0
        for src, data in zip(group["source"], group["data"], strict=True):
            b = blobs.unpack(data)
            u_lists.append(blobs.undelta(b[0]))
            u_runs.append(b[1].astype(np.int64))
            w_index.append(b[2].astype(np.int64) + listed)
            w_lists.append(_words_of(b[3], b[4], common))
            listed += len(w_lists[-1])
            counts.append(b[5].astype(np.int64))
            self.docs.append(b[6])
            train.append(b[7][b[6]].astype(bool))
            self.source.append(int(src))
            self.size.append(len(b[7]))
            self.extra.append(b[8:])
        self.words, which = np.unique(np.concatenate(w_lists), return_inverse=True)
        w = which[np.concatenate(w_index)]
        self.contexts, which = np.unique(np.concatenate(u_lists), return_inverse=True)
        u = np.repeat(which, np.concatenate(u_runs))
        n = max(1, len(self.words))
        order, key = K.in_order((u * n + w).astype(np.uint64))
        begin = K.runs(key)
        size = np.diff(np.append(begin, len(key)))
        pair = np.empty(len(key), np.int32)
        pair[order] = np.repeat(np.arange(len(begin), dtype=np.int32), size)
        self.pair = np.repeat(pair, np.concatenate(counts))
        key = key[begin].astype(np.int64)
        self.u, self.w = key // n, key % n
        self.c = np.bincount(self.pair[np.concatenate(train)], minlength=len(key))


def _hot_of(contexts: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Numbers of the contexts that are hot."""
    return np.flatnonzero(np.isin(contexts, hot))


class Shared:
    """The keys of a part, by slice: its words, and its hot contexts under keys of their own."""

    def __init__(self, words: np.ndarray, contexts: np.ndarray, hot: np.ndarray, parts: int):
        self.hot = _hot_of(contexts, hot)
        keys = np.concatenate([words, K.mix64(contexts[self.hot] ^ _HOT_KEY)])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.is_word = self.order < len(words)
        self.cut = np.searchsorted(_slice_of(self.keys, parts), np.arange(parts + 1))


def _first(parts: int, hot: np.ndarray, common: np.ndarray):
    """Of one part: customers and distinct pairs of its keys, by slice."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        me = int(group["part"].iloc[0])
        p = Part(group, common)
        seen = p.c > 0
        u, w, c = p.u[seen], p.w[seen], p.c[seen]
        sh = Shared(p.words, p.contexts, hot, parts)
        customers = _own_keys(sh, u, w, c, len(p.contexts), len(p.words))
        tables = _own_keys(sh, u, w, np.ones(len(u)), len(p.contexts), len(p.words))
        rows = [(k, me, blobs.pack(blobs.delta(sh.keys[a:b]), _small(customers[a:b]), _small(tables[a:b]), sh.is_word[a:b].astype(np.uint8))) for k, (a, b) in enumerate(zip(sh.cut[:-1], sh.cut[1:], strict=True))]
        K.trim()
        return pd.DataFrame(rows, columns=["key", "part", "data"])

    return run


def _own_pairs(common: np.ndarray):
    """Of one part: its words, contexts and training pairs, for its sweeps."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        p = Part(group, common)
        seen = p.c > 0
        data = blobs.pack(blobs.delta(p.contexts), blobs.delta(p.words), _small(np.bincount(p.u[seen], minlength=len(p.contexts))), _small(p.w[seen]), _small(p.c[seen]))
        out = pd.DataFrame({"part": [int(group["part"].iloc[0])], "source": [-1], "data": [data]})
        del p
        K.trim()
        return out

    return run


def _first_answer(parts: int):
    """Of one slice: which keys of each part others have too, their sums, and sums over the slice."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        key = int(group["key"].iloc[0])
        got = [blobs.unpack(x) for x in group["data"]]
        lists = [blobs.undelta(b[0]) for b in got]
        keys, which = np.unique(np.concatenate(lists), return_inverse=True)
        n, held = len(keys), np.bincount(which)
        customers = np.bincount(which, weights=np.concatenate([b[1] for b in got]), minlength=n).astype(np.int64)
        tables = np.bincount(which, weights=np.concatenate([b[2] for b in got]), minlength=n).astype(np.int64)
        word = np.zeros(n, dtype=bool)
        word[which] = np.concatenate([b[3] for b in got]) > 0
        known = word & (customers > 0)
        t, weight = root_draws(keys[known], tables[known], 0, 0, 0)
        sums = np.array([known.sum(), customers[known].sum(), tables[known].sum(), t.sum(), weight.sum()], np.int64)
        rows, at = [], 0
        for part, mine in zip(group["part"], lists, strict=True):
            k = which[at : at + len(mine)]
            at += len(mine)
            several = held[k] > 1
            rows.append((part, key, blobs.pack(sums, several.astype(np.uint8), _small(customers[k][several]), _small(tables[k][several]))))
        return pd.DataFrame(rows, columns=["part", "source", "data"])

    return run


class State:
    """What a part knows of the root after a sweep, for each of its words; and tables of hot contexts."""

    def __init__(self, sh: Shared, n_words: int):
        self.sh, self.n_words = sh, n_words

    def take(self, customers: np.ndarray, tables: np.ndarray, sums: np.ndarray) -> None:
        """Numbers by key in the order of ``sh.keys``."""
        back = np.empty(len(self.sh.order), np.int64)
        back[self.sh.order] = customers
        self.customers, self.hot_tables = back[: self.n_words], back[self.n_words :]
        back = np.empty(len(self.sh.order), np.int64)
        back[self.sh.order] = tables
        self.tables = back[: self.n_words]
        self.all_customers, self.all_tables, self.all_weights = (int(x) for x in sums)


def _first_state(rows: pd.DataFrame, sh: Shared, own: np.ndarray, own_tables: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, int, int, State]:
    """(which keys others have, customers by key, V, N, the state before the first sweep)."""
    several, customers, tables, sums = np.zeros(len(sh.keys), dtype=bool), own.copy(), own_tables.copy(), np.zeros(5, np.int64)
    for k, data in zip(rows["source"], rows["data"], strict=True):
        if k >= 0:
            a, b = sh.cut[k], sh.cut[k + 1]
            s, held, c, t = blobs.unpack(data)
            held = held > 0
            sums += s
            several[a:b] = held
            customers[a:b][held], tables[a:b][held] = c, t
    state = State(sh, n_words)
    state.take(tables, np.minimum(tables, 1), sums[2:])
    return several, customers, int(sums[0]), int(sums[1]), state


def _received(rows: pd.DataFrame, sh: Shared, several: np.ndarray, own: np.ndarray, before: int, words: int, sweep: int, state: State) -> None:
    """The state after a sweep: sums of keys that others have too, and own numbers of the rest."""
    customers, tables, sums = own.copy(), np.zeros(len(own), np.int64), np.zeros(3, np.int64)
    for k, data in zip(rows["source"], rows["data"], strict=True):
        if k >= 0:
            a, b = sh.cut[k], sh.cut[k + 1]
            s, c, t = blobs.unpack(data)
            sums += s
            held = several[a:b]
            customers[a:b][held], tables[a:b][held] = c, t
    alone = np.flatnonzero(~several & sh.is_word)
    tables[alone] = root_draws(sh.keys[alone], customers[alone], before, words, sweep)[0]
    state.take(customers, tables, sums)


def _own_keys(sh: Shared, u: np.ndarray, w: np.ndarray, t: np.ndarray, n_contexts: int, n_words: int) -> np.ndarray:
    """Sums of a number of pairs by key."""
    return np.concatenate([np.bincount(w, weights=t, minlength=n_words), np.bincount(u, weights=t, minlength=n_contexts)[sh.hot]])[sh.order].astype(np.int64)


def _tables_of_contexts(u: np.ndarray, t: np.ndarray, n_contexts: int, sh: Shared, hot_tables: np.ndarray) -> np.ndarray:
    out = np.bincount(u, weights=t, minlength=n_contexts)
    out[sh.hot] = hot_tables
    return out


def sweep_tables(pair_keys: np.ndarray, u: np.ndarray, c: np.ndarray, context_keys: np.ndarray, tables_of: np.ndarray, weight: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of pairs after a sweep, from the tables of contexts before and the root's weights of the pairs' words."""
    x = gamma(context_keys, STRENGTH / DISCOUNT + tables_of, sweep)
    return draw_tables(c, DISCOUNT * x[u] * weight, DISCOUNT, pair_keys, sweep)


def root_weights(word: np.ndarray, customers: np.ndarray, tables: np.ndarray, all_tables: int, all_weights: int, words: int, sweep: int) -> np.ndarray:
    """G(w) of words in the state after a sweep."""
    weight = np.zeros(len(word))
    some = customers > 0
    weight[some] = np.maximum(1, np.round(gamma(word[some], customers[some] - ROOT_DISCOUNT * tables[some], sweep) * (1 << 20)))
    new = gamma(np.array([_HOT_KEY ^ _U(1)]), np.array([ROOT_STRENGTH + ROOT_DISCOUNT * all_tables]), sweep)[0] * (1 << 20)
    return (weight + new / (words + 1)) / (all_weights + new)


def _sweep(parts: int, hot: np.ndarray, sweep: int):
    """Of one part: a sweep over its pairs; sums of shared keys by slice, and for itself its tables."""

    def run(first: pd.DataFrame, last: pd.DataFrame) -> pd.DataFrame:
        if len(first) == 0:
            return pd.DataFrame({"key": [], "part": [], "data": []})
        me = int(first["part"].iloc[0])
        contexts, words, runs, w, c = blobs.unpack(first["data"][first["source"] == -1].iloc[0])
        contexts, words, w, c = blobs.undelta(contexts), blobs.undelta(words), w.astype(np.int64), c.astype(np.int64)
        u = np.repeat(np.arange(len(contexts)), runs)
        sh = Shared(words, contexts, hot, parts)
        several, _, n_words, _, state = _first_state(first, sh, _own_keys(sh, u, w, c, len(contexts), len(words)), _own_keys(sh, u, w, np.ones(len(u)), len(contexts), len(words)), len(words))
        t = np.minimum(c, 1)
        if sweep > 1:
            own = last["data"][last["source"] == -1].iloc[0]
            t, before = (x.astype(np.int64) for x in blobs.unpack(own))
            _received(last, sh, several, _own_keys(sh, u, w, t, len(contexts), len(words)), int(before[0]), n_words, sweep - 1, state)
        weight = root_weights(words, state.customers, state.tables, state.all_tables, state.all_weights, n_words, sweep - 1)
        tables_of = _tables_of_contexts(u, t, len(contexts), sh, state.hot_tables)
        t = sweep_tables(_pair_keys(words[w], contexts[u]), u, c, contexts, tables_of, weight[w], sweep)
        own = _own_keys(sh, u, w, t, len(contexts), len(words))
        alone = np.flatnonzero(~several & sh.is_word)
        root, weights = root_draws(sh.keys[alone], own[alone], state.all_tables, n_words, sweep)
        private, nothing = np.array([own[alone].sum(), root.sum(), weights.sum()], np.int64), np.zeros(3, np.int64)
        told = np.array([state.all_tables, n_words], np.int64)
        rows = []
        for k, (a, b) in enumerate(zip(sh.cut[:-1], sh.cut[1:], strict=True)):
            held = several[a:b]
            rows.append((k, me, blobs.pack(private if k == me else nothing, told, blobs.delta(sh.keys[a:b][held]), _small(own[a:b][held]), sh.is_word[a:b][held].astype(np.uint8))))
        rows.append((parts + me, me, blobs.pack(_small(t), told[:1])))
        K.trim()
        return pd.DataFrame(rows, columns=["key", "part", "data"])

    return run


def _sweep_answer(parts: int, sweep: int):
    """Of one slice: the sums of each part's keys, the root's tables drawn for them, and sums over the slice."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        key = int(group["key"].iloc[0])
        if key >= parts:
            return pd.DataFrame({"part": group["part"], "source": -1, "data": group["data"]})
        got = [blobs.unpack(x) for x in group["data"]]
        lists = [blobs.undelta(b[2]) for b in got]
        keys, which = np.unique(np.concatenate(lists), return_inverse=True)
        customers = np.bincount(which, weights=np.concatenate([b[3] for b in got]), minlength=len(keys)).astype(np.int64)
        word = np.zeros(len(keys), dtype=bool)
        word[which] = np.concatenate([b[4] for b in got]) > 0
        before, n_words = (int(x) for x in got[0][1])
        tables = np.zeros(len(keys), np.int64)
        tables[word], weight = root_draws(keys[word], customers[word], before, n_words, sweep)
        sums = np.array([customers[word].sum(), tables.sum(), weight.sum()], np.int64) + sum(b[0] for b in got)
        rows, at = [], 0
        for part, mine in zip(group["part"], lists, strict=True):
            k = which[at : at + len(mine)]
            at += len(mine)
            rows.append((part, key, blobs.pack(sums, _small(customers[k]), _small(tables[k]))))
        return pd.DataFrame(rows, columns=["part", "source", "data"])

    return run


def root_mean(customers, tables, all_customers: int, all_tables: int, words: int):
    """P(w) of words in the root."""
    return (customers - ROOT_DISCOUNT * tables + (ROOT_STRENGTH + ROOT_DISCOUNT * all_tables) / (words + 1)) / (ROOT_STRENGTH + all_customers)


def below(c, t, tables_of, customers_of, p):
    """P(w | u) by the pair's customers and tables, the context's tables and customers, and P(w)."""
    return (c - DISCOUNT * t + (STRENGTH + DISCOUNT * tables_of) * p) / (STRENGTH + customers_of)


def _score(parts: int, hot: np.ndarray, common: np.ndarray):
    """Of one part: for each source, sums over its documents of log10(c + 0.5), log10 P and known tokens, and N and V."""

    def run(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if len(group) == 0:
            return pd.DataFrame({"source": [], "data": []})
        p = Part(group, common)
        seen = np.flatnonzero(p.c > 0)
        u, w, c = p.u[seen], p.w[seen], p.c[seen]
        sh = Shared(p.words, p.contexts, hot, parts)
        size = len(p.contexts), len(p.words)
        first = answers[answers["sweep"] == 0]
        several, customers, n_words, tokens, state = _first_state(first, sh, _own_keys(sh, u, w, c, *size), _own_keys(sh, u, w, np.ones(len(u)), *size), size[1])
        back = np.empty(len(sh.order), np.int64)
        back[sh.order] = customers
        known, customers_of = back[: size[1]], np.bincount(u, weights=c, minlength=size[0])
        customers_of[sh.hot] = back[size[1] :]
        total = np.zeros(len(p.c))
        for sweep in sorted(x for x in answers["sweep"].unique() if x):
            rows = answers[answers["sweep"] == sweep]
            t, before = (x.astype(np.int64) for x in blobs.unpack(rows["data"][rows["source"] == -1].iloc[0]))
            _received(rows, sh, several, _own_keys(sh, u, w, t, *size), int(before[0]), n_words, int(sweep), state)
            mean = root_mean(state.customers, state.tables, state.all_customers, state.all_tables, n_words)
            tables_of = _tables_of_contexts(u, t, size[0], sh, state.hot_tables)
            tables = np.zeros(len(p.c))
            tables[seen] = t
            total += below(p.c, tables, tables_of[p.u], customers_of[p.u], mean[p.w])
        log_p = np.round(np.log10(total / SAMPLES) * SCALE)
        log_c = np.round(np.log10(known + 0.5) * SCALE)[p.w]
        is_known = (known > 0)[p.w]
        rows, at = [], 0
        for d, src, n, info in zip(p.docs, p.source, p.size, p.extra, strict=True):
            mine = p.pair[at : at + len(d)]
            at += len(d)
            sums = [np.bincount(d, weights=x[mine], minlength=n) for x in (log_c, log_p, is_known)]
            rows.append((src, blobs.pack(*(-x.astype(np.int64) for x in sums[:2]), _small(sums[2].astype(np.int64)), np.array([tokens, n_words], np.int64), *info)))
        K.trim()
        return pd.DataFrame(rows, columns=["source", "data"])

    return run


def _finish(group: pd.DataFrame) -> pd.DataFrame:
    sums, info = None, None
    for data in group.sort_values("data")["data"]:
        b = blobs.unpack(data)
        mine = [x.astype(np.int64) for x in b[:3]]
        sums = mine if sums is None else [a + x for a, x in zip(sums, mine, strict=True)]
        tokens, words = (int(x) for x in b[3])
        if len(b) > 4:
            info = b[4:]
    ids, null, n = blobs.undelta(info[0]), info[1].astype(bool), info[2].astype(np.int64)
    doc_id = pd.array(ids, dtype="Int64")
    doc_id[null] = pd.NA
    held = held_out_rows([None if z else int(x) for x, z in zip(ids, null, strict=True)])
    base = -sums[0] / SCALE - n * np.log10(tokens + 0.5 * (words + 1))
    return pd.DataFrame({"doc_id": doc_id, "held_out": held, "n_tokens": n, "n_known": sums[2].astype(np.int64), "train_tokens": tokens, "base_score": base, "score": -sums[1] / SCALE})


def score_texts(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text).

    There are as many parts (and slices of keys) as the tokens ask for, unless ``parts`` says how many.
    """
    docs = docs.select("doc_id", "text")
    census = {r.key: blobs.unpack(bytes(r.data)) for r in docs.mapInArrow(_census, "key int, data binary").groupBy("key").applyInPandas(_census_sum, "key int, data binary").collect()}
    tokens, whole = (int(x) for x in census[-1][0]) if -1 in census else (0, 0)
    if parts is None:
        parts = max(min(FEW_PARTS, K.hot_conf(docs.sparkSession)), -(-whole // PART_TOKENS))
    frequent = census.get(-2, [np.zeros(0, np.uint64), np.zeros(0, np.int64)])
    hot = np.sort(frequent[0][frequent[1] * HOT >= tokens])[: 4 * HOT] if tokens else np.zeros(0, np.uint64)
    common = census[-3][0] if -3 in census else np.zeros(0, np.uint64)
    told, answered = "key int, part int, data binary", "part int, source int, data binary"
    placed = docs.mapInArrow(K.tidy(_exchange(parts, hot, common)), "part int, source long, data binary").groupBy("part")
    sums = placed.applyInPandas(_first(parts, hot, common), told).groupBy("key").applyInPandas(_first_answer(parts), answered)
    first = sums.union(placed.applyInPandas(_own_pairs(common), answered))
    last, sampled = sums, sums.withColumn("sweep", F.lit(0))
    for sweep in range(1, BURN_IN + SAMPLES + 1):
        swept = first.groupBy("part").cogroup(last.groupBy("part")).applyInPandas(_sweep(parts, hot, sweep), told)
        last = swept.groupBy("key").applyInPandas(_sweep_answer(parts, sweep), answered)
        if sweep > BURN_IN:
            sampled = sampled.union(last.withColumn("sweep", F.lit(sweep)))
    scored = placed.cogroup(sampled.groupBy("part")).applyInPandas(_score(parts, hot, common), "source long, data binary")
    return scored.groupBy("source").applyInPandas(_finish, SCHEMA)
