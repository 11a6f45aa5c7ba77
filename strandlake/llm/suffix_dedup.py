"""Removal of repeated passages by prefix-free parsing.

A passage is any string of ``LENGTH`` bytes ("gram") that also starts in a
document of a smaller doc_id; every byte it covers goes.  Results are exact up
to collisions of 64-bit hashes.

*Where a gram belongs.*  A rolling hash looks at every ``TRIGGER`` bytes; the
smallest hash inside a gram is the gram's trigger, a function of the gram's bytes
alone.  Neighbouring grams of one trigger form a *string*, so each text becomes a
sequence of overlapping strings, cut alike wherever the same bytes stand.

1. *Repeated triggers.*  Fingerprints of all triggers meet, by fingerprint; those
   of two or more documents go back to the batches of documents that hold them.  A
   gram whose trigger is in one document only is in one document only.
2. *Corpus order.*  Each batch sends its distinct strings with a repeated trigger,
   each with the smallest doc_id it has there, to the part of the trigger.  A part parses its
   strings prefix-free: an inner rolling hash cuts them into phrases, each of which
   ends with the bytes the next begins with.  The suffix array of the distinct
   phrases (the dictionary) and that of the parse combine into the order of
   all suffixes of the part (``corpus_order``); equal grams are neighbours there.  Equal
   grams of the corpus have one trigger, so the parts' orders one after the other put them side by side.
   The smallest doc_id of each gram goes back to the batches.
3. *Removal.*  Each batch parses its texts again and looks its strings up: a
   gram is removed in documents above its smallest doc_id.

A trigger that more than ``HEAVY`` strings have is split: its grams are sent one by one, each to the
part of its own hash.  Batches are hashes of doc_id; the numbers of batches and parts follow the
bytes of the table, so memory does not grow with it.  Texts are exchanged once (both passes over a
batch read one exchange).  Copies and common passages count once a batch before any
shuffle, so no key's occurrences meet in one task, and no pairs are formed.

Nulls and empties: a null text counts as empty; texts shorter than a gram stay
as they are.  A row with a null doc_id has no order: it stays whole and removes
nothing elsewhere.  Rows of equal doc_id don't remove from each other.  An empty table gives no
rows.  A long text is a batch of its own.  Extra columns pass through;
those named like results are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blobs
from . import kernels as K

LENGTH = 50
TRIGGER = 24
RESULTS = ("n_bytes", "n_removed", "n_spans", "kept")
#: Bytes of text a batch, bytes of strings a part, strings of one trigger that still meet in one part.
BATCH_BYTES = 8 << 20
PART_BYTES = 8 << 20
HEAVY = 50_000
#: Bytes that a trigger of the inner parse covers, and the mask that its hash must miss.
INNER, INNER_MASK = 8, 31
_FLUSH = 3_000_000
_SHIFT = np.uint64(20)


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a little-endian number; zeros follow the end."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw),), "<u8", padded, 0, (1,)).copy()


def triggers(raw: np.ndarray) -> np.ndarray:
    """The smallest hash of TRIGGER bytes inside the gram at each place."""
    w = _words(raw)
    n = len(raw) - TRIGGER + 1
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h += w[8 : n + 8]
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h += w[16 : n + 16]
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    width = LENGTH - TRIGGER + 1
    step = 1
    while 2 * step <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    if width > step:
        h = np.minimum(h[: len(h) - (width - step)], h[width - step :])
    return h


def parse(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of a window: (first gram, number of grams, trigger, document index)."""
    empty = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return empty, empty, np.zeros(0, np.uint64), empty
    t = triggers(raw)
    n = len(t)
    edge = np.empty(n, dtype=bool)
    edge[0] = True
    np.not_equal(t[1:], t[:-1], out=edge[1:])
    size = np.diff(offsets)
    begin, end = offsets[:-1], offsets[1:] - LENGTH + 1
    long_ = size >= LENGTH
    begin, end = begin[long_], end[long_]
    edge[begin] = True
    stops = end[end < n]
    edge[stops] = True
    f = np.flatnonzero(edge)
    count = np.diff(np.append(f, n))
    doc = np.searchsorted(offsets, f, side="right") - 1
    inside = f + LENGTH <= offsets[doc + 1]
    f, count, doc = f[inside], count[inside], doc[inside]
    count = np.minimum(count, offsets[doc + 1] - LENGTH + 1 - f)
    return f, count, t[f], doc


def _range_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    cs = np.zeros(len(raw) + 1, np.uint64)
    prod = raw.astype(np.uint64)
    prod += np.uint64(1)
    prod *= K.power_table(K._P, len(raw))
    np.cumsum(prod, out=cs[1:])
    h = (cs[last] - cs[first]) * K.power_table(K._PINV, len(raw))[first]
    return K.mix64(h + (last - first).astype(np.uint64))


def phrase_hashes(raw: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hashes of strings of ``count`` grams."""
    return _range_hashes(raw, first, first + count + LENGTH - 1)


def _ranked(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of keys, from 0."""
    order, sorted_ = K.in_order(keys)
    out = np.empty(len(keys), np.int64)
    step = np.zeros(len(keys), np.int64)
    step[1:] = sorted_[1:] != sorted_[:-1]
    out[order] = np.cumsum(step)
    return out


def _joined(rank: np.ndarray, at: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Keys of (own rank, rank at another place; 0 where there is none)."""
    key = rank.astype(np.uint64) << np.uint64(len(rank).bit_length())
    key[has] |= (rank[at[has]] + 1).astype(np.uint64)
    return key


def _dictionary_ranks(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Ranks of the dictionary's suffixes, each up to its phrase's end (``left`` bytes on) or a gram's depth: its suffix array, by doubling."""
    word = _words(text).byteswap() >> np.uint64(24)
    cut = np.maximum(5 - left, 0).astype(np.uint64) * np.uint64(8)
    word = word >> cut << cut
    rank = np.zeros(len(text), np.int64)
    tied = _split_ties(rank, np.arange(len(text)), word << np.uint64(3) | np.minimum(left, 5).astype(np.uint64), 64)
    depth = 5
    while depth < LENGTH and len(tied):
        more = left[tied] > depth
        second = np.zeros(len(tied), np.uint64)
        second[more] = (rank[tied[more] + depth] + 1).astype(np.uint64)
        tied = _split_ties(rank, tied, second, len(text).bit_length())
        depth *= 2
    return rank


def _split_ties(rank: np.ndarray, tied: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """Ranks (places of the first of equals) of tied suffixes by a second key of ``bits`` bits; gives those that are still tied."""
    key = second if bits == 64 else rank[tied].astype(np.uint64) << np.uint64(bits) | second
    order, key = K.in_order(key)
    n = len(key)
    new = np.ones(n + 1, dtype=bool)
    new[1:n] = key[1:] != key[:-1]
    first = np.maximum.accumulate(np.where(new[:n], np.arange(n), 0))
    old = np.zeros(n, np.int64) if bits == 64 else (key >> np.uint64(bits)).astype(np.int64)
    group = np.ones(n, dtype=bool)
    group[1:] = old[1:] != old[:-1]
    begin = np.maximum.accumulate(np.where(group, np.arange(n), 0))
    place = tied[order]
    rank[place] = old + first - begin
    return place[~(new[:n] & new[1:])]


def _parse_ranks(phrase: np.ndarray, begin: np.ndarray, string: np.ndarray) -> np.ndarray:
    """Ranks of the parse's suffixes, each up to its string's end or a gram's depth: its suffix array, by doubling."""
    n, span, place = len(phrase), 1, np.arange(len(phrase))
    rank = _ranked(phrase.astype(np.uint64))
    while True:
        has = np.zeros(n, dtype=bool)
        has[: n - span] = string[span:] == string[: n - span]
        short = has.copy()
        short[has] = begin[place[has] + span] - begin[has] < LENGTH
        if not short.any():
            return rank
        rank = _ranked(_joined(rank, place + span, has))
        span *= 2


def corpus_order(data: np.ndarray, size: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The order of the suffixes at ``places`` of strings of ``size`` bytes that follow one another in ``data``, to the depth of a gram.

    A suffix starts inside one phrase of the inner parse: the rank of that phrase's rest in the
    dictionary comes first, then the rank of the parse that follows it.  No phrase's rest is the
    beginning of another's, as each ends with the only trigger after its start.
    """
    n = len(data)
    end = np.cumsum(size)
    hash_ = _words(data) * np.uint64(0x9E3779B97F4A7C15)
    hash_ ^= hash_ >> np.uint64(32)
    edge = (hash_ & np.uint64(INNER_MASK)) == 0
    del hash_
    string_at = np.repeat(np.arange(len(size), dtype=np.int32), size)
    edge &= np.arange(n) + INNER <= end[string_at]
    edge[end - size] = True
    begin = np.flatnonzero(edge)
    string = string_at[begin]
    stop = end[string]
    inner = np.flatnonzero(string[1:] == string[:-1])
    stop[inner] = begin[inner + 1] + INNER
    h = np.concatenate([_range_hashes(data[begin[a] : stop[a:b].max()], begin[a:b] - begin[a], stop[a:b] - begin[a]) for a, b in _runs_of_bytes(begin, stop - begin)])
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    long_ = (stop - begin)[one]
    first = np.cumsum(long_) - long_
    text = data[K.ranges_concat(begin[one], long_)]
    rest = _dictionary_ranks(text, np.repeat(first + long_, long_) - np.arange(len(text)))
    follow = _parse_ranks(rest[first[which]], begin, string)
    at = np.searchsorted(begin, places, side="right") - 1
    key = rest[first[which[at]] + places - begin[at]].astype(np.uint64) << np.uint64(len(begin).bit_length())
    more = at + 1 < len(begin)
    more[more] = string[at[more] + 1] == string[at[more]]
    key[more] |= (follow[at[more] + 1] + 1).astype(np.uint64)
    return K.in_order(key)[0]


def smallest_owner(data: np.ndarray, count: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each gram of each string (of ``count`` grams, one after the other in ``data``), in turn, the smallest owner among all strings that hold it."""
    size = count + LENGTH - 1
    grams = K.ranges_concat(np.cumsum(size) - size, count)
    own = np.repeat(owner, count)
    if len(grams) == 0:
        return own
    order = corpus_order(data, size, grams)
    sorted_, new, w = grams[order], np.zeros(len(order), dtype=bool), _words(data)
    new[0] = True
    for at in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        k = w[sorted_ + at]
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    least = np.minimum.reduceat(own[order], at)
    out = np.empty(len(order), own.dtype)
    out[order] = np.repeat(least, np.diff(np.append(at, len(order))))
    return out


def _slices(keys: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of each value of sorted keys."""
    at = np.searchsorted(keys, np.arange(n + 1))
    for k in np.flatnonzero(np.diff(at)):
        yield int(k), int(at[k]), int(at[k + 1])


def _out(names: list[str], *columns: list) -> pa.RecordBatch:
    kinds = {"part": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.binary())) for n, c in zip(names, columns, strict=True)], names=names)


def _table(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([_out(["part", "data"], [r[0] for r in rows], [r[1] for r in rows])])


def _blobs(table: pa.Table) -> Iterator[list[np.ndarray]]:
    for x in table.column("data"):
        yield blobs.unpack(x.as_py())


def _batch_of(batch: pa.RecordBatch, raw: np.ndarray, off: np.ndarray, batches: int) -> np.ndarray:
    """The batch of each row: by doc_id, or by the text where that is null."""
    ids = np.asarray(batch.column("doc_id").fill_null(0).cast(pa.int64())).astype(np.uint64)
    null = np.flatnonzero(np.asarray(batch.column("doc_id").is_null()))
    if len(null):
        ids = ids.copy()
        ids[null] = [zlib.crc32(raw[off[k] : off[k + 1]]) for k in null]
    return (K.mix64(ids + np.uint64(0x51ED270B)) % np.uint64(batches)).astype(np.int64)


def _to_batches(batches: int):
    """Rows packed by batch."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            where = _batch_of(batch, *K.text_buffers(batch.column("text")), batches)
            order = np.argsort(where, kind="stable")
            sorted_ = batch.take(pa.array(order))
            part, data = [], []
            for k, a, b in _slices(where[order], batches):
                part.append(k)
                data.append(blobs.pack_rows(sorted_.slice(a, b - a)))
            yield _out(["part", "data"], part, data)

    return run


def _fingerprints(batches: int, parts: int):
    """Triggers by part: fingerprint, batch * 2 + (in several documents), and strings less one (an estimate, 266 at most)."""

    def flush(fps: list, docs: list, where: list, kinds: list) -> pa.RecordBatch:
        fp, doc, at, kind = np.concatenate(fps), np.concatenate(docs), np.concatenate(where), np.concatenate(kinds)
        order = np.lexsort((at, fp))  # stable: documents stay in order
        fp, doc, at, kind = fp[order], doc[order], at[order], kind[order]
        new = np.ones(len(fp), dtype=bool)
        new[1:] = (fp[1:] != fp[:-1]) | (at[1:] != at[:-1])
        begin = np.flatnonzero(new)
        several = doc[np.append(begin[1:], len(fp)) - 1] != doc[begin]
        seen = np.bitwise_count(np.bitwise_or.reduceat(np.uint64(1) << kind.astype(np.uint64), begin))
        strings = np.round(64 * np.log(64 / np.maximum(64.0 - seen, 1.0))).astype(np.int64)
        fp, at, more = fp[begin], at[begin] * 2 + several, np.maximum(strings - 1, 0).astype(np.uint16)
        part = (fp % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        fp, at, more, part = fp[order], at[order], more[order], part[order]
        rows = [(k, blobs.pack(blobs.delta(fp[a:b]), at[a:b].astype(np.uint32), more[a:b])) for k, a, b in _slices(part, parts)]
        return _out(["part", "data"], [r[0] for r in rows], [r[1] for r in rows])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, base, size = [], 0, 0
        for batch in rows:
            raw, off = K.text_buffers(batch.column("text"))
            at = _batch_of(batch, raw, off, batches)
            null = np.asarray(batch.column("doc_id").is_null())
            for i, j in K.windows(off):
                r = raw[off[i] : off[j]]
                f, count, t, doc = parse(r, off[i : j + 1] - off[i])
                if null[i:j].any():
                    keep = ~null[i:j][doc]
                    f, count, t, doc = f[keep], count[keep], t[keep], doc[keep]
                if len(f) == 0:
                    continue
                w = _words(r)
                kind = K.mix64(w[f] ^ (w[f + count + LENGTH - 9] * np.uint64(3))) >> np.uint64(58)
                held.append((t >> _SHIFT, (doc + (base + i)).astype(np.int64), at[i + doc].astype(np.int32), kind.astype(np.uint8)))
                size += len(t)
                if size > _FLUSH:
                    yield flush(*map(list, zip(*held, strict=True)))
                    held, size = [], 0
            base += len(at)
        if held:
            yield flush(*map(list, zip(*held, strict=True)))

    return run


def _repeated(heavy: int):
    """Of one part: the repeated fingerprints, for each batch that holds them, and whether more than ``heavy`` strings have them."""

    def run(table: pa.Table) -> pa.Table:
        got = list(_blobs(table))
        fp = np.concatenate([blobs.undelta(x[0]) for x in got])
        at = np.concatenate([x[1] for x in got])
        strings = np.concatenate([x[2] for x in got])
        order = np.argsort(fp, kind="stable")
        fp, at, strings = fp[order], at[order], strings[order].astype(np.int64) + 1
        begin = K.runs(fp)
        size = np.diff(np.append(begin, len(fp)))
        several = np.repeat((size > 1) | (np.maximum.reduceat(at & 1, begin) > 0), size)
        split = np.repeat(np.add.reduceat(strings, begin) > heavy, size)
        fp, at, split = fp[several], (at[several] >> 1).astype(np.int64), split[several]
        order = np.lexsort((fp, at))
        fp, at, split = fp[order], at[order], split[order].astype(np.uint8)
        return _table([(k, blobs.pack(blobs.delta(fp[a:b]), split[a:b])) for k, a, b in _slices(at, int(at.max()) + 1 if len(at) else 0)])

    return run


def _documents(table: pa.Table) -> pa.Table:
    """The documents of a batch in an order that does not depend on the tasks that sent them."""
    return pa.concat_tables([blobs.unpack_rows(x.as_py()) for x in table.column("data")]).combine_chunks().sort_by("doc_id")


def _doc_ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table.column("doc_id").combine_chunks().cast(pa.int64())
    return np.asarray(column.fill_null(0)), np.asarray(column.is_null())


def _phrases(parts: int):
    """Of one batch: its distinct strings with a repeated trigger, by part; grams one by one where the trigger is heavy."""

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if texts.num_rows == 0 or replies.num_rows == 0:
            return _table([])
        me = np.array([texts.column("part")[0].as_py()], np.int32)
        got = list(_blobs(replies))
        repeated, heavy = np.concatenate([blobs.undelta(x[0]) for x in got]), np.concatenate([x[1] for x in got])
        order = np.argsort(repeated)
        repeated, heavy = repeated[order], heavy[order] > 0
        table = _documents(texts)
        ids, null = _doc_ids(table)
        raw, off = K.text_buffers(table.column("text"))
        found: list[tuple] = []
        for i, j in K.windows(off):
            r = raw[off[i] : off[j]]
            f, count, t, doc = parse(r, off[i : j + 1] - off[i])
            fp = t >> _SHIFT
            place = np.minimum(np.searchsorted(repeated, fp), len(repeated) - 1)
            keep = (repeated[place] == fp) & ~null[i:j][doc]
            f, count, fp, doc, split = f[keep], count[keep], fp[keep], doc[keep], heavy[place[keep]]
            if split.any():
                n = count[split]
                single = (K.ranges_concat(f[split], n), np.ones(n.sum(), np.int64), np.repeat(fp[split], n), np.repeat(doc[split], n), np.ones(n.sum(), bool))
                f, count, fp, doc, split = (np.concatenate([x[~split], y]) for x, y in zip((f, count, fp, doc, split), single, strict=True))
                order = np.argsort(doc, kind="stable")
                f, count, fp, doc, split = f[order], count[order], fp[order], doc[order], split[order]
            if len(f):
                h = phrase_hashes(r, f, count)
                found.append(_once(h, f + off[i], count, fp, ids[i:j][doc], ids[i:j][doc], split))
        if not found:
            return _table([])
        h, f, count, fp, owner, last, split = _once(*(np.concatenate(x) for x in zip(*found, strict=True)))
        part = (np.where(split, h, fp) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((f, split, part))
        count, fp, owner, last, split, part, f = (x[order] for x in (count, fp, owner, last, split, part, f))
        rows = []
        for k, a, b in _slices(part, parts):
            text = raw[K.ranges_concat(f[a:b], count[a:b] + LENGTH - 1)]
            rows.append((k, blobs.pack(me, blobs.delta(owner[a:b]), (last[a:b] != owner[a:b]).astype(np.uint8), count[a:b].astype(np.uint32), fp[a:b][split[a:b]], text)))
        del table, raw, found
        K.trim()
        return _table(rows)

    return run


def _once(h, f, count, fp, owner, last, split) -> tuple:
    """Each string once, with its smallest and its largest doc_id (rows are in order of documents)."""
    order = np.argsort(h, kind="stable")
    begin = K.runs(h[order])
    one, final = order[begin], order[np.append(begin[1:], len(h)) - 1]
    return h[one], f[one], count[one], fp[one], owner[one], last[final], split[one]


def _answers(table: pa.Table) -> pa.Table:
    """Of one part: for each string that a batch sent and that may lose bytes there, the smallest doc_id of each of its grams, in runs."""
    got = list(_blobs(table))
    batch = np.repeat([int(x[0][0]) for x in got], [len(x[3]) for x in got])
    owner = np.concatenate([blobs.undelta(x[1]) for x in got])
    several = np.concatenate([x[2] for x in got]) > 0
    count = np.concatenate([x[3] for x in got]).astype(np.int64)
    heavy = np.concatenate([np.concatenate([np.zeros(len(x[3]) - len(x[4]), np.uint64), x[4]]) for x in got])
    data = np.concatenate([x[5] for x in got])
    del got
    size = count + LENGTH - 1
    first = np.cumsum(size) - size
    h = np.concatenate([phrase_hashes(data[first[a] : first[b - 1] + size[b - 1]], first[a:b] - first[a], count[a:b]) for a, b in _runs_of_bytes(first, size)])
    order = np.lexsort((owner, h))
    begin = K.runs(h[order])
    one = order[begin]  # each distinct string once, with its smallest doc_id
    place = np.empty(len(h), np.int64)
    place[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(h))))
    n = count[one]
    least = smallest_owner(data[K.ranges_concat(first[one], size[one])], n, owner[one])
    at = np.cumsum(n) - n
    smallest = np.minimum.reduceat(least, at)
    order = np.flatnonzero(several | (smallest[place] < owner))
    order = order[np.argsort(batch[order], kind="stable")]
    change = np.ones(len(least), dtype=bool)
    change[1:] = least[1:] != least[:-1]
    change[at] = True
    edge = np.flatnonzero(change)
    run_of = np.searchsorted(edge, at)  # runs of each distinct string
    runs = np.diff(np.append(run_of, len(edge)))
    long_ = np.diff(np.append(edge, len(least))).astype(np.uint32)
    rows = []
    for k, a, b in _slices(batch[order], int(batch.max()) + 1):
        mine = order[a:b]
        mine = mine[np.argsort(h[mine])]
        which = place[mine]
        take = K.ranges_concat(run_of[which], runs[which])
        rows.append((k, blobs.pack(h[mine], count[mine].astype(np.uint32), runs[which].astype(np.uint32), long_[take], blobs.delta(least[edge[take]]), np.unique(heavy[mine][heavy[mine] > 0]))))
    del data, least, change
    K.trim()
    return _table(rows)


def _runs_of_bytes(first: np.ndarray, size: np.ndarray, limit: int = K.WINDOW) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(first + size, first[a] + limit, side="right")))
        yield a, b
        a = b


def removed_mask(raw: np.ndarray, off: np.ndarray, ids: np.ndarray, null: np.ndarray, h: np.ndarray, count: np.ndarray, values: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Bytes that go, from the answers (sorted hashes of strings, their gram counts, the grams' smallest doc_ids; fingerprints of split triggers)."""
    out = np.zeros(len(raw), dtype=bool)
    if len(h) == 0:
        return out
    at = np.cumsum(count) - count
    for i, j in K.windows(off):
        r = raw[off[i] : off[j]]
        f, n, t, doc = parse(r, off[i : j + 1] - off[i])
        keep = ~null[i:j][doc]
        f, n, t, doc = f[keep], n[keep], t[keep], doc[keep]
        if len(heavy) and len(f):
            split = np.isin(t >> _SHIFT, heavy)
            single = K.ranges_concat(f[split], n[split])
            f, doc, n = np.concatenate([f[~split], single]), np.concatenate([doc[~split], np.repeat(doc[split], n[split])]), np.concatenate([n[~split], np.ones(len(single), np.int64)])
        if len(f) == 0:
            continue
        mine = phrase_hashes(r, f, n)
        place = np.minimum(np.searchsorted(h, mine), len(h) - 1)
        keep = (h[place] == mine) & (count[place] == n)
        f, n, doc, place = f[keep], n[keep], doc[keep], place[keep]
        grams = K.ranges_concat(f, n)
        gone = grams[values[K.ranges_concat(at[place], n)] < np.repeat(ids[i:j][doc], n)]
        mark = np.zeros(len(r) + 1, np.int32)
        np.add.at(mark, gone, 1)
        np.add.at(mark, gone + LENGTH, -1)
        out[off[i] : off[j]] = np.cumsum(mark[:-1]) > 0
    return out


def _remove(schema: pa.Schema):
    """Of one batch: its rows with what stays of their texts."""

    def run(texts: pa.Table, answered: pa.Table) -> pa.Table:
        if texts.num_rows == 0:
            return schema.empty_table()
        table = _documents(texts)
        ids, null = _doc_ids(table)
        raw, off = K.text_buffers(table.column("text"))
        got = list(_blobs(answered)) or [[np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint64)]]
        h, count, runs, long_, _, heavy = (np.concatenate([x[k] for x in got]) for k in range(6))
        count, runs = count.astype(np.int64), runs.astype(np.int64)
        least = np.concatenate([blobs.undelta(x[4]) for x in got])
        order = np.argsort(h, kind="stable")
        take = K.ranges_concat((np.cumsum(runs) - runs)[order], runs[order])
        gone = removed_mask(raw, off, ids, null, h[order], count[order], np.repeat(least[take], long_[take].astype(np.int64)), np.unique(heavy))
        del got, least, take
        total = np.zeros(len(raw) + 1, np.int64 if len(raw) >= 1 << 31 else np.int32)
        np.cumsum(gone, out=total[1:])
        kept_off = off - total[off]
        lost = (total[off[1:]] - total[off[:-1]]).astype(np.int64)
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        inner = off[:-1][off[:-1] < len(raw)]
        edge[inner] = gone[inner]
        np.cumsum(edge, out=total[1:])
        spans = (total[off[1:]] - total[off[:-1]]).astype(np.int64)
        kept = raw[~gone].tobytes()
        del total, edge
        out = {
            "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(lost), "n_spans": pa.array(spans),
            "kept": pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(kept_off.astype(np.int64).tobytes()), pa.py_buffer(kept)]).cast(pa.binary()),
        }
        if schema.field("kept").type != pa.binary():
            out["kept"] = pa.array([kept[a:b].decode("utf-8", "ignore") for a, b in zip(kept_off[:-1].tolist(), kept_off[1:].tolist(), strict=True)], pa.string())
        return pa.table({n: out[n] if n in out else table.column(n).cast(schema.field(n).type) for n in schema.names}, schema=schema)

    def tidied(texts: pa.Table, answered: pa.Table) -> pa.Table:
        out = run(texts, answered)
        K.trim()
        return out

    return tidied


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] | None = None, as_text: bool = False, heavy: int = HEAVY, batch_bytes: int = BATCH_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, and the columns of ``keep``; None: all) with n_bytes, n_removed, n_spans and ``kept``, the bytes that stay (as_text: as a string, without characters of which a part went)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [c for c in docs.columns if c not in RESULTS and (keep is None or c in (*keep, "doc_id", "text"))]
    docs = docs.select(*names)
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    batches = max(8, -(-total // batch_bytes))
    parts = max(8, -(-total * 9 // (2 * part_bytes)))  # strings overlap: about 4.5 bytes a byte of text
    packed = docs.mapInArrow(K.tidy(_to_batches(batches)), "part int, data binary")
    seen = docs.select("doc_id", "text").mapInArrow(K.tidy(_fingerprints(batches, batches)), "part int, data binary")
    replies = seen.groupBy("part").applyInArrow(_repeated(heavy), "part int, data binary")
    texts = packed.groupBy("part")
    sent = texts.cogroup(replies.groupBy("part")).applyInArrow(_phrases(parts), "part int, data binary")
    answers = sent.groupBy("part").applyInArrow(_answers, "part int, data binary")
    schema = T.StructType([f for f in docs.schema.fields if keep is None or f.name in keep])
    for name in RESULTS:
        schema = T.StructType([*schema.fields, T.StructField(name, (T.StringType() if as_text else T.BinaryType()) if name == "kept" else T.LongType())])
    return texts.cogroup(answers.groupBy("part")).applyInArrow(_remove(to_arrow_schema(schema)), schema)


#: The digests of whole documents in DuckDB SQL.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
g AS (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS s FROM d, unnest(range(n - 49)) t(i)),
m AS (SELECT s, min(doc_id) AS f FROM g GROUP BY s),
r AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM g JOIN m USING (s) WHERE f < doc_id),
k AS (SELECT doc_id, i, sum(CASE WHEN b IS NULL OR i > b + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r),
p AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM k GROUP BY doc_id, k),
q AS (SELECT p.doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY p.doc_id ORDER BY a), 0) AS y FROM p),
o AS (SELECT q.doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substring(h, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) || substring(any_value(h), 2 * max(z) + 1) AS kept FROM q JOIN d USING (doc_id) GROUP BY q.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""
