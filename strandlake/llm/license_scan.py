"""License scans with a generalised suffix automaton of license words.

Words are runs of ASCII letters and digits (lower-cased) and of other
characters.  The automaton holds the words of all templates and phrases.  A
text's words stream through it; at each word the state tells the longest run of
words ending there that stands in some template (its matching statistic).  Runs of
``MIN_MATCH`` words or more are matched to every place where they stand in a template and chained, per template,
into spans that advance in the text and in the template; the best chain to each match is found by a
tree over the template's places, whatever the number of matches.  A span that covers ``MIN_COVER`` of its template
(``SHORT_COVER`` of a short one, its ``TELLING`` words among them) gives the template's label.  Phrases are found at the states below their own in the suffix
links.

Only words of the templates' vocabulary can be in a match, so runs of such
words alone enter the automaton.  The automaton is built in each worker from
constants, or from the templates given (``read_templates``).  Memory is that of a window of whole documents.

Nulls and empties: a null or empty text has no words and no labels; an empty table gives no rows.  A null doc_id
stays null.  Repeated rows give equal values.  Extra columns are ignored.  A long text is scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Fixed phrases of the base labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Fixed wording of public licenses and license notices.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("mit", "released under the mit license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2", "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license legal entity shall mean the union of the acting entity and all other entities that control are controlled by or are under common control with that entity"),
    ("apache-2", "grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl", "licensed under the gnu general public license version 3 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "the gnu general public license is a free copyleft license for software and other kinds of works the licenses for most software and other practical works are designed to take away your freedom to share and change the works"),
    ("all-rights-reserved", "all rights reserved"),
]
#: Words that tell a short notice from others; a span must cover them.
TELLING = frozenset(["mit", "apache", "nc", "noncommercial", "gnu", "reserved"])
MIN_MATCH = 3
#: Share of a template that a span must cover; of one with fewer than SHORT words, nearly all.
MIN_COVER, SHORT, SHORT_COVER = 0.5, 20, 0.85
#: Words of the text between two matches of a span, and words that two may share.
MAX_GAP, MAX_SHARED = 12, 3

SCHEMA = "doc_id long, n_words long, places array<struct<label:string,start:long>>, spans array<struct<label:string,start:long,end:long,covered:double>>"


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.templates = [(label, text.split()) for label, text in [*templates, *((label, p) for p, label in phrases)]]
        self.number = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends_at: list[tuple[int, int, int]] = []
        for t, (_, words) in enumerate(self.templates):
            last = 0
            for at, w in enumerate(words):
                last = self._extend(last, self.number.setdefault(w, len(self.number)))
                ends_at.append((last, t, at))
        self.where: list[set[tuple[int, int]]] = [set() for _ in self.next]  # of each state of MIN_MATCH words or more: its ends in templates
        for state, t, at in ends_at:
            self.where[state].add((t, at))
        for state in sorted(range(1, len(self.next)), key=lambda x: -self.length[x]):
            if self.length[self.link[state]] >= MIN_MATCH:
                self.where[self.link[state]] |= self.where[state]
        self.found: list[tuple] = [()] * len(self.next)  # phrases that end where a state ends
        ends = {}
        for p, label in phrases:
            state = 0
            for w in p.split():
                state = self.next[state][self.number[w]]
            ends.setdefault(state, []).append((label, len(p.split())))
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            inherited = self.found[self.link[state]] if state else ()
            self.found[state] = inherited + tuple(ends.get(state, ()))
        self.index = K.HashIndex(max(12, (4 * len(self.number)).bit_length()))
        words = list(self.number)
        self.index.add(np.array([K.word_hash(w.encode()) for w in words], np.uint64))

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            if self.length[q] == self.length[last] + 1:
                return q
            return self._split(last, c, q)
        cur = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def stream(self, words: list[int], start: int):
        """(places, matches) of a run of known words; matches are (template, template start, text start, words) of maximal runs."""
        state, length = 0, 0
        places, matches = [], []
        before = None
        for at, c in enumerate(words, start):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            if before and (length <= before[1]):
                matches += self._matches(*before)
            before = (state, length, at) if length >= MIN_MATCH else None
            for label, size in self.found[state]:
                if length >= size:
                    places.append((label, at - size + 1))
        if before:
            matches += self._matches(*before)
        return places, matches

    def _matches(self, state: int, length: int, at: int) -> list[tuple[int, int, int, int]]:
        return [(t, end - length + 1, at - length + 1, length) for t, end in self.where[state]]

    def chain(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Spans (label, first word, last word, share of the template covered) of matches of a text."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for t, a, s, n in matches:
            by_template.setdefault(t, []).append((s, a, n))
        out = []
        for t, mine in sorted(by_template.items()):
            label, words = self.templates[t]
            telling = {k for k, w in enumerate(words) if w in TELLING} if len(words) < SHORT else set()
            least = (SHORT_COVER if len(words) < SHORT else MIN_COVER) * len(words)
            mine = sorted(set(mine))
            best = best_chains(mine, len(words))
            used = set()
            for k in sorted(range(len(mine)), key=lambda k: (-best[k][0], k)):
                if best[k][0] < least:
                    break
                b, path = k, []
                while b != -1 and b not in used:
                    path.append(b)
                    b = best[b][1]
                if b == -1 and telling <= {x for i in path for x in range(mine[i][1], mine[i][1] + mine[i][2])}:
                    used.update(path)
                    out.append((label, mine[path[-1]][0], mine[k][0] + mine[k][2] - 1, best[k][0] / len(words)))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def best_chains(matches: list[tuple[int, int, int]], size: int) -> list[tuple[int, int]]:
    """For each match (text start, template start, words), in order: (words covered by the best chain that ends with it, the match before it or -1).

    A match may give up to MAX_SHARED of its first words to the match before it.  Matches are taken in the order in which
    what is left of them begins; a tree over the template's places holds the matches that ended at most MAX_GAP words before.
    """
    best = [(n, -1) for _, _, n in matches]
    starts = sorted((s + o, a + o, n - o, k) for k, (s, a, n) in enumerate(matches) for o in range(min(MAX_SHARED, n - 1) + 1))
    ends = sorted((s + n, k) for k, (s, _, n) in enumerate(matches))
    at_place: dict[int, list[tuple[int, int]]] = {}
    base = 1 << size.bit_length()
    tree = [(0, -1)] * (2 * base)

    def update(place: int) -> None:
        i = base + place
        tree[i] = max(at_place[place], default=(0, -1))
        while i > 1:
            i >>= 1
            new = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == new:
                break
            tree[i] = new

    def highest(places: int) -> tuple[int, int]:
        """The best of the first places."""
        found, i, j = (0, -1), base, base + places
        while i < j:
            if i & 1:
                found = max(found, tree[i])
                i += 1
            if j & 1:
                j -= 1
                found = max(found, tree[j])
            i, j = i >> 1, j >> 1
        return found

    came = gone = 0
    for s, a, n, k in starts:
        while came < len(ends) and ends[came][0] <= s:
            j = ends[came][1]
            place = matches[j][1] + matches[j][2]
            at_place.setdefault(place, []).append((best[j][0], j))
            update(place)
            came += 1
        while gone < came and ends[gone][0] < s - MAX_GAP:
            j = ends[gone][1]
            place = matches[j][1] + matches[j][2]
            at_place[place].remove((best[j][0], j))
            update(place)
            gone += 1
        value, j = highest(a + 1)
        if value and value + n > best[k][0]:
            best[k] = (value + n, j)
    return best


_made: dict[tuple, Automaton] = {}


def automaton(templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES)) -> Automaton:
    if templates not in _made:
        _made.clear()
        _made[templates] = Automaton(templates)
    return _made[templates]


def read_templates(spark, path: str) -> tuple[tuple[str, str], ...]:
    """The built-in templates and those of a folder of license texts, each labelled by its file's name without extension; a few hundred files at most."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("label"), "value").orderBy("label").collect()
    found = []
    for r in rows:
        raw = np.frombuffer(r.value.encode(), np.uint8)
        starts, ends, _, _ = K.word_spans(raw, np.array([0, len(raw)]), K.ALNUM)
        low = K.LOWER[raw].tobytes()
        found.append((r.label, " ".join(low[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True))))
    return (*TEMPLATES, *found)


def scan_window(raw: np.ndarray, offsets: np.ndarray, auto: Automaton) -> tuple[np.ndarray, dict[int, tuple[list, list]]]:
    """(words per document, {document index: (places, spans)}) of a window."""
    _, _, h, doc = K.word_spans(raw, offsets, K.ALNUM)
    n_words = np.bincount(doc, minlength=len(offsets) - 1)
    begin = np.cumsum(n_words) - n_words
    known = auto.index.find(h)
    mask = np.zeros(len(h) + 2, np.int8)
    mask[1:-1] = known >= 0
    edge = np.flatnonzero(np.diff(mask))
    starts, ends = edge[::2], edge[1::2]
    cut = begin[(begin > 0) & (begin < len(h)) & (n_words > 0)]  # runs end with their document
    cut = cut[(known[cut] >= 0) & (known[cut - 1] >= 0)]
    starts, ends = np.sort(np.append(starts, cut)), np.sort(np.append(ends, cut))
    keep = ends - starts >= 3
    found: dict[int, tuple[list, list]] = {}
    for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True):
        k = int(doc[a])
        places, matches = auto.stream(known[a:b].tolist(), a - int(begin[k]))
        if places or matches:
            mine = found.setdefault(k, ([], []))
            mine[0].extend(places)
            mine[1].extend(matches)
    return n_words, {k: (p, auto.chain(m)) for k, (p, m) in found.items()}


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES)) -> DataFrame:
    """(doc_id, n_words, places of phrases, spans of templates) of each row; a narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))
        auto = automaton(templates)
        for batch in batches:
            raw, off = K.text_buffers(batch.column("text"))
            counts, places, spans = [], [], []
            for i, j in K.windows(off):
                n, found = scan_window(raw[off[i] : off[j]], off[i : j + 1] - off[i], auto)
                counts.append(n)
                for k in range(j - i):
                    p, s = found.get(k, ((), ()))
                    places.append([{"label": x, "start": y} for x, y in p])
                    spans.append([{"label": a, "start": b, "end": c, "covered": d} for a, b, c, d in s])
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(places, place), pa.array(spans, span)], names=["doc_id", "n_words", "places", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def labelled(docs: DataFrame, templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES)) -> DataFrame:
    s = scan(docs, templates)
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    own = F.transform("spans", lambda p: p["label"])
    start = F.transform("places", lambda p: p["start"])
    covered = F.array_max(F.transform("spans", lambda p: p["covered"]))
    return s.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce(covered, F.lit(0.0)))).alias("score"),
    )
