import random
import re

from strandlake.llm import license_scan as L

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    places = []
    for phrase, label in L.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(places)


def test_against_brute_force(spark):
    rng = random.Random(1)
    parts = [p for p, _ in L.PHRASES] + ["under the mit", "Under THE MIT License!", "CC-BY-NC", "cc by", "nc", "apache license", "version 2", "the", "license", "é", "under the MIT license", "x9", "\n"]
    texts = [None, "", "  "] + [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)] + ["the " * 50_000 + "cc by nc"]
    rows = L.labelled(spark.createDataFrame([(k, t, "?") for k, t in enumerate(texts)], "doc_id long, text string, labels string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, places = brute(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    assert L.labelled(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_matching_statistics():
    """Every state's run is the longest suffix that stands in a template."""
    auto = L.Automaton()
    known = {tuple(w) for _, w in auto.templates}
    grams = {t[i:j] for t in known for i in range(len(t)) for j in range(i + 1, min(len(t), i + 30) + 1)}
    rng = random.Random(2)
    words = [w for t in known for w in t]
    text = []
    for _ in range(60):
        t = rng.choice(sorted(known))
        i = rng.randrange(len(t))
        text += list(t[i : i + rng.randint(1, 12)]) + [rng.choice(words)]
    state = length = 0
    for at, w in enumerate(text):
        c = auto.number[w]
        while state and c not in auto.next[state]:
            state = auto.link[state]
            length = auto.length[state]
        if c in auto.next[state]:
            state, length = auto.next[state][c], length + 1
        best = max((n for n in range(1, 30) if at - n + 1 >= 0 and tuple(text[at - n + 1 : at + 1]) in grams), default=0)
        assert min(length, 29) == best


def test_template_spans(spark):
    label, text = L.TEMPLATES[0]
    w = text.split()
    damaged = "intro words " + " ".join(w[:20] + ["EXTRA"] + w[21:40]) + " outro"
    r = L.labelled(spark.createDataFrame([(1, damaged), (2, " ".join(w[:6]))], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[0].labels == label and r[0].base_labels == "" and 0.5 <= r[0].score <= 1
    assert r[1].labels == "" and r[1].score == 0
    s = L.scan(spark.createDataFrame([(1, damaged)], "doc_id long, text string")).first().spans
    assert s[0].start == 2


def brute_cover(words, template):
    """Words of the best chain of a template, by all matches and all pairs of them."""
    t = template.split()
    matches = []
    for s in range(len(words)):
        for a in range(len(t)):
            n = 0
            while s + n < len(words) and a + n < len(t) and words[s + n] == t[a + n]:
                n += 1
            if n >= L.MIN_MATCH and (s == 0 or a == 0 or words[s - 1] != t[a - 1]):
                matches.append((s, a, n))
    best = []
    for s, a, n in sorted(matches):
        value = n
        for (s2, a2, n2), v in best:
            for o in range(min(L.MAX_SHARED, n - 1) + 1):
                if s2 + n2 <= s + o <= s2 + n2 + L.MAX_GAP and a2 + n2 <= a + o:
                    value = max(value, v + n - o)
        best.append(((s, a, n), value))
    return max((v for _, v in best), default=0)


def test_chains_against_all_pairs():
    rng = random.Random(5)
    for _ in range(300):
        t = [rng.choice("abcde") for _ in range(rng.randint(5, 40))]
        words = []
        for _ in range(rng.randint(1, 8)):
            k = rng.randrange(len(t))
            words += t[k : k + rng.randint(1, 9)] + [rng.choice("abcdefg") for _ in range(rng.randint(0, 3))]
        auto = L.Automaton([("x", " ".join(t))], [])
        matches = []
        run, at = [], 0
        for k, w in enumerate([*words, None]):
            if w is not None and w in auto.number:
                run.append(auto.number[w])
            else:
                if len(run) >= L.MIN_MATCH:
                    matches += auto.stream(run, at)[1]
                run, at = [], k + 1
        mine = sorted({(s, a, n) for _, a, s, n in matches})
        got = max((v for v, _ in L.best_chains(mine, len(t))), default=0)
        assert got <= brute_cover(words, " ".join(t))
        # the same matches, all pairs
        best = []
        for s, a, n in mine:
            best.append(max([n, *(v + n - o for (s2, a2, n2), v in zip(mine, best, strict=False) for o in range(min(L.MAX_SHARED, n - 1) + 1) if s2 + n2 <= s + o <= s2 + n2 + L.MAX_GAP and a2 + n2 <= a + o)]))
        assert got == max(best, default=0)


def test_whole_and_damaged_texts(spark):
    """Whole texts give their label, damaged ones too, prose that shares a few words gives none."""
    rng = random.Random(6)
    rows, expected = [], {}
    for k, (label, text) in enumerate(L.TEMPLATES):
        w = text.split()
        rows.append((k, "Preface. " + text.upper() + " the end"))
        expected[k] = label
        if len(w) >= 40:
            damaged = [x if rng.random() > 0.04 else "changed" for x in w]
            rows.append((100 + k, " ".join(damaged)))
            expected[100 + k] = label
    prose = ["released under the new name", "Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "all rights of the license", "the terms of the license and the use of this software"]
    rows += [(200 + k, x) for k, x in enumerate(prose)] + [(None, "no id, no license"), (200, prose[0])]
    got = L.labelled(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        labels = set(filter(None, r.labels.split(",")))
        assert expected.get(r.doc_id) in labels if r.doc_id in expected else not labels, (r.doc_id, labels)


def test_repeated_license_words_are_linear():
    """A long text of license words alone, with a great many matches, is scanned in time and whole."""
    auto = L.automaton()
    rng = random.Random(3)
    w = L.TEMPLATES[0][1].split()
    words = []
    while len(words) < 20_000:
        k = rng.randrange(len(w))
        words += w[k : k + rng.randint(3, 6)]
    _, matches = auto.stream([auto.number[x] for x in words], 0)
    assert len(matches) > 5000
    auto.chain(matches)


def test_templates_from_files(spark, tmp_path):
    (tmp_path / "own-1.txt").write_text("This Sofa May Be Copied, by anyone who sits on it; nothing else is granted to them at all, ever.")
    templates = L.read_templates(spark, str(tmp_path))
    (row,) = L.labelled(spark.createDataFrame([(1, "x this sofa may be copied by anyone who sits on it nothing else is granted to them at all ever")], "doc_id long, text string"), templates).collect()
    assert row.labels == "own-1"


def test_short_notices(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "All rights reserved.", "all the rights"]
    rows = L.labelled(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == ["cc-by-nc", "gpl", "apache-2", "mit", "all-rights-reserved", ""]
