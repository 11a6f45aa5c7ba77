import hashlib
import random

from strandlake.llm import chat_format as C

EVENTS = "conv_id long, seq long, message long, kind string, role string, text string"


def brute_fold(events):
    out = {}
    for conv, seq, message, kind, role, text in sorted(events, key=lambda e: (e[0], e[1])):
        m = out.setdefault(conv, {})
        if kind == "regenerate":
            for k in [k for k in m if k >= message]:
                del m[k]
        if kind == "edit" and message in m:
            m[message][1] = ""
        old = m.setdefault(message, [None, ""])
        old[0] = role if role is not None else old[0]
        old[1] += text or ""
    return {(c, k): (r or "", t) for c, m in out.items() for k, (r, t) in m.items()}


def test_fold(spark):
    rng = random.Random(1)
    events = []
    for conv in range(30):
        for seq in range(rng.randint(1, 25)):
            events.append((conv, seq, rng.randint(0, 4), rng.choice(["delta", "delta", None, "edit", "regenerate"]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bc", None, "", "d\n"])))
    got = {(r.conv_id, r.message): (r.role, r.text) for r in C.fold(spark.createDataFrame(events, EVENTS)).collect()}
    assert got == brute_fold([(a, b, c, d or "delta", e, f) for a, b, c, d, e, f in events])


def test_digests(spark):
    rng = random.Random(2)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "<\\\\/s>", "[\\INST]", "<nl>", "\n", "\\", "é", "😀", "text", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole <nl>"]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))]), 7) for c in range(60) for t in range(rng.randint(1, 8))]
    rows += [(None, None, None, None, 0), (None, 1, "assistant", "x", 0), (3, 0, "assistant", "twice", 0), (3, 0, "assistant", "twice", 0)]
    got = {r.conv_id: r for r in C.formatted_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")).collect()}
    turns = {}
    for c, t, role, text, _ in rows:
        turns.setdefault(c, []).append(((t is not None, t or 0), (role is not None, role or ""), (text is not None, text or "")))
    for c, ts in turns.items():
        ts = sorted(ts)
        spoken = "".join(r[1] + "\n" + x[1] + "\n" for _, r, x in ts)
        loss = "".join(x[1] for _, r, x in ts if r[1] == "assistant")
        assert got[c].n_turns == len(ts)
        assert got[c].turns_sha256 == hashlib.sha256(spoken.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert set(got) == set(turns)
    assert C.formatted_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_log_of_conversations_needs_folding(spark):
    """Drafts, edits and regenerations are in the log, and its fold is the input."""
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", "x", "é" * 5, "some words of a turn " * rng.randint(1, 9)])) for c in range(20) for t in range(rng.randint(1, 9))]
    rows += [(50, 0, "user", "y" * 300_000), (50, 1, "assistant", "again"), (50, 1, "assistant", "again")]
    log = C.events_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"delta", "edit", "regenerate"}
    assert log.count() > 2.5 * len(rows)
    got = sorted((r.conv_id, r.message, r.role, r.text) for r in C.fold(log).collect())
    expected = []
    for c in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] or ""))
        expected += [(c, k + 1, r[2] or "", r[3] or "") for k, r in enumerate(mine)]
    assert got == expected


def test_no_control_string_survives_in_texts(spark):
    m = spark.createDataFrame([(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, message long, role string, text string")
    r = C.render(m).first()
    assert r.formatted == "[INST]user\n<\\/s>[\\INST] ok [\\/INST][/INST]<s>assistant\n<\\/s>[\\INST] ok [\\/INST]</s>"
    back = C.read_back(C.render(m)).first()
    assert [(t.role, t.text) for t in back.turns] == [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert back.loss_text == "</s>[INST] ok [/INST]"


def test_main_path_is_native(spark):
    import contextlib
    import io

    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        C.formatted_digests(spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")).explain()
    assert "Python" not in text.getvalue() and "Arrow" not in text.getvalue()
