"""Chat formatting: only conversations that no other one extends, rendered turn by turn."""

import weftline.llm.chat as chat

SCHEMA = "conv_id long, turn long, role string, text string, place string"


def render(turns):
    return "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)


def brute(rows):
    by = {}
    for c, turn, role, text, _ in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    seqs = {c: [(r if hr else None, t if ht else None) for _, _, hr, r, ht, t in sorted(v)] for c, v in by.items()}
    kept = {}
    low = lambda c: -1 if c is None else c
    for c, s in seqs.items():
        if not any(o is not c and o != c and t[: len(s)] == s and (len(t) > len(s) or low(o) < low(c)) for o, t in seqs.items()):
            kept[c] = s
    return {c: (len(s), render(s)) for c, s in kept.items()}


def test_snapshots_collapse(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 4)
    talk = [("user", "hi"), ("assistant", "hello"), ("user", None), (None, "x"), ("user", ""), ("assistant", "bye"), ("user", "again"), ("assistant", "yes"), ("user", "ok")]
    rows = []
    for c, n in ((1, 2), (2, 5), (3, 9), (4, 9), (5, 1)):
        rows += [(c, i, *talk[i], "p") for i in range(n)]
    rows += [(6, i, *t, "p") for i, t in enumerate(talk[:2] + [("user", "")])]  # an empty text is not a null one
    rows += [(None, i, *t, "p") for i, t in enumerate([("user", "n"), ("user", "n")])]
    rows += [(7, None, "user", "n", "p"), (8, 3, "user", "n", "p"), (8, 3, "user", "n", "p"), (9, 700, "user", "far", "p"), (9, -5, "user", "first", "p")]
    got = {}
    for r in chat.chat(spark.createDataFrame(rows, SCHEMA).repartition(3)).orderBy("segment").collect():
        n, text = got.get(r.conv_id, (0, ""))
        got[r.conv_id] = (r.n_turns, text + r.rendered)
    assert got == brute(rows)


def test_empty(spark):
    assert chat.chat(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_turn_number_for_all_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 16)
    rows = [(1, 5, "user", f"t{i:03d}", "p") for i in range(100)] + [(2, None, "user", f"t{i:03d}", "p") for i in range(60)] + [(3, 1, "user", "x" * 3_000_000, "p"), (4, 1, "user", "x" * 3_000_000 + "y", "p")]
    got = {}
    for r in chat.chat(spark.createDataFrame(rows, SCHEMA)).orderBy("segment").collect():
        n, text = got.get(r.conv_id, (0, ""))
        got[r.conv_id] = (r.n_turns, text + r.rendered)
    assert got == brute(rows) and set(got) == {1, 3, 4}


def test_many_logs_with_one_beginning(spark):
    rows = [(c, t, "user", "hello" if t < 2 else f"{c}.{t}", "p") for c in range(200) for t in range(2 + c % 3)]
    got = {r.conv_id: (r.n_turns, r.rendered) for r in chat.chat(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
