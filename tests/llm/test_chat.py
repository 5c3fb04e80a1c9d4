"""Quotation linking against a plain walk over messages, and its defined cases."""

import hashlib  # noqa: F401
import random
import re

from sedgewren.llm import chat, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(x):
    return "".join(c for c in x.lower() if c.isalnum())


def passages(text):
    """[(level, first line's place, lines)]"""
    out = []
    for place, line in enumerate(re.split("\r?\n", text or "")):
        m = re.match(r"[ \t]*(>[> \t]*)", line)
        level = m.group(1).count(">") if m else 0
        if not out or out[-1][0] != level:
            out.append((level, place, []))
        out[-1][2].append(line[m.end() :] if m else line)
    return out


def units(lines):
    """Three dictionaries of normalised texts: the whole, paragraphs, lines."""
    own = [plain(x) for x in lines]
    paragraphs, open_ = [], ""
    for x in [*own, ""]:
        if x:
            open_ += x
        elif open_:
            paragraphs.append(open_)
            open_ = ""
    return [{"".join(own)} - {""}, set(paragraphs), set(own) - {""}]


def walk(rows):
    """{(conv, turn): (n_linked, parent)} by brute force."""
    known = [r for r in rows if r[0] is not None and r[1] is not None]
    bodies = {}
    for c, t, _, text in known:
        parts = [p for p in passages(text) if p[0] == 0]
        own = bodies.setdefault((c, t), set())
        own.update({plain("".join(x for p in parts for x in p[2]))} - {""})
        for p in parts:
            own.update(*units(p[2]))
    out = {}
    for c, t, _, text in known:
        found = []
        for level, place, lines in passages(text):
            if not level:
                continue
            votes = {}
            for kind, texts in enumerate(units(lines)):
                for x in texts:
                    earlier = [u for (d, u), has in bodies.items() if d == c and u < t and x in has]
                    if earlier:
                        votes.setdefault(max(earlier), [0, 0, 0])[kind] += len(x)
            if votes:
                found.append((level, place, max((max(v), o) for o, v in votes.items())[1]))
        out[c, t] = (len(found), min(found)[2] if found else None)
    return out


def drawn(seed, n=160):
    rng = random.Random(seed)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    rows, said = [], {}
    for _ in range(n):
        conv = 1 if rng.random() < 0.4 else rng.randint(2, 9)
        text = []
        for _ in range(rng.randint(0, 3)):
            old = rng.choice(said.get(conv, [[line()]]))
            part = old[: rng.randint(1, len(old))] if old else [line()]
            signs = rng.choice([">", "> ", ">>", "> > ", ">\t"])
            if rng.random() < 0.3:
                part = [" ".join(part)]  # wrapped anew
            text += [signs + x.upper() for x in part]
            text += [line() for _ in range(rng.randint(0, 2))]
        body = [line() if rng.random() < 0.8 else "" for _ in range(rng.randint(1, 4))] + (["hot line"] if rng.random() < 0.5 else [])
        rows.append((conv, len(said.setdefault(conv, [])) * 3, rng.choice(["user", "assistant"]), "\n".join(text + body)))
        said[conv].append(body)
    return rows


def test_links_equal_a_plain_walk(spark, monkeypatch):
    monkeypatch.setattr(chat, "RANGE", 10)
    for seed in (1, 2):
        rows = drawn(seed)
        got = {(r["conv_id"], r["turn"]): r for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
        want = walk(rows)
        assert sum(n > 0 for n, _ in want.values()) > 30
        assert {k: (r["n_linked"], r["parent_turn"]) for k, r in got.items()} == want
        for (c, t), r in got.items():  # a thread begins where no parent is
            first = t
            while want[c, first][1] is not None:
                first = want[c, first][1]
            assert r["thread_turn"] == first


def test_chats(spark):
    rows = [
        (1, 0, "user", "How does it work?\nPlease tell me."),
        (1, 1, "assistant", "It works well."),
        (1, 2, "user", "> How does it WORK\n>> an older line\nI still wonder."),
        (1, 3, None, "On that:\n> > it works well\nGood."),
        (1, 4, "user", "> it works well\n> nowhere said\nYes.\n>> How does it work?\nEnd."),
        (1, 5, "user", "> How does it\n> work? Please\n> tell me.\nWrapped anew."),
        (2, 0, "user", "> How does it work?"),
        (3, None, "user", None),
        (None, 0, "user", "> How does it work?"),
    ]
    out = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {(r["conv_id"], r["turn"]): r for r in out}
    assert len(out) == 9
    assert (got[1, 2]["body"], got[1, 2]["n_quoted"], got[1, 2]["n_linked"], got[1, 2]["parent_turn"], got[1, 2]["thread_turn"]) == ("I still wonder.", 2, 1, 0, 0)
    assert (got[1, 3]["parent_turn"], got[1, 3]["thread_turn"], got[1, 3]["role"]) == (1, 1, "user")
    assert (got[1, 4]["body"], got[1, 4]["n_quoted"], got[1, 4]["n_linked"], got[1, 4]["parent_turn"]) == ("Yes.\nEnd.", 2, 2, 1)
    assert (got[1, 5]["parent_turn"], got[1, 5]["body"]) == (0, "Wrapped anew.")
    assert (got[2, 0]["n_linked"], got[2, 0]["parent_turn"], got[2, 0]["body"]) == (0, None, "")
    assert got[3, None]["formatted"] == "<|user|>\n\n" and got[None, 0]["n_linked"] == 0
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
    threads = {(r["conv_id"], r["thread_turn"]): r["messages"] for r in chat.conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [m["turn"] for m in threads[1, 0]] == [0, 2, 5] and [m["turn"] for m in threads[1, 1]] == [1, 3, 4]
    assert all(">" not in m["body"] for ms in threads.values() for m in ms)


def test_long_threads_ties_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 10)
    monkeypatch.setattr(chat, "RANGE", 7)
    rows = [(1, i, "user", ("> hot line\n" if i else "") + "hot line\n" + "x" * 50_000) for i in range(35)] + [(1, 3, "user", "hot line again")]
    table = spark.createDataFrame([(*r, "mine", "mine", "mine") for r in rows], SCHEMA + ", body string, place string, level string")
    got = {(r["turn"], r["body"][:5]): r["parent_turn"] for r in chat.format_chats(table).collect()}
    assert len(got) == 35 and all(got[i, "hot l"] == (i - 1 if i else None) for i in range(35))
    parts = chat.conversations(table).orderBy("thread_turn", "part").collect()
    assert [len(r["messages"]) for r in parts] == [10, 10, 10, 6] and {r["thread_turn"] for r in parts} == {0}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op10_chat(spark, DATA).collect()
    want = walk(rows)
    assert len(got) == len(rows) and all(want[r["conv_id"], r["turn"]] == (r["n_linked"], r["parent_turn"]) for r in got)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    for c, t, role, text in rows:
        body = "\n".join(x for level, _, lines in passages(text) if not level for x in lines)
        assert by[c, t]["body"] == body.strip() and by[c, t]["role"] == role
