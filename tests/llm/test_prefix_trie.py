"""The conversation trie against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

from stationflow.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth int, n int"


def plain(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for conv in turns:
        turns[conv].sort(key=lambda t: (*t[:3], hashlib.md5(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()))
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        # % of SQL: the sign of the dividend.
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = [t[2:] for t in turns.get(base, [])[:h]] + [t[2:] for t in turns[c][h:]]
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, own in members.items():
        ends = sorted(c for c in own if len(built[c]) == len(node))
        out.append((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own), kids[node], leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def made_up(longest=7, n=60, seed=2):
    rnd = random.Random(seed)
    texts = ["", "a", "é漢", "long " * 50, None, "b:c", "🙂"]
    rows = []
    for k in range(n):
        if k % 11 == 3:
            continue  # some families lack their first conversation
        for turn in range(rnd.randint(1, longest)):
            rows.append((k, turn if rnd.random() < 0.95 else None, rnd.choice(["user", "assistant", None, ""]) if rnd.random() < 0.2 else "user", rnd.choice(texts[: rnd.choice([2, 7])])))
    for k in range(200, 240):  # one very common conversation
        rows += [(k, 0, "user", "hi"), (k, 1, "assistant", "hello")]
    rows += [rows[0], rows[0], (None, 0, "user", "nobody"), (-7, 0, "u", "x"), (-5, 1, "u", "y"), (10**17, None, None, None)]
    rnd.shuffle(rows)
    return rows


def got(spark, rows):
    data = [(*r, "clash", 1, 1) for r in rows]
    return sorted(map(tuple, prefix_trie.trie(spark.createDataFrame(data, SCHEMA)).collect()), key=str)


def test_equals_a_plain_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 20)
    rows = made_up()
    assert got(spark, rows) == plain(rows)


def test_deep_paths(spark, monkeypatch):
    """Conversations far deeper than the limit, with copies that part near their ends."""
    monkeypatch.setattr(prefix_trie, "DEEP", 2)
    rows = made_up(longest=4, n=20)
    long = [(t, "user", f"turn {t}") for t in range(60)]
    for k, (stop, last) in enumerate([(60, "x"), (60, "x"), (60, "y"), (55, "z"), (40, "turn 40"), (9, "turn 9"), (60, "x")]):
        rows += [(1000 + 5 * k, *t) for t in long[:stop]] + [(1000 + 5 * k, 100, "user", last)]
    assert got(spark, rows) == plain(rows)


def test_very_long_conversation(spark):
    rows = [(5, t, "user", f"t{t}") for t in range(500)] + [(10, t, "user", f"t{t}") for t in range(490)]
    assert got(spark, rows) == plain(rows)


def test_odd_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []
    # Its own turns all lie among those it would take over from a conversation that is absent.
    turnless = next(c for c in range(1, 99) if c % 5 and prefix_trie.shared_turns(c) > 1)
    assert got(spark, [(turnless, 0, "user", "x")]) == [
        (turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())
    ]
