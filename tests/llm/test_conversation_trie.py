"""The conversation trie against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import pytest

from grainsieve.llm import conversation_trie
from grainsieve.llm.tables import share_package

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_force(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members = collections.defaultdict(list)
    for conv, turns in sorted(own.items()):
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - int(conv % 100 if conv >= 0 else -(-conv % 100))
        whole = own.get(base, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((conv, d == len(whole)))
    nodes = {}
    for seq in sorted(members, key=len, reverse=True):
        held = members[seq]
        below = [nodes[k] for k in nodes if len(k) == len(seq) + 1 and k[:-1] == seq]
        nodes[seq] = {
            "conv_id": held[0][0], "depth": len(seq), "parent_conv_id": members[seq[:-1]][0][0] if seq else None, "n_convs": len(held),
            "n_children": len(below), "n_leaves": sum(n["n_leaves"] for n in below) or 1,
            "saved_tokens": sum(n["saved_tokens"] for n in below) + ((len(held) - 1) * len(seq[-1][1]) if seq else 0),
            "ends_sha256": hashlib.sha256(",".join(str(c) for c, ends in held if ends).encode()).hexdigest(),
        }
    return collections.Counter(tuple(n[c] for c in COLUMNS) for n in nodes.values())


def as_bag(frame):
    assert frame.columns == COLUMNS
    return collections.Counter(map(tuple, frame.collect()))


@pytest.fixture(scope="module")
def session(spark):
    share_package(spark)
    return spark


def made_up(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for conv in convs:
        for turn in range(rng.randint(1, most)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "Ärger 日本"])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("range_turns", [7, 500_000])
def test_made_up_conversations(session, range_turns):
    rows = made_up(3, [*range(0, 12), 200, 205, 317, -5, -100, -250, 10**12 + 7], 9)
    rows += [(None, 0, "user", "lost"), (4, 1, "user", "a"), (4, 1, "user", "a")]
    # conversations longer than a range, one a copy of the other, and one that ends inside the head of its base
    rows += [(c, i, "user", f"t{i}") for c in (400, 401, 402) for i in range(40 if c < 402 else 1)]
    frame = session.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, f0 string, place int, `a.b` int")
    assert as_bag(conversation_trie.conversation_trie(frame, range_turns=range_turns)) == brute_force(rows)


def test_slices_of_long_conversations(session, monkeypatch):
    monkeypatch.setattr(conversation_trie, "SLICE", 4)
    rows = made_up(5, range(100, 112), 15) + [(c, i, "user", f"t{i}") for c in (100, 101, 103) for i in range(20, 50)]
    frame = session.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert as_bag(conversation_trie.conversation_trie(frame, range_turns=11)) == brute_force(rows)


def test_empty_table(session):
    frame = session.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie.conversation_trie(frame).count() == 0


def test_fingerprints_that_collide_are_drawn_anew(session, monkeypatch):
    rows = made_up(8, range(300, 310), 6)
    frame = session.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    # with a base of 0 every prefix of a length looks like every other
    real, seen = conversation_trie.bases, []
    monkeypatch.setattr(conversation_trie, "bases", lambda attempt: seen.append(attempt) or (real(attempt) if attempt else [1] * conversation_trie.LANES))
    swapped = [(500, 0, "user", "x"), (500, 1, "user", "y"), (501, 0, "user", "y"), (501, 1, "user", "x")]
    swapped = [(c, t + 10 * k, r, x) for c, t, r, x in swapped for k in range(8)]
    both = rows + swapped
    frame = session.createDataFrame(both, "conv_id long, turn long, role string, text string")
    assert as_bag(conversation_trie.conversation_trie(frame)) == brute_force(both)
    assert seen == [0, 1]


def test_fingerprints_compose():
    bases = conversation_trie.bases(0)
    rng = random.Random(1)
    turns = [[rng.randrange(1, conversation_trie.PRIME) for _ in bases] for _ in range(9)]

    def of(part):
        return len(part), [sum(v[k] * pow(b, i, conversation_trie.PRIME) for i, v in enumerate(part, 1)) % conversation_trie.PRIME for k, b in enumerate(bases)]

    for cut in range(10):
        assert conversation_trie.combine(of(turns[:cut]), of(turns[cut:]), bases) == of(turns)


def test_given_table(session):
    table = session.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert as_bag(conversation_trie.conversation_trie(table)) == brute_force(rows)
