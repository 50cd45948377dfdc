"""The conversation trie against a brute-force trie, split down to components of one segment."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from pairlens.llm import conversation_trie as ct


def expected(rows, shared=True):
    own, paths, members, below = defaultdict(list), {}, defaultdict(list), defaultdict(set)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 6 if shared else 0
        paths[c] = tuple(said.get(c - c % 100, [])[:h] + said[c][h:]) if shared else tuple(said[c])
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                below[path[:d - 1]].add(path[:d])
    sums, made = {}, []
    for node in sorted(members, key=len, reverse=True):
        own_value = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        sums[node] = (sum(sums[k][0] for k in below[node]) or 1, own_value + sum(sums[k][1] for k in below[node]))
        ends = ",".join(str(c) for c in sorted(members[node]) if paths[c] == node)
        made.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below[node]), *sums[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(made, key=repr)


def cases():
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c // 7 if t < 3 else c % 3}") for c in range(0, 230) if c != 100 for t in range(c % 9)]
    rows += [(300, None, None, None), (300, 1, "user", ""), (300, 2, None, "é\U0001F600"), (301, 5, "user", None), (301, -3, "", "x"), (None, 1, "user", "lost"), (305, 1, "a", "bc"), (306, 1, "ab", "c")]
    rows += [(400 + k, t, "user", f"chain {t}") for k in (0, 1) for t in range(60 + k)]  # a long way without branches
    rows += [(500 + k, t, "user", f"spine {t}" if t < k else f"own {k}") for k in range(30) for t in range(k + 1)]  # a branch at every depth
    rows += [(7000 + k, t, "system", "same") for k in range(40) for t in range(4)]
    return rows


@pytest.mark.parametrize("block, shared", [(2, True), (256, False)])
def test_trie_against_brute_force(spark, block, shared):
    rows = cases()
    turns = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, n_convs int, d string").repartition(4)
    codes = ct.turn_codes(turns)
    given = ct.with_shared_heads(codes) if shared else (codes.withColumnRenamed("pos", "d"), codes.select("conv").distinct())
    made = ct.prefix_trie(*given, block=block)
    assert made.columns == ct.NODE
    assert sorted((tuple(r) for r in made.collect()), key=repr) == expected(rows, shared)


def test_long_conversations_and_many_ends(spark, monkeypatch):
    """Several blocks of turns in a conversation and several id ranges in a digest change nothing."""
    monkeypatch.setattr(ct, "TURN_BITS", 3)
    monkeypatch.setattr(ct, "ID_BITS", 2)
    rows = [(c, t, "user", f"t{t}") for c in range(50) for t in range(40)] + [(60, t, "user", f"t{t}" if t < 30 else "other") for t in range(45)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    codes = ct.turn_codes(turns)
    made = ct.prefix_trie(codes.withColumnRenamed("pos", "d"), codes.select("conv").distinct(), block=2)
    assert sorted((tuple(r) for r in made.collect()), key=repr) == expected(rows, shared=False)


def test_no_conversation(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert ct.prefix_trie(*ct.with_shared_heads(ct.turn_codes(none))).count() == 0
