"""Sharding and the conversation trie against brute-force versions."""

import bisect
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from panelrisk.llm import packing, trie
from panelrisk.llm.store import written

DOCS = "doc_id long, text string, size long, shard int, place long, task long, unit long, th long"
TURNS = "conv_id long, turn long, role string, text string, depth long, p long, band long, words long"


def plain_best_fit(sizes, capacity):
    """Loads of the bins that best fit of decreasing sizes fills, with a sorted list."""
    left, loads = [], []
    for s in sorted(sizes, reverse=True):
        k = bisect.bisect_left(left, (s, -1))
        if k < len(left):
            room, own = left.pop(k)
        else:
            room, own = capacity, len(loads)
            loads.append(0)
        loads[own] += s
        if room > s:
            bisect.insort(left, (room - s, own))
    return sorted(loads)


def test_tree_stays_balanced_and_finds_the_tightest():
    rng = random.Random(2)
    tree, plain = packing.Capacities(), []
    for k in range(3000):
        if plain and rng.random() < 0.45:
            size = rng.randint(1, 600)
            want = min((x for x, _ in plain if x >= size), default=None)
            assert tree.tightest(size) == want
            if want is not None:
                own = next(b for x, b in plain if x == want)
                assert tree.take(want) == own
                plain.remove((want, own))
        else:
            plain.append((rng.randint(1, 500), k))
            tree.add(*plain[-1])

    def height(t):
        if t is None:
            return 0
        a, b = height(t[2]), height(t[3])
        assert abs(a - b) <= 1 and t[4] == 1 + max(a, b)
        return t[4]

    height(tree.root)
    ordered = packing.Capacities()
    for k in range(1024):
        ordered.add(k, k)
    assert height(ordered.root) <= 11


@pytest.mark.parametrize("capacity", [50, 97, 1000])
def test_packing_is_best_fit_decreasing(capacity):
    rng = random.Random(capacity)
    sizes = sorted((rng.randint(1, 120) for _ in range(400)), reverse=True)
    bins = packing.packed(sizes, capacity=capacity)
    loads = Counter()
    for b, s in zip(bins, sizes, strict=True):
        loads[b] += s
    assert sorted(loads.values()) == plain_best_fit(sizes, capacity)


def test_capacity_search_uses_the_shards_given():
    rng = random.Random(3)
    for n, shards in ((5, 16), (400, 16), (3000, 7), (1, 1)):
        sizes = sorted((rng.randint(1, 900) for _ in range(n)), reverse=True)
        loads = Counter()
        for b, s in zip(packing.packed(sizes, shards), sizes, strict=True):
            loads[b] += s
        assert max(loads) < shards and max(loads.values()) <= -(-sum(sizes) // shards) + sizes[0]
        if n > 100:
            assert max(loads.values()) <= 1.02 * sum(sizes) / shards
    assert packing.packed([], 4) == []


def document_rows():
    rng = random.Random(8)
    texts = ["x" * rng.randint(1, 300) + str(k) for k in range(300)] + ["hot passage " * 5] * 400 + [None, "", "", "É日本", "y" * 9000]
    return [(k if k != 7 else None, t, 1, 2, 3, 4, 5, 6) for k, t in enumerate(texts)] + [(3, texts[3], 1, 2, 3, 4, 5, 6)] * 2


@pytest.mark.parametrize("parts", [2, 512])
def test_shards_of_documents(spark, parts):
    rows = document_rows()
    got = packing.sharded(spark.createDataFrame(rows, DOCS).repartition(3), 4, parts=parts).collect()
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, size(t), crc(t)) for d, t, *_ in rows)
    shard_of = defaultdict(set)
    for r in got:
        shard_of[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(s) == 1 for s in shard_of.values())
    slots, loads = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append((r["slot"], r["doc_id"]))
        loads[r["shard"]] += r["size"]
    assert set(slots) == {0, 1, 2, 3}
    for own in slots.values():
        own.sort(key=lambda x: x[0])
        assert [s for s, _ in own] == list(range(len(own)))
        assert [d for _, d in own] == sorted((d for _, d in own), key=lambda d: (d is not None, d or 0))
    groups = Counter()
    for _, t, *_ in rows:
        groups[t or ""] += size(t)
    most, total = max(groups.values()), sum(groups.values())
    assert most > total / 4  # one group is more than a shard: it has one for itself, the others are near equal
    rest = sorted(loads.values())[:-1]
    assert max(loads.values()) == most and max(rest) <= 1.4 * sum(rest) / 3 + 9001


def test_shards_of_fixed_capacity(spark):
    rows = [(k, "z" * (20 + 7 * k % 90) + str(k)) for k in range(500)]
    got = packing.sharded(spark.createDataFrame(rows, "doc_id long, text string"), None, 1000).collect()
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    total = sum(loads.values())
    assert max(loads.values()) <= 1000 and len(loads) <= 1.1 * total / 1000 + 1 and len(got) == 500
    wide = packing.sharded(spark.createDataFrame([(1, "a" * 5000), (2, "b"), (3, None)], "doc_id long, text string"), None, 100).collect()
    assert {r["doc_id"]: r["size"] for r in wide} == {1: 5001, 2: 2, 3: 1} and len({r["shard"] for r in wide}) == 2


def test_shards_of_nothing(spark):
    out = packing.shard_digest(spark.createDataFrame([], DOCS))
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and out.count() == 0


def conversation_rows():
    rng = random.Random(6)
    out = []
    talks = [[(rng.choice(["user", "system", None]), rng.choice(["a b", "c", "", None, "d e  f"])) for _ in range(rng.randint(1, 6))] for _ in range(12)]
    for c in list(range(0, 70)) + [-3, -25, 140, 145]:
        talk = list(rng.choice(talks))
        if c == 45:
            talk = [("user", f"w{k % 3} x") for k in range(90)]  # deep, with the first turns of a talk of its own
        if c == 41:
            talk = [("user", f"w{k % 3} x") for k in range(70)]
        for k, (role, text) in enumerate(talk):
            out.append((c, None if k == 0 and c % 7 == 0 else k, role, text, 1, 2, 3, 4))
    out += [out[5]] * 2 + [(None, 0, "user", "nobody", 1, 2, 3, 4), (3, 1, "user", "tie", 1, 2, 3, 4), (3, 1, "system", "tie", 1, 2, 3, 4)]
    rng.shuffle(out)
    return out


def plain_trie(rows, every=20, most=4):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(r, x) for *_, r, _, x in sorted(t)] for c, t in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % every) * (1 if c >= 0 else -1)
        whole[c] = turns.get(base, [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    out, children = {}, Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        words = len([w for w in n[-1][1].split(" ") if w]) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += children[n] == 0
            saved[n[:d]] += (len(m) - 1) * words
    for n, m in members.items():
        out[len(n), min(m)] = (min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
    return out


@pytest.mark.parametrize("height", [2, 5, 16, 200])
def test_trie(spark, height):
    rows = conversation_rows()
    got = trie.trie(spark.createDataFrame(rows, TURNS).repartition(3), height=height).collect()
    want = plain_trie(rows)
    assert len(got) == len(want)
    for r in got:
        assert (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) == want[r["depth"], r["conv_id"]]


def test_one_conversation_over_many_tasks(spark):
    """A conversation that holds most rows is dealt over tasks and numbered through."""
    rows = [(1, k, "user", f"t{k}") for k in range(5000)] + [(2, k, "user", "x") for k in range(3)]
    turns = written(trie.placed_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)), "test-turns")
    assert sorted(r["pos"] for r in turns.where("conv_id = 1").collect()) == list(range(1, 5001))
    assert sorted(r["pos"] for r in turns.where("conv_id = 2").collect()) == [1, 2, 3]
    got = {(r["conv_id"], r["depth"]): r for r in trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 0]["n_convs"] == 2 and max(d for c, d in got if c == 1) >= 4997


def test_ends_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 7)
    rows = [(c, 0, "user", "same") for c in range(100, 400) if zlib.crc32(str(c).encode()) % 4 == 0]
    got = {r["depth"]: r for r in trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()}
    assert got[1]["ends_sha256"] == hashlib.sha256(",".join(str(c) for c, *_ in sorted(rows)).encode()).hexdigest()
    assert got[0]["ends_sha256"] == hashlib.sha256(b"").hexdigest()


def test_trie_of_nothing(spark):
    assert trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    alone = trie.trie(spark.createDataFrame([(None, 0, "user", "x")], "conv_id long, turn long, role string, text string"))
    assert alone.count() == 0
