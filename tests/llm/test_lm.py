"""LM scores against a suffix tree of dictionaries."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelrisk.llm import suffix_tree

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
END = None


def held_out(d):
    return d is not None and zlib.crc32(str(d).encode()) % 5 == 1


def brute(rows, depth, gain, discount, least=2):
    """For each row: id, tokens, known tokens, base score, score."""
    texts = [(d, [*(t or "").encode().translate(LOW).split(), END]) for d, t in rows]
    train = [t for d, t in texts if not held_out(d)]
    counts = Counter(tuple(t[k : k + n]) for t in train for n in range(1, depth + 2) for k in range(len(t) - n + 1))
    words = Counter(x for t in train for x in t)
    total = sum(words.values())
    scale = total + 0.5 * (len(words) + 1)
    after = defaultdict(list)
    for s in counts:
        if len(s) > 1:
            after[s[:-1]].append(s[-1])

    def rest(c):
        known = [w for w in after[c] if counts[(*c, w)] >= least]
        return (counts[c] - sum(counts[(*c, w)] for w in known) + discount * len(known)) / counts[c]

    rests = {c: rest(c) for c in after if counts[c] >= least}

    def p(c, w):
        if not c:
            return (words[w] + 0.5) / scale
        own = (counts[(*c, w)] - discount) / counts[c] if counts[(*c, w)] >= least else 0.0
        return own + rests[c] * p(c[1:], w)

    states = {c for c in rests if sum(counts[(*c, w)] * math.log(p(c, w) / p(c[1:], w)) for w in after[c]) >= gain}

    def score(t):
        out = 0.0
        for k, w in enumerate(t):
            c = max((tuple(t[k - n : k]) for n in range(min(k, depth) + 1) if not n or tuple(t[k - n : k]) in states), key=len)
            out += math.log10(p(c, w))
        return out

    return [(d, len(t), sum(words[x] > 0 for x in t), sum(math.log10(p((), x)) for x in t), score(t)) for d, t in texts], total, states, rests


def corpus():
    rng = random.Random(8)
    common = [f"c{k}" for k in range(12)]
    texts = []
    for _ in range(60):
        words = []
        while len(words) < rng.choice([5, 40, 120]):
            words += rng.choice([["the", "end", "of", "the"], ["one", "of", "the"], [rng.choice(common)], ["The", "Quick", rng.choice(common)], [f"r{rng.random()}"]])
        texts.append(" ".join(words))
    texts += [None, "", "  \t", texts[0], texts[0], "ÉÀ the end of the", "x" * 3000, "the " * 2000]
    return [(k if k != 9 else None, t) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def scores(frame, **options):
    return {r["doc_id"]: r.asDict() for r in suffix_tree.lm_scores(frame, **options).collect()}


@pytest.mark.parametrize(("depth", "gain", "hot", "chunk"), [(3, 2.0, 10**9, 10**6), (3, 12.0, 10**9, 300), (3, 2.0, 2, 300), (3, 12.0, 20, 500), (3, 2.0, 200, 500), (1, 2.0, 30, 300), (2, 5.0, 10**9, 500)])
def test_scores(spark, rows, monkeypatch, depth, gain, hot, chunk):
    monkeypatch.setattr(suffix_tree, "CHUNK", chunk)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, total, states, _ = brute(rows, depth, gain, 0.5)
    assert len(states) > 5
    got = scores(frame, depth=depth, gain=gain, hot=hot)
    assert len(got) == len(rows)
    for d, n, known, base, score in want:
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, held_out(d)), d
        assert math.isclose(r["base_score"], base, rel_tol=1e-9), d
        assert math.isclose(r["score"], score, rel_tol=1e-9, abs_tol=1e-9), d


def test_distributions_sum_to_one(rows):
    _, _, states, rests = brute(rows, 3, 2.0, 0.5)
    assert states and all(0 < rests[c] <= 1 for c in states)


def test_numbers_of_words_above_32_bits():
    words = np.array([0, 5, 2**40, 5, 0, 2**33, 2**40])
    small = suffix_tree._narrow(words)
    assert small.max() < 2**32 and small[0] == small[4] == 0 and small[1] == small[3] and small[2] == small[6] and len(set(small.tolist())) == 4


def test_edges(spark):
    schema = "doc_id long, text string, chunk string, bucket int, score double"
    assert suffix_tree.lm_scores(spark.createDataFrame([], schema)).count() == 0
    held = next(k for k in range(100) if held_out(k))
    r = scores(spark.createDataFrame([(held, "a b", "c", 1, 0.5)], schema))[held]
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0.0, 0.0)
    twice = suffix_tree.lm_scores(spark.createDataFrame([(None, None, "c", 1, 0.5)] * 3 + [(held, None, "c", 1, 0.5)], schema)).collect()
    assert sorted(r["n_tokens"] for r in twice) == [1] * 4 and {r["train_tokens"] for r in twice} == {3}


def test_sequences_seen_twice_count_at_every_size(spark):
    words = np.char.add("v", np.random.default_rng(5).integers(0, 50_000, 3_200_000).astype(str))
    planted = " ".join(f"planted{k}" for k in range(40))
    ids = [k for k in range(100) if not held_out(k)][:34]
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in zip(ids, np.split(words, 32), strict=False)] + [(ids[32], planted), (ids[33], planted)], "doc_id long, text string")
    got = scores(frame)[ids[33]]
    assert got["train_tokens"] > 3_000_000 and got["base_score"] < -200 and got["score"] > -60
