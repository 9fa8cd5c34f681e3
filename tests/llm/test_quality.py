"""The quality classifier rebuilt from its definition: indicators from Python sets, ratios from counts, a hinge-loss fit and a logistic fit that meet their optimality conditions."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelrisk.llm import quality

MASK = (1 << 64) - 1
GOOD, BAD = [f"Fine{k}" for k in range(200)], [f"jUNK{k}!" for k in range(60)] + ["77", "77", "$$"]


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def grams(values, orders, salt):
    """Slots of all runs of values, whose key takes 13 bits a value."""
    out = set()
    for k in orders:
        for i in range(len(values) - k + 1):
            key = 0
            for v in values[i : i + k]:
                key = (key * (1 << 13) + v) & MASK
            out.add(mix((key * 8 + salt + k) & MASK) >> (64 - quality.BITS))
    return out


def shape(word, before):
    upper, lower = sum(65 <= b <= 90 for b in word), sum(97 <= b <= 122 for b in word)
    digits, signs = sum(48 <= b <= 57 for b in word), sum(33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126 for b in word)
    s = min(upper, 2) * 3 + min(lower, 2)
    s = s * 4 + (2 if digits else 0)
    s = (s * 4 + min(signs, 3)) * 4 + min(len(word) // 4, 3)
    return s * 2 + (word == before)


def slots(text):
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    shapes = [shape(w, words[k - 1] if k else None) + 1 for k, w in enumerate(words)]
    return grams([b + 1 for b in data], (1, 2, 3), 11) | grams(shapes, (1, 2, 3, 4), 23) | {quality.SIZE - 1}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    out = [(k, text(GOOD, rng.randint(5, 30)) if k % 3 else text(BAD, rng.randint(5, 30)) + (" " + text(GOOD, 6) if k % 2 else "")) for k in range(150)]
    return out + [(150, None), (151, ""), (152, "  \n"), (153, "Éa日本 Éa日本 x"), (154, "a" * 3000)]


def test_indicators_are_those_of_sets(rows):
    column = pa.array([t for _, t in rows])
    for lo, hi, flags in quality.flagged(column):
        for k in range(lo, hi):
            assert set(np.flatnonzero(flags[k - lo]).tolist()) == slots(rows[k][1]), k


def test_scores_follow_from_the_definition(spark, rows):
    marks = [(k, int(k % 3 > 0)) for k in range(150) if k % 4]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    key = {r["doc_id"]: r["key"] for r in labels.select("doc_id", F.xxhash64("doc_id", F.lit(3)).alias("key")).collect()}
    train = sorted((k for k, _ in marks if zlib.crc32(str(k).encode()) % 5), key=key.get)
    y, own, texts = dict(marks), {k: slots(t) for k, t in rows}, dict(rows)
    fit, held = [k for i, k in enumerate(train) if i % 5 != 4], [k for i, k in enumerate(train) if i % 5 == 4]
    # log-count ratios of the rows that the model is fitted on
    counts = np.ones((2, quality.SIZE))
    for k in fit:
        counts[y[k]][list(own[k])] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[-1] = 1.0
    unit = {k: (at, ratio[at] / max(1e-12, math.sqrt((ratio[at] ** 2).sum()))) for k, at in ((k, np.array(sorted(s))) for k, s in own.items())}
    (scaled, square), a, b = quality.fitted(docs, labels)
    assert np.allclose(square, ratio**2)
    w = np.where(ratio != 0, scaled / np.where(ratio != 0, ratio, 1), 0)
    share = np.mean([y[k] for k in fit])
    cost = {k: 4 * (0.5 / share if y[k] else 0.5 / (1 - share)) for k in fit}
    sign = {k: 1.0 if y[k] else -1.0 for k in fit}
    loss = lambda w: 0.5 * w @ w + sum(cost[k] * max(0.0, 1 - sign[k] * (w[unit[k][0]] @ unit[k][1])) for k in fit)
    # the same problem by many more rounds of dual ascent in a fixed order
    best, alpha = np.zeros(quality.SIZE), dict.fromkeys(fit, 0.0)
    for _ in range(400):
        for k in fit:
            at, v = unit[k]
            new = min(max(alpha[k] - (sign[k] * (best[at] @ v) - 1) / (v @ v), 0.0), cost[k])
            best[at] += (new - alpha[k]) * sign[k] * v
            alpha[k] = new
    assert loss(w) <= 1.01 * loss(best) and sum(alpha.values()) - 0.5 * best @ best <= loss(w) + 1e-9  # between the dual and the primal optimum
    # the logistic fit of the margins of the rows held back: its gradient vanishes
    margin = {k: w[unit[k][0]] @ unit[k][1] for k in own}
    m, t = np.array([margin[k] for k in held]), np.array([y[k] for k in held], float)
    target = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
    p = 1 / (1 + np.exp(-(a * m + b)))
    assert abs(((p - target) * m).sum() + 1e-3 * a) < 1e-3 and abs((p - target).sum()) < 1e-3 and a > 0
    got = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    for k in own:
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * margin[k] + b))))
        assert abs(got[k]["score"] - want) < 1e-3, (k, texts[k])
        assert got[k]["predicted"] == int(got[k]["score"] >= 0.3) and got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0)
    right = [(got[k]["score"] >= 0.5) == bool(k % 3) for k in range(150) if got[k]["held_out"]]
    assert sum(right) >= 0.9 * len(right)
