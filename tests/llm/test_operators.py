"""Every operator against a brute-force version, over texts with nulls, empties, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from panelrisk.llm import components, decontam, encode, mixing, neardup, quality, substring, suffix_array, token_counts, token_files, vectors
from panelrisk.llm.store import shared_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, th long, size long, h string, uid int, score double, sha string, component int"


def texts():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)] + ["Éa", "ñu.", "x's", "9.5", "日本"]
    draw = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, original = draw(130), draw(200)
    near = original.split()
    near[17] = "changed"
    out = [draw(rng.randint(1, 90)) for _ in range(25)]
    out += [original, " ".join(near), original, draw(20) + " " + passage + " " + draw(5), draw(3) + "\n" + passage, passage + "  " + draw(70), passage[100:700]]
    out += [None, "", "   \t\n", "one", "one", "De " * 400, "a\x0bb\x0cc\r\nd", "<|endoftext|> x", draw(6000), " ".join(["tail", *passage.split()[40:95]]), "ÀÉ ÀÉ", "  b  c", "don't 'll I'm 12ab ab12 $$.. ,,a"]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(k if k != 9 else None, t, "en", f"s{k % 4}" if k % 7 else None, 0, 1, 2, 3, "h", 4, 0.5, "sha", 6) for k, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def crc5(d):
    return -1 if d is None else zlib.crc32(str(d).encode()) % 5


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_token_files(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.default_tokenizer())
    path = shared_path(spark, "test-tokens")
    got = by_id(token_files.token_digest(docs, path))
    start = 0
    for d, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        r = got[d]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    found = token_files.read_token_files(spark, path, [3, 5])
    assert sorted(r["doc_id"] for r in found.collect()) == [3, 5]
    assert [r["ids"] for r in found.where("doc_id = 3").collect()] == [[*t.encode(rows[3][1], add_special_tokens=False).ids, 0]]
    assert token_files.token_digest(empty, shared_path(spark, "test-tokens")).count() == 0


def test_repeated_rows_keep_their_places(spark, docs, rows):
    twice = docs.where("doc_id = 3").unionAll(docs.where("doc_id = 3")).unionAll(docs.where("doc_id = 5"))
    got = token_files.token_digest(twice, shared_path(spark, "test-tokens")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [3, 3, 5] and got[1]["start"] == got[0]["n_tokens"] and got[0]["ids_crc32"] == got[1]["ids_crc32"]


def test_encoder_forgets_without_changing_results(monkeypatch):
    from tokenizers import Tokenizer

    import pyarrow as pa

    t, own = Tokenizer.from_file(encode.default_tokenizer()), encode.Encoder(encode.default_tokenizer())
    monkeypatch.setattr(encode, "ENTRIES", 50)
    monkeypatch.setattr(encode.T.pieces, "__defaults__", (200,))
    given = [x or "" for x in texts()]
    got = {}
    for lo, hi, counts, ids in own.rows(pa.array(given)):
        for k, part in zip(range(lo, hi), np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            got[k] = part.tolist()
    assert all(got[k] == t.encode(x, add_special_tokens=False).ids for k, x in enumerate(given))


def test_spaces_at_the_end_of_a_text_stay_together(tmp_path):
    """A vocabulary with a token of two spaces, whatever the next text begins with."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    import pyarrow as pa

    t = Tokenizer(models.BPE(vocab={"Ġ": 0, "a": 1, "ĠĠ": 2}, merges=[("Ġ", "Ġ")]))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    t.save(str(tmp_path / "two_spaces.json"))
    given = ["a  ", "a", "  ", "", " a", " ", "a   ", "a"]
    ((_, _, counts, ids),) = encode.Encoder(str(tmp_path / "two_spaces.json")).rows(pa.array(given))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in given]


def targets(sizes):
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight, total, held, free = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, sum(sizes.values()), {}, set(order)
    while free:
        share = {s: (total - sum(held.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return held | share
        for s in over:
            held[s] = 3.0 * sizes[s]
            free.discard(s)
    return held


def test_mixing(spark, docs, rows, empty):
    got = mixing.mix_digest(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORDS.findall(r[1] or ""))
    want = targets(sizes)
    for r in got:
        text = next(x[1] for x in rows if x[0] == r["doc_id"])
        assert r["size"] == len(WORDS.findall(text or "")) and r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        rate = r["target"] / r["source_size"]
        assert r["size"] * math.floor(rate + 1e-9) <= r["taken"] <= min(3, math.floor(rate) + 1) * r["size"]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_digest(docs.repartition(7)).collect()))
    mix = mixing.mix(docs)
    assert mix.columns == docs.columns
    taken = Counter(r["doc_id"] for r in mix.collect())
    assert all(taken[r["doc_id"]] * r["size"] == r["taken"] for r in got)
    assert mixing.mix_digest(empty).count() == 0 and mixing.mix(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_targets_against_iteration(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{k}": int(10 ** rng.uniform(0, 5)) for k in range(rng.randint(1, 12))} | ({None: 50, "zero": 0} if seed % 2 else {})
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    assert all(math.isclose(got[s], v, rel_tol=1e-9, abs_tol=1e-9) for s, v in targets(sizes).items())


def test_quality(spark, docs, empty):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["the", "of", "and", "house", "river", "walks."]) + rng.choice(["", "s"]) for _ in range(60)) for _ in range(150)]
    bad = [" ".join(rng.choice(["buy", "now", "###", "the"]) + rng.choice(["$$$", "%%%"]) for _ in range(60)) for _ in range(150)]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate([*good, *bad])] + [(900, None), (901, ""), (None, "the house")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 150), 0) for k in range(300)] + [(5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality(frame, labels).collect()}
    assert len(got) == 303 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [r for d, r in got.items() if d is not None and d < 300 and r["held_out"]]
    assert len(held) > 30 and all(r["predicted"] == int(r["doc_id"] < 150) for r in held)
    assert all(got[d]["held_out"] == (crc5(d) == 0) for d in got)
    kept = quality.accepted(frame.withColumn("score", frame["doc_id"]), labels)
    assert kept.columns == ["doc_id", "text", "score"] and {r["doc_id"] for r in kept.where("doc_id < 300").collect()} >= set(range(150))
    assert {r["score"] for r in quality.quality(frame, labels.where("quality = 1")).collect()} == {0.5}
    assert quality.quality(empty, labels).count() == 0
    assert quality.quality(docs, labels.limit(0)).count() == docs.count()


def test_flags_and_sketches_of_short_texts_are_made_in_blocks(monkeypatch):
    import pyarrow as pa

    given = ["", "one", "A b 9.", None, "x " * 40] * 30
    whole = quality.indicators(*quality.T.buffers(pa.array(given)))
    got = list(quality.flagged(pa.array(given)))
    assert max(hi - lo for lo, hi, _ in got) <= quality.ROWS and (np.concatenate([f for *_, f in got]) == whole).all()
    rows, h, weights, _, _ = neardup.shingles(*quality.T.buffers(pa.array(given)))
    together = neardup.sketches(rows, h, weights, len(given))
    monkeypatch.setattr(neardup, "TOGETHER", 7)
    assert (neardup.sketches(rows, h, weights, len(given)) == together).all()


def test_dual_descent_meets_the_optimality_conditions():
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((60, 5)), np.where(rng.random(60) < 0.5, 1.0, -1.0)
    rows = [(np.arange(5), v) for v in x]
    w = quality.dual_descent(rows, y, np.full(60, 0.3), 5, rounds=2000)
    objective = lambda w: 0.5 * w @ w + 0.3 * np.maximum(0, 1 - y * (x @ w)).sum()
    assert all(objective(w) <= objective(w + 1e-2 * rng.standard_normal(5)) + 1e-6 for _ in range(50))


def removed_words(rows, window):
    first = {}
    words = {d: WORDS.findall(t or "") for d, t in rows}
    key = lambda d: 2**63 if d is None else d
    for d in sorted(words, key=key):
        for k in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][k : k + window]), d)
    for d, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if key(first[tuple(w[k : k + window])]) < key(d):
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        yield d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept


@pytest.mark.parametrize(("window", "base"), [(50, 25), (50, 13), (8, 2), (50, 50)])
def test_substring_dedup(docs, rows, empty, window, base):
    got = by_id(substring.substring_digest(docs, window, base))
    for d, n, gone, sha, _ in removed_words([r[:2] for r in rows], window):
        r = got[d]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, sha), d
    assert substring.substring_digest(empty, window, base).count() == 0


def test_substring_dedup_keeps_columns_and_repeated_rows(docs, rows):
    out = substring.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    for d, _, gone, _, kept in removed_words([r[:2] for r in rows], 50):
        assert left[d] == (kept if gone else next(r[1] for r in rows if r[0] == d))
    twice = docs.unionAll(docs)
    assert substring.substring_digest(twice).count() == 2 * len(rows)


@pytest.mark.parametrize(("size", "gram"), [(400, 100), (60, 20), (30, 30)])
def test_suffix_dedup(docs, rows, empty, size, gram):
    got = by_id(suffix_array.suffix_digest(docs, size, gram))
    raw = {d: (t or "").encode() for d, t, *_ in rows}
    c = Counter(b[k : k + size] for b in raw.values() for k in range(len(b) - size + 1))
    for d, b in raw.items():
        cover = np.zeros(len(b), bool)
        for k in range(len(b) - size + 1):
            if c[b[k : k + size]] > 1:
                cover[k : k + size] = True
        kept = bytes(x for x, g in zip(b, cover, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if cover[k] and not (k and cover[k - 1]))
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()), d
    left = by_id(suffix_array.remaining(docs, size, gram))
    assert all(hashlib.sha256(bytes(left[d]["kept"])).hexdigest() == got[d]["kept_sha256"] for d in raw)
    assert suffix_array.suffix_digest(empty, size, gram).count() == 0


def test_suffix_dedup_of_copies_in_two_chunks(spark):
    rng = random.Random(11)
    draw = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    copied = [draw(900) for _ in range(16)]
    beside = [draw(300) + a[200:650] + draw(250) for a in copied]
    given = [*enumerate(copied), *((50 + k, "short") for k in range(16)), *((100 + k, a) for k, a in enumerate(copied)), *((200 + k, b) for k, b in enumerate(beside))]
    got = by_id(suffix_array.suffix_digest(spark.createDataFrame(spark.sparkContext.parallelize(given, 2), "doc_id long, text string")))  # the copies are in different chunks
    assert [got[200 + k]["n_spans"] for k in range(16)] == [1] * 16
    assert all(450 <= got[200 + k]["n_removed"] <= 454 for k in range(16)) and all(got[k]["n_removed"] == 900 for k in range(16))


def test_suffix_dedup_deals_out_hot_anchors(spark, docs, rows, empty, monkeypatch):
    rng = random.Random(12)
    draw = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = draw(500)
    given = [(k, draw(rng.randrange(300, 600)) + passage + draw(300)) for k in range(300)]
    frame = spark.createDataFrame(given, "doc_id long, text string")
    monkeypatch.setattr(suffix_array, "HOT", 50)
    n_bytes = sum(len(t) for _, t in given)
    hot = suffix_array.hot_anchors(suffix_array.keyed(frame), n_bytes, 400, 100)
    assert len(hot) > 0
    every = suffix_array.anchors(suffix_array.keyed(frame), 400, 100, 8)
    packed = suffix_array.stretches(suffix_array.keyed(frame).join(every, "id").select("text", "id", "runs"), 400, 100, 8, hot)
    sizes = [len(r["lengths"]) // 4 for r in packed.where("anchors IS NOT NULL").collect()]
    assert sum(sizes) < 300 / 2 and packed.where("anchors IS NULL").count() > 0
    got = by_id(suffix_array.suffix_digest(frame))
    assert all(500 <= got[k]["n_removed"] <= 510 and got[k]["n_spans"] == 1 for k, _ in given)
    monkeypatch.setattr(suffix_array, "HOT", 1)
    test_suffix_dedup(docs, rows, empty, 60, 20)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6, 7, 50, 301])
@pytest.mark.parametrize("letters", [1, 2, 4])
def test_suffix_order(n, letters):
    s = np.random.default_rng(n).integers(1, letters + 1, n)
    for depth in (1, 2, 7):
        order = suffix_array.suffix_order(s, depth)
        heads = [s[k : k + 3**depth].tolist() for k in order]
        assert sorted(order.tolist()) == list(range(n)) and all(a <= b for a, b in zip(heads, heads[1:], strict=False))


def similarity(a, b):
    total = 0.0
    kinds = Counter((a[k], b[k]) for k in a.keys() | b.keys())
    for x, y in kinds:
        if x and y:
            total += kinds[x, y] / sum(m * max(p / x, q / y) for (p, q), m in kinds.items())
    return total


def grams(text, k=5):
    w = WORDS.findall(text or "")
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])


@pytest.mark.parametrize(("block", "words"), [(neardup.BLOCK, neardup.BLOCK_WORDS), (3, 10**6), (256, 300)])
def test_near_dedup(spark, docs, rows, empty, monkeypatch, block, words):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BLOCK_WORDS", words)
    rng = random.Random(3)
    original = [f"q{rng.randrange(500)}" for _ in range(120)]
    more = []
    for k in range(60):
        w = list(original)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        more.append((1000 + k, " ".join(w)))
    everything = [r[:2] for r in rows] + more
    frame = spark.createDataFrame(everything, "doc_id long, text string").withColumn("uid", neardup.F.lit("x"))
    sets, root = [grams(t) for _, t in everything], list(range(len(everything)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and similarity(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    key = lambda d: 2**63 if d is None else d
    least = {}
    for k, (d, _) in enumerate(everything):
        least[find(k)] = min(least.get(find(k), d), d, key=key)
    got = {r["doc_id"]: r for r in neardup.neardup_digest(frame).collect()}
    for k, (d, _) in enumerate(everything):
        assert got[d]["class_id"] == least[find(k)] and got[d]["kept"] == (d == least[find(k)]), d
    left = neardup.one_of_each(frame)
    assert left.columns == frame.columns and sorted(key(r["doc_id"]) for r in left.collect()) == sorted(map(key, least.values()))
    again = neardup.one_of_each(frame.unionAll(frame)).where(neardup.F.col("text").rlike("[^ \t\n]"))
    assert sorted(key(r["doc_id"]) for r in again.collect()) == sorted({key(d) for k, d in least.items() if grams(everything[k][1])} )
    assert neardup.neardup_digest(empty).count() == 0


def test_similar_texts_share_their_rarest_shingle():
    rng = np.random.default_rng(4)
    often = rng.integers(0, 50, neardup.COUNTERS)
    met = 0
    for _ in range(300):
        n = int(rng.integers(1, 60))
        h = np.unique(rng.integers(1, 2**63, n + 20, dtype=np.uint64))
        a, b = (np.sort(rng.permutation(h)[: max(1, len(h) - int(rng.integers(0, 5)))]) for _ in range(2))
        wa, wb = ((v % np.uint64(3)).astype(np.int64) + 1 + (rng.random(len(v)) < 0.02) for v in (a, b))
        first, second = neardup.rare_shingles(a, wa, often), neardup.rare_shingles(b, wb, often)
        assert len(first) < len(a) or len(a) < 5
        if neardup.probability_jaccard((a, wa), (b, wb)) >= 0.8:
            both = np.intersect1d(a, b)
            rarest = both[neardup.by_rarity(both, often)[0]]
            assert rarest in first and rarest in second
            met += 1
    assert met > 30


def test_a_common_passage_brings_no_texts_together(spark, monkeypatch, tmp_path):
    """Texts of which three quarters are one passage: crowded buckets, no copies but the planted ones, and few rows to compare."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(90)]
    texts = [" ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(30)]) for _ in range(300)]
    texts += [t.rsplit(" ", 1)[0] + " other" for t in texts[:20]]
    made = {}

    def kept(df, name):
        made[name] = written(df, name)
        return made[name]

    written = neardup.written
    monkeypatch.setattr(neardup, "written", kept)
    got = {r["doc_id"]: r["class_id"] for r in neardup.neardup_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: k if k < 300 else k - 300 for k in range(320)}
    assert made["open-buckets"].groupBy("key").count().where("count > 40").count()
    assert made["crowded-texts"].count() > 200
    crowd = made["rare-shingles"].groupBy("key").count().agg({"count": "max"}).first()[0]
    assert crowd is None or crowd <= 3


def test_buckets_are_compared_without_their_leader(spark, monkeypatch):
    """Two texts that share a bucket were compared when one of them led it; they do not travel again."""
    rng = random.Random(9)
    texts = []
    for k in range(60):
        words = [f"w{k}x{rng.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join(words), " ".join(words[:50] + [f"v{k}x{j}" for j in range(10)])]
    made = {}

    def kept(df, name):
        made[name] = written(df, name)
        return made[name]

    written = neardup.written
    monkeypatch.setattr(neardup, "written", kept)
    got = {r["doc_id"]: r["class_id"] for r in neardup.neardup_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: k for k in range(120)}
    assert made["open-buckets"].count() > 20 and made["compared-buckets"].count() == 0


def test_keys_of_the_same_texts_are_compared_once(spark):
    rows = [(k, 10 - k, uid, c) for k, uids in {1: "ab", 2: "ab", 3: "abc", 4: "aa", 5: "bc"}.items() for uid, c in enumerate(uids)]
    rows += [(6, 4, 0, "a"), (6, 4, 7, "b")]
    frame = spark.createDataFrame(rows, "key long, band int, uid long, component string")
    left = neardup._of_different_texts(frame, ["band"]).collect()
    # 1, 2 and 5 hold the texts 0 and 1; 4 is in one component
    assert Counter(r["key"] for r in left) == {5: 2, 3: 3, 6: 2}


def test_blocks_of_one_component_meet_those_of_others_alone(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = [(1, uid, 0 if uid < 200 else uid, 10) for uid in range(220)] + [(2, uid, uid, 10) for uid in range(30)] + [(3, 0, 0, 10), (3, 250, 250, 10)]
    met = neardup._in_blocks(spark.createDataFrame(rows, "key long, uid long, component long, n_words long")).collect()
    pairs = Counter()
    for key, lo, hi in {(r["key"], r["lo"], r["hi"]) for r in met}:
        own = [r for r in met if (r["key"], r["lo"], r["hi"]) == (key, lo, hi)]
        x, y = ([r for r in own if r["part"] == side] for side in (lo, hi))
        pairs.update({(key, *sorted((i["uid"], j["uid"]))) for i in x for j in y if i["component"] != j["component"]})
    every = {(k, *sorted((u, v))) for k, u, c, _ in rows for m, v, d, _ in rows if k == m and c != d}
    assert set(pairs) == every and set(pairs.values()) == {1}
    # 20 other texts are three blocks, which each text of the large component meets once
    assert sum(r["key"] == 1 and r["uid"] < 200 for r in met) == 600


def test_probability_jaccard():
    rng = random.Random(0)
    for _ in range(50):
        a, b = (Counter({k: rng.randint(1, 3) for k in rng.sample(range(30), rng.randint(1, 20))}) for _ in range(2))
        pack = lambda c: (np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)], np.int64))
        assert math.isclose(neardup.probability_jaccard(pack(a), pack(b)), similarity(a, b), abs_tol=1e-12)


def test_sketches_estimate_the_similarity():
    rng = np.random.default_rng(2)
    n, errors = 80, []
    for _ in range(20):
        h = rng.integers(1, 2**63, n, dtype=np.uint64)
        wa, wb = rng.integers(1, 4, n), rng.integers(1, 4, n)
        own = [neardup.sketches(np.zeros(n, np.int64), h, w, 1)[0] for w in (wa, wb)]
        errors.append((own[0] == own[1]).mean() - similarity(Counter(dict(enumerate(wa.tolist()))), Counter(dict(enumerate(wb.tolist())))))
    assert abs(np.mean(errors)) < 0.03


def test_components(spark):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(0, 40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)] + [(7, 7)]
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: find(k) for k in got} and set(got) == {x for a, b in links if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.default_tokenizer())
    sizes = [len(t.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    got = token_counts.length_histogram(token_counts.token_lengths(docs))
    for r in got.collect():
        n = r["n_tokens"]
        assert r["n_docs"] == sizes.count(n) and r["docs_from"] == sum(s >= n for s in sizes) and r["tokens_from"] == sum(s for s in sizes if s >= n)
        assert r["truncated_total"] == sum(min(s, n) for s in sizes) and math.isclose(r["cum_share"], sum(s <= n for s in sizes) / len(sizes))
    one = token_counts.summary(got, [10, 100]).first()
    assert one["tokens"] == sum(sizes) and one["left_at_10"] == sum(min(s, 10) for s in sizes) and one["p50"] == sorted(sizes)[(len(sizes) - 1) // 2]
    assert token_counts.length_histogram(token_counts.token_lengths(empty)).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((12, 16))
    own = [b + 0.15 * rng.standard_normal(16) * np.abs(b) for b in base for _ in range(12)] + list(rng.standard_normal((60, 16)))
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(own)]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, None), (503, [0.0] * 16), (504, [float("nan")] * 16), (505, [1.0, None] * 8), (506, []), (507, [1.0, 2.0]), (508, [2.0, 4.0]), (509, [float("inf")] * 16), (None, rows[7][1])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, uid string")
    got = {r["vec_id"]: r for r in vectors.vector_classes(frame).collect()}
    good = {d: np.array(np.float32(v), float) for d, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {d: [e for e in good if e != d and len(good[e]) == len(good[d]) and good[d] @ good[e] / np.sqrt((good[d] @ good[d]) * (good[e] @ good[e])) >= 0.9] for d in good}
    found = sum(got[d]["n_links"] for d in good)
    assert len(got) == len(rows) and found >= 0.9 * sum(map(len, links.values())) and all(got[d]["n_links"] <= len(links[d]) for d in good)
    for d in got:
        if d not in good:
            assert got[d]["n_links"] == 0 and got[d]["component_id"] == d and got[d]["kept"]
    assert got[501]["component_id"] == got[500]["component_id"] == got[3]["component_id"] and got[508]["component_id"] == 507
    assert vectors.vector_classes(frame.limit(0)).count() == 0
    again = vectors.vector_classes(frame.repartition(5)).collect()
    assert sum(r["n_links"] for r in again) == sum(r["n_links"] for r in got.values())


def test_a_full_cell_is_compared_in_blocks(spark, monkeypatch):
    """One cell holds all vectors; blocks of a few make the same links as all pairs."""
    monkeypatch.setattr(vectors, "FILED", 7)
    monkeypatch.setattr(vectors, "VISITING", 5)
    rng = np.random.default_rng(12)
    v = rng.standard_normal((90, 6))
    v[40:80] = v[40] + 0.3 * rng.standard_normal((40, 6))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = ((unit @ unit.T) >= 0.9).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in vectors.vector_classes(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()}
    assert [got[k] for k in range(90)] == want.tolist() and want.max() > 20


def test_traversal_visits_the_nearest_cells():
    rng = np.random.default_rng(0)
    books, v = (rng.standard_normal((9, 3)), rng.standard_normal((9, 4))), rng.standard_normal((40, 7))
    sums = (vectors.distances(v[:, :3], books[0])[:, :, None] + vectors.distances(v[:, 3:], books[1])[:, None, :]).reshape(40, -1)
    for n in (1, 5, 30, 81):
        got = vectors.traversal(v, books, n)
        assert np.allclose(np.take_along_axis(sums, got, axis=1), np.sort(sums, axis=1)[:, :n])


CLEAN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


@pytest.mark.parametrize("block", [200_000, 7])
def test_decontamination(spark, docs, rows, empty, block):
    words = lambda t: CLEAN.findall((t or "").translate(LOW))
    some = next(r[1] for r in rows if r[1] and len(r[1].split()) > 60)
    items = [(1, " ".join(some.split()[5:25]).upper()), (2, "one"), (3, None), (4, ""), (5, "Do not find me in any of the texts here at all"), (12, " ".join(some.split()[18:40])), (None, " ".join(next(r[1] for r in rows if r[1] and 60 < len(r[1].split()) and r[1] != some).split()[:12])), (1, "ÀÉ")]
    frame = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, th string")
    patterns = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            patterns.setdefault(tuple(w[k : k + 10]), set()).update({str(i)} if i is not None else ())
    got = by_id(decontam.contamination(docs, frame, block=block))
    bad = set()
    for d, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(p) for p in patterns}:
            for k in range(len(w) - n + 1):
                if (p := patterns.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= p
        r = got[d]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit)), d
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        bad |= {d} if hit else set()
    kept = decontam.decontaminated(docs, frame, block=block)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - bad and bad
    assert decontam.contamination(empty, frame, block=block).count() == 0
    assert not decontam.contamination(docs, frame.limit(0)).where("contaminated").count()


def test_texts_without_candidates_are_not_joined(spark):
    from panelrisk.llm import neardup
    from panelrisk.llm.store import keyed

    docs = keyed(spark.createDataFrame([(k if k % 7 else None, f"text {k}" if k % 5 else None) for k in range(5000)], "doc_id long, text string"))
    wanted = docs.where("xxhash64(text, doc_id) % 20 = 0").select("id", "th")
    kept = neardup._held(docs, wanted)
    assert kept.join(wanted, ["id", "th"], "left_semi").count() == docs.join(wanted, ["id", "th"], "left_semi").count() > 0
    assert wanted.count() <= kept.count() < 1500
    assert neardup._held(docs, wanted.limit(0)).count() == 0
