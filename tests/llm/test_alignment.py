"""Alignment of two tokenizers against their libraries, text by text."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from panelrisk.llm import alignment

SCHEMA = "doc_id long, text string, n_a long, codes array<long>, links long, count long, best boolean"


def texts():
    rng = random.Random(9)
    vocabulary = ["the", "theory", "Über", "naïve", "日本語", "don't", "x1y2", "3.14", "$$$", "tion", "a", ",", "–", "🙂", "É", " ", "ﬁ"]
    gaps = [" ", " ", " ", "  ", "\n", "\n\n", "\t", "   ", "", "\r\n", " \n "]
    draw = lambda n: "".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(n))
    out = [draw(rng.randint(1, 40)) for _ in range(120)] + [draw(4000), "word " * 3000]
    out += [None, "", " ", "  ", "\n", "a", " a", "a ", "a  ", "▁x", "x ▁", "a▁ b", "<|endoftext|> <s> </s> <unk> <0x41>", "a\x00b", "é", "� x", "x" * 700, "same text", "same text"]
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(k if k % 50 else None, t, 1, [2], 3, 4, True) for k, t in enumerate(texts())]
    return out + out[:2]


def plain(text, a, b, a_bytes, b_bytes):
    """Ids of either, groups as lists of ids, linked id pairs, overlapping pairs of places."""
    if not text:
        return [], [], [], [], []
    whole = (" " + text).encode()
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if b"".join(a_bytes(k) for k in ia) != whole or b"".join(b_bytes(k) for k in ib) != whole:
        return [], [], [], [], []
    ends_a, ends_b = np.cumsum([len(a_bytes(k)) for k in ia]).tolist(), np.cumsum([len(b_bytes(k)) for k in ib]).tolist()
    groups, links, i, j = [], [], 0, 0
    for e in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(e) + 1, ends_b.index(e) + 1
        groups.append((ia[i:k], ib[j:m]))
        links.append((ia[k - 1], ib[m - 1]))
        i, j = k, m
    begin = lambda ends, k: ends[k - 1] if k else 0
    pairs = [(x, y) for x in range(len(ia)) for y in range(len(ib)) if begin(ends_a, x) < ends_b[y] and begin(ends_b, y) < ends_a[x]] if len(ia) < 400 else None
    return ia, ib, groups, links, pairs


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(alignment.default_tokenizer()), SentencePieceProcessor(model_file=alignment.default_pieces())
    a.encode_special_tokens = True
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in own)}
    a_bytes = lambda k: bytes(back[c] for c in a.id_to_token(k))
    b_bytes = lambda k: bytes([k - b.piece_to_id("<0x00>")]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()
    return a, b, a_bytes, b_bytes


@pytest.mark.parametrize("limit", [1 << 18, 500])
def test_digest(spark, rows, libraries, limit):
    want = [plain(t, *libraries) for _, t, *_ in rows]
    counts = Counter(p for *_, links, _ in want for p in links)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    expected = Counter()
    for (d, *_), (ia, ib, groups, links, _) in zip(rows, want, strict=True):
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        expected[d, len(ia), len(ib), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if ia else ""] += 1
    got = alignment.alignment_digest(spark.createDataFrame(rows, SCHEMA).repartition(3), limit=limit)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == expected
    assert sum(1 for x in want if not x[0]) >= 5 and len(counts) > 50


@pytest.mark.parametrize("limit", [1 << 18, 300])
def test_lists(spark, rows, libraries, limit):
    got = alignment.alignments(spark.createDataFrame(rows, SCHEMA).coalesce(1), limit=limit).collect()
    for (d, t, *_), r in zip(rows, got, strict=True):
        ia, ib, groups, _, pairs = plain(t, *libraries)
        assert (r["doc_id"], r["a_ids"], r["b_ids"]) == (d, ia, ib)
        assert (r["a_counts"], r["b_counts"]) == ([len(x) for x, _ in groups], [len(y) for _, y in groups])
        if pairs is not None:
            assert list(zip(r["pair_a"], r["pair_b"], strict=True)) == pairs
            assert sum(r["together"]) == len(groups)


def test_pairs_are_bounded_by_suffixes(libraries):
    """Every pair of tokens that ends together is a token and a suffix of it: there are no more than the docstring says."""
    a, b, a_bytes, b_bytes = libraries
    sizes = [len(a_bytes(k)) for k in range(50_256)] + [len(b_bytes(k)) for k in range(b.get_piece_size())]
    assert sum(sizes) < 700_000


def test_intervals_coalesce():
    a, b = np.array([0, 2, 5, 9]), np.array([0, 3, 5, 7, 9])
    ends_a, ends_b = np.array([2, 5, 9, 10]), np.array([3, 5, 7, 9, 10])
    of_a, of_b, n = alignment.coalesced(a, ends_a, b, ends_b)
    assert (of_a.tolist(), of_b.tolist(), n) == ([0, 0, 1, 2], [0, 0, 1, 1, 2], 3)
    x, y = alignment.overlaps(a, ends_a, b, ends_b)
    assert list(zip(x.tolist(), y.tolist(), strict=True)) == [(0, 0), (1, 0), (1, 1), (2, 2), (2, 3), (3, 4)]
    none = np.zeros(0, np.int64)
    assert alignment.coalesced(none, none, none, none)[2] == 0


def test_nothing(spark):
    assert alignment.alignment_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    only = alignment.alignment_digest(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")).collect()
    assert [tuple(r)[1:] for r in only] == [(0, 0, 0, 0, 0, 0, "")] * 2
