"""Ranked lexical search against plain Python over all documents, and bounds against true scores."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from portage.llm import lexical

DOCS = "doc_id long, text string, rows int, kid string, item string"
ITEMS = "item_id string, text string, block int, rank string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall(text.translate(LOWER)) if text else []


def plain(docs, items, top):
    """(item, rank, doc, score) by the contract's integers; rows of equal score and id in no order."""
    words = [terms(t) for _, t in docs]
    n, total = sum(1 for w in words if w), sum(map(len, words))
    df = Counter(t for w in words for t in set(w))
    out = []
    for item, text in items:
        found = []
        for (doc, _), w in zip(docs, words):
            tf, score = Counter(w), 0
            m = 75 + (25 * len(w) * n) // total if total else 0
            for t in terms(text):
                if tf[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, k, None if none else doc, -score) for k, (score, none, doc) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def corpus(draw, n, vocabulary=400, most=120):
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "été", "日本"]
    rank = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(draw.choices(words, rank, k=draw.randrange(most))) for _ in range(n)]


def searched(spark, docs, items, top=20):
    d = spark.createDataFrame([(*r, 1, "k", "i") for r in docs], DOCS).repartition(3)
    i = spark.createDataFrame([(*r, 1, "r") for r in items], ITEMS)
    found = lexical.search(d, i, top)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("seed, item_chars, block_bits", [(1, 1 << 18, 1 << 22), (2, 150, 1 << 22), (3, 1 << 18, 1 << 12)])
def test_search_equals_plain_python(spark, monkeypatch, seed, item_chars, block_bits):
    monkeypatch.setattr(lexical, "ITEM_CHARS", item_chars)
    monkeypatch.setattr(lexical, "BLOCK_BITS", block_bits)
    draw = random.Random(seed)
    texts = corpus(draw, 300)
    texts += [texts[4]] * 40 + ["", None, " .,! ", "W1 w1-W1_w2", "x " * 30_000 + "w3 " * 500, "w7" * 4000]
    docs = list(enumerate(texts)) + [(None, texts[9]), (5, texts[5])]
    items = [(f"i{k}", t) for k, t in enumerate(corpus(draw, 12, most=30))]
    items += [("copy", texts[4]), ("rare", "w399 w398"), ("none", "zzz"), ("empty", ""), ("null", None), ("twice", "w3 w3 W3 w5"), (None, "w2 w9")]
    assert searched(spark, docs, items) == plain(docs, items, 20)


def test_empty_tables(spark):
    assert searched(spark, [], [("a", "w1")]) == []
    assert searched(spark, [(1, "w1")], []) == []
    assert searched(spark, [(1, "w1"), (2, "w2 w2")], [("a", "w1"), ("a", "w1"), ("a", "w2")], top=1) == sorted(
        plain([(1, "w1"), (2, "w2 w2")], [("a", "w1"), ("a", "w2")], 1), key=repr
    )


def test_bounds_are_never_below_scores_and_rule_most_out():
    draw = random.Random(5)
    words = [terms(t) for t in corpus(draw, 2000, vocabulary=3000, most=200)]
    counts = [Counter(w.encode() for w in ws) for ws in words]
    df = Counter(t for c in counts for t in c)
    items = [" ".join(draw.sample(sorted(set(w)), min(8, len(set(w))))) for w in draw.sample([w for w in words if len(w) > 20], 20)]
    query = lexical._item_query(items, len(words), sum(map(len, words)))
    weights = np.array([math.floor(1000 * math.log((2 * len(words) + 2) / (2 * df[t] + 1))) for t in query.terms])
    query = query._replace(weights=weights)
    hashed = [(lexical._hashes(c), np.fromiter(c.values(), dtype=np.int64, count=len(c))) for c in counts]
    hashes, candidates, covered = lexical._hashes(query.terms), 0, 0
    exact = np.zeros((len(items), len(words)), dtype=np.int64)
    lengths = np.array([len(w) for w in words])
    parts = lexical.length_parts(lengths, query)
    for d, c in enumerate(counts):
        adds = np.array([lexical.contribution(int(w), c[t], int(parts[d])) if c[t] else 0 for t, w in zip(query.terms, weights)])
        exact[:, d] = [often @ adds[which] for which, often in query.items]
    threshold = np.sort(exact, axis=1)[:, -20]
    for rows, members, bits in lexical.signature_blocks(hashed):
        bounds = lexical.upper_bounds(rows, bits, lengths[members], query, hashes)
        assert (bounds >= exact[:, members]).all()
        candidates += (bounds >= threshold[:, None]).sum()
        covered += len(members)
    assert covered == sum(1 for c in counts if c)
    assert candidates < 0.05 * exact.size  # at least 1 % are the best themselves
