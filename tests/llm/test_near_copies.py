"""Near copies of the pipeline: planted at known similarities, against shingle sets compared in plain Python."""

import random
from itertools import pairwise

import corpus_pipeline
import pytest
from conftest import SF

from portage.llm import simhash


def plain_shingles(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def similarity(a, b):
    one, other = plain_shingles(a), plain_shingles(b)
    return len(one & other) / len(one | other)


def planted(draw, least, most, pairs, words=450):
    """Texts in pairs whose similarity lies in the given range: words of the copy are replaced at random."""
    out = []
    while len(out) < 2 * pairs:
        text = [f"w{draw.randrange(5000)}" for _ in range(words)]
        copy = [f"x{draw.randrange(5000)}" if draw.random() < draw.uniform(0.001, 0.03) else w for w in text]
        if least <= similarity(" ".join(text), " ".join(copy)) < most:
            out += [" ".join(text), " ".join(copy)]
    return out


def copies_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, {r.kid: r.root for r in simhash.near_copies(docs).collect()}


def test_planted_copies_are_linked_from_the_threshold_on(spark):
    draw = random.Random(61)
    bands = [(0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.0), (0.7, 0.79)]
    texts = [t for low, high in bands for t in planted(draw, low, high, 60)]
    docs, root = copies_of(spark, texts)
    linked = [sum(root[i] == root[i + 1] for i in range(120 * n, 120 * (n + 1), 2)) / 60 for n in range(5)]
    print("linked by band", list(zip(bands, linked)))
    assert linked[0] >= 0.9 and min(linked[1:4]) >= 0.98 and linked[4] == 0
    assert all(root[i] != root[j] for i, j in pairwise(range(1, 600, 2)))
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert kept == {min(i for i in root if root[i] == r) for r in root.values()}


def test_components_hold_pairs_that_no_centre_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 7)
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    monkeypatch.setattr(simhash, "PIECE_BYTES", 10_000)
    draw = random.Random(67)
    texts, words = [], [f"w{i}" for i in range(200)]
    for step in range(40):  # a drifting text: neighbours are copies, the ends are not
        texts.append(" ".join(words))
        words[draw.randrange(200)] = f"x{step}"
    assert similarity(texts[0], texts[-1]) < 0.5
    _, root = copies_of(spark, [*texts, "", None, " \n", "short text", "Short  TEXT", "other text"])
    assert len({root[i] for i in range(40)}) == 1
    assert root[40] == root[41] == root[42] and root[43] == root[44]
    assert len(set(root.values())) == 4


@pytest.mark.parametrize("size", [0, 1, 4, 5, 300, 1000])
def test_shingles_are_the_distinct_runs_of_words(size):
    text = " ".join(f"w{i % 271}" for i in range(size))
    assert len(simhash.shingles(text.encode(), 5)) == len(plain_shingles(text))


def test_rows_move_once_for_all_keys_of_a_block(spark):
    """Keys are those of every two blocks, and a row is repeated for its keys behind the exchange and not before it."""
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(30)]
    edges = [round(i * 64 / simhash.PARTS) for i in range(simhash.PARTS + 1)]
    rows = [(n, seed, simhash.signed(fp), 0) for n, fp in enumerate(fps) for seed in (0, 7)]
    led = simhash._led(spark.createDataFrame(rows, "node long, seed int, fp long, check long"))
    keys = {}
    for r in simhash._keyed(led).collect():
        keys.setdefault(r["key"], set()).add((r["node"], r["fp"]))
    blocks = {
        (seed, i, j, *(fp >> edges[k] & (1 << (edges[k + 1] - edges[k])) - 1 for k in (i, j)))
        for _, seed, signed, _ in rows for fp in [signed % (1 << 64)] for i in range(simhash.PARTS) for j in range(i)
    }
    assert len(keys) == len(blocks) and min(keys) >= 0
    assert sum(map(len, keys.values())) == len(rows) * 15
    nodes = spark.createDataFrame([(n, [simhash.signed(rng.getrandbits(64)) for _ in range(8)]) for n in range(20)], "node long, fps array<long>")
    plan = simhash._families(nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2
    assert plan.index("Generate explode") < plan.index("RepartitionByExpression [lead") < plan.rindex("Generate explode")
