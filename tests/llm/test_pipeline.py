"""The corpus pipeline against a plain Python version of its stages, over planted copies, passages, leaks and clean documents."""

import hashlib
import random

import corpus_pipeline
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_near_copies import plain_shingles
from test_text_operators import plain_contamination

from portage.llm import bpe


def plain_near_copies(docs):
    """The documents that stay: one of each group linked by a Jaccard similarity of 0.8 or more."""
    sets = [frozenset(plain_shingles(text)) for _, text in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if (not union or len(sets[i] & sets[j]) / union >= 0.8) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [d for i, d in enumerate(docs) if find(i) == i]


def plain_substrings(docs, window=20):
    """Texts without the windows that start earlier; those that lose nothing stay as they are, empty ones go."""
    seen, out = set(), []
    for name, text in docs:
        words, gone = (text or "").encode().split(), set()
        for i in range(len(words) - window + 1):
            run = tuple(words[i : i + window])
            if run in seen:
                gone.update(range(i, i + window))
            seen.add(run)
        if not gone:
            out.append((name, text))
        elif kept := [w for i, w in enumerate(words) if i not in gone]:
            out.append((name, b" ".join(kept).decode()))
    return out


def plain_tokens(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.vocabulary())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    out = []
    for name, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        out.append((name, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded)), ids))
    return out


def changed(draw, text):
    """The text with one word replaced: of 120 words, nine shingles in ten stay."""
    words = text.split()
    words[draw.randrange(len(words))] = "changed"
    return " ".join(words)


def corpus(spark):
    """Documents of the test data, and planted ones behind them by id: (rows, languages, ids by kind)."""
    draw = random.Random(71)
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").collect()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    vocabulary = {}
    for r in base:
        vocabulary.setdefault(r.lang, []).extend((r.text or "").split())
    speaking = [lang for lang, words in vocabulary.items() if lang and len(words) > 500]
    said = lambda lang, n: " ".join(draw.choices(vocabulary[lang], k=n))
    rows = [(r.doc_id, r.text, r.lang) for r in base]
    planted, name = {}, 100_000

    def plant(kind, text, lang):
        nonlocal name
        planted.setdefault(kind, []).append(name)
        rows.append((name, text, lang))
        name += 1

    clean = [said(lang, 120) for lang in speaking for _ in range(4)]
    for text in clean:
        plant("clean", text, None)
    for i in range(8):
        plant("switched", " ".join(said(speaking[(i + j) % len(speaking)], 40) for j in range(3)), None)
    for text in clean[:6]:
        plant("exact copy", text, None)
        plant("near copy", changed(draw, text) + " more", None)
    passage = said(speaking[0], 60)
    for _ in range(5):
        plant("passage", f"{said(speaking[0], 50)} {passage} {said(speaking[0], 50)}", None)
    for item in items[:5]:
        plant("leak", f"{said(speaking[0], 60)} {item} {said(speaking[0], 30)}", None)
    for text in ("?! 123", None, "", " \n"):
        plant("no letters", text, None)
    return rows, planted


def test_run_equals_plain_python(spark, tmp_path):
    rows, planted = corpus(spark)
    # Other columns, of which some have names that the stages use.
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS source", "CAST(length(text) AS BIGINT) AS n_chars", "1 AS row", "'k' AS kept")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    spoken = {r.doc_id for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()}
    assert not spoken & set(planted["no letters"])
    assert spoken >= {i for kind, ids in planted.items() if kind != "no letters" for i in ids}

    left = plain_near_copies([(i, t) for i, t, _ in rows if i in spoken])
    kept = {i for i, _ in left}
    assert kept >= {*planted["clean"], *planted["switched"], *planted["passage"], *planted["leak"]}
    assert not kept & {*planted["exact copy"], *planted["near copy"]}
    left = plain_substrings(left)
    cut = dict(left)
    whole = {i: t for i, t, _ in rows}
    assert all(len(cut[i].split()) <= len(whole[i].split()) - 55 for i in planted["passage"][1:])
    leaks = {r[0] for r in plain_contamination(left, items) if r[-1]}
    assert leaks >= set(planted["leak"]) and not leaks & {*planted["clean"], *planted["switched"]}
    expected = plain_tokens([d for d in left if d[0] not in leaks])

    found = corpus_pipeline.run(spark, str(tmp_path))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(tuple(r) for r in found.select(names).collect()) == sorted(r[:4] for r in expected)
    ids = next(c for c in found.columns if c not in names)
    assert {r.doc_id: list(r[ids]) for r in found.select("doc_id", ids).collect()} == {r[0]: r[4] for r in expected}


@pytest.mark.parametrize("copies", [2, 5])
def test_repeated_rows_leave_the_smallest_by_all_columns(spark, copies):
    texts = ["some words that stand in a text of their own here", "quite another text with words of its own in it"]
    rows = [(i, t, s) for i, t in zip((1, None), texts) for s in ["z", "b", "a", "c", "d"][:copies]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row", F.lit(1))
    kept = corpus_pipeline.near_dedup(spark, docs.repartition(3), SF)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.source) for r in kept.collect()) == [(0, min(rows[i][2] for i in range(copies))), (1, min(r[2] for r in rows[:copies]))]
