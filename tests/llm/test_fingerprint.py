"""Document fingerprints against brute force: the same sketches in plain Python, and true similarities of shingle sets."""

import base64
import hashlib
import random
import re

import pytest
import xxhash
from conftest import SF
from pyspark.sql import functions as F

from portage.llm import fingerprint

DOCS = "doc_id long, text string, kid string, range int, sketch string"
K = fingerprint.SKETCH


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    runs = [words[i : i + 5] for i in range(max(1, len(words) - 4))] if words else []
    out = set()
    for run in runs:
        seed = 42
        for word in run:
            seed = xxhash.xxh64_intdigest(word.encode(), seed)
        out.add(seed - (1 << 64) if seed >> 63 else seed)
    return out


def plain_sketch(text):
    return sorted(shingles(text))[:K]


def plain_likeness(a, b):
    one, other = plain_sketch(a), plain_sketch(b)
    both = sorted({*one, *other})[:K]
    return sum(h in one and h in other for h in both) / len(both) if both else 1.0


def plain_fingerprint(text):
    return base64.b64encode(b"".join((h % (1 << 64)).to_bytes(8, "big") for h in plain_sketch(text))).decode()


def expected(rows):
    """Rows in order, each followed by the next one."""
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        out.append((
            i, len(text), hashlib.sha256(edited.encode()).hexdigest(), plain_fingerprint(text), plain_fingerprint(edited),
            plain_likeness(text, edited), plain_likeness(text, after),
        ))
    return out


def found(docs):
    rows = fingerprint.edited_likeness(docs).collect()
    return [tuple(r)[:7] for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))]


@pytest.mark.parametrize("ids", ["dense", "sparse"])
def test_query_equals_plain_python(spark, ids):
    draw = random.Random(11)
    texts = [" ".join(draw.choice(["a", "bé", "C", "d\t", "😀"]) + str(draw.randrange(40)) for _ in range(draw.randrange(400))) for _ in range(150)]
    texts += ["", " \n", "one", None, "Five words in this TEXT", "five words in this text", "x " * 5000, "w\x0b y", texts[3], texts[3]]
    draw.shuffle(texts)
    chosen = range(len(texts)) if ids == "dense" else sorted(draw.randrange(-(1 << 62), 1 << 62) for _ in texts)
    rows = list(zip(chosen, texts))
    docs = spark.createDataFrame([(*r, "k", 1, "s") for r in draw.sample(rows, len(rows))], DOCS)
    assert found(docs) == expected(rows)


def test_one_document_follows_itself_and_an_empty_table_has_no_rows(spark):
    one = spark.createDataFrame([(5, "a b c d e f g h", "k", 1, "s")], DOCS)
    assert found(one) == expected([(5, "a b c d e f g h")])
    assert found(one.limit(0)) == []


def test_rows_without_id_and_repeated_rows(spark):
    rows = [(None, f"text number {i} of those without an id") for i in range(60)] + [(1, "same row here"), (1, "same row here"), (2, None)]
    out = found(spark.createDataFrame([(*r, "k", 1, "s") for r in rows], DOCS))
    assert [r[0] for r in out] == [1, 1, 2] + [None] * 60
    assert sorted(r[3] for r in out) == sorted(plain_fingerprint(t) for _, t in rows)
    hashes = {hashlib.sha256(e.encode()).hexdigest() for e in ("same row hsam", "same row here"[:10] + "")}
    assert {out[0][2], out[1][2]} == hashes  # the first is followed by its copy, the second by a text without a word


def test_estimates_lie_near_the_truth(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = fingerprint.edited_likeness(docs).collect()
    ids = sorted(text)
    errors, counts = [], []
    for r in rows:
        t, after = text[r.doc_id], text[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        cut = len(t) // 4
        one, other = shingles(t), shingles(t[: len(t) - cut] + after[:cut])
        errors.append(abs(r.near_edited - (len(one & other) / len(one | other) if one | other else 1)))
        errors.append(abs(r.contained_edited - (len(one & other) / len(one) if one else 1)))
        counts.append(abs(r.distinct_shingles - len(one)) / max(1, len(one)))
    assert max(errors) < 0.25 and sum(errors) / len(errors) < 0.04
    assert max(counts) < 0.4 and sum(counts) / len(counts) < 0.06


def test_merged_sketches_are_those_of_all_parts(spark):
    draw = random.Random(3)
    rows = [(i, " ".join(str(draw.randrange(3000)) for _ in range(60)), "big" if i % 3 else None, 1, "") for i in range(120)] + [(500, "", "none", 1, "")]
    docs = spark.createDataFrame(rows, DOCS)
    made = fingerprint.fingerprints(docs).join(docs.select("doc_id", F.col("kid").alias("part")), "doc_id")
    whole = {r.part: r.sketch for r in fingerprint.merged(made, ["part"]).collect()}
    for part in ("big", None, "none"):
        union = set().union(*(shingles(t) for _, t, p, _, _ in rows if p == part))
        assert whole[part] == sorted(union)[:K]


def test_main_path_is_native(spark):
    plan = fingerprint.edited_likeness(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
