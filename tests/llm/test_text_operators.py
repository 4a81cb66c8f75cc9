"""The text operators against brute force, and their defined results for odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import SF
from pyspark.sql import functions as F

from portage.session import stage
from portage.llm import bpe, decontaminate, langid, simhash, substring
from portage.llm.common import components, gram_hashes, winnow, word_hashes

DOCS = "doc_id long, text string, lang string, fp string, kid string, kh string, fingerprint int"


def documents(spark, texts, first=1):
    """Documents with other columns whose names the operators use themselves."""
    return spark.createDataFrame([(first + i, t, "en", "x", "y", "z", 1) for i, t in enumerate(texts)], DOCS)


def odd(spark):
    long = " ".join(f"word{i % 977} {i}" for i in range(60_000))
    rows = [(1, "a b c d e"), (2, None), (3, ""), (4, " \t\n"), (None, "a b c d e"), (1, "a b c d e"), (1, "other text here"), (5, long), (6, "!?")]
    return spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], DOCS)


# Shared helpers -----------------------------------------------------------------------------------------------


def test_winnowing_finds_every_shared_window():
    draw = random.Random(1)
    for _ in range(200):
        shared = [b"%d" % draw.randrange(50) for _ in range(10)]
        places = []
        for _ in range(2):
            words = [b"x%d" % draw.randrange(9) for _ in range(draw.randrange(8))]
            text = words + shared + [b"y%d" % draw.randrange(9) for _ in range(draw.randrange(8))]
            chosen = set(winnow(gram_hashes(word_hashes(text), 5), 6).tolist())
            places.append({p - len(words) for p in chosen if len(words) <= p <= len(words) + 5})
        assert places[0] & places[1]


def test_winnow_takes_the_last_of_equal_grams():
    assert winnow(np.array([5, 1, 1, 7, 9], dtype=np.uint64), 3).tolist() == [2, 2, 2]
    assert winnow(np.array([5], dtype=np.uint64), 3).tolist() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# SimHash ------------------------------------------------------------------------------------------------------


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    votes = Counter(j for s in shingles for j in range(64) if xxhash.xxh64_intdigest(s, 42) >> j & 1)
    return sum(1 << j for j in range(64) if 2 * votes[j] > len(shingles))


def plain_components(prints, bits=4):
    """Smallest id reachable from each id over pairs within ``bits``; null ids are reached but never named."""
    left, out = dict(prints), {}
    while left:
        group, todo = {}, [left.popitem()]
        while todo:
            name, fp = todo.pop()
            group[name] = fp
            near = [n for n, other in left.items() if (fp ^ other).bit_count() <= bits]
            todo += [(n, left.pop(n)) for n in near]
        out |= {name: min(group) for name in group}
    return out


def test_fingerprints_and_components_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = {r.doc_id: plain_simhash(r.text) for r in docs.collect()}
    roots = plain_components(prints)
    assert found == {i: (f"{fp:016x}", roots[i]) for i, fp in prints.items()}


@pytest.mark.parametrize("piece", [4096, 20])
def test_links_connect_all_near_pairs_without_writing_them_all(spark, monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    draw = random.Random(3)
    centre = draw.getrandbits(64)
    prints = {centre}
    for _ in range(300):  # a drifting group: many near pairs, and ends that are far from each other
        prints.add(draw.choice(sorted(prints)) ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)))
    prints |= {draw.getrandbits(64) for _ in range(100)} | {0, (1 << 64) - 1, 0b1111, 0b111110000}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    whole = {p: p for p in signed}

    def root(p):
        while whole[p] != p:
            p = whole[p]
        return p

    for r in links:
        assert ((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 4
        whole[root(r.a)] = root(r.b)
    expected = plain_components({p: p & ((1 << 64) - 1) for p in signed})
    groups = [defaultdict(set), defaultdict(set)]
    for p in signed:
        groups[0][root(p)].add(p)
        groups[1][expected[p]].add(p)
    assert sorted(map(sorted, groups[0].values())) == sorted(map(sorted, groups[1].values()))


def test_every_near_pair_shares_a_block():
    masks = simhash.block_masks(4, 7)
    assert len(masks) == 35
    draw = random.Random(5)
    for _ in range(300):
        a = draw.getrandbits(64)
        b = a
        for _ in range(4):
            b ^= 1 << draw.randrange(64)
        assert any(a & m == b & m for m in masks)


def test_simhash_of_odd_rows(spark):
    found = simhash.near_duplicates(odd(spark)).collect()
    by = defaultdict(list)
    for r in found:
        by[r.doc_id].append((r.fingerprint, r.component_id))
    assert len(found) == 9
    assert [by[i] for i in (2, 3, 4)] == [[("0" * 16, 2)]] * 3
    assert by[None] == [(f"{plain_simhash('a b c d e'):016x}", 1)]
    assert len(by[1]) == 3
    assert simhash.near_duplicates(odd(spark).limit(0)).count() == 0


# Decontamination ----------------------------------------------------------------------------------------------


def plain_contamination(docs, items, window=10):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def words(text):
        return pattern.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    windows = defaultdict(set)
    for name, text in items:
        own = words(text)
        for i in range(max(1, len(own) - window + 1) if own else 0):
            windows[tuple(own[i : i + window])].add(name)
    out = []
    for name, text in docs:
        own, hit, found = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(own) - size + 1):
                if (run := tuple(own[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[run]
        names = sorted(str(n) for n in found if n is not None)
        out.append((name, len(own), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


REPORT = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_contamination_equals_brute_force(spark, as_rows):
    draw = random.Random(11)
    words = [f"w{i}" for i in range(6)] + ["É", "Ünd", "x-y", "A1"]
    items = [(i, " ".join(draw.choices(words, k=draw.choice([0, 1, 3, 5, 9, 10, 11, 30])))) for i in range(25)]
    items += [(100, "same five words are here"), (101, "same five words are here"), (102, None), (103, "..."), (7, items[7][1])]
    texts = []
    for i in range(60):
        text = draw.choices(words, k=draw.randrange(60))
        if i % 3 == 0:
            own = (draw.choice(items)[1] or "").split()
            at = draw.randrange(len(text) + 1)
            text[at:at] = own
        texts.append(" ".join(text))
    texts += [None, "", "?!", "Same FIVE words--are here", "same five words are", texts[3]]
    docs = documents(spark, texts)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n_words int")
    found = decontaminate.contamination(docs, bench)
    assert as_rows(found, *REPORT) == sorted(plain_contamination(list(enumerate(texts, 1)), items), key=repr)


def test_contamination_of_odd_rows_and_empty_tables(spark, as_rows):
    bench = spark.createDataFrame([(1, "a b c d e"), (None, "other text here"), (2, None)], "item_id long, text string")
    plain = plain_contamination([(r.doc_id, r.text) for r in odd(spark).collect()], [(1, "a b c d e"), (None, "other text here"), (2, None)])
    assert as_rows(decontaminate.contamination(odd(spark), bench), *REPORT) == sorted(plain, key=repr)
    assert decontaminate.contamination(odd(spark).limit(0), bench).count() == 0
    assert not decontaminate.contamination(odd(spark), bench.limit(0)).where("contaminated").count()


# Substring dedup ----------------------------------------------------------------------------------------------


def plain_repeats(docs, window):
    seen, out = set(), []
    for name, text in docs:
        words, gone = (text or "").encode().split(), set()
        for i in range(len(words) - window + 1):
            run = tuple(words[i : i + window])
            if run in seen:
                gone.update(range(i, i + window))
            seen.add(run)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((name, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard", [1000, 2])
def test_repeats_equal_brute_force(spark, as_rows, monkeypatch, shard):
    monkeypatch.setattr(substring, "SHARD_ROWS", shard)
    draw = random.Random(17)
    passages = [[f"p{draw.randrange(30)}" for _ in range(draw.randrange(4, 25))] for _ in range(8)]
    texts = []
    for i in range(80):
        words = []
        for _ in range(draw.randrange(6)):
            words += draw.choice(passages) if draw.random() < 0.5 else [f"q{draw.randrange(1000)}" for _ in range(draw.randrange(9))]
        texts.append(" ".join(words))
    texts += [texts[0], texts[5], "again " * 40, "again " * 25 + "and again " * 20, None, "", " \n", "Again again"]
    report, left = substring.repeated_text(documents(spark, texts), window=8, k=4)
    plain = plain_repeats(list(enumerate(texts, 1)), 8)
    assert as_rows(report, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(plain, key=repr)
    kept = {hashlib.sha256(r.kept.encode()).hexdigest() for r in left.collect()}
    assert kept == {digest for _, _, n, digest in plain if n}


def test_repeats_of_odd_rows(spark):
    report, _ = substring.repeated_text(odd(spark), window=4, k=2)
    found = Counter((r.doc_id, r.n_words, r.n_removed) for r in report.collect())
    assert found[(1, 5, 0)] == 2 and found[(None, 5, 5)] == 1 and found[(2, 0, 0)] == 1 and sum(found.values()) == 9
    assert substring.repeated_text(odd(spark).limit(0))[0].count() == 0


def test_documents_without_id_are_told_apart(spark, as_rows):
    draw = random.Random(29)
    shared = [" ".join(f"s{draw.randrange(99)}" for _ in range(12)) for _ in range(4)]
    texts = [f"{draw.choice(shared)} u{i} {draw.choice(shared)} v{i}" for i in range(60)] + [shared[0], shared[0], f"  {shared[0]}"]
    docs = spark.createDataFrame([(None, t, "en", "x", "y", "z", 1) for t in texts], DOCS)
    report, _ = substring.repeated_text(docs, window=8, k=4)
    order = docs.select("text", F.xxhash64(F.col("text"), F.length("text")).alias("kh")).collect()
    ranked = sorted({(r.kh, r.text) for r in order})
    plain = {kh: row[1:] for (kh, _), row in zip(ranked, plain_repeats([(None, t) for _, t in ranked], 8))}
    assert as_rows(report, "kh", "n_words", "n_removed", "kept_sha256") == sorted(((r.kh, *plain[r.kh]) for r in order), key=repr)


def test_suffix_automaton_gives_longest_matches():
    draw = random.Random(23)
    for _ in range(100):
        automaton, texts = substring.SuffixAutomaton(), []
        for _ in range(draw.randrange(1, 5)):
            texts.append([b"%d" % draw.randrange(3) for _ in range(draw.randrange(1, 15))])
            automaton.add(texts[-1])
        known = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        words = [b"%d" % draw.randrange(4) for _ in range(20)]
        longest = [max([n for n in range(1, i + 1) if tuple(words[i - n : i]) in known], default=0) for i in range(1, 21)]
        assert automaton.statistics(words) == longest
        assert len(automaton.length) <= 2 * sum(map(len, texts)) + 1


# BPE ----------------------------------------------------------------------------------------------------------


PIECES = [
    "a", "b", "A", "é", "e\u0301", "'s", "'ll", "1", "!", ".", ",", "<|", "endoftext", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "日", "本",
    "\u00a0", "\u0085", "\x1c", "\u200b", "İ", "Σ", "ß", "ﬁ", "-", "_", "\u0338", "=", "<", "가", "ª", "²", " ", "\n", "\t", "\r", "\x0b",
]


def test_tokens_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    draw = random.Random(29)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["".join(draw.choices(PIECES[: -5 if i % 3 == 0 else None], k=draw.choice([1, 5, 40, 3000]))) for i in range(200)]
    texts += ["x" * 9000, "ab-" * 4000, "日本" * 3000 + "1!" * 2000, "<|endoftext|>" * 500, None, "", " "]
    tokenizer = Tokenizer.from_file(bpe.vocabulary())
    found = {r.doc_id: r for r in bpe.tokenized(documents(spark, texts), bpe.vocabulary(), with_ids=True).collect()}
    for i, text in enumerate(texts, 1):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert found[i].ids == ids and found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert found[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_long_runs_are_cut_by_content_and_repaired():
    coder = bpe.ChunkCoder(bpe.vocabulary())
    draw = random.Random(31)
    run = "".join(draw.choices("abcdef-+.日本12", k=20_000))
    parts = bpe.cut_run(run, coder.special)
    assert "".join(parts) == run and len(parts) > 10
    shifted = bpe.cut_run("zz-" + run, coder.special)
    assert len(set(parts) & set(shifted)) > len(parts) // 2
    repaired = coder.repaired(parts)
    assert [i for ids in repaired for i in ids] == coder.ids(run) and 1 < len(repaired) < len(parts)


def test_keys_of_fingerprints_are_not_broadcast(spark, tmp_path):
    """the keys are 35 times as many as the fingerprints, which Spark's estimate does not know."""
    fps = stage(spark.range(1000).select(F.xxhash64("id").alias("fp")), str(tmp_path / "fps"))
    plan = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_ordinary_texts_are_cut_by_content_and_repaired():
    """F16: every text is cut, not only long runs; a passage that two texts share is encoded once, and runs that a cut parts are whole."""
    coder = bpe.ChunkCoder(bpe.vocabulary())
    draw = random.Random(37)
    text = " ".join("".join(draw.choices("abcdeo", k=draw.randint(1, 12))) + draw.choice(["", "", ",", "-x"]) for _ in range(3000))
    parts = bpe.cut_run(text, coder.special)
    assert "".join(parts) == text and len(parts) > 10
    assert any(a[-1] != " " != b[0] for a, b in zip(parts, parts[1:]))
    first = coder.encode(text)
    assert set(coder.chunks) == set(parts) and [int(i) for c in first for i in c[2].split()] == coder.ids(text)
    other = "Another beginning. " + text
    second = coder.encode(other)
    assert len(coder.chunks) <= len(parts) + 2 and [int(i) for c in second for i in c[2].split()] == coder.ids(other)
    for short in ("", " ", "a", "ab cd", "日本 \u0301a"):
        assert [int(i) for c in coder.encode(short) for i in c[2].split()] == coder.ids(short)


def test_remembered_chunks_stay_exact_when_few_are_kept():
    few, many = bpe.ChunkCoder(bpe.vocabulary(), remembered=3), bpe.ChunkCoder(bpe.vocabulary())
    for text in ["the cat. The CAT, the", "dog! cat the", "a b c d e f", "the cat."] * 3:
        assert [c[2] for c in few.encode(text)] == [c[2] for c in many.encode(text)]


def test_tokens_of_odd_rows(spark):
    found = bpe.tokenized(odd(spark), bpe.vocabulary()).collect()
    assert len(found) == 9 and {r.n_tokens for r in found if r.doc_id in (2, 3, 4)} == {0}
    assert bpe.tokenized(odd(spark).limit(0), bpe.vocabulary()).count() == 0


# Language -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def chain(spark):
    return langid.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_language_of_held_out_documents(spark, chain):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r.doc_id: r.lang for r in docs.collect()}
    found = [r for r in langid.identify(docs, chain).collect() if r.held_out]
    assert len(found) > 30
    assert sum(r.lang_pred == known[r.doc_id] for r in found) / len(found) >= 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_words_of_switched_text_are_labelled(spark, chain):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    english, german = (
        [w for r in docs if r.lang == lang for w in langid.WORD.findall(r.text.lower())][100:140] for lang in ("en", "de")
    )
    labeller = langid.Labeller(chain)
    at = labeller._look_up(english + german)
    posterior = langid.forward_backward(labeller.table[at], np.array([80]), chain.moves, chain.start)
    best = [chain.labels[i] for i in posterior.argmax(axis=1)]
    assert best[:38].count("en") >= 34 and best[42:].count("de") >= 34
    assert (np.diag(chain.moves) > 0).all()


def test_forward_backward_equals_enumeration():
    from itertools import product

    draw = np.random.default_rng(2)
    lengths = np.array([3, 1, 4])
    emissions, moves, start = draw.random((8, 3)) + 0.1, draw.normal(size=(3, 3)), draw.normal(size=3)
    found = langid.forward_backward(emissions.copy(), lengths, moves, start)
    at = 0
    for n in lengths:
        sums = np.zeros((n, 3))
        for path in product(range(3), repeat=int(n)):
            weight = np.exp(start[path[0]]) * np.prod([emissions[at + t, y] for t, y in enumerate(path)])
            weight *= np.exp(sum(moves[a, b] for a, b in zip(path, path[1:])))
            for t, y in enumerate(path):
                sums[t, y] += weight
        assert np.allclose(found[at : at + n], sums / sums.sum(axis=1, keepdims=True))
        at += n


def cut_texts(spark, languages, size):
    """Texts of ``size`` words and their languages, cut from the documents in these."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    out = []
    for r in docs:
        words = langid.WORD.findall(r.text)[:400] if r.lang in languages else []
        out += [(r.lang, " ".join(words[i : i + size])) for i in range(0, len(words), size)]
    return out


def test_language_is_learned_from_short_texts_only(spark):
    rows = [(i, text, lang) for i, (lang, text) in enumerate(cut_texts(spark, ("de", "en", "es", "fr"), 10))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chain = langid.train(docs)
    assert chain is not None
    known = {i: lang for i, _, lang in rows}
    found = [r for r in langid.identify(docs, chain).collect() if r.held_out]
    assert len(set(known.values())) > 1 and "und" not in {r.lang_pred for r in found}
    assert sum(r.lang_pred == known[r.doc_id] for r in found) / len(found) >= 0.9


def test_a_language_of_short_texts_stands_beside_long_ones(spark):
    short, long = cut_texts(spark, ("de",), 8), cut_texts(spark, ("en",), 200)
    chain = langid.fit(short[::2][:300] + long[::2][:300] + [("xx", "123 456")])
    assert chain.labels == ["de", "en"]
    names, _ = langid.Labeller(chain).label([text for _, text in short[1::2]])
    assert names.count("de") / len(names) >= 0.9


def test_the_whole_of_a_long_run_of_letters_counts():
    draw = random.Random(73)

    def run(letters, n):
        return "".join(draw.choice(letters) for _ in range(n))

    chain = langid.fit([(lang, run(letters, 60)) for lang, letters in (("aa", "abcdefgh"), ("zz", "stuvwxyz")) for _ in range(60)])
    text = run("abcdefgh", 22) + run("stuvwxyz", 600) + run("abcdefgh", 11)
    names, shares = langid.Labeller(chain).label([text])
    assert names == ["zz"] and shares[0] > 0.85
    assert len(langid.features("abcdefghijk", frozenset(["abcdefghijk"]))) == langid.MAX_FEATURES


def test_language_of_odd_rows(spark, chain):
    found = {(r.doc_id, r.held_out): (r.lang_pred, r.score) for r in langid.identify(odd(spark), chain).collect()}
    by_id = {i: v for (i, _), v in found.items()}
    assert all(by_id[i] == ("und", 0.0) for i in (2, 3, 4, 6)) and by_id[None][0] != "und"
    assert langid.identify(odd(spark).limit(0), chain).count() == 0
    assert langid.train(odd(spark)) is None
    assert {r.lang_pred for r in langid.identify(odd(spark), None).collect()} == {"und"}


def test_long_runs_of_one_word_cost_a_few_encodings():
    """Cut and repaired runs have the ids of the whole, at any length, and a run that is one word is not encoded part by part."""
    import random

    coder = bpe.ChunkCoder(bpe.vocabulary())
    draw = random.Random(5)
    for n in (100, 127, 128, 300, 2048, 2049, 5000):
        for letters in ("aeiounrst", "a.b,1;", "\u03a3\u03c3a", "e\u0301\u0327a"):
            run = "".join(draw.choices(letters, k=n))
            assert list(np.frombuffer(coder.packed(run)[1], dtype=np.int32)) == coder.ids(run)
    run, plain, read = "".join(draw.choices("aeiounrst", k=20_000)), coder.ids, []
    coder.ids = lambda text: read.append(len(text)) or plain(text)
    assert [i for ids in coder.repaired(bpe.cut_run(run, coder.special)) for i in ids] == plain(run)
    assert sum(read) < 8 * len(run)


def test_only_rows_that_may_be_named_go_through_the_join(spark):
    """Pipeline, disk: texts move only where a key may be among those that are taken out."""
    from portage.llm import common

    rows = spark.range(2000).selectExpr("IF(id = 7, NULL, id) AS doc_id", "IF(id % 9 = 0, NULL, CONCAT('t', id)) AS text", "id")
    keyed = common.texts(rows).select("doc_id", "text", "kid", "kh")
    keys = keyed.where("doc_id is null or doc_id % 100 = 0").select("kid", "kh").distinct()
    asked, others = common.told_apart(keyed, keys)
    assert 21 <= asked.count() <= 25
    assert asked.count() + others.count() == 2000
    left = sorted(common.without(keyed, keys).collect())
    assert left == sorted(keyed.join(keys, ["kid", "kh"], "left_anti").select(*common.without(keyed, keys).columns).collect())
    assert len(left) == 1979


def test_stages_that_take_documents_out_leave_the_others_where_they_are(spark):
    import corpus_pipeline
    from conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.substring_dedup, corpus_pipeline.decontamination):
        plan = stage(spark, docs, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("held(xxhash64(") >= 2, stage.__name__
