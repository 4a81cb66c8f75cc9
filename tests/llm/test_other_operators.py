"""Search, url filters, archives, toxicity and chat formatting against brute force and odd rows."""

import base64
import hashlib
import json
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF

from portage.llm import chat, covertree, toxicity, urlfilter, warc

# Search -------------------------------------------------------------------------------------------------------


def plain_top_k(rows, every, k=5):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            own = [math.floor(256 * float(np.float32(c))) for c in v]
            ok[i] = min(ok.get(i, own), own)
    out = set()
    for q, a in ok.items():
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok.items() if i != q)[:k]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)}
    return out


@pytest.mark.parametrize("block, group, leaf", [(4096, 512, 32), (40, 5, 4)])
def test_top_k_equals_brute_force(spark, monkeypatch, block, group, leaf):
    for name, value in (("BLOCK", block), ("GROUP", group), ("LEAF", leaf), ("CELLS", 6)):
        monkeypatch.setattr(covertree, name, value)
    draw = random.Random(41)
    centres = [[draw.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + draw.gauss(0, 0.1) for c in draw.choice(centres)]) for i in range(400)]
    rows += [(1000 + i, centres[0]) for i in range(60)]  # equal vectors: ties go to smaller ids
    rows += [(2000, None), (2010, [None] * 6), (2020, [float("nan")] * 6), (2030, [float("inf")] * 6), (None, centres[1])]
    rows += [(2040, [1.0, 1.0]), (2050, []), (10, rows[10][1]), (20, [0.5] * 6)]
    data = spark.createDataFrame([(i, v, "v", 1) for i, v in rows], "vec_id long, embedding array<float>, v string, cell int")
    found = {(r.query_id, r.rank, r.vec_id, r.score) for r in covertree.top_k(data, every=10).collect()}
    assert found == plain_top_k(rows, 10)


def test_top_k_of_few_and_no_rows(spark):
    data = spark.createDataFrame([(0, [1.0]), (50, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, covertree.top_k(data).collect())) == [(0, 1, 50, -65536), (50, 1, 0, -65536)]
    assert covertree.top_k(data.limit(0)).count() == 0


def test_cover_tree_covers_and_separates():
    draw = np.random.default_rng(3)
    rows = draw.integers(-50, 50, (500, 4))
    tree = covertree.CoverTree.build(np.arange(500), rows)
    assert sorted(tree.ids) == list(range(500)) and (tree.rows == rows[tree.ids]).all()
    for i in range(len(tree.radius)):
        own = tree.rows[tree.lo[i] : tree.hi[i]]
        assert np.sqrt(((own - tree.centre[i]) ** 2).sum(axis=1)).max() <= tree.radius[i] + 1e-9
        if n := tree.children[i]:
            inner = np.arange(tree.child[i], tree.child[i] + n)
            apart = np.sqrt(((tree.centre[inner][:, None] - tree.centre[inner][None]) ** 2).sum(axis=2))
            assert apart[~np.eye(n, dtype=bool)].min() >= tree.radius[inner].max() - 1e-9


def test_large_components_give_exact_scores():
    left, right = np.array([[1 << 40, 3]]), np.array([[1 << 20, 5], [1 << 40, 0]])
    assert covertree.products(left, right).tolist() == [[(1 << 60) + 15, (1 << 63) - 1]]


# Urls ---------------------------------------------------------------------------------------------------------


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://A.Example.COM/en/x?y#z": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://x.www.example.com/en/1": ("x.www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://wwww.example.com/en/1": ("wwww.example.com", "/en/1", "example.com/en/", "block"),
        "https://badexample.com/en/1": ("badexample.com", "/en/1", "com/", "allow"),
        "https://a.net/es/": ("a.net", "/es/", "net/es/", "block"), "https://a.net/ES/": ("a.net", "/ES/", None, None),
        "https://a.net/es": ("a.net", "/es", None, None), "x://b.com": ("b.com", "", None, None), "a.com/en/": ("", "", None, None),
        "q?u=://C.d/e#f://g": ("c.d", "/e", None, None), "://É.COM/": ("É.com", "/", "com/", "allow"), "": ("", "", None, None),
        None: ("", "", None, None), "s://h?/p": ("h", "", None, None), "s://u\n.net/fr/x": ("u\n.net", "/fr/x", "net/fr/", "block"),
        "http://" + "a/" * 50_000: ("a", "/" + "a/" * 49_999, None, None),
    }
    pages = spark.createDataFrame([(i, u, 1, 2.0) for i, u in enumerate(cases)], "page_id long, url string, host int, label double")
    found = {r.page_id: r for r in urlfilter.judge(pages).collect()}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, rule)
        assert found[i].verdict == verdict if verdict else found[i].verdict in ("allow", "block")


def test_trees_learn_from_ruled_urls(spark):
    pages = spark.createDataFrame(
        [(i, f"http://site{i % 9}.org/{'spam/' * 6 if i % 2 else 'ok/'}{i}{'?a=1&b=2' if i % 2 else ''}") for i in range(200)]
        + [(1000 + i, f"http://x{i}.info/{'spam/' * 6}{i}?a=2&b=3") for i in range(10)] + [(2000 + i, f"http://y{i}.info/ok/{i}") for i in range(10)],
        "page_id long, url string",
    )
    rules = {f"site{i}.org/spam/": "block" for i in range(9)} | {f"site{i}.org/ok/": "allow" for i in range(9)}
    found = {r.page_id: r.verdict for r in urlfilter.judge(pages, rules).collect()}
    assert {found[1000 + i] for i in range(10)} == {"block"} and {found[2000 + i] for i in range(10)} == {"allow"}


def test_urls_without_labels_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in urlfilter.judge(pages).collect()} == {"allow"}
    assert urlfilter.judge(pages.limit(0)).count() == 0


# Archives -----------------------------------------------------------------------------------------------------


ODD_PAGES = [
    (1, "u", "a\r\n\r\nb"), (2, None, "x" * 200_000 + "é" * 100_000), (3, "http://a b\r\n", "\r\n"), (4, "u", "\r\n\r\n"),
    (5, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n"), (6, "u", None), (7, "u", ""), (None, "u", "n"), (9, "u", "\r\n\r\n\r"), (10, "u", "\r"),
    (11, "u", "a\r\n\r\nb"), (12, "u", "q\r\n\r"), (13, "u", "\r\r\n\r\n\r\n\n" * 30_000), (None, "v", "a\r\n\r\nb"), (11, "w", "a\r\n\r\nb"),
]


def sha1(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_archives_come_back_as_they_went(spark):
    pages = spark.createDataFrame([(*r, 0, "x") for r in ODD_PAGES], "page_id long, url string, html string, total_bytes int, last string")
    found = warc.archive_and_read(spark, pages).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr)
    largest = {}
    for i, _, html in ODD_PAGES:
        if i is not None:
            largest[html or ""] = max(i, largest.get(html or "", i))
    expected = []
    for i, _, html in ODD_PAGES:
        payload, top = (html or "").encode(), largest.get(html or "")
        own = top is None or i == top
        expected.append((i, len(payload), sha1(payload), "response" if own else "revisit", None if own else top))
    assert got == sorted(expected, key=repr)
    assert warc.archive_and_read(spark, pages.limit(0)).count() == 0


def test_chunks_carry_their_digests(spark, tmp_path):
    pages = spark.createDataFrame(ODD_PAGES, "page_id long, url string, html string")
    warc.write_archives(spark, warc.with_record_types(pages), str(tmp_path / "a"), size=1000)
    rows = sorted((r for r in warc.read_chunks(spark, str(tmp_path / "a"), with_data=True).collect() if r.page_id == 2), key=lambda r: r.chunk_no)
    payload = ODD_PAGES[1][2].encode()
    assert b"".join(r.data for r in rows) == payload and max(r.n_bytes for r in rows) <= 1000 and len(rows) >= 400
    so_far = b""
    for r in rows[:5]:
        so_far += r.data
        assert r.digest_so_far == sha1(so_far)
    assert rows[-1].last and not rows[0].last and rows[-1].total_bytes == len(payload)


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "long one"), (4, "u", "long one")], "page_id long, url string, html string")
    found = {r.page_id: r.record_type for r in warc.archive_and_read(spark, pages, least_bytes=5).collect()}
    assert found == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_a_damaged_archive_fails(spark, tmp_path):
    text = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nPage-ID: 1\r\nWARC-Payload-Digest: sha1:" + sha1(b"abc")
    (tmp_path / "x.warc").write_bytes(text.encode() + b"\r\nContent-Length: 3\r\n\r\nabd\r\n\r\n")
    with pytest.raises(Exception, match="damaged payload of page 1"):
        warc.read_records(warc.read_chunks(spark, str(tmp_path))).collect()
    (tmp_path / "x.warc").write_bytes(text.encode() + b"\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_chunks(spark, str(tmp_path)).collect()


# Toxicity -----------------------------------------------------------------------------------------------------


def test_toxic_documents_are_caught_and_clean_ones_left_alone(spark):
    folder = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in known if zlib.crc32(str(i).encode()) % 4 == 0]
    graded = labels.selectExpr("doc_id", "1 - quality AS low_quality", "toxic").where(~labels.doc_id.isin(held))
    found = {r.doc_id: r.is_toxic for r in toxicity.classify(docs, graded, ("low_quality", "toxic")).collect()}
    toxic, clean = [i for i in held if known[i]], [i for i in held if not known[i]]
    assert sum(found[i] for i in toxic) / len(toxic) > 0.5
    assert sum(found[i] for i in clean) / len(clean) < 0.05


def test_later_models_see_earlier_probabilities():
    draw = np.random.default_rng(5)
    first = draw.integers(0, 2, 400)
    rows = [np.array([1, 2] if y else [3, 4], np.int32) for y in first]
    truth = np.stack([first, 1 - first], axis=1).astype(float)
    chain = toxicity.fit_chain(toxicity.Rows.of(rows), truth, ["a", "b"])
    assert len(chain.models[0].dense) == 0 and chain.models[1].dense[0] < 0
    found = chain.probabilities(toxicity.Rows.of(rows))
    assert ((found > 0.5) == (truth == 1)).all()


def test_toxicity_does_not_depend_on_the_size_of_the_labelled_table(spark):
    draw = random.Random(71)
    rows = []
    for i in range(900):  # one in nine toxic; the telling word is in most toxic and some clean texts
        toxic = i % 9 == 0
        words = [f"w{draw.randrange(40)}" for _ in range(12)] + ["vile"] * (draw.random() < (0.7 if toxic else 0.15))
        rows.append((i, " ".join(words), int(i % 2), int(toxic)))
    probes = [(10**7 + i, t, None, None) for i, t in enumerate(["w1 w2 w3 w4", "w5 vile w6 w7"])]
    found = []
    for times in (1, 12):
        table = spark.createDataFrame([(i + n * 1000, *r) for n in range(times) for i, *r in rows] + probes, "doc_id long, text string, low int, bad int")
        labels = table.where("doc_id < 10000000").drop("text")
        chain = toxicity.train(table, labels, ["low", "bad"], 2000)
        got = toxicity.scored(table.where("doc_id >= 10000000"), chain, ["low", "bad"], 0.5).orderBy("doc_id").collect()
        found.append([r.p_bad for r in got])
    (plain, vile), (plain_large, vile_large) = found
    assert abs(plain - plain_large) < 0.05 and abs(vile - vile_large) < 0.1
    assert plain_large < 0.12 and 0.25 < vile_large < 0.5  # 0.04 and 0.37 by Bayes' rule


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "bad"), (2, None), (3, ""), (None, "bad"), (1, "bad"), (4, "word " * 100_000)], "doc_id long, text string")
    docs = docs.selectExpr("*", "1 AS p_x", "'q' AS is_x")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None), (None, 1), (9, 1)], "doc_id long, x int")
    found = toxicity.classify(docs, labels, ("x",)).collect()
    assert len(found) == 6 and {r.p_x for r in found if r.doc_id in (2, 3)} == {0.0}
    assert {r.p_x for r in toxicity.classify(docs, labels.limit(0), ("x",)).collect()} == {0.0}
    assert toxicity.classify(docs.limit(0), labels, ("x",)).count() == 0


# Chat ---------------------------------------------------------------------------------------------------------


def test_formatted_turns_are_read_back(spark):
    draw = random.Random(47)
    bits = ["<|im_start|>", "<|im_end|>", "</s>", "[INST]", "\\", "\\l", "\\b", "\n", "<", "[", "é", "x", "<<SYS>>", "\\n", "<<s>", "\r"]
    turns = [(i % 7, i, draw.choice(["user", "assistant", "a\nb", "<s>", None]), "".join(draw.choices(bits, k=draw.randrange(12))) or None) for i in range(300)]
    data = spark.createDataFrame([(*t, 0) for t in turns], "conv_id long, turn long, role string, text string, piece int")
    pieces = chat.formatted(chat.canonical(data))
    for r, (_, _, role, text) in zip(pieces.orderBy("turn").collect(), turns):
        assert list(chat.read_turns(r.piece)) == [(role or "", text or "")]
        inner = r.piece[len(chat.OPEN) : -len(chat.CLOSE) - 1]
        assert not any(c in inner for c in chat.CONTROLS)
    found = {r.conv_id: r for r in chat.digests(pieces).collect()}
    for conv in range(7):
        own = [(r or "", t or "") for c, _, r, t in turns if c == conv]
        said = "".join(t for r, t in own if r == "assistant")
        assert found[conv].n_turns == len(own) and found[conv].loss_chars == len(said)
        assert found[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert found[conv].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_layouts_are_told_apart_by_their_fields(spark):
    layouts = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"}, {"response": "a", "prompt": "q"}, {"instruction": "q", "output": "a"},
        {"question": "q", "answer": "a", "id": 7}, {"instruction": "q", "input": None, "output": "a", "extra": {"deep": [1]}},
    ]
    odd = [{"what": 1}, [1], None, {"messages": []}]
    raw = [(i, json.dumps(x) if x is not None else None) for i, x in enumerate([*layouts, *odd])] + [(90, "{broken"), (91, None)]
    found = defaultdict(list)
    for r in chat.canonical_records(spark.createDataFrame(raw, "id long, body string"), "id", "body").orderBy("conv_id", "turn").collect():
        found[r.conv_id].append((r.role, r.text))
    assert all(found[i] == [("user", "q"), ("assistant", "a")] for i in range(len(layouts)))
    assert all(found[i] == [(None, None)] for i in (7, 8, 9, 10, 90, 91))
    with_input = {"instruction": "q", "input": "more", "output": "a", "system": "s"}
    assert chat.turns_of(with_input) == [("system", "s"), ("user", "q\n\nmore"), ("assistant", "a")]


def test_tables_of_known_layouts(spark):
    rows = spark.createDataFrame([(1, "q", "a"), (2, None, "b")], "conv_id long, prompt string, completion string")
    assert sorted(map(tuple, chat.canonical(rows).collect())) == [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "assistant", "b")]
    nested = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<`from`:string,value:string>>")
    assert sorted(map(tuple, chat.canonical(nested).collect())) == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    with pytest.raises(ValueError, match="no layout"):
        chat.canonical(rows.select("prompt"))


def test_chat_of_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (None, None, "assistant", "y"), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a"), (6, 0, None, None)]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.digests(chat.formatted(chat.canonical(data))).collect()}
    assert found[None].turns_sha256 == hashlib.sha256(b"assistant\ny\nuser\nx\n").hexdigest()
    assert found[5].turns_sha256 == hashlib.sha256(b"user\na\nuser\na\nuser\nb\n").hexdigest()
    assert found[6].n_turns == 1 and found[6].loss_chars == 0
    assert chat.digests(chat.formatted(chat.canonical(data.limit(0)))).count() == 0
