"""Ranked lexical search with bit-sliced Bloom signatures: bounds from bitmaps rule documents out, the rest is scored exactly."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portage.llm.common import as_bytes, bitmap, in_tasks, marked, staged, table, texts
from portage.llm.decontaminate import split_words

#: Rows of a slice that a term marks, and bits a signature has for each of them: about 1 in 100 absent terms looks present.
ROWS, BITS_PER_MARK = 7, 1.5

#: Documents whose terms are in memory at once.
SLICE = 2048

#: Bits of a block of signatures, and the most rows of one; a text with more terms than fit has a looser bound, no other result.
BLOCK_BITS, MOST_ROWS = 1 << 22, 1 << 24

#: Occurrences from which a term marks a further level of its own. The level reached bounds how often it occurs.
LEVELS = [1, 2, *(x for e in range(2, 40) for x in (3 << (e - 2), 1 << e))]

#: Characters of the items that are searched together; what is broadcast and brought to the driver grows with this only.
ITEM_CHARS = 1 << 18

#: Bits of the map that tells which documents are to be scored: 512 KiB. Others that it lets through fall out in the join.
MAP_BITS = 22


class Query(NamedTuple):
    """A block of items: their distinct terms, each item's terms with how often it has them, and the corpus figures."""

    terms: dict[bytes, int]
    items: list[tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray
    documents: int
    words: int


def _hashes(words) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _places(hashes: np.ndarray, level: int, rows: int) -> np.ndarray:
    """The rows, ``ROWS`` for each hash, that a term marks at a level in a signature of ``rows`` rows."""
    x = hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    step = (x >> np.uint64(32)) | np.uint64(1)
    first = x & np.uint64(0xFFFFFFFF)
    return ((first[:, None] + np.arange(ROWS, dtype=np.uint64) * step[:, None]) % np.uint64(rows)).astype(np.int64)


def signature_blocks(terms: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Bit-sliced signatures of documents, given as term hashes and counts: (rows, which documents, bits).

    Documents with about equally many marks go to one block, in which row ``r`` has one bit a document: the bits of a
    row lie together, so whether any of the documents can hold a term is the conjunction of ``ROWS`` short bit strings.
    """
    if not terms:
        return
    owner = np.repeat(np.arange(len(terms)), [len(h) for h, _ in terms])
    hashes, counts = np.concatenate([h for h, _ in terms]), np.concatenate([c for _, c in terms])
    marks = np.bincount(owner, np.searchsorted(LEVELS, counts, "right"), len(terms))
    sizes = np.ceil(2.0 ** (np.ceil(np.log2(np.maximum(marks, 4) * ROWS * BITS_PER_MARK) * 2) / 2)).astype(np.int64)
    sizes = np.minimum(sizes, MOST_ROWS)
    for rows in np.unique(sizes[marks > 0]).tolist():
        chosen = np.flatnonzero((sizes == rows) & (marks > 0))
        most = max(8, BLOCK_BITS // rows // 8 * 8)
        for at in range(0, len(chosen), most):
            members = chosen[at : at + most]
            column = np.full(len(terms), -1)
            column[members] = np.arange(len(members))
            here = column[owner]
            inside = here >= 0
            h, c, here = hashes[inside], counts[inside], here[inside]
            width = (len(members) + 7) // 8
            bits = np.zeros(rows * width, dtype=np.uint8)
            for level, least in enumerate(LEVELS):
                reached = c >= least
                if not reached.any():
                    break
                h, c, here = h[reached], c[reached], here[reached]
                places = _places(h, level, rows) * width + (here >> 3)[:, None]
                np.bitwise_or.at(bits, places, (128 >> (here & 7)).astype(np.uint8)[:, None])
            yield rows, members, bits.tobytes()


def contribution(weight, count, length_part):
    """What a term with ``count`` occurrences adds to a score; grows with ``count``."""
    return weight * ((1_000_000_000 * count) // (1000 * count + 12 * length_part))


def length_parts(lengths: np.ndarray, query: Query) -> np.ndarray:
    return 75 + (25 * lengths * query.documents) // query.words


def upper_bounds(rows: int, bits: bytes, lengths: np.ndarray, query: Query, hashes: np.ndarray) -> np.ndarray:
    """For each item and document of a block a score that its own does not exceed.

    A term's bitmap holds every document with the term; levels that are marked too raise its possible occurrences.
    """
    n, parts = len(lengths), length_parts(lengths, query)
    block = np.frombuffer(bits, dtype=np.uint8).reshape(rows, -1)
    out = np.zeros((len(query.items), n))
    width = max(8, (1 << 21) // max(1, len(hashes)) // 8 * 8)
    for low in range(0, n, width):
        piece = block[:, low // 8 : (low + width) // 8]
        size = min(width, n - low)
        most = np.zeros((len(hashes), size), dtype=np.int64)
        alive, held = np.flatnonzero(query.weights > 0), None
        for level in range(len(LEVELS)):
            here = np.bitwise_and.reduce(piece[_places(hashes[alive], level, rows)], axis=1)
            held = here if held is None else held & here
            some = held.any(axis=1)
            alive, held = alive[some], held[some]
            if not len(alive):
                break
            term, doc = np.nonzero(np.unpackbits(held, axis=1, count=size))
            most[alive[term], doc] = LEVELS[level + 1] - 1 if level + 1 < len(LEVELS) else 1 << 40
        term, doc = np.nonzero(most)
        count = np.minimum(most[term, doc], lengths[low + doc])
        adds = np.zeros(most.shape)
        adds[term, doc] = contribution(query.weights[term], count, parts[low + doc])
        for i, (which, often) in enumerate(query.items):
            out[i, low : low + size] = often @ adds[which]
    return out


_INDEX = "rows int, kids array<long>, khs array<long>, lengths array<long>, bits binary, term int, n long"
_DOCUMENTS, _WORDS = -1, -2


def _scan(docs: DataFrame, terms: dict[bytes, int], index: bool) -> DataFrame:
    """One pass over the texts: signature blocks if ``index``, and per task in how many documents each of ``terms`` occurs,
    how many documents have a term, and how many words there are in all."""
    schema = pa.schema([
        ("rows", pa.int32()), ("kids", pa.list_(pa.int64())), ("khs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
        ("bits", pa.binary()), ("term", pa.int32()), ("n", pa.int64()),
    ])
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = shared.value, np.zeros(len(shared.value) + 2, dtype=np.int64)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            found, lengths = [], []
            for body in as_bytes(batch.column(2)):
                words = split_words(body)
                counts = Counter(words)
                for word in counts.keys() & wanted.keys():
                    seen[wanted[word]] += 1
                lengths.append(len(words))
                if index:
                    found.append((_hashes(counts), np.fromiter(counts.values(), dtype=np.int64, count=len(counts))))
            lengths = np.array(lengths, dtype=np.int64)
            seen[_DOCUMENTS] += (lengths > 0).sum()
            seen[_WORDS] += lengths.sum()
            kids, khs = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for rows, members, bits in signature_blocks(found):
                ids = [pa.array([x[members]], pa.list_(pa.int64())) for x in (kids, khs, lengths)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows], pa.int32()), *ids, pa.array([bits], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64())],
                    schema=schema,
                )
        term = np.flatnonzero(seen)
        named = np.where(term >= len(wanted), term - len(seen), term)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(term), f.type) for f in list(schema)[:5]] + [pa.array(named, pa.int32()), pa.array(seen[term], pa.int64())], schema=schema
        )

    return in_tasks(texts(docs).select("kid", "kh", "text"), run, _INDEX)


def _bounded(index: DataFrame, query: Query, function, schema: str) -> DataFrame:
    """``function`` on the blocks of the index, each as (kids, khs, bounds), and at last on None."""
    shared = index.sparkSession.sparkContext.broadcast(query)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = shared.value
        hashes, handle = _hashes(query.terms), function()
        for batch in batches:
            for at in range(batch.num_rows):
                kids, khs, lengths = (batch.column(i)[at].values.to_numpy() for i in range(1, 4))
                bits = batch.column(4)[at].as_buffer()
                yield from handle(kids, khs, upper_bounds(batch.column(0)[at].as_py(), bits, lengths, query, hashes))
        yield from handle(None, None, None)

    blocks = index.where("rows is not null").select("rows", "kids", "khs", "lengths", "bits")
    return in_tasks(blocks, run, schema)


def _promising(index: DataFrame, query: Query, top: int) -> DataFrame:
    """The ``top`` documents of each item with the highest bounds in each task: ``item``, ``kid``, ``kh``, ``bound``."""
    n = len(query.items)

    def start():
        best = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(n)]
        least = np.zeros(n)

        def handle(kids, khs, bounds):
            if kids is None:
                names = np.repeat(np.arange(n), np.array([len(b[0]) for b in best], dtype=np.int64))
                columns = [np.concatenate([b[j] for b in best]) if n else np.empty(0) for j in range(3)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(names, pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                    pa.array(columns[0].astype(np.int64), pa.int64()),
                ], ["item", "kid", "kh", "bound"])
                return
            higher = bounds > least[:, None]
            for i in np.flatnonzero(higher.any(axis=1)).tolist():
                where = np.flatnonzero(higher[i])
                score, kid, kh = (np.concatenate(x) for x in zip(best[i], (bounds[i, where], kids[where], khs[where])))
                if len(score) > top:
                    chosen = np.argpartition(-score, top - 1)[:top]
                    score, kid, kh = score[chosen], kid[chosen], kh[chosen]
                    least[i] = score.min()
                best[i] = (score, kid, kh)

        return handle

    found = _bounded(index, query, start, "item int, kid long, kh long, bound long")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "kid", "kh")
    return found.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).drop("place")


def _not_excluded(index: DataFrame, query: Query, thresholds: np.ndarray) -> DataFrame:
    """Every document whose bound reaches an item's threshold: ``kid``, ``kh`` and those ``items``."""

    def start():
        def handle(kids, khs, bounds):
            if kids is None:
                return
            reached = (bounds >= thresholds[:, None]).T
            docs = np.flatnonzero(reached.any(axis=1))
            if len(docs):
                each, item = np.nonzero(reached[docs])
                offsets = np.concatenate([[0], np.cumsum(np.bincount(each, minlength=len(docs)))])
                items = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(item, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(kids[docs]), pa.array(khs[docs]), items], ["kid", "kh", "items"])

        return handle

    return _bounded(index, query, start, "kid long, kh long, items array<int>").dropDuplicates(["kid", "kh"])


def _scored(docs: DataFrame, asked: DataFrame, query: Query) -> DataFrame:
    """The exact scores above 0 of the ``asked`` documents (``kid``, ``kh``, ``items``): ``item``, ``doc_id``, key, ``score``.

    Texts stay where they are read: what moves are the counts of the items' terms in the documents that a bitmap lets through.
    """
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(bitmap(asked.select(F.xxhash64("kid", "kh").alias("h")), MAP_BITS))
    shared = spark.sparkContext.broadcast(query)
    rows = texts(docs).select("doc_id", "kid", "kh", F.xxhash64("kid", "kh").alias("h"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value.terms
        for batch in batches:
            batch = batch.filter(pa.array(marked(wanted.value, batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64))))
            lengths, which, often = [], [], []
            for body in as_bytes(batch.column(4)):
                words = split_words(body)
                counts = Counter(w for w in words if w in terms)
                lengths.append(len(words))
                which.append([terms[w] for w in counts])
                often.append(list(counts.values()))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(lengths, pa.int64()), pa.array(which, ints), pa.array(often, ints)],
                ["doc_id", "kid", "kh", "length", "terms", "counts"],
            )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = shared.value
        for batch in batches:
            out = []
            lengths = batch.column(3).to_numpy(zero_copy_only=False)
            for at, part in enumerate(length_parts(lengths, query).tolist()):
                terms, counts = (batch.column(i)[at].values.to_numpy() for i in (4, 5))
                adds = np.zeros(len(query.weights), dtype=np.int64)
                adds[terms] = contribution(query.weights[terms], counts.astype(np.int64), part)
                for item in batch.column(6)[at].values.to_numpy().tolist():
                    which, often = query.items[item]
                    total = int(often @ adds[which])
                    if total > 0:
                        out.append((item, *(batch.column(i)[at].as_py() for i in range(3)), total))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = (pa.int32(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["item", "doc_id", "kid", "kh", "score"])

    counted = in_tasks(rows, count, "doc_id long, kid long, kh long, length long, terms array<int>, counts array<int>")
    both = counted.join(asked, ["kid", "kh"]).select("doc_id", "kid", "kh", "length", "terms", "counts", "items")
    return in_tasks(both, score, "item int, doc_id long, kid long, kh long, score long")


def _best(scores: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "kid", "kh")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _item_query(items: list, documents: int = 0, words: int = 0) -> Query:
    """The block of items given as texts, still without weights."""
    terms: dict[bytes, int] = {}
    found = []
    for text in items:
        counts = Counter(split_words(text.encode() if text else None))
        which = [terms.setdefault(word, len(terms)) for word in counts]
        found.append((np.array(which, dtype=np.int64), np.fromiter(counts.values(), dtype=np.int64, count=len(counts))))
    return Query(terms, found, np.zeros(len(terms), dtype=np.int64), documents, words)


def search(docs: DataFrame, items: DataFrame, top: int = 20, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The ``top`` documents of each item by score, those above 0: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``.

    Terms are runs of digits, ASCII letters (in lower case) and characters beyond ASCII. Equal scores go by doc_id, null
    last, then by a hash of the text. Every row is a document of its own, repeated ones too; item rows that agree in id
    and text are one item. Null and wordless texts find nothing and are not found; empty tables give no rows.

    The index, bit-sliced Bloom signatures of all documents, is written once. Items are searched in blocks of bounded
    size: the documents with the highest bounds are scored for a threshold, the score of the ``top``-th of them; a
    document whose bound does not reach it cannot be among the best, and all others are scored from their whole texts.
    """
    asked = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text")).where("text is not null").distinct()
    asked = staged(asked, "search-items")
    blocks = max(1, math.ceil((asked.agg(F.sum(F.length("text"))).first()[0] or 0) / ITEM_CHARS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    spark, index, results = docs.sparkSession, None, []
    for block in range(blocks):
        rows = sorted(asked.where(F.col("block") == block).select("item_id", "text").collect(), key=repr)
        query = _item_query([r.text for r in rows])
        scan = staged(_scan(docs, query.terms, index is None), "signatures")
        index = scan if index is None else index
        figures = {r.term: r.n for r in scan.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        documents, words = figures.pop(_DOCUMENTS, 0), figures.pop(_WORDS, 0)
        weights = np.zeros(len(query.terms), dtype=np.int64)
        for term in range(len(weights)):
            weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * figures.get(term, 0) + 1)))
        query = query._replace(weights=weights, documents=documents, words=max(1, words))
        first = _promising(index, query, top).groupBy("kid", "kh").agg(F.collect_list("item").alias("items"))
        known = _best(_scored(docs, staged(first, "search-promising"), query), top)
        reached = known.where(F.col("rank") == top).select("item", "score").collect()
        thresholds = np.ones(len(rows))
        for item, score in reached:
            thresholds[item] = score
        left = staged(_not_excluded(index, query, thresholds), "search-candidates")
        found = _best(_scored(docs, left, query), top)
        # One row per item of the block.
        names = spark.createDataFrame(
            [(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}"
        )
        results.append(staged(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "search-results"))
    return reduce(DataFrame.unionByName, results)


def op12_ranked_lexical_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
