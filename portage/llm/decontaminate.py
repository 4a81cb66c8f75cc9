"""Benchmark decontamination by winnowed k-gram fingerprints whose hits are extended word by word."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portage.llm.common import as_bytes, bitmap, gram_hashes, in_tasks, marked, signed, staged, table, texts, winnow, word_hashes

#: Words of a UTF-8 text in lower case: digits, a to z and everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Bits of the map that keeps document fingerprints no item has out of the join: 512 KiB at any number of items.
MAP_BITS = 22

_HITS = "array<struct<kind:int,h:long,at:int,lead:int,context:string>>"


def split_words(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


def selected(words: list[bytes], window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The winnowed fingerprints of a text: their hashes and places.

    Of every ``window`` consecutive words the smallest hash of ``k`` words is kept, so two texts that share ``window``
    words in a row share a fingerprint at the same place of that run.
    """
    grams = gram_hashes(word_hashes(words), k)
    places = np.unique(winnow(grams, window - k + 1))
    return grams[places], places


def _context(words: list[bytes], at: int, k: int, reach: int) -> tuple[int, str]:
    lead = min(reach, at)
    return lead, b" ".join(words[at - lead : at + k + reach]).decode("utf-8", "replace")


def _shape(kind: int, window: int, k: int) -> tuple[int, int]:
    """Words in a fingerprint and words around it that a window may reach. Kind 0: items of a window or more words;
    other kinds: items of that many words, which have one fingerprint over all of them."""
    return (kind, 0) if kind else (k, window - k)


def item_fingerprints(items: DataFrame, item_id: str, text: str, window: int, k: int) -> DataFrame:
    """Fingerprints of the items: ``item``, ``kind``, ``h``, ``lead`` (words before it in ``context``), ``context``."""
    schema = pa.schema([("item", pa.string()), ("kind", pa.int32()), ("h", pa.int64()), ("lead", pa.int32()), ("context", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, body in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = split_words(body)
                if not words:
                    continue
                kind = 0 if len(words) >= window else len(words)
                size, reach = _shape(kind, window, k)
                for h, at in zip(*(x.tolist() for x in selected(words, size + reach, size))):
                    rows.append(dict(zip(schema.names, (item, kind, signed(h), *_context(words, at, size, reach)))))
            yield pa.RecordBatch.from_pylist(rows, schema)

    wanted = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    return in_tasks(wanted, run, "item string, kind int, h long, lead int, context string")


def candidate_hits(docs: DataFrame, maps: dict[int, np.ndarray], window: int, k: int) -> DataFrame:
    """One row per document: its key, ``n_words`` and the fingerprints that some item may have, with their contexts.

    ``maps`` has a bitmap of the items' hashes for each kind of item there is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(maps)
    fields = pa.struct([("kind", pa.int32()), ("h", pa.int64()), ("at", pa.int32()), ("lead", pa.int32()), ("context", pa.string())])

    def hits_of(words: list[bytes]) -> list[dict]:
        found, hashed = [], word_hashes(words)
        for kind, items in shared.value.items():
            size, reach = _shape(kind, window, k)
            grams = gram_hashes(hashed, size)
            places = np.unique(winnow(grams, reach + 1))
            for at in places[marked(items, grams[places])].tolist():
                lead, context = _context(words, at, size, reach)
                found.append({"kind": kind, "h": signed(int(grams[at])), "at": at, "lead": lead, "context": context})
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hits = [], []
            for body in as_bytes(batch.column(3)):
                words = split_words(body)
                counts.append(len(words))
                hits.append(hits_of(words))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(hits, pa.list_(fields))],
                ["doc_id", "kid", "kh", "n_words", "hits"],
            )

    return in_tasks(
        texts(docs).select("doc_id", "kid", "kh", "text"), run, f"doc_id long, kid long, kh long, n_words long, hits {_HITS}"
    )


def _equal_steps(here: Column, at: Column, there: Column, to: Column, steps: range) -> Column:
    """How many words in a row are equal, going from ``at`` and ``to`` by each of ``steps``."""
    same = [F.coalesce(F.get(here, at + s) == F.get(there, to + s), F.lit(False)) for s in steps]
    return reduce(lambda rest, i: F.when(~same[i], F.lit(i)).otherwise(rest), reversed(range(len(same))), F.lit(len(same)))


def extended(hits: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    """The hits that lie in a shared window: the document's key, ``item`` and the span of equal words around the hit."""
    reach = window - k
    there = items.select("kind", "h", "item", F.col("lead").alias("item_lead"), F.split("context", " ").alias("item_words"))
    met = hits.withColumn("words", F.split("context", " ")).join(there, ["kind", "h"])
    size = F.when(F.col("kind") == 0, k).otherwise(F.col("kind"))
    sides = (F.col("words"), F.col("lead"), F.col("item_words"), F.col("item_lead"))
    left, right = _equal_steps(*sides, range(-1, -reach - 1, -1)), _equal_steps(*sides, range(k, k + reach))
    return (
        met.where(F.slice("words", F.col("lead") + 1, size) == F.slice("item_words", F.col("item_lead") + 1, size))
        .withColumns({"left": F.when(F.col("kind") == 0, left).otherwise(0), "right": F.when(F.col("kind") == 0, right).otherwise(0)})
        .where((F.col("kind") > 0) | (F.col("left") + k + F.col("right") >= window))
        .select("kid", "kh", "item", (F.col("at") - F.col("left")).alias("from"), (F.col("at") + size + F.col("right")).alias("to"))
    )


def _covered(spans: Column) -> Column:
    """How many words the sorted spans (``from``, ``to``) cover together."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
    return F.aggregate(spans, start, lambda done, span: F.struct(
        (done["sum"] + F.greatest(F.lit(0), span["to"] - F.greatest(span["from"], done["end"]))).alias("sum"),
        F.greatest(done["end"], span["to"]).alias("end"),
    ))["sum"]


def contamination(
    docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = 10, k: int = 5
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. Winnowing keeps the smallest
    ``k``-gram hash of every window on both sides, the fingerprints are joined, and each hit is extended over equal
    words: every occurrence of a window is found through the fingerprint it contains. A document word inside an
    occurrence is hit; ``n_items`` counts items with occurring windows. Null and wordless texts have no words and no
    windows; items without an id mark words but are not counted; repeated rows get equal results; with no items
    nothing is hit.
    """
    prints = staged(item_fingerprints(items, item_id, text, window, k), "items")
    # At most as many kinds as a window has words.
    kinds = sorted(r[0] for r in prints.select("kind").distinct().collect())
    maps = {kind: bitmap(prints.where(F.col("kind") == kind).select("h"), MAP_BITS) for kind in kinds}
    base = staged(candidate_hits(docs, maps, window, k), "hits")
    hits = base.where("size(hits) > 0").select("kid", "kh", F.inline("hits"))
    spans = extended(hits, prints, window, k)
    found = spans.groupBy("kid", "kh").agg(
        F.array_sort(F.collect_set(F.struct("from", "to"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items")
    ).select("kid", "kh", _covered(F.col("spans")).cast("long").alias("n_hit"), "items")
    names = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return base.select("doc_id", "kid", "kh", "n_words").join(found, ["kid", "kh"], "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "kid", "kh",
    )


def op4_benchmark_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("kid", "kh")
