"""Substring deduplication: repeated word windows are found by suffix automata of reference shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portage.llm.common import as_bytes, bitmap, gram_hashes, in_tasks, marked, staged, table, texts, winnow, word_hashes
from portage.session import drop_dir, new_work_dir, stage

#: Bits of the maps that keep what cannot repeat out of the shuffles: 8 MiB and 2 MiB at any size of the corpus.
ANCHOR_BITS, DOC_BITS = 26, 24

#: Different passages up to which one automaton takes those of an anchor; beyond it their windows are compared by 128-bit keys.
SHARD_ROWS = 1000


class SuffixAutomaton:
    """The suffix automaton of several word sequences, which can be extended at any time."""

    def __init__(self) -> None:
        self.after: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, after: dict[bytes, int]) -> int:
        self.after.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, state: int, word: bytes) -> int:
        """The state for ``word`` after ``state`` that holds no longer sequence than that; cut off if need be."""
        target = self.after[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.after[target]))
        self.link[target] = copy
        while state != -1 and self.after[state].get(word) == target:
            self.after[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            if word in self.after[last]:
                last = self._split(last, word)
                continue
            new, state = self._state(self.length[last] + 1, 0, {}), last
            while state != -1 and word not in self.after[state]:
                self.after[state][word] = new
                state = self.link[state]
            if state != -1:
                # The split may copy a state, but never changes what leads to the new one.
                self.link[new] = self._split(state, word)
            last = new

    def statistics(self, words: list[bytes]) -> list[int]:
        """For each word the length of the longest run ending there that the automaton's sequences hold."""
        out, state, length = [], 0, 0
        for word in words:
            while state and word not in self.after[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.after[state]:
                state, length = self.after[state][word], length + 1
            else:
                length = 0
            out.append(length)
        return out


def repeated_spans(statistics: list[int], window: int) -> list[tuple[int, int]]:
    """The spans that runs of at least ``window`` words cover, merged."""
    spans: list[tuple[int, int]] = []
    for end, length in enumerate(statistics, 1):
        if length >= window:
            if spans and end - length <= spans[-1][1]:
                spans[-1] = (min(spans[-1][0], end - length), end)
            else:
                spans.append((end - length, end))
    return spans


def _cut(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    kept, at = [], 0
    for lo, hi in spans:
        kept += words[at : max(at, lo)]
        at = max(at, hi)
    return kept + words[at:]


def _anchors(docs: DataFrame, k: int, width: int) -> DataFrame:
    """One row per document: its key, ``n_words``, the digest of all its words and its winnowed fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, found = [], [], []
            for text in as_bytes(batch.column(3)):
                words = text.split() if text else []
                grams = gram_hashes(word_hashes(words), k)
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                found.append(grams[np.unique(winnow(grams, width))].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(digests), pa.array(found, pa.list_(pa.int64()))],
                ["doc_id", "kid", "kh", "n_words", "digest", "anchors"],
            )

    return in_tasks(
        texts(docs).select("doc_id", "kid", "kh", "text"), run,
        "doc_id long, kid long, kh long, n_words long, digest string, anchors array<long>"
    )


def _spread_out(words: list[bytes], window: int, k: int) -> Iterator[tuple[int, int, int]]:
    """Anchor, first word and length of every passage of a text: the union of the neighbouring windows that chose one anchor."""
    grams = gram_hashes(word_hashes(words), k)
    chosen = winnow(grams, window - k + 1)
    if len(chosen):
        starts = np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1])
        stops = np.concatenate([starts[1:], [len(chosen)]])
        yield from zip(grams[chosen[starts]].view(np.int64).tolist(), starts.tolist(), (stops - starts + window - 1).tolist())


def _places(docs: DataFrame, known: np.ndarray, window: int, k: int) -> DataFrame:
    """Where the passages of marked anchors are: ``anchor``, ``same`` (128 bits of their words), key, ``start``, ``size``."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows: list[tuple] = []
            for kid, kh, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                words = text.split() if text else []
                found = list(_spread_out(words, window, k))
                stays = marked(shared.value, np.array([f[0] for f in found], dtype=np.int64).view(np.uint64))
                for (anchor, start, size), stay in zip(found, stays.tolist()):
                    if stay:
                        same = xxhash.xxh3_128_digest(b" ".join(words[start : start + size]))
                        rows.append((anchor, same, kid, kh, start, size))
                if len(rows) > 20_000:
                    yield packed(rows)
                    rows = []
            yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], ["anchor", "same", "kid", "kh", "start", "size"]
        )

    return in_tasks(
        texts(docs).select("kid", "kh", "text"), run, "anchor long, same binary, kid long, kh long, start int, size int"
    )


def _texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``kid, kh, text`` of the documents that ``keys`` may name: a bitmap of fixed size keeps others out of the shuffle that follows."""
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(keys.select(F.xxhash64("kid", "kh").alias("h")), DOC_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = marked(wanted.value, batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(stays)).columns[:3], ["kid", "kh", "text"])

    rows = texts(docs).select("kid", "kh", "text", F.xxhash64("kid", "kh").alias("h"))
    return in_tasks(rows, run, "kid long, kh long, text string")


def _passages(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """The words of the ``needed`` passages: ``anchor``, ``hot``, key, ``start`` and ``words``."""
    by_doc = needed.groupBy("kid", "kh").agg(F.collect_list(F.struct("anchor", "hot", "start", "size")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            rows: list[tuple] = []
            for kid, kh, text, asked in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3).to_pylist()
            ):
                words = text.split()
                rows += [
                    (x["anchor"], x["hot"], kid, kh, x["start"], b" ".join(words[x["start"] : x["start"] + x["size"]])) for x in asked
                ]
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["anchor", "hot", "kid", "kh", "start", "words"]
            )

    return in_tasks(
        _texts_of(docs, needed).join(by_doc, ["kid", "kh"]), run,
        "anchor long, hot boolean, kid long, kh long, start int, words binary"
    )


def _matched(passages: DataFrame, window: int) -> DataFrame:
    """The spans of passages that an earlier passage of the same anchor holds too.

    The passages of an anchor come in the order of their documents. Each is streamed through the automaton of those
    before it, and then added to it unless it brought nothing new.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, place, held, automaton = None, None, None, None
        for batch in batches:
            out: list[tuple] = []
            columns = [c.to_pylist() for c in batch.columns]
            for h, kid, kh, start, joined in zip(*columns):
                words = joined.split(b" ")
                if h != anchor:
                    anchor, place, held, automaton = h, (kid, kh, start), words, None
                    continue
                if (kid, kh, start) == place:  # a repeated row is the same document
                    continue
                place = (kid, kh, start)
                if automaton is None:
                    automaton = SuffixAutomaton()
                if held is not None:
                    automaton.add(held)
                lengths = automaton.statistics(words)
                out += [(kid, kh, start + lo, start + hi) for lo, hi in repeated_spans(lengths, window)]
                # Added only when another passage comes, so the last one costs nothing.
                held = words if lengths[-1] < len(words) else None
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32()])],
                ["kid", "kh", "from", "to"],
            )

    dealt = passages.select("anchor", "kid", "kh", "start", "words").repartition("anchor")
    return in_tasks(dealt.sortWithinPartitions("anchor", "kid", "kh", "start"), run, "kid long, kh long, from int, to int")


def _repeats(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows (``anchor``, ``same``, ``place``, others) that an earlier row equals in ``anchor`` and ``same``.

    The first places are a table of their own, so that a key most rows hold is split in the join.
    """
    first = rows.groupBy("anchor", "same").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    first = staged(first.where("first <> last").drop("last"), purpose)
    return rows.join(first, ["anchor", "same"]).where("place <> first")


def _hot_matched(passages: DataFrame, window: int) -> DataFrame:
    """The same for anchors with very many different passages, by 128-bit keys of their windows instead of one automaton each."""
    words = F.split(F.col("words").cast("string"), " ")
    whole = passages.select("anchor", "kid", "kh", "start", words.alias("words"))
    keys = F.transform(F.sequence(F.lit(0), F.size("words") - window), lambda i: F.unhex(F.md5(
        F.array_join(F.slice("words", i + 1, window), " ").cast("binary")
    )))
    windows = whole.select("anchor", "kid", "kh", "start", F.posexplode(keys).alias("i", "same")).select(
        "anchor", "same", F.struct("kid", "kh", (F.col("start") + F.col("i")).alias("start")).alias("place")
    )
    return _repeats(windows, "hot-windows").select(
        "place.kid", "place.kh", F.col("place.start").alias("from"), (F.col("place.start") + window).alias("to")
    )


def _kept(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents that lose words: their key, ``n_removed``, the digest and the text of what is kept."""
    by_doc = spans.groupBy("kid", "kh").agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, kept_texts = [], [], []
            for text, spans in zip(as_bytes(batch.column(2)), batch.column(3).to_pylist()):
                words = text.split()
                kept = _cut(words, [(s["from"], s["to"]) for s in spans])
                joined = b" ".join(kept)
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
                kept_texts.append(joined)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(removed, pa.int64()), pa.array(digests), pa.array(kept_texts, pa.binary()).cast(pa.string())],
                ["kid", "kh", "n_removed", "kept_sha256", "kept"],
            )

    losing = _texts_of(docs, spans).join(by_doc, ["kid", "kh"]).dropDuplicates(["kid", "kh"])
    return in_tasks(
        losing.select("kid", "kh", "text", "spans"), run, "kid long, kh long, n_removed long, kept_sha256 string, kept string"
    )


def repeated_text(docs: DataFrame, window: int = 20, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """What ``docs`` lose when only the first occurrence of every ``window`` consecutive words stays.

    Returns one row per row of ``docs`` (``doc_id``, key, ``n_words``, ``n_removed``, ``kept_sha256``) and, for those
    that lose words, the key and the text that is left (``kept``, words joined by one space).

    Every window contains the winnowed ``k``-gram it chooses, and equal windows choose the same one: its anchor. Anchors
    that occur once are dropped. Of the passages around the others first only a digest moves: all but the first of those that are equal
    in 128 bits are repeated as a whole. Of anchors with several different passages, the words of the first ones are dealt
    to reference shards by anchor, where matching statistics against the suffix automaton of the earlier passages give the repeated
    spans. Texts with all the words of an earlier one (by SHA-256) are repeated as a whole and build no passages.

    Documents are ordered by doc_id, null last, then by a hash of the text; rows that agree in both are one document.
    Null and empty texts have no words; a text of fewer than ``window`` words loses none.
    """
    spark, width = docs.sparkSession, window - k + 1
    dirs = {part: new_work_dir(spark, f"substring-{part}") for part in ("anchors", "places", "first", "passages")}
    prints = stage(_anchors(docs, k, width), dirs["anchors"])
    base = staged(prints.drop("anchors"), "documents")

    # Texts whose words are all those of an earlier one.
    long = base.where(F.col("n_words") >= window).select("digest", F.struct("kid", "kh").alias("key"))
    first = long.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first <> last")
    copies = staged(
        long.join(staged(first.drop("last"), "first-copies"), "digest").where("key <> first").select("key.*").distinct(), "copies"
    )

    anchors = prints.join(copies, ["kid", "kh"], "left_anti").select(F.explode("anchors").alias("anchor"))
    repeated = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    found = _places(docs, bitmap(repeated, ANCHOR_BITS), window, k).join(copies, ["kid", "kh"], "left_anti")
    places = stage(found.select("anchor", "same", F.struct("kid", "kh", "start").alias("place"), "size"), dirs["places"])
    firsts = stage(places.groupBy("anchor", "same").agg(F.min("place").alias("place"), F.first("size").alias("size")), dirs["first"])
    several = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    needed = firsts.join(several.select("anchor", (F.col("n") > SHARD_ROWS).alias("hot")), "anchor").select(
        "anchor", "hot", "place.kid", "place.kh", "place.start", "size"
    )
    passages = stage(_passages(docs, needed), dirs["passages"])
    whole = _repeats(places, "repeated-passages").select(
        "place.kid", "place.kh", F.col("place.start").alias("from"), (F.col("place.start") + F.col("size")).alias("to")
    )
    spans = whole.unionByName(_matched(passages.where("not hot"), window)).unionByName(_hot_matched(passages.where("hot"), window))
    spans = staged(spans, "spans")
    changed = staged(_kept(docs, spans), "kept")
    for path in dirs.values():
        drop_dir(spark, path)

    nothing = F.sha2(F.lit(""), 256)
    lost = changed.select("kid", "kh", "n_removed", "kept_sha256").unionByName(
        copies.select("kid", "kh", F.lit(None).cast("long").alias("n_removed"), nothing.alias("kept_sha256"))
    ).withColumn("loses", F.lit(True))
    report = base.select("doc_id", "kid", "kh", "n_words", "digest").join(lost, ["kid", "kh"], "left").select(
        "doc_id", "kid", "kh", "n_words",
        F.when(F.col("loses"), F.coalesce("n_removed", "n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "digest").alias("kept_sha256"),
    )
    left = changed.select("kid", "kh", "kept").unionByName(copies.select("kid", "kh", F.lit("").alias("kept")))
    return report, left


def op7_substring_dedup(spark, sf_dir):
    return repeated_text(table(spark, sf_dir, "documents"))[0].drop("kid", "kh")
