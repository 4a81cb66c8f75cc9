"""Near duplicates by SimHash fingerprints that meet in pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portage.llm.common import (
    as_bytes, bitmap, components, gram_hashes, in_tasks, marked, signed, staged, table, texts, word_hashes,
)
from portage.session import drop_dir, new_work_dir, stage, unbroadcast

#: Rows of a bucket that one task compares with each other; larger buckets are cut into pieces and every two pieces meet.
PIECE = 4096

#: For copies by Jaccard similarity: fingerprints of a document, and parts of each, of which every two make a key.
SEEDS, PARTS = 8, 6

#: Bits of a part at most, of a seed with a part, and of a key: it fits an int.
PART_BITS, LEAD_BITS, KEY_BITS = 11, 17, 31

#: Fingerprints that meet are near if they and those of the next seed differ in so many of their 128 bits together. Sets of
#: similarity 0.8 differ in 15 % of the bits (19 % if they are very small), unrelated ones in 50 %.
NEAR_BITS = 30

#: Sets are compared if their fingerprints of all seeds differ in at most this share of their bits.
NEAR_SHARE = 0.26

#: One in so many documents is counted to find large buckets. Bytes of shingles of a piece of a family.
SAMPLED, PIECE_BYTES = 16, 16 << 20

#: Large buckets up to which their names, of 12 bytes each, are broadcast; beyond it they are joined by a shuffle.
MOST_BROADCAST = 200_000

#: Bits of the map that keeps texts without near ones out of the shuffle: 2 MiB.
MAP_BITS = 24


def simhash(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text: the majority vote of its shingles' hashes, bit by bit."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    stop = np.cumsum(lengths + 1) - 1
    start, reach = stop - lengths, min(shingle, len(words)) - 1
    start, stop = start[: len(words) - reach], stop[reach:]
    votes, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(start), 1 << 17):
        piece = zip(start[at : at + (1 << 17)].tolist(), stop[at : at + (1 << 17)].tolist())
        hashes = np.array([digest(joined[s:e], seed) for s, e in piece], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(start), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id``, key and ``fp`` (the fingerprint's bits as a long) of every row; texts stay where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signed(simhash(t, shingle, seed)) for t in as_bytes(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.int64())], ["doc_id", "kid", "kh", "fp"])

    return in_tasks(texts(docs).select("doc_id", "kid", "kh", "text"), run, "doc_id long, kid long, kh long, fp long")


def block_masks(bits: int, blocks: int) -> list[int]:
    """The masks of all choices of ``blocks - bits`` of ``blocks`` near-equal parts of 64 bits.

    Two fingerprints that differ in at most ``bits`` places differ in at most that many blocks, so they agree on all
    bits of one of these masks at least.
    """
    if not bits < blocks <= 64:
        raise ValueError("there must be more blocks than differing bits")
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - bits)]


def _forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join the fingerprints of each connected part; at most one less than there are fingerprints."""
    found, left = [], fps
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            one = todo.pop()
            near = np.bitwise_count((left ^ one).view(np.uint64)) <= bits
            hits = left[near]
            if len(hits):
                found += [(int(one), int(x)) for x in hits]
                todo += list(hits)
                left = left[~near]
    return found


def links(fps: DataFrame, bits: int = 4, blocks: int = 7) -> DataFrame:
    """Links (``a``, ``b``) between the distinct fingerprints ``fp`` that connect all pairs within ``bits``.

    Every pair within ``bits`` ends in the same component of these links, and each link is such a pair. Within a
    bucket only a spanning forest is written, so a group of near copies yields about as many links as it has members.
    With ``b`` blocks a key has about ``64 * (b - bits) / b`` bits: more blocks make more and sharper keys.
    """
    masks = block_masks(bits, blocks)
    keys = fps.select("fp", F.explode(F.array(*[
        F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks)
    ])).alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    met = (
        # Spark takes the exploded keys for a few times smaller than they are, and would broadcast them.
        unbroadcast(keys).join(shared, "key")
        .select("key", "fp", pieces.alias("pieces"), F.pmod(F.xxhash64(F.lit("piece"), "fp"), pieces).cast("int").alias("own"))
        .select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            rows = rows if held is None else np.concatenate([held, rows], axis=1)
            cuts = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
            yield from written(rows, [0, *cuts.tolist()])
            held = rows[:, cuts[-1] if len(cuts) else 0 :]
        if held is not None:
            yield from written(held, [0, held.shape[1]])

    def written(rows: np.ndarray, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        found = []
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo > 1:
                found += _forest(np.unique(rows[3, lo:hi]), bits)
        if found:
            pairs = np.array(found, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    dealt = met.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return in_tasks(dealt, run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4, blocks: int = 7, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``, its key and ``root``,
    a number of its component.

    Documents whose fingerprints differ in at most ``bits`` bits are linked; ``component_id`` is the smallest doc_id
    that links reach. A null or wordless text has fingerprint zero and is linked like any other; repeated rows get
    equal results; a null doc_id takes part, and a component of null ids only has a null component_id; an empty
    table gives an empty result.
    """
    found = staged(fingerprints(docs, shingle, seed), "simhash")
    holders = staged(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(holders.select("fp"), bits, blocks)).withColumnsRenamed({"node": "fp"})
    linked = roots.join(holders, "fp")
    reached = linked.groupBy("root").agg(F.min("first").alias("reached"))
    linked = linked.join(reached, "root").select("fp", "root", "reached")
    known = holders.join(linked, "fp", "left").select(
        "fp", F.coalesce("reached", "first").alias("component_id"), F.coalesce("root", "fp").alias("root")
    )
    return found.join(known, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "kid", "kh", "root"
    )


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """The distinct hashes of all runs of ``size`` words of a UTF-8 text, sorted; a shorter text is one run."""
    words = text.lower().split() if text else []
    return np.unique(gram_hashes(word_hashes(words), min(size, len(words)))) if words else np.empty(0, dtype=np.uint64)


def wide_simhash(hashes: np.ndarray, seeds: int = SEEDS) -> np.ndarray:
    """The fingerprints of a set of hashes, one for each seed, as longs."""
    salts = np.arange(1, seeds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    votes = np.zeros(64 * seeds, dtype=np.int64)
    for at in range(0, len(hashes), 255):  # so many votes fit a byte
        mixed = hashes[at : at + 255, None] ^ salts
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed ^= mixed >> np.uint64(shift)
            mixed *= np.uint64(factor)
        mixed ^= mixed >> np.uint64(31)
        votes += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")


def _split(rows: DataFrame, by: list[str], pieces: Column) -> DataFrame:
    """``rows`` dealt by ``by``; those of a group of several ``pieces`` once for every other piece, so that every two meet."""
    own = F.pmod(F.xxhash64(F.lit("piece"), "node"), pieces).cast("int")
    met = rows.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), pieces - 1))})
    met = met.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("own", "other")
    return met.repartition(*by, "lo", "hi").sortWithinPartitions(*by, "lo", "hi")


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each group, one at a time; rows come sorted by the first ``keys`` columns, which are whole numbers."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(keys)])
        cuts = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1
        if held and (names[:, 0] != last).any():
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *cuts.tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if lo:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
        last = names[:, -1]
    if held:
        yield pa.Table.from_batches(held)


def _apart(prints: np.ndarray, one: np.ndarray) -> np.ndarray:
    """In how many bits each row of ``prints`` differs from ``one``."""
    return np.bitwise_count((prints ^ one).view(np.uint64)).sum(axis=1, dtype=np.int64)


def _met(node: np.ndarray, prints: np.ndarray) -> list[tuple[int, int]]:
    """Links to the smallest one of the nodes that near fingerprints connect; at most one less than there are nodes.

    In a large family the smallest of many buckets is the same, and so are the links.
    """
    found, left = [], np.argsort(node)[::-1]
    while len(left) > 1:
        least, todo, left = left[-1], [left[-1]], left[:-1]
        while todo and len(left):
            one = todo.pop()
            near = _apart(prints[left], prints[one]) <= NEAR_BITS
            hits = left[near]
            if len(hits):
                found += [(int(node[least]), int(node[x])) for x in hits]
                todo += hits.tolist()
                left = left[~near]
    return found


def _similar(node: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that join the nodes whose sets have a Jaccard similarity of ``least`` or more, each of them compared.

    Sets whose fingerprints are too far apart, or whose sizes alone rule it out, are not compared.
    """
    sizes = np.array([len(s) for s in sets])
    bits = int(NEAR_SHARE * 64 * prints.shape[1])
    found, left = [], np.arange(len(node))
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            one = todo.pop()
            small, large = np.minimum(sizes[left], sizes[one]), np.maximum(sizes[left], sizes[one])
            asked = left[(small >= least * large) & (_apart(prints[left], prints[one]) <= bits)]
            if not len(asked):
                continue
            members, whole = np.concatenate([sets[x] for x in asked]), sets[one]
            at = np.minimum(np.searchsorted(whole, members), len(whole) - 1) if len(whole) else np.zeros(0, np.int64)
            ends = np.cumsum(sizes[asked])
            running = np.concatenate([[0], np.cumsum(whole[at] == members if len(whole) else members == 0)])
            common = running[ends] - running[ends - sizes[asked]]
            together = sizes[asked] + sizes[one] - common
            hits = asked[common >= least * together]
            if len(hits):
                found += [(int(node[one]), int(node[x])) for x in hits]
                todo += hits.tolist()
                left = np.setdiff1d(left, hits, assume_unique=True)
    return found


class _Joined:
    """The nodes that the links of a task connect, each with the smallest of its part: what a task hands on of all its links."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, node: int) -> int:
        above = self.above
        while (up := above.setdefault(node, node)) != node:
            above[node] = node = above[up]
        return node

    def add(self, links: list[tuple[int, int]]) -> None:
        for a, b in links:
            a, b = self.root(a), self.root(b)
            if a != b:
                self.above[max(a, b)] = min(a, b)

    def batches(self) -> Iterator[pa.RecordBatch]:
        nodes = list(self.above)
        for at in range(0, len(nodes), 100_000):
            piece = nodes[at : at + 100_000]
            pairs = [(r, n) for n in piece if (r := self.root(n)) != n]
            columns = np.array(pairs, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(columns[:, 0]), pa.array(columns[:, 1])], ["a", "b"])


def _part(number: int) -> Column:
    """One of the ``PARTS`` blocks of a fingerprint ``fp``."""
    lo, hi = (round(i * 64 / PARTS) for i in (number, number + 1))
    return F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).cast("int")


def _led(prints: DataFrame) -> DataFrame:
    """Each fingerprint once for every block but the last: ``lead`` names the seed, the block and its bits."""
    leads = [F.shiftleft(F.col("seed") * PARTS + i, PART_BITS).bitwiseOR(_part(i)) for i in range(PARTS - 1)]
    return prints.select("node", "fp", "check", F.explode(F.array(*leads)).alias("lead"))


def _keyed(led: DataFrame) -> DataFrame:
    """Each row once for every later block: ``key`` names the lead, the later block and its bits, and nothing is hashed."""
    block = F.shiftright("lead", PART_BITS) % PARTS
    keys = [
        F.when(block < j, F.shiftleft("lead", KEY_BITS - LEAD_BITS).bitwiseOR(F.lit(j << PART_BITS)).bitwiseOR(_part(j))) for j in range(1, PARTS)
    ]
    return led.select("node", "fp", "check", F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())).alias("key"))


def _families(nodes: DataFrame) -> DataFrame:
    """Links between nodes of fingerprints that are near by two seeds, met where they agree in blocks of one of them.

    A bucket writes a spanning forest, not its pairs. Buckets that a sample shows to be large are cut into pieces.
    """
    seeds = F.posexplode(F.transform("fps", lambda fp, i: F.struct(fp.alias("fp"), F.get("fps", (i + 1) % SEEDS).alias("check"))))
    prints = nodes.select("node", seeds.alias("seed", "two")).select("node", "seed", "two.fp", "two.check")
    led = _led(prints)
    sample = _keyed(_led(prints.where(F.pmod("node", F.lit(SAMPLED)) == 0))).groupBy("key").agg((F.count(F.lit(1)) * SAMPLED).alias("n"))
    large = staged(
        sample.where(F.col("n") > PIECE).select("key", F.ceil(F.col("n") / PIECE).cast("int").alias("pieces")), "simhash-large"
    )
    n_large = large.count()
    few = F.broadcast if n_large <= MOST_BROADCAST else lambda df: df
    crowded = few(large.select(F.shiftright("key", KEY_BITS - LEAD_BITS).alias("lead")).distinct())
    alone = led.join(crowded, "lead", "left_anti") if n_large else led
    # Rows move once for all keys that begin with the same block, and are repeated for each key where they arrive.
    met = _keyed(alone.repartition("lead")).sortWithinPartitions("key").select(
        "key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "node", "fp", "check"
    )
    if n_large:
        rows = _keyed(led.join(crowded, "lead", "left_semi")).join(few(large), "key", "left")
        met = met.unionByName(_split(rows, ["key"], F.coalesce("pieces", F.lit(1))).select("key", "lo", "hi", "node", "fp", "check"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, joined = np.empty((6, 0), dtype=np.int64), _Joined()

        def linked(rows: np.ndarray, edges: np.ndarray) -> None:
            # Nearly all buckets have one row.
            for at in np.flatnonzero(np.diff(edges) > 1).tolist():
                here = rows[3:, edges[at] : edges[at + 1]]
                joined.add(_met(here[0], here[1:].T))

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)])
            rows = np.concatenate([held, rows], axis=1)
            cuts = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
            linked(rows, np.concatenate([[0], cuts]))
            held = rows[:, cuts[-1] if len(cuts) else 0 :]
        linked(held, np.array([0, held.shape[1]]))
        yield from joined.batches()

    return in_tasks(met, run, "a long, b long").distinct()


def near_copies(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """One row (``kid``, ``kh``, ``root``) per row of ``docs``; documents linked by copies have the same ``root``.

    A link is a pair whose sets of ``size``-word shingles have a Jaccard similarity of ``least`` or more. Fingerprints that agree
    in two of their ``PARTS`` blocks for some seed meet, and those that are near are linked to families; within
    a family all sets are compared, so a pair is overlooked only if its family is, which at the very threshold has a
    small probability. Families come to their tasks by pieces of ``PIECE_BYTES`` of shingles, every two of which meet, and leave as
    the parts they fall into: no pairs are written. Shingles are compared by 32 bits of their hashes, which takes one in about
    four billion different ones for the same. Texts with the same shingles, and all texts without a word, are one document.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sets = [shingles(t, size) for t in as_bytes(batch.column(2))]
            nodes = [signed(xxhash.xxh64_intdigest(s.tobytes())) for s in sets]
            prints = np.concatenate([wide_simhash(s) for s in sets]) if sets else np.empty(0, np.int64)
            wide = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * SEEDS, pa.array(prints, pa.int64()))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(nodes, pa.int64()), sizes, wide], ["kid", "kh", "node", "n", "fps"])

    rows = texts(docs).select("kid", "kh", "text")
    found = staged(in_tasks(rows, run, "kid long, kh long, node long, n long, fps array<long>"), "simhash")
    nodes_dir, asked_dir = new_work_dir(spark, "simhash-distinct"), new_work_dir(spark, "simhash-asked")
    first = F.min(F.struct("kid", "kh")).alias("first")
    nodes = stage(found.groupBy("node").agg(first, F.min("n").alias("n"), F.min("fps").alias("fps")), nodes_dir)
    families = components(_families(nodes)).select("node", F.col("root").alias("family"))
    members = nodes.join(families, "node")
    # Together the members of a family may have any number of shingles.
    shares = members.groupBy("family").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") * 4 / PIECE_BYTES)).cast("int").alias("pieces"))
    asked = stage(members.join(shares, "family").select("first.kid", "first.kh", "node", "fps", "family", "pieces"), asked_dir)
    wanted = spark.sparkContext.broadcast(bitmap(asked.select(F.xxhash64("kid", "kh").alias("h")), MAP_BITS))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # repeated rows of a task go on once
        for batch in batches:
            there = marked(wanted.value, batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64))
            for at, key in zip(np.flatnonzero(there).tolist(), zip(*(batch.column(i).filter(pa.array(there)).to_pylist() for i in (0, 1)))):
                there[at] = key not in seen
                seen.add(key)
            batch = batch.filter(pa.array(there))
            # Half of each hash is enough to count what two texts have in common.
            sets = [np.unique((shingles(t, size) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for t in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sets, pa.list_(pa.int32()))], ["kid", "kh", "held"])

    held = in_tasks(rows.select("kid", "kh", "text", F.xxhash64("kid", "kh").alias("h")), sets_of, "kid long, kh long, held array<int>")
    met = _split(held.join(asked, ["kid", "kh"]), ["family"], F.col("pieces")).select("family", "lo", "hi", "node", "fps", "held")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = _Joined()
        for group in _grouped(batches, 3):
            if group.num_rows > 1:
                node, place = np.unique(group.column(3).to_numpy(), return_index=True)
                group = group.take(place)
                prints = np.stack([x.values.to_numpy() for x in group.column(4)])
                joined.add(_similar(node, prints, [x.values.to_numpy().view(np.uint32) for x in group.column(5)], least))
        yield from joined.batches()

    roots = components(in_tasks(met, verified, "a long, b long").distinct()).select("node", "root")
    for path in (nodes_dir, asked_dir):
        drop_dir(spark, path)
    return found.select("kid", "kh", "node").join(roots, "node", "left").select("kid", "kh", F.coalesce("root", "node").alias("root"))


def op3_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
