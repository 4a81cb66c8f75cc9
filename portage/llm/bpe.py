"""BPE encoding and decoding that encodes the chunks documents share once and repairs their joins."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portage.llm.common import in_tasks, keeps, no_cycle_search, table, texts

#: ASCII white space, which ends a chunk for certain: tokens never cross it, and it is no token.
SPACES = "\n\t\r"

#: A text is cut where a rolling hash says so: the hash of ROLL characters has CUT_BITS high zero bits; no chunk is shorter than SHORTEST.
ROLL, CUT_BITS, SHORTEST = 16, 9, 64

#: Words of each of two generations that a Python worker remembers, about 400 bytes each, and one chunk for so many words, about 2 kB each.
REMEMBERED, WORDS_A_CHUNK = 100_000, 25

#: Letters below this stay one letter each in lower case and in normal form, if a letter or a mark follows.
LATIN_END = "\u0130"


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones stand for themselves, the
    others are numbered from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


BYTE_LETTERS = byte_letters()


def cut_run(run: str, special: re.Pattern | None) -> list[str]:
    """Content-defined chunks of a text or a run of it: cut where the hash of the last characters says so.

    The same passage in two texts is cut at the same places. Never inside a special token's string.
    """
    rolled = np.frombuffer(run.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    width, factor = 1, 0x9E3779B97F4A7C15
    while width < ROLL:  # twice as many characters a step
        rolled = rolled[:-width] * np.uint64(factor) + rolled[width:]
        width, factor = 2 * width, factor * factor % (1 << 64)
    rolled ^= rolled >> np.uint64(32)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    wanted = np.flatnonzero(rolled >> np.uint64(64 - CUT_BITS) == 0) + ROLL
    inside = np.zeros(len(run) + 1, dtype=bool)
    for found in special.finditer(run) if special else ():
        inside[found.start() + 1 : found.end()] = True
    cuts = [0]
    for at in wanted[~inside[wanted]].tolist():
        if at - cuts[-1] >= SHORTEST and len(run) - at >= SHORTEST:
            cuts.append(at)
    return [run[lo:hi] for lo, hi in zip(cuts, [*cuts[1:], len(run)])]


class ChunkCoder:
    """Encodes and decodes texts of any length chunk by chunk, exactly as the tokenizer would as a whole."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        if self.ids("a b") != self.ids("a") + self.ids("b") or self.ids(" "):
            raise ValueError(f"{path} keeps white space: its texts cannot be cut there")
        #: Whether case does not matter, and whether a mark after a letter is a word of its own.
        self.folds, self.splits = self.ids("Ab") == self.ids("ab"), self.ids("ab.") == self.ids("ab") + self.ids(".")
        #: Whether a word of letters goes to the merges as it is, in lower case and byte by byte.
        self.direct = all(self.ids(w) == self.word_ids(w) for w in ("a", "Hello", "Straße", "ÉÑÎ", "lentement"))
        self.remembered = remembered
        self.known, self.chunks = _Known(self, {}), _Chunks(self, {})

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def word_ids(self, word: str) -> list[int]:
        """The merges alone, without normalising and splitting, of Latin letters that need neither."""
        spelt = "".join(map(str.lower, word)).encode()
        return [t.id for t in self.tokenizer.model.tokenize("".join(map(BYTE_LETTERS.__getitem__, spelt)))]

    def packed(self, *parts: str) -> tuple[int, bytes, str, str]:
        """Number of tokens, ids as 32-bit integers, ids in decimal, decoded text of a run, which the cuts have left in ``parts``.

        A run that is cut once is encoded as a whole, which is what repairing its only join takes.
        """
        run = "".join(parts)
        if len(parts) > 2:
            ids = [i for part in self.repaired(list(parts)) for i in part]
        elif self.direct and run.isalpha() and max(run) < LATIN_END:
            ids = self.word_ids(run)
        else:
            ids = self.ids(run)
        decoded = self.tokenizer.decode(ids, skip_special_tokens=False)
        return len(ids), array("i", ids).tobytes(), " ".join(map(str, ids)), decoded

    def repaired(self, parts: list[str]) -> list[list[int]]:
        """The encodings of the parts of a run, joined where that is exact.

        At each join the two parts are encoded together. If that differs from their encodings one after the other, the
        join lies inside a token's word: they become one part. All joins are tried in one pass, and parts that hang together
        are encoded once a pass, so a run that is one word costs as much as a few encodings of it.
        """
        found = [self.ids(part) for part in parts]
        while True:
            hangs = [self.ids(a + b) != x + y for a, b, x, y in zip(parts, parts[1:], found, found[1:])]
            if not any(hangs):
                return found
            groups = [[0]]
            for i, hang in enumerate(hangs, 1):
                if hang:
                    groups[-1].append(i)
                else:
                    groups.append([i])
            found = [found[g[0]] if len(g) == 1 else self.ids("".join(parts[g[0] : g[-1] + 1])) for g in groups]
            parts = ["".join(parts[g[0] : g[-1] + 1]) for g in groups]

    def encode(self, text: str) -> list[tuple[int, bytes, str, str]]:
        """The packed runs of a text that have tokens, in order: those inside its chunks, and those that cross their joins.

        A join at white space is exact. A run that a cut has parted belongs to no chunk: it is repaired here.
        """
        if len(self.known) > self.remembered:
            self.known = _Known(self, dict(self.known))
        if len(self.chunks) * WORDS_A_CHUNK > self.remembered:
            self.chunks = _Chunks(self, dict(self.chunks))
        for space in SPACES:
            text = text.replace(space, " ")
        found, crossing = [], []
        for part in cut_run(text, self.special):
            chunk = self.chunks[part]
            crossing.append(chunk[0])
            if len(chunk) > 1:
                found.append(self.run(crossing))
                found += chunk[1]
                crossing = [chunk[2]]
        found.append(self.run(crossing))
        return [run for run in found if run[0]]

    def run(self, parts: list[str]) -> tuple[int, bytes, str, str]:
        """The packed run that the cuts have left in ``parts``."""
        return self.packed(*filter(None, parts)) if len(parts) > 2 else self.known["".join(parts)]


class _Chunks(dict):
    """Content-defined chunks by text: the run that each begins with, the packed runs between, and the run it ends with; a chunk
    without white space is one run. Of the ``older`` chunks those stay that are met again."""

    def __init__(self, coder: ChunkCoder, older: dict) -> None:
        self.coder, self.older = coder, older

    def __missing__(self, chunk: str) -> tuple:
        if (found := self.older.get(chunk)) is None:
            first, *runs = chunk.split(" ")
            found = (first,)
            if runs:
                inner = [run for run in map(self.coder.known.__getitem__, runs[:-1]) if run[0]]
                found = first, inner, runs[-1]
        self[chunk] = found
        return found


class _Known(dict):
    """Runs by text. One that is met for the first time is encoded, or made of runs that were: a word and the mark
    after it, a word in another case. Of the ``older`` runs those stay that are met again."""

    def __init__(self, coder: ChunkCoder, older: dict) -> None:
        self.coder, self.older = coder, older

    def __missing__(self, chunk: str) -> tuple[int, bytes, str, str]:
        coder = self.coder
        if (older := self.older.get(chunk)) is not None:
            self[chunk] = older
            return older
        if coder.splits and len(chunk) > 1 and chunk[-1] in ".,;:!?" and chunk[-2].isalpha() and chunk[-2] < LATIN_END:
            (n, ids, decimal, decoded), mark = self[chunk[:-1]], self[chunk[-1]]
            found = (n + mark[0], ids + mark[1], f"{decimal} {mark[2]}", f"{decoded} {mark[3]}")
        elif coder.folds and chunk.isascii() and not chunk.islower() and chunk.isalpha():
            found = self[chunk.lower()]
        else:
            found = coder.packed(chunk)
        self[chunk] = found
        return found


@lru_cache(maxsize=2)
def coder_of(path: str) -> ChunkCoder:
    """The coder of this process: what one task has encoded, later tasks of the worker reuse."""
    return ChunkCoder(path)


keeps("bpe", coder_of.cache_clear)


def tokenized(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, and on demand ``ids``.

    Texts are cut by content into chunks. A chunk is encoded once per worker, whichever documents hold it, and so is a run of it
    between white space; joins that lie inside a run are repaired by encoding both sides together.
    Decoding joins the chunks' decoded texts by one space, as the tokenizer joins tokens. A null text is empty and has
    no tokens; repeated rows get equal results. ``path`` must be readable on every executor.
    """
    kinds = {"doc_id": "long", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if with_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                with no_cycle_search():
                    found = [coder.encode(t or "") for t in part.column(1).to_pylist()]
                    out = packed(part.column(0), found)
                yield out

    def packed(doc_ids: pa.Array, found: list[list[tuple[int, bytes, str, str]]]) -> pa.RecordBatch:
        counts = [sum(c[0] for c in chunks) for chunks in found]
        columns = [
            doc_ids, pa.array(counts, pa.int64()),
            pa.array([hashlib.sha256(" ".join([c[2] for c in chunks]).encode()).hexdigest() for chunks in found], pa.string()),
            pa.array([hashlib.sha256(" ".join([c[3] for c in chunks]).encode()).hexdigest() for chunks in found], pa.string()),
        ]
        if with_ids:
            ids = np.frombuffer(b"".join(c[1] for chunks in found for c in chunks), dtype=np.int32)
            columns.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), ids))
        return pa.RecordBatch.from_arrays(columns, list(kinds))

    return in_tasks(texts(docs).select("doc_id", "text"), run, ", ".join(f"{n} {k}" for n, k in kinds.items()), "bpe")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of one of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe_encoding_and_decoding(spark, sf_dir):
    return tokenized(table(spark, sf_dir, "documents"), vocabulary())
