"""Language identification by a linear-chain conditional random field that labels every word."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portage.llm.common import in_tasks, keeps, table

#: A word's language is sure from this probability on.
SURE = 0.5

#: Words are runs of letters (digits and underscores end one). A longer run, as in scripts without spaces, is as many words
#: of this length as it holds and the rest.
LONGEST_WORD = 11
WORD = re.compile(rf"[^\W\d_]{{1,{LONGEST_WORD}}}")

UNKNOWN = "und"

#: The classifier is fitted on at most this many documents of each language, those with the smallest hashed ids.
SAMPLE_PER_LANGUAGE = 300

#: Hashed features, words in a training sequence, and words that a lexicon feature takes to be known.
BUCKETS, SEQUENCE, LEXICON_COUNT = 1 << 17, 24, 3

#: Features of a word at most: its affixes, itself and all 3-grams of the longest word.
MAX_FEATURES = 7 + LONGEST_WORD - 2

#: Characters of texts decoded together: bounds the memory of a task whatever the batch holds.
PIECE_CHARS = 3_000_000


def features(word: str, lexicon: frozenset[str]) -> list[int]:
    """Hashed features of a lower-case word: affixes, itself if the lexicon has it, and the 3-grams inside."""
    own = [f"p{word[:i]}" for i in (1, 2, 3)] + [f"s{word[-i:]}" for i in (1, 2, 3)]
    if word in lexicon:
        own.append(f"w{word}")
    own += [word[i : i + 3] for i in range(min(len(word) - 2, MAX_FEATURES - len(own)))]
    return [1 + zlib.crc32(f.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) for f in own]


@dataclass
class ChainModel:
    """Weights of a linear chain: per feature and label, per label pair, and per label at the start."""

    labels: list[str]
    lexicon: frozenset[str]
    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """The potential of each label for each word, up to a factor per word."""
        ids = feature_table(words, self.lexicon)
        scores = np.zeros((len(words), len(self.labels)), dtype=np.float32)
        for column in ids.T:
            scores += self.weights[column]
        return np.exp(scores - scores.max(axis=1, keepdims=True)) + np.float32(1e-12)


def feature_table(words: list[str], lexicon: frozenset[str]) -> np.ndarray:
    """Feature numbers by word, filled up with zero, whose weights stay zero."""
    out = np.zeros((len(words), MAX_FEATURES), dtype=np.int32)
    for i, word in enumerate(words):
        found = features(word, lexicon)
        out[i, : len(found)] = found
    return out


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Posterior label probabilities of sequences that lie one after the other in ``emissions``.

    All sequences advance together, longest first, so that a step is one small matrix product. Each step is scaled to
    sum one, so long sequences neither vanish nor overflow.
    """
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    sorted_lengths = lengths[order]
    longest = int(sorted_lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-sorted_lengths, -np.arange(longest), side="left")
    push, pull = np.exp(moves), np.exp(moves).T
    ahead = np.empty_like(emissions)
    for t in range(longest):
        at = first[: active[t]] + t
        state = emissions[at] * (np.exp(start) if t == 0 else ahead[at - 1] @ push)
        ahead[at] = state / state.sum(axis=1, keepdims=True)
    behind = np.ones((len(lengths), emissions.shape[1]), dtype=emissions.dtype)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        here = ahead[at] * behind[:n]
        ahead[at] = here / here.sum(axis=1, keepdims=True)
        back = (emissions[at] * behind[:n]) @ pull
        behind[:n] = back / back.sum(axis=1, keepdims=True)
    return ahead


def pair_expectations(emissions: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors and expected label pairs of equally long sequences, ``emissions[sequence, step, label]``."""
    push = np.exp(moves)
    ahead, behind = np.empty_like(emissions), np.empty_like(emissions)
    for t in range(emissions.shape[1]):
        state = emissions[:, t] * (np.exp(start) if t == 0 else ahead[:, t - 1] @ push)
        ahead[:, t] = state / state.sum(axis=1, keepdims=True)
    behind[:, -1] = 1
    for t in range(emissions.shape[1] - 2, -1, -1):
        state = (emissions[:, t + 1] * behind[:, t + 1]) @ push.T
        behind[:, t] = state / state.sum(axis=1, keepdims=True)
    posterior = ahead * behind
    posterior /= posterior.sum(axis=2, keepdims=True)
    pairs = np.zeros_like(push)
    for t in range(emissions.shape[1] - 1):
        joint = ahead[:, t, :, None] * push * (emissions[:, t + 1] * behind[:, t + 1])[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return posterior, pairs


def fit(samples: list[tuple[str, str]], rounds: int = 40, rate: float = 0.5, per_language: int = 2_000) -> ChainModel | None:
    """A chain fitted on labelled texts by adaptive gradient ascent on the conditional likelihood.

    Texts become sequences of ``SEQUENCE`` words; a short text and the end of a text are shorter ones. Every second
    sequence is made of two halves in different languages, so that the learned moves allow for switches within a text.
    Languages whose texts have no word are not learned.
    """
    counts: Counter[str] = Counter()
    by_label: dict[str, list[list[str]]] = {}
    for label, text in samples:
        if words := WORD.findall(text.lower()):
            counts.update(set(words))
            by_label.setdefault(label, []).extend(words[i : i + SEQUENCE] for i in range(0, len(words), SEQUENCE))
    if not by_label:
        return None
    labels = sorted(by_label)
    pieces = [by_label[label] for label in labels]
    lexicon = frozenset(w for w, n in counts.items() if n >= LEXICON_COUNT)
    draw = np.random.default_rng(7)
    chosen: list[tuple[list[str], list[int]]] = []
    for i in range(len(labels)):
        for j in draw.permutation(len(pieces[i]))[:per_language].tolist():
            words, other = pieces[i][j], int(draw.integers(len(labels)))
            if len(chosen) % 2 and other != i:
                partner = pieces[other][int(draw.integers(len(pieces[other])))]
                one, two = words[: (len(words) + 1) // 2], partner[len(partner) // 2 :]
                chosen.append((one + two, [i] * len(one) + [other] * len(two)))
            else:
                chosen.append((words, [i] * len(words)))
    vocabulary: dict[str, int] = {}
    by_length: dict[int, list[tuple[list[int], list[int]]]] = {}
    for words, known in chosen:
        by_length.setdefault(len(words), []).append(([vocabulary.setdefault(w, len(vocabulary)) for w in words], known))
    groups = [
        (np.array([at for at, _ in group]), np.eye(len(labels), dtype=np.float32)[np.array([known for _, known in group])])
        for _, group in sorted(by_length.items())
    ]
    ids = feature_table(list(vocabulary), lexicon)
    model = ChainModel(
        labels, lexicon, np.zeros((BUCKETS, len(labels)), np.float32), np.zeros((len(labels),) * 2, np.float32), np.zeros(len(labels), np.float32)
    )
    seen_pairs = sum(np.einsum("sti,stj->ij", truth[:, :-1], truth[:, 1:]) for _, truth in groups)
    places = np.concatenate([at.ravel() for at, _ in groups])
    sums = [np.full_like(x, 1e-8) for x in (model.weights, model.moves, model.start)]
    for _ in range(rounds):
        scores = np.zeros((len(ids), len(labels)), np.float32)
        for column in ids.T:
            scores += model.weights[column]
        emissions = np.exp(scores - scores.max(axis=1, keepdims=True)) + np.float32(1e-12)
        found = [pair_expectations(emissions[at], model.moves, model.start) for at, _ in groups]
        pairs = sum(p for _, p in found)
        errors = [truth - posterior for (_, truth), (posterior, _) in zip(groups, found)]
        error = np.concatenate([e.reshape(-1, len(labels)) for e in errors])
        by_word = np.stack([np.bincount(places, error[:, i], len(ids)) for i in range(len(labels))], axis=1)
        grown = np.stack([
            np.bincount(ids.ravel(), np.repeat(by_word[:, i], MAX_FEATURES), BUCKETS) for i in range(len(labels))
        ], axis=1)
        n = len(chosen)
        steps = [grown / n - 1e-6 * model.weights, (seen_pairs - pairs) / n, sum(e[:, 0].sum(axis=0) for e in errors) / n]
        steps[0][0] = 0
        for i, (value, step) in enumerate(zip((model.weights, model.moves, model.start), steps)):
            sums[i] += step * step
            value += (rate * step / np.sqrt(sums[i])).astype(np.float32)
    return model


class _Numbers(dict):
    """Words by number, in the order they are met; those without a letter have number -1."""

    def __init__(self) -> None:
        self.fresh: list[str] = []
        self.size = 0

    def __missing__(self, word: str) -> int:
        if not (word.isalpha() or any(map(str.isalpha, word))):
            self[word] = -1
            return -1
        number = self[word] = self.size
        self.size += 1
        self.fresh.append(word)
        return number


class Labeller:
    """A fitted chain in a worker, with the emissions of the words it has met; ``known`` bounds their number."""

    def __init__(self, model: ChainModel, known: int = 150_000) -> None:
        self.model, self.known = model, known
        self.numbers, self.table = _Numbers(), np.empty((0, len(model.labels)), np.float32)

    def _look_up(self, words: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int64, count=len(words))
        if fresh := self.numbers.fresh:
            parts = [self.model.emissions(fresh[i : i + 50_000]) for i in range(0, len(fresh), 50_000)]
            self.table = np.concatenate([self.table, *parts])
            self.numbers.fresh = []
        return at

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """For each text the mean posterior of every label over its words; zero where there is no letter."""
        if len(self.numbers) > self.known:
            self.numbers, self.table = _Numbers(), self.table[:0]
        words, counts = [], []
        for text in texts:
            found = WORD.findall(text.lower()) if text else []
            words += found
            counts.append(len(found))
        at = self._look_up(words)
        lettered = at >= 0
        held = np.bincount(np.repeat(np.arange(len(texts)), counts)[lettered], minlength=len(texts))
        out, sure = np.zeros((len(texts), len(self.model.labels))), np.zeros(len(texts))
        spoken = held > 0
        if spoken.any():
            posterior = forward_backward(self.table[at[lettered]], held[spoken], self.model.moves, self.model.start)
            starts = (np.cumsum(held) - held)[spoken]
            out[spoken] = np.add.reduceat(posterior, starts, axis=0, dtype=np.float64) / held[spoken][:, None]
            sure[spoken] = np.add.reduceat(posterior.max(axis=1) >= SURE, starts, dtype=np.float64) / held[spoken]
        return out, sure

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language that holds most of each text's words, and its share."""
        return self.judged(texts)[:2]

    def judged(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """The language that holds most of each text's words, its share, and the share of words of which the language is sure.

        Texts of like length go together, in pieces of bounded size.
        """
        sizes = np.array([len(t or "") for t in texts], dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        piece = np.cumsum(sizes[order]) // PIECE_CHARS
        found, sure = np.zeros((len(texts), len(self.model.labels))), np.zeros(len(texts))
        for part in np.split(order, np.flatnonzero(np.diff(piece)) + 1) if len(texts) else []:
            found[part], sure[part] = self.shares([texts[i] for i in part.tolist()])
        best, spoken = found.argmax(axis=1), found.sum(axis=1) > 0
        names = [self.model.labels[i] if s else UNKNOWN for i, s in zip(best.tolist(), spoken.tolist())]
        return names, np.minimum(found[np.arange(len(texts)), best], 1.0).tolist(), sure.tolist()


#: The labeller of this process: it keeps the words it has met from one task to the next, and gives way to the next model's.
_LABELLER: list[Labeller] = []
keeps("langid", _LABELLER.clear)


def labeller_of(model: ChainModel) -> Labeller:
    if not _LABELLER or _LABELLER[0].model is not model:
        _LABELLER[:] = [Labeller(model)]
    return _LABELLER[0]


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept out of training: crc32 of its id as text, modulo 4, is 2. Null ids are not."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> ChainModel | None:
    """The chain learned from ``docs`` that are not held out and have a language; None if there are none with a word.

    The sample is bounded: ``per_language`` documents of each language, whole texts. It is chosen in the tasks first,
    so that no language's rows meet in one place.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id"), F.col("text")).alias("h"), F.col("doc_id").alias("doc_id")
    )
    spread = rows.withColumn("deal", F.pmod(F.col("h"), F.lit(64)))
    first = Window.partitionBy("lang", "deal").orderBy("h", "doc_id")
    again = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = (
        spread.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_language)
        .withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= per_language).select("lang", "h").distinct()
    )
    whole = docs.where(~held_out() & F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").alias("text"), F.xxhash64(F.col("doc_id"), F.col("text")).alias("h")
    )
    samples = whole.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", "text").toArrow().to_pylist()
    samples = sorted({(r["lang"], r["h"], r["text"]) for r in samples})
    return fit([(lang, text) for lang, _, text in samples])


def identify(docs: DataFrame, model: ChainModel | None, keep=None) -> DataFrame:
    """``docs`` with the language the chain finds in each whole text.

    With ``keep``, a function of language, score and the share of words whose language is sure, whichever it is, the rows
    of ``docs`` it accepts, unchanged; without, the columns ``doc_id``, ``held_out``, ``lang_pred`` and ``score``. A null text or one without letters is ``und`` with score
    zero, and so is all text if there was nothing to learn from. Repeated rows get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def labelled(batches: Iterator[pa.RecordBatch], text_at: int):
        labeller = labeller_of(shared.value) if shared.value else None
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            yield batch, *(labeller.judged(texts) if labeller else ([UNKNOWN] * len(texts), *[[0.0] * len(texts)] * 2))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, names, scores, _ in labelled(batches, 2):
            columns = [*batch.columns[:2], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, *found in labelled(batches, place):
            yield batch.filter(pa.array([keep(*x) for x in zip(*found)], pa.bool_()))

    if keep:
        return in_tasks(docs, accepted, docs.schema, "langid")
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return in_tasks(wanted, report, "doc_id long, held_out boolean, lang_pred string, score double", "langid")


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
