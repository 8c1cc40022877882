"""Toxicity scores of documents after undoing obfuscated spellings.

Method (noisy channel). A writer's letters reach us through a channel that
swaps letters for look-alike digits and signs, repeats them, and puts spaces
or marks between them. Spots that look so (signs or digits beside letters, a
letter twice in a row, several single letters in a row) become lattices of
possible letters; Viterbi decoding finds the most likely sequence under the
channel and a character language model, for spots of any length (time and memory
are linear in it). Brackets and exclamation marks at the edges of a token are
tried as letters, too. The rest of a text stands as it is. The text seen and the
restored text are scored alike, also when a classifier is fitted.

* The language model has character 4-grams, smoothed with shorter ones, of all
  words of all documents: words are counted over the whole corpus, and each
  word's n-grams weigh by the logarithm of its count. Its tables have a fixed
  size (``TABLE_BITS``).
* The classifier has one weight for each word and each word beginning: the
  share of documents labelled toxic among the training documents that hold it,
  drawn towards the mean for rare ones; a group of near copies (linked by
  ``jaccard_join``) counts as one document. A word's weight is the largest of its own and its beginnings'. The score is the
  chance that any of the suspicious words (weight of at least one half) marks
  the text, else the largest weight met. It is fitted on at most ``fit_documents`` labelled documents, those with
  the smallest hash of their id.

Defined cases: a null text is scored as an empty one, whose score is the share
of toxic labels. A null doc_id is scored, not held out and never labelled.
Labels that are null are skipped; if a doc_id is labelled twice, it is toxic
if either says so. Without labelled documents every score is 0. Equal texts get
equal scores; nothing but the text enters a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics.llm import words as W
from shopmetrics.llm.jaccard_join import jaccard_join
from shopmetrics.llm.lean import lean
from shopmetrics.sources.staging import stage

FIT_DOCUMENTS = 20_000
FOLDS = 5
# Drawing of rare words towards the mean, as a number of documents.
PRIOR_DOCUMENTS = 4.0
# Near copies are linked by shingles of so many words and a similarity of at least (num, den);
# a group of linked copies counts as one document.
COPY_WORDS, COPY_SIMILARITY = 5, (80, 100)
# Features held by fewer toxic training documents than this are left out. Copies count as one
# document; the number is the same for samples of any size.
LEAST_TOXIC = 5
# Beginnings of words count as suspicious only if so few of their documents are clean.
CLEAN_SHARE = 0.01
PREFIXES = range(4, 9)
TABLE_BITS = 18
ORDER = 4
KEPT_WORDS = 300_000
# Letters of the spots whose restored texts a task keeps.
KEPT_LETTERS = 5_000_000

# What a sign may stand for. Fixed values.
LOOKALIKES = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "il",
    "|": "il",
    "+": "t",
    "(": "c",
    "€": "e",
    "£": "l",
    "¡": "i",
    "а": "a",
    "е": "e",
    "о": "o",
    "р": "p",
    "с": "c",
    "х": "x",
    "у": "y",
    "і": "i",
    "*": "aeiou",
    "#": "aeiou",
}
SEPARATORS = "._-*~/\\'’`·•"
INVISIBLE = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))

_SIGNS = re.escape("".join(LOOKALIKES))
_WORD = re.compile(r"[^\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
_REPEAT = re.compile(r"([^\W\d_])\1")
_STRANGE = re.compile(
    rf"[^\W\d_][{_SIGNS}{re.escape(SEPARATORS)}]+[^\W\d_]|[{_SIGNS}][^\W\d_]|[^\W\d_][{_SIGNS}]"
)
_SEPARATED = dict.fromkeys(ord(c) for c in SEPARATORS if c not in LOOKALIKES)
_SINGLES = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_INVISIBLE = re.compile("[" + "".join(map(chr, INVISIBLE)) + "]")
_EDGES = "\"'.,;:?)]}»”’“«([{"
# Of these some are listed as letters, too; tokens are also tried with them.
_MARKS = "(!"
_SIGNS_AT_EDGES = frozenset(_MARKS)
_SIGN_LETTERS = frozenset(c for c in LOOKALIKES if c.isalpha())
_OTHER_EDGES = _EDGES.replace("(", "")

# Channel costs, as log probabilities.
KEEP, SWAP, DROP_REPEAT, KEEP_REPEAT, DROP_GAP, KEEP_GAP = 0.0, -1.0, -0.5, -2.0, -0.5, -0.7


class CharacterModel:
    """Character n-grams in hashed tables of fixed size."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts  # one row for each order, 1 to ORDER
        self.total = float(counts[0].sum())

    @staticmethod
    def slot(gram: str) -> int:
        """The place that ``slots`` gives, without arrays."""
        value = 0
        for c in gram:
            value = (value * 0x01000193 & 0xFFFFFFFF) ^ ord(c)
        value ^= value >> 15
        value = value * 0x2C1B3C6D & 0xFFFFFFFF
        return (value ^ value >> 12) & ((1 << TABLE_BITS) - 1)

    def cost(self, context: str, letter: str, memo: dict[str, float]) -> float:
        """Log probability of a letter after a context of ORDER - 1 letters."""
        key = context + letter
        found = memo.get(key)
        if found is None:
            share = 1.0 / 60
            for order in range(1, ORDER + 1):
                before = context[len(context) - order + 1 :]
                seen = float(self.counts[order - 1][self.slot(before + letter)])
                total = (
                    float(self.counts[order - 2][self.slot(before)])
                    if order > 1
                    else self.total
                )
                share = (seen + 4.0 * share) / (max(total, seen) + 4.0)
            found = memo[key] = math.log(max(share, 1e-9))
        return found


def slots(letters: list[np.ndarray] | np.ndarray) -> np.ndarray:
    """Table places of n-grams given letter by letter."""
    value = np.zeros(len(letters[0]), dtype=np.uint32)
    for column in letters:
        value = value * np.uint32(0x01000193) ^ column
    value ^= value >> np.uint32(15)
    value = value * np.uint32(0x2C1B3C6D)
    value ^= value >> np.uint32(12)
    return (value & np.uint32((1 << TABLE_BITS) - 1)).astype(np.int64)


def gram_table(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Weighted counts of the n-grams of words between spaces, orders 1 to ORDER."""
    size, pad = 1 << TABLE_BITS, ORDER - 1
    table = np.zeros((ORDER, size))
    joined = "".join([" " * pad + w + " " for w in words])
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    lengths = np.array([len(w) for w in words]) + pad + 1
    heavy = np.repeat(weights, lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ends = np.flatnonzero(place >= pad)
    for order in range(1, ORDER + 1):
        at = slots([codes[ends - i] for i in range(order - 1, -1, -1)])
        table[order - 1] += np.bincount(at, heavy[ends], size)
        if order < ORDER:  # the context at the start of a word
            table[order - 1, CharacterModel.slot(" " * order)] += weights.sum()
    return table


def seen_places(seen: str) -> Iterator[tuple[str, bool, bool]]:
    """Each sign, whether it repeats the one before, and whether it may be a mark at an edge."""
    first = last = -1
    if not _SIGNS_AT_EDGES.isdisjoint(seen):
        letters = [i for i, c in enumerate(seen) if c.isalpha()] or [0]
        first, last = letters[0], letters[-1]
    before = ""
    for i, c in enumerate(seen):
        mark = c in _SIGNS_AT_EDGES and (c == "(" and i < first or i > last)
        yield c, c == before, mark
        before = c


@cache
def options(c: str, repeated: bool, mark: bool) -> list[tuple[str, float]]:
    """The texts that a sign may stand for, with channel costs."""
    if c.isspace():
        return [(" ", KEEP_GAP), ("", DROP_GAP)]
    if c.isalpha() and c not in LOOKALIKES:
        return [(c, KEEP_REPEAT), ("", DROP_REPEAT)] if repeated else [(c, KEEP)]
    found = [(x, SWAP) for x in LOOKALIKES.get(c, "")]
    if repeated:
        found.append(("", DROP_REPEAT))
    if c in SEPARATORS or mark:
        found.append(("", DROP_GAP))
    if c in SEPARATORS or not found:
        found.append((" ", KEEP_GAP))
    return found


@dataclass
class Restorer:
    """Restores obfuscated spots of texts.

    With ``heads``, a token of some word isn't decoded if no reading of it has a word
    that begins so (or is one, if shorter): such words weigh nothing in a score. With
    ``features`` it isn't either if no reading has a word with one of these, whole or as
    a beginning (marked by a dash).
    """

    model: CharacterModel
    heads: set[str] | None = None
    features: Collection[str] | None = None

    def __post_init__(self) -> None:
        self.memo: dict[str, float] = {}
        self.known: dict[str, str] = {}
        self.letters = 0  # of the spots in known
        # What a word has to begin with, or to be, to weigh anything.
        if self.features is None:
            self.ends = {h for h in self.heads or () if len(h) < PREFIXES.start}
            self.stems = set(self.heads or ()) - self.ends
        else:
            self.ends = {f for f in self.features if not f.endswith("-")}
            self.stems = {f[:-1] for f in self.features if f.endswith("-")}
        # A word that begins otherwise can have none of them.
        self.beginnings = {f[:n] for f in self.ends | self.stems for n in range(len(f) + 1)}

    def lattice(self, seen: str) -> list[list[tuple[str, float]]]:
        """For each place the texts it may stand for, with channel costs."""
        return [options(*place) for place in seen_places(seen)]

    def reaches(self, seen: str) -> bool:
        """Whether any reading of a spot, likely or not, has a word with a feature (or head)."""
        if seen.isascii() and seen.isalpha():
            return self.reaches_plainly(seen)
        begun: set[str | None] = {""}  # words so far; None for one that has no feature
        for place in seen_places(seen):
            after: set[str | None] = set()
            for word in begun:
                for letter, _ in options(*place):
                    if letter == " ":
                        if word in self.ends:
                            return True
                        after.add("")
                    elif not letter or word is None:
                        after.add(word)
                    elif word + letter in self.stems:
                        return True
                    else:
                        begins = word + letter in self.beginnings
                        after.add(word + letter if begins else None)
            begun = after
        return not begun.isdisjoint(self.ends)

    def reaches_plainly(self, seen: str) -> bool:
        """``reaches`` of letters alone: one word, in which repeated letters may go."""
        begun, last = {""}, ""
        for letter in seen:
            after = set(begun) if letter == last else set()
            for word in begun:
                word += letter
                if word in self.stems:
                    return True
                if word in self.beginnings:
                    after.add(word)
            if not after:
                return False
            begun, last = after, letter
        return not begun.isdisjoint(self.ends)

    def decode(self, seen: str) -> str:
        """Viterbi: the best text, by the last ORDER - 1 letters as the state."""
        start = " " * (ORDER - 1)
        scores = {start: 0.0}
        back: list[dict[str, tuple[str, str]]] = []  # for each place the state before, and the letter
        for options in self.lattice(seen):
            after: dict[str, float] = {}
            steps: dict[str, tuple[str, str]] = {}
            for state, score in scores.items():
                for letter, channel in options:
                    total, now = score + channel, state
                    if letter and not (letter == " " and state.endswith(" ")):
                        total += self.model.cost(state, letter, self.memo)
                        now = (state + letter)[1:] if letter != " " else start
                    if now not in after or after[now] < total:
                        after[now] = total
                        steps[now] = state, letter
            scores = after
            back.append(steps)
            if len(self.memo) > KEPT_WORDS:
                self.memo.clear()
        ends = {s: score + self.model.cost(s, " ", self.memo) for s, score in scores.items()}
        best = max(ends.values())
        return max(self.read(back, s) for s, score in ends.items() if score == best)

    @staticmethod
    def read(back: list[dict[str, tuple[str, str]]], state: str) -> str:
        """The text of the best path to a last state."""
        letters = []
        for steps in reversed(back):
            state, letter = steps[state]
            letters.append(letter)
        return "".join(reversed(letters))

    def spot(self, seen: str) -> str:
        """A spot of any length as it reads once restored."""
        found = self.known.get(seen)
        if found is None:
            found = self.decode(seen)
            self.letters += len(seen)
            if self.letters > KEPT_LETTERS:
                self.known.clear()
                self.letters = len(seen)
            self.known[seen] = found
        return found

    def odd(self, token: str) -> bool:
        if _REPEAT.search(token) or _STRANGE.search(token):
            return True
        return bool(_STRANGE.search(token.translate(_SEPARATED)))

    def matters(self, seen: str, found: list[str]) -> bool:
        """Whether the restored spot could tell more than the words found as they stand."""
        return not found or self.heads is None or self.reaches(seen)

    def weightless(self, token: str) -> bool:
        """Whether a token is surely one word that, however read, has none of the heads.

        Letters without a repeat among the first ones begin alike in every reading.
        """
        if self.heads is None:
            return False
        core = token.strip(_EDGES).rstrip("!" + _EDGES)
        head = core[: PREFIXES.start]
        if len(head) < PREFIXES.start or head in self.heads:
            return False
        a, b, c, d = head
        if not a != b != c != d or not core.isalpha() or not _SIGN_LETTERS.isdisjoint(head):
            return False
        return len(core) == len(token) or len(core) == len(token.strip(_OTHER_EDGES))

    def words(self, token: str) -> list[str]:
        """Words of a token in lower case, with what an odd token may stand for."""
        core = token.strip(_EDGES).rstrip("!" + _EDGES)
        if core.isascii() and core.isalpha():  # most tokens: one word between marks
            found, odd = [core], _REPEAT.search(core)
        else:
            found, odd = _WORD.findall(token), core and self.odd(core)
        if odd and self.matters(core, found):
            found += _WORD.findall(self.spot(core))
        if len(core) < len(token):
            whole = token.strip(_OTHER_EDGES)
            if len(core) < len(whole) and self.odd(whole) and self.matters(whole, found):
                found += _WORD.findall(self.spot(whole))
        return found

    def tokens(self, text: str, spaced: bool) -> set[str]:
        """Distinct tokens of a text, and the words of its spaced-out runs."""
        text = text.lower()
        if not text.isascii():
            text = text.translate(INVISIBLE) if _INVISIBLE.search(text) else text
        found = set(text.split())
        if spaced:
            for run in _SINGLES.findall(text):
                found.update(self.singles(run).split())
        return found

    def singles(self, run: str) -> str:
        """A run of single letters, decoded as a whole."""
        letters = run.split()
        # A word of one letter may stand before the spaced one.
        parts = [" ".join(letters), " ".join(letters[1:])] if len(letters) > 3 else [" ".join(letters)]
        return " ".join(self.spot(p) for p in parts if _LETTER.search(p))


def spaced_out(texts: pa.Array) -> list[bool]:
    """Whether a text has three words of one letter in a row."""
    out: list[bool] = []
    for first, data, offsets in W.byte_slices(texts):
        start, stop = W.bounds(data, offsets)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        single = lead[stop] - lead[start] == 1
        word = np.searchsorted(start, offsets)
        run = np.zeros(len(start) + 1, dtype=np.int64)
        run[1:-2] = np.cumsum(single[:-2] & single[1:-1] & single[2:]) if len(start) > 2 else 0
        if len(start) > 2:
            run[-2:] = run[-3]
        last = np.maximum(word[1:] - 2, word[:-1])
        out += (run[np.minimum(last, len(start))] > run[word[:-1]]).tolist()
    return out


class WordScorer:
    """Weights of words: the largest of the word's and its beginnings'."""

    def __init__(self, weights: dict[str, float], prior: float):
        self.weights, self.prior = weights, prior
        # Words that begin otherwise have none of the features.
        self.heads = {f[: PREFIXES.start] for f in weights}
        self.kept: dict[str, float] = {}
        self.tokens: dict[str, float] = {}
        self.weightless: set[str] = set()  # tokens of the weight 0
        self.strong: dict[str, dict[str, float]] = {}

    def weight(self, word: str) -> float:
        if word[: PREFIXES.start] not in self.heads:
            return 0.0
        found = self.kept.get(word)
        if found is None:
            if len(self.kept) > KEPT_WORDS:
                self.kept.clear()
            get = self.weights.get
            found = max(get(f, 0.0) for f in features(word))
            self.kept[word] = found
        return found

    def token(self, token: str, restorer: Restorer) -> float:
        """Largest weight of a token's words; suspicious words are kept by token."""
        found = self.tokens.get(token)
        if found is None:
            if len(self.tokens) + len(self.weightless) > KEPT_WORDS:
                self.tokens.clear()
                self.weightless.clear()
                self.strong.clear()
            if restorer.weightless(token):
                self.weightless.add(token)
                return 0.0
            words = restorer.words(token)
            found = max(map(self.weight, words), default=-1.0)
            if found == 0.0:
                self.weightless.add(token)
                return 0.0
            self.tokens[token] = found
            if found >= 0.5:
                weights = {w: self.weight(w) for w in words}
                self.strong[token] = {w: x for w, x in weights.items() if x >= 0.5}
        return found

    def score(self, tokens: set[str], restorer: Restorer) -> float:
        get, make = self.tokens.get, self.token
        marks = {}
        rest = tokens - self.weightless
        highest = -1.0 if len(rest) == len(tokens) else 0.0
        for token in rest:
            weight = get(token)
            if weight is None:
                weight = make(token, restorer)
            if weight > highest:
                highest = weight
            if weight >= 0.5:
                if token not in self.strong:  # the table has begun anew since
                    del self.tokens[token]
                    make(token, restorer)
                marks.update(self.strong[token])
        if marks:
            return 1.0 - math.prod(sorted(1.0 - w for w in marks.values()))
        return self.prior if highest < 0.0 else highest


def features(word: str) -> list[str]:
    """A word and its beginnings (marked by a dash)."""
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) >= n)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map task: words of each batch with their counts."""
    for batch in batches:
        counts: Counter[str] = Counter()
        for text in batch.column(0).to_pylist():
            if text:
                counts.update(text.lower().split())
        words: Counter[str] = Counter()
        for token, n in counts.items():
            word = token.strip(_EDGES)
            if word.isalpha():
                words[word] += n
        del counts
        yield pa.RecordBatch.from_pydict(
            {
                "word": pa.array(list(words), pa.string()),
                "n": pa.array(list(words.values()), pa.int64()),
            }
        )


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map task: n-gram tables of its words."""
    table = np.zeros((ORDER, 1 << TABLE_BITS))
    for batch in batches:
        words = batch.column(0).to_pylist()
        weights = 1.0 + np.log2(batch.column(1).to_numpy())
        for i in range(0, len(words), 50_000):
            table += gram_table(words[i : i + 50_000], weights[i : i + 50_000])
    places = np.flatnonzero(table)
    yield pa.RecordBatch.from_pydict(
        {"place": pa.array(places), "n": pa.array(table.reshape(-1)[places])}
    )


def character_model(docs: DataFrame) -> CharacterModel:
    """The language model of all words of all documents.

    The driver gets at most ORDER * 2 ** TABLE_BITS figures.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = (
        docs.select("text")
        .mapInArrow(lean(_count_words), "word string, n long")
        .repartition(tasks, "word")  # as many tasks for the n-grams of the words
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )
    grams = (
        words.mapInArrow(lean(_count_grams), "place long, n double")
        .groupBy("place")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    counts = np.zeros(ORDER << TABLE_BITS, dtype=np.float32)
    # Sums of fractions depend on their order; rounding makes reruns agree.
    counts[grams["place"].to_numpy()] = np.round(grams["n"].to_numpy(), 2)
    return CharacterModel(counts.reshape(ORDER, -1))


def _document_features(shared):
    """Map task: weight of the documents by label that hold each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            sums: dict[str, list[float]] = {}
            spaced = spaced_out(batch.column(0))
            for text, toxic, weight, odd in zip(*batch.columns, spaced):
                tokens = restorer.tokens(text.as_py() or "", odd)
                words = {w for t in tokens for w in restorer.words(t)}
                own, weight = toxic.as_py(), weight.as_py()
                for f in {f for w in words for f in features(w)}:
                    if f not in sums:
                        sums[f] = [0.0, 0.0]
                    sums[f][own] += weight
            clean, dirty = zip(*sums.values()) if sums else ((), ())
            yield pa.RecordBatch.from_pydict(
                {
                    "feature": pa.array(list(sums), pa.string()),
                    "clean": pa.array(clean, pa.float64()),
                    "toxic": pa.array(dirty, pa.float64()),
                }
            )

    return run


def _weighted(sample: DataFrame) -> DataFrame:
    """Documents with a weight: one part in the number of their group of near copies."""
    groups = stage(
        jaccard_join(
            sample.select(F.col("document").alias("doc_id"), "text"), COPY_WORDS, *COPY_SIMILARITY
        ).select(F.col("doc_id").alias("document"), "component_id"),
        "fit-copies",
    )
    sizes = groups.groupBy("component_id").agg((1 / F.count("*")).alias("weight"))
    return sample.join(groups.join(sizes, "component_id").select("document", "weight"), "document")


def held_out(doc_id: str = "doc_id"):
    """Whether a document's labels may not be learnt from."""
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == 0, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, model, fit_documents: int = FIT_DOCUMENTS
) -> WordScorer:
    """The classifier, from labelled documents outside the held-out fold.

    ``model`` is a broadcast language model. The driver gets the features that
    enough toxic documents of the bounded sample hold.
    """
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .where(~held_out())
        .groupBy(F.col("doc_id").alias("__doc"))
        .agg(F.max(F.when(F.col("toxic") != 0, 1).otherwise(0)).alias("__toxic"))
    )
    chosen = stage(known.orderBy(F.xxhash64("__doc"), "__doc").limit(fit_documents), "fit-labels")
    sample = stage(
        docs.select("doc_id", "text")
        .join(chosen, F.col("doc_id") == F.col("__doc"))
        .groupBy(F.xxhash64("text").alias("document"))  # a text counts once
        .agg(F.first("text").alias("text"), F.max("__toxic").cast("int").alias("toxic"))
        .select("text", "document", "toxic"),
        "fit-documents",
    )
    # Spread over the tasks that the session has for a shuffle.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = stage(_weighted(sample), "fit-weights").select("text", "toxic", "weight")
    spread = spread.repartition(tasks)
    n = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if not n.n:
        return WordScorer({}, 0.0)
    prior = n.toxic / n.n
    found = (
        spread.mapInArrow(
            lean(_document_features(model)), "feature string, clean double, toxic double"
        )
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.round("toxic", 6) >= LEAST_TOXIC)  # weights are parts of one
        .withColumn(
            "weight",
            F.round(
                (F.col("toxic") + PRIOR_DOCUMENTS * prior)
                / (F.col("toxic") + F.col("clean") + PRIOR_DOCUMENTS),
                6,
            ),
        )
        .where(F.col("weight") >= min(2 * prior, 0.5))
        .select(
            "feature",
            F.when(
                F.col("feature").endswith("-")
                & (F.col("clean") > CLEAN_SHARE * (F.col("clean") + F.col("toxic"))),
                F.col("weight") / 2,
            )
            .otherwise(F.col("weight"))
            .alias("weight"),
        )
        .collect()
    )
    return WordScorer({r.feature: r.weight for r in found}, prior)


def toxicity(
    docs: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS
) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (score >= 0.5)."""
    context = docs.sparkSession.sparkContext
    model = context.broadcast(character_model(docs))
    fitted = fit(docs, labels, model, fit_documents)
    scorer = context.broadcast((fitted.weights, fitted.prior))

    kept = docs.select([c for c in docs.columns if c.lower() not in OUT_COLUMNS])
    names = list(kept.columns)
    text_at = [c.lower() for c in names].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordScorer(*scorer.value)
        restorer = Restorer(model.value, words.heads, words.weights)
        for batch in batches:
            texts = batch.column(text_at)
            scores = [
                words.score(restorer.tokens(t.as_py() or "", odd), restorer)
                for t, odd in zip(texts, spaced_out(texts))
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], names=[*names, "score"]
            )

    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])
    scored = kept.mapInArrow(lean(run), schema)
    return scored.withColumn("held_out", held_out()).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)
    )


OUT_COLUMNS = ("held_out", "score", "predicted")
