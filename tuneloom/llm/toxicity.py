"""Toxicity of texts after noisy-channel deobfuscation.

A character language model (trigrams over all texts) restores what was written in leetspeak, spelled with
gaps or stretched by repetition: each doubtful word becomes a lattice of what its characters may stand
for, and Viterbi decoding finds the likeliest path under the model. Words without such signs have a
lattice of one path and stay as they are. Restored words are weighed by how much likelier toxic texts hold them,
or words that begin or end like them; the strongest words of a text make its score.

Weights and calibration are fitted on at most ``sample_rows`` labelled rows, dealt by a hash of the id;
the language model counts every text.

Defined results: null and blank texts are scored by the calibration's constant; of an id labelled more
than once the larger label counts; without labelled rows every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tuneloom.llm.common import worker_state

SYMBOLS = 64  # boundary, a-z, the letters of Latin-1, any other letter
OTHER = 63
#: What a character may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
GAPS = " .-_*~'/,;:"
SINGLE = r"[\w@$!|+(€£]"
#: Three or more single characters between white space; punctuation may stand around them.
SPELLED = re.compile(rf"(?<!\S)[\"'«(\[{{]*({SINGLE}(?:\s+{SINGLE}){{2,}})[.,;:!?)\]}}\"'»…]*(?!\S)")
STRETCHED = re.compile(r"(.)\1\1")
COST_SUBSTITUTE, COST_GAP, COST_STRETCH = 1.0, 0.5, 1.5
COST_BREAK, COST_LOST = 2.0, 8.0  # a gap, or a stand-in, that does end a word
CHANCE = float(np.log(SYMBOLS))  # per symbol; stand-ins alone are a word if their reading is likelier than this
MOST_WORDS_HELD = 150_000


def symbol_table() -> np.ndarray:
    """Symbol of each code point below 256 of a lower-case text; 0 is a boundary."""
    table = np.zeros(256, dtype=np.int64)
    table[ord("a"):ord("z") + 1] = np.arange(1, 27)
    latin = [c for c in range(0xDF, 0x100) if c != 0xF7]
    table[latin] = np.arange(27, 27 + len(latin))
    return table


TABLE = symbol_table()


def symbols(text: str) -> np.ndarray:
    """Symbols of ``text``, between boundaries; runs of boundaries are kept."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")
    wide = points >= 256
    found = TABLE[np.where(wide, 0, points)]
    if wide.any():
        found[wide] = [OTHER if chr(p).isalpha() else 0 for p in points[wide].tolist()]
    return found


def trigram_counts(texts: Column, docs: DataFrame) -> np.ndarray:
    """Counts of symbol trigrams over all rows; the table's size is fixed, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("trigrams",))  # what an earlier step kept goes
        total, pieces, held = np.zeros(SYMBOLS**3, dtype=np.int64), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    s = np.concatenate(([0, 0], symbols(text), [0, 0]))
                    codes = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
                    pieces.append(codes)
                    held += len(codes)
                if held > 1 << 19:
                    total += np.bincount(np.concatenate(pieces), minlength=SYMBOLS**3)
                    pieces, held = [], 0
        if pieces:
            total += np.bincount(np.concatenate(pieces), minlength=SYMBOLS**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["trigram", "n"])

    rows = docs.select(texts.alias("text")).mapInArrow(count, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS**3)
    for trigram, n in rows:
        counts[trigram] = n
    return counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


class CharModel:
    """Log-probabilities of a symbol after two others, smoothed by shorter contexts."""

    def __init__(self, counts: np.ndarray):
        counts = counts.copy()
        counts[0, 0, 0] = 0  # white space upon white space says nothing about words
        two, one = counts.sum(axis=0), counts.sum(axis=(0, 1))
        p1 = (one + 1) / (one + 1).sum()
        p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
        p3 = (counts + 5 * p2[None]) / (counts.sum(axis=2, keepdims=True) + 5)
        self.logs = np.log(p3).astype(np.float32).tolist()

    def decode(self, word: str) -> str:
        """The likeliest reading of a lower-case word or spelled-out run; boundaries become spaces."""
        return self.likeliest(word)[1]

    def likeliest(self, word: str) -> tuple[float, str]:
        """The likeliest reading and its score."""
        logs, best = self.logs, {(0, 0): (0.0, "")}
        for options in lattice(word):
            reached: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, text) in best.items():
                for cost, letters in options:
                    x, y, s = a, b, score - cost
                    for letter, symbol in letters:
                        if not (symbol == 0 and y == 0):
                            s += logs[x][y][symbol]
                            x, y = y, symbol
                    if (x, y) not in reached or s > reached[x, y][0]:
                        reached[x, y] = (s, text + "".join(letter for letter, _ in letters))
            best = reached
        ended = ((score + (logs[a][b][0] if b else 0.0), text) for (a, b), (score, text) in best.items())
        return max(ended)


def _symbol(letter: str) -> int:
    return int(TABLE[ord(letter)]) if ord(letter) < 256 else OTHER if letter.isalpha() else 0


def lattice(word: str) -> list[list[tuple[float, list[tuple[str, int]]]]]:
    """Per run of equal characters: costs and letters it may stand for."""
    steps, at = [], 0
    while at < len(word):
        end = at + 1
        while end < len(word) and word[end] == word[at]:
            end += 1
        char, run = word[at], end - at
        options = []
        if char.isalpha():
            own = (char, _symbol(char))
            options.append((0.0, [own] * run))
            if run > 2:
                options += [(COST_STRETCH, [own]), (COST_STRETCH, [own, own])]
        else:
            options.append((COST_LOST if char in STANDS_FOR else COST_BREAK, [(" ", 0)]))
            if char in GAPS or char in STANDS_FOR and not char.isalnum():
                options.append((COST_GAP, []))
            for letter in STANDS_FOR.get(char, ""):
                stand_in = (letter, _symbol(letter))
                options.append((COST_SUBSTITUTE, [stand_in] * run))
                if run > 2:
                    options.append((COST_SUBSTITUTE + COST_STRETCH, [stand_in]))
        steps.append(options)
        at = end
    return steps


def doubtful(word: str) -> bool:
    """Whether a word's lattice has more than one path worth a look: it mixes letters with others, or stretches one."""
    if word.isalpha():
        return bool(STRETCHED.search(word))
    return any(map(str.isalpha, word))


def stand_ins_only(word: str) -> bool:
    """Whether a word is written without letters, with three stand-ins or more."""
    return sum(c in STANDS_FOR for c in word) > 2 and all(c in STANDS_FOR or c in GAPS for c in word)


class Restorer:
    """Words of texts as they were meant, with the readings of recent words at hand."""

    def __init__(self, model: CharModel, most_held: int = MOST_WORDS_HELD):
        self._model, self._most = model, most_held
        self._readings: dict[str, list[str]] = {}

    def reading(self, word: str) -> list[str]:
        known = self._readings.get(word)
        if known is None:
            plain = word.strip(".,;:!?()[]{}\"'«»…|-")
            if plain.isalpha() and not STRETCHED.search(plain):
                known = [plain]
            else:
                known = self._model.decode(word).split() if doubtful(word) else self._without_letters(plain) if plain else []
            if len(self._readings) >= self._most:
                self._readings.clear()
            if len(word) <= 64 and self._most:
                self._readings[word] = known
        return known

    def _without_letters(self, word: str) -> list[str]:
        """The reading of stand-ins if the model takes it for a word; a stand-in lost makes it too dear, and numbers stay."""
        if not stand_ins_only(word):
            return [word]
        score, reading = self._model.likeliest(word)
        return reading.split() if score > -CHANCE * (len(reading) + 1) else [word]

    def _run(self, run: str) -> str:
        """The reading of single characters, whatever white space is between them."""
        return self._model.decode(" ".join(run.split()))

    def spelled(self, text: str) -> list[str]:
        """Readings of runs of single characters."""
        return [word for run in SPELLED.findall(text) for word in self._run(run).split()]

    def restore(self, text: str) -> str:
        """The whole text in lower case with its doubtful words replaced by their readings."""
        text = SPELLED.sub(lambda run: self._run(run.group(1)), text.lower())
        return " ".join(reading for word in text.split() for reading in self.reading(word))


def features(word: str) -> list[str]:
    """The word, its beginnings and its ends."""
    return [word] + ["^" + word[:n] for n in (3, 4, 5, 6) if len(word) > n] + [word[-n:] + "$" for n in (4, 5) if len(word) > n]


class ToxicityModel:
    """A fitted model; ``evidence`` and ``score`` make columns."""

    def __init__(self, spark, counts: np.ndarray, weights: dict[str, float], line: list[float], key: str):
        self._shared, self._key, self.line = spark.sparkContext.broadcast((counts, weights)), key, line

    def evidence(self, text: Column) -> Column:
        """Weights of the two strongest words and the log of how many are strong."""
        shared, key = self._shared, self._key

        @F.pandas_udf("array<double>")
        def evidence(texts: pd.Series) -> pd.Series:
            state = worker_state(("toxicity", key))
            if not state:
                counts, weights = shared.value
                # The weights of words are held, so their readings needn't be.
                state.update(restorer=Restorer(CharModel(counts), 0), weights=weights, held={})
            restorer, weights, held = state["restorer"], state["weights"], state["held"]

            def weigh(word: str) -> float:
                weight = max((weights.get(f, 0.0) for reading in restorer.reading(word) for f in features(reading)), default=0.0)
                if len(held) >= MOST_WORDS_HELD:
                    held.clear()
                if len(word) <= 64:
                    held[word] = weight
                return weight

            out = []
            for text in texts:
                low = (text or "").lower()
                words = set(low.split())
                found = [held[w] if w in held else weigh(w) for w in words]
                for word in set(restorer.spelled(low)):
                    found.append(max((weights.get(f, 0.0) for f in features(word)), default=0.0))
                strong = sorted((w for w in found if w > 0), reverse=True)
                out.append([*(strong + [0.0, 0.0])[:2], float(np.log1p(sum(w > 4 for w in strong)))])
            return pd.Series(out)

        return evidence(text)

    def score(self, evidence: Column) -> Column:
        total = F.lit(self.line[0])
        for at, factor in enumerate(self.line[1:]):
            total = total + F.lit(factor) * evidence[at]
        return 1 / (1 + F.exp(-total))


def _feature_counts(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """``feature, toxic, clean``: texts of either kind that have a feature; ``texts`` has ``text, label``."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("features",))
        restorer = None
        for batch in batches:
            restorer = restorer or Restorer(CharModel(shared.value))
            seen = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low = (text or "").lower()
                words = {reading for word in set(low.split()) for reading in restorer.reading(word)} | set(restorer.spelled(low))
                seen[label].update({f for word in words for f in features(word)})
            names = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([seen[1][f] for f in names], pa.int64()), pa.array([seen[0][f] for f in names], pa.int64())],
                names=["feature", "toxic", "clean"])

    counted = texts.select("text", "label").mapInArrow(count, "feature string, toxic long, clean long")
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _fit_line(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression by Newton's method, with a little shrinkage."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + 0.1 * w
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.1 * np.eye(len(w)), gradient)
    return w.tolist()


def held_out(doc_id: Column, parts: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % parts == 0


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
        sample_rows: int = 20_000, most_features: int = 200_000, least_texts: int = 5) -> ToxicityModel:
    """Fit on the labelled rows of ``docs`` that are not held out; at most ``sample_rows`` of them.

    Three quarters of the sample give the words' weights, the last quarter the line from evidence to score.
    """
    spark = docs.sparkSession
    counts = trigram_counts(F.col(text), docs)
    known = labels.filter(F.col(label).isNotNull() & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("label"))
    known = known.withColumn("deal", F.xxhash64(F.lit(3), "id")).orderBy("deal").limit(sample_rows)
    # At most sample_rows ids.
    sample = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id")
    for_weights = F.pmod("deal", F.lit(4)) != 0
    toxic, clean = (sample.filter(for_weights).groupBy().agg(F.sum("label"), F.sum(1 - F.col("label"))).first() or (0, 0))
    key = f"{spark.sparkContext.applicationId}-{np.random.default_rng().integers(1 << 62)}"
    if not toxic or not clean:
        return ToxicityModel(spark, counts, {}, [-50.0, 0.0, 0.0, 0.0], key)
    odds = F.log((F.col("toxic") + 1) / (F.col("clean") + 1) * F.lit((clean + 2) / (toxic + 2)))
    weighed = _feature_counts(sample.filter(for_weights), counts).filter(F.col("toxic") >= least_texts).withColumn("w", odds).filter("w > 1")
    weights = {row["feature"]: row["w"] for row in weighed.orderBy(F.desc("w"), "feature").limit(most_features).select("feature", "w").collect()}
    model = ToxicityModel(spark, counts, weights, [], key)
    rest = sample.filter(~for_weights).select(model.evidence(F.col("text")).alias("x"), "label").toPandas()
    if rest["label"].nunique() < 2:
        return ToxicityModel(spark, counts, weights, [-4.0, 1.0, 0.0, 0.0], key + "-")
    model.line = _fit_line(np.array(rest["x"].tolist()), rest["label"].to_numpy(dtype=float))
    return model


def scored(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` as ``row`` with ``score``."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), model.evidence(F.col(text)).alias("evidence"))
    return rows.select("row", model.score(F.col("evidence")).alias("score"))
