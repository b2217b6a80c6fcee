"""Reading level of the English prose in documents: boosted regression trees over distributions of length, vocabulary, syntax and cohesion,
cross-validated source by source and calibrated to grades on the held-out predictions."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veloframe.llm.prose import N_DISTRIBUTIONS, N_FEATURES, Grades, Lexicon, beginning, distinct_words, distributions, ending, features, proses, vocabulary
from veloframe.llm.trees import Boosted, boost
from veloframe.storage import materialize

#: The model is trained on at most this many labelled rows, those of the least hash of their id; the bound keeps training on the driver
#: small. Their texts are read whole, on the executors, like those to be graded; the driver gets distributions and counts of distinct words.
MAX_LABELLED = 20_000
#: A word, ending or beginning gets a grade once this many labelled texts have it.
LEAST_TEXTS = 3
#: So many words that occur in the most labelled texts count as function words.
COMMON = 150
#: Sources are dealt into at most this many folds.
FOLDS = 8
LEVELS = 5


@dataclass(frozen=True)
class ReadingModel:
    grades: Grades
    trees: Boosted
    cuts: list[float]
    validation: list[tuple[str | None, int, float, float, int, int, int]]  # source, n, rmse, accuracy, and of the top level: cases, found, right

    def level(self, score: np.ndarray, empty: np.ndarray) -> np.ndarray:
        return np.where(empty, 0, np.searchsorted(self.cuts, score)).astype(np.int32)


class Bags:
    """Distinct words of texts and how often each occurs, as flat arrays; ``parts`` are what gets a grade: words, endings, beginnings."""

    def __init__(self, texts: list[str], counts: list[np.ndarray], common: frozenset[str]):
        """texts: the distinct words of each text, separated by spaces."""
        number: dict[str, int] = {}
        ids = [np.array([number.setdefault(w, len(number)) for w in t.split()], np.int64) for t in texts]
        none = [np.zeros(0, np.int64)]
        self.names, self.common = list(number), common
        self.ids = np.concatenate(none + ids)
        self.text = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        self.counts = np.concatenate(none + [np.asarray(c, np.int64) for c in counts])
        self.parts = []
        for of in (lambda w: w, ending, beginning):
            names = [of(w) for w in self.names]
            kinds = {x: i for i, x in enumerate(dict.fromkeys(names))}
            self.parts.append((list(kinds), np.array([kinds[x] for x in names], np.int64)))

    def grades(self, y: np.ndarray, taken: np.ndarray) -> list[np.ndarray]:
        """By word, ending and beginning the mean level, drawn to the general mean, of the taken texts that have it; NaN without a grade."""
        mean, out = float(y[taken].mean()) if taken.any() else 0.0, []
        for names, of in self.parts:
            pairs = np.unique(self.text[taken[self.text]] * max(len(names), 1) + of[self.ids[taken[self.text]]])
            kind, text = pairs % max(len(names), 1), pairs // max(len(names), 1)
            n, total = np.bincount(kind, minlength=len(names)), np.bincount(kind, y[text], len(names))
            g = np.where(n >= LEAST_TEXTS, (total + mean) / (n + 1), np.nan)
            out.append(np.where(np.array(names, object) == "", np.nan, g))
        return out

    def table(self, grades: list[np.ndarray], texts: np.ndarray) -> np.ndarray:
        """Rows of the vocabulary features of these texts."""
        columns = [np.zeros(len(self.names))] * 2 + [np.array([w in self.common for w in self.names], float)] + [g[of] for g, (_, of) in zip(grades, self.parts, strict=True)]
        place = np.full(int(self.text.max(initial=-1)) + 1 if len(self.text) else 0, -1)
        place = np.full(max(len(place), int(texts.max(initial=-1)) + 1), -1)
        place[texts] = np.arange(len(texts))
        mine = place[self.text] >= 0
        return vocabulary(np.repeat(self.ids[mine], self.counts[mine]), np.repeat(place[self.text[mine]], self.counts[mine]), len(texts), np.stack(columns, 1))

    def learned(self, grades: list[np.ndarray]) -> Grades:
        named = [{names[i]: float(g[i]) for i in np.flatnonzero(~np.isnan(g)).tolist()} for g, (names, _) in zip(grades, self.parts, strict=True)]
        return Grades(*named, self.common)


@dataclass(frozen=True)
class Training:
    """The labelled rows: levels, folds, distributions and words."""

    y: np.ndarray
    fold: np.ndarray
    plain: np.ndarray
    bags: Bags

    def table(self, rows: np.ndarray, grades: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([self.plain[rows], self.bags.table(grades, rows)], 1) if len(rows) else np.zeros((0, N_FEATURES))

    def fit(self, outer: int | None) -> Boosted | np.ndarray:
        """Scores of the rows of a fold by a model of the others, or the model of all rows. Each row is described by grades of words from other folds
        than its own."""
        parts, at = [np.zeros((0, N_FEATURES))], [np.zeros(0, int)]
        for g in sorted(set(self.fold.tolist()) - {outer}):
            mine = np.flatnonzero(self.fold == g)
            parts.append(self.table(mine, self.bags.grades(self.y, (self.fold != g) & (self.fold != outer))))
            at.append(mine)
        model = boost(np.concatenate(parts), self.y[np.concatenate(at)])
        if outer is None:
            return model
        return model.predict(self.table(np.flatnonzero(self.fold == outer), self.bags.grades(self.y, self.fold != outer)))


def _cuts(score: np.ndarray, y: np.ndarray) -> list[float]:
    """Between each two grades, the middle of the cut points with the fewest held-out rows on the wrong side; ascending."""
    out = []
    for k in range(LEVELS):
        at = np.linspace(k + 0.02, k + 0.98, 97)
        wrong = ((score[None, :] > at[:, None]) != (y > k)[None, :]).sum(1) if len(y) else np.zeros(len(at))
        best = at[wrong == wrong.min()]
        out.append(float(best[len(best) // 2]))
    return np.maximum.accumulate(out).tolist()


def train(documents: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", level: str = "reading_level", source: str = "source") -> ReadingModel:
    """A model from labelled documents. Words, endings and beginnings are graded, for the rows of a fold, on the other folds only; folds are
    whole sources (rows of one source alone are dealt by id instead). Labels that are null or outside 0..5, of unknown documents, or repeated
    with another level, are left out, and of documents with one id one text counts; without labels every document with prose gets level 0."""
    ok = labels.filter(F.col(level).between(0, LEVELS) & F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.min(level).alias("y"), F.max(level).alias("z")).filter("y = z")
    ok = ok.orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED).select("id", "y")
    spark = documents.sparkSession
    rows = documents.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), F.col(source).cast("string").alias("source")).join(F.broadcast(ok), "id")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(2), b.column(3).cast(pa.float64()), pc.utf8_length(texts.fill_null("")).cast(pa.int64()), pa.array(proses(texts), pa.string())], names=["id", "source", "y", "n_chars", "prose"])

    found = rows.select("id", "text", "source", "y").mapInArrow(find, "id string, source string, y double, n_chars long, prose string")
    found = materialize(found.groupBy("id").agg(F.min(F.struct("prose", "n_chars", "source", "y")).alias("r")).select("id", "r.*"), "labelled")  # MAX_LABELLED rows at most

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"word": [w for p in pdf["prose"] for w in distinct_words(p)]})

    common = frozenset(r["word"] for r in found.select("prose").mapInPandas(split, "word string").groupBy("word").count().orderBy(F.desc("count"), "word").limit(COMMON).collect())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lexicon, p = Lexicon(Grades(common=common)), pdf["prose"].tolist()
            tokens, of = lexicon.tokens(p)
            plain, w, d = distributions(tokens, of, len(p), lexicon.table, np.array([len(x) for x in p]), pdf["n_chars"].to_numpy())
            bags = [Counter(x.tolist()) for x in np.split(w, np.searchsorted(d, np.arange(1, len(p))))] if len(p) else []
            yield pd.DataFrame({"id": pdf["id"], "source": pdf["source"], "y": pdf["y"], "empty": [not x for x in p], "plain": list(plain), "words": [" ".join(lexicon.word[i] for i in b) for b in bags], "counts": [list(b.values()) for b in bags]})

    sample = found.mapInPandas(read, "id string, source string, y double, empty boolean, plain array<double>, words string, counts array<int>").toPandas().sort_values("id", ignore_index=True)  # bounded, see above
    y, empty = sample["y"].to_numpy(float), sample["empty"].to_numpy(bool)
    plain = np.array(sample["plain"].tolist(), float).reshape(len(y), N_DISTRIBUTIONS)
    bags = Bags(sample["words"].tolist(), sample["counts"].tolist(), common)
    origin = sample["source"].where(sample["source"].notna(), None)
    names = sorted(origin.dropna().unique())
    if len(names) + origin.isna().any() > 1:
        fold = origin.map({s: i % FOLDS for i, s in enumerate(names)}).fillna(len(names) % FOLDS).to_numpy(int)
    else:
        fold = np.arange(len(y)) % FOLDS
    present = sorted(set(fold.tolist()))

    # each fold, and at last the whole, is trained in a task of its own
    shared = spark.sparkContext.broadcast((y, fold, plain, bags))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = Training(*shared.value)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "found": [pickle.dumps(data.fit(present[i] if i < len(present) else None)) for i in pdf["id"]]})

    found = {r["id"]: pickle.loads(r["found"]) for r in spark.range(0, len(present) + 1, 1, len(present) + 1).mapInPandas(fit, "id long, found binary").collect()}  # FOLDS + 1 rows
    score = np.zeros(len(y))
    for i, f in enumerate(present):
        score[fold == f] = found[i]
    model = ReadingModel(bags.learned(bags.grades(y, np.ones(len(y), bool))), found[len(present)], _cuts(score, y), [])
    got = model.level(score, empty)
    report = []
    for s in [*names, None]:
        m = (origin.isna() if s is None else origin == s).to_numpy()
        if m.any():
            top, hit = y[m] == LEVELS, got[m] == LEVELS
            report.append((s, int(m.sum()), float(np.sqrt(np.mean((score[m] - y[m]) ** 2))), float((got[m] == y[m]).mean()), int(top.sum()), int(hit.sum()), int((top & hit).sum())))
    model.validation.extend(report)
    return model


def grade(documents: DataFrame, model: ReadingModel, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, reading_score, reading_level`` of every document: the regression's value and the calibrated grade, 0 to 5.

    Whole texts are read. Null and empty texts, and texts without running English prose, have level 0; repeated rows are graded alike."""
    kind = documents.schema[id].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(model)  # grades of the words of MAX_LABELLED texts and the trees: a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lexicon = Lexicon(m.grades)
        for b in batches:
            found = proses(b.column(1))
            score = m.trees.predict(features(found, pc.utf8_length(b.column(1).fill_null("")).to_numpy(zero_copy_only=False), lexicon))
            level = m.level(score, np.array([not p for p in found], bool))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array(level, pa.int32())], names=["id", "reading_score", "reading_level"])

    rows = documents.select(documents[id].alias("id"), documents[text].cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, reading_score double, reading_level int").withColumnRenamed("id", id)


def validation(model: ReadingModel, documents: DataFrame) -> DataFrame:
    """One row per held-out source: ``source, n, rmse, accuracy, top_cases, top_found, top_right``."""
    return documents.sparkSession.createDataFrame(model.validation, "source string, n long, rmse double, accuracy double, top_cases long, top_found long, top_right long")
