"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Evidence: word forms and word beginnings that stand in toxic rather than clean documents of a
labelled sample. A token's evidence, as a class of strength and support, is its observation. Tokens
of strong evidence in toxic documents are labelled 1, all others 0, and a two-state chain with
weights for a token's own and its neighbours' classes and for transitions is fitted to the sample's
whole texts, in pieces of SPAN tokens; equal pieces are one with a weight. Forward-backward marginals then give, per document, the expected number of toxic
tokens, the highest marginal and the offending offsets; a logistic curve over the first two and
their share, fitted to the sample's document labels, gives the score.

The sample is bounded (SAMPLE labelled documents, by hash of their ids), and with it all that is
collected of it; nothing of the sample is left out. Scoring reads every token of every text.

Defined cases: a null or empty text is scored as one without tokens; a null label isn't used;
without both classes in the sample every score is the share of toxic rows (0 without rows);
repeated rows each return a row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.llm.common import cut, text_of

#: Labelled documents that are learned from at most; tokens of a piece of them.
SAMPLE, SPAN = 20_000, 32
PREFIXES = (4, 5, 6)
LEAST_TOXIC, LEAST_ODDS = 3, 2.0
ODDS = np.array([3.0, 4.0, 5.0, 6.0, 7.0])
SUPPORT = np.array([8, 40])
CLASSES = 1 + (len(ODDS) + 1) * (len(SUPPORT) + 1)
STRONG = 3.5
#: Marginals that count towards a document's toxic tokens.
FLOOR = 0.05
#: Words whose classes a task keeps, cells of a padded matrix of tokens, and rows that are looked at together.
CACHE, CELLS, SLICE = 150_000, 250_000, 500
_word = re.compile(r"[^\W_]+")


def forms(word: str) -> list[str]:
    return [word] + [f"{word[:n]}*" for n in PREFIXES if len(word) > n]


@dataclass
class Model:
    evidence: dict[str, tuple[int, int]]  # form: toxic and clean documents of the sample
    toxic: int
    clean: int
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    moves: np.ndarray
    curve: np.ndarray

    def class_of(self, word: str, label: int | None = None) -> int:
        """Class of a word; for a document of the sample its own label is given, and it is left out of the counts."""
        best = (0.0, 0)
        for form in forms(word):
            toxic, clean = self.evidence.get(form, (0, 0))
            toxic, clean = toxic - (label == 1), max(0, clean - (label == 0))
            if toxic >= LEAST_TOXIC:
                odds = math.log((toxic + 0.5) / (self.toxic + 1)) - math.log((clean + 0.5) / (self.clean + 1))
                best = max(best, (odds, toxic))
        if best[0] < LEAST_ODDS:
            return 0
        return 1 + int(np.searchsorted(ODDS, best[0], side="right")) * (len(SUPPORT) + 1) + int(np.searchsorted(SUPPORT, best[1], side="right"))


def tokens(text: str) -> list[str]:
    return _word.findall(text.lower())


class Classes:
    """The class of each token, with a bounded table of words."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def of(self, words: list[str], label: int | None = None) -> np.ndarray:
        known = self.known.setdefault(label, {})
        new = set(words).difference(known)
        if len(known) + len(new) > CACHE:
            known.clear()
            new = set(words)
        for word in new:
            known[word] = self.model.class_of(word, label)
        return np.array([known[w] for w in words], dtype=np.int8)


def potentials(model: Model, classes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Odds of state 1 against 0 by the observations alone; classes is padded to the right with 0."""
    score = model.own[classes].copy()
    score[:, 1:] += model.before[classes[:, :-1]]
    score[:, :-1] += model.after[classes[:, 1:]]
    return np.exp(np.clip(score, -30, 30))


def chain(odds: np.ndarray, size: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages as odds of state 1 against 0, rows padded to the right."""
    m = np.exp(moves)
    width = odds.shape[1]
    forward, backward = np.empty_like(odds), np.ones_like(odds)
    forward[:, 0] = odds[:, 0]
    for t in range(1, width):
        r = forward[:, t - 1]
        forward[:, t] = odds[:, t] * (m[0, 1] + r * m[1, 1]) / (m[0, 0] + r * m[1, 0])
    for t in range(width - 2, -1, -1):
        e = odds[:, t + 1] * backward[:, t + 1]
        backward[:, t] = np.where(t + 1 < size, (m[1, 0] + m[1, 1] * e) / (m[0, 0] + m[0, 1] * e), 1.0)
    return forward, backward


def marginals(model: Model, documents: list[np.ndarray]) -> list[np.ndarray]:
    """Probability of state 1 of each token of each document."""
    out: list[np.ndarray] = [np.zeros(0)] * len(documents)
    order = sorted((i for i, d in enumerate(documents) if len(d)), key=lambda i: len(documents[i]))
    while order:
        width = len(documents[order[-1]])
        take = [i for i in order[-max(1, CELLS // width) :] if len(documents[i]) * 2 > width or width <= 64]
        order = order[: -len(take)]
        size = np.array([len(documents[i]) for i in take])
        padded = np.zeros((len(take), width), dtype=np.int8)
        for row, i in enumerate(take):
            padded[row, : size[row]] = documents[i]
        odds = potentials(model, padded, size)
        forward, backward = chain(np.asfortranarray(odds), size, model.moves)
        both = forward * backward
        p = both / (1 + both)
        for row, i in enumerate(take):
            out[i] = p[row, : size[row]]
    return out


def fit_chain(model: Model, classes: np.ndarray, labels: np.ndarray, times: np.ndarray, rounds: int = 150) -> None:
    """Maximum likelihood of the labels of pieces (rows of SPAN tokens), each of which stands so many times, by Adam, with a ridge."""
    width = classes.shape[1]
    n, size = times.sum(), np.full(len(classes), width)
    weight = times[:, None].astype(np.float64)
    weights = [model.own, model.before, model.after, model.moves]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), np.repeat(times, width - 1))
    for step in range(1, rounds + 1):
        odds = potentials(model, classes, size)
        forward, backward = chain(odds, size, model.moves)
        p = forward * backward / (1 + forward * backward)
        gap = (labels - p) * weight
        own = np.bincount(classes.ravel(), gap.ravel(), CLASSES)
        before = np.bincount(classes[:, :-1].ravel(), gap[:, 1:].ravel(), CLASSES)
        after = np.bincount(classes[:, 1:].ravel(), gap[:, :-1].ravel(), CLASSES)
        m, r, e = np.exp(model.moves), forward[:, :-1], (odds * backward)[:, 1:]
        joint = np.stack([np.full_like(r, m[0, 0]), m[0, 1] * e, m[1, 0] * r, m[1, 1] * r * e])
        moves = seen_moves - (joint / joint.sum(axis=0) * weight).sum(axis=(1, 2)).reshape(2, 2)
        for i, (w, g) in enumerate(zip(weights, (own, before, after, moves), strict=True)):
            g = g / n - 1e-4 * w
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            w += 0.1 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)


def document_features(p: np.ndarray) -> tuple[float, float, float]:
    """Highest marginal, log of the expected number of toxic tokens, and their share.

    Marginals below FLOOR count for nothing: of a very long clean text they would add up to toxic tokens.
    """
    if not len(p):
        return 0.0, 0.0, 0.0
    total = float(p[p >= FLOOR].sum())
    return float(p.max()), math.log1p(total), math.sqrt(total / len(p))


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [0.05] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_of(model: Model, features: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(features)), features]) @ model.curve, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits a model to at most `sample` rows of labels (doc_id, toxic) and their texts in docs."""
    chosen = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` pairs of numbers: broadcast
    rows = cut(docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "text").distinct())
    count = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = count.get(1, 0), count.get(0, 0)
    model = Model({}, toxic, clean, np.full(CLASSES, -1.0), np.zeros(CLASSES), np.zeros(CLASSES), np.zeros((2, 2)), np.zeros(4))
    if not toxic or not clean:
        share = toxic / max(1, toxic + clean)
        model.curve[0] = math.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return model

    def count_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [Counter(), Counter()]
                for text, label in zip(part.column("text"), part.column("toxic"), strict=True):
                    found[label.as_py() == 1].update({f for w in set(tokens(text.as_py())) for f in forms(w)})
                names = list(found[0].keys() | found[1].keys())
                yield pa.RecordBatch.from_pydict({"form": pa.array(names, pa.string()), "toxic": pa.array([found[1][x] for x in names], pa.int64()), "clean": pa.array([found[0][x] for x in names], pa.int64())})

    counted = rows.mapInArrow(count_forms, "form string, toxic long, clean long").groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    strong = counted.where(F.col("toxic") >= LEAST_TOXIC).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    model.evidence = {r.form: (r.toxic, r.clean) for r in strong.collect()}

    def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(model)
        for batch in batches:
            found: Counter = Counter()
            for text, label in zip(batch.column("text"), batch.column("toxic"), strict=True):
                line = classes.of(tokens(text.as_py()), label.as_py())
                padded = np.zeros(-(-len(line) // SPAN) * SPAN, dtype=np.int8)
                padded[: len(line)] = line
                for piece in padded.reshape(-1, SPAN):
                    # without evidence a piece is the same in either kind of document
                    found[piece.tobytes(), label.as_py() if piece.any() else 0] += 1
            yield pa.RecordBatch.from_pydict({"piece": pa.array([w for w, _ in found], pa.binary()), "toxic": pa.array([y for _, y in found], pa.int32()), "n": pa.array(list(found.values()), pa.int64())})

    pieces = rows.mapInArrow(cut_pieces, "piece binary, toxic int, n long").groupBy("piece", "toxic").agg(F.sum("n").alias("n")).orderBy("piece", "toxic").collect()
    x = np.stack([np.frombuffer(bytes(r.piece), dtype=np.int8) for r in pieces])
    strength = np.concatenate([[0.0], np.repeat(np.concatenate([[LEAST_ODDS], ODDS]), len(SUPPORT) + 1)])
    y = (strength[x] >= STRONG) & (np.array([r.toxic for r in pieces]) == 1)[:, None]
    fit_chain(model, x, y.astype(np.int64), np.array([r.n for r in pieces]))
    scored = _features(rows.select(F.lit(0).cast("long").alias("doc_id"), "text", "toxic"), model, keep="toxic").select("f0", "f1", "f2", "toxic").collect()
    model.curve = fit_curve(np.array([[r.f0, r.f1, r.f2] for r in scored]), np.array([r.toxic for r in scored], dtype=float))
    return model


def _features(docs: DataFrame, model: Model, keep: str | None = None, spans: bool = False, least: float = 0.5) -> DataFrame:
    """Features and score per document; keep names the label column of the sample's own rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(model)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = [x.as_py() or "" for x in part.column("text")]
                known = part.column(keep).to_pylist() if keep else [None] * len(texts)
                found = [classes.of(tokens(t), y) for t, y in zip(texts, known, strict=True)]
                p = marginals(model, found)
                features = np.array([document_features(x) for x in p])
                columns = {"doc_id": part.column("doc_id"), "f0": features[:, 0], "f1": features[:, 1], "f2": features[:, 2], "score": score_of(model, features)}
                if keep:
                    columns[keep] = part.column(keep)
                if spans:
                    columns["spans"] = pa.array([_offending(t, x, least) for t, x in zip(texts, p, strict=True)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))
                yield pa.RecordBatch.from_pydict(columns)

    kinds = dict(docs.dtypes)
    schema = f"doc_id {kinds['doc_id']}, f0 double, f1 double, f2 double, score double"
    schema += f", {keep} {kinds[keep]}" if keep else ""
    schema += ", spans array<struct<start: int, end: int, p: double>>" if spans else ""
    return docs.mapInArrow(run, schema)


def _offending(text: str, p: np.ndarray, least: float) -> list[dict]:
    """Runs of tokens with marginals of at least `least`: offsets in code points, highest marginal."""
    if not len(p) or p.max() < least:
        return []
    out: list[dict] = []
    last = -2
    # lower-casing may change lengths: offsets are of the text whose words the tokens are
    for i, m in enumerate(_word.finditer(text if len(text.lower()) == len(text) else text.lower())):
        if p[i] >= least:
            if last == i - 1:
                out[-1] |= {"end": m.end(), "p": max(out[-1]["p"], float(p[i]))}
            else:
                out.append({"start": m.start(), "end": m.end(), "p": float(p[i])})
            last = i
    return out


def score(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """Per document: doc_id, score and, if asked for, the offending spans."""
    found = _features(docs.select("doc_id", "text"), model, spans=spans)
    return found.select("doc_id", "score", *["spans"] * spans)


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(model)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                p = marginals(model, [classes.of(tokens(x.as_py() or "")) for x in part.column("text")])
                yield part.filter(pa.array(score_of(model, np.array([document_features(x) for x in p])) < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(column: str = "doc_id", parts: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts == 0, F.lit(False))
