"""Quality classifier by co-training two views.

One view is the text's content: shares of letter kinds, signs and lines, and word measures. The other is the page's
metadata: source, language and length. Each view has its own logistic classifier. Round by round each gives the other the
unlabelled documents that it is surest of, with its label. Both views are then calibrated on labelled documents that neither
has seen, and the calibrated log odds add up, less the prior counted twice, to the score of every document.

Texts are read once, into a table of features. All unlabelled documents take part: tasks count how sure a view is of them,
which gives the threshold of a round for any number of documents, and add up gradients and curvatures of those beyond it;
these sums, whose size is that of the model, are what the driver gets. Only the labelled rows that it fits on are bounded:
the ``fit_docs`` with the smallest hashes of their ids. A null text has no words; null metadata is a value of its own. With
no labelled documents, or labels of one kind only, the score is the share of good labels (0.5 without any). Labels that
are null or repeat: the smallest counts. Rows that repeat come out repeated; rows without a doc_id are scored, but teach
nothing. Other columns are not read, and the label table's own other columns neither. An empty table gives an empty result.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewright.llm.wordhash import blocks
from routewright.session import cut_lineage

#: Fixed value: signs that junk is full of.
SIGNS = b"#*$%&|<>"
SOURCE_SLOTS, LANG_SLOTS = 64, 16
#: Steps between 0 and the largest log odds by which sureness is counted, and Newton steps of a round at most.
_ODDS_MOST, _ODDS_STEPS, _NEWTON_STEPS = 20.0, 4000, 8


@dataclass(frozen=True)
class CoTraining:
    fit_docs: int = 12_000
    rounds: int = 4
    #: Share of the unlabelled documents that a view may hand over in a round, and how sure it must be.
    share: float = 0.05
    sure: float = 0.95
    ridge: float = 1.0
    keep_from: float = 0.5


def _classes() -> np.ndarray:
    """Class of each byte: upper, lower, digit, space, line end, sign, exclamation, full stop or comma, other ASCII, beyond ASCII."""
    out = np.full(256, 8)
    out[128:] = 9
    for n, group in enumerate((range(65, 91), range(97, 123), range(48, 58), (9, 11, 12, 13, 32), (10,), SIGNS, b"!", b".,")):
        out[list(group)] = n
    return out


_CLASS = _classes()
TEXT_FEATURES = 10 + 5


def _word_features(block) -> np.ndarray:
    """Measures of words that do not depend on case: count, mean length, share of long ones, share of different ones, words by line."""
    rows, row = len(block.rows), block.row_of_word()
    counts = np.maximum(np.diff(block.first), 1)
    length = block.ends - block.starts
    order = np.lexsort((block.hashes, row))
    again = (row[order][1:] == row[order][:-1]) & (block.hashes[order][1:] == block.hashes[order][:-1])
    repeats = np.bincount(row[order][1:][again], minlength=rows)
    mean = np.bincount(row, length, rows) / counts
    return np.stack([np.log1p(np.diff(block.first)), mean, np.bincount(row[length > 20], minlength=rows) / counts, 1 - repeats / counts], 1)


def text_features(column: pa.Array) -> np.ndarray:
    """Rows x TEXT_FEATURES of a non-null string column."""
    out, offsets = [], np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    everything = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    for block in blocks(column):
        begin, stop = block.rows.start, block.rows.stop
        sizes = np.diff(offsets[begin:stop + 1])
        kind = _CLASS[everything[offsets[begin]:offsets[stop]]]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        counts = np.bincount(owner * 10 + kind, minlength=10 * len(sizes)).reshape(-1, 10)
        shares = np.sqrt(counts / np.maximum(sizes, 1)[:, None])
        words = _word_features(block)
        lines = np.log1p(np.diff(block.first) / (counts[:, 4] + 1))
        out.append(np.column_stack([shares, words, lines]))
    return np.concatenate(out) if out else np.zeros((0, TEXT_FEATURES))


def metadata_features(source: np.ndarray, lang: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    """Slots of hashed source and language, and length."""
    rows = np.arange(len(source))
    out = np.zeros((len(source), SOURCE_SLOTS + LANG_SLOTS + 2))
    out[rows, source] = 1
    out[rows, SOURCE_SLOTS + lang] = 1
    length = np.log1p(np.maximum(n_chars, 0))
    out[:, -2], out[:, -1] = length, length * length / 10
    return out


class Logistic:
    """Ridge logistic regression on standardised features, with calibration of its log odds."""

    def __init__(self, x: np.ndarray, ridge: float):
        self.mean, self.spread = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
        self.ridge = np.full(x.shape[1] + 1, ridge)
        self.ridge[-1] = 1e-6
        self.weights = np.zeros(x.shape[1] + 1)
        self.scale, self.shift = 1.0, 0.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.spread, -8, 8), np.ones(len(x))])

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the log likelihood of some rows; those of several parts add up."""
        return _sums(self.scaled(x), y, self.weights)

    def move(self, gradient: np.ndarray, curvature: np.ndarray) -> float:
        """One Newton step; returns its length."""
        step = np.linalg.solve(curvature + np.diag(self.ridge), gradient - self.ridge * self.weights)
        self.weights = self.weights + step
        return float(np.abs(step).max())

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Scale and shift of the log odds by regression on held-out labels; targets a little inside 0 and 1."""
        self.scale, self.shift = 1.0, 0.0
        good, bad = y.sum(), len(y) - y.sum()
        if good and bad:
            target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
            odds = self.odds(x)
            rows, w, ridge = np.column_stack([odds, np.ones(len(odds))]), np.zeros(2), np.array([1e-3, 1e-3])
            for _ in range(25):
                gradient, curvature = _sums(rows, target, w)
                w = w + np.linalg.solve(curvature + np.diag(ridge), gradient - ridge * w)
            self.scale, self.shift = w

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.scale * (self.scaled(x) @ self.weights) + self.shift, -_ODDS_MOST, _ODDS_MOST)


def _sums(rows: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
    return rows.T @ (y - p), (rows * (p * (1 - p))[:, None]).T @ rows


def _prepared(docs: DataFrame) -> DataFrame:
    slot = lambda c, n: F.when(F.col(c).isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(n - 1))).cast("int")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), slot("source", SOURCE_SLOTS).alias("source_slot"),
                       slot("lang", LANG_SLOTS).alias("lang_slot"), F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)).alias("length"))


_FEATURES = "doc_id long, text_view array<double>, source_slot int, lang_slot int, length double"


def feature_table(docs: DataFrame) -> DataFrame:
    """``doc_id, text_view, source_slot, lang_slot, length`` of every row; the texts are not read again."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                view = text_features(batch.column("text"))
                bounds = pa.array(np.arange(0, view.size + 1, TEXT_FEATURES), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.ListArray.from_arrays(bounds, pa.array(view.ravel())), *batch.columns[2:]],
                    ["doc_id", "text_view", "source_slot", "lang_slot", "length"])

    return _prepared(docs).mapInArrow(run, _FEATURES)


def _views(batch) -> tuple[np.ndarray, np.ndarray]:
    column = lambda c: batch.column(c).combine_chunks() if isinstance(batch.column(c), pa.ChunkedArray) else batch.column(c)
    text = column("text_view").flatten().to_numpy().reshape(-1, TEXT_FEATURES)
    return text, metadata_features(*(batch.column(c).to_numpy() for c in ("source_slot", "lang_slot", "length")))


@dataclass
class TwoViews:
    text: Logistic | None
    page: Logistic | None
    prior: float

    def scores(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, text view, page view), each a probability."""
        if self.text is None or self.page is None:
            same = np.full(len(text), self.prior)
            return same, same, same
        one, two, prior = self.text.odds(text), self.page.odds(page), np.log(self.prior / (1 - self.prior))
        return tuple(1 / (1 + np.exp(-x)) for x in (one + two - prior, one, two))


@dataclass
class Handover:
    """What a round hands over: the models as they were, and for (view, label) the log odds from which a document counts as sure."""

    models: tuple[Logistic, Logistic]
    thresholds: dict[tuple[int, int], float]


def given_labels(views: tuple[np.ndarray, np.ndarray], rounds: list[Handover]) -> list[np.ndarray]:
    """For each view the labels that the other one gave to these rows; -1 for none. The first one given stands."""
    labels = [np.full(len(views[0]), -1), np.full(len(views[0]), -1)]
    for hand in rounds:
        for view in (0, 1):
            odds, other = hand.models[view].odds(views[view]), labels[1 - view]
            for label, sure in ((1, odds), (0, -odds)):
                other[(other < 0) & (sure >= hand.thresholds[view, label])] = label
    return labels


def _thresholds(pool: DataFrame, models: tuple[Logistic, Logistic], rounds: list[Handover], good: float, params: CoTraining) -> dict:
    """From what log odds on a view's documents are handed over, by counts over all of them."""
    shared = pool.sparkSession.sparkContext.broadcast((models, rounds))

    def count(batches):
        models, rounds = shared.value
        sums = np.zeros((2, 2, _ODDS_STEPS + 1), np.int64)
        rows = 0
        for batch in batches:
            if batch.num_rows:
                views = _views(batch)
                labels, rows = given_labels(views, rounds), rows + batch.num_rows
                for view in (0, 1):
                    odds = models[view].odds(views[view])[labels[1 - view] < 0]
                    for label, sure in ((1, odds), (0, -odds)):
                        at = np.floor(sure[sure >= 0] / _ODDS_MOST * _ODDS_STEPS).astype(np.int64)
                        sums[view, label] += np.bincount(at, minlength=_ODDS_STEPS + 1)
        view, label, step = np.nonzero(sums)
        columns = [np.append(view, -1), np.append(label, -1), np.append(step, -1), np.append(sums[view, label, step], rows)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["view", "label", "step", "n"])

    found = pool.mapInArrow(count, "view long, label long, step long, n long").groupBy("view", "label", "step").agg(F.sum("n").alias("n")).collect()
    shared.unpersist()
    total = sum(r["n"] for r in found if r["view"] < 0)
    least = np.log(params.sure / (1 - params.sure))
    out = {}
    for view in (0, 1):
        for label in (0, 1):
            wanted = max(1, int(params.share * total * (good if label else 1 - good)))
            threshold, held = np.inf, 0
            for step, n in sorted(((r["step"], r["n"]) for r in found if (r["view"], r["label"]) == (view, label)), reverse=True):
                odds = step / _ODDS_STEPS * _ODDS_MOST
                if odds < least or held >= wanted:
                    break
                threshold, held = odds, held + n
            out[view, label] = threshold
    return out


def _pool_sums(pool: DataFrame, models: tuple[Logistic, Logistic], rounds: list[Handover]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Gradient and curvature of each view over all documents that the other one labelled."""
    shared = pool.sparkSession.sparkContext.broadcast((models, rounds))

    def add(batches):
        models, rounds = shared.value
        sums = [[0, 0], [0, 0]]
        for batch in batches:
            if batch.num_rows:
                views = _views(batch)
                for view, labels in enumerate(given_labels(views, rounds)):
                    named = labels >= 0
                    for n, part in enumerate(models[view].sums(views[view][named], labels[named].astype(float))):
                        sums[view][n] = sums[view][n] + part
        flat = [np.concatenate([np.ravel(part) for part in pair]) if np.ndim(pair[0]) else None for pair in sums]
        rows = [(view, place, value) for view, values in enumerate(flat) if values is not None for place, value in enumerate(values.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate((pa.int64(), pa.int64(), pa.float64()))],
                                         ["view", "place", "value"])

    found = pool.mapInArrow(add, "view long, place long, value double").groupBy("view", "place").agg(F.sum("value").alias("value")).toArrow()
    shared.unpersist()
    out = []
    for view in (0, 1):
        width = len(models[view].weights)
        values = np.zeros(width + width * width)
        mine = found.column("view").to_numpy() == view
        values[found.column("place").to_numpy()[mine]] = found.column("value").to_numpy()[mine]
        out.append((values[:width], values[width:].reshape(width, width)))
    return out


def fit(features: DataFrame, labels: DataFrame, params: CoTraining = CoTraining()) -> TwoViews:
    """Both views' models from a written :func:`feature_table` and labels."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marks = cut_lineage(marks.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")))
    named = marks.withColumn("turn", F.xxhash64("doc_id", F.lit(10))).orderBy("turn", "doc_id").limit(params.fit_docs)
    # no more rows than fit_docs
    found = features.join(F.broadcast(named), "doc_id").dropDuplicates(["doc_id"]).toArrow().sort_by([("turn", "ascending"), ("doc_id", "ascending")])
    y = (found.column("quality").to_numpy() > 0).astype(float)
    held = np.arange(len(y)) % 5 == 0  # rows are in hash order
    good = float(y.mean()) if len(y) else 0.5
    if len(set(y[~held].tolist())) < 2:
        return TwoViews(None, None, good)
    views = _views(found)
    models = tuple(Logistic(v[~held], params.ridge) for v in views)
    pool = cut_lineage(features.where("doc_id is not null").join(marks.select("doc_id"), "doc_id", "left_anti"))
    rounds: list[Handover] = []
    for turn in range(params.rounds + 1):
        for _ in range(_NEWTON_STEPS if rounds else 25):
            shares = _pool_sums(pool, models, rounds) if rounds else [(0, 0), (0, 0)]
            moved = []
            for view, (gradient, curvature) in enumerate(shares):
                own = models[view].sums(views[view][~held], y[~held])
                moved.append(models[view].move(own[0] + gradient, own[1] + curvature))
            if max(moved) < 1e-3:
                break
        for view in (0, 1):
            models[view].calibrate(views[view][held], y[held])
        if turn < params.rounds:
            rounds.append(Handover(copy.deepcopy(models), _thresholds(pool, models, rounds, good, params)))
            if all(np.isinf(t) for t in rounds[-1].thresholds.values()):
                break
    return TwoViews(*models, min(max(good, 1e-3), 1 - 1e-3))


def score(features: DataFrame, model: TwoViews, params: CoTraining = CoTraining()) -> DataFrame:
    """``doc_id, score, text_score, page_score, kept`` of every row of a :func:`feature_table`."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                together, text, page = shared.value.scores(*_views(batch))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(together), pa.array(text), pa.array(page), pa.array(together >= params.keep_from)],
                    ["doc_id", "score", "text_score", "page_score", "kept"])

    return features.mapInArrow(run, "doc_id long, score double, text_score double, page_score double, kept boolean")


def classify(docs: DataFrame, labels: DataFrame, params: CoTraining = CoTraining()) -> DataFrame:
    features = cut_lineage(feature_table(docs))
    return score(features, fit(features, labels, params), params)
