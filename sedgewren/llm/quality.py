"""Quality scores by co-training two views of a document.

The content view sees the text alone (shares of letters, capitals, digits, signs and bars, word and line lengths, repeated
words and lines); the page view sees the metadata alone (language, source, stated length).  Both start as logistic
models on the labelled rows.  In each of ``ROUNDS`` rounds either view labels the unlabelled rows that it is surest of, up
to ``GIVEN`` of each class and only beyond ``SURE``, and hands them to the other view's training set.  All unlabelled rows are asked
in every round: their features, of equal ones once, are a staged table, and each task hands on no more than it may give.  Both views are then
calibrated on labelled rows that took no part in training, and a logistic model over the two calibrated views scores all
documents.

Fitting reads at most ``LABELLED`` labelled rows, chosen by a hash of their ids, one row for each id. Rows whose crc32
of the id mod 3 is 1 are held out.

Defined cases: null and empty texts have features of 0; null language, source and length are values of their own; repeated
rows get equal scores; without labels of both classes every score is 0.5; several labels of an id count as good if one is;
columns that have the names of the results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgewren.llm.common import PIECE, freed, in_small_batches, staged, with_columns
from sedgewren.llm.toxicity import fit_logistic, held_out

LABELLED = 6000
ROUNDS, GIVEN, SURE = 5, 300, 0.97
#: Slots that sources and languages are hashed to.
SLOTS = 32
_DROP_LOWER = bytes(range(97, 123))
_DROP_UPPER = bytes(range(65, 91))
_DROP_DIGIT = bytes(range(48, 58))
_DROP_SIGN = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'-")
_DROP_COMMON = b".,"
_DROP_HIGH = bytes(range(128, 256))
CONTENT = 17


def content_features(text: bytes | None) -> list[float]:
    """What the content view sees of a text."""
    text = text or b""
    words = text.split()
    n, m = len(text), len(words)
    if not m:
        return [0.0] * CONTENT
    share = lambda drop: (n - len(text.translate(None, drop))) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    closed = sum(x.rstrip().endswith((b".", b"!", b"?", b'"')) for x in lines)
    kinds = set(words)
    mean = n / m
    return [
        share(_DROP_LOWER), share(_DROP_UPPER), share(_DROP_DIGIT), share(_DROP_SIGN), share(_DROP_COMMON), share(_DROP_HIGH),
        math.sqrt(share(_DROP_SIGN)), math.sqrt(share(_DROP_UPPER)), len(kinds) / m, math.log1p(m) / 10, min(mean, 30) / 10, math.log1p(n / len(lines)) / 10,
        len(set(lines)) / len(lines), closed / len(lines), text.count(b"|") / m, min(1.0, len(max(words, key=len)) / 100), math.log1p(m / len(kinds)),
    ]


def slot(value: str | None) -> int:
    return zlib.crc32((value or "\0").encode()) % SLOTS


def page_features(lang: np.ndarray, source: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What the page view sees of documents' metadata: the slots of language and source, and the length (nan for none)."""
    out = np.zeros((len(lang), 2 * SLOTS + 4))
    at = np.arange(len(lang))
    out[at, lang] = 1.0
    out[at, SLOTS + source] = 1.0
    known = np.nan_to_num(length, nan=0.0)
    x = np.log1p(np.maximum(known, 0)) / 10
    out[:, -4:] = np.c_[x, x * x, known < 200, np.isnan(length)]
    return out


def _probability(x: np.ndarray, model: tuple) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ model[0] + model[1], -35, 35)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class CoTrained:
    """Two views, their calibrations, and the model that combines them."""

    def __init__(self, views: list[tuple], scales: list[tuple], both: tuple):
        self.views, self.scales, self.both = views, scales, both

    def scores(self, x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = [_probability(_logit(_probability(v, m))[:, None], s) for v, m, s in zip(x, self.views, self.scales)]
        return own[0], own[1], _probability(np.c_[_logit(own[0]), _logit(own[1])], self.both)


def cotrain(x: list[np.ndarray], y: np.ndarray, surest, seed: int = 5) -> CoTrained:
    """Fit on labelled features of both views (``x``, ``y``).

    ``surest(models)`` gives for each view the unlabelled rows that it is surest of, none of them twice: the other view's features
    and the labels.
    """
    aside = np.random.default_rng(seed).random(len(y)) < 0.3
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside = np.zeros(len(y), bool)
    train = [(x[v][~aside], y[~aside]) for v in (0, 1)]
    models = [fit_logistic(a, b) for a, b in train]
    for _ in range(ROUNDS):
        given = surest(models)
        if not sum(len(labels) for _, labels in given):
            break
        for v, (rows, labels) in enumerate(given):  # what view v is sure of goes to the other
            train[1 - v] = (np.r_[train[1 - v][0], rows], np.r_[train[1 - v][1], labels])
        models = [fit_logistic(a, b) for a, b in train]
    rows = aside if aside.any() else ~aside
    scales = [fit_logistic(_logit(_probability(x[v][rows], models[v]))[:, None], y[rows]) for v in (0, 1)]
    own = [_logit(_probability(_logit(_probability(x[v][rows], models[v]))[:, None], scales[v])) for v in (0, 1)]
    return CoTrained(models, scales, fit_logistic(np.c_[own[0], own[1]], y[rows]))


def extremes(p: np.ndarray, key: np.ndarray) -> list[tuple[int, int]]:
    """(side, place) of the rows of the largest and least chances beyond ``SURE``, ties to smaller keys."""
    good, bad = np.lexsort((key, -p))[:GIVEN], np.lexsort((key, p))[:GIVEN]
    return [(1, i) for i in good if p[i] >= SURE] + [(0, i) for i in bad if p[i] <= 1 - SURE]


def _featured(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            step = max(1, batch.num_rows * PIECE // max(1, batch.nbytes))
            for i in range(0, batch.num_rows, step):
                ids, text, lang, source, length = batch.slice(i, step).columns
                a = [content_features(t.as_py()) for t in text.cast(pa.binary())]
                slots = [pa.array([slot(x) for x in c.to_pylist()], pa.int32()) for c in (lang, source)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(a, pa.list_(pa.float64())), *slots, length], names=["doc_id", "a", "lang", "source", "length"])

    rows = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("double").alias("length"))
    return in_small_batches(rows).mapInArrow(run, f"doc_id {kind}, a array<double>, lang int, source int, length double")


def _views(rows: list) -> list[np.ndarray]:
    a = np.array([r["a"] for r in rows], float).reshape(len(rows), CONTENT)
    lengths = np.array([np.nan if r["length"] is None else r["length"] for r in rows], float)
    return [a, page_features(np.array([r["lang"] for r in rows], int), np.array([r["source"] for r in rows], int), lengths)]


def _arrays(columns: dict[str, pa.Array], at: np.ndarray) -> list[np.ndarray]:
    a = np.asarray(columns["a"].flatten()).reshape(-1, CONTENT)
    lang, source, length = (columns[c].to_numpy(zero_copy_only=False) for c in ("lang", "source", "length"))
    return [a[at], page_features(lang[at].astype(int), source[at].astype(int), length[at].astype(float))]


def _surest_of(pool: DataFrame):
    """surest() for cotrain() over a staged table of features."""
    given: set[int] = set()
    schema = "view int, side int, p double, key long, a array<double>, lang int, source int, length double"

    def surest(models):
        taken = np.array(sorted(given), np.int64)

        def run(batches):
            held: list[dict] = []
            for batch in batches:
                key = batch.column(0).to_numpy(zero_copy_only=False)
                left = np.flatnonzero(~np.isin(key, taken))
                if len(left):
                    columns = dict(zip(batch.schema.names, batch.columns))
                    own = batch.take(pa.array(sorted({left[i] for *_, i in marked(_arrays(columns, left), key[left])}), pa.int64()))
                    held += own.to_pylist()
                    keep = marked(_views(held), np.array([r["key"] for r in held]))
                    held = [held[i] for i in sorted({i for *_, i in keep})]
            found = marked(_views(held), np.array([r["key"] for r in held], np.int64)) if held else []
            yield pa.RecordBatch.from_pylist([{**held[i], "view": v, "side": side, "p": float(p)} for v, side, p, i in found], schema=out)

        def marked(x, key):
            chances = [_probability(x[v], models[v]) for v in (0, 1)]
            return [(v, side, chances[v][i], i) for v in (0, 1) for side, i in extremes(chances[v], key)]

        out = pa.schema([("view", pa.int32()), ("side", pa.int32()), ("p", pa.float64()), ("key", pa.int64()), ("a", pa.list_(pa.float64())), ("lang", pa.int32()), ("source", pa.int32()), ("length", pa.float64())])
        sure = F.when(F.col("side") == 1, -F.col("p")).otherwise(F.col("p"))
        first = F.row_number().over(Window.partitionBy("view", "side").orderBy(sure, "key"))
        rows = pool.mapInArrow(run, schema).withColumn("first", first).where(F.col("first") <= GIVEN).collect()
        rows = sorted(rows, key=lambda r: (r["view"], -r["side"], r["first"]))
        given.update(r["key"] for r in rows)
        own = [[r for r in rows if r["view"] == v] for v in (0, 1)]
        return [(_views(own[v])[1 - v], np.array([r["side"] for r in own[v]], float)) for v in (0, 1)]

    return surest


def fitted(docs: DataFrame, labels: DataFrame) -> CoTrained | None:
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).where(~held_out())
    some = staged(known.orderBy(F.xxhash64(F.lit(9), F.col("doc_id")), "doc_id").limit(LABELLED), "quality-labels")
    rows = staged(_featured(docs.where("doc_id is not null").where(~held_out())), "quality-features")
    labelled = rows.join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("a", "lang", "source", "length")).alias("x")).select("doc_id", "quality", "x.*").orderBy("doc_id").collect()
    y = np.array([r["quality"] for r in labelled], float)
    if not 0 < y.sum() < len(y):
        return None
    pool = rows.join(known.select("doc_id"), "doc_id", "left_anti").select(F.xxhash64("a", "lang", "source", "length").alias("key"), "a", "lang", "source", "length").dropDuplicates(["key"])
    pool = staged(pool, "quality-pool")
    model = cotrain(_views(labelled), y, _surest_of(pool))
    freed(rows, pool)
    return model


def score(docs: DataFrame, labels: DataFrame, new: tuple[str, str, str] = ("content_score", "page_score", "quality_score")) -> DataFrame:
    """Append the chances that the document is good, by the content view, the page view and both, under the given names."""
    model = fitted(docs, labels)
    kept = [c for c in docs.columns if c.lower() not in new]
    places = [kept.index(c) for c in ("text", "lang", "source", "n_chars")]

    def f(batch: pa.RecordBatch) -> list[pa.Array]:
        if model is None:
            return [pa.array([0.5] * batch.num_rows, pa.float64())] * 3
        text, lang, source, length = (batch.column(i) for i in places)
        a = np.array([content_features(t.as_py()) for t in text.cast(pa.binary())])
        b = page_features(*(np.array([slot(x) for x in c.to_pylist()], int) for c in (lang, source)), length.cast(pa.float64()).to_numpy(zero_copy_only=False))
        return [pa.array(s, pa.float64()) for s in model.scores([a, b])]

    return with_columns(docs, f, [T.StructField(c, T.DoubleType()) for c in new])
