"""Toxicity by cumulative-link ordinal regression (proportional odds).

Severity grades 0..K-1 follow P(grade <= k) = sigmoid(theta_k - w.x): one weight vector shared by ordered thresholds.
x holds hashed word features (is the word in the text, punctuation around it aside, A-Z lower-cased), so that a long
text is no more toxic for being long; only features that the labelled sample, or its texts of one language, ties to
the grade (frequency and z-score) get a weight. The expected severity is the sum over k of P(grade > k).

The model is fitted on at most `max_labelled` labelled rows, the first by a hash of the id among those whose document is
there; everything else reads all rows. Labels that only say toxic or not are graded first: a toxic text is severe (2) if the
number of different words that the sample finds telling reaches the median of toxic texts, else mild (1).

Null and empty texts have no features and get the model's base rate; they are never called toxic. Long texts are read
whole. Rows without a usable label are not learned from; of several labels of an id the greatest counts; without any two
grades in the sample every text scores 0. Ids may be of any type that labels and documents share; rows equal in the id's hash are taken in the order of their
features' hash. Repeated rows are scored alike, and learned from each. Extra columns stay as they are, whatever their names
(`scored` replaces columns of its results' names). An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propval.llm.text import own_columns, unused_prefix

MAX_LABELLED, BUCKETS = 12_000, 1 << 20
MIN_TEXTS, MIN_Z, L2, THRESHOLD = 8, 5.0, 0.1, 0.5
#: Within a language a feature needs this share of its toxic texts, at least LEAST_TEXTS and at most MIN_TEXTS texts.
LANG_SHARE, LEAST_TEXTS = 0.1, 4
UPPER = bytes(range(65, 91))
FOLD = bytes.maketrans(UPPER + b"\t\n\x0b\x0c\r", UPPER.lower() + b"     ")
EDGES = b".,;:!?\"'()[]{}*#$%&|<>-_~`"


def buckets_of(text: str | None) -> set[int]:
    """Hash buckets of the distinct words of a text."""
    seen = set((text or "").encode("utf-8", "replace").translate(FOLD).split(b" "))
    return {zlib.crc32(w) % BUCKETS for w in {x.strip(EDGES) for x in seen} if w}


@dataclass
class Model:
    """features: buckets in order; weights: one for each; thetas: ordered thresholds (empty: nothing was learned)."""

    features: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thetas: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thetas[None, :] - score[:, None], -500, 500)))


def telling(rows: list[np.ndarray], toxic: np.ndarray, min_texts: int = MIN_TEXTS, min_z: float = MIN_Z) -> tuple[np.ndarray, np.ndarray]:
    """Features in at least min_texts texts whose frequency in toxic and other texts differs by min_z standard errors; their z."""
    n1, n0 = float(toxic.sum()), float((~toxic).sum())
    if not len(rows) or not n1 or not n0:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    where = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    f, inverse = np.unique(np.concatenate(rows), return_inverse=True)
    c1 = np.bincount(inverse, weights=toxic[where].astype(float), minlength=len(f))
    c = np.bincount(inverse, minlength=len(f)).astype(float)
    c0, share = c - c1, c / (n0 + n1)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    z = (c1 / n1 - c0 / n0) / error
    good = (c >= min_texts) & (np.abs(z) >= min_z)
    return f[good], z[good]


def telling_by(rows: list[np.ndarray], toxic: np.ndarray, langs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features telling over all texts or among the texts of one language; of several z the one furthest from 0."""
    found = [telling(rows, toxic)]
    for lang in np.unique(langs) if langs is not None else ():
        mine = np.flatnonzero(langs == lang)
        floor = min(MIN_TEXTS, max(LEAST_TEXTS, int(np.ceil(LANG_SHARE * toxic[mine].sum()))))
        found.append(telling([rows[i] for i in mine], toxic[mine], floor))
    f, z = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((-np.abs(z), f))
    f, first = np.unique(f[order], return_index=True)
    return f, z[order][first]


def fit(rows: list[np.ndarray], grades: np.ndarray, l2: float = L2, rounds: int = 1500, langs: np.ndarray | None = None) -> Model:
    """Proportional odds by full-batch gradient steps (Adam) on the regularised likelihood; deterministic."""
    kinds = np.unique(grades)
    if len(kinds) < 2:
        return Model()
    y = np.searchsorted(kinds, grades)
    features, _ = telling_by(rows, y > 0, langs)
    if not len(features):
        return Model()
    place = {int(b): j for j, b in enumerate(features)}
    at = [(i, place[int(b)]) for i, r in enumerate(rows) for b in r if int(b) in place]
    row, col = (np.array(x, dtype=np.int64) for x in zip(*at, strict=True)) if at else (np.zeros(0, dtype=np.int64),) * 2
    k = len(kinds) - 1
    base = np.array([np.mean(y <= j) for j in range(k)]).clip(1e-3, 1 - 1e-3)
    start = np.log(base / (1 - base))
    # thetas stay in order: the first, then logarithms of the steps
    params = np.concatenate([np.zeros(len(features)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    n = len(y)
    for t in range(1, rounds + 1):
        w, steps = params[: len(features)], np.exp(params[len(features) + 1 :])
        theta = params[len(features)] + np.concatenate([[0.0], np.cumsum(steps)])
        score = np.bincount(row, weights=w[col], minlength=n)
        hi = np.where(y < k, sig(theta[np.minimum(y, k - 1)] - score), 1.0)
        lo = np.where(y > 0, sig(theta[np.maximum(y - 1, 0)] - score), 0.0)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_score = d_hi - d_lo  # of the negative log-likelihood, by score
        g_w = np.bincount(col, weights=g_score[row], minlength=len(features)) / n + l2 * w / n
        g_theta = (np.bincount(np.maximum(y - 1, 0), weights=np.where(y > 0, d_lo, 0), minlength=k) - np.bincount(np.minimum(y, k - 1), weights=np.where(y < k, d_hi, 0), minlength=k)) / n
        g = np.concatenate([g_w, [g_theta.sum()], np.cumsum(g_theta[::-1])[::-1][1:] * steps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    steps = np.exp(params[len(features) + 1 :])
    return Model(features, params[: len(features)], params[len(features)] + np.concatenate([[0.0], np.cumsum(steps)]))


def graded(rows: list[np.ndarray], toxic: np.ndarray, langs: np.ndarray | None = None) -> np.ndarray:
    """Grades of texts labelled toxic or not."""
    features, z = telling_by(rows, toxic, langs)
    found = np.array([np.isin(r, features[z > 0]).sum() for r in rows])
    cut = max(1.0, np.median(found[toxic])) if toxic.any() else 1.0
    return np.where(toxic, np.where(found >= cut, 2, 1), 0)


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = MAX_LABELLED) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Features, labels and languages ("" where docs has none) of at most max_labelled labelled rows, in a fixed order."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    read = docs.where(F.col("text").isNotNull())
    first = known.join(read.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"h": b["h"], "y": b["y"], "lang": b["lang"], "x": [np.array(sorted(buckets_of(t)), dtype=np.int32) for t in b["text"]]})

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    held = read.select("doc_id", "text", lang.alias("lang")).join(F.broadcast(first), "doc_id")  # at most max_labelled rows
    held = held.select(F.xxhash64("doc_id").alias("h"), "y", "lang", "text").mapInPandas(features, "h long, y int, lang string, x array<int>")
    got = held.orderBy("h", F.xxhash64("x")).limit(max_labelled).toArrow()
    flat = [np.asarray(x.values, dtype=np.int64) for x in got["x"]]
    return flat, np.asarray(got["y"], dtype=np.int64), np.asarray(got["lang"].to_pylist(), dtype=str)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    rows, y, langs = sample(docs, labels, label, max_labelled)
    if len(y) and set(np.unique(y)) <= {0, 1}:
        y = graded(rows, y > 0, langs)
    return fit(rows, y, langs=langs)


def scored(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD, prefix: str = "") -> DataFrame:
    """docs with severity (expected grade), p_toxic (P(grade > 0)) and toxic, under `prefix` + name."""
    place = {int(b): float(w) for b, w in zip(model.features, model.weights, strict=True)}

    @F.pandas_udf("severity double, p_toxic double")
    def score(texts: pd.Series) -> pd.DataFrame:
        known = set(place)
        s = np.array([sum(place[b] for b in sorted(buckets_of(t) & known)) for t in texts], dtype=float)
        if not len(model.thetas):
            return pd.DataFrame({"severity": np.zeros(len(s)), "p_toxic": np.zeros(len(s))})
        above = model.above(s)
        return pd.DataFrame({"severity": above.sum(axis=1), "p_toxic": above[:, 0]})

    text = F.col(f"`{text_col}`")
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rated = docs.withColumn(f"{prefix}__score", score(text))
    return rated.withColumns(
        {
            f"{prefix}severity": F.col(f"{prefix}__score.severity"),
            f"{prefix}p_toxic": F.col(f"{prefix}__score.p_toxic"),
            f"{prefix}toxic": (F.col(f"{prefix}__score.p_toxic") >= threshold) & worded,
        }
    ).drop(f"{prefix}__score")


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the toxic ones."""
    p = unused_prefix(docs, "t")
    return scored(docs, learn(docs, labels), prefix=p).where(~F.col(f"{p}toxic")).select(*own_columns(docs))
