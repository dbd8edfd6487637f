"""Language ID by hierarchical discrimination: the language family first, then linear support vector machines, one
for each pair of languages of the family.

A text's features are its byte trigrams, hashed to DIMENSION bins (letters case-folded in ASCII, other ASCII as one
space), square-rooted and scaled to length one; whole texts count. The machines (squared hinge, L2) are fitted on the
driver on a bounded sample: at most SAMPLE different texts a language, those with the smallest hash of id and text. The model is
DIMENSION weights for each family and pair of languages.

The score is the softmax of the family margins times the mean logistic of the winning language's margins.

Defined results: null, empty and letterless texts are `und` with score 0; so is all, if nothing is labelled. One
learned language: that one. Repeated rows: a row each; null doc_ids aren't held out nor learned from. Extra columns
are ignored by `predict`; `accept` keeps all columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import chunks, small_batches, take, utf8

DIMENSION = 2048
#: Labelled texts learned from, for each language.
SAMPLE = 500
UNKNOWN = "und"
#: Language families by ISO 639-1 code (fixed values); other codes are a family of their own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fo fy lb",
    "romance": "fr es pt it ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "finnic": "fi et",
    "indo-aryan": "hi ur bn mr ne gu pa",
    "turkic": "tr az kk uz ky tk",
    "sinitic": "zh yue",
    "semitic": "ar he am mt",
}
_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[0x61:0x7B] = _FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


def family(code: str) -> str:
    return _OF.get(code.split("-")[0].lower(), code)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of unit length for each text; zeros where a text has under three bytes."""
    n = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((n, DIMENSION), np.float32)
    b = _FOLD[data]
    h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)[: len(h)]
    for back in (1, 2):  # no trigram runs into the next text
        doc[np.maximum(offsets[1:][(size >= back) & (offsets[1:] - back < len(h))] - back, 0)] = n
    counts = np.bincount(doc * DIMENSION + (h >> np.uint32(21)), minlength=(n + 1) * DIMENSION)[: n * DIMENSION]
    out = np.sqrt(counts.reshape(n, DIMENSION).astype(np.float32))
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(_LETTER[data])])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for k in np.flatnonzero(~out):
        out[k] = any(map(str.isalpha, data[offsets[k] : offsets[k + 1]].tobytes().decode()))
    return out


def fit_machine(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 300) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by accelerated gradient steps; y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c * 10
    step = 1 / (1 + 2 * 2 * weight.sum())
    w = z = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z))
        new = z - step * (z - 2 * x.T @ (weight * slack * y))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w


@dataclass
class Model:
    families: list[str]
    members: list[list[str]]
    family_weights: np.ndarray
    pairs: list[dict[tuple[int, int], np.ndarray]]

    @classmethod
    def fit(cls, x: np.ndarray, lang: np.ndarray) -> Model:
        kinds = np.array([family(v) for v in lang])
        families = sorted(set(kinds.tolist()))
        members = [sorted(set(lang[kinds == f].tolist())) for f in families]
        top = np.stack([fit_machine(x, np.where(kinds == f, 1.0, -1.0)) if len(families) > 1 else np.zeros(x.shape[1] + 1) for f in families])
        pairs = []
        for own in members:
            pairs.append({})
            for i in range(len(own)):
                for j in range(i + 1, len(own)):
                    use = (lang == own[i]) | (lang == own[j])
                    pairs[-1][i, j] = fit_machine(x[use], np.where(lang[use] == own[i], 1.0, -1.0))
        return cls(families, members, top, pairs)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not len(x):
            return [], np.zeros(0)
        margin = 3 * (x @ self.family_weights[:, :-1].T + self.family_weights[:, -1])
        chance = np.exp(margin - margin.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        top = chance.argmax(1)
        out, score = np.empty(len(x), object), chance[np.arange(len(x)), top]
        for f, own in enumerate(self.members):
            rows = np.flatnonzero(top == f)
            votes, trust = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
            for (i, j), w in self.pairs[f].items():
                p = 1 / (1 + np.exp(-3 * (x[rows] @ w[:-1] + w[-1])))
                votes[:, i] += p >= 0.5
                votes[:, j] += p < 0.5
                trust[:, i] += p
                trust[:, j] += 1 - p
            best = (votes + trust / (2 * len(own))).argmax(1)
            out[rows] = np.array(own, object)[best]
            if len(own) > 1:
                score[rows] *= trust[np.arange(len(rows)), best] / (len(own) - 1)
        return out.tolist(), np.clip(score, 0, 1)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id's text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _features(batches):
    for batch, data, offsets in chunks(batches):
        x, ok = features(data, offsets), has_letter(data, offsets)
        yield pa.RecordBatch.from_arrays([take(batch, "lang"), pa.array([r.tobytes() if k else None for r, k in zip(x, ok)], pa.binary())], ["lang", "x"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of docs (doc_id, text, lang); None where nothing is labelled."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # rows under a share of the hash range that leaves half as many again as are wanted, so few meet to be ranked
    key = F.xxhash64("doc_id", "text")
    share = F.least(F.lit(1.0), (1.5 * sample + 100) / F.col("n"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))  # a row a language, of which the model has a machine a pair
    some = rows.withColumn("key", key).join(F.broadcast(counts), "lang").filter(F.abs(F.col("key") / 2.0**63) <= share)
    once = some.dropDuplicates(["lang", "key"])  # a row that repeats counts once
    ranked = once.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("key"))).filter(F.col("k") <= sample)
    found = ranked.select("lang", "text").mapInArrow(_features, "lang string, x binary").filter("x is not null").toArrow()
    if not found.num_rows:
        return None
    lang = np.array(found["lang"].to_pylist(), object)
    x = np.stack([np.frombuffer(v, np.float32) for v in found["x"].to_pylist()])
    order = sorted(range(len(lang)), key=lambda k: (lang[k], x[k].tobytes()))  # rows come in any order
    return Model.fit(x[order], lang[order])


def _predict(shared):
    def run(batches):
        model = shared.value
        for batch, data, offsets in chunks(batches):
            n = len(offsets) - 1
            lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
            rows = np.flatnonzero(has_letter(data, offsets))
            if model and len(rows):
                found, trust = model.predict(features(data, offsets)[rows])
                lang[rows], score[rows] = found, trust
            yield pa.RecordBatch.from_arrays([take(batch, "doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_predict(spark.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, model: Model | None, least: float = 0.0) -> DataFrame:
    """The rows of docs whose text has a language, predicted with a score of at least `least`; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def kept(s):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for at in range(0, len(s), 200):
            data, offsets = utf8(pa.array(s.iloc[at : at + 200], pa.large_string(), from_pandas=True))
            ok = has_letter(data, offsets)
            if shared.value and ok.any():
                _, trust = shared.value.predict(features(data, offsets)[ok])
                ok[ok] = trust >= least
            out.append(ok)
        return pd.Series(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.filter(kept(F.col("text").cast("string")))
