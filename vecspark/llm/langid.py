"""Language identification by nearest centroids of TF-IDF character n-grams.

Texts become vectors of hashed letter trigrams (1 + log of the count, times the inverse document frequency, at unit
length). Each language's sample is clustered by spherical k-means into several centroids; a text takes the language of
the centroid at the highest cosine and is rejected where even that one is farther than the language's own texts lie.
Cosines rise with the length of a text, so this is calibrated by length, on the sample's texts and their beginnings.

The fit reads at most SAMPLE rows of a language, drawn by a hash of the id, fewer where there are many languages, but at least
LEAST of every one; no language is left out. Executors turn the texts drawn into counts, of at most DIMENSIONS slots
whatever a text's length, and the fit runs on the driver in numpy. Prediction is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a language, and of all languages together, that the fit reads at most; but for LEAST of each.
SAMPLE, SAMPLE_ALL, LEAST = 400, 8000, 20
DIMENSIONS = 4096
CENTROIDS = 4
#: A text is rejected below REJECT_SHARE of this quantile of the cosines of the language's sample at like lengths.
REJECT_QUANTILE, REJECT_SHARE = 0.005, 0.9
#: Lengths are told apart by the power of two of the number of trigrams, up to this power.
LENGTHS = 12
UNKNOWN = "und"

_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """A number for the lower case of each letter's code point, 0 for what is no letter."""
    if not _TABLE:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low[0]) + 1
        _TABLE.append(table)
    return _TABLE[0]


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts of the letter trigrams of a text, word edges included; nothing without letters."""
    none = np.empty(0, np.int64), np.empty(0, np.float32)
    if not text:
        return none
    c = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not c.any():
        return none
    c = np.concatenate(([0], c, [0])).astype(np.uint64)
    middle = c[1:-1] > 0
    with np.errstate(over="ignore"):
        h = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
        h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 12)
    n = np.bincount(h[middle].astype(np.int64), minlength=DIMENSIONS)
    at = np.flatnonzero(n)
    return at, n[at].astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # unit rows
    owner: np.ndarray  # language of each centroid
    least: np.ndarray  # by language and length, cosine below which a text is rejected

    def vectors(self, counted) -> tuple[np.ndarray, np.ndarray]:
        """Unit rows of texts given by counts(), and the power of two of each text's number of trigrams."""
        x, size = np.zeros((len(counted), DIMENSIONS), np.float32), np.ones(len(counted))
        for i, (at, n) in enumerate(counted):
            x[i, at] = (1 + np.log(n)) * self.idf[at]
            size[i] = max(1, n.sum())
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, norm, out=x, where=norm > 0), np.minimum(np.log2(size).astype(int), LENGTHS - 1)

    def calibrate(self, language: int, texts: list[list], centroids: np.ndarray) -> None:
        """Sets the language's row of least by its texts, each given as counts of the whole and of its beginnings."""
        found = [[] for _ in range(LENGTHS)]
        for cut in range(LENGTHS):
            some = [t[cut] for t in texts if len(t) > cut]
            if some:
                x, length = self.vectors(some)
                best = (x @ centroids.T).max(1)
                for k in range(LENGTHS):
                    found[k].append(best[(length == k) & x.any(1)])
        low = 0.0
        for k, cosines in enumerate(map(np.concatenate, found)):
            if len(cosines):
                low = REJECT_SHARE * np.quantile(cosines, REJECT_QUANTILE)
            self.least[language, k] = low

    def predict(self, texts) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, cosines in 0..1 and rejections."""
        if not len(texts):
            return [], np.empty(0), np.empty(0, bool)
        x, length = self.vectors([counts(t) for t in texts])
        some = x.any(1)
        if not len(self.centroids):
            return [UNKNOWN] * len(x), np.zeros(len(x)), np.ones(len(x), bool)
        cos = x @ self.centroids.T
        best = cos.argmax(1)
        score = np.clip(cos[np.arange(len(x)), best], 0, 1).astype(float)
        language = self.owner[best]
        said = [self.languages[k] if s else UNKNOWN for k, s in zip(language, some)]
        return said, np.where(some, score, 0.0), ~some | (score < self.least[language, length])


def _clusters(x: np.ndarray, k: int, seed: int = 5, rounds: int = 12) -> np.ndarray:
    """Unit centroids of spherical k-means, seeded by farthest rows."""
    centres = [x.mean(0)]
    while len(centres) < min(k, len(x)):
        centres.append(x[np.max(x @ np.stack(centres).T, axis=1).argmin()])
    c = np.stack(centres)
    for _ in range(rounds):
        c = c / np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
        near = (x @ c.T).argmax(1)
        c = np.stack([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of whole texts and of their beginnings, and a digest to order them by."""
    for b in batches:
        cuts = [[t, *(t[: 3 << k] for k in range(LENGTHS - 1) if len(t) > 3 << k)] for t in b.text]
        counted = [[counts(t) for t in parts] for parts in cuts]
        whole = [hashlib.md5(t.encode("utf-8", "replace")).hexdigest() for t in b.text]
        yield pd.DataFrame({"lang": b.lang, "whole": whole, "slots": [[a.astype(np.int64).tobytes() for a, _ in c] for c in counted], "counts": [[n.astype(np.float32).tobytes() for _, n in c] for c in counted]})


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """Rows whose CRC-32 of the id as text is divisible by `parts` are not learned from; nor are rows without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(False))


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from rows with a text, a language and an id that are not held out. Without any, a model that rejects all."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a language
    most = max(LEAST, min(SAMPLE, SAMPLE_ALL // max(1, len(sizes))))
    if not sizes:
        return Model([], np.zeros(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros((0, LENGTHS)))
    # a language's share that gives fewer than `most` rows in expectation, then the bound itself
    rate = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 0.8 * most / r["n"]) if r["n"] > most else 1.0)])
    drawn = rows.where(draw < F.try_element_at(rate, F.col("lang")) * (1 << 30)).select("lang", "doc_id", "text")
    place = F.row_number().over(W.partitionBy("lang").orderBy("doc_id", "text"))  # of a few hundred rows a language
    drawn = drawn.withColumn("place", place).where(F.col("place") <= most).select("lang", "text").mapInPandas(_sampled, "lang string, whole string, slots array<binary>, counts array<binary>").toPandas()
    drawn = drawn.sort_values(["lang", "whole"])
    drawn["parts"] = [[(np.frombuffer(a, np.int64), np.frombuffer(b, np.float32)) for a, b in zip(s, n)] for s, n in zip(drawn.slots, drawn.counts)]
    languages = sorted(drawn.lang.unique())
    model = Model(languages, np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros((len(languages), LENGTHS)))
    seen = np.zeros(DIMENSIONS)
    for parts in drawn.parts:
        seen[parts[0][0]] += 1
    model.idf = (np.log((1 + len(drawn)) / (1 + seen)) + 1).astype(np.float32)
    found, owner = [], []
    for k, language in enumerate(languages):
        texts = drawn.parts[drawn.lang == language].tolist()
        x, _ = model.vectors([t[0] for t in texts])
        x = x[x.any(1)]
        if len(x):
            c = _clusters(x, CENTROIDS)
            found.append(c)
            owner += [k] * len(c)
            model.calibrate(k, texts, c)
    if found:
        model.centroids, model.owner = np.concatenate(found).astype(np.float32), np.array(owner)
    return model


def predictor(spark, model: Model):
    """A column function of the text: struct(lang_pred, score, rejected)."""
    shared = spark.sparkContext.broadcast(model)  # DIMENSIONS x CENTROIDS floats for each language

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [shared.value.predict(texts.iloc[i : i + 500].tolist()) for i in range(0, len(texts), 500)]
            yield pd.DataFrame({"lang_pred": [x for p in parts for x in p[0]], "score": np.concatenate([p[1] for p in parts] or [[]]), "rejected": np.concatenate([p[2] for p in parts] or [[]]).astype(bool)})

    return predict


def identify(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of documents: doc_id, held_out, lang_pred, score (cosine, 0 to 1) and rejected.

    A text that is null or has no letters is `und` with score 0 and rejected. Other texts always get a learned language
    (if any was learned); rejected says that it is too far from it. Of languages as near, the first by name is said. A null
    id is not held out and not learned from; rows that repeat an id are judged each. Texts are read whole, however long.
    """
    predict = predictor(documents.sparkSession, fit(documents, id_col, text_col, lang_col))
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    done = docs.withColumn("p", predict("text"))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score", "p.rejected")
