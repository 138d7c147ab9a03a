"""Language ID: blended n-gram presence kernels, Nystroem landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Carried, broadcast_if_small

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageConfig:
    """max_sample_per_lang and max_sample bound the training sample: with many languages each gets its part of max_sample.
    landmarks is the size of the kernel expansion, unless languages are so many that landmarks_per_lang of each are more. The model
    grows with them (about 0.26 MB a language, sent to every executor), so more than max_languages are refused."""

    orders: tuple[int, ...] = (1, 2, 3, 4)
    buckets: int = 1 << 15
    max_sample_per_lang: int = 400
    max_sample: int = 40_000
    landmarks: int = 192
    landmarks_per_lang: int = 2
    max_languages: int = 1_000
    ridge: float = 1e-3
    softness: float = 8.0


def presence(text: str, config: LanguageConfig) -> np.ndarray:
    """The buckets of the n-grams of all orders that the lower-cased text has, each once, in order."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    seen = np.zeros(config.buckets, bool)
    for n in config.orders:
        if len(points) < n:
            break
        gram = np.full(len(points) - n + 1, n, np.uint64)
        for k in range(n):
            gram = (gram ^ points[k : len(points) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            gram ^= gram >> np.uint64(29)
        seen[(gram >> np.uint64(20)) % np.uint64(config.buckets)] = True
    return np.flatnonzero(seen)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def as_rows(sets: list[np.ndarray], config: LanguageConfig) -> np.ndarray:
    out = np.zeros((len(sets), config.buckets), np.float32)
    for i, s in enumerate(sets):
        out[i, s] = 1
    return out


@dataclass(frozen=True)
class LanguageModel:
    """What scoring needs: landmark rows, their sizes, and for each language the weights over landmark kernels."""

    config: LanguageConfig
    languages: list[str]
    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """Softened one-versus-rest outputs of texts given by their n-gram sets, by two matrix products a batch."""
        common = as_rows(sets, self.config) @ self.landmarks
        sizes = np.array([max(1, len(s)) for s in sets], np.float32)
        kernel = common / np.sqrt(sizes[:, None] * self.sizes[None, :])
        margin = self.config.softness * (kernel @ self.weights)
        e = np.exp(margin - margin.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def training_sample(docs: DataFrame, text: str, lang: str, key: str, config: LanguageConfig) -> DataFrame:
    """A bounded number of rows (lang, packed n-gram set) for each language, chosen by a hash of the key, then the n-gram set.

    A threshold on the hash first leaves about twice the bound of each language, so that the exact bound orders few rows even
    where one language has most of the table.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = rows.groupBy(F.col(lang).alias("_l")).agg(F.count("*").alias("_n"))
    n_langs = counts.count()
    if n_langs > config.max_languages:
        raise ValueError(f"{n_langs} languages are more than max_languages ({config.max_languages}) of the configuration")
    each = max(config.landmarks_per_lang, min(config.max_sample_per_lang, config.max_sample // max(1, n_langs)))
    counts = broadcast_if_small(counts, n_langs, 100_000)
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("language sample")), F.lit(1 << 30))
    few = rows.select(F.col(lang).alias("_l"), F.col(text).alias("_t"), draw.alias("_d")).join(counts, "_l").filter(F.col("_d") < F.lit(float(1 << 30)) * 2 * each / F.col("_n") + (1 << 10))

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            bits = np.zeros(config.buckets, bool)
            bits[presence(t, config)] = True
            out.append(np.packbits(bits).tobytes() if has_letter(t) else None)
        return pa.array(out, pa.binary())

    first = Window.partitionBy("_l").orderBy("_d", "_s")
    return few.select("_l", "_d", packed("_t").alias("_s")).filter("_s is not null").withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= each).select(F.col("_l").alias("lang"), F.col("_s").alias("grams"), F.col("_r").alias("nth"))


def fit_language(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", config: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """Fits on a sample bounded by config; landmarks are the first rows of each language's sample in turn.

    Rows with a null language or a text that is null or has no letter are not learnt from. No language at all gives a model
    that answers `und`; more than config.max_languages raise ValueError.
    """
    pdf = training_sample(docs, text, lang, key, config).toPandas().sort_values(["nth", "lang"], kind="stable")
    languages = sorted(pdf["lang"].unique().tolist())
    if not languages:
        return LanguageModel(config, [], np.zeros((config.buckets, 1), np.float32), np.ones(1, np.float32), np.zeros((1, 0), np.float32))
    y = np.where(pdf["lang"].to_numpy()[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    dense = lambda grams: np.stack([np.unpackbits(np.frombuffer(g, np.uint8)) for g in grams]).astype(np.float32)
    norm = lambda a: np.sqrt(np.maximum(1, a.sum(axis=1)))
    marks = dense(pdf["grams"][: max(config.landmarks, config.landmarks_per_lang * len(languages))])
    # Rows stay packed, but for a block of them at a time.
    blocks = (dense(pdf["grams"].iloc[i : i + 512]) for i in range(0, len(pdf), 512))
    k_nm = np.concatenate([(x @ marks.T) / (norm(x)[:, None] * norm(marks)[None, :]) for x in blocks])
    k_mm = (marks @ marks.T) / (norm(marks)[:, None] * norm(marks)[None, :])
    values, vectors = np.linalg.eigh(k_mm.astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    z = k_nm.astype(np.float64) @ root
    # Each language weighs the same, however many rows it has.
    weight = 1.0 / pdf.groupby("lang")["lang"].transform("count").to_numpy(float)
    weight *= len(weight) / weight.sum()
    a = (z * weight[:, None]).T @ z + config.ridge * len(z) * np.eye(z.shape[1])
    w = root @ np.linalg.solve(a, (z * weight[:, None]).T @ y)
    return LanguageModel(config, languages, np.ascontiguousarray(marks.T), (norm(marks) ** 2).astype(np.float32), w.astype(np.float32))


def predict_language(docs: DataFrame, model: LanguageModel, text: str = "text", to: str = "language") -> DataFrame:
    """Adds the struct column `to` (lang, score) for every whole text.

    A text that is null or has no letter is `und` with score 0, and so is any text if the model knows no language. Ties go to
    the first language in order. A column of the name `to` is replaced. The model has a fixed size and goes with the tasks.
    """
    own = Carried(docs, to)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang: string, score: double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        at = [i for i, t in enumerate(texts) if m.languages and has_letter(t)]
        for b in range(0, len(at), 256):
            block = at[b : b + 256]
            p = m.scores([presence(texts.iat[i], m.config) for i in block])
            best = p.argmax(axis=1)
            for i, k, row in zip(block, best, p, strict=True):
                lang[i], score[i] = m.languages[k], float(row[k])
        return pd.DataFrame({"lang": lang, "score": np.clip(score, 0, 1)})

    return own.rows.select(*own.back(), predict(F.col(own.at(text))).alias(to))
