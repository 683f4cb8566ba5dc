"""Language identification by a string kernel.

Kernel: k(x, y) = |G(x) and G(y)| / sqrt(|G(x)| |G(y)|), G(x) being the set of
n-grams (blended: n = 1 to 4 lower-case characters) present in the whole text,
by hash into ``BITS`` places. Nystroem landmarks stand for the training rows,
one-versus-rest kernel ridge regression gives a weight per landmark and
language. As the kernel is a product of presence vectors, landmarks and
weights fold into one matrix; a batch of texts is scored by one product.

Every lang value is learned. Only the presence bits of at most ``max_rows``
training rows, or ``least`` rows a language if that is more, ever reach the
driver; ``landmarks`` of them, or one a language, are landmarks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, remainder

BITS = 1 << 15
LETTER = regex.compile(r"\p{L}")  # as training asks of a text


def present(text: str) -> np.ndarray:
    """Places of the n-grams that the text holds, as a boolean vector."""
    found = np.zeros(BITS, bool)
    codes = np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype(np.uint32)
    gram = np.zeros(len(codes) + 1, np.uint32)
    for n in range(1, 5):
        if len(codes) < n:
            break
        gram = gram[: len(codes) - n + 1] * np.uint32(0x9E3779B1) + codes[n - 1 :] + np.uint32(n)
        mixed = gram ^ (gram >> np.uint32(15))
        found[(mixed * np.uint32(0x85EBCA6B)) >> np.uint32(17)] = True
    return found


def normalised(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BITS x languages: landmarks and regression folded

    def margins(self, x: np.ndarray) -> np.ndarray:
        return normalised(x) @ self.weights

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = 4 * self.margins(x)
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def unpacked(packed: np.ndarray) -> np.ndarray:
    return normalised(np.unpackbits(packed, axis=1).astype(np.float32))


def fit(packed: np.ndarray, names: list[str], landmarks: int, ridge: float, block: int = 128) -> Model:
    """One-versus-rest kernel ridge regression on Nystroem features.

    packed: presence vectors, eight places a byte, rows in any order; the
    landmarks are taken evenly over the rows, and each language has one at least.
    Only the landmarks and ``block`` rows are unpacked at a time.
    """
    languages = sorted(set(names))
    chosen = np.unique(np.linspace(0, len(packed) - 1, min(landmarks, len(packed))).astype(int))
    without = set(languages) - {names[i] for i in chosen}
    marks = unpacked(packed[np.unique(np.concatenate([chosen, [names.index(x) for x in sorted(without)]])).astype(int)])
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    z = np.concatenate([unpacked(packed[lo : lo + block]) @ marks.T for lo in range(0, len(packed), block)]) @ root
    y = np.where(np.asarray(names)[:, None] == np.asarray(languages), 1.0, -1.0)
    beta = np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ (y - y.mean(0)))
    # an intercept would be lost in the fold; the centred targets' means are small against the margins
    return Model(languages, marks.T @ (root @ beta).astype(np.float32))


def training_bits(docs: DataFrame, key: str, text: str, lang: str, max_rows: int, least: int) -> tuple[np.ndarray, list[str]]:
    """Presence bits (packed) and languages of a sample of labelled rows of every language, equal shares by language, chosen by hash of the key."""
    rows = docs.filter((remainder(key, 4) != 2) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit(11), F.col(key)).alias("h"))
    counts = rows.groupBy("lang").count()
    languages = counts.count()
    if not languages:
        return np.zeros((0, BITS // 8), np.uint8), []
    share = max(least, max_rows // languages)
    # a hash threshold lets about twice the share through; the rest is cut exactly in a small window
    bound = F.least(F.lit(1.0), F.lit(2.0 * share + 50) / F.col("count")) * 2.0**64 - 2.0**63
    bounds = F.broadcast(counts.select("lang", bound.alias("bound")))  # one row a language
    passes = F.col("h").cast("double") <= F.col("bound")
    few = rows.join(bounds, "lang").filter(passes).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("rank") <= share)

    def bits(batches):
        import pyarrow as pa

        for batch in pieces(batches):
            packed = [np.packbits(present(t)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["lang", "bits"])

    got = few.select("lang", "text").mapInArrow(bits, "lang string, bits binary").collect()
    got.sort(key=lambda r: (r["lang"], r["bits"]))
    return np.frombuffer(b"".join(r["bits"] for r in got), np.uint8).reshape(len(got), BITS // 8), [r["lang"] for r in got]


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = 1600, landmarks: int = 256, ridge: float = 0.1, least: int = 8) -> Model | None:
    bits, names = training_bits(docs, key, text, lang, max_rows, least)
    return fit(bits, names, landmarks, ridge) if names else None


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1) appended.

    ``und`` with score 0: the text is null or has no letter, or no row was
    there to learn from. Very long texts are read whole. Every row is predicted,
    repeated ones alike; an empty table gives no rows. Input columns called
    lang_pred or score are replaced, others kept.
    """
    from .common import free_names

    spark: SparkSession = docs.sparkSession
    docs = free_names(docs, "lang_pred", "score")
    shared = spark.sparkContext.broadcast(model)  # BITS x languages numbers
    at = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in pieces(batches, 128):
            texts = batch.column(at).to_pylist()
            seen = [i for i, t in enumerate(texts) if m and t and LETTER.search(t)]
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            if seen:
                p = m.probabilities(np.stack([present(texts[i]) for i in seen]).astype(np.float32))
                for i, row in zip(seen, p, strict=True):
                    best = int(row.argmax())
                    names[i], scores[i] = m.languages[best], float(row[best])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)
