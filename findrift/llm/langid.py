"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1; one binary classifier on hashed character n-grams (1 to
3, of letters and single spaces) predicts each bit.  A text's language is the codeword with the least
loss over the bits, each bit weighted by how well its classifier separates the training rows; texts
whose two best codewords are nearly as good are flagged ambiguous.

The classifiers are fitted on the driver on a bounded sample of labelled rows (``sample_rows``, chosen
by a hash); prediction reads every whole text.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, slices

DIMS = 4096
#: Labelled rows that are fitted, over all languages; each gives its whole text and a short piece of it.
SAMPLE_ROWS = 1000
#: Sampled rows of a language, however many languages there are.
LEAST_ROWS = 5
RIDGE = 0.05
#: Below this margin between the two best languages' probabilities a text is ambiguous.
MARGIN = 0.05
UNDETERMINED = "und"
SLICE = 1 << 20

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """A table over all code points: is it a letter?"""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def counts(text: str) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text; None where it has no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return None
    code = np.where(letter, code, 32)
    code = code[np.r_[True, letter[1:] | letter[:-1]]]
    code = np.concatenate([[32], code, [32]]).astype(np.uint32)
    total = np.zeros(DIMS, np.int64)
    for lo in range(0, len(code), SLICE):
        part, h = code[lo : lo + SLICE + 2], np.uint32(0)
        for n in range(1, 4):
            stop = min(SLICE, len(code) - lo - n + 1)
            if stop <= 0:
                break
            h = (h[:stop] if n > 1 else np.zeros(stop, np.uint32)) * np.uint32(0x01000193) + part[n - 1 : n - 1 + stop] + np.uint32(n)
            total += np.bincount(((h * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64), minlength=DIMS)
    return total


def features(text: str) -> np.ndarray | None:
    """Square roots of the counts, scaled to length 1."""
    c = counts(text)
    if c is None:
        return None
    x = np.sqrt(c.astype(np.float32))
    return x / np.sqrt(np.float32(c.sum()))


def code_words(n: int) -> np.ndarray:
    """n codewords of +1 and -1 that differ in many bits: all splits for up to 7, else the best of 50 random tables."""
    if n < 2:
        return np.ones((n, 1), np.float32)
    if n <= 7:
        table = np.array(list(itertools.product([1, -1], repeat=n - 1)))[1:]
        return np.concatenate([np.ones((len(table), 1)), table], axis=1).T.astype(np.float32)
    bits, rng, best = 15 * int(np.ceil(np.log2(n))), np.random.default_rng(5), None
    for _ in range(50):
        table = rng.choice([-1.0, 1.0], (n, bits)).astype(np.float32)
        gap = ((bits - table @ table.T) / 2 + bits * np.eye(n)).min()
        if best is None or gap > best[0]:
            best = (gap, table)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weight: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, its probability, margin over the second)."""
        f = x @ self.weights + self.bias
        # Logistic loss of each bit for each codeword, weighted by the bit's quality.
        loss = np.stack([(np.logaddexp(0, -4 * c * f) * self.bit_weight).sum(axis=1) for c in self.codes], axis=1)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        order = np.sort(p, axis=1)
        return loss.argmin(axis=1), p.max(axis=1), order[:, -1] - (order[:, -2] if p.shape[1] > 1 else 0)


def fit(x: np.ndarray, labels: list[str]) -> Model:
    """Ridge classifiers for the bits, solved in the sample's own space."""
    languages = sorted(set(labels))
    codes = code_words(len(languages))
    at = {lang: i for i, lang in enumerate(languages)}
    which = np.array([at[lang] for lang in labels])
    share = np.bincount(which, minlength=len(languages))[which]
    importance = np.sqrt(len(labels) / (len(languages) * share)).astype(np.float32)[:, None]  # languages weigh alike
    target = codes[which]
    if len(languages) == 1:
        return Model(languages, codes, np.zeros((DIMS, 1), np.float32), np.ones(1, np.float32), np.ones(1, np.float32))
    bias = (target * importance**2).mean(axis=0)
    xs, ys = x * importance, (target - bias) * importance
    if len(xs) <= DIMS:
        weights = xs.T @ np.linalg.solve(xs @ xs.T + RIDGE * np.eye(len(xs), dtype=np.float32), ys)
    else:  # the same solution in the space of the features
        weights = np.linalg.solve(xs.T @ xs + RIDGE * np.eye(DIMS, dtype=np.float32), xs.T @ ys)
    agree = (np.sign(x @ weights + bias) == target).mean(axis=0)
    return Model(languages, codes, weights.astype(np.float32), bias.astype(np.float32), np.maximum(2 * agree - 1, 0.05).astype(np.float32))


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fits on rows that aren't held out and have a language; None where there is none.

    Every language that has training rows is learned.  The sample takes ids by a hash, as many for every
    language: ``sample_rows`` over the number of languages, or LEAST_ROWS where that is more.
    """
    light = df.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang")).where(
        F.col("_lang").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id"))
    )
    found = light.select("_lang").distinct().count()
    if not found:
        return None
    each = max(LEAST_ROWS, sample_rows // found)
    w = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    chosen = light.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= each).select("_id", "_lang").distinct()
    ids = chosen.collect()  # at most sample_rows, or LEAST_ROWS a language
    if not ids:
        return None
    spark = df.sparkSession
    table = F.broadcast(spark.createDataFrame(ids, chosen.schema))
    texts = df.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text")).join(
        table, ["_id", "_lang"]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, lang, text in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
                text = text or ""
                n = (20, 40, 80, 160)[len(text) % 4]
                at = len(text) // 2
                for piece, t in enumerate((text, text[at : at + n])):
                    if (c := counts(t)) is not None:
                        where = np.flatnonzero(c)
                        out.append({"id": str(i), "lang": lang, "piece": piece, "at": where.astype(np.int16).tobytes(), "n": c[where].astype(np.float32).tobytes()})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("id", pa.string()), ("lang", pa.string()), ("piece", pa.int32()), ("at", pa.binary()), ("n", pa.binary())]))

    rows = lean(texts).mapInArrow(run, "id string, lang string, piece int, at binary, n binary").dropDuplicates(["id", "lang", "piece"]).collect()
    rows.sort(key=lambda r: (r["lang"], r["id"], r["piece"]))
    if not rows:
        return None
    x = np.zeros((len(rows), DIMS), np.float32)
    for i, r in enumerate(rows):
        n = np.frombuffer(r["n"], np.float32)
        x[i, np.frombuffer(r["at"], np.int16)] = np.sqrt(n / n.sum())
    return fit(x, [r["lang"] for r in rows])


def identify(
    df: DataFrame,
    model: Model | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    margin: float = MARGIN,
    outputs: tuple[str, str, str] = ("lang_pred", "score", "ambiguous"),
) -> DataFrame:
    """The language of every whole text: ``id_col``, ``keep``, and ``outputs``: language, score, ambiguous or not.

    score is the winning language's probability, 0 to 1.  Null texts, texts without a letter, and all
    texts under no model are ``und`` with score 0, not ambiguous.  One output row per input row;
    ``keep`` names further columns to pass through, the text among them if wanted; a kept column with
    the name of an output gives way to it.
    """
    taken = {c.lower() for c in outputs}
    names = [c for c in dict.fromkeys([id_col, *keep]) if c == id_col or c.lower() not in taken]
    more = [] if text_col in names else [text_col]
    at_text = [*names, *more].index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in slices(batches, 512):
            lang, score, unsure = [UNDETERMINED] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
            if m:
                found = [(i, x) for i, t in enumerate(part.column(at_text)) if t.is_valid and (x := features(t.as_py())) is not None]
                if found:
                    which, p, gap = m.predict(np.stack([x for _, x in found]))
                    for (i, _), k in zip(found, which, strict=True):
                        lang[i] = m.languages[k]
                    at = [i for i, _ in found]
                    score[at], unsure[at] = p, gap < margin
            yield pa.RecordBatch.from_arrays(
                [*part.columns[: len(names)], pa.array(lang, pa.string()), pa.array(score.astype(float), pa.float64()), pa.array(unsure, pa.bool_())],
                names=[*names, *outputs],
            )

    schema = T.StructType(
        [*[T.StructField(c, df.schema[c].dataType) for c in names], T.StructField(outputs[0], T.StringType()),
         T.StructField(outputs[1], T.DoubleType()), T.StructField(outputs[2], T.BooleanType())]
    )
    return lean(df.select(*names, *more)).mapInArrow(run, schema)
