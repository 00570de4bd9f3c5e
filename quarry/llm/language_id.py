"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from the letter's code point. An n-gram is the
product of its letters' vectors, each rotated by its distance from the n-gram's end; a text is the
sum of its n-grams, and a language the sum of its training texts. A text gets the language whose
vector has the largest cosine with its own. Text is lower-cased; everything but letters is a word
boundary, which is a symbol like the letters.

Nulls: a null text, and one without a letter, is ``und`` with score 0. Rows without a language
don't train. Ties go to the language that sorts first. Without any training row every text is
``und``. Repeated rows count as often as they occur. Other columns are ignored; columns that are
called lang_pred or score are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import code_points, crc_mod, released, slices, table

DIMENSIONS = 1024
GRAM = 3
BATCH_BYTES = 384 << 10
SUPPORT = 1_000  # labelled rows of one length that it takes to measure one
NOISE = 0.05  # a cosine that unrelated vectors of DIMENSIONS reach

_state: dict = {}


def _letter_table() -> np.ndarray:
    """Code point -> itself if a letter, else 0."""
    if "letters" not in _state:
        points = np.arange(0x110000, dtype=np.uint32)
        letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
        _state["letters"] = np.where(letters, points, 0).astype(np.uint32)
    return _state["letters"]


def letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    known = _state.setdefault(("vectors", dimensions), {})
    for p in map(int, points):
        if p not in known:
            bits = np.random.Generator(np.random.Philox(key=p)).integers(0, 2, dimensions, dtype=np.int8)
            known[p] = (2 * bits - 1).astype(np.float32)
    return np.stack([known[int(p)] for p in points]) if len(points) else np.zeros((0, dimensions), np.float32)


def grams(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of the texts (rows of code points), and for each occurrence the text's
    number and the n-gram's. A text without letters has none."""
    table_ = _letter_table()
    parts, owners = [], []
    for i, text in enumerate(texts):
        points = table_[code_points((text or "").lower())]
        kept = points[(points != 0) | np.concatenate([[False], points[:-1] != 0])] if len(points) else points
        if not kept.any():
            continue
        parts.append(np.concatenate([[0], kept, [0]] if kept[-1] else [[0], kept]).astype(np.int64))
        owners.append(np.full(len(parts[-1]), i))
    if not parts:
        return np.zeros((0, n), np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    line, owner = np.concatenate(parts), np.concatenate(owners)
    seen = np.zeros(0x110000, dtype=np.int32)
    seen[line] = 1
    alphabet = np.flatnonzero(seen)
    seen[alphabet] = np.arange(len(alphabet))
    local, size = seen[line].astype(np.int64), len(alphabet)
    code = local[: len(local) - n + 1].copy()
    for k in range(1, n):
        code = code * size + local[k : len(local) - n + 1 + k]
    whole = owner[: len(owner) - n + 1] == owner[n - 1 :]
    code, owner = code[whole], owner[: len(owner) - n + 1][whole]
    if size**n <= 1 << 22:
        at = np.bincount(code, minlength=size**n)
        distinct = np.flatnonzero(at)
        at[distinct] = np.arange(len(distinct))
        which = at[code]
    else:
        distinct, which = np.unique(code, return_inverse=True)
    rows = np.empty((len(distinct), n), np.uint32)
    for k in range(n - 1, -1, -1):
        rows[:, k] = alphabet[distinct % size]
        distinct = distinct // size
    return rows, owner, which


def gram_vectors(rows: np.ndarray, dimensions: int) -> np.ndarray:
    letters, which = np.unique(rows, return_inverse=True)
    base, which = letter_vectors(letters, dimensions), which.reshape(rows.shape)
    out = np.ones((len(rows), dimensions), np.float32)
    for k in range(rows.shape[1]):
        out *= np.roll(base, rows.shape[1] - 1 - k, axis=1)[which[:, k]]
    return out


def bundle(texts: list[str | None], groups: np.ndarray, n_groups: int, dimensions: int, n: int) -> np.ndarray:
    """The sums of the n-gram vectors of each group of texts."""
    out = np.zeros((n_groups, dimensions), np.float32)
    rows, owner, which = grams(texts, n)
    for a in range(0, len(rows), 8192):
        mine = (which >= a) & (which < a + 8192)
        part = rows[a : a + 8192]
        counts = np.bincount(groups[owner[mine]] * len(part) + which[mine] - a, minlength=n_groups * len(part))
        out += counts.reshape(n_groups, len(part)).astype(np.float32) @ gram_vectors(part, dimensions)
    return out


def train(labelled: DataFrame, dimensions: int = DIMENSIONS, n: int = GRAM) -> tuple[list[str], np.ndarray]:
    """Language prototypes from (text, lang): their names, sorted, and their unit vectors. What
    comes to the driver is one vector a language."""

    @released(__name__)
    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, most=4 * BATCH_BYTES):
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            place = {name: i for i, name in enumerate(names)}
            found = bundle(batch.column(0).to_pylist(), np.array([place[x] for x in langs]), len(names), dimensions, n)
            for name, vector in zip(names, found.astype(np.float64)):
                total[name] = total[name] + vector if name in total else vector
        for name, vector in total.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name]), "bundle": pa.array([vector])})

    rows = (
        labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
        .where("lang is not null and text is not null")
        .mapInArrow(sums, "lang string, bundle array<double>")
        .select("lang", F.posexplode("bundle").alias("place", "value"))
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    names = sorted({r.lang for r in rows})
    place = {name: i for i, name in enumerate(names)}
    out = np.zeros((len(names), dimensions))
    for r in rows:
        out[place[r.lang], r.place] = r.value
    return names, (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def judge(texts: list[str | None], model: tuple[list[str], np.ndarray], n: int = GRAM) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and the cosine, at least 0."""
    names, prototypes = model
    found = bundle(texts, np.arange(len(texts)), len(texts), prototypes.shape[1], n)
    norm = np.linalg.norm(found, axis=1)
    if not names:
        return ["und"] * len(texts), np.zeros(len(texts))
    cosines = found @ prototypes.T / np.maximum(norm, 1e-12)[:, None]
    best = np.argmax(cosines, axis=1)
    score = np.clip(cosines[np.arange(len(texts)), best], 0, 1).astype(np.float64)
    score[norm == 0] = 0
    return [names[b] if v > 0 else "und" for b, v in zip(best, norm)], score


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], n: int = GRAM) -> DataFrame:
    """``docs`` with lang_pred and score (the cosine, at least 0) added; needs a column text."""
    docs = docs.drop("lang_pred", "score")
    place = docs.columns.index("text")

    @released(__name__)
    def label(batches):
        for batch in slices(batches, most=BATCH_BYTES):
            lang, score = judge(batch.column(place).to_pylist(), model, n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(label, f"{kinds}, lang_pred string, score double")


def _size(text):
    """The binary logarithm of a text's length, a whole number; texts of one size score alike."""
    return F.floor(F.log2(F.length(text) + 1)).cast("int")


def least_scores(labelled: DataFrame, model: tuple[list[str], np.ndarray], share: float = 0.001) -> dict[int, float]:
    """For each size of text the score that all but ``share`` of the labelled rows (text, lang),
    which the model hasn't seen, reach in their own language. All of them are measured; a size with
    fewer than SUPPORT of them isn't in the result."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    found = (
        predict(rows, model)
        .where("lang = lang_pred")
        .groupBy(_size(F.col("text")).alias("size"))
        .agg(F.percentile_approx("score", share, 10_000).alias("least"), F.count("*").alias("n"))
        .where(F.col("n") >= SUPPORT)
        .collect()
    )  # a row a size
    return {r["size"]: r["least"] for r in found}


def of_known_language(docs: DataFrame, model: tuple[list[str], np.ndarray], least: dict[int, float], n: int = GRAM) -> DataFrame:
    """``docs``, all columns, without texts that are ``und`` or score less than their size's least
    score (NOISE where it has none). Rows that stay pass through the tasks once."""
    place = docs.columns.index("text")

    @released(__name__)
    def keep(batches):
        for batch in slices(batches, most=BATCH_BYTES):
            texts = batch.column(place).to_pylist()
            lang, score = judge(texts, model, n)
            enough = [l != "und" and s >= least.get((len(t) + 1).bit_length() - 1, NOISE) for l, s, t in zip(lang, score, texts)]
            yield batch.filter(pa.array(enough, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(crc_mod(F.col("doc_id"), 3) != 1))
    return predict(docs.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("text").cast("string").alias("text")), model).drop("text")
