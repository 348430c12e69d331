"""Language identification in two steps: the family first, then one-against-one support vector machines.

Texts become normalised counts of hashed character trigrams.  Linear support vector machines for every
pair of families decide the family by votes; inside it, machines for every pair of its languages decide
the language.  Training uses at most about `PER_LANGUAGE` texts of each of the `LANGUAGES` most frequent
languages, picked by a hash of the id, from rows that are not held out.

Defined cases: a text that is null or has no letter is `und` with score 0; so is every text when there is
nothing to learn from.  A family with one language needs no further machine.  Equal votes go to the larger
sum of margins, then to the earlier name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.shared import chunks, held_out, narrow
from rankwell.scratch import staged

PER_LANGUAGE = 400
LANGUAGES = 200
FEATURES = 2048

# Families of languages; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "baltic": ["lt", "lv"], "uralic": ["fi", "et", "hu"], "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "mr", "ne", "bn", "gu", "pa", "ur"], "semitic": ["ar", "he", "mt"],
}


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language in members), language)


def letter_table() -> np.ndarray:
    """Code point to 1 if it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x32400)], bool)


def features(texts: list[str | None], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of FEATURES numbers per text, of length 1 (0 without a letter), and whether it has a letter."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    any_letter = np.zeros(len(texts), bool)
    for row, text in enumerate(texts):
        if not text:
            continue
        counts = np.zeros(FEATURES, np.int64)
        # One text may be very long: pieces overlap by two characters, so every trigram is counted once.
        for low in range(0, max(1, len(text) - 2), 1 << 18):
            piece = text[low:low + (1 << 18) + 2].lower()
            codes = np.frombuffer(f" {piece} ".encode("utf-32-le", "surrogatepass"), np.uint32)
            is_letter = letters[np.minimum(codes, len(letters) - 1)]
            any_letter[row] |= bool(is_letter.any())
            codes = np.where(is_letter, codes, 32)
            grams = (codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA6B) ^ codes[2:] * np.uint32(0xC2B2AE35))
            useful = is_letter[1:-1]
            counts += np.bincount((grams[useful] * np.uint32(0x27D4EB2F)) >> np.uint32(21), minlength=FEATURES)
        out[row] = np.sqrt(counts)
        size = np.linalg.norm(out[row])
        if size:
            out[row] /= size
    return out, any_letter


def training_texts(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, x): features of the sample."""
    known = docs.where(~held_out()).where("lang is not null and text is not null")
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return docs.sparkSession.createDataFrame([], "lang string, x array<double>")
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, per_language / r["n"]))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                x, good = features(part.column("text").to_pylist(), letters)
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), pa.array(list(x.astype(np.float64)), pa.list_(pa.float64()))], names=["lang", "x"]).filter(pa.array(good))

    return known.where(draw < F.try_element_at(share, F.col("lang"))).select("lang", "text").mapInArrow(
        count, "lang string, x array<double>")


def _machines(rows: DataFrame, column: str, values: list[str]) -> list[tuple[str, str, np.ndarray]]:
    """For each pair of values the coefficients (constant last) that are positive for the second."""
    out = []
    for a, b in combinations(values, 2):
        pair = rows.where(F.col(column).isin(a, b)).select(
            array_to_vector("x").alias("features"), (F.col(column) == b).cast("double").alias("label"))
        fitted = LinearSVC(maxIter=20, regParam=0.001, standardization=False).fit(pair)
        out.append((a, b, np.append(fitted.coefficients.toArray(), fitted.intercept)))
    return out


def _decided(x: np.ndarray, values: list[str], machines: list[tuple[str, str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Position of the winning value per row, and how sure the least sure machine that it won is."""
    place = {v: i for i, v in enumerate(values)}
    votes, margins = np.zeros((len(x), len(values))), np.zeros((len(x), len(values)))
    least = np.full((len(x), len(values)), np.inf)
    for a, b, w in machines:
        m = x @ w[:-1] + w[-1]
        i, j = place[a], place[b]
        votes[:, j] += m > 0
        votes[:, i] += m <= 0
        for k, s in ((i, -m), (j, m)):
            margins[:, k] += s
            least[:, k] = np.minimum(least[:, k], s)
    best = np.lexsort((np.tile(-np.arange(len(values)), (len(x), 1)), margins, votes), axis=1)[:, -1]
    sure = 1 / (1 + np.exp(-2 * np.clip(least[np.arange(len(x)), best], -15, 15)))
    return best, sure


def fit_languages(docs: DataFrame) -> dict:
    """The families, and the machines of families and of the languages inside each."""
    rows = staged(training_texts(docs), "languages")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    families = sorted({family_of(v) for v in languages})
    members = {f: [v for v in languages if family_of(v) == f] for f in families}
    family = F.create_map(*[F.lit(v) for x in languages for v in (x, family_of(x))]) if languages else None
    named = rows.withColumn("family", F.try_element_at(family, F.col("lang"))) if languages else rows
    return {
        "families": families, "members": members,
        "between": _machines(named, "family", families) if len(families) > 1 else [],
        "inside": {f: _machines(rows, "lang", m) if len(m) > 1 else [] for f, m in members.items()},
    }


def predict_languages(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of `docs` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        letters = letter_table()
        for batch in batches:
            names = np.full(batch.num_rows, "und", object)
            scores = np.zeros(batch.num_rows)
            texts = batch.column("text")
            for start, stop, _, _ in chunks(texts):
                for first in range(start, stop, 512):
                    last = min(stop, first + 512)
                    x, good = features(texts.slice(first, last - first).to_pylist(), letters)
                    rows = np.flatnonzero(good)
                    if not len(rows) or not model["families"]:
                        continue
                    x = x[rows]
                    which, sure = _decided(x, model["families"], model["between"])
                    for i, family in enumerate(model["families"]):
                        own = np.flatnonzero(which == i)
                        if not len(own):
                            continue
                        members = model["members"][family]
                        best, more = _decided(x[own], members, model["inside"][family])
                        names[first + rows[own]] = np.array(members, object)[best]
                        scores[first + rows[own]] = np.minimum(sure[own], more)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(names), pa.string()), pa.array(scores)],
                                             names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def identify_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of `docs` (doc_id, text, lang)."""
    docs = narrow(docs, {"doc_id": "long", "text": "string", "lang": "string"})
    return predict_languages(docs, fit_languages(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
