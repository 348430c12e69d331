"""Toxicity scores of texts whose words are restored by a noisy-channel decoder first.

1. Trigram counts of characters over all texts give a character language model.
2. A token that mixes letters with digits or signs, holds two signs that look like letters, repeats a
   letter three times, or is spread over single letters is taken for the output of a channel that swaps
   letters for look-alikes, inserts separators and repeats letters.  The lattice of what each character
   may stand for (itself, a letter it looks like, nothing) is decoded by Viterbi under the language model.
   Runs of single letters are decoded again with word ends between letters, and cut into words that
   labelled rows know; tokens are cut at separators.  Every word counts.  Runs and tokens may have any length.
3. Words, and their first four and five letters, get log odds from labelled rows; what a text gathers
   from raw and restored words becomes a probability by logistic regression on labelled rows that the
   odds have not seen.

Labels come from at most `LABELS` rows, at most half of them of either class, picked by a hash of the id;
in the regression a row counts for all labelled rows of its class that it was drawn from, so scores follow
the true ratio of classes at any size.  Rows held out (`shared.held_out`) are never read.  Model tables have fixed bounds and go to every task.  Scores use the
text alone.

Defined cases: null and empty texts, and texts without a known sign, get the score of "nothing found";
without labels of both kinds the coefficients are fixed ones.  A label that is repeated counts as toxic
if one of its rows is; null labels and labels of unknown documents are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwell.llm.shared import chunks, held_out, narrow
from rankwell.scratch import staged

#: Most labelled rows that a model is fitted on.
LABELS = 40_000
#: Most words and beginnings with odds.
SIGNS = 20_000
#: Tokens that a task remembers with their odds.
KNOWN_TOKENS = 400_000
_SYMBOLS = 128
#: Steps of the lattice that stay open behind the ones that are settled.
LAG = 256
#: The letters of the longest word when a run of spread letters is cut, and what an unknown word costs there in nats.
WORD_LETTERS, UNKNOWN_COST = 64, 2.0
#: Longest token that a task remembers.
KNOWN_LENGTH = 256

# What a character may stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h",
}
# Characters that may be inserted between letters, and costs in nats.
SEPARATORS = set(".-_*~'`^+=/\\,:;|")
SWAP_COST, REPEAT_COST, SEPARATOR_COST, DROP_COST = 1.0, 1.2, 1.5, 4.0
_EDGES = ".,;:?\"'()[]{}«»“”„"


def symbol_table() -> np.ndarray:
    """Code point to symbol: 0 for what is no letter, Latin letters each, all other letters 127."""
    table = np.zeros(0x32400, np.uint8)
    known = [chr(c) for c in range(97, 123)] + [chr(c) for c in range(0xDF, 0x180) if chr(c).isalpha() and chr(c) == chr(c).lower()]
    for c in range(0x180, len(table)):
        if chr(c).isalpha():
            table[c] = _SYMBOLS - 1
    for i, c in enumerate(known[:_SYMBOLS - 2], 1):
        table[ord(c)] = i
    return table


def _symbols(text: str, table: np.ndarray) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return table[np.minimum(codes, len(table) - 1)]


def character_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): trigrams of symbols over all texts of `docs` (text), with a blank at either end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = symbol_table()
        total = np.zeros(_SYMBOLS ** 3, np.int64)
        for batch in batches:
            texts = batch.column(0)
            for first, last, _, _ in chunks(texts):
                joined = "\n" + "\n".join(t or "" for t in texts.slice(first, last - first).to_pylist()).lower() + "\n"
                s = np.concatenate(([0], _symbols(joined, table))).astype(np.int32)
                grams = (s[:-2] * _SYMBOLS + s[1:-1]) * _SYMBOLS + s[2:]
                total += np.bincount(grams, minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["gram", "n"])

    return docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probability of a symbol after two others, smoothed by shorter contexts (at most 2,097,152 counts)."""
    counts = character_counts(docs).toArrow()
    three = np.zeros(_SYMBOLS ** 3)
    three[counts.column("gram").to_numpy()] = counts.column("n").to_numpy()
    three = three.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS)
    two = three.sum(axis=0)
    one = two.sum(axis=0) + 1.0
    p1 = one / one.sum()
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None, :, :]) / (three.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


class Restorer:
    """Viterbi decoding of one token at a time."""

    def __init__(self, model: np.ndarray):
        self.model = model
        table = symbol_table()
        self.symbol = lambda c: int(table[min(ord(c), len(table) - 1)])

    def lattice(self, token: str, gaps: bool = False) -> Iterator[list[tuple[str, float]]]:
        """What each character may stand for, with its cost; '' is nothing, ' ' the end of a word.

        With `gaps` a word may end between any two characters.
        """
        before = ""
        for c in token:
            if gaps and before:
                yield [("", 0.0), (" ", 0.0)]
            if c.isalpha():
                options = [(c, 0.0)]
                if c == before:
                    options.append(("", REPEAT_COST))
            else:
                options = [(x, SWAP_COST) for x in LOOKS_LIKE.get(c, "")]
                options.append(("", SEPARATOR_COST if c in SEPARATORS else DROP_COST))
            before = c
            yield options

    def restore(self, token: str, gaps: bool = False) -> str:
        """The letters that most likely stood behind the token, with blanks between words if `gaps` is set.

        Tokens may have any length: each time 2 * `LAG` steps are open, the first `LAG` are settled by the path
        that is best so far.
        """
        best = {(0, 0): 0.0}
        steps: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
        done: list[str] = []

        def path(state: tuple[int, int]) -> list[tuple[tuple[int, int], str]]:
            """For each open step the state in front of it and what it adds."""
            out = []
            for step in reversed(steps):
                out.append(step[state])
                state = step[state][0]
            return out[::-1]

        for options in self.lattice(token, gaps):
            after: dict[tuple[int, int], float] = {}
            came: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
            for state, cost in best.items():
                a, b = state
                for c, extra in options:
                    if not c:
                        to, total = state, cost + extra
                    elif c == " " and not b:
                        continue
                    else:
                        s = self.symbol(c)
                        to, total = (b, s), cost + extra - float(self.model[a, b, s])
                    if to not in after or total < after[to]:
                        after[to] = total
                        came[to] = (state, c)
            best = after
            steps.append(came)
            if len(steps) == 2 * LAG:
                settled = path(min(best, key=best.__getitem__))
                done += [c for _, c in settled[:LAG]]
                # Paths that came another way are given up.
                best = {x: cost for x, cost in best.items() if path(x)[LAG][0] == settled[LAG][0]}
                del steps[:LAG]
        last = min((cost - float(self.model[a, b, 0]), (a, b)) for (a, b), cost in best.items())[1]
        return "".join(done + [c for _, c in path(last)]).strip()

    def segment(self, letters: str, words: dict[str, float]) -> list[str]:
        """The most likely words whose letters follow each other: known ones by their log probability, others by the model."""
        codes = [self.symbol(c) for c in letters]
        best = [0.0] + [math.inf] * len(letters)
        start = [0] * (len(letters) + 1)
        for i in range(len(letters)):
            a, b, spelled = 0, 0, UNKNOWN_COST
            for j in range(i + 1, min(len(letters), i + WORD_LETTERS) + 1):
                spelled -= float(self.model[a, b, codes[j - 1]])
                a, b = b, codes[j - 1]
                cost = best[i] + min(spelled - float(self.model[a, b, 0]), -words.get(letters[i:j], -math.inf))
                if cost < best[j]:
                    best[j], start[j] = cost, i
        out, end = [], len(letters)
        while end:
            out.append(letters[start[end]:end])
            end = start[end]
        return out[::-1]


_MIXED = re.compile(r"[^\W\d_].*[\d\W_]|[\d\W_].*[^\W\d_]", re.S)
_REPEATED = re.compile(r"(.)\1\1")
#: Two characters that may stand for letters; with them a token without a letter may be a word.
_LOOKS = re.compile("[" + re.escape("".join(LOOKS_LIKE)) + "].*[" + re.escape("".join(LOOKS_LIKE)) + "]", re.S)


_SEPARATED = re.compile("[" + re.escape("".join(sorted(SEPARATORS))) + "]+")


def _signs(word: str) -> list[str]:
    return [word] + [word[:k] + "~" for k in (4, 5) if len(word) > k]


class Reader:
    """Signs of tokens and texts: words and beginnings, of the token as it stands and as restored."""

    def __init__(self, model: np.ndarray, words: dict[str, float] | None = None):
        self.restorer = Restorer(model)
        self.words = words or {}

    def token_signs(self, token: str) -> list[str]:
        word = token.strip(_EDGES)
        if not word:
            return []
        out = _signs(word)
        inner = word if not word.endswith("!") else word.rstrip("!") or word
        if _MIXED.search(inner) or _REPEATED.search(inner) or _LOOKS.search(inner):
            restored = self.restorer.restore(inner)
            if restored and restored != word:
                out += _signs(restored)
            pieces = [x for x in _SEPARATED.split(inner) if x]
            if len(pieces) > 1:
                for piece in pieces:
                    out += self.token_signs(piece) if len(piece) > 1 else []
                for run in self.spread(pieces):
                    out += self.run_signs(run)
        return out

    def run_signs(self, run: str) -> list[str]:
        """Signs of every word that a run of spread characters is decoded into, by letters and by known words."""
        gapped = self.restorer.restore(run, True).split()
        found = dict.fromkeys(gapped)
        for letters in {self.restorer.restore(run), "".join(gapped), run if run.isalpha() else ""}:
            found.update(dict.fromkeys(self.restorer.segment(letters, self.words)))
        return [sign for word in found for sign in _signs(word)]

    @staticmethod
    def spread(tokens: list[str]) -> list[str]:
        """Runs of at least three single characters, joined."""
        if sum(len(t) == 1 for t in tokens) < 3:
            return []
        out: list[str] = []
        run: list[str] = []
        for t in [*tokens, "  "]:
            if len(t) == 1 or (run and len(t) == 2 and t[1] in _EDGES):
                run.append(t[0])
            else:
                if len(run) >= 3 and len(set(run)) > 1:
                    out.append("".join(run))
                run = []
        return out

    def tokens(self, text: str) -> set[str]:
        every = text.lower().split()
        found = set(every)
        # A spread word is read as one token; its joined form is marked so that it is always decoded.
        found.update("\x00" + x for x in self.spread(every))
        return found

    def signs(self, token: str) -> list[str]:
        if token[0] == "\x00":
            return _signs(token[1:]) + _signs(self.restorer.restore(token[1:])) + self.run_signs(token[1:])
        return self.token_signs(token)


def label_sample(labels: DataFrame, most: int = LABELS) -> DataFrame:
    """(doc_id, toxic, part, weight): at most `most` labelled rows that are not held out; part 3 is for calibration.

    `weight` is how many labelled rows of its class a drawn row stands for.
    """
    rows = narrow(labels, {"doc_id": "long", "toxic": "int"}).where("doc_id is not null and toxic is not null")
    rows = rows.where(~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.withColumn("part", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).cast("int"))
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    halves = [rows.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2).withColumn(
        "weight", F.lit(max(1.0, totals.get(k, 0) / max(1, most // 2)))) for k in (0, 1)]
    return halves[0].unionByName(halves[1])


def known_words(labelled: DataFrame) -> dict[str, float]:
    """Log probabilities of all words that occur three times or more in `labelled` (text), whatever their label.

    `labelled` is bounded (`label_sample`), and so are its words.
    """
    word = F.explode(F.split(F.lower("text"), r"\s+"))
    counts = labelled.select(word.alias("w")).select(F.btrim("w", F.lit(_EDGES)).alias("w")).where("w <> ''").groupBy("w").agg(
        F.count("*").alias("n")).where("n >= 3")
    found = counts.toArrow()
    total = sum(found.column("n").to_pylist())
    return {w: math.log(n / total) for w, n in zip(found.column("w").to_pylist(), found.column("n").to_pylist()) if w.isalpha()}


def sign_odds(labelled: DataFrame, model: np.ndarray, most: int = SIGNS, words: dict[str, float] | None = None) -> dict[str, float]:
    """Log odds of the signs that speak for toxicity, from `labelled` (text, toxic)."""
    shared = labelled.sparkSession.sparkContext.broadcast((model, words))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*shared.value)
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for sign in {s for t in reader.tokens(text or "") for s in reader.signs(t)}:
                    counts.setdefault(sign, [0, 0])[toxic] += 1
            signs = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signs, pa.string()), pa.array([counts[s][0] for s in signs], pa.int64()),
                 pa.array([counts[s][1] for s in signs], pa.int64())], names=["sign", "clean", "toxic"])

    totals = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    if not toxic:
        return {}
    counts = labelled.select("text", "toxic").mapInArrow(count, "sign string, clean long, toxic long").groupBy("sign").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    found = counts.where("toxic >= 2").select("sign", odds.alias("odds"), "toxic").where("odds > 1.5")
    return {r["sign"]: r["odds"] for r in found.orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "sign").limit(most).collect()}


def _evidence(docs: DataFrame, model: np.ndarray, odds: dict[str, float], words: dict[str, float], texts_too: bool = False) -> DataFrame:
    """`docs` (doc_id, text, ...), without text unless asked for, with `most` and `sum`: the largest odds of a
    token, and their sum."""
    shared = docs.sparkSession.sparkContext.broadcast((model, odds, words))
    rest = [f for f in docs.schema.fields if texts_too or f.name != "text"]
    sent = [f"`{f.name}`" for f in docs.schema.fields if f.name != "text"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, odds, words = shared.value
        reader = Reader(model, words)
        known: dict[str, float] = {}

        def of(token: str) -> float:
            worth = max((odds.get(s, 0.0) for s in reader.signs(token)), default=0.0)
            if len(token) <= KNOWN_LENGTH:
                known[token] = worth
            return worth

        for batch in batches:
            most, total = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            texts = batch.column("text")
            for first, last, _, _ in chunks(texts):
                if len(known) > KNOWN_TOKENS:
                    known.clear()
                for row, text in enumerate(texts.slice(first, last - first).to_pylist(), first):
                    if text:
                        worth = sorted(x for x in [known[t] if t in known else of(t) for t in reader.tokens(text)] if x)
                        if worth:
                            most[row], total[row] = worth[-1], math.fsum(worth)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in rest), pa.array(most), pa.array(total)], names=[*(f.name for f in rest), "most", "sum"])

    schema = T.StructType([*rest, T.StructField("most", T.DoubleType()), T.StructField("sum", T.DoubleType())])
    return docs.select(*sent, "text").mapInArrow(read, schema)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Coefficients (constant last) by Newton steps with a small penalty; a row counts `n` times."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + 0.05 * np.eye(len(w)), x.T @ (n * (y - p)) - 0.05 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


#: Coefficients for the largest odds, the log of their sum, and the constant, where labels of one kind are missing.
DEFAULT_COEFFICIENTS = (1.0, 0.0, -4.0)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs` (doc_id, text); `labels` has doc_id and toxic.

    `carry` names columns of `docs` to return as well, as they are; they are no inputs.
    """
    carry = [c for c in carry or [] if c != "doc_id"]
    every = narrow(docs, {"doc_id": "long", "text": "string"} | {c: t for c, t in docs.dtypes if c in carry and c != "text"})
    docs = every.select("doc_id", "text")
    model = language_model(docs)
    sample = label_sample(labels)
    # At most LABELS rows of two numbers.
    labelled = staged(docs.join(F.broadcast(sample), "doc_id"), "labelled")
    words = known_words(labelled.where("part <> 3"))
    odds = sign_odds(labelled.where("part <> 3").select("text", "toxic"), model, words=words)
    seen = _evidence(labelled.where("part = 3").select("doc_id", "toxic", "weight", "text"), model, odds, words).select(
        "toxic", "weight", "most", "sum").toArrow()
    y = seen.column("toxic").to_numpy()
    if 0 < y.sum() < len(y):
        w = _logistic(np.column_stack((seen.column("most").to_numpy(), np.log1p(seen.column("sum").to_numpy()))), y, seen.column("weight").to_numpy())
    else:
        w = np.array(DEFAULT_COEFFICIENTS)
    # The text travels with the row where it is carried, so nothing is joined back.
    found = _evidence(every, model, odds, words, "text" in carry)
    z = F.col("most") * float(w[0]) + F.log1p("sum") * float(w[1]) + float(w[2])
    score = (1 / (1 + F.exp(-z))).cast("double")
    return found.select("doc_id", *[f"`{c}`" for c in carry], held_out().alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
