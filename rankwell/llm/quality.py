"""Quality rules as a short-circuit cascade ordered by rejections per cost.

A rule is a condition that rejects a text.  Its cost (time) and selectivity (share rejected) are
estimated on a sample; rules that reject much for little run first, and a row that one rule rejects
is not looked at by the rules after it (CASE evaluates its branches in turn).  The order only decides
the time: a row is kept if no rule rejects it, whatever the order.

Defined cases: null and empty texts have no words, every count is 0 and they fail the base rules.
Rows are never merged or dropped, whether doc_ids repeat or are null; a text of any length is measured
whole, in one task.  Other columns are ignored.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.llm.shared import narrow
from rankwell.scratch import staged

_BLANKS = " \t\n\x0b\f\r"
_BLANK_RUN = "[ \\t\\n\\x0b\\f\\r]+"
_SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 2_000
#: How often a rule looks at a row of the sample when it is timed, so that its cost stands above that of a job.
REPEATS = 3


@dataclass(frozen=True)
class Rule:
    """`rejects` must not be null; it may use the columns of `text_statistics` and `text`."""

    name: str
    rejects: Column


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def words_of(text: Column) -> Column:
    """The words of a text: runs of characters other than space and \\t..\\r."""
    inner = F.btrim(text, F.lit(_BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _BLANK_RUN))


def text_statistics(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Words in a 3-word window that occurs twice are found inside the row: windows become 64-bit hashes,
    and only texts that repeat one sort them with their places.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    counted = docs.select(
        "doc_id", text.alias("text"),
        F.transform(words_of(text), lambda x: F.xxhash64(x)).alias("_h"),
        F.length(_without(text, _BLANKS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, _SYMBOLS))).cast("long").alias("n_symbols"),
        F.when(F.contains(text, F.lit("\n")), lines).otherwise(F.array().cast("array<string>")).alias("_l"))
    windows = F.when(F.size("_h") >= 4, F.transform(F.sequence(F.lit(1), F.size("_h") - 2), lambda i: F.xxhash64(
        F.get("_h", i - 1), F.get("_h", i), F.get("_h", i + 1)))).otherwise(F.array().cast("array<long>"))
    counted = counted.select(
        "doc_id", "text", "word_chars", "n_symbols", F.size("_h").cast("long").alias("n_words"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), windows.alias("_w"))
    placed = F.when(F.size(F.array_distinct("_w")) == F.size("_w"), F.lit(None)).otherwise(
        F.sort_array(F.transform("_w", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    counted = counted.withColumn("_p", placed).drop("_w")

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(F.get("_p", a)["h"] == F.get("_p", b)["h"], F.lit(False))

    starts = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("_p") - 1), lambda k: same(k, k + 1) | same(k, k - 1)),
        lambda k: F.get("_p", k)["i"])
    counted = counted.withColumn("_s", F.when(F.col("_p").isNotNull(), starts)).drop("_p")
    covered = F.array_distinct(F.concat("_s", F.transform("_s", lambda i: i + 1), F.transform("_s", lambda i: i + 2)))
    return counted.withColumn("n_repeat_words", F.coalesce(F.size(covered), F.lit(0)).cast("long")).drop("_s")


def default_rules() -> list[Rule]:
    """Rejections of text that is not prose; the thresholds are fixed values."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.size(F.split("text", "\n")), F.lit(1))
    chars = F.greatest(F.length("text"), F.lit(1))
    capitals = chars - F.length(F.regexp_replace("text", "\\p{Lu}", ""))
    letters = chars - F.length(F.regexp_replace("text", "\\p{L}", ""))
    return [
        Rule("symbols", F.col("n_symbols") * 4 > words),
        Rule("word_length", (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 14 * words)),
        Rule("repeated_lines", F.col("n_dup_lines") * 5 > lines * 2),
        Rule("exclamations", (F.length("text") - F.length(_without(F.col("text"), "!?"))) * 2 > words),
        Rule("few_letters", letters * 2 < F.col("word_chars")),
        Rule("capitals", capitals * 2 > letters),
        Rule("few_different_words", F.size(F.array_distinct(words_of(F.col("text")))) * 5 < words),
    ]


def sampled_rows(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most `rows` rows of `docs`, drawn at random from the first partitions that yield enough, as a written table."""
    total = docs.count()
    return staged(docs.sample(fraction=min(1.0, max(4 * rows / max(total, 1), 0.01)), seed=7).limit(rows), "rule-sample")


def rule_order(sample: DataFrame, rules: list[Rule]) -> list[str]:
    """Names of the rules, most rejections per second on `sample` first.

    A rule's cost is its time over the rows of the sample, each taken REPEATS times, beyond that of a pass
    without rules, the least of three; equal rates go by name.
    """
    if len(rules) < 2:
        return [r.name for r in rules]
    often = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def timed(condition: Column) -> tuple[float, int, int]:
        best, hits, drawn = float("inf"), 0, 0
        for _ in range(3):
            start = time.perf_counter()
            hits, drawn = often.agg(F.sum(condition.cast("int")), F.count(condition)).collect()[0]
            best = min(best, time.perf_counter() - start)
        return best, hits or 0, max(1, drawn)

    base, _, _ = timed(F.length("text") < 0)
    rates = []
    for rule in rules:
        cost, hits, drawn = timed(rule.rejects)
        rates.append((-(hits / drawn) / max(cost - base, 1e-4), rule.name))
    return [name for _, name in sorted(rates)]


def cascade(docs: DataFrame, rules: list[Rule], order: list[str] | None = None, sampled: DataFrame | None = None) -> DataFrame:
    """`docs` with `kept`: true if no rule rejects the row.  `order` is estimated on `sampled`, or rows of `docs`, unless given."""
    order = order or rule_order(sampled if sampled is not None else sampled_rows(docs), rules)
    by_name = {r.name: r.rejects for r in rules}
    verdict = None
    for name in order:
        verdict = F.when(by_name[name], False) if verdict is None else verdict.when(by_name[name], False)
    return docs.withColumn("kept", verdict.otherwise(True) if verdict is not None else F.lit(True))


def quality_verdicts(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, the five statistics, base_failed, and kept: false if base_failed, else the cascade's verdict."""
    def measured(rows: DataFrame) -> DataFrame:
        stats = text_statistics(rows)
        return stats.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))

    docs = narrow(docs, {"doc_id": "long", "text": "string"})
    stats = measured(docs)
    ruled = default_rules() if rules is None else rules
    # The sample is drawn first, so that only its rows are measured for it.
    order = rule_order(staged(measured(sampled_rows(docs)), "rule-statistics"), ruled) if len(ruled) > 1 else [r.name for r in ruled]
    ruled = [Rule("base", F.col("base_failed")), *ruled]
    return cascade(stats, ruled, ["base", *order]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_sql(docs: str = "documents") -> str:
    """DuckDB SQL for the rows of `quality_verdicts` with the default rules."""
    return f"""
with t as (select row_number() over () as k, doc_id, coalesce(text, '') as text from {docs}),
w as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words,
        [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] as lines from t),
p as (select k, unnest(generate_series(1, len(words) - 2)) as i, words from w where len(words) >= 4),
g as (select k, i, count(*) over (partition by k, words[i], words[i + 1], words[i + 2]) as n from p),
r as (select k, count(distinct j) as n from (select k, unnest([i, i + 1, i + 2]) as j from g where n > 1) group by k),
s as (select w.k, doc_id, text, words, len(words)::bigint as n_words,
        length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words,
        length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) as capitals,
        length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) as letters,
        length(regexp_replace(text, '[^!?]', '', 'g')) as marks from w left join r on w.k = r.k)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (n_symbols * 4 > n_words or word_chars < 2 * n_words or word_chars > 14 * n_words
    or n_dup_lines * 5 > len(string_split(text, chr(10))) * 2 or marks * 2 > n_words or letters * 2 < word_chars
    or capitals * 2 > letters or len(list_distinct(words)) * 5 < n_words) as kept
from (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s)"""
