"""License scan: ordered signature rules behind a keyword prefilter.

Texts are reduced to lower-case words with one space around each.  Rules are regular expressions over
that form; each names a keyword that a text must hold before the rule is tried, so most texts meet no
rule at all.  Detections are word intervals.  One inside another is dropped (equal ones: the rule of
higher priority stays); of two that overlap without containment the one of lower priority is dropped.

The rules come from a table of licenses and a list of templates.  Everything is DataFrame expressions:
hits are rows (document, rule), the rule table has a few hundred rows whatever the data and is
broadcast, and the suppression is a window over the detections of one text.

Defined cases: null counts as empty; words are runs of a-z, 0-9 and all characters above ASCII.  Equal
rows (doc_id, text) are scanned once; rows that share a doc_id but not the text are scanned apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankwell.llm.shared import narrow, one_of

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Every keyword below holds one of these.
SIGNS = ["licen", "copyright", "reserved", "gpl", "apache", "bsd", "creative commons", "cc by", "cc0", "public domain", "mpl", "cddl",
         "wtfpl", "eupl", "openrail", "warrant", "hereby granted", "redistribution", "proprietary", "confidential"]

# Label, keyword that must occur, names (regular expressions over words), versions.
LICENSES = [
    ("apache", "apache", ["apache(?: software)?(?: license)?"], ["1 0", "1 1", "2 0", "2"]),
    ("gpl", "general public licen", ["(?:gnu )?general public licen[sc]e"], ["1", "1 0", "2", "2 0", "3", "3 0"]),
    ("gpl", "gpl", ["(?:gnu )?gpl"], ["1", "1 0", "2", "2 0", "3", "3 0"]),
    ("lgpl", "general public licen", ["(?:gnu )?(?:lesser|library) general public licen[sc]e"], ["2", "2 0", "2 1", "3", "3 0"]),
    ("lgpl", "lgpl", ["(?:gnu )?lgpl"], ["2", "2 0", "2 1", "3", "3 0"]),
    ("agpl", "affero general public licen", ["(?:gnu )?affero general public licen[sc]e"], ["1", "3", "3 0"]),
    ("agpl", "agpl", ["(?:gnu )?agpl"], ["1", "3", "3 0"]),
    ("mit", "mit licen", ["(?:the )?mit licen[sc]e"], []),
    ("bsd", "bsd", ["bsd licen[sc]e", "(?:new|modified|simplified|revised) bsd"], ["2 clause", "3 clause", "4 clause"]),
    ("cc-by-nc", "cc by nc", ["cc by nc", "creative commons attribution noncommercial"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nd", "cc by nd", ["cc by nd", "creative commons attribution noderivatives"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-sa", "cc by sa", ["cc by sa", "creative commons attribution share ?alike"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-sa", "cc by nc sa", ["cc by nc sa"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-nd", "cc by nc nd", ["cc by nc nd"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by", "cc by", ["cc by"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by", "creative commons", ["creative commons attribution(?: licen[sc]e)?"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc0", "cc0", ["cc0"], ["1 0"]),
    ("public-domain", "public domain", ["public domain(?: dedication)?"], []),
    ("mpl", "mozilla public licen", ["mozilla public licen[sc]e"], ["1 0", "1 1", "2 0"]),
    ("mpl", "mpl", ["mpl"], ["1 0", "1 1", "2 0"]),
    ("epl", "eclipse public licen", ["eclipse public licen[sc]e"], ["1 0", "2 0"]),
    ("cddl", "cddl", ["cddl"], ["1 0", "1 1"]),
    ("cddl", "distribution licen", ["common development and distribution licen[sc]e"], ["1 0", "1 1"]),
    ("isc", "isc licen", ["isc licen[sc]e"], []),
    ("zlib", "licen", ["zlib(?: libpng)? licen[sc]e"], []),
    ("boost", "software licen", ["boost software licen[sc]e"], ["1 0"]),
    ("artistic", "artistic licen", ["(?:perl )?artistic licen[sc]e"], ["1 0", "2 0"]),
    ("unlicense", "unlicense", ["unlicense"], []),
    ("wtfpl", "wtfpl", ["wtfpl"], ["1", "2"]),
    ("eupl", "eupl", ["eupl"], ["1 0", "1 1", "1 2"]),
    ("eupl", "public licen", ["european union public licen[sc]e"], ["1 0", "1 1", "1 2"]),
    ("ofl", "open font licen", ["(?:sil )?open font licen[sc]e"], ["1 0", "1 1"]),
    ("odbl", "open database licen", ["open database licen[sc]e"], ["1 0"]),
    ("gfdl", "documentation licen", ["(?:gnu )?free documentation licen[sc]e"], ["1 1", "1 2", "1 3"]),
    ("psf", "foundation licen", ["python software foundation licen[sc]e"], ["2", "2 0"]),
    ("bsl", "source licen", ["business source licen[sc]e"], ["1 0", "1 1"]),
    ("sspl", "side public licen", ["server side public licen[sc]e"], ["1", "1 0"]),
    ("upl", "permissive licen", ["universal permissive licen[sc]e"], ["1 0"]),
    ("openrail", "openrail", ["(?:creativeml |bigscience )?openrail(?: m)?"], []),
    ("reserved", "all rights reserved", ["all rights reserved"], []),
    ("proprietary", "proprietary", ["proprietary and confidential", "proprietary licen[sc]e"], []),
    ("proprietary", "confidential", ["confidential and proprietary"], []),
    ("copyright", "copyright", ["copyright(?: c)? (?:19|20)[0-9]{2}", "copyright(?: c)? [^ ]+ (?:19|20)[0-9]{2}"], []),
    ("no-warranty", "warrant", ["without warranty of any kind", "without any warranty", "disclaims? all warrant(?:y|ies)"], []),
    ("permission", "permission is hereby granted", ["permission is hereby granted free of charge"], []),
    ("redistribution", "redistribution", ["redistribution and use in source and binary forms"], []),
]

# Forms in which a name ({0}) and a version ({1}) occur, with their priority.
TEMPLATES = [
    (90, "(?:licen[sc]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?{0}(?: version| v)? {1}"),
    (80, "{0}(?: licen[sc]e)? (?:version |v )?{1}(?: or (?:any )?later(?: version)?)?"),
    (85, "{1} {0}"),
    (70, "{0}(?: licen[sc]e)? v{1}"),
    (65, "spdx licen[sc]e identifier {0} {1}(?: only| or later)?"),
]
PLAIN = [
    (60, "(?:licen[sc]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?{0}"),
    (40, "{0}"),
]


def signature_rules() -> list[tuple[int, str, str, int, str]]:
    """(rule, label, keyword, priority, regular expression), in order; a rule matches whole words."""
    rules = []
    for label, keyword, names, versions in LICENSES:
        for name in names:
            for priority, form in PLAIN:
                rules.append((label, keyword, priority, form.format(name)))
            for version in versions:
                for priority, form in TEMPLATES:
                    rules.append((label, keyword, priority + version.count(" "), form.format(name, version)))
    return [(i, label, keyword, priority, f" (?:{form})(?= )") for i, (label, keyword, priority, form) in enumerate(rules)]


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(signature_rules(), "rule int, label string, keyword string, priority int, pattern string")


_GAPS = one_of("".join(chr(c) for c in range(128) if not chr(c).isalnum() or chr(c).isupper())) + "+"
_BASE_ANY = f" (?:{'|'.join(BASE)})(?= )"

def _gate(pad: Column) -> Column:
    """True if a rule's keyword may occur; every keyword holds one of the signs."""
    test = F.lit(False)
    for sign in SIGNS:
        test = test | F.contains(pad, F.lit(sign))
    return test


def _words(x: Column) -> Column:
    """Number of words of a piece in which every word follows one space."""
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of `docs`."""
    return _scan(docs)[0]


def license_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, rule, label, priority): detections that remain, in words from 0, end exclusive."""
    return _scan(docs)[1].drop("key")


def _scan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    # Lower-casing beyond A-Z touches no character of a base phrase and no word boundary.
    low = F.lower(F.coalesce("text", F.lit("")))
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(low, _GAPS, " ")), F.lit(" "))
    # Bound to a name, so that the replacement runs once and not for every sign.
    reduced = F.get(F.transform(F.array(padded), lambda p: F.struct(
        F.when(p == "  ", 0).otherwise(_words(p) - 1).cast("long").alias("n_words"), F.when(_gate(p), p).alias("pad"))), F.lit(0))
    rows = narrow(docs, {"doc_id": "long", "text": "string"}).select("doc_id", reduced.alias("r")).select(
        "doc_id", "r.n_words", "r.pad")
    rows = rows.withColumn("key", F.xxhash64("pad"))
    n_base = F.when(F.col("pad").isNotNull(), F.regexp_count("pad", F.lit(_BASE_ANY))).otherwise(0).cast("long")
    found = [F.when(F.contains("pad", F.lit(f" {p} ")), label) for p, label in BASE.items()]
    rows = rows.withColumn("n_base", n_base)
    has = F.col("n_base") > 0
    rows = rows.select(
        "doc_id", "key", "n_words", "n_base", "pad",
        F.when(has, _words(F.regexp_extract("pad", f"(?s)^(.*?){_BASE_ANY}", 1)).cast("long")).alias("first_word"),
        F.when(has, _words(F.regexp_extract("pad", f"(?s)^(.*){_BASE_ANY}", 1)).cast("long")).alias("last_word"),
        F.when(has, F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull()))).otherwise(
            F.array().cast("array<string>")).alias("base"))
    spans = _suppressed(_detections(rows.where("pad is not null").select("doc_id", "key", "pad")))
    method = spans.groupBy("doc_id", "key").agg(F.collect_set("label").alias("more"), F.max("priority").alias("top"))
    out = rows.drop("pad").join(
        method.withColumnRenamed("doc_id", "_d").withColumnRenamed("key", "_k"),
        F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    strength = F.greatest(F.coalesce(F.col("top"), F.lit(0)), F.when(F.col("n_base") > 0, 50).otherwise(0))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", labels).alias("labels"), (strength / 100.0).alias("score")), spans


def _detections(gated: DataFrame) -> DataFrame:
    """(doc_id, key, start, end, rule, label, priority) of every place where a rule matches."""
    keywords = sorted({k for _, k, _, _ in LICENSES})
    present = F.filter(F.array(*[F.when(F.contains("pad", F.lit(k)), k) for k in keywords]), lambda x: x.isNotNull())
    hits = gated.select("doc_id", "key", "pad", F.explode(present).alias("keyword"))
    tried = hits.join(F.broadcast(rule_table(gated.sparkSession)), "keyword")
    tried = tried.withColumn("hit", F.regexp_extract_all("pad", F.col("pattern"), F.lit(0))).where("size(hit) > 0")
    tried = tried.withColumn("part", F.split("pad", F.col("pattern"), -1))
    sizes = tried.select(
        "doc_id", "key", "rule", "label", "priority",
        F.transform("hit", _words).alias("own"), F.transform("part", _words).alias("gap"))
    # Match k starts after the gaps up to k and the matches before k.
    starts = F.aggregate(
        F.arrays_zip("gap", "own"), F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.coalesce(x["own"], F.lit(0))).alias("at"),
            F.when(x["own"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], F.struct(
                (acc["at"] + x["gap"]).alias("s"), (acc["at"] + x["gap"] + x["own"]).alias("e")))).alias("out")),
        lambda acc: acc["out"])
    return sizes.select("doc_id", "key", "rule", "label", "priority", F.explode(starts).alias("x")).select(
        "doc_id", "key", F.col("x.s").cast("long").alias("start"), F.col("x.e").cast("long").alias("end"),
        "rule", "label", "priority").distinct()


def _suppressed(spans: DataFrame) -> DataFrame:
    """Without detections inside others, then without those that overlap a neighbour of higher priority."""
    part = Window.partitionBy("doc_id", "key")
    order = part.orderBy("start", F.desc("end"), F.desc("priority"), "rule")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    outer = spans.withColumn("_reach", reach).where("_reach is null or _reach < end").drop("_reach")
    # What is left has rising starts and ends, so only neighbours can overlap.
    order = part.orderBy("start")
    outer = outer.withColumn("_b", F.lag(F.struct("end", "priority")).over(order)).withColumn(
        "_a", F.lead(F.struct("start", "priority")).over(order))
    beaten = ((F.col("_b.end") > F.col("start")) & (F.col("_b.priority") >= F.col("priority"))) | (
        (F.col("_a.start") < F.col("end")) & (F.col("_a.priority") > F.col("priority")))
    return outer.where(~F.coalesce(beaten, F.lit(False))).drop("_a", "_b")
