"""Benchmark decontamination on templates: numbers, names and units become typed placeholders.

A text is turned into tokens; a number, a unit after a number, and a word inside a sentence
that starts with a capital A-Z keep their value but count as a placeholder of their type.  Windows of `n` template tokens are hashed and
joined with the windows of the benchmark.  A document that holds at least `percent` of an item's windows
is a candidate; on the alignment with the most windows, or at any other place with `percent` of the windows,
the values behind the placeholders must map one to one (equal values to equal values), which tells a
re-parameterised question from a chance template.

Everything is DataFrame expressions.  Windows of the benchmark are broadcast only up to a checked number
of rows; beyond it the join shuffles.  Documents are read a second time only for the candidates.

Items that have no window, or so few that one more or less decides, are found by their exact tokens as well,
whatever stands between the tokens; such a row has the item's windows (1 if it has none) as `n_windows` and `n_found`.

Defined cases: windows with fewer than `literal` plain tokens say nothing and are left out on both sides;
an item of one word is in every document with that word; null and empty texts match nothing.  Rows that share a doc_id
are one document; rows without one are never reported and never removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.llm.shared import narrow, one_of
from rankwell.scratch import staged

#: Rows of benchmark windows (20 bytes each) up to which they are broadcast.
BROADCAST_WINDOWS = 500_000
#: Units that count as one after a number.
UNITS = ["mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "ms", "min", "h", "hours", "minutes", "seconds", "days",
         "years", "metres", "meters", "miles", "feet", "inches", "pounds", "ounces", "grams", "kilograms", "litres", "liters",
         "dollars", "euros", "cents", "percent", "degrees", "mph", "kmh", "hz", "kb", "mb", "gb", "tb"]
# Characters that end a sentence, and the other ASCII characters between words.
_MARKS = [".", "!", "?", ":", "\n"]
_GAP = "".join(map(chr, range(33))).replace("\n", "") + "\"#$%&'()*+,-/;<=>@[\\]^_`{|}~"
_CAPITALS, _SMALL, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_NAME, _NUMBER, _UNIT = "\x01", "\x02", "\x03"
#: Holds wherever a text has a number or a capital (A-Z) inside a sentence; other texts have no slot.
_HAS_SLOT = (one_of(_DIGITS) + "|" + one_of(".!?:" + "".join(map(chr, range(33))), True)
             + one_of(".!?:\n" + _CAPITALS + _SMALL, True) + "+" + one_of(_CAPITALS))


def has_slot(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(_HAS_SLOT)), F.lit(False))


def template_tokens(text: Column) -> Column:
    """Lower-cased tokens; a slot's value stands behind one of three control characters, its type.

    Texts without a slot, which are most, are cut at everything that is no word.
    """
    text = F.coalesce(text, F.lit(""))
    marks = ["", *_MARKS]

    def typed(raw: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            before = F.get(raw, i - 1)
            low, first = F.lower(t), F.substring(t, 1, 1)
            name = first.between("A", "Z") & (i > 0) & ~before.isin(*marks) & ~F.substring(t, 2, 1).between("A", "Z")
            return (
                F.when(t.isin(*marks), "")
                .when(first.between("0", "9"), F.concat(F.lit(_NUMBER), t))
                .when(name, F.concat(F.lit(_NAME), low))
                .when(F.substring(before, 1, 1).between("0", "9") & low.isin(*UNITS), F.concat(F.lit(_UNIT), low))
                .otherwise(low))
        return F.transform(raw, one)

    raw = F.split(text, f"{one_of(_GAP)}+|(?<=[.!?:\\n])|(?=[.!?:\\n])")
    # The array is bound to a name once, so that the look back does not cut the text again.
    with_slots = F.get(F.transform(F.array(raw), typed), F.lit(0))
    plain = F.split(F.lower(text), one_of(_GAP + ".!?:\n") + "+")
    return F.filter(F.when(has_slot(text), with_slots).otherwise(plain), lambda x: x != "")


def template_windows(tokens: DataFrame, n: int, literal: int, *keys: str, values: bool = False) -> DataFrame:
    """(keys, at, window): hashes of the windows of `tokens` with enough plain tokens; with `values` their tokens as `seen`."""
    slots = F.exists("tokens", lambda x: x < "\x04")
    marks = tokens.select(
        *keys, F.transform("tokens", lambda x: F.xxhash64(F.when(x < "\x04", F.substring(x, 1, 1)).otherwise(x))).alias("h"),
        F.when(slots, F.transform("tokens", lambda x: (x >= "\x04").cast("int"))).alias("plain"),
        *["tokens"] * values)

    def window(i: Column) -> Column:
        return F.xxhash64(*[F.get("h", i + k) for k in range(n)])

    def checked(i: Column) -> Column:
        enough = sum((F.get("plain", i + k) for k in range(1, n)), F.get("plain", i)) >= literal
        return F.when(enough, window(i))

    places = F.sequence(F.lit(0), F.size("h") - n)
    windows = F.when(F.size("h") < n, F.lit(None)).when(F.col("plain").isNull(), F.transform(places, window)).otherwise(
        F.transform(places, checked))
    if values:
        windows = F.transform(windows, lambda w, i: F.struct(w.alias("window"), F.slice("tokens", i + 1, n).alias("seen")))
        return marks.select(*keys, F.posexplode(windows).alias("at", "w")).select(*keys, "at", "w.*").where("window is not null")
    return marks.select(*keys, F.posexplode(windows).alias("at", "window")).where("window is not null")


def _one_to_one(pairs: Column) -> Column:
    """Whether equal values stand for equal values, both ways, in an array of (a, b)."""
    a, b = F.transform(pairs, lambda s: s["a"]), F.transform(pairs, lambda s: s["b"])
    different = F.size(F.array_distinct(F.arrays_zip(a.alias("a"), b.alias("b"))))
    return (different == F.size(F.array_distinct(a))) & (different == F.size(F.array_distinct(b)))


def _consistent_occurrences(texts: DataFrame, items: DataFrame, wanted: DataFrame, left: DataFrame, n: int, percent: int, literal: int
                            ) -> DataFrame:
    """(doc_id, item_id, n_windows, n_found, slots): rows of `left` with an occurrence whose values map one to one.

    Every shift at which a window of the item stands is the middle of an occurrence: each of the item's
    windows is taken at its nearest place, less than the item's length away, so that words put in or left
    out do not end it.  Values are compared in the windows taken.
    """
    key = ["doc_id", "doc_text", "item_id", "item_text"]
    searched = left.join(items, ["item_id", "item_text"]).select(*left.columns, "tokens", F.size("tokens").alias("width")).join(
        wanted, ["item_id", "item_text"]).select(*left.columns, "width", "item_at", "window", F.slice("tokens", F.col("item_at") + 1, n).alias("asked"))
    texts = texts.join(left.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("doc_text", F.xxhash64("tokens"))
    pairs = F.filter(
        F.transform("asked", lambda a, i: F.struct((F.col("item_at") + i).alias("i"), a.alias("a"), F.get("seen", i).alias("b"))),
        lambda s: s["a"] < "\x04")
    places = template_windows(texts, n, literal, "doc_id", "doc_text", values=True).join(searched, ["doc_id", "window"])
    places = staged(places.select(
        *key, "n_windows", "n_found", "width", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), pairs.alias("pairs")).distinct(), "places")
    stretch = F.floor(F.col("shift") / F.col("width"))
    middles = places.select(*key, "shift", F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch")).distinct().withColumnRenamed(
        "shift", "middle")
    away = F.abs(F.col("shift") - F.col("middle"))
    taken = places.withColumn("stretch", stretch).join(middles, [*key, "stretch"]).where(away < F.col("width")).groupBy(
        *key, "n_windows", "n_found", "middle", "item_at").agg(F.min(F.struct(away, "shift", "pairs"))["pairs"].alias("pairs"))
    whole = taken.groupBy(*key, "n_windows", "n_found", "middle").agg(F.count("*").alias("k"), F.flatten(F.collect_list("pairs")).alias("pairs"))
    return whole.where(f"100 * k >= {percent} * n_windows").where(_one_to_one(F.col("pairs"))).groupBy("doc_id", "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.max("n_found").alias("n_found"),
        F.max(F.size(F.array_distinct("pairs.i"))).cast("long").alias("slots"))


def _literal(tokens: Column) -> Column:
    """Tokens without the marks of their types."""
    return F.transform(tokens, lambda x: F.when(x < "\x04", F.substring(x, 2, (1 << 31) - 1)).otherwise(x))


def _exact_copies(docs: DataFrame, items: DataFrame, sizes: DataFrame, n: int, percent: int) -> DataFrame | None:
    """(doc_id, item_id, n_windows, n_found, slots): exact places of the items that would be lost with one window.

    Documents that hold the first tokens of such an item (at most `n`) are read again and searched for all of
    them.  None if there is no such item.
    """
    few = items.join(sizes, ["item_id", "item_text"], "left").where(F.size("tokens") > 0).where(
        f"n_windows is null or 100 * (n_windows - 1) < {percent} * n_windows")
    few = staged(few.select(
        "item_id", "item_text", F.coalesce("n_windows", F.lit(1)).cast("long").alias("n_windows"), _literal(F.col("tokens")).alias("asked"),
        F.size(F.filter("tokens", lambda x: x < "\x04")).cast("long").alias("slots")), "few")
    lengths = sorted(r["k"] for r in few.select(F.least(F.size("asked"), F.lit(n)).alias("k")).distinct().collect())
    if not lengths:
        return None
    heads = few.select("item_id", "item_text", F.xxhash64(F.slice("asked", 1, n)).alias("head"))
    heads = F.broadcast(heads) if few.count() <= BROADCAST_WINDOWS else heads
    tokens = docs.select("doc_id", _literal(template_tokens(F.col("text"))).alias("tokens"))

    def windows(k: int) -> Column:
        places = F.when(F.size("tokens") >= k, F.sequence(F.lit(1), F.size("tokens") - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(F.slice("tokens", i, k)))

    found = tokens.select("doc_id", F.explode(F.array_distinct(F.concat(*map(windows, lengths)))).alias("head")).join(heads, "head").select(
        "doc_id", "item_id", "item_text").distinct()
    found = staged(found, "heads")
    ids = found.select("doc_id").distinct()

    def joined(tokens: Column) -> Column:
        return F.concat(F.lit("\x00"), F.array_join(tokens, "\x00"), F.lit("\x00"))

    texts = docs.join(ids, "doc_id", "left_semi").select("doc_id", joined(_literal(template_tokens(F.col("text")))).alias("held"))
    asked = few.withColumn("asked", joined(F.col("asked")))
    return found.join(asked, ["item_id", "item_text"]).join(texts, "doc_id").where(F.contains("held", "asked")).select(
        "doc_id", "item_id", "n_windows", F.col("n_windows").alias("n_found"), "slots")


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 5, percent: int = 80, literal: int = 3) -> DataFrame:
    """(doc_id, item_id, n_windows, n_found, slots): documents that hold an item, with its values free.

    `slots` is the number of placeholders compared on the best alignment, or at the place that fits.
    """
    docs = narrow(docs, {"doc_id": "long", "text": "string"}).where("doc_id is not null")
    items = narrow(benchmark, {"item_id": "long", "text": "string"}).where("item_id is not null").distinct()
    # Items may repeat an id with another text; each text is searched by itself.
    items = items.select("item_id", F.xxhash64("text").alias("item_text"), template_tokens(F.col("text")).alias("tokens"))
    items = staged(items, "items")
    wanted = staged(template_windows(items, n, literal, "item_id", "item_text").withColumnRenamed("at", "item_at"), "wanted")
    sizes = wanted.groupBy("item_id", "item_text").agg(F.count("*").alias("n_windows"))
    look_up = F.broadcast(wanted) if wanted.count() <= BROADCAST_WINDOWS else wanted
    tokens = docs.select("doc_id", template_tokens(F.col("text")).alias("tokens"))
    found = template_windows(tokens, n, literal, "doc_id").join(look_up, "window")
    shifts = found.groupBy("doc_id", "item_id", "item_text", "item_at").agg(
        F.min(F.col("at") - F.col("item_at")).alias("shift"))
    shifts = shifts.groupBy("doc_id", "item_id", "item_text", "shift").agg(F.count("*").alias("k"))
    best = shifts.groupBy("doc_id", "item_id", "item_text").agg(
        F.sum("k").alias("n_found"), F.max(F.struct("k", -F.col("shift"))).alias("_b"))
    candidates = staged(
        best.join(sizes, ["item_id", "item_text"]).where(f"100 * n_found >= {percent} * n_windows").select(
            "doc_id", "item_id", "item_text", "n_windows", "n_found", (-F.col("_b.col2")).alias("shift")), "candidates")
    # Only the texts of candidates are read again; their ids (8 bytes each) are broadcast up to a checked number.
    ids = candidates.select("doc_id").distinct()
    ids = F.broadcast(ids) if candidates.count() <= BROADCAST_WINDOWS else ids
    texts = staged(docs.join(ids, "doc_id", "left_semi").select(
        "doc_id", template_tokens(F.col("text")).alias("tokens")), "texts")
    aligned = candidates.join(items.withColumnRenamed("tokens", "asked"), ["item_id", "item_text"]).join(texts, "doc_id")
    pairs = F.filter(
        F.transform("asked", lambda a, i: F.struct(a.alias("a"), F.get("tokens", i + F.col("shift").cast("int")).alias("b"))),
        lambda s: (s["a"] < "\x04") & (s["b"] < "\x04") & (F.substring(s["a"], 1, 1) == F.substring(s["b"], 1, 1)))
    aligned = aligned.withColumn("pairs", F.when(F.col("shift") >= -F.size("asked"), pairs))
    tested = staged(aligned.select(
        "doc_id", "item_id", "item_text", "n_windows", "n_found", F.size("pairs").cast("long").alias("slots"),
        F.coalesce(_one_to_one(F.col("pairs")), F.lit(False)).alias("fits")), "tested")
    reported = tested.where("fits").groupBy("doc_id", "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.max("n_found").alias("n_found"), F.max("slots").alias("slots"))
    # Where the best alignment does not fit, every other place is tried.
    left = tested.join(reported.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti").select(
        "doc_id", "item_id", "item_text", "n_windows", "n_found").distinct()
    if not left.isEmpty():
        reported = reported.unionByName(_consistent_occurrences(texts, items, wanted, left, n, percent, literal))
    copies = _exact_copies(docs, items, sizes, n, percent)
    if copies is not None:
        reported = reported.unionByName(copies).groupBy("doc_id", "item_id").agg(
            *[F.max(c).alias(c) for c in ("n_windows", "n_found", "slots")])
    return reported


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """The rows of `docs` that hold no benchmark item."""
    hit = staged(contaminated(docs, benchmark, **options).select("doc_id").distinct(), "hit")
    return docs.join(hit, "doc_id", "left_anti").select(docs.columns)


def contaminated_sql(n: int = 5, percent: int = 80, literal: int = 3) -> str:
    """DuckDB SQL for the rows of `contaminated`."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    mark = "('', '.', '!', '?', ':', chr(10))"

    def tokens(table: str, key: str) -> str:
        return f"""{key}_raw as (select {key}, text, string_split_regex(regexp_replace(coalesce(text, ''), '([.!?:\\n])', ' \\1 ', 'g'),
          '{one_of(_GAP)}+') as r from (select distinct {key}, text from {table} where {key} is not null)),
        {key}_one as (select {key}, text, unnest(r) as t, unnest(list_concat([null], r)[1:len(r)]) as b,
          unnest(generate_series(1, len(r))) as i from {key}_raw),
        {key}_typed as (select {key}, text, i, case when t in {mark} then null
          when t[1] between '0' and '9' then chr(2) || t
          when t[1] between 'A' and 'Z' and i > 1 and t[2] not between 'A' and 'Z' and b not in {mark} then chr(1) || lower(t)
          when b[1] between '0' and '9' and lower(t) in ({units}) then chr(3) || lower(t) else lower(t) end as w from {key}_one),
        {key}_tok as (select {key}, text, w, row_number() over (partition by {key}, text order by i) as i from {key}_typed where w is not null),
        {key}_win as (select * from (select {key}, text, i, count(*) over o as c, list(case when w < chr(4) then w[1] else w end) over o as g,
          sum((w >= chr(4))::int) over o as p from {key}_tok
          window o as (partition by {key}, text order by i rows between current row and {n - 1} following)) where c = {n} and p >= {literal})"""

    return f"""
with {tokens('documents', 'doc_id')}, {tokens('benchmark', 'item_id')},
sizes as (select item_id, text, count(*) as n_windows from item_id_win group by all),
found as (select d.doc_id, b.item_id, b.text, b.i as item_at, min(d.i - b.i) as shift
  from doc_id_win d join item_id_win b on d.g = b.g group by all),
shifts as (select doc_id, item_id, text, shift, count(*) as k from found group by all),
best as (select doc_id, item_id, text, sum(k) as n_found, arg_max(shift, k * 1000000000 - shift) as shift from shifts group by all),
cand as (select best.*, n_windows from best join sizes using (item_id, text) where 100 * n_found >= {percent} * n_windows),
slots as (select c.doc_id, c.item_id, c.text, d.text as doc_text, a.w as a, d.w as b from cand c
  join item_id_tok a on a.item_id = c.item_id and a.text = c.text
  join doc_id_tok d on d.doc_id = c.doc_id and d.i = a.i + c.shift
  where a.w < chr(4) and d.w < chr(4) and a.w[1] = d.w[1]),
bad as (select doc_id, item_id, text, doc_text, count(*) as n, count(distinct (a, b)) as ab, count(distinct a) as aa, count(distinct b) as bb
  from slots group by all)
select c.doc_id, c.item_id, max(n_windows)::bigint as n_windows, max(n_found)::bigint as n_found, max(coalesce(n, 0))::bigint as slots
from cand c left join bad s on s.doc_id = c.doc_id and s.item_id = c.item_id and s.text = c.text
where coalesce(ab, 0) = coalesce(aa, 0) and coalesce(ab, 0) = coalesce(bb, 0) group by all"""
