"""Mixing sources to target weights by pivotal dependent rounding.

A source with target T and size S wants every document T / S times.  The whole part is taken; the
fractions are rounded so that the words taken stay put: two documents with open fractions p and q and
sizes s and t exchange words until one of them is 0 or 1, the direction drawn so that every expectation
holds.  Documents are paired inside blocks, each block leaves at most one open document, and these meet
in blocks again: a reduction tree with one level per factor of BLOCK.  One open document per source is
left in the end and is rounded by a draw, so a source misses its target by less than that document.

Draws are hashes of the ids and the level, so reruns and repeated tasks agree.  Everything is DataFrame
expressions.

Defined cases: null texts have size 0; documents of size 0 take nothing and are not counted as copies.
Identical rows (doc_id, source, text) are rounded as one unit of several, and the copies are dealt out
among them, so a group of equal rows stays one row until the end.  Sources are ordered by code point, a
null source last.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankwell.llm.shared import narrow
from rankwell.scratch import staged

#: Open documents that one aggregate call pairs with each other.
BLOCK = 48
_OPEN = "array<struct<unit:bigint,p:double>>"


def word_count(text: Column) -> Column:
    inner = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.coalesce(inner, F.lit("")) == "", 0).otherwise(F.size(F.split(inner, "[ \\t\\n\\x0b\\f\\r]+"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) for `sizes` (source, source_size), one row per source.

    Targets share the total by weight, weights repeating over the sources in order.  No target exceeds
    `most` times its source; the excess is shared again by weight, which is the level L at which the sum
    of min(most * size, L * weight) is the total.  Sources reach their cap in the order of size / weight.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(w) for w in weights])
    w = sizes.withColumn("weight", F.get(cycle, ((F.row_number().over(order) - 1) % len(weights)).cast("int")).cast("double"))
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    w = w.withColumn("cap", most * F.col("source_size").cast("double")).withColumn(
        "total", F.sum("source_size").over(everything).cast("double")).withColumn(
        "above", F.sum("weight").over(everything))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.col("above") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # The first source, by cap per weight, that its level does not push above its cap fixes the level.
    fits = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)
    return w.withColumn("fit", fits["level"]).select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("fit") * F.col("weight"), F.col("cap"))).alias("target"))


def _draw(level: Column, a: Column, b: Column) -> Column:
    """A number in [0, 1) fixed by the arguments."""
    return F.pmod(F.xxhash64(level, a, b), F.lit(1 << 52)) / float(1 << 52)


def _paired(level: int) -> Column:
    """Fold the open documents `docs` (unit, size, p) of a block: closed ones, and the open one that is left."""
    start = F.struct(
        F.lit(None).cast("long").alias("unit"), F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("p"),
        F.array().cast(_OPEN).alias("closed"))

    def step(acc: Column, x: Column) -> Column:
        # In words: room up and down for either side, then one of the two moves that end at a bound.
        a, b = acc["p"] * acc["size"], x["p"] * x["size"]
        up = F.least(acc["size"] - a, b)  # words that the open one can take over
        down = F.least(a, x["size"] - b)  # words that it can give
        rise = _draw(F.lit(level), acc["unit"], x["unit"]) * (up + down) < down
        moved = F.when(rise, up).otherwise(-down)
        # Which side reached a bound is told by the move that was limiting, not by comparing sums.
        own_end = F.when(rise, acc["size"] - a <= b).otherwise(a <= x["size"] - b)
        own, other = (a + moved) / acc["size"], (b - moved) / x["size"]
        closed_own = F.struct(acc["unit"].alias("unit"), F.when(rise, 1.0).otherwise(0.0).alias("p"))
        closed_other = F.struct(x["unit"].alias("unit"), F.when(rise, 0.0).otherwise(1.0).alias("p"))
        left_own = F.struct(acc["unit"].alias("unit"), acc["size"].alias("size"), own.alias("p"),
                            F.array_append(acc["closed"], closed_other).alias("closed"))
        left_other = F.struct(x["unit"].alias("unit"), x["size"].alias("size"), other.alias("p"),
                              F.array_append(acc["closed"], closed_own).alias("closed"))
        first = F.struct(x["unit"].alias("unit"), x["size"].alias("size"), x["p"].alias("p"), acc["closed"].alias("closed"))
        return F.when(acc["unit"].isNull(), first).when(own_end, left_other).otherwise(left_own)

    return F.aggregate("docs", start, step)


def pivotal_rounding(units: DataFrame) -> DataFrame:
    """(unit, up) with up 0 or 1 for `units` (unit, grp, size, p, n): open fractions p, n of them in the group.

    `unit` is unique.  Each level deals the open units of a group to blocks by their hash and sorts a
    block by size, largest first: units of similar size meet, and what stays open tends to be small.  Closed
    ones are written, open ones go on.
    """
    closed: list[DataFrame] = []
    level = 0
    units = staged(units.select("unit", "grp", "size", "p", "n"), "open")
    while True:
        most = units.agg(F.max("n").alias("n")).collect()[0]["n"]
        if most is None:
            break
        if most <= 1:
            closed.append(units.select("unit", (_draw(F.lit(-1), F.col("unit"), F.lit(0)) < F.col("p")).cast("long").alias("up")))
            break
        blocks = F.ceil(F.col("n") / BLOCK).cast("long")
        dealt = units.withColumn("block", F.pmod(F.xxhash64(F.lit(level), "unit"), blocks)).groupBy("grp", "block").agg(
            F.sort_array(F.collect_list(F.struct("size", "unit", "p")), asc=False).alias("docs"), F.max(blocks).alias("n"))
        done = staged(dealt.select("grp", "n", _paired(level).alias("r")), f"level{level}")
        closed.append(done.select(F.explode("r.closed").alias("c")).select("c.unit", F.col("c.p").cast("long").alias("up")))
        units = done.select("r.unit", "grp", "r.size", "r.p", "n")
        level += 1
    if not closed:
        return units.select("unit", F.lit(0).cast("long").alias("up"))
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3,
                carry: list[str] | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row of `docs` (doc_id, source, text).

    `carry` names further columns to return: rows are then numbered among their equals by all of them.
    """
    carry = carry or []
    columns = {"doc_id": "long", "source": "string", "text": "string"}
    rows = narrow(docs, columns | {c: t for c, t in docs.dtypes if c in carry and c not in columns})
    kept = [c for c in rows.columns if c != "text" or "text" in carry]
    # Equal rows become one with their number; an id that comes with several texts stays several.
    sized = rows.select(*kept, word_count(F.col("text")).alias("size"),
                        F.xxhash64("doc_id", "source", "text").alias("unit")).groupBy(
        *kept, "size", "unit").agg(F.count("*").alias("times"))
    sized = staged(sized, "sizes")
    # Different rows with one 64-bit key would be rounded together; then the key's rows are simply summed.
    sizes = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"))
    targets = staged(source_targets(sizes, weights, most).withColumn("grp", F.xxhash64("source")), "targets")
    units = sized.where("size > 0").groupBy("unit", "source").agg(F.max("size").alias("size"), F.sum("times").alias("times"))
    wanted = units.join(targets, units["source"].eqNullSafe(targets["source"])).select(
        "unit", "grp", "size", "times",
        (F.col("times") * F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).alias("rate"))
    whole = F.floor(F.col("rate") + 1e-9)
    wanted = staged(wanted.select("unit", "grp", "size", "times", whole.cast("long").alias("whole"),
                                  F.greatest(F.col("rate") - whole, F.lit(0.0)).alias("p")), "wanted")
    open_units = wanted.where("p > 1e-9")
    open_units = open_units.join(open_units.groupBy("grp").agg(F.count("*").alias("n")), "grp")
    up = pivotal_rounding(open_units)
    copies = wanted.join(up, "unit", "left").select(
        "unit", F.col("times").alias("all_times"), (F.col("whole") + F.coalesce("up", F.lit(0))).alias("copies"))
    dealt = sized.join(copies, "unit", "left").join(
        F.broadcast(targets) if targets.count() <= 10_000 else targets, sized["source"].eqNullSafe(targets["source"])).select(
        *[sized[c] for c in kept], "size", "source_size", "target", "copies", "all_times", "times")
    # Row j of m equal ones gets its share of the unit's copies.
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    share = F.coalesce(F.floor(F.col("copies") / F.col("all_times")) + (
        F.col("j") <= F.col("copies") % F.col("all_times")).cast("long"), F.lit(0)).cast("long")
    return dealt.select(*kept, "size", "source_size", "target", share.alias("copies"),
                        (share * F.col("size")).alias("taken"))
