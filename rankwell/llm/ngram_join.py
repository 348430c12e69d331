"""Jaccard join of documents on word n-grams through a token-group matrix.

The tokens are 64-bit hashes of the distinct n-grams of a document.  Similar documents are put in
groups, the matrix holds for every group the union of the tokens its members are indexed under, and a
group is opened for another one only if the overlap of their unions allows a link.

1. Tokens in more than `often` documents are found by counting all tokens.  A global order puts them
   last; within a class the hash decides.  Two sets whose Jaccard similarity reaches t share a token
   among the first n - ceil(t n) + 1 of each, under any such order, so those tokens are the index.
2. Equal sets become one node.  Nodes that agree in a pair of minima under two scrambled orders are
   compared with the smallest node of their bucket (one comparison per node and band); components of
   the links found are the groups.  Groups only save work: any partition gives the same result.
3. The matrix has a row (token, group) per indexed token.  The place of a shared token in the order bounds
   the overlap of any member of the one group with the other; where no shared token leaves room for a
   link, the groups stay closed to each other.  The nodes of groups left open stand in blocks of 64, and
   pairs of blocks are counted by products of bits, which bounds the overlap of every pair of nodes
   again; pairs that stay are compared on all tokens.
4. Components of all links are the classes.  A pair inside one group is already connected and is
   never compared again, so a group of thousands of near copies costs its size, not its square.

Defined cases: lower-case A-Z only; words are runs of bytes other than space and \\t..\\r; a text with
fewer than n words is one token, its whole sequence; an empty or null text has no token and no link.
Rows with the same doc_id count as one document.  A row without doc_id is returned with a null class.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.components import components
from rankwell.llm.shared import chunks, cut, mix, narrow, utf8, word_hashes
from rankwell.scratch import staged

#: Most tokens of the list of frequent tokens (8 bytes each), which every task gets; fewer if fewer are frequent.
HOT_LIMIT = 500_000
#: Bits of the filter of wanted documents that every task gets (8 MB); a full filter only costs time.
FILTER_BITS = 1 << 26
_BANDS = 4


def token_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct tokens) of every text."""
    weights = mix(np.arange(1, n + 1, dtype=np.uint64))
    for first, end, data, starts in chunks(column):
        words, before = word_hashes(data, starts)
        count = len(words)
        grams = np.zeros(max(0, count - n + 1), np.uint64)
        for k in range(n):
            grams += mix(words[k:count - n + 1 + k] ^ weights[k])
        grams = mix(grams)
        for row in range(first, end):
            low, high = int(before[row - first]), int(before[row - first + 1])
            if high - low >= n:
                yield row, np.unique(grams[low:high - n + 1])
            elif high > low:
                own = words[low:high]
                yield row, mix(np.add.reduce(mix(own ^ weights[:len(own)]), keepdims=True) + np.uint64(len(own)))
            else:
                yield row, np.zeros(0, np.uint64)


def index_length(n: int, percent: int) -> int:
    """How many first tokens of a set of n go to the index."""
    return n - (percent * n + 99) // 100 + 1


def _frequent_tokens(docs: DataFrame, n: int, often: int, rows: int) -> np.ndarray:
    """Leading bits of the most frequent tokens among those that occur in more than `often` documents.

    Every task sorts its tokens and sends 32 bits of each, packed per bucket of the leading bits, so
    all tokens are counted at four bytes a token and without a row per token.
    """
    bits = min(18, max(5, (rows // 4096).bit_length()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            tokens = np.sort(np.concatenate(held) >> np.uint64(32 - bits))
            bucket = (tokens >> np.uint64(32)).astype(np.int32)
            tails = tokens.astype(np.uint32)
            edges = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(edges[1:], len(bucket))
            return cut(None, {"bucket": bucket[edges], "tails": pa.array(
                [tails[a:b].tobytes() for a, b in zip(edges, ends)], pa.binary())})

        for batch in batches:
            for _, tokens in token_sets(batch.column(0), n):
                if len(tokens):
                    held.append(tokens)
                    size += len(tokens)
                if size > 1_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def count(group: pa.Table) -> pa.Table:
        tails = np.sort(np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group.column("tails")]))
        edges = np.flatnonzero(np.diff(tails.astype(np.int64), prepend=-1))
        times = np.diff(np.append(edges, len(tails)))
        many = times > often
        head = np.int64(group.column("bucket")[0].as_py()) << np.int64(32)
        return pa.table({"token": head | tails[edges[many]].astype(np.int64), "n": times[many].astype(np.int64)})

    packed = docs.select("text").mapInArrow(pack, "bucket int, tails binary")
    frequent = packed.groupBy("bucket").applyInArrow(count, "token long, n long")
    found = frequent.orderBy(F.desc("n"), "token").limit(HOT_LIMIT).select("token").toArrow()
    leading = np.sort(found.column("token").to_numpy().astype(np.uint64))
    return np.concatenate((np.array([bits], np.uint64), leading))


def _is_frequent(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if len(frequent) < 2:
        return np.zeros(len(tokens), bool)
    leading = tokens >> np.uint64(32 - int(frequent[0]))
    at = np.searchsorted(frequent[1:], leading)
    return frequent[1:][np.minimum(at, len(frequent) - 2)] == leading


def token_index(docs: DataFrame, n: int, percent: int, often: int) -> DataFrame:
    """Per document: set size, 128-bit digest of the set, band keys, the indexed tokens in the
    global order, and how many of them (the first ones) are not frequent."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent_tokens(docs, n, often, docs.count()))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_list = frequent.value
        salts = mix(np.arange(11, 11 + 2 * _BANDS, dtype=np.uint64))
        for batch in batches:
            ids = batch.column("doc_id")
            out: list[tuple] = []
            rows: list[int] = []
            held = 0
            for row, tokens in token_sets(batch.column("text"), n):
                size = len(tokens)
                if size:
                    hot = _is_frequent(tokens, hot_list)
                    first = np.concatenate((tokens[~hot], tokens[hot]))[:index_length(size, percent)]
                    low = [(mix(tokens ^ s)).min() for s in salts]
                    bands = mix(np.array(low[::2]) + mix(np.array(low[1::2]))).astype(np.int64)
                    sums = [int(np.add.reduce(mix(tokens + np.uint64(k))).astype(np.int64)) for k in (1, 2)]
                    out.append((size, *sums, bands.tolist(), first.tobytes(), min(len(first), int((~hot).sum()))))
                    held += len(first)
                else:
                    out.append((0, 0, 0, [], b"", 0))
                rows.append(row)
                if held > 200_000:
                    yield _index_batch(ids, rows, out)
                    out, rows, held = [], [], 0
            if rows:
                yield _index_batch(ids, rows, out)

    return docs.select("doc_id", "text").mapInArrow(
        index, "doc_id long, n int, d1 long, d2 long, bands array<long>, first binary, cold int")


def _index_batch(ids: pa.Array, rows: list[int], out: list[tuple]) -> pa.RecordBatch:
    n, d1, d2, bands, first, cold = zip(*out)
    return pa.RecordBatch.from_arrays(
        [pc.take(ids, pa.array(rows)), pa.array(n, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
         pa.array(bands, pa.list_(pa.int64())), pa.array(first, pa.binary()), pa.array(cold, pa.int32())],
        names=["doc_id", "n", "d1", "d2", "bands", "first", "cold"])


def linked_pairs(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of `pairs` (a, b: document ids) whose whole token sets reach the similarity.

    The texts are not shuffled: a filter of the wanted ids with a fixed number of bits goes to the tasks
    that read them, and only the token sets of documents that pass it are joined with the pairs.
    """
    spark = docs.sparkSession
    pairs = staged(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    # The bitmap functions count from 1.
    marks = wanted.select((bit + 1).alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 8 + 8192, np.uint8)
    for bucket, bits in zip(marks.column("bucket").to_pylist(), marks.column("bits").to_pylist()):
        bitmap[(bucket - 1) * 4096:(bucket - 1) * 4096 + len(bits)] = np.frombuffer(bits, np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = batch.column("bit").to_numpy()
            # Bit b of a bitmap stands in byte b // 8, lowest first.
            keep = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            for low in range(0, len(keep), 128):
                part = batch.take(pa.array(keep[low:low + 128]))
                found = [x.tobytes() for _, x in token_sets(part.column("text"), n)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "tokens"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate((x, y)))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(both) - same) > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    tokens = staged(docs.where("doc_id is not null").select("doc_id", "text", bit.alias("bit")).mapInArrow(
        sets, "doc_id long, tokens binary"), "tokens")
    left = tokens.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x"))
    right = tokens.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _band_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """Every node beside the smallest node of each of its buckets."""
    band = nodes.select("node", "n", F.explode("bands").alias("band"))
    lead = band.groupBy("band").agg(F.min(F.struct("node", "n")).alias("lead"), F.count("*").alias("many"))
    return (
        band.join(lead.where("many > 1"), "band")
        .where(f"node <> lead.node and 100 * least(n, lead.n) >= {percent} * greatest(n, lead.n)")
        .select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct()
    )


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per indexed token; `room` is the size of the set from this token on, `hot` tells frequent tokens."""
    for batch in batches:
        for low in range(0, batch.num_rows, 512):
            part = batch.slice(low, 512)
            tokens, starts = utf8(part.column("first"))
            times = np.diff(starts) // 8
            place = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            n = np.repeat(part.column("n").to_numpy(), times)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(tokens.tobytes(), np.int64)), pa.array(n), pa.array((n - place).astype(np.int32)),
                 *(pa.array(np.repeat(part.column(c).to_numpy(), times)) for c in ("grp", "many")),
                 pa.array(place >= np.repeat(part.column("cold").to_numpy(), times))],
                names=["token", "n", "room", "grp", "many", "hot"])


def token_group_matrix(rows: DataFrame) -> DataFrame:
    """(token, grp, many, low, high, room, hot): each group's token union, with the number of its members, the sizes of its
    smallest and largest member and the most tokens that a member has from this one on.

    Groups of one member need no aggregation; those of several are combined before the shuffle.
    """
    one = rows.where("many = 1").select("token", "grp", "many", F.col("n").alias("low"), F.col("n").alias("high"), "room", "hot")
    return one.unionByName(rows.where("many > 1").groupBy("token", "grp").agg(
        F.max("many").alias("many"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("room").alias("room"), F.max("hot").alias("hot")))


def _met_again(rows: DataFrame, owner: str, alone: str = "false") -> DataFrame:
    """Rows whose token occurs in another row as well, those with frequent tokens, and those for which `alone` holds.

    Most tokens occur once; they go here, so that the join by token moves the rest only.  Rows with frequent
    tokens are kept unseen and dealt by their owner, so no task gets all rows of one token.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, False  # The last row so far, and whether it is out already.
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            token = batch.column("token").to_numpy()
            again = np.zeros(len(token), bool)
            again[1:] = token[1:] == token[:-1]
            again[:-1] |= again[1:]
            again |= batch.column("keep").to_numpy(zero_copy_only=False)
            ends = bool(again[-1])
            if last is not None and kept:
                again[0] = False
            last, kept = batch.slice(len(token) - 1), ends
            yield batch.filter(pa.array(again))

    kind = rows.withColumn("keep", F.expr(f"hot or ({alone})"))
    return kind.repartition("token", F.when(F.col("hot"), F.col(owner))).sortWithinPartitions("token").mapInArrow(
        keep, kind.schema).drop("keep", "hot")


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with the same home as blocks of at most 64 nodes: the union of their indexed tokens, and for each
    token a word with a bit per node that has it, and whether it is frequent.  A block is named by its first node."""
    held: list[tuple] = []
    size, run = 0, None

    def block() -> pa.RecordBatch:
        tokens = np.concatenate([np.frombuffer(x[3], np.uint64) for x in held])
        bits = np.repeat(np.uint64(1) << np.arange(len(held), dtype=np.uint64), [len(x[3]) // 8 for x in held])
        union, at = np.unique(tokens, return_inverse=True)
        masks = np.zeros(len(union), np.uint64)
        np.bitwise_or.at(masks, at, bits)
        hot = np.isin(union, np.concatenate([np.frombuffer(x[3], np.uint64)[x[4]:] for x in held]))
        node, n, grp = ([x[k] for x in held] for k in range(3))
        return pa.RecordBatch.from_arrays(
            [pa.array([node[0]], pa.int64()), pa.array([node], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int32())),
             pa.array([grp], pa.list_(pa.int64())), pa.array([union.tobytes()], pa.binary()), pa.array([masks.tobytes()], pa.binary()),
             pa.array([hot.tobytes()], pa.binary())],
            names=["block", "nodes", "sizes", "grps", "tokens", "masks", "hot"])

    for batch in batches:
        for row in batch.to_pylist():
            own = (row["home"], row["guest"], row["part"])
            if held and (own != run or len(held) == 64 or size > 500_000):
                yield block()
                held, size = [], 0
            run = own
            held.append((row["node"], row["n"], row["grp"], row["first"], row["cold"]))
            size += len(row["first"]) // 8
    if held:
        yield block()


def _spread_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, tokens, masks, hot in zip(*(batch.column(c) for c in ("block", "tokens", "masks", "hot"))):
            tokens, masks = (np.frombuffer(x.as_buffer(), np.int64) for x in (tokens, masks))
            hot = np.frombuffer(hot.as_buffer(), bool)
            for low in range(0, len(tokens), 65_536):
                part = tokens[low:low + 65_536]
                yield cut(None, {"token": part, "block": np.full(len(part), block.as_py()), "mask": masks[low:low + 65_536],
                                 "hot": hot[low:low + 65_536]})


def _block_counts(percent: int):
    """Pairs of nodes of two blocks whose shared indexed tokens leave room for a link."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[np.ndarray] = []
            for row in batch.to_pylist():
                nodes, sizes, grps = ([np.array(row[f"{c}_{side}"], np.int64) for side in "xy"] for c in ("nodes", "sizes", "grps"))
                shared = np.zeros((len(nodes[0]), len(nodes[1])), np.float32)
                masks = np.array([(m["x"], m["y"]) for m in row["masks"]], np.int64).view(np.uint8).reshape(-1, 2, 8)
                for low in range(0, len(masks), 8192):
                    bits = np.unpackbits(masks[low:low + 8192], axis=2, bitorder="little").astype(np.float32)
                    shared += bits[:, 0, :len(nodes[0])].T @ bits[:, 1, :len(nodes[1])]
                least, most = np.minimum.outer(*sizes), np.maximum.outer(*sizes)
                bound = (most * percent + 99) // 100 - 1 + shared.astype(np.int64)
                keep = (shared > 0) & (100 * least >= percent * most) & ((100 + percent) * bound >= percent * (least + most))
                keep &= np.not_equal.outer(*grps)
                if row["bx"] == row["by"]:
                    keep = np.triu(keep, 1)
                i, j = np.nonzero(keep)
                if len(i):
                    found.append(np.stack((nodes[0][i], nodes[1][j])))
            if found:
                a, b = np.concatenate(found, axis=1)
                yield cut(None, {"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return count


def _open_blocks(sized: DataFrame, open_groups: DataFrame) -> DataFrame:
    """The nodes of open groups in blocks of at most 64.

    A group stands beside the largest group that it is open for, so that many small groups around one
    large group share blocks.  The members of a home are dealt by a hash into as many parts as their number
    asks for; no part grows with a group.
    """
    def size_first(side: str):
        return F.struct((-F.col(f"many_{side}")).alias("many"), F.col(f"grp_{side}").alias("grp"))

    sides = open_groups.select(F.explode(F.array(
        F.struct(size_first("x").alias("own"), size_first("y").alias("other")),
        F.struct(size_first("y").alias("own"), size_first("x").alias("other")))).alias("s"))
    homes = sides.groupBy("s.own.grp").agg(
        F.min(F.least("s.own", "s.other"))["grp"].alias("home"), (-F.min("s.own.many")).alias("many")).select(
        "grp", "home", (F.col("home") != F.col("grp")).alias("guest"), "many")
    parts = homes.groupBy("home", "guest").agg(F.ceil(F.sum("many") / 40).alias("parts"))
    homes = staged(homes.join(parts, ["home", "guest"]).select("grp", "home", "guest", "parts"), "homes")
    dealt = sized.select("node", "n", "first", "cold", "grp").join(homes, "grp").withColumn(
        "part", F.pmod(F.xxhash64("node"), F.col("parts")))
    return dealt.repartition("home", "guest", "part").sortWithinPartitions("home", "guest", "part", "node").select(
        "home", "guest", "part", "node", "n", "grp", "first", "cold").mapInArrow(
        _pack_blocks, "block long, nodes array<long>, sizes array<int>, grps array<long>, tokens binary, masks binary, hot binary")


def _matrix_pairs(nodes: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different groups that the bounds leave open.

    The first token, in the order, that two sets share bounds their overlap by what either has from it
    on.  A group is opened for another if one of their shared tokens leaves room for a link.  The nodes
    of open groups stand in blocks, and the matrix of blocks has a bit per node; where two blocks with
    groups open for each other share tokens, a product of their bits counts the shared indexed tokens of
    every pair of nodes at once: of the set whose last indexed token comes first, all indexed tokens but
    those are missing in the other, so the overlap is at most n - index_length(n) + count.
    """
    many = groups.groupBy("component").agg(F.count("*").cast("int").alias("many"))
    sized = nodes.join(groups.join(many, "component"), "node", "left").select(
        "node", "n", "first", "cold", F.coalesce("component", "node").alias("grp"), F.coalesce("many", F.lit(1)).alias("many"))
    matrix = staged(_met_again(token_group_matrix(
        sized.mapInArrow(_spread, "token long, n int, room int, grp long, many int, hot boolean")), "grp"), "matrix")
    x, y = (matrix.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("grp", "many", "low", "high", "room")]) for side in "xy")
    near = f"100 * high_x >= {percent} * low_y and 100 * high_y >= {percent} * low_x"
    room = f"{100 + percent} * least(room_x, room_y) >= {percent} * (low_x + low_y)"
    open_groups = staged(x.join(y, "token").where(f"grp_x < grp_y and {near} and {room}").select(
        "grp_x", "grp_y", "many_x", "many_y").distinct(), "open")
    blocks = staged(_open_blocks(sized, open_groups), "blocks")
    place = blocks.select("block", F.explode(F.array_distinct("grps")).alias("grp"))
    open_blocks = staged(
        open_groups.join(place.select(F.col("grp").alias("grp_x"), F.col("block").alias("p")), "grp_x")
        .join(place.select(F.col("grp").alias("grp_y"), F.col("block").alias("q")), "grp_y")
        .select(F.least("p", "q").alias("bx"), F.greatest("p", "q").alias("by")).distinct(), "open_blocks")
    tokens = staged(_met_again(blocks.select("block", "tokens", "masks", "hot").mapInArrow(
        _spread_blocks, "token long, block long, mask long, hot boolean"), "block", "mask & (mask - 1) <> 0"), "block_tokens")
    x = tokens.select("token", F.col("block").alias("bx"), F.col("mask").alias("x"))
    y = tokens.select("token", F.col("block").alias("by"), F.col("mask").alias("y"))
    counted = x.join(open_blocks, "bx").join(y, ["token", "by"]).groupBy("bx", "by").agg(
        F.collect_list(F.struct("x", "y")).alias("masks"))
    for side in "xy":
        counted = counted.join(blocks.select(
            F.col("block").alias(f"b{side}"), *[F.col(c).alias(f"{c}_{side}") for c in ("nodes", "sizes", "grps")]), f"b{side}")
    return counted.mapInArrow(_block_counts(percent), "a long, b long")


def ngram_jaccard_classes(docs: DataFrame, n: int = 5, percent: int = 80, often: int = 32) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs` (doc_id, text).

    Two documents are linked if 100 |A and B| >= percent |A or B| for their sets of word n-grams;
    component_id is the smallest doc_id that links reach.  `often` only steers the order of the index.
    """
    docs = narrow(docs, {"doc_id": "long", "text": "string"})
    index = staged(token_index(docs, n, percent, often), "index")
    nodes = staged(index.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(
        F.min("doc_id").alias("node"), F.min(F.struct("first", "bands", "cold")).alias("_s")).select(
        "d1", "d2", "n", "node", "_s.first", "_s.bands", "_s.cold"), "nodes")
    # Versions of one document (a repeated id with another text) are linked by definition.
    same = index.where("n > 0 and doc_id is not null").select("doc_id", "d1", "d2", "n").join(
        nodes.select("d1", "d2", "n", "node"), ["d1", "d2", "n"])
    versions = same.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("a", "b")
    near = linked_pairs(_band_pairs(nodes, percent), docs, n, percent)
    links = staged(near.unionByName(versions), "near")
    groups = components(links)
    more = linked_pairs(_matrix_pairs(nodes.select("node", "n", "first", "cold"), groups, percent), docs, n, percent)
    classes = components(links.unionByName(more))
    of_set = nodes.select("d1", "d2", "n", "node").join(classes, "node", "left").select(
        "d1", "d2", "n", F.coalesce("component", "node").alias("component_id"))
    return index.select("doc_id", "n", "d1", "d2").join(of_set, ["d1", "d2", "n"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
