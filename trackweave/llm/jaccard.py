"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

A document is the set of hashes of its word n-grams. Sets that are equal are collapsed first, so a
group of copies costs one row. All sets are sorted by one global order, rarest first; rarity is read from a table of
fixed size that counts all n-grams of all documents by hash. If two sets are to overlap enough, the prefixes of
length |x| - ceil(t |x|) + l share at least l tokens. A longer prefix finds more rows in the join but asks
for more matches, so each document picks the l with the least estimated cost, and a pair needs
min(l_x, l_y) shared prefix tokens, and as many as its two sizes imply, before its sets are compared exactly. Of a
pair's smaller set a shorter prefix does, |y| - ceil(2 t / (1 + t) |y|) + l, as its partner is no smaller.

Each prefix row carries its place in the set and its rank among the document's tokens that stand in a block of several clusters. A pair that meets
at a token shares at most the smaller rank up to it and the fewer of what is left after it; the join's condition drops it if that isn't
enough. Rows whose sets differ in many rare tokens are so ruled out in the largest blocks. The last join adds a bound from a bitmap
of each set: two sets differ in at least as many tokens as their parity bitmaps do in bits.

Only components are asked for, so pairs that are already known to be connected are not compared again:
each document is first compared with the smallest document of each of its prefix blocks (one row per
prefix token, not per pair), again with other centres while large blocks are left and that still connects a good part; later joins only pair rows of different clusters, and never two rows of the
cluster that most of a block belongs to. No link between clusters is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from trackweave.llm.common import flat_words, mixed, pieces, settled, small_batches


@dataclass(frozen=True)
class JaccardParams:
    """Links: 100 * intersection >= percent * union of sets of n-word shingles.

    table_bits: size of the rarity table. longest: most matches that a prefix may ask for. star_rounds: comparisons with block centres before the pairs, at most.
    """

    n: int = 5
    percent: int = 80
    table_bits: int = 20
    longest: int = 6
    star_rounds: int = 5


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-grams of each text; with fewer words, of the whole sequence."""
    offsets, index, words = flat_words(texts)
    codes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))[index] if len(words) else np.empty(0, np.uint64)
    total = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for k in range(n):
        total = mixed(total ^ codes[k : k + len(total)])
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= n:
            s = np.sort(total[a : b - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            h = np.array([b - a], np.uint64)
            for c in codes[a:b]:
                h = mixed(h ^ c)
            out.append(mixed(h))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def rarity_table(docs: DataFrame, p: JaccardParams) -> np.ndarray:
    """Counts of all n-grams (of each distinct text once per row) by their lowest bits: 2**table_bits numbers, whatever the input."""
    size, parts, groups = 1 << p.table_bits, 64, 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.int64)
        for b in (x for batch in batches for x in pieces(batch)):
            cells = [(s & np.uint64(size - 1)).astype(np.int64) for s in shingle_sets(b.column("text"), p.n)]
            np.add.at(table, np.concatenate(cells) if cells else np.empty(0, np.int64), 1)
        cut = np.split(table.astype(np.uint32), parts)
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column("part").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, np.uint32).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(s, 2**32 - 1).astype(np.uint32).tobytes() for s in sums.values()], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    counted = docs.select("text").mapInArrow(count, schema)
    # added up in a tree: no task gets more than its share of groups
    counted = counted.repartition("part", F.spark_partition_id() % groups).mapInArrow(add, schema)
    rows = counted.repartition("part").mapInArrow(add, schema).collect()
    return np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in sorted(rows, key=lambda r: r["part"])]) if rows else np.zeros(size, np.uint32)


def prefix_lengths(counts: np.ndarray, size: int, percent: int, longest: int) -> tuple[int, int]:
    """(prefix length, matches l) of least cost for a set whose rarest-first tokens have `counts` other occurrences (estimated)."""
    base = size - (percent * size + 99) // 100
    best, chosen, upto = None, (min(size, base + 1), 1), np.cumsum(counts[: base + longest], dtype=np.float64)
    for matches in range(1, longest + 1):
        length = base + matches
        if length > size:
            break
        rows = upto[length - 1]
        cost = rows + rows / matches * size / 8  # rows of the join, and comparisons of sets: no more pairs than rows / matches can have as many matches
        if best is None or cost < best:
            best, chosen = cost, (length, matches)
    return chosen


def bitmaps(sets: list[np.ndarray]) -> list[bytes | None]:
    """256 bits of each set: the parity of how many of its tokens fall on each."""
    out = []
    for s in sets:
        flags = np.bincount((s >> np.uint64(20)).astype(np.int64) & 255, minlength=256) & 1
        out.append(np.packbits(flags.astype(np.uint8), bitorder="little").tobytes() if len(s) else None)
    return out


#: The bitmap as columns of 64 bits.
BITS = ("b0", "b1", "b2", "b3")


def signatures(docs: DataFrame, p: JaccardParams) -> DataFrame:
    """doc_id, n_shingles, set_key, 128 bits of the whole set, and its bitmap; null key for empty sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in pieces(batch)):
            sets = shingle_sets(b.column("text"), p.n)
            bits = np.frombuffer(b"".join(x or bytes(32) for x in bitmaps(sets)), np.int64).reshape(len(sets), 4)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), *(pa.array(bits[:, k]) for k in range(4))], ["doc_id", "n_shingles", "set_key", *BITS])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, b0 long, b1 long, b2 long, b3 long")


#: Of the document, in each of its prefix rows.
PREFIX, PREFIX_TYPES = ("doc_id", "size", "matches", "length", "short"), (pa.int64(), *[pa.int32()] * 4)


def prefixes(docs: DataFrame, table: np.ndarray, p: JaccardParams) -> DataFrame:
    """token, place, doc_id, size, matches, length, short: a row per prefix token. place: of the token in the ordered set, from 1; short: length of the prefix as a pair's smaller set."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    average = float(table.sum()) / max(1, len(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        mask = np.uint64(len(counts) - 1)
        for b in (x for batch in batches for x in pieces(batch)):
            tokens, rows = [], []
            for i, s in zip(b.column("doc_id").to_pylist(), shingle_sets(b.column("text"), p.n), strict=True):
                if not len(s) or i is None:
                    continue
                own = counts[(s & mask).astype(np.int64)]
                order = np.lexsort((s, own))[: len(s) - (p.percent * len(s) + 99) // 100 + p.longest]
                length, matches = prefix_lengths(np.maximum(own[order] - average, 0), len(s), p.percent, p.longest)
                tokens.append(s[order[:length]])
                short = min(length, len(s) - (2 * p.percent * len(s) + 99 + p.percent) // (100 + p.percent) + matches)
                rows.append((i, len(s), matches, length, short))
            if rows:
                n = [len(t) for t in tokens]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate([np.arange(1, k + 1, dtype=np.int32) for k in n])), *[pa.array(np.repeat(np.array(c, np.int64), n), t) for c, t in zip(zip(*rows, strict=True), PREFIX_TYPES, strict=True)]], ["token", "place", *PREFIX])
    return docs.select("doc_id", "text").mapInArrow(run, "token long, place int, doc_id long, size int, matches int, length int, short int")


def token_sets(docs: DataFrame, p: JaccardParams) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in pieces(batch)):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(shingle_sets(b.column("text"), p.n))], ["doc_id", "tokens"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, tokens array<long>")


def _candidates(left: DataFrame, right: DataFrame, condition: str, p: JaccardParams) -> DataFrame:
    """Pairs x < y with enough shared prefix tokens; left and right: token, place, rank, PREFIX, cluster, major, and the bitmap if both have it."""
    bits = [b for b in BITS if b in left.columns and b in right.columns]
    names = (*PREFIX, "place", "rank", "cluster", "major", *bits)
    a = left.select("token", *[F.col(n).alias(f"x_{n}") for n in names])
    b = right.select("token", *[F.col(n).alias(f"y_{n}") for n in names])
    fits = f"100L * least(x_size, y_size) >= {p.percent}L * greatest(x_size, y_size)"
    smaller = "(x_size < y_size or x_size = y_size and x_doc_id < y_doc_id)"
    early = f"if({smaller}, x_place <= x_short, y_place <= y_short)"
    overlap = f"({p.percent}L * (x_size + y_size) + {100 + p.percent - 1}) div {100 + p.percent}"
    reach = f"least(x_rank, y_rank) + least(x_size - x_place, y_size - y_place) >= {overlap}"
    differ = f" and coalesce({' + '.join(f'bit_count(x_{n} ^ y_{n})' for n in bits)} <= x_size + y_size - 2 * ({overlap}), true)" if bits else ""
    j = a.join(b, "token").filter(f"{condition} and {fits} and {early} and {reach}{differ}")
    unseen = f"greatest(x_size - if({smaller}, x_short, x_length), y_size - if({smaller}, y_length, y_short))"
    j = j.selectExpr("if(x_doc_id < y_doc_id, x_doc_id, y_doc_id) as x", "if(x_doc_id < y_doc_id, y_doc_id, x_doc_id) as y", f"greatest(least(x_matches, y_matches), {overlap} - {unseen}) as need")
    return j.groupBy("x", "y").agg(F.count("*").alias("_shared"), F.max("need").alias("_need")).filter("_shared >= _need").select("x", "y")


#: Ids that are sent to all executors at most (16 bytes each); beyond it, the texts are shuffled by id.
IDS_SENT = 500_000


def _by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs with (left_semi) or without (left_anti) the ids of a computed table."""
    return docs.join(F.broadcast(ids) if ids.count() <= IDS_SENT else ids, "doc_id", how)


def _verified(pairs: DataFrame, docs: DataFrame, p: JaccardParams) -> DataFrame:
    """The pairs that link, by their whole sets."""
    involved = settled(pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct())
    sets = token_sets(_by_ids(docs, involved, "left_semi"), p)
    j = pairs.join(sets.select(F.col("doc_id").alias("x"), F.col("tokens").alias("a")), "x").join(sets.select(F.col("doc_id").alias("y"), F.col("tokens").alias("b")), "y")
    both = F.size(F.array_intersect("a", "b"))
    return j.withColumn("_both", both).filter(f"100 * _both >= {p.percent} * (size(a) + size(b) - _both)").select("x", "y")


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, component (least node reachable) of all nodes with links (x, y), by alternating large-star and small-star rounds.

    With a number of rounds, it stops after these: equal components are then connected, but connected nodes may still have several.
    """
    edges = settled(links.selectExpr("greatest(x, y) as u", "least(x, y) as v").filter("u <> v").distinct())
    before, done = None, 0
    while done != rounds:
        both = edges.unionAll(edges.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = both.join(least, "u").filter("v > u").selectExpr("v as u", "m as v").filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("v as u", "m as v").filter("u <> v").unionAll(low.selectExpr("u", "m as v")).distinct()
        edges = settled(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first() if rounds is None else None
        if rounds is None and state == before:
            break
        before, done = state, done + 1
    ends = edges.selectExpr("u as node", "v as component").unionAll(edges.selectExpr("v as node", "v as component"))
    return ends.groupBy("node").agg(F.min("component").alias("component"))


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows of blocks (equal tokens) with two clusters or more. major: whether the row's cluster is the block's largest one; rank: of the token among the document's rows that are left."""
    per = rows.groupBy("token", "cluster").agg(F.count("*").alias("n"))
    most = per.groupBy("token").agg(F.max(F.struct("n", "cluster")).alias("top"), F.count("*").alias("clusters")).filter("clusters > 1").select("token", F.col("top.cluster").alias("_top"))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("place"))  # a prefix at most
    return rows.join(most, "token").withColumns({"major": F.col("cluster") == F.col("_top"), "rank": rank}).drop("_top")


def near_duplicates(docs: DataFrame, p: JaccardParams = JaccardParams()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) of every row.

    Null and empty texts, and those of white space only, have no shingles, link with nothing and are their own component. Copies link by their equal
    sets. Repeated doc_ids are one document each if their texts are the same, else their links are joined; a null doc_id gets a null component. An
    empty table gives an empty result. doc_id is a long. Extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signed = settled(signatures(docs, p))
    classes = signed.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("first"))
    copies = signed.join(classes, "set_key").filter("doc_id <> first").select("doc_id").distinct().join(classes.select(F.col("first").alias("doc_id")), "doc_id", "left_anti")
    distinct = _by_ids(docs, settled(copies), "left_anti")
    table = rarity_table(docs, p)
    rows = prefixes(distinct, table, p)
    alone = rows.groupBy("token").agg(F.count("*").alias("_n")).filter("_n > 1").select("token")
    block = settled(_blocks(settled(rows.join(alone, "token").withColumn("cluster", F.col("doc_id")))))
    links, linked = [], []
    for _ in range(p.star_rounds):
        # the centre of a block: its smallest document, later the smallest outside of its largest cluster
        centre = (block.filter("not major") if links else block).groupBy("token").agg(F.min(F.struct("doc_id", *PREFIX[1:], "place", "rank", "cluster")).alias("c")).select("token", "c.*").withColumn("major", F.lit(False))
        found = settled(_verified(settled(_candidates(centre, block, "x_cluster <> y_cluster", p)), distinct, p))
        links.append(found)
        linked.append(found.count())
        near = components(_union(links), 2)
        rows = block.drop("cluster", "major", "rank").join(near.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("cluster", F.coalesce("component", "doc_id")).drop("component")
        block = settled(_blocks(rows))
        left, most = block.groupBy("token").agg(F.count("*").alias("n"), F.count_if(~F.col("major")).alias("m")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n").cast("double") * F.col("m")), F.lit(0.0))).first()
        if linked[-1] * 50 <= linked[0] or most <= 8 * left:  # another round finds little, or has little to spare
            break
    signs = signed.filter("set_key is not null").groupBy("doc_id").agg(*(F.min(b).alias(b) for b in BITS), F.min("set_key").alias("_k"), F.max("set_key").alias("_l")).filter("_k = _l").drop("_k", "_l")  # an id with several texts has none
    block = settled(block.join(signs, "doc_id", "left"))
    rest = _candidates(block.filter("not major"), block, "x_cluster <> y_cluster and (y_major or x_doc_id < y_doc_id)", p)
    links.append(settled(_verified(settled(rest), distinct, p)))
    near = components(_union(links)).select(F.col("node").alias("first"), "component")
    named = signed.filter("set_key is not null").select("set_key", "doc_id", "n_shingles").join(classes.join(near, "first", "left").select("set_key", F.coalesce("component", "first").alias("component_id")), "set_key")
    named = named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return named.unionByName(signed.filter("set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out


def first_of_each(docs: DataFrame, p: JaccardParams = JaccardParams()) -> DataFrame:
    """The documents with one of each component left, that of the smallest doc_id. Rows of null doc_id stay; of rows with equal doc_id and text one stays, of a doc_id with several texts each of them."""
    found = settled(near_duplicates(docs, p))
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    twice = settled(found.filter("doc_id is not null and doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("doc_id"))
    kept = _by_ids(docs, settled(gone.unionAll(twice).distinct()), "left_anti").select(docs.columns)
    if twice.isEmpty():
        return kept
    return kept.unionByName(_by_ids(docs, twice, "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns))


def near_duplicates_sql(n: int, percent: int) -> str:
    """DuckDB, for small tables."""
    return f"""
    with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') ws from documents),
    s as (select doc_id, case when len(ws) >= {n} then list_distinct(list_transform(range(1, len(ws) - {n} + 2), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))) when len(ws) > 0 then [array_to_string(ws, ' ')] else []::varchar[] end g from w),
    k as (select doc_id, len(g) c, unnest(g) t from s),
    p as (select a.doc_id x, b.doc_id y from k a join k b on a.t = b.t and a.doc_id < b.doc_id and 100 * least(a.c, b.c) >= {percent} * greatest(a.c, b.c) group by a.doc_id, b.doc_id, a.c, b.c having 100 * count(*) >= {percent} * (a.c + b.c - count(*))),
    e as (select x, y from p union all select y, x from p),
    r as (select doc_id node, doc_id lab from s union select e.y, r.lab from r join e on r.node = e.x)
    select doc_id, len(g)::bigint n_shingles, m component_id from s join (select node, min(lab) m from r group by node) on node = doc_id"""
