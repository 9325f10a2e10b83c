"""Documents linked by the Jaccard similarity of their word shingles: prefix filters under several global orders.

A linked set shares at least t of its tokens with one other set, so only sets of which that share occurs in some other
one go on; tokens are counted for this in shards of their hash. Two sets of similarity t or more share a token among
the first n - ceil(t n) + 1 of each, under any order of all tokens. The first order puts rare tokens first, by a count
sketch over all sets that go on; it makes the candidates. Two more orders are plain scramblings; a candidate pair must
share a token of its prefixes under each of them too before it is verified exactly.

Documents with equal sets are one node from the start. Tokens with the same nodes are one bucket. Small buckets give
their pairs; in large ones every node meets a pivot, links are joined into components, and new pivots meet only nodes of
other components. What two rounds leave is dealt into buckets anew, by tokens of the second order, and the large ones of them by
size as well, as long as they span components; only nodes that are in large ones even then are compared block by block,
blocks of sizes that allow links alone. What shuffles whole sets, prefixes or pairs goes portion by portion, each bounded by a
share of the input, and its shuffle files go before the next; so disk does not depend on how many sets go on or pairs there are.
So no bucket gives all its pairs, and no link between components is lost. Hashes have 64 bits: two distinct sets among 10^9 coincide with a chance of 3 in 100.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shingles import mix, shingle_set, word_memo
from .workspace import Workspace, portions

#: Cells of the count sketch (one byte each when it is broadcast), slices it is summed in.
CELLS, SLICES = 1 << 22, 16
#: Nodes of a bucket that gives all its pairs; rounds of pivots in larger ones.
SMALL, ROUNDS = 8, 2
#: Sets of a block, when the rest of large buckets is compared.
TOGETHER = 256
#: Tokens of a shard in which occurrences are counted, about.
PER_SHARD = 2_000_000
#: Bytes up to which a side is broadcast after it was counted; beyond, the join shuffles.
BROADCAST = 32 << 20
#: Bytes that one step shuffles, about: this many, or this share of all texts if that is more. What takes more goes in portions.
PORTION, SHARE = 1 << 30, 0.25


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _node(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


RECORDS = "shard int, block long, tokens binary, at binary, doc_id array<long>, n array<long>, node array<long>"
COUNTED = "block long, at array<int>, held array<int>, doc_id array<long>, n array<long>, node array<long>"
_LONGS = pa.list_(pa.int64())
_RECORDS = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("tokens", pa.binary()), ("at", pa.binary()), ("doc_id", _LONGS), ("n", _LONGS), ("node", _LONGS)])


def _sets(width: int, text: str, shards: int):
    """Per batch (a block): its documents' ids, set sizes and nodes, and for each shard the tokens (40 bits) of its distinct sets with their places in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen, block = word_memo(), set(), TaskContext.get().partitionId() << 32
        for b in portions(batches):
            n, node, sets, places = [], [], [], []
            for i, t in enumerate(b.column(text).to_pylist()):
                s = shingle_set(t, width, memo)
                n.append(len(s))
                node.append(_node(s))
                if len(s) and node[-1] not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(node[-1])
                    sets.append(s)
                    places.append(np.full(len(s), i, np.uint16))
            out = {"shard": [block % shards], "block": [block], "tokens": [None], "at": [None], "doc_id": [b.column("doc_id").to_pylist()], "n": [n], "node": [node]}
            if sets:
                x, at = np.concatenate(sets), np.concatenate(places)
                shard = ((x >> np.uint64(40)) % np.uint64(shards)).astype(np.int32)
                order = np.argsort(shard, kind="stable")
                x, at, shard = x[order], at[order], shard[order]
                low = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :5])
                cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])).tolist()
                for i, j in zip(cuts, cuts[1:]):
                    for k, v in zip(out, (int(shard[i]), block, low[i:j].tobytes(), at[i:j].tobytes(), None, None, None)):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out.values(), _RECORDS)], schema=_RECORDS)
            block += 1

    return run


def _held(t: pa.Table) -> pa.Table:
    """A shard's count, for each set, of its tokens that occur in more than one (40 bits and the shard's share of the rest tell tokens apart well enough for a bound that may only be too high)."""
    out = {"block": [], "at": [], "held": [], "doc_id": [], "n": [], "node": []}
    blocks, raw, places = [], [], []
    for r in t.to_batches():
        for block, tokens, at, doc_id, n, node in zip(*(r.column(c).to_pylist() for c in ("block", "tokens", "at", "doc_id", "n", "node"))):
            if tokens is None:
                for k, v in zip(out, (block, None, None, doc_id, n, node)):
                    out[k].append(v)
            else:
                blocks.append(block)
                raw.append(tokens)
                places.append(np.frombuffer(at, np.uint16))
    if raw:
        sizes = [len(p) for p in places]
        x = np.zeros((sum(sizes), 8), np.uint8)
        x[:, :5] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 5)
        order = np.argsort(x := x.view(np.uint64).ravel(), kind="stable")
        same = x[order[1:]] == x[order[:-1]]
        twice = np.zeros(len(x), bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        start = 0
        for block, p, k in zip(blocks, places, sizes):
            got = np.bincount(p[twice[start : start + k]])
            at = np.flatnonzero(got)
            start += k
            if len(at):
                for key, v in zip(out, (block, at.tolist(), got[at].tolist(), None, None, None)):
                    out[key].append(v)
    ints = pa.list_(pa.int32())
    return pa.table({k: pa.array(v, pa.int64() if k == "block" else ints if k in ("at", "held") else _LONGS) for k, v in out.items()})


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts of the sets' tokens, in slices."""
    counts = np.zeros(CELLS, np.uint32)
    for b in portions(batches):
        s = b.column("tokens").flatten().to_numpy().view(np.uint64)
        counts += np.bincount((s & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.uint32)
    if counts.any():
        parts = np.minimum(counts, 255).astype(np.uint8).reshape(SLICES, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([TaskContext.get().partitionId() // 64] * SLICES, pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["slice", "part", "counts"])


def _summed(kind: type):
    """Adds up a slice's counts, which come as ``kind``."""

    def run(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = np.zeros(CELLS // SLICES, np.uint32), None
        for b in groups:
            for at, c in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist()):
                total += np.frombuffer(zlib.decompress(c), kind)
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["slice", "counts"])

    return run


def rarity(sketch: DataFrame) -> bytes:
    """One byte for each cell: the binary logarithm of how many shingles of distinct sets fell into it. Its size does not depend on the data."""
    once = sketch.select("slice", "part", "counts").groupBy("slice", "part").applyInArrow(_summed(np.uint8), "slice int, counts binary")
    twice = once.groupBy("slice").applyInArrow(_summed(np.uint32), "slice int, counts binary")
    total = np.zeros((SLICES, CELLS // SLICES), np.uint32)
    for r in twice.collect():
        total[r["slice"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return np.log2(total.ravel() + 1.0).astype(np.uint8).tobytes()


def _prefixes(percent: int, rare):
    """Each set's rarest tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(zlib.decompress(rare.value), np.uint8)
        for b in portions(batches):
            tokens = []
            for t in b.column("tokens"):
                s = t.values.to_numpy().view(np.uint64)
                p = prefix_length(len(s), percent)
                key = level[(s & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | mix(s) >> np.uint64(8)
                tokens.append(s[np.argpartition(key, p - 1)[:p]].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(tokens, pa.list_(pa.int64()))], names=["node", "tokens"])

    return run


def _arrays(width: int, percent: int, text: str):
    """Each set as an array, and its prefixes under two more orders (as 32-bit hashes: enough for a filter that may only let too much pass)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        for b in portions(batches):
            nodes, sets, second, third = [], [], [], []
            for t in b.column(text).to_pylist():
                s = shingle_set(t, width, memo)
                if not len(s):
                    continue
                p = prefix_length(len(s), percent)
                nodes.append(_node(s))
                sets.append(s.view(np.int64))
                for out, salt in ((second, 2), (third, 3)):
                    x = mix(s, salt)
                    out.append((np.partition(x, p - 1)[:p] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, _LONGS), pa.array(second, pa.list_(pa.int32())), pa.array(third, pa.list_(pa.int32()))], names=["node", "tokens", "second", "third"])

    return run


def _step(percent: int):
    """The size step of a set of n: linked sets lie in the same step or in neighbours."""
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent * 1.001)))


def _across(left: DataFrame, going: DataFrame, sets: DataFrame, ws: Workspace, percent: int, portion: int) -> DataFrame:
    """Links (a, b) that join components among the nodes of buckets still open (bucket, node, root).

    Buckets that share nodes form one group, so that nodes that meet in many buckets are compared once. A group is cut into
    blocks by steps of size, and every two blocks of the same step or of neighbours are compared in one call, by counting the
    tokens they share; pairs are never rows. The sets go to their calls portion by portion.
    """
    groups = components(left.select(F.col("bucket").alias("a"), F.col("node").alias("b")), ws, "groups").toDF("node", "group")
    nodes = left.select("node", "root").distinct().join(groups, "node").join(going.select("node", "n"), "node").withColumn("step", _step(percent))
    nodes = ws.write(nodes, "open")
    size = nodes.groupBy("group", "step").agg(F.ceil(F.count("*") / TOGETHER).alias("blocks"))
    block = lambda step, k: (F.col(step) * F.lit(1 << 32) + k).cast("long")
    dealt = nodes.join(size, ["group", "step"]).withColumn("block", block("step", F.pmod(F.xxhash64("node", F.lit(5)), "blocks"))).drop("blocks")
    dealt = dealt.withColumn("near", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1))).join(size.withColumnRenamed("step", "near"), ["group", "near"])
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("other", block("near", F.col("k")))
    dealt = ws.write(dealt.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root", "n"), "cells")
    few = sets.join(small_side(nodes.select("node"), nodes.count()), "node", "left_semi").select("node", "tokens")
    parts = -(-8 * (dealt.agg(F.sum("n")).first()[0] or 0) // portion) or 1

    def compare(t: pa.Table) -> pa.Table:
        node, root, block = (t.column(c).to_numpy() for c in ("node", "root", "block"))
        lists = t.column("tokens").combine_chunks()
        n = np.diff(lists.offsets.to_numpy())
        tokens, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(node)), n)
        word, at, times = np.unique(tokens, return_inverse=True, return_counts=True)
        again = times[at] > 1  # others are common to no two sets
        at = (np.cumsum(times > 1) - 1)[at[again]]
        of = of[again]
        order = np.argsort(at, kind="stable")
        at, of = at[order], of[order]
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        rows, cols = np.flatnonzero(block == i), np.flatnonzero(block == j)
        both = np.zeros((len(rows), len(cols)), np.float32)
        for start in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
            lo, hi = np.searchsorted(at, [start, start + 4096])
            m = np.zeros((len(node), 4096), np.float32)
            m[of[lo:hi], at[lo:hi] - start] = 1
            both += m[rows] @ m[cols].T
        ok = (100 * both >= percent * (n[rows][:, None] + n[cols][None, :] - both)) & (root[rows][:, None] != root[cols][None, :])
        heads: dict[int, int] = {}

        def head(x: int) -> int:
            while x in heads:
                x = heads[x]
            return x

        a, b = [], []
        for r, c in zip(*(x.tolist() for x in np.nonzero(ok))):
            p, q = head(int(root[rows[r]])), head(int(root[cols[c]]))
            if p != q:
                heads[p] = q
                a.append(int(node[rows[r]]))
                b.append(int(node[cols[c]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def part(k: int) -> DataFrame:
        some = dealt.where(F.pmod(F.xxhash64("group", "i", "j"), F.lit(parts)) == k).drop("n").join(few, "node")
        return some.groupBy("group", "i", "j").applyInArrow(compare, "a long, b long")

    return ws.write_parts(part, parts, "links-left")


def _narrowed(members: DataFrame, keys: list[str], ws: Workspace, name: str) -> tuple[DataFrame, DataFrame]:
    """The buckets ``keys`` of nodes (node, root, n, held) that span components, small ones and large ones; buckets of the same nodes count once."""
    of = members.groupBy(*keys).agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    once = of.groupBy("size", "x", "y").agg(F.min(F.struct(*keys)).alias("k")).select("k.*", "size")
    kept = ws.write(members.join(once, keys), name)
    return kept.where(F.col("size") <= SMALL).drop("size"), kept.where(F.col("size") > SMALL).drop("size")


def _closer(left: DataFrame, going: DataFrame, sets: DataFrame, ws: Workspace, percent: int, fits: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, w: both sizes) of nodes left open, from small buckets by the second order, then by size too; and the nodes (node) that are in large ones even so."""
    nodes = left.select("node", "root").distinct().join(going.select("node", "n", "held"), "node")
    step = _step(percent)
    pairs, open_, keys = None, nodes, []
    for key in ("second", "step"):
        keys = [*keys, key]
        more = open_.withColumn(key, F.explode(F.array(step, step + 1))) if key == "step" else open_.join(sets.select("node", F.explode(key).alias(key)), "node")
        small, open_ = _narrowed(more, keys, ws, f"by-{key}")
        one, two = small.toDF(*[c if c in keys else {"node": "a", "root": "ra", "n": "na", "held": "ha"}[c] for c in small.columns]), small.toDF(*[c if c in keys else {"node": "b", "root": "rb", "n": "nb", "held": "hb"}[c] for c in small.columns])
        some = one.join(two, keys).where(f"a < b and ra <> rb and {fits}").selectExpr("a", "b", "na + nb as w")
        pairs = some if pairs is None else pairs.union(some)
    return pairs.distinct(), open_.select("node").distinct()


def small_side(df: DataFrame, rows: int, width: int = 64) -> DataFrame:
    """Marked for broadcast if its counted rows, ``width`` bytes each once they are hashed, are few enough; else left to a shuffle."""
    return F.broadcast(df) if rows * width <= BROADCAST else df


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75, text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles long, component_id (the smallest doc_id reachable by links, its own included).

    Two rows link when 100 * intersection >= percent * union of their shingle sets (of ``width`` words, A-Z lower-cased).
    A null or empty text, or one without words, has no shingles and no links. Equal texts link, so repeated rows and ties
    share a component. Rows with a null id take part; they count for no component_id, which is null where no linked row has an id.
    Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(64, size // (6 * PER_SHARD))
    counted = ws.write(docs.mapInArrow(_sets(width, "text", shards), RECORDS).groupBy("shard").applyInArrow(_held, COUNTED), "counted")
    rows = counted.where("node is not null").select("block", F.posexplode(F.arrays_zip("doc_id", "n", "node")).alias("at", "r")).select("block", "at", "r.*")
    classes = ws.write(rows.where("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id")), "classes")
    held = counted.where("held is not null").select("block", F.explode(F.arrays_zip("at", "held")).alias("r")).groupBy("block", F.col("r.at").alias("at")).agg(F.sum("r.held").alias("held"))
    going = rows.where("n > 0").join(held, ["block", "at"]).where(f"100 * held >= {percent} * n").groupBy("node").agg(F.max("n").alias("n"), F.max("held").alias("held"))
    going = ws.write(going, "going")
    portion = max(PORTION, int(SHARE * size))
    key = F.coalesce("doc_id", F.lit(-(2**63))).alias("k")
    ids = going.select("node").join(classes, "node").select("node", key)
    times = rows.select(key).join(ids.select("k").distinct(), "k", "left_semi").groupBy("k").agg((F.count("*") == 1).alias("once"))
    ids = ws.write(ids.join(times, "k"), "ids")
    some = {r["once"]: r["count"] for r in ids.groupBy("once").count().collect()}

    def arrays(once: bool) -> DataFrame:
        """The sets of documents by whose ids they go on."""
        own = ids.where("once" if once else "not once")
        picked = docs.withColumn("k", key).join(small_side(own.select("k").distinct(), some.get(once, 0)), "k", "left_semi").select("text")
        return picked.mapInArrow(_arrays(width, percent, "text"), "node long, tokens array<long>, second array<int>, third array<int>")

    sets = arrays(True)
    if some.get(False):  # other rows have these ids too: of each set that goes on by them, one
        repeated = arrays(False).join(ids.where("not once").select("node"), "node", "left_semi").dropDuplicates(["node"])
        sets = sets.unionByName(repeated) if some.get(True) else repeated
    sets = ws.write(sets, "arrays", "lz4")
    rare = spark.sparkContext.broadcast(zlib.compress(rarity(sets.select("tokens").mapInArrow(_sketched, "slice int, part int, counts binary")), 1))
    prefixes = ws.write(sets.select("node", "tokens").mapInArrow(_prefixes(percent, rare), "node long, tokens array<long>"), "prefixes", "lz4")
    tokens = prefixes.select("node", F.explode("tokens").alias("token"))
    longest = going.agg(F.sum(F.expr(f"n - ceil({percent} * n / 100) + 1"))).first()[0] or 0
    parts = -(-72 * int(longest) // portion) or 1

    def one_bucket_each(of: DataFrame) -> DataFrame:
        """Of tokens with the same nodes, one."""
        return of.groupBy("size", "x", "y").agg(F.min("token").alias("token"))

    def bucketed(k: int) -> DataFrame:
        some = tokens if parts == 1 else tokens.where(F.pmod(F.xxhash64("token"), F.lit(parts)) == k)
        of = some.groupBy("token").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("size > 1")
        return some.join(one_bucket_each(of), "token")

    met = ws.write_parts(bucketed, parts, "met", "lz4")
    ws.drop("prefixes")
    if parts > 1:
        met = met.join(one_bucket_each(met).select("token"), "token")
    members = ws.write(met.join(going, "node").select(F.col("token").alias("bucket"), "size", "node", "n", F.col("held").alias("h")), "members", "lz4")
    ws.drop("met")

    def fits(a: str, b: str) -> str:
        """Sizes allow a link: no more tokens can be common than either set has, and has in common with any set at all."""
        n = [f"n{x}" if x != "p" else "p.n" for x in (a, b)]
        h = [f"h{x}" if x != "p" else "p.h" for x in (a, b)]
        return f"100 * least({', '.join(n)}) >= {percent} * greatest({', '.join(n)}) and {100 + percent} * least({', '.join(h)}) >= {percent} * ({' + '.join(n)})"

    def links(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b, w) that link, of those whose prefixes meet under the other orders. Only sets of the pairs are shuffled, and those in portions, by their nodes on either side."""

        def both_sides(of: DataFrame, columns: list[str], share: float, on, to: str, codec: str = "zstd") -> DataFrame:
            ends = of.selectExpr("stack(2, a, w, b, w) as (node, w)").groupBy("node").agg(F.sum("w").alias("w")).join(going.select("node", "n"), "node")
            ends = ws.write(ends, f"{to}-ends")
            rows, held, sent = ends.agg(F.count("*"), F.sum("n"), F.sum("w") / 2).first()
            some = sets.join(small_side(ends.select("node"), rows), "node", "left_semi").select("node", *columns)
            p = max(-(-int(16 * share * (held or 0)) // portion), int((4 * share * (sent or 0) / portion) ** 0.5) + 1)

            def part(k: int) -> DataFrame:
                def of_(df: DataFrame, node: str, at: int) -> DataFrame:
                    return df if p == 1 else df.where(F.pmod(F.xxhash64(node, F.lit(9)), F.lit(p)) == at)

                i, j = divmod(k, p)
                left, right = (of_(some, "node", x).toDF(side, *[f"{side}_{c}" for c in columns]) for side, x in (("a", i), ("b", j)))
                return of_(of_(of, "a", i), "b", j).join(left, "a").join(right, "b").where(on).select("a", "b", "w")

            out = ws.write_parts(part, p * p, to, codec)
            ws.drop(f"{to}-ends")
            return out

        meet = F.arrays_overlap("a_second", "b_second") & F.arrays_overlap("a_third", "b_third")
        left = both_sides(pairs, ["second", "third"], 0.25, meet, f"{name}-left")
        both = F.size(F.array_intersect("a_tokens", "b_tokens"))
        alike = 100 * both >= percent * (F.size("a_tokens") + F.size("b_tokens") - both)
        out = both_sides(left, ["tokens"], 1, alike, name)
        ws.drop(f"{name}-left")
        return out.select("a", "b")

    small, large = members.where(F.col("size") <= SMALL), members.where(F.col("size") > SMALL)
    one, two = small.drop("size").toDF("bucket", "a", "na", "ha"), small.drop("size").toDF("bucket", "b", "nb", "hb")
    pivots = large.groupBy("bucket").agg(F.min(F.struct("node", "n", "h")).alias("p"))
    met_pairs = small.agg(F.sum(F.expr("(size - 1) / 2"))).first()[0] or 0
    portions_of_pairs = -(-int(32 * met_pairs) // portion) or 1

    def met_in(k: int) -> DataFrame:
        of = lambda df, c: df if portions_of_pairs == 1 else df.where(F.pmod(F.xxhash64(c, F.lit(9)), F.lit(portions_of_pairs)) == k)
        close = of(one, "a").join(two, "bucket").where(f"a < b and {fits('a', 'b')}").selectExpr("a", "b", "na + nb as w")
        star = large.join(of(pivots, "p.node"), "bucket").where(f"node <> p.node and {fits('', 'p')}").select(F.col("p.node").alias("a"), F.col("node").alias("b"), (F.col("p.n") + F.col("n")).alias("w"))
        return close.union(star).distinct()

    found = links(ws.write_parts(met_in, portions_of_pairs, "pairs-0"), "links-0")
    comp = ws.write(components(found, ws, "star-0"), "comp-0")
    used = ws.write(pivots.select("bucket", F.col("p.node").alias("node")), "used-0")
    def rest_of(used: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Nodes of large buckets that were no pivots, and the buckets where they lie in several components, with a new pivot."""
        rest = large.join(used, ["bucket", "node"], "left_anti").join(comp, "node", "left").select("bucket", "node", "n", "h", F.coalesce("root", "node").alias("root"))
        return rest, rest.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct("node", "n", "h", "root")).alias("p")).where("lo < hi").select("bucket", "p")

    for i in range(1, ROUNDS + 1):
        rest, open_ = rest_of(used, comp)
        new = rest.join(open_, "bucket").where(f"node <> p.node and root <> p.root and {fits('', 'p')}").select(F.col("p.node").alias("a"), F.col("node").alias("b"), (F.col("p.n") + F.col("n")).alias("w"))
        new = ws.write(new.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").distinct(), f"pairs-{i}")
        state = ws.write(open_.select("bucket", F.col("p.node").alias("node")), f"pivots-{i}")
        if state.isEmpty():
            break
        more = links(new, f"links-{i}")
        used = ws.write(used.union(state), f"used-{i}")
        if not more.isEmpty():
            found = ws.write(found.union(more), f"found-{i}")
            comp = ws.write(components(found, ws, f"star-{i}"), f"comp-{i}")
    rest, open_ = rest_of(used, comp)
    left = ws.write(rest.join(open_.select("bucket"), "bucket").select("bucket", "node", "root"), "left")
    if not left.isEmpty():
        near, open_ = _closer(left, going, sets, ws, percent, fits("a", "b"))
        found = ws.write(found.union(links(ws.write(near, "pairs-closer"), "links-closer")), "found-closer")
        comp = ws.write(components(found, ws, "star-closer"), "comp-closer")
        rest = left.drop("root").join(open_, "node").join(comp, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
        spans = rest.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
        large = ws.write(rest.join(spans.select("bucket"), "bucket"), "left-large")
        if not large.isEmpty():
            more = _across(large, going, sets, ws, percent, portion)
            found = ws.write(found.union(more), "found-left")
            comp = ws.write(components(found, ws, "star-left"), "comp-left")

    named = classes.join(comp, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    final = named.join(least, "root").select("node", "component_id")
    out = rows.where("n > 0").join(final, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    out = ws.write(out, "result")
    ws.close("result")
    rare.destroy()
    return out


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 75, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component: one document of each group of near copies.

    Of rows that repeat an id, one stays. Rows without an id, which no result can name, all stay.
    """
    found = jaccard_components(docs, width, percent, text)
    kept = found.where("doc_id = component_id").groupBy("doc_id").count()
    again = not kept.where("count > 1").isEmpty()
    unnamed = not found.where("doc_id is null").isEmpty()
    ids = kept.select("doc_id")
    out = docs.join(small_side(ids, ids.count()), "doc_id", "left_semi")
    if again:
        out = out.dropDuplicates(["doc_id"])
    return out.unionByName(docs.where("doc_id is null")) if unnamed else out
