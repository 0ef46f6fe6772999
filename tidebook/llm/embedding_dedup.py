"""Near duplicates of embeddings by a random-projection tree forest with spill overlap.

Vectors are scaled to length 1. A tree splits its vectors again and again at the median of their
projections on a random direction (one a tree and level); those within ``SPILL`` / sqrt(components) of the cut go to both
sides, as projections of unit vectors shrink with the root of their length. Pairs are compared
by cosine in double precision within leaves only, over ``TREES`` trees; pairs at ``COSINE`` = 0.95 or more
are links, and linked vectors form components.

Copies. Equal vectors are one class; one of them is indexed, and each counts in its neighbours' links.

Depth. Splitting goes in rounds. In each, the medians of a leaf's next levels are fitted on a bounded sample of its vectors
(the ``SAMPLE`` of smallest hash, one task a leaf), and all its vectors are sent down, in pieces of ``PIECE``. A round adds log2(``SAMPLE`` / 8) = 11 levels
at most; leaves of more than ``BIG`` vectors are split again, so leaves don't grow with the input. A node where more than
``DENSE`` of the sample would go to both sides is a leaf for good: a dense cluster that no direction divides is compared in full, in blocks.

Recall. A pair at 0.95 parts at a level with a chance of about 0.02 and only counts as lost if it parts in all trees: 0.0004 at 11 levels,
0.005 at 20. A level makes 1.13 vectors of one: 3.9 copies a tree at 11 levels, whatever the number of components.

Counting. Pairs are never written out. Every vector carries its leaves in all trees, and a pair counts only in
the smallest leaf that holds both, so the sums over leaves are the exact numbers of distinct links. For
the components each leaf gives each vector's smallest linked identifier within it, and the forest inside the
leaf as star edges: at most one edge a vector and leaf. A leaf of more than ``BLOCK`` vectors is compared in
pairs of blocks by separate tasks.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component link with nothing
and are kept; vectors of different length never link, and all lengths share one plan; rows with one identifier count as one
vector each; a null identifier links with nothing; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import mix, runs
from .common import bounded, components, spread_join, table, written

COSINE, TREES, SPILL, LEAF, BIG, BLOCK, SAMPLE, PIECE, DENSE, SEED = 0.95, 5, 0.16, 256, 4096, 1024, 16_384, 5_000, 0.5, 42
_U = np.uint64


@lru_cache(maxsize=32)
def directions(dim: int, tree: int, block: int) -> np.ndarray:
    """Unit directions of 16 levels of a tree, as columns."""
    d = np.random.default_rng((SEED, dim, tree, block)).standard_normal((dim, 16))
    return d / np.linalg.norm(d, axis=0)


def projections(x: np.ndarray, tree: int, depth: int, levels: int) -> np.ndarray:
    """Projections of the rows on the directions of ``levels`` levels from ``depth`` on."""
    first, last = depth // 16, (depth + max(levels, 1) - 1) // 16
    d = np.concatenate([directions(x.shape[1], tree, b) for b in range(first, last + 1)], axis=1)
    return x @ d[:, depth - 16 * first :][:, :levels]


def fitted(x: np.ndarray, tree: int, depth: int, levels: int) -> np.ndarray:
    """The cuts of a tree's next ``levels`` levels, in heap order (node k has the children 2k+1 and 2k+2); no number: no vectors, infinity: too dense to divide."""
    cuts = np.full((1 << levels) - 1, np.nan)
    p, spill, held = projections(x, tree, depth, levels), SPILL / np.sqrt(x.shape[1]), {0: np.arange(len(x))}
    for node in range(len(cuts)):
        rows = held.pop(node, ())
        if len(rows) < 2:
            continue
        v = p[rows, (node + 1).bit_length() - 1]
        cut = np.median(v)
        if np.mean(np.abs(v - cut) < spill) > DENSE:
            cuts[node] = np.inf
            continue
        cuts[node] = cut
        held[2 * node + 1], held[2 * node + 2] = rows[v < cut], rows[v >= cut]
    return cuts


def descended(x: np.ndarray, tree: int, depth: int, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, heap numbers of their last nodes and whether these are too dense to divide; spilled rows more than once."""
    levels = len(cuts).bit_length()
    p, spill = projections(x, tree, depth, levels), SPILL / np.sqrt(x.shape[1])
    row, node, out = np.arange(len(x)), np.zeros(len(x), np.int64), []
    for level in range(levels):
        cut = cuts[node]
        ends = ~np.isfinite(cut)
        out.append((row[ends], node[ends], np.isinf(cut[ends])))
        row, node = row[~ends], node[~ends]
        v = p[row, level] - cut[~ends]
        left, right = v < spill, v >= -spill
        row = np.concatenate([row[left], row[right]])
        node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
    out.append((row, node, np.zeros(len(row), bool)))
    return tuple(np.concatenate(c) for c in zip(*out))


def packed(x: np.ndarray) -> bytes:
    """A vector as bytes, in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return (short if (short == x).all() else x).tobytes()


def unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    """The vectors of ``packed`` as rows."""
    if all(len(r) == 4 * dim for r in rows):
        return np.frombuffer(b"".join(rows), np.float32).reshape(-1, dim).astype(np.float64)
    return np.array([np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64) for r in rows], np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    scale = np.abs(x).max(axis=1, keepdims=True)  # keeps very large and very small components in range
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows ``(id, dim, v)`` with vectors that can link, as bytes."""
    v = F.col(vector).cast("array<double>")
    good = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = df.select(F.col(key).cast("long").alias("id"), F.size(v).cast("long").alias("dim"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            flat, at = column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(batch.column("dim").to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("dim"), pa.array([packed(flat[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["id", "dim", "v"])

    return rows.transform(bounded).mapInArrow(run, "id long, dim long, v binary")


def fits(sample: DataFrame) -> DataFrame:
    """Rows ``(leaf, rows, levels, cuts)``, one a leaf; ``sample`` has ``(leaf, tree, depth, rows, dim, v)``, tree -1 stands for all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "leaf"):
            leaf, tree, depth, rows, dim = (part.column(c)[0].as_py() for c in ("leaf", "tree", "depth", "rows", "dim"))
            x = unit(unpacked(part.column("v").to_pylist(), dim))
            levels = int(max(1, min(np.ceil(np.log2(rows / (LEAF if tree < 0 else BIG // 4))), np.log2(max(16, min(len(x), SAMPLE)) / 8))))
            cuts = np.concatenate([fitted(x, t, depth, levels) for t in (range(TREES) if tree < 0 else [tree])])
            yield pa.RecordBatch.from_arrays([pa.array([leaf]), pa.array([rows]), pa.array([cuts.tobytes()], pa.binary())], names=["leaf", "rows", "cuts"])

    return sample.repartition("leaf").sortWithinPartitions("leaf", "h").transform(bounded).mapInArrow(run, "leaf long, rows long, cuts binary")


def split(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows ``(leaf, tree, depth, done, id)`` of the leaves below; each piece of a leaf's rows comes with the leaf's cuts in front."""
    piece, pieces = F.pmod(F.xxhash64("id"), F.ceil(F.col("rows") / PIECE)).cast("int").alias("piece"), F.ceil(F.col("rows") / PIECE).cast("int")
    front = known.select("leaf", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"), F.lit(0).alias("kind"), "cuts", *(F.lit(None).cast(t).alias(c) for c, t in (("id", "long"), ("tree", "int"), ("depth", "int"), ("dim", "long"), ("v", "binary"))))
    both = front.unionByName(rows.select("leaf", piece, F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("cuts"), "id", "tree", "depth", "dim", "v"))
    schema = pa.schema([("leaf", pa.int64()), ("tree", pa.int32()), ("depth", pa.int32()), ("done", pa.bool_()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "leaf", "piece"):
            if part.num_rows < 2:
                continue
            cuts, part = np.frombuffer(part.column("cuts")[0].as_py(), np.float64), part.slice(1)
            leaf, tree, depth, dim = (part.column(c)[0].as_py() for c in ("leaf", "tree", "depth", "dim"))
            ids, x = part.column("id").to_numpy(), unit(unpacked(part.column("v").to_pylist(), dim))
            trees = range(TREES) if tree < 0 else [tree]
            for t, own in zip(trees, cuts.reshape(len(trees), -1)):
                row, node, done = descended(x, t, depth, own)
                parent = mix(np.array([leaf, dim], np.int64).view(_U))
                code = mix((node.astype(_U) + _U(1)) * _U(64) + _U(t) ^ parent[0] ^ (parent[1] << _U(1))) >> _U(1) | _U(1)
                deep = depth + np.floor(np.log2(node + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(np.full(len(row), t, np.int32)), pa.array(deep.astype(np.int32)), pa.array(done), pa.array(ids[row])], schema=schema)

    return both.repartition("leaf", "piece").sortWithinPartitions("leaf", "piece", "kind").transform(bounded).mapInArrow(run, "leaf long, tree int, depth int, done boolean, id long")


def indexed(classes: DataFrame) -> DataFrame:
    """Rows ``(leaf, id)``: every vector in each leaf of each tree that holds it. The root of all trees is the leaf whose number is the vectors' length."""
    active = classes.select(F.col("dim").alias("leaf"), F.lit(-1).alias("tree"), F.lit(0).alias("depth"), F.lit(False).alias("done"), "id")
    out, limit = None, LEAF
    while True:
        sizes = active.groupBy("leaf").agg(F.count("*").alias("n")).withColumn("rows", F.col("n"))
        tagged = written(spread_join(active, sizes, "leaf", "id", active.count()), "leaves")
        small = F.col("done") | (F.col("rows") <= limit)
        ends = tagged.where(small).select("leaf", "id")
        out = ends if out is None else out.unionByName(ends)
        big = tagged.where(~small)
        if big.isEmpty():
            return out
        rows = written(big.join(classes.select("id", "dim", "v"), "id"), "split")
        share = F.least(F.lit(1.0), (SAMPLE + 8 * SAMPLE**0.5 + 16) / F.col("rows"))
        h = F.xxhash64("id", "leaf")
        sample = rows.withColumn("h", h).where(h / 2.0**64 + 0.5 <= share)
        active, limit = written(split(rows, written(fits(sample), "fits")), "leaves"), BIG


def smallest_linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable by the pairs (a, b), for each of 0..n-1."""
    least = np.arange(n)
    while True:
        new = least.copy()
        np.minimum.at(new, a, least[b])
        np.minimum.at(new, b, least[a])
        new = new[new]
        if (new == least).all():
            return least
        least = new


def compared(rows: DataFrame) -> DataFrame:
    """Rows ``(id, links, least)``: links counted in one leaf block, and the smallest identifier linked within it; ``rows`` has ``(id, dim, copies, leaves, v)`` with leaves and their numbers of blocks."""
    dealt = rows.withColumn("at", F.explode("leaves")).withColumn("blocks", F.col("at.blocks"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.col("at.leaf").alias("leaf"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "dim", "copies", F.col("leaves.leaf").alias("leaves"), "v")
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("least", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "leaf", "i", "j"):
            part = part.combine_chunks().sort_by("id")
            n = part.num_rows
            if n < 2:
                continue
            leaf, i, j, dim = (part.column(c)[0].as_py() for c in ("leaf", "i", "j", "dim"))
            ids, own, copies = (part.column(c).to_numpy() for c in ("id", "own", "copies"))
            x = unit(unpacked(part.column("v").to_pylist(), dim))
            lists = part.column("leaves").combine_chunks()
            counts = lists.value_lengths().to_numpy()
            seen = np.zeros((n, counts.max()), np.int64)  # leaves before this one; their numbers are over 0
            seen[np.arange(seen.shape[1]) < counts[:, None]] = lists.flatten().to_numpy()
            seen[seen >= leaf] = 0
            seen = seen[:, (seen > 0).any(axis=0)]
            links, a, b = np.zeros(n, np.int64), [], []
            sides = np.flatnonzero(own == i), np.flatnonzero(own == j)
            for k in range(0, len(sides[0]), 256):
                left = sides[0][k : k + 256]
                p, q = np.nonzero(x[left] @ x[sides[1]].T >= COSINE)
                p, q = left[p], sides[1][q]
                if i == j:
                    p, q = p[p < q], q[p < q]
                a.append(p)
                b.append(q)
                for m in range(0, len(p), 20_000):
                    pp, qq = p[m : m + 20_000], q[m : m + 20_000]
                    before = np.zeros(len(pp), bool)
                    for c in range(seen.shape[1]):
                        s = seen[pp, c]
                        before |= (s > 0) & (seen[qq] == s[:, None]).any(axis=1)
                    pp, qq = pp[~before], qq[~before]
                    links += np.bincount(pp, copies[qq], n).astype(np.int64) + np.bincount(qq, copies[pp], n).astype(np.int64)
            least = smallest_linked(np.concatenate(a), np.concatenate(b), n)
            keep = np.flatnonzero((links > 0) | (least != np.arange(n)))
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(links[keep]), pa.array(ids[least[keep]])], schema=schema)

    return dealt.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j").transform(bounded).mapInArrow(run, "id long, links long, least long")


def embedding_duplicates(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Rows ``(key, n_links, component_id, kept)``, one for each row of ``df``."""
    good = written(usable(df, key, vector).withColumn("digest", F.sha2(F.concat(F.col("v"), F.col("dim").cast("string").cast("binary")), 256)), "vectors")
    classes = written(good.groupBy("digest", "dim").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v")), "classes")
    leaves = indexed(classes)
    sizes = leaves.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    lists = spread_join(leaves, sizes, "leaf", "id", leaves.count()).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("leaf", "blocks"))).alias("leaves"))
    found = written(compared(lists.join(classes.drop("digest"), "id")), "links")
    joined = components(found.select(F.col("id").alias("a"), F.col("least").alias("b")))
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.select("id", "digest", "copies").join(sums, "id", "left").join(joined, "id", "left")
    known = known.select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    known = known.join(classes.select("digest", F.col("copies").alias("n")), "digest")
    members = spread_join(good.select(F.col("id").alias("__id"), "digest"), known, "digest", "__id", good.count())
    members = members.groupBy("__id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    own = df.select(F.col(key).cast("long").alias(key))
    out = own.where(F.col(key).isNotNull()).join(members, F.col(key) == F.col("__id"), "left")
    out = out.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", key).alias("component_id"))
    missing = own.where(F.col(key).isNull()).select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"))
    return out.unionByName(missing).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings, whatever their labels."""
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))
