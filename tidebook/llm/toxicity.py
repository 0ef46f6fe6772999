"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text is the bag of the character n-grams (3 to 5 bytes, word boundaries included) of its lower-cased
words, hashed to ``BUCKETS`` rows of an embedding. The mean embedding goes through a linear softmax over
two classes; embedding and softmax are trained jointly in numpy (AdaGrad on mini-batches). A misspelt
or unseen word shares most of its n-grams with the words it comes from, so it shares their vectors.

As all is linear up to the softmax, each n-gram adds one number to its text's margin; whole texts are
scored by one table lookup an n-gram on Arrow buffers.

Training uses a bounded sample: of the documents of at most ``TRAIN_BYTES`` bytes that have a label the ``TRAIN_ROWS``
(clean, toxic) with the smallest hashes of their identifier. Each bag also holds ``PAD`` zero vectors, so
that a few rare n-grams do not decide short texts. N-grams found in fewer than
``LEAST_DOCS`` training texts keep the zero vector.

Defined cases: null and empty texts, and those without words, get the score of an empty bag; without labels of
both classes every score is the share of toxic labels in the sample (0 without any); labels that are
null or have no document of that size are ignored; of texts that share an identifier one is learned from, all are
scored; very long texts are scored whole; a null identifier is kept and scored, but nothing is learned from it; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import _powers, _tables, buffers, mix, slices
from .common import bounded, hash_bound, table, words_of, written
from .language_id import held_out

SIZES, BUCKETS, DIM, PAD, TOGETHER = (3, 4, 5), 1 << 17, 4, 300, 32
TRAIN_ROWS, TRAIN_BYTES, LEAST_DOCS, STEPS, EPOCHS, BATCH, RATE, DECAY = (3000, 1500), 20_000, 3, 300, 6, 64, 0.5, 1e-5
PIECES = 64
MOST = (1 << 15) - 1  # a bucket and a count up to this take 32 bits together
_U = np.uint64


def bag_text(text: Column) -> Column:
    """The words with a space on both sides; empty if there are none."""
    words = words_of(text)
    return F.when(words != "", F.concat(F.lit(" "), words, F.lit(" "))).otherwise(F.lit(""))


def grams(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size the positions of the n-grams within a word and their buckets."""
    n = len(data)
    if not n:
        return
    mix_letters = _tables.setdefault("letters", mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15)))
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(mix_letters[data] * up[:n], out=sums[1:])
    space = np.where(data == 32, np.arange(n), n)
    following = np.append(np.minimum.accumulate(space[::-1])[::-1][1:], n)  # of the next space after each byte
    for size in SIZES:
        at = np.flatnonzero(following[: max(0, n - size + 1)] >= np.arange(max(0, n - size + 1)) + size - 1)
        yield at, (mix((sums[at + size] - sums[at]) * down[at] + _U(size)) & _U(BUCKETS - 1)).astype(np.int64)


def bags(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bags: text, bucket and how often the text has it, in order of text."""
    text, bucket = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for where, b in grams(data):
        text.append(np.searchsorted(at, where, "right") - 1)
        bucket.append(b)
    keys, counts = np.unique(np.concatenate(text) * BUCKETS + np.concatenate(bucket), return_counts=True)
    return keys // BUCKETS, keys % BUCKETS, counts


def packed(of: np.ndarray, bucket: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and, in four bytes, bucket and count of each entry; what a count is above ``MOST`` goes into more entries."""
    parts = -(-counts // MOST)
    turn = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    counts = np.minimum(np.repeat(counts, parts) - turn * MOST, MOST)
    return np.repeat(of, parts), (np.repeat(bucket, parts) * (MOST + 1) + counts).astype(np.uint32)


def sample_bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and count (``packed``) of the n-grams that ``LEAST_DOCS`` texts have, the first of each text's, its number of all n-grams, and in how many texts each bucket occurs.

    Bags are made twice, so that what goes is never held: four bytes an n-gram that stays are all that is.
    """
    seen = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(column), TOGETHER):
        seen += np.bincount(bags(*buffers(column.slice(i, TOGETHER)))[1], minlength=BUCKETS)
    entries, sizes, totals = bytearray(), [], []
    for i in range(0, len(column), TOGETHER):
        block = column.slice(i, TOGETHER)
        of, bucket, counts = bags(*buffers(block))
        totals.append(np.bincount(of, counts, len(block)))
        keep = seen[bucket] >= LEAST_DOCS
        of, entry = packed(of[keep], bucket[keep], counts[keep])
        entries += entry.tobytes()
        sizes.append(np.bincount(of, minlength=len(block)))
    return np.frombuffer(entries, np.uint32), np.append(0, np.cumsum(np.concatenate(sizes))), np.concatenate(totals), seen


def train(texts: list[str] | pa.Array, labels: np.ndarray, seed: int = 42) -> tuple[np.ndarray, float]:
    """Each bucket's share of the margin (toxic minus clean), and the constant."""
    rng = np.random.default_rng(seed)
    weight = np.zeros(BUCKETS, np.float32)
    n = len(texts)
    if n == 0 or labels.min() == labels.max():
        share = float(np.clip(labels.mean() if n else 0.0, 1e-6, 1 - 1e-6))
        return weight, float(np.log(share / (1 - share)))
    entries, first, total, seen = sample_bags(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
    e = (rng.random((BUCKETS, DIM), np.float32) - 0.5) * 0.1 * (seen >= LEAST_DOCS)[:, None].astype(np.float32)
    w = (rng.random((DIM, 2), np.float32) - 0.5)
    c = np.zeros(2, np.float32)
    ge, gw, gc = np.full_like(e, 1e-8), np.full_like(w, 1e-6), np.full_like(c, 1e-6)
    target = np.eye(2, dtype=np.float32)[labels]
    epochs = max(EPOCHS, -(-STEPS * BATCH // n))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            docs = order[i : i + BATCH]
            sizes = first[docs + 1] - first[docs]
            entry = np.repeat(first[docs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            row = np.repeat(np.arange(len(docs)), sizes)
            b, s = entries[entry] // np.uint32(MOST + 1), entries[entry] & np.uint32(MOST)
            s = (s / (total[docs][row] + PAD)).astype(np.float32)
            mean = np.stack([np.bincount(row, e[b, k] * s, len(docs)) for k in range(DIM)], axis=1).astype(np.float32)
            logits = mean @ w + c
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = (p - target[docs]) / len(docs)
            dw, dc, dm = mean.T @ d, d.sum(axis=0), d @ w.T
            for k in range(DIM):
                de = np.bincount(b, dm[row, k] * s, BUCKETS).astype(np.float32) + DECAY * e[:, k] / n
                ge[:, k] += de * de
                e[:, k] -= rate * de / np.sqrt(ge[:, k])
            gw += dw * dw
            gc += dc * dc
            w -= rate * dw / np.sqrt(gw)
            c -= rate * dc / np.sqrt(gc)
    e[seen < LEAST_DOCS] = 0
    return e @ (w[:, 1] - w[:, 0]), float(c[1] - c[0])


def training_sample(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> tuple[pa.Array, np.ndarray]:
    """At most ``TRAIN_ROWS`` texts of the classes with their labels, in a fixed order."""
    known = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("y")).where("y IN (0, 1) AND __key IS NOT NULL").distinct()
    short = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where(F.octet_length(F.coalesce("__text", F.lit(""))) <= TRAIN_BYTES).withColumn("t", F.xxhash64("__text"))
    # of texts under one identifier the one of smallest hash; labels without a short document take no place
    known = written(known.join(short.groupBy("__key").agg(F.min("t").alias("t")), "__key").withColumn("h", F.xxhash64("__key")), "labelled")
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [known.where((F.col("y") == y) & (F.col("h") <= hash_bound(sizes.get(y, 0), k))).orderBy("h", "__key").limit(k) for y, k in enumerate(TRAIN_ROWS)]
    few = parts[0].unionByName(parts[1])  # bounded
    # dealt out into PIECES, so that no task sends the driver one large block
    rows = short.join(F.broadcast(few), ["__key", "t"]).repartition(PIECES, "__key", "y").dropDuplicates(["__key", "y"]).select("y", "h", bag_text(F.col("__text")).alias("t"))
    found = rows.toArrow().sort_by([("h", "ascending"), ("y", "ascending"), ("t", "ascending")])
    texts = found.column("t").cast(pa.large_string()).combine_chunks()
    return texts, found.column("y").to_numpy().astype(np.int64)


def scores(weight: np.ndarray, constant: float, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The probability of the toxic class for each text."""
    total, count = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
    for where, bucket in grams(data):
        sums = np.append(0.0, np.cumsum(weight[bucket], dtype=np.float64))
        edge = np.searchsorted(where, at)
        total += np.diff(sums[edge])
        count += np.diff(edge)
    return 1 / (1 + np.exp(-np.clip(total / (count + PAD) + constant, -500, 500)))


def scored(df: DataFrame, model: tuple[np.ndarray, float], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows ``(key, score)`` with the probability of the toxic class."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(scores(*sent.value, *buffers(batch.column("__text"))))], names=[key, "score"])

    return df.select(F.col(key).cast("long").alias(key), bag_text(F.col(text)).alias("__text")).transform(bounded).mapInArrow(run, f"{key} long, score double")


def toxicity(df: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows ``(key, score, predicted)`` of ``df``, learned from the labelled rows of ``learn_from`` (``df`` if None)."""
    model = train(*training_sample(df if learn_from is None else learn_from, labels, text, key))
    return scored(df, model, text, key).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` that score under ``threshold``, learned from its labelled rows; each row is judged by its own text."""
    sent = df.sparkSession.sparkContext.broadcast(train(*training_sample(df, labels, text, key)))
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__bag"):
                good = scores(*sent.value, *buffers(batch.column("__bag"))) < threshold
                yield batch.select(columns).filter(pa.array(good))

    return df.select("*", bag_text(F.col(text)).alias("__bag")).transform(bounded).mapInArrow(run, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learned from labels with checksum mod 5 other than 0."""
    labels = table(spark, sf_dir, "labels").where(~held_out(0, 5))
    out = toxicity(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", held_out(0, 5).alias("held_out"), "score", "predicted")
