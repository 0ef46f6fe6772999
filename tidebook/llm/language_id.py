"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed greedily into the
longest phrases that occur in that language's training text; c phrases over n bytes, normalised by
the training size N as c log2(N) / n, estimate the cross entropy in bits a byte. The language with
the fewest normalised phrases wins (ties: the smaller name).

The automaton and the restart at its root make a complete automaton (state, byte) -> (state, phrases
ended), so whole texts run through one table lookup a byte and language, in lockstep over many
blocks. Texts are cut into blocks of ``BLOCK`` bytes; a phrase may not span two blocks.

Training text is a bounded sample: the ``TRAIN_DOCS`` distinct labelled texts (letters only) a language with the
smallest hashes, until ``TRAIN_BYTES`` are reached; of a text of ``TRAIN_BYTES`` // 4 bytes or more an excerpt below that, at a hashed
place, is taken. So every language with a labelled letter is learned. Only this sample is sent to the executors: the model holds one automaton
a language, so its size grows with the number of labelled languages (some 10 MB each), not with the rows.

Defined cases: a text that is null or has no letter gets ``und`` and score 0; without any labelled
text all get ``und``; rows without language are not learned from; bytes never seen in training are
phrases of their own; a null identifier is kept and predicted; very long texts are parsed whole; an empty table gives an empty result; extra
columns are ignored, equal rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bytesops import buffers, slices, walk
from .common import bounded, letters_of, table

TRAIN_DOCS, TRAIN_BYTES, BLOCK, SHIFT = 64, 32768, 1024, 2


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


@lru_cache(maxsize=2)
def parsers(samples: tuple[tuple[str, bytes], ...]) -> tuple[np.ndarray, int, list[tuple[str, np.ndarray, float]]]:
    """Byte classes, their number, and each language's table and log2 of its training size."""
    seen = sorted(set(b"".join(text for _, text in samples)))
    classes = np.zeros(256, np.int64)
    classes[seen] = np.arange(1, len(seen) + 1)
    width, out = len(seen) + 1, []
    for lang, text in samples:
        automaton = suffix_automaton(text)
        start = np.ones(width, np.int32)  # a byte that is unknown at the root: one phrase, stay there
        for c, to in automaton[0].items():
            start[classes[c]] = (to * width) << SHIFT
        moves = np.tile(start + 1, (len(automaton), 1))  # a phrase ends, and the byte starts the next
        moves[0] = start
        at = np.repeat(np.arange(len(automaton)), [len(x) for x in automaton])
        key = np.fromiter((c for x in automaton for c in x), np.int64, len(at))
        to = np.fromiter((t for x in automaton for t in x.values()), np.int64, len(at))
        moves[at, classes[key]] = (to * width) << SHIFT
        out.append((lang, moves.ravel(), float(np.log2(len(text) + 1))))
    return classes, width, out


def excerpt(text: Column, most: int) -> Column:
    """``text``, or about ``most`` (and no more) bytes of it from a hashed place on."""
    size = F.length(text)
    n = F.floor(size * F.lit(float(most)) / F.octet_length(text)).cast("int")
    piece = F.substring(text, (F.pmod(F.xxhash64(text, F.lit(1)), size - n + 1) + 1).cast("int"), n)
    return F.when(F.octet_length(text) <= most, text).when(F.octet_length(piece) <= most, piece).otherwise(F.substring(piece, 1, most // 4))


def training_sample(df: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id") -> tuple[tuple[str, bytes], ...]:
    """The bounded training text of each language (at most ``TRAIN_BYTES`` bytes)."""
    rows = df.select(F.col(lang).cast("string").alias("lang"), letters_of(F.col(text)).alias("t")).where("lang IS NOT NULL AND t <> ''").withColumn("h", F.xxhash64("t"))
    counts = rows.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    k = 4 * TRAIN_DOCS
    share = F.least(F.lit(1.0), (k + 8 * k**0.5 + 16) / F.col("n"))  # all but surely at least k hashes are below it
    rows = rows.join(F.broadcast(counts), "lang").where(F.col("h") / 2.0**64 + 0.5 <= share).withColumn("t", excerpt(F.col("t"), TRAIN_BYTES // 4 - 1)).dropDuplicates(["lang", "h"])
    least = rows.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "t"))).where(F.col("k") <= TRAIN_DOCS)
    run = least.withColumn("sum", F.sum(F.octet_length("t") + 1).over(W.partitionBy("lang").orderBy("k")))
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in run.where(F.col("sum") <= TRAIN_BYTES).select("lang", "k", "t").collect():
        texts.setdefault(r["lang"], []).append((r["k"], r["t"]))
    return tuple((lang, " ".join(t for _, t in sorted(texts[lang])).encode()) for lang in sorted(texts))


def phrases(samples: tuple[tuple[str, bytes], ...], data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Normalised phrases (bits a byte) of each text (rows) and language (columns)."""
    classes, width, langs = parsers(samples)
    sizes = np.diff(at)
    parts = np.maximum(1, -(-sizes // BLOCK))
    of = np.repeat(np.arange(len(sizes)), parts)
    k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = at[:-1][of] + k * BLOCK
    lengths = np.minimum(BLOCK, at[1:][of] - starts)
    out = np.zeros((len(sizes), len(langs)))
    for j, (_, moves, log) in enumerate(langs):
        ended, state = walk(moves, width, SHIFT, classes, data, starts, lengths)
        out[:, j] = np.bincount(of, ended + (state > 0), len(sizes)) * log
    return out / np.maximum(sizes, 1)[:, None]


def identified(df: DataFrame, samples: tuple[tuple[str, bytes], ...], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows ``(key, lang_pred, score, bits)``: the best language, its lead over the next (0 to 1), its bits a byte."""
    names = np.array([lang for lang, _ in samples] + ["und"], dtype=object)
    sent = df.sparkSession.sparkContext.broadcast(samples)
    schema = pa.schema([(key, pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text", 4_000_000):
                data, at = buffers(batch.column("__text"))
                best = np.full(batch.num_rows, len(names) - 1)
                score, bits = np.zeros(batch.num_rows), np.full(batch.num_rows, np.nan)
                if sent.value and batch.num_rows:
                    x = phrases(sent.value, data, at)
                    has, order = np.diff(at) > 0, np.sort(x, axis=1)
                    best = np.where(has, x.argmin(axis=1), best)
                    lead = 1 - order[:, 0] / np.maximum(order[:, 1], 1e-12) if x.shape[1] > 1 else np.ones(len(x))
                    score, bits = np.where(has, np.clip(lead, 0, 1), 0.0), np.where(has, order[:, 0], np.nan)
                yield pa.RecordBatch.from_arrays([batch.column(key).cast(pa.int64()), pa.array(names[best], pa.string()), pa.array(score), pa.array(bits, from_pandas=True)], schema=schema)

    return df.select(key, letters_of(F.col(text)).alias("__text")).transform(bounded).mapInArrow(run, f"{key} long, lang_pred string, score double, bits double")


def held_out(remainder: int, of: int, key: str = "doc_id") -> Column:
    """Whether the checksum of the identifier as text leaves this remainder."""
    return F.coalesce(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % of == remainder, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from those with checksum mod 4 other than 2."""
    docs = table(spark, sf_dir, "documents")
    out = identified(docs, training_sample(docs.where(~held_out(2, 4))))
    return out.select("doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score", "bits")
