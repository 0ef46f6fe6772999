"""Benchmark decontamination by spaced-seed hashing.

Two fixed masks of span 8 take six of eight neighbouring words and ignore the other two. Together they
hit every window of ``WINDOW`` = 13 words in which at most ``SUBSTITUTIONS`` = 2 words were replaced (a
test tries all placements). The seed hashes of the benchmark are joined with those of the
documents, and each hit is verified on the words around it: a document holds a benchmark passage if
13 aligned words of both, in one piece, agree in all but two places.

Shorter items must occur whole, but for one replaced word from 5 words on (two from 10): the same share as in
a window. Callers who hold short items for noise can set ``least``, the fewest words of an item that is searched. The words of each such length are cut into two groups more than may be wrong, and each way to leave out as many groups as may be
wrong is a mask, so one mask sees none of the replaced words. Of a short item that must
occur unchanged only the first and last place in a document are looked at, so frequent words cost little.

A bitmap of the benchmark's hashes (``BITS`` bits a hash, 16 MB at most whatever the benchmark's size)
is sent to the executors, so that only words around probable hits leave a document's task; all else is
an equi-join on the hash, in which a hash of very many places is split into pieces. Texts are cut into lower-cased runs of letters and digits.

Defined cases: null and empty texts match nothing; equal documents match alike; rows with a null
identifier are reported under null; an empty benchmark or table gives no rows; extra columns are
ignored by ``contamination`` and kept by ``decontaminated``; very long texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import buffers, mix, slices, word_hashes
from .common import bounded, spread_join, table, words_of, written

WINDOW, SUBSTITUTIONS, LEAST, TOLERANT, BITS, MOST_BITS = 13, 2, 1, 5, 11, 27
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN = 2 * (WINDOW - 1) + WINDOW
_U = np.uint64


def seeds(words: np.ndarray, at: np.ndarray, mask: tuple[int, ...], number: int) -> tuple[np.ndarray, np.ndarray]:
    """The seed hashes of a mask and the word positions they start at."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    total = np.full(n, number + 1, _U)
    for k in mask:
        total = (total ^ words[k : k + n]) * _U(0x9E3779B97F4A7C15)
        total ^= total >> _U(29)
    ends = np.repeat(at[1:], np.diff(at))[:n]
    starts = np.flatnonzero(np.arange(n) + mask[-1] < ends)
    return mix(total[starts]), starts


def context(words: np.ndarray, at: np.ndarray, text: np.ndarray, starts: np.ndarray, outside: int) -> list[bytes]:
    """The low halves of the word hashes from ``WINDOW`` - 1 before each start on; ``outside`` stands for words beyond the text."""
    low = (words & _U(0xFFFFFFFF)).astype(np.uint32)
    low[low < 2] = 2
    where = starts[:, None] + np.arange(-(WINDOW - 1), SPAN - WINDOW + 1)
    inside = (where >= at[text][:, None]) & (where < at[text + 1][:, None])
    out = np.where(inside, low[np.clip(where, 0, max(0, len(low) - 1))], np.uint32(outside)).astype("<u4")
    return [row.tobytes() for row in out]


def lengths_of(benchmark: DataFrame, text: str, least: int = LEAST) -> list[int]:
    """The word counts from ``least`` to ``WINDOW`` - 1 that occur in the benchmark (12 values at most)."""
    words = words_of(F.col(text))
    counts = benchmark.select(F.when(words != "", F.size(F.split(words, " "))).alias("n"))
    return sorted(r[0] for r in counts.where((F.col("n") >= max(1, least)) & (F.col("n") < WINDOW)).distinct().collect())


def allowed(n: int) -> int:
    """How many words of a whole item of ``n`` < ``WINDOW`` words may be replaced."""
    return round(SUBSTITUTIONS * n / WINDOW) if n >= TOLERANT else 0


def masks_of(n: int) -> list[tuple[int, ...]]:
    """Masks over a whole item of ``n`` words, of which one misses any ``allowed(n)`` places."""
    if not allowed(n):
        return [tuple(range(n))]
    groups = np.array_split(np.arange(n), allowed(n) + 2)
    return [tuple(int(k) for g in kept for k in g) for kept in combinations(groups, 2)]


def outermost(hashes: np.ndarray, text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of the ``places`` with equal hash in one text the first and the last."""
    order = places[np.lexsort((places, hashes[places], text[places]))]
    new = np.append(True, (hashes[order[1:]] != hashes[order[:-1]]) | (text[order[1:]] != text[order[:-1]]))
    return np.sort(order[new | np.append(new[1:], True)])


def item_seeds(benchmark: DataFrame, masks: list[tuple[int, tuple[int, ...]]], text: str, key: str) -> DataFrame:
    """Rows ``(hash, item_id, item_words, item_at, item_context)`` of every seed of the benchmark; a mask's length is 0 if it serves all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text", 500_000):
                words, at = word_hashes(*buffers(batch.column("__text")))
                ids, sizes = batch.column(key), np.diff(at)
                text_of = np.repeat(np.arange(len(sizes)), sizes)
                for m, (n, mask) in enumerate(masks):
                    hashes, starts = seeds(words, at, mask, m)
                    of = text_of[starts]
                    use = (sizes[of] == n) & (starts == at[of]) if n else (sizes[of] >= WINDOW)
                    hashes, starts, of = hashes[use], starts[use], of[use]
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), ids.take(pa.array(of)), pa.array(sizes[of]), pa.array(starts - at[of]), pa.array(context(words, at, of, starts, 1), pa.binary())], names=["hash", "item_id", "item_words", "item_at", "item_context"])

    return benchmark.select(F.col(key).cast("long").alias(key), words_of(F.col(text)).alias("__text")).transform(bounded).mapInArrow(run, "hash long, item_id long, item_words long, item_at long, item_context binary")


def bitmap(known: DataFrame) -> tuple[bytes, int]:
    """A bitmap of the hashes, made by a grouped OR, and the log2 of its size (which is bounded)."""
    n = known.select(F.approx_count_distinct("hash")).first()[0]
    bits = min(MOST_BITS, max(16, int(n).bit_length() + BITS))
    word, bit = F.shiftrightunsigned("hash", 64 - bits + 6), F.shiftrightunsigned("hash", 64 - bits).bitwiseAND(63).cast("int")
    rows = known.select(word.alias("w"), F.expr("1L").alias("one"), bit.alias("b")).selectExpr("w", "shiftleft(one, b) AS v").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("w").to_numpy()] = rows.column("v").to_numpy()
    return out.tobytes(), bits


def contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", least: int = LEAST) -> DataFrame:
    """Rows ``(key, item_id, matched, first_word, last_word)``, one for each document and item that it holds.

    ``matched`` is the most agreeing words of a window, the others are the span of words, from 0, over all windows.
    """
    masks = [*((0, mask) for mask in MASKS), *((n, mask) for n in lengths_of(benchmark, item_text, least) for mask in masks_of(n))]
    known = written(item_seeds(benchmark, masks, item_text, item_key), "seeds")
    bits, log = bitmap(known)
    sent = df.sparkSession.sparkContext.broadcast(bits)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(sent.value, np.uint8)
        for whole in batches:
            for batch in slices(whole, "__text"):
                words, at = word_hashes(*buffers(batch.column("__text")))
                ids = batch.column(key)
                text_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
                for m, (size, mask) in enumerate(masks):
                    hashes, starts = seeds(words, at, mask, m)
                    places = hashes >> _U(64 - log)
                    maybe = np.flatnonzero(table[places >> _U(3)] >> (places & _U(7)).astype(np.uint8) & 1)
                    if size and not allowed(size) and len(maybe):
                        maybe = outermost(hashes, text_of[starts], maybe)
                    if len(maybe):
                        starts, of = starts[maybe], text_of[starts[maybe]]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array(hashes[maybe].view(np.int64)), pa.array(starts - at[of]), pa.array(context(words, at, of, starts, 0), pa.binary())], names=[key, "hash", "at", "context"])

    schema = pa.schema([(key, pa.int64()), ("item_id", pa.int64()), ("matched", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, item = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, SPAN) for c in ("context", "item_context"))
            same, inside = doc == item, (doc != 0) & (item != 1)
            sums = lambda x, w: np.lib.stride_tricks.sliding_window_view(x, w, axis=1).sum(axis=2)
            sizes = batch.column("item_words").to_numpy()
            agree = np.where(sums(inside, WINDOW) == WINDOW, sums(same, WINDOW), 0)
            good = (agree >= WINDOW - SUBSTITUTIONS) & (sizes >= WINDOW)[:, None]
            at = batch.column("at").to_numpy()
            first = at - (WINDOW - 1) + good.argmax(axis=1)
            last = at - (WINDOW - 1) + good.shape[1] - 1 - good[:, ::-1].argmax(axis=1) + WINDOW - 1
            matched = np.where(good, agree, 0).max(axis=1)
            end = np.minimum(sizes, WINDOW) - 1
            whole, hit = (x[:, WINDOW - 1 :].cumsum(axis=1)[np.arange(len(sizes)), end] for x in (inside, same))
            short = (sizes < WINDOW) & (whole == sizes) & (hit >= sizes - np.array([allowed(n) for n in range(WINDOW + 1)])[end + 1])
            first, last, matched = np.where(short, at, first), np.where(short, at + sizes - 1, last), np.where(short, hit, matched)
            keep = np.flatnonzero(matched > 0)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(keep)), batch.column("item_id").take(pa.array(keep)), *(pa.array(x[keep]) for x in (matched, first, last))], schema=schema)

    found = df.select(F.col(key).cast("long").alias(key), words_of(F.col(text)).alias("__text")).transform(bounded).mapInArrow(hits, f"{key} long, hash long, at long, context binary")
    found = written(found, "hits")
    sizes = found.groupBy("hash").agg(F.count("*").alias("n"))
    pairs = spread_join(found, known.join(sizes, "hash"), "hash", key, found.count())
    # dealt out anew, so that no task holds two Python workers
    pairs = pairs.select(key, "item_id", "item_words", "at", "context", "item_context").repartition(key, "at")
    return pairs.transform(bounded).mapInArrow(verify, f"{key} long, item_id long, matched long, first_word long, last_word long").groupBy(key, "item_id").agg(F.max("matched").alias("matched"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"))


def decontaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """The rows of ``df`` that hold no passage of the benchmark; rows whose key is null are judged together."""
    bad = written(contamination(df, benchmark, text, key, least=least).select(F.col(key).alias("__bad")).distinct(), "contaminated")
    kept = df.where(F.col(key).isNotNull()).join(bad, F.col(key).cast("long") == F.col("__bad"), "left_anti")
    return kept if bad.where("__bad IS NULL").count() else kept.unionByName(df.where(F.col(key).isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
