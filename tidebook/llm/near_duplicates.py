"""Near duplicates of texts by BagMinHash signatures of their word shingles.

A text is the multiset of its runs of ``SIZE`` = 5 words (lower-cased runs of letters and digits; a
text of fewer words has one shingle, all of them). Two texts are linked if the weighted Jaccard
similarity of their multisets is ``SIMILARITY`` = 0.8 or more; linked texts form components.

Signatures. Each shingle owns Poisson processes over its weight axis, cut at 1, 2, 4, 8, ...: the process
of an interval has its length as rate, and each of its points has a register, an arrival time and a
weight level. A text of weight w takes the points with levels up to w, drawn from the intervals below w
only, and keeps each register's earliest time. Two texts agree on a register with a probability equal
to their weighted Jaccard similarity. A process ends once it is later than all the text's registers.

Search. Texts with equal words are one class, of which one text goes on. ``BANDS`` bands of ``ROWS``
registers are hashed; a pair at 0.8 misses all bands with probability 3e-5. A pair is a candidate if it shares a bucket and agrees
on ``AGREE`` or more registers (at 0.8 all but 1 in 10,000 do), and is verified by counting the shingles of both whole texts.
(1) In each bucket every text is paired with the one that shares most buckets with others, which takes one pair a text however large the
bucket. (2) Buckets whose texts are not yet in one component are compared by registers alone, in pairs of blocks (``blocks_of``); what
comes out are the texts that have a candidate of another component. (3) Only these texts are fetched, dealt into blocks of
about ``BLOCK_BYTES``, and each two blocks of a bucket are verified in one task; a pair is skipped once other links have joined it.

Cost. Steps 1 and 2 move each text once and each signature once a block. Step 3 moves a bucket's remaining texts as often as
they fill blocks: a bucket of texts that all lie just under the threshold is compared whole, with bytes x bytes / ``BLOCK_BYTES``
moved, the least for comparing all pairs in bounded memory. No bucket is capped and only links that join components are written.

Defined cases: rows whose text is null or has no word, or whose identifier is null, are linked with
nothing and kept; rows with one identifier count as one document; very long texts are signed whole and compared in blocks of their own; of texts that
meet equally many others the one of smallest identifier is the centre; extra columns are ignored by
``near_duplicates`` and kept by ``deduplicated``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import buffers, mix, runs, shingles, slices, word_hashes
from .common import bounded, components, hot_from, spread_join, table, words_of, written
from .decontamination import bitmap

SIZE, SIMILARITY, BANDS, ROWS, AGREE, BLOCK, BLOCKS, MOST_BLOCK, BLOCK_BYTES = 5, 0.8, 20, 4, 50, 256, 64, 16_384, 8_000_000
REGISTERS = BANDS * ROWS
POINTS = 32_768  # drawn at once for all processes, beyond one each
_U = np.uint64
_LOW = _U((1 << 44) - 1)


def weighted(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles as 44-bit hashes, the text of each and its weight, in order of text and hash."""
    keys = np.sort((of.astype(_U) << _U(44)) | (hashes & _LOW))
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    return keys[at] & _LOW, (keys[at] >> _U(44)).astype(np.int64), np.diff(np.append(at, len(keys)))


def bag_minhash(items: np.ndarray, of: np.ndarray, weights: np.ndarray, texts: int, m: int = REGISTERS) -> np.ndarray:
    """The ``m`` earliest arrival times of each text; infinity in texts without items."""
    registers = np.full(texts * m, np.inf)
    octaves = np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) + 1
    take = np.repeat(np.arange(len(items)), octaves)
    octave = np.arange(len(take)) - np.repeat(np.cumsum(octaves) - octaves, octaves)
    length = np.where(octave > 0, 2.0 ** (octave - 1), 1.0)
    floor, limit = np.where(octave > 0, length, 0.0), weights[take].astype(float)
    text = of[take]
    stream = mix(items[take] ^ (octave.astype(_U) * _U(0xD1B54A32D192ED03)))
    time, count, turn = np.zeros(len(take)), np.zeros(len(take), np.int64), 0
    while len(take):
        points = 1 if turn < 2 else int(np.clip(POINTS // len(take), 1, 16))
        draw = mix(stream[:, None] + (count[:, None] + np.arange(1, points + 1)).astype(_U) * _U(0x9E3779B97F4A7C15))
        # added one by one, so that times don't depend on how many points are drawn at once
        steps = -np.log1p(-(draw >> _U(11)).astype(float) * 2.0**-53) / length[:, None]
        at = np.cumsum(np.concatenate([time[:, None], steps], axis=1), axis=1)[:, 1:]
        more = mix(draw ^ _U(0xA0761D6478BD642F))
        level = np.ceil(floor[:, None] + length[:, None] * (((more >> _U(32)).astype(float) + 0.5) * 2.0**-32))
        slot = text[:, None] * m + (more & _U(0xFFFFFFFF)).astype(np.int64) * m // (1 << 32)
        use = level <= limit[:, None]
        np.minimum.at(registers, slot[use], at[use])
        time, count, turn = at[:, -1], count + points, turn + 1
        live = time < registers.reshape(texts, m).max(axis=1)[text]
        stream, time, count, length, floor, limit, text, take = (x[live] for x in (stream, time, count, length, floor, limit, text, take))
    return registers.reshape(texts, m)


def signatures(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows ``(key, digest, bytes, bands, registers)`` of the texts that have a word and an identifier."""
    schema = pa.schema([(key, pa.int64()), ("digest", pa.string()), ("bytes", pa.int64()), ("bands", pa.list_(pa.int64())), ("registers", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__words"):
                data, at = buffers(batch.column("__words"))
                hashes, of = shingles(*word_hashes(data, at), SIZE)
                times = bag_minhash(*weighted(hashes, of), batch.num_rows)
                codes = mix(times.view(_U))
                bands = np.full((len(codes), BANDS), 1, _U) * (np.arange(1, BANDS + 1, dtype=_U))
                for k in range(ROWS):
                    bands = (bands ^ codes[:, k::ROWS]) * _U(0x9E3779B97F4A7C15)
                    bands ^= bands >> _U(31)
                flat = pa.array(mix(bands).view(np.int64).ravel())
                small = (codes >> _U(32)).astype("<u4")
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("digest"), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * BANDS), flat), pa.array([r.tobytes() for r in small], pa.binary())], schema=schema)

    rows = df.select(F.col(key).cast("long").alias(key), words_of(F.col(text)).alias("__words")).where((F.col("__words") != "") & F.col(key).isNotNull())
    return rows.withColumn("digest", F.md5("__words")).transform(bounded).mapInArrow(run, f"{key} long, digest string, bytes long, bands array<long>, registers binary")


def ends(pairs: DataFrame, values: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` with the ``columns`` of both ends, named with ``_a`` and ``_b``; ``values`` is keyed by ``id``. Ends of very many pairs are no single task's group."""
    both = pairs.select(F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.col(side).alias("id")) for side in "ab"))).alias("end"))
    found = both.groupBy("end").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    total, largest = (found[0] or 0) // 2, found[1] or 0
    counts = {side: pairs.groupBy(side).agg(F.count("*").alias("n")) for side in "ab"}
    for side, other in ("ab", "ba"):
        own = values.select(F.col("id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))
        own = own.join(counts[side], side) if largest > hot_from(total) else own
        pairs = spread_join(pairs, own, side, other, total, largest)
    return pairs


def agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that agree on ``AGREE`` or more registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(batch.num_rows, -1) for c in ("registers_a", "registers_b"))
                yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= AGREE))

    return ends(pairs, classes, "registers").select("a", "b", "registers_a", "registers_b").transform(bounded).mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose weighted Jaccard similarity is high enough; ``texts`` has ``(id, words)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for half in slices(whole, "words_a"):
                for batch in slices(half, "words_b"):
                    sides = [weighted(*shingles(*word_hashes(*buffers(batch.column(c))), SIZE)) for c in ("words_a", "words_b")]
                    (ka, ta, na), (kb, tb, nb) = sides
                    n = batch.num_rows
                    _, ia, ib = np.intersect1d(ka | (ta.astype(_U) << _U(44)), kb | (tb.astype(_U) << _U(44)), assume_unique=True, return_indices=True)
                    both = np.bincount(ta[ia], np.minimum(na[ia], nb[ib]), n)
                    either = np.bincount(ta, na, n) + np.bincount(tb, nb, n) - both
                    keep = np.flatnonzero(both >= SIMILARITY * either - 1e-9)
                    yield batch.select(["a", "b"]).take(pa.array(keep))

    return ends(pairs, texts, "words").select("a", "b", "words_a", "words_b").transform(bounded).mapInArrow(run, "a long, b long")


def elements(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' multisets as sets, the k-th equal shingle counting as one of its own; offsets of each text's, sorted. Worked out in pieces, so that only the elements stay in memory."""
    found, counts = [], []
    for piece in slices(pa.RecordBatch.from_arrays([column], names=["words"]), "words"):
        items, of, weights = weighted(*shingles(*word_hashes(*buffers(piece.column(0))), SIZE))
        repeat = np.repeat(np.arange(len(items)), weights)
        turn = np.arange(len(repeat)) - np.repeat(np.cumsum(weights) - weights, weights)
        keys = mix(items[repeat] + turn.astype(_U) * _U(0xD1B54A32D192ED03))
        found.append(keys[np.lexsort((keys, of[repeat]))])
        counts.append(np.bincount(of[repeat], minlength=piece.num_rows))
    return np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def dealt(rows: DataFrame, blocks: str) -> DataFrame:
    """``rows`` once for each pair of blocks ``(i, j)`` of their bucket that holds their ``own`` block."""
    n = F.col(blocks)
    out = rows.withColumn("own", F.pmod(F.xxhash64("id"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    out = out.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", blocks)
    return out.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").transform(bounded)


def blocks_of(n: Column) -> Column:
    """Into how many blocks ``n`` rows are cut: of ``BLOCK`` rows, but at most ``BLOCKS`` as long as these have at most ``MOST_BLOCK`` rows."""
    return F.greatest(F.ceil(n / MOST_BLOCK), F.least(F.ceil(n / BLOCK), F.lit(BLOCKS))).cast("int")


def rivals(part: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a block pair the rows of other components that agree on ``AGREE`` registers, each pair once and in its first common band only."""
    i, j, band = (part.column(c)[0].as_py() for c in ("i", "j", "band"))
    own, ids, comp = (part.column(c).to_numpy() for c in ("own", "id", "component"))
    regs = np.frombuffer(b"".join(part.column("registers").to_pylist()), "<u4").reshape(len(ids), -1)
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    small = (regs & 255).astype(np.uint8)  # a first look at a quarter of the bytes: equal registers have equal low bytes
    for x in left:
        ys = right[(comp[right] != comp[x]) & ((ids[right] > ids[x]) if i == j else True)]
        ys = ys[(small[ys] == small[x]).sum(axis=1, dtype=np.uint8) >= AGREE]
        same = regs[ys] == regs[x]
        ys, same = ys[keep := same.sum(axis=1) >= AGREE], same[keep]
        ys = ys[same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band]
        if len(ys):
            yield int(x), ys


def contested(rows: DataFrame) -> DataFrame:
    """The ``(bucket, id)`` of rows with a candidate of another component; ``rows`` has ``(bucket, band, n, id, component, registers)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "bucket", "i", "j"):
            part, found = part.combine_chunks(), set()
            for x, ys in rivals(part):
                found.add(x)
                found.update(ys.tolist())
            if found:
                yield part.select(["bucket", "id"]).take(sorted(found)).combine_chunks().to_batches()[0]

    blocks = blocks_of(F.col("n"))
    return dealt(rows.withColumn("blocks", blocks).drop("n"), "blocks").mapInArrow(run, "bucket long, id long").distinct()


def across(rows: DataFrame) -> DataFrame:
    """Links between components, as ``(a, b)`` of components; ``rows`` has ``(bucket, band, blocks, id, component, registers, words)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "bucket", "i", "j"):
            part = part.combine_chunks()
            comp, sets, at = part.column("component").to_numpy(), None, None
            now = {int(c): int(c) for c in comp}  # components as joined here so far

            def root(c: int) -> int:
                while now[c] != c:
                    now[c] = c = now[now[c]]
                return c

            for x, ys in rivals(part):
                if sets is None:
                    sets, at = elements(part.column("words").combine_chunks())
                mine = sets[at[x] : at[x + 1]]
                for y in ys.tolist():
                    a, b = root(int(comp[x])), root(int(comp[y]))
                    theirs = sets[at[y] : at[y + 1]]
                    if a == b or min(len(mine), len(theirs)) < SIMILARITY * max(len(mine), len(theirs)) - 1e-9:
                        continue
                    both = np.count_nonzero(mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs)
                    if both >= SIMILARITY * (len(mine) + len(theirs) - both) - 1e-9:
                        now[max(a, b)] = min(a, b)
                        yield pa.RecordBatch.from_arrays([pa.array([min(a, b)]), pa.array([max(a, b)])], names=["a", "b"])

    return dealt(rows, "blocks").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows ``(key, exact_id, component_id, kept)``, one for each row of ``df``.

    ``exact_id`` is the smallest identifier with the same words, ``component_id`` the smallest one reachable by links.
    """
    signed = written(signatures(df, text, key), "signatures")
    firsts = (F.first(c).alias(c) for c in ("bytes", "bands", "registers"))
    classes = written(signed.groupBy("digest").agg(F.min(key).alias("id"), F.count("*").alias("n"), *firsts), "classes")
    n_classes, n_signed, most_copies = (n or 0 for n in classes.agg(F.count("*"), F.sum("n"), F.max("n")).first())
    rows = classes.select("id", F.posexplode("bands").alias("band", "bucket"))
    sizes = written(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("size", F.col("n")), "sizes")
    n_met, most_met = (n or 0 for n in sizes.agg(F.sum("n"), F.max("n")).first())
    met = written(spread_join(rows, sizes, "bucket", "id", BANDS * n_classes, most_met), "buckets")

    # a text that meets most others is likely the one that its group's copies were made from
    degrees = met.groupBy("id").agg(F.sum("size").alias("degree"))
    shared = met.select("bucket", "id").join(degrees, "id")
    centres = shared.groupBy("bucket").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("centre"), F.count("*").alias("n"))
    stars = spread_join(met.select("bucket", "id"), centres, "bucket", "id", n_met, most_met).where("id <> centre")
    stars = written(stars.select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    near = written(agreeing(stars, classes), "candidates")
    links = written(verified(near, texts_of(df, near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), text, key)), "links")
    first = components(links)

    placed = written(met.join(first, "id", "left").select("bucket", "band", "id", F.coalesce("component", "id").alias("component")), "placed")
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x <> y").select("bucket", "n", F.col("n").alias("size"))
    rest = written(spread_join(placed, open_, "bucket", "id", n_met, most_met).withColumnRenamed("size", "n"), "open")
    hits = written(contested(rest.join(classes.select("id", "registers"), "id")), "contested")
    every = classes.select("digest", F.col("id").alias("exact_id"), "n").join(first.withColumnRenamed("id", "exact_id"), "exact_id", "left")
    every = written(every.withColumn("joined", F.coalesce("component", "exact_id")).drop("component"), "joined")
    if not hits.isEmpty():
        texts = texts_of(df, hits.select("id").distinct(), text, key)
        fights = written(hits.join(rest.drop("n"), ["bucket", "id"]).join(classes.select("id", "bytes", "registers"), "id"), "fights")
        blocks = F.greatest(F.ceil(F.sum("bytes") / BLOCK_BYTES), blocks_of(F.count("*"))).cast("int")
        sized = fights.groupBy("bucket").agg(blocks.alias("blocks"), F.count("*").alias("n"))
        more = written(across(spread_join(fights.drop("bytes"), sized, "bucket", "id", n_met, most_met).join(texts, "id")), "links")
        every = rejoined(every, more, n_classes)
    members = spread_join(signed.select(F.col(key).alias("__key"), "digest"), every, "digest", "__key", n_signed, most_copies).groupBy("__key")
    members = members.agg(F.min("exact_id").alias("exact_id"), F.min("joined").alias("component_id"))
    own = df.select(F.col(key).cast("long").alias(key))
    known = own.where(F.col(key).isNotNull()).join(members, F.col(key) == F.col("__key"), "left")
    known = known.select(key, F.coalesce("exact_id", key).alias("exact_id"), F.coalesce("component_id", key).alias("component_id"))
    missing = own.where(F.col(key).isNull()).select(key, F.col(key).alias("exact_id"), F.col(key).alias("component_id"))
    return known.unionByName(missing).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def rejoined(every: DataFrame, links: DataFrame, total: int) -> DataFrame:
    """``every`` with the column ``joined``, a component, led through the ``links`` between components; ``total`` is its number of rows."""
    second = components(links).select(F.col("id").alias("joined"), F.col("component").alias("now"))
    groups = every.groupBy("joined").agg(F.count("*").alias("n")).join(second, "joined", "left")
    found = spread_join(every.withColumnRenamed("n", "copies"), groups, "joined", "exact_id", total)
    return found.select("digest", "exact_id", F.coalesce("now", "joined").alias("joined"), F.col("copies").alias("n"))


def texts_of(df: DataFrame, wanted: DataFrame, text: str, key: str) -> DataFrame:
    """Rows ``(id, words)`` of the ``wanted`` identifiers.

    A bitmap of their hashes (16 MB at most, whatever their number) goes to all tasks, which drop the texts that it rules out before the shuffle; the
    rest is joined exactly.
    """
    wanted = written(wanted, "wanted")
    bits, log = bitmap(wanted.select(F.xxhash64("id").alias("hash")))
    sent = df.sparkSession.sparkContext.broadcast(bits)

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitset = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            places = batch.column("hash").to_numpy().view(_U) >> _U(64 - log)
            found = bitset[places >> _U(3)] >> (places & _U(7)).astype(np.uint8) & 1
            yield batch.select(["id", "__text"]).filter(pa.array(found.astype(bool)))

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("__text")).where("id IS NOT NULL").withColumn("hash", F.xxhash64("id"))
    near = rows.transform(bounded).mapInArrow(maybe, "id long, __text string")
    found = near.join(wanted, "id", "left_semi")
    return written(found.dropDuplicates(["id"]).select("id", words_of(F.col("__text")).alias("words")), "texts")


def deduplicated(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` with one document of each component, that of the smallest identifier."""
    out = written(near_duplicates(df, text, key).where(~F.col("kept")).select(F.col(key).alias("__out")).distinct(), "dropped")
    kept = df.where(F.col(key).isNotNull()).join(out, F.col(key).cast("long") == F.col("__out"), "left_anti")
    return kept.unionByName(df.where(F.col(key).isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
