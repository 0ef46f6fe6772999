"""Masked pseudo-likelihood of texts under a bidirectional window network trained in numpy.

Every word of a text is predicted from the ``SIDE`` words on either side of it; a text's score is the sum
of the conditional log-probabilities of all its words. The network has an embedding a word, one hidden layer over
the concatenated window, and a two-step softmax (a word's class, then the word in its class), so a
prediction costs ``CLASSES`` + ``WORDS`` outputs instead of their product.

Vocabulary: the most frequent words of the whole corpus, counted over all documents, in order of count, dealt into ``CLASSES`` classes
of ``WORDS``; words beyond it share ``WORDS`` hashed entries of the network, the last class. Output biases start from the
corpus counts, so the untrained network is the unigram model.

Words that share an entry are told apart by their own counts, all of which are kept: the log-probability of a word is that of its
entry plus log(n(word) / (n(entry) + ``UNSEEN``)); all words that the corpus lacks count as one of ``UNSEEN`` occurrences. Words that make
up at least 1 / ``KNOWN`` of the corpus (so at most ``KNOWN`` words) are looked up inside tasks, the others are joined with the table
of counts. That table, of one row a distinct word, is what is gathered, and grows with the corpus.

Encoding. Texts are cut into words once; their ids (two bytes a word) are written, and training and scoring read these.

Training: documents are dealt by a hash into shards of about ``SHARD_WORDS`` words, so there are more shards in a larger corpus, and
each shard's documents are taken in order of the hash. In each of ``ROUNDS`` rounds every shard trains the network, from the last
round's average, on all its documents: of each run of ``MASK`` words one is masked (at a hashed place, another one in each round) and predicted. The shards' weights
are averaged, weighted by predictions, by sums of ``FAN`` arrays at a time in order of shard. What is gathered besides the counts is one array a shard.
Neither shards nor order nor sums depend on how the input is split into files or tasks, so the scores don't.

Defined cases: texts that are null or have no word have 0 words, log-probability 0 and no mean; an empty corpus gives the
uniform model; very long texts are trained and scored whole, in pieces of bounded memory; null identifiers and repeated rows are scored like
others; extra columns are ignored; equal texts get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import buffers, mix, slices, word_hashes
from .common import bounded, table, words_of, written

CLASSES, WORDS, SIDE, DIM, HIDDEN = 64, 64, 2, 16, 24
MASK, ROUNDS, FIRST_BATCH, BATCH, RATE, SEED, HELD = 8, 2, 256, 4096, 0.05, 42, 1_000_000
SHARD_WORDS, CHUNK, FAN = 4_000_000, 65_536, 16
VOCABULARY = CLASSES * WORDS
KNOWN, UNSEEN, SCALE = 1 << 20, 0.5, 1e9
SAFE = 600
_U = np.uint64
SHAPES = {"e": (VOCABULARY + 1, DIM), "w": (2 * SIDE * DIM, HIDDEN), "b": (HIDDEN,), "c": (HIDDEN, CLASSES), "cb": (CLASSES,), "o": (CLASSES, HIDDEN, WORDS), "ob": (CLASSES, WORDS)}


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows ``(word, n)`` with the hash and count of every word; tasks combine before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            words, back = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            return words, np.bincount(back, np.concatenate([n for _, n in held]), len(words)).astype(np.int64)

        def rows(words: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 50_000].view(np.int64)), pa.array(n[i : i + 50_000])], names=["word", "n"])

        for whole in batches:
            for batch in slices(whole, "__words"):
                held.append(np.unique(word_hashes(*buffers(batch.column("__words")))[0], return_counts=True))
                if sum(len(w) for w, _ in held) > HELD:
                    held = [merged()]
                    if len(held[0][0]) > HELD // 2:
                        yield from rows(*held[0])
                        held = []
        if held:
            yield from rows(*merged())

    return df.select(words_of(F.col(text)).alias("__words")).transform(bounded).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def entry(hashes: np.ndarray) -> np.ndarray:
    """The shared entry, from 0, of each word without an entry of its own."""
    return (mix(hashes + _U(77)) % _U(WORDS)).astype(np.int64)


def places(words: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each hash stands in the sorted ``words``, and whether it does."""
    if not len(words):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return at, words[at] == hashes


class Vocabulary:
    """Ids of words by their hashes, the corpus counts of the ids, and the counts of the known words that share an id."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, rest: np.ndarray, known: np.ndarray, known_counts: np.ndarray) -> None:
        order = np.argsort(words)
        self.words, self.ids = words[order], order
        self.counts = np.full(VOCABULARY, 0.5)
        self.counts[: len(words)] += counts
        self.counts[VOCABULARY - WORDS :] += rest
        order = np.argsort(known)
        self.known, self.logs = known[order], np.log(known_counts[order])
        self.rest = np.log(rest + UNSEEN)
        self.total = int(counts.sum() + rest.sum())  # words of the corpus

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        """The id of each word."""
        at, own = places(self.words, hashes)
        return np.where(own, self.ids[at] if len(self.ids) else 0, VOCABULARY - WORDS + entry(hashes))

    def within(self, hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log-probability of each word within its id, and the places of the words whose log count is still to be added."""
        out = np.zeros(len(ids))
        rare = np.flatnonzero(ids >= VOCABULARY - WORDS)
        at, found = places(self.known, hashes[rare])
        out[rare] = -self.rest[ids[rare] - (VOCABULARY - WORDS)]
        out[rare[found]] += self.logs[at[found]]
        return out, rare[~found]


def vocabulary(df: DataFrame, text: str = "text", counts: DataFrame | None = None) -> Vocabulary:
    """The most frequent words over all rows, from their written ``counts`` (at most ``KNOWN`` + ``VOCABULARY`` rows reach the driver)."""
    counts = written(word_counts(df, text), "counts") if counts is None else counts
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY - WORDS).collect()
    words, n = np.array([r["word"] for r in top], np.int64).view(_U), np.array([r["n"] for r in top], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(WORDS)
        for batch in batches:
            out += np.bincount(entry(batch.column("word").to_numpy().view(_U)), batch.column("n").to_numpy(), WORDS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(WORDS)), pa.array(out.astype(np.int64))], names=["i", "n"])

    rest = np.zeros(WORDS)
    for r in counts.mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        rest[r["i"]] = r["n"]
    known = counts.where(F.col("n") * KNOWN >= int(rest.sum())).toArrow()
    return Vocabulary(words, n, rest - np.bincount(entry(words), n, WORDS), known.column("word").to_numpy().view(_U), known.column("n").to_numpy())


def fresh(counts: np.ndarray, seed: int = SEED) -> dict[str, np.ndarray]:
    """The network before training: small random weights, biases from the counts."""
    rng = np.random.default_rng(seed)
    net = {k: (rng.standard_normal(s) * (0.3 if k in "ew" else 0.0)).astype(np.float32) for k, s in SHAPES.items()}
    net["w"] *= np.float32(0.5)
    net["e"][VOCABULARY] = 0
    p = counts.reshape(CLASSES, WORDS)
    net["cb"] = np.log(p.sum(axis=1) / p.sum()).astype(np.float32)
    net["ob"] = np.log(p / p.sum(axis=1, keepdims=True)).astype(np.float32)
    return net


def neighbours(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids with room for ``SIDE`` ids ``VOCABULARY`` on both sides of each text, and each id's place there."""
    place = np.arange(len(ids)) + np.repeat(np.arange(len(at) - 1) * 2 * SIDE + SIDE, np.diff(at))
    room = np.full(len(ids) + 2 * SIDE * (len(at) - 1), VOCABULARY, np.int64)
    room[place] = ids
    return room, place


def windows(room: np.ndarray, place: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The ids around each place; beyond the text's ends the id ``VOCABULARY``."""
    p = place[where]
    return np.stack([room[p + d] for d in range(-SIDE, SIDE + 1) if d], axis=1)


def softmax(x: np.ndarray) -> np.ndarray:
    """Log-softmax along the last axis."""
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def forward(net: dict[str, np.ndarray], ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, hidden layer and class log-probabilities."""
    x = net["e"][ctx].reshape(len(ctx), -1)
    h = np.maximum(x @ net["w"] + net["b"], 0)
    return x, h, softmax(h @ net["c"] + net["cb"])


def by_class(target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The classes that occur and the places of each."""
    kind = target // WORDS
    order = np.argsort(kind.astype(np.int8), kind="stable")
    edge = np.searchsorted(kind[order], np.arange(CLASSES + 1))
    for c in range(CLASSES):
        if edge[c] < edge[c + 1]:
            yield c, order[edge[c] : edge[c + 1]]


def turned(net: dict[str, np.ndarray]) -> list[np.ndarray]:
    """What each id adds to the hidden layer from each place of the window: worked out once a network, so that a prediction adds rows instead of multiplying by ``w``."""
    return [net["e"] @ w for w in net["w"].reshape(2 * SIDE, DIM, HIDDEN)]


def log_probabilities(net: dict[str, np.ndarray], ctx: np.ndarray, target: np.ndarray, inputs: list[np.ndarray] | None = None) -> np.ndarray:
    """The conditional log-probability of each target; ``inputs`` are the network's ``turned`` embeddings."""
    inputs = turned(net) if inputs is None else inputs
    h = inputs[0].take(ctx[:, 0], axis=0)
    for k in range(1, len(inputs)):
        h += inputs[k].take(ctx[:, k], axis=0)
    h += net["b"]
    np.maximum(h, 0, out=h)

    def picked(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not -SAFE < x.min() <= x.max() < SAFE:  # else exponentials neither overflow nor vanish
            x -= x.max(axis=1, keepdims=True)
        chosen = x[np.arange(len(x)), at]
        return chosen - np.log(np.exp(x, out=x) @ np.ones(x.shape[1]))

    out = picked(h @ net["c"] + net["cb"], target // WORDS).astype(np.float64)
    for c, rows in by_class(target):
        out[rows] += picked(h[rows] @ net["o"][c] + net["ob"][c], target[rows] % WORDS)
    return out


def step(net: dict[str, np.ndarray], sums: dict[str, np.ndarray], ctx: np.ndarray, target: np.ndarray) -> None:
    """One AdaGrad step on a batch; only the embeddings of the batch's ids change."""
    n = len(target)
    x, h, lp = forward(net, ctx)
    d = np.exp(lp)
    d[np.arange(n), target // WORDS] -= 1
    g = {"c": h.T @ d, "cb": d.sum(axis=0), "o": np.zeros_like(net["o"]), "ob": np.zeros_like(net["ob"])}
    dh = d @ net["c"].T
    for c, rows in by_class(target):
        own = h[rows]
        q = np.exp(softmax(own @ net["o"][c] + net["ob"][c]))
        q[np.arange(len(rows)), target[rows] % WORDS] -= 1
        g["o"][c], g["ob"][c] = own.T @ q, q.sum(axis=0)
        dh[rows] += q @ net["o"][c].T
    dh *= h > 0
    g["w"], g["b"] = x.T @ dh, dh.sum(axis=0)
    flat = ctx.ravel()
    order = np.argsort(flat.astype(np.uint16), kind="stable")
    edge = np.flatnonzero(np.diff(flat[order], prepend=-1))
    used = flat[order][edge]
    ge = np.add.reduceat((dh @ net["w"].T).reshape(-1, DIM)[order], edge, axis=0) / np.float32(n)
    ge[used == VOCABULARY] = 0
    sums["e"][used] += ge * ge
    net["e"][used] -= np.float32(RATE) * ge / np.sqrt(sums["e"][used])
    for k, v in g.items():
        v /= n
        sums[k] += v * v
        net[k] -= np.float32(RATE) * v / np.sqrt(sums[k])


def packed(net: dict[str, np.ndarray]) -> np.ndarray:
    """All weights in one row."""
    return np.concatenate([net[k].ravel() for k in SHAPES])


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The network of a row of weights."""
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def encoded(df: DataFrame, words: Vocabulary, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows ``(row, key, n_words, digest, ids, base, far)``, written: the ids of the words (two bytes each), the sum of the log-probabilities of known words
    within their ids, and the hashes of the words whose counts are still to be joined."""
    sent = df.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for whole in batches:
            for batch in slices(whole, "__words"):
                hashes, at = word_hashes(*buffers(batch.column("__words")))
                ids, n = known.encode(hashes), np.diff(at)
                each, far = known.within(hashes, ids)
                base = np.bincount(np.repeat(np.arange(len(n)), n), each, len(n)).astype(float)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(far, at).astype(np.int32)), pa.array(hashes[far].view(np.int64)))
                short = ids.astype("<u2")
                rows = pa.array([short[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("__row"), batch.column(key), pa.array(n), batch.column("digest"), rows, pa.array(base), lists], names=["row", key, "n_words", "digest", "ids", "base", "far"])

    rows = df.select(F.monotonically_increasing_id().alias("__row"), F.col(key).cast("long").alias(key), words_of(F.col(text)).alias("__words")).withColumn("digest", F.xxhash64("__words", key))
    return written(rows.transform(bounded).mapInArrow(run, f"row long, {key} long, n_words long, digest long, ids binary, base double, far array<long>"), "encoded")


def flat_ids(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some texts in one array, and the offsets of each text's."""
    return np.frombuffer(b"".join(rows), "<u2").astype(np.int64), np.append(0, np.cumsum([len(r) // 2 for r in rows], dtype=np.int64))


def masked(ids: np.ndarray, at: np.ndarray, turn: int) -> np.ndarray:
    """One place of each run of ``MASK`` words of a text, chosen by a hash of its words and another one in each round, in hashed order."""
    lead = np.repeat(at[:-1], np.diff(at))
    lead = np.flatnonzero((np.arange(len(ids)) - lead) % MASK == 0)
    size = np.minimum(MASK, np.repeat(at[1:], np.diff(at))[lead] - lead)
    where = lead + ((mix(ids[lead].astype(_U) + lead.astype(_U) * _U(77) + _U(5)) % _U(MASK)).astype(np.int64) + turn * MASK // ROUNDS) % size
    return where[np.argsort(mix(ids[where].astype(_U) ^ where.astype(_U)))]


def shard_rows(rows: DataFrame, start: dict[str, np.ndarray], turn: int) -> DataFrame:
    """Rows ``(shard, seen, net)``: the network that each shard trains from ``start``, times its number of predictions; ``rows`` are sorted by shard."""
    sent = rows.sparkSession.sparkContext.broadcast(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = None, [], 0
        net, sums, seen = {}, {}, 0

        def learn() -> int:
            ids, edges = flat_ids(held)
            where, around = masked(ids, edges, turn), neighbours(ids, edges)
            at = 0
            while at < len(where):  # the first batches of a shard are small, so that small corpora are learned too
                part = where[at : at + min(BATCH, max(FIRST_BATCH, (seen + at) // 16))]
                step(net, sums, windows(*around, part), ids[part])
                at += len(part)
            return len(where)

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([float(seen)]), pa.array([(packed(net).astype(np.float64) * seen).tobytes()], pa.binary())], names=["shard", "seen", "net"])

        for batch in batches:
            for own, row in zip(batch.column("shard").to_pylist(), batch.column("ids")):
                if own != shard:
                    if held:
                        seen += learn()
                    if shard is not None:
                        yield result()
                    shard, held, size, seen = own, [], 0, 0
                    net, sums = {k: v.copy() for k, v in sent.value.items()}, {k: np.full(s, 1e-6, np.float32) for k, s in SHAPES.items()}
                held.append(row.as_py())
                size += len(held[-1]) // 2
                if size >= CHUNK:
                    seen += learn()
                    held, size = [], 0
        if held:
            seen += learn()
        if shard is not None:
            yield result()

    return rows.transform(bounded).mapInArrow(run, "shard long, seen double, net binary")


def added(rows: DataFrame) -> DataFrame:
    """The sums of ``FAN`` shards' rows each, added in order of shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, seen, total = None, 0.0, None
        for batch in batches:
            for own, n, net in zip(*(batch.column(c) for c in ("group", "seen", "net"))):
                x = np.frombuffer(net.as_py(), np.float64)
                if own.as_py() != group:
                    if total is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([seen]), pa.array([total.tobytes()], pa.binary())], names=["shard", "seen", "net"])
                    group, seen, total = own.as_py(), 0.0, np.zeros(len(x))
                seen, total = seen + n.as_py(), total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([seen]), pa.array([total.tobytes()], pa.binary())], names=["shard", "seen", "net"])

    grouped = rows.withColumn("group", F.floor(F.col("shard") / FAN)).repartition("group").sortWithinPartitions("group", "shard")
    return grouped.transform(bounded).mapInArrow(run, "shard long, seen double, net binary")


def trained(ids: DataFrame, words: Vocabulary) -> dict[str, np.ndarray]:
    """The network after ``ROUNDS`` rounds over all ``encoded`` rows."""
    shards = max(1, -(-words.total // SHARD_WORDS))
    rows = ids.where("n_words > 0").select(F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard"), "digest", "ids")
    net = fresh(words.counts)
    for turn in range(ROUNDS):
        found, left = shard_rows(rows.repartition("shard").sortWithinPartitions("shard", "digest", "ids"), net, turn), shards
        while left > FAN:
            found, left = added(found), -(-left // FAN)
        parts = sorted(found.collect(), key=lambda r: r["shard"])  # at most FAN arrays
        if not parts:
            break
        net = unpacked(sum(np.frombuffer(r["net"], np.float64) for r in parts) / sum(r["seen"] for r in parts))
    return net


def scored(ids: DataFrame, net: dict[str, np.ndarray], key: str = "doc_id", counts: DataFrame | None = None) -> DataFrame:
    """Rows ``(key, n_words, log_prob, mean_log_prob)`` of ``encoded`` rows; without the ``counts`` of words, of the network's ids only."""
    sent = ids.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = {k: v.astype(np.float64) for k, v in sent.value.items()}
        inputs = turned(model)
        for whole in batches:
            sizes = np.cumsum(whole.column("n_words").to_numpy())
            first = 0
            while first < whole.num_rows:
                last = max(first + 1, int(np.searchsorted(sizes, sizes[first] + CHUNK, "right")))
                batch = whole.slice(first, last - first)
                first = last
                flat, at = flat_ids(batch.column("ids").to_pylist())
                each = np.zeros(len(flat))
                around = neighbours(flat, at)
                for i in range(0, len(flat), 16_384):
                    where = np.arange(i, min(len(flat), i + 16_384))
                    each[where] = log_probabilities(model, windows(*around, where), flat[where], inputs)
                n = np.diff(at)
                # double precision, rounded, so that equal texts get equal sums in any block
                total = np.round(np.bincount(np.repeat(np.arange(len(n)), n), each, len(n)).astype(float), 6)
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column(key), pa.array(n), pa.array(total)], names=["row", key, "n_words", "log_prob"])

    out = ids.select("row", key, "n_words", "ids").transform(bounded).mapInArrow(run, f"row long, {key} long, n_words long, log_prob double")
    if counts is not None:
        logs = ids.select("row", F.explode("far").alias("word")).join(counts, "word", "left").select("row", F.round(F.log(F.coalesce("n", F.lit(UNSEEN))) * SCALE).cast("long").alias("v"))
        # whole numbers, so that equal texts get equal sums in any order
        logs = logs.groupBy("row").agg(F.sum("v").alias("v"))
        rest = ids.select("row", "base").join(logs, "row", "left").select("row", (F.col("base") + F.coalesce("v", F.lit(0)) / SCALE).alias("rest"))
        out = out.join(rest, "row").withColumn("log_prob", F.col("log_prob") + F.col("rest"))
    return out.select(key, "n_words", "log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("mean_log_prob"))


def pseudo_likelihood(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Train on ``df`` and score every row of it."""
    counts = written(word_counts(df, text), "counts")
    words = vocabulary(df, text, counts)
    ids = encoded(df, words, text, key)
    return scored(ids, trained(ids, words), key, counts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's masked pseudo-likelihood under a network trained on all documents."""
    return pseudo_likelihood(table(spark, sf_dir, "documents"))
