"""Near duplicates, sharding, mixing, table files and the pipeline against plain versions."""

import io
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidebook.llm import embedding_dedup, mixing, near_duplicates, sharding, token_tables
from tidebook.llm.common import components

from .helpers import awkward, nothing, prose, words

DATA = "/root/testdata/sf0.001"


def linked(ids, edges):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    ids = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()}
    assert got == linked(ids, [(a, b) for a, b in edges if a != b])


def bag(text):
    w = words(text)
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def test_signatures_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 400, 40)
    items, of, w = rng.integers(0, 2**44, sizes.sum()).astype(np.uint64), np.repeat(np.arange(40), sizes), rng.integers(1, 6, sizes.sum())
    together = near_duplicates.bag_minhash(items, of, w, 40)
    alone = [near_duplicates.bag_minhash(items[of == k], np.zeros(sizes[k], int), w[of == k], 1) for k in range(40)]
    assert (together == np.concatenate(alone)).all()


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    for _ in range(5):
        wa, wb = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
        items = np.arange(60).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        keep = np.concatenate([items[wa > 0], items[wb > 0]])
        of = np.concatenate([np.zeros((wa > 0).sum(), int), np.ones((wb > 0).sum(), int)])
        r = near_duplicates.bag_minhash(keep, of, np.concatenate([wa[wa > 0], wb[wb > 0]]), 2, 4096)
        want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        assert abs((r[0] == r[1]).mean() - want) < 5 * math.sqrt(want * (1 - want) / 4096) + 1e-3


def plain_groups(rows):
    bags = {i: bag(t) for i, t in rows}
    ids = sorted(bags)
    return linked(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if bags[a] and bags[b] and jaccard(bags[a], bags[b]) >= 0.8 - 1e-9])


def test_near_duplicates(spark):
    rng = random.Random(2)
    base = prose(7, 200).split()
    rows = []
    for i in range(120):  # copies of one base, which link through it more than with one another
        w = list(base)
        for k in rng.sample(range(200), 4 + i % 3):
            w[k] = f"e{i}x{k}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000, " ".join(base)), (2001, "a b"), (2002, "A, b!"), (2003, "b a")] + [(3000 + i, prose(100 + i, 80)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(df).collect()}
    assert got == plain_groups(rows)
    kept = near_duplicates.deduplicated(df)
    assert {r["doc_id"] for r in kept.collect()} == set(got.values())
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(docs).collect()} == plain_groups([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_near_duplicate_cases(spark):
    df = awkward(spark)
    out = near_duplicates.near_duplicates(df).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == 15 and {got[i]["component_id"] for i in (5, 6, 7, 8, 13)} == {5} and all(got[i]["kept"] for i in (0, 1, 2, 3, 4, 9, 11, 12, None))
    kept = near_duplicates.deduplicated(df)
    assert kept.columns == df.columns and kept.count() == 15 - 5
    assert near_duplicates.near_duplicates(nothing(spark)).count() == 0 and near_duplicates.deduplicated(nothing(spark)).count() == 0


@pytest.mark.parametrize("dim", [384, 1024])
def test_forest_copies_and_recall(dim):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((16_384, dim))
    a = embedding_dedup.unit(x[:800])
    z = rng.standard_normal(a.shape)
    z = embedding_dedup.unit(z - (z * a).sum(axis=1, keepdims=True) * a)
    b = 0.951 * a + math.sqrt(1 - 0.951**2) * z  # pairs at cosine 0.951
    x, met, copies = embedding_dedup.unit(x), np.zeros(800, bool), []
    for tree in range(embedding_dedup.TREES):
        cuts = embedding_dedup.fitted(x, tree, 0, 11)
        row, _, done = embedding_dedup.descended(x, tree, 0, cuts)
        copies.append(len(row) / len(x))
        deeper = [embedding_dedup.descended(v, tree, 0, cuts) for v in (a, b)]
        one, two = (set(zip(r.tolist(), n.tolist())) for r, n, _ in deeper)
        met[[r for r, _ in one & two]] = True
        assert not done.any()
    assert max(copies) <= 6 and met.mean() >= 0.98


def test_dense_vectors_are_not_split():
    rng = np.random.default_rng(9)
    x = embedding_dedup.unit(np.ones(64) + rng.standard_normal((500, 64)) * 0.01)
    row, node, done = embedding_dedup.descended(x, 0, 0, embedding_dedup.fitted(x, 0, 0, 5))
    assert len(row) == 500 and done.all() and set(node) == {0}


@pytest.mark.parametrize("block, leaf, big, sample", [(1024, 256, 4096, 16_384), (16, 64, 60, 64)])
def test_embeddings(spark, monkeypatch, block, leaf, big, sample):
    for name, value in (("BLOCK", block), ("LEAF", leaf), ("BIG", big), ("SAMPLE", sample), ("PIECE", 200)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 24)).astype(np.float32)
    for i in range(0, 300, 3):
        x[i + 1] = x[i] + rng.standard_normal(24) * 0.25
        x[i + 2] = x[i + 1] * 2
    x[400:440] = x[400] + rng.standard_normal((40, 24)) * 0.1
    x[500:520] = x[500]
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(9001, None, 1), (9002, [0.0] * 24, 1), (9003, [float("nan")] * 24, 1), (9004, [None] * 24, 1), (9005, [], 1), (9006, [float("inf")] * 24, 1), (None, x[0].tolist(), 1), (9007, [1.0, 2.0], 1), (9008, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int")
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_duplicates(df).collect()}
    comp = linked(range(700), zip(*np.nonzero(near)))
    n = np.array([got[i]["n_links"] for i in range(700)])
    assert n.sum() >= 0.97 * near.sum() and (n <= near.sum(axis=1)).all()
    assert np.mean([got[i]["component_id"] == comp[i] for i in range(700)]) >= 0.99
    for i in (9001, 9002, 9003, 9004, 9005, 9006, None):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert got[9008]["component_id"] == 9007 and got[9007]["n_links"] == 1
    assert embedding_dedup.embedding_duplicates(df.limit(0)).count() == 0


def test_sharding(spark):
    for n in (1, 2, 3, 100, 1000):
        import pandas as pd

        assert sorted(sharding.permuted(pd.Series(range(n)), n)) == list(range(n))
    df = awkward(spark)
    out = sharding.feistel_shards(df, 4, "doc_id", "text").collect()
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(out) == 15 and all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.feistel_shards(nothing(spark), 4, "doc_id").count() == 0
    got = sharding.query(spark, DATA).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got)


@pytest.mark.parametrize("module, query", [(sharding, sharding.query_nocrc), (mixing, mixing.query)])
def test_sql(spark, module, query):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = c.sql(module.oracle()).df()
    got = query(spark, DATA).toPandas()
    cols = sorted(want.columns)
    key = lambda df: sorted(map(tuple, df[cols].astype(str).itertuples(index=False)))
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)


def test_mixing(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id < 3000 THEN 'big' WHEN id < 3990 THEN 'mid' ELSE NULL END AS source", "9 AS copy")
    out = mixing.poisson_mix(df, {"big": 1, "mid": 2, None: 1})
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    for source, want in (("big", 1000), ("mid", 2000), (None, 1000)):
        assert abs(n[source] - want) < 5 * math.sqrt(want)
    counts = [r["count"] for r in out.where("source = 'mid'").groupBy("doc_id").count().collect()]
    zero = 990 - len(counts)
    assert abs(zero - 990 * math.exp(-2000 / 990)) < 5 * math.sqrt(990 * 0.13 * 0.87)  # the Poisson share of nought
    keys = [r["shuffle_key"] for r in out.collect()]
    assert keys == sorted(keys) and out.columns == ["doc_id", "source", "copy", "shuffle_key"]
    assert mixing.poisson_mix(df, {"mid": 1}).where("source IS NULL OR source = 'big'").count() == 0
    clash = spark.createDataFrame([(i, "x" * (i * 1000), "s", 1, 2, 3, 4) for i in range(9)] + [(None, None, None, 1, 2, 3, 4)] * 2, "doc_id long, text string, source string, ladder int, parts int, n int, rate int")
    assert mixing.poisson_mix(clash).columns == [*clash.columns, "copy", "shuffle_key"] and mixing.poisson_mix(clash).where("ladder = 1 AND parts = 2 AND n = 3 AND rate = 4").count() == mixing.poisson_mix(clash).count()
    assert mixing.poisson_mix(awkward(spark)).columns[:5] == corpus_pipeline.COLUMNS and mixing.poisson_mix(nothing(spark)).count() == 0


def test_mixing_small_sources_reach_their_weight(spark):
    df = spark.range(50_000).selectExpr("id AS doc_id", "CASE WHEN id < 10 THEN 'small' WHEN id = 10 THEN 'one' ELSE 'big' END AS source")
    out = mixing.poisson_mix(df, {"small": 2, "one": 1, "big": 1})
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    for source, want in (("small", 25_000), ("one", 12_500), ("big", 12_500)):
        assert abs(n[source] - want) < 5 * math.sqrt(want)
    each = out.where("source <> 'big'").groupBy("doc_id").agg(F.max("copy").alias("last"), F.count("*").alias("n")).collect()
    assert len(each) == 11 and all(r["last"] == r["n"] - 1 for r in each) and len({r["n"] for r in each}) > 5
    assert out.select("doc_id", "copy").distinct().count() == sum(n.values())
    assert {r["source"]: round(r["rate"]) for r in mixing.rates(df, {"small": 2, "one": 1, "big": 1}).collect()} == {"small": 2500, "one": 12_500, "big": 0}


def test_mixing_of_equal_weights_in_sql(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text", "'x' AS lang", "CASE WHEN id < 4 THEN 'tiny' WHEN id < 6 THEN NULL ELSE 'big' END AS source", "1L AS n_chars")
    want = df.toPandas()
    c = duckdb.connect()
    c.register("documents", want)
    rows = c.sql(mixing.oracle(0.0)).df()
    out = mixing.poisson_mix(df, power=0.0).toPandas()
    key = lambda t: sorted(zip(t["doc_id"], t["copy"], t["shuffle_key"]))
    assert key(rows) == key(out)
    n = out.groupby(out["source"].fillna("none")).size()
    assert all(abs(n[s] - 20_000 / 3) < 5 * math.sqrt(20_000 / 3) for s in ("tiny", "none", "big"))


def test_table_file():
    rng = random.Random(6)
    keys = sorted([None, None, -5] + [rng.randrange(-(10**6), 10**6) for _ in range(5000)] + [77] * 40, key=token_tables.key_of)
    rows = [(k, bytes(rng.randrange(256) for _ in range(2 * rng.randrange(0, 40)))) for k in keys]
    out = io.BytesIO()
    w = token_tables.Writer(out)
    for k, v in rows:
        w.add(token_tables.key_of(k), v)
    w.close()
    r = token_tables.Reader(io.BytesIO(out.getvalue()))
    assert [(token_tables.id_of(k), v) for k, v in r.scan()] == rows and r.entries == len(rows) and len(r.places) > 3
    for k in [None, -5, 77, *rng.sample([k for k in keys if k is not None], 200)]:
        assert r.get(token_tables.key_of(k)) == [v for x, v in rows if x == k]
    absent = [k for k in range(-500, 500) if k not in set(keys)]
    assert all(r.get(token_tables.key_of(k)) == [] for k in absent)
    assert np.mean([r.may_hold(token_tables.key_of(k)) for k in range(2 * 10**6, 2 * 10**6 + 2000)]) < 0.05
    with pytest.raises(ValueError):
        w.add(b"", b"")


def test_token_tables(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(token_tables.VOCABULARY))
    odd = [(50, "a  b   c \n\n d\t e "), (51, " lead"), (52, "x <|endoftext|> y"), (53, "it's 12,345.67 ok… “q” don't!!"), (54, "日本 語   nbsp　wide"), (55, "\n\n\n"), (56, "end  ")]
    df = awkward(spark, odd)
    rows = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: token_tables.key_of(r[0]))
    want, start = [], 0
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_tables.token_tables(df).collect()), key=lambda r: r[1]) == want
    assert token_tables.token_tables(nothing(spark)).count() == 0


def test_encoder_is_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_tables.VOCABULARY)
    plain, encoder = Tokenizer.from_file(path), token_tables.encoder(path)
    assert encoder.by_words
    rng = random.Random(11)
    parts = ["a", "Word", " ", "  ", "\n", "\n\n", "\t", "'s", "don't", "12", "3,4.5", "…", "é", "ñandú", "日本", "🎉", "<|endoftext|>", "\u00a0", "\u3000", "_", "--", "!?", "x1y2", "'", "“q”", "\r\n", "ß", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    bad = [t for t in texts if encoder(t) != token_tables.packed(plain.encode(t, add_special_tokens=False).ids + [0])]
    assert not bad
    other = token_tables.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.by_words and other("It's  a Test") == token_tables.packed(whole.encode("It's  a Test", add_special_tokens=False).ids + [0])


def test_texts_just_under_the_threshold(spark):
    base = prose(21, 60).split()
    rows = []
    for i in range(300):  # pairs differ in two of sixty words: about 0.7 of their shingles agree
        w = list(base)
        w[10 + i % 40] = f"e{i}"
        rows.append((i, " ".join(w)))
    want = plain_groups(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(df).collect()} == want


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA).collect()
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, DATA)
    assert kept.columns == corpus_pipeline.COLUMNS
    one = stages["near_duplicates"](spark, kept, DATA).collect()
    groups = plain_groups([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert {r["doc_id"] for r in one} == set(groups.values())
    assert out and sorted(r["start"] for r in out) == list(np.cumsum([0] + [r["n_tokens"] for r in sorted(out, key=lambda r: r["start"])])[:-1])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    bench = [(1, prose(77, 16, 9000)), (2, "three odd words")]
    more = [(60 + i, prose(900 + i, 50)) for i in range(20)] + [(90, f"{prose(7, 30)} {bench[0][1]} {prose(8, 30)}"), (91, "they say three odd words often"), (None, prose(31, 40)), (92, prose(61, 70_000, 3000))]
    for name, df in (("documents", awkward(spark, more)), ("labels", spark.createDataFrame([(i, 0) for i in range(4, 80)] + [(None, 1)], "doc_id long, toxic int")), ("benchmark", spark.createDataFrame(bench, "item_id long, text string"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = docs if not kept else spark.read.parquet(str(tmp_path / list(kept)[-1]))
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns == corpus_pipeline.COLUMNS
        kept[name] = out.collect()
    assert len(kept["toxicity"]) == 15 + len(more)  # no toxic label, so nothing is toxic
    texts = {r["doc_id"]: r["text"] for r in kept["toxicity"] if r["doc_id"] is not None}
    groups = plain_groups(sorted(texts.items()))
    assert {r["doc_id"] for r in kept["near_duplicates"]} - {None} == set(groups.values())
    assert sum(r["doc_id"] is None for r in kept["near_duplicates"]) == 2
    before = {r["doc_id"] for r in kept["near_duplicates"]}
    assert before - {r["doc_id"] for r in kept["decontamination"]} == {90, 91}
    n, sources = len(kept["decontamination"]), Counter(r["source"] for r in kept["decontamination"])
    rates = {s: math.sqrt(k) / sum(map(math.sqrt, sources.values())) * n / k for s, k in sources.items()}
    want = Counter()
    for r in kept["decontamination"]:
        import hashlib

        key = "42|" + ("" if r["doc_id"] is None else str(r["doc_id"]))
        u, rate = (int(hashlib.md5(key.encode()).hexdigest()[:12], 16) + 0.5) / 16**12, rates[r["source"]]
        p = c = math.exp(-rate)
        k = 0
        while c < u:
            k, p = k + 1, p * rate / (k + 1)
            c += p
        want[r["doc_id"]] += k
    assert Counter(r["doc_id"] for r in kept["mixing"]) == +want
    plain, start, rows = Tokenizer.from_file(public_tokenizers.path(token_tables.VOCABULARY)), 0, []
    for i, t in sorted(((r["doc_id"], r["text"]) for r in kept["mixing"]), key=lambda r: (token_tables.key_of(r[0]), r[1] or "")):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        rows.append((i, start, len(ids)))
        start += len(ids)
    last = corpus_pipeline.STAGES[-1][1](spark, spark.read.parquet(str(tmp_path / "mixing")), str(tmp_path)).collect()
    assert sorted((r["start"], r["doc_id"]) for r in last if r["doc_id"] is not None) == [(s, i) for i, s, _ in rows if i is not None] and sum(r["n_tokens"] for r in last) == start


def test_near_duplicates_take_few_jobs(spark):
    # of each exchange the driver keeps a thread and a stage for a while: with many of them the pipeline's driver outgrew its memory
    rows = [(i, prose(i, 40)) for i in range(30)] + [(30 + i, prose(i, 40) + " end") for i in range(10)]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few jobs", "near duplicates")
    try:
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == plain_groups(rows)
    assert len(tracker.getJobIdsForGroup("few jobs")) <= 110


def test_components_of_nothing_and_of_stars(spark):
    assert components(spark.createDataFrame([(3, 3), (None, 1)], "a long, b long")).count() == 0
    star = [(1, 7 + i) for i in range(2500)]  # more than HOT_ROWS links of one node
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert got == {1: 1} | {b: 1 for _, b in star}
    late = [(9000, i) for i in range(2, 2500)]  # the centre is the largest
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(late, "a long, b long")).collect()}
    assert got == {9000: 2} | {b: 2 for _, b in late}
