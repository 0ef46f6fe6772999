"""Token counts, languages, toxicity, language model, decontamination against plain versions."""

import collections
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tidebook.llm import decontamination, language_id, masked_lm, token_counts, toxicity
from tidebook.llm.bytesops import buffers, runs, shingles, word_hashes

from .helpers import awkward, nothing, prose, words

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_words_and_shingles():
    texts = ["", "a", "a b c d e f", "a b c d e", "x y", "b c d e f"]
    h, at = word_hashes(*buffers(pa.array(texts)))
    assert np.diff(at).tolist() == [len(t.split()) for t in texts]
    assert h[at[1]] == h[at[2]] and h[at[2] + 1] == h[at[5]]
    s, of = shingles(h, at, 5)
    assert sorted(of.tolist()) == [1, 2, 2, 3, 4, 5] and len(set(s.tolist())) == 4


def test_runs():
    b = pa.record_batch({"k": [1, 1, 2], "v": [1, 2, 3]}), pa.record_batch({"k": [2, 3, 3], "v": [4, 5, 6]}), pa.record_batch({"k": [3, 4], "v": [7, 8]})
    assert [t.column("v").to_pylist() for t in runs(iter(b), "k")] == [[1, 2], [3, 4], [5, 6, 7], [8]]


def plain_count(text, pieces, longest):
    n = 0
    for word in (text or "").split():
        raw, i = b" " + word.encode(), 0
        while i < len(raw):
            k = min(longest, len(raw) - i)
            while raw[i : i + k] not in pieces:
                k -= 1
            i, n = i + k, n + 1
    return n


def test_token_counts(spark, docs):
    pieces = set(token_counts.vocabulary()) | {bytes([c]) for c in range(256)}
    longest = max(map(len, pieces))
    for df in (docs.limit(60), awkward(spark, [(20, "x" * 5000), (21, "▁ ▁a 🎉🎉 \x01")])):
        got = sorted((r["n_tokens"] for r in token_counts.token_counts(df).collect()))
        assert got == sorted(plain_count(r["text"], pieces, longest) for r in df.collect())
    assert token_counts.token_counts(nothing(spark)).count() == 0
    spaced = spark.createDataFrame([(1, "a\u00a0b"), (2, "\u3000a\u2003b \x1c c\x85"), (3, "\u00a0\u2028")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(spaced).collect()}
    assert [got[i][0] for i in (1, 2, 3)] == [2, 3, 0] and all(got[r["doc_id"]][1] == plain_count(r["text"], pieces, longest) for r in spaced.collect())


def test_automaton_on_random_vocabularies():
    rng = random.Random(3)
    for _ in range(30):
        pieces = {"".join(rng.choice(" ab") if k == 0 else rng.choice("ab") for k in range(rng.randint(1, 7))).encode() for _ in range(12)}
        auto = token_counts.Automaton(sorted(pieces))
        texts = [" ".join([""] + ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 5))]) for _ in range(40)]
        known = pieces | {bytes([c]) for c in range(256)}
        assert auto.counts(*buffers(pa.array(texts))).tolist() == [plain_count(t, known, 8) for t in texts]


def test_language_parse_is_the_plain_one():
    samples = (("a", b"the cat sat on the mat and the dog"), ("b", b"le chat est sur le tapis et le chien"))
    texts = ["the chat sat", "zzz", "le tapis the mat " * 200, "q"]
    got = language_id.phrases(samples, *buffers(pa.array(texts)))
    for text, row in zip(texts, got):
        raw = text.encode()
        for (_, train), bits in zip(samples, row):
            n = 0
            for block in (raw[i : i + language_id.BLOCK] for i in range(0, len(raw), language_id.BLOCK)):
                i = 0
                while i < len(block):
                    k = 0
                    while i + k < len(block) and block[i : i + k + 1] in train:
                        k += 1
                    i, n = i + max(k, 1), n + 1
            assert math.isclose(bits, n * math.log2(len(train) + 1) / len(raw))


def test_language_accuracy_and_cases(spark, docs):
    train = language_id.training_sample(docs.where(~language_id.held_out(2, 4)))
    assert all(len(t) <= language_id.TRAIN_BYTES for _, t in train)
    rows = language_id.identified(docs, train).join(docs, "doc_id").where(language_id.held_out(2, 4)).select("lang", "lang_pred", "score").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.97 and all(0 <= r["score"] <= 1 for r in rows)
    got = {r["doc_id"]: r for r in language_id.identified(awkward(spark), train).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 3, 11)] == ["und"] * 5 and got[4]["lang_pred"] != "und" and got[0]["score"] == 0
    assert {r["lang_pred"] for r in language_id.identified(awkward(spark), language_id.training_sample(nothing(spark))).collect()} == {"und"}
    assert language_id.identified(nothing(spark), train).count() == 0


def test_language_of_long_or_repeated_texts_is_learned(spark):
    rng = random.Random(8)
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))
    same = text("pqrs", 100)
    rows = [(i, text("abcd", 4000), "long") for i in range(6)] + [(10 + i, text("日本語x", 4000), "wide") for i in range(6)]
    rows += [(100 + i, same.upper() if i % 2 else same, "copies") for i in range(2000)] + [(3000 + i, text("ijkl", 60), "copies") for i in range(5)]
    rows += [(4000 + i, "123 !", "none") for i in range(500)] + [(5000, text("tuvw", 50), "none")]
    train = dict(language_id.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert set(train) == {"long", "wide", "copies", "none"} and all(len(t) <= language_id.TRAIN_BYTES for t in train.values())
    assert len(train["long"]) > 30_000 and len(train["wide"]) > 8_000 and train["wide"].decode()
    assert train["copies"].decode().count(same) == 1 and all(r[1].encode() in train["copies"] for r in rows if r[0] in range(3000, 3005))
    new = spark.createDataFrame([(1, text("abcd", 30)), (2, text("日本語x", 30)), (3, text("ijkl", 30)), (4, text("tuvw", 30))], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identified(new, tuple(sorted(train.items()))).collect()}
    assert got == {1: "long", 2: "wide", 3: "copies", 4: "none"}


def test_toxicity(spark):
    rng = random.Random(5)
    bad = ["grimbol", "snarfex", "wozzlet"]
    rows, labels = [], []
    for i in range(600):
        w = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnpr')}{rng.choice(['a', 'en', 'is'])}" for _ in range(rng.randint(40, 80))]
        if i % 3 == 0:
            for k in rng.sample(range(len(w)), 3):
                w[k] = rng.choice(bad) + rng.choice(["", "", "s", "ed"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(df, lab.where("doc_id % 5 <> 0")).collect()
    held = [r for r in out if r["doc_id"] % 5 == 0]
    assert np.mean([(r["doc_id"] % 3 == 0) == bool(r["predicted"]) for r in held]) >= 0.95
    seen = df.where("doc_id % 5 <> 0")
    misspelt = spark.createDataFrame([(1, rows[1][1] + " grimbool snarfexx wozlet grimbol"), (2, rows[1][1])], "doc_id long, text string")
    a, b = (r["score"] for r in toxicity.toxicity(misspelt, lab, seen).orderBy("doc_id").collect())
    assert a > b
    got = toxicity.toxicity(awkward(spark), lab, seen).collect()
    assert len(got) == 15 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(awkward(spark), lab.where("toxic = 0"), seen).where("predicted = 1").count() == 0
    kept = toxicity.accepted(awkward(spark), lab.where("toxic = 0"))
    assert kept.columns == awkward(spark).columns and kept.count() == 15
    assert toxicity.accepted(nothing(spark), lab).count() == 0


def bucket_of(gram):
    """The bucket of an n-gram by its definition: a polynomial of letter hashes, finished with the size."""
    mask, odd = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    total = sum(mix((c + 1) * odd & mask) * pow(odd, k, 1 << 64) for k, c in enumerate(gram)) & mask
    return mix((total + len(gram)) & mask) % toxicity.BUCKETS


def test_toxicity_sample_and_scores_are_the_plain_ones(spark):
    rng = random.Random(6)
    rows = [(i, prose(i, rng.randint(5, 40)), None) for i in range(300)] + [(7, "another text", None), (7, "another text", None), (400, "x" * 30_000, None), (401, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t long")
    lab = spark.createDataFrame([(i, i % 2) for i in range(0, 5000)] + [(7, 1), (7, 0)], "doc_id long, toxic int")
    texts, y = toxicity.training_sample(df, lab)
    known = [i for i in range(300)]
    assert len(texts) == 302 and sorted(y.tolist()) == sorted([i % 2 for i in known] + [0, 1])  # 401: an empty text; 7: both labels, one text
    weight, constant = toxicity.train(texts, y)
    got = {(r["doc_id"], round(r["score"], 9)) for r in toxicity.scored(df, (weight, constant)).collect()}
    want = set()
    for i, text, _ in rows:
        padded = f" {' '.join(words(text))} ".encode() if words(text) else b""
        total = count = 0
        for n in toxicity.SIZES:
            for k in range(len(padded) - n + 1):
                if b" " not in padded[k + 1 : k + n - 1]:
                    count += 1
                    total += float(weight[bucket_of(padded[k : k + n])])
        want.add((i, round(1 / (1 + math.exp(-(total / (count + toxicity.PAD) + constant))), 9)))
    assert got == want


def test_language_model(spark, docs):
    model = masked_lm.vocabulary(docs)
    net = masked_lm.trained(masked_lm.encoded(docs, model), model)
    df = docs.limit(20)
    got = {r["doc_id"]: r for r in masked_lm.scored(masked_lm.encoded(df, model), net).collect()}
    total = count = uniform = 0
    for r in df.collect():
        ids = model.encode(word_hashes(*buffers(pa.array([" ".join(words(r["text"]))])))[0])
        want = 0.0
        for i, t in enumerate(ids):
            ctx = [int(ids[i + d]) if 0 <= i + d < len(ids) else masked_lm.VOCABULARY for d in (-2, -1, 1, 2)]
            h = np.maximum(net["e"][ctx].reshape(-1) @ net["w"] + net["b"], 0)
            c = masked_lm.softmax(h @ net["c"] + net["cb"])[t // masked_lm.WORDS]
            want += float(c + masked_lm.softmax(h @ net["o"][t // masked_lm.WORDS] + net["ob"][t // masked_lm.WORDS])[t % masked_lm.WORDS])
        assert got[r["doc_id"]]["n_words"] == len(ids) and math.isclose(got[r["doc_id"]]["log_prob"], want, rel_tol=1e-3)
        total, count = total + want, count + len(ids)
        p = model.counts / model.counts.sum()
        uniform += float(np.log(p[ids]).sum())
    assert total > uniform  # better than the unigram model it starts from
    rows = {r["doc_id"]: r for r in masked_lm.pseudo_likelihood(awkward(spark)).collect()}
    assert rows[0]["log_prob"] == 0 and rows[1]["n_words"] == 0 and rows[3]["mean_log_prob"] is None and rows[5]["log_prob"] == rows[6]["log_prob"]
    assert masked_lm.pseudo_likelihood(nothing(spark)).count() == 0


def test_language_model_tells_rare_words_apart(spark, monkeypatch):
    rare = [f"r{i}q" for i in range(3000)]
    rows = [(i, f"{prose(i, 40, 1500)} {' '.join(rare[i::50])} {' '.join(rare[:20]) if i % 2 else ''}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = collections.Counter(w for _, t in rows for w in words(t))
    new = spark.createDataFrame([(-1, "r1q r7q"), (-2, "r1q qqqq"), (-3, rows[4][1]), (-4, rows[4][1])], "doc_id long, text string")
    got = []
    for known in (1, masked_lm.KNOWN):  # all counts joined, all counts looked up
        monkeypatch.setattr(masked_lm, "KNOWN", known)
        counts = masked_lm.word_counts(df)
        model = masked_lm.vocabulary(df, counts=counts)
        net = masked_lm.fresh(model.counts)
        ids = {w: int(model.encode(word_hashes(*buffers(pa.array([w])))[0])[0]) for w in [*seen, "qqqq"]}
        sums = collections.Counter()
        for w, n in seen.items():
            sums[ids[w]] += n
        text = {r["doc_id"]: r["text"] for r in df.union(new).collect()}
        every = masked_lm.encoded(df.union(new), model)
        plain = {r["doc_id"]: r["log_prob"] for r in masked_lm.scored(every, net).collect()}
        out = {r["doc_id"]: r for r in masked_lm.scored(every, net, counts=counts).collect()}
        for i, r in out.items():
            own = sum(math.log((seen[w] or 0.5) / (sums[ids[w]] + 0.5)) for w in words(text[i]) if ids[w] >= masked_lm.VOCABULARY - masked_lm.WORDS)
            assert math.isclose(r["log_prob"], plain[i] + own, rel_tol=1e-6) and math.isclose(r["mean_log_prob"], r["log_prob"] / r["n_words"])
        assert out[-3]["log_prob"] == out[-4]["log_prob"] and len(out) == len(text)
        got.append([out[i]["log_prob"] for i in sorted(out)])
    assert np.allclose(*got, rtol=1e-6)
    scores = {r["doc_id"]: r["log_prob"] for r in masked_lm.pseudo_likelihood(df.union(new)).collect()}
    assert len(scores) == 54 and all(v < 0 for v in scores.values())


def test_language_model_does_not_depend_on_the_split(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(masked_lm, "SHARD_WORDS", 3000)  # so many shards that they are added in two steps
    monkeypatch.setattr(masked_lm, "CHUNK", 1000)
    got = []
    for files in (4, 40):
        docs.repartition(files).write.parquet(str(tmp_path / str(files)))
        got.append({r["doc_id"]: r["log_prob"] for r in masked_lm.pseudo_likelihood(spark.read.parquet(str(tmp_path / str(files)))).collect()})
    assert len(got[0]) == docs.count() and all(math.isclose(v, got[1][k], rel_tol=1e-6) for k, v in got[0].items())


def test_every_place_is_masked_in_turn():
    rng = np.random.default_rng(3)
    sizes = [1, 7, 8, 9, 100, 0, 3]
    ids, at = rng.integers(0, 100, sum(sizes)), np.append(0, np.cumsum(sizes))
    turns = [masked_lm.masked(ids, at, t) for t in range(masked_lm.ROUNDS)]
    assert all(len(t) == len(set(t.tolist())) == sum(-(-n // masked_lm.MASK) for n in sizes) for t in turns)
    assert all((np.diff(np.sort(t)) <= 2 * masked_lm.MASK).all() for t in turns) and set(turns[0].tolist()) != set(turns[1].tolist())


def test_masks_hit_every_placement():
    n, spans = decontamination.WINDOW, decontamination.MASKS
    for k in range(decontamination.SUBSTITUTIONS + 1):
        for wrong in itertools.combinations(range(n), k):
            assert any(not any(w - at in mask for w in wrong) for mask in spans for at in range(n - mask[-1]))


def test_short_items_with_replaced_words(spark):
    pad, items, docs, want = prose(4, 30), [], [], set()
    for n in range(1, decontamination.WINDOW):
        k, item = decontamination.allowed(n), [f"q{n}i{j}" for j in range(n)]
        assert k == (2 if n >= 10 else 1 if n >= 5 else 0)
        items.append((n, " ".join(item)))
        for wrong in [w for m in range(k + 2) for w in itertools.combinations(range(n), m)]:
            text = " ".join("zzz" if j in wrong else w for j, w in enumerate(item))
            docs.append((len(docs), text if len(docs) % 2 else f"{pad} {text} {pad}"))
            want |= {(docs[-1][0], n, n - len(wrong), 0 if docs[-1][0] % 2 else 30)} if len(wrong) <= k else set()
        docs.append((len(docs), " ".join(item[1:])))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["matched"], r["first_word"]) for r in decontamination.contamination(df, bench).collect()}
    assert got == want


def plain_contamination(docs, items):
    """All windows of all documents against all items, word by word."""
    found = set()
    for (d, text), (i, item) in itertools.product(docs, items):
        a, b = words(text), words(item)
        n = min(len(b), decontamination.WINDOW)
        wrong = decontamination.allowed(n) if n < decontamination.WINDOW else decontamination.SUBSTITUTIONS
        if n and any(sum(x != y for x, y in zip(a[p : p + n], b[q : q + n])) <= wrong for p in range(len(a) - n + 1) for q in range(len(b) - n + 1)):
            found.add((d, i))
    return found


def test_decontamination_against_brute_force(spark):
    rng = random.Random(12)
    items = [(i, prose(50 + i, rng.choice([1, 2, 3, 4, 5, 8, 11, 12, 13, 20, 40]), 60)) for i in range(25)]
    docs = []
    for d in range(60):
        w = prose(500 + d, 80, 60).split()
        for _ in range(3):
            part = rng.choice(items)[1].split()
            at = rng.randrange(max(1, len(part) - 13)) if len(part) > 13 else 0
            part = part[at : at + 14]
            for _ in range(rng.randrange(4)):
                part[rng.randrange(len(part))] = "zz"
            p = rng.randrange(len(w))
            w[p:p] = part
        docs.append((d, " ".join(w)))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == plain_contamination(docs, items)


def test_decontamination(spark):
    rng = random.Random(9)
    item = [f"q{rng.randrange(9999)}" for _ in range(20)]
    near = list(item)
    near[5], near[11] = "zzz", "yyy"
    far = [w if i % 4 else "zzz" for i, w in enumerate(item)]
    short = ["alpha", "beta", "gamma", "delta", "eps"]
    bench = spark.createDataFrame([(1, " ".join(item), 3), (2, " ".join(short), 3), (3, "only four words here", 3), (4, None, 3), (5, "", 3), (None, " ".join(reversed(item)), 3)], "item_id long, text string, hash long")
    pad = prose(4, 30)
    more = [(30, f"{pad} {' '.join(item).upper()}! {pad}"), (31, f"{pad} {' '.join(near)} {pad}"), (32, f"{pad} {' '.join(far)}"), (33, " ".join(item[:13])), (34, " ".join(item[:12])), (35, f"{pad} Alpha, beta; gamma delta eps."), (36, "alpha beta gamma delta"), (37, " ".join(reversed(item)))]
    df = awkward(spark, more)
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contamination(df, bench).collect()}
    assert set(got) == {(30, 1), (31, 1), (33, 1), (35, 2), (37, None)}
    words3 = bench.union(spark.createDataFrame([(9, "Beta, gamma: delta!", 1)], bench.schema))
    assert {r["doc_id"] for r in decontamination.contamination(df, words3).where("item_id = 9").collect()} == {35, 36}
    assert decontamination.contamination(df, words3, least=4).where("item_id = 9").count() == 0
    r = got[30, 1]
    assert (r["matched"], r["first_word"], r["last_word"]) == (13, 30, 49) and got[31, 1]["matched"] >= 11
    clean = decontamination.decontaminated(df, bench)
    assert clean.columns == df.columns and clean.count() == df.count() - 5
    assert decontamination.contamination(df, bench.limit(0)).count() == 0 and decontamination.contamination(nothing(spark), bench).count() == 0
