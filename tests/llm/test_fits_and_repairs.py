"""Whitening, conversation repair and secret scans against plain versions."""

import hashlib
import heapq
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tidebook.llm import conversations, secrets, whitening
from tidebook.llm.conversations import ASSISTANT, NEXT, NOTHING, USER, Repair, Row

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, n long, whitened double, __v int, __key int"


def spectrum(values, seed):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return (q * np.array(values)) @ q.T, q


@pytest.mark.parametrize("values", [
    np.arange(1.0, 33.0),
    [1.0, 1 + 1e-9, 1 + 2e-9, 0.5, 0.5, 0.5, 0.1, 1e-5],
    [1.0] * 12,
    [4e6, 4e6 - 1e-3, 3.0, 3.0 - 1e-6, 1e-3, 0.0, 0.0, 0.0],
    [0.0] * 5,
])
def test_refined_eigenvectors(values):
    a, _ = spectrum(values, 3)
    a = (a + a.T) / 2
    found, x = whitening.refined(a)
    assert np.all(np.diff(found) <= 1e-12 * max(1.0, found[0]))
    wide, size = x.astype(np.longdouble), max(np.abs(a).max(), 1e-300)
    assert np.abs(wide.T @ wide - np.eye(len(a))).max() < 5e-16
    assert np.abs(a.astype(np.longdouble) @ wide - wide * found).max() < 4e-15 * size * len(a) ** 0.5
    assert np.allclose(np.sort(values)[::-1], found, rtol=1e-12, atol=1e-14 * size * len(a))


def test_refinement_beats_single_precision():
    a, q = spectrum(np.linspace(1, 2, 40), 5)
    a = (a + a.T) / 2
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(float)[:, ::-1]
    fine = whitening.refined(a)[1]
    error = lambda x: np.abs(np.abs((q[:, ::-1] * x).sum(axis=0)) - 1).max() + np.linalg.norm(x.T @ x - np.eye(40))
    assert error(rough) > 1e-7 and error(fine) < 1e-13


def plain_whitening(rows):
    """By exact fractions up to the covariance."""
    good = {i: [math.floor(256.0 * float(np.float32(c))) for c in v] for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted({tuple(x) for x in good.values()})
    n, dim = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(dim)]
    v = [[float(sum(Fraction(n * x[i] - s[i], n) * Fraction(n * x[j] - s[j], n) for x in fit) / n) for j in range(dim)] for i in range(dim)]
    values, axes = np.linalg.eigh(np.array(v))
    return good, n, s, values[::-1], axes[:, ::-1]


def test_whitening_matches_plain_version(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(6) * [3, 2, 1, 0.5, 0.1, 0.1]], 0, 5, 0.5, 7, 9) for i in range(60)]
    rows += [(100 + i, rows[i][1], 1, 5, None, 7, 9) for i in range(0, 60, 2)]  # repeated vectors
    rows += [(200, None, 0, 0, 0.0, 0, 0), (201, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0, 0, 0.0, 0, 0), (202, [float("nan")] * 6, 0, 0, 0.0, 0, 0), (203, [float("inf")] + [0.0] * 5, 0, 0, 0.0, 0, 0), (None, [-0.0] * 6, 0, 0, 0.0, 0, 0)]
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    good, n, s, values, axes = plain_whitening([(r[0], r[1]) for r in rows])
    assert len(got) == 4 * len(good) and {r["vec_id"] for r in got} == set(good)
    sign = {}
    for r in got:
        x, k = good[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x, s))
        want = float((np.array(x) - np.array(s) / n) @ axes[:, k] / values[k] ** 0.5)
        if abs(want) > 1e-6:
            assert sign.setdefault(k, round(r["whitened"] / want)) == round(r["whitened"] / want)
        assert abs(r["whitened"] - sign.get(k, 1) * want) < 1e-10
        assert abs(r["explained"] - values[k] / values.sum()) < 1e-10 and r["identity_error"] < 1e-9


def test_whitening_of_awkward_vectors(spark):
    big = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [1e10, 0.0]), (4, [0.0, 0.0])]
    flat = [(10, [1.0, 2.0, 3.0]), (11, [1.0, 2.0, 3.0])]
    line = [(20 + i, [float(i)]) for i in range(5)]
    rows = [(i, v, 0, 0, 0.0, 0, 0) for i, v in [*big, *flat, *line, (30, [])]]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whitened(spark.createDataFrame(rows, VECTORS)).collect()}
    assert {k for k, _ in got} == {1, 2, 3, 4, 10, 11, *range(20, 25)}
    assert got[1, 1]["n"] == 4 and {c for k, c in got if k == 1} == {1, 2}
    assert got[10, 1]["whitened"] == 0 and got[10, 1]["explained"] == 0 and got[10, 1]["identity_error"] == 0 and got[10, 1]["deviation"] == 0
    assert abs(got[24, 1]["explained"] - 1) < 1e-12 and got[22, 1]["whitened"] == 0
    x = [256 * i for i in range(5)]
    assert [got[20 + i, 1]["deviation"] for i in range(5)] == [(5 * v - sum(x)) ** 2 for v in x]
    assert whitening.whitened(spark.createDataFrame([], VECTORS)).count() == 0


def test_whitening_of_the_table(spark):
    got = whitening.query(spark, DATA).toPandas()
    assert (got.groupby("component").whitened.mean().abs() < 1e-9).all() and got.identity_error.max() <= 1e-4
    assert got.identity_error.nunique() == 1 and dict(whitening.query(spark, DATA).dtypes)["deviation"] == "bigint"


def cheapest(rows):
    """Cost and audit by labels settled in order of (cost, audit), over whole conversations."""
    heap, done = [(0, "", 0, NOTHING)], set()
    while True:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (NOTHING, ASSISTANT):
            return cost, audit
        other = ASSISTANT if state == USER else USER
        heapq.heappush(heap, (cost + 3, audit + "I", i, other))
        if i < len(rows):
            row = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
            if not row.gone:
                if (state, row.role[:1]) in NEXT:
                    heapq.heappush(heap, (cost + 3 * row.cut, audit + "K", i + 1, NEXT[state, row.role[:1]]))
                heapq.heappush(heap, (cost + 3 * row.cut + 3, audit + "R", i + 1, other))


def every_edit(rows):
    """The same by trying all edit strings with up to two inserts in a row."""
    best = (10**9, "")

    def go(i, roles, cost, audit, inserts):
        nonlocal best
        if (cost, audit) > best and cost >= best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best, (cost, audit))
        if inserts < 2:
            for x in "ua":
                go(i, roles + x, cost + 3, audit + "I", inserts + 1)
        if i < len(rows):
            row = rows[i]
            go(i + 1, roles, cost + 4, audit + "D", 0)
            if not row.gone:
                if row.role:
                    go(i + 1, roles + row.role[0], cost + 3 * row.cut, audit + "K", 0)
                for x in "ua":
                    go(i + 1, roles + x, cost + 3 * row.cut + 3, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


def some_rows(rng, n, mess):
    rows = []
    for k in range(n):
        role = rng.choice(["user", "assistant", "system", "tool", " ", ""]) if rng.random() < mess else ("user", "assistant")[k % 2]
        gone = rng.random() < 0.15
        rows.append(Row(role, f"t{k}", gone, not gone and rng.random() < 0.15))
    return rows


def test_repair_is_optimal():
    rng = random.Random(1)
    for trial in range(700):
        rows = some_rows(rng, rng.randrange(4) if trial < 60 else rng.randrange(13) if trial < 680 else rng.randrange(60, 300), rng.choice([0.1, 0.5]))
        want = cheapest(rows)
        if trial < 60:
            assert want == every_edit(rows)
        for block in (2, 5, conversations.BLOCK):
            out = []
            repair = Repair(lambda *x: out.append(x), block)
            for row in rows:
                repair.add(row)
            assert repair.finish() == want
            assert re.fullmatch("(s?(ua)+)?", "".join(role[:1] for _, role, _ in out))
            assert [e for e, _, _ in out] == [e for e in want[1] if e != "D"]


def plain_repair(rows, damage):
    """Counts, repair and digest of every conversation; ``rows`` are (conv_id, turn, role, text)."""
    spaced = lambda v: " " if v is None else str(v)
    groups = {r[0]: [] for r in rows}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, spaced(r[2]).encode(), spaced(r[3]).encode())):
        role, text = spaced(role), spaced(text)
        kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20 if damage else 99
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, found in groups.items():
        seen, counts, marked = set(), [0, 0, 0], []
        for _, role, text in found:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not ink else 1 if (role, text) in seen else 2 if ink[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            marked.append(Row(role, text, fault in (0, 1), fault == 2))
        turns = {t for t, _, _ in found if t is not None}
        cost, audit = cheapest(marked)
        lines, i, state = [], 0, NOTHING
        for letter in audit:
            if letter == "D":
                i += 1
                continue
            role = "assistant" if state == USER else "user"
            text = ""
            if letter != "I":
                text = marked[i].text
                role = marked[i].role if letter == "K" else role
                i += 1
            state = NEXT[state, role[0]]
            lines.append(f"{role}:{text}")
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, __gone string, cost int, edit string"


def awkward_conversations():
    rng, rows = random.Random(4), []
    for conv in [*range(40), None, 77]:
        for turn in range(200 if conv == 77 else rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "system", "tool", None, ""]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rng.choice([None, "", " \t\n", "Yes. ", "No", "a.\x0b", "é!", " ", "x" * 5000 + "?"]) if rng.random() < 0.5 else f"text {turn}."
            rows.append((conv, None if rng.random() < 0.1 else turn - (turn % 7 == 5), role, text, "clash", 1, None))
    return rows + rows[:5]


def test_conversations_match_plain_version(spark):
    rows = awkward_conversations()
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(3)
    plain = [r[:4] for r in rows]
    assert {r[0]: tuple(r[1:]) for r in conversations.summarised(df).collect()} == plain_repair(plain, False)
    hurt = plain_repair(plain, True)
    for block in (4, 64):
        assert {r[0]: tuple(r[1:]) for r in conversations.summaries(conversations.damaged(df), block).collect()} == hurt
    turns = {}
    for r in sorted(conversations.repaired(df, block=4).where("conv_id IS NOT NULL").collect(), key=lambda r: (r["conv_id"], r["place"])):
        turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, want in plain_repair(plain, False).items():
        if conv is not None:
            assert hashlib.sha256("\n".join(turns.get(conv, [])).encode()).hexdigest() == want[-1]
    assert conversations.summarised(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_conversations_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r[1:]) for r in conversations.query(spark, DATA).collect()} == plain_repair(rows, True)


def test_one_shuffle_of_conversations(spark):
    plan = conversations.query(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def plain_spans(text):
    """The patterns as they are written, by scanning."""
    found = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    for k, (kind, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24))):
        found += [(m.start(), k + 1, kind, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return [secrets.Span(kind, a, b) for a, _, kind, b in sorted(found)]


def test_base_spans():
    rng = random.Random(3)
    bits = ["password", "PassWD", "secret", "ToKen", "api_key", "APIKEY", "ſecret", "toKen", "=", ":", " ", '"', "'", "é", "日", "AKIA", "ABCDEFGH01234567", "deadbeef", "0123456789abcdef", "x", "-", "A", "\n", "\t", "/", "12345", "AKIAAKIA"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        assert [s for s, _ in secrets.base_spans(text)] == plain_spans(text)


def test_inferred_automata():
    rng = random.Random(5)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    values = sorted({"ghp_" + hexes(12) for _ in range(300)})
    a = secrets.inferred(values)
    assert 5 <= len(a.moves) <= 40  # the fixed beginning stays apart, the random letters merge
    for moves, logs in zip(a.moves, a.logs):
        assert abs(sum(map(math.exp, logs.values())) - 1) < 1e-9 and set(moves) <= set(logs)
    fresh = ["ghp_" + hexes(12) for _ in range(50)]
    assert min(a.score(v) for v in fresh) > max(a.score(v) for v in (hexes(16), "gph_" + hexes(12), "internationalise", "ghp_ghp_ghp_ghp_"))
    # a language of two words and their repetition is learned as it is
    b = secrets.inferred(["ab" * k for k in range(1, 6) for _ in range(2 ** (8 - k))])
    assert b.score("abab") > b.score("aabb") and b.score("ab" * 9) > b.score("ab" * 9 + "a") + 5


TEXTS = "doc_id long, text string, spans string, n_hex int, __text int, __key int, kind string"


def secret_rows():
    rng = random.Random(6)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    prose = lambda n: " ".join(rng.choice("the of internationalisation standing-orders well-known example.com/path value and 2024-01-15 report_final_v2.txt counterrevolutionaries a is".split()) for _ in range(n))
    texts = [f'{prose(80)} token = "{hexes(40)}" {prose(9)}' for _ in range(60)] + [f"{prose(30)} password: {hexes(20)}é {prose(3)}" for _ in range(40)]
    bare = [f"{prose(20)} {hexes(20)} {prose(20)}" for _ in range(30)]
    clean = [prose(100) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate([*texts, *bare, *clean, "", None, "AKIA" + "Q7" * 9, prose(30_000) + " secret=" + hexes(30), texts[0]])]
    return [(i, t, "x", 1, 2, 3, "y") for i, t in [*rows, (None, texts[1]), (0, texts[2])]], range(100, 130), range(130, 190)


def test_secrets_match_plain_version(spark):
    rows, bare, clean = secret_rows()
    df = spark.createDataFrame(rows, TEXTS).repartition(3)
    model = secrets.fitted(df)
    got = secrets.scanned(df, model).collect()
    want = []
    for r in rows:
        t = r[1] or ""
        base = plain_spans(t)
        more = [(m.start(), 9, "format", m.end()) for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", t) if m.end() - m.start() >= 16 and not any(s.start < m.end() and m.start() < s.end for s in base) and model.score(m[0]) >= 14.0]
        order = {"assign": 0, "access": 1, "hex": 2, "format": 9}
        want.append((r[0], tuple((k, a, b) for a, _, k, b in sorted([(s.start, order[s.kind], s.kind, s.end) for s in base] + more))))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in r["spans"])) for r in got), key=key) == sorted(want, key=key)
    by = {r["doc_id"]: r["spans"] for r in got}
    found = [i for i in bare if any(s["kind"] == "format" and s["end"] - s["start"] == 20 for s in by[i])]
    assert len(found) == len(bare) and not any(by[i] for i in clean)
    empty = spark.createDataFrame([], TEXTS)
    assert secrets.scanned(empty).count() == 0
    assert all(not r["spans"] for r in secrets.scanned(spark.createDataFrame([r for r in rows if r[0] in clean], TEXTS)).collect())


def test_letter_pairs_cover_all_documents(spark):
    rows, _, _ = secret_rows()
    df = spark.createDataFrame(rows, TEXTS).repartition(2)
    found = {r["value"]: r["n"] for r in secrets.evidence(df, "text").where("kind = 'pair'").collect()}
    total = 0
    for r in rows:
        t = r[1] or ""
        total += len((secrets.masked(t, secrets.base_spans(t)) + "\n").encode())
    assert sum(found.values()) == total


def test_secrets_of_the_table(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = secrets.query(spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == secrets.digest(base)
        assert [r[f"n_{k}"] for k in secrets.KINDS] == [sum(s.kind == k for s in base) for k in secrets.KINDS]
        assert {f"{s.kind}:{s.start}:{s.end}" for s in base} <= set(r["spans"].split(",")) | {""}
