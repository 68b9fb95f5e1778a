"""Importance resampling, whitening and personal data against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenequarry.llm import importance_resampling as resampling
from scenequarry.llm import personal_data, queries, whitening

DATA = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ODD = [(1, None, 1), (2, "", 2), (3, " \n\t", 3), (4, "one", 4), (5, "Éa \x00 b-c " + "w" * 70 + " ÄB" * 30, 5), (5, "Éa \x00 b-c " + "w" * 70 + " ÄB" * 30, 5), (None, "no id here " * 20, 6), (7, "long words " * 40_000, 7), (8, "漢字" * 400 + " 漢 " * 30, 8)]


def features(text):
    words = WORD.findall((text or "").encode().translate(LOWER))
    return len(words), [zlib.crc32(b" ".join(words[i : i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def resampled(rows, target):
    have, want = collections.Counter(), collections.Counter()
    made = [(d, *features(t)) for d, t in rows]
    for _, _, f in made:
        have.update(f)
    for t in target:
        want.update(features(t)[1])
    some, most = sum(have.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1) * (some + 10_000) / ((have[b] + 1) * (most + 10_000)))) for b in range(10_000)]
    out = []
    for d, n, f in made:
        h = int(hashlib.sha256(f"42:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = 5 * len(able) // 100
    return collections.Counter((*r[:4], None) for r in [*able[drawn:], *(r for r in out if r[4] < 20)]) + collections.Counter((*r[:4], i + 1) for i, r in enumerate(able[:drawn]))


def test_resampling_against_brute_force(spark):
    out = queries.op11_resample_target(spark, DATA).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert collections.Counter(tuple(r) for r in out) == resampled(docs, target)


def test_resampling_edge_cases(spark):
    odd = spark.createDataFrame([(*r, "x") for r in ODD], "doc_id long, text string, weight int, score string")
    target = ["Éa b", None, "long words"]
    got = resampling.resample_towards(odd, spark.createDataFrame([(t,) for t in target], "text string"), percent=50)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = collections.Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got.collect())
    assert rows == collections.Counter({k[:4]: n for k, n in resampled([r[:2] for r in ODD], target).items()})
    assert sorted(r["rank"] for r in got.where("rank IS NOT NULL").collect()) == [1, 2]
    assert resampling.resample_towards(odd.limit(0), odd).isEmpty()
    assert resampling.resample_towards(odd, odd.limit(0)).count() == len(ODD)
    named = odd.withColumn("doc_id", F.concat(F.lit("id"), F.col("doc_id").cast("string")))
    assert resampling.resample_towards(named, odd, percent=100).where("rank IS NOT NULL").count() == 5


@pytest.mark.parametrize("bits, block", [(11, 1 << 16), (3, 16)])
def test_radix_ranks(spark, bits, block):
    rng = random.Random(2)
    rows = [(rng.choice([None, -(2**63), 2**63 - 1, -1, 0, 7]), 5 if i % 3 else rng.randrange(-50, 50), i) for i in range(400)]
    df = spark.createDataFrame(rows, "a long, b int, i int").repartition(5)
    got = {r.i: r["rank"] for r in resampling.radix_ranks(df, [("a", True), ("b", False)], bits=bits, block=block).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert sorted(got.values()) == list(range(1, 401))
    assert [(r[0], r[1]) for r in sorted(rows, key=lambda r: got[r[2]])] == [r[:2] for r in order]
    same = resampling.radix_ranks(df.select(F.lit(3).alias("a"), "i"), [("a", False)], bits=bits, block=block)
    assert sorted(r["rank"] for r in same.collect()) == list(range(1, 401))
    assert resampling.radix_ranks(df.limit(0), [("a", True)]).isEmpty()


def spectrum(rows):
    s = whitening.Spectrum(rows.shape[1])
    for x in rows:
        s.add(x)
    return s


@pytest.mark.parametrize("kind", ["plain", "copies", "low rank", "equal spread", "few", "one"])
def test_spectra(kind):
    """Rank-one updates, deflation and union against a dense decomposition of the scatter."""
    rng, d = np.random.default_rng(5), 12
    rows = np.rint(rng.normal(size=(300, d)) * np.linspace(300, 20, d))
    if kind == "copies":
        rows[::2] = rows[0]
    elif kind == "low rank":
        rows = rows[:, :3] @ rng.integers(-3, 4, (3, d))
    elif kind == "equal spread":
        rows = np.concatenate([np.eye(d), -np.eye(d)] * 5) * 100
    elif kind in ("few", "one"):
        rows = rows[: 5 if kind == "few" else 1]
    whole = spectrum(rows[:100])
    for part in np.array_split(rows[100:], 3):
        whole.unite(spectrum(part))
    away = rows - rows.mean(0)
    scatter = away.T @ away
    size = max(np.abs(scatter).max(), 1.0)
    assert whole.n == len(rows) and np.allclose(whole.mean, rows.mean(0), atol=1e-9)
    assert np.allclose(whole.values, np.linalg.eigvalsh(scatter), atol=1e-10 * size)
    assert np.allclose(whole.vectors.T @ whole.vectors, np.eye(d), atol=1e-10)
    assert np.allclose(scatter @ whole.vectors, whole.vectors * whole.values, atol=1e-10 * size)


def check_whitened(out, table):
    x = np.array([np.floor(1024 * np.array(v, float)) for _, v in table]).astype(np.int64) + 100_000
    n, total = len(x), x.sum(0)
    away = (x * n - total) / n
    v = away.T @ away / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    k = out.component.max()
    w = np.array([g.sort_values("component").whitened.to_numpy() for _, g in out.groupby("vec_id")])
    order = np.argsort([i for i, _ in table])
    want = (away @ q[:, :k] / np.sqrt(e[:k]))[order]
    assert np.allclose(w * np.sign((w * want).sum(0)), want, atol=1e-7)
    assert (out.n == n).all() and (out.identity_error <= 1e-4).all() and out.identity_error.nunique() == 1
    first = out[out.component == 1].sort_values("vec_id")
    assert first.deviation.tolist() == ((x * n - total) ** 2).sum(1)[order].tolist()
    assert np.allclose(out.groupby("component").explained.first(), e[:k] / np.trace(v), rtol=1e-9)
    return k


def test_whitening_against_a_dense_decomposition(spark):
    out = queries.op12_whiten_embeddings(spark, DATA).toPandas()
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert check_whitened(out, table) == 8 and len(out) == 8 * len(table)


def test_whitening_edge_cases(spark):
    rng = np.random.default_rng(8)
    good = [(i, [float(v) for v in rng.normal(size=5) * (5, 4, 3, 2, 1)]) for i in range(60)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [float("nan")] * 5), (104, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (105, [1.0, 2.0])]
    schema = "vec_id long, embedding array<float>, x string, n int"
    rows = lambda vs: spark.createDataFrame([(i, v, "x", 1) for i, v in vs], schema)
    out = whitening.whiten(rows(good + bad).repartition(7)).toPandas()
    table = [(i, [float(np.float32(v)) for v in vs]) for i, vs in good]
    assert check_whitened(out, table) == 5 and set(out.vec_id) == set(range(60))
    # Many partitions make a tree of more than one level.
    assert check_whitened(whitening.whiten(rows(good).repartition(20)).toPandas(), table) == 5
    for few in ([], bad, good[:1], [good[0]] * 4):
        nothing = whitening.whiten(rows(few))
        assert nothing.isEmpty() and nothing.columns == out.columns.tolist()
    flat = whitening.whiten(rows([(i, [float(i % 3), 1.0, float(i % 2)]) for i in range(30)])).toPandas()
    assert flat.component.max() == 2
    assert whitening.whiten(rows(good + good[:5])).count() == 65 * 5


def base_spans(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m.group())
        doubled = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))))
        if 16 <= len(digits) <= 19 and doubled % 10 == 0:
            found.append(("card", *m.span()))
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans_against_expressions():
    rng = random.Random(4)
    parts = ["a.b+c@d-e.f.g", "@", "a@b", "x@y.z@q.r", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "001.02.3.255", "0001.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "41111111111111111", "+1 (017) 555-7713", "+44.20.7946.0958", "++49", "+1", "é", "\n", " ", "-", "..", "9", "(", "55", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        assert personal_data.base_spans(text) == base_spans(text), text
    # Linear in runs that could be the beginning of anything.
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1." * 500_000, "@" * 500_000, "a@" * 500_000, "+1" * 300_000, "!" * 1_000_000 + "1", " " * 1_000_000 + "1"):
        personal_data._read(text)


def test_personal_data_on_the_table(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op13_personal_data(spark, DATA).collect():
        want = base_spans(docs[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.spans.startswith(text)
        assert tuple(sum(k == kind for k, _, _ in want) for kind in personal_data.KINDS) == (r.n_email, r.n_ip, r.n_card, r.n_phone)


def test_contexts_discover_identifiers(spark):
    """Numbers that no pattern describes are found where seeds stand, and nowhere else."""
    rng = random.Random(6)
    phone = lambda: f"+49 30 {rng.randrange(10**6, 10**7)}"
    rows = [f"please call me under {phone()} before noon, thanks" for _ in range(12)] + [f"please call me under {rng.randrange(10**7, 10**8)} before noon, thanks" for _ in range(4)]
    rows += [f"page count {rng.randrange(10**7, 10**8)} pages of print" for _ in range(20)] + [f"write to user{i}@mail.example.org or wait" for i in range(10)] + ["write to root@localhost or wait"]
    rows += ["the version of 2024-03-15 is final", "", None, "no digits at all"]
    df = spark.createDataFrame([(i % 45 if i < 47 else None, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, spans string")
    # One of the numbers again, elsewhere: it is believed wherever it stands.
    again = rows[13].split("under ")[1].split(" ")[0]
    df = df.union(spark.createDataFrame([(99, f"see {again} there", "x")], df.schema))
    got = personal_data.find_personal_data(df).collect()
    assert len(got) == len(rows) + 1
    learned = collections.Counter()
    texts = dict(zip(map(str, range(100)), rows, strict=False))
    for r in got:
        learned[r.doc_id] += r.n_context
    assert sum(learned.values()) == 4 + 1 + 1 and learned[99] == 1
    by_id = {r.doc_id: r.spans for r in got if r.doc_id == 99}
    assert by_id[99] == f"context:4:{4 + len(again)}" and texts
    _, believed = personal_data.score_graph(personal_data.store(personal_data.read_places(df).select(F.inline("places")).select(F.explode("patterns").alias("pattern"), "instance", "seed").groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "test-edges"))
    assert {r.instance.split(": ")[0] for r in believed.collect()} == {"number", "address"} and believed.where("instance = 'address: root@localhost'").count() == 1
    assert personal_data.find_personal_data(df.limit(0)).isEmpty()


def test_scores_without_broadcast(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = sorted(map(str, personal_data.find_personal_data(docs, least_seeds=1, least_instances=1).collect()))
    monkeypatch.setattr(personal_data, "BROADCAST_ROWS", -1)
    assert sorted(map(str, personal_data.find_personal_data(docs, least_seeds=1, least_instances=1).collect())) == want
