"""Operators 11 to 13 on small fixtures against brute force."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfold.llm import ball_kmeans, filter_audit, fingerprints
from wayfold.llm.near_dedup import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mask int, part string, cluster int"


def words(r, n, vocabulary=4000):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


# ---------------------------------------------------------------- 11: audit


def audit_texts():
    r = random.Random(5)
    rows = [(i, words(r, r.choice([3, 150, 199, 200, 400]), r.choice([5, 90, 4000])), r.choice(["en", "de", None])) for i in range(60)]
    rows += [(60 + i, t.upper() if i % 2 else t + r.choice(["", "$", "|"]), lang) for i, (_, t, lang) in enumerate(rows[:20])]
    copied = rows[3][1]
    rows += [(100 + i, copied, r.choice(["en", "fr"])) for i in range(30)] + [(2, copied, "en"), (2, copied, "en"), (None, copied, "en"), (None, None, None)]
    rows += [(200, "", "en"), (201, None, "en"), (202, " \n\x0b\x0c\r\t", ""), (203, "É" * 40 + "AB", "de"), (204, "ABCé" * 5, "de"), (205, "a b " * 200, "de"), (206, words(r, 60_000), "en")]
    return rows


def brute_audit(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = {}
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall("[^\\x20\\x09-\\x0D]+", t)
        fails.append((lang or "", {
            f for f, bad in zip("ABCDE", (
                len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                bool(re.search("[#$%&*|]", t)), i is not None and least[t] < i,
            )) if bad
        }, i in good, i in toxic))
    removed_at = {}
    for order in itertools.permutations("ABCDE"):
        for part in {p for p, *_ in fails}:
            left = [f for f in fails if f[0] == part]
            gone = []
            for step, name in enumerate(order, 1):
                now = [f for f in left if name in f[1]]
                left = [f for f in left if name not in f[1]]
                unique = sum(f[0] == part and f[1] == {name} for f in fails)
                out[part, "".join(order), step] = [len(left), len(now), sum(name in f[1] for f in gone), unique, sum(f[2] for f in now), sum(f[3] for f in now)]
                removed_at[part, name] = removed_at.get((part, name), 0) + len(now)
                gone += now
    return {k: (*v, removed_at[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark):
    rows = audit_texts()
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 210, 3)] + [(3, 0, 1), (None, 1, 1), (9, None, None)]
    docs = spark.createDataFrame([(i, t, lang, None, None, 9, "x", 1) for i, t, lang in rows], SCHEMA).repartition(5)
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r[0], r[1], r[2]): tuple(r[3:]) for r in filter_audit.filter_audit(docs, marked).collect()}
    assert got == brute_audit(rows, labels)
    assert len(got) == 4 * 600
    assert filter_audit.filter_audit(docs.limit(0), marked).count() == 0
    alone = filter_audit.filter_audit(docs.where("doc_id = 200"), marked.limit(0)).collect()
    assert len(alone) == 600 and {r["removed"] for r in alone if r["filter_order"][r["step"] - 1] == "A"} == {1}


def test_signed_sums_are_inverted_exactly(spark):
    r = random.Random(2)
    rows = [(p, m, r.randrange(10**12)) for p in "ab" for m in range(32) if r.random() < 0.7]
    sums = filter_audit.signed_sums(spark.createDataFrame(rows, "part string, mask int, n long"), ["part"])
    got = {(x["part"], m): n for x in sums.select("part", filter_audit.inverse("sums").alias("n")).collect() for m, n in enumerate(x["n"]) if n}
    assert got == {(p, m): n for p, m, n in rows}


# ---------------------------------------------------------------- 12: ball k-means


def brute_kmeans(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [nearest(v) for _, v in kept]
    total = sum(d for d, _ in last)
    within = {j: sum(d for d, o in last if o == j) for _, j in last}
    digest = lambda j: hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()
    return sorted(((i, j, d, within[j], total, digest(j)) for (i, _), (d, j) in zip(kept, last)), key=str)


def vector_rows(n=300, spread=0.05):
    r = random.Random(8)
    middles = [[r.uniform(-0.3, 0.3) for _ in range(64)] for _ in range(12)]
    rows = [(i, [float(np.float32(m + r.gauss(0, spread))) for m in r.choice(middles)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(40)] + [(5, rows[9][1]), (None, rows[2][1])]
    return rows + [(900, None), (901, []), (902, [0.1] * 63), (903, [0.1] * 63 + [None]), (904, [0.1] * 63 + [float("nan")]), (905, [float("inf")] * 64), (906, [0.0] * 64)]


VECTORS = "vec_id long, embedding array<float>, label int, cluster int, distance string"


@pytest.mark.parametrize("moved", [0.25, 0.0, 1.0])
def test_clusters(spark, monkeypatch, moved):
    monkeypatch.setattr(ball_kmeans, "MOVED", moved)
    frame = spark.createDataFrame([(i, v, 0, 3, "d") for i, v in vector_rows()], VECTORS).repartition(5)
    got = sorted((tuple(r) for r in ball_kmeans.cluster_digests(frame).collect()), key=str)
    assert got == brute_kmeans(vector_rows())


def test_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(i, v, 0, 3, "d") for i, v in vector_rows()], VECTORS)
    assert ball_kmeans.cluster_digests(frame.where("vec_id >= 900 AND vec_id < 906")).count() == 0
    assert ball_kmeans.cluster_digests(frame.limit(0)).count() == 0
    few = [(i, v) for i, v in vector_rows()[:5]] + [(3, vector_rows()[3][1])] * 20
    got = ball_kmeans.cluster_digests(spark.createDataFrame([(i, v, 0, 3, "d") for i, v in few], VECTORS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_kmeans(few)


def test_large_components(spark):
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) * 10.0 ** r.choice([0, 3, 6]) for _ in range(64)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = [tuple(None if isinstance(x, int) and x >= 1 << 63 else x for x in row) for row in brute_kmeans(rows)]
    assert sorted((tuple(x) for x in ball_kmeans.cluster_digests(frame).collect()), key=str) == sorted(want, key=str)
    beyond = spark.createDataFrame([*rows, (77, [1e30] * 64)], "vec_id long, embedding array<double>")
    assert ball_kmeans.cluster_digests(beyond).count() == 61


def test_neighbours_alone_are_compared():
    """Of members in the core none is compared with another centroid, of those in an annulus only the neighbours within reach."""
    centroids = [[0] * 4, [100, 0, 0, 0], [1000, 0, 0, 0]]
    x = np.array([[1, 0, 0, 0], [49, 0, 0, 0], [60, 0, 0, 0], [50, 0, 0, 0]], np.int64)
    balls = ball_kmeans.Balls(centroids, centroids, [60, 0, 0])
    assert [j for _, j in balls.neighbours[0]] == [1] and balls.neighbours[1] == []
    cluster, best = balls.assign(x, np.zeros(4, np.int64))
    assert cluster.tolist() == [0, 0, 1, 0] and best.tolist() == [1, 49**2, 40**2, 50**2]


# ---------------------------------------------------------------- 13: fingerprints


def print_texts():
    r = random.Random(3)
    rows = [(r.randrange(10_000), words(r, r.randint(1, 400))) for _ in range(60)]
    rows += [(7, "same words in every one of these rows " * 3)] * 5 + [(8, rows[0][1]), (9, rows[0][1].upper())]
    return rows + [(20_000, ""), (20_001, None), (20_002, " \n"), (20_003, "une éducation où l’on " * 50), (20_004, words(r, 30_000)), (None, "no id at all"), (3, "x")]


def brute_print(text):
    """Bin by bin, from the same shingle hashes."""
    (_, _, members, _), = shingles(pa.array([text], pa.large_string()))
    least = {}
    for h in map(int, members):
        bin_ = h >> 56
        least[bin_] = min(h, least.get(bin_, h))
    if not least:
        return ""
    values = [(least[k] if k in least else least[next(b for b in fingerprints.LENDERS[k] if b in least)]) & 15 for k in range(256)]
    return b"".join(bytes([values[k] | values[k + 1] << 4]) for k in range(0, 256, 2)).hex()


def brute_likeness(a, b):
    if not a or not b:
        return 1.0 if a == b else 0.0
    same = sum(x == y for x, y in zip(a, b)) / 256
    return min(max((same - 1 / 16) / (15 / 16), 0.0), 1.0)


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_edited_fingerprints(spark, monkeypatch, parts):
    monkeypatch.setattr(fingerprints, "STEP", 3000)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        frame = spark.createDataFrame([(i, t, None, None, None, 1, "p", 2) for i, t in print_texts()], SCHEMA).repartition(3)
        order = frame.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
        order = sorted(((r[0] is not None, r[0] or 0, r[2]), r[1]) for r in order)
        want = []
        for (key, t), (_, other) in zip(order, order[1:] + order[:1]):
            n = len(t) // 4
            new = t[: len(t) - n] + other[:n]
            a, b, c = brute_print(t), brute_print(new), brute_print(other)
            want.append((key[1] if key[0] else None, len(t), hashlib.sha256(new.encode()).hexdigest(), a, b, round(brute_likeness(a, b), 9), round(brute_likeness(a, c), 9)))
        found = fingerprints.edited_fingerprints(frame).collect()
        got = [(*r[:5], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in found]
        assert sorted(got, key=str) == sorted(want, key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_and_no_documents(spark):
    frame = spark.createDataFrame([(1, "abcdefgh", None, None, None, 1, "p", 2)], SCHEMA)
    (r,) = fingerprints.edited_fingerprints(frame).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and r["near_next"] == 1.0
    assert fingerprints.edited_fingerprints(frame.limit(0)).count() == 0


def test_likeness_follows_the_sets(spark):
    """The estimate against the true similarity, and columns against the batch form."""
    r = random.Random(12)
    errors = []
    for _ in range(60):
        a = [f"v{r.random()}" for _ in range(400)]
        b = a[: r.randint(40, 400)] + [f"u{r.random()}" for _ in range(r.randint(0, 200))]
        sets = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (a, b)]
        true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        both = [fingerprints.packed(pa.array([" ".join(x)])) for x in (a, b)]
        errors.append(float(fingerprints.likeness(*both)[0]) - true)
    assert abs(sum(errors) / len(errors)) < 0.012 and math.sqrt(sum(e * e for e in errors) / len(errors)) < 0.045
    frame = spark.createDataFrame([(1, "a b c d e f g", "A B C D E f g"), (2, "", None), (3, "x", "")], "i long, a string, b string")
    got = frame.select("i", fingerprints.fingerprint("a").alias("p"), fingerprints.fingerprint("b").alias("q"))
    assert [x[0] for x in got.orderBy("i").select(fingerprints.fingerprint_likeness("p", "q")).collect()] == [1.0, 1.0, 0.0]
    assert fingerprints.fingerprints(frame.withColumnRenamed("a", "text"), "i").count() == 3


def test_lenders_of_few_bins_are_even():
    """A text of two shingles: each bin asks for itself, so that both lend about half."""
    values, filled = np.zeros((1, 256), np.uint8), np.zeros((1, 256), bool)
    filled[0, [3, 200]], values[0, 200] = True, 1
    fingerprints.dense(values, filled)
    assert 90 < values.sum() < 166
