"""Operators 11 to 13 against brute force on small tables, and on odd inputs."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from tilewright.llm import clusters, collisions, spelling

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"


# ------------------------------------------------------------------ 11

def brute_copies(rows, threshold=0.93):
    """(id, links, component, kept) of every row, by all pairs."""
    ok = [i for i, (d, v, k) in enumerate(rows) if d is not None and v and k is not None and None not in v and all(map(math.isfinite, v)) and any(v)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i in ok:
        by[rows[i][2], len(rows[i][1])].append(i)
    for own in by.values():
        m = np.array([rows[i][1] for i in own], float)
        m /= np.abs(m).max(axis=1, keepdims=True)
        m /= np.linalg.norm(m, axis=1)[:, None]
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= threshold, 1))):
            links[own[a]] += 1
            links[own[b]] += 1
            parent[max(find(own[a]), find(own[b]))] = min(find(own[a]), find(own[b]))
    least = {}
    for i in ok:
        least[find(i)] = min(rows[i][0], least.get(find(i), rows[i][0]))
    out = []
    for i, (d, _, _) in enumerate(rows):
        c = least[find(i)] if i in ok else d
        out.append((d, links[i], c, c == d))
    return sorted(out, key=str)


def planted_vectors(seed=5, n=300):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        base = rng.standard_normal(64)
        rows.append((base, k % 3))
        for _ in range(60 if k == 0 else rng.integers(0, 4)):  # cosines of 0.93 to 1 with the base, less among each other
            noise = rng.standard_normal(64)
            noise -= noise @ base / (base @ base) * base
            cos = rng.uniform(0.92, 1.0)
            rows.append((base / np.linalg.norm(base) * cos + noise / np.linalg.norm(noise) * math.sqrt(1 - cos**2), k % 3))
    rows += rows[:5] + rows[:2] * 3
    return [(i, v.astype(np.float32).tolist(), lab) for i, (v, lab) in enumerate(rows)]


@pytest.mark.parametrize("cell_rows,block_rows", [(2048, 2048), (64, 2048), (16, 20), (2048, 30)])
def test_near_copies_equal_brute_force(spark, cell_rows, block_rows):
    rows = planted_vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = sorted((tuple(r) for r in collisions.near_copies(df, cell_rows=cell_rows, block_rows=block_rows).collect()), key=str)
    want = brute_copies(rows)
    assert len(got) == len(want)
    assert sum(w[1] for w in want) > 1000
    found, all_links = sum(g[1] for g in got), sum(w[1] for w in want)
    assert found <= all_links and found >= 0.998 * all_links
    if cell_rows == 2048:
        assert got == want


def test_collision_calibration():
    """Share of pairs at the threshold that reach the count, over fresh lines each."""
    rng = np.random.default_rng(3)
    near = math.sqrt(2 - 2 * collisions.THRESHOLD)
    needed = collisions.count_needed(math.erf(collisions.WINDOW / math.sqrt(2)))
    counts = (np.abs(rng.standard_normal((20_000, collisions.LINES))) * near <= collisions.WINDOW * near).sum(axis=1)
    assert (counts >= needed).mean() > 0.999
    far = (np.abs(rng.standard_normal((20_000, collisions.LINES))) * math.sqrt(2) <= collisions.WINDOW * near).sum(axis=1)
    assert (far >= needed).mean() < 0.005
    for bits in (1, 4, 12):
        p = (1 - math.acos(0.93) / math.pi) ** bits
        assert (1 - p) ** collisions.tables_needed(bits, 0.93) <= collisions.MISSED


def test_near_copies_odd(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, v, 2), (5, v, None), (6, v, None), (7, None, 1), (8, [0.0, 0.0, 0.0], 1),
            (9, [0.0, 0.0, 0.0], 1), (10, [1.0, None, 3.0], 1), (11, [float("nan"), 2.0, 3.0], 1), (12, [float("inf"), 2.0, 3.0], 1), (None, v, 1),
            (13, [1.0, 2.0], 1), (14, [1.0, 2.0], 1), (15, [], 1), (16, [1e-38, 2e-38, 3e-38], 1), (17, [1e38, 2e38, 3e38], 1), (None, None, None), (18, [-1.0, -2.0, -3.0], 1)]
    df = spark.createDataFrame(rows, VECTORS)
    for c in ("place", "weight", "id", "vec", "n_links", "component_id", "root", "code"):
        df = df.selectExpr("*", f"7 as {c}")
    got = sorted((tuple(r) for r in collisions.near_copies(df).collect()), key=str)
    want = [(d, n, c, True if d is None else k) for d, n, c, k in brute_copies(rows)]
    assert got == sorted(want, key=str)
    assert collisions.near_copies(df.limit(0)).count() == 0


def test_near_copies_sql(spark):
    rows = planted_vectors(n=60)
    df = spark.createDataFrame(rows, VECTORS)
    embeddings = df.toPandas()  # noqa: F841  read by the SQL
    want = sorted(duckdb.sql(collisions.SQL).fetchall())
    assert sorted(tuple(r) for r in collisions.near_copies(df).collect()) == want


# ------------------------------------------------------------------ 12

def brute_clusters(rows, k=40, rounds=5):
    own = [(d, [int(math.floor(256 * float(x))) for x in v]) for d, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((sha256(f"2:{d}".encode()).hexdigest(), v) for d, v in own if d is not None)[:k]
    centroids = np.array([v for _, v in start], object).reshape(-1, 64)
    if not len(centroids):
        return []
    x = np.array([v for _, v in own], object)

    def assigned():
        d = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], 1)
        return [min((e, j) for j, e in enumerate(row)) for row in d.tolist()]

    for _ in range(rounds):
        near = assigned()
        for c in range(len(centroids)):
            at = [i for i, (_, j) in enumerate(near) if j == c]
            if at:
                centroids[c] = [s // len(at) for s in x[at].sum(axis=0).tolist()]
    near = assigned()
    by = Counter()
    for e, j in near:
        by[j] += e
    return sorted(((d, j, e, by[j], sum(by.values()), sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (d, _), (e, j) in zip(own, near)), key=str)


def test_clusters_equal_brute_force_and_sql(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute_clusters([(r["vec_id"], r["embedding"]) for r in df.collect()])
    for leading in (1, 16, 63):
        got = clusters.centroid_clusters(df.repartition(3), leading=leading).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    embeddings = duckdb.read_parquet(f"{SF}/embeddings.parquet")  # noqa: F841  read by the SQL
    assert sorted(duckdb.sql(clusters.SQL).fetchall(), key=str) == want


def test_clusters_odd(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(64)]) for i in range(90)]
    rows += rows[:20] + [(None, rows[3][1]), (200, None), (201, [1.0] * 63), (202, [1.0] * 65), (203, [None, *[1.0] * 63]), (204, [float("nan")] * 64),
                         (205, [0.0] * 64), (206, [0.0] * 64), (207, [1000.5] * 64), (5, [2.0] * 64), (208, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as cluster", "2 as v", "3 as id", "4 as distance")
    got = sorted((tuple(r) for r in clusters.centroid_clusters(df).collect()), key=str)
    assert got == brute_clusters(rows)
    assert clusters.centroid_clusters(df.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert sorted((tuple(r) for r in clusters.centroid_clusters(few).collect()), key=str) == brute_clusters(rows[:3])
    huge = spark.createDataFrame([(1, [1e38] * 64), (2, [-1e38] * 64)], "vec_id long, embedding array<float>")
    assert {r["distance"] for r in clusters.centroid_clusters(huge).collect()} == {0}


def test_bounds_spare_exact_distances():
    """On data that lie near few axes the filter leaves a fraction of the exact distances; the result is the same."""
    rng = np.random.default_rng(1)
    v = np.rint(rng.standard_normal((2000, 64)) * np.r_[np.full(8, 200.0), np.full(56, 5.0)]).astype(np.int32)
    c = v[:40].astype(np.int64)
    axes = np.linalg.eigh(np.cov(v.T))[1][:, ::-1].copy()
    near, best, done = clusters.assign(v, *clusters.rotated(v, axes, 16), c, axes)
    d = ((v[:, None, :].astype(np.int64) - c[None]) ** 2).sum(axis=2)
    assert (near == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert done < 0.1 * d.size


# ------------------------------------------------------------------ 13

def brute_words(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute_variants(rows):
    n = brute_words(rows)
    marks = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            marks[w[:i] + w[i + 1:]].add(w)
    out = {}
    for w in n:
        near = set()
        for i in range(len(w)):
            cut = w[:i] + w[i + 1:]
            near |= {cut} & n.keys()
            near |= {x for x in marks[cut] if len(x) == len(w) and sum(a != b for a, b in zip(x, w)) == 1}
        near |= marks[w]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= 5 * n[w] else None
        out[w] = (form, len(near))
    rows = []
    for w, (form, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n[w], k, n[form] if form else None))
    return sorted(rows)


def word_rows(seed=8):
    rng = random.Random(seed)
    letters = "aeinrtoslàéßöudcmbghj"
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([6, 7, 9, 12]))) for _ in range(60)] + ["x" * 300, "y" * 64, "z" * 65, "abcdef"]
    rows = []
    for i in range(800):
        words = []
        for _ in range(60):
            w = rng.choice(base)
            if rng.random() < 0.3:
                at = rng.randrange(min(8, len(w)))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("ae") + w[at:], w[:at] + rng.choice("ae") + w[at + 1:]])
            words.append(rng.choice([w, w.upper(), w.capitalize()]))
        rows.append((i, rng.choice([" ", "-", "1", "Ā", "日", "\n"]).join(words)))
    chain = " ".join(w for k in range(4) for w in ["lantern" + "sdkb"[:k]] * (6 * 6**k))  # forms of forms
    return [*rows, (900, chain)]


@pytest.mark.parametrize("trie_words", [20_000, 40])
def test_spelling_equals_brute_force(spark, trie_words):
    rows = word_rows()
    got = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), trie_words=trie_words)
    want = brute_variants(rows)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sum(w[1] is not None for w in want) > 100 and any(w[1] and w[1] != w[2] for w in want)


def test_spelling_of_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_variants([(r["doc_id"], r["text"]) for r in df.collect()])
    assert sorted(tuple(r) for r in spelling.op13_spelling_variants(spark, SF).collect()) == want


def test_spelling_odd(spark):
    rows = [(None, "colour " * 9), (1, None), (2, ""), (3, "colours " * 60), (3, "colours " * 60), (4, "COLOUR2colour_colour"), (5, "coloür " * 7), (6, "a" * 100_000), (7, "×÷×÷×÷ " * 5),
            (8, "colour" * 1), (9, "12 34")] + [(10 + i, "b" * 70 + " " + "b" * 71) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "3 as id", "4 as cell", "5 as form")
    assert sorted(tuple(r) for r in spelling.spelling_variants(df).collect()) == brute_variants(rows)
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_trie_search_is_whole():
    """The search lists exactly the pairs within one surplus and one deficit, in blocks of any size."""
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 3, (200, spelling.LEVELS))
    trie = spelling.Trie(counts)
    diff = counts[:, None, :] - counts[None, :, :]
    over, under = np.maximum(diff, 0).sum(axis=2), np.maximum(-diff, 0).sum(axis=2)
    want = set(zip(*(x.tolist() for x in np.nonzero((over <= 1) & (under <= 1)))))
    for block in (7, 1000):
        got = [p for q, w in trie.search(counts, block) for p in zip(q.tolist(), w.tolist())]
        assert len(got) == len(set(got)) and set(got) == want


def test_moves_cover_one_edit():
    for levels in (1, 3):
        steps = set(spelling.moves(levels))
        rng = random.Random(levels)
        for _ in range(2000):
            w = bytes(rng.choice(b"eainrtosludxz\xe9") for _ in range(rng.randint(6, 9)))
            at = rng.randrange(len(w))
            v = rng.choice([w[:at] + w[at + 1:], w[:at] + b"e" + w[at:], w[:at] + bytes([rng.choice(b"eax\xe9")]) + w[at + 1:]])
            a, b = spelling.group_counts([w, v])[:, :levels].tolist()
            assert (len(v) - len(w), *[y - x for x, y in zip(a, b)]) in steps
