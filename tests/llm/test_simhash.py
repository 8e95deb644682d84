import random
import re

import numpy as np
import pytest
from odd import components, run_everywhere
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from whylake.llm import simhash


def brute(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows):
    """rows: (doc_id, fingerprint); component of each by comparing all pairs."""
    fps = sorted({f for _, f in rows})
    roots = components(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4])
    best = {}
    for doc, f in rows:
        if doc is not None:
            best[roots[f]] = min(best.get(roots[f], doc), doc)
    return sorted((str(doc), f"{f:016x}", str(best.get(roots[f]))) for doc, f in rows)


def found(df):
    return sorted((str(r.doc_id), f"{r.fp & (1 << 64) - 1:016x}", str(r.component_id)) for r in df.collect())


def test_odd_documents(odd_docs):
    rows = [(r.doc_id, brute(r.text)) for r in odd_docs.select("doc_id", "text").collect()]
    assert found(simhash.near_components(odd_docs)) == expected(rows)


def test_links_within_the_radius(spark):
    """Chains and clouds of fingerprints around common centres, each at most four bits from some other."""
    draw = random.Random(3)
    fps = []
    for _ in range(60):
        f = draw.getrandbits(64)
        for _ in range(draw.randint(1, 12)):
            fps.append(f)
            for _ in range(draw.randint(0, 5)):
                f ^= 1 << draw.randrange(64)
    rows = [(i, f) for i, f in enumerate(fps)]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in set(fps)], "fp long")
    for chunk in (1024, 3):  # a chunk of three cuts nearly every block
        roots = {r.node & (1 << 64) - 1: r.root for r in simhash.components(simhash.links(df, chunk=chunk)).collect()}
        sizes = {}
        for f in set(fps):
            sizes.setdefault(roots.get(f, f - (1 << 64) if f >> 63 else f), set()).add(f)
        want = {}
        for f, c in {(f, c) for _, f, c in expected([(i, f) for i, f in rows])}:
            want.setdefault(c, set()).add(int(f, 16))
        assert sorted(map(sorted, sizes.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 500])
def test_forest(n):
    draw = np.random.default_rng(n)
    fps = draw.integers(0, 1 << 63, n).astype("<u8")
    for i in range(1, n):
        if draw.random() < 0.7:
            fps[i] = fps[draw.integers(0, i)] ^ np.uint64(1 << int(draw.integers(0, 63))) ^ np.uint64(1 << int(draw.integers(0, 63)))
    group = np.sort(draw.integers(0, 5, n))
    u, v = simhash.forest(fps.copy(), group, 4)
    pairs = [(int(fps[i]), int(fps[j])) for i in range(n) for j in range(i) if group[i] == group[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= 4]
    nodes = set(map(int, fps))
    assert components(nodes, pairs) == components(nodes, zip(map(int, u), map(int, v), strict=True))
    assert len(u) < max(n, 1)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 300)] + [(5, 5)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(n, n) == (0 if n <= 200 else 1000) for n in [*range(201), *range(1000, 1300)])


def test_keep_one(spark, odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = [(r.doc_id, brute(r.text)) for r in odd_docs.collect()]
    want = sorted({d for d, _, c in expected(rows) if d == c})
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert simhash.keep_one(no_docs).count() == 0 and simhash.near_components(no_docs).count() == 0


def test_keep_one_with_null_and_repeated_ids(spark, words):
    """Rows that share an id, or have none, go with their own component and not with that of another row."""
    draw = random.Random(8)
    a, b, c = (" ".join(draw.choices(words, k=400)) for _ in range(3))
    near = [a + " end", c + " end"]
    assert 0 < (brute(a) ^ brute(near[0])).bit_count() <= 4 and 0 < (brute(c) ^ brute(near[1])).bit_count() <= 4
    rows = [(1, a), (5, near[0]), (5, b), (None, near[0]), (None, c), (None, near[1]), (7, "one more"), (7, "one more")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    first = min((c, near[1]), key=lambda t: brute(t) - (brute(t) >> 63 << 64))
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("1", a), ("5", b), ("None", first), ("7", "one more")])


def test_query(spark, sf_tiny):
    df = run_everywhere(simhash.op7_simhash, spark, sf_tiny)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_tiny}/documents.parquet").select("doc_id", "text").collect()}
    want = expected([(d, brute(t)) for d, t in docs.items()])
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect()) == want
    assert df.where(F.length("fingerprint") != 16).count() == 0


def jaccard(a, b, size=5):
    sets = []
    for t in (a, b):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


@pytest.fixture(scope="module")
def edited(words):
    """Texts with copies in which 1 to 20 words are replaced, one cluster far larger than a chunk of the test."""
    draw, rows = random.Random(31), []
    for i in range(40):
        base = draw.choices(words, k=draw.randint(60, 400))
        rows.append((1000 * i, " ".join(base)))
        for j in range(draw.randint(0, 4) if i else 60):
            own = list(base)
            for _ in range(draw.randint(1, 20 if i else 2)):
                own[draw.randrange(len(own))] = draw.choice(words)
            rows.append((1000 * i + j + 1, draw.choice([" ", "\n"]).join(own)))
    return rows


def test_similar_documents_by_brute_force(spark, edited):
    """All pairs of similarity 0.8 or more, but for the share that no band or a wide fingerprint misses."""
    docs = spark.createDataFrame(edited, "doc_id long, text string").repartition(5)
    kept = {r.doc_id for r in simhash.keep_one_similar(docs).collect()}
    pairs = [(a, b) for i, (a, s) in enumerate(edited) for b, t in edited[:i] if a // 1000 == b // 1000 and jaccard(s, t) >= 0.8]
    groups = components([d for d, _ in edited], pairs)
    firsts = set(groups.values())
    gone = len(edited) - len(firsts)
    assert firsts <= kept and len(kept - firsts) <= 0.04 * gone and gone > 40


@pytest.mark.parametrize(("n", "groups"), [(0, 1), (1, 1), (130, 1), (300, 7), (700, 3)])
def test_close_pairs_and_distances(n, groups):
    draw = np.random.default_rng(n)
    fps = draw.integers(0, 1 << 63, (n, simhash.WIDE)).astype("<u8")
    for i in range(1, n):
        if draw.random() < 0.6:
            flips = np.packbits((draw.random(64 * simhash.WIDE) < draw.choice([0.02, 0.1, 0.2])).astype(np.uint8), bitorder="little").view("<u8")
            fps[i] = fps[draw.integers(0, i)] ^ flips
    group = np.sort(draw.integers(0, groups, n))
    a, b, apart = simhash.close_pairs(simhash.planes(fps), simhash.behind(group), 102)
    got = {(int(x), int(y)): int(d) for x, y, d in zip(a, b, apart, strict=True)}
    every = {(i, j): sum(int(x ^ y).bit_count() for x, y in zip(fps[i], fps[j], strict=True)) for i in range(n) for j in range(i + 1, n) if group[i] == group[j]}
    assert got == {p: d for p, d in every.items() if d <= 102}
    root, pairs = simhash.spanned(fps, group, simhash.WIDE_RADIUS)
    assert len(pairs) < max(2 * n, 1) and components(range(n), got) == dict(enumerate(root.tolist())) == components(range(n), map(tuple, pairs.tolist()))


def test_wide_prints_and_bands():
    draw = np.random.default_rng(2)
    near, same = [], []
    for _ in range(300):
        h = draw.integers(0, 1 << 63, 300).astype(np.uint64)
        g = np.unique(np.concatenate([h[:267], draw.integers(0, 1 << 63, 33).astype(np.uint64)]))  # similarity 0.8
        a, b = simhash.wide_print(np.unique(h)), simhash.wide_print(g)
        near.append(sum(int(x ^ y).bit_count() for x, y in zip(a, b, strict=True)))
        same.append(any(x == y for x, y in zip(simhash.band_keys(h), simhash.band_keys(g), strict=True)))
    assert np.mean(np.array(near) <= simhash.WIDE_RADIUS) > 0.98 and np.mean(same) > 0.98


def test_odd_similar_documents(spark, odd_docs, no_docs):
    """Copies, near copies in case and white space, null and repeated ids, empty texts."""
    both = odd_docs.union(odd_docs.where("doc_id in (8, 13)"))
    kept = simhash.keep_one_similar(both)
    assert kept.columns == odd_docs.columns
    rows = sorted([(r.doc_id is None, r.doc_id or 0, r.text) for r in both.collect()], key=lambda r: (r[0], r[1]))
    want, seen = [], []
    for _, d, t in rows:
        if not any(jaccard(t, s) >= 0.8 for s in seen):
            want.append(t)
        seen.append(t)
    assert sorted(map(str, (r.text for r in kept.collect()))) == sorted(map(str, want))
    assert simhash.keep_one_similar(no_docs).count() == 0
