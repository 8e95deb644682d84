import hashlib
import random
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from whylake.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes, fanout):
    """(root, proof of each node) by the plain definition; a proof is a list of (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = a // fanout * fanout
            paths[i].append(("".join(nodes[run:a]), "".join(nodes[a + 1 : run + fanout])))
            at[i] = a // fanout
        nodes = [digest(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def folded(leaf, path):
    for left, right in path:
        leaf = digest(left, leaf, right)
    return leaf


def expected(rows):
    """All result rows of the query, sorted."""
    def leaf(r, text):
        return digest(*map(written, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[s] = tree([leaf(r, r["text"]) for r in by_source[s]], 3)
    root, upper = tree([trees[s][0] for s in names], 3) if names else (None, [])
    out = []
    for s, over in zip(names, upper, strict=True):
        for r, path in zip(by_source[s], trees[s][1], strict=True):
            own = leaf(r, r["text"])
            hit = crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 2 == 0 and r["text"] is not None
            used = leaf(r, r["text"].replace("\n", "")) if hit else own
            end = folded(used, path + over)
            out.append((str(r["doc_id"]), own, trees[s][0], root, digest(*(a + b for a, b in path + over)), end, end == root))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def make(spark, counts, seed=1):
    draw, rows = random.Random(seed), []
    for s, n in counts.items():
        for _ in range(n):
            rows.append({"doc_id": draw.randrange(10**6), "text": draw.choice([None, "", "a\nb", "é \U0001f600", "plain"]), "lang": draw.choice([None, "en"]), "source": s, "n_chars": draw.choice([None, 3])})
    draw.shuffle(rows)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return rows, spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(5)


@pytest.mark.parametrize("counts", [{"a": 1}, {"a": 2, None: 1}, {"a": 3, "b": 4, "": 9, "é": 10, "z": 27, None: 28}, {"big": 800, "b": 244, "c": 243, "d": 729, "e": 730}, {f"s{i}": 1 for i in range(300)}])
def test_proofs_by_brute_force(spark, counts):
    rows, docs = make(spark, counts)
    assert got(merkle.checked(docs)) == expected(rows)


def test_rounds_with_relays(spark):
    """Blocks of one and of three leaves, so that many rounds with ragged ends are run."""
    for n in (1, 4, 10, 31, 82):
        leaves = [digest(str(i)) for i in range(n)]
        nodes = spark.createDataFrame([("1x", i, h) for i, h in enumerate(leaves)], "grp string, no int, leaf string")
        root, paths = tree(leaves, 3)
        for levels in (0, 1) if n < 80 else (0,):
            found = {r.no: r for r in merkle.proofs(nodes, ["no"], 3, levels).collect()}
            assert [[(s.left, s.right) for s in found[i].steps] for i in range(n)] == paths
            assert {(r.subroot, r.root) for r in found.values()} == {(root, root)}


def test_other_fanout(spark):
    leaves = [digest(str(i)) for i in range(40)]
    nodes = spark.createDataFrame([("1x", i, h) for i, h in enumerate(leaves)], "grp string, no int, leaf string")
    for fanout in (2, 5):
        assert {r.root for r in merkle.proofs(nodes, ["no"], fanout, 1).collect()} == {tree(leaves, fanout)[0]}


def test_odd_documents(spark, odd_docs, no_docs):
    docs = odd_docs.union(odd_docs.where("doc_id < 3"))
    rows = [r.asDict() for r in docs.collect()]
    assert got(merkle.checked(docs)) == expected(rows)
    assert merkle.checked(no_docs).count() == 0
    texts = merkle.manifest(odd_docs.withColumn("doc_id", F.col("doc_id").cast("string")))
    assert texts.count() == odd_docs.count()


def test_query(spark, sf_tiny):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_tiny}/documents.parquet").collect()]
    out = merkle.op13_merkle(spark, sf_tiny)
    assert got(out) == expected(rows)
    assert out.where("verified").count() < len(rows) and out.where("verified").count() > 0
