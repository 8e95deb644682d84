import hashlib
import random
import re
import time

import pytest
from odd import run_everywhere
from pyspark.sql import functions as F

from whylake.llm import pii


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c)
        total += (v * 2 - 9 if v > 4 else v * 2) if i % 2 else v
    return total % 10 == 0


def base(text):
    """The stated forms by Python's own matcher."""
    text, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        number = re.sub("[^0-9]", "", m[0])
        if 13 <= len(number) <= 19 and luhn(number):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


HARD = [
    "a@b.c_d@e.f x@y..z a.b@c-d.e.f.g@h.i  1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 é€\U0001f600 4111 1111 1111 1111 4111-1111-1111-1112 +1 (555) 123-4567.",
    "x@" * 50 + " 1.2.3 " * 20, "0000.0.0.0 12.34.56.789 5.5.5.5@a.b 4111111111111111 4111111111111111", "a" * 3000 + "@",
    "+1-- - -- 2345678 +1 2 3 4 5 6 7 8 9 +99999999 9 +12 +123456789012345678", "1 " * 3000, "1.1.1.1 " * 300, "@@ @a.b .@.. %@-.-",
]


def fixed(spans):
    return [(s.kind, s.start, s.stop) for s in spans if s.kind in pii.BASE]


def test_base_kinds(spark, odd_docs, no_docs):
    draw = random.Random(4)
    texts = HARD + ["".join(draw.choice("01234567890123456789 .-+@()ab_é\U0001f600") for _ in range(draw.randint(0, 120))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(docs).collect():
        assert fixed(r.spans) == base(texts[r.doc_id]), texts[r.doc_id]
    odd = [(str(r.doc_id), base(r.text)) for r in odd_docs.collect()]
    assert sorted((str(r.doc_id), fixed(r.spans)) for r in pii.find(odd_docs).collect()) == sorted(odd)
    assert pii.find(no_docs).count() == 0 and pii.masked(no_docs).count() == 0


@pytest.fixture(scope="module")
def contextual(spark, words):
    """``token = "..."`` precedes long hexadecimal values in many texts, and in some a value without a fixed form."""
    draw, rows = random.Random(6), []
    for i in range(60):
        around = [" ".join(draw.choices(words, k=20)) for _ in range(2)]
        value = f"{draw.getrandbits(200):050x}" if i % 6 else f"K{i:03d}-xy"
        rows.append((i, f'{around[0]} token = "{value}" {around[1]} mail u{i}@mail.example.org {draw.choice(words)} 17 and {draw.choice(words)}'))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_patterns_discover_values_without_a_form(contextual):
    texts = {r.doc_id: r.text for r in contextual.collect()}
    got = {}
    for r in pii.find(contextual).collect():
        for s in r.spans:
            got.setdefault(s.kind, set()).add((r.doc_id, texts[r.doc_id][s.start : s.stop]))
    assert got["id"] == {(i, f"K{i:03d}-xy") for i in range(0, 60, 6)}
    assert len(got["secret"]) == 50 and len(got["email"]) == 60


def test_support_does_not_grow_with_the_corpus(spark):
    """A context with four seeds finds its fifth value beside 5,000 seeds of another context too."""
    rare = [(i, f'some words badge token {"K17-xy" if i == 4 else f"{i + 1:x}a" * 20} and more') for i in range(5)]
    hot = [(100 + i, " ".join(f"write to u{i}x{j}@mail.example.org or" for j in range(100))) for i in range(50)]
    spans = []
    for rows in (rare, rare + hot):
        found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id < 100").collect()
        spans.append(sorted((r.doc_id, s.kind, s.start, s.stop) for r in found for s in r.spans))
    assert spans[0] == spans[1] and (4, "id", 23, 29) in spans[1]


def test_masked(contextual, odd_docs):
    for r in pii.masked(contextual).collect():
        assert "[EMAIL]" in r.text and ("[ID]" in r.text if r.doc_id % 6 == 0 else "[SECRET]" in r.text) and "@" not in r.text
    kept = pii.masked(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd_docs.collect()))


def test_overlapping_spans_are_covered_once(spark):
    docs = spark.createDataFrame([(1, "see +4111 1111 1111 1111 or 1.2.3.4@a.bc now"), (1, "see +4111 1111 1111 1111 or 1.2.3.4@a.bc now")], "doc_id long, text string")
    out = [r.text for r in pii.masked(docs).collect()]
    assert len(out) == 2 and out[0] == out[1] and not re.search("[0-9@]", out[0])


def test_query(spark, sf_tiny):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_tiny}/documents.parquet").select("doc_id", "text").collect()}
    df = run_everywhere(pii.op6_bootstrapped_pii, spark, sf_tiny)
    for r in df.collect():
        spans = base(docs[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert ",".join(s for s in r.spans.split(",") if s.split(":")[0] in pii.BASE) == line
    assert df.where(F.col("n_email") > 0).count() > 0


def test_running_sums(spark):
    rows = [(list(range(n)),) for n in (0, 1, 2, 7, 8, 9, 63, 64, 65, 200)]
    df = spark.createDataFrame(rows, "v array<int>")
    for stretch in (1, 8, 64):
        for r in df.select("v", pii.running(F.col("v"), stretch).alias("sums")).collect():
            assert r.sums == [sum(r.v[: i + 1]) for i in range(len(r.v))]


def test_counts_of_runs(spark):
    df = spark.createDataFrame([([],), ([5],), ([1, 1, 2, 3, 3, 3],)], "v array<long>")
    got = df.select(pii.counted(F.col("v")).alias("c")).collect()
    assert got[0].c is None and [tuple(x) for x in got[1].c] == [(5, 1)] and [tuple(x) for x in got[2].c] == [(1, 2), (2, 1), (3, 3)]


def test_many_addresses_in_one_text(spark):
    text = "host 10.0.0.1 up " * 20_000
    docs = spark.createDataFrame([(1, text), (2, "x 10.0.0.1")], "doc_id long, text string")
    began = time.time()
    found = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert time.time() - began < 60
    assert [(s.start, s.stop) for s in found[1]] == [(17 * i + 5, 17 * i + 13) for i in range(20_000)]


def patterns(text):
    """The words of a text and where each starts."""
    words = re.split(r"[\x20\x09-\x0d]", text)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    return words, starts


def discovered(rows):
    """Identifiers by plain loops over all patterns and words: what the operator's rounds must find."""
    bare = lambda w: re.sub(r"[^A-Za-z0-9]+$", "", re.sub(r"^[^A-Za-z0-9+]+", "", w))
    seeds, occurring, words_after = set(), {}, []
    for d, text in rows:
        words, starts = patterns(text)
        spans = base(text) + [("secret", *m.span()) for m in re.finditer(r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}", text) if re.search("[0-9]", m[0]) and re.search("[a-fA-F]", m[0])]
        for _, a, b in spans:
            w = max(i for i in range(len(words)) if starts[i] <= a)
            if w >= 2:
                p = (words[w - 2].lower(), words[w - 1].lower())
                seeds.add((p, text[a:b].lower()))
                occurring[p] = occurring.get(p, 0) + 1
        for i in range(2, len(words)):
            words_after.append(((words[i - 2].lower(), words[i - 1].lower()), d, words[i], starts[i], spans))
    support = {}
    for p, _ in seeds:
        support[p] = support.get(p, 0) + 1
    total = {}
    for p, *_ in words_after:
        total[p] = total.get(p, 0) + 1
    good = {p for p, n in support.items() if n >= pii.SUPPORT and occurring[p] >= pii.LEAST_SHARE * total[p]}
    known = {v for _, v in seeds}
    edges = {(p, bare(w).lower()) for p, _, w, _, _ in words_after if p in good}
    score = {e: 1.0 if e[1] in known else 0.0 for e in edges}
    for _ in range(pii.ROUNDS):
        sure = {p: (lambda own: sum(own) / len(own))([s for (q, _), s in score.items() if q == p]) for p in {p for p, _ in edges}}
        miss = {}
        for p, v in edges:
            miss[v] = miss.get(v, 1.0) * max(1 - sure[p], 1e-9)
        score = {(p, v): max(1.0 if v in known else 0.0, 1 - miss[v]) for p, v in edges}
    strong = {p for p in {p for p, _ in edges} if (lambda own: sum(own) / len(own))([s for (q, _), s in score.items() if q == p]) >= pii.SURE}
    out = set()
    for p, d, w, at, spans in words_after:
        value = bare(w)
        if p in strong and len(value) >= 4 and re.search("[0-9@]", value):
            a = at + w.index(value)
            if not any(s < a + len(value) and a < e for _, s, e in spans):
                out.add((d, a, a + len(value)))
    return out


def test_discovered_spans_by_brute_force(spark):
    """Random templates, sure and unsure ones, and long words before a value."""
    draw, rows = random.Random(12), []
    heads = ["user token", "my key", "see page", "contact me", "Write To", f"{'q' * 90} after", f"{'r' * 90} after"]
    for i in range(250):
        out = []
        for _ in range(draw.randint(1, 5)):
            head = draw.choice(heads)
            value = draw.choice([f"u{draw.randrange(99)}@mail.example.org", f"{draw.getrandbits(200):050x}", f"K{draw.randrange(30):02d}-xy,", "nothing", "plain"])
            out.append(f"{head} {value if head != 'see page' or draw.random() < 0.1 else draw.choice(['12', 'x', '1234'])}")
        rows.append((i, draw.choice([" ", "\n", "  "]).join(out)))
    got = {(r.doc_id, s.start, s.stop) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r.spans if s.kind == "id"}
    assert got == discovered(rows) and got


def test_null_ids_in_the_query(spark, odd_docs, tmp_path):
    odd_docs.withColumn("doc_id", F.col("doc_id")).write.parquet(str(tmp_path / "documents.parquet"))
    assert pii.op6_bootstrapped_pii(spark, str(tmp_path)).count() == odd_docs.count()
