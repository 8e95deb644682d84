import collections
import os
import re
import sys

import duckdb
import pyarrow as pa
from odd import run_everywhere
from pyspark.sql import functions as F

from whylake.llm import chat, fertility, licenses

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rows_of(df_or_rows):
    return sorted(tuple(map(str, r)) for r in df_or_rows)


def counted(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, doubled = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            doubled += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), doubled, len(again)]


def test_base_counts(odd_docs, no_docs):
    texts = {(str(r.doc_id), r.text) for r in odd_docs.collect()}
    for r in fertility.measures(odd_docs).collect():
        want = [counted(t) for d, t in texts if d == str(r.doc_id)]
        assert [r[c] for c in fertility.COUNTS[:5]] in want
    assert fertility.judged(fertility.measures(no_docs)).count() == 0


def test_measures_by_hand():
    import math

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=fertility.vocabulary())
    for text in ("the thing on the table", "中 \U0001f9ff x", "a a a a"):
        ids = [i for w in text.split() for i in model.encode(w)]
        m = fertility.measured(pa.array([text]), fertility.vocabulary())
        assert m["n_tokens"][0] == len(ids)
        assert abs(m["byte_share"][0] - sum(model.is_byte(i) or model.is_unknown(i) for i in ids) / len(ids)) < 1e-12
        entropy = -sum(c / len(ids) * math.log(c / len(ids)) for c in collections.Counter(ids).values())
        assert abs(m["token_entropy"][0] - entropy / math.log(max(len(ids), 2))) < 1e-9


def test_strange_tokens_are_rejected(spark, words):
    import random

    draw = random.Random(2)
    rows = [(i, " ".join(draw.choices(words, k=200)), "en") for i in range(100)]
    rows += [(1000, " ".join(f"{w}%%#{w[::-1]}&&{i}" for i, w in enumerate(draw.choices(words, k=200))), "en"), (1001, "few words", "en")]
    rows += [(1002, " ".join(["same three words"] * 60), None)]
    out = {r.doc_id: r for r in fertility.judged(fertility.measures(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).collect()}
    assert all(out[i].kept for i in range(100)) and out[1000].reason == "low chars_per_token" and out[1001].reason == out[1002].reason == "base"


def test_fertility_query(spark, sf_tiny):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_tiny}/documents.parquet").select("doc_id", "text").collect()}
    for r in run_everywhere(fertility.op10_fertility, spark, sf_tiny).collect():
        n = counted(docs[r.doc_id])
        assert [r[c] for c in fertility.COUNTS[:5]] == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.base_failed and r.kept)


def in_duckdb(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return [tuple(r[i] for i in sorted(range(len(names)), key=lambda i: names[i])) for r in cur.fetchall()]


def by_name(df):
    return df.select(*sorted(df.columns))


def test_licences(spark, odd_docs, no_docs):
    s = licenses.SENTENCES
    texts = [
        "Released under the MIT License.", f"Intro. {s[8]}.\n{s[9].upper()}!", f"{s[9]}\n{s[8]}", f"{s[10]}. Other line. {s[11]}. {s[12]}.",
        f"{s[10]}\n{s[12]}\n{s[11]}\n{s[12]}", "Licensed under the Apache License, Version 2.0.\nYou may obtain a copy of the License at\n" * 2, "This  work is licensed under the GNU General Public License, version 3.5",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", "text").union(odd_docs.select("doc_id", "text"))
    found = licenses.scan(docs)
    assert rows_of(by_name(found).collect()) == rows_of(in_duckdb(licenses.sql(), documents=docs))
    rules = collections.Counter((r.doc_id, r.rule) for r in found.collect() if r.doc_id is not None)
    assert rules == {(0, "mit-notice"): 1, (1, "mit-text"): 1, (3, "bsd-text"): 1, (5, "apache-notice"): 2, (5, "apache-notice-with-address"): 2}
    assert licenses.scan(no_docs).count() == 0


def test_wrapped_licences(spark):
    """Headers as they stand in files: wrapped, in comments, and with the real Apache header."""
    import textwrap

    s = licenses.SENTENCES | licenses.MORE_SENTENCES
    apache = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
    wrapped = {n: textwrap.fill(t, 72) for n, t in s.items()}
    texts = [
        f"{wrapped[8]}:\n\n{wrapped[9]}.", textwrap.indent(f"{wrapped[13]}.\n\n{wrapped[14]}. If not, see", " * "),
        textwrap.indent(f"{wrapped[10]}:\n1. {wrapped[11]}.\n(2) {wrapped[12]}.\n{wrapped[22]}.", "# "), apache, textwrap.indent(apache, "// "),
        f"dnl {s[13][:60]}\ndnl {s[13][60:]}; {s[14]}", s[8][:70], "Released\nunder\nthe MIT License.",
    ]
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.rule) for r in found) == [
        (0, "mit-text"), (1, "gpl-header"), (2, "bsd-3-text"), (2, "bsd-text"), (3, "apache-header"), (4, "apache-header"), (5, "gpl-header"), (7, "mit-notice")]
    assert {(r.first_sentence, r.last_sentence) for r in found if r.doc_id in (3, 4)} == {(0, 2)}


def test_perspectives(spark):
    turns = [
        (1, 0, "system", "be brief"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello é"), (1, 3, "cyd", None), (1, 4, "ann", ""), (2, 0, "system", "alone"),
        (3, None, None, "late"), (3, 5, "x", "first"), (3, 5, "x", "first"), (None, 1, "u", "no id"), (None, 2, "v", "none"),
    ] + [(7, i, "ab"[i % 2], f"turn {i}") for i in range(700)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("name", F.lit(1)).withColumn("chars", F.lit(2))
    out = chat.rotate(df)
    assert rows_of(by_name(out).collect()) == rows_of(in_duckdb(chat.SQL, conversations=df))
    for key in ((1, "ann"), (1, "bob"), (7, "b")):
        rows = sorted((r for r in out.collect() if (r.conv_id, r.perspective) == key), key=lambda r: r.start)
        whole = "".join(r.rendered for r in rows)
        for r in rows:
            assert whole[r.start : r.stop] == r.rendered and (r.mask_start is not None) == (r.chat_role == "assistant")
            if r.mask_start is not None:
                assert whole[r.mask_start : r.mask_stop].endswith("<|im_end|>") and whole[: r.mask_start].endswith("assistant\n")
    assert chat.rotate(df.limit(0)).count() == 0
    assert out.where("conv_id = 2").count() == 0


def test_sql_queries(spark, sf_tiny):
    from oracle_check import compare, connect

    con = connect(sf_tiny)
    for name in ("op2_license_rules", "op3_perspectives"):
        assert compare(spark, con, name, sf_tiny)[0].startswith("ok"), name
