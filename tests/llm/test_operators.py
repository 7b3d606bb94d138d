"""The operators on awkward rows, empty tables and the given tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from gustframe.llm import encoding, hamming, language, licenses, mixing, near_dedup, quality, secretscan, tokens, toxicity
from gustframe.llm.decontaminate import contamination
from gustframe.plans.verify import _canon, digest, duck

SF = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"


def _labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 1, 1), (6, 1, 0), (7, 0, 0), (8, 0, 1), (99, 1, 1)], LABELS)


def _bench(spark):
    return spark.createDataFrame([(1, "Fox jumps over the"), (2, None), (3, "..."), (4, "lazy dog!")], "item_id long, text string")


OPERATORS = {
    "licenses": lambda s, d: licenses.license_scan(d, F.concat_ws("/", "source", F.col("doc_id").cast("string"))),
    "tokens": lambda s, d: tokens.token_output(d),
    "toxicity": lambda s, d: toxicity.by_toxicity(d, _labels(s)),
    "contamination": lambda s, d: contamination(d, _bench(s), window=3),
    "language": lambda s, d: language.by_language(d),
    "duplicates": lambda s, d: near_dedup.near_duplicates(d),
    "quality": lambda s, d: quality.by_quality(d, _labels(s)),
    "mixing": lambda s, d: mixing.mix(d),
    "secrets": lambda s, d: secretscan.secrets(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_and_empty_table(spark, docs, no_docs, name):
    run = OPERATORS[name]
    rows = run(spark, docs).collect()
    assert len(rows) == docs.count()
    twins = [r for r in rows if r.doc_id == 5]
    assert len(twins) == 2 and (name == "tokens" or twins[0] == twins[1])
    assert run(spark, no_docs).count() == 0


def test_duplicates_of_awkward_rows(spark, docs):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    assert [got[i].n_shingles for i in (1, 2, 3, 4)] == [0, 0, 0, 1] and got[6].component_id == 5 and not got[6].kept
    assert all(got[i].kept for i in (1, 2, 3, 4, 5, 7)) and got[None].component_id is None and got[None].kept


def test_duplicates_of_repeated_ids_with_other_texts(spark):
    """(5, A), (5, B) and near copies of A or B under other ids: no link is lost, whichever text comes first."""
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for case in range(10):
        words = [[f"c{case}t{k}w{i}" for i in rng.permutation(80)] for k in range(3)]
        near = [[*w[:79], "other"] for w in words]
        k = 10 * case
        rows += [(k + 5, " ".join(words[0])), (k + 5, " ".join(words[1])), (k + 9, " ".join(near[1])), (k + 8, " ".join(near[0])),
                 (k + 6, " ".join(words[1])), (k + 6, " ".join(words[2])), (k + 3, " ".join(near[2])), (k + 1, " ".join(near[2][1:40]))]
        want |= dict.fromkeys((k + 3, k + 5, k + 6, k + 8, k + 9), k + 3) | {k + 1: k + 1}
    docs = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "doc_id long, text string").repartition(4)
    got = near_dedup.near_duplicates(docs).select("doc_id", "component_id").collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == set(want.items())


def test_mixing_of_many_sources(spark):
    """50,000 sources: targets of the plain rule, all taken words near them."""
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("host"), F.format_string("%05d", F.col("id") % 50_000)).alias("source"),
                                    F.repeat(F.lit("word "), (F.col("id") % 7 * F.when(F.col("id") % 1000 == 0, 50).otherwise(1)).cast("int")).alias("text"))
    got = mixing.mix(df).toPandas()
    by = got.merge(df.select("doc_id", "source").toPandas(), on="doc_id").groupby("source").agg(
        size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), largest=("size", "max"))
    want = mixing.targets(by["size"].tolist(), [(5, 2, 1)[i % 3] for i in range(len(by))])
    assert len(by) == 50_000 and np.allclose(by.target, want, rtol=1e-12, atol=0)
    assert ((by.taken - by.target).abs() <= np.maximum(by.largest, 1)).all()


def test_mixing_of_overlapping_and_separate_sources(spark):
    """Patterns that share a source go through the flow, the others do not; both meet their targets."""
    rows = [(i, "one two three four", m) for i, m in enumerate((["a"], ["a", "b"], ["b"], ["c"], ["d"], ["d"], [], ["e", "f"]) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, members array<string>")
    narrow = mixing.seeded(docs, F.col("members"), "doc_id", "text", "mix")
    plan = mixing.make_plan(narrow)
    taken = mixing.copies(narrow, plan).groupBy("__pattern").agg(F.sum(F.col("__size") * F.col("__copies")).alias("w")).toPandas().set_index("__pattern").w
    goal = {r.name: r.target for r in plan.sources.collect()}
    assert goal == {"sa": 400, "sb": 160, "sc": 80, "sd": 400, "se": 160, "sf": 80}          # shares of all 1,280 words by 5, 2, 1, 5, 2, 1
    assert taken["[]"] == 0 and abs(taken['["sc"]'] - goal["sc"]) <= 4 and abs(taken['["sd"]'] - goal["sd"]) <= 4
    both = taken['["sa"]'] + taken['["sa","sb"]'] + taken['["sb"]']
    assert abs(both - goal["sa"] - goal["sb"]) <= 12 and abs(taken['["se","sf"]'] - goal["se"] - goal["sf"]) <= 4


def test_language_sample_is_the_first_by_hash(spark):
    rows = [(i % 900, "en" if i % 3 else "de", f"text number {i % 900} {'x' * (i % 90)}") for i in range(3000)] + [(7, "fr", "une ligne")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    got = sorted((r.lang, r.piece) for r in language.training_windows(docs, 30, 16).collect() for _ in range(r.copies))
    seed = F.xxhash64("doc_id", "text", F.lit("window"))
    at = F.pmod(seed, F.greatest(F.length("text") - 16, F.lit(0)) + 1).cast("int") + 1
    plain = docs.select("lang", seed.alias("seed"), F.substring("text", at, F.lit(16)).alias("piece")).toPandas()
    want = plain.sort_values(["lang", "seed", "piece"]).groupby("lang").head(30)
    assert got == sorted(zip(want.lang, want.piece)) and len(got) == 90


def _shuffled(plan) -> list[int]:
    """Rows that each exchange of an executed plan wrote."""
    name, below = plan.nodeName(), []
    if name.startswith("AdaptiveSparkPlan"):
        below = [plan.executedPlan()]
    elif name.endswith("QueryStage"):
        below = [plan.plan()]
    else:
        below = [plan.children().apply(i) for i in range(plan.children().size())]
    own = [plan.metrics().apply("shuffleRecordsWritten").value()] if name == "Exchange" else []
    return own + [n for p in below for n in _shuffled(p)]


def test_texts_of_nodes_without_pairs_are_not_shuffled(spark):
    """Whether or not the wanted nodes are few enough for a broadcast of their own."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").cast("binary").alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    twice = docs.union(docs.where("doc_id % 1000 = 0")).localCheckpoint()
    t = {r.doc_id: r.t for r in docs.where("doc_id % 1000 < 2").collect()}
    pairs = spark.createDataFrame([(i, t[i], i + 1, t[i + 1]) for i in range(0, 20_000, 1000)], near_dedup._PAIRS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = near_dedup._texts(pairs, twice)
        got = texts.collect()
        most = max(_shuffled(texts._jdf.queryExecution().executedPlan()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.doc_id, r.t) for r in got) == sorted(t.items()) and all(r.text.decode() == f"text {r.doc_id}" for r in got)
    assert 0 < most < 100


def test_duplicates_in_a_large_bucket(spark, monkeypatch):
    """Chains of near copies that no star finds, with small comparison blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.integers(0, 4)):
            own[rng.integers(0, 120)] = f"v{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[i:i + 5]) for i in range(116)} for _, t in rows]
    parent = list(range(60))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in range(60):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert got == {i: find(i) for i in range(60)} and 1 < len(set(got.values())) < 60


def test_contamination_spans(spark, docs):
    got = {r.doc_id: r for r in contamination(docs, _bench(spark), window=3).collect()}
    assert (got[5].n_hit, got[5].n_items, got[6].n_hit) == (6, 2, 6) and not got[7].contaminated and got[1].n_words == 0
    text = "The Quick brown FOX jumps over the lazy dog and runs away from it"
    assert [text[p.start:p.end] for p in got[6].passages] == ["FOX jumps over the lazy dog"]


def test_licence_inheritance(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "code here"), (3, "z/y.py", "code"),
            (4, "a/b/LICENSE", "Licensed under CC BY-NC 4.0."), (5, "a/q.py", "words before\nAll rights reserved.\n" + "word " * 300),
            (6, "ab/x.py", "nothing"), (7, None, None), (8, "top.py", "the MIT license was mentioned in this long sentence about other things")]
    got = {r.doc_id: (r.license, r.basis, r.from_folder) for r in licenses.license_scan(
        spark.createDataFrame(rows, "doc_id long, path string, text string"), F.col("path")).collect()}
    assert got[1] == ("MIT", "header", None) and got[2] == ("CC-BY-NC-4.0", "inherited", "a/b") and got[3] == (None, "none", None)
    assert got[4][0] == "CC-BY-NC-4.0" and got[5] == ("proprietary", "header", None) and got[6] == got[7] == got[8] == (None, "none", None)


def test_licence_texts_headers_and_names(spark):
    texts = {n: t for n, (t,) in licenses.bodies().items()}
    rows = [(f"{n}/LICENSE", f"Copyright (c) 2020 Some One\n\n{t}") for n, t in texts.items()] + [(f"{n}/src/x.py", "code") for n in texts]
    free = """# This file is part of Foobar.
#
# Foobar is free software: you can redistribute it and/or modify
# it under the terms of the GNU {}General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version.
#
# Foobar is distributed in the hope that it will be useful,
import os
x = 1
"""
    heads = {"g3.py": (free.format("", 3), "GPL-3.0"), "g2.py": (free.format("", 2), "GPL-2.0"), "l3.py": (free.format("Lesser ", 3), "LGPL-3.0"),
             "a3.py": (free.format("Affero ", 3), "AGPL-3.0"), "v2": ("GNU General Public License, version 2.", "GPL-2.0"),
             "l": ("SPDX-License-Identifier: LGPL-3.0", "LGPL-3.0"), "b2": ("SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"),
             "z": ("SPDX-License-Identifier: Zlib", None), "sa": ("Licensed under CC BY-SA 4.0.", None), "isc": ("SPDX-License-Identifier: ISC", "ISC"),
             "m": ("code\n/* " + texts["MIT"].replace("\n", "\n * ") + "*/\n" + "more code here\n" * 200, "MIT"),
             "b3": ("# " + texts["BSD-3-Clause"].replace("\n", "\n# ") + "\n" + "more code here\n" * 200, "BSD-3-Clause"),
             "two": ("SPDX-License-Identifier: MIT\nx\nSPDX-License-Identifier: Apache-2.0", "Apache-2.0,MIT"), "prose": ("the of and to a in that is was " * 300, None)}
    rows += [(n, t) for n, (t, _) in heads.items()]
    got = {r.path: r for r in licenses.license_scan(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, path string, text string"),
                                                    F.col("path")).collect()}
    assert {n: got[f"{n}/LICENSE"].file_license for n in texts} == {n: n for n in texts}
    assert {n: (got[f"{n}/src/x.py"].license, got[f"{n}/src/x.py"].from_folder) for n in texts} == {n: (n, n) for n in texts}
    assert {n: ",".join(sorted((got[n].header_licenses or "").split(","))) or None for n in heads} == {n: want for n, (_, want) in heads.items()}


def test_top_k_with_ties_nulls_and_copies(spark):
    rows = [(i, [1.0] * 64 if i < 30 else [float((i * j) % 7 - 3) for j in range(64)]) for i in range(60)]
    rows += [(60, None), (None, [1.0] * 64), (61, []), (0, [1.0] * 64)]
    odd = [(80, [1.0] * 60), (81, [1.0] * 65)]                       # of another length: neither asked nor found
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = {}
    for r in hamming.top_k(df, lambda i: i % 20 == 0, k=4).collect():
        got.setdefault(r.vec_id, []).append((r.distance, r.neighbour))
    code = {i: [x > 0 for x in v] for i, v in rows if v and i is not None}
    for q in (0, 20, 40):
        want = sorted((sum(a != b for a, b in zip(code[q], code[i])), i) for i in code if i != q)[:4]
        assert sorted(got[q]) == want
    assert set(got) == {0, 20, 40} and hamming.top_k(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_tokens_read_back_what_the_library_encodes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in tokens.token_output(docs).collect()}
    encoder, at = encoding.ByteBpe(tokens.TOKENIZER), 0
    for r in docs.orderBy("doc_id").collect():
        ids = encoder.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens) == (at, len(ids))
        assert got[r.doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_mix_reaches_targets_and_copies_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("all"), F.max("size").alias("one"))
    for r in by.collect():
        assert abs(r.taken - r.target) <= r.one / 2 and r.target <= 3 * r["all"]
    total = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    mixed = mixing.mixed(docs, F.array("source"))
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORDS)))).first()[0] == total


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    lang = language.by_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert lang.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    for found, name in ((toxicity.by_toxicity(docs, labels), "toxic"), (quality.by_quality(docs, labels), "quality")):
        both = found.join(labels, "doc_id").where("held_out")
        assert both.agg(F.avg((F.col(name) == F.col("predicted")).cast("int"))).first()[0] > 0.95


@pytest.mark.parametrize("name", [n for n in E.oracle_sql() if n.startswith("op")])
def test_query_matches_sql(spark, name):
    a, b = _canon(E.queries()[name](spark, SF).toPandas()), _canon(duck(SF).execute(E.oracle_sql()[name]).df())
    assert len(a) == len(b) and digest(a) == digest(b)


def test_pipeline_stages_on_awkward_rows(spark, docs, no_docs):
    """Null ids, null and empty texts, repeated rows, and columns named like those the operators add."""
    import corpus_pipeline as P
    names = ("copies", "kept", "contaminated", "passages", "lang_pred", "n_words", "component_id", "cut_key", "held_out")
    wide = docs.withColumns({c: F.lit(1) for c in names}).withColumn("a column", F.lit("x"))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    every = wide.collect()
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, wide, SF)
        assert got.columns == wide.columns and set(got.collect()) <= set(every), name
        assert stage(spark, wide.limit(0), SF).count() == stage(spark, no_docs, SF).count() == 0, name
    lettered = {r.doc_id for r in every if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in P.language_id(spark, wide, SF).collect()} <= lettered
    assert sorted(r.doc_id or 0 for r in P.near_dedup(spark, wide, SF).collect()) == [0, 1, 2, 3, 4, 5, 5, 7, 8, 9, 10, 11]
    clean = contamination(docs, bench).where("not contaminated")
    assert P.decontamination(spark, wide, SF).count() == clean.count()
    taken = {(r.doc_id, r["size"]): r.taken for r in mixing.mix(wide).collect()}
    mix = P.mixing(spark, wide, SF)
    for r in mix.groupBy("doc_id", F.regexp_count("text", F.lit(mixing.WORDS)).alias("words_in")).count().collect():
        rows = 2 if r.doc_id == 5 else 1
        assert taken[r.doc_id, r.words_in] * rows == r["count"] * r.words_in
    assert P.tokens(spark, wide, SF).count() == wide.count() and P.tokens(spark, no_docs, SF).count() == 0


def test_pipeline_stages_equal_their_operators(spark):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = P.language_id(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() == docs.where("text is not null").count()
    unique = P.near_dedup(spark, kept, SF)
    assert {r.doc_id for r in unique.collect()} == {r.doc_id for r in near_dedup.near_duplicates(kept).where("kept").collect()}
    clean = P.decontamination(spark, unique, SF)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert clean.count() == unique.count() - contamination(unique, bench).where("contaminated").count()
    mix = P.mixing(spark, clean, SF)
    out = P.tokens(spark, mix, SF)
    assert out.count() == mix.count() == P.run(spark, SF).count() and len(P.STAGES) == 5
