"""Registered queries against their SQL, brute force or held-out labels."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

import corpus_pipeline
from runsieve.llm import queries
from runsieve.llm.common import ascii_lower

NATIVE = ("op5_pii", "op7_positional_index", "op8_line_dedup", "op10_two_pass_shards")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf, name):
    ok, text = compare(spark, duck(sf), sf, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, text


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans(spark, sf, name):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin|SinglePartition", plan)


def test_entry_registers_every_operator():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op1_compression_quality"](spark, sf).collect()
    truth = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    rows = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows]) > 0.9


def test_language_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op2_language_mixture"](spark, sf).collect()
    truth = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    rows = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def brute_spans(text):
    # The patterns of the contract.
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def fine(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and luhn(d)
        return kind == "email" or 9 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, text or "") if fine(k, m.group())]


def test_personal_data_is_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    for r in queries.QUERIES["op5_pii"](spark, sf).collect():
        spans = brute_spans(texts[r.doc_id])
        joined = ",".join("%s:%d:%d" % s for s in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        assert set(joined.split(",")) <= set(r.spans.split(",")) | {""}


def test_shards_follow_the_law(spark, sf, documents):
    got = queries.QUERIES["op10_two_pass_shards"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in documents}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.size == len((texts[r.doc_id] or "").encode()) + 8
        assert r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
        assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_pipeline_keeps_what_it_should(spark, sf, documents):
    seen = {}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        seen[name] = docs.select("doc_id").rdd.map(lambda r: r[0]).collect()
        assert docs.columns[:5] == corpus_pipeline.COLUMNS
    by_id = {r["doc_id"]: r for r in documents}

    def shingles(text):
        w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    assert sorted(seen["language_id"]) == sorted(i for i, r in by_id.items() if re.search(r"[^\W\d_]", r["text"] or ""))
    sets = {i: shingles(by_id[i]["text"]) for i in seen["language_id"]}
    group = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0]
    while changed:
        changed = False
        for a, b in links:
            low = min(group[a], group[b])
            changed |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    assert sorted(seen["ngram_join"]) == sorted(i for i in sets if group[i] == i)
    hits = {r.doc_id for r in queries.QUERIES["op7_positional_index"](spark, sf).collect() if r.contaminated}
    assert sorted(seen["decontamination"]) == sorted(set(seen["ngram_join"]) - hits)
    assert set(seen["mixing"]) <= set(seen["decontamination"]) and sorted(seen["mixing"]) == sorted(seen["sharding"])


def test_ascii_lower(spark):
    rows = spark.createDataFrame([("ÀBcİK",), ("ABC",), ("",), (None,)], "t string").select(ascii_lower(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["Àbcİk", "abc", "", None]
