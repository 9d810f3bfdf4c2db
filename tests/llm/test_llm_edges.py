"""Nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from runsieve.llm import compression, cover_tree, decontam, language_mix, line_dedup, mixing, ngram_join, pii, sharding, warc
from runsieve.llm.components import connected
from runsieve.llm.shingles import parity, shingle_sets

LONG = "word " * 200_000
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, "a text of a null id"), (5, "Same same"), (5, "Same same"), (6, LONG)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (None, 3)]
    group = {}
    for a, b in edges:
        if a is not None and a != b:
            group.setdefault(a, a), group.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            if a in group and b in group and a != b:
                group[a] = group[b] = min(group[a], group[b])
    got = {r.id: r.component_id for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == group
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines(docs):
    shared = [(i, f"own {i}\n  SHARED line \n\nshared LINE") for i in range(10, 20)]
    got = line_dedup.dedup_lines(docs([*shared, *EDGES, (7, "\n".join(["shared line"] * 3))]).withColumn("n_lines", F.lit("x")), 10).collect()
    by_id = {(r.doc_id, r.text): r for r in got}
    assert len(got) == len(shared) + len(EDGES) + 1
    for i, t in shared:
        assert (by_id[i, t].n_lines, by_id[i, t].n_dropped, by_id[i, t].kept_text) == (4, 2, f"own {i}\n")
    assert by_id[7, "\n".join(["shared line"] * 3)].kept_text == ""
    assert (by_id[1, None].n_lines, by_id[1, None].kept_text) == (1, "") and by_id[2, ""].n_dropped == 0
    assert by_id[6, LONG].kept_text == LONG and sum(r.doc_id == 5 for r in got) == 2
    assert line_dedup.dedup_lines(docs([])).count() == 0


def test_shards(docs):
    rows = [*EDGES, *[(100 + i, f"text {i}" * 50) for i in range(300)]]
    got = sharding.shuffle_into_shards(docs(rows).withColumn("shard", F.lit("x")), 5, bucket_bytes=2000).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t in rows)
    for s in range(5):
        mine = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        assert [r.doc_id for r in mine] != sorted(r.doc_id or 0 for r in mine)
    assert sharding.shuffle_into_shards(docs([])).count() == 0


def test_pii(docs):
    iban = "GB82 WEST 1234 5698 7654 32"
    rows = [
        *EDGES,
        (10, f"é😀 my card 4111 1111 1111 1111, not 4111 1111 1111 1112; iban {iban} call +1 (555) 010-2030."),
        (11, "a..b@c-d.e.f x@y 1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.255"),
        (12, "9" * 30_000 + " " + "1 " * 20_000 + "a@" + "b." * 20_000 + "c"),
        (13, "GB82 WEST 1234 5698 7654 33"),
    ]
    got = {r.doc_id: r for r in pii.find_pii(docs(rows).withColumn("pii", F.lit(0))).collect()}
    found = [(s.kind, s.text, s.checked) for s in got[10].pii]
    assert found == [("card", "4111 1111 1111 1111", True), ("phone", "+1 (555) 010-2030", False), ("iban", iban, True)]
    text = rows[len(EDGES)][1]
    assert all(text[s.start : s.end] == s.text for s in got[10].pii)
    assert [s.score for s in got[10].pii] == pytest.approx([1.0, 0.7, 1.0])
    assert [(s.kind, s.text) for s in got[11].pii] == [
        ("email", "a..b@c-d.e.f"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("ip", "01.002.0003.255"),
    ]
    assert [s.kind for s in got[12].pii] == ["email"] and got[13].pii == [] and got[1].pii == [] and got[None].pii == []
    assert pii.find_pii(docs([])).count() == 0


def test_phrases(docs, spark):
    item = [f"t{i}" for i in range(30)]
    words = " ".join(item)
    items = spark.createDataFrame([(1, words), (2, "short item here"), (3, None), (4, ""), (2, "short item here"), (None, "null id item")], "item_id long, text string")
    rows = [
        *EDGES,
        (20, "x, " + words.upper() + "; y"),
        (21, " ".join(item[8:22])),
        (22, " ".join(item[:12])),
        (23, "w " * 100 + "SHORT-item here"),
        (24, " ".join(item[:13]) + " gap " + " ".join(item[5:20])),
    ]
    got = {(r.doc_id, r.n_words): r for r in decontam.contamination(docs(rows), items).collect()}
    assert (got[20, 32].n_hit, got[20, 32].n_items, got[20, 32].contaminated) == (30, 1, True)
    assert got[21, 14].n_hit == 14 and got[22, 12].n_hit == 0
    assert got[23, 103].n_hit == 3 and not got[23, 103].contaminated
    assert got[24, 29].n_hit == 28 and got[24, 29].items_sha256 == hashlib.sha256(b"1").hexdigest()
    assert got[1, 0].n_words == 0 and not got[1, 0].contaminated and got[6, 200_000].n_hit == 0
    kept = decontam.decontaminate(docs(rows).withColumn("extra", F.lit(1)), items)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 5, 6, 22, 23]
    assert decontam.contamination(docs([]), items).count() == 0
    assert {r.n_hit for r in decontam.contamination(docs(rows), items.limit(0)).collect()} == {0}


def test_proximity(docs, spark):
    item = [f"t{i}" for i in range(20)]
    loose = [w for i, t in enumerate(item) for w in ([t, "um"] if i in (5, 11) else [t])]
    items = decontam.item_words(spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    items = items.withColumn("term", F.xxhash64("word").bitwiseAND(F.lit((1 << 62) - 1)))
    index = decontam.build_index(docs([(1, "a b " + " ".join(loose)), (2, "t1 t2 only")]), items.select("word", "term").distinct())
    assert [(r.doc_id, r.n_terms) for r in decontam.find_near(index, items).collect()] == [(1, 20)]


def test_mixing(docs, spark):
    base = docs([*EDGES[:6], *[(100 + i, "abc" * 20) for i in range(4000)]]).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "even").when(F.col("doc_id") > 3, "odd"))
    rates = spark.createDataFrame([("even", 0.5), ("odd", 40.0), (None, 1.0)], "source string, rate double")
    got = mixing.mix(base.withColumn("copy", F.lit("x")), rates)
    n = {r.source: r.n for r in got.filter("doc_id >= 100").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["even"] / 2000 - 0.5) < 0.08 and abs(n["odd"] / 2000 - 40) < 1
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.mix(base.repartition(7), rates).collect()))
    assert mixing.mix(docs([]).withColumn("source", F.lit("a"))).count() == 0
    with_null = docs([(None, "x")] * 50).withColumn("source", F.lit(None).cast("string"))
    assert {r.copy for r in mixing.mix(with_null).collect()} <= set(range(20))


def test_warc(spark, tmp_path):
    evil = "<p>WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n</p>"
    rows = [
        (1, "http://a\r\nX: y", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "u", None), (4, "u", ""), (5, "u", evil),
        (6, "u", evil), (7, "u", "WARC/1.1\r\n"), (8, "u", "é😀"), (9, "u", "x" * 300_000 + "WARC/1.1\r\n" + "y" * 300_000), (None, "u", "n"), (10, "u", "end\r\n\r\n"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("header", F.lit(1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        path = str(tmp_path / "warc")
        warc.write_archives(pages.coalesce(2), path)
        got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(rows)
    import base64

    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode()), i
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {2: 1, 4: 3, 6: 5}
    assert got[1].url == "http://a%0D%0AX: y"
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_long_url(spark, tmp_path):
    """A header block above 64 KB does not end the chain of its file, and its revisit finds it."""
    rows = [(1, "http://a/" + "x" * 200_000, "<p>long</p>"), (2, "u", "<p>long</p>"), (3, "v" * 70_000, "WARC/1.1\r\nabc"), (4, "w", "<p>last</p>")]
    path = str(tmp_path / "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert {i: (r.url, r.payload_bytes) for i, r in got.items()} == {i: (url, len(html)) for i, url, html in rows}
    assert got[2].refers_to == 1 and all(r.payload_digest for r in got.values())


@pytest.mark.parametrize("marks", [100_000, 0])
def test_warc_splits_change_between_scans(spark, tmp_path, monkeypatch, marks):
    """Payloads with a magic are whole also if a second scan cuts the files in another way."""
    inner = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, "u", f"{i} " + ("x" * (900 * i) + "WARC/1.1\r\n" + inner * 2) * (i % 3)) for i in range(1, 40)] + [(50, "u", "WARC/1.1\r\n")]
    rows += [(100 + i, "u", html) for i, _, html in rows[:9]]
    sizes, cut = iter(["100k", "30k", "70k", "50k"]), warc.segments

    def segments(spark, path):
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        return cut(spark, path)

    monkeypatch.setattr(warc, "segments", segments)
    monkeypatch.setattr(warc, "MARKS", marks, raising=False)
    path = str(tmp_path / "warc")
    try:
        warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), path)
        got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    import base64

    want = {i: (len(html), base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()) for i, _, html in rows}
    assert {i: (r.payload_bytes, r.payload_digest) for i, r in got.items()} == want


def brute_groups(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    group = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while any(group[a] != group[b] for a, b in links):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    return {i: (len(s), group[i]) for i, s in sets.items()}


@pytest.mark.parametrize("frequent,paired", [(32, 1024), (0.5, 1024), (0.5, 40)])
def test_ngram_join_is_brute_force(docs, monkeypatch, frequent, paired):
    """Also with most tokens in the frequent class, and with large sets that index them singly."""
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "PAIRED_SIZE", paired)
    rng = random.Random(5)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(5, 90))] for _ in range(12)]
    rows = []
    for i in range(160):
        w = list(base[rng.randrange(12)])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "one two"), (905, LONG), (906, LONG + "end")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs(rows), 3, 80).collect()}
    assert got == brute_groups(rows, 3, 80)


def test_ngram_join_edges(docs):
    got = ngram_join.similar_groups(docs(EDGES)).collect()
    assert len(got) == len(EDGES) and {r.component_id for r in got if r.doc_id is None} == {None}
    assert ngram_join.similar_groups(docs([])).count() == 0
    kept = ngram_join.keep_one(docs([*EDGES, (8, "same SAME")]).withColumn("n", F.lit(1)))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6]
    # An id that repeats with another text loses only the copy; of rows without an id one of a kind stays.
    text = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(1, text), (2, text), (2, "a clean text of its own words here"), (None, text), (None, "only here and nowhere else today"), (None, "only here and nowhere else today")]
    kept = sorted((r.doc_id or 0, r.text) for r in ngram_join.keep_one(docs(rows)).collect())
    assert kept == [(0, rows[4][1]), (1, text), (2, rows[2][1])]


def test_ngram_join_with_a_shared_passage(docs):
    """Many unlike documents around one passage, some of them near copies of each other, meet once a pair."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = []
    for i in range(60):
        own = " ".join(f"u{i if i % 5 else 0}x{j}" for j in range(12 + i % 5))
        rows.append((i, own + " " + passage + (" tail" if rng.random() < 0.5 else "")))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs(rows), 5, 80).collect()}
    assert got == brute_groups(rows, 5, 80)


def test_words_with_nul_differ(docs):
    words = "a b c d e f g h i j k l".split()
    rows = [(1, " ".join(words)), (2, " ".join(["a\0", *words[1:]])), (3, "a \0 b"), (4, "a \0\0 b"), (5, "\0"), (6, "\0\0")]
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(docs(rows), 3, 90).collect()}
    assert got == {i: i for i, _ in rows}
    long = [bytes(97 + (bin(i).count("1") + flip) % 2 for i in range(2048)).decode() for flip in (0, 1)]
    a, b = shingle_sets(long, 1)
    assert a[0] != b[0]


@pytest.mark.parametrize("text", ["a" * 300_000 + " @ 3.1", "1" * 300_000 + " 3.1 @", "b" * 200_000 + "@" + "c" * 200_000])
def test_pii_long_runs(docs, text):
    assert pii.find_pii(docs([(1, text)])).select("pii").first()[0] == []


def test_pii_many_spans(docs):
    text = "1.1.1.1 " * 3_000 + "a@b.c_d@e.f"
    spans = pii.find_pii(docs([(1, text)])).select("pii").first()[0]
    assert [s.start for s in spans if s.kind == "ip"] == [8 * i for i in range(3_000)]
    assert [(s.text, s.start) for s in spans if s.kind == "email"] == [("a@b.c", 24_000), ("_d@e.f", 24_005)]
    iban = "ES91 2100 0418 4502 0005 1332"
    got = pii.find_pii(docs([(1, iban + " EUR"), (2, iban + " IS IT"), (3, iban)])).select("doc_id", "pii.text").collect()
    assert {r.doc_id: r.text for r in got} == {1: [iban], 2: [iban], 3: [iban]}


def test_slots_do_not_depend_on_the_layout(docs):
    rows = [(i % 400, f"text {i % 300}") for i in range(1_000)] + [(7, "same")] * 200
    slots = [
        sorted((r.doc_id, r.text, r.shard, r.slot) for r in sharding.shuffle_into_shards(docs(rows, parts), 4, bucket_bytes=2_000).collect())
        for parts in (2, 7)
    ]
    assert slots[0] == slots[1] and len(slots[0]) == len(rows)


def test_parity_bounds_difference():
    a, b = list(shingle_sets([" ".join(map(str, range(90))), " ".join(map(str, range(20, 110)))], 2))
    bits = sum(int(x).bit_count() for x in (parity(a, 8) ^ parity(b, 8)).view(np.uint64))
    assert bits <= len(np.setxor1d(a, b))


def vectors_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)


def brute_vectors(rows, threshold):
    ok = {i: np.asarray(v, np.float32).astype(float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    ids = sorted(ok)
    x = np.array([ok[i] / np.linalg.norm(ok[i]) for i in ids])
    near = x @ x.T >= threshold
    comp = {i: i for i, _ in rows}
    for _ in range(len(ids)):
        old = dict(comp)
        for a, i in enumerate(ids):
            comp[i] = min(comp[ids[b]] for b in np.flatnonzero(near[a]))
        if comp == old:
            break
    links = {i: int(near[a].sum()) - 1 for a, i in enumerate(ids)}
    return {i: (links.get(i, 0), comp[i], comp[i] == i) for i, _ in rows}


@pytest.mark.parametrize("block,sample", [(8192, 1024), (64, 16), (16, 200)])
def test_cover_tree_is_brute_force(spark, monkeypatch, block, sample):
    """Also with small blocks and few centres, so that nodes are split, shared and pruned."""
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    monkeypatch.setattr(cover_tree, "SAMPLE", sample)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(14, 12))
    rows = [(i, (centres[rng.integers(14)] + rng.normal(scale=rng.choice([0.02, 0.15, 0.3]), size=12)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(30)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 12), (2003, [float("nan")] * 12), (2004, [float("inf")] + [1.0] * 11), (2005, [None] + [1.0] * 11)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover_tree.linked_vectors(vectors_frame(spark, rows)).collect()}
    assert got == brute_vectors(rows, 0.95)


def test_cover_tree_edges(spark):
    assert cover_tree.linked_vectors(vectors_frame(spark, [])).count() == 0
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (3, [2.0, 0.0]), (1, [1.0, 0.0])]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in cover_tree.linked_vectors(vectors_frame(spark, rows)).collect())
    assert got == [("1", 1, "1"), ("1", 1, "1"), ("2", 0, "2"), ("3", 1, "1"), ("None", 0, "None")]


def test_quality_edges(docs, spark):
    rng = random.Random(2)
    good = [(i, " ".join(rng.choice(["river", "stone", "light", "garden"]) for _ in range(40))) for i in range(60)]
    bad = [(100 + i, "".join(rng.choice("#$%!") for _ in range(150))) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in [*good[:50], *bad[:50]]] + [(1, 5), (None, 1), (2, None)], "doc_id long, quality int")
    got = compression.quality_scores(docs([*good, *bad, *EDGES]).withColumn("score", F.lit("x")), labels).collect()
    assert len(got) == 120 + len(EDGES) and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    assert min(score[i] for i, _ in good[50:]) > 0.5 > max(score[i] for i, _ in bad[50:])
    assert compression.quality_scores(docs([]), labels).count() == 0
    assert {round(r.score, 6) for r in compression.quality_scores(docs(EDGES), labels.limit(0)).collect()} == {0.5}


def test_language_edges(docs, spark):
    a, b = "the cat and the dog of this house ", "der hund und die katze von diesem haus "
    known = docs([(i, (a if i % 2 else b) * 5) for i in range(40)]).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))
    known = known.unionByName(docs(EDGES).withColumn("lang", F.lit(None).cast("string")))
    rows = [*EDGES, (50, a), (51, b), (52, a * 9 + b * 9), (53, "123 !?")]
    got = {r.doc_id: r for r in language_mix.languages(docs(rows).withColumn("score", F.lit(1)), known).collect()}
    assert got[50].lang_pred == "en" and got[51].lang_pred == "de"
    assert {m.lang for m in got[52].mixture} == {"en", "de"} and abs(got[52].score - 0.5) < 0.15
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 53))
    assert {r.lang_pred for r in language_mix.languages(docs(rows), known.limit(0)).collect()} == {"und"}
    assert language_mix.languages(docs([]), known).count() == 0
    kept = language_mix.identified(docs(rows).withColumn("lang", F.lit(None).cast("string")), known)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 5, 5, 6, 50, 51, 52]


@pytest.mark.parametrize("lang", [None, ""])
def test_language_stage_without_labels(docs, spark, lang):
    rows = docs([*EDGES, (50, "a clean text"), (53, "123 !?")])
    rows = rows.select("doc_id", "text", F.lit(lang).cast("string").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    kept = corpus_pipeline.identify(spark, rows, "")
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 5, 5, 6, 50]


def test_every_language_is_learned(docs, spark):
    rng = random.Random(4)
    words = {f"l{i:02d}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(8)] for i in range(70)}
    rows = [(name, " ".join(rng.choices(w, k=30))) for name, w in words.items() for _ in range(3 if name < "l64" else 2)]
    known = spark.createDataFrame([(i, t, name) for i, (name, t) in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_mix.languages(known, known).collect()}
    assert got == {i: name for i, (name, _) in enumerate(rows)}
    few = language_mix.fit(known, 1)
    assert few.names == sorted(words) and set(few.langs.tolist()) == set(range(70))
