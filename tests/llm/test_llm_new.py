"""Packing, collocations and conversation repair against brute force, with nulls, empties, repeats and clashes."""

from __future__ import annotations

import hashlib
import itertools
import random
import struct
from collections import Counter, defaultdict
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runsieve.llm import collocations, conversations, packing, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path(queries.TOKENIZER)
TEXT = "Naïve CAFÉ's don't stop, 3.14 <|endoftext|> <|ENDOFTEXT|> é end. x ?!a.b I'LL 日本語 İ ß"


def _pieces_by_hand(rows, ids_of):
    return Counter((i, tuple([*ids_of(t), 1])) for i, t in rows)


def _check_packing(pieces, rows, ids_of, capacity):
    """Each id in one piece, sequences gapless and not above the capacity."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = struct.unpack(f"<{p.length}I", bytes(p.ids))
        sequences[p.sequence_id].append((p.offset, p.length))
        documents[p.doc_id].append((p.doc_tokens, p.start, ids))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(sequences) == list(range(len(sequences)))
    wanted = defaultdict(list)
    for i, t in rows:
        wanted[i].append((*ids_of(t), 1))
    for i, texts in wanted.items():
        ids = sorted(x for t in texts for x in t)
        assert sorted(x for _, _, part in documents[i] for x in part) == ids
        for n, start, part in documents[i]:
            assert any(len(t) == n and t[start : start + len(part)] == part for t in texts)
    assert set(documents) == set(wanted)
    return sum(capacity - sum(n for _, n in spans) for spans in sequences.values())


def test_packing_is_brute_force(docs, spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(MODEL)

    def ids_of(text):
        return tokenizer.encode(text or "", add_special_tokens=False).ids

    rng = random.Random(3)
    rows = [(i, " ".join(f"{rng.choice('abcdef')}{rng.randrange(40)}" for _ in range(rng.randrange(1, 400)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, TEXT), (None, "no id"), (204, "same"), (204, "same"), (205, "long words " * 30_000)]
    frame = docs(rows, 5).withColumn("start", F.lit("clash")).withColumn("ids", F.lit(0))
    pieces = packing.pack(frame, MODEL)
    got = pieces.collect()
    waste = _check_packing(got, rows, ids_of, 2048)
    assert waste <= 0.03 * sum(p.length for p in got) + 2048
    whole = packing.sequences(pieces).collect()
    assert {s.sequence_id: len(s.ids) // 4 for s in whole} == {s.sequence_id: s.tokens for s in whole}
    small = packing.pack(docs(rows[:40], 3), MODEL, capacity=64)
    _check_packing(small.collect(), rows[:40], ids_of, 64)
    assert packing.pack(docs([]), MODEL).count() == 0


def test_other_tokenizers_take_whole_texts():
    other = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    model = open(other, encoding="utf-8").read()
    assert not packing.parts_words(model) and packing.parts_words(open(MODEL, encoding="utf-8").read())
    texts = ["one  two", None, TEXT]
    got = [list(x) for x in packing.WordIds(model).texts(iter(texts))]
    assert got == [Tokenizer.from_file(other).encode(t or "", add_special_tokens=False).ids for t in texts]


def test_piece_lengths():
    for n in range(1, 6_000, 7):
        lengths = packing.piece_lengths(n)
        assert sum(lengths) == n and all(packing.FILL * 2048 <= 2048 // x * x <= 2048 for x in lengths[-1:])


def _brute_collocations(rows, least, top, percent=100):
    out, lower = {}, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    pieces = defaultdict(list)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            pieces[lang if lang is not None else "und"].append([w for w in re.split("[ \t]+", piece) if w])
    for lang, lists in pieces.items():
        n = sum(map(len, lists))
        f = Counter(tuple(w[i : i + k]) for w in lists for k in range(1, 6) for i in range(len(w) - k + 1))
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in good.items():
            score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            inside = any(100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in good.items() if len(q) > len(p))
            if not inside:
                ranked.append((-score, -a, " ".join(p).encode(), l, r, n))
        out[lang] = [(i + 1, s[2].decode(), -s[1], *s[3:], -s[0]) for i, s in enumerate(sorted(ranked)[:top])]
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("held", [4, 1 << 19])
def test_blocks_of_a_task_share_their_windows(monkeypatch, held):
    """A task's blocks give each window once, unless it holds too many; the counts stay."""
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 64)
    monkeypatch.setattr(collocations, "MERGE_ROWS", held)
    every = SimpleNamespace(value=b"\xff" * (1 << (collocations.TABLE_BITS - 3)))
    texts = pa.RecordBatch.from_arrays([pa.array(["en", "de"] * 50), pa.array(["a b c d e f. g \u00e4"] * 100)], names=["lang", "text"])
    rows = [tuple(r.values()) for b in collocations._windows(every, every)(iter([texts])) for r in b.to_pylist()]
    sums = Counter()
    for *window, n in rows:
        sums[tuple(window)] += n
    words = "a b c d e f".split()
    want = [words[i : i + 5] for i in range(6)] + [["g", "\u00e4"], ["\u00e4"]]
    assert sums == {(lang, *w, *[None] * (5 - len(w))): 50 for lang in ("en", "de") for w in want}
    assert held < 100 or len(rows) == len(sums)


def test_window_rows_do_not_grow_with_splits(spark, monkeypatch):
    """Equal texts in more splits than cores: each core gives each window once, and every text is counted."""
    made, windows = spark.sparkContext.accumulator(0), collocations._windows

    def counted(*tables):
        run = windows(*tables)

        def more(batches):
            for batch in run(batches):
                made.add(batch.num_rows)
                yield batch

        return more

    monkeypatch.setattr(collocations, "_windows", counted)
    cores = spark.sparkContext.defaultParallelism
    frame = spark.range(20 * cores, numPartitions=5 * cores).select(F.lit("en").alias("lang"), F.lit("a b c d e f. g h").alias("text"))
    got = {(r["size"], r.phrase): r.f for r in collocations.phrase_counts(frame, 6).collect()}
    words = "a b c d e f".split()
    want = [" ".join(words[i : i + k]) for k in range(1, 6) for i in range(7 - k)] + ["g", "h", "g h"]
    assert got == {(0, ""): 160 * cores, **{(len(p.split()), p): 20 * cores for p in want}}
    assert 0 < made.value <= 8 * cores


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_collocations_are_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    rng = random.Random(4)
    words = ["alpha", "Beta", "é", "İx", "d'e", "zz", " q", "und"]
    rows = [
        (rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", "\r\n", ",", " ; "]) for _ in range(rng.randrange(60))))
        for _ in range(80)
    ]
    rows += [("en", None), ("fr", ""), ("xx", ".,;"), (None, "alpha " * 500), ("en", "one two three four five six. " * 9)]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(4).withColumn("n", F.lit(1)).withColumn("phrase", F.lit("clash"))
    got = defaultdict(list)
    for r in collocations.collocations(frame, 6, 40).orderBy("lang", "rank").collect():
        got[r.lang].append((r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score))
    assert dict(got) == _brute_collocations(rows, 6, 40)
    assert collocations.collocations(frame.limit(0)).count() == 0


def _brute_repair(rows):
    """All edit paths in order of cost and letters, by dynamic programming over whole strings."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    start = {"": (0, "", ())}
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def inserted(paths):
        best = dict(paths)
        for q, (cost, audit, said) in paths.items():
            for _ in range(2):
                q = step[q]
                cost, audit, said = cost + 3, audit + "I", (*said, name[q] + ":")
                best[q] = min(best.get(q, (10**9,)), (cost, audit, said))
        return best

    paths = start
    for (role, text), fault in zip(rows, faults):
        after = {}
        for q, (cost, audit, said) in inserted(paths).items():
            extra = 3 if fault == "t" else 0
            options = [(q, 4, "D", ())]
            if fault not in ("b", "d"):
                options.append((step[q], 3 + extra, "R", (f"{name[step[q]]}:{text}",)))
                if role[:1] == step[q] or (q == "" and role[:1] == "s"):
                    options.append((role[:1], extra, "K", (f"{role}:{text}",)))
            for to, price, letter, line in options:
                after[to] = min(after.get(to, (10**9,)), (cost + price, audit + letter, said + line))
        paths = after
    cost, audit, said = min(v for q, v in inserted(paths).items() if q in ("", "a"))
    return [faults.count(x) for x in "bdt"] + [cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()]


@pytest.mark.parametrize("spill,batch", [(1 << 20, 10_000), (16, 3)])
def test_repair_is_brute_force(spark, spill, batch):
    rng = random.Random(8)
    roles, texts = ["system", "user", "assistant", "tool", "", None], ["Yes.", "No", " ", "", None, "Why?\n", "ok", "fine!"]
    rows = [
        (c if c < 39 else None, t if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(texts) if rng.random() < 0.7 else f"t{rng.randrange(99)}.")
        for c in range(40) for t in range(rng.randrange(0, 12))
    ]
    rows += [(77, 2**60 + i, "user" if i % 2 == 0 else "assistant", f"n {i}.") for i in range(60)] + [(78, 5, "user", "Same."), (78, 5, "user", "Same.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).withColumn("cost", F.lit(1)).withColumn("_key", F.lit(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        repairs = conversations.repair(frame, spill).cache()
        got = {r.conv_id: r for r in repairs.collect()}
        turns = defaultdict(list)
        for r in conversations.repaired_turns(frame, repairs).orderBy("conv_id", "turn").collect():
            turns[r.conv_id].append(f"{r.role}:{r.text}")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by_conv = defaultdict(list)
    for c, t, role, text in rows:
        by_conv[c].append(((t is not None, t or 0), " " if role is None else role, " " if text is None else text))
    assert set(got) == set(by_conv)
    for c, items in by_conv.items():
        items.sort()
        r = got[c]
        assert [r.blank, r.duplicate, r.truncated, r.cost, r.audit, r.repaired_sha256] == _brute_repair([i[1:] for i in items])
        known = [i[0][1] for i in items if i[0][0]]
        assert r.gaps == (max(known) - min(known) + 1 - len(set(known)) if known else 0)
        assert r.illegal == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(items))
        assert hashlib.sha256("\n".join(turns[c]).encode()).hexdigest() == r.repaired_sha256


def test_repair_edges(spark):
    rows = [(1, 0, "user", "Gone.", True), (1, 1, "user", "Gone.", True), (2, 0, "user", "Hi.", False), (2, 1, "user", None, True)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, dropped boolean")
    got = {r.conv_id: r for r in conversations.repair(frame).collect()}
    assert (got[1].rows, got[1].cost, got[1].audit, got[1].repaired_sha256) == (0, 0, "", hashlib.sha256(b"").hexdigest())
    assert (got[2].rows, got[2].cost, got[2].audit) == (1, 3, "KI")
    assert conversations.repair(frame.limit(0)).count() == 0
