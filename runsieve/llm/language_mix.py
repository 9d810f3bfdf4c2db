"""Languages of a text as a mixture inferred by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runsieve.llm.common import ship, stored

ship(__name__)

#: Documents of a language that may be used, by smallest hash of the id; the only bound of the model.
SAMPLE_ROWS = 400
#: Cells that hashed n-grams of 1 to 4 bytes fall into, and weight of an unseen one.
CELLS, SMOOTH = 1 << 16, 0.5
ROUNDS = 12
_NOT_LETTERS = regex.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    """Likelihoods of the cells under each language: ``base`` where it has not seen the cell, and for the
    cells it has seen, ordered by cell from ``starts``, the language and what comes on top."""

    names: list[str]
    base: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    more: np.ndarray


def ngrams(text: str) -> np.ndarray:
    """Cells of all n-grams of 1 to 4 bytes of the lower-cased text with everything but letters as one blank."""
    data = np.frombuffer(b" " + _NOT_LETTERS.sub(b" ", text.lower().encode("utf-8", "surrogatepass")) + b" ", np.uint8).astype(np.uint32)
    key, out = data, [data]
    for n in (2, 3, 4):
        key = key[:-1] * np.uint32(0x01000193) ^ data[n - 1 :]
        out.append((key * np.uint32(0x9E3779B1)) >> np.uint32(16))
    return np.concatenate(out).astype(np.int64)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    cells = np.bincount(ngrams(text), minlength=CELLS)
    seen = np.flatnonzero(cells)
    return seen, cells[seen].astype(float)


def _sample(known: DataFrame, sizes: dict[str, int], rows: int) -> DataFrame:
    """``doc_id, lang`` of the ``rows`` smallest hashes of each language.

    A hash bound that some more than ``rows`` documents should pass is set for each language and raised
    until enough pass, so that only about so many rows are ordered, however large a language is.
    """
    spark, share = known.sparkSession, {name: (rows + 8 * rows**0.5 + 32) / n for name, n in sizes.items()}
    ids = known.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(5)).alias("_o"))
    while True:
        cuts = [(name, (1 << 63) - 1 if s >= 1 else int(s * 2**64) - (1 << 63)) for name, s in share.items()]
        bound = F.broadcast(spark.createDataFrame(cuts, "lang string, _cut bigint"))
        near = stored(ids.join(bound, "lang").filter("_o <= _cut").drop("_cut"), "near")
        got = {r["lang"]: r["n"] for r in near.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        short = [name for name, n in sizes.items() if share[name] < 1 and got.get(name, 0) < min(n, rows)]
        if not short:
            break
        share |= {name: share[name] * 4 for name in short}
    order = Window.partitionBy("lang").orderBy("_o", "doc_id")
    return near.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= rows).select("doc_id", "lang").distinct()


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """N-gram likelihoods per value of ``lang`` from a bounded sample of labelled documents of each.

    Only the sampled ids meet the texts; a null or empty value is no label. Every language is learned;
    the driver holds the whole counts of one at a time, and of the others the cells they have seen.
    """
    known = docs.filter("lang IS NOT NULL AND lang <> '' AND doc_id IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    place = {n: i for i, n in enumerate(names)}
    base, seen, more = np.zeros(len(names)), [np.zeros(0, np.int64)] * len(names), [np.zeros(0, np.float32)] * len(names)
    if names:
        picked = stored(_sample(known, sizes, sample_rows), "sample")
        rows = known.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"]).select("lang", "text")
        for lang, texts in groupby(rows.orderBy("lang").toLocalIterator(), lambda r: r["lang"]):
            weight = np.zeros(CELLS)
            for r in texts:
                cells, n = counted(r["text"])
                weight[cells] += n / n.sum() * 1000
            i, total = place[lang], weight.sum() + CELLS * SMOOTH
            base[i], seen[i] = SMOOTH / total, np.flatnonzero(weight)
            more[i] = (weight[seen[i]] / total).astype(np.float32)
    cells = np.concatenate(seen) if names else np.zeros(0, np.int64)
    order = np.argsort(cells, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(cells, minlength=CELLS))])
    langs = np.repeat(np.arange(len(names), dtype=np.int32), [len(x) for x in seen])[order]
    return Model(names, base, starts, langs, np.concatenate(more)[order] if names else np.zeros(0, np.float32))


def mixture(p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Shares of the columns of ``p`` that make the counts ``n`` likeliest, and the log-likelihood."""
    share = np.full(p.shape[1], 1.0 / p.shape[1])
    total = n.sum()
    for _ in range(rounds):
        mixed = p @ share
        share = share * (p.T @ (n / mixed)) / total
    return share, float(n @ np.log(p @ share))


def infer(model: Model, text: str | None) -> tuple[str, float, list[tuple[str, float]]]:
    """Main language, its share and all selected languages with their shares.

    Languages are added to the best single one while the log-likelihood of the mixture gains more than the
    penalty, half the logarithm of the number of n-grams for each share (and at least ``n / 200``: n-grams
    of one text overlap and repeat). The likelihood is concave in the shares, so its slope towards a
    language bounds what adding it can gain; a language under the penalty is not tried.
    """
    if not text or not model.names or not _LETTER.search(text):
        return "und", 0.0, []
    cells, n = counted(text)
    total, many = n.sum(), len(model.names)
    size = model.starts[cells + 1] - model.starts[cells]
    row = np.repeat(np.arange(len(cells)), size)
    entry = np.arange(len(row)) + np.repeat(model.starts[cells] - (np.cumsum(size) - size), size)
    lang, more = model.langs[entry], model.more[entry].astype(float)

    def column(i: int) -> np.ndarray:
        p, mine = np.full(len(cells), model.base[i]), lang == i
        p[row[mine]] += more[mine]
        return p

    single = total * np.log(model.base) + np.bincount(lang, n[row] * np.log1p(more / model.base[lang]), many)
    chosen = [int(single.argmax())]
    p = column(chosen[0])[:, None]
    share, best = np.ones(1), float(single[chosen[0]])
    penalty = max(0.5 * np.log(total), total / 200)
    while len(chosen) < len(model.names):
        w = n / (p @ share)
        slope = model.base * w.sum() + np.bincount(lang, w[row] * more, many) - total
        slope[chosen] = -np.inf
        other = int(slope.argmax())
        if slope[other] <= penalty:
            break
        wider = np.column_stack([p, column(other)])
        new, gain = mixture(wider, n)
        if gain - best <= penalty:
            break
        chosen, p, share, best = [*chosen, other], wider, new, gain
    order = np.argsort(-share, kind="stable")
    mix = [(model.names[chosen[i]], float(share[i])) for i in order]
    return mix[0][0], min(mix[0][1], 1.0), mix


def _predict(model):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
        ("mixture", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [infer(model.value, t.as_py()) for t in batch.column(1)]
            mixes = [[{"lang": name, "share": s} for name, s in g[2]] for g in got]
            columns = [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array(mixes, schema.field(3).type)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def languages(docs: DataFrame, known: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, lang_pred, score, mixture`` per row of ``docs``, learned from ``known``.

    ``mixture`` lists the selected languages with their shares, largest first; ``lang_pred`` and ``score``
    are the first of them. A null text, a text without a letter, or a model without languages gives
    ``und``, 0 and no mixture. Rows are independent: repeats and null ids pass through, extra columns are
    ignored; no shuffle. An empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(known, sample_rows))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_predict(model), "doc_id bigint, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")


def identified(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``docs`` with the first language of the inferred mixture as ``lang``, without the documents whose
    language is undetermined; all other columns and repeats stay.

    Rows are judged by their text alone, in the pass that predicts them. Without a labelled document
    (``lang`` null or empty everywhere) the model has no languages; then only texts that are null or have
    no letter are rejected and ``lang`` stays as it is.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs if known is None else known))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lang = batch.schema.get_field_index("text"), batch.schema.get_field_index("lang")
            texts = (t.as_py() for t in batch.column(at))
            if not model.value.names:
                yield batch.filter(pa.array([bool(t and _LETTER.search(t)) for t in texts], pa.bool_()))
                continue
            found = pa.array([infer(model.value, t)[0] for t in texts], pa.string())
            named = batch.set_column(lang, batch.schema.field(lang), found.cast(batch.schema.field(lang).type))
            yield named.filter(pc.not_equal(found, "und"))

    return docs.mapInArrow(keep, docs.schema)
