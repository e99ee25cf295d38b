"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found in a block-max inverted index.

The index holds a bounded sample of labelled documents as vectors over the terms that go with a label: (1 + ln tf) * idf,
scaled to length 1, with document frequencies counted over all documents. Examples are numbered by their heaviest terms,
so that neighbours in number are alike, and cut into blocks of BLOCK. A term's postings lie block by block with the largest
weight of each. The sum of those bounds says how similar a block's best example can be; blocks are scored in the order of
their bounds until no bound reaches the k-th best, so the neighbours are those that a full scan gives, ties included.

Neighbours vote with 1 / (distance + NEAR), weighted back to the labels' frequency before sampling. The vote is calibrated
by leaving each example out in turn: examples are binned by their vote, and the share of label 1 in the bins, made
monotone, is the score. A document with none of the terms has no neighbours and gets the share among such examples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from navloom.llm.textwords import LOWER, byte_column, row_pieces, word_bounds, word_hashes
from navloom.session import settle

PER_LABEL = 10_000  # labelled documents of each label that the index holds, at most
MAX_TERMS = 1 << 16  # terms of the index, at most: those that go with a label most surely
FALSE_TERMS = 0.05  # expected share of terms that are taken by accident
LEAST_ODDS = 4.0  # a term changes the odds of a label by this factor at least
LEAST_TEXTS = 3  # and is in so many texts of different content
NEIGHBOURS = 25
NEAR = 0.1  # added to a distance, which bounds a vote
BLOCK = 64  # examples
BINS = 20  # of votes, for calibration
EVIDENCE = 3  # neighbours that are named
PIECE = 1 << 21  # bytes of texts worked on at once
_STEP, _STEPS = 0.25, 400  # in which the likelihood ratios are counted
MEMO = 100_000  # vectors whose answer a task remembers

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True
_IS_WORD[0x80:] = True


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, A-Z in lower case, and the rows they are in. Words are runs of ASCII letters and
    digits and of other characters but Latin-1, general and CJK punctuation."""
    data, bounds = byte_column(column)
    data = LOWER[data]
    after = np.append(data[1:], np.uint8(0))
    two = (data == 0xC2) & (after >= 0xA0) & (after <= 0xBF)
    three = ((data == 0xE2) & ((after == 0x80) | (after == 0x81))) | ((data == 0xE3) & (after == 0x80))
    word = _IS_WORD[data]
    for mark, size in ((two, 2), (three, 3)):
        for i in range(size):
            word[i:][mark[:len(mark) - i]] = False
    data = np.where(word, data, np.uint8(0x20))
    starts, ends, sizes = word_bounds(data, bounds)
    return word_hashes(data, starts, ends), np.repeat(np.arange(len(sizes)), sizes)


def _counted(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, count), by row, then key."""
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1]))[:len(keys)]
    first = np.flatnonzero(new)
    return rows[first], keys[first], np.diff(np.append(first, len(keys)))


def _lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.array(values))


@dataclass(frozen=True)
class Index:
    """Postings sorted by term, then example; each (term, block) that has any is an entry with its bound."""
    ids: np.ndarray  # per example
    toxic: np.ndarray
    vote: np.ndarray  # how many documents an example stands for
    entry_of: np.ndarray  # per term, its first entry; one more at the end
    block: np.ndarray  # per entry
    bound: np.ndarray
    first: np.ndarray  # per entry, its first posting; one more at the end
    example: np.ndarray  # per posting
    weight: np.ndarray

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples that share a term with the query and are at least as similar as the k-th most similar, and their
        cosines; the example `but` aside."""
        none = np.empty(0, np.int64), np.empty(0)
        entries = [np.arange(self.entry_of[t], self.entry_of[t + 1]) for t in terms]
        if not entries or not sum(map(len, entries)):
            return none
        of = np.concatenate(entries)
        by = np.repeat(weights, [len(e) for e in entries])
        blocks, place = np.unique(self.block[of], return_inverse=True)
        bounds = np.bincount(place, self.bound[of] * by)
        found, sims, least = [none[0]], [none[1]], 0.0
        order = np.argsort(-bounds, kind="stable")
        at, step = 0, 4
        while at < len(order):
            taken = order[at:at + step]
            taken = taken[bounds[taken] >= least - 1e-12]
            if not len(taken):
                break
            mine = np.isin(place, taken)
            sizes = self.first[of[mine] + 1] - self.first[of[mine]]
            inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            post = np.repeat(self.first[of[mine]], sizes) + inner
            examples, slot = np.unique(self.example[post], return_inverse=True)
            score = np.bincount(slot, self.weight[post] * np.repeat(by[mine], sizes))
            keep = examples != but
            found.append(examples[keep])
            sims.append(score[keep])
            held = np.concatenate(sims)
            if len(held) >= k:
                least = np.partition(held, len(held) - k)[len(held) - k]
            at += step
            step *= 2
        found, sims = np.concatenate(found), np.concatenate(sims)
        near = sims >= least - 1e-12
        return found[near], np.minimum(sims[near], 1.0)


@dataclass(frozen=True)
class Model:
    vocabulary: np.ndarray  # term hashes, ascending
    idf: np.ndarray
    index: Index
    prior: float  # share of label 1
    alone: float  # the same among documents without any of the terms
    votes: np.ndarray  # calibration: votes and their scores
    scores: np.ndarray

    def restricted(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count) of the model's terms."""
        keys, rows = terms_of(column)
        if not len(self.vocabulary):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        term = np.minimum(np.searchsorted(self.vocabulary, keys), len(self.vocabulary) - 1)
        known = self.vocabulary[term] == keys
        return _counted(term[known], rows[known])

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        weights = (1 + np.log(counts)) * self.idf[terms]
        return weights / np.sqrt((weights**2).sum())

    def vote(self, near: np.ndarray, sims: np.ndarray) -> float:
        weights = self.index.vote[near] / (1 - sims + NEAR)
        shrink = 1 / (1 + NEAR)  # as of one neighbour with nothing in common
        return float((weights @ self.index.toxic[near] + self.prior * shrink) / (weights.sum() + shrink))

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[tuple[int, float, int]]]:
        near, sims = self.index.nearest(terms, self.vector(terms, counts), NEIGHBOURS) if len(terms) else (np.empty(0, np.int64), np.empty(0))
        if not len(near):
            return self.alone, []
        best = near[np.lexsort((self.index.ids[near], -sims.round(9)))[:EVIDENCE]]
        cosine = dict(zip(near.tolist(), sims.tolist()))
        named = [(int(self.index.ids[e]), cosine[e], int(self.index.toxic[e])) for e in best.tolist()]
        return float(np.interp(self.vote(near, sims), self.votes, self.scores)), named


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int) -> tuple[DataFrame, dict[int, float]]:
    """(id, text, label) of at most about `per_label` documents of each label, and how many documents each stands for."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = {label: min(1.0, per_label / n) for label, n in sizes.items()}
    draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30))
    chosen = marks.where(draw < F.when(F.col("label") == 1, F.lit(share.get(1, 0.0))).otherwise(F.lit(share.get(0, 0.0))) * (1 << 30))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), "id").select("text", "id", "label"), {label: 1 / s for label, s in share.items()}


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in row_pieces(batch, PIECE):
            rows, keys, counts = _counted(*terms_of(piece.column(0)))
            least = np.full(piece.num_rows, np.iinfo(np.int64).max, np.int64)
            np.minimum.at(least, rows, keys.view(np.int64))
            n = piece.num_rows
            yield pa.RecordBatch.from_arrays([piece.column(1), piece.column(2), pa.array(least), _lists(keys.view(np.int64), rows, n), _lists(counts, rows, n)],
                                             names=["id", "label", "content", "terms", "counts"])


def _log_term(seen: Column, expected: Column) -> Column:
    return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(F.lit(0.0))


def _chosen_terms(examples: DataFrame) -> np.ndarray:
    """Terms that go with a label: by a likelihood-ratio test over contents, at an expected share of accidents among all
    terms tested, and by the odds. Texts that share their least term hash are copies more often than not and count as one content, so a passage that
    was copied a hundred times is no hundred observations."""
    contents = {r["label"]: r["n"] for r in examples.select("label", "content").distinct().groupBy("label").agg(F.count("*").alias("n")).collect()}
    t, f = float(contents.get(1, 0)), float(contents.get(0, 0))
    if not t or not f:
        return np.empty(0, np.uint64)
    seen = examples.select("label", "content", F.explode("terms").alias("term")).distinct()
    seen = seen.groupBy("term").agg(F.count(F.when(F.col("label") == 1, 1)).alias("a"), F.count(F.when(F.col("label") == 0, 1)).alias("b")).where(F.col("a") + F.col("b") >= LEAST_TEXTS)
    seen = settle(seen, "toxic-terms")
    tested = seen.count()
    if not tested:
        return np.empty(0, np.uint64)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    share = (a + b) / (t + f)
    ratio = _log_term(a, share * t) + _log_term(b, share * f) + _log_term(t - a, (1 - share) * t) + _log_term(f - b, (1 - share) * f)
    odds = ((a + 0.5) * (f - b + 0.5)) / ((b + 0.5) * (t - a + 0.5))
    far = (odds >= LEAST_ODDS) | (odds <= 1 / LEAST_ODDS)
    best = seen.where(far).select("term", ratio.alias("ratio"))
    step = F.least(F.floor(F.col("ratio") / _STEP), F.lit(_STEPS)).cast("int").alias("step")
    steps = best.groupBy(step).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    least, held = None, 0
    for r in steps:  # the lowest step at which the terms from there on hold no more accidents than that
        held += r["n"]
        if erfc(sqrt(r["step"] * _STEP / 2)) <= FALSE_TERMS * held / tested:
            least = r["step"] * _STEP
    if least is None:
        return np.empty(0, np.uint64)
    kept = best.where(F.col("ratio") >= least).orderBy(F.desc("ratio"), "term").limit(MAX_TERMS).select("term").toPandas()["term"].to_numpy(np.int64)
    return np.sort(kept.view(np.uint64))


def _with_frequencies(model: Model, docs: DataFrame, text_col: str) -> Model:
    """Inverse document frequencies over all documents: each task adds its own up."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = 0, np.zeros(len(shared.value.vocabulary) + 1, np.int64)
        for batch in batches:
            for piece in row_pieces(batch, PIECE):
                found += np.bincount(shared.value.restricted(piece.column(0))[1], minlength=len(found))
                total += piece.num_rows
        found[-1] = total
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], names=["term", "n"])

    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "term BIGINT, n BIGINT").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    found = np.zeros(len(model.vocabulary) + 1)
    found[counts["term"].to_numpy(np.int64)] = counts["n"].to_numpy(np.float64)
    return replace(model, idf=np.log((1 + found[-1]) / (1 + found[:-1])) + 1)


def _restricted_examples(model: Model, examples: DataFrame):
    """(id, label, terms, counts) of the examples over the model's terms, in no order."""
    shared = examples.sparkSession.sparkContext.broadcast(model.vocabulary)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            lists = batch.column(2)
            keys = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            term = np.minimum(np.searchsorted(vocabulary, keys), max(0, len(vocabulary) - 1))
            known = vocabulary[term] == keys if len(vocabulary) else np.zeros(len(keys), bool)
            counts = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(term[known], rows[known], batch.num_rows), _lists(counts[known], rows[known], batch.num_rows)],
                                             names=["id", "label", "terms", "counts"])

    return examples.select("id", "label", "terms", "counts").mapInArrow(keep, "id BIGINT, label INT, terms ARRAY<BIGINT>, counts ARRAY<BIGINT>").toPandas()


def build_index(ids: np.ndarray, toxic: np.ndarray, vote: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> Index:
    """Examples are numbered by their terms from the heaviest down, then by weights and id."""
    def place(i: int) -> tuple:
        terms, weights = vectors[i]
        down = np.lexsort((terms, -weights.round(9)))
        return tuple(terms[down].tolist()), tuple((-weights[down]).round(9).tolist()), int(ids[i])

    order = sorted(range(len(vectors)), key=place)
    example = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
    term = np.concatenate([np.empty(0, np.int64), *(vectors[i][0] for i in order)])
    weight = np.concatenate([np.empty(0), *(vectors[i][1] for i in order)])
    by = np.lexsort((example, term))
    example, term, weight = example[by], term[by], weight[by]
    block = example // BLOCK
    new = np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))[:len(term)]
    first = np.flatnonzero(new)
    bound = np.maximum.reduceat(weight, first) if len(first) else np.empty(0)
    order = np.array(order, np.int64)
    return Index(ids[order], toxic[order], vote[order], np.searchsorted(term[first], np.arange(n_terms + 1)), block[first], bound,
                 np.append(first, len(term)), example, weight)


def _calibrated(model: Model, spark) -> Model:
    """Votes of the examples with each left out, as the share of label 1 by bin, made monotone."""
    index, n = model.index, len(model.index.ids)
    by = np.argsort(index.example, kind="stable")  # postings example by example
    terms = np.repeat(np.arange(len(index.entry_of) - 1), index.first[index.entry_of[1:]] - index.first[index.entry_of[:-1]])[by]
    shared = spark.sparkContext.broadcast((model, terms, index.weight[by], np.searchsorted(index.example[by], np.arange(n + 1))))

    def leave_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, terms, weights, edges = shared.value
        for batch in batches:
            rows = batch.column(0).to_pylist()
            votes = []
            for i in rows:
                own = slice(edges[i], edges[i + 1])
                near, sims = model.index.nearest(terms[own], weights[own], NEIGHBOURS, but=i)
                votes.append(model.vote(near, sims) if len(near) else model.prior)
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), pa.array(model.index.toxic[rows].astype(np.float64)), pa.array(model.index.vote[rows])],
                                             names=["vote", "toxic", "size"])

    votes = spark.range(n).repartition(max(1, n // 500)).mapInArrow(leave_out, "vote DOUBLE, toxic DOUBLE, size DOUBLE")
    size, vote = F.col("size"), F.col("vote")
    bins = votes.groupBy(F.least(F.floor(vote * BINS), F.lit(BINS - 1)).alias("bin")).agg(
        F.sum(size).alias("n"), (F.sum(vote * size) / F.sum(size)).alias("vote"), F.sum(F.col("toxic") * size).alias("toxic")).orderBy("bin").collect()
    pools: list[list[float]] = []  # adjacent bins that fall are pooled
    for r in bins:
        pools.append([r["n"] + 1, r["toxic"] + model.prior, [r["vote"]]])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] > pools[-1][1] / pools[-1][0]:
            size_, toxic_, at_ = pools.pop()
            pools[-1] = [pools[-1][0] + size_, pools[-1][1] + toxic_, pools[-1][2] + at_]
    votes_ = np.array([v for _, _, at in pools for v in at])
    return replace(model, votes=votes_, scores=np.repeat([t / n for n, t, _ in pools], [len(at) for _, _, at in pools]))


def fit(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        per_label: int = PER_LABEL) -> Model:
    """Learns from the labels 0 and 1 of `labels`, by id, for the texts in `docs`; document frequencies are counted over
    `corpus` (all of `docs` by default). An id with both labels has label 1; null ids, other labels and ids without a text
    teach nothing. At most about `per_label` documents of each label are taken, by a hash of their id, so the index that the
    driver builds and tasks receive is bounded. Without labels the score is 0 everywhere."""
    spark = docs.sparkSession
    sample, stands_for = _sampled(docs, labels, id_col, text_col, label_col, per_label)
    examples = settle(sample.mapInArrow(_terms, "id BIGINT, label INT, content BIGINT, terms ARRAY<BIGINT>, counts ARRAY<BIGINT>"), "toxic-examples")
    vocabulary = _chosen_terms(examples)
    none = np.empty(0)
    model = Model(vocabulary, np.ones(len(vocabulary)), build_index(np.empty(0, np.int64), none, none, [], len(vocabulary)), 0.0, 0.0, np.zeros(1), np.zeros(1))
    found = _restricted_examples(model, examples)
    if not len(found):
        return model
    model = _with_frequencies(model, corpus if corpus is not None else docs, text_col)
    toxic = found["label"].to_numpy(np.float64)
    vote = np.array([stands_for[label] for label in found["label"]])
    prior = float(toxic @ vote / vote.sum())
    some = np.array([len(t) > 0 for t in found["terms"]])
    # two documents' worth of the overall share, so that few examples give no certainty
    alone = float((toxic[~some] @ vote[~some] + 2 * prior) / (vote[~some].sum() + 2))
    vectors = [(np.asarray(t, np.int64), model.vector(np.asarray(t, np.int64), np.asarray(c, np.int64))) for t, c in zip(found["terms"], found["counts"]) if len(t)]
    index = build_index(found["id"].to_numpy(np.int64)[some], toxic[some], vote[some], vectors, len(vocabulary))
    model = replace(model, index=index, prior=prior, alone=alone, scores=np.full(1, prior))
    if not vectors:
        return model
    return _calibrated(model, spark)


def _slices(rows: np.ndarray, n: int) -> list[slice]:
    edges = np.searchsorted(rows, np.arange(n + 1)).tolist()
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), score_col: str = "score", evidence_col: str = "evidence") -> DataFrame:
    """The `keep` columns of every row with `score_col`, the chance of label 1 from 0 to 1, and `evidence_col`, the nearest
    examples as (id, similarity, toxic), most similar first, then by id. Equal texts get equal answers. Null and empty texts
    and those without any of the model's terms get the share of label 1 among such examples, and no evidence. Other columns are
    left out; a kept column that has one of the new names is an error."""
    if {score_col, evidence_col} & set(keep):
        raise ValueError(f"{score_col} or {evidence_col} is among the kept columns")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)))
    neighbour = StructType([StructField("id", LongType()), StructField("similarity", DoubleType()), StructField("toxic", LongType())])
    schema = StructType([*rows.schema.fields[1:], StructField(score_col, DoubleType()), StructField(evidence_col, ArrayType(neighbour))])
    arrow = pa.list_(pa.struct([("id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = shared.value, {}
        for batch in batches:
            for piece in row_pieces(batch, PIECE):
                rows, terms, counts = model.restricted(piece.column(0))
                found = []
                for s in _slices(rows, piece.num_rows):
                    key = terms[s].tobytes() + counts[s].tobytes()
                    if key not in memo:
                        if len(memo) >= MEMO:
                            memo.clear()
                        value, near = model.score(terms[s], counts[s])
                        memo[key] = value, [dict(zip(("id", "similarity", "toxic"), e)) for e in near]
                    found.append(memo[key])
                yield pa.RecordBatch.from_arrays([*piece.columns[1:], pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], arrow)], names=schema.names)

    return rows.mapInArrow(run, schema).withColumnsRenamed({f"_{i}": c for i, c in enumerate(keep)})
