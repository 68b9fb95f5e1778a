"""Toxicity by the nearest labelled examples, under exact TF-IDF cosine.

A bounded sample of labelled texts is indexed with all its terms: for each term, postings in order of the example, cut into
blocks of ``BLOCK`` examples, and the largest weight of each block. Bounds on a query's blocks (query weights times
block maxima) tell which to read first, and which can't hold any of the k nearest: those are never
read, and the k nearest are exact. Queries are answered ``TOGETHER``, so that a block is read once for all that need it. The neighbours vote with their cosines as weights, the classes weighted back to their
shares among the labels; a logistic curve, fitted on the votes that each example gets from the others, turns the vote into a
probability. The neighbours are the evidence.

Terms are words and their beginnings of 4 to 7 bytes (stems under many endings), all of them. Weights are (1 + log tf) * idf * rf, with
the relevance frequency rf of supervised term weighting (Lan et al., 2009): log2(2 + toxic / clean examples that have the term).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenequarry.llm.shared import PLAIN_BREAKS, Slice, learnable, map_slices, mix, slices

#: Bounds of the fit: examples of each class, and characters of all examples of a class.
EXAMPLES, EXAMPLE_CHARS = 1_024, 8_000_000
BEGINNINGS = (4, 5, 6, 7)
NEIGHBOURS, BLOCK, DENSE = 15, 64, 24
TOGETHER = 256
#: Slack for sums in single precision; what lies within it is summed again in double.
_SLACK = 2e-5
#: Weight of the prior among the votes, as a sum of cosines.
PRIOR_WEIGHT = 0.02
THRESHOLD = 0.3
#: Bits of a term's hash; the text's place in its slice takes the others of a word.
HASH_BITS = 48
_HASH = np.uint64((1 << HASH_BITS) - 1)


def terms(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of every distinct term of each text, sorted: all words, and the beginnings of ``BEGINNINGS`` bytes of longer words."""
    hashes, docs = [s.word_hashes()], [s.doc]
    length = s.ends - s.starts
    long = np.flatnonzero(length > BEGINNINGS[0])
    head = np.zeros(len(long), np.uint64)
    for j in range(BEGINNINGS[-1]):
        there = length[long] > j
        long, head = long[there], head[there]
        head = (head << np.uint64(8)) | s.data[s.starts[long] + j].astype(np.uint64)
        if j + 1 in BEGINNINGS:
            longer = length[long] > j + 1
            hashes.append(mix(head[longer] * np.uint64(0x51ED270B4D2B3C1D) + np.uint64(j)))
            docs.append(s.doc[long[longer]])
    keys = np.sort((np.concatenate(docs).astype(np.uint64) << np.uint64(HASH_BITS)) | (np.concatenate(hashes) >> np.uint64(64 - HASH_BITS)))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return (keys[first] >> np.uint64(HASH_BITS)).astype(np.int64), keys[first] & _HASH, np.diff(np.append(first, len(keys))).astype(float)


def _term_lists(documents: DataFrame, keep: list[str]) -> DataFrame:
    """doc_id, what is kept, and distinct terms with their counts."""

    def work(batch: pa.RecordBatch, s: Slice) -> dict:
        doc, h, times = terms(s)
        cuts = np.searchsorted(doc, np.arange(s.n + 1)).astype(np.int32)
        as_lists = lambda values: pa.ListArray.from_arrays(pa.array(cuts), pa.array(values.astype(np.int64)))
        return {"terms": as_lists(h), "times": as_lists(times)}

    return map_slices(documents, ["doc_id", *keep], "text", work, "terms array<long>, times array<long>", lower=True, breaks=PLAIN_BREAKS)


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and which range each is of."""
    n = end - start
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + start[of], of


@dataclass(frozen=True)
class BlockMaxIndex:
    """Unit TF-IDF vectors of examples, inverted: term -> (block, largest weight) entries -> postings of the entry.

    A term that more than one example in ``DENSE`` has keeps its postings as a row over all examples, gaps included, which is shorter and read at once.
    """

    vocabulary: np.ndarray  # sorted term hashes
    weight: np.ndarray  # idf * rf by term
    unknown: float  # the same for a term of no example
    entries: np.ndarray  # by term, where its entries begin
    block: np.ndarray  # by entry
    most: np.ndarray  # by entry, the largest weight of its postings
    postings: np.ndarray  # by entry, where its postings begin
    example: np.ndarray  # by posting
    value: np.ndarray  # by posting
    row: np.ndarray  # by term, its row of the dense postings, or -1
    dense: np.ndarray  # weights by row and example, whole blocks
    dense_most: np.ndarray  # largest weight by row and block
    ids: np.ndarray  # by example
    toxic: np.ndarray  # by example
    vote: np.ndarray  # by example, its class's share among the labels over that among the examples
    prior: float
    curve: tuple[float, float] = (0.0, 0.0)

    @staticmethod
    def build(examples: list[tuple[int, int, np.ndarray, np.ndarray]], prior: float) -> BlockMaxIndex:
        """From ``(id, toxic, distinct term hashes, counts)`` of each example."""
        n, toxic = len(examples), np.array([e[1] for e in examples], float)
        h = np.concatenate([e[2] for e in examples]) if n else np.empty(0, np.uint64)
        times = np.concatenate([e[3] for e in examples]) if n else np.empty(0)
        of = np.repeat(np.arange(n), [len(e[2]) for e in examples]) if n else np.empty(0, np.int64)
        vocabulary, term = np.unique(h, return_inverse=True)
        of_class = [max(1.0, float((toxic == k).sum())) for k in (0, 1)]
        vote = np.where(toxic == 1, prior / of_class[1], (1 - prior) / of_class[0]) * n
        # The classes are sampled apart: a term's frequency is weighted back to their shares.
        share = np.stack([np.bincount(term, toxic[of] == k, len(vocabulary)) for k in (0, 1)])
        rate = np.maximum((1 - prior) * share[0] / of_class[0] + prior * share[1] / of_class[1], 1e-9)
        relevance = np.log2(2 + share[1] / np.maximum(1, share[0] * of_class[1] / of_class[0]))
        weight = (np.log(np.maximum(1 / rate, 1.0)) + 1) * relevance
        unknown = float(np.log(max(2, n)) + 1)
        value = (1 + np.log(times)) * weight[term]
        norm = np.sqrt(np.bincount(of, value**2, n)) if n else np.empty(0)
        value = value / norm[of] if n else value
        # Examples of one leading term stand together, so that blocks differ and their bounds are tight.
        lead = np.full(n, -1, np.int64)
        order = np.lexsort((value, of))
        lead[of[order]] = term[order]
        rank = np.lexsort(([e[0] for e in examples], lead, toxic)) if n else np.empty(0, np.int64)
        place = np.empty(n, np.int64)
        place[rank] = np.arange(n)
        example = place[of]
        blocks = max(1, -(-n // BLOCK))
        often = np.flatnonzero(share.sum(axis=0) * DENSE > n) if n else np.empty(0, np.int64)
        row = np.full(len(vocabulary), -1, np.int32)
        row[often] = np.arange(len(often))
        value = value.astype(np.float32)
        dense = np.zeros((len(often), blocks * BLOCK), np.float32)
        there = row[term] >= 0
        dense[row[term[there]], example[there]] = value[there]
        order = np.lexsort((example[~there], term[~there]))
        term, example, value = term[~there][order], example[~there][order], value[~there][order]
        fresh = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (example[1:] // BLOCK != example[:-1] // BLOCK)])) if len(term) else np.empty(0, np.int64)
        most = np.maximum.reduceat(value, fresh) if len(term) else value
        return BlockMaxIndex(
            vocabulary, weight, unknown, np.searchsorted(term[fresh], np.arange(len(vocabulary) + 1)), (example[fresh] // BLOCK).astype(np.int32), most, np.append(fresh, len(term)),
            example.astype(np.int32), value, row, dense, dense.reshape(len(often), blocks, BLOCK).max(axis=2), np.array([examples[i][0] for i in rank], np.int64), toxic[rank], vote[rank], prior if n else 0.0,
        )

    def vectors(self, doc: np.ndarray, h: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known terms (text, place in the vocabulary, weight in the text's unit vector) of ``n`` texts' distinct terms; unknown ones count in the length."""
        if not len(h) or not len(self.vocabulary):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        place = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[place] == h
        w = (1 + np.log(times)) * np.where(known, self.weight[place], self.unknown)
        length = np.sqrt(np.bincount(doc, w**2, n))
        return doc[known], place[known], w[known] / length[doc[known]]

    def nearest(self, doc: np.ndarray, t: np.ndarray, w: np.ndarray, n: int, k: int = NEIGHBOURS, but: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of ``n`` vectors the k examples of largest positive cosine, by cosine down, then id (without example ``but``); and the cosines."""
        out = []
        for first in range(0, n, TOGETHER):
            a, b = np.searchsorted(doc, [first, first + TOGETHER])
            out += self._nearest(doc[a:b] - first, t[a:b], w[a:b], min(TOGETHER, n - first), k, None if but is None else but[first : first + TOGETHER])
        return out

    def _nearest(self, doc: np.ndarray, t: np.ndarray, w: np.ndarray, n: int, k: int, but: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        blocks, width = self.dense_most.shape[1], self.dense.shape[1]
        row = self.row[t]
        often = row >= 0
        wide = np.zeros((n, len(self.dense)), np.float32)
        wide[doc[often], row[often]] = w[often]
        entry, of = _ranges(self.entries[t[~often]], self.entries[t[~often] + 1])
        weight, query = w[~often][of], doc[~often][of]
        bound = np.bincount(query * blocks + self.block[entry], weight * self.most[entry], n * blocks).reshape(n, blocks) + wide @ self.dense_most
        at, of = _ranges(self.postings[entry], self.postings[entry + 1])
        rare = np.bincount(query[of] * width + self.example[at], weight[of] * self.value[at], n * width).reshape(n, width)
        score = np.zeros((n, width), np.float32)
        # The two blocks of highest bound first; their k-th cosine tells which others to read.
        order = np.argsort(-bound, axis=1, kind="stable")
        wanted = np.zeros((n, blocks), bool)
        np.put_along_axis(wanted, order[:, :2], True, axis=1)
        self._read(score, wide, rare, wanted)
        self._leave_out(score, but)
        floor = np.partition(score, -k, axis=1)[:, -k] if width >= k else np.zeros(n, np.float32)
        self._read(score, wide, rare, ~wanted & (bound > 0) & (bound >= floor[:, None] - _SLACK))
        self._leave_out(score, but)
        floor = np.partition(score, -k, axis=1)[:, -k] if width >= k else np.zeros(n, np.float32)
        out = []
        begin = np.searchsorted(doc[often], np.arange(n + 1))
        rows, values = row[often], w[often]
        for i in range(n):
            near = np.flatnonzero((score[i] >= floor[i] - _SLACK) & (score[i] > 0))
            part = slice(begin[i], begin[i + 1])
            cos = (rare[i, near] + values[part] @ self.dense[np.ix_(rows[part], near)].astype(float)).round(9)
            best = np.lexsort((self.ids[near], -cos))[:k]
            best = best[cos[best] > 0]
            out.append((near[best], cos[best]))
        return out

    def _read(self, score: np.ndarray, wide: np.ndarray, rare: np.ndarray, wanted: np.ndarray) -> None:
        """Fill the cosines of the wanted blocks of each query."""
        size = self.dense.shape[1] // self.dense_most.shape[1]
        for b in np.flatnonzero(wanted.any(axis=0)).tolist():
            who = np.flatnonzero(wanted[:, b])
            part = slice(b * size, (b + 1) * size)
            score[who, part] = wide[who] @ self.dense[:, part] + rare[who, part]

    @staticmethod
    def _leave_out(score: np.ndarray, but: np.ndarray | None) -> None:
        if but is not None:
            score[np.arange(len(score)), but] = 0

    def votes(self, docs: np.ndarray, cos: np.ndarray) -> float:
        """Share of toxic votes, by cosine and class, with the prior's."""
        w = cos * self.vote[docs]
        return float((w @ self.toxic[docs] + PRIOR_WEIGHT * self.prior) / (w.sum() + PRIOR_WEIGHT))

    def judge(self, doc: np.ndarray, h: np.ndarray, times: np.ndarray, n: int) -> tuple[list[float], list[list[int]]]:
        """Scores and evidence (ids of neighbours) of ``n`` texts' distinct terms."""
        if not len(self.ids):
            return [0.0] * n, [[]] * n
        a, b = self.curve
        near = self.nearest(*self.vectors(doc, h, times, n), n)
        return [float(1 / (1 + np.exp(-(a * self.votes(*x) + b)))) for x in near], [self.ids[docs].tolist() for docs, _ in near]

    def calibrated(self, examples: list[tuple[int, int, np.ndarray, np.ndarray]]) -> BlockMaxIndex:
        """With the logistic curve of the toxic share over each example's vote by the others (classes weighted to their shares)."""
        at = {d: i for i, d in enumerate(self.ids.tolist())}
        n = len(examples)
        doc = np.repeat(np.arange(n), [len(e[2]) for e in examples]) if n else np.empty(0, np.int64)
        every = [np.concatenate([e[i] for e in examples]) if n else np.empty(0) for i in (2, 3)]
        near = self.nearest(*self.vectors(doc, *every, n), n, but=np.array([at[e[0]] for e in examples], np.int64)) if n else []
        x = np.array([self.votes(*v) for v in near])
        y, w = np.array([e[1] for e in examples], float), self.vote[[at[e[0]] for e in examples]] if examples else np.empty(0)
        beta = np.array([0.0, np.log((self.prior + 1e-3) / (1 - self.prior + 1e-3))])
        design = np.stack([x, np.ones_like(x)], axis=1) if len(x) else np.zeros((0, 2))
        # Newton steps of a logistic regression, held by a weak ridge on the slope.
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            slope = design.T @ (w * (y - p)) - np.array([0.01 * beta[0], 0.0])
            curvature = (design * (w * p * (1 - p))[:, None]).T @ design + np.diag([0.01, 1e-6])
            step = np.clip(np.linalg.solve(curvature, slope), -4, 4)
            beta = beta + step
            if np.abs(step).max() < 1e-9:
                break
        return BlockMaxIndex(**{**self.__dict__, "curve": (max(0.0, float(beta[0])), float(beta[1]))})


def sample_examples(documents: DataFrame, labels: DataFrame) -> tuple[list[tuple[int, int, np.ndarray, np.ndarray]], float]:
    """Terms of the sampled examples, and the toxic share among the labels.

    Of each class up to ``EXAMPLES`` learnable ids that come first by a hash, as long as their texts have ``EXAMPLE_CHARS`` characters in sum.
    A threshold on the hash keeps all but about twice as many from the ranking.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("__toxic"))
    counts = {r["__toxic"]: r["count"] for r in marked.groupBy("__toxic").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    hashed = F.xxhash64("doc_id")
    part = lambda n: F.shiftrightunsigned(hashed, 33) < int(2**31 * min(1.0, 2 * EXAMPLES / max(1, n)))
    near = marked.where(F.when(F.col("__toxic") == 1, part(counts.get(1, 0))).otherwise(part(sum(counts.values()) - counts.get(1, 0))))
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(near), "doc_id").groupBy("doc_id", "__toxic").agg(F.min("text").alias("text"))
    order = Window.partitionBy("__toxic").orderBy(hashed, "doc_id")
    ranked = texts.withColumns({"__i": F.row_number().over(order), "__chars": F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    rows = _term_lists(ranked.where((F.col("__i") <= EXAMPLES) & ((F.col("__chars") <= EXAMPLE_CHARS) | (F.col("__i") == 1))), ["__toxic"]).toArrow()
    columns = [rows.column(c).combine_chunks() if rows.num_rows else [] for c in ("terms", "times")]
    lists = [(h.values.to_numpy().view(np.uint64), t.values.to_numpy().astype(float)) for h, t in zip(*columns, strict=True)]
    made = zip(rows.column("doc_id").to_pylist(), rows.column("__toxic").to_pylist(), lists, strict=True)
    return [(d, int(x == 1), h, t) for d, x, (h, t) in sorted(made, key=lambda e: e[0]) if len(h)], prior


def fit(documents: DataFrame, labels: DataFrame) -> BlockMaxIndex:
    """The calibrated index of a bounded sample of labelled rows."""
    examples, prior = sample_examples(documents, labels)
    return BlockMaxIndex.build(examples, prior).calibrated(examples)


def score_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of the neighbours) for every row of ``documents``.

    Learns from labelled rows with crc32(doc_id) mod 4 other than 2 only; the text is the only input. An
    id labelled both ways counts as toxic; of an id's texts the least is the example. Texts without a known term (null and empty ones too)
    get the curve's value at the prior and no evidence. Ties of cosine go to the smaller example id. Repeated rows are scored each; empty tables give
    no rows; without labels all scores are 0; other columns are ignored.
    """
    index = fit(documents, labels)
    held = F.coalesce(~learnable(F.col("doc_id")), F.lit(False))
    rows = documents.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i, j, s in slices(batch.column(2), True, PLAIN_BREAKS):
                scores, evidence = model.judge(*terms(s), s.n)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))], ["doc_id", "held_out", "score", "evidence"])

    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, evidence array<long>")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
