"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton. A text is parsed against it from left to
right: each phrase is the longest match with the language's text. Few phrases mean a close language: the
phrases, normalised by the logarithm of the language's text length and the text's own, estimate a cross entropy, and
the least one wins.

Texts are read as UTF-8 bytes, lower-cased, with whatever isn't a letter or a mark as one blank: a few dozen symbols for any script. The
automata are one table of transitions, so that all texts of a slice walk all languages at once, a byte a step;
the few longest are walked to their ends one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenequarry.llm.shared import learnable, store

#: Bounds of the fit: bytes of a language, of all languages together, rows looked at per language, and the longest text that is learnt
#: from where a language has shorter ones. Every language with a labelled text is learnt, from whole texts; one that has longer texts only, from
#: the first bytes of its shortest.
TRAIN_BYTES, ALL_BYTES, MAX_ROWS, MAX_TEXT = 40_000, 200_000, 400, 10_000
#: Bytes of texts that are walked at once, and texts below which they are walked one by one.
SLICE, FEW = 8 << 20, 48
#: Languages that may be broadcast with their counts.
FEW_LANGUAGES = 100_000
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def sample_texts(documents: DataFrame) -> dict[str, list[str]]:
    """Texts by language, in order of a hash of the id, up to the bounds. A threshold on the hash keeps most rows from the ranking."""
    text = F.col("text").cast("string")
    rows = documents.select("doc_id", F.col("lang").cast("string").alias("lang"), text.alias("text"), F.octet_length(text).alias("n"))
    rows = rows.where(F.col("lang").isNotNull() & (F.col("n") > 0) & learnable(F.col("doc_id")))
    per = store(rows.groupBy("lang").agg(F.count_if(F.col("n") <= MAX_TEXT).alias("usable"), F.min("n").alias("least")), "language-counts")
    languages = per.count()
    share = max(1, min(TRAIN_BYTES, ALL_BYTES // max(1, languages)))
    hashed = F.xxhash64("doc_id", F.lit(6))
    near = (F.col("n") <= MAX_TEXT) & (F.shiftrightunsigned(hashed, 33) * F.col("usable") < F.lit(4 * MAX_ROWS * 2**31))
    picked = rows.join(F.broadcast(per) if languages <= FEW_LANGUAGES else per, "lang").where(F.when(F.col("usable") > 0, near).otherwise(F.col("n") == F.col("least")))
    order = Window.partitionBy("lang").orderBy(hashed, "doc_id", F.xxhash64("text"))
    first = picked.withColumn("i", F.row_number().over(order)).where(F.col("i") <= MAX_ROWS)
    taken = first.withColumn("sum", F.sum("n").over(Window.partitionBy("lang").orderBy("i"))).where((F.col("sum") <= share) | (F.col("i") == 1))
    out: dict[str, list[str]] = {}
    for r in sorted(taken.select("lang", "i", F.substring("text", 1, share).alias("text")).collect(), key=lambda r: (r["lang"], r["i"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return out


@dataclass(frozen=True)
class Parser:
    """Transitions of all automata: ``table[state + class]`` is (next state << 2 | phrases that end before or with this symbol)."""

    languages: list[str]
    roots: np.ndarray
    log_length: np.ndarray
    table: np.ndarray
    classes: bytes  # of each byte: 0 for one that no language has, 1 for the blank

    @staticmethod
    def symbols(text: str) -> bytes:
        """Letters and marks, lower-cased, as UTF-8; all between them as one blank."""
        return _OTHER.sub(" ", text.lower()).encode("utf-8", "surrogatepass")

    def codes(self, text: str) -> np.ndarray:
        """Classes of a text's symbols."""
        return np.frombuffer(self.symbols(text).translate(self.classes), np.uint8)

    def parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by text and language, and the texts' lengths in symbols."""
        codes = [self.codes(t) for t in texts]
        lengths = np.array([len(c) for c in codes], np.int64)
        order = np.argsort(-lengths, kind="stable")
        size, offset = lengths[order], (np.cumsum(lengths) - lengths)[order]
        joined = np.concatenate(codes) if codes else np.empty(0, np.uint8)
        state = np.repeat(self.roots[:, None], len(texts), axis=1)
        count = np.ones(state.shape, np.int64)
        step, live = 0, int((size > 0).sum())
        while live >= FEW:
            got = self.table[state[:, :live] + joined[offset[:live] + step]]
            state[:, :live] = got >> 2
            count[:, :live] += got & 3
            step += 1
            live = int(np.searchsorted(-size, -step, "left"))
        table = memoryview(self.table)
        for i in range(live):
            rest = joined[offset[i] + step : offset[i] + size[i]].tobytes()
            for k in range(len(self.languages)):
                at, n = int(state[k, i]), int(count[k, i])
                for c in rest:
                    got = table[at + c]
                    at = got >> 2
                    n += got & 3
                state[k, i], count[k, i] = at, n
        # At a root the last phrase is empty: the symbol before it was a phrase of its own.
        count -= state == self.roots[:, None]
        phrases = np.zeros((len(texts), len(self.languages)))
        phrases[order] = count.T
        return phrases, lengths


def _automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton, by state."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nxt


def fit(samples: dict[str, list[str]]) -> Parser | None:
    """Automata of bounded samples; None without any."""
    if not samples:
        return None
    texts = {lang: b"".join(Parser.symbols(t) + b" " for t in samples[lang]).replace(b"  ", b" ") for lang in sorted(samples)}
    known = sorted(set(b"".join(texts.values())) - {0x20})
    classes = bytearray(256)
    classes[0x20] = 1
    for i, byte in enumerate(known):
        classes[byte] = 2 + i
    n_classes = 2 + len(known)
    tables, roots, logs, base = [], [], [], 0
    for text in texts.values():
        codes = np.frombuffer(text.translate(bytes(classes)), np.uint8)
        nxt = _automaton(codes)
        root = np.full(n_classes, base, np.int64)
        for c, to in nxt[0].items():
            root[c] = base + to * n_classes
        # A symbol without a transition ends the phrase and begins the next; one that the language hasn't is a phrase of its own.
        table = np.tile(root << 2 | np.where(root == base, 2, 1), (len(nxt), 1))
        table[0] = np.where(root == base, base << 2 | 1, root << 2)
        for state, edges in enumerate(nxt):
            for c, to in edges.items():
                table[state, c] = (base + to * n_classes) << 2
        kind = np.int32 if (base + table.size) << 2 < 2**31 else np.int64
        tables.append(table.reshape(-1).astype(kind))
        roots.append(base)
        logs.append(np.log2(len(codes) + 2))
        base += len(nxt) * n_classes
    kind = np.int32 if base << 2 < 2**31 else np.int64
    return Parser(list(texts), np.array(roots, np.int64), np.array(logs), np.concatenate([x.astype(kind, copy=False) for x in tables]), bytes(classes))


def identify_languages(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``documents(doc_id, text, lang)``.

    Learns from text and language of rows with crc32(doc_id) mod 4 other than 2; predictions use the
    text only. ``und`` with score 0 if the text is null or has no letter, or nothing could be learnt. The score is the runner-up's
    share of the two least entropies: 0.5 for a tie (the first language by code point wins), 1 with one language.
    Repeated rows are judged each; empty tables give no rows; other columns are ignored.
    """
    parser = fit(sample_texts(documents))
    held = F.coalesce(~learnable(F.col("doc_id")), F.lit(False))
    rows = documents.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(parser)

    def judge(texts: list[str]) -> tuple[list[str], list[float]]:
        model = shared.value
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        worded = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if model is None or not worded:
            return langs, scores
        phrases, lengths = model.parse([texts[i] for i in worded])
        entropy = phrases * model.log_length / np.maximum(lengths, 1)[:, None]
        best = entropy.argmin(axis=1)
        two = np.sort(entropy, axis=1)[:, :2]
        score = two[:, 1] / two.sum(axis=1) if two.shape[1] == 2 else np.ones(len(worded))
        for i, b, s in zip(worded, best.tolist(), score.tolist(), strict=True):
            langs[i], scores[i] = model.languages[b], s
        return langs, scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(2).to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= SLICE):
                    size += len(texts[end] or "")
                    end += 1
                langs, scores = judge(texts[at:end])
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
                at = end

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
