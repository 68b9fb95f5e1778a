"""What the text operators share: stored intermediates, label splits and a vectorised tokeniser.

The tokeniser works on the UTF-8 bytes of an Arrow column, a slice of about ``SLICE_BYTES`` at a
time, so that memory follows the slice (or one long text), never the partition.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenequarry.operators.stored import remove_stored, stored

SLICE_BYTES = 1 << 20
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Intermediates are written to the shared folder and read back: lineage ends there and survives a lost executor.
store = functools.partial(stored, tidy=False)


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learnt from: crc32 of the id as text, modulo 4, is not 2."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) != 2


TEXT_HASH = ["__text_a", "__text_b"]


def with_text_hash(df: DataFrame) -> DataFrame:
    """``df`` with 128 bits that, beside its id, tell a row's text from others."""
    return df.withColumns({TEXT_HASH[0]: F.xxhash64("text"), TEXT_HASH[1]: F.xxhash64(F.lit(771), F.col("text"))})


def native_word_count(text: Column) -> Column:
    """Words of a text, on the JVM; null counts as none."""
    # One split: edges of white space leave empty strings, which are no words.
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.array_remove(F.split(text, SPACES + "+"), ""))).cast("long")


# ---------------------------------------------------------------- tokeniser
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MULT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Breaks of plain word tokens: whatever is ASCII but not a letter or digit.
PLAIN_BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash base, kept between calls."""
    global _POWERS
    if len(_POWERS) < n:
        base = np.full(max(n, 2 * len(_POWERS), 4096), _STEP, np.uint64)
        base[0] = 1
        _POWERS = np.multiply.accumulate(base)
    return _POWERS[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public SplitMix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Slice:
    """Some whole texts: their bytes, and where texts and words begin."""

    data: np.ndarray  # bytes, A-Z lower-cased if asked for
    raw: np.ndarray  # bytes as they are
    bounds: np.ndarray  # text i is data[bounds[i]:bounds[i + 1]]
    space: np.ndarray
    starts: np.ndarray  # byte where each word begins
    ends: np.ndarray
    doc: np.ndarray  # text of each word

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    def per_doc(self, of_word: np.ndarray | None = None) -> np.ndarray:
        """Words, or the sum of a number of each word, by text."""
        return np.bincount(self.doc, of_word, self.n).astype(np.int64)

    def word_hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.empty(0, np.uint64)
        at = np.flatnonzero(~self.space)
        first = np.searchsorted(at, self.starts)
        length = self.ends - self.starts
        pos = at - np.repeat(self.starts, length)
        return mix(np.add.reduceat(_BYTE[self.data[at]] * powers(int(length.max()))[pos], first) + length.astype(np.uint64))

    def shingles(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all k-word windows, the text and the first word of each; a text of fewer words, but not none, is one."""
        n = len(words)
        full = np.flatnonzero(self.doc[k - 1 :] == self.doc[: n - k + 1]) if n >= k else np.empty(0, np.int64)
        h = np.zeros(len(full), np.uint64)
        for j in range(k):
            h += words[full + j] * _MULT[j]
        counts = self.per_doc()
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            begin = np.searchsorted(self.doc, short)
            extra = np.zeros(len(short), np.uint64)
            for j in range(k - 1):
                there = counts[short] > j
                extra[there] += words[begin[there] + j] * _MULT[j]
            full, h = np.concatenate([full, begin]), np.concatenate([h, extra + counts[short].astype(np.uint64) * _MULT[63]])
            order = np.argsort(full, kind="stable")
            full, h = full[order], h[order]
        return mix(h), self.doc[full], full

    def within(self, flags: np.ndarray) -> np.ndarray:
        """Bytes of each text for which the flag holds."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def slices(texts: pa.Array, lower: bool, breaks: np.ndarray = _IS_SPACE) -> Iterator[tuple[int, int, Slice]]:
    """Cut a string column into slices of whole texts: (first row, end row, slice). A null is an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and off[-1] else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, "right")) - 1)
        part = raw[off[i] : off[j]]
        bounds = off[i : j + 1] - off[i]
        space = breaks[part]
        begins = ~space
        begins[1:] &= space[:-1]
        cuts = bounds[:-1][(bounds[:-1] < bounds[1:])]
        begins[cuts] |= ~space[cuts]
        stops = ~space
        stops[:-1] &= space[1:] | begins[1:]
        starts = np.flatnonzero(begins)
        ends = np.flatnonzero(stops) + 1
        doc = np.searchsorted(bounds, starts, "right") - 1
        yield i, j, Slice(_LOWER[part] if lower else part, part, bounds, space, starts, ends, doc)
        i = j


def map_slices(df: DataFrame, columns: list[str], text: str, work: Callable[[pa.RecordBatch, Slice], dict], schema: str, lower: bool = False, breaks: np.ndarray = _IS_SPACE) -> DataFrame:
    """Run ``work`` over slices of the texts; ``columns`` are handed on, followed by what ``work`` returns by text."""
    source = df.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, s in slices(batch.column(len(columns)), lower, breaks):
                keep = batch.slice(i, j - i)
                made = work(keep, s)
                yield pa.RecordBatch.from_arrays([*keep.columns[: len(columns)], *[v if isinstance(v, pa.Array) else pa.array(v) for v in made.values()]], [*columns, *made])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{head}, {schema}")
