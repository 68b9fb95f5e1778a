"""Per-document statistics that the quality operators share, one pass over whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scenequarry.llm.shared import _BYTE, Slice, map_slices, mix, powers

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True

#: Names and order of what :func:`document_statistics` adds.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_points", "n_upper", "n_digits", "n_punct", "n_stops", "n_distinct", "n_echo", "long_chars"]


def _lines(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word by text, and how many of them equal an earlier one."""
    if not len(s.raw):
        return np.zeros(s.n, np.int64), np.zeros(s.n, np.int64)
    begin = np.union1d(s.bounds[:-1][s.bounds[:-1] < s.bounds[1:]], np.flatnonzero(s.raw == 10) + 1)
    begin = begin[begin < len(s.raw)]
    length = np.diff(np.append(begin, len(s.raw)))
    value = _BYTE[s.raw]
    value[s.raw == 10] = 0
    pos = np.arange(len(s.raw)) - np.repeat(begin, length)
    hashes = mix(np.add.reduceat(value * powers(int(length.max()))[pos], begin))
    worded = np.add.reduceat((~s.space).astype(np.int64), begin) > 0
    doc = np.searchsorted(s.bounds, begin, "right") - 1
    doc, hashes = doc[worded], hashes[worded]
    keys = np.unique(mix(hashes + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)[1]
    lines = np.bincount(doc, minlength=s.n)
    return lines, lines - np.bincount(doc[keys], minlength=s.n)


def _count(batch: pa.RecordBatch, s: Slice) -> dict:
    words = s.word_hashes()
    salt = s.doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    repeated = np.zeros(len(words) + 2, bool)
    if len(words) >= 3:
        inside = np.flatnonzero(s.doc[2:] == s.doc[:-2])
        h = mix(words[inside] + (words[inside + 1] << np.uint64(1)) * np.uint64(0x9FB21C651E98DF25) + words[inside + 2] * np.uint64(0xA0761D6478BD642F) + salt[inside])
        _, back, times = np.unique(h, return_inverse=True, return_counts=True)
        found = inside[times[back] > 1]
        for j in range(3):
            repeated[found + j] = True
    point = (s.raw & 0xC0) != 0x80
    ends = np.concatenate([[0], np.cumsum(point)])
    chars = ends[s.ends] - ends[s.starts]
    first = np.unique(mix(words + salt), return_index=True)[1]
    echo = np.zeros(len(words), bool)
    if len(words) > 1:
        echo[1:] = (words[1:] == words[:-1]) & (s.doc[1:] == s.doc[:-1])
    lines, dup = _lines(s)
    return {
        "n_words": s.per_doc(), "word_chars": s.per_doc(chars), "n_symbols": s.within(_SYMBOL[s.raw]), "n_dup_lines": dup, "n_repeat_words": s.per_doc(repeated[: len(words)]),
        "n_lines": lines, "n_points": s.within(point), "n_upper": s.within(_UPPER[s.raw]), "n_digits": s.within(_DIGIT[s.raw]), "n_punct": s.within(_PUNCT[s.raw]), "n_stops": s.within(_STOP[s.raw]),
        "n_distinct": np.bincount(s.doc[first], minlength=s.n), "n_echo": s.per_doc(echo), "long_chars": s.per_doc(np.where(chars > 12, chars, 0)),
    }


def document_statistics(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Counts of whole texts: one output row for each input row, in any order.

    Words are maximal runs of characters other than ASCII white space. A null or empty text counts 0
    everywhere; repeated rows are counted each; other columns are ignored unless named in ``keep``.
    """
    return map_slices(documents, [id_column, *(keep or [])], text_column, _count, ", ".join(f"{c} long" for c in COUNTS))
