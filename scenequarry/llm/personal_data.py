"""Personal data by bootstrapped contextual extraction.

Fixed patterns find e-mail addresses, IP numbers, payment cards and phone numbers: the seeds. The words around a seed are lexical patterns;
so are those around any other string that looks like an identifier. Both sides form a graph, patterns on one side and instances on the other,
which Spark scores in rounds: a pattern is as good as the share of its instances that are seeds or believed already, an instance as
good as the patterns it appears in. Instances of high-confidence patterns are personal data that no fixed pattern describes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenequarry.llm.shared import store

KINDS = ("email", "ip", "card", "phone")
#: Name of the spans that contexts add.
LEARNED = "context"
#: Rounds of scoring; seeds that a pattern must have; instances from which on a pattern counts as evidence; confidence of patterns and instances.
ROUNDS, LEAST_SEEDS, LEAST_INSTANCES, CONFIDENT = 3, 3, 3, 0.5
#: Characters of a token that can be an identifier, and of context that is read each way.
LONGEST, REACH = 64, 80
#: Rows up to which a table of scores is broadcast (strings of up to about 200 bytes); copies of it where it isn't.
BROADCAST_ROWS, COPIES = 100_000, 16

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HINT, _BREAK, _DIGIT = re.compile("[0-9@]"), re.compile(r"\s"), re.compile("[0-9]")
_SPACES = " \n\t\r\x0b\x0c"
_PLAIN_NUMBER = re.compile(r"[0-9()+./-]+")


def _luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four fixed kinds, leftmost and without overlaps in each, kinds in order; time is linear in the text."""
    found: list[tuple[str, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        tail = _DOMAIN.match(text, at)
        # The local part reaches back as far as its characters go, but not into an earlier match.
        if tail:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                done = tail.end()
                found.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return found
    for chain in _DOTTED.finditer(text):
        parts = chain.group().split(".")
        at = chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                found.append(("ip", at, at + size))
            at += size + 1
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append(("phone", *m.span()))
    return found


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Runs without white space that hold a digit or an at sign, without the punctuation at their ends; each character is read a bounded number of times."""
    at = 0
    while hint := _HINT.search(text, at):
        start = max(at, *(text.rfind(c, at, hint.start()) + 1 for c in _SPACES))
        stop = _BREAK.search(text, hint.start())
        end = at = stop.start() if stop else len(text)
        while start < end and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        while end > start and not (text[end - 1].isalnum() or text[end - 1] == ")"):
            end -= 1
        if start < end:
            yield start, end


def identifier_slots(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, class) of strings that may identify somebody: ``number`` of seven digits or more, ``address`` around an at sign, ``code`` of letters and digits.

    Parts of a number of up to eight digits, one space apart, are one, up to 19 digits.
    """
    held: tuple[int, int, int] | None = None
    for start, end in _tokens(text):
        if end - start > LONGEST:
            continue
        token = text[start:end]
        digits = sum(c in "0123456789" for c in token)
        number = bool(_PLAIN_NUMBER.fullmatch(token))
        if held is not None:
            if number and digits <= 8 and start == held[1] + 1 and text[held[1]] == " " and held[2] + digits <= 19:
                held = (held[0], end, held[2] + digits)
                continue
            if held[2] >= 7:
                yield held[0], held[1], "number"
            held = None
        if number:
            if digits <= 8:
                held = (start, end, digits)
            else:
                yield start, end, "number"
        elif 0 < token.find("@") < len(token) - 1:
            yield start, end, "address"
        elif digits >= 4 and len(token) >= 6:
            yield start, end, "code"
    if held is not None and held[2] >= 7:
        yield held[0], held[1], "number"


def _word(raw: str) -> str:
    """A context word: lower case, digits as 0, without punctuation at its ends (punctuation alone stays)."""
    inner = raw.strip("\"'`.,;:!?()[]{}<>*#$%&|_~=-")
    return _DIGIT.sub("0", (inner or raw[:4]).lower())[:32]


def context_patterns(text: str, start: int, end: int, kind: str) -> list[str]:
    """Lexical patterns of a place: the word before, the two before, the word after, and one each side; ``^`` and ``$`` are the text's ends."""
    before = text[max(0, start - REACH) : start].split()[-2:]
    after = text[end : end + REACH].split(None, 1)[:1]
    # Punctuation that touches the identifier belongs to no word.
    if before and not text[start - 1].isspace() and not any(c.isalnum() for c in before[-1]):
        before = before[:-1] or before
    if after and not text[end].isspace():
        rest = text[end : end + REACH].split(None, 2)
        after = rest[1:2] if not any(c.isalnum() for c in rest[0]) else rest[:1]
    left = [_word(w) for w in before]
    one, two = (left[-1] if left else "^"), (left[-2] if len(left) > 1 else "^")
    right = _word(after[0]) if after else "$"
    return [f"{kind}: {one} _", f"{kind}: {two} {one} _", f"{kind}: _ {right}", f"{kind}: {one} _ {right}"]


def _read(text: str | None) -> tuple[list[int], str, list[dict]]:
    """Counts by kind, the base spans as text, and the places of seeds and other identifiers with their patterns."""
    if not text or not _HINT.search(text):
        return [0] * len(KINDS), "", []
    base = base_spans(text)
    by_kind = sorted(base, key=lambda s: (KINDS.index(s[0]), s[1]))
    places = [(s, e, "address" if k == "email" else "number", True) for k, s, e in by_kind]
    taken = sorted((s, e) for _, s, e in base)
    i, reach = 0, 0
    for s, e, kind in identifier_slots(text):
        # Base spans that begin before this place ends, and how far they reach.
        while i < len(taken) and taken[i][0] < e:
            reach, i = max(reach, taken[i][1]), i + 1
        if reach <= s:
            places.append((s, e, kind, False))
    made = [{"start": s, "end": e, "seed": seed, "instance": f"{kind}: {text[s:e].lower()[:200]}", "patterns": context_patterns(text, s, e, kind)} for s, e, kind, seed in places]
    return [sum(k == kind for k, _, _ in base) for kind in KINDS], ",".join(f"{k}:{s}:{e}" for k, s, e in by_kind), made


_PLACES = "array<struct<start: int, end: int, seed: boolean, instance: string, patterns: array<string>>>"
_ARROW_PLACES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))


def read_places(documents: DataFrame) -> DataFrame:
    """``row, doc_id``, counts by kind, ``base`` and ``places`` of each row of ``documents(doc_id, text)``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A text at a time: a batch's places are small, its texts need not be.
            rows = [_read(batch.column(2)[i].as_py()) for i in range(batch.num_rows)]
            counts = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *counts, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], _ARROW_PLACES)], ["row", "doc_id", *[f"n_{k}" for k in KINDS], "base", "places"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    numbered = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    return numbered.mapInArrow(work, f"row long, doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base string, places {_PLACES}")


def _look_up(left: DataFrame, scores: DataFrame, key: str, other: str, how: str = "left") -> DataFrame:
    """Join stored ``scores`` (a row a key) to rows that may share a key in any number: broadcast if few, else each score to every salt."""
    if scores.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(scores), key, how)
    salted = scores.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(other), F.lit(COPIES)).cast("int")).join(salted, [key, "__salt"], how).drop("__salt")


def score_graph(edges: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, least_instances: int = LEAST_INSTANCES, confident: float = CONFIDENT) -> tuple[DataFrame, DataFrame]:
    """Scored patterns and believed instances of ``edges(pattern, instance, seed)``, distinct pairs.

    A round scores each pattern with ``believed / (instances + 1)``, where seeds count as 1 and other instances by their confidence if
    believed, then each other instance with the mean score of its patterns that have ``least_instances`` or more. It is believed if that
    mean and its best pattern reach ``confident``; patterns with fewer than ``least_seeds`` seeds score 0.
    """
    believed = patterns = None
    unseen = edges.where("NOT seed")
    for _ in range(rounds):
        weighed = edges.withColumn("c", F.lit(0.0)) if believed is None else _look_up(edges, believed.select("instance", F.col("confidence").alias("c")), "instance", "pattern")
        weight = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("c", F.lit(0.0)))
        counted = weighed.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"), F.count_if("seed").alias("seeds"), F.sum(weight).alias("believed"))
        score = F.when(F.col("seeds") >= least_seeds, F.col("believed") / (F.col("instances") + 1)).otherwise(F.lit(0.0))
        patterns = store(counted.where(F.col("instances") >= least_instances).withColumn("score", score), "personal-patterns")
        judged = _look_up(unseen, patterns.select("pattern", "score"), "pattern", "instance", "inner").groupBy("instance").agg(F.avg("score").alias("confidence"), F.max("score").alias("best"))
        believed = store(judged.where((F.col("confidence") >= confident) & (F.col("best") >= confident)).select("instance", "confidence"), "personal-instances")
    return patterns, believed


def find_personal_data(documents: DataFrame, **options) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, n_context: a row for each row of ``documents(doc_id, text)``.

    ``spans`` holds the base spans by kind, then those learned from contexts by start (kind ``context``), which never overlap a base span; an instance
    that is believed is one wherever it stands. Null and empty texts have no spans; texts of any length are read whole; offsets count code points. Rows that
    repeat an id, or have none, are rows of their own; equal rows get equal results. An empty table gives no rows; extra columns are ignored. All thresholds look at all rows.
    ``options`` are those of ``score_graph``.
    """
    read = store(read_places(documents), "personal-places")
    places = read.where(F.exists("places", lambda p: ~p["seed"])).select("row", F.inline("places"))
    pairs = read.select(F.inline("places")).select(F.explode("patterns").alias("pattern"), "instance", "seed")
    edges = store(pairs.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "personal-edges")
    _, believed = score_graph(edges, **options)
    hits = _look_up(places.where("NOT seed").select("row", "start", "end", "instance"), believed.select("instance"), "instance", "row", "inner")
    found = hits.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("found"))
    learned = F.coalesce(F.transform("found", lambda s: F.concat_ws(":", F.lit(LEARNED), s["start"], s["end"])), F.array().cast("array<string>"))
    base = F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.array("base"))
    joined = read.drop("places").join(found, "row", "left")
    return joined.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), F.array_join(F.concat(base, learned), ",").alias("spans"), F.size(learned).cast("long").alias("n_context"))
