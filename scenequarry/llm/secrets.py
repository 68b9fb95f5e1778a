"""Secret scans with built-in functions only.

Fixed patterns give the base spans. Beyond them, long tokens are compared under character Markov models of random strings and of
ordinary tokens: one whose log-likelihood ratio is clearly on the side of random strings is one more span.

Random strings are modelled for each ``FAMILIES`` alphabet; a token is held against the narrowest that spells it. They learn
from the values of all base spans and from digests, which are made up and random by construction, written in the alphabet. Ordinary tokens have a model for each
of ``ORDINARY``, and a token is held against the one that explains it best: ``prose`` are the words of all texts, three at a time, spelled as
programs and paths spell them; ``names`` have the shapes of paths, constants, part numbers, dates and counters with any letters; ``typography`` are
rule lines, runs, alphabets and strings over a few letters; ``uuid`` groups of lower-case hexadecimal digits, ``camel`` words told apart by capitals. Half of these, by a hash of the token, train the models; the ratio that
all but ``FALSE_RATE`` of the other half stay below, an exact quantile, is the cutoff. A model is a small array (``SIDE`` squared numbers), so that a token is scored in one pass
over its characters. Tokens have at least 20 characters and no dots: shorter secrets, or parts of fewer between dots, are for the fixed patterns alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenequarry.llm.shared import store
from scenequarry.operators.order import group_quantiles

#: Digests that are made up for each alphabet, which give each transition of the widest one dozens of times; a few more for small alphabets.
DIGESTS, SEEDS = 5_000, 12
#: Part of ordinary identifiers that may lie above the cutoff. A span's ratio, in nats, is at least the cutoff for each character on average, and this in sum.
FALSE_RATE, LEAST_SUM = 0.001, 10.0
SMOOTHING = 0.5
#: Weight, in observations, of the letters' own frequencies in the frequencies after a letter.
BACKOFF = 8.0
#: Alphabets of random strings, narrow ones first: the pattern of tokens, and the characters that digests are written in.
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FAMILIES = (
    ("upper_hex", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+=*$", _UPPER + "234567"),
    ("lower", "^[a-z0-9]+$", _DIGITS + _LOWER),
    ("upper", "^[A-Z0-9]+$", _DIGITS + _UPPER),
    ("base62", "^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    ("base64", "", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64_url", "^[A-Za-z0-9_=-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
)
BASE64 = _UPPER + _LOWER + _DIGITS + "+/"
#: Kinds of ordinary tokens, each with a model of its own; samples of shapes and of groups that are generated.
ORDINARY = ("prose", "names", "typography", "uuid", "camel")
SHAPES = 3_000
SEPARATORS = "+/_=-"
#: Characters of tokens lie from "+" to "z": places 1 to SIDE - 1; place 0, of the character before "+", is the start.
FIRST, SIDE = ord("+") - 1, ord("z") - ord("+") + 2
START = chr(FIRST)
PIECE = 256

VALUE = r"[A-Za-z0-9+/_.=-]+"
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(""" + VALUE + ")"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
#: Code points of a block, in which spans are cut out.
BLOCK = 4096


def _matches(text: Column, pattern: str) -> Column:
    """The text before each match (since the last one), and the match, in order."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"))


def _spans(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, kind, begin, end (code points), value: base spans, and the tokens that the models will judge (kind ``token``).

    Positions are running sums of the lengths of gaps and matches. Rows that repeat an id and text are
    scanned once more but counted once.
    """
    text = F.col("text").cast("string")
    found = documents.where(text.isNotNull()).select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    scans = [
        ("assign", ASSIGN, (F.contains("text", F.lit("=")) | F.contains("text", F.lit(":"))) & F.col("text").rlike(ASSIGN)),
        ("access", ACCESS, F.contains("text", F.lit("AKIA"))),
        ("hex", HEX, F.col("text").rlike(HEX)),
        ("token", TOKEN, F.col("text").rlike(TOKEN)),
    ]
    none = F.array().cast("array<struct<gap:string,found:string>>")
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.when(c, _matches(F.col("text"), p)).otherwise(none).alias("m")) for k, p, c in scans])
    rows = found.select("doc_id", "text_hash", F.explode(each).alias("k")).where(F.size("k.m") > 0).select("doc_id", "text_hash", "k.kind", F.posexplode("k.m").alias("pos", "m"))
    rows = rows.select("doc_id", "text_hash", "kind", "pos", F.length("m.gap").alias("gap"), F.length("m.found").alias("width"), F.col("m.found").alias("found"))
    rows = rows.where(F.col("found").isNotNull()).dropDuplicates(["doc_id", "text_hash", "kind", "pos"])
    end = F.sum(F.col("gap") + F.col("width")).over(Window.partitionBy("doc_id", "text_hash", "kind").orderBy("pos"))
    placed = rows.withColumn("end", end).withColumn("value", F.when(F.col("kind") == "assign", F.regexp_extract("found", ASSIGN, 1)).otherwise(F.col("found")))
    return placed.where((F.col("kind") != "assign") | (F.length("value") >= 12)).select("doc_id", "text_hash", "kind", (F.col("end") - F.col("width")).alias("begin"), "end", "value")


def family(token: Column) -> Column:
    """Place in ``FAMILIES`` of the narrowest alphabet that spells the token, base64 (of either kind) otherwise."""
    last = [n for n, _, _ in FAMILIES].index("base64")
    choice = None
    for i, (_, pattern, _) in enumerate(FAMILIES):
        if pattern:
            choice = F.when(token.rlike(pattern), i) if choice is None else choice.when(token.rlike(pattern), i)
    return choice.otherwise(last)


def _steps(values: DataFrame, *keys: str) -> DataFrame:
    """``keys``, pair: a row for each character of ``value``, after the one before it (``START`` at the start)."""
    pieces = _pieces(values, *keys).where(F.length("__x") > 1)
    return pieces.select(*keys, "__x", F.explode_outer(F.sequence(F.lit(1), F.length("__x") - 1)).alias("__i")).select(*keys, F.substring("__x", F.col("__i"), F.lit(2)).alias("pair"))


def _pieces(values: DataFrame, *keys: str) -> DataFrame:
    """``keys``, __x: the value after ``START``. Long values go in pieces, each with the next one's first character, so that a place is found in few steps."""
    text = F.concat(F.lit(START), F.col("value"))
    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), 0)
    lapped = F.zip_with(cut, F.slice(cut, 2, F.greatest(F.size(cut), F.lit(1))), lambda x, y: F.concat(x, F.coalesce(F.substring(y, 1, 1), F.lit(""))))
    return values.select(*keys, F.explode_outer(F.when(F.length("value") < PIECE, F.array(text)).otherwise(lapped)).alias("__x"))


def identifiers(documents: DataFrame) -> DataFrame:
    """``(value, held)``: ordinary identifiers from the words of all texts, each once; ``held`` ones, half of them by a hash, are kept from training."""
    words = documents.select(F.filter(F.split(F.col("text").cast("string"), "[^A-Za-z]+"), lambda w: F.length(w).between(1, 40)).alias("w"))

    def spelled(w: Column, i: Column) -> Column:
        joined = lambda glue: F.array_join(w, glue)
        title = F.replace(F.initcap(joined(" ")), F.lit(" "), F.lit(""))
        camel = F.concat(F.lower(F.substring(title, 1, 1)), F.substring(title, 2, 200))
        number = F.pmod(i * 37, F.lit(1000)).cast("string")
        ways = [F.lower(joined("_")), F.upper(joined("_")), F.lower(joined("-")), F.concat(F.lit("/"), joined("/")), camel, title, F.lower(joined("")), F.upper(joined("")), F.concat(F.lower(joined("_")), F.lit("_"), number), F.concat(camel, number), F.concat(joined("/"), F.lit("/"), number), joined("")]
        way = F.pmod(i, F.lit(len(ways)))
        found = F.when(way == 0, ways[0])
        for k, spelling in enumerate(ways[1:], 1):
            found = found.when(way == k, spelling)
        return found

    # Three words at a time; the n-th three of a text are spelled in the n-th way. Spelled before the rows are dealt out, so that no filter spells them again.
    threes = F.transform(F.sequence(F.lit(0), (F.size("w") / 3).cast("int")), lambda i: F.slice("w", i * 3 + 1, 3))
    values = words.select(F.explode_outer(F.transform(threes, lambda w, i: F.when(F.size(w) == 3, spelled(w, i)))).alias("value")).where("value IS NOT NULL")
    return values.distinct().withColumn("held", F.pmod(F.xxhash64("value", F.lit("held")), F.lit(2)) == 1)


def _letters(seed: Column, alphabet: str) -> Column:
    """86 letters of an alphabet that follow from a seed."""
    text = lambda part: F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit(part), seed.cast("string")).cast("binary"), 256))), "=", "")
    return F.translate(F.concat(text("one "), text("two ")), BASE64, "".join(alphabet[k % len(alphabet)] for k in range(64)))


def shaped_tokens(spark: SparkSession, count: int = SHAPES) -> DataFrame:
    """``(component, value, held)``: generated samples of all kinds but ``prose``, the same on every run."""
    low, up, digit = (_letters(F.col("id"), a) for a in (_LOWER, _UPPER, _DIGITS))
    size = lambda j, least, most: (F.pmod(F.xxhash64("id", F.lit(j)), F.lit(most - least + 1)) + least).cast("int")
    pieces = lambda pool, least, most, n=7: [F.substring(pool, F.lit(1 + 9 * j), size(j, least, most)) for j in range(n)]
    words, capitals, numbers, tags = pieces(low, 2, 8), pieces(up, 2, 8), pieces(digit, 1, 6), pieces(up, 1, 5)
    title = [F.initcap(w) for w in pieces(low, 3, 9)]
    dated = [F.substring(digit, 1 + 9 * j, n) for j, n in enumerate((4, 2, 2, 2, 2, 2, 6))]
    mixed = [F.concat(F.substring(up, 1 + 9 * j, 1), F.substring(digit, 1 + 9 * j, 1 + j % 2), F.substring(up, 5 + 9 * j, j % 3)) for j in range(3)]
    alternate = [x for pair in zip(tags, numbers, strict=True) for x in pair]
    ways = [
        F.concat_ws("/", *words), F.concat_ws("_", *words), F.concat_ws("-", *words), F.concat_ws("_", *capitals), F.concat_ws("-", *alternate),
        F.concat(F.concat_ws("-", *dated[:3]), F.lit("_"), F.concat_ws("-", *dated[3:])), F.concat_ws("-", *numbers), low, up, digit, F.concat_ws("-", *mixed, *tags[3:5], *numbers[5:]), F.concat_ws("/", *words, title[0]),
        F.concat_ws("_", *[x for pair in zip(words, numbers, strict=True) for x in pair][:8]), F.concat(F.concat_ws("/", *[F.concat_ws("-", a, b) for a, b in zip(words, numbers, strict=True)])),
    ]
    names = spark.range(count).select(F.lit(1).alias("component"), F.element_at(F.array(*ways), (F.pmod("id", F.lit(len(ways))) + 1).cast("int")).alias("value"))
    humps = [F.concat(*title), F.concat(words[0], *title[1:]), F.concat(*title[:4], numbers[0])]
    camel = spark.range(count // 2).select(F.lit(4).alias("component"), F.element_at(F.array(*humps), (F.pmod("id", F.lit(len(humps))) + 1).cast("int")).alias("value"))
    same = [c * 40 for c in SEPARATORS + _DIGITS + _UPPER + _LOWER] + [(a + b) * 20 for a in SEPARATORS for b in SEPARATORS] + [a * 3 for a in (_LOWER, _UPPER, _DIGITS, _LOWER[::-1], _UPPER[::-1], _DIGITS[::-1], "1234567890")]
    lines = spark.range(1).select(F.lit(2).alias("component"), F.explode(F.array(*[F.lit(x) for x in same])).alias("value"))
    few = spark.range(60).select(F.lit(2).alias("component"), F.element_at(F.array(_letters(F.col("id"), "ACGT"), _letters(F.col("id"), "01"), _letters(F.col("id"), "ACGU")), (F.pmod("id", F.lit(3)) + 1).cast("int")).alias("value"))
    grouped = lambda x: F.concat_ws("-", *[F.substring(x, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    uuids = spark.range(count // 4).select(F.lit(3).alias("component"), grouped(_letters(F.col("id"), _DIGITS + "abcdef")).alias("value"))
    return names.union(lines).union(few).union(uuids).union(camel).withColumn("held", (F.col("component") != 2) & (F.pmod(F.xxhash64("value"), F.lit(2)) == 1))


def digest_seeds(ordinary: DataFrame) -> DataFrame:
    """What digests are made of, ``DIGESTS`` numbers, whatever the tokens: they are random strings on any input, and ``ordinary`` only lends its session."""
    return ordinary.sparkSession.range(DIGESTS).select(F.concat(F.lit("seed "), F.col("id").cast("string")).alias("value"))


def digests(seeds: DataFrame) -> DataFrame:
    """``(family, value)``: digests of ``seeds(value)``, written in each alphabet."""
    text = F.translate(F.base64(F.unhex(F.sha2(F.col("value").cast("binary"), 256))), "=", "")
    each = F.array(*[F.struct(F.lit(i).alias("family"), F.translate(text, BASE64, "".join(letters[k % len(letters)] for k in range(64))).alias("value")) for i, (_, _, letters) in enumerate(FAMILIES)])
    return seeds.select(F.inline(each))


def markov_models(random: DataFrame, ordinary: DataFrame) -> DataFrame:
    """``(pair, p)``: log frequencies of the transition from a character to the next, by model: in random strings of each family, ``random(family, value)``, then in ordinary tokens of each kind, ``ordinary(component, value)``.

    Frequencies after a letter lean on the letters' own (``BACKOFF``), and these on equal ones over the alphabet (``SMOOTHING``); every
    transition has a row, at most ``SIDE`` squared, whatever the input.
    """
    spark = random.sparkSession
    first, models = len(FAMILIES), len(FAMILIES) + len(ORDINARY)
    samples = random.select(F.col("family").alias("model"), "value").union(ordinary.select((F.col("component") + first).alias("model"), "value"))
    counted = _steps(samples, "model").groupBy("model", "pair").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(models * SIDE * SIDE).select((F.col("id") / (SIDE * SIDE)).cast("int").alias("model"), F.pmod((F.col("id") / SIDE).cast("int"), F.lit(SIDE)).alias("a"), F.pmod("id", F.lit(SIDE)).cast("int").alias("b"))
    grid = grid.where("b > 0").withColumn("pair", F.concat(F.char(F.col("a") + FIRST), F.char(F.col("b") + FIRST)))
    full = grid.join(counted, ["model", "pair"], "left").na.fill(0, ["n"])
    of_a, of_b, whole = Window.partitionBy("model", "a"), Window.partitionBy("model", "b"), Window.partitionBy("model")
    own = (F.sum("n").over(of_b) + SMOOTHING) / (F.sum("n").over(whole) + SMOOTHING * (SIDE - 1))
    logs = full.select("model", "pair", F.log((F.col("n") + BACKOFF * own) / (F.sum("n").over(of_a) + BACKOFF)).alias("p"))
    return logs.groupBy("pair").agg(F.transform(F.sort_array(F.collect_list(F.struct("model", "p"))), lambda x: x["p"]).alias("p"))


def ratio(models: DataFrame, tokens: DataFrame, keys: list[str], kinds: tuple[str, ...] = ORDINARY) -> DataFrame:
    """``keys``, llr: log-likelihood of each of ``tokens(keys…, value)`` as a random string, less that as the ordinary token (of ``kinds``) it is likeliest to be.

    A token's transitions meet those of ``models``, a table of bounded size that is broadcast. Long tokens go in pieces keyed by ``keys``, never by their
    text: linear in the token, with short arrays.
    """
    steps = _steps(tokens.select(*keys, family(F.col("value")).alias("__f"), "value"), *keys, "__f").join(F.broadcast(models), ["pair"])
    ordinary = [F.sum(F.get("p", F.lit(len(FAMILIES) + ORDINARY.index(k)))) for k in kinds]
    return steps.groupBy(*keys).agg((F.sum(F.get("p", F.col("__f"))) - (F.greatest(*ordinary) if len(ordinary) > 1 else ordinary[0])).alias("llr"))


def ordinary_samples(documents: DataFrame) -> DataFrame:
    """``(component, value, held)`` of all ordinary tokens, from all texts and made up, that the models learn from or are held against."""
    prose = identifiers(documents).select(F.lit(0).alias("component"), "value", "held")
    # Stored, so that no filter makes them up again.
    return prose.union(store(shaped_tokens(documents.sparkSession), "secret-shapes"))


def fit(base: DataFrame, documents: DataFrame) -> tuple[DataFrame, float]:
    """The models, a stored table of ``SIDE`` squared rows, and the cutoff by character, both from all texts.

    Identifiers are not stored: the training half and the long ones of the other half are each made where they are needed.
    """
    ordinary = ordinary_samples(documents)
    values = base.select(family(F.col("value")).alias("family"), "value").where(F.length("value") >= 12)
    fixed = documents.sparkSession.range(SEEDS).select(F.concat(F.lit("digest "), F.col("id").cast("string")).alias("value"))
    random = digests(digest_seeds(ordinary)).union(digests(fixed)).union(values)
    models = store(markov_models(random, ordinary.where("NOT held")), "secret-models")
    return models, cutoff(models, ordinary)


def cutoff(models: DataFrame, ordinary: DataFrame) -> float:
    """The ratio by character that all but ``FALSE_RATE`` of the held tokens of ``ordinary(component, value, held)`` with 20 characters or more stay below; 0 at least."""
    held = ordinary.where(F.col("held") & (F.length("value") >= 20)).select("component", F.col("value").alias("token"), "value")
    means = store(ratio(models, held, ["component", "token"]).select(F.lit(0).alias("all"), (F.col("llr") / F.length("token")).alias("mean")), "secret-held")
    found = group_quantiles(means, ["all"], {"mean": [1 - FALSE_RATE]}).first()
    return max(0.0, found["mean_q0"]) if found else 0.0


def scan_spans(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, kind, begin, end, value, llr: all spans, base kinds (llr null) and ``markov``."""
    return _scan(documents)[0]


def _scan(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All spans, and the models that judged them."""
    spans = store(_spans(documents), "secret-spans")
    base = spans.where("kind != 'token'")
    models, least = fit(base, documents)
    # A token is free if no base span that begins before its end reaches beyond its begin.
    order = Window.partitionBy("doc_id", "text_hash").orderBy("begin")
    reach = F.max(F.when(F.col("kind") != "token", F.col("end"))).over(order.rangeBetween(Window.unboundedPreceding, 0))
    later = F.min(F.when(F.col("kind") != "token", F.col("begin"))).over(order.rangeBetween(0, Window.unboundedFollowing))
    free = spans.withColumns({"__reach": reach, "__later": later}).where("kind = 'token' AND coalesce(__reach <= begin, true) AND coalesce(__later >= end, true)").drop("__reach", "__later")
    keys = ["doc_id", "text_hash", "begin", "end"]
    scores = ratio(models, free, keys).where((F.col("llr") >= LEAST_SUM) & (F.col("llr") >= F.lit(least) * (F.col("end") - F.col("begin"))))
    columns = [*keys[:2], "kind", *keys[2:], "value", "llr"]
    scored = scores.select(*[F.col(k).alias(f"__{k}") for k in keys], "llr")
    scored = free.join(scored, [free[k].eqNullSafe(F.col(f"__{k}")) for k in keys])
    return base.withColumn("llr", F.lit(None).cast("double")).select(columns).union(scored.withColumn("kind", F.lit("markov")).select(columns)), models


def _without_runs(spans: DataFrame, models: DataFrame) -> DataFrame:
    """Spans without those of kind ``hex`` that are typography, likelier a run, a count or the like than random digits."""
    keys = ["doc_id", "text_hash", "begin", "end"]
    runs = ratio(models, spans.where("kind = 'hex'").select(*keys, F.upper("value").alias("value")), keys, ("typography",)).where("llr < 0").select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = F.col("kind") == "hex"
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return spans.join(runs, same, "left_anti")


def _listed(spans: DataFrame) -> DataFrame:
    """Spans of each text in order: by begin, then kind as listed."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    return spans.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("begin", rank.alias("rank"), "end", "kind"))).alias("spans"))


def find_secrets(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov for every row of ``documents``.

    Spans read ``kind:start:end`` in code points, end exclusive, by start, then kind as listed, joined by
    commas. Null or empty texts have none; repeated rows are each reported; a null doc_id is an id of its
    own; other columns are ignored; an empty table gives no rows.
    """
    listed = _listed(scan_spans(documents)).select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), "spans")
    rows = documents.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    joined = rows.join(listed, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__h")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<begin:bigint,rank:int,end:bigint,kind:string>>"))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    written = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter(spans, lambda s: s["kind"] != "markov")
    return joined.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(spans).alias("spans"), count("markov")
    )


def redact_secrets(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with every span (overlapping or touching ones together) replaced by ``mark``; other columns as they are.

    Null texts stay null; repeated rows are each redacted; an empty table gives no rows. Texts with spans are cut into blocks of ``BLOCK`` code points, so that a span
    costs its block and not its text; all others are handed on. Runs of one digit, counts and the like stay, though they are base spans of kind ``hex``.
    """
    spans = _without_runs(*_scan(documents))
    keys = ["__d", "__h"]
    marks = spans.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), "begin", "end")
    # Spans that overlap are one: a span begins a new one if none before it reaches its begin.
    by_begin = Window.partitionBy(*keys).orderBy("begin", "end")
    reach = F.max("end").over(by_begin.rowsBetween(Window.unboundedPreceding, -1))
    marks = marks.withColumn("__new", F.coalesce(reach < F.col("begin"), F.lit(True)).cast("int")).withColumn("__n", F.sum("__new").over(by_begin))
    marks = store(marks.groupBy(*keys, "__n").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("__n"), "secret-marks")
    touched = marks.withColumn("__block", F.explode(F.sequence(F.floor(F.col("begin") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))))
    start = F.col("__block") * BLOCK
    cut = F.struct(F.greatest(F.col("begin") - start, F.lit(0)).cast("int").alias("lo"), F.least(F.col("end") - start, F.lit(BLOCK)).cast("int").alias("hi"), (F.col("begin") >= start).alias("first"))
    touched = touched.groupBy(*keys, F.col("__block").cast("int").alias("__block")).agg(F.sort_array(F.collect_list(cut)).alias("__cuts"))
    keyed = documents.withColumn("__key", F.xxhash64(F.col("text").cast("string")))
    having = marks.select(*keys).distinct()
    texts = keyed.select(F.col("doc_id").alias("__td"), F.col("__key").alias("__th"), F.col("text").cast("string").alias("text")).join(having, F.col("__td").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__h")))
    texts = texts.groupBy(*keys).agg(F.min("text").alias("text"))
    blocks = texts.select(*keys, F.posexplode(F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{BLOCK}}}"), 0)).alias("__i", "part"))
    named = touched.select(*[F.col(k).alias(f"{k}2") for k in keys], "__block", "__cuts")
    joined = blocks.join(named, F.col("__d").eqNullSafe(F.col("__d2")) & (F.col("__h") == F.col("__h2")) & (F.col("__i") == F.col("__block")), "left")
    part = F.col("part")

    def step(acc: Column, c: Column) -> Column:
        gap = F.substring(part, acc["at"] + 1, c["lo"] - acc["at"])
        return F.struct(F.concat(acc["out"], gap, F.when(c["first"], F.lit(mark)).otherwise(F.lit(""))).alias("out"), c["hi"].alias("at"))

    clean = F.aggregate("__cuts", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(part, acc["at"] + 1, F.lit(BLOCK))))
    joined = joined.select(*keys, "__i", F.when(F.col("__cuts").isNull(), part).otherwise(clean).alias("part"))
    whole = joined.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__i", "part"))), lambda x: x["part"]), "").alias("__clean"))
    found = keyed.join(whole, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__h")), "left")
    return found.select(*[F.coalesce("__clean", keyed["text"]).alias(c) if c == "text" else keyed[c] for c in documents.columns])
