"""Label, JSON and span-attribute functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Words that don't tell objects apart.
STOPWORDS = ("a", "an", "the", "and", "or", "with", "of", "on", "in", "to", "for", "is", "at", "by", "from", "this", "that")
#: Fixed value: an alternative that begins so names the cluster that this one repeats.
DUPLICATE = "duplicate_of:"
SCENE_ID = r"^[A-Za-z0-9_-]{1,64}$"
#: Attribute names in order of precedence.
COST_KEYS = ("gen_ai.usage.cost", "cost_usd", "usage.cost", "est_cost_usd")
IN_KEYS = ("gen_ai.usage.input_tokens", "tokens_in", "input_tokens")
OUT_KEYS = ("gen_ai.usage.output_tokens", "tokens_out", "output_tokens")
LABELS_TYPE = "map<string,struct<label:string,confidence:double,alternatives:array<string>>>"
PROPOSALS_TYPE = "array<struct<phrase:string,bbox:array<double>,confidence:double>>"


def label_tokens(label: Column) -> Column:
    """Distinct lower-cased words of three letters or more without stopwords."""
    words = F.regexp_extract_all(F.lower(label), F.lit(r"(?U)(\w+)"), 1)
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3)), F.array(*[F.lit(w) for w in STOPWORDS]))


def label_similar(a: Column, b: Column, least: float) -> Column:
    """Equal, one inside the other (lower-cased, trimmed), or token Jaccard of ``least`` or more; false if either is empty."""
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    ta, tb = label_tokens(a), label_tokens(b)
    both = F.size(F.array_intersect(ta, tb))
    tokens = (F.size(ta) > 0) & (F.size(tb) > 0) & (both >= F.size(F.array_union(ta, tb)) * F.lit(least))
    given = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return F.coalesce(given & (F.contains(x, y) | F.contains(y, x) | tokens), F.lit(False))


def match_tier(needle: Column, ident: Column, label: Column) -> Column:
    """1 id, 2 label, 3 either inside the other; null for no match or a blank needle. Case doesn't count."""
    n, i, t = F.lower(F.trim(needle)), F.lower(ident), F.lower(label)
    return F.when(n == "", F.lit(None).cast("int")).when(n == i, 1).when(n == t, 2).when(F.contains(t, n) | F.contains(n, t), 3)


def strip_fence(text: Column) -> Column:
    """Model output without a Markdown fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def parse_labels(text: Column) -> Column:
    """Label map of a model's answer; null if it's no JSON."""
    return F.from_json(strip_fence(text), LABELS_TYPE)


def parse_proposals(text: Column) -> Column:
    """Valid proposals of a model's answer: corner in the unit square, size in (0, 1], inside up to 0.001 (then clamped), a phrase. Bad JSON gives none."""
    got = F.coalesce(F.from_json(strip_fence(text), PROPOSALS_TYPE), F.array().cast(PROPOSALS_TYPE))

    def valid(p: Column) -> Column:
        x, y, w, h = (F.get(p["bbox"], F.lit(i)) for i in range(4))
        inside = x.between(0, 1) & y.between(0, 1) & (w > 0) & (w <= 1) & (h > 0) & (h <= 1) & (x + w <= 1.001) & (y + h <= 1.001)
        return F.coalesce((F.size(p["bbox"]) == 4) & inside & (F.trim(p["phrase"]) != ""), F.lit(False))

    def clamped(p: Column) -> Column:
        x, y, w, h = (F.get(p["bbox"], F.lit(i)) for i in range(4))
        return F.struct(F.trim(p["phrase"]).alias("phrase"), F.array(x, y, F.least(w, 1 - x), F.least(h, 1 - y)).alias("bbox"), F.coalesce(p["confidence"], F.lit(0.0)).alias("confidence"))

    return F.transform(F.filter(got, valid), clamped)


def is_duplicate(alternatives: Column) -> Column:
    """Whether the first alternative marks the cluster as a repeat."""
    return F.coalesce(F.startswith(F.get(alternatives, F.lit(0)), F.lit(DUPLICATE)), F.lit(False))


def strip_duplicates(alternatives: Column) -> Column:
    return F.filter(alternatives, lambda a: ~F.startswith(a, F.lit(DUPLICATE)))


def attribute(json: Column, key: str) -> Column:
    """An attribute by its whole name, dots included."""
    return F.get_json_object(json, f"$['{key}']")


def first_number(json: Column, keys: tuple[str, ...]) -> Column:
    """The first attribute that is there, as a number; 0 if none is or it isn't a number."""
    return F.coalesce(F.coalesce(*[attribute(json, k) for k in keys]).try_cast("double"), F.lit(0.0))


def first_numbers(json: Column, keys: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """``first_number`` for several names at once: the text is parsed a single time."""
    parsed = F.from_json(json, StructType([StructField(k, StringType()) for k in dict.fromkeys(x for v in keys.values() for x in v)]))
    return {name: F.coalesce(F.coalesce(*[parsed.getField(k) for k in v]).try_cast("double"), F.lit(0.0)) for name, v in keys.items()}


def span_duration(seconds: Column, milliseconds: Column) -> Column:
    return F.coalesce(seconds, milliseconds / 1000)


def span_family(name: Column) -> Column:
    """What kind of work a span's name stands for; the name parts are fixed values, the first that fits counts."""
    has = lambda s: F.contains(name, F.lit(s))
    begins = lambda s: F.startswith(name, F.lit(s))
    return (
        F.when(has("vlm_label") | has("vlm_proposal"), "model").when(has("sam3"), "masks").when(begins("inference."), "inference").when(begins("modal."), "runtime")
        .when(begins("segmentation.lift"), "lift").when(begins("capture."), "capture").otherwise("other")
    )


def valid_scene_id(c: Column) -> Column:
    return F.coalesce(c.rlike(SCENE_ID), F.lit(False))


def cap_payload(value: Column, most: int = 16_000) -> Column:
    """JSON text cut to ``most`` characters, with its whole length and whether it was cut."""
    return F.struct(F.substring(value, 1, most).alias("payload"), F.length(value).cast("long").alias("full_length"), (F.length(value) > most).alias("truncated"))


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./]+$", "")


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def quick_fingerprint(content: Column, edge: int = 4096) -> Column:
    """Size and md5 of the first and last ``edge`` bytes."""
    data = content.cast("binary")
    size = F.octet_length(data)
    tail = F.substring(data, F.greatest(size - edge + 1, F.lit(1)), F.lit(edge))
    return F.concat_ws(":", size.cast("string"), F.md5(F.concat(F.substring(data, 1, edge), tail)))
