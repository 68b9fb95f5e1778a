"""The text operators against brute force, held-out labels and edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenequarry.llm import components, decontamination, html_text, language_id, mixing, near_duplicates, quality_classifier, quality_rules, secrets, statistics, toxicity, url_filters

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_words string, kept int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None, None, None, "x", 1), (2, "", "en", "s", None, 2), (3, " \n\t ", "en", "s", None, 3), (4, "one", None, "s", None, 4), (5, "a b c\na b c\n a b c", "en", None, None, 5),
    (5, "a b c\na b c\n a b c", "en", None, None, 5), (6, "Éa ÉA éa # $ * & | < > %", "fr", "t", None, 6), (7, "word " * 70_000, "en", "s", None, 7), (8, "nul \x00 and \U0001f600 pair", "en", "t", None, 8), (None, "no id here", "en", "s", None, 9),
]


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def _statistics(text):
    words = WORD.findall(text or "")
    grams, marked = collections.Counter(zip(words, words[1:], words[2:])), set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked)


def test_statistics(spark, odd, docs):
    for df in (odd, docs):
        want = collections.Counter((r.doc_id, *_statistics(r.text)) for r in df.collect())
        got = statistics.document_statistics(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert collections.Counter(map(tuple, got.collect())) == want


def test_binomial_tail():
    assert math.isclose(quality_rules.binomial_tail(0, 100, 0.01), 0.99**100, rel_tol=1e-9)
    assert quality_rules.binomial_tail(5, 5, 0.2) == 1 and quality_rules.binomial_tail(1, 3, 0.5) == pytest.approx(0.5)


def test_quality_thresholds_are_certified(spark):
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(6000):
        good = i % 4 != 0
        words = [f"w{rng.randrange(500)}" for _ in range(60)]
        if not good:
            words = [w + "$$" for w in words]
        rows.append((i, " ".join(words), "en" if i % 3 else "de", "s", None, 0))
        marks.append((i, int(good), 0))
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    judged = {r.doc_id: r for r in quality_rules.apply_quality_rules(docs, labels).collect()}
    assert all(judged[i].kept == bool(q) for i, q, _ in marks)
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(q for _, q, _ in marks)
    # Where good documents have as many symbols as bad ones nothing may be rejected.
    same = quality_rules.apply_quality_rules(docs, labels.withColumn("quality", F.lit(1)))
    assert same.where("not kept").isEmpty()


def test_quality_steps_and_bounds():
    rules = (quality_rules.Rule("a", "x", "y", (0.5, 0.2, 0.1)), quality_rules.Rule("b", "z", "y", (0.9,)))
    # Levels by rule, good rows, bad rows: the strictest cutoff of the first rule would cost good rows.
    patterns = [((0, 0), 900, 5), ((1, 0), 90, 10), ((2, 0), 1, 30), ((3, 0), 0, 20), ((0, 1), 0, 8)]
    assert quality_rules.propose(patterns, rules, 0.02) == [(0, 2), (1, 1)]
    for n, risk, error in ((200, 0.02, 0.05), (1000, 0.01, 0.01), (148, 0.02, 0.05)):
        exact = lambda k, n=n, risk=risk: sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))
        good = [0, 0, 1, 2, 5, 9, 20, 60]
        want = next((k for k, g in enumerate(good) if exact(g) > error), len(good))
        assert quality_rules.certified_steps(good, n, risk, error) == want
    assert quality_rules.certified_steps([0], 0, 0.02, 0.05) == 0
    need = quality_rules.rows_needed(0.02, 0.05)
    assert quality_rules.certified_steps([0], need, 0.02, 0.05) == 1 and quality_rules.certified_steps([0], need - 1, 0.02, 0.05) == 0


def test_quality_rules_against_brute_force(spark):
    """Cutoffs and verdicts of the whole operator, worked out again from the texts."""
    where = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    got = {r.doc_id: r for r in quality_rules.apply_quality_rules(docs, labels).collect()}
    stats = statistics.document_statistics(docs, keep=["lang"]).withColumn("stratum", F.col("lang"))
    cuts = quality_rules.certify(stats, labels)
    marks = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    passed = [r for r in stats.collect() if not (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)]
    held = {r.doc_id for r in stats.where(F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(quality_rules.PROPOSE)) != 0).select("doc_id").collect()}

    def rejected(r, chosen):
        return any(chosen[x.name] is not None and r[x.part] > r[x.whole] * chosen[x.name] for x in quality_rules.RULES)

    for stratum, chosen in cuts.items():
        good = [r for r in passed if marks.get(r.doc_id) == 1 and r.doc_id in held and stratum in ("", r.stratum)]
        k, n = sum(rejected(r, chosen) for r in good), len(good)
        assert all(c is None for c in chosen.values()) or sum(math.comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(k + 1)) <= 0.05
    assert {r.doc_id for r in passed if not rejected(r, cuts.get(r.stratum, cuts[""]))} == {i for i, r in got.items() if r.kept}
    bad = [r for r in passed if marks.get(r.doc_id) == 0]
    assert sum(not got[r.doc_id].kept for r in bad) >= len(bad) / 3


def test_quality_rules_on_odd_rows(odd, empty, no_labels):
    got = quality_rules.apply_quality_rules(odd, no_labels).collect()
    assert len(got) == len(ODD) and all(r.kept == (not r.base_failed) for r in got)
    assert quality_rules.apply_quality_rules(empty, no_labels).isEmpty()


def test_quality_rules_judge_rows_not_ids(spark, no_labels):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(n, i, t, "en", "s", None, 0) for n, (i, t) in enumerate([(None, good), (None, bad), (None, None), (7, good), (7, bad), (8, bad), (9, good)])]
    docs = spark.createDataFrame(rows, "row int, " + DOCS)
    kept = quality_rules.keep_good(docs, no_labels)
    assert kept.columns == docs.columns and sorted(r.row for r in kept.collect()) == [0, 3, 6]


def _families(seed=5, families=12, each=40):
    """Groups of edited copies, many of them close to the threshold."""
    rng = random.Random(seed)
    texts = []
    for _ in range(families):
        base = [f"b{rng.randrange(4000)}" for _ in range(rng.randrange(40, 120))]
        for _ in range(each):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(30)}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(10_000, texts[0].upper()), (10_001, None), (10_002, ""), (10_003, "two words"), (10_004, "TWO words")]


def _brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(low(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)
    rows = _families()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates.near_duplicates(df, k, percent).collect()}
    assert got == _brute_components(rows, k, percent)


def test_chunks_cover_the_radius():
    for percent in (80, 85, 95):
        plan = near_duplicates.chunk_plan(percent)
        rng = np.random.default_rng(percent)
        for _ in range(500):
            wrong = set(rng.choice(near_duplicates.POSITIONS, plan.radius, replace=False).tolist())
            assert any(not wrong & set(key) for key in plan.keys)


def test_near_duplicates_on_odd_rows(odd, empty):
    got = near_duplicates.near_duplicates(odd, 3, 85).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 9)) and all(r.kept for r in got)
    assert near_duplicates.near_duplicates(empty).isEmpty()
    assert near_duplicates.drop_near_duplicates(odd).count() == len(ODD)


def test_near_duplicates_link_all_texts_of_an_id(spark):
    one, two = [f"a{i}" for i in range(80)], [f"b{i}" for i in range(80)]
    rows = [(5, one), (5, two), (1, [*one[:-1], "x"]), (9, [*two[:-1], "y"]), (6, [f"c{i}" for i in range(80)])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in near_duplicates.near_duplicates(df, 5, 80).collect()}
    assert got == {1: (1, True), 5: (1, False), 9: (1, False), 6: (6, True)}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(70, 60), (None, 3), (9, 9)], "a long, b long")
    got = {r.id: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 60: 60, 70: 60}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a<p>b <b>c</b>d", "a\n\nb cd"), ("<ul><li>x<li>y<ol start=3><li>q</ol></ul>", "- x\n- y\n  3. q"), ("<table><tr><td>aa<td>b<tr><td>c<td>dddd</table>", "aa  b\nc   dddd"),
        ('<div style="display:none">no</div>x<br>y<span hidden>no</span>', "x\ny"), ("<pre> k\n  z</pre>", " k\n  z"), ("<script>if (a</p>)</script>&amp;&copy;", "&©"), ("a<b", "a"), ("", ""), ("<!-- c --><title>t</title>", ""),
        ("<div>a</div><div>b</div>", "a\nb"), ("<p>a  \n b</p>", "a b"), ("<dl><dt>t<dd>d</dl>", "t\nd"), ("<td>loose", "loose"),
    ],
)
def test_html(html, text):
    assert html_text.render(html)[1] == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p title=Bob's>Hello <b>it's</b> fine</p>", "Hello it's fine"), ('<a href="foo"">x</a> y', "x y"), ('<p title="a>b">q</p>', "q"), ("<p a=\"b\"c='d'e=f/>z", "z"), ("a<p b='c", "a"), ("<p style='display:none' style=''>no", ""),
        ("let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> be", "let x=2 be"), ("<svg><title>no</title>no<path/><text>Axis <tspan>one</tspan></text><text>two</text></svg>", "Axis one\ntwo"),
        ("<svg><path d=m/><p>out", "out"), ("<svg><foreignObject><p>in</p></foreignObject></svg>after", "in\n\nafter"), ("<svg><text><![CDATA[a<b]]></text></svg>", "a<b"), ("<svg><defs><text>no</text></defs></svg>x", "x"),
        ("<select><option>A<option selected>B<option>C</select>!", "B!"), ("<select><option disabled>no<option>first</select>", "first"), ("<select multiple><optgroup label=G><option>A<option label=L>B</select>", "G\nA\nL"), ("<select><option>A<input>x", "Ax"),
        ("<div style='visibility:hidden'>no<p style='visibility:visible'>yes</p><i style='display:none'><b style='visibility:visible'>no</b></i></div>", "yes"), ("<ol><li>a<li style='visibility:hidden'>no<li>b</ol>", "1. a\n3. b"), ("<p style='display:none;display:block'>x", "x"),
    ],
)
def test_html_shows_all_visible_text(html, text):
    assert html_text.render(html)[1] == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<table><tr><td colspan=2>wide cell<td>x<tr><td>a<td>b<td>y</table>", "wide cell  x\na  b       y"), ("<table><tr><td colspan=9999999999>a<td>b</table>", "a  b"),
        ("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c</tbody><tbody><tr><td>d<td>e</table>", "a  b\n   c\nd  e"), ("<table><caption>t</caption><tr><td>a<td><td>c<tr><td>1<td>2<td>3</table>", "t\na     c\n1  2  3"),
        ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"), ("<ol><li value=5>a<li>b</ol>", "5. a\n6. b"), ("<dialog>no</dialog>x<dialog open>yes</dialog>", "x\nyes"), ("<details><summary>S</summary>no</details>z", "S\nz"), ("<details open><summary>S</summary>yes</details>z", "S\nyes\nz"),
        ("a<plaintext><b>x</b>", "a\n\n<b>x</b>"), ("<p class=x'>first</p><p>It's second</p>", "first\n\nIt's second"), ("<p don't>one</p><p>It's two</p><p>three</p>", "one\n\nIt's two\n\nthree"),
    ],
)
def test_html_tables_lists_and_closed_elements(html, text):
    assert html_text.render(html)[1] == text


class _Visible(HTMLParser):
    """All text outside of elements that never show, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.off, self.parts = [], []

    def handle_starttag(self, tag, attrs):
        names = dict(attrs)
        style = (names.get("style") or "").replace(" ", "").lower()
        if tag not in html_text.VOID and (self.off or tag in html_text.HIDDEN - {"head"} or "hidden" in names or "display:none" in style or "visibility:hidden" in style):
            self.off.append(tag)

    def handle_endtag(self, tag):
        if tag in self.off:
            while self.off.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.off:
            self.parts.append(data)


def test_html_shows_the_words_of_all_pages(spark):
    """Every visible word of every page, in any order (tables are laid out anew), and no other."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        parser = _Visible()
        parser.feed(r.html or "")
        parser.close()
        letters = lambda s: collections.Counter(c for c in s if c.isalpha())
        assert letters(got[r.page_id]) == letters("".join(parser.parts)), r.page_id


def test_html_of_very_long_pages_and_clashing_columns(spark):
    words = [f"w{i}" for i in range(400_000)]
    rows = [(1, "".join(f"<p><i title='x'>{w}</i></p>" for w in words), "t", "x"), (2, "<table>" + "<tr><td>a<td>b" * 20_000 + "</table>", "t", "x")]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, html string, title string, text string")).collect()}
    assert WORD.findall(got[1]) == words and got[2].count("a  b") == 20_000


def test_html_never_fails(spark, empty):
    rng = random.Random(3)
    parts = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "<!--", "-->", "<b", ">", "text ", "&amp", "<script>", "</script>", "<div>" * 300, '<a href="', "\x00"]
    rows = [(i, "".join(rng.choices(parts, k=30))) for i in range(200)] + [(200, None), (200, None)]
    df = spark.createDataFrame(rows, "page_id long, html string")
    assert html_text.extract_text(df).count() == 202
    assert html_text.extract_text(empty.select(F.lit(1).alias("page_id"), F.lit("").alias("html"))).isEmpty()
    words = [f"w{i}" for i in range(50)]
    assert WORD.findall(html_text.render("".join(f"<div><i>{w}</i>" for w in words))[1]) == words


def test_quality_classifier(spark, docs, labels, odd, empty, no_labels):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = quality_classifier.classify_quality(big, marks).join(marks, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    got = quality_classifier.classify_quality(odd, marks).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0.5 for r in quality_classifier.classify_quality(odd, no_labels).collect())
    assert quality_classifier.classify_quality(empty, labels).isEmpty()
    long = spark.createDataFrame([(1, "word " * 400_000), (2, "solo" * 300_000)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in quality_classifier.classify_quality(long, marks).collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)


def _targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3.0 * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        now = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / share for s in names}
        more = {s for s in names if s not in full and now[s] >= 3.0 * sizes[s]}
        if not more or not share:
            return now
        full |= more
        if len(full) == len(names):
            return {s: 3.0 * sizes[s] for s in names}


def test_mixing(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), None, rng.choices([None, "a", "b", "z", "é"], [1, 9, 3, 1, 2])[0], None, 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    size = {r[0]: len(WORD.findall(r[1])) for r in rows}
    per = collections.Counter()
    for r in rows:
        per[r[3]] += size[r[0]]
    want = _targets(per)
    once, again = (sorted(map(tuple, mixing.mix_sources(df).collect()), key=lambda r: r[0]) for df in (docs, docs.repartition(7)))
    assert once == again and len(once) == len(rows)
    taken, largest = collections.Counter(), collections.Counter()
    for doc, source, n, total, target, copies, t in once:
        assert n == size[doc] and total == per[source] and target == pytest.approx(want[source]) and t == n * copies <= 3 * n
        taken[source] += t
        largest[source] = max(largest[source], n)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in per)
    mixed = mixing.take_copies(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r[5] for r in once)


def test_mixing_levels(spark):
    rows = spark.range(5000).select(F.lit("a").alias("source"), F.lit(True).alias("named"), F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("text_hash"), F.xxhash64("id").alias("unit"), (F.col("id") % 50 + 1).alias("size"), F.lit(0.3).alias("fraction"))
    got = mixing.pivotal_rounding(rows, 5000, chunk=40, fan_in=5).collect()
    assert sorted(r.doc_id for r in got) == list(range(5000)) and {r.fraction for r in got} == {0.0, 1.0}
    assert abs(sum(r["size"] * r.fraction for r in got) - 0.3 * sum(r["size"] for r in got)) <= 50


def test_mixing_decides_rows_not_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 300)
    rng = random.Random(3)
    rows = [(7, "w " * rng.randrange(1, 80), "a", "x") for _ in range(500)] + [(i, "w " * rng.randrange(1, 80), "b", "x") for i in range(1000, 2000)]
    rows += [(None, "w " * 10, "c", f"x{i % 3}") for i in range(2000)] + [(None, None, "c", "x"), (-1, "w w", "c", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got, again = (mixing.mix_sources(df).collect() for df in (docs, docs.repartition(5)))
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    assert collections.Counter((r.doc_id, r.source, r["size"]) for r in got) == collections.Counter((d, s, len(WORD.findall(t or ""))) for d, t, s, _ in rows)
    for source in "abc":
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r["size"] for r in mine)
        assert all(r.taken <= 3 * r["size"] for r in mine)
    copies = collections.Counter((r.doc_id, r.source, r.text) for r in mixing.take_copies(docs).collect())
    sums = collections.Counter()
    for r in got:
        sums[r.doc_id, r.source, r["size"]] += r.copies if r["size"] else 0
    assert sum(copies.values()) == sum(sums.values()) and sum(n for (d, s, _), n in copies.items() if s == "c" and d is None) == sums[None, "c", 10]


def test_mixing_on_odd_rows(odd, empty):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == len(ODD) and all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.mix_sources(empty).isEmpty() and mixing.take_copies(empty).isEmpty()


def test_cross_parsing():
    rng = random.Random(1)
    letters = "abcdéñ中文字 .²"
    samples = {k: ["".join(rng.choices(letters, k=300)) for _ in range(2)] for k in "xyz"}
    parser = language_id.fit(samples)
    # Shorter and much longer texts than what is walked together, unknown letters, and nothing.
    texts = ["".join(rng.choices(letters + "qЖ", k=rng.choice([0, 1, 5, 40, 700, 5000]))) for _ in range(80)] + ["", "²½"]

    def phrases(text, train):
        n = i = 0
        while i < len(text):
            j = i
            while j < len(text) and text[i : j + 1] in train:
                j += 1
            i = max(j, i + 1)
            n += 1
        return n

    got, lengths = parser.parse(texts)
    for i, text in enumerate(texts):
        symbols = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())).encode()
        assert lengths[i] == len(symbols)
        for k, lang in enumerate(sorted(samples)):
            train = re.sub(" +", " ", "".join(c if c.isalpha() else " " for s in samples[lang] for c in s.lower() + " ")).encode()
            assert got[i, k] == phrases(symbols, train), (text[:40], lang)


def test_all_languages_are_learnt(spark, monkeypatch):
    """More languages than one would name, some with long texts only, in several scripts."""
    rng = random.Random(12)
    names = [f"l{i:02d}" for i in range(90)]
    letters = {n: [chr(rng.choice([0x61, 0x430, 0x4E00, 0xAC00]) + rng.randrange(24)) for _ in range(8)] for n in names}
    text = lambda n, k: " ".join("".join(rng.choices(letters[n], k=6)) for _ in range(k))
    rows = [(i, text(n, 4000 if i % 9 == 0 else 60), n) for i, n in enumerate(names * 6)]
    got = language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    held = [(r.lang_pred, rows[r.doc_id][2]) for r in got if r.held_out]
    assert {r.lang_pred for r in got} <= set(names) and sum(a == b for a, b in held) >= 0.9 * len(held)
    odd = spark.createDataFrame([(1, "² ½ 12", "x"), (2, "中", "x"), (3, None, "x")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred == "und" for r in language_id.identify_languages(odd).collect()} == {1: True, 2: False, 3: True}


def test_language_id(spark, odd, empty):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify_languages(big).join(big.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    odds = {r.doc_id: r for r in language_id.identify_languages(odd).collect()}
    assert len(odds) == len({r[0] for r in ODD}) and all(odds[i].lang_pred == "und" and odds[i].score == 0 for i in (1, 2, 3))
    assert language_id.identify_languages(empty).isEmpty()


def _rule(url, rules):
    host, path = "", ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    host = low(host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_filters(spark, empty):
    rng = random.Random(4)
    hosts = ["com", "example.com", "a.example.com", "ample.com", "b.a.example.com", "net", "x.net", "EXAMPLE.com", "", "com.", "example.co"]
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("a.example.com", "", "block"), ("net", "/", "block"), ("x.net", "/en", "allow"), ("com", "", "allow")]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/7', '/en/71?x=/en/', '/en#f', '?q', '/x/en/7'])}" for _ in range(400)] + [None, "", "no scheme", "a://b://c/d", "http://com/en/\nx"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "y")], "page_id long, url string, host string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for ranges in (1, 7):
        got = collections.Counter(map(tuple, url_filters.filter_urls(df, table, ranges=ranges).collect()))
        assert got == collections.Counter([(i, *_rule(u, rules)) for i, u in enumerate(urls)] + [(0, *_rule(urls[0], rules))])
    assert url_filters.filter_urls(df.limit(0), table).isEmpty()
    assert url_filters.filter_urls(df, table.limit(0)).where("rule is not null").isEmpty()


def test_decontamination(spark, odd, empty):
    rng = random.Random(6)
    vocab = ["the", "of", "Alpha", "beta", "gamma9", "Ünder", "x"]
    bench = [(1, " ".join(rng.choices(vocab, k=14))), (2, "Short One!"), (3, " ".join(["the"] * 12)), (4, None), (5, "--"), (10, "alpha, BETA")]
    texts = []
    for i in range(300):
        words = rng.choices(vocab, k=rng.randrange(0, 60))
        if i % 3 == 0:
            words[3:3] = bench[0][1].split()
        if i % 5 == 0:
            words += ["the"] * rng.randrange(9, 15)
        texts.append((i, rng.choice(["", "! "]) + " - ".join(words).upper() if i % 2 else " ".join(words)))
    texts += [(900, None), (901, "..."), (902, "the")]
    table = spark.createDataFrame(bench, "item_id long, text string")
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    rows = decontamination.find_contamination(documents, table).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}
    # The same where the set is too large to broadcast.
    both = [sorted(map(tuple, decontamination.window_hits(documents, table, most_rows=n).distinct().collect()), key=repr) for n in (0, 1000)]
    assert both[0] == both[1] and both[0]
    split = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(s))
    windows = collections.defaultdict(set)
    for item, text in bench:
        w = split(text)
        for i in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[tuple(w[i : i + min(10, len(w))])].add(str(item))
    for i, text in texts:
        w, hit, items = split(text), set(), set()
        for gram, who in windows.items():
            for j in range(len(w) - len(gram) + 1):
                if tuple(w[j : j + len(gram)]) == gram:
                    hit |= set(range(j, j + len(gram)))
                    items |= who
        assert got[i] == (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)), text
    assert decontamination.find_contamination(odd, table).count() == len(ODD)
    assert decontamination.find_contamination(empty, table).isEmpty()
    assert decontamination.find_contamination(odd, table.limit(0)).where("contaminated").isEmpty()
    assert decontamination.remove_contaminated(odd, table).columns == odd.columns


def test_decontamination_judges_rows_not_ids(spark):
    passage, other = " ".join(f"p{i}" for i in range(12)), " ".join(f"q{i}" for i in range(12))
    table = spark.createDataFrame([(1, passage), (None, other)], "item_id long, text string")
    rows = [(0, None, f"so {passage}"), (1, None, "clean"), (2, None, None), (3, 4, f"so {passage}"), (4, 4, "clean"), (5, 5, f"so {other}"), (6, 6, f"{other} {passage}")]
    docs = spark.createDataFrame(rows, "row int, doc_id long, text string")
    left = decontamination.remove_contaminated(docs, table)
    assert left.columns == docs.columns and sorted(r.row for r in left.collect()) == [1, 2, 4]
    every = collections.Counter((r.doc_id, r.n_words, r.n_hit) for r in decontamination.find_contamination(docs, table).collect())
    assert every == collections.Counter([(None, 13, 12), (None, 1, 0), (None, 0, 0), (4, 13, 12), (4, 1, 0), (5, 13, 12), (6, 24, 24)])
    # As the SQL twin counts: an item without an id is one, with no name in the hash.
    got = {r.doc_id: r for r in decontamination.find_contamination(docs.where("row > 4"), table).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [(got[i].n_hit, got[i].n_items, got[i].items_sha256) for i in (5, 6)] == [(12, 1, sha("")), (24, 2, sha("1"))]


PLAIN = re.compile(rb"(?:[0-9A-Za-z]|[\x80-\xff])+")


def _terms(text):
    """Words and their beginnings, with their counts."""
    words = PLAIN.findall(low(text).encode())
    return collections.Counter(words) + collections.Counter((b"^", w[:k]) for w in words for k in toxicity.BEGINNINGS if len(w) > k)


def test_toxicity_against_brute_force(spark, monkeypatch):
    """Neighbours, cosines, votes and scores from the raw texts."""
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    where = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    texts, marks = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    index = toxicity.fit(docs, labels)
    bags = {i: _terms(texts[i]) for i in marks if texts.get(i) is not None}
    bags = {i: b for i, b in bags.items() if b}
    assert sorted(index.ids.tolist()) == sorted(bags)  # every example that has a word
    prior, n = sum(marks.values()) / len(marks), len(bags)
    of = [max(1, sum(marks[i] == k for i in bags)) for k in (0, 1)]
    having = [collections.Counter(t for i, b in bags.items() if marks[i] == k for t in b) for k in (0, 1)]

    def weight(t):
        a, b = having[0][t], having[1][t]
        if not a + b:
            return math.log(n) + 1
        return (math.log(max(1, 1 / ((1 - prior) * a / of[0] + prior * b / of[1]))) + 1) * math.log2(2 + b / max(1, a * of[1] / of[0]))

    def vector(bag):
        w = {t: (1 + math.log(c)) * weight(t) for t, c in bag.items()}
        length = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / length for t, x in w.items()}

    vectors = {i: vector(b) for i, b in bags.items()}
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    a, b = index.curve
    for i in sorted(texts)[::9]:
        mine = vector(_terms(texts[i])) if texts[i] and _terms(texts[i]) else {}
        cos = {j: sum(x * v[t] for t, x in mine.items() if t in v) for j, v in vectors.items()}
        best = sorted((j for j in cos if cos[j] > 1e-9), key=lambda j: (-cos[j], j))[: toxicity.NEIGHBOURS]
        w = {j: cos[j] * n * ((prior / of[1]) if marks[j] else (1 - prior) / of[0]) for j in best}
        share = (sum(w[j] for j in best if marks[j]) + toxicity.PRIOR_WEIGHT * prior) / (sum(w.values()) + toxicity.PRIOR_WEIGHT)
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-(a * share + b))), abs=1e-4), i
        assert [cos[j] for j in got[i].evidence] == pytest.approx([cos[j] for j in best], abs=1e-6)


def test_toxicity_scores_are_calibrated(spark):
    where = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    held = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("score", "toxic").collect()
    assert abs(sum(r.score for r in held) - sum(r.toxic for r in held)) <= 0.15 * sum(r.toxic for r in held)
    assert sum(r.toxic for r in held if r.score > 0.9) >= 0.9 * sum(r.score > 0.9 for r in held)
    assert sum(r.toxic for r in held if r.score < 0.05) <= 0.05 * sum(r.score < 0.05 for r in held)


def test_toxicity(spark, odd, empty, no_labels):
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = toxicity.score_toxicity(big, marks).join(marks, "doc_id").where("held_out").collect()
    toxic = [r for r in held if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in held if not r.toxic) <= 0.06 * (len(held) - len(toxic))
    got = toxicity.score_toxicity(odd, marks).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    long = spark.createDataFrame([(1, "word " * 300_000, 0), (2, "solo" * 200_000, 1)], "doc_id long, text string, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(long, marks).collect())
    assert all(r.score == 0 for r in toxicity.score_toxicity(odd, no_labels).collect()) and toxicity.score_toxicity(empty, marks).isEmpty()


ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def _spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_secrets(spark, odd, empty):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    key = lambda n, a=letters: "".join(rng.choices(a, k=n))
    rows = []
    for i in range(400):
        parts = ["plain", "é\U0001f600", "identifierswithletters", f'ToKen = "{key(rng.randrange(8, 20))}"', f"api_key:{key(20)}", "secret: secret=abcdefghijkl", "AKIA" + key(rng.randrange(10, 20), "ABCDEFGHIJ0123456789"), key(rng.randrange(12, 20), "0123456789abcdef"), "password='short'", "\n"]
        rows.append((i, " ".join(rng.choices(parts, k=12)) + (" " + key(40) if i % 4 == 0 else "")))
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.find_secrets(df).collect()}
    found = 0
    for i, text in rows:
        want = _spans(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[3] == k for s in want) for k in ("assign", "access", "hex"))
        found += i % 4 == 0 and got[i].n_markov == 1
        assert "identifierswithletters" not in {text[int(a) : int(b)] for k, a, b in (s.split(":") for s in got[i].spans.split(",") if s)}
    assert found >= 90
    clean = {r.doc_id: r.text for r in secrets.redact_secrets(df).collect()}
    assert all(not _spans(t) for t in clean.values()) and clean[1].count("[SECRET]") >= 1
    assert secrets.find_secrets(odd).count() == len(ODD) and secrets.find_secrets(empty).isEmpty()
    same = secrets.redact_secrets(odd)
    assert same.columns == odd.columns and same.count() == len(ODD)


def test_secret_models_against_brute_force(spark):
    """Log-likelihood ratios from counted transitions, and the spans that they make."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rng = random.Random(10)
    alphabets = {"base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "lower": "abcdefghijklmnopqrstuvwxyz0123456789", "hex": "0123456789ABCDEF"}
    kinds = [("base62", 24), ("base62", 40), ("base62", 100), ("base32", 32), ("lower", 32), ("hex", 32)]
    secret = [(10**6 + i, f"some words {''.join(rng.choices(alphabets[k], k=n))} and more", k) for i, (k, n) in enumerate(kinds * 20)]
    plain = ["src/main/java/org/example/project/Handler", "thisIsAnOrdinaryIdentifierName", "SOME_ORDINARY_CONSTANT_NAME", "another-ordinary-page-title-here", "documents/reports/annual/summary"]
    extra = [(2 * 10**6 + i, f"see {x} there", "plain") for i, x in enumerate(plain)]
    table = docs.unionByName(spark.createDataFrame([r[:2] for r in secret + extra], docs.schema))
    spans = {}
    for r in secrets.scan_spans(table).collect():
        spans.setdefault(r.doc_id, []).append(r)
    hit = lambda rows: sum(any(s.kind == "markov" for s in spans.get(r[0], [])) for r in rows)
    for kind in alphabets:
        rows = [r for r in secret if r[2] == kind]
        assert hit(rows) >= 0.9 * len(rows), kind
    assert sum(any(s.kind == "markov" for s in v) for i, v in spans.items() if i < 10**6) <= 0.01 * docs.count()
    # The ratio of each token, counted again from the same samples.
    stored = secrets.store(secrets._spans(table), "test-spans")
    base = stored.where("kind != 'token'")
    ordinary = secrets.store(secrets.ordinary_samples(table), "test-identifiers")
    fixed = spark.range(secrets.SEEDS).select(F.concat(F.lit("digest "), F.col("id").cast("string")).alias("value"))
    random_rows = secrets.digests(secrets.digest_seeds(ordinary.where("component = 0"))).union(secrets.digests(fixed)).union(base.select(secrets.family(F.col("value")), "value").where("length(value) >= 12")).collect()
    counts = [collections.Counter() for _ in range(len(secrets.FAMILIES) + len(secrets.ORDINARY))]
    for family, value in [(r[0], r[1]) for r in random_rows] + [(len(secrets.FAMILIES) + r.component, r.value) for r in ordinary.where("NOT held").collect()]:
        counts[family].update(zip(["", *value], value))

    def log(k, a, b):
        n = counts[k]
        own = (sum(v for (_, y), v in n.items() if y == b) + secrets.SMOOTHING) / (sum(n.values()) + secrets.SMOOTHING * (secrets.SIDE - 1))
        return math.log((n[a, b] + secrets.BACKOFF * own) / (sum(v for (x, _), v in n.items() if x == a) + secrets.BACKOFF))

    patterns = [(i, re.compile(p)) for i, (_, p, _) in enumerate(secrets.FAMILIES) if p]
    last = [name for name, _, _ in secrets.FAMILIES].index("base64")
    for r in [s for v in spans.values() for s in v if s.kind == "markov"][:12]:
        k = next((i for i, p in patterns if p.match(r.value)), last)
        total = lambda m, value=r.value: sum(log(m, a, b) for a, b in zip(["", *value], value))
        want = total(k) - max(total(len(secrets.FAMILIES) + i) for i in range(len(secrets.ORDINARY)))
        assert r.llr == pytest.approx(want, abs=1e-3 * len(r.value))


def test_secret_models_learn_from_all_texts(spark):
    """Identifiers of every text, each once; the cutoff is an exact quantile of the held ones; steps of long values."""
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    texts = [f"{word(3 * i)} {word(3 * i + 1)} {word(3 * i + 2)}" for i in range(3000)]
    table = spark.createDataFrame([*enumerate(texts + texts[:200]), (9000, None), (9001, "two words")], "doc_id long, text string")
    got = secrets.identifiers(table).collect()
    assert sorted(r.value for r in got) == sorted(t.replace(" ", "_") for t in texts)
    assert 0.4 * len(got) <= sum(r.held for r in got) <= 0.6 * len(got)
    ordinary = secrets.store(secrets.ordinary_samples(table), "test-identifiers")
    models = secrets.store(secrets.markov_models(secrets.digests(secrets.digest_seeds(table)), ordinary.where("NOT held")), "test-models")
    rows = spark.range(2000).select(F.lit(0).alias("component"), F.substring(F.sha2(F.col("id").cast("string").cast("binary"), 256), 1, 30).alias("value"), F.lit(True).alias("held"))
    means = [r.llr / 30 for r in secrets.ratio(models, rows.select(F.col("value").alias("key"), "value"), ["key"]).collect()]
    assert len(means) == 2000 and secrets.cutoff(models, rows) == pytest.approx(max(0, np.quantile(means, 1 - secrets.FALSE_RATE)), abs=1e-9)
    values = ["", "a", "ab", *["".join(random.Random(n).choices("abcXYZ019_-/", k=n)) for n in (254, 255, 256, 257, 511, 512, 513, 2000)]]
    steps = collections.Counter((r.id, r.pair) for r in secrets._steps(spark.createDataFrame([*enumerate(values)], "id int, value string"), "id").collect())
    assert steps == collections.Counter((i, a + b) for i, v in enumerate(values) for a, b in zip(secrets.START + v, v))


def test_ordinary_typography_is_no_secret(spark):
    """Rule lines, runs, alphabets, dates, part numbers, paths and names stay; what is planted beside them goes."""
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rng = random.Random(21)
    plain = [c * n for c in "-=_+/aZ01" for n in (20, 33, 80)] + ["=-" * 15, "-=-=" * 8, "+---------+---------+----------+", "1234567890" * 3, low, up, up + low, "".join(rng.choices("ACGT", k=60)), "".join(rng.choices("ACGT", k=600))]
    plain += [
        "2024-03-15_17-42-08-000001", "2024-01-01T00-00-00Z-backup-full", "978-3-16-148410-0-2024-01-01", "ISBN-13-978-0-306-40615-7", "E2E-ISO-27001-2013-A-12-4", "MKTG-Q3-2024-EMEA-DACH-07", "INV-2024-000123-REV-B-FINAL", "RFC-2119-SECTION-4-PARAGRAPH-2",
        "com/org/example/project/module/Main", "usr/local/lib/python3/site-packages/numpy/core", "node_modules/react-dom/cjs/react-dom-production", "https//www/example/com/products/12345/details", "550e8400-e29b-41d4-a716-446655440000", "v2-beta-release-candidate-20240315",
        "AbstractSingletonProxyFactoryBean", "getUserAccountInformationById", "order_id_20240315_batch_0007", "internationalization_configuration", "DONAUDAMPFSCHIFFFAHRTSGESELLSCHAFT",
    ]
    secret = "".join(rng.choices(up + low + "0123456789", k=40))
    rows = [(i, f"Title\n{x}\nsome words | {x} | more") for i, x in enumerate(plain)] + [(10_000, f"{plain[0]} {secret} {plain[1]}")]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in secrets.redact_secrets(table.unionByName(docs.select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))).where("doc_id < 100000").collect()}
    assert {i: t for i, t in clean.items() if i < 10_000} == dict(rows[:-1])
    assert clean[10_000] == f"{plain[0]} [SECRET] {plain[1]}"


def test_long_tokens_and_redaction(spark):
    rng = random.Random(13)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    big, hexes = "".join(rng.choices(letters, k=1_000_000)), [f"{rng.getrandbits(64):016x}" for _ in range(3000)]
    rows = [(1, f"é {big} z"), (2, " x ".join(hexes)), (3, "so on " * 900 + hexes[0] + hexes[1]), (None, hexes[2]), (None, "clean"), (4, None), (4, f"token={hexes[3]}{hexes[4]}!")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, value string")
    clean = {(r.doc_id, r.text) for r in secrets.redact_secrets(docs).collect()}
    assert clean == {(1, "é [SECRET] z"), (2, " x ".join(["[SECRET]"] * 3000)), (3, "so on " * 900 + "[SECRET]"), (None, "[SECRET]"), (None, "clean"), (4, None), (4, "[SECRET]!")}


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    out = corpus_pipeline.run(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert out.columns == docs.columns and 0 < out.select("doc_id").distinct().count() < docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "secrets", "mixing"]
    # Brute force of the base rules, groups, windows and base spans; the mix by its targets.
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = quality_rules.keep_good(docs, labels)
    base = {r.doc_id for r in docs.collect() if (s := _statistics(r.text))[0] >= 50 and 100 * s[4] <= 50 * s[0]}
    assert {r.doc_id for r in kept.collect()} <= base
    groups = _brute_components([(r.doc_id, r.text) for r in kept.collect()], 5, 80)
    single = near_duplicates.drop_near_duplicates(kept)
    assert {r.doc_id for r in single.collect()} == {i for i, g in groups.items() if g[2]}
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    split = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(s))
    grams = {tuple(w[i : i + min(10, len(w))]) for r in bench.collect() for w in [split(r.text)] if w for i in range(len(w) - min(10, len(w)) + 1)}
    left = corpus_pipeline.decontaminate(spark, single, DATA)
    free = lambda w: not any(tuple(w[i : i + k]) in grams for k in {len(g) for g in grams} for i in range(len(w) - k + 1))
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in single.collect() if free(split(r.text))}
    masked = corpus_pipeline.secrets(spark, left, DATA)
    assert masked.columns == docs.columns and masked.count() == left.count() and not any(_spans(r.text) for r in masked.collect())
    before = {r.doc_id: r.text for r in left.collect()}
    assert all(r.text == before[r.doc_id] or "[SECRET]" in r.text for r in masked.collect()) and all("[SECRET]" in r.text for r in masked.collect() if _spans(before[r.doc_id]))
    assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in masked.collect()}
    sizes = collections.Counter()
    for r in masked.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    taken = collections.Counter()
    for r in out.collect():
        taken[r.source] += len(WORD.findall(r.text or ""))
    longest = max(len(WORD.findall(r.text or "")) for r in masked.collect())
    assert all(abs(taken[s] - want) <= longest for s, want in _targets(sizes).items())


def test_stages_on_odd_rows(spark, odd, empty, no_labels):
    """Null ids, sources and texts, repeated rows, an empty table and extra columns, stage by stage."""
    table = spark.createDataFrame([(1, "x")], "item_id long, text string")
    stages = [lambda d: quality_rules.keep_good(d, no_labels), near_duplicates.drop_near_duplicates, lambda d: decontamination.remove_contaminated(d, table), secrets.redact_secrets, mixing.take_copies]
    for stage in stages:
        for docs in (odd, empty):
            got = stage(docs)
            assert got.columns == docs.columns and got.count() <= 3 * docs.count()
    assert secrets.redact_secrets(odd).count() == len(ODD) and decontamination.remove_contaminated(odd, table).count() == len(ODD)
