import math
import random

import pytest
from pyspark.sql import functions as F

from fieldgrid.llm import quality_rules, url_reputation
from fieldgrid.llm.quality_rules import RULES

WORDS = "the quick brown fox jumps over a lazy dog while many small birds sing".split()


def _count(text):
    words = [w for w in __import__("re").split(r"[ \t\n\x0b\x0c\r]+", text or "") if w]
    grams = {}
    for i in range(len(words) - 4):
        grams.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    lines, seen, dup = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_counts_equal_brute_force(spark):
    g = random.Random(1)
    texts = [None, "", " \n\t ", "a b c d e a b c d e", "x " * 40, "é ü\nß\né ü\n", "a\x0bb\x0cc\rd", "#*$%&|<>!"]
    texts += ["".join(g.choice(["a", "b", "c ", " ", "\n", "d e ", "# "]) for _ in range(g.randint(0, 120))) for _ in range(150)]
    texts += [" ".join(g.choice(WORDS) for _ in range(3000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b c"), (0, None), (0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality_rules.judge(df, order=RULES).collect()
    assert len(got) == len(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    mine = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key)
    assert mine == sorted(((i, *_count(t)) for i, t in rows), key=key)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)


def test_order_changes_no_verdict_and_columns_stay(spark):
    good = "The river bends twice before it meets another stream. Nobody counted how often boats passed there last year."
    rows = [(1, good, 5), (2, good.upper() + "!!! " * 20, 5), (3, "# $ % " * 30, 5), (4, None, None), (5, good, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    a = sorted(r.doc_id for r in quality_rules.keep(df, order=RULES).collect())
    b = quality_rules.keep(df, order=RULES[::-1])
    assert a == sorted(r.doc_id for r in b.collect()) == [1, 5] and b.columns == df.columns


def test_cascade_plan_covers_every_rule_and_takes_empty_tables(spark):
    df = spark.createDataFrame([(1, "word " * 30), (2, "a b")], "doc_id long, text string")
    assert sorted(r.name for r in quality_rules.plan_cascade(df)) == sorted(r.name for r in RULES)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules.judge(empty).collect() == []


def test_a_rejected_row_meets_no_later_feature(spark):
    """A feature that can't be made of rejected rows: it is never asked for, in whichever place its rule stands."""
    trap = quality_rules.Feature((("trap", lambda: F.when(F.col("n_words") < 10, F.raise_error(F.lit("made"))).otherwise(F.size("_w"))),), ("words",))
    features = {**quality_rules.FEATURES, "trap": trap}
    late = quality_rules.Rule("late", ("trap",), lambda t: F.col("trap") > 100)
    df = spark.createDataFrame([(1, "a b c"), (2, " ".join(WORDS)), (3, " ".join(WORDS) * 20), (4, None)], "doc_id long, text string")
    start = df.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"), F.lit(None).cast("string").alias("_why"))
    got = {r.doc_id: r._why for r in quality_rules.run_cascade(start, [RULES[0], late], features=features).collect()}
    assert got == {1: "few_words", 2: None, 3: "late", 4: "few_words"}
    with pytest.raises(Exception, match="made"):
        quality_rules.run_cascade(start, [late, RULES[0]], features=features).collect()


def test_cheap_rules_that_reject_much_come_first(spark):
    rows = [(i, "one two" if i % 2 else " ".join(WORDS[: 12 + i % 3])) for i in range(300)]
    order = quality_rules.plan_cascade(spark.createDataFrame(rows, "doc_id long, text string"))
    assert order[0].name == "few_words"


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("http://A.Example.ORG/es/1?x=/y#z", "a.example.org", "/es/1", "example.org/es/"),
        ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1"),
        ("x://notexample.org/es/", "notexample.org", "/es/", "org/"),
        ("http://example.com/de/", "example.com", "/de/", "com/de/"),
        ("http://example.com?q", "example.com", "", None),
        ("http://example.org", "example.org", "", None),
        ("no scheme", "", "", None),
        (None, "", "", None),
        ("a://b://c/d", "b:", "//c/d", None),
    ],
)
def test_url_parts_and_rules(spark, url, host, path, rule):
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, n long, bad long")
    r = url_reputation.judge_pages(pages, none).first()
    assert (r.host, r.path, r.rule) == (host, path, rule)
    assert r.verdict in ("allow", "block")


def test_reputation_shrinks_to_the_domain(spark):
    hosts = [("bad.spam.net", 500, 480), ("new.spam.net", 1, 0), ("fine.net", 500, 5), ("unseen.fine.net", 0, 0), ("a.good.co.uk", 300, 2)]
    df = spark.createDataFrame(hosts, "host string, n long, bad long")
    got = {r.host: r for r in url_reputation.host_reputation(df).collect()}
    assert got["bad.spam.net"].blocked and got["bad.spam.net"].bad_tail < 1e-6 and not got["fine.net"].blocked and got["fine.net"].bad_tail > 0.999
    assert got["new.spam.net"].bad_mean > got["unseen.fine.net"].bad_mean > 0
    assert all(0 < r.bad_mean < 1 for r in got.values())


def test_a_host_does_not_speak_for_itself_twice(spark):
    """The only host of its domain and suffix has the prior of the others, whatever its own outcomes."""
    own = lambda n, bad: [("one.alone", n, bad), ("a.x.net", 100, 10), ("b.x.net", 100, 12), ("c.y.net", 100, 9)]
    policy = url_reputation.Policy(min_strength=50.0, max_strength=50.0)
    for n, bad in ((0, 0), (10, 10), (100, 50)):
        got = {r.host: r for r in url_reputation.host_reputation(spark.createDataFrame(own(n, bad), "host string, n long, bad long"), policy).collect()}
        prior = (31 + 0.5) / (300 + 1)
        assert got["one.alone"].bad_mean == pytest.approx((50 * prior + bad) / (50 + n))


def test_mass_of_a_beta_posterior(spark):
    g = random.Random(2)
    rows = [(g.uniform(0.2, 60), g.uniform(0.2, 60)) for _ in range(40)] + [(0.5, 0.5), (1.0, 1.0), (300.0, 900.0), (2000.0, 9000.0), (3.0, 1e-3 + 8)]
    got = url_reputation.with_mass_below(spark.createDataFrame(rows, "alpha double, beta double"), 0.2, "p").collect()
    for r in got:
        # Simpson's rule in t with x = 0.2 t**k, which takes the pole at zero away
        k, n = max(1.0, 3 / r.alpha), 20_000
        f = lambda t, r=r, k=k: 0.0 if t == 0 else math.exp(math.lgamma(r.alpha + r.beta) - math.lgamma(r.alpha) - math.lgamma(r.beta) + (r.alpha - 1) * math.log(0.2 * t**k) + (r.beta - 1) * math.log1p(-0.2 * t**k)) * 0.2 * k * t ** (k - 1)
        want = sum(f(i / n) * (1 if i in (0, n) else 4 if i % 2 else 2) for i in range(n + 1)) / (3 * n)
        assert r.p == pytest.approx(want, abs=1e-6), r


def test_labels_may_repeat_and_miss(spark):
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert [(r.page_id, r.n, r.bad) for r in url_reputation.outcomes_from_labels(labels).collect()] == [(1, 2, 1)]
    assert url_reputation.judge_pages(spark.createDataFrame([], "page_id long, url string"), url_reputation.outcomes_from_labels(labels)).collect() == []
