"""Quality rules as a short-circuit cascade (native).

Every rule is a Column that is true when it rejects a document, over features that
it names. ``plan_cascade`` measures on a bounded sample what each feature costs
beyond those it needs, and which rows each rule rejects. The rules are ordered
greedily by new rejections per cost, where a feature that an earlier rule has
made costs nothing more. ``run_cascade`` makes a rule's features only for
documents that no earlier rule has rejected, so a document stops at its first
rejection. The order changes only the work, never the verdict: a document is
kept when no rule rejects it.

Defined cases: a null or empty text has no words, is rejected by ``few_words``
and yields zeros; repeated rows and null ids are judged row by row; rules of equal
yield keep the order they are given in; other columns, whatever their names, pass
through untouched; an empty table gives an empty result; texts are read whole.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldgrid.llm.common import WHITESPACE, is_scan, materialise, split_words, text_or_empty

WINDOW = 5
#: Rows on which cost and selectivity are estimated, and files from which they come; bounds, not shares of the data.
SAMPLE_ROWS = 1000
SAMPLE_FILES = 32


@dataclass(frozen=True)
class Thresholds:
    min_words: int = 10
    max_repeat_percent: int = 20
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 30
    mean_word_chars: tuple[int, int] = (3, 12)
    max_exclamation_percent: int = 50
    max_upper_percent: int = 60


Step = tuple[str, Callable[[], Column]]


@dataclass(frozen=True)
class Feature:
    """Columns made one after another from ``_t``, the text, and the columns of the features it needs. Each is a projection
    of its own: what a lambda reads by index must be a stored column, or it would be computed again for every element."""

    steps: tuple[Step, ...]
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    name: str
    features: tuple[str, ...]
    rejects: Callable[[Thresholds], Column]


def _grams() -> Column:
    gram = lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(WINDOW)])
    return F.when(F.size("_w") > WINDOW, F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), gram))


def _sorted_grams() -> Column:
    found = F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(found))


def _repeated_places() -> Column:
    words_at = lambda x: F.slice(F.col("_w"), x.i + 1, WINDOW)

    def twin(x: Column, other: Column) -> Column:
        return F.coalesce((other.h == x.h) & (words_at(other) == words_at(x)), F.lit(False))

    twice = F.filter("_s", lambda x, j: twin(x, F.get(F.col("_s"), j - 1)) | twin(x, F.get(F.col("_s"), j + 1)))
    return F.array_sort(F.transform(twice, lambda x: x.i))


def _repeated_words() -> Column:
    step = F.transform("_p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_p"), j + 1) - p, F.lit(WINDOW))))
    return F.coalesce(F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long")


def _removed(pattern: str) -> Callable[[], Column]:
    return lambda: (F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))).cast("long")


FEATURES = {
    "words": Feature((("_w", lambda: split_words(F.col("_t"))), ("n_words", lambda: F.size("_w").cast("long")))),
    "word_chars": Feature((("word_chars", lambda: F.length(F.array_join("_w", "")).cast("long")),), ("words",)),
    "symbols": Feature((("n_symbols", _removed(r"[#*$%&|<>]")),)),
    "lines": Feature(
        (
            ("_l", lambda: F.filter(F.split("_t", "\n", -1), lambda x: F.btrim(x, F.lit(WHITESPACE)) != "")),
            ("n_lines", lambda: F.size("_l").cast("long")),
            ("n_dup_lines", lambda: (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")),
        )
    ),
    "repeats": Feature((("_g", _grams), ("_s", _sorted_grams), ("_p", _repeated_places), ("n_repeat_words", _repeated_words)), ("words",)),
    "exclamations": Feature((("n_exclamations", _removed("!")),)),
    "capitals": Feature((("n_capitals", _removed("[A-Z]")),)),
}


def add_features(df: DataFrame, names: tuple[str, ...], made: set[str], only: Column | None = None, features: dict[str, Feature] = FEATURES) -> DataFrame:
    """df with the columns of features that aren't in ``made`` yet (it is updated); null where ``only`` is false."""
    for name in names:
        if name in made:
            continue
        df = add_features(df, features[name].needs, made, only, features)
        for column, step in features[name].steps:
            df = df.withColumn(column, step() if only is None else F.when(only, step()))
        made.add(name)
    return df


def _share(count: Column, percent: int, of: Column) -> Column:
    return count * 100 > of * percent


BASE_RULES = [
    Rule("few_words", ("words",), lambda t: F.col("n_words") < t.min_words),
    Rule("repeated_words", ("words", "repeats"), lambda t: _share(F.col("n_repeat_words"), t.max_repeat_percent, F.col("n_words"))),
]
RULES = BASE_RULES + [
    Rule("symbols", ("words", "symbols"), lambda t: _share(F.col("n_symbols"), t.max_symbol_percent, F.col("n_words"))),
    Rule("duplicate_lines", ("lines",), lambda t: _share(F.col("n_dup_lines"), t.max_dup_line_percent, F.col("n_lines"))),
    Rule("short_or_long_words", ("word_chars",), lambda t: (F.col("word_chars") < F.col("n_words") * t.mean_word_chars[0]) | (F.col("word_chars") > F.col("n_words") * t.mean_word_chars[1])),
    Rule("exclamations", ("words", "exclamations"), lambda t: _share(F.col("n_exclamations"), t.max_exclamation_percent, F.col("n_words"))),
    Rule("upper_case", ("word_chars", "capitals"), lambda t: _share(F.col("n_capitals"), t.max_upper_percent, F.col("word_chars"))),
]


def sample_texts(docs: DataFrame, rows: int = SAMPLE_ROWS, files: int = SAMPLE_FILES) -> DataFrame:
    """At most ``rows`` texts in the order of a hash, from at most ``files`` files that a hash has chosen, written down."""
    text = F.col("text").cast("string").alias("text")
    if is_scan(docs):
        chosen = sorted(docs.inputFiles(), key=lambda f: hashlib.blake2b(f.encode()).digest())[:files]
        some = docs.filter(F.col("_metadata.file_path").isin(chosen))
    else:
        some = docs
    keyed = some.select(text, F.xxhash64("doc_id", F.octet_length("text")).alias("_h"))
    return materialise(keyed.orderBy("_h").limit(rows).select("text"), "rule-sample")


def _seconds(df: DataFrame, names: tuple[str, ...], features: dict[str, Feature], times: int = 2) -> float:
    """The least time of a job that makes these features of every row."""
    made: set[str] = set()
    df = add_features(df.select(text_or_empty("text").alias("_t")), names, made, features=features)
    last = [features[n].steps[-1][0] for n in names]
    job, least = df.agg(F.count("_t"), *[F.count(c) for c in last]), float("inf")
    for _ in range(times):
        began = time.perf_counter()
        job.collect()
        least = min(least, time.perf_counter() - began)
    return least


def _closure(names: tuple[str, ...], features: dict[str, Feature]) -> set[str]:
    return set(names).union(*(_closure(features[n].needs, features) for n in names)) if names else set()


def plan_cascade(docs: DataFrame, rules: list[Rule] = RULES, thresholds: Thresholds = Thresholds(), rows: int = SAMPLE_ROWS, features: dict[str, Feature] = FEATURES, given: set[str] = frozenset()) -> list[Rule]:
    """Order rules by rejection per cost, both estimated on at most ``rows`` rows.

    Which rows fall is one query. A feature's cost is the time of a job that makes it, less that of a job that makes only
    what it needs, so reading and scheduling don't count. Greedy: at each step the rule that rejects most of the rows still
    alive per second of features that aren't made yet; those in ``given`` are made anyway."""
    sample = sample_texts(docs, rows)
    needed = sorted(set().union(*(_closure(r.features, features) for r in rules)))
    whole = add_features(sample.select(text_or_empty("text").alias("_t")), tuple(needed), set(), features=features)
    alive = whole.select(*[F.coalesce(r.rejects(thresholds), F.lit(False)).alias(r.name) for r in rules]).collect()
    bare = _seconds(sample, (), features)
    cost = {n: max(_seconds(sample, (n,), features) - (_seconds(sample, features[n].needs, features) if features[n].needs else bare), 1e-4) for n in needed}
    order, left, made = [], list(rules), set(given)
    while left:
        price = lambda r: 1e-4 + sum(cost[n] for n in _closure(r.features, features) - made)
        best = max(left, key=lambda r: (sum(row[r.name] for row in alive) / price(r), -price(r)))
        order.append(best)
        left.remove(best)
        made |= _closure(best.features, features)
        alive = [row for row in alive if not row[best.name]]
    return order


def run_cascade(df: DataFrame, order: list[Rule], thresholds: Thresholds = Thresholds(), made: set[str] = frozenset(), features: dict[str, Feature] = FEATURES) -> DataFrame:
    """df(_t, _why) with ``_why`` set to the first rule that rejects a row; rows where it is set already meet no rule.
    Features are made just before the rule that needs them, for rows that are still alive."""
    made = set(made)
    for rule in order:
        alive = F.col("_why").isNull()
        df = add_features(df, rule.features, made, alive, features)
        df = df.withColumn("_why", F.when(alive & rule.rejects(thresholds), F.lit(rule.name)).otherwise(F.col("_why")))
    return df


COUNTS = ("words", "word_chars", "symbols", "lines", "repeats")


def judge(docs: DataFrame, thresholds: Thresholds = Thresholds(), order: list[Rule] | None = None) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every document. The counts are part of the result and made of every row;
    the cascade saves the features of the other rules."""
    order = order or plan_cascade(docs, RULES, thresholds, given=set(COUNTS))
    made: set[str] = set()
    df = add_features(docs.select("doc_id", text_or_empty("text").alias("_t")), COUNTS, made)
    base = F.lit(False)
    for rule in BASE_RULES:
        base = base | rule.rejects(thresholds)
    df = df.withColumn("base_failed", base).withColumn("_why", F.when(F.col("base_failed"), F.lit("base")))
    df = run_cascade(df, [r for r in order if r not in BASE_RULES], thresholds, made)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("_why").isNull().alias("kept"))


def keep(docs: DataFrame, thresholds: Thresholds = Thresholds(), order: list[Rule] | None = None) -> DataFrame:
    """The rows of docs that no rule rejects, all columns as they were.

    The row number keeps Catalyst from moving the filter below the projections, where the counts
    would be computed once per use."""
    order = order or plan_cascade(docs, RULES, thresholds)
    packed = docs.select(F.struct("*").alias("_row"), text_or_empty("text").alias("_t"), F.lit(None).cast("string").alias("_why"))
    judged = run_cascade(packed, order, thresholds).select("_row", "_why", F.monotonically_increasing_id().alias("_n"))
    return judged.filter(F.col("_why").isNull() & (F.col("_n") >= 0)).select("_row.*")


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    list_transform(range(0, greatest(len(w) - 4, 0)), lambda i: array_to_string(w[i + 1:i + 5], ' ')) AS g
  FROM w
), r AS (
  SELECT *, row_number() OVER () AS rid FROM l
), e AS (
  SELECT rid, unnest(g) AS g, unnest(range(0, len(g))) AS i FROM r
), twice AS (
  SELECT rid, g FROM e GROUP BY rid, g HAVING count(*) > 1
), p AS (
  SELECT rid, count(DISTINCT e.i + k.k) AS n FROM e JOIN twice USING (rid, g) CROSS JOIN (SELECT unnest(range(0, 5)) AS k) k GROUP BY rid
), f AS (
  SELECT doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
    length(t) - length(replace(t, '!', '')) AS n_bangs, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper
  FROM r LEFT JOIN p USING (rid)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 3 * n_words OR word_chars > 12 * n_words
    OR 100 * n_bangs > 50 * n_words OR 100 * n_upper > 60 * word_chars) AS kept
FROM b
"""
