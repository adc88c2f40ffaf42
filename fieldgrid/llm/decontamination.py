"""Benchmark decontamination as a prefix-filtered set join (native).

Items are cut into windows of ten consecutive words (a shorter item is one
window). A window is a set of shingles with their places: its three-word
shingles, or the whole window where that has fewer words. Containment is asked
for in full, so the necessary prefix of a window is one shingle, and the rarest
one in the corpus is taken. The steps:

1. every document shingle is looked up in a bitmap of the items' shingle hashes,
   within the row; the few that are in it are joined with the shingles of the items
   and stored with their place (the corpus never moves);
2. shingles are ordered by the number of those matches, over all documents;
3. stored matches are joined with each window's prefix shingle; the place of the
   shingle fixes where the window would start, and the start and end must lie in
   the document (positional and length bounds);
4. each candidate is verified: all shingles of the window stand at their places.
   Overlapping word shingles spell the window out, so this is exact.

Results belong to a text, so documents with equal texts share one computation
(keyed by the text's SHA-256) and ids may be null or repeated.

Item tables are measured and broadcast only below a size limit; beyond it the
same joins shuffle. Defined cases: null or empty texts have no words and are
never contaminated; items without words are ignored; equal windows of several
items count for each; items with a null id mark words but aren't listed;
repeated item ids count once; of equally rare shingles the least is the prefix;
texts are read whole; other columns, whatever their names, pass through ``clean``;
empty tables give clean documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldgrid.llm.common import ascii_lower, broadcast_if_small, materialise, text_or_empty

WINDOW = 10
SHINGLE = 3
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD, -1), "")


def _shingles(words: Column, size: int) -> Column:
    """Struct (pos, shingle) for each run of ``size`` words; words must be a stored column."""
    run = lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(size)])
    places = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("pos"), run(i).alias("shingle")))


def _hash(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(size)])


#: Bits of the bitmap: as many for each shingle, between these bounds (8 KB to 1 MB). A full one lets all pass to the join.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 23


def _bitmap(wanted: DataFrame) -> Column:
    """The hashes of wanted(shingle, k) as a constant array of 64-bit words, of bounded size."""
    bits = LEAST_BITS
    n = wanted.count()
    while bits < min(n * BITS_EACH, MOST_BITS):
        bits *= 2
    words = F.split("shingle", " ", -1)
    hashed = F.coalesce(*[F.when(F.col("k") == k, _hash(words, F.lit(0), k)) for k in range(1, SHINGLE + 1)])
    at = F.pmod(hashed, F.lit(bits))
    rows = wanted.select((at / 64).cast("int").alias("i"), F.expr("1L").alias("one"), (at % 64).cast("int").alias("b"))
    rows = rows.groupBy("i").agg(F.bit_or(F.expr("shiftleft(one, b)")).alias("v")).collect()  # at most MOST_BITS / 64
    table = [0] * (bits // 64)
    for r in rows:
        table[r.i] = r.v
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")


def _marked(bitmap: Column, size: Column, h: Column) -> Column:
    at = F.pmod(h, size)
    return F.getbit(F.get(bitmap, (at / 64).cast("int")), (at % 64).cast("int")) == 1


def item_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item_id, window (its words joined), len, shingles(pos, shingle); one row per item and distinct window."""
    words = benchmark.select("item_id", item_words(text_or_empty()).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    cut = words.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s") + 1, window).alias("w")).distinct()
    n = F.size("w")
    whole = F.array(F.struct(F.lit(0).alias("pos"), F.array_join("w", " ").alias("shingle")))
    return cut.select("item_id", F.array_join("w", " ").alias("window"), n.alias("len"), F.when(n < shingle, whole).otherwise(_shingles(F.col("w"), shingle)).alias("shingles"))


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(hits(key, window, start, len), windows): every exact occurrence of a window in a text."""
    windows = materialise(item_windows(benchmark, window, shingle), "windows")
    parts = windows.select("window", "len", F.explode("shingles").alias("p")).select("window", "len", "p.pos", "p.shingle").distinct()
    wanted = parts.select("shingle").distinct()
    wanted = materialise(wanted.withColumn("k", F.size(F.split("shingle", " ", -1))), "wanted")
    sizes = sorted(r.k for r in wanted.select("k").distinct().collect())  # at most ``shingle`` values
    words = docs.select(F.sha2(text_or_empty(), 256).alias("key"), item_words(text_or_empty()).alias("w"))
    bitmap = _bitmap(wanted)
    bits = F.lit(64) * F.size(bitmap)
    hashed = lambda k: lambda i: _hash(F.col("w"), i, k)
    spelled = lambda k: lambda i: F.struct(i.alias("pos"), F.concat_ws(" ", *[F.get("w", i + j) for j in range(k)]).alias("shingle"))
    for k in sizes:  # each array is stored before a lambda reads it by index
        places = F.when(F.size("w") >= k, F.sequence(F.lit(0), F.size("w") - k)).otherwise(F.array().cast("array<int>"))
        words = words.withColumn(f"h{k}", F.transform(places, hashed(k)))
    here = [F.filter(F.transform(f"h{k}", lambda h, i: F.when(_marked(bitmap, bits, h), i)), lambda i: i.isNotNull()) for k in sizes]
    found = F.concat(*[F.transform(p, spelled(k)) for p, k in zip(here, sizes, strict=True)]) if sizes else F.array().cast("array<struct<pos:int,shingle:string>>")
    exploded = words.select("key", F.size("w").alias("n"), F.explode(found).alias("f")).select("key", "n", "f.pos", "f.shingle")
    wanted = wanted.select("shingle")
    matches = materialise(exploded.join(broadcast_if_small(wanted), "shingle").groupBy("key", "n", "pos", "shingle").agg(F.count("*").alias("copies")), "shingle-matches")
    rarity = matches.groupBy("shingle").agg(F.sum("copies").alias("seen"))
    # a shingle may stand in a window twice; its first place is enough, for the others follow from it
    first = parts.groupBy("window", "len", "shingle").agg(F.min("pos").alias("at"))
    prefix = (
        first.join(rarity, "shingle", "left")
        .groupBy("window", "len")
        .agg(F.min_by(F.struct("shingle", "at"), F.struct(F.coalesce("seen", F.lit(0)), "shingle")).alias("x"))
        .select("window", "len", "x.shingle", "x.at")
    )
    prefix = broadcast_if_small(materialise(prefix, "prefix"))
    start = F.col("pos") - F.col("at")
    candidates = matches.join(prefix, "shingle").withColumn("start", start).filter((start >= 0) & (start + F.col("len") <= F.col("n"))).select("key", "window", "len", "start")
    spelled = candidates.join(broadcast_if_small(windows.select("window", "shingles").dropDuplicates(["window"])), "window")
    expected = spelled.select("key", "window", "len", "start", F.size("shingles").alias("need"), F.explode("shingles").alias("p"))
    expected = expected.select("key", "window", "len", "start", "need", (F.col("start") + F.col("p.pos")).alias("pos"), F.col("p.shingle").alias("shingle"))
    there = expected.join(matches.select("key", "pos", "shingle"), ["key", "pos", "shingle"])
    hits = there.groupBy("key", "window", "len", "start", "need").agg(F.count("*").alias("have")).filter("have = need")
    return hits.select("key", "window", "start", "len"), windows


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every document."""
    hits, windows = find_windows(docs, benchmark, window, shingle)
    hits = materialise(hits, "hits")
    covered = hits.select("key", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("p")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    owners = broadcast_if_small(windows.select("window", F.col("item_id").cast("string").alias("item")).distinct())
    items = hits.select("key", "window").distinct().join(owners, "window").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = broadcast_if_small(materialise(covered.join(items, "key", "left"), "found"))
    each = docs.select("doc_id", F.sha2(text_or_empty(), 256).alias("key"), F.size(item_words(text_or_empty())).cast("long").alias("n_words"))
    n_hit, listed = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return each.join(found, "key", "left").select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs whose text holds no window of any item, all columns as they were."""
    hits, _ = find_windows(docs, benchmark, window, shingle)
    keys = materialise(hits.select(F.col("key").alias("_key")).distinct(), "contaminated")
    keyed = docs.select(F.struct("*").alias("_row"), F.sha2(text_or_empty(), 256).alias("_key"))
    return keyed.join(broadcast_if_small(keys), "_key", "left_anti").select("_row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s + 1:s + 10], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT rid, s, sizes.n, array_to_string(w[s + 1:s + sizes.n], ' ') AS g
  FROM (SELECT rid, w, unnest(range(0, len(w))) AS s FROM d) x JOIN sizes ON s + sizes.n <= len(w)
), h AS (SELECT rid, s, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n
), c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM h) GROUP BY rid
), i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM h) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN i USING (rid)
"""
