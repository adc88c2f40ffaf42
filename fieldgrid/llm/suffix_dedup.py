"""Removal of repeated byte strings by a sparse, hash-compared suffix sort.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere
else in the corpus. Every such window is filed under an anchor: the leftmost
least hash of the grams in it, which depends on the window alone. Neighbouring
windows with the same anchor form a run, so the corpus is described by about
one row per (length / 2) bytes: (g, the gram's hash; c, the digest of the run's bytes).

1. Runs are counted by (g, c) and by g; c is a 128-bit BLAKE2b digest, so runs
   with one c are taken for equal without a look at their bytes. A gram that occurs once holds no repeats;
   runs whose bytes occur twice are repeated in full; what is left are runs that
   share a gram with different runs.
2. Those runs' bytes (one copy of each) are fetched by joining their places with
   the texts, and within a gram the suffixes from the gram on, and the reversed
   prefixes before it, are mergesorted by common extensions of prefix polynomial
   hashes (see suffix_kernel); classes of both orders give the repeated windows.
3. A gram with more than ``max_group`` different runs is never gathered in one
   task: its windows are split into ``fan`` bands, each filed under the longer
   string that all its windows share, and the same steps follow on those, down to
   single windows, where equal bytes are counted and nothing is left to compare.
4. Intervals are joined with the texts, merged and cut out.

Counting is by map-side sums, and a hot passage collapses into one row per task;
joins on hot keys are plain joins that adaptive skew handling can split.

Defined cases: null texts count as empty and keep the hash of nothing; equal
texts share their intervals; null or repeated ids are allowed, each row is
answered; texts shorter than ``length`` keep everything; empty tables give empty
results; long texts are processed in segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldgrid.llm import suffix_kernel as kernel
from fieldgrid.llm.common import materialise

RUNS = "key binary, g long, c binary, start long, size long, mark long"
TEXTS = "g long, c binary, low long, high long, mark long, bytes binary"


@dataclass(frozen=True)
class Params:
    length: int = 400
    gram: int = 32
    max_group: int = 256
    fan: int = 8


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select("doc_id", F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("key"), text.alias("bytes"))


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=names)


def runs(texts: DataFrame, params: Params) -> DataFrame:
    """All runs of windows of texts(key, bytes)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, digests, rows = [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    raw = memoryview(text.as_buffer())
                    for found in kernel.anchors(np.frombuffer(raw, np.uint8), params.length, params.gram):
                        rows.append(found)
                        keys += [key] * len(found)
                        digests += [hashlib.blake2b(raw[a : a + n], digest_size=16).digest() for _, a, n, _ in found.tolist()]
                if rows:
                    g, start, size, mark = np.concatenate(rows).T
                    yield _batch([pa.array(keys, pa.binary()), pa.array(g), pa.array(digests, pa.binary()), pa.array(start), pa.array(size), pa.array(mark)], ["key", "g", "c", "start", "size", "mark"])

    long_enough = texts.filter(F.octet_length("bytes") >= params.length).select("key", "bytes")
    return long_enough.mapInArrow(cut, RUNS)


def _census(rows: DataFrame) -> DataFrame:
    """g, c, n (runs with these bytes), d (different runs of the gram), for grams that occur twice at least."""
    pairs = materialise(rows.groupBy("g", "c").agg(F.count("*").alias("n")), "run-counts")
    grams = materialise(pairs.groupBy("g").agg(F.sum("n").alias("total"), F.count("*").alias("d")).filter("total > 1").select("g", "d"), "gram-counts")
    return pairs.join(grams, "g")


def _fetch(texts: DataFrame, places: DataFrame) -> DataFrame:
    """The bytes of runs(key, g, c, start, size, mark, low, high), from one copy of each text: a hot text is one row a task."""
    texts = texts.groupBy("key").agg(F.first("bytes").alias("bytes"))
    wanted = places.groupBy("key").agg(F.collect_list(F.struct("g", "c", "start", "size", "mark", "low", "high")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for text, listed in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    rows += [(r["g"], r["c"], r["low"], r["high"], r["mark"], text[r["start"] : r["start"] + r["size"]]) for r in listed]
                if rows:
                    g, c, low, high, mark, cuts = zip(*rows, strict=True)
                    yield _batch([pa.array(g, pa.int64()), pa.array(c, pa.binary()), *(pa.array(x, pa.int64()) for x in (low, high, mark)), pa.array(cuts, pa.binary())], ["g", "c", "low", "high", "mark", "bytes"])

    return texts.join(wanted, "key").select("bytes", "runs").mapInArrow(cut, TEXTS)


def _compare(texts: DataFrame, params: Params) -> DataFrame:
    """g, c, first, last: the repeated part of each run, for groups of bounded size."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[int, bytes], tuple[int, bytes]] = {}
        for batch in batches:
            g, c, mark, cuts = (batch.column(k).to_pylist() for k in range(4))
            rows.update(zip(zip(g, c, strict=True), zip(mark, cuts, strict=True), strict=True))  # copies of a text bring a run again
        names = sorted(rows)
        at = 0
        while at < len(names):  # whole groups, a bounded number of runs at a time
            end = min(at + 8192, len(names))
            while end < len(names) and names[end][0] == names[end - 1][0]:
                end += 1
            part = names[at:end]
            first, last = kernel.repeated_runs(np.array([x[0] for x in part]), [rows[x][1] for x in part], np.array([rows[x][0] for x in part]), params.length)
            hit = np.flatnonzero(first >= 0)
            if len(hit):
                yield _batch([pa.array([part[i][0] for i in hit]), pa.array([part[i][1] for i in hit], pa.binary()), pa.array(first[hit]), pa.array(last[hit])], ["g", "c", "first", "last"])
            at = end

    return texts.select("g", "c", "mark", "bytes").repartition("g").mapInArrow(sort, "g long, c binary, first long, last long")


def _bands(texts: DataFrame, params: Params) -> DataFrame:
    """Split the windows of each run into bands: rows of the band with the run (g0, c0) and the band's place in it.

    low and high bound how far windows of the gram reach before the mark; bands divide that reach, not the run's own,
    so equal windows of different runs are in one band. All windows of a band hold the bytes that name it."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for g, c, low, high, mark, cut in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                step = -(-(high - low + 1) // params.fan)
                for lo in range(low, high + 1, step):
                    hi = min(lo + step - 1, high)
                    own_lo, own_hi = max(lo, params.length - (len(cut) - mark)), min(hi, mark)
                    if own_lo > own_hi:
                        continue
                    core, span = cut[mark - lo : mark - hi + params.length], cut[mark - own_hi : mark - own_lo + params.length]
                    name = hashlib.blake2b(core, digest_size=8, salt=f"{lo},{hi}".encode(), key=f"{g}".encode()).digest()
                    content = hashlib.blake2b(span, digest_size=16, salt=f"{own_lo},{own_hi}".encode()).digest()
                    rows.append((g, c, mark - own_hi, int.from_bytes(name, "little", signed=True), content, lo, hi, own_hi, span))
            if rows:
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield _batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["g0", "c0", "at", "g", "c", "low", "high", "mark", "bytes"])

    return texts.select("g", "c", "low", "high", "mark", "bytes").mapInArrow(split, "g0 long, c0 binary, at long, " + TEXTS)


def _solve(texts: DataFrame, params: Params) -> DataFrame:
    """g, c, first, last for texts(g, c, low, high, mark, bytes): the repeated part of each run whose bytes occur once."""
    sizes = texts.select("g", "c").distinct().groupBy("g").agg(F.count("*").alias("d"))
    large = materialise(sizes.filter(F.col("d") > params.max_group).select("g"), "large-groups")
    if large.isEmpty():
        return _compare(texts, params)
    done = _compare(texts.join(large, "g", "left_anti"), params)
    bands = materialise(_bands(texts.join(large, "g", "left_semi").dropDuplicates(["g", "c"]), params), "bands")
    census = materialise(_census(bands), "band-census")
    again = bands.join(census.filter("d > 1"), ["g", "c"], "left_semi").select("g", "c", "low", "high", "mark", "bytes").dropDuplicates(["g", "c"])
    deeper = _solve(materialise(again, "band-texts"), params).join(census.filter("n = 1").select("g", "c"), ["g", "c"], "left_semi")
    whole = census.filter("n > 1").select("g", "c", F.lit(0).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    found = materialise(whole.unionByName(deeper), "band-runs")
    hits = bands.select("g0", "c0", "at", "g", "c", F.octet_length("bytes").cast("long").alias("size")).join(found, ["g", "c"])
    merged = hits.groupBy("g0", "c0").agg(F.min(F.col("at") + F.col("first")).alias("first"), F.max(F.col("at") + F.coalesce("last", "size")).alias("last"))
    return done.unionByName(merged.select(F.col("g0").alias("g"), F.col("c0").alias("c"), "first", "last"))


def repeated_intervals(texts: DataFrame, params: Params = Params()) -> DataFrame:
    """key, spans(first, last): the repeated byte intervals of texts(key, bytes), not yet merged."""
    marks = materialise(runs(texts, params), "runs")
    places = materialise(marks.join(materialise(_census(marks), "census"), ["g", "c"]), "places")
    one = F.min(F.struct("key", "start", "size", "mark")).alias("o")
    wanted = places.filter("d > 1").groupBy("g", "c").agg(one).select("g", "c", "o.*", F.lit(0).cast("long").alias("low"), F.lit(params.length - params.gram).cast("long").alias("high"))
    solved = materialise(_solve(materialise(_fetch(texts, wanted), "run-texts"), params), "solved")
    whole = places.filter("n > 1").select("key", F.col("start").alias("first"), (F.col("start") + F.col("size")).alias("last"))
    part = places.filter("n = 1 AND d > 1").join(solved, ["g", "c"]).select("key", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))
    return whole.unionByName(part).distinct().groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in sorted((s["first"], s["last"]) for s in spans or ()):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def cut_repeats(docs: DataFrame, params: Params = Params(), raw: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and what is left of every document: ``text`` without the parts of
    characters that a border cuts, or with ``raw`` all remaining ``bytes``."""
    texts = _keyed(docs)
    spans = materialise(repeated_intervals(texts, params), "spans")
    name, kind = ("bytes", "binary") if raw else ("text", "string")
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, {name} {kind}"
    types = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), (name, pa.binary() if raw else pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for name, text, listed in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    gone, kept, end = _merged(listed), [], 0
                    for a, b in gone:
                        kept.append(text[end:a])
                        end = b
                    left = b"".join([*kept, text[end:]])
                    rows.append((name, len(text), len(text) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left if raw else left.decode("utf-8", "ignore")))
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

    return texts.join(spans, "key", "left").select("doc_id", "bytes", "spans").mapInArrow(cut, schema)
