"""MinHash near-duplicates with weighted (bag) signatures.

A document is a bag of five-word shingles with multiplicities. Its signature has
``registers`` minima of Poisson processes: each shingle owns, for every dyadic
interval of its discretised weight ([0,1), [1,2), [2,4), ...), a process of
points whose rate is the interval's width; a point has a time, a register and a
level within the interval, and counts if the weight reaches its level. The
register minima of two bags agree with probability equal to their weighted
Jaccard similarity. Points are generated lazily: a document of total weight W
fills all registers by time about registers * (ln registers + c) / W, so nearly
all shingles are dismissed by their first point, and the limit is doubled in the
rare case that a register stays empty. Signatures are therefore cheap and exact.

Classes. Equal word sequences are one node (hot copies collapse in a map-side
aggregate). Registers are banded; a bucket's members are compared with its hub
first, the member that meets most others. Where a bucket still spans several
classes, its largest class stands for it: the shingles that at least half of
that class's bags hold are the class's consensus. Members of other classes are
compared with a few of the largest class's most central bags, and settle there
as a rule. For the rest links are found without making all pairs: two bags
overlap within the consensus by no more than the lesser of their parts in it, so
a link either has two parts in it that suffice, or shares shingles outside it.
The first kind is joined within buckets, the second on those shingles, rarest
first and as many as a link can't do without (a prefix filter). Both bounds are
exact, so the classes are exactly the connected components of the candidate
pairs that are links. Verification is the exact multiset overlap of the bags.

Rows are told apart by file and row index, or, where the input is no plain scan
of files, by those of a written copy; so a second reading meets the same rows.

Defined cases: texts without words are singletons; texts of fewer than five
words are one shingle; a null id takes part and the class id is the least id in
the class (null if it has none); repeated rows are one class; empty tables give
empty results; texts are hashed whole, whatever their length; other columns,
whatever their names, pass through ``keep_one``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldgrid.llm.common import broadcast_if_small, is_scan, materialise

SHINGLE = 5
#: Bags of a large class that all members of other classes in its buckets meet.
CENTRES = 4
#: What str.split() takes for white space beyond the six ASCII characters.
_OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


@dataclass(frozen=True)
class Params:
    bands: int = 25
    rows: int = 6
    threshold: float = 0.8

    @property
    def registers(self) -> int:
        return self.bands * self.rows


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """(0, 1] from the upper 53 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * (1.0 / 9007199254740992.0)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def bag(words: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, multiplicities) of a word sequence."""
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(len(h) - SHINGLE + 1, 1)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(SHINGLE, len(h))):
            out = mix(out * _GOLD + h[k : k + n])
    return np.unique(out, return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """Register minima of many bags at once, as 64-bit point names. The limits on time only decide which points are
    looked at; a bag with an empty register is done again with a doubled limit."""
    total = np.array([c.sum() for _, c in bags], dtype=np.float64)
    limit = registers * (np.log(registers) + 6.0) / total
    names = np.zeros((len(bags), registers), dtype=np.uint64)
    todo = np.arange(len(bags))
    with np.errstate(over="ignore"):
        while len(todo):
            live = np.concatenate([bags[d][0] for d in todo])
            weight = np.concatenate([bags[d][1] for d in todo])
            owner = np.repeat(np.arange(len(todo)), [len(bags[d][0]) for d in todo])
            best, found = np.full(len(todo) * registers, np.inf), np.zeros(len(todo) * registers, dtype=np.uint64)
            level = 0
            while len(live):
                low = 0 if level == 0 else 1 << (level - 1)
                width = 1 if level == 0 else low
                _points(live, weight, owner, low, width, level, limit[todo], registers, best, found)
                keep = weight > low + width
                live, weight, owner, level = live[keep], weight[keep], owner[keep], level + 1
            names[todo] = found.reshape(len(todo), registers)
            todo = todo[~np.isfinite(best.reshape(len(todo), registers)).all(axis=1)]
            limit[todo] *= 2
    return names


def signature(shingles: np.ndarray, counts: np.ndarray, registers: int) -> np.ndarray:
    return signatures([(shingles, counts)], registers)[0]


def _points(live, weight, owner, low, width, level, limit, registers, best, found) -> None:
    """Feed all points up to their bag's limit, of the processes of one dyadic interval, into the minima."""
    seed = mix(live + np.uint64(level + 1) * _GOLD)
    time = np.zeros(len(seed))
    while True:
        seed = mix(seed + _GOLD)
        time = time - np.log(_unit(seed)) / width
        near = np.flatnonzero(time <= limit[owner])
        if not len(near):
            return
        seed, time, weight, owner = seed[near], time[near], weight[near], owner[near]
        place = mix(seed ^ _M2)
        at = owner * registers + (place & np.uint64(0xFFFFFFFF)).astype(np.int64) % registers
        if width > 1 or low:
            counts = low + (place >> np.uint64(32)).astype(np.int64) % width < weight
            at, t, name = at[counts], time[counts], seed[counts]
        else:
            t, name = time, seed
        np.minimum.at(best, at, t)
        won = t == best[at]
        found[at[won]] = name[won]


def overlap(a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags given as sorted distinct hashes and counts."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[i], cb[j]).sum())
    return both / (int(ca.sum()) + int(cb.sum()) - both)


def _numbered(docs: DataFrame) -> DataFrame:
    """_row (all columns), doc_id, text and _n, a row's file (hashed) and place in it, the same at every reading."""
    if not is_scan(docs):
        docs = materialise(docs.select(F.struct("*").alias("_row")), "rows")
        row, at = F.col("_row"), lambda c: F.col(f"_row.{c}")
    else:
        row, at = F.struct("*"), F.col
    place = F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    return docs.select(row.alias("_row"), at("doc_id").cast("long").alias("doc_id"), at("text").cast("string").alias("text"), place.alias("_n"))


def _chunks(part: pa.RecordBatch, most: int = 400_000) -> Iterator[list[int]]:
    """Row numbers of a batch in runs whose texts have a bounded size together."""
    run, size = [], 0
    for i, text in enumerate(part.column("text")):
        run.append(i)
        size += text.as_buffer().size if text.is_valid else 0
        if size >= most or len(run) >= 512:
            yield run
            run, size = [], 0
    if run:
        yield run


def sketch(rows: DataFrame, params: Params) -> DataFrame:
    """rows(_n, doc_id, text) -> _n, doc_id, node (hash of the word sequence) and bands; the last two null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        salt = mix(np.arange(1, params.bands + 1, dtype=np.uint64))
        for batch in batches:
            for chosen in _chunks(batch):
                part = batch.take(pa.array(chosen))
                words = [t.split() if t else [] for t in map(_plain, part.column("text").to_pylist())]
                full = [i for i, w in enumerate(words) if w]
                nodes, bands = [None] * len(words), [None] * len(words)
                if full:
                    sig = signatures([bag(words[i], hashes) for i in full], params.registers).reshape(len(full), params.bands, params.rows)
                    with np.errstate(over="ignore"):
                        h = np.broadcast_to(salt, sig.shape[:2])
                        for k in range(params.rows):
                            h = mix(h * _GOLD + sig[:, :, k])
                    for i, row in zip(full, h.view(np.int64), strict=True):
                        nodes[i] = hashlib.blake2b(" ".join(words[i]).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                        bands[i] = row
                yield pa.RecordBatch.from_arrays([part.column("_n"), part.column("doc_id"), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["_n", "doc_id", "node", "bands"])

    return rows.select("_n", "doc_id", "text").mapInArrow(run, "_n struct<f:long,i:long>, doc_id long, node binary, bands array<long>")


def _plain(text: str | None) -> str | None:
    """Words are split at ASCII white space only; other white space is no border."""
    return text if text is None else _OTHER_SPACE.sub("\u0000", text)


def bags_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles and counts (bytes of sorted hashes) for wanted(node, _n): one row for each node."""
    texts = rows.select("_n", "text").join(broadcast_if_small(wanted), "_n").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for chosen in _chunks(batch):
                part = batch.take(pa.array(chosen))
                found = [bag(_plain(t).split(), hashes) for t in part.column("text").to_pylist()]
                counts = [b"" if (c == 1).all() else c.astype(np.uint32).tobytes() for _, c in found]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([s.tobytes() for s, _ in found], pa.binary()), pa.array(counts, pa.binary()), pa.array([int(c.sum()) for _, c in found], pa.int64())], names=["node", "shingles", "counts", "total"])

    return texts.mapInArrow(run, "node binary, shingles binary, counts binary, total long")


def similarities(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """pairs(a, b) with the exact weighted Jaccard similarity of their bags."""
    left = bags.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("counts").alias("ca"))
    right = bags.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("counts").alias("cb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def load(s: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
            h = np.frombuffer(s, np.uint64)
            return h, np.frombuffer(c, np.uint32).astype(np.int64) if c else np.ones(len(h), np.int64)

        for batch in batches:
            found = []
            for sa, ca, sb, cb in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                (x, cx), (y, cy) = load(sa, ca), load(sb, cb)
                found.append(overlap(x, y, cx, cy))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "ca", "sb", "cb").mapInArrow(run, "a binary, b binary, similarity double")


def shingle_rows(bags: DataFrame) -> DataFrame:
    """node, root, m, shingle and n (its multiplicity) for bags(node, root, m, shingles, counts)."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                h = [np.frombuffer(s, np.int64) for s in part.column(3).to_pylist()]
                n = [np.frombuffer(c, np.uint32).astype(np.int64) if c else np.ones(len(x), np.int64) for x, c in zip(h, part.column(4).to_pylist(), strict=True)]
                owner = pa.array(np.repeat(np.arange(len(h)), [len(x) for x in h]))
                own = [part.column(k).take(owner) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate(h)), pa.array(np.concatenate(n))], names=["node", "root", "m", "shingle", "n"])

    return bags.select("node", "root", "m", "shingles", "counts").mapInArrow(explode, "node binary, root binary, m long, shingle long, n long")


def _parts(sides: DataFrame, threshold: float) -> DataFrame:
    """sides(large, node, root, total, least, shared, consensus) with ``inner``, how much of the bag lies in the consensus,
    ``outer``, how much of it lies in shared shingles outside, and ``prefix``: the rarest of these, without those that a
    link may do without. ``shared`` holds (bags, shingle, n), rarest first; ``least`` is the group's least total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for total, least, shared, consensus in zip(*(batch.column(k).to_pylist() for k in ("total", "least", "shared", "consensus")), strict=True):
                shingle, n = np.array([x["shingle"] for x in shared], np.int64), np.array([x["n"] for x in shared], np.int64)
                inside = np.isin(shingle, np.array(consensus, np.int64))
                inner, rest, own = int(n[inside].sum()), shingle[~inside], n[~inside]
                need = max(_needed(total, least, threshold) - inner, 1)
                after = own[::-1].cumsum()[::-1]  # what stands at or behind each place
                rows.append((inner, int(own.sum()), rest[after >= need].tolist()))
            inner, outer, prefix = zip(*rows, strict=True) if rows else ((), (), ())
            kept = [batch.column(k) for k in ("large", "node", "root", "total")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(inner, pa.int64()), pa.array(outer, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))], names=["large", "node", "root", "total", "inner", "outer", "prefix"])

    return sides.mapInArrow(run, "large binary, node binary, root binary, total long, inner long, outer long, prefix array<long>")


def _needed(a, b, threshold: float):
    """The least overlap of a link between bags of totals a and b >= ``b``: t / (1 + t) of both, and t of the larger one."""
    both = (a + b) * (threshold / (1 + threshold)) - 1e-6
    return F.greatest(both, a * F.lit(threshold) - 1e-6) if isinstance(a, Column) else max(both, a * threshold - 1e-6)


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, root: the least node of its component, by alternating large and small stars.
    Each round is written to the shared folder; the number of rounds grows with the logarithm of the size."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = materialise(both.filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        # large star: larger neighbours move to the least neighbour
        least = now.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = now.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: each node has smaller neighbours only; they and the node move to the least of them
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(small.select("a", F.col("m").alias("b"))).distinct()
        moved = materialise(moved, "stars")
        now = moved.union(moved.select(F.col("b").alias("a"), F.col("a").alias("b")))
        seen = moved.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            break
        mark = seen
    return moved.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(rows: DataFrame, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(sketched rows, node -> root for every node that is linked to another one)."""
    sketched = materialise(sketch(rows, params), "sketches")
    # equal word sequences give equal rows; a hot copy is reduced before it travels
    nodes = sketched.filter(F.col("node").isNotNull()).groupBy("node").agg(F.first("bands").alias("bands"), F.min("_n").alias("_n"))
    nodes = materialise(nodes, "nodes")
    members = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    shared = members.groupBy("band", "h").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialise(members.join(shared, ["band", "h"]), "buckets")
    # a bucket's hub: the member that meets most others over all its bands, so the middle of a group of near copies
    meets = members.groupBy("node").agg(F.sum("n").alias("meets"))
    hubs = members.drop("n").join(meets, "node").groupBy("band", "h").agg(F.max_by("node", F.struct("meets", "node")).alias("hub"))
    buckets = materialise(members.drop("n").join(hubs, ["band", "h"]), "hubs")
    bags = materialise(bags_of(rows, nodes.select("node", "_n").join(meets, "node", "left_semi")), "bags")
    first = buckets.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    spokes = materialise(similarities(first, bags), "spokes")
    roots = components(spokes.filter(F.col("similarity") >= params.threshold))
    links = _links_across(buckets, roots, bags, params)
    if links is None:
        return sketched, roots
    return sketched, components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))


def _rooted(df: DataFrame, roots: DataFrame, node: str, name: str) -> DataFrame:
    """df with the root of its column ``node``; a node without links is its own root."""
    found = roots.select(F.col("node").alias(node), F.col("root").alias("_found"))
    return df.join(found, node, "left").withColumn(name, F.coalesce("_found", node)).drop("_found")


def _links_across(buckets: DataFrame, roots: DataFrame, bags: DataFrame, params: Params) -> DataFrame | None:
    """All links (a, b) between different classes that meet in a bucket, but for some that others imply; None if there are none."""
    t = params.threshold
    labelled = _rooted(buckets, roots, "node", "root")
    sizes = labelled.groupBy("band", "h", "root").agg(F.count("*").alias("n"))
    spread = sizes.groupBy("band", "h").agg(F.max_by("root", F.struct("n", "root")).alias("large"), F.count("*").alias("k")).filter("k > 1").select("band", "h", "large")
    open_ = materialise(labelled.filter("node <> hub").join(spread, ["band", "h"]).select("band", "h", "node", "root", "large"), "open-buckets")
    if open_.isEmpty():
        return None
    members = open_.select("node", "root").distinct()
    members = members.join(members.groupBy("root").agg(F.count("*").alias("m")), "root")
    involved = bags.join(members, "node")
    rows = shingle_rows(involved)
    counts = materialise(rows.groupBy("root", "shingle").agg(F.count("*").alias("k"), F.max("m").alias("m")), "shingle-counts")
    seen = counts.groupBy("shingle").agg(F.sum("k").alias("bags")).filter("bags > 1")
    shared = rows.join(seen, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("bags", "shingle", "n"))).alias("shared"), F.sum("n").alias("mass"))
    # what a bag has in common with others is at least t of it, or it has no link
    able = materialise(shared.join(involved.select("node", "total"), "node").filter(F.col("mass") >= t * F.col("total") - 1e-6).drop("mass"), "shared-bags")
    sides = open_.select("large", "node", "root").distinct().join(able, "node")
    wanted = sides.groupBy("large").agg(F.min("total").alias("least"))
    consensus = counts.filter("2 * k >= m").select(F.col("root").alias("large"), "shingle").join(wanted, "large", "left_semi")
    consensus = materialise(consensus.groupBy("large").agg(F.collect_list("shingle").alias("consensus")), "consensus")
    # a large class may have no member in its open buckets but the hubs, which have met everyone there; then it has no consensus
    sides = materialise(_parts(sides.join(wanted, "large").join(consensus, "large", "left").withColumn("consensus", F.coalesce("consensus", F.array().cast("array<long>"))), t), "sides")
    # the most central bag of each of CENTRES parts of the large class meets all members of other classes
    own = sides.filter("root = large").join(consensus.select("large", F.size("consensus").alias("size")), "large")
    middle = F.struct((F.col("inner") / (F.col("size") + F.col("total") - F.col("inner"))).alias("s"), "node")
    centres = own.groupBy("large", F.pmod(F.xxhash64("node"), F.lit(CENTRES)).alias("part")).agg(F.max_by("node", middle).alias("centre"))
    odd = sides.filter("root <> large").select("large", "node")
    first = materialise(similarities(odd.join(centres, "large").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), bags).filter(F.col("similarity") >= t).select("a", "b"), "central-links")
    central = not first.isEmpty()
    if central:
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(first))
    sides = _rooted(_rooted(sides.drop("root"), roots, "node", "root"), roots, "large", "top")
    sides = materialise(sides.withColumn("odd", F.col("root") != F.col("top")), "settled-sides")
    names = ("node", "root", "total", "inner", "outer")
    side = lambda k, *more: [F.col(c).alias(f"{c}_{k}") for c in names + more]
    once = (F.col("root_x") != F.col("root_y")) & (~F.col("odd_y") | (F.col("node_x") < F.col("node_y")))
    need = _needed(F.greatest("total_x", "total_y"), F.least("total_x", "total_y"), t)
    inside = F.least("inner_x", "inner_y")
    near = materialise(open_.select("band", "h", "large", "node").join(sides.filter(F.col("inner") >= t * F.col("total") - 1e-6).drop("prefix"), ["large", "node"]), "near-centre")
    x, y = near.filter("odd").select("band", "h", *side("x")), near.select("band", "h", *side("y", "odd"))
    direct = x.join(y, (x.band == y.band) & (x.h == y.h) & once & (inside >= need)).select("node_x", "node_y")
    spread_ = materialise(sides.select("large", *names, "odd", F.explode("prefix").alias("shingle")), "prefixes")
    x, y = spread_.filter("odd").select("large", "shingle", *side("x")), spread_.select("large", "shingle", *side("y", "odd"))
    outside = x.join(y, (x.large == y.large) & (x.shingle == y.shingle) & once & (inside + F.least("outer_x", "outer_y") >= need)).select("node_x", "node_y")
    pairs = direct.union(outside).select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()
    more = materialise(similarities(pairs, bags).filter(F.col("similarity") >= t).select("a", "b"), "more-links")
    found = first.union(more) if central else more
    return None if found.isEmpty() else found


def dedupe_classes(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id and class_id (least id of the class) for every document, and the class's size."""
    sketched, roots = classes(_numbered(docs), params)
    singles = sketched.filter(F.col("node").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    named = materialise(_rooted(sketched.filter(F.col("node").isNotNull()).select("doc_id", "node"), roots, "node", "root").select("doc_id", "root"), "membership")
    ids = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return named.join(materialise(ids, "class-ids"), "root").select("doc_id", "class_id", "class_size").unionByName(singles)


def keep_one(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """One row of docs per class, the one with the least id (ties: any one), all columns as they were;
    rows without words all stay. Rows are chosen by a small aggregate over ids and row numbers."""
    rows = _numbered(docs)
    sketched, roots = classes(rows, params)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_n")
    rooted = _rooted(sketched.filter(F.col("node").isNotNull()).select("doc_id", "node", "_n"), roots, "node", "root")
    chosen = rooted.groupBy("root").agg(F.min(order).alias("o"))
    gone = rooted.select("_n").join(chosen.select(F.col("o._n").alias("_n")), "_n", "left_anti")
    gone = materialise(gone, "dropped")
    return rows.select("_row", "_n").join(broadcast_if_small(gone), "_n", "left_anti").select("_row.*")
