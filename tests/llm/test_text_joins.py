import hashlib
import random
import re

import numpy as np

from fieldgrid.llm import bag_minhash, decontamination, suffix_dedup, suffix_kernel


def _words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def _brute_leaks(docs, items):
    windows = {}
    for i, t in items:
        w = _words(t)
        for s in range(max(len(w) - 10, 0) + 1) if w else ():
            windows.setdefault(tuple(w[s : s + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = _words(t), set(), set()
        for win, owners in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    found |= owners
        ids = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination_equals_brute_force(spark):
    g = random.Random(2)
    vocabulary = ["a", "B", "c1", "d", "É", "é"]
    text = lambda n: " ".join(g.choice(vocabulary) + g.choice(["", ",", "."]) for _ in range(n))
    items = [(1, text(25)), (10, text(12)), (2, "a b"), (3, "z"), (4, None), (5, "..."), (None, text(11)), (1, text(11)), (7, text(10))]
    docs = [(i, text(g.randint(0, 30)) + " " + g.choice(items)[1].__str__() + " " + text(3)) for i in range(40)]
    docs += [(50, None), (51, ""), (None, items[0][1]), (52, items[0][1].upper()), (52, items[0][1]), (53, "z " * 500)]
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.decontaminate(dd, ii).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(_brute_leaks(docs, items), key=key)
    kept = decontamination.clean(dd.selectExpr("*", "1 AS key", "2 AS _key2"), ii)
    assert kept.columns == ["doc_id", "text", "key", "_key2"]
    assert kept.count() == sum(not r[5] for r in got)


def test_no_items_leaves_all_clean(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontamination.decontaminate(docs, none).collect()] == [False]


def test_signatures_are_unbiased_and_do_not_depend_on_the_batch():
    rng, hashes, off = np.random.default_rng(1), bag_minhash.WordHashes(), []
    for _ in range(25):
        base = [f"w{i}" for i in rng.integers(0, 40, 90)]
        other = [w if rng.random() > 0.05 else f"z{rng.integers(99)}" for w in base]
        a, b = bag_minhash.bag(base, hashes), bag_minhash.bag(other, hashes)
        s = bag_minhash.signatures([a, b, bag_minhash.bag(["x"], hashes)], 512)
        assert (s[0] == bag_minhash.signature(*a, 512)).all()
        off.append((s[0] == s[1]).mean() - bag_minhash.overlap(a[0], b[0], a[1], b[1]))
    assert abs(np.mean(off)) < 0.015


def _near_copies(g):
    base = [[f"w{g.randint(0, 400)}" for _ in range(120)] for _ in range(6)]
    rows = []
    for k in range(90):
        w = list(base[k % 6])
        for _ in range(g.randint(0, 6)):
            w[g.randrange(len(w))] = f"e{g.randint(0, 9999)}"
        rows.append((k, " ".join(w)))
    return rows + [(100, rows[0][1].replace(" ", "\n")), (101, None), (102, ""), (103, "one two"), (104, "one  two"), (None, rows[7][1]), (0, rows[0][1])]


def _links(rows):
    hashes = bag_minhash.WordHashes()
    bags = [bag_minhash.bag(t.split(), hashes) if t and t.split() else None for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and bag_minhash.overlap(bags[i][0], bags[j][0], bags[i][1], bags[j][1]) >= 0.8:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def test_classes_equal_brute_force(spark):
    rows = _near_copies(random.Random(3))
    roots = _links(rows)
    want = sorted((str(d), str(min((rows[j][0] for j in range(len(rows)) if roots[j] == roots[i] and rows[j][0] is not None), default=None)), roots.count(roots[i])) for i, (d, _) in enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in bag_minhash.dedupe_classes(df).collect())
    assert got == want
    kept = bag_minhash.keep_one(df.selectExpr("*", "'x' AS node"))
    assert kept.columns == ["doc_id", "text", "node"] and kept.count() == len(set(roots))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"x", b"y")], "a binary, b binary")
    got = {bytes(r.node): bytes(r.root) for r in bag_minhash.components(edges).collect()}
    assert all(got[bytes([i])] == b"\x00" for i in range(1, 41)) and got[b"y"] == b"x"


def test_suffix_sort_orders_suffixes_and_finds_extensions():
    g = random.Random(4)
    data = np.frombuffer("".join(g.choice("ab") for _ in range(400)).encode(), np.uint8)
    start = np.array(sorted(g.sample(range(380), 120)))
    size = np.array([g.randint(1, 20) for _ in start])
    group = np.array([g.randint(0, 3) for _ in start])
    order, common = suffix_kernel.sorted_suffixes(data, start, size, group)
    raw = data.tobytes()
    rows = [(group[i], raw[start[i] : start[i] + size[i]]) for i in order]
    assert rows == sorted(rows)
    for k in range(1, len(rows)):
        (ga, a), (gb, b) = rows[k - 1], rows[k]
        n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b))) if ga == gb else 0
        assert common[k] == n


def _brute_repeats(rows, length):
    seen, out = {}, []
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] = seen.get(b[s : s + length], 0) + 1
    for i, b in texts:
        m = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                m[s : s + length] = b"\1" * length
        left = bytes(x for x, k in zip(b, m, strict=True) if not k)
        out.append((i, len(b), sum(m), sum(1 for k in range(len(m)) if m[k] and not (k and m[k - 1])), hashlib.sha256(left).hexdigest()))
    return out


def test_repeats_equal_brute_force_with_and_without_bands(spark):
    g = random.Random(5)
    rnd = lambda n: "".join(g.choice("abcdefgh") for _ in range(n))
    passages, rows = [rnd(60), rnd(45), rnd(150)], []
    for i in range(70):
        t = rnd(g.randint(0, 60))
        for _ in range(g.randint(0, 3)):
            p, a = g.choice(passages), g.randint(0, 20)
            t += p[a : a + g.randint(20, len(p))] + rnd(g.randint(0, 30))
        rows.append((i, t))
    rows += [(200, None), (201, ""), (None, rows[3][1]), (203, "ab" * 100), (204, "é" * 60), (205, rows[5][1]), (205, rows[5][1])]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = sorted(_brute_repeats(rows, 40), key=key)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for params in (suffix_dedup.Params(40, 8, 4, 3), suffix_dedup.Params(40, 8, 1000, 8)):
        found = suffix_dedup.cut_repeats(df, params).collect()
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found]
        assert sorted(got, key=key) == want
        left = {r.kept_sha256: bytes(r.bytes) for r in suffix_dedup.cut_repeats(df, params, raw=True).collect()}
        assert all(hashlib.sha256(b).hexdigest() == k for k, b in left.items())
        assert all(r.text == left[r.kept_sha256].decode("utf-8", "ignore") for r in found)


def test_repeats_of_no_documents_and_of_extra_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.cut_repeats(none).count() == 0
    rows = spark.createDataFrame([(1, "ab" * 300, b"x", 1), (2, None, None, 2)], "doc_id long, text string, bytes binary, key long")
    assert {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.cut_repeats(rows).collect()} == {1: (600, 600), 2: (0, 0)}


def test_anchors_cover_every_window_once_even_across_segments():
    data = np.frombuffer(random.Random(6).randbytes(3000), np.uint8)
    rows = np.concatenate(suffix_kernel.anchors(data, 100, 16, segment=700))
    covered = sorted(s + k for _, s, size, _ in rows for k in range(size - 100 + 1))
    assert covered == list(range(2901))


def test_one_row_of_each_class_stays_whatever_the_input_is(spark, tmp_path):
    rows = [(d, t, f"x{k}") for k, (d, t) in enumerate(_near_copies(random.Random(8)))]
    want = len(set(_links([r[:2] for r in rows])))
    made = spark.createDataFrame(rows, "doc_id long, text string, _n string")
    made.repartition(3).write.parquet(str(tmp_path / "docs"))
    plain = spark.read.parquet(str(tmp_path / "docs"))
    pages = spark.createDataFrame([(f"x{k}", k) for k in range(len(rows))], "_n string, _row long")
    for docs in (plain, plain.repartition(5), plain.join(pages, "_n"), plain.withColumn("_metadata", bag_minhash.F.lit(1))):
        kept = bag_minhash.keep_one(docs)
        assert kept.columns == docs.columns
        found = [r.asDict()["_n"] for r in kept.collect()]
        assert len(found) == len(set(found)) == want
        roots = _links([r[:2] for r in rows])
        assert len({roots[int(x[1:])] for x in found}) == want


def test_a_hot_group_without_its_base_is_linked_whole(spark):
    """Copies of one text, none of it unchanged: some are no link of any hub, and some of few others only."""
    g = random.Random(12)
    base, rows = [f"w{g.randint(0, 5000)}" for _ in range(120)], []
    for k in range(240):
        w = list(base)
        for _ in range(g.randint(1, 5)):
            w[g.randrange(len(w))] = f"e{g.randint(0, 12)}"
        rows.append((k, " ".join(w)))
    rows += [(500, None), (501, "one two"), (502, " ".join(base[:100]))]
    roots = _links(rows)
    got = {r.doc_id: r.class_id for r in bag_minhash.dedupe_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    least = {}
    for i, (d, _) in enumerate(rows):
        least[roots[i]] = min(d, least.get(roots[i], d))
    assert got == {d: least[roots[i]] for i, (d, _) in enumerate(rows)}
    assert len(set(got.values())) > 3


def test_empty_documents_have_no_classes(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bag_minhash.dedupe_classes(none).count() == 0 and bag_minhash.keep_one(none).count() == 0
