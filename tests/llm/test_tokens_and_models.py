import random
import textwrap
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldgrid.llm import licenses, packing, queries, rule_ensemble, token_rollup
from fieldgrid.llm.tokens import ByteBpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_tokenizer():
    g, plain, mine = random.Random(1), _plain(), ByteBpe(PATH)
    assert mine.fast
    bits = [" ", "  ", "\n", "\t", "a", "The", " é", "\u00a0", "\u2003", "12", "!", "<|endoftext|>", "don't", "\r\n", "漢字", "\x1c", "ß", "Œ", "\x85", "²", "…", "aaaa" * 40, "\x00"]
    texts = ["", " ", "  a", "a  ", "a \n", "\n \nb", " a b"] + ["".join(g.choice(bits) for _ in range(g.randint(1, 40))) for _ in range(600)]
    for t in texts:
        assert mine.encode(t) == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_is_an_exact_round_trip(spark):
    g = random.Random(2)
    rows = [(i, " ".join(g.choice(["alpha", "beta,", "gamma"]) for _ in range(g.choice([0, 3, 40, 900, 4000])))) for i in range(60)] + [(None, None), (60, ""), (1, "twin")]
    pieces = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    plain, want = _plain(), []
    for i, t in rows:
        want.append((i is None, i or 0, [*plain.encode(t or "", add_special_tokens=False).ids, 1]))
    by_doc = {}
    for p in pieces:
        by_doc.setdefault((p.doc_id is None, p.doc_id or 0, p.doc_tokens), []).append(p)
    assert sum(p.length for p in pieces) == sum(len(x[2]) for x in want)
    for none, i, ids in want:
        own = sorted(by_doc[(none, i, len(ids))], key=lambda p: p.start)
        starts = {p.start: p for p in own}
        at = 0
        while at < len(ids):
            p = starts[at]
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0 and p.segments == len(s) <= 8 and p.loss_tokens == p.length - 1
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def _packed(lengths, capacity):
    packer = packing._Packer(0, capacity)
    packer.add(list(enumerate(lengths)))
    packer.finish()
    found, covered = {}, {}
    for doc, start, n, sequence, at, segments in packer.out:
        found.setdefault(sequence, []).append((at, n, segments))
        covered.setdefault(doc, []).append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, k in sorted(covered[doc]):
            assert start == at and k > 0
            at += k
        assert at == n
    for parts in found.values():
        at = 0
        for place, n, segments in sorted(parts):
            assert place == at and segments == len(parts) <= capacity.segments
            at += n
        assert at <= capacity.tokens and at - len(parts) <= capacity.loss and (at == capacity.tokens or at & (at - 1) == 0)
    return found, covered


def test_each_limit_of_cut_documents_binds():
    g = random.Random(6)
    mixed = [g.choice([1, 3, 20, 200, 700, 3000]) for _ in range(400)]
    free, _ = _packed(mixed, packing.Capacity(2048, 2048, 2047))
    tight, covered = _packed(mixed, packing.Capacity(2048, 8, 2047))
    assert max(len(p) for p in free.values()) > 8 == max(len(p) for p in tight.values())  # segments
    short = [5] * 300
    tight, _ = _packed(short, packing.Capacity(2048, 8, 2047))
    loose, _ = _packed(short, packing.Capacity(2048, 2048, 2047))
    assert max(sum(n for _, n, _ in p) for p in tight.values()) <= 40 < 1024 <= max(sum(n for _, n, _ in p) for p in loose.values())
    less, _ = _packed(mixed, packing.Capacity(2048, 8, 511))  # loss-bearing tokens
    assert max(sum(n - 1 for _, n, _ in p) for p in less.values()) <= 511
    # documents that fit whole are seldom cut where longer ones are there to be cut
    whole = [n for n in mixed if n < 2048]
    assert sum(len(covered[d]) > 1 for d, n in enumerate(mixed) if n < 2048) < 0.2 * len(whole)


def test_packing_of_any_lengths_is_gapless():
    g = random.Random(7)
    for _ in range(60):
        _packed([g.choice([1, 2, 7, 64, 100, 2047, 2048, 2049, 5000]) for _ in range(g.randint(1, 60))], packing.Capacity(2048, g.choice([1, 2, 3, 8]), 2047))


def test_conversations_become_examples_of_which_answers_bear_loss(spark):
    turns = [(1, 0, "user", "Hello there"), (1, 1, "assistant", "Yes"), (2, 0, "assistant", None), (None, 0, "user", "x"), (None, 0, None, "")]
    got = packing.instruction_examples(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")).collect()
    n = lambda t: len(_plain().encode(t or "", add_special_tokens=False).ids) + 1
    assert {r.id: (r.tokens, r.loss_tokens) for r in got} == {1: (n("Hello there") + n("Yes"), n("Yes")), 2: (1, 1), None: (n("x") + 1, 0)}


def test_whole_examples_respect_all_limits(spark):
    g = random.Random(3)
    rows = [(i, g.randint(1, 900), g.randint(0, 300)) for i in range(200)] + [(900, 5000, 1), (901, None, None)]
    cap = packing.Capacity(1000, 4, 500)
    got = packing.pack(spark.createDataFrame(rows, "id long, tokens long, loss_tokens long").coalesce(1), cap).collect()
    assert sorted(r.id for r in got) == sorted(r[0] for r in rows)
    size, bins = {r[0]: (r[1] or 0, r[2] or 0) for r in rows}, {}
    for r in got:
        if r.sequence_id is not None:
            bins.setdefault(r.sequence_id, []).append(size[r.id])
    assert [r.id for r in got if r.sequence_id is None] == [900]
    assert all(sum(t for t, _ in b) <= 1000 and len(b) <= 4 and sum(x for _, x in b) <= 500 for b in bins.values())
    assert len(bins) <= 1.25 * max(sum(t for t, _ in size.values()) - 5000, 0) / 1000 + 60


def test_rollup_is_idempotent_and_signed(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", "s", "en"), (2, "d", None, "en"), (3, None, "s", None), (4, "", "s", "en")], "doc_id long, text string, source string, lang string")
    roll = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    assert roll.totals().collect() == []
    one = token_rollup.inserts(docs, F.lit(5), "v1")
    assert roll.commit("a", one) and not roll.commit("a", one)
    one.write.parquet(str(tmp_path / "r" / "draft-dead"))  # what a writer that died leaves behind
    assert roll.commit("b", token_rollup.deletes(docs.filter("doc_id = 2"), F.lit(5), "v1"))
    assert roll.commit("c", token_rollup.revisions(docs.filter("doc_id = 1"), F.lit(5), F.lit(9), "v1"))
    want = {("s", "en"): (2, 14), ("s", None): (1, 5)}
    for _ in range(2):
        assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in roll.totals().collect()} == want
        roll.compact()
    assert not roll.commit("a", one) and roll.commit("dead", one) and roll.committed() == {"a", "b", "c", "dead"}


def test_rollup_below_any_folder_and_with_any_id(spark, tmp_path):
    one = spark.createDataFrame([("s", "en", "v", 1, 5)], token_rollup.SCHEMA)
    roll = token_rollup.TokenRollup(spark, str(tmp_path / "base-1" / "batch-runs" / "r"))
    for batch in ("2024/01 a%b", "batch-x", "base-1"):
        assert roll.commit(batch, one) and not roll.commit(batch, one)
        roll.compact()
        assert not roll.commit(batch, one)
    assert roll.committed() == {"2024/01 a%b", "batch-x", "base-1"}
    assert [(r.n_docs, r.n_tokens) for r in roll.totals().collect()] == [(3, 15)]
    # a second writer of the same id, who saw none, loses the race and leaves nothing
    one.write.parquet(f"{roll.path}/draft-late")
    one.write.parquet(f"{roll.path}/batch-late")
    assert not roll._publish("draft-late", "batch-late") and roll._names("draft") == []
    none = spark.createDataFrame([], token_rollup.SCHEMA)
    assert roll.commit("nothing", none) and {r.n_docs for r in roll.totals().collect()} == {4}


def test_corpus_totals_equal_direct_counts(spark, tmp_path):
    docs = [(1, "Hello there  world", "s", "en"), (2, "Hello", "s", "en"), (3, None, "s", "en"), (4, "é", None, "fr")]
    got = token_rollup.load_corpus(spark, spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), str(tmp_path / "x")).collect()
    n = lambda t: len(_plain().encode(t, add_special_tokens=False).ids)
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in got} == {("s", "en"): (2, n(docs[0][1]) + n("Hello")), (None, "fr"): (1, n("é"))}


def test_query_counts_documents_without_tokens(spark, tmp_path):
    docs = [(1, "Hello", "s", "en"), (2, None, "s", "en"), (3, "", "s", "en"), (4, "", "bare", "en"), (5, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op4_token_counts(spark, str(tmp_path)).collect()
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in got} == {("s", "en"): (3, 1), ("bare", "en"): (1, 0), (None, None): (1, 0)}


def test_licenses_are_told_apart(spark):
    rows = [
        (1, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore."),
        (2, "x. Licensed under CC BY-NC 4.0. Then words"),
        (3, "Licensed under CC BY 4.0."),
        (4, "Released under the MIT license"),
        (5, "Licensed under the GNU General Public License, version 3.\n\nAll rights reserved."),
        (6, "The licence of poets is wide."),
        (7, None),
        (8, ""),
        (None, "plain words"),
        (9, "word " * 50000 + "\nReleased under the MIT License."),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: list(r.licenses) for k, r in got.items()} == {1: ["Apache-2.0"], 2: ["CC-BY-NC-4.0"], 3: ["CC-BY-4.0"], 4: ["MIT"], 5: ["GPL-3.0", "Proprietary"], 6: [], 7: [], 8: [], None: [], 9: ["MIT"]}
    assert got[1].n_exact == 1 and got[6].n_blocks == 1 and got[7].n_blocks == 0
    assert got[1].best_saving > 0.3


def test_every_template_finds_itself():
    s = licenses.Scanner()
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            found = s.identify(t)
            assert [n for n, _, d in found if d == 0] == [name], (name, t, found)


def test_every_license_of_a_block_is_found():
    s, short = licenses.Scanner(), [(n, t) for n, ts in licenses.TEMPLATES.items() for t in ts if len(t) < 90]
    for a, x in short:
        for b, y in short:
            for between in ("\n", " "):
                found = s.identify(x + between + y)
                assert {n for n, _, d in found if d == 0} == {a, b} == {n for n, _, _ in found}, (x, y, found)
    every = "\n".join(t for ts in licenses.TEMPLATES.values() for t in ts)
    assert {n for n, _, d in s.identify(every) if d == 0} == set(licenses.TEMPLATES)
    five = ["Released under the MIT License.", "Licensed under CC BY-SA 4.0.", "Licensed under the GNU Affero General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "All rights reserved."]
    assert [n for n, _, _ in s.identify("\n".join(five))] == ["AGPL-3.0", "Apache-2.0", "CC-BY-SA-4.0", "MIT", "Proprietary"]
    assert [(n, d) for n, _, d in s.identify("the of Released openly under the MIT License. the under")] == [("MIT", 1)]


def test_wrapped_licenses_are_whole():
    s = licenses.Scanner()
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            for width in (20, 41, 72, 80):
                for mark in ("", " * "):
                    lines = textwrap.wrap("Copyright 2020 Some Body. " + t, width)
                    text = "\n".join(mark + x for x in ["word " * 200, *lines, "", "int main() {", "}", "word " * 200])
                    found = [h for b in licenses.blocks_of(text) for h in s.identify(b)]
                    assert [(n, d) for n, _, d in found] == [(name, 0)], (text, found)
    mit = "Copyright (c) 2020 X\nAll rights reserved.\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\n"
    assert sorted(n for b in licenses.blocks_of(mit) for n, _, _ in s.identify(b)) == ["MIT", "Proprietary"]
    far = "All rights reserved.\n" + "word " * 500 + "\nReleased under the MIT License."
    assert len(licenses.blocks_of(far)) == 2 and licenses.blocks_of("plain words") == []


def test_versions_and_kinds_are_told_apart():
    s = licenses.Scanner()
    clauses = licenses.BSD_2.replace(": Redis", ":\n\n1. Redis").replace(". Redis", ".\n\n2. Redis")
    cases = {
        "Licensed under the GNU Lesser General Public License, version 2.1.": ["LGPL-2.1"],
        "Licensed under the GNU Affero General Public License, version 3.": ["AGPL-3.0"],
        "Licensed under the GNU General Public License, version 4.": [],
        "Licensed under CC BY-NC-ND 4.0.": ["CC-BY-NC-ND-4.0"],
        "Licensed under CC BY 3.0.": [],
        "Copyright 1999 A. B.\n" + clauses: ["BSD-2-Clause"],
        "Copyright 1999 A. B.\n" + clauses + "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": ["BSD-3-Clause"],
        licenses.BSD + ".": ["BSD"],
        "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.": ["GPL-2.0"],
        "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007": ["GPL-3.0"],
    }
    for text, want in cases.items():
        assert sorted({n for b in licenses.blocks_of(text) for n, _, _ in s.identify(b)}) == want, text


def test_tags_name_licenses(spark):
    rows = [(1, "// SPDX-License-Identifier: MIT\nint x;"), (2, "/* SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 OR Apache-2.0) */"), (3, "SPDX-License-Identifier: BSD-3-Clause and more words"), (4, "SPDX-License-Identifier:")]
    got = {r.doc_id: (list(r.licenses), r.n_tags) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (["MIT"], 1), 2: (["Apache-2.0", "GPL-2.0-only"], 2), 3: (["BSD-3-Clause"], 1), 4: ([], 0)}
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_classifier_learns_and_takes_odd_rows(spark):
    g = random.Random(4)
    words = ["river", "stone", "and", "the", "Window.", "light", "over,"]
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        rows.append((i, " ".join(g.choice(words) for _ in range(g.randint(20, 60))) if good else " ".join(g.choice(words).upper() + "!!" for _ in range(30))))
        labels.append((i, int(good), 0))
    rows += [(None, None), (1000, ""), (3, "twin")]
    labels += [(None, 1, 0), (5, None, 0)]
    out = rule_ensemble.classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth and r.doc_id != 3]
    assert held and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_classifier_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in rule_ensemble.classify(docs, none).collect()] == [0.5, 0.5]
