"""The numbered operators against SQL or brute force, and on odd tables."""

import base64
import hashlib
import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter
from unittest.mock import patch

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from __spark_entry__ import oracle_sql, queries
from check import compare
from ledgerloom.llm import (
    column_bwt, impact_index, license_rules, near_dedup, pow2_pack, quality_sketch, source_mix, spans, superkmer, toxicity, warc_store,
)
from ledgerloom.llm.queries import ORACLES, QUERIES, tokenizer_path
from ledgerloom.llm.words import chunks, split_words
from ledgerloom.session import scratch_path


def rows(df):
    return df.toArrow().to_pylist()


def test_all_are_registered():
    assert {int(n[2:].split("_")[0]) for n in queries() if n[:2] == "op" and n[2].isdigit()} == set(range(1, 14))
    assert set(ORACLES) <= set(oracle_sql()) and "pipeline" in queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, small, name):
    assert compare(spark, small, QUERIES[name], ORACLES[name]) is None


# words


def test_words_split_at_six_bytes_only():
    text = "a b\x1cc d\te\nf\x0bg\x0ch\ri  j "
    got = split_words(pa.array([text, None, "", "A Ä"]), lower=True)
    assert [got.vocabulary[int(i)].as_py() for i in got.ids] == ["a b\x1cc", *"defghij", "a", "Ä"]
    assert got.counts.tolist() == [8, 0, 0, 2]


def test_chunks_are_bounded_and_whole():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * n for n in (5, 30, 1, 1, 1, 0, 40)]})
    got = [c["t"].to_pylist() for c in chunks(iter([batch, batch]), "t", 10)]
    assert list(itertools.chain(*got)) == batch["t"].to_pylist() * 2
    assert all(len(c) == 1 or sum(map(len, c[:-1])) <= 10 for c in got)


# 1 near duplicates


def _set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates_by_brute_force(spark):
    random.seed(5)
    docs, at = [], 0
    for _ in range(12):
        base = [f"w{random.randrange(3000)}" for _ in range(120)]
        for _ in range(random.choice([1, 4, 12])):
            copy = [f"n{random.randrange(10**6)}" if random.random() < random.choice([0, 0.01, 0.03]) else w for w in base]
            docs.append((at, " ".join(copy).title() if at % 2 else " ".join(copy)))
            at += 1
    random.shuffle(docs)
    got = {r["doc_id"]: r for r in rows(near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=85))}
    sets = {i: _set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {
        i: (len(s), root(i), root(i) == i) for i, s in sets.items()
    }


def _family(seed, loose, tight):
    """Variants of one text, most of them too different from all others, a few alike."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(10**6)}" for _ in range(600)]
    docs = []
    for i in range(loose + tight):
        copy = list(base)
        for at in draw.sample(range(5, 595, 5), 12 if i < loose else 4):
            copy[at] = f"n{draw.randrange(10**9)}"
        docs.append(" ".join(copy))
    draw.shuffle(docs)
    return list(enumerate(docs))


def _least_ids(docs, percent):
    sets = {i: _set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_few_links_inside_a_family_of_loose_variants(spark):
    docs = _family(1, 300, 5)
    want = _least_ids(docs, 85)
    assert len(set(want.values())) == 301
    got = rows(near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=85))
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_near_duplicates_on_odd_tables(odd_documents, no_documents):
    got = rows(near_dedup.near_duplicates(odd_documents))
    assert len(got) == odd_documents.count()
    own = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in got}
    assert own[(2, 176)] == (1, False) and own[(1, 176)] == (1, True) and own[(3, 177)] == (1, False)
    assert own[(5, 0)] == own[(6, 0)][:0] + (5, True) and own[(8, 1)] == (8, True)
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert near_dedup.near_duplicates(no_documents).count() == 0


def test_densified_bins_agree_as_often_as_sets_do():
    draw = np.random.default_rng(1)
    agree = []
    for _ in range(60):
        values = np.unique(draw.integers(0, 2**63, 60, dtype=np.int64).astype(np.uint64))
        a, b = values[:50], values[10:]
        m = near_dedup.bin_minima([np.sort(a << np.uint64(1)), np.sort(b << np.uint64(1))])
        agree.append((m[0] == m[1]).mean())
    assert abs(np.mean(agree) - 40 / 60) < 0.03


# 2 mixing


def test_every_prefix_is_within_one_block():
    random.seed(3)
    for parts in (64, 257, 1024):
        weights = source_mix.whole_parts({i: random.random() ** 3 + 0.001 for i in range(17)}, parts)
        period = source_mix.pfair_period(weights)
        assert len(period) == sum(weights.values()) == parts
        seen = Counter()
        for t, s in enumerate(period, 1):
            seen[s] += 1
            assert all(abs(seen[x] - t * w / parts) < 1 for x, w in weights.items())


def test_mixed_rows_follow_the_schedule(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    weights = {"src0": 5.0, "src1": 1.0}
    got = rows(source_mix.mix_sources(docs, weights, block_chars=4000, parts=64))
    sizes = {r["doc_id"]: max(1, len(r["text"] or "")) for r in rows(docs.select("doc_id", "text"))}
    assert sorted(r["doc_id"] for r in got) == sorted(sizes)
    plan = source_mix.whole_parts({r["source"]: weights.get(r["source"], 0) for r in got}, 64)
    period = source_mix.pfair_period(plan)
    for source in plan:
        own = sorted((r["block"] * 4000 + r["seat"], r) for r in got if r["source"] == source)
        place = 0
        for at, r in own:
            assert at == place
            place += sizes[r["doc_id"]]
            turns = [t for t, s in enumerate(period) if s == source]
            assert r["slot"] == r["block"] // len(turns) * 64 + turns[r["block"] % len(turns)]


def test_too_many_sources_raise(odd_documents, monkeypatch):
    monkeypatch.setattr(source_mix, "SOURCES", 3)
    assert source_mix.mix_sources(odd_documents).count() == odd_documents.count()
    monkeypatch.setattr(source_mix, "SOURCES", 2)
    with pytest.raises(ValueError, match="more than 2 sources"):
        source_mix.mix_sources(odd_documents)


def test_mixing_odd_tables(odd_documents, no_documents):
    got = rows(source_mix.mix_sources(odd_documents))
    assert len(got) == odd_documents.count() and all(r["slot"] is not None for r in got)
    assert {r["source"] for r in got} == {"a", "b", None}
    assert source_mix.mix_sources(no_documents).count() == 0


# 3 licences


def test_licence_rules_need_their_order(spark):
    s = license_rules.SENTENCES
    grant, notice, warranty = (s[f"mit.{x}"] for x in ("grant", "notice", "warranty"))
    wrapped = "/*\n * " + f"{grant}\n{notice}\n\n{warranty}".replace(" software", "\n * software") + "\n */"
    texts = [wrapped, f"{warranty} {grant} {notice}", f"{grant} Other words. {notice} {warranty}", "Ends.\nReleased under the MIT License.\nx", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in rows(license_rules.scan_licences(df))}
    assert got == {0: ["MIT"], 1: [], 2: ["MIT"], 3: ["MIT"], 4: [], 5: []}


def test_licence_texts_and_names(spark):
    s = license_rules.SENTENCES
    mit = "\n".join(s[f"mit.{x}"] for x in ("grant", "notice", "warranty"))
    bsd2 = [s[f"bsd.{x}"] for x in ("grant", "source", "binary")]
    hashed = "\n".join("# " + line for line in ["Copyright (c) 2020 Foo", "", *mit.replace(" software", "\nsoftware").split("\n")])
    gpl2 = "This program is free software; you can redistribute it and/or modify it " + s["gpl2.notice"].replace(" Foundation", "\n * Foundation")
    texts = {
        hashed: ["MIT"],
        "Copyright (c) 2020 Foo\n" + mit: ["MIT"],
        "\n".join(bsd2): ["BSD-2-Clause"],
        "\n".join([*bsd2, "Neither the name of Foo nor the names of its contributors" + s["bsd.names"].split("contributors")[1]]): ["BSD-3-Clause"],
        "the terms of the Mozilla Public License, v. 1.1.": [],
        "is subject to the terms of the Mozilla Public License, v. 1.1.": ["MPL-1.1"],
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": ["MPL-2.0"],
        gpl2: ["GPL-2.0-or-later"],
        "// SPDX-License-Identifier: GPL-2.0-or-later": ["GPL-2.0-or-later"],
        "SPDX-License-Identifier: GPL-2.0-only\nSPDX-License-Identifier: MIT": ["GPL-2.0-only", "MIT"],
        "Licensed under the Apache License, Version 2.0 and available under the MIT licence": ["Apache-2.0", "MIT"],
        "unlicensed under mitten": [],
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in rows(license_rules.scan_licences(df))}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
    assert len({licence for licence, _ in license_rules.all_rules()}) >= 60
    pattern = re.compile(license_rules.sentence_pattern(license_rules.known_sentences()))
    assert all(pattern.fullmatch(sentence) for sentence in license_rules.known_sentences())


def test_licences_of_odd_tables(odd_documents, no_documents):
    assert license_rules.scan_licences(odd_documents.drop("sentences")).count() == odd_documents.count()
    assert all(r["licences"] == [] for r in rows(license_rules.scan_licences(odd_documents)))
    assert license_rules.scan_licences(no_documents).count() == 0


# 4 archive


def test_archive_gives_back_every_record(spark):
    pages = [(3, "http://a/ü", "hi\r\n\r\nthere"), (1, "u\r\nX: y", "hi\r\n\r\nthere"), (None, None, None), (9, "z", ""), (1, "u\r\nX: y", "hi\r\n\r\nthere"), (4, "q", "ä" * 9000)]
    df = spark.createDataFrame([(*p, "clash", "clash") for p in pages], "page_id long, url string, html string, sha256 string, kind string")
    path = scratch_path(spark, "archive")
    warc_store.write_archive(df, path)
    got = rows(warc_store.read_records(spark, path))
    assert len(got) == len(pages) and spark.read.parquet(f"{path}/payloads").count() == 3
    for r in got:
        head, _, block = r["record"].partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1") and block.endswith(b"\r\n\r\n") and "X" not in fields
        assert int(fields["Content-Length"]) == len(block) - 4
        body = block[:-4].partition(b"\r\n\r\n")[2]
        assert body == (r["payload"] if r["record_type"] == "response" else b"")
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode()
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got)
    assert kinds == [("1", "response", None), ("1", "response", None), ("3", "revisit", 1), ("4", "response", None), ("9", "response", None), ("None", "revisit", 9)]


def test_archive_notices_a_wrong_payload(spark):
    from pyspark.sql import functions as F

    path, bad = scratch_path(spark, "archive"), scratch_path(spark, "bad")
    warc_store.write_archive(spark.createDataFrame([(1, "u", "good")], "page_id long, url string, html string"), path)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"evil")).write.parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="differs from its digest"):
        warc_store.read_payloads(spark, bad).collect()


def test_empty_archive(spark):
    path = scratch_path(spark, "archive")
    warc_store.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc_store.read_records(spark, path).count() == 0


# 5 top-k


def test_search_by_brute_force_with_ties():
    draw = np.random.default_rng(2)
    for n, width, high in ((300, 16, 3), (50, 4, 2000), (3, 8, 50), (700, 8, 1)):
        m = draw.integers(-high, high + 1, (n, width))
        ids = draw.permutation(n)
        segments, unread = impact_index.build_index(m)
        q = m[ids % 7 == 0]
        qi = ids[ids % 7 == 0]
        for row, own, (at, scores) in zip(q, qi, impact_index.search_block(segments, unread, m, ids, q, qi, 5)):
            s = m @ row
            want = [j for j in np.lexsort((ids, -s)) if ids[j] != own][:5]
            assert ids[at].tolist() == ids[want].tolist() and scores.tolist() == s[want].tolist()


def test_reading_stops_before_the_last_segment():
    draw = np.random.default_rng(4)
    m = np.rint(draw.standard_normal((2000, 16)) * 60).astype(np.int64)
    m[:40] = m[0] + draw.integers(-3, 4, (40, 16))
    segments, unread = impact_index.build_index(m)
    read = []

    class Watched(list):
        def __getitem__(self, i):
            read.append(i)
            return super().__getitem__(i)

    list(impact_index.search_block(Watched(segments), unread, m, np.arange(2000), m[:1], np.arange(1), 5))
    assert max(read) < len(segments) - 1


def test_unsound_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.0]), (1, [0.5, 2.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (50, [1.0, 1.0]), (5, [1.0, None]), (None, [9.0, 9.0]), (6, []), (7, [1.0]), (8, [0.5, 2.0]), (8, [0.5, 2.0])]
    df = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<double>, score int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(impact_index.exact_top_k(df)))
    assert got == [
        (0, 1, 50, 65536), (0, 2, 1, 32768), (0, 3, 8, 32768), (0, 4, 8, 32768),
        (50, 1, 1, 163840), (50, 2, 8, 163840), (50, 3, 8, 163840), (50, 4, 0, 65536),
    ]
    assert impact_index.exact_top_k(df.where("false")).count() == 0


def test_packs_keep_the_best_of_many_blocks():
    draw = np.random.default_rng(6)
    for high, width, k in ((40, 16, 5), (1 << 27, 6, 3), (1, 3, 4), (0, 2, 2)):
        m = draw.integers(-high, high + 1, (900, width))
        m[500:520] = m[0]  # ties
        m[7] = 0
        ids = draw.permutation(900)
        ids[100:110] = ids[90:100]  # repeated ids
        ask = np.concatenate(([0, 7, 95], draw.integers(0, 900, 40)))
        packs = [impact_index.Pack(impact_index._narrow(m[part]), ids[part], k) for part in (ask[:20], ask[20:])]
        share = 1.0
        for a, b in ((0, 3), (3, 300), (300, 301), (301, 900)):
            share = impact_index.scan_block(*impact_index.build_index(m[a:b]), m[a:b], ids[a:b], packs, a, share)
        for pack in packs:
            for row, own, at, scores in zip(pack.queries.astype(np.int64), pack.query_ids, pack.rows, pack.scores):
                s = m @ row
                want = [j for j in np.lexsort((ids, -s)) if ids[j] != own][:k]
                assert ids[at].tolist() == ids[want].tolist() and scores.tolist() == s[want].tolist()


@pytest.mark.parametrize("held", [1, 96 << 20])
def test_queries_meet_every_block_without_a_join(spark, tmp_path, monkeypatch, held):
    monkeypatch.setattr(impact_index, "HELD", held)
    monkeypatch.setattr(impact_index, "PIECE", 4)
    draw = np.random.default_rng(8)
    m = draw.standard_normal((1500, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    impact_index.write_index(df, str(tmp_path / "index"), "vec_id", "embedding", block=30)
    found = impact_index.search(spark, str(tmp_path / "index"), k=3, every=10, query_block=40)
    assert "Join" not in found._jdf.queryExecution().toString()
    whole = np.floor(256 * m).astype(np.int64)
    want = []
    for q in range(0, 1500, 10):
        s = whole @ whole[q]
        best = [j for j in np.lexsort((np.arange(1500), -s)) if j != q][:3]
        want += [(q, n + 1, int(j), int(s[j])) for n, j in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in rows(found)) == want


# 6 quality


def test_fences_follow_language_and_source(spark):
    random.seed(1)
    word = lambda n: "".join(random.choice("abcdefgh") for _ in range(n))
    docs = [(i, " ".join(word(random.choice([4, 5, 6])) for _ in range(40)), "en", "a") for i in range(300)]
    docs += [(1000 + i, " ".join(word(random.choice([14, 15, 16])) for _ in range(40)), "xx", "b") for i in range(300)]
    docs += [(5000, " ".join(word(15) for _ in range(40)), "en", "a"), (5001, " ".join(word(5) for _ in range(40)), "xx", "b")]
    docs += [(5002, " ".join(word(5) + "%%%" for _ in range(40)), "en", "a"), (5003, "too short", "en", "a"), (5004, "same words here " * 40, "en", "a")]
    got = {r["doc_id"]: r for r in rows(quality_sketch.adaptive_quality(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")))}
    assert all(got[i]["kept"] for i, *_ in docs if i < 5000)
    assert not any(got[i]["kept"] for i in range(5000, 5005))
    assert got[5003]["base_failed"] and got[5004]["base_failed"] and not got[5002]["base_failed"]


@pytest.mark.parametrize("bad, words, measure", [
    ("nine words that come again after the first nine " * 2, 45, "repeat_share"), ("one line\n" * 6, 60, "dup_line_share"), ("%" * 40 + " ", 60, "symbol_share"),
])
def test_every_fence_rejects_what_the_base_rule_lets_pass(spark, bad, words, measure):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.choice([4, 5, 6])))
    text = lambda n: "\n".join(" ".join(word() for _ in range(n // 5)) for _ in range(5))
    docs = [(i, text(40), "en", "a") for i in range(300)] + [(1000, bad + text(words), "en", "a")]
    got = {r["doc_id"]: r for r in rows(quality_sketch.adaptive_quality(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")))}
    assert all(got[i]["kept"] for i in range(300))
    assert not got[1000]["base_failed"] and not got[1000]["kept"] and got[1000][measure] > 0


def test_sketches_merge(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    half = lambda k: quality_sketch.sketches(quality_sketch.measures(docs.where(f"doc_id % 2 = {k}")))
    both = half(0).union(half(1)).groupBy("level", "lang", "source", "measure", "bin").sum("count")
    whole = quality_sketch.sketches(quality_sketch.measures(docs))
    assert sorted(map(str, both.collect())) == sorted(str(r).replace("count=", "sum(count)=") for r in whole.collect())


def test_bins_are_within_a_32nd(spark):
    from pyspark.sql import functions as F

    values = [*range(200), *(random.Random(1).randrange(1 << 40) for _ in range(200))]
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("b", quality_sketch.bin_of(F.col("v")).cast("long"))
    for r in rows(df.withColumn("top", quality_sketch.top_of(F.col("b")))):
        assert r["v"] <= r["top"] <= r["v"] + r["v"] / 32


def test_quality_of_odd_tables(odd_documents, no_documents):
    got = rows(quality_sketch.adaptive_quality(odd_documents))
    assert len(got) == odd_documents.count()
    assert all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 20)
    assert [r["n_repeat_words"] for r in got if r["doc_id"] == 11] == [700]
    assert quality_sketch.adaptive_quality(no_documents).count() == 0


# 7 toxicity


def test_gradients_agree_with_differences():
    texts = ["one two three four", "two five six", "seven one eight nine ten"]
    words = split_words(pa.array(texts))
    stems, stem_of = toxicity.stems_of(words.vocabulary)
    net = toxicity.Network(stems, 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["word"][1:] += 0.3
    numbers, (flat, count) = net.word_numbers(stems), toxicity.trigrams_of(stems)
    doc, first, length = toxicity.windows_of(words.counts)
    begin, labels = words.starts[doc] + first, np.array([1.0, 0.0, 1.0])

    def loss():
        s = net.scores(stems, stem_of[words.ids], begin, length).astype(np.float64)
        return -(labels * np.log(s) + (1 - labels) * np.log(1 - s)).mean()

    class Still:
        def random(self, n):
            return np.ones(n)

    before = {k: v.copy() for k, v in net.p.items()}
    net.m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    net.learn(numbers, flat, count, stem_of[words.ids], begin, length, labels, 0.0, Still())
    net.p = before
    for name in net.p:
        grad = net.m[name][0] * 10
        for at in [np.unravel_index(i, grad.shape) for i in np.argsort(-np.abs(grad), axis=None)[:3]]:
            old, e = net.p[name][at], 1e-3
            net.p[name][at] = old + e
            up = loss()
            net.p[name][at] = old - e
            down = loss()
            net.p[name][at] = old
            assert abs((up - down) / (2 * e) - grad[at]) < 0.02 * abs(grad[at]) + 1e-3, name


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in rows(QUERIES["op7_bigru_toxicity"](spark, folder))}
    labels = rows(spark.read.parquet(f"{folder}/labels.parquet"))
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    out = [r for r in labels if got[r["doc_id"]]["held_out"]]
    assert np.mean([got[r["doc_id"]]["predicted"] == r["toxic"] for r in out]) > 0.93
    assert np.mean([got[r["doc_id"]]["predicted"] for r in out if not r["toxic"]]) < 0.03


def test_windows_cover_all_words_and_overlap():
    counts = np.array([0, 1, 31, 32, 33, 56, 57, 1000])
    doc, first, length = toxicity.windows_of(counts)
    for i, n in enumerate(counts):
        own = [(f, f + k) for d, f, k in zip(doc, first, length) if d == i]
        assert set().union(*(range(a, b) for a, b in own), set()) == set(range(n))
        assert all(b[0] < a[1] for a, b in itertools.pairwise(own))


def test_sampled_windows_are_bounded_and_spread():
    doc = np.repeat([0, 2, 3], [5, 1000, 140])
    some = toxicity.sampled_windows(doc, 140)
    assert np.bincount(doc[some]).tolist() == [5, 0, 140, 140]
    assert np.flatnonzero(some[5:1005]).max() > 900


def test_toxicity_of_odd_tables(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, None), (2, 0, 1), (None, 1, 1), (3, None, None), (4, 1, 0)], "doc_id long, toxic int, score int")
    got = rows(toxicity.toxic_scores(odd_documents, labels))
    assert len(got) == odd_documents.count() and all(r["score"] == 0 for r in got if r["doc_id"] in (5, 6, 7))
    assert all(r["score"] == 0 for r in rows(toxicity.toxic_scores(odd_documents, labels.where("false"))))
    assert toxicity.toxic_scores(no_documents, labels).count() == 0


# 8 byte dedup


@pytest.mark.parametrize("block", [4 << 20, 7])
def test_columns_find_the_repeated_windows(monkeypatch, block):
    monkeypatch.setattr(column_bwt, "BLOCK_ROWS", block)
    for seed in range(40):
        draw = random.Random(seed)
        width, letters = draw.choice([3, 5, 8]), draw.choice(["ab", "abcd"])
        strings = ["".join(draw.choice(letters) for _ in range(draw.randint(width, width + 12))).encode() for _ in range(draw.randint(1, 60))]
        before = np.array([draw.randrange(len(s)) for s in strings])
        length = np.array(list(map(len, strings)))
        got = column_bwt.repeated_starts(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(length) - length, length, before, width)
        count = Counter((i - p, s[i : i + width]) for s, p in zip(strings, before) for i in range(len(s) - width + 1))
        assert got.tolist() == [count[i - p, s[i : i + width]] > 1 for s, p in zip(strings, before) for i in range(len(s) - width + 1)], seed


def _bytes_brute(texts):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_short_columns_open_no_files(monkeypatch):
    def refuse(*args):
        raise AssertionError("a file was opened")

    monkeypatch.setattr(column_bwt._Files, "_open", refuse)
    strings = [b"abcabd", b"xbcabd", b"abcabd", b"zzzzzz"]
    length = np.array([len(x) for x in strings])
    flags = column_bwt.repeated_starts(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(length) - length, length, np.full(4, 2), 4)
    assert flags.reshape(4, 3).tolist() == [[True, True, True], [False, True, True], [True, True, True], [False, False, False]]


def test_a_table_has_the_planes_of_its_columns():
    table = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, (17, 3))
    assert spans.planes(table) == b"".join(spans.planes(table[:, i]) for i in range(3))
    for some in (table, table[:1], table[:0]):
        got = spans.unpacked(np.frombuffer(spans.planes(some), np.uint8), 3)
        assert got.tolist() == some.T.tolist() and got.flags.writeable
    assert spans.unpack_numbers(spans.pack_numbers(table[:, 0], table[:3, 1]), 17, 3)[1].tolist() == table[:3, 1].tolist()


def test_byte_dedup_by_brute_force(spark, small):
    docs = rows(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(QUERIES["op8_column_bwt_dedup"](spark, small))}
    assert got == dict(zip((d["doc_id"] for d in docs), _bytes_brute([d["text"] for d in docs])))


def test_byte_dedup_of_odd_tables(odd_documents, no_documents):
    done = rows(column_bwt.drop_repeats(odd_documents))
    want = _bytes_brute([r["text"] for r in done])
    assert len(done) == odd_documents.count()
    assert [(r["_bytes"], r["_removed"], r["_spans"], hashlib.sha256(r["_kept"]).hexdigest()) for r in done] == want
    assert column_bwt.drop_repeats(no_documents).count() == 0


def test_marks_of_copies_spread_over_the_parts():
    n = 4000
    ids, hashes = np.arange(n) % 2000, np.full(n, -5)
    found = list(spans.pack_runs(ids, hashes, np.arange(n), np.zeros(n, np.int64), np.ones(n, np.int64), 16))
    assert len(found) == 16 and sum(r[1] for r in found) == n and max(r[1] for r in found) < n / 8
    own = [set(np.frombuffer(r[2], "<i8").reshape(3, -1)[0].tolist()) for r in found]
    assert sum(map(len, own)) == 2000  # a document has one part


# 9 packing


def test_pieces_are_powers_of_two():
    for n in (1, 2, 3, 2047, 2048, 2049, 10_000):
        pieces = pow2_pack.binary_pieces(n)
        assert sum(pieces) == n and all(p & (p - 1) == 0 and p <= 2048 for p in pieces)


def test_ids_are_the_tokenizers():
    path = tokenizer_path()
    tokenizer = pow2_pack._tokenizer(path)
    draw = random.Random(1)
    signs = [*"abcXYZ012.,!'<|>%é\n\t ", "'s", "'LL", "́", "İ", "İ", "K", " ", "　", "\x1c", "\x85", "<|endoftext|>", "<|STARTOFTEXT|>", "ς", "Σ.", "日本", "½", "​", "ǅ", "ß", "\x00", "😀", "ﬁ", "d'.", "'re,"]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 60))) for _ in range(4000)] + [None, "", " . , "]
    for text, ids in zip(texts, pow2_pack.document_ids(pa.array(texts), path)):
        assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_ids_of_a_tokenizer_that_reads_spaces_and_capitals():
    path = tokenizer_path("byte_bpe_50k.json")
    texts = ["Hello  World. Again\n\nAGAIN it's", None, "", " a ", "Ünïcode 日本 12345"] * 3
    for text, ids in zip(texts, pow2_pack.document_ids(pa.array(texts), path)):
        assert ids.tolist() == pow2_pack._tokenizer(path).encode(text or "", add_special_tokens=False).ids, text


def test_packing_keeps_every_id_once(spark, odd_documents, no_documents):
    path = tokenizer_path()
    got = rows(pow2_pack.pack_documents(odd_documents, path))
    assert len({r["sequence_id"] for r in got}) == len(got) and all(r["offset"] == 0 and 1 << r["bucket"] == r["length"] == len(r["tokens"]) for r in got)
    whole, own = Counter(), []
    for r in got:
        own = own if r["start"] else []
        assert len(own) == r["start"]
        own = own + r["tokens"]
        if len(own) == r["doc_tokens"]:
            whole[(r["doc_id"], tuple(own))] += 1
    ids = lambda t: (*pow2_pack._tokenizer(path).encode(t or "", add_special_tokens=False).ids, 1)
    assert whole == Counter((r["doc_id"], ids(r["text"])) for r in rows(odd_documents))
    digests = rows(pow2_pack.piece_digests(pow2_pack.pack_documents(odd_documents, path)))
    assert [d["ids_crc32"] for d in digests] == [zlib.crc32(np.array(r["tokens"], "<u4").tobytes()) for r in got]
    assert pow2_pack.pack_documents(no_documents, path).count() == 0


def _many_words(n_docs: int) -> pa.RecordBatch:
    draw = random.Random(4)
    spelled = ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(20_000)]
    texts = [" ".join(draw.choices(spelled, k=1000)) for _ in range(n_docs)]
    return pa.RecordBatch.from_arrays([pa.array(range(n_docs), pa.int64()), pa.array(texts)], ["_id", "_text"])


def test_a_packing_task_holds_little_beside_its_batch():
    """Twelve megabytes of text once took over 100 megabytes of arrays, and some 400 in all."""
    path, batch = tokenizer_path(), _many_words(2000)
    pow2_pack._ends_word(path), pow2_pack.reads_words(path)
    task = []  # without Spark around it

    class Docs:
        schema = T.StructType([T.StructField("doc_id", T.LongType())])
        select = lambda self, *_: self
        mapInArrow = lambda self, fn, _: task.append(fn) or self

    with patch.object(pow2_pack, "F"):
        pow2_pack.pack_documents(Docs(), path)
    tracemalloc.start()
    sizes = [out.nbytes for out in task[0](iter([batch]))]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.nbytes > 12e6 and max(sizes) < 10e6 and most < 60e6, (sizes, most)


def test_words_met_before_keep_their_ids(monkeypatch):
    path, batch = tokenizer_path(), _many_words(200)
    encoded = []
    one = pow2_pack.word_ids
    monkeypatch.setattr(pow2_pack, "word_ids", lambda words, path: encoded.append(len(words)) or one(words, path))
    texts = batch["_text"]
    whole = [ids.tolist() for ids in pow2_pack.document_ids(texts, path)]
    distinct = encoded.pop()
    for limit, again in ((pow2_pack.KNOWN, False), (1 << 18, True)):  # the second lets go of its words on the way
        monkeypatch.setattr(pow2_pack, "KNOWN", limit)
        known = pow2_pack.KnownWords(path)
        parts = [ids.tolist() for at in range(0, 200, 30) for ids in pow2_pack.document_ids(texts.slice(at, 30), path, known)]
        assert parts == whole
        assert (sum(encoded) > distinct) == again
        encoded.clear()


def test_strings_of_any_length_are_encoded_in_bounded_calls(monkeypatch):
    path = tokenizer_path()
    texts = ["a b", "", "word " * 40_000, "x", *["some more words"] * 9000]
    flat, sizes = pow2_pack._encode(pa.array(texts), path)
    ids = [pow2_pack._tokenizer(path).encode(t, add_special_tokens=False).ids for t in texts[:5]]
    assert sizes.tolist() == [len(i) for i in ids[:4]] + [len(ids[4])] * 9000
    assert flat.tolist() == [x for i in ids[:4] for x in i] + ids[4] * 9000


def test_digests_of_sliced_batches(spark):
    docs = spark.range(3500).selectExpr("id AS doc_id", "repeat('one two three ', int(id % 7)) AS text").coalesce(1)
    pieces = pow2_pack.pack_documents(docs, tokenizer_path())
    got, want = rows(pow2_pack.piece_digests(pieces)), rows(pieces)
    assert len(want) > 2 * pow2_pack.DIGESTED
    assert [g["ids_crc32"] for g in got] == [zlib.crc32(np.array(r["tokens"], "<u4").tobytes()) for r in want]


# 10 word dedup


def _words_brute(docs):
    first, split = {}, [(t or "").encode().split() for _, t in docs]
    key = lambda i: float("inf") if i is None else i
    for (i, _), w in zip(docs, split):
        for j in range(len(w) - 12):
            g = tuple(w[j : j + 13])
            first[g] = min(first.get(g, float("inf")), key(i))
    out = []
    for (i, _), w in zip(docs, split):
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < key(i):
                gone[j : j + 13] = [True] * 13
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def test_word_dedup_of_odd_tables(odd_documents, no_documents):
    done = rows(superkmer.drop_repeats(odd_documents))
    assert len(done) == odd_documents.count() and set(odd_documents.columns) < set(done[0])
    assert [(r["_words"], r["_removed"], r["_kept"]) for r in done] == _words_brute([(r["doc_id"], r["text"]) for r in done])
    assert superkmer.drop_repeats(no_documents).count() == 0


def test_equal_hashes_are_settled_by_words():
    ids = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3], np.int32)
    at = np.array([0, 3, 6])
    assert superkmer._marked(np.zeros(3, np.uint64), np.array([1, 2, 3]), at, ids, 3).tolist() == [False, False, True]


# pipeline


def _bag(df):
    return Counter(map(str, rows(df)))


def test_stages_on_odd_documents(spark, small, odd_documents, no_documents):
    import corpus_pipeline

    clashing = odd_documents.withColumns({c: odd_documents["lang"] for c in ("_kept", "_removed", "_words", "_seat", "SLOT2")})
    plain = {}
    for first in (odd_documents.select("doc_id", "text", "lang", "source", "n_chars"), clashing, clashing.where("false")):
        docs = first
        for name, stage in corpus_pipeline.STAGES:
            path = scratch_path(spark, "t")
            stage(spark, docs, small).write.parquet(path)
            new = spark.read.parquet(path)
            if name == "packing":
                break
            assert new.columns == docs.columns
            found = _bag(new.select("doc_id", "text", "lang", "source", "n_chars"))
            if first is clashing:
                assert found == plain[name]  # other columns change nothing
            elif first.columns == ["doc_id", "text", "lang", "source", "n_chars"]:
                plain[name] = found
            else:
                assert not found
            docs = new
    near = plain["near_duplicates"]
    assert not any(k.startswith(("{'doc_id': 2,", "{'doc_id': 3,")) for k in near)  # copies of document 1
    assert all(any(k.startswith(f"{{'doc_id': {i},") for k in near) for i in (1, 5, 6, 7, 8, 9, None))
    assert sum(plain["substring_dedup"].values()) == sum(near.values()) == sum(plain["source_mix"].values())


def test_repeats_go_whatever_the_columns_are_called(spark, odd_documents):
    plain = odd_documents.select("doc_id", "text")
    clashing = odd_documents.withColumns({c: odd_documents["lang"] for c in ("_kept", "_removed", "_words", "_bytes", "_spans", "_row")})
    for done, added in ((superkmer.drop_repeats, ["_kept", "_words", "_removed"]), (column_bwt.drop_repeats, ["_kept", "_bytes", "_removed", "_spans"])):
        want = done(plain)
        got = done(clashing)
        assert got.columns == [c for c in clashing.columns if c not in added] + added
        assert _bag(got.select("doc_id", "text", *added)) == _bag(want)


def test_pipeline_by_brute_force(spark, small):
    import corpus_pipeline

    docs = rows(spark.read.parquet(f"{small}/documents.parquet"))
    scored = {r["doc_id"]: r["predicted"] for r in rows(QUERIES["op7_bigru_toxicity"](spark, small))}
    left = [d for d in docs if not scored[d["doc_id"]]]
    sets = [_set(d["text"]) for d in left]
    parent = list(range(len(left)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(left)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    left = [d for i, d in enumerate(left) if root(i) == i]
    kept = [(d["doc_id"], k if n else d["text"]) for d, (_, n, k) in zip(left, _words_brute([(d["doc_id"], d["text"]) for d in left]))]
    tokenizer = pow2_pack._tokenizer(tokenizer_path())
    want = Counter()
    for i, text in kept:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for n in pow2_pack.binary_pieces(len(ids)):
            want[(i, at, n, zlib.crc32(ids[at : at + n].tobytes()))] += 1
            at += n
    got = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows(corpus_pipeline.run(spark, small)))
    assert got == want


def test_mixed_files_are_in_slot_order(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    place = {r["doc_id"]: (r["slot"], r["seat"]) for r in rows(source_mix.mix_sources(docs))}
    order = [place[r["doc_id"]] for r in rows(corpus_pipeline.mix_to_weights(spark, docs, small))]
    assert order == sorted(order) and len(order) == docs.count()
