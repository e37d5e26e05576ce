"""FLAC streams and HTML extraction."""

import hashlib
import os
import random
import re
import time
import zlib
from html import unescape

import brute
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flowlens.llm import flac, html, labelled, licences, queries

SF = "/root/testdata/sf0.001"


def payloads():
    rng = np.random.default_rng(3)
    wave = np.clip(128 + 50 * np.sin(np.arange(5760) / 15) + rng.normal(0, 1, 5760), 0, 255).astype(np.uint8).tobytes()
    return [flac.padded(t)[0] for t in (None, "", "abc", "x" * 9000, "Une phrase, deux phrases. " * 300)] + [wave, rng.integers(0, 256, 5760, dtype=np.uint8).tobytes(), bytes(576), b"\xff" * 576 * 130]


def test_round_trip():
    own = payloads()
    streams = flac.streams(own)
    assert flac.read_many(streams) == own
    assert len(streams[5]) < len(own[5]) * 0.7  # predictors help a wave
    heads = [flac.read_head(s) for s in streams]
    assert all(len(h.seek) * flac.BLOCK == h.samples == len(p) for h, p in zip(heads, own))
    assert all(h.md5 == hashlib.md5((np.frombuffer(p, np.uint8) ^ 128).tobytes()).digest() for h, p in zip(heads, own))


def test_without_seek_table_frames_are_walked():
    for p, s in zip(payloads(), flac.streams(payloads())):
        h = flac.read_head(s)
        bare = b"fLaC" + bytes([128]) + s[5:42] + s[h.audio :]
        assert flac.read_head(bare).seek is None and flac.read_many([bare]) == [p]


@pytest.mark.parametrize("where", ["head", "frame", "end", "cut"])
def test_damage_is_found(where):
    s = flac.streams([flac.padded("Some words to be stored. " * 60)[0]])[0]
    h, bad = flac.read_head(s), bytearray(s)
    if where == "head":
        bad[h.audio + 2] ^= 0x10
    elif where == "frame":
        bad[h.audio + 100] ^= 1
    elif where == "end":
        bad[-1] ^= 1
    else:
        bad = bad[:-40]
    with pytest.raises(flac.FlacError):
        flac.read_many([bytes(bad)])


def bits_frame(number, fields):
    """A frame of 576 samples made of (value, bits) fields, with right checksums."""
    head = bytes([0xFF, 0xF8, 0x24, 0x02]) + flac.coded_number(number)
    raw = np.frombuffer(head, np.uint8)
    head += bytes([int(flac.crcs(raw, np.array([0]), np.array([len(raw)]), False)[0])])
    text = "".join(format(v, f"0{b}b") for v, b in fields)
    text += "0" * (-len(text) % 8)
    body = head + int(text, 2).to_bytes(len(text) // 8)
    raw = np.frombuffer(body, np.uint8)
    return body + int(flac.crcs(raw, np.array([0]), np.array([len(raw)]), True)[0]).to_bytes(2)


def test_escaped_partitions_five_bit_parameters_and_wasted_bits():
    rng = np.random.default_rng(2)
    values = rng.integers(-16, 16, 576)
    escaped = [(0, 1), (8, 6), (0, 1), (0, 2), (0, 4), (15, 4), (5, 5), *((int(v) & 31, 5) for v in values)]
    rice = [(0, 1), (8, 6), (0, 1), (1, 2), (0, 4), (3, 5)]
    for v in values:
        u = 2 * int(v) if v >= 0 else -2 * int(v) - 1
        rice += [(1, (u >> 3) + 1), (u & 7, 3)]
    wasted = [(0, 1), (1, 6), (1, 1), (1, 2), *((int(v) & 63, 6) for v in values)]  # two wasted bits: a zero and a one
    for fields, scale in ((escaped, 1), (rice, 1), (wasted, 4)):
        frame = bits_frame(0, fields)
        got, number, end = flac.read_frames(frame, np.array([0]), 576)
        assert (got[0] == values * scale).all() and number[0] == 0 and end[0] == len(frame)


def test_frame_numbers():
    assert [flac.coded_number(n) for n in (0, 127, 128, 2047, 2048, 65536)] == [chr(n).encode() for n in (0, 127, 128, 2047, 2048, 65536)]


def test_query_against_plain_bytes(spark, texts):
    for r in queries.op10_flac(spark, SF).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        want = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))


def test_columns_of_odd_rows(odd, none):
    stored = flac.media(odd)
    rows = flac.read_back(flac.pcm(stored)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, flac.read_back(flac.recorded(odd)).collect()))
    assert len(rows) == 9 and len({r["media_sha256"] for r in rows if r["doc_id"] == 1}) == 1
    blocks = flac.pcm_blocks(stored.filter("doc_id = 6")).orderBy("sample_offset").collect()
    assert b"".join(b["pcm"] for b in blocks) == flac.padded("ü" * 5000)[0] and [b["sample_offset"] for b in blocks] == list(range(0, 10368, 576))
    assert flac.read_back(flac.recorded(none)).count() == 0 and flac.pcm_blocks(flac.media(none)).count() == 0


def test_pcm_offsets_are_seekable_and_gaps_are_found(spark, odd):
    for r in flac.pcm(flac.media(odd)).join(flac.media(odd).withColumnRenamed("n_bytes", "n"), "doc_id").filter("doc_id in (5, 6)").collect():
        for at in (0, 7, len(r["blocks"]) - 1):  # a block decodes from its byte offset alone
            b = r["blocks"][at]
            got, number, _ = flac.read_frames(bytes(r["media"]), np.array([b["byte_offset"]]), flac.BLOCK)
            assert (got[0] + 128).astype(np.uint8).tobytes() == bytes(b["pcm"]) and number[0] == at and b["sample_offset"] == at * flac.BLOCK
    blocks = flac.pcm(flac.media(odd).withColumn("media", F.when(F.col("doc_id") != 3, F.col("media"))))
    none = flac.read_back(blocks).filter("payload_sha256 is null")
    assert none.count() == 2 and blocks.filter("blocks is null").count() == 2  # also the null id
    torn = flac.pcm(flac.media(odd)).filter("doc_id = 6").withColumn("blocks", F.slice("blocks", 2, 3))
    with pytest.raises(Exception, match="gap"):
        flac.read_back(torn).collect()


# ---------------------------------------------------------------- pages


def article(page):
    a = page.index("<article>") + 9
    b = page.find("</article>")
    s = re.sub(r"<!--.*?-->", "", page[a : b if b >= 0 else len(page)], flags=re.S)
    parts = re.split(r"</?(?:p|h1)\b[^>]*>", s)
    blocks = [" ".join(unescape(re.sub(r"</?b>", "", re.sub(r"<br[^>]*>", " ", x))).split()) for x in parts]
    return "\n\n".join(x for x in blocks if x)


def test_extraction_query(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op1_html_extraction(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


@pytest.fixture(scope="module")
def weights():
    return html.learn()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>Caf&eacute; &amp; bar&nbsp;open<br>now</p>", "Café & bar open now"),
        ("<article><p>One two three.</p><div class='ad'>Buy now</div><p>Four.</p><section class='comments'><p>I liked it a lot, really.</p></section></article>", "One two three.\n\nFour."),
        ("<body><div class=sidebar>Links here</div><main><h1>Head</h1><p>Body of it<script>var x='<p>no</p>'</script></p><form>Your name</form></main><footer>End</footer>", "Head\n\nBody of it"),
        ("<article><header><h1>Kept title</h1></header><p>Text &lt;b&gt; is here</p></article><header>Site</header>", "Kept title\n\nText <b> is here"),
        ("plain words and nothing else", "plain words and nothing else"),
        ("<nav><a href=/>Home</a></nav>", ""),
        ("<!-- only -->", ""),
        ("<article><p>cut off in the mid", "cut off in the mid"),
        ("<article><ul><li><a href='/x'>linked item</a></li></ul></article>", "linked item"),
    ],
)
def test_extraction_cases(weights, page, want):
    assert html.extract_one(page, weights) == want


STORY = "The story goes on for many more words than any card beside it does."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<main><p>{STORY}</p></main><article><p>Read this too</p></article>", STORY),
        (f"<article><p>Read this too</p></article><p>or that</p><main><p>{STORY}</p></main>", STORY),
        (f"<main><p>Few words</p><article><p>{STORY}</p></article></main>", STORY),
        (f"<article class='post has-sidebar'><p>{STORY}</p></article>", STORY),
        (f"<article class='post comments-open'><p>{STORY}</p></article>", STORY),
        (f"<div role='main' class='with-sidebar'><p>{STORY}</p></div><aside>Links</aside>", STORY),
        (f"<div class='post no-comments'><p>{STORY}</p></div><div class='post-footer'>By them</div>", STORY),
        (f"<article><p>{STORY}</p></article><article class='comment'><p>I liked it</p></article>", STORY),
        (f"<p>{STORY}</p><div class='ad'>{'Buy this now. ' * 30}</div><p>{STORY}</p>", f"{STORY}\n\n{STORY}"),
        (f"<article><p>{STORY}</p></article><div class='ad'>{'Buy this now. ' * 30}</div><article><p>{STORY}</p></article>", f"{STORY}\n\n{STORY}"),
    ],
)
def test_extraction_finds_the_core_by_its_words(weights, page, want):
    assert html.extract_one(page, weights) == want


LINKS = "<a href=/>Some link</a> " * 10


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        (f"<article><p>{STORY}</p><div class='share-price'>{STORY}</div><div class='content-ad-free'>{STORY}</div><section class='related-work'>{STORY}</section></article>", 4),
        (f"<article><p>{STORY}</p></article><aside>{LINKS}</aside><article><p>{STORY}</p></article>", 2),
        (f"<div><div>Contact us</div><div><a href=/>Home</a></div></div><div>{STORY}</div><div>{STORY} {STORY}</div><div>Copyright 2020 All rights reserved</div>", 2),
        (f"<form action=/><div>{LINKS}</div><div class=content><p>{STORY}</p><p>{STORY}</p><p>{STORY}</p></div></form>", 3),
        (f"<p>{STORY}</p><p>{STORY}</p><p>{STORY}</p>" + "<div><a href=/>Another link of the page</a></div>" * 12 + f"<p>{STORY}</p>", 3),  # the scan leaves the last one out
    ],
)
def test_extraction_is_not_a_matter_of_words_in_classes(weights, page, blocks):
    assert html.extract_one(page, weights).count(STORY) == html.extract_one(page, weights).count("\n\n") + 1 + ("{0} {0}".format(STORY) in page)
    assert html.extract_one(page, weights).count("\n\n") + 1 == blocks


def test_weights_and_scan_decide(weights):
    page = f"<p>{STORY}</p><p>{STORY}</p>" + "<div><a href=/>Another link of the page</a></div>" * 12 + f"<p>{STORY}</p>"
    assert html.extract_one(page, html.Weights(np.zeros_like(weights.block), {})) == ""
    odds = html.features(html.parse(page)) @ weights.block
    assert (odds > 0).sum() == 3 and html.extract_one(page, weights).count(STORY) == 2


def test_best_region_equals_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(300):
        x = rng.integers(-5, 6, rng.integers(0, 14)).astype(float)
        first, end = html.best_region(x)
        sums = {(a, b): x[a:b].sum() for a in range(len(x)) for b in range(a + 1, len(x) + 1)}
        assert x[first:end].sum() == max([0.0, *sums.values()])


def test_labelled_pages_are_learned(weights):
    rng, right = random.Random(77), 0
    pages = [labelled.filled(t, rng) for t in labelled.TEMPLATES for _ in range(5)]  # words and lengths that were not learned
    for text in pages:
        spans = [(m.start(), text.find("<!--/-->", m.start())) for m in re.finditer(re.escape("<!--+-->"), text)]
        want = "\n\n".join(b.text for b in html.parse(text).blocks if any(a < b.at < (z if z >= 0 else len(text)) for a, z in spans))
        right += html.extract_one(text, weights) == want
    assert right >= 0.9 * len(pages)


@pytest.mark.parametrize("unit", ["<div>", "<a x='", "<a ", "</svg", "<", "</div>", "<article>", "<a x=\">", "<p><article><div></p>", "<a '\""])
def test_long_pages_take_linear_time(weights, unit):
    took = []
    for size in (1 << 18, 1 << 20):
        page = "<svg>" * (unit == "</svg") + unit * (size // len(unit)) + " words"
        began = time.process_time()
        html.extract_one(page, weights)
        took.append(time.process_time() - began)
    assert took[1] < 9 * took[0] + 0.5  # four times as long


def test_pages_null_and_empty(spark, weights):
    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", "", "x"), (2, "u", "<p>a b</p>", "x"), (2, "u", "<p>a b</p>", "x")], "page_id long, url string, html string, text string")
    got = sorted((r["text"], r["n_chars"]) for r in html.extract(df, weights).collect())
    assert got == [("", 0), ("", 0), ("a b", 3), ("a b", 3)]
    assert html.extract(df.limit(0), weights).count() == 0


# ---------------------------------------------------------------- licences


def test_licence_query_finds_planted_lines(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    marks = {"MIT License": "MIT", "Apache License": "Apache-2.0", "GNU General": "GPL", "CC BY-NC": "CC-BY-NC"}
    wrong = [r["doc_id"] for r in queries.op5_licence_scan(spark, "/root/testdata/sf0.01").collect() if r["families"] != ",".join(sorted({f for m, f in marks.items() if m in docs[r["doc_id"]]}))]
    assert wrong == []


def test_licences_of_odd_rows(spark, docs, none):
    text = "Some first line of words.\nReleased under the MIT License.\nAnd the last one. " + "word " * 200
    rows = [(-1, text), (-1, text), (-2, None), (-3, ""), (-4, "This licence is not a licence.")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text").limit(20))
    got = {r["doc_id"]: [x["family"] for x in r["licences"]] for r in licences.scan(odd).filter("doc_id < 0").collect()}
    assert got == {-1: ["MIT"], -2: [], -3: [], -4: []}
    assert licences.scan(none.select("doc_id", "text")).count() == 0
    clash = licences.scan(docs.select("doc_id", "text", F.lit(1).alias("n_windows"), F.lit(2).alias("p"), F.lit(3).alias("_likely")).limit(5))
    assert clash.columns == ["doc_id", "text", "p", "_likely", "n_windows", "licences"] and clash.count() == 5


WRAPPED = """/*
 * Copyright (c) 2020 Somebody
 *
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 */
int main() {}"""
HEADER = """# This library is free software; you can redistribute it and/or
# modify it under the terms of the GNU Lesser General Public
# License as published by the Free Software Foundation; either
# version 2.1 of the License, or (at your option) any later version."""
BOTH = "Released under the MIT License, or, as you wish, licensed under the Apache License, Version 2.0."


@pytest.fixture(scope="module")
def licensed(spark, docs):
    rows = [(-1, WRAPPED), (-2, HEADER), (-3, BOTH), (-4, "// SPDX-License-Identifier: Zlib"), (-5, "They studied at MIT, and the Apache license plate was new."), (-6, "Redistribution and use in source and binary\nforms, with or without modification, are\npermitted provided that the following\nconditions are met:"), (-7, "This is free and unencumbered software released into the public domain. " + "word and " * 300)]
    return spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))


def test_wrapped_and_rarer_notices(licensed):
    got = {r["doc_id"]: sorted({x["family"] for x in r["licences"]}) for r in licences.scan(licensed, ["doc_id"]).filter("doc_id < 0").collect()}
    assert got == {-1: ["MIT"], -2: ["LGPL"], -3: ["Apache-2.0", "MIT"], -4: ["Zlib"], -5: [], -6: ["BSD"], -7: ["Unlicense"]}


def test_licence_scores_equal_brute_force(spark, licensed):
    """Windows, n-grams, softmax, template shares and calibration, in plain Python."""
    work = licensed.filter("doc_id < 60").select(F.struct("doc_id").alias("_row"), F.col("text").alias("_text"))
    notices = licences.notice_grams(spark)
    model = licences.learn(work, notices)
    found = licences.likely(work, model, notices, ["_row"]).collect()
    texts = {r["_row"]["doc_id"]: r["_text"] for r in work.collect()}
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    ones = lambda ws: [brute.signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in ws]

    def hashes(ws):
        o = ones(ws)
        return set(o) | {brute.signed(brute.spark_xx(b, brute.spark_xx(a, 42))) for a, b in zip(o, o[1:])}

    assert {f: [set(x) for x in xs] for f, xs in notices.items()} == {f: [hashes(words(t)) for t in ts] for f, ts in licences.templates().items()}
    for r in found:
        text = texts[r["_row"]["doc_id"]]
        ws = [p[s : s + 64] for p in map(words, re.split(r"\n[\W_]*?\n", text or "")) if p for s in range(0, max(len(p) - 32, 1), 32)]
        assert r["n_windows"] == len(ws)
        seen = {x["window"]: x for x in r["_likely"]}
        for k, w in enumerate(ws):
            gs = hashes(w)
            active = [model.row[b] for b in {g % licences.BUCKETS for g in gs} if model.row[b]]
            e = np.exp([sum(own[x] for x in active) + bias for own, bias in zip(model.weights, model.intercepts)])
            p = e / e.sum()
            if k in seen:
                assert np.allclose(seen[k]["p"], p, atol=1e-6)
                assert np.allclose(seen[k]["held"], [max(len(gs & set(n)) / len(n) for n in notices[f]) for f in licences.FAMILIES])
            else:
                assert p[:-1].max() < p[-1] + 1e-6


def test_files_are_not_in_the_repository():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert not [f for d, _, files in os.walk(root) if ".git" not in d for f in files if f.endswith((".model", ".tiktoken"))]
