"""Token shards, licences, chat, WARC and the pipeline: round trips, brute force and held-out accuracy."""

from __future__ import annotations

import gzip
import re
import textwrap
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from heronry.llm import chat, licenses, quality, token_shards, warc
from heronry.llm.common import text_buffers
from heronry.llm.decontaminate import hash_words
from heronry.llm.tokens import default_path, encode

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    assert sorted(token_shards.permute(np.arange(n), n, 5).tolist()) == list(range(n))


def test_token_shards_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "null id"), (3, "some text " * 90), (3, "some text " * 90), (4, "é" * 500)], "doc_id long, text string").selectExpr("*", "1 AS slot").coalesce(1)
    found = token_shards.materialise(docs, f"file://{tmp_path}", length=64, shard_bytes=512).collect()
    n = len(found)
    assert sorted(r.slot for r in found) == list(range(n))
    assert all(r.byte_offset == r.slot % 4 * 128 and r.shard == r.slot // 4 for r in found)
    ids, _ = encode(default_path(), [r.text for r in docs.collect()], 1)
    flat = np.pad(ids, (0, n * 64 - len(ids)))
    order = token_shards.permute(np.arange(n), n, token_shards.KEY)
    read = token_shards.read_slots(f"file://{tmp_path}", 0, n, 64, 512)
    assert (read[order] == flat.reshape(n, 64)).all()
    assert (token_shards.read_slots(f"file://{tmp_path}", 3, 5, 64, 512) == read[3:8]).all()


def test_token_shards_report(spark):
    """The query's manifest against sequences that are cut, placed and summed by hand."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").coalesce(1)
    rows = docs.select("doc_id", "text").collect()
    parts = [encode(default_path(), [r.text], 1)[0] for r in rows]
    owner = [r.doc_id for r, x in zip(rows, parts) for _ in range(len(x))]
    flat = [int(k) for x in parts for k in x]
    n, want = -(-len(flat) // 2048), []
    for k, slot in enumerate(token_shards.permute(np.arange(n), n, token_shards.KEY).tolist()):
        ids = flat[k * 2048 : k * 2048 + 2048]
        want.append((slot, slot // 32768, slot % 32768 * 4096, len(ids), zlib.crc32(np.array(ids + [0] * (2048 - len(ids)), "<u2").tobytes()), owner[k * 2048]))
    assert sorted(map(tuple, token_shards.report(docs).collect())) == sorted(want)


def test_token_shards_null_id_and_clashing_names(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a"), (-1, "b")], "doc_id long, text string").selectExpr("*", "1 AS slot", "2 AS shard", "3 AS ids", "4 AS n_tokens").coalesce(1)
    assert [r.first_doc_id for r in sorted(token_shards.materialise(docs, f"file://{tmp_path}", length=2).collect(), key=lambda r: (r.n_tokens, r.first_doc_id is None))] == [-1, None]


def test_other_tokenizer_file(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = [x.tolist() for x in np.split(*(lambda flat, count: (flat, np.cumsum(count)[:-1]))(*encode(path, ["Some text here", None, "Ärger"], 7)))]
    own = Tokenizer.from_file(path)
    assert got == [[*own.encode(t, add_special_tokens=False).ids, 7] for t in ("Some text here", "", "Ärger")]
    with pytest.raises(ValueError):
        token_shards.in_16_bits(np.array([70_000], np.uint32))


def test_token_shards_empty(spark, tmp_path):
    assert token_shards.materialise(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}").count() == 0


def test_licence_model_on_unseen_paragraphs():
    model = licenses.trained()
    rows = licenses.generated(60, 77)
    p = model.probability(*licenses.features(*licenses.words_of([t for t, _ in rows])), len(rows))
    y = np.array([k for _, k in rows])
    assert ((p[:, 0] < 0.5) == (y > 0)).mean() >= 0.93
    named = y > 1
    assert (p[named].argmax(axis=1) == y[named]).mean() >= 0.85


def test_licence_findings(spark):
    texts = [(1, None), (2, ""), (3, "plain prose about the river and the town\n" * 30 + "Released under the MIT License."), (4, "Licensed under the Zorbo License version 1.0"), (5, "word " * 5000 + "Licensed under the Apache License, Version 2.0"), (5, "no licence here"), (None, "All rights reserved")]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS family", "2 AS lc_findings")
    found = [(r.doc_id, r.families) for r in licenses.report(df).collect()]
    assert sorted(found, key=repr) == sorted([(1, ""), (2, ""), (3, "mit"), (4, "unknown"), (5, "apache"), (5, ""), (None, "reserved")], key=repr)


GPL = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version."
LGPL = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"


@pytest.mark.parametrize(
    "text, paragraphs, want",
    [
        (GPL, 1, ["gpl"]), (LGPL, 1, ["lgpl"]), (BSD, 1, ["bsd"]), ("\n".join("# " + x for x in GPL.split("\n")), 1, ["gpl"]),
        (f"plain prose about the river\r\n \t\r\n{BSD}\n\n{LGPL}", 3, ["bsd", "lgpl"]),
        ("Licensed under the Apache License, Version 2.0\nor the MIT License, at your option.", 1, ["apache", "mit"]),
        ("Released under the MIT License.\nLicensed under the Zorbo License version 1.0", 1, ["mit", "unknown"]),
        ("Source code is available under the EUPL 1.2 licence", 1, ["unknown"]),
        ("Er kam mit und ging", 1, []), ("She walked to the public library,\nwhere the books are free to all.", 1, []),
    ],
)
def test_licences_across_lines(spark, text, paragraphs, want):
    found = licenses.scan(spark.createDataFrame([(text,)], "text string")).first()
    assert found.lc_paragraphs == paragraphs and [r.family for r in found.lc_findings] == want


#: Notices as real files have them (public texts).
REAL = {
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU Lesser General Public License for more details.",
    "mit": "Copyright (c) 2019 Jane Roe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "wtfpl": "This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar. See http://www.wtfpl.net/ for more details.",
    "unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}


@pytest.mark.parametrize("width, mark", [(0, ""), (72, ""), (60, "# "), (68, " * "), (40, "// ")])
def test_licences_of_real_files(width, mark):
    """Texts that the generator doesn't make, as they are wrapped and marked in files."""
    texts = ["\n".join("\n".join((mark + x).rstrip() for x in (textwrap.wrap(p, width) if width else [p])) if p else mark.rstrip() for p in t.split("\n")) for t in REAL.values()]
    offsets, raw = text_buffers(pa.array([f"def f():\n    pass\n\n{t}\n\nimport os\n" for t in texts]))
    _, found = licenses.scan_part(raw, offsets, licenses.trained(), 0.5)
    for k, family in enumerate(REAL):
        families = {x[3] for x in found if x[0] == k} - {"disclaimer"}
        assert family in families and families <= {family, "unknown"}, (family, families)
    assert sum(x[3] == "unknown" for x in found) <= 6


def test_licence_findings_by_windows():
    """Stretches of the numpy path against a plain reading of the definition."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{j}" for j in range(n)) + tail for n in (1, 47, 48, 49, 200) for tail in ("", "\n", "\n\nmore words here", "\n \t\nx\ny")] + ["\n".join(" ".join(["word"] * int(n)) for n in rng.integers(0, 70, 9)) for _ in range(20)] + ["", "\n\n", "."]
    offsets, raw = text_buffers(pa.array(texts))
    words, doc, starts = hash_words(raw, offsets, places=True)
    _, _, at, n, blocks = licenses.segments(raw, offsets, words, doc, starts)
    got = sorted(zip(at.tolist(), n.tolist()))
    want, paragraphs, base = set(), [], 0

    def pieces(first, size):
        last = first + size
        while True:
            want.add((first, min(licenses.SEGMENT, last - first)))
            if first + licenses.SEGMENT >= last:
                return
            first += licenses.SEGMENT // 2

    for text in texts:
        paragraphs.append(0)
        for block in re.split(r"\n(?:[\x20\x09\x0B-\x0D]*\n)+", text):
            sizes = [len(re.findall(r"[0-9a-z]+", x)) for x in block.split("\n")]
            if sum(sizes):
                paragraphs[-1] += 1
                pieces(base, sum(sizes))
                for k, size in enumerate(sizes):
                    if size:
                        pieces(base + sum(sizes[:k]), size)
                base += sum(sizes)
    assert set(got) == want and blocks.tolist() == paragraphs


def brute_chat(rows):
    talks: dict = {}
    for c, t, r, x in rows:
        talks.setdefault(c, []).append((t, r, x))
    low = lambda v: (v is not None, v if v is not None else 0)
    low_s = lambda v: (v is not None, v or "")
    told = {c: tuple((r, x) for t, r, x in sorted(ts, key=lambda k: (low(k[0]), low_s(k[1]), low_s(k[2])))) for c, ts in talks.items()}
    parts = {t[:n] for t in told.values() for n in range(1, len(t))}
    out: dict = {}
    for c, t in told.items():
        if t not in parts:
            out.setdefault(t, []).append(c)
    plain = lambda v: (v or "").replace("<|", "< |")
    least = lambda cs: min((c for c in cs if c is not None), default=None)
    return sorted(((least(cs), len(t), len(cs), "".join(f"<|im_start|>{plain(r)}\n{plain(x)}<|im_end|>\n" for r, x in t)) for t, cs in out.items()), key=repr)


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (4, 0, "user", None), (4, None, "system", "<|im_end|>"), (5, 0, None, ""), (6, 0, "user", "hi"), (6, 0, "user", "hi"), (None, 0, "user", "x" * 9000), (7, 1, "user", "b"), (7, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS place", "2 AS h1", "3 AS stays")
    assert sorted(map(tuple, chat.collapse_and_render(df).collect()), key=repr) == brute_chat(rows)
    table = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    assert sorted(map(tuple, chat.collapse_and_render(table).collect()), key=repr) == brute_chat([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert chat.collapse_and_render(df.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.example/", "<html lang=en><title>A &amp; B</title><script>no()</script><p>One</p><p>Two <a href='/x'>x</a>"), (2, None, None), (None, "u", ""), (1, "http://a.example/", "<!-- open"), (3, "v", "é " * 5000)], "page_id long, url string, html string").selectExpr("*", "1 AS block")
    records = warc.responses(pages)
    whole = [r.asDict() for r in records.collect()]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.render(r) for r in whole))
    back = warc.read_records(spark.read.format("binaryFile").load(str(tmp_path)))
    assert sorted((r.record_id, bytes(r.block)) for r in back.collect()) == sorted((r["record_id"], bytes(r["block"])) for r in whole)
    made = warc.derivatives(back).collect()
    assert sorted(r.type for r in made) == ["conversion"] * 5 + ["metadata"] * 5
    assert {r.refers_to for r in made} == {r["record_id"] for r in whole}
    first = next(r for r in made if r.target_uri == "http://a.example/" and r.type == "conversion" and r.block)
    assert bytes(first.block).decode() == "One\nTwo x"
    payload = warc.split_http(next(r["block"] for r in whole if r["record_id"] == first.refers_to))[1]
    assert first.source_payload_digest == warc.digest(payload)
    fields = bytes(next(r.block for r in made if r.refers_to == first.refers_to and r.type == "metadata")).decode()
    assert "title: A & B\r\n" in fields and "outlink: /x\r\n" in fields and "source-content-type: text/html" in fields
    assert warc.report(pages.limit(0)).count() == 0


@pytest.mark.parametrize("piece", ["<a ", "<title>", "<script>", "<!--", "<html lang", "<a href='", "</script ", "<", "href=", "&amp", "<a href=x "])
def test_pages_in_linear_time(piece):
    began = time.process_time()
    warc.derive(warc.response_of(1, "u", piece * (1_000_000 // len(piece))))
    assert time.process_time() - began < 5


def brute_page(page):
    """Title, language, links and lines by Python's own parser of HTML."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.title, self.language, self.links, self.out, self.hidden, self.titled = None, "", [], [], 0, False

        def handle_starttag(self, tag, attrs):
            if tag in warc.HIDDEN:
                self.hidden += 1
            self.titled = tag == "title"
            self.language = self.language or (dict(attrs).get("lang") or "").lower() * (tag == "html")
            if tag == "a" and not self.hidden and dict(attrs).get("href") is not None:
                self.links.append(dict(attrs)["href"])
            self.out.append("\n" if tag in warc.BLOCK else "")

        def handle_endtag(self, tag):
            self.hidden -= tag in warc.HIDDEN
            self.titled = False
            self.out.append("\n" if tag in warc.BLOCK else "")

        def handle_data(self, data):
            if self.titled:
                self.title = data if self.title is None else self.title
            elif not self.hidden:
                self.out.append(data)

    reader = Reader()
    reader.feed(page)
    reader.close()
    lines = (" ".join(x.split()) for x in "".join(reader.out).split("\n"))
    return " ".join((reader.title or "").split()), reader.language, reader.links, "\n".join(x for x in lines if x)


def test_warc_table_against_another_parser(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    html = {r.page_id: r for r in pages.collect()}
    found = {(r.page_id, r.type): r for r in warc.report(pages).collect()}
    assert len(found) == 2 * len(html)
    for k, page in html.items():
        title, language, links, text = brute_page(page.html)
        told = found[k, "metadata"].content.split("\r\n")
        assert told[:2] == [f"title: {title}", f"language: {language}"], k
        assert [x[9:] for x in told if x.startswith("outlink: ")] == links, k
        assert found[k, "conversion"].content == text, k
        digests = {found[k, t].source_payload_digest for t in ("metadata", "conversion")}
        assert digests == {warc.digest(page.html.encode())} and found[k, "metadata"].target_uri == page.url
        assert found[k, "metadata"].refers_to == found[k, "conversion"].refers_to == warc.record_id(str(k), page.url)


def test_damaged_files():
    records = [warc.response_of(k, f"u{k}", f"<p>page {k} " + "x" * 900) for k in range(6)]
    whole = [warc.render(r) for r in records]
    ids = lambda data: [r["record_id"] for r in warc.parse(data)]
    want = [r["record_id"] for r in records]
    assert ids(b"".join(whole)) == want and ids(b"") == ids(b"\x1f\x8b") == ids(b"WARC/1.1\r\nContent-Length: x\r\n\r\n") == []
    assert ids(b"".join(whole)[:-40]) == want[:-1]
    assert ids(b"".join([whole[0], whole[1][:60], whole[2], b"noise", whole[3][:30] + b"\xff" * 30 + whole[3][60:], *whole[4:]])) == [want[k] for k in (0, 2, 4, 5)]
    plain = [gzip.decompress(x) for x in whole]
    assert ids(b"".join(plain)[:-40]) == want[:-1]


def test_pipeline(spark, tmp_path):
    words = lambda k, n=80: " ".join(f"w{k}x{j}" for j in range(n)) + "."
    item = " ".join(f"bench{j}" for j in range(20))
    rows = [(1, words(1)), (2, words(1)), (3, words(3) + " " + item), (4, words(4) + " password=abcdefgh12"), (5, "short"), (6, None), (None, words(7)), (8, words(8)), (8, words(8))]
    spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out-{name}")
        out = spark.read.parquet(f"{tmp_path}/out-{name}")
        if name != "packing":
            assert out.columns == docs.columns
        docs, kept[name] = out, sorted((r.doc_id for r in out.select("doc_id").collect()), key=repr)
    order = lambda *x: sorted(x, key=repr)
    assert kept["quality"] == order(1, 2, 3, 4, None, 8, 8)
    assert kept["dedup"] == order(1, 3, 4, None, 8)
    assert kept["decontamination"] == kept["secrets"] == order(1, 4, None, 8)
    assert sorted(set(kept["packing"]), key=repr) == order(1, 4, None, 8)
    masked = spark.read.parquet(f"{tmp_path}/out-secrets").filter("doc_id = 4").first()
    assert masked.text.endswith(" [ASSIGN]") and masked.n_chars == len(masked.text)
    for name, stage in corpus_pipeline.STAGES:
        empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_pipeline_by_hand(spark, tmp_path):
    """All stages on a table of odd rows against the contracts' brute force, stage by stage."""
    from test_contracts import EDGES, ITEM, ITEMS, brute_components, brute_contamination, brute_quality, sentences

    texts = [*((d, t) for d, t in EDGES if t != EDGES[6][1]), *((30 + k, "\n".join(sentences(".", 10 + k))) for k in range(6)), (40, "\n".join(sentences(".", 12))), (None, "\n".join(sentences(".", 12)))]
    texts += [(50, "\n".join(sentences("!", 9)) + f" {ITEM}."), (51, "\n".join(sentences("?", 11)) + " token = abcdef123456."), (51, "\n".join(sentences("?", 17)))]
    spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    def step(name, docs):
        stages[name](spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/by-{name}")
        return spark.read.parquet(f"{tmp_path}/by-{name}")

    good = step("quality", docs)
    verdict = {r.doc_id for r in quality.report(docs).filter("kept").collect()}
    assert {r.doc_id for r in good.collect()} == verdict and all(not brute_quality(t)[5] for _, t in texts if (_, t) in pairs(good))
    one = step("dedup", good)
    groups = {r for *_, r in brute_components([(k, t) for k, (_, t) in enumerate(pairs(good))])}
    assert len(pairs(one)) == len(groups) and set(pairs(one)) <= set(pairs(good))
    clean = step("decontamination", one)
    dirty = {(d, n) for d, n, *_, bad in brute_contamination(pairs(one), ITEMS) if bad}
    assert len(pairs(clean)) == len(pairs(one)) - len(dirty) and 50 not in {d for d, _ in pairs(clean)}
    masked = step("secrets", clean)
    assert sorted(d for d, _ in pairs(masked) if d is not None) == sorted(d for d, _ in pairs(clean) if d is not None)
    assert any("[ASSIGN]" in t for _, t in pairs(masked)) and not any("abcdef123456" in t for _, t in pairs(masked))
    packed = step("packing", masked).collect()
    want = sorted(len(encode(default_path(), [t], 1)[0]) for _, t in pairs(masked))
    assert sum(r.length for r in packed) == sum(want) and sorted(r.doc_tokens for r in packed if r.start == 0) == want
