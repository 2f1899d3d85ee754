"""The ten operators on a small table of hard cases, each against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import (
    language_id,
    license_scan,
    line_dedup,
    media_columns,
    mixing,
    ngram_join,
    packing,
    spot_signatures,
    substring_dedup,
    toxicity,
)

LOW = -(1 << 63)
LONG_TEXT = " ".join(f"word{i}" for i in range(60))


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def brute_components(rows, k, percent):
    sets = []
    for _, text, *_ in rows:
        words = (text or "").encode().lower().split()
        size = min(k, len(words))
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(rows[i][0])
    least = {r: min((m for m in ms if m is not None), default=None) for r, ms in members.items()}
    return Counter((rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows)))


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_ngram_join(docs, rows, k, percent):
    found = ngram_join.components(docs, k, percent)
    assert Counter(map(tuple, found.collect())) == brute_components(rows, k, percent)
    assert ngram_join.components(docs.limit(0), k, percent).count() == 0


def test_one_of_each_group_stays(spark, docs, rows):
    """Rows of one id are told apart by their texts; equal rows and near copies leave one."""
    texts = {1: LONG_TEXT, 2: LONG_TEXT + " end"}
    frame = spark.createDataFrame(
        [(1, texts[1], 0), (2, texts[2], 1), (2, "quite another text of id two", 2), (2, "quite another text of id two", 3), (None, texts[1], 4),
         (None, "a text without an id", 5), (3, None, 6), (3, None, 7), (4, "", 8), (5, "short", 9), (6, "Short", 10)],
        "doc_id long, text string, _tie int",
    )
    found = Counter((r["doc_id"], r["text"]) for r in ngram_join.without_copies(frame).collect())
    assert found == Counter([(1, texts[1]), (2, "quite another text of id two"), (None, "a text without an id"), (3, None), (3, None), (4, ""), (5, "short")])
    kept = ngram_join.without_copies(docs)
    assert kept.columns == docs.columns and ngram_join.without_copies(docs.limit(0)).count() == 0


def test_sketches_never_differ_more_than_sets():
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (1, 3, 63, 64, 65, 500, 3_000):
        whole = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        other = np.unique(np.r_[whole[n // 7 :], rng.integers(0, 2**63, n // 9 + 1, dtype=np.uint64)])
        a, b = sorted((ngram_join.sketch_of(whole), ngram_join.sketch_of(other)), key=len)
        while len(b) > len(a):
            b = b[: len(b) // 2] ^ b[len(b) // 2 :]
        differ = int(np.unpackbits((a ^ b).view(np.uint8)).sum())
        assert differ <= len(np.setxor1d(whole, other))


def test_ngram_join_of_frequent_tokens(spark, monkeypatch):
    """A large group of near copies: all tokens are frequent, lists are long, blocks are small."""
    monkeypatch.setattr(ngram_join, "FREQUENT_PLUS", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for d in range(60):
        words = list(base)
        for j in range(d % 7):
            words[(d * 31 + j * 17) % 120] = f"e{d}-{j}"
        rows.append((d, " ".join(words)))
    found = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80)
    assert Counter(map(tuple, found.collect())) == brute_components(rows, 3, 80)


def test_prefixes_share_a_key():
    """Sets that are similar enough share a key, whatever tokens are frequent."""
    import numpy as np

    rng = np.random.default_rng(1)
    for percent in (60, 80, 90):
        for trial in range(60):
            counts = np.where(rng.random(1 << ngram_join.CLASS_BITS) < rng.choice([0.0, 0.5, 1.0]), 10_000, 1).astype(np.uint32)
            made = ngram_join.Prefixes(counts, percent)
            made.frequent = 100.0
            a = np.unique(rng.integers(0, 2**63, int(rng.integers(4, 400))).astype(np.uint64))
            drop = int(len(a) * (100 - percent) / 100 * rng.random())
            b = np.sort(rng.permutation(a)[drop:])
            if 100 * len(b) >= percent * len(a) and len(b) >= made.least and len(a) > len(b):
                assert len(np.intersect1d(made.keys(a), made.keys(b)))


def plain_chains(text):
    """Anchors with the two content words that follow each, spelled out; anchors by the words' own rule."""
    import xxhash

    words = []
    for w in (text or "").encode().split():
        bare = w.lower().strip(b".,;:!?\"'()[]{}*#$%&|<>-_") or w
        anchor = bare.decode() in spot_signatures.COMMON or (xxhash.xxh3_64_intdigest(bare) >> 1) % 32 == 0
        words.append((bare, anchor))
    out = set()
    for i, (w, anchor) in enumerate(words):
        after = [x for x, a in words[i + 1 :] if not a][:2]
        if anchor and len(after) == 2:
            out.add((w, *after))
    return out or ({tuple(w for w, _ in words)} if words else set())


def test_signatures_are_chains_after_anchors(rows):
    texts = [t for _, t, *_ in rows if t] + ["the cat sat on a mat, and THE dog lay by (the) door", "of the and", "cat dog", "the cat"]
    texts += [texts[-4].replace("dog", "fox"), "la maison de mon père est à côté du jardin de ma mère"]
    chains, signed = [plain_chains(t) for t in texts], [spot_signatures.signatures(t) for t in texts]
    assert [len(s) for s in signed] == [len(c) for c in chains]
    for a, x in zip(chains, signed, strict=True):
        for b, y in zip(chains, signed, strict=True):
            if all(len(c) > 1 or any(len(k) == 3 for k in c) for c in (a, b)):
                assert spot_signatures.likeness(x, y) == len(a & b) / len(a | b)


def test_fingerprints(docs, rows):
    found = spot_signatures.fingerprint_documents(docs).collect()
    assert len(found) == len(rows)
    ordered = sorted(rows, key=lambda r: LOW if r[0] is None else r[0])
    by_id = Counter(r[0] for r in rows)
    for k, (doc_id, text, *_) in enumerate(ordered):
        if by_id[doc_id] > 1 or by_id[ordered[(k + 1) % len(rows)][0]] > 1:
            continue
        mine, following = text or "", ordered[(k + 1) % len(rows)][1] or ""
        cut = len(mine) // 4
        changed = mine[: len(mine) - cut] + following[:cut]
        row = next(r for r in found if r["doc_id"] == doc_id)
        signs = spot_signatures.signatures
        assert (row["n_chars"], row["edited_sha256"]) == (len(mine), sha(changed))
        assert row["fingerprint"] == spot_signatures.as_text(signs(mine))
        assert row["edited_fingerprint"] == spot_signatures.as_text(signs(changed))
        assert row["near_edited"] == spot_signatures.likeness(signs(mine), signs(changed))
        assert row["near_next"] == spot_signatures.likeness(signs(mine), signs(following))
    assert spot_signatures.fingerprint_documents(docs.limit(0)).count() == 0


def test_near_pairs(spark):
    texts = [" ".join(f"the c{i} d{i}" for i in range(k, k + 40)) for k in (0, 1, 2, 3, 30, 60, 60)]
    prints = [(i, spot_signatures.as_text(spot_signatures.signatures(t))) for i, t in enumerate(texts)] + [(99, ""), (98, None)]
    frame = spark.createDataFrame(prints, "doc_id long, fingerprint string")
    found = {(r["low"], r["high"]) for r in spot_signatures.near_pairs(frame, 0.8).collect()}
    signs = [spot_signatures.signatures(t) for t in texts[:6]]
    wanted = {(i, j) for i in range(6) for j in range(i + 1, 6) if spot_signatures.likeness(signs[i], signs[j]) >= 0.8}
    assert found == wanted and wanted
    assert spot_signatures.near_pairs(frame.limit(0)).count() == 0


def test_media(docs, rows):
    found = media_columns.document_media(docs).collect()
    wanted = Counter()
    for doc_id, text, *_ in rows:
        payload = (text or "").encode()
        padded = payload + bytes(-len(payload) % 64 or (0 if payload else 64))
        stored = media_columns.encode_media(payload)
        assert media_columns.decode_media(stored) == padded
        wanted[doc_id, len(payload), len(padded), sha(padded), zlib.crc32(padded[-64:]), len(stored), sha(stored)] += 1
    assert Counter(tuple(r)[:7] for r in found) == wanted
    texts = defaultdict(list)
    for doc_id, text, *_ in rows:
        texts[doc_id, len((text or "").encode())].append(text or "")
    for r in found:
        assert r["caption"] == f"{r['n_bytes']} bytes"
        own = texts[r["doc_id"], r["n_bytes"]]
        assert r["pos"] in {int(bool(t[: (t.find(" ", len(t) // 2) + 1) or len(t)].split())) for t in own}
        assert r["feature"] in {brute_feature(t) for t in own}
    assert media_columns.document_media(docs.limit(0)).count() == 0


def brute_feature(text):
    """Mean, variance and block signs by plain loops over the samples."""
    samples = list(text.encode())
    samples += [0] * (-len(samples) % 64 or (0 if samples else 64))
    n = len(samples)
    mean = sum(samples) * 1000 // n
    var = (sum(x * x for x in samples) * n - sum(samples) ** 2) // (n * n)
    edges = [int(n * k / 64) for k in range(65)]
    bits = "".join(str(int(sum(samples[a:b]) * 1000 // max(1, b - a) > mean)) for a, b in zip(edges, edges[1:], strict=False))
    return f"rows={n // 64};mean={mean};var={var};hash={int(bits, 2):016x}"


def test_media_pages_keep_their_text(spark, docs, rows):
    """Text, media and captions of the pages in order, with columns of clashing names."""
    pages = media_columns.document_pages(docs).selectExpr("*", "1 AS pos", "2 AS ref", "3 AS caption", "4 AS _item", "5 AS _html", "6 AS sequence")
    found = media_columns.interleave(pages).collect()
    texts = Counter((r[0], " ".join((r[1] or "").split())) for r in rows)
    assert Counter((r["doc_id"], " ".join(x["text"] for x in r["sequence"] if x["kind"] == "text")) for r in found) == texts
    refs = media_columns.references(media_columns.interleave(pages))
    assert refs.columns == ["doc_id", "n_bytes", "_item", "_html", "pos", "ref", "caption"] and refs.count() == 2 * len(rows)
    stored = media_columns.store_media(docs)
    assert stored.select("ref").distinct().count() == len({r[1] or "" for r in rows})
    joined = media_columns.resolve(refs, stored).collect()
    for r in joined:
        if r["ref"] == "/icon.png":
            assert r["media"] is None and r["caption"] == "icon"
        else:
            assert sha(bytes(r["media"])) == r["ref"] and len(media_columns.decode_media(bytes(r["media"]))) >= r["n_bytes"]


def test_interleaved_html():
    page = "a &amp; <b>b</b><figure><img src=x alt=q><img src=y><figcaption>c <i>d</i></figcaption></figure><script>no</script>e<img src=z alt=w><p>"
    found = media_columns.parse_interleaved(page)
    assert [(x["kind"], x["text"] or x["ref"], x["caption"]) for x in found] == [
        ("text", "a & b", None),
        ("media", "x", "c d"),
        ("media", "y", "c d"),
        ("text", "e", None),
        ("media", "z", "w"),
    ]
    assert [x["pos"] for x in found] == list(range(5))
    assert media_columns.parse_interleaved(None) == media_columns.parse_interleaved("<!-- x --><p>") == []
    told = lambda page: [(x["text"] or x["ref"], x["caption"]) for x in media_columns.parse_interleaved(page)]
    assert told("<figure><img src=x><figcaption>c<p>d</figure>e") == [("x", "c d"), ("e", None)]
    assert told("<figure><table>x</table><figcaption>abc</figcaption></figure>") == [("x", None), ("abc", None)]
    assert told("<figure><img src=x><figure><img src=y><figcaption>in</figcaption></figure><figcaption>out</figcaption></figure>") == [("x", "out"), ("y", "in")]
    assert told("a<figcaption>b") == [("a", None), ("b", None)]
    assert told("<figure><img src=x><figcaption>one<figure><img src=y>z") == [("x", "one"), ("y", None), ("z", None)]
    assert told("a<br>b<script/>c") == [("a bc", None)] and told("<script>no") == []


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer_path())
    rows = [*rows, (50, "hello <|endoftext|> world", None, None), (51, "<|endoftext|>", None, None)]
    more = docs.sparkSession.createDataFrame([r[:2] for r in rows[-2:]], "doc_id long, text string")
    pieces = packing.pack_documents(docs.unionByName(more, allowMissingColumns=True), seq_len=64).collect()
    ids = sorted((r[0] if r[0] is not None else LOW, plain.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in rows)
    assert (50, [31373, 220, 50256, 995, 0]) in ids
    stream = defaultdict(bytes)
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] * 4 == len(stream[p["sequence_id"]]) and p["ids_crc32"] == zlib.crc32(p["ids"])
        assert p["length"] * 4 == len(p["ids"]) and p["length"] > 0
        stream[p["sequence_id"]] += p["ids"]
    sizes = [len(stream[i]) // 4 for i in sorted(stream)]
    assert sorted(stream) == list(range(len(stream))) and set(sizes[:-1]) == {64} and sum(sizes) == sum(len(i) for _, i in ids)
    placed = defaultdict(list)  # a document's pieces follow each other in the whole stream
    whole = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    for p in whole:
        if p["start"] == 0:
            placed[p["doc_id"]].append(b"")
        assert 4 * p["start"] == len(placed[p["doc_id"]][-1])
        placed[p["doc_id"]][-1] += p["ids"]
        assert p["start"] + p["length"] <= p["doc_tokens"]
    wanted = Counter((None if d == LOW else d, packing.pack_ids(x)) for d, x in ids)
    assert Counter((d, x) for d, xs in placed.items() for x in xs) == wanted
    assert packing.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  a", "a  b", "\n\n x", "it's I'LL 'tis", "<|endoftext|> x", "a<|endoftext|>", "<|endoftext |> b", "漢字 テスト　z", "½ ² a1b2", "tab\ta\r\nb", " lead trail ", "😀 😀x", "a.. b, c.", "é. f"])
def test_ids_are_the_tokenizers(text):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer_path()
    plain = Tokenizer.from_file(path)
    assert packing.encoder(path).encode([text])[0] == packing.pack_ids(plain.encode(text, add_special_tokens=False).ids)


def test_license_scan(docs, spark):
    import duckdb

    texts = ["Released under the MIT License.", "x. Licensed under CC BY-NC 4.0!\nAll rights reserved", None, "", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. The above copyright notice and this permission notice shall be included in all copies. THE SOFTWARE IS PROVIDED \"AS IS\", without warranty of any kind."]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in license_scan.scan_licenses(frame).collect()}
    assert [found[i]["licenses"] for i in range(5)] == ["MIT", "CC-BY-NC-4.0|LicenseRef-all-rights-reserved", "", "", "MIT"]
    assert found[4]["n_sentences"] == 3 and found[2]["primary_license"] is None
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    columns = ["doc_id", "n_sentences", "sentence_ids", "licenses", "primary_license"]
    wanted = con.sql(f"select {', '.join(columns)} from ({license_scan.oracle()}) order by 1").fetchall()
    assert [tuple(found[i][c] for c in columns) for i in range(5)] == wanted
    assert license_scan.scan_licenses(docs).count() == docs.count() and license_scan.scan_licenses(docs.limit(0)).count() == 0


def test_license_scan_of_each_sentence(spark):
    import duckdb

    texts = [(i, f"Some words. {s.upper()}") for i, (_, s) in enumerate(license_scan.SENTENCES)]
    found = license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["sentence_ids"] for r in found] == [i for i, _ in license_scan.SENTENCES] and {r["n_sentences"] for r in found} == {1}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", texts)
    assert [tuple(r) for r in found] == con.execute(f"select * from ({license_scan.oracle()}) order by 1").fetchall()


MIT = """MIT License

Copyright (c) 2020 A. Holder

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD_2 = """Copyright (c) 2020, A. Holder

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{more}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
BSD_3 = BSD_2.format(
    more="""
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
)
BSD_2 = BSD_2.format(more="")
APACHE = """Copyright 2020 A. Holder

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{stop} either version {version} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""


def test_license_scan_of_whole_licences(spark):
    import re

    import duckdb

    whole = {
        "MIT": (MIT, 4),
        "BSD-2-Clause": (BSD_2, 5),
        "BSD-3-Clause": (BSD_3, 6),
        "Apache-2.0": (APACHE, 4),
        "GPL-3.0-or-later": (GPL.format(mark=":", stop=",", version=3), 4),
        "GPL-2.0-or-later": (GPL.format(mark=";", stop=";", version=2), 4),
    }
    forms = [
        lambda t: t,
        lambda t: "\n\n".join(re.sub(r"\s+", " ", p).strip() for p in t.split("\n\n")),
        lambda t: re.sub(r"\s+", " ", t),
        lambda t: "/*\n" + "".join(f" * {x}".rstrip() + "\n" for x in t.split("\n")) + " */\ncode()",
        lambda t: "".join(f"# {x}".rstrip() + "\r\n" for x in t.split("\n")),
        lambda t: "Prose before. " + t + "\nProse after it\nReleased under the MIT License.",
    ]
    texts, wanted = [], []
    for name, (text, n) in whole.items():
        for k, form in enumerate(forms):
            if k == 2 and not name.startswith("GPL"):
                continue  # one line joins headings and addresses with sentences
            texts.append(form(text))
            wanted.append((n + (k == 5), "|".join(sorted({name, *(["MIT"] if k == 5 else [])})), name))
    texts = list(enumerate(texts))
    found = license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id").collect()
    for (_, text), row, (n, names, first) in zip(texts, found, wanted, strict=True):
        assert (row["n_sentences"], row["licenses"], row["primary_license"]) == (n, names, first), (row, text)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", texts)
    assert [tuple(r) for r in found] == con.execute(f"select * from ({license_scan.oracle()}) order by 1").fetchall()


def test_toxicity(spark, docs):
    clean = [f"good words here {i % 17} and there. More of it {i % 5}. Fine." for i in range(120)]
    bad = [f"good words here {i % 17} and there. You vile toad {i % 5}! Fine." for i in range(60)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(clean + bad)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 120)) for i in range(180)] + [(901, None), (5000, 1)], "doc_id long, toxic int")
    weights = toxicity.train(frame, labels)
    found = {r["doc_id"]: r for r in toxicity.score(frame, weights).collect()}
    out = [i for i in range(180) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((found[i]["score"] >= 0.7) == (i >= 120) == bool(found[i]["predicted"]) for i in out)
    assert all(found[i]["worst_sentence"] == 1 for i in out if i >= 120)
    assert 0 <= found[900]["score"] < 0.5 and found[900]["score"] == found[901]["score"]
    assert toxicity.score(docs, weights).count() == docs.count()
    nothing = toxicity.train(frame.limit(0), labels.limit(0))
    assert nothing.words == {} and toxicity.score(docs.limit(0), nothing).count() == 0


def test_noisy_or_by_hand():
    weights = toxicity.Weights({b"bad": 3.0}, -2.0)
    sig = lambda z: 1 / (1 + 2.718281828459045**-z)
    score, worst, own = toxicity.score_text("All ok. So bad! Bad again.", weights, toxicity._Lookup(weights))
    assert abs(score - (1 - (1 - sig(-2)) * (1 - sig(1)) ** 2)) < 1e-9 and worst == 1 and abs(own - sig(1)) < 1e-9


def brute_noisy_or(text, weights):
    """Sentence by sentence, from single words."""
    import math

    odds, number, begun = [weights.bias], 0, False
    for word in (text or "").encode().split():
        if begun:
            odds.append(weights.bias)
            begun, number = False, number + 1
        odds[-1] += sum(weights.words.get(f, 0.0) for f in toxicity.features(word))
        begun = word.endswith(toxicity._ENDS)
    p = [1 / (1 + math.exp(-z)) for z in odds]
    return 1 - math.prod(1 - x for x in p), p.index(max(p)), max(p)


def test_noisy_or_of_very_long_texts(monkeypatch):
    """Neither a text's length nor where pieces end changes a result."""
    weights = toxicity.Weights({b"bad": 2.5, b"^awfu": 1.0, b"good": -1.0}, -6.0)
    texts = [
        "good words. " * 40_000 + "bad bad awfully bad! " + "more good words. " * 30_000,
        "fine " * 99_999 + "bad bad",  # one sentence over several pieces
        "a. " * 60_000 + "bad bad bad",
        "bad. ok",
        "one",
    ]
    whole = [toxicity.score_text(t, weights, toxicity._Lookup(weights)) for t in texts]
    assert whole[0][1] == 40_000 and whole[2][1] == 60_000
    for found, text in zip(whole, texts, strict=True):
        wanted = brute_noisy_or(text, weights)
        assert found[1] == wanted[1] and abs(found[0] - wanted[0]) < 1e-9 and abs(found[2] - wanted[2]) < 1e-12
    for piece in (1, 7, 1_000, 10_000_000):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        monkeypatch.setattr(toxicity, "WORDS_KEPT", max(piece, 100))
        for found, text in zip(whole[1:], texts[1:], strict=True):
            if len(text) < 50_000 or piece > 7:
                assert toxicity.score_text(text, weights, toxicity._Lookup(weights)) == found


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        left, share = total - sum(done.values()), sum(weight[s] for s in names if s not in done)
        over = [s for s in names if s not in done and left * weight[s] / share > 3 * sizes[s]] if share else []
        if not over:
            return {s: done.get(s, left * weight[s] / share if share else 0) for s in names}
        done |= {s: 3 * sizes[s] for s in over}


def test_mixing(docs, rows):
    found = mixing.mix_plan(docs).collect()
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len((text or "").encode().split())
    targets = brute_targets(sizes)
    taken, smallest = Counter(), {}
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    for source, target in targets.items():
        unspent = [r["size"] for r in found if r["source"] == source and r["size"] and r["copies"] < 3]
        assert taken[source] <= target + 1e-6 and (not unspent or target - taken[source] < 2 * max(unspent))
    assert sorted(map(str, mixing.mix_plan(docs).collect())) == sorted(map(str, found))
    assert mixing.mix_plan(docs.limit(0)).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.where("_mix_key <> 2").count() == 0
    assert mixed.count() == sum(r["copies"] for r in found)


def test_mixing_spends_its_room(spark):
    longs = {"a": 600, "b": 100, "c": 90, "d": 900, "e": 350, "f": 200, "g": 2_000, "h": 50, "i": 450}
    two = [(0, "w " * 600, "a"), (99, "w " * 500, "b")] + [(i, "w " * 10, "a") for i in range(1, 41)]
    many = [(k, "w " * n, s) for k, (s, n) in enumerate(longs.items())]
    many += [(100 * (k + 1) + i, "w " * 10, s) for k, s in enumerate(longs) for i in range(40)]
    for rows in (two, many):
        found = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        for source in {s for *_, s in rows}:
            own = [r for r in found if r["source"] == source]
            target, base = own[0]["target"], int(own[0]["target"] // own[0]["source_size"])
            short = target - sum(r["taken"] for r in own)
            passed = [r["size"] for r in own if r["copies"] == base < 3]
            assert short > -1e-6 and (not passed or short < min(passed)), (source, target, short, min(passed))
        if rows is two:
            assert sum(r["taken"] for r in found if r["source"] == "a") == 400


def test_mixing_of_repeated_rows(spark):
    """Equal rows that do not fit as a whole are taken one by one; other columns stay with their rows."""
    text = "w " * 10
    rows = [(7, text, "a", k) for k in range(60)] + [(8, "x " * 900, "b", 0), (9, "", "a", 1), (9, "", "a", 2), (10, None, "a", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").repartition(5)
    plans = []
    for _ in range(2):
        found = mixing.mix_plan(frame).collect()
        own = [r for r in found if r["source"] == "a" and r["size"]]
        base, target = int(own[0]["target"] // own[0]["source_size"]), own[0]["target"]
        assert {r["copies"] for r in own} == {base} or {r["copies"] for r in own} == {base, base + 1}
        assert 0 <= target - sum(r["taken"] for r in own) < 10 or base == 3
        plans.append(sorted((r["doc_id"], r["size"], r["rank"], r["copies"]) for r in found))
    assert plans[0] == plans[1]
    mixed = Counter(r["doc_id"] for r in mixing.mix(frame).collect())
    assert mixed == Counter({d: n for d in (7, 8, 9, 10) if (n := sum(r["copies"] for r in found if r["doc_id"] == d))})


def brute_removal(rows, length):
    first = {}
    ordered = sorted(rows, key=lambda r: LOW if r[0] is None else r[0])
    words = [(r[1] or "").encode().split() for r in ordered]
    for (doc_id, *_), own in zip(ordered, words, strict=True):
        for k in range(len(own) - length + 1):
            first.setdefault(tuple(own[k : k + length]), LOW if doc_id is None else doc_id)
    out = Counter()
    for (doc_id, *_), own in zip(ordered, words, strict=True):
        gone = [False] * len(own)
        for k in range(len(own) - length + 1):
            if first[tuple(own[k : k + length])] < (LOW if doc_id is None else doc_id):
                gone[k : k + length] = [True] * length
        kept = [w for w, g in zip(own, gone, strict=True) if not g]
        out[doc_id, len(own), sum(gone), sha(b" ".join(kept))] += 1
    return out


@pytest.mark.parametrize("length", [50, 7])
def test_substring_dedup(docs, rows, length):
    found = substring_dedup.remove_repeats(docs, length)
    assert Counter(tuple(r)[:4] for r in found.collect()) == brute_removal(rows, length)
    assert substring_dedup.remove_repeats(docs.limit(0), length).count() == 0


def test_rolling_hashes():
    import numpy as np

    words = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    roll = substring_dedup.Rolling(substring_dedup.BASES[0])
    whole = roll.windows(words, 20)
    assert all(whole[k] == roll.windows(words[k : k + 20], 20)[0] for k in range(0, 180, 13)) and len(set(whole.tolist())) == 180


def test_repeated_lengths(docs):
    found = {r["doc_id"]: r["longest"] for r in substring_dedup.repeated_lengths(docs, 50).collect()}
    assert found[1] == found[10] == 200 and found[4] == 50
    assert substring_dedup.repeated_lengths(docs.limit(0)).count() == 0


def test_language_id(spark, docs):
    sets = {"xx": ["blorp", "zint", "quax"], "yy": ["mela", "sumi", "taro"], "zz": ["grün", "öfter", "ßig"]}
    made = [(100 + i, " ".join(w[(i * 7 + j) % 3] for j in range(9)), lang) for i in range(60) for lang, w in sets.items()]
    train = spark.createDataFrame([(d * 3 + k, t, lang) for k, (d, t, lang) in enumerate(made)] + [(1, None, "xx"), (2, "a", None)], "doc_id long, text string, lang string")
    model = language_id.train(train)
    assert model.langs == ["xx", "yy", "zz"]
    found = {r["doc_id"]: r for r in language_id.identify(train, model).collect()}
    assert all(found[d * 3 + k]["lang_pred"] == lang for k, (d, _, lang) in enumerate(made))
    assert found[1]["lang_pred"] == "und" and found[1]["score"] == 0
    out = language_id.identify(docs, model)
    assert out.where("doc_id IN (5, 6, 7, 8)").select("lang_pred").distinct().collect() == [("und",)]
    assert out.count() == docs.count() and dict(out.dtypes)["score"] == "double" and out.where("h <> 5 OR _id <> 1").count() == 0
    assert language_id.identify(docs.limit(0), model).count() == 0
    none = language_id.train(docs.limit(0))
    assert none.langs == [] and language_id.identify(docs, none).where("lang_pred <> 'und'").count() == 0


def brute_bits(texts, lang, text):
    """Bits of a text by a plain tree of contexts."""
    import math

    tree, k_most = defaultdict(Counter), language_id.ORDER
    for own, seen in texts:
        if own == lang:
            s = language_id.coded(seen)
            for i in range(k_most, len(s)):
                for k in range(k_most + 1):
                    tree[s[i - k : i]][s[i]] += 1
    s, bits = language_id.coded(text), 0.0
    for i in range(k_most, len(s)):
        for k in range(k_most, -1, -1):
            seen = tree.get(s[i - k : i])
            if not seen:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if s[i] in seen:
                bits -= math.log2(seen[s[i]] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


def made_model(spark, rows):
    return language_id.model_of(language_id.count_runs(spark.createDataFrame(rows, "lang string, text string")))


def test_code_lengths_by_hand(spark, monkeypatch):
    rows = [("en", "abab ab a"), ("en", "ab  cd"), ("de", "ba ba\nbé"), ("de", "")]
    model = made_model(spark, rows)
    texts = ["ab", "ba ab", "abz", "q", "", " a \t b ", "abab " * 40, "é"]
    for piece in (language_id.PIECE, 7):
        monkeypatch.setattr(language_id, "PIECE", piece)
        found = model.code_lengths([language_id.coded(t) for t in texts])
        for i, text in enumerate(texts):
            for j, lang in enumerate(model.langs):
                assert abs(found[i, j] - brute_bits(rows, lang, text)) < 1e-9


def test_two_models_in_one_session(spark):
    """Each model gives its own answers in workers that another one has used."""
    frame = spark.createDataFrame([(i, "aa bb aa" if i % 2 else "cc dd cc") for i in range(40)], "doc_id long, text string")
    for _ in range(3):
        for names in (("x", "y"), ("y", "x")):
            model = made_model(spark, [(names[0], "aa bb aa bb"), (names[1], "cc dd cc dd")])
            found = language_id.identify(frame, model).collect()
            assert all(r["lang_pred"] == names[(r["doc_id"] + 1) % 2] for r in found)
            del model


def plain_alignment(a, b):
    """Patience alignment by recursion: equal heads and tails, then lines unique in both in their longest common order."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0), *((i + 1, j + 1) for i, j in plain_alignment(a[1:], b[1:]))]
    if a[-1] == b[-1]:
        return [*plain_alignment(a[:-1], b[:-1]), (len(a) - 1, len(b) - 1)]
    unique = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == b.count(x) == 1]
    longest = lambda found: max(found, key=lambda r: (len(r), -r[-1][1]), default=[])  # noqa: E731  of equal ones that which ends first
    best = []  # of the longest rows of pairs that end at each pair
    for i, j in unique:
        best.append(longest(r for r in best if r[-1][1] < j) + [(i, j)])
    fixed = longest(best)
    out, low = list(fixed), (0, 0)
    for i, j in [*fixed, (len(a), len(b))] if fixed else []:
        out += [(low[0] + x, low[1] + y) for x, y in plain_alignment(a[low[0] : i], b[low[1] : j])]
        low = (i + 1, j + 1)
    return sorted(out)


def brute_lines(rows):
    """Lines that go when every document is aligned with every earlier one."""
    split = {(LOW if i is None else i, t or ""): [x.strip() for x in (t or "").split("\n")] for i, t, *_ in rows}
    out = {}
    for later, b in split.items():
        gone = set()
        for earlier, a in split.items():
            if earlier[0] < later[0] and set(a) & set(b) - {""}:
                aligned = plain_alignment(a, b)
                blocks, last = [], (-2, -2)
                for i, j in aligned:
                    if (i, j) != (last[0] + 1, last[1] + 1):
                        blocks.append([])
                    blocks[-1].append(j)
                    last = (i, j)
                gone |= {j for block in blocks if any(b[k] for k in block) for j in block}
        out[later] = gone
    return out


def test_line_dedup(docs, rows):
    found = line_dedup.dedup_lines(docs)
    assert found.columns == [*docs.columns, "n_lines", "n_removed"]
    wanted, gone = Counter(), brute_lines(rows)
    for doc_id, text, *_ in rows:
        lines = None if text is None else text.split("\n")
        lost = gone[LOW if doc_id is None else doc_id, text or ""] if text is not None else set()
        kept = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in lost)
        wanted[doc_id, kept, len(lines or ()), len(lost)] += 1
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in found.collect()) == wanted
    assert found.where("_gone <> 'g' OR _id <> 1 OR key <> 'k'").count() == 0
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_of_frequent_blocks(spark):
    own = lambda i, k: f"own {k} of {i}"
    block = [(i, "\n".join([own(i, 0), own(i, 1), "block one", "", "block two", own(i, 2)])) for i in range(60)]
    near = [(i, "\n".join([*(f"long {k}" for k in range(6)), own(i, 0), own(i, 1)])) for i in range(100, 170)]
    found = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(block + near, "doc_id long, text string")).collect()}
    assert [found[i]["n_removed"] for i, _ in block] == [0] + [3] * 59
    assert [found[i]["n_removed"] for i, _ in near] == [0] + [6] * 69
    assert all(found[i]["text"] == "\n".join(own(i, k) for k in range(3)) for i in range(1, 60))
    wanted = brute_lines(block + near)
    assert all(found[i]["n_removed"] == len(wanted[i, t]) for i, t in block + near)


def test_line_dedup_meets_the_first_holder_of_a_block(spark):
    """Single lines are owned by a document that has them in another order; the block is another's."""
    rows = [(1, "c\nb\na"), (2, "own 2\na\nb\nc\nown two"), (3, "own 3\na\nb\nc\nown three")]
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] == "c\nb\na" and found[3] == "own 3\nown three"
    assert len(brute_lines(rows)[3, rows[2][1]]) == 3


def test_line_dedup_recall_against_all_pairs(spark):
    """Documents of shuffled, overlapping pieces of common blocks: nothing is deleted that no pair has, and little is missed."""
    import random

    rng, rows = random.Random(5), []
    blocks = [[f"block {k} line {i}" for i in range(rng.randint(1, 6))] for k in range(40)]
    for i in range(250):
        lines = []
        for _ in range(rng.randint(1, 6)):
            block = rng.choice(blocks)
            low = rng.randrange(len(block))
            lines += block[low : low + rng.randint(1, 6)] + [f"own {i} {rng.random()}"] * rng.randint(0, 1) + [""] * rng.randint(0, 1)
        rows.append((i, "\n".join(lines)))
    found = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wanted = brute_lines(rows)
    deleted = missed = 0
    for i, text in rows:
        all_, lost = wanted[i, text], found[i]["n_removed"]
        every = [x for k, x in enumerate(text.split("\n")) if k not in all_]
        stays = found[i]["text"].split("\n") if found[i]["text"] else []
        assert Counter(every) - Counter([""]) <= Counter(stays) and len(stays) + lost in (len(text.split("\n")), len(text.split("\n")) - 1)
        deleted, missed = deleted + len(all_), missed + len(all_) - lost
    print(f"deleted by all pairs {deleted}, missed {missed}")
    assert missed <= 0.1 * deleted


def test_patience():
    a, b = [1, 2, 3, 4, 5, 6], [9, 2, 3, 8, 5, 6]
    assert line_dedup.patience(a, b) == [(1, 1), (2, 2), (4, 4), (5, 5)]
    assert line_dedup.patience([], b) == [] and line_dedup.patience([1, 1], [1, 1]) == [(0, 0), (1, 1)]
    found = line_dedup.patience([1, 7, 7, 2, 3], [2, 1, 7, 7, 3])
    assert all([1, 7, 7, 2, 3][i] == [2, 1, 7, 7, 3][j] for i, j in found) and found == sorted(found)
    assert line_dedup.common_lines(a, b) == [1, 2, 4, 5]


def test_pipeline_stages(spark, docs, rows):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "mix_sources", "pack"]
    frame = docs.select("doc_id", "text", "lang", "source", F.length("text").alias("n_chars"))
    first = corpus_pipeline.language_id(spark, frame, "").cache()
    assert {r["doc_id"] for r in first.collect()} == {r[0] for r in rows} - {5, 6, 7, 8}
    second = corpus_pipeline.line_dedup(spark, first, "").cache()
    assert second.columns == frame.columns and 2 not in {r["doc_id"] for r in second.collect()}
    assert second.where("n_chars <> length(text)").count() == 0
    third = corpus_pipeline.near_duplicates(spark, second, "").cache()
    kept = {r["doc_id"] for r in third.collect()}
    wanted = {d for (d, _, c), _ in brute_components([(r["doc_id"], r["text"]) for r in second.collect()], 5, 80).items() if d is None or c == d}
    assert kept == wanted
    fourth = corpus_pipeline.mix_sources(spark, third, "")
    assert fourth.columns == frame.columns and {r["doc_id"] for r in fourth.collect()} <= kept
    assert corpus_pipeline.pack(spark, third, "").select("doc_id").distinct().count() == len(kept)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from shelfmark.llm import common

    unset = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            common.scratch_root(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master)))
    named = SimpleNamespace(get=lambda key, *_: "hdfs://x/y/" if key == "spark.checkpoint.dir" else None)
    assert common.scratch_root(SimpleNamespace(conf=named, sparkContext=SimpleNamespace(master="yarn"))) == "hdfs://x/y"


def test_a_worker_keeps_one_operators_table():
    from shelfmark.llm import common

    one = common.worker_table("one", dict)
    assert common.worker_table("one", dict) is one
    common.begin("two")
    assert common.worker_table("one", dict) is not one
    common.begin("")


def test_hashes_of_words_do_not_depend_on_pieces(monkeypatch):
    import numpy as np

    from shelfmark.llm import common

    data = " ".join(f"wörd{i} x" for i in range(5_000)).encode() + b"\t\n end"
    whole = common.word_hashes(data)
    monkeypatch.setattr(common, "_PIECE", 1_000)
    assert np.array_equal(common.word_hashes(data), whole) and len(whole) == len(data.split())
    roll = substring_dedup.Rolling(substring_dedup.BASES[0])
    windows = roll.windows(whole, 50)
    monkeypatch.setattr(substring_dedup, "PIECE", 77)
    assert np.array_equal(substring_dedup.Rolling(substring_dedup.BASES[0]).windows(whole, 50), windows) and len(windows) == len(whole) - 49
