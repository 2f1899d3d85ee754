"""BPE transducer, ranked search and spelling variants, each against another library, SQL or brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import bpe_stream, queries, spelling, treap_search
from shelfmark.llm.packing import default_tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer_path())


@pytest.fixture(scope="module")
def merges():
    return bpe_stream.Merges(default_tokenizer_path())


ATOMS = ["a", "b", "the", "ing", "'s", "'", "'re", "'l", " ", "  ", "\n", "\t", " é", "ñ", "漢字", "😀", "𝔸", "1", "23", "½", "!", "...", "-"]
ATOMS += ["<|endoftext|>", "<|endo", "<|", "|>", "　", "Ġ", "Ᲊ", "՘", "\x1c", "\x85", "�", "x" * 50, "-" * 70, " " * 40, "guarantee", "́"]


def odd_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    texts += ["a" * 5000, "-" * 5000 + "x", " " * 5000 + "x", "\n" * 5000, " \n" * 3000 + "b", "'" * 3000 + "re", "é" * 4000 + "1" * 4000, "漢字" * 3000 + " a"]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))]
    pieces = ["ing", "er", "the", "tion", "a", "guarantee", "ed", "an", "in"]
    return texts + ["".join(rng.choice(pieces) for _ in range(2000)) for _ in range(10)]


@pytest.mark.parametrize("piece", [1, 13, 700, 1 << 16])
def test_ids_do_not_depend_on_pieces(merges, library, monkeypatch, piece):
    monkeypatch.setattr(bpe_stream, "PIECE", piece)
    texts = odd_texts() if piece > 1 else odd_texts()[:200]
    found = bpe_stream.encode_texts(merges, texts)
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [f.tolist() for f in found] == wanted
    assert [bpe_stream.decode_ids(merges, f) for f in found] == [library.decode(w, skip_special_tokens=False) for w in wanted]


def test_ids_that_are_no_text_decode_alike(merges, library):
    rng = random.Random(2)
    for _ in range(200):
        ids = [rng.randrange(50_257) for _ in range(40)]
        assert bpe_stream.decode_ids(merges, np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_what_is_kept_is_bounded(merges):
    state, most = bpe_stream.Encoder(merges), 0
    for k in range(300):
        state.feed("ab" * 500, k == 299)
        most = max(most, len(state.open) + len(state.held) + len(state.marked))
    assert most < 3 * merges.window


def test_lookahead_is_sufficient():
    """Small merge lists: no continuation changes a token that ends the lookahead before the end."""
    from itertools import product

    rng = random.Random(3)
    for _ in range(60):
        made, parts = [], [b"a", b"b", b"c"]
        for _ in range(6):
            a, b = rng.choice(parts), rng.choice(parts)
            if a + b not in parts:
                made.append((a, b))
                parts.append(a + b)
        look = bpe_stream.sufficient_lookahead(made)

        def tokens(text):
            out = [bytes([c]) for c in text]
            for a, b in made:
                i = 0
                while i < len(out) - 1:
                    if (out[i], out[i + 1]) == (a, b):
                        out[i : i + 2] = [a + b]
                    i += 1
            return out

        for _ in range(40):
            text = bytes(rng.choice(b"abc") for _ in range(look + rng.randint(1, 8)))
            stable, at = [], 0
            for t in tokens(text):
                at += len(t)
                if at <= len(text) - look:
                    stable.append(t)
            for more in map(bytes, product(b"abc", repeat=3)):
                assert tokens(text + more)[: len(stable)] == stable


def test_bpe_rows(spark, docs, library):
    encoded = bpe_stream.encode_documents(docs)
    assert encoded.columns == ["doc_id", "ids"]
    rows = docs.select("doc_id", "text").collect()
    wanted = Counter((r["doc_id"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()) == wanted
    back = bpe_stream.decode_documents(encoded)
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((r["doc_id"], r["text"] or "") for r in rows)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [-1, 60_000, 64])], "doc_id long, ids array<int>")
    assert [r["text"] for r in bpe_stream.decode_documents(odd).orderBy("doc_id").collect()] == ["", "", "a"]
    assert encoded.limit(0).count() == 0 and bpe_stream.transcode_digests(docs.limit(0)).count() == 0
    for r in bpe_stream.transcode_digests(docs.where("doc_id < 5")).collect():
        text = next(x["text"] or "" for x in rows if x["doc_id"] == r["doc_id"])
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def duck(docs, items):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    con.register("benchmark", items.toPandas())
    return sorted(map(tuple, con.sql(treap_search.oracle()).fetchall()), key=repr)


def search_cases(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["ÀB", "éa", "x1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(0, 60))) for _ in range(400)]
    texts += ["w1 w2 w3"] * 40 + [None, "", " .,;", "W1-w2_w3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "nowhere"), (93, "w1 W1 w2! w3 nowhere"), (94, " ".join(words))]
    return docs.repartition(5), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_docs, together", [(1 << 14, 1 << 18), (16, 64)])
def test_search_against_sql(spark, monkeypatch, block_docs, together):
    monkeypatch.setattr(treap_search, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(treap_search, "_TOGETHER", together)
    docs, items = search_cases(spark)
    found = treap_search.search_documents(docs, items)
    assert sorted(map(tuple, found.collect()), key=repr) == duck(docs, items)


def test_search_in_groups_and_rare_rows(spark, monkeypatch, docs):
    some, items = search_cases(spark)
    whole = sorted(map(tuple, treap_search.search_documents(some, items, 3).collect()))
    monkeypatch.setattr(treap_search, "GROUP_TERMS", 20)
    assert sorted(map(tuple, treap_search.search_documents(some, items, 3).collect())) == whole
    found = treap_search.search_documents(docs, spark.createDataFrame([(1, "un DEUX"), (1, "identifiant"), (None, "tiny")], "item_id long, text string")).collect()
    ranked = defaultdict(list)
    for r in sorted(found, key=lambda r: r["rank"]):
        ranked[r["item_id"]].append((r["rank"], r["doc_id"]))
    assert ranked[None] == [(1, 11), (2, 12)] and Counter(ranked[1]) == Counter([(1, 9), (2, 9), (1, None), (2, 9)])
    assert treap_search.search_documents(docs.limit(0), items).count() == 0 and treap_search.search_documents(docs, items.limit(0)).count() == 0
    with pytest.raises(ValueError, match="positive"):
        treap_search.search_documents(docs, items, 0)


def test_treaps_are_heaps_in_document_order():
    rng = np.random.default_rng(0)
    terms, docs = rng.integers(0, 4, 500), rng.integers(0, 200, 500)
    terms, docs = np.unique(np.stack([terms, docs]), axis=1)
    impacts = rng.integers(1, 9, len(terms))
    t = treap_search.Treaps(terms, docs, impacts, 6)
    assert t.root[4] == t.root[5] == -1
    seen = 0
    for term in range(4):
        stack, depth = [(t.root[term], -1, 200, 9, 0)], 0
        while stack:
            node, low, high, most, level = stack.pop()
            if node < 0:
                continue
            assert low < t.doc[node] < high and t.impact[node] <= most
            seen, depth = seen + 1, max(depth, level)
            stack += [(t.left[node], low, t.doc[node], t.impact[node], level + 1), (t.right[node], t.doc[node], high, t.impact[node], level + 1)]
        assert depth < 40
    assert seen == len(terms)


def brute_words(rows, least_length=7, least_count=2, ratio=10, each=31):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if each and h % each == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= least_length
    n = {w: c for w, c in counts.items() if c >= least_count}
    near = defaultdict(set)
    for a in n:
        for b in n:
            if a < b and abs(len(a) - len(b)) < 2:
                short, long_ = sorted((a, b), key=len)
                if len(a) == len(b):
                    edit = sum(x != y for x, y in zip(a, b, strict=True)) == 1
                else:
                    edit = any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))
                if edit:
                    near[a].add(b)
                    near[b].add(a)
    form = {w: best for w in n if near[w] and n[best := min(near[w], key=lambda x: (-n[x], x))] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


@pytest.mark.parametrize("block", [5_000, 3])
def test_spelling_against_all_pairs(spark, block):
    rng = random.Random(6)
    base = ["thesame" + "".join(rng.choices("ab", k=rng.randint(0, 4))) for _ in range(25)] + ["élégance", "Élégance", "über÷×weg", "straßenbahn"]
    words = []
    for w in base:
        words += [w] * rng.choice([2, 3, 30, 400])
        for _ in range(3):
            i, c = rng.randrange(len(w)), rng.choice("abß")
            words += [rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])] * rng.choice([1, 2, 40])
    rng.shuffle(words)
    rows = [(k, " ".join(w.upper() if rng.random() < 0.2 else w for w in words[k::40])) for k in range(40)]
    rows += [(None, "thesameaa thesameaa"), (7, None), (8, ""), (9, "x" * 3000), (9, "x" * 3000), (10, "1234 !!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("n"), "side": F.lit(2)})
    found = spelling.spelling_variants(docs, drop_each=31, block=block)
    wanted = brute_words(rows)
    assert set(map(tuple, found.collect())) == wanted and found.count() == len(wanted)
    assert any(w[1] and w[1] != w[2] for w in wanted) and spelling.spelling_variants(docs.limit(0)).count() == 0


def test_spelling_of_long_shared_halves(spark):
    """Words that share hundreds of characters are told apart in rounds of doubling depth."""
    words = ["a" * 300 + f"{i:b}".replace("0", "x").replace("1", "y") + "b" * 300 for i in range(40)]
    table = spark.createDataFrame([(w, i + 2) for i, w in enumerate(words)], "word string, n long")
    near = {(r["word"], r["near"]) for r in spelling.near_words(table, block=4).collect()}
    counts = [(w, i + 2) for i, w in enumerate(words)]
    wanted = {(w[0], x) for w in brute_near(counts) for x in w[1]}
    assert near == wanted and len(near) > 100


def brute_near(counts):
    for a, _ in counts:
        found = []
        for b, _ in counts:
            short, long_ = sorted((a, b), key=len)
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1:
                found.append(b)
            elif len(long_) == len(short) + 1 and any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_))):
                found.append(b)
        yield a, found


def test_words_are_cut_at_no_piece(monkeypatch):
    text = " ".join(["Abcdefghij", "kl", "ÀÉmnopqrs"] * 50)
    whole = spelling.count_words(text, 1, 7, None), treap_search.count_terms(text)
    monkeypatch.setattr(spelling, "_PIECE", 5)
    monkeypatch.setattr(treap_search, "_PIECE", 5)
    assert (spelling.count_words(text, 1, 7, None), treap_search.count_terms(text)) == whole


def test_registered_queries(spark):
    found = queries.op11_spelling(spark, SF)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"] and found.where("n < 2").count() == 0
    assert queries.op12_bpe_stream(spark, SF).where("n_tokens > 0").count() == 200
    assert queries.op13_treap_search(spark, SF).columns == ["item_id", "rank", "doc_id", "score"]
