"""The text operators against brute force, round trips and edge cases."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellbeam.llm import byte_bpe, html_text, jaccard_join, licenses, merkle, packing, quality, suffix_dedup, toxicity, url_filter
from cellbeam.llm.common import text_buffer
from cellbeam.llm.components import components

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LONG = "lorem ipsum dolor sit amet " * 3000
ODD = [None, "", " ", "\n\n", "a", "a  b\t\tc ", "x" * 5000, LONG, LONG, "don't 'S 12 ½ é́ 日本 \x1c \x00 🙂", "<|endoftext|> \x01 mark"]


def docs(spark, texts):
    """Extra columns carry names that operators use inside."""
    rows = [(i, t, "key", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, ids long").repartition(3, "doc_id")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def given_docs(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def test_bpe(spark, given_docs):
    with open(BPE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ODD + [t for _, t in given_docs[:100]]
    out = by_id(byte_bpe.decode(byte_bpe.encode(docs(spark, texts), BPE, public_tokenizers.PATTERN), BPE, public_tokenizers.PATTERN))
    for i, t in enumerate(texts):
        assert out[i]["ids"] == enc.encode_ordinary(t or "")
        assert bytes(out[i]["decoded"]) == (t or "").encode()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_bpe_any_text(texts):
    m = byte_bpe.model(BPE, public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=m.ranks, special_tokens={})
    assert [np.frombuffer(x, np.int32).tolist() for x in m.encode(texts)] == [enc.encode_ordinary(t) for t in texts]


def test_bpe_lexicon_is_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "LEXICON", 60_000)
    small, whole = byte_bpe.ByteBpe(BPE, public_tokenizers.PATTERN), byte_bpe.model(BPE, public_tokenizers.PATTERN)
    for k in range(30):
        text = " ".join(f"word{k}x{i}, common{i}" for i in range(40))
        assert small.encode([text, None, ""]) == whole.encode([text, None, ""])
        assert small.held <= 60_000


def test_pack(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    out = packing.pack(docs(spark, ODD), WORDS).collect()
    assert len({r["sequence_id"] for r in out}) == len(out)
    for i, t in enumerate(ODD):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["start"])
        assert [x for r in mine for x in np.frombuffer(r["ids"], "<u4").tolist()] == ids
        assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["offset"] == 0 for r in mine)
    assert packing.binary_pieces(4096 + 5, 2048) == [(0, 2048), (2048, 2048), (4096, 4), (4100, 1)]


def test_pack_control_strings():
    """As the library's plain call by default, as text on demand; a small lexicon gives the same ids."""
    from tokenizers import Tokenizer

    plain, text = Tokenizer.from_file(WORDS), Tokenizer.from_file(WORDS)
    text.encode_special_tokens = True
    cases = [f"a {x} b{x}c\n{x}{x} \x01{x}" for x in ("<|startoftext|>", "<|endoftext|>", "<|endof text|>")]
    for as_text, tok in ((False, plain), (True, text)):
        own = packing.WordTokenizer(WORDS, as_text)
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(cases)] == [tok.encode(c, add_special_tokens=False).ids for c in cases]
    assert 49407 in plain.encode(cases[1], add_special_tokens=False).ids and 49407 not in text.encode(cases[1], add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("aB9zé'’.,;:!?)]}\"-|<> \n\t\r\x0b\x1c\x85\u00a0\u0301ßΣσİ日½²_#")), st.characters(max_codepoint=0x2FFF)), max_size=30), min_size=1, max_size=4))
def test_pack_any_text(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.tokenizer(WORDS).encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_pack_lexicon_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "LEXICON", 20_000)
    monkeypatch.setattr(packing, "WORDS", 30_000)
    own, fresh = packing.WordTokenizer(WORDS), packing.WordTokenizer(WORDS)
    for k in range(40):
        text = " ".join(f"word{k}x{i} common{i}" for i in range(50))
        assert own.encode([text]) == fresh.encode([text])
        assert own.held <= 20_000
        assert own.held_words <= 60_000
        fresh.forget()
    assert fresh.held == 0 and not fresh.lexicon


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        out.append((bytes(x for x, g in zip(b, gone) if not g), sum(gone)))
    return out


def test_suffix_dedup(spark):
    rng = np.random.default_rng(0)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    shared, other = word(300), word(90)
    texts = [None, "", "short", word(500), shared, word(50) + shared + word(50), word(120) + shared[40:260] + word(9), shared[:199] + word(200), "ab" * 400, word(400) + "x" + other * 5, "z" * 450, word(30) + shared[50:300]]
    texts += [texts[3], texts[3]]
    out = by_id(suffix_dedup.remove_repeats(docs(spark, texts)))
    for i, (kept, gone) in enumerate(brute_repeats(texts, 200)):
        assert (bytes(out[i]["kept"]), out[i]["n_removed"]) == (kept, gone), i
        assert sum(s["end"] - s["start"] for s in out[i]["spans"]) == gone
    assert suffix_dedup.remove_repeats(docs(spark, ["a"]).where("false")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6), max_size=8), min_size=1, max_size=6))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    got = list(suffix_dedup.merge_runs([suffix_dedup.front_code(r) for r in runs]))
    assert [g[2] for g in got] == sorted(x for r in runs for x in r)
    for a, b in zip(got, got[1:]):
        assert b[3] == suffix_dedup.common_prefix(a[2], b[2])


def brute_stats(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    three = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cover = {i + k for i in range(len(words) - 2) if three[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(cover)]


def test_quality(spark, sf_dir, given_docs):
    texts = ODD + ["a b c a b c\nx\nx\n #$", "é é é é"] + [t for _, t in given_docs]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    out = by_id(quality.judge(docs(spark, texts), model))
    for i, t in enumerate(texts):
        r = out[i]
        assert [r[k] for k in quality.COUNTS[:5]] == brute_stats(t or "")
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["score"] >= 0.5)
    empty = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.where("false"))
    assert len(empty.roots) == 0


def test_trees_are_monotonic():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = (x[:, 0] + 0.3 * rng.standard_normal(2000) < 0.5).astype(float)
    m = quality.fit_trees(x, y, [-1, 0, 0])
    assert ((m.score(x) >= 0.5) == y).mean() > 0.75
    grid = np.column_stack([np.linspace(0, 1, 200), np.full(200, 0.4), np.full(200, 0.6)])
    assert (np.diff(m.score(grid)) <= 1e-12).all()


def test_quality_held_out(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    d, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = quality.fit(d, labels.where("doc_id % 2 = 0"))
    out = quality.judge(d, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").select((F.col("kept").cast("int") == F.col("quality")).alias("ok")).collect()
    assert np.mean([r["ok"] for r in out]) > 0.9


def test_merkle(spark):
    texts = ["One two three. Four five six.\nSeven eight nine ten eleven.\n" * 20, "", None, "same words here " * 50, "same words here " * 50, LONG, "日本 " * 300]
    out = by_id(merkle.compare_with_edits(docs(spark, texts)))
    plain = by_id(merkle.fingerprint(docs(spark, texts)))
    full = [t or "" for t in texts]
    for i, t in enumerate(full):
        n, h = full[(i + 1) % len(full)], len(t) // 2
        edited = t[: len(t) - h] + n[:h]
        assert out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and out[i]["n_chars"] == len(t)
        assert out[i]["fingerprint"] == plain[i]["fingerprint"] and (out[i]["edited_fingerprint"] == out[i]["fingerprint"]) == (edited == t)
        assert 0 <= out[i]["near_edited"] <= 1
    assert out[3]["near_next"] == 1.0 and out[0]["near_edited"] > 0.3
    a, b = merkle.fingerprints([texts[0], texts[0].replace("ten", "10", 1)])
    assert merkle.differing(a, b) and merkle.differing(a, a) == []
    assert merkle.compare_with_edits(docs(spark, ["a"]).where("false")).count() == 0


def test_toxicity(spark, sf_dir):
    bad = [f"you are such an {w} my friend" for w in ("idiot", "moron", "idiot moron")] * 30
    good = [f"you are such an {w} my friend" for w in ("actor", "garden", "window")] * 30
    texts = bad + good + ODD
    labels = spark.createDataFrame([(i, 1 if i < 90 else 0, None) for i in range(180)] + [(999, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs(spark, texts), labels)
    out = by_id(toxicity.score(docs(spark, texts + ["you are such an i.d.i.o.t my friend", "you are such an idixot my friend"]), model))
    assert all(out[i]["predicted"] == (1 if i < 90 else 0) for i in range(180))
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert out[len(texts)]["predicted"] == 1 and out[len(texts) + 1]["score"] > max(out[i]["score"] for i in range(90, 180))
    assert toxicity.score(docs(spark, ODD), toxicity.fit(docs(spark, texts), labels.where("false"))).count() == len(ODD)


def test_kernel_is_brute_force():
    a, b = "idiot", "idxiot"

    def weights(w):
        out = Counter()
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, len(w)):
                    if k - i < toxicity.SPAN:
                        out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x, y = weights(a), weights(b)
    want = sum(v * y[u] for u, v in x.items()) / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    marks = toxicity.Landmarks.of([a])
    _, got = marks.kernel(toxicity.units_of(*text_buffer(pa.array([b]))))
    assert abs(got[0, 0] - want**toxicity.POWER) < 1e-9


def test_licenses(spark):
    texts = ["Released under the MIT License. mit license", "GNU  General-Public LICENSE and CC-BY 4.0", "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */", "nothing", None, "", LONG + "apache license"]
    out = by_id(licenses.scan(docs(spark, texts)))
    assert [(h["label"], h["word"], h["base"]) for h in out[0]["hits"]] == [("mit", 3, True), ("mit", 5, True)] and out[0]["score"] == 0.9
    assert out[1]["labels"] == ["cc-by", "gpl"]
    assert out[2]["labels"] == ["apache-2.0", "gpl-2.0-only-with-classpath-exception-2.0", "mit"] and out[2]["score"] == 1.0
    assert out[4]["n_words"] == 0 and out[4]["labels"] == [] and out[6]["hits"][0]["word"] == 15000
    assert licenses.parse_expression("MIT OR")[0] == ["MIT"] and licenses.parse_expression("OR MIT")[0] == []
    postfix = licenses.parse_expression("A OR B AND C")[0]
    assert [licenses.evaluate(postfix, frozenset(x)) for x in ("a", "b", "bc", "c", "")] == [True, False, True, False, False]
    assert licenses.licences_of(postfix) == {"a", "b", "c"}
    assert licenses.parse_expression("(A OR B) WITH C")[0] == ["A", "B", "OR".lower()] and licenses.parse_expression("A WITH (B)")[0] == ["A"]
    assert out[2]["met"] is False and out[3]["met"] is None


def test_licenses_after_many_grants():
    for n in (999, 1000, 1001, 3000):
        text = "mit license " + "licensed under " + "some other terms that follow at length here and on " * 2 + "released under some other terms " * n
        assert licenses.scan_text(text)[3] == 0.6
        assert licenses.scan_text(text + "licensed under the mit license")[3] == 0.9
        assert licenses.scan_text(text + "licensed under " + "x " * 6 + "mit license")[3] == 0.9
        assert licenses.scan_text(text + "licensed under " + "x " * 7 + "mit license")[3] == 0.6


def test_urls(spark):
    urls = ["https://www.Example.NET/en/1?x", "http://example.net/de/", "ftp://a.net", "http://shop.example.com/de/x", "http://x.org/fr/", "http://x.org/en/", "nourl", None, "http://bad.com/#://", "http://example.com/de/"]
    link = '<a href="http://shop.example.com/">x</a>'
    rows = [(i, u, link if i == 5 else "<p>", 1) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host long")
    out = by_id(url_filter.judge(pages), "page_id")
    assert [out[i]["rule"] for i in range(10)] == ["example.net/en/", "net/", None, "example.com/de/", "org/fr/", None, None, None, None, "example.com/de/"]
    assert (out[0]["host"], out[0]["path"]) == ("www.example.net", "/en/1") and (out[2]["host"], out[2]["path"]) == ("a.net", "")
    assert (out[7]["host"], out[6]["path"], out[8]["host"]) == ("", "", "bad.com")
    assert [out[i]["verdict"] for i in (0, 1, 3, 4, 5, 6, 7)] == ["allow", "block", "block", "allow", "allow", "allow", "allow"]
    assert url_filter.judge(pages.where("false")).count() == 0


def test_propagation_is_pagerank(spark):
    edges = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 2.0)]
    seeds = [("a", 1.0, 0.0), ("b", 0.0, 0.0), ("c", 0.0, 2.0)]
    e = spark.createDataFrame(edges, "src string, dst string, weight double")
    s = spark.createDataFrame(seeds, "host string, trust double, distrust double")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.propagate(s, e, 5, 0.5).collect()}
    m = np.zeros((3, 3))
    for a, b, w in edges:
        m["abc".index(a), "abc".index(b)] = w
    t0, d0 = np.array([1.0, 0, 0]), np.array([0, 0, 2.0])
    t, dd = t0, d0
    for _ in range(5):
        t = 0.5 * t0 + 0.5 * t @ (m / m.sum(1, keepdims=True))
        dd = 0.5 * d0 + 0.5 * dd @ (m / m.sum(0, keepdims=True)).T
    assert np.allclose([got[h] for h in "abc"], np.stack([t, dd], 1))


def brute_groups(texts, size=5, percent=80):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [(len(s), r) for s, r in zip(sets, root)]


def test_jaccard_join(spark):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 500, 120)]
    texts = [None, "", "one two", "One  TWO", "a b c d e"]
    for k in range(60):  # near copies with more and more edits: chains and hubs
        w = list(base)
        for p in rng.integers(0, 120, k // 6):
            w[p] = f"x{rng.integers(0, 9999)}"
        texts.append(" ".join(w))
    passage = " ".join(f"p{k}" for k in range(40))
    texts += [passage + " " + " ".join(f"q{k}_{j}" for j in range(n)) for k, n in enumerate([3, 5, 8, 12, 20, 30, 40])]
    texts += [texts[10]] * 5 + [LONG, LONG]
    out = by_id(jaccard_join.similar_groups(docs(spark, texts)))
    assert [(out[i]["n_shingles"], out[i]["component_id"]) for i in range(len(texts))] == brute_groups(texts)
    assert jaccard_join.similar_groups(docs(spark, ["a"]).where("false")).count() == 0


def test_jaccard_join_of_contained_texts(spark):
    """One text of a pair is the other with a fifth to a quarter appended, or cut from its start or end."""
    rng = np.random.default_rng(5)
    texts = []
    for k in range(60):
        n = int(rng.integers(40, 120))
        more = n * int(rng.integers(20, 26)) // 100
        w = [f"w{k}_{j}" for j in range(n + more)]
        texts += [" ".join(w), " ".join(w[more:] if k % 3 == 0 else w[:n])]
    w = [f"v{j}" for j in range(104)]
    for _ in range(20):  # 80 of 100 shingles: exactly the limit
        w = [f"{x}v" for x in w]
        texts += [" ".join(w[:84]), " ".join(w)]
    out = by_id(jaccard_join.similar_groups(docs(spark, texts)))
    assert [(out[i]["n_shingles"], out[i]["component_id"]) for i in range(len(texts))] == brute_groups(texts)


def test_components(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(205, 203), (203, 209), (7, 7)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(out[k] == 0 for k in range(41)) and all(out[k] == 100 for k in range(100, 130)) and out[205] == out[209] == 203


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><script>var a="</p><article>";</script></head><body>
<nav><ul><li><a href="/a">menu one</a></li><li><a href="/b">menu two</a></li></ul></nav><div class="ad banner">Buy this now.</div>
<article><header>by someone</header><h1>Head &lt;1&gt;</h1><p><b>First   part
 of text, quite long so that it counts for something here.<br><p>Second &eacute; part<!-- gone --> goes on.
<aside>side</aside><ul><li>item a<li>item b</ul><div id="comments"><p>reader says</p></div><form><input>send</form></article><footer>&copy; foot</footer></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, "u", None, "x"), (3, "u", "", "x"), (4, None, "<p>only < text & more", "x"), (5, "u", "<div" * 500, "x"), (6, "u", "<p>" + LONG, "x")], "page_id long, url string, html string, text string")
    out = by_id(html_text.extract(pages), "page_id")
    assert out[1]["text"] == "Head <1>\nFirst part of text, quite long so that it counts for something here.\nSecond é part goes on.\nitem a\nitem b"
    assert out[2]["text"] == out[3]["text"] == "" and out[4]["text"] == "only < text & more" and out[6]["text"] == LONG.strip()
    assert html_text.extract(pages.where("false")).count() == 0


def test_html_split_bodies():
    """No article or main: parts that stand side by side in the body are taken along if they are dense enough."""
    p = [f"<p>{c * 4} ".ljust(300, c) + "</p>" for c in "abcdef"]
    text = ["\n".join(" ".join(x[3:-4].split()) for x in p[k : k + 3]) for k in (0, 3)]
    nav = '<div><a href="/1">one</a> <a href="/2">two</a> <a href="/3">three</a></div>'
    first, second = [f"<div>{''.join(p[k : k + 3])}</div>" for k in (0, 3)]
    for page in (first + second, first + nav + second, nav + first + '<div class="ads">' + p[0] + "</div>" + second + nav):
        assert html_text.extract_text(f"<html><body>{page}</body></html>") == "\n".join(text)
    assert html_text.extract_text(f"<body>{nav}<section>{first}{nav}</section>{nav}</body>") == text[0]
    head = "A heading of the page " * 12
    assert html_text.extract_text(f"<body><h1>{head}</h1>{nav}{first}</body>") == f"{head.strip()}\n{text[0]}"


def test_empty_tables(spark):
    none = docs(spark, ["a"]).where("false")
    assert byte_bpe.encode(none, BPE, public_tokenizers.PATTERN).count() == 0
    assert packing.pack(none, WORDS).count() == 0 and licenses.scan(none).count() == 0 and merkle.fingerprint(none).count() == 0
