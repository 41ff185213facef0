"""Operators against brute force, round trips and held-out accuracy."""

import collections
import random
import re
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import bpe, html_extract, jaccard, langid, linedup, neardup, packing, quality, sharding, warc
from corpusmill.llm.common import components
from corpusmill.llm.html_blocks import blocks
from corpusmill.llm.html_labelled import labelled_pages

R = random.Random(3)
VOCAB = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 6))) for _ in range(400)]
BYTES = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
WORDS = Path(public_tokenizers.path("word_bpe_49k.json")).read_bytes()


def sentence(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


def corpus():
    texts = [sentence(R.randint(5, 120)) for _ in range(60)]
    for _ in range(60):
        words = R.choice(texts).split()
        for _ in range(R.randint(0, 3)):
            words[R.randrange(len(words))] = R.choice(VOCAB)
        texts.append(" ".join(words))
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string").cache()


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [512, 7])
def test_jaccard(docs, block):
    sets = {}
    for i, text in docs.collect():
        w = text.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    n = collections.Counter(i for pair in links for i in pair)
    expected = roots(sets, links)
    rows = jaccard.jaccard_join(docs, block=block).collect()
    assert links
    assert {r["doc_id"]: r["n_links"] for r in rows} == {i: n[i] for i in sets}
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected
    assert sorted(r["doc_id"] for r in rows if r["kept"]) == sorted(set(expected.values()))


def test_least_matches():
    least = jaccard.least_matches(0.8, 1e-6, 128, 32)
    assert least == sorted(least)
    assert 0 < least[0] < 26


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 200), (300, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["root"] for r in components(df).collect()}
    assert found == {**dict.fromkeys([*range(41), 100], 0), 200: 200, 201: 200}


@pytest.mark.parametrize("block", [256, 5])
def test_embeddings(spark, block):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 16))
    near = np.repeat(base[:8], 6, axis=0) + 0.08 * rng.standard_normal((48, 16))
    x = np.vstack([base, near, base[:3]]).astype(np.float32)
    label = [i % 2 for i in range(len(x))]
    rows = [(i, v.tolist(), y) for i, (v, y) in enumerate(zip(x, label, strict=True))]
    out = neardup.embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=block).collect()
    v = x.astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    links = [(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if label[i] == label[j] and v[i] @ v[j] >= 0.98]
    n = collections.Counter(i for pair in links for i in pair)
    assert links
    assert {r["vec_id"]: r["n_links"] for r in out} == {i: n[i] for i in range(len(v))}
    assert {r["vec_id"]: r["component_id"] for r in out} == roots(range(len(v)), links)


def test_collisions():
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((9, 4)), rng.standard_normal((7, 4))
    assert (neardup.collisions(a, b, 0.5) == (np.abs(a[:, None] - b) <= 0.5).sum(axis=2)).all()


def test_sharding(docs):
    first = sharding.shard(docs, 4, F.octet_length("text"), "doc_id", bucket_bytes=2000).collect()
    again = sharding.shard(docs, 4, F.octet_length("text"), "doc_id", bucket_bytes=2000).collect()
    place = lambda rows: {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}
    assert place(first) == place(again)
    assert sorted(collections.Counter(s for s, _ in place(first).values()).values()) == [30] * 4
    assert sorted(sharding.fisher_yates(50, np.random.default_rng(1)).tolist()) == list(range(50))


def test_sharding_in_two_levels_is_the_same(docs):
    place = lambda **options: sorted((r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(docs, 5, F.octet_length("text"), "doc_id", bucket_bytes=1500, **options).collect())
    assert place() == place(most_buckets=4)


def test_offsets(spark):
    rows = [(i, i % 7 + 1) for i in range(0, 100, 3)]
    found = sharding._offsets(spark.createDataFrame(rows, "number long, n long"), "number", "n", wide=10).collect()
    assert sorted((r["number"], r["before"], r["all"]) for r in found) == [(i, sum(n for j, n in rows if j < i), sum(n for _, n in rows)) for i, _ in rows]


def test_sharding_is_uniform(spark):
    """Chi-square at about 1e-6: places of rows, orders of three, and the places that the rows of one stretch of the input get."""
    many = [sharding.fisher_yates(6, np.random.Generator(np.random.PCG64([s, 0]))).tolist() for s in range(6000)]
    counts = np.zeros((6, 6))
    for order in many:
        counts[np.arange(6), order] += 1
    assert ((counts - 1000) ** 2 / 1000).sum() < 70  # 25 degrees of freedom
    orders = collections.Counter(map(tuple, (o[:3] for o in many)))
    assert len(orders) == 120 and sum((n - 50) ** 2 / 50 for n in orders.values()) < 205  # 119 degrees of freedom
    rows = spark.range(4000).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text").coalesce(1)
    counts = np.zeros((8, 8))
    for r in sharding.shard(rows, 4, F.octet_length("text"), "doc_id", bucket_bytes=20_000).collect():
        counts[r["doc_id"] // 500, 2 * r["shard"] + r["slot"] // 500] += 1
    assert ((counts - 62.5) ** 2 / 62.5).sum() < 113  # 49 degrees of freedom


def test_word_tokens_equal_the_library():
    own, library = packing.WordTokens(WORDS), Tokenizer.from_buffer(WORDS)
    special = ["Some text. <|endoftext|> More", "a<|endoftext|>b<|ENDOFTEXT|>", "<|startoftext|><|endoftext|>'s", "<|end<|endoftext|>oftext|>", "é<|endoftext|>\u0301a"]
    texts = [*special, "", " ", "I'll don't 'S x's,", "İstanbul ΣΑΣ é́ 　 x", "a" * 500, "\x1c foo\x1e", "naïve 東京 😀", *[t for _, t in corpus()]]
    for text, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def word_tokens():
    return packing.WordTokens(WORDS), Tokenizer.from_buffer(WORDS)


PIECES = st.sampled_from([*"abIx'., \n\t\x1c\xa0é東ΣİÀ1-!?😀<|>", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "\u0301", "text"])


@settings(max_examples=250, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=40).map("".join), max_size=6))
def test_words_equal_the_library(word_tokens, texts):
    own, library = word_tokens
    for text, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_of_equal_hash(word_tokens):
    own, library = word_tokens
    texts = []
    for power in (10, 11, 12):
        bits = [bin(i).count("1") % 2 for i in range(1 << power)]
        texts += ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
        a, b = (own.words(np.frombuffer(t.encode(), np.uint8))[2] for t in texts[-2:])
        assert a == b
    texts += [f"{texts[0]} then {texts[1]}", f"{texts[1]} {texts[0]}"]
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert wanted[0] != wanted[1]
    own.forget()
    assert [x.tolist() for x in own.encode([t.encode() for t in texts])] == wanted
    for t, ids in zip(texts[::-1], wanted[::-1], strict=True):  # known words, one text at a time
        assert own.encode([t.encode()])[0].tolist() == ids == own.encode_long(t.encode()).tolist()


def test_long_words(word_tokens):
    own, library = word_tokens
    for text in ("x" * 300_000, "ab" * 100_000 + " " + "é" * 50_000, "".join(R.choice("abcd-'") for _ in range(100_000))):
        assert own.encode_long(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing(docs):
    library = Tokenizer.from_buffer(WORDS)
    rows = packing.pack(docs, WORDS, size=128, open_windows=16).collect()
    for i, text in docs.collect():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        pieces = sorted((r["start"], bytes(r["ids"])) for r in rows if r["doc_id"] == i)
        assert b"".join(p for _, p in pieces) == ids
    fill = sum(r["length"] for r in rows) / (128 * len({r["sequence_id"] for r in rows}))
    assert fill > 0.95


@pytest.fixture(scope="module")
def own_bpe():
    return bpe.ByteBPE(bpe.read_ranks(BYTES), public_tokenizers.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abeinorst \n\t\x1cé東1234!?'😀", max_size=900))
def test_bpe_equals_the_library(own_bpe, text):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own_bpe.ranks, special_tokens={})
    ids = own_bpe.encode_batch([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert own_bpe.decode(ids) == text.encode()


def test_bpe_long_rows(own_bpe):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own_bpe.ranks, special_tokens={})
    for text in ("a" * 5000, "ab" * 2000, "".join(R.choice("aeinorst") for _ in range(3000))):
        assert np.frombuffer(own_bpe.encode_batch([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_quality(spark):
    texts = [sentence(R.randint(1, 60)) for _ in range(40)]
    texts += [" ".join(sentence(6).split() * 3) + f"\n{sentence(3)}\nsame line\nsame line\n \n#*$ a|b" for _ in range(20)]
    rows = list(enumerate(texts))
    labels = spark.createDataFrame([(i, int(i < 30), int(i % 9 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), labels, buckets=512).collect()}

    def signed(h):
        return h - 2**64 if h >= 2**63 else h

    def buckets(words):
        h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
        pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), seed=xxhash.xxh64_intdigest(a.to_bytes(8, "little"), seed=42)) for a, b in zip(h, h[1:], strict=False)]
        return [signed(x) % 512 for x in h + pairs]

    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in rows}
    grams = {i: buckets(w) for i, w in words.items()}
    raw = collections.Counter(b for g in grams.values() for b in g)
    good = collections.Counter(b for i, g in grams.items() if i < 30 and i % 9 for b in g)
    scale = sum(good.values()) / sum(raw.values())
    for i, text in rows:
        w = words[i]
        at = collections.defaultdict(list)
        for k in range(len(w) - 4):
            at[tuple(w[k : k + 5])].append(k)
        covered = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(5)}
        lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
        r = out[i]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), len(covered), len(lines) - len(set(lines)))
        assert (r["word_chars"], r["n_symbols"]) == (sum(map(len, w)), sum(c in "#*$%&|<>" for c in text))
        llr = np.mean([np.log((good[b] + 16) / (raw[b] * scale + 16)) for b in grams[i]])
        assert r["llr"] == pytest.approx(llr, abs=1e-9)
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        assert (r["base_failed"], r["kept"]) == (failed, not failed and llr >= -0.08)


def edited(line):
    i = R.randrange(len(line))
    return R.choice([line[:i] + line[i + 1 :], line[:i] + "Z" + line[i + 1 :], line[:i] + "Z" + line[i:], line[:i] + "ZZZ" + line[i:]])


def test_lines(spark):
    lines = [sentence(R.randint(4, 40)) for _ in range(30)]
    lines += [edited(R.choice(lines)) for _ in range(60)] + ["short one", "x" * 70 + "é" * 70]
    rows = [(i, "\n".join(R.choice(lines) for _ in range(R.randint(1, 6)))) for i in range(50)]
    out = {r["doc_id"]: r["text"] for r in linedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def close(a, b):
        if a == b:
            return True
        if len(a) < len(b):
            a, b = b, a
        cut = {a[:i] + a[i + 1 :] for i in range(len(a))}
        return len(a) - len(b) <= 1 and (b in cut or len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1)

    seen = []
    for i, text in rows:
        stays = []
        for line in text.split("\n"):
            if len(line) < 20 or not any(close(line, s) for s in seen):
                stays.append(line)
            if len(line) >= 20:
                seen.append(line)
        assert out[i] == "\n".join(stays)


def test_language(spark):
    alphabet = {"de": "abdeunß", "en": "thewiso", "es": "ñaoclrq", "fr": "éèuxqle"}
    texts = [(i, " ".join("".join(R.choice(alphabet[x]) for _ in range(5)) for _ in range(40)), x) for i, x in enumerate(list(alphabet) * 30)]
    rows = [(i, t, x if i % 10 else "en", f"h{i % 3}.example.{x}") for i, t, x in texts] + [(999, "12 34 !!", "de", "h1.example.de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    out = {r["doc_id"]: r for r in langid.identify(df, declared=F.col("lang"), host=F.col("host")).collect()}
    assert all(out[i]["lang_id"] == x and out[i]["kept"] for i, _, x in texts)
    assert out[999]["lang_id"] == "zxx" and not out[999]["kept"]


def test_language_posterior(spark):
    """The whole posterior again, document by document: trigrams, declarations, and priors down the hierarchy; ties; declared markup."""
    names = ["aa", "bb", "zxx"]
    alphabet = {"aa": "abcde", "bb": "cdefg"}
    rows = []
    for i in range(60):
        lang = ("aa", "bb")[i % 2]
        text = " ".join("".join(R.choice(alphabet[lang]) for _ in range(4)) for _ in range(R.randint(1, 6)))
        page = f"<HTML class=x lang='{R.choice([lang, lang, 'bb'])}-XY'>" if i % 3 else "<html>"
        rows.append((i, text, page, R.choice([f"h{i % 4}.site.{lang}", "h9.site.bb", "localhost", "10.0.0.7", None])))
    rows += [(60, None, "<html lang=aa>", "h0.site.aa"), (61, "", "", None), (62, "12 34", "<html lang=aa>", "h0.site.aa"), (63, "ce", "<p lang=aa>", None), (63, "ce", "<p lang=aa>", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, html string, host string")
    declared = langid.declared_language(F.col("html"))
    options = {"languages": ("aa", "bb"), "temper": 0.1, "strength": 20.0}
    model = langid.fit_text_model(df, "doc_id", "text", declared, ("aa", "bb"), 2000).astype(np.float64)
    out = langid.identify(df, declared=declared, host=F.col("host"), **options).collect()

    def say(page):
        found = re.search(r"<html[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", page, re.I | re.S)
        return "none" if not found else found[1].lower() if found[1].lower() in names[:2] else "other"

    def tail(host):
        found = re.search(r"\.([A-Za-z]{2,24})\.?$", host or "")
        return found[1].lower() if found else None

    seen = []
    for i, text, page, host in rows:
        data = f" {text.lower()} ".encode() if text and any(map(str.isalpha, text)) else b""
        grams = [((data[k] << 16 | data[k + 1] << 8 | data[k + 2]) * 2654435761 % 2**32) >> 16 for k in range(len(data) - 2)]
        ll = [sum(model[j][g] for g in grams) for j in range(3)]
        seen.append((i, ll, say(page), tail(host), host, int(np.argmax(ll)) if grams else None))
    votes = lambda test: np.array([sum(1.0 for s in seen if s[5] == j and test(s)) for j in range(3)])
    total = votes(lambda s: True)
    top = (total + 1) / (total.sum() + 3)
    expected = {}
    for i, ll, said, suffix, host, first in seen:
        if first is None:
            expected[i] = ("zxx", "zxx", 1.0)
            continue
        prior = top
        if suffix is not None:
            c = votes(lambda s, x=suffix: s[3] == x)
            prior = (c + 20 * prior) / (c.sum() + 20)
        if host is not None:
            c = votes(lambda s, x=host: s[4] == x)
            prior = (c + 20 * prior) / (c.sum() + 20)
        post = 0.1 * np.array(ll) + np.log((votes(lambda s, x=said: s[2] == x) + 1) / (total + 4)) + np.log(prior)
        p = np.exp(post - post.max())
        expected[i] = (names[first], names[int(np.argmax(post))], 1 / p.sum())
    assert len(out) == len(rows)
    for r in out:
        text_lang, lang, confidence = expected[r["doc_id"]]
        assert (r["text_lang"], r["lang_id"]) == (text_lang, lang)
        assert r["confidence"] == pytest.approx(confidence, abs=2e-5)
        assert r["kept"] == (lang != "zxx" and r["confidence"] >= 0.5)


def test_language_priors_decide_without_text(spark):
    rows = [(i, "der die das und nicht", "de", "a.example.de") for i in range(30)] + [(i, "the and not with", "en", "b.example.com") for i in range(30, 60)]
    rows += [(100, "ok", None, "a.example.de"), (101, "ok", None, "b.example.com")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    out = {r["doc_id"]: r["lang_id"] for r in langid.identify(df, declared=F.col("lang"), host=F.col("host"), languages=("de", "en"), temper=0.0).collect()}
    assert (out[100], out[101]) == ("de", "en")


def test_html_most_likely_labels():
    """Viterbi against all labellings, with random weights."""
    from itertools import product

    rng = np.random.default_rng(4)
    for n in range(1, 9):
        page = [((("body", ""), (R.choice(["p", "div", "li"]), R.choice(["", "ad", "story"]))), sentence(R.randint(1, 30)) + R.choice([".", ""]), 0) for _ in range(n)]
        feats = html_extract.page_features(page)
        index = {f: i for i, f in enumerate(sorted({f for row in feats for f in row}))}
        emit, move, start, end = rng.standard_normal((len(index), 2)), 2 * rng.standard_normal((2, 2)), rng.standard_normal(2), rng.standard_normal(2)

        def score(y, feats=feats, index=index, emit=emit, move=move, start=start, end=end):
            return start[y[0]] + end[y[-1]] + sum(emit[index[f], a] for a, row in zip(y, feats, strict=True) for f in row) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False))

        assert tuple(html_extract.Crf(index, emit, move, start, end).decode(page)) == max(product((0, 1), repeat=n), key=score)


def test_html_gradient():
    """The step's direction is the slope of the likelihood, measured by small changes."""
    from itertools import product

    pages = [(p, y) for p, y in labelled_pages(400, seed=8) if 2 <= len(y) <= 9][:6]
    data, index = html_extract.training_set(pages)
    rng = np.random.default_rng(5)
    params = [rng.standard_normal(s) * 0.3 for s in ((len(index), 2), (2, 2), (2,), (2,))]

    def likelihood(params):
        emit, move, start, end = params
        total = 0.0
        for page, gold in pages:
            rows = [[index[f] for f in row] for row in html_extract.page_features(list(blocks(page)))]
            score = lambda y, rows=rows: start[y[0]] + end[y[-1]] + sum(emit[r, a].sum() for a, r in zip(y, rows, strict=True)) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False))
            total += score(gold) - np.logaddexp.reduce([score(y) for y in product((0, 1), repeat=len(gold))])
        return total

    grads = html_extract.gradients(data, params)
    for k, p in enumerate(params):
        for _ in range(6):
            at = tuple(int(rng.integers(0, s)) for s in p.shape)
            p[at] += 1e-4
            up = likelihood(params)
            p[at] -= 2e-4
            down = likelihood(params)
            p[at] += 1e-4
            assert grads[k][at] == pytest.approx((up - down) / 2e-4, abs=2e-3)


def test_html_held_out():
    model = html_extract.default_model()
    pages = labelled_pages(150, seed=77)
    right = total = 0
    for page, labels in pages:
        found = model.decode(list(blocks(page)))
        assert len(found) == len(labels)
        right += sum(a == b for a, b in zip(found, labels, strict=True))
        total += len(labels)
    assert right / total > 0.98


def test_html_page():
    page = '<html><head><title>t</title></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class="ad">Buy</div><article><h1>Title &amp; more</h1><p><b>Bold.<br><p>Two\n  words&nbsp;here.</article><section id=comments><p>Nice, I liked it.</p></section><footer>&copy; us</footer>'
    assert html_extract.main_text(page, html_extract.default_model()) == "Title & more\n\nBold.\n\nTwo words here."


def archive(n):
    out = []
    for i in range(n):
        block = b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\npayload" + b"%02d" % i
        head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:%d>\r\nWARC-Block-Digest: sha256:%s\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n"
        import hashlib

        out.append(head % (i, hashlib.sha256(block).hexdigest().encode(), len(block)) + block + b"\r\n\r\n")
    return out


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 5), st.integers(0, 10_000), st.integers(1, 255), st.booleans())
def test_warc_damage_costs_one_record(which, at, flip, zipped):
    import gzip

    parts = [gzip.compress(r, mtime=0) if zipped else r for r in archive(6)]
    start = sum(map(len, parts[:which]))
    data = bytearray(b"".join(parts))
    data[start + at % len(parts[which])] ^= flip
    found = list(warc.salvage(bytes(data)))
    assert found[0][1] == 0 and found[-1][2] == len(data)
    assert all(a[2] == b[1] for a, b in zip(found, found[1:], strict=False) if a[1:3] != b[1:3])
    ids = {x["fields"]["warc-record-id"] for kind, _, _, x in found if kind == "record"}
    assert ids >= {f"<urn:x-page:{i}>" for i in range(6) if i not in (which, which - 1 if at % len(parts[which]) == 0 else which)}
    assert len([1 for kind, *_ in found if kind == "gap"]) <= 1


def test_warc_many_members_take_linear_time():
    import gzip
    import time

    took = []
    for n in (8000, 16000):
        data = b"".join(gzip.compress(r, 1, mtime=0) for r in archive(n))
        start = time.perf_counter()
        assert sum(kind == "record" for kind, *_ in warc.salvage(data)) == n
        took.append(time.perf_counter() - start)
    assert took[1] < 3 * took[0] + 1


def test_warc_many_false_starts_take_linear_time():
    import time

    start = time.perf_counter()
    found = list(warc.salvage(b"WARC/1.1\r\na: b\r\n" * 200_000 + archive(1)[0]))
    assert [kind for kind, *_ in found] == ["gap", "record"]
    assert time.perf_counter() - start < 20


def test_warc_nested_claims_take_linear_time():
    """Records that each claim all later ones, with a digest that differs: the whole one among them is found."""
    import time

    def nested(n):
        data = archive(1)[0]
        tail = len(data) + 4
        parts = []
        for i in range(n):
            head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:{i}>\r\nWARC-Block-Digest: sha256:{'0' * 64}\r\nContent-Length: "
            size = f"{tail:09d}\r\n\r\n"
            parts.append(head + size)
            tail += len(head) + len(size)
        return "".join(reversed(parts)).encode() + data + b"\r\n\r\n"

    took = []
    for n in (2000, 20_000):
        start = time.perf_counter()
        found = list(warc.salvage(nested(n)))
        took.append(time.perf_counter() - start)
        assert [x["fields"]["warc-record-id"] for kind, _, _, x in found if kind == "record"] == ["<urn:x-page:0>"]
    assert took[1] < 25 * max(took[0], 0.05)


def test_warc_members_of_many_records():
    import gzip

    parts = archive(6)
    whole = gzip.compress(b"".join(parts), mtime=0)
    assert [x["fields"]["warc-record-id"] for _, _, _, x in warc.salvage(whole)] == [f"<urn:x-page:{i}>" for i in range(6)]
    broken = bytearray(b"".join(parts))
    broken[len(b"".join(parts[:3])) + len(parts[3]) - 8] ^= 1
    found = list(warc.salvage(gzip.compress(bytes(broken), mtime=0)))
    assert [kind for kind, *_ in found] == ["record"] * 3 + ["gap"] + ["record"] * 2
    for level in (0, 6):
        whole = gzip.compress(b"".join(parts), level, mtime=0)
        cut = whole[: -len(parts[5]) // 2 if level == 0 else -20]
        for after in (parts[0], gzip.compress(parts[0], mtime=0)):
            found = list(warc.salvage(cut + after))
            assert [kind for kind, *_ in found] == ["record"] * 5 + ["gap", "record"]
            assert found[5][1:3] == (0, len(cut)) and found[6][1:3] == (len(cut), len(cut) + len(after))


def test_warc_urls_and_long_headers(spark):
    urls = ["http://a/x%20y", "http://a/%", "http://é.fr/?q=a b#c", "u" * 3_000_000, None, "http://a/x\r\ny"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit("z"))
    out = {r["page_id"]: r["target_uri"] for r in warc.read_warc(spark, warc.write_warc(df)).withColumn("page_id", warc.page_id(F.col("record_id"))).collect()}
    assert [out[i] for i in range(6)] == [*urls[:5], "http://a/x%0D%0Ay"]


def test_warc_files_are_bounded(spark):
    pages = [(i, "u", "x" * n) for i, n in enumerate([10] * 50 + [4000] * 20 + [70_000] * 3)]
    path = warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), least=1 << 20, file_records=32, file_bytes=1 << 17)
    files = spark.read.format("binaryFile").load(path).select("length").collect()
    assert max(r[0] for r in files) <= 1 << 17 and len(files) >= 10
    out = warc.read_warc(spark, path).withColumn("page_id", warc.page_id(F.col("record_id"))).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in out) == [(i, len(h)) for i, _, h in pages]


def test_warc_round_trip(spark):
    pages = [(i, f"http://x/{i}", "é<p>" * (i % 7 * 20)) for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = warc.read_warc(spark, warc.write_warc(df, file_records=7)).withColumn("page_id", warc.page_id(F.col("record_id"))).collect()
    first = {}
    for i, _, h in pages:
        if len(h.encode()) >= 100:
            first.setdefault(h, i)
    for r in out:
        i, _, h = pages[r["page_id"]]
        revisit = first.get(h, i) != i
        assert (r["record_type"], r["payload_bytes"]) == ("revisit" if revisit else "response", len(h.encode()))
        assert revisit or bytes(r["payload"]).decode() == h


def test_shards_are_alike_however_counts_are_joined(spark, monkeypatch):
    rows = spark.range(500).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text").coalesce(1)
    out = []
    for few in (sharding.FEW, 0):
        monkeypatch.setattr(sharding, "FEW", few)
        out.append(sorted(map(tuple, sharding.shard(rows, 4, F.octet_length("text"), "doc_id", bucket_bytes=2000).select("doc_id", "shard", "slot").collect())))
    assert out[0] == out[1] and len(out[0]) == 500
