"""Text operators against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import math
import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.llm import common, components, fingerprint, html_text, language, mixing, ngram_join, sentence_pieces, shingles, token_counts, topk, url_filter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 91}x{i}" for i in range(6000))
TEXTS = [None, "", "  \t\n", "One two three", "one TWO three", "a b c d e f g", "a b c d e f g h", LONG, LONG + " tail", "été 中文 <|endoftext|> it's ▁ \x00 😀", "!!! 123", "a b c d e f g"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, rid long, key long, row int, src string, gid long, lang_pred string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, [None, "b", "a"][i % 3], len(t or ""), "x", 1, 2, 3, "s", 4, "zz") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, "null id text here ok", None, None, None, None, None, None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def sets_of(text):
    w = WORD.findall((text or "").translate(str.maketrans(common.UPPER, common.LOWER)))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_join(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    sets = {i: sets_of(next(t for j, t in rows if j == i)) for i in ids}
    low = {i: i for i in ids}
    links = Counter()
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for a, b in linked:
        links[a] += 1
        links[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {i: (len(sets[i]), low[i], links[i]) for i in ids}


def noisy_family(seed, n, base=120):
    rnd = random.Random(seed)
    words = [f"w{rnd.randrange(4000)}" for _ in range(base)]
    out = []
    for _ in range(n):
        own = list(words)
        for _ in range(rnd.randrange(0, 6)):
            own[rnd.randrange(base)] = f"z{rnd.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("group_tokens", [100_000, 700])
def test_join_is_exact(spark, monkeypatch, group_tokens):
    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", group_tokens)
    rnd = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [*noisy_family(1, 25), *noisy_family(2, 9, 30), *[f"{passage} " + " ".join(f"q{rnd.randrange(10**6)}" for _ in range(k)) for k in (5, 15, 20, 60, 80)], "a b c", "A b C", "a b c d", "", None, "x y z w v u", "x y z w v u"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.ngram_jaccard_join(df).collect()}
    assert got == brute_join(rows)


def template_group(n):
    """A group of ``n`` short sets of one template, of which none links, and one that links with each."""
    sets = shingles.shingle_sets([*[f"one two three four five six seven x{i}" for i in range(n)], "one two three four five six seven"])
    return ngram_join.Group(np.arange(n + 1).tobytes(), np.full(n + 1, 2).tobytes(), np.array([len(s) for s in sets]).tobytes(), b"".join(s.tobytes() for s in sets))


def test_many_short_sets_are_compared_in_little_memory():
    group = template_group(6000)
    tracemalloc.start()
    try:
        _, low, links = ngram_join.tied(group, group, 75)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (low == 0).all() and (links[:-1] == 2).all() and links[-1] == 12_000
    assert peak < 200e6


@pytest.mark.parametrize("cells", [1, 50, 4_000_000])
def test_join_in_blocks(monkeypatch, cells):
    monkeypatch.setattr(ngram_join, "BLOCK_CELLS", cells)
    texts = [*noisy_family(1, 25), *noisy_family(2, 9, 30), *noisy_family(7, 12, 40)]
    sets = [s for s in shingles.shingle_sets(texts)]

    def group(ids):
        return ngram_join.Group(np.array(ids).tobytes(), np.ones(len(ids), np.int64).tobytes(), np.array([len(sets[i]) for i in ids]).tobytes(), b"".join(sets[i].tobytes() for i in ids))

    want = brute_join(list(enumerate(texts)))
    whole = group(range(len(texts)))
    assert [(int(i), int(low), int(k)) for i, low, k in zip(*ngram_join.tied(whole, whole, 75), strict=True)] == [(i, low, k) for i, (_, low, k) in want.items()]
    odd, even = group(range(1, len(texts), 2)), group(range(0, len(texts), 2))
    parts = [ngram_join.tied(odd, odd, 75), ngram_join.tied(even, even, 75), ngram_join.tied(odd, even, 75)]
    total = Counter()
    for rids, _, links in parts:
        total.update(dict(zip(rids.tolist(), links.tolist(), strict=True)))
    assert dict(total) == {i: k for i, (_, _, k) in want.items()}


def test_join_of_many_short_texts_of_one_template(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three four five six seven x"), "id").alias("text"))
    got = ngram_join.ngram_jaccard_join(df.union(spark.createDataFrame([(30_000, "one two three four five six seven")], df.schema)))
    assert got.groupBy("component_id").agg(F.count("*"), F.sum("n_links"), F.max("n_links")).collect() == [(0, 30_001, 60_000, 30_000)]


def test_join_edges(docs, none):
    got = ngram_join.ngram_jaccard_join(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[0]["component_id"] == 0 and by[0]["n_shingles"] == 0 and by[2]["n_links"] == 0
    assert by[4]["component_id"] == 3 and by[11]["component_id"] == 5 and by[8]["component_id"] == 7
    assert by[None]["n_links"] == 0 and by[None]["component_id"] is None
    assert ngram_join.ngram_jaccard_join(none).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {0, 1, 2, 3, 5, 7, 9, 10, None} | ({6} if by[6]["component_id"] == 6 else set())


def test_join_of_repeated_and_missing_ids(spark):
    a, b = [[t, t + " and one end more"] for t in noisy_family(3, 2, 60)]
    rows = [(1, a[0]), (1, b[0]), (2, a[1]), (3, b[1]), (None, a[0]), (None, "p q r s t u v"), (None, "p q r s t u v"), (None, "p q r s t u v"), (1, a[0]), (9, "k l m n o p q r s t"), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.ngram_jaccard_join(df).collect()), key=repr)
    sets = [sets_of(t) for _, t in rows]
    link = lambda x, y: bool(x) and bool(y) and 100 * len(x & y) >= 75 * len(x | y)
    want = []
    for i, (doc, _) in enumerate(rows):
        reach = {i}
        while more := {k for k in range(len(rows)) if k not in reach and any(link(sets[k], sets[j]) for j in reach)}:
            reach |= more
        want.append((doc, len(sets[i]), min((rows[k][0] for k in reach if rows[k][0] is not None), default=None), sum(link(sets[i], s) for k, s in enumerate(sets) if k != i)))
    assert got == sorted(want, key=repr)
    kept = sorted((repr(r["doc_id"]), r["text"] or "") for r in ngram_join.one_of_each(df.withColumn("row_key", F.lit(1)).withColumn("_row_key", F.lit(2))).select("doc_id", "text").collect())
    assert kept == sorted([("1", a[0]), ("1", b[0]), ("None", "p q r s t u v"), ("9", rows[9][1]), ("None", ""), ("None", "")])


@pytest.mark.parametrize("hot", [1, 10])
def test_join_with_hot_tokens(spark, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "LEAST_HOT", hot)
    monkeypatch.setattr(ngram_join, "HOT_PARTS", 10**9)
    monkeypatch.setattr(ngram_join, "FLUSH", 300)
    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", 700)
    rows = list(enumerate([*noisy_family(1, 30), *noisy_family(2, 9, 30), *noisy_family(5, 2, 80)]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_join(rows)


def test_unions_are_bounded_before_groups_are_opened(spark):
    def group(gid, texts):
        sets = shingles.shingle_sets(texts)
        return gid, np.arange(len(sets)).tobytes(), np.ones(len(sets), np.int64).tobytes(), np.array([len(s) for s in sets]).tobytes(), b"".join(s.tobytes() for s in sets)

    near = noisy_family(6, 8, 60)
    far = [" ".join(t.split()[:9] + [f"o{k}x{i}" for i in range(50)]) for k, t in enumerate(near)]
    groups = spark.createDataFrame([group(1, near[:4]), group(2, near[4:]), group(3, far)], "gid long, rids binary, weights binary, sizes binary, tokens binary")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "gida long, gidb long")
    assert [tuple(r) for r in ngram_join._qualifying(pairs, ngram_join._unions(groups), 0, 75).collect()] == [(1, 2)]


def test_shingles_of_all_shapes():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aB \t\n\x0b~é") for _ in range(rnd.randrange(60))) for _ in range(500)] + ["x" * 5000 + " y", "x" * 5000 + " z"]
    found = shingles.shingle_sets(texts)
    assert [len(s) for s in found] == [len(sets_of(t)) for t in texts]
    same = {}
    for t, s in zip(texts, found, strict=True):
        assert same.setdefault(sets_of(t), s.tobytes()) == s.tobytes()


def test_components(spark):
    rnd = random.Random(8)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 470)] + [(9, 9)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    low = {x: x for e in links for x in e}
    for _ in range(500):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    assert got == {k: v for k, v in low.items() if any(k in e and e[0] != e[1] for e in links)}


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.vocabulary_path(token_counts.VOCABULARY))
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for r in token_counts.count_tokens(docs, limit=9).join(docs.select("doc_id", "text"), "doc_id").collect():
        text = r["text"] or ""
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (size(text), len(text.encode()), size(text) > 9)
        if len(text) < 100:
            assert r["fit_chars"] == max(p for p in range(len(text) + 1) if size(text[:p]) <= 9)
    assert token_counts.count_tokens(none).count() == 0


def test_prefix_counts():
    from tokenizers import Tokenizer

    path = token_counts.vocabulary_path(token_counts.VOCABULARY)
    library, mine = Tokenizer.from_file(path), token_counts.WordCounter(path)
    for word in ("internationalization", "don't!!'re", "İstanbulΣ", "<|endoftext|>x", "éa"):
        assert list(mine.prefixes(word)) == [len(library.encode(word[:p], add_special_tokens=False).ids) for p in range(1, len(word) + 1)]


def test_fitting_prefix_is_the_longest():
    mine = token_counts.WordCounter(token_counts.vocabulary_path(token_counts.VOCABULARY))
    rnd = random.Random(12)
    signs = ["a", "the", "re", "'", "'re", "!", "7", "é", "e\u0301", "\u0323", "\u0301", "中", "文", "한", "\u1112\u1161\u11ab", "Σ", "İ", "<|endoftext|>", "<|end", "😀", "\u0344", "ﬁ", "\u0958"]
    for _ in range(400):
        chunk = "".join(rnd.choice(signs[rnd.randrange(3) * 6 :]) for _ in range(rnd.randrange(1, 30)))
        sizes = [mine.count(chunk[:p]) for p in range(len(chunk) + 1)]
        table = mine.table(chunk)
        assert [table.at(p) for p in range(len(chunk) + 1)] == sizes, ascii(chunk)
        for budget in range(0, sizes[-1] + 1, 3):
            assert mine.inside(chunk, budget) == table.fitting(budget) == max(p for p, n in enumerate(sizes) if n <= budget), (ascii(chunk), budget)


@pytest.mark.parametrize("kind", ["base64", "chinese", "letters", "code", "decomposed"])
def test_a_long_chunk_is_cut_in_one_pass(kind):
    mine = token_counts.WordCounter(token_counts.vocabulary_path(token_counts.VOCABULARY))
    rnd = random.Random(13)
    made = {
        "base64": lambda: base64.b64encode(rnd.randbytes(750_000)).decode(),
        "chinese": lambda: "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(330_000)),
        "letters": lambda: "".join(rnd.choices("etaoinshrdlu", k=1_000_000)),
        "code": lambda: "".join(rnd.choices(["if(", "a", "b1", ")", "{", "return", "};", "'re", "x=>"], k=350_000)),
        "decomposed": lambda: "".join(rnd.choices(["e\u0301", "a", "o\u0302\u0323", "t"], k=350_000)),
    }
    text = made[kind]()
    started = time.process_time()
    fit = mine.table(text).fitting(2048)
    assert time.process_time() - started < 60
    assert mine.count(text[:fit]) <= 2048 and all(mine.count(text[: fit + k]) > 2048 for k in range(1, 40))


def test_parts_are_decoded_once(monkeypatch):
    codec = sentence_pieces.Codec(token_counts.vocabulary_path(sentence_pieces.MODEL))
    texts = ["", "plain words, plain words", "odd \u2581 mark \U0001f980\u00e9\ufffd\u4e00 <0x41>", "x" * 90 + " end", "a  b\n\tc" * 30]
    whole = [codec.decode(np.frombuffer(codec.encode(t)[0], np.int32)) == t.replace(sentence_pieces.MARK, " ") for t in texts]
    asked, decode = [], codec.decode
    monkeypatch.setattr(codec, "decode", lambda ids: asked.append(len(ids)) or decode(ids))
    assert [codec.restores(t, codec.encode(t)[0]) for t in texts] == whole == [True] * len(texts)
    assert len(asked) <= 1  # only what went through the window piece by piece
    codec.raw[codec.pieces.pieces.index("\u2581new")] = b"?"  # an id that does not give its letters back
    found, _ = codec.encode("a new one")
    assert not codec.sure and codec.restores("a new one", found) and "\u2581new" not in codec.memo


def test_sentence_pieces(docs, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=token_counts.vocabulary_path(sentence_pieces.MODEL))
    for r in sentence_pieces.encode_documents(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r["token_ids"] == library.encode(r["text"] or "") and r["n_tokens"] == len(r["token_ids"]) and r["restored"]
    assert sentence_pieces.encode_documents(none).count() == 0


@pytest.mark.parametrize("part", [1, 7, 64, 1000])
def test_streaming_commits_early(part):
    import sentencepiece

    path = token_counts.vocabulary_path(sentence_pieces.MODEL)
    library, pieces = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.Pieces(path)
    rnd = random.Random(part)
    text = "".join(rnd.choice("abcdeth漢 ") for _ in range(3000))
    stream = sentence_pieces.StreamingEncoder(pieces)
    normal = sentence_pieces.MARK + text.replace(" ", sentence_pieces.MARK)
    ids = [i for at in range(0, len(normal), part) for i in stream.feed(normal[at : at + part])]
    widest = stream.widest
    assert [*ids, *stream.flush()] == library.encode(text) and widest < 200
    codec = sentence_pieces.Codec(path)
    assert codec.decode(np.array(library.encode(text), np.int32)) == text


PAGE = """<html><head><title>t</title><script>if (a<b) x("<p>no</p>")</script></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div id=cookie-notice>We use cookies on this site and many other things you should know about.</div><main><article><header><h1>Title &amp; more</h1></header><p>First   paragraph<br>of the text, with <a href=x>a link</a>.<p>Second &lt;one&gt;&nbsp;here &#233;.<ul><li>item<li>other</ul></article>
<section class="comments"><article class=comment><p>I disagree with all of it, and will tell you why at great length and without pause.</p></article></section></main><aside>Related</aside><form><label>Name</label><input></form><footer>end</footer></body></html>"""


def test_html(spark):
    want = "Title & more\n\nFirst paragraph of the text, with a link.\n\nSecond <one> here é.\n\nitem\n\nother"
    assert html_text.extract(PAGE) == want
    assert [html_text.extract(x) for x in (None, "", "<p>", "plain", "<p>a<p>b", "<b>x", "<div class=nav>only this</div>")] == ["", "", "", "plain", "a\n\nb", "x", "only this"]
    assert html_text.extract("<div>" * 3000 + "deep") == "deep"
    plain = "<html><body><div class=menu><a href=a>A</a> <a href=b>B</a></div><div id=c>" + "".join(f"<p>Sentence number {k} of a text without any article tag at all.</p>" for k in range(9)) + "</div><div class=ad>buy</div></body></html>"
    assert html_text.extract(plain) == "\n\n".join(f"Sentence number {k} of a text without any article tag at all." for k in range(9))
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = html_text.extract_pages(pages).collect()
    assert sorted((r["n_chars"], r["text"]) for r in got) == sorted([(0, ""), (len(want), want), (len(want), want)])
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_urls(spark):
    urls = ["http://a.com/en/1", "HTTP://Example.COM/en/7x", "x://example.com?/en/7", "http://y.net/de/8", "http://q.example.net/de/88#f", "http://badorg/es/1", "http://org/es/", None, "no scheme", "http://com", "http://COM/en/://"]
    df = spark.createDataFrame([(i, u, "h", "p", "k") for i, u in enumerate(urls)] + [(0, urls[0], "h", "p", "k")], "page_id long, url string, host string, path string, key string")
    rules = spark.createDataFrame(url_filter.RULES, "action string, host string, path string")
    got = sorted(tuple(r) for r in url_filter.filter_urls(df, rules).collect())
    want = []
    for i, u in [*enumerate(urls), (0, urls[0])]:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0].lower()
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fit = max(((len(h + p), h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, "allow"))
        want.append((i, host, path, fit[1], fit[2]))
    assert got == sorted(want)
    assert {r["verdict"] for r in url_filter.filter_urls(df, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom = url_filter.bloom_filter(keys, 128)
    passed = lambda df: df.withColumn("block", url_filter.bloom_block(F.col("key"), 128)).join(bloom, "block").where(" and ".join(f"(w{i} & m{i}) = m{i}" for i in range(8))).count()
    masks = lambda df: df.select("key", *[m.alias(f"m{i}") for i, m in enumerate(url_filter.bloom_masks(F.col("key")))])
    assert passed(masks(keys)) == 3000
    assert passed(masks(spark.range(3000).select(F.concat(F.lit("other"), "id").alias("key")))) < 150


@pytest.mark.parametrize("least", [0, 3])
def test_warc(spark, least):
    rows = [(5, "http://a", "same"), (3, "http://b", "same"), (9, None, None), (8, "http://c\r\nWARC-Type: x", ""), (7, "u", "é"), (7, "u", "é"), (None, "n", "lone"), (None, "n", "same"), (11, "v", "ab"), (12, "v", "ab")]
    df = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    archive = warc.read_archive(spark, warc.write_archive(df, least))
    body = lambda t: (t or "").encode()
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[body(t)] = min(i, first.get(body(t), i))
    want = []
    for i, _, t in rows:
        again = len(body(t)) >= least and body(t) in first and i != first[body(t)]
        want.append((i, len(body(t)), base64.b32encode(hashlib.sha1(body(t)).digest()).decode(), "revisit" if again else "response", first[body(t)] if again else None))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in warc.read_records(archive).collect())
    assert archive.payloads.count() == len({body(t) for _, _, t in rows})
    rebuilt = warc.rebuild(archive).collect()
    assert sorted((repr(r["page_id"]), repr(r["url"])) for r in rebuilt) == sorted((repr(i), repr(u)) for i, u, _ in rows)
    for r in rebuilt:
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and {"WARC-Date", "WARC-Record-ID", "WARC-Type"} <= set(fields) and block.endswith(b"\r\n\r\n")
        assert int(fields["Content-Length"]) == len(block) - 4
        if fields["WARC-Type"] == "response":
            assert block[:-4].partition(b"\r\n\r\n")[2] in {body(t) for i, u, t in rows if (i, u) == (r["page_id"], r["url"])}
        else:
            assert len(block) == 4 and "WARC-Refers-To" in fields
    ids = {}
    for r in rebuilt:
        ids.setdefault(re.search(rb"WARC-Record-ID: (\S+)", bytes(r["record"]))[1], set()).add((r["page_id"], r["url"]))
    assert all(len(v) == 1 for v in ids.values())


def test_warc_of_nothing_and_of_changed_bytes(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.read_archive(spark, warc.write_archive(empty))).count() == 0
    bad = warc.Archive(spark.createDataFrame([("0" * 64, bytearray(b"x"))], "digest string, payload binary"), None)
    with pytest.raises(Exception, match="does not match"):
        warc.verified(bad).collect()
    good = warc.read_archive(spark, warc.write_archive(spark.createDataFrame([(1, "u", "page")], empty.schema)))
    changed = warc.rebuild(good).withColumn("record", F.expr("cast(replace(decode(record, 'UTF-8'), 'page', 'gape') as binary)"))
    with pytest.raises(Exception, match="another payload"):
        warc.parsed(changed).collect()


def brute_targets(sizes, share, most, weights):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    cap = {s: most * sizes[s] for s in names}
    target, open_ = {}, list(names)
    left = share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > cap[s]]
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = cap[s]
            left -= cap[s]
        open_ = [s for s in open_ if s not in over]
    return target


def test_mixing(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["b", "a", "z", "hot", "hot", "hot", None]), " ".join(["w"] * rnd.randrange(0, 40))) for i in range(600)] + [(600, "tiny", "x"), (601, "empty", None), (5, "a", "again x")]
    names = "size long, name string, bucket long, mix_times int, mix_copy int, _rank long, _times int, _copy int, _rows int, src string"
    df = spark.createDataFrame([(*r, 1, "n", 2, 3, 4, 5, 6, 7, 8, "s") for r in rows], f"doc_id long, source string, text string, {names}")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = brute_targets(dict(sizes), 1.5, 2.0, (5, 2, 1))
    named = {i: s for i, s, _ in rows}
    taken = Counter()
    for r in got:
        s = named[r["doc_id"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], want[s], abs_tol=1e-6) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))
    assert mixing.mix(df.limit(0)).count() == 0
    again = mixing.repeated(df)
    assert again.columns == df.columns and again.select(*[c for c in df.columns if c not in ("doc_id", "source", "text")]).distinct().collect() == [(1, "n", 2, 3, 4, 5, 6, 7, 8, "s")]
    times = Counter(r["doc_id"] for r in again.collect())
    assert max(times.values()) <= 4 and times[601] == 1


def test_null_ids_are_mixed(spark):
    rows = [(None if i % 3 == 0 else i, [None, "a", "b"][i % 7 % 3], " ".join(["w"] * (5 + i))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r["doc_id"], r["size"]] += int(r["taken"] / r["size"] + 0.5)
    got = Counter((r["doc_id"], len(r["text"].split())) for r in mixing.repeated(df).collect())
    assert got == +want and any(i is None for i, _ in got)


def test_rows_that_are_alike_share(spark):
    rows = [(None, "a", "x y z")] * 400 + [(1, "b", "w " * 30)] + [(2, "c", "v " * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df).collect()
    want = brute_targets({"a": 1200, "b": 30, "c": 2000}, 1.5, 2.0, (5, 2, 1))
    taken = Counter()
    for r in got:
        taken[r["source_size"]] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[n] - want[s]) <= 1 for s, n in (("a", 1200), ("b", 30), ("c", 2000)))


def test_a_source_of_equal_rows_meets_its_target(spark):
    rows = [(i, "a", " ".join(["w"] * (1 + i % 9))) for i in range(300)] + [(None, "b", "x")] * 1000
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, source string, text string, lot long").repartition(7)
    size = sum(1 + i % 9 for i in range(300))
    want = brute_targets({"a": size, "b": 1000}, 1.5, 2.0, (5, 2, 1))
    got = mixing.mix(df).collect()
    of = lambda n: [r["taken"] for r in got if r["source_size"] == n]
    assert abs(sum(of(size)) - want["a"]) <= 1 and abs(sum(of(1000)) - want["b"]) <= 1
    assert max(of(1000)) - min(of(1000)) <= 1
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    mixed = mixing.repeated(df)
    assert mixed.columns == df.columns
    assert abs(mixed.where("source = 'b'").count() - want["b"]) <= 1


def test_words_are_counted(spark):
    texts = ["", " a", "a\u00a0b c\x0b\x0c d\r\n", "\x1f x", "😀 y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(mixing.n_words(F.col("t"))).collect()] == [len(WORD.findall(t)) for t in texts]


def test_fingerprints(spark, docs, none):
    got = fingerprint.fingerprint_documents(docs).collect()
    assert len(got) == docs.count()
    order = [None, *sorted((i for i in range(len(TEXTS))))]  # ascending, null id below all
    text = {i: t or "" for i, t in enumerate(TEXTS)} | {None: "null id text here ok"}
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    for r in got:
        t = text[r["doc_id"]]
        following = order[order.index(r["doc_id"]) - 1]
        half = len(t) // 2
        edited = t[: len(t) - half] + text[following][:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1
        same = sum(r["fingerprint"][8 * k : 8 * k + 8] == prints[following][8 * k : 8 * k + 8] for k in range(fingerprint.SAMPLES)) / fingerprint.SAMPLES
        assert r["near_next"] == same
        if edited == t:
            assert r["edited_fingerprint"] == r["fingerprint"]
    assert prints[5] == prints[11] and prints[0] == prints[1] == prints[2] and prints[5] != prints[6]
    assert fingerprint.fingerprint_documents(none).count() == 0


def test_samples_collide_as_generalised_jaccard(spark):
    rnd = random.Random(4)
    a, b = [Counter({f"t{k}": rnd.randrange(0, 9) for k in range(60)}) for _ in range(2)]
    want = sum(min(a[k], b[k]) for k in a | b) / sum(max(a[k], b[k]) for k in a | b)
    text = lambda c: " ".join(k for k, n in c.items() for _ in range(n))
    df = spark.createDataFrame([(0, text(a)), (1, text(b))], "id int, body string")
    n = 256
    x, y = (r["fingerprint"] for r in fingerprint.fingerprints(df, ["id"], "body", n).orderBy("id").collect())
    assert abs(sum(x[8 * k : 8 * k + 8] == y[8 * k : 8 * k + 8] for k in range(n)) / n - want) < 0.12


def test_rows_that_share_an_id_have_one_stand_in(spark):
    rows = [(7, "head one two three four"), (7, "other words stand here now"), (9, "a b c d e f g h"), (None, "nameless first text"), (None, "second without a name"), (None, "second without a name")]
    got = fingerprint.fingerprint_documents(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row int, key long")).collect()
    assert len(got) == len(rows)
    own = {r["edited_sha256"]: r for r in got}
    nine = next(r for r in got if r["doc_id"] == 9)
    heads = {hashlib.sha256(("a b c d " + t[:7]).encode()).hexdigest(): t for i, t in rows if i == 7}
    stand_in = heads[nine["edited_sha256"]]
    prints = {}
    for r in spark.createDataFrame(rows, "doc_id long, text string").select("text").distinct().collect():
        x = fingerprint.fingerprint_documents(spark.createDataFrame([(1, r["text"])], "doc_id long, text string")).first()
        prints[r["text"]] = x["fingerprint"]
    n = fingerprint.SAMPLES
    same = sum(prints[rows[2][1]][8 * k : 8 * k + 8] == prints[stand_in][8 * k : 8 * k + 8] for k in range(n)) / n
    assert nine["near_next"] == same and own


def test_error_of_the_production_number_of_samples(spark):
    """Over many pairs of known likeness, estimates scatter by the binomial error and no more."""
    rnd = random.Random(14)
    pairs, rows = [], []
    for p in range(120):
        a = Counter({f"p{p}t{k}": rnd.randrange(1, 4) for k in range(60)})
        b = Counter({t: n for t, n in a.items() if rnd.random() < 0.88} | {f"p{p}z{k}": 1 for k in range(3)})
        pairs.append(sum(min(a[t], b[t]) for t in a | b) / sum(max(a[t], b[t]) for t in a | b))
        rows += [(2 * p, " ".join(a.elements())), (2 * p + 1, " ".join(b.elements()))]
    got = {r["id"]: r["fingerprint"] for r in fingerprint.fingerprints(spark.createDataFrame(rows, "id int, body string"), ["id"], "body").collect()}
    n = fingerprint.SAMPLES
    off = []
    for p, want in enumerate(pairs):
        x, y = got[2 * p], got[2 * p + 1]
        off.append((sum(x[8 * k : 8 * k + 8] == y[8 * k : 8 * k + 8] for k in range(n)) / n - want) / math.sqrt(want * (1 - want) / n))
    assert abs(np.mean(off)) < 0.35 and 0.8 < np.std(off) < 1.2 and max(map(abs, off)) < 4.5


@pytest.mark.parametrize("block", [8_000_000, 600])
def test_topk(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_BYTES", block)
    monkeypatch.setattr(topk, "ROWS", 50)
    rnd = random.Random(6)
    vector = lambda: [rnd.uniform(-1, 1) for _ in range(6)]
    rows = [(i, vector()) for i in range(230)] + [(i, [0.5] * 6) for i in range(230, 300)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (40, vector()), (None, vector()), (305, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, id long")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(df, k=7).collect())
    fine = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in (r for r in fine if r[0] % 20 == 0):
        scores = sorted(((-sum(a * b for a, b in zip(v, w)), c) for c, w in fine if c != q))[:7]
        want += [(q, k, c, -s) for k, (s, c) in enumerate(scores, 1)]
    assert got == sorted(want)
    assert topk.search(df.limit(0)).count() == 0
    few = df.where("vec_id < 3")
    assert [(r["rank"], r["query_id"]) for r in topk.search(few).orderBy("rank").collect()] == [(1, 0), (2, 0)]


def test_language(spark, docs, none, sf):
    judged = language.with_language(docs, language.train(docs), "guess", "how")
    assert judged.columns == [*docs.columns, "guess", "how"]
    by = {r["doc_id"]: r for r in judged.collect()}
    assert [by[i]["guess"] for i in (0, 1, 2, 10)] == ["und"] * 4 and by[7]["guess"] == "en"
    assert {r["doc_id"] for r in language.identified(docs).collect()} == {3, 4, 5, 6, 7, 8, 9, 11, None}
    assert language.with_language(none, language.train(none)).count() == 0
    assert {r["lang_pred"] for r in language.with_language(docs.drop("lang_pred"), None).collect()} == {"und"}
    out = language.op5_language(spark, sf.replace("0.001", "0.01")).join(common.table(spark, sf.replace("0.001", "0.01"), "documents").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_scores_are_those_of_kernel_ridge_regression():
    """With every text a landmark: kernel by sets of hashed n-grams, and (K + n ridge I)^-1 y in full."""
    rnd = random.Random(17)
    words = {"a": ["lorem", "ipsum", "dolor", "sit"], "b": ["pater", "noster", "qui", "es"], "c": ["unter", "den", "linden", "baum"]}
    texts = [(" ".join(rnd.choices(words[k], k=9)) + f" {rnd.choice('xyz')}", k) for k in "abcab" * 4]
    found = [language.features(t) for t, _ in texts]
    sets = [set(np.flatnonzero(f).tolist()) for f in found]
    k = np.array([[len(x & y) / math.sqrt(len(x) * len(y)) for y in sets] for x in sets])
    y = np.array([[float(label == name) for name in "abc"] for _, label in texts])
    alpha = np.linalg.solve(k + language.RIDGE * len(texts) * np.eye(len(texts)), y)
    model = language.fit([np.packbits(f).tobytes() for f in found], [label for _, label in texts], landmarks=1000)
    new = "lorem noster sit es unter"
    mine = language.features(new)
    x = set(np.flatnonzero(mine).tolist())
    want = np.array([len(x & z) / math.sqrt(len(x) * len(z)) for z in sets]) @ alpha
    got = mine.astype(np.float32) @ model.weights / math.sqrt(mine.sum())
    assert np.abs(got - want).max() < 2e-3
    assert language.predict(model, [new])[0] == [model.labels[int(want.argmax())]]


def test_landmarks_of_every_label():
    labels = ["a"] * 1000 + ["b"] * 3 + ["c"]
    chosen = [labels[i] for i in language.chosen_landmarks(labels, 100)]
    assert 90 <= chosen.count("a") <= 101 and chosen.count("b") == 2 and chosen.count("c") == 1


def test_every_label_is_learnt(spark):
    rnd = random.Random(21)
    words = {f"l{k:02}": ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for k in range(60)}
    rows = [(i, " ".join(rnd.choices(words[lang], k=30)), lang) for i, lang in enumerate(sorted(words) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    assert model.labels == sorted(words)
    right = language.with_language(df, model).where(language.held_out(F.col("doc_id"))).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95


def test_the_stage_rejects_what_no_language_fits(spark, sf):
    documents = common.table(spark, sf.replace("0.001", "0.01"), "documents")
    strange = [(10**9 + i, t, None, "s", 1) for i, t in enumerate(["Это русский текст о разных вещах", "你好世界 这是一个测试", "qzxj wvkq xxzj jqwx"])]
    kept = language.identified(documents.unionByName(spark.createDataFrame(strange, documents.schema)))
    assert kept.where(f"doc_id >= {10**9}").count() == 0
    assert kept.count() == documents.where(r"text rlike '\\p{L}'").count()


def test_documents_stay_where_nothing_is_labelled(docs):
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language.train(unlabelled) is None
    assert {r["doc_id"] for r in language.identified(unlabelled).collect()} == {3, 4, 5, 6, 7, 8, 9, 11, None}


def test_pipeline(spark, tmp_path, docs):
    """Every stage against brute force, on rows with null and repeated ids, repeats and columns that clash with the stages' own."""
    import corpus_pipeline

    extra = {"rid": 1, "gid": 2, "row_key": 3, "mix_times": 4, "mix_copy": 5, "component_id": 6, "_row_key": 7, "_rank": 8}
    given = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(v).alias(k) for k, v in extra.items()])
    again = given.where("doc_id in (3, 10)").withColumn("doc_id", F.lit(3).cast("long"))
    given = given.unionByName(again).unionByName(given.where("doc_id is null")).unionByName(given.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    given.write.parquet(str(tmp_path / "documents.parquet"))
    given = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "mixing", "sentence_pieces"]
    stage = dict(corpus_pipeline.STAGES)
    pairs = lambda df: [(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()]

    one = common.stored(stage["language"](spark, given, str(tmp_path)), "t")
    assert one.columns == given.columns
    assert Counter(pairs(one)) == Counter(x for x in pairs(given) if x[1] and any(c.isalpha() for c in x[1]))

    two = common.stored(stage["near_copies"](spark, one, str(tmp_path)), "t")
    assert two.columns == given.columns
    rows = pairs(one)
    sets = [sets_of(t) for _, t, _ in rows]
    left, classes = set(range(len(rows))), []
    while left:
        reach, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            reach.add(i)
            near = {k for k in left if 100 * len(sets[i] & sets[k]) >= 75 * len(sets[i] | sets[k])}
            left -= near
            todo += near
        classes.append(reach)
    kept = pairs(two)
    assert len(kept) == len(classes)
    first = lambda ids: min((i for i in ids if i is not None), default=None)
    assert Counter(i for i, _, _ in kept) == Counter(first([rows[k][0] for k in c]) for c in classes)

    three = common.stored(stage["mixing"](spark, two, str(tmp_path)), "t")
    assert three.columns == given.columns and three.select(*extra).distinct().collect() == [tuple(extra.values())]
    size = lambda t: len(WORD.findall(t or ""))
    sizes, taken, most = Counter(), Counter(), Counter()
    for _, t, s in kept:
        sizes[s] += size(t)
        most[s] = max(most[s], size(t))
    for _, t, s in pairs(three):
        taken[s] += size(t)
    targets = brute_targets(dict(sizes), 1.5, 2.0, (5, 2, 1))
    assert all(abs(taken[s] - targets[s]) <= most[s] / 2 + 1 for s in sizes)
    times = Counter(pairs(three))
    assert all(n <= 2 * Counter(kept)[x] for x, n in times.items())

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=token_counts.vocabulary_path(sentence_pieces.MODEL))
    got = Counter((r["doc_id"], tuple(r["token_ids"]), r["restored"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == Counter((i, tuple(library.encode(t or "")), True) for i, t, _ in pairs(three))


def test_sql_of_the_registered_queries(spark, sf):
    import duckdb

    from skylattice.llm import queries

    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        r = c.execute(sql)
        order = [d[0] for d in r.description]
        assert sorted(map(repr, (tuple(x) for x in df.select(order).collect()))) == sorted(map(repr, r.fetchall())), name


def test_misses_end_at_the_filter(spark):
    keys = spark.range(400).select(F.concat(F.lit("k"), "id").alias("key"))
    probes = spark.range(20_000).select(F.col("id").alias("row"), F.concat(F.lit("k"), "id").alias("key"))
    bloom = url_filter.bloom_filter(keys, 16)
    passed = url_filter.possible(probes, bloom, 16)
    assert passed.where("row < 400").count() == 400 and passed.count() < 1200


def test_urls_where_the_list_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST", -1)
    test_urls(spark)


def test_topk_resolves_only_sufficient_entries():
    rnd = np.random.default_rng(4)
    queries, rows = rnd.integers(-60, 60, (5, 64)), rnd.integers(-60, 60, (4000, 64))
    exact = queries @ rows.T
    tile = topk.Lists(topk.partial_scores(queries, rows, 4))
    cutoff = np.sort(exact, axis=1)[:, -20]
    held = [(np.empty(0, np.int64), np.empty(0, np.int64))] * 5
    topk.sufficient(tile, np.arange(4000), np.full(5, -1), cutoff, held, 20)
    assert 0 < tile.resolved < 0.6 * exact.size
    for i, (ids, scores) in enumerate(held):
        want = topk.best(np.arange(4000), exact[i], 20)
        assert ids.tolist() == want.tolist() and scores.tolist() == exact[i][want].tolist()


def test_topk_fails_rather_than_overflow(spark):
    df = spark.createDataFrame([(0, [2.0**27] * 64), (1, [2.0**27] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.search(df).collect()
    with pytest.raises(Exception, match="64 bits"):
        topk.search(spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>")).collect()


def sentences(n, start=0):
    return [f"This is sentence number {k} of a text that says a few things at some length." for k in range(start, start + n)]


def paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


LINKS = "".join(f"<li><a href=/{k}>Item {k}</a></li>" for k in range(12))


def test_density_finds_the_text_without_telling_tags():
    want = sentences(7)
    page = f"<html><body><div><ul>{LINKS}</ul></div><div>{paragraphs(want)}</div><div><a href=a>About</a> <a href=b>Terms</a> <a href=c>Help</a> x</div></body></html>"
    assert html_text.extract(page) == "\n\n".join(want)
    order = html_text.measure(root := html_text.parse(page))
    assert root.best.name == "div" and root.best.total == max(x.total for x in order)
    inner = f"<body><div><ul>{LINKS}</ul></div><div><h1>A heading of the text, in a block of its own</h1><div>{paragraphs(want)}</div></div></body>"
    assert html_text.extract(inner) == "\n\n".join(["A heading of the text, in a block of its own", *want])


def test_the_greatest_sum_and_not_a_tag_decides():
    """The text beside an article of one line is the page's article where its sum is greater."""
    want = sentences(9)
    page = f"<body><div>{paragraphs(want)}</div><div><ul>{LINKS}</ul></div></body>"
    assert html_text.extract(page) == "\n\n".join(want)
    several = "<body>" + "".join(f"<article>{paragraphs(sentences(3, k))}</article>" for k in (0, 3, 6)) + f"<ul>{LINKS}</ul></body>"
    assert html_text.extract(several) == "\n\n".join(sentences(9))
    linked = f"<body><div>{paragraphs(want)}<ul>{LINKS}</ul></div></body>"
    assert html_text.extract(linked) == "\n\n".join(want)


def test_names_weigh_but_do_not_lose_a_story():
    story = " ".join(sentences(6))
    assert html_text.extract(f"<div class='story tags'><p>{story}</p></div><p>x</p>").startswith(story)
    assert html_text.extract(f"<body><div class=widget>{paragraphs(sentences(4))}</div></body>") == "\n\n".join(sentences(4))
    with_ad = f"<body><div id=a>{paragraphs(sentences(4))}<div class=ad>{' '.join(sentences(9))}</div></div></body>"
    assert html_text.extract(with_ad) == "\n\n".join(sentences(4))


def test_html_is_scanned_as_browsers_do():
    assert html_text.extract("<p title=don't>first</p><p>second</p>") == "first\n\nsecond"
    assert html_text.extract("<p title='a>b' data-x=\"</p>\" hidden-not>first<p class=>second") == "first\n\nsecond"
    assert html_text.extract("<p>1 < 2 and <3 and a<b</p") == "1 < 2 and <3 and a"


@pytest.mark.parametrize("part", ["</b>", "<span></i>", "<div>", "<noscript>", "<p a='", "<a ", "<li>", "<ul><li>", "<!--", "<table><td>", "<", "x=\"'"])
def test_long_pages_take_linear_time(part):
    started = time.process_time()
    html_text.extract("<p>start<b>" + part * 200_000)
    assert time.process_time() - started < 20


def test_prefix_table_answers_without_encoding_again(monkeypatch):
    mine = token_counts.WordCounter(token_counts.vocabulary_path(token_counts.VOCABULARY))
    rnd = random.Random(31)
    signs = ["internationalization", "don't", " ", "  \n", "é中文", "e\u0301", "<|endoftext|>", "!!", "x9", "\u00a0", "antidisestablishment" * 4]
    texts = ["".join(rnd.choices(signs, k=rnd.randrange(25))) for _ in range(60)]
    size = lambda t: sum(map(mine.count, token_counts.CHUNK.findall(t)))
    sizes = [[size(t[:p]) for p in range(len(t) + 1)] for t in texts]
    tables = [mine.table(t) for t in texts]
    assert [[t.at(p) for p in range(len(t.text) + 1)] for t in tables] == sizes
    short = [(t, s) for t, s in zip(tables, sizes, strict=True) if all(min(i) >= 0 for i in t.inner)]
    assert len(short) > 30
    for name in ("count", "of_word", "part_counts", "inside"):  # nothing is encoded for an answer
        monkeypatch.setattr(mine, name, None)
    for t, s in short:
        assert t.tokens == s[-1] and [t.at(p) for p in range(len(s))] == s
        for budget in range(0, s[-1] + 1, 5):
            assert t.fitting(budget) == max(p for p, n in enumerate(s) if n <= budget)


def test_every_id_comes_out_of_the_window(monkeypatch):
    import sentencepiece

    path = token_counts.vocabulary_path(sentence_pieces.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(sentence_pieces, "PART", 53)
    codec = sentence_pieces.Codec(path)
    rnd = random.Random(2)
    out = []
    commit = sentence_pieces.StreamingEncoder._path
    monkeypatch.setattr(sentence_pieces.StreamingEncoder, "_path", lambda self, end: out.append(commit(self, end)) or out[-1])
    for _ in range(200):
        text = "".join(rnd.choices(["a", "the", "漢", "字", " ", "  ", "▁", "😀", "é", "x" * 90, "thereforea"], k=rnd.randrange(60)))
        codec.memo.clear()
        codec.of_parts.clear()
        ids, window = codec.encode(text)
        assert np.frombuffer(ids, np.int32).tolist() == library.encode(text) and window <= 200
    words = {tuple(x) for x in out}
    text = "therefore the fore there"
    ids, window = sentence_pieces.Codec(path).encode(text)
    assert window == token_counts.LONG and words and len(out) > 500
    big = "".join(rnd.choices("abcdefgh漢字", k=300_000))
    ids, window = codec.encode(big)
    assert window < 300 and np.frombuffer(ids, np.int32).tolist() == library.encode(big)


def test_control_characters_are_counted_as_the_library_does():
    from tokenizers import Tokenizer

    path = token_counts.vocabulary_path(token_counts.VOCABULARY)
    counter, library = token_counts.WordCounter(path), Tokenizer.from_file(path)
    rnd = random.Random(15)
    texts = ["\x01\x02\x03\x04\x05", "\x7f\x7f\x7f\x7f", "\x01'<|", "\u058c\u0558 \ua7cba \U000323b0b"]
    texts += ["".join(chr(rnd.randrange(0x500)) for _ in range(rnd.randint(1, 30))) for _ in range(3000)]
    texts += ["".join(chr(rnd.choice([*range(1, 32), 127, 39, 115])) for _ in range(60)) for _ in range(300)]
    for text in texts:
        chunks = token_counts.CHUNK.findall(text)
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert sum(counter.count(c) for c in chunks) == want, text
        assert sum(counter.prefixes(c)[-1] for c in chunks) == want, text


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 4, lambda i: i])
def test_languages_are_learnt_whatever_the_ids(spark, ids):
    rnd = random.Random(2)
    words = {"en": "the of and to in that was for with his".split(), "de": "der die und das nicht von ist mit auf ein".split()}
    rows = [(ids(i), " ".join(rnd.choices(words[lang], k=12)), lang) for i in range(2000) for lang in words]
    rows += [(ids(9), "same text of one row", "en")] * 500 + [(ids(3), "gleicher text", "xx")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model is not None and set(model.labels) >= {"de", "en", "xx"}
    labels, _ = language.predict(model, ["the of that was", "der und das nicht", "12"])
    assert labels == ["en", "de", "und"]


def test_parts_of_an_article_stay_whatever_they_are_called():
    story = " ".join(f"Word{i} of the story goes on." for i in range(20))
    parts = [
        "<section id=discussion><p>One thing. Another thing. A third thing. A fourth. A fifth. A sixth.</p></section>",
        "<p class=alert>Mind the step.</p>",
        "<p class='social'>People met.</p>",
        "<figure class=banner><img src=a><figcaption>A banner on the wall.</figcaption></figure>",
        "<p>See <a href=1>this</a> and <a href=2>that other long thing</a></p>",
        "<ul><li><a href=1>The first source of all</a></li><li><a href=2>The second source</a></li></ul>",
    ]
    shown = ["One thing. Another thing. A third thing. A fourth. A fifth. A sixth.", "Mind the step.", "People met.", "A banner on the wall.", "See this and that other long thing", "The first source of all\n\nThe second source"]
    for part, want in zip(parts, shown, strict=True):
        page = f"<html><body><nav><a href=/>Home</a></nav><div class=ad>Buy now</div><article><h1>T</h1><p>{story}</p>{part}<p>The end.</p><div class=ad>Buy more</div><section class=comments><p>I disagree.</p></section></article></body></html>"
        assert html_text.extract(page) == f"T\n\n{story}\n\n{want}\n\nThe end."
