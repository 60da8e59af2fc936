"""Ranked search, vector codes and personal data against brute force, with nulls, ties, repeats, long and empty texts."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from skylattice.llm import personal_data, ranked_search, vector_codes

# --- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def term_list(text):
    return TERM.findall((text or "").translate(SMALL))


def brute_search(docs, items, k=20):
    counted = [(i, Counter(term_list(t))) for i, t in docs if term_list(t)]
    n, words = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 75 + 25 * c.total() * n // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in term_list(text) if t in c)
            if s > 0:
                scores.append((-s, 2**63 if i is None else i, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=repr)


def made_docs(n=260, seed=3):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["été", "中文", "ÀB", "x1"]
    docs = [(i * 3, " ".join(rnd.choices(words, weights=[1 / (1 + k) for k in range(len(words))], k=rnd.randint(1, 60)))) for i in range(n)]
    return [*docs, (None, "w1 w2 w3"), (None, "w1 w2 w3"), (5, None), (7, ""), (8, "--- !?"), (9, "w1 w2"), (9, "w1 w2"), (11, "W1\x00w2\x7f{w3}"), (12, "w5 " * 20_000 + "rare")]


ITEMS = [(1, "w1 W2, w3 w3 été"), (2, None), (3, ""), (4, "nowhere"), (5, "w59 rare 中文 àb ÀB"), (5, "w5"), (None, "x1 w40"), (6, " ".join(f"w{i}" for i in range(60)))]


@pytest.mark.parametrize("postings", [7, 300, 1_000_000])
def test_search_equals_brute_force(spark, postings):
    docs = made_docs()
    given = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item string, score int").repartition(3)
    asked = spark.createDataFrame([(*i, 2) for i in ITEMS], "item_id long, text string, doc_id int")
    found = ranked_search.search(given.select("doc_id", "text"), asked, postings=postings).collect()
    assert sorted(map(tuple, found), key=repr) == brute_search(docs, ITEMS)


def test_search_in_blocks_and_empty(spark, monkeypatch):
    docs = made_docs(80)
    given = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 100)
    assert sorted(map(tuple, ranked_search.search(given, asked).collect()), key=repr) == brute_search(docs, ITEMS)
    assert ranked_search.search(given.limit(0), asked).collect() == []
    assert ranked_search.search(given, asked.limit(0)).collect() == []
    assert ranked_search.search(spark.createDataFrame([(1, None), (2, "  ")], "doc_id long, text string"), asked).collect() == []


def test_tree_keeps_lists_in_falling_order_and_opens_few_nodes():
    docs = made_docs(2000, seed=8)
    found = [(i, Counter(ranked_search.terms(t.encode()))) for i, t in docs if i is not None and term_list(t)]
    total = sum(c.total() for _, c in found)
    shard = ranked_search.Shard.build([i for i, _ in found], [c for _, c in found], len(found), total)
    again = ranked_search.Shard.read(*shard.row())
    again.open()
    assert (again.bits == shard.bits).all() and list(again.ids) == sorted(i for i, _ in found)
    for t, at in again.places.items():
        heights = again.impacts[again.starts[at] : again.starts[at + 1]]
        assert (np.diff(heights) <= 0).all() and len(heights) == sum(t in c for _, c in found)
    none = np.empty(0, np.int64)
    scores, ids = again.best({b"w59": 5000, b"w58": 4000}, 5, (none, none))
    assert len(scores) == 5 and again.opened < len(found) / 2


def test_search_sql(spark, sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = ranked_search.op11_ranked_search(spark, sf)
    columns = ["item_id", "rank", "doc_id", "score"]
    assert df.columns == columns
    r = c.execute(ranked_search.ORACLE["op11_ranked_search"])
    assert [d[0] for d in r.description] == columns
    assert sorted(map(tuple, df.collect())) == sorted(r.fetchall())


# --- vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) if abs(x) < 2**53 else int(x) * 4096 for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    d = width // parts
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1]))[:entries]
    cut = lambda v, p: v[p * d : (p + 1) * d]
    books = [[cut(r[1], p) for r in first] or [[0] * d] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((far(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        groups = {}
        for _, v, _ in kept:
            for p in range(parts):
                groups.setdefault((p, near(v, p)[1]), []).append(cut(v, p))
        for (p, e), mine in groups.items():
            books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    top = 2**63 - 1
    out = [(i, label, "".join(f"{near(v, p)[1]:02x}" for p in range(parts)), min(top, sum(near(v, p)[0] for p in range(parts)))) for i, v, label in kept]
    sums = Counter()
    for _, label, _, e in out:
        sums[label] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted([(i, label, c, e, min(top, sums[label]), digest) for i, label, c, e in out], key=repr)


CODES = "vec_id long, embedding array<float>, label int, code string, v int, key long, error string"


def coded(spark, rows):
    given = spark.createDataFrame([(*r, "x", 1, 2, "e") for r in rows], CODES).repartition(3)
    return sorted(map(tuple, vector_codes.compressed(given).collect()), key=repr)


def near_float(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


def made_vectors(n, width, seed=1):
    rnd = random.Random(seed)
    return near_float([(7 * i % 1009, [rnd.gauss(0, 0.3) for _ in range(width)], rnd.choice([None, 0, 1, 2])) for i in range(n)])


@pytest.mark.parametrize("n, width", [(120, 16), (5, 24), (60, 13), (40, 3)])
def test_codes_equal_brute_force(spark, n, width):
    rows = made_vectors(n, width)
    more = [(None, [0.1] * width, 1), (None, rows[0][1], None), (3, None, 1), (4, [0.1, None], 1), (5, [float("nan")] * width, 1), (6, [float("inf")] * width, 1), rows[1], rows[1], (rows[2][0], rows[3][1], 2), (2000, [], 0), (2001, [0.5], 0)]
    rows = rows + near_float(more)
    assert coded(spark, rows) == brute_codes(rows)


def test_codes_of_equal_and_huge_vectors(spark):
    same = near_float([(i, [0.25] * 16, 1) for i in range(40)])
    assert coded(spark, same) == brute_codes(same)
    huge = made_vectors(30, 8, 2) + near_float([(5000 + k, [3e38, -3e38, 1e30, 2.5, 1e10, -1e15, 7.0, 1e20], k) for k in range(3)])
    assert coded(spark, huge) == brute_codes(huge)


def test_codes_without_ids_or_rows(spark):
    rows = near_float([(None, [0.1 * k] * 8, 1) for k in range(5)])
    assert coded(spark, rows) == brute_codes(rows)
    given = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.compressed(given).collect() == []
    assert coded(spark, [(1, None, 1)]) == []


def test_codes_with_many_labels(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "LABEL_BYTES", 1e9)
    rows = [(i, v, None if i % 3 else i) for i, v, _ in made_vectors(90, 8)]
    assert coded(spark, rows) == brute_codes(rows)


def test_sums_in_limbs():
    rnd = random.Random(4)
    for value in [0, 1, -1, 2**31 - 1, 2**31, -(2**31), -(2**31) - 1, 2**63, -(2**80), *[rnd.randint(-(2**150), 2**150) for _ in range(50)]]:
        assert sum(part << (vector_codes.LIMB * place) for place, part in vector_codes.limbs(value)) == value


def test_codes_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    df = vector_codes.op13_vector_codes(spark, sf)
    r = c.execute(vector_codes.ORACLE["op13_vector_codes"])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(x[c] for c in columns) for x in df.collect()) == sorted(r.fetchall())


# --- personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            odd = sum(int(d) for d in digits[-1::-2]) + sum(int(c) for d in digits[-2::-2] for c in str(2 * int(d)))
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and odd % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if ok[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_plain_patterns():
    rnd = random.Random(5)
    alphabet = ["a", "B", "7", "1", "0", "4", "255", "256", ".", ".", "@", "@", "-", "+", "+1", " ", "(", ")", "%", "_", "é", "\n", "4111111111111111", "x@y.de", "10.0.0.1", "+1 (415) 555-0132"]
    for _ in range(20_000):
        text = "".join(rnd.choices(alphabet, k=rnd.randint(1, 40)))
        assert personal_data.base_spans(text) == plain_spans(text), text


def test_base_spans_take_linear_time():
    for text in ["a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000, "+1" + " " * 300_000, "1 " * 150_000, "@" * 300_000, "a@b." * 75_000, "at dot " * 40_000]:
        personal_data.base_spans(text)
        list(personal_data.chains(text))


def brute_best(scores, steps):
    return max(itertools.product(range(scores.shape[1]), repeat=len(scores)), key=lambda p: total_of(scores, steps, p))


def total_of(scores, steps, path):
    if path[0] > 0 and path[0] % 2 == 0:
        return -math.inf
    out = scores[0, path[0]]
    for t in range(1, len(path)):
        out += steps[path[t - 1], path[t]] + personal_data.ALLOWED[path[t - 1], path[t]] + scores[t, path[t]]
    return out


def test_sums_and_best_paths_equal_all_paths():
    rng = np.random.default_rng(6)
    scores = rng.normal(size=(2, 3, personal_data.LABELS))
    steps = rng.normal(size=(personal_data.LABELS, personal_data.LABELS))
    one, both = personal_data.expected(scores, np.array([3, 2]), steps)
    pairs = np.zeros_like(both)
    for i, n in enumerate((3, 2)):
        paths = list(itertools.product(range(personal_data.LABELS), repeat=n))
        weights = np.exp([total_of(scores[i, :n], steps, p) for p in paths])
        weights /= weights.sum()
        by_hand = np.zeros((3, personal_data.LABELS))
        for p, w in zip(paths, weights, strict=True):
            for t, x in enumerate(p):
                by_hand[t, x] += w
            for a, b in zip(p, p[1:], strict=False):
                pairs[a, b] += w
        assert np.allclose(one[i], by_hand)
    assert np.allclose(both, pairs)


@pytest.fixture(scope="module")
def model():
    return personal_data.learn(list(personal_data._examples()))


def test_viterbi_equals_all_paths_in_any_batch(model, monkeypatch):
    texts = ["a (at) b", "10 . 0", "call 555-0132", "x"]
    found = [personal_data.keys(t, 0, len(t), model.words)[1][:4] for t in texts]
    together = personal_data.viterbi(model, found)
    for chain, path in zip(found, together, strict=True):
        ids = np.full((1, len(chain) + 6), model.number(personal_data.EDGE))
        classes = np.zeros_like(ids)
        ids[0, 3:-3] = [model.number(k) for k in chain]
        classes[0, 3:-3] = [personal_data._CLASS[k[0]] for k in chain]
        scores = personal_data.emissions(ids, classes, np.stack(model.worth), model.pairs)[0]
        assert tuple(path) == brute_best(scores, model.steps)
    long = [personal_data.keys(t, 0, len(t), model.words)[1] for t, _ in personal_data._examples(seed=21, each=1)]
    whole = personal_data.viterbi(model, long)
    monkeypatch.setattr(personal_data, "BLOCK", 5)
    for chain, path in zip(long, whole, strict=True):
        assert (personal_data.viterbi(model, [chain])[0] == path).all()


def test_field_finds_what_it_has_not_seen(model):
    held = list(personal_data._examples(seed=77, each=6))
    found = personal_data.Finder(model)([t for t, _ in held])
    right = sum(set(base + more) == set(spans) for (_, spans), (base, more) in zip(held, found, strict=True))
    assert right >= 0.93 * len(held)
    clean = [(t, f) for (t, spans), f in zip(held, found, strict=True) if not spans]
    assert sum(bool(more) for _, (_, more) in clean) <= 0.02 * len(clean)
    text = "write jane (at) mail (dot) org or call (415) 555-0132 now"
    base, more = personal_data.Finder(model)([text])[0]
    assert base == [] and [text[a:b] for _, a, b in more] == ["jane (at) mail (dot) org", "(415) 555-0132"]


def test_added_spans_overlap_no_base_span():
    known = [("email", 5, 20), ("ip", 8, 12), ("phone", 30, 35)]
    more = [("ip", 0, 5), ("ip", 4, 6), ("card", 14, 16), ("card", 20, 30), ("phone", 34, 40), ("phone", 40, 41)]
    assert personal_data.clear_of(known, more) == [("ip", 0, 5), ("card", 20, 30), ("phone", 40, 41)]


def test_personal_data_of_rows(spark, model):
    texts = [None, "", "é a.b@c.de, 10.0.0.7 and 4111 1111 1111 1111; +1 (415) 555-0132", "é a.b@c.de, 10.0.0.7 and 4111 1111 1111 1111; +1 (415) 555-0132", "clean text of 12 words", "7 " * 50_000, "10.0.0.256 4111111111111112 +12"]
    given = spark.createDataFrame([(i if i != 4 else None, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = personal_data.find(given, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"] if r["doc_id"] is not None else 4] or ""
        base = plain_spans(text)
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in personal_data.KINDS] == [sum(s[0] == k for s in base) for k in personal_data.KINDS]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(spans) >= {f"{k}:{a}:{b}" for k, a, b in base} and len(spans) == len(base) + r["n_added"]
    assert personal_data.find(given.limit(0), model).collect() == []
    alone = personal_data.find(given, personal_data.train(personal_data.labelled(spark).limit(0))).collect()
    assert all(r["n_added"] == 0 for r in alone)


def test_personal_data_query(spark, sf):
    rows = personal_data.op12_personal_data(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
