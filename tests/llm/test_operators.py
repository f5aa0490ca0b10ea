"""The other pipeline operators against brute force, with odd rows."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rillstone.llm import embedding_dedup, language_id, line_dedup, minhash, quality, topk_search, url_rules
from rillstone.llm.components import components, forest
from rillstone.llm.queries import HOST_RULES
from rillstone.llm.wordhash import shingles, words

EXTRA = "x int, n long, name string, k string, part int, rep long, cell int, tree int"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def docs(spark, texts, langs=None):
    rows = [(i, t, langs[j] if langs else "en", "s", len(t or ""), 1, 2, "n", "k", 3, 4, 5, 6) for j, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def roots(edges, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


# connected components


@pytest.mark.parametrize("one_task", [200_000, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr("rillstone.llm.components.ONE_TASK", one_task)
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 180)]
    star = [(1000, i) for i in range(1001, 1060)]
    loose = [(rng.randrange(5000, 5300), rng.randrange(5000, 5300)) for _ in range(200)]
    edges = [*chain, *star, *loose, (7, 7)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.node: r.component for r in components(df).collect()}
    want = roots(edges, {x for e in edges for x in e})
    assert got == {k: v for k, v in want.items() if k != v}
    assert components(df.limit(0)).count() == 0
    u, v = forest(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert dict(zip(u.tolist(), v.tolist())) == {5: 1, 3: 1, 9: 8}


# near-duplicates of documents


def brute_documents(texts, size, percent):
    def grams(t):
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}

    s = {i: grams(t) for i, t in texts}
    edges = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    return s, roots(edges, s)


def near_texts(seed=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    texts, at = [(0, None), (1, ""), (2, " \n "), (3, "One"), (4, "one"), (5, "one two"), (6, "ONE\ttwo"), (7, "word " * 3000), (8, "word " * 2999), (9, "y" * 5000)], 10
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, 8)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append((at, " ".join(copy)))
            at += 1
    return texts


@pytest.mark.parametrize("size", [2, 5])
def test_minhash_against_brute_force(spark, size):
    texts = near_texts(size)
    s, comp = brute_documents(texts, size, 80)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, texts), size=size).collect()}
    assert {i: r.component_id for i, r in got.items()} == comp
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(x) for i, x in s.items()}
    kept = minhash.near_duplicates(docs(spark, texts), size=size, keep_columns=True)
    assert kept.columns == docs(spark, texts).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, c in comp.items() if i == c}


def test_minhash_odd_rows(spark):
    same = docs(spark, [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (9, "a b c d")])
    got = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in minhash.near_duplicates(same).collect()))
    assert got == [(0, None, None), (5, 5, True), (5, 5, True), (9, 5, False)]
    assert sorted(r.doc_id or 0 for r in minhash.near_duplicates(same, keep_columns=True).collect()) == [0, 5]
    assert minhash.near_duplicates(same.limit(0)).count() == 0


def test_minhash_colliding_doc_ids(spark):
    """Of rows that share a doc_id each is judged by its own text."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    texts = [(1, a), (5, a + " x"), (5, b), (6, b + " y"), (7, c), (7, c + " z"), (8, c)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, texts)).collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 5, True), (6, 5, False), (7, 7, True), (7, 7, True), (8, 7, False)]
    kept = minhash.near_duplicates(docs(spark, texts), keep_columns=True).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, a), (5, b), (7, c), (7, c + " z")]


@pytest.mark.parametrize("block", [1024, 50])
def test_minhash_crowded_region(spark, monkeypatch, block):
    """A hub that links with 200 texts which don't link with each other."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    large = docs(spark, [(i, "p q r s t " * 3 + (f" z{i}" if i % 2 else "")) for i in range(400)])
    assert {r.component_id for r in minhash.near_duplicates(large).collect()} == brute_groups([(i, "p q r s t " * 3 + (f" z{i}" if i % 2 else "")) for i in range(400)])


def brute_groups(texts):
    return set(brute_documents(texts, 2, 80)[1].values())


def test_neighbours_over_batch_borders():
    rng = random.Random(0)
    for _ in range(200):
        window, rows = 3, []
        for t in range(2):
            for r in range(rng.randrange(1, 6)):
                rows += [(t, r, len(rows) + i, 10) for i in range(rng.choice([1, 1, 2, 3, 4, 5, 6, 9]))]
        cuts = sorted({0, len(rows), *[rng.randrange(len(rows) + 1) for _ in range(5)]})
        batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.int32()), *[pa.array([x[c] for x in own], pa.int64()) for c in (1, 2, 3)], pa.array([0] * len(own), pa.int32())], ["tree", "region", "rep", "n", "part"]) for own in (rows[a:b] for a, b in zip(cuts, cuts[1:]))]
        out = [r for b in minhash._neighbours(window, 0.8)(batches) for r in b.to_pylist()]
        pairs = {(r["a"], r["b"]) for r in out if r["kind"] == minhash.PAIR}
        ties = {(r["a"], r["b"]) for r in out if r["kind"] == minhash.TIE}
        groups = defaultdict(list)
        for t, r, rep, _ in rows:
            groups[t, r].append(rep)
        assert {(v[i], v[j]) for v in groups.values() for i in range(len(v)) for j in range(i) if i - j <= window or j == 0} <= pairs
        own = list(groups.values())
        tied = [v for v in own if len(v) > window + 1 or v is own[0] or v is own[-1]]
        assert {(x, v[0]) for v in tied for x in v[1:]} <= ties <= {(x, v[0]) for v in tied for x in v}
        borders = [(r["a"], r["last"]) for r in out if r["kind"] == minhash.BORDER]
        assert borders == ([(rows[0][2], False), (rows[-1][2], True)] if rows else [])


def test_words_and_shingles():
    texts = ["A b  a b\ta b", None, "", "É x", "one", "z" * 300, "\x1cq w"]
    _, _, _, h, n = words(texts)
    assert n.tolist() == [6, 0, 0, 2, 1, 1, 2]
    assert h[0] == h[2] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 2 + 2 + 1 + 1 + 2
    s, k = shingles(h, n, 2)
    assert k.tolist() == [2, 0, 0, 1, 1, 1, 1] and len(set(s.tolist())) == 6


# near-duplicates of vectors and searches


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, 6))
    rows = [(i, [float(x) for x in base[i]], i % 3) for i in range(60)]
    for i in range(60, 200):
        b = base[rng.integers(60)] + rng.normal(size=6) * 0.06
        rows.append((i, [float(np.float32(x)) for x in b], int(rng.integers(3))))
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 6, 1), (203, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (204, [float("nan")] * 6, 1), (205, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0], 1), (206, rows[0][1], None), (207, rows[0][1], 0), (208, [2 * x for x in rows[0][1]], 0), (300, [1.0, 2.0], 0), (301, [1.0, 2.0], 0), (400, [-x for x in rows[0][1]], 0)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "k") for r in rows], "vec_id long, embedding array<float>, label int, cell int, k string").repartition(3)


def sound(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("block,sample", [(8192, 4096), (8, 4096), (16, 80)])
def test_embedding_dedup_against_brute_force(spark, block, sample):
    rows = vectors()
    single = {i: np.array(v, np.float32).astype(float) if sound(v) and any(v) else None for i, v, _ in rows}
    label = {i: c for i, _, c in rows}
    edges = []
    for a in single:
        for b in single:
            x, y = single[a], single[b]
            if a < b and label[a] is not None and label[a] == label[b] and x is not None and y is not None and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                edges.append((a, b))
    comp = roots(edges, single)
    n = defaultdict(int)
    for a, b in edges:
        n[a] += 1
        n[b] += 1
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame(spark, rows), block=block, sample=sample).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: n[i] for i in single}
    assert {i: r.component_id for i, r in got.items()} == comp
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_embedding_dedup_odd_rows(spark):
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame(spark, [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (None, None, None)])).collect())
    assert got == [(-1, 0, None), (-1, 2, 1), (1, 2, 1), (1, 2, 1)]
    assert embedding_dedup.near_duplicates(frame(spark, vectors()).limit(0)).count() == 0


@pytest.mark.parametrize("block,query_block", [(4096, 4096), (40, 2)])
def test_topk_against_brute_force(spark, block, query_block):
    rows = [*vectors(), (None, [0.5] * 6, 0), (500, [3.0, 1.0], 2), (600, [], 1), (700, [0.0] * 6, 1)]
    x = {}
    for i, v, _ in rows:
        if sound(v):
            q = [int(np.floor(1024 * float(np.float32(a)))) for a in v]
            x.setdefault(i, q + [0] * (6 - len(q)))
    want = {}
    for i in x:
        if i is not None and i % 100 == 0:
            best = sorted(((sum(a * b for a, b in zip(x[i], x[j])), j) for j in x if j != i), key=lambda p: (-p[0], p[1] is None, p[1] or 0))[:10]
            want |= {(i, r + 1): (j, s) for r, (s, j) in enumerate(best)}
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk_search.top_inner_products(frame(spark, rows), block=block, query_block=query_block).collect()}
    assert got == want
    few = topk_search.top_inner_products(frame(spark, [(100, [1.0], 0), (3, [2.0], 0), (3, [2.0], 0)])).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in few] == [(100, 1, 3, 2 * 1024 * 1024), (100, 2, 3, 2 * 1024 * 1024)]
    assert topk_search.top_inner_products(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("size", [60, 200])
def test_topk_repeated_query_row(size):
    """Rows of the query's own id do not push out a page's true neighbours."""
    rng = np.random.default_rng(size)
    x = np.floor(1024 * rng.normal(size=(size, 4)))
    ids = np.arange(1, size + 1)
    x[:30], ids[:30] = 3 * np.abs(x).max(), 100_000
    tree = topk_search.MTree(x, float(np.sqrt((x * x).sum(1).max())))
    want = sorted(((int(s), -int(i)) for s, i in zip(x @ x[0], ids, strict=True) if i != 100_000), reverse=True)[:10]
    assert tree.search(x[0], 100_000, ids, 10, None) == want


def test_topk_large_numbers():
    big = np.array([[2.0**40, 1.0], [2.0**20, 3.0]])
    with pytest.raises(OverflowError):
        topk_search._scores(big, np.array([2.0**30, 1.0]))
    assert topk_search._scores(big, np.array([2.0**20, 5.0])).tolist() == [2**60 + 5, 2**40 + 15]


# urls


def test_urls_against_trying_every_rule(spark):
    hosts = ["a.com", "WWW.example.com", "example.com", "m.example.com", "x.net", "net", "example.org", "m.shop.org", "", "com"]
    paths = ["", "/", "/en/", "/en/1.html", "/es/2", "/fr/?page=2&ref=x", "/x?utm_source=feed&a", "/wp-admin", "/cart/checkout?x", "/rss.xml#a", "/v?sessionid=deadbeef0", "/en", "?utm_source=", "#http://b.com/en/"]
    urls = [None, "", "no scheme", "://", "ftp://A.net/es/x", "http://É.com/é?ü"] + [f"https://{h}{p}" for h in hosts for p in paths]
    rows = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)] + [(None, urls[9], "h", 1), (7, urls[7], "h", 1)], "page_id long, url string, rule string, low int")
    got = {r.page_id: r for r in url_rules.judge(rows, HOST_RULES).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u[u.index("://") + 3 :]
            host = re.match(r"[^/?#]*", rest)[0].translate(lower)
            path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [r for r in HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text), default=None)
        hit = next((p.name for p in url_rules.PATTERNS if u and re.search(p.regex, u.translate(lower))), None)
        want = (host, path, rule.text if rule else None, rule.verdict if rule else "block" if hit else "allow", None if rule else hit)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict, got[i].pattern) == want, u
    assert url_rules.judge(rows, HOST_RULES).count() == len(urls) + 2
    assert url_rules.judge(rows.limit(0), HOST_RULES).count() == 0
    assert {r.verdict for r in url_rules.judge(rows, [], []).collect()} == {"allow"}


def test_rarest_tokens_are_chosen(spark):
    rows = spark.createDataFrame([("http://a/utm?x",), ("http://a/utm_source",), (None,)], "url string")
    assert url_rules.rarest_tokens(rows, url_rules.PATTERNS)["tracked"] == "source"


# lines


def test_line_dedup(spark):
    rng = random.Random(5)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(2, 9)))
    passage = [line() for _ in range(40)]
    long = " ".join(f"v{i}" for i in range(60))
    texts = [(i, "\n".join([line() for _ in range(rng.randrange(0, 9))] + (passage if i % 3 == 0 else [long, "x"] if i % 3 == 1 else ["short line"]) + [line() for _ in range(rng.randrange(1, 9))])) for i in range(30)]
    texts += [(100, None), (101, ""), (102, "a"), (103, "a"), (104, "\n\n\n"), (105, "y" * 20_000), (106, texts[0][1])]
    first, want, lines = {}, {}, {}
    for i, t in texts:
        own = line_dedup.chunks(t) if t is not None else []
        assert t is None or "\n".join(c for _, c, _ in own) == t
        keep = []
        for at, (n, c, whole) in enumerate(own):
            if not whole or first.setdefault(c, (i, at)) == (i, at):
                keep.append((n, c))
        want[i] = "\n".join(c for _, c in keep) if t is not None else None
        lines[i] = (sum(n for n, _ in keep), sum(n for n, _, _ in own) - sum(n for n, _ in keep))
    got = line_dedup.dedup_lines(docs(spark, texts), stats=True)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = {r.doc_id: r for r in got.collect()}
    assert {i: r.text for i, r in rows.items()} == want
    assert {i: (r.lines_kept, r.lines_removed) for i, r in rows.items()} == lines
    assert all(r.n_chars == len(r.text or "") for r in rows.values())
    assert sum(long in (t or "") for t in want.values()) == 1 and want[106] == ""
    inner = [p for p in passage[5:-5]]
    assert all(sum(p in (t or "") for t in want.values()) == 1 for p in inner[3:-3])
    assert line_dedup.dedup_lines(docs(spark, texts).limit(0)).count() == 0


def test_line_dedup_columns_with_clashing_names(spark):
    t = "\n".join(f"line {j} of some words" for j in range(40))
    rows = [(i, t, 10 + i, "r", 5, 6, len(t)) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int, runs string, lines_kept long, __part int, n_chars int")
    plain = line_dedup.dedup_lines(df, passages=True)
    assert plain.columns == df.columns
    got = plain.orderBy("doc_id").collect()
    assert [(r.gone, r.runs, r.lines_kept) for r in got] == [(10, "r", 5), (11, "r", 5)] and got[0].text == t and len(got[1].text) == got[1].n_chars < len(t)
    assert line_dedup.dedup_lines(df, stats=True).columns.count("lines_kept") == 1


def test_long_lines_are_a_parameter():
    text = "a\n" + "w " * 60 + "\nb"
    assert [n for n, _, _ in line_dedup.chunks(text)] == [1, 1, 1]
    assert [n for n, _, _ in line_dedup.chunks(text, None)][0] > 1


def test_line_dedup_repeated_rows(spark):
    t = "\n".join(f"line {i} of it" for i in range(12))
    got = [r.text for r in line_dedup.dedup_lines(docs(spark, [(1, t), (1, t), (None, t), (None, t)])).orderBy("doc_id").collect()]
    assert got[:2] == [t, t] and all(len(x) < len(t) for x in got[2:])


def brute_passages(texts):
    """Lines left when every line goes that lies in a later copy of lines of 50 words."""
    first, out = {}, {}
    for d, t in texts:
        lines = t.split("\n")
        size = [len(x.split()) for x in lines]
        stay = [True] * len(lines)
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if sum(size[i : j + 1]) >= 50:
                    at = first.setdefault(tuple(lines[i : j + 1]), (d, i, j))
                    if at != (d, i, j):
                        for k in range(max(i, at[2] + 1) if at[0] == d else i, j + 1):
                            stay[k] = False
        out[d] = [x for x, own in zip(lines, stay, strict=True) if own]
    return out


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_line_dedup_short_passages(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_MARKS", broadcast)
    monkeypatch.setattr(line_dedup, "BROADCAST_GROUPS", broadcast)
    rng = random.Random(9)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [[line(-(-51 // n) + rng.randrange(12)) for _ in range(n)] for n in (2, 3, 4, 5, 6) for _ in range(6)]
    passages += [["", line(40), "", line(12), ""], ["x y"] * 80]
    texts = []
    for i in range(90):
        body = [line(rng.randrange(3, 20)) for _ in range(rng.randrange(1, 4))]
        texts.append((i, "\n".join(body + passages[i % len(passages)] + [line(rng.randrange(3, 20))])))
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts), stats=True, passages=True).collect()}
    for p in passages[:-2]:
        assert all(sum(x in r.text.split("\n") for r in rows.values()) == 1 for x in p)
    brute = brute_passages(texts)
    for d, t in texts:
        left = rows[d].text.split("\n")
        assert set(left) <= set(brute[d]) and rows[d].lines_kept + rows[d].lines_removed == t.count("\n") + 1
        assert d % len(passages) == len(passages) - 1 or left == brute[d]
    before, after = ({x for t in ts for x in t.split("\n")} for ts in ([t for _, t in texts], [r.text for r in rows.values()]))
    assert before == after


# language and quality

WORDS = {"en": "the and of with house river walking green stone".split(), "de": "der und mit haus fluss grün stein gehen nicht".split()}


def spoken(n=60):
    rng = random.Random(2)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(4, 40))).capitalize() + ".", lang) for i in range(n) for lang in [("en", "de")[i % 2]]]


def test_language_id(spark):
    rows = spoken()
    table = docs(spark, [(i, t) for i, t, _ in rows], [lang for *_, lang in rows])
    model = language_id.learn(table)
    assert len(model.places("haus")) == 1 < len(model.places("hausen")) and not model.places("ßßß")
    assert model.sums(["haus", "hausen", "12", "haus-house"])[:, :2].argmax(1).tolist()[:2] == [0, 0]
    want = [[model.table[model.places(w)].mean(0).tolist() for w in language_id.letters(c)] for c in ("haus-house", "hausen")]
    assert np.allclose(model.sums(["haus-house", "hausen"]), [[*np.sum(x, 0), len(x)] for x in want])
    odd = [(1, None), (2, ""), (3, "12 34 !?"), (4, "Häuser und Steine"), (5, "walked through greener houses " * 4000), (None, "the house"), (4, "Häuser und Steine"), (6, "²³ ½"), (7, "x" * 3000)]
    got = {r.doc_id: r for r in language_id.predict(docs(spark, odd), model).collect()}
    assert {i: got[i].lang_pred for i in (1, 2, 3, 4, 5, 6, None)} == {1: "und", 2: "und", 3: "und", 4: "de", 5: "en", 6: "und", None: "en"}
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1].score == 0
    q = {r.doc_id: r for r in language_id.op5_query(table).collect()}
    from zlib import crc32

    assert {i: r.held_out for i, r in q.items()} == {i: crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in q.values() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    kept = language_id.keep_sure(docs(spark, odd), model)
    assert kept.columns == docs(spark, odd).columns and {r.doc_id for r in kept.collect()} >= {4, 5}
    assert language_id.op5_query(table.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.predict(table, language_id.learn(table.limit(0))).collect()} == {"und"}


def test_language_cache_is_bounded():
    m = language_id.Model(["a", "b"], {"x": [5, 1], "y": [1, 5]}, {"x": [5, 1], "y": [1, 5]})
    m.restart(30)
    for i in range(5):
        lang, _ = m.predict([" ".join(f"x{chr(97 + i)}{chr(97 + j)}" for j in range(20)), "y " * 5, "z" * 400])
        assert lang[:2] == ["a", "b"] and len(m.codes) <= 30


def test_quality(spark):
    rng = random.Random(4)
    vocab = ["the", "of", "and", "a", "reading", "river", "stone,", "walked", "over", "bridge."] + ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(200)]
    good = [" ".join(rng.choice(vocab) for _ in range(60)).capitalize() for _ in range(160)]
    bad = [" ".join(["Word"] * 50 + ["other"] * 40), "SHOUT!! LOUD!! TEXT!! " * 20, "sym### bol$$$ mar%%% ked&&& " * 15]
    texts = [(i, t) for i, t in enumerate(good + bad * 14)] + [(900, None), (901, ""), (902, "Fine."), (903, "ok " * 5000), (None, good[0]), (0, good[0])]
    scorer = quality.fit(docs(spark, texts))
    got = [(r.doc_id, r.accepted, r.score) for r in quality.score(docs(spark, texts), scorer).collect()]
    assert len(got) == len(texts)
    by = dict((i, a) for i, a, _ in got)
    assert all(by[i] for i in range(160)) and not any(by[i] for i in range(160, 202)) and by[None]
    assert not by[900] and not by[901] and all(0 <= s <= 1 for *_, s in got)
    kept = quality.keep_accepted(docs(spark, texts), scorer)
    assert kept.columns == docs(spark, texts).columns
    assert quality.score(docs(spark, texts).limit(0), quality.fit(docs(spark, texts).limit(0))).count() == 0
    assert quality.Facts(["a a  b", None]).n.tolist() == [3, 0]


def test_em_recovers_labellers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.7
    right = np.array([0.95, 0.9, 0.8, 0.85])
    votes = np.where(rng.random((4000, 4)) < right, truth[:, None] * 2 - 1, 1 - truth[:, None] * 2)
    votes[rng.random((4000, 4)) < 0.2] = 0
    kinds, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good, share, rates = quality.fit_labellers(kinds, counts.astype(float))
    assert abs(share - 0.7) < 0.05
    assert (((good[back] > 0.5) == truth).mean()) > 0.93
    found = rates[0, :, 2] / (rates[0, :, 0] + rates[0, :, 2])
    assert np.abs(found - right).max() < 0.06


def plain_prediction(model, text):
    """The language of a text by the documented rule, word by word in plain Python."""
    import math

    own = [w for c in language_id.pieces(text or "") for w in language_id.letters(c)]
    if not own:
        return "und", 0.0
    total = [0.0] * len(model.langs)
    for w in own:
        rows = [model.table[i] for i in model.places(w)]
        for j in range(len(total)):
            total[j] += sum(float(r[j]) for r in rows) / max(len(rows), 1)
    best = max(range(len(total)), key=lambda j: (total[j], -j))
    share = 1 / sum(math.exp((t - total[best]) * min(len(own), 20) / len(own)) for t in total)
    return model.langs[best], share


def test_language_against_brute_force(spark):
    import math
    from collections import Counter

    rows = spoken(40)
    table = docs(spark, [(i, t) for i, t, _ in rows], [lang for *_, lang in rows])
    model = language_id.learn(table)
    counts = {lang: Counter(w for i, t, own in rows if own == lang for c in language_id.pieces(t) for w in language_id.letters(c)) for lang in model.langs}
    known = sorted({w for c in counts.values() for w in c})
    assert list(model.words) == known
    size = {lang: sum(c.values()) + 0.5 * len(known) for lang, c in counts.items()}
    for w in known[::5]:
        p = [math.log((counts[lang][w] + 0.5) / size[lang]) for lang in model.langs]
        norm = math.log(sum(map(math.exp, p)))
        assert np.allclose(model.table[model.words[w]], [x - norm for x in p])
    grams = Counter()
    for lang in model.langs:
        for w, n in counts[lang].items():
            for k in language_id.ORDERS:
                for g in language_id.grams(w, k):
                    grams[g] += n
    assert set(model.grams) == {g for g in grams if len(g) in language_id.ORDERS}
    texts = [(i, t) for i, t, _ in rows] + [(900, "qzx hausen walkings 12"), (901, ""), (902, None), (903, "ßßß"), (904, "the " * 3000)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs(spark, texts), model).collect()}
    for i, t in texts:
        lang, share = plain_prediction(model, t)
        assert got[i][0] == lang and got[i][1] == pytest.approx(share)


def plain_features(text):
    """Hashed features of a text by the documented rule, word by word."""
    from rillstone.llm.wordhash import mix, span_hashes

    def bucket(h):
        return int(h) >> (64 - quality.BITS)

    own, before, out = [], None, {}
    for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()):
        if not w:
            continue
        own.append(w)
        classes = bytes(quality._SHAPE[b] for b in w)
        runs = np.frombuffer(bytes(c for i, c in enumerate(classes) if not i or c != classes[i - 1]), np.uint8)
        shape = span_hashes(runs, np.array([0]), np.array([len(runs)]))[0]
        found = [shape, mix(np.array([min(len(w), 30) + (1 << 40)], np.uint64))[0]]
        if before is not None and before.lower() == w.lower():
            found.append(mix(np.array([shape + np.uint64(7)], np.uint64))[0])
        for h in found:
            out[bucket(h)] = out.get(bucket(h), 0) + 1
        before = w
    return {b: n / (len(own) + 10) for b, n in out.items()}, len(own)


def test_quality_against_brute_force(spark):
    import math

    rng = random.Random(9)
    texts = [(i, " ".join(rng.choice(["river", "Stone", "walked", "over,", "12", "WOW!!", "x|y"]) for _ in range(rng.randrange(0, 30)))) for i in range(80)] + [(90, None), (91, "one"), (92, "a a A a"), (93, "word " * 5000)]
    scorer = quality.fit(docs(spark, texts))
    got = {r.doc_id: (r.score, r.accepted) for r in quality.score(docs(spark, texts), scorer).collect()}
    for i, t in texts:
        f, n = plain_features(t)
        want = 1 / (1 + math.exp(-sum(scorer.weight[b] * math.sqrt(v) for b, v in f.items()))) if n else 0.0
        assert got[i][0] == pytest.approx(want) and got[i][1] == (got[i][0] >= 0.5)
    # expectation-maximisation in plain loops
    kinds, counts = np.unique(quality.votes(quality.Facts([t for _, t in texts])), axis=0, return_counts=True)
    good, share, rates = quality.fit_labellers(kinds.astype(int), counts.astype(float))
    total = [0.0, 0.0]
    for k, c, g in zip(kinds.tolist(), counts.tolist(), good.tolist()):
        p = [share, 1 - share]
        for j, v in enumerate(k):
            for side in (0, 1):
                p[side] *= rates[side, j, v + 1] if v else 1.0
        assert p[0] / sum(p) == pytest.approx(g, abs=1e-6)
        total[0] += c * g
        total[1] += c
    assert share == pytest.approx((total[0] + 1) / (total[1] + 2), abs=1e-6)
