"""Prefix trie, whitening and page extraction: the operators and their registered queries against brute force, with edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import pages, queries, trie, whitening

NAN, INF = float("nan"), float("inf")


def saved(spark, tmp_path, name, rows, schema, parts=3):
    spark.createDataFrame(rows, schema).repartition(parts).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# --- prefix trie ---


def turn_rows(seed):
    rng, rows = random.Random(seed), []
    for i in range(150):
        c = rng.choice([i, i * 50, i * 100 + rng.randrange(3)]) - 30
        for t in range(rng.choice([1, 1, 2, 3, 6, 9])):
            rows.append((c, rng.choice([t, t, t, None, 2]), rng.choice(["u", "a", None]), rng.choice(["x", "yy", "", None, "é"]) if rng.random() < 0.7 else "hot", "k", 1))
    rows += [(9000 + i * 100, 0, "u", "same", "k", 1) for i in range(60)]  # a large group of copies
    rows += [(5001, t, "u", f"long{t % 3}", "k", 1) for t in range(130)]
    return [*rows, (None, 1, "u", "x", "k", 1), rows[0], rows[0]]


def brute_trie(rows):
    convs = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append(((t is not None, t or 0), hashlib.sha256((hashlib.sha256(r.encode()).hexdigest() + x).encode()).hexdigest()[:32], (r, x)))
    own = {c: [y[2] for y in sorted(v)] for c, v in convs.items()}
    members, ends, kids, leaves, tokens = defaultdict(list), defaultdict(list), defaultdict(set), defaultdict(int), defaultdict(int)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        turns = own.get(c - abs(c) % 100 * (1 if c >= 0 else -1), [])[:h] + v[h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d < len(turns):
                kids[tuple(turns[:d])].add(turns[d])
        ends[tuple(turns)].append(c)
    for k, m in members.items():
        for d in range(len(k) + 1):
            tokens[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += k not in kids
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, ())), leaves[k], tokens[k], digest(ends.get(k, []))) for k, m in members.items()), key=str)


@pytest.mark.parametrize("block", [2, 23, 4096])
def test_trie_equals_brute_force_whatever_the_blocks(spark, tmp_path, monkeypatch, block):
    rows = turn_rows(block)
    folder = saved(spark, tmp_path, "conversations", rows, "conv_id long, turn long, role string, text string, key string, block int")
    plain = trie.prefix_trie
    monkeypatch.setattr(trie, "prefix_trie", lambda seqs: plain(seqs, block))
    got = queries.op11_prefix_trie(spark, folder)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_trie_of_none_and_of_turnless(spark):
    schema = "conv_id long, turns array<struct<digest:string,size:long>>"
    assert trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    row = trie.prefix_trie(spark.createDataFrame([(3, []), (1, [])], schema)).collect()
    assert [tuple(r) for r in row] == [(1, 0, None, 2, 0, 1, 0, hashlib.sha256(b"1,3").hexdigest())]


def test_trie_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    want = con.sql(queries.ORACLE_SQL["op11_prefix_trie"])
    assert sorted(map(tuple, queries.op11_prefix_trie(spark, folder).select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_sparse_table_searches():
    rng = np.random.default_rng(1)
    v = rng.integers(-1, 6, 100)
    t = trie.Table(v)
    for _ in range(300):
        i, d = int(rng.integers(0, 100)), int(rng.integers(-1, 7))
        right = next((j for j in range(i, 100) if v[j] < d), 100)
        left = next((j for j in range(i, -1, -1) if v[j] < d), -1)
        assert (t.right(np.array([i]), np.array([d]))[0], t.left(np.array([i]), np.array([d]))[0]) == (right, left)
        lo, hi = sorted(rng.integers(0, 100, 2).tolist())
        assert t.least(np.array([lo]), np.array([hi]))[0] == v[lo : hi + 1].min()


# --- whitening ---


def whitened(spark, tmp_path, rows):
    folder = saved(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>, x array<long>, component int")
    return queries.op12_whitening(spark, folder).collect()


def test_whitening_equals_a_dense_solver(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = (rng.standard_normal((400, 12)) * np.linspace(0.05, 0.4, 12)).astype(np.float32)
    rows = [(i, v.tolist(), [1], 2) for i, v in enumerate(base)]
    rows += [(1000 + i, base[7].tolist(), [1], 2) for i in range(300)] + [(None, base[9].tolist(), None, None), (3, base[10].tolist(), None, None)]
    bad = [(2000, None), (2001, [*base[0][:11].tolist(), None]), (2002, [NAN] * 12), (2003, [*base[0][:11].tolist(), INF])]
    got = whitened(spark, tmp_path, [*rows, *((i, v, [1], 2) for i, v in bad)])
    kept = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v, *_ in rows]
    fit = np.unique(np.array([x for _, x in kept]), axis=0)
    n, sums, centred = len(fit), fit.sum(axis=0).astype(int), fit - fit.mean(axis=0)
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n} and {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10
    signs = {}
    by = defaultdict(list)
    for i, x in kept:
        by[i].append(x)
    for r in got:
        k = r.component - 1
        if r.vec_id in (None, 3):
            continue
        x = by[r.vec_id][0]
        want = (x - sums / n) @ q[:, k] / np.sqrt(e[k])
        if abs(want) > 0.1:
            signs.setdefault(k, np.sign(r.whitened / want))
        assert abs(r.whitened * signs.get(k, np.sign(r.whitened * want)) - want) < 1e-9
        assert abs(r.explained / (e[k] / e.sum()) - 1) < 1e-10
        assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums))


def test_whitening_of_degenerate_tables(spark, tmp_path):
    assert whitened(spark, tmp_path / "a", []) == []
    assert whitened(spark, tmp_path / "b", [(1, [1.0, 2.0], None, None)] * 5) == []
    assert whitened(spark, tmp_path / "c", [(1, None, None, None), (2, [], None, None)]) == []
    short = whitened(spark, tmp_path / "d", [(1, [1.0, 2.0, 0.5], None, None), (2, [1.0], None, None), (3, [], None, None)])
    assert {(r.vec_id, r.component) for r in short} == {(i, c) for i in (1, 2, 3) for c in (1, 2)}  # three points span two directions
    huge = whitened(spark, tmp_path / "e", [(1, [1e30, 0.0], None, None), (2, [0.0, 1.0], None, None), (3, [5.0, 2.0], None, None)])
    assert {r.vec_id for r in huge} == {1, 2, 3} and any(r.deviation is None for r in huge)


def test_leading_pairs_of_hard_spectra():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    for values in (np.linspace(1, 2, 60), np.r_[np.ones(56), 3, 3, 3, 3], np.geomspace(1e-9, 1, 60), np.ones(60)):
        a = q * values @ q.T
        e, v = whitening.leading(lambda w: a @ w, 60, 4)
        assert np.allclose(e, np.sort(values)[::-1][:4], rtol=1e-13, atol=1e-15)
        assert np.linalg.norm(a @ v - v * e, axis=0).max() < 1e-13 * e[0] and np.abs(v.T @ v - np.eye(4)).max() < 1e-13


def test_many_partial_sums_are_added_by_spark(spark, monkeypatch):
    monkeypatch.setattr(whitening, "DIRECT", 1)
    x = np.random.default_rng(1).integers(-50, 50, (90, 3))
    fit = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(7)
    assert whitening.passed(fit, lambda m: m.sum(axis=0), 3, 3).tolist() == x.sum(axis=0).tolist()
    assert whitening.totals(fit, 3) == (90, x.sum(axis=0).tolist(), int(np.abs(x).max()))


# --- pages ---

NOISE = '<!-- c --><script>var a="</p><article>";</script><style>p{}</style>'


def site(kind, i, paragraphs):
    title, body = f"Title {i} of a page", "".join(f"<p>{p}</p>" for p in paragraphs)
    menu = "<ul><li><a href='/a'>Home</a><li><a href='/b'>About us all</a></ul>"
    comments = "".join(f"<p>I think that reader comment {i} {k} is long enough to count for something here.</p>" for k in range(9))
    return {
        "news": f"<html><head><title>{title}</title></head><body><header><h1>The Site</h1></header><nav>{menu}</nav>{NOISE}<main><article><header><h1>{title}</h1></header>{body}<footer>Filed under things</footer></article></main><aside>{comments}</aside><footer>&copy; us</footer></body></html>",
        "blog": f"<body><div id=top-menu>{menu}</div><div class='wrap-{i}'><div class='post-{i} entry-content'><h1>{title}</h1>{body}<div class=share-links><p>Share this with all of your friends today</p></div></div><div class='comments-area'>{comments}</div></div><div class=sidebar><p>{comments}</p></div><div class='cookie-notice'>We use cookies</div></body>",
        "bare": f"<body>{menu}<div class=x1><h1>{title}</h1>{body}<div class=zq>Read our magazine every week at home</div></div><div class=x2><form><p>Your name here please</p><input></form></div></body>",
    }[kind], "\n\n".join([title, *paragraphs])


def test_main_text_of_three_kinds_of_sites(spark, tmp_path):
    rng, rows, want = random.Random(4), [], {}
    for host, kind in (("a.example", "news"), ("B.example:8080", "blog"), ("c.example", "bare")):
        for i in range(12):
            paragraphs = [" ".join(rng.choice(["fish", "tree", "and", "the", "stone", "river"]) for _ in range(rng.randint(12, 40))) + f" {i}." for _ in range(rng.randint(3, 7))]
            html, text = site(kind, i, paragraphs)
            rows.append((len(rows), f"https://{host}/p/{i}", html, "h", [1]))
            want[len(rows) - 1] = text
    got = queries.op13_extraction(spark, saved(spark, tmp_path, "pages", rows, "page_id long, url string, html string, host string, paths array<int>"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    for r in got.collect():
        assert r.text == want[r.page_id]
        assert r.n_chars == len(r.text)


def test_page_edge_cases(spark):
    cases = [
        ("", ""), ("<body></body>", ""), ("plain &amp; simple\n text", "plain & simple text"), ("<p>a<p>b<br>c</p>d", "a\n\nb c\n\nd"), ("<p>a &lt; b 1 < 2 &eacute;&#8364;&nbsp;x</p>", "a < b 1 < 2 é€ x"),
        ("<p>one <!-- lost", "one"), ("<p>one <!-- a > lost", "one"), ("<p>one <!-- a --> two <!-- b -->", "one two"), ("<p>kept</p><script>lost", "kept"), ("<div class='no-sidebar'><p>text here</p></div>", "text here"), ("<p hidden>x</p><p>y</p>", "y"), ("<p title='a > b'>q</p>", "q"),
        ("<body class='nav'><p>body kept</p></body>", "body kept"), ("<div class='comment'><p>only this</p></div>", "only this"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"), ("<ul><li>x<li>y</ul>tail", "x\n\ny\n\ntail"),
    ]
    rows = [(i, f"http://h{i}.example/", h) for i, (h, _) in enumerate(cases)] + [(100, None, None), (101, "no host", "<p>z</p>"), (None, "http://h.example", "<p>w</p>"), (None, "http://h.example", "<p>w</p>")]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.main_text for r in got if r.page_id is not None} == {i: t for i, (_, t) in enumerate(cases)} | {100: "", 101: "z"}
    assert [r.main_text for r in got if r.page_id is None] == ["w", "w"]
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_of_any_depth_and_length_are_read():
    for html, n in (("<div>" * 50_000 + "x", 1), ("<p>word " * 50_000, 250_000 - 1 + 49_999), ("<a" * 100_000, 200_000), ("<ul>" + "<li>a" * 20_000, 3 * 20_000 - 2)):
        page = pages.Page(html)
        assert len(page.text_of([page.best()], set())) == n


def test_small_hosts_meet_their_paths_in_a_join(spark, monkeypatch):
    rows = [(i, f"http://h{i % 5}.example/{i}", site("blog", i, [f"some text of page {i} that runs on for a while", f"more of {i}"])[0]) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    whole = {r.page_id: r.main_text for r in pages.extract(df).collect()}
    monkeypatch.setattr(pages, "HOSTS", 2)
    assert {r.page_id: r.main_text for r in pages.extract(df).collect()} == whole and len(whole) == 40


def test_copies_on_a_host_keep_their_text(spark):
    html = site("blog", 1, ["the same text on all pages of the host", "and more of it"])[0]
    got = pages.extract(spark.createDataFrame([(i, "http://h.example/x", html) for i in range(9)], "page_id long, url string, html string"))
    assert {r.main_text for r in got.collect()} == {site("blog", 1, ["the same text on all pages of the host", "and more of it"])[1]}


def test_the_column_order_and_extra_columns_stay(spark):
    got = pages.extract(spark.createDataFrame([(1, "<p>t</p>", "http://h.example", "p")], "main long, html string, url string, paths string"))
    assert got.columns == ["main", "url", "paths", "main_text"] and got.select(F.col("main_text")).first()[0] == "t"
