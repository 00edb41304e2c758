"""The training-data operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, clashes."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.llm import language, lines, mixing, near, packing, pii, quality, scoring, sharding, simhash, sketch
from faultline.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, version int"
LONG = " ".join(f"word{i % 977} and the" for i in range(15_000))


def corpus():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        text = "\n".join(" ".join(rng.choice(words, 14)) + "." for _ in range(rng.integers(1, 6)))
        rows.append((i, text, "en" if i % 3 else "fr", f"s{i % 4}"))
    copy = rows[5][1]
    rows += [(100 + i, copy, "en", "s0") for i in range(20)]  # a group of copies
    rows += [(130, copy + " tail", "en", "s1"), (131, None, None, None), (132, "", "en", "s2"), (133, "  \n\t ", "de", "s2"), (134, "one", "en", None)]
    rows += [(135, LONG, "en", "s3"), (7, rows[7][1], "en", "s3"), (None, "no id here", "en", "s1"), (136, "É Ünï çödé " * 9, "fr", "s1")]
    return [(d, t, lang, s, len(t or ""), "k", 1, 2) for d, t, lang, s in rows]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(5).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(docs, spark):
    return spark.createDataFrame([], docs.schema)


def test_empty_tables(empty):
    learned = {"en": b"the and of", "fr": b"le la de"}
    assert packing.pack(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert sharding.shard(empty).count() == 0
    assert lines.drop_repeated_lines(empty).count() == 0
    assert quality.measure(empty).count() == 0
    assert language.classify(empty, learned).count() == 0
    assert language.dictionaries(empty) == {}
    assert sketch.edit_likeness(empty).count() == 0
    assert pii.detect(empty).count() == 0
    assert scoring.score(empty, F.lit(False)).count() == 0


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    got = packing.pack(docs, capacity=256).collect()
    want = Counter()
    for d, text, *_ in corpus():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for s in range(0, len(ids), 256):
            want[(d, s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    whole = packing.sequences(docs, capacity=256)
    assert whole.agg(F.sum(F.octet_length("ids"))).first()[0] == 4 * sum(n * k for (_, _, n, _, _), k in want.items())


def test_patterns_cover_demand_and_are_tight():
    demand = {200: 40, 130: 70, 90: 25, 60: 33, 7: 90, 1: 5}
    found = packing.patterns(demand, 256)
    for s, n in demand.items():
        assert sum(k * p.get(s, 0) for k, p in found) >= n
    assert all(sum(s * c for s, c in p.items()) <= 256 for _, p in found)
    bins, big = sum(k for k, _ in found), sum(n for s, n in demand.items() if s > 128)  # no two of these share a bin
    assert big <= bins <= big + 2
    assert packing.patterns({}, 256) == []


def brute_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_against_brute_force(docs):
    rows = corpus()
    fps = [brute_fingerprint(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), 1 << 60), r[0])
    want = Counter((r[0], fps[i], least.get(find(i))) for i, r in enumerate(rows))
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    missing = lambda d: (d is None, d or 0)
    assert sorted((r.doc_id for r in kept.collect()), key=missing) == sorted((least.get(k) for k in {find(i) for i in range(len(rows))}), key=missing)


def test_simhash_keeps_rows_without_an_id_and_texts_that_share_one(spark):
    a, b, c = ("alpha beta gamma delta", "one two three four five six", "red green blue white black grey")
    rows = [(None, a), (7, b), (7, c), (7, b), (None, b), (3, c)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, a), (7, b), (3, c)])


def stage_near_dedup(spark, rows):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)["near dedup"]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in stage(spark, df, "").collect())


def test_near_dedup_stage_against_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(30):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 300)))]
        rows.append((10 * i, " ".join(words)))
        for j in range(1, 4):  # copies with a few words edited, on both sides of the threshold
            edited = list(words)
            for at in rng.choice(len(words), j * len(words) // 70 + 1, replace=False):
                edited[at] = f"new{i}x{j}x{at}"
            rows.append((10 * i + j, " ".join(edited)))
    grams = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = [(False, *rows[i]) for i in range(len(rows)) if find(i) == i]
    assert 30 < len(want) < len(rows)
    assert stage_near_dedup(spark, rows) == want


def test_near_dedup_stage_keeps_rows_without_or_with_repeated_ids(spark):
    text = lambda x: " ".join(f"{x}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (1, text("c")), (1, text("d")), (2, text("c")), (None, text("d")), (3, text("e")), (3, text("e")), (4, ""), (5, " ")]
    got = stage_near_dedup(spark, rows)
    assert [x[1] for x in got if not x[2]] == [4]
    assert [x for x in got if x[2]] == sorted([(False, 1, text("c")), (False, 1, text("d")), (False, 3, text("e")), (True, 0, text("a")), (True, 0, text("b"))])


def test_trie_finds_every_close_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64).astype(np.uint64)
    near = base[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (60, 20)).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, (60, 20)).astype(np.uint64))
    keys = np.unique(np.concatenate([base, near.ravel()]))
    one = np.array([0]), np.array([len(keys)])
    a, b = simhash.trie_pairs(keys, one, one, np.array([0]), 2)
    got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    d = np.bitwise_count(keys[:, None] ^ keys[None, :])
    assert got == {(i, j) for i, j in zip(*np.nonzero(d <= 2)) if i < j}
    assert len(a) == len(got)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, x) for x in range(101, 140)] + [(200, 200), (-5, -9)]
    rows = components(spark.createDataFrame(edges, "src long, dst long")).collect()
    label = {r.node: r.root for r in rows}
    assert len({label[i] for i in range(1, 61)}) == 1
    assert len({label[i] for i in range(100, 140)}) == 1
    assert label[-5] == label[-9]
    assert len({label[1], label[100], label[-5]}) == 3
    assert 200 not in label


def test_sketch_against_exact_sets(docs):
    rows = sorted(corpus(), key=lambda r: (r[0] is None, -(r[0] or 0)))

    def shingles(t):
        w = t.split()
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)} - {""}

    got = sketch.edit_likeness(docs).collect()
    assert len(got) == len(rows)
    ids = [r[0] for r in rows]
    by = {r.doc_id: r for r in got}
    for i, (d, t, *_) in enumerate(rows):
        if ids.count(d) > 1 or ids.count(rows[(i + 1) % len(rows)][0]) > 1:
            continue
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        assert by[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert by[d].n_chars == len(t)
        for name, other in (("near_edited", e), ("near_next", n)):
            a, b = shingles(t), shingles(other)
            assert abs(by[d][name] - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
    assert len({tuple(r.sketch) for r in got if r.doc_id in range(100, 120)}) == 1


def test_sketches_merge(spark):
    text = " ".join(f"x{i % 400}" for i in range(3000))
    parts = [text[:6000], text[5000:]]
    df = spark.createDataFrame([(1, p) for p in parts] + [(2, "a b c d e f")], "g int, text string").withColumn("w", sketch.word_hashes(F.col("text"))).withColumn("sketch", sketch.sketch(F.col("w"), 64))
    one = {r.g: r.sketch for r in sketch.merged_by(df, "g", k=64).collect()}
    a, b = df.where("g = 1").select("sketch").collect()
    both = spark.createDataFrame([(a[0], b[0])], "a array<long>, b array<long>").select(sketch.merge(F.col("a"), F.col("b"), 64).alias("m"), sketch.containment(F.col("a"), F.col("b"), 64).alias("c")).first()
    assert one[1] == both.m and len(one[2]) == 2 and 0 <= both.c <= 1


def test_mixing_meets_targets(docs):
    docs = docs.where("doc_id is null or doc_id <> 135")  # one document larger than its source's target cannot meet it in whole copies
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(corpus()) - 1
    total = sum(len(WORD.findall(r[1] or "")) for r in corpus() if r[0] != 135)
    sources = {}
    for r in rows:
        assert r.size == len(WORD.findall(r.text or "")) and 0 <= r.taken <= 2 * r.size and r.key == "k"
        sources.setdefault(r.source, []).append(r)
    weights = dict(zip(sorted(sources, key=lambda s: (s is None, s or "")), (3, 1, 2) * 9))
    want, cap = dict.fromkeys(sources, 0.0), {s: 2 * sum(r.size for r in x) for s, x in sources.items()}
    left, open_ = 1.5 * total, set(sources)
    while left > 1e-9 and open_:
        share = left / sum(weights[s] for s in open_)
        left = 0.0
        for s in list(open_):
            want[s] += share * weights[s]
            if want[s] >= cap[s]:
                left += want[s] - cap[s]
                want[s] = cap[s]
                open_.discard(s)
    for s, x in sources.items():
        assert x[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in x) - want[s]) <= max(20, 0.01 * want[s])
    again = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.taken) for r in rows) == Counter((r.doc_id, r.taken) for r in again)
    assert mixing.mixed_rows(docs).count() == sum(r.copies for r in rows)


def test_sharding_is_even_whole_and_gapless(docs):
    rows = sharding.shard(docs, shards=5).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r[0], r[1]) for r in corpus())
    sizes = Counter()
    slots = {}
    for r in rows:
        assert r.size == len((r.text or "").encode()) + 8
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    largest = max(r.size for r in rows)
    assert max(sizes.values()) <= sum(sizes.values()) / 5 + largest


def test_sharding_cuts_a_group_larger_than_a_shard(spark):
    df = spark.createDataFrame([(i, "same text " * 5) for i in range(400)] + [(1000 + i, f"other {i}") for i in range(100)], "doc_id long, text string")
    sizes = sharding.shard(df, shards=8).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(sizes) == 8
    assert max(r.s for r in sizes) - min(r.s for r in sizes) <= 2 * 58
    for rows in sharding.shard(df, shards=8).groupBy("shard").agg(F.collect_list("slot").alias("slots"), F.collect_list("doc_id").alias("ids")).collect():
        assert sorted(rows.slots) == list(range(len(rows.ids)))


def test_base_spans_and_long_runs(spark):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(k, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[k]

    texts = [
        None, "", "a@b.c_d@e.f x@y.z..q a@b a.@-.-.. é@é.com", "1.2.3.4.5.6.7.8 300.1.1.1 001.0255.3.4", "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111",
        "+1 (23) 4567-890. +1-2 +12345678901234567890", "9" * 60_000, "1 " * 20_000, "a." * 20_000 + "@b.c", "x@" + "a." * 20_000 + "b", "é4111111111111111é +49 30 1234567ü",
        "call (743) 555-3824 or +1 (743) 555-3824", "plain words only",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.detect(df).select("doc_id", pii.listed(F.col("base")).alias("base"), pii.listed(F.col("spans")).alias("spans")).collect()}
    for i, t in enumerate(texts):
        spans = sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(patterns.items()) for m in re.finditer(p, t or "") if ok(k, m.group()))
        assert got[i].base == ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert set(filter(None, got[i].base.split(","))) <= set(got[i].spans.split(","))
    assert got[12].spans == ""
    out = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert out[12] == "plain words only" and "4111111111111111" not in out[10] and out[0] is None


def test_boosting_learns_and_calibrates():
    table = [(code, 90.0 if pii.feature(code, "digits") >= 4 else 2.0, 100.0) for code in range(0, 1 << 9, 3)]
    model = pii.boost(table)
    least = pii.threshold(table, model, 0.85)
    for code, pos, _ in table:
        assert (pii.scored(code, model) >= least) == (pos == 90.0)
    assert pii.threshold([(0, 0.0, 5.0)], model) == math.inf


def test_trees_add_national_numbers_spelt_addresses_and_secrets(spark):
    rnd = random.Random(5)
    num = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    national = lambda: f"({rnd.randint(200, 999)}) {rnd.randint(200, 999)}-{num(4)}"
    rows, wanted = [], {}

    def add(text, span="", kind=""):
        wanted[len(rows)] = f"{kind}:{text.index(span)}:{text.index(span) + len(span)}" if span else ""
        rows.append((len(rows), text))

    for k in range(120):
        n = national()
        add(f"word {k} here +1 {n} end", f"+1 {n}", "phone")  # confirmed numbers teach their national form
        n = national()
        add(f"word {k} here {n} end", n, "phone")
        a = f"user{k} [at] host{k} [dot] {rnd.choice(['com', 'org'])}"
        add(f"see {a} now", a, "email")
        key = hexes(16)
        add(f"the password={key} end", key, "secret")
        key = "AKIA" + "".join(rnd.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(15)) + "7"
        add(f"some {key} words", key, "secret")
        ip = ".".join(str(rnd.randint(100, 255)) for _ in range(4))
        add(f"word {k} {ip} end", ip, "ip")
        add(f"internationalization {k} of extraordinarily-long words on 2024-01-{k % 28 + 1:02d}")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.detect(df).select("doc_id", pii.listed(F.col("spans")).alias("spans")).collect()}
    looser = [i for i in wanted if i % 7 in (1, 2, 3, 4)]
    assert sum(got[i] == wanted[i] for i in looser) >= 0.95 * len(looser)
    rest = [i for i in wanted if i % 7 in (0, 5, 6)]
    assert all(got[i] == wanted[i] for i in rest)
    assert pii.redacted(df).where("doc_id = 3").first().text == "the password=[redacted] end"


def test_line_dedup_against_the_rule(docs):
    rows = lines.drop_repeated_lines(docs, report=True).collect()
    assert len(rows) == len(corpus())
    by = {r.doc_id: r for r in rows}
    assert by[5].doomed == [] and all(by[100 + i].text == "" for i in range(20))
    assert by[130].text.endswith(" tail") and by[131].text is None and by[135].text == LONG
    assert all(r.text == t for r in rows for d, t, *_ in corpus() if d == r.doc_id == 7)


def test_line_dedup_meets_the_holder_of_each_block(spark):
    nine = lambda x: " ".join(f"{x}{i}" for i in range(9))
    block = [nine(c) for c in "abcdef"]
    rows = [
        (1, "\n".join(x for i, c in enumerate(block[::2]) for x in (nine(f"A{i}"), c, nine(f"AA{i}")))),
        (2, "\n".join([nine("B"), *block, nine("BB")])),
        (3, "\n".join([nine("C"), *block, nine("CC")])),
        (4, "one two three four five six seven eight nine ten eleven twelve"),
        (5, "one two three four five six seven eight nine ten eleven twelve\nand a tail\nown words of five"),
        (6, "one two three four five six seven eight nine ten eleven twelve\nand a tail\nother words of six"),
    ]
    rows += [rows[2]] * 3 + [rows[1]] * 2  # repeated rows are one document
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, tuple(r.doomed)) for r in lines.drop_repeated_lines(df, report=True).collect())
    want = {1: (), 2: (), 3: (1, 2, 3, 4, 5, 6), 4: (), 5: (0,), 6: (0, 1)}
    assert got == sorted((d, want[d]) for d, _ in rows)


def test_patience_aligns_blocks():
    a, b = list("abcdXefg"), list("zabcdYefgq")
    got = lines.patience(a, b)
    assert [(a[i], b[j]) for i, j in got] == [(x, x) for x in "abcdefg"]
    assert lines.longest_increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])
    assert lines.patience([], list("ab")) == []


def test_quality_against_brute_force(docs):
    got = {(r.doc_id, r.n_words): r for r in quality.measure(docs).collect()}
    for d, t, *_ in corpus():
        w = WORD.findall(t or "")
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        r = got[(d, len(w))]
        assert (r.word_chars, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, w)), dup, len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.kept and r.base_failed)


def test_language_accuracy_and_rejection(spark):
    rng = np.random.default_rng(0)
    bank = {"en": "the of and to in is that it was for on are with as his they at be this have".split(), "fr": "le la les de des un une et est que qui dans pour pas sur avec plus par ce il".split()}
    make = lambda k, n: " ".join(rng.choice(bank[k], n))
    rows = [(i, make(k, 60), k, "s") for i in range(80) for k in [("en", "fr")[i % 2]]]
    df = spark.createDataFrame(rows + [(200, None, "en", "s"), (201, "123 !!", "en", "s"), (202, make("fr", 8000), None, "s")], "doc_id long, text string, lang string, score string")
    learned = language.dictionaries(df.where("doc_id < 40"))
    got = {r.doc_id: r for r in language.classify(df, learned).collect()}
    assert all(got[i].lang_pred == rows[i][2] and not got[i].rejected for i in range(40, 80))
    assert got[200].lang_pred == got[201].lang_pred == "und" and got[200].rejected
    assert got[202].lang_pred == "fr" and 0 <= got[202].score <= 1
    assert all(r.lang_pred == "und" for r in language.classify(df, {}).collect())


def test_scores_against_brute_force(docs):
    held = F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False))
    got = scoring.score(docs, held, most=50).collect()
    token = lambda t: (t or "").encode().lower().split() + [b"\n"]
    rows = corpus()
    c = Counter(w for d, t, *_ in rows if d is None or d % 5 != 1 for w in token(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d, t, *_ in rows:
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in token(t))
        want[(d, d is not None and d % 5 == 1, len(token(t)), sum(c[w] > 0 for w in token(t)), n, round(base, 5))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_the_cache_of_frequent_words_decides_nothing(docs):
    held = F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False))
    seen = [
        Counter((r.doc_id, r.n_tokens, r.n_known, round(r.score, 4)) for r in scoring.score(docs.coalesce(1), held, classes=8, rounds=0, most=most).collect())
        for most in (0, 50, 100_000)
    ]
    assert seen[0] == seen[1] == seen[2]
    text = "unbelievably antidisestablishmentarianism xqzzt"
    words = scoring.words_of(text)
    ids = scoring.coder().each_of(words)
    pool, starts = np.frombuffer(ids[0], "<u2"), np.array([0, len(ids[0]) // 2])
    row = [c[0] for c in scoring.prepared([text], scoring.coder(), {words[0]: 0}, pool, starts, np.zeros(2), np.array([5, 0], "<u2"))]
    assert row[6] == b"".join(ids)
    assert np.frombuffer(row[5], "<u2").tolist() == [5, 0, 0, 0] and np.frombuffer(row[4], "<u4").tolist() == [0, 1, 2]
    assert row[3] == [*words[1:], b"\n"]


def test_windows_score_each_prediction_once():
    lengths = np.array([1, 5, 31, 32, 33, 100, 1000])
    place, fresh = scoring.windows(lengths)
    base = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    hit = Counter(place[:, 1:][fresh].tolist())
    assert hit == Counter(b + i for b, n in zip(base.tolist(), lengths.tolist()) for i in range(1, n + 1))


def test_training_takes_every_window_of_every_document():
    rng = np.random.default_rng(5)
    blobs = [rng.integers(1, 1000, n).astype("<u2").tobytes() for n in [3, 40, 900, 31, 0, 200, 75]]
    opens, evidence = np.ones(scoring.SIZE, bool), np.zeros((scoring.SIZE, 2), np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array([None, 5, 2, 3, 4, 9, 8]), pa.array(blobs, pa.binary())], names=["doc_id", "ids"])
    got = Counter()
    for turn in range(scoring.ROUNDS):
        for _, _, _, marks in scoring.training_batches([batch], turn, scoring.ROUNDS, opens, evidence):
            got.update(row.tobytes() for row in marks)
    stream, begins, n = scoring.streamed(blobs, opens)
    assert got == Counter(row.tobytes() for row in scoring.token_marks(stream, begins)[scoring.windows(n)[0]])


def test_attention_is_causal_and_gradients_are_right(monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK", 2)
    rng = np.random.default_rng(2)
    k = 5
    flat = scoring.fresh(np.zeros(k)).astype(np.float64)
    flat += rng.normal(0, 0.1, len(flat))
    seen, target = rng.normal(0, 1, (2, 3, scoring.WINDOW, k))
    weight = rng.random((3, scoring.WINDOW)) < 0.8
    w = scoring.split(flat, k)
    other = seen.copy()
    other[:, 20:] = 3
    assert np.allclose(scoring.forward(w, seen)[0][:, :20], scoring.forward(w, other)[0][:, :20])

    def loss(x):
        logits, _ = scoring.forward(scoring.split(x, k), seen)
        mixed = np.log((scoring.softmax(logits) * np.exp(target)).sum(2))
        return -(mixed * weight).sum() / weight.sum()

    parts = scoring.gradient(w, seen, target, weight)
    g = np.concatenate([parts[n].ravel() for n in scoring.shapes(k)])
    for i in rng.choice(np.flatnonzero(np.abs(g) > 1e-5), 20, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert g[i] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=2e-3, abs=1e-7)


def test_log_probabilities_against_one_token_at_a_time():
    rng = np.random.default_rng(4)
    k, classes = 3, 4
    opens = rng.random(scoring.SIZE) < 0.7
    opens[scoring.END_ID] = True
    stats = SimpleNamespace(
        opens=opens, evidence=rng.normal(0, 1, (scoring.SIZE, k)), prior=rng.normal(0, 1, k), per=rng.random(k), left=rng.random(k) / 2, classes=rng.integers(0, classes, scoring.SIZE),
        goes_on=-rng.random(scoring.SIZE), ends=-rng.random(scoring.SIZE), follow=-rng.random((scoring.SIZE + 1, classes)), share=-rng.random((classes + 1, scoring.SIZE)), start=rng.random((scoring.SIZE, k)),
    )
    w = scoring.split(rng.normal(0, 0.4, len(scoring.fresh(np.zeros(k)))), k)
    goes_on, shares = np.array([0.1, 0.3, 0.6]), rng.random(9)
    pool = np.flatnonzero(opens[:60])[:12]
    texts = [[[int(rng.choice(pool)), *(int(x) for x in np.flatnonzero(~opens[:40])[: rng.integers(0, 3)])] for _ in range(n)] for n in (0, 1, 30, 31, 32, 33, 57, 120)]
    levels = [rng.integers(0, 9, len(t) + 1) for t in texts]
    sums, known_rare, other_rare, edges = scoring.judged([np.array(sum(t, []), "<u2").tobytes() for t in texts], [x.astype("<u2").tobytes() for x in levels], stats, w, goes_on, shares)
    rare = np.logaddexp(np.log(shares[0]) + known_rare, other_rare)
    got = [s + rare[lo:hi].sum() for s, lo, hi in zip(sums, edges, edges[1:])]
    ev = lambda t: np.clip(stats.evidence[t].sum(0), -12, 12)
    for text, level, value in zip(texts, levels, got):
        tokens, total = [[scoring.END_ID], *text, [scoring.END_ID]], 0.0
        for j in range(len(tokens) - 1):
            at = max(0, (j - scoring.OVERLAP) // (scoring.WINDOW - scoring.OVERLAP)) if j >= scoring.WINDOW else 0
            at *= scoring.WINDOW - scoring.OVERLAP
            seen, target = tokens[at : j + 1], tokens[j + 1]
            x = np.array([ev(t) for t in seen]) @ w["lift"] + w["place"][: len(seen)]
            a = scoring.softmax((x[-1] @ w["q"]) @ (x @ w["k"]).T / math.sqrt(scoring.WIDTH))
            hidden = np.tanh(x[-1] + (a @ (x @ w["v"])) @ w["o"])
            gate = scoring.softmax(hidden @ w["out"] + (a @ np.array([ev(t) for t in seen])) @ w["skip"] + w["bias"][0])
            known = shares[level[j]] * (gate * scoring.softmax(stats.prior + ev(target))) @ stats.per
            spelled = stats.ends[target[-1]] + sum(stats.goes_on[x] + stats.follow[x, stats.classes[y]] + stats.share[stats.classes[x], y] for x, y in zip(target, target[1:]))
            p = known + (gate * stats.start[target[0]]) @ stats.left * math.exp(spelled)
            for length in range(min(scoring.COPY, len(seen) - 1), 0, -1):
                ends = [e for e in range(length, len(seen)) if seen[e - length : e] == seen[-length:]]
                if ends:
                    p = (1 - goes_on[length - 1]) * p + goes_on[length - 1] * (seen[ends[-1]] == target)
                    break
            total += math.log(p)
        assert value == pytest.approx(total, rel=1e-4)


def test_repeated_places_of_later_windows_ask_nothing():
    rng = np.random.default_rng(6)
    k, n = 4, 40
    w = scoring.split(scoring.fresh(np.zeros(k)).astype(np.float64) + rng.normal(0, 0.1, len(scoring.fresh(np.zeros(k)))), k)
    seen, target = rng.normal(0, 1, (2, n, scoring.WINDOW, k))
    whole, _ = scoring.forward(w, seen)
    late, (rows, *_, hidden) = scoring.forward(w, seen, scoring.OVERLAP)
    assert late.shape == (n, scoring.WINDOW - scoring.OVERLAP, k) and hidden.shape[1] == late.shape[1]
    assert np.allclose(late, whole[:, scoring.OVERLAP :]) and np.allclose(rows.T, late.reshape(-1, k))
    weight = rng.random((n, scoring.WINDOW)) < 0.8
    weight[5:, : scoring.OVERLAP] = False
    got = scoring.gradient(w, seen, target, weight)
    all_places = scoring.block_gradient(w, scoring.joined(w), seen, target, (weight / weight.sum()), 0)
    assert np.allclose(got["out"], all_places[0]) and np.allclose(got["lift"], all_places[2] @ scoring.joined(w)[0].T)


def test_copies_and_evidence_against_plain_loops():
    rng = np.random.default_rng(7)
    marks = rng.integers(0, 6, (9, scoring.WINDOW + 1), np.uint64) + (rng.integers(0, 2, (9, scoring.WINDOW + 1), np.uint64) << np.uint64(16))  # alike in 16 bits
    length, right = scoring.copied(marks)
    for row, got, came in zip(marks.tolist(), length.tolist(), right.tolist()):
        for i in range(scoring.WINDOW):
            run = lambda j, i=i, row=row: next((m for m in range(scoring.COPY) if m > j or row[j - m] != row[i - m]), scoring.COPY)
            best, at = max(((run(j), j) for j in range(i)), default=(0, 0))
            assert got[i] == best and came[i] == (best > 0 and row[at + 1] == row[i + 1])
    lengths = np.array([1, 2, 7, 8, 9, 30, 1, 12])
    ids, evidence = rng.integers(0, 50, lengths.sum()), rng.normal(0, 1, (50, 3))
    begins = np.cumsum(lengths) - lengths
    assert np.allclose(scoring.token_evidence(ids, begins, evidence), np.clip([evidence[ids[b : b + n]].sum(0) for b, n in zip(begins, lengths)], -12, 12))


def test_neighbours_and_words_against_plain_loops():
    rng = np.random.default_rng(8)
    opens = rng.random(scoring.SIZE) < 0.6
    opens[scoring.END_ID] = True
    first, later = np.flatnonzero(opens[:200]), np.flatnonzero(~opens[:200])
    texts = [[[int(rng.choice(first)), *rng.choice(later, rng.integers(0, 3)).tolist()] for _ in range(n)] for n in (0, 1, 3, 30)]
    total, want = np.zeros(scoring.SIZE * (scoring.BUCKETS + 1), np.int64), Counter()
    for _ in range(2):
        scoring.count_neighbours(total, *scoring.streamed([np.array(sum(t, []), "<u2").tobytes() for t in texts]), opens)
    for words in texts:
        for i, word in enumerate(words):
            for j in range(max(0, i - scoring.REACH), min(len(words), i + scoring.REACH + 1)):
                want.update({(t, (words[j][0] * 0x9E3779B1 >> 7) % scoring.BUCKETS): 2 * c for t, c in Counter(word).items()} if j != i else {})
    table = total.reshape(scoring.SIZE, -1)[:, : scoring.BUCKETS]
    assert {(i, b): table[i, b] for i, b in np.argwhere(table).tolist()} == want

    texts = [None, "", " \n", " A\x0bb ", "x\x1cy\x85z\u00a0w \u2003q\t\r\n\u00c9 \u0130 ", "a a"]
    words, n = scoring.words_of_column(pa.array(["cut", *texts]).slice(1))
    assert words.cast(pa.binary()).to_pylist() == [w for t in texts for w in scoring.words_of(t)] and n.tolist() == [len(scoring.words_of(t)) for t in texts]


def test_binary_columns_are_read_whole_and_in_slices():
    blobs = [b"\1\0\2\0", b"", b"\3\1", b"\4\0\5\0\6\0"]
    column = pa.array([b"\7\0", *blobs, b"\7\0"], pa.binary()).slice(1, 4)
    assert scoring.bytes_of(column) == blobs
    for given in (blobs, column):
        ids, starts = scoring.ragged(given)
        assert ids.tolist() == [1, 2, 259, 4, 5, 6] and starts.tolist() == [0, 2, 2, 3, 6] and ids.dtype == np.int64
    for given in ([], column.slice(0, 0), [b""]):
        assert not len(scoring.ragged(given)[0]) and scoring.ragged(given)[1].tolist() == [0] * (len(given) + 1)
    lists = pa.array([[b"cut"], [b"a", b"b"], [], [b"c"], [b"cut"]], pa.list_(pa.binary())).slice(1, 3)
    which = [np.array(x, "<u4").tobytes() for x in ([1, 0, 1], [], [0, 0])]
    assert scoring.picked(lists, which).to_pylist() == [b"b", b"a", b"b", b"c", b"c"]
    assert scoring.picked(lists.slice(0, 0), []).to_pylist() == []


def test_words_with_punctuation_take_held_ids(monkeypatch):
    coding = scoring.coder()
    words = [b"known!!", b"known", b"other.", b"it's", "\u00e9t\u00e9,".encode()]
    want, asked = coding.looked_up(words), []
    stem = coding.each(["known"])[0]
    together = coding.together
    monkeypatch.setattr(coding, "together", lambda part: asked.extend(part) or together(part))
    assert coding.looked_up(words, lambda w: stem if w == b"known" else None) == want
    assert asked == ["other", "\u00e9t\u00e9"]


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    from faultline.llm import tokens

    hard = "It's X's, 'll café... a<|endoftext|> <|ENDOFTEXT|> ... Don't!! É́t, a b, İx. ΣΣ. 12,3 a\x1cb"
    path = packing.default_vocabulary()
    got = np.frombuffer(tokens.WordIds(path, "<u4", fold=True).of([hard.encode().split()])[0], "<u4").tolist()
    assert got == Tokenizer.from_file(path).encode(hard, add_special_tokens=False).ids


def test_pipeline_keeps_columns_and_decides(spark, docs, tmp_path):
    import corpus_pipeline

    path = str(tmp_path / "documents.parquet")
    docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null").write.parquet(path)
    out = spark.read.parquet(path)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = out
        out = stage(spark, before, str(tmp_path))
        if i < 4:
            assert out.columns == before.columns
            out.write.parquet(str(tmp_path / f"stage{i}"))
            out = spark.read.parquet(str(tmp_path / f"stage{i}"))
    assert out.count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == out.count()


def test_redaction_is_by_row_not_by_id(spark):
    rows = [(None, "mail a.b@c.de now"), (None, "plain"), (2, "call x@y.org"), (2, "other x@y.org z@y.org"), (2, "call x@y.org"), (3, None), (4, "")]
    got = pii.redacted(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(None, "mail [redacted] now"), (None, "plain"), (2, "call [redacted]"), (2, "other [redacted] [redacted]"), (2, "call [redacted]"), (3, None), (4, "")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_running_combines_over_blocks(spark):
    from faultline.llm.common import running

    sizes = [0, 1, 4, 5, 8, 9, 37]
    rng = np.random.default_rng(3)
    rows = [(n, [int(x) for x in rng.integers(-50, 50, n)]) for n in sizes] + [(-1, None)]
    df = spark.createDataFrame(rows, "n int, a array<int>").select("n", "a", running("a", lambda x, y: x + y, 4).alias("total"), running("a", F.greatest, 4).alias("top"))
    for r in df.collect():
        assert r.total == (None if r.a is None else list(np.cumsum(r.a)) if r.a else [])
        assert r.top == (None if r.a is None else list(np.maximum.accumulate(r.a)) if r.a else [])


def test_pii_of_texts_with_very_many_matches(spark):
    n = 60_000
    numbers = " ".join(f"call +4930{i:08d} or 030-1234-{i % 10000:04d}," for i in range(n))
    df = spark.createDataFrame([(1, numbers), (2, " ".join(f"word{i} and" for i in range(n))), (3, None), (4, "tel. +49301234567 \U0001f600 mail a@b.de")], "doc_id long, text string")
    begin = time.time()
    got = {r.doc_id: r.spans for r in pii.detect(df).collect()}
    want = [(m.start(), 3, m.end()) for m in re.finditer(r"\+4930[0-9]{8}", numbers)]
    assert [tuple(s) for s in got[1] if numbers[s.start] == "+"] == want and got[2] == got[3] == []
    assert {(s.start, s.end) for s in got[1]} - {(a, b) for a, _, b in want} <= {m.span() for m in re.finditer(r"030-1234-[0-9]{4}", numbers)}
    out = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    kept, at = [], 0
    for s in got[1]:
        kept.append(numbers[at : s.start])
        at = s.end
    assert out[1] == "[redacted]".join([*kept, numbers[at:]])
    assert out[2] == df.where("doc_id = 2").first().text and out[3] is None and out[4] == "tel. [redacted] \U0001f600 mail [redacted]"
    assert time.time() - begin < 120  # work that grew with the square of the matches would take hours


def shingle_nodes(spark, texts):
    found = near.sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    return found, found.select("node", F.col("node").alias("root")).distinct()


def test_rare_shingles_miss_no_similar_pair(spark):
    rng = np.random.default_rng(23)
    pools = [[f"p{p}w{x}" for x in range(60)] for p in range(4)]
    texts = {" ".join(pools[rng.integers(4)][int(a) : int(a + n)] + [f"x{i}"] * int(rng.integers(0, 3))) for i in range(160) for a, n in [(rng.integers(0, 12), rng.integers(3, 50))]}
    found, nodes = shingle_nodes(spark, sorted(texts))
    held = {r.node: set(np.frombuffer(r.held, np.uint64).tolist()) for r in found.collect()}
    pairs = near.rare_pairs(near.rare_ends(nodes, found))
    got = {(r.src, r.dst) for r in near.similar(pairs, found).collect()}
    keys = sorted(held)
    want = {frozenset((a, b)) for i, a in enumerate(keys) for b in keys[:i] if 5 * len(held[a] & held[b]) >= 4 * len(held[a] | held[b])}
    assert {frozenset(p) for p in got} == want and len(want) > 50


def test_many_texts_just_below_the_similarity_are_not_paired(spark):
    page = [f"page{x}" for x in range(304)]
    texts = [" ".join([*page, *[f"own{i}x{x}" for x in range(50)]]) for i in range(2_000)]  # 300 of 400 shingles shared by any two
    found, nodes = shingle_nodes(spark, texts)
    assert near.rare_pairs(near.rare_ends(nodes, found)).count() == 0
    assert len(stage_near_dedup(spark, list(enumerate(texts)))) == 2_000


def near_copies(n: int, seed: int):
    """Pairs of word texts whose 5-word shingle sets are similar by 0.8 to 0.9."""
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        words = [f"w{x}" for x in rng.integers(0, 9000, int(rng.integers(60, 300)))]
        edited = list(words)
        for at in rng.choice(len(words), max(1, int(len(words) * rng.uniform(0.01, 0.025))), replace=False):
            edited[at] = f"new{len(out)}x{at}"
        a, b = (set(zip(*(t[k:] for k in range(5)))) for t in (words, edited))
        if 0.8 <= len(a & b) / len(a | b) < 0.9:
            out.append((" ".join(words), " ".join(edited)))
    return out


def test_tries_link_pairs_of_similarity_above_the_bound(spark):
    pairs = near_copies(400, 5)
    rows = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    found = near.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    loose = {r.fp: r.loose for r in simhash.wide_groups(found.select("fp", "more")).collect()}
    of = {r.doc_id: loose.get(r.fp, r.fp) for r in found.collect()}
    assert sum(of[2 * i] == of[2 * i + 1] for i in range(len(pairs))) >= 396
    assert len(set(of.values())) >= len(pairs)


def test_near_dedup_stage_takes_its_candidates_from_the_tries(spark, monkeypatch):
    rows = [(2 * i + j, t) for i, p in enumerate(near_copies(5, 6)) for j, t in enumerate(p)]
    assert [r[1] for r in stage_near_dedup(spark, rows)] == [0, 2, 4, 6, 8]
    monkeypatch.setattr(simhash, "wide_groups", lambda fps: fps.select("fp", F.col("fp").alias("loose")))
    assert len(stage_near_dedup(spark, rows)) == 10


def test_dense_nodes_of_a_trie_are_spanned():
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, (3, 2), np.uint64)
    flips = np.packbits(rng.random((4000, 128)) < 0.1, axis=1).view(np.uint64)
    x, y = (np.concatenate([centres[np.arange(3000) % 3, k] ^ flips[:3000, k], flips[3000:, k] ^ rng.integers(0, 1 << 63, 1000, np.uint64)]) for k in range(2))
    d = np.bitwise_count(x[:, None] ^ x) + np.bitwise_count(y[:, None] ^ y) <= 38
    labels = []
    for a, b in (simhash.forest(*np.nonzero(np.triu(d, 1))), simhash.dense_links(x, y, 38)):
        label = np.arange(len(x))
        label[a] = b
        labels.append({frozenset(np.flatnonzero(label == k).tolist()) for k in np.unique(label)})
    assert labels[0] == labels[1] and len(labels[0]) > 3


def test_cells_of_a_large_vocabulary_take_a_bounded_array():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(0)
    blobs = [x.tobytes() for x in rng.integers(0, scoring.SIZE, (5_000, 100)).astype("<u2")]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * len(blobs)), pa.array(blobs)], names=["c", "ids"])
    cells, size = scoring.unigram_cells(64), scoring.SIZE * (1 + 2 * 64)
    tracemalloc.start()
    slices = list(scoring.cell_sums([batch], cells, size))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    at, weight = cells(*scoring.ragged(blobs), None)
    want = np.bincount(at, weight, size)
    got = np.zeros(size)
    for x in slices:
        assert x.num_rows <= 50_000
        got[x.column(0).to_numpy()] = x.column(1).to_numpy()
    assert np.array_equal(got, want) and peak < 150_000_000


def test_the_costly_level_is_asked_last(spark):
    """level 12 read every text first, for more than half the time, and told no more languages than level 10."""
    rng = random.Random(5)
    stems = {lang: ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(150)] for lang, letters in (("a", "abcdefghi"), ("b", "fghijklmn"), ("c", "klmnopqrs"))}
    rows = [(i, " ".join(rng.choices(stems[lang], k=rng.choice((3, 8, 60)))), lang) for i, lang in enumerate("abc" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language.dictionaries(df.where("doc_id < 90"))
    seen = {levels: {r.doc_id: r for r in language.classify(df.where("doc_id >= 90"), learned, levels=levels).collect()} for levels in (language.LEVELS, (12, 6, 3))}
    right = {levels: sum(r.lang_pred == r.lang for r in got.values()) for levels, got in seen.items()}
    assert right[language.LEVELS] >= right[(12, 6, 3)]
    assert not any(seen[language.LEVELS][d].rejected and not r.rejected for d, r in seen[(12, 6, 3)].items())
    assert max(language.LEVELS) == language.LEVELS[-1]


def test_word_ids_of_a_column_look_each_distinct_word_up_once():
    """every word of every text was looked up on its own."""
    from faultline.llm import tokens

    odd = ["", None, "  a b\t\x0b\fc\r\n ", "\x1ca\x1db c d İIẞ STRASSE", "!!! ...a,b c.. 中文 Café!", "a" * 5000, " ", "The the THE the, x", "tail\n"]
    coder = tokens.WordIds(packing.default_vocabulary(), "<u4", fold=True)
    want = coder.of([(t or "").encode().split() for t in odd])
    for column in (pa.array(odd), pa.array(odd, pa.large_string()), pa.array(["cut", *odd]).slice(1)):
        assert coder.of_column(column) == want
    assert coder.of_column(pa.array([], pa.string())) == []
    asked = []
    coder.each_of = lambda words: asked.extend(words) or [b"\1\0\0\0"] * len(words)
    assert coder.of_column(pa.array(["one two one", "Two ONE"])) == [b"\1\0\0\0" * 3, b"\1\0\0\0" * 2]
    assert sorted(asked) == [b"one", b"two"]


def test_workers_forget_vocabularies_and_take_small_batches(spark, docs):
    """workers kept vocabularies and memos for all later stages, and took 10,000 whole texts in a batch."""
    from faultline.llm import common, tokens

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    language.classify(docs, {"a": b"x"})
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == common.BATCH_ROWS
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    common.small_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    tokens.word_ids(packing.default_vocabulary(), fold=True).of_column(pa.array(["some words"]))
    assert tokens._MEMOS
    scoring._SEEDED["of"] = "a run"
    list(scoring.cell_sums(iter(()), None, 4))
    assert not tokens._MEMOS and not scoring._SEEDED
