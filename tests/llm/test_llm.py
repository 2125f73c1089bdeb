"""The training-data operators against SQL and brute force, on small and awkward tables."""

import hashlib
import re
from collections import defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import bpe, jaccard, lines, lm, mixing, passages, pii, quality, substrings, topk
from siltstone.llm.common import WordHash, small_batches, trimmed, word_hashes
from siltstone.llm.components import components
from siltstone.llm.oracles import SQL
from siltstone.llm.queries import QUERIES

TABLES = "documents embeddings pages benchmark labels conversations"
PROSE = " ".join(f"word{i % 97}x{i * i % 89}" for i in range(300))
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, "a b c"), (7, PROSE), (8, PROSE), (9, PROSE + " more words at the end"), (10, "é\n\n\nß\n\n\n"), (11, "x" * 5000),
    (12, "l1 a\nl2 b\nl3 c\nl4 d"), (13, "zz\nl1 a\nl2 b\nl3 c"), (14, "aa\naa\naa\naa\naa"), (7, PROSE), (None, PROSE), (None, None), (15, "The The " * 200),
]


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, None if i is None else f"s{i % 3}", "n", 1) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, id string, n int")


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    want = con.sql(SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    at = [want.columns.index(c) for c in sorted(want.columns)]
    got = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def documents(sf_dir):
    return duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()


# --- 1 ---


def brute_components(docs, k=4, num=85, den=100):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    holders, count, parent = defaultdict(list), defaultdict(int), {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for own in holders.values():
        for x in range(len(own)):
            for y in range(x):
                count[own[y], own[x]] += 1

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), c in count.items():
        if den * c >= num * (len(sets[a]) + len(sets[b]) - c):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def linked(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect() if r.doc_id is not None}


@pytest.mark.parametrize(("share", "few"), [(None, 33), (1.0, 33), (0.4, 2)])
def test_jaccard_against_brute_force(spark, sf_dir, monkeypatch, share, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    assert linked(jaccard.link(spark.read.parquet(f"{sf_dir}/documents.parquet"), share=share)) == brute_components(documents(sf_dir))


def test_jaccard_near_family(spark, monkeypatch):
    """A family of near copies around the threshold, with every later step in use."""
    monkeypatch.setattr(jaccard, "FEW", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "COMMON", 10**9)
    r = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(60):
        w = list(base)
        for at in r.choice(len(w), int(r.integers(0, 4)), replace=False):
            w[at] = f"e{i}x{at}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert linked(jaccard.link(df)) == brute_components(docs)
    monkeypatch.setattr(jaccard, "COMMON", 2)
    assert linked(jaccard.link(df)) == brute_components(docs)


def test_jaccard_awkward(spark, awkward, empty):
    """Rows that repeat an id, or have none, are documents of their own; a component is named by its smallest id."""
    rows = jaccard.link(awkward).collect()
    want = brute_components(list(enumerate(t for _, t in AWKWARD)))
    least = {}
    for n, (_, of) in want.items():
        least.setdefault(of, []).append(AWKWARD[n][0])
    named = [(str(i), want[n][0], str(min((x for x in least[want[n][1]] if x is not None), default=None))) for n, (i, _) in enumerate(AWKWARD)]
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == sorted(named)
    assert jaccard.link(empty).isEmpty()


def test_sketches():
    r = np.random.default_rng(2)
    for n, m, both in ((1, 1, 0), (1, 1, 1), (64, 65, 50), (70, 300, 69), (1000, 900, 880), (5, 4000, 0)):
        own = r.integers(0, 2**64, n + m - both, np.uint64, endpoint=False)
        a, b = own[:n], own[n - both :]
        assert jaccard.differ(jaccard.sketch(a), jaccard.sketch(b)) <= n + m - 2 * both
    assert jaccard.differ(jaccard.sketch(own[:5]), jaccard.sketch(own[:5])) == 0


@pytest.mark.parametrize("small", [0, 10_000])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr("siltstone.llm.components.SMALL", small)
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}


# --- 2, 3, 5 ---


def test_quality_verdicts(spark):
    """At a tenth of the full tables' scale junk goes and clean documents stay."""
    d = "/root/testdata/sf0.1"
    rows = quality.assess(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")).drop("quality").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("NOT base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in rows.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.005 * n[1, True]
    assert n.get((0, True), 0) <= 0.02 * n[0, False]


def test_quality_awkward(awkward, empty):
    rows = quality.assess(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 50)
    assert [r.n_repeat_words for r in rows if r.doc_id == 15] == [400]
    assert quality.assess(empty).isEmpty()


def check_mix(df):
    rows = mixing.mix(df).collect()
    assert len(rows) == df.count()
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.times <= 2
        by[r.source].append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    assert sum(own[0].target for own in by.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    return rows


def test_mixing_totals(spark, sf_dir, awkward, empty):
    for df in (spark.read.parquet(f"{sf_dir}/documents.parquet"), awkward):
        check_mix(df)
    assert mixing.mix(empty).isEmpty()


def test_mixing_ties(spark):
    """Documents without an id, and rows that repeat one, are not taken all or none."""
    schema = "doc_id long, text string, source string"
    rows = [(None, "w " * (1 + i % 4), "a") for i in range(50)] + [(7, "b c d", "b") for _ in range(50)] + [(8, f"x{i} y", "c") for i in range(50)]
    rows += [(i, "z " * 5, s) for i in range(100, 130) for s in "abc"] + [(i, "", "d") for i in range(20)] + [(1, "only words", "e")]
    check_mix(spark.createDataFrame(rows, schema))
    check_mix(spark.createDataFrame([(i, " ", "a") for i in range(9)], schema))
    full = mixing.mix(spark.createDataFrame([(i, "v" * (i % 2), "a") for i in range(40)] + [(50, "u " * 400, "b")], schema)).collect()
    assert max(r.times for r in full) <= 2


def plain_lines(rows):
    """Texts (id, text) after removal, by text and first row."""
    docs = sorted({(i is None, i or 0, t, i) for i, t in rows if t is not None}, key=lambda d: d[:2] + (hash_of(d[2]),))
    seen, out = set(), {}
    for _, _, t, i in docs:
        ls, gone = t.split("\n"), set()
        for n in range(len(ls) - 2):
            w = tuple(ls[n : n + 3])
            if "".join(w).encode().split():
                if w in seen:
                    gone |= {n, n + 1, n + 2}
                seen.add(w)
        out[i, t] = ("\n".join(x for n, x in enumerate(ls) if n not in gone), len(gone))
    return out


def hash_of(text):
    """The order of texts that share an id: Spark's xxhash64 of (1, text), looked up in HASHES."""
    return HASHES[text]


HASHES = {}


def test_lines_repeated_ids(spark):
    rows = [(5, "a\nb\nc\nd1 d2 d3"), (5, "q1\nq2\nq3\na\nb\nc"), (5, "a\nb\nc\nd1 d2 d3"), (None, "a\nb\nc"), (None, "n1\nn2\nn3\nn1\nn2\nn3\nn4"), (None, None), (9, "q2\nq3\na\nb"), (6, "q1\nq2\nq3 \na")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    HASHES.update({r.text: r.h for r in df.select("text", F.xxhash64(F.lit(1), "text").alias("h")).collect()})
    want = plain_lines(rows)
    got = lines.dedup_lines(df).collect()
    assert sorted((str(r.doc_id), r.text, r.n_removed) for r in got) == sorted((str(i), *(want[i, t] if t is not None else ("", 0))) for i, t in rows)
    assert len({r.text for r in got if r.doc_id == 5}) == 2 and any("q1\nq2\nq3" in r.text for r in got if r.doc_id == 5)


@pytest.mark.parametrize("names", ["_q _code _votes _failed id", "_source _size _hash _t _below s cut", "_id _starts at h1 body id row txt", "key k a b part"])
def test_clashing_names(spark, names):
    """Columns of any name come through unchanged."""
    extra = names.split()
    rows = [(i, t, f"s{(i or 0) % 2}", *(f"{c}{n}" for c in extra)) for n, (i, t) in enumerate(AWKWARD)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, source string, {', '.join(f'`{c}` string' for c in extra)}")
    want = sorted(tuple(r[3:]) for r in rows)
    for out in (quality.assess(df), mixing.mix(df), lines.dedup_lines(df), pii.find_personal_data(df, pii.labelled_table(spark)), bpe.encode(df, *bpe.tokenizer_files())):
        assert sorted(tuple(r[c] for c in extra) for r in out.select(*extra).collect()) == want


def test_lines_awkward(awkward, empty):
    got = {r.doc_id: r for r in lines.dedup_lines(awkward).collect() if r.doc_id is not None}
    assert got[13].text == "zz" and got[12].text == "l1 a\nl2 b\nl3 c\nl4 d"
    assert got[14].text == "aa" and got[14].n_removed == 4
    assert got[1].text == "" and got[7].text == PROSE and got[10].n_lines == 7
    assert lines.dedup_lines(empty).isEmpty()


# --- 4 ---


def best_products(rows, k):
    """Scores by Python's integers; a long's ends hold what is beyond them."""
    v = {i: [int(np.floor(64 * float(np.float32(c)))) for c in x] for i, x in rows if i is not None and x is not None and None not in x and np.isfinite(np.float32(x)).all()}
    want = {}
    for q in (i for i in v if i % 20 == 0):
        score = {i: max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(v[q], x, strict=True)))) for i, x in v.items() if i != q and len(x) == len(v[q])}
        want |= {(q, n + 1): (i, score[i]) for n, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:k])}
    return want


@pytest.mark.parametrize(("rows_at_once", "queries_at_once"), [(7, 2), (4096, 8192)])
def test_top_k_awkward(spark, monkeypatch, rows_at_once, queries_at_once):
    monkeypatch.setattr(topk, "ROW_BLOCK", rows_at_once)
    monkeypatch.setattr(topk, "QUERY_BLOCK", queries_at_once)
    monkeypatch.setattr(topk, "RUN", 3)
    monkeypatch.setattr(topk, "STEP", 2)
    monkeypatch.setattr(topk, "ASKED", 2)
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=5).round(1)]) for i in range(60)]
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (104, [1.0]), (105, [2.0]), (106, []), (120, [0.5] * 5), (121, [0.5] * 5), (None, [9.0] * 5)]
    large = [(200 + i, [float(np.float32(x)) for x in r.normal(size=5) * 3e7]) for i in range(50)] + [(260, [1e30] * 5), (261, [-1e30, 1.0, 1.0, 1.0, 1.0])]
    shifted = [(i, [float(np.float32(x)) for x in 1e6 + r.normal(size=5)]) for i in range(60)]
    for own in (rows, rows + large, shifted):
        df = spark.createDataFrame([(i, x, "n", 1) for i, x in own], "vec_id long, embedding array<float>, ids string, block int")
        got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in topk.top_k(df, df.filter("vec_id % 20 = 0"), 4, n_pivots=3).collect()}
        assert got == best_products(own, 4)
    assert topk.top_k(df.limit(0), df.limit(0), 4).isEmpty()


# --- 6 ---


def test_scores_awkward(awkward, empty):
    rows = lm.score(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert all((r.log10_score == 0) == (r.n_words == 0) for r in rows)
    assert lm.score(empty).isEmpty()


def test_scores_identical_rows(spark, monkeypatch):
    """A table of one row, over and over, over many chunks, and rows without an id."""
    monkeypatch.setattr(lm, "CHUNK", 60)
    for i in (7, None):
        rows = lm.score(spark.createDataFrame([(i, "a b c d")] * 40, "doc_id long, text string")).collect()
        assert len(rows) == 40 and {round(r.log10_score, 9) for r in rows} == {round(np.log10(1 / 4) + np.log10(0.4 ** 0), 9)}


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_order(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "CHUNK", 8)
    docs = [(1, "a b c a b"), (2, "a b c d"), (3, "b c"), (4, ""), (5, "x a b c a y d c b a")]
    got = {r.doc_id: r.log10_score for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string"), order=order).collect()}
    for i, t in docs:
        w, rest = t.split(), [x.split() for j, x in docs if j != i]
        count = lambda g: sum(tuple(x[p : p + len(g)]) == g for x in rest for p in range(len(x) - len(g) + 1))  # noqa: B023, E731
        total, words = 0.0, sum(map(len, rest))
        for p in range(len(w)):
            for n in range(min(order, p + 1), 0, -1):
                g = tuple(w[p - n + 1 : p + 1])
                if count(g):
                    total += np.log10(count(g) / (count(g[:-1]) if n > 1 else words)) + (min(order, p + 1) - n) * np.log10(0.4)
                    break
            else:
                total += -np.log10(words + 1) + (min(order, p + 1) - 1) * np.log10(0.4)
        assert got[i] == pytest.approx(total)


# --- 7 ---


def test_passages(spark, sf_dir, awkward, empty):
    docs = documents(sf_dir)
    found = passages.near_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    words = {i: (t or "").encode().lower().split() for i, t in docs}
    first, repeats = {}, set()
    for i, w in words.items():
        for j in range(len(w) - 50):
            g = tuple(w[j : j + 51])
            if first.setdefault(g, i) != i:
                repeats |= {i, first[g]}
    assert repeats <= {r.doc_id for r in found}
    assert all(0 <= r.start_word < r.end_word <= len(words[r.doc_id]) and r.end_word - r.start_word >= 50 for r in found)
    assert {r.doc_id for r in passages.near_passages(awkward).collect()} >= {7, 8, 9}
    assert passages.near_passages(empty).isEmpty()


@pytest.mark.parametrize("few", [33, 0])
def test_passages_beyond_leads(spark, monkeypatch, few):
    """Equal passages whose parts lead elsewhere, and near copies that are far from the first of their family."""
    monkeypatch.setattr(passages, "FEW", few)
    monkeypatch.setattr(passages, "TEXTS", 5)
    r = np.random.default_rng(11)
    prose = lambda n: [f"w{x}" for x in r.integers(0, 10**9, n)]
    docs, wanted = [], []
    for _ in range(4):
        passage = prose(90)
        docs += [prose(40) + passage[:45] + prose(40) for _ in range(5)] + [prose(40) + passage[45:] + prose(40) for _ in range(5)]
        wanted.append((len(docs), len(docs) + 1))
        docs += [prose(60) + passage + prose(60) for _ in range(2)]
    for _ in range(4):
        first = prose(120)
        other = [x if i % 17 else f"{x}y" for i, x in enumerate(first)]
        wanted.append((len(docs) + 1, len(docs) + 2))
        docs += [first, list(other), other[:60] + ["z"] + other[61:]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = {row.doc_id: row.class_id for row in passages.near_passages(df).collect()}
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in docs]
    for a, b in wanted[4:]:
        assert 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and 10 * len(sets[a] & sets[a - 1]) < 8 * len(sets[a] | sets[a - 1])
    assert [(a, b) for a, b in wanted if a not in got or got.get(a) != got.get(b)] == []


def test_passages_of_frequent_keys(spark, monkeypatch):
    """Two texts that are in one class by a third still get their own common passage, whether its keys count as large or not."""
    r = np.random.default_rng(5)
    prose = lambda n: [f"w{x}" for x in r.integers(0, 10**9, n)]
    docs, wanted = [], []
    for _ in range(4):
        one, two, three = prose(80), prose(80), prose(90)
        docs += [prose(40) + three[:45] + prose(40) for _ in range(5)] + [prose(40) + three[45:] + prose(40) for _ in range(5)]
        docs += [prose(20) + one + prose(60) + two + prose(20), prose(30) + one + prose(60) + three + prose(30), prose(40) + two + prose(60) + three + prose(40)]
        wanted += [(len(docs) - 2, 170, 260), (len(docs) - 1, 180, 270)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    for few in (33, 0):
        monkeypatch.setattr(passages, "FEW", few)
        got = {(x.doc_id, x.start_word, x.end_word): x.class_id for x in passages.near_passages(df).collect()}
        assert [x for x in wanted if x not in got] == [] and all(got[x] == x[0] // 13 * 13 + 10 for x in wanted)


def test_share():
    """Intervals of one function or without a common start are too little; pairs of one class whose places are covered are done."""
    held = lambda rows: np.array(sorted(rows), passages.HELD)
    a = held([(1, 0, 5, 0, 9, True), (2, 1, 7, 5, 12, True), (3, 2, 9, 9, 20, True), (4, 3, 40, 30, 45, True)])
    assert passages._share(a, a, 3, True) and not passages._share(a, a, 4, True) and not passages._share(a, a, 3, False)
    b = a.copy()
    b["covered"][3] = False
    assert passages._share(a, b, 3, False) and not passages._share(a, b[:2], 3, True)


def test_passages_behind_pieces(spark):
    """A passage that two texts share, where parts of it stand in sixty texts of smaller ids."""
    r = np.random.default_rng(3)
    prose = lambda n: [f"w{x}" for x in r.integers(0, 10**9, n)]
    passage = prose(60)
    docs = [prose(30) + passage[(a := int(r.integers(0, 26))) : a + 35] + prose(30) for _ in range(60)] + [prose(50) + passage + prose(50) for _ in range(2)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = {x.doc_id: (x.start_word, x.end_word, x.class_id) for x in passages.near_passages(df).collect()}
    assert set(got) == {60, 61} and all(50 <= a + 1 and b <= 111 and b - a >= 60 and c == 60 for a, b, c in got.values())


def test_passages_recall(spark):
    """Near copies of 0.8 and more among other texts: nine tenths of all pairs are found, and nothing that is not one."""
    r = np.random.default_rng(8)
    prose = lambda n: [f"w{x}" for x in r.integers(0, 3000, n)]
    docs, pairs = [], []
    for _ in range(120):
        passage = prose(int(r.integers(55, 200)))
        other = list(passage)
        for at in r.choice(len(other), len(other) // 60, replace=False):
            other[at] = f"z{at}"
        pairs.append((len(docs), len(docs) + 1))
        docs += [prose(40) + passage + prose(20), prose(10) + other + prose(70)]
    docs += [prose(150) for _ in range(50)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in passages.near_passages(df).collect()}
    found = sum(a in got and got.get(a) == got.get(b) for a, b in pairs)
    assert found >= 0.9 * len(pairs) and set(got) <= {i for p in pairs for i in p}


def test_passages_repetitive(spark):
    """Texts that repeat few words over and over are found and do not hang."""
    docs = [(1, "a b " * 60), (2, "x y z " + "a b " * 60), (3, "the " * 30000), (4, "The " * 200), (5, "q " * 10), (None, "a b " * 60), (5, "the " * 300 + "end"), (6, None), (7, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = passages.near_passages(df).collect()
    assert {(x.doc_id, x.class_id) for x in rows} >= {(1, 1), (None, 1), (3, 3), (4, 3), (5, 3)}


def test_inserted_sentence():
    """49 words, 13 of another sentence, 49 words: 90 of 111 shingles are common."""
    r = np.random.default_rng(1)
    w = r.integers(0, 2**63, 98).astype(np.uint64)
    other = np.concatenate([w[:49], r.integers(0, 2**63, 13).astype(np.uint64), w[49:]])
    shingle = lambda x: passages.shingle_hashes(x, 5)
    assert passages.matches(shingle(w), shingle(other), 46) == [(0, 94, 0, 107)]


def test_agreeing(spark):
    r = np.random.default_rng(6)
    rows = [(int(a), int(b), int(t), int(lo), int(lo + n)) for a, b, t, lo, n in zip(r.integers(0, 4, 300), r.integers(4, 9, 300), r.integers(0, 8, 300), r.integers(0, 60, 300) * 10, r.integers(0, 10, 300), strict=True)]
    rows = list({(a, b, t, lo): (a, b, t, lo, hi) for a, b, t, lo, hi in rows}.values())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    got = {(x.a, x.b) for x in passages.agreeing(spark.createDataFrame(rows + rows[:40], "a long, b long, t int, lo long, hi long"), 3).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(a, b) for a, b, _, lo, _ in rows if sum((a, b) == (c, d) and x <= lo <= y for c, d, _, x, y in rows) >= 3}
    assert got == want


def test_compact_windows():
    h = np.random.default_rng(0).permutation(200).astype(np.uint64)
    c, a, b = passages.windows(h, 20)
    want = {int(x + h[x : x + 20].argmin()) for x in range(181)}
    assert want <= set(c.tolist()) and len(c) < 40
    assert all(h[x : y + 1].min() == h[n] and x <= n <= y and y - x >= 19 for n, x, y in zip(c, a, b, strict=True))
    n, _, _ = passages.windows(np.zeros(100_000, np.uint64), 46)
    assert len(n) > 1000


# --- 8 ---


def plain_spans(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m.group())
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub(r"\D", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_base_patterns(sf_dir):
    cases = ["a@b.co@d.com x@y a@b-.c é@x.yz", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 1.2.3", "4111 1111 1111 1111-4111 +1 (017) 555-7713 +12 4111111111111111", "a@b..c .@a.b", "+1" * 9, "9" * 300]
    r = np.random.default_rng(3)
    cases += ["".join(r.choice(list("ab1290.@+-( )%"), 60)) for _ in range(400)]
    cases += [t or "" for _, t in documents(sf_dir)]
    for text in cases:
        assert pii.base_spans(text) == plain_spans(text)


def test_field_on_held_out_rows():
    tagger = pii.Tagger(pii._trained(pii.labelled_examples()))
    right = total = 0
    for words, tags in pii.labelled_examples.__wrapped__(200, 99):
        got = dict(tagger.tag([[w.encode() for w in words]])[0])
        right += sum(pii.TAGS[got.get(i, 0)] == t for i, t in enumerate(tags))
        total += len(tags)
    assert right / total > 0.98


def test_field_on_documents():
    """Secrets of the documents are found, and next to nothing else is added."""
    secret = re.compile(r'(?i)token = "([0-9a-f]{40})"')
    tagger = pii.Tagger(pii._trained(pii.labelled_examples()))
    texts = [t or "" for _, t in documents("/root/testdata/sf0.1")]
    wanted = found = other = 0
    for text, hits in zip(texts, tagger.tag([t.encode().split() for t in texts]), strict=True):
        want = {m.span(1) for m in secret.finditer(text)}
        got = {(a, b) for a, _, b in pii.field_spans(text, hits, pii.base_spans(text))}
        wanted, found, other = wanted + len(want), found + len(want & got), other + len(got - want)
    assert wanted > 100 and found >= 0.95 * wanted and other <= 0.05 * wanted


def test_personal_data_query(spark, sf_dir):
    """Counts, digest and spans of the query; base spans by plain patterns, all spans hold them."""
    text = dict(documents(sf_dir))
    for r in QUERIES["op8_personal_data"](spark, sf_dir).collect():
        base = plain_spans(text[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        names = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert set(names) <= {":".join(x) for x in spans} and spans == sorted(spans, key=lambda x: (int(x[1]), pii.KINDS.index(x[0])))


def test_bpe_query(spark, sf_dir):
    import tiktoken

    path, pattern = bpe.tokenizer_files()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in bpe.read_vocabulary(path).tokens.items()}, special_tokens={})
    text = dict(documents(sf_dir))
    for r in QUERIES["op9_byte_bpe"](spark, sf_dir).collect():
        ids = np.array(library.encode_ordinary(text[r.doc_id] or ""), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest())


def test_personal_data_awkward(spark, awkward, empty):
    rows = pii.find_personal_data(awkward, pii.labelled_table(spark)).collect()
    assert len(rows) == len(AWKWARD) and all(r.base_spans == [] for r in rows)
    assert pii.find_personal_data(empty, pii.labelled_table(spark)).isEmpty()
    one = spark.createDataFrame([("é token = \"0123456789abcdef0123\" at a@b.co",)], "text string")
    r = pii.find_personal_data(one, pii.labelled_table(spark)).first()
    assert [(s["kind"], s["start"], s["end"]) for s in r.all_spans] == [("secret", 11, 31), ("email", 36, 42)]


def test_field_sees_long_words_whole(spark):
    head, code = '{"a":"' + "b," * 250 + '","token":"', "0123456789abcdef0123"
    df = spark.createDataFrame([(f"foo {head}{code}\"}} bar",)], "text string")
    (span,) = pii.find_personal_data(df, pii.labelled_table(spark)).first().all_spans
    assert span["kind"] == "secret" and span["start"] <= 4 + len(head) and span["end"] >= 4 + len(head) + len(code)
    for n in (10, 500):
        assert pii.features(b"(" * n + b"a=" + code.encode())[2:] == pii.features(b"a=" + code.encode())[2:]


# --- 9 ---


def test_bpe_against_library(spark, sf_dir, awkward, empty):
    import tiktoken

    path, pattern = bpe.tokenizer_files()
    ranks = {t: i for i, t in bpe.read_vocabulary(path).tokens.items()}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    docs = awkward.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    docs = docs.unionByName(spark.createDataFrame([(1, "日本語 🎈 <|endoftext|> it's  \n\n x"), (2, "ab" * 20000)], "doc_id long, text string"))
    for r in bpe.decode(bpe.encode(docs, path, pattern), path).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == bytes(r.text_bytes) == (r.text or "").encode() and r.n_tokens * 4 == len(r.ids)
    assert bpe.encode(empty, path, pattern).isEmpty()


def test_workers_remember_little():
    """What a worker remembers is bounded, as tasks share an executor's memory; forgetting changes nothing."""
    packed = bpe.Packed(SimpleNamespace(encode_piece=lambda piece: [len(piece), piece[-1]]))
    want = {p: np.array([len(p), ord(p[-1])], "<u4").tobytes() for p in (f"p{i}" for i in range(450_000))}
    assert all(packed[p] == x for p, x in want.items()) and len(packed) + len(packed.old) <= 400_000
    assert packed["p0"] == want["p0"] and packed["p449999"] == want["p449999"]
    words, seen = [b"w%d" % i for i in range(300_000)], WordHash()
    assert (word_hashes(words, seen) == word_hashes(words[::-1], WordHash())[::-1]).all() and len(seen) <= 250_000
    assert list(trimmed(iter)([1, 2])) == [1, 2]


def test_bpe_returns_only_what_is_kept(spark, awkward):
    """Texts and decoded bytes that nobody asks for do not come back from the workers; the ids are the same."""
    files = bpe.tokenizer_files()
    slim = bpe.encode(awkward, *files, keep=["doc_id"], decoded=False)
    assert slim.columns == ["doc_id", "n_tokens", "ids"]
    want = bpe.encode(awkward, *files)
    assert want.columns == [*awkward.columns, "n_tokens", "ids", "decoded"]
    rows = lambda df: sorted(map(repr, df.select("doc_id", "n_tokens", "ids").collect()))
    assert rows(slim) == rows(want)


def test_small_batches(spark):
    """Workers get few rows at once in what runs meanwhile; the session's setting is as before then, after a failure too."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, df = spark.conf.get(name), spark.range(0, 5000, 1, 1)
    most = lambda: df.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [len(b)]}) for b in batches), "n long").agg(F.max("n")).first()[0]
    with small_batches(spark):
        assert most() == 2000
    with pytest.raises(ZeroDivisionError), small_batches(spark, 10):
        assert 1 // 0
    assert spark.conf.get(name) == before and most() == 5000


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(3000)]
    h = bpe.PerfectHash(keys, list(range(3000)))
    assert sorted(h.keys) == sorted(keys) and all(h.get(k) == i for i, k in enumerate(keys)) and h.get(b"none") == -1


# --- 10 ---


def brute_removal(docs, length):
    data, where = {i: (t or "").encode() for i, t in docs}, defaultdict(set)
    for i, b in data.items():
        for p in range(len(b) - length + 1):
            where[b[p : p + length]].add((i, p))
    gone = {i: bytearray(len(b)) for i, b in data.items()}
    for own in where.values():
        if len(own) > 1:
            for i, p in own:
                gone[i][p : p + length] = b"\1" * length
    out = {}
    for i, b in data.items():
        g = gone[i]
        out[i] = (len(b), sum(g), sum(g[j] and not (j and g[j - 1]) for j in range(len(g))), hashlib.sha256(bytes(x for x, y in zip(b, g, strict=True) if not y)).hexdigest())
    return out


def removed(df, length):
    rows = substrings.remove_repeats(df, length=length, outputs=lambda kept: [F.sha2(kept, 256).alias("k")]).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.k) for r in rows if r.doc_id is not None}


@pytest.mark.parametrize("length", [20, 45])
def test_removal_small(spark, length):
    r = np.random.default_rng(length)
    base = ["".join(r.choice(list("ab cdé"), 200)) for _ in range(4)]
    docs = [(i, "".join(r.choice(list("xyz q"), int(r.integers(30)))) + base[i % 4][(a := int(r.integers(150))) : a + int(r.integers(70))] + ["", "a" * 60, "ab" * 30, base[i % 3][3:90]][int(r.integers(4))]) for i in range(70)]
    assert removed(spark.createDataFrame(docs, "doc_id long, text string"), length) == brute_removal(docs, length)


def test_removal_documents(spark, sf_dir, awkward, empty):
    assert removed(spark.read.parquet(f"{sf_dir}/documents.parquet"), 400) == brute_removal(documents(sf_dir), 400)
    rows = substrings.remove_repeats(awkward, outputs=lambda kept: [F.sha2(kept, 256).alias("k")]).collect()
    want = brute_removal(list(enumerate(t for _, t in AWKWARD)), 400)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.k) for r in rows) == sorted((str(i), *want[n]) for n, (i, _) in enumerate(AWKWARD))
    assert removed(empty, 400) == {}


def test_removal_of_structured_texts(spark):
    """Strings that double and complement themselves are not taken for each other; a very long repetitive text is."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    for length in (400, 1024):
        docs = [(1, "x" + word[: length + 100]), (2, "y" + other[: length + 100]), (3, "z" + word[:length]), (4, "ab" * 2000), (5, "q" * 3000 + "r")]
        assert removed(spark.createDataFrame(docs, "doc_id long, text string"), length) == brute_removal(docs, length)


# --- all together ---


def test_pipeline_near_duplicates(spark):
    """Five-word similarity from 0.8 up is a copy: 41/51 with one of 50 words changed, 180/220 with four of 204; 32/52 is none."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    w = [f"w{i}" for i in range(50)]
    long = [f"v{i}" for i in range(204)]
    docs = [(1, w), (2, w[:25] + ["z"] + w[26:]), (3, long), (4, [f"{x}y" if i in (40, 80, 120, 160) else x for i, x in enumerate(long)]), (5, [f"u{i}" for i in range(46)]), (6, [f"u{i}y" if i in (15, 30) else f"u{i}" for i in range(46)])]
    texts = [(i, " ".join(x)) for i, x in docs]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(texts, "doc_id long, text string"), "")
    want = {c for _, c in brute_components(texts, 5, 80, 100).values()}
    assert want == {1, 3, 5, 6} and {r.doc_id for r in got.collect()} == want


def test_pipeline_awkward(spark, sf_dir):
    """Empty tables, null columns, and rows that share an id go through every stage."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).isEmpty()
    text = lambda r, n: " ".join(f"w{x}" for x in r.integers(0, 10**6, n))
    r = np.random.default_rng(4)
    a, b, c = text(r, 60), text(r, 60), text(r, 60)
    rows = [(3, a), (3, b), (None, c), (None, a), (2, c), (None, None), (None, ""), (3, a), (9, None)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], docs.schema)
    kept = sorted((str(x.doc_id), str(x.text)) for x in corpus_pipeline.near_duplicates(spark, df, sf_dir).collect())
    assert kept == sorted([("3", a), ("3", b), ("2", c), ("None", "None"), ("None", ""), ("9", "None")])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, sf_dir).count() <= 2 * len(rows)


def test_pipeline_against_brute_force(spark, sf_dir):
    """Each stage against a plain version of it, on what the stage before kept."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import tiktoken

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, spark.createDataFrame(steps[-1], docs.schema), sf_dir)
        steps.append(frame.collect())
    start, good, cut, single, mixed, out = steps
    kept = {r.doc_id for r in quality.assess(docs).filter("kept").collect()}
    assert {r.doc_id for r in good} == kept
    seen, texts = set(), {}
    for r in sorted(good, key=lambda r: r.doc_id):
        ls, gone = r.text.split("\n"), set()
        for i in range(len(ls) - 2):
            w = tuple(ls[i : i + 3])
            if "".join(w).encode().split():
                if w in seen:
                    gone |= {i, i + 1, i + 2}
                seen.add(w)
        text = "\n".join(x for i, x in enumerate(ls) if i not in gone)
        if text.encode().split():
            texts[r.doc_id] = text
    assert {r.doc_id: r.text for r in cut} == texts
    assert {r.doc_id for r in single} == {c for _, c in brute_components(list(texts.items()), 5, 80, 100).values()}
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in single}
    # the mix itself is held against SQL; here, what it says of each document takes effect
    times = {r.doc_id: r.times for r in mixing.mix(spark.createDataFrame(single, docs.schema)).collect()}
    counted = defaultdict(int)
    for r in mixed:
        counted[r.doc_id] += 1
    assert {i: n for i, n in times.items() if n} == counted
    size = lambda rows: sum(len(r.text.encode().split()) for r in rows)
    assert abs(size(mixed) - 1.5 * size(single)) < 0.2 * size(single)
    path, pattern = bpe.tokenizer_files()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in bpe.read_vocabulary(path).tokens.items()}, special_tokens={})
    by = {r.doc_id: r.text for r in mixed}
    assert len(out) == len(mixed) and all(np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(by[r.doc_id]) for r in out)
