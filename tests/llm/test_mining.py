"""Phrases, spelling variants and exact search against brute force and SQL."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from cairn.llm import phrases, spelling, topk

DOCS = "doc_id long, text string, lang string"


def compare_sql(spark, sf, query, sql, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    got = query(spark, sf)
    assert got.columns == names
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


@pytest.mark.parametrize("module,table", [(phrases, "documents"), (spelling, "documents"), (topk, "embeddings")])
def test_queries_equal_sql(spark, sf, module, table):
    compare_sql(spark, sf, module.query, module.ORACLE_SQL, table)


# phrases -------------------------------------------------------------------------------------------------------------


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_phrases(rows, support, longest, covered, most):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            lang_ = "und" if lang is None else lang
            totals[lang_] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts[lang_][tuple(words[i : i + m])] += 1
    out = set()
    for lang, f in counts.items():
        found = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        for p, a in candidates.items():
            if any(100 * b >= covered * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], start=1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def phrase_rows():
    rng = random.Random(3)
    common = ["the", "of", "New", "York", "É", "日本", "a b", "\U0001f642", "x\x1cy"]
    rows = []
    for i in range(120):
        words = [rng.choice(common if rng.random() < 0.8 else [f"w{rng.randint(0, 30)}"]) + rng.choice(["", "", "", ",", ".", "\n", "\r", "!!", "\t"]) for _ in range(rng.randint(0, 60))]
        rows.append((i, " ".join(words), rng.choice(["en", "en", "en", "", None])))
    rows += [(200, None, "en"), (201, "", None), (202, "new york " * 2000, "en"), (203, "\x00 é", "und"), (None, "new york, NEW york", "de")]
    return rows + [(204, "New York of the", "fr")] * 7


@pytest.mark.parametrize("support,longest,covered,most,buckets,block", [(3, 3, 50, 2000, 1 << 26, 1_000_000), (2, 4, 90, 15, 64, 50), (5, 2, 50, 10, 8, 7), (300, 3, 50, 50, 1 << 17, 1000)])
def test_phrases_by_brute_force(spark, support, longest, covered, most, buckets, block):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'z' AS TEXT", "1 AS n", "'p' AS phrase", "2 AS `a.b`").repartition(5)
    got = phrases.collocations(docs, support, longest, covered, most, buckets, block)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert set(map(tuple, got.collect())) == brute_phrases(rows, support, longest, covered, most)


def test_phrases_of_no_documents(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS), buckets=1 << 10).count() == 0
    with pytest.raises(ValueError):
        phrases.collocations(spark.createDataFrame([], DOCS), buckets=100)


def test_phrase_scores_are_exact_beyond_64_bits(spark):
    parts = [spark.createDataFrame([("en", w, n) for w, n in words], "lang string, phrase string, n long") for words in ([("a", 10**13 + 7), ("b", 10**13 + 9)], [("a b", 10**13 - 1)])]
    r = phrases.scored(parts).first()
    assert (r.a, r.score) == (10**13 - 1, 1_000_000 * (10**13 - 1) ** 2 // ((10**13 + 7) * (10**13 + 9)))


# spelling variants ---------------------------------------------------------------------------------------------------


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(rows, length, times, greater, typo):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= length and c >= times}
    found, forms = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best is not None and n[best] >= greater * n[w] else None
        found[w] = len(others)
    out = set()
    for w in n:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.add((w, forms[w], root, n[w], found[w], n[forms[w]] if forms[w] is not None else None))
    return out


def spelling_rows():
    rng = random.Random(8)
    stems = ["colour", "aaaaa", "aabaa", "élève", "straße", "Übung", "×letter÷", "y" * 300]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 30)):
            w = rng.choice(stems)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randint(0, len(w) - 1)
                w = w[:at] + rng.choice(["", "a", "b", "é", w[at] + w[at], "Y"]) + w[at + 1 :]
            words.append(w)
        rows.append((i, rng.choice([" ", "-", "\n", "1"]).join(words), "en"))
    rows += [(200, None, "en"), (201, "", None), (202, "COLOUR colour " * 3000, "en"), (None, "colour colours colours colours", "en"), (203, "q" * 100_000 + " " + "q" * 100_001, "en")]
    return rows + [(204, "q" * 100_000 + " colr", "de")] * 3 + [(205, "q" * 100_001, "de")] * 9


@pytest.mark.parametrize("length,times,greater,typo", [(5, 3, 2, 97), (5, 3, 2, 5), (1, 1, 1, 3), (3, 2, 3, 2)])
def test_groups_by_brute_force(spark, length, times, greater, typo):
    rows = spelling_rows() if greater > 1 else [r for r in spelling_rows() if r[0] is not None and r[0] < 12]
    greater = max(greater, 2)
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'z' AS TEXT", "'w' AS word", "1 AS id", "2 AS `a.b`").repartition(4)
    got = spelling.groups(docs, length, times, greater, typo)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert set(map(tuple, got.collect())) == brute_groups(rows, length, times, greater, typo)


def test_groups_of_no_documents(spark):
    assert spelling.groups(spark.createDataFrame([], DOCS)).count() == 0


def test_runs_of_long_texts_go_block_by_block(monkeypatch):
    text = "ab cd, " * 1000 + "Üb" * 50 + " ab"
    want = spelling.runs(text.encode())
    monkeypatch.setattr(spelling, "BLOCK_CHARS", 11)
    assert spelling.runs(text.encode()) == want == Counter(re.findall("[A-Za-zÀ-ÿ]+", text))


def test_keys_meet_exactly_near_words():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("aab") for _ in range(rng.randint(1, 6))) for _ in range(120)})
    by = defaultdict(set)
    for i, w in enumerate(words):
        points = np.frombuffer(w.encode("utf-32-le"), dtype="<u4").reshape(1, -1)
        for key, _, kind in zip(*spelling.keys(np.array([i]), points), strict=True):
            by[int(key)].add((i, int(kind)))
    met = {frozenset((a, b)) for own in by.values() for a, x in own for b, y in own if a != b and ({x, y} == {spelling.SUB} or {x, y} == {spelling.OWN, spelling.DELETED})}
    assert met == {frozenset((i, j)) for i in range(len(words)) for j in range(i) if near(words[i], words[j])}


# exact search --------------------------------------------------------------------------------------------------------


def brute_search(rows, k, every, scale):
    known = set()
    for vec_id, vec in rows:
        if vec_id is not None and vec is not None and all(x is not None and np.isfinite(x) for x in vec):
            known.add((vec_id, tuple(int(np.floor(scale * float(x))) for x in vec)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = Counter()
    for q, v in known:
        if q % every == 0:
            best = sorted((-dot(v, w), c) for c, w in known if (c, w) != (q, v))[:k]
            out.update((q, r, c, -s) for r, (s, c) in enumerate(best, start=1))
    return out


def vector_rows(seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 6))
    rows = [(i, (centres[rng.integers(0, 5)] + rng.normal(size=6) * rng.choice([0.01, 0.3])).tolist()) for i in range(-40, 300)]
    rows += [(1000 + i, [0.5] * 6) for i in range(90)]  # copies, of which some are queries
    rows += [(7, [0.5] * 6), (40, [0.5] * 6), (40, [1.0, 2.0]), (60, []), (61, [0.0] * 6), (80, [9.0] * 9), (81, [2000.0, -3000.0])]
    rows += [(100, None), (None, [1.0] * 6), (120, [1.0, None]), (121, [float("nan")] * 6), (140, [float("inf")] * 6), (160, [-float("inf")])]
    return rows + rows[:30]


@pytest.mark.parametrize("k,every,pivots,most", [(20, 20, 16, 2048), (3, 7, 2, 30), (1, 1, 1, 8), (500, 50, 4, 64)])
def test_search_by_brute_force(spark, monkeypatch, k, every, pivots, most):
    monkeypatch.setattr(topk, "BLOCK_ROWS", most)
    monkeypatch.setattr(topk, "PACK_ROWS", most // 2)
    monkeypatch.setattr(topk, "SUPER_ROWS", 3)
    rows = vector_rows(k)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS label", "'x' AS EMBEDDING", "2 AS id", "3 AS `a.b`").repartition(3)
    got = topk.search(table, k, every, 64, pivots)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute_search(rows, k, every, 64)


def test_search_of_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert topk.search(spark.createDataFrame([], kind)).count() == 0
    assert topk.search(spark.createDataFrame([(20, [1.0])], kind)).count() == 0
    assert topk.search(spark.createDataFrame([(1, [1.0]), (2, [2.0])], kind)).count() == 0
    assert sorted(map(tuple, topk.search(spark.createDataFrame([(0, [1.0]), (20, [-1.5]), (3, [0.0])], kind)).collect())) == [(0, 1, 3, 0), (0, 2, 20, -6144), (20, 1, 3, 0), (20, 2, 0, -6144)]


def test_candidates_are_evaluated_until_none_can_reach_the_kth():
    """The bound excludes most of a far group, and never a result."""
    rng = np.random.default_rng(4)
    c = np.concatenate([rng.integers(60, 70, (500, 8)), rng.integers(-70, -60, (500, 8))])
    q, pivots = c[:20], c[[0, 999]]
    far_q, far_c = topk.to_pivots(q, pivots).astype("f4"), topk.to_pivots(c, pivots).astype("f4")
    got = {i: list(zip((-s).tolist(), p.tolist(), strict=True)) for i, p, s in topk.best_in_bound_order(q, far_q, np.full(20, -np.inf), c, far_c, np.arange(1000), 10)}
    assert got == {i: sorted(zip((-(c @ q[i])).tolist(), range(1000), strict=True))[:10] for i in range(20)}
    lower = np.abs(far_q[:, None, :] - far_c[None, :, :]).max(2)
    bounds = topk.upper(lower, topk.squares(q), topk.squares(c), topk.error_of(far_q, far_c, topk.squares(q), topk.squares(c)))
    assert (bounds >= (c @ q.T).T).all() and (bounds[:, 500:] < 0).all()


def test_large_components_stay_exact():
    rng = np.random.default_rng(6)
    c = rng.integers(-(2**28), 2**28, (50, 4))
    q = c[:5]
    far = topk.to_pivots(c, c[:3]).astype("f4")
    for i, p, s in topk.best_in_bound_order(q, far[:5], np.full(5, -np.inf), c, far, np.arange(50), 7):
        want = sorted((-sum(int(x) * int(y) for x, y in zip(q[i], w, strict=True)), n) for n, w in enumerate(c))[:7]
        assert [(-int(x), int(n)) for x, n in zip(s, p, strict=True)] == want


def test_variants_send_no_table_to_all(spark):
    """Keys are many times the vocabulary that Spark sizes them by, so no join may go by a broadcast, however small Spark thinks it."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "planet planet planets plane network networks") for i in range(4)], "doc_id long, text string")
    vocabulary = spelling.words(docs)
    for df in (spelling.near_pairs(vocabulary), spelling.roots(vocabulary.select("id", F.lit(None).cast("long").alias("form"))), spelling.groups(docs)):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
