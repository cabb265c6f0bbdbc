"""Groups of spelling variants by symmetric deletion.

Every word emits hashed keys: itself, its distinct single deletions, and its single deletions with their places. Two
words are one replaced code point apart exactly where they share a deletion at one place, and one inserted or deleted
code point apart exactly where one is a deletion of the other; so an equi-join of the keys meets each such pair and
hardly any other, and no key's rows are paired with all others of a looser key. Each pair's words are then compared, so
two keys that hash alike change nothing. Forms are aggregated by word, and roots found by doubling the steps to them.

Keys are polynomial hashes modulo two primes from prefix sums, so a word of L code points costs L steps and emits
2 L + 1 rows of 17 bytes, never copies of itself.

Defined cases: null text has no words; a null doc_id counts as an empty one in `<doc_id>:<run>`; repeated rows count
each; other columns are ignored. Where two near words are as frequent the smaller in code-point order is the form.
Memory of a task: the different runs of a slice of texts (of one text, if longer), and the keys of CELLS code points.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import map_documents, narrow, read_table, slices, stored

LENGTH, TIMES, GREATER, TYPO = 5, 3, 2, 97
BLOCK_CHARS = 2_000_000
CELLS = 1 << 18
_RUN = re.compile("[a-zÀ-ÿ]+")
_GAP = re.compile("[^a-zÀ-ÿ]")
_PRIMES, _BASE = (2_147_483_647, 2_147_483_629), 1_000_003
SUB, OWN, DELETED = 0, 1, 2


def runs(text: bytes) -> Counter:
    """How often each lower-cased run occurs in a UTF-8 text; long texts go block by block."""
    lower, at, found = text.lower().decode(), 0, Counter()  # bytes.lower() changes A-Z only
    while at < len(lower):
        gap = _GAP.search(lower, at + BLOCK_CHARS)
        end = gap.start() if gap else len(lower)
        found.update(_RUN.findall(lower, at, end))
        at = end
    return found


def with_typos(found: Counter, doc_id, typo: int = TYPO) -> Counter:
    """The counts of `found` after the typing errors of document `doc_id`: runs whose hash `typo` divides lose a code point."""
    seed, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for run, n in found.items():
        h = zlib.crc32(run.encode(), seed)
        if h % typo == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def _met(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """An equi-join by sorting. Spark sizes rows that Python or an explode makes by those they come from, and Parquet by its
    compressed bytes, so left to itself it sends a table of many times its broadcast threshold through the driver."""
    return left.join(right.hint("merge"), on, how)


def words(docs: DataFrame, length: int = LENGTH, times: int = TIMES, typo: int = TYPO) -> DataFrame:
    """(id, word, n), stored: words of at least `length` code points that occur at least `times` times."""

    def count(columns):
        total = Counter()
        for doc_id, text in zip(columns["doc_id"], columns["text"], strict=True):
            if text is not None:
                total.update(with_typos(runs(text), doc_id, typo))
        kept = {w: n for w, n in total.items() if len(w) >= length}
        return {"word": list(kept), "n": list(kept.values())}

    rows = narrow(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    counted = map_documents(rows, count, "word string, n long", 100_000).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)
    return stored(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")


def _hashes(points: np.ndarray, prime: int):
    """Hash of each row of code points, and of the row without its i-th one for each i."""
    rows, size = points.shape
    p, base = np.uint64(prime), np.uint64(_BASE)
    ahead = np.zeros((size + 1, rows), dtype=np.uint64)  # of the first i
    behind = np.zeros((size + 1, rows), dtype=np.uint64)  # of those from i on
    power = np.ones(size + 1, dtype=np.uint64)
    columns = np.ascontiguousarray(points.T).astype(np.uint64) + np.uint64(1)
    for i in range(size):
        ahead[i + 1] = (ahead[i] * base + columns[i]) % p
        power[i + 1] = power[i] * base % p
    for i in range(size - 1, -1, -1):
        behind[i] = (columns[i] * power[size - 1 - i] + behind[i + 1]) % p
    without = (ahead[:-1] * power[size - 1 :: -1][:, None] + behind[1:]) % p
    return ahead[size], without.T


def keys(ids: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, id and kind of every key of words of one length, whose code points are the rows of `points`."""
    size = points.shape[1]
    (own, low), (own_b, low_b) = (_hashes(points, p) for p in _PRIMES)
    shift = np.uint64(31)
    own, low = own << shift | own_b, low << shift | low_b
    first = np.ones(points.shape, dtype=bool)
    first[:, 1:] = points[:, 1:] != points[:, :-1]  # a run of one letter has one deletion
    places = (np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    sub = (low + np.uint64(size)) * np.uint64(0xC2B2AE3D27D4EB4F) ^ places
    every = np.broadcast_to(ids[:, None], points.shape)
    found = ((sub.ravel(), every.ravel(), SUB), (own, ids, OWN), (low[first], every[first], DELETED))
    return np.concatenate([k for k, _, _ in found]).view(np.int64), np.concatenate([i for _, i, _ in found]), np.concatenate([np.full(len(i), kind, dtype=np.int8) for _, i, kind in found])


def emitted(vocabulary: DataFrame) -> DataFrame:
    """(key, id, kind) of every word."""
    import pyarrow as pa

    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("kind", pa.int8())])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 20_000):
                by: dict[int, list[int]] = {}
                texts = batch.column(1).to_pylist()
                for i, w in enumerate(texts):
                    by.setdefault(len(w), []).append(i)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for size, rows in by.items():
                    step = max(1, CELLS // size)
                    for k in range(0, len(rows), step):
                        own = rows[k : k + step]
                        points = np.frombuffer("".join(texts[i] for i in own).encode("utf-32-le"), dtype="<u4").reshape(len(own), size)
                        made = keys(ids[own], points)
                        for at in range(0, len(made[0]), CELLS):
                            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + CELLS]) for c in made], schema=schema)

    return vocabulary.select("id", "word").mapInArrow(run, "key long, id long, kind tinyint")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, word_a, word_b): each pair of words that exactly one code point sets apart, in one direction."""
    rows = emitted(vocabulary)
    left = rows.where(F.col("kind") != DELETED).select("key", F.col("id").alias("a"), F.col("kind").alias("kind_a"))
    right = rows.where(F.col("kind") != OWN).select("key", F.col("id").alias("b"), F.col("kind").alias("kind_b"))
    alike = (F.col("kind_a") == SUB) & (F.col("kind_b") == SUB) & (F.col("a") < F.col("b"))
    met = _met(left, right, "key").where(alike | ((F.col("kind_a") == OWN) & (F.col("kind_b") == DELETED) & (F.col("a") != F.col("b")))).select("a", "b").distinct()
    for side in ("a", "b"):
        met = _met(met, vocabulary.select(F.col("id").alias(side), F.col("word").alias(f"word_{side}"), F.col("n").alias(f"n_{side}")), side)
    return met.where(F.levenshtein("word_a", "word_b", 1) == 1)


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, form): the last id that forms lead to, or the id itself; each round doubles the steps."""
    now = stored(forms.select("id", F.coalesce("form", "id").alias("root")), "roots")
    while True:
        beyond = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        then = stored(_met(now, beyond, "root").select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        now = then.select("id", "root")
        if then.where("moved").isEmpty():
            return now


def groups(docs: DataFrame, length: int = LENGTH, times: int = TIMES, greater: int = GREATER, typo: int = TYPO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word; a form is the most frequent near word, if `greater` times as frequent."""
    vocabulary = words(docs, length, times, typo)
    pairs = near_pairs(vocabulary)
    sides = F.array(*(F.struct(F.col(a).alias("id"), F.col(f"n_{a}").alias("n"), F.struct((-F.col(f"n_{b}")).alias("less"), F.col(f"word_{b}").alias("word"), F.col(b).alias("id")).alias("near")) for a, b in ("ab", "ba")))
    near = pairs.select(F.explode(sides).alias("x")).select("x.*").groupBy("id").agg(F.count("*").alias("n_near"), F.min("near").alias("best"), F.first("n").alias("own"))
    good = -F.col("best.less") >= greater * F.col("own")
    near = near.select("id", "n_near", F.when(good, F.col("best.id")).alias("form"), F.when(good, F.col("best.word")).alias("form_word"), F.when(good, -F.col("best.less")).alias("form_n"))
    forms = stored(_met(vocabulary, near, "id", "left"), "forms")
    last = _met(roots(forms.select("id", "form")), vocabulary.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return _met(forms, last, "id").select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return groups(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, coalesce(doc_id::VARCHAR, '') AS doc, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
run AS (SELECT doc, run, count(*) AS n FROM (SELECT doc, unnest(regexp_extract_all(text, '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM d) GROUP BY doc, run),
steps AS (SELECT list(list_reduce(list_prepend(b, range(1, 9)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY b) AS step FROM (SELECT unnest(range(0, 256)) AS b)),
bytes AS (SELECT doc, run, n, flatten(list_transform(string_split(doc || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS b FROM run),
h AS (SELECT doc, run, n, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, step[xor(c, x) % 256 + 1]))) AS h FROM bytes, steps),
v AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
k AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS key FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
pair AS (SELECT a.word AS a, b.word AS b, b.n FROM k a JOIN k b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
  UNION SELECT v.word, k.word, k.n FROM v JOIN k ON k.key = v.word UNION SELECT k.word, v.word, v.n FROM v JOIN k ON k.key = v.word),
best AS (SELECT a, count(*) AS n_near, arg_min(b, (-n, b)) AS b, max(n) AS n FROM pair GROUP BY a),
form AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best.n >= 2 * v.n THEN b END AS form, CASE WHEN best.n >= 2 * v.n THEN best.n END AS form_n FROM v LEFT JOIN best ON best.a = v.word),
walk AS (SELECT word, word AS at FROM form UNION SELECT walk.word, form.form FROM walk JOIN form ON form.word = walk.at WHERE form.form IS NOT NULL)
SELECT form.word, form.form, walk.at AS root, form.n, form.n_near, form.form_n FROM form JOIN walk ON walk.word = form.word JOIN form f ON f.word = walk.at WHERE f.form IS NULL
"""
