"""Collocated phrases by hashed buckets (PCY/DHP) and Apriori pruning.

Pass m reads the texts once. It counts phrases of m words exactly, as far as they can be frequent, and at the same time
counts all phrases of m + 1 words whose parts can be frequent in hashed buckets. A bucket below the support rules out
every phrase in it, so the next pass counts exactly only what lies in full buckets and whose two parts of m words are
frequent themselves. Buckets and frequent phrases go to the tasks as bitmaps of `buckets` bits each: at most 2 * longest
of them, so what is broadcast has a fixed size whatever the corpus holds. Where two phrases share a bit, some are counted
in vain; results never depend on it. A corpus far beyond `buckets` different phrases wants more bits to prune well.

A task adds up its counts, in buckets cut at the support (a sum that reaches it stays one); ranges of buckets are packed
in a row each, and counts of phrases added again before their shuffle, so a frequent word or passage is one row a task. Scores compare by whole numbers of up to 38 digits.

Defined cases: null text is the empty text, null lang is "und", repeated rows count each, other columns are ignored;
phrases of equal score and count come in byte order. Memory of a task: the counters of the buckets (a byte each),
MOST_WORDS different words and the tokens of BLOCK_BYTES of text; a longer text goes block by block. AQE splits the joins of
phrases with their parts where a part is in very many.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cairn.llm.common import discard, narrow, read_table, slices, stored

SUPPORT, LONGEST, COVERED, MOST = 10, 3, 50, 2000
BUCKETS = 1 << 26
BLOCK_BYTES, SLICE_BYTES = 1_000_000, 2_000_000
MOST_WORDS, MOST_LANGS = 200_000, 1000
RANGE = 1 << 16
SPREAD = 32
ROWS = "lang string, phrase string, bucket long, n long, cells binary, counts binary"

_BREAK = b"\xff"  # in no UTF-8 text
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 10 + b" ")


def blocks(texts: list[bytes], most: int = BLOCK_BYTES):
    """Lists of tokens of joined texts, each of about `most` bytes: lower-cased words, and _BREAK between pieces."""
    joined = _BREAK.join(texts).translate(_BYTES)
    at = 0
    while at < len(joined):
        end = at + most
        if end < len(joined):
            ends = [e for e in (joined.find(b" ", end), joined.find(_BREAK, end)) if e >= 0]
            end = min(ends, default=len(joined))
        yield joined[at:end].replace(_BREAK, b" \xff ").split()
        at = end


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Bits:
    """What earlier passes rule out: bitmaps of frequent phrases by number of words, and of full buckets of one more."""

    def __init__(self, frequent: dict[int, np.ndarray], full: np.ndarray | None):
        self.frequent, self.full = frequent, full


def _among(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class Vocabulary:
    """Numbers of the words of one slice in one language, from 1; 0 is a break; and hashes of words with that language."""

    def __init__(self, lang: str):
        import xxhash

        self.numbers: dict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[_BREAK]
        self.words: list[bytes] = []
        self.hashes = np.empty(0, dtype=np.uint64)
        self._digest, self._seed = xxhash.xxh64_intdigest, xxhash.xxh64_intdigest(lang.encode())

    def of(self, tokens: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.numbers.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        new = list(islice(self.numbers, len(self.words), None))
        self.words += new
        self.hashes = np.concatenate([self.hashes, np.fromiter((self._digest(w, self._seed) for w in new), dtype=np.uint64, count=len(new))])
        return found


def _survivors(ids: np.ndarray, hashes: np.ndarray, m: int, bits: Bits, mask: int):
    """Where phrases of m words that can be frequent begin, and the buckets of those phrases."""
    at = np.flatnonzero(ids != 0)
    h = hashes[ids[at]]
    for q in range(1, m + 1):
        if q > 1:  # both parts of q - 1 words are there: the next place, too, is in `at`
            follows = np.zeros(len(at), dtype=bool)
            follows[:-1] = at[1:] == at[:-1] + 1
            keep = np.flatnonzero(follows)
            at, h = at[keep], _mixed(h[keep] * np.uint64(3) + hashes[ids[at[keep] + q - 1]])
        known = bits.frequent.get(q) if q < m else bits.full if m > 1 else None
        if known is not None:
            keep = _among(known, (h & np.uint64(mask)).astype(np.int64))
            at, h = at[keep], h[keep]
    return at, h


def _longer(at: np.ndarray, h: np.ndarray, ids: np.ndarray, hashes: np.ndarray, m: int):
    """Phrases of m + 1 words both of whose parts of m words begin in `at`."""
    keep = np.flatnonzero(at[1:] == at[:-1] + 1)
    return at[keep], _mixed(h[keep] * np.uint64(3) + hashes[ids[at[keep] + m]])


def _grouped(ids: np.ndarray, at: np.ndarray, m: int, size: int):
    """One place of each different phrase of m words that begins in `at`, and how often it does."""
    code = ids[at]
    for k in range(1, m):
        code = np.unique(code, return_inverse=True)[1] * size + ids[at + k]
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    return first, n


def _pass(m: int, support: int, longest: int, buckets: int, shared, block: int):
    """The function of pass m over Arrow batches of lang and text (bytes).

    Its rows are exact counts of phrases of m words, with their bits, and for each range of buckets the cells of phrases
    of m + 1 words with their counts.
    """
    import pyarrow as pa

    schema, mask, size = to_arrow_schema(StructType.fromDDL(ROWS)), buckets - 1, min(RANGE, buckets)

    def counted(lang, phrases, bucket, n):
        k = len(n)
        columns = [pa.array([lang] * k, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(bucket, pa.int64()), pa.array(n, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def words_of(states):
        for lang, (known, n) in states.items():
            yield counted(lang, [b""], [-1], [int(n[1:].sum())])
            used = np.flatnonzero(n[1:]) + 1
            for k in range(0, len(used), 100_000):
                part = used[k : k + 100_000]
                yield counted(lang, [known.words[i] for i in part.tolist()], (known.hashes[part] & np.uint64(mask)).astype(np.int64), n[part])

    def run(batches):
        bits = Bits({}, None) if shared is None else shared.value
        filled = np.zeros(buckets if m < longest else 0, dtype=np.uint8 if support < 128 else np.uint32)
        states: dict[str, list] = {}
        for whole in batches:
            for piece in slices(whole, most=SLICE_BYTES):
                texts: dict[str, list[bytes]] = defaultdict(list)
                for lang, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    texts[lang].append(text)
                if sum(len(known.words) for known, _ in states.values()) > MOST_WORDS or len(states) > MOST_LANGS:
                    if m == 1:
                        yield from words_of(states)
                    states = {}
                for lang, own in texts.items():
                    known, total = states.setdefault(lang, [Vocabulary(lang), np.zeros(1, dtype=np.int64)])
                    before = np.empty(0, dtype=np.int64)
                    for tokens in blocks(own, block):
                        ids = np.concatenate([before, known.of(tokens)])
                        fresh = len(before)
                        at, h = _survivors(ids, known.hashes, m, bits, mask)
                        if m < longest:
                            up, up_h = _longer(at, h, ids, known.hashes, m)
                            full, n = np.unique((up_h[up + m >= fresh] & np.uint64(mask)).astype(np.int64), return_counts=True)
                            filled[full] = np.minimum(filled[full] + np.minimum(n, support), support)
                        if m == 1:
                            n = np.bincount(ids[fresh:], minlength=len(known.words))
                            n[: len(total)] += total
                            states[lang][1] = total = n
                        else:
                            new = at + m - 1 >= fresh
                            at, h = at[new], h[new]
                            if len(at):
                                first, n = _grouped(ids, at, m, len(known.words))
                                words, rows = known.words, [ids[at[first] + k].tolist() for k in range(m)]
                                yield counted(lang, [b" ".join([words[i] for i in row]) for row in zip(*rows, strict=True)], (h[first] & np.uint64(mask)).astype(np.int64), n)
                        before = ids[-m:]
        if m == 1:
            yield from words_of(states)
        for at in range(0, len(filled), size):
            cells = np.flatnonzero(filled[at : at + size])
            if len(cells):
                n = filled[at : at + size][cells].astype("<u4" if support >= 128 else np.uint8)
                columns = [pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.array([at // size], pa.int64()), pa.nulls(1, pa.int64()), pa.array([cells.astype("<u2").tobytes()]), pa.array([n.tobytes()])]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _full(rows: DataFrame, support: int, buckets: int) -> np.ndarray:
    """A bitmap of the buckets that the rows of ranges fill: each task adds up whole ranges, and sends a bit for each bucket."""
    import pyarrow as pa

    size = min(RANGE, buckets)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells, n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                own = sums.setdefault(part, np.zeros(size, dtype=np.uint16 if support < 128 else np.uint32))
                at = np.frombuffer(cells, dtype="<u2")
                own[at] = np.minimum(own[at] + np.frombuffer(n, dtype="<u4" if support >= 128 else np.uint8), support)
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int64()), "bits": pa.array([np.packbits(v >= support, bitorder="little").tobytes() for v in sums.values()], pa.binary())})

    found = np.zeros(buckets // 8, dtype=np.uint8)
    ranges = rows.where(F.col("phrase").isNull()).select(F.col("bucket").alias("part"), "cells", "counts").repartition("part")
    for r in ranges.mapInArrow(run, "part long, bits binary").toLocalIterator():
        found[r.part * (size // 8) : (r.part + 1) * (size // 8)] = np.frombuffer(r.bits, dtype=np.uint8)
    return found


def _bitmap(rows: DataFrame, buckets: int) -> np.ndarray:
    """The column bucket of `rows` as a bitmap; what comes to the driver is at most the bitmap."""
    own = F.col("bucket") + 1  # such positions start at 1
    parts = rows.groupBy(F.bitmap_bucket_number(own).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(own)).alias("bits"))
    found = np.zeros(max(buckets // 8, 4096), dtype=np.uint8)
    for r in parts.toLocalIterator():
        found[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(r.bits, dtype=np.uint8)
    return found


def frequent(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, buckets: int = BUCKETS, block: int = BLOCK_BYTES) -> list[DataFrame]:
    """Stored tables (lang, phrase, bucket, n) of phrases of 1, 2, ... `longest` words that occur `support` times or more, and first of all words' numbers by lang."""
    if buckets & (buckets - 1) or buckets < 8:
        raise ValueError("buckets must be a power of two, 8 or more")
    spark = docs.sparkSession
    rows = narrow(docs, "lang", "text").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    found, bits, full, shared = [], {}, None, None
    for m in range(1, longest + 1):
        if m > 1:
            shared = spark.sparkContext.broadcast(Bits(dict(bits), full))
        made = stored(rows.mapInArrow(_pass(m, support, longest, buckets, shared, block), ROWS), "phrases-pass")
        counted = made.where(F.col("phrase").isNotNull()).groupBy("lang", "phrase", "bucket").agg(F.sum("n").alias("n"))
        counted = stored(counted.where((F.col("n") >= support) | (F.col("phrase") == "")), f"phrases-{m}")
        if m == 1:
            found.append(counted.where(F.col("phrase") == ""))
        found.append(counted.where(F.col("phrase") != ""))
        if m < longest:
            bits[m], full = _bitmap(found[-1], buckets), _full(made, support, buckets)
        discard(made)
        if shared is not None:
            shared.unpersist()
    return found


def scored(parts: list[DataFrame]) -> DataFrame:
    """lang, phrase, words, a, score, k, l, r of each frequent phrase of two words or more, at the cut of lowest score."""
    counts = None
    for one in parts:
        one = one.select("lang", "phrase", F.col("n").alias("f"))
        counts = one if counts is None else counts.unionByName(one)
    whole = None
    for m, one in enumerate(parts[1:], start=2):
        one = one.select("lang", "phrase", F.lit(m).alias("words"), F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(m - 1))).alias("k"))
        one = one.select("*", *(F.expr(f"substring_index(phrase, ' ', {side})").alias(name) for name, side in (("first", "k"), ("rest", "k - words"))))
        whole = one if whole is None else whole.unionByName(one)
    for name, short in (("first", "l"), ("rest", "r")):
        whole = whole.join(counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(short)), ["lang", name])
    a, left, right = (f"cast({c} as decimal(14,0))" for c in ("a", "l", "r"))
    whole = whole.withColumn("score", F.expr(f"(cast(1000000 as decimal(7,0)) * ({a} * {a})) div ({left} * {right})"))
    best = whole.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.*")


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, covered: int = COVERED, most: int = MOST, buckets: int = BUCKETS, block: int = BLOCK_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `most` phrases.

    Dropped first are phrases that a longer frequent one holds and that are not over 100 / `covered` times as frequent.
    """
    totals, *parts = frequent(docs, support, longest, buckets, block)
    rows = stored(scored(parts), "phrases-scored")
    inner = None
    for m, one in enumerate(parts[2:], start=3):
        for q in range(2, m):  # phrases of q words inside those of m
            inside = [F.array_join(F.slice(F.split("phrase", " "), i, q), " ") for i in range(1, m + 2 - q)]
            held = one.select("lang", F.col("n").alias("longer"), F.explode(F.array(*inside)).alias("phrase"))
            inner = held if inner is None else inner.unionByName(held)
    if inner is not None:
        inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        rows = rows.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    spread = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)))  # no task ranks a whole language
    spread = spread.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    ranked = spread.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return ranked.join(totals.select("lang", "n"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM t)),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM i, (VALUES (1), (2), (3)) AS sizes(m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
cuts AS (SELECT c.lang, c.m, c.phrase, c.a, k, l.f AS l, r.f AS r, ((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) AS c JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ') JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE m = 3) GROUP BY lang, phrase),
kept AS (SELECT best.* FROM best LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
