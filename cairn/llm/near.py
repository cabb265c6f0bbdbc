"""Near-duplicate documents by Order MinHash.

Shingles are five words (a shorter text is one shingle). Equal shingles of a text are told apart by their occurrence
number, so a text is a sequence of different symbols. Each of BANDS sketches hashes the symbols anew, takes the TAKEN
least, and hashes them in text order, so texts meet in a bucket only if the same symbols stand in the same order:
the chance is about s^4 for similarity s, and of two texts at 0.8 all 24 sketches differ once in 300,000 pairs. As the
least symbols are different ones, the chance is lower for texts of few symbols (C(4,4) / C(5,4) for 4 against 5 symbols,
which 24 sketches miss in 0.5 % of pairs), so texts of up to SHORT symbols have SHORT_BANDS further sketches of their two
least symbols; then all differ once in ten million pairs, or seldomer.

Candidates are verified by banded alignment: the longest common subsequence L of the two symbol sequences, sought only
within the band of places that a similarity of 0.8 allows, must have L / (n + m - L) >= 0.8. As symbols are unique in
a text, that alignment is a longest increasing run of places.

Equal texts share one node from the start. In a bucket, members are compared with a pivot (the member with most
bucket mates), in two rounds. In buckets that still hold several components, texts of different components are then
compared outright: pair by pair in buckets of up to SMALL_BUCKET members, and in larger ones by chunks of members,
bounded in rows and bytes, with exact overlaps from matrix products inside a task. So two texts of a bucket end up in one class or have been compared,
no bucket is capped, and no row is made for each pair of a large group.

Defined cases: null text is the empty text; texts without words are near only to equal texts; of a class the least
doc_id (null last, then the text's hash) stays; repeated rows are one class, of which one row stays; other columns are
ignored (classes) or kept as they are, whatever their names (deduplicated).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import joined_spread, map_documents, narrow, numbered, read_table, stored, text_or_empty
from cairn.llm.components import components

WORDS = 5
BANDS = 24
TAKEN = 4
PIVOT_ROUNDS = 2
GROUP_BYTES = 1_000_000
SMALL_BUCKET = 16
CHUNK = 512
CHUNK_BYTES = 4_000_000
SLICE = 8192
SHORT = 24
SHORT_BANDS = 12
SHORT_TAKEN = 2

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE_FACTORS = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SEEDS = _rng.integers(1, 1 << 63, BANDS + SHORT_BANDS, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _grown(which: int, base: int, n: int) -> np.ndarray:
    have = _powers[which]
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[which] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    h = h ^ h >> np.uint64(30)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled shingle hashes of all texts, in text order, and each text's first index (one more at the end)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8) if raw else np.zeros(0, dtype=np.uint8)
    n = len(data)
    white = (data == 32) | (data >= 9) & (data <= 13)
    edge = np.diff(np.concatenate([[1], white.astype(np.int8)]))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = ends[: len(starts)]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * _grown(0, BASE, n), out=sums[1:])
    words = mixed((sums[ends] - sums[starts]) * _grown(1, pow(BASE, -1, 1 << 64), n)[starts])
    doc_starts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)])
    first = np.searchsorted(starts, doc_starts)  # the first word of each text
    counts = np.diff(first)
    shingle_counts = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(shingle_counts)])
    doc_of = np.repeat(np.arange(len(raw)), shingle_counts)
    at = np.arange(bounds[-1]) - bounds[doc_of] + first[doc_of]
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(WORDS):
        inside = at + k < first[doc_of + 1]
        h += np.where(inside, words[np.minimum(at + k, max(0, len(words) - 1))], np.uint64(k + 1)) * PLACE_FACTORS[k] if len(words) else 0
    h = mixed(h)
    order = np.lexsort((h, doc_of))
    sorted_h, sorted_doc = h[order], doc_of[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (sorted_h[1:] != sorted_h[:-1]) | (sorted_doc[1:] != sorted_doc[:-1])
    run = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    occurrence = np.empty(len(h), dtype=np.uint64)
    occurrence[order] = (np.arange(len(h)) - run).astype(np.uint64)  # lexsort is stable: in text order
    return mixed(h + occurrence * np.uint64(0xD6E8FEB86659FD93)), bounds


def sketches(h: np.ndarray, bounds: np.ndarray, bands: range = range(BANDS), taken: int = TAKEN) -> np.ndarray:
    """A hash for each of `bands` of each text with symbols: of its `taken` least symbols under that band's hash, in text order."""
    counts = np.diff(bounds)
    full = np.flatnonzero(counts)
    out = np.zeros((len(counts), len(bands)), dtype=np.uint64)
    if not len(full):
        return out
    at, sizes = bounds[full], counts[full]
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for column, b in enumerate(bands):
        v = mixed(h ^ SEEDS[b])
        chosen = np.zeros((len(full), taken), dtype=np.int64)
        for k in range(taken):
            least = np.minimum.reduceat(v, at)
            hit = np.flatnonzero(v == np.repeat(least, sizes))
            owner = np.searchsorted(at, hit, side="right") - 1
            chosen[owner[::-1], k] = hit[::-1]  # the first where several are used up
            v[hit] = top
        chosen.sort(axis=1)
        value = np.full(len(full), np.uint64(b + 1), dtype=np.uint64)
        for k in range(taken):
            value = mixed(value * np.uint64(0x9FB21C651E98DF25) + h[chosen[:, k]])
        out[full, column] = value
    return out


def buckets_of(texts: list[str]) -> list[np.ndarray]:
    """Each text's sketches: none without words; those of short texts have the further ones."""
    h, bounds = symbols(texts)
    counts = np.diff(bounds)
    found = sketches(h, bounds).view(np.int64)
    short = np.flatnonzero((counts > 0) & (counts <= SHORT))
    inside = np.repeat((counts > 0) & (counts <= SHORT), counts)
    more = sketches(h[inside], np.concatenate([[0], np.cumsum(counts[short])]), range(BANDS, BANDS + SHORT_BANDS), SHORT_TAKEN).view(np.int64)
    out = [found[k] if counts[k] else found[k, :0] for k in range(len(texts))]
    for row, k in enumerate(short.tolist()):
        out[k] = np.concatenate([out[k], more[row]])
    return out


def grouped(texts: list[str]):
    """Slices of `texts` of about GROUP_BYTES together."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > GROUP_BYTES:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """L / (n + m - L) for the banded alignment of two symbol sequences; 0 as soon as 0.8 is out of reach."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    order = np.argsort(b)
    found = np.minimum(np.searchsorted(b, a, sorter=order), m - 1)
    place = order[found]
    same = b[place] == a
    if 9 * int(same.sum()) < 4 * (n + m):
        return 0.0
    i, j = np.flatnonzero(same), place[same]
    band = n + m - 2 * -(-4 * (n + m) // 9)  # unmatched symbols that 0.8 leaves room for
    j = j[np.abs(i - j) <= band]
    if len(j) > 1 and not (np.diff(j) > 0).all():
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        common = len(tails)
    else:
        common = len(j)
    return common / (n + m - common)


def near(a: np.ndarray, b: np.ndarray) -> bool:
    s = similarity(a, b)
    return s >= 0.8


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, key (digest of the text) and buckets (one for each sketch; none without words), stored."""

    def run(columns):
        buckets: list[np.ndarray] = []
        for a, b in grouped(columns["text"]):
            buckets += buckets_of(columns["text"][a:b])
        return {"doc_id": columns["doc_id"], "key": [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in columns["text"]], "buckets": buckets}

    rows = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return stored(map_documents(rows, run, "doc_id long, key binary, buckets array<long>"), "sketches")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b: keys) whose texts are near, stored. A pair is one row, wherever it is dealt."""
    rows = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")

    def run(columns):
        out = {"a": [], "b": []}
        kept: dict[str, np.ndarray] = {}
        for ka, kb, ta, tb in zip(columns["a"], columns["b"], columns["ta"], columns["tb"], strict=True):
            for k, t in ((ka, ta), (kb, tb)):
                if k not in kept:
                    kept[k] = symbols([t])[0]
            if near(kept[ka], kept[kb]):
                out["a"].append(ka)
                out["b"].append(kb)
        return out

    return stored(map_documents(rows.select("a", "b", "ta", "tb"), run, "a binary, b binary", rows=128), "edges")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many symbols each text of `left` shares with each of `right`: matrix products over slices of the shared symbols."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.uint64) for x in (left, right))
    common = np.intersect1d(a, b)
    places = []
    for values, texts in ((a, left), (b, right)):
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        kept = np.isin(values, common)
        column = np.searchsorted(common, values[kept])
        order = np.argsort(column)
        places.append((row[kept][order], column[order]))
    for low in range(0, len(common), SLICE):
        sides = []
        for (row, column), texts in zip(places, (left, right), strict=True):
            i, j = np.searchsorted(column, [low, low + SLICE])
            side = np.zeros((len(texts), min(SLICE, len(common) - low)), dtype=np.float32)
            side[row[i:j], column[i:j] - low] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def chunk_links(rows: list[dict], others: list[dict], same: bool) -> list[tuple[bytes, bytes]]:
    """Near pairs (keys) of the texts of two chunks, or inside one, that link labels which no earlier pair has linked.

    Inside one chunk `others` must be `rows` itself: the two sides of a join may gather a chunk in different orders.
    """
    left = [symbols([r["text"]])[0] for r in rows]
    right = left if same else [symbols([r["text"]])[0] for r in others]
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    met: dict[bytes, bytes] = {}

    def root(x):
        while met.setdefault(x, x) != x:
            met[x] = met[met[x]]
            x = met[x]
        return x

    found = []
    close = [(rows[i]["key"], others[j]["key"], i, j) for i, j in np.argwhere(9 * overlaps(left, right) >= 4 * sizes).tolist() if not same or i < j]
    for low, high, i, j in sorted((min(x, y), max(x, y), i, j) for x, y, i, j in close):
        a, b = root(rows[i]["label"]), root(others[j]["label"])
        if a != b and near(left[i], right[j]):  # texts that are linked already need no further link
            met[max(a, b)] = min(a, b)
            found.append((low, high))
    return found


def near_in_blocks(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Near pairs (a, b) within the buckets of `members` (bucket, n, key, label) that link different labels, stored.

    A bucket's members are dealt to chunks of about CHUNK texts and CHUNK_BYTES; a row is two chunks. Exact overlaps of all their texts come
    from matrix products, and pairs that may be near are aligned, all inside the task, which gives a link only where it
    joins what other links of the row have not joined yet.
    """
    sized = stored(members.join(texts.select("key", F.octet_length("text").alias("bytes")), "key"), "sized")
    counts = sized.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("bytes") / CHUNK_BYTES)).alias("chunks"), F.count("*").alias("members"))
    counts = stored(counts, "chunks")
    dealt = joined_spread(sized.select("bucket", "key", "label"), counts, "bucket", "members").withColumn("chunk", F.pmod(F.xxhash64("key"), "chunks"))
    chunks = dealt.join(texts, "key").groupBy("bucket", "chunk").agg(F.max("chunks").alias("chunks"), F.collect_list(F.struct("key", "label", "text")).alias("rows"))
    left = chunks.withColumn("other", F.explode(F.sequence(F.col("chunk"), F.col("chunks") - 1)))
    right = chunks.select("bucket", F.col("chunk").alias("other"), F.col("rows").alias("others"))
    pairs = left.join(right, ["bucket", "other"]).select((F.col("chunk") == F.col("other")).alias("same"), "rows", "others")

    def run(columns):
        found = [link for same, rows, others in zip(columns["same"], columns["rows"], columns["others"], strict=True) for link in chunk_links(rows, rows if same else others, same)]
        return {"a": [a for a, _ in found], "b": [b for _, b in found]}

    return stored(map_documents(pairs, run, "a binary, b binary", rows=1).distinct(), "edges")


def joined_labels(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """`labels` (node, label) after more `edges` (a, b): components of the labels that the edges join, carried to their nodes."""
    if edges.isEmpty():
        return edges.sparkSession.createDataFrame([], "node binary, label binary") if labels is None else labels
    if labels is None:
        return components(edges)
    ends = edges
    for end in ("a", "b"):
        known = labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))
        ends = ends.join(known, end, "left").withColumn(end, F.coalesce(f"l{end}", end)).drop(f"l{end}")
    ends = stored(ends.where("a <> b").distinct(), "joins")
    if ends.isEmpty():
        return labels
    merged = components(ends)
    old = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("now")), "label", "left").select("node", F.coalesce("now", "label").alias("label"))
    return stored(old.unionByName(merged.join(labels.select("node"), "node", "left_anti")), "labels")


def linked(docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """(node, label) for all texts that are near to another text: node is a text's key."""
    texts_once = sketch.where(F.size("buckets") > 0).groupBy("key").agg(F.first("buckets").alias("buckets"))
    entries = texts_once.select("key", F.explode("buckets").alias("bucket"))
    shared = stored(entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")  # apart from joins, so that Spark can split them
    members = stored(entries.join(shared, "bucket"), "members")
    if members.isEmpty():
        return docs.sparkSession.createDataFrame([], "node binary, label binary")
    weights = stored(members.groupBy("key").agg(F.sum("n").alias("weight")), "weights")
    plain = narrow(docs, "doc_id", "text").select(F.expr("unhex(md5(cast(coalesce(cast(text AS string), '') AS binary)))").alias("key"), text_or_empty().alias("text"))
    once = plain.groupBy("key").agg(F.first("text").alias("text"))  # copies meet before the shuffle
    texts = stored(once.join(weights.select("key").hint("merge"), "key", "left_semi"), "texts")
    members = stored(members.join(weights, "key"), "members")
    compared = labels = None
    for turn in range(PIVOT_ROUNDS + 1):
        if labels is None:
            now = members.withColumn("label", F.col("key"))
        else:
            now = members.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
            now = stored(now, "members")
        split = now.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
        open_rows = now.join(split, "bucket") if labels is not None else now
        if turn < PIVOT_ROUNDS:
            free = open_rows if turn == 0 else open_rows.join(used, ["bucket", "key"], "left_anti")
            pivots = stored(free.groupBy("bucket").agg(F.max(F.struct("weight", "key", "label")).alias("p")).select("bucket", F.col("p.key").alias("pivot"), F.col("p.label").alias("pivot_label")), "pivots")
            used = pivots.select("bucket", F.col("pivot").alias("key"))
            pairs = open_rows.join(pivots, "bucket").where("label <> pivot_label").select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct()
        else:
            in_blocks = near_in_blocks(open_rows.where(F.col("n") > SMALL_BUCKET).select("bucket", "n", "key", "label"), texts)
            small = open_rows.where(F.col("n") <= SMALL_BUCKET)
            others = small.select("bucket", F.col("key").alias("y"), F.col("label").alias("y_label"))
            pairs = small.select("bucket", F.col("key").alias("x"), F.col("label").alias("x_label")).join(others, "bucket")
            pairs = pairs.where("x < y AND x_label <> y_label").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        compared = pairs if compared is None else compared.unionByName(pairs)
        found = verified(pairs, texts)
        if turn == PIVOT_ROUNDS:
            found = found.unionByName(in_blocks)
        labels = joined_labels(labels, found)
    return labels


def classes(docs: DataFrame, sketch: DataFrame | None = None) -> DataFrame:
    """doc_id, key, class_id (least doc_id of the class), class_size and stays (whether this document represents it)."""
    sketch = sketched(docs) if sketch is None else sketch
    labels = linked(docs, sketch).withColumnRenamed("node", "key")
    texts = sketch.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"), F.count("*").alias("copies"))
    texts = stored(texts.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")), "texts")
    found = texts.groupBy("label").agg(F.min("best").alias("best"), F.sum("copies").alias("class_size"), F.count("*").alias("members"))
    found = stored(found.select("label", F.col("best.doc_id").alias("class_id"), F.col("best.key").alias("best_key"), "class_size", "members"), "classes")
    of_text = stored(joined_spread(texts.select("key", "label", "copies"), found, "label", "members"), "classes")
    rows = joined_spread(sketch.select("doc_id", "key"), of_text, "key", "copies")
    return rows.select("doc_id", "key", "class_id", "class_size", F.expr("doc_id <=> class_id AND key = best_key").alias("stays"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that represent their classes, all columns unchanged; of repeated rows one."""
    sketch = sketched(docs)
    staying = classes(docs, sketch).where("stays").select(F.col("doc_id").alias("__id"), F.col("key").alias("__kept"))
    repeated = not sketch.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    plain, places, at = numbered(docs)
    keyed = plain.withColumn("__key", F.expr(f"unhex(md5(cast(coalesce(cast({at['text']} AS string), '') AS binary)))"))
    kept = keyed.join(staying.distinct(), (F.col("__key") == F.col("__kept")) & F.col(at["doc_id"]).eqNullSafe(F.col("__id")), "left_semi")
    return (kept.dropDuplicates([at["doc_id"], "__key"]) if repeated else kept).select(*places).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "stays")
