"""Removal of byte strings that occur more than once in a corpus, by suffix order within content-defined groups.

A string of `length` bytes is repeated when it also starts elsewhere, in the same text or another; matches never cross
texts. The corpus has no suffix array of its own: every window of `length` bytes names its anchor, the place of the
least hash among its GRAM-byte grams, so equal windows have equal anchors and meet in one group. The windows of a text
that share an anchor place are a block (a run of window starts). Then:

1. Blocks are counted by anchor hash. Where all blocks of an anchor are equal, they are repeated (or alone) as a whole.
2. Elsewhere the different blocks are compared. Blocks that share no core of their windows, byte for byte, with another
   block of their group match nothing and drop out; each group of the others gets a suffix order with longest common prefixes, and
   longest-previous-factor arrays (nearest smaller positions before and after in suffix order), for earlier and for
   later matches. Groups are packed to about PACK_BYTES for one suffix order.
3. An anchor with more than GROUP_BLOCKS different blocks (a passage in very many texts) goes by hashes alone, without
   a suffix order: the window starts are cut into cells of 32, 8 and then 1 starts relative to the anchor. Windows of a
   cell share a core of bytes, so blocks with different cores part, and blocks equal over the whole cell are one. So no
   group is capped and none meets whole in one task.

With keep="none" every repeated window is removed, with keep="first" all but the first in order of doc_id and place.

The same steps find repeated passages of words: symbols are then 64-bit hashes of words, windows count words, and
within=False asks for a match in another document.

Steps 1 and 3 and equal blocks decide by hashes, not by bytes: 64-bit polynomial hashes mod 2^64 of random odd byte
values, an anchor and a block (or core) hash together for each comparison. Two different blocks of one anchor are taken
for equal with a chance of about 2^-64 for a pair, so over a group of m different blocks about m^2 / 2^65. A suffix order
compares hashes of length / 8 bytes (or single words) with a chance of 2^-63 for a pair of places.

Defined cases: null text is the empty text; texts shorter than `length` lose nothing; a null doc_id comes first in
order; of repeated rows all are copies of each other under "none" and one document under "first"; other columns are
ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import discard, joined_spread, map_documents, narrow, read_table, stored, text_or_empty
from cairn.llm.near import BASE, BYTE_VALUES, _grown, grouped, mixed
from cairn.llm.suffixes import neighbour_prefixes, previous_factors, suffix_order

LENGTH = 400
GRAM = 100
GROUP_BLOCKS = 200
CORES = 6
#: Sizes at which the arrays of one step stay in a processor's cache.
PACK_BYTES = 60_000
TOGETHER = 1 << 16
PART_BYTES = 8_000_000
CELLS = (32, 8, 1)
PLACE_BITS = 24
PIECE = 1 << 22

PASSAGE_WORDS = 50
PASSAGE_GRAM = 4
SALTS = 32

BLOCK = "doc long, start long, windows int, lead int, anchor long, block long"


class SpanHash:
    """Prefix polynomial hashes mod 2^64 of an array of bytes, or of symbols that are hashes themselves."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((BYTE_VALUES[data] if data.dtype == np.uint8 else data) * _grown(0, BASE, n), out=self.sums[1:])
        self.back = _grown(1, pow(BASE, -1, 1 << 64), n + 1)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of a text, in order; a very long text goes in pieces that end between words."""
    out, at = [], 0
    while at < len(raw):
        data = np.frombuffer(raw, dtype=np.uint8, offset=at, count=min(PIECE, len(raw) - at))
        white = (data == 32) | (data >= 9) & (data <= 13)
        if at + len(data) < len(raw) and white.any():  # the rest of a word goes to the next piece
            data, white = (x[: np.flatnonzero(white)[-1] + 1] for x in (data, white))
        elif at + len(data) < len(raw):
            end = next((i for i in range(at + len(data), len(raw)) if raw[i] == 32 or 9 <= raw[i] <= 13), len(raw))
            data, white = np.frombuffer(raw, dtype=np.uint8, offset=at, count=end - at), np.zeros(end - at, dtype=bool)
        edge = np.diff(np.concatenate([[1], white.astype(np.int8), [1]]))
        out.append(SpanHash(data).spans(np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)))
        at += len(data)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def symbols_of(raw: bytes, unit: str) -> np.ndarray:
    """A text as symbols: its bytes, or hashes of its words."""
    return np.frombuffer(raw, dtype=np.uint8) if unit == "bytes" else word_hashes(raw)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours: least so far from both sides of blocks of that width."""
    n = len(values)
    if n < width:
        return np.zeros(0, dtype=values.dtype)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    grid = padded.reshape(rows, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def blocks_of(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Blocks of concatenated texts: (text number, first window start in the text, windows, anchor place from that start, anchor, block hash)."""
    empty = (np.zeros(0, dtype=np.int64),) * 4 + (np.zeros(0, dtype=np.uint64),) * 2
    n = len(data)
    if n < length:
        return empty
    hashes = SpanHash(data)
    grams = hashes.spans(np.arange(n - gram + 1), np.arange(gram, n + 1))
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_least(grams & ~low | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
    text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = np.arange(n - length + 1)
    valid = text_of[starts] == text_of[starts + length - 1]
    first = np.flatnonzero(valid & np.concatenate([[True], (least[1:] != least[:-1]) | ~valid[:-1] | (text_of[starts[1:]] != text_of[starts[:-1]])]))
    if not len(first):
        return empty
    ended = np.flatnonzero(valid & np.concatenate([(least[1:] != least[:-1]) | ~valid[1:] | (text_of[starts[1:]] != text_of[starts[:-1]]), [True]]))
    windows = ended - first + 1
    place = (least[first] & low).astype(np.int64)
    lead = place - first
    content = hashes.spans(first, ended + length)
    block = mixed(content + lead.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return text_of[first], first - bounds[text_of[first]], windows, lead, grams[place], block


def text_blocks(raw: list[np.ndarray], length: int, gram: int):
    """blocks_of for a list of symbol arrays, about TOGETHER symbols at a time; a very long one goes in pieces that overlap by a window."""
    out: list[tuple[np.ndarray, ...]] = []
    small = [i for i, r in enumerate(raw) if len(r) <= PIECE]
    sizes = [len(raw[i]) for i in small]
    at = 0
    while at < len(small):
        end, total = at, 0
        while end < len(small) and (end == at or total + sizes[end] <= TOGETHER):
            total += sizes[end]
            end += 1
        data = np.concatenate([raw[i] for i in small[at:end]])
        found = blocks_of(data, np.concatenate([[0], np.cumsum(sizes[at:end], dtype=np.int64)]), length, gram)
        out.append((np.array(small[at:end], dtype=np.int64)[found[0]], *found[1:]))
        at = end
    for i, r in enumerate(raw):
        if len(r) > PIECE:
            for a in range(0, len(r) - length + 1, PIECE):
                data = r[a : a + PIECE + length - 1]
                found = blocks_of(data, np.array([0, len(data)]), length, gram)
                out.append((np.full(len(found[0]), i), found[1] + a, *found[2:]))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 6


def _documents(docs: DataFrame) -> DataFrame:
    """doc (names the row's document), doc_id and text. Where doc_ids repeat or are null, doc is a hash of id and text."""
    rows = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    n, known, different = rows.agg(F.count("*"), F.count("doc_id"), F.countDistinct("doc_id")).first()
    plain = n == known == different
    return rows.withColumn("doc", F.col("doc_id") if plain else F.xxhash64("doc_id", "text"))


def _packed(rows: DataFrame) -> DataFrame:
    """`rows` (doc, doc_id, text) with the text as zstandard-compressed UTF-8, which is what is shuffled."""

    def run(columns):
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        return {"doc": columns["doc"], "doc_id": columns["doc_id"], "packed": [press(t.encode("utf-8", "surrogatepass")) for t in columns["text"]]}

    return map_documents(rows.select("doc", "doc_id", "text"), run, "doc long, doc_id long, packed binary")


def _unpacked(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def blocks(rows: DataFrame, length: int, gram: int, unit: str) -> DataFrame:
    """All blocks of the texts of `rows` (doc, text), stored."""

    def run(columns):
        out = {k.split()[0]: [] for k in BLOCK.split(", ")}
        for a, b in grouped(columns["text"]):
            text, start, windows, lead, anchor, block = text_blocks([symbols_of(t.encode("utf-8", "surrogatepass"), unit) for t in columns["text"][a:b]], length, gram)
            out["doc"] += [columns["doc"][a + i] for i in text.tolist()]
            for k, v in (("start", start), ("windows", windows), ("lead", lead), ("anchor", anchor.view(np.int64)), ("block", block.view(np.int64))):
                out[k] += v.tolist()
        return out

    least = length if unit == "bytes" else 2 * length - 1  # words and the gaps between them
    return stored(map_documents(rows.where(F.octet_length("text") >= least).select("doc", "text"), run, BLOCK), "blocks")


def compared_blocks(contexts: list[np.ndarray], windows: list[int], length: int, first: bool, owners: list[tuple[int, int]] | None = None) -> list[list[tuple[int, int]]]:
    """For each context the runs of window starts that match at another start of any context; with `first`, at an earlier one.

    Contexts are in order of first occurrence. Symbols are hashes of a part of a window (`unit` places), so a match of
    a few symbols is a match of a window. After each context stands a gap of one symbol's length, and symbols that touch
    a gap are unlike any other, so no match steps from one context into the next. `owners` gives the least and the
    greatest document that holds each context; then a match must lie in another document.
    """
    unit = next(length // k for k in (8, 5, length) if length % k == 0)
    gap = np.zeros(unit, dtype=contexts[0].dtype)
    data = np.concatenate([x for c in contexts for x in (c, gap)])
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    ends = np.cumsum(sizes + unit) - unit
    n = len(data)
    if unit > 1:
        symbols = SpanHash(data).spans(np.arange(n), np.minimum(np.arange(n) + unit, n)) >> np.uint64(1)
    else:
        symbols = data.astype(np.uint64) >> np.uint64(data.dtype.itemsize == 8)
    touching = np.flatnonzero(np.arange(n) + unit > np.repeat(ends, sizes + unit))
    symbols[touching] = (1 << 63) + touching.astype(np.uint64)
    cap = length // unit
    order, levels = suffix_order(symbols, cap, unit)
    lcp = neighbour_prefixes(order, levels, unit, floor=cap)
    found = previous_factors(order, lcp, floor=cap) >= cap
    if not first:
        found |= previous_factors(order, lcp, later=True, floor=cap) >= cap
    if owners is not None:  # equal windows stand together in suffix order
        heads = np.flatnonzero(lcp < cap)
        lo, hi = (np.repeat(np.array([o[k] for o in owners], dtype=np.int64), sizes + unit)[order] for k in (0, 1))
        apart = np.minimum.reduceat(lo, heads) < np.maximum.reduceat(hi, heads)
        found[order] &= np.repeat(apart, np.diff(np.append(heads, n)))
    out = []
    for end, context, count in zip(ends.tolist(), contexts, windows, strict=True):
        hit = found[end - len(context) : end - len(context) + count].astype(np.int8)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
        out.append(list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True)))
    return out


RUN = "anchor long, block long, a int, b int"


def meeting(group: list, length: int, gram: int, item: int) -> list:
    """Those of the different blocks of one anchor that may share a window with another of them.

    Equal windows start at the same distance from the anchor. The distances are cut into CORES ranges; all windows of a
    range share a core of places, so blocks whose cores no other block has, byte for byte, share no window either.
    """
    if len(group) < 2:
        return []
    span, width = length - gram, -(-(length - gram + 1) // CORES)
    own, of = [], {}
    for i, r in enumerate(group):
        context, lead, last = r["context"], r["lead"], r["windows"] - 1
        for a in range(-span, 1, width):
            b = min(a + width - 1, 0)
            if -lead <= b and last - lead >= a:  # else the block has no window of this range
                core = (a, context[(b + lead) * item : (a + length + lead) * item])
                own.append((i, core))
                of[core] = of.get(core, 0) + 1
    return [group[i] for i in sorted({i for i, core in own if of[core] > 1})]


def _by_suffixes(rows: DataFrame, length: int, gram: int, first: bool, parts: int, dtype, within: bool) -> DataFrame:
    """Runs of repeated window starts of the blocks of small groups; what may match of a group is packed, whole, to about PACK_BYTES."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(RUN))
    item = np.dtype(dtype).itemsize

    def solved(pack):
        pack.sort(key=lambda r: (r["first_doc"], r["first_start"]))
        out = {"anchor": [], "block": [], "a": [], "b": []}
        contexts = [np.frombuffer(r["context"], dtype=dtype) for r in pack]
        owners = None if within else [(r["first_doc"], r["last_doc"]) for r in pack]
        for r, runs in zip(pack, compared_blocks(contexts, [r["windows"] for r in pack], length, first, owners), strict=True):
            for a, b in runs:
                for k, v in (("anchor", r["anchor"]), ("block", r["block"]), ("a", a), ("b", b)):
                    out[k].append(v)
        return pa.RecordBatch.from_pydict(out, schema=arrow)

    def run(batches):
        pack, size = [], 0
        for _, group in itertools.groupby((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["anchor"]):
            if size > PACK_BYTES:
                yield solved(pack)
                pack, size = [], 0
            kept = meeting(list(group), length, gram, item)
            pack += kept
            size += sum(len(r["context"]) for r in kept)
        if pack:
            yield solved(pack)

    dealt = rows.select("anchor", "block", "windows", "lead", "first_doc", "last_doc", "first_start", "context").repartition(parts, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, RUN)


CELL = "anchor long, block long, a int, b int, n long, cell int, core long, full long, first_doc long, last_doc long, first_start long"


def _by_cells(rows: DataFrame, length: int, first: bool, dtype, within: bool) -> DataFrame:
    """Runs for the blocks of large groups, by splitting window starts into ever smaller cells with a common core.

    Cells of one content are repeated whole (with `first`, all but the earliest). Of each content that shares its core
    with others one cell is split further, so the rows of a step follow the different contents, not the blocks.
    """
    contexts = rows.select("anchor", "block", "lead", "context")
    open_rows = rows.select("anchor", "block", F.lit(0).alias("a"), (F.col("windows") - 1).alias("b"), "n", "first_doc", "last_doc", "first_start")
    found = None
    for step in (c for c in CELLS if c == 1 or 2 * c <= length):

        def run(columns, step=step):
            out = {k.split()[0]: [] for k in CELL.split(", ")}
            for i, context in enumerate(columns["context"]):
                lead, a, b = columns["lead"][i], columns["a"][i], columns["b"][i]
                cells = np.arange((a - lead) // step, (b - lead) // step + 1)
                low, high = cells * step + lead, cells * step + step - 1 + lead  # window starts of the cell, in the context
                start, end = np.maximum(low, a), np.minimum(high, b)
                hashes = SpanHash(np.frombuffer(context, dtype=dtype))
                core = hashes.spans(high, low + length)
                full = mixed(hashes.spans(start, end + length) + (start - low).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                out["a"] += start.tolist()
                out["b"] += end.tolist()
                out["cell"] += cells.tolist()
                out["core"] += core.view(np.int64).tolist()
                out["full"] += full.view(np.int64).tolist()
                for k in ("anchor", "block", "n", "first_doc", "last_doc", "first_start"):
                    out[k] += [columns[k][i]] * len(cells)
            return out

        cells = map_documents(open_rows.join(contexts, ["anchor", "block"]), run, CELL)
        cells = stored(cells.withColumn("content", F.xxhash64("anchor", "cell", "core", "full")), "cells")
        earliest = F.min(F.struct("first_doc", (F.col("first_start") + F.col("a")).alias("at"), "block", "a", "b", "first_start")).alias("f")
        contents = cells.groupBy("anchor", "cell", "core", "full").agg(
            F.first("content").alias("content"), earliest, F.sum("n").alias("copies"), F.count("*").alias("m"), F.min("first_doc").alias("lo"), F.max("last_doc").alias("hi")
        )
        contents = stored(contents, "contents")
        repeated = contents.where("m > 1" if first else "copies > 1" if within else "lo < hi").select("content", "m", F.col("f.first_doc").alias("f_doc"), F.col("f.at").alias("f_at"))
        done = joined_spread(cells.select("content", "anchor", "block", "a", "b", "first_doc", "first_start"), repeated, "content", "m")
        done = (done.where("NOT (first_doc = f_doc AND first_start + a = f_at)") if first else done).select("anchor", "block", "a", "b")
        found = done if found is None else found.unionByName(done)
        shared = contents.groupBy("anchor", "cell", "core").agg(F.count("*").alias("m"), F.min("lo").alias("lowest"), F.max("hi").alias("highest"))
        shared = stored(shared.where("m > 1" if within else "m > 1 AND lowest < highest").withColumn("group", F.xxhash64("anchor", "cell", "core")), "shared")
        grouped_rows = contents.withColumn("group", F.xxhash64("anchor", "cell", "core"))
        open_rows = joined_spread(grouped_rows.drop("m"), shared.select("group", "m"), "group", "m")
        open_rows = open_rows.select("anchor", "f.block", "f.a", "f.b", F.col("copies").alias("n"), "f.first_doc", F.col("hi").alias("last_doc"), "f.first_start")
    return found


def repeated_spans(rows: DataFrame, packed: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: str = "none", unit: str = "bytes", within: bool = True) -> DataFrame:
    """doc, s and e: spans (in bytes or words, not merged) of what goes; without `within`, of what also stands in another document."""
    if keep not in ("none", "first") or unit not in ("bytes", "words"):
        raise ValueError(f"unknown keep or unit: {keep}, {unit}")
    first, dtype = keep == "first", np.uint8 if unit == "bytes" else np.uint64
    every = blocks(rows, length, gram, unit)
    anchors = every.groupBy("anchor").agg(F.count("*").alias("copies"), F.min("block").alias("low"), F.max("block").alias("high"), F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    anchors = stored(anchors.where("copies > 1" if within else "lo < hi").drop("lo", "hi"), "anchors")  # apart from the join, so that Spark can split a frequent anchor's rows there
    shared = stored(every.join(anchors, "anchor"), "shared")
    discard(every)
    place = F.struct("doc", "start")
    different = (
        shared.where("low <> high")
        .groupBy("anchor", "block")
        .agg(F.count("*").alias("n"), F.min(F.struct("doc", "start", "windows", "lead")).alias("f"), F.max("doc").alias("last_doc"))
        .select("anchor", "block", "n", F.col("f.doc").alias("first_doc"), "last_doc", F.col("f.start").alias("first_start"), F.col("f.windows").alias("windows"), F.col("f.lead").alias("lead"))
    )
    different = stored(different.withColumn("salt", F.pmod("block", F.lit(SALTS)).cast("int")), "different")
    item = np.dtype(dtype).itemsize
    sizes = different.groupBy("anchor").agg(F.count("*").alias("m"), F.sum((F.col("windows") + length) * item).alias("bytes"))
    # of large groups, one anchor in GROUP_BLOCKS blocks at most, each is sent once for each salt, so that no group meets in one task
    large = sizes.where(F.col("m") > GROUP_BLOCKS).select("anchor", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("large"))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    kept = ("anchor", "block", "n", "last_doc", "first_start", "windows", "lead", "large")
    wanted = different.join(large, ["anchor", "salt"], "left").withColumn("large", F.coalesce("large", F.lit(False)))
    wanted = wanted.groupBy(F.col("first_doc").alias("doc")).agg(F.collect_list(F.struct(*kept)).alias("wanted"))

    def cut(columns):
        out = {k: [] for k in (*kept, "first_doc", "context")}
        for doc, blob, wanted_here in zip(columns["doc"], columns["packed"], columns["wanted"], strict=True):
            data = symbols_of(_unpacked(blob), unit)
            for w in wanted_here:
                out["first_doc"].append(doc)
                out["context"].append(data[w["first_start"] : w["first_start"] + w["windows"] - 1 + length].tobytes())
                for k in kept:
                    out[k].append(w[k])
        return out

    once = packed.select("doc", "packed").join(wanted, "doc")
    contexts = map_documents(once, cut, "anchor long, block long, n long, last_doc long, first_start long, windows int, lead int, large boolean, first_doc long, context binary")
    contexts = stored(contexts.dropDuplicates(["anchor", "block"]) if _repeats(packed) else contexts, "contexts")
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PART_BYTES)
    runs = _by_suffixes(contexts.where("NOT large"), length, gram, first, parts, dtype, within).unionByName(_by_cells(contexts.where("large"), length, first, dtype, within))
    runs = stored(runs, "runs")
    if not first:  # blocks with equal copies are repeated whole
        copied = "n > 1" if within else "first_doc < last_doc"
        runs = runs.join(different.where(f"NOT ({copied})").select("anchor", "block"), ["anchor", "block"], "left_semi").unionByName(
            different.where(copied).select("anchor", "block", F.lit(0).alias("a"), (F.col("windows") - 1).alias("b"))
        )
        equal = shared.where("low = high")
        mixed_rows = shared.where("low <> high")
    else:  # of equal blocks all but the first go whole; the first loses what is earlier in other blocks
        firsts = shared.where("low = high").groupBy("anchor", "block").agg(F.min(place).alias("f"))
        equal = shared.where("low = high").join(firsts, ["anchor", "block"]).where("NOT (doc = f.doc AND start = f.start)").drop("f")
        own = different.select("anchor", "block", "first_doc", "first_start")
        mixed_rows = shared.where("low <> high").join(own, ["anchor", "block"])
        later = mixed_rows.where("NOT (doc = first_doc AND start = first_start)")
        equal = equal.unionByName(later.drop("first_doc", "first_start"))
        mixed_rows = mixed_rows.where("doc = first_doc AND start = first_start").drop("first_doc", "first_start")
    whole = equal.select("doc", F.col("start").alias("s"), (F.col("start") + F.col("windows") - 1 + length).alias("e"))
    partly = mixed_rows.join(runs, ["anchor", "block"]).select("doc", (F.col("start") + F.col("a")).alias("s"), (F.col("start") + F.col("b") + length).alias("e"))
    return whole.unionByName(partly)


def _repeats(packed: DataFrame) -> bool:
    """Whether one doc may stand for several rows."""
    return "doc_id" not in packed.columns or not packed.select("doc", "doc_id").where("NOT (doc <=> doc_id)").limit(1).isEmpty()


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def trimmed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: str = "none", passage_words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (what went, merged byte spans) and kept (binary: the bytes that stay) of every document.

    With `passage_words`, also n_passage_words: words in passages of so many words or more that stand in another document
    too. They are only counted; what is removed does not depend on them.
    """
    rows = _documents(docs)
    packed = _packed(rows)
    found = repeated_spans(rows, packed, length, gram, keep).withColumn("passage", F.lit(False))
    if passage_words:
        passages = repeated_spans(rows, packed, passage_words, min(PASSAGE_GRAM, passage_words), unit="words", within=False)
        found = found.unionByName(passages.withColumn("passage", F.lit(True)))
    of = lambda which: F.collect_set(F.when(which, F.struct("s", "e")))
    spans = found.groupBy("doc").agg(of(~F.col("passage")).alias("spans"), of(F.col("passage")).alias("passages"))

    def run(columns):
        out = {"doc_id": columns["doc_id"], "n_bytes": [], "spans": [], "kept": [], "n_passage_words": []}
        for blob, found, passages in zip(columns["packed"], columns["spans"], columns["passages"], strict=True):
            data, went = _unpacked(blob), merged(found)
            edges = [0, *(x for s in went for x in s), len(data)]
            out["n_bytes"].append(len(data))
            out["spans"].append([{"start": s, "end": e} for s, e in went])
            out["kept"].append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            out["n_passage_words"].append(sum(e - s for s, e in merged(passages)))
        return out

    joined = packed.join(spans, "doc", "left").select("doc_id", "packed", "spans", "passages")
    out = map_documents(joined, run, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary, n_passage_words long")
    return out if passage_words else out.drop("n_passage_words")


def query(spark, sf_dir: str) -> DataFrame:
    """The digest of what 400-byte strings remove, and n_passage_words: words in passages of 50 words that other documents hold too."""
    out = trimmed(read_table(spark, sf_dir, "documents"), passage_words=PASSAGE_WORDS)
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        "n_passage_words",
    )
