"""Document fingerprints from prefix polynomial hashes.

`PrefixHash` keeps, for two primes, H[k] = sum of c_i * B^i over the first k code points. Any span's hash is
(H[j] - H[i]) * B^-i, so spans compare in constant time, and the longest common extension of two places is found by
binary search over span lengths. A fingerprint is the whole text's hash and length, and for each of BINS classes the
least mixed hash among the spans of SPAN code points; the likeness of two fingerprints is the share of equal classes.

Documents are put in ascending doc_id order (null first; ties by a hash of the text, then the text) by range
partitioning on id and hash, so that many rows of one id are dealt to several tasks; only the first and last row of each
partition meet across partitions.

Defined cases: null text is the empty text; a text shorter than SPAN has one span, itself; the empty text has none and
its likeness is 1 to itself and 0 to others; a single document is its own next one; repeated rows each count.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import map_documents, narrow, read_table, slices, stored, text_or_empty

PRIMES = (2147483647, 2147483629)
BASES = (1_000_003, 998_244_353)
SPAN = 8
BINS = 64

_powers: dict[int, np.ndarray] = {}


def _table(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod prime; kept, and grown by doubling."""
    key = base * (1 << 32) + prime
    have = _powers.get(key)
    if have is None:
        have = np.ones(1, dtype=np.uint64)
    while len(have) < n:
        step = np.uint64(pow(base, len(have), prime))
        have = np.concatenate([have, have * step % np.uint64(prime)])
    _powers[key] = have
    return have[:n]


class PrefixHash:
    """Prefix arrays of one text for both primes."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.sums = []
        for prime, base in zip(PRIMES, BASES, strict=True):
            p = np.uint64(prime)
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(points * _table(base, prime, self.n) % p, out=sums[1:])
            self.sums.append(sums % p)

    def span(self, start, end) -> np.ndarray:
        """62-bit hashes of the spans [start, end); numbers or arrays."""
        start, end = np.atleast_1d(np.asarray(start)), np.atleast_1d(np.asarray(end))
        out = []
        for prime, base, sums in zip(PRIMES, BASES, self.sums, strict=True):
            p = np.uint64(prime)
            back = _table(pow(base, -1, prime), prime, self.n + 1)
            out.append((sums[end] + p - sums[start]) % p * back[start] % p)
        return out[0] << np.uint64(31) | out[1]

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all spans of `width`; of the whole text if it is shorter; none if it is empty."""
        if self.n <= width:
            return self.span(0, self.n) if self.n else np.zeros(0, dtype=np.uint64)
        out = []
        m = self.n - width + 1
        for prime, base, sums in zip(PRIMES, BASES, self.sums, strict=True):
            p = np.uint64(prime)
            out.append((sums[width:] + p - sums[:m]) % p * _table(pow(base, -1, prime), prime, m) % p)
        return out[0] << np.uint64(31) | out[1]


def equal_spans(a: PrefixHash, i: int, b: PrefixHash, j: int, length: int) -> bool:
    """Whether a[i:i+length] and b[j:j+length] are equal, up to hash chance (about 2^-60)."""
    return bool(a.span(i, i + length)[0] == b.span(j, j + length)[0])


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """The greatest length to which a[i:] and b[j:] agree."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if equal_spans(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def sketch(text: PrefixHash) -> np.ndarray:
    """For each class (the top bits of the mixed hash) 16 bits of its least member, 0 for none."""
    h = np.sort(mixed(text.windows(SPAN)))
    at = np.searchsorted(h, np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1))
    out = np.zeros(BINS, dtype=np.uint16)
    full = np.flatnonzero(np.append(at[1:], len(h)) > at)
    out[full] = (h[at[full]] & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal classes among those that either sketch fills; 1 if both fill none."""
    either = (a | b) > 0
    n = int(either.sum())
    return float((a == b)[either].sum() / n) if n else 1.0


class Print:
    """A text with its prefix hash, sketch and fingerprint string."""

    def __init__(self, text: str):
        self.text = text
        self.hash = PrefixHash(text)
        self.sketch = sketch(self.hash)
        whole = int(self.hash.span(0, self.hash.n)[0]) if self.hash.n else 0
        self.string = f"{self.hash.n:x}-{whole:016x}-{self.sketch.astype('>u2').tobytes().hex()}"


def likeness_of(a: str, b: str) -> float:
    """Likeness of two fingerprint strings."""
    return likeness(*(np.frombuffer(bytes.fromhex(x.rpartition("-")[2]), dtype=">u2").astype(np.uint16) for x in (a, b)))


def edited(text: str, following: str) -> str:
    """`text` with its last floor(n/2) code points replaced by the first as many of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, next_prefix long"


def compared(own: Print, following: Print) -> tuple:
    changed = Print(edited(own.text, following.text))
    return (
        own.hash.n,
        hashlib.sha256(changed.text.encode()).hexdigest(),
        own.string,
        changed.string,
        likeness(own.sketch, changed.sketch),
        likeness(own.sketch, following.sketch),
        common_extension(own.hash, 0, following.hash, 0),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every text."""

    def run(columns):
        return {"doc_id": columns["doc_id"], "fingerprint": [Print(t).string for t in columns["text"]]}

    return map_documents(_rows(docs), run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, its edited text's, and their likeness to each other and to the next document's."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    schema = f"doc_id long, {FIELDS}, edge string, part int, text string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    blank = (None,) * (len(FIELDS.split(",")))

    def run(batches):
        part = TaskContext.get().partitionId()
        last = None  # (doc_id, Print)
        for batch in batches:
            for part_of in slices(batch, 256):
                piece, out = part_of.to_pydict(), []
                for doc_id, text in zip(piece["doc_id"], piece["text"], strict=True):
                    now = Print(text)
                    if last is None:
                        out.append((None, *blank, "first", part, text))
                    else:
                        out.append((last[0], *compared(last[1], now), None, part, None))
                    last = (doc_id, now)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        if last is not None:
            row = (last[0], *blank, "last", part, last[1].text)
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, arrow, strict=True)], schema=arrow)

    ordered = _rows(docs).withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    done = stored(ordered.mapInArrow(run, schema), "fingerprints")
    names = ["doc_id", *(f.split()[0] for f in FIELDS.split(","))]
    parts = sorted(r.part for r in done.where("edge = 'first'").select("part").collect())  # one small number for each partition
    following = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, next_part int")
    first = done.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    edges = done.where("edge = 'last'").select("doc_id", "text", "part").join(following, "part").join(first, "next_part")

    def close(columns):
        rows = [compared(Print(a), Print(b)) for a, b in zip(columns["text"], columns["next_text"], strict=True)]
        return {"doc_id": columns["doc_id"]} | dict(zip(names[1:], map(list, zip(*rows, strict=True)) if rows else [[] for _ in names[1:]], strict=True))

    closed = map_documents(edges.select("doc_id", "text", "next_text"), close, f"doc_id long, {FIELDS}")
    return done.where("edge IS NULL").select(*names).unionByName(closed)


def _rows(docs: DataFrame) -> DataFrame:
    return narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    return with_next(read_table(spark, sf_dir, "documents"))
