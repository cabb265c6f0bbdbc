"""Token ids in binary files of independent zstandard frames.

A shard holds one frame for each document (its ids as little-endian unsigned 32-bit integers), then a skippable frame
with the doc_ids, then the seek table of the public zstd seekable format: a skippable frame with the compressed size,
size and checksum (low half of XXH64) of every frame, and a footer. A reader needs the footer, the table, and the
frames of the documents asked for. Each frame's checksum is tested on reading.

Documents are written in ascending doc_id order (null first, then text for ties): range partitioning orders the
shards, a sort orders each shard. Shards go to the shared folder under a name of the writing attempt, so a retried
task leaves at most an unused file; the manifest names the files of the attempts that succeeded.

Defined cases: null text is the empty text, whose ids are the end id alone; an empty table writes no shard; repeated
rows are written each; a null doc_id is kept as the least integer and read back as null.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.bpe import OpenEnd, cut, explicit_spaces
from cairn.llm.common import fresh_path, map_documents, narrow, read_table, slices, text_or_empty

SKIP_TABLE, SKIP_IDS, FOOTER = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
CACHE_ENTRIES = 500_000
MARKS = ".,!?;:"
LATIN_END = "\u0250"
#: The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for U+0100 and on, in order.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
ALPHABET = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
CACHE_CHARS = 48
NO_ID = -(1 << 63)


class FastTokenizer:
    """The tokenizers library's byte-level BPE behind caches of pieces.

    The library encodes each match of its splitting pattern apart, and the pattern never matches across a single space
    between two non-space characters. So texts are cut at such spaces, a cut part that is new is split by the pattern,
    and the library encodes the matches that are new. Parts with characters beyond the Latin letters, where versions
    of Unicode differ, or with a piece of a special token go to the library whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(explicit_spaces(public_tokenizers.PATTERN)).findall
        self.first = Generations(lambda part: self.part("", part))
        self.rest = Generations(lambda part: self.part(" ", part))
        self.pieces = Generations(self.piece)

    def piece(self, text: str) -> bytes:
        """Ids of one match of the pattern, by the library's model alone, its bytes spelt in the byte-level alphabet."""
        spelt = text.translate(ALPHABET) if text.isascii() else text.encode().decode("latin-1").translate(ALPHABET)
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, lead: str, part: str) -> bytes:
        """A part between spaces: a word is one match of the pattern, a word and a mark after it are two."""
        if part.isalpha() and (part.isascii() or max(part) < LATIN_END):
            return self.piece(lead + part)
        if not part or part[0].isspace() or part[-1].isspace():
            raise OpenEnd
        if part[-1] in MARKS and part[:-1].isalpha():
            return (self.rest if lead else self.first)[part[:-1]] + self.pieces[part[-1]]
        return self.chunk(lead + part)

    def chunk(self, text: str) -> bytes:
        if max(text) >= LATIN_END or any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of whole texts."""
        return [self.encode_text(text) if text else b"" for text in texts]

    def encode_text(self, text: str) -> bytes:
        parts = text.split(" ")
        try:
            return b"".join([self.first[parts[0]], *map(self.rest.__getitem__, parts[1:])])
        except OpenEnd:
            return b"".join(map(self.chunk, cut(text)))


class Generations(dict):
    """A bounded cache: when it is full, its entries become the older generation, from which hits are taken over."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > CACHE_CHARS:
                return found
        if len(self) >= CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


@lru_cache(maxsize=2)
def fast_tokenizer(path: str) -> FastTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return FastTokenizer(path)


class ShardWriter:
    """Writes one shard to a binary file object."""

    def __init__(self, sink, level: int = 3):
        import zstandard

        self.sink, self.compress = sink, zstandard.ZstdCompressor(level=level).compress
        self.doc_ids: list[int] = []
        self.entries: list[bytes] = []
        self.tokens = 0

    def add(self, doc_id: int | None, packed: bytes) -> None:
        import xxhash

        frame = self.compress(packed)
        self.sink.write(frame)
        self.doc_ids.append(NO_ID if doc_id is None else doc_id)
        self.entries.append(struct.pack("<III", len(frame), len(packed), xxhash.xxh64_intdigest(packed) & 0xFFFFFFFF))
        self.tokens += len(packed) // 4

    def close(self) -> None:
        ids = np.array(self.doc_ids, dtype="<i8").tobytes()
        self.sink.write(struct.pack("<II", SKIP_IDS, len(ids)) + ids)
        table = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), 0x80, FOOTER)
        self.sink.write(struct.pack("<II", SKIP_TABLE, len(table)) + table)


class ShardReader:
    """Reads a shard from a seekable file object."""

    def __init__(self, source, size: int):
        source.seek(size - 9)
        n, descriptor, magic = struct.unpack("<IBI", source.read(9))
        if magic != FOOTER or not descriptor & 0x80:
            raise ValueError("not a shard: its footer is missing")
        table = size - 9 - 12 * n - 8
        source.seek(table)
        if struct.unpack("<II", source.read(8)) != (SKIP_TABLE, 12 * n + 9):
            raise ValueError("the shard's seek table is damaged")
        self.sizes = np.frombuffer(source.read(12 * n), dtype="<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes[:, 0], dtype=np.int64)])
        source.seek(int(self.starts[-1]))
        if struct.unpack("<II", source.read(8)) != (SKIP_IDS, 8 * n):
            raise ValueError("the shard's list of documents is damaged")
        self.doc_ids = np.frombuffer(source.read(8 * n), dtype="<i8")
        self.source = source

    def frame(self, k: int) -> bytes:
        """Packed ids of document k, decompressed and tested."""
        import xxhash
        import zstandard

        self.source.seek(int(self.starts[k]))
        packed = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.sizes[k, 0])), max_output_size=max(1, int(self.sizes[k, 1])))
        if len(packed) != self.sizes[k, 1] or xxhash.xxh64_intdigest(packed) & 0xFFFFFFFF != self.sizes[k, 2]:
            raise ValueError(f"frame {k} fails its checksum")
        return packed

    def lookup(self, doc_id: int) -> list[bytes]:
        """Packed ids of the documents with this id; only their frames are read."""
        return [self.frame(int(k)) for k in np.flatnonzero(self.doc_ids == doc_id)]


def filesystem(uri: str):
    """(file system, path) for a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> list[dict]:
    """Encodes and writes all documents; the manifest in doc_id order: path, n_docs, n_tokens and the tokens before each shard.

    One row for each shard comes to the driver.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = "path string, first_id long, last_id long, n_docs long, n_tokens long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        system, root = filesystem(folder)
        name, sink, writer = f"shard-{uuid.uuid4().hex}.zst", None, None
        for batch in batches:
            for part in slices(batch):
                piece = part.to_pydict()
                if sink is None and piece["doc_id"]:
                    system.create_dir(root, recursive=True)
                    sink = system.open_output_stream(f"{root}/{name}", compression=None)  # the frames are the compression
                    writer = ShardWriter(sink)
                for doc_id, packed in zip(piece["doc_id"], fast_tokenizer(tokenizer).encode(piece["text"]), strict=True):
                    writer.add(doc_id, packed + end)
        if writer is not None:
            writer.close()
            sink.close()
            row = {"path": [f"{folder}/{name}"], "first_id": [writer.doc_ids[0]], "last_id": [writer.doc_ids[-1]], "n_docs": [len(writer.doc_ids)], "n_tokens": [writer.tokens]}
            yield pa.RecordBatch.from_pydict(row, schema=arrow)

    rows = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    manifest = sorted((r.asDict() for r in ordered.mapInArrow(run, schema).collect()), key=lambda r: (r["first_id"], r["last_id"]))
    before = 0
    for r in manifest:
        r["tokens_before"] = before
        before += r["n_tokens"]
    return manifest


def read_shards(spark, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards, each shard read by one task."""
    shards = spark.createDataFrame([(m["path"], m["tokens_before"]) for m in manifest], "path string, tokens_before long")

    def run(columns):
        out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
        for path, before in zip(columns["path"], columns["tokens_before"], strict=True):
            system, at = filesystem(path)
            with system.open_input_file(at) as source:
                reader = ShardReader(source, source.size())
                for k, doc_id in enumerate(reader.doc_ids.tolist()):
                    packed = reader.frame(k)
                    out["doc_id"].append(None if doc_id == NO_ID else doc_id)
                    out["start"].append(before)
                    out["n_tokens"].append(len(packed) // 4)
                    out["ids_crc32"].append(zlib.crc32(packed))
                    before += len(packed) // 4
        return out

    return map_documents(shards.repartition(max(1, len(manifest))), run, "doc_id long, start long, n_tokens long, ids_crc32 long", rows=1)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh_path(spark, "tokens")
    manifest = write_shards(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_shards(spark, manifest)
