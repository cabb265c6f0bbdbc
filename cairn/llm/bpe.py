"""Byte-level BPE encoding and decoding by longest matches with backtracking.

Bytes are mapped to Latin-1 characters, so a pyahocorasick trie over the vocabulary finds the longest token at any
position. A sequence of tokens is the one that merging by rank gives exactly when every two neighbours are
compatible: merging the bytes of the pair alone gives the pair back. So the encoder takes the longest token that is
compatible with the one before it and, in a dead end, goes back to a shorter prefix; a bit per position marks dead
ends, so each position is left at most once and the time is linear in the piece. For a token and the longest match
behind it, the longest prefix of that match that is compatible is memoised.

Texts are cut at single spaces between two non-space characters. The pattern never matches across such a cut, so the
parts are encoded apart. Words and other matches of the pattern are kept in bounded caches of two generations: when the
younger is full it becomes the older, and what is asked for again comes back. Caches change speed only.

Defined cases: null text is the empty text; an empty text has no tokens and decodes to no bytes; a text without
spaces is one piece, encoded in linear time; repeated rows are encoded row by row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import map_documents, narrow, read_table, text_or_empty

#: The pattern of these rank files; under it letters are one match, with or without a space before them.
WORDS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN_END = "\u0250"  # below it Python's letters are those of every version of Unicode in use
MARKS = frozenset(".,!?;:")
#: Most entries of a generation of a cache, and of the memo of compatible tokens.
WORD_ENTRIES, PIECE_ENTRIES, FIT_ENTRIES = 160_000, 40_000, 300_000
CACHE_CHARS = 48
#: Unicode's White_Space, as the rank files' own library reads \s; Python's \s has four control characters more.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters and numbers that Unicode has assigned since the tables of the rank files' own library.
LATER_LETTERS = (
    "\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce-\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1\\uab6c-\\uab6d"
    "\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a\\U00011db0-\\U00011ddb\\U00011df1"
    "\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3\\U00016ff2-\\U00016ff3\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20"
    "\\U00018d80-\\U00018df2\\U00018e00-\\U00019191\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24"
    "\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4-\\U0001e6e5"
    "\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4\\U0001e6fe-\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead"
    "\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)
LATER_NUMBERS = "\\U00011de0-\\U00011de9\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686\\U00016ff4-\\U00016ff6"
CUT = re.compile(r"(?<=\S) (?=\S)")


def explicit_spaces(pattern: str) -> str:
    r"""`pattern` with \s and \S spelled out as White_Space, inside and outside of character classes."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(WHITE if inside else f"[{WHITE}]")
            i += 2
        elif two == r"\S" and not inside:
            out.append(f"[^{WHITE}]")
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        else:
            inside = True if pattern[i] == "[" and not inside else False if pattern[i] == "]" else inside
            out.append(pattern[i])
            i += 1
    return "".join(out)


def without_later(pattern: str) -> str:
    """`pattern` with the later letters and numbers counted as neither."""
    return (
        pattern.replace(r"[^\s\p{L}\p{N}]+", rf"(?:[{LATER_LETTERS}{LATER_NUMBERS}]|[^\s\p{{L}}\p{{N}}])+")
        .replace(r"?\p{L}+", rf"?(?:(?![{LATER_LETTERS}])\p{{L}})+")
        .replace(r"?\p{N}+", rf"?(?:(?![{LATER_NUMBERS}])\p{{N}})+")
    )


class BytePairCodec:
    """Encoder and decoder for one table of ranks (token bytes to id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.pattern = regex.compile(explicit_spaces(pattern))
        self.later = regex.compile(f"[{LATER_LETTERS}{LATER_NUMBERS}]")
        self.later_pattern = regex.compile(explicit_spaces(without_later(pattern)))
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.trie = ahocorasick.Automaton()
        self.longest = max(map(len, ranks))
        self.reached: dict[str, int] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                halves = self.merge(token, i)
                if len(halves) != 2:
                    continue  # merging never reaches it; only a piece that equals it is it
                pair = (ranks[halves[0]], ranks[halves[1]])
                self.parts[i] = pair
                self.joined[pair] = i
            self.reached[token.decode("latin-1")] = i
            self.trie.add_word(token.decode("latin-1"), i)
        self.sizes = list(map(len, self.bytes_of))
        self.shorter: dict[int, int] = {}
        self.fits: list[dict[int, int]] = [{} for _ in self.bytes_of]
        self.n_fits = 0
        self.words = pattern == WORDS_PATTERN
        self.pieces = Pieces(self, "", PIECE_ENTRIES)
        self.first = Parts(self, "", PIECE_ENTRIES)
        self.rest = Parts(self, " ", WORD_ENTRIES)

    def merge(self, data: bytes, below: int) -> list[bytes]:
        """What merging by ranks under `below` leaves of `data`; for single tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def match(self, s: str, at: int) -> int:
        """The longest token that `s` has at `at`."""
        window = s[at : at + self.longest]
        path = window[: self.trie.longest_prefix(window)]
        found = self.reached.get(path)
        if found is None:  # a part of a token that is none itself; its longest prefix that is one is kept beside the tokens
            n = len(path) - 1
            while (found := self.reached.get(path[:n])) is None:
                n -= 1
            self.reached[path] = found
        return found

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of `token`; -1 if there is none."""
        found = self.shorter.get(token)
        if found is None:
            s, found = self.bytes_of[token].decode("latin-1"), -1
            for n in range(len(s) - 1, 0, -1):
                if (found := self.reached.get(s[:n], -1)) >= 0:
                    break
            self.shorter[token] = found
        return found

    def fitting(self, left: int, token: int) -> int:
        """The longest of `token` and its prefixes that is compatible with `left` before it; -1 if there is none."""
        found = token
        while found >= 0 and not self.compatible(left, found):
            found = self.prefix(found)
        if self.n_fits >= FIT_ENTRIES:
            for memo in self.fits:
                memo.clear()
            self.n_fits = 0
        self.fits[left][token] = found
        self.n_fits += 1
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of `left` and `right` together leaves just these two tokens.

        Undoes the merges of both sides, latest first; the border stands if no pair across it would merge sooner.
        """
        until = len(self.bytes_of)
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < until:
                return False
            whole_left, whole_right = left not in self.parts, right not in self.parts
            if whole_left and whole_right:
                return True
            if not whole_left and (whole_right or left > right):
                until = left  # a merge across the border of rank under `left` comes before left's own last merge
                left = self.parts[left][1]
            else:
                until = right + 1  # at equal rank the merge further left comes first
                right = self.parts[right][0]

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        s, n = data.decode("latin-1"), len(data)
        alive = bytearray(b"\x01") * (n + 1)
        longest, to, reached = self.longest, self.trie.longest_prefix, self.reached
        fits, sizes = self.fits, self.sizes
        out: list[int] = []
        at, left, token = 0, -1, self.match(s, 0)
        while True:
            if left >= 0 and token >= 0:
                found = fits[left].get(token)
                token = self.fitting(left, token) if found is None else found
            if token < 0:  # a dead end
                alive[at] = 0
                token = out.pop()
                at -= sizes[token]
                left = out[-1] if out else -1
                token = self.prefix(token)
                continue
            end = at + sizes[token]
            if not alive[end]:
                token = self.prefix(token)
                continue
            out.append(token)
            if end == n:
                return out
            at, left = end, token
            window = s[at : at + longest]
            token = reached.get(window[: to(window)])
            if token is None:
                token = self.match(s, at)

    def packed(self, piece: str) -> bytes:
        """encode_piece as little-endian unsigned 32-bit integers."""
        ids = self.encode_piece(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_chunk(self, text: str) -> bytes:
        """Ids of `text` as little-endian unsigned 32-bit integers, each match of the pattern encoded apart."""
        pattern = self.pattern if text.isascii() or not self.later.search(text) else self.later_pattern
        found = pattern.findall(text)
        if not self.words:
            return b"".join(map(self.pieces.__getitem__, found))
        return b"".join([self.rest[p[1:]] if p[0] == " " and p[1:].isalpha() and (p.isascii() or max(p) < LATIN_END) else self.pieces[p] for p in found])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed as in encode_chunk."""
        if not text:
            return b""
        parts = text.split(" ")
        try:
            return b"".join([self.first[parts[0]], *map(self.rest.__getitem__, parts[1:])])
        except OpenEnd:
            return b"".join(map(self.encode_chunk, cut(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


class OpenEnd(Exception):
    """A part is empty or touches white space, so the space beside it is no place to cut."""


class Pieces(dict):
    """Packed ids by match of the pattern, `lead` left out: the younger of two generations, with the older one beside it."""

    def __init__(self, codec, lead: str, most: int):
        super().__init__()
        self.codec, self.lead, self.most, self.older = codec, lead, most, {}

    def __missing__(self, key: str) -> bytes:
        packed = self.older.get(key)
        if packed is None:
            packed = self.codec.packed(self.lead + key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = packed
        return packed


class Parts(Pieces):
    """The same by part of a text between spaces, `lead` before it. Words alone are kept; other parts are put together from pieces."""

    def __missing__(self, part: str) -> bytes:
        codec = self.codec
        if codec.words and (part.isascii() or max(part) < LATIN_END):
            if part.isalpha():
                return super().__missing__(part)
            if part[-1:] in MARKS and part[:-1].isalpha():
                return self[part[:-1]] + codec.pieces[part[-1]]
        if not part or part[0].isspace() or part[-1].isspace():
            raise OpenEnd
        return codec.encode_chunk(self.lead + part)


def cut(text: str) -> list[str]:
    """`text` cut before each space that stands between two non-space characters."""
    ends = [m.start() for m in CUT.finditer(text)]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True)]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BytePairCodec:
    """The codec of a rank file, once for each Python process."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return BytePairCodec(ranks, pattern)


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """(path, pattern) of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str, pattern: str, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and ids (array of int) of every text, with the long columns `also` beside them."""

    def run(columns):
        c = codec(path, pattern)
        ids = [np.frombuffer(c.encode(t), dtype="<u4").astype("int32") for t in columns["text"]]
        return {"doc_id": columns["doc_id"], "ids": ids, **{k: columns[k] for k in also}}

    return map_documents(_rows(docs, *also), run, ", ".join(["doc_id long", "ids array<int>", *(f"{k} long" for k in also)]))


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and data (binary): the bytes of every id list; null ids give no bytes."""

    def run(columns):
        c = codec(path, pattern)
        return {"doc_id": columns["doc_id"], "data": [b"".join(map(c.bytes_of.__getitem__, ids or ())) for ids in columns["ids"]]}

    return map_documents(narrow(encoded, "doc_id", "ids"), run, "doc_id long, data binary")


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: both directions in one pass over the texts."""

    def run(columns):
        c = codec(path, pattern)
        packed = [c.encode(t) for t in columns["text"]]
        return {
            "doc_id": columns["doc_id"],
            "n_tokens": [len(p) // 4 for p in packed],
            "ids_sha256": [hashlib.sha256(p).hexdigest() for p in packed],
            "decoded_sha256": [hashlib.sha256(c.decode(p)).hexdigest() for p in packed],
        }

    return map_documents(_rows(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(docs: DataFrame, *also: str) -> DataFrame:
    return narrow(docs, "doc_id", "text", *also).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *also)


def query(spark, sf_dir: str) -> DataFrame:
    return digest_documents(read_table(spark, sf_dir, "documents"), *vocabulary())
