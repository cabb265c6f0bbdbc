"""The training-data operators against brute force, on hand-made rows and on a small data directory."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from cairn.llm import bpe, chat, fingerprint, mixing, near, pii, quality, repeats, tokencount, tokenfile
from cairn.llm.common import in_written_order
from cairn.llm.suffixes import neighbour_prefixes, previous_factors, suffix_order

EMPTY = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet consectetur " * 3000


def hard_rows():
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    words = [f"w{i}x" for i in range(300)]
    same = " ".join(words)
    close = " ".join([*words[:150], "changed", *words[151:]])
    rows = [
        (1, same, "en", "a", 3), (2, same, "en", None, 3), (3, close, None, "b", 3), (4, None, "en", "a", None), (5, "", "en", "a", 0),
        (6, "   \n ", "en", "b", 5), (7, LONG, "en", "a", 1), (8, "one two", "de", "c", 1), (8, "one two", "de", "c", 1), (None, "no id", "de", "c", 1), (9, "é 日本 🙂\nx\n", "fr", "a", 2),
    ]
    return rows


@pytest.fixture(scope="module")
def hard(spark):
    docs = spark.createDataFrame(hard_rows(), EMPTY)
    return docs.selectExpr(
        "*", "'t' AS TEXT", "'u' AS SOURCE", "5L AS Doc_ID", "1 AS key", "2 AS block", "'x' AS __bucket", "3 AS label", "4 AS start", "array(1) AS buckets",
        "'k' AS __key", "'h' AS __hash", "'t' AS __text", "'s' AS __slot", "6 AS c0", "7 AS row", "8 AS tie", "9 AS salt", "true AS stays",
    )


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EMPTY)


def sf_texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def compare_sql(spark, sf, query, sql, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    got = query(spark, sf)
    assert got.columns == names
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


# quality -------------------------------------------------------------------------------------------------------------


def test_quality_sql(spark, sf):
    compare_sql(spark, sf, quality.query, quality.ORACLE_SQL, "documents")


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(covered)


def test_quality_cases(hard, none):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_repeat_words) for r in quality.judge(hard).collect()}
    assert got == {(d, *brute_quality(t)) for d, t, *_ in hard_rows()}
    assert quality.judge(none).count() == 0 and quality.keep(none).count() == 0
    kept = quality.keep(hard)
    assert kept.columns == hard.columns and {r[0] for r in kept.collect()} == {1, 2, 3}
    assert {r[hard.columns.index("__text")] for r in kept.collect()} == {"t"}


def test_cascade_order_does_not_change_verdicts(hard):
    a = {(r.doc_id, r.kept) for r in quality.judge(hard).collect()}
    b = {(r.doc_id, r.kept) for r in quality.judge(hard, tuple(reversed(quality.RULES))).collect()}
    assert a == b


# byte-level BPE ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    path, pattern = bpe.vocabulary()
    return tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=bpe.codec(path, pattern).ranks, special_tokens={})


def test_bpe_equals_library(reference):
    codec = bpe.codec(*bpe.vocabulary())
    rng = random.Random(5)
    pool = ["a", "the", " ", "  ", "\n", "\t", "é", "日本", "🙂", "'s", "'", "12", ".", "!!", "\x1c", "​", "\xa0", "ing", "<|endoftext|>", "\x00", "ſ", "²", "_", "aaaa", "ation", "՘", "\U00011de0"]
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        packed = codec.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == reference.encode_ordinary(text), ascii(text)
        assert codec.decode(packed) == text.encode()
    long = "".join(rng.choice("abcdeth") for _ in range(50_000))
    assert np.frombuffer(codec.encode(long), "<u4").tolist() == reference.encode_ordinary(long)


def test_bpe_caches_change_speed_only(reference, monkeypatch):
    for name in ("WORD_ENTRIES", "PIECE_ENTRIES", "FIT_ENTRIES"):
        monkeypatch.setattr(bpe, name, 5)
    path, pattern = bpe.vocabulary()
    codec = bpe.BytePairCodec(reference._mergeable_ranks, pattern)
    rng = random.Random(6)
    pool = ["thing", "ation", "Élan", "ß", "ⅷ", "日本", "ΐ", ".", ",", "?!", "'s", "'", "12", "\n", "  ", " ", " ", " ", "²", "ſ", "ˮ", "ɐ", "\xaa", "\u1c89"]
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == reference.encode_ordinary(text), ascii(text)


def test_bpe_keeps_frequent_words_when_caches_fill(monkeypatch):
    path, pattern = bpe.vocabulary()
    codec, met = bpe.BytePairCodec(bpe.codec(path, pattern).ranks, pattern), Counter()
    encode = codec.encode_piece
    monkeypatch.setattr(codec, "encode_piece", lambda data: met.update([data]) or encode(data))
    digits = str.maketrans("0123456789", "qxzjkvwyhg")
    for at in range(0, 320_000, 1000):
        codec.encode("so whenceforthly " + " ".join(str(i).translate(digits) for i in range(at, at + 1000)) + " whenceforthly. Whenceforthly")
    assert met[b" whenceforthly"] == 1 and met[b" Whenceforthly"] == 1


def test_bpe_documents(spark, hard, none, reference):
    got = Counter((r.doc_id, tuple(r.ids)) for r in bpe.encode_documents(hard, *bpe.vocabulary()).collect())
    assert got == Counter((d, tuple(reference.encode_ordinary(t or ""))) for d, t, *_ in hard_rows())
    back = {(r.doc_id, bytes(r.data)) for r in bpe.decode_documents(bpe.encode_documents(hard, *bpe.vocabulary()), *bpe.vocabulary()).collect()}
    assert back == {(d, (t or "").encode()) for d, t, *_ in hard_rows()}
    digest = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe.digest_documents(hard, *bpe.vocabulary()).collect()}
    assert digest == {(d, len(reference.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in hard_rows()}
    assert bpe.digest_documents(none, *bpe.vocabulary()).count() == 0


# repeated strings ----------------------------------------------------------------------------------------------------


def brute_repeats(rows, length, first):
    seen = defaultdict(list)
    for k, text in enumerate(rows):
        for i in range(len(text) - length + 1):
            seen[text[i : i + length]].append((k, i))
    gone = [bytearray(len(t)) for t in rows]
    for places in seen.values():
        for k, i in (sorted(places)[1:] if first else places) if len(places) > 1 else ():
            gone[k][i : i + length] = b"\x01" * length
    return [bytes(x for x, g in zip(t, m) if not g) for t, m in zip(rows, gone)]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("most", [1, 200])
def test_repeats_brute_force(spark, monkeypatch, keep, most):
    monkeypatch.setattr(repeats, "GROUP_BLOCKS", most)
    rng = random.Random(most)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(130))
    texts = ["x" * 150, "ab " * 90, "", "short", "é" * 60]
    for _ in range(40):
        filler = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 90)))
        texts.append(filler() + (passage[rng.randint(0, 40) : 130 - rng.randint(0, 40)] if rng.random() < 0.7 else "") + filler())
    texts += texts[-3:]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in repeats.trimmed(docs, length=40, gram=10, keep=keep).collect()}
    assert [got[k] for k in range(len(texts))] == brute_repeats([t.encode() for t in texts], 40, keep == "first")


def brute_passages(texts, length):
    """Words of each text in windows of `length` words that another text holds too."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    windows = [[tuple(w[i : i + length]) for i in range(len(w) - length + 1)] for w in words]
    holders = Counter(x for own in windows for x in set(own))
    return [len({i + k for i, x in enumerate(own) if holders[x] > 1 for k in range(length)}) for own in windows]


@pytest.mark.parametrize("most", [1, 200])
def test_passages_brute_force(spark, sf, monkeypatch, most):
    monkeypatch.setattr(repeats, "GROUP_BLOCKS", most)
    rng = random.Random(most)
    word = lambda: rng.choice(["aa", "b", "c", "dé", "ee"])
    passage = [word() for _ in range(30)]
    texts = ["", "b " * 60, " ".join(["c"] * 40), "short"]
    for _ in range(40):
        part = passage[rng.randint(0, 8) : 30 - rng.randint(0, 8)] if rng.random() < 0.7 else []
        texts.append(rng.choice([" ", "\n"]).join([word() for _ in range(rng.randint(0, 25))] + part + [word() for _ in range(rng.randint(0, 25))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_passage_words for r in repeats.trimmed(docs, length=40, gram=10, passage_words=10).collect()}
    assert [got[k] for k in range(len(texts))] == brute_passages(texts, 10)
    if most > 1:
        all_texts = sorted(sf_texts(spark, sf).items())
        got = {r.doc_id: r.n_passage_words for r in repeats.query(spark, sf).collect()}
        assert [got[d] for d, _ in all_texts] == brute_passages([t for _, t in all_texts], 50)


def test_words_of_long_texts_go_in_pieces(monkeypatch):
    rng = random.Random(1)
    raw = "".join(rng.choice("ab \n") for _ in range(400)).encode() + b"x" * 100 + b" end"
    whole = repeats.word_hashes(raw)
    monkeypatch.setattr(repeats, "PIECE", 16)
    assert (repeats.word_hashes(raw) == whole).all() and len(whole) == len(raw.split())


def blocks_by_anchor(texts, length, gram):
    """The different blocks of texts by anchor, in order of first occurrence."""
    by = defaultdict(dict)
    for i, start, windows, lead, anchor, block in zip(*map(np.ndarray.tolist, repeats.text_blocks([np.frombuffer(t, dtype=np.uint8) for t in texts], length, gram)), strict=True):
        by[anchor].setdefault(block, {"windows": windows, "lead": lead, "context": texts[i][start : start + windows - 1 + length]})
    return [list(group.values()) for group in by.values()]


@pytest.mark.parametrize("length,gram", [(400, 100), (40, 10), (10, 4), (5, 4), (4, 4)])
def test_blocks_that_drop_out_match_nothing(length, gram):
    rng = random.Random(length)
    passages = [bytes(rng.choices(b"abcdef", k=n)) for n in (length // 2, length - 1, length, length + 7, 2 * length) for _ in range(3)]
    texts = [b"".join(rng.choice(passages) if rng.random() < 0.5 else bytes(rng.choices(b"abcdef", k=rng.randint(0, length))) for _ in range(8)) for _ in range(40)]
    dropped = 0
    for group in blocks_by_anchor(texts, length, gram):
        kept = repeats.meeting(group, length, gram, 1)
        dropped += len(group) - len(kept)
        stays = {id(r) for r in kept}
        windows = [{r["context"][k : k + length] for k in range(r["windows"])} for r in group]
        for i, r in enumerate(group):
            shares = any(windows[i] & w for j, w in enumerate(windows) if j != i)
            assert id(r) in stays or not shares
    assert dropped


def test_passages_under_the_length_take_no_suffix_order():
    rng = random.Random(3)
    passage = bytes(rng.choices(range(97, 123), k=320))
    texts = [bytes(rng.choices(range(97, 123), k=500)) + passage + bytes(rng.choices(range(97, 123), k=500)) for _ in range(50)]
    groups = [g for g in blocks_by_anchor(texts, 400, 100) if len(g) > 1]
    assert max(map(len, groups)) > 30 and not any(repeats.meeting(g, 400, 100, 1) for g in groups)


def test_repeats_cases(spark, sf, hard, none):
    texts = [(t or "").encode() for _, t, *_ in hard_rows()]
    got = Counter((r.doc_id, bytes(r.kept)) for r in repeats.trimmed(hard, length=40, gram=10).collect())
    assert got == Counter((d, k) for (d, *_), k in zip(hard_rows(), brute_repeats(texts, 40, False), strict=True))
    assert repeats.trimmed(none).count() == 0
    all_texts = sorted(sf_texts(spark, sf).items())
    want = brute_repeats([t.encode() for _, t in all_texts], 400, False)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in repeats.query(spark, sf).collect()}
    assert got == {d: (len(t.encode()), len(t.encode()) - len(k), hashlib.sha256(k).hexdigest()) for (d, t), k in zip(all_texts, want, strict=True)}


def test_previous_factors():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.randint(0, rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 50))]
        n = len(s)
        order, levels = suffix_order(np.array(s, dtype=np.int64), 64)
        lcp = neighbour_prefixes(order, levels)
        common = lambda i, j: next((d for d in range(n) if i + d >= n or j + d >= n or s[i + d] != s[j + d]), 0)
        assert order.tolist() == sorted(range(n), key=lambda i: s[i:])
        assert previous_factors(order, lcp).tolist() == [max([common(i, j) for j in range(i)], default=0) for i in range(n)]


# personal data -------------------------------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_pii(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0,
                "phone": lambda: 8 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans(spark, sf):
    rng = random.Random(3)
    pool = ["a", "@", "@", ".", "b-c", "1", "22", "255", "4111111111111111", " ", "-", "+", "+49", "(0)", "é", "%", "x.y", "_"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(5000)] + list(sf_texts(spark, sf).values())
    for text in texts:
        assert [s[:3] for s in pii.spans(text) if s[0] in pii.BASE] == brute_pii(text), text


def test_pii_added_spans_and_cases(hard, none):
    text = "bank account IBAN GB82 WEST 1234 5698 7654 32 and api token = 0cab398dc11d1a2a11dc6572c8df8bd228c864f3; ssn 123-45-6789"
    assert [s[0] for s in pii.spans(text)] == ["iban", "ssn", "secret"]
    assert pii.spans("GB82 WEST 1234 5698 7654 33") == [] and pii.spans("part 123-45-6789") == []
    assert pii.masked("write a@b.co or call +49 30 1234567!", pii.spans("write a@b.co or call +49 30 1234567!")) == "write <EMAIL> or call <PHONE>!"
    assert pii.digest(none).count() == 0
    out = pii.redact(hard)
    assert out.columns == hard.columns and out.count() == hard.count()
    assert {r.doc_id: r.text for r in out.collect()}[4] is None


# token counts --------------------------------------------------------------------------------------------------------


def test_token_counts(spark, hard, none, reference):
    rows = tokencount.count_sections(hard, *bpe.vocabulary()).collect()
    for d, t, *_ in hard_rows():
        mine = sorted({(r.section, r.start, r.end, r.n_tokens) for r in rows if r.doc_id == d})
        assert sum(r[3] for r in mine) == len(reference.encode_ordinary(t or ""))
        assert "".join((t or "")[r[1] : r[2]] for r in mine) == (t or "")
    assert tokencount.count_sections(none, *bpe.vocabulary()).count() == 0


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_section_counts_by_brute_force(spark, sf, reference, rule):
    """Every token of every text, byte by byte, given to one line by the rule."""
    texts = sf_texts(spark, sf) | {10**6 + k: t or "" for k, (_, t, *_) in enumerate(hard_rows())}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = Counter({(r.doc_id, r.section): r.n_tokens for r in tokencount.count_sections(docs, *bpe.vocabulary(), rule=rule).collect() if r.n_tokens})
    want = Counter()
    for d, t in texts.items():
        line_of, line = [], 0
        for byte in t.encode():
            line_of.append(line)
            line += byte == 10
        at = 0
        for piece in reference.decode_tokens_bytes(reference.encode_ordinary(t)):
            held = Counter(line_of[at : at + len(piece)])
            at += len(piece)
            want[d, {"start": min(held), "end": max(held), "majority": min(held, key=lambda x: (-held[x], x))}[rule]] += 1
    assert got == want


def test_counts_keep_frequent_words_when_caches_fill(reference, monkeypatch):
    path, pattern = bpe.vocabulary()
    codec, met = bpe.BytePairCodec(reference._mergeable_ranks, pattern), Counter()
    encode = codec.encode_piece
    monkeypatch.setattr(codec, "encode_piece", lambda data: met.update([data]) or encode(data))
    monkeypatch.setattr(tokencount, "codec", lambda *_: codec)
    letters = str.maketrans("0123456789", "qxzjkvwyhg")
    for at in range(0, 320_000, 1000):
        text = "so whenceforthly\n " + " ".join(str(i).translate(letters) for i in range(at, at + 1000)) + " whenceforthly.\nwords"
        counts = tokencount.counted(text, tokencount.lines(text), path, pattern, "majority")
        assert sum(counts) == len(codec.encode(text)) // 4
    assert sum(counts) == len(reference.encode_ordinary(text)) and met[b" whenceforthly"] == 1


def test_boundary_rules():
    starts, ends = np.array([0, 3]), np.array([3, 9])
    sections = np.array([4, 9])
    assert tokencount.attribute(starts, ends, sections, "start").tolist() == [2, 0]
    assert tokencount.attribute(starts, ends, sections, "end").tolist() == [1, 1]
    assert tokencount.attribute(starts, ends, sections, "majority").tolist() == [1, 1]
    assert tokencount.attribute(np.array([2]), np.array([6]), sections, "majority").tolist() == [1, 0]


def test_field_counts(spark, reference):
    df = spark.createDataFrame([("k", "title here", None, "body")], "id string, title string, sub string, body string")
    got = {r.field: r.n_tokens for r in tokencount.count_fields(df, "id", ["title", "sub", "body"], *bpe.vocabulary()).collect()}
    assert sum(got.values()) == len(reference.encode_ordinary("title here\n\nbody"))


# fingerprints --------------------------------------------------------------------------------------------------------


def test_fingerprints(spark, hard, none):
    got = fingerprint.with_next(hard).collect()
    rows = sorted(((d is not None, d or 0, t or "") for d, t, *_ in hard_rows()))
    want = []
    for k, (known, d, t) in enumerate(rows):
        changed = fingerprint.edited(t, rows[(k + 1) % len(rows)][2])
        want.append((d if known else None, len(t), hashlib.sha256(changed.encode()).hexdigest()))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(want)
    assert len({r.fingerprint for r in got}) == len({t for *_, t in rows})
    near = Counter()
    for k, (known, d, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][2]
        near[d if known else None, len(t), brute_likeness(t, fingerprint.edited(t, following)), brute_likeness(t, following)] += 1
    assert near == Counter((r.doc_id, r.n_chars, r.near_edited, r.near_next) for r in got)
    assert fingerprint.with_next(none).count() == 0


def brute_hash(s):
    """The hash of a span, by its polynomial."""
    high, low = (sum((ord(c) + 1) * pow(base, i, prime) for i, c in enumerate(s)) % prime for prime, base in zip(fingerprint.PRIMES, fingerprint.BASES, strict=True))
    return high << 31 | low


def brute_likeness(a, b):
    sides = []
    for t in (a, b):
        spans = {t[i : i + fingerprint.SPAN] for i in range(max(1, len(t) - fingerprint.SPAN + 1))} if t else set()
        hashes = sorted(int(h) for h in fingerprint.mixed(np.array([brute_hash(s) for s in spans], dtype=np.uint64)))
        least = {}
        for h in hashes:
            least.setdefault(h >> 58, h & 0xFFFF | 1)
        sides.append(least)
    either = sides[0].keys() | sides[1].keys()
    return sum(sides[0].get(k) == sides[1].get(k) for k in either) / len(either) if either else 1.0


def test_likeness_follows_shared_spans():
    """Over random edits the likeness is near the share of spans that both texts hold."""
    rng = random.Random(5)
    errors = []
    for _ in range(60):
        a = "".join(rng.choice("abcdefghij") for _ in range(1500))
        cut = rng.randrange(1500)
        b = a[:cut] + "".join(rng.choice("abcdefghij") for _ in range(1500 - cut))
        left, right = ({t[i : i + 8] for i in range(len(t) - 7)} for t in (a, b))
        errors.append(fingerprint.likeness(fingerprint.Print(a).sketch, fingerprint.Print(b).sketch) - len(left & right) / len(left | right))
    assert max(map(abs, errors)) < 0.25 and abs(sum(errors) / len(errors)) < 0.05


def test_prefix_hash():
    rng = random.Random(4)
    a, b = ("".join(rng.choice("ab") for _ in range(300)) for _ in range(2))
    ha, hb = fingerprint.PrefixHash(a), fingerprint.PrefixHash(b)
    for _ in range(300):
        i, j = rng.randrange(300), rng.randrange(300)
        n = rng.randint(0, 300 - max(i, j))
        assert fingerprint.equal_spans(ha, i, hb, j, n) == (a[i : i + n] == b[j : j + n])
        want = next((k for k in range(300) if i + k >= 300 or j + k >= 300 or a[i + k] != b[j + k]), 0)
        assert fingerprint.common_extension(ha, i, hb, j) == want


# mixing --------------------------------------------------------------------------------------------------------------


def test_schedule_deviates_by_less_than_a_block():
    weights = {"a": 5, "b": 3, "c": 2}
    blocks = {"a": 100, "b": 40, "c": 31}
    order = brute_schedule(blocks, weights)
    assert Counter(order) == blocks
    left, done, began, active = dict(blocks), Counter(), 0, set(blocks)
    for t, s in enumerate(order):  # in every phase, until its last source ends
        done[s] += 1
        total = sum(weights[x] for x in active)
        assert all(abs(done[x] - Fraction(weights[x] * (t + 1 - began), total)) < 1 for x in active)
        left[s] -= 1
        if not left[s]:
            active.discard(s)
            done, began = Counter(), t + 1


def brute_schedule(blocks, weights):
    """The source of every slot, slot by slot over the whole schedule: of the released blocks the one that is due first."""
    order, left = [], {s: n for s, n in blocks.items() if n}
    while left:
        total, began, done = sum(weights[s] for s in left), len(order), dict.fromkeys(left, 0)
        while all(left.values()):
            t = len(order) - began
            due = lambda s, i: -(-i * total // weights[s])  # noqa: B023, E731
            ready = [(due(s, done[s] + 1), due(s, done[s] + 2), s) for s in left if done[s] * total // weights[s] <= t]
            s = min(ready)[2]
            order.append(s)
            done[s] += 1
            left[s] -= 1
        left = {s: n for s, n in left.items() if n}
    return order


@pytest.mark.parametrize("seed", range(20))
def test_phases_are_the_whole_schedule(seed):
    rng = random.Random(seed)
    sources = "abcdefg"[: rng.randint(1, 7)]
    blocks = {s: rng.choice([0, 1, 3, 17, 60, 200]) for s in sources}
    weights = {s: rng.choice([1, 2, 4, 7, 30]) for s in sources}
    got = [p["order"][t % len(p["order"])] for p in mixing.phases(blocks, weights) for t in range(p["length"])]
    assert got == brute_schedule(blocks, weights)


@pytest.mark.parametrize("weights", [None, {"a": 5, "b": 2, None: 3}])
def test_positions_by_brute_force(spark, weights):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, "d"]), f"text {i}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.place(docs, weights, block_rows=4).collect()
    counts = Counter(s for _, s, _ in rows)
    key = lambda s: "n" if s is None else f"s:{s}"
    given = mixing.default_weights({key(s): n for s, n in counts.items()}) if weights is None else {key(s): weights.get(s, 1) for s in counts}
    left, want = {key(s): n for s, n in counts.items()}, []
    for s in brute_schedule({k: -(-n // 4) for k, n in left.items()}, given):
        want += [s] * min(4, left[s])
        left[s] -= min(4, left[s])
    assert [key(r.source) for r in sorted(got, key=lambda r: r["__position"])] == want
    assert sorted(r["__position"] for r in got) == list(range(700)) and {r.doc_id for r in got} == set(range(700))
    in_source = defaultdict(list)
    for r in sorted(got, key=lambda r: r["__position"]):
        in_source[r.source].append(r["__block"])
    assert all(b == [k // 4 for k in range(len(b))] for b in in_source.values())


def test_place(spark, hard, none, monkeypatch):
    rows = mixing.place(hard).collect()
    assert sorted(r["__position"] for r in rows) == list(range(len(hard_rows())))
    assert mixing.mixed(hard).columns == hard.columns
    assert Counter(r[0] for r in mixing.mixed(hard).collect()) == Counter(d for d, *_ in hard_rows())
    assert mixing.mixed(none).count() == 0
    for bad in ({"a": 0}, {"a": 1.5}, {"a": 10**6, "b": 7}):
        with pytest.raises(ValueError):
            mixing.place(hard, bad)
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    with pytest.raises(ValueError):
        mixing.place(hard)


def test_place_is_the_same_rule_at_every_size(spark):
    """Blocks have one length, and a document's slot does not depend on how many documents follow in its phase."""
    few, many = (spark.range(n).selectExpr("id AS doc_id", "concat('s', id % 2) AS source", "'' AS text") for n in (400, 4000))
    for docs in (few, many):
        sizes = Counter((r.source, r["__block"]) for r in mixing.place(docs).collect())
        assert max(sizes.values()) == mixing.BLOCK_ROWS


# token files ---------------------------------------------------------------------------------------------------------


def test_token_files(spark, hard, none, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    manifest = tokenfile.write_shards(hard, path, f"file://{tmp_path}/shards")
    got = tokenfile.read_shards(spark, manifest).collect()
    rows = sorted(((d is not None, d or 0, t or "") for d, t, *_ in hard_rows()))
    want, at = [], 0
    for known, d, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        want.append((d if known else None, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert Counter(map(tuple, got)) == Counter(want)
    with open(manifest[0]["path"].removeprefix("file://"), "rb") as source:
        source.seek(0, 2)
        reader = tokenfile.ShardReader(source, source.tell())
        assert [len(p) // 4 for p in reader.lookup(8)] == [len(library.encode("one two").ids) + 1] * len(reader.lookup(8))
    assert tokenfile.read_shards(spark, tokenfile.write_shards(none, path, f"file://{tmp_path}/none")).count() == 0


def test_damaged_frames_are_noticed(tmp_path):
    with open(tmp_path / "s", "wb") as sink:
        writer = tokenfile.ShardWriter(sink)
        writer.add(1, b"abcd" * 100)
        writer.close()
    data = bytearray((tmp_path / "s").read_bytes())
    data[-13] ^= 1  # the frame's checksum in the seek table
    import io

    with pytest.raises(ValueError, match="checksum"):
        tokenfile.ShardReader(io.BytesIO(bytes(data)), len(data)).frame(0)


def test_fast_tokenizer_equals_library():
    import public_tokenizers

    mine = tokenfile.fast_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    pool = ["a", "the", " ", "  ", "\n", "é", "日本", "🙂", "'s", "12", ".", "!!", "\x1c", "\xa0", "ing", "<|endoftext|>", "\x00", "²", "ª", "_", "ation,", "word."]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert mine.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in mine.tokenizer.encode_batch(texts, add_special_tokens=False)]


# chat format ---------------------------------------------------------------------------------------------------------


def test_chat_sql(spark, sf):
    compare_sql(spark, sf, chat.query, chat.ORACLE_SQL, "conversations")


def test_chat_links(spark):
    call = json.dumps({"tool_calls": [{"id": "x", "name": "search", "arguments": {"query": "q", "limit": 0}}, {"id": "y", "name": "search", "arguments": '{"query":"é"}'}, {"id": "z", "name": "none"}]})
    rows = [(1, 0, "user", "hi"), (1, 1, "tool", json.dumps({"tool_call_id": "x", "content": {"b": 1, "a": [2]}})), (1, 2, "assistant", call), (1, 3, "tool", json.dumps({"tool_call_id": "q", "content": "c"})), (2, 0, None, None), (3, 1, "assistant", "{bad"), (3, 1, "assistant", "{bad"), (None, None, "user", "[" * 5000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS calls", "2 AS message")
    done = chat.formatted(turns, chat.TOOLS)
    got = {(r.conv_id, r.turn): r for r in done.collect()}
    assert done.count() == len(rows)
    assert (got[1, 2].n_calls, got[1, 2].n_linked, got[1, 2].n_invalid) == (3, 1, 2)
    assert (got[1, 1].call_turn, got[1, 1].order_turn, got[1, 1].order_level, got[1, 1].orphan) == (2, 2, 1, False)
    assert got[1, 3].orphan and not got[1, 0].orphan
    texts = {r.conv_id: [m["role"] for m in json.loads(r.chat)] for r in chat.assemble(done).collect()}
    assert texts[1] == ["user", "assistant", "tool", "tool"]
    assert chat.formatted(turns.limit(0)).count() == 0


def test_chat_numbers_and_surrogates(spark):
    long = "x" * 300_000
    texts = [
        json.dumps({"tool_calls": [{"id": "a", "name": "search", "arguments": '{"query": "q", "limit": 1e999}'}]}),
        '{"tool_calls": [{"id": "b", "name": "search", "arguments": {"query": "q", "limit": 1e999}}]}',
        '{"tool_calls": [{"id": "c\\ud800", "name": "\\udfff", "arguments": {"query": "\\ud83d"}}]}',
        '{"tool_call_id": "c\\ud800", "content": "\\ud800"}', '{"tool_call_id": "c\\ud800", "content": NaN}', None, "", long, "[1]",
    ]
    rows = [(None if k == 5 else 1, k, "tool" if k in (3, 4) else "assistant", t) for k, t in enumerate(texts)]
    got = {r.turn: r for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chat.TOOLS).collect()}
    assert [got[k].n_calls for k in range(4)] == [0, 0, 1, 0] and got[2].n_linked == 1 and got[2].n_invalid == 1
    assert got[3].call_turn == 2 and json.loads(got[3].message)["content"] == "\ud800" and got[4].answers_id is None
    assert json.loads(got[7].message)["content"] == long and json.loads(got[5].message)["content"] == ""


def brute_chat(rows):
    """For each row (by its number) the links, straight from the JSON: n_calls, n_linked, n_invalid, call_turn, orphan."""
    calls, results = [], []
    for at, (conv, turn, role, text) in enumerate(rows):
        value = json.loads(text) if text.startswith("{") else {}
        if role == "assistant":
            calls += [(conv, turn, place, c["id"], c, at) for place, c in enumerate(value.get("tool_calls", []))]
        elif role == "tool":
            results.append((conv, value["tool_call_id"], at))
    out = []
    for at, (conv, turn, role, _) in enumerate(rows):
        own = [c for c in calls if c[5] == at]
        linked = {c[3] for c in calls if (c[0], c[1]) == (conv, turn) and any(r[:2] == (conv, c[3]) for r in results)} if own else set()
        bad = sum(c[4]["name"] not in chat.TOOLS or not isinstance(c[4]["arguments"].get("query"), str) or "more" in c[4]["arguments"] for c in own)
        call_turn = None
        for r in results:
            if r[2] == at:
                call_turn = min(((c[1], c[2]) for c in calls if (c[0], c[3]) == r[:2]), default=(None,))[0]
        out.append((conv, turn, role, len(own), len(linked), bad, call_turn, role == "tool" and call_turn is None))
    return Counter(out)


def test_chat_brute_force(spark):
    """Generated conversations with calls, answers before and after them, orphans, ids that are used twice, and repeated rows."""
    rng = random.Random(6)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 14)):
            kind = rng.random()
            if kind < 0.35:
                names = ["search", "search", "nothing"]
                made = [{"id": f"c{rng.randint(0, 6)}", "name": rng.choice(names), "arguments": rng.choice([{"query": "q"}, {"query": 1}, {}, {"query": "é", "more": 2}])} for _ in range(rng.randint(1, 3))]
                rows.append((conv, turn, "assistant", json.dumps({"tool_calls": made})))
            elif kind < 0.7:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": f"c{rng.randint(0, 8)}", "content": {"b": turn}})))
            else:
                rows.append((conv, turn, rng.choice(["user", "assistant"]), f"plain {turn}"))
    rows += rows[:20]
    got = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chat.TOOLS).collect()
    assert Counter((r.conv_id, r.turn, r.role, r.n_calls, r.n_linked, r.n_invalid, r.call_turn, r.orphan) for r in got) == brute_chat(rows)
    assert all(r.order_turn == max(r.turn, r.call_turn or 0) and r.order_level == (r.call_turn is not None) for r in got)
    assert sum(r.n_linked for r in got) > 50 and sum(r.orphan for r in got) > 10


def test_schema_violations():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "items": {"enum": ["x"]}}}, "additionalProperties": False}
    assert chat.violations({"a": 1, "b": ["x"]}, schema) == []
    assert chat.violations({"a": True, "b": ["y"], "c": 1}, schema) == ["$.a: not integer", "$.b[0]: not in enum", "$.c: not allowed"]
    assert chat.violations({}, schema) == ["$.a: missing"] and chat.violations([], schema) == ["$: not object"]
    either = {"type": ["string", "null"]}
    assert chat.violations(None, either) == chat.violations("x", either) == [] and chat.violations(1, either) == ["$: not string or null"]
    assert chat.violations(1, True) == [] and chat.violations(1, False) == ["$: not allowed"]
    assert chat.violations({"a": 1, "b": 2}, {"properties": {"a": False}, "additionalProperties": {"type": "string"}}) == ["$.a: not allowed", "$.b: not string"]
    assert chat.violations(True, {"enum": [1]}) == ["$: not in enum"] and chat.violations(1.0, {"enum": [True, 1]}) == [] and chat.violations([{"x": 0}], {"enum": [[{"x": False}]]}) == ["$: not in enum"]
    assert chat.violations(5, {"minimum": 2, "maximum": 4}) == ["$: out of range"]


@pytest.mark.parametrize("schema", [{"type": "text"}, {"type": ["string", 3]}, {"minimum": "1"}, {"maximum": True}, {"enum": "abc"}, {"required": "a"}, {"properties": []}, {"properties": {"a": {"type": "x"}}}, {"items": [1]}, 7, None])
def test_schemas_that_cannot_be_judged_are_an_error_before_the_job(spark, schema):
    with pytest.raises(ValueError):
        chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), {"f": schema})


def test_tool_calls_with_any_schema_and_without_a_conversation(spark):
    call = lambda **a: json.dumps({"tool_calls": [{"id": "1", "name": "f", "arguments": a}]})
    answer = json.dumps({"tool_call_id": "1", "content": "ok"})
    rows = [(1, 1, "assistant", call(q=None)), (1, 2, "tool", answer), (None, 1, "assistant", call(q="x")), (None, 2, "tool", answer), (2, None, "assistant", call(q=3)), (2, 1, "tool", answer)]
    got = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"f": {"properties": {"q": {"type": ["string", "null"]}}}}).collect()
    assert {(r.conv_id, r.turn): (r.n_calls, r.n_linked, r.n_invalid, r.orphan) for r in got} == {
        (1, 1): (1, 1, 0, False), (1, 2): (0, 0, 0, False), (None, 1): (1, 0, 0, False), (None, 2): (0, 0, 0, True), (2, None): (1, 0, 1, False), (2, 1): (0, 0, 0, True),
    }


# near duplicates -----------------------------------------------------------------------------------------------------


def brute_classes(texts):
    """Least id of each text's class, by all pairs."""
    seqs = {}
    for d, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        count, seq = Counter(), []
        for i in range(max(min(1, len(words)), len(words) - 4)):
            s = tuple(words[i : i + 5])
            seq.append((s, count[s]))
            count[s] += 1
        seqs[d] = seq
    parent = {d: d for d in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = seqs[a], seqs[b]
            if texts[a] != texts[b]:
                at = {s: k for k, s in enumerate(y)}
                places = [at[s] for s in x if s in at]
                if 9 * len(places) < 4 * (len(x) + len(y)) or not places:
                    continue
                tails = []
                from bisect import bisect_left

                for p in places:
                    k = bisect_left(tails, p)
                    tails[k : k + 1] = [p]
                if len(tails) / (len(x) + len(y) - len(tails)) < 0.8:
                    continue
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {d: root(d) for d in ids}


def variants(seed):
    rng = random.Random(seed)
    texts, k = {}, 0
    for _ in range(12):
        base = [f"v{rng.randint(0, 5000)}" for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = f"n{rng.randint(0, 9999)}"
            texts[k] = " ".join(words)
            k += 1
    texts[k], texts[k + 1], texts[k + 2] = "one two", "one two", "one two three"
    return texts


def test_near_classes(spark, sf, hard, none):
    for texts in (variants(1), variants(2), sf_texts(spark, sf)):
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        assert {r.doc_id: r.class_id for r in near.classes(docs).collect()} == brute_classes(texts)
    got = {(r.doc_id, r.class_id) for r in near.classes(hard).collect()}
    assert {(1, 1), (2, 1), (3, 1), (8, 8), (4, 4), (5, 4), (6, 6), (None, None)} <= got
    kept = near.deduplicated(hard)
    assert kept.columns == hard.columns
    assert Counter(r[0] for r in kept.collect()) == Counter([1, 4, 6, 7, 8, None, 9])
    assert {r[hard.columns.index("__key")] for r in kept.collect()} == {"k"}
    assert near.classes(none).count() == 0 and near.deduplicated(none).count() == 0


def aligned_share(a, b):
    """Similarity of two texts by labelled five-word shingles and a longest increasing run, from the words themselves."""
    from bisect import bisect_left

    def labelled(text):
        words, seen = text.split(), Counter()
        out = {}
        for i in range(len(words) - 4):
            w = tuple(words[i : i + 5])
            out[w, seen[w]] = i
            seen[w] += 1
        return out

    x, y = labelled(a), labelled(b)
    ends = []
    for place in (y[k] for k in x if k in y):
        at = bisect_left(ends, place)
        ends[at : at + 1] = [place]
    return len(ends) / (len(x) + len(y) - len(ends))


def test_recall_on_a_thousand_pairs_just_above_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.85, each of words of its own, and as many just below: all of the first meet, none of the others."""
    rng, pairs = random.Random(17), {True: [], False: []}
    while min(map(len, pairs.values())) < 1100:
        n = rng.choice([40, 60, 120, 300, 700])
        words = [f"w{rng.randrange(10**8)}" for _ in range(n)]
        other = list(words)
        for _ in range(max(1, round(n * rng.uniform(0.018, 0.045)))):
            at = rng.randrange(len(other))
            other[at : at + 1] = rng.choice([[f"n{rng.randrange(10**8)}"], [], [other[at], f"n{rng.randrange(10**8)}"]])
        a, b = " ".join(words), " ".join(other)
        share = aligned_share(a, b)
        if 0.75 < share < 0.85 and len(pairs[share >= 0.8]) < 1100:
            pairs[share >= 0.8].append((a, b))
    texts = [t for own in pairs.values() for pair in own for t in pair]
    found = {r.doc_id: r.class_id for r in near.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[2 * i] == found[2 * i + 1] for i in range(2200)] == [True] * 1100 + [False] * 1100


def test_short_texts_meet(spark):
    """Pairs of 4 against 5 and of 8 against 10 symbols, at similarity 0.8 exactly, all share a bucket."""
    rng = random.Random(3)
    for n, m in ((8, 9), (12, 14), (12, 13)):
        for _ in range(300):
            words = [f"w{rng.randrange(10**9)}" for _ in range(m)]
            a, b = near.buckets_of([" ".join(words[:n]), " ".join(words)])
            assert set(a.tolist()) & set(b.tolist())


def test_joined_spread(spark):
    from cairn.llm.common import joined_spread

    rows = spark.createDataFrame([("hot", i) for i in range(50)] + [("b", 1), ("none", 2), (None, 3)], "k string, v long")
    side = spark.createDataFrame([("hot", 50, "h"), ("b", 1, "x"), ("c", 0, "y")], "k string, n long, w string")
    got = Counter((r.k, r.v, r.w) for r in joined_spread(rows, side, "k", "n", over=10).collect())
    assert got == Counter([("hot", i, "h") for i in range(50)] + [("b", 1, "x")])


def test_chunks_in_any_order_give_near_pairs_only():
    """Keys belong to the texts that were compared, in whatever order either side of a join gathers its rows."""
    rng = random.Random(4)
    rows = []
    for g in range(6):
        base = [f"b{g}_{i}" for i in range(120)]
        for _ in range(5):
            words = list(base)
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
            text = " ".join(words)
            key = hashlib.md5(text.encode()).digest()
            rows.append({"key": key, "label": key, "text": text})
    texts = {r["key"]: near.symbols([r["text"]])[0] for r in rows}
    want = None
    for _ in range(5):
        rng.shuffle(rows)
        other = rng.sample(rows, len(rows))
        links = near.chunk_links(rows, rows, True)
        assert links and all(near.near(texts[a], texts[b]) for a, b in links + near.chunk_links(rows[:15], other[:15], False))
        parts = {k: k for k in texts}
        for a, b in links:
            low, high = sorted((parts[a], parts[b]))
            parts = {k: low if v == high else v for k, v in parts.items()}
        assert want in (None, parts)
        want = parts


def test_large_group_of_variants(spark):
    """Many variants of one text that are near to it and not to each other, in large buckets: one class."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(400)]
    texts = {0: " ".join(base)}
    for k in range(1, 120):
        words = list(base)
        for _ in range(6):
            words[rng.randrange(400)] = f"n{k}_{rng.randint(0, 10**6)}"
        texts[k] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near.classes(docs).collect()} == brute_classes(texts)


# pipeline ------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf, reference):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.ORACLE_SQL}) WHERE kept").fetchall()}
    texts = {d: t for d, t in sf_texts(spark, sf).items() if d in good}
    classes = brute_classes(texts)
    want = {d: tuple(reference.encode_ordinary(pii.masked(t, pii.spans(t)))) for d, t in texts.items() if classes[d] == d}
    assert {r.doc_id: tuple(r.ids) for r in corpus_pipeline.run(spark, sf).collect()} == want
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name


@pytest.mark.parametrize("most", [None, 20])
def test_pipeline_positions_are_those_of_the_mix(spark, sf, monkeypatch, most):
    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    want = {r.doc_id: r["__position"] for r in mixing.place(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "20000"} | ({"spark.sql.files.maxRecordsPerFile": str(most)} if most else {})
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = {r.doc_id: r.position for r in corpus_pipeline.run(spark, sf).collect()}
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert got == want and sorted(got.values()) == list(range(len(want)))


CLASHES = ["position", "position_file", "position_row", "_metadata", "__metadata", "a.b", "file", "row", "c0", "n", "start", "ids", "__key", "__hash", "__text", "slot", "label", "block", "key"]


def test_stages_take_any_further_columns(spark, sf, tmp_path):
    """Each stage, and then the last, on files whose columns have awkward names and whose rows are hard."""
    import corpus_pipeline

    docs = spark.createDataFrame([(*r, *("x" for _ in CLASHES)) for r in hard_rows()], f"{EMPTY}, " + ", ".join(f"`{c}` string" for c in CLASHES))
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = stage(spark, spark.read.parquet(f"{tmp_path}/{name}"), sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == [*EMPTY.replace(",", "").split()[::2], *CLASHES]
    got = docs.collect()
    assert {r.doc_id for r in got} == {1, 3} or {r.doc_id for r in got} == {1}
    assert sorted(r.position for r in got) == list(range(len(got)))


def test_files_of_other_writers_have_no_order(spark, tmp_path):
    import pandas as pd

    pd.DataFrame({"doc_id": [1], "text": ["x"]}).to_parquet(tmp_path / "mine.parquet")
    with pytest.raises(Exception, match="order of writing"):
        in_written_order(spark.read.parquet(str(tmp_path)), "position").collect()


def test_pii_long_secrets_and_ibans_before_capitals():
    def found(text):
        return [(k, text[a:b]) for k, a, b, _ in pii.spans(text) if k in ("iban", "secret")]

    for n in (10, 100, 101, 5000):
        assert found(f"token: {'a1' * n}.") == [("secret", "a1" * n)]
    assert found(f"token {'-' * 30}{'b2' * 150} {'c3' * 150}") == [("secret", "-" * 30 + "b2" * 150)]
    assert found(f"key {'x' * 300} {'key' * 50_000}") == found(f"key {'1' * 300}") == []
    spanish, german = "ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00"
    for tail in ("", " EUR", " BANK", " BANK EUR", " A", "."):
        assert found(f"IBAN {spanish}{tail}") == [("iban", spanish)]
    assert found(f"{spanish} {german} {spanish} EUR") == [("iban", spanish), ("iban", german), ("iban", spanish)]
    assert found(f"AB12 CDEF GHIJ {german} EUR") == [("iban", german)]
    assert found("ES91 2100 0418 4502 0005 1333 EUR") == []
