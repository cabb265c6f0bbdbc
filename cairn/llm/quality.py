"""Quality rules as a short-circuit cascade, in DataFrame and SQL functions only.

Each rule is a SQL predicate over the text (true: reject). `plan_cascade` estimates every rule's rejection rate
and cost on a sample; `cascade` then evaluates the rules in order of rejection per cost inside one CASE, which
stops at the first rule that rejects. The verdict does not depend on the order, only the work does.

Defined cases: a null text has no words, so it is rejected as too short; an empty table gives an empty result;
repeated rows are judged one by one; other columns are kept as they are, whatever their names. Repeated windows are found by
64-bit hashes of the words of one text; equal windows always meet, and two different windows of one text meet by
chance about once in 10^11 texts of 20,000 words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import narrow, numbered, read_table, text_or_empty

SPACE = r"[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Signals in terms of __text (never null), __words, __windows and the signals before them.
WORDS = f"array_remove(split(__text, '{SPACE}+'), '')"
WINDOWS = f"""element_at(transform(array(transform(__words, w -> xxhash64(w))), h ->
    CASE WHEN size(h) < {WINDOW} THEN cast(array() AS array<bigint>)
    ELSE transform(sequence(1, size(h) - {WINDOW - 1}), i -> xxhash64({', '.join(f'h[i + {k}]' for k in range(-1, WINDOW - 1))})) END), 1)"""
WORD_CHARS = "char_length(array_join(__words, ''))"
N_SYMBOLS = f"size(regexp_extract_all(__text, '[{SYMBOLS}]', 0))"
N_UPPER = r"size(regexp_extract_all(__text, '\\p{Lu}', 0))"
LINES = rf"filter(split(__text, '\\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"
N_DUP_LINES = "element_at(transform(array(__lines), l -> size(l) - size(array_distinct(l))), 1)"
#: Words covered by windows that occur twice or more: sort the windows with their places, keep the places of those
#: with an equal neighbour, and add up what each place covers before the next one begins.
N_REPEAT_WORDS = f"""CASE WHEN size(array_distinct(__windows)) = size(__windows) THEN 0 ELSE
    element_at(transform(array(sort_array(transform(__windows, (x, i) -> named_struct('h', x, 'p', i)))), s ->
    element_at(transform(array(sort_array(transform(filter(s, (e, k) ->
        coalesce(e.h = get(s, k - 1).h, false) OR coalesce(e.h = get(s, k + 1).h, false)), e -> e.p))), p ->
    aggregate(transform(p, (v, k) -> least({WINDOW}, coalesce(get(p, k + 1) - v, {WINDOW}))), 0, (a, b) -> a + b)), 1)), 1) END"""


@dataclass(frozen=True)
class Rule:
    """A named SQL predicate over the signals; `needs` are the signals it reads, in order of evaluation."""

    name: str
    rejects: str
    needs: tuple[str, ...]


SIGNALS = {
    "__words": WORDS,
    "__windows": WINDOWS,
    "__lines": LINES,
    "n_words": "cast(size(__words) AS bigint)",
    "word_chars": f"cast({WORD_CHARS} AS bigint)",
    "n_symbols": f"cast({N_SYMBOLS} AS bigint)",
    "n_upper": f"cast({N_UPPER} AS bigint)",
    "n_lines": "cast(size(__lines) AS bigint)",
    "n_dup_lines": f"cast({N_DUP_LINES} AS bigint)",
    "n_repeat_words": f"cast({N_REPEAT_WORDS} AS bigint)",
}

#: What a signal costs, in nanoseconds for each character, word or line, as measured once on prose; LEAST_COST is that of a comparison.
COSTS = {
    "__words": (60, "char"), "__windows": (250, "word"), "__lines": (25, "char"), "n_words": (0, "word"), "word_chars": (15, "word"), "n_symbols": (15, "char"),
    "n_upper": (30, "char"), "n_lines": (0, "line"), "n_dup_lines": (60, "line"), "n_repeat_words": (400, "word"),
}
LEAST_COST = 20.0

RULES = (
    Rule("too_short", "n_words < 10", ("__words", "n_words")),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words", ("__words", "n_words", "__windows", "n_repeat_words")),
    Rule("symbols", "10 * n_symbols > n_words", ("__words", "n_words", "n_symbols")),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words", ("__words", "n_words", "word_chars")),
    Rule("capitals", "10 * n_upper > 3 * word_chars", ("__words", "word_chars", "n_upper")),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines", ("__lines", "n_lines", "n_dup_lines")),
)
BASE_RULES = ("too_short", "repeated_words")


def with_signals(df: DataFrame, needed: tuple[str, ...] | list[str]) -> DataFrame:
    """`df`, which has __text, with the signals `needed`, arrays first so that none is computed twice."""
    for level in (("__words", "__lines"), ("__windows",), tuple(c for c in SIGNALS if not c.startswith("__"))):
        now = {c: F.expr(SIGNALS[c]) for c in level if c in needed}
        if now:
            df = df.withColumns(now)
    return df


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, seed: int = 7, given: tuple[str, ...] = ()) -> list[dict]:
    """Rules in order of rejection per cost: [{rule, rejection, cost}], by one pass over about `sample_rows` rows.

    A rule's cost is that of the signals it needs and `given` does not hold, in units of COSTS by the sample's mean
    numbers of characters, words and lines. Only the order of evaluation depends on the sample; verdicts do not. An
    empty table keeps the given order.
    """
    total = docs.count()  # of Parquet files the footers are read for it
    if not total:
        return [{"rule": r, "rejection": 0.0, "cost": LEAST_COST} for r in rules]
    sample = docs.select("__text").sample(fraction=min(1.0, sample_rows / total), seed=seed)
    seen = with_signals(sample, tuple(dict.fromkeys(c for r in rules for c in r.needs)) + ("__words", "__lines"))
    hits = [F.count_if(F.expr(r.rejects)).alias(f"r{i}") for i, r in enumerate(rules)]
    row = seen.agg(F.count("*").alias("n"), F.avg(F.length("__text")).alias("char"), F.avg(F.size("__words")).alias("word"), F.avg(F.size("__lines")).alias("line"), *hits).first()
    found = []
    for i, r in enumerate(rules):
        cost = sum(price * (row[unit] or 0.0) for c in r.needs if c not in given for price, unit in [COSTS[c]])
        found.append({"rule": r, "rejection": row[f"r{i}"] / max(1, row["n"]), "cost": max(LEAST_COST, cost)})
    return sorted(found, key=lambda x: -x["rejection"] / x["cost"])


def cascade(rules: list[Rule] | tuple[Rule, ...]) -> Column:
    """The name of the first rule that rejects, or null: one CASE, so later rules run only on rows that pass earlier ones."""
    return F.expr("CASE " + " ".join(f"WHEN {r.rejects} THEN '{r.name}'" for r in rules) + " END")


def inlined(rule: Rule) -> str:
    """The rule's predicate over __text alone, each signal computed where it stands, so a CASE can skip it whole."""
    inner = {c: SIGNALS[c] for c in SIGNALS}
    text = rule.rejects
    shown = [c for c in inner if not c.startswith("__") and c in rule.needs]
    arrays = [c for c in ("__words", "__lines", "__windows") if c in rule.needs]
    fields = ", ".join(f"'{c}', {inner[c]}" for c in shown)
    body = f"exists(array(named_struct({fields})), q -> {_qualified(text, shown, 'q')})"
    for c in reversed(arrays):  # bind each array once
        body = f"exists(array({inner[c]}), {c} -> {body})"
    return body


def _qualified(text: str, names: list[str], by: str) -> str:
    for n in sorted(names, key=len, reverse=True):
        text = " ".join(f"{by}.{n}" if w == n else w for w in text.split(" "))
    return text


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """`docs` (doc_id, text) with all base signals, base_failed and kept: every document, kept or not."""
    rows = narrow(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("__text"))
    signals = ("__words", "__lines", "__windows", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    later = tuple(r for r in rules if r.name not in BASE_RULES)
    extra = [x["rule"] for x in plan_cascade(rows, later, sample_rows, given=signals)]  # every row has the base signals: only others cost
    judged = with_signals(rows, signals).withColumn("base_failed", F.expr(" OR ".join(r.rejects for r in rules if r.name in BASE_RULES)))
    inline = {c: SIGNALS[c] for c in SIGNALS if c not in (*signals, "n_lines")} | {"n_lines": "size(__lines)"}  # what only some rows need stands inside the CASE
    verdict = " ".join(f"WHEN {' '.join(inline.get(w, w) for w in r.rejects.split(' '))} THEN false" for r in extra)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.expr(f"CASE WHEN base_failed THEN false {verdict} ELSE true END").alias("kept"),
    )


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """The rows of `docs` that no rule rejects, all their columns unchanged; the cascade alone decides, in planned order."""
    plain, places, at = numbered(docs)
    rows = plain.withColumn("__text", text_or_empty(at["text"]))
    order = [x["rule"] for x in plan_cascade(rows, rules, sample_rows)]
    verdict = F.expr("CASE " + " ".join(f"WHEN {inlined(r)} THEN '{r.name}'" for r in order) + " END")
    return rows.where(verdict.isNull()).select(*places).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win),
cov AS (SELECT doc_id, sum(least(5, coalesce(nx - i, 5))) AS n
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM rep WHERE c >= 2) GROUP BY doc_id),
s AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words
            OR word_chars > 15 * n_words OR 10 * n_upper > 3 * word_chars OR 2 * n_dup_lines > n_lines) AS kept
FROM s
"""
