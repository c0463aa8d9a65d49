"""Quality rules as a short-circuit cascade of SQL expressions.

Every rule is a Boolean column that is true where a text is rejected. On a
sample each rule's cost is measured (seconds of a warm run less those of a run
without a rule), and which rules reject which texts together. The cascade takes
the rule with the most rejections per second first, then the one with the most
among the texts that are left, and so on. A later rule is not evaluated for a
row that an earlier one rejects. The verdict is the same in any order: a text is
kept if no rule rejects it.

Defined results: a null text counts as empty, has no words and fails the base
test (under 50 words). Repeated rows, null ids and further columns of any name
pass through. An empty table stays empty; its rules keep their given order.
Texts are judged whole: one of more than 2 ** 24 words has its windows compared as
strings, as has one in which different windows share a hash, with the same counts.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS

#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 2000
#: Tasks that measure on it.
SAMPLE_TASKS = 8
#: Bits of a window's number that hold its position; the others hold its hash.
POSITION_BITS = 24
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE_CLASS}+"), "")


def _only(text: Column, keep: str) -> Column:
    """Number of characters of a class."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", ""))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CLASS))


def n_symbols(text: Column) -> Column:
    return _only(text, SYMBOLS)


def n_dup_lines(text: Column) -> Column:
    lines = _lines(text)
    return F.size(lines) - F.size(F.array_distinct(lines))


@dataclass(frozen=True)
class Rule:
    """``rejects(text, words, n_words)`` is true where the text is rejected."""

    name: str
    rejects: Callable[[Column, Column, Column], Column]


RULES = (
    Rule("symbols", lambda text, words, n: n_symbols(text) * 10 > n),
    Rule("shouting", lambda text, words, n: _only(text, "\\p{Lu}") * 2 > _only(text, "\\p{L}")),
    Rule("exclamations", lambda text, words, n: _only(text, "!") * 2 > n),
    Rule("few letters", lambda text, words, n: _only(text, "\\p{L}") * 2 < F.length(F.array_join(words, ""))),
    Rule(
        "word length",
        lambda text, words, n: ~F.length(F.array_join(words, "")).between(2 * n, 15 * n),
    ),
    Rule("repeated lines", lambda text, words, n: n_dup_lines(text) * 2 > F.size(_lines(text))),
    Rule("few distinct words", lambda text, words, n: F.size(F.array_distinct(words)) * 10 < n),
)


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names that ``docs`` does not have."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def base_facts(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """Adds words and base counts; returns the frame and the names in use."""
    keys = ["text", "words", "n_words", "windows", "twice", "clash", "sorted", "at", "n_repeat_words", "base_failed"]
    c = dict(zip(keys, _fresh(docs, *[f"quality_{k}" for k in keys]), strict=True))
    q = {k: F.col(v) for k, v in c.items()}
    out = docs.select("*", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(c["text"]))
    out = out.select("*", words_of(q["text"]).alias(c["words"]))
    out = out.select("*", F.size(q["words"]).alias(c["n_words"]))
    span = F.sequence(F.lit(0), q["n_words"] - 3)
    at = lambda i, k: F.get(q["words"], i + k)
    # One number for every window: the upper bits of its hash, and its position. Sorted, equal windows are neighbours.
    low = (1 << POSITION_BITS) - 1
    number = lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))
    fits = (q["n_words"] >= 3) & (q["n_words"] <= low)
    out = out.select("*", F.when(fits, F.sort_array(F.transform(span, number))).alias(c["windows"]))
    head = lambda x: F.shiftright(x, POSITION_BITS)
    like = lambda e, of, j: F.coalesce(head(F.get(q[of], j)) == head(e), F.lit(False))
    twice = F.filter(q["windows"], lambda e, j: like(e, "windows", j - 1) | like(e, "windows", j + 1))
    out = out.select("*", twice.alias(c["twice"]))
    # Equal hashes only say that windows may be equal. Where neighbours are not, the windows themselves are sorted.
    position = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    differs = lambda i, j: (at(i, 0) != at(j, 0)) | (at(i, 1) != at(j, 1)) | (at(i, 2) != at(j, 2))
    unlike = F.transform(
        q["twice"],
        lambda e, j: like(e, "twice", j - 1) & F.coalesce(differs(position(e), position(F.get(q["twice"], j - 1))), F.lit(False)),
    )
    out = out.select("*", ((q["n_words"] > low) | F.coalesce(F.array_contains(unlike, True), F.lit(False))).alias(c["clash"]))
    grams = F.transform(span, lambda i: F.struct(F.concat_ws(" ", at(i, 0), at(i, 1), at(i, 2)).alias("g"), i.alias("i")))
    out = out.select("*", F.when(q["clash"], F.array_sort(grams)).alias(c["sorted"]))
    same = lambda e, j: F.get(q["sorted"], j)["g"].eqNullSafe(e["g"])
    found = F.transform(F.filter(q["sorted"], lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"])
    out = out.select("*", F.sort_array(F.when(q["clash"], found).otherwise(F.transform(q["twice"], position))).alias(c["at"]))
    # A window covers three words, or those up to the next one.
    covered = F.transform(q["at"], lambda i, j: F.least(F.coalesce(F.get(q["at"], j + 1) - i, F.lit(3)), F.lit(3)))
    n_repeat = F.aggregate(covered, F.lit(0), lambda a, x: a + x)
    out = out.select("*", F.when(F.size(q["at"]) > 0, n_repeat).otherwise(0).alias(c["n_repeat_words"]))
    failed = (q["n_words"] < 50) | (q["n_repeat_words"] * 100 > q["n_words"] * 50)
    return out.select("*", failed.alias(c["base_failed"])), c


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: float  # of the texts that the rules before it leave


def plan_cascade(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> list[Measured]:
    """Rules with their figures in the order of the cascade."""
    n = docs.count()
    if not n:
        return [Measured(r, 0.0, 0.0) for r in rules]
    text, words = F.col("t"), F.col("w")
    part = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).sample(
        fraction=min(1.0, SAMPLE_ROWS / n), seed=1
    )
    part = part.repartition(SAMPLE_TASKS).select("t", words_of(text).alias("w")).persist()

    def seconds(test: Column) -> float:
        times = []
        for _ in range(3):
            # A frame of its own each time: one that is collected again reads its shuffle files and does no work.
            job = part.agg(F.count_if(test & (F.size(words) >= 0)))
            began = time.perf_counter()
            job.collect()
            times.append(time.perf_counter() - began)
        return min(times[1:])  # the first run compiles

    tests = [rule.rejects(text, words, F.size(words)) for rule in rules]
    verdicts = part.groupBy(F.array(*[F.coalesce(t, F.lit(False)) for t in tests]).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    left = [(r["v"], r["n"]) for r in verdicts.collect()]  # 2 ** rules rows at most
    idle = seconds(F.length(text) >= 0)
    costs = [max(seconds(t) - idle, 1e-4) for t in tests]
    part.unpersist()
    return greedy_order(rules, costs, left)


def greedy_order(rules: tuple[Rule, ...], costs: list[float], left: list[tuple[list[bool], int]]) -> list[Measured]:
    """The rules by rejections per second among what the ones before leave; ``left``: verdicts and how many texts have them."""
    out, open_rules = [], list(range(len(rules)))
    while open_rules:
        size = max(1, sum(n for _, n in left))
        share = {k: sum(n for v, n in left if v[k]) / size for k in open_rules}
        best = max(open_rules, key=lambda k: (share[k] / costs[k], -costs[k]))
        out.append(Measured(rules[best], costs[best], share[best]))
        open_rules.remove(best)
        left = [(v, n) for v, n in left if not v[best]]
    return out


def cascade(order: list[Measured], text: Column, words: Column, n_words: Column, base_failed: Column) -> Column:
    """Name of the rule that rejects a row, null if none does."""
    out = F.lit(None).cast("string")
    for m in reversed(order):
        out = F.when(m.rule.rejects(text, words, n_words), F.lit(m.rule.name)).otherwise(out)
    return F.when(base_failed, F.lit("base")).otherwise(out)


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with base counts and the rejecting rule; and the added names."""
    order = plan_cascade(docs, text_col, rules)
    out, c = base_facts(docs, text_col)
    (c["rejected_by"],) = _fresh(out, "quality_rejected_by")
    why = cascade(order, *[F.col(c[k]) for k in ("text", "words", "n_words", "base_failed")])
    return out.select("*", why.alias(c["rejected_by"])), c


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns."""
    judged, c = judge(docs, text_col)
    # A row number that the filter reads keeps the optimizer from copying the
    # counts into the filter, where it would compute them once per word.
    (row,) = _fresh(judged, "quality_row")
    judged = judged.select("*", F.monotonically_increasing_id().alias(row))
    return judged.filter(F.col(c["rejected_by"]).isNull() & (F.col(row) >= 0)).drop(*c.values(), row)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts and verdict of every row."""
    judged, c = judge(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    text, words = F.col(c["text"]), F.col(c["words"])
    return judged.select(
        "doc_id",
        F.col(c["n_words"]).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        n_symbols(text).cast("long").alias("n_symbols"),
        n_dup_lines(text).cast("long").alias("n_dup_lines"),
        F.col(c["n_repeat_words"]).cast("long").alias("n_repeat_words"),
        F.col(c["base_failed"]).alias("base_failed"),
        F.col(c["rejected_by"]).isNull().alias("kept"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), g AS (
  SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1),
         lambda i: struct_pack(i := i, g := ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS e
  FROM d
), twice AS (
  SELECT doc_id, e.i AS i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, e.g) > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), f AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS upper_n,
         length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS letters,
         length(regexp_replace(text, '[^!]+', '', 'g')) AS bangs,
         len(ls) AS lines_n, len(list_distinct(ws)) AS distinct_n
  FROM d LEFT JOIN rep USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
            OR n_symbols * 10 > n_words OR upper_n * 2 > letters OR bangs * 2 > n_words
            OR letters * 2 < word_chars OR NOT word_chars BETWEEN 2 * n_words AND 15 * n_words
            OR n_dup_lines * 2 > lines_n OR distinct_n * 10 < n_words) AS kept
FROM f
"""
