"""Spelling variants by anagram hashing.

The key of a word is the sum of a power of each letter's code point, so it does not
depend on their order. Two words that differ by one inserted, deleted or replaced
letter have keys that differ by the value of one letter, or by the exchange of one
value for another. Both are found by one join: a word has its own key, and a key for
each different letter that is taken away. An own key that equals a lessened one is an
addition or removal; two lessened keys that are equal are an exchange.

Equal keys only say that the letters are the same. The order of letters is verified
next: keys that more than one word has are followed by the places at which the letter
stands and a hash of what is left of the word there, and words are near if these are
equal too and so are the letters left. No group is paired in full: with key, place and
rest equal, words differ in one letter, so a group has as many words as there are letters.

Words are counted with partial aggregation, so frequent ones are not gathered. A word has
at most as many keys as different letters, however long it is, and only words with
a shared key are looked at place by place. Forms are followed to their roots by
doubling: every round halves the way that is left.

Defined results: a null text has no words; a null id is written as nothing before the
colon; repeated rows count as often as they are there; an empty table gives no rows; other
columns of any name are ignored; texts and words of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.recovery import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
#: The power of code points that are summed: high enough to keep different letters apart.
POWER = 5
#: Keys are taken modulo a power of two, so words of any length have one.
MASK = (1 << 62) - 1
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form is so many times as frequent as its variant.
TIMES = 5
#: One run in so many loses a letter (part of the registered query's contract).
SLIP = 199


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, run)``: all runs of letters, A-Z lower-cased."""
    found = F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(LETTERS), 0)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    # lower() is right, and much faster than translate(), where all letters are ASCII.
    plain = F.octet_length("run") == F.length("run")
    return rows.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))


def slipped(rows: DataFrame) -> DataFrame:
    """``(word)``: runs, of which one in SLIP has lost a letter."""
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return rows.withColumn("h", h).select(F.when(F.col("h") % SLIP == 0, less).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame) -> DataFrame:
    """``(word, n)`` of words that are long and frequent enough."""
    rows = words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return rows.filter(F.col("n") >= LEAST_COUNT)


def _value(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    value = code
    for _ in range(POWER - 1):
        value = value * code
    return value


def near_pairs(words: DataFrame) -> DataFrame:
    """``(a, b)``: ids of words that differ by one letter, each pair in both directions.

    ``words``: ``(id, word)``, distinct.
    """
    letters = F.split("word", "")
    whole = words.select("id", "word", letters.alias("letters"))
    whole = whole.select("id", "word", F.aggregate("letters", F.lit(0).cast("long"), lambda s, c: (s + _value(c)).bitwiseAND(F.lit(MASK))).alias("own"), F.array_distinct("letters").alias("kinds"))
    # A word's own key, without a letter, and its keys less one letter.
    keys = F.concat(
        F.array(F.struct(F.col("own").alias("key"), F.lit(None).cast("string").alias("letter"))),
        F.transform("kinds", lambda c: F.struct((F.col("own") - _value(c)).bitwiseAND(F.lit(MASK)).alias("key"), c.alias("letter"))),
    )
    rows = cut(whole.select("id", F.explode(keys).alias("k")).select("id", "k.key", "k.letter"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    rows = rows.join(shared, "key", "left_semi").join(words, "id")
    # Letter order: the places of the letter, and what is left of the word without it.
    n = F.length("word")
    places = F.filter(F.transform(F.split("word", ""), lambda c, i: F.when(c == F.col("letter"), i + 1)), lambda i: i.isNotNull())
    left = lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, n))
    less = F.transform(places, lambda i: F.struct(i.alias("place"), F.xxhash64(left(i)).alias("rest")))
    as_is = F.array(F.struct(F.lit(0).alias("place"), F.xxhash64("word").alias("rest")))
    rows = rows.select("id", "key", F.explode(F.when(F.col("letter").isNull(), as_is).otherwise(less)).alias("p"))
    rows = cut(rows.select("id", "key", "p.place", "p.rest"))
    exchanged = rows.filter("place > 0")
    a, b = exchanged.alias("a"), exchanged.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "rest")]
    pairs = a.join(b, [*same, F.col("a.place") == F.col("b.place"), F.col("a.id") != F.col("b.id")]).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    a, b = exchanged.alias("a"), rows.filter("place = 0").alias("b")
    removed = a.join(b, same).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    return pairs.union(removed).union(removed.select("b", "a"))


def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """``(a, n_a, b, n_b)`` of pairs whose words differ by one letter indeed, as words with their counts."""
    named = lambda side: words.select(F.col("id").alias(side), F.col("word").alias(f"word_{side}"), F.col("n").alias(f"n_{side}"))
    rows = pairs.join(named("a"), "a").join(named("b"), "b")
    return rows.filter(F.expr("levenshtein(word_a, word_b, 1) = 1")).select(F.col("word_a").alias("a"), "n_a", F.col("word_b").alias("b"), "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of words with a form. Frequencies rise along forms, so there is no cycle."""
    steps = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = cut(steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        steps = moved.select("word", "root")


def variants_of(counts: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``(word, n)``."""
    words = cut(counts.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    near = verified(near_pairs(words.select("id", "word")), words)
    best = F.min_by(F.struct("b", "n_b"), F.struct(-F.col("n_b"), "b"))
    near = near.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near = near.select(F.col("a").alias("word"), "n_near", F.col("best.b").alias("form"), F.col("best.n_b").alias("form_n"))
    rows = words.join(near, "word", "left")
    fits = F.col("form_n") >= TIMES * F.col("n")
    rows = cut(rows.select("word", F.when(fits, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("form_n")).alias("form_n")))
    found = roots(rows.filter("form is not null"))
    return rows.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Variants of all words of whole texts, with the slips of the registered query."""
    return variants_of(counted(slipped(runs(docs, id_col, text_col))))


#: CRC-32 is a fold over bytes with a table that follows from its polynomial; letters are one or two bytes.
SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS entries
), found AS MATERIALIZED (
  SELECT id, run, count(*) AS times FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents)
  GROUP BY id, run
), hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(id || ':' || run, ''),
         lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195::BIGINT, unicode(ch)::BIGINT - 64] END))),
         lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]))) AS h
  FROM found, crc
), words AS MATERIALIZED (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {LEAST_COUNT}
), less AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS MATERIALIZED (
  SELECT a.word AS a, b.word AS b, b.n AS n_b FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), ranked AS (
  SELECT a, b, n_b, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n_b DESC, b) AS k FROM pairs
), formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN n_b >= {TIMES} * n THEN b END AS form, CASE WHEN n_b >= {TIMES} * n THEN n_b END AS form_n
  FROM words LEFT JOIN (SELECT * FROM ranked WHERE k = 1) ON a = word
), chain AS (
  SELECT word, word AS root, 0 AS steps FROM formed
  UNION ALL SELECT c.word, f.form, c.steps + 1 FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word) USING (word)
"""
