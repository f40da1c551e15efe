"""Spelling variants: words one edit apart, found through the edits of words over a small alphabet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opswatch.llm.common import join_counted
from opswatch.session import cut_lineage

#: Letters of a word, as a character class; only A-Z are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT, FORM_RATIO, SLIP_EVERY = 6, 5, 5, 199
#: Symbols of the reduced alphabet.
SYMBOLS = 6


def _lowered(word: Column) -> Column:
    return F.when(word.rlike("[A-Z]"), F.translate(word, UPPER, LOWER)).otherwise(word)


def count_words(docs: DataFrame, slip_every: int = SLIP_EVERY, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: the words of at least ``min_length`` code points that occur at least ``min_count`` times in whole texts.

    A word is a maximal run of letters, A-Z lower-cased. Where ``slip_every`` divides the crc32 h of ``<doc_id>:<word>`` (a null id
    is empty), the code point h % length is left out first: planted misspellings. A null text has no words. Counts are added up in
    each task before the shuffle, so that a very common word is one row per task.
    """
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"([{LETTERS}]{{{min_length},}})"), 1)
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    words = docs.select(doc.alias("doc"), F.explode(runs).alias("run"))
    words = words.select("doc", _lowered(F.col("run")).alias("run"))
    words = words.select("run", F.crc32(F.concat_ws(":", "doc", "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % slip_every == 0, slipped).otherwise(F.col("run"))
    counted = words.groupBy(word.alias("word")).agg(F.count("*").alias("n"))
    return counted.where((F.col("n") >= min_count) & (F.length("word") >= min_length))


def reduced(word: str | Column, symbols: int = SYMBOLS) -> Column:
    """The word with each letter hashed to one of a few symbols: its code point modulo their number."""
    letters = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
    return F.translate(word, letters, "".join(_symbol(ord(c) % symbols) for c in letters))


def _symbol(i: int) -> str:
    return chr(ord("a") + i)


def neighbourhood(word: str, symbols: int = SYMBOLS) -> Column:
    """The words within one edit of the reduced word in column ``word``, itself included, one array per edited place.

    Explode it beside a column ``at`` with the places 1 to length + 1. At each place a symbol is left out,
    replaced or put in; some words come up at several places.
    """
    before = F.substring(word, F.lit(1), F.col("at") - 1)
    here = F.substring(word, F.col("at"), F.length(word))
    after = F.substring(word, F.col("at") + 1, F.length(word))
    put = [F.concat(before, F.lit(_symbol(i)), here) for i in range(symbols)]
    replaced = [F.concat(before, F.lit(_symbol(i)), after) for i in range(symbols)]
    inside = F.array(F.concat(before, after), *replaced, *put)
    return F.when(F.col("at") <= F.length(word), inside).otherwise(F.array(*put))


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``word, n, near, near_n``: every ordered pair of words that differ by exactly one inserted, deleted or replaced letter.

    ``words``: ``word, n``, each word once. An edit of a word is an edit of its reduced word, or leaves that as it is. So the full
    one-edit neighbourhoods of the distinct reduced words are joined with the reduced vocabulary, words are
    joined to the pairs of reduced words, and the originals are compared. Nothing is broadcast and no class
    of equal reduced words is gathered; a class that is too common is split by adaptive skew joins.
    """
    coded = words.select("word", "n", reduced("word", symbols).alias("code"))
    codes = cut_lineage(coded.select("code").distinct())
    places = codes.select("code", F.explode(F.sequence(F.lit(1), F.length("code") + 1)).alias("at"))
    around = places.select("code", F.explode(neighbourhood("code", symbols)).alias("near_code"))
    known = codes.select(F.col("code").alias("near_code"))
    # a pair that comes up at several places is made one after the join, where few are left
    pairs = cut_lineage(around.join(known, "near_code").distinct())
    others = coded.select(F.col("code").alias("near_code"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    candidates = coded.join(pairs, "code").join(others, "near_code")
    # the limit of 1 keeps the comparison at one band of the table of distances
    return candidates.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def spelling_variants(words: DataFrame, symbols: int = SYMBOLS, ratio: int = FORM_RATIO) -> DataFrame:
    """Every word with the form it is taken to be a variant of, and the root of its forms.

    ``words``: ``word, n``, each word once; other columns are left out. Columns: ``word, form, root, n, n_near, form_n``. The form is the near word of
    the largest count (ties: the smallest in code-point order) if that is at least ``ratio`` times the word's own, else null; the
    root follows forms to the last, which is the word itself where there is none. An empty table gives no rows.

    Counts grow by ``ratio`` along forms, so chains end; they are halved by joining each form's own, and
    the rounds grow with the logarithm of the longest.
    """
    words = words.select("word", "n")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    found = near_words(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(found, "word", "left")
    near_n = -F.col("best.less")
    is_form = near_n >= F.lit(ratio) * F.col("n")
    formed = cut_lineage(
        joined.select(
            "word", F.when(is_form, F.col("best.near")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, near_n).alias("form_n"),
        )
    )
    roots = _roots(formed.where("form is not null").select("word", F.col("form").alias("root")))
    return join_counted(formed, roots, ["word"], "left", 96).select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(links: DataFrame) -> DataFrame:
    """``word, root``: links followed to their end."""
    links = cut_lineage(links)
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = join_counted(links, onward, ["root"], "left", 96)
        links = cut_lineage(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if links.where("moved").isEmpty():
            return links.drop("moved")
        links = links.drop("moved")


_SQL_LETTERS = r"A-Za-z\x{C0}-\x{FF}"
SPELLING_SQL = rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
              lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END) ORDER BY i) AS t
  FROM range(256) r(i)
),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(w, '{UPPER}', '{LOWER}') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[{_SQL_LETTERS}]+')) AS w FROM documents)
  WHERE length(w) >= {MIN_LENGTH}
),
hashed AS (
  SELECT run, k,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
             list_transform(regexp_extract_all(hex(encode(doc || ':' || run)), '..'), lambda h: CAST(CAST('0x' || h AS INTEGER) AS BIGINT))),
             lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), CAST(4294967295 AS BIGINT)) AS h
  FROM (SELECT doc, run, count(*) AS k FROM runs GROUP BY doc, run) CROSS JOIN crc_table
),
words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT k, CASE WHEN h % {SLIP_EVERY} = 0
                   THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
                   ELSE run END AS word
    FROM hashed)
  WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(k) >= {MIN_COUNT}
),
cut AS (
  SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)
),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION
  SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
),
best AS (
  SELECT word, count(*) AS n_near, min({{'less': -near_n, 'near': near}}) AS b FROM near GROUP BY word
),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN -b.less >= {FORM_RATIO} * w.n THEN b.near END AS form,
         CASE WHEN -b.less >= {FORM_RATIO} * w.n THEN -b.less END AS form_n
  FROM words w LEFT JOIN best ON best.word = w.word
),
walk AS (
  SELECT word, word AS root, form AS further FROM formed
  UNION ALL
  SELECT walk.word, f.word, f.form FROM walk JOIN formed f ON f.word = walk.further
)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM formed f JOIN walk ON walk.word = f.word AND walk.further IS NULL
"""
