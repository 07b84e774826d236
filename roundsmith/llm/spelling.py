"""Spelling variants: words that differ by one edit, found by a rare-first prefix filter of positional bigrams.

One edit touches at most two bigrams of a word. So if bigrams are put in one order, rarest first, and equal ones by
position, two words that differ by one edit share an untouched bigram among the three first of each, at positions that
differ by no more than their lengths. As the edit lies on one side of that bigram, the words also agree on the other
side: from the word's start to the bigram's end, or from its start to the word's end. Words join on that piece and on
length; each pair is then verified. Pieces that more than GROUP words share are not joined: these words meet
through their one-deletion forms, which only few words can have in common.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from roundsmith.llm import storage

#: Letters of a word, A-Z and a-z and those from À to ÿ in Latin-1.
RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5
#: One occurrence in so many loses a letter.
TYPO_ONE_IN = 199
#: Bigrams of a word that are joined on; words of a piece that are joined with each other.
RAREST, GROUP = 3, 500
MAX_ROUNDS = 30


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words that occur LEAST_COUNT times or more in documents (doc_id, text), saved."""
    run = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0)))
    lowered = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", string.ascii_uppercase, string.ascii_lowercase))
    found = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("id"), run.alias("run")).select("id", lowered.alias("run"))
    hashed = found.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % TYPO_ONE_IN == 0, cut).otherwise(F.col("run"))
    words = hashed.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return storage.saved(words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT), "words")


def _rarest(words: DataFrame) -> DataFrame:
    """word, at, gram: the RAREST first bigrams of each word, in the order of their number, their letters and position."""
    grams = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at")).withColumn("gram", F.substring("word", F.col("at"), F.lit(2)))
    often = grams.groupBy("gram").agg(F.count("*").alias("df"))  # at most one row for each two of the 90 letters
    w = Window.partitionBy("word").orderBy("df", "gram", "at")
    return grams.join(F.broadcast(often), "gram").withColumn("k", F.row_number().over(w)).where(F.col("k") <= RAREST).select("word", "at", "gram")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: the pairs of words (word: string, each once, LEAST_LENGTH letters or more) that differ by exactly one
    inserted, deleted or replaced letter, once each way; saved."""
    words = words.select("word")
    length = F.length("word")
    pieces = _rarest(words).select("word", length.alias("len"), F.explode(F.array(
        F.struct(F.lit(True).alias("head"), F.substring("word", F.lit(1), F.col("at") + 1).alias("piece")),
        F.struct(F.lit(False).alias("head"), F.substring("word", F.col("at"), length).alias("piece")),
    )).alias("x")).select("word", "len", "x.*")
    pieces = storage.saved(pieces.distinct(), "pieces")
    often = storage.saved(pieces.groupBy("head", "piece").agg(F.count("*").alias("k")).where(F.col("k") > GROUP).select("head", "piece"), "often")
    few = pieces.join(often, ["head", "piece"], "left_anti")
    longer = few.select("head", "piece", F.explode(F.array(F.col("len"), F.col("len") + 1)).alias("len"), F.col("word").alias("a"))
    joined = longer.join(few.withColumnRenamed("word", "b"), ["head", "piece", "len"]).where((F.length("a") < F.length("b")) | (F.col("a") < F.col("b")))
    forms = pieces.join(often, ["head", "piece"], "left_semi").select("word").distinct()
    # a word and its one-deletion forms: of equal lengths two words share a form with the same gap, else one is the other's form
    gaps = forms.select("word", F.explode(F.sequence(F.lit(1), length)).alias("gap"))
    cut = F.concat(F.substring("word", F.lit(1), F.col("gap") - 1), F.substring("word", F.col("gap") + 1, length))
    deleted = gaps.select("word", "gap", cut.alias("form"))
    same = deleted.select(F.col("word").alias("a"), "gap", "form").join(deleted.select(F.col("word").alias("b"), "gap", "form"), ["gap", "form"]).where("a < b")
    within = deleted.select(F.col("word").alias("b"), F.col("form").alias("a")).join(forms.select(F.col("word").alias("a")), "a")
    pairs = joined.select("a", "b").union(same.select("a", "b")).union(within.select("a", "b")).where(F.levenshtein("a", "b", 1) == 1).distinct()
    out = storage.saved(pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*"), "near")
    storage.drop(pieces, often)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """word, root for words that have a form (word, form): the last word that forms lead to; by doubling steps."""
    at = storage.saved(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(MAX_ROUNDS):
        next_ = at.select(F.col("word").alias("root"), F.col("root").alias("far"))
        new = storage.saved(at.join(next_, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        moved = new.where("moved").limit(1).count()
        storage.drop(at)
        at = new
        if not moved:
            return at.select("word", "root")
    raise RuntimeError(f"roots: not settled after {MAX_ROUNDS} rounds")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for documents (doc_id, text); more columns are ignored.

    Words are runs of letters (RUN), A-Z as a-z; where TYPO_ONE_IN divides the crc32 h of "<doc_id>:<run>", the letter
    at h modulo length is deleted (a missing doc_id is written as nothing). Those of LEAST_LENGTH letters with
    LEAST_COUNT occurrences count, n each. n_near is the number of words that differ by one edit, form the
    one of them with the greatest n (of equal ones the first in code-point order) if that is FACTOR times the word's own,
    form_n its n; root is what forms lead to, or the word. Null and empty texts have no words; repeated rows count
    as often as they are there. An empty table, or one without frequent words, gives no rows.
    """
    words = vocabulary(docs)
    near = near_pairs(words)
    counted = near.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = counted.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("top"))
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("top.m") >= FACTOR * F.col("n"), F.col("top.b")).alias("form"), (-F.col("top.m")).alias("m"))
    rows = storage.saved(rows.withColumn("form_n", F.when(F.col("form").isNotNull(), F.col("m"))).drop("m"), "variants")
    roots = _roots(rows.where("form is not null"))
    storage.drop(words, near)
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of all documents with its form and root."""
    return variants(storage.table(spark, sf_dir, "documents"))


#: The crc32 goes byte by byte through its table of 256 values; near words share a one-deletion form.
ORACLE_SQL = r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM (SELECT unnest(range(256)) AS i)),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
coded AS (SELECT run, k, list_transform(string_split(doc_id || ':' || run, ''), lambda x: unicode(x)::BIGINT) AS points FROM runs),
hashed AS (SELECT run, k, xor(list_reduce([4294967295] || flatten(list_transform(points, lambda p: CASE WHEN p < 128 THEN [p] ELSE [195, p - 64] END)), lambda c, b: xor(c >> 8, tab[1 + xor(c, b) % 256])), 4294967295) AS h FROM coded, crc),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
gaps AS MATERIALIZED (SELECT word, gap, substr(word, 1, gap - 1) || substr(word, gap + 1) AS form FROM (SELECT word, unnest(range(1, length(word) + 1)) AS gap FROM words)),
pairs AS (SELECT x.word AS a, y.word AS b FROM gaps x JOIN gaps y USING (gap, form) WHERE x.word <> y.word
  UNION SELECT g.word, w.word FROM gaps g JOIN words w ON g.form = w.word UNION SELECT w.word, g.word FROM gaps g JOIN words w ON g.form = w.word),
near AS (SELECT a AS word, b, n AS m FROM pairs JOIN words ON b = word),
best AS (SELECT word, count(*) AS n_near, first(b ORDER BY m DESC, encode(b)) AS top, max(m) AS m FROM near GROUP BY word),
rows AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN top END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM rows UNION ALL SELECT c.word, r.form FROM chain c JOIN rows r ON r.word = c.root WHERE r.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN rows r ON r.word = c.root WHERE r.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM rows JOIN ends USING (word)
"""
