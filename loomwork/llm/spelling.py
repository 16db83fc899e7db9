r"""Spelling variants: each word's more frequent neighbour at one edit.

A word's mask has one bit for each of BITS classes of letters: whether it holds
an odd number of them. One inserted or deleted letter flips one bit, a replaced
one two at most, so of three bands of the mask one stays as it is. An edit also
leaves a word's first or its last half as it is. Words meet by band, half and
the shorter of the two lengths, so that lengths differ by one at most; of the
keys that a pair shares only the first one counts, so that no pair is found
twice, and the edit distance decides.

No join broadcasts: tables are as long as the list of words, and Spark takes them
for as small as their compressed files, twelve keys a word not counted.

Keys hold few words, as a half is part of each, and no word has more than twelve.
A word has at most as many neighbours as it has edits, whatever the corpus, so
what is left after the join is bounded for each word. Forms grow by FACTOR at
each step: chains of them are short, and their ends are found by doubling.

Defined results: null texts have no words, a null id is an empty one in the hash
that decides on the planted typos; repeated rows count each; words of any length
are whole; an empty table gives none; other columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import drop_stored, stored, stored_counted

#: Letters, and a run of them that can still have LEAST_LENGTH after an edit.
LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5
#: One occurrence in so many loses a letter.
TYPO = 199
BITS, BANDS = 30, 3
#: The bits of each band: every third one, so that neighbouring letters are in different bands.
BAND = [sum(1 << b for b in range(k, BITS, BANDS)) for k in range(BANDS)]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """doc_id, run: every maximal run of letters that has the least length, lower case in A-Z."""
    found = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"([{LETTERS}]{{{least},}})"), 1))
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), found.alias("run")).withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")))


def with_typos(found: DataFrame, every: int = TYPO) -> DataFrame:
    """word: the runs, of which those whose hash ``every`` divides lose a letter."""
    h = F.crc32(F.encode(F.concat(F.coalesce("doc_id", F.lit("")), F.lit(":"), "run"), "UTF-8"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return found.withColumn("h", h).select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word"))


def word_counts(words: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """word, n of words of the least length that occur often enough."""
    return words.filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= count)


def mask(word: Column) -> Column:
    """The parity of each class of letters."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(c) % BITS).cast("int"))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(bit(c)))


def keyed(words: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """word, n, len, mask, base, half, band, key: each word's keys as one of two words, the shorter of which has ``base`` letters."""
    base, half, band = F.col("base"), F.col("half"), F.col("band")
    in_band = F.col("mask").bitwiseAND(F.element_at(F.array(*[F.lit(b) for b in BAND]), band + 1).cast("long"))
    return (
        words.withColumn("len", F.length("word")).withColumn("mask", mask(F.col("word")))
        .withColumn("base", F.explode(F.filter(F.array(F.col("len") - 1, "len"), lambda b: b >= least)))
        .withColumn("half", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", F.explode(F.array(*[F.lit(k) for k in range(BANDS)])))
        .withColumn("key", F.xxhash64(base, half, band, in_band, F.when(half == 0, first_half(F.col("word"), base)).otherwise(last_half(F.col("word"), base))))
    )


def first_half(word: Column, base: Column) -> Column:
    return F.substring(word, F.lit(1), F.floor(base / 2).cast("int"))


def last_half(word: Column, base: Column) -> Column:
    n = base - F.floor(base / 2).cast("int")
    return F.substring(word, F.length(word) - n + 1, n)


def near_pairs(words: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """word, n, other, other_n: each pair of words at one edit, once from either side."""
    a, b = keyed(words, least).alias("a"), keyed(words, least).alias("b")
    x, y = F.col("a.word"), F.col("b.word")
    flips = F.col("a.mask").bitwiseXOR(F.col("b.mask"))
    same = [flips.bitwiseAND(F.lit(m).cast("long")) == 0 for m in BAND]
    first_band = F.when(same[0], 0).when(same[1], 1).when(same[2], 2)
    first = F.when(first_half(x, F.col("a.base")) == first_half(y, F.col("a.base")), 0).otherwise(1)
    on = (
        (F.col("a.key") == F.col("b.key")) & (F.col("a.base") == F.least("a.len", "b.len")) & (F.col("a.base") == F.col("b.base"))
        & (F.col("a.band") == first_band) & (F.col("b.band") == F.col("a.band")) & (F.col("a.half") == first) & (F.col("b.half") == F.col("a.half"))
        & (F.levenshtein(x, y, 1) == 1)
    )
    return a.join(b.hint("merge"), on).select(x.alias("word"), F.col("a.n").alias("n"), y.alias("other"), F.col("b.n").alias("other_n"))


def forms(words: DataFrame, factor: int = FACTOR, least: int = LEAST_LENGTH) -> DataFrame:
    """word, n, n_near, form, form_n."""
    alone = words.select("word", "n", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("other_n"))
    # most frequent first, then in code-point order, which is that of UTF-8 bytes
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))))
    found = near_pairs(words, least).unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.count("other").alias("n_near"), best.alias("best"))
    form = F.when(-F.col("best.m") >= factor * F.col("n"), F.col("best.w"))
    return found.select("word", "n", "n_near", form.alias("form"), F.when(form.isNotNull(), -F.col("best.m")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """word, root of the words that have a form: the end of their chain of forms."""
    up, left = stored_counted(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while left:
        above = up.select(F.col("word").alias("_at"), F.col("root").alias("_up"))
        jumped = up.join(above.hint("merge"), F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("went"))
        after, old = stored(jumped, "roots"), up
        drop_stored(old)
        left, up = after.filter("went").limit(1).count(), after
    return up.select("word", "root")


def variants(docs: DataFrame, typo: int = TYPO, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, factor: int = FACTOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each word."""
    words = stored(word_counts(with_typos(runs(docs, id_col, text_col, least), typo), least, count), "words")
    found = stored(forms(words, factor, least), "forms")
    drop_stored(words)
    ends = roots(found)
    out = found.join(ends.withColumnRenamed("word", "_word").hint("merge"), F.col("word") == F.col("_word"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(docs: DataFrame, **options) -> DataFrame:
    """root, words: the groups of variants with two words or more, as (word, n), most frequent first."""
    member = F.struct((-F.col("n")).alias("m"), "word")
    groups = variants(docs, **options).groupBy("root").agg(F.sort_array(F.collect_list(member)).alias("g")).filter(F.size("g") > 1)
    return groups.select("root", F.transform("g", lambda x: F.struct(x["word"].alias("word"), (-x["m"]).alias("n"))).alias("words"))
