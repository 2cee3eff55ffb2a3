"""Text columns: cleaning, tokens, vocabulary, ordered concatenation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bipartrix.session import cut_lineage

TOKEN = r"[\p{L}\p{N}_]{2,}"

#: The default English stop words of Spark's StopWordsRemover, in its order.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t
can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've
we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't
cannot could here's how's let's ought that's there's what's when's where's who's why's would
""".split()


def clean_comment(c: Column) -> Column:
    """Without ``/* ... */`` marks and tags."""
    return F.regexp_replace(c, r"/\*.*?\*/|<[^>]+>", "")


def is_bot(user: Column) -> Column:
    return F.lower(user).rlike("bot$")


def tokens(c: Column) -> Column:
    """Lower-case words of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def word_counts(docs: DataFrame, author: str, text: str, stop_words: list[str] | None = None) -> DataFrame:
    """(author, word, n) without stop words."""
    words = docs.where(F.col(author).isNotNull()).select(F.col(author).cast("string").alias("author"), F.explode(tokens(F.col(text))).alias("word"))
    if stop_words is None:
        stop_words = STOP_WORDS
    if stop_words:
        words = words.where(~F.col("word").isin(stop_words))
    return words.groupBy("author", "word").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(counts: DataFrame, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """(word, df, total) of words that ``min_df`` authors use, the most frequent ``max_features`` of them."""
    v = counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total")).where(F.col("df") >= min_df)
    return v if max_features is None else v.orderBy(F.desc("total"), "word").limit(max_features)


def user_word_edges(docs: DataFrame, author: str, text: str, min_df: int = 1, max_features: int | None = None, binary: bool = False, stop_words: list[str] | None = None) -> DataFrame:
    """Bag-of-words edges of authors and words; texts are cut into words once, and their counts read twice."""
    counts = cut_lineage(word_counts(docs, author, text, stop_words))
    kept = counts.join(vocabulary(counts, min_df, max_features).select("word"), "word", "left_semi")
    return kept.select(F.col("author").alias("row_id"), F.col("word").alias("col_id"), (F.lit(1.0) if binary else F.col("n").cast("double")).alias("w"))


def longest_texts(docs: DataFrame, author: str, text: str, k: int) -> DataFrame:
    """(author, user_text, n): each author's k longest texts in order, joined by line ends, and the number of all."""
    n = docs.groupBy(F.col(author).alias("author")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(author).orderBy(F.desc(F.length(text)), text)
    best = docs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    joined = best.groupBy(F.col(author).alias("author")).agg(F.array_sort(F.collect_list(F.struct("_r", F.col(text).alias("t")))).alias("l"))
    return joined.select("author", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("user_text")).join(n, "author")


def author_sample(docs: DataFrame, author: str, n: int, seed: str = "") -> DataFrame:
    """n authors by least MD5 of seed and name: the same on every engine and at every size."""
    h = F.md5(F.concat(F.lit(seed), F.col("author")).cast("binary"))
    return docs.select(F.col(author).cast("string").alias("author")).where("author IS NOT NULL").distinct().orderBy(h, "author").limit(n)
