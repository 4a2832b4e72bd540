"""Text joins: phrases inside texts, and similar word sets. No step pairs all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.operators.joins import few

#: So many of a set's rarest words come along with each of its prefix words.
RAREST = 4


def word_grams(words: Column, n: int) -> Column:
    """All runs of n words of an array, space-joined; none if there are fewer. Pass a column of its own: an expression would be computed for every run."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def containing(docs: DataFrame, phrases: DataFrame, n: int = 5) -> DataFrame:
    """Pairs (doc, phrase) of `docs` (doc, folded) and `phrases` (phrase, folded) where whole words of the text are the phrase.

    A phrase is looked up by the hash of its first n words, a shorter one by
    that of all, among those of each place of a text. Few phrases are broadcast
    and checked where the text is read, so no text moves or is read again; with
    more, texts are read again for the candidates. Null and empty phrases are
    in no text.
    """
    words = F.split("folded", " ")
    head = F.slice(words, F.lit(1), F.least(F.size(words), F.lit(n)))
    anchors = phrases.filter("folded <> ''").select("phrase", F.col("folded").alias("wanted"), F.size(head).alias("m"), F.xxhash64(head).alias("h"))
    lengths = sorted(r.m for r in anchors.select("m").distinct().collect())  # n at most
    word = lambda k: F.get("ws", F.col("i") + k)
    runs = F.array(*(F.when(F.col("i") + m <= F.size("ws"), F.xxhash64(*(word(k) for k in range(m)))) for m in lengths)).cast("array<bigint>")
    places = docs.select("doc", "folded", words.alias("ws")).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("ws") - 1)))
    holds = F.contains(F.concat(F.lit(" "), "folded", F.lit(" ")), F.concat(F.lit(" "), "wanted", F.lit(" ")))
    if few(anchors):
        return places.withColumn("h", F.explode(runs)).join(F.broadcast(anchors), "h").filter(holds).select("doc", "phrase").distinct()
    met = places.select("doc", F.explode(runs).alias("h")).distinct().join(anchors, "h").select("doc", "phrase", "wanted")
    return met.join(docs.select("doc", "folded"), "doc").filter(holds).select("doc", "phrase").distinct()


def similar_sets(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n_shared, n_all) with a < b of `sets` (id, block, words), Jaccard similarity `percent` or more within a block.

    Prefix filter: with words ordered from rare to frequent, two sets that
    similar share one of their first size - ceil(percent * size) + 1 words.
    At the first word they share, what is left of both has to hold all words
    that they need in common, which drops most meetings at frequent words.
    Each word sets one of 256 bits; bits that only one of both sets has set
    stand for at least as many words that aren't shared, so most pairs that
    aren't similar are dropped where they meet, before any words move. A pair
    that has met at one of the rarest words before isn't told again.
    Ids and sets have to be different.
    """
    # The same rows and columns for all three reads of the sets, so that their exchange is made once.
    sets = sets.filter((F.size("words") > 0) & F.col("words").isNotNull() & F.col("block").isNotNull())
    each = sets.select("id", "block", F.size("words").alias("n"), F.explode("words").alias("word"))
    known = each.groupBy("block", "word").agg(F.count("id").alias("df"))
    least = F.floor((F.col("n") * percent + 99) / 100)
    place = F.xxhash64("word").bitwiseAND(255)
    bit = lambda k: F.bit_or(F.when(F.shiftright(place, 6) == k, F.expr("shiftleft(1L, CAST(xxhash64(word) & 63 AS INT))")).otherwise(F.lit(0).cast("long")))
    marks = range(4)
    ordered = each.join(known, ["block", "word"]).groupBy("id", "block", "n").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("o"), *(bit(k).alias(f"m{k}") for k in marks))
    rarest = F.transform(F.slice("o", 1, RAREST), lambda x: x["word"])
    prefix = ordered.select("id", "block", "n", rarest.alias("rarest"), *(f"m{k}" for k in marks), F.posexplode(F.slice("o", F.lit(1), (F.col("n") - least + 1).cast("int"))).alias("i", "p")).filter("p.df > 1")
    before = F.slice("rarest", F.lit(1), F.least(F.col("i"), F.lit(RAREST)))
    side = lambda name: prefix.select("block", F.col("p.word").alias("word"), F.col("id").alias(name), F.col("n").alias(f"n{name}"), (F.col("n") - F.col("i")).alias(f"left_{name}"), *(F.col(f"m{k}").alias(f"m{k}{name}") for k in marks), before.alias(f"before_{name}"))
    both = F.col("na") + F.col("nb")
    like = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    enough = F.least("left_a", "left_b") * (100 + percent) >= both * percent
    apart = sum((F.bit_count(F.col(f"m{k}a").bitwiseXOR(F.col(f"m{k}b"))) for k in marks), F.lit(0))
    near = (both - apart) * (100 + percent) >= 2 * percent * both
    first = ~F.arrays_overlap("before_a", "before_b")
    met = side("a").join(side("b"), ["block", "word"]).filter((F.col("a") < F.col("b")) & like & enough & near & first).select("a", "b").distinct()
    # A set moves once a pair, as one string; a space inside of a word is escaped.
    joined = F.array_join(F.transform("words", lambda w: F.replace(F.replace(w, F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20"))), " ")
    words = lambda name: sets.select(F.col("id").alias(name), F.size("words").cast("long").alias(f"n{name}"), joined.alias(f"w{name}"))
    shared = F.size(F.array_intersect(F.split("wa", " "), F.split("wb", " "))).cast("long")
    # Exploded, so that filters don't count it anew.
    counted = met.join(words("a"), "a").join(words("b"), "b").select("a", "b", "na", "nb", F.explode(F.array(shared)).alias("n_shared")).select("a", "b", "n_shared", (both - F.col("n_shared")).alias("n_all"))
    return counted.filter(F.col("n_shared") * 100 >= F.col("n_all") * percent)
