"""Spelling variants by sorted permuterm rotations.

A word gets a terminator, and all rotations of the marked word are taken. The rotation that starts behind a character
ends with it, so two words that differ by that one character have rotations that agree in all but their last place,
and a word that lacks it has a whole rotation equal to that prefix: replaced, inserted and deleted characters are all
ranges of one prefix in the sorted rotations. Each rotation hence stands in the sort twice, whole and as (prefix, edited
character), ordered by prefix; the ranges are scanned and give every word of a range its number of neighbours there
and the best of the others.

A prefix fixes the word but for one character, so a range holds at most one word per letter and the shorter word: its
size is bounded by the alphabet, whatever the data, and no pairs are made. Two words meet in one range for a replacement
and in several for a character out of a run of equal ones ("aab", "ab"); of those only the range whose prefix does not
end with that character counts.

Words are counted before the first shuffle, so frequent ones are no hot keys. Forms are followed to their ends by
doubling; a form has at least twice the count, so a chain is at most log2 of the largest count long and settles in the
log of that many rounds.

Defined results. A null text has no words. A null doc_id counts as an empty one in the hash that picks typos. Rows that
repeat are counted each. Ties among near words go to the smallest in code-point order. Texts are read whole. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbolex.llm.lookups import looked_up
from arbolex.session import materialize

#: ends a word in its rotations; no letter
END = "$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: letters of a word (Latin, with the accented ones of Latin-1), in a regular expression
LETTERS = "A-Za-zÀ-ÿ"


def word_counts(documents: DataFrame, shortest: int = 5, fewest: int = 3, typos: int = 97) -> DataFrame:
    """word, n: lower-cased runs of letters with at least ``shortest`` letters and ``fewest`` occurrences.

    Where ``typos`` divides the CRC-32 of ``<doc_id>:<run>``, the run loses the letter that the hash points at, as
    if it were misspelt; 0 leaves all runs as they are.
    """
    # a run of fewer letters than that can't become a word
    runs = F.regexp_extract_all(F.translate(F.col("text"), UPPER, LOWER), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    rows = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    if typos:
        rows = rows.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        lost = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
        rows = rows.select(F.when(F.col("h") % typos == 0, lost).otherwise(F.col("run")).alias("run")).where(F.length("run") >= shortest)
    return rows.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fewest)


def rotations(words: DataFrame) -> DataFrame:
    """prefix, tail, n: all rotations of the marked words, whole (``tail`` empty) and cut before their last letter."""
    marked = F.concat("word", F.lit(END))
    size = F.length("word")

    def turn(i: Column) -> Column:
        rotation = F.concat(marked.substr(i, size + 1), marked.substr(F.lit(1), i - 1))
        whole = F.struct(rotation.alias("prefix"), F.lit("").alias("tail"))
        cut = F.struct(rotation.substr(F.lit(1), size).alias("prefix"), rotation.substr(size + 1, F.lit(1)).alias("tail"))
        return F.when(i == 1, F.array(whole)).otherwise(F.array(whole, cut))  # the first rotation ends with the terminator

    both = F.flatten(F.transform(F.sequence(F.lit(1), size + 1), turn))
    return words.select(F.inline(both), "n")


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, best (n and word of the most frequent near word, or null) of every row of ``words``."""
    turned = rotations(words).repartition("prefix")
    # the word starts behind the terminator
    rotation = F.concat("prefix", "tail")
    word = F.concat(F.substring_index(rotation, END, -1), F.substring_index(rotation, END, 1))
    own = F.struct((-F.col("n")).alias("minus_n"), F.col("word").alias("word"))
    scan = Window.partitionBy("prefix").orderBy("own")
    whole = scan.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut = F.col("tail") != ""
    # the edited letter is no part of a run of equal ones before it
    fresh = cut & ~F.endswith("prefix", "tail")
    ranges = (
        turned.select("prefix", "tail", "n", word.alias("word"))
        .withColumn("own", own)
        .withColumn("place", F.row_number().over(scan))
        .withColumn("size", F.count(F.lit(1)).over(whole))
        .withColumn("long", F.sum(cut.cast("long")).over(whole))
        .withColumn("fresh", F.sum(fresh.cast("long")).over(whole))
        .withColumn("first", F.first("own").over(whole))
        .withColumn("second", F.nth_value("own", 2).over(whole))
    )
    shorter = (F.col("size") > F.col("long")).cast("long")
    near = F.when(cut, F.col("long") - 1 + F.when(fresh, shorter).otherwise(0)).otherwise(F.col("fresh"))
    best = F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("first"))
    # one rotation of every word, the unturned one, is kept even where it is alone
    kept = ranges.where((F.col("size") > 1) | (~cut & F.endswith("prefix", F.lit(END))))
    found = kept.select("word", "n", near.alias("near"), best.alias("best")).groupBy("word", "n")
    return found.agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def followed(forms: DataFrame) -> DataFrame:
    """word, root of every row of ``forms`` (word, form): the end of the chain of forms."""
    ends = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = materialize(looked_up(ends, ahead, "root"), "roots")
        ends = further.select("word", F.coalesce("next", "root").alias("root"))
        if not further.where("next is not null").limit(1).count():
            return ends


def spelling_groups(documents: DataFrame, shortest: int = 5, fewest: int = 3, typos: int = 97, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts.

    ``form`` is the near word (one letter inserted, deleted or replaced) of largest count, if that is at least
    ``ratio`` times the word's; ``root`` ends the chain of forms from the word, which is the word itself without one.
    """
    words = materialize(word_counts(documents, shortest, fewest, typos), "words")
    near = materialize(near_words(words), "near-words")
    taken = -F.col("best.minus_n") >= ratio * F.col("n")
    rows = near.select(
        "word", F.when(taken, F.col("best.word")).alias("form"), "n", "n_near", F.when(taken, -F.col("best.minus_n")).alias("form_n")
    )
    roots = followed(rows.where("form is not null").select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
