"""Column expressions over raw text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white-space class, reserved words with ids 1, 2, 3 and reserved characters
# (padding, start of word, end of word) with ids 1, 2, 3.
SPACE = r"[ \t\n\x0B\f\r]+"
SOS, EOS, UNK = "<s>", "</s>", "<unk>"
SOS_ID, EOS_ID, UNK_ID = 1, 2, 3
PAD, SOW, EOW = "\x11", "\x12", "\x13"
PAD_ID, SOW_ID, EOW_ID = 1, 2, 3
N_RESERVED = 3

# Longest vocabulary word and longest word for character encoding.
VOCAB_WORD_LIMIT = 65
CHAR_WORD_LIMIT = 32


def split_words(text: Column) -> Column:
    """White-space tokens, empties dropped."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def split_chars(word: Column) -> Column:
    return F.split(word, "")


def cut(word: Column, limit: int) -> Column:
    """First ``limit`` characters."""
    return F.substring(word, 1, limit)


def has_reserved_char(word: Column) -> Column:
    return word.rlike(f"[{PAD}{SOW}{EOW}]")


def joined(ids: Column) -> Column:
    """Array of numbers as one space-separated string."""
    return F.concat_ws(" ", ids.cast("array<string>"))
