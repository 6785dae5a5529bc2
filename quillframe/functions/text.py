"""String expressions: whitespace handling, the character set, label encoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------
# 78 symbols; the position of a symbol is its class, and class 78 is the blank.
CHARSET = "!\"#&'()*+,-./0123456789:;?ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BLANK = len(CHARSET)
# The 62 classes of the character classifier, in class order.
CLASS_CHARS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
CAPTION_DEFAULT = "Not found in CSV"
# What Python's str.split() and str.strip() treat as whitespace.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same as a character class that both Java regular expressions and RE2 read.
SPACE = (
    r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# The same for Java alone, which looks characters below 256 up in one table and passes most others by one range.
_JAVA_SPACE = (
    r"[\t\n\x0B\f\r\x1C\x1D\x1E\x1F \x85\xA0"
    r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
)
# ----------------------------------------------------------------------------------------


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(SPACE_CHARS))


def words(s: Column) -> Column:
    """Whitespace tokens; an empty or blank string has none."""
    return F.filter(F.split(s, f"{_JAVA_SPACE}+"), lambda w: w != "")


def encode(word: Column) -> Column:
    """Array of classes; -1 marks a character outside the set, which is all ASCII."""
    classes = F.array(*[F.lit(CHARSET.find(chr(i))) for i in range(128)])
    return F.when(word == "", F.array().cast("array<int>")).otherwise(
        F.transform(F.split(word, ""), lambda c: F.coalesce(F.get(classes, F.ascii(c)), F.lit(-1)))
    )


def encodable(labels: Column) -> Column:
    return ~F.exists(labels, lambda i: i < 0)


def decode(labels: Column, skip: int = -1, charset: str = CHARSET) -> Column:
    """Text of a class array, leaving out ``skip`` (-1 in predictions, the blank in targets)."""
    chars = F.array(*[F.lit(c) for c in charset])

    def char(i: Column) -> Column:
        return F.coalesce(F.get(chars, i), F.substring(F.lit(charset), i + 1, F.lit(1)))

    # Joining leaves out nulls.
    return F.array_join(F.transform(labels, lambda i: F.when(i != skip, char(i))), "")


def image_path(word_id: Column, root: str) -> Column:
    """``a-b-...`` lies at ``root/a/a-b/a-b-....png``."""
    part = F.split(word_id, "-")
    first, second = F.get(part, F.lit(0)), F.get(part, F.lit(1))
    return F.concat_ws(
        "/", F.lit(root), first, F.concat_ws("-", first, second), F.concat(word_id, F.lit(".png"))
    )


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)
