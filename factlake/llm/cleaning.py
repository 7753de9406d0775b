"""Quality rules, line first, in DataFrame functions only.

Each line with a word is judged alone: does it read as prose (ends like a sentence, or is long and has sentence ends all
along), is it navigation (separators between short items, links, or no sentence at all), is it boilerplate (its phrases
stand in it, at least one for as many characters as a short line has). Lines that fail are removed, and a document that
loses too much of its text goes. The rules hold for lines of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of words, as a class and as characters.
_SPACE, _WORD, _SPACES = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]", " \t\n\u000b\f\r"
_SYMBOLS = "#*$%&|<>"
#: Ends of a sentence, with what may close after them.
_ENDS = r"""[.!?:;…。！？]["')\]»”’]*$"""
#: Characters that end a sentence, wherever they stand.
_STOPS = ".!?:;…。！？"
_BOILERPLATE = (
    r"(?i)(all rights reserved|copyright|©|\bcookies?\b|privacy policy|terms (of|and) (use|service|conditions)"
    r"|subscribe|newsletter|sign (in|up)|log ?in|javascript|lorem ipsum|click here|read more|share (this|on)"
    r"|licensed under|released under the|powered by)"
)
#: Separators of navigation items; a line of at least MANY of them, and of one for every four spaces, is navigation.
_SEPARATORS, _MANY = "|»›>•·", 3
#: Marks that prose hardly has; a line of more than one in ten is none.
_MARKS = "!#*$%&|<>~^=+@\\{}[]"
#: Characters for which a longer line needs one sentence end, and with one phrase for which a line is boilerplate; the share
#: of characters a document may lose.
LONG_LINE, MOST_LOST = 300, 0.5


def _count(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def line_stays(line: Column) -> Column:
    """Whether a line with words stays: it is no navigation, has few marks, reads as sentences, and is no boilerplate."""
    end = F.rtrim(F.substring(F.rtrim(line), -4, 4))
    length = F.char_length(line)
    sentences = end.rlike(_ENDS) | (length >= LONG_LINE) & (_count(line, _STOPS) * LONG_LINE >= length)
    boilerplate = line.rlike(_BOILERPLATE) & ((length < LONG_LINE) | (F.regexp_count(line, F.lit(_BOILERPLATE)) * LONG_LINE >= length))
    separators = _count(line, _SEPARATORS)
    navigation = (separators >= _MANY) & (separators * 4 >= _count(line, " "))
    marked = _count(line, _MARKS) * 10 > length
    return ~navigation & ~marked & sentences & ~boilerplate


def judged(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) as doc_id with the base counts, base_failed, kept, n_lines_removed and the cleaned text.

    Words stand between white space of [\\x20\\x09-\\x0D]. n_repeat_words: words in windows of three words that the text
    has at least twice. Windows are hashed (64 bits) and sorted with their places, those that equal a neighbour are
    repeated, and each covers three words less what the next one covers as well. Texts whose windows all differ, as
    most do, skip the sort. Null texts count as having no words and fail; equal rows give equal rows; other columns
    are ignored; an empty table gives no rows. Very long texts are judged whole. Each row is judged by itself: nothing is
    shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", "text", F.filter(F.split(text, f"{_SPACE}+"), lambda w: w != "").alias("_words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD)).alias("_lines"))
    words, hashes, ordered = F.col("_words"), F.col("_hashes"), F.col("_ordered")
    windows = F.sequence(F.lit(0), F.size(words) - 3)
    out = out.withColumn("_hashes", F.when(F.size(words) > 2, F.transform(windows, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))))
    repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
    out = out.withColumn("_ordered", F.when(repeated, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def equals(x: Column, i: Column) -> Column:
        return F.coalesce(x["h"] == F.get(ordered, i + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(ordered, F.when(i > 0, i - 1))["h"], F.lit(False))

    places = F.sort_array(F.transform(F.filter(ordered, equals), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    stays = F.col("_stays")
    out = out.withColumn("_stays", F.filter("_lines", line_stays))

    def characters(lines: Column) -> Column:
        return F.aggregate(lines, F.lit(0), lambda a, x: a + F.char_length(x))

    out = out.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        (F.char_length(text) - _count(text, _SPACES)).cast("long").alias("word_chars"),
        _count(text, _SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        (F.size("_lines") - F.size(stays)).cast("long").alias("n_lines_removed"),
        characters(F.col("_lines")).alias("_before"),
        characters(stays).alias("_after"),
        F.array_join(stays, "\n").alias("text"),
    )
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("_after") >= F.col("_before") * (1 - MOST_LOST))).drop("_before", "_after")
