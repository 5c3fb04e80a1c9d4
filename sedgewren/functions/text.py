"""Scalar text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as character class bodies for Java's patterns.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"

# Words that carry no search signal, English and Russian.
STOP_WORDS_EN = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would "
    "could should may might shall can this that these those it its as if not no nor so yet both either each any all some"
).split()
STOP_WORDS_RU = (
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из "
    "ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей "
    "может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот "
    "того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее были куда зачем всех никогда можно при наконец "
    "два об другой хоть после над больше тот через эти нас про всего какая много разве три эту моя впрочем хорошо свою этой "
    "перед иногда лучше чуть том нельзя такой им более всегда конечно всю между"
).split()
# Suffixes in the order in which they are tried.
SUFFIXES = ["ment", "tion", "ing", "ness", "ies", "ied", "ed", "er", "ly", "es", "s"]
STEM_LEAST = 4
# Blocks of CJK signs that are dropped from answers.
CJK = "[　-鿿豈-﫿︰-﹏＀-￯]"


def normalized(text: Column) -> Column:
    """White space runs become one blank, ends are cut."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def sentences(text: Column) -> Column:
    """Sentences of a text: cut after ., ! or ? before white space."""
    return F.filter(F.split(normalized(text), r"(?<=[.!?]) "), lambda s: F.length(s) > 0)


def stem(token: Column) -> Column:
    """Cut the first suffix of the list that leaves at least four letters."""
    out = None
    for suffix in SUFFIXES:
        fits = token.endswith(suffix) & (F.length(token) - len(suffix) >= STEM_LEAST)
        cut = F.left(token, F.length(token) - len(suffix))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(token)


def _words(text: Column, other: str) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), other, " ")), " ")


def raw_tokens(text: Column) -> Column:
    """Words for retrieval before stemming: Latin and Cyrillic letters and digits, without stop words."""
    return F.filter(_words(text, "[^a-zа-яё0-9]+"), lambda t: (F.length(t) > 1) & ~t.isin([*STOP_WORDS_EN, *dict.fromkeys(STOP_WORDS_RU)]))


def stemmed(token: Column) -> Column:
    """A word's stem; words with Cyrillic letters stay as they are."""
    return F.when(token.rlike("[а-яё]"), token).otherwise(stem(token))


def search_tokens(text: Column) -> Column:
    """Tokens for retrieval, in the order of the text."""
    return F.transform(raw_tokens(text), stemmed)


def rerank_tokens(text: Column) -> Column:
    """Tokens for reranking: ASCII letters and digits only, without English stop words, stemmed."""
    kept = F.filter(_words(text, "[^a-z0-9]+"), lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS_EN))
    return F.transform(kept, stem)


def bigrams(tokens: Column) -> Column:
    """Distinct pairs of adjacent tokens."""
    at = F.sequence(F.lit(1), F.size(tokens) - 1)
    pairs = F.transform(at, lambda i: F.concat(F.element_at(tokens, i), F.lit(" "), F.element_at(tokens, i + 1)))
    return F.when(F.size(tokens) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def overlap(asked: Column, found: Column) -> Column:
    """Share of the distinct asked items that are found; 0 if none is asked."""
    n = F.size(F.array_distinct(asked))
    return F.when(n > 0, F.size(F.array_intersect(asked, found)) / n).otherwise(F.lit(0.0))


def excerpt(text: Column, most: int = 150) -> Column:
    """One line of at most ``most`` characters; a longer text ends at its last blank within them, with an ellipsis."""
    raw = F.replace(stripped(text), F.lit("\n"), F.lit(" "))
    return F.when(F.length(raw) > most, F.concat(F.regexp_replace(F.left(raw, F.lit(most)), r" [^ ]*$", ""), F.lit("…"))).otherwise(raw)


def highlight_anchor(text: Column, most: int = 120, least: int = 40) -> Column:
    """The start of a text to search for on its page, cut at the last blank if that lies beyond ``least``."""
    head = F.left(stripped(text), F.lit(most))
    cut = F.regexp_replace(head, r" [^ ]*$", "")
    return F.when(head.contains(" ") & (F.length(cut) > least), cut).otherwise(head)


def found_at(text: Column, anchor: Column) -> Column:
    """Offset of an anchor in a text whose white space is normalised, letter case aside; -1 if absent or empty."""
    return F.when(normalized(anchor) == "", F.lit(-1)).otherwise(F.position(F.lower(normalized(anchor)), F.lower(normalized(text))) - 1)


def without_cjk(text: Column) -> Column:
    return F.regexp_replace(text, CJK, "")


def short_name(filename: Column, most: int = 22, kept: int = 20) -> Column:
    """A file name without .pdf; a long one is cut."""
    name = F.regexp_replace(filename, r"(?i)\.pdf$", "")
    return F.when(F.length(name) > most, F.concat(F.left(name, F.lit(kept)), F.lit("..."))).otherwise(name)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def is_pdf(path: Column) -> Column:
    return F.lower(path).endswith(".pdf")


def upload_folder(path: Column) -> Column:
    """Folder of a file in an uploaded tree: all parents joined if there are two or more, else the first part."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 1, F.size(parts) - 1), " / ")).otherwise(F.element_at(parts, 1))


def is_short_query(query: Column) -> Column:
    """At most two words: such a query is not expanded."""
    return F.size(F.filter(F.split(normalized(query), " "), lambda w: w != "")) <= 2


def expansion_lines(answer: Column) -> Column:
    """Query variants in a model's answer: up to four lines of over three characters, list marks dropped."""
    lines = F.transform(F.split(stripped(answer), "\n"), stripped)
    return F.slice(F.transform(F.filter(lines, lambda x: F.length(x) > 3), lambda x: F.regexp_replace(x, r"^[0-9.\-) ]+", "")), 1, 4)


def percent(score: Column) -> Column:
    return F.concat(F.floor(score * 100 + 0.5).cast("string"), F.lit("%"))
