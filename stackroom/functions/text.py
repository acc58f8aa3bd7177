"""Text functions as column expressions: tokens, stems, sentences, language, markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackroom.functions import lexicon as lx

WORD = r"([\p{L}\p{N}]+)(?:['’]\p{L}+)?"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{lx.SPACE}+|{lx.SPACE}+$", "")


def clean(text: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return trim(F.regexp_replace(text, f"{lx.SPACE}+", " "))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, without apostrophe suffixes."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def _drop(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def undouble(w: Column) -> Column:
    """w without its last letter if that repeats the one before, but for l, s and z."""
    last = F.right(w, F.lit(1))
    twice = (F.length(w) > 2) & (F.right(_drop(w, 1), F.lit(1)) == last) & ~last.isin("l", "s", "z")
    return F.when(twice, _drop(w, 1)).otherwise(w)


def stem(w: Column) -> Column:
    """A light English stem; the first rule that fits decides."""
    n = F.length(w)
    # words that end otherwise, numbers among them, stay; most do
    other = ~(w.endswith("s") | w.endswith("ing") | w.endswith("ed"))
    return (
        F.when(other | (n <= 3), w)
        .when(w.endswith("ies") & (n > 4), F.concat(_drop(w, 3), F.lit("y")))
        .when(w.endswith("sses"), _drop(w, 2))
        .when(w.endswith("ing") & (n > 5), undouble(_drop(w, 3)))
        .when(w.endswith("ed") & (n > 4), undouble(_drop(w, 2)))
        .when((n > 4) & (w.endswith("ches") | w.endswith("shes") | w.endswith("xes") | w.endswith("zes")), _drop(w, 2))
        .when(w.endswith("s") & ~(w.endswith("ss") | w.endswith("us") | w.endswith("is")), _drop(w, 1))
        .otherwise(w)
    )


def content_words(text: Column) -> Column:
    """The words of two letters and more that are no stop words."""
    return F.filter(words(text), lambda w: (F.length(w) > 1) & ~w.isin(lx.STOP_WORDS))


def terms(text: Column) -> Column:
    """Stems of the content words."""
    return F.transform(content_words(text), stem)


def sentences(text: Column) -> Column:
    """Sentences of three characters and more."""
    parts = F.split(F.regexp_replace(text, f"{lx.SPACE}+", " "), r'(?<=[.!?]) +(?=[A-Z0-9“"(])')
    return F.filter(F.transform(parts, trim), lambda s: F.length(s) > 2)


def guess_language(text: Column) -> Column:
    """A struct (code, confidence), or null: votes of function words in the first 20,000 characters.

    A tie goes to the language that scored first in the text, then to the order of the list.
    """

    def judge(found: Column) -> Column:
        votes = [
            F.struct(
                F.size(F.filter(found, _is_in(marks))).alias("votes"),
                (-F.array_position(F.transform(found, _is_in(marks)), True)).alias("first"),
                F.lit(-i).alias("place"),
                F.lit(code).alias("code"),
            )
            for i, (code, marks) in enumerate(lx.LANGUAGE_MARKERS.items())
        ]
        return F.when(F.size(found) >= 20, F.array(*votes))

    def decide(votes: Column) -> Column:
        total = F.aggregate(votes, F.lit(0), lambda acc, v: acc + v["votes"])
        best = F.array_max(votes)
        return F.when(best["votes"] >= 5, F.struct(best["code"].alias("code"), (best["votes"] / total).alias("confidence")))

    return once(once(words(F.substring(text, 1, 20_000)), judge), decide)


def once(value: Column, then) -> Column:
    """then(value), with value computed once however often then names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _is_in(marks: list[str]):
    return lambda w: w.isin(marks)


def title_case(text: Column) -> Column:
    """Words with a capital first letter, but for small ones; the whole starts with a capital."""

    def one(w: Column) -> Column:
        small = (F.length(w) <= 3) & F.lower(w).isin(lx.SMALL_WORDS)
        return F.when(small, F.lower(w)).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w))))

    made = F.array_join(F.transform(F.filter(F.split(text, " "), lambda w: w != ""), one), " ")
    return F.when(made.rlike("^[A-Za-z0-9_]"), F.concat(F.upper(F.left(made, F.lit(1))), F.substring(made, F.lit(2), F.length(made)))).otherwise(made)


def _character(code: Column) -> Column:
    """The character of a code point, a blank for what is none (0, surrogates, beyond U+10FFFF, null)."""
    there = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    made = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(code == 0xFEFF, F.lit("\ufeff")).when(there, made).otherwise(" ")


def _decode_entities(text: Column) -> Column:
    """Entities decoded once each: a decoded ampersand starts no other entity."""
    pattern = rf"&(#x?[0-9a-fA-F]+|{'|'.join(lx.ENTITIES)});"
    pieces = F.split(F.regexp_replace(text, pattern, "\ue000$1\ue001"), "\ue000")
    number = lambda digits, base: F.when(F.length(digits) <= 7, F.conv(digits, base, 10).try_cast("bigint"))

    def piece(p: Column, i: Column) -> Column:
        name, rest = F.substring_index(p, "\ue001", 1), F.regexp_extract(p, "(?s)\ue001(.*)", 1)
        # longer numbers are beyond all code points; of decimal ones those with letters are none
        value = F.when(name.startswith("#x"), _character(number(F.regexp_replace(name, "^#x0*", ""), 16)))
        value = value.when(name.rlike("^#[0-9]+$"), _character(number(F.regexp_replace(name, "^#0*", ""), 10))).when(name.startswith("#"), F.lit(" "))
        for entity, char in lx.ENTITIES.items():
            value = value.when(name == entity, F.lit(char))
        return F.when(i == 0, p).otherwise(F.concat(value, rest))

    return F.array_join(F.transform(pieces, piece), "")


def strip_markup(html: Column) -> Column:
    """Text of HTML: blocks end lines, tags go, entities are decoded, blanks are collapsed."""
    s = F.regexp_replace(html, r"(?is)<(script|style|head)[^>]*>.*?</\1>", " ")
    s = F.regexp_replace(s, r"(?i)<br\s*/?>|</p>|</h[1-6]>|</div>|</li>", "\n")
    s = _decode_entities(F.regexp_replace(s, r"<[^>]+>", " "))
    s = F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), rf"\n{lx.SPACE}*\n+", "\n")
    return trim(s)


def html_title(html: Column) -> Column:
    return F.when(html.rlike(r"(?is)<title>.*?</title>"), strip_markup(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)))


def first_line_title(text: Column) -> Column:
    """The first line with text, if it reads like a heading; else null."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(trim(x), r"^#{1,3}\s+", "")), lambda x: x != "")
    line = F.get(lines, F.lit(0))
    short = F.length(line).between(4, 120) & (F.size(F.split(line, f"{lx.SPACE}+")) <= 14)
    return F.when(short & ~line.endswith(".") & ~line.contains(". ") & line.rlike(r"[A-Za-z\x{c0}-\x{24f}]"), line)


def summary(text: Column, title: Column) -> Column:
    """The first two sentences of five words and more, without headings and the title; cut at 320 characters."""
    body = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~trim(x).startswith("#") & (trim(x) != trim(title))), "\n")
    picked = F.filter(sentences(body), lambda s: (F.size(F.split(s, " ")) >= 5) & (s != trim(title)))
    shown = lambda made: F.when(F.length(made) > 320, F.concat(trim(F.left(made, F.lit(317))), F.lit("…"))).otherwise(made)
    return once(F.array_join(F.slice(picked, 1, 2), " "), shown)
