"""Labels that readers see, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackroom.functions import lexicon as lx

# Names of languages and of the sources of a value.
LANGUAGE_NAMES = {
    "eng": "English", "fre": "French", "spa": "Spanish", "ger": "German", "por": "Portuguese", "twi": "Twi",
    "aka": "Akan", "ewe": "Ewe", "hau": "Hausa", "yor": "Yoruba", "swa": "Swahili",
}
SOURCE_LABELS = {"embedded": "Embedded", "content": "Content", "filename": "File name", "rules": "Rules", "ai": "AI", "lookup": "Lookup", "user": "You"}


def _of(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def language_name(code: Column) -> Column:
    """The name of a language code; unknown codes stay."""
    return F.coalesce(_of(LANGUAGE_NAMES, code), code)


def media_label(media_type: Column) -> Column:
    return _of(lx.MEDIA_LABELS, media_type)


def element_label(element: Column) -> Column:
    return F.concat(F.upper(F.left(element, F.lit(1))), F.substring(element, 2, 1 << 20))


def source_badge(source: Column, confidence: Column) -> Column:
    """``You`` for a reader's value, else the source and how sure it is."""
    return F.when(source == "user", "You").otherwise(F.format_string("%s %.2f", F.coalesce(_of(SOURCE_LABELS, source), F.lit("You")), confidence.cast("double")))


def size_label(size_bytes: Column) -> Column:
    """Whole KB, from 1,024 KB on MB with one decimal, where a tie goes to the even digit."""
    kb = size_bytes / 1024
    # the formatter rounds ties up
    return F.when(kb > 1024, F.format_string("%.1f MB", F.bround(kb / 1024, 1))).otherwise(F.format_string("%.0f KB", kb))


def tile_label(file_name: Column, media_type: Column) -> Column:
    """The first four characters of the extension, or of the media label where there is none."""
    return F.left(F.upper(F.when(file_name.contains("."), F.substring_index(file_name, ".", -1)).otherwise(media_label(media_type))), F.lit(4))


def subtitle(creator: Column, date: Column, media_type: Column) -> Column:
    """First creator and year, or the media label where there is neither. Creator may be null."""
    year = F.nullif(F.regexp_extract(date, "^[0-9]{4}", 0), F.lit(""))
    return F.when(creator.isNull() & year.isNull(), media_label(media_type)).otherwise(F.concat_ws(" · ", creator, year))


def import_summary(added: Column, duplicates: Column) -> Column:
    """What an import did, in words; empty if nothing happened."""
    return F.concat_ws(
        ", ",
        F.when(added > 0, F.concat(added.cast("string"), F.lit(" drafted"))),
        F.when(duplicates > 0, F.concat(duplicates.cast("string"), F.lit(" already in your library"))),
    )
