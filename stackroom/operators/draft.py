"""Draft records: Dublin Core values with their source and confidence, from extracted files.

Everything is an expression over one row, but for classification, which aggregates the
few keyword hits of each record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.functions import dates as dt
from stackroom.functions import identifiers as ids
from stackroom.functions import lexicon as lx
from stackroom.functions import text as tx
from stackroom.operators.classify import classify
from stackroom.shared import materialize
from stackroom.sources import files as fl

FV = "array<struct<value:string,source:string,confidence:double>>"
TEXT_LIKE = ("txt", "md", "html", "htm", "csv")


def value(v: Column, source: Column | str, confidence: Column | float) -> Column:
    """A list of one value."""
    source = F.lit(source) if isinstance(source, str) else source
    confidence = F.lit(float(confidence)) if isinstance(confidence, (int, float)) else confidence.cast("double")
    return F.array(F.struct(v.alias("value"), source.alias("source"), confidence.alias("confidence")))


def values(vs: Column, source: Column | str, confidence: Column | float) -> Column:
    return F.flatten(F.transform(vs, lambda v: value(v, source, confidence)))


def empty() -> Column:
    return F.array().cast(FV)


def _pick(*cases: tuple[Column, Column]) -> Column:
    """The list of the first case whose condition holds."""
    out = F.when(F.coalesce(cases[0][0], F.lit(False)), cases[0][1])
    for when, then in cases[1:]:
        out = out.when(F.coalesce(when, F.lit(False)), then)
    return out.otherwise(empty())


def is_junk_title(title: Column) -> Column:
    s = F.lower(tx.trim(title))
    return s.isin("", "untitled") | s.startswith("microsoft word - ") | s.rlike(r"^[a-z0-9_\-]+\.(?:docx?|pdf|indd|tex)$") | s.rlike(r"^(?:document|scan|img)[\s_\-]*[0-9]*$")


def language_code(raw: Column) -> Column:
    """The three-letter code of a language's name or code; unknown codes of three letters stay, others are null."""
    s = F.lower(tx.trim(raw))
    known = F.create_map(*[F.lit(x) for pair in lx.LANGUAGE_OF.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.regexp_extract(s, "^[^-_]*", 0)), F.when(F.length(s) == 3, s))


def _filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def identified(files: DataFrame) -> DataFrame:
    """Extracted files with their identifiers and the media type that follows, and what those are made from."""
    ex = lambda name: F.col(f"extracted.{name}")
    ext = fl.extension(F.col("file_name"))
    embedded = F.when(ext.isin(*TEXT_LIKE), F.lit("content")).otherwise(F.lit("embedded"))
    df = files.withColumns(
        {"named": fl.parse_file_name(F.col("file_name")), "media": fl.media_type(F.col("file_name")), "ext": ext, "embedded": embedded, "text": F.coalesce(ex("text"), F.lit(""))}
    )
    source, text = F.col("embedded"), F.col("text")
    head = F.substring(text, 1, 20_000)

    bare = lambda raw: F.regexp_replace(raw, "(?i)^urn:isbn:", "")
    one = lambda raw: (
        F.when(ids.to_isbn13(bare(raw)).isNotNull(), value(F.concat(F.lit("ISBN "), ids.to_isbn13(bare(raw))), source, 0.97))
        .when(raw.rlike("(?i)^(?:urn:uuid:|uuid:)") | (raw == ""), empty())
        .otherwise(value(raw, source, 0.8))
    )
    given = F.flatten(F.transform(ex("identifiers"), one))
    df = df.withColumns({"given": F.coalesce(given, empty()), "isbn": F.get(ids.find_isbns(head), F.lit(0)), "doi": ids.find_doi(head)})
    has_isbn = F.exists("given", lambda v: v["value"].startswith("ISBN"))
    found = F.concat(
        F.when(F.col("isbn").isNotNull(), value(F.concat(F.lit("ISBN "), "isbn"), "content", 0.92)).otherwise(empty()),
        F.col("given"),
        F.when(F.col("doi").isNotNull(), value(F.concat(F.lit("doi:"), "doi"), "content", 0.9)).otherwise(empty()),
    )
    df = df.withColumn("identifier", F.when(has_isbn, F.col("given")).otherwise(found))
    is_book = (F.col("media") == "document") & F.exists("identifier", lambda v: v["value"].startswith("ISBN"))
    return df.withColumn("media_type", F.when(is_book, F.lit("book")).otherwise(F.col("media")))


def module() -> Column:
    """Where readers find records of a media type."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in lx.MODULES.items() for x in pair]), F.col("media_type"))


def draft(files: DataFrame, added_at: Column) -> DataFrame:
    """Records of extracted files (record_id, file_name, size_bytes, sha256, extracted).

    Columns: record_id, media_type, dc (a struct of lists of values), class_number,
    class_suggestions, status, file_name, size_bytes, sha256, page_count, text, added_at, module.
    """
    ex = lambda name: F.col(f"extracted.{name}")
    sure = lambda high, low: F.when(F.col("embedded") == "embedded", high).otherwise(low)
    df = identified(files)
    source, text, named = F.col("embedded"), F.col("text"), lambda x: F.col(f"named.{x}")
    labels = F.create_map(*[F.lit(x) for pair in lx.MEDIA_LABELS.items() for x in pair])
    first, when = tx.first_line_title(text), F.coalesce(ex("date"), named("date"))
    placeholder = F.concat(F.element_at(labels, F.col("media_type")), F.when(when.isNotNull(), F.concat(F.lit(" from "), when)).otherwise(F.lit("")))
    df = df.withColumn("first", first)
    df = df.withColumn(
        "title",
        _pick(
            (_filled(ex("title")) & ~is_junk_title(ex("title")), value(ex("title"), source, sure(0.95, 0.72))),
            (named("creator").isNotNull() & named("title").isNotNull(), value(named("title"), "filename", 0.75)),
            (F.col("first").isNotNull(), value(F.col("first"), "content", 0.68)),
            (_filled(named("title")), value(named("title"), "filename", 0.55)),
            (F.lit(True), value(placeholder, "rules", 0.4)),
        ),
    )
    by = r"(?m)^\s*(?:[Bb]y|[Aa]uthor:)\s+([A-Z][\w.\-’]+(?:[ \t]+[A-Z][\w.\-’]+){1,3})"
    start = F.substring(text, 1, 1_500)
    df = df.withColumn(
        "creator",
        _pick(
            (F.size(ex("creators")) > 0, values(ex("creators"), source, sure(0.92, 0.65))),
            (named("creator").isNotNull(), value(named("creator"), "filename", 0.7)),
            (start.rlike(by), value(F.regexp_extract(start, by, 1), "content", 0.6)),
        ),
    )
    written = dt.date_in_text(text)
    df = df.withColumn(
        "date",
        _pick(
            (_filled(ex("date")), value(dt.normalise_date(ex("date")), source, F.when(F.col("media_type") == "image", 0.9).otherwise(0.88))),
            (named("date").isNotNull(), value(named("date"), "filename", F.when(named("camera"), 0.8).otherwise(0.6))),
            (written.isNotNull(), value(written, "content", 0.6)),
        ),
    )
    df = df.withColumn("publisher", _pick((_filled(ex("publisher")), value(ex("publisher"), source, 0.9))))
    df = df.withColumns({"guess": tx.guess_language(text), "coded": language_code(ex("language"))})
    clamp = F.least(F.lit(0.97), F.greatest(F.lit(0.0), 0.5 + F.col("guess.confidence") / 2))
    df = df.withColumn("language", _pick((F.col("coded").isNotNull(), value(F.col("coded"), source, 0.95)), (F.col("guess.code").isNotNull(), value(F.col("guess.code"), "rules", clamp))))
    name = F.coalesce(F.get("title", F.lit(0))["value"], F.col("file_name"))
    df = df.withColumn("summary", tx.summary(text, name))
    df = df.withColumn("description", _pick((_filled(ex("description")), value(ex("description"), source, 0.9)), (_filled(F.col("summary")), value(F.col("summary"), "rules", 0.6))))
    types = F.create_map(*[F.lit(x) for pair in lx.DCMI_TYPES.items() for x in pair])
    mimes = F.create_map(*[F.lit(x) for pair in lx.MIME_TYPES.items() for x in pair])
    mime = F.try_element_at(mimes, F.col("ext"))
    pages = F.when(ex("page_count").isNotNull(), F.concat(F.lit("; "), ex("page_count").cast("string"), F.lit(" pages"))).otherwise(F.lit(""))
    df = df.withColumns({"type": value(F.element_at(types, F.col("media_type")), "rules", 0.99), "format": _pick((mime.isNotNull(), value(F.concat(mime, pages), "rules", 0.99)))})

    # written once: classification reads it too, and files are not to be extracted again
    df = materialize(df, "drafted")
    name = F.coalesce(F.get("title", F.lit(0))["value"], F.col("file_name"))
    main = lambda c: F.coalesce(F.get(c, F.lit(0))["value"], F.lit(""))
    basis = df.select(
        "record_id", name.alias("title"), main("description").alias("description"), F.array_join(ex("subjects"), ". ").alias("subject"), "text", main("language").alias("language")
    )
    df = df.join(classify(basis, F.col("language")), "record_id", "left")
    lower = F.transform(ex("subjects"), lambda s: F.lower(s))
    fresh = F.filter(F.coalesce("subjects", F.array().cast("array<string>")), lambda s: ~F.array_contains(lower, F.lower(s)))
    room = F.greatest(F.lit(0), 5 - F.size(ex("subjects")))
    df = df.withColumn("subject", F.concat(values(ex("subjects"), source, 0.88), values(F.slice(fresh, F.lit(1), room), "rules", 0.62)))
    best = F.get("suggestions", F.lit(0))
    dc = F.struct(*[(F.col(e) if e in df.columns else empty()).alias(e) for e in lx.DC_ELEMENTS])
    return df.select(
        "record_id",
        "media_type",
        dc.alias("dc"),
        F.when(best["confidence"] >= 0.5, best["number"]).alias("class_number"),
        F.coalesce("suggestions", F.array().cast("array<struct<number:string,label:string,confidence:double>>")).alias("class_suggestions"),
        F.lit("draft").alias("status"),
        "file_name",
        "size_bytes",
        "sha256",
        ex("page_count").alias("page_count"),
        "text",
        added_at.alias("added_at"),
        module().alias("module"),
    )
