"""The inverted index as tables: postings, document statistics, document frequencies.

Records have ``record_id``, ``title``, ``creator``, ``subject``, ``description``,
``publisher``, ``identifier``, ``text`` (texts; nulls count as empty), ``media_type``,
``date`` and ``added_at``. Everything is aggregated by (record, term) before it is
shuffled by term, so a frequent term costs a row for each record and no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.functions import lexicon as lx
from stackroom.functions import text as tx

#: Indexed fields in their order, with the weight of a term found there.
FIELDS = {"title": 3, "creator": 2, "subject": 2, "description": 1, "publisher": 1, "identifier": 1, "text": 1}


def _by_field(records: DataFrame, name: str, of) -> DataFrame:
    """(record_id, field, place, weight, name): of(text), one row for each record and field that it has."""
    present = [f for f in FIELDS if f in records.columns]

    def one(field: str) -> Column:
        place = list(FIELDS).index(field)
        return F.struct(F.lit(field).alias("field"), F.lit(place).alias("place"), F.lit(FIELDS[field]).alias("weight"), of(F.coalesce(F.col(field), F.lit(""))).alias(name))

    return records.select("record_id", F.inline(F.array(*[one(f) for f in present])))


def field_terms(records: DataFrame) -> DataFrame:
    """(record_id, field, place, weight, terms): one row for each record and field that it has."""
    return _by_field(records, "terms", tx.terms)


def postings(records: DataFrame) -> DataFrame:
    """(term, record_id, wtf, fields): the weighted frequency of a term in a record, and the fields that hold it."""
    # words become terms as rows, in generated code, and not within arrays
    rows = _by_field(records, "words", tx.words).select("record_id", "place", "weight", F.explode("words").alias("word"))
    rows = rows.where((F.length("word") > 1) & ~F.col("word").isin(lx.STOP_WORDS)).select("record_id", "place", "weight", tx.stem(F.col("word")).alias("term"))
    # a bit for each field: a set of few bytes
    held = F.expr("bit_or(shiftleft(1, place))")
    found = rows.groupBy("record_id", "term").agg(F.sum("weight").cast("double").alias("wtf"), held.alias("held"))
    fields = F.array_compact(F.array(*[F.when(F.col("held").bitwiseAND(1 << i) != 0, F.lit(f)) for i, f in enumerate(FIELDS)]))
    return found.select("term", "record_id", "wtf", fields.alias("fields"))


def docstats(records: DataFrame) -> DataFrame:
    """(record_id, dl): terms over all fields, at least 1."""
    rows = _by_field(records, "words", tx.content_words)
    return rows.groupBy("record_id").agg(F.greatest(F.lit(1), F.sum(F.size("words"))).cast("long").alias("dl"))


def doc_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def upsert(index: DataFrame, changed: DataFrame, key: str = "record_id") -> DataFrame:
    """index with the rows of changed in place of those of the same records."""
    return index.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed)


def remove(index: DataFrame, gone: DataFrame, key: str = "record_id") -> DataFrame:
    return index.join(gone.select(key).distinct(), key, "left_anti")
