"""Library exports as column expressions: MARC 21, ISO 2709, MARCXML, Dublin Core, ISO 690."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.functions import dates as dt
from stackroom.functions import lexicon as lx
from stackroom.functions import text as tx
from stackroom.operators.library import first, texts, title

FIELD = "struct<tag:string,ind1:string,ind2:string,data:string,subfields:array<struct<code:string,value:string>>>"
URN = "urn:stackroom:"
XSI = "http://www.w3.org/2001/XMLSchema-instance"
OAI_DC, DC_NS = "http://www.openarchives.org/OAI/2.0/oai_dc/", "http://purl.org/dc/elements/1.1/"
SLIM = "http://www.loc.gov/MARC21/slim"

#: Formats with label, extension and MIME type.
FORMATS = {
    "marc": ("MARC 21 (ISO 2709)", "mrc", "application/marc"),
    "marcxml": ("MARCXML", "xml", "application/marcxml+xml"),
    "dublin_core": ("Dublin Core (OAI-DC XML)", "xml", "application/xml"),
    "jsonld": ("JSON-LD", "jsonld", "application/ld+json"),
    "iso690": ("ISO 690 references", "txt", "text/plain"),
}


def is_organisation(name: Column) -> Column:
    return name.rlike(lx.ORGANISATION)


def invert_name(name: Column) -> Column:
    """``Surname, Names`` of two to four words; organisations and inverted names stay."""

    def inverted(n: Column, parts: Column) -> Column:
        turned = F.concat(F.element_at(parts, -1), F.lit(", "), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " "))
        return F.when(n.contains(",") | is_organisation(n) | ~F.size(parts).between(2, 4), n).otherwise(turned)

    return tx.once(tx.trim(name), lambda n: tx.once(F.split(n, f"{lx.SPACE}+"), lambda parts: inverted(n, parts)))


def non_filing(name: Column, language: Column) -> Column:
    """Characters of an English article at the start of a title."""
    size = F.when(name.startswith("The "), 4).when(name.startswith("A "), 2).when(name.startswith("An "), 3).otherwise(0)
    return F.when(language == "eng", size).otherwise(0)


def _control(tag: str, data: Column) -> Column:
    return F.struct(F.lit(tag).alias("tag"), F.lit(" ").alias("ind1"), F.lit(" ").alias("ind2"), data.alias("data"), F.array().cast("array<struct<code:string,value:string>>").alias("subfields")).cast(FIELD)


def _field(tag: Column | str, ind1: Column | str, ind2: Column | str, *subs: tuple[str, Column | str, Column | None]) -> Column:
    """A data field; a subfield with a condition is left out where that is false."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    made = [F.struct(F.lit(code).alias("code"), lit(v).alias("value")) for code, v, _ in subs]
    kept = [m if when is None else F.when(when, m) for m, (_, _, when) in zip(made, subs, strict=True)]
    return F.struct(lit(tag).alias("tag"), lit(ind1).alias("ind1"), lit(ind2).alias("ind2"), F.lit(None).cast("string").alias("data"), F.array_compact(F.array(*kept)).alias("subfields")).cast(FIELD)


def _name_field(name: Column, tags: tuple[str, str]) -> Column:
    def field(org: Column) -> Column:
        return _field(F.when(org, tags[1]).otherwise(tags[0]), F.when(org, "2").otherwise("1"), " ", ("a", F.when(org, name).otherwise(invert_name(name)), None))

    return tx.once(is_organisation(name), field)


def marc(now: Column) -> Column:
    """A struct (leader, fields) of a record; lengths are filled in by the writer."""
    none = F.array().cast(f"array<{FIELD}>")
    maybe = lambda when, field: F.when(when, F.array(field)).otherwise(none)
    lang, date, publisher, name = first("language"), first("date"), first("publisher"), title()
    creators, media = texts("creator"), F.col("media_type")
    year = dt.year_of(date)
    f008 = F.concat(
        F.date_format("added_at", "yyMMdd"), F.when(year.isNotNull(), F.concat(F.lit("s"), year, F.lit("    "))).otherwise("nuuuuuuuu"), F.lit("xx " + "|" * 17),
        F.when(F.length(lang) == 3, lang).otherwise("und"), F.lit(" d"),
    )

    def identifier(i: Column) -> Column:
        doi = F.lower(i).startswith("doi:")
        return (
            F.when(i.startswith("ISBN "), _field("020", " ", " ", ("a", F.substring(i, F.lit(6), F.length(i)), None)))
            .when(doi, _field("024", "7", " ", ("a", F.substring(i, F.lit(5), F.length(i)), None), ("2", "doi", None)))
            .otherwise(_field("024", "8", " ", ("a", i, None)))
        )

    has = F.size(creators) > 0
    extent = F.when(F.col("page_count").isNotNull(), F.concat(F.lit("1 online resource ("), F.col("page_count").cast("string"), F.lit(" pages)"))).otherwise("1 online resource")
    kind = lambda *pairs: F.coalesce(*[F.when(media.isin(*m.split()), F.lit(v)) for m, v in pairs])
    term = kind(("book document", "text"), ("image", "still image"), ("video", "two-dimensional moving image"), ("audio", "spoken word"), ("other", "computer dataset"))
    code = kind(("book document", "txt"), ("image", "sti"), ("video", "tdi"), ("audio", "spw"), ("other", "cod"))
    others = F.concat(F.when(has, F.slice(creators, F.lit(2), F.greatest(F.lit(0), F.size(creators) - 1))).otherwise(F.array().cast("array<string>")), texts("contributor"))
    mime = F.trim(F.substring_index(first("format"), ";", 1))
    fields = F.concat(
        F.array(_control("001", F.col("record_id")), _control("005", F.concat(F.date_format(now, "yyyyMMddHHmmss"), F.lit(".0"))), _control("008", f008)),
        F.transform(texts("identifier"), identifier),
        maybe(F.length(lang) == 3, _field("041", "0", " ", ("a", lang, None))),
        maybe(F.col("class_number").isNotNull(), _field("082", "0", "4", ("a", F.col("class_number"), None), ("2", "23", None))),
        F.transform(F.slice(creators, 1, 1), lambda c: _name_field(c, ("100", "110"))),
        F.array(_field("245", F.when(has, "1").otherwise("0"), non_filing(name, lang).cast("string"), ("a", name, None), ("c", F.array_join(creators, ", "), has))),
        maybe((publisher != "") | (date != ""), _field("264", " ", "1", ("b", publisher, publisher != ""), ("c", date, date != ""))),
        F.array(
            _field("300", " ", " ", ("a", extent, None)),
            _field("336", " ", " ", ("a", term, None), ("b", code, None), ("2", "rdacontent", None)),
            _field("337", " ", " ", ("a", "computer", None), ("b", "c", None), ("2", "rdamedia", None)),
            _field("338", " ", " ", ("a", "online resource", None), ("b", "cr", None), ("2", "rdacarrier", None)),
        ),
        maybe(first("description") != "", _field("520", " ", " ", ("a", first("description"), None))),
        maybe(F.coalesce("sha256", F.lit("")) != "", _field("590", " ", " ", ("a", F.concat(F.lit("SHA-256 checksum: "), "sha256"), None))),
        F.transform(texts("subject"), lambda s: _field("650", " ", "4", ("a", s, None))),
        F.transform(others, lambda c: _name_field(c, ("700", "710"))),
        F.array(_field("856", "4", " ", ("f", F.col("file_name"), None), ("q", mime, mime != ""))),
    )
    musical = F.coalesce(F.col("class_number").startswith("78"), F.lit(False)) | F.exists(texts("subject"), lambda s: F.exists(tx.terms(s), lambda t: t.isin("music", "song")))
    letter = F.when(media == "audio", F.when(musical, "j").otherwise("i")).otherwise(kind(("book document", "a"), ("image", "k"), ("video", "g"), ("other", "m")))
    return F.struct(F.concat(F.lit("00000n"), letter, F.lit("m a2200000uc 4500")).alias("leader"), fields.alias("fields"))


def _field_body(f: Column) -> Column:
    subs = F.array_join(F.transform(f["subfields"], lambda s: F.concat(F.lit("\x1f"), s["code"], s["value"])), "")
    return F.concat(F.when(f["data"].isNotNull(), f["data"]).otherwise(F.concat(f["ind1"], f["ind2"], subs)), F.lit("\x1e"))


def iso2709(marc_col: Column) -> Column:
    """A struct (bytes, error): the record as ISO 2709, or what limit it breaks. Lengths count bytes."""

    def written(m: Column, bodies: Column, walk: Column) -> Column:
        base = F.length(walk["dir"]) + 25
        total = base + walk["at"] + 1
        leader = F.concat(F.lpad(total.cast("string"), 5, "0"), F.substring(m["leader"], 6, 7), F.lpad(base.cast("string"), 5, "0"), F.substring(m["leader"], 18, 7))
        text = F.concat(leader, walk["dir"], F.lit("\x1e"), F.array_join(F.transform(bodies, lambda b: b["body"]), ""), F.lit("\x1d"))
        error = F.when(walk["most"] > 9_999, "a field exceeds 9999 bytes").when(total > 99_999, "the record exceeds 99999 bytes")
        return F.struct(F.when(error.isNull(), text.cast("binary")).alias("bytes"), error.alias("error"), leader.alias("leader"))

    def walked(bodies: Column) -> Column:
        start = F.struct(F.lit("").alias("dir"), F.lit(0).alias("at"), F.lit(0).alias("most"))
        return F.aggregate(
            bodies,
            start,
            lambda acc, b: tx.once(
                F.octet_length(b["body"]),
                lambda n: F.struct(
                    F.concat(acc["dir"], b["tag"], F.lpad(n.cast("string"), 4, "0"), F.lpad(acc["at"].cast("string"), 5, "0")).alias("dir"),
                    (acc["at"] + n).alias("at"),
                    F.greatest(acc["most"], n).alias("most"),
                ),
            ),
        )

    def record(m: Column) -> Column:
        made = F.transform(m["fields"], lambda f: F.struct(f["tag"].alias("tag"), _field_body(f).alias("body")))
        return tx.once(made, lambda bodies: tx.once(walked(bodies), lambda walk: written(m, bodies, walk)))

    return tx.once(marc_col, record)


def display(marc_col: Column) -> Column:
    """The mnemonic form of a record."""
    subs = lambda f: F.array_join(F.transform(f["subfields"], lambda s: F.concat(F.lit("$"), s["code"], F.lit(" "), s["value"])), " ")
    blank = lambda x: F.replace(x, F.lit(" "), F.lit("_"))
    line = lambda f: F.when(f["data"].isNotNull(), F.concat(f["tag"], F.lit("    "), f["data"])).otherwise(F.concat(f["tag"], F.lit(" "), blank(f["ind1"]), blank(f["ind2"]), F.lit(" "), subs(f)))
    return F.array_join(F.concat(F.array(F.concat(F.lit("LDR  "), marc_col["leader"])), F.transform(marc_col["fields"], line)), "\n")


def escape(s: Column, quotes: bool = False) -> Column:
    """XML text: control characters go."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if quotes else ())):
        s = F.replace(s, F.lit(char), F.lit(name))
    return F.regexp_replace(s, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def marcxml(marc_col: Column) -> Column:
    """A record element; ``documents`` adds the collection around it."""
    sub = lambda s: F.concat(F.lit('      <subfield code="'), s["code"], F.lit('">'), escape(s["value"], True), F.lit("</subfield>\n"))
    control = lambda f: F.concat(F.lit('    <controlfield tag="'), f["tag"], F.lit('">'), escape(f["data"], True), F.lit("</controlfield>\n"))
    data = lambda f: F.concat(
        F.lit('    <datafield tag="'), f["tag"], F.lit('" ind1="'), f["ind1"], F.lit('" ind2="'), f["ind2"], F.lit('">\n'), F.array_join(F.transform(f["subfields"], sub), ""), F.lit("    </datafield>\n")
    )

    def record(m: Column) -> Column:
        fields = F.array_join(F.transform(m["fields"], lambda f: F.when(f["data"].isNotNull(), control(f)).otherwise(data(f))), "")
        return F.concat(F.lit("  <record>\n    <leader>"), iso2709(m)["leader"], F.lit("</leader>\n"), fields, F.lit("  </record>\n"))

    return tx.once(marc_col, record)


XML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n'
MARCXML_HEAD = f'<?xml version="1.0" encoding="UTF-8"?>\n<collection xmlns="{SLIM}" xmlns:xsi="{XSI}" xsi:schemaLocation="{SLIM} http://www.loc.gov/standards/marcxml/schema/MARC21slim.xsd">\n'
MARCXML_TAIL = "</collection>\n"


def oai_dc(indent: str = "") -> Column:
    """A record as an oai_dc:dc element, in the order of the vocabulary; the class follows the subjects."""
    lines = []
    for e in lx.DC_ELEMENTS:
        lines.append(_dc_lines(e, indent))
        if e == "subject":
            lines.append(F.when(F.col("class_number").isNotNull(), F.array(F.concat(F.lit(f"{indent}  <dc:subject>DDC "), escape(F.col("class_number")), F.lit("</dc:subject>\n")))).otherwise(F.array().cast("array<string>")))
    head = f'{indent}<oai_dc:dc xmlns:oai_dc="{OAI_DC}" xmlns:dc="{DC_NS}" xmlns:xsi="{XSI}" xsi:schemaLocation="{OAI_DC} http://www.openarchives.org/OAI/2.0/oai_dc.xsd">\n'
    return F.concat(F.lit(head), F.array_join(F.concat(*lines), ""), F.lit(f"{indent}</oai_dc:dc>\n"))


def _dc_lines(element: str, indent: str) -> Column:
    return F.transform(texts(element), lambda v: F.concat(F.lit(f"{indent}  <dc:{element}>"), escape(v), F.lit(f"</dc:{element}>\n")))


def oai_dc_document() -> Column:
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n'), oai_dc())


def _json_string(v: Column) -> Column:
    made = F.to_json(F.array(v))
    return F.substring(made, F.lit(2), F.length(made) - 2)


def jsonld(urn: str = URN) -> Column:
    """A record as JSON-LD: one value stands alone, several are a list."""

    def member(element: str) -> Column:
        vs = texts(element)
        body = F.when(F.size(vs) == 1, _json_string(F.get(vs, F.lit(0)))).otherwise(F.to_json(vs))
        return F.when(F.size(vs) > 0, F.concat(F.lit(f'"dcterms:{element}":'), body))

    parts = [F.lit('"@context":{"dcterms":"http://purl.org/dc/terms/"}'), F.concat(F.lit('"@id":'), _json_string(F.concat(F.lit(urn), F.col("record_id")))), *[member(e) for e in lx.DC_ELEMENTS]]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def _ended(s: Column) -> Column:
    return tx.once(s, lambda x: F.when(x.rlike(r"[.?!]\z"), x).otherwise(F.concat(x, F.lit("."))))


def _cited(name: Column) -> Column:
    def upper(inverted: Column) -> Column:
        surname = F.substring_index(inverted, ",", 1)
        return F.concat(F.upper(surname), F.substring(inverted, F.length(surname) + 1, F.length(inverted)))

    return F.when(is_organisation(name), name).otherwise(tx.once(invert_name(name), upper))


def iso690() -> Column:
    """The reference: creators, title and medium, publisher and year, identifier."""
    creators = texts("creator")

    def listed_names(names: Column) -> Column:
        n = F.size(names)
        who = F.when(F.size(creators) > 3, F.concat(F.get(names, F.lit(0)), F.lit(" et al"))).when(n == 1, F.get(names, F.lit(0)))
        return who.otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(F.lit(0), n - 1)), ", "), F.lit(" and "), F.try_element_at(names, F.lit(-1))))

    who = tx.once(F.transform(F.slice(creators, 1, 3), _cited), listed_names)
    media, form = F.col("media_type"), F.lower(first("format"))
    medium = (
        F.when((media == "book") & form.contains("epub"), "[e-book]")
        .when((media == "document") & form.contains("pdf"), "[PDF]")
        .when(media == "image", "[photograph]")
        .when(media == "video", "[video recording]")
        .when(media == "audio", "[audio recording]")
        .otherwise("[online]")
    )
    some = lambda c: F.when(c != "", c)
    year = F.coalesce(dt.year_of(first("date")), first("date"))
    published = F.concat_ws(", ", some(first("publisher")), some(year))
    listed = F.filter(texts("identifier"), lambda i: i.startswith("ISBN") | F.lower(i).startswith("doi:"))
    ident = F.get(listed, F.lit(0))
    ident = F.when(F.lower(ident).startswith("doi:"), F.concat(F.lit("DOI "), F.substring(ident, F.lit(5), F.length(ident)))).otherwise(ident)
    return F.concat_ws(
        " ", F.when(F.size(creators) > 0, _ended(who)), _ended(F.concat(title(), F.lit(" "), medium)), F.when(published != "", _ended(published)), F.when(ident.isNotNull(), _ended(ident))
    )


def preview(format: str, exported: Column) -> Column:
    """The start of an export: of ISO 2709 with its control characters made visible."""
    if format == "marc":
        shown = F.decode(F.substring(exported, 1, 1_600), "UTF-8")
        return F.translate(shown, "\x1d\x1e\x1f", "␝␞␟")
    return F.substring(exported, 1, 4_000)


def indented_jsonld(indent: str = "    ", urn: str = URN) -> Column:
    """A record as JSON-LD over several lines, as a member of a graph."""

    def member(element: str) -> Column:
        vs = F.transform(texts(element), _json_string)
        several = F.concat(F.lit(f"[\n{indent}    "), F.array_join(vs, f",\n{indent}    "), F.lit(f"\n{indent}  ]"))
        return F.when(F.size(vs) > 0, F.concat(F.lit(f'"dcterms:{element}": '), F.when(F.size(vs) == 1, F.get(vs, F.lit(0))).otherwise(several)))

    context = F.lit(f'"@context": {{\n{indent}    "dcterms": "http://purl.org/dc/terms/"\n{indent}  }}')
    parts = [context, F.concat(F.lit('"@id": '), _json_string(F.concat(F.lit(urn), F.col("record_id")))), *[member(e) for e in lx.DC_ELEMENTS]]
    return F.concat(F.lit(f"{indent}{{\n{indent}  "), F.array_join(F.array_compact(F.array(*parts)), f",\n{indent}  "), F.lit(f"\n{indent}}}"))


#: What stands before, between and after the records of a collection, and what a collection without records is.
COLLECTIONS = {
    "marc": ("", "", "", ""),
    "marcxml": (MARCXML_HEAD, "", MARCXML_TAIL, MARCXML_HEAD + MARCXML_TAIL),
    "dublin_core": (f'{XML_HEAD}<records xmlns:oai_dc="{OAI_DC}" xmlns:dc="{DC_NS}">\n', "", "</records>\n", f'{XML_HEAD}<records xmlns:oai_dc="{OAI_DC}" xmlns:dc="{DC_NS}">\n</records>\n'),
    "jsonld": ('{\n  "@graph": [\n', ",\n", "\n  ]\n}", '{\n  "@graph": []\n}'),
    "iso690": ("", "\n", "", ""),
}
ENDINGS = {"marc": "mrc", "marcxml": "xml", "dublin_core": "xml", "jsonld": "jsonld", "iso690": "txt"}


def _member(format: str, now: Column) -> Column:
    return indented_jsonld() if format == "jsonld" else EXPORTERS[format](now)


def document(records: DataFrame, format: str, now: Column) -> DataFrame:
    """One row with one document (column ``document``) of all records, newest first: for a selection that a reader
    exports, as the document has to fit a row. ``documents`` writes collections of any size."""
    head, between, tail, none = COLLECTIONS[format]
    rows = records.select("added_at", "record_id", _member(format, now).cast("string").alias("body"))
    # newest first; sort_array sorts upwards, so times are counted back
    back = -F.unix_micros(F.col("added_at").cast("timestamp"))
    held = rows.agg(F.sort_array(F.collect_list(F.struct(back.alias("back"), "record_id", "body"))).alias("rows"))
    bodies = F.filter(F.transform("rows", lambda r: r["body"]), lambda b: b.isNotNull())
    whole = F.concat(F.lit(head), F.array_join(bodies, between), F.lit(tail))
    return held.select(F.when(F.size(bodies) > 0, whole).otherwise(F.lit(none)).alias("document"))


def documents(records: DataFrame, format: str, folder: str, now: Column) -> DataFrame:
    """Writes a whole collection document for each partition to a folder that the cluster shares; returns the
    written (path, records). Records without an export, as of a field too long for ISO 2709, are left out."""
    from stackroom.shared import materialize, open_store

    head, between, tail, _ = (x.encode() for x in COLLECTIONS[format])
    ending = ENDINGS[format]
    source = records.select(_member(format, now).cast("binary").alias("body")).where("body IS NOT NULL")

    def run(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        bodies = (body for batch in batches for body in batch.column(0).to_pylist())
        first = next(bodies, None)
        if first is None:
            return
        name, n = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.{ending}", 1
        fs, root = open_store(folder)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(head + first)
            for body in bodies:
                out.write(between + body)
                n += 1
            out.write(tail)
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n]})

    return materialize(source.mapInArrow(run, "path string, records long"), "documents-manifest")


def file_names(records: DataFrame, format: str, many: str = "library") -> Column:
    """What an export is saved as: a single record under its title, several under one fixed name."""
    alone = records.limit(2).count() == 1
    slug = F.regexp_replace(title(), "[^A-Za-z0-9]+", "_") if alone else F.lit(many)
    return F.concat(slug, F.lit(f".{ENDINGS[format]}"))


EXPORTERS = {"marc": lambda now: iso2709(marc(now))["bytes"], "marcxml": lambda now: marcxml(marc(now)), "dublin_core": lambda now: oai_dc("  "), "jsonld": lambda now: jsonld(), "iso690": lambda now: iso690()}


def export(records: DataFrame, format: str, now: Column) -> DataFrame:
    """(record_id, exported) in one of FORMATS."""
    return records.select("record_id", EXPORTERS[format](now).alias("exported"))


MARC_SCHEMA = T.StructType(
    [
        T.StructField("leader", T.StringType()),
        T.StructField(
            "fields",
            T.ArrayType(
                T.StructType(
                    [*(T.StructField(x, T.StringType()) for x in ("tag", "ind1", "ind2", "data")), T.StructField("subfields", T.ArrayType(T.StructType([T.StructField("code", T.StringType()), T.StructField("value", T.StringType())])))]
                )
            ),
        ),
    ]
)


def read_record(data: bytes) -> dict:
    """The leader and fields of an ISO 2709 record; ValueError says what is wrong with it."""
    if len(data) < 25:
        raise ValueError("too short for ISO 2709")
    leader = data[:24].decode("ascii")
    length, base = int(leader[:5]), int(leader[12:17])
    if length != len(data):
        raise ValueError(f"leader length {length}, not {len(data)}")
    if data[-1:] != b"\x1d":
        raise ValueError("no record terminator")
    if data[base - 1 : base] != b"\x1e":
        raise ValueError("no directory terminator")
    fields = []
    for tag, size, start in struct.iter_unpack("3s4s5s", data[24 : base - 1]):
        body = data[base + int(start) : base + int(start) + int(size)]
        if body[-1:] != b"\x1e":
            raise ValueError(f"field {tag.decode()} is not terminated")
        body = body[:-1]
        if int(tag) < 10:
            fields.append({"tag": tag.decode(), "ind1": " ", "ind2": " ", "data": body.decode(), "subfields": []})
            continue
        lead, *subs = body.split(b"\x1f")
        if len(lead) != 2:
            raise ValueError(f"bad subfield in {tag.decode()}")
        pairs = [{"code": s.decode()[:1], "value": s.decode()[1:]} for s in subs]
        fields.append({"tag": tag.decode(), "ind1": chr(lead[0]), "ind2": chr(lead[1]), "data": None, "subfields": pairs})
    return {"leader": leader, "fields": fields}


def split_collection(data: bytes) -> list[bytes]:
    """The records of a collection, by the lengths in their leaders."""
    out, at = [], 0
    while at < len(data):
        size = int(data[at : at + 5])
        if size < 25:
            raise ValueError("too short for ISO 2709")
        out.append(data[at : at + size])
        at += size
    return out


def parse_marc(rows: DataFrame, bytes_col: str, keep: list[str]) -> DataFrame:
    """The columns of keep with marc and error: a bad record has an error and no fields."""
    source = rows.select(*keep, F.col(bytes_col).alias("__bytes"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("marc", MARC_SCHEMA), T.StructField("error", T.StringType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema).field("marc").type
        for batch in batches:
            made, errors = [], []
            for data in batch.column(batch.num_columns - 1).to_pylist():
                try:
                    made.append(read_record(data or b""))
                    errors.append(None)
                except ValueError as e:
                    made.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, kind), pa.array(errors, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)


def read_mrc(spark, glob: str) -> DataFrame:
    """(path, number, marc, error) of the records of .mrc files."""
    files = spark.read.format("binaryFile").load(glob).select("path", "content")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = split_collection(data)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(parts)), pa.array(list(range(len(parts))), pa.int64()), pa.array(parts, pa.binary())], names=["path", "number", "bytes"])

    rows = files.mapInArrow(run, "path string, number long, bytes binary")
    return parse_marc(rows, "bytes", ["path", "number"])


def write_mrc(records: DataFrame, folder: str, now: Column) -> DataFrame:
    """Writes a .mrc file for each partition; see ``documents``."""
    return documents(records, "marc", folder, now)
