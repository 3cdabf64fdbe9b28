"""JSON, CSV, XML, cookies and HTTP headers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def json_get(j, path: str, default=None) -> Column:
    """A value by path (``$.a.b``) as text, or the default."""
    out = F.get_json_object(_c(j), path)
    return out if default is None else F.coalesce(out, F.lit(default))


def json_typed(j, path: str, kind: str, default=None) -> Column:
    """A value by path cast to a type; the default where it is missing or doesn't fit."""
    out = F.try_variant_get(F.try_parse_json(_c(j)), path, kind)
    return out if default is None else F.coalesce(out, F.lit(default).cast(kind))


def json_names(j) -> Column:
    return F.array_sort(F.json_object_keys(_c(j)))


def json_length(j) -> Column:
    return F.coalesce(F.json_array_length(_c(j)), F.size(F.json_object_keys(_c(j))))


def json_has(j, name: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(_c(j)), name), F.lit(False))


def json_quote(s) -> Column:
    """Text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(_c(s).alias("s"))), r'^\{"s":(.*)\}$', 1)


def json_pretty(x) -> Column:
    return F.to_json(_c(x), {"pretty": "true"})


def coerce(s) -> Column:
    """The JSON text of a bare value: true, false, null and numbers as they are (0x as hexadecimal), anything else quoted."""
    v = F.trim(_c(s))
    low = F.lower(v)
    return (
        F.when(low.isin("true", "false", "null"), low)
        .when(low.rlike("^-?0x[0-9a-f]{1,15}$"), F.concat(F.when(low.startswith("-"), "-").otherwise(""), F.conv(F.regexp_replace(low, "^-?0x", ""), 16, 10)))
        .when(v.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), v)
        .otherwise(json_quote(v))
    )


def csv_row(*columns) -> Column:
    """A comma-separated row, quoted where needed."""
    return F.to_csv(F.struct(*[_c(c) for c in columns]))


def csv_to_json(row, names: list[str]) -> Column:
    return F.to_json(F.from_csv(_c(row), F.lit(", ".join(f"`{n}` string" for n in names))))


def xml_escape(s) -> Column:
    out = _c(s)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def xml_text(x, path: str) -> Column:
    """The first text at an XPath."""
    return F.xpath_string(_c(x), F.lit(path))


def xml_to_json(x, schema: str) -> Column:
    return F.to_json(F.from_xml(_c(x), F.lit(schema)))


def element_to_jsonml(name, attributes, text) -> Column:
    """["name", {attributes}, "text"] of an element."""
    return F.concat(F.lit("["), json_quote(name), F.lit(","), F.to_json(_c(attributes)), F.lit(","), json_quote(text), F.lit("]"))


def cookies(header) -> Column:
    """Names and values of a cookie header as a map; percent escapes are decoded."""
    pairs = F.filter(F.split(_c(header), r";\s*"), lambda p: p.contains("="))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.url_decode(F.trim(F.regexp_replace(p, "^[^=]*=", ""))).alias("value"))))


def cookie_header(m) -> Column:
    return F.array_join(F.transform(F.map_entries(_c(m)), lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"]))), ";")


def http_headers(raw) -> Column:
    """Headers of an HTTP message as a map with lower-case names; of repeated ones the last."""
    head = F.substring_index(F.replace(_c(raw), F.lit("\r"), F.lit("")), "\n\n", 1)
    rows = F.filter(F.split(head, "\n"), lambda r: r.rlike("^[A-Za-z-]+:"))
    parts = F.transform(rows, lambda r: F.struct(F.lower(F.substring_index(r, ":", 1)).alias("key"), F.trim(F.regexp_replace(r, "^[^:]*:", "")).alias("value")))
    last = F.filter(parts, lambda p, i: ~F.exists(F.slice(parts, i + 2, F.size(parts)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


# ---------------------------------------------------------------- JSON updates (objects come back with sorted names)


def _object(j) -> Column:
    return F.parse_json(_c(j)).cast("map<string,variant>")


def _items(j) -> Column:
    return F.parse_json(_c(j)).cast("array<variant>")


def json_is_null(j, name: str) -> Column:
    """Whether the member is JSON null or missing."""
    value = F.variant_get(F.parse_json(_c(j)), f"$.{name}", "variant")
    return value.isNull() | F.is_variant_null(value)


def json_put(j, name: str, value) -> Column:
    """The object with a member set to a value that is JSON text itself."""
    one = F.create_map(F.lit(name), F.parse_json(_c(value)))
    return F.to_json(F.parse_json(F.to_json(F.map_concat(F.map_filter(_object(j), lambda k, v: k != name), one))))


def json_remove(j, name: str) -> Column:
    return F.to_json(F.map_filter(_object(j), lambda k, v: k != name))


def json_increment(j, name: str, by: int = 1) -> Column:
    """The object with a whole number raised; a missing member counts as 0."""
    return json_put(j, name, (F.coalesce(F.try_variant_get(F.parse_json(_c(j)), f"$.{name}", "long"), F.lit(0).cast("long")) + by).cast("string"))


def json_accumulate(j, name: str, value) -> Column:
    """A missing member is set; a single value and the new one become an array; an array grows."""
    old = F.variant_get(F.parse_json(_c(j)), f"$.{name}", "variant")
    kind = F.schema_of_variant(old)
    new = F.parse_json(_c(value))
    grown = F.when(old.isNull(), F.to_json(new)).when(kind.startswith("ARRAY"), F.to_json(F.array_append(F.try_variant_get(old, "$", "array<variant>"), new))).otherwise(F.to_json(F.array(old, new)))
    return json_put(j, name, grown)


def json_append(j, name: str, value) -> Column:
    """A missing member becomes an array of the value; an array grows."""
    old = F.try_variant_get(F.parse_json(_c(j)), f"$.{name}", "array<variant>")
    return json_put(j, name, F.to_json(F.array_append(F.coalesce(old, F.array().cast("array<variant>")), F.parse_json(_c(value)))))


def json_array_join(j, sep: str) -> Column:
    return F.array_join(F.transform(_items(j), lambda x: F.to_json(x)), sep)


def json_array_put(j, at: int, value) -> Column:
    """The array with a place set; places between its end and that one become null."""
    some = _items(j)
    none = F.array(*[F.parse_json(F.lit("null"))] * (at + 1))
    padded = F.concat(some, F.slice(none, 1, F.greatest(F.lit(at + 1) - F.size(some), F.lit(0))))
    return F.to_json(F.transform(padded, lambda x, i: F.when(i == at, F.parse_json(_c(value))).otherwise(x)))


def json_array_remove(j, at: int) -> Column:
    return F.to_json(F.filter(_items(j), lambda x, i: i != at))


def json_object(**members) -> Column:
    """Written object of columns, in the order given."""
    return F.to_json(F.struct(*[_c(v).alias(k) for k, v in members.items()]), {"ignoreNullFields": "false"})


def json_array(*values) -> Column:
    return F.to_json(F.array(*[_c(v) for v in values]))


# ---------------------------------------------------------------- CSV tables, JSONML, HTTP


def csv_fields(row) -> Column:
    """Fields of a row; a quoted one may hold commas and doubled quotes."""
    found = F.regexp_extract_all(F.concat(F.lit(","), _c(row)), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    return F.transform(found, lambda x: F.when(x.rlike('^".*"$'), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(F.trim(x)))


def csv_table_to_json(text) -> Column:
    """Rows of a table with a header line as an array of JSON objects."""
    rows = F.filter(F.split(_c(text), "\r?\n"), lambda r: r != "")
    names = csv_fields(F.get(rows, 0))
    body = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    return F.to_json(F.transform(body, lambda r: F.map_from_arrays(names, F.transform(names, lambda _, i: F.get(csv_fields(r), i)))))


def json_to_csv(j, names: list[str]) -> Column:
    """A header line and a row for each object of an array."""
    quote = lambda x: F.when(x.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    rows = F.from_json(_c(j), "array<map<string,string>>")
    lines = F.transform(rows, lambda r: F.concat_ws(",", *[quote(F.coalesce(r[n], F.lit(""))) for n in names]))
    return F.array_join(F.concat(F.array(F.lit(",".join(names))), lines), "\n")


def jsonml(name, attributes, *children) -> Column:
    """["name", {attributes}, child, ...]; a child is JSON text itself (a quoted text or another element)."""
    return F.concat(F.lit("["), json_quote(name), F.lit(","), F.to_json(_c(attributes)), *[F.concat(F.lit(","), _c(x)) for x in children], F.lit("]"))


def cookie(text) -> Column:
    """One cookie with its attributes: a map of name, value, and attributes by lower-case name (``secure``: true)."""
    parts = F.transform(F.split(_c(text), ";"), lambda p: F.trim(p))
    first = F.get(parts, 0)
    decoded = lambda p: F.url_decode(F.trim(F.regexp_replace(p, "^[^=]*=", "")))
    rest = F.transform(
        F.filter(F.slice(parts, 2, F.size(parts)), lambda p: p != ""),
        lambda p: F.struct(F.lower(F.trim(F.substring_index(p, "=", 1))).alias("key"), F.when(p.contains("="), decoded(p)).otherwise("true").alias("value")),
    )
    own = F.array(F.struct(F.lit("name").alias("key"), F.url_decode(F.trim(F.substring_index(first, "=", 1))).alias("value")), F.struct(F.lit("value").alias("key"), decoded(first).alias("value")))
    return F.map_from_entries(F.concat(own, rest))


def http_start(raw) -> Column:
    """The first line of an HTTP message: method and target of a request, or status and reason of a response."""
    line = F.regexp_replace(F.substring_index(_c(raw), "\n", 1), "\r$", "")
    answer = line.startswith("HTTP/")
    word = lambda k: F.get(F.split(line, " ", 3), k)
    return F.struct(
        F.when(answer, word(0)).otherwise(word(2)).alias("version"),
        F.when(~answer, word(0)).alias("method"),
        F.when(~answer, word(1)).alias("target"),
        F.when(answer, word(1)).alias("status"),
        F.when(answer, word(2)).alias("reason"),
    )
