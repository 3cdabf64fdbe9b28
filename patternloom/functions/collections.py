"""Arrays, maps and sparse vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def int_range(first, last) -> Column:
    """first <= x < last; empty if there is none."""
    a, b = _c(first), _c(last)
    return F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))


def index_of(a, x) -> Column:
    """0-based, -1 if absent."""
    return F.array_position(_c(a), x) - 1


def last_index_of(a, x) -> Column:
    n = F.size(_c(a))
    back = F.array_position(F.reverse(_c(a)), x)
    return F.when(back > 0, n - back).otherwise(-1)


def sub_list(a, start: int, end: int) -> Column:
    """0-based, both ends included."""
    return F.slice(_c(a), start + 1, end - start + 1)


def add_unique(a, x) -> Column:
    return F.array_union(_c(a), F.array(x))


def last_n(a, n: int) -> Column:
    return F.slice(_c(a), F.greatest(F.size(_c(a)) - n + 1, F.lit(1)), n)


def sorted_intersection(a, b) -> Column:
    return F.array_sort(F.array_intersect(_c(a), _c(b)))


def map_plus(a, b) -> Column:
    return F.map_zip_with(_c(a), _c(b), lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def map_increment(m, key, by) -> Column:
    return map_plus(m, F.create_map(key, by))


def map_dot(a, b) -> Column:
    products = F.map_values(F.map_zip_with(_c(a), _c(b), lambda k, x, y: F.coalesce(x * y, F.lit(0.0))))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def map_length(m) -> Column:
    return F.sqrt(F.aggregate(F.map_values(_c(m)), F.lit(0.0), lambda s, x: s + x * x))


def map_normalize(m) -> Column:
    """Unit length; a zero vector stays."""
    n = map_length(m)
    return F.transform_values(_c(m), lambda k, v: F.when(n > 0, v / n).otherwise(v))


def entries_by_value(m, n: int | None = None) -> Column:
    """Entries by falling value, ties by key; null for an empty map."""

    def order(x, y):
        return F.when(x["value"] > y["value"], -1).when(x["value"] < y["value"], 1).when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)

    out = F.array_sort(F.map_entries(_c(m)), order)
    out = F.slice(out, 1, n) if n is not None else out
    return F.when(F.size(_c(m)) > 0, out)


def entries_by_key(m, n: int | None = None) -> Column:
    out = F.array_sort(F.map_entries(_c(m)))
    return F.when(F.size(_c(m)) > 0, F.slice(out, 1, n) if n is not None else out)


def vector_dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_length(a) -> Column:
    return F.sqrt(vector_dot(a, a))


def mod(x, n) -> Column:
    """Never negative."""
    return F.pmod(_c(x), n)


def int_bytes(x) -> Column:
    """Four bytes, the highest first."""
    return F.unhex(F.right(F.lpad(F.hex(_c(x).cast("int")), 8, "0"), F.lit(8)))


# ---------------------------------------------------------------- updates


def array_add(a, x) -> Column:
    return F.array_append(_c(a), x)


def array_insert(a, at: int, x) -> Column:
    """x before the 0-based place; at the end where that is the length."""
    return F.concat(F.slice(_c(a), 1, at), F.array(x), F.slice(_c(a), at + 1, F.greatest(F.size(_c(a)) - at, F.lit(0))))


def array_set(a, at: int, x) -> Column:
    return F.transform(_c(a), lambda y, i: F.when(i == at, x).otherwise(y))


def array_remove_at(a, at: int) -> Column:
    return F.filter(_c(a), lambda y, i: i != at)


def array_get(a, at: int) -> Column:
    """0-based; null outside."""
    return F.get(_c(a), at)


def array_sorted(a, falling: bool = False) -> Column:
    return F.sort_array(_c(a), asc=not falling)


def map_contains_key(m, key) -> Column:
    return F.map_contains_key(_c(m), key)


def map_contains_value(m, value) -> Column:
    return F.array_contains(F.map_values(_c(m)), value)


def map_put(m, key, value) -> Column:
    return map_put_all(m, F.create_map(key, value))


def map_put_all(a, b) -> Column:
    """Entries of both; of a key in both the second's."""
    return F.map_concat(F.map_filter(_c(a), lambda k, v: ~F.map_contains_key(_c(b), k)), _c(b))


def map_remove(m, key) -> Column:
    return F.map_filter(_c(m), lambda k, v: k != key)


def tuple_order(*fields: tuple[Column | str, Column | str]) -> Column:
    """A sort key of (value, symbol) fields: a field with a symbol (null: none) comes before any value, symbols in order."""
    return F.struct(*[F.struct(F.col(s).isNull() if isinstance(s, str) else s.isNull(), _c(s), _c(v)).alias(f"f{k}") for k, (v, s) in enumerate(fields)])
