"""Column expressions over the nested ``products`` array.

All are built-in higher-order functions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventscope.schema import PRODUCT_FIELDS, PRODUCTS_TYPE, UNKNOWN_CATEGORY


def _struct_from_positional(x: Column) -> Column:
    # get() returns NULL past the end, so short lists fill with NULL
    return F.struct(*[F.get(x, i).cast("string").alias(f) for i, f in enumerate(PRODUCT_FIELDS)])


def _struct_from_struct(x: Column, st: T.StructType) -> Column:
    names = set(st.fieldNames())
    return F.struct(*[(x[f].cast("string") if f in names else F.lit(None).cast("string")).alias(f)
                      for f in PRODUCT_FIELDS])


def _struct_from_map(x: Column) -> Column:
    return F.struct(*[F.try_element_at(x, F.lit(f)).cast("string").alias(f) for f in PRODUCT_FIELDS])


def normalize_products(col: Column, dtype: T.DataType | None) -> Column:
    """NULL → ``[]``; NULL elements dropped; every element a 5-field struct.

    Accepts arrays of structs (any field subset), of positional lists, or of maps.
    Any other type (including a scalar that is not a list) becomes ``[]``.
    """
    empty = F.array().cast(PRODUCTS_TYPE)
    if not isinstance(dtype, T.ArrayType):
        return empty
    et = dtype.elementType
    if isinstance(et, T.StructType):
        conv = lambda x: _struct_from_struct(x, et)
    elif isinstance(et, T.ArrayType):
        conv = _struct_from_positional
    elif isinstance(et, T.MapType):
        conv = _struct_from_map
    else:
        return empty
    kept = F.filter(F.coalesce(col, F.array().cast(dtype)), lambda x: x.isNotNull())
    return F.transform(kept, conv).cast(PRODUCTS_TYPE)


def categories_dropping(products: Column) -> Column:
    """Categories of the products, NULL and empty ones removed."""
    return F.filter(F.transform(products, lambda p: p["product_category"]),
                    lambda c: c.isNotNull() & (c != F.lit("")))


def categories_dropping_fields(products: Column) -> Column:
    """N7 on a raw array of structs, as a field extraction (nested-prunable).

    NULL elements and NULL/empty categories are dropped; NULL array → ``[]``.
    """
    cats = products["product_category"]
    return F.coalesce(F.filter(cats, lambda c: c.isNotNull() & (c != F.lit(""))),
                      F.array().cast("array<string>"))


def categories_unknown_fields(products: Column) -> Column:
    """N7b on a stored array without NULL elements, as a field extraction."""
    return F.coalesce(F.transform(products["product_category"],
                                  lambda c: F.coalesce(c, F.lit(UNKNOWN_CATEGORY))),
                      F.array().cast("array<string>"))


def categories_unknown(products: Column) -> Column:
    """Categories of the products, a missing category becomes ``'Unknown'``."""
    return F.transform(products, lambda p: F.coalesce(p["product_category"], F.lit(UNKNOWN_CATEGORY)))


def product_count(products: Column) -> Column:
    """Number of (non-NULL) products of a normalised array."""
    return F.size(F.coalesce(products, F.array().cast(PRODUCTS_TYPE))).cast("long")


def first_category(categories: Column) -> Column:
    """First category, else ``'Unknown'`` (also when there are no products)."""
    return F.coalesce(F.get(categories, 0), F.lit(UNKNOWN_CATEGORY))


def categories_text(categories: Column, sep: str = ", ") -> Column:
    """Category list as ``"a, b"`` text; no categories → ``''``."""
    return F.coalesce(F.array_join(categories, sep), F.lit(""))
