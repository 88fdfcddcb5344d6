"""Data-contract checks (V1–V5): what a valid event is, per the producers' rules.

Each check is a set of named boolean rules.  ``rule_counts`` evaluates all rules of a
check in one aggregation (one row, then unpivoted), ``violations`` emits one row per
(record, violated rule) in one pass.  Taxonomy rules join a small taxonomy frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventscope import schema as S

NO_PRODUCTS = S.NO_PRODUCT_EVENT_TYPES


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) for every rule, zeros included; a single global aggregate."""
    wide = df.agg(*[F.count_if(c).cast("long").alias(n) for n, c in rules.items()])
    return wide.unpivot([], list(rules), "rule", "violations")


def violations(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """One row per violated rule of each record: (*keys, rule)."""
    flagged = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]),
                       lambda x: x.isNotNull())
    return df.select(*keys, F.explode(flagged).alias("rule"))


def counted_violations(df: DataFrame, counts: dict[str, Column], keys: list[str]) -> DataFrame:
    """(*keys, rule, count) of each record's violated rules, in one pass and no shuffle."""
    found = F.filter(F.array(*[F.struct(F.lit(n).alias("rule"), c.cast("long").alias("count"))
                               for n, c in counts.items()]), lambda x: x["count"] > 0)
    return df.select(*keys, F.explode(found).alias("v")).select(*keys, "v.rule", "v.count")


def counted(rules: dict[str, Column]) -> dict[str, Column]:
    """Event rules as counts (0 or 1) of an event."""
    return {n: c.cast("int") for n, c in rules.items()}


def product_counts() -> dict[str, Column]:
    """V3 as counts of an event: its products that break each rule.  Only the tested
    fields are zipped, so a scan reads no others."""
    zipped = F.arrays_zip(*[F.col("products")[f].alias(f) for f in FIELD_RULE_FIELDS])

    def broken(name: str) -> Column:
        return F.size(F.filter(F.coalesce(zipped, F.array().cast("array<struct<product_id:string,price:string>>")),
                               lambda p: product_field_rules(lambda f: p[f])[name]))

    return {n: broken(n) for n in product_field_rules()}


def count_totals(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """(rule, violations) of counts, zeros included; one global aggregate."""
    wide = df.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in counts.items()])
    return wide.unpivot([], list(counts), "rule", "violations")


def _not_like(col: str | Column, pattern: str) -> Column:
    return F.coalesce(~(F.col(col) if isinstance(col, str) else col).rlike(pattern), F.lit(True))


def event_rules() -> dict[str, Column]:
    """V1: types, device and user type in their domains; user key format."""
    return {
        "event_type_domain": F.coalesce(~F.col("event_type").isin(S.EVENT_TYPES), F.lit(True)),
        "event_id_format": _not_like("event_id", S.EVENT_ID_PATTERN),
        "device_domain": F.col("device").isNotNull() & ~F.col("device").isin(S.DEVICES),
        "user_type_domain": F.col("user_type").isNotNull() & ~F.col("user_type").isin(S.USER_TYPES),
    }


def product_count_rules() -> dict[str, Column]:
    """V2 (per event of a prepared frame): login/logout carry none, others 1–3."""
    t, n = F.col("event_type"), F.col("product_count")
    return {
        "products_on_login_logout": t.isin(NO_PRODUCTS) & (n > 0),
        "product_count_range": t.isNotNull() & ~t.isin(NO_PRODUCTS) & ((n < 1) | (n > 3)),
    }


FIELD_RULE_FIELDS = ["product_id", "price"]


def product_field_rules(field=F.col) -> dict[str, Column]:
    """V3 (per product): id and price formats; ``field`` gives a product's field by name."""
    return {
        "product_id_format": _not_like(field("product_id"), S.PRODUCT_ID_PATTERN),
        "price_format": _not_like(field("price"), S.PRICE_PATTERN),
    }


def exploded_products(prepared: DataFrame, keys: list[str] = (), fields: list[str] | None = None) -> DataFrame:
    """One row per product with its fields (inner explode of normalised products).

    With ``fields`` only those product fields are zipped and exploded: each is a field
    extraction of the array, so Parquet reads just those nested columns.
    """
    keys = [k for k in keys if k in prepared.columns]
    if fields:
        zipped = F.arrays_zip(*[F.col("products")[f].alias(f) for f in fields])
        x = prepared.select(*keys, "event_type", F.explode(zipped).alias("p"))
    else:
        x = prepared.select(*keys, "event_type", F.explode("products").alias("p"))
    return x.select(*keys, "event_type", "p.*")


TAXONOMY_FIELDS = ["product_category", "product_type", "brand"]


def taxonomy_frame(spark: SparkSession, extended: bool = False) -> DataFrame:
    """Legal (category, kind, value) rows; kind ∈ {category, product_type, brand}."""
    cats = S.EXTENDED_CATEGORIES if extended else S.CATEGORIES
    types = S.EXTENDED_PRODUCT_TYPES if extended else S.PRODUCT_TYPES
    brands = S.EXTENDED_BRANDS if extended else S.BRANDS
    rows = [(c, "category", None) for c in cats]
    rows += [(c, "product_type", v) for c, vs in types.items() for v in vs]
    rows += [(c, "brand", v) for c, vs in brands.items() for v in vs]
    return spark.createDataFrame(rows, "category string, kind string, value string")


def with_taxonomy_flags(products: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Mark each product with the V4 rules via one left join to the taxonomy.

    The taxonomy is grouped to one row per category with its legal types and brands, so
    the join cannot multiply products; its strategy is Spark's choice by size.  A product
    without a category joins nothing.
    """
    def values(kind: str) -> Column:
        return F.collect_set(F.when(F.col("kind") == kind, F.col("value")))

    legal = taxonomy.groupBy(F.col("category").alias("_c")).agg(
        F.bool_or(F.col("kind") == "category").alias("_category"),
        values("product_type").alias("_types"), values("brand").alias("_brands"))
    p = products.join(legal, products["product_category"] == legal["_c"], "left")
    return p.select(
        *[p[c] for c in products.columns],
        F.when(F.col("_category"), F.lit(True)).alias("_ok_category"),
        F.when(F.array_contains("_types", F.col("product_type")), F.lit(True)).alias("_ok_product_type"),
        F.when(F.array_contains("_brands", F.col("brand")), F.lit(True)).alias("_ok_brand"))


def _pair(a: Column, b: Column) -> Column:
    return F.concat_ws("\u0001", a, b)


def builtin_taxonomy_rules(extended: bool = False) -> dict[str, Column]:
    """V4 against the built-in vocabularies, as in-set lookups (no join, no shuffle).

    The vocabularies are fixed and small (≤ ~130 values), so they travel inside the
    expression (a hash set) instead of as a broadcast join side.
    """
    cats = S.EXTENDED_CATEGORIES if extended else S.CATEGORIES
    types = S.EXTENDED_PRODUCT_TYPES if extended else S.PRODUCT_TYPES
    brands = S.EXTENDED_BRANDS if extended else S.BRANDS
    c = F.col("product_category")

    def pairs(d):
        return [f"{k}\u0001{v}" for k, vs in d.items() for v in vs]

    return {
        "category_domain": F.coalesce(~c.isin(cats), F.lit(True)),
        "product_type_for_category": F.col("product_type").isNotNull()
        & F.coalesce(~_pair(c, F.col("product_type")).isin(pairs(types)) | c.isNull(), F.lit(True)),
        "brand_for_category": F.col("brand").isNotNull()
        & F.coalesce(~_pair(c, F.col("brand")).isin(pairs(brands)) | c.isNull(), F.lit(True)),
    }


def taxonomy_rules() -> dict[str, Column]:
    """V4 over a frame flagged by ``with_taxonomy_flags`` (user-supplied taxonomy)."""
    return {
        "category_domain": F.col("_ok_category").isNull(),
        "product_type_for_category": F.col("product_type").isNotNull() & F.col("_ok_product_type").isNull(),
        "brand_for_category": F.col("brand").isNotNull() & F.col("_ok_brand").isNull(),
    }


MISSING_FIELDS = ["event_id", "event_type", "timestamp", "ip", "device", "user_type", "products"]


def missing_fields(raw: DataFrame, fields: list[str] = MISSING_FIELDS) -> DataFrame:
    """V5: NULL (or absent) count per required field of the raw stored events."""
    types = {f.name: f.dataType for f in raw.schema.fields}

    def missing(f):
        if f not in types:
            return F.lit(True)
        t = types[f]
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
            # a field extraction is NULL exactly when the array is: reads one nested field
            return F.col(f)[t.elementType.fieldNames()[0]].isNull()
        return F.col(f).isNull()

    rules = {f: missing(f) for f in fields}
    return rule_counts(raw, rules).withColumnRenamed("rule", "field").withColumnRenamed(
        "violations", "missing")
