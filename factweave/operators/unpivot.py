"""Source rows to facts, and facts to wide rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot(df: DataFrame, entity: str, keys: dict[str, Column], source: str, confidence: float, carry: list[str] = ()) -> DataFrame:
    """One fact per configured key whose value is not null: numbers in value_number, all rendered in value_text.
    A row's facts come from one pass over the row."""
    parts = []
    for key, value in keys.items():
        number = value.try_cast("double")
        parts.append(F.struct(F.lit(key).alias("fact_key"), value.cast("string").alias("value_text"), number.alias("value_number")))
    f = df.select(F.col(entity).alias("entity_id"), *carry, F.explode(F.array(*parts)).alias("f")).filter("f.value_text IS NOT NULL")
    return f.select("entity_id", "f.*", F.lit(source).alias("source_type"), F.lit(confidence).alias("confidence"), *carry)


def listing_facts(listings: DataFrame) -> DataFrame:
    """Sale listings with a finite price, area and bedrooms above zero, confidence 0.7."""
    ok = listings.filter("price > 0 AND area_sqft > 0 AND bhk > 0 AND NOT isnan(price) AND NOT isnan(area_sqft)")
    bhk = F.col("bhk").cast("string")
    keyed = {"listing_price": F.col("price"), "listing_area": F.col("area_sqft"), "price_per_sqft": F.floor(F.col("price") / F.col("area_sqft")), "bedrooms": F.col("bhk")}
    plain = unpivot(ok, "entity_id", keyed, "listing", 0.7, ["listing_id"])
    by_size = ok.select("entity_id", F.concat(F.lit("listing_"), bhk, F.lit("bhk")).alias("fact_key"), F.col("price").cast("string").alias("value_text"), F.col("price").alias("value_number"), F.lit("listing").alias("source_type"), F.lit(0.7).alias("confidence"), "listing_id")
    return plain.unionByName(by_size)


def rent_facts(rents: DataFrame) -> DataFrame:
    """Confidence 0.68, yearly rent and deposit included."""
    keys = {"rent_monthly": F.col("price"), "rent_yearly": F.col("price") * 12, "rent_deposit": F.col("price") * 2, "rent_area": F.col("area_sqft")}
    return unpivot(rents.filter("price > 0"), "entity_id", keys, "rent", 0.68)


def with_alias_copies(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Facts, and a copy of each under every alias of its entity."""
    return facts.unionByName(facts.join(aliases.select(F.col("entity_id"), "alias"), "entity_id").withColumn("entity_id", F.col("alias")).drop("alias"))


def two_sided_facts(rows: DataFrame, subject: str, target: str, key: str, value: Column, confidence: Column) -> DataFrame:
    """The same observation as a fact of the subject and of the linked place."""
    sides = F.array(F.struct(F.col(subject).alias("entity_id"), F.lit(key).alias("fact_key")), F.struct(F.col(target).alias("entity_id"), F.lit(f"{key}_of").alias("fact_key")))
    return rows.select(F.explode(sides).alias("s"), value.alias("value_number"), confidence.alias("confidence")).select("s.*", "value_number", "confidence")


def seed_areas(seeds: DataFrame) -> DataFrame:
    """Areas by normalised name with a digest id, the least name and the seeds in order."""
    n = F.trim(F.regexp_replace(F.lower("area"), "[^a-z0-9]+", " "))
    areas = seeds.withColumn("normalized", n).groupBy("normalized").agg(F.min("area").alias("name"), F.count(F.lit(1)).alias("seeds"))
    return areas.withColumn("entity_id", F.concat(F.lit("area:"), F.substring(F.sha2("normalized", 256), 1, 16)))


def parse_json_claims(df: DataFrame, key: str, column: str, schema: str, fields: list[str]) -> DataFrame:
    """JSON text to one claim a field; text that is no JSON gives none."""
    j = df.select(key, F.from_json(column, schema).alias("j"))
    parts = F.array(*[F.struct(F.lit(f).alias("predicate"), F.col(f"j.{f}").cast("string").alias("value")) for f in fields])
    return j.select(key, F.explode(parts).alias("c")).filter("c.value IS NOT NULL").select(key, "c.*")


def project_entity(facts: DataFrame, spec: dict[str, tuple[str, object]]) -> DataFrame:
    """One row per entity with a column for each key, of its type's view and default. ``facts`` hold one row per (entity, key)."""
    cols = []
    for key, (view, default) in spec.items():
        v = F.max(F.when(F.col("fact_key") == key, F.col("value_number" if view == "number" else "value_text")))
        cols.append(F.coalesce(v, F.lit(default)).alias(key))
    return facts.groupBy("entity_id").agg(*cols)


def representative_rows(facts: DataFrame) -> DataFrame:
    """P5: a row per (entity, bedroom count named in listing_{n}bhk or pricing_{n}bhk keys, 1 to 6), else one with 0."""
    n = F.regexp_extract("fact_key", "^(?:listing|pricing)_([1-6])bhk$", 1)
    named = facts.withColumn("bhk", F.when(n != "", n.cast("int"))).groupBy("entity_id").agg(F.sort_array(F.collect_set("bhk")).alias("all"))
    return named.select("entity_id", F.explode(F.when(F.size("all") > 0, F.col("all")).otherwise(F.array(F.lit(0)))).alias("bhk"))


def classify_documents(df: DataFrame, roles: dict[str, str], columns: list[str]) -> DataFrame:
    """The first role whose pattern matches the label, then the field, then the link, with the basis."""
    by = []
    for c in columns:
        role = F.lit(None).cast("string")
        for name, pattern in reversed(list(roles.items())):
            role = F.when(F.col(c).rlike(pattern), name).otherwise(role)
        by.append(role)
    basis = F.lit(None).cast("string")
    for c, role in reversed(list(zip(columns, by))):
        basis = F.when(role.isNotNull(), c).otherwise(basis)
    return df.withColumn("role", F.coalesce(*by, F.lit("other"))).withColumn("basis", basis)


def score_images(df: DataFrame) -> DataFrame:
    """Kind of an image from its URL and text, a quality from its size and source, a relevance from kind and text."""
    words = F.lower(F.concat_ws(" ", "url", "alt"))
    kind = F.when(words.rlike("floor|plan|layout"), "plan").when(words.rlike("map|location"), "map").when(words.rlike("logo|icon|sprite"), "logo").when(words.rlike("exterior|tower|elevation"), "exterior").otherwise("photo")
    size = F.least(F.lit(1.0), F.col("width") * F.col("height") / 1_000_000)
    trusted = F.when(F.col("source") == "official", 0.2).otherwise(0.0)
    quality = F.least(F.lit(1.0), size * 0.8 + trusted)
    relevance = F.when(kind == "logo", 0.0).otherwise(F.when(kind == "exterior", 0.6).otherwise(0.4) + F.when(F.length("alt") > 0, 0.2).otherwise(0.0))
    return df.withColumns({"kind": kind, "quality": F.round(quality, 6), "relevance": F.round(relevance, 6)})


def media_facts(images: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per entity one fact with its approved images in gallery order, copied to its aliases."""
    each = images.groupBy("entity_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("gallery_order", "image_url"))), lambda s: s["image_url"]), " ").alias("value_text"))
    return with_alias_copies(each.withColumn("fact_key", F.lit("media_gallery")), aliases)


def source_records(df: DataFrame, required: list[str], identity: list[str]) -> DataFrame:
    """Records whose required fields are not blank, with a digest id over the identity fields."""
    from ..functions.text import content_id

    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    return df.filter(ok).withColumn("record_id", content_id("record:", *[F.col(c) for c in identity]))


def pricing_facts(payloads: DataFrame, schema: str = "configurations array<struct<bhk: int, price: string, area: double>>", crore: float = 100.0) -> DataFrame:
    """Marketplace payloads to one price fact, in lakhs, a configuration whose range is readable and whose rate is plausible."""
    from ..functions.text import parse_range
    from .filters import plausible_price

    c = payloads.select("entity_id", "rate_low", "rate_high", F.explode(F.from_json("payload", schema)["configurations"]).alias("c"))
    r = c.select("entity_id", "rate_low", "rate_high", F.col("c.bhk").alias("bhk"), F.col("c.area").alias("area"), parse_range(F.col("c.price"), crore).alias("r")).filter("r IS NOT NULL")
    ok = plausible_price(F.col("r.lo"), F.col("r.hi"), F.col("area"), F.col("rate_low"), F.col("rate_high"))
    return r.filter(ok).select("entity_id", F.concat(F.lit("pricing_"), F.col("bhk").cast("string"), F.lit("bhk")).alias("fact_key"), F.col("r.lo").alias("low"), F.col("r.hi").alias("high"))
