"""Explosive products: name resolution and the product dimension."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BLAST
from .numeric import null_double, col

# Product, density g/cm3, energy MJ/kg, strength relative to ANFO, validation status, source.
REFERENCE_SOURCE = "Catálogo ENAEX (referencia, sin ficha oficial)"
PRODUCTS = (
    ("Pirex-920", 1.15, 2.95, None, "UNVALIDATED_REFERENCE", REFERENCE_SOURCE),
    ("Pirex-930", 1.20, 3.05, None, "UNVALIDATED_REFERENCE", REFERENCE_SOURCE),
    ("Pirex-950", 1.23, 3.15, None, "UNVALIDATED_REFERENCE", REFERENCE_SOURCE),
    ("Pirex-970", 1.25, 3.25, None, "UNVALIDATED_REFERENCE", REFERENCE_SOURCE),
    ("ANFO", 0.80, 3.72, 1.0, "VALIDATED", "Referencia industrial estándar (ANFO = base 1.0 RWS)"),
    ("Heavy ANFO", 1.05, 3.40, None, "UNVALIDATED_REFERENCE", REFERENCE_SOURCE),
    ("Bulk Emulsion", 1.15, 3.05, None, "UNVALIDATED_REFERENCE", REFERENCE_SOURCE),
    ("Enaline", 1.10, 2.85, None, "UNVALIDATED_REFERENCE", REFERENCE_SOURCE),
)
PRODUCT_SCHEMA = (
    "product string, density_g_cm3 double, energy_mj_kg double, rws double, validation_status string, source string"
)


def product_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRODUCTS), PRODUCT_SCHEMA)


def _key(name: Column) -> Column:
    return F.lower(F.trim(name))


def product_name(name: Column | str) -> Column:
    """Registry product a free-text name stands for, NULL when unknown.

    Exact names win, then Pirex grades and Enaline by prefix, then the families by the words they contain.
    """
    key = _key(col(name))
    exact = F.create_map(*[F.lit(x) for row in PRODUCTS for x in (row[0].lower(), row[0])])
    return F.coalesce(
        F.try_element_at(exact, key),
        F.when(key.rlike("^pirex-(920|930|950|970)"), F.concat(F.lit("Pirex-"), F.substring(key, 7, 3)))
        .when(key.startswith("enaline"), "Enaline")
        .when(key.rlike("heavy anfo|h-anfo"), "Heavy ANFO")
        .when(key.contains("emul"), "Bulk Emulsion")
        .when(key.contains("anfo"), "ANFO"))


def is_family_match(name: Column | str) -> Column:
    """True when a Pirex or Enaline name was matched by prefix only."""
    key = _key(col(name))
    exact = key.isin(*[p[0].lower() for p in PRODUCTS])
    return ~exact & key.rlike("^(pirex-(920|930|950|970)|enaline)")


def _lookup(name: Column | str, position: int, cast: str) -> Column:
    """Property of the resolved product, from a small literal map so that the name is resolved once."""
    table = F.create_map(*[x for row in PRODUCTS for x in (F.lit(row[0]), F.lit(row[position]).cast(cast))])
    return F.try_element_at(table, product_name(name))


def density(name: Column | str) -> Column:
    return _lookup(name, 1, "double")


def energy(name: Column | str) -> Column:
    return _lookup(name, 2, "double")


def official_rws(name: Column | str) -> Column:
    return _lookup(name, 3, "double")


def status(name: Column | str) -> Column:
    c = col(name)
    product = product_name(c)
    return (
        F.when(c.isNull() | (c == ""), "MISSING")
        .when(product.isNull(), "UNKNOWN")
        .when(is_family_match(c), "FAMILY_MATCH")
        .otherwise(_lookup(c, 4, "string"))
    )


def provenance(name: Column | str) -> dict[str, Column]:
    """Status, source, strength and the flags that mark it as an estimate or an assumption."""
    c = col(name)
    st = status(c)
    rws = official_rws(c)
    estimated = rws.isNull() & st.isin("VALIDATED", "UNVALIDATED_REFERENCE", "FAMILY_MATCH")
    return {
        "explosive_status": st,
        "explosive_source": F.coalesce(_lookup(c, 5, "string"), F.lit("")),
        "explosive_rws": F.coalesce(rws, energy(c) / BLAST.anfo_energy, null_double()),
        "explosive_rws_is_estimated": estimated,
        "explosive_assumption_flag": st.isin("UNKNOWN", "MISSING", "FAMILY_MATCH") | estimated,
    }


# Name prefix to exchange-format category, in match order.
CATEGORY_PREFIXES = (
    ("pirex-930", "Heavy ANFO"),
    ("pirex-920", "Heavy ANFO"),
    ("pirex-950", "Heavy ANFO"),
    ("pirex-970", "Heavy ANFO"),
    ("enaline", "Emulsion"),
    ("anfo", "ANFO"),
)


def category(name: Column | str) -> Column:
    """Exchange-format category of a product name."""
    key = _key(col(name))
    out = F.lit("Other")
    for prefix, value in reversed(CATEGORY_PREFIXES):
        out = F.when(key.startswith(prefix), value).otherwise(out)
    return out
