"""Countries: names and codes to one another, by a small dimension table that callers may replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import is_null

#: Name, alpha-2, alpha-3, numeric. A fuller table can be given as a parameter.
COUNTRIES = [tuple(x.split("|")) for x in (
    "Argentina|AR|ARG|32;Australia|AU|AUS|36;Austria|AT|AUT|40;Belgium|BE|BEL|56;Brazil|BR|BRA|76;Bulgaria|BG|BGR|100;Canada|CA|CAN|124;Chile|CL|CHL|152;China|CN|CHN|156;Colombia|CO|COL|170;Croatia|HR|HRV|191;"
    "Czechia|CZ|CZE|203;Denmark|DK|DNK|208;Egypt|EG|EGY|818;Estonia|EE|EST|233;Finland|FI|FIN|246;France|FR|FRA|250;Germany|DE|DEU|276;Greece|GR|GRC|300;Hungary|HU|HUN|348;Iceland|IS|ISL|352;India|IN|IND|356;"
    "Indonesia|ID|IDN|360;Ireland|IE|IRL|372;Israel|IL|ISR|376;Italy|IT|ITA|380;Japan|JP|JPN|392;Kenya|KE|KEN|404;Latvia|LV|LVA|428;Lithuania|LT|LTU|440;Luxembourg|LU|LUX|442;Malaysia|MY|MYS|458;Mexico|MX|MEX|484;"
    "Morocco|MA|MAR|504;Namibia|NA|NAM|516;Netherlands|NL|NLD|528;New Zealand|NZ|NZL|554;Niger|NE|NER|562;Nigeria|NG|NGA|566;Norway|NO|NOR|578;Pakistan|PK|PAK|586;Peru|PE|PER|604;Philippines|PH|PHL|608;Poland|PL|POL|616;"
    "Portugal|PT|PRT|620;Romania|RO|ROU|642;Russia|RU|RUS|643;Saudi Arabia|SA|SAU|682;Singapore|SG|SGP|702;Slovakia|SK|SVK|703;Slovenia|SI|SVN|705;South Africa|ZA|ZAF|710;South Korea|KR|KOR|410;Spain|ES|ESP|724;"
    "Sweden|SE|SWE|752;Switzerland|CH|CHE|756;Thailand|TH|THA|764;Turkey|TR|TUR|792;Ukraine|UA|UKR|804;United Kingdom|GB|GBR|826;United States|US|USA|840;Vietnam|VN|VNM|704"
).split(";")]
FORMATS = {"name": 0, "alpha-2": 1, "alpha-3": 2, "numeric": 3}


def iso_countries(spark: SparkSession) -> list[tuple]:
    """A fuller table: every country of ISO 3166 by the names and letter codes that the JVM's locales give, with numbers where COUNTRIES has them."""
    known = {row[1]: row for row in COUNTRIES}
    locale = spark._jvm.java.util.Locale
    found = [(code, locale("", code)) for code in locale.getISOCountries()]
    return [known.get(code) or (place.getDisplayCountry(locale.ENGLISH), code, place.getISO3Country(), None) for code, place in found]


def _lookup(c: Column, by: int, out: int, table: list[tuple]) -> Column:
    pairs = [F.lit(x) for row in table if row[by] is not None for x in (row[by].lower(), row[out])]
    return F.element_at(F.create_map(*pairs), c)


def convert(c: Column, output_format: str = "name", input_format: str = "auto", table: list[tuple] = COUNTRIES, fuzzy_dist: int = 0) -> Column:
    """The country in output_format, or null. auto reads numbers, 2 and 3 letters as codes and the rest as a name; fuzzy_dist allows so many edits of a name."""
    out, t = FORMATS[output_format], F.lower(F.trim(c.cast("string")))
    number = F.regexp_replace(t, "^0+(?=.)", "")
    ways = {"numeric": _lookup(number, 3, out, table), "alpha-2": _lookup(t, 1, out, table), "alpha-3": _lookup(t, 2, out, table), "name": _lookup(t, 0, out, table)}
    if fuzzy_dist:
        near = F.array_sort(F.array(*[F.struct(F.levenshtein(t, F.lit(r[0].lower())).alias("d"), F.lit(r[out]).alias("v")) for r in table]))[0]
        ways["name"] = F.coalesce(ways["name"], F.when(near["d"] <= fuzzy_dist, near["v"]))
    if input_format != "auto":
        return ways[input_format]
    return F.when(t.rlike(r"^\d+$"), ways["numeric"]).when(F.char_length(t) == 2, ways["alpha-2"]).when(F.char_length(t) == 3, F.coalesce(ways["alpha-3"], ways["name"])).otherwise(ways["name"])


def is_country(c: Column) -> Column:
    return F.coalesce(convert(c).isNotNull(), F.lit(False))


def clean_country(df: DataFrame, column: str, output_format: str = "name", input_format: str = "auto", fuzzy_dist: int = 0, errors: str = "coerce", table: list[tuple] = COUNTRIES) -> DataFrame:
    c = F.col(f"`{column}`")
    found = convert(c, output_format, input_format, table, fuzzy_dist)
    bad = {"coerce": F.lit(None), "ignore": c.cast("string"), "raise": F.when(~is_null(c), F.raise_error(F.concat(F.lit("not a country: "), c.cast("string"))))}[errors]
    return df.withColumn(f"{column}_clean", F.coalesce(found, bad))
