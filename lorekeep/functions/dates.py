"""Dates in two calendars, as structs of nullable numbers and as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names in calendar order.
HIJRI = [
    "Muharram", "Safar", "Rabi' I", "Rabi' II", "Jumada I", "Jumada II",
    "Rajab", "Sha'ban", "Ramadan", "Shawwal", "Dhu l-Qa'da", "Dhu l-Hijja",
]
GREGORIAN = "January February March April May June July August September October November December".split()
PARTS = ["ah_year", "ah_month", "ah_day", "ce_year", "ce_month", "ce_day", "bh_year"]

_YEAR = r"(?i)\b(\d{1,4})\s*(AH|CE|BH|AD|BC)\b"
_NAMES = "|".join(m.replace("'", "['’]") for m in sorted(HIJRI + GREGORIAN, key=len, reverse=True))
_DAY = rf"(?i)\b({_NAMES})\s+(\d{{1,2}})\b"


def _plain(name: Column) -> Column:
    return F.lower(F.translate(name, "'’", ""))


def parsed(text: Column) -> Column:
    """The first year and the first month and day that a text states. Years BC count as CE, as they are written."""
    num = lambda c: F.when(c != "", c.cast("int"))
    year, era = num(F.regexp_extract(text, _YEAR, 1)), F.upper(F.regexp_extract(text, _YEAR, 2))
    name, day = _plain(F.regexp_extract(text, _DAY, 1)), num(F.regexp_extract(text, _DAY, 2))
    month = lambda names: F.nullif(F.array_position(F.array(*[F.lit(n.lower().replace("'", "")) for n in names]), name), F.lit(0)).cast("int")
    h, g = month(HIJRI), month(GREGORIAN)
    return F.struct(
        F.when(era == "AH", year).alias("ah_year"), h.alias("ah_month"), F.when(h.isNotNull(), day).alias("ah_day"),
        F.when(era.isin("CE", "AD", "BC"), year).alias("ce_year"), g.alias("ce_month"), F.when(g.isNotNull(), day).alias("ce_day"),
        F.when(era == "BH", year).alias("bh_year"),
    )


def merged(values: list[Column]) -> Column:
    """The first value of each part, in the order given."""
    return F.struct(*[F.coalesce(*[v[p] for v in values]).alias(p) for p in PARTS])


def of_field(raw: Column, titles: Column) -> Column:
    """A field's date: its linked titles first, the raw text fills what they leave open."""
    none = F.struct(*[F.lit(None).cast("int").alias(p) for p in PARTS])
    by_links = F.aggregate(F.transform(titles, parsed), none, lambda a, x: merged([a, x]))
    return merged([by_links, parsed(raw)])


def _md(v: Column, cal: str) -> Column:
    month, day = v[f"{cal}_month"], v[f"{cal}_day"]
    two = lambda c: F.coalesce(F.concat(F.lit("-"), F.lpad(c.cast("string"), 2, "0")), F.lit(""))
    return F.concat(two(month), F.when(month.isNotNull(), two(day)).otherwise(F.lit("")))


def node_id(v: Column) -> Column:
    """The most specific id: AH, then BH, then CE years, then a day without a year."""
    four = lambda c: F.lpad(c.cast("string"), 4, "0")
    return (
        F.when(v["ah_year"].isNotNull(), F.concat(F.lit("date:ah:"), four(v["ah_year"]), _md(v, "ah")))
        .when(v["bh_year"].isNotNull(), F.concat(F.lit("date:bh:"), four(v["bh_year"])))
        .when(v["ce_year"].isNotNull(), F.concat(F.lit("date:ce:"), four(v["ce_year"]), _md(v, "ce")))
        .when(v["ah_month"].isNotNull(), F.concat(F.lit("date:ah-md:"), F.substring(_md(v, "ah"), 2, 9)))
        .when(v["ce_month"].isNotNull(), F.concat(F.lit("date:ce-md:"), F.substring(_md(v, "ce"), 2, 9)))
    )


def label_of(v: Column) -> Column:
    """`Month d, Y AH / Month d, Y CE`, as far as parts are known."""

    def one(cal: str, names: list[str], era: str) -> Column:
        number = v[f"{cal}_month"]
        month = F.coalesce(*[F.when(number == i, F.lit(n)) for i, n in enumerate(names, 1)])
        day = F.concat_ws(" ", month, v[f"{cal}_day"].cast("string"))
        year = F.concat(v[f"{cal}_year"].cast("string"), F.lit(f" {era}"))
        return F.nullif(F.concat_ws(", ", F.nullif(day, F.lit("")), year), F.lit(""))

    return F.nullif(F.concat_ws(" / ", one("ah", HIJRI, "AH"), F.concat(v["bh_year"].cast("string"), F.lit(" BH")), one("ce", GREGORIAN, "CE")), F.lit(""))
