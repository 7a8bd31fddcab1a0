"""Scalar text functions, all as JVM-side column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that carry no meaning in a search question.
STOPWORDS = (
    "a an the and or but if of to in on at for from by with about as is are was were be been being do does did have has had "
    "what which who whom whose when where why how that this these those there it its can could should would will shall may "
    "might must please tell me explain describe give list some any all more"
).split()
#: Words that do not count when a question is compared with a title.
TITLE_NOISE = "a s as ra book the of al b bt ibn bin".split()
#: Name spaces whose pages are no content.
NO_CONTENT = [
    "category", "file", "image", "media", "template", "help", "user", "talk", "special", "mediawiki", "module", "portal", "book", "draft",
    "category talk", "file talk", "template talk", "user talk", "help talk",
]

WORD = r"[\p{L}\p{N}]+"


def _fold_table() -> tuple[str, str]:
    """Latin letters with marks and what is left without their marks, by Unicode decomposition."""
    marked, plain = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(cp)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(cp):
            marked.append(chr(cp))
            plain.append(base)
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _fold_table()


def fold(text: Column) -> Column:
    """Lower case without Latin accents; combining accents go, other scripts' marks stay separators."""
    return F.regexp_replace(F.translate(F.lower(text), _MARKED, _PLAIN), "[\\u0300-\\u036F]", "")


def tokens(text: Column) -> Column:
    """Index tokens in order: runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def stripped(word: Column) -> Column:
    return F.regexp_replace(word, r"^['’\-]+|['’\-]+$", "")


def query_terms(question: Column) -> Column:
    """Distinct content words of a question, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit(r"(?U)[\w'’\-]+"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, stripped), lambda w: (F.length(w) >= 2) & ~w.isin(STOPWORDS)))


def title_terms(title: Column) -> Column:
    """The set of comparable terms of a title or question."""
    bare = fold(F.regexp_replace(F.coalesce(title, F.lit("")), r"\([^)]*\)", " "))
    found = F.transform(F.regexp_extract_all(bare, F.lit(r"(?U)[\w']+"), F.lit(0)), stripped)
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(TITLE_NOISE)))


def slug(text: Column) -> Column:
    """Stable ASCII identifier: apostrophes go, other runs become one hyphen."""
    bare = F.regexp_replace(F.lower(text), "['’]", "")
    return F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-|-$", "")


def page_title(raw: Column) -> Column:
    """A link target as a title: blanks for underscores, no anchor, first letter upper."""
    t = F.trim(F.split(F.trim(F.regexp_replace(raw, "_", " ")), "#")[0])
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1_000_000))


def is_content_link(target: Column) -> Column:
    """No known name space and no short (language) prefix."""
    prefix = F.lower(F.trim(F.split(target, ":")[0]))
    return ~target.contains(":") | (~prefix.isin(NO_CONTENT) & (F.length(prefix) > 3))


def wiki_links(text: Column) -> Column:
    """Targets of [[target|shown]] links."""
    return F.regexp_extract_all(text, F.lit(r"\[\[\s*([^\[\]|]+?)\s*(?:\|[^\[\]]*)?\]\]"), F.lit(1))


def field_name(raw: Column) -> Column:
    """A template field's name: links undone, _ and - as blanks, lower case, single blanks."""
    bare = F.regexp_replace(raw, r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(bare), "[_-]", " "), r"\s+", " "))


def token_estimate(text: Column) -> Column:
    """About how many model tokens a text has: at least 1, one for 2.6 characters."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 2.6).cast("int"))


def html_safe(json: Column) -> Column:
    """JSON that can stand inside a script element."""
    return F.replace(json, F.lit("</"), F.lit("<\\/"))


def label_search(rows: DataFrame, label: str, needle: str, limit: int, key: str) -> DataFrame:
    """The shortest labels that hold the needle, whatever the case; ties by key. The needle's % and _ are no wildcards."""
    found = F.contains(F.lower(F.col(label)), F.lit(needle.lower()))
    return rows.where(found).orderBy(F.length(label), key).limit(limit)


def explorer_search(rows: DataFrame, label: str, needle: str, limit: int, key: str, degree: str | None = None) -> DataFrame:
    """rows with `place`, where the needle begins in the folded label without apostrophes: by place, then length, then key.

    An empty needle gives the best connected rows, by the column `degree`.
    """
    bare = lambda c: F.translate(fold(c), "'’", "")
    if not needle:
        return rows.withColumn("place", F.lit(0)).orderBy(F.col(degree).desc() if degree else F.length(label), key).limit(limit)
    at = F.locate(needle.lower().replace("'", "").replace("’", ""), bare(F.col(label)))
    return rows.withColumn("place", at).where("place > 0").orderBy("place", F.length(label), key).limit(limit)


def json_column(text: Column, schema: str) -> Column:
    """A JSON text as a struct or array of the given schema; what does not parse is null."""
    return F.from_json(text, schema)
