"""Paths and comparisons as sentences, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def narrated(predicates: DataFrame, subject: Column, preds: Column, dirs: Column, labels: Column, persons: Column) -> Column:
    """One sentence for a path, null if its first step cannot be told.

    A step that reads forwards (its own phrase, or its inverse's) is joined by a pronoun to one
    before it that did too: `who` if persons holds of the node it leaves from, else `which`. A step
    that can only be read from its far end starts a clause of its own, and the pronoun is lost. A
    step without phrase or label ends the sentence. The ontology's phrases (tens of rows) are literals.
    """
    rows = {r.p: r for r in predicates.collect()}
    literal = lambda pairs: F.create_map(*[F.lit(x) for kv in pairs for x in kv]) if pairs else F.lit(None).cast("map<string,string>")
    own = literal([(p, r.label) for p, r in rows.items() if r.label])
    back = literal([(p, rows[r.inverse].label) for p, r in rows.items() if r.inverse in rows])
    steps = F.arrays_zip(preds.alias("p"), dirs.alias("d"), labels.alias("label"), F.slice(persons, 1, 64).alias("person"))

    def step(a: Column, x: Column) -> Column:
        phrase = F.element_at(own, x["p"])
        verb = F.when(x["d"] == "out", phrase).otherwise(F.element_at(back, x["p"]))
        ends = a["done"] | phrase.isNull() | (F.coalesce(x["label"], F.lit("")) == "")
        first = F.size(a["said"]) == 0
        lead = F.when(first, a["subject"]).when(a["linked"], F.when(x["person"], F.lit("who")).otherwise(F.lit("which"))).otherwise(F.concat(F.lit("and "), a["subject"]))
        ahead = F.concat_ws(" ", lead, verb, x["label"])
        behind = F.concat(F.when(first, F.lit("")).otherwise(F.lit("and ")), F.concat_ws(" ", x["label"], phrase, a["subject"]))
        said = F.when(verb.isNotNull(), ahead).otherwise(behind)
        return F.struct(
            ends.alias("done"),
            F.when(ends, a["linked"]).otherwise(verb.isNotNull()).alias("linked"),
            F.when(ends, a["subject"]).otherwise(x["label"]).alias("subject"),
            F.when(ends, a["said"]).otherwise(F.concat(a["said"], F.array(said))).alias("said"),
        )

    start = F.struct(F.lit(False).alias("done"), F.lit(False).alias("linked"), subject.alias("subject"), F.array().cast("array<string>").alias("said"))
    told = F.aggregate(steps, start, step)["said"]
    return F.when(F.size(told) > 0, F.concat(F.array_join(told, ", "), F.lit(".")))


def narrated_comparison(a: Column, b: Column, verb: Column, a_objects: Column, b_objects: Column, shared: Column, limit: int = 3) -> Column:
    """One line for a kind of fact that both ends have, at most `limit` objects each."""
    some = lambda x: F.coalesce(F.nullif(F.array_join(F.slice(x, 1, limit), ", "), F.lit("")), F.lit("nothing recorded"))
    line = F.concat_ws("; ", F.concat_ws(" ", a, verb, some(a_objects)), F.concat_ws(" ", b, verb, some(b_objects)))
    both = F.when(F.size(shared) > 0, F.concat(F.lit(" (both: "), F.array_join(F.slice(shared, 1, limit), ", "), F.lit(")"))).otherwise(F.lit(""))
    return F.concat(line, both, F.lit("."))
