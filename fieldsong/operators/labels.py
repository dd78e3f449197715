"""Labels of a segment: an array of structs (species, certainty, calltype, filter) and what reviewers do with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNSURE = "Don't Know"
LABEL = "struct<species: string, certainty: double, calltype: string, filter: string>"


def label(species: Column, certainty: Column, calltype: Column | None = None, source: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(species.alias("species"), certainty.cast("double").alias("certainty"), (none if calltype is None else calltype).alias("calltype"), (none if source is None else source).alias("filter"))


def no_label() -> Column:
    return F.array(label(F.lit(UNSURE), F.lit(0.0)))


def _with_certainty(x: Column, certainty: Column) -> Column:
    return x.withField("certainty", certainty)


def has_species(labels: Column, species: str) -> Column:
    return F.exists(labels, lambda x: x["species"] == species)


def has_calltype(labels: Column, species: str, calltype: str) -> Column:
    return F.exists(labels, lambda x: (x["species"] == species) & (x["calltype"] == calltype))


def keys(labels: Column) -> Column:
    return F.transform(labels, lambda x: x["species"])


def keys_with_calltypes(labels: Column) -> Column:
    return F.transform(labels, lambda x: F.struct(x["species"].alias("species"), x["calltype"].alias("calltype")))


def calltype_of(labels: Column, species: str) -> Column:
    return F.get(F.filter(labels, lambda x: x["species"] == species), F.lit(0))["calltype"]


def add_label(labels: Column, species: str, certainty: float) -> Column:
    """With a label more, unless there is one of the species."""
    return F.when(has_species(labels, species), labels).otherwise(F.concat(labels, F.array(label(F.lit(species), F.lit(certainty)))))


def wipe(labels: Column, species: str) -> Column:
    """Without the species; an empty result means that the segment goes."""
    return F.filter(labels, lambda x: x["species"] != species)


def remove(labels: Column, species: str) -> Column:
    """Without the species; Don't Know takes the place of the last label."""
    return or_unsure(wipe(labels, species))


def or_unsure(labels: Column) -> Column:
    return F.when(F.size(labels) == 0, no_label()).otherwise(labels)


def confirm(labels: Column, species: str | None = None) -> Column:
    """Certainties below 100 become 100 (of one species, or of all), but for Don't Know."""
    mine = lambda x: F.lit(True) if species is None else x["species"] == species
    return F.transform(labels, lambda x: F.when((x["species"] != UNSURE) & (x["certainty"] < 100) & mine(x), _with_certainty(x, F.lit(100.0))).otherwise(x))


def question(labels: Column, species: str | None = None) -> Column:
    """Certainties of 100 become 50, but for Don't Know."""
    mine = lambda x: F.lit(True) if species is None else x["species"] == species
    return F.transform(labels, lambda x: F.when((x["species"] != UNSURE) & (x["certainty"] == 100) & mine(x), _with_certainty(x, F.lit(50.0))).otherwise(x))


def changed(before: Column, after: Column) -> Column:
    return ~before.eqNullSafe(after)


def needs_review(labels: Column, bound: float) -> Column:
    """Any label as certain as bound, or less."""
    return F.exists(labels, lambda x: x["certainty"] <= bound)


def all_certain(labels: Column, species: str) -> Column:
    return F.array_min(F.transform(labels, lambda x: F.when(x["species"] == species, x["certainty"]).otherwise(100.0))) == 100


def rename(labels: Column, old: str, new: str) -> Column:
    return F.transform(labels, lambda x: F.when(x["species"] == old, x.withField("species", F.lit(new))).otherwise(x))


def info(labels: Column) -> Column:
    """One line of text for all labels."""
    one = lambda x: F.concat_ws(" ", x["species"], F.format_string("(%.0f)", x["certainty"]), x["calltype"])
    return F.array_join(F.transform(labels, one), "; ")


def valid(labels: Column) -> Column:
    """No species twice, certainties from 0 to 100, and a call type wherever a filter other than M made the label."""
    names = keys(labels)
    once = F.size(F.array_distinct(names)) == F.size(names)
    each = F.forall(labels, lambda x: x["species"].isNotNull() & x["certainty"].between(0, 100) & (x["filter"].isNull() | (x["filter"] == "M") | x["calltype"].isNotNull()))
    return once & each


def verdict(labels: Column, species: str, colour: Column) -> Column:
    """A quick reviewer's verdict: green confirms, yellow questions, red removes, anything else leaves as is."""
    return (
        F.when(colour == "green", confirm(labels, species))
        .when(colour == "yellow", question(labels, species))
        .when(colour == "red", remove(labels, species))
        .otherwise(labels)
    )


def bat_category(labels: Column) -> Column:
    """Category of a bat recording by its labels of the two kinds."""
    sure = lambda name: F.exists(labels, lambda x: (x["species"] == name) & (x["certainty"] == 100))
    some = lambda name: has_species(labels, name)
    long, short = "Long-tailed bat", "Short-tailed bat"
    return (
        F.when(sure(long) & sure(short), "Both")
        .when(sure(long), "Long Tail")
        .when(sure(short), "Short Tail")
        .when(some(long) | some(short), "Possible")
        .otherwise("Non-bat")
    )


def basic(segments: DataFrame, species: str, certainty: float, low: int = 0, high: int = 0, calltype: str | None = None, source: str | None = None) -> DataFrame:
    """segments with f_lo, f_hi and labels: one label and one band for all; bands below 0 raise."""
    if low < 0 or high < 0:
        raise ValueError(f"a band from {low} to {high} Hz cannot be used")
    text = lambda v: F.lit(v).cast("string")
    return segments.withColumns({"f_lo": F.lit(low), "f_hi": F.lit(high), "labels": F.array(label(F.lit(species), F.lit(float(certainty)), text(calltype), text(source)))})


def of_calltype(labels: Column, species: str, calltypes: list[str], calltype: str) -> Column:
    """Whether a segment is of a species' call type; if the species has one call type alone, of the species."""
    return has_species(labels, species) if len(calltypes) == 1 else F.coalesce(has_calltype(labels, species, calltype), F.lit(False))
