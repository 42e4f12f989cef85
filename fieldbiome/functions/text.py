"""Column functions that derive fields from free text. mode='reference' reproduces patterns that never match; default: intended."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldbiome.functions.coerce import blank_to_null, first_non_blank, fixed

# Keywords of the environments and treatment hints, in the order in which they are tried.
ENVIRONMENT_WORDS = {
    "wastewater": ["wastewater", "wwtp", "sewage", "effluent", "sludge"],
    "soil": ["soil", "rhizosphere", "topsoil", "farmland soil"],
    "river": ["river", "stream", "freshwater", "surface water"],
    "irrigation": ["irrigation", "irrigated", "canal water", "agricultural water"],
}
TREATMENT_WORDS = ["upgraded", "treated", "untreated", "control", "amended", "fertilized", "manure"]
#: Samples wanted by environment.
ENVIRONMENT_TARGETS = {"wastewater": 40, "soil": 25, "river": 20, "irrigation": 15}


def first_keyword(text: Column, groups: dict[str, list[str]]) -> Column:
    """The first group any of whose words the lower-cased text contains; null without one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for name, words in groups.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def environment_of(text: Column) -> Column:
    return first_keyword(text, ENVIRONMENT_WORDS)


def treatment_of(text: Column) -> Column:
    return F.coalesce(first_keyword(text, {w: [w] for w in TREATMENT_WORDS}), F.lit("NA"))


def merged_text(*columns: Column) -> Column:
    """The columns joined by single spaces; nulls count as empty."""
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])


def year_of(text: Column, mode: str = "intended") -> Column:
    if mode == "reference":
        return F.lit("NA")
    return F.coalesce(blank_to_null(F.regexp_extract(text, r"((?:19|20)\d{2})", 1)), F.lit("NA"))


def timepoint_of(text: Column, mode: str = "intended") -> Column:
    """The first of t1, time point 1, day 1, week 1, month 1 that the text holds, without spaces; else NA."""
    if mode == "reference":
        return F.lit("NA")
    low = F.lower(F.coalesce(text, F.lit("")))
    patterns = [r"\b(t\d+)\b", r"\b(time ?point ?\d+)\b", r"\b(day ?\d+)\b", r"\b(week ?\d+)\b", r"\b(month ?\d+)\b"]
    found = [blank_to_null(F.regexp_replace(F.regexp_extract(low, p, 1), " ", "")) for p in patterns]
    return F.coalesce(*found, F.lit("NA"))


def slug(text: Column, fallback: str = "UNKNOWN_PLANT", most: int = 80) -> Column:
    """Runs of other characters than letters and digits become _; trimmed, cut to `most`, fallback if nothing is left."""
    s = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "[^A-Za-z0-9]+", "_")
    s = F.substring(F.regexp_replace(s, "^_+|_+$", ""), 1, most)
    return F.when(s == "", fallback).otherwise(s)


def prefixed_slug(country: Column, alias: Column) -> Column:
    core, prefix = slug(F.coalesce(country, F.lit("unknown_site"))), alias_prefix(alias)
    return F.when(prefix != "", F.concat_ws("_", core, prefix)).otherwise(core)


def alias_prefix(alias: Column) -> Column:
    return F.regexp_extract(F.coalesce(alias, F.lit("")), "^([A-Za-z]+)", 1)


def time_code(alias: Column) -> Column:
    """WA is before (0), WB after (1); else blank."""
    p = F.upper(alias_prefix(alias))
    return F.when(p == "WA", "0").when(p == "WB", "1").otherwise("")


def treatment_code(place: Column) -> Column:
    low = F.lower(F.coalesce(place, F.lit("")))
    return F.when(low.contains("wascana creek"), "1").when(low.contains("qu'appelle river"), "0").otherwise("")


def aro_id(header: Column) -> Column:
    """'ARO:' and the digits after its first place in a header; null if no digit follows there."""
    tail = F.when(F.locate("ARO:", header) > 0, F.substring(header, F.locate("ARO:", header), F.length(header)))
    return blank_to_null(F.regexp_extract(tail, "^(ARO:[0-9]+)", 1))


def first_of_list(text: Column, sep: str = ";") -> Column:
    return F.trim(F.split_part(text, F.lit(sep), F.lit(1)))


def clean_sequence(seq: Column) -> Column:
    return F.regexp_replace(F.upper(seq), "[^A-Z]", "")


def any_contains(columns: list[Column], token: str) -> Column:
    """Whether any of the columns contains a token (a wildcard *token*)."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(c.contains(token), F.lit(False))
    return out


def panel_title(study: Column, label: Column | None = None) -> Column:
    """'Study X' for names that are study and an id, other names as they are; with a label, ': label' after it."""
    x = F.regexp_extract(F.trim(study), "^(?i:study)([A-Za-z0-9]+)$", 1)
    title = F.when(x != "", F.concat(F.lit("Study "), F.upper(x))).otherwise(study)
    return title if label is None else F.concat(title, F.lit(": "), label)


def panel_note(n: Column, mge_start: Column, arg_start: Column, mge_word: Column, arg_word: Column) -> Column:
    """A panel's note: start values (two and one decimals, NA for null), directions, and the number of points."""
    start = lambda x, places: fixed(x, places)
    parts = [
        F.concat(F.lit("Start values: MGE="), start(mge_start, 2), F.lit(", ARG="), start(arg_start, 1)),
        F.concat(F.lit("Direction over time: MGE="), mge_word, F.lit(", ARG="), arg_word),
        F.concat(F.lit("n="), n.cast("string")),
    ]
    return F.concat_ws(" | ", *parts)


def collection_date(*sources: Column) -> Column:
    return first_non_blank(*sources)


def wrapped_fasta(seq_id: Column, seq: Column, width: int = 80) -> Column:
    """A FASTA record with lines of `width`."""
    return F.concat(F.lit(">"), seq_id, F.lit("\n"), F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n"))


def links_of(html: Column) -> Column:
    """Distinct targets of href attributes, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)))
