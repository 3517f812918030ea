"""Free-text register cells and replies of models, parsed with column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Square metres of a unit, and the words that name it (* for any ending): fixed values.
AREA_UNITS = [(10000.0, ["ha", "हे", "hectare*"]), (100.0, ["are", "आर"]), (101.0, ["guntha*"])]
SQUARE_FOOT, SQUARE_METRE = (0.092903, ["sqft*", "चौफूट"]), (1.0, ["sqm*", "चौमी"])


def _clause(clauses: Column, name: str) -> Column:
    """What the first clause that holds a name says after it, else null."""
    said = F.get(F.filter(clauses, lambda c: F.contains(c, F.lit(name + " "))), 0)
    return F.substring_index(said, name + " ", -1)


def let(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), made), 0)


def _amounts(clause: Column, units: list[tuple[float, list[str]]]) -> Column:
    """For each unit the first number in a clause that stands before a word of it, in square metres, else null."""
    quantities = F.transform(
        F.regexp_extract_all(clause, F.lit(r"\d+(?:\.\d+)?\s*[\p{L}\p{M}]+"), F.lit(0)),
        lambda q: F.struct(F.regexp_extract(q, r"^[\d.]+", 0).cast("double").alias("n"), F.regexp_extract(q, r"[\p{L}\p{M}]+$", 0).alias("word")),
    )

    def named(words: list[str]) -> Callable[[Column], Column]:
        def fits(q: Column) -> Column:
            out = F.lit(False)
            for w in words:
                out = out | (F.startswith(q["word"], F.lit(w[:-1])) if w.endswith("*") else q["word"] == w)
            return out

        return fits

    return let(quantities, lambda qs: F.array(*[F.get(F.filter(qs, named(words)), 0)["n"] * factor for factor, words in units]))


def parse_cell(text: Column) -> Column:
    """survey_numbers, cts, area_sqm, built_sqm, open_space_sqm, flag of a cell. A cell is a list of clauses between
    commas; in each the first amount of a unit counts. "Akker" is flagged and never converted."""
    # full stops other than decimal ones go, and two-word units become one
    tidy = F.regexp_replace(F.regexp_replace(F.lower(text), r"\.(?!\d)", ""), r"\b(sq|चौ)\s+(?=[fmफम])", "$1")

    def parsed(plain: Column) -> Column:
        word_and_number = lambda w: F.nullif(F.regexp_extract(plain, rf"\b{w}\s*(?:no\s*)?([\d.]*\d)", 1), F.lit(""))
        amounts = lambda clauses: F.struct(
            _amounts(_clause(clauses, "area"), AREA_UNITS).alias("area"), _amounts(_clause(clauses, "construction"), [SQUARE_FOOT]).alias("built"),
            _amounts(_clause(clauses, "open space"), [SQUARE_METRE]).alias("open"),
        )
        return F.struct(word_and_number("cts").alias("cts"), word_and_number("akker").alias("akker"), let(F.split(plain, ","), amounts).alias("m"))

    named = F.get(F.filter(F.split(text, ","), lambda c: c.rlike(r"(?i)(?:s\.?|survey\s*)no\.?\s*\d")), 0)
    listed = F.split(F.regexp_replace(named, r"(?i)^.*?(?:s\.?|survey\s*)no\.?\s*(?=\d)", ""), "&")
    surveys = F.filter(F.transform(listed, lambda s: F.regexp_extract(F.trim(s), r"^\d+(?:/\w+)?", 0)), lambda s: s != "")

    def cell(p: Column) -> Column:
        area = p["m"]["area"]
        total = F.when(F.exists(area, lambda a: a.isNotNull()), F.aggregate(area, F.lit(0.0), lambda s, a: s + F.coalesce(a, F.lit(0.0))))
        return F.struct(
            F.coalesce(F.array_join(surveys, ";"), F.lit("")).alias("survey_numbers"), p["cts"].alias("cts"), total.alias("area_sqm"),
            F.round(F.get(p["m"]["built"], 0), 2).alias("built_sqm"), F.get(p["m"]["open"], 0).alias("open_space_sqm"),
            F.when(p["akker"].isNotNull(), F.concat(F.lit("Akker "), p["akker"], F.lit(": unit differs by district, needs review"))).alias("flag"),
        )

    return let(let(tidy, parsed), cell)


def lenient_json(reply: Column, schema: str) -> Column:
    """A struct of schema from a model's reply: without thoughts and fences, else its outermost braces; raw control
    characters are tolerated. Null where neither parses."""
    answer = F.trim(F.regexp_replace(reply, r"(?s)^.*</think>", ""))
    fenced = F.trim(F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1))
    braces = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    options = {"mode": "PERMISSIVE", "allowUnquotedControlChars": "true"}
    tried = [F.when(F.startswith(c, F.lit("{")), F.from_json(c, schema, options)) for c in (answer, fenced, braces)]
    first = schema.split(" ")[0]
    return F.coalesce(*[F.when(t[first].isNotNull(), t) for t in tried])
