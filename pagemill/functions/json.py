"""Reading JSON out of model replies.

What built-in functions can say stays a column expression; finding the first balanced object needs a scan that knows
strings and escapes, and runs as a vectorised Python function.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import text as tx


def balanced_object(text: str | None) -> str | None:
    """The first {...} that closes, braces in strings aside; None if there is none."""
    if not text or (start := text.find("{")) < 0:
        return None
    depth, quoted, skip = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def _first_objects(text: pd.Series) -> pd.Series:
    return text.map(balanced_object)


def first_object(t: Column) -> Column:
    return F.pandas_udf(_first_objects, "string")(t)


def valid(t: Column) -> Column:
    return F.try_parse_json(t).isNotNull()


def unfenced(t: Column) -> Column:
    """The contents of the first fence, or the text itself."""
    inside = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.when(inside != "", inside).otherwise(F.regexp_replace(t, r"```(?:json)?", ""))


def without_thoughts(t: Column) -> Column:
    return F.regexp_replace(t, r"(?s)<think>.*?</think>", "")


def without_trailing_commas(t: Column) -> Column:
    return F.regexp_replace(t, r",\s*([}\]])", "$1")


def greedy(t: Column) -> Column:
    """From the first { to the last }, if that is JSON."""
    found = F.regexp_extract(unfenced(t), r"(?s)\{.+\}", 0)
    return F.when(valid(found), found)


def extracted(t: Column) -> Column:
    """The first object behind thoughts and fences, trailing commas repaired."""
    found = without_trailing_commas(first_object(tx.without_control(unfenced(without_thoughts(t)))))
    return F.when(valid(found), found)


def ordered(t: Column) -> Column:
    """Directly, from a fence, or greedily."""
    return F.coalesce(F.when(valid(t), t), F.when(valid(unfenced(t)), unfenced(t)), greedy(t))


def or_summary(t: Column) -> Column:
    return F.coalesce(ordered(t), F.to_json(F.struct(t.alias("summary"), F.array().cast("array<string>").alias("key_points"))))


def untruncated(t: Column) -> Column:
    """As it is, cut behind its last complete list, greedily, or an empty object."""
    cut = F.concat(F.regexp_extract(t, r"(?s)^(.*\}\s*\])", 1), F.lit("}"))
    return F.coalesce(F.when(valid(t), t), F.when(valid(cut), cut), greedy(t), F.lit("{}"))


def closed(t: Column) -> Column:
    """Missing brackets and braces appended, by their numbers."""
    missing = lambda a, b: F.greatest(tx.hits(t, a) - tx.hits(t, b), F.lit(0))
    return F.concat(t, F.repeat(F.lit("]"), missing("[", "]")), F.repeat(F.lit("}"), missing("{", "}")))


def source_lists(value, path: str = "") -> list[tuple[str, list]]:
    """(path, sources) of every object that has sources, depth first."""
    out = []
    if isinstance(value, dict):
        if isinstance(value.get("sources"), list):
            out.append((path, [str(s) for s in value["sources"]]))
        for k, v in value.items():
            out += source_lists(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            out += source_lists(v, f"{path}[{i}]")
    return out


def _flattened(text: pd.Series) -> pd.Series:
    def one(t):
        try:
            return [{"path": p, "sources": s} for p, s in source_lists(json.loads(t))]
        except (TypeError, ValueError):
            return []

    return text.map(one)


def flattened_sources(t: Column) -> Column:
    """Every list of sources of a JSON text, with its path."""
    return F.pandas_udf(_flattened, "array<struct<path:string,sources:array<string>>>")(t)


def sample(result: Column, lists: dict[str, int], cap: int) -> Column:
    """A short JSON sample: the first members of each list, cut at ``cap`` characters."""
    return F.substring(F.to_json(F.struct(*(F.slice(result[k], 1, n).alias(k) for k, n in lists.items()))), 1, cap)


def normalised_summary(text: str, headings: list[str], cutoffs: list[str], placeholder: str = "-") -> str:
    """Sections under fixed headings in order: each up to the next heading or cut-off; missing ones get a placeholder."""
    places = sorted((m.start(), m.end(), h) for h in headings for m in [re.search(re.escape(h), text)] if m)
    if not places:
        return "\n\n".join(f"{h}\n{(text.strip() if i == 0 else '') or placeholder}" for i, h in enumerate(headings))
    found = {}
    for (_, end, h), (stop, *_) in zip(places, [*places[1:], (len(text),)]):
        body = text[end:stop]
        cut = min((m.start() for c in ["【", r"\n#", *map(re.escape, cutoffs)] for m in [re.search(c, body)] if m), default=len(body))
        found[h] = body[:cut].strip()
    return "\n\n".join(f"{h}\n{found.get(h) or placeholder}" for h in headings)


# The schema of an extraction, for from_json.
ITEM = "STRUCT<id: STRING, text: STRING, finding: STRING, original_quote: STRING, strength: STRING, evidence_level: STRING, sources: ARRAY<STRING>>"
EXTRACTION = f"doc_metadata STRUCT<title: STRING, authors: STRING, organization: STRING, publish_date: STRING, year: STRING, doi: STRING, document_type: STRING, sources: ARRAY<STRING>>, scope STRUCT<objective: STRING, target_population: STRING, sources: ARRAY<STRING>>, recommendations ARRAY<{ITEM}>, key_findings ARRAY<{ITEM}>, conclusions ARRAY<{ITEM}>"
