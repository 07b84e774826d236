"""Scalar expressions over columns: text, parsing, scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What marks a cut text, stands for an empty retrieval, and stands between documents.
TRUNCATION_SUFFIX = "\n... [truncated for token limit]"
NO_CONTEXT = "暂无匹配的历史上下文数据"
#: Fixed value: the marker by which an empty retrieval is recognised.
NO_CONTEXT_MARK = "暂无匹配"
CONTEXT_SEPARATOR = "\n---\n"
#: How many characters each step of the workflow sees.
QUERY_CHARS, ROUTER_CHARS, CRITIQUE_CHARS, LOCAL_CHARS, PREVIEW_CHARS = 500, 1500, 2000, 8000, 500


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, numbers and underscores (Unicode letters and numbers, no marks)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def prefix(text: Column, n: int) -> Column:
    """The first n code points."""
    return F.substring(text, 1, n)


def truncated(text: Column, n: int = LOCAL_CHARS) -> Column:
    """Texts over n code points are cut and say so; others stay."""
    return F.when(F.length(text) > n, F.concat(prefix(text, n), F.lit(TRUNCATION_SUFFIX))).otherwise(text)


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_fences(text: Column) -> Column:
    """Without code fences, then without white space at either end."""
    return strip(F.replace(F.replace(text, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))


def score(text: Column) -> Column:
    """A number as a double, not clamped; what is none counts as 1.0, a pass."""
    return F.coalesce(strip(text).try_cast("double"), F.lit(1.0))


def match_id_from_path(path: Column) -> Column:
    """The file name up to its first dot."""
    return F.substring_index(F.element_at(F.split(path, "/"), -1), ".", 1)


def is_demo(name: Column) -> Column:
    """Whether an uploaded file is accepted: by its suffix, case included."""
    return F.coalesce(name.endswith(".dem"), F.lit(False))


def upload_name(name: Column) -> Column:
    """A file name with eight random hexadecimal digits before it."""
    return F.concat_ws("_", F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8), name)


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def idf(n_docs: Column, df: Column) -> Column:
    """Smoothed inverse document frequency."""
    return F.log((n_docs + 1) / (df + 1)) + 1


def rrf(rank: Column) -> Column:
    """A rank's share in reciprocal rank fusion, ranks from 0."""
    return F.lit(1.0) / (F.lit(60) + rank)


def rendered(x: Column) -> Column:
    """A value as text; null as None."""
    return F.coalesce(x.cast("string"), F.lit("None"))


#: Competition map codes and the names of the knowledge corpus.
MAP_NAMES = {"de_mirage": "Mirage", "de_inferno": "Inferno", "de_dust2": "Dust2", "de_nuke": "Nuke", "de_ancient": "Ancient"}


def map_name(code: Column) -> Column:
    """A map's name in the corpus for its code; other values stay."""
    table = F.create_map(*[F.lit(x) for kv in MAP_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(code)), code)
