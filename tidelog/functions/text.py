"""Column functions on strings. The three normalisers differ on purpose: each serves another kind of key."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def light(x: Column) -> Column:
    """Trimmed, upper case, single spaces; blanks and runs of @ are NULL."""
    y = F.regexp_replace(F.upper(F.trim(x)), r"\s+", " ")
    return F.when((y != "") & ~y.rlike("^@+$"), y)


def key(x: Column) -> Column:
    """Upper case, all but A-Z, 0-9 and > as single spaces; UNKNOWN if nothing is left."""
    y = F.trim(F.regexp_replace(F.upper(x), "[^A-Z0-9>]+", " "))
    return F.coalesce(F.when(y != "", y), F.lit("UNKNOWN"))


@F.pandas_udf(T.StringType())
def folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility-decomposed without combining marks; arrows as >, separators as spaces, upper case."""
    for x in batches:
        y = x.map(lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)), na_action="ignore")
        y = y.str.replace("→", ">").str.replace(r"\s*(?:=+>|-+>|>)\s*", ">", regex=True).str.replace(r"[,_;|]+", " ", regex=True)
        yield y.str.upper().str.replace(r"\s+", " ", regex=True).str.strip()


def folded_ascii(x: Column) -> Column:
    """The same without leaving the JVM, for text with Latin-1 accents only."""
    plain = F.translate(F.upper(x), "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "AAAAAACEEEEIIIINOOOOOUUUUY")
    arrows = F.regexp_replace(plain, r"\s*(?:→|=+>|-+>|>)\s*", ">")
    return F.trim(F.regexp_replace(F.regexp_replace(arrows, r"[,_;|]+", " "), r"\s+", " "))


def compact(x: Column) -> Column:
    return F.regexp_replace(F.upper(x), "[^A-Z0-9]", "")


def terminal(x: Column) -> Column:
    """The last non-empty part of a route a > b > c."""
    return F.trim(F.try_element_at(F.filter(F.split(x, ">"), lambda p: F.trim(p) != ""), F.lit(-1)))


def is_route(x: Column) -> Column:
    return F.coalesce(x.contains(">"), F.lit(False))


def code_like(x: Column) -> Column:
    """Two letters, perhaps a space, three letters or digits."""
    return F.coalesce(x.rlike(r"^[A-Z]{2}\s?[A-Z0-9]{3}$"), F.lit(False))


def composite(*xs: Column) -> Column:
    """Parts joined by a separator that no part holds; missing parts count as UNKNOWN."""
    return F.concat_ws("\u001f", *(F.coalesce(x.cast("string"), F.lit("UNKNOWN")) for x in xs))


def labels(flags: dict[str, Column]) -> Column:
    """The names of the flags that hold, in their order, joined by semicolons."""
    return F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(x, F.lit(False)), F.lit(name)) for name, x in flags.items()))), ";")


def boolean(x: Column) -> Column:
    """true/1/yes and false/0/no in any case; anything else raises."""
    y = F.lower(F.trim(x.cast("string")))
    return F.when(y.isNull(), F.lit(None).cast("boolean")).when(y.isin("true", "1", "yes"), True).when(y.isin("false", "0", "no"), False).otherwise(
        F.raise_error(F.concat(F.lit("not a boolean: "), y)).cast("boolean")
    )


@F.pandas_udf(T.DoubleType())
def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
    """Ratio of matching blocks (difflib), in Arrow batches; for the few pairs that exact joins leave."""
    return pd.Series([None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(x, y, strict=True)], dtype="float64")
