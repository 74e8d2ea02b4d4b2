"""Tokens and paths as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All engines read \\w as ASCII here; Python is told to.
IDENTIFIER = r"[a-zA-Z_]\w*"


def camel_parts(tok: Column) -> Column:
    """Parts of a camelCase word; two passes, so that engines without look-ahead agree."""
    return F.regexp_extract_all(F.regexp_replace(tok, r"([A-Z]+)([A-Z][a-z])", "$1 $2"), F.lit(r"\d+|[A-Z]?[a-z]+|[A-Z]+"), F.lit(0))


def split_identifier(tok: Column) -> Column:
    """The identifier in lower case, and its parts if it has two or more."""

    def all_of(parts: Column) -> Column:
        return F.when(F.size(parts) >= 2, F.concat(F.array(F.lower(tok)), F.transform(parts, F.lower))).otherwise(F.array(F.lower(tok)))

    parts = F.when(tok.contains("_"), F.filter(F.split(tok, "_"), lambda p: p != "")).otherwise(camel_parts(tok))
    # Plain words, which most are, have one part; the rest bind theirs once.
    return F.when(tok.rlike(r"^[A-Za-z][a-z]*$"), F.array(F.lower(tok))).otherwise(F.get(F.transform(F.array(parts), all_of), F.lit(0)))


def tokenize(text: Column) -> Column:
    """Identifier tokens, each with its parts; order and repeats are kept."""
    return F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0)), split_identifier))


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores (ASCII): the tokens of the file score."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9_]+"), F.lit(0))


def file_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]+$", "$1")


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: (p != "") & (p != "."))


def enrich(content: Column, path: Column) -> Column:
    """Content, the stem twice, and the last three directories: what the lexical index sees."""
    dirs = directories(path)
    last = F.slice(dirs, F.greatest(F.size(dirs) - 2, F.lit(1)), 3)
    return F.concat_ws(" ", content, stem(path), stem(path), F.array_join(last, " "))


# The same on the driver, for query strings.
def tokens_of(text: str) -> list[str]:
    out = []
    for tok in re.findall(IDENTIFIER, text, re.ASCII):
        if "_" in tok:
            parts = [p.lower() for p in tok.split("_") if p]
        else:
            parts = [p.lower() for p in re.findall(r"\d+|[A-Z]?[a-z]+|[A-Z]+", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", tok), re.ASCII)]
        out += [tok.lower(), *parts] if len(parts) >= 2 else [tok.lower()]
    return out
