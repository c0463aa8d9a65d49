"""Text expressions: tokens, bigrams, hashed embeddings, names, snippets, chunks."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"([\p{L}\p{N}_]+)"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 1)


def bigrams(text: Column) -> Column:
    """Distinct character pairs."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), 0)
    pairs = F.zip_with(F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, 2, F.size(chars)), lambda a, b: F.concat(a, b))
    return F.array_distinct(pairs)


def hash_bucket(token: Column, buckets: int = 256) -> Column:
    return F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % buckets


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; a zero norm counts as one."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: total(F.transform(x, lambda v: v.cast("double") * v.cast("double")))
    size = lambda x: F.when(norm(x) == 0, 1.0).otherwise(F.sqrt(norm(x)))
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    return dot / (size(a) * size(b))


def occurrences(text: Column, part: Column) -> Column:
    """How often a literal part occurs, without overlaps."""
    n = F.char_length(part)
    return F.when(n > 0, ((F.char_length(text) - F.char_length(F.replace(text, part, F.lit("")))) / n)).otherwise(0).cast("long")


def snippet(text: Column, query: Column, width: int = 260, lead: int = 60) -> Column:
    at = F.position(F.lower(query), F.lower(text))
    return F.when(at > 0, F.substring(text, F.greatest(F.lit(1), at - lead), F.lit(width)))


def windows(text: Column, size: int, overlap: int) -> Column:
    """``array<struct<ordinal, start, stop, text>>`` of fixed windows; the last one reaches the end."""
    n = F.char_length(text)
    step = size - overlap
    last = F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int")
    starts = F.sequence(F.lit(0), last)
    return F.when(
        n > 0,
        F.transform(
            starts,
            lambda i: F.struct(
                i.alias("ordinal"),
                (i * step).alias("start"),
                F.least(i * step + size, n).alias("stop"),
                F.substring(text, i * step + 1, F.lit(size)).alias("text"),
            ),
        ),
    ).otherwise(F.array().cast("array<struct<ordinal:int,start:int,stop:int,text:string>>"))


def plain_name(value: str | None) -> str | None:
    """NFKC, case folded, white space collapsed."""
    return None if value is None else " ".join(unicodedata.normalize("NFKC", value).casefold().split())


def canonical_name(names: Column) -> Column:
    """``plain_name`` for columns; Spark has no normal forms of its own."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(plain_name, na_action="ignore")

    return run(names)


def primitive_datatype(value: Column) -> Column:
    """XSD type of a VARIANT literal."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "BOOLEAN", "xsd:boolean")
        .when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT)$"), "xsd:integer")
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "xsd:double")
        .when(kind == "STRING", "xsd:string")
    )


def redacted(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)(api[_-]?key|token|secret|password)(\s*[=:]\s*)\S+", "$1$2***")


def nfc_term(names: Column) -> Column:
    """NFC with white space collapsed; Spark has no normal forms of its own."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: " ".join(unicodedata.normalize("NFC", v).split()), na_action="ignore")

    return run(names)


#: Forms of absolute IRIs that terms may have, and what none of them holds (fixed values).
HTTP_IRI, URN_IRI = r"^[hH][tT][tT][pP][sS]?://[^/?#]+([/?#].*)?$", r"^[uU][rR][nN]:[A-Za-z0-9][A-Za-z0-9-]{0,30}[A-Za-z0-9]:.+$"
NOT_IN_IRI = r"[\x00-\x20<>\"{}|\\^`]|#.*#|%([^0-9A-Fa-f]|$|[0-9A-Fa-f]([^0-9A-Fa-f]|$))"


def is_iri(value: Column) -> Column:
    """An absolute http, https or urn address with one fragment at most, whole escapes and no character that an IRI never has."""
    return (value.rlike(HTTP_IRI) | value.rlike(URN_IRI)) & ~value.rlike(NOT_IN_IRI)


def local_name(iri: Column) -> Column:
    """What follows the last slash or hash, without a query."""
    return F.regexp_extract(iri, r"([^/#?]*)(?:[?][^/#]*)?$", 1)


def sequence_ratio(a: Column, b: Column) -> Column:
    """Twice the matching characters over all characters, by longest matching blocks."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)
