"""JSON metadata in typed columns: parsed once when they are stored, filtered by statistics when they are read.

A path has four columns: ``type``, ``text`` of strings, ``flag`` of booleans, and ``key`` of
numbers, a string whose order is that of the numbers, whatever their size. A filter on
a stored path becomes comparisons of columns with constants, which Spark pushes down
to the files; only other paths, lists and objects are read from the JSON itself.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import filters
from ..operators.recovery import dealt

#: Exponents are written as five digits above this.
_ZERO = 50_000


def sort_key(number: int | float | Decimal) -> str:
    """A string that orders numbers as their values: sign, exponent, digits."""
    sign, digits, exponent = (Decimal(repr(number)) if isinstance(number, float) else Decimal(number)).as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    size, text = len(text) + exponent, text.rstrip("0")
    if not text:
        return "1"
    if not sign:
        return f"2{_ZERO + size:05d}{text}"
    return f"0{_ZERO - size:05d}" + text.translate(str.maketrans("0123456789", "9876543210")) + ":"


def _key(k: Column) -> Column:
    """``sort_key`` of a number by its ``filters.number_key``."""
    exponent = F.lpad((F.lit(_ZERO) + k["exponent"]).cast("string"), 5, "0")
    return F.when(k["sign"] == 0, "1").otherwise(F.concat(F.when(k["sign"] < 0, "0").otherwise("2"), exponent, k["digits"]))


def _short_key(text: Column) -> Column:
    """``sort_key`` of a whole number of up to 18 digits, without patterns."""
    digits = F.ltrim(text, F.lit("-"))
    size = F.lpad(F.when(F.startswith(text, F.lit("-")), F.lit(_ZERO) - F.char_length(digits)).otherwise(F.lit(_ZERO) + F.char_length(digits)).cast("string"), 5, "0")
    held = F.rtrim(digits, F.lit("0"))
    least = F.concat(F.lit("0"), size, F.translate(held, "0123456789", "9876543210"), F.lit(":"))
    return F.when(digits == "0", "1").when(F.startswith(text, F.lit("-")), least).otherwise(F.concat(F.lit("2"), size, held))


def names(field: str) -> dict[str, str]:
    """Columns of a path."""
    plain = re.sub(r"\W", lambda m: f"_{ord(m[0]):x}_", field.removeprefix("metadata."))
    return {kind: f"m_{plain}__{kind}" for kind in ("type", "text", "flag", "key")}


def shredded(rows: DataFrame, json_col: str, fields: list[str]) -> DataFrame:
    """``rows`` with the typed columns of ``fields``; the JSON stays as it is. Text that is no JSON has none."""
    paths = ["$" + "".join(f"['{p}']" for p in f.removeprefix("metadata.").split(".")) for f in fields]

    # What a step finds is a column of the next, so that it is found once a row.
    c = lambda i, kind: f"m_shredded_{i}_{kind}"
    each = range(len(fields))
    out = rows.withColumn("m_shredded", F.try_parse_json(json_col))
    out = out.withColumns({c(i, "v"): F.try_variant_get("m_shredded", paths[i], "variant") for i in each}).drop("m_shredded")
    out = out.withColumns({c(i, "kind"): F.split_part(F.schema_of_variant(c(i, "v")), F.lit("("), F.lit(1)) for i in each} | {c(i, "text"): F.try_variant_get(c(i, "v"), "$", "string") for i in each})
    number = lambda i: F.col(c(i, "kind")).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")
    short = lambda i: (F.col(c(i, "kind")) == "BIGINT") & (F.char_length(c(i, "text")) <= 18)
    out = out.withColumns({c(i, "long"): F.when(number(i) & ~short(i), filters.number_key(F.col(c(i, "text")))) for i in each})
    typed = []
    for i, field in enumerate(fields):
        v, kind, text = (F.col(c(i, x)) for x in ("v", "kind", "text"))
        shown = {
            "type": F.when(v.isNotNull(), F.when(F.is_variant_null(v), "null").when(number(i), "number").otherwise(F.lower(F.regexp_extract(kind, "^[A-Z]+", 0)))),
            "text": F.when(kind == "STRING", text), "flag": F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")),
            "key": F.when(short(i), _short_key(text)).when(number(i), _key(F.col(c(i, "long")))),
        }
        typed += [shown[x].alias(n) for x, n in names(field).items()]
    return out.select(*rows.columns, *typed)


def store(rows: DataFrame, json_col: str, fields: list[str], path: str, order_by: str | None = None) -> None:
    """Writes ``shredded`` rows; ``order_by`` is a field whose order the files follow, so that statistics prune by it."""
    if order_by is not None:
        # Files are split by their compressed bytes, which are few beside the work on their rows; rows are dealt before it.
        rows = dealt(rows)
    out = shredded(rows, json_col, fields)
    if order_by is not None:
        n = names(order_by)
        out = out.repartitionByRange(n["type"], n["key"], n["text"]).sortWithinPartitions(n["type"], n["key"], n["text"])
    out.write.parquet(path)


def _leaf(n: dict[str, str], op: str, wanted: object) -> Column | None:
    kind, text, flag, key = (F.col(n[k]) for k in ("type", "text", "flag", "key"))
    is_number = isinstance(wanted, (int, float, Decimal)) and not isinstance(wanted, bool)
    if op == "exists":
        return kind.isNotNull() if wanted else kind.isNull()
    if op in ("eq", "ne"):
        if isinstance(wanted, (list, dict)):
            return None
        if wanted is None:
            same = kind == "null"
        else:
            same = flag == wanted if isinstance(wanted, bool) else key == sort_key(wanted) if is_number else text == wanted
        return same if op == "eq" else kind.isNotNull() & ~F.coalesce(same, F.lit(False))
    if op == "in":
        if any(isinstance(w, (list, dict, bool)) or w is None for w in wanted):
            return None
        numbers = [sort_key(w) for w in wanted if not isinstance(w, str)]
        strings = [w for w in wanted if isinstance(w, str)]
        tests = [c.isin(v) for c, v in ((key, numbers), (text, strings)) if v]
        return tests[0] | tests[1] if len(tests) == 2 else tests[0] if tests else F.lit(False)
    if op == "contains":
        return None  # lists are not shredded
    column, value = (key, sort_key(wanted)) if is_number else (text, wanted)
    return {"gt": column > value, "gte": column >= value, "lt": column < value, "lte": column <= value}[op]


def to_column(ast: dict, json_col: str, fields: list[str], columns: dict[str, Column] | None = None) -> Column:
    """A filter over stored rows, equal to ``filters.to_column`` over their JSON."""
    filters.validate(ast)
    return _column(ast, json_col, {f.removeprefix("metadata."): names(f) for f in fields}, columns or {})


def _column(ast: dict, json_col: str, stored: dict[str, dict[str, str]], columns: dict[str, Column]) -> Column:
    for group in ("and", "or"):
        if group in ast:
            parts = [_column(c, json_col, stored, columns) for c in ast[group]]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if group == "and" else out | p
            return out
    own = stored.get(ast["field"].removeprefix("metadata."))
    if ast["field"] not in columns and own is not None:
        leaf = _leaf(own, ast["op"], ast["value"])
        if leaf is not None:
            return leaf
    return filters.to_column(ast, F.try_parse_json(json_col), columns)
