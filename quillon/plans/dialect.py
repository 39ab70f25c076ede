"""SQL of other engines for Spark: function names, field access and places in arrays.

Names are changed where a text is neither quoted nor a comment.  Everything else, joins, windows, LATERAL and common table
expressions among it, is Spark SQL already."""

from __future__ import annotations

import re

# Function names of the other dialect and Spark's.
NAMES = {
    "approx_percentile_cont": "percentile_approx", "array_concat": "concat", "array_element": "element_at", "array_has": "array_contains", "array_length": "cardinality", "array_to_string": "array_join",
    "covar": "covar_samp", "make_array": "array", "random": "rand", "starts_with": "startswith", "ends_with": "endswith", "strpos": "instr", "to_char": "date_format", "var": "var_samp", "var_sample": "var_samp",
}
_PIECES = re.compile(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/)", re.S)
_NAME = re.compile(r"(?<![\w.])(" + "|".join(sorted(NAMES, key=len, reverse=True)) + r")(\s*\()", re.I)
_PLACE = re.compile(r"(?<![\w.])([A-Za-z_][\w.]*)\[(\d+)\]")
_FIELD = re.compile(r"(?<![\w.])get_field\(\s*([A-Za-z_][\w.]*)\s*,\s*'(\w+)'\s*\)", re.I)


def to_spark(sql: str) -> str:
    """``sql`` with Spark's names; ``a[1]`` is an array's first element, ``get_field(s, 'x')`` a struct's field."""
    out = []
    for k, p in enumerate(_PIECES.split(_FIELD.sub(r"\1.`\2`", sql))):
        if k % 2 == 0:
            p = _PLACE.sub(r"element_at(\1, \2)", _NAME.sub(lambda m: NAMES[m[1].lower()] + m[2], p))
        out.append(p)
    return "".join(out)
