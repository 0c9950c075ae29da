"""Column functions on JSON text: validity, quoting, escapes, number and time text. Built-ins first; an Arrow function
takes only the values on which the built-ins differ, and sees nulls for the rest."""

from __future__ import annotations

import secrets

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators import codec
from ..options import EncodeOptions

_MARK = secrets.token_hex(12)
#: A number that may be beyond a double's range.
_HUGE = r"[eE]\+?0*[0-9]{3,}|[0-9]{309,}"
def prepare(spark: SparkSession) -> None:
    """Session settings that built-in parsing needs: duplicate keys are allowed (the last one wins), times are UTC."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def col(c: "Column | str") -> Column:
    return F.col(c) if isinstance(c, str) else c


def wrapped(s: Column) -> Column:
    """A document as the first of two elements of a parsed array, the second being a mark that no document holds.

    What ends the array early or adds to it leaves another length, so trailing text, which parsing ignores, shows.
    """
    return F.try_parse_json(F.concat(F.lit("["), s, F.lit(f',"{_MARK}"]')))


def whole(w: Column) -> Column:
    """Whether wrapped() took the document for exactly one value."""
    return F.coalesce((F.try_variant_get(w, "$[1]", "string") == _MARK) & F.try_variant_get(w, "$[2]", "variant").isNull(), F.lit(False))


def is_valid(c: "Column | str") -> Column:
    """Whether a document is valid JSON; null for null. Only documents with a number that may overflow go to the codec."""
    s = col(c)
    exact = F.arrow_udf(lambda x: pa.array([codec.valid(v) for v in x.to_pylist()], pa.bool_()), "boolean")
    found = exact(F.when(s.rlike(_HUGE), s))
    return F.when(s.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(found, whole(wrapped(s))))


def json_quote(c: "Column | str", options: EncodeOptions = EncodeOptions()) -> Column:
    """A string as a JSON string."""
    s = col(c)
    if options.utf8_correction:
        s = F.make_valid_utf8(s)
    text = F.to_json(F.struct(s.alias("v")))
    plain = F.substr(text, F.lit(6), F.length(text) - 6)
    # built-in escapes of control characters have upper-case digits; an escape begins behind an even number of backslashes
    one = lambda t, c: F.regexp_replace(t, F.concat(F.lit(r"(?<!\\)((?:\\\\)*+)\\u00([01])"), c), F.concat(F.lit(r"$1\\u00$2"), F.lower(c)))
    lower = F.aggregate(F.array(*map(F.lit, "ABCDEF")), plain, one)
    return escape(F.when(plain.contains("\\u00"), lower).otherwise(plain), options)


def escape(text: Column, options: EncodeOptions) -> Column:
    """The optional escapes on finished JSON text: their characters only occur inside strings."""
    if options.escape_html:
        for char, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
            text = F.replace(text, F.lit(char), F.lit(code))
    if options.escape_line_terms:
        for char, code in (("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
            text = F.replace(text, F.lit(char), F.lit(code))
    return text


def float_text(c: "Column | str", single: bool = False, exp_auto: bool = False) -> Column:
    """A number's shortest digits; null for NaN and infinities.

    Numbers of at most 15 digits with at most four behind the point read back from that decimal, which makes it the
    shortest; the rest go to the codec.
    """
    x = col(c).cast("double")
    part = F.round(F.abs(x) * 10000).try_cast("long") % 10000
    digits = F.rtrim(F.lpad(part.cast("string"), 4, "0"), F.lit("0"))
    whole_ = F.abs(x).try_cast("long").cast("string")
    text = F.concat(F.when(x < 0, "-").otherwise(""), whole_, F.when(part > 0, F.concat(F.lit("."), digits)).otherwise(""))
    near = F.abs(x).between(F.lit(1e-4), F.lit(9.9e10)) & (F.round(x * 10000) / 10000 == x) if not single else F.abs(x).between(F.lit(1.0), F.lit(1e6)) & (x == F.floor(x))
    exact = F.arrow_udf(lambda v: pa.array([None if y is None or y != y or abs(y) == float("inf") else codec.float_text(y, single, exp_auto) for y in v.to_pylist()], pa.string()), "string")
    return F.when(near, text).otherwise(exact(F.when(~near, x)))


def time_text(c: "Column | str") -> Column:
    """RFC 3339 in UTC, the fraction's trailing zeros cut; null beyond the years 0 to 9999."""
    t = col(c)
    text = F.concat(F.regexp_replace(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "\\.?0+$", ""), F.lit("Z"))
    return F.when(F.year(t).between(0, 9999), text)


def time_value(c: "Column | str") -> Column:
    """RFC 3339 text as a timestamp; null for anything else."""
    s = col(c)
    good = s.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([.,]\d+)?(Z|[+-]\d\d:\d\d)$")
    cut = F.regexp_replace(F.replace(s, F.lit(","), F.lit(".")), r"(\.\d{6})\d+", "$1")
    return F.when(good, F.try_to_timestamp(cut))


def indent(c: "Column | str", prefix: str = "", step: str = "  ") -> Column:
    """Compact JSON text over several lines; an empty step leaves it compact."""
    run = F.arrow_udf(lambda x: pa.array([None if v is None else codec.indented(v, prefix, step) for v in x.to_pylist()], pa.string()), "string")
    return run(col(c)) if step else col(c)


def raw_member(c: "Column | str", name: str) -> Column:
    """The verbatim text of an object's member (the last of that name); null if there is none or the text is no object."""

    def one(v: str | None) -> str | None:
        if v is None:
            return None
        at = codec._WS.match(v, 0).end()
        if v[at : at + 1] != "{":
            return None
        try:
            found = [v[a:b] for k, a, b in codec.members(v, at)[0] if k == name]
        except codec.JsonSyntaxError:
            return None
        return found[-1] if found else None

    return F.arrow_udf(lambda x: pa.array([one(v) for v in x.to_pylist()], pa.string()), "string")(col(c))


def dynamic(c: "Column | str", numbers: str = "exact") -> Column:
    """A document as a variant. numbers: exact keeps integers and decimals; text keeps each number's own text as a
    string; float64 makes every number a double."""
    s = col(c)
    if numbers == "exact":
        return F.when(is_valid(s), F.try_parse_json(s))

    def one(v: str | None) -> str | None:
        if v is None:
            return None
        try:
            tree = codec.document(v)
        except codec.JsonSyntaxError:
            return None
        return codec.writer_text(codec.renumbered(tree, numbers))

    return F.try_parse_json(F.arrow_udf(lambda x: pa.array([one(v) for v in x.to_pylist()], pa.string()), "string")(s))
