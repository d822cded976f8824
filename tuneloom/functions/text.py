"""Text helpers with Python string semantics, written as Spark column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The characters Python's str.isspace() accepts.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same characters as a pattern; the JVM's Unicode \s lacks the four separators.
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
# The line boundaries of Python's str.splitlines(), after CR LF has become LF.
LINE_BREAK = r"[\n-\r\x1c-\x1e\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace."""
    return F.btrim(text, F.lit(WHITESPACE))


def tokens(text: Column) -> Column:
    """Whitespace-separated tokens; empty for blank text."""
    stripped = strip(text)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, WHITESPACE_RUN)
    )


def token_count(text: Column) -> Column:
    """How many tokens; splitting '' gives one empty part, which does not count."""
    stripped = strip(text)
    return F.size(F.split(stripped, WHITESPACE_RUN)) - (stripped == "").cast("int")


def capitalize(text: Column) -> Column:
    """First character upper, everything else lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(text.substr(F.lit(2), F.length(text))))


def lines(text: Column) -> Column:
    """Split at line boundaries; a final line break does not open another line."""
    parts = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def column_or_empty(df: DataFrame, name: str) -> Column:
    """The column as text, or '' when it is absent from the schema or null in the row."""
    if name not in df.columns:
        return F.lit("")
    return F.coalesce(df[name].cast("string"), F.lit(""))


def first_present(df: DataFrame, *names: str) -> str | None:
    """The first of ``names`` the schema has. Decided on the schema, never on values."""
    return next((name for name in names if name in df.columns), None)


def first_truthy(*options: Column) -> Column:
    """First option that is neither null nor ''; '' when there is none."""
    return reduce(
        lambda rest, option: F.coalesce(F.nullif(option, F.lit("")), rest),
        reversed(options),
        F.lit(""),
    )


def _scalar_text(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return F.when(value, F.lit("True")).when(~value, F.lit("False"))
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(value)
    return value.cast("string")


def _field_text(value: Column, dtype: T.StructType, field: str) -> Column:
    return _scalar_text(value.getField(field), dtype[field].dataType)


def variant_items(value: Column) -> Column:
    """The items of a list in a variant; null for any other shape."""
    return F.try_variant_get(value, "$", "array<variant>")


def variant_field(value: Column, name: str) -> Column:
    """A field of an object in a variant, null for any other shape or without the field."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def is_variant_object(value: Column) -> Column:
    """Whether a variant that is no list is an object; its JSON form tells, at the first character."""
    return F.startswith(F.to_json(value), F.lit("{"))


def variant_scalar(value: Column) -> Column:
    """A variant as text: strings stay, true and false are ``True`` and ``False``, lists and objects are JSON; null stays null."""
    as_json = F.to_json(value)
    return F.when(as_json == "true", F.lit("True")).when(as_json == "false", F.lit("False")).otherwise(F.try_variant_get(value, "$", "string"))


def _flatten_variant(value: Column) -> Column:
    def item(element: Column) -> Column:
        text = F.when(is_variant_object(element), variant_scalar(variant_field(element, "content"))).otherwise(variant_scalar(element))
        return F.coalesce(text, F.lit(""))

    listed = F.array_join(F.transform(variant_items(value), item), "\n")
    content = variant_field(value, "content")
    single = F.when(is_variant_object(value) & content.isNotNull(), F.coalesce(variant_scalar(content), F.lit("")))
    return F.coalesce(listed, single, variant_scalar(value), F.lit(""))


def first_field(row: Column, *names: str) -> Column:
    """Of a row kept as a variant, the first of ``names`` it has; a field that holds null or nothing counts."""
    return F.coalesce(*(variant_field(row, name) for name in names))


def parsed_shapes(text: Column) -> Column:
    """JSON text as a variant that keeps each row's shape; text that is no JSON is a string."""
    return F.coalesce(F.try_parse_json(text), text.cast("variant"))


def flatten(value: Column, dtype: T.DataType) -> Column:
    """Turn a prompt or completion of any shape into one text.

    Text stays; a list joins its items by newline (a message item gives its ``content``,
    or '' without one); a single message gives its ``content``, or its JSON form without
    one; other scalars give their string form. Null gives ''. A variant (see ``parsed_shapes``) does
    so by the shape of each row and of each item.
    """
    if isinstance(dtype, T.VariantType):
        return _flatten_variant(value)
    if isinstance(dtype, T.ArrayType):
        item = dtype.elementType

        def one(element: Column) -> Column:
            if isinstance(item, T.StructType):
                text = _field_text(element, item, "content") if "content" in item.names else F.lit("")
            elif isinstance(item, T.MapType):
                text = _scalar_text(element["content"], item.valueType)
            else:
                text = _scalar_text(element, item)
            return F.coalesce(text, F.lit(""))

        text = F.array_join(F.transform(value, one), "\n")
    elif isinstance(dtype, T.StructType):
        text = _field_text(value, dtype, "content") if "content" in dtype.names else F.to_json(value)
    elif isinstance(dtype, T.MapType):
        text = F.when(
            F.map_contains_key(value, "content"), _scalar_text(value["content"], dtype.valueType)
        ).otherwise(F.to_json(value))
    else:
        text = _scalar_text(value, dtype)
    return F.coalesce(text, F.lit(""))


def flat_column(df: DataFrame, name: str) -> Column:
    return flatten(F.col(name), df.schema[name].dataType)
