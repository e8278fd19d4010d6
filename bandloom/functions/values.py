"""Loosely typed model output, read from VARIANT by the kind each value really has."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

NUMBER = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"
NUMBER_OR_BOOLEAN = NUMBER.replace("(", "(BOOLEAN|", 1)


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated a single time, however often use names it."""
    return F.transform(F.array(value), use)[0]


class Read(NamedTuple):
    """What a value's kind, text and number are; the functions below take one in place of a VARIANT."""

    kind: Column
    text: Column
    number: Column


def parts(v: Column, path: str = "$") -> Column:
    """A value with all that is read from it: bind it once, by transform or once(), and use read() of it as often as needed."""
    value = v if path == "$" else F.try_variant_get(v, path, "variant")
    return F.struct(value.alias("value"), F.schema_of_variant(value).alias("kind"), F.try_variant_get(v, path, "string").alias("text"))


def read(given: Column) -> Read:
    """What parts() took, without another look at the VARIANT (but for the double of a FLOAT, whose text is shorter)."""
    found = given["kind"]
    number = F.when(found == "FLOAT", F.try_variant_get(given["value"], "$", "double")).otherwise(given["text"].try_cast("double"))
    number = F.when(found == "BOOLEAN", (given["text"] == "true").cast("double")).otherwise(number)
    return Read(F.when(found != "VOID", found), given["text"], number)


def _read(v: Column | Read) -> Read:
    return v if isinstance(v, Read) else Read(kind(v), F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double"))


def kind(v: Column | Read) -> Column:
    """BOOLEAN, BIGINT, DECIMAL(..), DOUBLE, STRING, ARRAY<..>, OBJECT<..>; null for a JSON null and a missing value."""
    if isinstance(v, Read):
        return v.kind
    found = F.schema_of_variant(v)
    return F.when(found != "VOID", found)


def is_number(v: Column | Read) -> Column:
    return F.coalesce(kind(v).rlike(NUMBER), F.lit(False))


def is_kind(v: Column | Read, name: str) -> Column:
    """Whether a scalar is of this kind. For lists and objects, which kind() would walk whole, see is_list and is_object."""
    return F.coalesce(kind(v).startswith(name), F.lit(False))


def items(v: Column, path: str = "$") -> Column:
    """The list's items; null where it is missing or of another kind."""
    return F.try_variant_get(v, path, "array<variant>")


def is_object(v: Column) -> Column:
    """Looks at the value itself only: nothing it holds is read or copied."""
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def as_double(v: Column | Read) -> Column:
    """Numbers and booleans; a string is not a number here."""
    return F.when(kind(v).rlike(NUMBER_OR_BOOLEAN), _read(v).number)


def as_text(v: Column | Read) -> Column:
    """The text of a scalar, booleans capitalised."""
    plain = _read(v).text
    return F.when(is_kind(v, "BOOLEAN"), F.when(plain == "true", "True").otherwise("False")).when(kind(v).isNotNull(), plain)


def truthy(v: Column | Read) -> Column:
    """False for null, false, zero and anything empty."""
    found, text, number = _read(v)
    return (
        F.when(found.isNull(), False).when(found == "STRING", text != "")
        .when(found.rlike(NUMBER_OR_BOOLEAN), number != 0).otherwise(~text.isin("[]", "{}"))
    )


def text_or_null(v: Column | Read) -> Column:
    text = strip(as_text(v))
    return F.when(text != "", text)


def positive_int(v: Column | Read) -> Column:
    """Numbers cut towards zero, booleans, and strings of an integer; null unless positive."""
    number = F.when(is_kind(v, "STRING"), F.regexp_extract(strip(as_text(v)), r"^\+?(\d+)$", 1).try_cast("int")).otherwise(as_double(v).try_cast("int"))
    return F.when(number > 0, number)


def confidence(v: Column | Read) -> Column:
    """Numbers held to 0..1 (not a number: 0), the words high, medium and low, otherwise null."""
    number = as_double(v)
    word = F.when(is_kind(v, "STRING"), strip(as_text(v)))
    held = F.when(F.isnan(number), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), number)))
    said = lambda w: F.when(is_word(w, "high"), 0.9).when(is_word(w, "medium"), 0.6).when(is_word(w, "low"), 0.3)
    return F.when(number.isNotNull(), held).otherwise(once(word, said))


def is_word(text: Column, word: str) -> Column:
    """Whether text is this word of a-z (but k) in any case: lower(text) == word without lower(), which costs far more than the match."""
    return text.rlike(rf"(?i)\A{word}\z")


def list_field(v: Column, name: str) -> Column:
    """The list's items; empty where it is missing or of another kind."""
    return F.coalesce(items(v, f"$.{name}"), F.array().cast("array<variant>"))


def records_field(v: Column, name: str, members: Sequence[str]) -> Column:
    """The list's objects as structs of these members, each as of parts(); empty where there is no list.

    One typed read where the list holds objects (and nulls) alone; otherwise each item is looked at.
    """
    plain = F.try_variant_get(v, f"$.{name}", f"array<struct<{','.join(f'{m}:variant' for m in members)}>>")
    sound = F.filter(plain, lambda x: x.isNotNull())
    one_by_one = F.transform(objects(list_field(v, name)), lambda x: F.struct(*[field(x, m).alias(m) for m in members]))
    return F.transform(F.coalesce(sound, one_by_one), lambda x: F.struct(*[parts(x[m]).alias(m) for m in members]))


def bad_list(v: Column, name: str) -> Column:
    """Whether the list is a JSON null, number or boolean, which cannot be walked."""
    found = field(v, name)
    scalar = F.when(F.try_variant_get(v, f"$.{name}", "double").isNotNull(), kind(found).rlike(NUMBER_OR_BOOLEAN))  # spares lists the walk of kind()
    return F.coalesce(F.is_variant_null(found), F.lit(False)) | F.coalesce(scalar, F.lit(False))


def last_item(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def objects(items: Column) -> Column:
    return F.filter(items, is_object)


def members_json(v: Column, keys: Sequence[str]) -> Column:
    """JSON text of an object with those of the keys that v has."""
    shown = [F.when(field(v, k).isNotNull(), F.concat(F.lit(f'"{k}":'), F.to_json(field(v, k)))) for k in keys]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*shown)), ","), F.lit("}"))
