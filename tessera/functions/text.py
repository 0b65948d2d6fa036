"""String functions on columns. White space is Unicode white space; lengths count code points."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a sentence ends, and the letters of a script.
SENTENCE_END = r"(?U)(?<=[.!?…])\s+|\n+"
GEORGIAN = "ა-ჿ"
# Fixed value: the shape of an owner/name id.
HUB_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]*/[A-Za-z0-9._-]+$"


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """The cleaned sentences of a text, in order, those left empty too."""
    return F.transform(F.split(or_empty(text), SENTENCE_END), collapsed)


def length_between(text: Column, least: int = 20, most: int = 300) -> Column:
    return F.length(text).between(least, most)


def has_script(text: Column, letters: str = GEORGIAN) -> Column:
    """Whether the text has a character of the class, a range such as "ა-ჿ"."""
    return text.rlike(f"[{letters}]")


def word_list(text: Column) -> Column:
    return F.filter(F.split(collapsed(or_empty(text)), " "), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(word_list(text))


def char_grams(text: Column, size: int = 3) -> Column:
    """The runs of `size` characters of the text between two spaces; the whole if it is shorter."""
    padded = F.concat(F.lit(" "), stripped(text), F.lit(" "))
    many = F.transform(F.sequence(F.lit(1), F.length(padded) - (size - 1)), lambda i: F.substr(padded, i, F.lit(size)))
    return F.when(F.length(padded) >= size, many).otherwise(F.array().cast("array<string>"))


def utf8_tokens(text: Column, shift: int = 5) -> Column:
    """Each UTF-8 byte plus `shift`, after the special ids: a batch's bytes become ids in one step."""

    @F.arrow_udf("array<int>")
    def tokens(column: pa.Array) -> pa.Array:
        column = column.cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
        return pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), pa.array(data.astype(np.int32) + np.int32(shift)))

    return tokens(or_empty(text))


def is_hub_id(spec: Column) -> Column:
    """owner/name ids: hf:// says so; paths and .json files are not."""
    marked = spec.startswith("hf://")
    path = spec.rlike(r"^[./~]") | spec.endswith(".json")
    return marked | (~path & spec.rlike(HUB_ID))


def without_hub_prefix(spec: Column) -> Column:
    return F.regexp_replace(spec, "^hf://", "")


def rate_limited(code: Column, message: Column) -> Column:
    told = F.lower(or_empty(message)).rlike("429|resource_exhausted|quota|rate limit")
    return F.coalesce(code == 429, F.lit(False)) | told


def out_of_memory(kind: Column, message: Column) -> Column:
    return F.coalesce(kind == "OutOfMemoryError", F.lit(False)) | F.lower(or_empty(message)).contains("out of memory")


def instruction_for(input_type: Column, given: Column, default: str) -> Column:
    """Only queries have one: the given one, or the default if that is empty."""
    return F.when(input_type == "query", F.coalesce(F.nullif(given, F.lit("")), F.lit(default))).otherwise("")


def formatted(text: Column, input_type: Column, instruction: Column) -> Column:
    return F.when(input_type == "query", F.concat(F.lit("Instruct: "), instruction, F.lit("\nQuery:"), text)).otherwise(text)


def normalised(text: Column, form: str = "NFKC") -> Column:
    """A Unicode normal form; ASCII texts have none but their own and stay in the JVM."""

    @F.pandas_udf("string")
    def normal(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, text).otherwise(normal(F.when(~plain, text)))


def shown(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)
