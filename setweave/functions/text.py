"""Token functions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every Unicode white space, as a character class body that Java and RE2 both read.
WHITE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: What a token drops: all but letters, numbers and the underscore (white space stays until the split).
DROPPED = r"[^\p{L}\p{N}_" + WHITE + r"]+"
BLANK = "[" + WHITE + "]+"


def tokens(text: Column) -> Column:
    """Lower-cased tokens of a text in order, repeats kept; a null text has none."""
    clean = F.lower(F.regexp_replace(text, F.lit(DROPPED), F.lit("")))
    return F.coalesce(F.array_remove(F.split(clean, BLANK), ""), F.array().cast("array<string>"))


def token_hashes(text: Column) -> Column:
    """64-bit hashes of the tokens, in order."""
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def hash_set(hashes: Column) -> Column:
    """Sorted distinct members."""
    return F.sort_array(F.array_distinct(hashes))


def sql_tokens(text: str) -> str:
    """The same tokens as a DuckDB expression."""
    return f"[x for x in regexp_split_to_array(lower(regexp_replace(coalesce({text}, ''), '{DROPPED}', '', 'g')), '{BLANK}') if x <> '']"


def graph_name(name: Column) -> Column:
    """A file name without what follows its first point, and without a trailing _adj and what follows that."""
    return F.substring_index(F.substring_index(name, ".", 1), "_adj", 1)


def slug(name: Column) -> Column:
    """Lower-case letters and digits of ASCII, anything else one underscore, none at the ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def plain_number(text: Column) -> Column:
    """A number written with thousands separators; null where it is none."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def ceil_to(value: Column, digits: int = 2) -> Column:
    """Rounded up to so many decimals."""
    return F.ceil(value * 10**digits) / F.lit(10**digits)


def json_field(text: Column, path: str, default: str) -> Column:
    """A field of a JSON text by its path, the default where the text or the field is missing or broken."""
    return F.coalesce(F.get_json_object(text, path), F.lit(default))
