"""Text, hash and map functions: Column to Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: languages and their extensions
LANGUAGES = {
    "go": (".go",),
    "python": (".py",),
    "javascript": (".js", ".jsx"),
    "typescript": (".ts", ".tsx"),
    "java": (".java",),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".hpp", ".cc", ".cxx", ".hxx"),
    "rust": (".rs",),
    "ruby": (".rb",),
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def language(path: Column) -> Column:
    """By extension; '' if it is unknown."""
    known = F.create_map(*[F.lit(x) for name, ends in LANGUAGES.items() for end in ends for x in (end, name)])
    return F.coalesce(F.element_at(known, extension(path)), F.lit(""))


def languages(spark: SparkSession) -> DataFrame:
    """(language), each once."""
    return spark.createDataFrame([(name,) for name in LANGUAGES], "language string").distinct()


def line_count(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(text, "\n", -1)))


def truncate(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def leading_space(line: Column) -> Column:
    return F.regexp_extract(line, r"^([ \t]*)", 1)


def lines_between(text: Column, first: Column | int, last: Column | int) -> Column:
    """Lines first to last, from 1, inclusive."""
    first, last = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    return F.array_join(F.slice(F.split(text, "\n", -1), first, last - first + 1), "\n")


def dedent(text: Column) -> Column:
    """Without the indent that all lines that aren't blank share."""
    lines = F.split(text, "\n", -1)
    least = F.array_min(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.length(leading_space(x))))
    least = F.coalesce(least, F.lit(0))
    return F.array_join(F.transform(lines, lambda x: F.substr(x, F.least(least, F.length(leading_space(x))) + 1)), "\n")


def numbered(text: Column, start: int = 1) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x, i: F.format_string("%3d | %s", i + start, x)), "\n")


def unquote(text: Column) -> Column:
    return F.replace(text, F.lit("''"), F.lit("'"))


def chunk_id(path: Column, start_line: Column, end_line: Column, start_byte: Column, end_byte: Column) -> Column:
    return F.sha2(F.concat_ws(":", path, *[c.cast("string") for c in (start_line, end_line, start_byte, end_byte)]), 256)


def document_id(path: Column) -> Column:
    return F.sha2(path, 256)


def checksum(*parts: Column) -> Column:
    """CRC32 (IEEE) of the parts laid end to end."""
    return F.crc32(F.concat(*[F.coalesce(p, F.lit("")).cast("binary") for p in parts]))


def bucket_path(bucket: Column) -> Column:
    h = F.sha2(bucket, 256)
    return F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2), h)


def block_location(text: Column) -> Column:
    """'offset:size' as a struct of two longs."""
    return F.struct(F.split_part(text, F.lit(":"), F.lit(1)).cast("long").alias("offset"), F.split_part(text, F.lit(":"), F.lit(2)).cast("long").alias("size"))


def user_metadata(headers: Column, prefix: str = "X-Amz-Meta-") -> Column:
    """Entries of map<string, array<string>> whose key has the prefix (in any case): the rest of the key and the first value."""
    mine = F.map_filter(headers, lambda k, v: F.lower(k).startswith(prefix.lower()) & (F.size(v) > 0))
    return F.transform_values(F.transform_keys(mine, lambda k, v: F.substr(k, F.lit(len(prefix) + 1))), lambda k, v: F.element_at(v, 1))


def with_entries(metadata: Column, **entries: Column) -> Column:
    """metadata with entries, which win over its own."""
    own = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*entries))
    return F.map_concat(own, F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v.cast("string"))]))


def scalars(columns: dict[str, Column], types: dict[str, str]) -> Column:
    """A map of strings: scalars as they are, arrays, maps and structs as JSON; null columns leave no entry."""
    nested = ("array", "map", "struct")
    values = {c: F.to_json(v) if types[c].startswith(nested) else v.cast("string") for c, v in columns.items()}
    return F.map_filter(F.create_map(*[x for c, v in values.items() for x in (F.lit(c), v)]), lambda k, v: v.isNotNull())


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")
