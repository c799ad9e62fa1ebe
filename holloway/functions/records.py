"""Attributes of survey records as Column expressions: lists in text, safe names, codes and keywords, missing values, unit changes."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Grave words, and words that only look like one.
GRAVE_WORDS = ("무덤", "분묘", "묘지", "묘역", "봉분", "고분군", "고분", "왕릉", "능묘", "가족묘", "공동묘")
NO_GRAVE = ("고분자",)
GRAVE_ENGLISH = r"\b(tombs?|graves?|burials?|cemeterys?|cemeteries)\b"
# Layer codes of topographic drawings, and the usual choices of heights.
CONTOUR_CODES = ("F0017110", "F0017111", "F0017112", "F0017113")
HEIGHT_CODES = {"modern": ("F0017111", "F0017114", "F0027217"), "legacy": ("7111", "7114", "2121", "2122")}
CODE_NAMES = {"F0017110": "contour, other", "F0017111": "index contour", "F0017112": "contour, minor", "F0017113": "contour, minor", "F0017114": "intermediate contour", "F0017115": "terrain line",
              "F0017120": "contour label", "F0027217": "spot height", "H0027311": "triangulation point", "H0027312": "bench mark", "E0011111": "stream line", "E0011112": "stream bank",
              "E0041311": "lake", "7111": "index contour", "7114": "intermediate contour", "7217": "spot height", "7132": "spot height label", "2121": "shore", "2122": "island shore"}
# Cell size in metres by map scale.
SCALE_CELLS = {1_000: 1.0, 2_500: 2.0, 5_000: 5.0, 25_000: 10.0, 50_000: 20.0}
# Field names.
HEIGHT_FIELDS = ("Z_COORD", "z_coord", "Elevation", "ELEVATION", "elev", "ELEV", "height", "HEIGHT", "표고", "고도", "z", "Z")
KEY_FIELDS = re.compile(r"^(fid|gid|id|oid|objectid|osm_id|uid|uuid|no|idx|index|seq|rank|pnu|r|g|b|component|번호|일련번호|.*_id|.*_fid|.*_no|.*_idx)$", re.IGNORECASE)
CLASS_HINTS = ("class", "type", "category", "code", "grade", "kind", "group", "zone", "use", "지목", "분류", "종류", "구분", "유형", "코드", "명칭", "등급", "용도", "구역", "구조")
# Metres of a degree by latitude, as series of cosines.
DEGREE_NORTH = (111132.92, -559.82, 1.175, -0.0023)
DEGREE_EAST = (111412.84, -93.5, 0.118)


def text_list(text: Column) -> Column:
    """The trimmed, non-empty parts of a comma-separated text."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), F.trim), lambda x: x != "")


def number_list(text: Column) -> Column:
    """The numbers of a text, parted by commas or semicolons; what is no number is left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,;]"), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())


def safe_name(name: Column, other: str = "layer") -> Column:
    """A name whose characters are letters, digits, ``-`` and ``_``."""
    base = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit(other)), r"[^\p{L}\p{N}_-]", "_"), "^_+|_+$", "")
    return F.when(base == "", F.lit(other)).otherwise(base)


def safe_file(name: Column, other: str = "layer") -> Column:
    """A file name: signs that file systems reserve and white space become ``_``."""
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r'[\\/:*?"<>|]+', "_"), r"\s+", "_"), "^_+|_+$", "")
    return F.when(base == "", F.lit(other)).otherwise(base)


def numbered_names(t: DataFrame, name: Column, order: str, out: str = "key") -> DataFrame:
    """``t`` with the safe names, the second and later of one name with the next free of _2, _3, ... A suffix is free if no other row's own
    safe name has it, so no two rows get the same name and the first of each name keeps it."""
    t = t.withColumn("__base", safe_name(name))
    # Own names that end like a suffix: they take a number from the name before it.
    ending = F.regexp_extract("__base", r"^(.*)_([1-9][0-9]{0,8})$", 2)
    taken = t.select("__base").distinct().where(ending != "").select(F.regexp_extract("__base", r"^(.*)_([1-9][0-9]{0,8})$", 1).alias("__base"), ending.cast("int").alias("k"))
    taken = taken.where("k >= 2").groupBy("__base").agg(F.array_sort(F.collect_set("k")).alias("__taken"))
    n = F.row_number().over(Window.partitionBy("__base").orderBy(order))
    numbered = t.withColumn("__n", n).join(taken, "__base", "left")
    free = F.aggregate(F.coalesce("__taken", F.array().cast("array<int>")), F.col("__n"), lambda s, k: F.when(k <= s, s + 1).otherwise(s))
    return numbered.withColumn(out, F.when(F.col("__n") == 1, F.col("__base")).otherwise(F.concat("__base", F.lit("_"), free.cast("string")))).select(*t.drop("__base").columns, out)


def code_era(code: Column) -> Column:
    return F.when(F.coalesce(code, F.lit("")).rlike("^[0-9]+$"), "legacy").otherwise("modern")


def code_name(code: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in CODE_NAMES.items() for x in kv])[code]


def of_codes(t: DataFrame, codes, field: str = "Layer") -> DataFrame:
    """The rows with one of the codes; all rows if the table has no such field."""
    return t.where(F.col(field).isin(*codes)) if field in t.columns else t


def codes_in(text: Column) -> Column:
    """The layer codes that a text cites: a capital letter and seven or eight digits, as whole words."""
    return F.regexp_extract_all(text, F.lit(r"\b([A-Z][0-9]{7,8})\b"), F.lit(1))


def speaks_of_graves(text: Column) -> Column:
    """Whether a text has a grave word: Korean ones anywhere, after words that only look so are taken out; English ones as whole words."""
    rest = text
    for w in NO_GRAVE:
        rest = F.replace(rest, F.lit(w), F.lit(""))
    return F.coalesce(rest.rlike("|".join(GRAVE_WORDS)) | F.lower(text).rlike(GRAVE_ENGLISH), F.lit(False))


def degrees_of(metres: Column, latitude: Column) -> dict[str, Column]:
    """A length in degrees of longitude and latitude at a latitude; 0 if it is not positive."""
    r = F.radians(latitude)
    north = sum(c * F.cos(2 * k * r) for k, c in enumerate(DEGREE_NORTH))
    east = sum(c * F.cos((2 * k + 1) * r) for k, c in enumerate(DEGREE_EAST))
    ok = (metres > 0) & (north > 0) & (east > 0)
    return {"lon": F.when(ok, metres / east).otherwise(0.0), "lat": F.when(ok, metres / north).otherwise(0.0)}


def same_nodata(a: Column, b: Column) -> Column:
    """Whether two no-data values are one: both missing, both nan, or equal within 1e-9."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).when(F.isnan(a) | F.isnan(b), F.isnan(a) & F.isnan(b)).otherwise(F.abs(a - b) <= 1e-9)


def finite(value: Column) -> Column:
    """A number, or null for what is none or not finite."""
    v = value.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < math.inf), v)


def made_by_tool(tool: Column, run: Column, name: Column, source: Column, prefixes: tuple[str, ...], marks: tuple[str, ...]) -> Column:
    """Whether a layer is a tool's output: by its run log entry, else by how its name begins, else by a mark in its source."""
    tagged = (F.coalesce(tool, F.lit("")) != "") | (F.coalesce(run, F.lit("")) != "")
    named = F.coalesce(name, F.lit("")).rlike("^(" + "|".join(map(re.escape, prefixes)) + ")")
    marked = F.lower(F.coalesce(source, F.lit(""))).rlike("|".join(map(re.escape, marks)))
    return tagged | named | marked


def fields_of(t: DataFrame, known: tuple[str, ...] = (), most: int = 12) -> tuple[list[str], str | None]:
    """Numeric fields worth statistics (keys and counters left out, known names first) and the string field worth a histogram."""
    numeric = [n for n, k in t.dtypes if (k in ("tinyint", "smallint", "int", "bigint", "float", "double") or k.startswith("decimal")) and not KEY_FIELDS.match(n)]
    text = [n for n, k in t.dtypes if k == "string"]
    named = next((n for n in ("class_id", "Layer", "element") if n in text), None)
    return ([n for n in known if n in numeric] + [n for n in numeric if n not in known])[:most], named or next((n for n in text if any(h in n.lower() for h in CLASS_HINTS)), None)


def height_field(t: DataFrame) -> str | None:
    """The field of heights, by its name only."""
    return next((n for n in HEIGHT_FIELDS if n in t.columns), None)


def common_fields(*tables: DataFrame) -> list[str]:
    """The fields that all tables have, in the order of the first."""
    return [c for c in tables[0].columns if all(c in t.columns for t in tables[1:])] if tables else []
