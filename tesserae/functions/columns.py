"""Column functions on strings, dates, maps and JSON. All are built-in expressions but ``decode``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters that keyword normalisation folds, and what they become.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyy"


def truthy(c: Column) -> Column:
    """The string, or null where it is empty."""
    return F.nullif(c.cast("string"), F.lit(""))


def join_truthy(*cols: Column, by: str = " ") -> Column:
    """The non-empty strings joined; an empty string if there is none."""
    return F.concat_ws(by, *[truthy(c) for c in cols])


def shown(c: Column, null_text: str = "None") -> Column:
    """The value as it is printed inside a label text, with ``null_text`` for null."""
    return F.coalesce(c.cast("string"), F.lit(null_text))


def shown_price(c: Column, null_text: str = "None") -> Column:
    """A decimal printed as a float: at least one decimal place, never in exponent form."""
    return F.coalesce(F.regexp_replace(c.cast("decimal(12,2)").cast("string"), r"0$", ""), F.lit(null_text))


def normalize_keyword(c: Column) -> Column:
    """Lower case, accents folded."""
    return F.translate(F.lower(c), ACCENTED, FOLDED)


def ignore_above(c: Column, most: int = 256) -> Column:
    return F.when(F.length(c) <= most, c)


def parse_time(c: Column) -> Column:
    """A timestamp from an ISO date-time, epoch milliseconds, or ``yyyy-MM-dd HH:mm:ss``; null otherwise."""
    text = c.cast("string")
    iso = F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d"), F.try_to_timestamp(text))
    millis = F.when(text.rlike(r"^-?\d{1,16}$"), F.timestamp_millis(text.try_cast("bigint")))
    plain = F.when(text.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.coalesce(iso, millis, plain)


def date_text(c: Column) -> Column:
    return c.cast("string")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def preview(c: Column, most: int = 10) -> Column:
    """Without tags, cut to ``most`` characters with ``...`` after a cut."""
    bare = strip_tags(F.coalesce(c, F.lit("")))
    return F.when(F.length(bare) > most, F.concat(F.substring(bare, 1, most), F.lit("..."))).otherwise(bare)


def em_to_mark(c: Column) -> Column:
    return F.regexp_replace(c, "<em>(.*?)</em>", "<mark>$1</mark>")


def clean_text(c: Column) -> Column:
    """Without carriage returns, zero-width characters and what can't be printed, but for line feeds and tabs."""
    return F.regexp_replace(c, r"[\r\u200B-\u200D\uFEFF]|[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}&&[^\n\t]]|[\p{Zs}&&[^ ]]", "")


def _decode(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    marks = ((b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"), (b"\xef\xbb\xbf", "utf-8-sig"))
    for name in [n for mark, n in marks if raw.startswith(mark)] + ["utf-8", "cp950", "big5", "utf-16le", "utf-16be"]:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            pass
    return raw.decode("utf-8", "ignore")


@F.pandas_udf(T.StringType())
def decode(raw: pd.Series) -> pd.Series:
    """Bytes to text: by the byte-order mark, else the first encoding that fits."""
    return raw.map(_decode)


def convert_script(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Each character on the left of ``pairs`` replaced by the one on its right."""
    return F.translate(c, "".join(a for a, _ in pairs), "".join(b for _, b in pairs)) if pairs else c


def with_defaults(metadata: Column, defaults: dict[str, Column], forced: dict[str, Column]) -> Column:
    """A map with ``defaults`` where it lacks the key and ``forced`` in any case."""
    base = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(list(forced)))
    for k, v in defaults.items():
        base = F.when(F.map_contains_key(base, k), base).otherwise(F.map_concat(base, F.create_map(F.lit(k), v.cast("string"))))
    return F.map_concat(base, F.create_map(*[x for k, v in forced.items() for x in (F.lit(k), v.cast("string"))])) if forced else base


def field_pairs(metadata: Column, most: int = 3, width: int = 50) -> Column:
    """``key: value`` of the first ``most`` ``field_*`` entries by key, values cut to ``width``, one a line."""
    found = F.filter(F.array_sort(F.map_entries(metadata)), lambda e: e["key"].startswith("field_"))
    return F.array_join(F.slice(F.transform(found, lambda e: F.concat(e["key"], F.lit(": "), F.substring(F.coalesce(e["value"], F.lit("")), 1, width))), 1, most), "\n")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole with 2 decimals; 0 for an empty whole."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 2)).otherwise(F.lit(0.0))


def state_json(name: Column, value: Column) -> Column:
    """An aggregate: (name, value) rows as one JSON object in order of names, as a sync's state is kept."""
    return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name.cast("string").alias("k"), value.cast("string").alias("v"))))))


def state_rows(text: Column) -> Column:
    """A JSON object back as (key, value) entries; none for null or what isn't an object."""
    return F.coalesce(F.map_entries(F.from_json(text, "map<string,string>")), F.array().cast("array<struct<key: string, value: string>>"))


def document_json(df_columns: list[str]) -> Column:
    """A document as JSON; fields without a value are left out."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df_columns]))
