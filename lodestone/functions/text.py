"""String, path and expression scalars as column expressions, built from Spark's own functions but for Unicode decomposition."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that a path component can't hold, and what replaces them by default.
RESERVED = '<>:"/\\|?*'
#: Cover kinds by priority.
COVER_KINDS = (
    "front", "back", "booklet", "medium", "tray", "obi", "spine", "track", "liner",
    "sticker", "poster", "watermark", "raw/unedited", "matrix/runout", "top", "bottom", "panel", "other",
)
UNKNOWN_KIND = 100
#: Names of cover providers and their aliases.
COVER_PROVIDERS = {
    "caa_release": ("caa_release", "cover_art_archive", "cover art archive"),
    "url_relationships": ("url_relationships", "allowed_cover_art_urls", "allowed cover art urls", "urlrels"),
    "caa_release_group": ("caa_release_group", "cover_art_archive_release_group", "cover art archive: release group"),
    "local_files": ("local_files", "local files"),
}
DEFAULT_PROVIDERS = ("caa_release", "url_relationships", "caa_release_group")


def stripped(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return text.rlike(r"(?U)^\s*$")


def blank_to_null(text: Column) -> Column:
    return F.nullif(stripped(text), F.lit(""))


def first_non_empty(*texts: Column) -> Column:
    return F.coalesce(*map(blank_to_null, texts))


def join_unique(values: Column) -> Column:
    """Trimmed, non-empty values in the order they first occur, joined by `; `."""
    return F.array_join(F.array_distinct(F.filter(F.transform(values, stripped), lambda x: x != "")), "; ")


def credit_text(credits: Column) -> Column:
    """Names with their join phrases, of an array of (name, phrase); null if blank."""
    return blank_to_null(F.aggregate(credits, F.lit(""), lambda s, x: F.concat(s, x["name"], F.coalesce(x["phrase"], F.lit("")))))


def identifier(text: Column) -> Column:
    """Lower-case letters and digits, all else an underscore; `default` for nothing."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(text), "[^a-z0-9]", "_"), F.lit("")), F.lit("default"))


def tool_identifier(text: Column) -> Column:
    return F.translate(text, RESERVED, "_" * len(RESERVED))


def metadata_key(text: Column) -> Column:
    """Lower-case letters and digits with single underscores between; `metadata` for nothing, `meta_` before a digit."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", "_")), "_+", "_"), "^_|_$", "")
    return F.when(key == "", "metadata").when(key.rlike("^[0-9]"), F.concat(F.lit("meta_"), key)).otherwise(key)


def environment_name(prefix: str, tool: Column, key: Column) -> Column:
    """PREFIX_TOOL_OS of a key `os/file`, with _DIR for a key `os/`."""
    os_, rest = F.substring_index(key, "/", 1), F.regexp_extract(key, "^[^/]*/(.*)$", 1)
    return F.concat(F.lit(f"{prefix}_"), F.upper(tool), F.lit("_"), F.upper(os_), F.when(rest == "", "_DIR").otherwise(""))


def escape_xml(text: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


@F.pandas_udf(StringType())
def decomposed(text: pd.Series) -> pd.Series:
    """Text in canonical decomposition (NFD), so that a letter with its accent is one string however it was typed; ASCII stays as it is."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFD", t))


def sanitized(component: Column, replacements: dict[str, str] | None = None) -> Column:
    """A path component, decomposed, with characters replaced one by one; replacements extend or change the defaults."""
    table = dict.fromkeys(RESERVED, "_") | (replacements or {})
    return F.translate(decomposed(component), "".join(table), "".join(table.values()))


def valid_component(component: Column) -> Column:
    """Not empty, free of reserved characters, neither `.` nor `..`, and decomposed."""
    return component.rlike('^[^<>:"/\\\\|?*]+$') & ~component.isin(".", "..") & (component == decomposed(component))


def normalized_path(path: Column) -> Column:
    """The path without `.` and empty components; null if that is empty, absolute, or holds `..`."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    bad = path.startswith("/") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def ancestors(path: Column) -> Column:
    """The path itself and every path above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def is_under(path: Column, prefix: Column) -> Column:
    return path.startswith(F.concat(prefix, F.lit("/")))


def excluded_from_scan(name: Column, prefix: Column, reserved: list[str]) -> Column:
    """Hidden names anywhere, and reserved names at the root."""
    return name.startswith(".") | ((prefix == "") & name.isin(reserved))


def relative_path(source: Column, target: Column) -> Column:
    """The path from the folder of file `source` to `target`."""
    a, b = F.split(source, "/"), F.split(target, "/")
    folder = F.slice(a, 1, F.size(a) - 1)
    same = F.aggregate(
        F.arrays_zip(folder.alias("x"), F.slice(b, 1, F.size(b) - 1).alias("y")), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")),
        lambda s, p: F.struct((s["n"] + F.when(s["go"] & p["x"].eqNullSafe(p["y"]), 1).otherwise(0)).alias("n"), (s["go"] & p["x"].eqNullSafe(p["y"])).alias("go")),
        lambda s: s["n"],
    )
    up = F.array_repeat(F.lit(".."), F.size(folder) - same)
    return F.array_join(F.concat(up, F.slice(b, same + 1, F.size(b))), "/")


def normalized_uri(uri: Column) -> Column:
    """A short video link as its long form, with its time; any other URI as it is."""
    host, path, time = F.lower(F.parse_url(uri, F.lit("HOST"))), F.parse_url(uri, F.lit("PATH")), F.parse_url(uri, F.lit("QUERY"), F.lit("t"))
    long = F.concat(F.lit("https://www.youtube.com/watch?v="), F.substr(path, F.lit(2)), F.coalesce(F.concat(F.lit("&t="), time), F.lit("")))
    return F.when(host == "youtu.be", long).otherwise(uri)


def media_id(uri: Column, digest: Column) -> Column:
    """The host with dashes and the first 12 digits of the URI's hash; a local one's path."""
    host = F.replace(F.regexp_replace(F.coalesce(F.parse_url(uri, F.lit("HOST")), F.lit("unknown")), "^(www\\.)+", ""), F.lit("."), F.lit("-"))
    return F.when(uri.startswith("local:"), F.substr(uri, F.lit(7))).otherwise(F.concat(host, F.lit("."), F.substring(digest, 1, 12)))


def extension(path: Column) -> Column:
    """`.ext` of the last component, `.bin` without one."""
    found = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    return F.when(found != "", F.concat(F.lit("."), found)).otherwise(".bin")


def archive_format(url: Column) -> Column:
    """zip, tar.gz, tar.xz or null, by the URL's last component without its query."""
    name = F.substring_index(F.rtrim(F.substring_index(url, "?", 1), F.lit("/")), "/", -1)
    return F.when(name.endswith(".tar.xz"), "tar.xz").when(name.endswith(".tar.gz") | name.rlike(r"(?i).\.tgz$"), "tar.gz").when(name.rlike(r"(?i).\.zip$") | (name == "zip"), "zip")


def duration_text(seconds: Column) -> Column:
    """42s, 1m35s, 12m, 2h15m, 1d8h."""
    s, m, h, d = seconds % 60, F.floor(seconds / 60) % 60, F.floor(seconds / 3600) % 24, F.floor(seconds / 86400)
    two = lambda a, x, b, y: F.concat(a.cast("string"), F.lit(x), F.when(b > 0, F.concat(b.cast("string"), F.lit(y))).otherwise(""))
    return F.when(seconds < 60, F.concat(s.cast("string"), F.lit("s"))).when(seconds < 3600, two(m, "m", s, "s")).when(d == 0, two(h, "h", m, "m")).otherwise(two(d, "d", h, "h"))


def rate_text(rate: Column) -> Column:
    """3.5/s, 42/s, 1.2k/s, 3.5M/s, and per minute, hour or day below one."""
    one = lambda x, unit: F.when(x < 10, F.format_string("%.1f" + unit, x)).otherwise(F.format_string("%.0f" + unit, x))
    whole = lambda x, unit: F.format_string("%.0f" + unit, x)
    return F.when(rate >= 1e6, one(rate / 1e6, "M/s")).when(rate >= 1e3, one(rate / 1e3, "k/s")).when(rate >= 1, one(rate, "/s")).when(rate * 60 >= 1, whole(rate * 60, "/m")).when(rate * 3600 >= 1, whole(rate * 3600, "/h")).otherwise(whole(rate * 86400, "/d"))


def metadata_tags(document: Column) -> Column:
    """An ffmetadata document's global tags as a map: lines up to the first section, without comments and blanks."""
    lines = F.transform(F.split(document, "\n"), lambda x: F.trim(x))
    section = F.array_position(F.transform(lines, lambda x: x.startswith("[")), True)
    head = F.when(section > 0, F.slice(lines, 1, (section - 1).cast("int"))).otherwise(lines)
    plain = lambda x: F.trim(F.regexp_replace(x, r"\\(.)", "$1"))
    pairs = F.transform(F.filter(head, lambda x: ~x.startswith(";") & x.contains("=")), lambda x: F.struct(plain(F.substring_index(x, "=", 1)).alias("k"), plain(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != "")))


def deterministic(template: Column) -> Column:
    """Whether a command part depends on neither environment, platform nor files."""
    return ~(template.contains("${env.") | template.contains("context.os") | template.contains(":file(") | template.contains(":folder("))


def placeholder_keys(template: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(template, F.lit(r"\$\{media\.metadata\.([^}]+)\}"), F.lit(1))))


def interpolated(template: Column, values: dict[str, Column]) -> Column:
    """`${key}` replaced by values; null if one of those in it is null."""
    out, missing = template, F.lit(False)
    for key, value in values.items():
        mark = f"${{{key}}}"
        missing = missing | (template.contains(mark) & value.isNull())
        out = F.replace(out, F.lit(mark), F.coalesce(value, F.lit("")))
    return F.when(~missing, out)


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regex: * and ? stop at a slash."""
    return "^" + "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) if c in ".+^$()|[]{}\\" else c for c in pattern) + "$"


def transformed(content: Column, entry: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Content after numbered rules (glob, find, replace), each where the entry's name matches."""
    for glob, find, replace in rules:
        content = F.when(entry.rlike(glob_regex(glob)), F.regexp_replace(content, find, replace)).otherwise(content)
    return content


def compared(left: Column, operator: str, right: Column) -> Column:
    """A string comparison of the template language."""
    return {"==": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[operator]


def version_matches(spec: list[Column], resolved: list[Column]) -> Column:
    """Each field that the spec has equals the resolved one; a spec without any field matches nothing."""
    some = F.coalesce(*spec).isNotNull()
    for s, r in zip(spec, resolved, strict=True):
        some = some & (s.isNull() | s.eqNullSafe(r))
    return some


def cover_priority(kind: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, COVER_KINDS)), kind)
    return F.when(at > 0, at - 1).otherwise(UNKNOWN_KIND)


def cover_kinds(expression: Column) -> Column:
    """The kinds that a list of kinds, `all` and `-kind` or `!kind` selects, sorted; unknown kinds are dropped."""
    every = F.array_sort(F.array(*map(F.lit, COVER_KINDS)))
    tokens = F.filter(F.transform(F.split(expression, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    plain = lambda x: F.trim(F.regexp_replace(x, "^[-!]+", ""))
    excluded = F.transform(F.filter(tokens, lambda x: x.rlike("^[-!]")), plain)
    included = F.filter(tokens, lambda x: ~x.rlike("^[-!]") & ~x.isin("all", "*"))
    all_ = F.exists(tokens, lambda x: plain(x).isin("all", "*")) | (F.size(included) == 0)
    return F.array_sort(F.array_except(F.when(all_, every).otherwise(F.array_intersect(included, every)), excluded))


def cover_providers(expression: Column) -> Column:
    """Providers by alias in the order first named; the default ones for none."""
    alias = F.create_map(*[F.lit(x) for name, names in COVER_PROVIDERS.items() for a in names for x in (a, name)])
    tokens = F.filter(F.transform(F.split(expression, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    named = F.array_distinct(F.transform(tokens, lambda x: alias[x]))
    return F.when(F.size(named) > 0, named).otherwise(F.array(*map(F.lit, DEFAULT_PROVIDERS)))


def best_cover_url(image: Column, thumbnails: Column, preferred: list[list[str]]) -> Column:
    """A URL of the preferred sizes, each list of keys in turn; else the largest, then the last by name."""
    score = lambda k: F.coalesce(k.try_cast("int"), F.when(F.lower(k) == "large", 1200).when(F.lower(k) == "small", 250).otherwise(0))
    sized = F.transform(F.map_entries(thumbnails), lambda e: F.struct(score(e["key"]).alias("s"), blank_to_null(e["value"]).alias("u")))
    every = F.filter(F.concat(F.array(F.struct(F.lit(2147483647).alias("s"), blank_to_null(image).alias("u"))), sized), lambda x: x["u"].isNotNull())
    return F.coalesce(*[blank_to_null(thumbnails[k]) for keys in preferred for k in keys], F.array_max(every)["u"])


def alternating_pairs(values: Column) -> Column:
    """An alternating list of keys and values as an array of pairs; null for odd lengths, empty or repeated keys."""
    n = F.floor(F.size(values) / 2).cast("int")
    pairs = F.when(n == 0, F.array().cast("array<struct<k:string,v:string>>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.trim(F.get(values, 2 * i - 2)).alias("k"), F.get(values, 2 * i - 1).alias("v"))))
    keys = F.transform(pairs, lambda p: p["k"])
    bad = (F.size(values) % 2 == 1) | F.array_contains(keys, "") | (F.size(F.array_distinct(keys)) < F.size(keys))
    return F.when(~bad, pairs)


def whole_number(value: Column) -> Column:
    """A double as a long if it is a whole number of at least zero, else null."""
    return F.when((value >= 0) & (value == F.floor(value)), value.cast("long"))


def exit_ok(code: Column, allowed: Column) -> Column:
    return (F.size(allowed) == 0) | F.array_contains(allowed, code)


def desktop_link(content: Column, marker: str) -> Column:
    """A link file with its `Name=` lines cleaned of the download folder, the marker and escaped spaces."""
    clean = lambda x: F.replace(F.replace(F.regexp_replace(x, "^(downloads/)+", ""), F.lit(marker), F.lit("")), F.lit("\\s"), F.lit(" "))
    line = lambda x: F.when(x.startswith("Name="), F.concat(F.lit("Name="), clean(F.substr(x, F.lit(6))))).otherwise(x)
    return F.array_join(F.transform(F.split(content, "\n"), line), "\n")


def sandbox_member(path: Column, marker: str) -> Column:
    """A member's path without the download folder and the marker, with forward slashes."""
    return F.replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^downloads/", ""), F.lit(marker), F.lit(""))


def os_selector(choices: list[tuple[str, str]]) -> str:
    """A template that picks by platform; the last choice stands for all others."""
    out = choices[-1][1]
    for name, value in reversed(choices[:-1]):
        out = f'${{context.os == "{name}" ? {value} : {out}}}'
    return out


def argument_problem(given: Column, known: list[str], required: list[str], non_empty: list[str], context: str) -> Column:
    """The first rule that a map of arguments breaks, null if none: unknown keys, then missing ones, then blank ones."""
    unknown = F.array_sort(F.array_except(F.map_keys(given), F.array(*map(F.lit, known)).cast("array<string>")))
    problem = F.when(F.size(unknown) > 0, F.concat(F.lit(f"{context} does not accept arg '"), F.get(unknown, F.lit(0)), F.lit("'")))
    for key in [*required, *non_empty]:
        problem = problem.when(~F.map_contains_key(given, key), f"{context} requires '{key}'")
        if key in non_empty:
            problem = problem.when(is_blank(F.element_at(given, key)), f"{context} requires non-empty '{key}'")
    return problem
