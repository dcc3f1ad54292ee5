"""Look-ups in JSON documents whose shape isn't known beforehand."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import is_blank

#: Keys that stand in for another one, in order.
ALIASES = {"artist": ("uploader", "channel", "track_artist"), "title": ("track",)}
MOST_ENTRIES, MOST_CHARS = 1024, 4096


def _text_of(object_: object, key: str) -> tuple[bool, str | None]:
    """The value of the first key that equals `key` whatever the case: whether there is one that is text, and it."""
    if isinstance(object_, dict):
        for k, v in object_.items():
            if k.lower() == key.lower():
                return isinstance(v, str), v if isinstance(v, str) else None
    return False, None


def _direct(document: dict, key: str) -> str | None:
    container = document.get("format")
    places = [container, container.get("tags") if isinstance(container, dict) else None]
    streams = document.get("streams")
    for stream in streams if isinstance(streams, list) else []:
        places += [stream, stream.get("tags") if isinstance(stream, dict) else None]
    for place in [*places, document]:
        found, value = _text_of(place, key)
        if found:
            return value
    return None


def find_text(document: str | None, key: str) -> str | None:
    """A key's text: in format, its tags, each stream and its tags, the root; then its aliases'."""
    try:
        parsed = json.loads(document or "")
    except (ValueError, RecursionError):
        return None
    if not isinstance(parsed, dict):
        return None
    for k in (key, *ALIASES.get(key, ())):
        if (value := _direct(parsed, k)) is not None:
            return value
    return None


def metadata_value(document: Column, key: str) -> Column:
    @F.pandas_udf("string")
    def apply(documents: pd.Series) -> pd.Series:
        return documents.map(lambda d: find_text(d, key))

    return apply(document)


def flatten_json(document: str | None) -> list[tuple[str, str]]:
    """Scalars by path with sorted keys; arrays of scalars joined by `; `, other arrays by index."""
    out: list[tuple[str, str]] = []

    def text(v: object) -> str:
        return v if isinstance(v, str) else json.dumps(v)

    def walk(path: str, v: object) -> None:
        if len(out) >= MOST_ENTRIES or v is None:
            return
        if isinstance(v, dict):
            for k in sorted(v):
                walk(f"{path}_{k}" if path else k, v[k])
        elif isinstance(v, list) and not any(isinstance(x, (dict, list)) for x in v):
            out.append((path, "; ".join(text(x) for x in v if x is not None)))
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(f"{path}_{i}", x)
        else:
            value = text(v)
            out.append((path, value[:MOST_CHARS] if len(value.encode()) > MOST_CHARS else value))

    try:
        walk("", json.loads(document or ""))
    except (ValueError, RecursionError):
        return []
    return out


def flattened(document: Column) -> Column:
    """A document's scalars as an array of (key, value)."""

    @F.pandas_udf("array<struct<key:string,value:string>>")
    def apply(documents: pd.Series) -> pd.Series:
        return documents.map(lambda d: [{"key": k, "value": v} for k, v in flatten_json(d)])

    return apply(document)


def resolved_value(candidates: list[Column]) -> Column:
    """The first candidate that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in candidates])


#: Further tags and the flattened entries that fill them, where there is one and the tag isn't set yet.
FURTHER_TAGS = {
    "albumartistsort": "musicbrainz_release_artist_credit_0_artist_sort_name",
    "artistsort": "musicbrainz_recording_artist_credit_0_artist_sort_name",
    "artistcredit": "artist",
    "albumartistcredit": "albumartist",
    "releasestatus": "musicbrainz_release_status",
    "releasetype": "musicbrainz_release_release_group_primary_type",
    "secondaryreleasetype": "musicbrainz_release_release_group_secondary_types",
    "primaryreleasetype": "musicbrainz_release_release_group_primary_type",
    "releasegroup": "musicbrainz_release_release_group_title",
    "musicbrainz_releasegroupid": "musicbrainz_release_release_group_id",
    "musicbrainz_artistid": "musicbrainz_recording_artist_credit_0_artist_id",
    "musicbrainz_albumartistid": "musicbrainz_release_artist_credit_0_artist_id",
    "recordingtitle": "musicbrainz_recording_title",
    "recordingcomment": "musicbrainz_recording_disambiguation",
    "releasecomment": "musicbrainz_release_disambiguation",
    "releasegroupcomment": "musicbrainz_release_release_group_disambiguation",
    "releaselanguage": "musicbrainz_release_text_representation_language",
    "script": "musicbrainz_release_text_representation_script",
    "releaseannotation": "musicbrainz_release_annotation",
    "recordingannotation": "musicbrainz_recording_annotation",
    "releasedate": "date",
    "releasecountry": "musicbrainz_release_country",
    "media": "musicbrainz_release_media_0_format",
    "asin": "musicbrainz_release_asin",
}


def bounded_value(value: Column) -> Column:
    """A value as it is up to MOST_CHARS bytes of UTF-8, else its first MOST_CHARS characters."""
    return F.when(F.octet_length(value) <= MOST_CHARS, value).otherwise(F.substring(value, 1, MOST_CHARS))


def tag_map(known: dict[str, Column], flat: Column | None = None) -> Column:
    """A map of tags: the known ones that aren't null, and FURTHER_TAGS from them or from a map of flattened entries.

    A further tag is set where no known one has its name and its value isn't blank; it is bounded.
    """
    none = F.lit(None).cast("string")
    tags = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, known)), F.array(*known.values())), lambda _, v: v.isNotNull())
    if flat is None:
        return tags
    source = lambda key: F.coalesce(known.get(key, none), F.element_at(flat, key))
    more = {tag: bounded_value(F.when(~is_blank(source(key)), source(key))) for tag, key in FURTHER_TAGS.items()}
    names = F.array(*map(F.lit, more))
    further = F.map_filter(F.map_from_arrays(names, F.array(*more.values())), lambda k, v: v.isNotNull() & ~F.array_contains(F.map_keys(tags), k))
    return F.map_concat(tags, further)
