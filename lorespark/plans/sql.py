"""DuckDB fragments that mirror the column functions, for the oracle's SQL."""

from __future__ import annotations

WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_’''-]*[\p{L}\p{N}_])?"
SEARCH_TOKEN = r"[a-zA-Z0-9]+(?:[''’-][a-zA-Z0-9]+)?"


def casefold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def normalise_key(x: str) -> str:
    return squeeze(f"regexp_replace(replace({casefold(x)}, '’', ''''), '[^\\p{{L}}\\p{{N}}_\\s''-]', ' ', 'g')")


def stable_id(prefix: str, *parts: str, normalise: bool = True) -> str:
    keys = [normalise_key(f"({p})::VARCHAR") if normalise else f"({p})::VARCHAR" for p in parts]
    return f"('{prefix}_' || substr(sha256(concat_ws(chr(31), {', '.join(keys)})), 1, 16))"


def word_count(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{WORD}'))::BIGINT"


def search_tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{SEARCH_TOKEN}'), lambda t: replace(lower(t), '’', ''''))"


def html_to_text(x: str) -> str:
    bare = f"regexp_replace({x}, '<(?:script|style)[^>]*>.*?</(?:script|style)>', '', 'gis')"
    spaced = f"regexp_replace(regexp_replace({bare}, '<[^>]+>', ' ', 'g'), '[ \\t]+', ' ', 'g')"
    return f"trim(regexp_replace({spaced}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))"
