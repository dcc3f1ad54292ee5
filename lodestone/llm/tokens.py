"""Token ids of a byte-level BPE, for texts of any shape."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import tiktoken

#: The id that ends every document.
END_ID = 0

#: The pattern engine keeps a state for each blank of a run, and gives up beyond a million.
LONG_RUN = 100_000
#: The code points that `\\s` of the pre-token pattern matches.
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str, special_tokens: tuple[tuple[str, int], ...] = ()) -> tiktoken.Encoding:
    """A byte-level BPE; strings of special tokens in a text are those tokens, whatever surrounds them."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(ranks_path).read_bytes().splitlines())}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special_tokens))


def added_tokens(json_path: str) -> tuple[tuple[str, int], ...]:
    """The added tokens of a vocabulary in the form of `tokenizers`, with their ids."""
    added = json.loads(Path(json_path).read_text())["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
        raise ValueError("added tokens must be matched as they are")
    return tuple((t["content"], t["id"]) for t in added)


def token_ids(ranks_path: str, pattern: str, special_tokens: tuple[tuple[str, int], ...] = ()) -> Callable[[str | None], list[int]]:
    """A function from a text to its ids and END_ID; null is an empty text.

    Runs of white space of LONG_RUN and more are cut out before the pattern sees the
    text.  It takes a run as one pre-token, but for its last blank where something
    other than a special token follows; that blank begins the next one.
    """
    encoding = encoder(ranks_path, pattern, special_tokens)
    specials = tuple(content for content, _ in special_tokens)

    def plain(text: str) -> list[int]:
        return encoding.encode(text, allowed_special="all") if specials else encoding.encode_ordinary(text)

    def ids(text: str | None) -> list[int]:
        if not text:
            return [END_ID]
        out: list[int] = []
        at = 0
        if len(text) >= LONG_RUN:
            for run in _SPACES.finditer(text):
                if run.end() - run.start() >= LONG_RUN:
                    end = run.end() if run.end() == len(text) or specials and text.startswith(specials, run.end()) else run.end() - 1
                    out += plain(text[at : run.start()])
                    out += encoding._encode_single_piece(text[run.start() : end])
                    at = end
        out += plain(text[at:])
        out.append(END_ID)
        return out

    return ids
