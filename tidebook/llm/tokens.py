"""Token ids from public vocabulary files, inside tasks."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from functools import lru_cache

#: The pre-tokenizer's pattern of the byte-level vocabularies (a fixed value of theirs).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs that the matcher of the ranks can't take (its stack ends at some hundred thousand characters of white space).
LONG_RUN = re.compile(r"\s{5000}|\S{100000}")


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], list[int]]:
    """The function that turns a text into ids, as tokenizers' encode(text, add_special_tokens=False) does.

    path: a *.json file of the tokenizers library, or a *.tiktoken file of ranks with the *.json file of the same name
    beside it. The ranks are several times faster and give the same ids: the special strings of the JSON file have
    their own ids in a text, and a text with a very long run of one kind is encoded by the JSON file. One worker process
    loads a file once.
    """
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda text: t.encode(text, add_special_tokens=False).ids
    import tiktoken

    beside = path.removesuffix(".tiktoken") + ".json"
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    with open(beside, encoding="utf-8") as f:
        special = {a["content"]: a["id"] for a in json.load(f)["added_tokens"]}
    e = tiktoken.Encoding(path, pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks={b: r for b, r in ranks.items() if r not in special.values()}, special_tokens=special)

    def encode(text: str) -> list[int]:
        if len(text) >= 5000 and LONG_RUN.search(text):
            return encoder(beside)(text)
        return e.encode(text, allowed_special="all") if "<|" in text else e.encode_ordinary(text)

    return encode
