"""Byte-level BPE ids of texts: the vocabulary file's ids, encoded on the executors in Arrow batches."""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes with the ranks of the same name where that file lies beside the JSON one (about four times as fast and
    the same ids), else with the JSON file itself. Strings of special tokens inside a text are ordinary text, or with
    special their own ids, as the JSON file by itself has it."""

    def __init__(self, path: str, special: bool = False):
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        self.tokenizer = self.ranks = None
        if path.endswith(".json") and os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            own = _special_tokens(path) if special else {}
            self.ranks = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=own)
            self.special = tuple(own)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.encode_special_tokens = not special

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.ranks:
            if any(x in text for x in self.special):
                return self.ranks.encode(text, allowed_special="all")
            return self.ranks.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


def _special_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as file:
        return {x["content"]: x["id"] for x in json.load(file).get("added_tokens", []) if x["special"]}


@lru_cache(maxsize=4)
def encoder(path: str, special: bool = False) -> Encoder:
    return Encoder(path, special)


def vocabulary_size(path: str) -> int:
    with open(path, encoding="utf-8") as file:
        return len(json.load(file)["model"]["vocab"])
