"""What token counting and token files share: tokenizer files, splitting without the library, worker caches."""

from __future__ import annotations

import gc
import json
import re
import sys
import unicodedata
from collections.abc import Callable
from types import ModuleType
from typing import Any

#: Characters below this code point are handled without the library: they are in composed form, have
#: one-to-one lower case (but for the one below) and categories that no Unicode version changed.
PLAIN_LIMIT = 0x180
NOT_PLAIN = re.compile(f"[^\x00-\x1b -įı-{chr(PLAIN_LIMIT - 1)}]")


def category_class(major: str) -> str:
    """The plain characters of a general category, for use inside brackets."""
    return "".join(re.escape(chr(c)) for c in range(PLAIN_LIMIT) if unicodedata.category(chr(c))[0] == major)


LETTER, NUMBER = category_class("L"), category_class("N")
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"


def read_tokenizer(path: str) -> str:
    """A tokenizer file's content; the driver reads it and tasks get it as a broadcast value.

    Its size is that of one vocabulary, whatever the data.
    """
    with open(path, encoding="utf-8") as file:
        return file.read()


def added_strings(content: str) -> list[str]:
    return [t["content"] for t in json.loads(content)["added_tokens"]]


def byte_letters() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, inverted."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def per_process(key: str, make: Callable[[], Any]) -> Any:
    """A value that a Python worker keeps from task to task. Losing it only costs time."""
    holder = sys.modules.setdefault("_stowage_worker_values", ModuleType("_stowage_worker_values"))
    if key not in vars(holder):
        setattr(holder, key, make())
    return getattr(holder, key)


def forget(key: str) -> None:
    """Frees a value of ``per_process``, if the worker has it."""
    holder = sys.modules.get("_stowage_worker_values")
    if holder is not None and vars(holder).pop(key, None) is not None:
        gc.collect()  # a cache may refer to its owner


class Filled(dict):
    """A dictionary that computes missing values and keeps them until it has ``most`` entries."""

    def __init__(self, compute: Callable[[str], Any], most: int, known: dict | None = None):
        super().__init__(known or {})
        self.compute, self.most = compute, most

    def __missing__(self, key: str) -> Any:
        value = self.compute(key)
        if len(self) < self.most and len(key) < 200:
            self[key] = value
        return value
