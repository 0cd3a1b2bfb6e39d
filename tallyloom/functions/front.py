"""Values of YAML front matter, read in tasks: the compiled parser for plain texts, each distinct text once."""

from __future__ import annotations

import functools
import re

#: Texts of which both parsers of the library make the same: no tabs, controls or odd line ends.
_PLAIN = re.compile(r"[\n\x20-\x7e\xa1-‧‪-퟿]*\Z")
#: Longer texts, and more brackets or indentation, are left to the library's own parser, which bounds its depth.
_LONGEST, _DEEPEST = 1 << 14, 50


def _plain(text: str) -> bool:
    nested = sum(text.count(x) for x in ("[", "{", "- ", "-\n", "? ", "?\n"))
    return len(text) <= _LONGEST and nested <= _DEEPEST and " " * _DEEPEST not in text and _PLAIN.match(text) is not None


@functools.lru_cache(maxsize=2048)
def _quick(text: str):
    import yaml

    return yaml.load(text, Loader=yaml.CSafeLoader)


def loaded(text: str):
    """`yaml.safe_load`, with its errors; equal texts share their value, so it is not to be changed."""
    import yaml

    if yaml.__with_libyaml__ and _plain(text):
        try:
            return _quick(text)
        except Exception:  # the library's own parser says what is wrong
            pass
    return yaml.safe_load(text)
