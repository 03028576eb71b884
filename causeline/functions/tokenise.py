"""Tokeniser of log messages (F4-F8): always-splitters, and ``:`` that splits from the right unless the piece is a variable.

Arrow-batched: a message is split by one compiled pattern, and only pieces with a conditional splitter take the slow path.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that always split, and those that split from the right.
SPLITTERS = " ()[]',+=\"><{};`|"
CONDITIONAL = ":"
TOKENS = "words array<string>, seps array<string>"

_TIME = re.compile(r"^\d{2}:\d{2}:\d{2}(\.\d+)?$")
_MAC = re.compile(r"^[0-9A-Fa-f]{2}(:[0-9A-Fa-f]{2}){5}$")


def is_variable(piece: str) -> bool:
    """An IP address or network, HH:MM:SS[.f], or a MAC address."""
    if _TIME.match(piece) or _MAC.match(piece):
        return True
    try:
        ipaddress.ip_address(piece)
        return True
    except ValueError:
        pass
    try:
        ipaddress.ip_network(piece, strict=False)
        return True
    except ValueError:
        return False


def _peel(piece: str, conditional: str) -> list[str]:
    """Pieces and splitters of one piece, in order."""
    tail: list[str] = []
    while piece and not is_variable(piece):
        at = max(piece.rfind(c) for c in conditional)
        if at < 0:
            break
        tail = [piece[at], *_peel(piece[at + 1 :], conditional), *tail]
        piece = piece[:at]
    return [piece, *tail] if piece else tail


def tokenise(message: str, splitters: str = SPLITTERS, conditional: str = CONDITIONAL, wildcard: str | None = None) -> tuple[list[str], list[str]]:
    """(words, separators around them): one separator more than words, neighbours joined.

    wildcard: also split around this string inside tokens (F8).
    """
    cuts = re.compile("([" + re.escape(splitters) + "])")
    words, seps = [], [""]
    for part in cuts.split(message):
        if part == "":
            continue
        if len(part) == 1 and part in splitters:
            seps[-1] += part
            continue
        pieces = [part]
        if wildcard and wildcard in part:
            pieces = [p for p in re.split("(" + re.escape(wildcard) + ")", part) if p]
        for p in pieces:
            for x in _peel(p, conditional) if any(c in p for c in conditional) else [p]:
                if len(x) == 1 and x in conditional:
                    seps[-1] += x
                else:
                    words.append(x)
                    seps.append("")
    return words, seps


def words_and_separators(message: Column, splitters: str = SPLITTERS, conditional: str = CONDITIONAL, wildcard: str | None = None) -> Column:
    """struct<words, seps> of each message; null for null."""

    @F.pandas_udf(TOKENS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = [tokenise(m, splitters, conditional, wildcard) if m is not None else (None, None) for m in s]
            yield pd.DataFrame(rows, columns=["words", "seps"])

    return run(message)


def symbols_as_words(message: Column, splitters: str = SPLITTERS, conditional: str = CONDITIONAL) -> Column:
    """All words and separators in one list, without empty ones."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        out = []
        for m in s:
            if m is None:
                out.append(None)
                continue
            words, seps = tokenise(m, splitters, conditional)
            out.append([x for pair in zip(seps, [*words, ""]) for x in pair if x])
        return pd.Series(out)

    return run(message)


def definition(lines: list[str]) -> tuple[str, str]:
    """Splitters of a definition file: two lines, items set apart by ``0``."""
    return tuple("".join(line.rstrip("\n").split("0")) for line in lines[:2])  # type: ignore[return-value]
