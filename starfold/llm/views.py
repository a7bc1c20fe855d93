"""The two views of a document and the fitted model: all that a task needs to score texts.

Tasks import this module and nothing of the training, so a worker starts quickly.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from zlib import crc32

import numpy as np

#: Every token has a place by its hash; nothing is chosen or left out, so unlabelled documents add words too.
DIMENSIONS = 1 << 18

WORD = re.compile(r"[^\W\d_]+")
SYMBOLS = re.compile(r"[^\w\s.,]+|[.,]{2,}")


def content_tokens(text: str | None) -> set[str]:
    """Presence features of a text; shares are cut to tenths. Null is read as empty."""
    text = text or ""
    words = WORD.findall(text.lower())
    tokens = set(words)
    tokens.update("~" + run[:3] for run in SYMBOLS.findall(text))
    if words:
        letters = max(1, sum(map(len, words)))
        upper = sum(map(str.isupper, text))
        common = Counter(words).most_common(1)[0][1]
        tokens.add(f"~upper {10 * upper // letters}")
        if len(words) >= 20:
            tokens.add(f"~distinct {10 * len(set(words)) // len(words)}")
            tokens.add(f"~common {10 * common // len(words)}")
        tokens.add(f"~symbols {min(10, 10 * (len(text) - letters - text.count(' ')) // letters)}")
    else:
        tokens.add("~wordless")
    return tokens


def metadata_tokens(source: str | None, lang: str | None, text: str | None) -> set[str]:
    """Presence features that do not look at the words."""
    text = text or ""
    return {
        f"source {source}",
        f"lang {lang}",
        f"length {int(math.log2(len(text) + 1))}",
        f"lines {int(math.log2(text.count(chr(10)) + 1))}",
    }


def places(tokens: Iterable[str]) -> list[int]:
    """The ascending places of a set of tokens."""
    return sorted({crc32(t.encode()) % DIMENSIONS for t in tokens})


class Weights:
    """The weight of any token."""

    def __init__(self, values: np.ndarray):
        self.values = values

    def __getitem__(self, token: str) -> float:
        return float(self.values[crc32(token.encode()) % DIMENSIONS])


def flat_places(lists) -> tuple[np.ndarray, np.ndarray]:
    """All places of an Arrow list column one after the other, and the row of each."""
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)


def margins_of(lists, weights: Weights, intercept: float) -> np.ndarray:
    """The margin of every row of an Arrow list column of places."""
    flat, row = flat_places(lists)
    return intercept + np.bincount(row, weights.values[flat], len(lists))


@dataclass
class View:
    """One fitted linear view: margin = intercept + the weights of the tokens that are present."""

    weights: Weights
    intercept: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, tokens: set[str]) -> float:
        return self.intercept + float(self.weights.values[places(tokens)].sum())


@dataclass
class Model:
    """Both views and the weights that combine their calibrated margins."""

    content: View
    metadata: View
    combine: tuple[float, float, float]

    def scores(self, source, lang, text) -> tuple[float, float, float]:
        """(content, metadata, combined) probability that a document is to be rejected."""
        one = self.content.margin(content_tokens(text))
        two = self.metadata.margin(metadata_tokens(source, lang, text))
        a, b, c = self.combine
        margins = (
            self.content.slope * one + self.content.offset,
            self.metadata.slope * two + self.metadata.offset,
            a * one + b * two + c,
        )
        return tuple(1 / (1 + math.exp(-max(-500.0, min(500.0, m)))) for m in margins)
