"""Quality rules, line first: each line is judged for punctuation, navigation and
boilerplate, failing lines go, and a document that loses too much text is rejected.

Words are what lies between the ASCII white space characters U+0009-U+000D and U+0020;
lines are split at U+000A. Null and empty texts have no words and fail the base rules.
Equal rows get equal results; rows never meet, so ties and copies need no rule. Texts are
read whole; memory grows with the longest single text of a task.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lattica.llm.common import SPACED, map_texts, window_hashes, words_of

SYMBOLS = "#*$%&|<>"
_ENDS = tuple(".!?…:;\"'”’»)]。！？")
_NAVIGATION = frozenset("| > < » « · • / › ‹ →".split())
_BOILERPLATE = re.compile(
    r"all rights reserved|licensed under|released under|copyright|©|\(c\) \d{4}|spdx-license|cookie|privacy policy|terms of (?:use|service)"
    r"|enable javascript|lorem ipsum|click here|sign up|log in|subscribe to|read more",
    re.IGNORECASE,
)


_WORD = re.compile(r"[^ \t-\r]+")


@dataclass(frozen=True)
class LineRules:
    """Bounds of the line rules; shares are of a line's words, lost of a document's words."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols: float = 0.3
    max_shouted: float = 0.3
    max_separators: float = 0.2
    least_distinct: float = 0.2
    long_line: int = 20
    boilerplate_words: int = 30
    max_lost: float = 0.5


#: Why a line fails, in the order the rules are tried.
REASONS = ("repeated", "navigation", "symbols", "shouting", "monotone", "boilerplate", "punctuation")


def line_fault(line: str, words: list[str], rules: LineRules) -> str | None:
    """The first rule that a line with words fails."""
    n = len(words)
    if n >= 3 and sum(w in _NAVIGATION for w in words) > rules.max_separators * n:
        return "navigation"
    if sum(map(line.count, SYMBOLS)) > rules.max_symbols * n and n >= 3:
        return "symbols"
    if n >= 3 and (line.count("!!") > rules.max_shouted * n or n >= 8 and line.isupper()):
        return "shouting"
    if n >= rules.long_line and len(set(words)) < rules.least_distinct * n:
        return "monotone"
    if n <= rules.boilerplate_words and _BOILERPLATE.search(line):
        return "boilerplate"
    if n >= rules.long_line and not line.rstrip().endswith(_ENDS) and not any(w.endswith((".", ",", ";", ":", "!", "?")) for w in words):
        return "punctuation"
    return None


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("n_lines_failed", T.LongType()),
    T.StructField("n_words_lost", T.LongType()),
    T.StructField("line_faults", T.MapType(T.StringType(), T.LongType(), False)),
]
_CLEAN = T.StructField("clean_text", T.StringType())


def repeated_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per text: its words, and its words in 3-word windows that occur twice or more in it."""
    words = words_of(texts, SPACED)
    n = np.diff(words.first)
    doc = words.doc
    windows = window_hashes(words.hashes, 3)
    if not len(windows):
        return n, np.zeros(len(texts), np.int64)
    own = np.flatnonzero(doc[:-2] == doc[2:])
    key = windows[own] ^ (doc[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    start = own[order[same[1:] | same[:-1]]]
    hit = np.zeros(len(doc), bool)
    for i in range(3):
        hit[start + i] = True
    return n, np.bincount(doc[hit], minlength=len(texts))


def _kernel(rules: LineRules, clean: bool) -> Callable[[], Callable]:
    def make() -> Callable[[list[bytes]], list]:
        def kernel(texts: list[bytes]) -> list[list]:
            n_words, n_repeat = repeated_words(texts)
            out: list[list] = [[] for _ in range(len(FIELDS) + clean)]
            for raw, n, repeat in zip(texts, n_words.tolist(), n_repeat.tolist(), strict=True):
                text = raw.decode("utf-8", "replace")
                seen: set[str] = set()
                faults: dict[str, int] = {}
                dup = lost = 0
                left = []
                for line in text.split("\n"):
                    words = _WORD.findall(line)
                    if not words:
                        left.append(line)
                        continue
                    if line in seen:
                        dup += 1
                        fault = "repeated"
                    else:
                        seen.add(line)
                        fault = line_fault(line, words, rules)
                    if fault:
                        faults[fault] = faults.get(fault, 0) + 1
                        lost += len(words)
                    else:
                        left.append(line)
                failed = n < rules.min_words or 100 * repeat > rules.max_repeat_percent * n
                row = [
                    n,
                    len(text) - sum(map(text.count, " \t\n\v\f\r")),
                    sum(map(text.count, SYMBOLS)),
                    dup,
                    repeat,
                    failed,
                    not failed and lost <= rules.max_lost * n,
                    sum(faults.values()),
                    lost,
                    list(faults.items()),
                ]
                for column, value in zip(out, [*row, "\n".join(left)] if clean else row, strict=True):
                    column.append(value)
            return out

        return kernel

    return make


def line_first_quality(docs: DataFrame, text: str = "text", rules: LineRules = LineRules(), keep: list[str] | None = None, clean: bool = False) -> DataFrame:
    """Measures, faults by rule and verdict for each row; clean adds the text without its failed lines."""
    return map_texts(docs, text, [*FIELDS, _CLEAN] if clean else FIELDS, _kernel(rules, clean), keep)
