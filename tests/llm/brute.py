"""Plain versions of the corpus operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def line_words(line):
    return SPACE_WORD.findall(line)


def removed_lines(texts, min_words):
    """texts in order of place; per text the numbers of its lines in a run that stands earlier."""
    seen, out = set(), []
    for text in texts:
        lines = [(k, " ".join([line.strip(" \t\v\f\r")]), len(line_words(line))) for k, line in enumerate((text or "").split("\n")) if line_words(line)]
        gone = set()
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if sum(n for _, _, n in lines[i : j + 1]) >= min_words:
                    content = tuple(s for _, s, _ in lines[i : j + 1])
                    if content in seen:
                        gone.update(k for k, _, _ in lines[i : j + 1])
                    seen.add(content)
        for (a, _, _), (b, _, _) in zip(lines, lines[1:]):
            if a in gone and b in gone:
                gone.update(range(a, b))
        out.append(gone)
    return out


def removed_lines_of_long_texts(texts, min_words):
    """As removed_lines; of the runs from a line on and up to a line only the shortest with enough words, which cover all others."""
    seen, out = set(), []
    for text in texts:
        lines = [(k, line.strip(" \t\v\f\r"), len(line_words(line))) for k, line in enumerate((text or "").split("\n")) if line_words(line)]
        runs, size, i = set(), 0, 0
        for j, (_, _, n) in enumerate(lines):  # up to j: the last i from which the words are enough
            size += n
            while size - lines[i][2] >= min_words:
                size -= lines[i][2]
                i += 1
            if size >= min_words:
                runs.add((i, j))
        size, j = 0, len(lines) - 1
        for i in range(len(lines) - 1, -1, -1):  # from i on: the first j up to which they are
            size += lines[i][2]
            while size - lines[j][2] >= min_words:
                size -= lines[j][2]
                j -= 1
            if size >= min_words:
                runs.add((i, j))
        gone = set()
        for i, j in sorted(runs):
            content = tuple(s for _, s, _ in lines[i : j + 1])
            if content in seen:
                gone.update(k for k, _, _ in lines[i : j + 1])
            seen.add(content)
        for (a, _, _), (b, _, _) in zip(lines, lines[1:]):
            if a in gone and b in gone:
                gone.update(range(a, b))
        out.append(gone)
    return out


def shingles(text, n=5):
    low = "".join(c.lower() if c < "\x80" or "À" <= c <= "Þ" and c != "×" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    if not words:
        return Counter([text]) if text else Counter()
    return Counter(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def similarity(a, b):
    if not a or not b:
        return 0.0
    both = a.keys() & b.keys()
    union = a.keys() | b.keys()
    weighted = sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in union) for d in both)
    return max(weighted, len(both) / len(union))


def classes(rows, least=0.8, versions=()):
    """rows: (doc_id, text). Per row the least id of its class. versions: (place of a row, other text of it)."""
    texts = [t for _, t in rows] + [t for _, t in versions]
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, _) in enumerate(versions):
        if sets[i] and sets[len(rows) + k]:
            parent[find(len(rows) + k)] = find(i)
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and (sets[i] == sets[j] or len(sets[i].keys() & sets[j].keys()) * 2 > min(len(sets[i]), len(sets[j])) and similarity(sets[i], sets[j]) >= least):
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return [ids.get(find(i)) for i in range(len(rows))]
