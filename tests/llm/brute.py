"""Plain Python versions of the operators, for small tables."""

import re
from collections import Counter, defaultdict
from math import log10

import xxhash

BLANK = re.compile("[\x20\x09-\x0d]+")


def lowered(text):
    return re.sub("[A-Z]", lambda letter: letter[0].lower(), text or "")


def words(text):
    return [word for word in BLANK.split(lowered(text)) if word]


def fingerprint(text):
    found = words(text)
    shingles = [" ".join(found[at : at + 3]) for at in range(max(1, len(found) - 2))] if found else []
    ones = Counter()
    for shingle in shingles:
        value = xxhash.xxh64_intdigest(shingle.encode(), 42)
        ones.update(bit for bit in range(64) if value >> bit & 1)
    return sum(1 << bit for bit, times in ones.items() if 2 * times > len(shingles))


def roots(nodes, linked):
    """The smallest node that each can reach; ``linked`` tells whether two are linked."""
    nodes = sorted(set(nodes))
    root = {node: node for node in nodes}

    def find(node):
        while root[node] != node:
            node = root[node]
        return node

    for at, one in enumerate(nodes):
        for other in nodes[at + 1 :]:
            if linked(one, other):
                a, b = find(one), find(other)
                root[max(a, b)] = min(a, b)
    return {node: find(node) for node in nodes}


def dedup_lines(texts, width=3):
    """Texts by id; the result has the lines that stay."""
    seen, gone = set(), defaultdict(set)
    for key in sorted(texts):
        lines = [line.strip(" ") for line in texts[key].split("\n")]
        for at in range(len(lines) - width + 1):
            window = tuple(lines[at : at + width])
            if window in seen:
                gone[key].update(range(at, at + width))
            seen.add(window)
    return {
        key: [line for at, line in enumerate(text.split("\n")) if at not in gone[key]]
        for key, text in texts.items()
    }


class Ppm:
    """Prediction by partial matching with escapes of method D and exclusion."""

    def __init__(self, texts, order):
        self.order = order
        self.levels = [defaultdict(Counter) for _ in range(order + 1)]
        for text in texts:
            stream = self.stream(text)
            for at in range(order, len(stream)):
                self.levels[order][stream[at - order : at]][stream[at]] += 1
        for level in range(order - 1, -1, -1):
            for context, seen in self.levels[level + 1].items():
                for byte in seen:
                    self.levels[level][context[1:]][byte] += 1

    def stream(self, text):
        return b"\n" * self.order + " ".join(words(text)).encode() + b"\n"

    def cost(self, context, byte):
        excluded, total = set(), 0.0
        for level in range(self.order, -1, -1):
            seen = self.levels[level].get(context[self.order - level :])
            if not seen:
                continue
            rest = {b: n for b, n in seen.items() if b not in excluded}
            if byte in rest:
                return total + log10((2 * rest[byte] - 1) / (2 * sum(rest.values())))
            if rest:
                total += log10(len(rest) / (2 * sum(rest.values())))
            excluded |= set(seen)
        return total + log10(1 / (256 - len(excluded)))

    def score(self, text):
        stream = self.stream(text)
        return sum(
            self.cost(stream[at - self.order : at], stream[at])
            for at in range(self.order, len(stream))
        )
