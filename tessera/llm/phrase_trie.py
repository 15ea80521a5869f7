"""A HAT-trie that counts phrases of word ids.

The upper levels are a shallow trie over word ids, at most ``DEPTH`` deep; below
it hang hash containers from the rest of a phrase to its count.  A container
above ``BURST`` entries bursts into one container for each next word.  Phrases
of one size go into one trie.  When it holds ``limit`` entries, its largest
subtrees are spilled, each as a whole, until few entries are left; a phrase may
thus be spilled several times, and its counts add up when runs are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Entries of a container, levels of the trie above the containers, and entries of a trie.
BURST = 16_384
DEPTH = 2
LIMIT = 250_000


class _Node:
    """A branch has children by word id; a container has counts by the rest of
    the phrase: a word id, or a tuple of several."""

    __slots__ = ("children", "counts", "size")

    def __init__(self):
        self.children: dict[int, _Node] | None = None
        self.counts: dict = {}
        self.size = 0


class PhraseTrie:
    """Counts of phrases of ``words`` word ids."""

    def __init__(self, words: int, *, burst: int = BURST, depth: int = DEPTH, limit: int = LIMIT):
        self.words, self.burst, self.limit = words, burst, limit
        self.depth = min(depth, words - 1)
        self.root = _Node()

    def __len__(self) -> int:
        return self.root.size

    def add(self, columns: list[np.ndarray], counts: np.ndarray) -> None:
        """Add distinct phrases, a column for each word, sorted by phrase."""
        if len(counts):
            self._add(self.root, 0, [c.tolist() for c in columns], counts.tolist(), 0, len(counts))

    def _add(self, node: _Node, level: int, columns, counts, lo: int, hi: int) -> int:
        before = node.size
        if node.children is None:
            held = node.counts
            rest = columns[level][lo:hi] if level == self.words - 1 else list(zip(*(c[lo:hi] for c in columns[level:])))
            if held:
                known = held.get
                for key, count in zip(rest, counts[lo:hi]):
                    held[key] = known(key, 0) + count
            else:
                held.update(zip(rest, counts[lo:hi]))
            node.size = len(held)
            if node.size > self.burst and level < self.depth:
                self._burst(node, level)
            return node.size - before
        word, at = columns[level], lo
        while at < hi:
            end = at + 1
            own = word[at]
            while end < hi and word[end] == own:
                end += 1
            child = node.children.get(own)
            if child is None:
                child = node.children[own] = _Node()
            node.size += self._add(child, level + 1, columns, counts, at, end)
            at = end
        return node.size - before

    def _burst(self, node: _Node, level: int) -> None:
        held, node.counts, node.children = node.counts, {}, {}
        last = level == self.words - 2
        for rest, count in held.items():
            child = node.children.get(rest[0])
            if child is None:
                child = node.children[rest[0]] = _Node()
            child.counts[rest[1] if last else rest[1:]] = count
            child.size += 1

    def _entries(self, node: _Node, start: tuple[int, ...], columns: list[list[int]], counts: list[int]) -> None:
        """Append all entries below a node."""
        for word, child in (node.children or {}).items():
            self._entries(child, (*start, word), columns, counts)
        if not node.counts:
            return
        n = len(node.counts)
        for column, word in zip(columns, start):
            column.extend([word] * n)
        rest = columns[len(start):]
        if len(rest) == 1:
            rest[0].extend(node.counts)
        else:
            for column, part in zip(rest, zip(*node.counts)):
                column.extend(part)
        counts.extend(node.counts.values())

    def spill(self, keep: int, rows: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """Take out subtrees under the first words, the largest first, until at
        most ``keep`` entries stay; several come together up to about ``rows``.
        A root that has not burst is one subtree."""
        root = self.root
        columns, counts = [[] for _ in range(self.words)], []

        def taken():
            return [np.array(c, dtype=np.int64) for c in columns], np.array(counts, dtype=np.int64)

        if root.children is None:
            if root.size > keep:
                self._entries(root, (), columns, counts)
                self.root = _Node()
        else:
            for word in sorted(root.children, key=lambda w: -root.children[w].size):
                if root.size <= keep:
                    break
                child = root.children.pop(word)
                root.size -= child.size
                self._entries(child, (word,), columns, counts)
                if len(counts) >= rows:
                    yield taken()
                    columns, counts = [[] for _ in range(self.words)], []
            if not root.children:
                self.root = _Node()
        if counts:
            yield taken()
