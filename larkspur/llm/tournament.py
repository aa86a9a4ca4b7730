"""A tournament tree over sorted runs that arrive in blocks."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

LAST = (float("inf"),)


class Tournament:
    """The least of many runs' heads: one path from a leaf to the root is played again when that run's head changes."""

    def __init__(self, leaves: int = 2):
        self.size = max(2, 1 << (leaves - 1).bit_length())
        self.heads: list[tuple] = [LAST] * self.size
        self.winner = [0] * self.size + list(range(self.size))
        for i in range(self.size - 1, 0, -1):
            self.winner[i] = self.winner[2 * i]

    def grow(self) -> None:
        """Twice as many leaves, with the heads there are."""
        heads = self.heads
        self.__init__(2 * self.size)
        for leaf, head in enumerate(heads):
            self.put(leaf, head)

    def put(self, leaf: int, head: tuple) -> None:
        heads, winner = self.heads, self.winner
        heads[leaf] = head
        at = (leaf + self.size) >> 1
        while at:
            a, b = winner[2 * at], winner[2 * at + 1]
            winner[at] = a if heads[a] <= heads[b] else b
            at >>= 1

    def first(self) -> tuple[int, tuple]:
        leaf = self.winner[1]
        return leaf, self.heads[leaf]


def merged(blocks: Iterable[tuple[int, list[tuple]]]) -> Iterator[tuple]:
    """The entries of all runs in order. blocks: (run, sorted entries), by first entry, and a run's blocks one after the other.

    A block is opened when its first entry may be next, so what is held are the blocks that overlap the entry at hand. Entries that compare
    equal come out one after the other.
    """
    tree, free = Tournament(), [1, 0]
    leaf_of: dict[int, int] = {}
    run_of: dict[int, int] = {}
    waiting: dict[int, deque] = {}
    entries: dict[int, Iterator[tuple]] = {}
    source = iter(blocks)
    ahead = next(source, None)
    while True:
        leaf, head = tree.first()
        while ahead is not None and ahead[1][0] <= head:
            run, block = ahead
            if run in leaf_of:
                waiting[leaf_of[run]].append(block)
            else:
                if not free:
                    free = list(range(2 * tree.size - 1, tree.size - 1, -1))
                    tree.grow()
                at = leaf_of[run] = free.pop()
                run_of[at] = run
                waiting[at], entries[at] = deque(), iter(block)
                tree.put(at, next(entries[at]))
            ahead = next(source, None)
            leaf, head = tree.first()
        if head is LAST:
            return
        yield head
        following = next(entries[leaf], None)
        if following is None and waiting[leaf]:
            entries[leaf] = iter(waiting[leaf].popleft())
            following = next(entries[leaf], None)
        if following is None:
            del leaf_of[run_of.pop(leaf)], waiting[leaf], entries[leaf]
            free.append(leaf)
        tree.put(leaf, LAST if following is None else following)
