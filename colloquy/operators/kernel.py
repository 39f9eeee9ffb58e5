"""Parents in the order of arrival, for nodes whose proposed edges may form a cycle.

Which edges of a cycle hold depends on the order in which messages arrive: each edge is taken unless it
would close a cycle among those that hold. The forest of these is kept as link-cut trees, in which a node's root is
found, and an edge put in or taken out, in logarithmic time on average, so a chain of any shape costs n log n.
"""

from __future__ import annotations

from collections.abc import Iterable

LAST = 2_147_483_647
PARENTS = "node string, parent string, at_pos long, at_idx int"


class Forest:
    """Rooted trees over numbers: ``up`` leads to the parent in a splay tree, or from its top to the path above."""

    def __init__(self):
        self.left: list[int] = []
        self.right: list[int] = []
        self.up: list[int] = []

    def add(self) -> int:
        self.left.append(-1)
        self.right.append(-1)
        self.up.append(-1)
        return len(self.up) - 1

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        y = up[x]
        z = up[y]
        if z >= 0:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x
        if left[y] == x:
            inner = left[y] = right[x]
            right[x] = y
        else:
            inner = right[y] = left[x]
            left[x] = y
        if inner >= 0:
            up[inner] = y
        up[y], up[x] = x, z

    def _splay(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        while (y := up[x]) >= 0 and (left[y] == x or right[y] == x):
            z = up[y]
            if z >= 0 and (left[z] == y or right[z] == y):
                self._rotate(y if (left[z] == y) == (left[y] == x) else x)
            self._rotate(x)

    def _expose(self, x: int) -> None:
        """The path from the root to ``x`` becomes one splay tree with ``x`` on top and nothing below it."""
        below, at = -1, x
        while at >= 0:
            self._splay(at)
            self.right[at] = below
            below, at = at, self.up[at]
        self._splay(x)

    def root(self, x: int) -> int:
        self._expose(x)
        while self.left[x] >= 0:
            x = self.left[x]
        self._splay(x)
        return x

    def link(self, child: int, parent: int) -> None:
        """``child`` must be a root."""
        self._expose(child)
        self.up[child] = parent

    def cut(self, child: int) -> None:
        """``child`` must not be a root."""
        self._expose(child)
        self.up[self.left[child]] = -1
        self.left[child] = -1


def take_edges(edges: Iterable[tuple[int, int, str, str, bool]]) -> dict[str, tuple[str, int, int]]:
    """node -> (parent, position, index) from proposed edges (position, index, parent, child, whether the child's message proposes it).

    A message's own edge replaces what others proposed for it before.
    """
    forest, number, parent = Forest(), {}, {}

    def of(node: str) -> int:
        if node not in number:
            number[node] = forest.add()
        return number[node]

    for position, index, above, below, own in sorted(edges):
        if above == below or below in parent and not own:
            continue
        a, b = of(above), of(below)
        if held := parent.get(below):
            forest.cut(b)
        if forest.root(a) != b:
            forest.link(b, a)
            parent[below] = (above, position, index)
        elif held:
            forest.link(b, of(held[0]))
    return parent


def choose_parents(messages: list[tuple[int, str, list[str]]]) -> dict[str, tuple[str, int, int]]:
    """``take_edges`` for whole messages (position, own node, nodes referred to)."""
    edges = []
    for position, own, chain in messages:
        edges += [(position, k, a, b, False) for k, (a, b) in enumerate(zip(chain, chain[1:], strict=False), 1)]
        edges += [(position, LAST, chain[-1], own, True)] if chain else []
    return take_edges(edges)


def link_core(rows: list[tuple]) -> list[tuple]:
    """``take_edges`` for the rows (root, at_pos, at_idx, parent, child, own) of one component, or of several."""
    found = take_edges(row[1:] for row in rows)
    return [(node, *where) for node, where in found.items()]
