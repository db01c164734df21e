"""A prefix tree over globally ordered n-gram sets, and the Jaccard join that walks it."""

from __future__ import annotations

import numpy as np

#: Tokens of a node: a longer run is a chain of nodes, so that a search can leave it early.
NODE_TOKENS = 16
#: So many tokens have to agree among the first ones (all that are needed, for smaller sets).
FIRST_COMMON = 32


def ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] of them), begin[1], ..."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + count, count)


class SetTrie:
    """Radix tree over sets whose tokens are integers in one global order (0 first).

    ``sets`` are sorted token arrays and ``sizes`` the sizes that count for the likeness; a size may
    exceed the array by tokens that no other set has. Sets with a common beginning share the nodes of it,
    so a search counts what it has in common with that beginning once for all of them. Sets link from
    100 * common >= ``percent`` * union on.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, tokens: int, percent: int):
        self.sizes, self.percent = np.asarray(sizes, np.int64), percent
        # A partner has at least ``need`` tokens in common, so k = min(need, FIRST_COMMON) among the first size - need + k.
        held = np.array([len(s) for s in sets])
        need = -(-percent * self.sizes // 100)
        self.least_first = np.maximum(1, np.minimum(need, FIRST_COMMON))
        self.first = np.clip(held - need + self.least_first, 0, held)
        tokens_first = np.concatenate([np.zeros(0, np.int32), *(s[:k] for s, k in zip(sets, self.first.tolist()))])
        owner = np.repeat(np.arange(len(sets)), self.first)
        self.owners = owner[np.argsort(tokens_first, kind="stable")].astype(np.int32)
        self.owner_count = np.bincount(tokens_first, minlength=tokens)
        self.owner_begin = np.cumsum(self.owner_count) - self.owner_count
        parent, begin, end, node_of, segment, order = self.radix(sets)
        # Chains of nodes of up to NODE_TOKENS tokens.
        length = end - begin
        pieces = np.maximum(1, -(-length // NODE_TOKENS))
        base = np.cumsum(pieces) - pieces
        node = np.repeat(np.arange(len(parent)), pieces)
        nth = np.arange(len(node)) - base[node]
        self.parent = np.where(nth > 0, np.arange(len(node)) - 1, (base + pieces - 1)[parent[node]])
        self.parent[0] = -1
        start = begin[node] + nth * NODE_TOKENS
        held = np.minimum(NODE_TOKENS, end[node] - start)
        self.grams = np.full((len(node), NODE_TOKENS), tokens, np.int32)  # ``tokens`` stands for none
        cells = np.arange(NODE_TOKENS)
        inside = cells < held[:, None]
        self.grams[inside] = segment[(start[:, None] + cells)[inside]]
        self.last = np.full(len(node), -1, np.int64)
        self.last[held > 0] = segment[(start + held - 1)[held > 0]]
        self.has = np.zeros(tokens + 1, bool)
        node_of = (base + pieces - 1)[node_of]
        self.members = np.argsort(node_of, kind="stable")
        self.member_count = np.bincount(node_of, minlength=len(node))
        self.member_begin = np.cumsum(self.member_count) - self.member_count
        up = self.parent[1:]
        self.children = np.argsort(up, kind="stable") + 1
        self.child_count = np.bincount(up, minlength=len(node)) if len(up) else np.zeros(len(node), np.int64)
        self.child_begin = np.cumsum(self.child_count) - self.child_count
        # What lies below each node: the longest rest, and the smallest and largest size.
        self.rest, self.least, self.most = np.zeros(len(node), np.int64), np.full(len(node), np.iinfo(np.int64).max >> 8), np.zeros(len(node), np.int64)
        np.minimum.at(self.least, node_of, self.sizes)
        np.maximum.at(self.most, node_of, self.sizes)
        # Below a node are the sets from ``low`` to before ``high`` in the tree's order.
        self.order, place = order, np.argsort(order)
        self.low, self.high = np.full(len(node), len(sets)), np.zeros(len(node), np.int64)
        np.minimum.at(self.low, node_of, place)
        np.maximum.at(self.high, node_of, place + 1)
        levels, nodes = [], np.zeros(1, np.int64)
        while len(nodes):
            levels.append(nodes)
            nodes = self.children[ragged(self.child_begin[nodes], self.child_count[nodes])]
        for nodes in levels[:0:-1]:
            up = self.parent[nodes]
            np.maximum.at(self.rest, up, self.rest[nodes] + held[nodes])
            np.minimum.at(self.least, up, self.least[nodes])
            np.maximum.at(self.most, up, self.most[nodes])
            np.minimum.at(self.low, up, self.low[nodes])
            np.maximum.at(self.high, up, self.high[nodes])

    @staticmethod
    def radix(sets: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """(parent, begin, end, node of each set, segment, order of the sets): nodes as runs of ``segment``; 0 is the root."""
        keys = [s.astype(">i4").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=keys.__getitem__)
        del keys
        parent, begin, ends, depth, pieces = [0], [0], [0], [0], []
        node_of = np.zeros(len(sets), np.int64)
        stack = [0]  # nodes from the root to the set before
        before, stored = np.zeros(0, np.int32), 0
        for i in order:
            s = sets[i]
            k = min(len(s), len(before))
            differ = np.flatnonzero(s[:k] != before[:k])
            common = int(differ[0]) if len(differ) else k
            while depth[stack[-1]] > common:
                node = stack.pop()
                if depth[stack[-1]] < common:  # split the node at the end of what is common
                    cut = begin[node] + common - depth[stack[-1]]
                    parent.append(stack[-1])
                    begin.append(begin[node])
                    ends.append(cut)
                    depth.append(common)
                    begin[node] = cut
                    parent[node] = len(parent) - 1
                    stack.append(len(parent) - 1)
            if len(s) > depth[stack[-1]]:
                parent.append(stack[-1])
                begin.append(stored)
                pieces.append(s[depth[stack[-1]] :])
                stored += len(pieces[-1])
                ends.append(stored)
                depth.append(len(s))
                stack.append(len(parent) - 1)
            node_of[i] = stack[-1]
            before = s
        return np.array(parent), np.array(begin), np.array(ends), node_of, np.concatenate([np.zeros(0, np.int32), *pieces]), np.array(order)

    def able(self, query: np.ndarray, i: int) -> np.ndarray:
        """In the tree's order, how many of the sets before each place have enough of their first tokens in common with set ``i``'s."""
        query = query[: self.first[i]]
        owners = self.owners[ragged(self.owner_begin[query], self.owner_count[query])]
        common = np.bincount(owners, minlength=len(self.sizes))
        return np.concatenate([[0], np.cumsum((common >= np.minimum(self.least_first, self.least_first[i]))[self.order])])

    def search(self, query: np.ndarray, i: int) -> np.ndarray:
        """Sets that link with set ``i``, whose tokens are ``query``; itself included.

        Only children of live nodes that lead to an able set are looked at. A node lives while the sizes below it
        may fit, and while what is common so far and what may still be (the longest rest below, or what is left of
        the query) can suffice.
        """
        size, percent, able = int(self.sizes[i]), self.percent, self.able(query, i)
        self.has[query] = True
        nodes, common, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(nodes):
            count = self.child_count[nodes]
            kids, common = self.children[ragged(self.child_begin[nodes], count)], np.repeat(common, count)
            fits = able[self.high[kids]] > able[self.low[kids]]
            fits &= (100 * self.most[kids] >= percent * size) & (percent * self.least[kids] <= 100 * size)
            kids, common = kids[fits], common[fits]
            same = np.bitwise_count(self.has[self.grams[kids]].view(np.uint64)).sum(1, dtype=np.int64)
            common = common + same
            left = len(query) - np.searchsorted(query, self.last[kids], "right")
            live = (100 + percent) * (common + np.minimum(self.rest[kids], left)) >= percent * (size + self.least[kids])
            nodes, common = kids[live], common[live]
            count = self.member_count[nodes]
            if count.any():
                here = self.members[ragged(self.member_begin[nodes], count)]
                both = np.repeat(common, count)
                found.append(here[(100 * both >= percent * (size + self.sizes[here] - both)) & (both > 0)])
        self.has[query] = False
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def linked_groups(sets: list[np.ndarray], sizes: np.ndarray, first: int, percent: int, asked: np.ndarray | None = None) -> np.ndarray:
    """For each set the position of a set that stands for its group of linked sets.

    The search begins with ``first``; a set that is already in its group asks no more, since every set
    outside that group asks for all of them. With ``asked``, exactly those sets ask.
    """
    root = np.arange(len(sets))
    if len(sets) < 2:
        return root
    every, back, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(every), np.int32)
    rank[np.argsort(df, kind="stable")] = np.arange(len(every), dtype=np.int32)  # rare tokens first, where sets that don't link differ
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    sets, count = [np.sort(x) for x in np.split(rank[back], cuts)], len(every)
    del every, back, df, rank
    trie = SetTrie(sets, sizes, count, percent)
    queue = [first, *(i for i in range(len(sets)) if i != first)] if asked is None else np.flatnonzero(asked).tolist()
    for i in queue:
        if asked is None and i != first and root[i] == root[first]:
            continue
        for other in np.unique(root[trie.search(sets[i], i)]).tolist():
            if other != root[i]:
                root[root == other] = root[i]
    return root
