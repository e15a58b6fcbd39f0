"""Which aromatic atoms take part in double bonds, and whether alternating bonds can be written: a maximum matching."""

from __future__ import annotations

from collections import deque


def needs_double(atom: dict, kinds: list[str]) -> bool:
    """Whether an aromatic atom takes part in one double bond of the ring in every form with alternating bonds."""
    if "DOUBLE" in kinds:
        return False
    links = len(kinds) + atom["n_h"]
    if atom["symbol"] in ("C", "Si"):
        return links == 3 and not atom["charge"]
    if atom["symbol"] in ("N", "P", "As"):
        return links == (3 if atom["charge"] == 1 else 2) and atom["charge"] >= 0
    return atom["symbol"] in ("O", "S", "Se", "Te") and atom["charge"] == 1


def paired(near: dict[int, list[int]]) -> dict[int, int]:
    """A first matching: atoms with one neighbour left are paired first, else the next one in order with its poorest neighbour."""
    left = {v: set(found) for v, found in near.items()}
    mate: dict[int, int] = {}
    ends = [v for v in sorted(left) if len(left[v]) == 1]

    def pair(v: int, w: int) -> None:
        mate[v], mate[w] = w, v
        for x in (v, w):
            for u in left[x]:
                left[u].discard(x)
                if len(left[u]) == 1 and u not in mate:
                    ends.append(u)

    for v in sorted(left):
        while ends:
            e = ends.pop()
            if e not in mate and left[e]:
                pair(e, min(left[e]))
        if v not in mate and left[v]:
            pair(v, min(left[v], key=lambda w: (len(left[w]), w)))
    return mate


def improve(near: dict[int, list[int]], mate: dict[int, int], root: int, spare: set[int]) -> bool:
    """Look for an alternating path from ``root`` to an atom without a partner, or to a spare one that may lose its own.

    Odd cycles on the way are contracted to their base: all of their atoms then count as reached by an even path.
    """
    base: dict[int, int] = {}
    back: dict[int, int] = {}
    even, queue = {root}, deque([root])
    of = lambda v: base.get(v, v)

    def turn(v: int) -> None:
        """Exchange what is paired on the path from an atom whose partner is to be the one before it."""
        while True:
            u = back[v]
            after = mate.get(u)
            mate[v], mate[u] = u, v
            if after is None:
                return
            v = after

    def meeting(a: int, b: int) -> int:
        seen = set()
        while True:
            a = of(a)
            seen.add(a)
            if a == root or a not in mate:
                break
            a = back[mate[a]]
        while (b := of(b)) not in seen:
            b = back[mate[b]]
        return b

    def contract(v: int, to: int, child: int, ring: set[int]) -> None:
        while of(v) != to:
            ring |= {of(v), of(mate[v])}
            back[v] = child
            child = mate[v]
            v = back[child]

    while queue:
        v = queue.popleft()
        for w in near[v]:
            if of(v) == of(w) or mate.get(v) == w:
                continue
            if w in even:
                to, ring = meeting(v, w), set()
                contract(v, to, w, ring)
                contract(w, to, v, ring)
                for x in near:
                    if of(x) in ring:
                        base[x] = to
                        if x not in even:
                            even.add(x)
                            queue.append(x)
            elif w not in back:
                back[w] = v
                if w not in mate:
                    turn(w)
                    return True
                u = mate[w]
                even.add(u)
                queue.append(u)
                if u in spare:
                    del mate[u]
                    turn(w)
                    return True
    return False


def unpaired(atoms: list[dict], bonds: list[dict]) -> list[int]:
    """Aromatic atoms without a partner for a double bond; empty if alternating bonds can be written. Dummy atoms may be partners."""
    wanting = {a["idx"] for a in atoms if a["aromatic"] and needs_double(a, [bonds[x["k"]]["kind"] for x in a["near"]])}
    if not wanting:
        return []
    ring = lambda x: bonds[x["k"]]["kind"] == "AROMATIC" or bonds[x["k"]]["in_ring"]
    spare = {x["v"] for v in wanting for x in atoms[v]["near"] if not atoms[x["v"]]["z"] and ring(x)}
    near: dict[int, list[int]] = {v: [] for v in sorted(wanting | spare)}
    for v in near:
        for x in atoms[v]["near"]:
            w = x["v"]
            if w in near and (bonds[x["k"]]["kind"] == "AROMATIC" or ((v in spare) != (w in spare) and ring(x))):
                near[v].append(w)
    mate = paired({v: [w for w in found if v in wanting and w in wanting] for v, found in near.items()})
    for v in sorted(wanting):
        if v not in mate:
            improve(near, mate, v, spare)
    return sorted(v for v in wanting if v not in mate)
