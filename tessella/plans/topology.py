"""Shared arcs of the faces of one tile: build, merge small faces, simplify, rebuild. Plain Python over integer vertices."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Container, Iterable

import numpy as np

from tessella.functions.kernels import opened, point_in_ring, signed_area, simplify_weights

Face = list[tuple[int, int]]


def arcs(faces: dict[int, Face]) -> tuple[list[Face], dict[int, list[int]]]:
    """Arcs between nodes, and for each face the arcs (negative minus one: reversed) that it is made of.

    A node is a vertex whose neighbours differ between faces, or that is in another number of faces than the vertex before.
    """
    faces = {k: opened(f) for k, f in faces.items()}
    return _split(faces, _nodes(faces.values(), None))


def _nodes(faces: Iterable[Face], only: set[tuple] | None) -> set[tuple]:
    """The nodes of open faces, of all vertices or some."""
    near: dict[tuple, set] = defaultdict(set)
    users: dict[tuple, set] = defaultdict(set)
    for k, f in enumerate(faces):
        for j, p in enumerate(f):
            if only is None or p in only:
                for q in (f[j - 1], f[(j + 1) % len(f)]):
                    near[p].add(q)
                    users[p, q].add(k)
    return {p for p, n in near.items() if len(n) != 2 or len({frozenset(users[p, q]) for q in n}) > 1}


def _runs(f: Face, node: Container[tuple]) -> list[Face]:
    """An open face cut at its nodes; one closed run if it has none."""
    at = next((j for j, p in enumerate(f) if p in node), None)
    start = min(range(len(f)), key=lambda j: f[j]) if at is None else at
    own, run = [], [f[start]]
    for p in f[start + 1 :] + f[: start + 1]:
        run.append(p)
        if p in node:
            own.append(run)
            run = [p]
    if len(run) > 1:
        own.append(run)
    return own


def _split(faces: dict[int, Face], node: Container[tuple]) -> tuple[list[Face], dict[int, list[int]]]:
    made: list[Face] = []
    number: dict[tuple, int] = {}
    out: dict[int, list[int]] = {}
    for k, f in faces.items():
        refs = []
        for r in _runs(f, node):
            forward, back = tuple(r), tuple(reversed(r))
            if forward in number:
                refs.append(number[forward])
            elif back in number:
                refs.append(-number[back] - 1)
            else:
                number[forward] = len(made)
                refs.append(len(made))
                made.append(r)
        out[k] = refs
    return made, out


def rebuild(made: list[Face], refs: list[int]) -> Face:
    """The open ring of a face's arcs."""
    ring: Face = []
    for r in refs:
        part = made[r] if r >= 0 else made[-r - 1][::-1]
        ring += part[:-1]
    return ring


def simplify_arcs(made: list[Face], tolerance: float, low: int, high: int) -> list[Face]:
    """Each arc once, so both faces get the same vertices; ends and vertices on the tile's border stay."""
    out = []
    for a in made:
        if len(a) < 3:
            out.append(a)
            continue
        p = np.array(a, float)
        pinned = (p <= low).any(1) | (p >= high).any(1)
        ring = a[0] == a[-1]
        weight = simplify_weights(p[:-1] if ring else p, ring, pinned[:-1] if ring else pinned)
        kept = [q for q, w in zip(a, weight, strict=False) if w >= tolerance]
        if ring:
            kept = kept + [kept[0]] if len(kept) >= 3 else a
        out.append(kept if len(kept) >= 2 else a)
    return out


def merge_small(faces: dict[int, Face], least: float = 4.0) -> dict[int, Face]:
    """Faces below ``least`` in area join the neighbour with which they share most arcs (large ones first), if they share exactly one arc."""
    faces = {k: opened(f) for k, f in faces.items()}
    area = {k: abs(signed_area(f)) for k, f in faces.items()}
    users: dict[frozenset, set] = defaultdict(set)
    edges = lambda f: [frozenset((f[j - 1], f[j])) for j in range(len(f))]
    for k, f in faces.items():
        for e in edges(f):
            users[e].add(k)
    for k in sorted(faces, key=lambda k: (area[k], k)):
        near = {j for e in edges(faces[k]) for j in users[e]} - {k} if area[k] < least else set()
        if not near:
            continue
        # arcs around a face only depend on the faces it touches
        made, refs = arcs({j: faces[j] for j in sorted(near | {k})})
        plain = lambda own: {r if r >= 0 else -r - 1 for r in own}
        mine = plain(refs[k])
        shared = {j: len(mine & plain(refs[j])) for j in near}
        best = [j for j, n in shared.items() if n]
        if not best:
            continue
        j = max(best, key=lambda j: (area[j] >= least, shared[j], area[j], -j))
        if shared[j] != 1:
            continue
        arc = next(r for r in refs[k] if (r if r >= 0 else -r - 1) in plain(refs[j]))
        merged = _joined(made, refs[k], refs[j], arc)
        if merged and len(merged) >= 3:
            for e in edges(faces[k]):
                users[e].discard(k)
            for e in edges(faces[j]):
                users[e].discard(j)
            for e in edges(merged):
                users[e].add(j)
            faces[j], area[j] = merged, abs(signed_area(merged))
            del faces[k]
    return faces


def _joined(made: list[Face], a: list[int], b: list[int], arc: int) -> Face | None:
    base = arc if arc >= 0 else -arc - 1
    at = next(i for i, r in enumerate(b) if (r if r >= 0 else -r - 1) == base)
    if b[at] == arc:
        # both run the arc in the same sense: one of the faces has to be turned
        a = [-r - 1 for r in reversed(a)]
        arc = -arc - 1
    i = a.index(arc)
    return rebuild(made, b[:at] + a[i + 1 :] + a[:i] + b[at + 1 :])


def holes(rings: list[Face]) -> list[bool]:
    """Which rings of a group are holes, by the parity of how many others hold them; the largest is always a shell."""
    if not rings:
        return []
    areas = [abs(signed_area(r)) for r in rings]
    largest = max(range(len(rings)), key=lambda k: areas[k])
    out = []
    for k, r in enumerate(rings):
        depth = sum(areas[j] > areas[k] and point_in_ring(r[0][0] + 1e-7, r[0][1] + 1e-7, rings[j]) for j in range(len(rings)) if j != k)
        out.append(k != largest and depth % 2 == 1)
    return out


def tidy(faces: dict[int, Face], tolerance: float, low: int, high: int, least: float = 4.0) -> dict[int, Face]:
    """The topology pass of one tile; faces that fall below three vertices go."""
    if not faces:
        return {}
    merged = merge_small(faces, least)
    made, refs = arcs(merged)
    slim = simplify_arcs(made, tolerance, low, high)
    out = {k: rebuild(slim, r) for k, r in refs.items()}
    return {k: f for k, f in out.items() if len(f) >= 3}


def _edges(f: Face) -> list[tuple]:
    return [(a, b) if a <= b else (b, a) for a, b in zip(f, f[1:] + f[:1], strict=True)]


class _Counted:
    """:func:`merge_small` over different faces with the number of copies of each, numbered by (area, face) and then by copy.

    Copies see the same neighbours: if one isn't merged the others aren't either, so work follows the different faces.
    Merging takes copies from the front; a merged face keeps the place of the copy that it came from.
    """

    def __init__(self, faces: list[Face], counts: list[int], least: float) -> None:
        self.rings, self.left, self.least = list(faces), list(counts), least
        self.areas = [abs(signed_area(f)) for f in faces]
        self.front = [0] * len(faces)
        self.homes: list[tuple[int, int]] = []  # of merged faces: the copy that each was
        self.born: dict[int, list[tuple[int, int]]] = {c: [] for c in range(len(faces))}  # merged faces whose turn is to come
        # Only edges of small faces are asked for, or of what is left where they lie over larger ones; others are looked up in all faces.
        self.users: dict[tuple, set[int]] = {e: set() for f, a in zip(faces, self.areas, strict=True) if a < 4 * least for e in _edges(f)}
        self.n = len(faces)
        for k, f in enumerate(faces):
            self._use(k, f)

    def _use(self, k: int, f: Face) -> None:
        for e in _edges(f):
            if e in self.users:
                self.users[e].add(k)

    def run(self) -> None:
        for c in range(self.n):
            at, born = -1, self.born[c]
            while born or self.left[c]:
                if born:
                    rank, k = heapq.heappop(born)
                    if rank > at and self.left[k]:
                        at = rank
                        self._attempt(k)
                    continue
                at = self.front[c]
                if not self._attempt(c):
                    break
            del self.born[c]

    def _place(self, k: int) -> tuple[int, int]:
        """Of the first copy, negative: the earliest is the largest."""
        c, rank = (k, self.front[k]) if k < self.n else self.homes[k - self.n]
        return -c, -rank

    def _attempt(self, k: int) -> bool:
        if not self.left[k] or self.areas[k] >= self.least:
            return False
        f = self.rings[k]
        for e in _edges(f):
            if e not in self.users:
                self.users[e] = {j for j, g in enumerate(self.rings) if self.left[j] and e in _edges(g)}
        by_edge = [self.users[e] for e in _edges(f)]
        near = set().union(*by_edge)
        if self.left[k] < 2:
            near = near - {k}
        if not near:
            return False
        local = [self.rings[j] for j in near | {k}]
        node = _nodes(local, set(f))
        if len(set(f)) == len(f):
            # an arc is used by the faces of any of its edges
            starts = [u for p, u in zip(f, by_edge, strict=True) if p in node] or by_edge[:1]
            shared = {j: sum(j in u for u in starts) for j in near}
        else:
            own = sorted(near | {k})
            _, refs = arcs({at: self.rings[at] for at in own})
            plain = {at: {r if r >= 0 else -r - 1 for r in refs[at]} for at in own}
            shared = {j: len(plain[k] & plain[j]) for j in near}
            shared = {j: n for j, n in shared.items() if n}
        if not shared:
            return False
        j = max(shared, key=lambda j: (self.areas[j] >= self.least, shared[j], self.areas[j], self._place(j)))
        if shared[j] != 1 or j == k:
            return False  # a face and its copy have nothing left when joined
        made, refs = _split({k: f, j: self.rings[j]}, _nodes(local, {*f, *self.rings[j]}))
        theirs = {r if r >= 0 else -r - 1 for r in refs[j]}
        merged = _joined(made, refs[k], refs[j], next(r for r in refs[k] if (r if r >= 0 else -r - 1) in theirs))
        if not merged or len(merged) < 3:
            return False
        self._take(k)
        home = self._take(j)
        self.homes.append(home)
        if home[0] in self.born:
            heapq.heappush(self.born[home[0]], (home[1], len(self.rings)))
        self.rings.append(merged)
        self.left.append(1)
        self.areas.append(abs(signed_area(merged)))
        self.front.append(0)
        self._use(len(self.rings) - 1, merged)
        return True

    def _take(self, k: int) -> tuple[int, int]:
        home = (k, self.front[k]) if k < self.n else self.homes[k - self.n]
        self.front[k] += 1
        self.left[k] -= 1
        if not self.left[k]:
            for e in _edges(self.rings[k]):
                if e in self.users:
                    self.users[e].discard(k)
        return home


def slim(faces: list[Face], tolerance: float, low: int, high: int) -> list[Face]:
    """Open faces with their arcs simplified. Nodes are found for all at once; faces of nodes only stay as they are."""
    if not faces:
        return []
    size = np.array([len(f) for f in faces])
    flat = np.array([p for f in faces for p in f], np.int64)
    _, u = np.unique((flat[:, 0] << 20) + flat[:, 1], return_inverse=True)
    owner, first = np.repeat(np.arange(len(faces)), size), np.cumsum(size) - size
    after = np.arange(len(u)) + 1
    after[first + size - 1] = first
    v, m = u[after], int(u.max()) + 1
    edge, at = np.unique(np.minimum(u, v) * m + np.maximum(u, v), return_inverse=True)
    # users of an edge, told apart by the sum of random numbers of its faces
    pairs = np.unique(at * np.int64(len(faces)) + owner)
    mark = np.zeros(len(edge), np.uint64)
    np.add.at(mark, pairs // len(faces), np.random.default_rng(7).integers(0, 1 << 63, len(faces), np.uint64)[pairs % len(faces)])
    ways, of = np.unique(np.concatenate([u * m + v, v * m + u]), return_index=True)
    start, edge_of = ways // m, np.concatenate([at, at])[of]
    node = np.bincount(start, minlength=m) != 2
    two = ~node[start]
    a, b = edge_of[two].reshape(-1, 2).T
    node[start[two][::2]] = mark[a] != mark[b]
    inner = ~node[u]
    before = np.arange(len(u)) - 1
    before[first] = first + size - 1
    (ax, ay), (bx, by), (cx, cy) = flat[before].T, flat.T, flat[after].T
    # Weights never fall as vertices go: where none begins below the tolerance, all stay. The ends of a closed arc can go too.
    ends = np.bincount(owner, node[u], len(faces))
    closed = (ends < 2) | (np.bincount(np.unique(owner * np.int64(m) + u) // m, minlength=len(faces)) < size)
    weak = (inner | closed[owner]) & (np.sqrt(np.abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay)) / 2) * 0.65 < tolerance)
    out, known = list(faces), {}
    slow = set(owner[weak].tolist())
    for k in np.unique(owner[inner]).tolist():
        f, skips = faces[k], inner[first[k] : first[k] + size[k]].tolist()
        if k not in slow:
            start = min(range(len(f)), key=f.__getitem__) if all(skips) else skips.index(False)
            out[k] = f[start:] + f[:start]
            continue
        ring: Face = []
        for r in _runs(f, {p for p, skip in zip(f, skips, strict=True) if not skip}):
            if len(r) > 2:
                forward, back = tuple(r), tuple(reversed(r))
                if forward not in known and back not in known:
                    known[forward] = simplify_arcs([r], tolerance, low, high)[0]
                r = known[forward] if forward in known else known[back][::-1]
            ring += r[:-1]
        out[k] = ring
    return out


def tidy_counted(faces: list[Face], counts: list[int], tolerance: float, low: int, high: int, least: float = 4.0) -> list[tuple[int, int, int, Face]]:
    """:func:`tidy` over different faces with their copies: (face, copy, last, ring); a face's ``last`` stands for all its copies from there on."""
    order = sorted(range(len(faces)), key=lambda k: (abs(signed_area(opened(faces[k]))), faces[k]))
    merged = _Counted([opened(faces[k]) for k in order], [counts[k] for k in order], least)
    merged.run()
    kept = [k for k, n in enumerate(merged.left) if n]
    done = slim([merged.rings[k] for k in kept], tolerance, low, high)
    out = []
    for k, ring in zip(kept, done, strict=True):
        c, rank = (k, merged.front[k]) if k < merged.n else merged.homes[k - merged.n]
        if len(ring) >= 3:
            out.append((order[c], rank, merged.front[c], ring))
    return out
