"""Geometry kernels over numpy arrays, without Spark: triangulation, simplification, clipping, areas, the tile codec."""

from __future__ import annotations

import heapq
import math
import struct

import numpy as np

Ring = list[tuple[float, float]]


def signed_area(ring: Ring) -> float:
    n = len(ring)
    return sum(ring[k][0] * ring[(k + 1) % n][1] - ring[(k + 1) % n][0] * ring[k][1] for k in range(n)) / 2


def opened(ring: Ring) -> Ring:
    """Without the closing vertex."""
    return ring[:-1] if len(ring) > 1 and tuple(ring[0]) == tuple(ring[-1]) else list(ring)


def point_in_ring(x: float, y: float, ring: Ring) -> bool:
    """Even-odd ray casting, half-open in y."""
    inside = False
    n = len(ring)
    for k in range(n):
        (x1, y1), (x2, y2) = ring[k], ring[(k + 1) % n]
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def interior_point(ring: Ring) -> tuple[float, float]:
    """The middle of the widest inner gap of the scanline at half height."""
    ring = opened(ring)
    ys = [p[1] for p in ring]
    y = (min(ys) + max(ys)) / 2
    if y in ys:
        y += (max(ys) - min(ys)) * 1e-4 or 1e-12
    n = len(ring)
    xs = sorted((x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in ((ring[k], ring[(k + 1) % n]) for k in range(n)) if (y1 > y) != (y2 > y))
    if len(xs) < 2:
        return sum(p[0] for p in ring) / n, sum(ys) / n
    a, b = max(zip(xs[::2], xs[1::2], strict=False), key=lambda p: p[1] - p[0])
    return (a + b) / 2, y


def _cross(o: tuple, a: tuple, b: tuple) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _bridge(shell: Ring, hole: Ring) -> Ring:
    """The shell with a hole spliced in at a vertex that its rightmost vertex sees."""
    m = max(range(len(hole)), key=lambda k: hole[k])
    hx, hy = hole[m]
    best, at, n = math.inf, None, len(shell)
    for k in range(n):
        (x1, y1), (x2, y2) = shell[k], shell[(k + 1) % n]
        if (y1 > hy) != (y2 > hy):
            x = x1 + (hy - y1) * (x2 - x1) / (y2 - y1)
            if hx <= x < best:
                best, at = x, k if x1 > x2 else (k + 1) % n
    if at is None:
        on = [k for k in range(n) if shell[k][1] == hy and shell[k][0] >= hx]
        at = min(on, key=lambda k: shell[k][0]) if on else max(range(n), key=lambda k: shell[k])
    else:
        # a reflex vertex inside the triangle hides the chosen one; the one of the smallest angle is seen
        tri = ((hx, hy), (best, hy), shell[at])
        seen = [k for k in range(n) if shell[k] != shell[at] and shell[k][0] >= hx and _in_triangle(shell[k], *tri)]
        if seen:
            at = min(seen, key=lambda k: (abs(shell[k][1] - hy) / max(1e-300, shell[k][0] - hx), shell[k][0]))
    turned = hole[m:] + hole[:m]
    return shell[: at + 1] + turned + [turned[0], shell[at]] + shell[at + 1 :]


def _in_triangle(p: tuple, a: tuple, b: tuple, c: tuple) -> bool:
    s = (_cross(a, b, p), _cross(b, c, p), _cross(c, a, p))
    return all(v >= 0 for v in s) or all(v <= 0 for v in s)


def triangulate(rings: list[Ring]) -> list[tuple[float, ...]]:
    """Triangles (x1, y1, x2, y2, x3, y3) of a polygon, the first ring its shell; rings of fewer than three vertices don't count."""
    own = [opened([tuple(p) for p in r]) for r in rings]
    if not own or len(own[0]) < 3:
        return []
    shell = own[0] if signed_area(own[0]) > 0 else own[0][::-1]
    holes = [h if signed_area(h) < 0 else h[::-1] for h in own[1:] if len(h) >= 3]
    for h in sorted(holes, key=lambda h: max(h), reverse=True):
        shell = _bridge(shell, h)
    nxt = [(k + 1) % len(shell) for k in range(len(shell))]
    prv = [(k - 1) % len(shell) for k in range(len(shell))]
    out, left, k, stuck = [], len(shell), 0, 0
    while left > 3 and stuck <= left:
        a, b, c = prv[k], k, nxt[k]
        turn = _cross(shell[a], shell[b], shell[c])
        ear = turn > 0
        if ear:
            j = nxt[c]
            while j != a:
                p = shell[j]
                if p not in (shell[a], shell[b], shell[c]) and _in_triangle(p, shell[a], shell[b], shell[c]):
                    ear = False
                    break
                j = nxt[j]
        if ear or turn == 0:
            if ear:
                out.append((*shell[a], *shell[b], *shell[c]))
            nxt[a], prv[c] = c, a
            left -= 1
            k, stuck = c, 0
        else:
            k, stuck = c, stuck + 1
    if left == 3:
        out.append((*shell[prv[k]], *shell[k], *shell[nxt[k]]))
    return [t for t in out if _cross(t[:2], t[2:4], t[4:]) != 0]


def simplify_weights(points: np.ndarray, closed: bool = False, pinned: np.ndarray | None = None) -> np.ndarray:
    """Visvalingam-Whyatt: sqrt(area) * 0.65 at which each vertex goes, never falling as they go; infinite for ends and pinned ones."""
    n = len(points)
    out = np.full(n, np.inf)
    if n < 3:
        return out
    prv, nxt = np.arange(-1, n - 1), np.arange(1, n + 1)
    if closed:
        prv[0], nxt[-1] = n - 1, 0
    fixed = np.zeros(n, bool) if pinned is None else pinned.copy()
    if not closed:
        fixed[[0, -1]] = True
    x, y = points[:, 0], points[:, 1]
    area = lambda k: abs((x[k] - x[prv[k]]) * (y[nxt[k]] - y[prv[k]]) - (x[nxt[k]] - x[prv[k]]) * (y[k] - y[prv[k]])) / 2
    now = {k: area(k) for k in range(n) if not fixed[k]}
    heap = [(a, k) for k, a in now.items()]
    heapq.heapify(heap)
    most, left = 0.0, n
    while heap and left > (3 if closed else 2):
        a, k = heapq.heappop(heap)
        if now.get(k) != a:
            continue
        del now[k]
        most = max(most, a)
        out[k] = math.sqrt(most) * 0.65
        p, q = prv[k], nxt[k]
        nxt[p], prv[q] = q, p
        left -= 1
        for j in (p, q):
            if j in now:
                now[j] = area(j)
                heapq.heappush(heap, (now[j], j))
    return out


def douglas_peucker(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Mask of the vertices that stay."""
    keep = np.zeros(len(points), bool)
    if not len(points):
        return keep
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, q, m = points[a], points[b], points[a + 1 : b]
        d = q - p
        n = math.hypot(*d)
        dist = np.abs(d[0] * (m[:, 1] - p[1]) - d[1] * (m[:, 0] - p[0])) / n if n else np.hypot(*(m - p).T)
        k = int(dist.argmax())
        if dist[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def clip_ring(ring: Ring, minx: float, miny: float, maxx: float, maxy: float) -> Ring:
    """Sutherland-Hodgman against a rectangle: one ring, which may run along the border twice."""
    out = opened(ring)
    for axis, bound, low in ((0, minx, True), (0, maxx, False), (1, miny, True), (1, maxy, False)):
        src, out = out, []
        for k in range(len(src)):
            a, b = src[k - 1], src[k]
            ain, bin_ = (a[axis] >= bound, b[axis] >= bound) if low else (a[axis] <= bound, b[axis] <= bound)
            if ain != bin_:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                p = [a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])]
                p[axis] = bound
                out.append((p[0], p[1]))
            if bin_:
                out.append(tuple(b))
    return out


def clip_polygon(ring: Ring, minx: float, miny: float, maxx: float, maxy: float) -> list[Ring]:
    """Exact parts of a simple ring in a rectangle, without bridges along the border.

    The runs of the boundary inside the rectangle are joined along the border, each exit to the next entry in the sense
    of the ring.
    """
    ring = opened(ring)
    if len(ring) < 3:
        return []
    if signed_area(ring) < 0:
        ring = ring[::-1]
    if all(minx <= x <= maxx and miny <= y <= maxy for x, y in ring):
        return [ring]
    runs: list[Ring] = []
    run: Ring = []
    n = len(ring)
    for k in range(n):
        cut = _clip_edge(ring[k], ring[(k + 1) % n], minx, miny, maxx, maxy)
        if cut is None:
            if len(run) > 1:
                runs.append(run)
            run = []
            continue
        p, q = cut
        if run and run[-1] != p:
            runs.append(run)
            run = []
        run = run or [p]
        if q != run[-1]:
            run.append(q)
    if len(run) > 1:
        if runs and runs[0][0] == run[-1]:
            runs[0] = run[:-1] + runs[0]
        else:
            runs.append(run)
    if not runs:
        return [[(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy)]] if point_in_ring((minx + maxx) / 2, (miny + maxy) / 2, ring) else []
    w, h = maxx - minx, maxy - miny

    def place(p: tuple) -> float:
        x, y = p
        d = [(abs(y - miny), x - minx), (abs(x - maxx), w + y - miny), (abs(y - maxy), w + h + maxx - x), (abs(x - minx), 2 * w + h + maxy - y)]
        return min(d)[1]

    corners = [(0.0, (minx, miny)), (w, (maxx, miny)), (w + h, (maxx, maxy)), (2 * w + h, (minx, maxy))]
    around = 2 * (w + h)
    starts = [place(r[0]) for r in runs]
    used, out = [False] * len(runs), []
    for first in range(len(runs)):
        if used[first]:
            continue
        k, made = first, []
        while not used[k]:
            used[k] = True
            made += runs[k]
            end = place(runs[k][-1])
            k = min((j for j in range(len(runs)) if not used[j] or j == first), key=lambda j: (starts[j] - end) % around)
            made += [c for _, c in sorted(((s - end) % around, c) for s, c in corners if 0 < (s - end) % around < (starts[k] - end) % around)]
        clean = [p for j, p in enumerate(made) if p != made[j - 1]]
        # Seen from its first vertex: far from the origin the area of a sliver would be lost in rounding.
        if len(clean) >= 3 and signed_area([(x - clean[0][0], y - clean[0][1]) for x, y in clean]) != 0:
            out.append(clean)
    return out


def _clip_edge(a: tuple, b: tuple, minx: float, miny: float, maxx: float, maxy: float) -> tuple | None:
    t0, t1, d = 0.0, 1.0, (b[0] - a[0], b[1] - a[1])
    for p, q in ((-d[0], a[0] - minx), (d[0], maxx - a[0]), (-d[1], a[1] - miny), (d[1], maxy - a[1])):
        if p == 0:
            if q < 0:
                return None
        elif p < 0:
            t0 = max(t0, q / p)
        else:
            t1 = min(t1, q / p)
    if t0 >= t1:
        return _grazed(a, b, minx, miny, maxx, maxy)
    snap = lambda t: a if t == 0 else b if t == 1 else (min(maxx, max(minx, a[0] + t * d[0])), min(maxy, max(miny, a[1] + t * d[1])))
    return tuple(snap(t0)), tuple(snap(t1))


def _grazed(a: tuple, b: tuple, minx: float, miny: float, maxx: float, maxy: float) -> tuple | None:
    """The part of an edge with one end inside, nearer to the border than its share of the edge can tell: from the border to that end."""
    inner = [minx < p[0] < maxx and miny < p[1] < maxy for p in (a, b)]
    if inner[0] == inner[1]:
        return None
    near, far = (a, b) if inner[0] else (b, a)
    on = list(near)
    for axis, low, high in ((0, minx, maxx), (1, miny, maxy)):
        bound = low if far[axis] < low else high if far[axis] > high else None
        if bound is not None and (bound - far[axis]) / (near[axis] - far[axis]) >= 1:
            on[axis] = bound
    on = tuple(on)
    return (tuple(near), on) if inner[0] else (on, tuple(near))


def encode_tile(verts: np.ndarray, rings: list[tuple[int, int, int, int, int]], cover: list[tuple[int, int]], before: tuple[int, int] = (0, 0)) -> bytes:
    """Vertices (n by 2, int16) as zigzag varints of steps, rings (type, hole, first, count, group), coverage (cell, count).

    ``before`` is the vertex before the first one, in a run that goes on another.
    """
    steps = np.diff(verts.astype(np.int64), axis=0, prepend=np.array([before])).ravel()
    out = bytearray(struct.pack("<III", len(verts), len(rings), len(cover)))
    for z in ((steps << 1) ^ (steps >> 63)).tolist():
        while z >= 0x80:
            out.append(z & 0x7F | 0x80)
            z >>= 7
        out.append(z)
    for r in rings:
        out += struct.pack("<BBIIi", *r)
    for c in cover:
        out += struct.pack("<IH", *c)
    return bytes(out)


def decode_tile(data: bytes, before: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, list[tuple], list[tuple]]:
    """The inverse of :func:`encode_tile`; raises ValueError on data that ends early or is too long."""
    try:
        n, k, c = struct.unpack_from("<III", data)
        at, values = 12, []
        for _ in range(2 * n):
            z = shift = 0
            while True:
                b = data[at]
                at += 1
                z |= (b & 0x7F) << shift
                shift += 7
                if b < 0x80:
                    break
            values.append((z >> 1) ^ -(z & 1))
        rings = [struct.unpack_from("<BBIIi", data, at + 14 * j) for j in range(k)]
        at += 14 * k
        cover = [struct.unpack_from("<IH", data, at + 6 * j) for j in range(c)]
        at += 6 * c
    except (IndexError, struct.error) as e:
        raise ValueError("the tile ends early") from e
    if at != len(data):
        raise ValueError("the tile has more bytes than it states")
    return (np.cumsum(np.array(values, np.int64).reshape(-1, 2), axis=0) + before).astype(np.int16), rings, cover


def fill_mask(triangles: np.ndarray, size: int, cell: float = 1.0) -> np.ndarray:
    """size by size cells whose centres lie in some triangle."""
    mask = np.zeros((size, size), bool)
    for x1, y1, x2, y2, x3, y3 in np.asarray(triangles, float).reshape(-1, 6):
        c0, c1 = max(0, math.ceil(min(x1, x2, x3) / cell - 0.5)), min(size - 1, math.floor(max(x1, x2, x3) / cell - 0.5))
        r0, r1 = max(0, math.ceil(min(y1, y2, y3) / cell - 0.5)), min(size - 1, math.floor(max(y1, y2, y3) / cell - 0.5))
        if c1 < c0 or r1 < r0:
            continue
        x, y = (np.arange(c0, c1 + 1) + 0.5) * cell, ((np.arange(r0, r1 + 1) + 0.5) * cell)[:, None]
        s = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for ax, ay, bx, by in ((x1, y1, x2, y2), (x2, y2, x3, y3), (x3, y3, x1, y1))]
        mask[r0 : r1 + 1, c0 : c1 + 1] |= ((s[0] >= 0) & (s[1] >= 0) & (s[2] >= 0)) | ((s[0] <= 0) & (s[1] <= 0) & (s[2] <= 0))
    return mask


def hole_cells(mask: np.ndarray) -> int:
    """Uncovered cells that a flood from the border over uncovered cells doesn't reach."""
    n, m = mask.shape
    seen = np.zeros_like(mask)
    stack = [(r, c) for r in range(n) for c in range(m) if (r in (0, n - 1) or c in (0, m - 1)) and not mask[r, c]]
    for p in stack:
        seen[p] = True
    while stack:
        r, c = stack.pop()
        for a, b in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
            if 0 <= a < n and 0 <= b < m and not mask[a, b] and not seen[a, b]:
                seen[a, b] = True
                stack.append((a, b))
    return int((~mask & ~seen).sum())


def buffer_ring(points: Ring, distance: float, closed: bool, sides: int = 8, cap: str = "round", join: str = "round") -> list[Ring]:
    """Convex pieces whose union is the buffer of a line or ring outline: a box for each edge and a joint for each vertex."""
    out: list[Ring] = []
    pts = opened(points) if closed else list(points)
    n = len(pts)
    edges = [(pts[k], pts[(k + 1) % n]) for k in range(n if closed and n > 1 else n - 1)]
    for k, ((x1, y1), (x2, y2)) in enumerate(edges):
        length = math.hypot(x2 - x1, y2 - y1)
        if not length:
            continue
        ux, uy = (x2 - x1) / length * distance, (y2 - y1) / length * distance
        a, b = (x1, y1), (x2, y2)
        if cap == "square" and not closed:
            a = (x1 - ux, y1 - uy) if k == 0 else a
            b = (x2 + ux, y2 + uy) if k == len(edges) - 1 else b
        out.append([(a[0] + uy, a[1] - ux), (b[0] + uy, b[1] - ux), (b[0] - uy, b[1] + ux), (a[0] - uy, a[1] + ux)])
    for k, (x, y) in enumerate(pts):
        end = not closed and k in (0, n - 1)
        if n > 1 and ((end and cap != "round") or (not end and join != "round")):
            if not end:
                out += _joint(pts[k - 1], pts[k], pts[(k + 1) % n], distance, join)
            continue
        out.append([(x + distance * math.cos(2 * math.pi * j / (4 * sides)), y + distance * math.sin(2 * math.pi * j / (4 * sides))) for j in range(4 * sides)])
    return out


def _joint(a: tuple, b: tuple, c: tuple, distance: float, join: str, limit: float = 5.0) -> list[Ring]:
    """The wedge outside a corner: a triangle for a bevel, a kite for a mitre within the limit."""
    la, lc = math.hypot(b[0] - a[0], b[1] - a[1]), math.hypot(c[0] - b[0], c[1] - b[1])
    if not la or not lc:
        return []
    turn = _cross(a, b, c)
    if turn == 0:
        return []
    s = distance if turn > 0 else -distance
    p = (b[0] + (b[1] - a[1]) / la * s, b[1] - (b[0] - a[0]) / la * s)
    q = (b[0] + (c[1] - b[1]) / lc * s, b[1] - (c[0] - b[0]) / lc * s)
    if join == "miter":
        mx, my = p[0] + q[0] - 2 * b[0], p[1] + q[1] - 2 * b[1]
        m = math.hypot(mx, my)
        if m:
            reach = 2 * distance * distance / m
            if reach <= limit * distance:
                return [[b, p, (b[0] + mx / m * reach, b[1] + my / m * reach), q]]
    return [[b, p, q]]


def sum_below(px: np.ndarray, py: np.ndarray, weight: np.ndarray, qx: np.ndarray, qy: np.ndarray, equal_x: bool, equal_y: bool) -> np.ndarray:
    """For each (qx, qy) the weights of the points below it in both coordinates, equal ones included or not, in n log n.

    Points in order of x are split by the bits of their y's rank, highest first; a query follows its own rank and takes the zeros where it has a one.
    """
    order = np.argsort(px, kind="stable")
    ranks = np.unique(py)
    at = np.searchsorted(px[order], qx, "right" if equal_x else "left")
    upto = np.searchsorted(ranks, qy, "right" if equal_y else "left")
    y, w, first, out = np.searchsorted(ranks, py[order]), weight[order], np.zeros_like(at), np.zeros(len(qx), np.int64)
    for bit in reversed(range(len(ranks).bit_length())):
        one, up = (y >> bit & 1).astype(bool), (upto >> bit & 1).astype(bool)
        zeros, sums = (np.concatenate(([0], np.cumsum(v))) for v in (~one, np.where(one, 0, w)))
        out += np.where(up, sums[at] - sums[first], 0)
        at, first = (np.where(up, zeros[-1] + v - zeros[v], zeros[v]) for v in (at, first))
        split = np.argsort(one, kind="stable")
        y, w = y[split], w[split]
    return out


def overlap_sums(boxes: tuple[np.ndarray, ...], weight: np.ndarray, asked: tuple[np.ndarray, ...]) -> np.ndarray:
    """For each asked box (minx, miny, maxx, maxy) the weights of the boxes that overlap or touch it; no box may be turned inside out."""
    a, b, c, e = boxes
    qa, qb, qc, qe = asked
    # in each axis: those that begin up to the end, less those that end before the beginning
    return sum_below(a, b, weight, qc, qe, True, True) - sum_below(a, e, weight, qc, qb, True, False) - sum_below(c, b, weight, qa, qe, False, True) + sum_below(c, e, weight, qa, qb, False, False)


def crosses_ray(px: np.ndarray, py: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """Whether edges cross the rays to the right of points; half-open in y, as ``geom.crosses_ray`` has it."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        return ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)


def _spread(at: np.ndarray, sizes: np.ndarray, most: int = 1 << 18):
    """Runs of rows with ``sizes`` members each, from ``at`` on: (slice of rows, row of each member within it, member); about ``most`` members at once."""
    upto = np.cumsum(sizes)
    begin = 0
    while begin < len(sizes):
        done = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, done + most, "right")))
        rows = np.repeat(np.arange(end - begin), sizes[begin:end])
        first = at[begin:end] - (upto[begin:end] - sizes[begin:end] - done)
        yield slice(begin, end), rows, np.arange(len(rows)) + first[rows]
        begin = end


def points_in_polygons(px: np.ndarray, py: np.ndarray, fid: np.ndarray, vx: np.ndarray, vy: np.ndarray, starts: np.ndarray, sizes: np.ndarray, leaf: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """How many points each polygon holds, even-odd, and the smallest fid of those (0 where there is none).

    Polygons are runs of ``sizes`` vertices; ``starts`` marks each ring's first one. Points are halved in turns by x and y. Where no edge meets the box of
    a half, one of its points speaks for all; only points in last halves that an edge meets are tested one by one. So work follows outlines, and
    results are those of testing every point. Polygons with open rings or missing coordinates have all points in their boxes tested.
    """
    n, first = np.zeros(len(sizes), np.int64), np.full(len(sizes), np.iinfo(np.int64).max)
    if len(px) == 0 or len(vx) == 0:
        return n, np.zeros(len(sizes), np.int64)
    depth = max(0, math.ceil(math.log2(len(px) / leaf)))
    cuts = [(np.arange((1 << k) + 1) * len(px)) >> k for k in range(depth + 1)]
    order = np.arange(len(px))
    for k in range(depth):
        order = order[np.lexsort(((py if k % 2 else px)[order], np.repeat(np.arange(1 << k), np.diff(cuts[k]))))]
    px, py, fid = px[order], py[order], fid[order]

    of = np.repeat(np.arange(len(sizes)), sizes)
    tail = np.flatnonzero(~starts[1:])
    x1, y1, x2, y2 = vx[tail], vy[tail], vx[tail + 1], vy[tail + 1]
    e_from = np.searchsorted(of[tail], np.arange(len(sizes) + 1))
    e_n, e_from = np.diff(e_from), e_from[:-1]
    ring = np.flatnonzero(starts)
    last = np.append(ring[1:], len(vx)) - 1
    odd = np.zeros(len(sizes), bool)
    odd[of[ring[(vx[ring] != vx[last]) | (vy[ring] != vy[last])]]] = True
    odd[of[~(np.isfinite(vx) & np.isfinite(vy))]] = True
    least, most = np.full((2, len(sizes)), np.inf), np.full((2, len(sizes)), -np.inf)
    for c, v in enumerate((vx, vy)):
        np.fmin.at(least[c], of, v)
        np.fmax.at(most[c], of, v)
    finite = np.concatenate([np.abs(c[np.isfinite(c)]) for c in (px, py, vx, vy)])
    near = 1e-9 * (1.0 + (finite.max() if len(finite) else 0.0))  # far over what rounding can move a crossing
    dx, dy = np.abs(x2 - x1), np.abs(y2 - y1)
    lx, hx, ly, hy = np.minimum(x1, x2) - near, np.maximum(x1, x2) + near, np.minimum(y1, y2) - near, np.maximum(y1, y2) + near

    def add(q: np.ndarray, count: np.ndarray, smallest: np.ndarray) -> None:
        np.add.at(n, q, count)
        np.minimum.at(first, q, smallest)

    top = min(2, depth)
    q, node = np.repeat(np.arange(len(sizes)), 1 << top), np.tile(np.arange(1 << top), len(sizes))
    for k in range(top, depth + 1):
        at = cuts[k][:-1]
        held, smallest = np.diff(cuts[k]), np.minimum.reduceat(fid, at)
        a, b, c, e = np.minimum.reduceat(px, at), np.minimum.reduceat(py, at), np.maximum.reduceat(px, at), np.maximum.reduceat(py, at)
        meets = (a[node] <= most[0][q]) & (c[node] >= least[0][q]) & (b[node] <= most[1][q]) & (e[node] >= least[1][q])
        q, node = q[meets], node[meets]
        cut = odd[q]
        for part, row, edge in _spread(e_from[q], e_n[q]):
            w = node[part][row]
            met = (lx[edge] <= c[w]) & (hx[edge] >= a[w]) & (ly[edge] <= e[w]) & (hy[edge] >= b[w])
            m, v = edge[met], w[met]
            off = (x2[m] - x1[m]) * ((b[v] + e[v]) / 2 - y1[m]) - (y2[m] - y1[m]) * ((a[v] + c[v]) / 2 - x1[m])
            met[met] = ~(np.abs(off) > dx[m] * ((e[v] - b[v]) / 2 + near) + dy[m] * ((c[v] - a[v]) / 2 + near))
            cut[part] |= np.bincount(row[met], minlength=part.stop - part.start) > 0
        free, free_node = q[~cut], node[~cut]
        for part, row, edge in _spread(e_from[free], e_n[free]):
            p = at[free_node[part]][row]
            inside = np.bincount(row[crosses_ray(px[p], py[p], x1[edge], y1[edge], x2[edge], y2[edge])], minlength=part.stop - part.start) % 2 == 1
            whole = free_node[part][inside]
            add(free[part][inside], held[whole], smallest[whole])
        q, node = q[cut], node[cut]
        if k < depth:
            q, node = np.repeat(q, 2), np.repeat(2 * node, 2) + np.tile((0, 1), len(q))
    at, held = cuts[depth][:-1], np.diff(cuts[depth])
    for part, row, p in _spread(at[node], held[node], 1 << 16):
        own = q[part][row]
        boxed = (px[p] >= least[0][own]) & (px[p] <= most[0][own]) & (py[p] >= least[1][own]) & (py[p] <= most[1][own])
        own, p = own[boxed], p[boxed]
        for some, pair, edge in _spread(e_from[own], e_n[own]):
            s = p[some][pair]
            inside = np.bincount(pair[crosses_ray(px[s], py[s], x1[edge], y1[edge], x2[edge], y2[edge])], minlength=some.stop - some.start) % 2 == 1
            add(own[some][inside], 1, fid[p[some][inside]])
    return n, np.where(n > 0, first, 0)
