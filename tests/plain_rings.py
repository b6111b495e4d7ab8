"""Areas put together from one geometry's lines in plain Python: what the joins are held against."""

from collections import defaultdict

Point = tuple[int, int]


def _side(a: Point, b: Point, c: Point) -> int:
    d = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return (d > 0) - (d < 0)


def _cross(a: Point, b: Point, c: Point, d: Point) -> bool:
    """Whether two segments meet in a point that is not an end of both."""
    shared = {a, b} & {c, d}
    if len(shared) == 2:
        return True
    s = _side(a, b, c), _side(a, b, d), _side(c, d, a), _side(c, d, b)
    if shared:
        if any(s):
            return False
        p = shared.pop()
        q, r = (b if a == p else a), (d if c == p else c)
        return (q[0] - p[0]) * (r[0] - p[0]) + (q[1] - p[1]) * (r[1] - p[1]) > 0
    if s[0] * s[1] < 0 and s[2] * s[3] < 0:
        return True

    def on(u: Point, v: Point, w: Point, side: int) -> bool:
        return side == 0 and min(u[0], v[0]) <= w[0] <= max(u[0], v[0]) and min(u[1], v[1]) <= w[1] <= max(u[1], v[1])

    return on(a, b, c, s[0]) or on(a, b, d, s[1]) or on(c, d, a, s[2]) or on(c, d, b, s[3])


def _any_crossing(edges: list[tuple[Point, Point]]) -> bool:
    edges = sorted((min(e), max(e)) for e in edges)
    active: list[tuple[Point, Point]] = []
    for e in edges:
        active = [f for f in active if f[1][0] >= e[0][0]]
        low, high = min(e[0][1], e[1][1]), max(e[0][1], e[1][1])
        if any(min(f[0][1], f[1][1]) <= high and max(f[0][1], f[1][1]) >= low and _cross(*e, *f) for f in active):
            return True
        active.append(e)
    return False


def _inside(ring: list[Point], p: tuple[float, float]) -> bool:
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


def plain_shapes(lines: list[list[Point]]) -> list[dict] | None:
    """Shapes from lines that together close: segments met twice cancel, the rest chains to rings, and rings nest by what
    contains what. None where ends stay open, segments cross, or nothing is left. Rings start at their smallest
    point and run counter-clockwise outside and clockwise inside; shapes go by their outer ring."""
    seen: dict[tuple[Point, Point], int] = defaultdict(int)
    for line in lines:
        for a, b in zip(line, line[1:]):
            if a != b:
                seen[min(a, b), max(a, b)] += 1
    edges = sorted(e for e, n in seen.items() if n % 2)
    if not edges or _any_crossing(edges):
        return None
    meets: dict[Point, list[Point]] = defaultdict(list)
    for a, b in edges:
        meets[a].append(b)
        meets[b].append(a)
    if any(len(x) % 2 for x in meets.values()):
        return None
    rings = []
    for start in sorted(meets):
        while meets[start]:
            path, at = [start], {start: 0}
            while True:
                here = path[-1]
                there = min(meets[here])
                meets[here].remove(there)
                meets[there].remove(here)
                if there in at:
                    first = at[there]
                    rings.append([*path[first:], there])
                    for p in path[first + 1 :]:
                        at.pop(p)
                    path = path[: first + 1]
                    if first == 0 and (there == start and not meets[start] or len(path) == 1):
                        break
                else:
                    at[there] = len(path)
                    path.append(there)
    if any(len(r) < 4 for r in rings):
        return None

    def turned(ring: list[Point], left: bool) -> list[Point]:
        twice = sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:]))
        body = ring[:-1] if (twice > 0) == left else ring[:-1][::-1]
        i = body.index(min(body))
        body = body[i:] + body[:i]
        return [*body, body[0]]

    def area(ring: list[Point]) -> int:
        return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:])))

    def probe(ring: list[Point]) -> tuple[float, float]:
        (x1, y1), (x2, y2) = ring[0], ring[1]
        return (x1 + x2) / 2, (y1 + y2) / 2

    rings.sort(key=area, reverse=True)
    holders = [[j for j in range(i) if area(rings[j]) > area(r) and _inside(rings[j], probe(r))] for i, r in enumerate(rings)]
    shapes = {i: {"outer": turned(r, True), "inners": []} for i, r in enumerate(rings) if len(holders[i]) % 2 == 0}
    for i, r in enumerate(rings):
        if len(holders[i]) % 2:
            shapes[max(j for j in holders[i] if len(holders[j]) == len(holders[i]) - 1)]["inners"].append(turned(r, False))
    out = sorted(shapes.values(), key=lambda s: s["outer"])
    for s in out:
        s["inners"].sort()
    return out
