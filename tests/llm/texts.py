from __future__ import annotations

import random


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))


def without_later_windows(rows):
    """Of rows (id, text), by (id, text): the text without lines of later windows that no first window holds, and how many went."""
    import hashlib

    order = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()[:15]))
    places = {}
    for n, (_, text) in enumerate(order):
        lines = text.split("\n")
        for k, pair in enumerate(zip(lines, lines[1:])):
            if any(x.strip() for x in pair):
                places.setdefault(pair, []).append((n, k))
    own = {(p[0][0], p[0][1] + d) for p in places.values() if len(p) > 1 for d in (0, 1)}
    gone = {(n, k + d) for p in places.values() for n, k in p[1:] for d in (0, 1)} - own
    return {(i, text): ("\n".join(x for k, x in enumerate(text.split("\n")) if (n, k) not in gone), sum(g == n for g, _ in gone)) for n, (i, text) in enumerate(order)}
