"""The sweep against the plain loop."""

import random
import time

import numpy as np

from tessera.operators import catalog, layouts, merging


def plain(boxes):
    boxes = list(boxes)
    again = True
    while again:
        again = False
        for i in range(len(boxes)):
            for j in range(i + 1, len(boxes)):
                a, b = boxes[i], boxes[j]
                if a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]:
                    boxes[i] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
                    del boxes[j]
                    again = True
                    break
            if again:
                break
    return sorted(boxes)


def test_equals_the_plain_loop():
    draw = random.Random(4)
    for n in range(400):
        side = draw.choice([10, 40, 200])
        boxes = []
        for _ in range(draw.randrange(1, 25)):
            x, y = draw.randrange(side), draw.randrange(side)
            boxes.append((x, y, x + draw.randrange(1, 12), y + draw.randrange(1, 12)))
        assert [tuple(r) for r in merging.fixed_point(np.array(boxes)).tolist()] == plain(boxes), boxes
    assert len(merging.fixed_point(np.empty((0, 4), int))) == 0


def test_a_merged_box_reaches_back():
    """The box around two covers one that the sweep has left."""
    boxes = [(0, 0, 2, 2), (3, 10, 20, 12), (19, 0, 22, 11)]
    assert plain(boxes) == [(3, 0, 22, 12), (0, 0, 2, 2)][::-1]
    boxes = [(4, 0, 6, 2), (3, 10, 20, 12), (19, 0, 22, 11)]
    assert [tuple(r) for r in merging.fixed_point(np.array(boxes)).tolist()] == plain(boxes) == [(3, 0, 22, 12)]


def test_many_boxes_of_one_frame():
    draw = np.random.default_rng(1)
    x, y = draw.integers(0, 100_000, (2, 100_000))
    boxes = np.stack((x, y, x + draw.integers(1, 60, 100_000), y + draw.integers(1, 60, 100_000)), axis=1)
    start = time.time()
    found = merging.fixed_point(boxes)
    assert time.time() - start < 20
    assert merging._sweep([tuple(b) for b in found.tolist()])[1] is False and len(found) < 100_000


def test_repeated_intervals_are_counted_not_listed():
    """Cuts by counts are those by the list of all intervals."""
    draw = random.Random(9)
    for _ in range(300):
        whole = draw.choice([1280, 1920])
        own = []
        for _ in range(draw.randrange(1, 7)):
            s = draw.randrange(0, whole - 40)
            own += [(s, min(whole, s + draw.randrange(0, 400)))] * draw.choice([1, 1, 2, 5])
        counted = [(s, e, own.count((s, e))) for s, e in set(own)]
        assert layouts.cut_around(counted, 256, whole) == layouts.cut_around(own, 256, whole), own


def test_islands_across_stretches(spark, monkeypatch):
    draw = random.Random(3)
    rows = sorted({(f"v{draw.randrange(2)}", f) for f in range(200) if draw.random() < 0.9 for _ in range(2)})
    rows = [(v, f, (f // 23) % 2) for v, f in rows]
    for stretch in (1, 3, 16, 4096):
        monkeypatch.setattr(catalog, "STRETCH", stretch)
        got = {(r["video"], r["first"], r["last"], r["value"]) for r in catalog.islands(spark.createDataFrame(rows, "video string, frame int, value int"), "frame", "value").collect()}
        want = set()
        for v in ("v0", "v1"):
            own, start = [r for r in rows if r[0] == v], 0
            for i in range(1, len(own) + 1):
                if i == len(own) or own[i][1] != own[i - 1][1] + 1 or own[i][2] != own[i - 1][2]:
                    want.add((v, own[start][1], own[i - 1][1], own[start][2]))
                    start = i
        assert got == want
