"""Position encodings against a plain walk over characters."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions.positions import ENCODINGS, Places, from_editor, to_editor

TEXTS = st.text("aé中\U0001f600\U00010348\r\n\t ́", max_size=30)


def units(c, encoding):
    return {"utf-8": len(c.encode()), "utf-32": 1}.get(encoding, 2 if ord(c) > 0xFFFF else 1)


def plain(text, encoding):
    """{byte offset: (line, unit)} of every place between characters, and the visible columns of each line."""
    found, at = {}, 0
    lines = text.split("\n")
    for n, line in enumerate(lines):
        seen = line if n == len(lines) - 1 else line + "\n"
        visible = seen.rstrip("\r\n")
        unit = 0
        for k, c in enumerate(seen):
            found[at] = (n, unit, k <= len(visible))
            if k < len(visible):
                unit += units(c, encoding)
            at += len(c.encode())
    found[at] = (len(lines) - 1, sum(units(c, encoding) for c in lines[-1].rstrip("\r")), True)
    return found


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.sampled_from([*ENCODINGS, "odd"]))
def test_places_equal_a_plain_walk(text, encoding):
    data, want = text.encode(), plain(text, encoding)
    places = Places(data, encoding)
    offsets = np.arange(-2, len(data) + 3)
    lines, cols = places.positions(offsets)
    assert [(a, b) for a, b in zip(lines.tolist(), cols.tolist())] == [want[o][:2] if o in want else (-1, -1) for o in offsets.tolist()]
    back = {}
    for o, (line, unit, visible) in want.items():
        if visible:
            back.setdefault((line, unit), o)
    asked = [(line, unit) for line in range(-1, text.count("\n") + 3) for unit in range(-1, 20)]
    got = places.offsets(np.array([a for a, _ in asked]), np.array([b for _, b in asked])).tolist()
    assert got == [back.get(p, -1) for p in asked]


def test_round_trips(spark):
    texts = [(1, "ab\r\né\U0001f600x\n", "utf-16"), (2, "é\U0001f600x", "utf-8"), (3, "é\U0001f600x", "utf-32"), (4, None, "utf-16"), (5, "no points", "utf-16")]
    frame = spark.createDataFrame(texts, "id int, text string, encoding string")
    points = [(1, 0, 1, 3), (1, 1, 1, 9), (1, 2, 2, 3), (1, 3, 2, 7), (1, 4, 2, 4), (1, 5, 3, 1), (1, 6, 4, 1), (1, 7, 0, 1), (2, 0, 1, 7), (3, 0, 1, 7), (4, 0, 1, 5)]
    got = {(r.id, r.point): (r.line, r.unit) for r in to_editor(frame, spark.createDataFrame(points, "id int, point int, line int, col int")).collect()}
    assert got == {(1, 0): (0, 2), (1, 1): (0, 2), (1, 2): (1, 1), (1, 3): (1, 3), (1, 4): (-1, -1), (1, 5): (2, 0), (1, 6): (-1, -1), (1, 7): (-1, -1), (2, 0): (0, 6), (3, 0): (0, 2), (4, 0): (0, 0)}
    back = spark.createDataFrame([(i, p, a, b) for (i, p), (a, b) in got.items() if a >= 0], "id int, point long, line long, unit long")
    again = {(r.id, r.point): (r.line, r.col) for r in from_editor(frame, back).collect()}
    assert {k: again[k] for k in ((1, 0), (1, 2), (1, 3), (2, 0), (3, 0))} == {(1, 0): (1, 3), (1, 2): (2, 3), (1, 3): (2, 7), (2, 0): (1, 7), (3, 0): (1, 7)}
    assert again[1, 1] == (1, 3)
    inside = spark.createDataFrame([(1, 0, 1, 2), (1, 1, 0, 3), (1, 2, 9, 0)], "id int, point int, line int, unit int")
    assert {(r.line, r.col) for r in from_editor(frame, inside).collect()} == {(-1, -1)}
