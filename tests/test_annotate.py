"""Emphasised lines found in blocks, against plain containment."""

import random

from docforge.operators import layout


def test_lines_of_any_length_meet_the_blocks_that_hold_them(spark):
    rng = random.Random(3)
    words = ["a", "ab", "abc", "iron", "ironic", "é", "😀", "😀b", "x.y", "शब्द", "salt", "of"]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    blocks = [(d, s, said(rng.randint(0, 12)) or None, "H1" if s % 9 == 8 else "P") for d in range(4) for s in range(30)]
    blocks += [(9, 0, "salt " * 20000 + "end", "P"), (8, 0, "alone", "P")]
    lines = []
    for d in (0, 1, 2, 3, 9):
        for n in range(25):
            runs = [(said(1), rng.random() < 0.5, False) for _ in range(rng.randint(1, 3))]
            lines.append((d, n, rng.choice(["", "  "]) + said(rng.randint(0, 4)), runs))
    lines += [(9, 90, "lt end", [("lt", True, False)] * 5), (3, 91, None, [("x", True, False)])]
    got = layout.annotate(
        spark.createDataFrame(blocks, "doc_id long, seq long, content string, tag string"),
        spark.createDataFrame(lines, "doc_id long, line_no long, text string, runs array<struct<text: string, bold: boolean, italic: boolean>>"),
    ).collect()
    assert len(got) == len(blocks)
    found = 0
    for r in got:
        held = [(len(runs), -n, runs) for d, n, t, runs in lines if d == r.doc_id and (t or "").strip() and any(x[1] or x[2] for x in runs) and t.strip() in (r.content or "")]
        want = max(held, key=lambda h: h[:2])[2] if held and r.tag == "P" else None
        assert (r.runs and [tuple(x) for x in r.runs]) == want, r
        found += want is not None
    assert found > 50
