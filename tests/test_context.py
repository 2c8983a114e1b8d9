"""Token windows against plain Python, lexical atoms and snippets on small texts."""

from __future__ import annotations

import random
import re
import unicodedata

from findrift.functions import context


def plain_window(text: str, start: int, end: int, limit: int):
    found = [(n, unicodedata.normalize("NFC", t)) for n, line in enumerate(text.split("\n"), 1) for t in re.findall(r"[_0-9A-Za-z\u0080-\U0010ffff]+|[^\s]", line)]
    before, inside, after = [t for n, t in found if n < start], [t for n, t in found if start <= n <= end], [t for n, t in found if n > end]
    if len(inside) > limit:
        return None
    left = limit - len(inside)
    x, y = left // 2, left - left // 2
    if len(before) < x:
        x, y = len(before), left - len(before)
    if len(after) < y:
        x, y = min(len(before), left - len(after)), len(after)
    chosen = before[len(before) - x :] + inside + after[:y]
    return context.vhash("token-window/v1", *chosen) if chosen else None


def test_token_windows():
    rng = random.Random(8)
    for _ in range(300):
        text = "\n".join(" ".join(rng.choice(["a_1", "b", "(", ")", "é", "x+y", "1.5"]) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 12)))
        start = rng.randrange(1, 12)
        end, limit = start + rng.randrange(3), rng.choice([1, 4, 9, 50])
        assert context.token_window(text, start, end, limit)[0] == plain_window(text, start, end, limit)
    assert context.token_window("a b c d", 1, 1, 3) == (None, "CANON0011")


def test_snippets_are_clamped():
    lines = ["1", "2", "3", "4"]
    assert context.snippet(lines, 2, None, 1) == "1\n2\n3"
    assert context.snippet(lines, 4, 9, 1) == "3\n4"
    assert context.snippet(lines, 5, None, 1) is None


def test_lexical_atoms():
    text = "class A {\n  int run(int a) {\n    call(a); // note\n    call(a);\n    other(\n      a);\n  }\n}"
    atoms = context.lexical_atoms(text)
    assert atoms[2][0] and atoms[2] == atoms[3]  # one statement under one header, comments apart
    assert atoms[1] == (None, "brace-on-line") and atoms[0] == (None, "brace-on-line")
    assert context.lexical_atoms("x = 1;")[0] == (None, "no-scope")
    moved = context.lexical_atoms("class A {\n\n\n  int run(int a) {\n\n    call(a);\n  }\n}")
    assert moved[5] == atoms[2]
    renamed = context.lexical_atoms(text.replace("run", "walk"))
    assert renamed[2][0] not in (None, atoms[2][0])
    assert context.lexical_atoms('f() {\n s = "open\n}')[1] == (None, "unterminated")
