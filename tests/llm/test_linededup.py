from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from findrift.llm import linededup
from findrift.llm.common import table

from .helpers import docs


def brute_lost(texts: dict[int, str], min_words: int) -> dict[int, set[int]]:
    """Word numbers that stand in a window of ``min_words`` words which stands earlier too; in one text only lines after the first window's."""
    first: dict[tuple, tuple[int, int]] = {}
    lost: dict[int, set[int]] = {d: set() for d in texts}
    for d in sorted(texts):
        words = texts[d].split()
        line_of = [i for i, line in enumerate(texts[d].split("\n")) for _ in line.split()]
        for p in range(len(words) - min_words + 1):
            at = first.setdefault(tuple(words[p : p + min_words]), (d, p))
            if at != (d, p):
                last = line_of[at[1] + min_words - 1] if at[0] == d else -1
                lost[d] |= {w for w in range(p, p + min_words) if line_of[w] > last}
    return lost


def runs_of(lost: set[int]) -> list[tuple[int, int]]:
    """Maximal runs of word numbers."""
    out: list[list[int]] = []
    for w in sorted(lost):
        if out and w == out[-1][1] + 1:
            out[-1][1] = w
        else:
            out.append([w, w])
    return [tuple(r) for r in out]


def brute(texts: dict[int, str], min_words: int) -> dict[int, str]:
    lost = brute_lost(texts, min_words)
    return {d: linededup.cut_text(t, runs_of(lost[d]))[0] if lost[d] else t for d, t in texts.items()}


def run(spark, texts: dict[int, str | None], min_words: int) -> dict[int, str | None]:
    df = docs(spark, list(texts.values()), ids=list(texts))
    return {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df, min_words=min_words).collect()}


def test_against_brute_force(spark):
    rng = random.Random(7)
    unique = iter(range(10**6))

    def line() -> str:
        return " ".join(f"w{next(unique)}" for _ in range(rng.choice([1, 2, 5, 9])))

    shared = [[line() for _ in range(rng.randrange(1, 7))] for _ in range(12)]
    texts = {}
    for d in range(60):
        parts: list[str] = []
        for block in rng.sample(range(12), rng.randrange(0, 4)):  # each at most once in a document
            own = shared[block]
            lo = rng.randrange(len(own))
            parts += own[lo:] if rng.random() < 0.5 else own
            parts += [line() for _ in range(rng.randrange(0, 3))] + [""] * rng.randrange(2)
        texts[d] = "\n".join(parts)
    assert run(spark, texts, 1) == brute(texts, 1)
    size = lambda d: sum(len(t.split()) for t in d.values())
    for min_words in (8, 15):  # blocks often begin or end elsewhere, so first places of marks differ from those of windows
        want, got = brute(texts, min_words), run(spark, texts, min_words)
        assert all(set(want[d].split()) <= set(got[d].split()) for d in texts)
        assert size(texts) - size(got) >= 0.9 * (size(texts) - size(want))


def test_recall_against_brute_force_on_real_rows(spark, sf_dir):
    """Nothing goes that does not stand earlier; at least 0.99 of what stands earlier goes."""
    df = table(spark, sf_dir, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    want = brute(texts, linededup.MIN_WORDS)
    got = {r["doc_id"]: r["text"] or "" for r in linededup.dedup_lines(df).collect()}
    assert got.keys() == texts.keys()
    size = lambda d: sum(len(t.split()) for t in d.values())
    assert all(len(got[d].split()) >= len(want[d].split()) for d in texts)
    assert size(texts) - size(want) > 1000
    assert size(texts) - size(got) >= 0.99 * (size(texts) - size(want))


def test_recall_where_pieces_of_passages_stand_first_elsewhere(spark):
    """Passages whose parts also stand alone in earlier documents, too short to be repeats there."""
    rng = random.Random(11)
    word = iter(range(10**7))
    fill = lambda n: [f"f{next(word)}" for _ in range(n)]
    texts = {}
    for k in range(80):
        passage = [f"p{k}x{i}" for i in range(rng.randrange(50, 120))]
        a = rng.randrange(len(passage) - 30)
        texts[k] = " ".join(fill(20) + passage[a : a + rng.randrange(26, 50)] + fill(20))
        texts[1000 + k] = " ".join(fill(20) + passage + fill(20))
        texts[2000 + k] = " ".join(fill(5) + passage + fill(30))
    want, got = brute(texts, 50), run(spark, texts, 50)
    size = lambda d: sum(len(t.split()) for t in d.values())
    assert all(set(want[d].split()) <= set(got[d].split()) for d in texts)
    assert size(texts) - size(got) >= 0.9 * (size(texts) - size(want))


@pytest.mark.parametrize("min_words", [1, 2, 5, 50])
def test_winnowing_selects_one_mark_in_every_window(min_words):
    import pyarrow as pa

    rng = random.Random(min_words)
    texts = [" ".join(str(rng.randrange(40)) for _ in range(n)) for n in (0, 1, 49, 50, 51, 400)] + [" ".join(["a"] * 200)]
    words = linededup.Words(pa.array(texts))
    rows, at, marks = linededup.selected(words, min_words)
    run_, wide = linededup.split_of(min_words)
    assert run_ + wide - 1 == min_words
    for i, t in enumerate(texts):
        n, own = len(t.split()), set(at[rows == i].tolist())
        assert all(any(p in own for p in range(lo, lo + wide)) for lo in range(n - min_words + 1))
        assert n >= min_words or not own
    assert min_words < 50 or len(at) < 500  # far fewer than the words, but for the text of one word


def test_few_marks_are_selected(spark):
    rng = random.Random(1)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(20_000))
    named = spark.createDataFrame([(1, 2, text)], "_id long, _hash long, _text string")
    assert 1000 < linededup.marks(named, 50).count() < 2500


def test_long_passages_go_short_ones_stay(spark):
    passage = "\n".join(" ".join(f"p{i}x{j}" for j in range(13)) for i in range(4))  # 52 words
    short = "Licensed under some license.\nAll rights reserved."
    got = run(spark, {3: f"a\n{passage}\nb\n{short}", 1: f"c\n\n{passage}\nd\n{short}", 7: passage, 8: short}, 50)
    assert got == {1: f"c\n\n{passage}\nd\n{short}", 3: f"a\nb\n{short}", 7: "", 8: short}


def test_repeats_within_a_document_and_edge_rows(spark):
    p = "one two three four five"
    assert run(spark, {1: f"{p}\nx\n{p}\n"}, 5) == {1: f"{p}\nx\n"}
    assert run(spark, {1: "\n".join(["a b"] * 6)}, 4)[1] == "a b\na b"
    assert run(spark, {1: None, 2: "", 3: "\n\n", 4: "x " * 30_000}, 5) == {1: None, 2: "", 3: "\n\n", 4: "x " * 30_000}
    df = docs(spark, [p, p, p], ids=[None, 5, 5])
    assert sorted((r["doc_id"] or 0, r["text"]) for r in linededup.dedup_lines(df, min_words=5).collect()) == [(0, p), (5, ""), (5, "")]
    assert linededup.dedup_lines(df.limit(0)).count() == 0
    assert linededup.dedup_lines(df).columns == df.columns


def test_clashing_names(spark):
    p = "one two three four five"
    df = docs(spark, [p, p]).withColumns({"lines_removed": F.lit("old"), "gone": F.lit("g"), "_row": F.lit("r"), "h_id": F.lit(1), "_met": F.lit(2)})
    done = linededup.dedup_lines(df, min_words=5, removed_col="lines_removed")
    assert sorted((r["doc_id"], r["lines_removed"], r["gone"], r["_row"], r["_met"]) for r in done.collect()) == [(0, 0, "g", "r", 2), (1, 1, "g", "r", 2)]
    assert linededup.dedup_lines(df, min_words=5).columns == df.columns


def test_passages_inside_lines_and_across_breaks(spark):
    words = [f"p{i}" for i in range(54)]
    passage = " ".join(words)
    broken = " ".join(words[:20]) + "\n" + " ".join(words[20:])
    texts = {1: f"a b {passage} c\nd", 2: f"e {passage} f g", 3: f"h {broken} i\nj", 4: f"k {' '.join(words[:49])} l", 5: f"m\n  n {passage}\no"}
    got = run(spark, texts, 50)
    assert got == {1: texts[1], 2: "e f g", 3: "h\ni\nj", 4: texts[4], 5: "m\n  n\no"}


def test_many_lines_in_one_document(spark):
    """40,000 repeated lines in one text, linear in its lines."""
    block = "\n".join(f"l{i} a b c" for i in range(20_000))
    got = run(spark, {1: block + "\n" + block, 2: "x " * 10}, 50)
    assert got[1] == block


def test_hot_passage(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    got = run(spark, {i: f"own{i} {passage} end{i}" for i in range(3000)}, 50)
    assert got == {0: f"own0 {passage} end0"} | {i: f"own{i} end{i}" for i in range(1, 3000)}


def plain_cut(text: str, lost: set[int]) -> str:
    kept, w, n = [], 0, len(text.split())
    for line in text.split("\n"):
        own = range(w, w + len(line.split()))
        w += len(own)
        if not own:
            if not (0 < w < n and w - 1 in lost and w in lost):
                kept.append(line)
        elif not lost & set(own):
            kept.append(line)
        elif not lost >= set(own):
            kept.append(" ".join(x for i, x in zip(own, line.split(), strict=True) if i not in lost))
    return "\n".join(kept)


def test_cut_against_plain_python():
    rng = random.Random(2)
    for _ in range(500):
        text = "\n".join(" ".join(rng.choice(["a", "é\U0001f600", "bc"]) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(1, 8)))
        n = len(text.split())
        if not n:
            continue
        runs = [tuple(sorted((rng.randrange(n), rng.randrange(n)))) for _ in range(rng.randrange(1, 4))]
        want = plain_cut(text, {w for a, b in runs for w in range(a, b + 1)})
        assert linededup.cut_text(text, runs)[0] == want
