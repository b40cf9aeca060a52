import random

import pandas as pd
import pytest
from rillspark.functions import languages, split
from rillspark.functions.split import CustomLanguage, RecursiveSplitter, break_level, rows, separator_spans, split_by_separators, split_recursively


def texts(text, *args, custom=(), **kw):
    return [text[a:b] for a, b in RecursiveSplitter(custom).spans(text, *args, **kw)]


def test_no_overlap():
    t = "Linea 1.\nLinea 2.\n\nLinea 3."
    assert RecursiveSplitter().spans(t, 15, 5, 0) == [(0, 8), (9, 17), (19, 27)]


def test_forced_break():
    found = RecursiveSplitter().spans("A very very long text that needs to be split.", 20, 12, 0)
    assert len(found) > 1 and found[0] == (0, 16)


def test_overlap():
    found = texts("This is a test text that is a bit longer to see how the overlap works.", 20, 10, 5)
    assert len(found) > 1 and all(len(x) <= 25 for x in found)


def test_trim():
    found = texts("  \n First chunk  \n\n  Second chunk with spaces at the end    \n", 30, 10, 0)
    assert len(found) == 3 and not found[0].startswith("  ")


def test_positions():
    t = "Chunk1\n\nChunk2"
    found = rows(t, RecursiveSplitter().spans(t, 10, 5, 0))
    assert [(r["start"]["line"], r["start"]["column"]) for r in found] == [(1, 1), (3, 1)]


def test_custom_language():
    custom = [CustomLanguage("myformat", ("---",), ("mf",))]
    for name in ("myformat", "MF"):
        assert texts("Part1---Part2---Part3", 10, 4, 0, name, custom=custom) == ["Part1", "Part2", "Part3"]
    with pytest.raises(ValueError):
        RecursiveSplitter([*custom, CustomLanguage("mf", ("x",))])


def test_multibyte_sizes_are_bytes_and_offsets_characters():
    t = "ééé ééé ééé"
    assert texts(t, 8, 4, 0) == ["ééé", "ééé", "ééé"]
    assert RecursiveSplitter().spans(t, 8, 4, 0)[1] == (4, 7)


def test_break_levels():
    assert [break_level(x) for x in ("a b", "a\nb", "\r\n", "\n\n", "\r\n\r\n", "\n \n")] == [0, 1, 1, 2, 2, 1]


@pytest.mark.parametrize(
    ("text", "separators", "kw", "expected"),
    [
        ("Para1\n\nPara2\n\n\nPara3", [r"\n\n+"], {}, [(0, 5), (7, 12), (15, 20)]),
        ("A||B", [r"\|"], {"include_empty": True}, [(0, 1), (2, 2), (3, 4)]),
        ("no mark", [], {}, [(0, 7)]),
    ],
)
def test_separator_spans(text, separators, kw, expected):
    assert separator_spans(text, separators, **kw) == expected


def test_separators_kept():
    t = "A. B. C."
    assert [t[a:b] for a, b in separator_spans(t, [r"\."], "LEFT")] == ["A.", "B.", "C."]
    t = "A. B. C"
    assert [t[a:b] for a, b in separator_spans(t, [r"\."], "RIGHT")] == ["A", ". B", ". C"]
    t = "Line1\nLine2\nLine3"
    found = rows(t, separator_spans(t, [r"\n"], trim=False))
    assert [(r["start"]["line"], r["start"]["column"], r["end"]["line"], r["end"]["column"]) for r in found] == [(1, 1, 1, 6), (2, 1, 2, 6), (3, 1, 3, 6)]


def test_columns(spark):
    df = spark.createDataFrame([("a b. c d", 6), (None, 6), ("x y", None)], "text string, n int")
    found = df.select(split_recursively(df.text, df.n, 2).alias("c"), split_by_separators(df.text, [r"\."]).alias("s")).collect()
    assert [r["text"] for r in found[0].c] == ["a b", "c d"] and [r["text"] for r in found[0].s] == ["a b", "c d"]
    assert found[1].c is None and found[1].s is None and found[2].c is None


def test_languages(spark):
    files = ["test.rs", "main.py", "app.js", "noextension", "unknown.xyz", "A.JSON", None, "x.h"]
    expected = ["rust", "python", "javascript", None, None, "json", None, "cpp"]
    assert [languages.detect(f) for f in files] == expected
    df = spark.createDataFrame([(f,) for f in files], "f string")
    assert [r[0] for r in df.select(languages.language_of(df.f)).collect()] == expected


def test_every_ladder_compiles():
    splitter = RecursiveSplitter()
    for name in languages.LADDERS:
        assert splitter.ladder(name) and splitter.spans("a b\n\nc d {\n e;\n}\n", 6, 2, 0, name)


def test_python_is_cut_at_definitions():
    t = "import some_module\n\nclass A:\n    def f(self):\n        return 1\n\n    def g(self):\n        return 2\n\n@d\ndef h():\n    pass\n"
    assert texts(t, 60, 10, 0, "python") == ["import some_module", "class A:\n    def f(self):\n        return 1", "    def g(self):\n        return 2", "@d\ndef h():\n    pass"]


def plain_cost(p, s, i, least):
    """The cost of a chunk of pieces s to i by itself."""
    inside, breaks = min(p.depth[s + 1 : i + 1], default=None), max(p.inner[s + 1 : i + 1], default=0)
    cost = 1048576 if p.ends[i] - p.begins[s] < least else 0
    for at in (s, i + 1):
        if inside is not None:
            cost += sum(512 // k for k in range(1, p.depth[at] - inside + 1))
        cost += 64 * max(0, breaks - p.outer[at])
    return cost


def plain_chunks(p, most, least, overlap):
    n = len(p.start)
    missing = lambda at: (p.total - at) * 512 // overlap
    best, came = [0], [None]
    left = [missing(0) if overlap else 0] + [missing(e) if overlap else 0 for e in p.ends[:n]]
    for i in range(n):
        found = []
        for s in range(i, -1, -1):
            if p.ends[i] - p.begins[s] > most:
                if s == i:
                    found.append((plain_cost(p, s, i, least) + best[s], -s, s))
                break
            if overlap:
                q = min((q for q in range(s, i + 1) if q == s or p.ends[q] <= p.begins[s] + overlap), key=lambda q: (best[q] + left[q], -q))
                before = best[q] + 512 - max(0, missing(p.begins[s]) - left[q])
            else:
                q, before = s, best[s] + 256
            found.append((plain_cost(p, s, i, least) + before, -s, q))
        cost, s, q = min(found, key=lambda x: x[:2])
        best.append(cost)
        came.append((-s, q))
    out, q = [], n
    while q:
        out.append((came[q][0], q - 1))
        q = came[q][1]
    return out[::-1]


def test_chunks_are_the_cheapest_by_the_plain_formula(monkeypatch):
    monkeypatch.setattr(split, "BLOCK", 7)
    rng = random.Random(4)
    for _ in range(300):
        t = "".join(rng.choices(["a", "bc", "é", " ", "\n", "\n\n", ". ", ", ", "\r\n", "\t", "日。"], k=rng.randrange(0, 60)))
        most = rng.randrange(4, 30)
        least, overlap = rng.randrange(0, most), rng.choice([0, 0, 3, 8])
        overlap = min(overlap, least)
        offsets = split.byte_offsets(t)
        p = split.Pieces(t, split.cut_by_levels(t, RecursiveSplitter().ladder(None), offsets, overlap or least), offsets)
        assert split.cheapest(p, most, least, overlap) == plain_chunks(p, most, least, overlap), (t, most, least, overlap)
        assert all(a < b for a, b in RecursiveSplitter().spans(t, most, least, overlap))


def test_depths_of_separators():
    t = "a b. c\n\n d, e"
    offsets = split.byte_offsets(t)
    p = split.Pieces(t, split.cut_by_levels(t, RecursiveSplitter().ladder(None), offsets, 1), offsets)
    assert [t[a:b] for a, b in zip(p.start, p.end)] == ["a", "b", "c", " d", "e"]
    assert p.depth.tolist() == [0, 7, 4, 2, 6, 0] and p.outer.tolist() == [0, 0, 0, 2, 0, 2]


def test_texts_are_cut_together(monkeypatch):
    """As each by itself, with few passes over arrays however many texts there are."""
    rng, calls, own = random.Random(6), [], split.own_costs
    words = ["a", "bc", "é", "\n", "\n\n", "end. ", "so, ", "日。"]
    asked = [(" ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 90]))), rng.choice([20, 30]), 8, rng.choice([None, 0, 6]), None) for _ in range(300)]
    alone = [RecursiveSplitter().spans(*a) for a in asked]
    monkeypatch.setattr(split, "own_costs", lambda *a: calls.append(1) or own(*a))
    assert RecursiveSplitter().spans_of(asked) == alone and len(calls) < 30


def test_rows_of_a_batch_are_handed_on_in_parts(monkeypatch):
    monkeypatch.setattr(split, "SLICE", 10)
    texts = pd.Series(["a.b", None, "c" * 30, "d.e", "f.g", "", "h.i", "j"])
    parts = list(split.separated(iter([texts, texts[:0]]), [r"\."]))
    assert [len(p) for p in parts] == [2, 1, 5, 0]
    found = [None if r is None else [x["text"] for x in r] for p in parts for r in p]
    assert found == [["a", "b"], None, ["c" * 30], ["d", "e"], ["f", "g"], [], ["h", "i"], ["j"]]
