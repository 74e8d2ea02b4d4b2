import hashlib
import random
import sys
from dataclasses import dataclass, field

from pyspark import cloudpickle

from lantern.operators import chunking, dense

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks don't see the tests' folder
BREAKS = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]


def plain_chunks(text, spans):
    """Rows of spans, as a loop over them."""
    out = []
    for s, e in spans:
        last = max(e - 1, s)
        content = text[s : last + 1]
        if content.strip():
            row = (text[:s].count("\n") + 1, text[:last].count("\n") + 1, len(text[:s].encode()), len(text[:last].encode()), content, hashlib.sha256(content.encode()).hexdigest()[:16])
            out.append(row)
    return out


def line_spans(text, size):
    spans, at = [], 0
    for line in text.splitlines(keepends=True):
        spans.append((at, at + len(line)))
        at += len(line)
    return chunking.merge_spans(spans, size)


def rows_of(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["id"], []).append((r["start_line"], r["end_line"], r["byte_start"], r["byte_end"], r["content"], r["chunk_hash"]))
    return {k: sorted(v, key=lambda r: r[2]) for k, v in got.items()}


def test_every_line_break(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["ab", "é漢😀", "", "x" * 30, " \t"]) + rng.choice(BREAKS) for _ in range(rng.randint(0, 25))) + rng.choice(["", "end"]) for _ in range(60)] + ["", "\n\n", " ", "one"]
    docs = spark.createDataFrame([*((i, t, "p.py") for i, t in enumerate(texts)), (99, None, "p.py")], "doc_id long, text string, path string")
    got = rows_of(chunking.line_chunks(docs, size=40))
    for i, t in enumerate(texts):
        assert got.get(i, []) == plain_chunks(t, line_spans(t, 40)), repr(t)
    assert 99 not in got


@dataclass
class Node:
    start_byte: int
    end_byte: int
    children: list = field(default_factory=list)


def grown(rng, start, end, depth):
    if depth == 0 or end - start < 4 or rng.random() < 0.2:
        return Node(start, end)
    cuts = sorted(rng.sample(range(start + 1, end), min(rng.randint(1, 4), end - start - 1)))
    return Node(start, end, [grown(rng, a, b, depth - 1) for a, b in zip([start, *cuts], [*cuts, end])])


def recursive(node, size):
    """Packing by recursion, as the rule is put."""
    if not node.children:
        return [(node.start_byte, node.end_byte)]
    out, i, kids = [], 0, node.children
    while i < len(kids):
        one = kids[i]
        n = one.end_byte - one.start_byte
        i += 1
        if n > size:
            out += recursive(one, size)
            continue
        end = one.end_byte
        while i < len(kids) and n + kids[i].end_byte - kids[i].start_byte <= size:
            n += kids[i].end_byte - kids[i].start_byte
            end = kids[i].end_byte
            i += 1
        out.append((one.start_byte, end))
    return out


def test_nodes_by_recursion():
    rng = random.Random(9)
    for _ in range(300):
        tree, size = grown(rng, 0, rng.randint(1, 200), 4), rng.randint(1, 60)
        assert chunking.node_spans(tree, size) == recursive(tree, size)
    deep = Node(0, 5000)
    at = deep
    for k in range(1, 5000):
        at.children = [Node(0, 5000 - k)]
        at = at.children[0]
    assert chunking.node_spans(deep, 1) == [(0, 1)]
    assert chunking.merge_spans([(0, 3), (5, 8), (8, 20), (20, 21)], 6) == [(0, 8), (8, 20), (20, 21)] and chunking.merge_spans([], 5) == []
    assert chunking.merge_spans([(0, 5), (5, 10)], 5, overlap=2) == [(0, 5), (5, 10)]


class Parsed:
    def __init__(self, raw):
        cuts = [0, *(i + 1 for i, c in enumerate(raw) if c == ord(";")), len(raw)]
        self.root_node = Node(0, len(raw), [Node(a, b) for a, b in zip(cuts, cuts[1:]) if a < b])


def parser(language):
    class P:
        def parse(self, raw):
            if b"!" in raw:
                raise ValueError("no syntax")
            return Parsed(raw)

    return P() if language == "semi" else None


def test_syntax_path(spark):
    """Where a parser is at hand and succeeds nodes are packed, by bytes turned into characters; elsewhere lines."""
    text = "é=1;\nfoo(漢);bar;\n" * 4
    docs = spark.createDataFrame([(1, text, "a", "semi"), (2, text, "b", "other"), (3, text + "!", "c", "semi"), (4, None, "d", "semi"), (5, "  ", "e", "semi")], "doc_id long, text string, path string, language string")
    got = rows_of(chunking.source_chunks(docs, size=20, parser=parser))
    raw, spans = text.encode(), chunking.merge_spans(chunking.node_spans(Parsed(text.encode()).root_node, 20), 20)
    chars = [(len(raw[:s].decode()), len(raw[:e].decode())) for s, e in spans]
    assert got[1] == plain_chunks(text, chars) and got[2] == plain_chunks(text, line_spans(text, 20)) and got[3] == plain_chunks(text + "!", line_spans(text + "!", 20)) and 4 not in got and 5 not in got
    assert not chunking.is_supported_language(None) and chunking.parser_for("no such language") is None


def test_vectors_change(spark):
    v = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, vector array<double>")
    new = spark.createDataFrame([("b", [3.0]), ("c", [4.0])], "id string, vector array<double>")
    more = dense.put(v, new)
    assert sorted((r["id"], r["vector"]) for r in more.collect()) == [("a", [1.0]), ("b", [3.0]), ("c", [4.0])]
    assert sorted(r["id"] for r in dense.drop(more, new.select("id")).collect()) == ["a"]
    assert dense.vector_of(more, "c") == [4.0] and dense.vector_of(more, "z") is None
