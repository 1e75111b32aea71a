"""The near-duplicate stage against all pairs of sets of shingles."""

import numpy as np
import pytest

from leafseek.llm import near_copies


def model(texts):
    """The least id of each id's component, by all pairs."""
    sets = {}
    for d, t in texts:
        w = (t or "").lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    component = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                p, q = sorted((component[a], component[b]))
                component = {k: p if v == q else v for k, v in component.items()}
    return component


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    out = [(i, None if i == 0 else " " * i) for i in range(3)]
    for base in range(40):
        words = [f"v{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 300)))]
        for _ in range(4):
            edited = list(words)
            for at in rng.integers(0, len(words), max(1, len(words) // 60)):
                edited[at] = f"e{rng.integers(1 << 30)}"
            out.append((len(out), " ".join(edited)))
    words = [f"h{i}" for i in range(120)]  # a hot group that is a chain: each text moves on by a word
    out += [(1000 + i, " ".join(words[i:] + [f"t{x}" for x in range(i)])) for i in range(60)]
    return out


@pytest.mark.parametrize("tile", [512, 8])
def test_near_copies(spark, texts, monkeypatch, tile):
    monkeypatch.setattr(near_copies, "TILE", tile)
    rows = near_copies.near_duplicates(spark.createDataFrame([*texts, (None, texts[5][1]), texts[7]], "doc_id long, text string")).collect()
    expected = model(texts)
    assert len(rows) == len(texts) + 2 and [r.component_id for r in rows if r.doc_id is None] == [None]
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == expected


def test_fingerprints_give_candidates(spark):
    """Nodes whose fingerprints links of two bits connect share a bucket without a common band."""
    fps = {1: 0b0, 2: 0b11, 3: 0b1111, 4: 0b1111 << 40, 5: -1, 6: -1}
    own = spark.createDataFrame([*fps.items(), (6, 0b1 << 40)], "node long, fp long")
    nodes = spark.createDataFrame([(n, [n + 100]) for n in fps], "node long, bands array<long>")
    held = {}
    for r in near_copies._entries(own, nodes).collect():
        held.setdefault(r.value, set()).add(r.node)
    # node 6 has two fingerprints, one a bit from node 1's and one node 5's
    assert sorted(map(sorted, held.values())) == sorted([[1, 2, 3, 6], [4], [5, 6], *([n] for n in fps)])


def test_similar_texts_with_near_fingerprints_need_no_band(spark, monkeypatch):
    """Of the groups of fingerprints the similar texts are joined, the others not."""
    words = [f"w{i}" for i in range(3000)]
    texts = [(1, " ".join(words)), (2, " ".join(words + ["end"])), (3, "word " * 5000), (4, "word " * 5000 + "end")]
    marked = near_copies._marked
    monkeypatch.setattr(near_copies, "_marked", lambda *a: marked(*a).selectExpr("doc_id", "h", "node", "fp", "cast(array() as array<long>) as bands"))
    rows = near_copies.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_stage_removes_edited_copies(spark, texts):
    import corpus_pipeline as C

    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id for r in C.distinct(spark, docs, "").collect()} == set(model(texts).values())
    assert C.distinct(spark, docs.where("false"), "").count() == 0


def test_stage_decides_by_row(spark):
    """Rows that share a doc_id, null ids, ties, repeated rows, null and empty texts, long texts, clashing columns."""
    import corpus_pipeline as C

    other, long = " ".join(f"z{i}" for i in range(40)), "word " * 20_000
    rows = [(9, "one two three four five six"), (9, other), (9, other), (3, other), (4, None), (5, ""), (None, other), (None, None), (7, long), (8, long + "end")]
    docs = spark.createDataFrame([(d, t, 1, "h", 5) for d, t in rows], "doc_id long, text string, node int, h string, component_id int")
    kept = C.distinct(spark, docs, "")
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    # the two long texts have one and two different shingles
    assert found == sorted([(9, rows[0][1]), (3, other), (4, None), (None, other), (None, None), (7, long), (8, long + "end")], key=repr)


def test_other_stages_on_odd_rows(spark):
    import corpus_pipeline as C

    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"x {passage} y"), (2, f"q {passage} r"), (2, f"q {passage} r"), (2, None), (None, passage), (3, ""), (4, "w " * 30_000)]
    docs = spark.createDataFrame([(d, t, 0, "k", 1) for d, t in rows], "doc_id long, text string, n_chars int, key string, spans int")
    cut = C.unrepeated(spark, docs, "")
    found = sorted(((r.doc_id, r.text) for r in cut.collect()), key=repr)
    assert cut.columns == docs.columns and found == sorted([(1, rows[0][1]), (2, "q r"), (2, "q r"), (2, None), (None, passage), (3, ""), (4, rows[6][1])], key=repr)
    pieces = C.packed(spark, docs, "").collect()
    assert len({r.doc_id for r in pieces}) == 5 and sum(r.length for r in pieces if r.start == 0) <= sum(r.length for r in pieces)
