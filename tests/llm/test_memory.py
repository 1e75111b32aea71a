"""What the pipeline's stages hold in workers that serve many tasks."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from leafseek.llm import byte_bpe, common, entries, near_copies, simhash, substring, toxicity, word_ids

WANTED = ["toxicity", "near_duplicates", "repeated_passages"]


def test_lean_functions_drop_the_encoder(monkeypatch):
    """What packing left in a worker is gone while a lean function runs, and free memory goes back when it has ended."""
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(True))
    word_ids.encoder(entries.word_vocabulary())
    run = common._lean(lambda batches: ((x, len(word_ids._ENCODERS), len(given)) for x in batches))
    assert list(run([1, 2])) == [(1, 0, 0), (2, 0, 0)]
    assert given == [True]


def test_lean_functions_see_all_batches_and_errors(spark):
    rows = spark.range(0, 30_000, 1, 2)
    same = common.map_arrow(rows, lambda batches: batches, "id long", lean=True)
    assert same.agg({"id": "sum"}).first()[0] == sum(range(30_000)) and same.count() == 30_000

    def failing(batches):
        for batch in batches:
            raise ValueError("a failing row")
            yield batch

    with pytest.raises(Exception, match="a failing row"):
        common.map_arrow(rows, failing, "id long", lean=True).count()


@pytest.mark.parametrize("name", WANTED)
def test_stages_are_lean_and_bound_their_batches(spark, tmp_path, monkeypatch, name):
    """Texts of 3 KB come 10,000 at a time unless bytes are bounded."""
    lean = []
    for module in (near_copies, simhash, substring, toxicity):
        monkeypatch.setattr(module, "map_arrow", lambda *a, **b: lean.append(b.get("lean", False)) or common.map_arrow(*a, **b))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    try:
        docs = spark.createDataFrame([(i, f"word{i} and more of them", 20) for i in range(4)], "doc_id long, text string, n_chars long")
        spark.createDataFrame([(i, 0, i % 2) for i in range(4)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        assert dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path)).count() <= 4
        assert lean and all(lean)
        long = spark.range(0, 10_000, 1, 1).selectExpr("id", "repeat('abc', 1000) as text")

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

        seen = common.map_arrow(long, sizes, "n long, size long").collect()
        assert sum(r["n"] for r in seen) == 10_000
        assert max(r["size"] for r in seen) < 2 * common.BATCH
        spark.conf.set(key, "1000000")
        common.small_batches(spark)
        assert spark.conf.get(key) == "1000000"
    finally:
        spark.conf.unset(key)


def test_byte_bpe_is_lean_and_bounds_its_batches(spark, monkeypatch):
    import public_tokenizers

    lean = []
    monkeypatch.setattr(byte_bpe, "map_arrow", lambda *a, **b: lean.append(b.get("lean", False)) or common.map_arrow(*a, **b))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    try:
        docs = spark.createDataFrame([(i, "words that all have") for i in range(8)], "doc_id long, text string").repartition(2)
        ranks = byte_bpe.read_ranks(entries.vocabulary(entries.BYTE_VOCABULARY))
        assert byte_bpe.digest(docs, ranks, public_tokenizers.PATTERN).count() == 8
        assert len(lean) == 5 and all(lean)
        assert spark.conf.get(key) == str(common.BATCH)
    finally:
        spark.conf.unset(key)


def test_byte_bpe_keeps_no_strings_of_shared_words():
    """A dictionary takes some 200 bytes for each of them, in each task."""
    import public_tokenizers
    import regex

    words = pa.array([f" word{i:06}" for i in range(50_000)])
    tracemalloc.start()
    try:
        splitter = byte_bpe._Splitter(regex.compile(public_tokenizers.PATTERN), words)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert splitter.n_first == 50_000 and held < 30 * len(words)


def test_byte_bpe_words_of_equal_hashes(monkeypatch):
    """A shared word that another's hash hides is a word like any other."""
    import public_tokenizers
    import regex

    monkeypatch.setattr(byte_bpe, "hash", len, raising=False)
    shared, text = [" one", " two", ",", ".", " three"], "one two, two. three six\nfour one"
    pattern = regex.compile(public_tokenizers.PATTERN)
    splitter = byte_bpe._Splitter(pattern, pa.array(shared))
    places = np.frombuffer(splitter.split(text), "<i4")
    assert [(shared + list(splitter.words))[i] for i in places] == pattern.findall(text)


def test_byte_bpe_appends_in_place_but_not_to_shared_ids():
    shared = np.arange(4)
    held = byte_bpe._append(shared, 4, np.array([7]))
    more = byte_bpe._append(held, 5, np.array([8]))
    assert more is held and more[:6].tolist() == [0, 1, 2, 3, 7, 8] and shared.tolist() == [0, 1, 2, 3]
