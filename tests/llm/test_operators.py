"""Each operator against a plain model, on rows with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from leafseek.llm import byte_bpe, embed_dedup, entries, flac, huffman, id_files, licenses, media, near_copies, packing, simhash, substring, token_counts, toxicity
from leafseek.llm.components import components
from leafseek.llm.fm_index import FMIndex
from leafseek.llm.word_ids import WordEncoder

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"w{i}" for i in range(70))
TEXTS = [
    (1, "The quick brown fox, it's 3.5 m tall!\nÉléphant naïve straße  CAFÉ"),
    (2, None),
    (3, ""),
    (4, "\n \t"),
    (5, f"start here {PASSAGE} tail of five"),
    (6, f"other words {PASSAGE} and six"),
    (7, "word " * 3000),
    (8, "x" * 5000 + " 日本語 👍🏽 İstanbul ǅ"),
    (9, f"other words {PASSAGE} and six"),
    (9, f"other words {PASSAGE} and six"),
    (None, f"no id {PASSAGE}"),
    (10, "Released under the MIT License. Licensed under the Apache License, Version 2.0."),
    (11, "This work is licensed under the GNU General Public License, version 3"),
    (12, "under the\x01mit license; the gnu version 3"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # columns with names that operators use inside, too
    return spark.createDataFrame([(d, t, None, 1, "z", 2) for d, t in TEXTS], "doc_id long, text string, lang string, label int, key string, n int").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.doc_id].append(r)
    return out


@pytest.mark.parametrize("thresholds", [None, {0: 1, 1: 0}, {0: -1, 1: 2}])
def test_simhash_plan_finds_all_links(spark, monkeypatch, thresholds):
    if thresholds:  # what large corpora get: two groups, of which one is probed within a distance
        groups = [list(range(0, 64, 2)), list(range(1, 64, 2))] if thresholds[0] >= 0 else [list(range(52)), list(range(52, 64))]
        fixed = [(simhash._mask(g), thresholds[i], g) for i, g in enumerate(groups) if thresholds[i] >= 0]
        monkeypatch.setattr(simhash, "plan", lambda fps, distance: fixed)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (6, 2))]
    dense = [int(base[0]) ^ int(m) for m in rng.integers(0, 1 << 10, 300)]  # one hot bucket
    values = sorted({*map(int, base), *near, *dense, 0})
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(values)], "fp long, id long")
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 2:
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    found = {r.node: r.component for r in components(simhash.links(fps)).collect()}
    assert all(found.get(i, i) == find(i) for i in range(len(values)))


def test_thresholds_by_dynamic_program():
    cost, chosen = simhash.allot([[0, 5, 50], [0, 1, 2], [0, 9, 90]], 0)
    assert (cost, sum(chosen)) == (min(6 + 9, 2 + 5, 2 + 9, 50 + 1), 0) and chosen == [0, 1, -1]
    assert sorted(b for g in simhash.correlated_groups(10, np.eye(64) * 5, 3) for b in g) == list(range(64))


def test_simhash(spark, docs, empty):
    def model(text):
        words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rows = by_id(simhash.near_duplicates(docs).collect())
    assert all(r.fp & (1 << 64) - 1 == model(t) for d, t in TEXTS for r in rows[d])
    assert [rows[i][0].component_id for i in (2, 3, 4)] == [2, 2, 2] and len(rows[9]) == 2 and rows[9][0].component_id == 6 and rows[None][0].component_id is None
    assert simhash.near_duplicates(empty).count() == 0


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def removal_model(texts):
    words = [(d, WORDS.findall(t or "")) for d, t in texts]
    first = {}
    for d, w in words:
        for i in range(len(w) - 49):
            if d is not None:
                key = tuple(w[i : i + 50])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, w in words:
        cut = set()
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                cut |= set(range(i, i + 50))
        kept = [x for i, x in enumerate(w) if i not in cut]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [2000, 0])
def test_substring(spark, docs, empty, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    assert sorted(map(tuple, substring.digest(docs).collect()), key=repr) == removal_model(TEXTS)
    assert substring.digest(empty).count() == 0
    kept = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    assert kept[6].text == "other words and six" and kept[1].text == TEXTS[0][1] and kept[2].text is None and kept[6].label == 1


def test_fm_index():
    rng = np.random.default_rng(3)
    for _ in range(10):
        sequences = [rng.integers(1, 4, rng.integers(1, 30)).astype(np.uint64) for _ in range(rng.integers(1, 8))]
        queries = [*sequences[:2], *[rng.integers(1, 5, rng.integers(0, 25)).astype(np.uint64) for _ in range(4)]]
        cap = int(rng.integers(2, 9))
        index = FMIndex(sequences, cap)
        for q, (length, low, high) in zip(queries, index.matching_statistics(queries), strict=True):
            for i in range(len(q)):
                places = []
                for m in range(min(cap, len(q) - i), 0, -1):
                    places = [(a, p) for a, s in enumerate(sequences) for p in range(len(s) - m + 1) if (s[p : p + m] == q[i : i + m]).all()]
                    if places:
                        break
                assert length[i] == (m if places else 0)
                if places:
                    assert sorted((index.owner[j], index.places[j] - index.starts[index.owner[j]]) for j in range(low[i], high[i])) == sorted(places)


def test_token_counts(docs, empty):
    vocabulary = token_counts.piece_vocabulary(entries.vocabulary(entries.PIECE_VOCABULARY))
    known, most = set(vocabulary), max(map(len, vocabulary))

    def model(text):
        total = unknown = 0
        words = WORDS.findall(text or "")
        for word in words:
            rest, n = "▁" + word, 0
            while rest:
                m = next((m for m in range(min(most, len(rest)), 0, -1) if rest[:m] in known), 0)
                if not m:
                    n, unknown = 1, unknown + 1
                    break
                rest, n = rest[m:], n + 1
            total += n
        return len(words), total, unknown

    rows = by_id(token_counts.count_tokens(docs, vocabulary).collect())
    assert all(tuple(r)[1:] == model(t) for d, t in TEXTS for r in rows[d])
    assert token_counts.count_tokens(empty, vocabulary).count() == 0


def test_failure_links_pop_tokens():
    counter = token_counts.Counter(token_counts.build(["a", "ab", "abcd", "c", "d"]))
    assert [counter.count(w) for w in ("abcd", "abc", "abab", "ad", "b", "abce")] == [1, 2, 2, 2, -1, -1]


def test_byte_bpe(docs, empty):
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(entries.vocabulary(entries.BYTE_VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = by_id(byte_bpe.digest(docs, ranks, public_tokenizers.PATTERN).collect())
    for d, t in TEXTS:
        ids = library.encode_ordinary(t or "")
        for r in rows[d]:
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert byte_bpe.digest(empty, ranks, public_tokenizers.PATTERN).count() == 0
    shared, ids, begins = byte_bpe.shared_words(docs, byte_bpe.PairMap(ranks), public_tokenizers.PATTERN)
    shared = shared.to_pylist()
    assert " other" in shared and len(shared) == len(set(shared)) == len(begins) - 1
    assert all(ids[begins[i] : begins[i + 1]].tolist() == library._encode_single_piece(w.encode()) for i, w in enumerate(shared))
    coded = byte_bpe.encode(docs.where("doc_id = 1"), ranks, public_tokenizers.PATTERN)
    assert bytes(byte_bpe.decode(coded, ranks).first().bytes).decode() == TEXTS[0][1]
    assert all(byte_bpe.heap_merges(w, ranks) == library._encode_single_piece(w) for w in (b"a" * 999, b"antidisestablishmentarianism" * 9))


def toxic_rows():
    rng = np.random.default_rng(2)
    plain = [f"plain{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        words = [plain[j] for j in rng.integers(0, 60, 40)]
        toxic = i % 6 == 0
        if toxic:
            words[::9] = [("idiot", "moron", "pathetic", "vile")[j] for j in rng.integers(0, 4, len(words[::9]))]
        rows.append((i, " ".join(words).capitalize() + "."))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(not toxic or i % 12 == 0), int(toxic)))
    return rows, labels


def test_byte_bpe_begins_anew_in_place():
    """A list of words begins anew behind the shared ones without a second list beside it."""
    import public_tokenizers
    import regex

    splitter = byte_bpe._Splitter(regex.compile(public_tokenizers.PATTERN), [" one", " two"])
    coded = splitter.split("three one, 4 two one")
    assert list(splitter.words) == ["three", ",", " 4"] and set(splitter) == {"two", "one"}
    assert np.frombuffer(coded, "<i4").tolist() == [2, 0, 3, 4, 1, 0]
    splitter.forget()
    assert not splitter.words and set(splitter) == {"two", "one"}
    assert splitter.split("4 two") == np.array([2, 1], "<i4").tobytes()


def test_byte_bpe_looks_up_distinct_chunks_once(monkeypatch):
    """The Python work of a text grows with its distinct chunks, not with all of them."""
    import public_tokenizers
    import regex

    looked, missing = [], byte_bpe._Splitter.__missing__
    monkeypatch.setattr(byte_bpe._Splitter, "__missing__", lambda self, chunk: looked.append(chunk) or missing(self, chunk))
    splitter = byte_bpe._Splitter(regex.compile(public_tokenizers.PATTERN), [" one"])
    coded = np.frombuffer(splitter.split("one rare one, " * 500 + "end"), "<i4")
    assert sorted(looked) == ["end", "one,", "rare"] and len(coded) == 500 * 4 + 1


def test_byte_bpe_in_many_runs_and_blocks(spark, monkeypatch):
    """Texts of all kinds in runs, blocks and lists of words that end often give the library's ids."""
    import public_tokenizers
    import tiktoken

    for name, value in {"RUN_BYTES": 300, "BLOCK_CHARS": 60, "GENERATION": 40, "LISTED": 50}.items():
        monkeypatch.setattr(byte_bpe, name, value)
    rng = np.random.default_rng(4)
    parts = [" ", " ", " ", "\n", "  ", "\t", "a", "the", "it's", "é", "日本", "12", ".", ",", "--", "\0", "word", "\u3000", "x" * 150]
    texts = ["".join(rng.choice(parts[: 10 if i % 2 else None], rng.integers(0, 30))) if i % 9 else None for i in range(400)]
    texts += [f"one {i} two{i:b}, three\nfour." for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    ranks = byte_bpe.read_ranks(entries.vocabulary(entries.BYTE_VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = by_id(byte_bpe.digest(docs, ranks, public_tokenizers.PATTERN).collect())
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert [tuple(r)[1:] for r in rows[i]] == [(len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())]


def test_toxicity(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame([(d, t, "x", 3) for d, t in [*rows, (None, None), (1000, ""), (1000, "")]], "doc_id long, text string, words string, toxic int")
    labels = spark.createDataFrame([*labels, (None, 1, 1), (5, 0, None), (5, None, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels.where("doc_id % 5 <> 1"))
    found = toxicity.score(docs, chain).collect()
    scored = {r.doc_id: r for r in found}
    held_out = [i for i in range(600) if i % 5 == 1]
    assert len(found) == len(rows) + 3 and np.mean([scored[i].toxic == (i % 6 == 0) for i in held_out]) > 0.98
    assert not scored[None].toxic and not scored[1000].toxic
    kept = toxicity.keep_clean(docs, chain)
    assert kept.columns == docs.columns and sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(r.doc_id) for r in found if not r.toxic)
    nothing = toxicity.fit(docs.where("false"), labels.where("false"))
    assert not any(r.toxic for r in toxicity.score(docs, nothing).collect())


def test_toxicity_scores_against_a_plain_chain(spark):
    """Words, folds and probabilities by another way: sets, dense matrices and plain gradient steps."""
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    texts = dict(rows)
    ids = sorted(d for d, _, _ in labels)
    fold = {r.doc_id: r.f for r in marked.selectExpr("doc_id", f"pmod(xxhash64(doc_id, 'fold'), {toxicity.FOLDS}) AS f").collect()}
    y = {d: (q, t) for d, q, t in labels}

    def choose(part):
        every = sorted({w for d in part for w in toxicity.words(texts[d])})
        out = []
        for w in every:
            has = np.array([w in toxicity.words(texts[d]) for d in part])
            for c in range(2):
                lab = np.array([y[d][c] for d in part], bool)
                table = np.array([[(has & lab).sum(), (has & ~lab).sum()], [(~has & lab).sum(), (~has & ~lab).sum()]], float)
                expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
                if has.sum() >= 3 and (expected > 0).all() and ((table - expected) ** 2 / expected).sum() >= toxicity.LEAST_CHI:
                    out.append(w)
                    break
        return out

    def model(x, t):
        full, w = np.concatenate([x, np.ones((len(x), 1))], 1), np.zeros(x.shape[1] + 1)
        penalty = np.append(np.full(x.shape[1], toxicity.RIDGE), toxicity.RIDGE / 100)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
            step = np.linalg.solve((full * (p * (1 - p) / len(t) + 1e-9)[:, None]).T @ full + np.diag(penalty), full.T @ (p - t) / len(t) + penalty * w)
            w -= step * min(1, 2 / np.abs(step).max())
        return lambda z: 1 / (1 + np.exp(-np.clip(np.concatenate([z, np.ones((len(z), 1))], 1) @ w, -30, 30)))

    def matrix(part, vocabulary):
        return np.array([[float(w in toxicity.words(texts[d])) for w in vocabulary] for d in part]).reshape(len(part), len(vocabulary))

    unseen = dict.fromkeys(ids, 0.0)
    for f in range(toxicity.FOLDS):
        inside, outside = [d for d in ids if fold[d] == f], [d for d in ids if fold[d] != f]
        own = choose(outside)
        unseen |= dict(zip(inside, model(matrix(outside, own), np.array([y[d][0] for d in outside], float))(matrix(inside, own)), strict=True))
    final, everyone = choose(ids), [d for d, _ in rows]
    first = model(matrix(ids, final), np.array([y[d][0] for d in ids], float))
    second = model(np.concatenate([matrix(ids, final), np.array([[unseen[d]] for d in ids])], 1), np.array([y[d][1] for d in ids], float))
    p = first(matrix(everyone, final))
    expected = dict(zip(everyone, zip(p, second(np.concatenate([matrix(everyone, final), p[:, None]], 1)), strict=True), strict=True))
    chain = toxicity.fit(docs, marked)
    assert sorted(chain.vocabulary) == final
    for r in toxicity.score(docs, chain).collect():
        assert np.allclose([r.p_quality, r.p_toxic], expected[r.doc_id], atol=2e-3)


def test_toxicity_keeps_its_bound_where_ids_repeat(spark):
    docs = spark.createDataFrame([(i % 9, f"text {i % 9} of {i}") for i in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(9)], "doc_id long, quality int, toxic int")
    seen = []
    toxicity.fit_chain, plain = lambda x, *rest: seen.append(len(x.dense)) or plain(x, *rest), toxicity.fit_chain
    try:
        toxicity.fit(docs, labels, max_rows=4)
    finally:
        toxicity.fit_chain = plain
    assert seen == [4]


def test_licenses(docs, empty):
    rows = by_id(licenses.digest(docs).collect())
    for d, t in TEXTS:
        words = re.findall(licenses.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        places = sorted((i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        for r in rows[d]:
            starts = [i for i, _ in places]
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
    assert rows[11][0].labels == "gpl-3" and rows[11][0].score == 1 and rows[12][0].labels == "mit" and rows[1][0].score == 0 and rows[10][0].labels == "apache-2,mit"
    assert licenses.digest(empty).count() == 0


def license_model(text, idf):
    """Labels and score by trying each template at each place of a text."""
    words = re.findall(licenses.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    labels, best = set(), 0.0
    for template, label, key in licenses.TEMPLATES:
        own, phrase = template.split(), key.split()
        first = next(j for j in range(len(own)) if own[j : j + len(phrase)] == phrase)
        rare = sorted(range(len(own)), key=lambda j: (-idf[licenses.VOCABULARY[own[j]]], j))[: licenses.RARE_WORDS]
        weight = [idf[licenses.VOCABULARY[w]] for w in own]
        for at in range(-len(own) + 1, len(words)):
            here = [0 <= at + j < len(words) and words[at + j] == w for j, w in enumerate(own)]
            score = sum(x for x, h in zip(weight, here, strict=True) if h) / sum(weight)
            if sum(here[j] for j in rare) >= licenses.AGREEING and all(here[first : first + len(phrase)]) and score >= licenses.LEAST_SCORE:
                labels.add(label)
                best = max(best, score)
    return ",".join(sorted(labels | {x for p, x in licenses.BASE.items() if f" {p} " in f" {' '.join(words)} "})), min(best, 1.0)


def test_altered_licenses(spark):
    """Notices with words replaced by others, in running text; also long texts of many notices."""
    rng = np.random.default_rng(8)
    plain = [f"plain{i}" for i in range(50)] + ["the", "of", "software", "license", "and", "version"]
    rows, intact = [], 0
    for n in range(160):
        template, label, key = licenses.TEMPLATES[n % len(licenses.TEMPLATES)]
        own, phrase = template.split(), key.split()
        first = next(j for j in range(len(own)) if own[j : j + len(phrase)] == phrase)
        free = [j for j in range(len(own)) if not first <= j < first + len(phrase)]
        for j in rng.permutation(free)[: n // len(licenses.TEMPLATES) % 3]:
            own[j] = "other"
        around = [[plain[i] for i in rng.integers(0, len(plain), 30)] for _ in range(2)]
        rows.append((n, " ".join([*around[0], *own, *around[1]]).title()))
    rows.append((1000, " and ".join(t for t, _, _ in licenses.TEMPLATES) * 40))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    idf = licenses.word_idf(licenses.positional_index(frame))
    found = {r.doc_id: r for r in licenses.digest(frame).collect()}
    for d, t in rows:
        labels, score = license_model(t, idf)
        assert found[d].labels == labels and abs(found[d].score - score) < 1e-6, t
    hits = [licenses.TEMPLATES[d % len(licenses.TEMPLATES)][1] in found[d].labels.split(",") for d, _ in rows[:-1]]
    print("altered notices found", np.mean(hits))
    assert np.mean(hits) > 0.8


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    rows = [(i, (centres[i % 40] + rng.standard_normal(16) * (0.05 if i % 40 < 20 else 1.5)).astype("f4").tolist(), i % 2) for i in range(400)]
    rows += [(500 + i, rows[0][1], 0) for i in range(50)] + [(600, None, 0), (601, [0.0] * 16, 0), (602, [float("nan")] * 16, 0), (603, [None, 1.0], 0), (604, rows[0][1], None), (605, [1.0, 2.0], 0), (606, [], 1), (None, rows[0][1], 0), (607, [3e38] * 16, 0), (608, [1e38] * 16, 0)]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, node string, n int, key int")
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(frame).collect()}
    usable = {i: (np.array(v, float) / np.abs(np.array(v, float)).max(), g) for i, v, g in rows if i is not None and v and g is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    degree, component = dict.fromkeys(got, 0), {i: i for i in got if i is not None}
    for a, (x, g) in usable.items():
        for b, (y, h) in usable.items():
            if a < b and g == h and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                degree[a] += 1
                degree[b] += 1
                p, q = sorted((component[a], component[b]))
                component = {k: p if v == q else v for k, v in component.items()}
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(degree.values())
    assert all(r.n_links <= degree[i] for i, r in got.items()) and all(r.component_id == component[i] and r.kept == (i == r.component_id) for i, r in got.items() if i is not None)
    assert embed_dedup.near_duplicates(frame.where("false")).count() == 0


def test_flac_round_trip_and_damage():
    rng = np.random.default_rng(1)
    payloads = [media.payload(t) for _, t in TEXTS] + [rng.integers(0, 256, 576 * 200, dtype=np.uint8).tobytes(), bytes(576 * 2), (np.sin(np.arange(5760) / 9) * 100 + 128).astype(np.uint8).tobytes()]
    streams = flac.encode_streams(payloads)
    for p, found in zip(payloads, flac.decode_streams(streams), strict=True):
        assert (np.concatenate(found)[:, 0] + 128).astype(np.uint8).tobytes() == p
    for at in (30, len(streams[4]) // 2, len(streams[4]) - 1):
        broken = bytearray(streams[4])
        broken[at] ^= 16
        good, bad, _ = flac.decode_streams([streams[0], bytes(broken), streams[1]])
        assert isinstance(bad, flac.DamagedStream) and isinstance(good, list)
    assert all(isinstance(x, flac.DamagedStream) for x in flac.decode_streams([b"", b"fLaC", streams[4][:-7]]))


def test_flac_subframes_that_the_encoder_does_not_write():
    """A stereo frame, mid-side, with wasted bits, partitions, an escape and a fixed predictor of order 2."""
    out = []

    def put(value, width):
        out.extend(value >> i & 1 for i in range(width - 1, -1, -1))

    def rice(value, k):
        folded = value << 1 ^ value >> 63
        out.extend([0] * (folded >> k) + [1])
        put(folded & (1 << k) - 1, k)

    left, right = [4 * (i % 7) for i in range(16)], [4 * (i % 5) + 2 * (i % 2) for i in range(16)]
    for value in (0xFF, 0xF8, 0x60, 0xA2, 0x00, 15):
        put(value, 8)
    crc = 0
    for i in range(0, 48, 8):
        crc = int(flac._CRC8[crc ^ int("".join(map(str, out[i : i + 8])), 2)])
    put(crc, 8)
    mid, side = [(a + b) >> 1 for a, b in zip(left, right, strict=True)], [a - b for a, b in zip(left, right, strict=True)]
    put((8 + 2) << 1, 8)  # mid: fixed order 2, two partitions, the second escaped
    for x in mid[:2]:
        put(x & 255, 8)
    residual = [mid[i] - 2 * mid[i - 1] + mid[i - 2] for i in range(2, 16)]
    put(0, 2)
    put(1, 4)
    put(3, 4)
    for x in residual[:6]:
        rice(x, 3)
    put(15, 4)
    put(9, 5)
    for x in residual[6:]:
        put(x & 511, 9)
    put(1 << 1 | 1, 8)  # side: verbatim, one wasted bit
    put(1, 1)
    for x in side:
        put(x >> 1 & 255, 8)
    out.extend([0] * (-len(out) % 8))
    frame = bytes(int("".join(map(str, out[i : i + 8])), 2) for i in range(0, len(out), 8))
    crc = 0
    for b in frame:
        crc = (crc << 8 & 0xFFFF) ^ int(flac._CRC16[crc >> 8 ^ b])
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 1 << 41 | 7 << 36 | 16).to_bytes(8, "big") + bytes(16)
    stream = b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame + crc.to_bytes(2, "big")
    (found,) = flac.decode_streams([stream])
    assert np.concatenate(found).T.tolist() == [left, right]


def test_media(docs, empty):
    rows = by_id(media.digest(docs).collect())
    for d, t in TEXTS:
        for r in rows[d]:
            p = media.payload(t)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
            (stream,) = flac.encode_streams([p])
            signed = [b - 128 for b in p]
            changes = sum((a < 0) != (b < 0) for a, b in zip(signed, signed[1:], strict=False))
            assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())
            assert r.feature == f"sum={sum(signed)};squares={sum(x * x for x in signed)};min={min(signed)};max={max(signed)};changes={changes}"
    assert rows[9][0].media_sha256 == rows[6][0].media_sha256 and media.digest(empty).count() == 0
    stored = media.encode_texts(docs.where("doc_id = 7"))
    blocks = media.pcm_blocks(stored.union(stored.selectExpr("8L", "0L", "cast(null as binary)"))).orderBy("doc_id", "block").collect()
    assert [b.first_sample for b in blocks[:-1]] == [576 * i for i in range(len(blocks) - 1)] and blocks[-1].error and blocks[-1].pcm is None


def plain_ids(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(entries.word_vocabulary())
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_word_ids_equal_the_library():
    encoder = WordEncoder(entries.word_vocabulary(), generation=5)
    extra = ["don't we'LL", "a  b\tc\x0bd", "é é́", "ΣΑΣ Σ", "…—“x”", "a\x1cb", "１２ ½", "<|endoftext|> x", "ab<|startoftext|>c <|endoftext|>.", "ﬁ ª º ŉ", "word,word;x...", "İx ǅ x, X, x. é, É", "Ab" * 99 + "! x", ", . !"]
    texts = [t for _, t in TEXTS if t] + extra
    for _ in range(2):
        for text in texts:
            assert encoder.encode(text).tolist() == plain_ids(text)[:-1], text
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode_all([*texts, None])] == [plain_ids(t)[:-1] for t in texts] + [[]]


def test_word_ids_of_marks_behind_words(monkeypatch):
    """A run of marks is encoded once for all words before it, and ids stay the library's."""
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_str(entries.word_vocabulary()), WordEncoder(entries.word_vocabulary())
    seen, whole = [], encoder._whole
    monkeypatch.setattr(encoder, "_whole", lambda piece: seen.append(piece) or whole(piece))
    text = "that*** That*** wider*** Éclair*** that,*** plain Plain PLAIN!? it's <|endoftext|> x<|endoftext|> a's** 'tis 4** ***"
    assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert sorted(seen) == sorted(["***", ",***", "!?", "it's", "<|endoftext|>", "x<|endoftext|>", "a's**", "'tis", "4**"])


def test_huffman():
    rng = np.random.default_rng(0)
    for counts in ([5], [0, 3, 0], [1, 1], [1 << i for i in range(30)], rng.integers(0, 99, 3000).tolist()):
        counts = np.array(counts, np.int64)
        lengths = huffman.code_lengths(counts, 12)
        assert lengths.max() <= 12 and sum(2.0 ** -int(x) for x in lengths if x) <= 1
        ids = rng.choice(np.flatnonzero(counts), 1000)
        payload, checkpoints = huffman.encode(ids, lengths, huffman.canonical_codes(lengths))
        empty = huffman.encode(ids[:0], lengths, huffman.canonical_codes(lengths))
        a, b, c = huffman.decode([(payload, checkpoints, 1000), (*empty, 0), (payload, checkpoints, 1000)], huffman.decoding_table(lengths, 12), 12)
        assert (a == ids).all() and (c == ids).all() and not len(b)
    assert huffman.code_lengths(np.array([1, 1, 2, 4]), 18).tolist() == [3, 3, 2, 1]


def test_id_files(docs, empty, monkeypatch):
    monkeypatch.setattr(id_files, "BLOCK_IDS", 50)
    monkeypatch.setattr(id_files, "STRETCH_DOCS", 4)
    codes, blocks = id_files.write(docs, entries.word_vocabulary())
    rows = sorted(id_files.digest(codes, blocks).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10, 11, 12]
    texts, start = dict(TEXTS), 0
    for r in rows:
        ids = plain_ids(texts[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: r.ids for r in id_files.read_tokens(codes, blocks).collect()}[1] == plain_ids(TEXTS[0][1])
    assert id_files.digest(*id_files.write(empty, entries.word_vocabulary())).count() == 0


def test_packing(docs, empty):
    rows = packing.pack(packing.cut(docs, entries.word_vocabulary(), 64, 16), 64).collect()
    assert sorted(map(repr, {(r.doc_id, r.doc_tokens) for r in rows})) == sorted(map(repr, {(d, len(plain_ids(t))) for d, t in TEXTS}))
    sequences = defaultdict(list)
    texts = dict(TEXTS)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        ids = plain_ids(texts[r.doc_id])[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and len(ids) == r.length
    for own in sequences.values():
        ends = 0
        for offset, length in sorted(own):
            assert offset == ends
            ends += length
        assert ends <= 64
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(r.length for r in rows) == sum(len(plain_ids(t)) for _, t in TEXTS)
    assert packing.pack(packing.cut(empty, entries.word_vocabulary())).count() == 0


def test_shortest_pack_first():
    patterns = packing.shortest_pack_first({6: 2, 4: 2, 3: 1, 10: 3}, 10)
    assert sorted(patterns) == [((4, 4), 1), ((6,), 1), ((6, 3), 1), ((10,), 3)]
    rng = np.random.default_rng(0)
    histogram = {int(n): int(c) for n, c in zip(range(1, 2049), rng.integers(0, 50, 2048), strict=True)}
    patterns = packing.shortest_pack_first(histogram, 2048)
    placed = defaultdict(int)
    for p, c in patterns:
        assert sum(p) <= 2048
        for n in p:
            placed[n] += c
    assert dict(placed) == {n: c for n, c in histogram.items() if c}
    assert sum(c for _, c in patterns) * 2048 < 1.02 * sum(n * c for n, c in histogram.items())
    assert packing.cuts(2048 + 700, 2048, 256) == [(0, 2048), (2048, 512), (2560, 188)] and packing.cuts(2048, 2048, 256) == [(0, 2048)] and packing.cuts(5, 2048, 256) == [(0, 5)]


@pytest.mark.skipif(not os.path.exists(os.path.join(os.path.dirname(__file__), "..", "..", "corpus_pipeline.py")), reason="the pipeline is absent")
def test_pipeline_stages(spark):
    import corpus_pipeline as C

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    clean = C.clean(spark, docs, d)
    assert clean.columns == docs.columns and clean.count() > 0.8 * docs.count()
    twice = docs.union(docs.withColumn("doc_id", docs.doc_id + 10_000))
    kept = C.distinct(spark, twice, d)
    sets = {i: set(near_copies.shingle_set(t).tolist()) for i, t in texts.items()}
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                p, q = sorted((group[a], group[b]))
                group = {k: p if v == q else v for k, v in group.items()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(group.values())
    cut = C.unrepeated(spark, docs, d)
    model = {x[0]: x[1] - x[2] for x in removal_model(sorted(texts.items()))}
    assert cut.columns == docs.columns and all(len(WORDS.findall(r.text)) == model[r.doc_id] and r.n_chars == len(r.text) for r in cut.collect())
    assert {r.doc_id for r in C.run(spark, d).select("doc_id").distinct().collect()} <= set(texts)
    assert C.clean(spark, docs.where("false"), d).count() == 0 and C.distinct(spark, docs.where("false"), d).count() == 0 and C.unrepeated(spark, docs.where("false"), d).count() == 0
