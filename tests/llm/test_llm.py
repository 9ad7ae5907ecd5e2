"""The training-data operators against brute force on small tables with all odd cases."""

import collections
import hashlib
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodemark.llm import embedding_dedup, graph, language_id, license_scan, linear, minhash_dedup, mixing, pii, quality_classifier, quality_rules, sentencepiece_codec, token_count
from lodemark.llm import queries as llm_queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, node string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make(spark, texts, start=0):
    """A documents table with extra columns whose names the operators use themselves."""
    rows = [(start + i, t, "en" if i % 2 else "fr", f"src{i % 3}", len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 99)) for _ in range(n))


ODD = [None, "", " \n\t ", "one", "a b c d", "x" * 3000, "née 漢字 😀 ▁ done", "a\nb\na\n\na", prose(1, 400), prose(1, 400), "\x85\xa0 odd blanks\x1f"]


@pytest.fixture(scope="module")
def odd(spark):
    docs = make(spark, ODD)
    return docs.unionByName(docs.where("doc_id = 8")).unionByName(make(spark, ["null id"]).withColumn("doc_id", F.lit(None).cast("long")).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string")))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(11)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")


def data(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# Quality rules


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(spark, odd, labels):
    repeated = make(spark, ["a b c " * 30, "a b c d a b c", "q a b c a b c a b", "w " * 500], 100)
    got = quality_rules.judge(odd.unionByName(repeated), labels).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.unionByName(repeated).collect()}
    assert len(got) == odd.count() + 4
    for r in got:
        counts = brute_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r["base_failed"] and r["kept"])


def test_rules_are_learned_and_filter(spark):
    good = [prose(i, 120).replace(" ", ". ", 20) for i in range(60)]
    bad = [prose(i, 120).replace(" ", "### ") for i in range(60)]
    docs = make(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    assert quality_rules.learn_from(docs, labels)
    kept = quality_rules.keep(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert len(ids & set(range(60))) >= 58 and len(ids - set(range(60))) <= 2


def test_rules_without_labels_keep_what_the_base_rule_keeps(spark):
    docs = make(spark, [prose(3, 80), "short"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["kept"] for r in quality_rules.judge(docs, none).orderBy("doc_id").collect()] == [True, False]
    assert quality_rules.judge(docs.limit(0), none).count() == 0


# Near duplicates


def multiset(text):
    words = (text or "").lower().encode().split()
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def brute_classes(texts):
    sets = {k: multiset(t) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y:
                both = sum((x & y).values())
                if both >= 0.8 * (sum(x.values()) + sum(y.values()) - both):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return {k: find(k) for k in texts}


def near_texts():
    rng = random.Random(5)
    texts = []
    for group in range(6):
        base = prose(group, 200).split()
        for _ in range(8):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 6, 12])):
                words[rng.randrange(200)] = f"edit{rng.randint(0, 10**6)}"
            texts.append(" ".join(words))
    chain = prose(77, 300).split()
    for step in range(6):
        texts.append(" ".join(chain))
        chain[step * 40 : step * 40 + 4] = [f"step{step}{k}" for k in range(4)]
    return texts + ["tiny words", "tiny words", "Tiny  WORDS", "four words only here", "", None, "rep " * 200, "rep " * 210]


def test_near_duplicates_equal_brute_force(spark):
    texts = dict(enumerate(near_texts()))
    docs = make(spark, near_texts())
    got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(docs).collect()}
    expected = brute_classes(texts)
    assert {k: r["class_id"] for k, r in got.items()} == expected
    assert all(r["kept"] == (r["class_id"] == k) for k, r in got.items())
    kept = minhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values()))


def test_near_pairs_among_texts_of_one_template(spark, monkeypatch):
    """All texts share boilerplate at 0.75, below the threshold; each has one partner at 0.82."""
    common, texts = prose(300, 300), {}
    for i in range(120):
        own = [f"own{i}x{k}" for k in range(16)]
        for side in range(2):
            texts[i + 1000 * side] = " ".join([common, *own, *[f"tail{i}x{side}x{k}" for k in range(34)]])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = brute_classes(texts)
    assert len(set(expected.values())) == 120
    for block in (minhash_dedup.BLOCK, 16):
        monkeypatch.setattr(minhash_dedup, "BLOCK", block)
        assert {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_duplicates(docs).collect()} == expected


def test_near_duplicates_of_odd_rows(spark, odd):
    got = minhash_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    kept = [r["doc_id"] for r in minhash_dedup.keep_one(odd).collect()]
    assert kept.count(8) == 1 and 9 not in kept and kept.count(None) == 1
    assert {0, 1, 2} <= set(kept)
    assert minhash_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_null_ids_link_near_duplicates(spark):
    near = " ".join(prose(8, 300).split()[:-1] + ["other"])
    rows = [(1, prose(8, 300)), (None, prose(8, 300)), (2, near), (None, prose(9, 300)), (None, prose(9, 300) + " more"), (7, prose(10, 50))]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["kept"]) for r in got.collect()) == sorted([("1", "1", True), ("None", "1", False), ("2", "1", False), ("None", "None", True), ("None", "None", True), ("7", "7", True)])


def test_families_near_the_threshold_lose_no_link(spark):
    """Texts of several templates, edited so that many pairs lie just above the threshold."""
    rng, texts = random.Random(21), {}
    for family in range(12):
        base = prose(500 + family, 160).split()
        for k in range(12):
            words = list(base)
            for _ in range(rng.randint(2, 5)):
                words[rng.randrange(len(words))] = f"w{rng.randint(0, 10**6)}"
            texts[family * 100 + k] = " ".join(words)
    expected = brute_classes(texts)
    got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == expected


def test_signatures_estimate_weighted_jaccard():
    hashes = minhash_dedup._Hashes()
    rng = random.Random(1)
    errors = []
    for i in range(12):
        words = prose(i, 300).split()
        other = words[: rng.randint(100, 300)] * rng.randint(1, 3) + prose(i + 50, 50).split()
        x, y = (minhash_dedup.shingles(" ".join(w), hashes) for w in (words * 2, other))
        times = minhash_dedup.signatures([x, y], 960)
        errors.append((times[0] == times[1]).mean() - minhash_dedup.similarity(x, y))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(1, 40)]
    parent = {}

    def find(k):
        parent.setdefault(k, k)
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {r["a"]: r["b"] for r in graph.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {k: find(k) for k in parent if find(k) != k}
    assert graph.components(spark.createDataFrame([], "x long, y long")).count() == 0


# Embeddings


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    vectors = [*base, *(base[i % 40] + rng.normal(size=16) * 0.05 for i in range(120)), *base[:5], base[0] * 3]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    rows += [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [1.0, None], 0), (904, [float("nan")] * 16, 0), (905, [float("inf")] + [0.0] * 15, 0), (906, [1.0, 2.0], 0), (907, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    x = np.array(vectors)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.minimum(root, np.where(linked, root[None, :], len(x)).min(axis=1))
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"]) == (linked[i].sum(), root[i])
        assert got[i]["kept"] == (root[i] == i)
    assert all((got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True) for k in range(900, 906))
    assert (got[907]["n_links"], got[907]["component_id"]) == (1, 906)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_null_and_repeated_vector_ids(spark):
    rows = [(1, [1.0, 0.0, 0.1]), (None, [1.0, 0.0, 0.11]), (None, [0.0, 1.0, 0.0]), (None, [0.0, 1.0, 0.01]), (5, [0.0, 0.0, 1.0]), (5, [0.0, 0.01, 1.0]), (5, [0.0, 0.0, 1.0]), (None, None)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit("clash"))).collect()
    expected = [("1", 1, "1", True), ("None", 1, "1", False), ("None", 1, "None", True), ("None", 1, "None", True), *[("5", 2, "5", True)] * 3, ("None", 0, "None", True)]
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == sorted(expected)


def test_large_buckets_are_dealt_as_block_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(4)
    vectors = np.ones(8) + rng.normal(size=(60, 8)) * 0.01
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    assert {(r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()} == {(59, 0)}


# SentencePiece


def test_encoding_equals_the_library(spark, odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    more = ["née 漢字 😀\t  two  spaces  ", "long" * 300, "x" * 3000, " lead", "  ", "ab" * 5000, "aB3xQkthe" * 400, "\n\n a\nb \n"]
    docs = data(spark, "documents").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    docs = docs.unionByName(make(spark, more, 2 * 10**6).select(*docs.columns)).withColumn("ids", F.lit("clash")).withColumn("key", F.lit(1))
    model = sentencepiece_codec.read_model()
    coded = sentencepiece_codec.encode(docs, model)
    expected = sorted((str(r["doc_id"]), library.encode(r["text"] or "")) for r in docs.collect())
    got = coded.collect()
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in got) == expected
    assert all(r["n_pieces"] == len(r["ids"]) for r in got)
    # A text that holds the mark of a space does not come back; all others do.
    marked = [r["doc_id"] for r in docs.collect() if "▁" in (r["text"] or "")]
    assert sorted(r["doc_id"] for r in got if not r["round_trip"]) == sorted(marked) == [6]
    texts = sorted(r["text"] or "" for r in docs.where("doc_id <> 6 or doc_id is null").collect())
    assert sorted(r["decoded"] for r in sentencepiece_codec.decode(coded.where("doc_id <> 6 or doc_id is null"), model).collect()) == texts
    assert sentencepiece_codec.encode(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("block, window", [(200, 64), (1 << 25, 7)])
def test_small_blocks_and_windows_agree(spark, monkeypatch, block, window):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    docs = data(spark, "documents").where("doc_id % 5 = 0").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "ab" * 100 + " " + "thequickbrown" * 9)], "doc_id long, text string"))
    for name, value in (("BLOCK", block), ("SLICE", 300), ("WINDOW", window), ("STEP", 50)):
        monkeypatch.setattr(sentencepiece_codec, name, value)
    got = {r["doc_id"]: list(r["ids"]) for r in sentencepiece_codec.encode(docs, sentencepiece_codec.read_model()).collect()}
    assert got == {r["doc_id"]: library.encode(r["text"]) for r in docs.collect()}


def test_chunks_end_where_no_piece_goes_on():
    """Numbers fall into digits, so the chunks of a corpus' numbers are few; no two characters of a chunk but stand side by side in a piece."""
    import pyarrow as pa

    model = sentencepiece_codec.read_model()
    inner = {p[k : k + 2] for p in model.ids for k in range(len(p) - 1)}
    words = [str(n) for n in range(1000)] + ["nombre.", "née漢字😀x9", "a\nb\n\nc", "▁▁if", "", "x" * 300]
    sizes, numbers, distinct = sentencepiece_codec._chunked(pa.array(["skipped", *words]).slice(1), model)
    found, ends = [distinct[int(k) - 1].as_py() for k in numbers], [0, *sizes.cumsum().tolist()]
    for word, a, b in zip(words, ends, ends[1:], strict=False):
        assert "".join(found[a:b]) == "▁" + word
        assert all(x[k : k + 2] in inner for x in found[a:b] for k in range(len(x) - 1))
        assert all(x[-1] + y[0] not in inner for x, y in zip(found[a:b], found[a + 1 : b], strict=False))
    assert len(set(found[: ends[1000]])) <= 21


def paths(spark, model, chunks):
    words = spark.createDataFrame([(c, i) for i, c in enumerate(chunks)], "chunk string, i long").withColumn("name", F.col("chunk"))
    return {r["chunk"]: list(r["ids"]) for r in sentencepiece_codec.encoded_chunks(words, model, ["name"]).collect()}


@pytest.mark.parametrize("window", [64, 3])
def test_viterbi_equals_brute_force(spark, monkeypatch, window):
    monkeypatch.setattr(sentencepiece_codec, "WINDOW", window)
    scores = {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "▁a": -3.0, "ba": -5.0, "aba": -6.9, "▁ab": -5.5}
    model = sentencepiece_codec.Model([("<unk>", 0.0), *scores.items()], [2] + [1] * len(scores), sentencepiece_codec.UNIGRAM)

    def best(chunk):
        options = [0.0]
        for e in range(1, len(chunk) + 1):
            own = [options[s] + scores[chunk[s:e]] for s in range(e) if chunk[s:e] in scores]
            options.append(max(own or [options[e - 1] + min(scores.values()) - 10]))
        return options[-1]

    chunks = ["▁abab", "▁aba", "▁bb", "ab", "▁acb", "▁" + "ab" * 5, "▁" + "abba" * 7, "c"]
    price = lambda path: sum(scores.get(model.pieces[k][0], min(scores.values()) - 10) for k in path)
    for chunk, path in paths(spark, model, chunks).items():
        assert price(path) == pytest.approx(best(chunk))
        assert "".join(model.pieces[k][0] if k else "?" for k in path) == re.sub("c", "?", chunk)


def test_paths_of_merge_models_equal_merging(spark):
    """Random vocabularies: the one path that is left is what merging the best neighbours gives."""
    rng = random.Random(11)
    for _ in range(4):
        pieces = ["a", "b", "c"]
        while len(pieces) < 24:
            new = rng.choice(pieces) + rng.choice(pieces)
            if len(new) <= 7 and new not in pieces:
                pieces.append(new)
        rank = {p: n for n, p in enumerate(pieces)}

        def merged(word, rank=rank):
            parts = list(word)
            while True:
                options = [(rank[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in rank]
                if not options:
                    return parts
                _, i = min(options)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]

        model = sentencepiece_codec.Model([("<unk>", 0.0), *((p, -float(n)) for p, n in rank.items())], [2] + [1] * len(pieces), sentencepiece_codec.BPE)
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 25))) for _ in range(150)})
        got = paths(spark, model, words)
        assert {w: [model.pieces[k][0] for k in got[w]] for w in words} == {w: merged(w) for w in words}


# Classifiers


def test_quality_scores_on_held_out_rows(spark):
    good, bad = [prose(i, 60) for i in range(150)], [prose(i, 60).replace(" ", " | ") for i in range(150)]
    docs = make(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] < 150) for r in held) >= 0.95 * len(held)


def test_quality_of_odd_rows_and_without_labels(spark, odd, labels):
    got = quality_classifier.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    none = quality_classifier.classify(odd, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_classifier.classify(odd.limit(0), labels).count() == 0


def test_repeated_ids_give_one_model_in_any_order(spark):
    rows = [(i, prose(i, 30 + i % 3), "en" if i % 2 else "de") for i in range(40)] + [(i, prose(90 + i, 30 + i % 3), "en" if i % 2 else "de") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    found = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string")
        scores = sorted((r["doc_id"], r["score"]) for r in quality_classifier.classify(docs, labels).collect())
        found.append((scores, sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(docs).collect())))
    assert found[0] == found[1]


def test_linear_model_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.2 > 0, 1.0, -1.0)
    rows = [(np.arange(5), v) for v in x]
    w = linear.fit(rows, y, 5, np.full(200, 10.0), epochs=60)
    assert (np.sign(linear.scores(rows, w)) == y).mean() > 0.97


def test_linear_model_is_the_least_of_its_objective():
    """The dual solver's weights against plain descent on the primal objective."""
    rng = np.random.default_rng(5)
    x = np.hstack([rng.normal(size=(60, 4)), np.ones((60, 1))])
    y, cost = np.where(x[:, 0] - x[:, 1] + rng.normal(size=60) * 0.5 > 0, 1.0, -1.0), rng.uniform(0.2, 2.0, 60)
    price = lambda w: w @ w / 2 + (cost * np.maximum(0.0, 1 - y * (x @ w))).sum()
    best, w = np.inf, np.zeros(5)
    for step in range(1, 60_000):
        on = y * (x @ w) < 1
        w = w - (w - (cost[on] * y[on]) @ x[on]) / (step + 10)
        best = min(best, price(w))
    found = linear.fit([(np.arange(4), v[:4]) for v in x], y, 4, cost, epochs=400)
    assert price(found) <= best * 1.002


def test_languages_on_held_out_rows(spark, odd):
    got = language_id.identify(data(spark, "documents")).join(data(spark, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    rows = {r["doc_id"]: r for r in language_id.identify(odd).collect()}
    assert len(language_id.identify(odd).collect()) == odd.count()
    assert all((rows[k]["lang_pred"], rows[k]["score"]) == ("und", 0.0) for k in (0, 1, 2))
    assert language_id.identify(odd.limit(0)).count() == 0


def test_language_vector_is_the_same_in_steps(monkeypatch):
    text = "Übung macht den Meister, 3 x 漢字 und so weiter. " * 50
    whole = language_id.vector(text)
    monkeypatch.setattr(language_id, "STEP", 37)
    assert np.abs(language_id.vector(text) - whole).max() < 0.02
    assert language_id.vector("123 +-") is None


# Token counts


def greedy(word, pieces):
    i = n = 0
    while i < len(word):
        size = next((k for k in range(len(word) - i, 0, -1) if word[i : i + k] in pieces), 0)
        if not size:
            return -1
        i, n = i + size, n + 1
    return n


def test_automaton_equals_greedy_matching():
    rng = random.Random(3)
    for _ in range(200):
        pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 14))}
        automaton = token_count.Automaton(sorted(pieces))
        for _ in range(30):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
            assert automaton.count(word) == greedy(word, pieces)


def test_token_counts(spark, odd):
    pieces = token_count.read_vocabulary()
    got = token_count.count_tokens(odd, pieces).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(got) == odd.count()
    for r in got:
        words = (texts[r["doc_id"]] or "").encode().split()
        assert r["n_words"] == len(words) and r["n_unknown"] == 0
        assert r["n_tokens"] == sum(greedy(b" " + w, set(pieces)) for w in words if len(w) < 100) + sum(token_count.Automaton(pieces).count(b" " + w) for w in words if len(w) >= 100)
    assert token_count.count_tokens(odd.limit(0), pieces).count() == 0
    unknown = token_count.count_tokens(make(spark, ["ab zz"]), [b" ", b"a", b"b"]).first()
    assert (unknown["n_tokens"], unknown["n_unknown"]) == (4, 1)


# Personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    parts = ["a@b.co", "@", "x.y@z", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234-5678", "+1", ".", " ", "-", "é", "😀", "007.8.9.10.11", "9" * 30, "a.b-c@d-e.f.g"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("1" * 200_000 + " " + "a" * 200_000) == []


def test_added_spans_are_precise_and_never_cross_base_ones():
    model = pii.trained()
    right = total = 0
    for text, gold in pii.examples(300, seed=99):
        base = pii.base_spans(text)
        added = pii.added_spans(text, base, model)
        assert not any(s < e2 and s2 < e for s, _, e in added for s2, _, e2 in base)
        if not base:
            total += 1
            right += [(s, e, k) for s, k, e in added] == gold
    assert right >= 0.97 * total
    assert pii.find("plain words of 2024 with 17 parts", model) == ([], [])


def every_segmentation(ends, at, chosen=()):
    """All ways to label segments up to token ``at``: each as a tuple of (start, end, kind, features)."""
    if at == 0:
        yield chosen
        return
    yield from every_segmentation(ends, at - 1, chosen)
    for i, a, b, f in ends[at]:
        for kind in pii.ADDED:
            yield from every_segmentation(ends, i, (*chosen, (a, b, kind, f)))


def test_field_equals_exhaustive_segmentation():
    model = pii.trained()
    for text in ["call (826) 555-4081 now", "a 123-45-6789 b", "x [at] y . com", "DE44 5001 0517 5407 3249 31", "1 22 333", "joe(at)web.de 17"]:
        tokens = [m.span() for m in re.finditer(r"\S+", text)]
        ends = model.segments(text, tokens, lambda a, b: False)
        total = lambda own: sum(model.score(k, f) for _, _, k, f in own)
        every = list(every_segmentation(ends, len(tokens)))
        found = model.best(ends)
        best = max(every, key=total)
        assert sum(model.score(k, f) for a, k, b in found for own in ends for _, x, y, f in own if (x, y) == (a, b)) == pytest.approx(total(best))
        assert model.forward(ends)[-1] == pytest.approx(np.log(sum(np.exp(total(o)) for o in every)))


def test_long_segments_are_found_whole():
    model = pii.trained()
    text = "write joe [at] alpha . beta . gamma . com"
    assert [(k, text[s:e]) for s, k, e in pii.added_spans(text, [], model)] == [("mail", "joe [at] alpha . beta . gamma . com")]
    long = "write " + "j" * 150 + " [at] " + "d" * 150 + " . com"
    assert [(k, long[s:e]) for s, k, e in pii.added_spans(long, [], model)] == [("mail", long[6:])]


def test_personal_data_of_odd_rows(spark, odd):
    text = "me@x.org 😀 8.8.8.8 call (826) 555-4081"
    docs = odd.unionByName(make(spark, [text], 500))
    got = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    assert pii.detect(docs).count() == docs.count()
    assert got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[0]["spans"] == ""
    assert (got[500]["n_email"], got[500]["n_ip"], got[500]["n_card"], got[500]["n_phone"]) == (1, 1, 0, 0)
    assert got[500]["base_sha256"] == hashlib.sha256(b"email:0:8,ip:11:18").hexdigest()
    assert got[500]["spans"].startswith("email:0:8,ip:11:18,tel:24:38")
    masked = pii.mask(docs)
    assert masked.columns == docs.columns
    row = {r["doc_id"]: r for r in masked.collect()}
    assert row[500]["text"] == "[EMAIL] 😀 [IP] call [TEL]" and row[500]["n_chars"] == len(row[500]["text"])
    assert row[0]["text"] is None and row[8]["text"] == ODD[8]
    assert pii.detect(docs.limit(0)).count() == pii.mask(docs.limit(0)).count() == 0


# Licences and mixing


def duck_equal(spark, docs, got, sql, tmp_path):
    path = str(tmp_path / "documents.parquet")
    pq.write_table(docs.toArrow(), path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    result = con.sql(sql)
    columns = sorted(got.columns)
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == sorted(str(tuple(r[i] for i in at)) for r in result.fetchall())


def test_licences(spark, odd, tmp_path):
    mit = license_scan.LICENSES["MIT"]
    texts = [mit, "MIT LICENCE\n\nCopyright (c) 2020 Someone\n\n" + mit.split("\n\n", 1)[1].upper(), "intro\nReleased under the MIT License!\n- licensed  under CC BY-NC 4.0\nend", mit + " more"]
    docs = odd.unionByName(make(spark, texts, 300))
    rows = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert (rows[300]["license_id"], rows[301]["license_id"], rows[303]["license_id"]) == ("MIT", "MIT", None)
    assert (rows[302]["notices"], rows[302]["n_notice_lines"], rows[302]["license_id"]) == ("CC-BY-NC-4.0,MIT", 2, None)
    duck_equal(spark, docs, license_scan.scan(docs), license_scan.oracle_sql(), tmp_path)
    assert license_scan.scan(docs.limit(0)).count() == 0
    assert len(license_scan.known()) < 300


def test_own_table_of_long_notices(spark):
    notice = "our own notice " + "word " * 80
    digest = hashlib.sha256(license_scan._one_line(license_scan.canonical_text(notice)).encode()).hexdigest()
    docs = make(spark, [f"intro\n{notice}\nend", notice, "none"])
    got = {r["doc_id"]: r for r in license_scan.scan(docs, [(digest, "Own-1", True), (digest, "Own-1", True)]).collect()}
    assert [(got[i]["notices"], got[i]["license_id"]) for i in range(3)] == [("Own-1", None), ("Own-1", "Own-1"), ("", None)]


def test_long_licences_and_standard_headers(spark, tmp_path):
    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}
    whole = [(k, (folder / f).read_text()) for k, f in files.items() if (folder / f).exists()]
    header = '/*\n * Licensed under the Apache License, Version 2.0 (the "License");\n * you may not use this file\n */'
    lines = [("Apache-2.0", header), ("LGPL-2.1", "# SPDX-License-Identifier: LGPL-2.1-or-later"), ("MPL-2.0", " * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0.")]
    docs = make(spark, [t for _, t in whole + lines])
    got = license_scan.scan(docs)
    found = {r["doc_id"]: r for r in got.collect()}
    for i, (name, _) in enumerate(whole):
        assert found[i]["license_id"] == name
    for i, (name, _) in enumerate(lines, len(whole)):
        assert found[i]["notices"] == name
    duck_equal(spark, docs, got, license_scan.oracle_sql(), tmp_path)


@pytest.mark.parametrize("share, epochs", [(0.5, 2), (0.05, 1), (1.7, 2), (2.5, 2)])
def test_mixing_equals_sql(spark, odd, tmp_path, share, epochs):
    docs = odd.unionByName(make(spark, [prose(i, 5 + 13 * i % 90) for i in range(150)], 1000))
    got = mixing.mix(docs, share=share, max_epochs=epochs)
    duck_equal(spark, docs, got, mixing.oracle_sql(share, epochs), tmp_path)


def test_mixing_keeps_to_budgets(spark):
    docs = data(spark, "documents")
    _, leaves = mixing.plan(docs)
    for r in leaves.collect():
        assert r["quota"] <= r["tokens"] * mixing.MAX_EPOCHS
    used = mixing.mix(docs).groupBy(*mixing.LEAF).agg(F.sum("n_tokens").alias("used")).join(leaves, mixing.LEAF).collect()
    assert used and all(r["used"] <= r["quota"] for r in used)
    kept = mixing.mixed_documents(docs)
    assert kept.columns == docs.columns and kept.count() == mixing.mix(docs).count()
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_ignores_weights_of_zero(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCE_WEIGHTS", {"src0": 0.0, "src1": -2.0})
    docs = make(spark, [prose(i, 30) for i in range(60)])
    assert {r["source"] for r in mixing.mix(docs).collect()} == {"src2"}


# Registry and pipeline


@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_query_sql(spark, name, tmp_path):
    duck_equal(spark, data(spark, "documents"), llm_queries.queries()[name](spark, SF), llm_queries.oracle_sql()[name], tmp_path)


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in llm_queries.queries()) == list(range(1, 14))


def test_pipeline(spark):
    import sentencepiece

    import corpus_pipeline

    docs = data(spark, "documents")
    kept = corpus_pipeline.quality(spark, docs, SF)
    unique = corpus_pipeline.near_duplicates(spark, kept, SF)
    texts = {r["doc_id"]: r["text"] for r in unique.collect()}
    assert len(set(brute_classes(texts).values())) == len(texts)
    assert len(texts) == len(set(brute_classes({r["doc_id"]: r["text"] for r in kept.collect()}).values()))
    clean = corpus_pipeline.personal_data(spark, unique, SF)
    assert all(not brute_spans(r["text"]) for r in clean.collect())
    out = corpus_pipeline.run(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    assert out and all(r["ids"] == library.encode(texts[r["doc_id"]]) for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_dedup", "pii", "source_mixing", "sentencepiece"]


@pytest.fixture
def odd_folder(spark, odd, labels, tmp_path):
    odd.unionByName(make(spark, [prose(i, 80) for i in range(30)], 1000)).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_pipeline_of_odd_and_empty_tables(spark, odd_folder, tmp_path_factory):
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, odd_folder)
        assert after.columns == docs.columns, name
        assert stage(spark, docs.limit(0), odd_folder).count() == 0, name
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = {x.name for x in shared.iterdir()}
    out = corpus_pipeline.run(spark, odd_folder).collect()
    # Of all tables written on the way only the last stage's input is left.
    left = [x.name for x in shared.iterdir() if x.name not in before and (x / "_SUCCESS").exists()]
    assert [x.rsplit("-", 1)[0] for x in left] == ["pipeline-source_mixing"]
    assert out and all(r["n_pieces"] == len(r["ids"]) for r in out)
    empty = str(tmp_path_factory.mktemp("empty"))
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_rows_of_one_id_stay_apart_from_the_driver(spark, monkeypatch):
    """However many rows share an id, no more than one of them is fitted on; odd labels are left out."""
    texts = [prose(i, 60) for i in range(30)]
    docs = make(spark, texts).unionByName(spark.createDataFrame([(3, f"copy {i} {texts[3]}", "en", "s", 1, "x", "y", "z") for i in range(3000)], SCHEMA))
    labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate([0, 1, 2, -1, -3, 1, 0] * 4)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality_classifier, "train", lambda sets, y: seen.append(list(y)) or (np.zeros(1 << 18), 0.0, 1.0, 0.0, np.zeros(1 << 18)))
    quality_classifier.fit(docs, labels)
    assert set(seen[0]) == {0, 1} and len(seen[0]) <= 30
    monkeypatch.setattr(language_id, "train", lambda vectors, langs: seen.append(langs))
    language_id.fit(docs)
    assert len(seen[1]) <= 30
    monkeypatch.setattr(quality_rules, "learn", lambda rows: seen.append(rows) or [])
    quality_rules.learn_from(docs, labels)
    assert len(seen[2]) <= 30
    assert quality_classifier.classify(docs, labels).count() == 3030
