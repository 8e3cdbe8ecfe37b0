"""Repeated rows, clashing names, very long texts, ties and empty tables; registered queries on a small folder; an independent Kneser-Ney."""

import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docveil.llm import bm25, dartminhash, kmtree, kneserney, langid, linededup, packing, queries, sapieces, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(43)
WORDS = ["".join(RNG.choices("abcdefghijklmnopqrstuvwxyz", k=RNG.randint(2, 8))) for _ in range(300)]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with all tables: odd rows, copies and extra columns named like columns used inside."""
    rng, folder = random.Random(47), tmp_path_factory.mktemp("small")
    rows = [(i, prose(rng, rng.randint(5, 60)) + "\nlast line", "en", f"s{i % 12}", 1) for i in range(100)]
    rows += [(200 + i, rows[i][1], "en", "t", 1) for i in range(10)] + [rows[3], rows[3], (None, None, None, None, None), (301, "", "xx", "a", 0), (302, None, None, None, None), (303, "!!!", None, "b", 3), (304, prose(rng, 20_000), "en", None, None), (None, "a text without an id of its own", "en", "c", 1)]
    d = spark.createDataFrame(rows, DOCS)
    for c in ("uid", "hash", "keys", "shard", "gone", "salt", "__kept", "__uid", "__gone"):
        d = d.withColumn(c, F.lit(c))
    d.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 10 == 0)) for i in range(100)] + [(5, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    nrng = np.random.default_rng(8)
    spark.createDataFrame([(i, [float(x) for x in nrng.normal(size=4)]) for i in range(301)] + [(400, None)], "vec_id long, embedding array<double>").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(k, f"https://h.example/{k % 9}", f"<div>Site</div><article><p>Text {k}</p></article>") for k in range(40)] + [(None, None, None)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_registered_queries(spark, small):
    """Every opN query on the small folder, one row for each row that its contract asks for."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    n = docs.count()
    for name, query in queries.queries().items():
        rows = query(spark, small).collect()
        if name in ("op1_quality", "op3_language", "op4_toxicity", "op7_line_dedup", "op8_sentencepiece", "op10_near_duplicates"):
            assert len(rows) == n, name
        if name == "op2_neighbours":
            assert Counter(r["query_id"] for r in rows) == {0: 10, 100: 10, 200: 10, 300: 10}
        if name == "op5_search":
            asked = {r["doc_id"] for r in docs.where("doc_id % 20 = 0 and text is not null and text <> ''").collect()}
            assert {r["query_id"] for r in rows} == asked and all(r["rank"] <= 10 for r in rows)
        if name == "op6_packing":
            assert sum(r["piece"] == 0 for r in rows) == n
        if name == "op9_html":
            assert len(rows) == 41 and {r["text"] for r in rows} == {f"Text {k}" for k in range(40)} | {""}
        if name == "op10_near_duplicates":
            got = {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] is not None}
            assert all(got[200 + i] == i for i in range(10)) and got[304] == 304


def test_pipeline_takes_odd_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), docs.schema)
    kept = {r["doc_id"] for r in docs.collect()}
    assert not kept & {301, 302, *range(200, 210)}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r["doc_id"] for r in packed} == kept


def test_repeated_rows_have_the_quality_of_one(spark):
    rng = random.Random(53)
    rows = [(i, prose(rng, 40), "en", "a", 1) for i in range(60)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)], "doc_id long, quality int")
    one = spark.createDataFrame(rows, DOCS)
    once = {r["doc_id"]: r for r in kneserney.classify(one, labels).collect()}
    four = kneserney.classify(one.unionByName(spark.createDataFrame([rows[1]] * 3, DOCS)), labels).where("doc_id = 1").collect()
    assert len(four) == 4 and all(r["chars"] == once[1]["chars"] == len(rows[1][1]) and abs(r["perplexity"] - once[1]["perplexity"]) < 1e-9 for r in four)


def test_kneser_ney_against_plain_dictionaries():
    """Interpolated modified Kneser-Ney from its formula (Chen and Goodman), with no code of the module."""
    rng, k = random.Random(59), kneserney.K
    symbols = [min(int(rng.paretovariate(0.9)), 63) for _ in range(1500)]
    tri = Counter(zip(symbols, symbols[1:], symbols[2:], strict=False))
    two, one = Counter(), Counter()
    for _, v, w in tri:
        two[v, w] += 1
    for _, w in two:
        one[w] += 1

    def cut(counts):
        n = [0, *(sum(c == i for c in counts) for i in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2])
        return [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]

    d3, d2, d1 = cut(tri.values()), cut(two.values()), cut([*one.values()])
    after3, after2 = defaultdict(list), defaultdict(list)
    for (u, v, _), c in tri.items():
        after3[u, v].append(c)
    for (v, _), c in two.items():
        after2[v].append(c)

    def p1(w):
        total, back = sum(one.values()), sum(d1[min(c, 3)] for c in one.values())
        return ((one[w] - d1[min(one[w], 3)]) + back / k) / total

    def p2(v, w):
        if not after2[v]:
            return p1(w)
        return (two[v, w] - d2[min(two[v, w], 3)] + sum(d2[min(c, 3)] for c in after2[v]) * p1(w)) / sum(after2[v])

    def p3(u, v, w):
        if not after3[u, v]:
            return p2(v, w)
        return (tri[u, v, w] - d3[min(tri[u, v, w], 3)] + sum(d3[min(c, 3)] for c in after3[u, v]) * p2(v, w)) / sum(after3[u, v])

    counts = np.zeros(k**3)
    for (u, v, w), c in tri.items():
        counts[(u * k + v) * k + w] = c
    got = kneserney.log_probabilities(counts)
    assert all(0.05 <= d[i] <= i - 0.05 for d in (d1, d2, d3) for i in (1, 2, 3))  # discounts that need no bounds
    for u, v, w in [*list(tri)[:200], *[(rng.randrange(64), rng.randrange(64), rng.randrange(64)) for _ in range(400)]]:
        assert abs(got[(u * k + v) * k + w] - math.log(p3(u, v, w))) < 1e-4


def test_long_text_without_blanks():
    import public_tokenizers
    import sentencepiece

    vocab, rng = sapieces.vocabulary(None), random.Random(61)
    text = "".join(rng.choices("ethaoinsrdlu", k=200_000))
    began = time.time()
    ids = sapieces.encode_texts([text], vocab)[0]
    assert time.time() - began < 30 and sapieces.decode_ids(ids.tolist(), vocab) == text
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for n in (63, 64, 65, 500, 5000):
        part = text[:n] + " é漢" + text[:n]
        assert sapieces.encode_texts([part], vocab)[0].tolist() == sp.encode(part)


def test_special_tokens_as_the_library(spark):
    import public_tokenizers
    import tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "<|endoftext|", "plain"]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["ids_crc32"] for r in rows} == {k: packing.crc_of_ids(np.array([*t.encode(x, add_special_tokens=False).ids, 0])) for k, x in enumerate(texts)}


def test_vectors_of_another_length_ask_nothing(spark):
    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<double>")
    other = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert kmtree.search(table, other).count() == 0 and kmtree.search(table.where("false"), table).count() == 0


def test_any_number_of_languages(spark):
    rows = [(i, f"text of language {i}", f"l{i % 700:03}", "a", 1) for i in range(1400)]
    model = langid.train(spark.createDataFrame(rows, DOCS))
    assert len(model.langs) > 550
    assert langid.features(["\U00030000\U00030001"])[1][-1] > 0  # letters beyond the first three planes
    tie = langid.Model(["a", "b"], np.ones(2**langid.BITS), np.zeros((2**langid.BITS + 1, 2)))
    got = langid.predict(spark.createDataFrame(rows[:3], DOCS), tie).collect()
    assert {r["lang_pred"] for r in got} == {"a"} and all(abs(r["score"] - 0.5) < 1e-9 for r in got)


def test_rows_that_share_an_id_and_not_a_text(spark):
    a, b = "one text of eight words stands here now", "quite another text has been written down below"
    d = spark.createDataFrame([(5, a), (9, a), (3, b), (5, b), (None, a), (None, "")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in dartminhash.classes(d).collect()) == [(0, 0), (0, 5), (3, 3), (5, 3), (5, 5), (9, 5)]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in dartminhash.one_of_each(d).collect()) == [(0, ""), (3, b), (5, a)]


def test_weights_decide_links(spark):
    """Shingles count as often as they occur: a repeated passage is another text, but not by sets."""
    base = prose(random.Random(67), 40)
    d = spark.createDataFrame([(1, base), (2, " ".join([base] * 4))], "doc_id long, text string")
    assert {r["class_id"] for r in dartminhash.classes(d).collect()} == {1, 2}
    assert {r["class_id"] for r in dartminhash.classes(d, weighted=False).collect()} == {1}


def test_bounds_drop_no_similar_pair():
    """Sizes, parities and own shingles never rule out a pair at the similarity."""
    rng = np.random.default_rng(71)
    for _ in range(300):
        n = int(rng.integers(5, 300))
        a = np.unique(rng.integers(0, 2**62, n).astype(np.uint64))
        k = int(rng.integers(0, len(a) // 4 + 1))
        b = np.unique(np.concatenate([a[k:], rng.integers(0, 2**62, int(rng.integers(0, k + 1))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        differ = int(np.bitwise_count((dartminhash.parities(a) ^ dartminhash.parities(b)).view(np.uint64)).sum())
        assert differ <= len(a) + len(b) - 2 * common
        if common >= 0.8 * (len(a) + len(b) - common):
            assert differ <= (len(a) + len(b)) * 0.2 / 1.8 + 1e-9 and min(len(a), len(b)) >= 0.8 * max(len(a), len(b))


def test_columns_inside_never_clash(spark):
    names = ["uid", "gone", "hash", "__uid", "__gone", "__kept", "__key", "v", "kind", "number", "salt", "lines_removed"]
    d = spark.createDataFrame([(i, f"line one\nown line {i} of this text here", "en", f"s{i}", 1) for i in range(15)], DOCS)
    for c in names:
        d = d.withColumn(c, F.lit(c))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(15)], "doc_id long, quality int, toxic int")
    out = linededup.remove_boilerplate(d)
    assert set(d.columns) < set(out.columns) and all(r[c] == c for r in out.collect() for c in names)
    for kept in (kneserney.keep_good(d, labels), dartminhash.one_of_each(d), toxicity.keep_clean(d, toxicity.train(d, labels))):
        assert kept.columns == d.columns and all(r[c] == c for r in kept.collect() for c in names)


def test_search_adds_up_rows_that_share_an_id(spark):
    rows = [(1, "alpha beta"), (1, "alpha gamma"), (2, "alpha"), (3, "delta"), (4, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    whole = spark.createDataFrame([(1, "alpha beta alpha gamma"), (2, "alpha"), (3, "delta")], "doc_id long, text string")
    got, want = ([tuple(r) for r in bm25.search(x, x).orderBy("query_id", "rank").collect()] for x in (d, whole))
    assert got == want
