"""The corpus operators against brute force, on small tables with nulls, empties, copies and ties."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docveil.llm import bm25, dartminhash, graph, kmtree, kneserney, langid, linededup, packing, pagediff, sapieces, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(5)
WORDS = ["".join(RNG.choices("abcdefghijklmnopqrstuvwxyz", k=RNG.randint(2, 8))) for _ in range(400)]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t) if t else None) for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty cells, wordless and long texts, repeated rows."""
    rng = random.Random(1)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "!!! ???", "en", None), (4, prose(rng, 30_000), None, "a"), (5, "one two", "en", "b"), (5, "one two", "en", "b"), (None, "no id here at all friend", "en", "c"), (6, "é漢字 ", "fr", "c")]
    return docs(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# packing


def test_pieces_and_sequences(spark, odd, empty):
    import tokenizers
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(odd).collect()
    for doc in odd.where("doc_id is not null").dropDuplicates().collect():
        ids = [*t.encode(doc["text"] or "", add_special_tokens=False).ids, 0]
        mine = sorted((r for r in rows if r["doc_id"] == doc["doc_id"]), key=lambda r: r["piece"])
        if doc["doc_id"] != 5:
            assert [r["start"] for r in mine] == list(np.cumsum([0, *[r["length"] for r in mine]])[:-1]) and sum(r["length"] for r in mine) == len(ids)
        assert all(packing.crc_of_ids(np.array(ids[r["start"] : r["start"] + r["length"]])) == r["ids_crc32"] for r in mine)
        assert all(r["length"] == 2048 for r in mine if r["piece"])
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by.values():
        held.sort()
        assert [o for o, _ in held] == list(np.cumsum([0, *[n for _, n in held]])[:-1]) and sum(n for _, n in held) <= 2048
    assert sum(r["doc_id"] == 5 for r in rows) == 2 and packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_swaps_reach_the_bound(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 1500) for _ in range(600)]
    first = packing.best_fit(sizes, 2048)
    bins = packing.swap_search([list(b) for b in first], sizes, 2048)
    assert sorted(i for b in bins for i in b) == list(range(600)) and all(sum(sizes[i] for i in b) <= 2048 for b in bins)
    assert len(bins) <= len(first) and len(bins) <= -(-sum(sizes) // 2048) + 1


def test_swaps_empty_a_bin():
    sizes = [6, 3, 5, 2, 4]  # bins of 10: best fit of a bad start is improved by exchanges
    bins = packing.swap_search([[0, 3], [2, 1], [4]], sizes, 10)
    assert len(bins) == 2 and sorted(i for b in bins for i in b) == list(range(5))


# line dedup


def test_lines_against_brute_force(spark, odd, empty):
    rng = random.Random(3)
    common, near, rare = "this line stands on every single site", "this line is seen on ten sites only", "this line is seen on nine sites only"
    rows = []
    for i in range(60):
        lines = [prose(rng, 6), prose(rng, 7)] + [common] + [near] * (i % 20 < 10) + [rare] * (i % 20 < 9) + ["short"]
        rows.append((i, "\n".join(lines), "en", f"s{i % 20}"))
    copy = prose(rng, 9) + "\n" + prose(rng, 9)
    rows += [(100 + i, copy, "en", f"s{i}") for i in range(20)]
    got = {r["doc_id"]: r for r in linededup.remove_boilerplate(docs(spark, rows).withColumn("hash", F.lit(1)).withColumn("pos", F.lit(2))).collect()}
    for i, text, _, _ in rows:
        keep = [x for x in text.split("\n") if x not in (common, near) or i == 0]
        assert got[i]["text"] == "\n".join(keep) and got[i]["lines_removed"] == len(text.split("\n")) - len(keep) and got[i]["hash"] == 1
    same = {r["doc_id"]: r["text"] for r in linededup.remove_boilerplate(odd).collect()}
    assert same[1] is None and same[2] == "" and linededup.remove_boilerplate(odd).count() == odd.count() and linededup.remove_boilerplate(empty).count() == 0


# near duplicates


def shingles(text):
    w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_classes_against_brute_force(spark, odd, empty):
    rng = random.Random(7)
    rows, n = [], 0
    passage = prose(rng, 60)
    for _ in range(25):
        words = prose(rng, rng.randint(6, 300)).split()
        for k in range(rng.randint(1, 6)):
            own = list(words)
            for _ in range(k * len(words) // 150):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            rows.append((n, " ".join(own) + (" " + passage if rng.random() < 0.4 else ""), "en", "a"))
            n += 1
    rows += [(n + k, rows[0][1].upper(), "en", "b") for k in range(5)]
    sets = {i: shingles(t) for i, t, *_ in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    for weighted in (False, True):
        got = {r["doc_id"]: r["class_id"] for r in dartminhash.classes(docs(spark, rows), weighted=weighted).collect()}
        assert got == {i: find(i) for i in sets}
    one = dartminhash.one_of_each(docs(spark, rows))
    assert {r["doc_id"] for r in one.collect()} == {find(i) for i in sets} and one.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in dartminhash.classes(odd).collect()) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (5, 5), (6, 6)]
    assert dartminhash.one_of_each(odd).count() == 7 and dartminhash.classes(empty).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    e = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.uniform(0.1, 5, 60), rng.uniform(0.1, 5, 60)
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((dartminhash.signature(e, a, 2000) == dartminhash.signature(e, b, 2000)).mean() - truth) < 0.05


def test_components(spark):
    edges = [(k, k + 1) for k in range(20, 40)] + [(1, 7), (7, 3), (3, 1), (9, 9)]
    got = {r["v"]: r["c"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 20 for k in range(20, 41)}, 1: 1, 7: 1, 3: 1}


# search


def test_bm25_against_brute_force(spark, odd, empty):
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randint(1, 120)), "en", "a") for i in range(300)] + [(300 + k, "same words in each copy", "en", "a") for k in range(15)]
    counts = {i: Counter(t.split()) for i, t, *_ in rows}
    df, n = Counter(w for c in counts.values() for w in c), len(rows)
    average = sum(sum(c.values()) for c in counts.values()) / n
    found = {}
    d = docs(spark, rows)
    for r in bm25.search(d, d.where("doc_id % 20 = 0"), shard_docs=70).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["doc_id"], round(r["score"], 9)))
    for q in range(0, 315, 20):
        score = {}
        for i, c in counts.items():
            length = sum(c.values())
            s = sum(m * math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length / average)) for w, m in counts[q].items() if w in c)
            if s > 0:
                score[i] = s
        best = sorted(score, key=lambda i: (-round(score[i], 9), i))[:10]
        assert [i for i, _ in found[q]] == best and np.allclose([s for _, s in found[q]], [score[i] for i in best])
    assert {r["query_id"] for r in bm25.search(odd, odd).collect()} == {4, 5, 6} and bm25.search(empty, empty).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 8))
    x[700:] = x[700]  # copies
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)] + [(1500, None), (1501, [0.0] * 8), (1502, [float("nan")] * 8), (1503, [1.0]), (1504, [1.0, None] + [1.0] * 6), (None, [1.0] * 8)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in kmtree.search(d, d.where("vec_id % 100 = 0"), sample=600).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 1500, 100):
        dist = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        dist[q] = np.inf
        best = np.lexsort((np.arange(1500), dist))[:10]
        hit += len({i for i, _ in got[q]} & set(best.tolist()))
        assert len(got[q]) == 10 and all(s == dist[i] for i, s in got[q]) and got[q] == sorted(got[q], key=lambda p: (p[1], p[0]))
    assert hit >= 0.9 * 150
    few = d.where("vec_id < 4")
    assert kmtree.search(few, few.where("vec_id = 0")).count() == 3 and kmtree.search(d.where("false"), d.where("false")).count() == 0


# SentencePiece


def test_pieces_match_the_library(spark, odd, empty):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    vocab = sapieces.vocabulary(None)
    rng = random.Random(9)
    texts = ["", " ", "  a  b ", "a\n\nb\t", "naïve café 漢字 😀", "x" * 300, prose(rng, 5000)] + ["".join(rng.choices("ab ▁é漢\n", k=40)) for _ in range(50)]
    for t, ids in zip(texts, sapieces.encode_texts(texts, vocab), strict=True):
        assert ids.tolist() == sp.encode(t)
        assert "▁" in t or sapieces.decode_ids(ids.tolist(), vocab) == t
    back = sapieces.decode(sapieces.encode(odd)).where("doc_id is not null")
    assert sorted(map(repr, (tuple(r) for r in back.collect()))) == sorted(map(repr, (tuple(r) for r in odd.where("doc_id is not null").select("doc_id", "text").collect())))
    assert sapieces.round_trip(empty).count() == 0


# classifiers


def two_languages(rng, i):
    vowels = "aeiou" if i % 2 else "yöäüé"
    return " ".join("".join(rng.choice("bcdfgklmnprst") + rng.choice(vowels) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60)))


def test_language(spark, odd, empty):
    rng = random.Random(13)
    d = docs(spark, [(i, two_languages(rng, i), "xx" if i % 2 else "yy", "a") for i in range(400)])
    rows = langid.predict(d, model := langid.train(d)).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 40 and sum(r["lang_pred"] == ("xx" if r["doc_id"] % 2 else "yy") for r in held) >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in rows)
    found = {r["doc_id"]: r["lang_pred"] for r in langid.predict(odd, model).collect()}
    assert found[1] == found[2] == found[3] == "und" and found[6] != "und"
    assert {r["lang_pred"] for r in langid.predict(odd, langid.train(empty)).collect()} == {"und"}


def test_toxicity(spark, odd, empty):
    rng = random.Random(17)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        words = prose(rng, 60).split()
        if toxic:
            words[7:7] = ["idiot", "zqxvor" + rng.choice("abc")]
        rows.append((i, " ".join(words), "en", "a"))
        labels += [(i, 1, int(toxic))] * (1 + i % 2)
    d, marks = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(d, marks)
    got = [r for r in toxicity.predict(d, model).collect() if r["held_out"]]
    assert all(r["predicted"] == (r["doc_id"] % 8 == 0) for r in got) and any(v.startswith(" zqxv") for v in model.voters)
    clean = toxicity.keep_clean(d, model)
    assert clean.columns == d.columns and clean.count() == 350
    assert all(0 <= r["score"] < 0.5 for r in toxicity.predict(odd, model).collect()) and toxicity.keep_clean(empty, model).count() == 0
    base = toxicity.train(d, marks.where("false"))
    assert toxicity.predict(docs(spark, [(1, "You idiot", "en", "a")]), base).first()["predicted"] == 1


def brute_labels(votes, balance):
    """The label model with plain loops: posteriors, accuracies, shares."""
    n, k = len(votes), len(votes[0])
    accuracy, share = [toxicity.ACCURACY] * k, [1.0] * k
    s = lambda z: 1 / (1 + math.exp(-min(30, max(-30, z))))
    for round_ in range(toxicity.ROUNDS):
        evidence = [sum(share[j] * (math.log(accuracy[j] / (1 - accuracy[j])) - math.log(balance / (1 - balance))) for j in range(k) if row[j]) for row in votes]
        low, high = -60.0, 60.0
        for _ in range(60):
            m = (low + high) / 2
            low, high = (low, m) if sum(s(e + m) for e in evidence) / n > balance else (m, high)
        q = [s(e + (low + high) / 2) for e in evidence]
        for j in range(k):
            hit = [q[i] for i in range(n) if votes[i][j]]
            accuracy[j] = min(0.99, max(balance + 1e-3, (sum(hit) + toxicity.STRENGTH * toxicity.ACCURACY) / (len(hit) + toxicity.STRENGTH)))
        if round_ % 5 == 4:
            rate = [[sum(w[i] * votes[i][j] for i in range(n)) / max(sum(w), 1e-9) for j in range(k)] for w in (q, [1 - x for x in q])]
            left = [[votes[i][j] - q[i] * rate[0][j] - (1 - q[i]) * rate[1][j] for j in range(k)] for i in range(n)]
            sd = [math.sqrt(sum(r[j] ** 2 for r in left) / n) + 1e-9 for j in range(k)]
            c = [[1.0 if a == b else sum(r[a] * r[b] for r in left) / n / sd[a] / sd[b] for b in range(k)] for a in range(k)]
            share = [1 / sum(x for x in row if x > toxicity.SAME_VOTE) for row in c]
    return q, accuracy, share


def test_label_model_against_brute_force():
    rng = np.random.default_rng(3)
    y = rng.random(400) < 0.3
    one, other = (y & (rng.random(400) < 0.8)) | (rng.random(400) < 0.02), (y & (rng.random(400) < 0.6)) | (rng.random(400) < 0.05)
    votes = np.column_stack([one, one, one, other, rng.random(400) < 0.1])
    q, accuracy, share = toxicity.label_model(votes, 0.3)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip((q, accuracy, share), brute_labels(votes.tolist(), 0.3), strict=True))
    assert share[0] < 0.5 and share[3] > 0.8 and accuracy[4] < accuracy[3] - 0.1 and abs(q.mean() - 0.3) < 1e-3


def test_posteriors_not_labels_train_the_classifier():
    """Ablation: a label that no voter supports is overruled, and training on labels gives another classifier."""
    rng = random.Random(37)
    toxic = [" ".join([*rng.choices(WORDS, k=20), *rng.sample(["idiot", "moron", "trash"], k=2)]) for _ in range(120)]
    clean = [prose(rng, 22) for _ in range(600)]
    rows = [(t, 1) for t in toxic[:110]] + [(t, 0) for t in toxic[110:]] + [(t, 0) for t in clean[:590]] + [(t, 1) for t in clean[590:]]
    model = toxicity.train_on(rows)
    q = model.seen["posterior"]
    assert (q[:120] > 0.5).all() and (q[120:] < 0.5).all()  # the ten false labels of each kind are seen through
    counts, words = toxicity.find([toxicity.folded(t) for t, _ in rows], toxicity.automaton(model.voters), len(model.voters))
    x = toxicity.inputs(counts, words)
    by_labels = toxicity.logistic(x, np.array([float(k) for _, k in rows]), np.array([2.0] * (x.shape[1] - 1) + [0.0]))
    sure = lambda w: np.abs(toxicity.sigmoid(x[:120] @ w) - 1).mean()
    assert np.abs(by_labels - model.weights).max() > 0.1 and sure(model.weights) < sure(by_labels)


def test_kneser_ney_is_a_distribution():
    rng = np.random.default_rng(6)
    counts = np.zeros(kneserney.K**3)
    np.add.at(counts, rng.integers(0, 3000, 20_000), 1)
    p = np.exp(kneserney.log_probabilities(counts).astype(float)).reshape(-1, kneserney.K)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4) and (p > 0).all()


def test_perplexity_against_brute_force(spark, odd, empty):
    rng = random.Random(19)
    rows = [(i, prose(rng, 80), "en", "a") for i in range(200)] + [(200 + i, "".join(rng.choices("#%&$!|@^~", k=300)), "en", "a") for i in range(10)]
    d, labels = docs(spark, rows), spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in kneserney.classify(d, labels).collect()}
    assert all(got[i]["keep"] == (i < 200) for i in got)
    log_p = kneserney.log_probabilities(kneserney.count_trigrams(d.where("doc_id < 200 and doc_id % 2 = 0").select("text")))
    table = kneserney.symbols()
    mean = {}
    for i, text, *_ in rows:
        s = [0, 0, *(int(table[ord(c)]) for c in text)]
        mean[i] = -sum(log_p[(s[k - 2] * 64 + s[k - 1]) * 64 + s[k]] for k in range(2, len(s))) / len(text)
    middle = sorted(mean[i] for i in range(0, 200, 2))[49]
    for i, text, *_ in rows:
        n = len(text)
        assert abs(math.log(got[i]["perplexity"]) - (mean[i] * n + middle * 300) / (n + 300)) < 0.01
    strange = {r["doc_id"]: r for r in kneserney.classify(odd, labels).collect()}
    assert not strange[1]["keep"] and not strange[2]["keep"] and kneserney.classify(odd, labels).count() == odd.count() and kneserney.classify(empty, labels).count() == 0


# pages


def test_pages(spark):
    page = lambda body: f"<html><head><title>t</title><style>p{{}}</style></head><body>{body}</body></html>"
    article = page('<nav><a>Menu</a></nav><div class="ad">Buy</div><article><h1>T &amp; x</h1><p>One  <b>two</b>\nthree<br>four<script>var t="</p>";</script><p>Fünf &lt;6&gt;<aside>side</aside><section id="comments"><p>me</p></section></article><footer>f</footer>')
    plain = [page(f"<div>Site name</div><div>Same menu</div><p>Story {k}</p><p>More of {k}</p><div>All rights reserved</div>") for k in range(3)]
    rows = [(1, "https://a.example/x", article), (2, None, None), (3, "https://c.example/", ""), (4, "https://a.example/x", article)] + [(10 + k, f"https://b.example/s/{k}", h) for k, h in enumerate(plain)]
    got = {r["page_id"]: r for r in pagediff.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), partitions=1).collect()}
    assert got[1]["text"] == got[4]["text"] == "T & x\nOne two three four\nFünf <6>" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and got[2]["n_chars"] == 0
    assert [got[10 + k]["text"] for k in range(3)] == [f"Story {k}\nMore of {k}" for k in range(3)]
    assert pagediff.shared(list("abcde"), list("xbdye")) == {1, 3, 4}
    assert pagediff.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_shared_lines_against_brute_force():
    rng = random.Random(41)
    for _ in range(300):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 12))] for _ in range(2))
        gone = sorted(pagediff.shared(a, b))
        rest = iter(b)
        assert len(gone) == longest_common(a, b) and all(a[i] in rest for i in gone)


def test_differencing_decides_beside_articles(spark):
    """Unmarked template lines go and other lines stay, where a page has an article too; only links go inside of it."""
    body = "<div>The Daily Site</div><div>{k} readers now</div><article><h1>T{k}</h1><p>Shared paragraph</p><p><a href=x>Print</a> <a href=y>Share</a></p><p>Own {k}</p><p class=related-work>Related work {k}</p></article><div>Imprint and contact</div><div class='cookie-banner'>We use cookies {k}</div>"
    rows = [(k, f"https://a.example/n/{k}", body.format(k=k), "x") for k in range(40)]
    want = {k: f"{k} readers now\nT{k}\nShared paragraph\nOwn {k}\nRelated work {k}" for k in range(40)}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").withColumn("part", F.lit(1))
    for n in (1, 7, 60):  # borders between partitions don't matter
        assert {r["page_id"]: r["text"] for r in pagediff.extract(pages, partitions=n).collect()} == want
    alone = pagediff.extract(pages.where("page_id = 3")).first()["text"]
    assert alone.startswith("The Daily Site\n3 readers") and alone.endswith("Imprint and contact")  # no partner: nothing is shared
    copies = spark.createDataFrame([(k, "https://a.example/n/1", rows[1][2]) for k in range(3)] + [rows[2][:3]], "page_id long, url string, html string")
    assert {r["text"] for r in pagediff.extract(copies, partitions=1).where("page_id = 2 and url like '%/2'").collect()} == {want[2]}


def test_scanning_is_linear():
    import time

    hostile = ["<a " * 200_000, "<div>" * 100_000 + "</x>" * 100_000, '<a ">"' * 100_000, "<!--" * 100_000, "<li>" * 200_000, "<head>" * 100_000, "<p>x" * 200_000, "</div>" * 200_000, "<" * 200_000, "<b class='" * 100_000, "<div>" * 50_000 + "</div>" * 100_000, "&amp" * 200_000]
    for page in hostile:
        began = time.time()
        pagediff.lines(page)
        assert time.time() - began < 5, page[:20]
    assert pagediff.lines("a < b <p title='x > y'>c</p><p>d")[0] == ["a < b", "c", "d"]


# the pipeline


def test_pipeline_guards_and_stages(spark, tmp_path):
    import __spark_entry__
    import corpus_pipeline

    assert "pipeline" in __spark_entry__.queries() and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "line_dedup", "near_duplicates", "packing"]
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, "/root/testdata/sf0.001")
        assert out.columns == d.columns and out.dtypes == d.dtypes
        out.write.mode("overwrite").parquet(str(tmp_path / "s"))
        d = spark.createDataFrame(spark.read.parquet(str(tmp_path / "s")).collect(), d.schema)
        assert 100 < d.count() <= 200
    assert corpus_pipeline.STAGES[-1][1](spark, d, "").count() >= d.count()
