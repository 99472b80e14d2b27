"""Operators over documents against brute force, the tokenizers library or held-out labels."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordant.llm import bpe, common, decontaminate, exact_dedup, language_id, near_dedup
from accordant.llm import components as components_module
from accordant.llm.common import table
from accordant.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `digest` string, label string"
ODD = [(1, None, None, None, None, "x", None), (2, "", "en", "a", 0, None, "y"), (None, "one two three four five six", "en", "a", 1, "x", "y"), (4, "one two three four five six", "en", "a", 1, "x", "y"), (4, "one two three four five six", "en", "a", 1, "x", "y"), (5, "12345 !!!", "de", None, 9, "x", "y"), (6, "word " * 60_000, "en", "a", 300_000, "x", "y"), (7, "a b", "fr", "b", 3, "x", "y")]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_bpe_equals_the_library(spark, sf):
    tokenizers = pytest.importorskip("tokenizers")
    known, own = tokenizers.Tokenizer.from_file(bpe.vocabulary_path()), bpe.load(bpe.vocabulary_path())
    draw = random.Random(3)
    texts = ["", "Σας ΣΑΣ", "İ ﬁ ½ ² ٣٤", "a\x1cb \x85c", "x<|endoftext|>y <|startoftext|>", "it's WE'RE 'S''ll", "é 日本語 👩‍👩‍👧", "a" * 3000, "ab" * 999, "　x y", "\0 q"]
    texts += ["".join(chr(draw.choice([draw.randrange(128), draw.randrange(0x500), draw.randrange(0x3040, 0x9FFF)])) for _ in range(draw.randrange(40))) for _ in range(300)]
    for text in texts:
        if any(0x500 > ord(c) and bpe.unicodedata.category(c) == "Cn" for c in text):
            continue
        ids = known.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids, text
        assert own.decode(own.encode(text)) == known.decode(ids, skip_special_tokens=False)
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    for r in bpe.op2_bpe(spark, sf).collect():
        ids = known.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(known.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_segment_tree_equals_plain_merging():
    own, draw = bpe.load(bpe.vocabulary_path()), random.Random(1)
    for _ in range(300):
        word = "".join(draw.choice("aeinrst") for _ in range(draw.randrange(1, 30)))
        symbols = [own.first[b] for b in word.encode()[:-1]] + [own.last[word.encode()[-1]]]
        while len(symbols) > 1:
            rank, i = min((own.merges.get(a << 20 | b, bpe.NONE), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
            if rank == bpe.NONE:
                break
            symbols[i : i + 2] = [own.merged[rank >> bpe.PLACE_BITS]]
        assert own.encode_word(word) == symbols


def test_bpe_odd_rows(odd):
    assert bpe.encode_documents(odd.limit(0)).count() == bpe.token_digests(odd.limit(0)).count() == 0
    got = {r.doc_id: r.n_tokens for r in bpe.encode_documents(odd).collect()}
    assert got[1] == got[2] == 0 and got[6] == 60_000


def test_exact_copies(spark, odd, monkeypatch):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 40}") for i in range(300)] + [(None, "hot"), (None, None), (900, ""), (901, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (4, 1000):
        monkeypatch.setattr(exact_dedup, "HOT", hot)
        got = exact_dedup.exact_copies(docs).collect()
        assert len(got) == len(rows)
        groups = Counter(t or "" for _, t in rows)
        best = {k: max((i for i, t in rows if (t or "") == k and i is not None), default=None) for k in groups}
        texts = {hashlib.sha256(k.encode()).hexdigest(): k for k in groups}
        for r in got:
            k = texts[r.text_sha256]
            assert (r.keep_id, r.group_size, r.kept) == (best[k], groups[k], r.doc_id == best[k])
        left = exact_dedup.drop_exact_copies(docs).collect()
        assert sorted(r.doc_id for r in left) == sorted(best.values())
    assert exact_dedup.drop_exact_copies(odd).count() == 5
    assert exact_dedup.exact_copies(odd.limit(0)).count() == 0
    assert exact_dedup.exact_copies(docs).filter("keep_id = 901").count() == 3


def test_language_held_out(spark, sf):
    sf = sf.replace("0.001", "0.01")
    truth = {r.doc_id: r.lang for r in table(spark, sf, "documents").collect()}
    got = language_id.op7_language_id(spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) <= 0.01 * len(got)


def test_language_odd_rows(odd, spark):
    model = language_id.Centroids(["the cat and the dog"] * 3 + ["le chat et le chien"] * 3, ["en"] * 3 + ["fr"] * 3)
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in language_id.languages(odd.select("doc_id", "text"), model).collect()]
    assert {(1, "und", True), (2, "und", True), (5, "und", True)} <= set(got) and len(got) == len(ODD)
    none = language_id.fit(spark.createDataFrame([], SCHEMA))
    assert {r.lang_pred for r in language_id.languages(odd.select("doc_id", "text"), none).collect()} == {"und"}
    assert language_id.keep_known(odd).columns == odd.columns


def test_language_equals_slow_cosine():
    """The prediction against centroids compared one by one, on n-grams counted with plain dictionaries."""
    draw = random.Random(9)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["ne", "ri", "lo"], "cc": ["su", "ta", "ne"]}
    say = lambda lang, n: " ".join("".join(draw.choice(syllables[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(n))
    langs = [lang for lang in syllables for _ in range(12)]
    model = language_id.Centroids([say(lang, 40) for lang in langs], langs)
    texts = [say(lang, draw.randrange(1, 60)) for lang in syllables for _ in range(10)] + ["x", "Ünïcode ß", "123 lo"]
    lang, score, _ = model.predict(texts)
    for k, text in enumerate(texts):
        one = language_id.Centroids.counts([text])[0]
        low = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower())
        grams = Counter(low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1))
        assert one.sum() == sum(grams.values())  # each n-gram is counted in one place
        v = [c**0.5 * i for c, i in zip(one.tolist(), model.idf.tolist())]
        size = sum(x * x for x in v) ** 0.5
        cosines = [sum(a * b for a, b in zip(v, center.tolist()) if a) / size for center in model.centers]
        assert max(cosines) == pytest.approx(score[k], abs=1e-4) and cosines[model.langs.index(lang[k])] <= max(cosines) + 1e-9
        assert max(c for c, own in zip(cosines, model.langs) if own == lang[k]) == pytest.approx(max(cosines), abs=1e-5)


def test_sample_does_not_depend_on_partitioning(spark):
    from accordant.llm.common import bounded_sample

    rows = [(k, f"t{k}", "abc"[min(2, k % 7)]) for k in range(7000)] + [(5, "again", "a")] * 400 + [(None, "n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    first = bounded_sample(docs.repartition(3), "doc_id", 500, "kind")
    assert first == bounded_sample(docs.repartition(11, "text"), "doc_id", 500, "kind")
    assert Counter(r.kind for r in first) == {"a": 500, "b": 500, "c": 500}
    assert Counter(r.kind for r in bounded_sample(docs, "doc_id", 500, "kind", most=90)) == {"a": 30, "b": 30, "c": 30}
    assert len(bounded_sample(docs, "doc_id", 10_000)) == 7401 and bounded_sample(docs.limit(0), "doc_id", 5, "kind") == []
    alone = bounded_sample(docs, "doc_id", 40)
    assert alone == bounded_sample(docs.repartition(5), "doc_id", 40) and len(alone) == 40


def brute_longest(text, items):
    doc, best = decontaminate.words(text), None
    for k, t in items:
        w = decontaminate.words(t)
        for i in range(len(w)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(w) and j + n < len(doc) and w[i + n] == doc[j + n]:
                    n += 1
                if n and n >= min(10, len(w)) and (best is None or (-n, str(k), i, j) < best):
                    best = (-n, str(k), i, j)
    return (-best[0], *best[1:]) if best else (0, None, 0, 0)


def brute_hits(text, items):
    doc, marks, ids = decontaminate.words(text), set(), set()
    for k, t in items:
        w = decontaminate.words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for j in range(len(doc) - n + 1):
                if doc[j : j + n] == w[i : i + n]:
                    marks.update(range(j, j + n))
                    ids.add(str(k))
    return len(doc), len(marks), ",".join(sorted(ids))


@pytest.mark.parametrize("block", [16 << 20, 300])
def test_decontamination(spark, odd, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    draw = random.Random(2)
    items = [(k, " ".join(draw.choice("ab") for _ in range(draw.choice([1, 4, 9, 10, 11, 25])))) for k in range(8) if k] + [(20, None), (21, "--"), (3, "zz Zz É")]
    texts = [" ".join(draw.choice("abc") for _ in range(draw.randrange(0, 60))) for _ in range(40)] + [None, "", "x zz, ZZ é", "é " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.matches(docs, tests).collect():
        n, hit, ids = brute_hits(texts[r.doc_id], items)
        assert (r.n_words, sum(r.marks), ",".join(sorted(set(r.item_ids)))) == (n, hit, ids)
        assert (r.longest_match, r.longest_item, r.longest_item_word, r.longest_word) == brute_longest(texts[r.doc_id], items)
    assert decontaminate.drop_contaminated(odd, tests).columns == odd.columns
    assert decontaminate.drop_contaminated(odd, tests.limit(0)).count() == len(ODD)


def test_decontamination_equals_its_sql(spark, sf, tmp_path):
    import duckdb

    draw, con = random.Random(5), duckdb.connect()
    say = lambda n: " ".join(draw.choice("abc") for _ in range(n))
    items = [(k, say(draw.choice([3, 9, 12, 30, 45]))) for k in range(12)]
    docs = [(k, say(draw.randrange(1, 80)) + draw.choice(["", " Z ", items[k % 12][1]])) for k in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for folder, files in ((str(tmp_path), "/*.parquet"), (sf, "")):
        for t in ("documents", "benchmark"):
            con.execute(f"create or replace view {t} as select * from '{folder}/{t}.parquet{files}'")
        want = con.execute(decontaminate.SQL)
        names = [d[0] for d in want.description]
        got = decontaminate.op8_decontamination(spark, folder)
        assert sorted(got.columns) == sorted(names)
        assert sorted(map(repr, got.select(names).collect())) == sorted(map(repr, spark.createDataFrame(want.fetchall(), got.select(names).schema).collect()))


def test_memory_of_items_with_one_opening():
    import tracemalloc

    opening = " ".join(f"w{k}" for k in range(40))
    test = decontaminate.Test([(str(k), f"{opening} x{k} y{k}") for k in range(1500)])
    tracemalloc.start()
    rows = decontaminate.scan([f"{opening} z{k}" for k in range(400)], test)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(r[3:] == (40, "0", 0, 0) and len(r[2]) == 1500 for r in rows) and peak < 60e6


def jaccard(a, b):
    bag = []
    for t in (a, b):
        w = decontaminate.words(t)
        bag.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    low, high = sum((bag[0] & bag[1]).values()), sum((bag[0] | bag[1]).values())
    return low / high if high else float(a == b)


def test_near_classes(spark, odd):
    draw, texts = random.Random(4), []
    for _ in range(25):
        base = [draw.choice(["ka", "lo", "mi", "nu", "re"]) + str(draw.randrange(400)) for _ in range(120)]
        texts.append(" ".join(base))
        for _ in range(draw.randrange(6)):
            copy = list(base)
            for _ in range(draw.randrange(4)):
                copy[draw.randrange(120)] = "new"
            texts.append(" ".join(copy))
    texts += [texts[0], "a b", "a b", "", None, "a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    assert got == dict(enumerate(want))
    assert near_dedup.drop_near_copies(docs).count() == len(set(want))
    assert near_dedup.near_classes(odd).count() == len(ODD) and near_dedup.near_classes(odd.limit(0)).count() == 0
    assert near_dedup.drop_near_copies(odd.limit(0)).columns == odd.columns


def test_near_classes_of_shared_and_negative_ids(spark):
    draw = random.Random(2)
    base = [str(draw.randrange(10**6)) for _ in range(100)]
    one, two, other = " ".join(base), " ".join([*base[:99], "x"]), " ".join(base[::-1])
    rows = [(-5, one, "a"), (7, two, "b"), (7, other, "c"), (None, two, "d"), (None, "alone", "e"), (7, other, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own string")
    got = sorted(str((r.doc_id, r.class_id, r.class_size)) for r in near_dedup.near_classes(docs).collect())
    assert got == sorted(map(str, [(-5, -5, 3), (7, -5, 3), (7, 7, 2), (7, 7, 2), (None, -5, 3), (None, None, 1)]))
    assert sorted(r.own for r in near_dedup.drop_near_copies(docs).collect()) == ["a", "c", "e", "f"]


def test_family_of_two_thousand_copies(spark):
    """Copies at similarities round 0.8 of one text and of each other: the classes of all links that share a bucket."""
    draw, texts = random.Random(3), []
    base = [str(draw.randrange(10**6)) for _ in range(120)]
    vocabulary = [f"v{k}" for k in range(8)]
    for _ in range(2000):
        copy = list(base)
        for _ in range(draw.randrange(1, 9)):
            at = draw.randrange(len(copy))
            copy[at : at + 1] = draw.choice([[], [draw.choice(vocabulary)], [copy[at], draw.choice(vocabulary)]])
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    # all pairs by a product of shingle counts (hardly any shingle repeats within a text)
    rows, columns, known = [], [], {}
    for k, t in enumerate(texts):
        w = t.split()
        for i in range(len(w) - 4):
            rows.append(k), columns.append(known.setdefault(tuple(w[i : i + 5]), len(known)))
    x = np.zeros((len(texts), len(known)), "f4")
    np.add.at(x, (rows, columns), 1)
    n = x.sum(1)
    same = x @ x.T
    like = same >= near_dedup.LEAST * (n[:, None] + n[None, :] - same) - 1e-4
    keys = near_dedup.bands(near_dedup.signatures(len(texts), *near_dedup.bags(*near_dedup.shingles(texts))))
    meet = np.zeros(like.shape, bool)
    for band in keys.T:
        meet |= band[:, None] == band[None, :]
    want = np.arange(len(texts))
    while True:
        low = np.where(like & meet, want[None, :], len(texts)).min(1)
        if (low >= want).all():
            break
        want = np.minimum(want, low)
    assert got == dict(enumerate(want.tolist()))
    lost = like & ~meet
    assert lost.sum() <= 0.002 * like.sum()


def test_signatures_estimate_weighted_jaccard():
    draw, errors = np.random.default_rng(5), []
    for _ in range(40):
        a, b = draw.integers(0, 9, 60), draw.integers(0, 9, 60)
        b = np.where(draw.random(60) < 0.7, a, b)
        w = np.concatenate((a, b))
        doc, element = np.repeat([0, 1], 60), np.tile(near_dedup.mix(np.arange(60, dtype="u8")), 2)
        s = near_dedup.signatures(2, doc[w > 0], element[w > 0], w[w > 0], 512)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 300), (7, 300), (500, 501)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(41), 100, 200, 300], 0), 500: 500, 501: 500}


def test_components_shrink_from_round_to_round(spark, monkeypatch):
    """Chains of random numbers, rings and a star: the rounds together write a few times the links, not all of them in every round."""
    draw, written = random.Random(9), []
    node = draw.sample(range(-(10**6), 10**6), 4000)
    links = list(zip(node[:1500], node[1:1501])) + [(node[2000], n) for n in node[2001:3000]] + [(node[3000 + k], node[3000 + (k + 1) % 900]) for k in range(900)] + [(5, 5), (None, 7)]
    real = components_module.materialize
    monkeypatch.setattr(components_module, "materialize", lambda df: written.append(real(df)) or written[-1])
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {n: min(group) for group in (node[:1501], node[2000:3000], node[3000:3900]) for n in group}
    assert got == want
    sides = [n for n in ((t.count(), t.columns) for t in written) if n[1] == ["a", "b"]]
    assert sum(n for n, _ in sides) < 3 * sides[0][0] and len(sides) > 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "bpe":
            assert out.columns == docs.columns
            docs = out
    assert out.filter(F.size("ids") != F.col("n_tokens")).count() == 0 and out.count() == docs.count() > 0


def test_hidden_pair_in_a_bucket_of_unlike_nodes(spark):
    """The bound rules none out, and the pair comes after more leaders than two rounds have."""
    draw = random.Random(5)
    page = [f"w{draw.randrange(10**9)}" for _ in range(900)]
    blocks = [range(k, k + 20) for k in range(0, 900, 20)]

    def without(*gone):
        drop = {j for b in gone for j in blocks[b]}
        return [w for j, w in enumerate(page) if j not in drop]

    texts = [without(*draw.sample(range(45), 10)) for _ in range(52)]
    hidden = without(*range(20, 30)) + [f"a{k}" for k in range(12)]
    texts += [hidden, hidden[:-12] + [f"b{k}" for k in range(12)]]
    plain = [" ".join(t) for t in texts]
    every = [(i, j) for i in range(54) for j in range(i)]
    like = [jaccard(plain[i], plain[j]) >= near_dedup.LEAST for i, j in every]
    assert [p for p, x in zip(every, like) if x] == [(53, 52)]
    members = spark.createDataFrame([(1, k, 54, 54) for k in range(54)], "bucket long, node long, size long, mass long")
    texts = spark.createDataFrame(list(enumerate(plain)), "node long, text string")
    got, labels = near_dedup.links(members, lambda pairs: near_dedup.compared(pairs, texts), near_dedup.RATIO)
    assert [(r.a, r.b) for r in got.collect()] == [(52, 53)]
    assert {(r.node, r.label) for r in labels.collect()} == {(52, 52), (53, 52)}


def test_pipeline_equals_brute_force(spark, sf):
    """Every stage on its own input: copies and near copies by all pairs, windows by plain sets, ids by the library."""
    import corpus_pipeline

    tokenizers = pytest.importorskip("tokenizers")
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    known = {r.doc_id for r in language_id.keep_known(table(spark, sf, "documents")).collect()}
    best = {}
    for k in known:
        best[docs[k]] = max(k, best.get(docs[k], k))
    left = sorted(best.values())
    label = {k: k for k in left}
    bags = {k: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for k in left if (w := decontaminate.words(docs[k]))}
    sizes = {k: sum(b.values()) for k, b in bags.items()}
    for a in bags:
        for b in bags:
            if a < b and min(sizes[a], sizes[b]) >= 0.8 * max(sizes[a], sizes[b]):
                same = sum((bags[a] & bags[b]).values())
                if same >= 0.8 * (sizes[a] + sizes[b] - same):
                    low, high = sorted((label[a], label[b]))
                    label = {k: low if v == high else v for k, v in label.items()}
    left = [k for k in left if label[k] == k]
    windows = set()
    for r in table(spark, sf, "benchmark").collect():
        w = decontaminate.words(r.text)
        windows |= {tuple(w[i : i + min(10, len(w))]) for i in range(len(w) - min(10, len(w)) + 1) if w}
    lengths = {len(x) for x in windows}

    def clean(text):
        w = decontaminate.words(text)
        return not any(tuple(w[i : i + n]) in windows for n in lengths for i in range(len(w) - n + 1))

    library = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    want = {k: library.encode(docs[k], add_special_tokens=False).ids for k in left if clean(docs[k])}
    assert {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf).collect()} == want


def test_pipeline_stages_on_odd_and_empty_rows(spark, sf, odd):
    import corpus_pipeline

    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name == "bpe":
                assert out.count() == docs.count()
            else:
                assert out.columns == docs.columns and out.count() <= docs.count()
    # a document that is repeated stays with all its rows; copies under other ids or none go
    assert sorted(str(r.doc_id) for r in near_dedup.drop_near_copies(odd).collect()) == sorted(map(str, [1, 4, 4, 5, 6, 7]))


def test_labels_meet_no_texts(spark, monkeypatch):
    """Beyond the size of a broadcast, too, no text is shuffled to find the sample, which is the same; ids that repeat are in it as often as before."""
    from accordant.llm import toxicity

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(k % 300, f"text {k}") for k in range(400)], "doc_id long, text string")
        labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id long, toxic int")
        known = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
        want = toxicity.bounded_sample(docs.join(known, "doc_id").select("doc_id", "text", "toxic"), "doc_id", 50, per="toxic")
        seen, plain, fitted = [], toxicity.bounded_sample, []
        monkeypatch.setattr(toxicity, "bounded_sample", lambda df, *rest, **more: (seen.append(df), plain(df, *rest, **more))[1])
        monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 50)
        monkeypatch.setattr(toxicity, "Bag", lambda texts, toxic: fitted.extend(zip(texts, toxic)))
        toxicity.fit(docs, labels)
        assert fitted == [(r.text, r.toxic) for r in want] and len(fitted) == 100
        for df in seen:
            assert "text" not in df.columns or "hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
        assert any("text" in df.columns for df in seen)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_a_kept_text_is_sent_once(spark):
    """Rows go to Python with their text in the kept struct only, whatever slices and nulls they come in."""
    docs = spark.createDataFrame([(k, None if k % 7 == 0 else f"text {k}" if k % 3 else "12", "x") for k in range(50)], "doc_id long, text string, __letters string").repartition(3)
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    out = common.over_texts(rows, lambda texts: {"n": [len(t or "") for t in texts]}, "n long", ["doc"], 40, ("doc/text",))
    assert {(r.doc.doc_id, r.n) for r in out.collect()} == {(r.doc_id, len(r.text or "")) for r in docs.collect()}
    sent = language_id.keep_known(docs.withColumn("lang", F.lit("a")))._jdf.queryExecution().analyzed().toString()
    assert "__told" not in sent and "MapInArrow" in sent
    assert next(line for line in sent.splitlines() if "__row" in line and "Project" in line and "AS __row" in line).count("text#") == 0
